"""Schemas of the raw dumps and of the tables derived from them."""

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# The column headers of the two dump files, in file order.
SUBMISSIONS_CSV = _strings(
    "Post ID", "Title", "Url", "Author", "Score", "Publish Date",
    "Total No. of Comments", "Permalink", "Flair", "Selftext",
)
COMMENTS_CSV = _strings(
    "Comment ID", "Author", "Body", "Score", "Publish Date", "Permalink",
    "Submission ID", "Parent ID",
)

# The fields that the dumped JSON objects are read for.
SUBMISSION_JSON = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("created_utc", T.LongType()),
    T.StructField("num_comments", T.IntegerType()),
    T.StructField("permalink", T.StringType()),
    T.StructField("link_flair_text", T.StringType()),
    T.StructField("selftext", T.StringType()),
])
COMMENT_JSON = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("created_utc", T.LongType()),
    T.StructField("permalink", T.StringType()),
    T.StructField("link_id", T.StringType()),
    T.StructField("parent_id", T.StringType()),
])

SUBMISSIONS = T.StructType([
    T.StructField("submission_id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("n_comments", T.IntegerType()),
    T.StructField("content", T.StringType()),
])
COMMENTS = T.StructType([
    T.StructField("comment_id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("submission_id", T.StringType()),
    T.StructField("parent_id", T.StringType()),
])
ENTRIES = T.StructType([
    T.StructField("parent_id", T.StringType()),
    T.StructField("entry_id", T.StringType()),
    T.StructField("period", T.IntegerType()),
    T.StructField("comment_id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("date", T.DateType()),
    T.StructField("submission_id", T.StringType()),
    T.StructField("n_comments", T.IntegerType()),
])
