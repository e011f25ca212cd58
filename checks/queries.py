"""One query per operator, each over the driver's whole tables."""

from __future__ import annotations

import lzma
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as X
from threadstats import schemas
from threadstats.functions import columns as C
from threadstats.functions.text import descriptor_stop_words, descriptor_tokens
from threadstats.operators import classifier as B
from threadstats.operators import density as K
from threadstats.operators import descriptors as D
from threadstats.operators import entries as E
from threadstats.operators import forest as G
from threadstats.operators import intervals as T
from threadstats.operators import landmarks as A
from threadstats.operators import medoids as M
from threadstats.operators import neighbours as N
from threadstats.operators import periods as P
from threadstats.operators import similarity as Y
from threadstats.operators import stance as S
from threadstats.operators import terms as W
from threadstats.operators import topics as L
from threadstats.operators import vectors as V
from threadstats.plans import datasets as Z
from threadstats.sources import dumps as I
from threadstats.storage import is_complete, materialize, scratch_path, shared_folder, written
from threadstats.streaming import ingest as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MINUTE = "yyyy-MM-dd HH:mm"
SECOND = "yyyy-MM-dd HH:mm:ss"
DIGITS = 6


def query(function: Query) -> Query:
    QUERIES[function.__name__.lstrip("_")] = function
    return function


def rounded(df: DataFrame, *names: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


def fractions_rounded(df: DataFrame) -> DataFrame:
    return rounded(df, *[name for name, kind in df.dtypes if kind == "double"])


def digest(column: str) -> list[Column]:
    return [F.md5(F.col(column).cast("binary")).alias("content_md5"), F.length(column).alias("content_length")]


def strings(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n in names})


# --- sources and sinks -----------------------------------------------------


@query
def read_submissions(spark, sf):
    path = scratch_path(spark, "submissions-csv")
    I.write_csv(X.raw_dumps(spark, sf)[0], path, compression="gzip")
    read = I.read_submissions(spark, path)
    return read.select("submission_id", "author", "score", "n_comments", F.date_format("ts", MINUTE).alias("published"), *digest("content"))


@query
def read_comments(spark, sf):
    path = scratch_path(spark, "comments-csv")
    I.write_csv(X.raw_dumps(spark, sf)[1], path, compression="gzip")
    read = I.read_comments(spark, path)
    return read.select("comment_id", "author", "score", "submission_id", "parent_id", F.date_format("ts", MINUTE).alias("published"), *digest("content"))


def _packed(folder: str, header: list[str]):
    """Task-side helper: write each batch of a dump as one xz file."""
    def pack(batches):
        import pyarrow.fs as pafs

        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            name = uuid.uuid4().hex
            with store.open_output_stream(f"{base}/{name}.csv.xz") as out:
                out.write(lzma.compress(batch.to_csv(index=False, header=header).encode(), preset=0))
            yield pd.DataFrame({"name": [name]})
    return pack


@query
def land_xz(spark, sf):
    folder = scratch_path(spark, "submissions-xz")
    raw = X.raw_dumps(spark, sf)[0]
    plain = raw.toDF(*[f"c{i}" for i in range(len(raw.columns))])
    plain.mapInPandas(_packed(folder, raw.columns), "name string").write.format("noop").mode("overwrite").save()
    landed = E.clean_submissions(I.land_xz(spark, folder, schemas.SUBMISSIONS_CSV))
    return landed.select("submission_id", "author", "score", "n_comments", F.date_format("ts", MINUTE).alias("published"), *digest("content"))


@query
def ingest_json(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    events = X.table(spark, sf, "events").select(F.to_json(F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("title"),
        F.lit("https://example.org").alias("url"),
        F.col("user_id").cast("string").alias("author"),
        k.alias("score"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_utc"),
        (k % 7).alias("num_comments"),
        F.lit("/r").alias("permalink"),
        F.when(k % 2 == 0, F.concat(F.lit("flair"), k.cast("string"))).alias("link_flair_text"),
        F.when(k % 3 == 0, F.lit('say "hello", twice')).alias("selftext"),
    )).alias("record"))
    rows = I.submission_records(I.from_json(events, "record", schemas.SUBMISSION_JSON))
    return rows.select(
        F.col("Post ID").alias("post_id"), F.col("Title").alias("title"), F.col("Author").alias("author"),
        F.col("Score").alias("score"), F.date_format("Publish Date", SECOND).alias("published"),
        F.col("`Total No. of Comments`").alias("n_comments"), F.col("Flair").alias("flair"),
        F.col("Selftext").alias("selftext"),
    )


@query
def incremental_slice(spark, sf):
    events = X.table(spark, sf, "events")
    after, before = (F.lit(f"2024-01-{d} 00:00:00").cast("timestamp_ntz") for d in (10, 20))
    return E.incremental_slice(events, after, before).select("event_id", "user_id", "event_type")


@query
def high_water_mark(spark, sf):
    mark = E.high_water_mark(X.table(spark, sf, "events"))
    return mark.select(F.date_format("high_water_mark", SECOND).alias("high_water_mark"))


@query
def dedup_latest(spark, sf):
    latest = E.latest_by_id(X.table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return latest.select("user_id", "event_type", "event_id", "value")


@query
def _materialize(spark, sf):
    def build():
        return X.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))

    path = scratch_path(spark, "kept")
    materialize(spark, path, build)
    return materialize(spark, path, build)


@query
def stream_ingest(spark, sf):
    schema = X.table(spark, sf, "events").schema
    events = R.read_stream(spark, sf, schema, "parquet", pathGlobFilter="events.parquet")
    twice = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = R.first_of_each(twice, ["event_id"], "ts", "40 days")
    return R.run_now(spark, once.select("event_id", "user_id", "event_type", "value"), R.append_to, "stream")


@query
def stream_latest(spark, sf):
    """Every record comes twice, the older form later: the last one in the order of ``ts`` stays."""
    schema = X.table(spark, sf, "events").schema
    events = R.read_stream(spark, sf, schema, "parquet", pathGlobFilter="events.parquet")
    target, checkpoint = scratch_path(spark, "latest"), scratch_path(spark, "latest-checkpoint")
    R.keep_latest(events, ["user_id", "event_type"], ["ts", "event_id"], target, checkpoint).awaitTermination()
    latest = R.latest_records(spark, target, ["user_id", "event_type"], ["ts", "event_id"])
    return latest.select("user_id", "event_type", "event_id", "value")


@query
def stream_latest_state(spark, sf):
    """As ``stream_latest``, but what is known of an id is kept as state: only changes of the latest record come out."""
    schema = X.table(spark, sf, "events").schema
    events = R.read_stream(spark, sf, schema, "parquet", pathGlobFilter="events.parquet")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    target, checkpoint = scratch_path(spark, "changes"), scratch_path(spark, "changes-checkpoint")
    with R.rocksdb_state(spark):
        changes = R.latest_changes(events, ["user_id", "event_type"], "ts", "event_id", "40 days")
        R.append_changes(changes, target, checkpoint).awaitTermination()
    latest = R.latest_records(spark, target, ["user_id", "event_type"], ["ts", "event_id"])
    return latest.select("user_id", "event_type", "event_id", "value")


@query
def ingest_json_comments(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    events = X.table(spark, sf, "events").select(F.to_json(F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("author"),
        F.col("event_type").alias("body"),
        k.alias("score"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_utc"),
        F.when(k % 2 == 0, F.concat(F.lit("/r/"), k.cast("string"))).alias("permalink"),
        F.concat(F.lit("t3_"), (k % 7).cast("string")).alias("link_id"),
        F.concat(F.lit("t1_"), k.cast("string")).alias("parent_id"),
    )).alias("record"))
    rows = I.comment_records(I.from_json(events, "record", schemas.COMMENT_JSON))
    return rows.select(
        F.col("Comment ID").alias("comment_id"), F.col("Author").alias("author"), F.col("Body").alias("body"),
        F.col("Score").alias("score"), F.date_format("Publish Date", SECOND).alias("published"),
        F.col("Permalink").alias("permalink"), F.col("Submission ID").alias("submission_id"), F.col("Parent ID").alias("parent_id"),
    )


@query
def write_features(spark, sf):
    """Round trip of a feature table: written, and read again."""
    path = scratch_path(spark, "features")
    described = D.f1_descriptors(X.entries(spark, sf))
    I.write_features(described, path)
    return fractions_rounded(spark.read.parquet(path).select(*described.columns))


# --- projections, filters, periods -----------------------------------------


@query
def sentinel_null(spark, sf):
    raw = F.when(F.col("user_id") % 37 == 3, F.lit("NaN")).otherwise(F.col("user_id").cast("string"))
    return X.table(spark, sf, "events").select("event_id", C.sentinel_to_null(raw).alias("author"))


@query
def content_concat(spark, sf):
    selftext = C.sentinel_to_null(F.when(F.col("lang") == "en", F.col("text")).otherwise(F.lit("NaN")))
    docs = X.table(spark, sf, "documents").select("doc_id", C.submission_content(F.col("source"), selftext).alias("content"))
    return docs.select("doc_id", *digest("content"))


@query
def parse_date(spark, sf):
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.date_format("ts", "M/d/yyyy H:mm"))
        .when(kind == 1, F.date_format("ts", "MM/dd/yyyy HH:mm"))
        .when(kind == 2, F.date_format("ts", SECOND))
        .otherwise(F.lit("yesterday"))
    )
    parsed = X.table(spark, sf, "events").withColumn("parsed", C.parse_timestamp(text))
    return parsed.select("event_id", F.date_format("parsed", SECOND).alias("parsed"), F.to_date("parsed").alias("date"))


@query
def strip_prefix(spark, sf):
    prefixed = F.concat(F.lit("t1_"), F.col("event_id").cast("string"))
    return X.table(spark, sf, "events").select("event_id", C.strip_type_prefix(prefixed).alias("bare_id"))


@query
def complete_cases(spark, sf):
    events = X.table(spark, sf, "events").select(
        "event_id", F.nullif("event_type", F.lit("view")).alias("event_type"),
        F.when(F.col("value") > 1, F.col("value")).alias("value"),
    )
    return E.complete_cases(events)


@query
def strip_quotes(spark, sf):
    quoted = F.concat(F.lit("&gt; quoted\n"), F.col("content"), F.lit(" &gt; tail"))
    docs = X.texts(spark, sf).withColumn("content", C.strip_quotes(quoted))
    return docs.select("doc_id", *digest("content"))


@query
def entry_id(spark, sf):
    return X.raw_entries(spark, sf).select(
        "comment_id", "submission_id", C.entry_id(F.col("comment_id"), F.col("submission_id")).alias("entry")
    )


@query
def stance_bucket(spark, sf):
    return X.raw_entries(spark, sf).select("entry_id", "leave_probability", C.stance_code(F.col("leave_probability")).alias("stance"))


def _long_dates(spark, sf):
    days = (F.col("event_id") * 7 % 1300).cast("int")
    return X.table(spark, sf, "events").select("event_id", F.date_add(F.lit("2015-11-01").cast("date"), days).alias("date"))


@query
def assign_period(spark, sf):
    return P.assign_period(_long_dates(spark, sf), 15)


@query
def assign_period_counts(spark, sf):
    """All lists of periods: how many dates fall in each period of each."""
    dates = _long_dates(spark, sf)
    parts = [P.assign_period(dates, n).groupBy("period").agg(F.count(F.lit(1)).alias("n")).withColumn("periods", F.lit(n))
             for n in (3, 7, 15, 16)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def assign_period_equal(spark, sf):
    return P.assign_equal_periods(_long_dates(spark, sf), 7)


@query
def log_histogram(spark, sf):
    return E.log_histogram(X.table(spark, sf, "events"), "value", 20)


# --- entries, sets, joins ---------------------------------------------------


def _clean_dumps(spark, sf):
    submissions, comments = X.raw_dumps(spark, sf)
    return E.clean_submissions(submissions), E.clean_comments(comments)


@query
def union_entries(spark, sf):
    return E.union_entries(*_clean_dumps(spark, sf)).select(
        "entry_id", "parent_id", "comment_id", "submission_id", "author", "score", "n_comments", "date"
    )


@query
def base_entries(spark, sf):
    return Z.base_entries(*_clean_dumps(spark, sf), cuts=X.CUTS).select(
        "entry_id", "parent_id", "author", "period", *digest("content")
    )


@query
def period_counts(spark, sf):
    return X.raw_entries(spark, sf).groupBy("period").agg(F.count(F.lit(1)).alias("n_entries"))


@query
def common_authors(spark, sf):
    return D.common_authors(X.raw_entries(spark, sf), 1, 2)


def _stances(raw: DataFrame) -> DataFrame:
    return S.with_stance(raw.groupBy("author", "period").agg(F.max("leave_probability").alias("leave_probability")))


@query
def entry_stance(spark, sf):
    raw = X.raw_entries(spark, sf)
    joined = E.attach_stance(raw.drop("leave_probability"), _stances(raw))
    return joined.select("entry_id", "author", "period", "leave_probability", "stance")


@query
def author_class_backfill(spark, sf):
    raw = X.raw_entries(spark, sf)
    by_author = raw.groupBy("author").agg(F.max("leave_probability").alias("leave_probability"))
    return E.attach_author_class(raw, by_author).select("entry_id", "author", "prediction")


@query
def repair_orphans(spark, sf):
    return G.repair_orphans(X.raw_entries(spark, sf)).select("entry_id", "parent_id")


@query
def retained_authors(spark, sf):
    return D.retained_authors(X.entries(spark, sf))


@query
def next_stance(spark, sf):
    return D.next_stance(X.entries(spark, sf))


# --- replies and threads ----------------------------------------------------


def _total(columns, name):
    return sum((F.col(c) for c in columns), F.lit(0)).alias(name)


@query
def direct_replies(spark, sf):
    counts = G.direct_reply_counts(X.entries(spark, sf))
    return counts.select("entry_id", _total(G.DIRECT.values(), "n_direct"))


@query
def direct_replies_by_stance(spark, sf):
    return G.direct_reply_counts(X.entries(spark, sf))


@query
def all_replies(spark, sf):
    counts = G.reply_counts(X.entries(spark, sf))
    return counts.select("entry_id", _total(G.ALL.values(), "n_all"))


@query
def all_replies_by_stance(spark, sf):
    return G.reply_counts(X.entries(spark, sf)).select("entry_id", *G.ALL.values())


@query
def parent_stance(spark, sf):
    return G.parent_stance_counts(G.replies_with_parent(X.entries(spark, sf)))


@query
def thread_closure(spark, sf):
    entries = X.entries(spark, sf)
    return G.descendants(entries, entries.select(F.col("submission_id").alias("entry_id")).distinct())


@query
def subtree_size(spark, sf):
    return G.subtree_size(X.entries(spark, sf))


@query
def thread_depth(spark, sf):
    return G.thread_depth(X.entries(spark, sf))


def _intervals(spark, sf):
    entries = written(X.entries(spark, sf), "entries")
    return entries, T.interval_labels(entries)


@query
def entry_intervals(spark, sf):
    return _intervals(spark, sf)[1].filter("is_entry").select("entry_id", "start", "stop", "depth")


@query
def interval_descendants(spark, sf):
    entries, labels = _intervals(spark, sf)
    return T.descendants_by_range(labels, entries.select(F.col("submission_id").alias("entry_id")).distinct())


@query
def interval_sums(spark, sf):
    entries, labels = _intervals(spark, sf)
    return T.range_sums(labels, entries.withColumn("n", (F.col("stance") == 1).cast("bigint")), "n")


@query
def ancestors(spark, sf):
    entries = X.entries(spark, sf)
    return G.path_to_root(entries, G.deepest_entries(entries))


@query
def conversation_depth(spark, sf):
    turns = X.table(spark, sf, "conversations")
    conv = F.col("conv_id").cast("string")

    def turn_id(number):
        return F.concat(conv, F.lit("-"), number.cast("string"))

    entries = G.repair_orphans(turns.select(
        F.when(F.col("turn") > 0, turn_id(F.col("turn") - 1)).alias("parent_id"),
        turn_id(F.col("turn")).alias("entry_id"), turn_id(F.lit(0)).alias("submission_id"),
    ))
    return G.thread_depth(entries)


# --- descriptors and training sets ------------------------------------------


@query
def f1_descriptors(spark, sf):
    return fractions_rounded(D.f1_descriptors(X.entries(spark, sf)))


@query
def f2_descriptors(spark, sf):
    return fractions_rounded(D.f2_descriptors(X.entries(spark, sf)))


@query
def thread_mix(spark, sf):
    return rounded(D.thread_mix(X.entries(spark, sf)), "pa", "pb", "pn")


@query
def f3_descriptors(spark, sf):
    return fractions_rounded(D.f3_descriptors(X.entries(spark, sf)))


@query
def f3_descriptors_as_of(spark, sf):
    return fractions_rounded(D.f3_descriptors(X.entries(spark, sf), as_of_period=True))


@query
def f1_training(spark, sf):
    return Z.f1_training(written(X.entries(spark, sf), "entries"), digits=DIGITS)


@query
def f2_training(spark, sf):
    return Z.f2_training(written(X.entries(spark, sf), "entries"), digits=DIGITS)


@query
def f3_training(spark, sf):
    return Z.f3_training(written(X.entries(spark, sf), "entries"), digits=DIGITS)


def _described(spark, sf):
    entries = written(X.entries(spark, sf), "entries")
    replies = written(G.replies_with_parent(entries), "replies")
    counts = written(G.reply_counts(entries, replies), "reply-counts")  # two of the sets read them
    return {"f1": D.f1_descriptors(entries, replies, counts), "f2": D.f2_descriptors(entries, replies, counts),
            "f3": D.f3_descriptors(entries, as_of_period=True)}


@query
def next_stance_classifier(spark, sf):
    tables = [B.evaluate(described, name) for name, described in _described(spark, sf).items()]
    return fractions_rounded(tables[0].unionByName(tables[1]).unionByName(tables[2]))


@query
def author_split(spark, sf):
    """Labelled rows and authors on either side of the split."""
    training, test = B.split_by_author(D.with_next_label(D.author_labels(X.entries(spark, sf))))
    sides = training.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return sides.groupBy("side").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("author").alias("n_authors"),
                                     F.sum("next_label").alias("labels"))


@query
def majority_collapse(spark, sf):
    entries = X.entries(spark, sf)
    described = entries.groupBy("author", "period").agg(
        F.count(F.lit(1)).alias("total_entries"), F.count("comment_id").alias("cs"), F.min("stance").alias("current_label")
    )
    return D.majority_collapse(D.with_next_label(described), ["total_entries", "cs", "current_label"])


def _posts(spark, sf):
    """The entries with the text of their document."""
    docs = X.table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return X.entries(spark, sf).join(docs, "doc_id").withColumn("content", C.strip_quotes(F.col("content")))


def _f0_inputs(spark, sf):
    posts = written(_posts(spark, sf), "posts")
    labels = D.author_labels(posts)
    return posts, written(Z.f0_words(posts), "words"), labels


F0_COLUMNS = [f"w{i}" for i in range(1, D.F0_WORDS + 1)]


@query
def f0_descriptors(spark, sf):
    return rounded(D.f0_descriptors(*_f0_inputs(spark, sf)), *F0_COLUMNS)


@query
def f0_training(spark, sf):
    posts, words, labels = _f0_inputs(spark, sf)
    return Z.f0_training(posts, words, labels.withColumnRenamed("current_label", "stance"), digits=DIGITS)


# --- sort, limit, top-k ------------------------------------------------------


@query
def posts_by_date(spark, sf):
    return E.by_date(X.raw_entries(spark, sf)).select("date", "entry_id", "author")


@query
def earliest_posts(spark, sf):
    ordered = X.raw_entries(spark, sf).withColumn("kind", F.col("comment_id").isNull().cast("int"))
    return W.earliest_posts(ordered, 2000, Z.ORDER).select("date", "kind", "entry_id")


@query
def top_clusters(spark, sf):
    return V.top_clusters(X.table(spark, sf, "events").select("event_id", "user_id"), "user_id")


@query
def top_terms_per_doc(spark, sf):
    texts = X.texts(spark, sf)
    weights = W.tf_idf(written(W.descriptor_counts(texts, ["doc_id"], stem=False), "counts"), texts, ["doc_id"])
    return rounded(W.top_terms(weights, 10, ["doc_id"]).select("doc_id", "rank", "term", "weight"), "weight")


@query
def top_terms_overall(spark, sf):
    return rounded(W.leading_words(X.texts(spark, sf), 100), "total")


@query
def topic_top_terms(spark, sf):
    shares = L.term_share(W.descriptor_counts(X.texts(spark, sf), ["author"], stem=False), "author")
    return rounded(W.top_terms_with_ties(shares, 10, ["topic"]), "beta", digits=9)


# --- text ---------------------------------------------------------------------


def _cleaned(spark, sf, topic_words):
    cleaned = W.clean_texts(X.texts(spark, sf), "content", "cleaned", topic_words)
    return cleaned.select("doc_id", *digest("cleaned"))


@query
def clean_tokens(spark, sf):
    return _cleaned(spark, sf, True)


@query
def clean_tokens_single(spark, sf):
    return _cleaned(spark, sf, False)


@query
def remove_stopwords(spark, sf):
    tokens = X.texts(spark, sf).select(F.explode(descriptor_tokens(F.col("content"))).alias("term"))
    kept = W.remove_stop_words(tokens.filter("term <> ''"), descriptor_stop_words())
    return kept.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query
def pool_text(spark, sf):
    return E.pooled_text_size(X.texts(spark, sf))


@query
def doc_term_counts(spark, sf):
    return W.descriptor_counts(X.texts(spark, sf), ["doc_id"])


@query
def doc_term_split(spark, sf):
    return W.matrix_counts(X.texts(spark, sf), ["doc_id"])


@query
def nb_tokens(spark, sf):
    return W.model_counts(X.texts(spark, sf), ["doc_id"], stem=False)


@query
def stem_vocabulary(spark, sf):
    tokens = X.texts(spark, sf).select(F.explode(descriptor_tokens(F.col("content"))).alias("term"))
    return W.stem_map(tokens.filter("term <> ''"))


@query
def tfidf(spark, sf):
    texts = X.texts(spark, sf)
    counts = written(W.descriptor_counts(texts, ["doc_id"], stem=False), "counts")
    return rounded(W.tf_idf(counts, texts, ["doc_id"]), "weight")


@query
def term_totals(spark, sf):
    return W.term_totals(W.descriptor_counts(X.texts(spark, sf), ["author"], stem=False))


@query
def trim_vocab(spark, sf):
    return W.trim_vocabulary(W.model_counts(X.texts(spark, sf), ["author"], stem=False), min_total=3)


@query
def remove_sparse_terms(spark, sf):
    texts = X.texts(spark, sf)
    counts = written(W.descriptor_counts(texts, ["doc_id"], stem=False), "counts")
    return W.remove_sparse_terms(counts, texts, ["doc_id"], 0.99)


# --- stance model --------------------------------------------------------------


def _model(spark, sf):
    """Train once per application and data folder, then load."""
    path = f"{shared_folder(spark)}/model-{sf.strip('/').replace('/', '_')}"
    if not is_complete(spark, f"{path}/prior"):
        S.save(*S.train(X.labelled_docs(spark, sf)), path)
    return S.load(spark, path)


@query
def nb_train(spark, sf):
    return rounded(S.train(X.labelled_docs(spark, sf))[0], "logp_remain", "logp_leave")


@query
def nb_score(spark, sf):
    return rounded(S.score(X.texts(spark, sf), *_model(spark, sf), ["doc_id"]), "leave_probability")


@query
def post_stance(spark, sf):
    return rounded(S.with_stance(S.score(X.texts(spark, sf), *_model(spark, sf), ["doc_id"], min_total=1)), "leave_probability")


@query
def author_stance(spark, sf):
    return rounded(S.author_stance(_posts(spark, sf), *_model(spark, sf)), "leave_probability")


def _post_means(spark, sf):
    scores = S.score(X.texts(spark, sf), *_model(spark, sf), ["author", "doc_id"])
    return S.mean_probability(scores)


@query
def author_polarization(spark, sf):
    return rounded(_post_means(spark, sf).select("author", "n_posts", "polarization"), "polarization")


@query
def author_mean_prob(spark, sf):
    return rounded(_post_means(spark, sf).select("author", "leave_probability"), "leave_probability")


@query
def annotated_entries(spark, sf):
    base = Z.base_entries(*_clean_dumps(spark, sf), cuts=X.CUTS)
    annotated = Z.annotated_entries(base, *_model(spark, sf))
    return rounded(annotated.select(
        "parent_id", "entry_id", "period", "comment_id", "author", "score", "date", "submission_id",
        "n_comments", "leave_probability", "stance",
    ), "leave_probability")


# --- vectors and topics ----------------------------------------------------------


def _units(spark, sf):
    return X.table(spark, sf, "embeddings").select("vec_id", "label", V.unit(F.col("embedding")).alias("vector"))


def _label_references(units):
    """The first vector of each label."""
    return units.groupBy("label").agg(F.min_by(F.struct("vec_id", "vector"), "vec_id").alias("r")).select("r.*")


@query
def cosine_distance(spark, sf):
    units = _units(spark, sf)
    return rounded(V.reference_distances(units, _label_references(units), "vec_id"), "distance")


@query
def k_medoids_round(spark, sf):
    units = _units(spark, sf)
    assigned = written(V.assign_to_medoids(units, _label_references(units), "vec_id"), "assigned")
    best = V.best_medoids(assigned.drop("label"), "vec_id")
    return rounded(best.select("medoid_id", "n_members", F.col("vec_id").alias("new_medoid_id"), "total_distance"), "total_distance")


@query
def density_clusters(spark, sf):
    units = _units(spark, sf)
    pair = _label_references(units).orderBy("vec_id").limit(2)
    distances = V.reference_distances(units, pair, "vec_id")
    points = distances.groupBy("vec_id").agg(
        F.min_by("distance", "reference_id").alias("x"), F.max_by("distance", "reference_id").alias("y")
    )
    return V.density_clusters(written(points, "points"), ["x", "y"], 0.05, 3).select("vec_id", "cluster")


@query
def nearest_two_medoids(spark, sf):
    units = _units(spark, sf)
    return rounded(M.nearest_two(units, _label_references(units), "vec_id"), "distance", "second_distance")


@query
def swap_gains(spark, sf):
    """The change of the total by every exchange of a label's first vector for a vector whose id is divisible by 25."""
    units = written(_units(spark, sf), "units")
    ids, medoids = V._references(_label_references(units), "vec_id")
    names, points = V._references(units.filter(F.col("vec_id").isin(list(range(0, 500, 25)))), "vec_id")
    gains = M.swap_gains(units, medoids, points)
    return rounded(gains.select(
        F.array(*map(F.lit, ids))[F.col("medoid")].alias("medoid_id"),
        F.array(*map(F.lit, names))[F.col("candidate")].alias("candidate_id"), "change"), "change")


@query
def swapped_medoids(spark, sf):
    units = _units(spark, sf)
    placed, _ = M.swapped_medoids(units, _label_references(units), "vec_id", candidates=500)
    return rounded(placed.select("vec_id", "medoid_id", "distance"), "distance")


@query
def landmark_coordinates(spark, sf):
    """Without signs: the squared length of each row's coordinates, and its distance from the first landmark's."""
    units = written(_units(spark, sf), "units")
    landmarks = units.orderBy("vec_id").limit(200)
    placed = written(A.landmark_coordinates(units, landmarks, 64, "vec_id"), "coordinates")
    first = F.array(*map(F.lit, placed.orderBy("vec_id").first()["coordinates"]))
    squared = F.aggregate(F.zip_with("coordinates", first, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    length = F.aggregate("coordinates", F.lit(0.0), lambda s, x: s + x * x)
    return rounded(placed.select("vec_id", length.alias("squared_length"), squared.alias("squared_distance")),
                   "squared_length", "squared_distance")


@query
def similar_pairs(spark, sf):
    texts = X.texts(spark, sf)
    counts = written(W.descriptor_counts(texts, ["doc_id"], stem=False), "counts")
    weights = written(W.tf_idf(counts, texts, ["doc_id"]), "weights")
    return rounded(Y.similar_pairs(weights, "doc_id", 0.7), "similarity")


@query
def vector_classes(spark, sf):
    return Y.vector_classes(W.descriptor_counts(X.texts(spark, sf), ["doc_id"], stem=False), "doc_id", "n")


def _indexed(spark, sf, k):
    """All vectors, indexed, and the graph of their k nearest neighbours."""
    index = N.build(written(_units(spark, sf).drop("label"), "units"), "vec_id")
    return index, N.neighbour_graph(index, k)


@query
def neighbour_graph(spark, sf):
    index, graph = _indexed(spark, sf, 5)
    names = index.table.select("node", "vec_id")
    near = graph.join(names, "node").join(names.toDF("other", "neighbour_id"), "other")
    return rounded(near.groupBy("vec_id").agg(F.sum("distance").alias("distance"), F.count(F.lit(1)).alias("n")), "distance")


@query
def core_distances(spark, sf):
    index, graph = _indexed(spark, sf, 4)
    cores = K.core_distances(index, graph, 5)
    return rounded(cores.join(index.table.select("node", "vec_id"), "node").select("vec_id", "core"), "core")


@query
def reach_forest(spark, sf):
    index, graph = _indexed(spark, sf, 8)
    forest = K.reach_forest(index, graph, 5)
    return rounded(forest.agg(F.count(F.lit(1)).alias("n_edges"), F.sum("weight").alias("total"), F.max("weight").alias("longest")), "total", "longest")


@query
def stable_clusters(spark, sf):
    index, graph = _indexed(spark, sf, 8)
    forest = K.reach_forest(index, graph, 5)
    labels = K.stable_clusters(index, forest, 5, K.rungs_of(forest, 12))
    names = index.table.select("node", "vec_id")
    return labels.join(names, "node").join(names.toDF("cluster", "cluster_id"), "cluster", "left").select("vec_id", "cluster_id")


@query
def pca_project(spark, sf):
    projected = V.pca_project(_units(spark, sf), 10, "vec_id")
    return projected.select("vec_id", *C.spread(F.col("projected"), [f"p{i}" for i in range(1, 11)]))


def _event_weights(spark, sf):
    period = (F.floor((F.day("ts") - 1) / 2) + 1).cast("int")
    return X.table(spark, sf, "events").groupBy(
        F.col("user_id").cast("string").alias("author"), period.alias("period"), F.col("event_type").alias("term")
    ).agg(F.count(F.lit(1)).alias("weight"))


def _spelled(vector):
    return F.array_join(F.transform(vector, lambda e: F.concat(e.term, F.lit(":"), e.weight.cast("string"))), " ")


@query
def distinct_vectors(spark, sf):
    vectors = W.term_vectors(_event_weights(spark, sf), ["author", "period"])
    return vectors.groupBy("vector").agg(F.count(F.lit(1)).alias("n_docs")).select(_spelled(F.col("vector")).alias("vector"), "n_docs")


@query
def vector_transition(spark, sf):
    return V.vector_transition(_event_weights(spark, sf), 1, 14)


@query
def vector_positions(spark, sf):
    return V.vector_positions(_event_weights(spark, sf), range(1, 17))


@query
def cluster_terms(spark, sf):
    return L.cluster_terms(X.texts(spark, sf), "author").select("cluster", "rank", "term", "total")


@query
def pearson_distances(spark, sf):
    counts = written(W.descriptor_counts(X.texts(spark, sf), ["author"], stem=False), "counts")
    first = [r["author"] for r in counts.select("author").distinct().orderBy("author").limit(3).collect()]
    return rounded(L.pearson_distances(counts, "author", first), "distance")


TOPICS, TOPIC_ROUNDS = 5, 3


def _topics(spark, sf):
    counts = W.descriptor_counts(X.texts(spark, sf), ["doc_id"], stem=False)
    return written(L.topic_terms(counts, "doc_id", TOPICS, TOPIC_ROUNDS), "topics")


@query
def lda_topics(spark, sf):
    betas = _topics(spark, sf).withColumn("beta", F.round("beta", 9))
    return W.top_terms_with_ties(betas, 10, ["topic"]).select("topic", "rank", "term", "beta")


@query
def topic_mass(spark, sf):
    mass = _topics(spark, sf).groupBy("topic").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("beta").alias("mass"))
    return rounded(mass, "mass")
