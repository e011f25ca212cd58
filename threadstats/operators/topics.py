"""Topics of documents and their leading terms; terms of clusters.

Both work on the long table (document, term, n) with every term it holds: topics
are tables that joins update round by round, and clusters under Pearson distance
need only sums over the terms that two documents share, so nothing is widened to
the vocabulary and no term is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadstats.operators.similarity import vector_classes
from threadstats.operators.terms import descriptor_counts, remove_sparse_terms, top_terms
from threadstats.operators.vectors import MAX_REFERENCES
from threadstats.storage import Rounds, broadcast_up_to, written

# A term's weights in all topics travel as one row; two hex digits of its digest seed each topic.
MAX_TOPICS = 16
# Rows (a term or document and its topic weights) that may be broadcast: about 200 MB.
MAX_BROADCAST_ROWS = 500_000


def _numbers(k: int, value) -> Column:
    return F.array(*[value(t) for t in range(k)])


def _first_guess(k: int) -> Column:
    """A term's weight in each topic before the first round: 1 to 2, from the digits of its digest."""
    digits = F.md5(F.col("term").cast("binary"))
    return _numbers(k, lambda t: F.conv(F.substring(digits, 2 * t + 1, 2), 16, 10).cast("double") / 255 + 1)


def _common_terms(frequencies: DataFrame) -> DataFrame:
    """(term): the terms in the most documents, as many as may be broadcast; hinted so."""
    levels = frequencies.groupBy("df").agg(F.count(F.lit(1)).alias("terms"))
    above = Window.orderBy(F.desc("df"))  # over the different frequencies, few
    fitting = levels.withColumn("so_far", F.sum("terms").over(above)).filter(F.col("so_far") <= MAX_BROADCAST_ROWS)
    least = fitting.agg(F.min("df")).first()[0]
    kept = F.lit(False) if least is None else F.col("df") >= least
    return F.broadcast(written(frequencies.filter(kept).select("term"), "common-terms"))


def topic_terms(
    counts: DataFrame, doc: str, k: int, rounds: int = 20, term_prior: float = 0.01, doc_prior: float = 0.1
) -> DataFrame:
    """Fit topics on all documents and list (topic, term, beta) for all terms.

    Expectation and maximisation with priors: every round shares each (document, term, n)
    among the topics by the document's mix and the topic's terms, and sums the shares by term
    and by document.  Both sums are written tables that the next round joins: the weights of
    the most frequent terms are broadcast, so that only rows of rarer ones are moved to theirs.
    The driver holds k sums.  The first guess depends on the terms alone, so reruns agree to rounding.
    """
    if not 1 <= k <= MAX_TOPICS:
        raise ValueError(f"1 to {MAX_TOPICS} topics")
    spark = counts.sparkSession
    rows = written(counts.select(F.col(doc).alias("doc"), "term", F.col("n").cast("double").alias("n")), "topic-counts")
    terms, docs, both = (Rounds(spark, f"topic-{name}") for name in ("terms", "docs", "sums"))
    names = [f"t{t}" for t in range(k)]
    frequencies = written(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "topic-frequencies")
    phi = terms.write(frequencies.select("term", _first_guess(k).alias("phi")))
    theta = docs.write(rows.select("doc").distinct().select("doc", _numbers(k, lambda t: F.lit(1.0)).alias("theta")))
    common = _common_terms(frequencies)
    frequent, rare = (written(rows.join(common, "term", kind), f"topic-{kind}") for kind in ("left_semi", "left_anti"))
    for _ in range(rounds):
        mixes = broadcast_up_to(theta, MAX_BROADCAST_ROWS)
        # Mixes first, while rows are narrow; only rows of rare terms are moved to their weights.
        joined = frequent.join(mixes, "doc").join(F.broadcast(phi.join(common, "term", "left_semi")), "term").unionByName(
            rare.join(mixes, "doc").join(phi, "term"))
        weights = joined.select("doc", "term", "n", F.zip_with("phi", "theta", lambda p, m: p * m).alias("w"))
        whole = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
        shared = weights.select("doc", "term", *[(F.col("n") * F.col("w")[t] / whole).alias(names[t]) for t in range(k)])
        # Sums by term and by document in one pass; the shares themselves are not written.
        sums = both.write(shared.groupingSets([["term"], ["doc"]], "term", "doc").agg(*[F.sum(c).alias(c) for c in names]))
        summed = sums.filter("term is not null").select("term", *[(F.col(c) + term_prior).alias(c) for c in names])
        totals = summed.agg(*[F.sum(c) for c in names]).first()  # k numbers
        phi = terms.write(summed.select("term", _numbers(k, lambda t: F.col(names[t]) / F.lit(totals[t])).alias("phi")))
        mix = sums.filter("doc is not null").select("doc", *[(F.col(c) + doc_prior).alias(c) for c in names])
        every = sum((F.col(c) for c in names[1:]), F.col(names[0]))
        theta = docs.write(mix.select("doc", _numbers(k, lambda t: F.col(names[t]) / every).alias("theta")))
    flat = phi.select("term", F.posexplode("phi").alias("place", "beta"))
    return flat.select((F.col("place") + 1).alias("topic"), "term", "beta")


def term_share(counts: DataFrame, by: str) -> DataFrame:
    """Share of each term within a given grouping: a table shaped like a topic model."""
    totals = counts.groupBy(by).agg(F.sum("n").alias("all_terms"))
    summed = counts.groupBy(by, "term").agg(F.sum("n").alias("n"))
    return summed.join(totals, by).select(
        F.col(by).alias("topic"), "term", (F.col("n") / F.col("all_terms")).alias("beta")
    )


# --- clusters under Pearson distance ------------------------------------------------


def centred_sizes(counts: DataFrame, key: str) -> DataFrame:
    """(key, total, scale): a document's sum over all terms, and the length of its centred vector.

    Terms it lacks count as zeros; a document whose centred vector is zero has no direction
    and is left out.
    """
    n_terms = counts.agg(F.count_distinct("term").cast("double")).scalar()
    sums = counts.groupBy(key).agg(F.sum(F.col("n").cast("double")).alias("total"),
                                   F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    length = F.sqrt(F.greatest(F.col("squares") - F.col("total") * F.col("total") / n_terms, F.lit(0.0)))
    return sums.withColumn("scale", length).filter(F.col("scale") > 1e-9 * F.sqrt("squares")).select(key, "total", "scale")


def pearson_distances(counts: DataFrame, key: str, references: list) -> DataFrame:
    """(key, reference_id, distance): 1 - correlation of every document with each reference document.

    ``counts`` is a written table; ``references`` are keys, a bounded number.  Products come
    from the terms shared; the means of both vectors, over all terms, are taken off afterwards.
    """
    if len(references) > MAX_REFERENCES:
        raise ValueError(f"at most {MAX_REFERENCES} reference documents")
    n_terms = counts.agg(F.count_distinct("term").cast("double")).scalar()
    sizes = written(centred_sizes(counts, key), "centred-sizes")
    wanted = sizes.filter(F.col(key).isin(references))
    named = F.array(*[F.struct(F.lit(r[key]).alias("reference_id"), F.lit(r["total"]).alias("other_total"),
                               F.lit(r["scale"]).alias("other_scale")) for r in wanted.orderBy(key).collect()])
    theirs = counts.filter(F.col(key).isin(references)).select(
        F.col(key).alias("reference_id"), "term", F.col("n").cast("double").alias("m"))
    shared = counts.join(broadcast_up_to(written(theirs, "reference-terms"), MAX_BROADCAST_ROWS), "term")
    products = shared.groupBy(key, "reference_id").agg(F.sum(F.col("n") * F.col("m")).alias("product"))
    pairs = sizes.select(key, "total", "scale", F.explode(named).alias("r")).select(key, "total", "scale", "r.*")
    joined = pairs.join(products, [key, "reference_id"], "left")
    centred = F.coalesce("product", F.lit(0.0)) - F.col("total") * F.col("other_total") / n_terms
    return joined.select(key, "reference_id", (1 - centred / (F.col("scale") * F.col("other_scale"))).alias("distance"))


def _best_members(counts: DataFrame, sizes: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """The member of each cluster with the least summed distance to the others: (medoid_id, best).

    A member's correlations with its cluster sum to its product with the cluster's sum of
    scaled rows, less its total times the cluster's sum of scaled means.
    """
    n_terms = counts.agg(F.count_distinct("term").cast("double")).scalar()
    about = written(members.join(sizes, key), "members")
    scaled = written(counts.join(about, key).select(key, "medoid_id", "term", F.col("n").cast("double").alias("n"), "scale"), "scaled")
    sums = written(scaled.groupBy("medoid_id", "term").agg(F.sum(F.col("n") / F.col("scale")).alias("a")), "cluster-sums")
    means = about.groupBy("medoid_id").agg(F.sum(F.col("total") / n_terms / F.col("scale")).alias("c"))
    products = scaled.join(broadcast_up_to(sums, MAX_BROADCAST_ROWS), ["medoid_id", "term"]).groupBy(key).agg(
        F.sum(F.col("n") * F.col("a")).alias("product"))
    # One row per cluster.
    valued = about.join(products, key).join(F.broadcast(means), "medoid_id")
    agreement = (F.col("product") - F.col("c") * F.col("total")) / F.col("scale")
    return valued.groupBy("medoid_id").agg(F.min_by(key, F.struct(-F.round(agreement, 9), key)).alias("best"))


def pearson_medoids(counts: DataFrame, key: str, k: int) -> tuple[DataFrame, list]:
    """(key, medoid_id) of every document under Pearson distance, and the medoids.

    Starts from the k smallest keys and alternates assignment and the choice of medoids until
    medoids come again.
    """
    counts = written(counts, "cluster-counts")
    sizes = written(centred_sizes(counts, key), "centred-sizes")
    medoids = [r[key] for r in sizes.select(key).orderBy(key).limit(k).collect()]
    seen: set[frozenset] = set()
    while True:
        far = pearson_distances(counts, key, medoids)
        members = written(far.groupBy(key).agg(
            F.min_by("reference_id", F.struct(F.round("distance", 9), "reference_id")).alias("medoid_id")), "assigned")
        if frozenset(medoids) in seen or not medoids:
            return members, sorted(medoids)
        seen.add(frozenset(medoids))
        medoids = [r["best"] for r in _best_members(counts, sizes, members, key).collect()]  # k rows


def cluster_terms(docs: DataFrame, key: str, k: int = 2, n_top: int = 10, sparsity: float | None = None) -> DataFrame:
    """Leading terms of k clusters of documents under Pearson distance: (cluster, term, total, rank).

    All terms count, or those that ``terms.remove_sparse_terms`` leaves.  Documents with equal
    counts are clustered once.
    """
    counts = written(descriptor_counts(docs, [key]), "all-counts")
    if sparsity is not None:
        counts = written(remove_sparse_terms(counts, docs, [key], sparsity), "frequent-counts")
    own = vector_classes(counts, key, "n").filter(F.col(key) == F.col("class_id")).select(key)
    distinct = written(counts.join(written(own, "distinct-keys"), key, "left_semi"), "distinct-counts")
    members, _ = pearson_medoids(distinct, key, k)
    named = members.withColumnRenamed("medoid_id", "cluster")
    totals = distinct.join(named, key).groupBy("cluster", "term").agg(F.sum("n").alias("total"))
    return top_terms(totals, n_top, ["cluster"], "total")
