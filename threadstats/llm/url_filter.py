"""URL filtering by association rules.

A list of host and path rules decides what it fits.  The urls that it decides
are the labelled ones: FP-growth mines the combinations of url tokens that go
with a verdict, and rules with enough support and confidence judge the urls that
the list leaves open.  A rule is found through an inverted index, under the
rarest of its tokens, and holds if the url has all of them.  The rule with the
largest confidence decides (ties: more tokens, more support, ``allow``, the
alphabet); a url that no rule fits gets the default verdict.

Urls with the same tokens are judged once.  Everything runs on columns; labels
may also be given as a table (url, label).  A url that is null or has no ``://``
has an empty host and path and no tokens but its lack of a host.  Repeated rows
are judged alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadstats.storage import broadcast_up_to, scope, written

Rule = tuple[str, str, str]  # verdict, host, path
LABELS = ("allow", "block")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Association rules that may be sent to every task.
MAX_BROADCAST_RULES = 20_000
#: Frequent tokens, with their names, that may be sent to every task.
MAX_BROADCAST_TOKENS = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path; both empty without a ``://``."""
    start = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def listed_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The url's distinct tokens, sorted: parts of the host, path segments, shapes, query keys."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    shape = F.transform(segments, lambda s: F.concat(
        F.lit("path:"), F.regexp_replace(F.translate(s, UPPER, LOWER), "[0-9]+", "0")))
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda q: q != ""), lambda q: F.concat(
        F.lit("query:"), F.substring_index(q, "=", 1)))
    one = [
        F.concat(F.lit("scheme:"), F.substring_index(url, "://", 1)), F.concat(F.lit("host:"), host),
        F.concat(F.lit("top:"), F.element_at(labels, -1)),
        F.when(n >= 2, F.concat(F.lit("site:"), F.substring_index(host, ".", -2))),
        F.when(n >= 3, F.concat(F.lit("sub:"), F.element_at(labels, 1))),
        F.when(F.endswith(path, F.lit("/")), F.lit("folder")), F.when(F.contains(url, F.lit("#")), F.lit("anchor")),
        F.when(host == "", F.lit("no host")),
    ]
    known = F.when(host == "", F.array(F.lit("no host"))).otherwise(
        F.concat(F.array_compact(F.array(*one)), shape, F.coalesce(keys, F.array().cast("array<string>"))))
    return F.array_sort(F.array_distinct(F.coalesce(known, F.array(F.lit("no host")))))


def classes(baskets: DataFrame, least: float) -> DataFrame:
    """(token, name) of the tokens in at least ``least`` of the written baskets (row, tokens).

    Tokens that occur in the same baskets get one name, the first of them: n such tokens would
    give 2^n combinations of equal support.  Sets of baskets are compared by their size and by
    two 64-bit sums of their rows' hashes.
    """
    rows = baskets.select("row", F.explode("tokens").alias("token"))
    marks = rows.groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("y"))
    frequent = written(marks.filter(F.col("n") >= least), "frequent-tokens")
    names = written(frequent.groupBy("n", "x", "y").agg(F.min("token").alias("name")), "token-classes")
    return written(frequent.join(names, ["n", "x", "y"]).select("token", "name"), "named-tokens")


def renamed(sets: DataFrame, names: DataFrame) -> DataFrame:
    """Add ``named`` to a table with a column ``tokens``: the sorted names of the tokens that have one."""
    table = broadcast_up_to(names, MAX_BROADCAST_TOKENS)
    keyed = sets.withColumn("set_id", F.monotonically_increasing_id())
    keyed = written(keyed, "token-sets")
    found = keyed.select("set_id", F.explode("tokens").alias("token")).join(table, "token").groupBy("set_id").agg(
        F.array_sort(F.collect_set("name")).alias("named"))
    none = F.array().cast("array<string>")
    return keyed.join(found.hint("merge"), "set_id", "left").withColumn("named", F.coalesce("named", none)).drop("set_id")


def mine(labelled: DataFrame, min_support: float, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """Rules (rule_id, items, rarest, verdict, confidence, support) from (tokens, label), and names of tokens.

    Items are names (see ``classes``): a rule fits if a url has any token of each of its names,
    which is what the rules of all these tokens together say.

    A rule goes if a shorter one with the same verdict is as sure: it could
    change no verdict's confidence.
    """
    known = labelled.filter(F.col("label").isin(*LABELS)).withColumn("row", F.monotonically_increasing_id())
    known = written(known, "labelled")
    total = known.count()
    names = classes(known, min_support * total)
    if not total:
        return known.sparkSession.createDataFrame(
            [], "rule_id bigint, items array<string>, rarest string, verdict string, confidence double, support double"), names
    label = F.concat(F.lit("label="), F.col("label"))
    baskets = written(renamed(known, names).select(F.array_append("named", label).alias("items")), "baskets")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    verdict = F.element_at("consequent", 1)
    rules = model.associationRules.filter(verdict.isin(*["label=" + x for x in LABELS])).filter("lift > 1").select(
        F.array_sort("antecedent").alias("items"), F.substring(verdict, 7, 5).alias("verdict"), "confidence", "support")
    rules = rules.filter(~F.exists("items", lambda i: F.startswith(i, F.lit("label="))))
    rules = written(rules.withColumn("rule_id", F.monotonically_increasing_id()), "rules")
    counts = written(model.freqItemsets.filter(F.size("items") == 1).select(
        F.element_at("items", 1).alias("item"), "freq"), "frequent")
    # Each rule's tokens once, joined to how often they occur: the rarest names the rule.
    rarest = rules.select("rule_id", F.explode("items").alias("item")).join(counts, "item").groupBy("rule_id").agg(
        F.min_by("item", F.struct("freq", "item")).alias("rarest"))
    found = written(rules.join(rarest, "rule_id"), "indexed")
    shorter = found.select(F.col("items").alias("part"), F.col("rarest").alias("key"), F.col("verdict").alias("same"),
                           F.col("confidence").alias("sure"))
    needless = found.select("rule_id", "items", "verdict", "confidence", F.explode("items").alias("key")).join(
        shorter, "key").filter((F.col("verdict") == F.col("same")) & (F.col("sure") >= F.col("confidence"))
                               & (F.size("part") < F.size("items")) & (F.size(F.array_except("part", "items")) == 0))
    return written(found.join(needless.select("rule_id").distinct(), "rule_id", "left_anti"), "mined"), names


def matched(sets: DataFrame, rules: DataFrame, names: DataFrame) -> DataFrame:
    """(tokens, verdict) for the token sets that a rule fits."""
    rules = broadcast_up_to(rules, MAX_BROADCAST_RULES)
    hits = renamed(sets.select("tokens"), names).select("tokens", "named", F.explode("named").alias("rarest")).join(
        rules, "rarest").filter(F.size(F.array_except("items", "named")) == 0)
    best = F.struct(-F.col("confidence"), -F.size("items"), -F.col("support"), "verdict", "items")
    return hits.groupBy("tokens").agg(F.min_by("verdict", best).alias("verdict"))


def judge(pages: DataFrame, rules: Sequence[Rule], labels: DataFrame | None = None, page_id: str = "page_id",
          url: str = "url", min_support: float = 0.005, min_confidence: float = 0.7, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row."""
    with scope(pages.sparkSession) as keep:
        host, path = host_and_path(F.col("url"))
        source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
        parted = source.select("page_id", "url", host.alias("host"), path.alias("path"))
        rows = written(parted.select("page_id", "host", "path", listed_rule(rules, F.col("host"), F.col("path")).alias("listed"),
                                     tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")), "urls")
        if labels is None:
            labelled = rows.filter("listed is not null").select("tokens", F.col("listed.verdict").alias("label"))
        else:
            given_host, given_path = host_and_path(F.col("url"))
            labelled = labels.select("url", given_host.alias("host"), given_path.alias("path"), "label").select(
                tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), "label")
        mined, names = mine(labelled, min_support, min_confidence)
        open_rows = rows.filter("listed is null")
        judged = written(matched(open_rows.select("tokens").distinct(), mined, names), "judged")
        decided = rows.filter("listed is not null").select("page_id", "host", "path", "listed.rule", "listed.verdict")
        other = open_rows.join(judged.hint("merge"), "tokens", "left").select(
            "page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
            F.coalesce("verdict", F.lit(default)).alias("verdict"))
        return keep(decided.union(other), "url_verdicts")
