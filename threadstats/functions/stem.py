"""English stemming (the public Porter2 rules) as DataFrame projections.

The rules only ever cut or replace a suffix, so each step is one projection
over the suffix found, and the whole stemmer runs inside the JVM.  Words are
expected in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The exceptional words and the suffix tables of Porter2.
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie",
    "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky",
    "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = [
    "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed",
]
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able",
    "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive",
    "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful",
    "lessli": "less", "li": "",
}
STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic",
    "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": "",
}
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
    "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion",
]
SHORT_SYLLABLE = "(^[aeiouy][^aeiouy]$)|([^aeiouy][aeiouy][^aeiouywxY]$)"
FIRST_REGION = "^(?:gener|commun|arsen|.*?[aeiouy][^aeiouy])"
SECOND_REGION = "^.*?[aeiouy][^aeiouy]"

_W, _R1, _R2, _SUFFIX = "__w", "__r1", "__r2", "__suffix"


def _longest(suffixes) -> Column:
    """The longest of the suffixes that the word ends in, or ''.

    Comparing bytes at the end of the word is far cheaper than a regular
    expression, which would decode the word first.
    """
    result = F.lit("")
    for suffix in sorted(suffixes, key=len):
        result = F.when(F.col(_W).endswith(suffix), F.lit(suffix)).otherwise(result)
    return result


def _if_contains(word: Column, letter: str, changed: Column) -> Column:
    """Apply a regular expression only to the words that can match it."""
    return F.when(word.contains(letter), changed).otherwise(word)


def _without(n: int | Column) -> Column:
    w = F.col(_W)
    return F.substr(w, F.lit(1), F.length(w) - n)


def _replacement(table: dict[str, str]) -> Column:
    result = F.lit("")
    for suffix, new in table.items():
        if new:
            result = F.when(F.col(_SUFFIX) == suffix, F.lit(new)).otherwise(result)
    return result


def with_stem(df: DataFrame, word: str, target: str) -> DataFrame:
    """Add the stem of column ``word`` as column ``target``."""
    w, r1, r2, suffix = F.col(_W), F.col(_R1), F.col(_R2), F.col(_SUFFIX)
    size = F.length(w)
    start = size - F.length(suffix)
    found = suffix != ""
    original = F.col(word)

    out = df.withColumn(_W, _if_contains(original, "'", F.regexp_replace(original, "^'", "")))
    out = out.withColumn(
        _W, _if_contains(w, "y", F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "([aeiouy])y", "$1Y"))
    )
    # Regions: positions after which R1 and R2 begin; the word's length if none.
    out = out.withColumn(_R1, F.length(F.regexp_extract(w, FIRST_REGION, 0)))
    out = out.withColumn(_R1, F.when(r1 == 0, size).otherwise(r1))
    out = out.withColumn(
        _R2, F.length(F.regexp_extract(F.substr(w, r1 + 1), SECOND_REGION, 0))
    )
    out = out.withColumn(_R2, F.when(r2 == 0, size).otherwise(r1 + r2))

    # Possessives, then plurals.
    out = out.withColumn(_W, _if_contains(w, "'", F.regexp_replace(w, "('s'|'s|')$", "")))
    out = out.withColumn(
        _W,
        F.when(w.endswith("sses"), _without(2))
        .when(w.endswith("ied") | w.endswith("ies"), F.when(size > 4, _without(2)).otherwise(_without(1)))
        .when(w.endswith("us") | w.endswith("ss"), w)
        .when(w.endswith("s") & w.rlike("[aeiouy].+s$"), _without(1))
        .otherwise(w),
    )
    out = out.withColumn("__done", w.isin(KEPT_AFTER_PLURAL))

    # Past tense and gerund, with the repair of the bared stem.
    out = out.withColumn(_SUFFIX, _longest(["eedly", "ingly", "edly", "eed", "ing", "ed"]))
    out = out.withColumn(
        "__bared", found & ~suffix.startswith("eed") & w.rlike("[aeiouy].*(ingly|edly|ing|ed)$") & ~F.col("__done")
    )
    out = out.withColumn(
        _W,
        F.when(F.col("__bared"), F.substr(w, F.lit(1), start))
        .when(suffix.startswith("eed") & (start >= r1) & ~F.col("__done"), F.concat(F.substr(w, F.lit(1), start), F.lit("ee")))
        .otherwise(w),
    )
    out = out.withColumn(
        _W,
        F.when(~F.col("__bared"), w)
        .when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e")))
        .when(w.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _without(1))
        .when((r1 >= size) & w.rlike(SHORT_SYLLABLE), F.concat(w, F.lit("e")))
        .otherwise(w),
    )
    out = out.withColumn(
        _W,
        F.when(~F.col("__done") & (w.endswith("y") | w.endswith("Y")) & w.rlike("^.+[^aeiouy][yY]$"), F.concat(_without(1), F.lit("i"))).otherwise(w),
    )

    # Derivational suffixes in R1, then R2.
    out = out.withColumn(_SUFFIX, _longest(STEP_2))
    allowed = (
        F.when(suffix == "ogi", w.endswith("logi"))
        .when(suffix == "li", w.rlike("[cdeghkmnrt]li$"))
        .otherwise(F.lit(True))
    )
    out = out.withColumn(
        _W,
        F.when(found & (start >= r1) & allowed & ~F.col("__done"), F.concat(F.substr(w, F.lit(1), start), _replacement(STEP_2))).otherwise(w),
    )
    out = out.withColumn(_SUFFIX, _longest(STEP_3))
    allowed = F.when(suffix == "ative", start >= r2).otherwise(F.lit(True))
    out = out.withColumn(
        _W,
        F.when(found & (start >= r1) & allowed & ~F.col("__done"), F.concat(F.substr(w, F.lit(1), start), _replacement(STEP_3))).otherwise(w),
    )
    out = out.withColumn(_SUFFIX, _longest(STEP_4))
    allowed = F.when(suffix == "ion", w.rlike("[st]ion$")).otherwise(F.lit(True))
    out = out.withColumn(
        _W,
        F.when(found & (start >= r2) & allowed & ~F.col("__done"), F.substr(w, F.lit(1), start)).otherwise(w),
    )

    # Final e or l.
    bare_e = w.endswith("e") & (
        (size - 1 >= r2) | ((size - 1 >= r1) & ~_without(1).rlike(SHORT_SYLLABLE))
    )
    bare_l = w.endswith("ll") & (size - 1 >= r2)
    out = out.withColumn(
        _W, F.when((bare_e | bare_l) & ~F.col("__done"), _without(1)).otherwise(w)
    )

    fixed = F.create_map(*[F.lit(x) for pair in WHOLE_WORDS.items() for x in pair])
    stem = (
        F.when(F.length(original) <= 2, original)
        .when(original.isin(list(WHOLE_WORDS)), F.element_at(fixed, original))
        .otherwise(F.translate(w, "Y", "y"))
    )
    # One-element explode: filters on the stem must not be pushed down through
    # the steps above, which would copy every step into its successor.
    kept = [c for c in df.columns if c != target]
    return out.select(*kept, F.explode(F.array(stem)).alias(target))
