"""Column expressions shared by the operators; all stay inside codegen."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stance codes and the probability bounds between them.
AGAINST, PRO, NEUTRAL = 0, 1, 2
NEUTRAL_FROM, PRO_FROM = 0.25, 0.75

# Suffixes of the stance-split descriptors, in the order against/pro/neutral.
STANCE_SUFFIX = {AGAINST: "a", PRO: "b", NEUTRAL: "n"}

# The text that stands for a missing field in the dumps.
MISSING_TEXT = "NaN"
NA_TEXT = "NA"

# Date formats of the dump files; the first is the one the files document.
DATE_FORMATS = ("M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")

QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def stance_code(probability: Column) -> Column:
    return (
        F.when(probability >= PRO_FROM, F.lit(PRO))
        .when(probability >= NEUTRAL_FROM, F.lit(NEUTRAL))
        .otherwise(F.lit(AGAINST))
    )


def polarization(probability: Column) -> Column:
    """Map a probability in [0, 1] to [-1, 1]."""
    return probability * 2 - 1


def sentinel_to_null(text: Column, sentinel: str = MISSING_TEXT) -> Column:
    return F.nullif(text, F.lit(sentinel))


def submission_content(title: Column, selftext: Column) -> Column:
    """Title and self text in one string; a bare title gets two blanks."""
    return F.when(selftext.isNull(), F.concat(title, F.lit("  "))).otherwise(
        F.concat(title, F.lit(" "), selftext)
    )


def parse_timestamp(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First format that fits; NULL if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def strip_type_prefix(identifier: Column) -> Column:
    """Drop the three-character kind prefix of an id."""
    return F.substr(identifier, F.lit(4))


def strip_quotes(content: Column) -> Column:
    """Delete quoted rests of lines, then all line breaks (without a blank)."""
    bare = F.when(content.contains("&gt;"), F.regexp_replace(content, "&gt;.*\n", "")).otherwise(content)
    return F.replace(bare, F.lit("\n"), F.lit(""))


def entry_id(comment_id: Column, submission_id: Column) -> Column:
    return F.coalesce(comment_id, submission_id)


def quartiles(value: Column) -> Column:
    """Array of min, quartiles and max with linear interpolation.

    ``percentile`` aggregates a histogram of distinct values per group and
    combines it before the shuffle, so a very active author does not have to
    pass value by value through one task.
    """
    return F.percentile(value, list(QUARTILES))


def log_edges(low: float, high: float, n: int) -> list[float]:
    """``n`` points from ``low`` to ``high``, equally spaced in the logarithm."""
    if n == 1:
        return [low]
    step = (math.log(high) - math.log(low)) / (n - 1)
    return [math.exp(math.log(low) + i * step) for i in range(n)]


def spread(array: Column, names: Sequence[str]) -> list[Column]:
    """The elements of a fixed-length array as named columns."""
    return [array[i].alias(name) for i, name in enumerate(names)]
