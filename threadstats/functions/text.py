"""Cleaning and tokenising as column expressions.

Three cleaning chains exist because three consumers define words differently:
descriptor words (``descriptor_text``), words of the stance model
(``model_tokens``) and words of the clustering matrix (``matrix_tokens``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadstats.functions.words import (
    CORPUS_STOP_WORDS,
    ENGLISH_STOP_WORDS,
    TOPIC_STOP_WORDS,
)

ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
DIGITS = "0123456789"

# Marks replaced by a blank, and the substring cut before lowering.
TYPOGRAPHIC_MARKS = "‘’”“¿„…– "
CUT_SUBSTRING = "will"

# Separators of the clustering matrix and its word lengths.
MATRIX_SEPARATORS = " \r\n\t.,;:()?!/"
MATRIX_MIN_LENGTH, MATRIX_MAX_LENGTH = 3, 100

# Shortest word of the descriptor and model vocabularies.
MIN_LENGTH = 3

# A model token is a run of letters and digits, which may go on after a single
# apostrophe, hyphen, underscore or dot (so contractions and domains stay whole).
MODEL_TOKEN = r"[\p{L}\p{N}]+(?:['._-][\p{L}\p{N}]+)*"
MODEL_CONNECTORS = "'._-"
URL = r"(?:https?://|www\.)\S*"
# White space as the expressions have it.
WHITE = " \t\n\x0b\f\r"

# Endings and words that the model vocabulary leaves out.
MODEL_DROPPED_ENDINGS = (".tt", ".uk", ".com")
MODEL_DROPPED_WORD = "rt"


def descriptor_text(content: Column) -> Column:
    """Punctuation out, "will" cut, marks to blanks, digits out, lower case."""
    bare = F.translate(content, ASCII_PUNCTUATION, "")
    cut = F.replace(bare, F.lit(CUT_SUBSTRING), F.lit(" "))
    marks = F.translate(cut, TYPOGRAPHIC_MARKS + DIGITS, " " * len(TYPOGRAPHIC_MARKS))
    return F.lower(marks)


def descriptor_tokens(content: Column) -> Column:
    return F.split(descriptor_text(content), r"\s+")


def descriptor_stop_words(topic_words: bool = True) -> list[str]:
    words = ENGLISH_STOP_WORDS + CORPUS_STOP_WORDS
    return words + TOPIC_STOP_WORDS if topic_words else words


def model_tokens(content: Column) -> Column:
    """Lower case, web addresses out, then the tokens."""
    return F.regexp_extract_all(model_text(content), F.lit(MODEL_TOKEN), F.lit(0))


def model_text(content: Column) -> Column:
    """Lower case, web addresses out; only texts that may hold an address are searched for one."""
    low = F.lower(content)
    return F.when(low.contains("://") | low.contains("www."), F.regexp_replace(low, URL, " ")).otherwise(low)


def is_model_token(token: Column) -> Column:
    """Not a number, not a dropped ending or word, not a stop word."""
    kept = ~token.rlike(r"^[\p{N}._-]+$") & (token != MODEL_DROPPED_WORD)
    for ending in MODEL_DROPPED_ENDINGS:
        kept = kept & ~token.endswith(ending)
    return kept & ~token.isin(ENGLISH_STOP_WORDS)


def matrix_tokens(content: Column) -> Column:
    """Lower case, digits out, separators to blanks, then split."""
    plain = F.translate(
        F.lower(content), MATRIX_SEPARATORS + DIGITS, " " * len(MATRIX_SEPARATORS)
    )
    return F.split(F.trim(plain), " +")
