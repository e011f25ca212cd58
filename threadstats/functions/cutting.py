"""Words of many texts at once, cut from their UTF-8 bytes (runs in tasks).

The rules are those of ``functions.text``; what needs the JVM's own rules (lower case, web
addresses, which characters are letters) is prepared there.  Each function takes an Arrow array of
texts and returns the words of all texts in order, and how many of them each text has.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from threadstats.functions.text import ASCII_PUNCTUATION, CUT_SUBSTRING, DIGITS, MODEL_CONNECTORS, TYPOGRAPHIC_MARKS, WHITE

Words = tuple[pa.Array, np.ndarray]

_BLANK, _CODES = ord(" "), 0x110000
#: Bytes of text cut at once, so that what is made of them stays in the processor's cache.
PART = 1 << 20


def _among(characters: str) -> np.ndarray:
    """Which bytes are one of the ASCII characters."""
    table = np.zeros(256, bool)
    table[[ord(c) for c in characters]] = True
    return table


_PUNCTUATION, _DIGIT, _WHITE, _CONNECTOR = map(_among, (ASCII_PUNCTUATION, DIGITS, WHITE, MODEL_CONNECTORS))


@cache
def letters() -> np.ndarray:
    """Which code points are letters or numbers (``[\\p{L}\\p{N}]``), as the JVM has it; on the driver."""
    spark = SparkSession.active()
    every = "".join(chr(c) for c in range(1, _CODES) if not 0xD800 <= c < 0xE000)
    kept = spark.createDataFrame([(every,)], "c string").select(F.regexp_replace("c", r"[^\p{L}\p{N}]+", "")).first()[0]
    table = np.zeros(_CODES, bool)
    table[np.frombuffer(kept.encode("utf-32-le"), np.uint32)] = True
    return table


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each text begins and the last one ends."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def _wide(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of more than one byte: where they begin, how many bytes and which code points they are."""
    at = np.flatnonzero(data >= 0xC0)
    lead = data[at].astype(np.int64)
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    code = np.where(size == 2, lead & 0x1F, np.where(size == 3, lead & 0x0F, lead & 0x07))
    for k in (1, 2, 3):
        more = size > k
        code[more] = code[more] << 6 | data[at[more] + k] & 0x3F
    return at, size, code


def _spread(flags: np.ndarray, at: np.ndarray, size: np.ndarray, value: np.ndarray | int) -> None:
    """Give all bytes of the characters at some places a value."""
    for k in range(4):
        more = size > k
        flags[at[more] + k] = value[more] if isinstance(value, np.ndarray) else value


def _runs(data: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> Words:
    """Longest runs of bytes that are inside; the ends of texts also end runs."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][ends[:-1] < len(data)]
    first[begins] = inside[begins]
    before = np.concatenate([[0], np.cumsum(first)])
    packed = data[inside]
    offsets = np.append(np.flatnonzero(first[inside]), len(packed)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(packed))
    return words, before[ends[1:]] - before[ends[:-1]]


def _in_parts(cut: Callable[..., Words], texts: pa.Array, *args: np.ndarray) -> Words:
    rows = max(1, len(texts) * PART // max(texts.nbytes, 1))
    parts = [cut(texts.slice(at, rows), *args) for at in range(0, max(len(texts), 1), rows)]
    return pa.concat_arrays([words for words, _ in parts]), np.concatenate([n for _, n in parts])


def model_words(texts: pa.Array, letter: np.ndarray) -> Words:
    """Words of the stance model, of texts as ``text.model_text`` leaves them."""
    return _in_parts(_model_words, texts, letter)


def descriptor_words(texts: pa.Array) -> Words:
    """Words of the descriptors before they are put in lower case."""
    return _in_parts(_descriptor_words, texts)


def _model_words(texts: pa.Array, letter: np.ndarray) -> Words:
    data, ends = _bytes_of(texts)
    if not len(data):
        return pa.array([], pa.string()), np.diff(ends)
    table = np.zeros(256, bool)
    table[:128] = letter[:128]
    word = table[data]
    at, size, code = _wide(data)
    _spread(word, at, size, letter[code])
    # A single connector between two letters of one text goes on with the word.
    joint = np.flatnonzero(_CONNECTOR[data[1:-1]] & word[:-2] & word[2:]) + 1
    if len(joint):
        text = np.searchsorted(ends, joint, side="right") - 1
        word[joint[(ends[text] < joint) & (joint < ends[text + 1] - 1)]] = True
    return _runs(data, ends, word)


def _descriptor_words(texts: pa.Array) -> Words:
    data, ends = _bytes_of(texts)
    data, ends = _without(data, ends, _PUNCTUATION[data])
    data = data.copy()
    cut = CUT_SUBSTRING.encode()
    found = np.ones(max(len(data) - len(cut) + 1, 0), bool)
    for k, byte in enumerate(cut):
        found &= data[k:len(found) + k] == byte
    found = np.flatnonzero(found)
    found = found[found + len(cut) <= ends[np.searchsorted(ends, found, side="right")]]
    for k in range(len(cut)):
        data[found + k] = _BLANK
    at, size, code = _wide(data)
    mark = np.isin(code, [ord(c) for c in TYPOGRAPHIC_MARKS])
    _spread(data, at[mark], size[mark], _BLANK)
    data, ends = _without(data, ends, _DIGIT[data])
    if not len(data):
        return pa.array([], pa.string()), np.diff(ends)
    return _runs(data, ends, ~_WHITE[data])


def _without(data: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kept = np.concatenate([[0], np.cumsum(~gone)])
    return data[~gone], kept[ends]


def counted(words: pa.Array, per_text: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Group number, word and count of every word in a group of texts; texts in group -1 are left out."""
    names, code = different(words)
    owner = np.repeat(group, per_text)
    if len(group) and group.min() < 0:
        code, owner = code[owner >= 0], owner[owner >= 0]
    pair, n, width = owner * len(names) + code, None, max(len(names), 1)
    cells = (int(group.max()) + 1 if len(group) else 0) * len(names)
    if cells <= 8 * len(pair) + 1024:
        n = np.bincount(pair, minlength=cells)
        pair = np.flatnonzero(n)
        n = n[pair]
    else:
        pair, n = np.unique(pair, return_counts=True)
    own, code = np.divmod(pair, width)
    return own, names.take(pa.array(code)), n.astype(np.int64)


def different(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different words, and for every word which of them it is."""
    encoded = words.dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)

