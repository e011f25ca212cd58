"""Encoding whole texts with a public tokenizer, as its library does, at the cost of their different words.

A tokenizer that replaces runs of white space and then keeps only the matches
of a pattern (white space is none of them) encodes each word by itself; its
words are encoded once per worker and remembered.  If its pattern, besides, ends
a match where ASCII letters end, "word," is remembered as a word and a comma.
All other tokenizers, and texts that hold one of a tokenizer's special strings,
are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from threadstats.llm.shared import LOWER, words_of

#: Bytes of the words that a Python worker remembers before it starts anew: about a million words.
MEMO = 64 << 20
#: Joined words that the library encodes at once.
JOINED = 20
#: Which bytes are white space, which are ASCII letters, and which are any other ASCII.
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
OTHER = (np.arange(256) < 128) & ~WHITE & ~LETTER
#: No match of this pattern holds a letter and, right after it, anything else.
LETTERS_ALONE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def version(path: str) -> str:
    """Digest of a tokenizer's file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def by_word(path: str) -> bool:
    """True if the tokenizer lower-cases, drops white space and so encodes each word by itself."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    first = _first_cut(spec)
    kinds = [s["type"] for s in steps]
    return (kinds == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": "\\s+"}
            and steps[1]["content"] == " " and first.get("type") == "Split" and first.get("behavior") == "Removed"
            and first.get("invert") is True and spec.get("post_processor") is None)


def by_letters(path: str) -> bool:
    """True if the tokenizer, besides, begins anew wherever an ASCII letter is followed by an ASCII byte that is none."""
    if not by_word(path):
        return False
    with open(path, encoding="utf-8") as file:
        return _first_cut(json.load(file))["pattern"] == {"Regex": LETTERS_ALONE}


def _first_cut(spec: dict) -> dict:
    return ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]


def lowered_words(text: bytes) -> list[bytes]:
    """The words between ASCII white space, with A-Z lower-cased as far as that can come before composing.

    The library composes (NFC) before it lower-cases, and some letters compose with a mark only
    in lower case.  Marks that compose with A-Z are U+0300 to U+036F, whose first byte is CC or
    CD: in texts that hold such a byte, only pure ASCII words are lower-cased here.
    """
    if b"\xcc" in text or b"\xcd" in text:
        return [word.lower() if word.isascii() else word for word in text.split()]
    return words_of(text)


def split_words(texts: list[bytes], cut: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different ``lowered_words`` of all texts, the number of each word in turn, and each text's number of words.

    ``cut`` also cuts between an ASCII letter and an ASCII byte that is none, as in "word,".
    """
    return cut_words([b" ".join(lowered_words(t)) if b"\xcc" in t or b"\xcd" in t else t.translate(LOWER) for t in texts], cut)


def cut_words(lowered: list[bytes], cut: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """``split_words`` of texts that are lower-cased."""
    flat = np.frombuffer(b" ".join([b"", *lowered]), np.uint8)  # white space comes before every text
    inside = ~WHITE[flat]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | (LETTER[flat[:-1]] & OTHER[flat[1:]]) if cut else ~inside[:-1]
    at = np.cumsum([len(t) + 1 for t in lowered], dtype=np.int64)
    counts = np.diff(np.searchsorted(np.flatnonzero(starts), at, side="right"), prepend=0)
    offsets = np.append(np.flatnonzero(starts[inside]), np.count_nonzero(inside)).astype(np.int32)
    words = pa.BinaryArray.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(flat[inside])]).dictionary_encode()
    ends = np.cumsum(pc.binary_length(words.dictionary).to_numpy(zero_copy_only=False), dtype=np.int64).tolist()
    together = b"".join(words.dictionary.buffers()[2:]) if ends else b""
    return [together[i:j] for i, j in zip([0, *ends], ends)], words.indices.to_numpy(), counts


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash, words), np.int64, len(words))


class Encoder:
    """Token ids of texts given as UTF-8.

    Words are remembered in a few arrays, found by their hash and compared: as
    objects of a dictionary they would take several times the memory.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are what runs in parallel
        self.path, self.words_alone, self.cut = path, by_word(path), by_letters(path)
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
            added = self.library.get_added_tokens_decoder()
            self.special = [t.content.encode() for t in added.values()]
            self.between = next(((i, t.content) for i, t in added.items() if t.special and not t.normalized), None)
            self._whole = lambda texts: [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.special = []
            self._whole = lambda texts: self.library.encode(texts, num_threads=1)
        self._forget()

    def _forget(self) -> None:
        # The word at a place is text[begin[place]:begin[place + 1]], its ids are ids[start[place]:start[place + 1]].
        self.text, self.begin = b"", np.zeros(1, np.int64)
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.hashes, self.places = np.zeros(0, np.int64), np.zeros(0, np.int32)  # by hash, ascending
        self.clash: dict[bytes, int] = {}  # places of words whose hash is that of another word

    def whole(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self._whole([t.decode("utf-8", "replace") for t in texts]) if texts else []
        return [np.array(ids, np.uint32) for ids in found]

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in turn and each word's number of ids."""
        if self.between is None:
            found = self.whole(words)
            return np.concatenate(found) if found else np.zeros(0, np.uint32), np.array([len(x) for x in found], np.int64)
        mark, content = self.between
        joined = [content.encode().join(words[i:i + 500]) for i in range(0, len(words), 500)]
        flat = np.concatenate([np.append(x, np.uint32(mark)) for i in range(0, len(joined), JOINED)
                               for x in self.whole(joined[i:i + JOINED])])
        ends = np.flatnonzero(flat == mark)
        if len(ends) != len(words):
            raise ValueError(f"{len(words)} words gave {len(ends)} ends: a word holds a special string")
        return flat[flat != mark], np.diff(np.concatenate([[-1], ends])) - 1

    @property
    def place(self) -> dict[bytes, int]:
        """The words remembered and their places."""
        ends = self.begin.tolist()
        return {self.text[begin:end]: at for at, (begin, end) in enumerate(zip(ends, ends[1:]))}

    def _size(self) -> int:
        return len(self.text) + sum(x.nbytes for x in (self.begin, self.start, self.ids, self.hashes, self.places))

    def _learn(self, new: list[bytes]) -> None:
        ids, lengths = self._words(new)
        place = np.arange(len(self.begin) - 1, len(self.begin) - 1 + len(new), dtype=np.int32)
        self.text += b"".join(new)
        self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(list(map(len, new))))
        self.start = np.append(self.start, self.start[-1] + np.cumsum(lengths))
        self.ids = np.append(self.ids, ids)
        hashes = _hashes(new)
        order = np.argsort(hashes, kind="stable")
        hashes, place = hashes[order], place[order]
        at = np.searchsorted(self.hashes, hashes)
        taken = np.append(False, hashes[1:] == hashes[:-1])
        if len(self.hashes):
            taken |= self.hashes.take(at, mode="clip") == hashes
        self.clash.update((new[i], int(p)) for i, p in zip(order[taken], place[taken]))
        self.hashes = np.insert(self.hashes, at[~taken], hashes[~taken])
        self.places = np.insert(self.places, at[~taken], place[~taken])

    def _found(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, -1 for those not remembered."""
        found = np.full(len(words), -1, np.int64)
        if len(self.hashes):
            hashes = _hashes(words)
            at = np.searchsorted(self.hashes, hashes)
            known = np.flatnonzero(self.hashes.take(at, mode="clip") == hashes)
            found[known] = own = self.places[at[known]]
            spans = zip(known.tolist(), self.begin[own].tolist(), self.begin[own + 1].tolist())
            others = [i for i, begin, end in spans if self.text[begin:end] != words[i]]
            found[others] = [self.clash.get(words[i], -1) for i in others]
        return found

    def _places(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The memo's place of every word of all texts in turn, and each text's number of words."""
        different, number, counts = split_words(texts, self.cut)  # a word that the texts repeat is looked up once
        found = self._found(different)
        if (found < 0).any():
            if self._size() > MEMO:
                self._forget()
                found[:] = -1
            new = np.flatnonzero(found < 0)
            found[new] = len(self.begin) - 1 + np.arange(len(new))
            self._learn([different[i] for i in new.tolist()])
        return found[number], counts

    def _plain(self, texts: list[bytes]) -> tuple[list[int], list[int]]:
        """Which texts go word by word, and which are encoded whole.

        Words are lower-cased before the library sees them, so a special string counts in any case of A-Z.
        """
        if self.words_alone:
            odd = [i for i, t in enumerate(texts) if any(s in t or s in t.translate(LOWER) for s in self.special)]
        else:
            odd = list(range(len(texts)))
        skip = set(odd)
        return [i for i in range(len(texts)) if i not in skip], odd

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """The number of ids of each text."""
        out = np.zeros(len(texts), np.int64)
        plain, odd = self._plain(texts)
        own, counts = self._places([texts[i] for i in plain])
        ends = np.concatenate([[0], np.cumsum(self.start[own + 1] - self.start[own])])
        last = np.cumsum(counts)
        out[plain] = ends[last] - ends[last - counts]
        out[odd] = [len(ids) for ids in self.whole([texts[i] for i in odd])]
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        plain, odd = self._plain(texts)
        own, counts = self._places([texts[i] for i in plain])
        lengths = self.start[own + 1] - self.start[own]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(self.start[own] - ends[:-1], lengths) + np.arange(ends[-1])]
        last = np.cumsum(counts)
        for i, low, high in zip(plain, ends[last - counts].tolist(), ends[last].tolist()):
            out[i] = ids[low:high]
        for i, found in zip(odd, self.whole([texts[i] for i in odd])):
            out[i] = found
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's encoder: a Python worker serves many tasks and keeps its words."""
    return Encoder(path)
