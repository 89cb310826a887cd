"""Texts to token ids inside Arrow tasks. Each distinct piece of a chunk is encoded once.

The usual pre-token pattern is applied to whole chunks as array operations over classes of code points:
runs of letters, numbers, white space and the rest; a space joins the run behind it; an apostrophe takes an English ending.
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from spanledger.llm.arrays import ragged

LETTER, NUMBER, SPACE, OTHER = range(4)
# Endings that an apostrophe takes with it.
ONE_LETTER = ("s", "t", "m", "d")
TWO_LETTERS = ("re", "ve", "ll")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            a, b = m.span()
            first, last = ord(every[a]), ord(every[b - 1])
            out[first:last + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def pieces(data: np.ndarray, off: np.ndarray, join_space: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts of pieces, which tile the rows (with the end); which of them are kept; pieces before each row (with the end).

    ``join_space``: white space is kept and a space joins what follows; else white space goes and each number stands alone."""
    tail = (data & 0xC0) == 0x80
    at = np.flatnonzero(~tail)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cp)
    rows = np.searchsorted(at, off)
    cls = classes()[cp]
    first = np.zeros(n + 1, bool)
    first[rows] = True
    edge = first.copy()
    first[1:n] |= cls[1:] != cls[:-1]
    first[0] = first[n] = True
    runs = np.flatnonzero(first)
    begin, end = runs[:-1], runs[1:]
    kind = cls[begin] if n else np.zeros(0, np.uint8)
    if join_space:
        stop = end[(kind == SPACE) & ~edge[end]]
        first[stop - 1] = True
        first[stop[cp[stop - 1] == 0x20]] = False
    else:
        first[:n] |= cls == NUMBER
    mark = (kind == OTHER) & (end - begin == 1) & ~edge[end]
    mark &= (cp[np.minimum(begin, n - 1)] == ord("'")) if n else mark
    for q in begin[mark & first[begin]] if n else ():
        run = runs[np.searchsorted(runs, q + 1, "right")] - (q + 1)
        if cls[q + 1] != LETTER:
            continue
        ahead = "".join(map(chr, cp[q + 1:q + 1 + min(run, 2)]))
        took = 1 if ahead[:1] in ONE_LETTER else 2 if ahead in TWO_LETTERS else 0
        if took:
            first[q + 1] = False
            first[q + 1 + took] = True
    cut = np.flatnonzero(first)
    keep = np.ones(len(cut) - 1, bool) if join_space else cls[cut[:-1]] != SPACE
    return np.append(at, len(data))[cut], keep, np.searchsorted(cut, rows)


def folded(texts: pa.Array) -> list[bytes]:
    """Composed and in lower case, code point by code point."""
    out = []
    for t in texts.cast(pa.large_string()).to_pylist():
        if not t.isascii():
            t = unicodedata.normalize("NFC", t).replace("Σ", "σ")
        out.append(t.lower().encode())
    return out


class Encoder:
    """Ids of pieces, with a bounded store of pieces already seen by this Python worker. ``encode`` gives each piece's ids as unsigned 32-bit numbers.

    ``added``: contents that are one id each wherever they stand; what lies between them is encoded as texts of its own."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], join_space: bool, fold: bool = False, capacity: int = 250_000,
                 added: dict[bytes, int] | None = None):
        self.encode, self.join_space, self.fold, self.capacity, self.seen = encode, join_space, fold, capacity, {}
        self.added = added or {}
        self.cuts = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk of binary texts, and how many stand before each row (with the end)."""
        if not any(pc.any(pc.match_substring(texts, c)).as_py() for c in self.added):
            return self._between(texts)
        parts, behind, rows = [], [], [0]
        for text in texts.to_pylist():
            a = 0
            for m in self.cuts.finditer(text):
                parts.append(text[a:m.start()])
                behind.append(self.added[m.group()])
                a = m.end()
            parts.append(text[a:])
            behind.append(-1)
            rows.append(len(parts))
        ids, at = self._between(pa.array(parts, pa.large_binary()))
        own = np.array(behind, np.int64)
        some = own >= 0
        before = at + np.concatenate([[0], np.cumsum(some)])
        return np.insert(ids, at[1:][some], own[some].astype(np.uint32)), before[rows]

    def _between(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        from spanledger.llm.arrays import flat

        data, off = flat(pa.array(folded(texts), pa.large_binary()) if self.fold else texts)
        cut, keep, rows = pieces(data, off, self.join_space)
        if len(cut) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        own = pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data.tobytes())])
        coded = own.dictionary_encode()
        index = coded.indices.to_numpy()
        if not keep.all():
            index = index[keep]
            rows = np.concatenate([[0], np.cumsum(keep)])[rows]
        used = np.zeros(len(coded.dictionary), bool)
        used[index] = True
        distinct, seen = coded.dictionary.to_pylist(), self.seen
        new = [w for w, u in zip(distinct, used.tolist()) if u and w not in seen]
        if len(seen) + len(new) > self.capacity:
            seen.clear()
            new = [w for w, u in zip(distinct, used.tolist()) if u]
        seen.update(zip(new, self.encode(new)))
        own = [seen[w] if u else b"" for w, u in zip(distinct, used.tolist())]
        count = np.fromiter(map(len, own), np.int64, len(own)) >> 2
        ids = np.frombuffer(b"".join(own), np.uint32)
        each = count[index]
        before = np.concatenate([[0], np.cumsum(each)])
        return ids[ragged((np.cumsum(count) - count)[index], each)], before[rows]


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write visible Latin-1 bytes as themselves and number the others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    return {b: b if b in shown else 256 + b - sum(x < b for x in shown) for b in range(256)}


def added_tokens(path: str) -> dict[bytes, int]:
    """Contents that the vocabulary file at ``path`` adds to its model, with their ids."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens") or []
    for t in found:
        if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added token with conditions: {t}")
    return {t["content"].encode(): t["id"] for t in found if t["content"]}


@lru_cache(maxsize=4)
def library_encoder(path: str, lower: bool, added: bool = False) -> Encoder:
    """Pieces are encoded by the model of the tokenizers library from the vocabulary file at ``path``.

    ``added``: contents of the file's added tokens get their ids, as the library does by default; else they are text (its encode_special_tokens)."""
    from tokenizers import Tokenizer

    model, letters = Tokenizer.from_file(path).model, byte_letters()

    def encode(new: list[bytes]) -> list[bytes]:
        return [array("I", [t.id for t in model.tokenize(w.decode("latin-1").translate(letters))]).tobytes() for w in new]

    return Encoder(encode, join_space=not lower, fold=lower, added=added_tokens(path) if added else None)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
