"""Byte-level BPE by corpus-level merge replay.

The words (pattern matches) of all texts in an Arrow batch are one corpus: each distinct word stands in it once. An inverted index leads from the
rank of a token pair to the positions where it stands; merges are taken in order of rank, every merge rewrites only its own position and the
pairs at its two neighbours. Then the ids of the words are dealt back to the texts. Nothing is shuffled.

Merges in different words do not touch each other, so only the order inside a word matters. Short words are replayed together, in passes: a pass applies to
every word the first place of its lowest rank, all as array operations on the index by position. Long words, which would need many passes, are
replayed rank by rank through a queue.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from spanledger.llm.arrays import chunks, ragged, texts_of
from spanledger.llm.pretokens import Encoder, read_ranks

#: Words of one replay: bounds the memory of its index.
REPLAY_WORDS = 30_000
#: Bytes of a word that is replayed in passes, and words in one replay of them.
SHORT, SHORT_WORDS = 64, 100_000
#: Ids that are decoded at once.
DECODE_IDS = 1_000_000
_SHIFT = 21
_END = (1 << _SHIFT) - 1
_NONE = 1 << 62
_SPREAD = np.int64(0x9E3779B97F4A7C15 - (1 << 64))


class Merges:
    """Ranks of tokens, and for each pair of tokens the rank of their union."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a << _SHIFT | b] = rank
        self.keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        order = np.argsort(self.keys)
        self.keys, self.values = self.keys[order], np.fromiter(self.pairs.values(), np.int64, len(order))[order]
        self.bytes = np.array(self.byte, np.int64)
        # The same pairs as a table of places by hash, a quarter full, with free places behind its end.
        bits = max(8, int(len(order) * 4 - 1).bit_length())
        self.drop = np.uint64(64 - bits)
        self.slots, self.found = np.full((1 << bits) + len(order) + 1, -1), np.zeros((1 << bits) + len(order) + 1, np.int64)
        left = np.arange(len(self.keys))
        at = (self.keys * _SPREAD).view(np.uint64) >> self.drop
        while len(left):
            free = self.slots[at] < 0
            place, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.slots[place], self.found[place] = self.keys[left[won]], self.values[left[won]]
            on = np.ones(len(left), bool)
            on[won] = False
            left, at = left[on], at[on]
            at = at + (self.slots[at] >= 0).astype(np.uint64)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as unsigned 32-bit numbers. A word that is a token itself is that token."""
        out = [array("I", (r,)).tobytes() if (r := self.ranks.get(w)) is not None else None for w in words]
        rest = [i for i, ids in enumerate(out) if ids is None and len(words[i]) > SHORT]
        short = [i for i, ids in enumerate(out) if ids is None and len(words[i]) <= SHORT]
        for a in range(0, len(short), SHORT_WORDS):
            part = short[a:a + SHORT_WORDS]
            for i, ids in zip(part, self._passes([words[i] for i in part]), strict=True):
                out[i] = ids
        for a in range(0, len(rest), REPLAY_WORDS):
            part = rest[a:a + REPLAY_WORDS]
            for i, ids in zip(part, self._merge([words[i] for i in part]), strict=True):
                out[i] = ids
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, ``_NONE`` where it is no token."""
        key = a << _SHIFT | b
        at = (key * _SPREAD).view(np.uint64) >> self.drop
        out = np.full(len(key), _NONE)
        left = np.arange(len(key))
        while len(left):  # open addressing: the next place until the key or a free one is met
            met = self.slots[at]
            same = met == key[left]
            out[left[same]] = self.found[at[same]]
            on = ~same & (met >= 0)
            left, at = left[on], at[on] + np.uint64(1)
        return out

    def _passes(self, words: list[bytes]) -> list[bytes]:
        """Replays all words at once: in every pass each word's first pair of lowest rank becomes one token."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        token = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        rank = np.full(len(token), _NONE)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self._rank(token[inside], token[inside + 1])
        done_word, done_token = [], []
        while len(token):
            begin = np.flatnonzero(np.diff(word, prepend=-1))
            size = np.diff(begin, append=len(word))
            low = np.minimum.reduceat(rank, begin)
            live = low < _NONE
            stay = np.repeat(live, size)
            if not live.all():  # finished words leave
                done_word.append(word[~stay])
                done_token.append(token[~stay])
                token, word, rank = token[stay], word[stay], rank[stay]
                size, low = size[live], low[live]
            if not len(token):
                break
            hits = np.flatnonzero(rank == np.repeat(low, size))
            at = hits[np.flatnonzero(np.diff(word[hits], prepend=-1))]  # the first place in each word
            token[at] = low
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            token, word, rank = token[keep], word[keep], rank[keep]
            at -= np.arange(len(at))  # places after those before them have gone
            touched = np.concatenate([at, at[at > 0] - 1])
            rank[touched] = _NONE
            touched = touched[touched + 1 < len(token)]
            touched = touched[word[touched] == word[touched + 1]]
            rank[touched] = self._rank(token[touched], token[touched + 1])
        word, token = np.concatenate(done_word), np.concatenate(done_token)
        order = np.argsort(word, kind="stable")
        data = token[order].astype(np.uint32).tobytes()
        ends = (np.cumsum(np.bincount(word, minlength=len(words))) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _merge(self, words: list[bytes]) -> list[bytes]:
        token, starts = [], []
        for w in words:
            starts.append(len(token))
            token += [self.byte[b] for b in w]
            token.append(_END)
        n, get = len(token), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        flat = np.array(token, np.int64)
        key = flat[:-1] << _SHIFT | flat[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = np.append(np.where(self.keys[at] == key, self.values[at], -1), -1)
        places = np.flatnonzero(found >= 0)
        places = places[np.argsort(found[places], kind="stable")]
        rank, first = np.unique(found[places], return_index=True)
        index = dict(zip(rank.tolist(), (x.tolist() for x in np.split(places, first[1:])), strict=False)) if len(places) else {}
        now, queue = found.tolist(), rank.tolist()
        heapify(queue)
        while queue:
            r = heappop(queue)
            held = -1
            for p in sorted(index.pop(r, ())):
                if now[p] != r:
                    continue
                if p < held:
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
                        heappush(queue, r)
                    continue
                q = after[p]
                z = after[q]
                token[p], now[q] = r, -1
                after[p], before[z] = z, p
                o = before[p]
                low = r
                for x, k in ((p, get(r << _SHIFT | token[z], -1)), (o, get(token[o] << _SHIFT | r, -1))):
                    now[x] = k
                    if k >= 0:
                        if k in index:
                            index[k].append(x)
                        else:
                            index[k] = [x]
                            heappush(queue, k)
                        low = min(low, k)
                if low < r:  # a lower rank arose in this word: it goes before the word's other pairs of rank r
                    i = bisect_right(starts, p)
                    held = starts[i] if i < len(starts) else n
        out = []
        for p in starts:
            ids = []
            while token[p] != _END:
                ids.append(token[p])
                p = after[p]
            out.append(array("I", ids).tobytes())
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(Merges(read_ranks(path)).replay, join_space=True, capacity=250_000)


@lru_cache(maxsize=2)
def _tokens(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens one after the other, where each begins, and its length (-1: no such id)."""
    ranks = read_ranks(path)
    size = np.full(max(ranks.values()) + 1, -1)
    size[list(ranks.values())] = [len(t) for t in ranks]
    return np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8), np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), size


def bytes_of(ids: np.ndarray, at: np.ndarray, path: str) -> pa.Array:
    """The bytes that the ids of each row stand for; ``at``: ids before each row (with the end). An id outside the vocabulary is an error."""
    data, begin, size = _tokens(path)
    if len(ids) and (ids.min() < 0 or ids.max() >= len(size) or size[ids].min() < 0):
        raise ValueError("an id outside the vocabulary")
    each = size[ids]
    text = data[ragged(begin[ids], each)]
    edges = np.concatenate([[0], np.cumsum(each)])[at].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(text.tobytes())])


def encode_bytes(docs: DataFrame, path: str, key: str = "doc_id", decoded: bool = False) -> DataFrame:
    """Key and ids of every whole text; with ``decoded``, also the bytes that the ids stand for, decoded in the same task.

    Null text is empty and has no ids; null and repeated keys stay as they are."""
    kind = docs.select(key).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for rows, _, _ in chunks(batches):
            ids, at = encoder.ids(texts_of(rows.column("text")))
            out = {key: rows.column(key), "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))}
            if decoded:
                out["decoded"] = bytes_of(ids, at, path)
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, ids array<int>" + ", decoded binary" * decoded)


def decode_bytes(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for; null ids give null. An id outside the vocabulary, or null among ids, is an error."""
    fields = StructType([*encoded.schema.fields, StructField(out, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            place = whole.schema.get_field_index(ids)
            offsets = whole.column(place).offsets.to_numpy()
            a = 0
            while a < len(whole):  # about DECODE_IDS at a time
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + DECODE_IDS, "right")) - 1)
                batch = whole.slice(a, b - a)
                own = batch.column(place)
                if own.flatten().null_count:
                    raise ValueError("a null among ids")
                count = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
                texts = bytes_of(own.flatten().to_numpy(), np.concatenate([[0], np.cumsum(count)]), path)
                yield pa.RecordBatch.from_arrays([*batch.columns, pc.if_else(own.is_null(), None, texts)], [*batch.schema.names, out])
                a = b

    return encoded.mapInArrow(run, fields)


def id_digest(ids: str = "ids"):
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256)
