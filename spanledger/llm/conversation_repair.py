"""Conversation structure repair with Four-Russians block tables.

A repaired conversation is empty, or pairs of user and assistant turns with at most one system turn before them. Turns are symbols (initial of the role,
truncated or not); what the rest of a conversation costs at least is a vector over the four states of that grammar. Its differences are bounded, so few
normalised vectors exist, and tables hold for each of them what a block of ``BLOCK`` symbols makes of it. Blocks are looked up from the last to the
first. Then each block is expanded backward from the vector at its end, and edits are read from its start: always the least initial that is still
cheapest, so ties are settled as if all cheapest edits had been sorted.

A conversation may be of any length: turns are parted by ranges of (conversation, turn), each part sums up the conversations at its two edges as maps from
vector to vector and from state to state, and these maps, at most two a task, say where every part begins and ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.common import cut_lineage

BLOCK = 4
#: Costs of the edits, and of a truncated turn that stays.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
# States: nothing yet, after system, after user, after assistant. Where a role leads from each; the role that comes next.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
MOVES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
ROLES = "sua"
SYMBOLS = 2 * (len(ROLES) + 1)
_FAR = 1 << 20
# White space.
SPACES = " \t\n\x0b\x0c\r"


def _settled(cost: list[int]) -> list[int]:
    """Insertions before the next turn."""
    out = list(cost)
    for _ in range(2):
        out = [min(c, INSERT + out[NEXT[q]]) for q, c in enumerate(out)]
    return out


def _ways(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """What may become of a turn: (initial of the edit, cost, next state)."""
    stays = TRUNCATED * (symbol > len(ROLES))
    role = (ROLES + "?")[symbol % (len(ROLES) + 1)]
    out = [("D", DELETE, state)]
    if role in MOVES[state]:
        out.append(("K", stays, MOVES[state][role]))
    return [*out, ("R", REROLE + stays, NEXT[state])]


class Tables:
    """Vectors of least costs; for each vector after a symbol or block: the vector before it, and where each state is led."""

    def __init__(self):
        first = _settled([0, _FAR, _FAR, 0])
        self.vectors, self.at, self.before, self.edits = [], {}, [], []
        self._number(first)
        for after in self.vectors:  # grows while it is read
            row, edits = [], []
            for symbol in range(SYMBOLS):
                cost = _settled([min(c + after[to] for _, c, to in _ways(symbol, q)) for q in range(4)])
                row.append(self._number(cost))
                edits.append([self._edit(symbol, q, cost, after) for q in range(4)])
            self.before.append(row)
            self.edits.append(edits)
        self.step = np.array(self.before)
        self.hop = np.array([[[e[2] for e in symbol] for symbol in row] for row in self.edits])
        codes = np.arange(SYMBOLS ** BLOCK)
        own = np.repeat(np.arange(len(self.vectors))[:, None], len(codes), 1)
        led = np.tile(np.arange(4), (*own.shape, 1))
        for i in range(BLOCK):  # from the last symbol of the block to its first
            symbol = codes // SYMBOLS ** i % SYMBOLS
            hop = self.hop[own, symbol]
            led = np.take_along_axis(led, hop, 2)
            own = self.step[own, symbol]
        self.block, self.block_hop = own, led

    def _number(self, cost: list[int]) -> int:
        vector = tuple(c - cost[EMPTY] for c in cost)
        if vector not in self.at:
            self.at[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.at[vector]

    @staticmethod
    def _edit(symbol: int, state: int, cost: list[int], after: tuple) -> tuple[tuple[str, ...], str, int]:
        """Roles inserted before the turn, its edit, and the state after it: the least initials among the cheapest."""
        inserted = ()
        while True:
            ways = {w: to for w, c, to in _ways(symbol, state) if c + after[to] == cost[state]}
            if "D" not in ways and INSERT + cost[NEXT[state]] == cost[state]:
                state = NEXT[state]
                inserted += (NAMES[state],)
                continue
            way = min(ways)
            return inserted, way, ways[way]

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        whole = symbols[:len(symbols) // BLOCK * BLOCK].reshape(-1, BLOCK)
        return whole @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))

    def summary(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector after the symbols: the vector before them, and where each state is led."""
        own = np.arange(len(self.vectors))
        led = np.tile(np.arange(4), (len(own), 1))
        for s in symbols[len(symbols) // BLOCK * BLOCK:][::-1]:
            led = np.take_along_axis(led, self.hop[own, s], 1)
            own = self.step[own, s]
        for code in self.codes(symbols)[::-1]:
            led = np.take_along_axis(led, self.block_hop[own, code], 1)
            own = self.block[own, code]
        return own, led

    def trace(self, symbols: np.ndarray, end: int = 0, state: int = EMPTY) -> tuple[list[tuple[tuple[str, ...], str, int]], int]:
        """The edit of each symbol, and the state at the end; ``end``: number of the vector after the last symbol."""
        ends, codes, vector = [], self.codes(symbols), end
        rest = symbols[len(codes) * BLOCK:].tolist()
        for s in rest[::-1]:
            vector = self.before[vector][s]
        for code in codes[::-1].tolist():
            ends.append(vector)
            vector = int(self.block[vector, code])
        parts = [symbols[i * BLOCK:(i + 1) * BLOCK].tolist() for i in range(len(codes))] + [rest]
        out = []
        for part, vector in zip(parts, [*ends[::-1], end], strict=True):
            after = []
            for s in part[::-1]:
                after.append(vector)
                vector = self.before[vector][s]
            for s, v in zip(part, after[::-1], strict=True):
                edit = self.edits[v][s][state]
                out.append(edit)
                state = edit[2]
        return out, state

    @staticmethod
    def close(state: int) -> list[str]:
        """Roles inserted after the last turn."""
        out = []
        while state in (SYSTEM, USER):
            state = NEXT[state]
            out.append(NAMES[state])
        return out


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


KEYS = ("cn", "c", "tn", "t", "role", "h1", "h2")


def _keyed(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv).isNull().alias("cn"), F.coalesce(F.col(conv).cast("string"), F.lit("")).alias("c"), F.col(turn).isNotNull().alias("tn"),
                        F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("t"), own(role).alias("role"), own(text).alias("text"))
    return rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64("text", F.lit(1), "role")})


def _runs(rows: DataFrame) -> DataFrame:
    """Equal turns once, with their number, and what is wrong with the first of them."""
    end = F.rtrim("text", F.lit(SPACES))
    rows = rows.select(*KEYS, (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    runs = rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    when = F.struct("tn", "t")
    seen = runs.where(~F.col("blank")).groupBy("cn", "c", "h1", "h2").agg(F.min(when).alias("seen"), F.count("*").alias("m")).where("m > 1").drop("m")
    runs = runs.join(seen, ["cn", "c", "h1", "h2"], "left").withColumn("later", F.coalesce(when > F.col("seen"), F.lit(False))).drop("seen")
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.substring("role", 1, 1)).cast("int"), F.lit(0))
    symbol = F.when(F.col("blank") | F.col("later"), -1).otherwise(F.when(kind == 0, len(ROLES)).otherwise(kind - 1) + F.when(F.col("cut"), len(ROLES) + 1).otherwise(0))
    return runs.withColumn("symbol", symbol.cast("int"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Rows of one conversation that follow one another, as slices of batches."""
    def slices():
        for b in batches:
            if not len(b):
                continue
            c, cn = b.column(b.schema.get_field_index("c")), b.column(b.schema.get_field_index("cn"))
            names, none = c.to_numpy(zero_copy_only=False), cn.to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]) | (none[1:] != none[:-1])) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts, cuts[1:]):
                yield (bool(none[lo]), names[lo]), b.slice(lo, hi - lo)

    for key, parts in groupby(slices(), key=lambda x: x[0]):
        yield key, [p for _, p in parts]


def _symbols(parts: list[pa.RecordBatch]) -> np.ndarray:
    return np.concatenate([p.column(p.schema.get_field_index("symbol")).to_numpy() for p in parts])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums up the first and the last conversation of a part."""
    held, number = None, 0

    def told(key, parts):
        own, led = tables().summary((s := _symbols(parts))[s >= 0])
        part = parts[0].column(parts[0].schema.get_field_index("part"))[0]
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([part.as_py()], pa.int32()), pa.array([own.astype(np.int32).tolist()], pa.list_(pa.int32())),
                                           pa.array([led.astype(np.int32).ravel().tolist()], pa.list_(pa.int32()))], ["cn", "c", "part", "own", "led"])

    for key, parts in _stretches(batches):
        number += 1
        if number == 1:
            yield told(key, parts)
        else:
            held = key, parts
    if held:
        yield told(*held)


def _joined(group: pa.Table) -> pa.Table:
    """Vector at the end and state at the start of each part of a conversation."""
    rows = sorted(group.to_pylist(), key=lambda r: r["part"])
    vector, ends = 0, []
    for r in rows[::-1]:
        ends.append(vector)
        vector = r["own"][vector]
    state, out = EMPTY, []
    for r, end in zip(rows, ends[::-1], strict=True):
        out.append({"cn": r["cn"], "c": r["c"], "part": r["part"], "end_vector": end, "state": state, "closes": r is rows[-1]})
        state = r["led"][4 * end + state]
    kinds = {"cn": pa.bool_(), "c": pa.string(), "part": pa.int32(), "end_vector": pa.int32(), "state": pa.int32(), "closes": pa.bool_()}
    return pa.Table.from_pylist(out, pa.schema(kinds.items()))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    strings = pa.list_(pa.string())
    for _, parts in _stretches(batches):
        symbols = _symbols(parts)
        first = {n: parts[0].column(parts[0].schema.get_field_index(n))[0].as_py() for n in ("end_vector", "state", "closes")}
        edits, state = tables().trace(symbols[symbols >= 0], first["end_vector"] or 0, first["state"] or EMPTY)
        own = iter(edits)
        every = [next(own) if s >= 0 else ((), "D", None) for s in symbols.tolist()]
        tail = Tables.close(state) if first["closes"] in (None, True) else []
        at = 0
        for p in parts:
            e = every[at:at + len(p)]
            at += len(p)
            roles = p.column(p.schema.get_field_index("role")).to_pylist()
            new = [None if way == "D" else role if way == "K" else NAMES[to] for (_, way, to), role in zip(e, roles, strict=True)]
            keep = [p.column(p.schema.get_field_index(n)) for n in (*KEYS, "n", "blank", "later", "cut")]
            after = [[]] * (len(p) - 1) + [tail if at == len(every) else []]
            yield pa.RecordBatch.from_arrays([*keep, pa.array([list(x[0]) for x in e], strings), pa.array([x[1] for x in e]), pa.array(new, pa.string()), pa.array(after, strings)],
                                             [*KEYS, "n", "blank", "later", "cut", "before", "edit", "new_role", "after"])


_EDITS = "cn boolean, c string, tn boolean, t long, role string, h1 long, h2 long, n long, blank boolean, later boolean, cut boolean, before array<string>, edit string, new_role string, after array<string>"


def _edit_rows(rows: DataFrame) -> DataFrame:
    runs = _runs(rows)
    runs = runs.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS).withColumn("part", F.spark_partition_id())
    runs = cut_lineage(runs)  # its parts and their order stay as they are
    edges = runs.select("cn", "c", "part", "symbol").mapInArrow(_edges, "cn boolean, c string, part int, own array<int>, led array<int>")
    inner = edges.groupBy("cn", "c").applyInArrow(_joined, "cn boolean, c string, part int, end_vector int, state int, closes boolean")
    runs = runs.join(F.broadcast(inner), ["cn", "c", "part"], "left")  # at most two rows for each task that wrote the parts
    return runs.select(*KEYS, "n", "blank", "later", "cut", "symbol", "end_vector", "state", "closes").mapInArrow(_edited, _EDITS)


def repair_edits(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The cheapest edits, one row for each different turn: conversation (as text), turn, role, number of equal turns, faults of the first of them,
    roles inserted ``before``, ``edit`` (K, R or D; further equal turns are deleted), ``new_role``, and roles inserted ``after`` (last turn only).

    Turns are taken by number, nulls first; turns of equal number by role, then by a 128-bit hash of role and text. Null roles and texts are one space; rows
    with a null conversation are one conversation. An empty role has no initial and can't be kept. Of texts of any length only hashes and ends are
    looked at. An empty table gives no rows. Columns of other names are not looked at."""
    none = F.when(~F.col("cn"), F.col("c"))
    out = _edit_rows(_keyed(turns, conv, turn, role, text))
    return out.select(none.alias("conversation"), F.when(F.col("tn"), F.col("t")).alias("turn"), "role", "n", "blank", F.col("later").alias("seen"), F.col("cut").alias("truncated"),
                      "before", "edit", "new_role", "after")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal turns once per batch, so many copies of one turn do not travel."""
    for b in batches:
        keys = np.stack([b.column(b.schema.get_field_index(n)).cast(pa.int64()).to_numpy(zero_copy_only=False) for n in ("ch", "tn", "t", "h1", "h2")], 1)
        yield b.take(pa.array(np.sort(np.unique(keys, axis=0, return_index=True)[1])))


def _in_order(turns: DataFrame, everyone: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Edits and texts of each conversation one after the other: a row of ``everyone``, then for each different turn its edit (tag 1) and its text (tag 2)."""
    rows = _keyed(turns, conv, turn, role, text)
    edits = _edit_rows(rows).select(*KEYS, F.lit(1).alias("tag"), "n", "blank", "later", "cut", "before", "edit", "new_role", "after", F.lit(None).cast("string").alias("text"))
    kinds = {**dict(rows.dtypes), "ch": "bigint"}
    texts = rows.withColumn("ch", F.xxhash64("cn", "c")).mapInArrow(_once, ", ".join(f"{c} {k}" for c, k in kinds.items()))
    texts = texts.select(*KEYS, F.lit(2).alias("tag"), "text")
    all_of = everyone.select(F.col(conv).isNull().alias("cn"), F.coalesce(F.col(conv).cast("string"), F.lit("")).alias("c")).distinct().withColumn("tag", F.lit(0))
    both = edits.unionByName(texts, allowMissingColumns=True).unionByName(all_of, allowMissingColumns=True)
    return both.repartition("cn", "c").sortWithinPartitions(*KEYS, "tag")


def _lines(rows: Iterator[dict]) -> Iterator[tuple[str, dict | None, tuple[str, str] | None]]:
    """(edit initials, the turn it is about, the line that comes of it); a line's text arrives in the row after its edit."""
    asked, texts_seen = None, True
    for r in rows:
        if r["tag"] == 1:
            for name in r["before"]:
                yield "I", None, (name, "")
            asked, texts_seen = r, False
            if r["edit"] == "D":
                yield "D" * r["n"], r, None
                for name in r["after"]:
                    yield "I", None, (name, "")
        elif r["tag"] == 2 and not texts_seen:
            texts_seen = True
            if asked["edit"] != "D":
                yield asked["edit"] + "D" * (asked["n"] - 1), asked, (asked["new_role"], r["text"])
                for name in asked["after"]:
                    yield "I", None, (name, "")


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    rows = (r for b in batches for small in range(0, len(b), 256) for r in b.slice(small, 256).to_pylist())
    return groupby(rows, key=lambda r: (r["cn"], r["c"]))


def repaired(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: conversation (as text, null for null), place from 0, role, text, edit. Cases as in ``repair_edits``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for (none, name), rows in _by_conversation(batches):
            place = 0
            for edit, _, line in _lines(rows):
                if line:
                    held.append((None if none else name, place, *line, edit[0]))
                    place += 1
                if len(held) == 4096:
                    yield _rows(held)
                    held = []
        yield _rows(held)

    def _rows(held):
        kinds = {"conversation": pa.string(), "place": pa.int64(), "role": pa.string(), "text": pa.string(), "edit": pa.string()}
        return pa.RecordBatch.from_pylist([dict(zip(kinds, h)) for h in held], pa.schema(kinds.items()))

    return _in_order(turns, turns, conv, turn, role, text).mapInArrow(work, "conversation string, place long, role string, text string, edit string")


def repair_report(turns: DataFrame, everyone: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation of ``everyone`` (default: ``turns``): conversation (as text), gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Each turn's first fault counts. ``audit``: initials of the cheapest edits; the hash is over the lines ``role:text`` of the repaired conversation. It is
    taken line by line, so no task holds a conversation; one conversation's lines do pass through one task, as its hash has no parts.
    A conversation without turns has zeros, an empty audit and the hash of nothing."""
    kinds = {"cn": pa.bool_(), "c": pa.string(), **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string()}

    def facts(key: tuple, rows: Iterator[dict]) -> dict:
        out = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
        digest, audit, first = hashlib.sha256(), [], True
        span, initial = None, None

        def counted(rows):
            nonlocal span, initial
            for r in rows:
                if r["tag"] == 1:
                    n, own = r["n"], r["role"][:1]
                    out["illegal"] += (initial is not None and initial + own not in ("su", "ua", "au")) + (n - 1)
                    initial = own
                    out["blank"] += n if r["blank"] else 0
                    out["duplicate"] += 0 if r["blank"] else n if r["later"] else n - 1
                    out["truncated"] += r["cut"] and not r["blank"] and not r["later"]
                    if r["tn"]:
                        t = r["t"]
                        span = (t, t, 1) if span is None else (span[0], t, span[2] + (t != span[1]))
                yield r

        for edits, about, line in _lines(counted(rows)):
            audit.append(edits)
            out["cost"] += INSERT * edits.count("I") + DELETE * edits.count("D") + REROLE * (edits[0] == "R") + TRUNCATED * (edits[0] in "KR" and about["cut"])
            if line:
                digest.update(("" if first else "\n").encode() + f"{line[0]}:{line[1]}".encode())
                first = False
        out["gaps"] = span[1] - span[0] + 1 - span[2] if span else 0
        return {"cn": key[0], "c": key[1], **out, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for key, rows in _by_conversation(batches):
            held.append(facts(key, rows))
            if len(held) == 1000:
                yield pa.RecordBatch.from_pylist(held, pa.schema(kinds.items()))
                held = []
        yield pa.RecordBatch.from_pylist(held, pa.schema(kinds.items()))

    ordered = _in_order(turns, turns if everyone is None else everyone, conv, turn, role, text)
    out = ordered.mapInArrow(work, "cn boolean, c string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return out.select(F.when(~F.col("cn"), F.col("c")).alias("conversation"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """Known damage by crc32 of ``conv_id:turn``: of 20 remainders, 0 drops a turn, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's.

    Nulls are one space, but for conv_id and turn themselves, which stay null."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rest = F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn")).cast("binary")) % 20
    text = F.when(rest == 1, "").when(rest == 2, F.translate(own("text"), ".!?", "")).otherwise(own("text"))
    copies = F.when(rest == 0, 0).when(rest == 3, 2).otherwise(1)
    out = conversations.select("conv_id", "turn", F.when(rest == 4, "user").otherwise(own("role")).alias("role"), text.alias("text"), copies.alias("copies"))
    return out.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_")).drop("_")
