"""A reader of one JSON array in parallel: byte ranges of a document, each record read by the range it starts in.

Whether a byte is inside a string depends on everything before it, so a range cannot know by itself where a record
starts. Each range therefore says first what it does to each of the three states it may be entered in (outside a
string, inside one, behind a backslash); the states are folded per document, one row per range; then every range
is read again from a known state. No range is guessed, and no task sees more than its range and its last record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

RANGE_BYTES = 32 << 20
# Fixed value: white space that may stand between a name, its colon and its array, in units.
GAP = 4096
ENTRIES = ((False, False), (True, False), (True, True))
_ASCII_LIKE = ("utf-8", "iso-8859-1", "latin-1", "us-ascii", "ascii", "windows-1252", "cp1252")


class Document:
    """Units (bytes, or 16-bit units) of one file; offsets count units after the byte order mark."""

    def __init__(self, path: str, encoding: str):
        uri = re.sub(r"^file:/(?!//)", "file:///", path)
        uri = re.sub(r"^s3[an]://", "s3://", uri)
        fs, name = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)
        self.file = fs.open_input_file(name)
        self.bytes = self.file.size()
        head = self.file.read_at(min(3, self.bytes), 0)
        enc = encoding.lower()
        if enc.startswith("utf-16"):
            little = enc.endswith("le") or (enc == "utf-16" and head[:2] == b"\xff\xfe")
            self.skip = 2 if head[:2] in (b"\xff\xfe", b"\xfe\xff") else 0
            self.kind, self.decoder = np.dtype("<u2" if little else ">u2"), "utf-16-le" if little else "utf-16-be"
        elif enc in _ASCII_LIKE:
            self.skip = 3 if head[:3] == b"\xef\xbb\xbf" and enc == "utf-8" else 0
            self.kind, self.decoder = np.dtype("u1"), enc
        else:
            raise ValueError(f"encoding {encoding} has no fixed place for a quote")
        self.units = (self.bytes - self.skip) // self.kind.itemsize

    def read(self, start: int, end: int) -> np.ndarray:
        start, end = max(start, 0), min(end, self.units)
        size = self.kind.itemsize
        return np.frombuffer(self.file.read_at(max(end - start, 0) * size, self.skip + start * size), self.kind)

    def text(self, units: np.ndarray) -> str:
        return units.tobytes().decode(self.decoder, "replace")

    def close(self) -> None:
        self.file.close()


def _quotes(units: np.ndarray, behind: bool) -> tuple[np.ndarray, bool]:
    """(places of quotes that are not escaped, whether the unit after the last one is)."""
    slash = units == 0x5C
    # Number of backslashes in a row that end before each place, of which every second one escapes.
    n = len(units)
    last_other = np.maximum.accumulate(np.where(slash, -1, np.arange(n))) if n else np.empty(0, np.int64)
    run = np.arange(n) - last_other
    odd = np.empty(n + 1, bool)
    odd[0] = behind
    # A run from the start on also counts the backslash behind it.
    odd[1:] = ((run + np.where(last_other < 0, int(behind), 0)) % 2 == 1) & slash
    if behind and n and not slash[0]:
        odd[1:][last_other >= 0] = (run[last_other >= 0] % 2 == 1) & slash[last_other >= 0]
    return np.flatnonzero((units == 0x22) & ~odd[:-1]), bool(odd[-1])


def _events(units: np.ndarray, inside: bool, behind: bool) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """(places of brackets outside strings, +1 or -1 for each, inside at the end, behind a backslash at the end)."""
    quotes, behind = _quotes(units, behind)
    opens, closes = (units == 0x7B) | (units == 0x5B), (units == 0x7D) | (units == 0x5D)
    at = np.flatnonzero(opens | closes)
    outside = (np.searchsorted(quotes, at) + int(inside)) % 2 == 0
    at = at[outside]
    return at, np.where(opens[at], 1, -1), bool((len(quotes) + int(inside)) % 2), behind


def _roots(doc: Document, start: int, units: np.ndarray, root: str) -> np.ndarray:
    """Places in the range of each ``[`` that follows ``"root":``."""
    before = doc.read(start - GAP - len(root) - 2, start)
    everything = np.concatenate([before, units])
    # One character per unit, so that places in the text are places in the file.
    text = everything.astype("<u2").tobytes().decode("utf-16-le", "surrogatepass") if not _has_pairs(everything) else "".join(map(chr, everything))
    name = "".join(map(chr, np.frombuffer(root.encode(doc.decoder), doc.kind)))
    found = [m.end() - 1 - len(before) for m in re.finditer(rf'(?<!\\)"{re.escape(name)}"\s*:\s*\[', text)]
    return np.array([p for p in found if p >= 0], np.int64)


def _has_pairs(units: np.ndarray) -> bool:
    return units.dtype.itemsize == 2 and bool(((units >= 0xD800) & (units < 0xE000)).any())


_SUMMARY = pa.schema([("path", pa.string()), ("start", pa.int64()), ("inside", pa.list_(pa.bool_())), ("behind", pa.list_(pa.bool_())),
                      ("delta", pa.list_(pa.int64())), ("least", pa.list_(pa.int64())), ("root_at", pa.list_(pa.list_(pa.int64()))),
                      ("root_depth", pa.list_(pa.list_(pa.int64()))), ("root_least", pa.list_(pa.list_(pa.int64()))),
                      ("root_objects", pa.list_(pa.list_(pa.int64()))), ("objects", pa.list_(pa.list_(pa.int64())))])
_SUMMARY_DDL = ("path string, start long, inside array<boolean>, behind array<boolean>, delta array<long>, least array<long>, "
                "root_at array<array<long>>, root_depth array<array<long>>, root_least array<array<long>>, "
                "root_objects array<array<long>>, objects array<array<long>>")


def _summarise(root: str, encoding: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b["path"].to_pylist(), b["start"].to_pylist()):
                doc = Document(path, encoding)
                units = doc.read(start, start + width)
                roots = _roots(doc, start, units, root)
                doc.close()
                row: dict = {k: [] for k in _SUMMARY.names[2:]}
                for inside, behind in ENTRIES:
                    at, step, row_in, row_behind = _events(units, inside, behind)
                    depth = np.cumsum(step)
                    here = np.searchsorted(at, roots)
                    real = [(i, p) for i, p in zip(here, roots) if i < len(at) and at[i] == p]
                    row["inside"].append(row_in)
                    row["behind"].append(row_behind)
                    row["delta"].append(int(depth[-1]) if len(depth) else 0)
                    row["least"].append(int(min(depth.min(), 0)) if len(depth) else 0)
                    row["root_at"].append([int(start + p) for _, p in real])
                    row["root_depth"].append([int(depth[i] - 1) for i, _ in real])
                    row["root_least"].append([int(depth[i:].min()) for i, _ in real])
                    # Depths that opening braces lead to: counts by 1 - depth, and those just inside each array.
                    braces = (step > 0) & (units[at] == 0x7B)
                    row["root_objects"].append([int((braces[i:] & (depth[i:] == depth[i] + 1)).sum()) for i, _ in real])
                    row["objects"].append(np.bincount(1 - depth[braces & (depth <= 1)]).tolist())
                yield pa.RecordBatch.from_pylist([{"path": path, "start": start} | row], _SUMMARY)
    return run


_STATE = pa.schema([("path", pa.string()), ("start", pa.int64()), ("inside", pa.bool_()), ("behind", pa.bool_()), ("depth", pa.int64()), ("root", pa.int64()),
                    ("first", pa.int64())])
_STATE_DDL = "path string, start long, inside boolean, behind boolean, depth long, root long, first long"


def _fold(table: pa.Table) -> pa.Table:
    """Entry states of a document's ranges that hold a part of its root array; ``root`` is where that starts, ``first`` the
    number of records before the range."""
    entry, depth, root, first, out = 0, 0, None, 0, []
    for r in table.sort_by("start").to_pylist():
        state, opened = ENTRIES[entry], root
        if root is None:
            for p, d in zip(r["root_at"][entry], r["root_depth"][entry]):
                if depth + d == 1:
                    root = p
                    break
        if root is not None:
            out.append({"path": r["path"], "start": r["start"], "inside": state[0], "behind": state[1], "depth": depth, "root": root, "first": first})
            if opened is None:
                i = r["root_at"][entry].index(root)
                lowest = depth + r["root_least"][entry][i]
                first += r["root_objects"][entry][i]
            else:
                lowest = depth + r["least"][entry]
                # Records open at depth 3.
                objects, i = r["objects"][entry], depth - 2
                first += objects[i] if i < len(objects) else 0
            if lowest <= 1:
                break
        depth += r["delta"][entry]
        entry = ENTRIES.index((r["inside"][entry], r["inside"][entry] and r["behind"][entry]))
    return pa.Table.from_pylist(out, _STATE)


_RECORD = pa.schema([("path", pa.string()), ("pos", pa.int64()), ("text", pa.string())])
_RECORD_DDL = "path string, pos long, text string"


def _record_end(doc: Document, at: int, inside: bool, behind: bool, depth: int) -> int | None:
    """Where the record ends that is open at ``at`` with ``depth`` brackets; none if the document ends before."""
    step = 1 << 16
    while at < doc.units:
        units = doc.read(at, at + step)
        places, steps, inside, behind = _events(units, inside, behind)
        down = np.flatnonzero(np.cumsum(steps) == -depth)
        if len(down):
            return at + int(places[down[0]]) + 1
        depth += int(steps.sum())
        at, step = at + len(units), min(2 * step, RANGE_BYTES)
    return None


def _read(encoding: str, width: int, most: int = 4096):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                doc = Document(r["path"], encoding)
                start = r["start"]
                units = doc.read(start, start + width)
                at, step, inside, behind = _events(units, r["inside"], r["behind"])
                after = r["depth"] + np.cumsum(step)
                use = np.arange(len(at)) >= np.searchsorted(at, r["root"] - start, side="right")
                shut = np.flatnonzero(use & (after <= 1))
                if len(shut):
                    use[shut[0]:] = False
                # Objects that are elements of the root array: from depth 2 to 3 and back.
                begins = np.flatnonzero(use & (step > 0) & (after == 3) & (units[at] == 0x7B))
                backs = np.flatnonzero((step < 0) & (after == 2))
                rows = []
                for no, i in enumerate(begins):
                    j = np.searchsorted(backs, i)
                    first = int(at[i])
                    if j < len(backs):
                        text = units[first:int(at[backs[j]]) + 1]
                    else:
                        end = _record_end(doc, start + len(units), inside, behind, int(after[-1]) - 2)
                        if end is None:
                            continue
                        text = doc.read(start + first, end)
                    rows.append({"path": r["path"], "pos": r["first"] + no, "text": doc.text(text)})
                    if len(rows) == most:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD)
                        rows = []
                doc.close()
                yield pa.RecordBatch.from_pylist(rows, _RECORD)
    return run


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the documents under a path."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def _tasks(spark: SparkSession, ranges: int, size: int) -> int:
    """Tasks for so many ranges: one for each ``RANGE_BYTES``, at least one per core, none without a range. A small range costs less
    than the start of a task, so a task reads several."""
    return max(1, min(ranges, max(-(-size // RANGE_BYTES), 2 * spark.sparkContext.defaultParallelism), 100_000))


def json_array(spark: SparkSession, path: str, root: str, encoding: str = "UTF-16", range_bytes: int = RANGE_BYTES,
               files: DataFrame | None = None) -> DataFrame:
    """(path, pos, text): the objects of array ``root`` of each JSON document under ``path``.

    ``pos`` numbers the objects of a document from 0, in the order of the array. ``root`` is a name of the outermost object; if it stands there twice the first one is read. Elements that are
    no objects are left out, and so is a last record that the document does not close. Empty documents and
    documents without the array give no rows. Ranges are read by the workers themselves, so ``path`` must be one that
    pyarrow can open (local or shared folders, HDFS, S3, GCS). ``files``, (path, length), saves listing the path again.
    """
    width = max(range_bytes // 2 if encoding.lower().startswith("utf-16") else range_bytes, 1)
    files = listed(spark, path) if files is None else files
    unit = 2 if encoding.lower().startswith("utf-16") else 1
    ranges = files.where("length > 0").select("path", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / unit), F.lit(width))).alias("start"))
    n, size = files.agg(F.sum(F.ceil(F.col("length") / (width * unit))), F.sum("length")).first()
    tasks = _tasks(spark, n or 1, size or 0)
    states = (ranges.repartition(tasks).mapInArrow(_summarise(root, encoding, width), _SUMMARY_DDL)
              .groupBy("path").applyInArrow(_fold, _STATE_DDL))
    return states.repartition(tasks).mapInArrow(_read(encoding, width), _RECORD_DDL)
