"""Token ids in Arrow files of equal-length sequences, and reading them back by place.

Documents are dealt into ranges of their key; each task appends the ids of its range to one stream, cut into rows of ``length`` ids.
A file has a fixed-size list of ids and one of mask bits per row, in batches of equal size, uncompressed: row r is found by arithmetic and is
read from the mapped file without a copy. A second file beside it names key, start and number of ids of each document.
"""

from __future__ import annotations

import os
import posixpath
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanledger.llm.arrays import chunks, texts_of
from spanledger.llm.common import cut_lineage
from spanledger.llm.pretokens import library_encoder

LENGTH = 2048
BATCH_ROWS = 256


def _store(folder: str):
    """File system and path of a URI or plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


class _Writer:
    """Fills rows of ``length`` ids; whole batches go out as they fill."""

    def __init__(self, sink, length: int, kind: pa.DataType):
        self.length, self.kind, self.rest, self.n = length, kind, [], 0
        self.have = 0
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))],
                                {b"sequence_length": str(length).encode(), b"batch_rows": str(BATCH_ROWS).encode()})
        self.out = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.have += len(ids)
        self.n += len(ids)
        block = self.length * BATCH_ROWS
        if self.have >= block:
            own = np.concatenate(self.rest)
            whole = len(own) // block * block
            for a in range(0, whole, block):
                self._put(own[a:a + block], block)
            self.rest, self.have = [own[whole:]], len(own) - whole

    def _put(self, ids: np.ndarray, n: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:n] = True
        values = (pa.array(ids.astype(self.kind.to_pandas_dtype()), self.kind), pa.array(mask))
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(v, self.length) for v in values], schema=self.schema))

    def close(self) -> None:
        if self.have:
            own = np.concatenate(self.rest)
            self._put(np.concatenate([own, np.zeros(-len(own) % self.length, own.dtype)]), len(own))
        self.out.close()


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", lower: bool = True, length: int = LENGTH,
                      id_bits: int = 16) -> DataFrame:
    """Writes all documents in ascending order of ``key`` (nulls first, equal keys by text); returns one row per file:
    part, file, docs, tokens and start (tokens of all files before it).

    Null text is empty: its document is the end id alone. Added tokens of the file are one id each. An empty table writes nothing. A task writes under a name of its own attempt and
    then renames, so a second attempt replaces the same file by the same bytes. Other columns are not read."""
    wide = pa.uint16() if id_bits == 16 else pa.uint32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, own, ready = task.partitionId(), f".{task.taskAttemptId()}", None
        encoder = library_encoder(path, lower, added=True)
        store, root = _store(folder)
        keys, counts = [], []
        for rows, _, _ in chunks(batches):
            if ready is None:
                store.create_dir(root, recursive=True)
                name = posixpath.join(root, f"part-{part:06d}.arrow")
                sink = store.open_output_stream(name + own)
                ready = _Writer(sink, length, wide)
            ids, at = encoder.ids(texts_of(rows.column("text")))
            if len(ids) and int(ids.max()) >> id_bits:
                raise ValueError(f"an id needs more than {id_bits} bits")
            n = np.diff(at)
            ready.add(np.insert(ids, at[1:], np.uint32(end_id)))
            keys.append(rows.column(key))
            counts.append(n + 1)
        if ready is None:
            return
        ready.close()
        sink.close()
        n = np.concatenate(counts)
        index = pa.table({"key": pa.chunked_array(keys), "start": np.cumsum(n) - n, "n_tokens": n})
        with store.open_output_stream(name + ".index" + own) as f, pa.ipc.new_file(f, index.schema) as out:
            out.write_table(index)
        for x in (name + ".index", name):
            store.move(x + own, x)
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"{folder}/part-{part:06d}.arrow"], "docs": [len(n)], "tokens": [ready.n]},
                                         schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    dealt = docs.select(key, "text").repartitionByRange(F.col(key).asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col(key).asc_nulls_first(), "text")
    files = cut_lineage(dealt.mapInArrow(run, "part int, file string, docs long, tokens long"))
    # One narrow row per file.
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


def open_sequences(file: str) -> tuple[pa.ipc.RecordBatchFileReader, int]:
    """A mapped file, and its rows per batch."""
    store, path = _store(file)
    local = store.type_name == "local"
    reader = pa.ipc.open_file(pa.memory_map(path) if local else store.open_input_file(path))
    return reader, int(reader.schema.metadata[b"batch_rows"])


def sequence(reader: pa.ipc.RecordBatchFileReader, batch_rows: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence ``row``; the ids are a view of the mapped file."""
    batch = reader.get_batch(row // batch_rows)
    i = row % batch_rows
    return batch.column("ids")[i].values.to_numpy(zero_copy_only=True), batch.column("mask")[i].values.to_numpy(zero_copy_only=False)


def read_token_files(spark: SparkSession, files: DataFrame, key_type: str = "bigint", key: str = "doc_id") -> DataFrame:
    """The documents of the files: key, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit numbers)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader, batch_rows = open_sequences(file)
                store, name = _store(file + ".index")
                with store.open_input_file(name) as f:
                    index = pa.ipc.open_file(f).read_all()
                width = reader.schema.field("ids").type.list_size
                kind, held, number = index.column("key"), None, -1
                begin, n = index.column("start").to_numpy(), index.column("n_tokens").to_numpy()
                block, crc = width * batch_rows, np.zeros(len(n), np.int64)
                for i, (a, z) in enumerate(zip(begin.tolist(), (begin + n).tolist(), strict=True)):
                    c = 0
                    while a < z:
                        if a // block != number:
                            number = a // block
                            held = reader.get_batch(number).column("ids").values.to_numpy(zero_copy_only=True)
                        b = min(z, (number + 1) * block)
                        c = zlib.crc32(held[a - number * block:b - number * block].astype("<u4").tobytes(), c)
                        a = b
                    crc[i] = c
                for a in range(0, len(n), 50_000):
                    s = slice(a, a + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(kind.slice(a, 50_000).chunks), pa.array(begin[s] + start), pa.array(n[s]), pa.array(crc[s])],
                                                     [key, "start", "n_tokens", "ids_crc32"])

    # Files are of about equal size; each goes to a task of its own as far as there are tasks.
    spread = files.select("file", "start").repartition(max(1, files.count()), "file")
    return spread.mapInArrow(run, f"{key} {key_type}, start long, n_tokens long, ids_crc32 long")
