"""The range reader against a plain parse of the whole document."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanledger.sources import json_array as J, readers


def _document(seed: int, n: int) -> dict:
    rng = random.Random(seed)
    odd = ['"', "\\", "{", "}", "[", "]", ",", ":", "é", "筛", "\U0001f600", "x", "VISPDATS", '\\"VISPDATS":[', "\t", ""]

    def text():
        return "".join(rng.choice(odd) for _ in range(rng.randrange(12)))
    return {"META": [{"VISPDATS": [{"a": 1}]}, text()], "note": '"VISPDATS":[{', "n": {"VISPDATS": [1]},
            "VISPDATS": [{"id": i, "t": text(), "in": {"l": [text(), {"k": {}}]}} for i in range(n)] + [7, None, [{"no": 1}]], "after": [{"z": text()}]}


def _by_ranges(path, encoding, width):
    """What the three steps give, without a session."""
    import pyarrow as pa

    doc = J.Document(str(path), encoding)
    starts = list(range(0, doc.units, width))
    ranges = pa.RecordBatch.from_pylist([{"path": str(path), "start": s} for s in starts], pa.schema([("path", pa.string()), ("start", pa.int64())]))
    states = J._fold(pa.Table.from_batches(list(J._summarise("VISPDATS", encoding, width)(iter([ranges]))), J._SUMMARY))
    rows = [r for b in J._read(encoding, width)(iter(states.to_batches())) for r in b.to_pylist()]
    rows.sort(key=lambda r: r["pos"])
    assert [r["pos"] for r in rows] == list(range(len(rows)))
    return [json.loads(r["text"]) for r in rows]


@pytest.mark.parametrize("encoding,indent,ascii_only", [("UTF-16", None, False), ("UTF-16LE", 1, True), ("UTF-16BE", None, False), ("UTF-8", 2, False)])
def test_any_cut_gives_the_same_records(tmp_path, encoding, indent, ascii_only):
    for seed in range(4):
        want = _document(seed, 9)
        path = tmp_path / f"{encoding}{seed}.json"
        path.write_bytes(json.dumps(want, indent=indent, ensure_ascii=ascii_only).encode(encoding))
        records = [r for r in want["VISPDATS"] if isinstance(r, dict)]
        for width in (1, 2, 3, 7, 50, 501, 1 << 20):
            assert _by_ranges(path, encoding, width) == records, (seed, width)


@pytest.mark.parametrize("text", ["", " ", "{}", '{"VISPDATS":[]}', '{"VISPDATS":{"a":1}}', '{"VISPDATS":null}', "[1]"])
def test_documents_without_records(tmp_path, text):
    path = tmp_path / "a.json"
    path.write_bytes(text.encode("utf-16"))
    assert [_by_ranges(path, "UTF-16", w) for w in (1, 3, 100)] == [[], [], []]


def test_an_open_last_record_is_left_out(tmp_path):
    path = tmp_path / "a.json"
    path.write_bytes('{"VISPDATS":[{"a":1},{"b":[{'.encode("utf-16"))
    assert all(_by_ranges(path, "UTF-16", w) == [{"a": 1}] for w in (1, 5, 100))


def test_quotes_behind_backslashes():
    for text in ('\\"a"', '\\\\"a', 'x\\\\\\"', '"\\', "\\\\", '"', ""):
        units = np.frombuffer(text.encode("utf-16-le"), "<u2")
        for behind in (False, True):
            escaped, want = behind, []
            for i, c in enumerate(text):
                want += [i] if c == '"' and not escaped else []
                escaped = c == "\\" and not escaped
            got, end = J._quotes(units, behind)
            assert (got.tolist(), end) == (want, escaped), (text, behind)


def test_a_document_is_read_by_several_tasks(spark, tmp_path):
    for no in (0, 1):
        rows = [{"IntakeID": i, "ClientID": no, "QuestionE": 'Wh\r\nat "},{" ?', "ScoreValue": str(i)} for i in range(400)]
        # The export breaks lines inside its strings.
        text = json.dumps({"VISPDATS": rows}).replace("\\r\\n", "\r\n")
        (tmp_path / f"{no}.json").write_bytes(text.encode("utf-16"))
    got = readers.read_answers(spark, str(tmp_path), range_bytes=4096).withColumn("task", F.spark_partition_id())
    rows = got.orderBy("pos").collect()
    assert [(r["ClientID"], r["IntakeID"], r["QuestionE"], r["ScoreValue"]) for r in rows] == [
        (no, i, 'What "},{" ?', str(i)) for no in (0, 1) for i in range(400)]
    raw = J.json_array(spark, str(tmp_path), "VISPDATS", range_bytes=4096).withColumn("task", F.spark_partition_id())
    assert all(r["n"] > 3 for r in raw.groupBy("path").agg(F.count_distinct("task").alias("n")).collect())
