"""op3 against a plain loop: every document against every voting row, one at a time, in double precision."""

import random

import numpy as np
import pyarrow as pa
import pytest

from spanledger.llm import quality_classifier as C
from spanledger.llm.arrays import chunks


def _plain_scores(model, texts):
    out = []
    known = [(e, float(q)) for e, q in zip(model["exemplars"].astype(np.float64), model["quality"])]
    for _, data, off in chunks(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})])):
        for i in range(len(off) - 1):
            own = data[off[i]:off[i + 1]]
            m = C.marks(own, np.array([0, len(own)]))
            if not m.any():
                out.append(model["prior"])
                continue
            x = model["project"](m)[0].astype(np.float64)
            near = sorted((sum(float(a) * float(b) for a, b in zip(x, e)), q) for e, q in known)[::-1][:C.NEIGHBOURS]
            votes = [(max(s, 0.0) ** 4, q) for s, q in near]
            total = sum(w for w, _ in votes)
            out.append(sum(w * q for w, q in votes) / total if total > 0 else model["prior"])
    return out


def test_scores_equal_a_loop_over_all_exemplars(sp):
    rng = random.Random(9)

    def text(good):
        vocab = [f"{'word' if good else 'SPAM!'}{rng.randrange(400)}" for _ in range(30)] + ["the", "of", "and"]
        return " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 120)))
    own = [(i, text(i % 3 > 0)) for i in range(240)] + [(240, None), (241, ""), (242, "long " * 400 + text(True))]
    docs = sp.createDataFrame(own, "doc_id long, text string")
    labels = sp.createDataFrame([(i, int(i % 3 > 0)) for i in range(240) if i % 4], "doc_id long, quality int")
    model = C.learn(docs, labels)
    assert len(model["exemplars"]) > C.NEIGHBOURS
    got = {r.doc_id: r.score for r in C.quality_scores(docs, labels).collect()}
    want = dict(zip([i for i, _ in own], _plain_scores(model, [t for _, t in own])))
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in got) < 1e-3
    assert got[240] == got[241] == pytest.approx(model["prior"])


def test_a_learner_does_not_see_held_out_rows(sp):
    docs = sp.createDataFrame([(i, f"text {i} of {i % 7}") for i in range(60)], "doc_id long, text string")
    kept = {r.doc_id for r in docs.where(~C.held_out()).collect()}
    labels = sp.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    assert {r.doc_id for r in C.labelled(docs, labels, "doc_id", 100).collect()} == kept and 0 < len(kept) < 60
