"""Mixing and hard negatives against plain definitions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanledger.llm import curriculum as C
from spanledger.llm import hard_negatives as H
from spanledger.llm.catalog import QUERIES
from spanledger.llm.native_sql import SCHEDULES

from brute import DOC, words


def level_targets(sizes, weights, share, most):
    total, out, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        level = (total - sum(most * sizes[s] for s in sizes if s not in open_)) / sum(weights[s] for s in open_)
        over = {s for s in open_ if most * sizes[s] < level * weights[s]}
        if not over:
            break
        open_ -= over
    return {s: level * weights[s] if s in open_ else most * sizes[s] for s in sizes}


def when(schedule, part):
    """The time at which a share of the integral is reached, by halving."""
    def until(t):
        return sum((min(t, b[0]) - a[0]) * (a[1] + (a[1] + (b[1] - a[1]) * (min(t, b[0]) - a[0]) / (b[0] - a[0]))) / 2 for a, b in zip(schedule, schedule[1:]) if t > a[0])

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if until(mid) < part * until(1.0) else (low, mid)
    return low


def mix(docs, schedules, share=1.5, most=2):
    by = {}
    for key, text, source in docs:
        by.setdefault(source, []).append((hashlib.md5(f"{'' if key is None else key}:{text or ''}".encode()).hexdigest(), len(words(text)), key))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    kind = {s: i % len(schedules) for i, s in enumerate(order)}
    sizes = {s: sum(n for _, n, _ in by[s]) for s in by}
    targets = level_targets(sizes, {s: C.integral(schedules[kind[s]]) for s in by}, share, most) if sum(sizes.values()) else dict.fromkeys(by, 0.0)
    out = []
    for s in by:
        at, goal = 0, int(targets[s] + 0.5)
        groups = {}
        for h, n, key in by[s]:
            groups.setdefault(h, []).append((n, key))
        for h in sorted(groups):
            n, copies = groups[h][0][0], len(groups[h])
            took, times = 0, []
            for p in range(most):
                x = max(0, min(goal - at - p * sizes[s], n * copies)) // copies
                took += x
                if x:
                    times.append(when(schedules[kind[s]], (at + p * sizes[s]) / goal))
            at += n * copies
            out += [(key, n, sizes[s], targets[s], took, times) for _, key in groups[h]]
    return out


def compare_mix(spark, docs, schedules=SCHEDULES):
    df = spark.createDataFrame([(k, t, "en", s, 0) for k, t, s in docs], DOC)
    got = C.curriculum(df, schedules).collect()
    facts = sorted(((str(r["doc_id"]), r["size"], r["source_size"], r["taken"]), [r["target"], *r["positions"]]) for r in got)
    want = sorted(((str(k), n, size, took), [target, *times]) for k, n, size, target, took, times in mix(docs, schedules))
    assert [f for f, _ in facts] == [w for w, _ in want]
    for (_, a), (_, b) in zip(facts, want, strict=True):
        assert a == pytest.approx(b, abs=1e-7)
    return got


def test_mix_equals_the_definition(sp):
    rng = random.Random(2)
    docs = [(i, rng.choice([None, "", " \t", "a b c", "w " * rng.randint(1, 300)]), rng.choice(["b", "a", "é", "Z", None, "a", "a"])) for i in range(300)]
    docs += [(7, "one two three", "a")] * 90 + [(None, "x y", "b")] * 3 + [(8, "long " * 50_000, "Z"), (9, "", "only empty")]
    got = compare_mix(sp, docs)
    first = [r["positions"][0] for r in got if r["positions"]]
    assert first == sorted(first)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert [r.asDict() for r in got] == [r.asDict() for r in C.curriculum(sp.createDataFrame([(k, t, "en", s, 0) for k, t, s in docs], DOC).repartition(7), SCHEDULES).collect()]


def test_mix_of_one_source_nothing_and_other_columns(sp):
    compare_mix(sp, [(i, "w " * i, "s") for i in range(20)])
    compare_mix(sp, [(1, None, None), (2, "", "a")])
    assert C.curriculum(sp.createDataFrame([], DOC), SCHEDULES).count() == 0
    odd = sp.createDataFrame([(1, "a b", "en", "s", 0)], DOC).withColumns({"h": F.lit(1), "Bucket": F.lit(2), "n": F.lit(3), "words": F.lit(4)})
    assert C.curriculum(odd, SCHEDULES).first()["taken"] == 3
    with pytest.raises(ValueError):
        C.curriculum(odd, [((0.0, 1.0), (0.9, 1.0))])


def test_mix_with_small_buckets(sp, monkeypatch):
    monkeypatch.setattr(C, "BUCKET_ROWS", 3)
    monkeypatch.setattr(C, "SENT_SOURCES", 0)
    rng = random.Random(4)
    compare_mix(sp, [(i, "w " * rng.randint(0, 30), rng.choice("abcde")) for i in range(200)])


def test_any_stretch_of_the_training_has_the_weights_of_its_time(sp):
    rng = random.Random(3)
    docs = sp.createDataFrame([(i, "w " * rng.randint(1, 9), "en", "ab"[i % 2], 0) for i in range(8000)], DOC)
    falling, rising = ((0.0, 2.0), (1.0, 0.0)), ((0.0, 0.0), (1.0, 2.0))
    visits = C.training_order(C.curriculum(docs, [falling, rising], share=1.0)).collect()
    at = [r["position"] for r in visits]
    assert at == sorted(at)
    for low in (0.0, 0.25, 0.5, 0.75):
        own = [r for r in visits if low <= r["position"] < low + 0.25]
        share = sum(r["size"] for r in own if r["source"] == "a") / sum(r["size"] for r in own)
        assert abs(share - (1 - low - 0.125)) < 0.03


def negatives(rows, anchor, positives=5, per=5, least=80):
    """rows: (id, label, vector) with null ids last."""
    rows = [r for r in dict.fromkeys((i, l, None if v is None else tuple(v)) for i, l, v in rows) if r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    dot = lambda a, b: int(sum(x * y for x, y in zip(a, b)))
    out = []
    for a in rows:
        if a[0] is None or not anchor(a[0]):
            continue
        scored = [(-dot(a[2], r[2]), r[0] is None, r[0] or 0, r) for r in rows if r is not a]
        near = sorted((x for x in scored if x[3][1] == a[1]), key=lambda x: x[:3])[:positives]
        for p, _, _, row in near:
            fit = sorted((x for x in scored if x[3][1] != a[1] and least * -p <= 100 * -x[0] <= 100 * -p), key=lambda x: x[:3])[:per]
            out += [(a[0], row[0], k, x[3][0], -p, -x[0]) for k, x in enumerate(fit, 1)]
    return out


NEG = "vec_id long, label int, vector array<double>, rank int, block int"


def compare_negatives(spark, rows):
    got = H.hard_negatives(spark.createDataFrame([(i, l, v, 1, 2) for i, l, v in rows], NEG), F.col("vec_id") % 10 == 0)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, negatives(rows, lambda i: i % 10 == 0)))


def vectors(seed, n, dims=8, labels=4, spread=40):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 100, (6, dims))
    return [(i, int(rng.integers(labels)), [float(x) for x in np.floor(centre[rng.integers(6)] + rng.normal(0, spread, dims))]) for i in range(n)]


def test_negatives_equal_the_definition(sp):
    compare_negatives(sp, vectors(1, 600))


def test_negatives_over_many_blocks_and_clusters(sp, monkeypatch):
    # Blocks and clusters of a few rows, and one label with most of them.
    monkeypatch.setattr(H, "BLOCK_NUMBERS", 8 * 70)
    monkeypatch.setattr(H, "CLUSTER_NUMBERS", 8 * 9)
    compare_negatives(sp, [(i, 0 if i % 3 else l, v) for i, l, v in vectors(2, 900)])


def test_negatives_of_unusual_rows(sp):
    rows = vectors(3, 120)
    rows += [(500, None, [1.0] * 8), (510, 1, None), (520, 1, [1.0, None]), (530, 1, [float("nan")] * 8), (540, 1, [float("inf")] * 8), (550, 2, [0.0] * 8), (560, 2, [5.0]), (570, 2, [])]
    rows += [rows[10]] * 40 + [(None, 1, rows[20][2]), (None, 2, rows[20][2])]
    rows += [(700 + i, i % 2, [3.0] * 8) for i in range(30)]  # ties
    compare_negatives(sp, rows)
    none = sp.createDataFrame([], NEG)
    assert H.hard_negatives(none, F.col("vec_id") % 10 == 0).count() == 0


def test_large_numbers_are_exact():
    a, x = np.full((1, 4), 2.0 ** 27 + 1), np.full((1, 4), 2.0 ** 28 + 3)
    assert H.products(a, x)[0, 0] == 4 * (2 ** 27 + 1) * (2 ** 28 + 3)
    with pytest.raises(ValueError):
        H.products(a * 2.0 ** 20, x * 2.0 ** 20)


def test_members_end_their_walk_early():
    rng = np.random.default_rng(0)
    centre = rng.normal(0, 1000, (40, 16))
    x = np.floor(np.repeat(centre, 300, 0) + rng.normal(0, 30, (12_000, 16)))
    a = np.floor(centre[:1] + rng.normal(0, 30, (20, 16)))
    lows, highs = np.full((20, 1), -2 ** 62), np.full((20, 1), 2 ** 62)
    m, _, c, s, made = H.walk(a, x, np.arange(len(x)), lambda m, c: np.ones((len(m), len(c)), bool), lows, highs, 5)
    full = H.products(a, x)
    assert sorted(zip(m.tolist(), s.tolist())) == sorted((i, v) for i in range(20) for v in np.sort(full[i])[-5:].tolist())
    assert made < full.size / 4


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_hard_negatives", "op13_curriculum_mix"])
def test_queries_equal_their_sql(sp, name):
    from oracle import compare, connect

    assert compare(QUERIES[name], sp, connect("sf0.01"), "sf0.01") is None
