"""Span and grid operators against the row-by-row stepper, on random and on edge-case histories."""

import random
from dataclasses import replace

import pytest
from stepper import DAY, counted, label_days, timed_total

from spanledger.config import SeriesSettings, Settings
from spanledger.operators import grid as G

BASE = 1_700_000_000 // DAY * DAY
CFG = replace(Settings(), timed_services=("Stay", "Housing"), counted_services=("Food", "Ride"),
              label_window_days=14, label_threshold_days=6, series=SeriesSettings(step_days=3, t_x=3))
GRID = G.Grid(first=BASE + 6 * DAY, step=3 * DAY, n=6, horizon=2 * DAY, close=1)


def history(rng, n):
    out = []
    for _ in range(n):
        svc = rng.choice(["Stay", "Stay", "Housing", "Food", "Ride"])
        unit = rng.choice([60, 300, 900, 3600])
        s = BASE + rng.randrange(0, 28 * DAY // unit) * unit
        length = rng.choice([0, 1, 14 * 60, 900, 901, 16 * 60, 3600, 5 * 3600, DAY, 3 * DAY, 20 * DAY])
        if svc == "Stay" and rng.random() < 0.4:
            s = BASE + 3 * DAY + rng.randrange(0, 200) * 60      # dense stretch: short steps after overlaps
            length = 900 + rng.randrange(0, 40) * 60
        out.append((svc, s, s + length))
        if rng.random() < 0.15:
            out.append((svc, s, s + rng.choice([0, 600, 7200])))
    return out


def edge_cases():
    b = BASE
    return {
        1: [("Stay", b, b + 14 * 60)], 2: [("Stay", b, b + 900)], 3: [("Stay", b, b + 960)],
        4: [("Stay", b, b + DAY), ("Stay", b + 3600, b + DAY + 600), ("Stay", b + 7200, b + DAY + 1300)],
        5: [("Housing", b, b), ("Housing", b, b + 5)], 6: [("Stay", b - 40 * DAY, b + 40 * DAY)],
        7: [("Housing", b + 100, b + 9 * DAY), ("Housing", b + 50, b + 8 * DAY), ("Housing", b + 10, b + 7 * DAY)],
        8: [("Food", b, b + 5), ("Food", b + 1, b + 5), ("Ride", b + 2, b + 5), ("Food", b + 3, b + 5)],
        9: [("Food", b, b + 30 * DAY), ("Food", b + 60, b + 10 * DAY), ("Ride", b + 61, b + 10 * DAY)],
        10: [("Stay", b + i * 60, b + i * 60 + 900) for i in range(3000)],
        11: [("Stay", GRID.first, GRID.first + DAY)], 12: [("Other", b, b + DAY)],
        13: [("Stay", b + 4 * DAY, b + 5 * DAY), ("Stay", b + 4 * DAY, b + 6 * DAY)],
    }


@pytest.fixture(scope="module")
def histories():
    rng = random.Random(11)
    h = edge_cases()
    for c in range(100, 340):
        h[c] = history(rng, rng.choice([1, 3, 8, 25]))
    return h


@pytest.fixture(scope="module")
def rows(spark, histories):
    data = [(c, v, s, e) for c, h in histories.items() for v, s, e in h]
    return spark.createDataFrame(data, "client long, service string, s long, e long").repartition(6).cache()


def as_dict(df, *cols):
    return {(r["client"], r["k"]): tuple(r[c] for c in cols) for r in df.collect()}


def cutoffs():
    return [GRID.first + k * GRID.step for k in range(GRID.n)]


def test_label_days_match_the_stepper(rows, histories):
    got = as_dict(G.label_days(rows, GRID, CFG), "days")
    for c, h in histories.items():
        for k, cut in enumerate(cutoffs()):
            assert got.get((c, k), (0,))[0] == label_days(h, cut + GRID.horizon, 14), (c, k)


def test_labels_cover_every_client_seen(rows, histories):
    got = as_dict(G.labels(rows, GRID, CFG), "GroundTruth")
    want = {(c, k): (int(label_days(h, cut + GRID.horizon, 14) >= 6),) for c, h in histories.items()
            for k, cut in enumerate(cutoffs()) if min(s for _, s, _ in h) <= cut + GRID.horizon}
    assert got == want


def test_running_totals_match_the_stepper(rows, histories):
    names = {"Stay": "a", "Housing": "b", "Food": "c", "Ride": "d"}
    flows = (G.timed_flows(G.timed_spans(rows, CFG), GRID, CFG)
             .unionByName(G.counted_flows(G.counted_since(rows, CFG), GRID)))
    got = as_dict(G.running_totals(G.presence(rows, GRID, CFG, False), flows, GRID, names), *names.values())
    want = {}
    for c, h in histories.items():
        for k, cut in enumerate(cutoffs()):
            if not any(s <= cut and v != "Other" for v, s, _ in h) or not any(s <= cut - 1 for _, s, _ in h):
                continue
            n = counted(h, ("Food", "Ride"), cut - 1)
            want[c, k] = (timed_total(h, "Stay", cut - 1), timed_total(h, "Housing", cut - 1), n["Food"], n["Ride"])
    assert got == want


def test_step_windows_match_the_stepper(rows, histories):
    names = {"Stay": "a", "Housing": "b", "Food": "c", "Ride": "d"}
    got = as_dict(G.step_features(G.window_timed(rows, GRID, CFG).unionByName(G.window_counted(rows, GRID, CFG)), names),
                  *names.values())
    for c, h in histories.items():
        for k, cut in enumerate(cutoffs()):
            n = counted(h, ("Food", "Ride"), cut - 1, cut - GRID.step)
            want = (timed_total(h, "Stay", cut - 1, cut - GRID.step),
                    timed_total(h, "Housing", cut - 1, cut - GRID.step), n["Food"], n["Ride"])
            assert got.get((c, k), (0, 0, 0, 0)) == want, (c, k)


def test_a_client_with_most_of_the_rows(spark):
    """One client, many overlapping records, none of them in one window by client alone."""
    rng = random.Random(5)
    h = [(rng.choice(["Stay", "Housing", "Food"]), s := BASE + rng.randrange(0, 20 * DAY), s + rng.randrange(0, 4_000)) for _ in range(20_000)]
    df = spark.createDataFrame([(1, *r) for r in h] + [(2, "Stay", BASE, BASE + DAY)], "client long, service string, s long, e long")
    names = {"Stay": "a", "Housing": "b", "Food": "c", "Ride": "d"}
    flows = G.timed_flows(G.timed_spans(df, CFG), GRID, CFG).unionByName(G.counted_flows(G.counted_since(df, CFG), GRID))
    got = as_dict(G.running_totals(G.presence(df, GRID, CFG, False), flows, GRID, names), "a", "b", "c")
    days = as_dict(G.label_days(df, GRID, CFG), "days")
    for k, cut in enumerate(cutoffs()):
        assert got[1, k] == (timed_total(h, "Stay", cut - 1), timed_total(h, "Housing", cut - 1), counted(h, ("Food", "Ride"), cut - 1)["Food"])
        assert days[1, k] == (label_days(h, cut + GRID.horizon, 14),)


def test_income_latest_per_type(spark):
    data = [(1, "a", BASE, 10.0), (1, "a", BASE + 5 * DAY, 30.0), (1, None, BASE, 7.0), (1, "b", BASE, None),
            (2, "a", BASE + 7 * DAY, 5.0)]
    df = spark.createDataFrame(data, "client long, kind string, s long, amount double")
    got = as_dict(G.income_totals(df, GRID, []), "IncomeTotal")
    assert got[1, 0] == (37.0,) and got[1, 5] == (37.0,)
    assert (2, 0) not in got and got[2, 1] == (5.0,)


def test_core_plans_have_no_python_and_no_cross_join(rows):
    flows = G.timed_flows(G.timed_spans(rows, CFG), GRID, CFG).unionByName(
        G.counted_flows(G.counted_since(rows, CFG), GRID))
    for df in (flows, G.labels(rows, GRID, CFG), G.window_timed(rows, GRID, CFG), G.window_counted(rows, GRID, CFG)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
