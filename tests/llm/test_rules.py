"""Line removal, quality rules, classifier and sharding."""

import hashlib
import random
import zlib
from collections import Counter
from math import comb

import pytest
from oracle import ROOT, compare, connect
from pyspark.sql import functions as F

from spanledger.llm import line_dedup as L
from spanledger.llm import quality_classifier as C
from spanledger.llm import quality_rules as Q
from spanledger.llm import sharding as H
from spanledger.llm.catalog import QUERIES

from brute import words


@pytest.mark.parametrize("name", ["op5_line_dedup", "op6_quality_rules"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_matches_sql(sp, name, sf):
    assert compare(QUERIES[name], sp, connect(sf), sf) is None


@pytest.mark.parametrize("bound", [100_000, 0])
def test_lines(sp, monkeypatch, bound):
    monkeypatch.setattr(L, "BROADCAST_LINES", bound)
    rng = random.Random(2)
    own = []
    for i in range(120):
        host = rng.choice(["http://a.x/p", "https://A.x/q", "http://b.y", None, "no url"])
        lines = [f"own {i}", "", *(f" menu {k}\t" for k in range(6) if rng.random() < k / 8), *["twice"] * 2]
        own.append((i, host, None if i % 40 == 0 else "\n".join(lines)))
    own += [(200, "http://few", "menu 5"), (201, "http://few", "menu 5"), (202, "http://a.x", ""), (203, "http://a.x", "a\r\n" * 50_000)]
    own.append(own[5])
    df = sp.createDataFrame(own, "page_id long, url string, text string").withColumn("host", F.lit("clash")).withColumn("n_removed", F.lit("x"))
    got = sorted((r.page_id, r.text, r.n_lines, r.n_removed) if r.text is not None else (r.page_id, "", 0, 0) for r in L.drop_boilerplate(df, L.url_host()).collect())
    host = lambda u: "" if not u or "://" not in u else u.split("://")[1].split("/")[0].lower()
    pages, seen = Counter(host(u) for _, u, _ in own), Counter()
    for _, u, t in own:
        seen.update({(host(u), x.strip(" \t\r")) for x in (t or "").split("\n")})
    want = []
    for i, u, t in own:
        h = host(u)
        bad = lambda x: x.strip(" \t\r") != "" and seen[h, x.strip(" \t\r")] > 1 and seen[h, x.strip(" \t\r")] > L.RATIO * pages[h]  # noqa: B023, E731
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if not bad(x)]
        want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert got == sorted(want)
    assert sum(w[3] for w in want) > 100
    assert L.drop_boilerplate(df.limit(0), L.url_host()).count() == 0


def figures(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    win = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = Counter(win)
    again = {j for i, k in enumerate(win) if often[k] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), sum(c.isupper() for c in text or ""), len(lines), len(lines) - len(set(lines)), len(again))


def test_figures(sp):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("a b c d E É ## x|y 中".split()) for _ in range(rng.randint(0, 60))).replace("d", "\n") for _ in range(150)]
    texts += [None, "", " ", "\n\n", "a", "a b", "a b c", "a a a a a", "x " * 20_000, "a b c a b c", "\x0b\x0c a\x1c\x85b"]
    df = sp.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("N_WORDS", F.lit("clash"))
    got = {r.doc_id: tuple(r[c] for c in Q.FIGURES) for r in Q.text_figures(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == figures(t), repr(t)


def test_binomial_bound(sp):
    cases = [(n, e) for n in (0, 1, 50, 200, 1000, 3000) for e in (0.5, 0.05, 0.001)]
    df = sp.createDataFrame(cases, "n long, e double")
    got = {(r.n, r.e): r.k for r in df.withColumn("k", Q.allowed_false(F.col("n"), 0.02, F.col("e"))).collect()}
    for n, e in cases:
        k, total = -1, 0.0
        while n and k < n:
            total += comb(n, k + 1) * 0.02 ** (k + 1) * 0.98 ** (n - k - 1)
            if total > e or k + 1 > 0.02 * n:
                break
            k += 1
        assert got[n, e] == k, (n, e)


def labelled_texts(n=3000):
    rng = random.Random(8)
    out = []
    for i in range(n):
        w = [f"w{rng.randrange(5000)}" for _ in range(80)]
        bad = rng.random() < 0.2
        out.append((i, " ".join(x + "**" if bad and rng.random() < 0.8 else x for x in w), "en" if i % 10 else None, int(not bad)))
    return out


def test_cutoffs_are_safe_and_useful(sp):
    own = labelled_texts()
    docs = sp.createDataFrame([r[:3] for r in own], "doc_id long, text string, lang string")
    labels = sp.createDataFrame([(i, q) for i, _, _, q in own] + [(None, 1), (5, None), (9999, 1)], "doc_id long, quality int")
    out = {r.doc_id: r for r in Q.quality_rules(docs, labels).collect()}
    good = [i for i, _, s, q in own if q and s]
    bad = [i for i, _, s, q in own if not q and s]
    assert all(out[i].kept for i in good)
    assert sum(not out[i].kept for i in bad) > 0.95 * len(bad)
    assert all(out[i].kept for i, _, s, _ in own if s is None)  # too few labels in this stratum: nothing is rejected
    edges = sp.createDataFrame([(None, None, None), (1, "", "xx"), (1, "", "xx")], "doc_id long, text string, lang string")
    assert [r.kept for r in Q.quality_rules(edges, labels.limit(0)).collect()] == [False] * 3
    assert Q.quality_rules(docs.limit(0), labels).count() == 0


def test_many_labels_take_the_other_way(sp, monkeypatch):
    own = labelled_texts(600)
    docs = sp.createDataFrame([r[:3] for r in own], "doc_id long, text string, lang string")
    labels = sp.createDataFrame([(i, q) for i, _, _, q in own], "doc_id long, quality int")
    one = Q.chosen_cutoffs(docs, labels, risk=0.2).collect()
    monkeypatch.setattr(Q, "PICKED_LABELS", 0)
    assert sorted(map(str, one)) == sorted(map(str, Q.chosen_cutoffs(docs, labels, risk=0.2).collect())) and one


def test_classifier_on_held_out_rows(sp):
    sf = f"{ROOT}/sf0.1"
    labels = sp.read.parquet(f"{sf}/labels.parquet")
    docs = sp.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    scored = C.quality_scores(docs, labels).join(labels, "doc_id").where(C.held_out()).collect()
    bad, good = [r.score for r in scored if r.quality == 0], [r.score for r in scored if r.quality == 1]
    assert sum(g > b for g in good for b in bad) / len(good) / len(bad) > 0.99
    assert sum(g >= C.THRESHOLD for g in good) > 0.99 * len(good)
    assert sum(b < C.THRESHOLD for b in bad) > 0.85 * len(bad)


def test_classifier_edges(sp):
    docs = sp.createDataFrame([(1, None), (2, ""), (None, "a"), (3, "ab " * 50_000), (3, "ab " * 50_000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    none = sp.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in C.quality_scores(docs, none).collect()] == [0.5] * 5
    some = sp.createDataFrame([(i, i % 2) for i in range(10)] + [(None, 1), (2, None)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in C.quality_scores(docs, some).collect())
    assert C.quality_scores(docs.limit(0), some).count() == 0


def shards_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r.shard, []).append(r)
    return out


def test_sharding(sp, tmp_path):
    rng = random.Random(9)
    own = [(i, "é" * rng.randrange(300)) for i in range(4000)] + [(None, "x"), (5, None), (5, None), (5, ""), (6, "y" * 9000)]
    own += [(77, f"hot key {i}") for i in range(2000)]
    docs = sp.createDataFrame(own, "doc_id long, text string").repartition(6).withColumn("shard", F.lit("clash")).withColumn("slot", F.lit("clash"))
    got = H.shard_records(sp, docs, str(tmp_path / "map"), 24).collect()
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in own)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    by = shards_of(got)
    assert sorted(by) == list(range(24))
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    load = [sum(r["size"] for r in rows) for rows in by.values()]
    assert max(load) - min(load) <= 0.02 * max(load)


def test_map_versions(sp, tmp_path):
    loads = [(s, 100 + s % 7, 3) for s in range(2000)]
    first = H.first_map(loads, 24, 2000)
    grown = H.rebalanced(first, loads, 25)
    moved = {s for s in first if first[s] != grown[s]}
    assert moved and {grown[s] for s in moved} == {24} and len(moved) < 2 * 2000 / 25
    size = Counter()
    for s, b, _ in loads:
        size[grown[s]] += b
    assert max(size.values()) < 1.05 * sum(size.values()) / 25
    shrunk = H.rebalanced(grown, loads, 20)
    assert max(shrunk.values()) == 19
    H.store_map(sp, str(tmp_path), 1, first, loads)
    H.store_map(sp, str(tmp_path), 2, grown, loads)
    with pytest.raises(Exception, match="already exists"):
        H.store_map(sp, str(tmp_path), 2, grown, loads)
    assert {(r.virtual_slot, r.shard) for r in H.load_map(sp, str(tmp_path), 2).collect()} == set(grown.items())
    empty = sp.createDataFrame([], "doc_id long, text string")
    assert H.shard_records(sp, empty, str(tmp_path / "none"), 24).count() == 0


def test_text_hash_of_removed_lines():
    assert hashlib.sha256(b"").hexdigest().endswith("b855")


def test_a_repeated_row_does_not_fill_one_shard(sp, tmp_path):
    rows = [(i, f"text {i}") for i in range(4000)] + [(7, "the same row")] * 2000
    docs = sp.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = H.shard_records(sp, docs, str(tmp_path / "map"), 24).collect()
    by = shards_of(got)
    load = {s: sum(r["size"] for r in own) for s, own in by.items()}
    assert len(got) == 6000 and max(load.values()) < 1.1 * sum(load.values()) / 24
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_copies_are_numbered(sp):
    df = sp.createDataFrame([(i % 3 if i < 90 else i, None if i % 2 else "x") for i in range(120)], "a long, b string").repartition(5)
    got = Counter((r.a, r.copy) for r in H.numbered_copies(df.select("a"), ["a"]).collect())
    assert got == Counter([(a, c) for a in range(3) for c in range(30)] + [(a, 0) for a in range(90, 120)])


def test_lines_of_small_hosts_go(sp):
    rows = [(1, "http://few", "menu\nown 1"), (2, "http://few", "menu\nown 2"), (3, "http://one", "menu\nmenu")]
    got = {r.page_id: r.text for r in L.drop_boilerplate(sp.createDataFrame(rows, "page_id long, url string, text string"), L.url_host()).collect()}
    assert got == {1: "own 1", 2: "own 2", 3: "menu\nmenu"}
