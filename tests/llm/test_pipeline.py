"""The stages one after the other, on documents with planted cases."""

import random

import corpus_pipeline as P
from pyspark.sql import functions as F

from brute import DOC, roots, shingle_set

ROWS = 240


def planted(tmp_path, sp):
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    own = []
    passage = text(70)
    for i in range(ROWS):
        body = text(100)
        if i in (50, 60, 70):
            body = f"{text(30)} {passage} {text(30)}"
        if i in (80, 81):
            body = own[10][1]
        if i == 90:
            body = own[11][1].replace("menu line\n", "menu line\nextra ")
        if i % 2:
            body = f"menu line\n{body}"
        own.append((i, body, "en", f"s{i % 2}", len(body)))
    own += [(300, "too short", "en", "s0", 9), (301, "same again now " * 60, "en", "s0", 900), (302, None, None, None, None), (None, text(60), "en", "s1", 1), (303, "", "en", "s1", 0)]
    folder = str(tmp_path)
    sp.createDataFrame(own, DOC).withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit("mine")).write.parquet(f"{folder}/documents.parquet")
    sp.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(sp, tmp_path):
    folder = planted(tmp_path, sp)
    docs = sp.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    quality, lines, near, passages, pack = (f for _, f in P.STAGES)
    one = quality(sp, docs, folder)
    assert one.columns == names and {r.kept for r in one.collect()} == {"mine"}
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in one.collect()} == {300, 301, 302, 303}
    two = lines(sp, one, folder)
    assert two.columns == names and two.count() == one.count()
    assert not any("menu line" in r.text for r in two.where("source = 's1'").collect())
    assert all(r.n_chars == len(r.text) for r in two.where("doc_id IS NOT NULL").collect())
    three = near(sp, two, folder).cache()
    sets = {r.doc_id: shingle_set(r.text, 5) for r in two.where("doc_id IS NOT NULL").collect()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(sets, links)
    assert len(links) >= 3
    assert {r.doc_id for r in three.collect()} == {d for d in root if root[d] == d} | {None}
    four = passages(sp, three, folder)
    before, after = {r.doc_id: r for r in three.collect()}, {r.doc_id: r for r in four.collect()}
    assert {d for d in after if after[d].text != before[d].text} == {60, 70}
    assert len(after[60].text.split()) == 60 and after[60].n_chars == len(after[60].text)
    five = pack(sp, four, folder)
    assert {r.doc_id for r in five.collect()} == set(after)


def test_empty_table(sp, tmp_path):
    folder = planted(tmp_path, sp)
    docs = sp.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        out = stage(sp, docs, folder)
        assert out.count() == 0


def test_repeated_rows(sp, tmp_path):
    folder = planted(tmp_path, sp)
    docs = sp.read.parquet(f"{folder}/documents.parquet").where("doc_id < 5")
    twice = docs.unionByName(docs)
    near = P.STAGES[2][1](sp, twice, folder)
    assert sorted(r.doc_id for r in near.collect()) == [0, 1, 2, 3, 4]


def test_run_equals_the_stages(sp, tmp_path):
    folder = planted(tmp_path, sp)
    got = P.run(sp, folder)
    assert got.agg(F.sum("length")).first()[0] > 0 and "sequence_id" in got.columns


def test_documents_of_one_number_that_differ_stay(sp):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = sp.createDataFrame([(1, one, "en", "s", 0), (1, two, "en", "s", 0), (1, two, "en", "s", 0), (5, "", "en", "s", 0)], schema)
    assert sorted((r.doc_id, r.text) for r in P.keep_one_of_each(sp, docs, "").collect()) == sorted([(1, one), (1, two), (5, "")])
