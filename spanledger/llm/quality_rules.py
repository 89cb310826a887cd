"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Every rule compares a ratio of the text with a cutoff of a fixed grid. Labelled documents that are not held out test the cutoffs of each stratum and
rule from the loosest to the strictest: a cutoff passes while the exact binomial probability of so few false rejections, if their rate were
``risk / rules``, is at most ``error / (strata * rules)``. The order is fixed, so a stop at the first failure needs no further
correction; strata and rules are corrected for by Bonferroni. So with probability 1 - error, no stratum falsely rejects more than ``risk``
of its good documents. Among cutoffs that passed, the one with most rejected bad documents, less ``cost`` times the good ones, is taken, the loosest first.
A stratum without enough labels has no cutoff and rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.llm.common import cut_lineage, fresh_names

# White space between words, and symbols.
GAP = r"[\x20\x09-\x0D]+"
IN_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Cutoffs in thousandths, from the loosest to the strictest: a ratio above the cutoff rejects.
GRID = (900, 800, 700, 600, 500, 400, 300, 200, 150, 100, 80, 60, 40, 20)
#: Rule: (numerator, denominator), both whole numbers.
RULES = {"symbols": ("n_symbols", "word_chars"), "capitals": ("n_capitals", "word_chars"), "repeats": ("n_repeat_words", "n_words"),
         "same_lines": ("n_dup_lines", "n_lines")}
RISK, ERROR, COST = 0.02, 0.05, 20
MIN_WORDS, MAX_REPEAT = 50, 50
#: Strata whose cutoffs may be broadcast (less than 5 MB).
BROADCAST_STRATA = 10_000
#: Labels that may be broadcast to pick their documents before the figures are made (about 15 MB as a hash table); more are joined with the figures of all.
PICKED_LABELS = 200_000


FIGURES = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def text_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_capitals, n_lines, n_dup_lines and n_repeat_words (all long) of every whole text.

    Null and empty texts have zeros. Windows of three words are compared by 64-bit hashes; these are sorted within the row with the
    position in their low bits, so a text of n words takes n log n steps. Columns of these names are replaced."""
    body, words, each, wide, keys, mask, pairs, again = fresh_names(docs, "body", "words", "each", "wide", "keys", "mask", "pairs", "again")
    df = docs.withColumn(body, F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn(words, F.filter(F.split(body, GAP), lambda w: w != ""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(IN_WORD))
    n = F.size(words)
    df = df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.char_length(body) - F.char_length(F.regexp_replace(body, SYMBOLS, ""))).cast("long"),
        "n_capitals": (F.char_length(body) - F.char_length(F.regexp_replace(body, r"\p{Lu}+", ""))).cast("long"),
        "n_lines": _let(lines, lambda x: F.size(x)).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        each: F.when(n >= 3, F.transform(words, lambda w: F.xxhash64(w))),
        # Low bits that a position needs are blanked in the hashes.
        mask: F.expr(f"~(shiftleft(1L, cast(ceil(log2(size(`{words}`) + 2)) AS int)) - 1)"),
    })
    n = F.size(each)
    part = lambda i: F.slice(each, F.lit(i), n - 2)
    combine = lambda x, y: F.xxhash64(x, y)
    df = df.withColumn(wide, F.zip_with(F.zip_with(part(1), part(2), combine), part(3), combine))
    low, h, k = F.col(mask), F.col(wide), F.col(keys)
    df = df.withColumn(keys, F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(low).bitwiseOR(i.cast("long")))))
    at = lambda x: x.bitwiseAND(F.bitwise_not(low)).cast("int")
    same = F.zip_with(F.slice(k, F.lit(1), F.size(k) - 1), F.slice(k, F.lit(2), F.greatest(F.size(k) - 1, F.lit(0))),
                      lambda x, y: F.when(x.bitwiseXOR(y).bitwiseAND(low) == 0, F.struct(at(x).alias("x"), at(y).alias("y"))))
    df = df.withColumn(pairs, F.when(F.size(k) > 1, F.filter(same, lambda p: p.isNotNull())))
    true = F.filter(pairs, lambda p: h[p["x"]] == h[p["y"]])
    places = _let(true, lambda t: F.sort_array(F.array_distinct(F.concat(F.transform(t, lambda p: p["x"]), F.transform(t, lambda p: p["y"])))))
    df = df.withColumn(again, F.when(F.size(pairs) > 0, places))
    d = F.col(again)
    covered = F.aggregate(d, F.lit(0).cast("long"), lambda n, _: n + 3)
    overlap = F.aggregate(F.sequence(F.lit(1), F.size(d) - 1), F.lit(0).cast("long"), lambda n, j: n + F.greatest(F.lit(0), 3 - (d[j] - d[j - 1])))
    total = F.when(d.isNull() | (F.size(d) == 0), F.lit(0)).when(F.size(d) == 1, F.lit(3)).otherwise(covered - overlap)
    df = df.withColumn("n_repeat_words", total.cast("long"))
    # Rows pass through a generator, so that no later filter is rewritten in terms of the text and computed a second time.
    rest = [c for c in docs.columns if c.lower() not in FIGURES]
    return df.select(*rest, F.inline(F.array(F.struct(*FIGURES))))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def over(rule: str, cutoff: Column) -> Column:
    """True when the ratio of the rule is above the cutoff; a text without a denominator is below."""
    a, b = RULES[rule]
    return 1000 * F.col(a) > cutoff * F.col(b)


def held_out(key: str = "doc_id") -> Column:
    """Three in sixteen labelled documents never take part in choosing cutoffs, so that a report can use them. A null key is held out."""
    return F.coalesce(F.substring(F.md5(F.col(key).cast("string")), 1, 1).isin("0", "1", "2"), F.lit(True))


def allowed_false(n: Column, rate: float, error: Column) -> Column:
    """Most false rejections among ``n`` good documents with which P(Binomial(n, rate) <= k) <= error; -1 where even none is too many.

    The probabilities follow one another by their ratio, in logarithms; the walk ends at the mean of the distribution."""
    odds = rate / (1 - rate)
    start = F.struct((n * F.log(F.lit(1 - rate))).alias("p"), F.lit(0.0).alias("c"), F.lit(-1).cast("long").alias("k"))

    def step(s: Column, i: Column) -> Column:
        c = s["c"] + F.exp(s["p"])
        ok = (s["k"] == i - 1) & (c <= error)
        return F.struct((s["p"] + F.log((n - i) / (i + 1) * odds)).alias("p"), c.alias("c"), F.when(ok, i.cast("long")).otherwise(s["k"]).alias("k"))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor(n * rate)), start, step)["k"]).otherwise(F.lit(-1).cast("long"))


def chosen_cutoffs(docs: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", risk: float = RISK, error: float = ERROR, cost: float = COST) -> DataFrame:
    """Cutoff of every stratum and rule that has one: stratum, rule, cutoff, n_good.

    ``docs`` has the text, or its figures. ``labels`` has the key and ``quality``; rows with a null label, repeated labels (each key counts once, by its lowest quality) and base failures are
    left out. A null stratum is a stratum of its own, ''. One row per stratum, rule and grid point is all that is sorted."""
    marks = labels.where(F.col("quality").isNotNull() & ~held_out(key)).groupBy(key).agg(F.min("quality").alias("quality"))
    ready = all(c in docs.columns for c in FIGURES)
    few = not ready and marks.count() <= PICKED_LABELS
    known = docs.join(F.broadcast(marks), key) if few else docs
    figures = known if ready else text_figures(known)
    known = figures.select(key, F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), base_failed().alias("failed"), *sorted({c for ab in RULES.values() for c in ab}), *["quality"] * few)
    known = (known if few else known.join(marks, key)).where(~F.col("failed"))
    # Counted per stratum, rule and grid point before anything is shuffled.
    wide = known.groupBy("stratum").agg(
        F.count(F.when(F.col("quality") == 1, 1)).alias("n_good"),
        *(F.count(F.when(over(r, F.lit(c)) & (F.col("quality") == q), 1)).alias(f"{r}_{c}_{q}") for r in RULES for c in GRID for q in (0, 1)))
    cells = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.lit(i).alias("level"), F.col(f"{r}_{c}_0").alias("bad"), F.col(f"{r}_{c}_1").alias("good"))
                      for r in RULES for i, c in enumerate(GRID)))
    wide = cut_lineage(wide)
    each_error = error / (len(RULES) * max(1, wide.count()))
    limit = wide.withColumn("allowed", allowed_false(F.col("n_good"), risk / len(RULES), F.lit(each_error)))
    each = limit.select("stratum", "n_good", "allowed", F.inline(cells))
    walk = Window.partitionBy("stratum", "rule").orderBy("level")
    passed = each.withColumn("stop", F.max((F.col("good") > F.col("allowed")).cast("int")).over(walk)).where("stop = 0")
    best = Window.partitionBy("stratum", "rule").orderBy((F.col("bad") - cost * F.col("good")).desc(), "level")
    return (passed.withColumn("place", F.row_number().over(best)).where((F.col("place") == 1) & (F.col("bad") > cost * F.col("good")))
            .select("stratum", "rule", "cutoff", "n_good"))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", **limits: float) -> DataFrame:
    """All columns of ``docs``, the figures, ``base_failed``, ``rejected_by`` (names of rules, null if none) and ``kept``.

    Rows stay one for one, also repeated ones; a null key, text or stratum crashes nothing. The map of cutoffs is one row per stratum (the strata are
    those of the labelled rows); it is broadcast up to BROADCAST_STRATA rows and joined by stratum beyond."""
    figures = text_figures(docs)
    cuts = chosen_cutoffs(docs.drop(*FIGURES), labels, stratum, key, **limits).groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    mine, cut = fresh_names(figures, "stratum", "cuts")
    own = figures.withColumn(mine, F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    cuts = cut_lineage(cuts.select(F.col("stratum").alias(mine), F.col("cuts").alias(cut)))
    judged = own.join(F.broadcast(cuts) if cuts.count() <= BROADCAST_STRATA else cuts, mine, "left")
    hits = F.filter(F.array(*(F.when(over(r, F.col(cut)[r]), F.lit(r)) for r in RULES)), lambda x: x.isNotNull())
    judged = judged.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.when(F.size(hits) > 0, F.array_join(hits, ",")))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()).drop(mine, cut)
