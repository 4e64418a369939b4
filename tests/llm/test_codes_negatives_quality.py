"""Product codes, hard negatives and quality rules: brute force, edges, held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixtable.llm import codes, negatives, quality, queries
from helixtable.llm.common import table

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("seed", range(6))
def test_nearest_equals_full_comparison(seed):
    """Ties and repeated entries included: few values, so that many distances are equal."""
    rng = np.random.default_rng(seed)
    book, parts = rng.integers(-3, 4, (rng.integers(1, 17), 4)), rng.integers(-3, 4, (500, 4))
    at, d = codes.nearest(parts, book)
    full = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (at == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()


def plain_codes(rows):
    kept = [(i, lab, [math.floor(4096 * float(x)) for x in v]) for i, v, lab in rows if v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    part = lambda v, p: v[2 * p : 2 * p + 2]
    books = [[part(v, p) for _, _, v in kept[:16]] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(6):
        for p, book in enumerate(books):
            of = [[] for _ in book]
            for _, _, v in kept:
                of[near(part(v, p), book)[1]].append(part(v, p))
            books[p] = [[sum(c) // len(own) for c in zip(*own, strict=True)] if own else e for own, e in zip(of, book, strict=True)]
    out = [(i, lab, [near(part(v, p), books[p]) for p in range(8)]) for i, lab, v in kept]
    by = Counter()
    for _, lab, x in out:
        by[lab] += sum(d for d, _ in x)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for _, k in x), sum(d for d, _ in x), by[lab], digest) for i, lab, x in out)


def vectors(n, width, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=width)], int(rng.integers(0, 3))) for i in range(n)]
    rows += [(n, None, 0), (n + 1, [NAN] * width, 0), (n + 2, [INF] + [0.0] * (width - 1), 1), (n + 3, [None] + [0.0] * (width - 1), 1), (n + 4, [], 1), (n + 5, [0.5] * width, None), (None, [0.25] * width, 2), (3, rows[3][1], 2), (2, rows[4][1], 1), (n + 6, [1.0] * 5, 0)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("n", [0, 5, 90])
def test_codes_brute(spark, n):
    rows = vectors(n, 16) if n else vectors(10, 16)[10:13]
    d = spark.createDataFrame(rows, SCHEMA).withColumn("v", F.lit(1)).withColumn("n", F.lit("x")).withColumn("error", F.lit("y")).repartition(3)
    got = sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in codes.compress(d).collect())
    assert got == (plain_codes(rows) if n else [])


def plain_negatives(rows):
    kept = [(i, lab, [math.floor(256 * float(x)) for x in v], k) for k, (i, v, lab) in enumerate(rows) if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, lab, v, k in kept:
        if i is not None and i % 100 == 0:
            met = [(dot(v, w), j, other) for j, other, w, at in kept if at != k and len(w) == len(v)]
            for p, j, _ in sorted((x for x in met if x[2] == lab), key=order)[:5]:
                fit = sorted((x for x in met if x[2] != lab and 80 * p <= 100 * x[0] <= 100 * p), key=order)[:5]
                out += [(i, j, rank, x[1], p, x[0]) for rank, x in enumerate(fit, 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("width", [1, 3, 20])
def test_negatives_brute(spark, monkeypatch, width):
    monkeypatch.setattr(negatives, "TILE", 60)
    monkeypatch.setattr(negatives, "BLOCK", 2)
    rows = vectors(420, width, width)
    rows = [(i, [round(x * 2) / 2 if x is not None and math.isfinite(x) else x for x in v] if v else v, lab) for i, v, lab in rows] + [(100, rows[100][1], 0), (100, rows[100][1], 0)]
    d = spark.createDataFrame(rows, SCHEMA).withColumn("uid", F.lit(1)).withColumn("tile", F.lit("x")).withColumn("score", F.lit(None).cast("int")).repartition(3)
    got = sorted(str((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"])) for r in negatives.mine(d).collect())
    assert got == plain_negatives(rows) and (width < 3 or got)


def test_negatives_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(empty).count() == 0
    alone = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 2), (100, [1.0], 2), (200, [-1.0, 0.0], 1)], SCHEMA)
    # 0 and 200 are positives of each other at a score below zero: no window; 100 meets nothing of its length
    assert negatives.mine(alone).count() == 0


def plain_statistics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t ", "a b c d e a b c d e", "a a a a a a", "a a a a a", "one\n\none\n \n one\none", "x " * 50_000, "# <b> | 100% *", "\x0b\x0cA\x1fb　c\x85 é 😀\r\nA\r\n", "w1 w2 w3 w4 w5 w6 w1 w2 w3 w4 w5", "q" * 200_000]


def test_quality_statistics(spark):
    rows = [(k if k % 3 else None, t, k) for k, t in enumerate(TEXTS)]
    d = spark.createDataFrame(rows, "doc_id long, text string, k int").withColumn("w_", F.lit(1)).withColumn("n_words_", F.lit("x"))
    got = {r["k"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.statistics(d.select("k", F.coalesce("text", F.lit("")).alias("text_"))).collect()}
    assert got == {k: plain_statistics(t) for k, t in enumerate(TEXTS)}
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (2, 0, 0), (4, None, 1), (None, 0, 0), (5, 7, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    out = quality.quality(d, labels).collect()
    assert len(out) == len(TEXTS) and all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in out)
    assert all(r["kept"] == (not r["base_failed"]) for r in out)  # labels of one kind only: no rules
    assert quality.quality(d.where("false"), labels).count() == 0
    assert quality.clean(d, labels).columns == d.columns


def test_quality_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    for r in queries.op13_quality(spark, sf).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_statistics(texts[r["doc_id"]])
        assert r["kept"] == (not r["base_failed"] and r["rule"] == 0) and (r["reason"] != "") == (r["rule"] > 0)


def test_best_step_equals_plain_search():
    rng = np.random.default_rng(5)
    cuts = {s: list(range(8)) for s in quality.STATISTICS}
    for _ in range(40):
        x = [{"at": at, "place": int(p), "bad": int(b), "n": int(rng.integers(0, 9))} for at in range(3) for p in range(9) for b in (0, 1)]
        for row in x:  # each statistic has all rows
            row["n"] += 1
        sums = Counter()
        for row in x:
            sums[row["at"], row["bad"]] += row["n"]
        for at in (1, 2):
            for b in (0, 1):
                x.append({"at": at, "place": 8, "bad": b, "n": max(0, sums[0, b] - sums[at, b])})
                x.append({"at": 0, "place": 8, "bad": b, "n": max(0, sums[at, b] - sums[0, b]) if at == 1 else 0})
        found = quality.best_step(x, cuts)
        best = 0
        for at in range(3):
            n, p = (sum(r["n"] for r in x if r["at"] == at and r["bad"] == b) for b in (0, 1))
            for cut in range(8):
                for above in (True, False):
                    n1, p1 = (sum(r["n"] for r in x if r["at"] == at and r["bad"] == b and (r["place"] > cut) == above) for b in (0, 1))
                    g = quality.gain(p, n, p1, n1)
                    if found and (at, above, cut) == (found[0].at, found[0].above, found[0].place):
                        mine = (g, n1)
                    best = max(best, g)
        assert (found is None and best <= 1e-9) or (abs(mine[0] - best) < 1e-6 and mine[1] == found[1])


def test_rules_learn_a_planted_conjunction(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        x = {s: float(rng.uniform()) for s in quality.STATISTICS}
        bad = (x["symbol_share"] > 0.6 and x["repeat_share"] <= 0.5) or x["upper_share"] > 0.9
        rows.append((i, bool(bad), *[x[s] for s in quality.STATISTICS]))
    d = spark.createDataFrame(rows, "doc_id long, bad boolean, " + ", ".join(f"{s} double" for s in quality.STATISTICS))
    rules = quality.learned(d)
    used = {lit.statistic for r in rules for lit in r}
    assert {"symbol_share", "repeat_share", "upper_share"} <= used
    c = d.select(F.count_if((quality.number(rules) > 0) == F.col("bad")).alias("right")).first()["right"]
    assert c >= 0.97 * 3000


def test_quality_on_held_out_labels(spark):
    """Rules from two thirds of the labels, judged on the rest."""
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    out = quality.quality(table(spark, sf, "documents"), labels.where("crc32(cast(doc_id as string)) % 3 <> 1"))
    rows = [r for r in out.join(labels, "doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    bad, good = [r for r in rows if r["quality"] == 0], [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    assert sum(not r["kept"] for r in bad) >= 0.95 * len(bad) and sum(r["kept"] for r in good) >= 0.99 * len(good)
