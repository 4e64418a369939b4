"""Likeness of fingerprints comes from what they print, and follows the text through insertions."""

import math
import random

from pyspark.sql import functions as F

from helixtable.llm import fingerprints as P
from helixtable.llm import queries
from helixtable.llm.common import table


def printed_likeness(a, b):
    at = 8 * P.EXACT
    lanes = [[int(x[at + 8 * k : at + 8 * k + 8], 16) for k in range(P.NEAR)] for x in (a, b)]
    n = [int(x[-8:], 16) for x in (a, b)]
    u, v = ([2 * x - c for x in lane] for lane, c in zip(lanes, n, strict=True))
    dot = lambda x, y: float(sum(p * q for p, q in zip(x, y, strict=True)))
    if a == b:
        return 1.0
    if not dot(u, u) or not dot(v, v):
        return float(n[0] == n[1])
    return max(0.0, min(1.0, dot(u, v) / math.sqrt(dot(u, u) * dot(v, v))))


def test_likeness_is_that_of_the_printed_fingerprints(spark, sf):
    docs = table(spark, sf, "documents")
    rows = queries.op10_fingerprints(spark, sf).collect()
    ids = sorted((r["doc_id"] for r in docs.collect()), reverse=True)
    by = {r["doc_id"]: r for r in rows}
    for i, r in by.items():
        assert len(r["fingerprint"]) == 8 * (P.EXACT + P.NEAR + 1)
        assert abs(printed_likeness(r["fingerprint"], r["edited_fingerprint"]) - r["near_edited"]) < 1e-9
        follows = by[ids[(ids.index(i) + 1) % len(ids)]]
        assert abs(printed_likeness(r["fingerprint"], follows["fingerprint"]) - r["near_next"]) < 1e-9


def test_likeness_outlives_insertions(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    text = " ".join(rng.choice(words) for _ in range(400))
    other = " ".join(rng.choice(words) for _ in range(400))
    cut = text.split(" ")
    forms = {"same": text, "front": "x" + text, "word": " ".join([*cut[:100], "inserted", *cut[100:]]), "less": " ".join(cut[:200] + cut[205:]), "other": other}
    d = spark.createDataFrame([(k, text, v) for k, v in forms.items()], "k string, a string, b string")
    d = P.fingerprinted(P.fingerprinted(d, "a", "me"), "b", "you")
    got = {r["k"]: r["x"] for r in d.select("k", P.likeness("me", "you").alias("x")).collect()}
    assert got["same"] == 1 and min(got["front"], got["word"], got["less"]) >= 0.9 and got["other"] <= 0.5


def test_paragraphs_come_and_go(spark):
    d = spark.createDataFrame([("one\ntwo\nthree", "three\none\ntwo", "one\nthree", "two")], "a string, b string, c string, d string")
    for c in "abcd":
        d = P.fingerprinted(d, c, f"f{c}")
    r = d.select("fa", "fb", (P.added(F.col("fc_exact"), F.col("fd_exact")) == F.col("fa_exact")).alias("plus"), (P.removed(F.col("fa_exact"), F.col("fd_exact")) == F.col("fc_exact")).alias("minus")).first()
    assert r["fa"] == r["fb"] and r["plus"] and r["minus"]
