"""The journal of a search against plain Python, and certified seeds against every word of small models."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixtable.operators import journal as J
from helixtable.operators import seeds as W


@pytest.fixture(scope="module")
def case(spark):
    """Two profiles over 137 targets; profile 2 has nothing but a certain row."""
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 50, 137)
    rows = [(1, int(p), ["SIMPLE", "F3_REJECT", "MULTI"][p % 3], int(p % 4)) for p in sorted(rng.choice(137, 40, replace=False))] + [(1, 136, "SIMPLE", 3), (1, 0, "MULTI", 4)] + [(2, 50, "F3_REJECT", 3)]
    rows = list({r[:2]: r for r in rows}.values())
    targets = spark.createDataFrame([(1000 + 7 * i, int(n)) for i, n in enumerate(sizes)], "seq long, size int").repartition(3)
    return sizes, rows, J.numbered(targets, "seq", "size"), spark.createDataFrame(rows, "k int, place long, route string, stage int"), spark.createDataFrame([(1,), (2,), (3,)], "k int")


def test_numbered(case):
    sizes, _, places, _, _ = case
    got = [(r["seq"], r["place"], r["before"], r["after"]) for r in places.orderBy("seq").collect()]
    total = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    assert got == [(1000 + 7 * i, i, total[i], total[i + 1]) for i in range(len(sizes))]


@pytest.mark.parametrize("span", [16, 1000])
def test_entries_and_blocks(spark, case, span):
    sizes, rows, places, d, keys = case
    out = J.entries(d, "k", keys, places, "route", "stage", F.col("route") == "F3_REJECT", span)
    want = []
    for k in (1, 2, 3):
        own = {p: (route, stage) for kk, p, route, stage in rows if kk == k}
        for low in range(0, 137, span):
            entry = []
            for p in range(low, min(137, low + span)):
                route, stage = own.get(p, ("SPAN", 0))
                route = "SPAN" if route == "F3_REJECT" else route
                if route == "SPAN" and entry and entry[-1][2] == "SPAN":
                    entry[-1] = (entry[-1][0], entry[-1][1] + 1, "SPAN", entry[-1][3] + int(sizes[p]), entry[-1][4] + stage)
                else:
                    entry.append((p, 1, route, int(sizes[p]), stage))
            want += [(k, low // span, i, *e) for i, e in enumerate(entry, 1)]
    got = sorted(tuple(r[c] for c in ("k", "range", "entry", "begin", "length", "route", "residues", "passed")) for r in out.collect())
    assert got == sorted(want)
    packed = J.blocks(out, "k", 4)
    assert max(len(r["begins"]) for r in packed.collect()) <= 4
    routes = {(r["k"], r["place"]): r["route"] for r in J.read_back(packed, "k").collect()}
    assert routes == {(k, p): next((r if r != "F3_REJECT" else "SPAN" for kk, q, r, _ in rows if (kk, q) == (k, p)), "SPAN") for k in (1, 2, 3) for p in range(137)}
    assert J.damaged(packed, "k").count() == 0
    forged = packed.withColumn("routes", F.when((F.col("k") == 1) & (F.col("range") == 0) & (F.col("block") == 1), F.transform("routes", lambda x: F.lit("SPAN"))).otherwise(F.col("routes")))
    assert [tuple(r) for r in J.damaged(forged, "k").collect()] == [(1, 0, 1)]


def test_one_block_is_checked_by_its_proof(spark, case):
    _, _, places, d, keys = case
    packed = J.blocks(J.entries(d, "k", keys, places, "route", "stage", F.lit(False), 16), "k", 4)
    nodes = J.tree(packed, "k", 2)
    top = nodes.agg(F.max("level")).first()[0]
    roots = {r["k"]: r["hash"] for r in nodes.where(F.col("level") == top).collect()}
    leaves = nodes.where("level = 0")
    assert set(roots) == {1, 2, 3} and {r["hash"] for r in leaves.collect()} == {r["hash"] for r in packed.collect()}
    proofs = {}
    for r in J.proof(nodes, "k", leaves.select("k", "node"), 2).collect():
        proofs.setdefault((r["k"], r["node"]), {})[r["level"]] = r["children"]
    for r in leaves.collect():
        h, at = r["hash"], r["node"]
        for level in range(1, top + 1):
            children = proofs[r["k"], r["node"]][level]
            assert h in children
            h, at = hashlib.sha256("".join(children).encode()).hexdigest(), at // 2
        assert h == roots[r["k"]]


def test_cores_miss_no_pair():
    """Every target of up to 6 symbols whose best segment reaches the gain that a level stands for holds a core of that level."""
    rng = np.random.default_rng(6)
    for m in range(1, 7):
        for symbols in (2, 3):
            for _ in range(6):
                gains = rng.integers(-3, 5, (m, symbols))
                for hits in (1, 2, 3):
                    found = W.cores(gains, hits)
                    need = (hits - 1) * int(gains.max()) + 1
                    for n in range(1, 7):
                        for target in itertools.product(range(symbols), repeat=n):
                            best = 0
                            for shift in range(-m + 1, n):
                                run = 0
                                for j in range(m):
                                    if 0 <= j + shift < n:
                                        run = max(0, run + int(gains[j][target[j + shift]]))
                                        best = max(best, run)
                            if best >= need and gains.max() > 0:
                                held = any(
                                    all(target[s + o] == key >> 5 * k & 31 for k, o in enumerate(o for o in range(m) if offsets >> o & 1))
                                    for first, offsets, key in found
                                    for s in range(n - offsets.bit_length() + 1)
                                )
                                assert held, (gains, hits, target)


def test_too_many_cores_leave_a_profile_open():
    assert W.cores(np.full((12, 4), 3), 3, limit=20) is None
    assert W.cores(np.full((3, 4), -1), 3) == []
