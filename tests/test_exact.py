"""Hexadecimal floats, strict JSON and fact bitmaps against Python's own."""

import json
import math
import random
import struct
from collections import Counter

from pyspark.sql import functions as F

from helixtable.functions import floats as X
from helixtable.operators import facts as B
from helixtable.operators import strict as J


def printed(x):
    """As C prints a double with %a."""
    if math.isnan(x) or math.isinf(x):
        return str(x)
    h = x.hex()
    head, _, power = h.partition("p")
    head = head.rstrip("0").rstrip(".") if "." in head else head
    return f"{head}p{power}" if x else ("-" if math.copysign(1, x) < 0 else "") + "0x0p+0"


def test_floats(spark):
    rng = random.Random(2)
    xs = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, 1.0, -1.0, 0.1, 2.0**52, 2.0**-1022, 0.02, math.inf, -math.inf, math.nan]
    xs += [x for x in (struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)) if not math.isnan(x)] + [2.0**k for k in range(-1074, 1024, 13)] + [math.nextafter(2.0**k, 0) for k in range(-1070, 1024, 17)]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").repartition(2)
    x = F.col("x")
    d = d.withColumn("hex", X.hex_text(x)).withColumn("back", X.from_hex_text(F.col("hex"))).withColumn("up", X.next_above(x)).withColumn("down", X.next_below(x))
    for r in d.collect():
        v = xs[r["i"]]
        assert r["hex"] == printed(v), v
        assert (math.isnan(v) and math.isnan(r["back"])) or (r["back"] == v and math.copysign(1, r["back"]) == math.copysign(1, v))
        if not math.isnan(v):
            assert (r["up"], r["down"]) == (math.nextafter(v, math.inf), math.nextafter(v, -math.inf)), v


def test_widened(spark):
    ps = [0.0, 5e-324, 1e-300, 0.02, 0.5, math.nextafter(0.5, 0), 1.0]
    low, high = X.widened(F.col("p"), 3)
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", low.alias("low"), high.alias("high")).collect():
        a = b = r["p"]
        for _ in range(3):
            a, b = max(0.0, math.nextafter(a, -1)), min(1.0, math.nextafter(b, 2))
        assert r["low"] <= a and r["high"] >= b and 0 <= r["low"] <= r["high"] <= 1


def plain_faults(text):
    """The keys that stand twice, with their paths."""
    count = Counter()

    def pairs(p):
        return ("object", p)

    def walk(v, path):
        if isinstance(v, tuple):
            seen = Counter(k for k, _ in v[1])
            for k, n in seen.items():
                if n > 1:
                    count[path, k, n] += 1
            for k, x in v[1]:
                walk(x, f"{path}.{k}")
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}[{i}]")

    walk(json.loads(text, object_pairs_hook=pairs), "$")
    return count


def made(rng, depth=0):
    kind = rng.random()
    if depth > 3 or kind < 0.3:
        return rng.choice(["1", "-2.5e3", "true", "null", '"a,b:{c}"', '"q\\"[x]"', '""'])
    if kind < 0.5:
        return "[" + ", ".join(made(rng, depth + 1) for _ in range(rng.randrange(4))) + "]"
    key = lambda: rng.choice(['"a"', '"b"', '"a b"', '"\\u0061"', '"x:y"', '"}"'])
    return "{" + ",".join(f"{key()} :{made(rng, depth + 1)}" for _ in range(rng.randrange(5))) + "}"


def test_json_faults(spark):
    rng = random.Random(5)
    texts = [made(rng) for _ in range(300)] + ["{", "{'a': 1}", '{"a": 1,}', "", None]
    got = {i: Counter() for i in range(len(texts))}
    for r in J.json_faults(spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3), "i", "t").collect():
        got[r["i"]][r["path"], r["name"], r["copies"]] += 1
    for i, t in enumerate(texts[:300]):
        assert got[i] == plain_faults(t), t
    assert [sum(got[i].values()) for i in range(300, 305)] == [1, 1, 1, 1, 0]


def test_json_faults_of_a_long_text(spark):
    """A walk whose time grows with the square of a text's length does not end on these; equal keys of two rows are two texts."""
    n = 200_000
    text = '{"log": [{' + ", ".join(f'"k{i % (n // 2)}": {i}' for i in range(n)) + '}, {"a": 1, "\\ud800": 2}]}'
    out = J.json_faults(spark.createDataFrame([(1, text), (2, '{"a": 1, "a": 2}'), (2, '{"a": 1, "a": 2}'), (3, '{"a": {"b": 1}, "a')], "i int, t string"), "i", "t").collect()
    assert len(out) == n // 2 + 3 and {(r["path"], r["copies"]) for r in out if r["i"] == 1} == {("$.log[0]", 2)}
    assert sorted((r["i"], r["name"], r["copies"]) for r in out if r["i"] > 1) == [(2, "a", 2), (2, "a", 2), (3, "INVALID", 1)]


def test_canonical(spark):
    texts = ['{"b": 1, "a": {"d": [1, 2, {"z": null, "y": "\\u0041"}], "c": true}}', '{"a":{"c":true,"d":[1,2,{"y":"A","z":null}]},"b":1}', '{"a": 1, "a": 2}', "nope"]
    out = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(J.canonical(F.col("t"))).collect()]
    assert out[0] == out[1] == '{"a":{"c":true,"d":[1,2,{"y":"A","z":null}]},"b":1}' and out[2:] == [None, None]


def test_fact_bitmaps(spark):
    rng = random.Random(9)
    names = ["a", "b", "c", "d"]
    rows = [(rng.choice("xy"), i * 11, [n for n in names if rng.random() < 0.3]) for i in range(9000)]
    maps = B.fact_bitmaps(spark.createDataFrame(rows, "stage string, at long, facts array<string>").repartition(3), "stage", "at", "facts")
    sets = [("ab", ["a", "b"]), ("acd", ["a", "c", "d"]), ("none", ["q"]), ("aq", ["a", "q"])]
    d = spark.createDataFrame(sets, "name string, facts array<string>")
    some = {(r["stage"], r["name"]): r["rows"] for r in B.with_any(maps, "stage", d).collect()}
    every = {(r["stage"], r["name"]): r["rows"] for r in B.with_all(maps, "stage", d).collect()}
    for s in "xy":
        for name, of in sets:
            own = [set(f) for k, _, f in rows if k == s]
            assert some.get((s, name), 0) == sum(bool(f & set(of)) for f in own)
            assert every.get((s, name), 0) == sum(set(of) <= f for f in own)
    assert {(r["stage"], r["fact"]): r["rows"] for r in B.fact_totals(maps, "stage").collect()} == Counter((s, n) for s, _, f in rows for n in f)


def test_decoded(spark):
    out = [r[0] for r in spark.createDataFrame([(0,), (5,), (10,)], "b long").select(B.decoded(F.col("b"), {"one": 1, "two": 2, "four": 4})).collect()]
    assert out == [[], ["one", "four"], ["two", "UNKNOWN"]]
