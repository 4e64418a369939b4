"""Queries against their SQL, the search end to end, sources and edge cases."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixtable.functions import scores as S
from helixtable.operators import kernels as K
from helixtable.operators import regions as G
from helixtable.operators import relational as R
from helixtable.plans import search as P
from helixtable.plans.queries import QUERIES, SQL
from helixtable.sources import sinks
from helixtable.sources import tables as T


def normal(frame):
    def one(x):
        if x is None or x is pd.NA or (isinstance(x, (float, np.floating)) and np.isnan(x)):
            return "none"
        return str(round(float(x), 6)) if isinstance(x, (float, np.floating, int, np.integer)) and not isinstance(x, (bool, np.bool_)) else str(x)

    return sorted(tuple(map(one, r)) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.fixture(scope="session")
def duck(sf):
    from pathlib import Path

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    a, b = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert normal(a) == normal(b)


def planted(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), n))
    profiles = [(i, f"p{i}", word(40)) for i in range(3)]
    targets = [(i, f"t{i}", word(150) + (profiles[i % 3][2] if i % 4 == 0 else "") + word(150)) for i in range(24)] + [(24, "empty", "")]
    p = spark.createDataFrame(profiles, "profile_ordinal int, name string, consensus string").withColumn("model_length", F.length("consensus"))
    t = spark.createDataFrame(targets, "seq_ordinal long, name string, residues string").withColumn("length", F.length("residues")).withColumn("status", F.when(F.col("length") == 0, "EMPTY").otherwise("OK"))
    return p, t, {(i % 3, i) for i in range(0, 24, 4)}


def test_search_finds_planted_copies(spark):
    p, t, want = planted(spark)
    r = P.search(p, t)
    hits = {(x["profile_ordinal"], x["seq_ordinal"]) for x in r.hits.where("included").collect()}
    assert hits == want
    d = r.domains.join(r.hits.where("included").select("profile_ordinal", "seq_ordinal"), ["profile_ordinal", "seq_ordinal"]).collect()
    assert all(abs(x["env_from"] - 151) <= 3 and abs(x["env_to"] - 190) <= 3 for x in d) and len(d) == len(want)
    steps = r.domains.select("profile_ordinal", "seq_ordinal", "domain_ordinal", F.posexplode("trace").alias("step", "s")).select("profile_ordinal", "seq_ordinal", "domain_ordinal", "step", "s.*")
    assert R.trace_faults(steps, ["profile_ordinal", "seq_ordinal", "domain_ordinal"]).count() == 0
    report = P.domain_report(r.domains, r.hits, 25, P.SearchOptions())
    assert report.where("c_evalue > i_evalue").count() == 0


def test_search_does_not_depend_on_partitions(spark):
    p, t, _ = planted(spark)
    a = P.search(p, t).hits.select("profile_ordinal", "seq_ordinal", "rank", F.round("score", 9))
    b = P.search(p, t.repartition(7, "name")).hits.select("profile_ordinal", "seq_ordinal", "rank", F.round("score", 9))
    assert R.set_differences(a, b).first().asDict() == {"only_first": 0, "only_second": 0}


def test_search_on_empty_tables(spark):
    p, t, _ = planted(spark)
    assert P.search(p, t.where("false")).hits.count() == 0


@pytest.mark.parametrize("bad", [{"f1": 1.5}, {"f3": float("nan")}, {"e": -1}, {"z": 0}])
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        P.SearchOptions(**bad)


def test_decision_keeps_what_is_not_certain(spark):
    d = spark.createDataFrame([(0.5, "OK"), (0.01, "OK"), (float("nan"), "OK"), (None, "OK"), (0.9, "OVERFLOW"), (None, "NO_RESULT")], "p double, status string")
    assert [r[0] for r in d.select(S.decision(F.col("p"), F.col("status"), 0.02)).collect()] == ["DEFINITE_REJECT", "KEEP", "KEEP", "KEEP", "KEEP", "KEEP"]


def test_status_ladder(spark):
    rows = [(g, t, 40, 3, 190, 10) for g in (0, 50, 72, 73, 90, 127, 200) for t in (5, 22, 80)]
    d = spark.createDataFrame(rows, "gain int, tjb int, tbm int, tec int, base int, bias int")
    status, numerator = S.ssv_status(*map(F.col, d.columns))
    for r in d.select("*", status.alias("s"), numerator.alias("n")).collect():
        raw = 128 + min(r.gain, 127)
        if r.tjb + r.tbm + r.tec + r.bias >= 127:
            want = ("NO_RESULT", None)
        elif raw >= 255 - r.bias:
            want = ("NO_RESULT" if r.base - r.tjb - r.tbm < 128 else "OVERFLOW", None)
        elif raw + r.base - r.tjb - r.tbm - 128 >= 255 - r.bias:
            want = ("OVERFLOW", None)
        elif raw + r.base - r.tjb - r.tbm - 128 - r.tec > r.base:
            want = ("NO_RESULT", None)
        else:
            want = ("OK", raw + r.base - r.tjb - r.tbm - 128 - r.tec - r.tjb - r.base)
        assert (r.s, r.n) == want


@pytest.mark.parametrize("size", [3, 8, 4096])
def test_regions_by_ranges_equal_kernel(spark, size):
    rng = np.random.default_rng(3)
    tracks, want, doubts = [], {}, {}
    for k in range(40):
        n = int(rng.integers(1, 60))
        t = np.concatenate([[[0, 0, 0]], rng.random((n, 3)) * [0.4, 0.4, 1 if k % 2 else 0.5]])
        tracks += [(k, j, *map(float, t[j])) for j in range(1, n + 1)]
        cum = t.copy()
        cum[:, :2] = np.cumsum(t[:, :2], axis=0)
        found, doubts[k] = K.regions(cum)
        want[k] = [(b, e, m) for b, e, m in found]
    d = spark.createDataFrame(tracks, "k int, j int, starts double, ends double, inside double").repartition(3)
    got = {k: [] for k in want}
    for r in G.regions(d, "k", "j", size=size).orderBy("k", "begin").collect():
        got[r["k"]].append((r["begin"], r["end"], r["split"] >= 0.2))
    assert got == want
    routes = {r["k"]: r for r in G.track_routes(d, "k", "j", size=size).collect()}
    assert {k: r["regions"] for k, r in routes.items()} == {k: len(w) for k, w in want.items()}
    for k, r in routes.items():
        assert (r["route"] == "UNCERTAIN") == (r["uncertain"] > 0)
        if not r["uncertain"]:
            assert r["route"] == ("NO_REGIONS" if not want[k] else "MULTIDOMAIN" if any(m for _, _, m in want[k]) else "SIMPLE")


@pytest.mark.parametrize("size", [4, 64])
def test_overlaps_equal_plain_walk(spark, size):
    rng = np.random.default_rng(8)
    rows = [(int(k), i, int(b), int(b + n)) for k in range(4) for i, (b, n) in enumerate(zip(rng.integers(0, 120, 50), rng.integers(0, 9, 50), strict=True))]
    rows += [(9, 0, 0, 100), (9, 1, 3, 5), (9, 2, 50, 60), (9, 3, 100, 100), (9, 4, 101, 101)]  # nested, touching, apart
    want = {}
    for k in {r[0] for r in rows}:
        chain, upto = [], None
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[2:]):
            if upto is None or r[2] > upto:
                chain.append([])
                upto = r[3]
            chain[-1].append(r)
            upto = max(upto, r[3])
        for c in chain:
            for r in c:
                want[r[:2]] = (min(x[2] for x in c), max(x[3] for x in c), len(c))
    d = spark.createDataFrame(rows, "k int, i int, lo int, hi int").repartition(3)
    assert {(r["k"], r["i"]): (r["cluster_begin"], r["cluster_end"], r["clustered"]) for r in G.overlaps(d, ["k"], "lo", "hi", size).collect()} == want


def test_seeds_miss_nothing(spark):
    """A gain of 4 matches needs a shared word: every pair whose exact score requires it shares one."""
    rng = np.random.default_rng(2)
    p = [(i, "".join(rng.choice(list("ACD"), 6))) for i in range(5)]
    t = [(i, "".join(rng.choice(list("ACD"), 12))) for i in range(20)]
    required = [(a, b) for a, x in p for b, y in t if any(x[i : i + 4] in y for i in range(3))]
    pw = R.words_of(spark.createDataFrame(p, "profile_ordinal int, c string"), "profile_ordinal", "c", 4)
    tw = R.words_of(spark.createDataFrame(t, "seq_ordinal int, r string"), "seq_ordinal", "r", 4)
    kept = R.seed_pairs(pw, tw)
    assert R.false_rejects(spark.createDataFrame(required, "profile_ordinal int, seq_ordinal int"), kept).count() == 0
    assert kept.count() == len(required)


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACD\nEF G\n>two\n\n>three x\nWW\n")
    r = T.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("ordinal").collect()
    assert [(x["identifier"], x["length"], x["residues"]) for x in r] == [("one", 6, "ACDEFG"), ("two", 0, ""), ("three", 2, "WW")]
    sinks.write_lines(T.fasta_text(T.read_fasta(spark, str(tmp_path / "a.fa")).coalesce(1).orderBy("ordinal"), 4), str(tmp_path / "out"))
    again = T.read_fasta(spark, str(tmp_path / "out")).orderBy("ordinal").collect()
    assert [x["residues"] for x in again] == ["ACDEFG", "", "WW"]
    (tmp_path / "b.fa").write_text("ACD\n>one\nA\n")
    with pytest.raises(Exception, match="before the first header"):
        T.read_fasta(spark, str(tmp_path / "b.fa")).collect()


def test_profile_text(spark, tmp_path):
    (tmp_path / "a.hmm").write_text("HMMER3/f [3.4]\nNAME  alpha\nACC   PF1.2\nLENG  12\nGA    25.0 20.5;\nHMM  A C\nNAME  no\n//\nHMMER3/f [3.4]\nNAME  beta\nLENG  7\nHMM  A\n//\n")
    r = T.read_profile_text(spark, str(tmp_path / "a.hmm")).orderBy("ordinal").collect()
    assert [(x["name"], x["accession"], x["model_length"], x["ga"]) for x in r] == [("alpha", "PF1.2", 12, [25.0, 20.5]), ("beta", None, 7, None)]


def test_reports_and_timings(spark, tmp_path):
    (tmp_path / "r.txt").write_text("Query model(s):   1  (10 nodes)\nTarget sequences:   20  (300 residues searched)\nPassed MSV filter:   4\nDomain search space  (domZ):   2\n//\nQuery model(s):   2\n//\n")
    r = {(x["block"], x["measure"]): x["value"] for x in T.parse_search_report(spark, str(tmp_path / "r.txt")).collect()}
    assert r == {(0, "queries"): 1.0, (0, "targets"): 20.0, (0, "residues"): 300.0, (0, "passed_msv"): 4.0, (0, "dom_z"): 2.0, (1, "queries"): 2.0}
    (tmp_path / "t.tsv").write_text("schema_version\tclock\tquery_index\tquery\tmetric\tcount\telapsed_ns\n1\tmono\t0\tq\tmsv\t3\t40\n1\tmono\t0\tq\tfwd\t1\t9\n")
    m = T.timing_matrix(T.read_stage_timings(spark, str(tmp_path / "t.tsv")), ["msv", "fwd", "vit"]).first()
    assert (m["msv_count"], m["fwd_ns"], m["missing"]) == (3, 9, ["vit"])


def test_manifest_drift(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / n).write_text(n)
    then = T.file_manifest(spark, f"{tmp_path}/*").select("path", "size_bytes", "sha256").collect()
    then = spark.createDataFrame(then, "path string, size_bytes long, sha256 string")
    (tmp_path / "a").write_text("x")
    (tmp_path / "b").unlink()
    (tmp_path / "c").write_text("c")
    drift = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in T.manifest_drift(then, T.file_manifest(spark, f"{tmp_path}/*")).collect()}
    assert drift == {"a": "CONTENT", "b": "MISSING", "c": "UNEXPECTED"}


def test_tables_report_and_lines(spark, tmp_path):
    d = spark.createDataFrame([("t", "q", 1e-9, 12.34, 0.5, True)], "target string, query string, evalue double, score double, bias double, reported boolean")
    assert "12.3" in sinks.target_table(d).first()[0]
    m = sinks.write_report({"hits": d}, str(tmp_path / "report")).collect()
    assert m[0]["rows"] == 1
    with pytest.raises(Exception, match="exist"):
        sinks.write_report({"hits": d}, str(tmp_path / "report"))
    a = spark.createDataFrame([("# time 1",), ("x  ",)], "value string")
    b = spark.createDataFrame([("x",), ("# time 2",)], "value string")
    assert sinks.science_lines(a).first() == sinks.science_lines(b).first()
    line = sinks.result_row({k: F.lit(v) for k, v in {"name": "n", "query": "q", "score": 1.0, "evalue": 1e-5, "c_evalue": 1e-6, "i_evalue": 1e-7, "env_from": 3, "env_to": 9, "domain_score": 2.5}.items()} | {k: F.lit(None).cast("int") for k in ("ali_from", "ali_to", "hmm_from", "hmm_to")})
    assert spark.range(1).select(line).first()[0] == "n\tq\t1.00\t1.00e-05\t1.00e-06\t1.00e-07\t3\t9\t2.50\t3\t9\t\t"


def test_lockstep_and_fallback(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "o int, name string")
    b = spark.createDataFrame([(0, "x"), (1, "z"), (2, "w")], "o int, name string")
    assert [r["mismatch"] for r in T.lockstep(a, b, "o", ["name"]).orderBy("o").collect()] == [None, "name differs", "streams of different length"]
    d = spark.createDataFrame([(1, False), (1, True), (2, False)], "k int, failed boolean")
    assert sorted((r["k"], r["fallback"]) for r in R.atomic_fallback(d, ["k"], "failed").collect()) == [(1, True), (1, True), (2, False)]


def test_sharded_tasks(spark):
    o = spark.createDataFrame([("g", i, w) for i, w in enumerate([1, 1, 100, 1])], "g string, o int, w long")
    parts = spark.createDataFrame([("g", 2, i, 25) for i in range(4)], "g string, first int, part int, w long")
    tasks = R.balanced_tasks(o, "g", "o", "w", 2)
    got = R.sharded_tasks(tasks, parts, "g", (1, 2)).orderBy("task", "shard").collect()
    assert sum(r["weight"] for r in got) == 103
    assert sum(r["last"] for r in got) == tasks.count() and max(r["shard"] for r in got) == 1


def test_entry_survives_without_the_optional_package(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "helixtable", tmp_path / "helixtable", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'search_hits' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_provenance(spark):
    from helixtable.operators import provenance as V

    a = spark.createDataFrame([(1, "x", 2.0), (2, "y", None)], "k int, s string, v double")
    stages = {"one": ["k"], "two": ["s", "v"]}
    sealed = V.sealed(a, stages)
    assert V.broken_seals(sealed, stages).count() == 0
    assert [r["broken"] for r in V.broken_seals(sealed.withColumn("v", F.lit(3.0)), stages).collect()] == ["two", "two"]
    assert V.same_content(a, a.orderBy(F.desc("k")).repartition(3)) and not V.same_content(a, a.where("k = 1"))
    with pytest.raises(ValueError):
        V.one_to_one(a, a.where("k = 1"), "k")
    assert V.one_to_one(a, a.select("k", F.lit(1).alias("w")), "k").count() == 2
    facts = spark.createDataFrame([(1, 5), (1, 6)], "k int, f int")
    with pytest.raises(Exception, match="twice"):
        V.scattered(a, facts, "k").collect()
    with pytest.raises(Exception, match="nowhere"):
        V.scattered(a, spark.createDataFrame([(9, 5)], "k int, f int"), "k").collect()
    d = spark.createDataFrame([(1.0, 0.1), (1.05, 0.1), (float("nan"), 0.1)], "s double, e double")
    assert [r[0] for r in d.select(V.stable_call(F.col("s"), F.col("e"), 1.2)).collect()][:2] == [True, True]
    assert [r[0] for r in d.select(V.stable_call(F.col("s"), F.col("e"), 1.09)).collect()][:2] == [False, False]


def test_streams_in_batches(spark, tmp_path):
    from helixtable.streaming.ingest import append_batches, counted_batches, counters, files

    for i in range(3):
        spark.range(i * 10, i * 10 + 10).selectExpr("id % 2 AS k", "cast(id AS double) AS value").coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    schema = spark.read.parquet(str(tmp_path / "in0")).schema
    got = lambda d: sorted((r["k"], r["rows"], r["total"]) for r in d.collect())
    stream, parts = files(spark, str(tmp_path / "in*"), schema), str(tmp_path / "parts")
    want = [(0, 15, 210.0), (1, 15, 225.0)]
    assert got(counted_batches(stream, "k", parts, str(tmp_path / "c1"))) == want
    assert len(list((tmp_path / "parts").glob("batch=*"))) == 3
    # the same batches once more, as after a failure before their commit: each counts once
    assert got(counted_batches(stream, "k", parts, str(tmp_path / "c1b"))) == want == got(counters(spark, "k", parts, schema))
    append_batches(stream, str(tmp_path / "out"), str(tmp_path / "c2"), lambda b: b.where("k = 0"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15


def test_chunks_and_lists(spark):
    d = spark.createDataFrame([(0, 5), (0, 3), (2, 9)], "profile_ordinal int, seq_ordinal int")
    assert [tuple(r) for r in R.candidate_lists(d).select("profile_ordinal", "start", "n", "targets").orderBy("profile_ordinal").collect()] == [(0, 0, 2, [3, 5]), (2, 2, 1, [9])]
    assert [r["chunk"] for r in R.chunked(spark.range(7).withColumnRenamed("id", "o"), "o", 3).orderBy("o").collect()] == [0, 0, 0, 1, 1, 1, 2]
