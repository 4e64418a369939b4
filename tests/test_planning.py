"""Ranks, bounded sums and record selection against plain Python; continuation from scores against the whole search."""

import random

from pyspark.sql import functions as F

from helixtable.operators import planning as L
from helixtable.plans import search as P
from helixtable.sources import tables as T


def test_ranked_equals_one_sorted_list(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(9)) for i in range(500)]
    got = L.ranked(spark.createDataFrame(rows, "i int, w long").repartition(7), [F.col("w").desc(), F.col("i")], ("w",)).collect()
    total = 0
    for rank, (i, w) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += w
        assert (i, w, rank, total) in {(r.i, r.w, r["rank"], r.w_upto) for r in got if r["rank"] == rank}
    assert L.ranked(spark.createDataFrame([], "i int, w long"), [F.col("i")], ("w",)).count() == 0


def test_bounded_gain_by_enumeration(spark):
    rng = random.Random(4)
    series = {g: [rng.randrange(-9, 9) for _ in range(rng.randrange(1, 12))] for g in range(20)}
    rows = [(g, i, x) for g, xs in series.items() for i, x in enumerate(xs)]
    for most in (1, 3, 50):
        got = dict(L.bounded_gain(spark.createDataFrame(rows, "g int, i int, x long"), "g", "i", "x", most).collect())
        for g, xs in series.items():
            assert got[g] == max(0, max(sum(xs[a:b]) for a in range(len(xs)) for b in range(a + 1, min(len(xs), a + most) + 1)))


def test_text_records_name_their_problem(spark):
    records = spark.createDataFrame([("f", 0, "NAME  a\n//"), ("f", 1, "NAME  b\n//\n"), ("f", 2, "NAME  b\n//"), ("f", 3, "NAME  c\nCOM"), ("f", 4, "COM\n//")], "file string, ordinal long, value string")
    wanted = spark.createDataFrame([(k, "f", k, n) for k, n in enumerate(["a", "b", "b", "c", "d", "e"])], "place int, file string, ordinal long, name string")
    got = {r.place: r.problem for r in L.select_text_records(records, wanted).collect()}
    assert got == {0: None, 1: "DUPLICATE", 2: "DUPLICATE", 3: "UNTERMINATED", 4: "MISMATCH", 5: "MISSING"}


def test_continuation_from_scores_equals_the_search(spark, sf):
    profiles, targets = T.profile_table(spark.read.parquet(f"{sf}/benchmark.parquet")), T.targets(spark.read.parquet(f"{sf}/documents.parquet"))
    o = P.SearchOptions()
    r = P.search(profiles, targets, o)
    columns = ["profile_ordinal", "seq_ordinal", "route", F.round("forward_nats", 6), "regions"]
    want = {tuple(map(str, x)) for x in r.continued.select(*columns).collect()}
    again = P.from_msv_scores(r.pairs.where("action = 'KEEP'"), targets, profiles, o)
    assert again.select("profile_ordinal", "seq_ordinal", "past").exceptAll(r.filtered.select("profile_ordinal", "seq_ordinal", "past")).count() == 0
    rows = r.filtered.where("past = 'VITERBI'").select("profile_ordinal", "seq_ordinal", "bias_nats", "viterbi_bits")
    for given in (rows, rows.join(r.continued.select("profile_ordinal", "seq_ordinal", "forward_nats"), ["profile_ordinal", "seq_ordinal"])):
        got = {tuple(map(str, x)) for x in P.from_filter_scores(given, targets, profiles, o).select(*columns).collect()}
        assert got == want and want


def test_candidates_are_what_the_first_filter_keeps_of_all_pairs(spark):
    rng = random.Random(6)
    passages = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n)) for n in (1, 2, 7, 30, 59, 300)]
    texts = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWYX-") for _ in range(n)) for n in (1, 2, 5, 40, 40, 700, 6000, 30000)]
    texts += [texts[5][:300] + p + texts[5][300:] for p in passages] + [p[len(p) // 3 :] for p in passages[2:]]
    profiles = spark.createDataFrame([(i, f"p{i}", p, len(p)) for i, p in enumerate(passages)], "profile_ordinal int, name string, consensus string, model_length int")
    targets = spark.createDataFrame([(i, t, len(t), "OK") for i, t in enumerate(texts)], "seq_ordinal long, residues string, length int, status string")
    chunks = P.loaded(profiles)
    for o in (P.SearchOptions(), P.SearchOptions(f1=1e-6), P.SearchOptions(f1=0.5, m_mu=-3.0), P.SearchOptions(f1=1.0), P.SearchOptions(f1=0.0)):
        every = P.first_filter(P.segment_scores(chunks, targets), P.profile_constants(profiles, chunks), o)
        assert every.count() == len(passages) * len(texts)
        assert sorted(P.candidates(profiles, targets, chunks, o).collect()) == sorted(every.where("action = 'KEEP'").collect())
    assert P.segment_scores(chunks, targets, P.SearchOptions()).count() < len(passages) * len(texts)  # the rest does not leave the task


def test_words_as_residues_by_python(spark):
    texts = [None, "", " \t\n\x0b\x0c\r", "Some words, some WORDS here\x1fso  İstanbul ΣΑΣ"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    words = F.array_remove(F.split(F.lower(F.coalesce("t", F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    plain = F.array_join(F.transform(words, lambda w: F.substring(F.lit("ACDEFGHIKLMNPQRSTVWY"), (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % 20 + 1).cast("int"), F.lit(1))), "")
    got = rows.select("i", T.words_as_residues(F.col("t")).alias("got"), plain.alias("plain")).collect()
    assert all(r["got"] == r["plain"] for r in got) and any(r["got"] for r in got)
