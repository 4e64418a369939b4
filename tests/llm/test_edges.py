"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixtable.llm import embeddings, fingerprints, html, lines, mixing, packing, pii, secrets, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, rank_ int, size int, blob string, fp int, key string, at int, copies int, removed string, score int, guest_ int"
LONG = "x" * 150_000 + " " + "1" * 5_000 + "@" + "a.b" * 2_000
TEXTS = [
    (1, "The cat sat on the mat and the dog ran away from it all day long", "s1"), (1, "The cat sat on the mat and the dog ran away from it all day long", "s1"), (1, "another text under the same id", None), (2, None, "s1"), (3, "", "s2"), (None, "no id here at all, friend", "s2"), (None, None, None),
    (4, "\n\n \t\r\n", "s3"), (5, LONG, "s1"), (6, "héllo wörld ñandú 日本語 \U0001f600 text", "s2"), (7, "The cat sat on the mat and the dog ran away from it all day long today", "s3"), (8, "word", "s3"), (9, "\x0b\x0c odd\x1fspace nbsp  ", "s3"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, len(t or ""), 7, 7, 7, "b", 7, "k", 7, 7, "r", 7, 7) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, None, 0), (6, 0, 0), (8, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


V = __import__("public_tokenizers").path("word_bpe_49k.json")
BY_ROW = {
    "pii": pii.find, "simhash": simhash.near_duplicates, "mixing": mixing.mix, "secrets": secrets.secrets, "lines": lines.line_dedup, "fingerprints": fingerprints.fingerprint_edits,
}


@pytest.mark.parametrize("name", BY_ROW)
def test_a_row_for_each_document(docs, name):
    out = BY_ROW[name](docs)
    got = sorted((r[0] is None, r[0] or 0) for r in out.select("doc_id").collect())
    assert got == sorted((i is None, i or 0) for i, _, _ in TEXTS)


@pytest.mark.parametrize("name", BY_ROW)
def test_empty_table(docs, name):
    assert BY_ROW[name](docs.where("false")).count() == 0


@pytest.mark.parametrize("name", BY_ROW)
def test_runs_agree(docs, name):
    a, b = (sorted(map(str, BY_ROW[name](d).collect())) for d in (docs, docs.repartition(5)))
    assert a == b


def test_packing(docs):
    rows = packing.pack(docs, V).collect()
    assert sum(r["length"] for r in rows) == sum(n for n in {(r["doc_id"], r["doc_tokens"], k): r["doc_tokens"] for k, r in enumerate(rows) if r["start"] == 0}.values())
    assert sum(r["start"] == 0 for r in rows) == len(TEXTS)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= packing.SIZE
    assert packing.pack(docs.where("false"), V).count() == 0


def test_toxicity(docs, labels):
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.toxicity(docs, labels.where("false")).agg(F.max("score")).first()[0] == 0
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns


def test_filters_keep_columns(docs):
    for f in (lines.deduplicated, simhash.deduplicated, mixing.mixed):
        out = f(docs)
        assert out.select(*docs.columns).columns == docs.columns and out.count() > 0
    assert simhash.deduplicated(docs).where("doc_id = 1 AND source = 's1'").count() == 1
    assert [f.dataType for f in mixing.mixed(docs).schema] == [f.dataType for f in docs.schema]


def test_pages(spark):
    rows = [(1, "u", None), (None, None, ""), (2, "u", "<p>Just one line of text that is long enough to be the text of the page, and it is.</p>"), (2, "u", "<!-- open"), (3, "u", "<script>var a = '<p>x</p>'"), (4, "u", "<div" * 2000), (5, "u", "a < b & c &amp; d &#233; &nope; <"), (6, "u", "<p title='a > b'>" + "word the of and " * 30)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(3))
    out = html.extract(d).collect()
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    assert html.extract(d.where("false")).count() == 0
    assert [r["text"] for r in out if r["page_id"] == 6][0].startswith("word the of")


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, [1.0, 0.0], 0), (4, [1.0, 0.0], None), (5, None, 0), (6, [0.0, 0.0], 0), (7, [nan, 1.0], 0), (8, [None, 1.0], 0), (9, [inf, 1.0], 0), (10, [1.0], 0), (11, [2.0, 0.0], 1), (12, [-1.0, 0.0], 0), (None, [0.0, 1.0], 0), (13, [], 0), (3, [1.0, 0.0], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("uid", F.lit(1)).withColumn("tile", F.lit("x"))
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(d).collect()]
    assert len(got) == len(rows)
    by = {g[0]: g for g in got}
    assert by[1] == (1, 3, 1, True) and by[2] == (2, 3, 1, False) and [g for g in got if g[0] == 3] == [(3, 3, 1, False)] * 2
    assert all(by[i] == (i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13))
    assert embeddings.near_duplicates(d.where("false")).count() == 0


def test_ledger_scans_only_unseen_blobs(spark, docs):
    _, ledger = secrets.update(docs)
    seen = {r["blob"] for r in ledger.collect()}
    assert len(seen) == ledger.count() == len({hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in TEXTS})
    more = spark.createDataFrame([(1, "password = hunter2secret"), (2, "word")], "doc_id long, text string")
    marked = ledger.withColumn("findings", F.expr("array(named_struct('kind', 'hex', 'start', 1, 'end', 2))"))
    out = {r["doc_id"]: r["spans"] for r in secrets.secrets(more, marked).collect()}
    assert out == {1: "assign:0:24", 2: "hex:1:2"}  # what the ledger holds is not scanned again


def test_pipeline_on_edges(spark, docs, labels, tmp_path):
    folder = tmp_path / "edge"
    labels.write.parquet(str(folder / "labels.parquet"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(folder / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(folder)).collect()
    assert out and {"doc_id", "sequence_id", "offset"} <= set(out[0].asDict())
