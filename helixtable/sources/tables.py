"""Targets and profiles as DataFrames, and the public text formats: FASTA, profile text files, reports and manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixtable.functions.alphabet import CANONICAL, SYMBOLS
from helixtable.functions.scores import LONGEST

#: Words whose residues a task keeps.
KNOWN = 1 << 20


class _Residues(dict):
    """Residues by word, each found when it is first asked for."""

    def __missing__(self, word: bytes) -> str:
        residue = self[word] = SYMBOLS[int.from_bytes(md5(word, usedforsecurity=False).digest()[:4], "big") % CANONICAL]
        return residue


def residues_of(text: Column) -> Column:
    """The letters of a text in upper case: every Latin letter is a symbol of the amino alphabet."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", ""))


def words_as_residues(text: Column) -> Column:
    """A residue for each word of a text, by the first 32 bits of its MD5: passages of words become sequences whose chance matches are rare.

    Each distinct word is hashed once by a task (KNOWN of them are kept). Not marked deterministic: what reads it several times, as filters on the length do, must not encode a text again.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Residues()
        for texts in batches:
            out = []
            for t in texts:
                if len(known) > KNOWN:
                    known.clear()
                out.append("".join(map(known.__getitem__, t.encode().split())))  # bytes: the six ASCII white-space characters only
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER).asNondeterministic()(F.lower(F.coalesce(text, F.lit(""))))


def targets(docs: DataFrame, encode: Callable[[Column], Column] = words_as_residues) -> DataFrame:
    """seq_ordinal, name, source, length, residues of documents; status TOO_LONG marks what the engine does not take."""
    t = docs.select(F.col("doc_id").alias("seq_ordinal"), F.concat(F.lit("doc"), F.col("doc_id")).alias("name"), "source", encode(F.col("text")).alias("residues"))
    return t.withColumn("length", F.length("residues")).withColumn("status", F.when(F.col("length") > LONGEST, "TOO_LONG").when(F.col("length") == 0, "EMPTY").otherwise("OK"))


def profile_table(passages: DataFrame, encode: Callable[[Column], Column] = words_as_residues) -> DataFrame:
    """profile_ordinal, name, consensus, model_length of passages: a profile for each whole passage."""
    p = passages.select(F.col("item_id").cast("int").alias("profile_ordinal"), F.concat(F.lit("passage"), F.col("item_id")).alias("name"), encode(F.col("text")).alias("consensus"))
    return p.withColumn("model_length", F.length("consensus")).where("model_length > 0")


def records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """value, file, ordinal (from 0 within a file) of text records. Files are split among tasks; a record's ordinal is its
    place in its split plus the records of the file's earlier splits, of which there is one row for each split."""
    raw = spark.read.option("lineSep", separator).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.spark_partition_id().alias("split"), F.monotonically_increasing_id().alias("at"))
    splits = raw.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return raw.join(F.broadcast(splits), ["file", "split"]).select("value", "file", (F.col("before") + F.col("at") - F.col("first")).alias("ordinal"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, identifier, header, length, residues, header_sha256 of a FASTA file.

    Records are split at line starts with '>', so no record is read by two tasks; data before the first header is an error.
    """
    raw = records(spark, path, "\n>")
    bad = (F.col("ordinal") == 0) & ~F.col("value").startswith(">")
    record = F.when(F.col("ordinal") == 0, F.expr("substring(value, 2)")).otherwise(F.col("value"))
    raw = raw.withColumn("record", F.when(bad, F.raise_error(F.lit("data before the first header"))).otherwise(record))
    header = F.regexp_extract("record", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("record", r"^[^\r\n]*", ""), r"\s", "")
    return raw.select("file", "ordinal", F.regexp_extract(header, r"^(\S*)", 1).alias("identifier"), header.alias("header"), F.length(body).alias("length"), body.alias("residues"), F.sha2(F.concat(F.lit(">"), header), 256).alias("header_sha256"))


def fasta_text(records: DataFrame, width: int = 60) -> DataFrame:
    """One column, value: FASTA records of (identifier, residues), lines of `width` residues."""
    lines = F.array_join(F.regexp_extract_all("residues", F.lit(f".{{1,{width}}}"), F.lit(0)), "\n")
    return records.select(F.concat(F.lit(">"), "identifier", F.lit("\n"), lines).alias("value"))


def read_profile_text(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, format, name, accession, model_length, ga, tc, nc (pairs of cutoffs) of profile text records, which end in //."""
    raw = records(spark, path, "\n//").where(F.col("value").rlike(r"\S"))
    # the body after the HMM line may not look like a header
    head = F.regexp_replace("value", r"(?s)\nHMM\s.*", "")
    field = lambda name: F.regexp_extract(head, rf"(?m)^{name}\s+([^\r\n]*?)\s*$", 1)
    pair = lambda name: F.when(field(name) != "", F.transform(F.split(F.trim(F.regexp_replace(field(name), ";", "")), r"\s+"), lambda x: x.cast("double")))
    named = F.when(field("NAME") == "", F.raise_error(F.lit("a record without NAME"))).otherwise(field("NAME"))
    return raw.select("file", "ordinal", F.regexp_extract(head, r"(HMMER\S*)", 1).alias("format"), named.alias("name"), F.nullif(field("ACC"), F.lit("")).alias("accession"), field("LENG").cast("int").alias("model_length"), pair("GA").alias("ga"), pair("TC").alias("tc"), pair("NC").alias("nc"))


def parse_search_report(spark: SparkSession, path: str) -> DataFrame:
    """block, measure, value of the text summaries of searches; a file may hold several blocks, each ended by //."""
    raw = records(spark, path, "\n//").where(F.col("value").rlike(r"\S")).withColumn("block", F.col("ordinal"))
    number = lambda pattern: F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")).cast("double")
    measures = {
        "queries": r"Query model\(s\):\s+(\d+)", "targets": r"Target sequences:\s+(\d+)", "residues": r"Target sequences:\s+\d+\s+\((\d+) residues",
        "passed_msv": r"Passed MSV filter:\s+(\d+)", "passed_bias": r"Passed bias filter:\s+(\d+)", "passed_viterbi": r"Passed Vit filter:\s+(\d+)", "passed_forward": r"Passed Fwd filter:\s+(\d+)",
        "z": r"Initial search space \(Z\):\s+([\d.]+)", "dom_z": r"Domain search space\s+\(domZ\):\s+([\d.]+)", "elapsed": r"Elapsed:\s+\d+:\d+:([\d.]+)", "mc_per_sec": r"Mc/sec:\s+([\d.]+)",
    }
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), number(p).alias("value")) for k, p in measures.items()]))
    return raw.select("block", parts.alias("x")).select("block", "x.measure", "x.value").where("value IS NOT NULL")


ORACLE_RECORD = "record string, model_name string, m int, l int, sequence_index long, profile_u8 int, agreement boolean, pass_f1 boolean, comparisons long, mismatches long"


def read_oracle_records(spark: SparkSession, path: str) -> DataFrame:
    """Comparison records as JSON lines, with their place; fields that the schema lacks are an error."""
    return spark.read.schema(ORACLE_RECORD).option("mode", "FAILFAST").json(path).withColumn("ordinal", F.monotonically_increasing_id())


TIMING = "schema_version int, clock string, query_index int, query string, metric string, count long, elapsed_ns long"


def read_stage_timings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TIMING).option("sep", "\t").option("header", True).option("mode", "FAILFAST").csv(path)


def timing_matrix(timings: DataFrame, metrics: list[str]) -> DataFrame:
    """A row for each query, a column of counts and one of nanoseconds for each metric; a metric that is missing or double is an error."""
    per = timings.groupBy("query_index", "query", "metric").agg(F.count("*").alias("n"), F.sum("count").alias("count"), F.sum("elapsed_ns").alias("ns"))
    per = per.withColumn("count", F.when(F.col("n") > 1, F.raise_error(F.lit("a metric stands twice"))).otherwise(F.col("count")))
    wide = per.groupBy("query_index", "query").pivot("metric", metrics).agg(F.first("count").alias("count"), F.first("ns").alias("ns"))
    missing = F.array_compact(F.array(*[F.when(F.col(f"{m}_count").isNull(), F.lit(m)) for m in metrics]))
    return wide.withColumn("missing", missing)


MANIFEST = "array<struct<id:string,path:string,size_bytes:long,sha256:string,sequences:long,residues:long>>"


def read_manifest(spark: SparkSession, path: str, key: str = "protein_fastas") -> DataFrame:
    """The entries of a dataset manifest, by a fixed schema."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json(F.get_json_object("value", f"$.{key}"), MANIFEST, {"mode": "FAILFAST"})).alias("x")).select("x.*")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, size_bytes, modified, sha256 of files, as validation compares them."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def manifest_drift(expected: DataFrame, found: DataFrame) -> DataFrame:
    """path and reason of every file that is missing, new, or of another size or content."""
    e, f = expected.alias("e"), found.alias("f")
    reason = (
        F.when(F.col("f.path").isNull(), "MISSING").when(F.col("e.path").isNull(), "UNEXPECTED").when(F.col("e.size_bytes") != F.col("f.size_bytes"), "SIZE").when(F.col("e.sha256") != F.col("f.sha256"), "CONTENT")
    )
    return e.join(f, F.col("e.path") == F.col("f.path"), "full").select(F.coalesce("e.path", "f.path").alias("path"), reason.alias("reason")).where("reason IS NOT NULL")


def lockstep(a: DataFrame, b: DataFrame, key: str, same: list[str]) -> DataFrame:
    """a and b side by side on their ordinal; a row that one side lacks, or that differs in a column of `same`, is an error."""
    b = b.select(key, *[F.col(c).alias(f"{c}_b") for c in b.columns if c != key])
    both = a.join(b.withColumn("there_b", F.lit(True)), key, "full")
    problem = F.when(F.col("there_b").isNull() | F.col(same[0]).isNull(), F.lit("streams of different length"))
    for c in same:
        problem = problem.when(~F.col(c).eqNullSafe(F.col(f"{c}_b")), F.lit(f"{c} differs"))
    return both.withColumn("mismatch", problem).drop("there_b")
