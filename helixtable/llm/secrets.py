"""Secret scans: an incremental blob ledger, with DataFrame functions only.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger holds, for each blob and rule
version, the findings; only pairs that it lacks are scanned, each blob once however many paths hold it, and findings
are joined back to all paths.

Defined cases: a null text is an empty blob; null paths stay; repeated rows each get the blob's findings; an empty
table gives an empty result; columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixtable.llm.common import text_of, written

# The rules of version 1, in the order of kinds: pattern, group whose length counts, least length.
# assign: Java's (?i: ) folds ASCII letters only. The runs of access and hex can't hold a shorter match that passes.
RULES = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
VERSION = "1"
FINDINGS = "array<struct<kind:string,start:int,end:int>>"


def found(text: str, kind: str) -> Column:
    """Spans of one rule, by start. The text between matches and the matches themselves, laid end to end, give the places."""
    pattern, group, least = RULES[kind]
    matches = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches(0)))
    none = F.array().cast(FINDINGS)

    def step(done: Column, x: Column) -> Column:
        start = done.at + F.length(x.gap)
        end = start + F.length(x.match)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(x.counts) >= least, F.concat(done.out, F.array(span))).otherwise(done.out).alias("out"))

    parts = F.arrays_zip(gaps.alias("gap"), matches(0).alias("match"), matches(group).alias("counts"))
    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda done: done.out)
    return F.when(F.col(text).rlike(pattern), spans).otherwise(none)


def scan(blobs: DataFrame) -> DataFrame:
    """blob, rule_version, findings (by start, then kind in the rules' order) of blobs (blob, text)."""
    kinds = F.array(*[F.lit(k) for k in RULES])
    all_of = F.concat(*[found("text", kind) for kind in RULES])
    keyed = F.array_sort(F.transform(all_of, lambda x: F.struct(x.start.alias("start"), F.array_position(kinds, x.kind).alias("n"), x.kind.alias("kind"), x.end.alias("end"))))
    return blobs.select("blob", F.lit(VERSION).alias("rule_version"), F.transform(keyed, lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end"))).alias("findings"))


def update(versions: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """versions (path, text, any others) with blob, and the ledger that covers them, as a written table."""
    named = versions.withColumn("blob", F.sha2(text_of(), 256))
    blobs = named.select("blob", text_of().alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == VERSION).select("blob"), "blob", "left_anti")
    fresh = scan(blobs.groupBy("blob").agg(F.first("text").alias("text")))
    return named, written(fresh if ledger is None else ledger.unionByName(fresh), "ledger")


def secrets(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, findings."""
    named, ledger = update(docs.select("doc_id", "text"), ledger)
    hits = ledger.where((F.col("rule_version") == VERSION) & (F.size("findings") > 0)).select("blob", "findings")
    rows = named.select("doc_id", "blob").join(hits, "blob", "left").withColumn("findings", F.coalesce("findings", F.expr(f"cast(array() as {FINDINGS})")))
    spans = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("findings", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, RULES), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"), "findings")


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for n, (kind, (pattern, group, least)) in enumerate(RULES.items()):
        parts.append(f"""SELECT doc_id, {n} AS n, '{kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, g, m, v, {least} AS least FROM (
            SELECT doc_id, string_split_regex(t, {quote(pattern)}) AS g, regexp_extract_all(t, {quote(pattern)}) AS m, regexp_extract_all(t, {quote(pattern)}, {group}) AS v FROM d)""")
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    x AS ({' UNION ALL '.join(parts)}),
    s AS (SELECT doc_id, n, kind, len(v[i]) >= least AS ok, coalesce(list_sum(list_transform(g[1:i], lambda z: len(z))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda z: len(z))), 0) AS a, len(m[i]) AS l FROM x),
    r AS (SELECT doc_id, count(*) FILTER (n = 0) AS n_assign, count(*) FILTER (n = 1) AS n_access, count(*) FILTER (n = 2) AS n_hex, string_agg(kind || ':' || a::BIGINT || ':' || (a + l)::BIGINT, ',' ORDER BY a, n) AS spans FROM s WHERE ok GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r USING (doc_id)
    """


ORACLE_SQL = _oracle()
