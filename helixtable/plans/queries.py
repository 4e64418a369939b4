"""Registered queries over the driver's tables, and DuckDB SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixtable.functions import scores as S
from helixtable.functions.alphabet import alphabet
from helixtable.operators import kernels as K
from helixtable.operators import planning as N
from helixtable.operators import provenance as V
from helixtable.operators import regions as G
from helixtable.operators import relational as R
from helixtable.plans import search as P
from helixtable.sources import sinks
from helixtable.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.targets(read(spark, sf_dir, "documents"), T.residues_of)


#: SQL of the letters of the documents as sequences.
LETTERS = "WITH s AS (SELECT doc_id AS seq_ordinal, source, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') AS r, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS residues, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))::INT AS length FROM documents)"
PROFILES = "p AS (SELECT item_id::INT AS profile_ordinal, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS consensus, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))::INT AS model_length FROM benchmark)"


# -- inventories ---------------------------------------------------------------


@query(f"""{LETTERS} SELECT source, count(*) AS records, sum(length)::BIGINT AS residues, min(length) AS shortest, max(length) AS longest, grouping(source)::INT AS is_total, round(sum(length) / count(*), 6) AS mean
FROM s GROUP BY GROUPING SETS ((source), ())""")
def fasta_inventory(spark, sf_dir):
    return R.length_inventory(letters(spark, sf_dir), "source", "length")


@query(f"{LETTERS} SELECT length, count(*) AS records, length * count(*) AS residues FROM s GROUP BY length")
def length_histogram(spark, sf_dir):
    return R.length_histogram(letters(spark, sf_dir), "length")


_RANKS = " UNION ALL ".join(f"SELECT '{S.quantile_name(q)}' AS quantile, {q}::DOUBLE AS q" for q in R.QUANTILES)


@query(f"""{LETTERS}, o AS (SELECT source, seq_ordinal, length, row_number() OVER (PARTITION BY source ORDER BY length, seq_ordinal) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM s),
q AS ({_RANKS})
SELECT source, quantile, k AS rank, seq_ordinal, length FROM o, q WHERE k = round_even(q * (n - 1), 0)::BIGINT""")
def length_quantile_records(spark, sf_dir):
    return R.quantile_records(letters(spark, sf_dir), "source", "length", "seq_ordinal")


@query(f"WITH {PROFILES} SELECT count(*) AS profiles, sum(model_length)::BIGINT AS positions, min(model_length) AS shortest, max(model_length) AS longest, round(avg(model_length), 6) AS mean, median(model_length)::DOUBLE AS median FROM p WHERE model_length > 0")
def profile_inventory(spark, sf_dir):
    p = T.profile_table(read(spark, sf_dir, "benchmark"), T.residues_of)
    n = F.col("model_length")
    return p.agg(F.count("*").alias("profiles"), F.sum(n).alias("positions"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"), F.median(n).alias("median"))


@query(f"""{LETTERS} SELECT length, count(*) AS records,
 round(length * ln(length::DOUBLE / (length + 1)) + ln(1 - length::DOUBLE / (length + 1)), 6) AS null1,
 least(255, (-round({K.SCALE_BYTE!r} * ln(3.0::DOUBLE / (length + 3))))::INT) AS tjb,
 greatest(-32768, least(32767, round({K.SCALE_WORD!r} * ln(3.0::DOUBLE / (length + 3.0)))))::INT AS move_word,
 round(3.0::DOUBLE / (length + 3.0), 9) AS move, round(1 - 3.0::DOUBLE / (length + 3.0), 9) AS loop, round(2.0::DOUBLE / (length + 2.0), 9) AS unihit_move,
 round(length * ln(length::DOUBLE / (length + 1)), 6) AS bias_logp, round(ln(1 - length::DOUBLE / (length + 1)), 6) AS bias_log1mp
FROM s WHERE length > 0 GROUP BY length""")
def length_classes(spark, sf_dir):
    return R.length_classes(letters(spark, sf_dir), "length", float(K.SCALE_BYTE), float(K.SCALE_WORD))


@query(f"{LETTERS}, c AS (SELECT unnest(string_split(residues, '')) AS residue FROM s), n AS (SELECT residue, count(*) AS n FROM c WHERE residue <> '' GROUP BY residue) SELECT residue, n, round(n / (SELECT sum(n) FROM n), 9) AS share FROM n")
def residue_composition(spark, sf_dir):
    return R.composition(letters(spark, sf_dir), "residues")


@query(f"""WITH {PROFILES}, c AS (SELECT unnest(string_split(consensus, '')) AS residue FROM p), n AS (SELECT residue, count(*) AS n FROM c WHERE residue <> '' GROUP BY residue),
h AS (SELECT residue, round(n / (SELECT sum(n) FROM n), 9) AS share FROM n),
a(code, symbol, members) AS (VALUES {', '.join(f"({i}, '{c}', '{c if i < 20 else {'B': 'DN', 'J': 'IL', 'Z': 'EQ', 'O': 'K', 'U': 'C', 'X': 'ACDEFGHIKLMNPQRSTVWY'}.get(c, '')}')" for i, c in enumerate('ACDEFGHIKLMNPQRSTVWY-BJZOUX*~'))}),
m AS (SELECT code, symbol, unnest(string_split(members, '')) AS residue FROM a WHERE members <> '')
SELECT code, symbol, round(sum(coalesce(share, 0)) / (count(*) * 0.05::DOUBLE), 6) AS odds FROM m LEFT JOIN h USING (residue) GROUP BY code, symbol""")
def degenerate_odds(spark, sf_dir):
    shares = R.composition(T.profile_table(read(spark, sf_dir, "benchmark"), T.residues_of), "consensus")
    return R.degenerate_odds(shares, alphabet(spark))


# -- selection -------------------------------------------------------------------


@query("""WITH r AS (SELECT source, doc_id, length(coalesce(text, ''))::INT AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ordinal FROM documents),
w AS (SELECT l.doc_id AS place, r.source, r.ordinal, r.n AS want FROM labels l JOIN r USING (doc_id))
SELECT w.place, w.source, w.ordinal, r.doc_id, r.n, CASE WHEN r.doc_id IS NULL THEN 'MISSING' WHEN r.n <> w.want THEN 'MISMATCH' END AS problem FROM w LEFT JOIN r ON r.source = w.source AND r.ordinal = w.ordinal""")
def select_by_ordinal(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("source", "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    records = N.ranked_within(docs, "source", [F.col("doc_id")], "ordinal")
    wanted = read(spark, sf_dir, "labels").select("doc_id").join(records, "doc_id").select(F.col("doc_id").alias("place"), "source", "ordinal", "n")
    return R.select_records(records, wanted, ["source", "ordinal"], ["n"]).select("place", "source", "ordinal", "doc_id", "n", "problem")


@query("SELECT conv_id, role, count(*) AS copies, count(DISTINCT text) AS \"values\", count(DISTINCT text) > 1 AS conflict FROM conversations GROUP BY conv_id, role")
def dedupe_conflicts(spark, sf_dir):
    return R.unique_or_conflict(read(spark, sf_dir, "conversations"), ["conv_id", "role"], ["text"])


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL OR l.doc_id IS NULL THEN 'streams of different length' WHEN d.doc_id % 2 <> (l.doc_id + l.toxic) % 2 THEN 'parity differs' END AS mismatch
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def lockstep_join(spark, sf_dir):
    """Documents and labels side by side, with what does not match: a row that one side lacks, or a parity that toxic labels turn."""
    d = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 2).alias("parity"))
    labels = read(spark, sf_dir, "labels").select("doc_id", ((F.col("doc_id") + F.col("toxic")) % 2).alias("parity"))
    return T.lockstep(d, labels, "doc_id", ["parity"]).select("doc_id", "mismatch")


# -- seeds -------------------------------------------------------------------------

SEED = 24


@query(f"""{LETTERS}, {PROFILES},
a AS (SELECT DISTINCT profile_ordinal, substr(consensus, i, {SEED}) AS word FROM (SELECT profile_ordinal, consensus, unnest(range(1, model_length - {SEED} + 2)) AS i FROM p)),
b AS (SELECT DISTINCT seq_ordinal, substr(residues, i, {SEED}) AS word FROM (SELECT seq_ordinal, residues, unnest(range(1, length - {SEED} + 2)) AS i FROM s))
SELECT profile_ordinal, seq_ordinal, count(*) AS shared FROM a JOIN b USING (word) GROUP BY profile_ordinal, seq_ordinal""")
def seed_pairs(spark, sf_dir):
    profiles = R.words_of(T.profile_table(read(spark, sf_dir, "benchmark"), T.residues_of), "profile_ordinal", "consensus", SEED)
    return R.seed_pairs(profiles, R.words_of(letters(spark, sf_dir), "seq_ordinal", "residues", SEED))


# -- the search ----------------------------------------------------------------------


def _searched(spark, sf_dir, until="domains", **options):
    o = P.SearchOptions(**options)
    r = P.search(T.profile_table(read(spark, sf_dir, "benchmark")), T.targets(read(spark, sf_dir, "documents")), o, until)
    return r, o, r.targets


def _first_filter(spark, sf_dir):
    profiles, targets = T.profile_table(read(spark, sf_dir, "benchmark")), T.targets(read(spark, sf_dir, "documents"))
    chunks = P.loaded(profiles)
    return P.first_filter(P.segment_scores(chunks, targets), P.profile_constants(profiles, chunks), P.SearchOptions())


_HIT, _MISS = (int(x) for x in K.Profile(0, "", "A").gains[0, :2])  # of any canonical position: its own residue, any other
_TBM = f"least(255, round(-{K.SCALE_BYTE!r} * ln(2.0 / (m * (m + 1))), 0))::INT"


def _coded(table: str, key: str, name: str) -> str:
    """SQL of the words of a table's texts as residue codes: (key, place, code)."""
    words = rf"list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    lists = f"SELECT {key} AS {name}, {words} AS w FROM {table}"
    return f"SELECT {name}, len(w)::INT AS n, unnest(range(1, len(w) + 1)) AS place, ('0x' || substr(md5(unnest(w)), 1, 8))::BIGINT % 20 AS code FROM ({lists}) WHERE len(w) > 0"


def _gains(name: str, code: str) -> str:
    """SQL of the best ungapped diagonal gain of each pair (profile_ordinal, seq_ordinal, gain), where codes are compared as `code`.

    Only equal residues raise a sum, so a best segment runs from one to another: between two of them, each place that differs
    costs the same, which makes the sum a difference of one running value, and the best one that value less its running minimum.
    """
    value = f"({_HIT - _MISS} * row_number() OVER o + {_MISS} * t.place)"
    return f"""{name}_r AS (SELECT profile_ordinal, seq_ordinal, t.place - p.place AS d, t.place AS spot, {value} AS v FROM t JOIN p ON {code.format('t.code')} = {code.format('p.code')} WINDOW o AS (PARTITION BY profile_ordinal, seq_ordinal, t.place - p.place ORDER BY t.place)),
{name} AS (SELECT profile_ordinal, seq_ordinal, max(x) AS gain FROM (SELECT profile_ordinal, seq_ordinal, v - min(v) OVER (PARTITION BY profile_ordinal, seq_ordinal, d ORDER BY spot) + {_HIT} AS x FROM {name}_r) GROUP BY profile_ordinal, seq_ordinal)"""


def _decided(name: str, gains: str) -> str:
    """SQL of the first filter over gains: every pair with its status, bits, P-value and action."""
    return f"""{name}_1 AS (SELECT q.profile_ordinal, l.seq_ordinal, l.n AS length, coalesce(g.gain, 0)::INT AS gain, least(255, (-round({K.SCALE_BYTE!r} * ln(3.0 / (l.n + 3)), 0))::INT) AS tjb, {_TBM} AS tbm FROM (SELECT DISTINCT profile_ordinal, n AS m FROM p) q CROSS JOIN (SELECT DISTINCT seq_ordinal, n FROM t) l LEFT JOIN {gains} g ON g.profile_ordinal = q.profile_ordinal AND g.seq_ordinal = l.seq_ordinal),
{name}_2 AS (SELECT *, 128 + least(gain, 127) AS raw, least(gain, 127) + {K.BASE} - tjb - tbm AS adjusted FROM {name}_1),
{name}_3 AS (SELECT *, CASE WHEN tjb + tbm + {K.TEC} + {-_MISS} >= 127 THEN 'NO_RESULT' WHEN raw >= {255 + _MISS} THEN CASE WHEN {K.BASE} - tjb - tbm < 128 THEN 'NO_RESULT' ELSE 'OVERFLOW' END WHEN adjusted >= {255 + _MISS} THEN 'OVERFLOW' WHEN adjusted - {K.TEC} > {K.BASE} THEN 'NO_RESULT' ELSE 'OK' END AS status FROM {name}_2),
{name}_4 AS (SELECT *, CASE WHEN status = 'OK' THEN adjusted - {K.TEC} - tjb - {K.BASE} END AS numerator, length * ln(length::DOUBLE / (length + 1)) + ln(1 - length::DOUBLE / (length + 1)) AS null1 FROM {name}_3),
{name}_5 AS (SELECT *, (numerator / {K.SCALE_BYTE!r} - 3.0 - null1) / {S.LN2!r} AS bits FROM {name}_4),
{name}_6 AS (SELECT *, exp(-{S.LN2!r} * (bits + 7.5)) AS ey FROM {name}_5),
{name} AS (SELECT *, CASE WHEN ey < {S.SMALL!r} THEN ey ELSE 1 - exp(-ey) END AS p, CASE WHEN status = 'OK' AND (CASE WHEN ey < {S.SMALL!r} THEN ey ELSE 1 - exp(-ey) END) > 0.02 THEN 'DEFINITE_REJECT' ELSE 'KEEP' END AS action FROM {name}_6)"""


_WORDS = f"WITH t AS ({_coded('documents', 'doc_id', 'seq_ordinal')}), p AS ({_coded('benchmark', 'item_id::INT', 'profile_ordinal')})"
_PAIRS = f"{_WORDS}, {_gains('g', '{}')}, {_decided('f', 'g')}"


@query(f"{_PAIRS} SELECT profile_ordinal, seq_ordinal, length, gain, tjb, status, numerator, round(bits, 6) AS bits, round(p, 9) AS p, action FROM f")
def ssv_scores(spark, sf_dir):
    """All pairs: gain, status, numerator, bits, P-value and the first filter's decision."""
    return _first_filter(spark, sf_dir).select("profile_ordinal", "seq_ordinal", "length", "gain", "tjb", "status", "numerator", F.round("bits", 6).alias("bits"), F.round("p", 9).alias("p"), "action")


@query(f"""{_PAIRS}, c AS (SELECT profile_ordinal, count(*) AS n, string_agg(seq_ordinal::VARCHAR, ',' ORDER BY seq_ordinal) AS targets FROM f WHERE action = 'KEEP' GROUP BY profile_ordinal)
SELECT profile_ordinal, coalesce(sum(n) OVER (ORDER BY profile_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, n, targets FROM c""")
def f1_candidates(spark, sf_dir):
    profiles, targets = T.profile_table(read(spark, sf_dir, "benchmark")), T.targets(read(spark, sf_dir, "documents"))
    return R.candidate_lists(P.candidates(profiles, targets, P.loaded(profiles), P.SearchOptions())).select("profile_ordinal", "start", "n", F.array_join("targets", ",").alias("targets"))


@query(f"{_PAIRS} SELECT count(*) AS compared, count(*) AS agreed, 0::BIGINT AS only_first, 0::BIGINT AS only_second, 0::BIGINT AS skipped, 'SCORE' AS mode FROM f")
def cutoff_agreement(spark, sf_dir):
    """The first filter by its compiled score cutoff against the one by P-value: both must decide alike."""
    o = P.SearchOptions()
    mode, cutoff = S.compiled_cutoff(lambda x: S.gumbel(x, o.m_mu, o.rate), o.f1)
    by_score = (F.col("status") != "OK") | (F.col("bits").cast("float") >= F.lit(cutoff).cast("float"))
    return R.agreement(_first_filter(spark, sf_dir), by_score, F.col("action") == "KEEP").withColumn("mode", F.lit(mode))


@query(f"""{_WORDS}, {_gains('g', '{}')}, {_decided('f', 'g')}, {_gains('h', '({} // 2)')}, {_decided('b', 'h')}
SELECT f.profile_ordinal, count(*) AS pairs, count(*) FILTER (b.action = 'DEFINITE_REJECT') AS certain, count(*) FILTER (b.action = 'DEFINITE_REJECT' AND f.action = 'KEEP') AS false_rejects, count(*) FILTER (b.gain < f.gain) AS below
FROM f JOIN b ON b.profile_ordinal = f.profile_ordinal AND b.seq_ordinal = f.seq_ordinal GROUP BY f.profile_ordinal""")
def coarse_filter(spark, sf_dir):
    """The reduced-alphabet bound: pairs that it certainly rejects, and how many of those the exact filter would keep (none)."""
    o = P.SearchOptions()
    profiles, targets = T.profile_table(read(spark, sf_dir, "benchmark")), T.targets(read(spark, sf_dir, "documents"))
    classes = np.concatenate([np.arange(20) // 2, np.arange(10, 19)])
    exact = P.loaded(profiles)
    coarse = [[K.coarse_gains(p, classes) for p in c] for c in exact]
    constants = P.profile_constants(profiles, exact)
    both = P.segment_scores(exact, targets, bounds=coarse)  # one pass: pairs need not be met again
    fine = P.first_filter(both, constants, o).select("profile_ordinal", "seq_ordinal", "length", F.col("action").alias("exact"), F.col("gain").alias("exact_gain"), F.col("bound").alias("gain"))
    d = P.first_filter(fine, constants, o).select("profile_ordinal", "exact", F.col("exact_gain").alias("gain"), F.col("action").alias("coarse"), F.col("gain").alias("bound"))
    return d.groupBy("profile_ordinal").agg(F.count("*").alias("pairs"), F.count_if(F.col("coarse") == "DEFINITE_REJECT").alias("certain"), F.count_if((F.col("coarse") == "DEFINITE_REJECT") & (F.col("exact") == "KEEP")).alias("false_rejects"), F.count_if(F.col("bound") < F.col("gain")).alias("below"))


@query()
def filter_scores(spark, sf_dir):
    """Candidates: multi-segment, bias and Viterbi scores, and the last filter passed."""
    r, _, _ = _searched(spark, sf_dir, "filters")
    return r.filtered.select("profile_ordinal", "seq_ordinal", "length", "msv_status", F.round("msv_bits", 6).alias("msv_bits"), F.round("bias_nats", 6).alias("bias_nats"), F.round("viterbi_bits", 6).alias("viterbi_bits"), "past")


@query()
def forward_regions(spark, sf_dir):
    """What passed Viterbi: Forward score, route and regions."""
    r, _, _ = _searched(spark, sf_dir, "regions")
    return r.continued.select("profile_ordinal", "seq_ordinal", F.round("forward_nats", 6).alias("forward_nats"), F.round("nexpected", 6).alias("nexpected"), "route", "regions")


@query()
def search_domains(spark, sf_dir):
    r, o, targets = _searched(spark, sf_dir)
    d = P.domain_report(r.domains, r.hits, targets.count(), o)
    return d.select("profile_ordinal", "seq_ordinal", "domain_ordinal", "env_from", "env_to", "ali_from", "ali_to", "hmm_from", "hmm_to", F.round("domain_score", 6).alias("score"), F.round("domain_bias", 6).alias("bias"), "i_evalue", "c_evalue", "dom_reported", "dom_included")


@query()
def search_hits(spark, sf_dir):
    """The flagship: which documents hold (near-)copies of which benchmark passages, ranked by passage."""
    r, _, _ = _searched(spark, sf_dir)
    return r.hits.where("reported").select("profile_ordinal", "seq_ordinal", "rank", F.round("score", 6).alias("score"), F.round("bias", 6).alias("bias"), "evalue", "included")


@query()
def search_rows(spark, sf_dir):
    """Result lines of included hits and reported domains."""
    r, o, targets = _searched(spark, sf_dir)
    d = P.domain_report(r.domains, r.hits, targets.count(), o).where("dom_reported").join(r.hits.where("included").select("profile_ordinal", "seq_ordinal", "score", "evalue"), ["profile_ordinal", "seq_ordinal"])
    fields = {c: F.col(c) for c in ("score", "evalue", "c_evalue", "i_evalue", "env_from", "env_to", "domain_score", "ali_from", "ali_to", "hmm_from", "hmm_to")}
    return d.select(sinks.result_row(fields | {"name": F.concat(F.lit("doc"), "seq_ordinal"), "query": F.concat(F.lit("passage"), "profile_ordinal")}).alias("line"))


@query()
def search_counters(spark, sf_dir):
    """Targets, residues and what passed each stage, by profile; rejected pairs count too."""
    r, _, targets = _searched(spark, sf_dir, "forward")
    size = targets.where("status = 'OK'").agg(F.count("*").alias("targets"), F.sum("length").alias("residues"))
    order = {"NONE": 0, "MSV": 1, "BIAS": 2, "VITERBI": 3}
    level = F.coalesce(*[F.when(F.col("past") == k, F.lit(v)) for k, v in order.items()])
    per = r.filtered.groupBy("profile_ordinal").agg(*[F.count_if(level >= v).alias(f"past_{k.lower()}") for k, v in order.items() if v])
    fwd = r.continued.groupBy("profile_ordinal").agg(F.count_if(F.col("route") != "F3_REJECT").alias("past_forward"))
    p = T.profile_table(read(spark, sf_dir, "benchmark")).select("profile_ordinal")
    return p.join(per, "profile_ordinal", "left").join(fwd, "profile_ordinal", "left").na.fill(0).crossJoin(F.broadcast(size))  # one row


@query()
def search_journal(spark, sf_dir):
    """Routes of the pairs that passed Viterbi partition them; one row a profile."""
    r, _, _ = _searched(spark, sf_dir, "regions")
    return R.route_partition(r.continued, "profile_ordinal", "route", ["F3_REJECT", "NO_REGIONS", "SIMPLE", "UNCERTAIN", "MULTIDOMAIN"])


@query()
def gathering_search(spark, sf_dir):
    """Certified pruning by gathering cutoffs: upper bounds never fall below the exact score."""
    r, o, _ = _searched(spark, sf_dir)
    cut = T.profile_table(read(spark, sf_dir, "benchmark")).select("profile_ordinal", F.lit(25.0).alias("ga_t"))
    pairs = r.continued.where("route <> 'F3_REJECT'").select("profile_ordinal", "seq_ordinal", "length", "forward_nats")
    d = P.gathering_prune(pairs, r.domains, cut)
    hits = r.hits.select("profile_ordinal", "seq_ordinal", "score")
    return d.join(hits, ["profile_ordinal", "seq_ordinal"], "left").select("profile_ordinal", "seq_ordinal", F.round("upper", 6).alias("upper"), "pruned", F.round("score", 6).alias("score"), (F.col("score") > F.col("upper")).alias("violated"))


# -- relational forms of the scoring tail, over line items as domains of orders -------------


@query(f"""WITH d AS (SELECT l_orderkey AS seq_ordinal, l_linenumber AS domain_ordinal, l_extendedprice / 1000 AS forward, l_discount * 40 AS correction, 100 * l_linenumber AS env_from, 100 * l_linenumber + l_quantity::INT AS env_to, 1000.0::DOUBLE AS n FROM lineitem),
e AS (SELECT *, env_to - env_from + 1 AS own, ln(0.00390625::DOUBLE) + correction AS y, n * ln(n / (n + 1)) + ln(1 - n / (n + 1)) AS null1 FROM d)
SELECT seq_ordinal, domain_ordinal, round(greatest(y, 0) + ln(1 + exp(-abs(y))), 6) AS bias, round((forward + (n - own) * ln(n / (n + 3)) - null1 - (greatest(y, 0) + ln(1 + exp(-abs(y))))) / {S.LN2!r}, 6) AS score FROM e""")
def domain_scores(spark, sf_dir):
    d = P.domain_scores(_domains(spark, sf_dir), 1 / 256)
    return d.select("seq_ordinal", "domain_ordinal", F.round("domain_bias", 6).alias("bias"), F.round("domain_score", 6).alias("score"))


def _domains(spark, sf_dir):
    n = F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 7).cast("int").alias("profile_ordinal"), F.col("l_orderkey").alias("seq_ordinal"), n.alias("domain_ordinal"), (F.col("l_extendedprice") / 1000).alias("forward"), (F.col("l_discount") * 40).alias("correction"),
        (100 * n).alias("env_from"), (100 * n + F.col("l_quantity").cast("int")).alias("env_to"), F.lit(1000).alias("length"), F.lit(60.0).alias("forward_nats"),
    )


_TARGETS = f"""WITH d AS (SELECT (l_orderkey % 7)::INT AS profile_ordinal, l_orderkey AS seq_ordinal, l_extendedprice / 1000 AS f, l_discount * 40 AS c, l_quantity::INT + 1 AS own, 1000.0::DOUBLE AS n FROM lineitem),
g AS (SELECT profile_ordinal, seq_ordinal, n, n * ln(n / (n + 1)) + ln(1 - n / (n + 1)) AS null1, ln(0.00390625::DOUBLE) + sum(c) AS y, coalesce(sum(f) FILTER (f - c > 0), 0) AS nats, ln(0.00390625::DOUBLE) + coalesce(sum(c) FILTER (f - c > 0), 0) AS z, coalesce(sum(own) FILTER (f - c > 0), 0) AS covered FROM d GROUP BY profile_ordinal, seq_ordinal, n),
t AS (SELECT profile_ordinal, seq_ordinal, (60.0 - null1 - (greatest(y, 0) + ln(1 + exp(-abs(y))))) / {S.LN2!r} AS full_score, CASE WHEN covered > 0 THEN (nats + (n - covered) * ln(n / (n + 3)) - null1 - (greatest(z, 0) + ln(1 + exp(-abs(z))))) / {S.LN2!r} END AS rebuilt FROM g),
h AS (SELECT profile_ordinal, seq_ordinal, full_score, rebuilt, greatest(full_score, rebuilt) AS score FROM t)"""


@query(f"{_TARGETS} SELECT profile_ordinal, seq_ordinal, round(full_score, 6) AS full_score, round(rebuilt, 6) AS rebuilt_score, round(score, 6) AS score FROM h")
def target_scores(spark, sf_dir):
    d = P.target_scores(_domains(spark, sf_dir), 1 / 256)
    return d.select("profile_ordinal", "seq_ordinal", *[F.round(c, 6).alias(c) for c in ("full_score", "rebuilt_score", "score")])


@query(f"""{_TARGETS}, r AS (SELECT profile_ordinal, seq_ordinal, round(score, 6) AS score FROM h),
e AS (SELECT *, CASE WHEN score < -3.5 THEN 1.0 ELSE exp(-{S.LN2!r} * (score + 3.5)) END * 1e12 AS evalue FROM r)
SELECT profile_ordinal, seq_ordinal, score, evalue <= 10.0 AS reported, evalue <= 0.01 AS included, row_number() OVER (PARTITION BY profile_ordinal ORDER BY score DESC, seq_ordinal) AS rank FROM e""")
def report_include(spark, sf_dir):
    scored = target_scores(spark, sf_dir).select("profile_ordinal", "seq_ordinal", "score")
    return P.ranked_hits(scored, 1e12, P.SearchOptions()).select("profile_ordinal", "seq_ordinal", "score", "reported", "included", "rank")


@query(f"""{_TARGETS}, r AS (SELECT profile_ordinal, seq_ordinal, round(score, 6) AS score FROM h)
SELECT profile_ordinal, seq_ordinal, score, score >= 90 AS reported, score >= 140 AS included,
 row_number() OVER (PARTITION BY profile_ordinal ORDER BY score DESC, seq_ordinal) AS rank FROM r""")
def report_by_score(spark, sf_dir):
    """Reporting and inclusion by scores of their own."""
    scored = target_scores(spark, sf_dir).select("profile_ordinal", "seq_ordinal", "score")
    return P.ranked_hits(scored, 1e12, P.SearchOptions(t=90.0, inc_t=140.0)).select("profile_ordinal", "seq_ordinal", "score", "reported", "included", "rank")


def _cutoffs(spark):
    """Cutoffs of profiles 0 to 5; the seventh has none, so nothing of it is reported."""
    n = F.col("id")
    return spark.range(6).select(n.cast("int").alias("profile_ordinal"), (80.0 + 10 * n).alias("tc_t"), (20.0 + 5 * n).alias("tc_d"))


@query(f"""{_TARGETS}, r AS (SELECT profile_ordinal, seq_ordinal, round(score, 6) AS score FROM h)
SELECT profile_ordinal, seq_ordinal, score, profile_ordinal < 6 AND score >= 80 + 10 * profile_ordinal AS reported, profile_ordinal < 6 AND score >= 80 + 10 * profile_ordinal AS included FROM r""")
def report_by_cutoffs(spark, sf_dir):
    """Reporting and inclusion by the profiles' own trusted cutoffs."""
    scored = target_scores(spark, sf_dir).select("profile_ordinal", "seq_ordinal", "score")
    return P.ranked_hits(scored, 1e12, P.SearchOptions(cutoffs="tc"), _cutoffs(spark)).select("profile_ordinal", "seq_ordinal", "score", "reported", "included")


_DOMAIN_SCORES = f"""WITH d AS (SELECT (l_orderkey % 7)::INT AS profile_ordinal, l_orderkey AS seq_ordinal, l_linenumber AS domain_ordinal, l_extendedprice / 1000 AS forward, l_quantity::INT + 1 AS own, ln(0.00390625::DOUBLE) + l_discount * 40 AS y, 1000.0::DOUBLE AS n FROM lineitem),
s AS (SELECT profile_ordinal, seq_ordinal, domain_ordinal, round((forward + (n - own) * ln(n / (n + 3)) - (n * ln(n / (n + 1)) + ln(1 - n / (n + 1))) - (greatest(y, 0) + ln(1 + exp(-abs(y))))) / {S.LN2!r}, 6) AS score FROM d)"""


def _reported_domains(spark, sf_dir, o):
    scored = target_scores(spark, sf_dir).select("profile_ordinal", "seq_ordinal", "score")
    hits = P.ranked_hits(scored, 1e12, o, _cutoffs(spark))
    d = P.domain_scores(_domains(spark, sf_dir), 1 / 256).withColumn("domain_score", F.round("domain_score", 6))
    d = P.domain_report(d, hits, 1e12, o, _cutoffs(spark))
    return d.select("profile_ordinal", "seq_ordinal", "domain_ordinal", F.col("domain_score").alias("score"), "dom_reported", "dom_included")


@query(f"""{_DOMAIN_SCORES} SELECT profile_ordinal, seq_ordinal, domain_ordinal, score, score >= 30 AS dom_reported, score >= 60 AS dom_included FROM s""")
def domains_by_score(spark, sf_dir):
    """Domains by scores of their own for reporting and inclusion."""
    return _reported_domains(spark, sf_dir, P.SearchOptions(t=90.0, inc_t=140.0, dom_t=30.0, inc_dom_t=60.0))


@query(f"""{_DOMAIN_SCORES} SELECT profile_ordinal, seq_ordinal, domain_ordinal, score, profile_ordinal < 6 AND score >= 20 + 5 * profile_ordinal AS dom_reported, profile_ordinal < 6 AND score >= 20 + 5 * profile_ordinal AS dom_included FROM s""")
def domains_by_cutoffs(spark, sf_dir):
    """Domains by the profiles' own trusted cutoffs."""
    return _reported_domains(spark, sf_dir, P.SearchOptions(cutoffs="tc"))


@query(f"""WITH d AS (SELECT (l_orderkey % 7)::INT AS profile_ordinal, l_orderkey AS seq_ordinal, l_extendedprice / 1000 AS f, 1000.0::DOUBLE AS n FROM lineitem),
g AS (SELECT profile_ordinal, seq_ordinal, n * ln(n / (n + 1)) + ln(1 - n / (n + 1)) AS null1, sum(greatest(f + 0.004, 0)) AS s FROM d GROUP BY profile_ordinal, seq_ordinal, n),
u AS (SELECT profile_ordinal, seq_ordinal, round(greatest((60.0 + 0.004 - null1) / {S.LN2!r} + 1e-5, (s - null1) / {S.LN2!r} + 1e-5), 6) AS upper FROM g)
SELECT profile_ordinal, seq_ordinal, upper, upper < 150 AS pruned FROM u""")
def ga_prune(spark, sf_dir):
    d = _domains(spark, sf_dir)
    cut = d.select("profile_ordinal").distinct().withColumn("ga_t", F.lit(150.0))
    out = P.gathering_prune(d.select("profile_ordinal", "seq_ordinal", "length", "forward_nats").distinct(), d, cut)
    return out.select("profile_ordinal", "seq_ordinal", F.round("upper", 6).alias("upper"), "pruned")


# -- regions on posterior tracks, over events of a user as positions --------------------------


def _tracks(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = read(spark, sf_dir, "events").select("user_id", (F.row_number().over(w)).alias("j"), (F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long") % 100).alias("v"))
    return e.select("user_id", "j", ((F.col("v") % 7) / 16.0).alias("starts"), ((F.col("v") % 5) / 16.0).alias("ends"), (F.col("v") / 128.0).alias("inside"))


_WALK = """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS j, (round(coalesce(value, 0) * 100)::BIGINT % 100) AS v FROM events),
t AS (SELECT user_id, j, (v % 7) / 16.0::DOUBLE AS b, (v % 5) / 16.0::DOUBLE AS e, v / 128.0::DOUBLE AS m FROM e),
m AS (SELECT user_id, 0::BIGINT AS j, NULL::BIGINT AS began, false AS is_on, NULL::BIGINT AS closed FROM t GROUP BY user_id
  UNION ALL SELECT t.user_id, t.j, CASE WHEN NOT m.is_on THEN CASE WHEN m.began IS NULL OR m.closed IS NOT NULL OR t.m - t.b < 0.1 THEN t.j ELSE m.began END ELSE m.began END,
    CASE WHEN NOT m.is_on THEN t.m >= 0.25 ELSE t.m - t.e >= 0.1 END, CASE WHEN m.is_on AND t.m - t.e < 0.1 THEN t.j END
  FROM m JOIN t ON t.user_id = m.user_id AND t.j = m.j + 1),
r AS (SELECT user_id, began AS lo, closed AS hi FROM m WHERE closed IS NOT NULL),
z AS (SELECT r.user_id, r.lo, r.hi, t.j, sum(t.e) OVER (PARTITION BY r.user_id, r.lo ORDER BY t.j) AS ends, sum(t.b) OVER (PARTITION BY r.user_id, r.lo ORDER BY t.j DESC) AS starts FROM r JOIN t ON t.user_id = r.user_id AND t.j BETWEEN r.lo AND r.hi)"""


@query(f"""{_WALK}
SELECT user_id, lo AS "begin", hi AS "end", round(max(least(ends, starts)), 9) AS split, max(least(ends, starts)) >= 0.2 AS multidomain FROM z GROUP BY user_id, lo, hi""")
def region_segments(spark, sf_dir):
    d = G.regions(_tracks(spark, sf_dir), "user_id", "j")
    return d.select("user_id", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), "split", (F.col("split") >= 0.2).alias("multidomain"))


@query(f"""{_WALK},
u AS (SELECT t.user_id, count(*) AS n, sum(CASE WHEN p.is_on THEN (abs(t.m - t.e - 0.1) <= 2e-4)::INT ELSE (abs(t.m - 0.25) <= 2e-4)::INT + (abs(t.m - t.b - 0.1) <= 2e-4)::INT END) AS doubts FROM t JOIN m p ON p.user_id = t.user_id AND p.j = t.j - 1 GROUP BY t.user_id),
s AS (SELECT user_id, lo, max(least(ends, starts)) AS split FROM z GROUP BY user_id, lo),
v AS (SELECT user_id, count(*) AS regions, sum((abs(split - 0.2) <= 2e-4)::INT) AS near, max(split) AS most FROM s GROUP BY user_id)
SELECT u.user_id, n, coalesce(regions, 0) AS regions, (doubts + coalesce(near, 0))::BIGINT AS uncertain,
    CASE WHEN doubts + coalesce(near, 0) > 0 THEN 'UNCERTAIN' WHEN regions IS NULL THEN 'NO_REGIONS' WHEN most >= 0.2 THEN 'MULTIDOMAIN' ELSE 'SIMPLE' END AS route FROM u LEFT JOIN v ON v.user_id = u.user_id""")
def row_routes(spark, sf_dir):
    return G.track_routes(_tracks(spark, sf_dir), "user_id", "j")


@query("""WITH i AS (SELECT l_suppkey, l_orderkey, l_linenumber, date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT AS lo, date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT + (l_quantity::BIGINT % 7) AS hi FROM lineitem),
r AS (SELECT *, max(hi) OVER (PARTITION BY l_suppkey ORDER BY lo, hi, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM i),
c AS (SELECT *, sum((reached IS NULL OR lo > reached)::INT) OVER (PARTITION BY l_suppkey ORDER BY lo, hi, l_orderkey, l_linenumber) AS c FROM r)
SELECT l_suppkey, l_orderkey, l_linenumber, min(lo) OVER (PARTITION BY l_suppkey, c) AS cluster_begin, max(hi) OVER (PARTITION BY l_suppkey, c) AS cluster_end, count(*) OVER (PARTITION BY l_suppkey, c) AS clustered FROM c""")
def interval_overlaps(spark, sf_dir):
    """Deliveries of a supplier as intervals of days: which chain of overlapping ones each belongs to."""
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("long")
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", day.alias("lo"), (day + F.col("l_quantity").cast("long") % 7).alias("hi"))
    return G.overlaps(rows, ["l_suppkey"], "lo", "hi", 256).drop("lo", "hi", "reached")


# -- accounting and telemetry -------------------------------------------------------------------


@query("""WITH e AS (SELECT event_type, value > 5 AS a, value > 10 AS b, value > 20 AS c FROM events),
g AS (SELECT event_type, count(*) AS total, count(*) FILTER (a) AS msv, count(*) FILTER (b) AS bias, count(*) FILTER (c) AS viterbi FROM e GROUP BY event_type)
SELECT event_type, total, stage, passed, round(passed / total, 9) AS share FROM (SELECT event_type, total, 'msv' AS stage, msv AS passed FROM g UNION ALL SELECT event_type, total, 'bias', bias FROM g UNION ALL SELECT event_type, total, 'viterbi', viterbi FROM g)""")
def stage_pass_rates(spark, sf_dir):
    v = F.coalesce("value", F.lit(0.0))
    e = read(spark, sf_dir, "events").select("event_type", (v > 5).alias("msv"), (v > 10).alias("bias"), (v > 20).alias("viterbi"))
    return R.stage_rates(e, ["event_type"], ["msv", "bias", "viterbi"])


@query("""WITH e AS (SELECT user_id, event_id, length(props)::BIGINT AS size, event_type = 'error' AS x, coalesce(value > 10, false) AS msv FROM events),
s AS (SELECT *, sum(x::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS segment, coalesce(sum(size) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT user_id, segment::BIGINT AS segment, min(event_id) AS "begin", max(event_id) AS "end", count(*) AS targets, sum(size)::BIGINT AS residues, min(before)::BIGINT AS residue_prefix, count(*) FILTER (msv) AS msv FROM s WHERE NOT x GROUP BY user_id, segment""")
def certificates(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.length("props").cast("long").alias("size"), F.coalesce(F.col("value") > 10, F.lit(False)).alias("msv"))
    return R.certificates(e, "user_id", "event_id", F.col("event_type") == "error", "size", ["msv"])


@query("""WITH e AS (SELECT event_type AS stage, unnest(list_filter([CASE WHEN value > 20 THEN 'HIGH' END, CASE WHEN value < 5 THEN 'LOW' END, CASE WHEN user_id % 2 = 0 THEN 'EVEN' END], lambda x: x IS NOT NULL)) AS reason, length(props)::BIGINT AS cells FROM events)
SELECT stage, reason, count(*) AS rows, sum(cells)::BIGINT AS logical_cells FROM e GROUP BY stage, reason""")
def telemetry_reasons(spark, sf_dir):
    v = F.col("value")
    reasons = F.array_compact(F.array(F.when(v > 20, "HIGH"), F.when(v < 5, "LOW"), F.when(F.col("user_id") % 2 == 0, "EVEN")))
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), reasons.alias("reasons"), F.length("props").cast("long").alias("cells"))
    return R.reason_totals(e, "stage", "reasons", "cells")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def telemetry_missing(spark, sf_dir):
    return R.missing_ordinals(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id")


@query("""WITH g AS (SELECT o_custkey, count(*) AS targets, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY o_custkey)
SELECT o_custkey, targets, F, O, P, F + O + P = targets AS complete FROM g""")
def route_partition(spark, sf_dir):
    return R.route_partition(read(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


@query("""WITH c AS (SELECT o_custkey, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cost FROM orders GROUP BY o_custkey)
SELECT o_custkey, cost, row_number() OVER (ORDER BY cost DESC, o_custkey) AS rank, sum(cost) OVER (ORDER BY cost DESC, o_custkey)::BIGINT AS numerator, sum(cost) OVER ()::BIGINT AS denominator FROM c""")
def pareto(spark, sf_dir):
    c = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cost"))
    return R.pareto(c, "o_custkey", "cost")


_TASKS = """WITH RECURSIVE o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, ceil(o_totalprice)::BIGINT AS w, count(*) OVER (PARTITION BY o_custkey) AS n, sum(ceil(o_totalprice)::BIGINT) OVER (PARTITION BY o_custkey) AS total FROM orders),
t AS (SELECT *, ceil(total / ceil(n / 8.0))::BIGINT AS target FROM o),
f AS (SELECT o_custkey, k, target, 0 AS task, 1 AS rows, w AS acc FROM t WHERE k = 1
  UNION ALL SELECT t.o_custkey, t.k, t.target, CASE WHEN f.rows >= 8 OR f.acc + t.w > t.target THEN f.task + 1 ELSE f.task END, CASE WHEN f.rows >= 8 OR f.acc + t.w > t.target THEN 1 ELSE f.rows + 1 END, CASE WHEN f.rows >= 8 OR f.acc + t.w > t.target THEN t.w ELSE f.acc + t.w END
  FROM f JOIN t ON t.o_custkey = f.o_custkey AND t.k = f.k + 1),
tasks AS (SELECT o_custkey, task, target, (min(k) - 1)::INT AS first, max(rows)::INT AS rows, max(acc)::BIGINT AS weight FROM f GROUP BY o_custkey, task, target)"""


@query(f"{_TASKS} SELECT o_custkey, task, target, first, rows, weight FROM tasks")
def balanced_tasks(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.ceil("o_totalprice").alias("w"))
    return R.balanced_tasks(o, "o_custkey", "o_orderkey", "w")


@query()
def sharded_tasks(spark, sf_dir):
    """Orders as heavy rows, their line items as parts."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.ceil("o_totalprice").alias("w")).withColumn("first", (F.row_number().over(w) - 1).cast("int"))
    items = read(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "first", F.col("l_linenumber").alias("part"), F.ceil("l_extendedprice").alias("w"))
    return R.sharded_tasks(R.balanced_tasks(o, "o_custkey", "o_orderkey", "w", 2), items, "o_custkey", (1, 1))


@query("SELECT event_type, count(*) AS runs, round(median(value), 6) AS median, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stdev FROM events GROUP BY event_type")
def replicate_stats(spark, sf_dir):
    d = R.replicate_statistics(read(spark, sf_dir, "events").where("value IS NOT NULL"), ["event_type"], "value")
    return d


@query("""WITH s AS (SELECT event_type, sum(value) / (SELECT sum(value) FROM events) AS f FROM events GROUP BY event_type), k(speedup) AS (VALUES (2.0::DOUBLE), (4.0), (10.0))
SELECT event_type, speedup, round(1 / (1 - f + f / speedup), 6) AS overall, round(1 / (1 - f), 6) AS ceiling FROM s, k""")
def amdahl(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("value").alias("v"))
    f = F.col("v") / F.sum("v").over(Window.partitionBy(F.lit(0)))  # a row for each stage
    d = e.select("event_type", f.alias("f")).withColumn("speedup", F.explode(F.array(F.lit(2.0), F.lit(4.0), F.lit(10.0))))
    return d.select("event_type", "speedup", F.round(S.amdahl(F.col("f"), F.col("speedup")), 6).alias("overall"), F.round(S.amdahl_ceiling(F.col("f")), 6).alias("ceiling"))


@query("SELECT count(*) AS compared, count(*) FILTER ((quality = 1) = (toxic = 1)) AS agreed, count(*) FILTER (quality = 1 AND toxic <> 1) AS only_first, count(*) FILTER (quality <> 1 AND toxic = 1) AS only_second, count(*) FILTER (quality IS NULL OR toxic IS NULL) AS skipped FROM labels")
def oracle_agreement(spark, sf_dir):
    return R.agreement(read(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1)


@query("SELECT 0::BIGINT AS only_first, 0::BIGINT AS only_second")
def shard_merge_equivalence(spark, sf_dir):
    """Four shards, merged, against the whole."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    shards = [o.where(F.pmod(F.xxhash64("o_orderkey"), F.lit(4)) == i) for i in range(4)]
    merged = shards[0].unionByName(shards[1]).unionByName(shards[2]).unionByName(shards[3])
    return R.set_differences(o, merged)


@query("""SELECT l_orderkey, l_linenumber, printf('%.2f', l_extendedprice) || chr(9) || printf('%.2e', l_discount) || chr(9) || coalesce(l_quantity::BIGINT::VARCHAR, '') AS line FROM lineitem""")
def result_tsv(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem")
    return d.select("l_orderkey", "l_linenumber", F.concat_ws("\t", F.format_string("%.2f", "l_extendedprice"), F.format_string("%.2e", "l_discount"), F.coalesce(F.col("l_quantity").cast("long").cast("string"), F.lit(""))).alias("line"))


@query("SELECT doc_id, sha256(source || ':' || coalesce(text, '')) AS fingerprint, length(coalesce(text, ''))::INT AS n FROM documents")
def record_fingerprints(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat("source", F.lit(":"), text), 256).alias("fingerprint"), F.length(text).alias("n"))


@query("SELECT quality, toxic FROM labels INTERSECT SELECT toxic, quality FROM labels")
def common_outcomes(spark, sf_dir):
    d = read(spark, sf_dir, "labels")
    return R.common_rows(d.select("quality", "toxic"), d.select(F.col("toxic").alias("quality"), F.col("quality").alias("toxic")))


@query("SELECT event_type, count(*) AS rows, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def incremental_ingest(spark, sf_dir):
    """Running counters of a stream of files, after everything there is."""
    from helixtable.streaming.ingest import counted_batches, files

    schema = read(spark, sf_dir, "events").schema
    stream = files(spark, f"{sf_dir}/events.parque[t]", schema)
    folder = sinks.shared_folder(spark, "ingest")
    return counted_batches(stream, "event_type", f"{folder}/parts", f"{folder}/checkpoint").select("event_type", "rows", F.round("total", 4).alias("total"))


# -- formats, merges and stability ---------------------------------------------------------------


@query(f"{LETTERS} SELECT 'doc' || seq_ordinal AS identifier, length, upper(residues) AS residues, sha256('>doc' || seq_ordinal || ' ' || source) AS header_sha256 FROM s")
def fasta_scan(spark, sf_dir):
    """Documents written as FASTA and read again."""
    path = sinks.shared_folder(spark, "fasta")
    records = letters(spark, sf_dir).select(F.concat("name", F.lit(" "), "source").alias("identifier"), "residues")
    sinks.write_lines(T.fasta_text(records), path)
    return T.read_fasta(spark, path).select("identifier", "length", "residues", "header_sha256")


@query(f"WITH {PROFILES} SELECT 'passage' || profile_ordinal AS name, model_length, 'P' || profile_ordinal AS accession, model_length / 2.0::DOUBLE AS ga_t FROM p WHERE model_length > 0")
def profile_text_scan(spark, sf_dir):
    """Passages written as profile text records and read again."""
    path = sinks.shared_folder(spark, "profiles")
    p = T.profile_table(read(spark, sf_dir, "benchmark"), T.residues_of)
    half = F.format_string("%.1f", F.col("model_length") / 2.0)
    text = F.concat(F.lit("HMMER3/f [3.4]\nNAME  "), "name", F.lit("\nACC   P"), "profile_ordinal", F.lit("\nLENG  "), "model_length", F.lit("\nGA    "), half, F.lit(" "), half, F.lit(";\nHMM  A C D\n//"))
    sinks.write_lines(p.select(text.alias("value")), path)
    return T.read_profile_text(spark, path).select("name", "model_length", "accession", F.col("ga")[0].alias("ga_t"))


@query("""WITH m AS (SELECT user_id AS profile_ordinal, event_id AS seq_ordinal, CASE WHEN value > 60 THEN 'OVERFLOW' WHEN value < 1 THEN 'NO_RESULT' ELSE 'OK' END AS msv_status, value > 5 AS msv_pass FROM events),
b AS (SELECT user_id AS profile_ordinal, event_id AS seq_ordinal, value > 10 AS bias_pass FROM events WHERE value > 5), v AS (SELECT user_id AS profile_ordinal, event_id AS seq_ordinal, value > 20 AS viterbi_pass FROM events WHERE value > 10)
SELECT profile_ordinal, seq_ordinal, CASE WHEN msv_status = 'OVERFLOW' THEN 'RANGE' WHEN msv_status <> 'OK' THEN 'EXACT_PATH' WHEN msv_pass THEN 'FINITE' ELSE 'RAW_REJECT' END AS kind,
 array_to_string(list_filter([CASE WHEN msv_status = 'OVERFLOW' THEN 'MSV_OVERFLOW' END, CASE WHEN msv_status = 'OK' AND NOT msv_pass THEN 'MSV_REJECT' END, CASE WHEN NOT bias_pass THEN 'BIAS_REJECT' END, CASE WHEN NOT viterbi_pass THEN 'VITERBI_REJECT' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM m LEFT JOIN b USING (profile_ordinal, seq_ordinal) LEFT JOIN v USING (profile_ordinal, seq_ordinal)""")
def merged_filters(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("profile_ordinal"), F.col("event_id").alias("seq_ordinal"), "value")
    key = ["profile_ordinal", "seq_ordinal"]
    msv = e.select(*key, F.when(F.col("value") > 60, "OVERFLOW").when(F.col("value") < 1, "NO_RESULT").otherwise("OK").alias("msv_status"), (F.col("value") > 5).alias("msv_pass"))
    bias, viterbi = e.where("value > 5").select(*key, (F.col("value") > 10).alias("bias_pass")), e.where("value > 10").select(*key, (F.col("value") > 20).alias("viterbi_pass"))
    return R.merged_filters(msv, bias, viterbi).select(*key, "kind", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT event_type, k AS query_index, count(*) FILTER (d = 0) AS day0_count, count(*) FILTER (d = 1) AS day1_count FROM (SELECT event_type, user_id % 5 AS k, event_id % 2 AS d FROM events) GROUP BY event_type, k")
def timing_matrix(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("query_index"), F.col("event_type").alias("query"), F.concat(F.lit("day"), F.col("event_id") % 2).alias("metric"))
    t = e.groupBy("query_index", "query", "metric").agg(F.count("*").alias("count")).withColumn("elapsed_ns", F.lit(0))
    d = T.timing_matrix(t, ["day0", "day1"])
    return d.select(F.col("query").alias("event_type"), "query_index", F.coalesce("day0_count", F.lit(0)).alias("day0_count"), F.coalesce("day1_count", F.lit(0)).alias("day1_count"))


@query(f"""WITH g AS (SELECT l_orderkey, round(sum(l_extendedprice) / 1000, 6) AS score FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, score, abs(score - 150) > 0.5 AS stable, ((0.9 * exp(-{S.LN2!r} * score / 10)) * 1e4 <= 1.0) = ((1.1 * exp(-{S.LN2!r} * score / 10)) * 1e4 <= 1.0) AS stable_e FROM g""")
def stable_calls(spark, sf_dir):
    g = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice") / 1000, 6).alias("score"))
    p = F.exp(-S.LN2 * F.col("score") / 10)
    return g.select("l_orderkey", "score", V.stable_call(F.col("score"), F.lit(0.5), 150.0).alias("stable"), V.stable_evalue(0.9 * p, 1.1 * p, F.lit(1e4), 1.0).alias("stable_e"))


@query()
def stage_seals(spark, sf_dir):
    """Seals of orders over three stages, after one value was changed: the stage that the change breaks."""
    stages = {"key": ["o_orderkey", "o_custkey"], "status": ["o_orderstatus"], "price": ["o_totalprice"]}
    d = V.sealed(read(spark, sf_dir, "orders"), stages)
    changed = d.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 1, F.lit("X")).otherwise(F.col("o_orderstatus")))
    return V.broken_seals(changed, stages).select("o_orderkey", "broken")


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def scattered_facts(spark, sf_dir):
    return V.scattered(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", "toxic")


@query("SELECT l_orderkey % 100 AS chunk, count(*) AS cells_rows, sum(l_linenumber::BIGINT * l_partkey)::BIGINT AS cells FROM lineitem GROUP BY l_orderkey % 100")
def work_cells(spark, sf_dir):
    """Profile positions times residues, by chunk."""
    d = read(spark, sf_dir, "lineitem")
    return d.groupBy((F.col("l_orderkey") % 100).alias("chunk")).agg(F.count("*").alias("cells_rows"), F.sum(F.col("l_linenumber").cast("long") * F.col("l_partkey")).alias("cells"))
