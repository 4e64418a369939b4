"""Document fingerprints: a homomorphic multiset hash of paragraphs, with DataFrame functions only.

A paragraph (a line of the text) is hashed to a wide vector: EXACT lanes from its whole content, NEAR lanes that
count the bits of the hashes of its pieces, and how many pieces there are. Pieces are cut where the content says, after a
space that follows one of LAST, or after LONGEST code points: what is put in or taken out changes the pieces around it,
not those after it. A document's fingerprint is the sum of its paragraphs' vectors, exact lanes, near lanes and the
count of pieces modulo 2^32 each, printed one after the other. So the order of paragraphs does not matter, and a
paragraph's vector can be added or taken away without the rest of its document (`added`, `removed`).

Likeness comes from the lanes that the fingerprint prints: it is the cosine of the centred near lanes, at least 0. With
+1 for a set and -1 for a clear bit, the inner product of two sums estimates how many pieces the texts share.

Defined cases: a null text is an empty one, and an empty text is one empty paragraph without pieces; two texts
without pieces are alike (1), a text with and one without are not (0); a null doc_id comes last in descending order;
rows that share a doc_id are ordered by their text's MD5; a table of one row has itself as next row; columns of other
names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixtable.llm.common import text_of, written

EXACT, NEAR, LAST, LONGEST = 8, 60, "adehlnort", 48
PIECE = rf"(?s).{{1,{LONGEST}}}?[{LAST}] |.{{1,{LONGEST}}}"


def _lower_hex(value: str, width: int, modulus: int) -> str:
    return f"array_join(transform({value}, x -> lpad(lower(hex(pmod(x, {modulus}L))), {width}, '0')), '')"


def fingerprinted(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with <out>_exact, <out>_near (array<long>), <out>_pieces (long) and <out> (hexadecimal) of the non-null column text."""
    number = lambda digest, at, n: f"cast(conv(substring({digest}, {at}, {n}), 16, 10) as long)"
    halves = ", ".join(number("d[0]", 8 * k + 1, 8) for k in range(4)) + ", " + ", ".join(number("d[1]", 8 * k + 1, 8) for k in range(4))
    df = df.withColumn("p_", F.split(text, "\n", -1))
    df = df.withColumn("h_", F.expr(f"transform(transform(p_, p -> array(md5(p), md5(concat('+', p)))), d -> array({halves}))"))
    df = df.withColumn(f"{out}_exact", F.expr("array(" + ", ".join(f"aggregate(h_, 0L, (a, h) -> (a + h[{k}]) % {1 << 32}L)" for k in range(EXACT)) + ")"))
    df = df.withColumn("b_", F.expr(f"transform(flatten(transform(p_, p -> regexp_extract_all(p, '{PIECE}', 0))), x -> {number('md5(x)', 1, NEAR // 4)})"))
    # two lanes in one sum, 31 bits each
    half = NEAR // 2
    sums = ", ".join(f"aggregate(b_, 0L, (a, h) -> a + (shiftright(h, {j}) & 1L) + shiftleft(shiftright(h, {j + half}) & 1L, 31))" for j in range(half))
    df = df.withColumn("s_", F.expr(f"array({sums})")).withColumn(f"{out}_pieces", F.size("b_").cast("long"))
    df = df.withColumn(f"{out}_near", F.expr(f"concat(transform(s_, x -> x & {(1 << 31) - 1}L), transform(s_, x -> shiftright(x, 31)))"))
    df = df.withColumn(out, F.expr(f"concat({_lower_hex(f'{out}_exact', 8, 1 << 32)}, {_lower_hex(f'{out}_near', 8, 1 << 32)}, lpad(lower(hex({out}_pieces % {1 << 32}L)), 8, '0'))"))
    return df.drop("p_", "h_", "b_", "s_")


def added(exact: Column, other: Column) -> Column:
    """The exact lanes of a document after the paragraphs whose lanes are `other` joined it."""
    return F.zip_with(exact, other, lambda a, b: F.pmod(a + b, F.lit(1 << 32)))


def removed(exact: Column, other: Column) -> Column:
    """The exact lanes of a document after the paragraphs whose lanes are `other` left it."""
    return F.zip_with(exact, other, lambda a, b: F.pmod(a - b, F.lit(1 << 32)))


def likeness(a: str, b: str) -> Column:
    """0 to 1 from the columns <a>, <a>_near, <a>_pieces and those of b."""
    dot = lambda x, y: f"aggregate(zip_with({x}_near, {y}_near, (u, v) -> cast((2 * u - {x}_pieces) as double) * (2 * v - {y}_pieces)), 0D, (s, z) -> s + z)"
    cosine = f"{dot(a, b)} / sqrt({dot(a, a)} * {dot(b, b)})"
    return F.expr(f"CASE WHEN {a} = {b} THEN 1D WHEN {dot(a, a)} = 0 OR {dot(b, b)} = 0 THEN cast({a}_pieces = {b}_pieces as double) ELSE greatest(0D, least(1D, {cosine})) END")


def ranges(df: DataFrame, key: str, levels: int) -> DataFrame:
    """df with range_, which grows with key: up to 2^levels ranges of about as many rows each; null keys lie below all."""
    n = 1 << levels
    found = df.select(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0] or [0] * (n - 1)  # n - 1 numbers
    bounds = "array(" + ", ".join(f"{int(x)}L" for x in found) + ")"
    steps = "array(" + ", ".join(str(n >> (i + 1)) for i in range(levels)) + ")"
    search = f"aggregate({steps}, 0, (a, h) -> CASE WHEN element_at({bounds}, a + h) < {key} THEN a + h ELSE a END)"
    return df.withColumn("range_", F.expr(f"CASE WHEN {key} IS NULL THEN -1 ELSE {search} END"))


def with_next(docs: DataFrame, levels: int) -> DataFrame:
    """doc_id, text and fingerprint columns (me...) of docs, and those of the next row in descending doc_id (next_...).

    Rows are dealt once, by ranges of doc_id. The head of each range, one row of 2^levels at most, is also put into
    the range above it as the row that follows there; the topmost head follows the last row of all.
    """
    keyed = ranges(docs, "doc_id", levels).withColumn("tie_", F.xxhash64("text"))
    tops = keyed.groupBy("range_").agg(F.max(F.struct("doc_id", "tie_")).alias("m_"))
    order = Window.orderBy("range_")  # over 2^levels rows at most
    tops = written(tops.select("range_", F.coalesce(F.lead("range_").over(order), F.first("range_").over(order)).alias("above_"), "m_.doc_id", "m_.tie_"), "heads")
    same = (keyed.range_ == tops.range_) & keyed.doc_id.eqNullSafe(tops.doc_id) & (keyed.tie_ == tops.tie_)
    heads = keyed.join(F.broadcast(tops), same).select(tops.above_.alias("range_"), keyed.doc_id, keyed.text, keyed.tie_).dropDuplicates(["range_", "doc_id", "tie_"])
    columns = ["range_", "doc_id", "tie_", "text"]
    rows = keyed.select(*columns, F.lit(0).alias("guest_")).union(heads.select(*columns, F.lit(1)))
    rows = fingerprinted(rows, "text", "me")
    down = Window.partitionBy("range_").orderBy("guest_", F.col("doc_id").desc_nulls_last(), F.col("tie_").desc())
    for c in ("text", "me", "me_near", "me_pieces"):
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(down))
    return rows.where("guest_ = 0")


def fingerprint_edits(docs: DataFrame, levels: int | None = None) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document's
    text in descending doc_id. levels: 2^levels ranges of doc_id, by default four for each shuffle partition, 2^14 at most.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    levels = levels or min(14, (4 * partitions - 1).bit_length())
    rows = with_next(docs.select("doc_id", text_of().alias("text")), levels)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited_", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))"))
    rows = rows.select("doc_id", "n_chars", "edited_", "me", "me_near", "me_pieces", F.col("next_me").alias("next"), F.col("next_me_near").alias("next_near"), F.col("next_me_pieces").alias("next_pieces"))
    rows = fingerprinted(rows, "edited_", "edited")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited_", 256).alias("edited_sha256"), F.col("me").alias("fingerprint"), F.col("edited").alias("edited_fingerprint"),
        likeness("me", "edited").alias("near_edited"), likeness("me", "next").alias("near_next"),
    )


def _fingerprint_sql(text: str) -> str:
    """DuckDB list of the exact lanes, the near lanes and the number of pieces of a text."""
    number = lambda s, salt, at, n: f"('0x' || substr(md5({salt}{s}), {at}, {n}))::BIGINT"
    lines = f"string_split({text}, chr(10))"
    pieces = f"list_transform(flatten(list_transform({lines}, lambda p: regexp_extract_all(p, '{PIECE}'))), lambda x: {number('x', '', 1, NEAR // 4)})"
    exact = ", ".join(f"list_sum(list_transform({lines}, lambda p: {number('p', chr(39) * 2 + ' || ' if k < 4 else chr(39) + '+' + chr(39) + ' || ', 8 * (k % 4) + 1, 8)})) % {1 << 32}" for k in range(EXACT))
    near = ", ".join(f"coalesce(list_sum(list_transform(b, lambda h: (h >> {j}) & 1)), 0)" for j in range(NEAR))
    return f"SELECT *, [{exact}] AS e, {pieces} AS b FROM", f"SELECT * EXCLUDE (b), [{near}] AS n, len(b) AS c FROM"


def _oracle() -> str:
    first, second = _fingerprint_sql("t")
    hexed = lambda lanes, width, mod: f"array_to_string(list_transform({lanes}, lambda x: lpad(lower(to_hex((x % {mod})::BIGINT)), {width}, '0')), '')"
    dot = lambda a, b: f"list_sum(list_transform(range(1, {NEAR + 1}), lambda i: ((2 * {a}n[i] - {a}c) * (2 * {b}n[i] - {b}c))::DOUBLE))"
    like = lambda a, b: f"CASE WHEN {a}f = {b}f THEN 1.0::DOUBLE WHEN {dot(a, a)} = 0 OR {dot(b, b)} = 0 THEN ({a}c = {b}c)::INT::DOUBLE ELSE greatest(0.0, least(1.0, {dot(a, b)} / sqrt({dot(a, a)} * {dot(b, b)}))) END"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    o AS (SELECT doc_id, t, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS follows, coalesce(lead(t) OVER w, first_value(t) OVER w) AS u FROM d WINDOW w AS (ORDER BY doc_id DESC)),
    g AS (SELECT doc_id, follows, length(t)::BIGINT AS n_chars, substr(t, 1, length(t) - length(t) // 2) || substr(u, 1, length(t) // 2) AS x FROM o),
    texts AS (SELECT 0 AS kind, doc_id, t FROM d UNION ALL SELECT 1, doc_id, x FROM g),
    v AS ({second} ({first} texts)),
    f AS (SELECT kind, doc_id, n, c, {hexed('e', 8, 1 << 32)} || {hexed('n', 8, 1 << 32)} || lpad(lower(to_hex(c % {1 << 32})), 8, '0') AS f FROM v)
    SELECT g.doc_id, g.n_chars, sha256(g.x) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint, {like('a.', 'b.')} AS near_edited, {like('a.', 'm.')} AS near_next
    FROM g JOIN f a ON a.kind = 0 AND a.doc_id = g.doc_id JOIN f b ON b.kind = 1 AND b.doc_id = g.doc_id JOIN f m ON m.kind = 0 AND m.doc_id = g.follows
    """


ORACLE_SQL = _oracle()
