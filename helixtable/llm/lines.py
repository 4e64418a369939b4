"""Line dedup: an exact set-similarity join of lines, with DataFrame functions only.

A line's tokens are its distinct words in lower case, ordered by rarity: by the binary logarithm of the corpus count of
one of BUCKETS hash buckets, then by hash. A line is removed if any earlier line (by doc_id, then line number) of
the corpus has a Jaccard similarity of at least SIMILARITY with it. Lines of equal token sets are one set, known by
128 bits, of which the first line stays. Different sets are joined on their prefixes: the n - ceil(t n) + CLASSES + 1
rarest tokens, of which similar sets share CLASSES + 1 at least. If one of those is in a bucket of fewer than
2^(RARE + 1) words, it is a key by itself, and its list has no more rows than that; there a set is looked for among those of
no more tokens, of which the n - ceil(2 t n / (1 + t)) + 1 rarest are enough. If all are more frequent, two of them are in one of
CLASSES hash classes, and that pair of tokens is the key. So no list is that of one frequent token, and the rows of
the joins grow with the lines. Where a corpus is so large that each bucket is full, all keys are pairs of the tokens
of the emptier buckets. Candidates must pass the length filter, the positional filter (single tokens) and a bound on the
bits in which the parities of the tokens' hashes differ; they are verified on whole token sets, read again from the texts.

Defined cases: a null text is an empty one; a null doc_id comes first; rows equal in doc_id and text are one document
whose lines are no earlier than each other, rows that share only a doc_id are ordered by their text's hash; lines
without words are never removed; lines of any number of words take part; a document may lose all lines and then has an
empty text; an empty table gives an empty result; `deduplicated` keeps other columns as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixtable.llm.common import WORD, forget, kept_by, marked, nested, text_of, written

SIMILARITY, CLASSES, RARE, BUCKETS, HEADS, SIEVES, FIRST = 0.8, 4, 10, 1 << 21, 4, 8, 3
SET = ("id", "n", "bits", "more")
WIDE = (*SET, "bits2", "more2")  # with a second sketch, for sets that are met by pairs of frequent tokens
PLACE = ("key", "tie", "line")  # of a line, in the order of lines
PART, HASH_BITS = 4096, 58  # buckets in a part of the counts; bits of a token's hash below its rarity


def words(text: Column) -> Column:
    """The words of a line or text in lower case, repeats included."""
    for space in "\t\n\x0b\x0c\r":  # one plain character splits without a regular expression
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(F.lower(text), " ", -1), "")


def hashes(line: Column) -> Column:
    """The hashes of the distinct words of a line."""
    return F.array_distinct(F.transform(words(line), lambda w: F.xxhash64(w)))


def keyed(docs: DataFrame) -> DataFrame:
    """key (doc_id, the least number for a null one), tie (hash of the text), text."""
    return docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64(text_of()).alias("tie"), text_of().alias("text"))


def exploded(texts: DataFrame) -> DataFrame:
    return texts.select("key", "tie", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))


def bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1))


def rarity(texts: DataFrame) -> DataFrame:
    """One row, counts: for each bucket the binary logarithm of how often its words stand in the texts. BUCKETS bytes whatever the input."""
    met = texts.select(F.explode(words(F.col("text"))).alias("w")).select(bucket(F.xxhash64("w")).alias("id")).groupBy("id").agg(F.floor(F.log2(F.count("*"))).cast("tinyint").alias("k")).where("k > 0")
    parts = met.groupBy(F.floor(F.col("id") / PART).alias("part")).agg(F.sort_array(F.collect_list(F.struct((F.col("id") % PART).cast("int").alias("at"), "k"))).alias("x"))  # PART at most
    one = "concat(array_repeat(0Y, e.at - CASE WHEN i = 0 THEN 0 ELSE x[i - 1].at + 1 END), array(e.k))"
    filled = F.expr(f"concat(flatten(transform(x, (e, i) -> {one})), array_repeat(0Y, {PART - 1} - x[size(x) - 1].at))")
    rows = texts.sparkSession.range(BUCKETS // PART).select(F.col("id").alias("part")).join(parts, "part", "left")
    rows = rows.select("part", F.coalesce(filled, F.expr(f"array_repeat(0Y, {PART})")).alias("x"))
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "x"))), lambda r: r.x))
    return written(rows.agg(whole.alias("counts")), "line-counts")


def by_rarity(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """lines with t, the tokens (h) rarest first: their bucket's logarithm above HASH_BITS bits of their hash; s1 and s2 are hashes of the
    whole set. The counts are a scalar subquery, so they stand in no plan. No token is NULL, or they would not be sorted as plain numbers."""
    rank = lambda h: F.coalesce(F.col("counts")[bucket(h).cast("int")].cast("long"), F.lit(0).cast("long"))
    t = F.sort_array(F.transform("h", lambda h: F.shiftleft(rank(h), HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - HASH_BITS))))
    # the counts must be named once only, or Spark lays them into each row
    named = lines.select(*PLACE, "h", counts.scalar().alias("counts")).select(*PLACE, t.alias("t"))
    return named.select(*PLACE, F.xxhash64("t").alias("s1"), F.xxhash64(F.lit(1), "t").alias("s2"), "t")


def keyed_sets(tokens: DataFrame, similarity: float) -> DataFrame:
    """tokens (t, n and others) with singles, the rare tokens that are keys by themselves, and frequent, those of which
    pairs are keys (of any two classes if few are shared). Sets that only an equal set can be similar to have neither."""
    least = f"cast(ceil({similarity} * n - 1e-9) as int)"
    partner = f"(floor(n / {similarity} + 1e-9) > n OR {least} < n OR n - 1 >= {similarity} * (n + 1) - 1e-9)"
    prefix = lambda more: f"slice(t, 1, CASE WHEN {partner} THEN n - {least} + {more} ELSE 0 END)"
    rare = f"shiftright(x, {HASH_BITS}) <= {RARE}"
    # if a shared token is rare, so is the rarest one, which stands in the prefixes that hold one shared token; a token
    # that is alone in its bucket is in no other line
    singles = f"transform({prefix(1)}, x -> CASE WHEN x >= {1 << HASH_BITS}L AND ({rare} OR {least} <= 1) THEN x END)"
    d = tokens.withColumn("singles", F.expr(singles)).withColumn("frequent", F.expr(f"filter({prefix(CLASSES + 1)}, x -> NOT {rare})")).withColumn("few", F.expr(f"{least} <= {CLASSES}"))
    # similar sets that share no rare token share `least` frequent ones, of which CLASSES + 1 stand here: a set that has fewer is met by rare tokens alone
    return d.withColumn("frequent", F.expr(f"CASE WHEN size(frequent) >= greatest(2, least({CLASSES + 1}, {least})) THEN frequent ELSE array() END"))


def paired(sets: DataFrame) -> DataFrame:
    """id, n, bits, more, key of the pairs of frequent tokens of one class; of all pairs where fewer than CLASSES + 1 tokens need be shared."""
    firsts = sets.where(F.size("frequent") > 1).select(*WIDE, "few", "frequent", F.posexplode("frequent").alias("i", "x"))
    own = f"filter(slice(frequent, i + 2, size(frequent)), y -> few OR (shiftright(x ^ y, 6) & {CLASSES - 1}L) = 0)"  # no row is made for a pair that is no key
    return firsts.select(*WIDE, "x", F.explode(F.expr(own)).alias("y")).select(*WIDE, F.xxhash64("x", "y").alias("key"))


def sieved(pair: DataFrame) -> DataFrame:
    """id, sieve, key: SIEVES minimum hashes of a set's pairs, so many rows a set, however many pairs it has."""
    least = F.array(*[F.min(F.xxhash64("key", F.lit(i))) for i in range(SIEVES)])
    return pair.groupBy("id").agg(least.alias("m")).select("id", F.posexplode("m").alias("sieve", "key"))


def parities(t: str, high: bool, shift: int = 0) -> Column:
    """64 of 128 bits: whether an odd number of tokens has each of 128 hash values. Two sets differ in as many tokens at least as bits."""
    x = f"shiftright(x, {shift})" if shift else "x"
    return F.expr(f"aggregate({t}, 0L, (a, x) -> CASE WHEN ({x} & 64L) {'<>' if high else '='} 0L THEN a ^ shiftleft(1L, cast({x} & 63L as int)) ELSE a END)")


APART = "(bit_count(bits_a ^ bits_b) + bit_count(more_a ^ more_b))"


def fitting(similarity: float, met_by: str = "") -> Column:
    """Whether sets a and b (n_a, n_b, bits_a, bits_b, more_a, more_b) can still be similar: where they are met by "tokens", also by their first
    common token, at pos_a and pos_b, and where they are met by "pairs" of tokens, by a second sketch."""
    need = f"ceil({similarity / (1 + similarity)!r} * (n_a + n_b) - 1e-9)"
    lengths = f"least(n_a, n_b) >= {similarity} * greatest(n_a, n_b) - 1e-9"
    more = {
        "tokens": f" AND least(n_a - pos_a, n_b - pos_b) >= {need}",
        "pairs": f" AND bit_count(bits2_a ^ bits2_b) + bit_count(more2_a ^ more2_b) <= n_a + n_b - 2 * {need}",
    }
    return F.expr(f"{lengths} AND {APART} <= n_a + n_b - 2 * {need}{more.get(met_by, '')}")


def by_first_tokens(sets: DataFrame, similarity: float) -> DataFrame:
    """id_a, id_b, apart: each set with the earliest set and the last one before it that have one of its FIRST rarest keys in their own,
    if they can be similar. Two rows at most for each of these keys, however many sets are alike; a list is that of a rare token."""
    list_ = Window.partitionBy("token").orderBy("id")
    own = F.struct(*SET)
    met = sets.select(*SET, F.explode("first").alias("token")).select(*SET, F.first(own).over(list_).alias("one"), F.lag(own).over(list_).alias("two")).where("two IS NOT NULL")
    met = met.select(*SET, F.explode(F.array_distinct(F.array("one", "two"))).alias("a"))
    met = met.select(*[F.col(f"a.{c}").alias(f"{c}_a") for c in SET], *[F.col(c).alias(f"{c}_b") for c in SET]).where("id_a < id_b")
    return met.where(fitting(similarity)).select("id_a", "id_b", F.expr(APART).alias("apart"))


def by_pairs(pair: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """id_a, id_b, apart: each set with HEADS early sets, at most, of those that share one of SIEVES minimum hashes of its pairs, if they can be
    similar. One row for each minimum hash, which has its early sets in an array, so that the same early set is met once."""
    least = sieved(pair)
    salt = F.pmod(F.xxhash64("id"), F.lit(HEADS))
    heads = least.groupBy("sieve", "key").agg(*[F.min(F.when(salt == i, F.col("id"))).alias(f"h{i}") for i in range(HEADS)])
    heads = heads.select("sieve", "key", F.array(*[f"h{i}" for i in range(HEADS)]).alias("heads"))
    met = least.join(heads, ["sieve", "key"]).select("id", F.filter("heads", lambda h: h < F.col("id")).alias("heads")).where(F.size("heads") > 0)
    star = met.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("heads"))).alias("heads")).select(F.explode("heads").alias("id_a"), F.col("id").alias("id_b"))
    thin_a, thin_b = (sets.select(*[F.col(c).alias(f"{c}_{x}") for c in WIDE]) for x in "ab")
    return star.join(thin_a, "id_a").join(thin_b, "id_b").where(fitting(similarity, "pairs")).select("id_a", "id_b", F.expr(APART).alias("apart"))


def by_singles(sets: DataFrame, similarity: float) -> DataFrame:
    """id_a, id_b (the later one) of the sets that share a rare token and can be similar, if the later one is open. A set of no fewer tokens
    is looked for among those of no more, of which a shorter prefix is enough: it can lack only as many tokens as the lengths allow."""
    single = sets.select(*SET, "open", F.posexplode("singles").alias("pos", "token")).where("token IS NOT NULL")
    few = F.expr(f"pos < n - ceil({2 * similarity / (1 + similarity)!r} * n - 1e-9) + 1")
    packed = F.expr("shiftleft(cast(n as long), 32) | shiftleft(cast(pos as long), 1) | cast(open as long)").alias("what")  # rows are many: one field less is a seventh
    side = lambda d, x: d.select("token", "id", packed, "bits", "more").select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "what", "bits", "more")])
    unpacked = [F.expr(e).alias(f"{c}_{x}") for x in "ab" for c, e in (("n", f"cast(shiftright(what_{x}, 32) as int)"), ("pos", f"cast(shiftright(what_{x}, 1) & 2147483647L as int)"))]
    met = side(single.where(few), "a").join(side(single, "b"), "token").where("CASE WHEN id_a < id_b THEN what_b ELSE what_a END & 1L = 1L AND id_a <> id_b")
    met = met.select("id_a", "id_b", "bits_a", "bits_b", "more_a", "more_b", *unpacked).where("n_a <= n_b").where(fitting(similarity, "tokens"))
    return met.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def sides(left: DataFrame, right: DataFrame, on: str, *columns: str) -> DataFrame:
    """left as a and right as b, joined on a key; the earlier set is a."""
    a, b = (d.select(on, *[F.col(c).alias(f"{c}_{x}") for c in columns]) for d, x in ((left, "a"), (right, "b")))
    return a.join(b, on).where("id_a < id_b")


def verified(pairs: DataFrame, firsts: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """ids of the later sets (id_b) of the pairs that are similar, by their whole token sets, read again from the texts."""
    ids = pairs.select(F.col("id_a").alias("id")).union(pairs.select(F.col("id_b").alias("id"))).distinct()
    needed = written(firsts.select("id", *PLACE, F.xxhash64(*PLACE).alias("place")).join(ids, "id"), "line-needs")
    whole = kept_by(exploded(texts).withColumn("place", F.xxhash64(*PLACE)), "place", marked(needed, "place")).drop("place")
    whole = written(whole.join(needed, [*PLACE]).dropDuplicates(["id"]).select("id", hashes(F.col("content")).alias("t")), "line-tokens")
    a, b = (whole.select(*[F.col(c).alias(f"{c}_{x}") for c in ("id", "t")]) for x in "ab")
    same = F.size(F.array_intersect("t_a", "t_b"))
    both = pairs.join(a, "id_a").join(b, "id_b").where(same >= F.lit(similarity) * (F.size("t_a") + F.size("t_b") - same) - 1e-9)
    out = written(both.select(F.col("id_b").alias("id")).distinct(), "line-late")
    forget(needed, whole)
    return out


def similar_sets(sets: DataFrame, lines: DataFrame, firsts: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """ids of the sets with an earlier similar set. sets: id (in the order of lines), n, bits, more, first (the FIRST rarest
    keys), frequent, few; lines: a line's place, n, bits, more, singles. Both are written tables that go when they are read for the last time.

    Each set is first held against a few early sets that share one of its rarest tokens, or a minimum hash of its pairs; of these the one with
    the fewest differing bits is verified. That settles groups of near copies at the cost of their members. Only the sets that this left
    open are then joined with all that are earlier: by rare tokens, whose lists are short, and by pairs of frequent ones.
    """
    pair = paired(sets)
    held = pair.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    pair = written(pair.join(held, "key"), "line-pairs")  # what more than one set has
    found = by_first_tokens(sets, similarity).union(by_pairs(pair, sets, similarity))
    best = found.groupBy("id_b").agg(F.min(F.shiftleft(F.least("apart", F.lit(127)).cast("long"), 56).bitwiseOR(F.col("id_a"))).alias("x"))  # 56 bits hold an id
    best = written(best.select(F.col("x").bitwiseAND(F.lit((1 << 56) - 1)).alias("id_a"), "id_b"), "line-best")
    early = verified(best, firsts, texts, similarity)
    marks = firsts.select("id", *PLACE).join(early.select("id", F.lit(False).alias("late")), "id", "left").select("id", *PLACE, F.col("late").isNull().alias("open"))
    open_ = lines.select(*PLACE, *SET[1:], "singles").join(marks, [*PLACE]).select(*SET, "singles", "open")  # single tokens are many and move once
    open_ = written(open_, "line-open")
    forget(sets, lines)  # the largest tables; nothing reads them any more
    near = written(by_singles(open_, similarity).distinct(), "line-near")
    forget(open_)
    rest = sides(pair, pair.join(early, "id", "left_anti"), "key", *WIDE).where(fitting(similarity, "pairs")).select("id_a", "id_b")
    rest = near.union(rest).distinct().join(best, ["id_a", "id_b"], "left_anti")
    rest = written(rest, "line-rest")
    late = verified(rest, firsts, texts, similarity)
    forget(pair, best, near, rest)
    return early.union(late).distinct()


def removed_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """key, tie, removed (sorted line numbers) of the documents that lose lines."""
    texts = keyed(docs)
    tokens = exploded(texts).select(*PLACE, "content").where(F.col("content").rlike(WORD)).select(*PLACE, hashes(F.col("content")).alias("h"))  # a condition on h would hash twice
    rare_first = by_rarity(tokens, rarity(texts)).withColumn("n", F.size("t")).withColumn("bits", parities("t", False)).withColumn("more", parities("t", True))
    second = [F.when(F.size("frequent") > 1, parities("t", high, 7)).otherwise(F.lit(0).cast("long")).alias(c) for c, high in (("bits2", False), ("more2", True))]
    lines = keyed_sets(rare_first, similarity).select(*PLACE, "s1", "s2", *SET[1:], *second, "singles", "frequent", "few")
    lines = written(lines, "lines")  # of a line's tokens only those that are keys; all of them cost more to write than to find again
    firsts = lines.groupBy("s1", "s2").agg(F.min(F.struct(*PLACE)).alias("at")).select("at.*", "s1", "s2")
    firsts = written(firsts.orderBy(*PLACE).withColumn("id", F.monotonically_increasing_id()), "line-firsts")  # ids grow as places do
    first = F.slice(F.filter("singles", lambda x: x.isNotNull()), 1, FIRST).alias("first")
    sets = lines.select(*PLACE, *WIDE[1:], first, "frequent", "few").join(firsts.select("id", *PLACE), [*PLACE])
    sets = written(sets.select(*WIDE, "first", "frequent", "few"), "line-sets")
    whole, lines = lines, written(lines.select(*PLACE, "s1", "s2"), "line-names")
    late = similar_sets(sets, whole, firsts, texts, similarity).withColumn("late", F.lit(True))
    ends = firsts.select("id", "s1", "s2", F.struct(*PLACE).alias("first")).join(late, "id", "left").drop("id")
    gone = lines.select(*PLACE, "s1", "s2").join(ends, ["s1", "s2"]).where(F.col("late").isNotNull() | (F.struct(*PLACE) > F.col("first")))
    out = written(gone.groupBy("key", "tie").agg(F.array_sort(F.collect_set("line")).alias("removed")), "gone")
    forget(firsts, lines)
    return out


def _cleaned(docs: DataFrame, similarity: float) -> DataFrame:
    """row (the document), text (what is left; NULL only where it was), n_removed, n_lines."""
    rows = nested(docs, key=F.coalesce("doc_id", F.lit(-(1 << 63))), tie=F.xxhash64(text_of())).join(removed_lines(docs, similarity), ["key", "tie"], "left")
    all_lines = F.split(F.coalesce("row.text", F.lit("")), "\n", -1)
    left = F.array_join(F.filter(all_lines, lambda x, i: ~F.array_contains("removed", i)), "\n")
    return rows.select(
        "row", F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(left).alias("text"),
        F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.size(all_lines).alias("n_lines"),
    )


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with `text` less the removed lines, and n_chars to match, if it is there."""
    rows, kinds = _cleaned(docs, similarity), dict(docs.dtypes)
    new = {"text": F.col("text")}
    if "n_chars" in kinds:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(kinds["n_chars"])).otherwise(F.col("row.n_chars"))
    return rows.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def line_dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, text (what is left)."""
    rows = _cleaned(docs.select("doc_id", text_of().alias("text")), similarity)
    return rows.select("row.doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), "text")


ORACLE_SQL = rf"""
WITH d AS (SELECT coalesce(doc_id, -9223372036854775808) AS key, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT key, i, string_split(text, chr(10))[i] AS line FROM (SELECT key, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d)),
t AS (SELECT key, i, line, list_distinct(regexp_extract_all(lower(line), '{WORD}')) AS w FROM l),
u AS (SELECT row_number() OVER (ORDER BY key, i) AS p, key, i, list_sort(w) AS w, len(w) AS n FROM t WHERE len(w) >= 1),
s AS (SELECT min(p) AS p, w, n FROM u GROUP BY w, n),
x AS (SELECT p, n, unnest(list_transform(list_sort(list_transform(w, lambda x: {{'k': -length(x), 'x': x}}))[1:(n - ceil({SIMILARITY} * n - 1e-9) + 1)::BIGINT], lambda e: e.x)) AS token FROM s),
c AS (SELECT DISTINCT a.p AS a, b.p AS b FROM x a JOIN x b ON a.token = b.token AND a.p < b.p AND a.n >= {SIMILARITY} * b.n AND b.n >= {SIMILARITY} * a.n),
v AS (SELECT DISTINCT b.p FROM c JOIN s a ON a.p = c.a JOIN s b ON b.p = c.b WHERE len(list_intersect(a.w, b.w)) >= {SIMILARITY} * (a.n + b.n - len(list_intersect(a.w, b.w))) - 1e-9),
g AS (SELECT u.key, u.i FROM u JOIN s ON s.w = u.w WHERE u.p > s.p OR s.p IN (SELECT p FROM v)),
r AS (SELECT t.key, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY t.i) FILTER (g.i IS NULL), '') AS text FROM t LEFT JOIN g ON g.key = t.key AND g.i = t.i GROUP BY t.key)
SELECT d.doc_id, n_lines, n_removed, r.text FROM d JOIN r ON r.key = d.key
"""
