"""SimHash near-dedup with a Gray-order hierarchical index.

A fingerprint bit is 1 if over half of a text's shingle hashes have it. Links are pairs of fingerprints that differ in
at most `radius` bits. Of radius + 1 blocks of bits two linked fingerprints share one, so each distinct fingerprint is
dealt once by each block's value. Within a block's value, fingerprints are sorted by Gray rank; equal leading bits
then stand together and form the nodes of a tree whose upper nodes hold the bits that a whole group shares. Pairs of
nodes are followed downwards with the differences accumulated so far, and a pair of groups that exceeds the radius
goes as a whole. Each task reports a spanning forest of its links, so a dense group costs its members, not its pairs.

Defined cases: a null text is an empty one, and texts without words have fingerprint zero, linked like any other; a
null doc_id takes part but is no component's name unless there is no other; repeated rows each get their component; an
empty table gives an empty result; columns of other names are ignored by `near_duplicates` and kept by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixtable.llm.common import components, forget, kept_by, marked, nested, small_batches, text_of, written

SHINGLE, RADIUS, BITS, SEED = 3, 2, 64, 42
SIMILARITY, BANDS, ROWS = 0.8, 24, 4
LEVEL, FLUSH, PAIRS = 8, 1 << 16, 1 << 21  # bits of a tree level; hashes counted at once; pairs of nodes held at once


def shingle_hashes(text: str, width: int = SHINGLE) -> list[int]:
    """XXH64 (seed 42) of every run of `width` words, repeats included; of all words where there are fewer; none for none."""
    words = text.encode().lower().split()  # bytes: ASCII letters and the six ASCII white-space characters only
    if not words:
        return []
    line, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(line, SEED)]
    return [digest(line[s : e - 1], SEED) for s, e in zip([0, *ends], ends[width - 1 :], strict=False)]


def majority(hashes: list[np.ndarray]) -> list[int]:
    """The fingerprint, as signed 64-bit, of each array of hashes."""
    sizes = np.array([len(h) for h in hashes])
    out = np.zeros(len(hashes), dtype=np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        flat = np.concatenate([hashes[i] for i in some])
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(sizes[some])[:-1]]), axis=0, dtype=np.int32)
        packed = np.packbits(2 * counts > sizes[some][:, None], axis=1, bitorder="little")
        out[some] = packed.view(np.int64)[:, 0]
    return out.tolist()


def fingerprint(text: Column, width: int = SHINGLE) -> Column:
    """The fingerprint, as a signed 64-bit number, of a text without nulls."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out, held, n = [], [], 0
            for t in texts:
                h = np.array(shingle_hashes(t, width), dtype=np.uint64)
                held.append(h)
                n += len(h)
                if n >= FLUSH:
                    out += majority(held)
                    held, n = [], 0
            yield pd.Series(out + majority(held), dtype=np.int64)

    return F.pandas_udf(run, "long", F.PandasUDFType.SCALAR_ITER)(text)


def gray_rank(x: Column) -> Column:
    """The place of x, as an unsigned number, in Gray order: each bit of the rank is the parity of x's bits from the top."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x


def popcounts() -> np.ndarray:
    return np.array([bin(i).count("1") for i in range(1 << LEVEL)], dtype=np.uint8)


def tree_links(group: np.ndarray, code: np.ndarray, radius: int, depth: int = BITS // LEVEL) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of rows of one group whose codes differ in at most radius bits; rows are sorted by group and Gray rank, codes distinct within a group."""
    ones = popcounts()
    fresh = np.concatenate([[True], group[1:] != group[:-1]])
    starts = [np.flatnonzero(fresh)]
    for level in range(1, depth + 1):
        prefix = code >> np.uint64(BITS - LEVEL * level)
        fresh = fresh | np.concatenate([[True], prefix[1:] != prefix[:-1]])
        starts.append(np.flatnonzero(fresh))
    ends = [np.append(s[1:], len(code)) for s in starts]
    many = np.flatnonzero(ends[0] - starts[0] > 1)
    stack = [(0, part, part, np.zeros(len(part), dtype=np.uint8)) for part in np.array_split(many, max(1, len(many) // 65536))]
    while stack:
        level, a, b, d = stack.pop()
        if not len(a):
            continue
        if level == depth:
            keep = a != b
            yield starts[level][a[keep]], starts[level][b[keep]]
            continue
        first = np.searchsorted(starts[level + 1], starts[level])
        last = np.append(first[1:], len(starts[level + 1]))
        na, nb = (last - first)[a], (last - first)[b]
        upto = np.cumsum(na * nb)
        if upto[-1] > PAIRS and len(a) > 1:  # halve until the pairs of children fit
            cut = len(a) // 2
            stack += [(level, a[:cut], b[:cut], d[:cut]), (level, a[cut:], b[cut:], d[cut:])]
            continue
        which = np.repeat(np.arange(len(a)), na * nb)
        at = np.arange(upto[-1]) - np.repeat(upto - na * nb, na * nb)
        x, y = first[a][which] + at // nb[which], first[b][which] + at % nb[which]
        seen = (code[starts[level + 1]] >> np.uint64(BITS - LEVEL * (level + 1))) & np.uint64((1 << LEVEL) - 1)
        total = d[which] + ones[seen[x] ^ seen[y]]
        size = ends[level + 1] - starts[level + 1]
        keep = (total <= radius) & (x <= y) & ((x != y) | (size[x] > 1))
        stack.append((level + 1, x[keep], y[keep], total[keep]))


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row that each of n rows reaches."""
    root = np.arange(n)
    for a, b in links:
        while True:
            ra, rb = root[a], root[b]
            low = np.minimum(ra, rb)
            if (ra == rb).all():
                break
            np.minimum.at(root, ra, low)
            np.minimum.at(root, rb, low)
            while (root[root] != root).any():
                root = root[root]
    return root


def _linked(radius: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def edges(f: pd.DataFrame) -> pd.DataFrame:
            if len(f) < 2:
                return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
            group = np.cumsum(np.concatenate([[True], (np.diff(f["route"]) != 0) | (np.diff(f["block"]) != 0)]))
            root = forest(len(f), tree_links(group, f["code"].to_numpy().astype(np.uint64), radius))
            fp, own = f["fp"].to_numpy(), root != np.arange(len(f))
            return pd.DataFrame({"a": fp[own], "b": fp[root[own]]})

        held = None
        for f in frames:
            held = f if held is None else pd.concat([held, f], ignore_index=True)
            if not len(held):
                continue
            last = (held["route"] == held["route"].iloc[-1]) & (held["block"] == held["block"].iloc[-1])
            done = held[~last]
            if len(done):
                yield edges(done)
                held = held[last].reset_index(drop=True)
        if held is not None and len(held):
            yield edges(held)

    return run


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect just the distinct fingerprints (column fp) which links of at most radius bits (1 at least) connect."""
    bounds = [BITS * i // (radius + 1) for i in range(radius + 2)]
    routes = []
    for r, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        block = F.shiftright("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        # the code, turned so that the block stands lowest: the tree starts with the bits that may differ
        if low == 0:
            code = F.shiftleft(F.shiftrightunsigned("fp", high), high)
        elif high < BITS:
            code = F.shiftleft("fp", BITS - low).bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", high), high - low))
        else:
            code = F.shiftleft("fp", BITS - low)
        routes.append(F.struct(F.lit(r).alias("route"), block.alias("block"), code.alias("code")))
    dealt = fps.select("fp", F.explode(F.array(*routes)).alias("x")).select("fp", "x.*")
    dealt = dealt.repartition("route", "block").sortWithinPartitions("route", "block", gray_rank(F.col("code")))
    return dealt.mapInPandas(_linked(radius), "a long, b long")


def classes(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, component_id of rows (doc_id, fp): the smallest doc_id of the fingerprints that links reach from fp."""
    reps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    found = components(links(reps.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = reps.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return written(named.join(least, "component").select("fp", "component_id"), "classes")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    small_batches(docs.sparkSession)
    rows = written(docs.select("doc_id", fingerprint(text_of(), width).alias("fp")), "simhash")
    return rows.join(classes(rows, radius), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def sketch(hashes: np.ndarray, factors: np.ndarray) -> tuple[int, int, int, list[int]]:
    """128 bits that name a set of hashes, its size, and a number for each band of ROWS least values under the factors."""
    with np.errstate(over="ignore"):
        mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        named = np.array([hashes.sum(dtype=np.uint64), (mixed ^ (mixed >> np.uint64(32))).sum(dtype=np.uint64)], dtype=np.uint64).view(np.int64).tolist()
        if not len(hashes):
            return *named, 0, []
        least = np.full(len(factors), np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in range(0, len(hashes), 1024):
            np.minimum(least, (hashes[at : at + 1024, None] * factors).min(axis=0), out=least)
        bands = np.arange(1, BANDS + 1, dtype=np.uint64)
        for r in least.reshape(BANDS, ROWS).T:
            bands = (bands ^ r) * np.uint64(0x9E3779B97F4A7C15)
            bands ^= bands >> np.uint64(31)
    return *named, len(hashes), bands.view(np.int64).tolist()


def sketched(text: Column, width: int) -> Column:
    """s1, s2, n, bands of the set of shingles of a text without nulls."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        factors = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for texts in batches:
            yield pd.DataFrame([sketch(np.unique(np.array(shingle_hashes(t, width), dtype=np.uint64)), factors) for t in texts], columns=["s1", "s2", "n", "bands"])

    return F.pandas_udf(run, "s1 long, s2 long, n long, bands array<long>", F.PandasUDFType.SCALAR_ITER)(text)


def shingle_set(text: Column, width: int) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.unique(np.array(shingle_hashes(t, width), dtype=np.uint64)).view(np.int64) for t in texts], dtype=object)

    return F.pandas_udf(run, "array<long>", F.PandasUDFType.SCALAR_ITER)(text)


def similar(pairs: DataFrame, sets: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets, read again from the texts, have a Jaccard similarity of at least `similarity`."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    needed = written(sets.select("id", "at.*").join(ids, "id"), "simhash-needs")
    texts = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64(text_of()).alias("tie"), text_of().alias("text"))
    again = kept_by(texts, "key", marked(needed, "key")).join(needed, ["key", "tie"]).dropDuplicates(["id"])
    again = written(again.select("id", shingle_set(F.col("text"), width).alias("t")), "simhash-sets")
    same = F.size(F.array_intersect("t_a", "t_b"))
    both = pairs.join(again.select(F.col("id").alias("a"), F.col("t").alias("t_a")), "a").join(again.select(F.col("id").alias("b"), F.col("t").alias("t_b")), "b")
    out = written(both.where(same >= F.lit(similarity) * (F.size("t_a") + F.size("t_b") - same) - 1e-9).select("a", "b"), "simhash-edges")
    forget(needed, again)
    return out


def linked_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the sets (id, s1, s2) of rows (s1, s2, fp) whose fingerprints the tree connects."""
    found = components(links(rows.select("fp").distinct())).withColumnRenamed("node", "fp")
    named = rows.select("s1", "s2", "fp").distinct().join(found, "fp", "left").join(sets.select("id", "s1", "s2"), ["s1", "s2"])
    named = written(named.select(F.coalesce("component", "fp").alias("group"), "id").distinct(), "simhash-groups")
    heads = named.groupBy("group").agg(F.min("id").alias("a"), F.count("*").alias("size")).where("size > 1")
    out = written(named.join(heads, "group").where("id > a").select("a", F.col("id").alias("b")).distinct(), "simhash-near")
    forget(named)
    return out


def deduplicated(docs: DataFrame, width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near-duplicates, the one of the smallest doc_id (null first, then by text hash).

    Links are pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Candidates are what
    the tree of fingerprints connects (RADIUS bits), each held against the first of its group; fingerprints of 64 bits do
    not reach as far as 0.8, where two differ in some nine bits, so further candidates are pairs of sets that agree in one
    of BANDS bands of ROWS minimum hashes (all but (1 - 0.8^4)^24, some 3 in a million pairs, at 0.8; fewer above), and
    each is verified on its whole sets. Equal sets are one. Sets are first held against the first set of each of
    their bands, which settles groups of near copies at the cost of their members; then all pairs of a band that this
    did not connect.
    """
    small_batches(docs.sparkSession)
    key, tie = F.coalesce("doc_id", F.lit(-(1 << 63))), F.xxhash64(text_of())
    rows = docs.select(F.struct(key.alias("key"), tie.alias("tie")).alias("at"), sketched(text_of(), width).alias("x"), fingerprint(text_of()).alias("fp")).select("at", "x.*", "fp")
    rows = written(rows, "simhash")
    sets = rows.groupBy("s1", "s2").agg(F.min(F.struct("at", "n", "bands")).alias("x")).select("s1", "s2", "x.*")
    sets = written(sets.withColumn("id", F.monotonically_increasing_id()), "simhash-sets")
    banded = written(sets.select("id", "n", F.explode("bands").alias("band")), "simhash-bands")
    fits = lambda a, b: F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - 1e-9
    heads = banded.groupBy("band").agg(F.min(F.struct("id", "n")).alias("head"), F.count("*").alias("size")).where("size > 1")
    star = banded.join(heads, "band").where(F.col("id") > F.col("head.id")).where(fits(F.col("n"), F.col("head.n")))
    star = star.select(F.col("head.id").alias("a"), F.col("id").alias("b")).union(linked_sets(rows, sets))
    star = written(star.distinct(), "simhash-pairs")
    edges = similar(star, sets, docs, width, similarity)
    placed = banded.join(components(edges).withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = written(placed, "simhash-placed")
    mixed = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    open_ = placed.join(mixed, "band")
    a, b = (open_.select("band", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "component")]) for x in "ab")
    rest = a.join(b, "band").where("component_a < component_b").where(fits(F.col("n_a"), F.col("n_b"))).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    rest = written(rest.distinct().join(star, ["a", "b"], "left_anti"), "simhash-pairs")
    found = components(edges.union(similar(rest, sets, docs, width, similarity))).withColumnRenamed("node", "id")
    least = sets.select("id", "at").join(found, "id", "left").groupBy(F.coalesce("component", "id").alias("component")).agg(F.min("at").alias("at"))
    keep = written(least.select("at.*"), "kept")
    forget(rows, banded, placed, star, rest)
    out = nested(docs, key=key, tie=tie).join(keep, ["key", "tie"], "left_semi").dropDuplicates(["key", "tie"])
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
