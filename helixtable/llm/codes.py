"""Vector code compression: product codes whose nearest entries are found by equal-average search.

Each component x becomes floor(4096 x). A vector is cut into PARTS equal consecutive parts; each part position has a
codebook of ENTRIES at most, which starts as that part of the smallest ids. A round assigns every part to its nearest
entry and replaces each entry by its parts' componentwise floor(sum / count); an entry without parts stays.

Equal-average search: the entries of a codebook are sorted by the sum of their components. From the place of a part's
own sum the search goes outward, always to the entry of the smaller gap, and ends where the squared gap over the
dimension of a part strictly exceeds the best squared distance: by Cauchy-Schwarz nothing further is as near. At equal
distances the lower index wins, so entries that tie are still visited.

A round is one pass over the written integers: each task adds up what it read, so PARTS x ENTRIES sums leave a task
and as many reach the driver, whatever the input. The error of a label is a sum with partial sums.

Defined cases: a null vector, or one with a null or non-finite component, is dropped, and so is one whose length is
not that of the smallest kept id (that length must be a positive multiple of PARTS: vectors of other lengths never
count as kept); components beyond 2^28 after scaling are held at that; a null id sorts last; rows of equal ids are rows
of their own, in the order of their components; fewer than ENTRIES rows give as many entries; null labels are summed
together; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixtable.llm.common import forget, written

SCALE, PARTS, ENTRIES, ROUNDS, MOST = 4096, 8, 16, 6, 1 << 28


def sound(column: str = "embedding") -> Column:
    """Whether a vector is there and all its components are finite."""
    return F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scaled(column: str, scale: int, most: int) -> Column:
    """Integers floor(scale x), held between -most and most."""
    return F.transform(column, lambda x: F.floor(F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), x.cast("double") * scale))).cast("long"))


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of parts the index of its nearest row of book, and the squared distance. Equal-average search."""
    n, width = parts.shape
    order = np.argsort(book.sum(axis=1), kind="stable")
    entries, sums, own = book[order], book.sum(axis=1)[order], parts.sum(axis=1)
    high = np.searchsorted(sums, own)
    low = high - 1
    best, at = np.full(n, np.iinfo(np.int64).max), np.full(n, len(book))
    far = np.iinfo(np.int64).max
    alive = np.arange(n)
    while len(alive):
        s, lo, hi = own[alive], low[alive], high[alive]
        below = np.where(lo >= 0, s - sums[np.maximum(lo, 0)], far)
        above = np.where(hi < len(sums), sums[np.minimum(hi, len(sums) - 1)] - s, far)
        down = below <= above
        gap = np.minimum(below, above)
        # a missing entry has no gap; the hair above the best covers rounding, and only ever visits one entry more
        go = (gap < far) & (np.where(gap < far, gap, 0).astype(float) ** 2 / width <= best[alive].astype(float) * (1 + 1e-12))
        alive, down, lo, hi = alive[go], down[go], lo[go], hi[go]
        pick = np.where(down, lo, hi)
        low[alive] -= down
        high[alive] += ~down
        diff = parts[alive] - entries[pick]
        d, index = np.einsum("ij,ij->i", diff, diff), order[pick]
        better = (d < best[alive]) | ((d == best[alive]) & (index < at[alive]))
        best[alive[better]], at[alive[better]] = d[better], index[better]
    return at, best


def stacked(frame: pd.DataFrame) -> np.ndarray:
    """Rows x PARTS x width."""
    x = np.stack(frame["v"].to_numpy()).astype(np.int64)
    return x.reshape(len(x), PARTS, -1)


def moved(books: np.ndarray, rows: list) -> np.ndarray:
    """books with each entry that has parts at the floor of their mean."""
    books = books.copy()
    for r in rows:
        books[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    return books


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    kinds = dict(vectors.dtypes)
    fine = vectors.where(sound()).where((F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0))
    kept = written(fine.select("vec_id", "label", scaled("embedding", SCALE, MOST).alias("v")), "vector-parts")
    schema = f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string"
    by_id = (F.col("vec_id").asc_nulls_last(), F.col("v"))
    first = kept.orderBy(*by_id).limit(1).collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], schema)
    alike = kept.where(F.size("v") == len(first[0]["v"]))
    start = [r["v"] for r in alike.orderBy(*by_id).limit(ENTRIES).collect()]
    books = np.array(start, dtype=np.int64).reshape(len(start), PARTS, -1).transpose(1, 0, 2)  # part, entry, position

    for _ in range(rounds):
        rows = alike.mapInPandas(_summed(books), "part int, entry int, n long, sums array<long>")
        adds = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(books.shape[2])]
        total = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *adds)
        books = moved(books, total.select("part", "entry", "n", F.array(*[f"s{i}" for i in range(books.shape[2])]).alias("sums")).collect())

    coded = written(alike.mapInPandas(_coded(books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "vector-codes")
    per_label = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "label_"), "label-errors")
    forget(kept)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = coded.join(per_label, F.col("label").eqNullSafe(F.col("label_")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _summed(books: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums = np.zeros(books.shape[:2], dtype=np.int64), np.zeros_like(books)
        for f in frames:
            if len(f):
                x = stacked(f)
                for p, book in enumerate(books):
                    at, _ = nearest(x[:, p], book)
                    counts[p] += np.bincount(at, minlength=len(book))
                    np.add.at(sums[p], at, x[:, p])
        part, entry = np.nonzero(counts)
        yield pd.DataFrame({"part": part.astype(np.int32), "entry": entry.astype(np.int32), "n": counts[part, entry], "sums": list(sums[part, entry])})

    return run


def _coded(books: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = stacked(f)
                found = [nearest(x[:, p], book) for p, book in enumerate(books)]
                code = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
                error = np.sum([d for _, d in found], axis=0)
                yield f[["vec_id", "label"]].assign(code=[c.tobytes().hex() for c in code], error=error)

    return run


def _oracle() -> str:
    """The same in SQL: the rounds are unrolled, each assigns by a full comparison with all entries."""
    book = lambda i: f"""
c{i} AS MATERIALIZED (
    SELECT o.part, o.entry, coalesce(m.e, o.e) AS e FROM c{i - 1} o LEFT JOIN (
        SELECT part, entry, list(f ORDER BY pos) AS e FROM (
            SELECT part, entry, pos, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS f
            FROM (SELECT part, entry, unnest(p) AS x, unnest(range(1, len(p) + 1)) AS pos FROM a{i - 1}) GROUP BY part, entry, pos
        ) GROUP BY part, entry
    ) m ON m.part = o.part AND m.entry = o.entry
)"""  # noqa: E731
    near = lambda i: f"""
a{i} AS MATERIALIZED (
    SELECT vec_id, label, part, p, split_part(s, ' ', 2)::INT AS entry, split_part(s, ' ', 1)::BIGINT AS d FROM (
        SELECT vec_id, label, part, p, min(d * 100 + entry) // 100 || ' ' || min(d * 100 + entry) % 100 AS s FROM (
            SELECT vec_id, label, r.part, p, c.entry, list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - e[i]) * (p[i] - e[i])))::BIGINT AS d
            FROM r JOIN c{i} c ON c.part = r.part
        ) GROUP BY vec_id, label, part, p
    )
)"""  # noqa: E731
    steps = ",".join(book(i) + "," + near(i) if i else near(0) for i in range(ROUNDS + 1))
    return f"""
WITH k AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
r AS MATERIALIZED (SELECT vec_id, label, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS p FROM k, range({PARTS}) t(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, p::HUGEINT[] AS e FROM r QUALIFY entry < {ENTRIES}),
{steps},
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS}),
f AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f, h
"""


ORACLE_SQL = _oracle()
