"""Embedding near-dedup with randomised-rotation binary codes.

Each unit vector is turned by a seeded random rotation; its code is the signs of what comes out, and its stored
correction factor is the inner product of the vector with its code's unit vector. For a code c with factor f and a
turned vector q, <c, q> / f estimates the inner product without bias, and
    f <c, q> + sqrt((1 - f^2) (1 - <c, q>^2))
bounds it from above with certainty (the part of the vector that its code doesn't show can't be longer). Pairs whose
bound reaches the threshold are computed again, exactly, in double precision; so no link is lost and none is false.

Equal vectors of a label are one class, compared once. Classes are ordered by the nearest of PIVOTS pivots (fitted on a
bounded sample of SAMPLE classes) and cut into tiles of BLOCK; a pair of tiles is compared unless the triangle
inequality on their centres and radii rules every link out. So no task holds more than two tiles, whatever the size
of a label or a group of copies. Where vectors have no clusters no tile can be ruled out, and exactness costs all
pairs of tiles of a label.

Defined cases: null, zero and non-finite vectors and those with null parts link with nothing, as do rows whose label
is null and vectors of different lengths; repeated rows are vectors of their own, linked like any other; a null vec_id
takes part and is nobody's component name; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixtable.llm.common import components, ranked, written
from helixtable.llm.simhash import forest

THRESHOLD, SAMPLE, PIVOTS, BLOCK, SEED = 0.93, 4096, 64, 1024, 42


def rotation(dimension: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turned vectors, their codes as unit vectors, and the correction factors."""
    turned = unit @ turn
    signs = np.where(turned >= 0, 1.0, -1.0) / np.sqrt(unit.shape[1])
    return turned, signs, np.minimum(1.0, np.einsum("ij,ij->i", turned, signs))


def estimate(signs: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of the coded vectors (rows) with the turned ones (columns)."""
    return (signs @ turned.T) / factor[:, None]


def close(x: np.ndarray, y: np.ndarray, turn: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of x and y with cosine of at least the threshold."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    _, signs, f = codes(x / nx[:, None], turn)
    turned, _, _ = codes(y / ny[:, None], turn)
    t = estimate(signs, f, turned) * f[:, None]
    bound = f[:, None] * t + np.sqrt(1 - f**2)[:, None] * np.sqrt(np.maximum(0.0, 1 - t * t))
    i, j = np.nonzero(bound >= threshold - 1e-9)
    exact = np.empty(len(i))
    for k in range(0, len(i), 1 << 16):
        a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        exact[k : k + (1 << 16)] = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b])
    keep = exact >= threshold
    return i[keep], j[keep]


def fitted(sample: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """n unit pivots at most: sampled vectors, moved thrice to the mean of those nearest to them."""
    rng = np.random.default_rng(seed)
    pivots = sample[rng.permutation(len(sample))[:n]]
    for _ in range(3):
        near = (sample @ pivots.T).argmax(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), pivots)
    return pivots


def edges(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows reaches by the links (i, j)."""
    return forest(n, iter([(i, j)]))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fine = fine & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    content = F.sha2(F.array_join(F.transform("embedding", lambda x: (x + F.lit(0.0)).cast("string")), ","), 256)
    rows = vectors.select("vec_id", "label", F.when(fine, content).alias("content"), F.when(fine, F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    classes = rows.where("content IS NOT NULL").groupBy("label", "content").agg(F.count("*").alias("w"), F.min("vec_id").alias("rep"), F.min("uid").alias("uid"))
    classes = written(classes, "classes")
    members = rows.select("uid", "v").join(classes.select("uid", "label", "w"), "uid").withColumn("n", F.size("v")).withColumn("hash", F.xxhash64(F.lit(SEED), "uid"))

    by_length: dict[int, np.ndarray] = {}
    for r in members.orderBy("hash").limit(SAMPLE).select("v").collect():  # bounded: SAMPLE vectors
        by_length.setdefault(len(r["v"]), []).append(r["v"])
    pivots = {}
    for n, vs in by_length.items():
        x = np.array(vs)
        pivots[n] = fitted(x / np.linalg.norm(x, axis=1)[:, None], PIVOTS)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            home = np.zeros(len(f), dtype=np.int64)
            for n, p in pivots.items():
                at = np.flatnonzero(f["n"] == n)
                if len(at):
                    x = np.stack(f["v"].to_numpy()[at])
                    home[at] = (x @ p.T).argmax(axis=1)
            yield f[["uid", "label", "n", "w", "hash", "v"]].assign(home=home)

    kind = dict(vectors.dtypes)["label"]
    placed = members.mapInPandas(place, f"uid long, label {kind}, n int, w long, hash long, v array<double>, home long")
    placed = placed.withColumn("by", F.shiftleft("home", 57).bitwiseOR(F.shiftrightunsigned("hash", 7)))
    tiled = ranked(placed, ["label", "n"], "by").withColumn("tile", F.floor(F.col("rank_") / BLOCK)).select("label", "n", "tile", "uid", "w", "v")
    tiled = written(tiled, "tiles")

    def summary(f: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(f["v"].to_numpy())
        x = x / np.linalg.norm(x, axis=1)[:, None]
        c = x.sum(axis=0)
        c = c / np.linalg.norm(c) if np.linalg.norm(c) > 1e-12 else x[0]
        radius = float(np.arccos(np.clip(x @ c, -1, 1)).max())
        return pd.DataFrame({"label": [f["label"].iloc[0]], "n": [f["n"].iloc[0]], "tile": [f["tile"].iloc[0]], "centre": [c], "radius": [radius]})

    tiles = written(tiled.groupBy("label", "n", "tile").applyInPandas(summary, f"label {kind}, n int, tile long, centre array<double>, radius double"), "centres")
    a, b = (tiles.select("label", "n", *[F.col(c).alias(f"{c}_{s}") for c in ("tile", "centre", "radius")]) for s in "ab")
    cosine = F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))
    pairs = a.join(b, ["label", "n"]).where("tile_a <= tile_b").where(angle - F.col("radius_a") - F.col("radius_b") <= float(np.arccos(threshold)) + 1e-6)
    pairs = written(pairs.select("label", "n", "tile_a", "tile_b"), "tile-pairs")
    visits = pairs.select("label", "n", F.col("tile_a").alias("tile"), "tile_a", "tile_b").union(pairs.where("tile_a < tile_b").select("label", "n", F.col("tile_b").alias("tile"), "tile_a", "tile_b"))

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        x, w, uid = np.stack(f["v"].to_numpy()), f["w"].to_numpy(), f["uid"].to_numpy()
        first = (f["tile"] == f["tile_a"]).to_numpy()
        own = bool((f["tile_a"] == f["tile_b"]).iloc[0])
        p = np.flatnonzero(first)
        q = p if own else np.flatnonzero(~first)
        i, j = close(x[p], x[q], rotation(x.shape[1]), threshold)
        i, j = p[i], q[j]
        if own:  # both orders are there
            i, j = i[i < j], j[i < j]
        links = np.zeros(len(f), dtype=np.int64)
        np.add.at(links, i, w[j])
        np.add.at(links, j, w[i])
        root = edges(len(f), i, j)
        some = np.flatnonzero(links)
        return pd.DataFrame({"uid": uid[some], "links": links[some], "root": uid[root[some]]})

    found = tiled.join(visits, ["label", "n", "tile"]).groupBy("label", "n", "tile_a", "tile_b").applyInPandas(compare, "uid long, links long, root long")
    found = written(found, "links")
    counts = found.groupBy("uid").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "uid")
    labelled = classes.select("uid", "label", "content", "w", "rep").join(counts, "uid", "left").join(named, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    per_class = written(labelled.join(least, "component").select("label", "content", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id"), "per-class")
    out = rows.select("vec_id", "label", "content").join(per_class, ["label", "content"], "left")
    component = F.when(F.col("content").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN (SELECT a, count(*) AS k FROM l GROUP BY a) x ON x.a = vec_id
"""
