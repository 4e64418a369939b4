"""Toxicity: a convolutional text classifier in numpy with thresholds calibrated by language.

A word's embedding is the sum of three rows of hashed tables, two for the word (words are confused only if both hashes
agree) and one for its first PREFIX letters, so forms of one stem are alike.
Filters of several widths run over the words of a text, each filter keeps its largest response over the whole text,
and a logistic layer weighs them. Filters of WIDTHS have weights of their own for each place, those of WIDE the same for
all, so they respond to how many telling words stand near to each other. Training, in one task, uses a bounded sample of labelled rows (POSITIVE and NEGATIVE, those of
the smallest hashes; HELD_BACK of all rows, by hash, are kept out of it). All labelled rows that are neither held out nor
trained on choose, for each language guessed from the text's own function words, the logit above which a text is toxic:
counts by language, bin of the logit and label have the least error there: missed toxic rows, and FALSE times the clean
rows that are not left alone, each as a share. A language's
counts are joined by those of all languages, scaled to SHRINK positive rows, so its cut moves from the common one to its
own as its labels grow. Scores are shifted so that this logit is always scored THRESHOLD.

Defined cases: a null text is an empty one, and an empty text is scored by the bias alone; null and repeated doc_ids
stay; a document labelled more than once is toxic if any label says so, null labels don't count; without labels of
both kinds every score is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixtable.llm.common import forget, nested, small_batches, text_of, written

POSITIVE, NEGATIVE, HELD_BACK, THRESHOLD, SEED, SHRINK, BINS, FALSE = 2000, 4000, 0.3, 0.7, 42, 30, 64, 4
BUCKETS, DIMENSION, WIDTHS, FILTERS, EPOCHS, STEPS, BATCH, RATE, PREFIX = 1 << 17, 8, (1, 2, 3), 8, 6, 400, 64, 0.05, 4
WIDE, WIDE_FILTERS = (32, 128), 4
KEPT = 1 << 16  # words whose hashes a batch function remembers
PAD = BUCKETS  # the row of zeros
# Frequent function words by language.
LANGUAGES = {
    "en": "the of and to in is that it for was on are with as his they be at this from have or by",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "le les et est une du dans pour sur pas au plus ne ce avec il elle sont ou",
    "es": "el los y del las por con para una al lo como más pero sus no se que",
}
EDGES = ".,;:!?…\"'()[]{}«»“”„*#$%&_-"


class Words:
    """Words by number, with their three buckets and one-hot language."""

    def __init__(self) -> None:
        self.marks = {w: k for k, v in reversed(list(enumerate(LANGUAGES.values()))) for w in v.split()}
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.buckets: list[tuple[int, int, int]] = [(PAD, PAD, PAD)]
        self.languages: list[int] = [len(LANGUAGES)]

    def look(self, word: str) -> int:
        lower = word.lower().strip(EDGES)
        b = lower.encode()
        h = zlib.crc32(b)
        self.buckets.append((h % BUCKETS, (h ^ zlib.crc32(b, 1) * 2654435761) >> 9 & (BUCKETS - 1), zlib.crc32(lower[:PREFIX].encode(), 7) % BUCKETS) if b else (PAD, PAD, PAD))
        self.languages.append(self.marks.get(lower, len(LANGUAGES)))
        self.known[word] = n = len(self.buckets) - 1
        return n

    def arrays(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Buckets (m, 3) of the m words met; the texts as numbers of words, each ended by padding for the widest filter; starts; language by index, -1 for none."""
        if len(self.known) > KEPT:
            self.clear()
        known, look = self.known, self.look
        flat: list[int] = []
        starts, pad = [], [0] * max(WIDTHS)
        for text in texts:
            starts.append(len(flat))
            flat += [known[w] if w in known else look(w) for w in text.split()]
            flat += pad
        numbers, starts = np.array(flat, dtype=np.int32), np.array(starts, dtype=np.int64)
        used, numbers = np.unique(numbers, return_inverse=True)
        hot = np.eye(len(LANGUAGES) + 1, dtype=np.int32)[np.array([self.languages[i] for i in used])]
        counts = np.add.reduceat(hot[numbers], starts, axis=0)[:, :-1]
        languages = np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), -1)
        return np.array([self.buckets[i] for i in used], dtype=np.int64), numbers, starts, languages


@dataclass
class Model:
    tables: np.ndarray  # (3, BUCKETS + 1, DIMENSION)
    filters: list[np.ndarray]  # by width: (width, DIMENSION, FILTERS)
    bias: np.ndarray
    weights: np.ndarray
    intercept: float
    wide: list[np.ndarray] = field(default_factory=list)  # by width: (DIMENSION, WIDE_FILTERS)

    def embedded(self, buckets: np.ndarray) -> np.ndarray:
        return self.tables[0][buckets[..., 0]] + self.tables[1][buckets[..., 1]] + self.tables[2][buckets[..., 2]]

    def responses(self, x: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """For each width, the responses of its filters at every word (row of x)."""
        n = len(x)
        for w, f in zip(WIDTHS, self.filters, strict=True):
            r = x @ f[0]
            for k in range(1, w):
                r[: n - k] += (x @ f[k])[k:]
            yield r
        for w, f in zip(WIDE, self.wide, strict=True):
            upto = np.concatenate([np.zeros((1, f.shape[1])), np.cumsum(x @ f, axis=0, dtype=np.float64)])
            yield (upto[stops(starts, n, w)] - upto[:-1]).astype(np.float32)

    def logits(self, buckets: np.ndarray, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        x = self.embedded(buckets)[numbers]
        best = np.concatenate([np.maximum.reduceat(r, starts, axis=0) for r in self.responses(x, starts)], axis=1)
        return np.maximum(best + self.bias, 0) @ self.weights + self.intercept


def stops(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """For each of n words the end of the window that starts there; a window ends with its text."""
    sizes = np.diff(np.append(starts, n))
    return np.minimum(np.arange(n) + width, np.repeat(starts + sizes, sizes))


def trained(texts: list[str], toxic: np.ndarray, seed: int = SEED) -> Model | None:
    """A model from labelled texts; None without both labels."""
    if len(set(toxic.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    tables = small(3, BUCKETS + 1, DIMENSION) * 0.1
    tables[:, PAD] = 0
    n_filters = FILTERS * len(WIDTHS) + WIDE_FILTERS * len(WIDE)
    m = Model(tables, [small(w, DIMENSION, FILTERS) * 5 for w in WIDTHS], np.zeros(n_filters, np.float32), np.abs(small(n_filters)) * 5, 0.0, [small(DIMENSION, WIDE_FILTERS) * 5 for _ in WIDE])
    squares = {"tables": np.full_like(tables, 1e-3)}

    def adapt(name: str, value: np.ndarray, grad: np.ndarray) -> None:
        """Adagrad."""
        g = squares.setdefault(name, np.full_like(value, 1e-3))
        g += grad * grad
        value -= RATE * grad / np.sqrt(g)

    def adapt_rows(k: int, rows: np.ndarray, grads: np.ndarray) -> None:
        """Adagrad on the rows of one table, each once."""
        used, inverse = np.unique(rows, return_inverse=True)
        total = np.stack([np.bincount(inverse, grads[:, d], len(used)) for d in range(DIMENSION)], axis=1).astype(np.float32)
        real = (used != PAD) & (np.abs(total).sum(axis=1) > 0)
        rows, total = used[real], total[real]
        squares["tables"][k, rows] += total * total
        tables[k, rows] -= RATE * total / np.sqrt(squares["tables"][k, rows])

    words, train = Words(), np.arange(len(texts))
    share = toxic[train].mean()
    balance = np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(train)))):
        order = rng.permutation(train)
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            buckets, numbers, starts, _ = words.arrays([texts[i] for i in some])
            x = m.embedded(buckets)[numbers]
            found = list(m.responses(x, starts))
            best = np.concatenate([np.maximum.reduceat(r, starts, axis=0) for r in found], axis=1)
            hidden = np.maximum(best + m.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ m.weights + m.intercept, -50, 50)))
            delta = ((p - toxic[some]) * balance[some] / len(some)).astype(np.float32)
            through = (delta[:, None] * m.weights[None, :] * (hidden > 0)).astype(np.float32)
            adapt("weights", m.weights, hidden.T @ delta)
            intercept = np.array([m.intercept], np.float32)
            adapt("intercept", intercept, np.array([delta.sum()], np.float32))
            m.intercept = float(intercept[0])
            adapt("bias", m.bias, through.sum(axis=0))
            rows, grads = [], []
            ends = np.append(starts[1:], len(numbers))
            for n, w in enumerate(WIDTHS):
                t, f = through[:, n * FILTERS : (n + 1) * FILTERS], m.filters[n]
                top = np.stack([s + found[n][s:e].argmax(axis=0) for s, e in zip(starts, ends, strict=True)])  # (texts, filters)
                change = np.zeros_like(f)
                for k in range(w):
                    at_k = np.minimum(top + k, len(numbers) - 1)
                    change[k] = np.einsum("tf,tfd->df", t, x[at_k])
                    rows.append(buckets[numbers[at_k]].reshape(-1, 3))  # of (texts, filters)
                    grads.append((t[:, :, None] * f[k].T[None]).reshape(-1, DIMENSION))
                adapt(f"filters{n}", f, change)
            sums = np.concatenate([np.zeros((1, DIMENSION)), np.cumsum(x, axis=0, dtype=np.float64)])
            for n, w in enumerate(WIDE):
                first = len(WIDTHS) * FILTERS + n * WIDE_FILTERS
                t, f, r = through[:, first : first + WIDE_FILTERS], m.wide[n], found[len(WIDTHS) + n]
                top = np.stack([s + r[s:e].argmax(axis=0) for s, e in zip(starts, ends, strict=True)])
                stop = stops(starts, len(numbers), w)[top]
                each = (stop - top).ravel()
                at_k = np.repeat(top.ravel(), each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                rows.append(buckets[numbers[at_k]])
                grads.append(np.repeat((t[:, :, None] * f.T[None]).reshape(-1, DIMENSION), each, axis=0))
                adapt(f"wide{n}", f, np.einsum("tf,tfd->df", t, sums[stop] - sums[top]).astype(np.float32))
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            for k in range(3):
                adapt_rows(k, rows[:, k], grads)
    return m


def judged(m: Model, words: Words, texts: list[str], at_once: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Logits and languages of texts."""
    logits, languages = [np.zeros(0)], [np.zeros(0, dtype=np.int64)]
    for at in range(0, len(texts), at_once):
        buckets, numbers, starts, own = words.arrays(texts[at : at + at_once])
        logits.append(m.logits(buckets, numbers, starts))
        languages.append(own)
    return np.concatenate(logits), np.concatenate(languages)


def best_cut(bins: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """From weighed counts by bin: the middle of the widest gap among the cuts whose error is within 0.005 of the least.
    The error is the share of toxic rows that are missed and FALSE times the share of clean rows that are not left alone."""
    used = toxic + clean > 0
    order = np.argsort(-bins[used], kind="stable")
    low, hits, false = bins[used][order] / BINS, np.cumsum(toxic[used][order]), np.cumsum(clean[used][order])
    error = 1 - hits / hits[-1] + FALSE * false / max(false[-1], 1e-9)
    below = np.append(low[1:] + 1 / BINS, low[-1] - 1)  # the upper end of the next bin
    gaps = np.where(error <= error.min() + 0.005, low - below, -np.inf)
    i = int(gaps.argmax())
    return float((low[i] + below[i]) / 2)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def known_rows(labels: DataFrame) -> DataFrame:
    """doc_id, toxic, hash, back (whether it stays out of training) of the labelled rows that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("toxic") == 1).cast("int").alias("toxic"))
    back = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(1000)) < int(1000 * HELD_BACK)
    return known.withColumn("hash", F.xxhash64(F.lit(SEED), "doc_id")).withColumn("back", back)


def sampled(docs: DataFrame, known: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE) -> tuple[DataFrame, Column]:
    """hash, text, toxic of at most positive + negative rows to train on, and the condition that names them among the known rows."""
    for own in (~F.col("back"), F.lit(True)):  # without both labels among the others, the rows that stay back train too
        some = known.where(own & (F.col("toxic") == 1)).orderBy("hash").limit(positive).union(known.where(own & (F.col("toxic") == 0)).orderBy("hash").limit(negative))
        rows = written(docs.select("doc_id", text_of().alias("text")).join(F.broadcast(some), "doc_id").select("hash", "text", "toxic"), "toxicity-sample")
        last = {r["toxic"]: r["hash"] for r in rows.groupBy("toxic").agg(F.max("hash").alias("hash")).collect()}
        if len(last) == 2:
            break
    lowest = -(1 << 63)
    return rows, own & (F.col("hash") <= F.when(F.col("toxic") == 1, F.lit(last.get(1, lowest))).otherwise(F.lit(last.get(0, lowest))))


def fitted(rows: DataFrame) -> Model | None:
    """A model from a sample of bounded size (hash, text, toxic), trained by one task; the driver receives its arrays."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = pd.concat([pd.DataFrame({"hash": [], "text": [], "toxic": []}), *frames]).sort_values(["hash", "text"])
        model = trained(f["text"].tolist(), f["toxic"].to_numpy(dtype=np.int64))
        yield pd.DataFrame({"model": [] if model is None else [pickle.dumps(vars(model))]})

    out = rows.repartition(1).mapInPandas(run, "model binary").collect()
    return Model(**pickle.loads(out[0]["model"])) if out else None


def judgement(text: Column, model: Model | None, spark) -> Column:
    """logit and language of a text without nulls; NULL without a model. The model, some 10 MB whatever the input, is broadcast."""
    small_batches(spark)
    if model is None:
        return F.lit(None).cast("struct<logit:double,language:int>")
    shared = spark.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, words = Model(**shared.value), Words()
        for texts in batches:
            logits, languages = judged(m, words, texts.tolist())
            yield pd.DataFrame({"logit": logits.astype(np.float64), "language": languages.astype(np.int32)})
            words.clear()  # an idle worker keeps no words

    return F.pandas_udf(run, "logit double, language int", F.PandasUDFType.SCALAR_ITER)(text)


def chosen_cuts(counts: pd.DataFrame) -> dict[int, float]:
    """The cut of each language and, as -1, of all, from counts: language, bin, toxic, trained, n."""
    if counts["toxic"].nunique() < 2:
        return {-1: 0.0}
    own = counts[~counts["trained"]]
    own = own if own["toxic"].nunique() == 2 else counts
    weight = counts.groupby("toxic")["n"].sum() / own.groupby("toxic")["n"].sum()  # the true mix of labels
    bins = np.unique(own["bin"])
    table = np.zeros((len(LANGUAGES) + 1, 2, len(bins)))
    np.add.at(table, (own["language"].to_numpy() % (len(LANGUAGES) + 1), own["toxic"].to_numpy(), np.searchsorted(bins, own["bin"])), (own["n"] * own["toxic"].map(weight)).to_numpy(dtype=float))
    everything = table.sum(axis=0)
    prior = everything * (SHRINK / everything[1].sum())
    return {-1: best_cut(bins, everything[1], everything[0])} | {k: best_cut(bins, *(table[k] + prior)[::-1]) for k in range(len(LANGUAGES))}


def cuts_by(rows: DataFrame, known: DataFrame, trained_on: Column) -> dict[int, float]:
    """Cuts from all known rows. rows: doc_id, logit, language (of all documents)."""
    near = known.select("doc_id", "toxic", trained_on.alias("trained"))
    bin_ = F.floor(F.greatest(F.lit(-100.0), F.least(F.lit(100.0), F.col("logit"))) * BINS).alias("bin")
    counts = rows.join(near, "doc_id").groupBy("language", bin_, "toxic", "trained").agg(F.count("*").alias("n"))
    return chosen_cuts(counts.toPandas())  # bounded by languages and bins


def score(cuts: dict[int, float]) -> Column:
    """The score of a row with logit and language; 0 without a model."""
    cut = F.lit(cuts[-1])
    for k, v in cuts.items():
        cut = F.when(F.col("language") == k, F.lit(v)).otherwise(cut)
    shifted = F.col("logit") - cut + float(np.log(THRESHOLD / (1 - THRESHOLD)))
    return F.when(F.col("logit").isNull(), 0.0).otherwise(1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), shifted)))))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    known = written(known_rows(labels), "labels")
    sample, trained_on = sampled(docs, known)
    model = fitted(sample)
    rows = written(docs.select("doc_id", judgement(text_of(), model, docs.sparkSession).alias("x")).select("doc_id", "x.*"), "logits")
    rows = rows.select("doc_id", held_out().alias("held_out"), score(cuts_by(rows, known, trained_on) if model else {-1: 0.0}).alias("score"))
    forget(known, sample)
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    known = written(known_rows(labels), "labels")
    sample, trained_on = sampled(docs, known)
    model = fitted(sample)
    rows = nested(docs, doc_id=F.col("doc_id"), x=judgement(text_of(), model, docs.sparkSession)).select("row", "doc_id", "x.*")
    rows = written(rows, "logits")
    kept = rows.where(score(cuts_by(rows.select("doc_id", "logit", "language"), known, trained_on) if model else {-1: 0.0}) < THRESHOLD)
    forget(known, sample)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
