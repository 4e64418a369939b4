"""Packing documents into sequences by cutting-stock column generation.

A document longer than a sequence fills whole sequences first; what remains of each document is a rest of 1 to
SIZE - 1 tokens. Over the histogram of those lengths a linear program chooses patterns, multisets of lengths that fit in a
sequence, so that all rests are packed by the fewest sequences. It starts from the patterns of first fit decreasing,
each of which uses one length up, so they are a basis; a bounded-knapsack dynamic programme prices new patterns by the
current duals, until the prices prove that no programme needs GAP less, or one sequence. Pattern counts are rounded down and the
residue is packed by first fit decreasing. The ranks of the documents of each length say which pattern, sequence and
offset each takes. What room the patterns leave, some hundredths of a per cent, is filled by cut documents: as many
sequences of the patterns with the most room are given up as it takes, and their rests are laid through the room
that is left in all others, and then through sequences of powers of two. So no sequence has padding, and all other rests
stay whole.

The driver holds histogram, patterns and their ranges: at most SIZE lengths and a few times SIZE patterns, whatever the input.

Defined cases: a null text is an empty one, of the end token alone; null and repeated doc_ids stay, each row is a
document; an empty table gives an empty result; columns of other names are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixtable.llm.common import ranked, small_batches, text_of, written

SIZE, END, GAP, PULL, REFRESH, ROUND, SEED = 2048, 1, 1e-3, 0.8, 64, 64, 42
ROWS = 64  # of the driver's inverse that are worked on at once
WORDS_KEPT = 250_000  # words a Python worker remembers the ids of, some 50 MB
_tokenizers: dict[str, tuple] = {}  # of this process: vocabulary file, with the words met

# Texts whose normal form is plain: Latin letters in composed form, no white space but ASCII's usual; there, lower case
# is by character, and the vocabulary's own rule for words reads as WORD. Other texts are cut at spaces only.
PLAIN = re.compile(r"[\n\r\t\x20-\x7e\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]*")
LETTERS, NUMBERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u024f\u2c65\u2c66", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")


def encoder(vocabulary: str) -> Callable[[list[str]], list[bytes]]:
    """Ids, as little-endian unsigned 32-bit, of texts. No token of this vocabulary spans a space, tab or line end, so
    the ids of a text are those of its words; each worker process keeps the ids of the words it met."""
    from tokenizers import Tokenizer

    if vocabulary not in _tokenizers:
        _tokenizers[vocabulary] = Tokenizer.from_file(vocabulary), {}
    tokenizer, words = _tokenizers[vocabulary]
    model, visible = tokenizer.model, byte_letters()

    def learn(plain: set[str], other: set[str]) -> None:
        """Words of plain texts go straight to the merges; pieces of other texts through the whole tokenizer."""
        for w in plain:
            words[w] = array("I", [t.id for t in model.tokenize(w.encode().decode("latin-1").translate(visible))]).tobytes()
        rest = list(other)
        for w, e in zip(rest, tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
            words[w] = array("I", e.ids).tobytes()

    def encode(texts: list[str]) -> list[bytes]:
        plain = [bool(PLAIN.fullmatch(t)) and "<|" not in t for t in texts]  # special tokens are whole words
        parts = [WORD.findall(t.lower()) if p else re.split("[ \n\t\r]", t) for t, p in zip(texts, plain, strict=True)]
        met = [set().union(*(x for x, p in zip(parts, plain, strict=True) if p == kind)) for kind in (True, False)]
        fresh = [m.difference(words) for m in met]
        if len(words) + sum(map(len, fresh)) > WORDS_KEPT:
            words.clear()
            fresh = met
        learn(*fresh)
        return [b"".join(map(words.__getitem__, p)) for p in parts]

    return encode


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: visible Latin-1 characters themselves, the others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in visible} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in visible)}


def tokenised(text: Column, vocabulary: str, size: int = SIZE, end: int = END) -> Column:
    """doc_tokens, crcs (of the whole blocks, then of the rest) and rest (its ids, little-endian) of a text without nulls."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode, last, block = encoder(vocabulary), np.array([end], dtype="<u4").tobytes(), 4 * size
        for texts in batches:
            out = []
            for at in range(0, len(texts), 256):
                for ids in encode(texts.iloc[at : at + 256].tolist()):
                    ids += last
                    out.append((len(ids) // 4, [zlib.crc32(ids[i : i + block]) for i in range(0, len(ids), block)], ids[len(ids) - len(ids) % block :]))
            yield pd.DataFrame(out, columns=["doc_tokens", "crcs", "rest"])

    return F.pandas_udf(run, "doc_tokens long, crcs array<long>, rest binary", F.PandasUDFType.SCALAR_ITER)(text)


Pattern = tuple[dict[int, int], float]  # how often each length (by index) is in it, and how many sequences take it


class Ladder:
    """For every room, the longest length left that fits."""

    def __init__(self, lengths: np.ndarray, size: int) -> None:
        self.upto = np.searchsorted(lengths, np.arange(size + 1), side="right") - 1
        self.live = list(range(-1, len(lengths)))  # live[i + 1]: the largest index up to i that is left, or one nearer to it

    def largest(self, room: int) -> int:
        i, path = int(self.upto[room]), []
        while self.live[i + 1] != i:
            path.append(i + 1)
            i = self.live[i + 1]
        for p in path:
            self.live[p] = i
        return i

    def drop(self, i: int) -> None:
        self.live[i + 1] = i - 1


def first_fit(lengths: np.ndarray, counts: np.ndarray, size: int, whole: bool) -> list[Pattern]:
    """Patterns by first fit decreasing over a histogram. Whole: of integer times, each as often as it fits. Otherwise
    each is taken until one of its lengths, the last in the dict, is used up, so there is one for every length."""
    ladder, left, out = Ladder(lengths, size), counts.tolist(), []
    for i in np.flatnonzero(counts == 0)[::-1] if whole else ():
        ladder.drop(int(i))
    while (i := ladder.largest(size)) >= 0:
        room, used = size, {}
        while i >= 0:
            used[i] = min(room // int(lengths[i]), max(1, int(left[i])))
            room -= used[i] * int(lengths[i])
            i = ladder.largest(min(room, int(lengths[i]) - 1))
        last = min(used, key=lambda i: left[i] / used[i])
        times = left[last] // used[last] if whole else left[last] / used[last]
        for i, n in used.items():
            left[i] = max(0, left[i] - n * times)
            if whole and not left[i]:
                ladder.drop(i)
        if not whole:
            left[last] = 0
            ladder.drop(last)
            used[last] = used.pop(last)
        out.append((used, times))
    return out


def priced(lengths: np.ndarray, counts: np.ndarray, duals: np.ndarray, size: int) -> tuple[float, dict[int, int]]:
    """The pattern of the greatest sum of duals, no length more often than it counts: bounded knapsack by powers of two."""
    best, steps = np.zeros(size + 1), []
    for i in np.flatnonzero(duals > 1e-12):
        spare, k = int(min(counts[i], size // lengths[i])), 1
        while spare > 0:
            k = min(k, spare)
            weight = k * int(lengths[i])
            added = best[: size + 1 - weight] + k * duals[i]
            better = added > best[weight:]
            np.maximum(best[weight:], added, out=best[weight:])
            steps.append((int(i), k, weight, np.packbits(better)))
            spare, k = spare - k, 2 * k
    room, used = size, {}
    for i, k, weight, better in reversed(steps):
        at = room - weight
        if at >= 0 and better[at >> 3] >> (7 - (at & 7)) & 1:
            used[i] = used.get(i, 0) + k
            room = at
    return float(best[size]), used


def programme(lengths: np.ndarray, counts: np.ndarray, size: int, gap: float = GAP) -> list[Pattern]:
    """Patterns and times (no integers) that pack all counts in at most 1 + gap times, or one more than, the fewest sequences.

    Revised simplex with an explicit inverse, computed anew every REFRESH pivots. The counts are moved by less than a
    millionth each, so no two bases tie. Prices are the duals drawn towards the best duals so far, first the lengths'
    shares of a sequence, so that they don't swing. It ends when a bound that a pricing gave proves the gap: any prices, divided by what the
    dearest pattern costs by them, bound the sequences from below. It also ends where a round of pivots, one for every
    eighth length, has gained less than the gap, or rounding has spoilt the basis: what it has packs everything.
    """
    m = len(lengths)
    basis = [{}] * m
    for used, _ in first_fit(lengths, counts, size, False):
        basis[next(reversed(used))] = used
    wanted = counts + np.random.default_rng(SEED).random(m) / 1e6

    def fresh() -> tuple[np.ndarray, np.ndarray]:
        columns = np.zeros((m, m))
        for r, used in enumerate(basis):
            columns[list(used), r] = list(used.values())
        inverse = np.linalg.inv(columns)
        return inverse, np.maximum(inverse @ wanted, 0)

    inverse, amounts = fresh()
    sound = list(basis), amounts
    centre = lengths / size  # by these prices no pattern costs more than 1
    bound, pull, pivots, since, before = 0.0, 1.0, 0, 0, np.inf  # the first prices are the shares alone: they prove the tokens' own bound
    while True:
        total = float(amounts.sum())
        if pivots - since >= max(ROUND, m // 8):
            if total > before * (1 - gap):
                break
            since, before = pivots, total
        duals = inverse.sum(axis=0)
        prices = np.maximum(pull * centre + (1 - pull) * duals, 0)
        value, used = priced(lengths, counts, prices, size)
        if counts @ prices / value > bound:
            bound, centre = float(counts @ prices / value), prices / value
        if total <= max(bound * (1 + gap), np.ceil(bound - 1e-9)):
            break
        at, n = list(used), np.array(list(used.values()), dtype=float)
        if duals[at] @ n <= 1 + 1e-9:  # no gain by the duals themselves: draw less
            if pull < 1e-3:
                break  # the duals price no pattern above 1
            pull = pull / 2 if pull > 2e-3 else 0.0
            continue
        pull, d = PULL, inverse[:, at] @ n
        able = np.flatnonzero(d > 1e-6)
        if not len(able):
            break
        r = able[int((amounts[able] / d[able]).argmin())]
        step = amounts[r] / d[r]
        amounts = np.maximum(amounts - step * d, 0)
        amounts[r] = step
        inverse[r] /= d[r]
        rows = np.flatnonzero(np.abs(d) > 1e-12)
        rows = rows[rows != r]
        for part in range(0, len(rows), ROWS):
            some = rows[part : part + ROWS]
            inverse[some] -= d[some, None] * inverse[r]
        basis[r] = used
        pivots += 1
        if pivots % REFRESH == 0:
            inverse = None  # its memory goes before the new one takes its own
            try:
                inverse, amounts = fresh()
                sound = list(basis), amounts
            except np.linalg.LinAlgError:  # rounding has made the basis singular: what was sound last packs everything too
                break
    basis, amounts = sound if pivots % REFRESH == 0 else _checked(basis, wanted, sound)
    return [(used, float(x)) for used, x in zip(basis, amounts, strict=True)]


def _checked(basis: list[dict[int, int]], wanted: np.ndarray, sound: tuple) -> tuple:
    """The basis with its amounts solved anew, or the last sound one where rounding has spoilt it."""
    columns = np.zeros((len(basis), len(basis)))
    for r, used in enumerate(basis):
        columns[list(used), r] = list(used.values())
    try:
        amounts = np.linalg.solve(columns, wanted)
    except np.linalg.LinAlgError:
        return sound
    fits = np.isfinite(amounts).all() and amounts.min() > -1e-3 and np.abs(columns @ amounts - wanted).max() < 1e-3
    return (basis, np.maximum(amounts, 0)) if fits else sound


def patterns(lengths: np.ndarray, counts: np.ndarray, size: int = SIZE, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """Patterns with whole times that pack all counts: those of the programme, rounded down; first fit decreasing packs
    what rounding leaves, less than one sequence for each length."""
    if not len(lengths):
        return []
    left, out = counts.copy(), []
    for used, amount in programme(lengths, counts, size, gap):
        times = int(min([np.floor(amount + 1e-6), *(left[i] // n for i, n in used.items())]))
        if times > 0:
            for i, n in used.items():
                left[i] -= n * times
            out.append((used, times))
    return out + [(used, int(times)) for used, times in first_fit(lengths, left, size, True)]


class Plan:
    """Where each rank of each length goes: arrays of a row for each length of each pattern."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, fulls: np.ndarray, size: int = SIZE, gap: float = GAP) -> None:
        """lengths 0 to size - 1 with their documents' number and number of whole blocks."""
        self.size = size
        real = lengths > 0
        own, many = lengths[real], counts[real]
        rooms = [(size - sum(n * int(own[i]) for i, n in used.items()), used, times) for used, times in patterns(own, many, size, gap)]
        rooms.sort(key=lambda x: (-x[0], sorted(x[1].items())))
        missing = sum(room * times for room, _, times in rooms)  # tokens of room that the cut rests do not fill
        taken, rows, sequence, gaps = np.zeros(len(own), dtype=np.int64), [], 0, []
        for room, used, times in rooms:
            given_up = min(times, max(0, -(-missing // size)))  # each sequence less is its room less, and its rests fill others
            missing, times, offset = missing - given_up * size, times - given_up, 0
            for i, n in used.items() if times else ():
                rows.append((int(own[i]), int(taken[i]), n, sequence, offset))
                taken[i] += n * times
                offset += n * int(own[i])
            if room and times:
                gaps.append((room, times, sequence))
            sequence += times
        rows.sort()
        self.slots = np.array(rows, dtype=np.int64).reshape(-1, 5)
        self.keys = self.slots[:, 0] << 48 | self.slots[:, 1]
        self.covered, self.stream = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        self.covered[own] = taken
        self.stream[own] = np.concatenate([[0], np.cumsum((many - taken) * own)[:-1]])
        self.gaps = np.array(gaps, dtype=np.int64).reshape(-1, 3)
        self.gap_ends = np.cumsum(self.gaps[:, 0] * self.gaps[:, 1])
        self.room = int(self.gap_ends[-1]) if len(gaps) else 0
        total = max(0, int(((many - taken) * own).sum()) - self.room)
        # the stream's own sequences: whole ones, then powers of two
        self.whole, self.first = total // size, sequence
        ends, at = [], self.whole * size
        for bit in range(size.bit_length() - 1, -1, -1):
            if (total - self.whole * size) >> bit & 1:
                at += 1 << bit
                ends.append(at)
        self.ends = np.array(ends, dtype=np.int64)
        self.blocks = np.zeros(size, dtype=np.int64)
        self.blocks[lengths] = sequence + self.whole + len(ends) + np.concatenate([[0], np.cumsum(fulls)[:-1]])

    def place(self, at: int) -> tuple[int, int, int]:
        """sequence_id, offset and room there of a place of the stream: the patterns' room first, then its own sequences."""
        if at < self.room:
            g = int(np.searchsorted(self.gap_ends, at, side="right"))
            room, times, sequence = self.gaps[g]
            k, inside = divmod(at - int(self.gap_ends[g] - room * times), int(room))
            return int(sequence) + k, self.size - int(room) + inside, int(room) - inside
        at -= self.room
        k, inside = divmod(at, self.size)
        if k < self.whole:
            return self.first + k, inside, self.size - inside
        i = int(np.searchsorted(self.ends, at, side="right"))
        start = int(self.ends[i - 1]) if i else self.whole * self.size
        return self.first + self.whole + i, at - start, int(self.ends[i]) - at

    def rest(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence_id, offset, length) of the pieces of the rest with this rank."""
        if rank < self.covered[length]:
            _, start, a, sequence, offset = self.slots[np.searchsorted(self.keys, length << 48 | rank, side="right") - 1]
            t = rank - start
            return [(int(sequence + t // a), int(offset + t % a * length), length)]
        at, out = int(self.stream[length] + (rank - self.covered[length]) * length), []
        while length:
            sequence, offset, room = self.place(at)
            n = min(length, room)
            out.append((sequence, offset, n))
            at, length = at + n, length - n
        return out


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END, gap: float = GAP) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", tokenised(text_of(), vocabulary, size, end).alias("x"))
    tokens = written(rows.select("uid", "doc_id", "x.*"), "tokens")
    sized = tokens.select("uid", (F.col("doc_tokens") % size).alias("rest_n"), F.floor(F.col("doc_tokens") / size).alias("full"), F.xxhash64(F.lit(SEED), "uid").alias("hash"))
    histogram = sized.groupBy("rest_n").agg(F.count("*").alias("n"), F.sum("full").alias("full")).orderBy("rest_n").collect()  # at most `size` rows
    plan = Plan(*(np.array([r[k] for r in histogram], dtype=np.int64) for k in ("rest_n", "n", "full")), size, gap)
    order = ranked(sized, ["rest_n"], "hash", ("full",)).select("uid", "rank_", "full_before_")

    def pieces(doc_tokens: pd.Series, crcs: pd.Series, rest: pd.Series, rank: pd.Series, before: pd.Series) -> pd.Series:
        out = []
        for n, c, ids, r, b in zip(doc_tokens, crcs, rest, rank, before, strict=True):
            full, left = divmod(n, size)
            first, at = plan.blocks[left] + b, 0
            own = [{"start": i * size, "length": size, "ids_crc32": c[i], "sequence_id": first + i, "offset": 0} for i in range(full)]
            for sequence, offset, k in plan.rest(left, r) if left else []:
                crc = c[full] if k == left else zlib.crc32(ids[4 * at : 4 * (at + k)])
                own.append({"start": full * size + at, "length": k, "ids_crc32": crc, "sequence_id": sequence, "offset": offset})
                at += k
            out.append(own)
        return pd.Series(out)

    cut = F.pandas_udf(pieces, "array<struct<start:long,length:long,ids_crc32:long,sequence_id:long,offset:long>>", F.PandasUDFType.SCALAR)
    placed = tokens.join(order, "uid").select("doc_id", "doc_tokens", F.explode(cut("doc_tokens", "crcs", "rest", "rank_", "full_before_")).alias("x"))
    return placed.select("doc_id", "x.start", "x.length", "x.ids_crc32", "doc_tokens", "x.sequence_id", "x.offset")
