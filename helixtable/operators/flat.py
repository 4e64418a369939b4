"""The filters of many (profile, target) pairs with the targets laid end to end: model positions are walked in turn, and
a step is one operation on all residues of a piece, so Python's cost is per model position and not per residue.

What begins a segment depends on the segments that ended before it. The first round has one segment only. A path of more
is no better unless each of its segments, taken alone, ends above a level that pays for the next one's begin; so further
rounds walk only the window from the first to the last such end, and take what begins a segment from the round before,
until nothing changes. Pairs that are not settled after ROUNDS go to the programmes of `batches`, residue by residue.
"""

from __future__ import annotations

import numpy as np

from helixtable.functions.alphabet import SYMBOLS
from helixtable.operators import batches as B
from helixtable.operators.kernels import BASE, NEG, TEC, Profile, _moves

#: Residues of a piece: its arrays stay in cache.
RESIDUES = 1 << 15
ROUNDS = 6
#: Residues of a block of the composition filter.
BLOCK = 32


def pieces(ps: list[Profile], codes: list[np.ndarray]) -> list[np.ndarray]:
    """Indices of the pairs in pieces of like model length and some RESIDUES residues, one pair at least."""
    order = np.argsort([p.m for p in ps], kind="stable")
    ends = np.cumsum([len(codes[k]) + 1 for k in order])
    cuts = np.unique(np.searchsorted(ends, np.arange(RESIDUES, ends[-1] if len(ends) else 0, RESIDUES)))
    return [x for x in np.split(order, cuts) if len(x)]


class Laid:
    """Targets end to end, each behind a cell of its own that no state survives; values(k) are the gains of all cells at model position k."""

    def __init__(self, ps: list[Profile], codes: list[np.ndarray], rows, absent: float, dtype) -> None:
        at: dict[int, int] = {}
        which = np.array([at.setdefault(id(p), len(at)) for p in ps])
        own = {id(p): p for p in ps}
        self.width, end = max(p.m for p in ps), len(SYMBOLS)
        tables = np.full((len(at), self.width, end + 1), absent, dtype)
        for key, k in at.items():
            tables[k, : own[key].m, :end] = rows(own[key])
        self.table, self.sizes = tables.ravel(), np.array([len(c) + 1 for c in codes])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(self.sizes.sum()) - np.repeat(self.starts, self.sizes)  # 0 before a target, its residues from 1
        code = np.full(len(self.place), end, np.intp)
        code[self.place > 0] = np.concatenate(codes)
        self.base = code + np.repeat(which * (self.width * (end + 1)), self.sizes)

    def values(self, k: int, out: np.ndarray) -> np.ndarray:
        return np.take(self.table[k * (len(SYMBOLS) + 1) :], self.base, out=out, mode="clip")

    def spread(self, x: np.ndarray) -> np.ndarray:
        """A value of each pair at all its cells."""
        return np.repeat(x, self.sizes)

    def windows(self, x: np.ndarray, of: np.ndarray, level: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(pair, first place, values from there to the last place) of where some pairs have values above their levels."""
        out = []
        for k, least in zip(of.tolist(), level.tolist(), strict=True):
            own = x[self.starts[k] : self.starts[k] + self.sizes[k]]
            above = np.flatnonzero(own > least)
            out.append((k, int(above[0]), own[above[0] : above[-1] + 1].copy()))
        return out


def _again(open_: list[list], begins) -> list[list]:
    """The windows [pair, first place, values, begins] whose begins, by their values, are not those of the last round."""
    out = []
    for k, first, values, last in open_:
        now = begins(k, np.maximum.accumulate(values))
        if last is None or not np.array_equal(now, last):
            out.append([k, first, values, now])
    return out


def multi_segments(ps: list[Profile], codes: list[np.ndarray], tjb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `batches.multi_segments`, for pairs in any order."""
    over, xj, tjb = np.zeros(len(ps), bool), np.zeros(len(ps), np.int64), np.asarray(tjb)
    step = tjb.astype(np.int64) + np.array([p.tbm for p in ps], np.int64)
    ceiling = 255 - np.array([p.bias for p in ps], np.int64)
    begin = np.maximum(0, BASE - step)
    # residues of a segment that ends above the level
    least = (BASE + TEC - begin) // np.maximum(1, np.array([int(p.gains.max()) for p in ps], np.int64)) + 1

    def ends_of(at: np.ndarray, targets: list[np.ndarray], begins) -> tuple[Laid, np.ndarray]:
        lay = Laid([ps[k] for k in at], targets, lambda p: np.maximum(p.gains, -10_000), -10_000, np.int16)
        ends = _segment_ends(lay, np.minimum(begins(lay), 255).astype(np.int16), lay.spread(ceiling[at]).astype(np.int16))
        top = np.maximum.reduceat(ends, lay.starts).astype(np.int64)
        over[at], xj[at] = over[at] | (top >= ceiling[at]), np.maximum(xj[at], top - TEC)
        return lay, ends

    open_: list[list] = []
    for at in pieces(ps, codes):
        lay, ends = ends_of(at, [codes[k] for k in at], lambda lay: lay.spread(begin[at]))  # noqa: B023
        some = np.flatnonzero(~over[at] & (xj[at] > BASE))
        open_ += [[int(at[k]), first, x.astype(np.int64), None] for k, first, x in lay.windows(ends, some, np.full(len(some), BASE + TEC)) if len(x) > least[at[k]]]
    begins = lambda k, x: np.maximum(0, np.maximum(BASE, x - TEC) - step[k])
    for _ in range(ROUNDS - 1):
        open_ = _again(open_, begins)
        targets = [codes[k][first : first + len(x) - 1] for k, first, x, _ in open_]
        for part in pieces([ps[w[0]] for w in open_], targets):
            at = np.array([open_[w][0] for w in part])
            lay, ends = ends_of(at, [targets[w] for w in part], lambda lay: np.concatenate([open_[w][3] for w in part]))  # noqa: B023
            for w, b, size in zip(part, lay.starts, lay.sizes, strict=True):
                open_[w][2] = np.maximum(open_[w][2], ends[b : b + size])
        open_ = [w for w in open_ if not over[w[0]]]
    at = np.array([k for k, *_ in _again(open_, begins)], dtype=int)
    for part in B.cut(np.array([len(codes[k]) for k in at])):
        over[at[part]], xj[at[part]] = B.multi_segments([ps[k] for k in at[part]], [codes[k] for k in at[part]], tjb[at[part]])
    return over, xj


def _segment_ends(lay: Laid, begin: np.ndarray, ceiling: np.ndarray) -> np.ndarray:
    """The best value of a segment that ends at each cell, where `begin` is that of a segment about to begin after it."""
    size = len(begin)
    ends, zero, gains, to, now = (np.zeros(size, np.int16) for _ in range(5))
    np.minimum(begin, ceiling, out=to)
    for k in range(lay.width):
        lay.values(k, gains)
        np.add(to[:-1], gains[1:], out=now[1:])
        np.maximum(now, zero, out=now)
        np.maximum(ends, now, out=ends)
        np.maximum(now, begin, out=to)
        np.minimum(to, ceiling, out=to)
    return ends


def viterbis(ps: list[Profile], codes: list[np.ndarray]) -> np.ndarray:
    """As `batches.viterbis`, for pairs in any order and expected further segments of one."""
    n, half = np.array([len(c) for c in codes], dtype=float), np.log(0.5)
    move, loop = map(np.log, _moves(n, 1.0))
    begin, score = move + np.log(np.array([p.entry for p in ps])), np.full(len(ps), NEG)
    # residues of a segment that ends above the level
    least = np.ceil((-half - begin) / (np.array([p.most for p in ps]) - loop))

    def ends_of(at: np.ndarray, targets: list[np.ndarray], first: np.ndarray, more: np.ndarray | float) -> tuple[Laid, np.ndarray, np.ndarray]:
        own = [ps[k] for k in at]
        lay = Laid(own, targets, lambda p: p.emit, NEG, np.float64)
        passed = (lay.place + lay.spread(first)) * lay.spread(loop[at])
        ends = _alignment_ends(lay, own, passed + more + lay.spread(begin[at]))
        ends -= passed
        best = np.maximum.reduceat(ends, lay.starts) + half
        score[at] = np.maximum(score[at], best + n[at] * loop[at] + move[at])
        return lay, ends, best

    open_: list[list] = []
    for at in pieces(ps, codes):
        lay, ends, best = ends_of(at, [codes[k] for k in at], np.zeros(len(at), int), 0.0)
        some = np.flatnonzero(best > 0)
        open_ += [[int(at[k]), first, x, None] for k, first, x in lay.windows(ends, some, np.full(len(some), -half)) if len(x) > least[at[k]]]
    begins = lambda k, x: np.maximum(0, x + half)  # noqa: E731 - by how much a further segment begins better than a first one
    for _ in range(ROUNDS - 1):
        open_ = _again(open_, begins)
        targets = [codes[k][first : first + len(x) - 1] for k, first, x, _ in open_]
        for part in pieces([ps[w[0]] for w in open_], targets):
            at, first = (np.array([open_[w][c] for w in part]) for c in (0, 1))
            lay, ends, _ = ends_of(at, [targets[w] for w in part], first, np.concatenate([open_[w][3] for w in part]))
            for w, b, size in zip(part, lay.starts, lay.sizes, strict=True):
                open_[w][2] = np.maximum(open_[w][2], ends[b : b + size])
    at = np.array([k for k, *_ in _again(open_, begins)], dtype=int)
    for part in B.cut(np.array([len(codes[k]) for k in at])):
        score[at[part]] = B.viterbis([ps[k] for k in at[part]], [codes[k] for k in at[part]])
    return score


def _alignment_ends(lay: Laid, ps: list[Profile], entered: np.ndarray) -> np.ndarray:
    """The best log-odds of what ends in a match at each cell, where `entered` is that of a segment about to begin after it."""
    p, size = ps[0], len(entered)
    mm, mi, md = np.log(1 - p.to_insert - p.to_delete), np.log(p.to_insert), np.log(p.to_delete)
    im, ii, dm, dd = np.log(1 - p.insert_again), np.log(p.insert_again), np.log(1 - p.delete_again), np.log(p.delete_again)
    # an insert falls by ii a cell, so it is a running maximum less a ramp. Between targets the ramp falls so far that what
    # is carried over stays below what begins in the next one
    most = np.maximum.reduceat(entered, lay.starts) + np.array([q.m for q in ps]) * max(q.most for q in ps)
    gaps = np.concatenate([[0], np.ceil(np.maximum(0, most[:-1] - entered[lay.starts[1:]]) / -ii) + 8])
    ramp = ii * (np.arange(size) + np.repeat(np.cumsum(gaps), lay.sizes))
    out_of = ramp[1:] + (mi - ii + im)
    best, delete, match = (np.full(size, NEG) for _ in range(3))
    emit, insert, other, to = np.empty(size), np.empty(size), np.empty(size), entered.copy()
    for k in range(lay.width):
        lay.values(k, emit)
        np.add(to[:-1], emit[1:], out=match[1:])
        np.maximum(best, match, out=best)
        if k + 1 == lay.width:
            break
        np.subtract(match, ramp, out=insert)
        np.maximum.accumulate(insert, out=insert)
        np.add(match, mm, out=to)
        np.add(insert[:-1], out_of, out=other[1:])
        np.maximum(to[1:], other[1:], out=to[1:])
        np.add(delete, dd * k + dm, out=other)  # deletions are kept less their slope
        np.maximum(to, other, out=to)
        np.maximum(to, entered, out=to)
        np.add(match, md - dd * (k + 1), out=other)
        np.maximum(delete, other, out=delete)
    return best


def bias_scores(ps: list[Profile], codes: list[np.ndarray]) -> np.ndarray:
    """As `batches.bias_scores`, for pairs in any order: the steps of each block are multiplied first, all blocks at a time, then the blocks."""
    out = np.full(len(ps), NEG)
    n = np.array([len(c) for c in codes])
    order = np.flatnonzero(n)[np.argsort(-n[n > 0], kind="stable")]
    ends = np.cumsum(n[order])
    for at in np.split(order, np.unique(np.searchsorted(ends, np.arange(RESIDUES * 8, ends[-1] if len(ends) else 0, RESIDUES * 8)))):
        if len(at):
            out[at] = _bias([ps[k] for k in at], [codes[k] for k in at])
    return out


def _bias(ps: list[Profile], codes: list[np.ndarray]) -> np.ndarray:
    at: dict[int, int] = {}
    which = np.array([at.setdefault(id(p), len(at)) for p in ps])
    own = {id(p): p for p in ps}
    expected = np.stack([own[k].expected for k in at])
    n, m = np.array([len(c) for c in codes]), np.array([p.m for p in ps], dtype=float)
    p1, stay = n / (n + 1), m / (m + 1)
    # residues after the first, in blocks by pair; only the last block of a pair may be shorter
    blocks = -(-(n - 1) // BLOCK)
    first = np.cumsum(blocks) - blocks
    total, of = int(blocks.sum()), np.repeat(np.arange(len(ps)), blocks)
    cells, there = np.zeros(total * BLOCK, np.uint8), np.full(total, BLOCK)
    for at, size, x in zip((first * BLOCK).tolist(), (n - 1).tolist(), codes, strict=True):
        cells[at : at + size] = x[1:]
    there[(first + blocks - 1)[blocks > 0]] -= (blocks * BLOCK - (n - 1))[blocks > 0]
    a, b, c, d = p1[of], 1 - p1[of], (1 - stay)[of], stay[of]
    one, two = [np.ones(total), np.zeros(total)], [np.zeros(total), np.ones(total)]  # what a block makes of each state
    scale = np.zeros(total)
    by_size = np.argsort(-there, kind="stable")  # running blocks first
    cells = np.ascontiguousarray(cells.reshape(total, BLOCK)[by_size].T)
    table, row = expected.ravel(), which[of][by_size] * expected.shape[1]
    a, b, c, d = a[by_size], b[by_size], c[by_size], d[by_size]
    running = (there[by_size][None, :] > np.arange(BLOCK)[:, None]).sum(axis=1)
    for k, r in enumerate(running):
        if not r:
            break
        odds = np.take(table, row[:r] + cells[k, :r], mode="clip")
        for x, y in (one, two):
            x[:r], y[:r] = x[:r] * a[:r] + y[:r] * c[:r], (x[:r] * b[:r] + y[:r] * d[:r]) * odds
        if k % 8 == 7:
            top = np.maximum(np.maximum(one[0], one[1]), np.maximum(two[0], two[1]))[:r]
            for x in (*one, *two):
                x[:r] /= top
            scale[:r] += np.log(top)
    back = np.empty(total, np.intp)
    back[by_size] = np.arange(total)
    one, two, scale = [x[back] for x in one], [x[back] for x in two], scale[back]
    x, y, score = np.full(len(ps), 0.999), 0.001 * expected[which, [int(q[0]) for q in codes]], np.zeros(len(ps))
    for k in range(int(blocks.max(initial=0))):  # pairs are longest first
        r = int((blocks > k).sum())
        s = first[:r] + k
        u, v = x[:r] * one[0][s] + y[:r] * two[0][s], x[:r] * one[1][s] + y[:r] * two[1][s]
        top = np.maximum(u, v)
        x[:r], y[:r] = u / top, v / top
        score[:r] += np.log(top) + scale[s]
    return score + np.log(x + y) + n * np.log(p1) + np.log(1 - p1)
