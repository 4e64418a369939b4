"""The filters of many (profile, target) pairs at once: each step of a dynamic programme is one operation on a
(pairs x model positions) matrix, so Python's cost is per residue of a batch's longest target, not per pair.

Pairs come as profiles and code arrays, longest target first, so that those still running are the first rows. Profiles of
a batch may differ in all but their transitions; shorter ones are padded with positions that nothing enters. Results
equal those of the one-pair kernels (Forward up to the order of sums).
"""

from __future__ import annotations

import numpy as np

from helixtable.functions.alphabet import BACKGROUND, SYMBOLS, expand
from helixtable.operators.kernels import BASE, NEG, TEC, Domain, Profile, Specials, _moves, occupied, walked

#: Cells (pairs x residues, pairs x model positions) of a batch; what is larger is a batch of its own.
CELLS = 1 << 20
#: Pairs of a batch at most: their match, insert and delete values stay in cache. Those of programmes that keep a few numbers a pair.
ROWS, NARROW_ROWS = 512, 4096
#: Up to so many model positions and running pairs, deletions are chained by a product of matrices rather than row by row.
CHAINED, FEW = 128, 256
#: Segments that are rescored at a time.
DOMAINS = 128


def cut(lengths: np.ndarray, rows: int = ROWS) -> list[np.ndarray]:
    """Indices of the pairs in batches, longest target first, of CELLS cells or one pair, and `rows` pairs at most."""
    out, order, at = [], np.argsort(-lengths, kind="stable"), 0
    while at < len(order):
        size = min(rows, max(1, CELLS // max(1, int(lengths[order[at]]))))
        out.append(order[at : at + size])
        at += size
    return out


def padded(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes by position (residues x pairs) and how many pairs reach each position."""
    lengths = np.array([len(c) for c in codes])
    grid = np.zeros((lengths.max(initial=0), len(codes)), dtype=np.intp)
    for b, c in enumerate(codes):
        grid[: len(c), b] = c
    return grid, (lengths[None, :] > np.arange(len(grid))[:, None]).sum(axis=1)


def stacked(ps: list[Profile], rows, fill: float, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Tables (distinct profiles x codes x positions) of rows(profile), and each pair's table."""
    at: dict[int, int] = {}
    which = np.array([at.setdefault(id(p), len(at)) for p in ps])
    own = {id(p): p for p in ps}
    out = np.full((len(at), len(SYMBOLS), max(p.m for p in ps)), fill, dtype)
    for key, k in at.items():
        out[k, :, : own[key].m] = rows(own[key]).T
    return out, which


def tabled(ps: list[Profile], rows, fill: float, dtype) -> tuple[np.ndarray, np.ndarray]:
    """As `stacked`, in one table (profiles and codes x positions), with each pair's first row: a code's row comes that much later."""
    tables, which = stacked(ps, rows, fill, dtype)
    return np.ascontiguousarray(tables.reshape(-1, tables.shape[2])), which * tables.shape[1]


def multi_segments(ps: list[Profile], codes: list[np.ndarray], tjb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each pair's multi-segment filter overflows, and its best state value where not."""
    grid, running = padded(codes)
    gains, which = tabled(ps, lambda p: p.gains, -10_000, np.int16)
    bias = np.array([p.bias for p in ps], np.int16)
    step = tjb.astype(np.int16) + np.array([p.tbm for p in ps], np.int16)
    n, width = len(codes), gains.shape[1]
    over, xj, xb = np.zeros(n, bool), np.zeros(n, np.int16), np.maximum(0, BASE - step).astype(np.int16)
    # model positions lie along the first axis, pairs along the second; a maximum of two whole arrays is vectorised
    row, zero = np.zeros((width + 1, n), np.int16), np.zeros((width, n), np.int16)
    ceiling = (255 - bias).astype(np.int16)
    for c, a in zip(grid, running, strict=True):
        s = np.maximum(row[:-1, :a], xb[:a])
        np.minimum(s, ceiling[:a], out=s)
        s += gains[which[:a] + c[:a]].T
        np.maximum(s, zero[:, :a], out=row[1:, :a])
        s = row[1:, :a]
        xe = s.max(axis=0)
        over[:a] |= xe >= ceiling[:a]
        np.maximum(xj[:a], xe - TEC, out=xj[:a])
        xb[:a] = np.maximum(0, np.maximum(BASE, xj[:a]) - step[:a])
    return over, xj


def single_segments(ps: list[Profile], gains: np.ndarray, tjb: np.ndarray) -> np.ndarray:
    """What `multi_segments` has as each pair's best state value, by its single-segment gain, where that settles it; -1 elsewhere.

    A second segment may begin better than the first only when a first one ends above BASE. Until then every place is the
    constant begin plus the best sum of its diagonal.
    """
    step = tjb.astype(int) + np.array([p.tbm for p in ps], int)
    begin, bias = BASE - step, np.array([p.bias for p in ps], int)
    end = begin + gains
    settled = (gains > 0) & (begin >= 0) & (end - TEC <= BASE) & (end < 255 - bias)
    return np.where(settled, np.maximum(0, end - TEC), -1)


def bias_scores(ps: list[Profile], codes: list[np.ndarray]) -> np.ndarray:
    """Log-probabilities of the targets under the two-state model of background and each profile's composition."""
    grid, running = padded(codes)
    if not len(grid):
        return np.full(len(codes), NEG)
    at: dict[int, int] = {}
    which = np.array([at.setdefault(id(p), len(at)) for p in ps])
    own = {id(p): p for p in ps}
    expected = np.stack([expand(own[k].composition / BACKGROUND) for k in at])
    n, m = np.array([len(c) for c in codes], dtype=float), np.array([p.m for p in ps], dtype=float)
    lengths = n * np.log(np.maximum(n, 1) / (n + 1)) + np.log(1 / (n + 1))
    p1, stay = n / (n + 1), m / (m + 1)
    first, other, score = np.full(len(codes), 0.999), 0.001 * expected[which, grid[0]], np.zeros(len(codes))
    for c, a in zip(grid[1:], running[1:], strict=True):
        x, y = first[:a], other[:a]
        top = np.maximum(x, y)
        score[:a] += np.log(top)
        x, y = x / top, y / top
        first[:a], other[:a] = x * p1[:a] + y * (1 - stay[:a]), (x * (1 - p1[:a]) + y * stay[:a]) * expected[which[:a], c[:a]]
    return np.where(n > 0, score + np.log(first + other) + lengths, NEG)


def viterbis(ps: list[Profile], codes: list[np.ndarray], loops: float = 1.0) -> np.ndarray:
    """Log-odds of the best multi-segment alignment of each pair."""
    grid, running = padded(codes)
    size, p = len(codes), ps[0]
    emit, which = tabled(ps, lambda q: np.log(q.odds), NEG, np.float64)
    width = emit.shape[1]
    move, loop = map(np.log, _moves(np.array([len(c) for c in codes], dtype=float), loops))
    e_j, e_c = (np.log(0.5), np.log(0.5)) if loops else (NEG, 0.0)
    mm, mi, md = np.log(1 - p.to_insert - p.to_delete), np.log(p.to_insert), np.log(p.to_delete)
    im, ii, dm, dd = np.log(1 - p.insert_again), np.log(p.insert_again), np.log(1 - p.delete_again), np.log(p.delete_again)
    entry, slope = np.log(np.array([q.entry for q in ps])), (dd * np.arange(width))[:, None]
    # model positions lie along the first axis, pairs along the second. Inserts are kept with their way out, deletions less their
    # slope, so that a running maximum chains them; a deletion that ends a model is below the match that it left, and an insert
    # there is followed by nothing
    match, insert, delete, best, other = (np.full((width, size), NEG) for _ in range(5))
    into, out_of = (np.repeat(x, size, axis=1) for x in (md - slope[1:], dm + slope[:-1]))
    xn, xj, xc = np.zeros(size), np.full(size, NEG), np.full(size, NEG)
    xb = xn + move
    for c, a in zip(grid, running, strict=True):
        m, i, d, to, x = (y[:, :a] for y in (match, insert, delete, best, other))
        np.add(m[:-1], mm, out=to[1:])
        np.maximum(to[1:], i[:-1], out=to[1:])
        np.add(d[:-1], out_of[:, :a], out=x[1:])
        np.maximum(to[1:], x[1:], out=to[1:])
        to[0] = NEG
        np.maximum(to, xb[:a] + entry[:a], out=to)
        np.add(m, mi + im, out=x)
        i += ii
        np.maximum(i, x, out=i)
        np.add(to, emit[which[:a] + c[:a]].T, out=m)
        np.add(m[:-1], into[:, :a], out=d[1:])
        lines = list(d)
        for y, z in zip(lines[1:], lines[2:], strict=False):  # numpy's running maximum along this axis is not vectorised
            np.maximum(y, z, out=z)
        xe = m.max(axis=0)
        xj[:a], xc[:a] = np.maximum(xj[:a] + loop[:a], xe + e_j), np.maximum(xc[:a] + loop[:a], xe + e_c)
        xn[:a] += loop[:a]
        xb[:a] = np.maximum(xn[:a], xj[:a]) + move[:a]
    return xc + move


def _chained(width: int, again: float) -> np.ndarray | None:
    """The matrix that chains deletions: y[k] = x[k] + again y[k - 1]; none for long models, whose rows are walked."""
    by = np.arange(width)[:, None] - np.arange(width)[None, :]
    return np.where(by >= 0, again ** np.maximum(by, 0).astype(float), 0.0) if width <= CHAINED else None


def forwards(ps: list[Profile], codes: list[np.ndarray], loops: float = 1.0, full: bool = False, lengths: np.ndarray | None = None) -> list[Specials]:
    """Forward of each pair: specials by row, their log factors and the score. full: match and insert values by row too.
    lengths: of the whole targets, for the length model of isolated segments."""
    grid, running = padded(codes)
    size, p = len(codes), ps[0]
    odds, which = tabled(ps, lambda q: q.odds, 0.0, np.float64)
    width, m_of = odds.shape[1], np.array([q.m for q in ps])
    ends = (np.arange(width)[:, None] != m_of - 1).astype(float)
    sizes = np.array([len(c) for c in codes])
    move, loop = _moves((sizes if lengths is None else np.asarray(lengths)).astype(float), loops)
    e_j, e_c = (0.5, 0.5) if loops else (0.0, 1.0)
    mm, mi, md = 1 - p.to_insert - p.to_delete, p.to_insert, p.to_delete
    im, ii, dm, dd = 1 - p.insert_again, p.insert_again, 1 - p.delete_again, p.delete_again
    entry, pairs, chain = np.array([q.entry for q in ps]), np.arange(size), _chained(width, dd)
    # what leaves matches, directly and through deletions, for the next position, in one product
    leaving = None if chain is None else mm * np.eye(width) + dm * md * np.vstack([np.zeros((1, width)), chain[:-1]])
    # states lie along the first axis, pairs along the second: the deletion scan walks whole rows
    match, insert, left = (np.zeros((width, size)) for _ in range(3))
    rows, scale = np.zeros((len(grid) + 1, 5, size)), np.zeros((len(grid) + 1, size))
    keep = [np.zeros((len(grid) + 1, width, size)) for _ in range(2)] if full else None
    rows[0, 1], rows[0, 3] = 1, move
    before = size + 1
    for i, (c, a) in enumerate(zip(grid, running.tolist(), strict=True), 1):
        if a < before:  # pairs that have ended take no part any more
            match, insert, left, before = match[:, :a].copy(), insert[:, :a].copy(), left[:, :a].copy(), a
            loop_, move_, entry_, which_, own, last = loop[:a], move[:a], entry[:a], which[:a], pairs[:a], m_of[:a] - 1
        last_row, row = rows[i - 1, :, :a], rows[i, :, :a]
        new = odds[which_ + c[:a]].T
        come = np.repeat((last_row[3] * entry_)[None, :], width, axis=0)
        come[1:] += left[:-1]
        come[1:] += insert[:-1] * im
        new = np.multiply(new, come, out=come)
        insert *= ii
        match *= mi
        insert += match
        match = new
        if leaving is not None and a <= FEW:
            left = leaving @ match
            out_of = (left[last, own] - mm * match[last, own]) / dm
        else:
            delete = np.zeros((width, a))
            np.multiply(match[:-1], md, out=delete[1:])
            lines = list(delete)
            for y, z in zip(lines, lines[1:], strict=False):  # numpy's sums along this axis are not vectorised
                z += y * dd
            out_of = delete[last, own]
            left = match * mm
            delete *= dm
            left += delete
        np.multiply(last_row, loop_, out=row)
        np.add(match.sum(axis=0), out_of, out=row[0])
        row[2] += row[0] * e_j
        row[4] += row[0] * e_c
        np.multiply(row[1] + row[2], move_, out=row[3])
        top = row.max(axis=0)
        if top.max() > 1e4 or top.min() < 1e-4:
            off = np.flatnonzero((top > 1e4) | (top < 1e-4))
            by = top[off]
            for x in (match, insert, left, row):
                x[:, off] /= by
            scale[i, off] = np.log(by)
        if full:
            keep[0][i, :, :a], keep[1][i, :, :a] = match, insert * ends[:, :a]
    xc = rows[sizes, 4, pairs]
    with np.errstate(divide="ignore"):
        total = np.log(xc * move)
    own = (lambda b, n, m: (keep[0][: n + 1, :m, b], keep[1][: n + 1, :m, b])) if full else (lambda b, n, m: (None, None))
    return [Specials(rows[: n + 1, :, b], scale[: n + 1, b], float(total[b] + scale[: n + 1, b].sum()) if xc[b] > 0 else NEG, *own(b, n, m_of[b])) for b, n in enumerate(sizes)]


def backwards(ps: list[Profile], codes: list[np.ndarray], loops: float = 1.0, full: bool = False, lengths: np.ndarray | None = None) -> list[Specials]:
    """Backward of each pair, as `forwards`; targets are walked from their ends, so all begin at once."""
    grid, running = padded([c[::-1] for c in codes])
    size, p = len(codes), ps[0]
    odds, which = tabled(ps, lambda q: q.odds, 0.0, np.float64)
    width, m_of = odds.shape[1], np.array([q.m for q in ps])
    inside = (np.arange(width)[:, None] < m_of).astype(float)
    sizes = np.array([len(c) for c in codes])
    move, loop = _moves((sizes if lengths is None else np.asarray(lengths)).astype(float), loops)
    e_j, e_c = (0.5, 0.5) if loops else (0.0, 1.0)
    mm, mi, md = 1 - p.to_insert - p.to_delete, p.to_insert, p.to_delete
    im, ii, dm, dd = 1 - p.insert_again, p.insert_again, 1 - p.delete_again, p.delete_again
    entry, pairs, chain = np.array([q.entry for q in ps]), np.arange(size), _chained(width, dd)
    chain = None if chain is None else np.ascontiguousarray(chain.T)
    match, insert = np.zeros((width, size)), np.zeros((width, size))
    rows, scale = np.zeros((len(grid) + 1, 5, size)), np.zeros((len(grid) + 1, size))
    keep = [np.zeros((len(grid) + 1, width, size)) for _ in range(2)] if full else None
    xn, xj, xc = np.zeros(size), np.zeros(size), np.array(move)
    before = size + 1
    for s, a in enumerate([size, *running.tolist()]):
        if a < before:
            match, insert, inside, before = match[:, :a].copy(), insert[:, :a].copy(), inside[:, :a], a
            xn, xj, xc, loop, move, entry, which, last = xn[:a], xj[:a], xc[:a], loop[:a], move[:a], entry[:a], which[:a], m_of[:a] - 1
        if s:
            emitted = match * odds[which + grid[s - 1, :a]].T  # what follows if the next residue is emitted by each match state
            xb = emitted.sum(axis=0) * entry
            xj, xc, xn = xj * loop + xb * move, xc * loop, xn * loop + xb * move
        else:
            emitted, xb = np.zeros((width, size)), np.zeros(size)
        xe = xj * e_j + xc * e_c
        follow = np.zeros((width, a))
        follow[:-1] = emitted[1:]
        delete = follow * dm
        delete[last, pairs[:a]] += xe
        if chain is not None and a <= FEW:
            delete = chain @ delete
        else:
            lines = list(delete)[::-1]
            for y, z in zip(lines, lines[1:], strict=False):
                z += y * dd
        match = follow * mm + insert * mi + xe
        match[:-1] += delete[1:] * md
        match *= inside
        insert *= ii
        insert += follow * im
        most = match.max(axis=0)
        top = np.maximum(np.maximum(np.maximum(xe, xn), np.maximum(xj, xc)), most)
        if top.max() > 1e4 or top.min() < 1e-4:
            off = np.flatnonzero((top > 1e4) | ((top > 0) & (top < 1e-4)))
            by = top[off]
            for x in (match, insert):
                x[:, off] /= by
            for x in (xe, xn, xj, xb, xc):
                x[off] /= by
            scale[s, off] = np.log(by)
        for x, y in zip(rows[s], (xe, xn, xj, xb, xc), strict=True):
            x[:a] = y
        if full:
            keep[0][s, :, :a], keep[1][s, :, :a] = match, insert
    out = []
    for b, n in enumerate(sizes):
        own, factors = rows[n::-1, :, b], scale[n::-1, b]
        kept = (keep[0][n::-1, : m_of[b], b], keep[1][n::-1, : m_of[b], b]) if full else (None, None)
        out.append(Specials(own, factors, float(np.log(own[0, 1]) + factors.sum()) if own[0, 1] > 0 else NEG, *kept))
    return out


def rescored(ps: list[Profile], codes: list[np.ndarray], spans: list[tuple[int, int]]) -> list[Domain]:
    """`kernels.rescored` of many segments, each with its profile, its whole target and its first and last residue."""
    parts, out = [c[b - 1 : e] for c, (b, e) in zip(codes, spans, strict=True)], [None] * len(ps)
    width = max((p.m for p in ps), default=1)
    sizes = np.array([len(c) for c in parts], dtype=int)
    for at in cut(sizes * width, DOMAINS):
        own, part, whole = [ps[k] for k in at], [parts[k] for k in at], np.array([len(codes[k]) for k in at])
        fs, bs = (run(own, part, 0.0, True, whole) for run in (forwards, backwards))
        known = [occupied(p, c, f, b, int(n)) for p, c, f, b, n in zip(own, part, fs, bs, whole, strict=True)]
        rows, width_ = int(sizes[at].max()) + 1, max(p.m for p in own)
        match, insert, xn = np.zeros((rows, len(at), width_)), np.zeros((rows, len(at), width_)), np.zeros((rows, len(at), 1))
        for k, (m, i, outside, _) in enumerate(known):
            match[: len(m), k, : m.shape[1]], insert[: len(i), k, : i.shape[1]] = m, i
            xn[1 : len(outside), k, 0] = np.cumsum(outside[1:])
        gain_m, gain_i, gain_d = (np.full(match.shape, NEG) for _ in range(3))
        for r in range(1, rows):
            came = np.repeat(xn[r - 1], width_, axis=1)
            np.maximum(came[:, 1:], np.maximum(np.maximum(gain_m[r - 1, :, :-1], gain_i[r - 1, :, :-1]), gain_d[r - 1, :, :-1]), out=came[:, 1:])
            np.add(came, match[r], out=gain_m[r])
            np.add(np.maximum(gain_m[r - 1], gain_i[r - 1]), insert[r], out=gain_i[r])
            np.maximum.accumulate(gain_m[r, :, :-1], axis=1, out=gain_d[r, :, 1:])
        for k, (i, p, f, b, (m, n, _, correction)) in enumerate(zip(at.tolist(), own, fs, bs, known, strict=True)):
            to = sizes[i] + 1
            accuracy, trace = walked(spans[i][0], m, n, xn[:to, k, 0], *(g[:to, k, : p.m] for g in (gain_m, gain_i, gain_d)))
            out[i] = Domain(*spans[i], f.score, b.score, accuracy, correction, trace)
    return out
