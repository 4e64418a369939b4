"""Dynamic-programming kernels on arrays: one profile against one target (or many targets, end to end).

A profile is `Profile`: match odds by position and residue code, and transition probabilities that are the same at
every position. Local, multi-segment alignment: entry to every position with equal probability, free exit.
All sums are in double precision; scores are natural logarithms unless named otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

from helixtable.functions.alphabet import BACKGROUND, CANONICAL, MEMBERS, SYMBOLS, digits, expand
from helixtable.functions.scores import LN2

SCALE_BYTE = 3.0 / LN2
SCALE_WORD = 500.0 / LN2
BASE, TEC = 190, 3
NEG = -np.inf


@dataclass
class Profile:
    ordinal: int
    name: str
    consensus: str
    match: float = 0.85  # probability of the consensus residue
    to_insert: float = 0.01
    to_delete: float = 0.01
    insert_again: float = 0.5
    delete_again: float = 0.5

    @cached_property
    def m(self) -> int:
        return len(self.consensus)

    @cached_property
    def odds(self) -> np.ndarray:
        """(M, 29) match odds against the background."""
        own = np.zeros((self.m, CANONICAL))
        for k, c in enumerate(digits(self.consensus)):
            symbol = SYMBOLS[c]
            members = [SYMBOLS.index(x) for x in (symbol if c < CANONICAL else MEMBERS.get(symbol, SYMBOLS[:CANONICAL]))]
            rest = (1 - self.match) / (CANONICAL - len(members)) if len(members) < CANONICAL else 0.0
            own[k] = rest
            own[k, members] = (self.match if len(members) < CANONICAL else 1.0) / len(members)
        return expand(own / BACKGROUND)

    @cached_property
    def gains(self) -> np.ndarray:
        """(M, 29) match scores in scaled byte units."""
        return np.round(SCALE_BYTE * np.log(self.odds)).astype(np.int16)

    @cached_property
    def bias(self) -> int:
        return int(max(0, -self.gains.min()))

    @cached_property
    def tbm(self) -> int:
        return min(255, int(np.round(-SCALE_BYTE * np.log(2.0 / (self.m * (self.m + 1))))))

    @cached_property
    def composition(self) -> np.ndarray:
        """Mean emission probabilities of the 20 residues over the model's positions."""
        return (self.odds[:, :CANONICAL] * BACKGROUND).mean(axis=0)

    @cached_property
    def expected(self) -> np.ndarray:
        """The composition's odds of all 29 codes."""
        return expand(self.composition / BACKGROUND)

    @cached_property
    def emit(self) -> np.ndarray:
        """(M, 29) logarithms of the match odds."""
        with np.errstate(divide="ignore"):
            return np.log(self.odds)

    @cached_property
    def most(self) -> float:
        """The largest of them, 0 at least."""
        return max(0.0, float(self.emit.max()))

    @property
    def entry(self) -> float:
        return 2.0 / (self.m * (self.m + 1))


def segment_gains(profiles: list[Profile], residues: np.ndarray, starts: np.ndarray, slice_: int = 1 << 17, narrow: bool = True) -> np.ndarray:
    """(targets, profiles) best ungapped diagonal gain, 0 at least. residues: targets end to end, each ended by a code of 255.

    Model positions are walked in turn; a step is one vector operation over all target positions, in pieces that stay in
    cache. Positions of equal gains, of any profile, share one row of gains looked up for the piece's residues. Sums are
    bytes; a pair whose sum came so near to their end that the next one might not fit is walked again in 16 bits.
    """
    best = np.zeros((len(starts), len(profiles)), dtype=np.int32)
    kinds: dict[bytes, int] = {}
    rows = [[kinds.setdefault(r.tobytes(), len(kinds)) for r in p.gains] for p in profiles]
    tables = np.full((len(kinds), len(SYMBOLS) + 1), -10_000, np.int16)  # the last column ends a target
    for key, at in kinds.items():
        tables[at, :-1] = np.frombuffer(key, np.int16)
    most = max(1, int(tables.max(initial=0)))
    if narrow := narrow and most <= 63 and int(tables[:, :-1].min(initial=0)) >= -128:
        tables = np.maximum(tables, -128).astype(np.int8)
    cuts = [0]
    for s in starts[1:]:
        if s - cuts[-1] >= slice_:
            cuts.append(int(s))
    cuts.append(len(residues))
    for low, high in zip(cuts, cuts[1:], strict=False):
        own = np.flatnonzero((starts >= low) & (starts < high))
        if not len(own):
            continue
        codes = residues[low:high]
        safe = np.where(codes == 255, len(SYMBOLS), codes)
        looked_up: dict[int, np.ndarray] = {}
        run, new, top = (np.empty(high - low, dtype=tables.dtype) for _ in range(3))
        zero = np.zeros(high - low, dtype=tables.dtype)  # a maximum of two arrays is vectorised, one of an array and a number is not
        for n, p in enumerate(rows):
            run[:] = 0
            top[:] = 0
            for kind in p:
                gains = looked_up.get(kind)
                if gains is None:
                    gains = looked_up[kind] = tables[kind][safe]
                new[0] = gains[0]
                np.add(run[:-1], gains[1:], out=new[1:])
                np.maximum(new, zero, out=new)
                np.maximum(top, new, out=top)
                run, new = new, run
            best[own, n] = np.maximum.reduceat(top, starts[own] - low)
        looked_up.clear()
    if narrow:
        ends = np.append(starts[1:], len(residues))
        for n in np.flatnonzero((best > 127 - most).any(axis=0)):
            again = np.flatnonzero(best[:, n] > 127 - most)
            parts = [residues[starts[k] : ends[k]] for k in again]
            best[again, n] = segment_gains([profiles[n]], np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])]), slice_, False)[:, 0]
    return best


def coarse_gains(profile: Profile, classes: np.ndarray) -> Profile:
    """The profile with each residue's gain raised to the best of its class: its gains bound the exact ones from above."""
    out = Profile(profile.ordinal, profile.name, profile.consensus)
    g = profile.gains.copy()
    for c in np.unique(classes):
        at = np.flatnonzero(classes == c)
        g[:, at] = profile.gains[:, at].max(axis=1, keepdims=True)
    out.__dict__["gains"] = g
    return out


def multi_segment(p: Profile, codes: np.ndarray, tjb: int) -> tuple[str, int]:
    """Status and best state value of the byte-valued multi-segment filter."""
    costs = (p.bias - p.gains).astype(np.int32)  # biased: 0 at least
    step = tjb + p.tbm
    xj, xb = 0, max(0, BASE - step)
    row = np.zeros(p.m + 1, dtype=np.int32)
    for c in codes:
        score = np.minimum(np.maximum(row[:-1], xb) + p.bias, 255) - costs[:, c]
        np.maximum(score, 0, out=score)
        row[1:] = score
        xe = int(score.max())
        if xe + p.bias >= 255:
            return "OVERFLOW", xe
        xj = max(xj, xe - TEC)
        xb = max(0, max(BASE, xj) - step)
    return "OK", xj


def bias_score(p: Profile, codes: np.ndarray) -> float:
    """Log-probability of the target under a two-state model of background and the profile's composition, with the length terms."""
    n = len(codes)
    if not n:
        return NEG
    expected = expand(p.composition / BACKGROUND)
    p1 = n / (n + 1)
    # state 0 is background with the target's length, state 1 the composition with a mean stay of M residues
    stay = p.m / (p.m + 1)
    step = np.array([[p1, 1 - p1], [1 - stay, stay]])
    state = np.array([0.999, 0.001 * expected[codes[0]]])
    score = 0.0
    for c in codes[1:]:
        top = state.max()
        score += np.log(top)
        state = (state / top) @ step
        state[1] *= expected[c]
    return float(score + np.log(state.sum()) + n * np.log(p1) + np.log(1 - p1))


def _moves(n: int, loops: float) -> tuple[float, float]:
    move = (2.0 + loops) / (n + 2.0 + loops)
    return move, 1 - move


def viterbi(p: Profile, codes: np.ndarray, loops: float = 1.0) -> float:
    """Log-odds of the best multi-segment alignment with insertions and deletions."""
    n = len(codes)
    move, loop = map(np.log, _moves(n, loops))
    e_j = np.log(0.5) if loops else NEG
    e_c = np.log(0.5) if loops else 0.0
    mm, mi, md = np.log(1 - p.to_insert - p.to_delete), np.log(p.to_insert), np.log(p.to_delete)
    im, ii, dm, dd = np.log(1 - p.insert_again), np.log(p.insert_again), np.log(1 - p.delete_again), np.log(p.delete_again)
    entry, emit, slope = np.log(p.entry), np.log(p.odds), dd * np.arange(p.m)
    match, insert, delete = (np.full(p.m, NEG) for _ in range(3))
    xn, xj, xc = 0.0, NEG, NEG
    xb = xn + move
    shift = lambda a: np.concatenate([[NEG], a[:-1]])
    for c in codes:
        best = np.maximum(np.maximum(shift(match) + mm, shift(insert) + im), np.maximum(shift(delete) + dm, xb + entry))
        insert = np.maximum(match + mi, insert + ii)
        insert[-1] = NEG
        match = best + emit[:, c]
        delete = np.maximum.accumulate(shift(match) + md - slope) + slope
        xe = max(match.max(), delete[-1])
        xj, xc, xn = max(xj + loop, xe + e_j), max(xc + loop, xe + e_c), xn + loop
        xb = max(xn, xj) + move
    return float(xc + move)


def _scan(x: np.ndarray, a: float, block: int = 128) -> np.ndarray:
    """y[k] = x[k] + a y[k - 1]."""
    out, carry = np.empty_like(x), 0.0
    for s in range(0, len(x), block):
        part = x[s : s + block]
        powers = a ** np.arange(len(part))
        out[s : s + block] = powers * (np.cumsum(part / powers) + carry * a)
        carry = out[min(s + block, len(x)) - 1]
    return out


@dataclass
class Specials:
    """Scaled values of the states outside the model by row: columns E, N, J, B, C; scale is each row's log factor."""

    rows: np.ndarray
    scale: np.ndarray
    score: float
    match: np.ndarray | None = None
    insert: np.ndarray | None = None


def forward(p: Profile, codes: np.ndarray, loops: float = 1.0, full: bool = False, length: int | None = None) -> Specials:
    """Log-odds summed over all alignments. length: of the whole target, for the length model of an isolated segment."""
    n = len(codes)
    move, loop = _moves(length or n, loops)
    e_j, e_c = (0.5, 0.5) if loops else (0.0, 1.0)
    mm, mi, md = 1 - p.to_insert - p.to_delete, p.to_insert, p.to_delete
    im, ii, dm, dd = 1 - p.insert_again, p.insert_again, 1 - p.delete_again, p.delete_again
    match, insert, delete = (np.zeros(p.m) for _ in range(3))
    rows, scale = np.zeros((n + 1, 5)), np.zeros(n + 1)
    xn, xj, xc = 1.0, 0.0, 0.0
    xb = move
    rows[0] = 0, xn, xj, xb, xc
    keep_m = np.zeros((n + 1, p.m)) if full else None
    keep_i = np.zeros((n + 1, p.m)) if full else None
    shift = lambda a: np.concatenate([[0.0], a[:-1]])
    for i, c in enumerate(codes, 1):
        new = (shift(match) * mm + shift(insert) * im + shift(delete) * dm + xb * p.entry) * p.odds[:, c]
        insert = match * mi + insert * ii
        insert[-1] = 0
        match = new
        delete = _scan(shift(match) * md, dd)
        xe = match.sum() + delete[-1]
        xj, xc, xn = xj * loop + xe * e_j, xc * loop + xe * e_c, xn * loop
        xb = (xn + xj) * move
        top = max(xe, xn, xj, xc)
        if top > 1e4 or top < 1e-4:
            match, insert, delete = match / top, insert / top, delete / top
            xe, xn, xj, xb, xc = xe / top, xn / top, xj / top, xb / top, xc / top
            scale[i] = np.log(top)
        rows[i] = xe, xn, xj, xb, xc
        if full:
            keep_m[i], keep_i[i] = match, insert
    total = float(np.log(xc * move) + scale.sum()) if xc > 0 else NEG
    return Specials(rows, scale, total, keep_m, keep_i)


def backward(p: Profile, codes: np.ndarray, loops: float = 1.0, full: bool = False, length: int | None = None) -> Specials:
    """The mirror of forward: the probability of what follows each row."""
    n = len(codes)
    move, loop = _moves(length or n, loops)
    e_j, e_c = (0.5, 0.5) if loops else (0.0, 1.0)
    mm, mi, md = 1 - p.to_insert - p.to_delete, p.to_insert, p.to_delete
    im, ii, dm, dd = 1 - p.insert_again, p.insert_again, 1 - p.delete_again, p.delete_again
    rows, scale = np.zeros((n + 1, 5)), np.zeros(n + 1)
    keep_m = np.zeros((n + 1, p.m)) if full else None
    keep_i = np.zeros((n + 1, p.m)) if full else None
    xc, xj, xn, xb = move, 0.0, 0.0, 0.0
    match = insert = emitted = np.zeros(p.m)
    back = lambda a: np.concatenate([a[1:], [0.0]])
    for i in range(n, -1, -1):
        if i < n:
            emitted = match * p.odds[:, codes[i]]  # what follows if residue i + 1 is emitted by each match state
            xb = emitted.sum() * p.entry
            xj, xc, xn = xj * loop + xb * move, xc * loop, xn * loop + xb * move
        xe = xj * e_j + xc * e_c
        follow = back(emitted)
        last = np.zeros(p.m)
        last[-1] = xe
        delete = _scan((follow * dm + last)[::-1], dd)[::-1]
        next_insert = insert
        match = follow * mm + next_insert * mi + back(delete) * md + xe
        insert = follow * im + next_insert * ii
        insert[-1] = 0
        top = max(xe, xn, xj, xc, match.max())
        if top > 1e4 or 0 < top < 1e-4:
            match, insert = match / top, insert / top
            xe, xn, xj, xb, xc = xe / top, xn / top, xj / top, xb / top, xc / top
            scale[i] = np.log(top)
        rows[i] = xe, xn, xj, xb, xc
        if full:
            keep_m[i], keep_i[i] = match, insert
    return Specials(rows, scale, float(np.log(rows[0, 1]) + scale.sum()) if rows[0, 1] > 0 else NEG, keep_m, keep_i)


def posteriors(f: Specials, b: Specials, loop: float) -> np.ndarray:
    """(L + 1, 3): cumulative expected starts and ends of segments, and the probability that a residue is in one."""
    before, after = np.cumsum(f.scale), np.cumsum(b.scale[::-1])[::-1]
    joint = np.exp(before + after - f.score)  # both sides meet in the same row
    n = len(joint) - 1
    starts = np.concatenate([[0.0], f.rows[:-1, 3] * b.rows[:-1, 3] * joint[:-1]])
    ends = f.rows[:, 0] * b.rows[:, 0] * joint
    across = np.exp(before[:-1] + after[1:] - f.score) * loop
    outside = (f.rows[:-1, [1, 2, 4]] * b.rows[1:, [1, 2, 4]]).sum(axis=1) * across
    out = np.zeros((n + 1, 3))
    out[:, 0], out[:, 1] = np.cumsum(starts), np.cumsum(ends)
    out[1:, 2] = 1 - outside
    return out


def regions(track: np.ndarray, rt1: float = 0.25, rt2: float = 0.10, rt3: float = 0.20, guard: float = 0.0) -> tuple[list[tuple[int, int, bool]], int]:
    """(begin, end, several segments) of each closed region, 1-based and inclusive; and how many comparisons fell within the guard."""
    out, begin, triggered, uncertain = [], None, False, 0
    near = lambda x, t: int(abs(x - t) <= guard) if guard else 0
    moves = np.diff(track[:, :2], axis=0).tolist()
    for j, ((b, e), inside) in enumerate(zip(moves, track[1:, 2].tolist(), strict=True), 1):
        if not triggered:
            uncertain += near(inside, rt1) + near(inside - b, rt2)
            if begin is None or inside - b < rt2:
                begin = j
            triggered = inside >= rt1
        else:
            uncertain += near(inside - e, rt2)
            if inside - e < rt2:
                z = np.arange(begin, j + 1)
                split = np.minimum(track[z, 1] - track[begin - 1, 1], track[j, 0] - track[z - 1, 0]).max()
                uncertain += near(split, rt3)
                out.append((begin, j, bool(split >= rt3)))
                begin, triggered = None, False
    return out, uncertain


@dataclass
class Domain:
    begin: int
    end: int
    forward: float
    backward: float
    accuracy: float
    correction: float
    trace: list[tuple[str, int, int, float]]  # state, model position, target position, posterior


def occupied(p: Profile, part: np.ndarray, f: Specials, b: Specials, whole: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Posteriors of match and insert states and of what is outside, by row, and the composition correction of an isolated segment."""
    n, loop = len(part), _moves(whole, 0.0)[1]
    joint = np.exp(np.cumsum(f.scale) + np.cumsum(b.scale[::-1])[::-1] - f.score)
    match, insert = f.match * b.match * joint[:, None], f.insert * b.insert * joint[:, None]
    outside = 1 - posteriors(f, b, loop)[:, 2]
    use_m, use_i, use_x = match[1:].sum(axis=0) / n, insert[1:].sum(axis=0) / n, outside[1:].sum() / n
    null2 = expand(use_m @ p.odds[:, :CANONICAL] + use_i.sum() + use_x)
    return match, insert, outside, float(np.log(null2[part]).sum())


def rescored(p: Profile, codes: np.ndarray, begin: int, end: int) -> Domain:
    """One segment on its own: Forward, Backward, decoding, composition correction, and its most accurate alignment."""
    part = codes[begin - 1 : end]
    n = len(part)
    f, b = (run(p, part, 0.0, True, len(codes)) for run in (forward, backward))
    match, insert, outside, correction = occupied(p, part, f, b, len(codes))
    # most accurate alignment: the largest sum of posteriors, one path of M, I and D within the model
    gain_m = np.full((n + 1, p.m), NEG)
    gain_i = np.full((n + 1, p.m), NEG)
    gain_d = np.full((n + 1, p.m), NEG)
    xn = np.concatenate([[0.0], np.cumsum(outside[1:])])
    shift = lambda a: np.concatenate([[NEG], a[:-1]])
    for i in range(1, n + 1):
        came = np.maximum(np.maximum(shift(gain_m[i - 1]), shift(gain_i[i - 1])), np.maximum(shift(gain_d[i - 1]), xn[i - 1]))
        gain_m[i] = came + match[i]
        gain_i[i] = np.maximum(gain_m[i - 1], gain_i[i - 1]) + insert[i]
        gain_d[i] = np.maximum.accumulate(shift(gain_m[i]))
    accuracy, trace = walked(begin, match, insert, xn, gain_m, gain_i, gain_d)
    return Domain(begin, end, f.score, b.score, accuracy, correction, trace)


def walked(begin: int, match: np.ndarray, insert: np.ndarray, xn: np.ndarray, gain_m: np.ndarray, gain_i: np.ndarray, gain_d: np.ndarray) -> tuple[float, list[tuple[str, int, int, float]]]:
    """The accuracy and the path of the best gains of an isolated segment."""
    exits, tail = gain_m.max(axis=1), xn[-1] - xn
    stop = int((exits + tail).argmax())
    k, i, state, trace = int(gain_m[stop].argmax()), stop, "M", []
    while True:
        trace.append((state, k + 1, begin + i - 1 if state != "D" else 0, float({"M": match[i, k], "I": insert[i, k]}.get(state, 0.0))))
        if state == "M":
            choices = {"B": xn[i - 1]}
            if k:
                choices |= {"M": gain_m[i - 1, k - 1], "I": gain_i[i - 1, k - 1], "D": gain_d[i - 1, k - 1]}
            i, k = i - 1, k - 1
            came_from = max(("M", "I", "D", "B"), key=lambda s: choices.get(s, NEG))
        elif state == "I":
            came_from = "M" if gain_m[i - 1, k] >= gain_i[i - 1, k] else "I"
            i -= 1
        else:
            came_from = "M" if gain_m[i, k - 1] >= gain_d[i, k - 1] else "D"
            k -= 1
        if came_from == "B":
            break
        state = came_from
    return float((exits + tail)[stop]), trace[::-1]
