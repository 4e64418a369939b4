"""Kernels against scalar versions written from the definitions."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixtable.functions import scores as S
from helixtable.functions.alphabet import SYMBOLS, digits
from helixtable.operators import batches as B
from helixtable.operators import kernels as K

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
words = st.text(RESIDUES, min_size=1, max_size=14)


def lse(*xs):
    top = max(xs)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in xs))


def scalar_gain(p, codes):
    best, row = 0, [0] * (p.m + 1)
    for c in codes:
        new = [0] * (p.m + 1)
        for k in range(1, p.m + 1):
            new[k] = max(0, row[k - 1] + int(p.gains[k - 1][c]))
            best = max(best, new[k])
        row = new
    return best


def scalar_total(p, codes, loops, combine):
    """Forward (combine = lse) or Viterbi (combine = max) by the definition, cell by cell in log space."""
    n, inf = len(codes), -math.inf
    move, loop = math.log((2 + loops) / (n + 2 + loops)), math.log(1 - (2 + loops) / (n + 2 + loops))
    ej, ec = (math.log(0.5), math.log(0.5)) if loops else (inf, 0.0)
    t = {k: math.log(v) for k, v in {"mm": 1 - p.to_insert - p.to_delete, "mi": p.to_insert, "md": p.to_delete, "im": 1 - p.insert_again, "ii": p.insert_again, "dm": 1 - p.delete_again, "dd": p.delete_again, "b": p.entry}.items()}
    m, i, d = ([inf] * (p.m + 1) for _ in range(3))
    xn, xj, xc, xb = 0.0, inf, inf, move
    for c in codes:
        nm, ni, nd = ([inf] * (p.m + 1) for _ in range(3))
        for k in range(1, p.m + 1):
            nm[k] = combine(m[k - 1] + t["mm"], i[k - 1] + t["im"], d[k - 1] + t["dm"], xb + t["b"]) + math.log(p.odds[k - 1][c])
            if k < p.m:
                ni[k] = combine(m[k] + t["mi"], i[k] + t["ii"])
            nd[k] = combine(nm[k - 1] + t["md"], nd[k - 1] + t["dd"])
        m, i, d = nm, ni, nd
        xe = combine(*m[1:], d[p.m])
        xj, xc, xn = combine(xj + loop, xe + ej), combine(xc + loop, xe + ec), xn + loop
        xb = combine(xn, xj) + move
    return xc + move


@settings(max_examples=60, deadline=None)
@given(words, st.lists(words, min_size=1, max_size=4))
def test_segment_gains(consensus, targets):
    p = K.Profile(0, "p", consensus)
    codes = [np.append(digits(t), 255).astype(np.uint8) for t in targets]
    starts = np.concatenate([[0], np.cumsum([len(c) for c in codes])[:-1]])
    got = K.segment_gains([p, p], np.concatenate(codes), starts, slice_=8)
    assert got[:, 0].tolist() == got[:, 1].tolist() == [scalar_gain(p, digits(t)) for t in targets]


@settings(max_examples=40, deadline=None)
@given(words, words, st.sampled_from([0.0, 1.0]))
def test_forward_backward_viterbi(consensus, target, loops):
    p, codes = K.Profile(0, "p", consensus), digits(target)
    total = scalar_total(p, codes, loops, lse)
    assert K.forward(p, codes, loops).score == pytest.approx(total, abs=1e-9)
    assert K.backward(p, codes, loops).score == pytest.approx(total, abs=1e-9)
    assert K.viterbi(p, codes, loops) == pytest.approx(scalar_total(p, codes, loops, max), abs=1e-9)


def test_long_target_keeps_its_scale():
    p = K.Profile(0, "p", "ACDEFGHIKL" * 30)
    codes = digits(("ACDEFGHIKL" * 30 + "W" * 50) * 4)
    f, b = K.forward(p, codes), K.backward(p, codes)
    assert f.score == pytest.approx(b.score, rel=1e-9) and f.score > 1000
    track = K.posteriors(f, b, K._moves(len(codes), 1.0)[1])
    assert ((track[:, 2] > -1e-6) & (track[:, 2] < 1 + 1e-6)).all()
    assert track[-1, 0] == pytest.approx(track[-1, 1], rel=1e-6)


@settings(max_examples=40, deadline=None)
@given(words, words, st.integers(0, 60))
def test_multi_segment(consensus, target, tjb):
    p, codes = K.Profile(0, "p", consensus), digits(target)
    row, xj, xb, status = [0] * (p.m + 1), 0, max(0, K.BASE - tjb - p.tbm), "OK"
    for c in codes:
        new, xe = [0] * (p.m + 1), 0
        for k in range(1, p.m + 1):
            new[k] = max(0, min(255, max(row[k - 1], xb) + p.bias) - (p.bias - int(p.gains[k - 1][c])))
            xe = max(xe, new[k])
        row = new
        if xe + p.bias >= 255:
            status = "OVERFLOW"
            break
        xj = max(xj, xe - K.TEC)
        xb = max(0, max(K.BASE, xj) - tjb - p.tbm)
    got = K.multi_segment(p, codes, tjb)
    assert got[0] == status and (status != "OK" or got[1] == xj)


def test_coarse_gains_bound_exact_ones():
    rng = np.random.default_rng(1)
    classes = np.arange(len(SYMBOLS)) // 3
    for _ in range(20):
        p = K.Profile(0, "p", "".join(rng.choice(list(RESIDUES), 12)))
        codes = digits("".join(rng.choice(list(RESIDUES), 60)))
        assert scalar_gain(K.coarse_gains(p, classes), codes) >= scalar_gain(p, codes)


def test_planted_copy_is_found_and_aligned():
    p = K.Profile(0, "p", "ACDEFGHIKLWWYVMNPQRS")
    target = "T" * 24 + "ACDEFGHIKLWWYVMNPQRS" + "T" * 24
    codes = digits(target)
    f, b = K.forward(p, codes), K.backward(p, codes)
    regions, _ = K.regions(K.posteriors(f, b, K._moves(len(codes), 1.0)[1]))
    assert [(x, y) for x, y, _ in regions] == [(25, 44)]
    d = K.rescored(p, codes, 25, 44)
    assert d.forward == pytest.approx(d.backward)
    assert [t[:3] for t in d.trace] == [("M", k, 24 + k) for k in range(1, 21)]


def test_degenerate_and_gap_codes():
    p = K.Profile(0, "p", "ABJZOUX")
    assert p.odds.shape == (7, 29) and np.isfinite(p.odds).all()
    assert p.odds[4][SYMBOLS.index("K")] == p.odds[4].max()
    assert p.odds[0][SYMBOLS.index("*")] == 1
    with pytest.raises(ValueError):
        digits("A1")


@pytest.mark.parametrize("threshold", [0.0, 1e-300, 1e-5, 0.02, 0.5, 1.0])
@pytest.mark.parametrize(("mu", "rate"), [(-7.5, math.log(2)), (3.0, 0.1), (0.0, 1e-30)])
def test_compiled_cutoff(threshold, mu, rate):
    mode, x = S.compiled_cutoff(lambda v: S.gumbel(v, mu, rate), threshold)
    if mode == "SCORE":
        assert S.gumbel(x, mu, rate) <= threshold < S.gumbel(S.from_ordered_key(S.ordered_key(x) - 1), mu, rate)
    elif mode == "ALWAYS_PASS":
        assert S.gumbel(-3.4e38, mu, rate) <= threshold
    else:
        assert S.gumbel(3.4e38, mu, rate) > threshold


@given(st.floats(width=32, allow_nan=False), st.floats(width=32, allow_nan=False))
def test_ordered_key(a, b):
    assert S.from_ordered_key(S.ordered_key(a)) == a
    if a < b:
        assert S.ordered_key(a) < S.ordered_key(b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=6), st.sampled_from([0.0, 1.0]))
def test_batches_equal_one_pair_kernels(pairs, loops):
    pairs.sort(key=lambda x: -len(x[1]))
    ps, codes = [K.Profile(0, "p", x) for x, _ in pairs], [digits(t) for _, t in pairs]
    tjb = np.arange(len(codes)) * 7
    over, xj = B.multi_segments(ps, codes, tjb)
    for p, c, t, o, x in zip(ps, codes, tjb, over, xj, strict=True):
        status, best = K.multi_segment(p, c, int(t))
        assert (status == "OVERFLOW") == o and (o or best == x)
    assert B.bias_scores(ps, codes) == pytest.approx([K.bias_score(p, c) for p, c in zip(ps, codes, strict=True)], abs=1e-9)
    assert B.viterbis(ps, codes, loops) == pytest.approx([K.viterbi(p, c, loops) for p, c in zip(ps, codes, strict=True)], abs=1e-9)
    for got, p, c in zip(B.forwards(ps, codes, loops), ps, codes, strict=True):
        want = K.forward(p, c, loops)
        assert got.score == pytest.approx(want.score, abs=1e-9) and np.allclose(got.rows, want.rows) and np.allclose(got.scale, want.scale)


def test_batches_of_long_models_and_targets():
    rng = np.random.default_rng(5)
    ps = [K.Profile(0, "p", "".join(rng.choice(list(RESIDUES), n))) for n in (300, 40, 129)]
    codes = [digits(ps[0].consensus * 3), digits("".join(rng.choice(list(RESIDUES), 400))), digits("A")]
    assert [s.score for s in B.forwards(ps, codes)] == pytest.approx([K.forward(p, c).score for p, c in zip(ps, codes, strict=True)], abs=1e-8)
    parts = B.cut(np.array([B.CELLS * 2, 5, 7] + [1] * 600))
    assert sorted(np.concatenate(parts).tolist()) == list(range(603)) and parts[0].tolist() == [0] and max(map(len, parts)) <= B.ROWS


def scalar_bias(p, codes):
    """The two-state model by enumeration in log space."""
    n = len(codes)
    p1, stay, odds = n / (n + 1), p.m / (p.m + 1), K.expand(p.composition / K.BACKGROUND)
    state = [math.log(0.999), math.log(0.001 * odds[codes[0]])]
    for c in codes[1:]:
        state = [lse(state[0] + math.log(p1), state[1] + math.log(1 - stay)), lse(state[0] + math.log(1 - p1), state[1] + math.log(stay)) + math.log(odds[c])]
    return lse(*state) + n * math.log(p1) + math.log(1 - p1)


@settings(max_examples=40, deadline=None)
@given(words, words)
def test_bias_score(consensus, target):
    p = K.Profile(0, "p", consensus)
    assert K.bias_score(p, digits(target)) == pytest.approx(scalar_bias(p, digits(target)), abs=1e-9)
