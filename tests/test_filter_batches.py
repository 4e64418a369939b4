"""Byte-wide gains, gains that settle the multi-segment filter, and batches of each filter's own."""

import numpy as np

from helixtable.functions.alphabet import SYMBOLS
from helixtable.operators import batches as B
from helixtable.operators import kernels as K


def _pairs(rng, copies):
    profiles = [K.Profile(k, "", "".join(rng.choice(list(SYMBOLS[:20]), m))) for k, m in enumerate((1, 3, 20, 40, 59))]
    out = []
    for p in profiles:
        for n in (1, 2, 17, 300, 900):
            codes = rng.integers(0, 20, n)
            if copies and n > p.m:
                at = rng.integers(0, n - p.m + 1)
                codes[at : at + p.m] = [SYMBOLS.index(c) for c in p.consensus]
            out.append((p, codes))
    return profiles, out


def test_gains_above_a_byte_are_exact():
    profiles, pairs = _pairs(np.random.default_rng(1), True)
    codes = [c for _, c in pairs]
    flat, starts = np.concatenate([np.append(c, 255) for c in codes]).astype(np.uint8), np.cumsum([0, *(len(c) + 1 for c in codes[:-1])])
    got = K.segment_gains(profiles, flat, starts)
    assert np.array_equal(got, K.segment_gains(profiles, flat, starts, narrow=False))
    assert got.max() > 127
    p, c = pairs[-1]
    plain = max(max((s := max(0, s + int(p.gains[k, c[k + d]]))) for k in range(p.m) if 0 <= k + d < len(c)) for d in range(1 - p.m, len(c)) if (s := 0) == 0)
    assert got[-1, -1] == plain


def test_gains_settle_the_multi_segment_filter():
    for copies in (False, True):
        profiles, pairs = _pairs(np.random.default_rng(2), copies)
        codes, ps = [c for _, c in pairs], [p for p, _ in pairs]
        flat, starts = np.concatenate([np.append(c, 255) for c in codes]).astype(np.uint8), np.cumsum([0, *(len(c) + 1 for c in codes[:-1])])
        gains = K.segment_gains(profiles, flat, starts)[np.arange(len(ps)), [p.ordinal for p in ps]]
        tjb = np.array([min(255, -round(K.SCALE_BYTE * np.log(3 / (len(c) + 3)))) for c in codes])
        settled = B.single_segments(ps, gains, tjb)
        exact = [K.multi_segment(p, c, int(t)) for (p, c), t in zip(pairs, tjb, strict=True)]
        assert (settled >= 0).any() and (copies is False or (settled < 0).any())
        assert all(s < 0 or ("OK", s) == e for s, e in zip(settled.tolist(), exact, strict=True))


def test_batches_of_unlike_lengths_and_widths_equal_single_pairs():
    _, pairs = _pairs(np.random.default_rng(3), True)
    order = sorted(range(len(pairs)), key=lambda k: -len(pairs[k][1]))
    ps, codes = [pairs[k][0] for k in order], [pairs[k][1] for k in order]
    assert np.allclose(B.viterbis(ps, codes), [K.viterbi(p, c) for p, c in zip(ps, codes, strict=True)], atol=1e-9)
    assert np.allclose([f.score for f in B.forwards(ps, codes)], [K.forward(p, c).score for p, c in zip(ps, codes, strict=True)], atol=1e-9)
    assert sorted(np.concatenate(B.cut(np.array([len(c) for c in codes]), 4)).tolist()) == list(range(len(codes)))
