"""Filters over targets laid end to end, batches of Backward and of segments, and the search whose stages share a task."""

import numpy as np
import pytest

from helixtable.functions.alphabet import SYMBOLS
from helixtable.operators import batches as B
from helixtable.operators import flat as L
from helixtable.operators import kernels as K
from helixtable.plans import search as P
from helixtable.sources import tables as T


def _pairs(seed=5):
    """Pairs without copies, with other symbols, and with one or many copies of the profile, in no order."""
    rng, out = np.random.default_rng(seed), []
    for k, m in enumerate((1, 2, 20, 59)):
        p = K.Profile(k, "", "".join(rng.choice(list(SYMBOLS[:20]), m)))
        for n in (1, 2, 3, 32, 33, 34, 300, 900):
            for copies in (0, 1, 9):
                codes = rng.integers(0, 29 if copies == 1 else 20, n).astype(np.uint8)
                for _ in range(copies if n > m else 0):
                    at = rng.integers(0, n - m + 1)
                    codes[at : at + m] = [SYMBOLS.index(x) for x in p.consensus]
                out.append((p, codes))
    out = [out[k] for k in rng.permutation(len(out))]
    return [p for p, _ in out], [c for _, c in out]


@pytest.mark.parametrize("residues", [1 << 15, 700, 1])
def test_flat_filters_equal_single_pairs(residues, monkeypatch):
    monkeypatch.setattr(L, "RESIDUES", residues)
    ps, codes = _pairs()
    tjb = np.array([min(255, -round(K.SCALE_BYTE * np.log(3 / (len(c) + 3)))) for c in codes])
    over, xj = L.multi_segments(ps, codes, tjb)
    exact = [K.multi_segment(p, c, int(t)) for p, c, t in zip(ps, codes, tjb, strict=True)]
    assert {s for s, _ in exact} == {"OK", "OVERFLOW"}
    assert all(o == (s == "OVERFLOW") and (o or x == e) for (s, e), o, x in zip(exact, over, xj, strict=True))
    assert L.bias_scores(ps, codes) == pytest.approx([K.bias_score(p, c) for p, c in zip(ps, codes, strict=True)], abs=1e-9)
    assert L.viterbis(ps, codes) == pytest.approx([K.viterbi(p, c) for p, c in zip(ps, codes, strict=True)], abs=1e-9)
    none = L.multi_segments([], [], tjb[:0]), L.bias_scores([], []), L.viterbis([], [])
    assert [len(x) for x in (*none[0], *none[1:])] == [0, 0, 0, 0]


def test_flat_filters_that_do_not_settle_in_a_round(monkeypatch):
    monkeypatch.setattr(L, "ROUNDS", 1)
    ps, codes = _pairs(6)
    tjb = np.array([min(255, -round(K.SCALE_BYTE * np.log(3 / (len(c) + 3)))) for c in codes])
    exact = [K.multi_segment(p, c, int(t)) for p, c, t in zip(ps, codes, tjb, strict=True)]
    over, xj = L.multi_segments(ps, codes, tjb)
    assert all(o == (s == "OVERFLOW") and (o or x == e) for (s, e), o, x in zip(exact, over, xj, strict=True))
    assert L.viterbis(ps, codes) == pytest.approx([K.viterbi(p, c) for p, c in zip(ps, codes, strict=True)], abs=1e-9)


@pytest.mark.parametrize("few", [0, 256])
def test_batches_of_both_directions_and_of_segments_equal_single_pairs(few, monkeypatch):
    monkeypatch.setattr(B, "FEW", few)
    ps, codes = _pairs(7)
    rng = np.random.default_rng(8)
    order = sorted(range(len(ps)), key=lambda k: -len(codes[k]))
    for loops in (1.0, 0.0):
        own, targets = [ps[k] for k in order], [codes[k] for k in order]
        for many, one in ((B.forwards, K.forward), (B.backwards, K.backward)):
            for got, p, c in zip(many(own, targets, loops), own, targets, strict=True):
                want = one(p, c, loops)
                assert got.score == pytest.approx(want.score, abs=1e-9)
                assert got.rows.shape == want.rows.shape
    spans = [(b, int(rng.integers(b, len(c) + 1))) for c in codes for b in [int(rng.integers(1, len(c) + 1))]]
    for got, p, c, (b, e) in zip(B.rescored(ps, codes, spans), ps, codes, spans, strict=True):
        want = K.rescored(p, c, b, e)
        assert [t[:3] for t in got.trace] == [t[:3] for t in want.trace]
        assert (got.forward, got.backward, got.accuracy, got.correction) == pytest.approx((want.forward, want.backward, want.accuracy, want.correction), abs=1e-9)


@pytest.fixture(scope="module")
def tables(spark, sf):
    return T.profile_table(spark.read.parquet(f"{sf}/benchmark.parquet")), T.targets(spark.read.parquet(f"{sf}/documents.parquet")).localCheckpoint()


def test_one_task_takes_a_target_through_all_stages(spark, tables, monkeypatch):
    """The same rows as candidates, filters and continuation one after the other, and no residues behind the first filter."""
    profiles, targets = tables
    o = P.SearchOptions(f3=1e-4)
    r = P.search(profiles, targets, o)
    assert "residues" not in r.filtered.columns and "residues" not in r.continued.columns
    rounded = lambda d, *cs: sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in row) for row in d.select(*cs).collect())
    chunks = P.loaded(profiles)
    filtered = P.filters(P.candidates(profiles, targets, chunks, o), targets, profiles, o).localCheckpoint()
    columns = ["profile_ordinal", "seq_ordinal", "length", "msv_status", "msv_bits", "bias_nats", "viterbi_bits", "past"]
    assert rounded(r.filtered, *columns) == rounded(filtered, *columns)
    continued = P.continuation(filtered.where("past = 'VITERBI'"), o)
    columns = ["profile_ordinal", "seq_ordinal", "length", "model_length", "forward_nats", "filter_nats", "nexpected", "uncertain", "route", "regions", "domains.ali_from", "domains.hmm_to"]
    assert rounded(r.continued, *columns) == rounded(continued, *columns)
    assert r.continued.where("size(domains) > 0").count() > 0


def test_a_search_ends_where_it_is_told_to(tables):
    profiles, targets = tables
    whole = P.search(profiles, targets)
    some = P.search(profiles, targets, until="filters")
    assert some.continued is None and some.filtered.exceptAll(whole.filtered).count() == 0 == whole.filtered.exceptAll(some.filtered).count()
    keys = ["profile_ordinal", "seq_ordinal"]
    regions = P.search(profiles, targets, until="regions").continued
    assert regions.select(*keys, "route", "regions").exceptAll(whole.continued.select(*keys, "route", "regions")).count() == 0
    assert regions.where("size(domains) > 0").count() == 0
    forward = P.search(profiles, targets, until="forward").continued
    assert sorted(forward.where("route <> 'F3_REJECT'").select(*keys).collect()) == sorted(whole.continued.where("route <> 'F3_REJECT'").select(*keys).collect())
    with pytest.raises(ValueError):
        P.search(profiles, targets, until="later")


def test_pairs_that_wait_in_small_pools(spark, tables, monkeypatch):
    """A task that flushes its pools often gives the same rows."""
    profiles, targets = tables
    o, chunks = P.SearchOptions(), P.loaded(profiles)
    fit = targets.orderBy("seq_ordinal").limit(60).localCheckpoint()
    keys = ["profile_ordinal", "seq_ordinal", "past", "route"]
    want = sorted(map(str, P.scored(chunks, fit, o).select(*keys).collect()))
    sets = [c[k::3] for c in chunks for k in range(3)]
    assert sorted(map(str, P.scored(sets, fit, o).select(*keys).collect())) == want
    strings = fit.where("status = 'OK'").select("length").toPandas()["length"].to_numpy()
    monkeypatch.setattr(P, "RESIDUES", 50)
    assert [k for part in P.portions(strings) for k in range(part.start, part.stop)] == list(range(len(strings)))
    assert P.portions(strings[:0]) == []


def test_forward_batches_are_cut_within_bands_of_model_length(monkeypatch):
    rng = np.random.default_rng(9)
    ps = [K.Profile(k, "", "A" * int(m)) for k, m in enumerate(rng.integers(1, 60, 50))]
    lengths = rng.integers(1, 500, 50)
    of = np.sort(rng.permutation(50)[:40])
    for band in (P.BAND, 10):
        monkeypatch.setattr(P, "BAND", band)
        parts = P.banded(ps, lengths, of)
        assert sorted(np.concatenate(parts).tolist()) == of.tolist()
        assert all((np.diff(lengths[x]) <= 0).all() for x in parts)
    assert max(ps[k].m for k in parts[0]) <= min(ps[k].m for k in parts[-1])
    assert sum(map(len, P.banded(ps, lengths, of[:0]))) == 0
