"""Operators against brute force, their SQL, round trips and held-out labels."""

import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from helixtable.llm import embeddings, html, mixing, packing, pii, queries, simhash, toxicity
from helixtable.llm.common import components, ranked, table


def normal(frame):
    one = lambda x: "none" if x is None or (isinstance(x, float) and np.isnan(x)) else str(round(float(x), 9)) if isinstance(x, (float, np.floating)) else str(x)
    return sorted(tuple(map(one, r)) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    assert normal(queries.QUERIES[name](spark, sf).toPandas()) == normal(con.execute(queries.ORACLES[name]).df())


def test_pii_equals_plain_patterns(spark, sf):
    got = {r["doc_id"]: r for r in queries.op2_pii(spark, sf).collect()}
    for r in table(spark, sf, "documents").collect():
        t, out = r["text"] or "", []
        digits = lambda s: re.sub(r"[^0-9]", "", s)
        out += [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
        out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
        out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m.group())) <= 15]
        want = pii.joined(sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2]))))
        assert ",".join(s for s in got[r["doc_id"]]["spans"].split(",") if not s.startswith("term")) == want


@pytest.mark.parametrize("text", ["a@b.c@d.e", "@@a@b.c", "a.b@c", "x@y.z..w@v.u", "1.2.3.4.5.6.7.8", "1.2.3.999 256.1.1.1", "é@b.cd a@b.c\n@d", "a@b-c.d-", "+1 (403) 555-9312 x +12-", "4111 1111 1111 1111-1"])
def test_pii_corner_cases(text):
    want = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert list(pii.emails(text)) == want
    ips = [(m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    assert [(a, b) for a, b, k in pii.base_spans(text) if k == "ip"] == ips


def test_pii_terms(spark):
    """A name that always stands beside one address discloses it; words of everywhere don't, nor do copies of one passage."""
    rows, k = [], 0
    for i in range(6):
        rows.append((k := k + 1, f"once upon number{i} we wrote zorblax ana@corp.example.org about item{i} and things{i}"))
    for i in range(40):
        rows.append((k := k + 1, f"once upon a time we wrote about other{i} and nothing"))
    for _ in range(5):
        rows.append((k := k + 1, "same passage quux bob@corp.example.org here"))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in pii.find(d).collect()}
    texts = dict(rows)
    terms = {i: {texts[i][int(a) : int(b)] for kind, a, b in (x.split(":") for x in s.split(",") if x) if kind == "term"} for i, s in out.items()}
    assert all("zorblax" in terms[i] and "once" not in terms[i] for i in range(1, 7))
    assert not any(terms[i] for i in range(7, 52))
    assert "zorblax" not in pii.sanitised(texts[1], out[1]) and "[EMAIL]" in pii.sanitised(texts[1], out[1], {"zorblax": "a person"})


def test_simhash_links(spark, sf):
    docs = table(spark, sf, "documents").collect()
    got = {r["doc_id"]: r for r in queries.op3_simhash(spark, sf).collect()}

    def fingerprint(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {r["doc_id"]: fingerprint(r["text"] or "") for r in docs}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    root = {i: i for i in prints}
    ids = sorted(prints)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if root[b] < root[a] and bin(prints[a] ^ prints[b]).count("1") <= 2:
                    root[a], changed = root[b], True
    assert {i: r["component_id"] for i, r in got.items()} == root


@pytest.mark.parametrize("radius", [1, 2, 4, 7])
def test_gray_tree(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40)
    prints = sorted({int(b) ^ sum(1 << int(x) for x in rng.choice(63, rng.integers(0, 6), replace=False)) for b in base for _ in range(12)})
    d = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = {r["node"]: r["component"] for r in components(simhash.links(d, radius)).collect()}
    root = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if root[j] < root[i] and bin(a ^ b).count("1") <= radius:
                    root[i] = root[j]
    assert [found.get(p, p) for p in prints] == [prints[r] for r in root]


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (900, 901), (901, 902), (900, 902)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert set(out.values()) == {0, 500, 900} and out[200] == 0 and len(out) == 206


def test_ranked(spark):
    d = spark.range(5000).selectExpr("id % 3 = 0 AS k", "xxhash64(id) AS h", "id % 5 AS f")
    rows = ranked(d, ["k"], "h", ("f",)).collect()
    for k in (True, False):
        own = sorted((r for r in rows if r["k"] == k), key=lambda r: r["h"] % (1 << 64))
        at = 0
        for i, r in enumerate(own):
            assert (r["rank_"], r["f_before_"]) == (i, at)
            at += r["f"]


def test_mix(spark, sf):
    docs = table(spark, sf, "documents").collect()
    rows = queries.op4_mixing(spark, sf).collect()
    sizes = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs}
    source = {r["doc_id"]: r["source"] for r in docs}
    total, per = sum(sizes.values()), {}
    for i, n in sizes.items():
        per[source[i]] = per.get(source[i], 0) + n
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(per))}
    want, free, left = {}, set(per), float(total)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * per[s]}
        if not over:
            want |= share
            break
        want |= {s: 3.0 * per[s] for s in over}
        left -= sum(3 * per[s] for s in over)
        free -= over
    took = {}
    for r in rows:
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == per[source[r["doc_id"]]] and r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]], rel=1e-12)
        took[source[r["doc_id"]]] = took.get(source[r["doc_id"]], 0) + r["taken"]
    for s in per:  # no choice of whole documents comes nearer
        own = [n for i, n in sizes.items() if source[i] == s]
        rounds, sums = int(want[s] // per[s]), {0}
        for n in own:
            sums |= {x + n for x in sums}
        assert abs(took[s] - want[s]) <= min(abs(rounds * per[s] + x - want[s]) for x in sums) + 1


def test_knapsack_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes, counts = rng.choice(np.arange(3, 40), 5, replace=False), rng.integers(0, 4, 5)
        budget = int(rng.integers(0, 120))
        took = mixing.knapsack(sizes, counts, budget)
        sums = {0}
        for s, c in zip(sizes, counts, strict=True):
            sums = {x + int(s) * k for x in sums for k in range(int(c) + 1)}
        assert (took <= counts).all() and abs(int((took * sizes).sum()) - budget) == min(abs(x - budget) for x in sums)


def test_packing_round_trip(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = table(spark, sf, "documents").collect()
    ids = {r["doc_id"]: np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [1], dtype="<u4") for r in docs}
    rows, seen, used = queries.op1_packing(spark, sf).collect(), {}, {}
    for r in rows:
        x = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(x) and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, x in ids.items():
        assert sum(n for _, n in seen[i]) == len(x) and all(a + n == b for (a, n), (b, _) in zip(sorted(seen[i]), sorted(seen[i])[1:], strict=False))
    padding = 0
    for pieces in used.values():
        n = sum(k for _, k in pieces)
        assert sorted(pieces)[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(sorted(pieces), sorted(pieces)[1:], strict=False)) and n <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding == 0


def test_words_have_the_ids_of_the_whole_text():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, encode, r = Tokenizer.from_file(path), packing.encoder(path), random.Random(3)
    texts = ["".join(r.choice("aZ'sSt \n\t.,!09²ªºµßÉéİıŒΣſ́ \u001c<|endoftext|> 日本Ⱥ") for _ in range(r.randint(0, 50))) for _ in range(3000)] + ["<|endoftext|> a", "don't WE'LL", ""]
    assert encode(texts) == [np.array(e.ids, dtype="<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("case", ["few", "half", "mid", "dense"])
def test_patterns_pack_all_in_few_sequences(case):
    """Every length of every pattern fits, all counts are used, and no sequence is needed that a bound can show to be one too many."""
    rng = np.random.default_rng(1)
    lengths, counts = {
        "few": (np.array([300, 451, 700, 900, 1101]), np.array([1000, 2000, 3000, 500, 700])),
        "half": (np.arange(683, 1024), rng.integers(1, 5000, 341)),
        "mid": (np.arange(300, 700, 3), rng.integers(1, 300, 134)),
        "dense": (np.arange(1, 2048), 1 + rng.poisson(60 * np.exp(-np.arange(1, 2048) / 400))),
    }[case]
    used, total = np.zeros(len(lengths), dtype=np.int64), 0
    for column, times in packing.patterns(lengths, counts):
        at = list(column)
        assert int(lengths[at] @ np.array(list(column.values()))) <= 2048 and times > 0
        used[at] += np.array(list(column.values())) * times
        total += times
    assert (used == counts).all()
    least = {"few": 2350, "half": -(-counts.sum() // 2)}.get(case, -(-int(lengths @ counts) // 2048))  # "few": by its dual prices
    assert total <= least * 1.003


def test_priced_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = np.sort(rng.choice(np.arange(1, 15), 4, replace=False))
        counts, prices = rng.integers(1, 4, 4), rng.random(4)
        value, column = packing.priced(lengths, counts, prices, 20)
        every = np.stack(np.meshgrid(*[np.arange(c + 1) for c in counts]), -1).reshape(-1, 4)
        assert value == pytest.approx((every @ prices)[every @ lengths <= 20].max())
        assert sum(n * prices[i] for i, n in column.items()) == pytest.approx(value) and all(n <= counts[i] for i, n in column.items())


def test_rests_stay_whole(spark):
    """95 % of the rests at least stand whole in a pattern, though no sequence has padding."""
    rows = queries.op1_packing(spark, "/root/testdata/sf0.01").collect()
    pieces = {}
    for r in rows:
        if r["start"] >= r["doc_tokens"] // 2048 * 2048:
            pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + 1
    assert sum(n == 1 for n in pieces.values()) >= 0.95 * len(pieces)


def test_mix_does_not_hang_on_partitions(spark):
    rows = [(i, "w " * 10, f"s{i % 2}") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted(r[0] for r in mixing.mixed(d.repartition(n)).collect()) for n in (3, 7))
    assert a == b


def test_embedding_codes_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    error, bound_ok = [], True
    for seed in range(20):
        turn = embeddings.rotation(64, seed)
        turned, signs, f = embeddings.codes(x, turn)
        e = embeddings.estimate(signs, f, turned)
        exact = x @ x.T
        off = ~np.eye(300, dtype=bool)
        error.append((e - exact)[off].mean())
        t = e * f[:, None]
        bound = f[:, None] * t + np.sqrt(np.maximum(0, 1 - f**2))[:, None] * np.sqrt(np.maximum(0, 1 - t * t))
        bound_ok &= bool((bound >= exact - 1e-9).all())
    assert abs(np.mean(error)) < 2e-3 and bound_ok


def test_toxicity_held_out(spark):
    """Labels of rows that training never sees, on the larger of the small tables."""
    sf = "/root/testdata/sf0.1"
    scores = {r["doc_id"]: r for r in queries.op6_toxicity(spark, sf).where("held_out").collect()}
    lang = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").select("doc_id", "lang").collect()}
    known = [(lang[r["doc_id"]], r["toxic"], scores[r["doc_id"]]["predicted"]) for r in table(spark, sf, "labels").collect() if r["doc_id"] in scores]
    toxic, clean = [p for _, t, p in known if t == 1], [p for _, t, p in known if t == 0]
    assert sum(toxic) / len(toxic) > 0.85 and sum(clean) / len(clean) < 0.03  # some 300 positive rows to learn from
    for own in ("en", "de", "fr", "es"):
        found = [p for k, t, p in known if t == 1 and k == own]
        assert sum(found) / len(found) > 0.6, own
    assert toxicity.THRESHOLD == 0.7


def test_responses_and_training_equal_plain_loops():
    """The convolution by a loop over words; one step of training moves the loss as the gradient says."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"], n)) for n in (1, 3, 40, 200)]
    m = toxicity.trained(texts * 10, np.array([0, 1, 0, 1] * 10))
    buckets, numbers, starts, _ = toxicity.Words().arrays(texts)
    x = m.embedded(buckets)[numbers]
    got, ends = list(m.responses(x, starts)), [*starts[1:], len(x)]
    for n, w in enumerate(toxicity.WIDTHS):
        for i in range(len(x) - w):
            assert got[n][i] == pytest.approx(sum(x[i + k] @ m.filters[n][k] for k in range(w)), abs=1e-3)
    for n, w in enumerate(toxicity.WIDE):
        for s, e in zip(starts, ends, strict=True):
            for i in range(s, e):
                assert got[len(toxicity.WIDTHS) + n][i] == pytest.approx(sum(x[k] @ m.wide[n] for k in range(i, min(e, i + w))), abs=1e-2)
    assert (m.logits(buckets, numbers, starts)[[1, 3]] > m.logits(buckets, numbers, starts)[[0, 2]].max()).all()


def test_html_equals_articles(spark, sf):
    import html as entities

    got = {r["page_id"]: r["text"] for r in queries.op7_html(spark, sf).collect()}
    for r in table(spark, sf, "pages").collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = (" ".join(entities.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert got[r["page_id"]] == "\n".join(p for p in parts if p)


def test_html_rules():
    page = """<body><header><h1>Site</h1></header><div class="site-header">The name of the site and all of the things that it is about, for you</div><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies, and so do you.</div>
    <div id="content"><h2>A headline</h2><p>This is the first paragraph of the story and it has all of the words that are needed for it to be the text of the page.</p>
    <p>Short.</p><p>And this is another paragraph of the same story with many of the words that it needs to be long enough for the rules of the game.</p>
    <p><a href=y>More links</a> <a href=z>and more</a></p></div><aside>Related stories of the day</aside>
    <section class="comments"><p>I think that this is the best of all the stories that I have read on the site in a very long time.</p></section>
    <form><p>Your name and the rest of it</p></form><footer>All rights of the owner</footer></body>"""
    lines = html.main_text(page).split("\n")
    assert lines[0] == "A headline" and lines[1].startswith("This is the first") and lines[2] == "Short." and lines[3].startswith("And this") and len(lines) == 4


def test_pipeline_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "packing"]
    out = corpus_pipeline.run(spark, sf)
    total = out.agg({"length": "sum"}).first()[0]
    assert total > 0 and out.where("length <= 0").count() == 0


def test_packing_comes_through_priced_columns(spark, monkeypatch):
    """On sf0.1 the programme prices columns, and its patterns place nearly all rests whole."""
    calls, made, price, solve = [], [], packing.priced, packing.programme
    monkeypatch.setattr(packing, "priced", lambda *a: calls.append(1) or price(*a))
    monkeypatch.setattr(packing, "programme", lambda *a: made.append(solve(*a)) or made[-1])
    rows = queries.op1_packing(spark, "/root/testdata/sf0.1").select("doc_id", "doc_tokens", "length", "sequence_id").toPandas()
    assert calls and len(made) == 1 and made[0]
    placed = sum(int(times + 1e-6) for _, times in made[0])
    assert placed >= 0.3 * rows["sequence_id"].nunique()  # sequences of the programme's own patterns, after rounding
    rests = rows[rows["length"] == rows["doc_tokens"] % 2048].groupby("doc_id").size()
    assert len(rests) >= 0.95 * (rows.drop_duplicates("doc_id")["doc_tokens"] % 2048 > 0).sum()
