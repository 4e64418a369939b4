"""Stages do the whole job: cases that once fell through a cut."""

import random
import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixtable.llm import html, lines, mixing, packing, pii, simhash, toxicity


def jaccard(a, b):
    a, b = (set(simhash.shingle_hashes(t, 5)) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_give_candidates_of_the_deduplication(spark):
    """Sets whose fingerprints the tree connects meet the first of their group, whatever their minimum hashes."""
    rows = spark.createDataFrame([(1, 1, 0b0), (2, 2, 0b11), (3, 3, 0b1111), (4, 4, -1), (5, 5, 1 << 40), (1, 1, 7 << 50), (6, 6, (7 << 50) + 1)], "s1 long, s2 long, fp long")
    sets = rows.select(F.col("s1").alias("id"), "s1", "s2").distinct()
    assert sorted(map(tuple, simhash.linked_sets(rows, sets).collect())) == [(1, 2), (1, 3), (1, 5), (1, 6)]


def test_near_duplicates_from_similarity_08(spark):
    """Texts at Jaccard 0.8 to 1 to another go, as by brute force; texts below it stay."""
    rng, texts = random.Random(1), []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts.append(" ".join(words))
        for changed in (1, 4, 6, 8, 12):
            copy = list(words)
            for at in rng.sample(range(300), changed):
                copy[at] = f"v{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if i // 6 == j // 6 and jaccard(texts[i], texts[j]) >= 0.8:
                group = [group[j] if g == group[i] else g for g in group] if group[j] < group[i] else [group[i] if g == group[j] else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.deduplicated(docs).select("doc_id").collect()) == sorted(set(group))


def test_short_lines_repeat(spark):
    """Repeats of lines of one to four words go, as sets of words; lines without words stay."""
    rows = [(1, "All rights reserved.\n\nYes\nall of the\n  "), (2, "ALL rights  reserved.\n\nno\nthe of all of\n  "), (3, "All rights reserved\nyes\nno"), (None, "No")]
    out = {r["doc_id"]: r["text"] for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: "All rights reserved.\n\nYes\nall of the\n  ", 2: "\n\n  ".replace("\n\n", "\n"), 3: "All rights reserved", None: "No"}


STORY = "This is the first paragraph of the story and it has all of the words that are needed for it to be the text of the page."
MORE = "And this is another paragraph of the same story with many of the words that it needs to be long enough for the rules."


def test_articles_beside_the_text():
    """Reader comments and teaser cards in <article> take nothing from a text that stands in a <div>."""
    body = f"<div id=content><p>{STORY}</p><p>{MORE}</p></div>"
    remark = "<p>I think that this is the best of all the stories that I have read on the site in a very long time.</p>"
    assert html.main_text(f'{body}<ol class="commentlist"><li><article class="comment">{remark}</article></ol>') == f"{STORY}\n{MORE}"
    assert html.main_text(f'{body}<article class="comment">{remark}</article>') == f"{STORY}\n{MORE}"
    assert html.main_text(f"{body}<article>{remark}</article>").startswith(f"{STORY}\n{MORE}")


def test_loose_words_and_tags():
    """Names that only mention a sidebar, comments or social do not make an element bad, nor do other tags swallow the text."""
    for name in ("content has-sidebar", "page-with-comments", "post social-studies", "no-header", "comments-open"):
        assert html.main_text(f'<div class="{name}" id="{name.split()[-1]}"><p>{STORY}</p><p>{MORE}</p></div>') == f"{STORY}\n{MORE}"
    for name in ("comment-list", "site-footer", "cookie-notice", "ad-container", "sidebar", "related-posts", "socialLinks", "nav-bar", "site-header", "post-comments", "social-share-bar"):
        assert html.main_text(f'<div class="{name}"><p>{STORY}</p></div><p>{MORE}</p>') == MORE
    for tag in ("<svg-icon>", "<title-block>", "<select-list>", "<svg viewBox='0 0 1 1'/>", "<iframe src='x' />", "<svg>", "<SELECT name=x>"):
        assert html.main_text(f"<p>{STORY}{tag}</p><p>{MORE}</p>") == f"{STORY}\n{MORE}"
    assert html.main_text(f"<article><p>{STORY} <math><mi>xyz</mi></math> <object>fallback</object><svg><text>drawn</text></svg></p></article>") == f"{STORY} xyz fallback"
    assert html.main_text("<svg>" * 100_000 + f"<p>{STORY}</p>") == STORY


def test_articles_lose_nothing():
    """Names of paragraphs, labels and links within sentences take nothing from an article."""
    for body in (f'<p class="share-price">{STORY}</p>', f'<section class="related-work"><p>{STORY}</p></section>', f'<p id="search-for-meaning">{STORY}</p>'):
        assert html.main_text(f"<article>{body}</article>") == STORY
    assert html.main_text(f"<article><p>{STORY} <label>and this</label></p></article>") == f"{STORY} and this"
    assert "linked words" in html.main_text("<article><p>And of the <a href=x>linked words that are in it for all of the time</a> to be here with it and on it</p></article>")


def test_hostile_pages_take_time_in_proportion():
    """Tags, quotes, comments and elements that never end."""
    began = time.time()
    for page in ("<a" * 200_000, '<b "' * 100_000, '<b "' * 100_000 + ">", '<b ">' * 100_000, "<div>" * 50_000 + "</p>" * 50_000, "<p><article>" + "<div>" * 50_000 + "</p>" * 50_000, "<!--" * 100_000, "<" * 300_000, "<article>" * 20_000 + "</main>" * 20_000):
        html.main_text(page)
    assert time.time() - began < 20


@pytest.mark.parametrize("rare", [0, 3, lines.RARE])
def test_line_sets_equal_brute_force(spark, monkeypatch, rare):
    """Jaccard 0.5 and 0.8 of lines of 0 to 10 words, against all pairs: by pairs of frequent tokens, by both, and by rare tokens alone."""
    monkeypatch.setattr(lines, "RARE", rare)
    rng = random.Random(3)
    word = ["a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k", "l", *(f"r{x}" for x in range(30))]
    rows = [(d, "\n".join(" ".join(rng.choice(word) for _ in range(rng.randint(0, 10))) for _ in range(6))) for d in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [((d, i), frozenset(x.split())) for d, t in rows for i, x in enumerate(t.split("\n"))]
    for similarity in (0.5, 0.8):
        want = {k for j, (k, s) in enumerate(sets) if s and any(q and len(s & q) >= similarity * len(s | q) - 1e-9 for _, q in sets[:j])}
        assert {(r["key"], x) for r in lines.removed_lines(docs, similarity).collect() for x in r["removed"]} == want


def test_disclosing_terms_of_whole_texts(spark):
    """A name far from the address, short, repeated, or in a text without the address is found all the same."""
    fill = lambda i, n: " ".join(f"fill{i}x{k}" for k in range(n))
    rows = [(i, f"note of day{i} ana@corp.example.org at{i} {fill(i, 30)} Zorblax, {fill(i + 100, 20)} (zorblax)  qz") for i in range(6)]
    rows += [(i, f"the note of day{i} {fill(i, 40)}") for i in range(6, 60)] + [(60, f"today {fill(60, 9)} Zorblax! came")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    places = {i: [t[int(a) : int(b)] for k, a, b in (x.split(":") for x in got[i].split(",") if x) if k == "term"] for i, t in rows}
    assert all(places[i] == ["Zorblax", "zorblax", "qz"] for i in range(6)) and places[60] == ["Zorblax"] and not any(places[i] for i in range(6, 60))


def test_cuts_cover_all_labels_at_their_mix():
    """A language with few labels has its own cut, moved by them; errors count as shares of their label."""
    rows = [(0, 64 * 4, 1, False, 900), (0, 64 * 1, 0, False, 90_000), (1, 64 * 8, 1, False, 25), (1, 64 * 6, 0, False, 20_000)]
    cuts = toxicity.chosen_cuts(pd.DataFrame(rows, columns=["language", "bin", "toxic", "trained", "n"]))
    assert 1 < cuts[0] < 4 and 6 < cuts[1] < 8 and cuts[2] == cuts[-1]
    # 10 of 20 toxic rows are missed at 4, 10 of 200 clean ones not left alone at 3: a twentieth, times FALSE, is less than a half
    frame = lambda clean: pd.DataFrame([(0, 64 * 3, 1, False, 10), (0, 64 * 3, 0, False, 10), (0, 64 * 5, 1, False, 10), (0, 0, 0, False, clean)], columns=["language", "bin", "toxic", "trained", "n"])
    assert toxicity.chosen_cuts(frame(190))[-1] < 3.1 < toxicity.chosen_cuts(frame(10))[-1]


def test_long_texts_meet_the_budget():
    """Where all texts are longer than what is left, the nearest sum is taken, above or below."""
    rounds, took = mixing.fit(np.array([200_000]), np.array([10]), 130_000.0)
    assert rounds == 0 and took.tolist() == [1]


def test_pairs_are_of_sets_that_rare_tokens_may_miss(spark):
    """Fewer frequent tokens than similar sets without a shared rare one must share make no pairs; so many do."""
    rows = [(i, sorted([(lines.RARE + 1) << lines.HASH_BITS | 64 * k for k in range(frequent)] + [1 << lines.HASH_BITS | 64 * k for k in range(20 - frequent)])) for i, frequent in ((4, 12), (5, 13))]
    sets = lines.keyed_sets(spark.createDataFrame(rows, "id long, t array<long>").withColumn("n", F.size("t")), 0.8)
    assert {r["id"]: len(r["frequent"]) for r in sets.collect()} == {4: 0, 5: 0}  # 9 rarest of 20: 8 and 7 rare ones, so 1 and 2 frequent
    rows = [(i, [(lines.RARE + 1) << lines.HASH_BITS | 64 * k for k in range(n)]) for i, n in ((2, 2), (3, 3), (4, 20))]
    sets = lines.keyed_sets(spark.createDataFrame(rows, "id long, t array<long>").withColumn("n", F.size("t")), 0.5)
    assert {r["id"]: len(r["frequent"]) for r in sets.collect()} == {2: 2, 3: 3, 4: 15}


def test_a_group_of_near_copies_costs_its_members(spark):
    """However many pairs the sets of a group share, each shows SIEVES minimum hashes of them to the heads of the group."""
    pair = spark.range(30).crossJoin(spark.range(200).select(F.col("id").alias("key")))
    rows = lines.sieved(pair).groupBy("id").count().collect()
    assert len(rows) == 30 and {r["count"] for r in rows} == {lines.SIEVES}


def test_the_programme_holds_one_inverse(monkeypatch):
    """Pivots and fresh starts of the packing's programme take no copies of its inverse beside the columns that it is made of."""
    monkeypatch.setattr(packing, "REFRESH", 4)
    lengths = np.arange(651, 1200)
    counts, calls, price = np.random.default_rng(7).integers(20, 60, len(lengths)), [], packing.priced
    monkeypatch.setattr(packing, "priced", lambda *a: calls.append(1) or price(*a))
    tracemalloc.start()
    packed = packing.programme(lengths, counts, 2048)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    made = sum(np.bincount(list(used), np.array(list(used.values())) * times, len(lengths)) for used, times in packed)
    assert len(calls) > 8 and np.abs(made - counts).max() < 1e-3
    assert peak < 2.7 * 8 * len(lengths) ** 2


def test_a_group_of_near_copies_makes_no_pair_of_each_two(spark, monkeypatch):
    """200 lines that share 40 words: as many candidates as lines, not 19,900, and all but the first line go."""
    rows, sizes = [(i, " ".join([f"w{k}" for k in range(40)] + [f"x{i}", f"y{i}"])) for i in range(200)], {}
    write = lines.written

    def counted(df, name):
        out = write(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(lines, "written", counted)
    gone = lines.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["key"] for r in gone} == set(range(1, 200))
    assert {n: s for n, s in sizes.items() if n in ("line-near", "line-found", "line-rest") and s > 400} == {}
