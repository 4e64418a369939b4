"""Personal data: pattern spans, and information-theoretic sanitisation of the terms around them.

Base spans are e-mail addresses, IP addresses, card and telephone numbers; their values are the protected entities.
The corpus estimates how strongly a term reveals an entity: over documents, pmi(t; e) = log2 p(t, e) / (p(t) p(e)),
as a share of the entity's own information -log2 p(e). A term (any word of a document that holds the entity) whose
share is at least DISCLOSURE, seen with it in at least SUPPORT different contexts, discloses it. Contexts are the words
within REACH words of the entity, so copies of one passage are one context. A word that discloses any entity becomes a
span of kind `term` wherever it stands, also in texts that do not state the entity: it gives the entity away there too.

Defined cases: a null text is an empty one; null and repeated doc_ids stay, each row is sanitised for itself; an empty
table gives an empty result; a very long run of digits or letters costs time in proportion to its length; columns of
other names are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixtable.llm.common import kept_by, marked, small_batches, text_of, written

REACH, SUPPORT, DISCLOSURE = 8, 3, 0.7
KINDS = ("email", "ip", "card", "phone", "term")
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match always starts where a run of digits starts: the look-behind saves the tries from within a run
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORDS = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local @ domain, leftmost and non-overlapping, from the places of @: linear in the text."""
    upto, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > upto and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            upto = m.end()
        elif start < at:
            upto = at  # what stands before this @ belongs to no later match
        at = text.find("@", max(at + 1, upto))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in its fixed order."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(g) <= 255 if len(g) < 4 else int(g.lstrip("0")[:4] or "0") <= 255 for g in m.groups())] if "." in text else []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15] if "+" in text else []
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def terms_of(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[str, int, int]]:
    """The words of a text in lower case, less what is no letter or digit at their ends, with their places; none that overlaps a span."""
    upto = list(accumulate((b for _, b, _ in spans), max))
    begins, out = [a for a, _, _ in spans], []
    for m in WORDS.finditer(text):
        s, e = m.span()
        while s < e and not text[s].isalnum():
            s += 1
        while e > s and not text[e - 1].isalnum():
            e -= 1
        i = bisect.bisect_left(begins, e)
        if e > s and not (i and upto[i - 1] > s):
            out.append((text[s:e].lower(), s, e))
    return out


def around(text: str, spans: list[tuple[int, int, str]], terms: list[tuple[str, int, int]]) -> list[dict]:
    """For each entity of spans: its key, and the hash of its context, the words within REACH."""
    if not spans:
        return []
    starts = [m.start() for m in WORDS.finditer(text)]
    begins, out = [t[1] for t in terms], []
    for a, b, kind in spans:
        i, j = max(0, bisect.bisect_left(starts, a) - REACH), bisect.bisect_left(starts, b) + REACH
        low, high = bisect.bisect_left(begins, starts[i]), bisect.bisect_left(begins, starts[j]) if j < len(starts) else len(begins)
        context = " ".join(sorted(t[0] for t in terms[low:high]))
        out.append({"entity": f"{kind}:{text[a:b].lower()}", "context": hashlib.md5(context.encode()).hexdigest()})
    return out


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base string, n_spans int, around array<struct<entity:string,context:string>>, words array<string>"


def _found(texts: pd.Series) -> pd.DataFrame:
    spans = [base_spans(t) for t in texts]
    kinds = [[s[2] for s in x] for x in spans]
    terms = [terms_of(t, x) if x else [] for t, x in zip(texts, spans, strict=True)]
    return pd.DataFrame(
        {f"n_{k}": [x.count(k) for x in kinds] for k in KINDS[:4]}
        | {"base": [joined(x) for x in spans], "n_spans": [len(x) for x in spans], "around": [around(t, x, w) for t, x, w in zip(texts, spans, terms, strict=True)], "words": [sorted({t[0] for t in w}) for w in terms]}
    )


def _placed(texts: pd.Series, terms: pd.Series) -> pd.Series:
    """The places of the terms of each text."""
    out = []
    for text, wanted in zip(texts, terms, strict=True):
        wanted = set(wanted)
        out.append([{"s": s, "e": e} for t, s, e in terms_of(text, base_spans(text)) if t in wanted])
    return pd.Series(out, dtype=object)


def distinct_words(text: str) -> Column:
    """The distinct words of a text as terms_of cuts them: white space is Python's."""
    return F.array_distinct(F.expr(rf"transform(split(lower({text}), '(?U)[\\s\\x1c-\\x1f]+'), w -> regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', ''))"))


def disclosing(docs: DataFrame, found: DataFrame, share: float, support: int) -> DataFrame:
    """The terms (t) that disclose an entity. docs: all documents (text); found: uid, around, words."""
    near = found.where("n_spans > 0").select("uid", "words", F.explode("around").alias("x")).select("uid", "words", "x.*")
    # no term of an entity has more contexts than the entity
    entities = written(near.groupBy("entity").agg(F.countDistinct("uid").alias("n_e"), F.countDistinct("context").alias("contexts")).where(F.col("contexts") >= support), "entities")
    met = near.join(entities.select("entity"), "entity").groupBy("uid", "entity").agg(F.first("words").alias("words"), F.collect_set("context").alias("met"))
    met = met.select("entity", F.explode("words").alias("t"), "met").select("entity", "t", F.posexplode("met").alias("nth", "context"))
    pairs = met.groupBy("entity", "t").agg(F.countDistinct("context").alias("contexts"), F.sum((F.col("nth") == 0).cast("long")).alias("n_te")).where(F.col("contexts") >= support)
    pairs = written(pairs, "pairs")
    # document frequencies over the whole corpus, summed before they meet the candidates
    counts = docs.select(F.explode(distinct_words("text")).alias("t")).groupBy("t").agg(F.count("*").alias("n_t"))
    n = docs.count()
    scored = pairs.join(entities.select("entity", "n_e"), "entity").join(counts, "t")
    pmi, own = F.log2(F.col("n_te") * F.lit(float(n)) / (F.col("n_t") * F.col("n_e"))), F.log2(F.lit(float(n)) / F.col("n_e"))
    return written(scored.where(pmi >= F.lit(share) * own).select("t").distinct(), "terms")


def find(docs: DataFrame, share: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base and disclosing terms)."""
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", text_of().alias("text"))
    keys = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")]  # rows of one text have the same spans
    scanned = F.pandas_udf(_found, FOUND, F.PandasUDFType.SCALAR)("text")
    found = written(texts.select(F.monotonically_increasing_id().alias("uid"), "doc_id", *keys, scanned.alias("x")).select("uid", "doc_id", "k1", "k2", "x.*"), "pii")
    terms = disclosing(texts, found, share, support)
    keyed = texts.select("text", *keys)
    holds = keyed.select("k1", "k2", F.explode(distinct_words("text")).alias("t")).join(terms, "t")
    holds = written(holds.groupBy("k1", "k2").agg(F.collect_set("t").alias("terms")), "pii-terms")
    place = F.pandas_udf(_placed, "array<struct<s:int,e:int>>", F.PandasUDFType.SCALAR)
    hits = kept_by(keyed, "k1", marked(holds, "k1")).join(holds, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    hits = written(hits.select("k1", "k2", place("text", "terms").alias("hits")), "pii-hits")
    rows = found.drop("around", "words").join(hits, ["k1", "k2"], "left")
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("s"), F.array_position(F.lit(list(KINDS)), F.split(x, ":")[0]).alias("k"), x.alias("x")))
    more = F.transform(F.coalesce("hits", F.expr("cast(array() as array<struct<s:int,e:int>>)")), lambda h: F.struct(h.s.alias("s"), F.lit(5).cast("bigint").alias("k"), F.concat_ws(":", F.lit("term"), h.s.cast("string"), h.e.cast("string")).alias("x")))
    spans = F.array_join(F.transform(F.array_sort(F.concat(base, more)), lambda x: x.x), ",")
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))


def sanitised(text: str, spans: str, general: dict[str, str] | None = None) -> str:
    """The text with its spans replaced: base values by their kind, terms by their generalisation, or removed to [TERM]."""
    out, upto = [], 0
    parts = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)]
    for kind, a, b in sorted(parts, key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= upto:
            out += [text[upto:a], (general or {}).get(text[a:b].lower(), PLACEHOLDERS[kind])]
            upto = b
    return "".join(out) + text[upto:]
