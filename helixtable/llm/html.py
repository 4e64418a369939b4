"""HTML main-text extraction by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass classifies each block by where it stands (menus, headers,
footers, sidebars, notices, adverts, forms and reader comments are bad by their element, role, class or id), by link
density, by stop-word density and by length: good, bad, or undecided where a block is too short to tell. On a page that
holds stop words of no language listed, and for blocks in scripts without spaces, length, link density and the mark at a
block's end decide alone. In the second pass undecided blocks take the label of their nearest decided neighbours; inside
an article, between labels that differ, and with no decided neighbour there, they are good. Inside an article, lists of
links, and sentences in elements that are named as menus or social ones, stay; so does what stands in noscript there.

Defined cases: null html is an empty page with an empty text; null and repeated page_ids and urls stay; unclosed
elements end with what encloses them; an unclosed comment, script or style runs to the end; what else holds no text
of the page (SKIPPED) is left out up to its end tag, or alone where it has none or closes itself; an empty table gives an
empty result; columns of other names are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixtable.llm.common import small_batches

NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
STOPS = re.compile(r"[>\"']")
RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style")}
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

SKIPPED = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("noscript", "template", "svg", "iframe", "title", "textarea", "select")}

# HTML's block-level and void elements.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements and words of class, id and role that name what is not the article.
NOT_TEXT = frozenset("nav aside footer form menu dialog button fieldset search".split())
# Elements that hold text itself: inside an article their names say nothing.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th caption figcaption address".split())
BARRIERS = frozenset("article main body".split())
NOT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies copyright disclaimer disqus "
    "footer gdpr masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted promotion related replies "
    "reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget login complementary search".split()
)
# Words that follow the one that names a container, and words that make a name say what an element has or lacks.
GENERIC = frozenset(
    "area background bar block body bottom box btn button buttons center col column container content entry footer form group head icon icons inner item items left link links list main media "
    "meta nav outer panel primary region right row secondary section slot text thread title top trail unit widget wrap wrapper".split()
)
SAYING = frozenset("has have with without no not is open closed enable enabled disable disabled show hide status".split())
QUALIFIERS = frozenset("related promoted sponsored".split())
QUALIFIED = frozenset("article articles news post posts product products reading story stories topic topics video videos".split()) | GENERIC
# Names that inside an article say too little: there only what reads as no sentence is bad.
SOFT = frozenset("menu social".split())
# Frequent function words of English, German, French, Spanish, Italian, Dutch, Portuguese, Polish, Swedish, Turkish, Russian and Ukrainian.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are with as his they be at this from have or by one had not but what all were when your can said there "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de et un une des du en que qui dans pour sur par pas au est plus ne se ce avec il elle sont ou "
    "el los las y del que por con para una su al lo como más pero sus no se "
    "il lo la i gli le un una di del della dei delle che e è per con non si sono come anche più nel nella da dal ha "
    "de het een en van in op te dat die is niet met voor zijn aan er om ook als bij maar naar door uit wordt "
    "o a os as um uma do da dos das em no na nos nas que e é para com não por mais ao foi se como mas "
    "i w z na do nie się to jest że o jak po od za ale przez dla był była są oraz "
    "och att det som en på är av för med den till inte om har de ett var från "
    "ve bir bu da de için ile olarak daha çok gibi en ama o ne "
    "и в не на что с по а к у из за это как его но от для о же то так все он она они был была было были мы вы ты "
    "і в не на що з по а до у за це як його але від для о та так все він вона вони був була".split()
)
LINKS, MOSTLY, SHORT, LONG, DENSE, SPARSE, KNOWN, SENTENCE = 0.33, 0.8, 25, 200, 0.30, 0.10, 0.05, 50
ENDS = re.compile("[.!?…。！？｡．؟।][\"'”’»)\\]」』]*$")
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")  # scripts that set no spaces between words


class Block:
    __slots__ = ("text", "linked", "bad", "soft", "article", "heading")

    def __init__(self, text: str, linked: int, mark: int, article: bool, heading: bool) -> None:
        self.text, self.linked, self.bad, self.soft, self.article, self.heading = text, linked, mark > 1, mark == 1, article, heading

    def share(self) -> float:
        """Of stop words among its words."""
        words = self.text.lower().split()
        return sum(w.strip(".,;:!?\"'()«»„“”") in STOP_WORDS for w in words) / len(words)


def head_word(words: list[str]) -> str:
    """The word of a class or id that says what its element is; an empty one if the name only says what it has."""
    if not SAYING.isdisjoint(words):
        return ""
    if words[0] in QUALIFIERS:
        return words[0] if QUALIFIED.issuperset(words[1:]) else ""
    end = len(words)
    while end > 1 and (words[end - 1] in GENERIC or len(words[end - 1]) == 1) and words[end - 1] not in NOT_WORDS:
        end -= 1
    return words[end - 1]


def marked(name: str, attributes: str, in_article: bool) -> int:
    """What an element's own name and attributes say of it: 2 bad, 1 bad unless it reads as sentences, 0 nothing."""
    if name in NOT_TEXT or (name == "header" and not in_article):
        return 2
    if not attributes or name in ("html", "body") or (in_article and name in TEXTS and "hidden" not in attributes):
        return 0
    out = 0
    for key, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if key.lower() == "hidden" or (key.lower() == "aria-hidden" and value == "true"):
            return 2
        if key.lower() == "aria-hidden":
            continue
        for token in value.split():
            parts = [p.lower() for p in PART.findall(token)]
            head = head_word(parts) if parts else ""
            if in_article and head in SOFT:
                out = 1
            elif head in NOT_WORDS or "".join(parts) in NOT_WORDS:
                return 2
            if head == "header" and not in_article and {"article", "entry", "post", "story", "content"}.isdisjoint(parts):
                return 2
    return out


class Scanner:
    """The tags of a page, in one walk: a page without an end of a tag, a comment or a quotation is not searched for it again."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.quoted = page, page.rfind(">"), True

    def end(self, at: int) -> int:
        """The place of the > that ends a tag whose attributes start at `at`. A > in quotes does not, unless the quotes run to the end of the page."""
        i = at
        while self.quoted:
            m = STOPS.search(self.page, i)
            if m and m[0] == ">":
                return m.start()
            i = self.page.find(m[0], m.end()) + 1 if m else 0
            if not i:
                self.quoted = False
        return self.page.find(">", at)

    def tags(self) -> Iterator[tuple[int, int, bool, str, str]]:
        """start, end, closing, name, attributes; the name is empty for comments and the like, and attributes say what they are."""
        page, at = self.page, self.page.find("<")
        while 0 <= at < self.last or (at >= 0 and page.startswith("<!--", at)):
            upto, mark = at + 1, page[at + 1 : at + 2]
            if mark == "!" and page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                upto = end + 3 if end >= 0 else len(page)
                yield at, upto, False, "", ""
            elif mark in ("!", "?") and mark:
                upto = page.find(">", at) + 1
                yield at, upto, False, "", ""
            elif m := NAME.match(page, at + 1 + (mark == "/")):
                name, end = m[0].lower(), self.end(m.end())
                upto = end + 1
                if name in RAW and mark != "/":
                    close = RAW[name].search(page, upto)
                    upto = close.end() if close else len(page)
                    yield at, upto, False, "", name
                else:
                    self.resume = 0
                    yield at, upto, mark == "/", name, page[m.end() : end]
                    upto = self.resume or upto
            at = page.find("<", upto)


def blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # element, its mark, in an article
    open_: list[Counter] = [Counter()]  # how many of each element are open, by the innermost of BARRIERS around them
    total: Counter = Counter()  # the same, of all
    parts: list[str] = []
    linked = in_link = upto = 0
    heading = False

    def flush() -> None:
        nonlocal linked, heading
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                mark, article = stack[-1][1:] if stack else (0, False)
                out.append(Block(text, linked, mark, article, heading))
            parts.clear()
        linked, heading = 0, False

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = entities.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if in_link:
                linked += len(raw)

    def push(name: str, mark: int, article: bool) -> None:
        stack.append((name, mark, article))
        total[name] += 1
        open_[-1][name] += 1
        if name in BARRIERS:
            open_.append(Counter())

    def pop() -> str:
        name = stack.pop()[0]
        if name in BARRIERS:
            open_.pop()
        total[name] -= 1
        open_[-1][name] -= 1
        return name

    unclosed: set[str] = set()
    scanner = Scanner(page)
    for start, end, closing, name, attributes in scanner.tags():
        text(page[upto:start])
        upto = end
        if not name:
            if attributes:
                parts.append(" ")
        elif name in SKIPPED:
            parts.append(" ")
            if name == "noscript" and stack and stack[-1][2]:
                continue
            if not closing and not attributes.endswith("/") and name not in unclosed:
                close = SKIPPED[name].search(page, upto)
                if close:
                    scanner.resume = upto = close.end()
                else:
                    unclosed.add(name)
        elif name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS or name in NOT_TEXT:
            flush()
            in_link = 0
            if closing:
                # a stray end tag does not end what encloses it: other elements end within the innermost barrier only
                if name == "html" or name in BARRIERS:
                    there = total[name] > 0
                else:
                    there = open_[-1][name] > 0
                while there and pop() != name:
                    pass
            elif name not in VOID:
                if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] in ("p", name):
                    pop()
                elif name not in ("p",) and stack and stack[-1][0] == "p":
                    pop()
                mark, article = stack[-1][1:] if stack else (0, False)
                article = article or name in ("article", "main")
                push(name, max(mark, marked(name, attributes, article)), article)
            heading = name[0] == "h" and name[1:].isdigit() and not closing
    text(page[upto:])
    flush()
    return out


def first_pass(b: Block, known: bool = True) -> str:
    """good, bad or undecided. An article is evidence for its own blocks only: it says nothing against others.
    known: whether the page holds stop words of a language that is listed."""
    if b.bad:
        return "bad"
    unspaced = len(UNSPACED.findall(b.text))
    size = len(b.text) + 2 * unspaced  # a character of these scripts says as much as some three letters
    known = known and 3 * unspaced < len(b.text)
    dense = b.share()
    sentence = size >= SENTENCE and bool(ENDS.search(b.text)) and (dense >= SPARSE or not known)
    if b.soft:
        return "good" if sentence and b.linked <= LINKS * len(b.text) else "bad"
    if b.linked > LINKS * len(b.text) and not (b.article and (dense >= SPARSE or not known) and b.linked < MOSTLY * len(b.text)):
        return "undecided" if b.article else "bad"  # an article's own sentences may hold links
    if b.article:
        return "good" if size >= SHORT and (dense >= SPARSE or size >= LONG or sentence) else "undecided"
    if size < SHORT or b.heading:
        return "undecided"
    if not known:
        return "good" if sentence or size >= LONG else "undecided"
    return "good" if dense >= DENSE or sentence or (size >= LONG and dense >= SPARSE) else "undecided" if dense >= SPARSE else "bad"


def second_pass(found: list[Block], labels: list[str]) -> list[str]:
    """Labels with each undecided one replaced by what its nearest decided neighbours say; an article's blocks look within articles."""
    out = list(labels)
    for articles in (False, True):
        places = [i for i, b in enumerate(found) if b.article == articles and not (articles and labels[i] == "bad")]
        before: list[tuple[str, int] | None] = []
        last: tuple[str, int] | None = None
        for n, i in enumerate(places):
            before.append(last)
            if labels[i] != "undecided":
                last = (labels[i], n)
        last = None
        for n in range(len(places) - 1, -1, -1):
            i = places[n]
            if labels[i] != "undecided":
                last = (labels[i], n)
            else:
                around = {x[0] for x in (before[n], last) if x}
                if len(around) == 1:
                    out[i] = around.pop()
                elif articles:
                    out[i] = "good"
                elif around:  # labels differ: the nearer one, good if they are as near, and a heading belongs to what follows
                    after, ago = last[1] - n, n - before[n][1]
                    out[i] = last[0] if found[i].heading or after < ago else before[n][0] if ago < after else "good"
                else:
                    out[i] = "bad"
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    words = [(len(b.text.split()), b.share()) for b in found if not b.bad]
    known = sum(n * share for n, share in words) >= KNOWN * sum(n for n, _ in words)
    labels = second_pass(found, [first_pass(b, known) for b in found])
    return "\n".join(b.text for b, label in zip(found, labels, strict=True) if label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    run = F.pandas_udf(lambda pages: pages.map(main_text), "string")
    return pages.select("page_id", "url", run(F.coalesce("html", F.lit(""))).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
