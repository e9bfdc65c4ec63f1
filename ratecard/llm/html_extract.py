"""Main-text extraction by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative; a linear scan finds
the contiguous stretch with the largest total, which is the main content. The weights come from
labelled pages, those that mark their content with one ``<article>`` element: a word scores by the
log-odds that words in its surroundings are content (never below a small positive number), a tag
loses by the log-odds that it stands outside of content (never less than a small loss). Inside the
stretch, elements that are never content (menus, notices, adverts, forms, comments, ...) are left
out, references are decoded and blocks become lines. Where every article or main element of a page
lies in a form, a page header or an element marked by class, id or role, the elements around the
longest are kept; on a page without any, a form around most of its words is.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_PAGES = 500  # labelled pages that the weights are fitted on
LEAST_WORD, LEAST_TAG, NEW_TAG = 0.05, 0.02, 0.5
STRONG = 12.0

# a tag with quoted attribute values; failing that, up to the next ">"
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
                   r"|</?[a-zA-Z][^>]*+>|<[!?][^>]*+>", re.S | re.I)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

# HTML's void and inline elements, elements that are never part of an article's text,
# words in class, id or role that mark such elements, and words that only say where or what box it is.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span "
             "strike strong sub sup time tt u var img wbr".split())
NEVER = set("nav footer aside form script style noscript template iframe button select option textarea svg "
            "canvas object dialog menu head title".split())
MARKS = (r"(?:ad|ads|adv|advert[^\W_]*|sponsor[^\W_]*|promo[^\W_]*|banner|cookies?|consent|notices?|popup|"
         r"modal|newsletter|subscri[^\W_]+|share|sharing|social|related|recommend[^\W_]*|sidebar|widget|menu|nav|"
         r"navigation|navbar|breadcrumbs?|pagination|comments?|replies|reply|disqus|footer|masthead|"
         r"topbar|login|signup|complementary|contentinfo|search)")
BOXES = (r"(?:article|post|posts|entry|page|site|inline|in|top|bottom|left|right|bar|box|block|area|list|items?|links?|"
         r"buttons?|icons?|section|wrap|wrapper|container|inner|outer|panel|slot|unit|form|thread|[0-9x]+)")
# a whole token of such words: "no-sidebar" or the slug of a heading ("search-algorithms") hold others
MARKED = re.compile(rf"(?:^|\s)(?:{BOXES}(?=[_-])[_-]+)*+{MARKS}(?=$|[\s_-])"
                    rf"(?:[_-]+(?:{MARKS}|{BOXES})(?=$|[\s_-]))*+(?=$|\s)", re.I)
TITLED = set("h1 h2 h3 h4 h5 h6 p".split())  # their id is a name of the text
SECTIONS = set("nav header footer aside article main form section div body".split())


def marked(name: str, attributes: list[tuple[str, str]]) -> bool:
    """Do class, id or role say, by a whole token, that the element is never content?"""
    if name in ("body", "html", "article", "main"):
        return False
    return any(MARKED.search(value) for kind, value in attributes if not (kind == "id" and name in TITLED))


class Token:
    """A run of text or a tag. ``key``: the tag, or the surroundings of the text; ``skip``: inside an
    element that is never content; ``words``: of a text."""

    __slots__ = ("text", "key", "inside", "skip", "block", "words")

    def __init__(self, text, key, inside, skip, block, words=0):
        self.text, self.key, self.inside, self.skip, self.block, self.words = text, key, inside, skip, block, words


class Layout:
    """What a walk over a page saw of its article, main and form elements."""

    def __init__(self):
        self.words = 0
        self.boxes: list[tuple[int, tuple[int, ...], bool]] = []  # words, what drops it, whether for good
        self.forms: list[tuple[int, int]] = []  # words, place

    def spared(self) -> set[int]:
        """Places of elements that must not be dropped: where each article or main element lies in a
        dropped form, page header or marked element, those around the longest; on a page without any,
        a form that holds most of the page's words."""
        if any(not around for _, around, _ in self.boxes):
            return set()
        kept = [(n, around) for n, around, for_good in self.boxes if not for_good]
        if kept:
            return set(max(kept, key=lambda x: x[0])[1])
        return {at for n, at in self.forms if 2 * n > self.words} if not self.boxes else set()


def tokens(page: str) -> list[Token]:
    """The page's tokens in order; ``inside``: within an article element."""
    layout = Layout()
    seen = list(walk(page, set(), layout))
    spared = layout.spared()
    return list(walk(page, spared, Layout())) if spared else seen


def walk(page: str, spared: set[int], layout: Layout) -> Iterator[Token]:
    """The tokens, with the elements that begin at ``spared`` places not dropped."""
    stack: list[tuple] = []  # name, key, never content, place, words before, what drops it
    skips = articles = mains = at = 0

    def text(piece):
        block = next((e[0] for e in reversed(stack) if e[0] not in INLINE), "")
        section = next((e[1] for e in reversed(stack) if e[0] in SECTIONS), "")
        n = len(piece.split())
        layout.words += n
        return Token(piece, (section, block), articles > 0, skips > 0, False, n)

    def leave(to):
        nonlocal skips, articles, mains
        for n, _, never, place, before, around in stack[to:]:
            skips -= never
            articles -= n == "article"
            mains -= n == "main"
            if n in ("article", "main"):
                layout.boxes.append((layout.words - before, tuple(p for p, _ in around), any(x for _, x in around)))
            elif n == "form":
                layout.forms.append((layout.words - before, place))
        del stack[to:]

    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield text(page[at:m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if m[2]:
            to = max((i for i, s in enumerate(stack) if s[0] == name), default=None)
            if name == "article" and to is not None:
                leave(to)  # the end of an article is outside of it
                yield Token(None, "/article", articles > 0, skips > 0, True)
                continue
            yield Token(None, "/" + name, articles > 0, skips > 0, name not in INLINE)
            if to is not None:
                leave(to)
            continue
        values = [(x[1].lower(), x[2] or x[3] or x[4]) for x in ATTRIBUTE.finditer(m[4]) if x[2] or x[3] or x[4]]
        marks = " ".join(v for _, v in values)
        key = f"{name}.{marks.lower().split()[0]}" if marks.strip() else name
        for_good = name in NEVER and name != "form"
        never = for_good or name == "form" or marked(name, values) or name == "header" and not articles + mains
        never = never and m.start() not in spared
        yield Token(None, key, articles > 0, skips > 0 or never, name not in INLINE)
        if name not in VOID and not m[4].endswith("/"):
            around = [(e[3], e[0] in NEVER and e[0] != "form") for e in stack if e[2]] if name in ("article", "main") else ()
            stack.append((name, key, never, m.start(), layout.words, around))
            skips += never
            articles += name == "article"
            mains += name == "main"
    if at < len(page):
        yield text(page[at:])
    leave(0)


def page_counts(page: str) -> tuple[Counter, Counter]:
    """How often tags, and words by their surroundings, occur inside and outside of the article."""
    inside, outside = Counter(), Counter()
    for t in tokens(page):
        side = inside if t.inside and not t.skip else outside
        if t.text is None:
            side[t.key] += 1
        else:
            for k in (t.key, t.key[1:]):  # in this section, and in any
                side[k] += t.words
    return inside, outside


class Weights:
    """Log-odds of being content for tags, and for words by their surroundings."""

    def __init__(self, pages: Iterable[str] = ()):
        counts = [page_counts(page) for page in pages]
        self.count(sum((i for i, _ in counts), Counter()), sum((o for _, o in counts), Counter()))

    def count(self, inside: Counter, outside: Counter) -> Weights:
        self.odds = {k: math.log((inside[k] + 0.5) / (outside[k] + 0.5)) for k in inside.keys() | outside.keys()}
        return self

    def word(self, t: Token) -> float:
        if t.skip:
            return LEAST_WORD
        odds = self.odds.get(t.key, self.odds.get(t.key[1:], 1.0))
        return max(LEAST_WORD, min(odds, 2.0))

    def tag(self, t: Token) -> float:
        if t.skip and t.inside:
            return -LEAST_TAG  # a notice within an article does not part it
        name = t.key.split(".")[0]
        if t.inside and t.key != "/article":
            # within an article element, labelled pages without this tag say little against it
            return -max(LEAST_TAG, min(-self.odds.get(t.key, -1.0) / 2.0, NEW_TAG))
        odds = self.odds.get(t.key, self.odds.get(name, -STRONG if t.skip else -1.0))
        return -STRONG * max(LEAST_TAG / STRONG, min(-odds / 2.0, 1.0))


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the contiguous stretch with the largest positive sum; of equal
    ones the first. (0, 0) if no sum is positive."""
    best, total, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, weights: Weights) -> str:
    """The text of the best stretch, a line per block."""
    seen = tokens(page or "")
    scores = [weights.tag(t) if t.text is None else weights.word(t) * t.words for t in seen]
    a, b = best_stretch(scores)
    blocks, now = [], []
    for t in seen[a:b]:
        if t.text is None:
            if t.block and now:
                blocks.append("".join(now))
                now = []
        elif not t.skip:
            now.append(t.text)
    blocks.append("".join(now))
    lines = (" ".join(htmllib.unescape(x).split()) for x in blocks)
    return "\n".join(x for x in lines if x)


def fit_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", n: int = FIT_PAGES) -> Weights:
    """Weights from ``n`` labelled pages, the first in the order of a hash of their ids. Without any
    labelled page, words and tags keep fixed weights. Pages are counted where they lie; only the counts
    of their tags and surroundings go to the driver."""
    html = F.col(html_col)
    labelled = pages.filter((F.length(html) - F.length(F.replace(html, F.lit("<article"), F.lit("")))) == 8)
    first = labelled.select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(n).collect()
    chosen = (labelled.filter(F.col(id_col).isin([r["id"] for r in first])).groupBy(id_col)
              .agg(F.min(html).alias("html")).select("html"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page in batch["html"]:
                rows = [((k, "", "", 0) if isinstance(k, str) else ("", k[0] if len(k) == 2 else "", k[-1], len(k)))
                        + (side, times) for side, counts in enumerate(page_counts(page)) for k, times in counts.items()]
                yield pd.DataFrame(rows, columns=["tag", "section", "block", "parts", "side", "n"])

    sums = (chosen.mapInPandas(counted, "tag string, section string, block string, parts int, side int, n long")
            .groupBy("tag", "section", "block", "parts", "side").agg(F.sum("n").alias("n")).collect())
    sides = Counter(), Counter()
    for r in sums:
        key = (r["tag"], (r["block"],), (r["section"], r["block"]))[r["parts"]]
        sides[r["side"]][key] += r["n"]
    return Weights().count(*sides)


def extract(pages: DataFrame, weights: Weights | None = None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """Per row: the id, the url, ``text`` and ``n_chars`` (code points).

    Null html is empty; an empty page, or one without words, has empty text. Rows are independent, so
    repeated rows give equal results and a null id or url is passed on; an empty table gives an empty
    result; other columns are ignored."""
    weights = weights or fit_weights(pages, id_col, html_col)

    @F.pandas_udf("string")
    def text(htmls: pd.Series) -> pd.Series:
        return htmls.map(lambda h: main_text(h, weights))

    return (pages.select(F.col(id_col), F.col(url_col), text(F.coalesce(F.col(html_col), F.lit(""))).alias("text"))
            .withColumn("n_chars", F.char_length("text").cast("long")))
