"""Main text of web pages by maximum-scoring subsequence.

A page becomes a sequence of tokens, words and tags. Words score positive and tags negative; how much is the log-odds that labelled
pages give to the block that words stand in, to links, to tags, and to standing in an article element or beside one (pages with one
article or main element label themselves; at most label_pages of them are used). Words in elements that are boilerplate by tag, name
or learned name score negative. One linear scan finds the contiguous region with the largest sum; its ends move out to block edges,
and its words that score negative are left out of the text. Nothing but the scan decides where the text begins and ends.
"""

from __future__ import annotations

import html as html_lib
import itertools
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, table, with_text

#: Labelled pages that the weights are fitted on: those with the smallest hashes.
LABEL_PAGES = 400

TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>]+)))?""")
RAW = frozenset("script style template noscript textarea svg iframe head".split())
CLOSING = {x: re.compile(f"</{x}", re.I) for x in RAW}
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and names of class, id or role that mark what isn't part of an article, and words of names that only tell of a state.
BOILERPLATE_TAGS = frozenset("nav aside footer header form menu button select dialog".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead comment comments discussion disqus reply replies cookie cookies consent notice notices popup modal newsletter subscribe "
    "subscription signup share sharing social related recommended widget toolbar pagination pager search login complementary contentinfo".split()
)
STATES = frozenset("no not has have with without is on off enabled disabled show shown hide hidden open closed toggle active ready".split())
ARTICLES = frozenset(("article", "main"))
#: An element that holds more than this share of a page's words is no boilerplate, whatever its name.
MOST_OF_PAGE = 0.6


def is_boilerplate_name(name: str) -> bool:
    """A whole name of the list, or a compound that begins or ends with one and tells of no state (no-sidebar, share-enabled)."""
    if name in BOILERPLATE_NAMES:
        return True
    parts = re.split(r"[-_]+", name)
    return len(parts) > 1 and (parts[0] in BOILERPLATE_NAMES or parts[-1] in BOILERPLATE_NAMES) and not STATES.intersection(parts)


def names_of(attributes: str) -> tuple[list[str], bool]:
    """Names of class, id and role, and whether the element is hidden."""
    names, hidden = [], False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            names += value.split()
        elif key == "hidden":
            hidden |= value != "until-found"
        elif key == "aria-hidden":
            hidden |= value == "true"
        elif key == "style":
            hidden |= "display:none" in re.sub(r"\s+", "", value)
    return names, hidden


def tokens_of(source: str) -> list[tuple[str, str, str]]:
    """(kind, name or text, attributes); kinds: w text, o opening, c closing tag. One pass: what is not found once isn't looked for
    again."""
    out: list[tuple[str, str, str]] = []
    at, n, strict = 0, len(source), True
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            out.append(("w", source[at:lt], ""))
        if lt == n:
            break
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        m = TAG.match(source, lt + 1)
        if not m:
            if source[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
            else:  # a plain character
                out.append(("w", "<", ""))
                at = lt + 1
            continue
        whole = ATTRIBUTES.match(source, m.end()) if strict else None
        if whole:
            end = whole.end()
        else:  # quotes that never close: from here on tags end at the first >
            strict = False
            end = source.find(">", m.end()) + 1
            if not end:  # no tag ends any more: what is left is a piece of one
                break
        name = m[2].lower()
        if not m[1] and name in RAW and source[end - 2] != "/":
            closing = CLOSING[name].search(source, end)
            if not closing:
                break
            close = source.find(">", closing.end())
            at = n if close < 0 else close + 1
            continue
        out.append(("c" if m[1] else "o", name, source[m.end() : end - 1]))
        at = end
    return out


class Page:
    """tokens; words: words before each token; of each token marked, link and inside: whether a boilerplate element, a link or an
    article holds it; spans: first and last token of elements with other names, and the names."""

    def __init__(self, source: str):
        self.tokens = tokens_of(source)
        n = len(self.tokens)
        self.words = [0]
        for kind, text, _ in self.tokens:
            self.words.append(self.words[-1] + (len(text.split()) if kind == "w" else 0))
        self.close = self.pairs()
        self.marked, self.link, self.inside = ([0] * (n + 1) for _ in range(3))
        self.spans: list[tuple[int, int, list[str]]] = []
        articles = [(k, e) for k, e in self.close.items() if self.tokens[k][1] in ARTICLES]
        for k, e in articles:
            self.inside[k] += 1
            self.inside[e + 1] -= 1
        held = self.running(self.inside)
        marked = []
        for k, (kind, name, attributes) in enumerate(self.tokens):
            if kind != "o" or name in VOID:
                continue
            if name == "a" and k in self.close:
                self.link[k] += 1
                self.link[self.close[k]] -= 1
            names, hidden = names_of(attributes) if attributes else ([], False)
            # the header of an article is its headline
            mark = hidden or name in BOILERPLATE_TAGS and not (name == "header" and held[k])
            if not mark and name not in ("body", "html", "article", "main"):
                mark = any(map(is_boilerplate_name, names)) and not (held[k] and name == "header")
            if mark:
                marked.append(k)
            elif names and name not in ("body", "html"):
                self.spans.append((k, self.end_of(k), names))
        limit = MOST_OF_PAGE * self.words[-1]
        for k in marked:
            e = self.end_of(k)
            if self.words[e + 1] - self.words[k] <= limit or self.tokens[k][1] in BOILERPLATE_TAGS - {"form", "header"}:
                self.marked[k] += 1
                self.marked[e + 1] -= 1
        self.marked, self.link, self.inside = self.running(self.marked), self.running(self.link), held
        self.has_article = any(self.inside)
        self.articles = articles

    @staticmethod
    def running(steps: list[int]) -> list[int]:
        return list(itertools.accumulate(steps))

    def end_of(self, k: int) -> int:
        """The last token of an element; one that is never closed ends before the next block."""
        if k in self.close:
            return self.close[k]
        e = self.next_block[k]
        return max(k, e - 1)

    def pairs(self) -> dict[int, int]:
        """Of opening tags, the closing ones: the nearest of the same name that is balanced."""
        open_: dict[str, list[int]] = {}
        close: dict[int, int] = {}
        n = len(self.tokens)
        self.next_block = [n] * (n + 1)
        for k, (kind, name, attributes) in enumerate(self.tokens):
            if kind == "o" and not attributes.endswith("/"):
                open_.setdefault(name, []).append(k)
            elif kind == "c" and open_.get(name):
                close[open_[name].pop()] = k
        later = n
        for k in range(n - 1, -1, -1):
            self.next_block[k] = later
            if self.tokens[k][0] != "w" and self.tokens[k][1] in BLOCKS:
                later = k
        return close

    def learned(self, weights: dict[str, float]) -> list[int]:
        """Of each token whether it stands under a name that labelled pages have outside their articles only."""
        steps = [0] * (len(self.tokens) + 1)
        for k, e, names in self.spans:
            if any(weights.get(f"m:{x}", 0.0) < 0 for x in names) and self.words[e + 1] - self.words[k] <= MOST_OF_PAGE * self.words[-1]:
                steps[k] += 1
                steps[e + 1] -= 1
        return self.running(steps)

    def features(self) -> list[tuple[str, str, int]]:
        """Of each token what its weight hangs on: key, where it stands (s:i in an article, s:o beside one), and words (0: a tag)."""
        out, block = [], ""
        for k, (kind, name, _) in enumerate(self.tokens):
            if kind == "w":
                out.append((f"w:{block}:{'a' if self.link[k] else ''}", ("s:i" if self.inside[k] else "s:o") if self.has_article else "", self.words[k + 1] - self.words[k]))
            else:
                if name in BLOCKS:
                    block = name if kind == "o" else ""
                out.append((f"t:{name}", "", 0))
        return out

    def text(self, a: int, b: int, left_out: list[bool]) -> str:
        """The blocks of tokens a to b; tokens that are left_out end no block."""
        blocks: list[str] = []
        now: list[str] = []

        def end():
            if now:
                if t := " ".join(html_lib.unescape("".join(now)).split()):
                    blocks.append(t)
                now.clear()

        for k in range(a, b + 1):
            kind, name, _ = self.tokens[k]
            if kind == "w":
                if not left_out[k]:
                    now.append(name)
            elif name in BLOCKS:
                end()
            elif name == "br":
                now.append(" ")
        end()
        return "\n".join(blocks)


#: Without labelled pages: words count 1, those of links in lists and bare links less; blocks cost more than tags inside them.
MARKED = -0.25
LINKS = -0.5


def weight_of(key: str, weights: dict[str, float]) -> float:
    if key in weights:
        return weights[key]
    if key[0] == "t":
        return -0.5 if key[2:] in BLOCKS else -0.05
    block, _, link = key[2:].partition(":")
    return LINKS if link and block not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "td", "dd") else 1.0


def scores_of(page: Page, weights: dict[str, float]) -> list[float]:
    learned = page.learned(weights)
    out = []
    for k, (key, place, n) in enumerate(page.features()):
        if key[0] == "t":
            out.append(0.0 if page.marked[k] else weight_of(key, weights))
        elif page.marked[k] or learned[k]:
            out.append(n * MARKED)
        else:
            out.append(n * (weight_of(key, weights) + weights.get(place, 0.0)))
    return out


def best_region(scores: list[float]) -> tuple[int, int] | None:
    """The linear scan for the contiguous tokens with the largest sum of scores."""
    best, top, run, start = None, 0.0, 0.0, 0
    for k, score in enumerate(scores):
        if run <= 0:
            run, start = 0.0, k
        run += score
        if run > top:
            top, best = run, (start, k)
    return best


def extract(source: str | None, weights: dict[str, float] | None = None) -> str:
    """Main text of one page; empty for null, for markup without words and where no region scores above 0."""
    page = Page(source or "")
    scores = scores_of(page, weights or {})
    found = best_region(scores)
    if not found:
        return ""
    a, b = found
    edge = lambda k: page.tokens[k][0] != "w" and page.tokens[k][1] in BLOCKS
    while a > 0 and not edge(a - 1):
        a -= 1
    while b + 1 < len(scores) and not edge(b + 1):
        b += 1
    return page.text(a, b, [s < 0 for s in scores])


def label_counts(source: str | None) -> list[tuple[str, int, int]]:
    """(feature, words or tags inside the article, outside) of a page that labels itself, else nothing."""
    page = Page(source or "")
    articles = [x for x in page.articles if page.tokens[x[0]][1] == "article"] or page.articles
    if len(articles) != 1:
        return []
    a, b = articles[0]
    inside, outside = Counter(), Counter()
    for k, (key, place, n) in enumerate(page.features()):
        if key[0] == "t":
            if key[2:] not in ARTICLES:
                (inside if a <= k <= b and not page.marked[k] else outside)[key] += 1
        elif not page.marked[k]:
            for x in (key, place):
                (inside if a <= k <= b else outside)[x] += n
    for k, e, names in page.spans:
        n = page.words[e + 1] - page.words[k]
        within = max(0, page.words[min(e, b) + 1] - page.words[max(k, a)]) if k <= b and e >= a else 0
        for x in names:
            inside[f"m:{x}"] += within
            outside[f"m:{x}"] += n - within
    return [(k, inside[k], outside[k]) for k in {*inside, *outside}]


def fit_weights(pages: DataFrame, html_col: str = "html", *, label_pages: int = LABEL_PAGES) -> dict[str, float]:
    """Weights from at most label_pages pages: log-odds of being inside, words of blocks held above 0, tags below."""
    fields = [T.StructField("counts", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("inside", T.LongType()), T.StructField("outside", T.LongType())])))]
    picked = pages.select(col(html_col).alias("html")).filter(F.col("html").rlike("(?i)<(article|main)[ >]")).orderBy(F.xxhash64("html"), "html").limit(label_pages)
    rows = with_text(picked.repartition(8), "html", lambda texts: {"counts": [label_counts(t) for t in texts]}, fields, keep=[])
    rows = rows.select(F.explode("counts").alias("c")).groupBy("c.key").agg(F.sum("c.inside").alias("i"), F.sum("c.outside").alias("o"))
    weights = {}
    for r in rows.collect():  # one row for each tag and name that occurs in the labelled pages
        odds = math.log((r.i + 0.5) / (r.o + 0.5))
        if r.key.startswith("w:"):
            weights[r.key] = min(max(odds / 4, 0.25), 2.0) if odds > -1 else LINKS
        elif r.key.startswith("s:"):
            weights[r.key] = min(max(odds, -2.5), 0.5)
        elif r.key.startswith("m:"):
            if odds < -3:
                weights[r.key] = MARKED
        else:
            weights[r.key] = max(min(odds / 4, 0.0), -1.0) - 0.05
    return weights


def extract_pages(pages: DataFrame, html_col: str = "html", *, weights: dict[str, float] | None = None, keep: list[str] | None = None) -> DataFrame:
    """row (the columns in keep, all by default) and text, one row for each row of pages; weights are fitted if not given.

    Null, empty and wordless pages give an empty text. Repeated pages are each extracted; no page is cut. An empty table gives no rows.
    """
    weights = fit_weights(pages, html_col) if weights is None else weights
    return with_text(pages, html_col, lambda texts: {"text": [extract(t, weights) for t in texts]}, [T.StructField("text", T.StringType())], keep=keep)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; nulls, empty pages and repeats as extract_pages has them."""
    found = extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op2_html_extract": op2_html_extract}
ORACLES: dict[str, str] = {}
