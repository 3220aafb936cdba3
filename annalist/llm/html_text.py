"""Operator 10, main text of web pages by maximum-scoring subsequences.

A page is a sequence of words and tags. Each has a score, the log likelihood ratio of standing inside and outside of the
article, learned on pages whose article is marked up by exactly one ``article`` element: words score positive, tags negative.
One linear scan finds the maximum-scoring subsequences of these scores. On a page that marks its articles, a token's score
depends on whether a mark is open, too, so every article is a subsequence of its own, and all of them are the content; on a
page without marks, the best one is.

Elements that are no main text by their meaning (menus, headers, footers, sidebars, adverts, forms, scripts, styles, notices
of cookies and the like, reader comments) take no part. Their names say so (``nav``, ``aside``), their role, or a class or id
of which every part does (``ad``, ``cookie-notice``, but not ``related-work``).

Text is what the blocks of the content hold: character references decoded, each run of white space one space, blocks joined
by a blank line. Nothing is capped, and a page is scanned once from left to right, whatever is unclosed in it.

Defined cases: null, empty or text-free html gives an empty text. A tag, comment or script that isn't closed ends with the
page; a quote that isn't closed is no quote. Without training pages, fixed weights hold. Repeated rows give repeated rows;
other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_words import text_slices
from .common import table

#: The weights are learned on at most so many pages, those with the least XXH64 of their page_id.
TRAIN_PAGES = 2000
#: Tags kept with a weight of their own.
MAX_TAGS = 400
#: Most and least that a word scores where it scores positive; what a tag costs at least, at most, and outside of marks if it is unknown.
WORD, LEAST_WORD = 1.0, 0.5
LEAST, STEEPEST, UNKNOWN = 0.01, 6.0, 0.5

_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_PLAIN_END = re.compile(r"[^<>\"']*>")
_END = re.compile(r"=\s*([\"'])|>")
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in "script style textarea title iframe noembed noframes xmp".split()}
_NAMES = frozenset("nav footer aside form button select option dialog menu label fieldset legend input noscript template svg".split())
_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising advertorial sponsor sponsors sponsored sponsoring promo promos promotion banner banners cookie cookies consent gdpr notice notices"
    " popup modal overlay newsletter subscribe subscription signup paywall sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar footer footers comment comments reply replies"
    " disqus share sharing social widget widgets toolbar login pagination pager".split()
)
#: Parts that say nothing beside a hint, as in ad-box or comment-list.
_FORMS = frozenset("box block container wrapper wrap inner outer area section list item items bar slot unit body content header main page site global top bottom left right primary secondary the form thread panel zone js no user reader readers related".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr math mi mo mn mrow msup msub mfrac msqrt mtext semantics annotation".split())
_OPTIONAL = frozenset("p li dt dd tr td th option".split())
_CLOSERS = frozenset("ul ol dl table div section article body main".split())
#: Elements that no class or id removes.
_CONTENT = frozenset("main body html h1".split())
_TEASERS = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended teaser".split())


def _dropped(name: str, attributes: str, inside: int) -> bool:
    """Whether an element is no main text; inside is the number of open articles."""
    if name in _CONTENT:
        return False
    if name in _NAMES or name == "header" and not inside:
        return True
    for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" and not value or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "role" and value.lower() in _ROLES:
            return True
        if key in ("class", "id"):
            for token in value.split():
                parts = {x.lower() for x in _PARTS.findall(token)}
                if name == "article" and not parts.isdisjoint(_TEASERS):
                    return True
                if name != "article" and not parts.isdisjoint(_HINTS) and parts <= _HINTS | _FORMS:
                    return True
    return False


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """Each text ("", text, "") and tag (name, attributes, slash) of a page; comments, declarations and raw text are left out."""
    at = start = 0
    quotes, last = True, page.rfind(">")
    while (p := page.find("<", at)) >= 0:
        at = p + 1
        if page.startswith("<!--", p):
            end = page.find("-->", p + 4)
            end = len(page) if end < 0 else end + 3
            name = None
        elif page[at : at + 1] in ("!", "?") and at < len(page):
            end = page.find(">", at)
            end = len(page) if end < 0 else end + 1
            name = None
        elif m := _OPEN.match(page, p):
            name = m[2].lower()
            if plain := _PLAIN_END.match(page, m.end()):
                end = plain.end()
            elif m.end() > last:
                end = len(page)
            else:
                end, x = -1, m.end()
                while quotes and (e := _END.search(page, x)):
                    if not e[1]:
                        end = e.end()
                        break
                    close = page.find(e[1], e.end())
                    x = e.end() if close < 0 else close + 1
                if end < 0:  # quotes don't pair from here on, so they mean nothing
                    quotes = False
                    end = page.find(">", m.end()) + 1 or len(page)
            attributes, slash = page[m.end() : end - 1], m[1]
        else:
            continue
        if p > start:
            yield "", page[start:p], ""
        if name is not None:
            yield name, attributes, slash
            if not slash and (raw := _RAW.get(name)):
                close = raw.search(page, end)
                end = close.start() if close else len(page)
        at = start = end
    if start < len(page):
        yield "", page[start:], ""


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """(tag, "") for each tag, a closing one with a slash before its name, and ("", text) for each text outside dropped elements."""
    skip, depth, inside = "", 0, 0
    for name, value, slash in pieces(page):
        if not name:
            if not skip:
                yield "", value
            continue
        if skip:
            if name == skip:
                depth += -1 if slash else 0 if value.rstrip().endswith("/") or skip in _OPTIONAL else 1
            elif slash and skip in _OPTIONAL and name in _CLOSERS:
                depth = 0
            elif name in ("article", "main") and not slash and skip not in ("article", "main") and not _dropped(name, value, 0):
                depth = 0  # an article doesn't stand in a menu or an advert: the element before it wasn't closed
            if depth > 0:
                continue
            ended, skip = skip, ""
            yield "/" + ended, ""
            if ended == name:
                continue
        if name in ("article", "main"):
            inside = max(0, inside + (-1 if slash else 1))
        if not slash and name not in _VOID and not value.rstrip().endswith("/") and _dropped(name, value, inside):
            skip, depth = name, 1
            if name == "article":
                inside -= 1
        yield slash + name, ""


def maximal(scores: list[float]) -> list[tuple[int, int]]:
    """The spans of all maximal scoring subsequences, in order: the best one, then so on to its left and right (Ruzzo and Tompa)."""
    found: list[tuple[int, int, float, float]] = []  # start, end, the sum before the start and at the end
    links: list[int] = []  # of each, the nearest before it with a smaller sum before its start, -1 if none
    total = 0.0
    for n, s in enumerate(scores):
        total += s
        if s <= 0:
            continue
        start, before = n, total - s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = links[j]
            if j < 0 or found[j][3] >= total:
                found.append((start, n + 1, before, total))
                links.append(j)
                break
            start, before = found[j][0], found[j][2]
            del found[j:], links[j:]
    return [(a, b) for a, b, _, _ in found]


def scored(seen: list[tuple[str, str]], weights: dict[str, float]) -> tuple[list[float], bool]:
    """The score of each token, and whether the page marks its content; ``main`` is a mark where there is no article."""
    names = {t for t, _ in seen}
    mark = "article" if "article" in names else "main" if "main" in names else ""
    out, open_ = [], 0
    for tag, text in seen:
        if tag == "/" + mark and mark:
            open_ = max(0, open_ - 1)
        key = ("in " if open_ else "out ") + tag if mark else tag
        if tag:
            w = weights.get(key)
            out.append((-LEAST if open_ else -UNKNOWN) if w is None else min(-LEAST, max(-STEEPEST, w)))
        else:
            out.append(weights[key] * len(text.split()))
        if tag == mark and mark:
            open_ += 1
    return out, bool(mark)


def main_text(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    seen = list(tokens(page))
    scores, marked = scored(seen, weights)
    spans = maximal(scores)
    if not marked and spans:
        spans = [max(spans, key=lambda x: (sum(scores[x[0] : x[1]]), -x[0]))]
    blocks = []
    for a, b in spans:
        now: list[str] = []
        for tag, text in seen[a:b]:
            if not tag:
                now.append(text)
            elif tag.lstrip("/") not in _INLINE:
                blocks.append("".join(now))
                now = []
            elif tag == "br":
                now.append(" ")
        blocks.append("".join(now))
    return "\n\n".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    for batch in batches:
        for page in batch.column("html").to_pylist():
            seen = list(tokens(page))
            if sum(t == "article" for t, _ in seen) != 1 or ("/article", "") not in seen:
                continue
            inside = False
            for tag, text in seen:
                inside = inside and tag != "/article"
                found[tag, inside] += 1 if tag else len(text.split())
                inside = inside or tag == "article"
    keys = list(found)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([found[k] for k in keys], pa.int64())], ["tag", "inside", "n"])


#: The weights without a labelled page. A name alone is for pages without marks; "in " and "out " are for those with.
_FIXED = {"": WORD, "in ": WORD, "out ": -WORD} | {x: -LEAST for t in ("p", "br", "b", "i", "em", "strong", "a", "span", "h1", "h2", "h3", "li", "ul", "div") for x in (t, "/" + t)}


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> dict[str, float]:
    """The weight of a word (under the empty name) and of each frequent tag, alone and inside and outside of a mark."""
    marked = pages.where("page_id is not null and html rlike '(?i)<article'").select("page_id").distinct()
    some = marked.orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages)
    one = pages.join(F.broadcast(some), "page_id").groupBy("page_id").agg(F.min("html").alias("html"))
    counts = one.select("html").mapInArrow(_counts, "tag string, inside boolean, n long").groupBy("tag").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("b"))
    rows = counts.orderBy((F.col("tag") == "").desc(), (F.col("a") + F.col("b")).desc(), "tag").limit(MAX_TAGS).collect()
    return weights_of({r.tag: (r.a, r.b) for r in rows})


def weights_of(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Weights by each token's number inside and outside of articles; inside of a mark, its outside number is none."""
    if not counts:
        return dict(_FIXED)
    a, b = sum(x for x, _ in counts.values()) + len(counts), sum(y for _, y in counts.values()) + len(counts)
    ratio = lambda x, y: math.log((x + 1) / a) - math.log((y + 1) / b)
    found = dict(_FIXED)
    for tag, (x, y) in counts.items():
        found |= {tag: ratio(x, y), "in " + tag: ratio(x, 0), "out " + tag: ratio(0, y)}
    return found | {"": max(LEAST_WORD, min(WORD, found[""])), "in ": max(LEAST_WORD, min(WORD, found["in "])), "out ": -max(LEAST_WORD, min(WORD, -found["out "]))}


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "html"):
                texts = [main_text(x, weights) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
