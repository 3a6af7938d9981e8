"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block; menus, headers, footers, adverts, comments and the like are left out
whatever their size. A line's weight is its text outside links, several times that in an article. Weights are summed over
a sliding window of lines; windows that reach a share of the page's largest sum, and are not mostly links, pick the text.
With them stay the short lines of the same element and the article that they lie in. All steps are linear in the page.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_batches

WINDOW = 3
#: Least sum of a window that belongs to a text, as a share of the page's largest.
SURGE = 0.2
#: What text in an article or main element weighs.
BONUS = 3
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|noscript|template|iframe|svg|math|textarea|select|object|canvas|audio|video|xmp)\b[^>]*?(?:/>|>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|</?(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[^<>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^<>]*+\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Elements of HTML by their part in a page, and names that mark what isn't the article.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
SKIPPED = set("head title nav header footer aside form menu dialog button label fieldset".split())
#: Asides that also wrap whole pages.
WRAPPERS = {"form", "fieldset"}
#: Parts of a page that a form or a named element holds only if it wraps the page.
LANDMARKS = {"nav", "header", "footer", "aside"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_BLOCK = {"p", "li", "dt", "dd", "option"}
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adbox|adsense|adunit|banner\w*|sponsor\w*|promo\w*|side-?bar\w*|side|nav|navbar|navigation|navi|menu\w*|breadcrumbs?|foot|footer\w*|header|masthead|topbar|cookies?|consent|gdpr"
    r"|notice\w*|alert|popup|pop-up|modal|overlay|newsletter|subscribe\w*|signup|login|share|sharing|social\w*|related\w*|recommend\w*|comments?|comment-?list|commentlist|disqus\w*|respond|replies|reply|widget\w*|toolbar|pagination|pager"
    r"|copyright|legal|disclaimer|hidden|skip-?link)(?:$|[\s_-])",
    re.I,
)

#: Names that are never those of a page's wrapper, but for what follows a "with" or "has".
FINAL = re.compile(
    r"(?:^|\s)(?!(?:has|with|no|show|hide)[_-])(?:[\w-]*[_-])?(?:ad|ads|adv|advert\w*|adbox|adsense|adunit|sponsor\w*|cookies?|consent|gdpr|popup|pop-up|modal|overlay|newsletter|subscribe\w*|signup|login|share|sharing|social\w*|related\w*|recommend\w*"
    r"|comments?|comment-?list|commentlist|disqus\w*|respond|replies|reply)(?:$|[\s_-])",
    re.I,
)


def aside_kind(tag: str, rest: str) -> str:
    """final, name or wrapper (asides unless they wrap the page), or nothing."""
    if tag in SKIPPED:
        return "wrapper" if tag in WRAPPERS else "final"
    if not rest or tag in ("body", "html", "main"):
        return ""
    kind = ""
    for name, *values in ATTRIBUTE.findall(rest):
        value = "".join(values)
        if name.lower() == "role":
            if value.lower() in ROLES:
                return "wrapper" if value.lower() == "form" else "final"
        elif found := NAMES.search(value):
            if FINAL.search(value):
                return "final"
            kind = kind if kind == "name" or found[0].strip(" _-") != value.strip() else "name"
            kind = kind or "wrapper"
    return kind


def is_hidden(rest: str) -> bool:
    return bool(rest and re.search(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true", rest, re.I))


class Line(NamedTuple):
    text: str
    links: int  # code points inside links
    article: int  # number of the outermost article or main element around it, or 0
    element: int  # number of the innermost element around it, 0 for the page
    low: tuple[int, int]  # depth and number of the element around it and the line before


class Element(NamedTuple):
    parent: int
    first: int  # its lines are first .. last - 1
    last: int


def blocks(page: str, held: frozenset[int] | None = None) -> tuple[list[Line], list[Element]]:
    """The page's lines in order, without the text of asides, and its elements.

    A form, or an element that is an aside by a name of the layout, is none if it wraps the page: if a main element lies
    in it, or an article (for a form, any landmark) beside landmarks. Where the page has no text otherwise, the outermost
    forms and elements whose name says more than the aside's own are none. Comments, adverts and such are final.
    """
    out: list[Line] = []
    elements: list[Element] = [Element(0, 0, 0)]
    stack: list[tuple[str, str, bool, int, tuple[int, int, int], int]] = []  # tag, kind, article, number, seen before it, first line
    tops: list[int] = []  # places of blocks in the stack
    open_tags: dict[str, int] = {}
    parts: list[str] = []
    wraps: set[int] = set()
    outermost: set[int] = set()
    links = skipping = link = final = marked = outer = mains = articles = landmarks = 0
    low = (0, 0)

    def flush() -> None:
        nonlocal links, low
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            here = stack[-1][3] if stack else 0
            out.append(Line(text, min(links, len(text)), outer, here, low))
            low = (len(stack), here)
        parts.clear()
        links = 0

    def close(k: int) -> None:
        nonlocal skipping, marked, final, link, low, outer
        while len(stack) > k:
            tag, kind, main, n, before, first = stack.pop()
            open_tags[tag] -= 1
            if tops and tops[-1] == len(stack):
                tops.pop()
            elements[n] = Element(elements[n].parent, first, len(out))
            if kind in ("name", "wrapper"):
                m, a, marks = mains - before[0], articles - before[1], landmarks - before[2]
                if m or (marks and (a or tag in WRAPPERS)):
                    wraps.add(n)
            skipping -= bool(kind)
            final -= kind == "final"
            marked -= main
            outer = outer if marked else 0
            link -= tag == "a"
        if k < low[0]:
            low = (k, stack[-1][3] if stack else 0)

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at and not skipping:
            parts.append(page[at : m.start()])
            links += m.start() - at if link else 0
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"] and not skipping:
                parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCKS:
            flush()
        if page[m.start() + 1] == "/":
            if open_tags.get(tag):
                # an inline end tag ends nothing beyond the innermost block
                least = -1 if tag in BLOCKS or not tops else tops[-1]
                k = next((i for i in range(len(stack) - 1, least, -1) if stack[i][0] == tag), None)
                if k is not None:
                    close(k)
            continue
        if tag in BLOCKS and stack and stack[-1][0] not in BLOCKS:
            close(tops[-1] + 1 if tops else 0)  # a block ends inline elements that were left open
        if tag in BLOCKS and stack and stack[-1][0] in CLOSED_BY_BLOCK and (tag == stack[-1][0] or stack[-1][0] == "p"):
            close(len(stack) - 1)
        if tag == "body" and open_tags.get("head"):
            close(next(i for i, s in enumerate(stack) if s[0] == "head"))
        if tag in VOID or m["rest"].endswith("/"):
            continue
        n, main = len(elements), tag in ("article", "main")
        kind = "final" if tag not in ("body", "html", "main") and is_hidden(m["rest"]) else aside_kind(tag, m["rest"])
        if kind in ("name", "wrapper"):
            if not skipping and (kind == "wrapper" or main):
                outermost.add(n)
            kind = "" if held is not None and n in held else kind
        before = (mains, articles, landmarks)
        if not final:
            mains += tag == "main"
            articles += tag == "article"
            landmarks += tag in LANDMARKS
        elements.append(Element(stack[-1][3] if stack else 0, 0, 0))
        if tag in BLOCKS:
            tops.append(len(stack))
        stack.append((tag, kind, main, n, before, len(out)))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        skipping += bool(kind)
        final += kind == "final"
        marked += main
        outer = outer or (n if main else 0)
        link += tag == "a"
    if at < len(page) and not skipping:
        parts.append(page[at:])
        links += len(page) - at if link else 0
    flush()
    close(0)
    elements[0] = Element(0, 0, len(out))
    if held is None and wraps:
        return blocks(page, frozenset(wraps))
    if not out and outermost - (held or set()):
        return blocks(page, (held or frozenset()) | outermost)
    return out, elements


def main_text(page: str | None) -> str:
    lines, elements = blocks(page or "")
    plain = [len(line.text) - line.links for line in lines]
    weights = [w * (BONUS if line.article else 1) for line, w in zip(lines, plain, strict=True)]
    # windows end where an article begins or ends
    ends, end = [0] * len(lines), len(lines)
    for i in reversed(range(len(lines))):
        end = i + 1 if i + 1 < len(lines) and lines[i].article != lines[i + 1].article else end
        ends[i] = min(i + WINDOW, end)
    sums = [sum(weights[i : ends[i]]) for i in range(len(lines))]
    most = max(sums, default=0)
    picked: set[int] = set()
    for i, total in enumerate(sums):
        if total and total >= SURGE * most and sum(plain[i : ends[i]]) >= sum(line.links for line in lines[i : ends[i]]):
            picked |= {j for j in range(i, ends[i]) if plain[j]}
    articles = {lines[i].article for i in picked} - {0} or ({line.article for line in lines} if not picked else set())
    core = [i for i in sorted(picked) if weights[i] >= SURGE * most / WINDOW and not lines[i].article]
    around = [0] * (len(lines) + 1)  # 1 where an element that is kept whole begins, -1 behind it
    for i, j in zip(core, [*core[1:], None], strict=False):
        # the element of this long line and the next, or the parent of the only one
        if j is not None and j - i <= 2 * WINDOW:
            whole = min(lines[k].low for k in range(i + 1, j + 1))[1]
        else:
            whole = elements[lines[i].element].parent
        around[elements[whole].first] += 1
        around[elements[whole].last] -= 1
    inside, kept = 0, []
    for k, line in enumerate(lines):
        inside += around[k]
        if (line.article and line.article in articles) or k in picked or (not line.article and plain[k] > line.links and inside):
            kept.append(k)
    # a few lines of links between lines that stay
    gaps = [k for a, b in zip(kept, kept[1:], strict=False) if b - a <= WINDOW + 1 for k in range(a + 1, b) if lines[k].article == lines[a].article == lines[b].article]
    return "\n\n".join(lines[k].text for k in sorted({*kept, *gaps}))


def extract_batches(batches):
    for batch in batches:
        texts = [main_text(page) for page in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.record_batch([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text (the article's blocks joined by a blank line), n_chars.

    Null and empty pages, and pages without an article, give an empty text. Very long and deeply nested pages are taken
    whole, in time linear in their length. Pages that repeat are extracted one by one; no rows give no rows; other
    columns are not read.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(extract_batches, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
