"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veduta.llm.tables import without

#: Lines in a sliding window, and the window sum from which text surges.
WINDOW, SURGE = 3, 80
#: Link-only lines in a row that make a menu.
MENU = 3

#: A value in quotes. One that spans a '>' counts only if its closing quote ends it as a value's should, and
#: does not open the value of a later tag; otherwise the quote is a stray one and the tag ends at the next '>'.
_QUOTED = "|".join(rf"{q}[^{q}>]*{q}|{q}[^{q}]*+(?<!=){q}(?=[\s/>]|\Z)" for q in "\"'")
#: An attribute as browsers read it: quotes pair only at the start of a value.
_PAIR = rf"(=?[^\s/>=]+)(?:\s*=\s*({_QUOTED}|[^\s\"'>][^\s>]*)?)?"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|(?>{_PAIR})|=)*+)>", re.S)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe")}
_ATTRIBUTE = re.compile(_PAIR, re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_STRUCTURE = frozenset("article aside body div dl footer form header main nav ol section table ul".split())
_CONTAINER = frozenset(("article", "main"))
_SKIPPED = frozenset("aside audio button canvas datalist dialog embed footer form head header iframe input label map menu nav noscript object script select style svg template textarea title video".split())
#: Skipped elements that some pages put around everything, as the attribute hidden also is.
_AROUND = frozenset("dialog form label menu".split())
_MAY_BE_AROUND = re.compile(rf"(?i)<(?:{'|'.join(sorted(_AROUND))})\b|<[^<>]*\shidden\b")
#: Words in a class, id or role that mark an element as not part of the article.
_MARKS = frozenset(
    "ad ads advert advertisement advertising adverts alert aside banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion related reply replies search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
#: Words that may go with marks in a class, id or role: ``ad-slot`` is a mark, ``no-sidebar`` and ``social-science`` are not.
_BESIDE = frozenset("area bar block bottom box btn button buttons center container form global group icon icons inner item items left link links list mobile outer panel placement primary right row secondary section site slot small space sticky top unit wrap wrapper".split())


def _attributes(text: str) -> Iterator[tuple[str, str]]:
    """(lower-case name, value without quotes) of every attribute of a tag."""
    for m in _ATTRIBUTE.finditer(text):
        yield m[1].lower(), (m[2] or "").strip("\"'")


def _marked(name: str, attributes: str, own_header: bool) -> bool:
    """Whether a whole class, id or role says that an element is not part of the article.

    That an article's own header is called a header says nothing."""
    marks = _MARKS - {"header"} if own_header else _MARKS
    if name in ("html", "body", "article", "main") or not attributes:
        return False
    for key, value in _attributes(attributes):
        for token in value.lower().split() if key in ("class", "id", "role") else ():
            parts = set(re.findall(r"[^\W\d_]+", token))
            if parts & marks and parts <= _MARKS | _BESIDE:
                return True
    return False


def _boilerplate(name: str, attributes: str) -> bool:
    if name in _SKIPPED:
        return True
    return name not in ("html", "body", "article", "main") and "hidden" in attributes.lower() and any(key == "hidden" for key, _ in _attributes(attributes))


def page_lines(html: str) -> list[tuple[str, bool, bool]]:
    """(text, link only, inside article or main) of every line of a page's visible text.

    A line ends where a block element begins or ends. Boilerplate elements are left out, but not the
    header of an article or main, which is its own; the edge of a structural element leaves an empty
    line. An unfinished tag or comment ends the page.
    Neither a class, id or role nor a form, label, menu, dialog or the attribute hidden leaves out an element
    that holds a ``main``, the longest ``article`` or more than half of the page's text."""
    around = _holders("around", *_walked(html, None, None)[1:]) if _MAY_BE_AROUND.search(html) else set()
    lines, spans, total = _walked(html, None, around)
    left_out = {x[1] for x in spans if x[0] == "marked"} - _holders("marked", spans, total)
    return _walked(html, left_out, around)[0] if left_out else lines


def _holders(kind: str, spans: list[tuple[str, int, int, int]], total: int) -> set[int]:
    """Starts of the elements of a kind that hold a main with text, the longest article or over half of all text."""
    mains = sorted(start for k, start, _, size in spans if k == "main" and size)
    longest = max((x for x in spans if x[0] == "article" and x[3]), key=lambda x: x[3], default=None)
    out = set()
    for k, start, end, size in spans:
        main = bisect(mains, start) < bisect(mains, end)
        if k == kind and (main or (longest and start < longest[1] < end) or 2 * size > total):
            out.add(start)
    return out


def _walked(html: str, marked_out: set[int] | None, staying: set[int] | None) -> tuple[list[tuple[str, bool, bool]], list[tuple[str, int, int, int]], int]:
    """Lines, leaving out the marked elements that start at ``marked_out``; then, if that is None,
    (marked, around, article or main; start; end; characters) of elements; and the characters of the page.
    Of elements that may be around everything those that start at ``staying`` stay, or all if that is None."""
    lines: list[tuple[str, bool, bool]] = []
    spans: list[tuple[str, int, int, int]] = []
    stack: list[tuple[str, int]] = []  # element, 1 where it begins to be left out
    open_: Counter[str] = Counter()  # elements in the stack by name
    blocks: list[int] = []  # places of block elements in the stack
    opened: list[tuple[int, str, int, int]] = []  # depth in the stack, kind, start, characters before
    text: list[str] = []
    linked = plain = False
    skipped = inside = links = at = seen = 0

    def flush(blank: bool) -> None:
        nonlocal linked, plain
        line = " ".join(unescape("".join(text)).split())
        text.clear()
        if line:
            lines.append((line, linked and not plain, inside > 0))
        if blank and any(x[0] for x in lines[-WINDOW:]):
            lines.append(("", False, inside > 0))
        linked = plain = False

    def add(piece: str) -> None:
        nonlocal linked, plain, seen
        if piece and not skipped:
            text.append(piece)
            if solid := piece.strip():
                seen += len(solid)
                if links:
                    linked = True
                else:
                    plain = True

    def pop(to: int) -> None:
        nonlocal skipped, inside, links
        while len(stack) > to:
            name, change = stack.pop()
            open_[name] -= 1
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            while opened and opened[-1][0] == len(stack):
                _, kind, start, before = opened.pop()
                spans.append((kind, start, at, seen - before))
            if not change and not skipped and name in _BLOCK:
                flush(name in _STRUCTURE)
            skipped -= change
            inside -= name in _CONTAINER
            links -= name == "a"

    size = len(html)
    while at < size:
        cut = html.find("<", at)
        if cut < 0:
            add(html[at:])
            break
        add(html[at:cut])
        m = _TAG.match(html, cut)
        if not m:
            if re.match(r"</?[a-zA-Z]", html[cut : cut + 3]):
                break  # a tag that never ends
            add("<")
            at = cut + 1
            continue
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if open_[name]:
                to = len(stack) - 1
                while stack[to][0] != name:
                    to -= 1
                pop(to)
            continue
        if name in _RAW_END:
            end = _RAW_END[name].search(html, at)
            at = end.end() if end else size
            continue
        if name == "br":
            add(" ")
            continue
        if name in _BLOCK:
            around = stack[blocks[-1]][0] if blocks else ""
            if around == "p" or name == around == "li":
                pop(blocks[-1])
            if not skipped:
                flush(name in _STRUCTURE)
        if name in _VOID:
            continue
        own_header = name == "header" and inside > 0
        left_out = _boilerplate(name, m[3]) and not own_header
        if left_out and (name in _AROUND or name not in _SKIPPED) and (staying is None or cut in staying):
            left_out = False
            if staying is None:
                opened.append((len(stack), "around", cut, seen))
        if marked_out is not None:
            left_out = left_out or cut in marked_out
        elif name in _CONTAINER:
            opened.append((len(stack), name, cut, seen))
        elif not left_out and _marked(name, m[3], own_header):
            opened.append((len(stack), "marked", cut, seen))
        if left_out and not skipped:
            flush(False)
        change = int(left_out)
        skipped += change
        inside += name in _CONTAINER
        links += name == "a"
        open_[name] += 1
        if name in _BLOCK:
            blocks.append(len(stack))
        stack.append((name, change))
    at = size
    pop(0)
    flush(False)
    return lines, spans, seen


def line_weights(lines: list[tuple[str, bool, bool]]) -> list[int]:
    """A line's part in window sums: its length, but 0 in menus (MENU or more link-only lines in a row
    outside ``article`` and ``main``, in which lists of links are text).

    Where a page has an ``article`` or ``main`` with text, its lines carry SURGE besides, so that text
    surges with the first of them however short, and lines outside it carry nothing."""
    contained = any(text and inside for text, _, inside in lines)
    weight = [0 if (link and not inside) or (contained and not inside) else len(text) for text, link, inside in lines]
    run = 0
    for i, (_, link, _) in enumerate([*lines, ("", False, False)]):
        if link:
            run += 1
            continue
        if 0 < run < MENU:
            for k in range(i - run, i):
                weight[k] = len(lines[k][0]) if lines[k][2] or not contained else 0
        run = 0
    return [w + SURGE if w and contained else w for w in weight]


def text_between(weight: list[int]) -> list[int]:
    """Lines between surge and dive, by the distribution of sums over sliding windows of WINDOW lines.

    Text surges at a line with weight whose window reaches SURGE (or the page's largest sum, if that
    is less) and dives where a window holds nothing; lines with weight in between are kept."""
    n = len(weight)
    total = [0, *accumulate(weight)]
    windows = [total[min(n, i + WINDOW)] - total[i] for i in range(n)]
    surge = min(SURGE, max(windows, default=0))
    kept, i = [], 0
    while i < n:
        if not weight[i] or windows[i] < surge:
            i += 1
            continue
        while i < n and windows[i]:
            if weight[i]:
                kept.append(i)
            i += 1
    return kept


def main_text(html: str | None) -> str:
    """The article's lines, joined by one newline; empty for a null or empty page.

    Tags only tell where lines end and what they weigh (``line_weights``); the window sums decide
    what is kept (``text_between``). In an article every line outside menus carries a surge of its
    own, so that short paragraphs between long ones, or alone, stay."""
    if not html:
        return ""
    lines = page_lines(html)
    return "\n".join(lines[i][0] for i in text_between(line_weights(lines)))


def extracted_text(html: Column) -> Column:
    """Main text of a column of raw html."""

    @F.pandas_udf("string")
    def extract(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([main_text(h if isinstance(h, str) else None) for h in batch], dtype=object)

    return extract(html)


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points). No shuffle; whole pages.

    A null or empty page has empty text and 0 characters. Repeated rows stay repeated; other
    columns are ignored; an empty table gives none."""
    rows = without(pages, "text", "n_chars").withColumn("text", extracted_text(F.col("html")))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
