"""Main text of web pages by line-block distribution.

Markup is stripped to lines: one for each block of the page, with white space inside it as
one space and character references decoded; a line's length is its characters but white space.
Lines of menus, headers, footers, sidebars, notices, adverts, forms and reader comments, told
by element, role, class and id, and of elements that are hidden or not displayed have
length 0 and are never kept; so has a line of nothing but links outside an article or main
element. A class or id tells a part by all its words, or by a word for a part at its start or end beside words that
qualify such parts. One that holds a word for a part among others casts doubt only: its element is left out where
density agrees, which is where it has less than half of the page's text and is links for the most part or
has lines of less than half the average length of those elsewhere.
Scripts, styles, forms and comments have no lines, so text before and after a form is not parted by it. Where an article or main element starts
or ends stand `window` empty lines, so no window reaches over that edge.

The lengths are summed over windows of consecutive lines. Text surges where a window reaches
the threshold, which is `surge` characters or, on pages whose fullest window has fewer than twice
as many, half of that window; it dives where a window is empty. The lines around a surge, as
far as the next dive on both sides, are main text. If the stretch with the most text lies in
an article or main element, only stretches in that element and in others that have at least a quarter of its text
are kept, so teasers beside an article are not; else all are.

A null or empty page, or one without a line that has a length, has an empty text; an empty
table gives no rows. Each row is extracted by itself, whole, in time in proportion to its
length; repeated rows give repeated rows.
"""

from __future__ import annotations

import html as entities
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, few, tidy

by_value(__name__)

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("nav footer aside form script style noscript template iframe object svg canvas button select textarea menu dialog head title fieldset audio video".split())
RAW = frozenset("script style noscript template iframe textarea svg title".split())
#: Words that name a part which is not the article. A class or id does so where all its words are of these two sets and one is of the first, a role where it is of the first.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside widget related "
    "recommended share sharing social cookie cookies consent gdpr notice foot copyright discussion discussions popup modal overlay newsletter subscribe subscription signup login search comment comments disqus replies respond responses pagination pager toolbar complementary contentinfo alert".split()
)
FILLERS = frozenset("site global main primary secondary bar box list area wrap wrapper container section block inner posts articles links items form button buttons".split())
#: Words that may follow a word of a part, and words that may stand before one.
AFTER = FILLERS | frozenset("slot unit label text message thread body content stories story left right entry".split())
BEFORE = FILLERS | frozenset("reader readers user users left right privacy".split())
#: First words of classes that say what a page has, not what an element is.
SAYS = frozenset("has with no without is".split())
#: Parts to fill in or play, which stand within text and do not part it.
UNLINED = frozenset("form button select fieldset dialog canvas object audio video".split())
#: Elements that no class, id or role leaves out.
KEPT = frozenset("body html article main h1 h2 h3 h4 h5 h6 p".split())
#: The rest of a tag that has no attribute values, and one attribute; every step takes characters, so a tag takes time in proportion to its length.
PLAIN = re.compile(r"[^<>\"'=]*>")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?")
END = re.compile(r"[\s/]*>")
PART = re.compile(r"\d+x\d+|[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]")
UNSHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!\s*important\s*)?(?:;|$)", re.I)


def names_part(token: str, inside: bool) -> bool:
    words = [p.lower() for p in PART.findall(token)]
    if "header" in words:
        return not inside and all(w in ("header", "site", "global", "top", "main") for w in words)
    if not any(w in WORDS for w in words):
        return False
    if all(w in WORDS or w in FILLERS or w[0].isdigit() for w in words):
        return True
    return words[0] in WORDS and all(w in AFTER for w in words[1:]) or words[-1] in WORDS and all(w in BEFORE for w in words[:-1])


def doubtful(tag: str, attributes) -> bool:
    """Whether a class or id holds a word of a part among others."""
    if tag in KEPT or tag in INLINE:
        return False
    found = {}
    for name, value in attributes:
        if name in ("class", "id"):
            found.setdefault(name, value)
    for token in " ".join(found.values()).split():
        words = [p.lower() for p in PART.findall(token)]
        if words and words[0] not in SAYS and any(w in WORDS for w in words):
            return True
    return False


def marked(tag: str, attributes, inside: bool) -> bool:
    if tag in SKIP or tag == "header" and not inside:
        return True
    seen = set()
    for name, value in attributes:
        if name in seen:  # the first of equal names counts
            continue
        seen.add(name)
        if name == "hidden" or name == "style" and UNSHOWN.search(value):
            if tag not in ("body", "html"):
                return True
        elif name in ("class", "id") and tag not in KEPT:
            if any(names_part(x, inside) for x in value.split()):
                return True
        elif name == "role" and tag not in KEPT:
            if any(x in WORDS for x in value.lower().split()):
                return True
    return False


def tokens(page: str):
    """(text, tag, kind, attributes) in page order: kind 0 is text, 1 a start, 2 a self-closed start, 3 an end."""
    at = start = 0
    while (at := page.find("<", at)) >= 0:
        lead = page[at + 1 : at + 2]
        if lead in ("!", "?"):
            if start < at:
                yield page[start:at], "", 0, ()
            for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
                if page.startswith(opening, at):
                    end = page.find(closing, at + len(opening))
                    if opening == "<![CDATA[":
                        yield page[at + 9 : end if end >= 0 else len(page)], "", 0, ()
                    at = start = end + len(closing) if end >= 0 else len(page)
                    break
            continue
        closes = lead == "/"
        name = NAME.match(page, at + 1 + closes)
        if not name:  # a lone "<" is text
            at += 1
            continue
        if start < at:
            yield page[start:at], "", 0, ()
        tag, at = name[0].lower(), name.end()
        if m := PLAIN.match(page, at):
            inner = m[0][:-1]
            attributes, empty, at = [(x.lower(), "") for x in inner.replace("/", " ").split()], inner.endswith("/"), m.end()
        else:
            attributes, empty = [], False
            while not (m := END.match(page, at)):
                if not (m := ATTRIBUTE.match(page, at)):  # nothing but the end of the page
                    at = len(page)
                    break
                attributes.append((m[1].lower(), entities.unescape(next((x for x in m.groups()[1:] if x is not None), ""))))
                at = m.end()
            else:
                empty, at = "/" in m[0] or page[m.start() - 1] == "/", m.end()
        start = at
        yield "", tag, 3 if closes else 2 if empty else 1, attributes
        if tag in RAW and not closes and not (empty and tag == "svg"):  # of these only svg can be empty
            end = RAW_END[tag].search(page, at)
            at = start = end.end() if end else len(page)
    if start < len(page):
        yield page[start:], "", 0, ()


RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


def lines(page: str, window: int) -> list[tuple[str, int, int]]:
    """(text, length, number of the article or main element or 0) of every line in page order; a text of "" is not to be kept."""
    out: list[tuple[str, int, int]] = []
    linked: list[int] = []  # characters in links of each line
    doubts: list[list[int]] = []  # [first, end) of the lines of each element in doubt
    stack: list[tuple[str, bool, int]] = []
    at_tag: dict[str, list[int]] = {}  # where the open elements of a name stand in the stack
    skipped: list[int] = []
    blocks: list[int] = []
    held: list[str] = []
    plain = articles = links = number = unlined = 0

    def put(text, length, article, links):
        out.append((text, length, article))
        linked.append(links)

    def flush():
        nonlocal plain
        text = " ".join("".join(held).split())
        if text:
            full = len(text) - text.count(" ")
            if not skipped:
                put(text, full if articles else plain, number if articles else 0, full - plain)
            elif not articles and not unlined:
                put("", 0, 0, 0)
        held.clear()
        plain = 0

    def edge():
        for _ in range(window):
            put("", 0, 0, 0)

    def pop(k):
        nonlocal articles, links, unlined
        while len(stack) > k:
            tag, skip, doubt = stack.pop()
            at_tag[tag].pop()
            unlined -= tag in UNLINED
            if doubt:
                doubts[doubt - 1][1] = len(out)
            if skip:
                skipped.pop()
            if tag not in INLINE:
                blocks.pop()
            links -= tag == "a"
            if tag in ("article", "main"):
                articles -= 1
                if not articles:
                    edge()

    for raw, tag, kind, attributes in tokens(page):
        if not kind:
            text = entities.unescape(raw)
            held.append(text)
            if not links:
                plain += len("".join(text.split()))
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if kind == 3:  # an inline end does not reach over the start of a block
            if (open_at := at_tag.get(tag)) and (tag not in INLINE or not blocks or blocks[-1] < open_at[-1]):
                pop(open_at[-1])
            continue
        if tag in VOID or tag in RAW:
            continue
        if tag not in INLINE:  # inline elements and paragraphs do not reach over the start of a block
            while stack and (stack[-1][0] in INLINE or stack[-1][0] == "p"):
                pop(len(stack) - 1)
        if tag in ("article", "main"):
            if skipped:  # an unclosed menu ends where the article starts
                pop(skipped[0])
            if not articles:
                edge()
                number += 1
            articles += 1
        skip = marked(tag, attributes, articles > (tag in ("article", "main")))
        if skip:
            skipped.append(len(stack))
        doubt = 0
        if not skipped and doubtful(tag, attributes):
            doubts.append([len(out), -1])
            doubt = len(doubts)
        unlined += tag in UNLINED
        if tag not in INLINE:
            blocks.append(len(stack))
        at_tag.setdefault(tag, []).append(len(stack))
        stack.append((tag, skip, doubt))
        links += tag == "a"
    flush()
    return settle(out, linked, doubts)


def settle(found: list[tuple[str, int, int]], linked: list[int], doubts: list[list[int]]) -> list[tuple[str, int, int]]:
    """The lines without those of elements in doubt that density tells apart; running sums make every element one step."""
    if not doubts:
        return found
    total = lambda xs: list(accumulate(xs, initial=0))
    texts, links, kept = total(len(t) - t.count(" ") for t, *_ in found), total(linked), total(bool(t) for t, *_ in found)
    opened = [0] * (len(found) + 1)
    for first, end in doubts:
        end = len(found) if end < 0 else end
        size, link, n = texts[end] - texts[first], links[end] - links[first], kept[end] - kept[first]
        rest, others = texts[-1] - size, kept[-1] - n
        if n and size < rest and (2 * link > size or 2 * size * others < rest * n):
            opened[first] += 1
            opened[end] -= 1
    return [("", 0, a) if depth else (t, n, a) for (t, n, a), depth in zip(found, accumulate(opened))]


def stretches(lengths: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """[first, end) of the lines around each surge, from the dive before it to the dive after it."""
    sums, total = [0] * len(lengths), 0
    for i in range(len(lengths) - 1, -1, -1):
        total += lengths[i] - (lengths[i + window] if i + window < len(lengths) else 0)
        sums[i] = total
    surge = min(surge, -(-max(sums, default=0) // 2))
    out, start, high = [], None, False
    for i, s in enumerate([*sums, 0]):
        if s and start is None:
            start, high = i + next(k for k in range(window) if lengths[i + k]), False
        if s >= surge > 0:
            high = True
        if not s and start is not None:
            if high:
                out.append((start, i))
            start = None
    return out


def main_text(page: str | None, window: int = 3, surge: int = 80) -> str:
    found = lines(page or "", window)
    lengths = [n for _, n, _ in found]
    kept = stretches(lengths, window, surge)
    if not kept:
        return ""
    fullest = max(kept, key=lambda x: sum(lengths[x[0] : x[1]]))
    main = max(a for *_, a in found[fullest[0] : fullest[1]])
    if main:  # no stretch reaches over the edge of an article
        sizes: dict[int, int] = {}
        for x, y in kept:
            a = max(a for *_, a in found[x:y])
            sizes[a] = sizes.get(a, 0) + sum(lengths[x:y])
        return "\n".join(found[i][0] for x, y in kept for i in range(x, y) if found[i][0] and found[i][2] and 4 * sizes[found[i][2]] >= sizes[main])
    return "\n".join(found[i][0] for x, y in kept for i in range(x, y) if found[i][0])


def extract(pages: DataFrame, column: str = "html", **kw) -> DataFrame:
    """Every row with text and n_chars in place of the page; columns of these names are replaced."""
    kept = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in few(batches):
            texts = [main_text(x, **kw) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return pages.mapInArrow(tidy(run), schema)


def digest(pages: DataFrame, **kw) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"), **kw).select("page_id", "url", F.col("text"), "n_chars")
