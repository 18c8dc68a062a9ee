"""Main text of pages by nearest-URL differencing.

A page becomes text lines (one for each block). Within a host each page is
paired with its neighbours in URL-path order, the nearest first: the one that
shares the longer path prefix. The lines of both are aligned by longest common
subsequence, and shared lines, the template, are deleted. Copies are no template
mates and delete nothing of each other: pages of equal lines are one class, and
captures of one URL one place in the order, so that neighbours are different
pages. Two pages with articles are copies if they share most of the article's
lines. A page without one that shares most of its text with a neighbour is
compared with pages 2, 4, 8, ... places away as well: its own lines are those
that the other page sharing least of it (but something) lacks, and only pages
that share most of its own lines are copies. The nearest page that is none is
taken. A page that has next to nothing of its own against any of them is left.

The markup then checks the result: lines inside article or main are restored
(two pages may quote the same sentence), and lines in elements that are never
text (menus, headers, footers, asides, forms, adverts, notices, comments,
scripts, styles) are removed even where no neighbour shares them, as on a host
with one page. A class, role or id marks such an element only as a whole name
(``sidebar``, ``cookie-notice``, ``commentlist``), not by a word in a longer one
(``related-work``, ``commentary``, ``no-sidebar``); inside an article ids do not
count, and no name takes the only article from a page.

Only hashes of the lines outside article are paired and moved, never texts; a
host of any size is ordered by a global sort, not in one task.

Defined cases: a null or empty html has an empty text. A null url belongs to
the host ``''``. Repeated rows are copies of each other. A table of one page has
no neighbours. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from math import isqrt
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import row_key, written
from webloom.operators.paging import with_row_index

#: Share of a page's own text, or of its article's lines, that makes another page its copy.
COPY_SHARE = 0.5
#: A page without article that has no more text of its own than this has only copies.
OWN_SHARE = 0.1

ARTICLE, NEUTRAL, CHROME = 0, 1, 2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>", re.S)
#: Elements whose content is no markup: it ends at the end tag only.
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I) for tag in ("script", "style", "textarea", "title")}
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: HTML element names, and words of class, id or role that mark chrome.
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_CHROME_TAG = frozenset("nav aside footer form head menu dialog header".split())
#: Elements whose content is never text, though it may be markup.
_ASIDE = frozenset("button select object svg iframe template noscript".split())
_CONTAINER = frozenset("div section ul ol table p span article main header footer aside nav form figure li details dialog".split())
_CHROME_WORD = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus reply replies widget login signup search form toolbar pagination pager contentinfo complementary alert dialog header".split())
_CHROME_START = ("advert", "breadcrumb", "comment", "cookie", "footer", "navig", "newsletter", "sidebar", "sponsor", "subscri")
#: Words that may stand beside a chrome word in a name of chrome, words
#: that turn it around (a page that has or lacks such an element), words of a reader's comment.
_PLACE_WORD = frozenset("area bar block body bottom box button buttons center column container content contents fixed global holder icons inner item items left level line link links list lists main message meta module outer page panel policy post posts primary reader readers right row section secondary site slot space sticky story stories tag tags thread toggle top unit user users wrap wrapper".split())
_TURN_WORD = frozenset("has have hide is no non not show with without".split())
_COMMENT_WORD = frozenset("comment comments reply replies".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _names(attributes: str, ids: bool = True) -> list[list[str]]:
    """Names of class and role, and of id, each as its words."""
    names = []
    for m in _ATTRIBUTE.finditer(attributes):
        if m[2] and m[1].lower() in (("class", "role", "id") if ids else ("class", "role")):
            names += [_WORD.findall(_CAMEL.sub(" ", name).lower()) for name in m[2].strip("\"'").split()]
    return names


def _chrome_words(name: list[str]) -> set[str]:
    """The chrome words of a name, if the name is one of chrome: nothing else is in it
    but words of place, and nothing that turns it around."""
    if not name or name[0] in _TURN_WORD:
        return set()
    words = set()
    for w in name:
        start = next((c for c in _CHROME_START if w.startswith(c)), None) if w not in _CHROME_WORD else w
        if w in _CHROME_WORD or start and any(w[:k] in _CHROME_WORD and w[k:] in _PLACE_WORD for k in range(len(start), len(w))):
            words.add(w)
        elif w not in _PLACE_WORD and not w.isdigit():
            return set()
    return words


def _of_reader(attributes: str) -> bool:
    """Whether an article is named as a reader's comment."""
    return any(_chrome_words(name) & _COMMENT_WORD for name in _names(attributes))


def _kind(tag: str, attributes: str, inside_article: bool, story: bool) -> int | None:
    """The zone an element opens, if it opens one. `story`: the page has an article or
    main that is no reader's comment; only then can one be such a comment. Inside
    an article an id names a part of the text and says nothing."""
    if tag in ("article", "main"):
        return CHROME if story and _of_reader(attributes) else ARTICLE
    if tag in _CHROME_TAG:
        return None if inside_article and tag == "header" else CHROME
    if tag in _CONTAINER and attributes:
        words = set().union(*map(_chrome_words, _names(attributes, not inside_article)))
        if words and not (inside_article and words <= {"header", "banner"}):
            return CHROME
    return None


def _tokens(page: str) -> list[tuple[int, int, bool, str, str]]:
    """(start, end, is end tag, tag, attributes) of each tag; comments and raw elements have no tag."""
    tokens = []
    at = svgs = 0
    while m := _TOKEN.search(page, at):
        start, at = m.span()
        tag = (m[2] or "").lower()
        closed = tag and m[3].endswith("/")
        if tag == "svg" and not closed:
            svgs = max(0, svgs - 1) if m[1] else svgs + 1
        if tag in _RAW_END and not m[1] and not (svgs and closed):
            at = _RAW_END[tag].search(page, at).end()
            tag = ""
        tokens.append((start, at, bool(m[1]), tag, m[3] or ""))
    return tokens


def _closed(tokens: list[tuple[int, int, bool, str, str]]) -> dict[int, int]:
    """Places of the start tags in _ASIDE, and of their end tags, if these come
    before the element around them ends."""
    found: dict[int, int] = {}
    if not any(tag in _ASIDE for *_, tag, _ in tokens):
        return found
    stack: list[tuple[str, int]] = []
    open_tags: dict[str, int] = {}
    for place, (_, _, ends, tag, attributes) in enumerate(tokens):
        if not tag or tag in _VOID or attributes.endswith("/") and tag not in _BLOCK:
            continue
        if not ends:
            stack.append((tag, place))
            open_tags[tag] = open_tags.get(tag, 0) + 1
        elif open_tags.get(tag):
            k = len(stack) - 1
            while stack[k][0] != tag:
                if stack[k][0] in _ASIDE and tag not in _ASIDE and (tag not in _BLOCK or tag == "p"):
                    break  # misnested: inline elements do not end the one they began before
                k -= 1
            else:
                if tag in _ASIDE:
                    found[stack[k][1]] = place
                for other, _ in stack[k:]:
                    open_tags[other] -= 1
                del stack[k:]
    return found


def page_lines(page: str) -> list[tuple[str, int]]:
    """(text, zone) of each block in page order."""
    lines: list[tuple[str, int]] = []
    pieces: list[str] = []
    zones: list[list] = []  # [tag, open elements of that tag, zone]
    at = 0

    def end_block():
        text = " ".join("".join(pieces).split())
        if text:
            lines.append((text, zones[-1][2] if zones else NEUTRAL))
        pieces.clear()

    tokens = _tokens(page)
    closed = _closed(tokens)
    story = any(tag in ("article", "main") and not ends and not _of_reader(attributes) for _, _, ends, tag, attributes in tokens)
    last = -1  # place of the end tag of the element of _ASIDE just passed
    muted = False  # such an element without an end tag reaches to the next block
    for place, (start, end, ends, tag, attributes) in enumerate(tokens):
        if start > at and place > last and not muted:
            pieces.append(html.unescape(page[at:start]))
        at = end
        if not tag or place <= last:
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in _BLOCK:
            end_block()
            muted = muted and tag == "option"
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCK:
            continue
        if ends:
            for k in range(len(zones) - 1, -1, -1):
                if zones[k][0] == tag:
                    zones[k][1] -= 1
                    if not zones[k][1]:
                        if tag not in _BLOCK:
                            end_block()
                        del zones[k:]
                    break
            continue
        if tag in _ASIDE:
            last = closed.get(place, last)
            muted = muted or place not in closed
            continue
        inside = any(z[2] == ARTICLE for z in zones)
        kind = _kind(tag, attributes, inside, story)
        if kind is None or zones and zones[-1][2] == CHROME and kind == CHROME and zones[-1][0] == tag:
            for z in reversed(zones):
                if z[0] == tag:
                    z[1] += 1
                    break
        else:
            if tag not in _BLOCK:
                end_block()
            zones.append([tag, 1, kind])
        if tag == "body":
            zones.clear()  # a head that was never closed
    if at < len(page) and not muted:
        pieces.append(html.unescape(page[at:]))
    end_block()
    return lines


def line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def shared_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in `a` of a longest common subsequence of both.

    Bit-parallel: a row of the table is one whole number with a bit for each line of
    `b`, 0 where the length grows (Hyyro's recurrence). Rows are kept at every
    square-root-th line and computed again, block by block, on the way back.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = {*range(head), *range(len(a) - tail, len(a))}
    left, right = a[head:len(a) - tail], b[head:len(b) - tail]
    if not left or not right:
        return found
    places: dict[int, int] = {}
    wanted = set(left)
    for j, line in enumerate(right):
        if line in wanted:
            places[line] = places.get(line, 0) | 1 << j
    whole = (1 << len(right)) - 1

    def below(row: int, line: int) -> int:
        same = row & places.get(line, 0)
        return ((row + same) | (row - same)) & whole

    step = isqrt(len(left)) + 1
    kept, row = [], whole
    for i, line in enumerate(left):
        if i % step == 0:
            kept.append(row)
        row = below(row, line)
    j = len(right)
    for block in range(len(kept) - 1, -1, -1):
        rows = [kept[block]]
        for line in left[block * step:(block + 1) * step]:
            rows.append(below(rows[-1], line))
        i = len(rows) - 1
        while i and j:
            if rows[i] >> (j - 1) & 1:
                # On to the last place at which this row's length grows.
                j = (~rows[i] & ((1 << j) - 1)).bit_length()
                continue
            i -= 1
            if rows[i] >> (j - 1) & 1:
                found.add(head + block * step + i)
                j -= 1
    return found


def _split(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path + ("?" + parts.query if parts.query else "")
    except ValueError:
        return "", url or ""


_OUTLINE = pa.schema([("key", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("same", pa.int64()), ("lines", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("body", pa.list_(pa.int64()))])


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host, path, the hash of all lines, and the hashes of those outside and inside article."""
    for batch in batches:
        rows = []
        for key, url, page in zip(*(batch.column(c).to_pylist() for c in range(3))):
            lines = page_lines(page or "")
            outside = [t for t, zone in lines if zone != ARTICLE]
            same = line_hash("\n".join(f"{zone}{t}" for t, zone in lines))
            rows.append((key, *_split(url), same, [line_hash(t) for t in outside], [len(t) for t in outside], [line_hash(t) for t, zone in lines if zone == ARTICLE]))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], field.type) for c, field in enumerate(_OUTLINE)], schema=_OUTLINE)


def _common_start(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _chosen(page: dict, others: list[dict]) -> tuple[list[int], bool]:
    """Places, among the lines outside article, of those shared with the nearest
    of the other pages (nearest first) that is no copy; and whether that is
    certain without pages further away."""
    text = lambda places: sum(page["sizes"][k] for k in places)
    shared = [shared_lines(page["lines"], n["lines"]) for n in others]
    if page["body"]:
        for n, s in zip(others, shared):
            both = sum((Counter(page["body"]) & Counter(n["body"])).values())
            if both <= COPY_SHARE * min(len(page["body"]), len(n["body"])):
                return sorted(s), True
        return [], False
    total = sum(page["sizes"])
    if text(shared[0]) <= COPY_SHARE * total:
        return sorted(shared[0]), True
    by_size = sorted((k for k, s in enumerate(shared) if s), key=lambda k: text(shared[k]))
    if total - text(shared[by_size[0]]) <= OWN_SHARE * total:
        return [], False
    for k, s in enumerate(shared):
        least = next((shared[m] for m in by_size if m != k), set())
        if text(s - least) <= COPY_SHARE * (total - text(least)):
            return sorted(s), False
    return [], False


def _template(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The choice between the page's neighbours in `near`."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            near = [n for n in r["near"] if n["host"] == r["host"]]
            near.sort(key=lambda n: (n["step"], -_common_start(n["path"], r["path"])))
            rows.append((r["key"], *(_chosen(r, near) if near else ([], True))))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows])], ["class", "deleted", "sure"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, deleted in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            gone, at, kept = set(deleted or ()), 0, []
            for text, zone in page_lines(page or ""):
                if zone == ARTICLE or zone == NEUTRAL and at not in gone:
                    kept.append(text)
                at += zone != ARTICLE
            texts.append("\n".join(kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(row_key(id, url, page).alias("key"), F.col(id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    outline = written(rows.select("key", "url", "html").mapInArrow(_outline, "key long, host string, path string, same long, lines array<long>, sizes array<int>, body array<long>"), "outline")
    named = outline.groupBy("host", "same").agg(F.min_by("key", F.struct("path", "key")).alias("class"))
    classes = outline.join(named.select(F.col("class").alias("key")), "key", "left_semi").dropDuplicates(["key"])
    # One place in the order for each URL; its first class is what others see.
    first = classes.groupBy("host", "path").agg(F.min("key").alias("key"))
    ordered = with_row_index(classes.join(first.select("key"), "key", "left_semi"), "host", "path")
    places = ordered.select("host", "path", "row_idx")
    asking = written(classes.join(places, ["host", "path"]).select("row_idx", "key", "host", "path", "lines", "sizes", "body"), "classes")

    def choices(pages: DataFrame, steps: list[int]) -> DataFrame:
        reach = F.explode(F.array(*[F.lit(x) for s in steps for x in (s, -s)]))
        asked = pages.select("key", "row_idx", reach.alias("reach")).select("key", F.abs("reach").alias("step"), (F.col("row_idx") + F.col("reach")).alias("row_idx"))
        seen = asked.join(ordered.select("row_idx", F.struct("host", "path", "lines", "body").alias("page")), "row_idx")
        near = seen.groupBy("key").agg(F.collect_list(F.struct("step", "page.*")).alias("near"))
        return pages.join(near, "key").select("key", "host", "path", "lines", "sizes", "body", "near").mapInArrow(_template, "class long, deleted array<int>, sure boolean")

    adjacent = written(choices(asking, [1]), "adjacent")
    unsure = written(asking.join(adjacent.filter("not sure").select(F.col("class").alias("key")), "key", "left_semi"), "unsure")
    if unsure.isEmpty():
        chosen = adjacent
    else:
        largest = places.groupBy("host").count().agg(F.max("count")).first()[0]
        steps = [1 << k for k in range(largest.bit_length())]
        chosen = adjacent.filter("sure").unionByName(choices(unsure, steps))
    members = outline.select("key", "host", "same").distinct().join(named, ["host", "same"])
    deleted = written(members.join(chosen.filter("size(deleted) > 0"), "class").select("key", "deleted"), "template")
    kind = rows.schema["page_id"].dataType.simpleString()
    texts = rows.join(deleted, "key", "left").select("page_id", "url", "html", "deleted")
    return texts.mapInArrow(_texts, f"page_id {kind}, url string, text string, n_chars long")
