"""Main text of web pages: blocks by markup, then differencing against the page with the nearest URL."""

from __future__ import annotations

import html as markup
import re
from bisect import bisect_left, bisect_right
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import partitions

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_PART = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
_DROPPED = frozenset("nav footer aside form button select option dialog menu svg canvas object audio video head label datalist math applet".split())
_MAIN = frozenset("article main".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
_NESTED = (_BLOCK | _DROPPED) - frozenset("p li dt dd hr tr option optgroup".split())
#: Words in class, id or role that name what stands around an article.
_AROUND = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar comment comments commentlist disqus respond reply replies nav navbar navigation menu menubar breadcrumb breadcrumbs share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay widget widgets pagination pager toolbar masthead contentinfo complementary search dialog footer paywall".split()
)
#: Words that say where or in what form something stands, not what it is: a name is one of the above only if all its parts are, or these.
_FORM = frozenset("area bar block body bottom box btn button buttons container content count fixed footer form group header heading holder icon icons inline inner item items left link links list main message middle outer panel right row section side slot small sticky text thread title top tree unit wrap wrapper".split())
_READERS = frozenset("comment comments commentlist disqus respond reply replies".split())
_PAGE_HEAD = frozenset("header topbar".split())
#: Pages on either side, in URL order, that a page is differenced against.
REACH = 2
#: A page that shares this part of another's characters is its copy, and can't tell what is boilerplate there.
COPY = 0.8
#: UTF-8 bytes of html that make up a bucket, and a task of some buckets, about.
BUCKET_BYTES, TASK_BYTES = 4_000_000, 64_000_000
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _named(value: str, words: frozenset) -> bool:
    """Whether one of the names in a class, id or role attribute is one of the words, alone or with words of form."""
    for name in value.split():
        parts = _PART.findall(_CAMEL.sub(" ", name).lower())
        told = [x for x in parts if not x.isdigit()]
        if any(x in words for x in told) and all(x in words or x in _FORM for x in told):
            return True
    return False


def _around(tag: str, raw: str, in_main: bool) -> bool:
    """Whether an element is something around the article: by its name, or by class, id, role or style.

    An article or main element is not judged by its names, unless they say that it is a reader's comment.
    """
    if tag in _DROPPED or tag == "header" and not in_main:
        return True
    if not raw or not raw.strip(" /"):
        return False
    low = raw.lower()
    if not any(x in low for x in ("class", "id", "role", "hidden", "style")):
        return False
    words = _READERS if tag in _MAIN else _AROUND if in_main else _AROUND | _PAGE_HEAD
    for m in _ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return True
        if name in ("class", "id", "role") and tag not in ("body", "html") and _named(value, words):
            return True
    return False


def blocks(page: str | None) -> tuple[list[str], list[bool]]:
    """Text blocks of a page in page order, and whether each stands in an article or main element.

    Left out: scripts, styles and other raw content, comments, and elements around the article. White
    space in a block is one space; character references are decoded.
    """
    page = page or ""
    lines, mains, buffer = [], [], []
    stack: list[tuple[str, bool, bool]] = []
    standing: Counter = Counter()
    dropped = main = breaks = at = 0

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                lines.append(text)
                mains.append(main > 0)

    while True:
        m = _TOKEN.search(page, at)
        if not dropped and (text := page[at : m.start() if m else len(page)]):
            buffer.append(markup.unescape(text) if "&" in text else text)
            if not text.isspace():
                breaks = 0
        if m is None:
            break
        at = m.end()
        closing, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _BLOCK:
            flush()
            breaks = 0
        if closing:
            if standing[tag]:
                flush()
                while True:
                    name, was_dropped, was_main = stack.pop()
                    standing[name] -= 1
                    dropped -= was_dropped
                    main -= was_main
                    if name == tag:
                        break
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            buffer.append(" ")
            breaks += 1
            if breaks > 1:
                flush()
            continue
        if tag in ("td", "th"):
            buffer.append(" ")
        if tag in _VOID or raw.endswith("/") and tag in ("svg", "path", "use"):
            continue
        around = _around(tag, raw, main > 0)
        is_main = not around and (tag in _MAIN or 'role="main"' in raw)
        if around or is_main or tag in _NESTED:
            if around:
                flush()
            stack.append((tag, around, is_main))
            standing[tag] += 1
            dropped += around
            main += is_main
    flush()
    return lines, mains


def common_lines(a: list[str], b: list[str]) -> list[int]:
    """Positions in a of a longest common subsequence of lines of a and b (Hunt and Szymanski's way)."""
    places: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    ends: list[int] = []
    tails: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(places.get(line, ())):
            k = bisect_left(ends, j)
            node = (i, tails[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                tails.append(node)
            else:
                ends[k], tails[k] = j, node
    out, node = [], tails[-1] if tails else None
    while node:
        out.append(node[0])
        node = node[1]
    return out[::-1]


def main_text(lines: list[str], mains: list[bool], others: list[list[str]]) -> str:
    """The blocks that are the page's own, joined by two line feeds.

    ``others``: the lines of the pages beside it, that with the nearest URL first. On a page without an
    article or main element the lines that it shares with the first are boilerplate and go; a page that
    shares all its lines is a copy, not boilerplate, and keeps them.

    Elsewhere the pages that are copies (of :data:`COPY` of the page's characters, or of its article's
    where that has most of them) have no say. Of what is left, one page that shares a line outside the
    article makes it boilerplate, and it takes two for a line inside. All other lines stay, wherever
    they stand. Where no page has a say, the markup decides: what is inside stays.
    """
    if not any(mains):
        shared = set(common_lines(lines, others[0])) if others else set()
        return "\n\n".join(x for i, x in enumerate(lines) if i not in shared or len(shared) == len(lines))
    size = [len(x) for x in lines]
    inside = sum(n for n, m in zip(size, mains, strict=True) if m)
    votes, voters = [0] * len(lines), 0
    for other in others:
        shared = common_lines(lines, other)
        if sum(size[i] for i in shared) >= COPY * sum(size) or 2 * inside >= sum(size) and sum(size[i] for i in shared if mains[i]) >= COPY * inside:
            continue
        voters += 1
        for i in shared:
            votes[i] += 1
    return "\n\n".join(x for x, m, v in zip(lines, mains, votes, strict=True) if (v < 2 if m else voters and not v))


def url_key(url: Column) -> Column:
    """Host, in lower case, and path of a URL, in an order that keeps a host's pages together (null: empty)."""
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"
    return F.concat(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), pattern, 1)), F.lit("\x00"), F.regexp_extract(F.coalesce(url, F.lit("")), pattern, 2))


def _order(page_id: int | None) -> int:
    return -(1 << 63) if page_id is None else page_id


def _bucketed(cuts: list[tuple[str, int]], known: frozenset = frozenset()):
    """(bucket, key, page_id) of batches (key, page_id), but for known places."""
    def run(batches):
        for batch in batches:
            places = [x for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (x := (k, _order(i))) not in known]
            yield pa.RecordBatch.from_arrays([pa.array([bisect_right(cuts, x) for x in places], pa.int32()), pa.array([x[0] for x in places], pa.string()), pa.array([x[1] for x in places], pa.int64())], names=["bucket", "key", "id"])
    return run


_LINES = "bucket int, key string, id long, context boolean, page_id long, url string, lines array<string>, mains array<boolean>"


def _parsed(cuts: list[tuple[str, int]], also: dict[tuple[str, int], list[int]]):
    """Blocks of each page in its bucket, and of a bucket's first and last pages in the buckets beside it."""
    def run(batches):
        for batch in batches:
            rows = []
            for key, page_id, url, page in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                place = (key, _order(page_id))
                found = (place[1], page_id, url, *blocks(page))
                rows.append((bisect_right(cuts, place), key, False, *found))
                rows += [(b, key, True, *found) for b in also.get(place, ())]
            for s in range(0, len(rows), 1000):
                part = list(zip(*rows[s : s + 1000], strict=True))
                kinds = [pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.bool_())]
                names = ["bucket", "key", "context", "id", "page_id", "url", "lines", "mains"]
                made = dict(zip(names, (pa.array(list(x), t) for x, t in zip(part, kinds, strict=True)), strict=True))
                order = ["bucket", "key", "id", "context", "page_id", "url", "lines", "mains"]
                yield pa.RecordBatch.from_arrays([made[n] for n in order], names=order)
    return run


def _common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _beside(before: list, row, after: list) -> list[list[str]]:
    """Lines of the pages of the same host, in URL order before (nearest first) and after, that a page is differenced against.

    First comes that of the next on either side whose path agrees longest, the one before if both do.
    """
    host = row[1].split("\x00", 1)[0]
    if not host:
        return []
    sides = [[x for x in side if x[0] == row[0] and x[1].split("\x00", 1)[0] == host] for side in (before, after)]
    if all(sides) and _common_prefix(sides[1][0][1], row[1]) > _common_prefix(sides[0][0][1], row[1]):
        sides.reverse()
    return [x[6] for side in sides for x in side]


def _differenced(batches):
    """Batches sorted by bucket, key, id: each page meets the pages just before and after it."""
    held: deque = deque([None] * (REACH + 1), 2 * REACH + 1)

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string()), pa.array([len(x[2]) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    def moved(after):
        """The result for the page in the middle of those held, after one more has come in."""
        held.append(after)
        rows = list(held)
        row = rows[REACH] if len(rows) > 2 * REACH else None
        if row is None or row[3]:
            return []
        before, later = ([x for x in side if x is not None] for side in (rows[REACH - 1 :: -1], rows[REACH + 1 :]))
        return [(row[4], row[5], main_text(row[6], row[7], _beside(before, row, later)))]

    for batch in batches:
        out = []
        for after in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
            out += moved(after)
        yield made(out)
    yield made([x for _ in range(REACH) for x in moved(None)])


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages(page_id, url, html): page_id, url, text (the main text, empty if none), n_chars.

    Pages in order of host, path and id are dealt to buckets by cut points from a sample of the keys, so
    a host with most pages fills many buckets; a bucket's first and last two pages also visit the buckets
    beside it, so the cut points change no result. In its bucket each page is paired with the two pages
    of the same host on either side, foremost the next one whose path agrees longest, their lines are
    aligned by a longest common subsequence, and shared lines are deleted as :func:`main_text` says.
    A task holds five pages.

    A null or malformed URL has no host and no pair; null html is empty. Pages with equal keys and ids
    are paired like any others. Other columns are ignored. Empty: empty; rows that repeat, repeat.
    """
    spark = pages.sparkSession
    rows = pages.select(url_key(F.col("url")).alias("key"), "page_id", "url", "html")
    keys = rows.select("key", "page_id")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
    tasks = max(partitions(spark), size // TASK_BYTES)
    buckets = max(4 * tasks, size // BUCKET_BYTES)
    share = min(1.0, 40 * buckets / max(n, 1))
    sample = sorted((r.key, _order(r.page_id)) for r in keys.sample(share, 5).toLocalIterator()) if n > 100 * buckets or n > 2000 else []
    step = max(1, len(sample) // buckets)
    cuts = sorted(set(sample[step::step]))
    # The first and last places of each bucket, one more on either side at each pass.
    ends: dict[int, set[tuple[str, int]]] = {}
    for _ in range(REACH if cuts else 0):
        known = frozenset().union(*ends.values())
        edges = keys.mapInArrow(_bucketed(cuts, known), "bucket int, key string, id long").groupBy("bucket").agg(F.min(F.struct("key", "id")).alias("first"), F.max(F.struct("key", "id")).alias("last"))
        for r in edges.collect():
            ends.setdefault(r.bucket, set()).update((tuple(r.first), tuple(r.last)))
    also: dict[tuple[str, int], list[int]] = {}
    order = sorted(ends)
    for at, b in enumerate(order):
        for others, last in ((order[:at][::-1][:REACH], True), (order[at + 1 :][:REACH], False)):
            places = [x for o in others for x in sorted(ends[o], reverse=last)]
            for x in places[:REACH]:
                also.setdefault(x, []).append(b)
    parsed = rows.select("key", "page_id", "url", "html").mapInArrow(_parsed(cuts, also), _LINES)
    dealt = parsed.repartition(tasks, "bucket").sortWithinPartitions("bucket", "key", "id", "context")
    return dealt.mapInArrow(_differenced, "page_id long, url string, text string, n_chars long")
