"""Main text of web pages by nearest-URL page differencing.

Pages are dealt by ranges of (host, URL path), so that each page stands beside
the pages of its host with the nearest paths; a host of any size spreads over as
many ranges as it needs. A page is cut into text lines, one per block, and
aligned with the page before and the page after it by a longest common
subsequence of lines (bit-parallel); lines that a neighbour shares are the
site's furniture and are deleted.

An exact check by markup follows, as articles can repeat a passage and menus
can differ from page to page: a line inside <article>, <main> or role=main stays
even if a neighbour has it; lines in menus, headers, footers, sidebars, notices,
adverts, forms and reader comments go; of a page that marks its article, only
lines inside it stay. An <article> or <main> inside an element that goes stays, unless
that is hidden; <article> also goes inside elements for other texts (comments, teasers).

Cases: null html is empty, its text is the empty string; a null URL stands for a
host of its own; equal URLs are neighbours in page_id order; repeated rows are
returned each; broken or truncated markup is read as far as it goes; other columns
are not read. The first and last page of each range wait until they are joined with
the last and first page of the ranges beside it, so that the ranges do not show.
"""

from __future__ import annotations

import html as _html
import json
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from .common import written

SCHEMA = "page_id long, url string, text string, n_chars long, n_shared long"
#: Of the pages at the ends of a range: its number, which end, the host and the lines with
#: their marks and the places that the neighbour within the range shares.
ENDS = "part int, first boolean, last boolean, host string, lines array<string>, marks array<string>, shared array<int>"

#: Elements whose content is never text, and elements that are not the article.
RAW = frozenset("script style noscript template iframe svg math canvas object audio video textarea select title head".split())
FURNITURE = frozenset("nav header footer aside form dialog menu button fieldset".split())
ARTICLE = frozenset(("article", "main"))
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Words of class, id and role values that mark furniture.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|"
    r"footer|sidebar|side-bar|aside|complementary|contentinfo|search|cookies?|consent|gdpr|notice|notification|alert|popup|modal|"
    r"overlay|newsletter|subscribe|signup|sign-up|login|share|sharing|social|related|recommended|comments?|comment-list|respond|"
    r"replies|disqus|pagination|pager|widget|toolbar|skip-link)(?:$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
#: Of these, what holds comments, teasers or adverts, which can be articles of their own.
OTHERS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|sidebar|side-bar|aside|complementary|contentinfo|footer|nav|"
    r"navigation|related|recommended|comments?|comment-list|respond|replies|disqus|widget)(?:$|[\s_-])", re.I)
OTHER_ELEMENTS = frozenset("nav footer aside menu".split())
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
#: Parts of class words that say what an element has or how it is, not what it is.
MODIFIERS = frozenset("with without has no not is show hide open opened closed visible active enabled disabled".split())

KEEP, PLAIN, DROP = "keep", "plain", "drop"
OTHER, HIDDEN = "drop other texts", "drop all"  # where <article>, and where <main> too, goes
DROPS = (DROP, OTHER, HIDDEN)  # ascending


def _words(value: str) -> str:
    """The words of a class, id or role value that can name an element."""
    words = (w.split("--")[0] for w in value.split())
    return " ".join(w for w in words if w and MODIFIERS.isdisjoint(re.split(r"[_-]+", w.lower())))


def _marked(name: str, attributes: str) -> str | None:
    found = KEEP if name in ARTICLE else (OTHER if name in OTHER_ELEMENTS else DROP) if name in FURNITURE else None
    for key, value in ATTRIBUTE.findall(attributes) if attributes else ():
        value, key = value.strip("\"'"), key.lower()
        if key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true":
            return HIDDEN
        if key == "role" and value.strip().lower() == "main" and name not in FURNITURE:
            found = KEEP
        elif key in ("class", "id", "role") and name not in ("body", "html", *ARTICLE) and found != KEEP:
            words = _words(value)
            if MARKS.search(words):
                found = OTHER if found == OTHER or OTHERS.search(words) else DROP
    return found


def _set(mark: str, found: str | None, name: str) -> str | None:
    """The mark inside an element, if it is another than outside."""
    if found is None or mark not in DROPS:
        return found
    if found == KEEP:
        return KEEP if mark == DROP or mark == OTHER and name != "article" else None
    return found if DROPS.index(found) > DROPS.index(mark) else None


def lines(page: str) -> list[tuple[str, str]]:
    """(line, mark) of every block with text, in page order."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str]] = []  # open elements that carry a mark, with the marks in force inside
    opened: list[str] = []  # all open non-void elements
    mark = PLAIN
    at, n = 0, len(page)

    def end_line():
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, mark))

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at:m.start()])
        at = m.end()
        name = m[2]
        if name is None:  # a comment or declaration
            continue
        name, closing, attributes = name.lower(), m[1], m[3]
        if not closing and name in RAW:
            if name == "head":
                end_line()
                at = _skip(page, at, "head", stop=re.compile(r"</head\s*>|<body\b", re.I))
            elif not attributes.endswith("/"):
                at = _skip(page, at, name)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            end_line()
        if name in VOID:
            continue
        if not closing:
            if attributes.endswith("/") and name not in BLOCKS:
                continue
            if name == "p":  # a paragraph ends at the next one
                _close(opened, stack, "p", within=True)
                mark = stack[-1][1] if stack else PLAIN
            opened.append(name)
            set_to = _set(mark, _marked(name, attributes), name)
            if set_to:
                if name in BLOCKS or set_to in DROPS or mark in DROPS:
                    end_line()
                mark = set_to
                stack.append((len(opened), mark))
        else:
            before = mark
            if name in opened:
                if _close_changes(opened, stack, name):
                    end_line()
                _close(opened, stack, name)
                mark = stack[-1][1] if stack else PLAIN
            if before != mark:
                parts.clear() if before in DROPS else None
    end_line()
    return out


def _skip(page: str, at: int, name: str, stop=None) -> int:
    m = (stop or re.compile(rf"</{name}\s*>", re.I)).search(page, at)
    if m is None:
        return len(page)
    return m.start() if m[0].lower().startswith("<body") else m.end()


def _close_changes(opened, stack, name) -> bool:
    depth = len(opened) - opened[::-1].index(name)
    return bool(stack) and stack[-1][0] >= depth


def _close(opened, stack, name, within=False):
    """Close the innermost open ``name`` and all that is open inside it. ``within``:
    only if no other block stands in between."""
    for k in range(len(opened) - 1, -1, -1):
        if opened[k] == name:
            del opened[k:]
            while stack and stack[-1][0] > k:
                stack.pop()
            return
        if within and opened[k] in BLOCKS:
            return


def common_lines(a: list, b: list) -> set[int]:
    """Places in ``a`` that a longest common subsequence of ``a`` and ``b`` uses."""
    shared: set[int] = set()
    lo, n, m = 0, len(a), len(b)
    while lo < n and lo < m and a[lo] == b[lo]:
        shared.add(lo)
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
        shared.add(n)
    a_part, b_part = a[lo:n], b[lo:m]
    if not a_part or not b_part:
        return shared
    where: dict = {}
    for j, x in enumerate(b_part):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b_part)) - 1
    rows, v = [full], full
    for x in a_part:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    # a zero bit j of rows[i]: the LCS of a[:i] and b[:j+1] is longer than that of a[:i] and b[:j]
    i, j = len(a_part), len(b_part)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            shared.add(lo + i)
    return shared


def shared_lines(own: list[str], neighbours: list[list[str]]) -> set[int]:
    """Places of the lines that a neighbour shares."""
    return set().union(*(common_lines(own, other) for other in neighbours))


def main_text(own: list[tuple[str, str]], neighbours: list[list[tuple[str, str]]]) -> tuple[str, int]:
    """The lines that stay, and how many a neighbour shares."""
    shared = shared_lines([t for t, _ in own], [[t for t, _ in other] for other in neighbours])
    return _kept(own, shared), len(shared)


def _kept(own, shared) -> str:
    article = any(mark == KEEP for _, mark in own)
    return "\n".join(t for i, (t, mark) in enumerate(own) if mark == KEEP or mark == PLAIN and not article and i not in shared)


def extract(pages, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"):
    """(page_id, url, text, n_chars, n_shared) of every page."""
    def read(batches):
        """Packed lines in place of pages, so that less is dealt."""
        for b in batches:
            packed = [zlib.compress(json.dumps(lines(x or "")).encode(), 1) for x in b.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(packed, pa.binary())], names=["page_id", "url", "host", "path", "tie", "lines"])

    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    dealt = (pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                          F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0)).alias("host"),
                          F.regexp_replace(F.regexp_replace(rest, r"^[^/?#]*", ""), r"[?#].*$", "").alias("path"))
             .withColumn("tie", F.xxhash64("url", "html")).select("page_id", "url", "host", "path", "tie", "html")
             .mapInArrow(read, "page_id long, url string, host string, path string, tie long, lines binary")
             .repartitionByRange("host", "path", "page_id", "tie").sortWithinPartitions("host", "path", "page_id", "tie"))

    def run(batches):
        part = TaskContext.get().partitionId()

        def rows():
            for b in batches:
                for x in zip(*(b.column(k).to_pylist() for k in range(4))):
                    yield (*x, json.loads(zlib.decompress(x[2])))

        held, before, here = [], None, None
        for after in _with_end(rows()):
            if here is not None:
                beside = [x[4] for x in (before, after) if x is not None and here[1] is not None and x[3] == here[3]]
                own, first, last = here[4], before is None, after is None
                shared = shared_lines([t for t, _ in own], [[t for t, _ in x] for x in beside])
                text = _kept(own, shared)
                end = (part, first, last, here[3], [t for t, _ in own], [m for _, m in own], sorted(shared)) if first or last else (None,) * 7
                held.append((here[0], here[1], text, len(text), len(shared), *end))
                if len(held) >= 200:
                    yield _batch(held, schema)
                    held = []
            before, here = here, after
        if held:
            yield _batch(held, schema)

    def meet(batches):
        for b in batches:
            held = []
            for x in b.to_pylist():
                own, shared = list(zip(x["lines"], x["marks"])), set(x["shared"])
                if x["url"] is not None:
                    shared |= shared_lines(x["lines"], [x[k] for k in ("before", "after") if x[k] is not None])
                text = _kept(own, shared)
                held.append((x["page_id"], x["url"], text, len(text), len(shared)))
            yield _batch(held, list(schema)[:5])

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_shared", pa.int64()),
                        ("part", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_()), ("host", pa.string()),
                        ("lines", pa.list_(pa.string())), ("marks", pa.list_(pa.string())), ("shared", pa.list_(pa.int32()))])
    done = written(dealt.select("page_id", "url", "lines", "host").mapInArrow(run, f"{SCHEMA}, {ENDS}"), "pages-dealt", compression="zstd")
    ends = done.filter("part IS NOT NULL")
    # one number per range that has pages
    parts = sorted(r.part for r in ends.filter("first").select("part").collect())
    steps = F.broadcast(pages.sparkSession.createDataFrame(list(zip(parts, parts[1:])), "p int, q int"))

    def beside(end, key, other, name):
        """(part, host, lines) of the pages at that end of the range beside."""
        return (ends.filter(end).select(F.col("part").alias(other), F.col("host").alias(f"{name}_host"), F.col("lines").alias(name))
                .join(steps, other).select(F.col(key).alias(f"{name}_part"), f"{name}_host", name))

    joined = (ends.join(beside("last", "q", "p", "before"), F.col("first") & (F.col("part") == F.col("before_part")) & (F.col("host") == F.col("before_host")), "left")
              .join(beside("first", "p", "q", "after"), F.col("last") & (F.col("part") == F.col("after_part")) & (F.col("host") == F.col("after_host")), "left"))
    met = joined.select("page_id", "url", "lines", "marks", "shared", "before", "after").mapInArrow(meet, SCHEMA)
    return done.filter("part IS NULL").select("page_id", "url", "text", "n_chars", "n_shared").unionByName(met)


def _batch(rows, fields):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], names=[f.name for f in fields])


def _with_end(rows):
    yield from rows
    yield None
