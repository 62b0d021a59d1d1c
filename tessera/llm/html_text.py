"""Main text of web pages: markup where it speaks, nearest-URL page differencing where it doesn't.

A page is cut into blocks. Markup says that a block is content (inside ``article`` or ``main``), or boilerplate
(inside menus, headers outside articles, footers, sidebars, forms, or elements whose class, id or role says notice,
advert, comment and the like), or nothing. Pages that have content by markup lose their other blocks, so a line that
an article shares with a neighbour's article stays. The other pages' blocks of the last kind are judged by page
differencing: each such page is paired with the nearest pages before and after it, of all pages of its host in the
order of their paths, the hashes of its lines are aligned with all of theirs by longest common subsequence, and lines
shared with a neighbour are deleted. Pages whose lines, but for boilerplate by markup, are the same are copies: they
are passed over, so a run of copies is judged once, by the pages around it, and keeps its text.

Of pages with content by markup only hashes of lines are moved between machines: pages are cut into ranges of
(host, path), sorted, and streamed; the nearest page before each range that is no copy of its first page is also sent
to it, and the nearest one after that is no copy of its last page. The driver sees four pages' keys of each range.

Defined results: null html is empty and gives an empty text; unclosed and cut-off markup ends with the page; a null
url has an empty host and path; repeated rows are copies; a host of copies alone keeps their undecided lines.
"""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import durable
from tessera.llm.url_filter import host_of, path_of

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_QUOTE_OR_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")

# Element names of the HTML standard, and common words of class, id and role attributes.
BLOCKS = frozenset("address article aside blockquote body center caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("nav footer aside form head menu dialog button".split())
CONTENT = frozenset("article main".split())
SAYS_BOILER = re.compile(r"(?:^|[\s_-])(ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|gdpr|comments?|disqus|replies|reply|sidebar|side|widget|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|header|share|sharing|social|related|recommended|subscribe|newsletter|popup|modal|login|signup|search|form|contentinfo|complementary|pagination)(?:$|[\s_-])", re.I)
#: Whole classes, ids and roles that inside an article mark what is not its own.
NOT_OWN = frozenset("ad ads advert advertisement comments comment-list reader-comments disqus_thread navigation complementary contentinfo".split())
#: Elements whose text is no text of the page.
RAW = {n: re.compile(rf"</{n}[\s/>]", re.I) for n in "script style noscript template svg iframe textarea select".split()}
#: End tags that close what is open below them, whatever stands between.
CLOSES_ALL = frozenset("body html header section div".split()) | BOILER | CONTENT
#: Elements that an opening tag of the same kind ends.
SELF_ENDING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTENT_ROLE, UNDECIDED, BOILER_ROLE = 1, 0, -1


def _said(attributes: str) -> list[str]:
    """The values of class, id and role."""
    return [a or b or c for name, a, b, c in _ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id", "role")]


def _role(name: str, attributes: str, above: int) -> int:
    """What the markup says of an element's blocks, below one of which it says ``above``."""
    if above == BOILER_ROLE or name in BOILER:
        return BOILER_ROLE
    if attributes and name not in CONTENT and name != "body":
        said = _said(attributes)
        if any(w.lower() in NOT_OWN for v in said for w in v.split()) or above != CONTENT_ROLE and any(map(SAYS_BOILER.search, said)):
            return BOILER_ROLE
    if name == "header" and above != CONTENT_ROLE:
        return BOILER_ROLE
    return CONTENT_ROLE if name in CONTENT else above


def tags_of(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it is an end tag, attributes) of each tag; comments, declarations and elements with
    raw text have no name. One pass: a tag ends at the first ``>`` outside of quotes that open a value and close."""
    at, closes = 0, {'"': True, "'": True}
    while (start := html.find("<", at)) >= 0:
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = len(html) if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        if html[start + 1 : start + 2] in ("!", "?"):
            end = html.find(">", start)
            at = len(html) if end < 0 else end + 1
            yield start, at, "", False, ""
            continue
        ends = html[start + 1 : start + 2] == "/"
        m = _NAME.match(html, start + 1 + ends)
        if m is None:
            at = start + 1
            continue
        at = m.end()
        while True:
            q = _QUOTE_OR_END.search(html, at)
            if q is None:
                last = at = len(html)
                break
            at = q.end()
            if q[0] == ">":
                last = q.start()
                break
            k = q.start() - 1
            while html[k].isspace():
                k -= 1
            if html[k] == "=" and closes[q[0]]:
                close = html.find(q[0], at)
                # What is not found from here on is not found later either.
                closes[q[0]] = close >= 0
                at = close + 1 if close >= 0 else at
        name, attributes = m[0].lower(), html[m.end() : last]
        if not ends and name in RAW:
            close = RAW[name].search(html, at)
            end = -1 if close is None else html.find(">", close.start())
            at = len(html) if end < 0 else end + 1
            name = ""
        yield start, at, name, ends, attributes


def blocks_of(html: str) -> list[tuple[int, str]]:
    """(role, text) of each block in page order; texts are decoded, their white space is one space."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {}  # of the open elements, by name
    bounds: list[int] = []  # places of open sections, which a stray end tag inside them doesn't end
    role, at = UNDECIDED, 0

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((role, text))

    def pop() -> None:
        places[stack.pop()[0]].pop()
        if bounds and bounds[-1] == len(stack):
            bounds.pop()

    for start, end, name, ends, attributes in tags_of(html):
        if start > at:
            parts.append(html[at:start])
        at = end
        if name == "br":
            parts.append(" ")
        if not name or name in VOID and name != "hr":
            continue
        if name in BLOCKS or name in BOILER:
            flush()
        if ends:
            if places.get(name):
                below = places[name][-1]
                if name in CLOSES_ALL or not bounds or bounds[-1] <= below:
                    while len(stack) > below:
                        pop()
        elif name != "hr" and not attributes.endswith("/"):
            if others := SELF_ENDING.get(name):
                while stack and stack[-1][0] not in BLOCKS:
                    pop()
                if stack and stack[-1][0] in others:
                    pop()
            if name in CONTENT or name in BOILER or name == "div":
                bounds.append(len(stack))
            places.setdefault(name, []).append(len(stack))
            stack.append((name, _role(name, attributes, stack[-1][1] if stack else UNDECIDED)))
        role = stack[-1][1] if stack else UNDECIDED
    if at < len(html):
        parts.append(html[at:])
    flush()
    return out


def shared(a: list[int], b: list[int]) -> set[int]:
    """Positions of ``a`` in a longest common subsequence with ``b``."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    found = set(range(lo)) | set(range(len(a) - hi, len(a)))
    both = set(a[lo : len(a) - hi]) & set(b[lo : len(b) - hi])
    x = [i for i in range(lo, len(a) - hi) if a[i] in both]
    y = [b[j] for j in range(lo, len(b) - hi) if b[j] in both]
    # Hunt and Szymanski: ends[k] is the least end in y of a common subsequence of k + 1 lines.
    at_y: dict[int, list[int]] = {}
    for j, line in enumerate(y):
        at_y.setdefault(line, []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i in x:
        for j in reversed(at_y[a[i]]):
            k = bisect.bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    link = links[-1] if links else None
    while link is not None:
        found.add(link[0])
        link = link[1]
    return found


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``id``, ``url`` and ``text``, its content blocks in page order joined by two line ends."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    said = T.StructType([
        rows.schema["id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("lines", T.ArrayType(T.StringType())),
        T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("body", T.LongType()),
    ])
    arrow = to_arrow_schema(said)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, hashes, bodies = [], [], [], []
            for html in batch.column(2):
                found = blocks_of(html.as_py())
                content = [t for r, t in found if r == CONTENT_ROLE]
                texts.append("\n\n".join(content) if content else None)
                lines.append(None if content else [t for r, t in found if r == UNDECIDED])
                hashes.append([_hash(t.encode()) for _, t in found])
                bodies.append(_hash(array("q", [h for (r, _), h in zip(found, hashes[-1], strict=True) if r != BOILER_ROLE]).tobytes()))
            made = [pa.array(v, t) for v, t in zip((texts, lines, hashes, bodies), arrow.types[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], schema=arrow)

    found = durable(rows.mapInArrow(cut, said), "pages")
    decided = found.filter("text is not null").select("id", "url", "text")
    return decided.unionByName(by_difference(found.drop("text")))


def _hash(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True)


def _neighbours(ranged: DataFrame) -> list[tuple[int, int]]:
    """(part, n) of the pages outside of each part that its first and its last run of copies are paired with."""
    key = F.struct("host", "path", "n", "body")
    light = ranged.select("part", "host", "body", key.alias("key"))
    ends = light.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    other = lambda end: ~(F.col("host").eqNullSafe(F.col(f"{end}.host")) & (F.col("body") == F.col(f"{end}.body")))
    met = light.join(F.broadcast(ends), "part")
    inner = met.groupBy("part").agg(F.min("first").alias("first"), F.min(F.when(other("first"), F.col("key"))).alias("second"), F.max(F.when(other("last"), F.col("key"))).alias("last_but"), F.max("last").alias("last"))
    parts = inner.orderBy("part").collect()

    def nearest(end, around: Iterator) -> int | None:
        """The first page around that is no copy of ``end``, if it is of the same host."""
        for page in around:
            if page is not None and (page.host, page.body) != (end.host, end.body):
                return page.n if page.host == end.host else None
        return None

    out = []
    for i, part in enumerate(parts):
        before = nearest(part.first, (page for p in reversed(parts[:i]) for page in (p.last, p.last_but)))
        after = nearest(part.last, (page for p in parts[i + 1 :] for page in (p.first, p.second)))
        out += [(part.part, n) for n in (before, after) if n is not None]
    return out


def by_difference(pages: DataFrame) -> DataFrame:
    """``id``, ``url`` and ``text`` of those pages (``id``, ``url``, ``lines``, ``hashes``, ``body``) that have
    ``lines``, without the ones that are shared with the nearest pages before and after them in their host, in the
    order of their paths. ``hashes`` are of all lines of a page; pages of one ``body`` are copies."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keyed = pages.select("id", F.when(F.col("lines").isNotNull(), F.col("url")).alias("url"), "lines", "hashes", "body", F.monotonically_increasing_id().alias("n"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ranged = keyed.repartitionByRange("host", "path", "n").sortWithinPartitions("host", "path", "n").withColumn("part", F.spark_partition_id())
    ranged = durable(ranged, "ranges")
    around = ranged.sparkSession.createDataFrame(_neighbours(ranged), "to int, n bigint")
    nothing = {c: F.lit(None).cast(ranged.schema[c].dataType) for c in ("id", "url", "lines")}
    ends = ranged.drop("part").join(F.broadcast(around), "n").withColumnRenamed("to", "part").withColumns(nothing)
    both = ranged.unionByName(ends)
    out = T.StructType([ranged.schema["id"], ranged.schema["url"], T.StructField("text", T.StringType())])
    arrow = to_arrow_schema(out)

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = before = last = lines = None
        waiting: list[tuple] = []

        def judged(after: list[int] | None) -> Iterator[pa.RecordBatch]:
            if not waiting:
                return
            own = [_hash(t.encode()) for t in lines]
            gone = {i for other in (before, after) if other is not None for i in shared(own, other)}
            text = "\n\n".join(t for i, t in enumerate(lines) if i not in gone)
            some = max(1, 4_000_000 // (len(text) + 100))
            for at in range(0, len(waiting), some):
                ids, urls = zip(*waiting[at : at + some], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, arrow.types[0]), pa.array(urls, arrow.types[1]), pa.array([text] * len(ids), arrow.types[2])], schema=arrow)

        for batch in batches:
            for page in batch.to_pylist():
                at = (page["part"], page["host"], page["body"])
                if at != run:
                    near = run is not None and at[:2] == run[:2]
                    yield from judged(page["hashes"] if near else None)
                    waiting.clear()
                    run, before, lines = at, last if near else None, None
                last = page["hashes"]
                if page["lines"] is not None:
                    lines = page["lines"]
                    waiting.append((page["id"], page["url"]))
        yield from judged(None)

    n = int(ranged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartitionById(n, F.col("part")).sortWithinPartitions("part", "host", "path", "n").mapInArrow(differ, out)
