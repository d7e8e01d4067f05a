"""HTML extraction by nearest-URL page differencing.

A page becomes a list of text lines, one per block, each with the place it stands in. Pages are put in order of host
and URL path, and neighbours are paired. The lines of a pair are aligned by a longest common subsequence, and lines
that both pages share are template: they go. What a page's own markup names as menu, header, footer, sidebar,
notice, advert, form, script, style or comments goes too, for such blocks also differ from page to page.

A pure difference would also delete a paragraph that two articles quote. So inside an explicit article or main element,
paragraphs, headings, list items, quotations and preformatted text stay; other shared blocks go there as well. A page
all of whose own lines are shared is a copy of its neighbour, not a template, and keeps them.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskweave.llm.common import written

#: Elements whose content is no text of the page.
_SILENT = "script style head title noscript template svg math iframe object canvas select textarea button audio video".split()
#: Elements that a page's markup names as something else than its main text.
_CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
#: Elements that hold blocks, and those that are blocks of their own.
_HOLDERS = _CHROME | set("div section article main ul ol dl table tbody thead tfoot tr figure blockquote details fieldset center body".split())
_LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd td th pre figcaption caption summary address hr legend option".split())
_PROSE = set("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption".split())
#: Words in a class, id or role that name such a place.
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|nav|navbar|navigation|menu|breadcrumbs?|header|footer|masthead|"
    r"sidebar|side|aside|widget|related|recommend\w*|share|sharing|social|comments?|reply|respond|disqus|notice|cookie\w*|"
    r"consent|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|pagination|pager|toolbar|skip|"
    r"copyright|legal|disclaimer|complementary|contentinfo|alert|dialog)(?=$|[\s_-])",
    re.I,
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    rf"<({'|'.join(_SILENT)})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|"
    r"<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


def lines_of(page: str | None) -> list[tuple[str, str, str]]:
    """``(key, zone, text)`` of each block with text, in page order.

    zone: "chrome" where markup names another part of the page, "prose" for a text block inside an article or main
    element, "inside" for other blocks in there, "open" for all else. key: the block's element and its text.
    """
    page = page or ""
    out: list[tuple[str, str, str]] = []
    stack: list[tuple[str, bool]] = []  # open holders, and whether each is chrome
    leaf, leaf_chrome = "", False
    held: list[str] = []

    def close():
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if not text:
            return
        names = [n for n, _ in stack]
        if leaf_chrome or any(c for _, c in stack):
            zone = "chrome"
        elif "article" in names or "main" in names:
            zone = "prose" if (leaf in _PROSE or names[-1] in _PROSE or not leaf and names[-1] in ("article", "main")) else "inside"
        else:
            zone = "open"
        out.append((f"{leaf or (names[-1] if names else '')} {text}", zone, text))

    def chrome(name: str, attributes: str) -> bool:
        if name in _CHROME:
            return True
        if not attributes:
            return False
        if _HIDDEN.search(attributes):
            return True
        return name not in ("body", "article", "main") and any(
            _NAMED.search(a or b or c) for a, b, c in _NAMES.findall(attributes)
        )

    at = 0
    for m in _TOKEN.finditer(page):
        held.append(page[at : m.start()])
        at = m.end()
        ending, name, attributes = m[2], (m[3] or "").lower(), m[4] or ""
        if not name:
            continue
        if name == "br":
            held.append(" ")
        elif name in _LEAVES:
            close()
            leaf, leaf_chrome = ("", False) if ending else (name, chrome(name, attributes))
        elif name in _HOLDERS:
            close()
            leaf, leaf_chrome = "", False
            if not ending:
                stack.append((name, chrome(name, attributes)))
            elif any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
    held.append(page[at:])
    close()
    return out


def common(a: list, b: list) -> tuple[set[int], set[int]]:
    """The places of a longest common subsequence in both lists (by longest increasing chains of matching places)."""
    places: dict = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i, key in enumerate(a):
        for j in places.get(key, ()):
            k = bisect_left(ends, j)
            link = (i, j, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            else:
                ends[k] = j
                chains[k] = link
    left, right = set(), set()
    link = chains[-1] if chains else None
    while link:
        left.add(link[0])
        right.add(link[1])
        link = link[2]
    return left, right


def dropped(a: list[tuple[int, str]], shared: set[int]) -> list[int]:
    """Which of a page's own lines go, counted without chrome, when those at ``shared`` stand on its neighbour too."""
    own = [k for k, (_, zone) in enumerate(a) if zone != "c"]
    if all(k in shared for k in own):
        return []  # a copy of its neighbour, not a template
    return [n for n, k in enumerate(own) if k in shared and a[k][1] != "p"]


_PLACE = r"^(?:[A-Za-z][\w+.-]*:)?(?://)?([^/?#]*)([^?#]*)"


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` for each row of ``pages (page_id, url, html)``: the main text, empty if there is none.

    Distinct pages of a host are ranked by URL path by a sort over ranges, so that a large host lies over many tasks;
    the pages of ranks 2k and 2k + 1 are a pair, and an odd last page is compared with the one before it. Only
    hashes of lines travel for this; the text of a page moves once, to meet the lines that it loses.
    Null or empty html has an empty text, a null url is a host of its own, repeated rows come out as often as they
    come in, and a page without a neighbour has its text by its markup alone.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    known = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("id"))

    def outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                lines = [lines_of(x) for x in some.column("html").to_pylist()]
                hashes = [[xxhash.xxh64_intdigest(key) - (1 << 63) for key, _, _ in page] for page in lines]
                zones = ["".join(zone[0] for _, zone, _ in page) for page in lines]
                columns = [pa.array(hashes, pa.list_(pa.int64())), pa.array(zones, pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [some.column("id"), some.column("url"), *columns], names=["id", "url", "keys", "zones"]
                )

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                own = [
                    pack.compress("\n".join(text for _, zone, text in lines_of(x) if zone != "chrome").encode())
                    for x in some.column("html").to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [some.column("id"), some.column("page_id"), some.column("url"), pa.array(own, pa.binary())],
                    names=["id", "page_id", "url", "own"],
                )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def done():
            shared: list[set[int]] = [set() for _ in rows]
            for a, b in zip(range(len(rows)), range(1, len(rows)), strict=False):
                left, right = common(rows[a]["keys"], rows[b]["keys"])
                shared[b] = right
                if a == 0:
                    shared[a] = left
            lost = [dropped(list(zip(r["keys"], r["zones"], strict=True)), x) for r, x in zip(rows, shared, strict=True)]
            some = [(r["id"], x) for r, x in zip(rows, lost, strict=True) if x]
            return pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in some], pa.int64()), pa.array([x for _, x in some], pa.list_(pa.int32()))],
                names=["id", "lost"],
            )

        for batch in batches:
            for r in batch.to_pylist():
                if rows and (r["host"], r["pair"]) != group:
                    yield done()
                    rows = []
                group = (r["host"], r["pair"])
                rows.append(r)
        if rows:
            yield done()

    address = F.coalesce("url", F.lit(""))
    outlines = (
        known.select("id", "url", "html")
        .mapInArrow(outlined, "id bigint, url string, keys array<bigint>, zones string")
        .select(
            "id",
            F.lower(F.regexp_extract(address, _PLACE, 1)).alias("host"),
            F.regexp_extract(address, _PLACE, 2).alias("path"),
            "keys",
            "zones",
        )
        .dropDuplicates(["id"])
    )
    order = ["host", "path", "id"]
    local = written(
        written(outlines, "page-outlines")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("id", "host", "keys", "zones", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")),
        "page-order",
    )
    # Where each range starts in the whole order: one row per range.
    counts = local.groupBy("part").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = local.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("seq") - F.col("first"))
    hosts = ranked.groupBy("host").agg(F.min("rank").alias("low"), F.count("*").alias("n"))
    pair = F.least(F.floor((F.col("rank") - F.col("low")) / 2), F.floor(F.col("n") / 2) - 1)
    lost = (
        ranked.join(hosts, "host")
        .select("id", "host", F.greatest(F.lit(0), pair).alias("pair"), "rank", "keys", "zones")
        .repartition("host", "pair")
        .sortWithinPartitions("host", "pair", "rank")
        .mapInArrow(compared, "id bigint, lost array<int>")
    )

    @F.pandas_udf("string")
    def rendered(own: pd.Series, lost: pd.Series) -> pd.Series:
        unpack = zstandard.ZstdDecompressor()

        def text(packed: bytes, gone) -> str:
            lines = unpack.decompress(packed).decode()
            gone = set() if gone is None else {int(k) for k in gone}
            return "\n\n".join(x for k, x in enumerate(lines.split("\n")) if k not in gone) if lines else ""

        return pd.Series([text(a, b) for a, b in zip(own, lost, strict=True)])

    return (
        known.mapInArrow(texts, f"id bigint, page_id {kind}, url string, own binary")
        .join(lost, "id", "left")
        .select("page_id", "url", rendered("own", "lost").alias("text"))
    )
