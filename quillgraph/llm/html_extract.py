"""Main text of web pages by nearest-URL page differencing.

Pages of a host are ordered by URL path, and each page is paired with the neighbour whose path has the longest
start in common with its own. The text lines of both pages are aligned by a longest common subsequence, and lines
that both share go: menus, notices and footers repeat between pages where the article doesn't. The markup then
checks what is left. What it declares to be something else (navigation, adverts, forms, comments) goes too, as does
all outside a declared article; lines of a declared article that differencing took come back, since sentences of an
article may well stand in another of the site. The README has the figures of both steps.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.url_filter import host_and_path
from quillgraph.runtime import materialise

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|(?P<text>[^<]+|<)""", re.DOTALL)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)

#: Elements whose content isn't text, read up to their end tag.
_RAW = frozenset(("script", "style", "template", "noscript", "textarea", "iframe", "svg", "title", "select", "math", "canvas", "object"))
#: Those whose content isn't markup either: it ends at the first end tag of their name, whatever stands before.
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in ("script", "style", "noscript", "textarea", "iframe", "title")}
#: Elements that aren't part of an article.
_OUTSIDE = frozenset(("head", "nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset"))
#: Elements that stand on lines of their own.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements without an end tag.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose end tag may be left out; they are never held open.
_LOOSE = frozenset("p li dd dt td th tr tbody thead tfoot option optgroup html body".split())
#: Words of a class, id or role that mark what isn't the article.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars aside complementary header masthead topbar footer contentinfo toolbar share sharing social related recommended "
    "comment comments disqus replies reply respond search pagination pager skip login".split()
)


def _marked(attrs: str) -> bool:
    for name, *values in _ATTR.findall(attrs):
        value = next(filter(None, values), "").lower()
        if name.lower() == "hidden" or (name.lower() == "aria-hidden" and value == "true"):
            return True
        if not _MARKS.isdisjoint(re.split(r"[^a-z]+", value)):
            return True
    return False


def text_lines(page: str | None) -> list[tuple[str, bool, bool]]:
    """The page's lines of text in order: text, whether it lies in a declared article, whether in a part declared to be none."""
    lines: list[tuple[str, bool, bool]] = []
    held: list[str] = []
    open_: list[tuple[str, bool, bool]] = []  # element, is an article, is none
    names: Counter[str] = Counter()  # of the open elements
    article = outside = 0
    raw_until = ""

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split()) if held else ""
        held.clear()
        if text:
            lines.append((text, article > 0, outside > 0))

    page = page or ""
    tokens = _TOKEN.finditer(page)
    while (m := next(tokens, None)) is not None:
        if m["tag"] is not None and not m["end"] and (ends := _RAW_END.get(m["tag"].lower())) and not m["attrs"].rstrip().endswith("/"):
            end = ends.search(page, m.end())
            tokens = _TOKEN.finditer(page, end.start() if end else len(page))
            continue
        if raw_until:
            if m["end"] and m["tag"].lower() == raw_until:
                raw_until = ""
            continue
        if m["text"] is not None:
            held.append(m["text"])
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag in _BLOCKS:
            flush()
        elif tag == "br":
            held.append(" ")
        if m["end"]:
            while names[tag]:
                name, is_article, none = open_.pop()
                names[name] -= 1
                if is_article or none:
                    flush()
                article -= is_article
                outside -= none
                if name == tag:
                    break
        elif tag in _RAW:
            raw_until = tag if not m["attrs"].rstrip().endswith("/") else ""
        elif tag not in _VOID and tag not in _LOOSE and not m["attrs"].rstrip().endswith("/"):
            # a header within an article is the article's own head
            none = tag in _OUTSIDE or (tag == "header" and not article) or _marked(m["attrs"])
            is_article = tag in ("article", "main") and not none
            if none or is_article:
                flush()
            article += is_article
            outside += none
            open_.append((tag, is_article, none))
            names[tag] += 1
    flush()
    return lines


def shared_places(a: list[int], b: list[int]) -> set[int]:
    """Places of ``a`` in a longest common subsequence with ``b``, whatever repeats.

    A row of the table of lengths is one integer: bit j is unset where the length grows from j to j + 1 lines of
    ``b``. Every ``step``-th row is kept on the way down, and those between are made again on the way back.
    """
    every = (1 << len(b)) - 1
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j

    def rows(row: int, lines: list[int]) -> list[int]:
        out = [row]
        for x in lines:
            if hits := row & where.get(x, 0):
                row = ((row + hits) | (row - hits)) & every
            out.append(row)
        return out

    step = math.isqrt(len(a)) + 1
    kept = [every]
    for i in range(0, len(a), step):
        kept.append(rows(kept[-1], a[i : i + step])[-1])
    found, j = set(), len(b)
    for block in range(len(kept) - 2, -1, -1):
        first = block * step
        held = rows(kept[block], a[first : first + step])
        for i in range(len(held) - 1, 0, -1):
            # the last column before j where the length grows: what follows has no line to give
            j = (~held[i] & ((1 << j) - 1)).bit_length()
            if j and held[i - 1] >> (j - 1) & 1:
                found.add(first + i - 1)
                j -= 1
    return found


@dataclass
class Kept:
    """What is left of a page's lines. How many went by differencing alone, how many the markup rules out whether they are shared or not,
    how many differencing took at first, and how many of these the markup gave back."""

    lines: list[str]
    shared: int
    by_markup: int
    differenced: int
    restored: int


def kept_lines(lines: list[tuple[str, bool, bool]], shared: set[int]) -> Kept:
    """Differencing takes the lines at the places ``shared``; the markup gives back those of a declared article, and takes what isn't the article."""
    declared = any(article and not outside for _, article, outside in lines)
    ruled_out = {i for i, (_, article, outside) in enumerate(lines) if outside or (declared and not article)}
    restored = {i for i in shared if declared and i not in ruled_out}
    left = [i for i in range(len(lines)) if i not in shared or i in restored]
    return Kept([lines[i][0] for i in left if i not in ruled_out], len(shared - ruled_out - restored), len(ruled_out), len(shared), len(restored))


def main_text(lines: list[tuple[str, bool, bool]], shared: set[int]) -> str:
    """The page's lines without shared ones and without what the markup rules out, and with its declared article whole."""
    return " ".join(kept_lines(lines, shared).lines)


def _neighbours(keys: DataFrame) -> DataFrame:
    """For each page (``k1, k2``) the neighbour in order of host and path that shares more of its path; the earlier one on a tie.

    The order is global but no host is ever in one task: pages are dealt by range over host, path and id,
    neighbours are found within each range, and only the first and last page of each range are collected.
    """
    order = ("host", "path", "page", "k1", "k2")
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.dropDuplicates(["k1", "k2"]).repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = materialise(ranged.select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("seq")), "page-order")
    cell = F.struct("host", "path", "k1", "k2")
    ends = sorted(ranged.groupBy("range").agg(F.min_by(cell, "seq").alias("first"), F.max_by(cell, "seq").alias("last")).collect(), key=lambda r: r["range"])
    kind = "struct<host:string,path:string,k1:bigint,k2:bigint>"
    edges = [(r["range"], ends[i - 1]["last"] if i else None, ends[i + 1]["first"] if i + 1 < len(ends) else None) for i, r in enumerate(ends)]
    edges = F.broadcast(keys.sparkSession.createDataFrame(edges, f"range int, before {kind}, after {kind}"))
    at = Window.partitionBy("range").orderBy("seq")
    near = ranged.join(edges, "range").select("host", "path", "k1", "k2", F.coalesce(F.lag(cell).over(at), "before").alias("prev"), F.coalesce(F.lead(cell).over(at), "after").alias("next"))

    @F.pandas_udf("int")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        def start(x: str, y: str) -> int:
            return next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))

        return pd.Series([start(x, y) if x is not None and y is not None else -1 for x, y in zip(a, b, strict=True)], dtype="int32")

    fits = lambda c: F.when(F.col(f"{c}.host") == F.col("host"), F.col(f"{c}.path"))
    near = near.withColumn("p", common("path", fits("prev"))).withColumn("q", common("path", fits("next")))
    chosen = F.when((F.col("p") >= F.col("q")) & (F.col("p") >= 0), F.col("prev")).when(F.col("q") >= 0, F.col("next"))
    return near.select("k1", "k2", chosen.alias("other")).select("k1", "k2", F.col("other.k1").alias("o1"), F.col("other.k2").alias("o2"))


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 8_000_000) -> DataFrame:
    """``page_id, url, text, n_chars, n_shared, n_by_markup, n_differenced, n_restored`` for each page: the main text of the whole HTML, and
    numbers of lines: gone by differencing alone, ruled out by the markup, taken by differencing at first, and given back as a declared article's.

    Only hashes of lines are written and paired; a page's text never moves unless the lists of shared lines exceed
    ``broadcast_bytes`` (measured), where pages and lists are joined by a shuffle instead.

    * A null or empty page has an empty text. A null URL, or one without ``://``, belongs to the host without a name.
    * Rows that repeat a page count once as a neighbour; each gives a row, and all the same one.
    * A page without a neighbour on its host shares no line and keeps all that its markup doesn't rule out. An empty table gives an
      empty result; other columns aren't read. Ids are integers or null.
    """
    url, body = F.col(url_col), F.col(html_col)
    rows = pages.select(F.col(id_col).cast("bigint").alias("page"), url.alias("url"), body.alias("html"), F.xxhash64(id_col, url_col, html_col).alias("k1"), F.xxhash64(F.lit(11), F.col(id_col), url, body).alias("k2"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [host_and_path(x.as_py()) for x in batch.column("url")]
            lines = [text_lines(x.as_py()) for x in batch.column("html")]
            marks = [np.array([xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) for text, _, _ in x], np.uint64).view(np.int64) for x in lines]
            columns = [pa.array([x[0] for x in places], pa.string()), pa.array([x[1] for x in places], pa.string()), pa.array(marks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page", "k1", "k2")), *columns], names=["page", "k1", "k2", "host", "path", "marks"])

    marked = materialise(rows.mapInArrow(mark, "page bigint, k1 bigint, k2 bigint, host string, path string, marks array<bigint>"), "page-marks")
    pairs = materialise(_neighbours(marked.select("page", "host", "path", "k1", "k2")), "page-pairs")
    once = marked.dropDuplicates(["k1", "k2"])
    both = once.select("k1", "k2", "marks").join(pairs.where("o1 IS NOT NULL"), ["k1", "k2"]).join(once.select("k1", "k2", "marks").toDF("o1", "o2", "other"), ["o1", "o2"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [sorted(shared_places(a, b)) for a, b in zip(batch.column("marks").to_pylist(), batch.column("other").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(shared, pa.list_(pa.int32()))], names=["k1", "k2", "shared"])

    shared = materialise(both.select("k1", "k2", "marks", "other").mapInArrow(align, "k1 bigint, k2 bigint, shared array<int>").where(F.size("shared") > 0), "page-shared")
    size = shared.agg(F.sum(F.size("shared") * 4 + 32)).first()[0] or 0
    known = rows.join(F.broadcast(shared) if size <= broadcast_bytes else shared, ["k1", "k2"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [kept_lines(text_lines(page.as_py()), set(places.as_py() or ())) for page, places in zip(batch.column("html"), batch.column("shared"), strict=True)]
            texts = [" ".join(x.lines) for x in found]
            columns = [pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in ([len(t) for t in texts], [x.shared for x in found], [x.by_markup for x in found], [x.differenced for x in found], [x.restored for x in found]))]
            yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("url"), *columns], names=["page_id", "url", "text", "n_chars", "n_shared", "n_by_markup", "n_differenced", "n_restored"])

    return known.select("page", "url", "html", "shared").mapInArrow(write, "page_id bigint, url string, text string, n_chars bigint, n_shared bigint, n_by_markup bigint, n_differenced bigint, n_restored bigint")
