"""Main text of web pages by nearest-URL page differencing.

Every page becomes a list of text blocks, each marked by where it stands: in the page's own article element, in an element that names itself as
something else (menu, header, footer, sidebar, notice, advert, form, comments), or neither. Pages of a host whose remaining lines are all equal are copies and tell nothing about
the template: they count once, at their first path. The different contents are ranked by host and URL path with one range sort, each is
paired with its neighbours in that order, and the plain blocks (neither in an article nor self-named) are aligned by longest common subsequence. What a page shares with a neighbour is its site's
template and is deleted, from all its copies.

Differencing alone can't give right results: menus and adverts often differ from page to page, and paragraphs of an article can recur on the next
page. So blocks in self-named boilerplate go even if unshared, and blocks in an article element stay even if shared; differencing decides on the plain blocks of every page, with or without an article element.

The rank comes from the sizes of the sorted partitions, so pairs don't depend on how Spark cut the range, and a host with a third of all pages is spread
over as many partitions as its share. Only hashes of lines are sorted and joined.

Defined results: null or empty html gives an empty text; a null url is a host of its own; repeated rows share one result, and each gets its row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm.common import stash, table

#: Elements whose content is never text of the article.
DROPPED = frozenset("script style noscript template head title svg math iframe object canvas audio video select option button textarea input nav footer aside form menu dialog".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr td th".split())
#: Words in class, id or role by which an element names itself as something other than the article.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert sidebar nav navbar navigation menu "
    "breadcrumb breadcrumbs footer masthead comment comments disqus replies share sharing social related recommended newsletter subscribe signup popup modal overlay widget toolbar "
    "pagination pager login search contentinfo complementary form skip hidden".split()
)
ARTICLE, PLAIN, OTHER = 0, 1, 2
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?/][^>]*>", re.S)
NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def _self_named(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    if HIDDEN.search(attributes):
        return True
    return any(w in NAMED for _, value in NAMES.findall(attributes) for w in re.split(r"[^a-z]+", value.lower()))


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, where) of each block in page order, white space collapsed and references decoded."""
    page, out, text = page or "", [], []
    open_tags: list[tuple[str, int]] = [("", PLAIN)]

    def close() -> None:
        line = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if line:
            out.append((line, open_tags[-1][1]))

    at = 0
    while m := TAG.search(page, at):
        text.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if any(t == tag for t, _ in open_tags):
                if tag not in INLINE:
                    close()
                while open_tags[-1][0] != tag:
                    open_tags.pop()
                open_tags.pop()
        else:
            where = open_tags[-1][1]
            if tag not in INLINE:
                close()
                if tag in ("p", "div", "h1", "h2", "h3", "ul", "table", "article", "section") and open_tags[-1][0] not in ("", "html", "body") and any(t == "p" for t, _ in open_tags):
                    while any(t == "p" for t, _ in open_tags):
                        open_tags.pop()
                    where = open_tags[-1][1]
            elif tag in ("br", "td", "th", "img"):
                text.append(" ")
            if _self_named(tag, m[3], where == ARTICLE):
                if tag in INLINE and tag not in VOID:
                    close()
                where = OTHER
            elif tag in ("article", "main") and where == PLAIN:
                where = ARTICLE
            if tag in RAW and not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif tag not in VOID and not m[3].endswith("/"):
                open_tags.append((tag, where))
    text.append(re.split(r"<[a-zA-Z/!?]", page[at:], maxsplit=1)[0])  # less a tag that is cut off
    close()
    return out


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def shared_lines(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by bit-parallel rows and a walk back; of several, the one that takes the earliest place in ``b`` for each line of ``a`` from its end.

    Only every k-th row is kept, k about the root of their number; the walk back finds the rows between two of them once more. So memory grows as n ** 1.5 bits, not with the square.
    """
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1

    def after(row: int, x: int) -> int:
        hit = row & masks.get(x, 0)
        return ((row + hit) | (row - hit)) & full

    every, row, saved = isqrt(len(a)) + 1, full, []
    for i, x in enumerate(a):
        if i % every == 0:
            saved.append(row)
        row = after(row, x)
    out, j = [], len(b)
    matched = lambda row, j: j - (row & ((1 << j) - 1)).bit_count()
    for block in range(len(saved) - 1, -1, -1):
        low = block * every
        rows = [saved[block]]
        for x in a[low : low + every]:
            rows.append(after(rows[-1], x))
        for i in range(len(rows) - 1, 0, -1):
            here = matched(rows[i], j)
            while j and here == matched(rows[i], j - 1):
                j -= 1
            if j and here > matched(rows[i - 1], j):
                out.append((low + i - 1, j - 1))
                j -= 1
    return out[::-1]


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"), path.alias("path"))


def main_lines(page: str | None) -> list[tuple[str, int]]:
    """The blocks that may be main text."""
    return [(t, where) for t, where in blocks(page) if where != OTHER]


def marked(lines: list[tuple[str, int]]) -> bytes:
    """The lines, each after its mark."""
    return "\n".join(f"{where}{t}" for t, where in lines).encode("utf-8", "surrogatepass")


def content_key(host: str | None, content: bytes) -> int:
    """Equal for pages of a host whose main lines are equal."""
    host = b"0" if host is None else b"1" + host.encode("utf-8", "surrogatepass")
    return xxhash.xxh64_intdigest(host + b"\n" + content) - (1 << 63)


def contents(pages: DataFrame) -> DataFrame:
    """(key, host, path, hashes) of the different contents: the hashes of their plain lines, and the first path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = [], []
            # One page at a time as text, not a batch of them.
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                lines = main_lines(page.as_py())
                keys.append(content_key(host, marked(lines)))
                hashes.append([line_hash(t) for t, where in lines if where == PLAIN])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column("host"), batch.column("path"), pa.array(hashes, pa.list_(pa.int64()))], ["key", "host", "path", "hashes"])

    found = pages.select("host", "path", "html").mapInArrow(run, "key long, host string, path string, hashes array<long>")
    return found.groupBy("key").agg(F.first("host").alias("host"), F.min("path").alias("path"), F.first("hashes").alias("hashes"))


def candidates(pages: DataFrame) -> DataFrame:
    """(key, page_id, url, lines): the lines that may be main text, each after its mark, compressed for the shuffle to come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lines = [], []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                content = marked(main_lines(page.as_py()))
                keys.append(content_key(host, content))
                lines.append(zstandard.compress(content, 3))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column("page_id"), batch.column("url"), pa.array(lines, pa.binary())], ["key", "page_id", "url", "lines"])

    return pages.select("page_id", "url", "host", "html").mapInArrow(run, "key long, page_id long, url string, lines binary")


def ranked(found: DataFrame) -> DataFrame:
    """(key, hashes, host, rank): rank in the order of host, path and key."""
    schema = "key long, hashes array<long>, host string, part int, place long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            place = pa.array(np.arange(n, n + batch.num_rows))
            n += batch.num_rows
            keep = [batch.column(c) for c in ("key", "hashes", "host")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(np.full(batch.num_rows, part, np.int32)), place], ["key", "hashes", "host", "part", "place"])

    # The range sort samples its input: written first, so that pages are not parsed again for it.
    keyed = stash(found, "pages-contents").select("key", "hashes", "host", "path")
    placed = stash(keyed.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key").mapInArrow(number, schema), "pages-ranked")
    # One number for each partition, so bounded by the cluster's parallelism.
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    offset, rows = 0, []
    for part, n in sizes:
        rows.append((part, offset))
        offset += n
    offsets = F.broadcast(placed.sparkSession.createDataFrame(rows, "part int, offset long"))
    return placed.join(offsets, "part").select("key", "hashes", "host", (F.col("place") + F.col("offset")).alias("rank"))


def template_lines(found: DataFrame) -> DataFrame:
    """(key, shared array<long>): hashes of the plain lines that a content shares with a neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, shared = [], []
            for key, other, a, b in zip(*(batch.column(c).to_pylist() for c in ("key", "key2", "hashes", "hashes2")), strict=True):
                if common := [a[i] for i, _ in shared_lines(a, b)]:
                    keys += [key, other]
                    shared += [common, common]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(shared, pa.list_(pa.int64()))], ["key", "shared"])

    order = ranked(found)
    after = order.select(F.col("key").alias("key2"), F.col("hashes").alias("hashes2"), F.col("host").alias("host2"), (F.col("rank") - 1).alias("rank"))
    pairs = order.join(after, "rank").filter(F.col("host").eqNullSafe(F.col("host2"))).drop("host", "host2", "rank")
    shared = pairs.mapInArrow(run, "key long, shared array<long>").groupBy("key").agg(F.flatten(F.collect_list("shared")).alias("shared"))
    # Written, so that AQE can split the join of a content with very many copies.
    return stash(shared, "pages-shared")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row. Pages are parsed once for pairing and once for their text, so that text is shuffled once and never stored."""
    rows = _hosted(pages)
    joined = candidates(rows).join(template_lines(contents(rows)), "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for packed, shared in zip(batch.column("lines"), batch.column("shared"), strict=True):
                lines = zstandard.decompress(packed.as_py()).decode("utf-8", "surrogatepass").split("\n")
                gone = set(shared.as_py() or ())
                texts.append("\n\n".join(x[1:] for x in lines if x and (x[0] == str(ARTICLE) or line_hash(x[1:]) not in gone)))
            n = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), n], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "lines", "shared").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
