"""Main text of web pages by differencing each page with the one whose URL is nearest."""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from math import isqrt
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_OPEN_END = re.compile(r"<[/!a-zA-Z][^<>]*\Z")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template iframe svg math textarea select title object audio video canvas".split())
_CHROME = set("nav footer aside form button dialog menu head label fieldset".split())
_CONTENT = set("article main".split())
_BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words of a class, id or role that mark what isn't the article.
_NOT_ARTICLE = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog disqus footer "
    "form gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion related "
    "replies reply responses search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split()
)
#: So many of the nearest pages of a host are looked for within REACH pages before and after; CERTAIN of them must agree on a line of an article.
NEAREST, REACH, CERTAIN = 4, 8, 3
#: What markup says of a line.
CONTENT, OPEN, CHROME = 0, 1, 2


def lines(page: str) -> list[tuple[str, int]]:
    """The page's blocks of text in order, each with CONTENT (in an article or main element), CHROME or OPEN.

    Unclosed elements end with their parent, a <p> with the next block; a page that breaks off in a tag loses that tag.
    """
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, whether it or one around it is chrome, and content
    text: list[str] = []

    def flush() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                _, chrome, content = stack[-1] if stack else ("", False, False)
                out.append((line, CHROME if chrome else CONTENT if content else OPEN))

    def close(tag: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return

    at = 0
    broken = _OPEN_END.search(page, max(0, page.rfind("<")))
    end = broken.start() if broken else len(page)
    while at < end:
        m = _TAG.search(page, at, end)
        text.append(page[at : m.start() if m else end])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in _BLOCK:
            flush()
        if m[1]:
            if any(s[0] == tag and (s[1] or s[2]) for s in stack[-1:]):
                flush()
            close(tag)
            continue
        if tag in _RAW and not m[3].endswith("/"):
            stop = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at, end)
            at = page.find(">", stop.start()) + 1 or end if stop else end
            continue
        if tag in _VOID or m[3].endswith("/"):
            continue
        if tag in _BLOCK and any(s[0] == "p" for s in stack):
            close("p")
        _, chrome, content = stack[-1] if stack else ("", False, False)
        if not chrome:
            chrome = tag in _CHROME or (tag == "header" and not content)
            if not chrome and "=" in m[3]:
                named = {w for x in _NAMED.finditer(m[3]) for w in re.split(r"[^a-z]+", (x[1] or x[2] or x[3] or "").lower())}
                chrome = bool(named & _NOT_ARTICLE) and tag not in ("html", "body")
            if chrome and tag not in _BLOCK:
                flush()
        stack.append((tag, chrome, content or tag in _CONTENT))
    flush()
    return out


def in_common(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence of a and b, by bit vectors over a (one addition a line of b).

    Lines that the other list lacks are left out first. Of the vectors every root-th is kept and those between are made
    again on the way back, so memory grows with the power 1.5 of the lines, not with their square.
    """
    lo = len(commonprefix([a, b]))
    hi = len(commonprefix([a[lo:][::-1], b[lo:][::-1]]))
    others, mine = set(b[lo : len(b) - hi]), set(a[lo : len(a) - hi])
    at = [i for i in range(lo, len(a) - hi) if a[i] in others]
    other = [x for x in b[lo : len(b) - hi] if x in mine]
    where: dict[int, int] = {}
    for i, place in enumerate(at):
        where[a[place]] = where.get(a[place], 0) | 1 << i
    full = (1 << len(at)) - 1

    def after(row: int, x: int) -> int:
        hit = row & where[x]
        return (row + hit | row - hit) & full

    step = isqrt(len(other)) + 1
    row, kept = full, []
    for j, x in enumerate(other):
        if j % step == 0:
            kept.append(row)
        row = after(row, x)
    found, i, j, rows = [], len(at), len(other), []
    while i and j:
        if not rows:  # rows[k] is the vector after the first of these lines and k more
            first = (j - 1) // step * step
            rows = [kept[first // step]]
            for x in other[first:j]:
                rows.append(after(rows[-1], x))
        if rows[-1] >> i - 1 & 1:
            i -= 1
            continue
        j -= 1
        rows.pop()
        if rows[-1] >> i - 1 & 1:
            i -= 1
            found.append(at[i])
        if len(rows) == 1:
            rows = []
    return [*range(lo), *reversed(found), *range(len(a) - hi, len(a))]


def main_text(page_lines: list[tuple[str, int]], hashes: list[int], near: list[list[int]]) -> str:
    """The lines that stay; near: the lines of the nearest pages, the nearest first.

    Lines that the nearest page or half of the others share (by alignment) go, and so do those that markup shows to be chrome. What
    is inside an article or main element may be quoted by another article, so there it takes at least CERTAIN pages with
    articles of their own, all of which share the line. Pages with such an element consist of what is in it. A page that
    has nearly all lines of this one is a copy of it and tells nothing.
    """
    content = {i for i, (_, role) in enumerate(page_lines) if role == CONTENT}
    votes, own_votes, asked, own_asked, first = Counter(), Counter(), 0, 0, set()
    for other in near:
        shared = in_common(hashes, other)
        if 10 * len(shared) >= 9 * max(len(hashes), len(other)):
            continue
        votes.update(shared)
        first = first or set(shared)
        asked += 1
        inside = content.intersection(shared)
        if 2 * len(inside) <= len(content):
            own_votes.update(inside)
            own_asked += 1
    if content:
        return "\n".join(x for i, (x, role) in enumerate(page_lines) if role == CONTENT and not (own_asked >= CERTAIN and own_votes[i] == own_asked))
    return "\n".join(x for i, (x, role) in enumerate(page_lines) if role != CHROME and not (i in first or (asked and 2 * votes[i] >= asked)))


class _Page:
    """A page in URL order: part and idx say where it stands, back how many pages of its part come after it (once known)."""

    def __init__(self, part, idx, page_id, url, host, path, packed, roles, hashes, back=None):
        self.part, self.idx, self.back = part, idx, back
        self.page_id, self.url, self.host, self.path = page_id, url, host or "", path or ""
        self.packed, self.roles, self.hashes = packed, roles, hashes

    def finished(self, around: list[_Page]) -> tuple:
        """around: the pages within REACH before and after it, in order."""
        mine = next(i for i, p in enumerate(around) if p is self)
        same = [(-len(commonprefix([self.path, p.path])), abs(i - mine), i < mine, p) for i, p in enumerate(around) if p is not self and p.host == self.host]
        nearest, seen = [], {tuple(self.hashes)}
        for *_, p in sorted(same, key=lambda x: x[:3]):
            if (key := tuple(p.hashes)) not in seen and len(nearest) < NEAREST:
                seen.add(key)
                nearest.append(p.hashes)
        text = main_text(list(zip(_unpack(self.packed, len(self.roles)), self.roles)), self.hashes, nearest)
        return self.page_id, self.url, text, len(text)

    def row(self) -> tuple:
        return None, None, self.part, self.idx, self.back, self.page_id, self.url, self.host, self.path, self.packed, self.roles, self.hashes


_LINES = "page_id long, url string, host string, path string, packed binary, roles array<int>, hashes array<long>"
_TEXT = "page_id long, url string, text string, n_chars long"
_WALKED = "text string, n_chars long, part int, idx long, back long, " + _LINES


def _candidates(page_lines: list[tuple[str, int]]) -> list[str | None]:
    """The lines that may stay; None for those that can't, of which the hash is enough to align them."""
    content = any(role == CONTENT for _, role in page_lines)
    return [x if (role == CONTENT if content else role != CHROME) else None for x, role in page_lines]


def _pack(texts: list[str | None]) -> bytes:
    """Lines hold no line feed and aren't empty, so an empty one stands for None."""
    return zstandard.ZstdCompressor().compress("\n".join(x or "" for x in texts).encode())


def _unpack(packed: bytes, n: int) -> list[str | None]:
    return [x or None for x in zstandard.ZstdDecompressor().decompress(packed).decode().split("\n")] if n else []


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            found = [lines(x or "") for x in part.column(4).to_pylist()]
            packed = pa.array([_pack(_candidates(f)) for f in found], pa.binary())
            roles = pa.array([[r for _, r in f] for f in found], pa.list_(pa.int32()))
            hashes = pa.array([[xxhash.xxh3_64_intdigest(x) >> 1 for x, _ in f] for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:4], packed, roles, hashes], names=_columns())


_KINDS = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], names=[c.split()[0] for c in _WALKED.split(", ")])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in URL order. Each is finished among those within REACH; the first and last 2 * REACH of a part are handed on as well, as the outer ones need pages of other parts."""
    window: deque[_Page] = deque(maxlen=2 * REACH + 1)  # the last page is REACH after the one that is finished
    tail: deque[_Page] = deque(maxlen=2 * REACH)
    heads: list[_Page] = []
    n, out = 0, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            page = _Page(row[0], n, *row[1:])
            n += 1
            window.append(page)
            tail.append(page)
            if len(heads) < 2 * REACH:
                heads.append(page)
            if len(window) == 2 * REACH + 1:
                done = window[REACH]
                page_id, url, text, size = done.finished(list(window))
                out.append((text, size, done.part, done.idx, None, page_id, url, *[None] * 5))
            if len(out) >= 200:
                yield _batch(out)
                out = []
    for page in {p.idx: p for p in [*heads, *tail]}.values():
        page.back = n - 1 - page.idx
        out.append(page.row())
    if out:
        yield _batch(out)


def _seam(rows: pa.Table) -> pa.Table:
    """The pages around the seam of two parts (and of all between, if they are short), finished if they stand within REACH of it."""
    pages = [_Page(*(r[c] for c in ("part", "idx", "page_id", "url", "host", "path", "packed", "roles", "hashes", "back"))) for r in rows.sort_by([("part", "ascending"), ("idx", "ascending")]).to_pylist()]
    wanted = dict(zip(zip(rows["part"].to_pylist(), rows["idx"].to_pylist()), rows["wanted"].to_pylist()))
    out = [p.finished(pages[max(0, i - REACH) : i + REACH + 1]) for i, p in enumerate(pages) if wanted[p.part, p.idx]]
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, (pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row a row of pages (page_id, url, html); other columns aren't read.

    Pages are sorted by range on (host, path), so each meets the pages with the nearest paths right beside it, and no
    host lands in one task. Within REACH pages before and after it, the NEAREST different pages of its host with the
    longest common starts of the path are its partners. Its lines are aligned with those of each by a longest common
    subsequence, and shared lines are deleted (see main_text). Lines that the markup (tag, role, class, id) shows to be
    menus, forms, adverts, comments and so on are deleted too, as they need not be the same on two pages.

    Only lines that may stay are shuffled as (compressed) text; of the others the 64-bit hash, by which lines are aligned, is enough.
    The outer pages of a part are finished afterwards, together with those of the parts beside it, so the result doesn't
    depend on where parts end; the parts that aren't empty are listed on the driver, two numbers a part. Null html is
    empty and gives an empty text; null urls share the empty host and path, as do urls without a host. Copies of a page
    are no partners of it, and repeated rows get the same text unless their neighbours differ. A page without partners
    keeps all that markup doesn't show to be chrome. An empty table gives an empty table.
    """
    spark = pages.sparkSession
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host")
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path")
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host, path, "html").mapInArrow(_parse, _LINES)
    order = ["host", "path", "page_id", "url"]
    ranged = parsed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "hashes")
    walked = cut(ranged.select(F.spark_partition_id().alias("part"), *_columns()).mapInArrow(_walk, _WALKED), "pages", "zstd")
    done = walked.where("back is null").select("page_id", "url", "text", "n_chars")
    sizes = sorted((r[0], r[1] + 1) for r in walked.where("back is not null").groupBy("part").agg(F.max(F.col("idx") + F.col("back"))).collect())
    if not sizes:
        return done
    seams, seam = [], 0
    for part, n in sizes:
        head = seam
        seam += n >= 2 * REACH
        seams.append((part, head, seam))
    ends = walked.where("back is not null").join(F.broadcast(spark.createDataFrame(seams, "part int, head int, tail int")), "part")
    near_head, near_tail = F.col("idx") < 2 * REACH, F.col("back") < 2 * REACH
    ends = ends.withColumn("seam", F.explode(F.array_distinct(F.array_compact(F.array(F.when(near_head, F.col("head")), F.when(near_tail, F.col("tail")))))))
    wanted = ((F.col("seam") == F.col("head")) & (F.col("idx") < REACH)) | ((F.col("seam") == F.col("tail")) & (F.col("back") < REACH))
    ends = ends.select("part", "idx", "back", *_columns(), "seam", wanted.alias("wanted"))
    return done.unionByName(ends.groupBy("seam").applyInArrow(lambda t: _seam(t), _TEXT))


def _columns() -> list[str]:
    return ["page_id", "url", "host", "path", "packed", "roles", "hashes"]


def op1(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
