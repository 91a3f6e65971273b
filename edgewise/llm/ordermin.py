"""Document fingerprints by Order MinHash."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, partitions, seeds, text_bytes

#: Code points of a k-mer, sketches of a fingerprint, and k-mers of a sketch.
K, SKETCHES, TUPLE = 6, 100, 2
_KMER = U64(int(seeds(1, 301)[0]))
_DRAWS = seeds(SKETCHES, 401)
_SHIFTS = mix(seeds(SKETCHES, 501))
_STEP = 1 << 9
EMPTY = b"\0" * (4 * SKETCHES)


def numbered_kmers(points: np.ndarray) -> np.ndarray:
    """A hash of each k-mer of a text's code points (uint32) and of how often it has stood before, in text order."""
    n = len(points)
    if not n:
        return np.zeros(0, np.uint64)
    points = points.astype(np.uint64)
    if n < K:
        points = np.concatenate([points, np.full(K - n, 0xFFFFFFFF, np.uint64)])
        n = K
    kmers = np.zeros(n - K + 1, np.uint64)
    for j in range(K):
        kmers = kmers * _KMER + points[j : n - K + 1 + j]
    kmers = mix(kmers) & ~U64(0xFFFFFF)
    where = np.arange(len(kmers), dtype=np.uint64)
    if len(kmers) < 1 << 24:
        both = np.sort(kmers | where)
        order, inorder = (both & U64(0xFFFFFF)).astype(np.int64), both & ~U64(0xFFFFFF)
    else:
        order = np.argsort(kmers, kind="stable")
        inorder = kmers[order]
    at = np.arange(len(order))
    start = np.maximum.accumulate(np.where(np.r_[True, inorder[1:] != inorder[:-1]], at, 0))
    numbered = np.empty_like(kmers)
    numbered[order] = mix(inorder + (at - start).astype(np.uint64))
    return numbered


Smallest = tuple[np.ndarray, np.ndarray]  # of each sketch the TUPLE smallest hashes, and their places in the text


def smallest(numbered: np.ndarray, start: int, end: int, before: Smallest | None = None) -> Smallest:
    """Of the k-mers from start to end and those that `before` comes from."""
    if before is None:
        best, place = np.full((SKETCHES, TUPLE), ~U64(0)), np.zeros((SKETCHES, TUPLE), np.int64)
    else:
        best, place = before[0].copy(), before[1].copy()
    rows = np.arange(SKETCHES)
    for lo in range(start, end, _STEP):
        drawn = numbered[None, lo : min(end, lo + _STEP)] * _DRAWS[:, None]
        drawn += _SHIFTS[:, None]
        for _ in range(min(TUPLE, drawn.shape[1])):
            low = drawn.argmin(axis=1)
            value = drawn[rows, low]
            drawn[rows, low] = ~U64(0)
            worst = best.argmax(axis=1)
            better = value < best[rows, worst]
            best[rows[better], worst[better]] = value[better]
            place[rows[better], worst[better]] = low[better] + lo
    return best, place


def sketches(found: Smallest, count: int) -> bytes:
    """The fingerprint from the smallest hashes of a text of so many k-mers."""
    best, place = found
    count = min(TUPLE, count)
    if not count:
        return EMPTY
    if count < TUPLE:
        kept = np.argsort(best, axis=1, kind="stable")[:, :count]
        best, place = np.take_along_axis(best, kept, axis=1), np.take_along_axis(place, kept, axis=1)
    chosen = np.take_along_axis(best, np.argsort(place, axis=1), axis=1)
    out = np.zeros(SKETCHES, np.uint64)
    for j in range(count):
        out = mix(out + chosen[:, j] + U64(1))
    return (out >> U64(32)).astype(">u4").tobytes()


def fingerprint(points: np.ndarray) -> bytes:
    """Of a text's code points (uint32): 4 bytes a sketch.

    Each k-mer is numbered by how often it has stood before, so repeats count. For each sketch all numbered k-mers are
    hashed anew; the TUPLE smallest are put in the order they have in the text, and their hashes make the sketch. A text
    shorter than K counts as one k-mer, one with fewer k-mers than TUPLE uses what it has; the empty text's is all zeros.
    """
    numbered = numbered_kmers(points)
    return sketches(smallest(numbered, 0, len(numbered)), len(numbered))


def with_first_half(points: np.ndarray) -> tuple[bytes, int, Smallest]:
    """The fingerprint, and of the part that an edited text keeps: how many k-mers lie in it, and their smallest hashes."""
    numbered = numbered_kmers(points)
    kept = max(0, len(points) - len(points) // 2 - K + 1)
    half = smallest(numbered, 0, kept)
    return sketches(smallest(numbered, kept, len(numbered), half), len(numbered)), kept, half


def likeness(a: bytes, b: bytes) -> float:
    """Share of the sketches that two fingerprints have in common."""
    return float((np.frombuffer(a, ">u4") == np.frombuffer(b, ">u4")).mean())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _row(doc_id: int | None, text: str, own: bytes, kept: int, first: Smallest | None, head: str, following: bytes) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + head[:half]
    mine = own
    if edited != text:
        numbered = numbered_kmers(_points(edited))
        mine = sketches(smallest(numbered, kept, len(numbered), first), len(numbered))
    return doc_id, len(text), hashlib.sha256(edited.encode()).digest(), own, mine, likeness(own, mine), likeness(own, following)


_NAMES = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
_SCHEMA = "doc_id long, n_chars long, edited binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (closes, doc_id, text) in order. Each is finished by the one after it; a part ends with a row that closes it, the first of the part that follows."""
    last = None
    for got in batches:
        for lo in range(0, got.num_rows, 200):
            out = []
            for closes, doc_id, raw in zip(*(c.to_pylist() for c in got.slice(lo, 200).columns)):
                text = raw.decode()
                own, *first = with_first_half(_points(text))
                if last is not None:
                    out.append(_row(*last, text, own))
                last = None if closes else (doc_id, text, own, *first)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _KINDS)], names=_NAMES)


def bounds(ids: DataFrame, parts: int) -> tuple[list[int], dict[int | None, int]]:
    """Ids, descending, that cut the rows into about so many equal parts; and of ids that fill more than one part, null too, how many. Such an id is a range of its own."""
    at = [i / parts for i in range(parts + 1)]
    n, known, found = ids.agg(F.count("*"), F.count("doc_id"), F.percentile_approx("doc_id", at, F.lit(max(10_000, 20 * parts)))).first()
    often = {i: c for i, c in Counter(found or []).items() if c > 2}
    cuts = set(found or []) | {i + 1 for i in often if i < (1 << 63) - 1}
    if n > known:
        often[None] = max(1, parts * (n - known) // n)
    return sorted(cuts, reverse=True), often


def _part(cuts: list[int], often: dict[int | None, int]):
    """The part of a row (doc_id, text), a long: parts are in the order of the rows. Ids that fill several parts are dealt among them by the range of the text's hash."""
    step = max(1, int(len(cuts) ** 0.5))
    over = lambda x: x > F.col("doc_id")
    literal = lambda x: F.array(*map(F.lit, x)).cast("array<bigint>")
    # How many cuts are over the id: first by every step-th of them, then within that step.
    steps = F.size(F.filter(literal(cuts[::step]), over))
    place = F.when(steps == 0, 0).otherwise((steps - 1) * step + F.size(F.filter(F.slice(literal(cuts), (steps - 1) * step + 1, F.lit(step)), over)))
    place = F.coalesce(F.when(F.col("doc_id").isNotNull(), place), F.lit(len(cuts) + 1)).cast("long")
    share = F.xxhash64("text").cast("double") / F.lit(2.0**64) + 0.5
    sub = F.lit(0)
    for i, k in often.items():
        sub = F.when(F.col("doc_id").eqNullSafe(F.lit(i).cast("long")), F.least(F.lit(k - 1), F.floor(share * k))).otherwise(sub)
    return place * F.lit(1 << 31) + sub


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row a row of docs.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document in descending doc_id; after the last comes the first. near_* is the share of equal sketches.

    Documents are dealt to parts by ranges of their ids, so a task meets each document's successor right after it. Only
    the last document of a part needs the first of another; those firsts, one a part, are looked up before and go to both
    parts. So texts are shuffled once and nothing else is written. The list of parts and their first ids is collected.

    Null texts are empty. Null ids come last. Rows with the same id are ordered by the hash of their text, so equal rows
    can't be told apart and the result is defined. A table of one row follows itself; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    cuts, often = bounds(rows.select("doc_id"), partitions(spark))
    rows = rows.withColumn("part", _part(cuts, often))
    several = F.col("doc_id").isNull() | F.col("doc_id").isin([i for i in often if i is not None]) if often else F.lit(False)
    firsts = rows.groupBy("part").agg(F.max("doc_id").alias("id"), F.min(F.when(several, F.xxhash64("text"))).alias("hash")).orderBy("part").collect()
    if not firsts:
        return _named(rows.select("doc_id", "text").mapInArrow(lambda _: iter(()), _SCHEMA))
    order = [r.part for r in firsts]
    number = spark.createDataFrame([(p, i, r.id, r.hash, (i - 1) % len(order)) for i, (p, r) in enumerate(zip(order, firsts))], "part long, at int, id long, hash long, before int")
    numbered = rows.join(F.broadcast(number), "part")
    heads = numbered.where(F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash").isNull() | (F.xxhash64("text") == F.col("hash"))))
    heads = heads.groupBy("before").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "doc_id")).alias("x"))
    both = numbered.select("at", F.lit(False).alias("closes"), "doc_id", "text").unionByName(heads.select(F.col("before").alias("at"), F.lit(True).alias("closes"), "x.doc_id", "x.text"))
    ranged = both.repartitionById(len(order), F.col("at")).sortWithinPartitions("at", "closes", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    return _named(ranged.select("closes", "doc_id", "text").mapInArrow(_walk, _SCHEMA))


def _named(done: DataFrame) -> DataFrame:
    hex_ = lambda c: F.lower(F.hex(c))
    return done.select("doc_id", "n_chars", hex_("edited").alias("edited_sha256"), hex_("fingerprint").alias("fingerprint"), hex_("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next")


def op10(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
