"""SimHash near-dedup with pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, local_forest, mix, partitions, row_key, text_bytes

SHINGLE = 3
MOST_BITS = 3
#: Reference fingerprints whose distances are tabled.
PIVOTS = 16
#: What the dedup stage looks for: similarity of the sets of so many words in a row, among fingerprints of them that differ in so many bits at most.
STAGE_SHINGLE, STAGE_BITS, SIMILAR = 5, 10, 0.8
#: Up to so many distinct fingerprints meet in buckets of two segments, more in buckets of three (the same pairs, of which each bucket holds fewer).
TWO_SEGMENTS = 1 << 20
#: Shingles of a text are counted in so many bins; what two texts can have in common follows from their counts.
COUNTS = 128
#: A bucket of more fingerprints is compared in chunks of so many, pair of chunks by pair of chunks.
CHUNK = 512


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of a UTF-8 text: a bit is 1 if set in over half the XXH64 (seed 42) of its shingles. No word: 0."""
    words = text.lower().split()  # of bytes: ASCII only, as the contract has it
    if not words:
        return 0
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        values = [hashed(joined, 42)]
    else:
        ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
        values = [hashed(joined[s:e], 42) for s, e in zip([0, *(e + 1 for e in ends)], ends[shingle - 1 :])]
    bits = np.unpackbits(np.array(values, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(values)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str | None = None, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp), and the text column key if there is one: fp is the fingerprint's 64 bits as a long. A null text is empty; repeated rows stay."""
    more = [key] if key else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), *more).mapInArrow(run, "doc_id long, fp long" + "".join(f", {c} string" for c in more))


def pivots(n: int = PIVOTS) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def links_within(group: np.ndarray, part: np.ndarray, fp: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of rows with the same group, and different parts where the group has two, whose fingerprints differ in at most `most` bits.

    |d(x, p) - d(y, p)| <= d(x, y) for every pivot p. A group is put in the order of the distance to the first pivot, and
    a row meets only those after it whose distance is at most `most` larger; a pair whose tabled distances differ by more
    at any other pivot is dropped before its fingerprints are looked at.
    """
    table = np.stack([np.bitwise_count(fp ^ p) for p in pivots()], axis=1).astype(np.int8)
    order = np.lexsort((table[:, 0], group))
    group, part, fp, table = group[order], part[order], fp[order], table[order]
    two = np.zeros(len(fp), bool)
    if len(fp):
        first = np.r_[True, group[1:] != group[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(len(fp)), 0))
        mixed = np.zeros(len(fp), bool)
        np.logical_or.at(mixed, start, part != part[start])
        two = mixed[start]
    found_a, found_b = [], []
    at = np.arange(len(fp))
    step = 0
    while len(at):
        step += 1
        at = at[at + step < len(fp)]
        at = at[(group[at] == group[at + step]) & (table[at + step, 0] - table[at, 0] <= most)]
        a, b = at, at + step
        wanted = ~two[a] | (part[a] != part[b])
        a, b = a[wanted], b[wanted]
        for lo in range(1, table.shape[1], 5):
            near = np.abs(table[a, lo : lo + 5] - table[b, lo : lo + 5]).max(axis=1, initial=0) <= most
            a, b = a[near], b[near]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= most
        found_a.append(a[near])
        found_b.append(b[near])
    return (order[np.concatenate(found_a)], order[np.concatenate(found_b)]) if found_a else (np.zeros(0, int), np.zeros(0, int))


def _forest(table: pa.Table) -> pa.Table:
    """Rows (bucket, part, fp) of many groups: links of each fingerprint to the first of those it is joined with."""
    fp = table["fp"].to_numpy().view(np.uint64)
    a, b = links_within(table["bucket"].to_numpy(), table["part"].to_numpy(), fp)
    nodes, inverse = np.unique(fp, return_inverse=True)
    label = local_forest(inverse[a], inverse[b], len(nodes))
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.table({"u": nodes[moved].view(np.int64), "v": nodes[label[moved]].view(np.int64)})


def _counts_here(a: np.ndarray, b: np.ndarray, fp: np.ndarray, t: np.ndarray, masks: list[int]) -> np.ndarray:
    """Whether each pair is in the bucket of the first mask it agrees in; pairs that meet in several buckets count there."""
    own = np.ones(len(a), bool)
    for i, m in enumerate(masks[: int(t.max(initial=0))]):
        own &= (i >= t[a]) | ((fp[a] ^ fp[b]) & np.uint64(m & (1 << 64) - 1) != 0)
    return own


def _can_be_similar(counts: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the counts of the shingles of each pair of texts leave room for a similarity of `least`: in a bin no more can be shared than the smaller count. A full bin leaves any room."""
    size, full = counts.sum(axis=1, dtype=np.int64), (counts == 255).any(axis=1)
    both = np.concatenate([np.zeros(0, np.int64), *(np.minimum(counts[a[i : i + 50_000]], counts[b[i : i + 50_000]]).sum(axis=1, dtype=np.int64) for i in range(0, len(a), 50_000))])
    return full[a] | full[b] | (both >= least * (size[a] + size[b] - both))


def _unlinked(table: pa.Table, most: int, least: float, masks: list[int], turn: int | None) -> pa.Table:
    """Rows (bucket, part, fp, t, node, label, counts) of many groups: pairs of nodes with different labels that can be similar (u, v, draw). All of them if turn is None, else of each node the one with the least draw, a number that differs from turn to turn."""
    group, part, t, node, label = (table[c].to_numpy() for c in ("bucket", "part", "t", "node", "label"))
    fp = table["fp"].to_numpy().view(np.uint64)
    _, of = np.unique(group, return_inverse=True)
    low, high = np.full(len(of), np.iinfo(np.int64).max), np.full(len(of), np.iinfo(np.int64).min)
    np.minimum.at(low, of, label)
    np.maximum.at(high, of, label)
    some = np.flatnonzero(low[of] < high[of])
    group, part, fp, t, node, label = group[some], part[some], fp[some], t[some], node[some], label[some]
    counts = np.frombuffer(b"".join(table["counts"].take(some).to_pylist()), np.uint8).reshape(-1, COUNTS)
    a, b = links_within(group, part, fp, most)
    keep = label[a] != label[b]
    a, b = a[keep], b[keep]
    keep = _counts_here(a, b, fp, t, masks)
    a, b = a[keep], b[keep]
    keep = _can_be_similar(counts, a, b, least)
    u, v = np.minimum(node[a[keep]], node[b[keep]]), np.maximum(node[a[keep]], node[b[keep]])
    draw = mix(mix(u.view(np.uint64)) ^ v.view(np.uint64) ^ np.uint64(turn or 0)).view(np.int64)
    if turn is not None:
        u, v, draw = np.r_[u, v], np.r_[v, u], np.r_[draw, draw]
        order = np.lexsort((draw, u))
        u, v, draw = u[order], v[order], draw[order]
        first = np.r_[True, u[1:] != u[:-1]] if len(u) else np.zeros(0, bool)
        u, v, draw = u[first], v[first], draw[first]
    return pa.table({"u": u, "v": v, "draw": draw})


def _nearest(table: pa.Table, most: int, masks: list[int]) -> pa.Table:
    """Rows (bucket, part, fp, t) of many groups: for each fingerprint the nearest smaller and the nearest larger one that it links with (u, v, bits)."""
    fp, t = table["fp"].to_numpy().view(np.uint64), table["t"].to_numpy()
    a, b = links_within(table["bucket"].to_numpy(), table["part"].to_numpy(), fp, most)
    own = _counts_here(a, b, fp, t, masks)
    a, b = a[own], b[own]
    nodes, inverse = np.unique(fp, return_inverse=True)
    bits = np.bitwise_count(fp[a] ^ fp[b]).astype(np.int64)
    low, high = np.minimum(inverse[a], inverse[b]), np.maximum(inverse[a], inverse[b])
    out = ([], [], [])
    for of, other in ((low, high), (high, low)):
        best = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(best, of, bits * len(nodes) + other)
        some = np.flatnonzero(best < np.iinfo(np.int64).max)
        for into, x in zip(out, (nodes[some].view(np.int64), nodes[best[some] % max(1, len(nodes))].view(np.int64), best[some] // max(1, len(nodes)))):
            into.append(x)
    return pa.table({"u": np.concatenate(out[0]), "v": np.concatenate(out[1]), "bits": np.concatenate(out[2])})


def _segments(most: int = MOST_BITS, agree: int = 2) -> list[int]:
    """Masks of every choice of `agree` among most + agree segments; fingerprints that differ in at most `most` bits agree in all bits of one of them."""
    n = most + agree
    width = [64 * i // n for i in range(n + 1)]
    one = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(width, width[1:])]
    masks = [sum(chosen) for chosen in combinations(one, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _met(fps: DataFrame, most: int, join, schema: str) -> DataFrame:
    """What join(rows, masks) makes of the distinct fingerprints that agree in some choice of segments (see _segments), bucket by bucket.

    Each distinct fingerprint goes to the buckets of its choices of segments, and pairs meet in a bucket. Buckets of one are
    dropped. Large buckets are dealt out in chunks, each pair of chunks to a task of its own. Where fps has columns node,
    label and counts, its rows meet instead of its fingerprints, and buckets of one label are dropped.
    """
    spark = fps.sparkSession
    own = ["node", "label", "counts"] if "label" in fps.columns else []
    nodes = cut(fps.where("fp is not null").select("fp", *own).distinct(), "distinct")
    agree = 2 if most <= MOST_BITS or nodes.count() <= TWO_SEGMENTS else 3
    masks = _segments(most, agree)
    keyed = nodes.select("fp", *own, F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    keyed = cut(keyed.select("fp", *own, "t", F.xxhash64("t", "key").alias("bucket")), "buckets")
    two = F.min("label") < F.max("label") if own else F.lit(True)
    many = keyed.groupBy("bucket").agg(F.count("*").alias("n"), two.alias("two")).where("n > 1 and two").select("bucket", "n")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    dealt = (
        keyed.join(many, "bucket")
        .select("fp", *own, "t", "bucket", chunks.alias("chunks"), F.pmod(F.xxhash64(own[0] if own else "fp", F.lit(7)), chunks).cast("int").alias("part"))
        .select("fp", *own, "t", "bucket", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select("fp", *own, "t", "part", F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("bucket"))
    )
    slices = 4 * partitions(spark)
    return dealt.groupBy(F.pmod("bucket", F.lit(slices)).alias("slice")).applyInArrow(lambda rows: join(rows, masks), schema)


def clusters(fps: DataFrame) -> DataFrame:
    """(fp, component): component is the fingerprint that stands for all that fp reaches over links of 3 or fewer bits; those without a link to another are left out.

    Equal fingerprints are one node. A task emits a forest, not pairs.
    """
    edges = _met(fps, MOST_BITS, lambda rows, _: _forest(rows), "u long, v long")
    return components(edges).select(F.col("node").alias("fp"), "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): one row a row of docs; component_id is the smallest doc_id reachable over links of fingerprints that differ in 3 or fewer bits.

    Null and blank texts have fingerprint 0 and are linked like any other. Rows with a null doc_id take part; a component
    of such rows alone has component_id null. An empty table gives an empty table.
    """
    fps = cut(fingerprints(docs), "fingerprints")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = first.join(clusters(fps), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    linked = cut(linked, "clusters")
    least = cut(linked.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    return fps.join(linked.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def shingles(text: str, n: int = STAGE_SHINGLE) -> set[bytes]:
    """The sets that are compared: n words in a row, A-Z in small letters; fewer words are one shingle, none is none."""
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def _similar(least: float, n: int):
    """Rows (u, v, a, b): those of which the texts a and b are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, left, keep = None, set(), []
            for a, b in zip(batch.column(2), batch.column(3)):
                if (text := a.as_py()) != last:  # rows that share a come together
                    last, left = text, shingles(text, n)
                right = shingles(b.as_py(), n)
                both = len(left & right)
                keep.append(left == right or both >= least * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["u", "v"])

    return run


def _counted(n: int):
    """Rows (node, text): (node, counts), the text's shingles counted in bins of their hash, up to 255 a bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(1):
                bins = np.array([xxhash.xxh64_intdigest(x, 42) % COUNTS for x in shingles(t.as_py(), n)], np.int64)
                found.append(np.minimum(np.bincount(bins, minlength=COUNTS), 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "counts"])

    return run


def similar_texts(docs: DataFrame, shingle: int = STAGE_SHINGLE, most: int = STAGE_BITS, similar: float = SIMILAR) -> DataFrame:
    """(_row, doc_id, node, component) for docs with a column _row that tells rows apart: node stands for the row's text, component for all texts it reaches over links.

    Two texts are linked if their fingerprints of `shingle` words differ in at most `most` bits and the Jaccard similarity
    of their shingle sets is at least `similar`. Every such pair is compared unless other links join its texts already:
    first texts with equal fingerprints and each fingerprint's nearest smaller and larger one, then, in turns, each text
    with one other of those that are near and in another component, while such turns find links, then all pairs left. In
    the last two, pairs whose counts of shingles leave no room for the similarity aren't compared. So a group whose texts
    link costs a few comparisons a text; near texts that don't link cost one a pair, at most.
    """
    fps = fingerprints(docs.withColumn("__key", F.concat_ws(",", "_row", F.xxhash64(F.coalesce("text", F.lit(""))).cast("string"))), "__key", shingle)
    of = F.split("__key", ",")
    fps = cut(fps.select("doc_id", "fp", of[0].alias("_row"), of[1].cast("long").alias("node")), "fingerprints")
    texts = fps.groupBy("fp", "node").agg(F.min("_row").alias("_row"))
    first = texts.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n"))
    alike = texts.join(first, "fp").where("node != first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    near = _met(fps, most, lambda rows, masks: _nearest(rows, most, masks), "u long, v long, bits long")
    near = cut(near.groupBy("u", (F.col("v") < F.col("u")).alias("side")).agg(F.min(F.struct("bits", "v")).alias("x")).select("u", F.col("x.v").alias("v")), "near")
    # Only texts that are near another take part from here on.
    some = near.select(F.col("u").alias("fp")).unionByName(first.where("n > 1").select("fp")).distinct()
    open_ = cut(texts.join(some, "fp").select("fp", "node", "_row"), "open")
    text = docs.select("_row", F.coalesce("text", F.lit("")).alias("text")).join(open_.select("_row", "node"), "_row").dropDuplicates(["node"]).select("node", "text")
    text = cut(text, "texts", "zstd")
    open_ = cut(open_.select("fp", "node").join(text.mapInArrow(_counted(shingle), "node long, counts binary"), "node"), "counts")

    def linked(asked: DataFrame) -> DataFrame:
        pairs = asked.join(text.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(text.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
        return cut(pairs.select("u", "v", "a", "b").mapInArrow(_similar(similar, shingle), "u long, v long"), "links")

    def left(reached: DataFrame, turn: int | None) -> DataFrame:
        labelled = open_.join(reached, "node", "left").select("fp", "node", F.coalesce("component", "node").alias("label"), "counts")
        return _met(labelled, most, lambda rows, masks: _unlinked(rows, most, similar, masks, turn), "u long, v long, draw long")

    one_way = lambda asked: cut(asked.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "asked")
    near = near.join(first.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    links = linked(one_way(alike.unionByName(near)))
    reached, turn, found, n = cut(components(links), "similar"), 0, 1, 1
    while found * 10 >= n > 0:
        turn += 1
        asked = one_way(left(reached, turn).groupBy("u").agg(F.min(F.struct("draw", "v")).alias("x")).select("u", F.col("x.v").alias("v")))
        new = linked(asked)
        n, found = asked.count(), new.count()
        if found:
            links = links.unionByName(new)
            reached = cut(components(links), "similar")
    if n:
        new = linked(one_way(left(reached, None)))
        if not new.isEmpty():
            reached = cut(components(links.unionByName(new)), "similar")
    return fps.join(reached, "node", "left").select("_row", "doc_id", "node", F.coalesce("component", "node").alias("component"))


def drop_near_duplicates(docs: DataFrame, shingle: int = STAGE_SHINGLE, most: int = STAGE_BITS, similar: float = SIMILAR) -> DataFrame:
    """docs without all but one row of each group of near duplicates (see similar_texts). Columns stay as they are.

    The row with the smallest doc_id stays (null ids come last; of rows with the same id, that with the smallest key of all
    its columns). Rows are told apart by that key, not by doc_id, so null or repeated ids cost no text of another group;
    rows that agree in all columns are one. Null and blank texts are near duplicates of each other. An empty table gives an
    empty table. What is lost of recall: texts more similar than asked for whose fingerprints differ in more bits.
    """
    keyed = docs.withColumn("_row", row_key(docs.columns))
    linked = similar_texts(keyed, shingle, most, similar)
    keep = cut(linked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("x")).select("x._row"), "keep")
    return keyed.join(keep, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")


def op7(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
