"""Language-model scores: prediction by partial matching over bytes, beside a unigram base."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, crc_mod, cut, partitions, text_bytes

#: Longest context, in bytes of the running text. A (context, byte) is one key: the byte before in the highest place, the byte itself in the lowest.
ORDER = 5
#: Bytes of text that are looked at together, and of those that are sorted together.
BLOCK, PIECE = 1 << 24, 1 << 20
#: Slices of the trie for a corpus of up to SLICED bytes; beyond, their number grows with the root of its size.
SLICES, SLICED = 64, 1 << 32
_CLASSES = 1024
_MERGED = 1 << 22  # keys that a slice holds before it adds up what is alike
END = b""  # the end of a text, which no word equals
_START = b"\n" * ORDER


def spelled(words: list[bytes]) -> bytes:
    """What the model predicts of a text: each word and a space, then a line feed."""
    return b" ".join([*words, b"\n"])


def _chunks(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """The spelled texts in lots of about PIECE bytes: of which text each chunk is, and its bytes behind the ORDER bytes before them."""
    owners, chunks, size = [], [], 0
    for i, text in enumerate(texts):
        whole = _START + text
        for lo in range(0, len(text), PIECE):
            chunk = whole[lo : lo + PIECE + ORDER]
            owners.append(i)
            chunks.append(chunk)
            size += len(chunk)
            if size >= PIECE:
                yield owners, chunks
                owners, chunks, size = [], [], 0
    if owners:
        yield owners, chunks


def _keys(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The key at each byte of the chunks (without those before them), and where each chunk's start."""
    symbols = np.frombuffer(b"".join(chunks), np.uint8).astype(np.uint64)
    key = symbols[ORDER:].copy()
    for back in range(1, ORDER + 1):
        key |= symbols[ORDER - back : len(symbols) - back] << U64(8 * (ORDER - back + 1))
    lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
    own = np.ones(len(key), bool)
    joints = np.cumsum(lengths)[:-1]  # the first ORDER bytes of each later chunk are no predictions
    own[(joints[:, None] - ORDER + np.arange(ORDER)).ravel()] = False
    return key[own], np.cumsum(lengths - ORDER) - (lengths - ORDER)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, each with the sum of its counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _pack(numbers: np.ndarray) -> bytes:
    """Eight- or four-byte numbers, byte place by byte place, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes())


def _unpack(packed: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=U64(0)))


def _unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed, np.uint64), dtype=np.uint64)


def _slice_of_grams(keys: np.ndarray, slices: int) -> np.ndarray:
    """All contexts that end in the same two bytes share a slice."""
    last = keys >> U64(8 * (ORDER - 1))
    return ((last * U64(0x9E3779B97F4A7C15)) >> U64(40)).astype(np.int64) % slices


def _slice_of_words(keys: np.ndarray, slices: int) -> np.ndarray:
    return slices + ((keys >> U64(20)) % U64(slices)).astype(np.int64)


def _sliced(keys: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Slices and the places of their keys, which stay sorted."""
    order = np.argsort(of, kind="stable")
    first = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]]) if len(of) else []
    for part in np.split(order, first[1:]):
        if len(part):
            yield int(of[part[0]]), part


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_LEDGER = "block long, slice int, keys binary, counts binary"


def _ledger(slices: int):
    """Of each block of texts: the texts themselves (slice -1), and for each slice its keys and how often each was learned (0 in held-out texts only)."""

    def rows(block: int, ids: list, held: list[bool], texts: list[bytes]) -> pa.RecordBatch:
        plain = [spelled(t.lower().split()) for t in texts]
        learned: Counter = Counter()
        others: set[bytes] = {END}
        for text, out in zip(plain, held):
            if out:
                others.update(text.split())
            else:
                learned.update(text.split())
                learned[END] += 1
        others.difference_update(learned)
        words = [*learned, *others]
        parts = []
        for is_held in (False, True):
            for _, chunks in _chunks([t for t, h in zip(plain, held) if h == is_held]):
                key, n = np.unique(_keys(chunks)[0], return_counts=True)
                parts.append((key, n * (not is_held)))
        of_words = _merge([(_hashed(words), np.r_[np.fromiter(learned.values(), np.int64, len(learned)), np.zeros(len(others), np.int64)])])
        meta = np.array([[i or 0, i is None, h, len(t)] for i, h, t in zip(ids, held, texts)], np.int64)
        out = [(-1, zstandard.ZstdCompressor().compress(b"".join(texts)), _pack(meta.ravel()))]
        for (keys, n), dealt in ((_merge(parts), _slice_of_grams), (of_words, _slice_of_words)):
            out += [(s, _pack_sorted(keys[at]), _pack(n[at])) for s, at in _sliced(keys, dealt(keys, slices))]
        columns = [pa.array([block] * len(out), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary())))]
        return pa.RecordBatch.from_arrays(columns, names=["block", "slice", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, kept = TaskContext.get().partitionId() << 32, 0, ([], [], [])
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for into, x in zip(kept, row):
                    into.append(x)
                size += len(row[2])
                if size >= BLOCK:
                    yield rows(block, *kept)
                    block, size, kept = block + 1, 0, ([], [], [])
        if kept[0]:
            yield rows(block, *kept)

    return run


@dataclass
class Level:
    """Contexts of one length: the (context, byte) keys seen and their counts; of each context the sum of its counts and how many different bytes it has."""

    gram: np.ndarray
    c: np.ndarray
    context: np.ndarray
    start: np.ndarray
    n: np.ndarray
    kinds: np.ndarray

    @classmethod
    def of(cls, gram: np.ndarray, c: np.ndarray) -> Level:
        context, start, kinds = np.unique(gram >> U64(8), return_index=True, return_counts=True)
        return cls(gram, c, context, start, np.add.reduceat(c, start) if len(c) else c, kinds)

    def shorter(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of contexts one byte shorter. A byte counts once for each longer context that it was new in (update exclusion)."""
        return np.unique(_shorter(self.gram), return_counts=True)

    def left_out(self) -> np.ndarray:
        """For each class of contexts, how many of the bytes seen would have been known, and how many new, had each been left out of its context's counts."""
        of = np.repeat(np.arange(len(self.context)), self.kinds)
        n, kinds, many = self.n[of], self.kinds[of], self.c > 1
        known = np.bincount(_class(n[many] - 1, kinds[many]), self.c[many], minlength=_CLASSES)
        once = ~many & (n > 1)
        return np.array([known, np.bincount(_class(n[once] - 1, kinds[once] - 1), minlength=_CLASSES)], np.float64)

    def escapes(self, sums: np.ndarray) -> np.ndarray:
        """The share of new bytes in each context's class; where a class was hardly seen it comes near kinds / (n + kinds)."""
        known, new = sums[:, _class(self.n, self.kinds)]
        return np.clip((new + self.kinds / np.maximum(self.n + self.kinds, 1)) / (known + new + 1), 1e-6, 0.98)

    def left(self, below: Level) -> np.ndarray:
        """Of each context, what the bytes it knows leave of the counts of the context one byte shorter."""
        at = np.searchsorted(below.gram, _shorter(self.gram))
        up = np.searchsorted(below.context, self.context >> U64(8))
        return below.n[up] - np.add.reduceat(below.c[at], self.start)


def _shorter(gram: np.ndarray) -> np.ndarray:
    return gram >> U64(16) << U64(8) | gram & U64(255)


def _class(n: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The class of contexts seen n times with so many different bytes: exact for small numbers, by powers of two beyond."""
    coarse = lambda x, exact: (np.minimum(x, exact) + np.log2(np.maximum(x, exact) / exact)).astype(int)
    return np.minimum(coarse(n, 8) * 16 + np.minimum(coarse(kinds, 4), 15), _CLASSES - 1)


def levels(gram: np.ndarray, c: np.ndarray, longest: int = ORDER, shortest: int = 0) -> dict[int, Level]:
    """Levels from the counts of the longest contexts."""
    out = {}
    for k in range(longest, shortest - 1, -1):
        out[k] = Level.of(gram, c)
        if k:
            gram, c = out[k].shorter()
    return out


def log_probabilities(trie: dict[int, Level], sums: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """log10 probability of each key's byte after its context.

    A byte that a context has seen c of n times gets (1 - e) c / n there; otherwise the escape e is paid and the next
    shorter context is asked, without the bytes that the longer one knows (symbol exclusion). e is estimated for each
    class of contexts (length, n, number of different bytes) by leaving each byte seen out of the counts once. A context
    that was never seen, or that has no byte left, costs nothing. Below length 0 all other bytes are equally likely.
    """
    out = np.zeros(len(keys))
    at = np.arange(len(keys))
    over = np.full(len(keys), -1.0)  # what the bytes excluded so far leave of the level's count; -1: none was excluded
    for k in range(ORDER, -1, -1):
        level = trie[k]
        if not len(level.gram):
            continue
        gram = keys[at] >> U64(8 * (ORDER - k + 1)) << U64(8) | keys[at] & U64(255)
        context, there = _find(level.context, gram >> U64(8))
        hit, known = _find(level.gram, gram)
        room = np.where(over[at] >= 0, over[at], level.n[context])
        usable = there & (room > 0)
        escape = level.escapes(sums[k])[context]
        good = usable & known
        out[at[good]] += np.log10((1 - escape[good]) * level.c[hit[good]] / room[good])
        bad = usable & ~known
        out[at[bad]] += np.log10(escape[bad])
        if k and len(trie[k - 1].gram):
            over[at] = np.where(there, level.left(trie[k - 1])[context], -1.0)
        at = at[~good]
    out[at] -= np.log10(256 - len(trie[0].gram))
    return out


def _find(inorder: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each is (or would be), and whether it is there."""
    at = np.minimum(np.searchsorted(inorder, wanted), len(inorder) - 1)
    return at, inorder[at] == wanted


def _gathered(slices: int):
    """Rows (slice, keys, counts) sorted by slice: one row a slice with all its keys, their counts added up, and what the whole model needs of it."""

    def row(of: int, parts: list) -> tuple:
        keys, counts = _merge(parts)
        seen = counts > 0
        if of >= slices:
            stats = np.array([counts.sum(), seen.sum()], np.float64)
        else:
            own = levels(keys[seen], counts[seen], ORDER, 2)
            gram, c = own[2].shorter()
            stats = np.concatenate([*(own[k].left_out().ravel() for k in range(2, ORDER + 1)), gram.astype(np.float64), c])
        return of, _pack_sorted(keys), _pack(counts), _pack(stats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda r: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(r, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["slice", "keys", "counts", "stats"])
        at, parts, size = None, [], 0
        for batch in batches:
            for of, keys, counts in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in (1, 2))):
                if of != at:
                    if parts:
                        yield made(row(at, parts))
                    at, parts, size = of, [], 0
                parts.append((_unpack_sorted(keys.as_py()), _unpack(counts.as_py(), np.int64)))
                size += len(parts[-1][0])
                if size > 2 * _MERGED + 2 * len(parts[0][0]):  # what was merged before comes first
                    parts = [_merge(parts)]
                    size = len(parts[0][0])
        if parts:
            yield made(row(at, parts))

    return run


def _model(stats: list[tuple[int, bytes]], slices: int) -> tuple[dict[int, Level], np.ndarray, int, int]:
    """Levels 1 and 0, the escapes' sums for all levels, and the unigram model's totals, from what the slices have gathered."""
    sums = np.zeros((ORDER + 1, 2, _CLASSES))
    pairs = np.zeros(1 << 16)
    total = distinct = 0
    wide = (ORDER - 1) * 2 * _CLASSES
    for of, packed in stats:
        x = _unpack(packed, np.float64)
        if of >= slices:
            total, distinct = total + int(x[0]), distinct + int(x[1])
        else:
            sums[2:] += x[:wide].reshape(ORDER - 1, 2, _CLASSES)
            gram, c = x[wide:].reshape(2, -1)
            pairs[gram.astype(np.int64)] += c
    gram = np.flatnonzero(pairs)
    low = levels(gram.astype(np.uint64), pairs[gram].astype(np.int64), 1, 0)
    for k in (0, 1):
        sums[k] = low[k].left_out()
    return low, sums, total, distinct


def _answers(slices: int, shared):
    """Rows (slice, block, keys, counts) sorted by slice, the gathered one (block null) first: each block's keys with the log10 probabilities of grams and the counts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = known = values = None
        for batch in batches:
            out = []
            for s, block, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                keys = _unpack_sorted(keys)
                if block is None:
                    of, known, values = s, keys, _unpack(counts, np.int64)
                    if s < slices:
                        low, sums = shared.value
                        values = log_probabilities(levels(keys[values > 0], values[values > 0], ORDER, 2) | low, sums, keys).astype(np.float32)
                    continue
                if s != of:
                    raise RuntimeError(f"slice {s} comes before its counts")
                out.append((block, s, _pack_sorted(keys), _pack(values[np.searchsorted(known, keys)])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "slice", "keys", "counts"])

    return run


def _lookup(rows: list[tuple[bytes, bytes]], kind) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their values, from the rows of several slices."""
    keys = np.concatenate([_unpack_sorted(k) for k, _ in rows])
    values = np.concatenate([_unpack(v, kind) for _, v in rows])
    by = np.argsort(keys)
    return keys[by], values[by]


def _score(docs: pa.Table, answers: pa.Table, slices: int, total: int, distinct: int) -> pa.Table:
    """The scores of one block's texts."""
    meta = _unpack(docs["counts"][0].as_py(), np.int64).reshape(-1, 4)
    ends = np.cumsum(meta[:, 3])
    joined = zstandard.ZstdDecompressor().decompress(docs["keys"][0].as_py())
    plain = [spelled(joined[e - n : e].lower().split()) for e, n in zip(ends.tolist(), meta[:, 3].tolist())]
    del joined
    rows = list(zip(answers["slice"].to_pylist(), answers["keys"].to_pylist(), answers["counts"].to_pylist()))
    keys, lp = _lookup([(k, v) for s, k, v in rows if s < slices], np.float32)
    score = np.zeros(len(plain))
    for owners, chunks in _chunks(plain):
        key, starts = _keys(chunks)
        one, which = np.unique(key, return_inverse=True)
        each = lp[np.searchsorted(keys, one)].astype(np.float64)[which]
        np.add.at(score, owners, np.add.reduceat(each, starts))
    keys, counts = _lookup([(k, v) for s, k, v in rows if s >= slices], np.int64)
    words = {END}
    for text in plain:
        words.update(text.split())
    words = list(words)
    count = dict(zip(words, counts[np.searchsorted(keys, _hashed(words))].tolist()))
    n_tokens, n_known, base = [], [], []
    for text in plain:
        tokens = [*text.split(), END]
        c = np.fromiter(map(count.__getitem__, tokens), np.int64, len(tokens))
        n_tokens.append(len(c))
        n_known.append(int((c > 0).sum()))
        base.append(float(np.log10((c + 0.5) / (total + 0.5 * (distinct + 1))).sum()))
    ids = pa.array(meta[:, 0], mask=meta[:, 1].astype(bool))
    return pa.table([ids, pa.array(meta[:, 2].astype(bool)), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def score_documents(docs: DataFrame, folds: int = 5, fold: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row a row of docs; other columns aren't read.

    held_out: crc32(doc_id as text) mod folds is fold (null ids are learned from); the others train both models. Tokens
    are lower-cased (A-Z) words and one end of text. base_score is the unigram model with 0.5 added to every count; score
    is the PPM code length of the text, each word spelled out with a space and the end as a line feed, turned into log10
    probability. Contexts are the up to ORDER bytes before in the running text, over the ends of words; a text begins
    behind line feeds. Every context that occurs in a text learned from is in the trie.

    A byte's probability depends on it and its context alone, so texts are read in blocks of about BLOCK bytes, each of
    which gives its distinct (context, byte) keys with their counts, packed as one row for each slice of the trie. A slice
    has all contexts that end in the same two bytes, so all but the two lowest levels are computed within it; those two,
    at most 2^16 + 2^8 keys, and the sums of the escapes' classes are added up on the driver and broadcast. Slices then
    answer each block's keys, and a block's texts meet its answers. No task holds more than a slice or a block (a text
    longer than BLOCK is a block). Words go the same way by their 64-bit hashes, which the base takes as the words.

    A null text is empty: its only token is the end. Without a document to learn from, counts are 0 and all bytes equally
    likely. Rows with the same id and text get the same scores. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = int(SLICES * max(1, np.ceil(np.sqrt(size / SLICED))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", folds) == fold).alias("held_out"), text_bytes().alias("text"))
    ledger = cut(rows.mapInArrow(_ledger(slices), _LEDGER), "ledger")
    dealt = ledger.where("slice >= 0")
    by_slice = lambda df, *then: df.repartition(partitions(spark), "slice").sortWithinPartitions("slice", *then)
    gathered = cut(by_slice(dealt.select("slice", "keys", "counts")).mapInArrow(_gathered(slices), "slice int, keys binary, counts binary, stats binary"), "gathered")
    low, sums, total, distinct = _model([tuple(r) for r in gathered.select("slice", "stats").collect()], slices)
    shared = spark.sparkContext.broadcast((low, sums))
    asked = dealt.select("slice", "block", "keys", F.lit(None).cast("binary").alias("counts"))
    asked = asked.unionByName(gathered.select("slice", F.lit(None).cast("long").alias("block"), "keys", "counts"))
    answers = by_slice(asked, F.col("block").asc_nulls_first()).select("slice", "block", "keys", "counts").mapInArrow(_answers(slices, shared), _LEDGER)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    texts = ledger.where("slice < 0").select("block", "keys", "counts")
    scored = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda d, a: _score(d, a, slices, total, distinct), schema)
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))


def op9(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
