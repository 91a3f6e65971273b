"""Substring dedup with a log-structured index of window fingerprints."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, cut, mix, partitions, seeds, shared_dir, text_bytes

WINDOW = 35
#: Words of a gram; a window is filed under the smallest hash of its grams, so equal windows are filed alike.
GRAM = 4
#: The whole-table query feeds its documents to the index in so many batches.
BATCHES = 2
REMEMBERED = 300_000

_BASE, _BASE_GRAM = (int(x) for x in seeds(2, 101))
_BACK = pow(_BASE, -1, 1 << 64)


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def _power(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(12, n.bit_length()))[:n]


class Words:
    """64-bit hashes of words, of which the latest are remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class Windows:
    """The windows of one document: under what each is filed (fp), its own hash, and the runs of windows filed together."""

    def __init__(self, words: np.ndarray, window: int = WINDOW):
        n = len(words) - window + 1
        self.n = max(0, n)
        if n <= 0:
            return
        grams = np.zeros(len(words) - GRAM + 1, np.uint64)
        for j in range(GRAM):
            grams = grams * U64(_BASE_GRAM) + words[j : len(words) - GRAM + 1 + j]
        low, width = mix(grams), 1
        while 2 * width <= window - GRAM + 1:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = window - GRAM + 1 - width
        self.fp = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * _power(_BASE, len(words)), out=self.sums[1:])
        self.window = window

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of the words [start, stop) of each interval."""
        back = _power(_BACK, int(start.max(initial=0)) + 1)
        return mix((self.sums[stop] - self.sums[start]) * back[start] + (stop - start).astype(np.uint64) * U64(0x9E3779B97F4A7C15))

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last window of each run of windows with the same fp."""
        turn = np.flatnonzero(self.fp[1:] != self.fp[:-1])
        return np.r_[0, turn + 1], np.r_[turn, self.n - 1]

    def each(self) -> np.ndarray:
        """The hash of each window."""
        at = np.arange(self.n)
        return self.hashes(at, at + self.window)

    def repeated_here(self) -> np.ndarray:
        """Whether each window's words start elsewhere in the document too."""
        own = self.each()
        inorder = np.sort(own)
        twice = inorder[1:][inorder[1:] == inorder[:-1]]
        return np.isin(own, twice) if len(twice) else np.zeros(self.n, bool)


def _runs(batches: Iterator[pa.RecordBatch], windows: bool) -> Iterator[pa.RecordBatch]:
    hashed = Words()
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part, out, inside = batch.slice(lo, 500), ([], [], [], []), []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                w = Windows(hashed(text.split()))
                if w.n:
                    first, last = w.runs()
                    for into, x in zip(out, (w.fp[first], w.hashes(first, last + WINDOW), np.full(len(first), key), (first << 32) | last)):
                        into.append(x)
                    if windows:
                        own = w.each()
                        inside += [own[f : t + 1].tobytes() for f, t in zip(first, last)]
            if out[0]:
                columns = [pa.array(np.concatenate(x).view(np.int64)) for x in out]
                names = ["fp", "run", "key", "span"]
                if windows:
                    columns, names = [*columns, pa.array(inside, pa.binary())], [*names, "windows"]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def keyed(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, key, doc_id, text): rows with the same id and text share a key; their results are alike."""
    key = F.xxhash64("doc_id", "text")
    return docs.select(F.pmod(key, F.lit(buckets)).cast("int").alias("bucket"), key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))


def run_fingerprints(keyed_docs: DataFrame, windows: bool = True) -> DataFrame:
    """(fp, run, key, span, windows): for each run of windows filed under the same fp, the hash of all its words, its first and last window, and the hashes of its windows, eight bytes each."""
    schema = "fp long, run long, key long, span long" + (", windows binary" if windows else "")
    return keyed_docs.select("key", "text").mapInArrow(lambda batches: _runs(batches, windows), schema)


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            own = [np.frombuffer(x, np.int64) for x in part.column(2).to_pylist()]
            times = [len(x) for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(i).to_numpy(), times)) for i in (0, 1)] + [pa.array(np.concatenate(own))], names=["fp", "n", "hash"])


class FingerprintIndex:
    """A log of immutable runs, each sorted by fingerprint: rows (fp, run, n, windows), how often a run of windows has been seen and the hashes of its windows.

    append() writes one more sorted run of the log, unless a batch of that name is in it already, so that a batch that is
    tried again changes nothing; compact() merges all runs into one; probe() and others() join a batch with the log by
    fingerprint, as sort-merge joins. fp, run and the windows' hashes are independent 64-bit hashes, the first of four
    words, the second of all words of the run; two must agree (that is the verification; texts aren't kept).

    With a path the index stays: what has been written is listed in a folder state-N of its own, written after the run it
    names, and an index that is opened on the path goes on from the last whole one. One writer at a time; runs never change,
    so readers of an older state stay right. With windows=False the log leaves out the windows, for use within one call.
    """

    SCHEMA = "fp long, run long, n long, windows binary"

    def __init__(self, spark: SparkSession, path: str | None = None, windows: bool = True):
        self.spark, self.windows, self.stays = spark, windows, path is not None
        self.path = path or f"{shared_dir(spark)}/edgewise/index-{uuid.uuid4().hex}"
        self.levels: list[str] = []
        self.batches: set[str] = set()
        self.state = -1
        if self.stays and (states := self._states()):
            self.state = states[-1]
            for kind, name in spark.read.schema("kind string, name string").parquet(f"{self.path}/state-{self.state:010d}").collect():
                if kind == "batch":
                    self.batches.add(name)
                else:
                    self.levels.append(f"{self.path}/{name}")

    def _states(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        at = path(self.path)
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
        return sorted(int(n[6:]) for n in names if n.startswith("state-") and files.exists(path(at, f"{n}/_SUCCESS")))

    def _save(self, levels: list[str], batches: set[str]) -> None:
        if self.stays:
            rows = [("batch", b) for b in sorted(batches)] + [("run", x.rsplit("/", 1)[1]) for x in levels]
            self.spark.createDataFrame(rows, "kind string, name string").coalesce(1).write.parquet(f"{self.path}/state-{self.state + 1:010d}")
            self.state += 1
        self.levels, self.batches = levels, batches

    def _write(self, counts: DataFrame) -> str:
        to = f"{self.path}/run-{uuid.uuid4().hex}"
        counts.sortWithinPartitions("fp", "run").write.parquet(to)
        return to

    def _counted(self, rows: DataFrame, n) -> DataFrame:
        return rows.groupBy("fp", "run").agg(n.alias("n"), *([F.first("windows").alias("windows")] if self.windows else []))

    def append(self, found: DataFrame, batch: str | None = None) -> None:
        """found: rows with fp and run, and windows unless the index leaves them out. A batch whose name is known isn't added again; without a name each is a new one."""
        batch = batch or uuid.uuid4().hex
        if batch not in self.batches:
            self._save([*self.levels, self._write(self._counted(found, F.count("*")))], self.batches | {batch})

    def _rows(self) -> DataFrame:
        """(fp, run, n, windows); a run may come once a level."""
        schema = self.SCHEMA if self.windows else "fp long, run long, n long"
        return self.spark.read.schema(schema).parquet(*self.levels) if self.levels else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """(fp, run, n)"""
        return self._rows().select("fp", "run", "n")

    def compact(self) -> None:
        if len(self.levels) > 1:
            self._save([self._write(self._counted(self._rows(), F.sum("n")))], self.batches)

    def _runs(self) -> DataFrame:
        return self.read().groupBy("fp", "run").agg(F.sum("n").alias("n")) if len(self.levels) > 1 else self.read()

    def probe(self, found: DataFrame) -> DataFrame:
        """found with n (times its run is in the log) and kinds (different runs in the log under its fp); only rows with n or kinds over 1."""
        log = self._runs()
        kinds = cut(log.groupBy("fp").agg(F.count("*").alias("kinds"), F.max("n").alias("most")).where("kinds > 1 or most > 1"), "kinds")
        known = cut(log.join(kinds, "fp").select("fp", "run", "n", "kinds"), "known")
        return found.join(known, ["fp", "run"])

    def others(self, found: DataFrame) -> DataFrame:
        """(fp, n, hash): the windows of the runs of the log that aren't in found but filed under an fp of it, with the times of their run."""
        own = found.select("fp", "run").distinct()
        rows = self._rows().join(own.select("fp").distinct(), "fp", "left_semi").join(own, ["fp", "run"], "left_anti")
        return self._counted(rows, F.sum("n")).select("fp", "n", "windows").mapInArrow(_explode, "fp long, n long, hash long")


def _windows(buckets_docs: pa.Table, asked: pa.Table) -> pa.Table:
    """The windows, one by one, of the runs asked for."""
    hashed, out = Words(), ([], [], [], [], [])
    wanted = _by_key(asked, ("fp", "span", "n"))
    for key, text in _distinct(buckets_docs, wanted):
        w = Windows(hashed(text.split()))
        for fp, span, n in zip(*wanted[key]):
            at = np.arange(span >> 32, (span & 0xFFFFFFFF) + 1)
            for into, x in zip(out, (np.full(len(at), fp), w.hashes(at, at + WINDOW).view(np.int64), np.full(len(at), key), at, np.full(len(at), n))):
                into.append(x)
    joined = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out]
    return pa.table(dict(zip(("fp", "hash", "key", "at", "n"), joined)))


def _by_key(table: pa.Table, names: tuple[str, ...]) -> dict[int, list[np.ndarray]]:
    keys = table["key"].to_numpy()
    order = np.argsort(keys, kind="stable")
    own, start = np.unique(keys[order], return_index=True)
    columns = [np.split(table[n].to_numpy()[order], start[1:]) for n in names]
    return {int(k): [c[i] for c in columns] for i, k in enumerate(own)}


def _distinct(docs: pa.Table, wanted: dict) -> Iterator[tuple[int, bytes]]:
    done = set()
    keys = docs["key"].to_pylist()
    texts = docs["text"]
    for i, key in enumerate(keys):
        if key in wanted and key not in done:
            done.add(key)
            yield key, texts[i].as_py()


def _strip(docs: pa.Table, spans: pa.Table) -> pa.Table:
    """Each document without the words that the given windows, and those repeated within it, cover."""
    hashed, out = Words(), ([], [], [], [], [])
    gone = _by_key(spans, ("span",))
    for key, doc_id, text in zip(docs["key"].to_pylist(), docs["doc_id"].to_pylist(), docs["text"].to_pylist()):
        words = text.split()
        kept = words
        w = Windows(hashed(words))
        if w.n:
            again = w.repeated_here()
            steps = np.zeros(len(words) + 1, np.int64)
            at = np.flatnonzero(again)
            np.add.at(steps, at, 1)
            np.add.at(steps, at + WINDOW, -1)
            if key in gone:
                span = gone[key][0]
                np.add.at(steps, span >> 32, 1)
                np.add.at(steps, (span & 0xFFFFFFFF) + WINDOW, -1)
            stay = np.cumsum(steps[:-1]) == 0
            if not stay.all():
                kept = [words[i] for i in np.flatnonzero(stay)]
        text = b" ".join(kept)
        for into, x in zip(out, (doc_id, len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text)):
            into.append(x)
    return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, index: FingerprintIndex | None = None, batches: int = BATCHES, with_text: bool = False, batch: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), and kept with with_text; one row a row of docs.

    A window is WINDOW consecutive words; each word goes that a window covers whose words also start elsewhere in docs
    (same document included) or in what `index` held before. docs are added to the index in `batches` parts, and the index
    is compacted. `batch` names docs in the index: a batch that it holds already isn't added again, and the answer to it
    stays that of the first time, but for what others have added since. Without a name the rows' ids and texts make it, so a job that is tried again
    removes nothing more; rows that come again and are to go need a name of their own.

    Of each document only the runs of windows that share their smallest gram are shuffled, about one for sixteen words:
    equal windows lie in runs with the same fp. Equal runs are repeated as a whole. Where an fp has different runs, their windows
    are compared one by one, those of earlier batches from the log; of equal runs one takes part, so a passage that thousands share costs one.

    Null texts are empty; a text under WINDOW words loses nothing; rows with the same id and text lose the same words
    (all, if long enough, as each repeats the other). An empty table gives an empty table.
    """
    spark = docs.sparkSession
    buckets = 2 * partitions(spark)
    keys = keyed(docs, buckets)
    if index is None:
        own, batch = FingerprintIndex(spark, windows=False), "docs"
    else:
        own = index
        if batch is None:
            n, total = keys.agg(F.count("*"), F.sum(F.col("key").cast("decimal(38,0)"))).first()
            batch = f"{n}:{total}"
    found = cut(run_fingerprints(keys, own.windows), "runs")
    for b in range(batches):
        own.append(found.where(F.pmod(F.shiftright("key", 20), F.lit(batches)) == b), f"{batch}/{b}/{batches}")
    own.compact()
    found = found.select("fp", "run", "key", "span")
    hits = cut(own.probe(found), "hits")
    bucket = F.pmod("key", F.lit(buckets)).cast("int").alias("bucket")
    whole = hits.where("n > 1").select("key", "span")
    mixed = hits.where("kinds > 1")
    one_of_each = mixed.where("n > 1").groupBy("fp", "run").agg(F.min(F.struct("key", "span")).alias("x"), F.first("n").alias("n")).select("fp", "x.*", "n")
    asked = mixed.where("n = 1").select("fp", "key", "span", "n").unionByName(one_of_each)
    singles = (
        keys.groupBy("bucket")
        .cogroup(asked.select(bucket, "fp", "key", "span", "n").groupBy("bucket"))
        .applyInArrow(lambda d, a: _windows(d, a), "fp long, hash long, key long, at long, n long")
    )
    singles = cut(singles, "windows")
    seen = singles.select("fp", "hash", "n")
    if own.windows:
        seen = seen.unionByName(own.others(mixed))
    often = cut(seen.groupBy("fp", "hash").agg(F.sum("n").alias("times")).where("times > 1").select("fp", "hash"), "often")
    here = singles.where("n = 1").join(often, ["fp", "hash"]).select("key", (F.shiftleft("at", 32) + F.col("at")).alias("span"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"
    out = keys.groupBy("bucket").cogroup(whole.unionByName(here).select(bucket, "key", "span").groupBy("bucket")).applyInArrow(lambda d, s: _strip(d, s), schema)
    out = out.withColumn("kept", F.col("kept").cast("string"))
    return out if with_text else out.drop("kept")


def op6(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
