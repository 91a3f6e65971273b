"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64
#: Spark removes the shuffle files of a query when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Edges of a partition, at least, where their components are looked for.
EDGES = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset in local mode, as in tests, a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="edgewise-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it again: later steps neither compute it twice nor lose it with an executor. The shuffle files that it took go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/edgewise/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(n: int, start: int = 1) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix(np.arange(start, start + n, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))


def row_key(columns: list[str]):
    """A key of the row: rows have the same if and only if they agree in these columns."""
    return F.md5(F.to_json(F.struct(*columns)).cast("binary"))


def text_bytes(column: str = "text"):
    """The text as UTF-8 bytes, so that Arrow hands it to Python without decoding; null is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def local_forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n nodes and links a[i]-b[i] between them, the smallest node that each node reaches."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        label = new[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node that node reaches over edges (u, v), both long.

    Alternating large-star and small-star steps, each an aggregation and a join on the node. Nodes without an edge to
    another node aren't returned; null ends are no edges. Each round is written to the shared folder, so an executor
    that is lost costs one round. Raises if rounds don't suffice. Partitions follow the number of edges: a few edges dealt
    over all shuffle partitions would cost each round thousands of small files.
    """
    pairs = edges.where("u is not null and v is not null and u != v").select("u", "v")
    now = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, now.count() // EDGES)
    was = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The minima are written before they are joined: both sides of each join are then dealt out for it, and Spark can split a node with very many edges.
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts), "low")
        large = both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.coalesce(parts).distinct().coalesce(parts), "large")
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts), "low")
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).coalesce(parts).distinct().coalesce(parts), "edges")
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == was:
            break
        was = state
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    # Every edge now leads from a node to its component's smallest node.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
