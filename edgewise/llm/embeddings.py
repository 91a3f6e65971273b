"""Embedding near-dedup by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, local_forest, partitions

COSINE = 0.93
#: Leading principal dimensions of the grid.
GRID = 4
#: Vectors of a block of the order, and of an interval that is compared at once.
BLOCK, LEAF = 1024, 128
#: The widest covariance that is summed for the principal dimensions; wider vectors use their first coordinates.
WIDEST = 2048
_SLACK = 1e-6


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the unit vectors' products, one vector length at a time."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        wide = np.array(batch.column(1).to_pylist())
        for d in np.unique(wide):
            x = _unit(batch.column(0).filter(pa.array(wide == d)))
            sums[int(d)] = sums.get(int(d), 0) + x.T @ x
    for d, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(s.tolist(), pa.list_(pa.float64()))], names=["width", "i", "row"])


def principal(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors, the GRID leading principal directions, from sums over all of them. Any orthonormal directions give the same result; these prune best."""
    made = vectors.where(F.col("width") <= WIDEST).select("embedding", "width").mapInArrow(_moments, "width int, i int, row array<double>")
    d = F.col("row")
    by = made.select("width", "i", F.posexplode(d).alias("j", "x")).groupBy("width", "i", "j").agg(F.sum("x").alias("x"))
    out: dict[int, np.ndarray] = {}
    for r in by.collect():
        out.setdefault(r["width"], np.zeros((r["width"], r["width"])))[r["i"], r["j"]] = r["x"]
    return {w: np.linalg.eigh(m)[1][:, ::-1][:, :GRID] for w, m in out.items()}


def _compare(a: pa.Table, b: pa.Table, eps: float, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the linked pairs of two sorted sequences of one group, by recursion over their intervals."""
    ax, bx = _unit(a["embedding"]), _unit(b["embedding"])
    ag, bg = (np.array(t["grid"].to_pylist()) for t in (a, b))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(0, len(ax), 0, len(bx))]
    while todo:
        i, j, k, m = todo.pop()
        if same and k >= j:
            continue
        gap = np.maximum(0, np.maximum(ag[i:j].min(0) - bg[k:m].max(0), bg[k:m].min(0) - ag[i:j].max(0)))
        if (gap * gap).sum() > eps * eps:
            continue
        if j - i <= LEAF and m - k <= LEAF:
            p, q = np.nonzero(ax[i:j] @ bx[k:m].T >= cosine)
            p, q = p + i, q + k
            if same:
                p, q = p[p > q], q[p > q]
            found.append((p, q))
            continue
        halves = lambda lo, hi: [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)] if hi - lo > LEAF else [(lo, hi)]
        todo += [(*x, *y) for x in halves(i, j) for y in halves(k, m)]
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    p, q = (np.concatenate(x) for x in zip(*found))
    return p, q


def _join(table: pa.Table, eps: float, cosine: float) -> pa.Table:
    """All rows dealt to one pair of blocks: (u, v, n) with v null gives n links to u, else an edge of a forest."""
    blocks = np.array(table["block"].to_pylist())
    left, right = table["left"][0].as_py(), table["right"][0].as_py()
    a = table.filter(pa.array(blocks == left)).sort_by("at")
    b = a if left == right else table.filter(pa.array(blocks == right)).sort_by("at")
    p, q = _compare(a, b, eps, cosine, left == right)
    aid, bid = a["rep"].to_numpy(), b["rep"].to_numpy()
    an, bn = a["copies"].to_numpy(), b["copies"].to_numpy()
    ids, at = np.unique(np.r_[aid, bid], return_inverse=True)
    pa_, qb = at[: len(aid)][p], at[len(aid) :][q]
    links = np.bincount(pa_, bn[q], minlength=len(ids)) + np.bincount(qb, an[p], minlength=len(ids))
    label = local_forest(pa_, qb, len(ids))
    some, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(ids)))
    return pa.table(
        {
            "u": np.r_[ids[some], ids[moved]],
            "v": pa.array([None] * len(some) + ids[label[moved]].tolist(), pa.int64()),
            "n": np.r_[links[some], np.zeros(len(moved))].astype(np.int64),
        }
    )


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row a row of vectors (vec_id, embedding, label).

    Two vectors are linked if their labels are equal and not null, their lengths are equal, and their cosine in double
    precision is at least `cosine`. Vectors that are null, empty, zero, or hold null or non-finite components, and rows
    with a null vec_id, link with nothing: n_links 0, component_id their own id, kept true (null for a null id).
    Repeated rows are vectors of their own; ids are expected to be distinct (rows that share one share a node).

    Equal vectors of a label are compared once. Unit vectors within the cosine are within eps of each other, so also
    within eps on any orthonormal directions. Vectors are put in epsilon grid order (label, length, then cells of side
    eps on the leading principal dimensions), cut into blocks, and each pair of blocks whose bounds on those dimensions
    are within eps goes to a task, which joins the two sequences by recursion over their intervals and skips those that
    are provably too far apart. A task returns counts and a forest, never pairs.
    """
    spark = vectors.sparkSession
    eps = float(np.sqrt(2 - 2 * cosine)) + _SLACK
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0)
    good = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    nodes = good.where("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    nodes = cut(nodes.withColumn("width", F.size("embedding")), "vectors")
    axes = principal(nodes)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = np.array(batch.column(2).to_pylist())
            grid = np.zeros((batch.num_rows, GRID))
            for d in np.unique(width):
                x = _unit(batch.column(1).filter(pa.array(width == d)))
                on = x @ axes[int(d)] if int(d) in axes else x[:, :GRID]
                grid[width == d, : on.shape[1]] = on
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grid.tolist(), pa.list_(pa.float64()))], names=["rep", "grid"])

    # The grid is computed beside the vectors' ids, labels and lengths only; vectors themselves are joined to it by id.
    spots = nodes.select("rep", "embedding", "width").mapInArrow(placed, "rep long, grid array<double>").join(nodes.select("rep", "label", "width"), "rep")
    cells = [F.floor(F.col("grid")[i] / eps).alias(f"c{i}") for i in range(GRID)]
    order = ["label", "width", *(f"c{i}" for i in range(GRID)), "rep"]
    inorder = spots.select("rep", "label", "width", "grid", *cells).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    # A block is BLOCK rows that follow each other in a partition; blocks need not be equally full.
    numbered = cut(inorder.withColumn("at", F.monotonically_increasing_id()), "order")
    numbered = numbered.withColumn("block", F.concat_ws(":", F.floor(F.col("at") / BLOCK), "label", "width"))
    bounds = [f(F.col("grid")[i]).alias(f"{n}{i}") for i in range(GRID) for n, f in (("lo", F.min), ("hi", F.max))]
    blocks = cut(numbered.groupBy("block", "label", "width").agg(*bounds), "blocks")
    # Blocks meet in the cells of the first dimension that they reach, so no pair of distant blocks is looked at.
    reach = F.sequence(F.floor(F.col("lo0") / eps), F.floor(F.col("hi0") / eps) + 1)
    one = blocks.withColumn("cell", F.explode(reach))
    two = blocks.select(F.col("label"), F.col("width"), F.explode(reach).alias("cell"), *[F.col(c).alias(f"{c}_") for c in blocks.columns if c not in ("label", "width")])
    gap = sum((F.greatest(F.lit(0.0), F.col(f"lo{i}") - F.col(f"hi{i}_"), F.col(f"lo{i}_") - F.col(f"hi{i}")) ** 2 for i in range(GRID)), F.lit(0.0))
    met = one.join(two, ["label", "width", "cell"]).where((F.col("block") <= F.col("block_")) & (gap <= eps * eps))
    met = cut(met.select(F.col("block").alias("left"), F.col("block_").alias("right")).distinct(), "pairs")
    sides = met.select("left", "right", F.col("left").alias("block")).unionByName(met.where("left != right").select("left", "right", F.col("right").alias("block")))
    placed_vectors = numbered.select("rep", "grid", "at", "block").join(nodes.select("rep", "embedding", "copies"), "rep")
    dealt = placed_vectors.join(sides, "block")
    found = dealt.groupBy("left", "right").applyInArrow(lambda t: _join(t, eps, cosine), "u long, v long, n long")
    found = cut(found, "links")
    degree = found.where("v is null").groupBy("u").agg(F.sum("n").alias("links"))
    reached = components(found.where("v is not null").select("u", "v"))
    about = nodes.select("label", "embedding", "rep", "copies").join(degree.withColumnRenamed("u", "rep"), "rep", "left").join(reached.withColumnRenamed("node", "rep"), "rep", "left")
    about = cut(about.select("label", "embedding", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component")), "about")
    linked = good.where("sound").join(about, ["label", "embedding"]).select("vec_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("component").alias("component_id"))
    alone = good.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op4(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
