"""Mixing sources to target weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: So many hash seeds are tried for each source; the one whose copies come nearest to the target is taken.
TRIALS = 32


def coin(key: Column, trial: Column | int) -> Column:
    """A number in [0, 1) from the hash of a document's key and a seed; SQL engines that have md5 get the same."""
    trial = F.lit(trial) if isinstance(trial, int) else trial
    digest = F.md5(F.concat(trial.cast("string"), F.lit(":"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """Target of each source. sizes: (source, words), one row a source. Targets stop at cap times the source's size; what is over is shared again by weight among the others."""
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    size = dict(order)
    out: dict[str | None, float] = {}
    left, free = share * sum(size.values()), dict(weight)
    while free:
        total = sum(free.values())
        full = [s for s, w in free.items() if left * w / total > cap * size[s]]
        if not full:
            out |= {s: left * w / total for s, w in free.items()}
            break
        for s in full:
            out[s] = cap * size[s]
            del free[s]
        left = max(0.0, left - sum(cap * size[s] for s in full))
    return out


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, trials: int = TRIALS) -> DataFrame:
    """docs with size, source_size, target and copies (columns of these names are replaced).

    A document of a source with repetition rate r = target / source_size is taken floor(r) times, and once more if a
    coin made from the hash of its doc_id (where that is null: of its text) and a seed falls below the fraction of r.
    Each source uses, of `trials` seeds, the one whose words come nearest to the target (the first of equals): all coins
    are known after one aggregation, so this costs no second pass. Reruns agree, as nothing depends on the order of rows.

    Null text: size 0. Null source: a source of its own, the last. A source without words: target 0, rate 0. Rows with
    the same doc_id share a coin. An empty table gives an empty table. The number of sources, not of rows, bounds what
    is collected and broadcast: one row a source.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    sized = docs.drop("size", "source_size", "target", "copies").withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    by = {r[0]: r[1] for r in sized.groupBy("source").agg(F.sum("size")).collect()}
    if not by:
        return sized.select("*", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("copies"))
    aim = targets(list(by.items()), weights, share, cap)
    rate = {s: aim[s] / n if n else 0.0 for s, n in by.items()}
    fraction = {s: r - int(r) for s, r in rate.items()}
    spark = docs.sparkSession
    chances = spark.createDataFrame([(s, float(f)) for s, f in fraction.items()], "source string, fraction double")
    drawn = (
        sized.where("size > 0")
        .select(F.col("source").alias("_s"), "size", key.alias("key"))
        .join(F.broadcast(chances), F.col("_s").eqNullSafe(F.col("source")))
        .groupBy("_s")
        .agg(*[F.sum(F.when(coin(F.col("key"), t) < F.col("fraction"), F.col("size")).otherwise(0)).alias(f"t{t}") for t in range(trials)])
        .collect()
    )
    seed = {s: 0 for s in by}
    for r in drawn:
        wanted = aim[r[0]] - int(rate[r[0]]) * by[r[0]]
        seed[r[0]] = min(range(trials), key=lambda t: (abs(r[1 + t] - wanted), t))
    plans = spark.createDataFrame(
        [(s, int(by[s]), float(aim[s]), int(rate[s]), float(fraction[s]), seed[s]) for s in by],
        "_s string, source_size long, target double, whole int, fraction double, seed int",
    )
    return sized.join(F.broadcast(plans), F.col("source").eqNullSafe(F.col("_s"))).select(
        *[sized[c] for c in sized.columns],
        "source_size",
        "target",
        (F.col("whole") + F.when(coin(key, F.col("seed")) < F.col("fraction"), 1).otherwise(0)).cast("long").alias("copies"),
    )


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """docs with each document as often as plan() takes it, in the columns of docs."""
    planned = plan(docs.withColumn("_row", F.struct(*docs.columns)), **how).where("copies > 0")
    return planned.select(F.explode(F.array_repeat("_row", F.col("copies").cast("int"))).alias("_row")).select("_row.*")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _op3_sql() -> str:
    """The same in DuckDB SQL. The capped shares come to a fixed point within as many rounds as there are sources; each round of the recursion fixes the sources over their cap."""
    sums = ", ".join(f"sum(CASE WHEN coin{t} < fraction THEN size ELSE 0 END) AS t{t}" for t in range(TRIALS))
    coins = ", ".join(f"{_coin_sql(f"'{t}'")} AS coin{t}" for t in range(TRIALS))
    best = "least(" + ", ".join(f"abs(t{t} - wanted)" for t in range(TRIALS)) + ")"
    pick = reduce(lambda rest, t: f"CASE WHEN abs(t{t} - wanted) = {best} THEN {t} ELSE {rest} END", reversed(range(TRIALS)), "0")
    return f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, ''))) AS key
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1) % 3 + 1)::BIGINT] AS w,
         sum(source_size) OVER () AS everything
  FROM totals),
rounds AS (
  SELECT 0 AS k, source, source_size, w, NULL::DOUBLE AS fixed, 1.5::DOUBLE * everything AS room, sum(w) OVER () AS weight, true AS more FROM ranked
  UNION ALL
  SELECT k + 1, source, source_size, w, f, greatest(0.0::DOUBLE, room - coalesce(sum(CASE WHEN fixed IS NULL THEN f END) OVER (), 0)),
         sum(CASE WHEN f IS NULL THEN w END) OVER (), count(CASE WHEN fixed IS NULL AND f IS NOT NULL THEN 1 END) OVER () > 0
  FROM (SELECT *, CASE WHEN fixed IS NOT NULL THEN fixed WHEN room * w / weight > 2.0::DOUBLE * source_size THEN 2.0::DOUBLE * source_size END AS f FROM rounds)
  WHERE more),
aims AS (SELECT source, source_size, coalesce(fixed, room * w / weight) AS target FROM rounds WHERE k = (SELECT max(k) FROM rounds)),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM aims),
plans AS (SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS fraction FROM rates),
coins AS (SELECT s.source, s.size, p.fraction, {coins} FROM sized s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source WHERE s.size > 0),
drawn AS (SELECT source, {sums} FROM coins GROUP BY source),
chosen AS (
  SELECT source, {pick} AS seed
  FROM (SELECT d.*, p.target - p.whole * p.source_size AS wanted FROM drawn d JOIN plans p ON d.source IS NOT DISTINCT FROM p.source))
SELECT s.doc_id, s.size, p.source_size, p.target,
       (s.size * (p.whole + CASE WHEN {_coin_sql("coalesce(c.seed, 0)::VARCHAR", "s.key")} < p.fraction THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN chosen c ON s.source IS NOT DISTINCT FROM c.source
"""


def _coin_sql(trial: str, key: str = "s.key") -> str:
    return f"('0x' || substr(md5({trial} || ':' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


OP3_SQL = _op3_sql()
