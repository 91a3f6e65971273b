"""Quality classifier: Bradley-Terry scores of documents, learned from preference pairs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, row_key, text_bytes

#: Documents of each quality that meet in a slot, on average.
PAIRS = 8
#: Slots of a document are listed in arrays of so many, as there are very many where one quality is rare.
SLOTS_AT_ONCE = 4096
#: Scores are counted in so many bins at a time to find the one at a rank.
BINS = 1024
SYMBOLS = b"!|%&*$#"
SENTENCE_END = b".,;:?"
FEATURES = 20


def features(text: bytes) -> list[float]:
    """Surface statistics of a UTF-8 text, each bounded: shares of its words, letters, symbols and repetitions. Over the whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (FEATURES - 1) + [1.0]
    length = len(text)
    counts = Counter(words)
    out = [min(1.0, 4 * text.count(bytes([c])) / n) ** 0.5 for c in SYMBOLS]
    letters = length - len(text.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    upper = length - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = length - len(text.translate(None, b"0123456789"))
    ends = length - len(text.translate(None, SENTENCE_END))
    symbols = length - len(text.translate(None, SYMBOLS))
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = text.split(b"\n")
    out += [
        min(1.0, upper / max(1, letters)),
        float(upper > 0.3 * letters),
        min(1.0, 10 * digits / length),
        min(1.0, ends / n),
        min(1.0, symbols / n),
        same / n,
        float(same > 0.2 * n),
        len(counts) / n,
        max(counts.values()) / n,
        1 - len(set(lines)) / len(lines),
        min(1.0, length / n / 20),
        min(1.0, np.log1p(n) / 10),
        0.0,
    ]
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), found, *batch.columns[2:]], names=["doc_id", "features", *batch.schema.names[2:]])


def featurize(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(doc_id, features), and the text column key if there is one; one row a row of docs; a null text is empty."""
    more = [key] if key else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), *more).mapInArrow(_features, "doc_id long, features array<double>" + "".join(f", {c} string" for c in more))


def at_rank(scores: DataFrame, rank: int) -> float:
    """The value of the column s at a rank (from 0), exactly. Values are counted in bins, then those of the bin that holds the rank, until it holds one value; a count a bin comes to the driver."""
    low, high = scores.agg(F.min("s"), F.max("s")).first()
    while low < high:
        bin_ = F.least(F.floor((F.col("s") - low) / (high - low) * BINS), F.lit(BINS - 1)).alias("bin")
        for _, n, least, most in sorted(scores.where(F.col("s").between(low, high)).groupBy(bin_).agg(F.count("*"), F.min("s"), F.max("s")).collect()):
            if rank < n:
                low, high = least, most
                break
            rank -= n
    return low


def learn(rows: DataFrame, pairs: int = PAIRS) -> tuple[list[float], float]:
    """Weights and threshold from all rows (doc_id, features, quality).

    A pair is a document of quality 1 and one of quality 0; the model says that the first wins with probability
    sigmoid(w * (x1 - x0)), and w minimises the logistic loss over the pairs. Each document goes to hashed slots, and
    pairs are those that meet in a slot, so each document meets few and pairs grow with the rows. The threshold is the
    score quantile at the share of quality 0. Without labels of both kinds: weights 0 and threshold 0 (every score 0.5).
    """
    rows = cut(rows.where("quality in (0, 1)"), "labelled")
    n = {r[0]: r[1] for r in rows.groupBy("quality").count().collect()}
    if len(n) < 2:
        return [0.0] * FEATURES, 0.0
    few, lot = sorted((n[0], n[1]))
    slots = max(1, lot // 2)
    each = {q: max(1, pairs * lot // (n[q] * 2)) if n[q] == few else pairs // 2 for q in n}

    def side(q: int) -> DataFrame:
        mine = rows.where(F.col("quality") == q).select(F.col("doc_id").alias(f"id{q}"), F.col("features").alias(f"x{q}"), F.explode(F.sequence(F.lit(1), F.lit(each[q]), F.lit(SLOTS_AT_ONCE))).alias("at"))
        turns = F.sequence("at", F.least(F.col("at") + SLOTS_AT_ONCE - 1, F.lit(each[q])))
        return mine.select(f"id{q}", f"x{q}", F.explode(F.transform(turns, lambda i: F.pmod(F.xxhash64(f"id{q}", i, F.lit(q)), F.lit(slots)))).alias("slot"))

    # Without an intercept a pair costs the same as (x1 - x0, won) and as (x0 - x1, lost); a coin says which.
    met = side(1).join(side(0), "slot").withColumn("won", F.pmod(F.xxhash64("id1", "id0", "slot"), F.lit(2)))
    both = met.select(array_to_vector(F.zip_with("x1", "x0", lambda a, b: F.when(F.col("won") == 1, a - b).otherwise(b - a))).alias("d"), F.col("won").cast("double").alias("y"))
    model = LogisticRegression(featuresCol="d", labelCol="y", fitIntercept=False, regParam=1e-4, maxIter=50).fit(both)
    weights = [float(w) for w in model.coefficients]
    scored = cut(rows.select(strength(weights).alias("s")), "strengths")
    last = n[0] + n[1] - 1
    share = n[0] / (n[0] + n[1])
    low, high = (at_rank(scored, round(last * min(1.0, max(0.0, share + d)))) for d in (-0.01, 0.01))
    return weights, (low + high) / 2


def strength(weights: list[float]):
    """The Bradley-Terry score of a features column."""
    return sum((F.lit(w) * F.col("features")[i] for i, w in enumerate(weights)), F.lit(0.0))


def score(features: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) of rows (doc_id, features); further columns are passed on. labels: (doc_id, quality); only rows that aren't held out are learned from.

    held_out: crc32(doc_id as text) mod 3 is 1; a null doc_id isn't held out and has no label. A label that contradicts
    another of the same doc_id stays, as one more row. Labels never enter a score, and neither do ids, languages or sources.
    """
    held = crc_mod("doc_id", 3) == 1
    known = labels.select("doc_id", "quality").where(~held)
    weights, threshold = learn(features.join(known, "doc_id"), **how)
    chance = 1 / (1 + F.exp(-(strength(weights) - F.lit(threshold))))
    return features.select("doc_id", *[c for c in features.columns if c not in ("doc_id", "features")], held.alias("held_out"), chance.alias("score")).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def drop_low_quality(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs without those whose score is under 0.5. Columns and repeated rows stay. A score counts for its id and text, not for others with that id."""
    keyed = docs.withColumn("_row", row_key(["doc_id", "text"]))
    bad = score(cut(featurize(keyed, "_row"), "features"), labels, **how).where("predicted = 0").select("_row").distinct()
    return keyed.join(bad, "_row", "left_anti").select(docs.columns)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score(cut(featurize(docs), "features"), labels)
