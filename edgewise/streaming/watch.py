"""The change feed, and checks of a stream of requests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.entities import entity_type, key_order
from ..operators.access import check_batch, list_resources
from ..plans.policy import Policy
from ..sources.store import COMMIT, KEY, LOG, TUPLE, Store


@dataclass
class Watch:
    """A stream of a vault's commits, and which of their changes are wanted."""

    stream: DataFrame
    path: str
    start: int
    types: list[str] | None

    def changes(self, commits: DataFrame) -> DataFrame:
        """The changes that a batch of commits points to, in the order of revision and key."""
        folders = [r[0] for r in commits.where(F.col("revision") >= self.start).select("folder").collect()]
        spark = commits.sparkSession
        out = spark.read.schema(LOG).parquet(*[f"{self.path}/changes/{f}" for f in folders]) if folders else spark.createDataFrame([], LOG)
        out = out.drop("vault")
        return (out.where(entity_type(F.col("resource")).isin(self.types)) if self.types else out).orderBy("revision", key_order())


def watch(spark: SparkSession, path: str, vault: int, start: int, types: list[str] | None = None, files: int | None = None) -> Watch:
    """The change feed from a revision on (inclusive). New commits are its source, so no change of a revision is left out and none without a commit is seen."""
    stream = spark.readStream.schema(COMMIT)
    if files:
        stream = stream.option("maxFilesPerTrigger", files)
    store = Store(spark, path)
    return Watch(stream.json(store.commits_path(vault)), store.path, start, types)


def rendered(changes: DataFrame) -> DataFrame:
    """Change events as JSON, with the time in RFC 3339."""
    time = F.date_format(F.timestamp_micros((F.col("timestamp_nanos") / 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return changes.select("revision", F.to_json(F.struct("operation", "resource", "relation", "subject", "revision", time.alias("timestamp"))).alias("event"))


def follow(feed: Watch, take: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Hands the changes of each batch, sorted by revision and key, to `take`; stops when all there is has been read, and goes on from the checkpoint next time."""
    return feed.stream.writeStream.foreachBatch(lambda df, _: take(feed.changes(df))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def evaluate(requests: DataFrame, policy: Policy, edges: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Decides a stream of requests against a pinned snapshot, as Parquet.

    Each batch has a folder of its own, which a batch that runs again overwrites, so no decision comes twice. summary()
    counts them. An error is a deny with its message.
    """
    write = lambda df, batch: check_batch(policy, edges, df).write.mode("overwrite").parquet(f"{out}/batch={batch}")
    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_deletes(requests: DataFrame, store: Store, vault: int, out: str, checkpoint: str, limit: int | None = None) -> StreamingQuery:
    """Deletes what a stream of filters (resource, relation, subject; null: any) matches, one revision a batch of the stream.

    Which tuples go is written before they are deleted, to a folder for each batch. A batch that runs again deletes what
    it wrote then, so it neither goes on to the next tuples under the limit nor deletes by a later snapshot.
    """

    def take(df: DataFrame, batch: int) -> None:
        folder = f"{out}/batch={batch}"
        if not store.written(folder):
            store.chosen(vault, df, limit).write.mode("overwrite").parquet(folder)
        store.delete_exact(vault, store.spark.read.schema(TUPLE).parquet(folder))

    return requests.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summary(spark: SparkSession, out: str) -> DataFrame:
    """(total, allowed, errors, complete) of what evaluate() wrote."""
    rows = spark.read.parquet(out)
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("decision") == "allow").alias("allowed"), F.count("error").alias("errors")).withColumn("complete", F.lit(True))


def stream_resources(policy: Policy, edges: DataFrame, subject: str, resource_type: str, permission: str):
    """Yields the resources of list_resources() one by one, a partition at a time on the driver, then their number."""
    n = 0
    for row in list_resources(policy, edges, subject, resource_type, permission).toLocalIterator():
        n += 1
        yield {"resource": row[0]}
    yield {"total": n, "complete": True}


def state(log: DataFrame) -> DataFrame:
    """(resource, relation, subject): what lives after all changes of a log; each tuple's last change decides. The batch form of keeping state by tuple."""
    last = log.groupBy(*KEY).agg(F.max_by("operation", "revision").alias("last"))
    return last.where("last = 'create'").select(*KEY)


def live_state(log_stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """state() kept up incrementally over a stream of changes: Spark's state holds each tuple's last change, and each batch writes the tuples it touched to a folder of its own."""
    last = log_stream.groupBy(*KEY).agg(F.max_by("operation", "revision").alias("operation"), F.max("revision").alias("revision"))
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
    return last.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
