"""A relationship graph, a change log and requests that follow from the tables region, nation, customer, orders and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

POLICY = """
type region   { relation admin }
type nation   { relation parent  relation manager  relation can_view: manager | parent->admin }
type customer { relation parent  relation owner    relation can_view: owner | parent->can_view }
type order {
  relation parent  relation viewer  relation editor  relation blocked_user  relation suspended_user
  relation can_edit: editor
  relation can_view: viewer | can_edit | parent->can_view
  relation safe_view: can_view - blocked_user
  relation dual: viewer & editor
  forbid denied: suspended_user
}
"""

_ORDERS = "events JOIN orders ON event_id = o_orderkey"
#: table, condition, resource, relation, subject. Plain SQL, the same in Spark and DuckDB.
RULES = [
    ("region", "true", "concat('region:', r_regionkey)", "admin", "concat('user:', r_regionkey)"),
    ("nation", "true", "concat('nation:', n_nationkey)", "parent", "concat('region:', n_regionkey)"),
    ("nation", "true", "concat('nation:', n_nationkey)", "manager", "concat('user:', 10 + n_nationkey)"),
    ("customer", "true", "concat('customer:', c_custkey)", "parent", "concat('nation:', c_nationkey)"),
    ("customer", "true", "concat('customer:', c_custkey)", "owner", "concat('user:', c_custkey % 97)"),
    ("orders", "true", "concat('order:', o_orderkey)", "parent", "concat('customer:', o_custkey)"),
    (_ORDERS, "event_type = 'view'", "concat('order:', event_id)", "viewer", "concat('user:', user_id)"),
    ("events", "event_type = 'purchase' OR (event_type = 'view' AND event_id % 3 = 0)", "concat('order:', event_id)", "editor", "concat('user:', user_id)"),
    ("events", "event_type = 'view' AND event_id % 5 = 0", "concat('order:', event_id)", "blocked_user", "concat('user:', user_id)"),
    ("events", "event_type = 'view' AND event_id % 7 = 0", "concat('order:', event_id)", "suspended_user", "concat('user:', user_id)"),
    ("events", "event_type = 'view' AND event_id % 25 = 0", "concat('order:', event_id)", "safe_view", "concat('user:', user_id)"),
    ("orders", "o_orderkey % 50 = 0", "concat('order:', o_orderkey)", "viewer", "'user:*'"),
]

EDGES_SQL = " UNION ".join(f"SELECT {res} AS resource, '{rel}' AS relation, {sub} AS subject FROM {table} WHERE {cond}" for table, cond, res, rel, sub in RULES)
REQUESTS_SQL = """SELECT event_id AS req_id, concat('order:', event_id) AS resource,
  concat('user:', CASE WHEN event_id % 2 = 0 THEN user_id ELSE (user_id * 7) % (SELECT count(DISTINCT user_id) FROM events) END) AS subject FROM events"""
CHANGES_SQL = """SELECT row_number() OVER (ORDER BY ts, event_id) AS revision, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'create' END AS operation,
  concat('doc:', event_id % 50) AS resource, 'viewer' AS relation, concat('user:', user_id % 10) AS subject FROM events"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(resource, relation, subject), distinct."""
    out = []
    for table, cond, res, rel, sub in RULES:
        if table == _ORDERS:
            df = _read(spark, sf_dir, "events").join(_read(spark, sf_dir, "orders").selectExpr("o_orderkey AS event_id"), "event_id", "left_semi")
        else:
            df = _read(spark, sf_dir, table)
        out.append(df.where(cond).selectExpr(f"{res} AS resource", f"'{rel}' AS relation", f"{sub} AS subject"))
    return reduce(DataFrame.unionByName, out).distinct()


_STORED: dict[tuple[str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges() as the session's table, in one folder for each relation and sorted by resource, so a check reads only the relations it asks for. Made once a session and folder of tables."""
    from .shared import cut

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        made = edges(spark, sf_dir).repartition("relation", "resource").sortWithinPartitions("relation", "resource")
        _STORED[key] = cut(made, "graph", ("relation",)).select("resource", "relation", "subject")
    return _STORED[key]


def requests(spark: SparkSession, sf_dir: str, permission: str) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    n = events.selectExpr("count(DISTINCT user_id) AS n").first()[0]
    subject = f"concat('user:', CASE WHEN event_id % 2 = 0 THEN user_id ELSE (user_id * 7) % {n} END) AS subject"
    return events.selectExpr("event_id AS req_id", "concat('order:', event_id) AS resource", subject, f"'{permission}' AS permission")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(revision, operation, resource, relation, subject). Revisions are numbered by range-sorted parts, so no task holds the whole log."""
    from pyspark.sql import functions as F

    from .shared import cut

    events = _read(spark, sf_dir, "events").select("ts", "event_id", "event_type", "user_id")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = events.repartitionByRange(n, "ts", "event_id").sortWithinPartitions("ts", "event_id")
    ordered = cut(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "log")
    sizes = sorted((r[0], r[1]) for r in ordered.groupBy("part").count().collect())
    before, starts = 0, []
    for part, size in sizes:
        starts.append((part, before))
        before += size
    starts = spark.createDataFrame(starts, "part int, before long")
    op = "CASE WHEN event_type = 'error' THEN 'delete' ELSE 'create' END AS operation"
    return ordered.join(F.broadcast(starts), "part").selectExpr("before + at + 1 AS revision", op, "concat('doc:', event_id % 50) AS resource", "'viewer' AS relation", "concat('user:', user_id % 10) AS subject")
