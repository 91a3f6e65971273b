"""The library's queries over the graph of sources.graph, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import functions as F

from ..functions.entities import encode_cursor, encode_offset, key_order, relationship_error, request_error, start_of
from ..plans.compile import resolve
from ..plans.policy import parse
from ..sources import graph
from ..sources.shared import shared_dir
from ..sources.store import Store, Tenants, as_of, intervals, matching, read_changes, visible
from ..streaming.watch import evaluate, follow, state, stream_deletes, summary, watch
from . import access

POLICY = parse(graph.POLICY)


def _checks(spark, d, permission, documented=False):
    return access.check_batch(POLICY, graph.stored(spark, d), graph.requests(spark, d, permission)).select("req_id", "decision")


def _edges(spark, d, resource=None, relation=None, subject=None):
    return matching(graph.stored(spark, d), resource=resource, relation=relation, subject=subject)


def _overlay(spark, d):
    extra = spark.createDataFrame([("customer:1", "owner", "user:3"), ("region:0", "admin", "user:2"), ("order:4", "suspended_user", "user:4")], "resource string, relation string, subject string")
    return access.simulate(graph.stored(spark, d), extra, graph.requests(spark, d, "can_view"), POLICY).select("req_id", "decision")


def _tenants(spark, d):
    nations = spark.read.parquet(f"{d}/nation.parquet")
    orgs = spark.read.parquet(f"{d}/region.parquet").selectExpr("CAST(r_regionkey AS BIGINT) AS id", "r_name AS name")
    vaults = nations.selectExpr("CAST(n_nationkey AS BIGINT) AS id", "CAST(n_regionkey AS BIGINT) AS organization", "n_name AS name")
    kept = Tenants(orgs, vaults).without(2)
    owned = spark.read.parquet(f"{d}/customer.parquet").selectExpr("CAST(c_nationkey AS BIGINT) AS vault", "c_custkey")
    return kept.orphans(owned).groupBy("vault").agg(F.count("*").alias("orphans"))


def _as_of(spark, d):
    """Each request sees the graph as it was at its own revision."""
    asked = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id AS req_id", "concat('doc:', event_id % 50) AS resource", "'viewer' AS relation", "concat('user:', user_id % 10) AS subject", "event_id + 1 AS at")
    return as_of(graph.changes(spark, d), asked)


def _both_ways(spark, d):
    e = graph.stored(spark, d)
    one, all_ = (access.expand(POLICY, e, "order:150", "can_view", deep).select("subject") for deep in (False, True))
    return all_.join(one.withColumn("shallow", F.lit(True)), "subject", "left").select("subject", F.coalesce("shallow", F.lit(False)).alias("shallow"))


#: More rules over the same tuples: a from t, `this` as documented, a predicate, an error on the way.
MORE = parse(
    graph.POLICY.replace("relation dual: viewer & editor", 'relation dual: viewer & editor relation above: can_view from parent relation even: viewer & module("even") relation broken: editor | viewer->can_view')
)
DOCUMENTED = parse("type order { relation viewer relation editor: this & viewer relation either: editor | viewer }")
EVEN = {"even": lambda s, r: F.substring_index(s, ":", -1).cast("long") % 2 == 0}


def _more(spark, d, permission, policy=MORE, **how):
    return access.check_batch(policy, graph.stored(spark, d), graph.requests(spark, d, permission), **how)


def _store(spark, d):
    """Writes, deletes and refused writes of a new store, step by step: (step, revision, changed, living)."""
    tuples = graph.stored(spark, d).where("relation = 'editor'")
    store, steps = Store(spark, f"{shared_dir(spark)}/edgewise/store-{uuid.uuid4().hex}"), []

    def note(step, done):
        steps.append((step, done[0], done[1], store.snapshot(1).count()))

    note("write", store.write_counted(1, tuples))
    note("write again", store.write_counted(1, tuples))
    note("delete by filter", store.delete(1, subject="user:3", limit=5))
    store.checkpoint(1)
    note("delete by filter, all", store.delete(1, subject="user:3"))
    out = store.delete_request(1, exact=tuples.where("subject IN ('user:3', 'user:4')"))
    note("delete exact", (out["revision"], out["deleted"]))
    note("write back", store.write_counted(1, tuples, expected=5))
    note("before", (store.revision(1), store.snapshot(1, 2).count()))
    return spark.createDataFrame(steps, "step string, revision long, changed long, living long")


def _feed(spark, d):
    """The change feed of a store, read as a stream."""
    where = f"{shared_dir(spark)}/edgewise/feed-{uuid.uuid4().hex}"
    store = Store(spark, f"{where}/store")
    tuples = graph.stored(spark, d).where("relation = 'editor'")
    store.write(1, tuples)
    store.delete(1, subject="user:3")
    store.write(1, tuples.where("subject = 'user:3'"))
    take = lambda df: df.select("revision", "operation", "resource", "subject").write.mode("append").parquet(f"{where}/seen")
    follow(watch(spark, store.path, 1, start_of(encode_cursor(2), store.log_revision(1)), ["order"]), take, f"{where}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{where}/seen")


def _streamed(spark, d):
    """Requests decided as a stream, and their summary."""
    where = f"{shared_dir(spark)}/edgewise/decided-{uuid.uuid4().hex}"
    graph.requests(spark, d, "can_edit").repartition(3).write.parquet(f"{where}/requests")
    asked = spark.readStream.schema("req_id long, resource string, subject string, permission string").option("maxFilesPerTrigger", 2).parquet(f"{where}/requests")
    evaluate(asked, POLICY, graph.stored(spark, d), f"{where}/out", f"{where}/checkpoint").awaitTermination()
    return summary(spark, f"{where}/out")


def _stream_deletes(spark, d):
    """What is left of a store after a stream of filters: a subject, a resource with a relation, and one tuple; at most ten for each filter."""
    where = f"{shared_dir(spark)}/edgewise/deletes-{uuid.uuid4().hex}"
    store = Store(spark, f"{where}/store")
    store.write(1, graph.stored(spark, d).where("relation IN ('editor', 'viewer')"))
    asked = [(None, "editor", "user:3"), ("order:50", "viewer", None), (None, None, "user:4"), ("order:1", "viewer", "user:none")]
    schema = "resource string, relation string, subject string"
    spark.createDataFrame(asked, schema).coalesce(1).write.parquet(f"{where}/asked")
    stream_deletes(spark.readStream.schema(schema).parquet(f"{where}/asked"), store, 1, f"{where}/out", f"{where}/checkpoint", 10).awaitTermination()
    return store.snapshot(1)


def _items(spark, d):
    """Structured items: the first 100 requests, each third without an id of its subject."""
    r = graph.requests(spark, d, "can_view").where("req_id < 100")
    entity = lambda c, id_: F.struct(F.substring_index(c, ":", 1).alias("type"), id_.alias("id"))
    own = F.substring_index("subject", ":", -1)
    items = r.select("req_id", entity("subject", F.when(F.col("req_id") % 3 == 0, "").otherwise(own)).alias("subject"), entity("resource", F.substring_index("resource", ":", -1)).alias("resource"), F.col("permission").alias("action"))
    return access.evaluations(POLICY, graph.stored(spark, d), items)


def _invalid(spark, d):
    """What is wrong with tuples made odd on purpose."""
    x = F.col("event_id")
    odd = spark.read.parquet(f"{d}/events.parquet").select(
        "event_id",
        F.when(x % 11 == 0, "").when(x % 11 == 1, "order").when(x % 11 == 2, "Order:1").when(x % 11 == 3, "order:").otherwise(F.concat(F.lit("order:"), x)).alias("resource"),
        F.when(x % 13 == 0, "").otherwise("viewer").alias("relation"),
        F.when(x % 7 == 0, "user:*").when(x % 7 == 1, "Bad:*").when(x % 7 == 2, F.lit(None)).otherwise(F.concat(F.lit("user:"), F.col("user_id"))).alias("subject"),
    )
    return odd.select("event_id", F.coalesce(relationship_error(), F.lit("")).alias("error"), F.coalesce(request_error("subject", "resource", "relation"), F.lit("")).alias("request_error"))


def _paged(spark, d):
    got = access.page(access.list_relationships(graph.stored(spark, d), relation="owner"), 50, encode_offset(50))
    return got.rows.withColumn("cursor", F.lit(got.cursor)).withColumn("total", F.lit(got.total).cast("long"))


def _dimension(spark, d):
    t = spark.read.parquet(f"{d}/nation.parquet").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "CAST(n_regionkey AS BIGINT) AS organization", "n_name AS name")
    orgs = spark.read.parquet(f"{d}/region.parquet").selectExpr("CAST(r_regionkey AS BIGINT) AS id", "r_name AS name")
    now = Tenants(orgs, t).with_organization(10, "NEW").with_vault(100, 10, "EMPTY").moved(3, 10).without_vault(4).without(2)
    return now.vaults.join(now.list_organizations(100).select(F.col("id").alias("organization"), F.col("name").alias("owner")), "organization").select("id", "organization", "name", "owner")


QUERIES = {
    "load_graph": lambda s, d: graph.stored(s, d).groupBy("relation").agg(F.count("*").alias("n")),
    "check_from_batch": lambda s, d: _more(s, d, "above").select("req_id", "decision"),
    "check_module_batch": lambda s, d: _more(s, d, "even", modules=EVEN).select("req_id", "decision"),
    "check_errors_batch": lambda s, d: _more(s, d, "broken").select("req_id", "decision", F.coalesce("error", F.lit("")).alias("error")),
    "check_this_batch": lambda s, d: _more(s, d, "either", DOCUMENTED, documented=True).select("req_id", "decision"),
    "evaluations_items": _items,
    "invalid_tuples": _invalid,
    "page_relationships": _paged,
    "store_steps": _store,
    "watch_stream": _feed,
    "streaming_evaluate": _streamed,
    "streaming_delete": _stream_deletes,
    "audit_windows": lambda s, d: access.audit_rates(s.read.parquet(f"{d}/events.parquet")).select("start", "total", "failures", "failure_rate", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95")),
    "state_from_log": lambda s, d: state(graph.changes(s, d)).select("resource", "subject"),
    "tenant_dimensions": _dimension,
    "audit_outcomes": lambda s, d: access.audit(_more(s, d, "broken"), graph.requests(s, d, "broken")).groupBy("event", "outcome").agg(F.count("*").alias("n")),
    "exists_any": lambda s, d: graph.requests(s, d, "x").where("req_id < 200").select("resource").distinct().join(graph.stored(s, d).where("relation = 'viewer'").select("resource").distinct(), "resource", "left_semi"),
    "expand_tree_users": lambda s, d: access.expand_tree(POLICY, graph.stored(s, d), "order:150", "can_view").where("users is not null").select("name", F.explode("users").alias("user")).groupBy("name").agg(F.count("*").alias("n")),
    "rel_scan_filter": lambda s, d: _edges(s, d, relation="owner", subject="user:5"),
    "rel_point_lookup": lambda s, d: _edges(s, d, "nation:3", "parent", "region:1").unionByName(_edges(s, d, "order:50", "viewer")),
    "resources_by_type": lambda s, d: graph.stored(s, d).where(F.col("resource").startswith("customer:")).select("resource").distinct(),
    "snapshot_asof": lambda s, d: visible(intervals(graph.changes(s, d)), 500).select("resource", "relation", "subject"),
    "asof_per_request": _as_of,
    "changelog_replay": lambda s, d: intervals(graph.changes(s, d)).selectExpr("resource", "subject", "CAST(created_at AS BIGINT) AS created_at", "CAST(deleted_at AS BIGINT) AS deleted_at"),
    "read_changes_typed": lambda s, d: read_changes(graph.changes(s, d), 100, ["doc"], 250).selectExpr("CAST(revision AS BIGINT) AS revision", "operation", "resource", "subject"),
    "check_direct_batch": partial(_checks, permission="editor"),
    "check_wildcard_batch": partial(_checks, permission="viewer"),
    "check_union_batch": partial(_checks, permission="can_edit"),
    "check_intersection_batch": partial(_checks, permission="dual"),
    "check_exclusion_batch": partial(_checks, permission="safe_view"),
    "check_forbid_batch": partial(_checks, permission="blocked_user"),
    "check_hierarchy_batch": partial(_checks, permission="can_view"),
    "list_resources_user": lambda s, d: access.list_resources(POLICY, graph.stored(s, d), "user:7", "order", "can_view"),
    "list_resources_glob": lambda s, d: access.list_resources(POLICY, graph.stored(s, d), "user:3", "order", "can_view", "order:1?*5"),
    "list_subjects_resource": lambda s, d: access.list_subjects(POLICY, graph.stored(s, d), "order:150", "can_view", "user"),
    "expand_users": lambda s, d: access.expand(POLICY, graph.stored(s, d), "order:150", "can_view"),
    "expand_shallow_vs_deep": _both_ways,
    "resolve_recursive": lambda s, d: resolve(graph.stored(s, d), "customer", "admin", "parent"),
    "simulate_overlay": _overlay,
    "delete_by_filter_preview": lambda s, d: _edges(s, d, relation="editor").orderBy(key_order()).limit(100),
    "tenant_cascade": _tenants,
    "trace_node_counts": lambda s, d: access.trace(POLICY, graph.stored(s, d), graph.requests(s, d, "can_view")).groupBy("node_type", "name").agg(F.count("*").alias("n"), F.sum(F.col("result").cast("long")).alias("n_true")),
    "watch_batch": lambda s, d: graph.changes(s, d).where("revision >= 200 AND operation = 'delete'").selectExpr("CAST(revision AS BIGINT) AS revision", "resource", "subject"),
    "topk_resources": lambda s, d: graph.stored(s, d).where("relation = 'viewer'").groupBy("subject").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "subject").limit(10),
}

_CTE = f"WITH edges AS ({graph.EDGES_SQL}), requests AS ({graph.REQUESTS_SQL})"
_HIT = """hits AS (
  SELECT DISTINCT r.req_id, e.relation FROM requests r JOIN {edges} e ON e.resource = r.resource AND (e.subject = r.subject OR e.subject = split_part(r.subject, ':', 1) || ':*'))"""
_LEVELS = """l0 AS (SELECT resource, subject FROM {edges} WHERE relation = 'admin'),
l1 AS (SELECT resource, subject FROM {edges} WHERE relation IN ('manager') AND resource LIKE 'nation:%' UNION SELECT e.resource, l0.subject FROM {edges} e JOIN l0 ON e.relation = 'parent' AND e.subject = l0.resource),
l2 AS (SELECT resource, subject FROM {edges} WHERE relation = 'owner' UNION SELECT e.resource, l1.subject FROM {edges} e JOIN l1 ON e.relation = 'parent' AND e.subject = l1.resource),
l3 AS (SELECT resource, subject FROM {edges} WHERE relation IN ('viewer', 'editor', 'can_edit', 'can_view') AND resource LIKE 'order:%' UNION SELECT e.resource, l2.subject FROM {edges} e JOIN l2 ON e.relation = 'parent' AND e.subject = l2.resource)"""
_LOG = f"WITH changes AS ({graph.CHANGES_SQL}), effective AS (SELECT * FROM (SELECT *, lag(operation, 1, 'delete') OVER (PARTITION BY resource, relation, subject ORDER BY revision) AS was FROM changes) WHERE operation != was), " + (
    "live AS (SELECT * FROM (SELECT *, revision AS created_at, lead(revision) OVER (PARTITION BY resource, relation, subject ORDER BY revision) AS deleted_at FROM effective) WHERE operation = 'create')"
)


def _check_sql(condition: str, edges: str = "edges", more: str = "") -> str:
    levels = _LEVELS.format(edges=edges)
    view = f"view AS (SELECT DISTINCT r.req_id FROM requests r JOIN l3 ON l3.resource = r.resource AND (l3.subject = r.subject OR l3.subject = split_part(r.subject, ':', 1) || ':*'))"
    has = lambda rel: f"r.req_id IN (SELECT req_id FROM hits WHERE relation = '{rel}')"
    text = condition.format(viewer=has("viewer"), editor=has("editor"), can_edit=has("can_edit"), dual=has("dual"), safe_view=has("safe_view"), blocked=has("blocked_user"), view="r.req_id IN (SELECT req_id FROM view)")
    return f"{_CTE}{more}, {_HIT.format(edges=edges)}, {levels}, {view} SELECT r.req_id, CASE WHEN ({text}) AND NOT {has('suspended_user')} THEN 'allow' ELSE 'deny' END AS decision FROM requests r"


def _list_sql(user: str, pattern: str) -> str:
    match = f"(subject = '{user}' OR subject = 'user:*')"
    return f"{_CTE}, {_LEVELS.format(edges='edges')} SELECT DISTINCT resource FROM l3 WHERE {match} AND resource LIKE '{pattern}' AND resource NOT IN (SELECT resource FROM edges WHERE relation = 'suspended_user' AND {match})"


_SHALLOW = "SELECT subject FROM edges WHERE resource = 'order:150' AND relation IN ('viewer', 'editor') UNION SELECT b.subject FROM edges a JOIN edges b ON a.resource = 'order:150' AND a.relation = 'parent' AND b.resource = a.subject AND b.relation = 'can_view'"
_EXTRA = ", more AS (SELECT * FROM edges UNION VALUES ('customer:1', 'owner', 'user:3'), ('region:0', 'admin', 'user:2'), ('order:4', 'suspended_user', 'user:4'))"

_FIRST = "CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 11 = 1 THEN 'order' WHEN event_id % 11 = 2 THEN 'Order:1' WHEN event_id % 11 = 3 THEN 'order:' ELSE 'ok' END"
_RESOURCE_BAD = "CASE WHEN event_id % 11 = 1 THEN 'resource: no type' WHEN event_id % 11 = 2 THEN 'resource: bad type' WHEN event_id % 11 = 3 THEN 'resource: empty id' END"
_EDITORS = "editors AS (SELECT * FROM edges WHERE relation = 'editor'), n AS (SELECT count(*) AS every, count(*) FILTER (subject = 'user:3') AS three, count(*) FILTER (subject = 'user:4') AS four FROM editors)"
_ABOVE = "above AS (SELECT DISTINCT r.req_id FROM requests r JOIN edges e ON e.resource = r.resource AND e.relation = 'parent' JOIN l2 ON l2.resource = e.subject AND (l2.subject = r.subject OR l2.subject = split_part(r.subject, ':', 1) || ':*'))"
_MORE_CTE = f"{_CTE}, {_HIT.format(edges='edges')}, {_LEVELS.format(edges='edges')}, {_ABOVE}"
_HAS = lambda rel: f"r.req_id IN (SELECT req_id FROM hits WHERE relation = '{rel}')"
_DECIDED = lambda text: f"{_MORE_CTE} SELECT r.req_id, CASE WHEN ({text}) AND NOT {_HAS('suspended_user')} THEN 'allow' ELSE 'deny' END AS decision FROM requests r"
_WRONG = "r.resource IN (SELECT resource FROM edges WHERE relation = 'viewer')"
_BROKEN = f"""{_MORE_CTE} SELECT r.req_id, CASE WHEN {_HAS('editor')} AND NOT {_WRONG} AND NOT {_HAS('suspended_user')} THEN 'allow' ELSE 'deny' END AS decision,
  CASE WHEN {_WRONG} AND NOT {_HAS('suspended_user')} THEN 'Type not found: user' ELSE '' END AS error FROM requests r"""
_VIEW = f"({_HAS('viewer')} OR {_HAS('editor')} OR r.req_id IN (SELECT req_id FROM above))"
_NODES = [("decision", "can_view", f"{_VIEW} AND NOT {_HAS('suspended_user')}"), ("forbid", "denied", _HAS("suspended_user")), ("reference", "suspended_user", _HAS("suspended_user")), ("permission", "can_view", _VIEW), ("direct", "can_view", "false"), ("union", "can_view", _VIEW), ("reference", "viewer", _HAS("viewer")), ("reference", "can_edit", _HAS("editor")), ("traversal", "can_view", "r.req_id IN (SELECT req_id FROM above)")]

ORACLE_SQL = {
    "load_graph": f"{_CTE} SELECT relation, count(*) AS n FROM edges GROUP BY 1",
    "trace_node_counts": f"{_MORE_CTE} " + " UNION ALL ".join(f"SELECT '{k}' AS node_type, '{n}' AS name, count(*) AS n, CAST(count(*) FILTER ({t}) AS BIGINT) AS n_true FROM requests r" for k, n, t in _NODES),
    "check_from_batch": _DECIDED("r.req_id IN (SELECT req_id FROM above)"),
    "check_module_batch": _DECIDED(f"{_HAS('viewer')} AND CAST(split_part(r.subject, ':', 2) AS BIGINT) % 2 = 0"),
    "check_errors_batch": _BROKEN,
    "check_this_batch": f"{_MORE_CTE} SELECT r.req_id, CASE WHEN {_HAS('viewer')} OR {_HAS('editor')} THEN 'allow' ELSE 'deny' END AS decision FROM requests r",
    "evaluations_items": f"{_MORE_CTE} SELECT r.req_id, r.req_id % 3 != 0 AND {_VIEW} AND NOT {_HAS('suspended_user')} AS decision, CASE WHEN r.req_id % 3 = 0 THEN 'subject: empty id' ELSE '' END AS reason FROM requests r WHERE r.req_id < 100",
    "invalid_tuples": f"""SELECT event_id, coalesce(CASE WHEN event_id % 11 = 0 THEN 'resource cannot be empty' WHEN event_id % 13 = 0 THEN 'relation cannot be empty' WHEN event_id % 7 = 2 THEN 'subject cannot be empty' END, {_RESOURCE_BAD}, CASE WHEN event_id % 7 = 1 THEN 'subject: bad wildcard' END, '') AS error,
      coalesce(CASE WHEN event_id % 7 = 2 THEN 'subject cannot be empty' WHEN event_id % 11 = 0 THEN 'resource cannot be empty' WHEN event_id % 13 = 0 THEN 'permission cannot be empty' WHEN event_id % 7 = 1 THEN 'subject: bad type' END, {_RESOURCE_BAD}, '') AS request_error FROM events""",
    "page_relationships": f"{_CTE}, owners AS (SELECT * FROM edges WHERE relation = 'owner') SELECT *, CASE WHEN (SELECT count(*) FROM owners) > 100 THEN 'ZAAAAAAAAAA=' END AS cursor, (SELECT count(*) FROM owners) AS total FROM owners ORDER BY concat_ws(':', resource, relation, subject) LIMIT 50 OFFSET 50",
    "store_steps": f"""{_CTE}, {_EDITORS} SELECT 'write' AS step, 1 AS revision, every AS changed, every AS living FROM n UNION ALL SELECT 'write again', 2, 0, every FROM n
      UNION ALL SELECT 'delete by filter', 3, least(5, three), every - least(5, three) FROM n UNION ALL SELECT 'delete by filter, all', 4, three - least(5, three), every - three FROM n
      UNION ALL SELECT 'delete exact', 5, four, every - three - four FROM n UNION ALL SELECT 'write back', 6, three + four, every FROM n UNION ALL SELECT 'before', 6, every, every FROM n""",
    "watch_stream": f"{_CTE} SELECT v.revision, v.operation, resource, subject FROM edges, (VALUES (2, 'delete'), (3, 'create')) v(revision, operation) WHERE relation = 'editor' AND subject = 'user:3'",
    "streaming_evaluate": f"SELECT count(*) AS total, count(*) FILTER (decision = 'allow') AS allowed, 0 AS errors, true AS complete FROM ({_DECIDED(_HAS('editor'))})",
    "streaming_delete": f"""{_CTE}, stored AS (SELECT * FROM edges WHERE relation IN ('editor', 'viewer')), matched AS (
      SELECT resource, relation, subject, 1 AS f FROM stored WHERE relation = 'editor' AND subject = 'user:3' UNION ALL SELECT resource, relation, subject, 2 FROM stored WHERE resource = 'order:50' AND relation = 'viewer'
      UNION ALL SELECT resource, relation, subject, 3 FROM stored WHERE subject = 'user:4'),
      gone AS (SELECT resource, relation, subject FROM matched QUALIFY row_number() OVER (PARTITION BY f ORDER BY concat_ws(':', resource, relation, subject)) <= 10)
      SELECT resource, relation, subject FROM stored EXCEPT SELECT resource, relation, subject FROM gone""",
    "audit_windows": """SELECT date_trunc('hour', ts) AS start, count(*) AS total, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'error') / count(*) AS failure_rate,
      round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events WHERE ts IS NOT NULL GROUP BY 1""",
    "state_from_log": f"{_LOG} SELECT resource, subject FROM live WHERE deleted_at IS NULL",
    "tenant_dimensions": """WITH vaults AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey = 3 THEN 10 ELSE n_regionkey END AS organization, n_name AS name FROM nation WHERE n_nationkey != 4 UNION ALL SELECT 100, 10, 'EMPTY'),
      orgs AS (SELECT r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 10, 'NEW') SELECT v.id, v.organization, v.name, o.name AS owner FROM vaults v JOIN orgs o ON o.id = v.organization WHERE v.organization != 2""",
    "audit_outcomes": f"SELECT 'authorization_check' AS event, CASE WHEN error != '' THEN 'error' ELSE decision END AS outcome, count(*) AS n FROM ({_BROKEN}) GROUP BY 1, 2",
    "exists_any": f"{_CTE} SELECT DISTINCT r.resource FROM requests r WHERE r.req_id < 200 AND EXISTS (SELECT 1 FROM edges e WHERE e.resource = r.resource AND e.relation = 'viewer')",
    "expand_tree_users": f"{_CTE} SELECT relation AS name, count(*) AS n FROM edges WHERE resource = 'order:150' AND relation IN ('viewer', 'editor') GROUP BY 1",
    "rel_scan_filter": f"{_CTE} SELECT * FROM edges WHERE relation = 'owner' AND subject = 'user:5'",
    "rel_point_lookup": f"{_CTE} SELECT * FROM edges WHERE (resource = 'nation:3' AND relation = 'parent' AND subject = 'region:1') OR (resource = 'order:50' AND relation = 'viewer')",
    "resources_by_type": f"{_CTE} SELECT DISTINCT resource FROM edges WHERE resource LIKE 'customer:%'",
    "snapshot_asof": f"{_LOG} SELECT resource, relation, subject FROM live WHERE created_at <= 500 AND (deleted_at IS NULL OR deleted_at > 500)",
    "asof_per_request": f"{_LOG} SELECT e.event_id AS req_id, CASE WHEN EXISTS (SELECT 1 FROM live l WHERE l.resource = concat('doc:', e.event_id % 50) AND l.subject = concat('user:', e.user_id % 10) AND l.created_at <= e.event_id + 1 AND (l.deleted_at IS NULL OR l.deleted_at > e.event_id + 1)) THEN 'allow' ELSE 'deny' END AS decision FROM events e",
    "changelog_replay": f"{_LOG} SELECT resource, subject, created_at, deleted_at FROM live",
    "read_changes_typed": f"{_LOG} SELECT revision, operation, resource, subject FROM changes WHERE revision >= 100 ORDER BY revision LIMIT 250",
    "check_direct_batch": _check_sql("{editor}"),
    "check_wildcard_batch": _check_sql("{viewer}"),
    "check_union_batch": _check_sql("{can_edit} OR {editor}"),
    "check_intersection_batch": _check_sql("{dual} OR ({viewer} AND {editor})"),
    "check_exclusion_batch": _check_sql("{safe_view} OR ({view} AND NOT {blocked})"),
    "check_forbid_batch": _check_sql("{blocked}"),
    "check_hierarchy_batch": _check_sql("{view}"),
    "list_resources_user": _list_sql("user:7", "order:%"),
    "list_resources_glob": _list_sql("user:3", "order:1_%5"),
    "list_subjects_resource": f"{_CTE}, {_LEVELS.format(edges='edges')} SELECT DISTINCT subject FROM l3 WHERE resource = 'order:150' AND subject LIKE 'user:%'",
    "expand_users": f"{_CTE} {_SHALLOW}",
    "expand_shallow_vs_deep": f"{_CTE}, {_LEVELS.format(edges='edges')} SELECT DISTINCT subject, subject IN ({_SHALLOW}) AS shallow FROM l3 WHERE resource = 'order:150'",
    "resolve_recursive": f"WITH RECURSIVE edges AS ({graph.EDGES_SQL}), reach(resource, above) AS (SELECT DISTINCT resource, resource FROM edges WHERE resource LIKE 'customer:%' UNION SELECT r.resource, e.subject FROM reach r JOIN edges e ON e.resource = r.above AND e.relation = 'parent') SELECT DISTINCT r.resource, e.subject FROM reach r JOIN edges e ON e.resource = r.above AND e.relation = 'admin'",
    "simulate_overlay": _check_sql("{view}", "more", _EXTRA),
    "delete_by_filter_preview": f"{_CTE} SELECT * FROM edges WHERE relation = 'editor' ORDER BY concat_ws(':', resource, relation, subject) LIMIT 100",
    "tenant_cascade": "SELECT CAST(c_nationkey AS BIGINT) AS vault, count(*) AS orphans FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) GROUP BY 1",
    "watch_batch": f"{_LOG} SELECT revision, resource, subject FROM changes WHERE revision >= 200 AND operation = 'delete'",
    "topk_resources": f"{_CTE} SELECT subject, count(*) AS n FROM edges WHERE relation = 'viewer' GROUP BY 1 ORDER BY n DESC, subject LIMIT 10",
}
