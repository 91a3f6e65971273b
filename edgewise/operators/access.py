"""Questions to a relationship graph under a policy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.entities import DEFAULT_LIMIT, MAX_LIMIT, decode_offset, encode_offset, entity_type, glob, key_order, request_error
from ..plans.compile import Checker, Subjects, verdict
from ..plans.policy import Exclusion, Intersection, Module, Policy, Ref, This, Tuples, Union, Via
from ..sources.shared import cut, held
from ..sources.store import matching


@dataclass
class Page:
    rows: DataFrame
    cursor: str | None
    total: int


def check_batch(policy: Policy, edges: DataFrame, requests: DataFrame, **how) -> DataFrame:
    """(req_id, decision, error) for requests (req_id, subject, resource, permission), all at once."""
    return Checker(policy, edges, **how).check(requests)


def check(policy: Policy, edges: DataFrame, subject: str, resource: str, permission: str, **how) -> str:
    """allow or deny for one request; raises on an error."""
    one = edges.sparkSession.createDataFrame([(0, subject, resource, permission)], "req_id long, subject string, resource string, permission string")
    row = check_batch(policy, edges, one, **how).first()
    if row.error:
        raise ValueError(row.error)
    return row.decision


def simulate(edges: DataFrame | None, extra: DataFrame, requests: DataFrame, policy: Policy | None = None) -> DataFrame:
    """check_batch() with extra tuples laid over the graph, or, without edges, with them alone; without a policy only tuples count and all else is an error."""
    rows = extra.select("resource", "relation", "subject")
    if edges is not None:
        rows = rows.unionByName(edges.select("resource", "relation", "subject")).distinct()
    return check_batch(policy or Policy(), rows, requests)


def list_resources(policy: Policy, edges: DataFrame, subject: str, resource_type: str, permission: str, pattern: str | None = None) -> DataFrame:
    """(resource), sorted: those of a type, with a tuple of their own, on which the subject has the permission. One pass, no check per row."""
    rows = edges.where(entity_type(F.col("resource")) == resource_type).select("resource").distinct()
    if pattern is not None:
        rows = rows.where(F.col("resource").rlike(glob(pattern)))
    asked = rows.select(F.col("resource").alias("req_id"), F.lit(subject).alias("subject"), "resource", F.lit(permission).alias("permission"))
    return check_batch(policy, edges, asked).where("decision = 'allow'").select(F.col("req_id").alias("resource")).orderBy("resource")


def list_relationships(edges: DataFrame, resource: str | None = None, relation: str | None = None, subject: str | None = None) -> DataFrame:
    """(resource, relation, subject), sorted by key; tuples whose keys are spelled alike by their columns, so every call gives one order."""
    return matching(edges, resource=resource, relation=relation, subject=subject).select("resource", "relation", "subject").orderBy(key_order(), "resource", "relation")


def list_subjects(policy: Policy, edges: DataFrame, resource: str, relation: str, subject_type: str | None = None) -> DataFrame:
    """(subject), sorted, distinct, as rules reach them all the way down."""
    rows = Subjects(policy, edges).relation(resource.split(":")[0], relation, resource)
    if subject_type:
        rows = rows.where(entity_type(F.col("subject")) == subject_type)
    return rows.select("subject").distinct().orderBy("subject")


def expand(policy: Policy, edges: DataFrame, resource: str, relation: str, deep: bool = False) -> DataFrame:
    """(subject), sorted, distinct, with traversals followed one level."""
    type_name = resource.split(":")[0]
    t = policy.type(type_name)
    if t is None or t.relation(relation) is None:
        raise ValueError(f"no relation {relation} of {type_name}")
    return Subjects(policy, edges, deep).relation(type_name, relation, resource).select("subject").distinct().orderBy("subject")


def expand_tree(policy: Policy, edges: DataFrame, resource: str, relation: str) -> DataFrame:
    """(node_id, parent_id, ordinal, node_type, name, users): the rule's tree, users at its leaves."""
    type_name = resource.split(":")[0]
    subjects, spark = Subjects(policy, edges, deep=False), edges.sparkSession
    nodes, leaves = [], []

    def add(parent, ordinal, expr, owner):
        me = len(nodes)
        kind = type(expr).__name__.lower()
        nodes.append((me, parent, ordinal, kind, getattr(expr, "name", getattr(expr, "through", owner))))
        if isinstance(expr, Ref):
            rule = policy.type(type_name).relation(expr.name)
            if rule.expr is not None:
                add(me, 0, rule.expr, expr.name)
                return
        children = (expr.base, expr.less) if isinstance(expr, Exclusion) else getattr(expr, "parts", ())
        if children:
            for i, c in enumerate(children):
                add(me, i, c, owner)
        else:
            leaves.append(subjects.expression(type_name, owner, expr, resource).select(F.lit(me).alias("node_id"), "subject"))

    add(None, 0, policy.type(type_name).relation(relation).expr or This(), relation)
    users = leaves[0]
    for more in leaves[1:]:
        users = users.unionByName(more)
    users = users.groupBy("node_id").agg(F.array_sort(F.collect_set("subject")).alias("users"))
    return spark.createDataFrame(nodes, "node_id int, parent_id int, ordinal int, node_type string, name string").join(users, "node_id", "left")


def trace(policy: Policy, edges: DataFrame, requests: DataFrame, **how) -> DataFrame:
    """(req_id, node_id, parent_id, node_type, name, result, error): the truth of each node of the rules that requests of one type and permission ask.

    None is left out: the decision, the forbids, the permission, its own tuples and all parts of its rule, each read from
    the same row, so all nodes cost one evaluation. Rules of other types behind a traversal are one node.
    """
    kinds = {(r[0], r[1]) for r in requests.select(entity_type(F.col("resource")), "permission").distinct().limit(2).collect()}
    if len(kinds) != 1:
        raise ValueError("one type and permission at a time")
    (type_name, permission), = kinds
    t, tree, exprs = policy.type(type_name), [], []

    def add(parent: int | None, kind: str, name: str, column: str) -> int:
        tree.append((len(tree), parent, kind, name, column))
        return len(tree) - 1

    def below(parent: int, expr, owner: str) -> None:
        kind = {This: "direct", Ref: "reference", Via: "traversal", Module: "module", Union: "union", Intersection: "intersection", Exclusion: "exclusion"}[type(expr)]
        exprs.append((f"node:{len(tree)}", owner, expr))
        me = add(parent, kind, getattr(expr, "name", owner), exprs[-1][0])
        for c in (expr.base, expr.less) if isinstance(expr, Exclusion) else getattr(expr, "parts", ()):
            below(me, c, owner)

    root = add(None, "decision", permission, "decision")
    for i, f in enumerate(t.forbids if t else []):
        me = add(root, "forbid", f.name, f"forbid:{i}")
        if f.expr is not None:
            below(me, f.expr, f.name)
    me = add(root, "permission", permission, permission)
    exprs.append((f"node:{len(tree)}", permission, Tuples(permission)))
    add(me, "direct", permission, exprs[-1][0])
    if t and (rule := t.relation(permission)) and rule.expr is not None:
        below(me, rule.expr, permission)
    asked = requests.select("req_id", "resource", F.col("subject").alias("s"))
    told = Checker(policy, edges, **how).evaluate(type_name, [permission], asked.select("resource", "s").distinct(), forbids=True, nodes=exprs)
    decision, error = verdict(told, permission)
    told = told.withColumn("decision", F.struct((decision == "allow").alias("held"), error.alias("error")))
    nodes = [F.struct(F.lit(i).alias("node_id"), F.lit(p).cast("int").alias("parent_id"), F.lit(k).alias("node_type"), F.lit(n).alias("name"), F.col(f"`{c}`.held").alias("result"), F.col(f"`{c}`.error").alias("error")) for i, p, k, n, c in tree]
    return asked.join(told.select("resource", "s", F.array(*nodes).alias("nodes")), ["resource", "s"]).select("req_id", F.explode("nodes").alias("n")).select("req_id", "n.*")


def page(rows: DataFrame, limit: int | None = None, cursor: str | None = None, default: int | None = DEFAULT_LIMIT, most: int = MAX_LIMIT) -> Page:
    """A page of sorted rows. The cursor counts rows; there is one only if more rows remain. The rows are made once.

    Rows on their way to one task come in any order, so a limit over sorted parts takes those of whichever part comes first.
    The sorted rows are written with their part and their place in it instead, and the page is looked up by these; at any
    depth no task sorts more than a page.
    """
    start = decode_offset(cursor)
    n = min(limit or default or most, most)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    with held(rows.select(F.struct("*").alias("row"), F.spark_partition_id().alias("part"), place.alias("at")), "sorted") as placed:
        total, starts = 0, []
        for part, size in sorted((r[0], r[1]) for r in placed.groupBy("part").count().collect()):
            starts.append((part, total))
            total += size
        first, before = max((x for x in starts if x[1] <= start), default=(0, 0))
        last = max((part for part, at in starts if at < start + n), default=0)
        own = F.col("part").between(first, last) & ((F.col("part") > first) | (F.col("at") >= start - before))
        got = cut(placed.where(own).orderBy("part", "at").limit(n).select("row.*"), "page")
    return Page(got, encode_offset(start + n) if total > start + n else None, total)


def evaluations(policy: Policy, edges: DataFrame, items: DataFrame, most: int = 100) -> DataFrame:
    """Decisions for structured items (req_id, subject struct<type,id>, resource struct<type,id>, action): (req_id, decision boolean, reason). An item that isn't well formed, or whose check fails, is a denial with its reason and hinders no other."""
    n = items.limit(most + 1).count()
    if not 0 < n <= most:
        raise ValueError(f"between 1 and {most} items are needed")
    joined = lambda c: F.concat_ws(":", F.col(f"{c}.type"), F.col(f"{c}.id"))
    flat = items.select("req_id", joined("subject").alias("subject"), joined("resource").alias("resource"), F.col("action").alias("permission"))
    flat = flat.withColumn("bad", request_error())
    wrong = flat.where("bad is not null").select("req_id", F.lit(False).alias("decision"), F.col("bad").alias("reason"))
    return wrong.unionByName(check_batch(policy, edges, flat.where("bad is null")).select("req_id", (F.col("decision") == "allow").alias("decision"), F.coalesce("error", F.lit("")).alias("reason")))


def audit(decided: DataFrame, requests: DataFrame) -> DataFrame:
    """One audit event a decision: (req_id, event, subject, resource, permission, outcome, details as JSON)."""
    rows = requests.join(decided, "req_id")
    details = F.to_json(F.struct("subject", "resource", "permission", "error"))
    return rows.select("req_id", F.lit("authorization_check").alias("event"), "subject", "resource", "permission", F.coalesce(F.when(F.col("error").isNotNull(), "error"), F.col("decision")).alias("outcome"), details.alias("details"))


def audit_rates(events: DataFrame, width: str = "1 hour", *, time: str = "ts", kind: str = "event_type", value: str = "value", failed: str = "error", accuracy: int = 0) -> DataFrame:
    """(start, total, failures, failure_rate, median, p95) of each window of time in which there are events.

    Quantiles are exact while accuracy is 0: equal values are counted before the shuffle, and a task then holds the distinct
    values of a window. Where those are too many, accuracy makes them Spark's sketch of bounded size, with a rank error of
    1 / accuracy. A null value counts in none, and a null kind is no failure. Events without a time are left out.
    """
    at = lambda q: F.percentile_approx(value, q, accuracy) if accuracy else F.percentile(value, F.lit(q))
    bad = F.count_if(F.col(kind) == failed)
    per = events.where(F.col(time).isNotNull()).groupBy(F.window(time, width)).agg(F.count("*").alias("total"), bad.alias("failures"), at(0.5).alias("median"), at(0.95).alias("p95"))
    return per.select(F.col("window.start").alias("start"), "total", "failures", (F.col("failures") / F.col("total")).alias("failure_rate"), "median", "p95")
