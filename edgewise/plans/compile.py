"""Policies as joins: checks of many requests at once, and sets of subjects."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entities import entity_type, wildcard
from ..sources.shared import cut
from .policy import Exclusion, Intersection, Module, Policy, Ref, This, Tuples, Union, Via, walk

Key = tuple[str, str]


Truth = tuple[Column, Column]  # whether it holds, and its error


class Checker:
    """Which of the demanded (resource, s) pairs hold a relation, and which fail with an error.

    All relations that a rule reads on its own type are looked up in one join of the demanded pairs with the edges; |, &
    and - are then columns of the pair's row. Each traversal is one more join, to the pairs demanded of the next type, so
    the work follows the requests and not the graph. Wildcard grants match at the leaves. A relation's own tuples grant it
    before its rule is asked; `this` in a rule means tuples of a relation called this, unless documented=True, where it
    means the relation itself. Nothing is short-circuited: an error in any branch is an error of the whole, through
    recursion as well. Recursive rules are solved by a least fixpoint.
    """

    def __init__(self, policy: Policy, edges: DataFrame, modules: dict[str, Callable[[Column, Column], Column]] | None = None, documented: bool = False, cap: int = 100):
        self.policy, self.edges, self.modules, self.documented, self.cap = policy, edges, modules or {}, documented, cap
        self._types: dict[Key, list[str]] | None = None
        self._circles: dict[Key, set[Key]] = {}

    def leads_to(self, type_name: str, relation: str) -> list[str]:
        """Types of the subjects of a relation, from the data. One small aggregation over the relations that rules traverse."""
        if self._types is None:
            self._types = {}
            through = sorted({x.through for t in self.policy.types for r in [*t.relations, *t.forbids] for x in walk(r.expr) if isinstance(x, Via)})
            for r in self.edges.where(F.col("relation").isin(through)).select(entity_type(F.col("resource")), "relation", entity_type(F.col("subject"))).distinct().collect():
                self._types.setdefault((r[0], r[1]), []).append(r[2])
        return sorted(self._types.get((type_name, relation), []))

    def _rule(self, key: Key):
        t = self.policy.type(key[0])
        return t.relation(key[1]) if t else None

    def _reaches(self, key: Key) -> list[Key]:
        rule = self._rule(key)
        out = []
        for x in walk(rule.expr if rule else None):
            if isinstance(x, Ref):
                out.append((key[0], x.name))
            elif isinstance(x, Via):
                out += [(to, x.name) for to in self.leads_to(key[0], x.through)]
        return out

    def _circle(self, key: Key) -> set[Key]:
        """The relations that key reaches and that reach key; empty if it isn't recursive."""

        def reach(start: Key) -> set[Key]:
            seen, todo = set(), list(self._reaches(start))
            while todo:
                k = todo.pop()
                if k not in seen:
                    seen.add(k)
                    todo += self._reaches(k)
            return seen

        if key not in self._circles:
            below = reach(key)
            self._circles[key] = {k for k in below if key in reach(k)} if key in below else set()
        return self._circles[key]

    def _leaves(self, type_name: str, name: str, expr, known: set[Key], seen: set[str], leaves: dict) -> None:
        """What an expression reads: tuples of its own type, traversals, and relations solved elsewhere."""
        for x in walk(expr):
            if isinstance(x, This):
                leaves.setdefault(("direct", name if self.documented else "this"))
            elif isinstance(x, Tuples):
                leaves.setdefault(("direct", x.name))
            elif isinstance(x, Ref):
                self._relation_leaves((type_name, x.name), known, seen, leaves)
            elif isinstance(x, Via):
                leaves.setdefault(("via", x.through, x.name))

    def _relation_leaves(self, key: Key, known: set[Key], seen: set[str], leaves: dict) -> None:
        if key in known or self._circle(key):
            leaves.setdefault(("known", key[1]))
            return
        leaves.setdefault(("direct", key[1]))
        if key[1] not in seen and (rule := self._rule(key)):
            seen.add(key[1])
            self._leaves(*key, rule.expr, known, seen, leaves)

    def _of(self, type_name: str) -> DataFrame:
        """The tuples on resources of a type. Stored tuples are sorted by resource, so those of other types are hardly read."""
        return self.edges.where(F.col("resource").startswith(f"{type_name}:") | (F.col("resource") == type_name))

    def direct(self, type_name: str, relations: list[str], need: DataFrame) -> DataFrame:
        """need's pairs (resources of the type) that have tuples of any of the relations, with one boolean column for each."""
        asked = need.select("resource", "s", F.explode(F.array_distinct(F.array("s", wildcard(F.col("s"))))).alias("subject"))
        found = self._of(type_name).where(F.col("relation").isin(relations)).select("resource", "subject", "relation")
        has = [F.max(F.col("relation") == r).alias(f"direct:{r}") for r in relations]
        return asked.join(found, ["resource", "subject"]).groupBy("resource", "s").agg(*has)

    def _hop(self, type_name: str, through: str, need: DataFrame) -> DataFrame:
        step = self._of(type_name).where(F.col("relation") == through).select("resource", F.col("subject").alias("object"))
        return need.select("resource", "s").join(step, "resource")

    def _joined(self, type_name: str, need: DataFrame, leaves: dict, known: dict[Key, DataFrame]) -> DataFrame:
        """need's pairs with a column for each leaf: a boolean for tuples, a struct (held, error) for the others."""
        out = need.select("resource", "s")
        if relations := sorted(x[1] for x in leaves if x[0] == "direct"):
            out = out.join(self.direct(type_name, relations, need), ["resource", "s"], "left")
            out = out.withColumns({f"direct:{r}": F.coalesce(F.col(f"`direct:{r}`"), F.lit(False)) for r in relations})
        for _, name in (x for x in leaves if x[0] == "known"):
            key = (type_name, name)
            state = known[key] if key in known else self._fixpoint(key, self._circle(key), need)
            out = out.join(state.select("resource", "s", F.struct("held", "error").alias(f"known:{name}")), ["resource", "s"], "left")
        by_hop: dict[str, list[str]] = {}
        for _, through, name in (x for x in leaves if x[0] == "via"):
            by_hop.setdefault(through, []).append(name)
        for through, names in by_hop.items():
            hop, parts = cut(self._hop(type_name, through, need), "hop"), []  # read three times by the next type's plan
            for to in self.leads_to(type_name, through):
                mine = hop.where(entity_type(F.col("object")) == to)
                below = mine.select(F.col("object").alias("resource"), "s").distinct()
                told = self.evaluate(to, names, below, known).withColumnRenamed("resource", "object")
                # Pairs on which nothing holds or fails say nothing to those that lead to them.
                says = [F.col(f"`{n}`.held") | F.col(f"`{n}`.error").isNotNull() for n in names]
                told = told.where(reduce(Column.__or__, says))
                parts.append(mine.join(told, ["object", "s"]).select("resource", "s", *[F.col(f"`{n}`") for n in names]))
            if not parts:
                continue
            up = parts[0]
            for more in parts[1:]:
                up = up.unionByName(more)
            any_of = [F.struct(F.max(F.col(f"`{n}`.held")).alias("held"), F.min(F.col(f"`{n}`.error")).alias("error")).alias(f"via:{through}:{n}") for n in names]
            out = out.join(up.groupBy("resource", "s").agg(*any_of), ["resource", "s"], "left")
        return out

    def _truth(self, type_name: str, name: str, expr, columns: list[str]) -> Truth:
        """An expression as columns of the row that _joined() makes."""
        none, no = F.lit(None).cast("string"), F.lit(False)
        of = lambda c: (F.coalesce(F.col(f"`{c}`.held"), no), F.col(f"`{c}`.error")) if c in columns else (no, none)
        if isinstance(expr, This):
            return F.col(f"`direct:{name if self.documented else 'this'}`"), none
        if isinstance(expr, Tuples):
            return F.col(f"`direct:{expr.name}`"), none
        if isinstance(expr, Ref):
            return self._relation_truth((type_name, expr.name), columns)
        if isinstance(expr, Module):
            if expr.name not in self.modules:
                return no, F.lit(f"Module not found: {expr.name}")
            return F.coalesce(self.modules[expr.name](F.col("s"), F.col("resource")), no), none
        if isinstance(expr, Via):
            return of(f"via:{expr.through}:{expr.name}")
        parts = [expr.base, expr.less] if isinstance(expr, Exclusion) else list(expr.parts)
        told = [self._truth(type_name, name, p, columns) for p in parts]
        held = told[0][0]
        for more, _ in told[1:]:
            held = held | more if isinstance(expr, Union) else held & (~more if isinstance(expr, Exclusion) else more)
        return held, F.least(*[e for _, e in told])

    def _relation_truth(self, key: Key, columns: list[str]) -> Truth:
        if f"known:{key[1]}" in columns:
            return F.coalesce(F.col(f"`known:{key[1]}`.held"), F.lit(False)), F.col(f"`known:{key[1]}`.error")
        own, rule = F.col(f"`direct:{key[1]}`"), self._rule(key)
        if rule is None:
            why = f"Relation not found: {key[1]}" if self.policy.type(key[0]) else f"Type not found: {key[0]}"
            return own, F.when(~own, why)
        if rule.expr is None:
            return own, F.lit(None).cast("string")
        held, error = self._truth(*key, rule.expr, columns)
        return own | held, F.when(~own, error)

    def evaluate(self, type_name: str, names: list[str], need: DataFrame, known: dict[Key, DataFrame] | None = None, forbids: bool = False, nodes: list | None = None) -> DataFrame:
        """need's pairs with a struct (held, error) for each of the relations.

        With forbids also for each forbid of the type, named forbid:0 and so on; nodes: (name, relation, expression) of more columns.
        """
        known = known or {}
        t, leaves, seen = self.policy.type(type_name), {}, set()
        for n in names:
            self._relation_leaves((type_name, n), set(known), seen, leaves)
        rules = [(f"forbid:{i}", f) for i, f in enumerate(t.forbids)] if forbids and t else []
        for _, f in rules:
            leaves.setdefault(("direct", f.name)) if f.expr is None else self._leaves(type_name, f.name, f.expr, set(known), seen, leaves)
        for _, owner, expr in nodes or []:
            self._leaves(type_name, owner, expr, set(known), seen, leaves)
        rows = self._joined(type_name, need, leaves, known)
        truths = {n: self._relation_truth((type_name, n), rows.columns) for n in names}
        truths |= {c: (F.col(f"`direct:{f.name}`"), F.lit(None).cast("string")) if f.expr is None else self._truth(type_name, f.name, f.expr, rows.columns) for c, f in rules}
        truths |= {c: self._truth(type_name, owner, expr, rows.columns) for c, owner, expr in nodes or []}
        return rows.select("resource", "s", *[F.struct(h.alias("held"), e.alias("error")).alias(c) for c, (h, e) in truths.items()])

    def _fixpoint(self, key: Key, circle: set[Key], need: DataFrame) -> DataFrame:
        """(resource, s, held, error) by a least fixpoint over the relations of a circle: first all pairs asked for, then what holds and fails, in rounds until nothing is new."""
        rules = {k: self._rule(k) for k in circle}
        for k, r in rules.items():
            for x in walk(r.expr):
                for y in walk(x.less) if isinstance(x, Exclusion) else ():
                    if (isinstance(y, Ref) and (k[0], y.name) in circle) or (isinstance(y, Via) and any((to, y.name) in circle for to in self.leads_to(k[0], y.through))):
                        raise ValueError(f"{key[0]}.{key[1]} is recursive through the right side of -")
        empty = need.where(F.lit(False)).select("resource", "s")
        asked = {k: empty for k in circle} | {key: cut(need.select("resource", "s").distinct(), "need")}
        fresh = {key: asked[key]}
        for _ in range(self.cap):
            more: dict[Key, DataFrame] = {}
            for k, n in fresh.items():
                for x in walk(rules[k].expr):
                    if isinstance(x, Ref) and (k[0], x.name) in circle:
                        to = [((k[0], x.name), n)]
                    elif isinstance(x, Via):
                        hop = self._hop(k[0], x.through, n).select(F.col("object").alias("resource"), "s")
                        to = [((t, x.name), hop.where(entity_type(F.col("resource")) == t)) for t in self.leads_to(k[0], x.through) if (t, x.name) in circle]
                    else:
                        continue
                    for target, d in to:
                        more[target] = more[target].unionByName(d) if target in more else d
            fresh = {k: cut(d.distinct().join(asked[k], ["resource", "s"], "left_anti"), "need") for k, d in more.items()}
            fresh = {k: d for k, d in fresh.items() if not d.isEmpty()}
            if not fresh:
                break
            asked |= {k: asked[k].unionByName(d) for k, d in fresh.items()}
        else:
            raise RuntimeError(f"{key[0]}.{key[1]}: demand still grows after {self.cap} rounds")
        state = {k: cut(asked[k].select("*", F.lit(False).alias("held"), F.lit(None).cast("string").alias("error")), "state") for k in circle}
        was = None
        for _ in range(self.cap):
            new = {}
            for k in circle:
                leaves: dict = {("direct", k[1]): None}
                self._leaves(*k, rules[k].expr, circle, set(), leaves)
                rows = self._joined(k[0], asked[k], leaves, state)
                held, error = self._truth(*k, rules[k].expr, rows.columns)
                own = F.col(f"`direct:{k[1]}`")
                new[k] = cut(rows.select("resource", "s", (own | held).alias("held"), F.when(~own, error).alias("error")), "state")
            state = new
            now = {k: tuple(d.agg(F.count_if("held"), F.count("error"), F.bit_xor(F.xxhash64("resource", "s", "error"))).first()) for k, d in state.items()}
            if now == was:
                return state[key]
            was = now
        raise RuntimeError(f"{key[0]}.{key[1]}: no fixpoint after {self.cap} rounds")

    def check(self, requests: DataFrame) -> DataFrame:
        """(req_id, decision, error) for requests (req_id, subject, resource, permission).

        Forbids of the resource's type are asked first, in order: the first that holds denies, an error before it is the
        answer. An error is a deny with its message. The permissions and types in the requests are listed on the driver.
        """
        asked = requests.select("req_id", F.col("subject").alias("s"), "resource", "permission", entity_type(F.col("resource")).alias("type"))
        kinds = sorted((r[0], r[1]) for r in asked.select("type", "permission").distinct().collect())
        out = None
        for type_name, permission in kinds:
            mine = asked.where((F.col("type") == type_name) & (F.col("permission") == permission))
            told = self.evaluate(type_name, [permission], mine.select("resource", "s").distinct(), forbids=True)
            decision, error = verdict(told, permission)
            told = told.select("resource", "s", decision.alias("decision"), error.alias("error"))
            one = mine.join(told, ["resource", "s"]).select("req_id", "decision", "error")
            out = one if out is None else out.unionByName(one)
        if out is None:
            return asked.select("req_id", F.lit("deny").alias("decision"), F.lit(None).cast("string").alias("error"))
        return out


def verdict(told: DataFrame, permission: str) -> Truth:
    """Decision and error from the columns of a permission and the forbids before it."""
    error, allow = F.col(f"`{permission}`.error"), F.col(f"`{permission}`.held")
    decision = F.when(error.isNull() & allow, "allow").otherwise("deny")
    for c in sorted((c for c in told.columns if c.startswith("forbid:")), key=lambda c: -int(c[7:])):
        bad, hit = F.col(f"`{c}`.error"), F.col(f"`{c}`.held")
        decision = F.when(bad.isNotNull() | hit, "deny").otherwise(decision)
        error = F.when(bad.isNotNull(), bad).when(~hit, error)
    return decision, error


class Subjects:
    """The subjects that hold a relation on the given resources, as plain sets: wildcards are literal, `this` is the relation's own tuples, forbids don't count.

    Tuples are read for the given resources only and, behind a traversal, for what it leads to from them. deep=False
    follows a traversal one level only, to the tuples of the named relation (expand); deep=True follows its rule as well
    (list_subjects). Undefined types and relations on the way are skipped.
    """

    def __init__(self, policy: Policy, edges: DataFrame, deep: bool = True):
        self.policy, self.edges, self.deep = policy, edges, deep
        self._checker = Checker(policy, edges)

    def tuples(self, type_name: str, relation: str, of: str | DataFrame | None = None) -> DataFrame:
        """of: a resource, or a table of resources; None is all."""
        rows = self.edges.where((F.col("relation") == relation) & (entity_type(F.col("resource")) == type_name))
        if isinstance(of, str):
            rows = rows.where(F.col("resource") == of)
        elif of is not None:
            rows = rows.join(of.select("resource").distinct(), "resource", "left_semi")
        return rows.select("resource", "subject")

    def relation(self, type_name: str, name: str, of: str | DataFrame | None = None, path: tuple[Key, ...] = ()) -> DataFrame:
        key = (type_name, name)
        t = self.policy.type(type_name)
        rule = t.relation(name) if t else None
        if rule is None or rule.expr is None or key in path:
            return self.tuples(type_name, name, of)
        return self.expression(type_name, name, rule.expr, of, (*path, key))

    def expression(self, type_name: str, name: str, expr, of: str | DataFrame | None = None, path: tuple[Key, ...] = ()) -> DataFrame:
        if isinstance(expr, This):
            return self.tuples(type_name, name, of)
        if isinstance(expr, Ref):
            t = self.policy.type(type_name)
            if t.relation(expr.name) is None:
                raise ValueError(f"Relation not found: {expr.name}")
            return self.relation(type_name, expr.name, of, path)
        if isinstance(expr, Module):
            raise ValueError("modules can't be listed")
        if isinstance(expr, Via):
            hop = self.tuples(type_name, expr.through, of).withColumnRenamed("subject", "object")
            out = None
            for to in self._checker.leads_to(type_name, expr.through):
                t = self.policy.type(to)
                if t is None or t.relation(expr.name) is None:
                    continue
                mine = hop.where(entity_type(F.col("object")) == to)
                objects = mine.select(F.col("object").alias("resource")) if of is not None else None
                below = self.relation(to, expr.name, objects, path) if self.deep else self.tuples(to, expr.name, objects)
                one = mine.join(below.withColumnRenamed("resource", "object"), "object").select("resource", "subject")
                out = one if out is None else out.unionByName(one)
            return out.distinct() if out is not None else hop.where(F.lit(False)).select("resource", F.col("object").alias("subject"))
        parts = [expr.base, expr.less] if isinstance(expr, Exclusion) else list(expr.parts)
        held, *rest = [self.expression(type_name, name, p, of, path) for p in parts]
        for more in rest:
            held = held.unionByName(more) if isinstance(expr, Union) else held.join(more, ["resource", "subject"], "left_semi" if isinstance(expr, Intersection) else "left_anti")
        return held.distinct()


def resolve(edges: DataFrame, resource_type: str, relation: str, through: str, cap: int = 100) -> DataFrame:
    """(resource, subject): tuples of `relation` on each object of a type and on all that `through` leads to from it. Cycles add nothing; semi-naive rounds."""
    here = edges.where(F.col("relation") == relation).select("resource", "subject").distinct()
    up = edges.where(F.col("relation") == through).select("resource", F.col("subject").alias("above"))
    reached = fresh = cut(edges.where(entity_type(F.col("resource")) == resource_type).select("resource", F.col("resource").alias("above")).distinct(), "reach")
    for _ in range(cap):
        step = fresh.join(up.withColumnRenamed("above", "next").withColumnRenamed("resource", "above"), "above").select("resource", F.col("next").alias("above")).distinct()
        fresh = cut(step.join(reached, ["resource", "above"], "left_anti"), "reach")
        if fresh.isEmpty():
            return reached.join(here.withColumnRenamed("resource", "above"), "above").select("resource", "subject").distinct()
        reached = reached.unionByName(fresh)
    raise RuntimeError(f"{through} is deeper than {cap}")
