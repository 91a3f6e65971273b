"""The policy language: relations of types, derived by set algebra and one-hop traversal.

    type folder   { relation parent  relation owner  relation viewer: this | owner | parent->viewer  forbid denied: banned }

`-` binds tightest and at most once, then `&`, then `|`; parentheses group. `a from t` and `t->a` both mean: a on the
objects that t leads to. `module("m")` asks a registered predicate. Comments start with //.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class This:
    pass


@dataclass(frozen=True)
class Tuples:
    """A relation's own tuples, without its rule. Nothing parses to it."""

    name: str


@dataclass(frozen=True)
class Ref:
    name: str


@dataclass(frozen=True)
class Via:
    """`name` on the objects that `through` leads to; arrow: written with ->."""

    through: str
    name: str
    arrow: bool = True


@dataclass(frozen=True)
class Module:
    name: str


@dataclass(frozen=True)
class Union:
    parts: tuple


@dataclass(frozen=True)
class Intersection:
    parts: tuple


@dataclass(frozen=True)
class Exclusion:
    base: object
    less: object


@dataclass(frozen=True)
class Rule:
    name: str
    expr: object | None = None


@dataclass
class Type:
    name: str
    relations: list[Rule] = field(default_factory=list)
    forbids: list[Rule] = field(default_factory=list)

    def relation(self, name: str) -> Rule | None:
        return next((r for r in self.relations if r.name == name), None)


@dataclass
class Policy:
    types: list[Type] = field(default_factory=list)

    def type(self, name: str) -> Type | None:
        return next((t for t in self.types if t.name == name), None)


class PolicyError(ValueError):
    pass


_TOKEN = re.compile(r'\s+|//[^\n]*|(?P<str>"[^"]*")|(?P<op>->|[{}:|&()\-])|(?P<id>[A-Za-z][A-Za-z0-9_]*)')


def parse(text: str) -> Policy:
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise PolicyError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0], m.start()))
        at = m.end()
    tokens.append(("end", "", len(text)))
    pos = 0

    def peek(value: str | None = None, ahead: int = 0) -> bool | tuple:
        token = tokens[min(pos + ahead, len(tokens) - 1)]
        return token if value is None else token[1] == value and token[0] != "str"

    def take(kind: str, value: str | None = None) -> str:
        nonlocal pos
        k, v, where = tokens[pos]
        if k != kind or (value is not None and v != value):
            raise PolicyError(f"expected {value or kind} at {where}, found {v or 'the end'!r}")
        pos += 1
        return v

    def primary():
        if peek("("):
            take("op", "(")
            inner = union()
            take("op", ")")
            return inner
        name = take("id")
        if name == "module" and peek("("):
            take("op", "(")
            inner = Module(take("str").strip('"'))
            take("op", ")")
            return inner
        if peek("->"):
            take("op", "->")
            return Via(name, take("id"))
        if peek("from") and peek(ahead=1)[0] == "id" and not peek(":", 2):
            take("id", "from")
            return Via(take("id"), name, arrow=False)
        return This() if name == "this" else Ref(name)

    def exclusion():
        base = primary()
        if peek("-"):
            take("op", "-")
            base = Exclusion(base, primary())
            if peek("-"):
                raise PolicyError(f"a second - at {peek()[2]}: use parentheses")
        return base

    def many(one, op, made):
        parts = [one()]
        while peek(op):
            take("op", op)
            parts.append(one())
        return parts[0] if len(parts) == 1 else made(tuple(parts))

    def intersection():
        return many(exclusion, "&", Intersection)

    def union():
        return many(intersection, "|", Union)

    policy = Policy()
    while not peek()[0] == "end":
        take("id", "type")
        t = Type(take("id"))
        take("op", "{")
        while not peek("}"):
            kind = take("id")
            if kind not in ("relation", "forbid"):
                raise PolicyError(f"expected relation or forbid, found {kind!r}")
            name, expr = take("id"), None
            if peek(":"):
                take("op", ":")
                expr = union()
            (t.relations if kind == "relation" else t.forbids).append(Rule(name, expr))
        take("op", "}")
        policy.types.append(t)
    return policy


def walk(expr):
    """expr and all below it."""
    if expr is not None:
        yield expr
        for part in getattr(expr, "parts", ()) or ((expr.base, expr.less) if isinstance(expr, Exclusion) else ()):
            yield from walk(part)


def references(expr) -> set[str]:
    return {x.name for x in walk(expr) if isinstance(x, Ref)} | {x.through for x in walk(expr) if isinstance(x, Via)}


def validate(policy: Policy) -> list[tuple[str, str, str, str, str]]:
    """(type, relation, kind, severity, message) for undefined names, cycles, conflicts and unused relations."""
    out = []
    for t in policy.types:
        names, used = {r.name for r in t.relations}, set()
        for r in [*t.relations, *t.forbids]:
            used |= references(r.expr)
            for x in walk(r.expr):
                if isinstance(x, Ref) and x.name not in names:
                    out.append((t.name, r.name, "undefined relation", "error", f"{x.name} isn't a relation of {t.name}"))
                if isinstance(x, Via) and x.through not in names:
                    out.append((t.name, r.name, "undefined tupleset", "error", f"{x.through} isn't a relation of {t.name}"))
        for r in t.relations:
            path, seen = [r.name], set()
            todo = [(x.name, [r.name]) for x in walk(r.expr) if isinstance(x, Ref)]
            while todo:
                name, path = todo.pop()
                if name == r.name:
                    out.append((t.name, r.name, "cycle", "error", " -> ".join([*path, name])))
                    break
                if name not in seen and (rule := t.relation(name)):
                    seen.add(name)
                    todo += [(x.name, [*path, name]) for x in walk(rule.expr) if isinstance(x, Ref)]
        forbidden = {f.name for f in t.forbids}
        for r in t.relations:
            if r.name in forbidden:
                out.append((t.name, r.name, "conflict", "error", f"{r.name} is both a relation and a forbid"))
            elif r.name not in used:
                severity = "warning" if r.expr is not None else "info"
                out.append((t.name, r.name, "unused", severity, f"no rule of {t.name} refers to {r.name}"))
            if r.expr is None:
                out.append((t.name, r.name, "suggested test", "info", f"a tuple of {r.name} grants it"))
    return out


def cost(expr) -> int:
    if expr is None or isinstance(expr, This):
        return 1
    if isinstance(expr, Ref):
        return 5
    if isinstance(expr, Via):
        return 10 if expr.arrow else 5
    if isinstance(expr, Module):
        return 8
    if isinstance(expr, Intersection):
        return max(map(cost, expr.parts)) + 1
    return sum(map(cost, getattr(expr, "parts", None) or (expr.base, expr.less))) // 2


def explain(policy: Policy, type_name: str, relation: str) -> list[tuple[int, str, str, int]]:
    """(step, kind, name, cost) of a relation's plan, outermost first; a last step names an expensive plan."""
    t = policy.type(type_name)
    rule = t.relation(relation) if t else None
    if rule is None:
        raise PolicyError(f"no relation {relation} of {type_name}")
    out = [(i, type(x).__name__, getattr(x, "name", getattr(x, "through", "")), cost(x)) for i, x in enumerate(walk(rule.expr) if rule.expr else [This()])]
    if cost(rule.expr) > 20:
        out.append((len(out), "hint", "expensive", cost(rule.expr)))
    return out
