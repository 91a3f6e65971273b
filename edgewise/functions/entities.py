"""Columns and codecs of entities `type:id`."""

from __future__ import annotations

import base64
import re
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_LIMIT, MAX_LIMIT, DELETE_LIMIT = 100, 1000, 1000


def entity_type(c: Column) -> Column:
    return F.substring_index(c, ":", 1)


def entity_id(c: Column) -> Column:
    """What stands between the first and the second colon; null without a colon."""
    return F.try_element_at(F.split(c, ":"), F.lit(2))


def wildcard(c: Column) -> Column:
    """The wildcard of the entity's type."""
    return F.concat(entity_type(c), F.lit(":*"))


def is_wildcard(c: Column) -> Column:
    return c.endswith(":*")


def matches(pattern: Column, subject: Column) -> Column:
    return (pattern == subject) | (is_wildcard(pattern) & (pattern == wildcard(subject)))


def glob(pattern: str) -> str:
    """A regular expression for rlike: * is any run, ? one character."""
    return r"(?s)\A" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + r"\z"


def key_order() -> Column:
    """Orders tuples by their joined key, byte by byte."""
    return F.concat_ws(":", "resource", "relation", "subject")


def entity_error(c: Column) -> Column:
    return (
        F.when(c.isNull() | (c == ""), "empty")
        .when(~c.contains(":"), "no type")
        .when(~entity_type(c).rlike(r"\A[a-z0-9_]+\z"), "bad type")
        .when(F.length(F.substring(c, F.length(entity_type(c)) + 2, F.length(c))) == 0, "empty id")
    )


def strict_error(c: Column) -> Column:
    return F.when(~c.rlike(r"\A[a-z_][a-z0-9_]*:[a-z0-9_-]+\z") | c.isNull(), "not type:id")


def wildcard_error(c: Column) -> Column:
    return F.when(is_wildcard(c) & ~c.rlike(r"\A[a-z0-9_]+:\*\z"), "bad wildcard")


def encode_offset(n: int) -> str:
    return base64.b64encode(struct.pack("<Q", n)).decode()


def decode_offset(token: str | None) -> int:
    return struct.unpack("<Q", base64.b64decode(token).ljust(8, b"\0")[:8])[0] if token else 0


def encode_cursor(revision: int) -> str:
    return base64.b64encode(str(revision).encode()).decode()


def decode_cursor(cursor: str) -> int:
    return int(base64.b64decode(cursor))


def _named(c: Column, name: str, wildcards: bool = False) -> Column:
    """The first thing wrong with a column of entities, as a message that names it."""
    format_ = F.when(is_wildcard(c), wildcard_error(c)).otherwise(entity_error(c)) if wildcards else entity_error(c)
    return F.when(c.isNull() | (c == ""), f"{name} cannot be empty").when(format_.isNotNull(), F.concat(F.lit(f"{name}: "), format_))


def _present(c: Column, name: str) -> Column:
    return F.when(c.isNull() | (c == ""), f"{name} cannot be empty")


def request_error(subject: str = "subject", resource: str = "resource", permission: str = "permission") -> Column:
    """What is wrong with a request; null if nothing is. What is empty comes before what has a wrong format."""
    s, r, p = F.col(subject), F.col(resource), F.col(permission)
    empty = F.coalesce(_present(s, "subject"), _present(r, "resource"), _present(p, "permission"))
    return F.coalesce(empty, _named(s, "subject"), _named(r, "resource"))


def relationship_error(resource: str = "resource", relation: str = "relation", subject: str = "subject") -> Column:
    """What is wrong with a tuple; its subject may be a wildcard."""
    r, n, s = F.col(resource), F.col(relation), F.col(subject)
    empty = F.coalesce(_present(r, "resource"), _present(n, "relation"), _present(s, "subject"))
    return F.coalesce(empty, _named(r, "resource"), _named(s, "subject", wildcards=True))


def filter_error(resource: str | None, relation: str | None, subject: str | None) -> str | None:
    """What is wrong with a filter: all of it missing, or an entity without a type or an id."""
    if resource is None and relation is None and subject is None:
        return "at least one field of the filter is needed"
    for name, x in (("resource", resource), ("subject", subject)):
        if x and not re.fullmatch(r"[a-z0-9_]+:.+", x, re.S):
            return f"{name}: not type:id"
    return None


def start_of(cursor: str | None, head: int, replay_head: bool = False) -> int:
    """The first revision a watcher sees: that of its cursor (an empty one: all), else what comes after the log's head; replay_head begins with the head itself."""
    if cursor is None:
        return head if replay_head else head + 1
    return 0 if cursor in ("", "0") else decode_cursor(cursor)
