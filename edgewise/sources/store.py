"""Versioned relationships as an append-only change log on Parquet."""

from __future__ import annotations

import json
import uuid
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.entities import DELETE_LIMIT, entity_type, filter_error, key_order, relationship_error

KEY = ["resource", "relation", "subject"]
TUPLE = "resource string, relation string, subject string"
LOG = "revision long, operation string, resource string, relation string, subject string, timestamp_nanos long, vault long"
COMMIT = "revision long, operation string, folder string, rows long"


class RevisionMismatch(ValueError):
    pass


def intervals(log: DataFrame, latest_only: bool = False) -> DataFrame:
    """(resource, relation, subject, created_at, deleted_at): the times each tuple lives, from a log in which repeated creates and deletes of what is already so have no effect."""
    own = Window.partitionBy(*KEY).orderBy("revision")
    effective = log.withColumn("was", F.lag("operation", 1, "delete").over(own)).where("operation != was")
    out = effective.withColumn("deleted_at", F.lead("revision").over(own)).where("operation = 'create'").select(*KEY, F.col("revision").alias("created_at"), "deleted_at")
    if latest_only:
        out = out.withColumn("n", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("created_at")))).where("n = 1").drop("n")
    return out


def visible(rows: DataFrame, revision) -> DataFrame:
    """Tuples of intervals() that live at a revision (a number or a column)."""
    at = F.lit(revision) if isinstance(revision, int) else revision
    return rows.where((F.col("created_at") <= at) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > at)))


def as_of(log: DataFrame, asked: DataFrame) -> DataFrame:
    """(req_id, decision) for asked (req_id, resource, relation, subject, at): whether the tuple lives at revision `at`.

    The last operation on the tuple up to `at` decides, so a key with c changes and r requests costs c + r rows in one
    sort, not c * r pairs. A key's changes and requests are sorted together; spilling is Spark's.
    """
    rows = log.select(*KEY, F.col("revision").alias("at"), F.col("operation"), F.lit(None).cast("long").alias("req_id"))
    rows = rows.unionByName(asked.select(*KEY, "at", F.lit(None).cast("string").alias("operation"), F.col("req_id").cast("long").alias("req_id")))
    own = Window.partitionBy(*KEY).orderBy("at", F.col("req_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("last", F.last("operation", ignorenulls=True).over(own)).where("req_id is not null")
    return rows.select("req_id", F.when(F.col("last") == "create", "allow").otherwise("deny").alias("decision"))


def read_changes(log: DataFrame, start: int, types: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Changes from a revision on (inclusive), of resources of some types, in the order of revision and key."""
    out = log.where(F.col("revision") >= start)
    if types:
        out = out.where(entity_type(F.col("resource")).isin(types))
    out = out.orderBy("revision", key_order())
    return out.limit(limit) if limit is not None else out


class Store:
    """Vaults of tuples, as commits. Each non-empty write takes one revision, even if it changes nothing.

    A commit is a small file named by its revision that points to a folder of changes. It is created exclusively after
    the changes are written, so a revision exists as a whole or not at all and of two writers only one gets it; the other
    raises RevisionMismatch or, without an expected revision, tries again on the new state. Folders that no commit points
    to are never read. checkpoint() writes a snapshot, from which later snapshots are replayed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, folder: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(folder)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def commits_path(self, vault: int) -> str:
        return f"{self.path}/commits/vault={vault}"

    def _names(self, folder: str) -> list[str]:
        fs, at = self._files(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def written(self, folder: str) -> bool:
        """Whether Spark has finished writing a folder."""
        return "_SUCCESS" in self._names(folder)

    def _create(self, file: str, text: str) -> bool:
        """Whether the file is new; it is never overwritten."""
        fs, at = self._files(file)
        try:
            out = fs.create(at, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def revision(self, vault: int) -> int:
        names = [n for n in self._names(self.commits_path(vault)) if n.endswith(".json")]
        return int(names[-1][:20]) if names else 0

    def log(self, vault: int, after: int = 0) -> DataFrame:
        """Changes of all commits with a revision above `after`."""
        empty = self.spark.createDataFrame([], LOG).drop("vault")
        if self.revision(vault) <= after:
            return empty
        commits = self.spark.read.schema(COMMIT).json(self.commits_path(vault)).where(F.col("revision") > after)
        folders = [r[0] for r in commits.select("folder").distinct().collect()]
        return self.spark.read.schema(empty.schema).parquet(*[f"{self.path}/changes/{f}" for f in folders])

    def log_revision(self, vault: int) -> int:
        return self.log(vault).agg(F.coalesce(F.max("revision"), F.lit(0))).first()[0]

    def checkpoint(self, vault: int) -> int:
        """Writes the snapshot of the latest revision; snapshots from there on start at it."""
        at = self.revision(vault)
        folder = f"{at:020d}-{uuid.uuid4().hex}"
        self.snapshot(vault).write.parquet(f"{self.path}/snapshots/vault={vault}/{folder}")
        self._create(f"{self.path}/checkpoints/vault={vault}/{at:020d}.json", folder)
        return at

    def snapshot(self, vault: int, revision: int = 0) -> DataFrame:
        """Tuples that live at a revision; 0 is the latest."""
        at = revision or self.revision(vault)
        marks = [n for n in self._names(f"{self.path}/checkpoints/vault={vault}") if n.endswith(".json") and int(n[:20]) <= at]
        if not marks:
            return visible(intervals(self.log(vault)), at).select(*KEY)
        mark = int(marks[-1][:20])
        folder = self.spark.read.text(f"{self.path}/checkpoints/vault={vault}/{marks[-1]}").first()[0]
        base = self.spark.read.schema("resource string, relation string, subject string").parquet(f"{self.path}/snapshots/vault={vault}/{folder}")
        log = base.select(F.lit(0).cast("long").alias("revision"), F.lit("create").alias("operation"), *KEY).unionByName(self.log(vault, mark).select("revision", "operation", *KEY))
        return visible(intervals(log), at).select(*KEY)

    def _commit(self, vault: int, operation: str, made, expected: int | None, tries: int = 20) -> tuple[int, int]:
        """made: a function of the revision that gives the rows to write. Returns the new revision and how many rows it has."""
        for _ in range(tries):
            now = self.revision(vault)
            if expected is not None and expected != now:
                raise RevisionMismatch(f"expected {expected}, is {now}")
            stamp = F.unix_micros(F.current_timestamp()) * 1000
            folder = f"{vault}-{now + 1:020d}-{uuid.uuid4().hex}"
            rows = made(now).select(F.lit(now + 1).cast("long").alias("revision"), F.lit(operation).alias("operation"), *KEY, stamp.alias("timestamp_nanos"))
            rows.write.parquet(f"{self.path}/changes/{folder}")
            n = self.spark.read.parquet(f"{self.path}/changes/{folder}").count()
            if self._create(f"{self.commits_path(vault)}/{now + 1:020d}.json", json.dumps({"revision": now + 1, "operation": operation, "folder": folder, "rows": n})):
                return now + 1, n
            if expected is not None:
                raise RevisionMismatch(f"expected {expected}, which another writer has taken")
        raise RevisionMismatch(f"other writers took the revision {tries} times")

    def write(self, vault: int, rows: DataFrame, expected: int | None = None) -> int:
        """Adds tuples; those that live already, or come twice, change nothing. A tuple that isn't well formed is an error. Returns the revision."""
        return self.write_counted(vault, rows, expected)[0]

    def write_counted(self, vault: int, rows: DataFrame, expected: int | None = None) -> tuple[int, int]:
        """As write(); returns the revision and how many tuples are new."""
        if "vault" in rows.columns and not rows.where(F.col("vault") != vault).isEmpty():
            raise ValueError("a tuple belongs to another vault")
        if bad := rows.select(relationship_error().alias("error")).where("error is not null").first():
            raise ValueError(bad.error)
        if rows.isEmpty():
            return self.revision(vault), 0
        return self._commit(vault, "create", lambda at: rows.select(*KEY).dropDuplicates().join(self.snapshot(vault, at) if at else self.log(vault), KEY, "left_anti"), expected)

    def delete(self, vault: int, resource: str | None = None, relation: str | None = None, subject: str | None = None, limit: int | None = None, expected: int | None = None) -> tuple[int, int]:
        """Deletes the living tuples that match, at most `limit` of them in the order of keys (0: no limit). Returns the revision and how many went."""
        if why := filter_error(resource, relation, subject):
            raise ValueError(why)

        def made(at: int) -> DataFrame:
            rows = matching(self.snapshot(vault, at) if at else self.log(vault), resource=resource, relation=relation, subject=subject)
            return rows.orderBy(key_order()).limit(limit) if limit else rows

        return self._commit(vault, "delete", made, expected)

    def delete_exact(self, vault: int, rows: DataFrame, expected: int | None = None) -> tuple[int, int]:
        """Deletes the tuples of a table; those that don't live change nothing. Returns the revision and how many went."""
        return self._commit(vault, "delete", lambda at: (self.snapshot(vault, at) if at else self.log(vault)).join(rows.select(*KEY).distinct(), KEY, "left_semi"), expected)

    def chosen(self, vault: int, filters: DataFrame, limit: int | None = None) -> DataFrame:
        """The living tuples that any row of filters (resource, relation, subject; null: any) matches, at most `limit` for each filter in the order of keys (0: no limit).

        Filters that ask by the same columns are one join on them, so many filters cost seven joins at most. All are judged on
        the same snapshot. A filter without a column, or with an entity that isn't type:id, is an error.
        """
        limit = DELETE_LIMIT if limit is None else limit
        entity = r"^[a-z0-9_]+:(?s:.+)$"
        bad = F.coalesce(*KEY).isNull() | ~F.coalesce(F.col("resource").rlike(entity), F.lit(True)) | ~F.coalesce(F.col("subject").rlike(entity), F.lit(True))
        if not filters.where(bad).isEmpty():
            raise ValueError("a filter needs a column, and its entities a type and an id")
        now, out = self.snapshot(vault), None
        for given in product((True, False), repeat=3):
            by = [k for k, g in zip(KEY, given) if g]
            if not by:
                continue
            of = filters.where(" AND ".join(f"{k} IS {'NOT ' if g else ''}NULL" for k, g in zip(KEY, given))).select(*by).distinct()
            found = now.join(of, by, "left_semi").select(*KEY)
            if limit and len(by) < len(KEY):
                own = Window.partitionBy(*by).orderBy(key_order())
                found = found.withColumn("n", F.row_number().over(own)).where(F.col("n") <= limit).drop("n")
            out = found if out is None else out.unionByName(found)
        return out.distinct()

    def delete_request(self, vault: int, limit: int | None = None, exact: DataFrame | None = None, **given) -> dict[str, int]:
        """A filter (with the default limit of requests), a table of exact tuples, or both: the last revision, and how many were asked for and went."""
        out = {"revision": self.revision(vault), "requested": 0, "deleted": 0}
        if exact is None and not given:
            raise ValueError("a filter or tuples are needed")
        if exact is not None:
            out["requested"] = exact.count()
            out["revision"], out["deleted"] = self.delete_exact(vault, exact)
        if given:
            out["revision"], n = self.delete(vault, limit=DELETE_LIMIT if limit is None else limit, **given)
            out["deleted"] += n
        return out


def matching(rows: DataFrame, **given) -> DataFrame:
    for k, v in given.items():
        if v is not None:
            rows = rows.where(F.col(k) == v)
    return rows


class Tenants:
    """Organizations and their vaults as dimension tables."""

    def __init__(self, organizations: DataFrame, vaults: DataFrame):
        self.organizations, self.vaults = organizations, vaults

    def organization(self, id_: int) -> DataFrame:
        return self.organizations.where(F.col("id") == id_)

    def list_organizations(self, limit: int | None = None) -> DataFrame:
        """In the order of ids as text, so 10 comes before 2."""
        out = self.organizations.orderBy(F.col("id").cast("string"))
        return out.limit(limit) if limit is not None else out

    def with_organization(self, id_: int, name: str) -> Tenants:
        if not self.organization(id_).isEmpty():
            raise ValueError(f"organization {id_} exists")
        return Tenants(self.organizations.unionByName(self._row(self.organizations, id=id_, name=name)), self.vaults)

    def with_vault(self, id_: int, organization: int, name: str) -> Tenants:
        """A new vault of an organization that exists."""
        if self.organization(organization).isEmpty():
            raise ValueError(f"no organization {organization}")
        if not self.vaults.where(F.col("id") == id_).isEmpty():
            raise ValueError(f"vault {id_} exists")
        return Tenants(self.organizations, self.vaults.unionByName(self._row(self.vaults, id=id_, organization=organization, name=name)))

    def moved(self, vault: int, organization: int) -> Tenants:
        """A vault under another organization; listings follow."""
        return Tenants(self.organizations, self.vaults.withColumn("organization", F.when(F.col("id") == vault, organization).otherwise(F.col("organization"))))

    def without_vault(self, vault: int) -> Tenants:
        return Tenants(self.organizations, self.vaults.where(F.col("id") != vault))

    @staticmethod
    def _row(like: DataFrame, **values) -> DataFrame:
        return like.sparkSession.range(1).select(*[F.lit(values.get(c)).cast(t).alias(c) for c, t in like.dtypes])

    def vaults_of(self, organization: int) -> DataFrame:
        return self.vaults.where(F.col("organization") == organization).orderBy("id")

    def without(self, organization: int) -> Tenants:
        """Both tables after an organization and its vaults are deleted."""
        return Tenants(self.organizations.where(F.col("id") != organization), self.vaults.where(F.col("organization") != organization))

    def orphans(self, relationships: DataFrame) -> DataFrame:
        """Tuples whose vault is gone; nothing deletes them."""
        return relationships.join(self.vaults.select(F.col("id").alias("vault")), "vault", "left_anti")
