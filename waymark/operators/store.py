"""Tables of runs, evidence and overrides: latest rows, overlays, and checks that a session catalogue can't declare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import first_of_each

#: Columns that a user can't override.
FIXED_COLUMNS = ("id", "first_seen_run", "updated_at")
CRM_STATUSES = 9


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Rows of both, the latest version of each key; of equal versions the change."""
    both = table.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    return first_of_each(both, keys, [F.desc(version), F.desc("__new")]).drop("__new")


def apply_overrides(rows: DataFrame, overrides: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """rows with users' values (id, field, value) on top.

    A row of overrides is the lock and its value may be null, so the overlay
    asks whether the row exists. Unknown and fixed columns are ignored.
    """
    fields = [c for c in columns if c not in FIXED_COLUMNS]
    one = overrides.where(F.col("field").isin(*fields)).groupBy(F.col(id_col).alias("__id")).agg(
        F.map_from_entries(F.collect_list(F.struct("field", F.struct("value")))).alias("__locks")
    )
    joined = rows.join(one, F.col(id_col) == F.col("__id"), "left")

    def overlaid(c: str) -> Column:
        lock = F.col("__locks")[c]
        return F.when(lock.isNotNull(), lock["value"].cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c)

    return joined.select(*[overlaid(c) if c in fields else F.col(c) for c in rows.columns])


def violations(table: DataFrame, unique: Sequence[Sequence[str]] = (), domains: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(rule, n): how many keys or values break each uniqueness or domain rule; null keys are allowed."""
    parts = []
    for keys in unique:
        some = table.dropna(subset=list(keys)).groupBy(*keys).count().where("count > 1")
        parts.append(some.agg(F.lit(f"unique({', '.join(keys)})").alias("rule"), F.count(F.lit(1)).alias("n")))
    for c, values in (domains or {}).items():
        parts.append(table.where(F.col(c).isNotNull() & ~F.col(c).isin(*values)).agg(F.lit(f"domain({c})").alias("rule"), F.count(F.lit(1)).alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose reference has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
