"""Scoping, keyed upserts, duplicates, hit/miss splits and ordered reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("pending", "failed", "rejected", "processing")


def scoped(sites: DataFrame, tenants: DataFrame, user: str) -> DataFrame:
    """Sites of the tenant that a user belongs to."""
    return sites.join(tenants.where(F.col("auth_id") == user).select(F.col("id").alias("tenant_id")), "tenant_id", "left_semi")


def zero_filled_counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Children of every parent, 0 where there are none."""
    counts = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ascending order, nulls first, as a partial aggregate (no sort of a key's rows)."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(F.lit(0).alias("__at"), *rest), F.struct(*order)).alias("__first")
    return df.groupBy(*keys).agg(first).select(*[F.col(c) if c in keys else F.col(f"__first.{c}").alias(c) for c in df.columns])


def last_write(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by a total order, as a partial aggregate (no sort of a key's rows)."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")
    return df.groupBy(*keys).agg(last).select(*keys, "__last.*")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], fill: bool = False) -> DataFrame:
    """Merge rows by key, the last incoming one winning; ``fill`` keeps old values where the new are null."""
    rest = [c for c in existing.columns if c not in keys]
    new = last_write(incoming, keys, order).select(*keys, F.struct(*rest).alias("__new"))
    joined = existing.select(*keys, F.struct(*rest).alias("__old")).join(new, keys, "full_outer")
    if fill:
        return joined.select(*keys, *[F.coalesce(f"__new.{c}", f"__old.{c}").alias(c) for c in rest])
    return joined.select(*keys, F.coalesce("__new", "__old").alias("__row")).select(*keys, "__row.*")


def get_or_create(existing: DataFrame, wanted: DataFrame, keys: list[str], fold_case: bool = False) -> DataFrame:
    """Existing rows and those wanted that are missing, one each."""
    fold = (lambda c: F.lower(c)) if fold_case else (lambda c: F.col(c))
    marks = {f"__k{i}": fold(k) for i, k in enumerate(keys)}
    new = wanted.withColumns(marks).dropDuplicates(list(marks)).join(existing.withColumns(marks).select(*marks), list(marks), "left_anti")
    return existing.unionByName(new.drop(*marks), allowMissingColumns=True)


def hits_and_misses(wanted: DataFrame, cached: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Cached rows that are wanted, and wanted keys that aren't cached."""
    return cached.join(wanted.select(key).distinct(), key, "left_semi"), wanted.join(cached.select(key), key, "left_anti")


def masters(rows: DataFrame, keys: list[Column], order: list[Column], id_col: str) -> DataFrame:
    """(id, master): the oldest row of each group stands for all; null keys are a group.

    Groups are reduced by a partial aggregate, and rows are joined to their group's one row.
    """
    named = rows.select(F.col(id_col), F.struct(*[F.struct(k.isNull().alias("none"), k.alias("k")).alias(f"k{i}") for i, k in enumerate(keys)]).alias("group"), F.struct(*order).alias("at"))
    named = named.withColumn("group", F.to_json("group", {"ignoreNullFields": "false"}))
    first = named.groupBy("group").agg(F.min_by(id_col, "at").alias("master"))
    return named.join(first, "group").select(id_col, "master")


def reassign(children: DataFrame, mapping: DataFrame, key: str, id_col: str) -> DataFrame:
    """Children with their parent replaced by its master."""
    to = mapping.select(F.col(id_col).alias(key), "master")
    return children.join(to, key, "left").withColumn(key, F.coalesce("master", key)).drop("master")


def set_status(rows: DataFrame, chosen: Column, status: str) -> DataFrame:
    """Change the status of chosen rows; unknown statuses are an error."""
    if status not in STATUSES:
        raise ValueError(f"status must be one of {', '.join(STATUSES)}")
    return rows.withColumn("status", F.when(chosen, F.lit(status)).otherwise(F.col("status")))


def without_property(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a property cleared, and how many had it."""
    return rows.withColumn(name, F.lit(None).cast(rows.schema[name].dataType)), rows.agg(F.count(name).alias("removed"))


def append(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows with new ones after them; columns that either lacks are null."""
    return existing.unionByName(new, allowMissingColumns=True)


def copy_on_hit(cached: DataFrame, wanted: DataFrame, key: str, id_col: str, **changed: Column) -> tuple[DataFrame, DataFrame]:
    """(copies of cached rows whose key is wanted, wanted rows that aren't cached).

    Copies take the ``changed`` columns and a surrogate id made of the old one and these.
    """
    hits, misses = hits_and_misses(wanted, cached, key)
    copies = hits.withColumns(changed)
    return copies.withColumn(id_col, F.xxhash64(F.col(id_col), *[F.col(c) for c in changed]).cast(cached.schema[id_col].dataType)), misses


def first_non_null(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The first value of each key, in order, that isn't null; null if there is none."""
    return rows.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def delete_counted(rows: DataFrame, chosen: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that are not chosen (null is not), and how many were."""
    doomed = F.coalesce(chosen, F.lit(False))
    return rows.where(~doomed), rows.agg(F.count(F.when(doomed, 1)).alias("deleted"))


def emptied(rows: DataFrame) -> DataFrame:
    """A table's columns without its rows, to overwrite it with."""
    return rows.limit(0)


def newest_first(rows: DataFrame, tenants: DataFrame, user: str, stamp: str, key: str) -> DataFrame:
    """A user's rows, newest first, ties by key."""
    return scoped(rows, tenants, user).orderBy(F.desc(stamp), key)
