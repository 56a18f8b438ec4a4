"""Keyed changes of a table: updates of allowed columns, deletions and locks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def updated(rows: DataFrame, key: str, changes: DataFrame, allowed: list[str]) -> DataFrame:
    """rows with the columns of changes in place of their own, where the key is changed.

    changes has the key and columns to set, also to null; a column that isn't allowed
    is an error.  Changes of unknown or null keys do nothing; of several for one key
    the greatest in order of the columns counts.
    """
    fields = [c for c in changes.columns if c != key]
    unknown = sorted(set(fields) - set(allowed)) + sorted(set(fields) - set(rows.columns))
    if unknown:
        raise ValueError(f"columns that can't be set: {', '.join(dict.fromkeys(unknown))}")
    if not fields:
        return rows
    one = changes.groupBy(key).agg(F.max(F.struct(*fields)).alias("_set"))
    joined = rows.join(one, key, "left")
    value = lambda c: F.when(F.col("_set").isNotNull(), F.col("_set")[c]).otherwise(F.col(c)).alias(c)
    return joined.select(*[value(c) if c in fields else F.col(c) for c in rows.columns])


def forgotten(tables: list[DataFrame], key: str, gone: DataFrame) -> list[DataFrame]:
    """Each table without the rows whose key is in gone; rows without a key stay."""
    keys = gone.select(key).distinct()
    return [t.join(keys, key, "left_anti").select(*t.columns) for t in tables]


def against_locks(current: DataFrame, locks: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """current with first_run (there is no lock yet) and changed_since_lock (a field differs).

    A field that is null on one side only differs; a first run has changed nothing.
    locks has one row for each key.
    """
    before = locks.select(F.col(key), F.lit(True).alias("_locked"), *[F.col(c).alias(f"_was_{c}") for c in fields])
    differs = F.lit(False)
    for c in fields:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_was_{c}"))
    joined = current.join(before, key, "left")
    return joined.select(*current.columns, F.col("_locked").isNull().alias("first_run"), (F.col("_locked").isNotNull() & differs).alias("changed_since_lock"))


def locked(current: DataFrame, locks: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The locks after a run: those that were there, and current's for new keys."""
    new = current.join(locks.select(key), key, "left_anti").select(key, *fields)
    return locks.select(key, *fields).unionByName(new)
