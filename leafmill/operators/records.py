"""Reads, joins and rewrites of job, user and session records.

All operators are projections, filters, equi-joins and aggregations over
DataFrames, left to Catalyst: filters reach the scan, limits become a top-k,
and sides that only decide membership are semi- or anti-joined. Orders always
end in a unique key, so that pages of a listing never overlap. Points in time
are parameters, never the clock.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_all(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose columns equal the given values; a value of None sets no condition, a list means any of it."""
    tests = [F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v for c, v in wanted.items() if v is not None]
    return rows.where(functools.reduce(operator.and_, tests)) if tests else rows


def where_owned(rows: DataFrame, owner: str | None = None, status: str | None = None) -> DataFrame:
    """Rows of an owner and status, where the status counts only together with an owner, as the listing of translations has it."""
    return where_all(rows, owner_id=owner, status=status if owner is not None else None)


def by_id_policy(rows: DataFrame, column: str, policy: str) -> DataFrame:
    """Rows whose ids are UUIDs; others are refused (policy reject), dropped (drop), or kept with an ``error`` (mark)."""
    good = F.coalesce(F.col(column).rlike(r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit(False))
    if policy == "drop":
        return rows.where(good)
    if policy == "reject":
        return rows.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("not an id: "), F.coalesce(F.col(column), F.lit("null")))).cast("boolean")))
    return rows.withColumn("error", F.when(~good, F.concat(F.lit("not an id: "), F.coalesce(F.col(column), F.lit("null")))))


def page(rows: DataFrame, by: str = "created_at", key: str = "id", newest: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a listing, newest or oldest first, ties by ``key``."""
    first = F.col(by).desc() if newest else F.col(by).asc()
    listed = rows.orderBy(first, F.col(key).asc())
    return (listed.offset(offset) if offset else listed).limit(limit)


def latest_per(rows: DataFrame, group: str | list[str], by: str = "created_at", key: str = "id") -> DataFrame:
    """The newest row of each group, ties to the smallest ``key``; a window whose limit is pushed below the shuffle."""
    groups = [group] if isinstance(group, str) else group
    newest = Window.partitionBy(*groups).orderBy(F.col(by).desc(), F.col(key).asc())
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def with_latest(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, columns: Mapping[str, str]) -> DataFrame:
    """Every parent with columns of its newest child, or nulls; children are reduced before the join."""
    one = latest_per(children.where(F.col(child_key).isNotNull()), child_key)
    slim = one.select(F.col(child_key).alias(parent_key), *(F.col(c).alias(a) for c, a in columns.items()))
    return parents.join(slim, parent_key, "left")


def live_sessions(sessions: DataFrame, users: DataFrame, at: Column) -> DataFrame:
    """Sessions not expired at ``at`` with their enabled users; repeated rows of a session count once."""
    return (
        sessions.dropDuplicates(["session_id"]).where(F.col("expires_at") > at)
        .join(users.where(~F.coalesce(F.col("disabled"), F.lit(False))).select(F.col("id").alias("user_id"), "username", "role", "must_change_password"), "user_id")
    )


def patched(rows: DataFrame, changes: DataFrame, key: str, allowed: Iterable[str], at: Column | None = None, stamp: str = "updated_at", named: str | None = None) -> DataFrame:
    """Rows with the allowed columns of ``changes`` put in, where it has the key; columns that aren't allowed are ignored.

    ``named`` is the column of ``changes`` that lists the columns a change
    sets, to null as well; without it a null keeps the value. A change without
    an allowed column changes nothing; any other sets ``stamp`` to ``at``.
    """
    names = [c for c in allowed if c in changes.columns and c in rows.columns and c != key]
    if not names:
        return rows
    sets = F.array(*map(F.lit, names)) if named is None else F.coalesce(named, F.array().cast("array<string>"))
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in names), sets.alias("_sets"))
    new = new.withColumn("_hit", F.arrays_overlap("_sets", F.array(*map(F.lit, names))))
    joined = rows.join(new, key, "left")
    put = lambda c: F.coalesce(f"_{c}", c) if named is None else F.when(F.array_contains("_sets", c), F.col(f"_{c}")).otherwise(F.col(c))
    out = [put(c).alias(c) if c in names else F.when(F.col("_hit"), at).otherwise(F.col(c)).alias(c) if c == stamp and at is not None else F.col(c) for c in rows.columns]
    return joined.select(*out)


def backfilled(rows: DataFrame, column: str, value: object) -> DataFrame:
    """Nulls of a column replaced by one value."""
    return rows.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def without(rows: DataFrame, gone: DataFrame, key: str, gone_key: str | None = None) -> DataFrame:
    """Rows whose key isn't among the deleted ones; null keys stay."""
    return rows.join(gone.select(F.col(gone_key or key).alias(key)), key, "left_anti")


def cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Survivors of both tables when parents are deleted and children follow."""
    return without(parents, gone, key), without(children, gone, child_key, key)


def orphans(children: DataFrame, parents: DataFrame, child_key: str, key: str) -> DataFrame:
    """Children that name a parent which isn't there."""
    return children.where(F.col(child_key).isNotNull()).join(parents.select(F.col(key).alias(child_key)), child_key, "left_anti")


def artifacts(rows: DataFrame, kinds: Mapping[str, str], key: str = "id") -> DataFrame:
    """key, kind and path of every artifact that a row names; a null path is none."""
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("path")) for k, c in kinds.items()))
    return rows.select(key, F.explode(pairs).alias("a")).select(key, "a.kind", "a.path").where("path is not null")


def counted(rows: DataFrame, group: list[str], **tests: Column) -> DataFrame:
    """Rows of each group, and how many of them pass each test; one aggregation."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(t).alias(name) for name, t in tests.items()))


def same_name(users: DataFrame, column: str = "username") -> DataFrame:
    """Names that are equal but for case: the lower form, how many, and the smallest id."""
    return users.groupBy(F.lower(column).alias("name")).agg(F.count(F.lit(1)).alias("n_users"), F.min("id").alias("first_id")).where("n_users > 1")
