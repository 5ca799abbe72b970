"""Grants as query operators: row and table permissions by semi-join, and CRUD bits by organisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

READ, CREATE, UPDATE, DELETE = 1, 2, 4, 8
VERBS = {"SELECT": READ, "EXPLAIN": READ, "WITH": READ, "SHOW": READ, "INSERT": CREATE, "CREATE": CREATE, "UPDATE": UPDATE, "ALTER": UPDATE, "SET": UPDATE, "DELETE": DELETE, "DROP": DELETE}


def verb_bit(sql: str) -> int:
    """The permission that a statement's first keyword asks for."""
    word = (sql.split(None, 1) or [""])[0].upper().rstrip("(;")
    if word not in VERBS:
        raise ValueError(f"no permission is known for {word!r}")
    return VERBS[word]


def subjects(roles: DataFrame, user: str) -> DataFrame:
    """(subject_kind, subject) of a user: itself and its roles. roles: (user, role)."""
    own = roles.sparkSession.createDataFrame([("user", user)], "subject_kind string, subject string")
    return own.unionByName(roles.where(F.col("user") == user).select(F.lit("role").alias("subject_kind"), F.col("role").alias("subject")).distinct())


def readable(df: DataFrame, table: str, grants: DataFrame, roles: DataFrame, user: str, perm: str = "read", key: str = "_id") -> DataFrame:
    """The rows of a table that a user may use.

    grants: (table, row_id or null for the whole table, subject_kind, subject, perm). A table without any grant is open;
    admin implies every permission; rows need a grant of their own or of the table. Catalyst gets one plan: a semi-join
    with the row grants, or everything where the table grant or openness holds.
    """
    mine = grants.where(F.col("table") == table)
    if mine.isEmpty():
        return df
    who = subjects(roles, user)
    ok = mine.where(F.col("perm").isin(perm, "admin")).join(who, ["subject_kind", "subject"], "left_semi")
    if not ok.where(F.col("row_id").isNull()).isEmpty():
        return df
    return df.join(ok.select(F.col("row_id").alias(key)).distinct(), key, "left_semi")


def effective(defaults: DataFrame, stored: DataFrame, principals: list[str]) -> DataFrame:
    """(resource, bits): OR over principals of the stored bits, or the default ones where none are stored.

    defaults: (resource, bits); stored: (principal, resource, bits)."""
    spark = defaults.sparkSession
    who = spark.createDataFrame([(p,) for p in principals], "principal string")
    every = defaults.withColumnRenamed("bits", "fallback").crossJoin(who)
    found = every.join(stored, ["principal", "resource"], "left")
    return found.groupBy("resource").agg(F.bit_or(F.coalesce("bits", "fallback").cast("int")).alias("bits"))


def allowed(bits: Column | str, verb: int) -> Column:
    return (F.col(bits) if isinstance(bits, str) else bits).bitwiseAND(F.lit(verb)) == verb


def masked(df: DataFrame, hidden: list[str], may_see: bool) -> DataFrame:
    """Columns that the user may not see become null."""
    return df if may_see else df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in hidden})
