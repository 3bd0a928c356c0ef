"""Semantic versions as comparable columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z\-]+(?:\.[0-9A-Za-z\-]+)*))?(?:\+[0-9A-Za-z.\-]+)?$"


def version_key(version: Column) -> Column:
    """A struct that orders as versions do (pre-releases before their release, numbers before
    words); null for what is no version."""
    part = lambda n: F.regexp_extract(version, PATTERN, n)
    pre = part(4)
    rank = lambda x: F.struct(F.when(F.rlike(x, F.lit(r"^\d+$")), 0).otherwise(1).alias("word"), F.coalesce(F.try_to_number(x, F.lit("999999999999999999")).cast("long"), F.lit(0)).alias("number"), F.when(F.rlike(x, F.lit(r"^\d+$")), "").otherwise(x).alias("text"))
    ids = F.when(pre == "", F.array().cast("array<struct<word:int,number:bigint,text:string>>")).otherwise(F.transform(F.split(pre, r"\."), rank))
    return F.when(F.rlike(version, F.lit(PATTERN)), F.struct(part(1).cast("long").alias("a"), part(2).cast("long").alias("b"), part(3).cast("long").alias("c"), (pre == "").cast("int").alias("released"), ids.alias("ids")))


def version_in_range(version: Column, least: Column, most: Column) -> Column:
    """Whether a version is within inclusive bounds; bounds that are missing or no versions do not
    bind, and a version that is none is in any range."""
    v, a, b = version_key(version), version_key(least), version_key(most)
    return v.isNull() | (F.coalesce(v >= a, F.lit(True)) & F.coalesce(v <= b, F.lit(True)))
