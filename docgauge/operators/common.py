"""Building blocks the operators share: ordered limits that survive hot keys, and check rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docgauge import constants as K
from docgauge.functions.numbers import clamp01, round1

CHECK_COLUMNS = (
    "site_key", "check_ord", "id", "group", "category", "title", "status", "source", "max", "earned", "message", "fix",
    "evidence",
)
_SMALL_LIMIT = 64
_SALTS = 64


def first_n(df: DataFrame, keys: list[str], order: list[str | Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per key in the given order.

    ``row_number() <= n`` lets Spark drop all but ``n`` rows per key before the shuffle, so a key holding most of
    the data sends only ``n`` rows per task. Larger limits first cut within salted sub-groups, so that one key is
    never sorted whole in one task either.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    position = rank or "__rn"
    if n > _SMALL_LIMIT:
        salt = F.pmod(F.xxhash64(*order), F.lit(_SALTS))
        df = df.withColumn("__salt", salt)
        df = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(*order)))
        df = df.filter(F.col("__rn") <= n).drop("__rn", "__salt")
    ranked = df.withColumn(position, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = ranked.filter(F.col(position) <= n)
    return ranked if rank else ranked.drop(position)


def order_buckets(
    df: DataFrame, keys: list[str], order: Column, wanted: Column | None = None, per_bucket: int = 100_000, most: int = 4096, salts: int = 16
) -> DataFrame:
    """Adds ``__bucket`` (rising with ``order`` within a group) and ``__total`` (rows of the group): what ranks and running sums over groups
    of any size start from, as no group needs to lie in one task.

    A group of n rows gets about n / ``per_bucket`` splitters, ``most`` of them at the most expected: values of ``order`` whose hash, as a share
    of all hashes, is below that many in n. So buckets depend on the rows alone, and computing any of them again gives the same. Equal values
    share a bucket. Groups meet their splitters in ``salts`` parts.
    """
    rows = df.withColumns({"__order": order})
    hashed = F.xxhash64(*keys, "__order")
    rows = rows.withColumns({"__salt": F.pmod(hashed, F.lit(salts)), "__lot": F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))})
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("__salt")
    totals = df.groupBy(*keys).agg(F.count("*").alias("__total"))
    target = F.least(F.ceil(F.col("__total") / per_bucket), F.lit(most))
    drawn = rows.select(*keys, "__order", "__salt", "__lot").join(totals.select("*", every), [*keys, "__salt"])
    drawn = drawn.filter((F.col("__lot") * F.col("__total") < target) & F.col("__order").isNotNull())
    splits = drawn.groupBy(*keys).agg(F.sort_array(F.collect_set("__order")).alias("__splits"))
    known = totals.join(splits, keys, "left").select("*", every)
    bucket = F.coalesce(F.size(F.filter("__splits", lambda s: s <= F.col("__order"))), F.lit(0))
    return rows.join(known, [*keys, "__salt"]).withColumn("__bucket", bucket).drop("__splits", "__salt", "__lot", "__order")


def first_per(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    return first_n(df, keys, order, 1)


def numbered(df: DataFrame, keep: list[str | Column], values: str | Column, position: str, name: str) -> DataFrame:
    """Explodes an array with its positions.

    The outer form plus a filter on the position: a plain explode makes Spark test the array for emptiness below it,
    and pushing that test to the scan would compute an expensive array a second time.
    """
    rows = df.select(*keep, F.posexplode_outer(values).alias(position, name))
    return rows.filter(F.col(position).isNotNull())


def ordered_texts(ordinal: Column, text: Column, condition: Column, n: int) -> Column:
    """First ``n`` texts by ordinal, as an aggregate; for groups whose size a previous limit bounds."""
    kept = F.collect_list(F.when(condition, F.struct(ordinal.alias("o"), text.alias("t"))))
    return F.transform(F.slice(F.array_sort(kept), 1, n), lambda item: item["t"])


def native_check(
    df: DataFrame,
    check_id: str,
    check_ord: int,
    status: Column,
    credit: Column,
    message: Column,
    fix: Column | None = None,
    evidence: Column | None = None,
) -> DataFrame:
    """One ``check_results`` row per input row; a check that did not run earns null, never zero."""
    top = float(K.CHECK_POINTS[check_id])
    counts = credit.isNotNull() & ~status.isin("skip", "unverified")
    nothing = F.lit(None).cast("array<string>")
    found = nothing if evidence is None else F.when(F.size(evidence) > 0, evidence)
    return df.select(
        "site_key",
        F.lit(check_ord).alias("check_ord"),
        F.lit(check_id).alias("id"),
        F.lit(K.CHECK_GROUPS[check_id]).alias("group"),
        F.lit(K.CHECK_CATEGORIES[check_id]).alias("category"),
        F.lit(K.CHECK_TITLES[check_id]).alias("title"),
        status.alias("status"),
        F.lit("native").alias("source"),
        F.lit(top).alias("max"),
        F.when(counts, round1(F.lit(top) * clamp01(credit))).alias("earned"),
        message.alias("message"),
        (F.lit(None).cast("string") if fix is None else fix).alias("fix"),
        found.alias("evidence"),
    )
