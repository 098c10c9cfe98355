"""Join helpers for lookups whose key may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: A key is hot if more than one in HOT of all rows hold it, so there are at most HOT such keys.
HOT = 1000


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, spread_by: Sequence[str],
                salts: int | None = None) -> DataFrame:
    """Join a large left side with a right side that has few rows per key.

    Left rows of one key are spread over `salts` sub-keys by a hash of `spread_by`; each right row is repeated once
    per sub-key; by default there are as many sub-keys as shuffle partitions, so a hot key can fill them all. The
    result equals the plain join. Adaptive execution still turns it into a broadcast when the right side is measured
    to be small.
    """
    salts = salts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salting keeps every left row in exactly one sub-key; {how} joins need both sides whole")
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    joined = left.withColumn("_salt", salt).join(right.withColumn("_salt", copies), [*on, "_salt"], how)
    return joined.drop("_salt")


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread_by: Sequence[str], how: str = "inner", most_hot: int = HOT) -> DataFrame:
    """left joined (inner or left) with a right side that has one row per key, or a few, where some keys may hold most of left's rows.

    Hot keys, those of more than one in `most_hot` rows, are counted first; there are at most so many of them, so their right rows are a broadcast of proven size. The other rows
    are shuffled by their key; rows of hot keys are spread over that shuffle and meet no partner in it. Neither side is
    repeated, and everything is part of one plan. Keys that are null meet nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"a lookup is an inner or a left join, not {how}")
    extra = [c for c in right.columns if c not in on]
    counts = left.groupBy(*on).agg(F.count("*").alias("_rows"))
    hot = counts.filter(F.col("_rows") * most_hot > counts.agg(F.sum("_rows")).scalar()).select(*on).join(right, list(on)) \
        .select(*on, F.struct(F.lit(True).alias("_met"), *extra).alias("_hot"))
    marked = left.join(F.broadcast(hot), list(on), "left")
    place = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*spread_by), F.lit(1 << 20))).cast("int")
    cold = right.select(*on, F.lit(0).alias("_place"), F.struct(F.lit(True).alias("_met"), *extra).alias("_cold"))
    both = marked.withColumn("_place", place).join(cold, [*on, "_place"], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    kept = both.filter("_found._met") if how == "inner" else both
    return kept.select(*left.columns, *[F.col("_found")[c].alias(c) for c in extra])


#: Bits of a membership filter: 1 MB; more keys than an eighth of it only weaken the filter.
MEMBER_BITS = 1 << 23
_BLOCK = 1 << 15  # bits of one value of bitmap_construct_agg


def may_be_member(keys: DataFrame, on: Sequence[str], bits: int = MEMBER_BITS) -> Column:
    """A condition on rows with the same columns: false only if their key is not among `keys`; a few others pass too.

    One bit per key hash, set in tasks and merged as bitmaps, so that at most bits / 32768 rows of 4 KB come together, however many
    keys there are. The filter is a subquery of the plan: it is tested inside the scan, before any shuffle.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(bits))
    blocks = keys.select(place.alias("p")).groupBy(F.expr(f"cast(p div {_BLOCK} as int)").alias("block")).agg(F.bitmap_construct_agg(F.col("p") % _BLOCK).alias("bitmap"))
    held = blocks.agg(F.map_from_entries(F.collect_list(F.struct("block", "bitmap"))).alias("m"))
    by_number = held.select(F.transform(F.sequence(F.lit(0), F.lit(max(1, bits // _BLOCK) - 1)), lambda b: F.try_element_at("m", b))).scalar()
    bitmap = F.get(by_number, F.floor(place / _BLOCK).cast("int"))
    byte = F.conv(F.hex(F.substring(bitmap, F.floor((place % _BLOCK) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
