"""Exact quantiles per group by selection: wanted ranks are narrowed by counting, never by sorting a group.

A double is mapped to a whole number of the same order. Each pass counts rows by the next bits of that number, for all
groups and wanted ranks at once, and keeps the part that a rank falls into. Only parts of a bounded size are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.session import settle

#: Bits of the ordered number that a pass counts by; values of a part that are ranked in one task.
PART_BITS = 16
MOST_RANKED = 100_000
METHODS = ("continuous", "midpoint")


def with_group_values(df: DataFrame, by, per_group: DataFrame) -> DataFrame:
    """``df`` with the columns of its group's row in ``per_group``; null groups match."""
    names = {name: f"_of_{name}" for name in by}
    side = per_group.withColumnsRenamed(names)
    same = F.lit(True)
    for name in by:
        same = same & F.col(name).eqNullSafe(F.col(names[name]))
    return df.join(side, same).drop(*names.values())


def ordered_bits(x: str) -> Column:
    """A long that orders as the double column ``x`` does: exponent and fraction of its size as in its binary form, with
    the sign. Both zeros are 0, infinity lies beyond all numbers, NaN beyond infinity.

    SQL has no access to the bits of a double. The exponent comes from the logarithm, put right where that was rounded
    across a power of two; dividing by a power of two is exact, so the fraction is whole after scaling.
    """
    size, guess = f"abs({x})", f"cast(floor(log2(abs({x}))) AS int)"
    power = "pow(2D, e)"
    exact = f"CASE WHEN {size} < {power} THEN e - 1 WHEN {size} / {power} >= 2D THEN e + 1 ELSE e END"
    normal = f"(g + 1023L) * 4503599627370496L + cast(({size} / pow(2D, g) - 1D) * 4503599627370496D AS bigint)"
    number = f"get(transform(transform(array({guess}), e -> {exact}), g -> {normal}), 0)"
    least_normal, least = "2.2250738585072014E-308D", "4.9E-324D"
    tiny = f"cast({size} / {least} AS bigint)"  # below the least normal number the fraction alone counts
    bits = (f"CASE WHEN isnan({x}) THEN 9223372036854775807L WHEN {x} = 0D THEN 0L WHEN {size} = double('Infinity') THEN 9218868437227405312L "
            f"WHEN {size} < {least_normal} THEN {tiny} ELSE {number} END")
    return F.expr(f"CASE WHEN {x} < 0D THEN -1L ELSE 1L END * {bits}")


def exact_quantiles(df: DataFrame, value: str, probabilities, by, method: str = "continuous", most: int = MOST_RANKED) -> DataFrame:
    """(by…, q0, q1, …) as doubles, one column per probability; null values are not counted.

    ``continuous`` interpolates at rank (n - 1)·p, the usual definition; ``midpoint`` at rank n·p - 0.5, which the
    box plots of plotting libraries use. ``by`` names at least one column.

    A pass reads the values once and combines its counts map-side. Passes end when no wanted rank lies in a part of over
    ``most`` rows, after four at the latest: then a part holds one value. At most ``most`` values of a part are ranked
    in one task, however many rows a group has.
    """
    if method not in METHODS:
        raise ValueError(f"unknown quantile method {method!r}")
    by, probabilities = list(by), list(probabilities)
    each = range(len(probabilities))
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    keyed = rows.withColumn("_bits", ordered_bits("_x"))

    def rank_of(p: float) -> Column:
        last = (F.col("_total") - 1).cast("double")
        exact = last * F.lit(p) if method == "continuous" else F.col("_total") * F.lit(p) - 0.5
        return F.greatest(F.lit(0.0), F.least(exact, last))

    def located(counts: DataFrame, wanted: DataFrame, keys) -> DataFrame:
        """The part of each wanted rank, and the rank within it. ``counts``: keys…, _part, _size."""
        before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        placed = counts.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        found = with_group_values(placed, keys, wanted)
        return found.filter((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_size"))).select(
            *by, "_t", "_side", F.col("_part").alias("_place"), (F.col("_rank") - F.col("_start")).alias("_rank"), "_size")

    shift = 64 - PART_BITS
    counts = settle(keyed.groupBy(*by, F.shiftright("_bits", shift).alias("_part")).agg(F.count(F.lit(1)).alias("_size")), "parts")
    totals = settle(counts.groupBy(*by).agg(F.sum("_size").alias("_total")), "totals")
    ranks = F.explode(F.array(*[
        F.struct(F.lit(i).alias("_t"), F.lit(side).alias("_side"), end(rank_of(p)).cast("long").alias("_rank"))
        for i, p in enumerate(probabilities) for side, end in (("lo", F.floor), ("hi", F.ceil))]))
    wanted = settle(located(counts, totals.select(*by, ranks.alias("_w")).select(*by, "_w.*"), by), "ranks")

    def inside(shift: int) -> DataFrame:
        """The values of the parts that hold wanted ranks; a part that several ranks want is taken once."""
        parts = wanted.select(*by, "_place").distinct()
        return with_group_values(keyed.withColumn("_place", F.shiftright("_bits", shift)), [*by, "_place"], parts)

    while shift and (wanted.agg(F.max("_size")).first()[0] or 0) > most:
        finer = shift - PART_BITS
        counts = inside(shift).groupBy(*by, "_place", F.shiftright("_bits", finer).alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
        wanted = settle(located(counts, wanted.drop("_size"), [*by, "_place"]), "ranks")
        shift = finer

    values = inside(shift).groupBy(*by, "_place", F.col("_x").alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    found = located(values, wanted.drop("_size"), [*by, "_place"]).groupBy(*by).agg(*[
        F.max(F.when((F.col("_t") == i) & (F.col("_side") == side), F.col("_place"))).alias(f"_{side}{i}") for i in each for side in ("lo", "hi")])
    joined = with_group_values(found, by, totals)

    def between(i: int, p: float) -> Column:
        fraction = rank_of(p) - F.floor(rank_of(p))
        apart = F.when(fraction == 0, F.lit(0.0)).otherwise((F.col(f"_hi{i}") - F.col(f"_lo{i}")) * fraction)
        return (F.col(f"_lo{i}") + apart).alias(f"q{i}")

    return joined.select(*by, *[between(i, p) for i, p in enumerate(probabilities)])
