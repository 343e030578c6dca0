"""The N highest-scoring items of every group by simultaneous per-group bisection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.runtime import cut

ID_BYTES = 7  # bytes of the identifier in one limb of the code
ID_BASE = 1 << (8 * ID_BYTES)


def score_code(x: Column) -> Column:
    """A bigint that orders like the double: its IEEE bits, built from arithmetic so that it stays in generated code.

    Negative numbers get the negated code of their size, so -0.0 equals 0.0; infinities come last and first.
    """
    a = F.abs(x)
    two = lambda e: F.pow(F.lit(2.0), e)
    e0 = F.greatest(F.lit(-1022), F.least(F.lit(1023), F.floor(F.log2(a)).cast("int")))
    m0 = a / two(e0)
    e = F.greatest(F.lit(-1022), e0 + F.when(m0 >= 2, 1).when(m0 < 1, -1).otherwise(0))
    m = a / two(e)
    part = F.lit(1 << 52).cast("bigint")
    code = F.when(m < 1, (m * part).cast("bigint")).otherwise((e + 1023).cast("bigint") * part + ((m - 1) * part).cast("bigint"))
    code = F.when(a == 0, F.lit(0).cast("bigint")).when(a == float("inf"), F.lit(2047 << 52).cast("bigint")).otherwise(code)
    return F.when(x < 0, -code).otherwise(code)


def id_limb(c: Column, k: Column) -> Column:
    """Limb k of a string identifier as a number: ID_BYTES bytes of its UTF-8, padded with zeros, above every limb past the string's end.

    Past the end the limb is the length, which orders strings that differ in trailing zero bytes.
    """
    raw = F.encode(c, "UTF-8")
    part = F.substring(raw, k * ID_BYTES + 1, F.lit(ID_BYTES))
    value = F.conv(F.rpad(F.hex(part), 2 * ID_BYTES, "0"), 16, 10).cast("bigint") + F.lit(ID_BASE)
    return F.when(k * ID_BYTES < F.octet_length(raw), value).otherwise(F.octet_length(raw).cast("bigint"))


def top_items(df: DataFrame, group: str, item: str, score: str, n: int, bits: int = 8) -> DataFrame:
    """(group, item, score) of the ``n`` best distinct items of each group: highest score first, equal scores by smaller item.

    An item's score is the highest of its rows. The order is that of a code made of limbs: the
    inverted bits of the score, then the bytes of the item. For every group at once, a round counts
    the rows in the 2^bits slices between the group's lowest and highest open code, which is what
    ``bits`` bisection steps with all their midpoints count; slices above the cutoff are in, those
    below are out, and only the cutoff's slice stays open. The first round's slices are the same for
    all groups, so it needs no join with bounds. A group ends when its cutoff slice is wholly in, so
    exactly ``n`` rows are left, or all rows of a smaller group.

    No group is gathered: counts are combined before each shuffle, histograms have at most 2^bits
    rows a group, and a group's rows are spread by a salt when they meet their bounds, the bounds being
    repeated once per salt.

    Edge cases: rows with null group, item or score, or a NaN score, count nowhere; repeated rows count
    once; infinite scores are ordinary; an empty table gives an empty result; other columns are ignored;
    n below 1 is an error.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    g, i, s = F.col(group).alias("g"), F.col(item).cast("string").alias("i"), F.col(score).cast("double").alias("s")
    base = df.select(g, i, s).where("g is not null and i is not null and s is not null and not isnan(s)").groupBy("g", "i").agg(F.max("s").alias("s"))
    base = cut(base.withColumn("c", -score_code(F.col("s"))))
    # first round: slices by sign, exponent and leading bits of the fraction, equal for all groups
    first = F.shiftright("c", 52 - bits // 2)
    hist = base.groupBy("g", first.alias("slice")).agg(F.count("*").alias("rows"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    bounds = cut(_cutoffs(hist.withColumn("k", F.lit(n)).withColumn("limb", F.lit(-1))))
    met = _meet(base.withColumn("slice", first), bounds)
    chosen, rows = [], cut(met)
    while True:
        chosen.append(rows.where("taken"))
        open_rows = rows.where("not taken")
        if open_rows.isEmpty():
            break
        # bounds equal in this limb: the group goes on to the next one
        tied = F.col("lo") == F.col("hi")
        moved = open_rows.select(
            "g", "i", "s", "k", F.when(tied, F.col("limb") + 1).otherwise(F.col("limb")).alias("limb"),
            F.when(tied, id_limb(F.col("i"), F.col("limb") + 1)).otherwise(F.col("c")).alias("c"),
            F.when(tied, 0).otherwise(F.col("lo")).cast("bigint").alias("lo"),
            F.when(tied, 2 * ID_BASE - 1).otherwise(F.col("hi")).cast("bigint").alias("hi"),
        ).withColumn("slice", _slice(bits)).drop("lo", "hi")
        hist = moved.groupBy("g", "slice", "k", "limb").agg(F.count("*").alias("rows"), F.min("c").alias("lo"), F.max("c").alias("hi"))
        rows = cut(_meet(moved.drop("k", "limb"), _cutoffs(hist)))
    return reduce(DataFrame.unionByName, chosen).select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score))


def _slice(bits: int) -> Column:
    """Which of 2^bits slices between lo and hi holds c; a range too wide for bigint is sliced in doubles, which is as monotone."""
    narrow = F.shiftright("hi", 1) - F.shiftright("lo", 1) < F.lit(1 << 61)
    whole = F.expr(f"(c - lo) div ((hi - lo) div {1 << bits} + 1)")
    real = F.expr(f"cast(floor((double(c) - double(lo)) / (double(hi) - double(lo)) * {(1 << bits) - 1}) as bigint)")
    return F.when(narrow, whole).otherwise(real)


def _cutoffs(hist: DataFrame) -> DataFrame:
    """Per group the slice that holds the k-th row, the rows still wanted from it, and its bounds."""
    w = Window.partitionBy("g").orderBy("slice")
    run = hist.withColumn("upto", F.sum("rows").over(w))
    size = F.sum("rows").over(Window.partitionBy("g"))
    last = run.withColumn("size", size).where(
        ((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("rows") < F.col("k"))) | ((F.col("size") < F.col("k")) & (F.col("upto") == F.col("size")))
    )
    return last.select(
        "g", F.col("slice").alias("cut_slice"), (F.col("upto") <= F.col("k")).alias("whole"),
        (F.col("k") - (F.col("upto") - F.col("rows"))).alias("k"), "limb", "lo", "hi",
    )


def _meet(rows: DataFrame, bounds: DataFrame, salts: int = 8) -> DataFrame:
    """Rows not below their group's cutoff slice; ``taken`` says which are in for good."""
    b = bounds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        rows.withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(salts)).cast("int"))
        .join(b, ["g", "salt"])
        .where("slice <= cut_slice")
        .select("g", "i", "s", "c", "k", "limb", "lo", "hi", ((F.col("slice") < F.col("cut_slice")) | F.col("whole")).alias("taken"))
    )
