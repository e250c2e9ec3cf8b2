"""Ordered operators over groups of any size.

A window over a whole group puts the group into one task.  These helpers cut the order of a group
into blocks (``block`` is any column that is monotone in the order), run the window inside
``(keys, block)``, and fix the seams with one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cols, join_same

def value_blocks(df: DataFrame, value: str, keys=(), name: str = "_block") -> DataFrame:
    """Add one of 1,000 block numbers, monotone in ``value``, cut at approximate quantiles of each key group.

    The cut points only balance the blocks; no result depends on where they lie.  A row finds its block
    digit by digit, nine comparisons each, which keeps the generated code small enough to be compiled.
    """
    keys = list(keys)
    n = 1000
    probs = "array(" + ", ".join(f"{i / n!r}D" for i in range(1, n)) + ")"
    cuts = df.groupBy(*keys).agg(F.expr(f"percentile_approx({value}, {probs}, {4 * n})").alias("_cuts"))
    if keys:
        cond = None
        renamed = cuts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_cuts")
        for k in keys:
            eq = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
            cond = eq if cond is None else cond & eq
        joined = df.join(renamed, cond).drop(*[f"_k_{k}" for k in keys])
    else:
        joined = df.crossJoin(F.broadcast(cuts))  # one row
    out, before = joined, "0"
    for step, digit in ((100, "_d1"), (10, "_d2"), (1, "_d3")):
        over = " + ".join(f"if({value} > _cuts[{before} + {step * i - 1}], 1, 0)" for i in range(1, 10))
        out = out.selectExpr("*", f"{over} as {digit}")
        before = f"{before} + {digit} * {step}"
    return out.selectExpr("*", f"{before} as {name}").drop("_cuts", "_d1", "_d2", "_d3")


def running_total(
    df: DataFrame, amount: Column, order, keys=(), block: str = "_block", name: str = "running", inclusive: bool = True
) -> DataFrame:
    """Running sum of ``amount`` in ``order`` within ``keys``, in two levels."""
    keys, order = list(keys), list(order)
    d = df.withColumn("_amount", amount)
    per_block = d.groupBy(*cols(keys, block)).agg(F.sum("_amount").alias("_sum"))
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    base = per_block.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(block).alias("_kb"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"),
    )
    cond = F.col(block) == F.col("_kb")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    end = 0 if inclusive else -1
    inside = W.partitionBy(*cols(keys, block)).orderBy(*order).rowsBetween(W.unboundedPreceding, end)
    out = d.join(base, cond).withColumn(
        name, F.col("_base") + F.coalesce(F.sum("_amount").over(inside), F.lit(0))
    )
    return out.drop("_amount", "_base", "_kb", *[f"_k_{k}" for k in keys])


def previous_row(df: DataFrame, columns, order, keys=(), block: str = "_block", prefix: str = "prev_") -> DataFrame:
    """Add ``prefix + c`` = value of each column on the previous row in ``order`` within ``keys``.

    Inside a block this is ``lag``; the first row of a block takes the last row of the nearest
    earlier block.
    """
    keys, order, columns = list(keys), list(order), list(columns)
    inside = W.partitionBy(*cols(keys, block)).orderBy(*order)
    last = df.groupBy(*cols(keys, block)).agg(F.max(F.struct(*order, *[F.col(c).alias(f"_v_{c}") for c in columns])).alias("_last"))
    seam = last.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(block).alias("_kb"),
        F.lag("_last").over(W.partitionBy(*keys).orderBy(block)).alias("_seam"),
    )
    cond = F.col(block) == F.col("_kb")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    d = df.withColumn("_first", F.row_number().over(inside) == 1)
    for c in columns:
        d = d.withColumn(f"_lag_{c}", F.lag(c).over(inside))
    d = d.join(seam, cond)
    for c in columns:
        d = d.withColumn(prefix + c, F.when(F.col("_first"), F.col(f"_seam._v_{c}")).otherwise(F.col(f"_lag_{c}")))
    return d.drop("_first", "_seam", "_kb", *[f"_lag_{c}" for c in columns], *[f"_k_{k}" for k in keys])


def hashed_ordinal(df: DataFrame, key: str, by=(), name: str = "ordinal") -> DataFrame:
    """0-based position of each distinct ``key`` in the order of (md5(key), key) within ``by``.

    The first three hex digits of the digest make 4,096 even blocks, so numbering needs no global sort.
    """
    d = df.withColumn("_md", F.md5(F.col(key).cast("string")))
    d = d.withColumn("_block", F.conv(F.substring("_md", 1, 3), 16, 10).cast("int"))
    out = running_total(d, F.lit(1).cast("long"), ["_md", key], keys=by, name=name)
    return out.withColumn(name, F.col(name) - 1).drop("_md", "_block")


def exact_percentiles(df: DataFrame, value: str, probs, keys=()) -> DataFrame:
    """Exact linear-interpolation percentiles per key group, columns ``p0, p1, ...`` and ``n``.

    Values are collapsed to distinct values with counts first, ranked by two-level running sums, and
    only the one or two rows around each wanted rank are read.  NULL and NaN values are ignored.
    """
    keys = list(keys)
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = clean.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_total(value_blocks(counts, value, keys), F.col("_c"), [value], keys=keys, name="_upto")
    total = counts.groupBy(*keys).agg(F.sum("_c").alias("n"))
    if keys:
        ranked = join_same(ranked, total, keys)
    else:
        ranked = ranked.crossJoin(F.broadcast(total))  # one row
    picks = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.floor(at), F.ceil(at)
        first, last = F.col("_upto") - F.col("_c"), F.col("_upto") - 1
        picks.append(F.max(F.when(low.between(first, last), F.col(value))).alias(f"_l{i}"))
        picks.append(F.max(F.when(high.between(first, last), F.col(value))).alias(f"_h{i}"))
    got = ranked.groupBy(*keys).agg(F.max("n").alias("n"), *picks)
    out = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("n") - 1)
        frac = at - F.floor(at)
        lo, hi = F.col(f"_l{i}").cast("double"), F.col(f"_h{i}").cast("double")
        out.append((lo + (hi - lo) * frac).alias(f"p{i}"))
    return got.select(*keys, "n", *out)
