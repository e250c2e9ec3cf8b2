"""Caps, seeded samples and ordered picks.

Every sample ranks rows by a hash of (seed, key).  The filter on ``row_number`` lets Spark keep only
the first N rows per group on the map side, so a group that holds a third of the table still ships
only N rows per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import SEED, digest, pick, uniform
from ..session import cols, join_same


def first_per_group(df: DataFrame, n: int | Column, by, order) -> DataFrame:
    """The first ``n`` rows of each group in ``order``; adds ``rank``."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def cap_per_group(df: DataFrame, n: int | None, by, key, seed=SEED) -> DataFrame:
    """At most ``n`` rows per group, chosen by hash of (seed, by, key); ``None`` or ``n <= 0`` means no cap."""
    if n is None or n <= 0:
        return df
    key = [key] if isinstance(key, str) else list(key)
    mixed = digest(seed, *[F.col(c) for c in cols(by, key)])
    return first_per_group(df, n, by, [mixed, *key]).drop("rank")


def stratified_sample(df: DataFrame, quotas: dict[str, int], stratum: str, key: str, seed=SEED, prefix: str = "R") -> DataFrame:
    """Per stratum its quota of rows, then shuffled ids ``R01 ...`` in one hash order.

    The quotas bound the result, so numbering the picked rows is a small sort.
    """
    quota = F.coalesce(F.create_map(*[F.lit(v) for kv in quotas.items() for v in kv])[F.col(stratum)], F.lit(0))
    largest = max(quotas.values())
    chosen = first_per_group(
        df.filter(F.col(stratum).isin(*quotas)), largest, [stratum], [digest(seed, F.col(stratum), F.col(key)), key]
    ).filter(F.col("rank") <= quota).drop("rank")
    order = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(digest(f"{seed}.id", F.col(key)), key))
    return chosen.withColumn("review_id", F.concat(F.lit(prefix), F.lpad(order.cast("string"), 2, "0")))


def shuffled_slice(df: DataFrame, key: str, start: int, stop: int, seed=SEED) -> DataFrame:
    """Rows at positions [start, stop) of the seeded shuffle of all keys.

    Positions come from even hash blocks (no global sort); the slice boundary is exact.
    """
    from .ordered import running_total

    d = df.withColumn("_md", digest(seed, F.col(key)))
    d = d.withColumn("_block", F.conv(F.substring("_md", 1, 3), 16, 10).cast("int"))
    out = running_total(d, F.lit(1).cast("long"), ["_md", key], name="_pos")
    return out.filter((F.col("_pos") > start) & (F.col("_pos") <= stop)).drop("_pos", "_md", "_block")


def preferred(df: DataFrame, flag: Column, order, n: int) -> DataFrame:
    """First ``n`` rows, rows with ``flag`` before the others."""
    return df.orderBy(flag.desc(), *order).limit(n)


POISSON_TERMS, SHARE_MEAN = 120, 10


def poisson_count(mean: Column, u: Column) -> Column:
    """Poisson quantile of a uniform number, for means up to 40 (a longer series would add nothing)."""
    zero = F.struct(F.exp(-mean).alias("p"), F.lit(0.0).alias("c"), F.lit(0).alias("k"))

    def step(acc, i):
        c = acc["c"] + acc["p"]
        return F.struct(
            (acc["p"] * mean / (i + 1)).alias("p"), c.alias("c"),
            (acc["k"] + F.when(u >= c, 1).otherwise(0)).alias("k"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(POISSON_TERMS)), zero, step, lambda acc: acc["k"])


def random_alarms(surface: DataFrame, density: Column | float, vertex_area: float, by, key, seed=SEED) -> DataFrame:
    """Random baseline: a Poisson number of vertices per part of a surface, without replacement.

    ``by`` names the parts, for example the patch, of any size.  ``density`` is per unit area and
    ``vertex_area`` the area one vertex stands for.  A Poisson count over an area is the sum of
    independent counts over its shares, so each part is dealt by hash into shares that expect
    ``SHARE_MEAN`` alarms or a little more; the alarms of a share are its first k vertices in hash
    order, numbered by ``rank``.
    """
    by, key = list(by), list(key)
    density = density if isinstance(density, Column) else F.lit(float(density))
    sizes = surface.groupBy(*by).agg((density * F.count(F.lit(1)) * F.lit(vertex_area)).alias("_mean"))
    shares = sizes.select(*by, F.greatest(F.ceil(F.col("_mean") / SHARE_MEAN), F.lit(1)).cast("long").alias("_shares"))
    own = [F.col(c) for c in cols(by, key)]
    dealt = join_same(surface, shares, by).withColumn("_share", pick(F.col("_shares"), f"{seed}.share", *own)).drop("_shares")
    count = dealt.groupBy(*by, "_share").agg((density * F.count(F.lit(1)) * F.lit(vertex_area)).alias("_mean"))
    wanted = count.select(*by, "_share", poisson_count(F.col("_mean"), uniform(seed, *[F.col(c) for c in by], F.col("_share"))).alias("_k"))
    ranked = first_per_group(dealt, POISSON_TERMS + 1, [*by, "_share"], [digest(f"{seed}.vertex", *own), *key])
    return join_same(ranked, wanted, [*by, "_share"]).filter(F.col("rank") <= F.col("_k")).drop("_share", "_k")
