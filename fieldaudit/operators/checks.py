"""Set and rule checks that return what violates them, with witnesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import join_same

NOT_LISTED, NOT_COVERED = "missing", "unexpected"


def key_set_violations(found: DataFrame, expected: DataFrame, keys, subset: bool = False) -> DataFrame:
    """(keys, problem, found, expected): keys on one side only, NULL being a key like others; empty if the sets are equal.

    ``missing`` keys are expected and not found, ``unexpected`` ones found and not expected.  With ``subset`` it is enough that
    everything expected is found.  The counts say how often each side holds the key.
    """
    keys = list(keys)
    sides = [d.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for d, n in ((found, "found"), (expected, "expected"))]
    both = sides[0].withColumn("expected", F.lit(0).cast("long")).unionByName(sides[1].withColumn("found", F.lit(0).cast("long")))
    both = both.groupBy(*keys).agg(F.sum("found").alias("found"), F.sum("expected").alias("expected"))
    problem = F.when(F.col("found") == 0, NOT_LISTED)
    if not subset:
        problem = problem.when(F.col("expected") == 0, NOT_COVERED)
    return both.withColumn("problem", problem).filter("problem IS NOT NULL").select(*keys, "problem", "found", "expected")


def lost_hits(smaller: DataFrame, larger: DataFrame, keys, hit: str) -> DataFrame:
    """(keys): hits of ``smaller`` that ``larger``, a superset of its inputs, has not kept; a key that it lacks is lost as well."""
    keys = list(keys)
    before = smaller.filter(F.coalesce(F.col(hit), F.lit(False))).select(*keys).distinct()
    after = larger.filter(F.coalesce(F.col(hit), F.lit(False))).select(*keys).distinct().withColumn("_kept", F.lit(True))
    return join_same(before, after, keys, "left").filter("_kept IS NULL").select(*keys)


def sanity_verdicts(cases: DataFrame, rules: dict[str, tuple[str, Column]], witness: str) -> DataFrame:
    """One row per rule: (rule, n, bad, share, passed, witness) over the cases it applies to.

    ``rules`` maps a name to (kind, flag): flag is true where a case speaks against the rule and NULL where the
    case can't be judged.  Kind ``none`` passes if no judged case does, ``few`` if at most one in twenty does,
    ``all`` if every case is judged and none speaks against it, and there is one.  The witness is the least such case.
    """
    tidy = []
    for name, (kind, flag) in rules.items():
        bad = F.coalesce(flag, F.lit(False))
        tidy.append(F.struct(F.lit(name).alias("rule"), F.lit(kind).alias("kind"), flag.alias("flag"), F.when(bad, F.col(witness)).alias("witness")))
    rows = cases.select(F.explode(F.array(*tidy)).alias("_r")).select("_r.*")
    agg = rows.groupBy("rule", "kind").agg(
        F.count("flag").alias("n"), F.count_if("flag").alias("bad"), F.count_if(F.col("flag").isNull()).alias("open"), F.min("witness").alias("witness"))
    share = F.col("bad") / F.greatest(F.col("n"), F.lit(1))
    passed = F.when(F.col("kind") == "none", F.col("bad") == 0).when(F.col("kind") == "few", share <= 0.05)
    passed = passed.otherwise((F.col("bad") == 0) & (F.col("open") == 0) & (F.col("n") > 0))
    return agg.select("rule", "n", "bad", share.alias("share"), passed.alias("passed"), "witness")
