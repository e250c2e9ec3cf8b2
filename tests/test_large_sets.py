"""Block sets and radius joins beyond the size that one matrix or one broadcast takes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from fieldaudit.functions.hashing import md5_heads
from fieldaudit.operators import bootstrap as B


def _broadcasts_left(df) -> int:
    plan = df._jdf.queryExecution().toString()
    return plan[plan.index("== Physical Plan"):].count("BuildLeft")


@pytest.mark.parametrize("prefix", ["20260925|7|", "", "s" * 60 + "|"])
def test_md5_heads(prefix):
    for first, last in ((0, 1200), (9995, 10004), (16380, 16390), (5, 5)):
        want = [int(hashlib.md5(f"{prefix}{s}".encode()).hexdigest()[:8], 16) for s in range(first, last)]
        assert md5_heads(prefix, first, last).tolist() == want


def test_every_way_of_pooling(spark, monkeypatch):
    rows = [(s, b, d, (b * 7 + len(d or "")) % 5, None if b == 3 else b % 4) for s in ("u", "v") for b in range(40 if s == "u" else 9) for d in ("x", "y", None)]
    blocks = spark.createDataFrame(rows, "s string, b int, d string, k int, n int")
    parts = {"k": F.col("k"), "n": F.col("n")}
    run = lambda **more: sorted(B.pooled_draws(blocks, parts, "b", ["s"], ["d"], draws=50, **more).collect(), key=repr)
    matrix = run()
    sizes = spark.createDataFrame([("u", 40), ("v", 9)], "s string, n long")
    joined = run(plan=B.draw_slots(sizes, 50, by=["s"]))
    assert matrix == joined and len(matrix) == 2 * 3 * 50
    monkeypatch.setattr(B, "MATRIX_BLOCKS", 0)
    assert run() == joined  # one chunk a set
    monkeypatch.setattr(B, "CHUNK", 16)
    monkeypatch.setattr(B, "SLICE", 7)
    monkeypatch.setattr(B, "AT_ONCE", 3)
    assert run() == joined  # chunks, and draws counted in slices
    monkeypatch.setattr(B, "MATRIX_BLOCKS", 20)  # one set each way
    assert run() == joined
    whole = B.pooled_draws(blocks.filter("s = 'u'"), parts, "b", draws=50).orderBy("draw").collect()
    assert [r["k"] for r in whole] == [sum(r["k"] for r in joined if r["s"] == "u" and r["draw"] == d) for d in range(50)]


def test_counts_above_a_byte(spark, monkeypatch):
    monkeypatch.setattr(B, "MATRIX_BLOCKS", 0)
    monkeypatch.setattr(B, "_picks", lambda seed, draw, first, last, n: B.np.full(last - first, 2, B.np.uint32))
    blocks = spark.createDataFrame([(b, b) for b in range(700)], "b int, k int")
    third = B.hashed_ordinal(blocks, "b").filter("ordinal = 2").first()["k"]
    assert {r["k"] for r in B.pooled_draws(blocks, {"k": F.col("k")}, "b", draws=3).collect()} == {700.0 * third}


def test_block_sets_share_the_hashes_of_a_slice(spark, monkeypatch, tmp_path):
    """36 sets of 15,000 blocks hashed every slot 36 times."""
    log = str(tmp_path / "calls")
    picks = B._picks

    def logged(seed, draw, first, last, n):
        with open(log, "a") as f:
            f.write(f"{draw} {first}\n")
        return picks(seed, draw, first, last, n)

    monkeypatch.setattr(B, "MATRIX_BLOCKS", 0)
    monkeypatch.setattr(B, "SLICE", 16)
    blocks = spark.range(100).select((F.col("id") % 4 * (F.col("id") % 3)).alias("s"), F.col("id").alias("b"), (F.col("id") % 5).alias("k"))
    joined = B.pooled_draws(blocks, {"k": F.col("k")}, "b", ["s"], draws=6, plan=B.draw_slots(blocks.groupBy("s").agg(F.count(F.lit(1)).alias("n")), 6, by=["s"])).collect()
    monkeypatch.setattr(B, "_picks", logged)
    assert sorted(B.pooled_draws(blocks, {"k": F.col("k")}, "b", ["s"], draws=6).collect()) == sorted(joined)
    calls = open(log).read().splitlines()
    assert len(calls) == len(set(calls))


def test_picks_are_not_broadcast(spark):
    """Spark takes picks for as few rows as there are block sets; a plan that sends them to the driver grows with draws x blocks."""
    blocks = spark.range(5000).select(F.col("id").alias("b"), (F.col("id") % 3).alias("k"))
    assert _broadcasts_left(B.pooled_draws(blocks, {"k": F.col("k")}, "b", draws=20)) == 0
    plan = B.draw_slots(blocks.agg(F.count(F.lit(1)).alias("n")), 20)
    assert _broadcasts_left(B.pooled_draws(blocks, {"k": F.col("k")}, "b", draws=20, plan=plan)) == 0


def test_covers_are_not_broadcast(spark):
    """A query's cover is an explode, whose rows Spark does not count; a false-alarm join sent every cover to the driver."""
    import __spark_entry__ as entry

    for name in ("false_alarms_raw", "event_hits", "alarms_off_events"):
        df = entry.queries()[name](spark, "/root/testdata/sf0.1")
        plan = df._jdf.queryExecution().toString()
        plan = plan[plan.index("== Physical Plan"):]
        assert "BuildLeft" not in plan and "_lo0" in plan, name
        assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "_lo0" in line], name
