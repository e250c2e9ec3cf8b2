"""Block bootstrap of pooled ratios.

Pooled recall and false alarms per length are ratios of sums, so one row ``(block, num, den)`` per
block is a sufficient statistic.  A draw picks as many blocks as there are, with replacement; the
pick is a hash of (seed, draw, slot), so a draw does not depend on partitioning, and every measure
over the same blocks sees the same picks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import SEED, md5_heads, pick
from ..session import cols, ship
from .ordered import hashed_ordinal

DRAWS = 2000
CHUNK = 4096
#: Blocks of a set that are pooled as one matrix, and the tasks that share its draws.
MATRIX_BLOCKS, DRAW_PARTS = 4096, 16
#: Slots of a draw that a task counts at once, the tasks that count larger sets, and the draws multiplied at once.
SLICE, TALLY_PARTS, AT_ONCE = 1 << 22, 64, 128


def draw_slots(sizes: DataFrame, draws: int = DRAWS, seed=SEED, by=()) -> DataFrame:
    """``(by, draw, ordinal)``: one row per pick; ``sizes`` has one row ``(by, n)`` per block set.

    The plan of a draw is spread in two steps (chunks of slots, then slots), so no task expands a
    whole plan even for millions of blocks.
    """
    by = list(by)
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))
    plan = (
        sizes.filter(F.col("n") > 0)
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        .withColumn("_chunk", chunks)
        .repartition("draw", "_chunk")
    )
    first = F.col("_chunk") * CHUNK
    last = F.least(first + (CHUNK - 1), F.col("n") - 1)
    slots = plan.withColumn("_slot", F.explode(F.sequence(first, last)))
    return slots.select(*by, "draw", pick(F.col("n"), seed, F.col("draw"), F.col("_slot")).alias("ordinal"))


def _picks(seed, draw: int, first: int, last: int, n: int) -> np.ndarray:
    """The ordinals that slots ``first`` to ``last - 1`` of a draw pick among ``n``, as :func:`draw_slots` has them."""
    return (md5_heads(f"{seed}|{draw}|", first, last) % n).astype(np.uint32)


def _matrix(columns, at: np.ndarray, n: int, series, parts) -> tuple[np.ndarray, np.ndarray]:
    """The first row of every series among the rows, and the values as one ``n`` x series matrix per part; ``at`` is a row's ordinal."""
    code = np.zeros(len(at), np.int64)
    for c in series:
        own = columns[c].dictionary_encode(null_encoding="encode")
        code = code * len(own.dictionary) + np.asarray(own.indices)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    values = np.zeros((len(parts), n, len(first)))
    for i, c in enumerate(parts):
        np.add.at(values[i], (at, code), np.nan_to_num(np.asarray(columns[c], np.float64)))
    return first, values


def _matrix_draws(packed: DataFrame, by, series, parts, draws: int, seed) -> DataFrame:
    """Sums per (by, series, draw) of block sets small enough for one matrix; ``packed`` has a row (by, n, _blocks) per set.

    A task takes a part of the draws: it counts how often each draw picks each block, once for all series, and
    multiplies these counts with the blocks' values.  No row per draw and block is made.
    """
    ship(packed.sparkSession)
    names, k = [*by, *series], len(by)
    types = dict(packed.dtypes)
    inner = packed.schema["_blocks"].dataType.elementType["_rows"].dataType.elementType
    schema = ", ".join([*[f"{c} {types[c]}" for c in by], *[f"{c} {inner[c].dataType.simpleString()}" for c in series], "draw int", *[f"{c} double" for c in parts]])

    def pool(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                n, part = (batch.column(k + i)[row].as_py() for i in range(2))
                blocks = batch.column(k + 2).slice(row, 1).flatten()
                rows = blocks.field("_rows")
                at = np.repeat(np.asarray(blocks.field("ordinal")), np.asarray(pc.list_value_length(rows)))
                flat = rows.flatten()
                first, values = _matrix({c: flat.field(c) for c in (*series, *parts)}, at, n, series, parts)
                own = range(part, draws, DRAW_PARTS)
                counts = np.zeros((len(own), n))
                for i, d in enumerate(own):
                    counts[i] = np.bincount(_picks(seed, d, 0, n, n), minlength=n)
                m = len(own) * len(first)
                columns = [pa.array([batch.column(i)[row].as_py()] * m, batch.schema.field(i).type) for i in range(k)]
                columns += [flat.field(c).take(pa.array(np.tile(first, len(own)))) for c in series]
                columns.append(pa.array(np.repeat(np.array(own, np.int32), len(first))))
                columns += [pa.array((counts @ v).ravel()) for v in values]
                yield pa.RecordBatch.from_arrays(columns, [*names, "draw", *parts])

    spread = packed.select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(DRAW_PARTS - 1))).alias("_part"), "_blocks")
    return spread.repartition(DRAW_PARTS, *by, "_part").mapInArrow(pool, schema)


def _tallies(sizes: DataFrame, by, draws: int, seed) -> DataFrame:
    """``(by, _chunk, draw, _counts)``: how often a draw picks each of a chunk's blocks, a byte per block.

    A task counts the picks of a slice of a draw's slots, so no pick becomes a row.  Counts above 255 go on in
    a further row of the same chunk and draw.  What a slot picks depends on the set by its size alone, so the sets of
    a slice come one after the other, the largest first, and share its hashes.
    """
    types, k = dict(sizes.dtypes), len(by)
    schema = ", ".join([*[f"{c} {types[c]}" for c in by], "_chunk long", "draw int", "_counts binary"])

    def tally(batches):
        of, heads = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                n, draw, start = (batch.column(k + i)[row].as_py() for i in range(3))
                if of != (draw, start):
                    of, heads = (draw, start), _picks(seed, draw, start, min(start + SLICE, n), 1 << 32)
                picks = heads[:n - start] % n
                edges = np.arange(0, n + CHUNK, CHUNK)
                if n <= SLICE:
                    whole = np.bincount(picks, minlength=n)
                else:  # few of the blocks are picked by one slice
                    picks = np.sort(picks)
                    cuts = np.searchsorted(picks, edges)
                chunks, rest = [], []
                for c in range(len(edges) - 1):
                    if n <= SLICE:
                        counts = whole[edges[c]:edges[c + 1]]
                    else:
                        counts = np.bincount(picks[cuts[c]:cuts[c + 1]] - edges[c], minlength=min(CHUNK, n - edges[c]))
                    while counts.any():
                        low = np.minimum(counts, 255).astype(np.uint8)
                        chunks.append(c)
                        rest.append(low.tobytes())
                        counts = counts - low
                same = [pa.array([batch.column(i)[row].as_py()] * len(chunks), batch.schema.field(i).type) for i in range(k)]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(chunks, pa.int64()), pa.array([draw] * len(chunks), pa.int32()), pa.array(rest, pa.binary())], [*by, "_chunk", "draw", "_counts"])

    spread = sizes.select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    spread = spread.select(*by, "n", "draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLICE).cast("long"))).alias("_start"))
    # a fixed number of tasks: their rows are few and small, but each stands for a slice of picks
    spread = spread.repartition(TALLY_PARTS, "draw", "_start").sortWithinPartitions("draw", "_start", F.desc("n"))
    return spread.mapInArrow(tally, schema)


def _chunk_draws(numbered: DataFrame, sizes: DataFrame, by, series, parts, draws: int, seed) -> DataFrame:
    """Sums per (by, series, draw) of block sets of any size: chunks of blocks meet the draws' counts of just these blocks."""
    ship(numbered.sparkSession)
    names = [*by, *series]
    flat = numbered.select(*by, "ordinal", F.inline("_rows"))
    flat = flat.join(sizes.select(*by), by) if by else flat.crossJoin(F.broadcast(sizes.select()))  # a row or none
    flat = flat.withColumn("_chunk", F.floor(F.col("ordinal") / CHUNK))
    types = dict(flat.dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in names], "draw int", *[f"{c} double" for c in parts]])

    def pool(blocks, counted):
        at = np.asarray(blocks["ordinal"]) % CHUNK
        if not len(at) or not len(counted):
            return pa.table([pa.array([], t) for t in [*[blocks.schema.field(c).type for c in names], pa.int32(), *[pa.float64()] * len(parts)]], names=[*names, "draw", *parts])
        columns = {c: blocks[c].combine_chunks() for c in (*names, *parts)}
        drawn, counts = np.asarray(counted["draw"]), counted["_counts"].combine_chunks()
        n = len(counts[0].as_py())
        first, values = _matrix(columns, at, n, series, parts)
        sums = []
        for i in range(0, len(drawn), AT_ONCE):
            own = np.frombuffer(b"".join(counts.slice(i, AT_ONCE).to_pylist()), np.uint8).reshape(-1, n).astype(np.float64)
            sums.append(np.stack([(own @ v).ravel() for v in values]))
        out = [columns[c].take(pa.array(np.tile(first, len(drawn)))) for c in names]
        out.append(pa.array(np.repeat(drawn, len(first)).astype(np.int32)))
        return pa.table([*out, *[pa.array(v) for v in np.concatenate(sums, axis=1)]], names=[*names, "draw", *parts])

    key = cols(by, "_chunk")
    met = flat.groupBy(*key).cogroup(_tallies(sizes, by, draws, seed).groupBy(*key)).applyInArrow(pool, schema)
    return met.groupBy(*cols(names, "draw")).agg(*[F.sum(a).alias(a) for a in parts])


def pooled_draws(blocks: DataFrame, parts: dict[str, Column], block: str, by=(), series=(), draws: int = DRAWS, seed=SEED, plan: DataFrame | None = None) -> DataFrame:
    """``(by, series, draw, parts)``: the sums of every part over the blocks that a draw picks.

    Block sets of up to ``MATRIX_BLOCKS`` blocks are pooled as one matrix, larger ones as a matrix per chunk of blocks;
    an injected ``plan`` joins its picks with the blocks.  All give the same picks.
    """
    by, series = list(by), list(series)
    rows = blocks.groupBy(*cols(by, block, series)).agg(*[F.sum(c).cast("double").alias(a) for a, c in parts.items()])
    packed = rows.groupBy(*cols(by, block)).agg(F.collect_list(F.struct(*series, *parts)).alias("_rows"))
    numbered = hashed_ordinal(packed, block, by=by).select(*by, "ordinal", "_rows")
    if plan is not None:
        # picks are many rows that Spark takes for few, so they are never to be broadcast
        flat = plan.hint("merge").join(numbered, cols(by, "ordinal")).select(*by, "draw", F.inline("_rows"))
        return flat.groupBy(*cols(by, series, "draw")).agg(*[F.sum(a).alias(a) for a in parts])
    sizes = packed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    few = sizes.filter(F.col("n") <= MATRIX_BLOCKS)
    fit = numbered.join(few, by) if by else numbered.crossJoin(F.broadcast(few))  # one row
    # at most MATRIX_BLOCKS blocks of a set meet in a row
    fit = fit.groupBy(*by, "n").agg(F.collect_list(F.struct("ordinal", "_rows")).alias("_blocks"))
    small = _matrix_draws(fit, by, series, list(parts), draws, seed)
    return small.unionByName(_chunk_draws(numbered, sizes.filter(F.col("n") > MATRIX_BLOCKS), by, series, list(parts), draws, seed))


def bootstrap_ratio(
    blocks: DataFrame,
    measures: dict[str, tuple[Column, Column]],
    block: str,
    by=(),
    series=(),
    draws: int = DRAWS,
    seed=SEED,
    scale: float = 1.0,
    plan: DataFrame | None = None,
    probs=(0.025, 0.975),
) -> DataFrame:
    """Percentile interval of ``scale * sum(num) / sum(den)`` per ``(by, series)``.

    ``by`` names the columns that define a block set of its own (a subset); ``series`` names columns
    that share the picks (detectors, radii).  ``measures`` maps an output name to (num, den); it
    yields ``<name>_lo``, ``<name>_hi``.  ``plan`` injects another resampling plan
    ``(by, draw, ordinal)``.  Draws whose pooled denominator is 0 are skipped.
    """
    by, series = list(by), list(series)
    parts = {}
    for m, (num, den) in measures.items():
        parts[f"{m}_num"], parts[f"{m}_den"] = num, den
    pooled = pooled_draws(blocks, parts, block, by, series, draws, seed, plan)
    wanted = []
    for m in measures:
        value = F.lit(scale) * F.col(f"{m}_num") / F.nullif(F.col(f"{m}_den"), F.lit(0.0))
        pooled = pooled.withColumn(f"{m}_v", value)
        wanted.append(F.percentile(f"{m}_v", list(probs)).alias(f"{m}_q"))
    ci = pooled.groupBy(*cols(by, series)).agg(*wanted)
    out = []
    for m in measures:
        out += [F.col(f"{m}_q")[0].alias(f"{m}_lo"), F.col(f"{m}_q")[1].alias(f"{m}_hi")]
    return ci.select(*cols(by, series), *out)


def unmixed_intervals(
    rows: DataFrame, flag: str, group: str, first, second, p_first: float, p_second: float, key: str, draws: int = DRAWS, seed=SEED, probs=(0.025, 0.975),
) -> DataFrame:
    """One row: the rates of ``flag`` in the two classes that both groups mix, with bootstrap intervals.

    A group's rate is p * true + (1 - p) * false with its share p of the first class.  Every row is a block; both
    groups are drawn on their own, and each draw solves its own pair of equations.  Rows without a flag or of another group are left out.
    Intervals aren't cut to [0, 1].
    """
    from ..functions.stats import unmix

    known = rows.filter(F.col(flag).isNotNull()).select(F.col(key).alias("_key"), F.col(group).alias("_group"), F.col(flag).cast("int").alias("_flag"))
    solved, whole = None, None
    for tag, value in (("a", first), ("b", second)):
        part = known.filter(F.col("_group") == F.lit(value))
        drawn = pooled_draws(part, {"k": F.col("_flag"), "n": F.lit(1)}, "_key", draws=draws, seed=f"{seed}.{tag}").select("draw", (F.col("k") / F.col("n")).alias(f"r_{tag}"))
        total = part.agg(F.avg("_flag").alias(f"r_{tag}"), F.count(F.lit(1)).alias(f"n_{tag}"))
        solved = drawn if solved is None else solved.join(drawn, "draw")
        whole = total if whole is None else whole.crossJoin(total)  # one row each
    both = lambda: unmix(F.col("r_a"), F.col("r_b"), F.lit(p_first), F.lit(p_second))
    t, f = both()
    ends = solved.select(t.alias("t"), f.alias("f")).agg(F.percentile("t", list(probs)).alias("t"), F.percentile("f", list(probs)).alias("f"))
    return whole.crossJoin(ends).select(  # one row each
        "n_a", "n_b", t.alias("true_rate"), f.alias("false_rate"), F.col("t")[0].alias("true_lo"), F.col("t")[1].alias("true_hi"),
        F.col("f")[0].alias("false_lo"), F.col("f")[1].alias("false_hi"))
