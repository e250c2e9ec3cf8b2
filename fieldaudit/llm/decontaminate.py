"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A seed is a hash of the tokens under a fixed mask of ``SPAN`` positions; positions outside the mask may differ.
Seeds of every token position of every document meet the seeds of every position of the benchmark items.  A hit is
verified on ``WINDOW`` tokens of the item around it: at least three quarters of them must stand at the same distance
in the document, or ``RUN`` of them in a row.  So substituted words do not hide a passage, a passage that was cut out of
an item is found, and a shared phrase does not make one.  Every run of ``RUN`` equal tokens holds a seed, and so does an
item of 15 tokens or more of which every fourth token was replaced.

The benchmark's seeds are broadcast in blocks of about ``BLOCK_SEEDS`` rows, cut by their contents, so a long item is
spread too; a larger benchmark takes more passes.  A window that many items share is looked up and verified once, and
its items are joined to the verified hits only.  Document windows are probed by the tokens that all masks share, the few
that pass are hashed under every mask and verified, all inside one stage; only verified hits are shuffled.

Tokens are lower-case runs of letters and digits.  Null and empty texts have none.  Items with fewer than ``LEAST``
tokens are no evidence and match nothing; items shorter than a mask use the mask's beginning.  Items of equal tokens
are searched once and all reported.  Rows that repeat a document id count as one document.  Empty tables give no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed masks: 1 takes the token, 0 ignores it.  The last one ignores every fourth token.
MASKS = ["111011011101", "110111100111", "101101111011", "110111011101"]
SPAN, WINDOW, LEAD, LEAST, BLOCK_SEEDS = 12, 24, 6, 8, 200_000
#: Equal tokens in a row that are evidence by themselves.
RUN = 13


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seed(h: Column, p: Column, mask: str, number: int) -> Column:
    return F.xxhash64(F.lit(number), F.lit(len(mask)), *[F.get(h, p + i) for i, c in enumerate(mask) if c == "1"])


def _windows(rows: DataFrame, span: int, keep: list[str]) -> DataFrame:
    """One row per position ``p`` that has ``span`` tokens; ``anchor`` hashes the tokens that every mask takes."""
    places = F.when(F.size("h") >= span, F.sequence(F.lit(0), F.size("h") - span))
    shared = [i for i in range(span) if all(m[i] == "1" for m in MASKS)]
    return rows.select(*keep, "h", F.explode(places).alias("p")).withColumn("anchor", F.xxhash64(F.lit(span), *[F.get("h", F.col("p") + i) for i in shared]))


def _seeds(windows: DataFrame, span: int, keep: list[str]) -> DataFrame:
    """One row per position and mask: ``seed`` and ``p``; ``h`` are hashed tokens."""
    seeds = F.array(*[_seed(F.col("h"), F.col("p"), m[:span], i) for i, m in enumerate(MASKS)])
    return windows.select(*keep, "h", "p", "anchor", F.explode(seeds).alias("seed"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, share: float = 0.75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``(doc_id, item_id, matched, width, first_token)``: documents that hold a passage of an item.

    ``matched`` of ``width`` tokens agree at the best hit; ``first_token`` is the first verified window's place in the document.
    ``doc_id`` keeps the type of ``id_col``, which need not be a number; rows without one count as one document.
    """
    hashed = lambda text: F.transform(tokens(text), lambda t: F.xxhash64(t))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), hashed(F.col(item_text).cast("string")).alias("h"))
    items = items.filter(F.col("item_id").isNotNull() & (F.size("h") >= LEAST)).distinct()
    kinds = items.groupBy("h").agg(F.min("item_id").alias("rep"))
    size = kinds.agg(F.sum(F.greatest(F.size("h") - SPAN + 1, F.lit(1)) * len(MASKS)).alias("n"), F.collect_set(F.when(F.size("h") < SPAN, F.size("h"))).alias("s")).first()
    spans, blocks = [SPAN, *sorted(size["s"])], -(-(size["n"] or 0) // BLOCK_SEEDS)
    own = kinds.withColumn("short", F.least(F.size("h"), F.lit(SPAN)))
    begin = F.greatest(F.lit(0), F.least(F.col("p") - LEAD, F.size("h") - WINDOW))
    windows = reduce(DataFrame.unionByName, [_seeds(_windows(own.filter(F.col("short") == n), n, ["rep"]), n, ["rep"]) for n in spans]).select(
        "anchor", "seed", "rep", (begin - F.col("p")).alias("shift"), F.slice("h", begin + 1, F.lit(WINDOW)).alias("expected"))
    windows = windows.withColumn("window", F.xxhash64("shift", "expected"))
    known, holders = windows.drop("rep").distinct(), windows.select("window", "rep").distinct()
    rows = docs.select(F.col(id_col).alias("doc_id"), hashed(F.col(text_col).cast("string")).alias("h"))
    found = None
    for b in range(max(blocks, 1)):
        part = known if blocks <= 1 else known.filter(F.pmod(F.xxhash64(F.lit("block"), "seed", "window"), F.lit(blocks)) == b)
        # both broadcasts are bounded, see above; few positions pass the anchors, and only these are hashed under all masks
        anchors = F.broadcast(part.select("anchor").distinct())
        near = [_seeds(_windows(rows, n, ["doc_id"]).join(anchors, "anchor", "left_semi"), n, ["doc_id"]) for n in spans]
        hits = reduce(DataFrame.unionByName, near).drop("anchor").join(F.broadcast(part.drop("anchor")), "seed")
        at = F.col("p") + F.col("shift")
        # comparisons are spelled out: they stay in the generated code of the scan, and no hit carries its document along
        same = reduce(lambda x, y: x + y, [F.when(F.get("expected", F.lit(k)) == F.get("h", at + k), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(WINDOW)])
        hits = hits.select("doc_id", "window", at.alias("at"), same.alias("same"), F.size("expected").alias("width"))
        hits = hits.filter((F.bit_count("same") >= F.col("width") * F.lit(share)) | F.contains(F.bin("same"), F.lit("1" * RUN)))
        hits = hits.select("doc_id", "window", "at", F.bit_count("same").alias("matched"), "width")
        found = hits if found is None else found.unionByName(hits)
    seen = found.groupBy("doc_id", "window").agg(F.max("matched").alias("matched"), F.max("width").alias("width"), F.min("at").alias("at")).join(holders, "window")
    best = seen.groupBy("doc_id", "rep").agg(F.max("matched").cast("long").alias("matched"), F.max("width").cast("long").alias("width"), F.greatest(F.min("at"), F.lit(0)).cast("long").alias("first_token"))
    members = items.join(kinds, "h").select("rep", "item_id")
    return best.join(members, "rep").select("doc_id", "item_id", "matched", "width", "first_token")


def oracle_sql() -> str:
    """The same in DuckDB SQL over ``documents`` and ``benchmark`` for items of at least ``SPAN`` tokens or fewer than ``LEAST``."""
    seeds = ", ".join("'" + str(i) + "'" + "".join(f" || ' ' || h[p + {k + 1}]" for k, c in enumerate(m) if c == "1") for i, m in enumerate(MASKS))
    cut = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    return f"""
        WITH d AS (SELECT doc_id, {cut} AS h FROM documents), i AS (SELECT item_id, {cut} AS h FROM benchmark),
        dp AS (SELECT doc_id, h, unnest(range(0, len(h) - {SPAN - 1})) AS p FROM d), ip AS (SELECT item_id, h, unnest(range(0, len(h) - {SPAN - 1})) AS p FROM i),
        ds AS (SELECT doc_id, p, unnest([{seeds}]) AS seed FROM dp), bs AS (SELECT item_id, p AS q, unnest([{seeds}]) AS seed FROM ip),
        hit AS (SELECT DISTINCT doc_id, item_id, p, q, greatest(0, least(q - {LEAD}, len(i.h) - {WINDOW})) AS b FROM ds JOIN bs USING (seed) JOIN i USING (item_id)),
        ver AS (SELECT doc_id, item_id, p - q + b AS "at", len(i.h[b + 1 : b + {WINDOW}]) AS width,
            list_filter(range(0, len(i.h[b + 1 : b + {WINDOW}])), lambda k: p - q + b + k >= 0 AND coalesce(d.h[p - q + b + k + 1] = i.h[b + k + 1], false)) AS same
            FROM hit JOIN d USING (doc_id) JOIN i USING (item_id))
        SELECT doc_id, item_id, max(len(same))::BIGINT AS matched, max(width)::BIGINT AS width, greatest(0, min("at"))::BIGINT AS first_token
        FROM ver WHERE len(same) >= 0.75 * width OR len(list_filter(range(0, len(same) - {RUN - 1}), lambda j: same[j + {RUN}] - same[j + 1] = {RUN - 1})) > 0
        GROUP BY doc_id, item_id"""
