"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with DataFrame functions only.

A text is cut into short paragraphs: a line, or of a long line the sentences that end behind ``SHORTEST`` characters
(``SHORTEST + LONGER`` at most).  Their distinct 64-bit digests go into cells: each digest is added to one cell of every sub-table, as a count, an exclusive or of digests and
one of check values.  The fingerprint is the first sketch of ``3 * CELLS[0]`` cells, whatever the text's size.

Two sketches subtract cell by cell; digests of both cancel.  Peeling takes a cell that holds a single digest, removes
it from its other cells, and goes on until nothing is left: what it took are the digests that differ.  If cells remain,
the sketch was too small.  Then both texts' digests are dealt by hash into blocks of a few digests with a sketch each, and a
block that fails is built anew with more cells and other hashes.  A block that fails at every size is compared
digest by digest, so the difference is always exact.  Work per document is nearly linear in its paragraphs.

Null texts are empty; two empty texts are alike (1), an empty and another one are not (0).  Equal texts have equal
fingerprints; a paragraph that repeats within a text counts once.  Rows with equal ids are ordered by their texts, null
ids come first; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ordered_blocks

SHORTEST, LONGER, PER_BLOCK = 100, 120, 3
#: Cells of one sub-table: of the fingerprint, then of the blocks at each try; three sub-tables fit 64 bits.
CELLS = [8, 5, 9, 14, 21]
_PIECE = rf"[^\n]{{1,{SHORTEST}}}[^.!?\n]{{0,{LONGER}}}[.!?\n]*|\n+"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PIECE), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _check(d: Column) -> Column:
    return F.xxhash64(d, F.lit(7)).bitwiseAND(F.lit(0x7FFFFFFF))


def _placed(signed: Column, attempt: int) -> Column:
    """Signed digests with their check value and the bits of their cells."""
    m = CELLS[attempt]
    bit = lambda g, j: F.call_function("shiftleft", F.lit(1).cast("long"), (F.pmod(F.shiftright(g, 20 * j), F.lit(m)) + j * m).cast("int"))
    bits = lambda g: bit(g, 0).bitwiseOR(bit(g, 1)).bitwiseOR(bit(g, 2))
    return F.transform(signed, lambda e: F.struct(
        e["d"].alias("d"), e["s"].alias("s"), _check(e["d"]).alias("c"), let(F.xxhash64(e["d"], F.lit(1000 + attempt)), bits).alias("at")))


def _cell(n: Column, d: Column, c: Column) -> Column:
    return F.struct(n.alias("n"), d.alias("d"), c.alias("c"))


def _nothing() -> Column:
    return _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))


def _here(e: Column, j: Column) -> Column:
    return F.getbit(e["at"], j) == 1


def sketch(signed: Column, attempt: int) -> Column:
    """The cells of signed digests (struct d, s)."""
    return let(_placed(signed, attempt), lambda placed: F.transform(F.sequence(F.lit(0), F.lit(3 * CELLS[attempt] - 1)), lambda j: F.aggregate(
        F.filter(placed, lambda e: _here(e, j)), _nothing(),
        lambda a, e: _cell(a["n"] + e["s"], a["d"].bitwiseXOR(e["d"]), a["c"].bitwiseXOR(e["c"])))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["d"].bitwiseXOR(y["d"]), x["c"].bitwiseXOR(y["c"])))


def peel(cells: Column, attempt: int, steps: Column) -> Column:
    """The signed digests that a subtracted sketch holds, or null where cells remain."""
    m = CELLS[attempt]
    pure = lambda x: F.when(F.abs(x["n"]) == 1, _check(x["d"]) == x["c"]).otherwise(F.lit(False))
    empty = F.array().cast("array<struct<d:bigint,s:int>>")

    def step(state: Column, _) -> Column:
        def remove(found: Column) -> Column:
            one = F.get(_placed(F.array(F.struct(found["d"].alias("d"), found["n"].alias("s"))), attempt), F.lit(0))
            return let(one, lambda e: F.struct(
                F.transform(state["cells"], lambda x, j: F.when(_here(e, j), _cell(x["n"] - e["s"], x["d"].bitwiseXOR(e["d"]), x["c"].bitwiseXOR(e["c"]))).otherwise(x)).alias("cells"),
                F.concat(state["out"], F.array(F.struct(e["d"].alias("d"), e["s"].alias("s")))).alias("out"), F.lit(True).alias("more")))

        stopped = F.struct(state["cells"].alias("cells"), state["out"].alias("out"), F.lit(False).alias("more"))
        return F.when(~state["more"], state).otherwise(let(F.get(F.filter(state["cells"], pure), F.lit(0)), lambda f: F.when(f.isNull(), stopped).otherwise(remove(f))))

    start = F.struct(cells.alias("cells"), empty.alias("out"), F.lit(True).alias("more"))
    left = lambda s: F.exists(s["cells"], lambda x: (x["n"] != 0) | (x["d"] != 0) | (x["c"] != 0))
    done = F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, step)
    return let(done, lambda s: F.when(~left(s), s["out"]))


def _signed(d: Column, sign: int) -> Column:
    return F.transform(d, lambda x: F.struct(x.alias("d"), F.lit(sign).alias("s")))


def _block(own: Column) -> Column:
    """The digests that differ within a block: ever larger sketches, then digest by digest."""
    tries = [peel(sketch(own, a), a, F.size(own)) for a in range(1, len(CELLS))]
    side = lambda s: F.transform(F.filter(own, lambda e: e["s"] == s), lambda e: e["d"])
    exact = F.concat(_signed(F.array_except(side(1), side(-1)), 1), _signed(F.array_except(side(-1), side(1)), -1))
    return F.coalesce(*tries, exact)


def _dealt(signed: Column, ways: Column, shift: int) -> Column:
    """``signed`` in ``ways`` groups by hash."""
    at = lambda e: F.pmod(F.shiftright(F.xxhash64(e["d"], F.lit(3)), shift), ways)
    return F.transform(F.sequence(F.lit(0), (ways - 1).cast("int")), lambda b: F.filter(signed, lambda e: at(e) == b))


def difference(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """Digests of one text only, signed 1 (first) or -1 (second), by subtracting, peeling and retrying larger."""
    first = peel(subtract(cells_a, cells_b), 0, F.lit(3 * CELLS[0]))

    def larger() -> Column:
        ways = F.greatest(F.ceil(F.sqrt((F.size(a) + F.size(b)) / PER_BLOCK)), F.lit(1)).cast("long")
        blocks = lambda part: F.flatten(F.transform(_dealt(part, ways, 24), lambda own: F.when(F.size(own) > 0, _block(own)).otherwise(own)))
        return F.flatten(F.transform(_dealt(F.concat(_signed(a, 1), _signed(b, -1)), ways, 0), blocks))

    return F.coalesce(first, larger())


def likeness(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """Shared over all distinct digests of two texts, from the difference of their sketches."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        let(F.size(difference(a, b, cells_a, cells_b)), lambda d: (both - d) / (both + d)))


def fingerprint(d: Column, cells: Column) -> Column:
    """The sketch as text: the number of digests, then count, digests and checks of each cell in hex."""
    wide = lambda x, n: F.lpad(F.hex(x), n, "0")
    return F.concat(F.size(d).cast("string"), F.lit(":"), F.array_join(F.transform(cells, lambda x: F.concat(wide(x["n"], 4), wide(x["d"], 16), wide(x["c"], 8))), ""))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, own, next_text, next_own)``: each text with its digests and sketch and those of the next document.

    Blocks of the id order are windowed alone; the first row of a block also stands at the end of the block before.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    block, count = ordered_blocks(rows, "doc_id")
    rows = rows.withColumn("b", block)
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))  # null ids come first
    lowest = rows.groupBy("b").agg(F.min(key).alias("key"))  # at most BLOCKS rows
    first = rows.withColumn("key", key).join(F.broadcast(lowest), ["b", "key"]).groupBy("b", "doc_id").agg(F.min("text").alias("text"))
    first = first.select("doc_id", "text", F.pmod(F.col("b") - 1, F.lit(count)).cast("int").alias("b"), F.lit(True).alias("guest"))
    dealt = rows.withColumn("b", F.col("b").cast("int")).withColumn("guest", F.lit(False)).select("doc_id", "text", "b", "guest").unionByName(first).repartition("b")
    dealt = dealt.withColumn("own", let(digests(F.col("text")), lambda d: F.struct(d.alias("d"), sketch(_signed(d, 1), 0).alias("cells"))))
    after = Window.partitionBy("b").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    seen = dealt.withColumn("next_text", F.lead("text").over(after)).withColumn("next_own", F.lead("own").over(after))
    return seen.filter(~F.col("guest")).select("doc_id", "text", "own", "next_text", "next_own")


def compare_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text (second half from the next document's beginning) and the next document."""
    rows = with_next(docs, id_col, text_col)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    own, after = F.col("own"), F.col("next_own")

    def told(text: Column) -> Column:
        return let(digests(text), lambda e: let(sketch(_signed(e, 1), 0), lambda ce: F.struct(
            F.sha2(text, 256).alias("sha"), fingerprint(own["d"], own["cells"]).alias("f"), fingerprint(e, ce).alias("fe"),
            likeness(own["d"], e, own["cells"], ce).alias("near_edited"), likeness(own["d"], after["d"], own["cells"], after["cells"]).alias("near_next"))))

    out = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), let(edited, told).alias("t"))
    return out.select(
        "doc_id", "n_chars", F.col("t.sha").alias("edited_sha256"), F.col("t.f").alias("fingerprint"), F.col("t.fe").alias("edited_fingerprint"),
        F.col("t.near_edited").alias("near_edited"), F.col("t.near_next").alias("near_next"))
