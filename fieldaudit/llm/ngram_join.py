"""N-gram Jaccard join: documents whose sets of word n-grams overlap enough, exactly, as connected classes.

1. Documents become sets of hashed n-grams; equal sets are one class from here on.
2. Under one global order of n-grams, sets that reach the threshold share an n-gram among the first
   ``size - ceil(t * size) + 1`` of both.  The order puts frequent n-grams last (those in more than one of
   ``HOT_SHARE`` documents, counted over all documents), so common passages name few candidates.
3. Of the classes that share such an n-gram, those with no partner of a fitting size go, and groups whose pairs all meet
   in another group.  The others are first compared with their first partner only, which joins groups of copies with one exact comparison per member.
4. Where a group still holds several components, its classes go to size-banded tiles.  Bitmaps of parities bound the
   overlap of two sets from above (a bit that differs takes an element of one only); pairs of different
   components that may reach the threshold are compared exactly, as sorted arrays.  First the best pair of each class
   in a group, then all that are left.

Groups are streamed or cut into tiles of at most about ``2 * TILE`` classes, so no task holds a hot group.  No pair that
reaches the threshold is lost; n-grams are compared as 64-bit hashes.

Words are runs of anything but the six ASCII white space characters; A-Z count as lower case.  A text of fewer words than
n is one n-gram; texts without words (null or empty too) have no n-grams and are linked with nothing.  Rows that repeat a
document id are treated alike by their texts; null ids stay out of components of others and get a null id.  An empty table
gives no rows.  Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import giving_back, text_slices, written
from .grams import SPACE, mix, shingles, words

#: An n-gram is frequent from one in so many documents on; at most HOT_SHARE times the mean set size are.
HOT_SHARE, TILE, MOST = 8000, 2048, 1 << 20
#: Up to so many document ids are broadcast to fetch texts; more are joined.
BROADCAST_ROWS = 1_000_000
#: Pairs that a task remembers, so as not to tell them again.
TOLD = 500_000


def sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-grams of each text, one after the other, and their offsets."""
    grams, at = shingles(words(texts, SPACE), n)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    new[at[:-1][at[:-1] < len(grams)]] = True
    kept = np.append(0, np.cumsum(new))
    return grams[new], kept[at]


def needed(a, b, num: int, den: int):
    """The overlap from which sets of ``a`` and ``b`` elements reach the threshold num / den."""
    return -(-num * (a + b) // (num + den))


def _signature(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.append(np.uint64(0), np.cumsum(mix(grams ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64))
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def _ranges(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the first ``size`` elements behind each offset."""
    return np.repeat(at[:-1] - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _prefix(grams: np.ndarray, at: np.ndarray, hot: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n-grams of every set under the order (frequent, hash), and their numbers."""
    size = np.diff(at)
    many = np.where(size > 0, size - -(-num * size // den) + 1, 0)
    out = grams[_ranges(at, many)]
    if not len(hot):
        return out, many
    often = lambda g: hot[np.minimum(np.searchsorted(hot, g), len(hot) - 1)] == g
    ends = np.append(0, np.cumsum(many)).tolist()
    touched = np.flatnonzero(np.diff(np.append(0, np.cumsum(often(out)))[ends]) > 0)
    for i in touched.tolist():  # sets with a frequent n-gram among their first
        own = grams[at[i] : at[i + 1]]
        last = often(own)
        out[ends[i] : ends[i + 1]] = np.concatenate([own[~last], own[last]])[: many[i]]
    return out, many


def bits_for(num: int, den: int) -> int:
    """Bits an element of the bitmaps: sets at a lower threshold differ by more elements, of which fewer may fall on one bit."""
    return max(1, -(-12 * (den - num) // (den + num)))


def _bitmaps(grams: np.ndarray, at: np.ndarray, per: int = 1) -> list[bytes]:
    """For each set a bitmap of at least ``per`` bits per element, a power of two: whether an odd number of elements hash to a bit.

    The elements that two sets share cancel out, so few bits tell sets apart.
    """
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        wide = 1 << max(6, int(per * (b - a) - 1).bit_length())
        bits = (np.bincount((grams[a:b] & np.uint64(wide - 1)).astype(np.int64), minlength=wide) & 1).astype(np.uint8)
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return out


def _describe(docs: DataFrame, n: int, hot: np.ndarray, num: int, den: int, maps: bool = True) -> DataFrame:
    """``(doc_id, size, sig, prefix, bits)`` of every row."""

    per = bits_for(num, den)

    def run(batches):
        for batch in text_slices(batches, 1, 1 << 19):
            grams, at = sets(batch.column(1), n)
            first, many = _prefix(grams, at, hot, num, den)
            ends = np.append(0, np.cumsum(many)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at).astype(np.int32)), pa.array(_signature(grams, at)), pa.ListArray.from_arrays(pa.array(ends), pa.array(first.view(np.int64))), pa.array(_bitmaps(grams, at, per) if maps else [None] * len(batch), pa.binary())],
                ["doc_id", "size", "sig", "prefix", "bits"])

    return docs.mapInArrow(giving_back(run), "doc_id long, size int, sig long, prefix array<long>, bits binary")


def partners(key: np.ndarray, size: np.ndarray, comp: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by (key, size): whether a row of the same key, another component and a fitting size exists, and the first row that fits."""
    n = len(key)
    group = np.append(0, np.cumsum(key[1:] != key[:-1])) if n else np.zeros(0, np.int64)
    wide = int(size.max()) + 2 if n else 2
    place = group * wide + size
    low = np.searchsorted(place, group * wide + -(-size * num // den), "left")
    high = np.searchsorted(place, group * wide + np.minimum(size * den // num, wide - 1), "right")
    change = np.append(0, np.cumsum(comp[1:] != comp[:-1])) if n else np.zeros(0, np.int64)
    return change[np.maximum(high - 1, 0)] > change[low], low


def _streamed(rows: DataFrame, comp: str, num: int, den: int) -> DataFrame:
    """``(key, sig, size, comp, rep)`` of the rows (key, sig, size, comp) that have a partner; ``rep`` is their first one.

    Rows come sorted by key and size.  A group that a batch cuts is kept whole, as far as it holds two rows.
    """
    names = list(dict.fromkeys(["key", "sig", "size", comp]))

    def solve(key, sig, size, own, cut):
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
        key, sig, size, own = key[fresh], sig[fresh], size[fresh], own[fresh]
        keep, low = partners(key, size, own, num, den)
        for k in cut:
            keep |= key == k
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (key, sig, size, own, sig[low])], ["key", "sig", "size", "comp", "rep"])

    def run(batches):
        rest, cut = None, []
        for batch in batches:
            c = [np.asarray(batch.column(names.index(x)), np.int64) for x in ("key", "sig", "size", comp)]
            if rest is not None:
                c = [np.append(x, y) for x, y in zip(rest, c, strict=True)]
            begin = int(np.searchsorted(c[0], c[0][-1]))  # the last group may go on
            if begin == 0 and len(c[0]) > MOST:
                yield solve(*c, [*cut, c[0][-1]])
                rest, cut = [x[-1:] for x in c], [c[0][-1]]
                continue
            if begin:
                yield solve(*(x[:begin] for x in c), cut)
                cut = [k for k in cut if k == c[0][-1]]
            rest = [x[begin:] for x in c]
        if rest is not None and len(rest[0]):
            yield solve(*rest, cut)

    ordered = rows.select(*names).repartition(F.col("key")).sortWithinPartitions("key", "size", "sig")
    return ordered.mapInArrow(giving_back(run), "key long, sig long, size long, comp long, rep long")


def _thinned(members: DataFrame) -> DataFrame:
    """``members`` without the groups whose pairs all meet in another group as well.

    The main n-gram of a class is the one of its largest group.  Where all classes of a group have the same main
    n-gram, and it is another one, they all stand in that group too.
    """
    size = members.groupBy("key").agg(F.count(F.lit(1)).alias("k"))
    sized = members.select("key", "sig").join(size, "key")
    main = sized.groupBy("sig").agg(F.max(F.struct("k", "key")).alias("m")).select("sig", F.col("m.key").alias("main"))
    spread = sized.select("key", "sig").join(main, "sig").groupBy("key").agg(F.min("main").alias("a"), F.max("main").alias("b"))
    return members.join(spread.filter("a <> b or key = a").select("key"), "key", "left_semi")


def may_reach(a: bytes, size_a: int, b: bytes, size_b: int, num: int, den: int) -> bool:
    """Do the bitmaps of two sets leave room for the threshold?  The wider one folds onto the narrower."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    w = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(m.reshape(-1, w), axis=0) if len(m) > w else m for m in (x, y))
    bound = (size_a + size_b - int(np.bitwise_count(x ^ y).sum())) // 2
    return bound >= needed(size_a, size_b, num, den)


def _possible(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose bitmaps allow the threshold."""

    def run(batches):
        for b in batches:
            keep = [may_reach(*x, num, den) for x in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: classes.select(F.col("sig").alias(c), F.col("bits").alias(f"_{c}b"), F.col("size").cast("long").alias(f"_{c}n"))
    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "_ub", "_un", "_vb", "_vn").mapInArrow(giving_back(run), "u long, v long")


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (u, v) of classes whose sets reach the threshold, by exact intersection of their texts' sets."""
    pairs = written(pairs, "ngram-pairs")
    asked = written(pairs.select(F.col("u").alias("sig")).unionByName(pairs.select(F.col("v").alias("sig"))).distinct().join(classes, "sig").select("sig", F.col("first").alias("doc_id")), "ngram-asked")
    few = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked  # else the texts are shuffled

    def own(batches):  # rows may repeat an id with another text
        for batch in text_slices(batches, 1, 1 << 19):
            yield batch.filter(pa.array(_signature(*sets(batch.column(1), n)) == np.asarray(batch.column(0))))

    texts = written(rows.join(few, "doc_id").select("sig", "text").mapInArrow(giving_back(own), "sig long, text string").dropDuplicates(["sig"]), "ngram-texts")
    a = texts.select(F.col("sig").alias("u"), F.col("text").alias("_a"))
    b = texts.select(F.col("sig").alias("v"), F.col("text").alias("_b"))

    def run(batches):
        for batch in text_slices(text_slices(batches, 2, 1 << 19), 3, 1 << 19):
            x, xa = sets(batch.column(2), n)
            y, ya = sets(batch.column(3), n)
            keep = []
            for i in range(len(batch)):
                p, q = x[xa[i] : xa[i + 1]], y[ya[i] : ya[i + 1]]
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                keep.append(int((both[1:] == both[:-1]).sum()) >= needed(len(p), len(q), num, den))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return written(pairs.join(a, "u").join(b, "v").select("u", "v", "_a", "_b").mapInArrow(giving_back(run), "u long, v long"), "ngram-links")


def tile_pairs(sig, size, comp, band, salt, bits: list[bytes], low: int, crossing: bool, best: bool, num: int, den: int):
    """Pairs of different components in one tile whose bitmaps allow the threshold."""
    order = np.argsort(size, kind="stable")
    sig, size, comp, band, salt = (c[order] for c in (sig, size, comp, band, salt))
    maps = [np.frombuffer(bits[i], np.uint64) for i in order]
    width = np.array([len(m) for m in maps])
    folded: dict[int, np.ndarray] = {}
    out_u, out_v, out_bound = [], [], []
    for i in range(len(sig)):
        to = np.searchsorted(size, size[i] * den // num, "right")
        j = np.arange(i + 1, to)
        ok = (comp[j] != comp[i]) & ((band[j] == low) | (band[i] == low))
        if crossing:
            ok &= salt[j] != salt[i]
        j = j[ok]
        if not len(j):
            continue
        w = int(width[i])
        if w not in folded:  # wider maps fold onto narrower ones
            folded[w] = np.array([np.bitwise_xor.reduce(m.reshape(-1, w), axis=0) if len(m) >= w else np.zeros(w, np.uint64) for m in maps])
        mine, theirs = folded[w][i], folded[w][j]
        bound = (int(size[i]) + size[j] - np.bitwise_count(mine ^ theirs).sum(1).astype(np.int64)) // 2
        may = bound >= needed(int(size[i]), size[j], num, den)
        out_u += [sig[i]] * int(may.sum())
        out_v += sig[j[may]].tolist()
        out_bound += (bound[may] - needed(int(size[i]), size[j[may]], num, den)).tolist()
    u, v, gain = np.array(out_u, np.int64), np.array(out_v, np.int64), np.array(out_bound, np.int64)
    found = len(u)
    if best and len(u):  # for each class the pair with the most room
        keep: dict[int, int] = {}
        for k in np.lexsort((np.maximum(u, v), gain)).tolist():
            keep[int(u[k])] = keep[int(v[k])] = k
        at = sorted(set(keep.values()))
        u, v = u[at], v[at]
    return np.minimum(u, v), np.maximum(u, v), len(u) < found


def _tiles(members: DataFrame, comp: DataFrame, classes: DataFrame, best: bool, num: int, den: int) -> DataFrame:
    """Pairs (u, v) to compare in groups that hold several components; rows with ``key`` alone name groups of which pairs were put off."""
    named = _streamed(members.select("key", "sig", "size").join(comp, "sig").select("key", "sig", "size", "comp"), "comp", num, den)
    named = written(named.select("key", "sig", "size", "comp"), "ngram-mixed")
    count = named.groupBy("key").agg(F.count(F.lit(1)).alias("k"))
    big = count.filter(F.col("k") > TILE)
    small = named.join(count.filter(F.col("k") <= TILE).select("key"), "key").select("key", F.lit(-1).alias("low"), F.lit(0).alias("i"), F.lit(0).alias("j"), "sig", "size", "comp", F.lit(-1).alias("band"), F.lit(0).alias("salt"))
    # groups of more than one tile: neighbouring size bands, and in them pairs of hashed shares
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(den / num))).cast("int")
    cells = named.join(big.select("key"), "key").withColumn("band", band).select("*", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("low"))
    share = cells.groupBy("key", "low").agg(F.count(F.lit(1)).alias("k"), F.min("comp").alias("_a"), F.max("comp").alias("_b")).filter("_a < _b")
    cells = cells.join(share.select("key", "low", F.ceil(F.col("k") / TILE).cast("int").alias("t")), ["key", "low"])
    salt = F.pmod(F.xxhash64("sig"), F.col("t")).cast("int")
    cells = cells.withColumn("salt", salt).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    cells = cells.select("key", "low", F.least("salt", "o").alias("i"), F.greatest("salt", "o").alias("j"), "sig", "size", "comp", "band", "salt").unionByName(small)
    cells = cells.join(classes.select("sig", "bits"), "sig")

    def run(batches):
        names = ["key", "low", "i", "j"]
        rest, told = None, set()
        for batch in batches:
            t = pa.table(batch.columns, names=batch.schema.names)
            t = t if rest is None else pa.concat_tables([rest, t])
            cell = np.column_stack([np.asarray(t.column(c), np.int64) for c in names])
            cut = np.append(0, np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1)
            yield from solve(t, cell, cut[:-1], cut[1:], told)
            rest = t.slice(int(cut[-1]))
        if rest is not None and rest.num_rows:
            cell = np.column_stack([np.asarray(rest.column(c), np.int64) for c in names])
            yield from solve(rest, cell, [0], [len(cell)], told)

    def solve(t, cell, begins, ends, told):
        columns = [np.asarray(t.column(c), np.int64) for c in ("sig", "size", "comp", "band", "salt")]
        bits = t.column("bits")
        us, vs, off = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for a, b in zip(begins, ends, strict=True):
            if b - a > 1:
                u, v, less = tile_pairs(*(c[a:b] for c in columns), bits.slice(a, b - a).to_pylist(), int(cell[a, 1]), cell[a, 2] != cell[a, 3], best, num, den)
                if len(u):  # a pair that shares many n-grams is told once per task, as far as the memory of it reaches
                    fresh = [k for k, pair in enumerate(zip(u.tolist(), v.tolist(), strict=True)) if pair not in told]
                    u, v = u[fresh], v[fresh]
                    if len(told) < TOLD:
                        told.update(zip(u.tolist(), v.tolist(), strict=True))
                us.append(u)
                vs.append(v)
                if less:
                    off.append(int(cell[a, 0]))
        none = pa.nulls(len(off), pa.int64())
        u, v = (pa.concat_arrays([pa.array(np.concatenate(x)), none]) for x in (us, vs))
        yield pa.RecordBatch.from_arrays([u, v, pa.concat_arrays([pa.nulls(len(u) - len(off), pa.int64()), pa.array(off, pa.int64())])], ["u", "v", "key"])

    ordered = cells.repartition("key", "low", "i", "j").sortWithinPartitions("key", "low", "i", "j")
    return ordered.select("key", "low", "i", "j", "sig", "size", "comp", "band", "salt", "bits").mapInArrow(giving_back(run), "u long, v long, key long").distinct()


def ngram_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: set size and the smallest document id reachable by links of num / den or more."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # frequent n-grams: at most HOT_SHARE times the mean number of n-grams in a prefix, whatever the table's size
    total = rows.count()
    plain = _describe(rows, n, np.zeros(0, np.uint64), num, den, maps=False).select(F.explode("prefix").alias("key"))
    often = plain.groupBy("key").count().filter(F.col("count") > max(2, total // HOT_SHARE)).select("key")
    hot = np.sort(np.array([r["key"] for r in often.collect()], np.int64).view(np.uint64))
    described = written(_describe(rows, n, hot, num, den), "ngram-sets")
    some = described.filter(F.col("size") > 0)
    shared = written(_streamed(some.select(F.explode("prefix").alias("key"), "sig", "size"), "sig", num, den), "ngram-shared")
    members = written(_thinned(shared), "ngram-members")
    classes = some.groupBy("sig").agg(F.min("doc_id").alias("first"), F.first("size").alias("size"), F.min("bits").alias("bits"))
    classes = written(classes, "ngram-classes")
    star = members.filter(F.col("sig") != F.col("rep")).select(F.least("sig", "rep").alias("u"), F.greatest("sig", "rep").alias("v")).distinct()
    edges = _verified(_possible(star, classes, num, den), rows, classes, n, num, den)
    nodes = members.select(F.col("sig").alias("node")).distinct()
    linked = lambda: connected_components(nodes, edges, "node").select(F.col("node").alias("sig"), F.col("component").alias("comp"))
    comp = written(linked(), "ngram-comp")
    for best in (True, False):
        told = written(_tiles(members, comp, classes, best, num, den), "ngram-tiles")
        more = _verified(told.filter(F.col("u").isNotNull()).select("u", "v"), rows, classes, n, num, den)
        if more.count():
            edges = edges.unionByName(more)
            comp = written(linked(), "ngram-comp")
        if best:
            members = members.join(told.filter(F.col("key").isNotNull()).select("key").distinct(), "key", "left_semi")
    named = classes.join(comp, "sig", "left").select("sig", "first", F.coalesce("comp", "sig").alias("comp"))
    lowest = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    of = named.join(lowest, "comp").select("sig", "component_id")
    out = described.select("doc_id", "size", "sig").join(of, "sig", "left")
    return out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
