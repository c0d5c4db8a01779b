"""Operator 6: n-gram Jaccard join by universe partition.

A document's set is its distinct word shingles. Sets are dealt into bands of sizes; in each
band the universe of shingles is hashed into segments. If two sets are similar enough, their
difference is at most H shingles, so segments hold it unevenly (pigeonhole): of the `one`
segments that are indexed with one-deletion neighbourhoods, one differs by at most 1, or
the exact segments have at most H - 2 * one differing ones, and among the cheapest
H - 2 * one + 1 of either set (in one order for all: rare shingles first, then large subsets) a
subset is common. How many segments of each kind a band has is allocated by cost.

Sets that share a signature are candidates. Before the sets themselves are brought together,
candidates are held against each other by parity bitmaps: each shingle flips one of one or two bits a
shingle, so the bits that differ are never more than the shingles that differ, and pairs with
too many are no links for certain. What is left is verified exactly, in this order: each set
with the one that it shares most signatures with, and with the likeliest of its largest group;
in the end every candidate pair that still is in two components, and as long as these are
many, a few for each set. Large groups are cut into blocks that meet in pairs, each in a
group of rows of its own, and only pairs that pass the bitmaps ever become rows, once each.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from attestra.llm.common import id_and_text, map_arrow, materialise, read_table, release, remove, shared_dir
from attestra.llm.components import components

#: Words of a shingle; documents link at 100 * |intersection| >= PERCENT * |union|.
WORDS, PERCENT = 5, 80
#: Cells in which shingles are counted to tell frequent ones; only the order of signatures depends on them.
HOT_BITS = 22
#: Bytes of a batch: words, hashes and sets of its texts take some twenty times as much in a worker.
BATCH = 2 << 20
#: Rows of a signature up to which its pairs are made by a join; larger groups meet in blocks of so many rows.
SMALL, BLOCK = 16, 512
#: Partners that a set tries in a turn, and open pairs a set that are few enough to be tried all.
PARTNERS, FEW = 2, 20
#: A column that no table has.
SET = "attestra set of row"
#: Words of 64 bits of the filter that tells which rows are needed again.
FILTER_WORDS = 1 << 20
_SEEDS = np.random.default_rng(61).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser on unsigned arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts (A-Z lower-cased), and where each text's words end."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts).cast(pa.large_string()))
    words = lists.flatten()
    ends = np.asarray(lists.offsets)[1:] - lists.offsets[0].as_py()
    filled = np.asarray(pc.binary_length(words)) > 0
    coded = words.dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    of = hashes[np.asarray(coded.indices)] if len(hashes) else np.zeros(0, np.uint64)
    if not filled.all():
        ends = np.concatenate(([0], np.cumsum(filled)))[ends]
        of = of[filled]
    return of, ends


def shingle_sets(texts: pa.Array, width: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than a shingle count as one, none as no shingle."""
    words, ends = word_hashes(texts)
    n = len(words) - width + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        rolled += mix(words[k : k + max(n, 0)] + _SEEDS[k]) * _SEEDS[width + k]
    rolled = mix(rolled)
    start = 0
    for end in ends.tolist():
        if end - start >= width:
            yield np.unique(rolled[start : end - width + 1])
        elif end > start:
            few = words[start:end]
            k = np.arange(len(few))
            yield mix((mix(few + _SEEDS[k]) * _SEEDS[width + k]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(few)))
        else:
            yield np.zeros(0, np.uint64)
        start = end


def set_id(shingles: np.ndarray) -> int:
    """Signed 64-bit identity of a set."""
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles)) - (1 << 63)


def most_difference(size: int, largest: int) -> int:
    """Largest symmetric difference of a similar pair of `size` and a set of `largest` at most."""
    least, largest = -(-size * PERCENT // 100), min(largest, size * 100 // PERCENT)
    top = size + largest
    return max((s - 2 * -(-PERCENT * s // (100 + PERCENT)) for s in range(max(size + least, top - 9), top + 1)), default=0)


@lru_cache(maxsize=64)
def allocation(band: int) -> tuple[int, int, int]:
    """(exact segments, one-deletion segments, their share of the universe in exact segments) of a band, by cost.

    A band holds sizes 2^band to 2^(band + 1) - 1, and larger sets that may be similar to
    them. Cost: signatures a set has, and, where too few of its exact segments are filled, the
    common signatures of empty segments.
    """
    own = (2 << band) - 1
    sizes = [1 << band, (1 << band) * 3 // 2, own, own * 100 // PERCENT]
    need = [most_difference(s, own if s > own else s * 100 // PERCENT) for s in sizes]
    best: tuple[float, tuple[int, int, int]] = (math.inf, (1, 0, 1))
    for one in range(0, min(12, max(need) // 2 + 1) + 1):
        left = [max(0, h - 2 * one + 1) for h in need]
        shares = [0] if not max(left) else sorted({max(max(left), round(own * c)) for c in (0.3, 0.35, 0.4, 0.5, 0.65, 0.8, 1, 2, 4, 8, 16)})
        for exact, wide in ((e, w) for e in shares for w in (1, 2, 4)):
            slots = exact + one * wide
            if not slots:
                continue
            cost = 0.0
            for size, k in zip(sizes, left):
                load = size / slots
                cost += k + one * (1 + wide * load) + 4 * one * math.exp(-wide * load)
                if k:  # the common signatures of empty segments, where fewer than k are filled
                    cost += 1000 * _few_filled(size, exact, load, k)
            cost += exact / 1000 / own
            if cost < best[0]:
                best = (cost, (exact, one, wide))
    return best[1]


def _few_filled(size: int, exact: int, load: float, k: int) -> float:
    """About how likely fewer than k of the exact segments are filled, `load` shingles a segment."""
    empty = math.exp(-load)
    spread = math.sqrt(exact * empty * (1 - empty)) + 0.5
    return 0.5 * math.erfc((min(exact * (1 - empty), size) - k) / spread / math.sqrt(2))


@np.errstate(over="ignore")
def signatures(shingles: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Signed 64-bit signatures of a set: any similar set that is not equal shares one."""
    n = len(shingles)
    if n < 2 or not most_difference(n, n * 100 // PERCENT):
        return np.zeros(0, np.int64)
    band = n.bit_length() - 1
    out = []
    weight = mix(shingles ^ _SEEDS[10])
    heat = hot[(shingles >> np.uint64(64 - HOT_BITS)).astype(np.int64)]
    bands = [band] + ([band - 1] if -(-n * PERCENT // 100) < 1 << band else [])
    for b in bands:
        h = most_difference(n, n * 100 // PERCENT if b == band else (1 << band) - 1)
        exact, one, wide = allocation(b)
        slot = (mix(shingles + _SEEDS[11] * np.uint64(b + 1)) % np.uint64(exact + one * wide)).astype(np.int64)
        segment = np.where(slot < exact, slot, exact + (slot - exact) // wide)
        at = np.argsort(segment, kind="stable")
        sorted_segment, sorted_weight = segment[at], weight[at]
        start = np.flatnonzero(np.concatenate(([True], sorted_segment[1:] != sorted_segment[:-1])))
        filled = sorted_segment[start]
        content = np.add.reduceat(sorted_weight, start)
        size = np.diff(np.append(start, n))
        cold = np.minimum.reduceat(heat[at], start)
        place = _SEEDS[12] * (filled.astype(np.uint64) + np.uint64(1)) + _SEEDS[13] * np.uint64(b + 1)
        code = mix(content * _SEEDS[14] + place)
        need = max(0, h - 2 * one + 1)
        mine = np.flatnonzero(filled < exact)
        if need:
            order = mine[np.lexsort((code[mine], -size[mine], cold[mine]))][:need]
            out.append(code[order])
            if len(order) < need:
                empty = np.setdiff1d(np.arange(exact), filled[mine])
                codes = np.sort(mix(_SEEDS[12] * (empty.astype(np.uint64) + np.uint64(1)) + _SEEDS[13] * np.uint64(b + 1)))
                out.append(codes[: need - len(order)])
        if one:
            group = np.repeat(np.arange(len(start)), size)
            near = sorted_segment >= exact
            less = content[group[near]] - sorted_weight[near]
            out.append(mix(less * _SEEDS[14] + place[group[near]]))
            out.append(code[filled >= exact])
            bare = np.setdiff1d(np.arange(exact, exact + one), filled)
            out.append(mix(_SEEDS[12] * (bare.astype(np.uint64) + np.uint64(1)) + _SEEDS[13] * np.uint64(b + 1)))
    return np.unique(np.concatenate(out)).view(np.int64)


def _heat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of shingles that a partition has far more often than most."""
    counts = np.zeros(1 << HOT_BITS, np.int32)
    for batch in batches:
        sets = [s for s in shingle_sets(batch.column("text"))]
        if sets:
            cells, n = np.unique((np.concatenate(sets) >> np.uint64(64 - HOT_BITS)).astype(np.uint32), return_counts=True)
            counts[cells] += n.astype(np.int32)
    cells = np.flatnonzero(counts >= 6 + 6 * counts.mean())
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(counts[cells], pa.int64())], ["cell", "n"])


def _signed(batches: Iterator[pa.RecordBatch], hot: bytes) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles, set_id and, once for each set in a partition, its signatures."""
    import zlib

    heat = np.frombuffer(zlib.decompress(hot), np.uint8)
    met: set[int] = set()
    for batch in batches:
        sizes, keys, codes = [], [], []
        for s in shingle_sets(batch.column("text")):
            key = set_id(s) if len(s) else None
            sizes.append(len(s))
            keys.append(key)
            codes.append(signatures(s, heat) if len(s) and key not in met else None)
            met.add(key)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(codes, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_id", "codes"])


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the shingles in each of 1 to 2 times as many cells (64 at least, a power of two): 2 bits a shingle at most."""
    cells = max(64, 2 << (len(shingles).bit_length() - 1 if len(shingles) else 0))
    odd = np.bincount((mix(shingles ^ _SEEDS[15]) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> bytes:
    """The bitmap of the same set with fewer cells."""
    while len(bits) > size:
        half = len(bits) // 2
        bits = (int.from_bytes(bits[:half], "little") ^ int.from_bytes(bits[half:], "little")).to_bytes(half, "little")
    return bits


def may_link(n: int, m: int, a: bytes, b: bytes) -> bool:
    """False only for sets, of n and m shingles with bitmaps a and b, that differ too much for a link."""
    size = min(len(a), len(b))
    differ = (int.from_bytes(folded(a, size), "little") ^ int.from_bytes(folded(b, size), "little")).bit_count()
    return differ <= n + m - 2 * -(-PERCENT * (n + m) // (100 + PERCENT))


def _wanted(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """set_id, n, bitmap and shingles of the sets that may be needed, once for each set in a partition."""
    met: set[int] = set()
    for batch in batches:
        keys, sizes, maps, sets = [], [], [], []
        for s in shingle_sets(batch.column("text")):
            if len(s):
                key = set_id(s)
                if key not in met and bits[key % FILTER_WORDS] >> (key // FILTER_WORDS % 64) & 1:
                    met.add(key)
                    keys.append(key)
                    sizes.append(len(s))
                    maps.append(bitmap(s))
                    sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary()), pa.array(sets, pa.binary())], ["set_id", "n", "bitmap", "shingles"])


def _fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that the bitmaps don't rule out."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("n_u", "n_v", "map_u", "map_v")))
        yield batch.select(["u", "v"]).filter(pa.array([may_link(*r) for r in rows], pa.bool_()))


def _block(rows: pa.Table, most: int | None) -> pa.Table:
    """Pairs of one block pair's rows (set_id, n, component, codes, half, bitmap): of different components, not ruled out, of different halves if there are two.

    most: for each set only so many, those whose bitmaps differ least for their sizes. Else
    all, each in the first group that both sets are in; codes are a set's groups before this one.
    """
    keys, n, component, half = (np.asarray(rows.column(c)) for c in ("set_id", "n", "component", "half"))
    maps = rows.column("bitmap").to_pylist()
    size = min(len(m) for m in maps)
    cells = np.frombuffer(b"".join(folded(m, size) for m in maps), np.uint64).reshape(len(maps), -1)
    two = half.min() != half.max()
    us, vs = [], []
    for i in range(len(keys)):
        total = n + n[i]
        over = np.bitwise_count(cells ^ cells[i]).sum(1, dtype=np.int64) - (total - 2 * -(-PERCENT * total // (100 + PERCENT)))
        fit = (over <= 0) & (component != component[i]) & (100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i]))
        if two:
            fit &= half != half[i]
        if most is None:
            fit &= keys > keys[i]
        at = np.flatnonzero(fit)
        if most is not None and len(at) > most:
            at = at[np.lexsort((keys[at], over[at]))[:most]]
        us.append(np.full(len(at), i))
        vs.append(at)
    u, v = np.concatenate(us), np.concatenate(vs)
    if most is None and len(u):
        lists = rows.column("codes").combine_chunks()
        start, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        own = [set(flat[start[i] : start[i + 1]].tolist()) for i in range(len(keys))]
        first = np.array([own[i].isdisjoint(own[j]) for i, j in zip(u.tolist(), v.tolist())])
        u, v = u[first], v[first]
    return pa.table({"u": pa.array(np.minimum(keys[u], keys[v]), pa.int64()), "v": pa.array(np.maximum(keys[u], keys[v]), pa.int64())})


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets are similar, by the exact sizes of intersection and union."""
    for batch in batches:
        good = []
        for a, b in zip(batch.column("set_u").to_pylist(), batch.column("set_v").to_pylist()):
            common = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
            good.append(100 * common >= PERCENT * ((len(a) + len(b)) // 8 - common))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(good, pa.bool_()))


def _filter_bits(keys: DataFrame, column: str) -> np.ndarray:
    """A filter of fixed size over 64-bit keys: false only where a key is not among them."""
    word = F.pmod(F.col(column), F.lit(FILTER_WORDS))
    bit = F.expr(f"pmod(({column} - pmod({column}, {FILTER_WORDS}L)) div {FILTER_WORDS}L, 64L)").cast("int")
    rows = keys.select(word.alias("word"), bit.alias("b")).select("word", F.expr("shiftleft(1L, b)").alias("bit"))
    bits = np.zeros(FILTER_WORDS, np.int64)
    got = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # FILTER_WORDS rows at most
    bits[np.asarray(got["word"])] = np.asarray(got["bits"])
    return bits


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified pairs (u, v); a pair carries u's set to where v's is."""
    left = pairs.join(sets.select(F.col("set_id").alias("u"), F.col("shingles").alias("set_u")), "u")
    both = left.join(sets.select(F.col("set_id").alias("v"), F.col("shingles").alias("set_v")), "v")
    return map_arrow(both.select("u", "v", "set_u", "set_v"), _verified, "u long, v long", BATCH)


def _open(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (code, set_id, n, size, component) of those codes that stand in more than one component."""
    placed = shared.join(groups.withColumnRenamed("node", "set_id"), "set_id", "left").select("code", "set_id", "n", "size", F.coalesce("component", "set_id").alias("component"))
    split = placed.groupBy("code").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a != b").select("code")
    return placed.join(split, "code")


def _fitted(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) that the bitmaps don't rule out."""
    for s in ("u", "v"):
        pairs = pairs.join(known.select(F.col("set_id").alias(s), F.col("n").alias(f"n_{s}"), F.col("bitmap").alias(f"map_{s}")), s)
    return map_arrow(pairs.select("u", "v", "n_u", "n_v", "map_u", "map_v"), _fitting, "u long, v long", BATCH)


def _by_join(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (u, v) of small groups, in different components, that the bitmaps don't rule out. A group of SMALL rows has half as many pairs a row."""
    rows = rows.where(F.col("size") <= SMALL)
    one, two = (rows.select("code", *(F.col(c).alias(f"{c}_{s}") for c in ("set_id", "n", "component"))) for s in ("u", "v"))
    like = (F.col("set_id_u") < F.col("set_id_v")) & (F.col("component_u") != F.col("component_v")) & (100 * F.least("n_u", "n_v") >= PERCENT * F.greatest("n_u", "n_v"))
    return _fitted(one.join(two, "code").where(like).select(F.col("set_id_u").alias("u"), F.col("set_id_v").alias("v")).distinct(), known)


def _by_blocks(rows: DataFrame, known: DataFrame, most: int | None) -> DataFrame:
    """Pairs (u, v) of large groups: a group's blocks of BLOCK rows meet in pairs, each pair of blocks in a group of rows of its own.

    most: partners of a set in each block of its largest group, likeliest first; None: all of all groups that the bitmaps don't rule out.
    """
    codes = F.sort_array(F.collect_list("code"))
    largest = F.max(F.struct("size", "code"))
    sets = rows.where(F.col("size") > SMALL).groupBy("set_id").agg((codes if most is None else F.array(largest["code"])).alias("codes"), F.first("n").alias("n"), F.first("component").alias("component"), F.collect_list(F.struct("code", "size")).alias("of") if most is None else F.array(largest.alias("of")).alias("of"))
    sets = sets.join(known.select("set_id", "bitmap"), "set_id").withColumn("of", F.explode("of"))
    sets = sets.select("set_id", "n", "component", "codes", "bitmap", "of.code", "of.size").withColumn("codes", F.filter("codes", lambda c: c < F.col("code")))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    met = sets.withColumn("half", F.pmod(F.xxhash64("set_id", "code"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    keyed = met.select("code", F.least("half", "other").alias("one"), F.greatest("half", "other").alias("two"), "set_id", "n", "component", "codes", "half", "bitmap")
    return keyed.groupBy("code", "one", "two").applyInArrow(lambda table: _block(table, most), "u long, v long")


def _numbered(codes: DataFrame, root: str, name: str) -> DataFrame:
    """(code, number): numbers of their own, small ones, which are shorter to send than codes: a code's place in its partition, and the partition in the last bits."""
    found = materialise(codes.select("code", F.monotonically_increasing_id().alias("id")), root, name)
    part = F.shiftright("id", 33)
    bits = (found.agg(F.max(part)).first()[0] or 0).bit_length()
    return found.select("code", (F.shiftleft(F.col("id").bitwiseAND(F.lit((1 << 33) - 1)), bits) + part).alias("number"))


def _some(pairs: DataFrame, turn: int) -> DataFrame:
    """PARTNERS of each set's open pairs, in a random order of this turn."""
    both = pairs.select("u", "v", F.explode(F.array("u", "v")).alias("node"))
    order = F.xxhash64("u", "v", F.lit(turn))
    return both.groupBy("node").agg(*(F.min_by(F.struct("u", "v"), F.xxhash64(order, F.lit(k))).alias(f"p{k}") for k in range(PARTNERS))).select(F.explode(F.array(*(f"p{k}" for k in range(PARTNERS)))).alias("p")).select("p.u", "p.v").distinct()


def _sets(docs: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, set_id, codes) of every row, and (set_id, component) of the sets that link with others."""
    import zlib

    spark = docs.sparkSession
    base = id_and_text(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    hot = np.zeros(1 << HOT_BITS, np.uint8)
    heat = map_arrow(base.select("text"), _heat, "cell long, n long", BATCH).groupBy("cell").agg(F.floor(F.log2(F.sum("n"))).alias("level")).toArrow()  # 2^HOT_BITS rows at most
    hot[np.asarray(heat["cell"])] = np.asarray(heat["level"])
    signed = materialise(map_arrow(base, _signed, f"doc_id {kind}, n_shingles long, set_id long, codes array<long>", BATCH, hot=zlib.compress(hot.tobytes(), 1)), root, "signed")

    by_code = Window.partitionBy("code").orderBy("set_id")
    whole = Window.partitionBy("code")
    rows = signed.where(F.col("codes").isNotNull()).select(F.explode("codes").alias("code"), "set_id", F.col("n_shingles").alias("n"))
    grouped = rows.withColumn("before", F.lag("set_id").over(by_code)).withColumn("least", F.min("set_id").over(whole)).withColumn("most", F.max("set_id").over(whole)).withColumn("size", F.count("*").over(whole))
    shared = materialise(grouped.where((F.col("least") != F.col("most")) & (F.col("before").isNull() | (F.col("before") != F.col("set_id")))).select("code", "set_id", "n", "least", "size"), root, "shared")
    sets = materialise(signed.drop("codes"), root, "sets")  # most codes are met once: the rest of the run needs none of them
    remove(spark, f"{root}/signed")
    release(spark)

    bits = _filter_bits(shared.select("set_id").distinct(), "set_id")
    known = map_arrow(base.select("text"), _wanted, "set_id long, n long, bitmap binary, shingles binary", BATCH, bits=bits)
    known = known.groupBy("set_id").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.first("shingles").alias("shingles"))
    name = "attestra_sets_" + uuid.uuid4().hex  # bucketed, so pairs are brought to the sets, and the sets are never dealt out again
    known.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "set_id").option("path", f"{root}/known").saveAsTable(name)
    known = spark.table(name)
    release(spark)

    first = shared.where("set_id != least").groupBy("set_id", "least").count().groupBy("set_id").agg(F.max_by("least", F.struct("count", "least")).alias("v"))
    stars = _fitted(first.select(F.least("set_id", "v").alias("u"), F.greatest("set_id", "v").alias("v")).distinct(), known)
    likely = _by_blocks(shared.withColumn("component", F.col("set_id")), known, PARTNERS)
    tried = materialise(stars.unionByName(likely).distinct(), root, "tried")
    linked = materialise(_links(tried, known), root, "linked")
    release(spark)
    groups = components(linked, root, "groups")
    turn, before, last = 0, math.inf, False
    while not last:
        turn += 1
        rows = materialise(_open(shared, groups), root, f"open-{turn}")
        large = _numbered(rows.where(F.col("size") > SMALL).select("code").distinct(), root, f"large-{turn}")
        numbered = rows.join(large, "code").withColumn("code", F.col("number")).drop("number")
        rest = _by_join(rows, known).unionByName(_by_blocks(numbered, known, None)).distinct().join(tried, ["u", "v"], "left_anti")
        rest = materialise(rest, root, f"rest-{turn}")
        pairs = rest.count()
        sets_open = rest.select(F.explode(F.array("u", "v")).alias("node")).distinct().count() if pairs else 0
        last = pairs <= FEW * sets_open or pairs > 0.8 * before
        before = pairs
        some = rest if last else materialise(_some(rest, turn), root, f"some-{turn}")
        more = materialise(_links(some, known), root, f"linked-{turn}")
        tried = tried.unionByName(some)
        if not more.isEmpty():
            groups = components(groups.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more), root, f"groups-{turn}")
        release(spark)
    spark.sql(f"drop table {name}")
    for folder in ("known", "shared", f"open-{turn}"):
        remove(spark, f"{root}/{folder}")
    return sets, groups.select(F.col("node").alias("set_id"), "component")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every row.

    Documents without words, null texts included, link with nothing. Rows with null doc_id
    take part, but never name a component while another id is there. Rows that repeat a
    doc_id are documents of their own that share a name. Other columns stay behind.
    """
    sets, final = _sets(docs, shared_dir(docs.sparkSession))
    least = sets.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min("doc_id").alias("own"))
    named = least.join(final, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    names = named.groupBy("component").agg(F.min("own").alias("component_id"))
    of_set = named.join(names, "component").select("set_id", "component_id")
    return sets.select("doc_id", "n_shingles", "set_id").join(of_set, "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of similar documents, all columns: of those of the least doc_id (null ids last) the set of least hash, of its rows the least text.

    Documents without words stay, every one. Only rows that a filter of fixed size takes for
    rows of a group are joined and compared; the others go through.
    """
    spark = docs.sparkSession
    root = shared_dir(spark)
    sets, final = _sets(docs, root)
    grouped = sets.where(F.col("set_id").isNotNull()).groupBy("set_id", "doc_id").agg(F.count("*").alias("n")).join(final, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "set_id")).alias("best")
    several = grouped.groupBy("component").agg(best, F.sum("n").alias("n")).where("n > 1").select("component", "best")
    placed = materialise(grouped.join(several.select("component", "best"), "component").select("set_id", F.col("doc_id").alias("id"), (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("set_id") == F.col("best.set_id"))).alias("stays"), "n"), root, "grouped")
    bits = _filter_bits(placed.select(F.xxhash64("id").alias("at")), "at")

    names = docs.columns

    def part(maybe: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.asarray(batch.column(batch.num_columns - 1))
                hit = (bits[at % FILTER_WORDS] >> (at // FILTER_WORDS % 64)) & 1
                some = batch.filter(pa.array(hit == maybe, pa.bool_()))
                cols = some.columns[:-1]
                if maybe:
                    texts = some.column("text").fill_null("")
                    cols.append(pa.array([set_id(s) if len(s) else None for s in shingle_sets(texts)], pa.int64()))
                yield pa.RecordBatch.from_arrays(cols, [*names, *([SET] if maybe else [])])

        schema = StructType([*docs.schema.fields, *([StructField(SET, LongType())] if maybe else [])])
        return map_arrow(docs.withColumn(SET, F.xxhash64("doc_id")), run, schema, BATCH)

    rows = part(True).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(SET).alias("key"))
    rows = rows.withColumn("id", F.col("row.doc_id"))
    known = rows.join(placed.select(F.col("set_id").alias("key_of"), F.col("id").alias("id_of"), "stays", "n"), (F.col("key") == F.col("key_of")) & F.col("id").eqNullSafe(F.col("id_of")), "left")
    known = materialise(known.where("stays is null or stays").select("row", "key", "id", "stays", "n"), root, "maybe")
    alone = known.where("stays is null or n = 1").select("row.*")
    first = known.where("n > 1").groupBy("key", "id").agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row")).select("row.*")
    return part(False).unionByName(alone).unionByName(first)


def op6_universe_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents
),
s as (
  select distinct doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0)
),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (
  select a.doc_id as u, b.doc_id as v from s a join s b on a.g = b.g and a.doc_id < b.doc_id
  join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 80 * (na.n + nb.n - count(*))
),
e as (select u, v from pairs union all select v, u from pairs),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.v from r join e on r.b = e.u)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.component_id
from w left join n on n.doc_id = w.doc_id
join (select a as doc_id, min(b) as component_id from r group by a) c on c.doc_id = w.doc_id
"""
