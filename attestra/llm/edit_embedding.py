"""Operator 9: document fingerprints by a randomised edit embedding.

A shared random walk reads a text: at step j it stands on a character c and moves on if a
random bit r(j, c), the same for all texts, says so. Two texts walk together while they
agree and meet again soon after an insertion or deletion, so their edit distance shows as
Hamming distance between the characters that the walks emit. A fingerprint samples the
emitted sequence: for each of its places, the step with the least hash among those of its
class that the text's walk has, so texts of like length sample the same steps. Banding
over groups of places proposes near pairs, which the edit distance then verifies: first
each band's least text meets the others, then all that are still in two classes meet.
Short texts, whose walks leave places empty, are proposed by their halves instead, exactly.
Many unlike texts may share a code, such as copies with other words in places: a bitmap of the
parities of a text's character pairs rules those out within the join, so they never become rows.
Groups above SMALL rows meet in pairs of blocks, in order of length: each text goes to its blocks,
and what comes out are only pairs within the edits allowed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.llm.common import id_and_text, map_arrow, materialise, read_table, release, shared_dir
from attestra.llm.components import components

#: Places of a fingerprint (two hex digits each), rows of the walk's random table, steps per character.
PLACES, PERIOD, STEPS_PER_CHAR = 64, 4093, 1.4
#: Share of steps that move on; code units walked at once.
MOVE_SHARE, WALK_CHARS = 0.75, 12_000_000
#: Near texts: one edit in so many characters, so many edits at most, one at least from so many characters; bands.
CHARS_PER_EDIT, MOST_EDITS, LEAST_CHARS, BANDS, BAND_PLACES = 200, 8, 10, 32, 4
#: Texts below the first length are proposed by halves (one edit at most), from the second on by bands.
HALVES_BELOW, BANDS_FROM = 2 * CHARS_PER_EDIT, CHARS_PER_EDIT
#: Parity bits of a text, and how many of them one edit flips at most: two pairs of characters go, two come.
PARITIES, FLIPS = 128, 4
#: Groups of one code up to so many rows are joined; larger ones meet in blocks of so many rows, a row more for each so many characters.
SMALL, BLOCK, ROW_CHARS = 16, 512, 8192
#: Pairs whose edit distance is worked out at once.
PAIRS_AT_ONCE = 16_384
_SEED = 20_240_229


@lru_cache(maxsize=1)
def _moves() -> np.ndarray:
    """r(j, c) for 255 classes of characters; class 255 is the end and never moves."""
    table = (np.random.default_rng(_SEED).random((PERIOD, 256)) < MOVE_SHARE).astype(np.int64)
    table[:, 255] = 0
    return table


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=64)
def _records(limit: int) -> list[list[int]]:
    """For each place, the steps below limit (a power of two) whose hash is the least so far in their class."""
    out = []
    steps = np.arange(limit, dtype=np.uint64)
    h = _mix(steps + np.uint64(_SEED))
    for k in range(PLACES):
        mine = np.flatnonzero(steps % np.uint64(PLACES) == k)
        least = np.minimum.accumulate(h[mine])
        out.append(mine[h[mine] == least].tolist())
    return out


def fingerprints(texts: list[str]) -> list[bytes]:
    """PLACES bytes for each text; equal texts have equal ones. Places that the walk does not reach are 0, reached ones never."""
    n = len(texts)
    if not n:
        return []
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    size = np.array([len(c) for c in codes], np.int64)
    order = np.argsort(-size, kind="stable")
    steps = (size * STEPS_PER_CHAR).astype(np.int64) + 1
    start = np.concatenate(([0], np.cumsum(size[order] + 4)[:-1]))
    flat = np.zeros(int(size.sum()) + 4 * n, np.uint32)
    for at, k in zip(start, order):
        flat[at : at + size[k]] = codes[k]
    ends = start + size[order]
    kind = np.empty(len(flat), np.uint8)
    gram = np.empty(len(flat), np.uint8)  # what a step emits: the four characters from where the walk stands
    for a in range(0, len(flat), 1 << 20):
        b = min(len(flat), a + (1 << 20))
        kind[a:b] = _mix(flat[a:b]) % np.uint64(255)
        ahead = flat[a : b + 3].astype(np.uint64)
        ahead = np.concatenate((ahead, np.zeros(b + 3 - a - len(ahead), np.uint64)))
        g = ahead[: b - a]
        for d in (1, 2, 3):
            g = g * np.uint64(1_000_003) + ahead[d : b - a + d]
        gram[a:b] = 1 + _mix(g) % np.uint64(254)
    for d in range(4):
        kind[ends + d] = 255
        gram[ends + d] = 255  # the end is a character of its own
    limit = 1 << int(max(PLACES, steps.max()) - 1).bit_length()
    records = _records(limit)
    wanted = sorted({j for r in records for j in r})
    row = {j: i for i, j in enumerate(wanted)}
    seen = np.zeros((len(wanted), n), np.uint8)
    moves, pos, most = _moves(), start.copy(), steps[order]
    live, j = n, 0
    for target in [*wanted, limit]:
        while j < target and live:
            until = min(target, j + 256)
            p = pos[:live]
            for q in range(j, until):
                p += moves[q % PERIOD].take(kind.take(p))
            j = until
            live = int(np.searchsorted(-most, -j, side="left"))  # walks that have steps left
        if target == limit or not live:
            break
        seen[row[target], :live] = gram.take(pos[:live])
    picked = np.empty((n, PLACES), np.uint8)
    walk = np.arange(n)
    for k, r in enumerate(records):
        latest = np.searchsorted(np.array(r), most, side="left") - 1
        step = np.array([row[x] for x in r])[np.maximum(latest, 0)]
        picked[order, k] = np.where(latest >= 0, seen[step, walk], 0)
    return [x.tobytes() for x in picked]


def likeness(a: bytes, b: bytes) -> float:
    """Share of places at which two fingerprints agree, of those that either walk has reached; empty texts reach the first and agree."""
    reached = sum(x > 0 or y > 0 for x, y in zip(a, b))
    return sum(x == y and x > 0 for x, y in zip(a, b)) / reached if reached else 1.0


def allowed(n_chars: int) -> int:
    """Edits within which two texts are near, by the length of the longer one."""
    return max(int(n_chars >= LEAST_CHARS), min(n_chars // CHARS_PER_EDIT, MOST_EDITS))


@lru_cache(maxsize=1)
def _bands() -> list[list[int]]:
    """Places of each band: all places in random order, cut into bands, as often as it takes."""
    rng, out = np.random.default_rng(_SEED), []
    while len(out) < BANDS:
        out += rng.permutation(PLACES).reshape(-1, BAND_PLACES).tolist()
    return out[:BANDS]


def band_codes(fingerprint: bytes) -> list[int]:
    import xxhash

    return [xxhash.xxh3_64_intdigest(b"%d:" % k + bytes(fingerprint[i] for i in band)) - (1 << 63) for k, band in enumerate(_bands())]


def half_codes(text: str) -> list[int]:
    """What short texts within one edit share: one of their halves.

    One edit leaves all but one character of the shorter text to the common beginning and
    end, so one of them has half of the rest; a text looks for partners of its length and one less.
    """
    import xxhash

    n = len(text)
    if not LEAST_CHARS - 1 <= n < HALVES_BELOW:
        return []
    parts = [(kind, shorter, part) for shorter in (n, n - 1) for kind, part in (("a", text[: shorter // 2]), ("z", text[n - shorter // 2 :]))]
    return [xxhash.xxh3_64_intdigest(f"{kind}{shorter}:{part}".encode("utf-8", "surrogatepass")) - (1 << 63) for kind, shorter, part in parts]


def parities(text: str) -> tuple[int, int]:
    """Two words of PARITIES bits, each the parity of a class of neighbouring characters; one edit flips FLIPS of them at most."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    count = np.zeros(PARITIES, np.int64)
    for a in range(0, len(c) - 1, 1 << 20):
        some = c[a : a + (1 << 20) + 1].astype(np.uint64)
        count += np.bincount((_mix(some[:-1] * np.uint64(1_000_003) + some[1:]) % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES)
    return tuple(np.packbits((count & 1).astype(np.uint8)).view(np.int64).tolist())


def codes(text: str, fingerprint: bytes) -> list[int]:
    """What a text shares with its near texts."""
    return half_codes(text) + (band_codes(fingerprint) if len(text) >= BANDS_FROM else [])


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in descending order of one partition: all but the last get their edited text; the first and last are kept as edges."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held: tuple | None = None
    first: tuple | None = None

    def record(kind: str, rows: list[tuple]) -> pa.RecordBatch:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text_sha256", "halves", "parity_a", "parity_b", "kind", "part", "text"]
        types = [id_type, pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    def flush(ids: list, texts: list[str]) -> pa.RecordBatch | None:
        nonlocal held, first
        if not ids:
            return None
        changed = [edited(a, b) for a, b in zip(([held[1]] if held else []) + texts, texts if held else texts[1:])]
        prints = fingerprints(texts + changed)
        own, new = prints[: len(texts)], prints[len(texts) :]
        before = ([held] if held else []) + list(zip(ids, texts, own))
        rows = []
        for (i, t, f), e, g, nxt in zip(before, changed, new, own if held else own[1:]):
            rows.append((i, len(t), hashlib.sha256(e.encode()).digest(), f, g, likeness(f, g), likeness(f, nxt), hashlib.sha256(t.encode()).digest(), half_codes(t), *parities(t), "row", part, None))
        first = first or before[0]
        held = (ids[-1], texts[-1], own[-1])
        return record("row", rows) if rows else None

    ids: list = []
    texts: list[str] = []
    id_type, size = pa.int64(), 0
    for batch in batches:
        id_type = batch.column("doc_id").type
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size > WALK_CHARS:
                if (out := flush(ids, texts)) is not None:
                    yield out
                ids, texts, size = [], [], 0
    if (out := flush(ids, texts)) is not None:
        yield out
    if first and held:
        yield record("edge", [(i, None, None, f, None, None, None, None, None, None, None, kind, part, t) for kind, (i, t, f) in (("first", first), ("last", held))])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mine, following = (batch.column(c).to_pylist() for c in ("text", "next_text"))
        prints = [batch.column(c).to_pylist() for c in ("fingerprint", "next_fingerprint")]
        changed = [edited(a, b) for a, b in zip(mine, following)]
        new = fingerprints(changed)
        cols = [
            pa.array([len(t) for t in mine], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).digest() for e in changed], pa.binary()),
            batch.column("fingerprint"),
            pa.array(new, pa.binary()),
            pa.array([likeness(f, g) for f, g in zip(prints[0], new)], pa.float64()),
            pa.array([likeness(f, g) for f, g in zip(*prints)], pa.float64()),
            pa.array([hashlib.sha256(t.encode()).digest() for t in mine], pa.binary()),
            pa.array([half_codes(t) for t in mine], pa.list_(pa.int64())),
            *(pa.array([parities(t)[k] for t in mine], pa.int64()) for k in (0, 1)),
        ]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text_sha256", "halves", "parity_a", "parity_b"])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness to each other and to the next document's.

    Documents follow each other by doc_id descending, null ids last, ties by the text's hash
    and the text; after the last comes the first. The texts are dealt out by range once;
    what lies at the partitions' edges is stitched from two rows a partition. Null and empty
    texts have n_chars 0 and the fingerprint of the empty text. Other columns stay behind.
    """
    return _in_hex(_with_halves(docs).drop(*_OF_TEXT))


#: What near_documents needs of each text besides; what is kept as bytes until it is returned.
_OF_TEXT = ("text_sha256", "halves", "parity_a", "parity_b")
_BYTES = ("edited_sha256", "fingerprint", "edited_fingerprint")


def _in_hex(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.lower(F.hex(c)) for c in _BYTES})


def _with_halves(docs: DataFrame) -> DataFrame:
    """fingerprint_documents, and each text's hash, the codes of its halves and its parities."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    dealt = id_and_text(docs)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    dealt = dealt.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    result = f"doc_id {kind}, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text_sha256 binary, halves array<long>, parity_a long, parity_b long"
    root = shared_dir(spark)
    rows = materialise(map_arrow(dealt, _walks, f"{result}, kind string, part long, text string"), root, "walks")
    del dealt
    release(spark)
    parts = [r.part for r in rows.where("kind = 'first'").select("part").orderBy("part").collect()]  # one a partition
    follow = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part long, next_part long")
    last = rows.where("kind = 'last'").select("part", "doc_id", "text", "fingerprint").join(F.broadcast(follow), "part")
    first = rows.where("kind = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    edges = map_arrow(last.join(first, "next_part").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint"), _edges, result)
    edges = materialise(edges, root, "edges")
    return rows.where("kind = 'row'").drop("kind", "part", "text").unionByName(edges)


def near_pairs(prints: DataFrame, bands: int = 16, likely: float = 0.5) -> DataFrame:
    """Pairs (a, b, likeness) of ids whose fingerprints share a band of places and agree at `likely` of them at least.

    prints: doc_id and fingerprint, one row an id. Equal fingerprints are joined through
    their least id; of unlike ones all members of a band meet.
    """
    width = PLACES * 2 // bands
    own = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    same = prints.join(own.withColumnRenamed("doc_id", "a"), "fingerprint").where("a < doc_id").select("a", F.col("doc_id").alias("b"), F.lit(1.0).alias("likeness"))
    banded = own.select("doc_id", "fingerprint", F.explode(F.array(*(F.concat(F.lit(f"{k}:"), F.substring("fingerprint", 1 + k * width, width)) for k in range(bands)))).alias("band"))
    others = banded.select(F.col("doc_id").alias("b"), F.col("fingerprint").alias("fb"), "band")
    pairs = banded.withColumnsRenamed({"doc_id": "a", "fingerprint": "fa"}).join(others, "band").where("a < b").drop("band").distinct()
    agree = F.expr(f"aggregate(sequence(1, {PLACES * 2}, 2), 0, (s, i) -> s + int(substring(fa, i, 2) = substring(fb, i, 2)))") / F.lit(float(PLACES))
    return same.unionByName(pairs.withColumn("likeness", agree).where(F.col("likeness") >= likely).select("a", "b", "likeness"))


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, prints, halves = (batch.column(c).to_pylist() for c in ("n_chars", "fingerprint", "halves"))
        found = [h + (band_codes(f) if k >= BANDS_FROM else []) for k, f, h in zip(n, prints, halves)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(n, pa.int32()), pa.array(found, pa.list_(pa.int64()))], ["node", "n_chars", "codes"])


def _edits(n: str) -> str:
    """allowed() in SQL."""
    return f"greatest(int({n} >= {LEAST_CHARS}), least(int({n} div {CHARS_PER_EDIT}), {MOST_EDITS}))"


def _texts(needed: DataFrame, nodes: DataFrame, docs: DataFrame, root: str, name: str) -> DataFrame:
    """(node, text) of the nodes needed; only their texts are moved on."""
    least = materialise(nodes.join(needed, "node").select("node", F.col("doc_id").alias("least_id"), "text_sha256"), root, f"{name}-nodes")
    keyed = id_and_text(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"), "text")
    # a bitmap of the wanted texts' hashes, about a byte each, keeps nearly all other texts from being moved
    bits = 64 << max(0, least.count() // 8).bit_length()
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    word, bit = (lambda c: F.shiftright(at(c), 6)), (lambda c: F.expr(f"shiftleft(1L, int(pmod(xxhash64({c}), 64)))"))
    bitmap = least.groupBy(word("text_sha256").alias("word")).agg(F.bit_or(bit("text_sha256")).alias("bits"))
    keyed = keyed.join(F.broadcast(bitmap), word("key") == F.col("word")).where(F.col("bits").bitwiseAND(bit("key")) != 0)
    texts = keyed.join(least, (F.col("key") == F.col("text_sha256")) & F.col("doc_id").eqNullSafe(F.col("least_id"))).select("node", "text")
    texts = materialise(texts.dropDuplicates(["node"]), root, f"{name}-texts")
    release(docs.sparkSession)
    return texts


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, root: str, name: str) -> DataFrame:
    """Those of the pairs (u, v) whose texts are within the edits allowed."""
    needed = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    texts = _texts(needed, nodes, docs, root, name)
    u, v = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "uv")
    longer = "greatest(length(text_u), length(text_v))"
    links = pairs.join(u, "u").join(v, "v").where(F.expr(f"levenshtein(text_u, text_v, {_edits(longer)}) >= 0")).select("u", "v").distinct()
    return materialise(links, root, f"{name}-links")


class _Strings:
    """Texts laid end to end, with hashes of all beginnings: parts of two texts are compared in one step.

    Equal parts always have equal hashes; unlike ones have with a chance of about 2**-64 at random.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, texts: list[str]) -> None:
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        self.size = np.array([len(c) for c in codes], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size + 1)[:-1])).astype(np.int64)
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(self.size.max(initial=0)), self.BASE, np.uint64))))
        self.hash = np.zeros(int((self.size + 1).sum()), np.uint64)
        for at, c in zip(self.start, codes):
            np.cumsum(_mix(c) * power[: len(c)], out=self.hash[at + 1 : at + 1 + len(c)])

    def common(self, u: np.ndarray, v: np.ndarray, i: np.ndarray, d: int) -> np.ndarray:
        """How far text u from i on and text v from i + d on agree."""
        a, b = self.start[u] + i, self.start[v] + i + d
        most = np.minimum(self.size[u] - i, self.size[v] - i - d)
        shift = np.uint64(pow(self.BASE, abs(d), 1 << 64))
        ha, hb = self.hash[a], self.hash[b]
        low, high = np.zeros_like(most), np.maximum(most, 0)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_] + 1) // 2
            x, y = self.hash[a[open_] + mid] - ha[open_], self.hash[b[open_] + mid] - hb[open_]
            same = x * shift == y if d >= 0 else x == y * shift
            low[open_] = np.where(same, mid, low[open_])
            high[open_] = np.where(same, high[open_], mid - 1)
        return low

    def near(self, u: np.ndarray, v: np.ndarray, most: int, longer: int) -> np.ndarray:
        """Whether texts u are within `most` edits of texts v, which are `longer` characters longer each: furthest places by edits and shift."""
        out = np.zeros(len(u), bool)
        live = np.arange(len(u))
        reached: dict[int, np.ndarray] = {}
        for e in range(most + 1):
            now = {}
            for d in range(max(-e, longer - (most - e)), min(e, longer + (most - e)) + 1):
                tries = [reached[d] + 1] if d in reached else []
                tries += [reached[d - 1]] if d - 1 in reached else []
                tries += [reached[d + 1] + 1] if d + 1 in reached else []
                i = np.zeros(len(live), np.int64) if not e else np.maximum.reduce(tries)
                a, b = u[live], v[live]
                i = np.maximum(np.minimum(i, np.minimum(self.size[a], self.size[b] - d)), max(0, -d))
                now[d] = i + self.common(a, b, i, d)
            reached = now
            if longer in reached:
                done = reached[longer] >= self.size[u[live]]
                out[live[done]] = True
                live, reached = live[~done], {d: i[~done] for d, i in reached.items()}
        return out


def _block(rows: pa.Table) -> pa.Table:
    """Pairs (u, v) of two blocks of a group (or of one with itself) that are within the edits allowed, in different components."""
    rows = rows.sort_by([("n_chars", "ascending"), ("node", "ascending")])
    col = {c: rows.column(c).to_numpy() for c in ("node", "n_chars", "component", "parity_a", "parity_b", "block")}
    n, parity = col["n_chars"].astype(np.int64), np.stack((col["parity_a"], col["parity_b"]), 1).view(np.uint64)
    edits = np.maximum(n >= LEAST_CHARS, np.minimum(n // CHARS_PER_EDIT, MOST_EDITS)).astype(np.int64)  # the longer text, which comes later, decides
    alone = rows.column("one")[0].as_py() == rows.column("two")[0].as_py()
    number: dict[int, int] = {}
    held = [(k, number.setdefault(c, len(number))) for k, cs in enumerate(rows.column("codes").to_pylist()) for c in cs]
    codes = np.zeros((len(n), len(number) + 1), np.float32)
    if held:
        codes[tuple(np.array(held).T)] = 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for v in range(1, len(n)):
        first = int(np.searchsorted(n, n[v] - edits[v], "left"))
        u = np.arange(first, v)
        u = u[(col["component"][u] != col["component"][v]) & (alone | (col["block"][u] != col["block"][v]))]
        u = u[np.bitwise_count(parity[u] ^ parity[v]).sum(1, dtype=np.int64) <= FLIPS * edits[v]]
        if len(u):
            u = u[codes[u] @ codes[v] == 0]  # pairs that share a lesser code meet there
        if len(u):
            found.append((u, np.full(len(u), v)))
    near: list[tuple[np.ndarray, np.ndarray]] = []
    if found:
        u, v = (np.concatenate(x) for x in zip(*found))
        strings = _Strings(rows.column("text").to_pylist())
        kind = edits[v] * (MOST_EDITS + 1) + n[v] - n[u]
        for x in np.unique(kind):
            mine = np.flatnonzero(kind == x)
            for at in range(0, len(mine), PAIRS_AT_ONCE):
                some = mine[at : at + PAIRS_AT_ONCE]
                hit = some[strings.near(u[some], v[some], *divmod(int(x), MOST_EDITS + 1))]
                near.append((col["node"][u[hit]], col["node"][v[hit]]))
    u, v = (np.concatenate(x) for x in zip(*near)) if near else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return pa.table({"u": pa.array(np.minimum(u, v), pa.int64()), "v": pa.array(np.maximum(u, v), pa.int64())})


def _by_blocks(rows: DataFrame, parity: DataFrame, nodes: DataFrame, docs: DataFrame, root: str) -> DataFrame:
    """Near pairs (u, v) of large groups, in different components: pairs of blocks whose lengths are near meet, each in a group of rows of its own.

    rows: code, node, n_chars, component; parity: node, parity_a, parity_b. A pair meets in the least code that it shares.
    """
    by_length = Window.partitionBy("code").orderBy("n_chars", "node").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("block", F.floor((F.sum(1 + F.floor(F.col("n_chars") / ROW_CHARS)).over(by_length) - 1) / BLOCK))
    rows = materialise(rows, root, "blocks")
    spans = rows.groupBy("code", "block").agg(F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))
    one, two = (spans.select("code", *(F.col(c).alias(f"{c}_{x}") for c in ("block", "low", "high"))) for x in ("u", "v"))
    meet = one.join(two, "code").where("block_u <= block_v").where(F.expr(f"low_v - high_u <= {_edits('high_v')}"))
    meet = meet.select("code", F.col("block_u").alias("one"), F.col("block_v").alias("two"), F.explode(F.array_distinct(F.array("block_u", "block_v"))).alias("block"))
    of_node = rows.groupBy("node", "n_chars", "component").agg(F.collect_list(F.struct("code", "block")).alias("of"))
    texts = _texts(rows.select("node").distinct(), nodes, docs, root, "blocks")
    dealt = of_node.join(parity, "node").join(texts, "node").withColumn("at", F.explode("of"))  # joined once a node, not once a code
    dealt = dealt.select("node", "n_chars", "component", "parity_a", "parity_b", "text", "at.code", "at.block", F.filter("of.code", lambda c: c < F.col("at.code")).alias("codes"))
    return dealt.join(meet, ["code", "block"]).groupBy("code", "one", "two").applyInArrow(_block, "u long, v long").distinct()


def near_documents(docs: DataFrame) -> DataFrame:
    """fingerprint_documents with class_id and n_links.

    Two texts are linked if they share a code and their edit distance is within allowed().
    class_id is the least doc_id of the texts that links connect, equal texts included (null: no
    text of the class has an id). n_links counts the links of a text to other texts that
    were verified; pairs that links already connect are not compared again.
    """
    spark = docs.sparkSession
    root = shared_dir(spark)
    rows = _with_halves(docs)
    nodes = rows.groupBy("fingerprint", "n_chars", *_OF_TEXT).agg(F.min("doc_id").alias("doc_id"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), root, "nodes")
    release(spark)
    coded = map_arrow(nodes.select("node", "n_chars", "fingerprint", "halves"), _coded, "node long, n_chars int, codes array<long>")
    members = coded.select("node", "n_chars", F.explode("codes").alias("code"))
    most = _edits("greatest(n_u, n_v)")
    close = F.expr(f"abs(n_u - n_v) <= {most}")
    alike = F.expr(f"bit_count(parity_a_u ^ parity_a_v) + bit_count(parity_b_u ^ parity_b_v) <= {FLIPS} * {most}")
    parity = nodes.select("node", "parity_a", "parity_b")

    def end(frame: DataFrame, x: str) -> DataFrame:
        return frame.select("code", F.col("node").alias(x), *(F.col(c).alias(f"{a}_{x}") for c, a in (("n_chars", "n"), ("component", "component"), ("parity_a", "parity_a"), ("parity_b", "parity_b"))))

    def pairs(found: DataFrame) -> DataFrame:
        return found.where(close & alike).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()

    of_code = Window.partitionBy("code")  # the members are dealt out once
    met = members.withColumn("first", F.min(F.struct("node", "n_chars")).over(of_code)).withColumn("size", F.count("*").over(of_code)).where("size > 1")
    shared = materialise(met.select("code", "node", "n_chars", F.col("first.node").alias("u"), F.col("first.n_chars").alias("n_u")), root, "shared")
    release(spark)
    met = shared.where("node != u").select("u", "n_u", F.col("node").alias("v"), F.col("n_chars").alias("n_v")).where(close).distinct()
    for x in "uv":
        met = met.join(parity.toDF(x, f"parity_a_{x}", f"parity_b_{x}"), x)
    stars = materialise(pairs(met), root, "stars")
    links = _verified(stars, nodes, docs, root, "stars")
    joined = components(links, root, "joined")
    labelled = shared.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = materialise(labelled.select("node", "n_chars", "code", "component"), root, "labelled")
    apart = labelled.groupBy("code").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("size")).where("a < b").select("code", "size")
    left = labelled.join(apart, "code")
    small, large = left.where(F.col("size") <= SMALL).join(parity, "node"), left.where(F.col("size") > SMALL).drop("size")
    rest = pairs(end(small, "u").join(end(small, "v"), "code").where("u < v and component_u != component_v"))
    rest = rest.unionByName(_by_blocks(large, parity, nodes, docs, root)).distinct().join(stars, ["u", "v"], "left_anti")
    rest = materialise(rest, root, "rest")
    release(spark)
    links = links.unionByName(_verified(rest, nodes, docs, root, "rest"))
    final = components(links, root, "final")
    counts = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    placed = nodes.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    known = placed.join(least, "component").join(counts, "node", "left").select("text_sha256", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return _in_hex(rows.join(known, "text_sha256").drop(*_OF_TEXT))


def op9_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(read_table(spark, sf_dir, "documents"))
