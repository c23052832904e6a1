"""SimHash near-duplicates with pivot distance tables.

Every distinct fingerprint gets its Hamming distances to many reference fingerprints. By the triangle
inequality two fingerprints whose distances to any one reference differ by more than the radius cannot link,
so a pair is discarded on the greatest difference of its coordinates; survivors are verified bit by bit.

Candidates meet in buckets, not in all pairs: bits are dealt into ``radius + k`` blocks, and fingerprints
within the radius agree on at least ``k`` whole blocks, so every choice of ``k`` blocks is a key. ``k`` grows with the number of
fingerprints, so that a bucket of strangers stays small; which one is taken changes no link. A bucket never becomes a list of pairs either: it is
searched in tiles of bounded size, spread over tasks, and each tile gives the edges of a spanning forest of
its links, at most one for each fingerprint. Equal fingerprints are one node throughout.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from bioloom.llm.blocks import SPACES, SubstringHashes, lean, lower_ascii, mix64, text_pieces, word_spans
from bioloom.operators.graph import components
from bioloom.session import stored

SHINGLE = 3
RADIUS = 3
SEED = 42
PIVOTS = 16
#: Fingerprints of one bucket that a tile compares with those of another.
TILE = 2048
WORD = re.compile(rb"[^" + re.escape(SPACES) + rb"]+")
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
LOWERED = bytes.maketrans(UPPER, LOWER)
MASK = 2**64 - 1


SPACE = re.compile(rb"[" + re.escape(SPACES) + rb"]")
PIECE = 1 << 20


def word_lists(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, some megabytes of it at a time."""
    at = 0
    while at < len(text):
        space = SPACE.search(text, at + size) if len(text) - at > size else None
        end = space.start() if space else len(text)
        yield WORD.findall(text, at, end)
        at = end


def shingles(text: bytes, size: int = SHINGLE, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The word shingles of a text, repeats included, in lists: all words if there are fewer than ``size``."""
    carried: list[bytes] = []
    some = False
    for words in word_lists(text.translate(LOWERED), piece):
        words = carried + words
        if len(words) >= size:
            some = True
            yield list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))
            words = words[len(words) - size + 1 :]
        carried = words
    if carried and not some:
        yield [b" ".join(carried)]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Bit by bit the strict majority of the XXH64 hashes of the shingles; 0 for no words."""
    ones, n = np.zeros(64, np.int64), 0
    for parts in shingles(text, size):
        for lo in range(0, len(parts), 1 << 16):
            hashes = np.array([xxhash.xxh64_intdigest(x, SEED) for x in parts[lo : lo + (1 << 16)]], dtype=">u8")
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)
        n += len(parts)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``docs`` without ``text``, with ``fp``: the fingerprint as a signed long. A null text has no words."""
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "fp"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields if f.name != text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            made = np.array([fingerprint((x.as_py() or "").encode(), size) for x in batch.column(at)], np.uint64)
            others = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in others), pa.array(made.view(np.int64))], [*(batch.schema.names[i] for i in others), "fp"])

    return rest.mapInArrow(run, f"{kinds}, fp long" if kinds else "fp long")


def pivots(lanes: int = 1, n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(20070508).integers(0, 2**64, (n, lanes), dtype=np.uint64)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which rows of 64-bit lanes differ."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)


def distance_table(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distances to all references, one row each."""
    return np.stack([hamming(fps, p) for p in references])


class Forest:
    """Union-find over positions, by least position."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True


def close_pairs(fps: np.ndarray, left: np.ndarray, right: np.ndarray, table: np.ndarray, radius: int) -> np.ndarray:
    """Which of the index pairs link: first by the pivot coordinates, then by the bits."""
    alive = np.arange(len(left))
    for row in table:
        alive = alive[np.abs(row[left[alive]] - row[right[alive]]) <= radius]
        if not len(alive):
            return alive
    return alive[hamming(fps[left[alive]], fps[right[alive]]) <= radius]


def _runs(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each place with the ``counts`` places after it."""
    left = np.repeat(first, counts)
    return left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts, counts)


def tile_links(fps: np.ndarray, radius: int, references: np.ndarray, proof: Callable[[int, int], bool] | None = None) -> np.ndarray:
    """A spanning forest, as pairs of places, of the links among the rows of ``fps``.

    Rows are sorted by their first coordinate, so each meets only a run of the others. With ``proof``, close rows
    link only if it holds for them; every close pair is tried whose rows are not in one tree already.
    """
    table = distance_table(fps, references)
    order = np.argsort(table[0], kind="stable")
    sorted_fps, table = fps[order], table[:, order]
    upto = np.searchsorted(table[0], table[0] + radius, "right")
    forest, found, at = Forest(len(fps)), [], 0
    while at < len(fps):
        end, total = at, 0
        while end < len(fps) and (end == at or total + upto[end] - end - 1 <= 1 << 19):
            total += upto[end] - end - 1
            end += 1
        left, right = _runs(np.arange(at, end), upto[at:end] - np.arange(at, end) - 1)
        close = close_pairs(sorted_fps, left, right, table, radius)
        for i, j in zip(left[close].tolist(), right[close].tolist(), strict=True):
            if forest.root(i) != forest.root(j) and (proof is None or proof(int(order[i]), int(order[j]))):
                forest.join(i, j)
                found.append((i, j))
        at = end
    return order[np.array(found, np.int64).reshape(-1, 2)]


def bucket_links(fps: np.ndarray, buckets: np.ndarray, radius: int, references: np.ndarray) -> np.ndarray:
    """Links, as pairs of places, of rows sorted by bucket: small buckets all at once, larger ones one by one."""
    out = [np.zeros((0, 2), np.int64)]
    first = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(buckets)))
    small = sizes <= 64
    for s, n in zip(first[~small].tolist(), sizes[~small].tolist(), strict=True):
        out.append(s + tile_links(fps[s : s + n], radius, references))
    members = np.flatnonzero(np.repeat(small & (sizes > 1), sizes))
    rest = np.repeat(first + sizes, sizes)[members] - members - 1
    for lo in range(0, len(members), 1 << 14):
        left, right = _runs(members[lo : lo + (1 << 14)], rest[lo : lo + (1 << 14)])
        if len(left):
            used = np.unique(np.concatenate([left, right]))
            close = close_pairs(fps[used], np.searchsorted(used, left), np.searchsorted(used, right), distance_table(fps[used], references), radius)
            out.append(np.stack([left[close], right[close]], axis=1))
    return np.concatenate(out)


def bucketed_links(keyed: DataFrame, lanes: list[str], radius: int, tile: int = TILE) -> DataFrame:
    """Edges ``a, b`` between the ``node`` of rows that share ``block`` and ``value`` and differ in at most ``radius`` bits.

    They span the same components as all such pairs. A bucket of up to ``tile`` rows is one tile. A larger one
    is dealt into groups by a hash; every two of its groups meet in one tile, so no pair is lost and no task
    holds a whole hot bucket. A node is in a bucket once.
    """
    sizes = stored(keyed.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    sizes = sizes.select(F.col("block").alias("in_block"), F.col("value").alias("in_value"), F.ceil(F.col("n") / F.lit(tile // 2)).cast("int").alias("groups"))
    dealt = keyed.join(sizes, (F.col("block") == F.col("in_block")) & (F.col("value") == F.col("in_value")))
    own = F.pmod(F.xxhash64("node"), F.col("groups")).cast("int")
    # Group g of k meets all others: tile (less, greater). Up to two groups are a single tile.
    meets = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda g: F.least(g, own) * F.col("groups") + F.greatest(g, own))
    tiles = F.when(F.col("groups") <= 2, F.array(F.lit(0))).otherwise(F.filter(meets, lambda t: t % F.col("groups") != F.floor(t / F.col("groups"))))
    placed = dealt.select("node", *lanes, "block", "value", F.explode(tiles).alias("tile"))
    dealt_out = placed.select("node", *lanes, F.xxhash64("block", "value", "tile").alias("bucket")).repartition("bucket").sortWithinPartitions("bucket")
    references = pivots(len(lanes))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(lanes) + 2, 0), np.int64)

        def emit(rows: np.ndarray) -> pa.RecordBatch:
            pairs = rows[0][bucket_links(np.ascontiguousarray(rows[1:-1].T).view(np.uint64), rows[-1], radius, references)]
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
                last = int(np.searchsorted(held[-1], held[-1][-1]))
                yield emit(held[:, :last])
                held = held[:, last:]
        if held.shape[1]:
            yield emit(held)

    return dealt_out.mapInArrow(search, "a long, b long")


#: Strangers that a bucket may hold on average.
STRANGERS = 64


def equal_blocks(n: int, radius: int) -> int:
    """How many whole blocks a key has, so that ``n`` random fingerprints give buckets of up to ``STRANGERS``; at most four."""
    return next((k for k in range(1, 4) if n >> (64 * k // (radius + k)) <= STRANGERS), 4)


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE, equal: int | None = None) -> DataFrame:
    """Edges ``a, b`` whose components are those of all pairs of distinct ``fp`` within ``radius`` bits."""
    equal = equal or equal_blocks(nodes.count(), radius)
    blocks = radius + equal
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    single = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(x) for x in combinations(single, equal)]
    values = F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])
    keyed = nodes.select(F.col("fp").alias("node"), "fp", F.posexplode(values).alias("block", "value"))
    return bucketed_links(keyed, ["fp"], radius, tile)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per row: key, ``fp`` (signed long) and ``component_id``, the least key reachable over links of at most ``radius`` bits.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows are one node and repeat in
    the result. A null key is in no component's name unless no other key is there; an empty table gives no rows.
    """
    made = stored(fingerprints(docs.select(key, text), text, size), "fingerprints")
    nodes = stored(made.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    edges = links(nodes, radius)
    member = components(edges).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = stored(nodes.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    named = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    labelled = stored(rooted.join(named, "root").select(F.col("fp").alias("of_fp"), "component_id"), "labels")
    return made.join(labelled, F.col("fp") == F.col("of_fp")).select(key, "fp", "component_id")


def group_documents(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint in hexadecimal digits and the least id of its component.

    Null and empty texts have fingerprint zero and link to any that is near it. Repeated rows repeat in the result; a null id names a
    component only where no other id is there; an empty table gives no rows. Long texts are read in pieces.
    """
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- near copies for a corpus: wide fingerprints, larger radius -------------------------------------------------

#: Words in a shingle, lanes of 64 bits, and how many of the bits may differ in a candidate. Sets of Jaccard similarity 0.8
#: agree in 0.81 (of four shingles) to 0.85 of the bits; 0.7 is four and a half standard deviations below.
WIDE_SHINGLE, LANES = 5, 4
WIDE_RADIUS = 64 * LANES - -(-64 * LANES * 7 // 10)
#: Bytes of shingle sets in a group of a large bucket; a tile has two groups.
SET_BYTES = 8 << 20
#: Two texts meet where all ``BAND`` least hashes of one of ``BANDS`` bands are equal.
BANDS, BAND = 12, 4
WIDE = [f"fp{i}" for i in range(LANES)]


def shingle_hashes(buf: np.ndarray, bounds: np.ndarray, size: int = WIDE_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of a block and the documents they are of; a shorter text is one shingle."""
    buf = lower_ascii()[buf]
    starts, ends, doc = word_spans(buf, bounds)
    words, docs = SubstringHashes(buf).of(starts, ends), len(bounds) - 1
    counts = np.bincount(doc, minlength=docs)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.repeat(np.cumsum(counts) - counts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    owner = np.repeat(np.arange(docs), n)
    length = np.minimum(size, counts[owner])
    made = np.zeros(len(first), np.uint64)
    for i in range(size):
        inside = np.flatnonzero(length > i)
        made[inside] = mix64(made[inside] * np.uint64(0x9E3779B97F4A7C15) + words[first[inside] + i])
    return made, owner


def shingle_sets(column: pa.Array, size: int = WIDE_SHINGLE, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts ``first`` to ``last`` of a column and the distinct hashes of their shingles, as ``_distinct`` gives them.

    A long text comes in pieces; each repeats the last ``size - 1`` words before it, so no shingle is lost or made up.
    """
    carried, found = b"", []
    for block in text_pieces(column, limit):
        if block.start == 0 and block.ended:
            yield block.first, block.last, *_distinct(*shingle_hashes(block.buf, block.bounds, size))
            continue
        buf = np.concatenate([np.frombuffer(carried, np.uint8), block.buf])
        bounds = np.array([0, len(buf)])
        starts, _, _ = word_spans(buf, bounds)
        if len(starts) >= size or (block.ended and not found):
            hashes, owner = shingle_hashes(buf, bounds, size)
            found.append(_distinct(hashes, owner)[0])
        carried = buf[starts[max(0, len(starts) - size + 1)] :].tobytes() if len(starts) else b""
        if block.ended:
            hashes = np.concatenate(found)
            yield block.first, block.last, *_distinct(hashes, np.zeros(len(hashes), np.int64))
            carried, found = b"", []


def _distinct(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's hashes once by their upper 32 bits, in rising order."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    upper = hashes >> np.uint64(32)
    fresh = np.ones(len(order), bool)
    fresh[1:] = (upper[1:] != upper[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], owner[fresh]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 0.8 or more."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * shared >= 4 * (len(a) + len(b) - shared)


def similar_links(nodes: DataFrame, tile: int = TILE, set_bytes: int = SET_BYTES) -> DataFrame:
    """Edges ``a, b`` that span the components of all nodes that share a band, are in ``WIDE_RADIUS`` and have similar sets.

    Buckets of the same members are searched once. Large ones are cut into tiles as in ``bucketed_links``, by rows or by bytes of sets;
    a tile holds the sets of its rows, so no pair needs to leave it.
    """
    keyed = nodes.select("node", F.octet_length("shingles").alias("bytes"), F.posexplode("bands").alias("block", "value"))
    members = [F.bit_xor("node").alias("m1"), F.bit_xor(F.xxhash64("node")).alias("m2")]
    sizes = keyed.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), *members).where("n > 1")
    once = stored(sizes.groupBy("n", "bytes", "m1", "m2").agg(F.min(F.struct("block", "value")).alias("at")), "buckets")
    groups = F.greatest(F.ceil(F.col("n") / F.lit(tile // 2)), F.ceil(F.col("bytes") / F.lit(set_bytes))).cast("int")
    once = once.select(F.col("at.block").alias("in_block"), F.col("at.value").alias("in_value"), groups.alias("groups"))
    dealt = keyed.join(once, (F.col("block") == F.col("in_block")) & (F.col("value") == F.col("in_value")))
    own = F.pmod(F.xxhash64("node"), F.col("groups")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda g: F.least(g, own) * F.col("groups") + F.greatest(g, own))
    tiles = F.when(F.col("groups") <= 2, F.array(F.lit(0))).otherwise(F.filter(meets, lambda t: t % F.col("groups") != F.floor(t / F.col("groups"))))
    placed = dealt.select(F.col("node").alias("of"), "block", "value", F.explode(tiles).alias("tile")).select("of", F.xxhash64("block", "value", "tile").alias("bucket"))
    whole = nodes.select("node", *WIDE, "shingles").join(placed, F.col("node") == F.col("of"))
    dealt_out = whole.select("node", *WIDE, "shingles", "bucket").repartition("bucket").sortWithinPartitions("bucket")
    references = pivots(LANES)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def emit() -> pa.RecordBatch:
            fps = np.array([r[1:-2] for r in held], np.int64).view(np.uint64)
            sets = [np.frombuffer(r[-2], np.uint32) for r in held]
            found = tile_links(fps, WIDE_RADIUS, references, lambda i, j: similar(sets[i], sets[j])).tolist() if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([held[p[k]][0] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][-1] != row[-1]:
                    yield emit()
                    held = []
                held.append(row)
        if held:
            yield emit()

    return dealt_out.mapInArrow(lean(search), "a long, b long")


def wide_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text_hash, fp0 .. fp3, bands, shingles``: a fingerprint of four lanes over the set of five-word shingles, band keys and the set.

    The set is packed: 32 bits of each shingle's hash in rising order. No words: all zero and empty.
    """
    kind = docs.schema[key].dataType.simpleString()
    salts = np.random.default_rng(19).integers(0, 2**64, LANES + BANDS * BAND, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, hashes, owner in shingle_sets(batch.column(1)):
                size = end - begin
                counts = np.bincount(owner, minlength=size)
                some = np.flatnonzero(counts)
                first = (np.cumsum(counts) - counts)[some]
                lanes, bands = np.zeros((LANES, size), np.uint64), np.zeros((BANDS, size), np.uint64)
                if len(some):
                    for i in range(LANES):
                        bits = np.unpackbits(mix64(hashes ^ salts[i]).view(np.uint8).reshape(-1, 8), axis=1)
                        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
                        lanes[i, some] = np.packbits(2 * ones > counts[some, None], axis=1).view(np.uint64)[:, 0]
                    for i in range(BANDS * BAND):
                        least = np.minimum.reduceat(mix64(hashes ^ salts[LANES + i]), first)
                        bands[i // BAND, some] = mix64(bands[i // BAND, some] + least)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * BANDS), pa.array(np.ascontiguousarray(bands.T).view(np.int64).ravel()))
                ends = np.cumsum(counts) * 4
                packed = (hashes >> np.uint64(32)).astype(np.uint32).tobytes()
                sets = pa.array([packed[e - 4 * n : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary())
                given = [batch.column(i).slice(begin, size) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*given, *(pa.array(x.view(np.int64)) for x in lanes), lists, sets], [key, "text_hash", *WIDE, "bands", "shingles"])

    return docs.select(key, text, F.xxhash64(text).alias("text_hash")).mapInArrow(lean(run), f"`{key}` {kind}, text_hash long, {', '.join(f'{c} long' for c in WIDE)}, bands array<long>, shingles binary")


def keepers(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text_hash``: the row with the least key, then the least hash of its text, of each group of near copies.

    Texts link if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Candidates share a band of
    least hashes, which a pair of similarity 0.8 misses twice in a thousand times, and agree in at least 0.7 of the bits
    of their wide fingerprints. Texts of equal sets are one node, so exact copies always link. A null key is the
    least only where there is no other.
    """
    made = wide_fingerprints(docs, key, text).withColumn("node", F.xxhash64(*WIDE, "shingles"))
    least = F.min(F.struct(F.isnull(key).alias("none"), key, "text_hash"))
    nodes = stored(made.groupBy("node").agg(least.alias("least"), *[F.first(c).alias(c) for c in (*WIDE, "bands", "shingles")]), "nodes")
    member = components(similar_links(nodes))
    joined = nodes.select("node", "least").join(member.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    return joined.groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("least").alias("least")).select(f"least.{key}", "least.text_hash")
