"""SimHash groups against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from bioloom.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum((sum(h >> bit & 1 for h in hashes) * 2 > len(hashes)) << bit for bit in range(64)) if parts else 0


def plain_components(fps):
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


def test_groups_of_texts(spark):
    rng = random.Random(8)
    base = [[rng.choice("alpha Beta gamma delta eps ÉTÉ zeta".split()) for _ in range(120)] for _ in range(6)]
    texts = [" ".join(b) for b in base] * 2
    for b in base[:4]:
        for _ in range(3):
            c = list(b)
            c[rng.randrange(len(c))] = "changed"
            texts.append("\t".join(c))
    texts += ["", None, " \n", "One", "one TWO", "a b c"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    found = sorted(map(tuple, simhash.group_documents(docs).collect()))
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    roots = plain_components(fps)
    assert found == sorted((i, f"{f:016x}", rows[r][0]) for (i, _, _), f, r in zip(rows, fps, roots, strict=True))
    assert simhash.group_documents(docs.limit(0)).collect() == []
    nameless = simhash.near_duplicates(spark.createDataFrame([(None, "x y z"), (None, "x y z"), (4, "x y z")], "doc_id long, text string")).collect()
    assert [r["component_id"] for r in nameless] == [4, 4, 4]


@pytest.mark.parametrize(("tile", "equal"), [(4, 1), (64, 2), (64, 3), (2048, 4), (2048, None)])
def test_links_of_hot_buckets(spark, tile, equal):
    """A cloud of fingerprints round one centre, and strangers, in tiles of any size."""
    rng = np.random.default_rng(6)
    centre = int(rng.integers(0, 2**63))
    cloud = {centre}
    for _ in range(80):
        value = centre
        for bit in rng.integers(0, 64, rng.integers(1, 7)):
            value ^= 1 << int(bit)
        cloud.add(value)
    fps = sorted(cloud | {int(x) for x in rng.integers(0, 2**63, 60)} | {0, 1, 2**64 - 1, 2**63})
    signed = [(int(np.uint64(x).view(np.int64)),) for x in fps]
    found = {tuple(np.int64(v).view(np.uint64) for v in r) for r in simhash.links(spark.createDataFrame(signed, "fp long"), 3, tile, equal).collect()}
    assert all((int(a) ^ int(b)).bit_count() <= 3 for a, b in found)
    roots = plain_components(fps)
    forest = simhash.Forest(len(fps))
    for a, b in found:
        forest.join(fps.index(int(a)), fps.index(int(b)))
    assert [forest.root(i) for i in range(len(fps))] == roots


def test_keys_widen_with_the_number_of_fingerprints():
    assert [simhash.equal_blocks(n, 3) for n in (0, 10**6, 10**7, 10**9, 10**11, 10**15)] == [1, 1, 2, 2, 3, 4]


@pytest.mark.parametrize("piece", [1, 9, 40, 1 << 20])
def test_long_texts_in_pieces(piece):
    rng = random.Random(3)
    texts = ["", " ", "one", "one two", " ".join(rng.choice(["a", "Bb", "ccc", "x" * 30]) for _ in range(60)) + " ", "a b c d e", "   lone   "]
    for text in texts:
        whole = [x for part in simhash.shingles(text.encode()) for x in part]
        assert [x for part in simhash.shingles(text.encode(), piece=piece) for x in part] == whole
    sets = {i: h.tolist() for f, la, hashes, owner in simhash.shingle_sets(pa.array(texts)) for i in range(f, la) for h in [hashes[owner == i - f]]}
    cut = {i: h.tolist() for f, la, hashes, owner in simhash.shingle_sets(pa.array(texts), limit=piece) for i in range(f, la) for h in [hashes[owner == i - f]]}
    assert sets == cut


def test_pivot_table_discards_nothing_close():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**64, (400, 1), dtype=np.uint64)
    fps[200:, 0] = fps[:200, 0] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    found = simhash.tile_links(fps, 3, simhash.pivots())
    assert {tuple(sorted(p)) for p in found.tolist()} >= {(i, i + 200) for i in range(200)}


def test_keepers(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(900)]
    rows, near = [], []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(200, 400))]
        rows.append((2 * i, " ".join(words)))
        if i % 3 == 0:
            copy = list(words)
            copy[rng.randrange(len(copy))] = "other"
            near.append(2 * i + 1)
            rows.append((2 * i + 1, " ".join(copy)))
    rows += [(500, rows[0][1]), (501, rows[0][1].upper()), (502, None), (503, ""), (504, "few words"), (504, "few words"), (None, "few words")]
    found = sorted(r["doc_id"] for r in simhash.keepers(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == sorted({i for i, _ in rows if i is not None} - {*near, 500, 501, 503})
    assert simhash.keepers(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def similar_texts(n, changed, seed):
    """A text of ``n`` shingles and one whose last words are others: similarity (n - changed) / (n + changed)."""
    word = lambda i, kind: f"{kind}{seed}x{i}"
    words = [word(i, "w") for i in range(n + 4)]
    return " ".join(words), " ".join(words[: n + 4 - changed] + [word(i, "o") for i in range(changed)])


@pytest.mark.parametrize(("changed", "linked"), [(159, False), (112, False), (101, False), (100, True), (73, True)])
def test_keepers_link_from_similarity(spark, changed, linked):
    """Jaccard 0.70, 0.779, 0.798, 0.8 and 0.85, thirty pairs each."""
    pairs = [similar_texts(900, changed, s) for s in range(30)]
    docs = spark.createDataFrame([(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)], "doc_id long, text string")
    assert simhash.keepers(docs).count() == (30 if linked else 60)


def test_keepers_count_shingles_once(spark):
    line = "the same line of eight words once more "
    text, copy = similar_texts(300, 10, 1)
    docs = spark.createDataFrame([(1, text + " " + line * 2), (2, copy + " " + line * 400)], "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.keepers(docs).collect()] == [1]


@pytest.mark.parametrize(("tile", "set_bytes"), [(4, 1 << 20), (2048, 3000), (2048, 1 << 20)])
def test_similar_links_of_a_hot_bucket(spark, tile, set_bytes):
    """Sets round one centre with all bands in common: the components are those of all pairs."""
    rng = np.random.default_rng(4)
    centre = rng.choice(2**32, 100, replace=False)
    sets = [np.unique(np.concatenate([centre[rng.permutation(100)[: rng.integers(75, 100)]], rng.integers(0, 2**32, rng.integers(0, 12))])).astype(np.uint32) for _ in range(40)]
    rows = [(i, 0, 0, 0, 0, [5, 6], bytearray(x.tobytes())) for i, x in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node long, fp0 long, fp1 long, fp2 long, fp3 long, bands array<long>, shingles binary")
    plain, forest = simhash.Forest(40), simhash.Forest(40)
    for i in range(40):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if len(a & b) / len(a | b) >= 0.8:
                plain.join(i, j)
    for a, b in simhash.similar_links(nodes, tile, set_bytes).collect():
        forest.join(a, b)
    roots = [plain.root(i) for i in range(40)]
    assert [forest.root(i) for i in range(40)] == roots and 1 < len(set(roots)) < 40
