"""Chroma fingerprints: areas by brute force, and recordings cut from one another."""

import numpy as np
from pyspark.sql import functions as F

from bioloom.llm import chroma


def tune(seed, notes=60):
    rng = np.random.default_rng(seed)
    return chroma.melody(rng.uniform(-1, 1, notes).tolist())


def to_pcm(samples):
    return (samples * 20000).astype("<i2").tobytes()


def test_filters_by_plain_sums():
    image = np.random.default_rng(3).random((30, 12))
    for place, code in enumerate(chroma.packed(image)):
        bits = 0
        for parts in chroma.filters():
            plus = sum(image[place + t0 : place + t1, y0:y1].sum() for s, t0, t1, y0, y1 in parts if s > 0)
            minus = sum(image[place + t0 : place + t1, y0:y1].sum() for s, t0, t1, y0, y1 in parts if s < 0)
            value = np.log((1 + plus) / (1 + minus))
            level = sum(value >= x for x in (-0.4, 0.0, 0.4))
            bits = bits << 2 | (level ^ level >> 1)
        assert bits == code
    assert all(0 <= t0 < t1 <= chroma.SPAN and 0 <= y0 < y1 <= 12 for parts in chroma.filters() for _, t0, t1, y0, y1 in parts)


def test_pitch_classes():
    t = np.arange(8000) / chroma.RATE
    assert set(chroma.frames(np.sin(2 * np.pi * 440 * t)).argmax(1)) == {0}
    assert set(chroma.frames(np.sin(2 * np.pi * 880 * 2 ** (3 / 12) * t)).argmax(1)) == {3}


def test_alignment(spark):
    a, b = tune(1), tune(2)
    noisy = a + np.random.default_rng(9).normal(0, 0.05, len(a)).astype(np.float32)
    cut = a[chroma.HOP * 20 :]
    rows = [(0, to_pcm(a)), (50, to_pcm(cut)), (7, to_pcm(noisy)), (3, to_pcm(b)), (100, to_pcm(b)), (9, None), (10, b""), (11, b"xyz"), (100, to_pcm(b))]
    media = spark.createDataFrame([(i, bytes(x) if x is not None else None, 1) for i, x in rows], "rec long, audio binary, codes int")
    prints = chroma.fingerprints(media, "rec", "audio")
    found = chroma.align(prints, "rec", F.col("rec") % 50 == 0).collect()
    by = {r["rec"]: r for r in found}
    assert len(found) == len(rows)
    assert (by[0]["n_links"], by[50]["n_links"], by[3]["n_links"]) == (2, 2, None)
    assert (by[100]["class_id"], by[100]["n_links"], by[9]["n_codes"], by[11]["class_id"]) == (3, 0, 0, 9)
    assert by[50]["best_class_id"] == 0 and by[50]["best_offset"] == -20 and by[50]["best_error"] == 0
    assert chroma.align(prints.limit(0), "rec", F.col("rec") % 50 == 0).collect() == []


def plain_error(a, b, least):
    """The least rate of wrong bits of two recordings over all offsets with enough overlap, and its offset."""
    best = (2.0, 0)
    for offset in range(-len(a) + 1, len(b)):
        first = max(0, -offset)
        n = min(len(a) - first, len(b) - first - offset)
        if n >= min(least, len(a), len(b)) and n > 0:
            wrong = np.bitwise_count(a[first : first + n] ^ b[first + offset : first + offset + n]).sum()
            best = min(best, (round(float(wrong) / (32 * n), 6), offset))
    return best


def test_recall_and_offsets_by_brute_force(spark):
    """Noisy and cut copies among strangers: what is found is what all offsets give, and nine tenths of that at least."""
    rng = np.random.default_rng(12)
    rows = [(i, chroma.melody(rng.uniform(-1, 1, 64).tolist())) for i in range(60)]
    for i in range(40):
        sound = rows[i][1][chroma.HOP * int(rng.integers(0, 50)) + int(rng.integers(0, 256)) :]
        rows.append((50 * (i + 2), sound + rng.normal(0, rng.uniform(0.05, 0.6), len(sound)).astype(np.float32)))
    rows += [(9000, rows[0][1][: chroma.FRAME + chroma.HOP * (chroma.SPAN + 5)])]
    codes = {i: chroma.packed(chroma.frames(x)) for i, x in rows}
    media = spark.createDataFrame([(i, c.view(np.int32).tolist()) for i, c in codes.items()], "rec long, codes array<int>")
    found = {r["rec"]: r for r in chroma.align(media, "rec", F.col("rec") % 50 == 0).collect()}
    links = caught = 0
    for i in (r for r in codes if r % 50 == 0):
        truth = {j: plain_error(codes[j], codes[i], chroma.MIN_OVERLAP) for j in codes if j != i}
        near = {j for j, (e, _) in truth.items() if e <= chroma.MAX_ERROR}
        links, caught = links + len(near), caught + found[i]["n_links"]
        assert found[i]["n_links"] <= len(near)
        if found[i]["n_links"]:
            assert found[i]["best_class_id"] in near and found[i]["best_error"] >= truth[found[i]["best_class_id"]][0]
    assert links >= 20 and caught >= 0.9 * links


def test_keys_by_plain_loops(spark):
    codes = np.random.default_rng(1).integers(0, 2**32, 40, dtype=np.uint32)
    found = spark.createDataFrame([(codes.view(np.int32).tolist(),)], "codes array<int>").select(F.explode(chroma.keys(F.col("codes"), 3)).alias("k")).select("k.*").collect()
    expected = set()
    for byte in range(4):
        for i in range(0, 40 - chroma.LAGS[-1], 3):
            key = byte
            for lag in (0, *chroma.LAGS):
                key = key * 256 + (int(codes[i + lag]) >> 8 * byte & 255)
            expected.add((i, key))
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)


def test_short_recordings(spark):
    """Too few codes for a key: equal ones are one class, others link to nothing."""
    rows = [(0, [1, 2, 3]), (50, [1, 2, 3]), (100, [1, 2]), (150, []), (200, None), (250, list(range(24))), (300, list(range(24)))]
    found = {r["rec"]: (r["class_id"], r["n_links"]) for r in chroma.align(spark.createDataFrame(rows, "rec long, codes array<int>"), "rec", F.col("rec") % 50 == 0).collect()}
    assert found == {0: (0, 0), 50: (0, 0), 100: (100, 0), 150: (150, 0), 200: (200, 0), 250: (250, 0), 300: (250, 0)}
