"""Checks of id sets, and sampled sequences, on small tables."""

import hashlib
from collections import Counter

from bioloom.operators import curate, generate


def test_every_violation_of_id_sets(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    fasta = frame([(1, "ACDE"), (2, "ACDF"), (3, "ACXE"), (4, "AC"), (5, "ACDE"), (6, "ACDG"), (6, "ACDG"), (7, None), (None, "ACDE"), (10, "GGGG")], "id long, seq string")
    alignment = frame([(1, "A-CDE"), (2, "ACD-"), (3, "ACXE"), (4, "-AC-"), (5, "ACDE"), (6, "ACDG"), (7, "-"), (8, "ACDE"), (10, "GGGG"), (None, "A")], "id long, aligned string")
    metadata = frame([(i,) for i in (1, 2, 3, 4, 5, 6, 7, 9, None)], "id long")
    profile = frame([(i,) for i in (1, 1, 2, 3, 4, 5, 6, 7, 10)], "id long")
    found = dict(map(tuple, curate.id_set_checks(fasta, alignment, metadata, profile, "id", "seq", "aligned", 3, 10).collect()))
    assert found == {
        2: "msa_sequence_differs", 3: "illegal_letters", 4: "length", 5: "repeated_sequence", 6: "repeated_id", 7: "length",
        8: "not_in_fasta;not_in_metadata;not_in_profile", 9: "not_in_fasta;not_in_msa;not_in_profile", 10: "not_in_metadata",
    }
    sound = [t.where("id = 1") for t in (fasta, alignment, metadata, profile)]
    assert curate.id_set_checks(*sound, "id", "seq", "aligned", 3, 10).collect() == []


def draw(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def test_sampled_lengths_and_letters_follow_the_counts(spark):
    counts = spark.createDataFrame([("C", 3), ("A", 1), ("D", 0)], "aa string, n long")
    lengths = spark.createDataFrame([(5, 1), (2, 2), (9, 1)], "length long, n long")
    found = {r["idx"]: r["seq"] for r in generate.sample_letters(spark, counts, lengths, 400, 7).collect()}
    for i in range(400):
        u = draw(7, i, "length")
        size = 2 if u < 0.5 else 5 if u < 0.75 else 9
        assert found[i] == "".join("A" if draw(7, i, p) < 0.25 else "C" for p in range(size))
    shares = Counter(len(s) for s in found.values())
    assert abs(shares[2] - 200) < 40 and abs(shares[9] - 100) < 40
    assert generate.sample_letters(spark, counts.limit(0), lengths, 5, 7).collect() == [] and generate.sample_letters(spark, counts, lengths.limit(0), 5, 7).collect() == []


def test_lengths_of_sequences(spark):
    rows = spark.createDataFrame([("AC",), ("DE",), ("",), (None,), ("A",)], "seq string")
    assert sorted(map(tuple, generate.length_counts(rows, "seq").collect())) == [(1, 1), (2, 2)]
