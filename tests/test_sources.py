"""Files written and read back."""

import pytest
from pyspark.sql import functions as F

from bioloom.functions import residues as R
from bioloom.operators import curate, msa, records
from bioloom.sources import sequences


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fasta").write_bytes(b"\xef\xbb\xbf>id1 gas vesicle [Some thing]\r\nmkv\r\n\r\nLLA\r\n>id2\nACD\n> \nAA\n")
    found = {tuple(r) for r in sequences.read_fasta(spark, str(tmp_path / "a.fasta")).drop("source_file").collect()}
    assert found == {("id1", "gas vesicle [Some thing]", "MKVLLA"), ("id2", "", "ACD")}
    rows = spark.createDataFrame([("x", "A" * 200), ("y", ""), ("z", "C" * 80)], "id string, seq string")
    sequences.write_fasta(rows, str(tmp_path / "out"), "id", F.lit("run_id=7"), "seq")
    back = sequences.read_fasta(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in back.select("sequence_id", "description", "sequence").collect()} == {("x", "run_id=7", "A" * 200), ("z", "run_id=7", "C" * 80)}
    assert max(len(line) for p in (tmp_path / "out").glob("part-*") for line in p.read_text().splitlines()) == 80


def test_tables(spark, tmp_path):
    (tmp_path / "hits.tsv").write_text("a\tb\t95.0\t70\t0.9\t0.8\t1e-5\nc\td\t0.5\t7\t1\t1\t0\n")
    assert [r["identity"] for r in sequences.read_alignment_hits(spark, str(tmp_path / "hits.tsv")).collect()] == [0.95, 0.5]
    (tmp_path / "bad.tsv").write_text("a\tb\t95.0\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        sequences.read_alignment_hits(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "p.tbl").write_text("# c\n\nid1 - q - 1e-9 124.8 0.1 x\n")
    assert [tuple(r) for r in sequences.read_profile_hits(spark, str(tmp_path / "p.tbl")).collect()] == [("id1", 1e-9, 124.8)]
    (tmp_path / "r.json").write_text('[{"sequence": "MK"}, {"sequence": "", "representative_annotation": {"sequence": "AC"}}, {"sequence": null}]')
    assert sorted(r[0] for r in sequences.read_json_records(spark, str(tmp_path / "r.json")).collect()) == ["AC", "MK"]


XML = """<GBSet><GBSeq><GBSeq_length>3</GBSeq_length><GBSeq_accession-version>WP_1.1</GBSeq_accession-version><GBSeq_definition>gas vesicle protein GvpA</GBSeq_definition>
<GBSeq_organism>Nostoc</GBSeq_organism><GBSeq_taxonomy>Bacteria; Cyanobacteriota</GBSeq_taxonomy><GBSeq_sequence>mkv</GBSeq_sequence><GBSeq_feature-table>
<GBFeature><GBFeature_key>source</GBFeature_key><GBFeature_location>1..3</GBFeature_location><GBFeature_quals><GBQualifier><GBQualifier_name>db_xref</GBQualifier_name><GBQualifier_value>taxon:1177</GBQualifier_value></GBQualifier></GBFeature_quals></GBFeature>
<GBFeature><GBFeature_key>Protein</GBFeature_key><GBFeature_location>1..3</GBFeature_location><GBFeature_quals><GBQualifier><GBQualifier_name>product</GBQualifier_name><GBQualifier_value>GvpA</GBQualifier_value></GBQualifier></GBFeature_quals></GBFeature>
<GBFeature><GBFeature_key>Region</GBFeature_key><GBFeature_location>1..3</GBFeature_location><GBFeature_quals><GBQualifier><GBQualifier_name>region_name</GBQualifier_name><GBQualifier_value>PRK09371</GBQualifier_value></GBQualifier><GBQualifier><GBQualifier_name>db_xref</GBQualifier_name><GBQualifier_value>CDD:181805</GBQualifier_value></GBQualifier></GBFeature_quals></GBFeature>
</GBSeq_feature-table></GBSeq></GBSet>"""


def test_annotations(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    row = sequences.read_annotation_xml(spark, str(tmp_path / "a.xml")).first()
    assert (row["accession"], row["taxid"], row["products"], row["region_names"], row["cdd_xrefs"]) == ("WP_1.1", "1177", "GvpA", "PRK09371", "CDD:181805")
    assert row["complete_by_feature"] and not row["partial5"] and row["meta_sequence"] == "MKV"


def test_default_family_rules(spark):
    columns = "seq_order long, sequence_id string, sequence string, header string, has_metadata boolean, meta_sequence string, taxonomy string, organism string, definition string, products string, genes string, comments string, partial5 boolean, partial3 boolean, complete_by_feature boolean, region_names string, cdd_xrefs string"
    good = ("M" * 60, "h", True, "", "Cyanobacteriota", "Nostoc", "gas vesicle protein GvpA", "", "", "", False, False, True, "PRK09371", "CDD:181805")
    rows = [(0, "a", *good), (1, "WP_b", *good), (2, "c", "MJ", *good[1:]), (3, "d", *good[:2], False, *good[3:]), (4, "c", *good[:6], "hypothetical thing", *good[7:])]
    made = curate.resolve_duplicates(curate.classify(spark.createDataFrame(rows, columns)))
    by = {r["seq_order"]: r for r in made.collect()}
    assert by[1]["decision"] == "include" and by[1]["reasons"] == [curate.PASSES]
    assert by[0]["decision"] == "exclude" and by[0]["duplicate_sequence_of"] == "WP_b" and by[0]["reasons"] == [curate.DUPLICATE_SEQUENCE]
    assert "invalid_amino_acids:J" in by[2]["reasons"] and "metadata_not_retrieved" in by[3]["reasons"] and "ambiguous_annotation" in by[4]["reasons"]
    assert [by[i]["duplicate_id_of"] for i in (2, 4)].count("c") == 1


def test_edges_of_scalars(spark):
    df = spark.createDataFrame([("",), ("AAA",), ("AAABBBJ",)], "seq string")
    got = df.select(R.longest_repeat(F.col("seq")), R.kmer_diversity(F.col("seq")), R.is_legal(F.col("seq")), R.detokenize(R.token_ids(F.col("seq")))).collect()
    assert [tuple(r) for r in got] == [(1, 0.0, True, ""), (3, 1.0, True, "AAA"), (3, 1.0, False, "AAAXXXX")]
    low = spark.createDataFrame([("K" * 40,), ("L" * 40,), ("",)], "seq string").select(msa.low_hydropathy_windows(F.col("seq"))).collect()
    assert [r[0] for r in low] == [[0, 16], [], []]
    flags = spark.createDataFrame([("yes",), ("",), ("nan",), ("0",)], "v string").select(records.as_flag(F.col("v"))).collect()
    assert [r[0] for r in flags] == [True, None, None, False]
    with pytest.raises(ValueError):
        records.readonly_sql(spark, {}, "DROP TABLE x")
