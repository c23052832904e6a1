"""The stages of the pipeline against brute force, one after the other."""

import hashlib
import random
import re

import public_tokenizers as vocab
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bioloom.llm import bpe


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(700)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(60)
    rows = [(i, prose(rng.randint(40, 120)), "en", f"s{i % 3}") for i in range(30)]
    rows += [(100, rows[4][1], "en", "s1"), (101, passage + " " + prose(50), "en", "s0"), (102, prose(50) + " " + passage, "en", "s2"), (103, None, "en", "s0"), (104, " 12 ?", None, None), (30, rows[3][1], "en", None)]
    return [(i, t, k, s, len(t) if t is not None else None) for i, t, k, s in rows], passage


def test_stages(spark, corpus):
    rows, passage = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language ID"](spark, docs, "")
    assert kept.columns == docs.columns and {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()} == {103, 104}
    kept = stages["SimHash near-dedup"](spark, kept, "").persist()
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {*range(30), 101, 102} and kept.count() == len(ids)
    cut = stages["suffix-array dedup"](spark, kept, "").persist()
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert cut.columns == docs.columns and passage in texts[101] and passage[10:-10] not in texts[102]
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    mixed = stages["mixing sources to target weights"](spark, cut, "").persist()
    assert mixed.columns == docs.columns
    sizes = {}
    for r in mixed.collect():
        assert texts[r["doc_id"]].startswith(r["text"].rstrip()) and r["n_chars"] == len(r["text"])
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    total = sum(len(t.split()) for t in texts.values())
    assert abs(sum(sizes.values()) - total) <= 3 and sizes["s0"] > sizes["s1"] > sizes["s2"]
    coded = stages["byte-level BPE encoding and decoding"](spark, mixed, "").collect()
    enc = bpe.encoding(vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN)
    expected = sorted((r["doc_id"], len(enc.encode_ordinary(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in mixed.collect())
    assert sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in coded) == expected
    for table in (kept, cut, mixed):
        table.unpersist()


def test_language_stage(spark, corpus):
    """The prediction decides: texts of no learned language go; an unlabelled corpus stays, without letterless texts."""
    rows, _ = corpus
    foreign = [(200, "жшщ ъыь эюя " * 20, None, "s0", 240), (201, "Q" * 300, "en", "s0", 300)]
    docs = spark.createDataFrame(rows + foreign, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["language ID"]
    # What is labelled teaches, so 201 is of the language of its label; 200 is of none.
    assert {r["doc_id"] for r in stage(spark, docs, "").collect()} == {r[0] for r in rows} - {103, 104} | {201}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in stage(spark, unlabelled, "").collect()} == {r[0] for r in rows} - {103, 104} | {200, 201}
    assert stage(spark, docs.limit(0), "").collect() == []


def test_clashing_columns_nulls_and_repeated_ids(spark, corpus):
    """Columns named like those that operators make pass through; null ids and repeated rows stay once."""
    rows, _ = corpus
    names = ["score", "lang_pred", "id", "no_id", "doc", "part", "kept", "removed", "whole", "extra", "words", "size", "mix_words", "Zähl a.b"]
    rows = [*rows[:12], rows[5], rows[5], (None, "no id but these words are here", "en", None, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in names:
        docs = docs.withColumn(name, docs["doc_id"] + len(name))
    given = docs.columns
    for label, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").persist()
        assert docs.columns == given
        found = docs.collect()
        assert {r["doc_id"] for r in found} <= {None, *range(12)} and len(found) >= 8
        assert all(r[name] == (None if r["doc_id"] is None else r["doc_id"] + len(name)) for r in found for name in names)
        if "near" in label:
            assert sorted(r["doc_id"] for r in found if r["doc_id"] is not None) == list(range(12)) and len(found) == 13
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(coded) == docs.count()


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == []


def test_rows_of_null_and_repeated_ids(spark, corpus):
    """Documents are told apart by id and text: only near copies go, whatever their ids, and the mixture takes each by itself."""
    rows, _ = corpus
    texts = [r[1] for r in rows[:14]]
    given = [(None, t) for t in texts[:6]] + [(None, texts[6]), (6, texts[6]), (7, texts[7]), (7, texts[8]), (7, texts[7] + " end"), (None, texts[9]), (None, texts[9])]
    given += [(0, texts[10]), (0, texts[11])]
    expected = [(None, t) for t in texts[:6]] + [(6, texts[6]), (7, texts[8]), (None, texts[9]), (0, texts[10]), (0, texts[11])]
    docs = spark.createDataFrame([(i, t, f"s{n % 2}", 0) for n, (i, t) in enumerate(given)], "doc_id long, text string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["SimHash near-dedup"](spark, docs, "").persist()
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    seven = [t for i, t in found if i == 7 and t != texts[8]]
    assert len(seven) == 1 and seven[0] in (texts[7], texts[7] + " end")
    assert sorted((x for x in found if x != (7, seven[0])), key=str) == sorted(expected, key=str)
    again = stages["SimHash near-dedup"](spark, docs.repartition(5), "").collect()
    assert sorted(map(str, again)) == sorted(map(str, kept.collect()))
    whole = {r["text"] for r in kept.collect() if r["source"] == "s0"}
    mixed = stages["mixing sources to target weights"](spark, kept, "").collect()
    words = sum(len(t.split()) for _, t in found)
    assert abs(sum(len(r["text"].split()) for r in mixed) - words) <= 2
    assert len(whole) > 2 and whole <= {r["text"] for r in mixed}
    kept.unpersist()


@pytest.mark.parametrize("name", ["suffix-array dedup", "byte-level BPE encoding and decoding"])
def test_a_task_has_one_python_worker(spark, corpus, name):
    """Two Python steps without a shuffle between them run in two workers beside each other, twice the memory."""
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string, lang string, source string, n_chars long")
    plan = dict(corpus_pipeline.STAGES)[name](spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("MapInArrow|FlatMapCoGroupsInArrow", plan.split("Exchange")[0])) == 1
