"""Each stage of the corpus pipeline on rows with repeated and null ids and with columns of its helpers' names."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, guess string, _guess int, _text string, _hit long, row string, part string, text_id long"
SENTENCE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions"


def prose(seed: int, n: int = 80) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioutnrslm") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, SENTENCE), (None, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", 5, "g", 1, "t", 2, "r", "p", 3) for i, t in pairs], DOCS)


def ids_and_texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_language_stage(spark, sf_dir):
    docs = frame(spark, [(i, prose(i)) for i in range(6)] + [(0, "1 2 3"), (None, None), (None, prose(9))])
    got = corpus_pipeline.known_language(spark, docs, sf_dir)
    assert got.schema.names == docs.schema.names and {r.guess for r in got.collect()} == {"g"}
    assert ids_and_texts(got) == ids_and_texts(docs.where("text rlike '[a-z]'"))
    assert corpus_pipeline.known_language(spark, docs.limit(0), sf_dir).collect() == []


def test_group_stage(spark, sf_dir):
    one, two, near = prose(1), prose(2), prose(1) + " end"
    docs = frame(spark, [(1, one), (1, two), (2, one), (3, near), (4, None), (4, ""), (4, None), (None, prose(3)), (None, two), (5, prose(5)), (5, prose(5))])
    got = corpus_pipeline.one_of_each_group(spark, docs, sf_dir)
    assert got.schema.names == docs.schema.names
    assert ids_and_texts(got) == sorted([(1, one), (1, two), (4, None), (4, ""), (4, None), (None, prose(3)), (5, prose(5))], key=str)
    assert corpus_pipeline.one_of_each_group(spark, docs.limit(0), sf_dir).collect() == []


def test_benchmark_stage(spark, sf_dir):
    docs = frame(spark, [(1, "so " + SENTENCE), (1, "clean words"), (None, SENTENCE), (None, "clean"), (2, None), (2, "")])
    got = corpus_pipeline.clean_of_benchmark(spark, docs, sf_dir)
    assert got.schema.names == docs.schema.names
    assert ids_and_texts(got) == sorted([(1, "clean words"), (None, "clean"), (2, None), (2, "")], key=str)
    assert corpus_pipeline.clean_of_benchmark(spark, docs.limit(0), sf_dir).collect() == []


def test_secret_stage(spark, sf_dir):
    docs = frame(spark, [(1, "password=hunter22x end"), (1, "nothing here"), (None, None), (2, "")])
    got = corpus_pipeline.without_secrets(spark, docs, sf_dir)
    assert got.schema.names == docs.schema.names and {r._text for r in got.collect()} == {"t"}
    by = {(r.doc_id, r.text is None or "end" in r.text): r for r in got.collect()}
    assert "hunter22x" not in by[1, True].text and by[1, True].n_chars == len(by[1, True].text)
    assert by[1, False].text == "nothing here" and by[1, False].n_chars == 5 and by[None, True].text is None
    assert "n_chars" not in corpus_pipeline.without_secrets(spark, docs.drop("n_chars"), sf_dir).columns


def test_packing_stage(spark, sf_dir):
    docs = frame(spark, [(1, prose(1, 3000)), (1, "a"), (None, None), (2, "")])
    got = corpus_pipeline.packed(spark, docs, sf_dir).collect()
    assert sum(r.length for r in got if r.doc_id in (2, None)) == 2
    used: dict = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 2048
