"""The pipeline, and the queries' registration."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from sparsemill.llm import queries
from sparsemill.llm.common import stored

from .helpers import frame, prose, simple
from .test_simhash import fingerprint


@pytest.fixture
def sf_dir(spark, tmp_path):
    from .helpers import corpus

    frame(spark, corpus(80)).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "lines", "near_dedup", "substrings", "pack"]
    for name, stage in pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, sf_dir), name)
        assert out.columns == columns and out.schema == docs.schema
        assert 0 < out.count() <= docs.count()
        for r in out.where("text is not null").collect():
            assert r.n_chars == len(r.text)
        docs = out
    packed = pipeline.pack(spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    whole = pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "length", "ids_crc32").collect()), key=str) == sorted(map(tuple, packed.select("doc_id", "piece", "length", "ids_crc32").collect()), key=str)


def test_one_of_each_group_stays(spark):
    import random

    text = prose(random.Random(1), 200)
    rows = [(5, text), (3, text), (3, text), (9, text + " x"), (7, "a different text altogether"), (None, text), (None, "no id, one of a kind here"), (None, None)]
    got = pipeline.near_dedup(spark, simple(spark, rows).select("doc_id", "text", "lang", "source", "n_chars"), "").collect()
    near = (fingerprint(text) ^ fingerprint(text + " x")).bit_count() <= 2
    want = [(3, text), (7, rows[4][1]), (None, rows[6][1]), (None, None)] + ([] if near else [(9, text + " x")])
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)


def test_unlike_texts_of_one_id_stay(spark):
    rows = [(1, "one text of eight words under this id"), (1, "quite another one that shares nothing with it"), (1, "one text of eight words under this id"), (2, "one text of eight words under this id")]
    docs = frame(spark, [(i, t, lang, "s", len(t), 1, 2, 3, 4, "g", "v", 5) for lang in ("de", "en") for i, t in rows]).select("doc_id", "text", "lang", "source", "n_chars")
    first = sorted(map(tuple, pipeline.near_dedup(spark, docs, "").collect()))
    assert [(x[0], x[1]) for x in first] == sorted({rows[0], rows[1]})
    assert first == sorted(map(tuple, pipeline.near_dedup(spark, docs.repartition(7), "").collect()))


def test_empty_table(spark):
    docs = frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_names():
    assert sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0])) == [n for k in range(1, 11) for n in queries.queries() if n.startswith(f"op{k}_")]
    assert len(queries.queries()) == 10 and {*queries.queries(), "pipeline"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
