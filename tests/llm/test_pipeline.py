"""The stages of the corpus pipeline on the small table, each on what its predecessor kept."""

import importlib.util
import os
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from streamweave.llm import bpe

DATA = "/root/testdata/sf0.001"
HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def pipeline():
    spec = importlib.util.spec_from_file_location("corpus_pipeline", f"{HERE}/corpus_pipeline.py")
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the shared tables")
def test_stages(spark, pipeline):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = docs
    sizes = []
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, kept, DATA)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        kept = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(kept.count())
        if name == "quality":
            ids = {r.doc_id for r in kept.collect()}
            good = [i for i, q in labels.items() if q == 1]
            bad = [i for i, q in labels.items() if q == 0]
            assert sum(i in ids for i in good) >= 0.97 * len(good) and sum(i not in ids for i in bad) >= 0.9 * len(bad)
        if name == "dedup":
            assert len({r.text for r in kept.collect()}) == sizes[-1]
    last = pipeline.STAGES[-1][1](spark, kept, DATA)
    b = bpe.bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = last.collect()
    assert len(rows) == sizes[-1] and all(b.decode(r.token_ids).decode() == r.text for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the shared tables")
def test_run(spark, pipeline):
    assert pipeline.ORACLE_SQL is None and pipeline.run(spark, DATA).count() > 0


ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n ", "en", "a", 3), (4, "The river and the stone house stand over the green garden. It was there.", "en", "a", 72),
    (4, "The river and the stone house stand over the green garden. It was there.", "en", "a", 72), (5, "Der Fluss und das Haus sind nicht grün. Das war dort für alle.", "de", None, 62),
    (None, "The table and the chair under the window are old. They were here.", "en", "b", 65), (6, "The quick fox walks over the lazy dog in the garden. " * 3000, "en", "b", 156000), (7, "日本語", None, "b", 3),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_odd_rows(spark, pipeline):
    """Nulls in every column, empty and very long texts, repeated rows, further columns whose names the operators use: every stage has a result, with the columns as they were."""
    docs = spark.createDataFrame(ODD, COLUMNS)
    extra = ["_stays", "_lang_pred", "_lang_score", "score", "node", "_row", "_h", "_g", "_copies", "_key", "_bucket", "n", "kept", "label"]
    docs = docs.withColumns({c: F.lit("extra") for c in extra}).cache()
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert rows and all(r[c] == "extra" for r in rows for c in extra), name
        if name == "language":
            assert {r.doc_id for r in rows} & {1, 2, 3} == set() and Counter(r.doc_id for r in rows)[4] == 2
        if name == "dedup":
            assert Counter(r.doc_id for r in rows)[4] == 1 and sum(r.doc_id is None for r in rows) == 1
    last = pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(last) == len(ODD) and all((r.token_ids == []) == (not r.text) for r in last)


def test_stages_of_nothing(spark, pipeline):
    for name, stage in pipeline.STAGES:
        out = stage(spark, spark.createDataFrame([], COLUMNS), "")
        assert out.count() == 0 and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
