"""The pipeline stage by stage against brute force, the registered queries, and their SQL."""

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from docloom.llm import quality
from docloom.storage import cut
from pyspark.sql import functions as F
from test_operators import PATH, _slow_components, _slow_dedup, _slow_hash, _slow_overlaps
from tokenizers import Tokenizer

import __spark_entry__ as contract
from check import compare, oracle_connection

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "op1_bpe", "op2_quality", "op3_winnowing", "op4_resharding", "op5_decontamination", "op6_chat", "op7_simhash", "op8_secrets",
    "op9_line_dedup", "op10_toxicity", "op11_whitening", "op12_suffix_dedup", "op13_filter_audit", "pipeline",
]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that go into each stage, and what the last one returns."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, FOLDER), f"test-{name}")
        out.append(docs)
    return out


def _texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns_of_documents(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "bpe"]


def test_quality_keeps_what_is_labelled_good(spark, stages):
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {i for i, _ in _texts(stages[1])}
    known = [i for i, _ in _texts(stages[0]) if i in marks]
    assert sum((i in kept) == bool(marks[i]) for i in known) >= 0.97 * len(known)
    network = quality.fit(stages[0], spark.read.parquet(f"{FOLDER}/labels.parquet"), F.lit(True))
    scored = quality.score(stages[0], network).collect()
    assert kept == {r.doc_id for r in scored if r.score >= quality.THRESHOLD}


def test_lines_near_duplicates_and_overlaps_against_brute_force(spark, stages):
    lines = _texts(stages[2])
    assert Counter(lines) == _slow_dedup(_texts(stages[1]))
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())
    prints = {i: _slow_hash(t) for i, t in lines}
    roots = _slow_components(set(prints.values()), 2)
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(least.get(roots[p], i), i)
    assert sorted(i for i, _ in _texts(stages[3])) == sorted(least.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    gone = {i for i, _ in _slow_overlaps([(i, t) for i, t in _texts(stages[3]) if len(t) < 1500], items)}
    kept = {i for i, _ in _texts(stages[4])}
    assert all((i in kept) == (i not in gone) for i, t in _texts(stages[3]) if len(t) < 1500)


def test_ids_are_those_of_the_library(stages):
    theirs = Tokenizer.from_file(PATH)
    theirs.no_truncation()
    theirs.no_padding()
    got = {r.doc_id: r for r in stages[5].collect()}
    texts = _texts(stages[4])
    assert len(got) == len(texts)
    for i, t in texts:
        ids = np.array(theirs.encode(t, add_special_tokens=False).ids, "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_run_gives_the_rows_of_the_stages(spark, stages):
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = corpus_pipeline.run(spark, FOLDER).select(*columns).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, stages[5].select(*columns).collect()))


def test_stages_on_odd_rows_and_on_none(spark, documents, odd_texts, tmp_path):
    empty_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty_labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (documents(odd_texts, clash=True), documents([])):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, str(tmp_path))
            rows = made.count()
            if name == "quality":
                assert rows == 0  # without labels every text scores a half, which is below the threshold
            elif name in ("line_dedup", "bpe"):
                assert rows == docs.count()
            else:
                assert rows <= docs.count() and made.columns == docs.columns


def test_all_queries_are_registered():
    known = contract.queries()
    assert all(name in known for name in NAMES)


@pytest.mark.parametrize("name", ["op5_decontamination", "op6_chat", "op8_secrets"])
def test_queries_against_sql(spark, name):
    assert compare(spark, oracle_connection(FOLDER), name, FOLDER) == ""


@pytest.mark.parametrize("name", ["op1_bpe", "op2_quality", "op3_winnowing", "op4_resharding", "op7_simhash", "op9_line_dedup", "op10_toxicity"])
def test_queries_return_a_row_per_document(spark, name):
    got = contract.queries()[name](spark, FOLDER)
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert sorted(ids) == sorted(i for i, _ in _texts(spark.read.parquet(f"{FOLDER}/documents.parquet")))
