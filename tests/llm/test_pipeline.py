"""The pipeline: each stage against brute force on its own input."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pytest
from llm_cases import SF_DIR
from test_dedup_operators import brute_force_lines
from test_row_operators import brute_force_hits, check_packing
from test_similarity_operators import brute_force_groups

import corpus_pipeline
from terralux.llm import common, line_dedup


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage, written and read again in between."""
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        following = spark.read.parquet(path)
        out.append((name, docs, following))
        docs = following
    return {name: (a, b) for name, a, b in out}


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_order_and_columns(stages):
    assert list(stages) == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    first = stages["toxicity"][0].dtypes
    assert all(after.dtypes == first for name, (_, after) in stages.items() if name != "best_fit_packing")


def test_toxic_documents_go(stages):
    labels = pd.read_parquet(f"{SF_DIR}/labels.parquet")
    before, after = stages["toxicity"]
    toxic = set(labels[labels.toxic == 1].doc_id)
    kept = {r.doc_id for r in after.collect()}
    clean = {r.doc_id for r in before.collect()} - toxic
    assert len(toxic & kept) < len(toxic) / 2 and len(clean & kept) > 0.9 * len(clean)


def test_repeated_lines_go(stages):
    before, after = (pairs(x) for x in stages["line_dedup"])
    assert dict(after) == brute_force_lines(before, line_dedup.MIN_WORDS)


def test_one_of_each_group_stays(stages):
    before, after = (pairs(x) for x in stages["ngram_jaccard_join"])
    groups = brute_force_groups(before)
    assert sorted(k for k, _ in after) == sorted(k for k, (_, c) in groups.items() if c == k)


def test_contaminated_go(spark, stages):
    before, after = (pairs(x) for x in stages["benchmark_decontamination"])
    items = pd.read_parquet(f"{SF_DIR}/benchmark.parquet")
    want = [r[0] for r in brute_force_hits(before, list(zip(items.item_id, items.text, strict=True))) if not r[5]]
    assert sorted(k for k, _ in after) == sorted(want)


def test_the_rest_is_packed(stages):
    before, after = stages["best_fit_packing"]
    check_packing(after.collect(), pairs(before))


def test_run_is_all_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF_DIR).count() == stages["best_fit_packing"][1].count()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.count() == 0


@pytest.mark.parametrize("texts", [[], ["a b", None, ""]])
def test_a_partition_of_texts_gives_its_memory_back(monkeypatch, texts):
    freed = []
    monkeypatch.setattr(common, "free_memory", lambda: freed.append(1))
    batch = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": pa.array(texts, pa.string())})
    assert sum(part.num_rows for part, _, _ in common.chunked_texts(iter([batch, batch]))) == 2 * len(texts)
    assert freed == [1]
