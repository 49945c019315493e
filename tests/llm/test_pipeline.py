"""The pipeline against a brute-force version of its stages."""

from __future__ import annotations

import pytest

import corpus_pipeline
from frameloom.llm import queries
from tests.llm.test_dedup import brute, digest
from tests.llm.test_tokens import WORDS, check_packing, tokenizer


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        results[name] = out.collect()
        if name != "best_fit_packing":
            assert out.columns == columns and out.count() <= seen
            docs, seen = out, out.count()
    ids = lambda name: {r["doc_id"] for r in results[name]}
    last = {}
    for r in results["quality_classifier"]:
        last[digest(r["text"])] = max(r["doc_id"], last.get(digest(r["text"]), -1))
    assert ids("exact_dedup") == set(last.values())
    rows = [(r["doc_id"], r["text"]) for r in results["exact_dedup"]]
    assert ids("near_dedup") == {i for i, v in brute(rows, 5).items() if v[2]}
    texts = {r["doc_id"]: r["text"] for r in results["near_dedup"]}
    check_packing(results["best_fit_packing"], {i: [*tokenizer(WORDS).encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}, 4096)
    assert {r["doc_id"] for r in results["best_fit_packing"]} == set(texts)


def test_run_gives_the_last_stage(spark, small):
    rows = corpus_pipeline.run(spark, small)
    assert rows.columns[:3] == ["doc_id", "piece", "start"] and rows.count() > 0


def test_runs_side_by_side_keep_their_tables(spark):
    from concurrent.futures import ThreadPoolExecutor

    from frameloom.llm import shared

    def run(k):
        since = shared.mark()
        first, last = (shared.written(spark.range(k * 10 + j + 1), "side") for j in range(2))
        gone = shared.clear(spark, since, last)
        return gone, last.count(), first.inputFiles()

    with ThreadPoolExecutor(2) as pool:
        a, b = pool.map(run, (1, 2))
    assert (a[:2], b[:2]) == ((1, 12), (1, 22))


def test_every_query_is_registered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]


@pytest.fixture(scope="module")
def odd_folder(odd, spark, tmp_path_factory):
    """Odd documents with clashing columns, and ratings with nulls, doubles and unknown ids."""
    folder = tmp_path_factory.mktemp("odd")
    odd.write.parquet(f"{folder}/documents.parquet")
    ratings = [(3, 1, 0), (4, 1, 0), (4, None, None), (5, None, 0), (7, 0, 1), (99, 1, 0), (None, 1, 0)]
    spark.createDataFrame(ratings, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_on_odd_documents(spark, odd, odd_folder):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd_folder)
        assert out.columns == odd.columns
        ids = {r["doc_id"] for r in out.collect()}
        assert ids <= {r["doc_id"] for r in docs.collect()}
        if name == "language_id":
            assert not ids & {0, 1, 2, 12}
        if name == "exact_dedup":
            assert 4 not in ids  # row 5 has its text and a larger id
        docs = out if ids else docs
    pieces = corpus_pipeline.STAGES[-1][1](spark, odd, odd_folder)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in odd.collect()}


def test_stages_on_an_empty_table(spark, nothing, odd_folder):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, nothing, odd_folder)
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == nothing.columns)


def test_without_ratings_all_documents_stay(spark, odd, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.quality_classifier(spark, odd, str(tmp_path)).count() == odd.count()
