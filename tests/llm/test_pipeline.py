"""The pipeline's stages, one after the other, against brute force on what each one gets."""

import hashlib

import pytest
import sentencepiece

import corpus_pipeline
from tablekit.llm import benchmark_leaks
from tablekit.llm.common import tokenizer_file
from test_corpus_operators import brute_classes, brute_repeated


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, out[-1], data).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "repeated_text", "benchmark_leaks", "piece_tokens"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_each_stage_decides_on_what_it_gets(spark, data, stages):
    start, good, distinct, cut, clean, tokens = stages
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    kept = rows(good)
    assert sum(1 for d in kept if labels.get(d) == 1) >= 0.95 * sum(1 for d in labels.values() if d == 1)
    before = list(rows(good).items())
    assert set(rows(distinct)) == {c for _, c, _, _ in brute_classes(before)}
    before = list(rows(distinct).items())
    sizes = {d: n - gone for d, n, gone, _, _ in brute_repeated(before)}
    after = rows(cut)
    assert set(after) == set(sizes) and all(sizes[d] - 3 <= len(t.encode()) <= sizes[d] for d, t in after.items())
    items = [f" {' '.join(benchmark_leaks.words(r['text']))} " for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert set(rows(clean)) == {d for d, t in after.items() if not any(i in f" {' '.join(benchmark_leaks.words(t))} " for i in items)}
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    digest = lambda t: hashlib.sha256(" ".join(map(str, library.encode(t, add_eos=True))).encode()).hexdigest()
    assert {r["doc_id"]: r["ids_sha256"] for r in tokens.collect()} == {d: digest(t) for d, t in rows(clean).items()}


def test_run_is_the_stages(spark, data, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).collect())) == sorted(map(tuple, stages[-1].collect()))
