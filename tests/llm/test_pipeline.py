"""The pipeline's stages, each against brute force on what its predecessor kept."""

import random
import re

import corpus_pipeline
import pytest
import sentencepiece
import test_neardup

from arcweft.llm import pieces, quality


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    d = str(tmp_path_factory.mktemp("tables"))
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice(['', 'e', 'ing'])}" for _ in range(n)]
    bench = [(i, " ".join(words(20))) for i in range(5)]
    docs, labels = [], []
    for i in range(160):
        lines = [" ".join(words(rng.randrange(4, 15))).capitalize() + "." for _ in range(rng.randrange(2, 8))]
        bad = i % 4 == 0
        if bad:
            lines = [line.replace(" ", "### ") for line in lines]
        if i % 10 == 1:
            lines.insert(1, bench[i % 5][1])
        if i % 10 == 3:
            lines.append(f"Card 4111 1111 1111 1111 of user{i}@mail.example.org")
        docs.append((i, "\n".join(lines), "en", f"s{i % 3}", 0))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    for i in range(160, 200):
        docs.append((i, docs[i - 160][1] + " Tail.", "en", "s", 0))
    docs.append((300, None, "en", "s", 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, dict(bench)


def test_stages(spark, tables):
    d, bench = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    old = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut(stage(spark, docs, d), name)
        new = {r.doc_id: r for r in out.collect()}
        if name != "encode":
            assert out.columns == docs.columns
        if name == "quality":
            scores = {r.doc_id: r.predicted for r in quality.op3_quality_classifier(docs, spark.read.parquet(f"{d}/labels.parquet")).collect()}
            assert set(new) == {i for i in old if scores[i]}
            assert sum("###" in (r.text or "") for r in new.values()) == 0 and len(new) > 120
        if name == "near_dedup":
            want = test_neardup.brute([(i, r.text) for i, r in old.items()], 5)
            assert set(new) == {i for i, c in want.items() if i == c}
        if name == "decontaminate":
            flat = {i: re.findall("[a-z0-9]+", (r.text or "").lower()) for i, r in old.items()}
            dirty = {i for i, w in flat.items() if any(b in " ".join(w) for b in bench.values())}
            assert dirty and set(new) == set(old) - dirty
        if name == "pii":
            assert set(new) == set(old)
            assert not any("4111 1111 1111 1111" in (r.text or "") or re.search(r"user\d+@", r.text or "") for r in new.values())
            assert all(new[i].text == r.text for i, r in old.items() if "Card" not in (r.text or ""))
        if name == "encode":
            sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
            assert all(r.decoded_equal and r.ids == (None if old[i].text is None else sp.encode(old[i].text)) for i, r in new.items())
        docs, old = out, new
    assert corpus_pipeline.run(spark, d).count() == len(new)


def test_clashing_names_and_repeated_rows(spark, tables):
    d, bench = tables
    text = "Plain words of a quiet line, written well.\nAnd one more line of the same kind."
    rows = [(1, text, "a", 7.0, True), (1, text, "a", 7.0, True), (2, None, "b", None, None), (None, text, "c", 1.0, False), (3, f"So {bench[0]} it is.", "d", 0.0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _quality double, kept boolean")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        assert sum(r.doc_id == 1 for r in out.collect()) == 2 and any(r.doc_id is None for r in out.collect())
        assert any(r.doc_id == 3 for r in out.collect()) == (name != "decontaminate")
    kept = corpus_pipeline.quality_stage(spark, docs, d)
    assert kept.columns == docs.columns and {r._quality for r in kept.collect()} <= {7.0, None, 1.0, 0.0}


def test_empty_documents(spark, tables, tmp_path):
    d, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, d), name)
        assert docs.count() == 0
