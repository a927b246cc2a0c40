"""The lattice in Spark's operators against the model's own library."""

import sentencepiece
from test_pieces import ODD

from arcweft.llm import lattice, pieces


def test_ids_equal_the_library_s(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [t for t in ODD if "▁" not in t and max(map(len, t.split()), default=0) < 60 and len(t) < 400]
    texts += [r.text[:1500] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(12).collect()]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(900, None, 1), (None, "a b", 1), (None, "a b", 1), (1, "x y", 1)]
    got = lattice.encode_relational(spark.createDataFrame(rows, "doc_id long, text string, ids int")).collect()
    want = {(i, None if t is None else tuple(sp.encode(t))) for i, t, _ in rows}
    assert {(r.doc_id, None if r.ids is None else tuple(r.ids)) for r in got} == want and len(got) == len(rows) - 1
    assert lattice.encode_relational(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_on_executors(spark):
    plan = lattice.encode_relational(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
