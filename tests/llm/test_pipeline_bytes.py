"""The pipeline's first stage asks for the model over whole bytes."""

import corpus_pipeline as P
from test_pipeline import DOCS
from test_quality_bytes import corpus, spied


def test_the_pipeline_uses_whole_bytes(spark, monkeypatch):
    asked = spied(monkeypatch, P)
    P.quality(spark, spark.createDataFrame(corpus(), DOCS), "")
    assert asked == [False]
