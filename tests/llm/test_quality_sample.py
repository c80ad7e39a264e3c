"""The scorer's sample is of distinct texts, the lowest hashes first, whatever is copied."""

from __future__ import annotations

from stationlens.llm import quality
from tests.llm.helpers import prose


def test_sample_of_distinct_texts(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_DOCS", 20)
    rows = [(None,)] * 300 + [("a copied text",)] * 300 + [(prose(20, i),) for i in range(300)]
    texts = spark.createDataFrame(rows, "text string")
    one, other = (sorted(tuple(r) for r in quality.sampled(t).collect()) for t in (texts.repartition(7), texts.coalesce(1)))
    assert one == other and len(one) == 40
    assert None not in {t for t, _ in one} and all(n == (300 if t == "a copied text" else 1) for t, n in one)
    assert quality.sampled(texts.filter("text IS NULL")).count() == 0
    assert quality.quality(texts.filter("text IS NULL").selectExpr("1L AS doc_id", "text")).count() == 300
