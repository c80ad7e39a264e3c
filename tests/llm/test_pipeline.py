from __future__ import annotations

import re

import corpus_pipeline
from tests.llm.helpers import odd_rows, prose
from tests.llm.test_jaccard import classes

KEY = "Station lamps turn green before the northern gate opens and seldom after the quiet bell has rung twice over"


def tables(spark, folder: str, docs: list[tuple]) -> str:
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, KEY)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_and_run(spark, tmp_path):
    rows = [(i, prose(60, i)) for i in range(30)] + [(100 + i, prose(60, i) + " more") for i in range(5)] + [(200, f"{prose(20, 77)} {KEY}"), (300, f"{prose(30, 78)} ask ann.12@mail.example.com"), (400, None), (401, "")]
    sf_dir = tables(spark, str(tmp_path / "in"), [(i, t, "en", "s", len(t or "")) for i, t in rows])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "private_data", "packing"]
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r.asDict() for r in docs.collect()}
    # only one kind of label: nothing to learn, so nothing is rejected
    assert len(seen["toxicity"]) == len(rows)
    assert set(seen["near_duplicates"]) == set(classes(rows, 5, 80, 100).values())
    assert set(seen["near_duplicates"]) - set(seen["decontamination"]) == {200}
    changed = seen["private_data"][300]["text"]
    assert "ann.12" not in changed and re.search(r"\w+\.\d\d@\w+\.example\.com", changed) and seen["private_data"][300]["n_chars"] == len(changed)
    assert {i: r["text"] for i, r in seen["private_data"].items() if i != 300} == {i: r["text"] for i, r in seen["decontamination"].items() if i != 300}
    assert set(seen["packing"]) == set(seen["private_data"])
    packed = spark.read.parquet(str(tmp_path / "packing")).count()
    assert corpus_pipeline.run(spark, sf_dir).count() == packed


def test_odd_documents(spark, tmp_path):
    sf_dir = tables(spark, str(tmp_path / "in"), [r[:5] for r in odd_rows()])
    assert corpus_pipeline.run(spark, sf_dir).filter("doc_id IS NOT NULL").select("doc_id").distinct().count() == len(set(classes([r[:2] for r in odd_rows()], 5, 80, 100).values()))
    empty = tables(spark, str(tmp_path / "none"), [])
    assert corpus_pipeline.run(spark, empty).count() == 0
