"""Texts without spaces are scored on all their characters."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from stationlens.llm import toxicity
from tests.llm.test_text_filters import INSULTS, prose, toxic_rows


def test_steps_hold_every_character():
    rng = random.Random(1)
    for n in (24, 25, 42, 43, 500):
        word = "".join(rng.choices("漢字仮名交文読書世界平和", k=n))
        runs = toxicity.steps(word)
        assert all(len(r) <= toxicity.WORD_CHARS for r in runs)
        grams = {r[i : i + 6] for r in runs for i in range(len(r) - 5)}
        assert grams == {word[i : i + 6] for i in range(n - 5)}
    assert toxicity.steps("one/two_three-four\u200bfive.six.seven") == ["one", "two", "three", "four", "five", "six", "seven"]
    assert toxicity.steps("-" * 50) == [""] and toxicity.steps(None) == [] and toxicity.steps("a-b c") == ["a-b", "c"]


@pytest.mark.parametrize("glue", ["", "_", "\u200b", "/"])
def test_toxic_passage_in_a_text_without_spaces(spark, glue):
    rows, labels = toxic_rows(400)
    if not hasattr(test_toxic_passage_in_a_text_without_spaces, "model"):
        test_toxic_passage_in_a_text_without_spaces.model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    clean = prose(60, 9).split()
    toxic = clean[:30] + INSULTS * 3 + clean[30:]
    a, b = toxicity.scorer(test_toxic_passage_in_a_text_without_spaces.model).scores([glue.join(clean), glue.join(toxic)])
    assert b > a + 0.2 and b >= toxicity.THRESHOLD


def test_training_sees_all_words_of_a_long_document():
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}x" for k in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(words)]), pa.array([1])], ["doc_id", "text", "toxic"])
    (bag,) = next(toxicity._cut_windows(iter([batch]))).column(1).to_pylist()
    assert len(bag) == len(toxicity.windows(5000)) and {w for win in bag for w in win.split()} == set(words)
