"""Rows that every operator must take: nulls anywhere, empty and long texts, repeated rows, extra columns, no rows."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, bucket int, at long"
WORDS = "the of and station river paper green seven lamp under window bright carry north stone apple cloud quiet seldom garden".split()


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def odd_rows() -> list[tuple]:
    texts = [None, "", " ", "\n\t ", "a", "Two words", "x" * 5000, prose(3000, 1), prose(40, 2), prose(40, 2), "été ñandú ß Ωμ 漢字 🙂 " * 3, "1.2.3.4 <|endoftext|> tab\there", "a  b \n c   d"]
    rows = [(i, t, "en", "s", len(t or ""), 1.0, "k", 1, 2) for i, t in enumerate(texts)]
    rows += [(None, prose(12, 3), None, None, None, None, None, None, None), (8, prose(40, 2), "en", "s", 1, 1.0, "k", 1, 2)]
    return rows


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
