"""Items are found past detached marks, without spaces, and however short they are."""

from __future__ import annotations

from stationlens.llm import decontaminate
from tests.llm.helpers import prose

FORMULA = "given x = 3 + 4 , y = x - 2 and z = 9 find alpha beta gamma delta"
HAN = "请计算下列方程的所有整数解并说明理由"


def test_items_that_word_seeds_miss(spark):
    items = [(1, FORMULA), (2, " ".join(f"quux{k}" for k in range(20))), (3, "seven - dwarfs dig deep"), (4, HAN), (5, "rhubarb custard"), (6, "ทดสอบ"), (7, "zyzzyva"), (8, "| = -"), (9, None)]
    docs = [
        (1, f"{prose(20, 1)} {FORMULA} {prose(20, 2)}"), (2, f"a | {' | '.join(f'Quux{k}' for k in range(20))} | b"), (3, "so seven - dwarfs dig - deep, down"), (4, f"题目：{HAN}。答案"),
        (5, "- my Rhubarb - custard."), (6, "การทดสอบนี้"), (7, "x zyzzyva"), (8, prose(50, 3) + " | = -"), (9, "custard rhubarb seven deep dwarfs"), (10, None), (11, ""),
    ]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.leaks(frame, bench).collect()}
    assert {(d, r.item_id) for d, r in got.items()} == {(k, k) for k in range(1, 8)}
    assert all(got[k].score == 1 for k in range(1, 8))
    assert (got[2].first_word, got[2].last_word) == (2, 40) and (got[5].first_word, got[5].last_word) == (2, 4) and (got[4].first_word, got[4].last_word) == (0, 0)
    assert {r.doc_id for r in decontaminate.remove_leaks(frame, bench).collect()} == {8, 9, 10, 11}
    only = bench.filter("item_id = 5")
    assert [r.doc_id for r in decontaminate.leaks(frame, only).collect()] == [5]
