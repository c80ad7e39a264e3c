from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from stationlens.llm import components as cc
from stationlens.llm.common import Scratch
from stationlens.llm.components import components
from stationlens.llm.jaccard import LEAST_KEYS, Bands, _fold, bitmap, bitmap_width, first_met, jaccard_components, one_of_each, overlap, part_keys
from tests.llm.helpers import none, odd, odd_rows


def sets(text: str | None, size: int) -> set:
    words = re.findall(r"[^\x20\t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def classes(rows: list[tuple], size: int, num: int, den: int) -> dict:
    of = {}
    for i, t in rows:
        of.setdefault(i, []).append(sets(t, size))
    ids = [i for i in of if i is not None]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(ids), 2):
        if any(x and y and den * len(x & y) >= num * len(x | y) for x in of[a] for y in of[b]):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def copies(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for _ in range(25):
        base = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.choice([1, 2, 4, 9, 10, 13, 25, 60, 130]))]
        for _ in range(rng.choice([1, 2, 6, 12])):
            words = [w if rng.random() > 0.01 * rng.choice([0, 0, 1, 3]) else "z" + str(rng.random()) for w in base]
            rows.append((len(rows), " ".join(words[: max(1, round(len(words) * rng.uniform(0.9, 1)))])))
    return rows


@pytest.mark.parametrize("size,num", [(3, 90), (5, 80)])
def test_classes_equal_brute_force(spark, size, num):
    rows = copies(size)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), size, num, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == classes(rows, size, num, 100)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(sets(t, size)) for i, t in rows}


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    got = jaccard_components(odd(spark)).collect()
    want = classes(rows, 3, 90, 100)
    assert len(got) == len(rows)
    assert all(r.component_id == want.get(r.doc_id) for r in got)
    assert jaccard_components(none(spark)).count() == 0
    kept = one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(classes(rows, 5, 80, 100).values()))
    assert kept.filter("doc_id IS NULL").count() == 1


def test_linked_sets_share_a_tile_and_pass_the_bound():
    rng = np.random.default_rng(1)
    for num in (80, 90):
        bands = Bands(num, 100)
        for _ in range(300):
            n = int(rng.integers(1, 200))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.06], rng.integers(0, 2**63, int(rng.integers(0, 6))).astype(np.uint64)]))
            o = overlap(a, b)
            assert o == len(np.intersect1d(a, b))
            width = bitmap_width(min(len(a), max(1, len(b))))
            x, y = _fold(bitmap(a, bitmap_width(len(a))), width // 64), bitmap(b, width)
            assert (x == bitmap(a, width)).all()
            assert o <= (len(a) + len(b) - int(np.bitwise_count(x ^ y).sum())) // 2
            if len(b) and bands.linked(o, len(a), len(b)) and o < max(len(a), len(b)):
                docs, keys = part_keys(np.concatenate([a, b]), np.array([len(a), len(b)]), bands)
                assert set(keys[docs == 0]) & set(keys[docs == 1])


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(70)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: c for x, c in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_components_go_on_to_the_fixed_point(spark, monkeypatch):
    path = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.component for r in components(path, Scratch(spark)).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(path, Scratch(spark), rounds=2)
    # hubs, by broadcast
    monkeypatch.setattr(cc, "HUB_ROWS", 3)
    stars = spark.createDataFrame([(100 * h, 100 * h + k) for h in range(5) for k in range(1, 20)] + [(5, 105), (999, 999)], "a long, b long")
    got = {r.node: r.component for r in components(stars, Scratch(spark)).collect()}
    assert got == {100 * h + k: 0 if h < 2 else 100 * h for h in range(5) for k in range(20)}
    assert components(stars.limit(0), Scratch(spark)).count() == 0


@pytest.mark.parametrize("n", [30, 300, 3000])
def test_disjoint_sets_share_no_tile(n):
    rng = np.random.default_rng(n)
    for docs in (100, 200):
        own = [np.unique(rng.integers(0, 2**63, n + int(rng.integers(0, n // 3))).astype(np.uint64)) for _ in range(docs)]
        _, keys = part_keys(np.concatenate(own), np.array(list(map(len, own))), Bands(80, 100))
        assert len(np.unique(keys)) == len(keys)


def test_a_pair_is_looked_at_in_one_of_its_tiles():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = (np.sort(rng.choice(60, int(rng.integers(1, 30)), replace=False)) for _ in range(2))
        common = np.intersect1d(a, b)
        rows = np.full((2, LEAST_KEYS), np.iinfo(np.int64).max)
        for row, own in zip(rows, (a, b), strict=True):
            row[: min(len(own), LEAST_KEYS)] = own[:LEAST_KEYS]
        looked = [k for k in common if first_met(k, rows[:1], rows[1:])[0]]
        assert (looked == [common[0]] if len(np.intersect1d(rows[0], rows[1][rows[1] < 60])) else looked == list(common)) if len(common) else not looked


def test_large_groups_of_copies(spark, monkeypatch):
    from stationlens.llm import jaccard

    monkeypatch.setattr(jaccard, "LARGE_ROWS", 2)
    rows = [(i, "one text that many have in common") for i in range(9)] + [(20, "another text of its own here"), (21, "another text of its own here"), (22, None), (23, "")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == classes(rows, 3, 90, 100) and len(got) == len(rows)


def test_near_copies_of_one_text_across_classes(spark):
    """A group of near copies that are mostly not alike enough, as long chains and many classes."""
    rng = random.Random(9)
    base, rows = [f"w{k}" for k in range(120)], []
    for i in range(120):
        words = list(base)
        for k in rng.sample(range(120), rng.randint(0, 8)):
            words[k] = f"x{rng.randint(0, 9)}"
        rows.append((i, " ".join(words)))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == classes(rows, 5, 80, 100)
