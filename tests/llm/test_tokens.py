from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stationlens.llm import packing
from stationlens.llm.common import Scratch
from stationlens.llm.packing import _numbered, _sweep, cut, encoder, meet, pack, ranges
from stationlens.llm.token_count import count_tokens, counter
from tests.llm.helpers import none, odd, odd_rows

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "Bé", " ", "  ", "\n", "1", "'s", ".", "\t", "\xa0", "　", "日", "½", "\x1c", "ΑΣ", "İ", "<|endoftext|>", "<|startoftext|>", "don't", "-"]


def mixed(seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 16))) for _ in range(1500)]


def test_counts_equal_the_library():
    own, library = counter(WORD), Tokenizer.from_file(WORD)
    texts = mixed(1) + [r[1] or "" for r in odd_rows()]
    assert [own.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_of_odd_rows(spark):
    rows = count_tokens(odd(spark), WORD, limit=100).collect()
    library = Tokenizer.from_file(WORD)
    assert len(rows) == len(odd_rows())
    want = sorted(((r[0] is None, r[0] or 0), len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in odd_rows())
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)
    assert count_tokens(none(spark), WORD).count() == 0


def test_ids_equal_the_library():
    own = encoder(BYTE)
    assert own.ranked is not None
    for t in mixed(2) + ["x" * 9000, "word " * 3000]:
        assert own.encode(t).tolist() == own.library.encode(t, add_special_tokens=False).ids


def test_cut():
    for n in (1, 5, 7, 8, 14, 15):
        pieces = cut(n, 7)
        assert [s for s, _ in pieces] == [sum(k for _, k in pieces[:i]) for i in range(len(pieces))] and sum(k for _, k in pieces) == n
        assert n <= 7 or all(k == 7 for _, k in pieces[1:])


def best_fit(lengths: list[int], capacity: int) -> int:
    rooms: list[int] = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            rooms.append(capacity - x)
    return len(rooms)


def swept(items: list[tuple]) -> list[tuple]:
    """What one stack over all (size, is_piece, id) gives, longest first and gaps first: pairs of piece and gap."""
    stack, pairs = [], []
    for _, is_piece, ident in sorted(items, key=lambda x: (-x[0], x[1])):
        if not is_piece:
            stack.append(ident)
        elif stack:
            pairs.append((ident, stack.pop()))
    return pairs


def test_sweeps_of_ranges_place_as_many_as_one_sweep_of_all():
    rng = random.Random(5)
    for _ in range(200):
        items = [(rng.randint(1, 20), rng.random() < 0.5, k) for k in range(rng.randint(1, 60))]
        counts = {n: sum(x[0] == n for x in items) for n in range(1, 21)}
        first, many = ranges(counts, 0, 20, rng.choice([1, 3, 10, 100]))
        dealt = sorted(((first[n - 1] + k % many[n - 1], n, is_piece, k) for n, is_piece, k in items), key=lambda x: (x[0], -x[1], x[2], x[3]))
        assert [n for _, n, _, _ in dealt] == sorted((n for n, _, _ in items), reverse=True)
        cut_at = rng.randint(0, len(dealt))  # a range may go on in the next batch
        batches = [pa.RecordBatch.from_arrays([pa.array([x[c] for x in part]) for c in range(4)] + [pa.array([0] * len(part))], ["part", "size", "is_piece", "id", "room"]) for part in (dealt[:cut_at], dealt[cut_at:]) if part]
        rows = [r for b in _sweep(iter(batches)) for r in b.to_pylist()]
        left: dict[int, list[int]] = {}
        for r in rows:
            if r["kind"] in (1, 2):
                left.setdefault(r["part"], [0, 0])[r["kind"] - 1] += 1
        told = {r["part"]: [r["turn"], r["length"]] for r in rows if r["kind"] == 3}
        assert {p: n for p, n in told.items() if any(n)} == left and set(told) == {p for p, *_ in dealt}
        rows = [r for r in rows if r["kind"] < 3]
        over, free = meet({k: tuple(v) for k, v in left.items()})
        rest = [r for r in rows if r["kind"]]
        batch = pa.RecordBatch.from_pylist(rest, pa.schema([("kind", pa.int32()), *((n, pa.int64()) for n in ("part", "turn", "pid", "length", "gap", "room"))]))
        numbered = [r for b in _numbered(over, free)(iter([batch])) for r in b.to_pylist()] if rest else []
        of_gap = {r["number"]: r["gap"] for r in numbered if r["kind"] == 2 and r["number"] is not None}
        far = [(r["pid"], of_gap[r["number"]]) for r in numbered if r["kind"] == 1 and r["number"] is not None]
        assert len(far) == len(of_gap)
        pairs = [(r["pid"], r["gap"]) for r in rows if r["kind"] == 0] + far
        size = {k: n for n, _, k in items}
        assert all(size[p] <= size[g] for p, g in pairs) and len({p for p, _ in pairs}) == len({g for _, g in pairs}) == len(pairs)
        if max(many) == 1:
            assert sorted(pairs) == sorted(swept(items))
        lonely = sorted(r["rank"] for r in numbered if r["rank"] is not None)
        assert lonely == list(range(sum(is_piece for _, is_piece, _ in items) - len(pairs)))


@pytest.mark.parametrize("capacity,low,high,many", [(64, 1, 64, 300), (1024, 100, 500, 400), (10, 1, 10, 200), (1024, 1, 30, 300), (1024, 300, 1024, 200)])
def test_about_as_few_sequences_as_best_fit(spark, monkeypatch, capacity, low, high, many):
    monkeypatch.setattr(packing, "RANGE_ROWS", 40)
    rng = random.Random(capacity)
    lengths = [rng.randint(low, high) for _ in range(many)] + [high] * 20
    pieces = spark.createDataFrame(list(enumerate(lengths)), "pid long, length long")
    rows = [r for t in packing._placed(pieces, capacity, Scratch(spark)) for r in t.collect()]
    assert sorted((r.pid, r.length) for r in rows) == list(enumerate(lengths))
    by: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        by.setdefault(r.gap, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= capacity
    assert len(by) <= best_fit(lengths, capacity) * 1.005 + 1


def test_packing_of_odd_rows(spark):
    library = Tokenizer.from_file(BYTE)
    rows = pack(odd(spark), BYTE, max_tokens=64, end_id=2).collect()
    ids = [[*library.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in odd_rows()]
    want = sorted((r[0] is None, r[0] or 0, k, s, n, zlib.crc32(np.array(x[s : s + n], "<u4").tobytes())) for r, x in zip(odd_rows(), ids, strict=True) for k, (s, n) in enumerate(cut(len(x), 64)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= 64
    assert len(by) <= best_fit([r.length for r in rows], 64) + 1
    assert pack(none(spark), BYTE).count() == 0
