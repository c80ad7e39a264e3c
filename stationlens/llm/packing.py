"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

Bulk-synchronous best-fit. Pieces and gaps are dealt by ranges of size and sorted there, longest first. Pieces are placed in
classes of falling length. In each round every waiting piece of a class bids for its successor, the smallest gap that is large
enough, by a sweep down its range: gaps met go on a stack, a piece takes the top. Of the pieces that bid for one gap that of
the highest rank (the longest) wins it, the others go on to the next larger gap; those that find none in their range meet
the gaps which the ranges above have left, again the smallest first. Then the gaps are updated and the next round follows; what waits after
``ROUNDS`` rounds opens sequences. A gap that holds several pieces of a class for certain takes as many bids.

Pieces and gaps are rows of tables throughout. The driver gets, in each round, how many of each size there are (to cut the
ranges) and how many pieces and gaps each range has left.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlens.llm.common import Scratch, own_caches, prepare, shuffle_partitions

#: Classes of length end at the capacity divided by these.
SHARES = (1, 2, 3, 4, 5, 6, 8, 11, 16, 24, 32, 64, 128, 256)
ROUNDS = 2
#: Rows of a range, at most, but for the shuffle's least number of them.
RANGE_ROWS = 200_000
#: Texts with longer runs without white space go to the library, whose merging is not quadratic.
LONG_RUN_CHARS = 4096
#: The byte-level pre-tokeniser's pattern: a fixed value of this kind of tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
TAKEN, LEFT_OVER, GAP_LEFT, OF_RANGE = 0, 1, 2, 3
PLACE, GAP = 0, 1
_STEP = "kind int, pid long, gap long, offset long, length long"
_SWEPT = "kind int, part long, turn long, pid long, length long, gap long, room long"


class Encoder:
    """Ids of whole texts as the library gives them for a byte-level tokenizer file.

    Where the file's ids are in the order of its merges (checked here), tiktoken merges by the same ranks several times
    as fast. Texts that it might treat otherwise go to the library: those with special tokens, with characters beyond
    the basic plane (whose classes depend on the Unicode version), or with very long runs without white space.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.ranked = _ranked(json.load(f))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self.ranked is None or any(s in text for s in self.specials) or len(text.encode("utf-16-le")) > 2 * len(text) or (len(text) > LONG_RUN_CHARS and max(map(len, text.split()), default=len(text)) > LONG_RUN_CHARS):
            return self.whole(text)
        return self.ranked.encode_to_numpy(text, disallowed_special=())


def _ranked(spec: dict):
    """The same tokenizer for tiktoken, or None where the file is of another kind."""
    import tiktoken

    split = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex") or spec["model"].get("end_of_word_suffix"):
        return None
    # the byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    made = [vocab[a + b] for a, b in pairs]
    if made != sorted(made) or len(vocab) != len(merges) + 256:
        return None
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items()}
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(n: int, max_tokens: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: whole ones, but for a shorter first."""
    if n <= max_tokens:
        return [(0, n)]
    first = n % max_tokens
    return ([(0, first)] if first else []) + [(s, max_tokens) for s in range(first, n, max_tokens)]


def tokenize_pieces(docs: DataFrame, tokenizer: str, max_tokens: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document; a null text is empty, so each document has at least its end id."""
    prepare(docs.sparkSession)
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_caches("packing", _ENCODERS.clear)
        encode = encoder(tokenizer).encode
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), end]).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), max_tokens)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].data)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def classes(capacity: int) -> list[tuple[int, int]]:
    """(over, up to) of the classes of length, longest first."""
    bounds = sorted({capacity // k for k in SHARES if capacity // k}, reverse=True) + [0]
    return list(zip(bounds[1:], bounds[:-1], strict=True))


def ranges(counts: dict[int, int], low: int, high: int, rows: int) -> tuple[list[int], list[int]]:
    """For each size over ``low`` up to ``high``: its first range (they rise as sizes fall) and how many it is dealt to."""
    first, many, part, held = [0] * (high - low), [1] * (high - low), 0, 0
    for size in range(high, low, -1):
        n = counts.get(size, 0)
        if held and held + n > rows:
            part, held = part + 1, 0
        first[size - low - 1], many[size - low - 1] = part, max(1, -(-n // rows))
        if n > rows:
            part, held = part + many[size - low - 1], 0
        else:
            held += n
    return first, many


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, size, is_piece, id, room) by range, longest first, gaps before pieces of their size -> what was taken, what is
    left, and of each range how many pieces (turn) and gaps (length) that are."""
    names, part = [f.split()[0] for f in _SWEPT.split(", ")], None
    stack: list[tuple[int, int]] = []
    out: list[tuple] = []
    turn = 0

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.int64()) for k, c in enumerate(columns)], names)

    def close() -> list[tuple]:
        held = [(GAP_LEFT, part, k, None, None, gap, room) for k, (gap, room) in enumerate(stack)]
        return [*held, (OF_RANGE, part, turn, None, len(stack), None, None)] if part is not None else []

    for rows in batches:
        for p, size, is_piece, ident, room in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if p != part:
                out += close()
                part, stack, turn = p, [], 0
            if not is_piece:
                stack.append((ident, room))
            elif stack:
                gap, left = stack.pop()
                out.append((TAKEN, p, 0, ident, size, gap, left))
            else:
                out.append((LEFT_OVER, p, turn, ident, size, None, None))
                turn += 1
        yield batch(out)
        out = []
    yield batch(close())


def meet(left: dict[int, tuple[int, int]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Pieces and gaps that ranges have left (range -> how many of each), longest first, brought together.

    Returns runs (range, first turn, number) of pieces and (range, last turn, number) of gaps, where a piece and a gap with
    the same number meet: a piece's number rises with its turn, a gap's falls. Gaps that meet none have -1; the number of pieces
    that meet none is -1 less their rank among those.
    """
    pieces, gaps, stack, number, unmet = [], [], [], 0, 0
    for part in sorted(left):
        waiting, free = left[part]
        turn = 0
        while turn < waiting and stack:
            other, top = stack.pop()
            met = min(top, waiting - turn)
            pieces.append((part, turn, number))
            gaps.append((other, top - 1, number))
            if top > met:
                stack.append((other, top - met))
                gaps.append((other, top - met - 1, -1))
            turn, number = turn + met, number + met
        if turn < waiting:
            pieces.append((part, turn, -1 - unmet))
            unmet += waiting - turn
        if free:
            stack.append((part, free))
    return pieces, gaps + [(part, top - 1, -1) for part, top in stack]


def _numbered(pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]]):
    """Rows left over -> with ``number``: at which they meet, or null; pieces that meet none have their ``rank`` among those."""
    up = sorted(pieces)
    down = sorted({(part, turn): number for part, turn, number in gaps}.items())
    shift = 1 << 40
    up_at, up_turn, up_number = (np.array(c, np.int64) for c in ([p * shift + t for p, t, _ in up], [t for _, t, _ in up], [n for _, _, n in up]))
    down_at, down_turn, down_number = (np.array(c, np.int64) for c in ([p * shift + t for (p, t), _ in down], [t for (_, t), _ in down], [n for _, n in down]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, part, turn = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            number, rank = np.full(len(kind), -1, np.int64), np.full(len(kind), -1, np.int64)
            mine = np.flatnonzero(kind == LEFT_OVER)
            if len(mine):
                k = np.searchsorted(up_at, part[mine] * shift + turn[mine], side="right") - 1
                past = turn[mine] - up_turn[k]
                number[mine] = np.where(up_number[k] >= 0, up_number[k] + past, -1)
                rank[mine] = np.where(up_number[k] < 0, -1 - up_number[k] + past, -1)
            mine = np.flatnonzero(kind == GAP_LEFT)
            if len(mine):
                k = np.searchsorted(down_at, part[mine] * shift + turn[mine])
                number[mine] = np.where(down_number[k] >= 0, down_number[k] + down_turn[k] - turn[mine], -1)
            none = lambda x: pa.array(x, mask=x < 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, none(number), none(rank)], [*(f.split()[0] for f in _SWEPT.split(", ")), "number", "rank"])

    return run


def _at(values: list[int], place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), place.cast("int"))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == "int" else pa.int64()) for c, k in zip(columns, kinds, strict=True)], list(names))


_PAIR = "gap long, pid long, length long"


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (number, kind, pid, length, gap) in order: under each number the piece, then the gap that it meets."""
    piece = None
    for batch in batches:
        out = []
        for _, kind, pid, length, gap in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == LEFT_OVER:
                piece = pid, length
            else:
                out.append((gap, *piece))
        yield _batch(out, _PAIR)


def _fill(capacity: int):
    """Rows (group, gap, room, pid, length) by group, its gap first if it has one -> the places of its pieces, and the gap that remains.

    A group without a gap opens a sequence, which is named by its first piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = gap = None
        room = 0
        for batch in batches:
            out = []
            for g, own, free, pid, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    if group is not None and room:
                        out.append((GAP, None, gap, None, room))
                    group, gap, room = g, (pid if own is None else own), (capacity if free is None else free)
                if pid is not None:
                    out.append((PLACE, pid, gap, capacity - room, length))
                    room -= length
            yield _batch(out, _STEP)
        yield _batch([(GAP, None, gap, None, room)] if group is not None and room else [], _STEP)

    return run


def _lengths(pieces: DataFrame) -> dict[int, int]:
    return {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}


def _placed(pieces: DataFrame, capacity: int, scratch: Scratch) -> list[DataFrame]:
    """Tables (pid, gap, offset, length) of all pieces' places; a sequence is named by the first piece in it."""
    spark = pieces.sparkSession
    none = lambda c: F.lit(None).cast("long").alias(c)
    lengths, done = _lengths(pieces), []
    gaps, before = spark.createDataFrame([], "gap long, room long"), ""
    for at, (low, high) in enumerate(classes(capacity)):
        sizes = {n: c for n, c in lengths.items() if low < n <= high}
        if not sizes:
            continue
        waiting = pieces.filter((F.col("length") > low) & (F.col("length") <= high)).select("pid", "length")
        if capacity // high == 1 and low >= capacity // 2:  # no two of them fit together
            done.append(waiting.select("pid", F.col("pid").alias("gap"), F.lit(0).cast("long").alias("offset"), "length"))
            gaps = scratch.keep(waiting.select(F.col("pid").alias("gap"), (F.lit(capacity) - F.col("length")).alias("room")).filter("room > 0"), f"gaps-{at}")
            before = f"gaps-{at}"
            continue
        for round_ in range(ROUNDS):
            name = f"{at}-{round_}"
            free = gaps.filter(F.col("room") > low)
            rooms = {r["room"]: r["n"] for r in free.groupBy("room").agg(F.count("*").alias("n")).collect()}
            # no gap bids for more pieces than twice the mean, as all bids need not be more than twice the pieces
            most = max(1, -(-2 * sum(sizes.values()) // max(1, sum(rooms.values()))))
            bids = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.col("room") / high))).cast("int")
            slots = free.select("gap", "room", F.explode(F.sequence(F.lit(1), bids)).alias("slot"), F.least("room", F.lit(high)).alias("size"))
            counts = dict(sizes)
            for room, n in rooms.items():
                size = min(room, high)
                counts[size] = counts.get(size, 0) + n * min(most, max(1, room // high))
            total = sum(counts.values())
            first, many = ranges(counts, low, high, max(1, -(-total // max(shuffle_partitions(spark), -(-total // RANGE_ROWS)))))
            items = waiting.select(F.col("length").alias("size"), F.lit(True).alias("is_piece"), F.col("pid").alias("id"), F.lit(0).cast("long").alias("room"), F.lit(0).alias("slot"))
            items = items.unionByName(slots.select("size", F.lit(False).alias("is_piece"), F.col("gap").alias("id"), "room", "slot"))
            place = F.col("size") - low
            part = (_at(first, place) + F.pmod(F.xxhash64("id", "slot"), _at(many, place))).cast("long")
            items = items.withColumn("part", part).repartition("part").sortWithinPartitions("part", F.desc("size"), "is_piece", F.desc("room"), "id")
            swept = scratch.keep(items.select("part", "size", "is_piece", "id", "room").mapInArrow(_sweep, _SWEPT), f"swept-{name}")
            over, under = meet({r["part"]: (r["turn"], r["length"]) for r in swept.filter(F.col("kind") == OF_RANGE).collect()})
            rest = swept.filter(F.col("kind").isin(LEFT_OVER, GAP_LEFT)).mapInArrow(_numbered(over, under), f"{_SWEPT}, number long, rank long")
            far = rest.filter("number IS NOT NULL").select("number", "kind", "pid", "length", "gap").repartition("number").sortWithinPartitions("number", "kind").mapInArrow(_pair, _PAIR)
            taken = swept.filter(F.col("kind") == TAKEN).select("gap", "pid", "length").unionByName(far)
            rows = gaps.select(F.col("gap").alias("group"), "gap", "room", none("pid"), none("length"))
            rows = rows.unionByName(taken.select(F.col("gap").alias("group"), "gap", none("room"), "pid", "length"))
            step = rows.repartition("group").sortWithinPartitions("group", F.col("pid").asc_nulls_first()).mapInArrow(_fill(capacity), _STEP)
            unmet = any(n < 0 for _, _, n in over)
            lonely = rest.filter("rank IS NOT NULL").select("pid", "length", "rank")
            if unmet and round_ == ROUNDS - 1:  # the rest opens sequences, each for as many as fit for certain
                own = lonely.select(F.floor(F.col("rank") / (capacity // high)).alias("group"), none("gap"), none("room"), "pid", "length", "rank")
                step = step.unionByName(own.repartition("group").sortWithinPartitions("group", "rank").drop("rank").mapInArrow(_fill(capacity), _STEP))
            kept = scratch.keep(step, f"step-{name}")
            done.append(kept.filter(F.col("kind") == PLACE).drop("kind"))
            gaps = kept.filter(F.col("kind") == GAP).select("gap", F.col("length").alias("room"))
            if not unmet:
                scratch.drop(f"swept-{name}", before)
                break
            if round_ < ROUNDS - 1:
                waiting = scratch.keep(lonely.select("pid", "length"), f"waiting-{name}")
                sizes = _lengths(waiting)
            scratch.drop(f"swept-{name}", before)
            before = ""
    return done or [spark.createDataFrame([], "pid long, gap long, offset long, length long")]


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Nulls: a null text is empty (its end id alone is packed), a null id is kept as null. Repeated rows are packed
    each. An empty table gives no rows. Other columns are ignored. Texts are tokenised once and the pieces kept in the
    shared folder; only narrow rows are shuffled.
    """
    scratch = Scratch(docs.sparkSession)
    made = tokenize_pieces(docs, tokenizer, max_tokens, end_id, id_col, text_col).withColumn("pid", F.monotonically_increasing_id())
    pieces = scratch.keep(made, "pieces")
    places = reduce(DataFrame.unionByName, _placed(pieces, max_tokens, scratch))
    return pieces.join(places.select("pid", F.col("gap").alias("sequence_id"), "offset"), "pid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
