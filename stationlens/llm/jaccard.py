"""Exact set-similarity join of documents on word shingles, and the classes its links make.

Size-banded tiles. Band boundaries grow by half; a document signs its own band, and the next one if a partner there
can still be similar enough. A set can differ from a linked one in at most k shingles (k follows from its size, the
band's upper size and the threshold). The shingles are dealt by hash into somewhat more than k parts; if more than k of a set's parts
are filled, any linked set agrees with it on a filled one. A set with too few filled parts signs more finely cut
levels as well until one has enough, so two linked sets always meet on the first level that is enough for either. A tile is the set of documents
that agree on one filled part: tiles lose no link, and no part without shingles ever joins strangers.

Equal sets count once. Each tile first links its members to its smallest one (no pairs among the rest); members that
are in one class by then need no comparison. What is left is compared block by block: hashed bitmaps, as wide as the
sets need, bound the overlap from above by bit counts, and only pairs that pass meet in an exact intersection of
sorted arrays. Tiles with the same members are compared once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlens.llm.common import Scratch, in_slices, own_caches, semi_by_id, small_enough
from stationlens.llm.components import components

#: Parts beyond k + 1 on the first level: some, and one in so many, as about one in seventy is empty in a set of the largest size.
SPARE_PARTS, SPARE_SHARE = 2, 24
#: A set with more than 1 in so many of all copies, and more than ``LARGE_ROWS``, is led by broadcast.
LARGE_SETS, LARGE_ROWS = 10_000, 200
#: Members of a block and shingles in a block, at most.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 21
#: Of a document's tiles, the smallest keys: enough to tell where most pairs meet first.
LEAST_KEYS = 8
CACHE_ENTRIES = 100_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit of the input."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = h
        return h


_WORDS = _Words()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; the whole sequence is one if it has fewer words.

    Words are maximal runs without ASCII white space, A-Z lower-cased. No words: an empty set.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    rounds = min(size, len(words))
    many = len(words) - rounds + 1
    out = np.full(many, rounds, np.uint64)
    for k in range(rounds):
        out = out * _A + h[k : k + many] * _B
        out ^= out >> _S33
    return np.unique(mix(out))


class Bands:
    """Size bands for a threshold of ``num``/``den``: their bounds, the differences a link allows, their parts."""

    def __init__(self, num: int, den: int) -> None:
        if 3 * num < 2 * den:
            raise ValueError("bands grow by half: a partner must be in the same band or the next")
        self.num, self.den = num, den

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each size's band, and the bounds up to one beyond the last band needed."""
        bounds = [1]
        while bounds[-1] <= int(sizes.max(initial=1)) * 2:
            bounds.append(max(bounds[-1] + 1, math.ceil(bounds[-1] * 1.5)))
        bounds.append(math.ceil(bounds[-1] * 1.5))
        edges = np.array(bounds, np.int64)
        return np.searchsorted(edges, sizes, side="right") - 1, edges

    def allowed(self, upper: np.ndarray) -> np.ndarray:
        """Shingles in which two linked sets of sizes below ``upper`` can differ."""
        return 2 * (upper - 1) * (self.den - self.num) // (self.den + self.num)

    def differences(self, sizes: np.ndarray, upper: np.ndarray) -> np.ndarray:
        """Shingles in which sets of these sizes can differ from any linked one of their band."""
        reach = sizes + sizes * self.den // self.num
        return np.minimum(self.allowed(upper), reach * (self.den - self.num) // (self.den + self.num))

    def linked(self, overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * overlap >= self.num * (a + b - overlap)


def part_keys(flat: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(document index, key) of every filled part of every band and level that a document signs."""
    band, edges = bands.of(sizes)
    out_doc, out_key = [], []
    owner = np.repeat(np.arange(len(sizes)), sizes)
    low, high = (flat & np.uint64(0xFFFFFFFF)).astype(np.float64), (flat >> np.uint64(32)).astype(np.float64)
    for step in (0, 1):
        mine = band + step
        upper = edges[np.minimum(mine + 1, len(edges) - 1)]
        k = bands.allowed(upper)
        need = bands.differences(sizes, upper) + 1
        signs = (sizes > 0) & (k > 0)
        if step:  # a partner in the next band has at least that band's lower bound
            signs &= bands.den * sizes >= bands.num * edges[mine]
        level = 0
        while signs.any():
            salt = mine.astype(np.uint64) * _C + mix(np.full(1, level, np.uint64))
            cut = (k + 1) * (1 << level) + (k // SPARE_SHARE if level == 0 else 0) + SPARE_PARTS
            parts = np.where(signs, cut, 0)
            base = np.cumsum(parts) - parts
            use = signs[owner]
            who, some = owner[use], flat[use]
            slot = base[who] + ((mix(some + salt[who]) >> np.uint64(20)) % parts[who].astype(np.uint64)).astype(np.int64)
            total = int(parts.sum())
            filled = np.bincount(slot, minlength=total) > 0
            sums = [np.bincount(slot, weights=w[use], minlength=total).astype(np.uint64) for w in (low, high)]
            doc = np.repeat(np.arange(len(sizes)), parts)
            part = (np.arange(total) - base[doc]).astype(np.uint64)
            key = mix(mix(sums[0] * _A + sums[1]) + part * _B + salt[doc])
            out_doc.append(doc[filled])
            out_key.append(key[filled])
            signs = signs & (np.bincount(doc[filled], minlength=len(sizes)) < need)
            level += 1
    if not out_doc:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    docs, keys = np.concatenate(out_doc), np.concatenate(out_key)
    order = np.argsort(docs, kind="stable")
    return docs[order], keys[order]


def bitmap_width(n: int) -> int:
    return 1 << max(6, (n - 1).bit_length())


def bitmap(members: np.ndarray, width: int) -> np.ndarray:
    """A parity bitmap as 64-bit words: each member flips one of ``width`` (a power of two) bits.

    Two sets' bitmaps differ in no more bits than the sets do in members, which bounds the overlap from above.
    """
    flips = np.bincount(((members >> np.uint64(7)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.uint64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Exact intersection size of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _signatures(size: int, bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_caches("jaccard", _WORDS.clear)
        for whole in batches:
            for batch in in_slices(whole, 1):
                sets = [shingles(t.as_py(), size) for t in batch.column(1)]
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                hashes = []
                for seed in (_A, _C):
                    run_sum = np.concatenate([[np.uint64(0)], np.cumsum(mix(flat + seed), dtype=np.uint64)])
                    hashes.append(pa.array((run_sum[ends[1:]] - run_sum[ends[:-1]]).view(np.int64)))
                docs, keys = part_keys(flat, sizes, bands)
                offsets = np.searchsorted(docs, np.arange(len(sets) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64)))
                bits = pa.array([bitmap(x, bitmap_width(len(x))).tobytes() for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), *hashes, lists, bits], ["doc_id", "n", "h1", "h2", "keys", "bits"])

    return run


def _members(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_caches("jaccard", _WORDS.clear)
        for whole in batches:
            for batch in in_slices(whole, 1):
                sets = [shingles(t.as_py(), size).view(np.int64) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "members"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, n) in order -> those of keys with several ids, with the key's smallest id as ``center`` and its size."""
    own_caches("jaccard", _WORDS.clear)
    last_key = last_id = center = center_n = None
    pending = None  # the first row of the last key, as long as it is the only one
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ident, n = (batch.column(c).to_numpy() for c in range(3))
        repeated = np.zeros(len(key), bool)
        repeated[1:] = (key[1:] == key[:-1]) & (ident[1:] == ident[:-1])
        repeated[0] = key[0] == last_key and ident[0] == last_id
        key, ident, n = key[~repeated], ident[~repeated], n[~repeated]
        if not len(key):
            continue
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        first, first_n = ident[start], n[start]
        goes_on = key[0] == last_key
        emits = size > 1
        if goes_on:
            first[0], first_n[0], emits[0] = center, center_n, True
            if pending is not None:
                key, ident, n = (np.concatenate([[x], y]) for x, y in zip(pending, (key, ident, n), strict=True))
                size[0] += 1
        alone = size[-1] == 1 and not emits[-1]
        pending = (key[-1], ident[-1], n[-1]) if alone else None
        last_key, last_id, center, center_n = key[-1], ident[-1], first[-1], first_n[-1]
        row = np.repeat(emits, size)
        yield pa.RecordBatch.from_arrays([pa.array(x[row]) for x in (key, ident, n, np.repeat(first, size), np.repeat(first_n, size))], ["key", "id", "n", "center", "center_n"])


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The parity bitmap of a smaller width: bit i stands for all bits that are i modulo it."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _bounded(bands: Bands):
    """Rows (a, b, a_n, a_bits, b_n, b_bits) -> the (a, b) whose bit counts allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True)
            found = []
            for a, b, n, p, m, q in rows:
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                words = min(len(p), len(q))
                p, q = _fold(p, words), _fold(q, words)
                if bands.linked((n + m - int(np.bitwise_count(p ^ q).sum())) // 2, n, m):
                    found.append((a, b))
            yield _pairs(found)

    return run


def _exact(bands: Bands):
    """Rows (a, b, a_members, b_members) -> the linked (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            a_ids, b_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                x, y = (batch.column(c)[i].values.to_numpy().view(np.uint64) for c in (2, 3))
                if bands.linked(overlap(x, y), len(x), len(y)):
                    found.append((a_ids[i], b_ids[i]))
            yield _pairs(found)

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def first_met(here: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs are to be looked at in the tile ``here``, from the ``LEAST_KEYS`` smallest tiles of their members (rows of a and b).

    If both rows hold a common tile, the smallest of those is the smallest that the two share: only it counts. Else any does.
    """
    most = np.iinfo(np.int64).max
    out = np.empty(len(a), bool)
    for k in range(0, len(a), 1 << 14):
        x, y = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
        common = np.where(x[:, :, None] == y[:, None, :], x[:, :, None], most).min(axis=(1, 2), initial=most)
        out[k : k + (1 << 14)] = (common == most) | (common == here)
    return out


def _block(bands: Bands):
    """Rows (key, i, j, id, component, n, block, bits, least) in order of key, i, j -> pairs whose bit counts allow a link.

    A group (key, i, j) is two blocks of a tile, or one; pairs are of members in different classes, one from either block.
    A pair that shares several tiles is looked at in one of them.
    """

    def pairs(key: int, ids: np.ndarray, root: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, bits: list[bytes], least: np.ndarray) -> list[tuple[int, int]]:
        rows = [np.frombuffer(x, np.uint64) for x in bits]
        words = min(map(len, rows))
        whole = np.stack([_fold(x, words) for x in rows])
        found, lows = [], np.flatnonzero(left)
        step = max(1, (1 << 20) // whole.size)
        for a in range(0, len(lows), step):
            own = lows[a : a + step]
            apart = np.bitwise_count(whole[own][:, None] ^ whole[None]).sum(axis=2, dtype=np.int64)
            near = bands.linked((n[own][:, None] + n[None] - apart) // 2, n[own][:, None], n[None])
            near &= (root[own][:, None] != root[None]) & right[None]
            near &= (ids[own][:, None] < ids[None]) | ~(left & right)[None]
            r, c = np.nonzero(near)
            once = first_met(key, least[own][r], least[c])
            r, c = r[once], c[once]
            found.extend(zip(ids[own][r].tolist(), ids[c].tolist(), strict=True))
        return found

    def groups(table: pa.Table) -> list[tuple[int, int]]:
        key, i, j, ids, root, n, block = (table.column(c).to_numpy() for c in range(7))
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        bits, found = table.column(7).to_pylist(), []
        lists = table.column(8).combine_chunks()
        least = np.full((len(key), LEAST_KEYS), np.iinfo(np.int64).max)
        sizes = lists.value_lengths().to_numpy()
        least[np.repeat(np.arange(len(key)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
        for a, b in zip(start, np.append(start[1:], len(key)), strict=True):
            if b - a > 1:
                found += pairs(key[a], ids[a:b], root[a:b], n[a:b], block[a:b] == i[a], block[a:b] == j[a], bits[a:b], least[a:b])
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None  # the rows of the last group, which the next batch may go on with
        for batch in batches:
            table = pa.Table.from_batches([batch] if carry is None else [*carry.to_batches(), batch])
            if not table.num_rows:
                continue
            last = np.stack([table.column(c).to_numpy() for c in range(3)])
            cut = int(np.flatnonzero((last != last[:, -1:]).any(axis=0))[-1]) + 1 if (last != last[:, -1:]).any() else 0
            carry = table.slice(cut)
            if cut:
                yield _pairs(groups(table.slice(0, cut)))
        if carry is not None and carry.num_rows:
            yield _pairs(groups(carry))

    return run


def jaccard_components(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable by links).

    Two documents link when ``den * intersection >= num * union`` of their sets of ``size``-word shingles. A null or
    wordless text has an empty set and links with nothing. Rows that share an id are one document, whose links are
    those of all its rows. A null id has a null component and links with nothing. Repeated rows give a row each;
    other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bands, scratch = Bands(num, den), Scratch(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.keep(texts.mapInArrow(_signatures(size, bands), "doc_id long, n long, h1 long, h2 long, keys array<long>, bits binary"), "signed")

    # equal sets: one representative each, by a pre-aggregated minimum
    full = signed.filter("n > 0 AND doc_id IS NOT NULL")
    sets = scratch.keep(full.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("many")).filter("many > 1"), "sets")
    narrow, whose = signed.select("doc_id", "n", "h1", "h2"), F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")
    # sets with very many copies are broadcast (there are few), so that no task gets all rows of one
    large = F.col("many") > max(LARGE_ROWS, (sets.agg(F.sum("many")).first()[0] or 0) // LARGE_SETS)
    led = narrow.join(F.broadcast(sets.filter(large).select("h1", "h2", "n", F.col("rep").alias("_lead"))), ["h1", "h2", "n"], "left")
    some = led.filter("_lead IS NULL").drop("_lead").join(sets.filter(~large).drop("many"), ["h1", "h2", "n"], "left")
    rows = scratch.keep(some.select("doc_id", "n", whose).unionByName(led.filter("_lead IS NOT NULL").withColumnRenamed("_lead", "rep").select("doc_id", "n", whose)), "rows")
    copies = rows.filter("doc_id <> rep").select("doc_id").distinct()
    own = signed.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "keys").join(F.broadcast(copies) if small_enough(copies, 1_000_000) else copies, "doc_id", "left_anti")
    signs = own.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"), "n")

    # tiles with more than one member; their smallest is the first partner of all. One shuffle of the keys: a tile's rows
    # stream through a task in order, none is held but the first
    tiles = scratch.keep(signs.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_shared, "key long, id long, n long, center long, center_n long"), "tiles")
    ids = scratch.keep(tiles.select(F.col("id").alias("doc_id")).distinct(), "ids")
    maps = scratch.keep(semi_by_id(signed.select("doc_id", "n", "h1", "h2", "bits"), ids, "doc_id").dropDuplicates(["doc_id", "h1", "h2"]).select("doc_id", "n", "bits"), "maps")
    scratch.drop("signed")

    def sided(pairs: DataFrame, side_rows: DataFrame, *columns: str) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(side_rows.select(F.col("doc_id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns)), side)
        return pairs.select("a", "b", *(f"{side}_{c}" for side in ("a", "b") for c in columns))

    def links(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that the exact intersection confirms; only their documents' arrays are made."""
        pairs = scratch.keep(pairs, name)
        met = scratch.keep(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), f"{name}-ids")
        arrays = scratch.keep(semi_by_id(texts, met, "doc_id").mapInArrow(_members(size), "doc_id long, members array<long>"), f"{name}-arrays")
        return sided(pairs, arrays, "members").mapInArrow(_exact(bands), "a long, b long")

    # a first pass over likely pairs: of a tile's smallest member and one it shares several tiles with, of fitting sizes
    fitting = F.lit(den) * F.least("n", "center_n") >= F.lit(num) * F.greatest("n", "center_n")
    partners = tiles.filter((F.col("id") != F.col("center")) & fitting).groupBy(F.col("id").alias("a"), F.col("center").alias("b")).agg(F.count("*").alias("tiles")).filter("tiles > 1").drop("tiles")
    stars = links(sided(partners, maps, "n", "bits").mapInArrow(_bounded(bands), "a long, b long"), "partners")
    # rows of one id but different sets
    least = rows.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).filter("b < most")
    again = rows.join(least, "doc_id").select(F.col("rep").alias("a"), "b")
    first = scratch.keep(components(stars.unionByName(again), scratch, "stars"), "first")

    # members of a tile that are in different classes still: block by block, once for each set of members
    marked = tiles.select("key", "id", "n").join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    marked = scratch.keep(marked, "marked")
    opened = marked.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("many"), F.max("n").alias("widest"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("y"))
    opened = opened.filter("lo < hi").groupBy("many", "x", "y").agg(F.min("key").alias("key"), F.max("widest").alias("widest"))
    fit = F.greatest(F.lit(8), F.least(F.lit(BLOCK_DOCS), F.floor(F.lit(BLOCK_SHINGLES) / F.col("widest"))))
    opened = opened.select("key", F.ceil(F.col("many") / fit).cast("int").alias("blocks"))
    inside = scratch.keep(marked.join(opened, "key").select("key", "id", "component", "n", "blocks"), "inside")
    least = inside.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LEAST_KEYS).alias("least"))
    dealt = inside.join(least.join(maps.select(F.col("doc_id").alias("id"), "bits"), "id"), "id").withColumn("block", F.expr("cast(pmod(xxhash64(id, key), blocks) as int)"))
    dealt = dealt.select("key", "id", "component", "n", "bits", "least", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", "id", "component", "n", "bits", "least", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "id", "component", "n", "block", "bits", "least")
    more = scratch.keep(links(ordered.mapInArrow(_block(bands), "a long, b long").distinct(), "near"), "more")
    joined = first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    last = scratch.keep(components(joined, scratch, "all"), "last")
    out = scratch.keep(rows.join(last.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")), "out")
    scratch.paths.pop("out")  # the result is read from it
    scratch.drop()
    return out


def one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, with all columns, of the smallest id of each class; one row where an id is repeated.

    Rows with a null id stay, as they link with nothing.
    """
    classes = jaccard_components(docs, size, num, den)
    gone = classes.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(F.broadcast(gone) if small_enough(gone, 1_000_000) else gone, "doc_id", "left_anti").select(*docs.columns)
    if classes.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        kept = kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id IS NULL"))
    return kept
