"""Benchmark decontamination: rare word n-grams of test items lead to passages that Smith-Waterman alignment scores.

The test items are broadcast in blocks of bounded size; the documents are read once a block to count in how many of
them each seed (an n-gram of an item) occurs, and once to find candidates: an item and a band of diagonals on which a
document has ``RARE_HITS`` seeds that are rare in the corpus, or a share ``SHARE_HITS`` of the item's seeds, rare or not (as
those of a passage that thousands of documents copy are not). The passage around a candidate is aligned with the item
word by word, in memory of the passage's length; the score is the alignment's over that of the whole item against itself. The
fewer words an item has, the higher a score it takes (``NEEDED``), as a few common words in order are no copy. A character of a script
without spaces is a word; what is empty without its punctuation is none. Items of fewer words than a seed are found by whole match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlens.llm.common import own_caches, prepare

SEED_WORDS = 3
#: A seed is rare in at most this share of the documents (or in three).
RARE_SHARE, RARE_HITS = 0.0005, 2
SHARE_HITS, LEAST_HITS = 0.2, 3
BAND = 32
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.4
#: (words, least score) of items with fewer words than the first; of longer ones the threshold's score is enough.
NEEDED = ((5, 1.0), (8, 0.75))
#: A block of test items: words, at most (an item is never cut).
BLOCK_WORDS = 2_000_000
CACHE_ENTRIES = 200_000

_STRIP = ".,;:!?\"'()[]{}<>|*#$%&@^~`+-=_/\\¿¡«»“”‘’…–—。，、！？；：「」『』（）・"
#: Han, kana, Thai, Lao, Burmese, Khmer.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_ONE, _PARTS = re.compile(f"[{_UNSPACED}]"), re.compile(f"[{_UNSPACED}]|[^{_UNSPACED}]+")
FOUND = "doc_id long, item_id long, score double, matched int, first_word long, last_word long"


def normal(chunk: str) -> str:
    return chunk.lower().strip(_STRIP)


def cut(text: str | None) -> tuple[list[str], np.ndarray | None]:
    """The chunks of a text, and the whitespace word each is of where that is not its own place."""
    chunks = text.split() if text else []
    if not chunks or text.isascii() or not _ONE.search(text):
        return chunks, None
    parts = [_PARTS.findall(c) for c in chunks]
    return [p for own in parts for p in own], np.repeat(np.arange(len(parts)), [len(own) for own in parts])


class Items:
    """A block of test items: their words as numbers from 1, and their seeds with postings."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.ids, self.words = [], []
        short: list[tuple[int, np.ndarray]] = []
        for item, text in items:
            words = [w for w in map(normal, cut(text)[0]) if w]
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)
            if len(words) >= SEED_WORDS:
                self.ids.append(item)
                self.words.append(numbers)
            elif len(words):
                short.append((item, numbers))
        self.base = len(self.vocabulary) + 1
        #: By number of words: key of the whole item -> its ids.
        self.short: dict[int, dict[int, list[int]]] = {}
        for item, numbers in short:
            self.short.setdefault(len(numbers), {}).setdefault(int(self.keys(numbers, len(numbers))[0]), []).append(item)
        self.short_keys = {n: np.sort(np.fromiter(own, np.int64, len(own))) for n, own in self.short.items()}
        own = [self.keys(w) for w in self.words]
        flat = np.concatenate(own) if own else np.empty(0, np.int64)
        item = np.repeat(np.arange(len(own)), [len(x) for x in own])
        place = np.concatenate([np.arange(len(x)) for x in own]) if own else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.seeds, self.start = np.unique(flat[order], return_index=True)
        self.end = np.append(self.start[1:], len(flat))
        self.post_item, self.post_place = item[order], place[order]
        self.n_seeds = np.array([len(x) for x in own], np.int64)
        self.rare = np.ones(len(self.seeds), bool)

    def keys(self, ids: np.ndarray, size: int = SEED_WORDS) -> np.ndarray:
        many = max(0, len(ids) - size + 1)
        out = np.zeros(many, np.int64)
        for k in range(size):
            out = out * self.base + ids[k : k + many]
        return out

    def whole(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, words, place) of the items too short for a seed, at their first place."""
        out = []
        for n, own in self.short_keys.items():
            key = self.keys(ids, n)
            for k in range(n):
                key[ids[k : k + len(key)] == 0] = -1
            place = np.flatnonzero(own[np.minimum(np.searchsorted(own, key), len(own) - 1)] == key)
            met, first = np.unique(key[place], return_index=True)
            out += [(item, n, int(place[f])) for k, f in zip(met, first, strict=True) for item in self.short[n][int(k)]]
        return out

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, seed) of the seeds among a document's words; 0 is a word of no item."""
        if len(ids) < SEED_WORDS or not len(self.seeds):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known = ids > 0
        whole = known[: len(ids) - SEED_WORDS + 1].copy()
        for k in range(1, SEED_WORDS):
            whole &= known[k : k + len(whole)]
        at = np.flatnonzero(whole)
        key = np.zeros(len(at), np.int64)
        for k in range(SEED_WORDS):
            key = key * self.base + ids[at + k]
        seed = np.searchsorted(self.seeds, key)
        seed[seed == len(self.seeds)] = 0
        met = self.seeds[seed] == key
        return at[met], seed[met]


def needed(words: int, threshold: float) -> float:
    """The least score at which an item of so many words counts."""
    return next((max(score, threshold) for fewer, score in NEEDED if words < fewer), threshold)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman over words: (score, words matched, first, last) of the best local alignment in the passage.

    Of equal scores the first to end counts. A row of the table is kept at a time, with the start and the matches of the
    alignment that each cell ends.
    """
    n = len(passage)
    place = np.arange(n + 1)
    step = place * -GAP
    up, start, matched = np.zeros(n + 1, np.int64), place.copy(), np.zeros(n + 1, np.int64)
    best = (0, 0, 0, -1)
    for word in item:
        same = passage == word
        diagonal = up[:-1] + np.where(same, MATCH, MISMATCH)
        down = up[1:] + GAP
        took = diagonal >= down
        row, row_start, row_matched = np.zeros(n + 1, np.int64), place.copy(), np.zeros(n + 1, np.int64)
        row[1:] = np.where(took, diagonal, down)
        row_start[1:] = np.where(took, start[:-1], start[1:])
        row_matched[1:] = np.where(took, matched[:-1] + same, matched[1:])
        # a gap along the row costs the same at each step, so a running maximum carries it; its nearest source counts
        risen = np.maximum(row, 0) + step
        highest = np.maximum.accumulate(risen)
        source = np.maximum.accumulate(np.where(risen == highest, place, 0))
        up, start, matched = highest - step, row_start[source], row_matched[source]
        none = up <= 0
        up[none], start[none], matched[none] = 0, place[none], 0
        at = int(up.argmax())
        if up[at] > best[0]:
            best = (int(up[at]), int(matched[at]), int(start[at]), at - 1)
    return best


class Finder(dict):
    """Finds items in whole texts; as a dict it numbers chunks by the items' vocabulary."""

    def __init__(self, items: Items) -> None:
        self.items = items

    def __missing__(self, chunk: str) -> int:
        word = normal(chunk)
        n = self.items.vocabulary.get(word, 0) if word else -1
        if len(chunk) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = n
        return n

    def number(self, text: str | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Numbers of the words, and the whitespace word each is of where that is not its own place."""
        chunks, owner = cut(text)
        ids = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        if len(ids) and ids.min() < 0:
            kept = np.flatnonzero(ids >= 0)
            return ids[kept], kept if owner is None else owner[kept]
        return ids, owner

    def find(self, text: str | None, threshold: float) -> list[tuple[int, float, int, int, int]]:
        it = self.items
        ids, owner = self.number(text)
        at, seed = it.hits(ids)
        word = (lambda k: k) if owner is None else (lambda k: int(owner[k]))
        found = [(item, 1.0, n, word(p), word(p + n - 1)) for item, n, p in it.whole(ids)] if it.short else []
        if len(at) < 1:
            return found
        many = it.end[seed] - it.start[seed]
        first = np.repeat(it.start[seed], many)
        post = first + np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
        item, place = it.post_item[post], it.post_place[post]
        pos, rare = np.repeat(at, many), np.repeat(it.rare[seed], many)
        diagonal = pos - place
        best: dict[int, tuple[float, int, int, int]] = {}
        tried = set()
        for shift in (0, BAND):
            band = (diagonal + shift) // (2 * BAND)
            group = np.stack([item, band], axis=1)
            keys, where, count = np.unique(group, axis=0, return_inverse=True, return_counts=True)
            where = where.reshape(-1)
            few = np.bincount(where, weights=rare, minlength=len(keys))
            seeds = it.n_seeds[keys[:, 0]]
            need = np.minimum(np.where(seeds < LEAST_HITS + SEED_WORDS, RARE_HITS, np.maximum(LEAST_HITS, np.ceil(SHARE_HITS * seeds))), seeds)
            for g in np.flatnonzero((few >= np.minimum(RARE_HITS, seeds)) | (count >= need)):
                k = int(keys[g, 0])
                words = it.words[k]
                own = pos[where == g]
                # hits on one band of diagonals: parts of them that are far apart are passages of their own
                for part in np.split(own, np.flatnonzero(np.diff(np.sort(own)) > 2 * len(words)) + 1):
                    lo, hi = max(0, int(part.min()) - len(words)), min(len(ids), int(part.max()) + len(words) + SEED_WORDS)
                    if (k, lo, hi) in tried:
                        continue
                    tried.add((k, lo, hi))
                    score, matched, a, b = align(words, ids[lo:hi])
                    share = score / (MATCH * len(words))
                    if share >= needed(len(words), threshold) and share > best.get(k, (0.0,))[0]:
                        best[k] = (share, matched, lo + a, lo + b)
        return found + [(it.ids[k], share, matched, word(a), word(b)) for k, (share, matched, a, b) in sorted(best.items())]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    block, words = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        words += len(cut(row[1])[0])
        if words >= BLOCK_WORDS:
            yield block
            block, words = [], 0
    if block:
        yield block


def _count_seeds(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_caches("decontaminate", int)
        finder = Finder(items.value)
        counts = np.zeros(len(finder.items.seeds), np.int64)
        for batch in batches:
            for text in batch.column(0):
                counts[np.unique(finder.items.hits(finder.number(text.as_py())[0])[1])] += 1
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["seed", "n"])

    return run


def _find(items, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_caches("decontaminate", int)
        finder = Finder(items.value)
        for batch in batches:
            found = [(doc, *row) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for row in finder.find(text.as_py(), threshold)]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in enumerate(kinds)], ["doc_id", "item_id", "score", "matched", "first_word", "last_word"])

    return run


def _prepared(docs: DataFrame, benchmark: DataFrame) -> Iterator[object]:
    """Broadcast blocks of test items with their rare seeds marked, from counts over all documents."""
    spark = docs.sparkSession
    prepare(spark)
    texts, total = docs.select(F.col("text").cast("string").alias("text")), None
    for block in _blocks(benchmark):
        items = Items(block)
        if not len(items.seeds):
            if items.short:
                yield spark.sparkContext.broadcast(items)
            continue
        total = texts.count() if total is None else total
        sent = spark.sparkContext.broadcast(items)
        counts = texts.mapInArrow(_count_seeds(sent), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()  # a row a seed of the block
        df = np.zeros(len(items.seeds), np.int64)
        df[counts["seed"].to_numpy()] = counts["n"].to_numpy()
        sent.unpersist()
        items.rare = df <= max(3, RARE_SHARE * total)
        yield spark.sparkContext.broadcast(items)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of ``docs`` and item found in it: doc_id, item_id, score, matched, first_word, last_word.

    Null and empty texts hold no item and are none. Repeated rows (of either table) give their rows each; null ids are
    kept. Other columns are ignored. Without test items there are no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in _prepared(docs, benchmark):
        found = texts.mapInArrow(_find(items, threshold), FOUND)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], FOUND) if out is None else out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text holds no item of the benchmark, with all their columns.

    Null and empty texts hold none and stay, as do null ids; repeated rows stay or go alike. Without test items, or for an
    empty table, it is the table.
    """
    at = docs.columns.index("text")
    for items in _prepared(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            own_caches("decontaminate", int)
            finder = Finder(items.value)
            for batch in batches:
                yield batch.filter(pa.array([not finder.find(t.as_py(), threshold) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
