"""Cross-entropy difference between a target and a background n-gram model.

Both models are interpolated bigram models over one shared vocabulary, that of all words of both sets; the background is all
other documents. All words, histories and pairs are counted, by 64-bit hashes, in both sets.

Documents are dealt to chunks of bounded size by a hash of their id and text. A chunk asks for the counts of its distinct
keys, each once however often it occurs there, with its own counts beside them; the keys are sorted, so that their differences and counts
are a few bytes each. A range of the key space gathers what all chunks ask of it, sums the counts and answers each chunk in
the order of its questions. So what is gathered grows with the corpus, a frequent pair is a row a chunk rather than one an
occurrence, and nothing is broadcast but the target's ids (up to a bound). The chunk then scores its documents, each without
its own counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlens.llm.common import Scratch, own_caches, prepare, shuffle_partitions, small_enough
from stationlens.llm.jaccard import mix

#: Weights of the pair, word and uniform parts.
WEIGHTS = (0.55, 0.4, 0.05)
CACHE_ENTRIES = 200_000
#: Ids that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Characters of a chunk, about, and keys that chunks ask of a range of the key space, about.
CHUNK_CHARS, RANGE_KEYS = 4_000_000, 1_000_000

_STRIP = ".,;:!?\"'()[]{}<>|*#$%&@^~`+-=_/\\¿¡«»“”‘’…–—"
SCORES = "doc_id long, n_words long, target_loss double, background_loss double, score double"
_ASKED = "range long, chunk long, payload binary"
_ANSWERED = "chunk long, range long, words long, t long, b long, payload binary"
_CHUNK = "chunk long, kind int, range long, doc_id long, side int, text string, payload binary"

#: What a key is of, in its two lowest bits; the others are a hash. Fewer bits make smaller differences of sorted keys.
PAIR, WORD, HISTORY = 0, 1, 2
KEY_BITS = 56
_SEEDS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _Numbers(dict):
    def __missing__(self, chunk: str) -> int:
        n = xxhash.xxh3_64_intdigest(chunk.lower().strip(_STRIP))
        if len(chunk) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = n
        return n


_NUMBERS = _Numbers()


def number(text: str | None) -> np.ndarray:
    words = text.split() if text else []
    return np.fromiter(map(_NUMBERS.__getitem__, words), np.uint64, len(words))


def keys(before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word that follows another: the keys of the pair, the word and its history."""
    own = lambda x, kind: (mix(x + _SEEDS[kind]) >> np.uint64(66 - KEY_BITS) << np.uint64(2)) | np.uint64(kind)
    return own(mix(before) * _SEEDS[1] + word, PAIR), own(word, WORD), own(before, HISTORY)


def bits(p: np.ndarray, h: np.ndarray, w: np.ndarray, total: np.ndarray, vocabulary: int) -> np.ndarray:
    """Bits for a word, from the counts of the pair, its history, the word and all words.

    Over the vocabulary the probabilities add up to 1 after any history: what an unknown history or an empty set cannot
    say goes to the next part.
    """
    a, b, c = WEIGHTS
    a = np.where(h > 0, a, 0.0)
    b = np.where(total > 0, WEIGHTS[0] + WEIGHTS[1] - a, 0.0)
    c = 1 - a - b
    return -np.log2(a * p / np.maximum(h, 1) + b * w / np.maximum(total, 1) + c / vocabulary)


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of numbers of one length, 64 bits each, by planes of bytes, compressed."""
    n = len(arrays[0])
    planes = np.stack([np.asarray(x).astype("<u8") for x in arrays]).view(np.uint8).reshape(len(arrays), n, 8).transpose(0, 2, 1)
    return n.to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, many: int) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], decompressed_size=n * many * 8, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(many, 8, n).transpose(0, 2, 1)).view("<u8").reshape(many, n)


class Chunk:
    """Documents that are counted and scored together."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.sides: list[int] = []
        self.words: list[np.ndarray] = []

    def add(self, doc_id: int | None, side: int, text: str | None) -> None:
        self.ids.append(doc_id)
        self.sides.append(side)
        self.words.append(number(text))

    def count(self) -> None:
        """``keys``, sorted and distinct, their counts in the target ``t`` and the background ``b``, and where each word's are (``at``)."""
        self.n = np.fromiter(map(len, self.words), np.int64, len(self.words))
        flat = np.concatenate([*self.words, np.empty(0, np.uint64)])
        self.words = []
        self.owner = np.repeat(np.arange(len(self.n)), self.n)
        self.side = np.array(self.sides, np.int64)
        before = np.zeros(len(flat), np.uint64)
        before[1:] = flat[:-1]
        starts = np.cumsum(self.n) - self.n
        before[starts[self.n > 0]] = 0  # the start of a text
        self.keys, where = np.unique(np.concatenate(keys(before, flat)), return_inverse=True)
        self.at = where.reshape(3, len(flat))
        of_target = np.tile(self.side[self.owner], 3)
        self.t = np.bincount(where, weights=of_target, minlength=len(self.keys)).astype(np.int64)
        self.b = np.bincount(where, minlength=len(self.keys)) - self.t

    def asked(self, shift: int) -> Iterator[tuple[int, bytes]]:
        """(range, payload) of the keys in each range of the key space."""
        part = (self.keys >> np.uint64(shift)).astype(np.int64)
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, e in zip(starts, [*starts[1:], len(part)], strict=False):
            own = self.keys[a:e]
            yield int(part[a]), packed([np.diff(own, prepend=np.uint64(0)), self.t[a:e], self.b[a:e]])

    def scored(self, t: np.ndarray, b: np.ndarray, totals: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Each document's summed bits under both models, from the counts of the keys in all documents."""
        own = []
        for at in self.at:
            _, where, n = np.unique(self.owner * len(self.keys) + at, return_inverse=True, return_counts=True)
            own.append(n[where])
        out = []
        for side, counts in ((1, t), (0, b)):
            mine = self.side[self.owner] == side
            p, w, h = (np.where(mine, counts[at] - less, counts[at]) for at, less in zip(self.at, own, strict=True))
            total = totals["t" if side else "b"] - np.where(mine, self.n[self.owner], 0)
            out.append(np.bincount(self.owner, weights=bits(p, h, w, total, totals["vocabulary"]), minlength=len(self.n)))
        return out[0], out[1]


def _ask(shift: int):
    """Rows (chunk, doc_id, side, text) in the order of chunks -> what each chunk asks of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_caches("lm_scoring", _NUMBERS.clear)
        last, chunk = None, Chunk()

        def rows() -> pa.RecordBatch:
            chunk.count()
            made = list(chunk.asked(shift))
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in made], pa.int64()), pa.array([last] * len(made), pa.int64()), pa.array([p for _, p in made], pa.binary())], ["range", "chunk", "payload"])

        for batch in batches:
            for c, doc, side, text in zip(*(batch.column(k) for k in range(4)), strict=True):
                if c.as_py() != last and last is not None:
                    yield rows()
                    chunk = Chunk()
                last = c.as_py()
                chunk.add(doc.as_py(), side.as_py(), text.as_py())
        if last is not None:
            yield rows()

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, chunk, payload) in the order of ranges -> the counts in all chunks of what each chunk asked, in its order."""
    own_caches("lm_scoring", _NUMBERS.clear)
    names = [f.split()[0] for f in _ANSWERED.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.binary()]

    def summed(part: int, asked: list[tuple[int, bytes]]) -> pa.RecordBatch:
        whole = [unpacked(p, 3) for _, p in asked]
        uniq, where = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in whole]), return_inverse=True)
        t, b = (np.bincount(where, weights=np.concatenate([x[k] for x in whole]).astype(float), minlength=len(uniq)).astype(np.int64) for k in (1, 2))
        word = (uniq & np.uint64(3)) == WORD
        ends = np.cumsum([x.shape[1] for x in whole])
        rows = []
        for k, ((chunk, _), x, e) in enumerate(zip(asked, whole, ends, strict=True)):
            at = where[e - x.shape[1] : e]
            first = (int(word.sum()), int(t[word].sum()), int(b[word].sum())) if k == 0 else (0, 0, 0)
            rows.append((chunk, part, *first, packed([t[at], b[at]])))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    last, asked = None, []
    for batch in batches:
        for part, chunk, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != last and asked:
                yield summed(last, asked)
                asked = []
            last = part
            asked.append((chunk, payload))
    if asked:
        yield summed(last, asked)


def _score(totals: dict[str, int]):
    """Rows of ``_CHUNK`` in the order of chunks, a chunk's texts before its answers, those by range -> scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_caches("lm_scoring", _NUMBERS.clear)
        last, chunk, answers = None, Chunk(), []

        def scores() -> pa.RecordBatch:
            chunk.count()
            t, b = np.concatenate([*answers, np.zeros((2, 0), np.uint64)], axis=1).astype(np.int64)
            target, background = chunk.scored(t, b, totals)
            n = np.maximum(chunk.n, 1)
            columns = [pa.array(chunk.ids, pa.int64()), pa.array(chunk.n), *(pa.array(x / n) for x in (target, background, background - target))]
            return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCORES.split(", ")])

        for batch in batches:
            for c, kind, _, doc, side, text, payload in zip(*batch.columns, strict=True):
                if c.as_py() != last and last is not None:
                    yield scores()
                    chunk, answers = Chunk(), []
                last = c.as_py()
                if kind.as_py():
                    answers.append(unpacked(payload.as_py(), 2))
                else:
                    chunk.add(doc.as_py(), side.as_py(), text.as_py())
        if last is not None:
            yield scores()

    return run


def _sides(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, text, side: 1 target, 0 background."""
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct().withColumn("_target", F.lit(1))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    side = F.broadcast(ids) if small_enough(ids, BROADCAST_IDS) else ids
    return texts.join(side, "doc_id", "left").select("doc_id", "text", F.coalesce("_target", F.lit(0)).alias("side"))


def _chunk_of(many: int) -> Column:
    """The same for a document in every run; texts without words need none, so that they can't meet in one."""
    wordless = F.coalesce(F.trim("text") == "", F.lit(True))
    return F.when(wordless, F.pmod(F.monotonically_increasing_id(), F.lit(many))).otherwise(F.pmod(F.xxhash64("doc_id", "text"), F.lit(many)))


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, target_loss and background_loss (bits a word), and score.

    The score is the mean over the words of background loss minus target loss: above 0 the text is more like the target
    documents (``target_ids``: doc_id) than like the rest. Null, empty and wordless texts have 0 words and losses and score 0.
    Without target documents or without others the models are empty on that side and losses are those of the uniform
    part. Repeated rows count and are scored each; a null id is never a target; other columns are ignored; an empty table
    gives no rows. Texts cross the network twice, with the chunk that counts and with the chunk that scores them.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    sided = _sides(docs, scratch.keep(target_ids.select("doc_id").distinct(), "target"))
    chars = sided.agg(F.sum(F.length("text"))).first()[0] or 0
    many = max(shuffle_partitions(spark), -(-chars // CHUNK_CHARS))
    shift = KEY_BITS - (chars // 5 // RANGE_KEYS).bit_length()
    dealt = sided.withColumn("chunk", _chunk_of(many))
    texts = dealt.select("chunk", "doc_id", "side", "text").repartition(many, "chunk")
    asked = texts.sortWithinPartitions("chunk").mapInArrow(_ask(shift), _ASKED)
    answers = scratch.keep(asked.repartition("range").sortWithinPartitions("range", "chunk").mapInArrow(_answer, _ANSWERED), "answers")
    sums = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "t", "b"))).first()
    totals = {"vocabulary": max(1, sums["words"]), "t": sums["t"], "b": sums["b"]}
    none = F.lit(None)
    rows = dealt.select("chunk", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("range"), "doc_id", "side", "text", none.cast("binary").alias("payload"))
    rows = rows.unionByName(answers.select("chunk", F.lit(1).alias("kind"), "range", none.cast("long").alias("doc_id"), none.cast("int").alias("side"), none.cast("string").alias("text"), "payload"))
    return rows.repartition(many, "chunk").sortWithinPartitions("chunk", "kind", "range").mapInArrow(_score(totals), SCORES)
