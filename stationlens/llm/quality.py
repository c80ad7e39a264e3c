"""Quality classifier from weak labels: heuristic labellers, expectation-maximisation, and a hashed linear scorer.

Each labeller votes good, bad or not at all on a text's form. How often each vote occurs among good and bad texts is
estimated by expectation-maximisation over the counts of vote patterns of all documents (at most 3 to the number of
labellers, whatever the corpus); the posterior of a pattern is the label that a linear scorer over hashed words, their
shapes and the text's measures is trained on. The scorer learns from a bounded sample of distinct texts (2 x ``SAMPLE_DOCS``,
lowest hashes first, weighted by 1 + the logarithm of their copies, so that no text drowns the rest); statistics of the votes cover all documents, and whole texts are scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlens.llm.common import in_one_task, own_caches, prepare

SAMPLE_DOCS = 4000
FEATURES = 1 << 16
EPOCHS, RATE, DECAY = 12, 0.3, 1e-5
EM_ROUNDS = 100
THRESHOLD = 0.5
CACHE_ENTRIES = 400_000

#: Labellers that know bad texts: (measure, bad if over), then (measure, bad if under); otherwise they don't vote.
OVER = [("symbols", 0.04), ("capitals", 0.3), ("bars", 0.1), ("repeated_lines", 0.3), ("sentence_ends", 0.5), ("digits", 0.25)]
UNDER = [("distinct", 0.45), ("plain_words", 0.6)]
#: Labellers that know good texts: (measure, good from, good to).
WITHIN = [("sentence_ends", 0.03, 0.2), ("distinct", 0.6, 1.0), ("plain_words", 0.75, 1.0)]
MEASURES = [m for m, _ in OVER + UNDER]
LABELLERS = len(OVER) + len(UNDER) + len(WITHIN)

_UPPER, _SYMBOLS = bytes(range(65, 91)), b"#$%&*@^~`+=_/\\<>{}[]!"
_END = re.compile(r"[.!?](?=\s|$)")
_PLAIN = re.compile(r"(?<!\S)[^\W\d_]+[.,;:!?]*(?!\S)")
_DIGITS = [b"%d" % k for k in range(10)]


def measures(text: str | None) -> list[float]:
    """The measures the labellers vote on, of a whole text."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(MEASURES)
    raw = text.encode()
    solid = max(1, len(raw) - raw.count(b" ") - raw.count(b"\n"))
    lines = [x for x in text.split("\n") if x.strip()]
    n = len(words)
    return [
        (len(raw) - len(raw.translate(None, _SYMBOLS))) / solid,
        (len(raw) - len(raw.translate(None, _UPPER))) / solid,
        raw.count(b"|") / n,
        1 - len(set(lines)) / len(lines),
        len(_END.findall(text)) / n,
        sum(map(raw.count, _DIGITS)) / solid,
        # over windows of so many words, as a long text repeats more of them
        float(np.mean([len(set(words[k : k + 400])) / len(words[k : k + 400]) for k in range(0, n, 400)])),
        len(_PLAIN.findall(text)) / n,
    ]


def votes(m: list[float]) -> list[int]:
    """1 good, -1 bad, 0 none, a vote a labeller."""
    of = dict(zip(MEASURES, m, strict=True))
    out = [-(of[x] > bad) for x, bad in OVER] + [-(of[x] < bad) for x, bad in UNDER]
    return out + [int(low <= of[x] <= high) for x, low, high in WITHIN]


def pattern(v: list[int]) -> int:
    out = 0
    for x in v:
        out = 3 * out + x + 1
    return out


def unpattern(codes: np.ndarray, many: int) -> np.ndarray:
    return np.stack([(codes // 3 ** (many - 1 - k)) % 3 for k in range(many)], axis=1)


def estimate(codes: np.ndarray, counts: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: (posterior of good by pattern, vote probabilities by labeller, class and vote).

    Starts from the votes for bad, else those for good; probabilities are smoothed, so that no pattern is impossible.
    """
    v = unpattern(codes, many)
    lean = 1 + (v == 2).sum(axis=1) - 4 * (v == 0).sum(axis=1)
    good = 1 / (1 + np.exp(-lean))
    for _ in range(EM_ROUNDS):
        by_class = np.stack([counts * (1 - good), counts * good])
        prior = (by_class.sum(axis=1) + 1) / (counts.sum() + 2)
        table = np.stack([[[by_class[c][v[:, k] == x].sum() + 1 for x in range(3)] for c in range(2)] for k in range(many)])
        table = table / table.sum(axis=2, keepdims=True)
        log = np.log(prior)[None, :] + sum(np.log(table[k][:, v[:, k]]).T for k in range(many))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(new - good).max(initial=0) < 1e-6:
            good = new
            break
        good = new
    return good, table


def _hash(kind: str, x: str) -> int:
    return xxhash.xxh3_64_intdigest(kind + x) % FEATURES


def _shape(chunk: str) -> str:
    out = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a", chunk)
    return re.sub(r"(.)\1+", r"\1", re.sub(r"\d", "9", out))[:12]


class Hashed(dict):
    """Chunk -> hashed numbers of its word and its shape."""

    def __missing__(self, chunk: str) -> tuple[int, int]:
        pair = (_hash("w", chunk.lower()), _hash("s", _shape(chunk)))
        if len(chunk) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = pair
        return pair


_HASHED = Hashed()


def features(text: str | None, m: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, value): shares of hashed words and shapes, and the measures with their votes at hashed places."""
    words = text.split() if text else []
    ids = np.array([x for w in words for x in _HASHED[w]], np.int64)
    own = [_hash("m", f"{k}/{vote}") for k, vote in enumerate(votes(m))]
    if not len(ids):
        return np.array(own, np.int64), np.ones(len(own))
    at, n = np.unique(ids, return_counts=True)
    return np.concatenate([at, own]), np.concatenate([4 * n / len(words), np.ones(len(own))])


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, weight: np.ndarray, seed: int = 3) -> tuple[np.ndarray, float]:
    """Logistic weights and bias by adaptive gradient steps on soft labels of weighted rows."""
    w, b, past = np.zeros(FEATURES), 0.0, np.full(FEATURES, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            g = weight[i] * (1 / (1 + np.exp(-np.clip(w[at] @ x + b, -30, 30))) - good[i])
            step = g * x + DECAY * w[at]
            past[at] += step * step
            w[at] -= RATE * step / np.sqrt(past[at])
            b -= 0.02 * g
    return w, b


class Model:
    def __init__(self, w: np.ndarray, b: float, accuracy: np.ndarray, posterior: dict[int, float]) -> None:
        self.w, self.b, self.accuracy, self.posterior = w.astype(np.float32), b, accuracy, posterior


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own_caches("quality", _HASHED.clear)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([pattern(votes(measures(t.as_py()))) for t in batch.column(0)], pa.int32())], ["pattern"])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own_caches("quality", _HASHED.clear)
    for batch in batches:
        out = []
        for t in batch.column(0).to_pylist():
            m = measures(t)
            at, x = features(t, m)
            out.append((pattern(votes(m)), at.tolist(), x.tolist()))
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.list_(pa.int64())), pa.array(columns[2], pa.list_(pa.float64())), batch.column(1)], ["pattern", "at", "x", "n"])


def sampled(texts: DataFrame) -> DataFrame:
    """(text, n): the distinct texts of the lowest hashes, with their copies; ``2 * SAMPLE_DOCS`` at most."""
    known = texts.filter("text IS NOT NULL")
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    # a first cut at four times the share that is needed, as the number of distinct texts is an estimate
    many = known.agg(F.approx_count_distinct(F.xxhash64("text"))).first()[0]
    cut = int(min(1.0, 8 * SAMPLE_DOCS / max(1, many)) * (1 << 40))
    return known.filter(place <= cut).groupBy("text").agg(F.count("*").alias("n")).orderBy(place, "text").limit(2 * SAMPLE_DOCS)


def fit(docs: DataFrame) -> Model | None:
    """The model, or None for an empty table."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(_patterns, "pattern int").groupBy("pattern").agg(F.count("*").alias("n")).toArrow().sort_by("pattern")
    if not len(rows):
        return None
    codes, counts = rows["pattern"].to_numpy().astype(np.int64), rows["n"].to_numpy().astype(float)
    good, table = estimate(codes, counts, LABELLERS)
    posterior = dict(zip(codes.tolist(), good.tolist(), strict=True))
    sample = sampled(texts).mapInArrow(_sample, "pattern int, at array<long>, x array<double>, n long")

    def learn(rows: pa.Table) -> Model:
        parts = [(np.array(a, np.int64), np.array(x)) for a, x in zip(rows["at"].to_pylist(), rows["x"].to_pylist(), strict=True)]
        order = sorted(range(len(parts)), key=lambda i: (rows["pattern"][i].as_py(), parts[i][0].tobytes(), parts[i][1].tobytes()))
        soft, weight = np.array([posterior.get(k, 0.5) for k in rows["pattern"].to_pylist()]), 1 + np.log(rows["n"].to_numpy())
        w, b = fit_scorer([parts[i] for i in order], soft[order], weight[order])
        return Model(w, b, table, posterior)

    return in_one_task(sample, learn)


def quality(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, weak_label (posterior of its votes), score (0 to 1, higher: better), keep (0/1).

    Null and empty texts have the votes and score of a text without words. Repeated rows give a row each (the same
    scores), null ids are kept, other columns are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_caches("quality", _HASHED.clear)
        model = sent.value
        for batch in batches:
            weak, score = [], []
            for t in batch.column(1):
                text = t.as_py()
                m = measures(text)
                at, x = features(text, m)
                weak.append(model.posterior.get(pattern(votes(m)), 0.5))
                score.append(float(1 / (1 + np.exp(-np.clip(model.w[at] @ x + model.b, -30, 30)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weak, pa.float64()), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())], ["doc_id", "weak_label", "score", "keep"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, weak_label double, score double, keep int")
