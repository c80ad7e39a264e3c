"""Toxicity scores: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a step are a word and its characters: a learned word vector, the mean of learned vectors of the word's
character n-grams (with its start and end marked), and the log-odds of word and n-grams among the labelled training
documents (from the other folds while training, so that they don't repeat a document's own label). A chunk of more than
``WORD_CHARS`` characters is cut at marks inside it, and what is still longer into overlapping runs. A text is cut into
overlapping windows of words, all of which are scored; training sees each document as a bag whose highest window
carries the label. A logistic layer over the highest, the mean of the three highest and the mean of all window scores,
fitted on documents the network has not seen and weighted to the share of toxic labels, gives a probability.

The network is fitted on a bounded sample of labelled documents (``SAMPLE_TOXIC``, ``SAMPLE_CLEAN``,
lowest hashes of the id first), on all their windows; scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlens.llm.common import in_one_task, own_caches, prepare

SAMPLE_TOXIC, SAMPLE_CLEAN = 1600, 2400
WINDOW, STRIDE = 64, 48
#: Entries of the vocabularies, at most; rarer ones (documents) are unknown.
MAX_WORDS, MAX_GRAMS, LEAST_DOCS = 30_000, 30_000, 3
WORD_DIM, GRAM_DIM, HIDDEN, ATTEND = 8, 8, 8, 8
EPOCHS, BATCH, RATE, FOLDS = 6, 48, 0.01, 4
THRESHOLD = 0.3
#: Small samples are gone over more often, for so many steps.
LEAST_STEPS = 150
#: Of either label, that many unseen documents at least fit the last layer.
LEAST_HELD = 20
#: Distinct words a worker keeps projected.
CACHE_ROWS = 150_000
#: Characters of a word, at most; runs of a longer one start so many apart, so that its n-grams are whole in one of them.
WORD_CHARS, RUN_STRIDE = 24, 18

_STRIP = ".,;:!?\"'()[]{}<>|*#$%&@^~`+-=_/\\0123456789¿¡«»“”‘’…–—"


def normal(chunk: str) -> str:
    return chunk.lower().strip(_STRIP)


_GLUE = re.compile(r"[.,;:!?\"'()\[\]{}<>|*#$%&@^~`+\-=_/\\¿¡«»“”‘’…–—。，、！？；：「」『』（）\u00ad\u200b-\u200f\u2060\ufeff]+")


def steps(text: str | None) -> list[str]:
    """The words of a text; those of a long chunk are its parts between marks, in overlapping runs where they are long as well."""
    out: list[str] = []
    for chunk in text.split() if text else []:
        if len(chunk) <= WORD_CHARS:
            out.append(chunk)
            continue
        parts = [p for p in _GLUE.split(chunk) if p]
        for part in parts or [""]:
            n = len(part) - WORD_CHARS
            out += [part] if n <= 0 else [part[s : s + WORD_CHARS] for s in (*range(0, n, RUN_STRIDE), n)]
    return out


def grams(word: str) -> list[str]:
    """Marked character n-grams: starts of 3 to 5 characters, the end, and all inner runs of four."""
    if not word:
        return []
    marked = f"^{word}$"
    return [marked[:4], marked[:5], marked[:6], *[marked[i : i + 4] for i in range(1, len(marked) - 3)]]


def windows(n: int) -> list[tuple[int, int]]:
    """(start, end) of the overlapping windows over ``n`` words; one, empty, if there are none."""
    if n <= WINDOW:
        return [(0, n)]
    starts = [*range(0, n - WINDOW, STRIDE), n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Model:
    """Vocabularies, parameters and the final logistic layer; ``prior`` alone if there was nothing to learn from."""

    words: dict[str, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    word_odds: np.ndarray | None = None
    gram_odds: np.ndarray | None = None
    params: dict[str, np.ndarray] = field(default_factory=dict)
    last: np.ndarray | None = None
    prior: float = 0.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


# ---------------------------------------------------------------- the network


def run_gru(X: np.ndarray, U: np.ndarray, bias: np.ndarray, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
    """States of a gated recurrent layer over X (steps, windows, 3 x hidden); masked steps leave the state."""
    steps, many, wide = X.shape
    h = wide // 3
    state = np.zeros((many, h), X.dtype)
    out = np.empty((steps, many, h), X.dtype)
    for t in range(steps):
        g = state @ U
        gates = _sigmoid(X[t, :, : 2 * h] + g[:, : 2 * h])
        r, z = gates[:, :h], gates[:, h:]
        q = g[:, 2 * h :] + bias
        new = np.tanh(X[t, :, 2 * h :] + r * q)
        nxt = new + z * (state - new)
        if mask is not None:
            nxt = np.where(mask[t][:, None], nxt, state)
        if keep is not None:
            keep.append((state, r, z, q, new))
        out[t] = state = nxt
    return out


def back_gru(dH: np.ndarray, U: np.ndarray, mask: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of X, U and bias from those of the states."""
    steps, many, h = dH.shape
    dX, dU, dbias = np.zeros((steps, many, 3 * h), dH.dtype), np.zeros_like(U), np.zeros(h, dH.dtype)
    carry = np.zeros((many, h), dH.dtype)
    for t in range(steps - 1, -1, -1):
        state, r, z, q, new = kept[t]
        total = carry + dH[t]
        m = mask[t][:, None]
        d = np.where(m, total, 0)
        dn = d * (1 - z) * (1 - new * new)
        dz = d * (state - new) * z * (1 - z)
        dr = dn * q * r * (1 - r)
        dq = dn * r
        dg = np.concatenate([dr, dz, dq], axis=1)
        dX[t] = np.concatenate([dr, dz, dn], axis=1)
        dU += state.T @ dg
        dbias += dq.sum(axis=0)
        carry = np.where(m, d * z + dg @ U.T, total)
    return dX, dU, dbias


def forward(P: dict[str, np.ndarray], XF: np.ndarray, XB: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
    """Window logits from the projected inputs of both directions (steps, windows, 3 x hidden)."""
    flipped = None if mask is None else mask[::-1]
    keep_f, keep_b = ([], []) if keep is not None else (None, None)
    HF = run_gru(XF, P["Uf"], P["cf"], mask, keep_f)
    HB = run_gru(XB[::-1], P["Ub"], P["cb"], flipped, keep_b)[::-1]
    H = np.concatenate([HF, HB], axis=2)
    act = np.tanh(H @ P["Wa"] + P["ba"])
    score = act @ P["va"]
    if mask is not None:
        score = np.where(mask, score, -1e9)
    weight = np.exp(score - score.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = (weight[:, :, None] * H).sum(axis=0)
    if keep is not None:
        keep.update(H=H, act=act, weight=weight, pooled=pooled, f=keep_f, b=keep_b)
    return pooled @ P["wo"] + P["bo"][0]


def backward(P: dict[str, np.ndarray], dlogit: np.ndarray, mask: np.ndarray, kept: dict) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Gradients of the parameters and of the projected inputs of both directions."""
    H, act, weight, pooled = kept["H"], kept["act"], kept["weight"], kept["pooled"]
    out = {"wo": pooled.T @ dlogit, "bo": np.array([dlogit.sum()], H.dtype)}
    dpooled = dlogit[:, None] * P["wo"]
    dH = weight[:, :, None] * dpooled
    dweight = (H * dpooled).sum(axis=2)
    dscore = weight * (dweight - (weight * dweight).sum(axis=0))
    out["va"] = np.einsum("tn,tnk->k", dscore, act)
    dact = dscore[:, :, None] * P["va"] * (1 - act * act)
    out["Wa"] = np.einsum("tnh,tnk->hk", H, dact)
    out["ba"] = dact.sum(axis=(0, 1))
    dH += dact @ P["Wa"].T
    h = P["Uf"].shape[0]
    dXF, out["Uf"], out["cf"] = back_gru(dH[:, :, :h], P["Uf"], mask, kept["f"])
    dXB, out["Ub"], out["cb"] = back_gru(dH[::-1, :, h:], P["Ub"], mask[::-1], kept["b"])
    return out, dXF, dXB[::-1]


def gru_start(rng: np.random.Generator, inputs: int) -> dict[str, np.ndarray]:
    u = lambda *s, k=0.3: rng.uniform(-k, k, s).astype(np.float32)
    z = lambda *s: np.zeros(s, np.float32)
    h = HIDDEN
    return {"Wx": u(inputs, 6 * h), "bx": z(6 * h), "Uf": u(h, 3 * h), "Ub": u(h, 3 * h), "cf": z(h), "cb": z(h), "Wa": u(2 * h, ATTEND), "ba": z(ATTEND), "va": u(ATTEND), "wo": u(2 * h), "bo": z(1)}


# ---------------------------------------------------------------- inputs


def _select(c0: np.ndarray, c1: np.ndarray, n0: int, n1: int, size: int) -> np.ndarray:
    """Indexes of the entries whose document counts are farthest from independence of the label."""
    known = np.flatnonzero(c0 + c1 >= LEAST_DOCS)
    return known[np.argsort(-np.abs(c1[known] / max(1, n1) - c0[known] / max(1, n0)), kind="stable")][:size]


def _take(flat: np.ndarray, start: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of ``which`` out of lists held one after another: their entries and sizes."""
    sizes = start[which + 1] - start[which]
    at = np.repeat(start[which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return flat[at], sizes


def _odds(c0: np.ndarray, c1: np.ndarray, n0: int, n1: int) -> np.ndarray:
    out = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
    out = np.where(c0 + c1 >= LEAST_DOCS, out, 0)
    out[0] = 0
    return (np.clip(out, -3, 4) / 2).astype(np.float32)


def _csr(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))
    return flat, sizes


def features(P: dict[str, np.ndarray], wid: np.ndarray, flat: np.ndarray, sizes: np.ndarray, word_odds: np.ndarray, gram_odds: np.ndarray) -> np.ndarray:
    """A row for each word: its vector, its n-grams' mean vector, and the log-odds of both."""
    rows = np.repeat(np.arange(len(sizes)), sizes)
    share = 1 / np.maximum(sizes, 1)
    vector = np.zeros((len(sizes), GRAM_DIM), np.float32)
    top, mean = np.zeros(len(sizes), np.float32), np.zeros(len(sizes), np.float32)
    if len(flat):
        for k in range(GRAM_DIM):
            vector[:, k] = np.bincount(rows, weights=P["Ec"][flat, k], minlength=len(sizes)) * share
        mean[:] = np.bincount(rows, weights=gram_odds[flat], minlength=len(sizes)) * share
        np.maximum.at(top, rows, gram_odds[flat])
    return np.concatenate([P["Ew"][wid], vector, word_odds[wid, None], top[:, None], mean[:, None]], axis=1)


# ---------------------------------------------------------------- training


def train(names: list[str], bags: list[list[np.ndarray]], labels: list[int], share: float, seed: int = 7) -> Model:
    """A model from documents as lists of windows of indexes into ``names``; ``share`` is that of toxic labels overall."""
    y = np.array(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        return Model(prior=float(share))
    rng = np.random.default_rng(seed)
    # n-grams by their hashes, as there are many more than are kept in the end
    hashed, sizes = array("Q"), np.zeros(len(names), np.int64)
    for k, w in enumerate(names):
        own = grams(w)
        sizes[k] = len(own)
        hashed.extend(map(xxhash.xxh3_64_intdigest, own))
    gram_hashes = np.unique(np.frombuffer(hashed, np.uint64) if hashed else np.empty(0, np.uint64))
    all_flat = np.searchsorted(gram_hashes, np.frombuffer(hashed, np.uint64)).astype(np.int32) if hashed else np.empty(0, np.int32)
    del hashed
    all_start = np.concatenate([[0], np.cumsum(sizes)])
    many_grams = len(gram_hashes)
    doc_words = [np.unique(np.concatenate(bag)) for bag in bags]
    doc_grams = lambda i: np.unique(_take(all_flat, all_start, doc_words[i])[0])
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    # document counts by fold and label, so that a fold's own can be left out
    fold = rng.permutation(len(y)) % FOLDS
    cw, cg = np.zeros((FOLDS, 2, len(names)), np.int32), np.zeros((FOLDS, 2, many_grams), np.int32)
    docs_in = np.zeros((FOLDS, 2), np.int64)
    for i in range(len(y)):
        cw[fold[i], y[i], doc_words[i]] += 1
        cg[fold[i], y[i], doc_grams(i)] += 1
        docs_in[fold[i], y[i]] += 1
    tw, tg = cw.sum(axis=0), cg.sum(axis=0)
    word_pick, gram_pick = _select(tw[0], tw[1], n0, n1, MAX_WORDS), _select(tg[0], tg[1], n0, n1, MAX_GRAMS)
    words, place = {names[j]: k + 1 for k, j in enumerate(word_pick)}, {int(gram_hashes[j]): k + 1 for k, j in enumerate(gram_pick)}
    gram_ids = {g: k for w in names for g in grams(w) if (k := place.get(xxhash.xxh3_64_intdigest(g)))}
    del gram_hashes, place
    pad = lambda x, pick: np.concatenate([np.zeros((*x.shape[:-1], 1), x.dtype), x[..., pick]], axis=-1).astype(float)
    cw, cg, tw, tg = pad(cw, word_pick), pad(cg, gram_pick), pad(tw, word_pick), pad(tg, gram_pick)
    model = Model(words, gram_ids, _odds(tw[0], tw[1], n0, n1), _odds(tg[0], tg[1], n0, n1))
    odds = []
    for k in range(FOLDS):
        m0, m1 = n0 - docs_in[k, 0], n1 - docs_in[k, 1]
        odds.append((_odds(tw[0] - cw[k, 0], tw[1] - cw[k, 1], m0, m1), _odds(tg[0] - cg[k, 0], tg[1] - cg[k, 1], m0, m1)))
    word_id, gram_id = np.zeros(len(names), np.int64), np.zeros(max(1, many_grams), np.int64)
    word_id[word_pick], gram_id[gram_pick] = np.arange(1, len(word_pick) + 1), np.arange(1, len(gram_pick) + 1)
    known = gram_id[all_flat] > 0
    flat_known = gram_id[all_flat][known]
    start_known = np.concatenate([[0], np.cumsum(known)])[all_start]
    del all_flat, all_start, known

    P = gru_start(rng, WORD_DIM + GRAM_DIM + 3)
    P["Ew"] = rng.normal(0, 0.1, (len(words) + 1, WORD_DIM)).astype(np.float32)
    P["Ec"] = rng.normal(0, 0.1, (len(gram_pick) + 1, GRAM_DIM)).astype(np.float32)
    P["Ew"][0] = 0
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in P.items()}
    held = rng.random(len(y)) < 0.2  # for the last layer
    order_all = np.flatnonzero(~held)
    weight = np.where(y == 1, 0.5 / max(1, n1), 0.5 / max(1, n0)) * len(y) ** 1.0
    step = 0

    def inputs(of: list[tuple[int, int]]):
        """Features of the distinct words (by fold) of some windows, and the windows as indexes into them."""
        own = [bags[i][k] for i, k in of]
        lens = np.fromiter(map(len, own), np.int64, len(own))
        keys, where = np.unique(np.concatenate(own).astype(np.int64) * FOLDS + np.repeat(fold[[i for i, _ in of]], lens), return_inverse=True)
        name, of_fold = keys // FOLDS, keys % FOLDS
        wid = word_id[name]
        flat, sizes = _take(flat_known, start_known, name)
        feats = np.zeros((len(keys), WORD_DIM + GRAM_DIM + 3), np.float32)
        gram_fold = np.repeat(of_fold, sizes)
        for f in range(FOLDS):
            pick = of_fold == f
            if pick.any():
                feats[pick] = features(P, wid[pick], flat[gram_fold == f], sizes[pick], *odds[f])
        mask = np.arange(max(1, int(lens.max(initial=0))))[:, None] < lens
        at = np.zeros((len(own), len(mask)), np.int64)
        at[mask.T] = where
        return wid, flat, sizes, feats, np.ascontiguousarray(at.T), mask

    def score(of: list[tuple[int, int]]) -> np.ndarray:
        out = []
        for a in range(0, len(of), 512):
            wid, flat, sizes, feats, at, mask = inputs(of[a : a + 512])
            X = (feats @ P["Wx"] + P["bx"])[at]
            out.append(forward(P, X[:, :, : 3 * HIDDEN], X[:, :, 3 * HIDDEN :], mask))
        return np.concatenate(out) if out else np.empty(0, np.float32)

    epochs = max(EPOCHS, -(-LEAST_STEPS // max(1, -(-len(order_all) // BATCH))))
    for epoch in range(epochs):
        order = rng.permutation(order_all)
        rate = RATE * (1 - epoch / (epochs + 1))
        for a in range(0, len(order), BATCH):
            chosen = order[a : a + BATCH]
            every = [(i, k) for i in chosen for k in range(len(bags[i]))]
            logits = score(every)
            best: dict[int, tuple[float, int]] = {}
            for (i, k), s in zip(every, logits, strict=True):
                if i not in best or s > best[i][0]:
                    best[i] = (s, k)
            of = [(i, best[i][1]) for i in chosen]
            wid, flat, sizes, feats, at, mask = inputs(of)
            X = (feats @ P["Wx"] + P["bx"])[at]
            kept: dict = {}
            logit = forward(P, X[:, :, : 3 * HIDDEN], X[:, :, 3 * HIDDEN :], mask, kept)
            d = ((_sigmoid(logit) - y[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            G, dXF, dXB = backward(P, d, mask, kept)
            dX = np.concatenate([dXF, dXB], axis=2)[mask]
            each = np.zeros((len(sizes), 6 * HIDDEN), np.float32)
            np.add.at(each, at[mask], dX)
            G["Wx"], G["bx"] = feats.T @ each, each.sum(axis=0)
            df = each @ P["Wx"].T
            G["Ew"], G["Ec"] = np.zeros_like(P["Ew"]), np.zeros_like(P["Ec"])
            np.add.at(G["Ew"], wid, df[:, :WORD_DIM])
            G["Ew"][0] = 0
            rows = np.repeat(np.arange(len(sizes)), sizes)
            np.add.at(G["Ec"], flat, df[rows, WORD_DIM : WORD_DIM + GRAM_DIM] / sizes[rows, None])
            norm = np.sqrt(sum(float((g * g).sum()) for g in G.values()))
            step += 1
            for k, g in G.items():
                g = g * min(1.0, 2.0 / (norm + 1e-9)) + 1e-4 * P[k]
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                P[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    model.params = {k: v.astype(np.float32) for k, v in P.items()}
    # the last layer, on documents the network has not seen (all where those are few), weighted to the share overall
    fit = np.flatnonzero(held) if min((y[held] == 0).sum(), (y[held] == 1).sum()) >= LEAST_HELD else np.arange(len(y))
    every = [(i, k) for i in fit for k in range(len(bags[i]))]
    logits, owner = score(every), np.array([i for i, _ in every])
    Z = np.array([summary(logits[owner == i]) for i in fit])
    t = y[fit]
    w = np.where(t == 1, share / max(1, (t == 1).sum()), (1 - share) / max(1, (t == 0).sum()))
    model.last = _logistic(Z, t, w / w.sum() * len(t))
    model.prior = float(share)
    return model


def summary(logits: np.ndarray) -> np.ndarray:
    """Of a document's window scores: the highest, the mean of the three highest, and the mean."""
    top = np.sort(logits)[::-1]
    return np.array([top[0], top[:3].mean(), top.mean()], float)


def _logistic(Z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights and bias; a ridge pulls the weights towards equal shares, so that few documents can't turn them.

    Newton's steps are halved until the loss falls, as on labels that can be told apart whole ones run away.
    """
    A = np.concatenate([Z, np.ones((len(Z), 1))], axis=1)
    centre, ridge = np.array([1 / 3, 1 / 3, 1 / 3, 0]), np.diag([5.0, 5.0, 5.0, 1e-3])

    def loss(beta: np.ndarray) -> float:
        s = A @ beta
        return float((w * (np.logaddexp(0, s) - y * s)).sum() + (beta - centre) @ ridge @ (beta - centre) / 2)

    beta = centre.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(A @ beta, -30, 30)))
        slope = A.T @ (w * (p - y)) + ridge @ (beta - centre)
        step = np.linalg.solve((A * (w * p * (1 - p))[:, None]).T @ A + ridge, slope)
        now, size = loss(beta), 1.0
        while size > 1e-9 and loss(beta - size * step) > now - 1e-4 * size * float(slope @ step):
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return beta


# ---------------------------------------------------------------- scoring


class Scorer(dict):
    """Scores whole texts; as a dict it gives each chunk the row of its projected input."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.rows = np.zeros((1, 6 * HIDDEN), np.float16)
        self.fresh: list[str] = []
        self.known = 0

    def __missing__(self, chunk: str) -> int:
        at = self.known + len(self.fresh)
        self.fresh.append(chunk)
        if len(chunk) <= 64:
            self[chunk] = at
        return at

    def project(self) -> None:
        """Rows for the chunks met since."""
        m, P = self.model, self.model.params
        fresh = [normal(c) for c in self.fresh]
        get = m.grams.get
        flat, sizes = _csr([[*filter(None, map(get, grams(w)))] for w in fresh])
        wid = np.fromiter((m.words.get(w, 0) for w in fresh), np.int64, len(fresh))
        made = features(P, wid, flat, sizes, m.word_odds, m.gram_odds) @ P["Wx"] + P["bx"]
        need = self.known + len(fresh)
        if need > len(self.rows):
            grown = np.zeros((max(need, len(self.rows) * 3 // 2), 6 * HIDDEN), np.float16)
            grown[: self.known] = self.rows[: self.known]
            self.rows = grown
        self.rows[self.known : need] = made
        self.known, self.fresh = need, []

    def logits(self, at: list[np.ndarray]) -> np.ndarray:
        """Window logits; full windows go without a mask."""
        P, out = self.model.params, np.empty(len(at), np.float32)
        sizes = np.fromiter(map(len, at), np.int64, len(at))
        order = np.argsort(sizes, kind="stable")
        for a in range(0, len(order), 1024):
            own = order[a : a + 1024]
            steps = max(1, int(sizes[own[-1]]))
            idx, mask = np.zeros((steps, len(own)), np.int64), None
            if sizes[own[0]] < steps:
                mask = np.arange(steps)[:, None] < np.maximum(sizes[own], 1)
            for n, i in enumerate(own):
                idx[: sizes[i], n] = at[i]
            X = self.rows[idx].astype(np.float32)
            out[own] = forward(P, X[:, :, : 3 * HIDDEN], X[:, :, 3 * HIDDEN :], mask)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.model.last is None:
            return np.full(len(texts), self.model.prior)
        if self.known > CACHE_ROWS:
            self.reset()
        chunks = [steps(t) for t in texts]
        ids = [np.fromiter(map(self.__getitem__, c or [""]), np.int64) for c in chunks]
        self.project()
        cuts = [windows(len(x)) for x in ids]
        logit = self.logits([x[s:e] for x, own in zip(ids, cuts, strict=True) for s, e in own])
        ends = np.cumsum([0, *map(len, cuts)])
        Z = np.array([summary(logit[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(Z @ self.model.last[:3] + self.model.last[3], -30, 30)))


_SCORERS: dict[str, Scorer] = {}


def scorer(model: Model) -> Scorer:
    if model.key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.key] = Scorer(model)
    return _SCORERS[model.key]


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Whether a document's labels are kept from training: crc32 of its id as text, modulo 4, is 2."""
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own_caches("toxicity", _SCORERS.clear)
    for batch in batches:
        bags = []
        for text in batch.column(1).to_pylist():
            words = [normal(c) for c in steps(text)]
            bags.append([" ".join(w or "_" for w in words[s:e]) for s, e in windows(len(words))])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.list_(pa.string())), batch.column(2)], ["doc_id", "bag", "toxic"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains on a bounded sample of the labelled documents outside the held-out fold.

    A document with several labels counts as toxic if one says so; null labels don't count. Without two kinds of
    labels the model scores all texts with the share of toxic ones (0 without labels).
    """
    prepare(docs.sparkSession)
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    totals = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    share = totals["toxic"] / totals["n"] if totals["n"] else 0.0
    first = lambda k, n: known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = first(1, SAMPLE_TOXIC).unionByName(first(0, SAMPLE_CLEAN))  # so few rows that they can be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").mapInArrow(_cut_windows, "doc_id long, bag array<string>, toxic long")

    def learn(table: pa.Table) -> Model:
        own_caches("toxicity", _SCORERS.clear)
        table = table.sort_by([("doc_id", "ascending")])
        ids: dict[str, int] = {}
        bags = [[np.array([ids.setdefault(w, len(ids)) for w in win.as_py().split(" ")], np.int32) for win in bag] for bag in table["bag"]]
        return train(list(ids), bags, table["toxic"].to_pylist(), share)

    return in_one_task(rows, learn)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted. Null and empty texts are scored as texts without words.

    Repeated rows give a row each, a null id is kept (and not held out), other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabularies' sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_caches("toxicity", _SCORERS.clear)
        own = scorer(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                s = own.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Fits on the labelled documents among ``docs`` and scores all of them."""
    return score(docs, fit(docs, labels), threshold)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_docs: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``threshold``.

    Null and empty texts are scored as texts without words; null ids and repeated rows stay or go by their text. With one kind
    of label, or none, nothing is known to be toxic: all rows stay unless the share of toxic labels reaches the threshold.
    """
    model = fit(docs if train_docs is None else train_docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_caches("toxicity", _SCORERS.clear)
        own = scorer(sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield part.filter(pa.array(own.scores(part.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
