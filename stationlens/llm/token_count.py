"""Token counts by heap-and-linked-list byte-pair merging.

The segmentation (normaliser and pre-tokeniser) is the library's; the merging is ours: adjacent pairs wait in a
heap by (merge rank, position), the lowest is popped, its two symbols become one in a doubly linked list, and the
count is the initial symbols minus the merges. No token identifiers are produced.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlens.llm.common import own_caches, prepare

#: Distinct chunks whose counts a worker keeps; beyond it the table starts anew, so memory stays bounded.
CACHE_ENTRIES = 600_000
#: Longer chunks are counted without being kept.
CACHE_CHUNK_CHARS = 64
#: Separators for str.split() that the tokenizer's \s does not know.
_FILE_SEPARATORS = re.compile("[\x1c-\x1f]")
#: The pre-tokeniser's pattern over lower-case printable ASCII, where normalising is lower-casing and bytes are themselves.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class MergeTable:
    """Merge ranks over interned symbols: ``pairs[(left, right)] = (rank, merged)``."""

    def __init__(self, model: dict) -> None:
        self.suffix = model.get("end_of_word_suffix") or ""
        self.symbols: dict[str, int] = model["vocab"]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[self.symbols[left], self.symbols[right]] = (rank, self.symbols[left + right])

    def count(self, word: str) -> int:
        """Tokens of one pre-token: initial symbols minus merges."""
        get = self.symbols.get
        chars = [*word[:-1], word[-1] + self.suffix] if word else []
        at = [s for s in map(get, chars) if s is not None]
        n = len(at)
        if n < 2:
            return n
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        pairs = self.pairs
        heap = [(m[0], i, at[i], at[i + 1], m[1]) for i in range(n - 1) if (m := pairs.get((at[i], at[i + 1])))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if at[i] != left or j < 0 or at[j] != right:
                continue  # one of the two was merged meanwhile
            at[i], at[j] = made, -1
            after[i] = k = after[j]
            merges += 1
            if k >= 0:
                before[k] = i
                if m := pairs.get((made, at[k])):
                    heapq.heappush(heap, (m[0], i, made, at[k], m[1]))
            if (h := before[i]) >= 0 and (m := pairs.get((at[h], made))):
                heapq.heappush(heap, (m[0], h, at[h], made, m[1]))
        return n - merges


class TokenCounter(dict):
    """Counts whole texts; as a dict it keeps the counts of white-space-free chunks.

    The tokenizer drops white space and no pre-token spans it, so a text's count is the sum over its chunks.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merging = MergeTable(spec["model"])
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex", "")
        self.ascii_pattern = "Lowercase" in kinds and split == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.hint = specials[0][:2] if specials and len({s[:2] for s in specials}) == 1 else ""

    def segment(self, text: str) -> int:
        if self.ascii_pattern and text.isascii() and text.isprintable():
            return sum(map(self.merging.count, _ASCII.findall(text.lower())))
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        words = [w for w, _ in self.pre_tokenizer.pre_tokenize_str(text)]
        return sum(map(self.merging.count, words))

    def __missing__(self, chunk: str) -> int:
        n = self.segment(chunk)
        if len(chunk) <= CACHE_CHUNK_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = n
        return n

    def plain(self, text: str) -> int:
        if _FILE_SEPARATORS.search(text):
            return self.segment(text)
        return sum(map(self.__getitem__, text.split()))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.specials is None or (self.hint and self.hint not in text):
            return self.plain(text)
        parts = self.specials.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, UTF-8 bytes, tokens, and whether it has more than ``limit`` tokens.

    A null text counts as empty (0 bytes, 0 tokens); repeated rows and null ids give a row each; other columns
    are ignored. One narrow pass: no shuffle, and memory bounded by a record batch and the chunk cache.
    """

    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_caches("token_count", _COUNTERS.clear)
        count = counter(tokenizer).count
        for batch in batches:
            n = [count(t.as_py()) for t in batch.column(1)]
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
