"""Encoding of a corpus with a public byte-level tokenizer.

Method: contiguous rank array. A word's part boundaries and the ranks of its adjacent pairs stand in two arrays; the
minimum is found by a scan, its inner boundary deleted and the two neighbouring ranks refreshed. The scan is quadratic,
so a word of more than SHORT bytes takes the same merges from a heap, with linked parts.

Defined results: null, empty and blank texts are ordinary: null and '' give an empty list, white space gives its own
tokens. Special-token strings in a text are ordinary text. Repeated rows give one row. Whole texts are encoded.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.tables import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of the 50k byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 128
_KEPT_WORDS = 400_000
_KEPT_BYTES = 64
_NONE = 1 << 60


class Encoder:
    """The ids of texts; holds the ranks and a bounded memory of short words."""

    def __init__(self, vocabulary: str = VOCABULARY, pattern: str = PATTERN):
        with open(vocabulary, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def merge_short(self, word: bytes) -> list[int]:
        """Scan, delete, refresh."""
        get = self.ranks.get
        edge = list(range(len(word) + 1))
        rank = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
        while rank:
            low = min(rank)
            if low == _NONE:
                break
            i = rank.index(low)
            del edge[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get(word[edge[i] : edge[i + 2]], _NONE)
            if i:
                rank[i - 1] = get(word[edge[i - 1] : edge[i + 1]], _NONE)
        return [self.ranks[word[a:b]] for a, b in zip(edge, edge[1:])]

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges (lowest rank, then leftmost) in n log n steps."""
        get, n = self.ranks.get, len(word)
        end, before, dead = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := get(word[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, j, end[j]))

        heap: list[tuple[int, int, int, int]] = []
        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if dead[i] or end[i] != j or dead[j] or end[j] != k:
                continue
            dead[j], end[i] = 1, k
            if k < n:
                before[k] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return out

    def word(self, text: str) -> list[int]:
        raw = text.encode("utf-8", "replace")
        if (one := self.ranks.get(raw)) is not None:
            ids = [one]
        else:
            ids = self.merge_short(raw) if len(raw) <= SHORT else self.merge_long(raw)
        if len(raw) <= _KEPT_BYTES:
            if len(self.known) >= _KEPT_WORDS:
                self.known.clear()
            self.known[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        known, out = self.known, []
        for w in self.split(text or ""):
            ids = known.get(w)
            out += self.word(w) if ids is None else ids
        return out

    def count(self, text: str | None) -> int:
        known = self.known
        return sum(len(self.word(w) if (ids := known.get(w)) is None else ids) for w in self.split(text or ""))


@lru_cache(2)
def encoder(vocabulary: str) -> Encoder:
    """One encoder per Python worker, from the copy that was sent to its node, else from the path itself."""
    try:
        sent = SparkFiles.get(os.path.basename(vocabulary))
    except AssertionError:  # no Spark here
        sent = vocabulary
    return Encoder(sent if os.path.exists(sent) else vocabulary)


def _sent(documents: DataFrame, vocabulary: str) -> str:
    """Sends the vocabulary file to all nodes, so that only the driver needs it at its path."""
    documents.sparkSession.sparkContext.addFile(vocabulary)
    return vocabulary


def _once(documents: DataFrame, key: str, text: str) -> DataFrame:
    """One row per key, spread over the cores. A key's rows are copies of one another; should they differ, the greatest text counts."""
    return spread(documents.select(F.col(key).alias("k"), F.col(text).alias("t")), None, "k").groupBy("k").agg(F.max("t").alias("t"))


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids ARRAY<INT>): the token ids of every text, one row per key."""
    kind = documents.schema[key].dataType.simpleString()
    path = _sent(documents, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encode(x.as_py()) for x in part.column(1)], pa.list_(pa.int32()))], names=[key, "ids"])

    return _once(documents, key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, tokens BIGINT): the number of tokens of every text; ids never leave the workers."""
    kind = documents.schema[key].dataType.simpleString()
    path = _sent(documents, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(x.as_py()) for x in batch.column(1)], pa.int64())], names=[key, "tokens"])

    return _once(documents, key, text).mapInArrow(run, f"`{key}` {kind}, tokens bigint")
