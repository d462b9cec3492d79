"""Encoding of a corpus with a public byte-level BPE vocabulary.

The vocabulary's rank file (a token in base64 and its rank on each line) is read once on the driver and broadcast;
its size is checked against MAX_VOCABULARY_BYTES. Each task splits texts with the vocabulary's own pattern and merges
every distinct word once: a contiguous array holds the ranks of adjacent parts, its minimum is looked up again and
again, the boundary there deleted and the two neighbouring ranks refreshed. Words beyond LONG_WORD bytes take the same
merges from a heap over linked parts, so that a text without blanks doesn't cost the square of its length.

Nulls and empty texts give an empty list; blanks are encoded as they stand; strings that look like special tokens are
ordinary text. Rows are neither dropped nor merged, so repeated rows come out as often as they came in.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Pattern that splits text before merging; fixed by the vocabulary.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 16 * 2**20
LONG_WORD = 96
MEMO_WORDS = 200_000
NO_MERGE = 1 << 60


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by repeated scans of the rank array."""
    get = ranks.get
    bounds = list(range(len(word) + 1))
    adjacent = [get(word[i : i + 2], NO_MERGE) for i in range(len(word) - 1)]
    while adjacent:
        least = min(adjacent)
        if least == NO_MERGE:
            break
        i = adjacent.index(least)
        del bounds[i + 1], adjacent[i]
        if i < len(adjacent):
            adjacent[i] = get(word[bounds[i] : bounds[i + 2]], NO_MERGE)
        if i:
            adjacent[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], NO_MERGE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges, lowest rank first and leftmost among equals, from a heap over linked parts."""
    n, get = len(word), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2], NO_MERGE)) != NO_MERGE]
    heapq.heapify(heap)
    while heap:
        rank, i, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or after[j] != end:
            continue
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
            if (r := get(word[i : after[end]], NO_MERGE)) != NO_MERGE:
                heapq.heappush(heap, (r, i, after[end]))
        if (p := before[i]) >= 0 and (r := get(word[p:end], NO_MERGE)) != NO_MERGE:
            heapq.heappush(heap, (r, p, end))
    return [ranks[word[i : after[i]]] for i in range(n) if alive[i]]


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    return merge_short(word, ranks) if len(word) <= LONG_WORD else merge_long(word, ranks)


class Encoder:
    """Text to ids; remembers the words it has merged."""

    def __init__(self, raw: bytes) -> None:
        import regex

        self.ranks = read_ranks(raw)
        self.words = regex.compile(SPLIT_PATTERN).findall
        self.memo: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        memo = self.memo
        for word in self.words(text) if text else ():
            got = memo.get(word)
            if got is None:
                got = encode_word(word.encode("utf-8", "surrogatepass"), self.ranks)
                if len(word) <= LONG_WORD:
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    memo[word] = got
            ids += got
        return ids


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """One row per row of df: key as doc_id, and ids."""
    spark = SparkSession.active()
    size = os.path.getsize(vocabulary)
    if size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} has {size} bytes; a vocabulary may have {MAX_VOCABULARY_BYTES}")
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            ids = pa.array([encoder.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(df[key].alias("doc_id"), df[text].alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")
