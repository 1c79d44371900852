"""Token counts by byte-pair merging with a heap and a linked list.

A piece of text starts as one symbol a byte. The adjacent pair of lowest rank
(leftmost among equals) is popped from a heap and merged in a doubly linked
list until no adjacent pair has a rank. The count is the initial symbols minus
the merges; token identifiers are never produced. Work is O(n log n) in the
length of a piece, so a text without any white space is no special case.

Words repeat, so each Python worker keeps the counts of the short pieces and of
the short blank-separated chunks it has met, up to MEMO of each (about 100 bytes
an entry); a full memo starts over.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); the strings of
the file's special tokens inside a text count one token each, as the library
does by default; ties and repeated rows give equal rows; further columns of the
input are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import table, text_or_empty

MEMO = 500_000
#: The split of byte-level files whose pre-tokenizer has use_regex, as the library defines it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level files."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class PieceCounter(dict):
    """piece -> number of tokens; missing pieces are merged on first sight."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in merges)
        #: (left id << 20 | right id) -> (rank, merged id)
        self.ranks = {vocab[a] << 20 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.initial = [vocab[c] for c in byte_symbols()]
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]

    def __missing__(self, piece: str) -> int:
        n = self.merge(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 40:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = n
        return n

    def merge(self, data: bytes) -> int:
        ids = [self.initial[b] for b in data]
        n = len(ids)
        if n < 2:
            return n
        get = self.ranks.get
        heap = []
        for i in range(n - 1):
            if found := get(ids[i] << 20 | ids[i + 1]):
                heap.append((found[0], i, found[1]))
        if not heap:
            return n
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        merges = 0
        while heap:
            rank, i, merged = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            found = get(ids[i] << 20 | ids[j])
            if found is None or found[0] != rank:
                continue  # one of the two symbols has changed since
            ids[i], ids[j] = merged, -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := get(merged << 20 | ids[k]):
                    heappush(heap, (found[0], i, found[1]))
            h = before[i]
            if h >= 0 and (found := get(ids[h] << 20 | merged)):
                heappush(heap, (found[0], h, found[1]))
        return n - merges


class ChunkCounter(dict):
    """What follows a blank up to the next one -> its number of tokens, the blank included.

    A blank between two other characters always starts a piece, so such chunks
    can be counted alone. White space at an end of a chunk makes a longer run of
    it, which the split treats as a whole; UNSURE then sends the text to the
    split of the whole text.
    """

    UNSURE = 1 << 50

    def __init__(self, pieces: PieceCounter, find):
        super().__init__()
        self.pieces, self.find = pieces, find

    def whole(self, text: str) -> int:
        return sum(map(self.pieces.__getitem__, self.find(text)))

    def __missing__(self, chunk: str) -> int:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return self.UNSURE
        n = self.whole(" " + chunk)
        if len(chunk) <= 30:
            if len(self) >= MEMO:
                self.clear()
            self[chunk] = n
        return n

    def count(self, text: str) -> int:
        first, *rest = text.split(" ")
        n = sum(map(self.__getitem__, rest))
        if n >= self.UNSURE or first[-1:].isspace() or not first and rest:
            return self.whole(text)
        return n + self.whole(first)


@lru_cache(maxsize=2)
def counter(path: str):
    """text -> number of tokens, with what this worker has merged before in memory."""
    import regex

    pieces = PieceCounter(path)
    chunks = ChunkCounter(pieces, regex.compile(SPLIT).findall)
    special = regex.compile("|".join(map(regex.escape, pieces.special))) if pieces.special else None

    def count(text: str) -> int:
        if special is None or not any(s in text for s in pieces.special):
            return chunks.count(text)
        parts = special.split(text)
        return len(parts) - 1 + sum(map(chunks.count, parts))

    return count


def n_tokens(text: Column, path: str) -> Column:
    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        f = counter(path)
        return pa.array([f(t.as_py()) for t in texts], pa.int64())

    return count(text)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text."""
    text = text_or_empty("text")
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text, path or vocabulary_path()).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
