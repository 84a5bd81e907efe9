"""Token ids of a whole corpus by a public byte-level BPE vocabulary.

A text is split by the vocabulary's published pattern. Within a piece the pairs
of adjacent symbols are the leaves of a segment tree whose root holds the lowest
rank, the leftmost where ranks tie. Each merge changes at most three leaves and
the paths above them, so a piece of n bytes takes O(n log n) however long it is.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldspan.runtime import spread

VOCABULARY = os.environ.get("GOLDSPAN_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the split pattern published with byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces a worker remembers; longer pieces than KEPT_BYTES aren't remembered, so memory is bounded.
KEPT_PIECES, KEPT_BYTES = 200_000, 64
NO_RANK = 1 << 40
#: Bytes of a vocabulary's file at most.
LARGEST = 64 << 20


class Encoder:
    """Encodes texts by one vocabulary of lines ``base64-token rank``."""

    def __init__(self, path: str = VOCABULARY, raw: bytes | None = None):
        if raw is None:
            with open(path, "rb") as file:
                raw = file.read()
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}
        self.split = regex.compile(PATTERN).findall
        self.kept: dict[str, list[int]] = {}

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one piece: merge the lowest-ranked adjacent pair until none can merge."""
        ranks = self.ranks
        whole = ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        width = 1
        while width < n:
            width *= 2
        parts: list[bytes] = [raw[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # A leaf holds rank * n + place, so that the smallest leaf is the leftmost of the lowest rank.
        tree = [NO_RANK * n] * (2 * width)
        for i in range(n - 1):
            rank = ranks.get(raw[i : i + 2])
            if rank is not None:
                tree[width + i] = rank * n + i
        for k in range(width - 1, 0, -1):
            left, right = tree[2 * k], tree[2 * k + 1]
            tree[k] = left if left < right else right

        def put(place: int, value: int) -> None:
            k = width + place
            tree[k] = value
            k //= 2
            while k:
                left, right = tree[2 * k], tree[2 * k + 1]
                low = left if left < right else right
                if tree[k] == low:
                    break
                tree[k] = low
                k //= 2

        none = NO_RANK * n
        while tree[1] < none:
            i = tree[1] % n
            j = after[i]
            parts[i] += parts[j]
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, none)
            rank = ranks.get(parts[i] + parts[after[i]]) if after[i] < n else None
            put(i, none if rank is None else rank * n + i)
            p = before[i]
            if p >= 0:
                rank = ranks.get(parts[p] + parts[i])
                put(p, none if rank is None else rank * n + p)
        out, i = [], 0
        while i < n:
            out.append(ranks[parts[i]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty text and a null text both give an empty list."""
        if not text:
            return []
        kept, ids = self.kept, []
        for piece in self.split(text):
            known = kept.get(piece)
            if known is None:
                known = self.piece(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= KEPT_BYTES:
                    if len(kept) >= KEPT_PIECES:
                        kept.clear()
                    kept[piece] = known
            ids += known
        return ids


_encoders: dict[str, Encoder] = {}


def shipped(spark: SparkSession, path: str) -> tuple[str, Broadcast]:
    """The vocabulary's file, read where the driver runs and sent to every executor; vocabularies are a few MB, larger files are refused."""
    with open(path, "rb") as file:
        raw = file.read(LARGEST + 1)
    if len(raw) > LARGEST:
        raise ValueError(f"{path} is no vocabulary: over {LARGEST} bytes")
    return hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw)


def encoder(vocabulary: tuple[str, Broadcast]) -> Encoder:
    """The process's encoder of a shipped vocabulary, made once."""
    name, raw = vocabulary
    if name not in _encoders:
        _encoders[name] = Encoder(raw=raw.value)
    return _encoders[name]


def token_ids(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ids (array of int) of every document.

    Empty and null texts give empty lists. Special tokens are neither added nor
    recognised: their strings are ordinary text. Texts are encoded whole,
    whatever their length. Repeated rows give repeated rows; a null doc_id stays
    null; further columns are ignored; an empty table gives an empty table.
    """
    rows = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    sent = shipped(documents.sparkSession, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(sent)
        for batch in batches:
            ids = pa.array([own.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return rows.mapInArrow(encode, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of keep and n_tokens of every document; the ids themselves don't leave the worker."""
    rows = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), *keep, "text"))
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_tokens bigint"

    sent = shipped(documents.sparkSession, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(sent)
        for batch in batches:
            n = pa.array([len(own.encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*batch.schema.names[:-1], "n_tokens"])

    return rows.mapInArrow(count, schema)
