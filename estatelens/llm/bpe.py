"""Byte-level BPE by corpus-level merge replay.

The distinct words of a block of texts are encoded together. An inverted index
leads from the rank of a token pair to the positions where the pair stands;
ranks are taken in order, each is applied at all its positions at once, and only
the pairs that touch a merge are looked up and indexed again. The ids of texts
are then put together from the ids of their words.

The block that is replayed is what one task holds of the corpus, not the whole
corpus: words don't influence each other, so the ids are the same, no word has to
be shuffled, and a lost executor costs its own blocks only.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import small_batches, texts_of
from estatelens.llm.units import UnitEncoder

_NONE = np.iinfo(np.int32).max


class Replay:
    """Merges from a table of ranks; the id of a token is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.end = len(self.tokens)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (ranks[token[:i]] * (self.end + 1) + ranks[token[i:]], rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        pairs.sort()
        self.pair = np.array([p for p, _ in pairs], np.int64)
        self.rank = np.array([r for _, r in pairs], np.int32)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) * (self.end + 1) + right
        slot = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
        return np.where(self.pair[slot] == pair, self.rank[slot], _NONE)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word, as merging its lowest-ranked pair again and again gives them."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        n = int(length.sum())
        start = np.cumsum(length) - length
        token = np.append(self.byte[np.frombuffer(b"".join(words), np.uint8)], np.int32(self.end))
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[(start + length - 1)[length > 0]] = n
        before[start[length > 0]] = n
        after[n] = before[n] = n
        rank = np.append(self._ranks(token[:-1], token[after[:-1]]), _NONE) if n else np.array([_NONE])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            at = at[rank[at] != _NONE]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            found = rank[at]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            for r, part in zip(found[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts)):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heappush(heap, r)

        add(np.arange(n))
        while heap:
            r = heappop(heap)
            at = index.pop(r)
            at = np.unique(np.concatenate(at)) if len(at) > 1 else at[0]
            at = at[rank[at] == r]
            if not len(at):
                continue
            at = _apart(at, after)
            gone = after[at]
            follow = after[gone]
            token[at] = r
            token[gone] = -1
            rank[gone] = _NONE
            after[at] = follow
            before[follow] = at
            touched = np.concatenate((before[at], at))
            touched = touched[touched != n]
            rank[touched] = self._ranks(token[touched], token[after[touched]])
            add(touched)
        alive = token[:n] >= 0
        ids = token[:n][alive]
        count = np.concatenate(([0], np.cumsum(alive)))
        return [ids[a:b] for a, b in zip(count[start], count[start + length])]


def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of pairs that share a token, as in a run of equal tokens, every second from the left."""
    follows = np.concatenate(([False], after[at[:-1]] == at[1:]))
    if not follows.any():
        return at
    begin = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
    return at[(np.arange(len(at)) - begin) % 2 == 0]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class WordEncoder:
    """Ids of units: the pattern cuts them into words, unknown words are replayed together.

    Keeps at most ``most`` words.
    """

    def __init__(self, replay: Replay, pattern: str, most: int = 300_000):
        self.replay, self.most = replay, most
        self.words_of = regex.compile(pattern).findall
        self.ids: dict[str, bytes] = {}

    def __call__(self, units: list[bytes]) -> list[bytes]:
        split = [self.words_of(u.decode()) for u in units]
        wanted = {w for words in split for w in words}
        if len(self.ids) + len(wanted) > self.most:
            self.ids = {}
        new = [w for w in wanted if w not in self.ids]
        self.ids.update(zip(new, map(np.ndarray.tobytes, self.replay.encode([w.encode() for w in new]))))
        ids = self.ids
        return [ids[words[0]] if len(words) == 1 else b"".join([ids[w] for w in words]) for words in split]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> tuple[Replay, UnitEncoder]:
    """One for each worker process."""
    replay = Replay(load_ranks(path))
    return replay, UnitEncoder(WordEncoder(replay, pattern))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) for each row of ``docs``; a null or empty text has no ids.

    ``path`` is a file of ranks that every executor has, ``pattern`` splits texts
    into words. No special tokens. Repeated rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, units = encoder(path, pattern)
        for batch in small_batches(batches, "text", 4 << 20):
            ids, at = units.texts(*texts_of(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "ids": lists})

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes) from (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(path)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            texts = [b"".join([tokens[i] for i in x]) for x in ids]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "bytes": pa.array(texts, pa.binary())})

    return encoded.mapInArrow(run, "doc_id bigint, bytes binary")


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass.

    ids_sha256 is taken of the decimal ids with single spaces between,
    decoded_sha256 of the bytes that the ids decode to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, units = encoder(path, pattern)
        decimal = [str(i).encode() for i in range(replay.end)]
        for batch in small_batches(batches, "text", 4 << 20):
            ids, at = units.texts(*texts_of(batch.column("text")))
            said, back = [], []
            for i in range(batch.num_rows):
                own = ids[at[i] : at[i + 1]].tolist()
                said.append(hashlib.sha256(b" ".join([decimal[x] for x in own])).hexdigest())
                back.append(hashlib.sha256(b"".join([replay.tokens[x] for x in own])).hexdigest())
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array(np.diff(at), pa.int64()),
                "ids_sha256": pa.array(said, pa.string()), "decoded_sha256": pa.array(back, pa.string()),
            })

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
