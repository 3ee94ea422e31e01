"""Byte-level BPE by corpus-level merge replay."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cached_property
from itertools import chain
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from roadspark.llm.common import extended, map_batches, released, texts, with_fields

#: Pieces whose ids a task keeps between batches; beyond it the store starts anew.
KEPT_PIECES = 150_000

_STATE: dict = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 token and its rank on each line."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in lines}


#: Pieces of more bytes than this are merged by the scalar form of the replay.
LONG_PIECE = 512

#: Ranks that the replay takes from its index at once.
RANK_RUN = 512


class Merges:
    """The vocabulary as a table of pairs: sorted keys ``left << 32 | right`` and the rank each merges to."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.keys, self.to = np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1])
        self.pair = dict(pairs)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it doesn't merge."""
        if not len(self.keys):
            return np.full(len(left), -1)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)


def replay(pieces: list[bytes], merges: Merges) -> list[np.ndarray]:
    """Ids of each piece, from replaying the merges over all pieces at once.

    All pieces lie behind one another in one array of tokens.  An inverted index leads from a mergeable
    pair, under its rank, to the positions where it stands in the corpus.  The ranks are taken in order, in
    runs of ``RANK_RUN``.  One step merges in every piece the first place of the lowest rank that the run
    holds for it, and looks up the pairs of the touched neighbours only; the run's other places in that
    piece go back to the index, after any lower rank that the step made.  So every piece sees its merges in
    rank order, from left to right.
    """
    if not pieces:
        return []
    long = {k: _replay_one(p, merges) for k, p in enumerate(pieces) if len(p) > LONG_PIECE}
    short = [b"" if k in long else p for k, p in enumerate(pieces)]
    sizes = np.array([len(p) for p in short])
    ends = np.cumsum(sizes)
    token = merges.byte[np.frombuffer(b"".join(short), np.uint8)]
    n = len(token)
    word = np.repeat(np.arange(len(short)), sizes)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    full = sizes > 0
    before[(ends - sizes)[full]], after[ends[full] - 1] = -1, -1
    index: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def back(run: int, places: np.ndarray) -> None:
        if run not in index:
            index[run] = []
            heapq.heappush(waiting, run)
        index[run].append(places)

    def enter(places: np.ndarray) -> None:
        runs = merges.of(token[places], token[after[places]]) // RANK_RUN
        places, runs = places[runs >= 0], runs[runs >= 0]
        order = np.argsort(runs, kind="stable")
        places, runs = places[order], runs[order]
        cut = np.flatnonzero(runs[1:] != runs[:-1]) + 1
        for run, part in zip(runs[[0, *cut]].tolist() if len(runs) else (), np.split(places, cut), strict=False):
            back(run, part)

    enter(np.flatnonzero(after >= 0))
    while waiting:
        run = heapq.heappop(waiting)
        places = np.sort(np.concatenate(index.pop(run)))
        places = places[np.diff(places, prepend=-1) > 0]
        right = after[places]
        there = (token[places] >= 0) & (right >= 0)
        places, right = places[there], right[there]
        rank = merges.of(token[places], token[right])
        there = rank // RANK_RUN == run
        order = np.lexsort((rank[there], word[places[there]]))
        places, right, rank = places[there][order], right[there][order], rank[there][order]
        if not len(places):
            continue
        first = np.ones(len(places), bool)
        first[1:] = word[places[1:]] != word[places[:-1]]
        if not first.all():
            back(run, places[~first])
            places, right, rank = places[first], right[first], rank[first]
        beyond = after[right]
        token[places], token[right] = rank, -1
        after[places], after[right] = beyond, -1
        before[beyond[beyond >= 0]] = places[beyond >= 0]
        left = before[places]
        touched = np.concatenate([left[left >= 0], places[beyond >= 0]])
        if len(touched):
            enter(touched)
    alive = token >= 0
    counts = np.r_[0, np.cumsum(alive)]
    ids = token[alive].astype("<u4")
    edges = counts[ends].tolist()
    starts = counts[ends - sizes].tolist()
    return [long[k] if k in long else ids[a:b] for k, (a, b) in enumerate(zip(starts, edges, strict=True))]


def _replay_one(piece: bytes, merges: Merges) -> np.ndarray:
    """The same for one long piece: a heap of (rank, place) instead of whole ranks."""
    token = merges.byte[np.frombuffer(piece, np.uint8)].tolist()
    n = len(token)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    pair = merges.pair.get
    heap = [(r, i) for i in range(n - 1) if (r := pair(token[i] << 32 | token[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if token[i] < 0 or j < 0 or pair(token[i] << 32 | token[j]) != rank:
            continue
        token[i], token[j] = rank, -1
        after[i], after[j] = after[j], -1
        if after[i] >= 0:
            before[after[i]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] >= 0 and (r := pair(token[left] << 32 | token[after[left]])) is not None:
                heapq.heappush(heap, (r, left))
    return np.array([t for t in token if t >= 0], "<u4")


class Codec:
    """Ranks, pattern and the ids met so far, one for each worker process.

    ``pieces`` holds the ids of matches of the pattern, ``chunks`` those of what stands behind one space up
    to the next: if it starts and ends with no white space, its matches don't depend on what surrounds it.
    """

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.split = regex.compile(pattern).findall
        self.by_space = pattern == public_tokenizers.PATTERN
        self.bytes_of = np.empty(max(self.ranks.values()) + 1, dtype=object)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    @cached_property
    def merges(self) -> Merges:
        return Merges(self.ranks)

    def forget(self) -> None:
        """Let go of the ids met; a worker between tasks holds the vocabulary only."""
        self.pieces, self.chunks = {}, {}
        released()

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in _STATE:
            _STATE[path, pattern] = cls(path, pattern)
        return _STATE[path, pattern]

    def learn(self, pieces: set[str]) -> None:
        """Merge every piece that is new, all of them together."""
        new = list(pieces.difference(self.pieces))
        raw = [p.encode() for p in new]
        whole = [self.ranks.get(r) for r in raw]
        merged = iter(replay([r for r, w in zip(raw, whole, strict=True) if w is None], self.merges))
        for piece, w in zip(new, whole, strict=True):
            self.pieces[piece] = next(merged).tobytes() if w is None else w.to_bytes(4, "little")

    def encode(self, batch: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        if len(self.pieces) > KEPT_PIECES:
            self.pieces = {}
        if len(self.chunks) > KEPT_PIECES:
            self.chunks = {}
        cut = [t.split(" ") if self.by_space else [] for t in batch]
        new: set[str] = set()
        for chunks in cut:
            new.update(chunks[1:])
        new.difference_update(self.chunks)
        odd = {c for c in new if not c or c[0].isspace() or c[-1].isspace()}
        new -= odd
        split = {c: self.split(" " + c) for c in new}
        apart: dict[int, list[str]] = {}
        for k, chunks in enumerate(cut):
            if not self.by_space or odd and not odd.isdisjoint(chunks) or chunks[0][-1:].isspace():
                apart[k] = self.split(batch[k])
            else:
                apart[k] = self.split(chunks[0])
        self.learn(set(chain.from_iterable(split.values())).union(*apart.values()))
        piece, chunk = self.pieces.__getitem__, self.chunks.__getitem__
        for c, pieces in split.items():
            self.chunks[c] = b"".join(map(piece, pieces))
        out = []
        for k, chunks in enumerate(cut):
            ids = b"".join(map(piece, apart[k]))
            if self.by_space and not (odd and not odd.isdisjoint(chunks) or chunks[0][-1:].isspace()):
                ids += b"".join(map(chunk, chunks[1:]))
            out.append(ids)
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(self.bytes_of[np.frombuffer(packed, "<u4")])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """Add ``token_ids`` (ids of the whole text as little-endian unsigned 32-bit integers) and ``n_tokens``.

    With ``decoded`` also what ``decode`` adds of these ids, from the same worker, so that a task has one with one vocabulary.

    Each match of ``pattern`` is merged by itself; no special tokens.  A null text counts as empty and has
    no ids; repeated rows stay; an empty table gives an empty one; columns named like the new ones are replaced.  ``path`` names the rank file,
    which every executor has.
    """
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType()), *[T.StructField("decoded", T.BinaryType())] * decoded]
    schema = with_fields(docs, *added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        codec.forget()
        for batch in batches:
            ids = codec.encode(texts(batch, text))
            new = {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "token_ids": pa.array(ids, pa.binary())}
            yield extended(batch, new | ({"decoded": pa.array(map(codec.decode, ids), pa.binary())} if decoded else {}))
            del batch, ids, new
            released()
        codec.forget()

    return map_batches(docs, run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """Add ``decoded``, the bytes that the packed ``ids`` stand for; null ids give empty bytes, an empty table an empty one."""
    schema = with_fields(encoded, T.StructField("decoded", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            yield extended(batch, {"decoded": pa.array([codec.decode(x or b"") for x in batch.column(ids).to_pylist()], pa.binary())})

    return map_batches(encoded, run, schema)
