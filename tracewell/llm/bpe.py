"""Byte-level BPE by corpus merge replay, and decoding.

The pretokens of a corpus repeat, so merges are applied to the distinct ones, all at once. Their
symbols lie in one flat array, linked to their neighbours. An inverted index holds, for each pair of
tokens that makes a token, the positions in the words where it stands; the made token's rank names the
pair. Ranks are taken from the index in rising order: all positions of a rank are merged, and only the
pairs with the two neighbours of each are looked up anew and go back into the index.

A merge may open a lower rank in its word, which the tiktoken library would take before other places
of the rank at hand. Words where that occurs are replayed once more, one place at a time from the left.

Merges never cross pretokens, so a replay may cover any set of them. Here each Spark task replays the
distinct pretokens of its own partition, as it meets them, and knows up to HELD bytes of them: text
that went to meet a vocabulary of the whole corpus would be shuffled as a whole. Nothing that grows
with the input is collected or broadcast; the rank file (about 50,000 entries) is, as arrays.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField

from tracewell.llm.common import append_arrow

#: Bytes of pretokens that a task knows the ids of; beyond it a pretoken is replayed again.
HELD = 1 << 21
NONE = np.int32(2**31 - 1)
#: What an id that names no token decodes to.
UNKNOWN = "�".encode()


@dataclass(frozen=True)
class Vocabulary:
    """keys, values: left << 32 | right of each pair of tokens that makes a token, rising, and the rank
    of what it makes. of_byte: the rank of each byte, -1 if it has none."""

    pattern: str
    ranks: dict[bytes, int]
    keys: np.ndarray
    values: np.ndarray
    of_byte: np.ndarray

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it makes no token."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        want = left.astype(np.int64) << 32 | right
        at = self.keys.searchsorted(want)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == want, self.values[at], NONE)


def vocabulary(ranks: dict[bytes, int], pattern: str) -> Vocabulary:
    pairs = {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
    keys = np.array(sorted(pairs), np.int64)
    return Vocabulary(pattern, ranks, keys, np.array([pairs[k] for k in keys.tolist()], np.int32), np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32))


def load(path: str, pattern: str) -> Vocabulary:
    """A rank file (base64 token and rank per line), read on the driver."""
    with open(path, "rb") as f:
        return vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)


class Words:
    """The symbols of words as one linked list, and the inverted index from pair to positions.

    A word's symbols begin as its bytes. Position 0 and the one after each word hold no symbol (token
    -1), so that no pair crosses words. pair[p] is the rank of the pair at p and its successor."""

    def __init__(self, words: list[bytes], v: Vocabulary):
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes + 1)
        n = 1 + int(ends[-1]) if len(words) else 1
        self.v, self.alive = v, np.ones(n, bool)
        self.alive[0] = self.alive[ends] = False
        self.token = np.full(n, -1, np.int32)
        self.token[self.alive] = v.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        if (self.token[self.alive] < 0).any():
            raise KeyError("a byte has no rank of its own")
        self.word = np.repeat(np.arange(-1, len(words), dtype=np.int32), np.concatenate([[1], sizes + 1]))
        self.after, self.before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        self.pair = np.full(n, NONE)
        self.index: dict[int, list[np.ndarray]] = {}
        self.queue: list[int] = []
        self.look_up(np.flatnonzero(self.alive[:-1] & self.alive[1:]).astype(np.int32))

    def look_up(self, at: np.ndarray) -> np.ndarray:
        """Renews the pairs at the given rising positions and their entries in the index; returns their ranks."""
        ranks = self.v.ranks_of(self.token[at], self.token[self.after[at]])
        self.pair[at] = ranks
        some = ranks != NONE
        self.enter(at[some], ranks[some])
        return ranks

    def enter(self, at: np.ndarray, ranks: np.ndarray) -> None:
        order = ranks.argsort(kind="stable")
        at, ranks = at[order], ranks[order]
        first = np.flatnonzero(np.diff(ranks, prepend=-1))
        edges = [*first.tolist(), len(ranks)]
        for k, rank in enumerate(ranks[first].tolist()):
            held = self.index.get(rank)
            if held is None:
                self.index[rank] = held = []
                heapq.heappush(self.queue, rank)
            held.append(at[edges[k] : edges[k + 1]])

    def merge_next(self, singly: bool) -> np.ndarray:
        """Merges what the index holds for its lowest rank (singly: only the first place in each word)
        and returns the words where that opened a lower one."""
        rank = heapq.heappop(self.queue)
        held = self.index.pop(rank)
        at = held[0] if len(held) == 1 else np.sort(np.concatenate(held))
        at = at[self.pair[at] == rank]  # neighbours may have been merged since the entry
        if not len(at):
            return at
        if singly:
            lead = np.diff(self.word[at], prepend=-1) != 0
            at, rest = at[lead], at[~lead]
            self.enter(rest, np.full(len(rest), rank, np.int32))
        else:
            at = self.apart(at)
        right = self.after[at]
        beyond = self.after[right]
        opened = [self.word[at[(self.pair[beyond] == rank) & (self.v.ranks_of(np.full(len(at), rank), self.token[beyond]) < rank)]]]
        self.token[at], self.pair[right], self.alive[right] = rank, NONE, False
        self.after[at], self.before[beyond] = beyond, at
        touched = np.unique(np.concatenate([at, self.before[at]]))
        touched = touched[self.alive[touched]]
        return np.concatenate([*opened, self.word[touched[self.look_up(touched) < rank]]])

    def apart(self, at: np.ndarray) -> np.ndarray:
        """Of places that overlap, as in a run of one letter, every other one from the left."""
        follows = np.concatenate([[False], self.after[at[:-1]] == at[1:]])
        if not follows.any():
            return at
        number = np.arange(len(at))
        first = np.maximum.accumulate(np.where(follows, 0, number))
        return at[(number - first) % 2 == 0]


def replay(words: list[bytes], v: Vocabulary, singly: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of all words, one after the other, and each word's number of ids. A word that is a
    token as a whole is that token, as in tiktoken. Bytes without a rank of their own are an error."""
    whole = [v.ranks.get(w) for w in words]
    if not singly and any(w is not None for w in whole):
        rest = [i for i, w in enumerate(whole) if w is None]
        ids, sizes = replay([words[i] for i in rest], v)
        all_sizes = np.ones(len(words), np.int64)
        all_sizes[rest] = sizes
        starts = np.cumsum(all_sizes) - all_sizes
        out, known = np.empty(int(all_sizes.sum()), np.int32), np.ones(int(all_sizes.sum()), bool)
        known[spread(np.arange(len(out)), starts, all_sizes, np.array(rest, np.int64))] = False
        out[~known], out[known] = ids, [w for w in whole if w is not None]
        return out, all_sizes
    state, again = Words(words, v), []
    while state.queue:
        again.append(state.merge_next(singly))
    ids, sizes = state.token[state.alive], np.bincount(state.word[state.alive], minlength=len(words))
    redo = np.unique(np.concatenate(again)) if again and not singly else ()
    if len(redo):
        parts, (own, own_sizes) = np.split(ids, np.cumsum(sizes)[:-1]), replay([words[i] for i in redo], v, singly=True)
        for i, part in zip(redo, np.split(own, np.cumsum(own_sizes)[:-1]), strict=True):
            parts[i], sizes[i] = part, len(part)
        ids = np.concatenate(parts)
    return ids, sizes


def spread(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + sizes[i]] for each i of which, one after the other."""
    n = sizes[which]
    ends = np.cumsum(n)
    return flat[np.arange(ends[-1] if len(n) else 0) + np.repeat(starts[which] - ends + n, n)]


class Encoder:
    """Encodes lists of texts; numbers the pretokens it has met and knows their ids."""

    def __init__(self, v: Vocabulary):
        self.v, self.split = v, regex.compile(v.pattern).findall
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.bytes, self.ids, self.sizes = 0, np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and each text's number of ids."""
        if self.bytes > HELD:
            self.forget()
        pieces, known = [], len(self.number)
        for t in texts:
            p = self.split(t)
            pieces.append(np.fromiter(map(self.number.__getitem__, p), np.int32, len(p)))
        new = [w.encode() for w in islice(self.number, known, None)]
        ids, sizes = replay(new, self.v)
        self.bytes += sum(map(len, new))
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        which = np.concatenate([np.zeros(0, np.int32), *pieces])
        n = np.concatenate([[0], np.cumsum(self.sizes[which])])
        edges = np.cumsum([0, *map(len, pieces)])
        return spread(self.ids, np.cumsum(self.sizes) - self.sizes, self.sizes, which), np.diff(n[edges])


def decoder(v: Vocabulary):
    """A function from ids (None or unknown: UNKNOWN) to bytes."""
    token = {r: t for t, r in v.ranks.items()}
    return lambda ids: b"".join([token.get(i, UNKNOWN) for i in ids])


def encode(df: DataFrame, v: Vocabulary, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with the token ids of each whole text and, in column decoded, what they decode to.

    Null and empty texts have no ids and decode to no bytes. Repeated rows get equal ids. Columns of df
    named like the results are replaced. No rows: no rows."""
    shared = df.sparkSession.sparkContext.broadcast(v)

    def start():
        encoder, bytes_of = Encoder(shared.value), decoder(shared.value)

        def make(batch):
            ids, sizes = encoder.encode([x or "" for x in batch.column(text).to_pylist()])
            edges = np.concatenate([[0], np.cumsum(sizes)])
            made = [pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))]
            if decoded:
                made.append(pa.array([bytes_of(ids[a:b].tolist()) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()))
            return made

        return make

    fields = [StructField(out, ArrayType(IntegerType())), *([StructField(decoded, BinaryType())] if decoded else [])]
    return append_arrow(df, fields, start, text)


def decode(df: DataFrame, v: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes of each list of ids. Null and empty lists have none; a null id and one that
    names no token give the bytes of U+FFFD. Repeated rows get equal bytes. A column of df named like out
    is replaced. No rows: no rows."""
    shared = df.sparkSession.sparkContext.broadcast(v)

    def start():
        bytes_of = decoder(shared.value)
        return lambda batch: [pa.array([bytes_of(x or ()) for x in batch.column(ids).to_pylist()], pa.binary())]

    return append_arrow(df, [StructField(out, BinaryType())], start, ids)
