"""Byte-level BPE encoding with a hierarchical-bitmap rank queue.

The encoder follows the public definition of byte-level BPE: text is cut into
pre-tokens by a pattern, each pre-token is a sequence of bytes, and the
adjacent pair whose concatenation has the lowest rank is merged until no pair
is in the vocabulary.

Pairs waiting to be merged sit in one bucket per merge rank; a bucket holds
positions of a doubly linked list of symbols.  A three-level bitmap over the
ranks tells which buckets are filled, so the next rank is three find-first-set
steps away, whatever the length of the sequence.  Entries that an earlier merge
made invalid are skipped when their bucket is drained.  A pre-token of n bytes
thus costs O(n) queue steps, where rescanning costs O(n^2).

All pre-tokens of a batch that are not in the cache share one queue: they lie
one after the other in the same linked list, with no link across a border.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Sequence

import numpy as np
import regex

_NONE = -1

# Unicode white space.  A cut before a space that a word follows, or between
# the last and the other characters of a run of white space, is a pre-token
# border under the usual byte-level patterns.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ASCII_SPACE = r"\t\n\x0b\x0c\r "
_CHUNKS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall
_CHUNKS_ASCII = re.compile(f" ?[^{_ASCII_SPACE}]+|[{_ASCII_SPACE}]+(?![^{_ASCII_SPACE}])|[{_ASCII_SPACE}]+").findall


class RankQueue:
    """Integers in [0, size) as a set with the smallest member on demand."""

    __slots__ = ("_leaf", "_mid", "_top")

    def __init__(self, size: int) -> None:
        leaves = (size >> 6) + 1
        self._leaf = [0] * leaves
        self._mid = [0] * ((leaves >> 6) + 1)
        self._top = 0

    def add(self, rank: int) -> None:
        leaf = rank >> 6
        mid = leaf >> 6
        self._leaf[leaf] |= 1 << (rank & 63)
        self._mid[mid] |= 1 << (leaf & 63)
        self._top |= 1 << mid

    def discard(self, rank: int) -> None:
        leaf = rank >> 6
        mid = leaf >> 6
        self._leaf[leaf] &= ~(1 << (rank & 63))
        if not self._leaf[leaf]:
            self._mid[mid] &= ~(1 << (leaf & 63))
            if not self._mid[mid]:
                self._top &= ~(1 << mid)

    def first(self) -> int:
        """The smallest member, -1 if there is none."""
        top = self._top
        if not top:
            return _NONE
        mid = (top & -top).bit_length() - 1
        word = self._mid[mid]
        leaf = (mid << 6) + (word & -word).bit_length() - 1
        word = self._leaf[leaf]
        return (leaf << 6) + (word & -word).bit_length() - 1


class _Pairs(dict):
    """``left << 20 | right`` to the rank of the merged pair, filled on demand."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self._ranks = ranks
        self._bytes_of = {rank: token for token, rank in ranks.items()}

    def __missing__(self, key: int) -> int:
        bytes_of = self._bytes_of
        rank = self[key] = self._ranks.get(bytes_of[key >> 20] + bytes_of[key & 0xFFFFF], _NONE)
        return rank


class BytePairEncoder:
    """Encoder for a ``{token bytes: rank}`` vocabulary and a pre-token pattern.

    The pattern must never let a pre-token cross white space, but for one space
    before a word.  ``cache_size`` bounds the number of chunks of text whose ids
    a worker remembers; the cache is emptied when it is full.  Chunks of more
    than ``cache_longest`` characters are never kept.
    """

    def __init__(
        self,
        ranks: dict[bytes, int],
        pattern: str,
        cache_size: int = 400_000,
        cache_longest: int = 64,
    ) -> None:
        self._ranks = ranks
        self._size = max(ranks.values()) + 1
        self._find = regex.compile(pattern).findall
        self._cache: dict[str, bytes] = {}
        self._cache_size = cache_size
        self._cache_longest = cache_longest
        self._single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self._pairs = _Pairs(ranks)
        self._words: dict[str, bytes] = {}
        table = np.full((256, 256), _NONE, dtype=np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                table[token[0], token[1]] = rank
        self._byte_pairs = table

    # -- merging ----------------------------------------------------------

    def merge_many(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all byte strings one after the other, number of ids of each).

        One rank queue serves all of them.
        """
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        n = len(raw)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        first = np.zeros(n, dtype=bool)
        first[starts[lengths > 0]] = True
        last = np.zeros(n, dtype=bool)
        last[ends[lengths > 0] - 1] = True
        index = np.arange(n)
        symbol: list[int] = self._single[raw].tolist()
        nxt: list[int] = np.where(last, _NONE, index + 1).tolist()
        prev: list[int] = np.where(first, _NONE, index - 1).tolist()

        pair = self._byte_pairs[raw[:-1], raw[1:]]
        pair[last[:-1]] = _NONE
        at = np.flatnonzero(pair != _NONE)
        order = np.argsort(pair[at], kind="stable")
        at, ranks = at[order], pair[at[order]]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        buckets: dict[int, list[int]] = {}
        queue = RankQueue(self._size)
        for group, rank in zip(np.split(at, cuts), ranks[np.r_[0, cuts]].tolist() if len(ranks) else ()):
            buckets[rank] = group.tolist()
            queue.add(rank)

        pairs = self._pairs
        while (rank := queue.first()) != _NONE:
            bucket = buckets.pop(rank)
            queue.discard(rank)
            if len(bucket) > 1:
                bucket.sort()
            for k, here in enumerate(bucket):
                left = symbol[here]
                if left < 0 or (right_at := nxt[here]) == _NONE:
                    continue
                if pairs[left << 20 | symbol[right_at]] != rank:
                    continue  # stale: one side was merged since
                symbol[here] = rank
                symbol[right_at] = _NONE
                after = nxt[here] = nxt[right_at]
                lowest = rank
                if after != _NONE:
                    prev[after] = here
                    new = pairs[rank << 20 | symbol[after]]
                    if new != _NONE:
                        if new in buckets:
                            buckets[new].append(here)
                        else:
                            buckets[new] = [here]
                            queue.add(new)
                        lowest = new if new < lowest else lowest
                before = prev[here]
                if before != _NONE:
                    new = pairs[symbol[before] << 20 | rank]
                    if new != _NONE:
                        if new in buckets:
                            buckets[new].append(before)
                        else:
                            buckets[new] = [before]
                            queue.add(new)
                        lowest = new if new < lowest else lowest
                if lowest < rank and k + 1 < len(bucket):
                    buckets[rank] = bucket[k + 1 :]  # a merge opened a lower rank, which comes first
                    queue.add(rank)
                    break
        if len(pairs) > 4_000_000:
            pairs.clear()

        flat = np.array(symbol, dtype=np.int32)
        alive = flat >= 0
        counts = np.add.reduceat(np.r_[alive, False].astype(np.int64), np.minimum(starts, n))
        counts[lengths == 0] = 0
        return flat[alive], counts

    # -- texts ------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        return self._find(text)

    def chunks(self, text: str) -> list[str]:
        """The text cut at white space only; no pre-token crosses a cut."""
        return _CHUNKS_ASCII(text) if text.isascii() else _CHUNKS(text)

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        cut = list(map(self._find, chunks))
        words = self._words
        missing = [w for w in set().union(*cut) if w not in words]
        if len(words) + len(missing) > self._cache_size:
            words.clear()
            missing = list(set().union(*cut))
        ids, counts = self.merge_many([w.encode("utf-8", "surrogatepass") for w in missing])
        ends = (np.cumsum(counts) * 4).tolist()
        raw = ids.astype("<i4").tobytes()
        words.update(zip(missing, [raw[a:b] for a, b in zip([0, *ends], ends)]))
        get = words.__getitem__
        out = [get(own[0]) if len(own) == 1 else b"".join(map(get, own)) for own in cut]
        for w in missing:
            if len(w) > self._cache_longest:
                del words[w]
        return out

    def _lookup(self, batch: Iterable[list[str]]) -> dict[str, bytes]:
        """A table with the ids, as int32 bytes, of every chunk of the batch."""
        cache = self._cache
        wanted = set().union(*batch)
        missing = [w for w in wanted if w not in cache]
        if not missing:
            return cache
        encoded = zip(missing, self._encode_chunks(missing))
        if len(cache) + len(missing) > self._cache_size:
            table = {w: cache[w] for w in wanted if w in cache} | dict(encoded)
            cache.clear()
            return table
        long = {}
        for w, ids in encoded:
            (cache if len(w) <= self._cache_longest else long)[w] = ids
        return {**cache, **long} if long else cache

    def encode_batch(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text).

        Null and empty texts have no ids.
        """
        cut = [self.chunks(t) if t else [] for t in texts]
        get = self._lookup(cut).__getitem__
        parts = [b"".join(map(get, chunks)) for chunks in cut]
        counts = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) >> 2
        return np.frombuffer(b"".join(parts), dtype="<i4"), counts

    def count_batch(self, texts: Sequence[str | None]) -> np.ndarray:
        """The number of ids of each text, 0 for null."""
        cut = [self.chunks(t) if t else [] for t in texts]
        get = self._lookup(cut).__getitem__
        return np.array([sum(map(len, map(get, chunks))) for chunks in cut], dtype=np.int64) >> 2

    def chunk_counts(self, batch: Sequence[list[str]]) -> list[np.ndarray]:
        """Tokens of each chunk of each list."""
        get = self._lookup(batch).__getitem__
        return [np.fromiter(map(len, map(get, chunks)), dtype=np.int64, count=len(chunks)) >> 2 for chunks in batch]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
