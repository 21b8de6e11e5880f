"""Byte-level BPE by a rank queue with a hierarchical bitmap.

Pairs wait in buckets by merge rank; a bitmap of three levels tells the lowest
rank that waits by one find-first-set step a level; a bucket holds places of a
linked list, and an entry whose pair has changed meanwhile is
skipped.  A pre-token of n bytes takes O(n log n) steps, however long it is.

Null and empty text: no ids.  Repeated rows each get their row; columns other
than the two named are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache
from itertools import chain

from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_texts
from .pretok import pretokens

#: Pre-tokens that a Python worker remembers, about; the older half goes when it is full.
REMEMBERED = 500_000
#: Characters that are encoded at once.
BATCH_CHARS = 1_000_000
RANKS_FILE = "byte_bpe_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankQueue:
    """Buckets of places by rank; ``lowest`` finds the lowest rank that has any."""

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((ranks >> 6) + 1)  # 64 ranks a word
        self.mid = [0] * ((ranks >> 12) + 1)  # 64 words of low
        self.top = 0  # words of mid; as wide as it takes

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(place)
            return
        self.buckets[rank] = [place]
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def lowest(self) -> int:
        """-1 if nothing waits."""
        if not self.top:
            return -1
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        return a << 6 | (word & -word).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """The rank's bucket, which leaves the queue."""
        a, b = rank >> 6, rank >> 12
        self.low[a] &= ~(1 << (rank & 63))
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        return self.buckets.pop(rank)


def merge(pieces: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Ids of each pre-token: its lowest-ranked adjacent pair is merged first, the leftmost on ties.

    All pre-tokens stand in one linked list, with no pair across their ends, and
    share one queue: pre-tokens do not touch each other, so only the order
    within each matters, and that is by rank, then place.
    """
    data = b"".join(pieces)
    n = len(data)
    find = ranks.get
    after = list(range(1, n + 1))  # where the part that begins here ends
    before = list(range(-1, n - 1))
    waiting: list[int | None] = [None] * n  # rank of the pair that begins here
    limit: list[int] = [0] * n  # where the pre-token of this part ends
    queue = RankQueue(max(ranks.values(), default=0))
    push = queue.push
    at = 0
    for piece in pieces:
        end = at + len(piece)
        if end > at:
            before[at] = -1
            limit[at:end] = [end] * (end - at)
            if piece in ranks:
                after[at] = end
            else:
                for i in range(at, end - 1):
                    rank = waiting[i] = find(data[i : i + 2])
                    if rank is not None:
                        push(rank, i)
        at = end
    while (rank := queue.lowest()) >= 0:
        bucket = queue.take(rank)
        bucket.sort(reverse=True)
        while bucket:
            i = bucket.pop()
            if waiting[i] != rank:
                continue  # stale
            j = after[i]
            end = after[j]
            waiting[j] = None
            after[i] = end
            first = second = None
            if end < limit[i]:
                before[end] = i
                waiting[i] = first = find(data[i : after[end]])
                if first is not None:
                    push(first, i)
            else:
                waiting[i] = None
            k = before[i]
            if k >= 0:
                second = find(data[k:end])
                if second != waiting[k]:
                    waiting[k] = second
                    if second is not None:
                        push(second, k)
            if first is not None and first <= rank or second is not None and second <= rank:
                for i in bucket:  # what has just come goes first
                    push(rank, i)
                break
    out, at = [], 0
    for piece in pieces:
        end = at + len(piece)
        ids = []
        while at < end:
            ids.append(ranks[data[at : after[at]]])
            at = after[at]
        out.append(ids)
    return out


class Codec:
    """Encodes and decodes with the ranks of one file; remembers pre-tokens in two generations."""

    def __init__(self, path: str) -> None:
        self.ranks = load_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.decimal = {rank: str(rank) for rank in self.tokens}
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        if len(self.known) > REMEMBERED // 2:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        split = [pretokens(x) for x in texts]
        fresh = set().union(*split) - known.keys()
        new = []
        for piece in fresh:
            ids = older.get(piece)
            if ids is None:
                new.append(piece)
            else:
                known[piece] = ids
        known.update(zip(new, merge([x.encode() for x in new], self.ranks), strict=True))
        return [list(chain.from_iterable(map(known.__getitem__, x))) for x in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@cache
def codec(path: str | None) -> Codec:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(RANKS_FILE)
    return Codec(path)


def summary(texts: list[str | None], path: str | None) -> list[tuple]:
    own = codec(path)
    out = []
    for ids in own.encode([x or "" for x in texts]):
        shown = " ".join(map(own.decimal.__getitem__, ids))
        out.append((len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
    return out


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col`` and ids (array<int>) of each whole text; ``path`` names a ranks file, the public 50k one if None."""
    return map_texts(df, lambda texts: [(x,) for x in codec(path).encode([t or "" for t in texts])], "ids array<int>", id_col, text_col, BATCH_CHARS)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col``, n_tokens, and SHA-256 of the ids in decimal and of the bytes that they decode to."""
    return map_texts(df, lambda texts: summary(texts, path), "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col, BATCH_CHARS)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


QUERIES = {"op6_bpe": op6_bpe}
