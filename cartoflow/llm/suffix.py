"""Repeated passages across documents, by suffix arrays.

Every byte that a string of LENGTH bytes covers which also starts in a document
with a smaller id is removed.

1. Documents are dealt to blocks by hash of the id.  A string of LENGTH bytes is
   known by its least K-gram hash, its anchor; neighbouring strings mostly share
   one.  Blocks send the distinct anchors, by anchor range, to where those that
   two documents hold are found; nothing else can repeat.
2. Blocks cut out the runs of strings that have such an anchor, once each, and
   send them to shards by anchor, so equal strings meet.
3. A shard is a bounded piece of text: its suffix array comes from prefix ranks
   refined by doubling (only groups that are not yet single are sorted again),
   its common prefixes from Kasai's rule over many stretches side by side.
   Strings of one anchor that fill several shards are merged by binary search in
   the shards' sorted strings.  Each string gets the least id that has it.
4. Blocks take the runs back and remove what has a smaller id.

A hot anchor, one with more than HOT_RUNS distinct runs, would gather them in
one shard.  Its runs are cut into single strings, which go by their own hash, so
that equal strings still meet and the anchor is spread over all ranges.

Strings are judged on the input.  Null text counts as empty.  A very long text
is hashed SLICE_BYTES at a time.  Rows with a null id neither lose bytes nor
cause it, and go past the shards.  Rows that repeat an id are not smaller than
each other.  Other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, text_or_empty

LENGTH = 50
#: Bytes of the grams that anchors are chosen from.
K = 20
#: Text bytes of a block, blocks for each anchor range, and bytes whose hashes are held at once.
BLOCK_BYTES = 8 << 20
BLOCKS_A_RANGE = 4
SLICE_BYTES = 1 << 20
#: Text bytes of a shard: places must fit in 21 bits.
SHARD_BYTES = 1 << 20
#: Text bytes of the runs that a range works through at once.
PASS_BYTES = 16 << 20
#: Distinct runs of an anchor beyond which it is hot; blocks tell them as a power of two.
HOT_RUNS = 1 << 16
#: Strings of a run that are sent together at most.
MOST_RUN = 256
#: Bytes by which ranks start, and stretches of text in which common prefixes are found side by side.
FIRST = 4
LANES = 32768


# --- anchors


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each place on, by doubling."""

    def wider(h: np.ndarray, width: int, factor: int) -> np.ndarray:
        return h[:-width] * np.uint64(factor) + h[width:]

    h1 = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h1 ^= h1 >> np.uint64(29)
    h2 = wider(h1, 1, 0xBF58476D1CE4E5B9)
    h4 = wider(h2, 2, 0x94D049BB133111EB)
    h8 = wider(h4, 4, 0xD6E8FEB86659FD93)
    h16 = wider(h8, 8, 0xA0761D6478BD642F)
    n = len(data) - K + 1
    out = h16[:n] * np.uint64(0xE7037ED1A0B428DB) + h4[16 : 16 + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` neighbours from each place on."""
    have = 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (width - have)], h[width - have :]) if width > have else h


def anchor_runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over texts that end at ``ends`` in ``data``: start, number of strings, and anchor of each run of strings with one anchor."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = least_of(gram_hashes(data), length - K + 1)
    inside = np.ones(len(least) + 1, bool)
    inside[-1] = False
    for end in ends[ends < len(data) + length - 1]:
        inside[max(0, end - length + 1) : max(0, end)] = False
    change = np.ones(len(least) + 1, bool)
    change[1:-1] = (least[1:] != least[:-1]) | (inside[1:-1] != inside[:-2])
    at = np.flatnonzero(change)
    counts, at = np.diff(at), at[:-1]
    keep = inside[at]
    at, counts = at[keep], counts[keep]
    if len(counts) and counts.max() > MOST_RUN:
        pieces = -(-counts // MOST_RUN)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        total = np.repeat(counts, pieces)
        at, counts = np.repeat(at, pieces) + step * MOST_RUN, np.minimum(MOST_RUN, total - step * MOST_RUN)
    return at, counts, least[at]


class Block:
    """Texts of one block in a fixed order, joined, with their runs."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by([("_id", "ascending"), ("_text", "ascending")])
        self.ids = table.column("_id")
        texts = [x.encode() for x in table.column("_text").to_pylist()]
        self.ends = np.cumsum(np.array([len(x) for x in texts], np.int64))
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.doc_ids = np.array(self.ids.to_pylist(), np.int64)
        starts, counts, anchors, docs = [], [], [], []
        for offset in range(0, len(self.data), SLICE_BYTES):  # strings that start here, whatever texts they are of
            stop = min(len(self.data), offset + SLICE_BYTES + LENGTH - 1)
            first, last = np.searchsorted(self.ends, [offset + 1, stop], side="left")
            at, n, a = anchor_runs(self.data[offset:stop], self.ends[first : last + 1] - offset)
            starts.append(at + offset)
            counts.append(n)
            anchors.append(a)
            docs.append(np.searchsorted(self.ends, at + offset, side="right"))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.starts, self.counts, self.anchors, self.docs = join(starts, np.int64), join(counts, np.int64), join(anchors, np.uint64), join(docs, np.int64)


def range_of(anchors: np.ndarray, ranges: int) -> np.ndarray:
    """Anchors are minima, so mix them before they are dealt out."""
    mixed = anchors * np.uint64(0x9FB21C651E98DF25)
    return ((mixed >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; sizes first."""
    sizes = np.array([len(arrays), *(x.nbytes for x in arrays)], np.int64)
    return zstandard.compress(b"".join([sizes.tobytes(), *(x.tobytes() for x in arrays)]), 1)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(kinds), 8)
    at, out = 8 * (len(kinds) + 1), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _planes(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of sorted numbers, byte by byte."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).ravel()


def _from_planes(planes: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = planes.reshape(width, -1).T
    return out.view("<u8").ravel()


#: Bits of an anchor that are compared; a chance match only adds a candidate.
TAG_BYTES = 6
TAG = np.uint64((1 << 8 * TAG_BYTES) - 1)


def send_anchors(block: Block, ranges: int) -> list[tuple[int, bytes]]:
    """For each anchor range: the block's distinct anchors, sorted, whether two documents of the block hold each, and its runs as a power of two."""
    to = range_of(block.anchors, ranges)
    tags = block.anchors & TAG
    order = np.lexsort((block.docs, tags, to))
    to, tags, ids = to[order], tags[order], block.doc_ids[block.docs[order]]
    if not len(to):
        return []
    new = np.ones(len(to), bool)
    new[1:] = (to[1:] != to[:-1]) | (tags[1:] != tags[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(to)) - 1
    several = ids[first] != ids[last]
    power = np.ceil(np.log2(last - first + 1)).astype(np.uint8)
    to, tags = to[first], tags[first]
    cuts = np.searchsorted(to, np.arange(ranges + 1))
    return [(r, _pack(_planes(tags[a:b], TAG_BYTES), np.packbits(several[a:b]), power[a:b])) for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]


def find_shared(blobs: list[bytes], hot_runs: int = HOT_RUNS) -> list[bytes]:
    """For each blob, two rows of packed bits: is its anchor in two documents or more, and is it hot?"""
    each = [_unpack(x, "u1", "u1", "u1") for x in blobs]
    tags = [_from_planes(p, TAG_BYTES) for p, _, _ in each]
    own = [np.unpackbits(b, count=len(t)).astype(bool) for t, (_, b, _) in zip(tags, each, strict=True)]
    distinct, of, blocks = np.unique(np.concatenate(tags), return_inverse=True, return_counts=True)
    runs = np.bincount(of, weights=np.exp2(np.concatenate([p for _, _, p in each]).astype(float)), minlength=len(distinct))
    out, at = [], 0
    for t, several in zip(tags, own, strict=True):
        mine = of[at : at + len(t)]
        out.append(np.packbits(np.stack([several | (blocks[mine] > 1), runs[mine] > hot_runs]), axis=1).tobytes())
        at += len(t)
    return out


# --- runs of strings


def shared_runs(block: Block, answers: dict[int, bytes], ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs whose anchor two documents hold, and which of them are hot, by the answers to send_anchors."""
    to = range_of(block.anchors, ranges)
    tags = block.anchors & TAG
    keep, hot = np.zeros(len(to), bool), np.zeros(len(to), bool)
    order = np.lexsort((tags, to))
    cuts = np.searchsorted(to[order], np.arange(ranges + 1))
    for r, packed in answers.items():
        mine = order[cuts[r] : cuts[r + 1]]
        distinct, of = np.unique(tags[mine], return_inverse=True)
        bits = np.unpackbits(np.frombuffer(packed, np.uint8).reshape(2, -1), axis=1, count=len(distinct)).astype(bool)
        keep[mine], hot[mine] = bits[0][of], bits[1][of]
    runs = np.flatnonzero(keep)
    return runs, hot[runs]


class Routed:
    """Runs of a block in the order of the ranges that they go to: start, strings, document, and the number they go by.

    That is the anchor; of a hot anchor, whose runs are cut into single strings,
    the string's hash.
    """

    def __init__(self, block: Block, runs: np.ndarray, hot: np.ndarray, ranges: int) -> None:
        whole, apart = runs[~hot], runs[hot]
        counts = block.counts[apart]
        single = spread(block.starts[apart], counts)
        starts = np.concatenate([block.starts[whole], single])
        self.block = block
        keys = np.concatenate([block.anchors[whole], string_hashes(block.data, single)])
        to = range_of(keys, ranges)
        order = np.argsort(to, kind="stable")
        self.starts, self.keys = starts[order], keys[order]
        self.counts = np.concatenate([block.counts[whole], np.ones(len(single), np.int64)])[order]
        self.docs = np.concatenate([block.docs[whole], np.repeat(block.docs[apart], counts)])[order]
        to = to[order]
        self.ranges = np.unique(to)  # those that have runs
        self.cuts = np.append(np.searchsorted(to, self.ranges), len(to))

    def of(self, r: int) -> slice:
        place = int(np.searchsorted(self.ranges, r))
        return slice(int(self.cuts[place]), int(self.cuts[place + 1]))


def string_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of the LENGTH bytes from each start on."""
    out = np.zeros(len(starts), np.uint64)
    words = np.zeros(-(-LENGTH // 8) * 8, np.uint8)
    for at in range(0, len(starts), SLICE_BYTES // 16):
        own = starts[at : at + SLICE_BYTES // 16]
        padded = np.tile(words, (len(own), 1))
        padded[:, :LENGTH] = data[own[:, None] + np.arange(LENGTH)[None, :]]
        mixed = np.zeros(len(own), np.uint64)
        for column in padded.view("<u8").T:
            mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        out[at : at + len(own)] = mixed
    return out


def distinct_runs(routed: Routed) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
    """For each run, its number within its range, and for each range the distinct runs:
    bytes, strings in each, bits of the number they go by, and least and greatest id that holds it."""
    block, whole = routed.block, routed.block.data.tobytes()
    numbers, out = np.zeros(len(routed.starts), np.int64), []
    for r in routed.ranges.tolist():
        mine = routed.of(r)
        known: dict[bytes, int] = {}
        kept: list[int] = []
        for i, (start, count) in enumerate(zip(routed.starts[mine].tolist(), routed.counts[mine].tolist(), strict=True), mine.start):
            number = known.setdefault(whole[start : start + count + LENGTH - 1], len(known))
            if number == len(kept):
                kept.append(i)
            numbers[i] = number
        ids = block.doc_ids[routed.docs[mine]]
        low, high = np.full(len(kept), np.iinfo(np.int64).max), np.full(len(kept), np.iinfo(np.int64).min)
        np.minimum.at(low, numbers[mine], ids)
        np.maximum.at(high, numbers[mine], ids)
        out.append((r, _pack(np.frombuffer(b"".join(known), np.uint8), routed.counts[kept].astype("<u2"), (routed.keys[kept] >> np.uint64(32)).astype("<u4"), low, high)))
    return numbers, out


# --- suffix arrays


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Places of ``data`` in the order of their suffixes; what is past the end is least.

    Larsson and Sadakane's refinement: a place's rank is where its group of
    equals starts; doubling compares the rank ``h`` places on; only groups of
    several are sorted again.  Rank, next rank and place share one 63-bit key.
    """
    n = len(data)
    if n >= (1 << 21) - 1:
        raise ValueError("a shard has fewer than 2**21 bytes")
    place = np.uint64(21)
    low = np.uint64((1 << 21) - 1)
    wide = np.zeros(n + FIRST, np.uint64)
    wide[:n] = data
    wide[:n] += np.uint64(1)  # 0 is past the end
    key = wide[:n].copy()
    for k in range(1, FIRST):
        key = key << np.uint64(9) | wide[k : n + k]
    key = np.sort(key << place | np.arange(n, dtype=np.uint64))
    order = (key & low).astype(np.int64)
    start = np.ones(n, bool)
    start[1:] = key[1:] >> place != key[:-1] >> place
    first = np.flatnonzero(start)
    slot_rank = np.repeat(first, np.diff(np.append(first, n)))
    rank = np.zeros(n + 1, np.int64)
    rank[order] = slot_rank + 1  # 0 is past the end
    h = FIRST
    slots = np.flatnonzero(~(start & np.append(start[1:], True)))
    while len(slots):
        at = order[slots]
        key = np.sort(rank[at].astype(np.uint64) << np.uint64(42) | rank[np.minimum(at + h, n)].astype(np.uint64) << place | at.astype(np.uint64))
        at = (key & low).astype(np.int64)
        order[slots] = at
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] >> place != key[:-1] >> place
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(slots)))
        rank[at] = np.repeat(slots[first], sizes) + 1
        slots = slots[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, lanes: int = LANES) -> np.ndarray:
    """For each slot, the bytes, up to ``most``, that its suffix shares with the slot before.

    Kasai: going one place on in the text loses one byte at most.  The text is
    cut into stretches that go on side by side; each step compares 8 bytes.
    """
    n = len(data)
    padded = np.zeros(n + most + 16, np.uint8)
    padded[:n] = data
    words = np.zeros(n + most + 8, np.uint64)
    for k in range(8):
        words |= padded[k : k + len(words)].astype(np.uint64) << np.uint64(8 * k)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    lanes = max(1, min(lanes, n // 32))
    stretch = -(-n // lanes)
    base = np.arange(lanes) * stretch
    shared = np.zeros(n, np.int64)
    h = np.zeros(lanes, np.int64)
    for step in range(stretch):
        live = np.flatnonzero((at := base + step) < n)
        i = at[live]
        j = before[i]
        own = np.maximum(h[live] - 1, 0)
        own[j < 0] = 0
        going = np.flatnonzero((j >= 0) & (own < most))
        while len(going):
            differ = words[i[going] + own[going]] ^ words[j[going] + own[going]]
            lowest = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.bitwise_count(lowest - np.uint64(1)) >> 3)
            own[going] += same
            going = going[(same == 8) & (own[going] < most)]
        own = np.minimum(own, np.minimum(most, n - np.maximum(i, j)))
        h[live] = own
        shared[i] = own
    out = shared[order]
    return out


class Shard:
    """Distinct runs side by side; the strings of LENGTH bytes in them, in groups of equals by suffix order."""

    def __init__(self, texts: list[bytes], lows: np.ndarray) -> None:
        self.sizes = np.array([len(x) for x in texts], np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        run = np.repeat(np.arange(len(texts)), self.sizes)
        ends = np.cumsum(self.sizes)
        valid = np.arange(len(self.data)) + LENGTH <= ends[run]
        order = suffix_array(self.data)  # in full, as Kasai's rule needs it
        shared = common_prefixes(self.data, order, LENGTH)
        group = np.cumsum(shared < LENGTH)
        kept = valid[order]
        self.places, group = order[kept], group[kept]
        self.firsts = np.flatnonzero(np.diff(group, prepend=-1))
        self.lows = np.minimum.reduceat(lows[run[self.places]], self.firsts) if len(self.places) else np.zeros(0, np.int64)

    def strings(self) -> np.ndarray:
        """A group's string as numbers that sort like it (groups x 7)."""
        at = self.places[self.firsts]
        padded = np.zeros((len(at), 56), np.uint8)
        padded[:, :LENGTH] = self.data[at[:, None] + np.arange(LENGTH)[None, :]]
        return padded.view(">u8").astype(np.uint64)

    def least(self) -> np.ndarray:
        """For each byte, the least id of the string that starts there; the largest number where none does."""
        out = np.full(len(self.data), np.iinfo(np.int64).max)
        sizes = np.diff(np.append(self.firsts, len(self.places)))
        out[self.places] = np.repeat(self.lows, sizes)
        return out


def search(rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted string in sorted ``rows``, or -1, by binary search."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(rows), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        differ = rows[mid] != wanted[open_]
        word = differ.argmax(axis=1)
        at = np.arange(len(open_))
        less = rows[mid, word] < wanted[open_][at, word]
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]
    found = np.minimum(low, max(len(rows) - 1, 0))
    return np.where((low < len(rows)) & (rows[found] == wanted).all(axis=1), found, -1) if len(rows) else np.full(len(wanted), -1)


def merge_shards(shards: list[Shard]) -> None:
    """Give equal strings of different shards the least id of all, by binary search of each in the ones before."""
    if len(shards) < 2:
        return
    strings = [s.strings() for s in shards]
    met = []
    for i, later in enumerate(shards):
        for j, earlier in enumerate(shards[:i]):
            at = search(strings[j], strings[i])
            mine = np.flatnonzero(at >= 0)
            met.append((i, mine, j, at[mine]))
            least = np.minimum(later.lows[mine], earlier.lows[at[mine]])
            later.lows[mine] = least
    for i, mine, j, at in reversed(met):  # the last shard's ids are complete, so they go back
        shards[j].lows[at] = np.minimum(shards[j].lows[at], shards[i].lows[mine])


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each pair of start and count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def least_ids(texts: list[bytes], tags: np.ndarray, lows: np.ndarray, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """For each byte of the distinct runs, side by side, the least id of the string that starts there."""
    order = np.argsort(tags, kind="stable")
    all_sizes = np.array([len(x) for x in texts], np.int64)
    begins = np.cumsum(all_sizes) - all_sizes
    out = np.zeros(all_sizes.sum(), np.int64)
    sizes = all_sizes[order]
    # cut where the anchor changes, if it can be; shards of one anchor are merged
    groups: list[list[list[int]]] = []
    shard: list[int] = []
    held = 0
    changes = [*np.flatnonzero(np.diff(tags[order], prepend=-1)).tolist(), len(order)]
    totals = np.add.reduceat(sizes, changes[:-1]).tolist() if len(order) else []
    for a, b, total in zip(changes, changes[1:], totals, strict=False):
        if held + total > shard_bytes and shard:
            groups.append([shard])
            shard, held = [], 0
        if total > shard_bytes:
            groups.append([order[a + i : a + j].tolist() for i, j in slices(sizes[a:b].tolist(), shard_bytes)])
        else:
            shard += order[a:b].tolist()
            held += total
    if shard:
        groups.append([shard])
    for group in groups:
        shards = [Shard([texts[i] for i in members], lows[members]) for members in group]
        merge_shards(shards)
        for members, own in zip(group, shards, strict=True):
            out[spread(begins[members], own.sizes)] = own.least()
    return out


def answer_runs(blobs: list[bytes], shard_bytes: int = SHARD_BYTES, pass_bytes: int = PASS_BYTES) -> list[bytes]:
    """For each blob of distinct_runs: stretches (run, offset, strings, least id) whose least id is below the run's greatest.

    Runs are worked through in passes by anchor, so that one pass's runs are held at a time.
    """
    passes = max(1, -(-sum(zstandard.get_frame_parameters(x).content_size for x in blobs) // pass_bytes))
    parts: list[list[tuple[np.ndarray, ...]]] = [[] for _ in blobs]
    for turn in range(passes):
        known: dict[bytes, int] = {}
        tags, lows, of = [], [], []
        for blob in blobs:
            data, counts, tag, low, high = _unpack(blob, "u1", "<u2", "<u4", "i8", "i8")
            sizes = counts.astype(np.int64) + LENGTH - 1
            ends = np.cumsum(sizes)
            chosen = np.flatnonzero(tag % passes == turn)
            raw, mine = data.tobytes(), []
            for start, end, t, least in zip((ends - sizes)[chosen].tolist(), ends[chosen].tolist(), tag[chosen].tolist(), low[chosen].tolist(), strict=True):
                number = known.setdefault(raw[start:end], len(tags))
                if number == len(tags):
                    tags.append(t)
                    lows.append(least)
                elif least < lows[number]:
                    lows[number] = least
                mine.append(number)
            of.append((chosen, np.array(mine, np.int64), high[chosen]))
        if not tags:
            continue
        texts = list(known)
        least = least_ids(texts, np.array(tags, np.int64), np.array(lows, np.int64), shard_bytes)
        sizes = np.array([len(x) for x in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        strings = sizes - LENGTH + 1
        least = least[spread(begins, strings)]
        run = np.repeat(np.arange(len(texts)), strings)
        change = np.ones(len(least), bool)
        change[1:] = (least[1:] != least[:-1]) | (run[1:] != run[:-1])
        first = np.flatnonzero(change)
        lengths = np.diff(np.append(first, len(least)))
        run, least = run[first], least[first]
        offsets = first - (np.cumsum(strings) - strings)[run]
        cuts = np.searchsorted(run, np.arange(len(texts) + 1))
        for place, (chosen, mine, high) in enumerate(of):
            n = cuts[mine + 1] - cuts[mine]
            at = spread(cuts[mine], n)
            keep = least[at] < np.repeat(high, n)
            at = at[keep]
            parts[place].append((np.repeat(chosen, n)[keep], offsets[at], lengths[at], least[at]))
    out = []
    for own in parts:
        run, offset, count, low = (np.concatenate([x[k] for x in own]) if own else np.zeros(0, np.int64) for k in range(4))
        order = np.argsort(run, kind="stable")
        out.append(_pack(run[order].astype("<u4"), offset[order].astype("<u4"), count[order].astype("<u4"), low[order]))
    return out


# --- the operator


def remove(routed: Routed, numbers: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
    """For each byte of the block: is it to go?"""
    block = routed.block
    depth = np.zeros(len(block.data) + 1, np.int32)
    for r, blob in answers.items():
        run, offset, count, low = _unpack(blob, "<u4", "<u4", "<u4", "i8")
        if not len(run):
            continue
        mine = routed.of(r)
        first, last = np.searchsorted(run, numbers[mine]), np.searchsorted(run, numbers[mine], side="right")
        n = last - first
        own = np.repeat(np.arange(mine.start, mine.stop), n)
        at = spread(first, n)
        goes = low[at] < block.doc_ids[routed.docs[own]]
        own, at = own[goes], at[goes]
        start = routed.starts[own] + offset[at]
        np.add.at(depth, start, 1)
        np.add.at(depth, start + count[at] + LENGTH - 1, -1)
    return np.cumsum(depth[:-1]) > 0


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hot_runs: int = HOT_RUNS) -> DataFrame:
    """``id_col``, n_bytes, n_removed, n_spans, kept (binary) of each row.  ``id_col`` is an integer."""
    id_type = df.schema[id_col].dataType.simpleString()
    given = df.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    rows = given.filter("_id is not null")
    total = rows.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    ranges = max(1, -(-blocks // BLOCKS_A_RANGE))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int"))

    def anchors(table: pa.Table) -> pa.Table:
        sent = send_anchors(Block(table), ranges)
        return pa.table({"_range": pa.array([r for r, _ in sent], pa.int32()), "_block": pa.array([table.column("_block")[0].as_py()] * len(sent), pa.int32()), "blob": pa.array([b for _, b in sent], pa.binary())})

    def shared(table: pa.Table) -> pa.Table:
        return table.set_column(2, "blob", pa.array(find_shared(table.column("blob").to_pylist(), hot_runs), pa.binary()))

    def answered(table: pa.Table) -> dict[int, bytes]:
        return dict(zip(table.column("_range").to_pylist(), table.column("blob").to_pylist(), strict=True))

    def runs_of(texts: pa.Table, flags: pa.Table) -> tuple[Routed, np.ndarray, list[tuple[int, bytes]]]:
        block = Block(texts)
        routed = Routed(block, *shared_runs(block, answered(flags), ranges), ranges)
        return routed, *distinct_runs(routed)

    def cut(texts: pa.Table, flags: pa.Table) -> pa.Table:
        sent = runs_of(texts, flags)[2] if texts.num_rows else []
        here = texts.column("_block")[0].as_py() if texts.num_rows else None
        return pa.table({"_range": pa.array([r for r, _ in sent], pa.int32()), "_block": pa.array([here] * len(sent), pa.int32()), "blob": pa.array([b for _, b in sent], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        return table.set_column(2, "blob", pa.array(answer_runs(table.column("blob").to_pylist()), pa.binary()))

    def finish(texts: pa.Table, back: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return done.empty_table()
        kind = back.column("kind").to_pylist()
        pick = lambda k: back.filter(pa.array([x == k for x in kind], pa.bool_()))
        routed, numbers, _ = runs_of(texts, pick("anchors"))
        block, gone = routed.block, remove(routed, numbers, answered(pick("runs")))
        out, start = [], 0
        for end in block.ends.tolist():
            own = gone[start:end]
            spans = int(own[:1].sum()) + int((own[1:] & ~own[:-1]).sum())
            out.append((end - start, int(own.sum()), spans, block.data[start:end][~own].tobytes()))
            start = end
        columns = list(zip(*out, strict=True))
        return pa.Table.from_arrays([block.ids.combine_chunks() if isinstance(block.ids, pa.ChunkedArray) else block.ids, *(pa.array(c, f.type) for c, f in zip(columns, list(done)[1:], strict=True))], schema=done)

    done = pa.schema([("_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    routed = "_range int, _block int, blob binary"
    by_block = dealt.groupBy("_block")  # one exchange of the texts, which all three steps read
    flags = by_block.applyInArrow(anchors, routed).groupBy("_range").applyInArrow(shared, routed)
    found = by_block.cogroup(flags.groupBy("_block")).applyInArrow(cut, routed).groupBy("_range").applyInArrow(answer, routed)
    back = flags.withColumn("kind", F.lit("anchors")).unionByName(found.withColumn("kind", F.lit("runs")))
    out = by_block.cogroup(back.groupBy("_block")).applyInArrow(finish, "_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    past = given.filter("_id is null").select("_id", F.octet_length("_text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("_text").cast("binary").alias("kept"))
    return out.unionByName(past).withColumn("_id", F.col("_id").cast(id_type)).withColumnRenamed("_id", id_col)


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The same by a dictionary of all strings, for tests; ids are distinct."""
    least: dict[bytes, int] = {}
    raw = {i: (text or "").encode() for i, text in rows}
    for i in sorted(raw):
        for at in range(len(raw[i]) - length + 1):
            least.setdefault(raw[i][at : at + length], i)
    out = {}
    for i, data in raw.items():
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            if least[data[at : at + length]] < i:
                gone[at : at + length] = b"\1" * length
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        out[i] = len(data), sum(gone), gone.count(b"\0\1") + (gone[:1] == b"\1"), hashlib.sha256(kept).hexdigest()
    return out


QUERIES = {"op2_suffix": op2_suffix}
