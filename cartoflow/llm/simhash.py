"""Near-duplicates by SimHash, with pivot distance tables.

Fingerprints link at MOST_BITS or fewer differing bits.  Two such fingerprints
agree on GROUPS - MOST_BITS of GROUPS bit groups at least, so pairs are looked
for in blocks of equal bits there.  In a block, a table of Hamming distances to
PIVOTS reference fingerprints discards pairs whose largest coordinate
difference is over MOST_BITS (the distance cannot be smaller than that), and
the survivors are verified.  Within a block, what is already in one component is
not compared again: leaders (fingerprints of the block itself) tie the copies
around them first.  A block of more than MOST_BLOCK fingerprints is cut into
parts by hash, and every two parts meet in a task of their own, with the same
tables; no block's pairs are written out, only spanning edges.

Equal fingerprints are one node, whatever the number of their documents.

Null text counts as empty: no words, fingerprint zero.  Very long texts are
hashed in bounded steps.  Rows with a null id get a fingerprint and the
component of it.  Repeated rows each get their row; ties in ``representatives``
are told below; extra columns are left out, or travel as one struct, so their
names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import documents, each, map_texts, text_or_empty, written
from .components import stars

SHINGLE = 4
SEED = 42
MOST_BITS = 4
GROUPS = 7
#: Reference fingerprints, from a seeded generator.
PIVOTS = np.random.default_rng(SEED).integers(0, 1 << 64, 16, dtype=np.uint64)
#: Fingerprints of a part of a block; two parts meet in a task.
MOST_BLOCK = 4096
#: Leaders of a block, and the fingerprints from which on a block has them.
LEADERS = 8
LED = 64
#: Rows of a partition that are held at once.
HELD = 500_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits as a signed integer; a bit is 1 if it is set in over half the shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter((xxh64_intdigest(x, SEED) for x in joined), ">u8", n)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        bits += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id_col`` and fp (long) of each whole text."""
    return map_texts(df, each(lambda text: (fingerprint(text, shingle),)), "fp long", id_col, text_col)


def group_masks(groups: int = GROUPS, agree: int = GROUPS - MOST_BITS) -> list[int]:
    """Masks, signed, of every choice of ``agree`` of ``groups`` runs of bits."""
    ends = [64 * (g + 1) // groups for g in range(groups)]
    runs = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip([0, *ends], ends, strict=False)]
    masks = [sum(c) for c in combinations(runs, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def components_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node of each node's component, for edges a-b over nodes 0 to n - 1."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, up := label[label]):
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def close_pairs(keys: np.ndarray, fps: np.ndarray, most: int = MOST_BITS, held: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key: a spanning set (u, v) of the pairs within a run of one key that differ in ``most`` bits or fewer."""
    n = len(keys)
    if not n:
        return fps, fps
    table = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    nodes, of = np.unique(fps, return_inverse=True)
    label = np.arange(len(nodes))
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, n))
    run = np.repeat(np.arange(len(starts)), sizes)

    def tied(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return components_of(len(nodes), np.concatenate([label[moved], *a]), np.concatenate([moved, *b]))

    def open_rows() -> np.ndarray:
        """Rows of runs that are not one component yet."""
        own = label[of]
        return np.flatnonzero((np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts))[run])

    led = np.flatnonzero((sizes >= LED)[run])
    for _ in range(LEADERS if len(led) else 0):
        # the first row of each run that is in no leader's component yet
        first = np.full(len(starts), n)
        np.minimum.at(first, run[led], led)
        leader = first[run[led]]
        near = np.bitwise_count(fps[led] ^ fps[leader]) <= most
        label = tied([of[led[near]]], [of[leader[near]]])
        led = led[label[of[led]] != label[of[leader]]]
        if not len(led):
            break
    at, step, a_all, b_all, count = open_rows(), 1, [], [], 0
    while True:
        at = at[at + step < n]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        apart = label[of[at]] != label[of[at + step]]
        left = at[apart]
        right = left + step
        for p in range(len(PIVOTS)):
            near = np.abs(table[left, p] - table[right, p]) <= most
            left, right = left[near], right[near]
        near = np.bitwise_count(fps[left] ^ fps[right]) <= most
        a_all.append(of[left[near]])
        b_all.append(of[right[near]])
        count += int(near.sum())
        if count > max(held, len(nodes)):
            label = tied(a_all, b_all)
            a_all, b_all, count = [], [], 0
            at = np.intersect1d(at, open_rows(), assume_unique=True)
        step += 1
    label = tied(a_all, b_all)
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[moved]], nodes[moved]


def _link(batches: Iterator[pa.RecordBatch], most_block: int | None = MOST_BLOCK) -> Iterator[pa.RecordBatch]:
    """Of (key, fp) sorted by key: edges (u, v) of fingerprints; of a block that is too large, its rows as (fp, null, key)."""

    def out(u: np.ndarray, v: np.ndarray | None, key: np.ndarray | None = None) -> pa.RecordBatch:
        none = pa.nulls(len(u), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), none if v is None else pa.array(v.view(np.int64)), none if key is None else pa.array(key)], names=["u", "v", "key"])

    def work(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
        sizes = np.diff(np.append(starts, len(keys)))
        small = np.repeat((sizes > 1) & (sizes <= (most_block or len(keys))), sizes)
        u, v = close_pairs(keys[small], fps[small])
        if len(u):
            yield out(u, v)
        large = np.repeat(sizes > (most_block or len(keys)), sizes)
        if large.any():
            yield out(fps[large], None, keys[large])

    held_keys, held_fps, hot = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if hot is not None:  # the block that is being passed on goes on
            same = keys == hot
            if same.any():
                yield out(fps[same], None, keys[same])
                keys, fps = keys[~same], fps[~same]
            if len(keys):
                hot = None
        held_keys, held_fps = np.concatenate([held_keys, keys]), np.concatenate([held_fps, fps])
        if len(held_keys) >= HELD:
            last = np.searchsorted(held_keys, held_keys[-1])
            yield from work(held_keys[:last], held_fps[:last])
            held_keys, held_fps = held_keys[last:], held_fps[last:]
            if most_block and len(held_keys) > most_block:
                hot = held_keys[0]
                yield out(held_fps, None, held_keys)
                held_keys, held_fps = held_keys[:0], held_fps[:0]
    yield from work(held_keys, held_fps)


LINKED = "u long, v long, key long"


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "fp")


def part_pairs(hot: DataFrame, most_block: int = MOST_BLOCK) -> DataFrame:
    """(key, fp) of large blocks, dealt to a key for every two of the block's parts of about ``most_block`` fingerprints."""
    sizes = hot.groupBy("key").agg(F.ceil(F.count("*") / most_block).alias("parts"))
    placed = hot.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return met.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "fp")


def links(nodes: DataFrame, most_block: int = MOST_BLOCK) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs within MOST_BITS, over distinct fingerprints (column fp)."""
    block = lambda i, m: F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m)))
    keys: list[Column] = [block(i, m) for i, m in enumerate(group_masks())]
    rows = _dealt(nodes.select(F.explode(F.array(*keys)).alias("key"), "fp"))
    found = written(rows.mapInArrow(lambda batches: _link(batches, most_block), LINKED), "links")
    edges, hot = found.filter("v is not null").select("u", "v"), found.filter("v is null").select("key", F.col("u").alias("fp"))
    if not hot.head(1):
        return edges
    return edges.unionByName(_dealt(part_pairs(hot, most_block)).mapInArrow(lambda batches: _link(batches, None), LINKED).select("u", "v"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id_col``, fp and component_id, the smallest id reachable over links, of each row."""
    rows = written(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min(id_col).alias("first")), "nodes")
    ends = stars(links(nodes.select("fp")))
    tied = nodes.join(ends, nodes["fp"] == ends["u"], "left").select("fp", "first", F.coalesce("v", "fp").alias("root"))
    least = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    of = tied.join(least, "root").select("fp", "component_id")
    return rows.join(of, "fp").select(F.col(id_col), "fp", "component_id")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each component: the one of the smallest id, of equal ids the one of the least text hash,
    of rows equal in both the one whose other columns have the least hash.

    Components are of texts, so rows that share an id may be in several.  Rows
    with a null id are chosen among themselves, one of each component.
    """
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.md5(text_or_empty(text_col)).alias("key"), F.col(text_col).alias("text"))
    texts = written(fingerprints(rows, "key", "text").distinct(), "fingerprints")
    nodes = written(texts.select("fp").distinct(), "nodes")
    ends = stars(links(nodes))
    roots = nodes.join(ends, nodes["fp"] == ends["u"], "left").select("fp", F.coalesce("v", "fp").alias("root"))
    least = rows.groupBy("key", F.col("id").isNull().alias("none")).agg(F.min("id").alias("first"))
    of = least.join(texts.join(roots, "fp").select("key", "root"), "key")
    heads = written(of.groupBy("root", "none").agg(F.min(F.struct("first", F.col("key").alias("head"))).alias("b")).select("b.*"), "heads")
    chosen = rows.join(heads, rows["id"].eqNullSafe(heads["first"]) & (rows["key"] == heads["head"]), "left_semi")
    one = Window.partitionBy("id", "key").orderBy(F.xxhash64(F.to_json(F.col("row").dropFields(f"`{text_col}`"))))
    return chosen.withColumn("n", F.row_number().over(one)).filter("n = 1").select("row.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
