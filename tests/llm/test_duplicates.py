"""SimHash and suffix arrays against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cartoflow.llm import components, simhash, suffix


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, near):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprint():
    for text in (None, "", " \x0b\x1c ", "One", "one TWO three", "É a b c D e", "a b c d " * 300, "x" * 5000):
        assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def near_copies(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((3, 40, 300)))]
        out.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            out.append(" ".join(copy))
    return out


def test_components_against_brute_force(spark):
    texts = [None, "", *near_copies(40, 1), "last one", "last one"]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    expected = classes(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    assert [got[i].component_id for i in range(len(texts))] == expected
    kept = {r.doc_id for r in simhash.representatives(df).collect()}
    assert kept == set(expected)


@pytest.mark.parametrize("most_block", [4096, 2])
def test_links_of_crowded_fingerprints(spark, most_block):
    """Chains of small steps, and blocks that are too large for comparing all."""
    rng, values = random.Random(2), set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            values.add(x)
            for _ in range(rng.choice((1, 3, 4, 5))):
                x ^= 1 << rng.randrange(64)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    ends = components.stars(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), most_block))
    root = {r.u: r.v for r in ends.collect()}
    got = {}
    for v in signed:
        got.setdefault(root.get(v, v), set()).add(v)
    expected = {}
    for v, c in zip(signed, classes(values, lambda a, b: (a ^ b).bit_count() <= 4), strict=True):
        expected.setdefault(c, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_long_chain_of_edges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    assert {r.u: r.v for r in components.stars(edges).collect()} == {i: 0 for i in range(1, 61)} | {101: 100}


def test_simhash_on_nothing_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (5, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(df).collect()) == [(0, 3), (3, 3), (3, 3), (5, 5)]
    assert simhash.near_duplicates(df.limit(0)).collect() == []
    assert sorted((r.doc_id or 0) for r in simhash.representatives(df).collect()) == [0, 3, 5]


def test_one_row_of_each_group_whatever_its_id(spark):
    one, two, three = ("alpha beta gamma delta epsilon", "quick brown foxes jump over lazy dogs", "lorem ipsum dolor sit amet tempor")
    assert min((simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() if a != b else 64 for a in (one, two, three) for b in (one, two, three)) > simhash.MOST_BITS
    df = spark.createDataFrame([(7, one), (7, two), (8, two), (9, one)] + [(None, three)] * 50, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in simhash.representatives(df).collect())
    assert got == sorted([(7, one), (7, two), (0, three)])


# --- suffix arrays


@pytest.mark.parametrize("n", [1, 2, 7, 200, 2500])
def test_suffix_array(n):
    rng = random.Random(n)
    data = bytes(rng.choice(b"ab\0c") for _ in range(n))
    order = suffix.suffix_array(np.frombuffer(data, np.uint8))
    expected = sorted(range(n), key=lambda i: data[i:])
    assert order.tolist() == expected

    def shared(i, j):
        k = 0
        while k < 50 and max(i, j) + k < n and data[i + k] == data[j + k]:
            k += 1
        return k

    got = suffix.common_prefixes(np.frombuffer(data, np.uint8), order, 50)
    assert got.tolist()[1:] == [shared(expected[i - 1], expected[i]) for i in range(1, n)]


def passages(n, seed):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdef é") for _ in range(rng.randrange(20, 140))) for _ in range(12)] + ["ab" * 120, "\0" * 300, "q" * 400]
    return ["".join(rng.choice((rng.choice(stock), "".join(rng.choice("ghijkl ") for _ in range(rng.randrange(60))))) for _ in range(rng.randrange(8))) for _ in range(n)]


@pytest.mark.parametrize(("block_bytes", "hot_runs"), [(8 << 20, suffix.HOT_RUNS), (4000, suffix.HOT_RUNS), (4000, 1), (4000, 20)])
def test_removal_against_brute_force(spark, block_bytes, hot_runs):
    rows = [(i * 37 % 211, t) for i, t in enumerate([None, "", *passages(120, 3)])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_bytes string")
    got = {r.doc_id: tuple(r)[1:] for r in suffix.dedup(df, block_bytes=block_bytes, hot_runs=hot_runs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}
    assert got == suffix.brute_force(rows)


def test_small_shards_and_passes_are_merged():
    """One anchor whose runs fill many shards, and many passes: the answers stay the same."""
    texts = passages(80, 4)
    import pyarrow as pa

    table = pa.table({"_id": pa.array(range(80), pa.int64()), "_text": pa.array(texts)})
    block = suffix.Block(table)
    sent = suffix.send_anchors(block, 1)
    flags = {r: suffix.find_shared([b])[0] for r, b in sent}
    _, out = suffix.distinct_runs(suffix.Routed(block, *suffix.shared_runs(block, flags, 1), 1))
    whole = suffix.answer_runs([out[0][1]])
    assert suffix.answer_runs([out[0][1]], shard_bytes=300) == whole
    assert suffix.answer_runs([out[0][1]], pass_bytes=2000) == whole


def test_slices_of_long_texts(monkeypatch):
    """What a block finds does not depend on where its bytes are cut."""
    import pyarrow as pa

    table = pa.table({"_id": pa.array(range(60), pa.int64()), "_text": pa.array(passages(60, 6))})

    def strings():
        b = suffix.Block(table)
        return sorted((s + k, int(a), int(d)) for s, n, a, d in zip(b.starts, b.counts, b.anchors, b.docs, strict=True) for k in range(n))

    whole = strings()
    for size in (50, 64, 333):
        monkeypatch.setattr(suffix, "SLICE_BYTES", size)
        assert strings() == whole


def test_crowded_blocks_in_parts():
    """Pairs of one block's parts tie what the whole block does; copies around a leader, chains and strangers."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    near = [b ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j)) for b in base for i in range(20) for j in range(i)]
    fps = np.unique(np.concatenate([np.array(near, np.uint64), rng.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    u, v = simhash.close_pairs(np.zeros(len(fps), np.int64), fps)
    place = {int(x): i for i, x in enumerate(fps)}
    got = simhash.components_of(len(fps), np.array([place[int(x)] for x in u]), np.array([place[int(x)] for x in v]))
    expected = classes([int(x) for x in fps], lambda a, b: (a ^ b).bit_count() <= 4)
    assert got.tolist() == expected


def test_repeated_and_null_ids(spark):
    text = "".join(random.Random(5).choice("abcdefgh ") for _ in range(200))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in suffix.dedup(df).collect())
    assert got == [(0, 0, 0), (1, 0, 0), (1, 0, 0), (2, 200, 1)]
    assert suffix.dedup(df.limit(0)).collect() == []
