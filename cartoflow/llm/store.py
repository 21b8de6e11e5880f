"""Token ids in a content-addressed store.

Each document's ids, an end id last, are cut into chunks where a rolling hash
of the last WINDOW ids says so.  A chunk is stored once under its digest; a
recipe lists a document's digests and lengths; a Merkle root over the digests
stands in the recipe, and a root over a file's recipes in its manifest.

File format: Parquet tables below one folder of the shared storage.
``staged/kind=chunk``: key (BLAKE2b-128), payload (ids, little-endian, 2 bytes
each if the vocabulary allows, else 4).  ``index/kind=recipe``, in ascending id
order (nulls first): id, n_tokens, root, entries (digest and id count, 20 bytes
a chunk), part and local_start.  ``index/kind=manifest``: a row a part.

Reading back checks every payload against its digest and every recipe against
its root.  A document's CRC is put together from its chunks' CRCs, each shifted
by the bytes that follow it, so payloads are not gathered by document.

The strings of the vocabulary's added tokens become their ids wherever they
stand in a text, as the library has it; add_special_tokens=False only keeps it
from adding some of its own.

Null and empty text: the end id alone.  A very long text is encoded by itself;
its ids are held once.  Repeated rows each get their row and place, rows of one
id in the order of the table; columns other than the two named are left out; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, new_folder, slices
from .pretok import pretokens

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Ids that the rolling hash sees, mean chunk length in ids, and the most; pre-tokens that a Python worker remembers, about.
WINDOW = 4
MEAN_CHUNK = 128
MOST_CHUNK = 1024
REMEMBERED = 1_200_000
BATCH_CHARS = 1_000_000
DIGEST = 16
INDEX = "id {}, n_tokens long, root binary, entries binary, _row long, part int, local_start long, kind string"
ENTRY = np.dtype([("digest", f"V{DIGEST}"), ("n", "<u4")])


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Known(dict):
    """Ids of pre-tokens as bytes; one that is not there comes from ``older`` or from the library's model, and stays."""

    def __init__(self, model, units: list[bytes], older: dict[str, bytes]) -> None:
        super().__init__()
        self.ask, self.units, self.older, self.letters = model.tokenize, units, older, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            units = self.units
            found = b"".join([units[t.id] for t in self.ask(piece.encode().decode("latin-1").translate(self.letters))])
        self[piece] = found
        return found


class Encoder:
    """The tokenizers library's model, asked for each distinct pre-token once: it encodes pre-tokens on their own anyway.
    Texts with an added token's string go to the library as they are."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = library = Tokenizer.from_file(path)
        self.added = [t.content for t in library.get_added_tokens_decoder().values()]
        size = max(library.get_vocab_size(), END_ID + 1, *(i + 1 for i in library.get_vocab().values()))
        self.width = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.units = [i.to_bytes(self.width.itemsize, "little") for i in range(size)]
        self.known = Known(library.model, self.units, {})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED // 2:
            older, self.known.older = self.known, {}
            self.known = Known(self.library.model, self.units, older)
        out, end, ids_of = [], self.units[END_ID], self.known.__getitem__
        for text in texts:
            if any(t in text for t in self.added):  # the library matches them before all else
                ids = self.library.encode(text, add_special_tokens=False).ids
                out.append(np.array([*ids, END_ID], self.width))
                continue
            out.append(np.frombuffer(b"".join([*map(ids_of, pretokens(text)), end]), self.width))
        return out


@cache
def encoder(path: str | None) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return Encoder(path)


def cuts(ids: np.ndarray) -> np.ndarray:
    """Ends of the chunks: after an id where the rolling hash of the last WINDOW ids is 0 modulo MEAN_CHUNK, or MOST_CHUNK ids on."""
    if not len(ids):
        return np.zeros(0, np.int64)
    mixed = ids.astype(np.uint32) * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    rolling = mixed.copy()
    for k in range(1, min(WINDOW, len(ids))):
        rolling[k:] += mixed[:-k] * np.uint32(pow(0x85EBCA6B, k, 1 << 32))
    ends = np.flatnonzero((rolling >> np.uint32(20)) % np.uint32(MEAN_CHUNK) == 0) + 1
    if not len(ends) or ends[-1] != len(ids):
        ends = np.append(ends, len(ids))
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > MOST_CHUNK:
        ends = np.concatenate([np.append(np.arange(e - g + MOST_CHUNK, e, MOST_CHUNK), e) if g > MOST_CHUNK else [e] for e, g in zip(ends, gaps, strict=True)])
    return ends


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=DIGEST).digest()


def merkle(leaves: bytes) -> bytes:
    """Root over digests side by side; an odd one moves up as it is; of none, the digest of nothing."""
    level = leaves or digest(b"")
    while len(level) > DIGEST:
        pairs = [level[i : i + 2 * DIGEST] for i in range(0, len(level), 2 * DIGEST)]
        level = b"".join([digest(b"\1" + x) if len(x) > DIGEST else x for x in pairs])
    return level


class Merkle:
    """The same root over digests that come one by one; holds a digest for each power of two."""

    def __init__(self) -> None:
        self.n, self.peaks = 0, []

    def add(self, leaf: bytes) -> None:
        self.n += 1
        self.peaks.append(leaf)
        for _ in range((self.n & -self.n).bit_length() - 1):
            right = self.peaks.pop()
            self.peaks[-1] = digest(b"\1" + self.peaks[-1] + right)

    def root(self) -> bytes:
        if not self.peaks:
            return digest(b"")
        out = self.peaks[-1]
        for left in reversed(self.peaks[:-1]):
            out = digest(b"\1" + left + out)
        return out


@cache
def _shifts() -> np.ndarray:
    """Tables (power, byte, value): what a CRC-32 becomes when 2 ** power zero bytes follow, byte by byte of the CRC."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    values = np.arange(256, dtype=np.uint32)
    first = np.stack([one, values, values << np.uint32(8), values << np.uint32(16)])
    out = [first]
    for _ in range(40):
        out.append(np.stack([_apply(out[-1], x) for x in out[-1]]))
    return np.stack(out)


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def shift(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """CRC-32s, each as a part of the CRC of its bytes and ``after`` more bytes."""
    crc, after = crc.astype(np.uint32), after.astype(np.int64)
    power = 0
    while after.any():
        odd = (after & 1).astype(bool)
        crc[odd] = _apply(_shifts()[power], crc[odd])
        after = after >> 1
        power += 1
    return crc


def _stage(df: DataFrame, id_col: str, text_col: str, path: str | None) -> DataFrame:
    """Chunks (key: digest, n: ids) and recipes (key: root, n: ids, payload: entries), a chunk once a task at most."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = encoder(path), set()
        for batch in batches:
            column = batch.column(2)
            for start, end in slices((x or 0 for x in pa.compute.binary_length(column).to_pylist()), BATCH_CHARS):
                rows, keys, counts, payloads, recipes = [], [], [], [], []
                for i, ids in enumerate(own.encode([x or "" for x in column.slice(start, end - start).to_pylist()])):
                    data, size, ends, at, leaves = ids.tobytes(), ids.itemsize, cuts(ids).tolist(), 0, []
                    for stop in ends:
                        payload = data[at * size : stop * size]
                        key = digest(payload)
                        leaves.append(key)
                        if key not in seen:
                            seen.add(key)
                            keys.append(key)
                            counts.append(stop - at)
                            payloads.append(payload)
                        at = stop
                    joined = b"".join(leaves)
                    entries = np.empty(len(leaves), ENTRY)
                    entries["digest"] = np.frombuffer(joined, f"V{DIGEST}")
                    entries["n"] = np.diff(ends, prepend=0)
                    rows.append(start + i)
                    recipes.append((merkle(joined), len(ids), entries.tobytes()))
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["chunk"] * n + ["recipe"] * len(rows)),
                        pa.array(keys + [r[0] for r in recipes], pa.binary()),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), batch.column(0).take(pa.array(rows)).cast(pa.int64())]),
                        pa.concat_arrays([pa.nulls(n, batch.column(1).type), batch.column(1).take(pa.array(rows))]),
                        pa.array(counts + [r[1] for r in recipes], pa.int64()),
                        pa.array(payloads + [r[2] for r in recipes], pa.binary()),
                    ],
                    names=["kind", "key", "_row", "_id", "n", "payload"],
                )

    return df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col)).mapInArrow(run, f"kind string, key binary, _row long, _id {id_type}, n long, payload binary")


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by a number made from the key, the last column: chunks once each, and all recipes; the number goes."""
    before, seen = None, set()  # of the last row's number
    for batch in batches:
        if not batch.num_rows:
            continue
        kinds, keys, numbers = batch.column(0), batch.column(1), batch.column(batch.num_columns - 1).to_numpy()
        same = np.append(numbers[0] == before, numbers[1:] == numbers[:-1])
        keep = ~same
        for i in np.flatnonzero(same).tolist():
            if i and not same[i - 1]:
                seen = {keys[i - 1].as_py()}
            if kinds[i].as_py() == "recipe" or keys[i].as_py() not in seen:
                keep[i] = True
                seen.add(keys[i].as_py())
        if not same[-1]:
            seen = {keys[batch.num_rows - 1].as_py()}
        before = numbers[-1]
        yield batch.filter(pa.array(keep)).drop_columns([batch.schema.names[-1]])


def write(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> None:
    """Encode ``df`` and write the store to ``folder``."""
    spark = df.sparkSession
    staged = _stage(df, id_col, text_col, path)
    # chunks meet by digest; recipes by row, so that neither a common chunk nor a common text gathers rows
    dealt = staged.withColumn("_number", F.when(F.col("kind") == "chunk", F.xxhash64("key")).otherwise(F.xxhash64("_row"))).repartition("_number").sortWithinPartitions("_number")
    dealt.mapInArrow(_first_of_each, staged.schema).write.options(compression="zstd", **{"parquet.compression.codec.zstd.level": "1", "parquet.enable.dictionary": "false"}).partitionBy("kind").parquet(f"{folder}/staged")

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Recipes with their places, then a manifest: root over the file's document roots, row count in _row."""
        from pyspark import TaskContext

        part, at, roots, names = TaskContext.get().partitionId(), 0, Merkle(), None
        for batch in batches:
            counts = np.array(batch.column(1).to_pylist(), np.int64)
            begin = at + np.cumsum(counts) - counts
            at += int(counts.sum())
            for x in batch.column(2).to_pylist():
                roots.add(x)
            names, id_type = batch.schema.names, batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(counts), part, np.int32)), pa.array(begin), pa.array(["recipe"] * len(counts))], names=[*names, "part", "local_start", "kind"])
        if names:
            row = [pa.nulls(1, id_type), pa.array([at], pa.int64()), pa.array([roots.root()], pa.binary()), pa.nulls(1, pa.binary()), pa.array([roots.n], pa.int64()), pa.array([part], pa.int32()), pa.array([0], pa.int64()), pa.array(["manifest"])]
            yield pa.RecordBatch.from_arrays(row, names=[*names, "part", "local_start", "kind"])

    recipes = spark.read.schema(staged.schema).parquet(f"{folder}/staged").filter("kind = 'recipe'").select(F.col("_id").alias("id"), F.col("n").alias("n_tokens"), F.col("key").alias("root"), F.col("payload").alias("entries"), "_row")
    dealt = recipes.repartitionByRange(F.col("id").asc_nulls_first(), F.col("_row")).sortWithinPartitions(F.col("id").asc_nulls_first(), "_row")
    dealt.mapInArrow(lay_out, INDEX.format(df.schema[id_col].dataType.simpleString())).write.partitionBy("kind").parquet(f"{folder}/index")


def check_manifests(recipes: DataFrame, manifests: DataFrame) -> list:
    """Manifest rows by part, after each has been held against the roots of its file's recipes, in order."""

    def roots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by part and place: the root of each part."""
        part, tree = None, Merkle()
        done = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([tree.root()], pa.binary()), pa.array([tree.n], pa.int64())], names=["part", "found", "rows"])
        for batch in batches:
            for p, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != part:
                    if tree.n:
                        yield done()
                    part, tree = p, Merkle()
                tree.add(root)
        if tree.n:
            yield done()

    ordered = recipes.select("part", "root", "local_start").repartition("part").sortWithinPartitions("part", "local_start")
    found = ordered.select("part", "root").mapInArrow(roots_of, "part int, found binary, rows long")
    rows = manifests.join(found, "part", "left").orderBy("part").collect()  # a row a file
    for r in rows:
        if r["found"] != r["root"] or r["rows"] != r["_row"]:
            raise ValueError(f"the recipes of file {r['part']} do not hold what its manifest says")
    return rows


def read(spark: SparkSession, folder: str, id_type: str = "bigint", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """``id_col``, start, n_tokens, ids_crc32, from the files alone; fails if a digest, root or manifest does not hold."""
    width = encoder(path).width
    staged = spark.read.schema(f"key binary, n long, payload binary, kind string, _id {id_type}, _row long").parquet(f"{folder}/staged")
    index = spark.read.schema(INDEX.format(id_type)).parquet(f"{folder}/index")
    recipes = index.filter("kind = 'recipe'")

    def check_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            crcs, ends = [], []
            wide = memoryview(np.frombuffer(b"".join(payloads), width).astype("<u4").tobytes())
            start = 0
            for key, payload in zip(keys, payloads, strict=True):
                if digest(payload) != key:
                    raise ValueError(f"chunk {key.hex()} does not hold what its digest says")
                end = start + len(payload) * 4 // width.itemsize
                crcs.append(zlib.crc32(wide[start:end]))
                ends.append(end)
                start = end
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64()), pa.array(np.diff(ends, prepend=0) // 4, pa.int64())], names=["key", "crc", "n_held"])

    def open_recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, roots, entries = (c.to_pylist() for c in batch.columns)
            for at in range(0, len(entries), 2000):
                keys, after, rows, held = [], [], [], []
                for i in range(at, min(at + 2000, len(entries))):
                    own = np.frombuffer(entries[i], ENTRY)
                    leaves = np.ascontiguousarray(own["digest"]).tobytes()
                    if merkle(leaves) != roots[i]:
                        raise ValueError("a recipe does not hold what its root says")
                    keys.append(leaves)
                    held.append(own["n"])
                    n = own["n"].astype(np.int64)
                    after.append(4 * (n.sum() - np.cumsum(n)))
                    rows.append(np.full(len(n), numbers[i]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.FixedSizeBinaryArray.from_buffers(pa.binary(DIGEST), sum(map(len, rows)), [None, pa.py_buffer(b"".join(keys))]).cast(pa.binary()), pa.array(np.concatenate(after)), pa.array(np.concatenate(held).astype(np.int64))], names=["_row", "key", "after", "n"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = shift(batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint32), batch.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc.astype(np.int64)), batch.column(3)], names=["_row", "crc", "n"])

    chunks = staged.filter("kind = 'chunk'").select("key", "payload").mapInArrow(check_chunks, "key binary, crc long, n_held long")
    opened = recipes.select("_row", "root", "entries").mapInArrow(open_recipes, "_row long, key binary, after long, n long")
    met = opened.join(chunks, "key").filter("n = n_held").select("_row", "crc", "after", "n").mapInArrow(put, "_row long, crc long, n long")
    whole = met.groupBy("_row").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("_found"))
    # added up on the driver: as many rows as there were range partitions
    sums, starts = 0, {}
    for r in check_manifests(recipes, index.filter("kind = 'manifest'").select("part", "n_tokens", "root", "_row")):
        starts[r["part"]] = sums
        sums += r["n_tokens"]
    offsets = spark.createDataFrame(list(starts.items()) or [(0, 0)], "part int, offset long")
    laid = recipes.select("id", "n_tokens", "_row", "part", "local_start").join(F.broadcast(offsets), "part")
    right = F.when(F.col("_found") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document's chunks are not all there")).cast("long"))
    return laid.join(whole, "_row", "left").select(F.col("id").alias(id_col), (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", right.alias("ids_crc32"))


def op9_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = new_folder(spark, "store")
    write(docs, folder)
    return read(spark, folder, docs.schema["doc_id"].dataType.simpleString())


QUERIES = {"op9_store": op9_store}
