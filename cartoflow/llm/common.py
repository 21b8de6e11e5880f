"""Helpers that the operators share: shared storage, Arrow plumbing, text columns."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of text that are handled at once inside a Python task, in characters.
SLICE_CHARS = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one, in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    sc = spark.sparkContext
    made = sc._jsc.sc().getCheckpointDir()
    if not made.isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cartoflow-"))
        made = sc._jsc.sc().getCheckpointDir()
    return made.get()


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


#: This process' folder below each shared one; what it holds is deleted when the process ends.
_RUN = f"run-{uuid.uuid4().hex}"
_known: set[str] = set()


def new_folder(spark: SparkSession, name: str) -> str:
    run = f"{shared_folder(spark).rstrip('/')}/cartoflow/{_RUN}"
    if run not in _known:
        _known.add(run)
        sc = spark.sparkContext
        jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()

        def clean() -> None:
            with contextlib.suppress(Exception):  # the JVM may be gone
                at = jvm.org.apache.hadoop.fs.Path(run)
                at.getFileSystem(conf).delete(at, True)

        atexit.register(clean)
    return f"{run}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the table of ``written`` that nothing reads any more."""
    _delete(df.sparkSession, df._written_to)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def slices(lengths: Iterable[int], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Cut consecutive rows into runs (start, end) of about ``limit`` characters; a longer row stands alone."""
    start = end = total = 0
    for n in lengths:
        if end > start and total + n > limit:
            yield start, end
            start, total = end, 0
        end += 1
        total += n
    if end > start:
        yield start, end


def map_texts(df: DataFrame, per_slice: Callable[[list[str | None]], list[tuple]], schema: str, id_col: str = "doc_id", text_col: str = "text", limit: int = SLICE_CHARS) -> DataFrame:
    """``id_col`` and what ``per_slice`` makes of a run of whole texts (a tuple each), in one narrow pass over Arrow batches."""
    full = StructType.fromDDL(f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(full)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for start, end in slices((x or 0 for x in pa.compute.binary_length(column).to_pylist()), limit):
                made = zip(*per_slice(column.slice(start, end - start).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([ids.slice(start, end - start).cast(arrow.field(0).type), *(pa.array(c, arrow.field(i + 1).type) for i, c in enumerate(made))], schema=arrow)

    return df.select(id_col, text_col).mapInArrow(run, full)


def each(per_row: Callable[[str | None], tuple]) -> Callable[[list[str | None]], list[tuple]]:
    return lambda texts: [per_row(x) for x in texts]
