"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine names none (tests), a temporary folder is made once; on a cluster
    it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="tessera-")
    return _own_dirs[app]


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage: a lost executor costs a re-read and no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path, None
    return out


def write_bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """The same, bucketed by ``key``: groups and joins by it read their buckets without a shuffle.

    For contents that are compressed already.
    """
    spark = df.sparkSession
    name = f"tessera_{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "uncompressed").saveAsTable(name)
    out = spark.table(name)
    out._written = path, name
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        spark, (path, name) = df.sparkSession, df._written
        if name:
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut a list into runs of about ``most`` in size."""
    start = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def slices(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Runs of about ``most`` characters, whole texts each."""
    return runs([len(t) for t in texts], most)


class Covered:
    """Spans (kind, start, end) of a text, overlaps allowed, asked for in logarithmic time."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        pairs = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in pairs]
        self.ends = list(accumulate((b for _, b in pairs), max))

    def meets(self, a: int, b: int) -> bool:
        """Whether a span shares a place with a..b."""
        i = bisect_left(self.starts, b)
        return i > 0 and self.ends[i - 1] > a

    def holds(self, a: int, b: int) -> bool:
        """Whether one span covers all of a..b."""
        i = bisect_right(self.starts, a)
        return i > 0 and self.ends[i - 1] >= b


def map_texts(
    df: DataFrame,
    schema: str,
    make: Callable[[], Callable[[list[str]], dict]],
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    most: int = 1_000_000,
) -> DataFrame:
    """Run ``make()``'s function over whole texts, a bounded number of characters at a time.

    The function gets a list of texts (null reads as empty) and returns one list or array for
    each column of ``schema`` that is not in ``keep``. ``make`` runs once in each task.
    Other columns of ``df`` are pruned before they reach Python. Arrow batches are bounded in bytes
    by the session (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set).
    """
    kinds = {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(schema))}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fn = fn or make()
            sizes = pc.fill_null(pc.binary_length(batch.column(len(keep))), 0).to_pylist()
            for i, j in runs(sizes, most):
                got = fn([t or "" for t in batch.column(len(keep)).slice(i, j - i).to_pylist()])
                cols = [batch.column(k).slice(i, j - i) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    cols + [pa.array(v, kinds[n]) for n, v in got.items()],
                    names=[*keep, *got],
                )

    return df.select(*keep, F.col(text)).mapInArrow(run, schema)


def crc_bucket(col: str, n: int):
    """crc32 of an id's decimal text, mod ``n``; null ids go to bucket -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n)), F.lit(-1))
