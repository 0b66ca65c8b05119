"""What the corpus operators share: staged tables, distributed prefix sums, words and shingles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set a local master, as in tests, gets a new one; on a
    cluster that is an error, as executors would write where nobody else can read."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = at.get() if at.isDefined() else None
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="granary-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet under the shared folder and read again: it cuts the lineage and
    survives lost executors. The files go by released(), or when the application ends; those of a killed one lie in
    the folder of its id."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/granary-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    heap_returned(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    out._staged_at = at
    return out


#: Bytes of the driver's heap that the last heap_returned() left, by application.
_LEFT: dict[str, int] = {}


def heap_returned(spark: SparkSession) -> None:
    """Has the driver's JVM give memory back that it has taken but doesn't need. Planning dozens of queries makes garbage, for which the
    JVM takes more and more heap, several times what it holds; only a full collection returns it. One runs when the heap has passed
    half its limit, and a quarter over what the last one left."""
    jvm = spark._jvm.java.lang.Runtime.getRuntime()
    app = spark.sparkContext.applicationId
    if jvm.totalMemory() > max(jvm.maxMemory() / 2, 1.25 * _LEFT.get(app, 0)):
        jvm.gc()
        _LEFT[app] = jvm.totalMemory()


def released(*frames: DataFrame) -> None:
    """Deletes the files of staged tables that nothing will read again; other frames are left alone."""
    for df in frames:
        if at := getattr(df, "_staged_at", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def n_words(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sub_bits(rows: int, per_bucket: int = 50_000) -> int:
    """Bits that split `rows` rows into buckets of about per_bucket rows, 64 to 65536 buckets a group."""
    return min(16, max(6, int(rows // per_bucket).bit_length()))


def running(df: DataFrame, group: list[str], order: str, value: Column, out: str, bits: int, ties: list[str] = (), bucket: Column | None = None) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same group that come before, in the order of the
    long column `order` (a hash) and then `ties`.

    No group is sorted in one task. A group is cut by the top bits of `order` into 2^bits buckets, or by `bucket`, which then comes
    first in the order; a small table of bucket sums gives each bucket's start, and a window runs within buckets alone. Null group
    values form a group of their own. df is read twice, so it must give the same rows each time.
    """
    df = df.withColumn("_v", value.cast("long")).withColumn("_b", F.shiftright(F.col(order), 64 - bits) if bucket is None else bucket)
    sums = df.groupBy(*group, "_b").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_bb"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    on = F.col("_b") == F.col("_bb")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inner = Window.partitionBy(*group, "_b").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(starts, on).drop(*[f"_g{i}" for i in range(len(group))], "_bb")
    return joined.withColumn(out, F.col("_start") + F.coalesce(F.sum("_v").over(inner), F.lit(0))).drop("_v", "_b", "_start")


class WordIds(dict):
    """64-bit ids of words, remembered up to a bound."""

    def __init__(self, most: int = 100_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value stirred, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, ids: WordIds, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of its whole word sequence when that is
    shorter than `width`; none for a text without words. A-Z count as a-z."""
    words = text_bytes(text).translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = np.array([ids[x] for x in words], np.uint64)
    n = len(w) - width + 1
    h = mixed(w[:n] + _P)
    for k in range(1, width):
        h = mixed(h * _P + w[k : k + n])
    return np.unique(h)


def clean(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns of df only, so that other columns can't clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in needed])



def mapped(df: DataFrame, start: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str, rows: int = 256) -> DataFrame:
    """df through a Python function of columns, as Arrow batches, `rows` rows at a time. `start` is called once a task and
    gives the function. Integers stay exact beside nulls."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = f({c: part.column(i).to_pylist() for i, c in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[c.name], c.type) for c in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
