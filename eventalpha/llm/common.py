"""Small helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a regular expression class body; words are maximal runs of anything else.
SPACE = r"\x20\x09-\x0D"

_fallback: dict[str, str] = {}
_written: dict[int, tuple] = {}  # of each table that ``cut`` returned: its path, and what takes the entry away with it


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where it is unset, a
    temporary folder of this machine if Spark runs on this machine alone, else ValueError."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _fallback[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    It ends the lineage (a lost executor only repeats what follows), keeps what two later jobs
    need from being computed twice, and gives the planner the real size of the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = path, weakref.ref(out, lambda _, key=id(out): _written.pop(key, None))
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that nothing will read again."""
    for df in tables:
        if id(df) in _written:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_written.pop(id(df))[0])
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """From now on in this session Python gets at most ``most`` bytes of rows at once, and a row more; a smaller limit of the
    caller's stays. Spark's own limit (64 MB) costs an executor up to twice that for each task in its buffers, and again
    in each Python worker, which keeps it for the next stage."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= most:
        spark.conf.set(key, f"{most}b")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """The array of words of a text."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TABLE_BITS = 23  # of a bit table, as a power of two: 1 MB, whatever it is made of


def bit_table(df: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of a column of 64-bit hashes, packed, to be broadcast: at most 2^TABLE_BITS / 64 numbers reach
    the driver. The fuller it is, the more it lets pass that is not in it; it never loses what is."""
    places = F.array(*[F.shiftright(column, s).bitwiseAND(F.lit((1 << TABLE_BITS) - 1)) for s in (0, 32)])
    words = df.select(F.explode(places).alias("at")).groupBy(F.shiftright("at", 6).alias("w"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def unpacked(packed: np.ndarray) -> np.ndarray:
    return np.unpackbits(packed, bitorder="little").astype(bool)


def in_table(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (unsigned) the unpacked table may hold."""
    mask = np.uint64((1 << TABLE_BITS) - 1)
    return bits[(hashes & mask).astype(np.int64)] & bits[((hashes >> np.uint64(32)) & mask).astype(np.int64)]
