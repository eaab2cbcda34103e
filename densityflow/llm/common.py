"""What the operators share: reading tables, scratch tables, size-checked broadcasts, numbering."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache, wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but space and \t \n \v \f \r.
SPACES = r"[\x20\x09-\x0D]+"
#: Rows up to which the small side of a join is broadcast; it holds a few numbers or a short string
#: each, so that the broadcast stays below about 20 MB. Larger sides are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Scratch tables of the operator that is running in this thread.
_made: ContextVar[list[DataFrame] | None] = ContextVar("_made", default=None)
#: Deletes a query's shuffle files when it ends.
LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to Python at once, and how many where they are long.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 512
#: For each setting those that hold it, and what it was before the first of them.
_holding: dict[str, list[str | None]] = {LET_GO: [], BATCH: []}
_holding_lock = threading.Lock()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder of the cluster (``spark.checkpoint.dir``).

    Only a local master, whose one machine is the cluster, may go without the setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.conf.get("spark.master", "").split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base or _local_dir()}/{uuid.uuid4().hex}"


def cut(df: DataFrame, compression: str | None = None) -> DataFrame:
    """The rows of df, written to the shared folder and read back: lineage ends there.

    Nothing needs the shuffles behind the written table any more, and so they are let go with it."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    with let_go(spark):
        df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    made = _made.get()
    if made is not None:
        made.append(out)
    return out


@contextmanager
def _held(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting for a while; several threads hold it together, and the last puts it back."""
    held = _holding[name]
    with _holding_lock:
        held.append(spark.conf.get(name, None) if not held else held[0])
        spark.conf.set(name, value)
    try:
        yield
    finally:
        with _holding_lock:
            before = held.pop()
            if not held:
                spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def let_go(spark: SparkSession):
    """LET_GO for a write."""
    return _held(spark, LET_GO, "true")


def small_batches(spark: SparkSession):
    """Batches of few rows for Python tasks: with long rows, the usual 10,000 take much memory on both sides."""
    return _held(spark, BATCH, str(BATCH_ROWS))


def tidy(operator):
    """An operator whose result is stored, small beside its input; its scratch tables go when it ends."""

    @wraps(operator)
    def run(*args, **options):
        made: list[DataFrame] = []
        outer = _made.set(made)
        try:
            out = cut(operator(*args, **options))
        except BaseException:
            drop(*made)
            raise
        finally:
            _made.reset(outer)
        drop(*[t for t in made if t is not out])
        around = _made.get()
        if around is not None:  # an operator inside another: the outer one's result holds what it needs
            around.append(out)
        return out

    return run


def drop(*tables: DataFrame) -> None:
    """Deletes the folders of tables made by cut; nothing reads them again."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; df is a scratch table, cheap to count."""
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")


def fresh(name: str, taken: list[str]) -> str:
    """name, or name with underscores before it until no column has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(ws: Column, width: int = 5) -> Column:
    """64-bit hash of each window of words, in order; shorter texts give one over all their words."""
    n = F.size(ws)
    each = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[ws[i + k] for k in range(width)]))
    return F.when(n >= width, each).when(n > 0, F.array(F.xxhash64(F.lit("short"), F.array_join(ws, " ")))).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(ws: Column, width: int = 5) -> Column:
    """The windows of words themselves; shorter texts give one with all their words."""
    n = F.size(ws)
    each = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.array_join(F.slice(ws, i + 1, width), " "))
    return F.when(n >= width, each).when(n > 0, F.array(F.array_join(ws, " "))).otherwise(F.array().cast("array<string>"))


def gapless(df: DataFrame, group: str, chunk: str, order: list[str], to: str) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps.

    chunk is a stored column that cuts the table into pieces of bounded size whatever their keys.
    No task gets more than the rows of one chunk and group; only counts meet.
    """
    counts = df.groupBy(group, chunk).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, chunk, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(group, chunk).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(own))
    out = ranked.join(offsets, [group, chunk])
    return out.withColumn(to, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_before", "_rank")
