"""Cell sums of a stream, kept as state: they merge, so that a fixed partition needs no more.

Each micro-batch is summed by cell where its rows are; then a row for each cell and task meets the
cell's state, and the cells that a batch touched are written, under the number of the batch, to a table
that any session reads. The state lives in the checkpoint: whoever starts again from it goes on, and a
batch that is repeated writes the same rows over its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from densityflow.operators.kgmm import draw, grid_cell
from densityflow.sources.store import shared_path

SUMS = ["n", "szz", "sz0", "sx0"]
PARTIAL = "cell int, n long, szz double, sz0 double, sx0 double"
#: What a batch writes of a cell: its sums so far, and those that it had before.
TOUCHED = f"{PARTIAL}, old_n long, old_sz0 double"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, x0, z0) of a task as sums."""
    held = []
    for b in batches:
        if b.num_rows:
            cell, x, z = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            held.append(pd.DataFrame({"cell": cell, "n": np.ones(len(cell), np.int64), "szz": z * z, "sz0": z, "sx0": x}).groupby("cell", as_index=False).sum())
    if held:
        both = pd.concat(held).groupby("cell", as_index=False).sum()
        yield pa.RecordBatch.from_pandas(both.astype({"cell": "int32"}), preserve_index=False)


class CellState(StatefulProcessor):
    """The sums of one cell."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "n long, szz double, sz0 double, sx0 double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = tuple(self.sums.get()) if self.sums.exists() else (0, 0.0, 0.0, 0.0)
        new = list(old)
        for part in rows:
            for k, name in enumerate(SUMS):
                new[k] += part[name].sum()
        new = (int(new[0]), *(float(v) for v in new[1:]))
        self.sums.update(new)
        yield pd.DataFrame([(key[0], *new, old[0], old[2])], columns=["cell", *SUMS, "old_n", "old_sz0"])

    def close(self) -> None:
        pass


def stream_cells(spark: SparkSession, path: str, schema: str, row: str, value: str, sigma: float, seed: int, low: float, width: float, cells: int, out: str, checkpoint: str) -> None:
    """Brings the table at out up to date with all files at path, from where the checkpoint stands."""
    files = f"{path[:-1]}[{path[-1]}]"  # as a pattern, it may be one file as well as a folder
    points = spark.readStream.schema(schema).parquet(files).select(F.col(row).alias("row"), F.col(value).cast("double").alias("y0"))
    noisy = draw(points, F.lit(sigma), range(1, 2), seed).withColumn("cell", grid_cell(F.col("x0"), low, width, cells))
    parts = noisy.select("cell", "x0", "z0").mapInArrow(_summed, PARTIAL)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        kept = parts.groupBy("cell").transformWithStateInPandas(CellState(), TOUCHED, "Update", "None")
        write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        query = kept.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def latest(spark: SparkSession, out: str) -> DataFrame:
    """(cell, n, szz, sz0, sx0): of each cell, what the last batch that touched it wrote."""
    rows = spark.read.schema(f"{TOUCHED}, batch long").parquet(out)
    return rows.groupBy("cell").agg(F.max_by(F.struct(*SUMS), "batch").alias("s")).select("cell", "s.*")


def batch_deltas(spark: SparkSession, out: str) -> DataFrame:
    """(batch, n, delta): rows that a batch added, and how far the means of z of the cells that it touched moved,
    relative to their size."""
    rows = spark.read.schema(f"{TOUCHED}, batch long").parquet(out)
    new, old = F.col("sz0") / F.col("n"), F.coalesce(F.col("old_sz0") / F.nullif("old_n", F.lit(0)), F.lit(0.0))
    delta = F.sum((new - old) * (new - old)) / F.greatest(F.sum(new * new), F.lit(1e-300))
    return rows.groupBy("batch").agg(F.sum(F.col("n") - F.col("old_n")).alias("n"), delta.alias("delta"))


def stream_cell_sums(spark: SparkSession, path: str, schema: str, row: str, value: str, sigma: float, seed: int, low: float, width: float, cells: int) -> DataFrame:
    """The sums over all files at path, once they are read."""
    out = shared_path(spark)
    stream_cells(spark, path, schema, row, value, sigma, seed, low, width, cells, out, shared_path(spark))
    return latest(spark, out)
