"""Array files (.npy) of snapshots as a data source: ``spark.read.format("npy").load(path)``.

The longer axis is time, as in files of fields. A file is cut into ranges of times; a task reads the
bytes of its range and no more, and with a stride only those of the times that it keeps. Options:
``stride`` (every so manieth time), ``most`` (at most so many), ``rows`` (times of a range). Conditions
on t cut the ranges before any is read. ``describe`` gives what a file says of itself, with the time
step that stands beside it in ``<path>.json``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Bytes that a range holds, unless its number of times is given.
RANGE_BYTES = 32 << 20
#: With a stride, times so far apart are read one by one.
NEAR_BYTES = 1 << 16


def _open(path: str, mode: str = "rb"):
    """A file that can be read at any place, in whatever store Arrow knows."""
    if not urlparse(path).scheme:
        path = f"file://{os.path.abspath(path)}"
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner) if mode == "rb" else store.open_output_stream(inner)


@dataclass(frozen=True)
class Layout:
    """times snapshots of places numbers each, of which the first byte stands at offset."""

    times: int
    places: int
    dtype: str
    offset: int
    by_time: bool  # whether a snapshot's numbers stand together

    @property
    def item(self) -> int:
        return np.dtype(self.dtype).itemsize


def layout(path: str) -> Layout:
    with _open(path) as f:
        version = npy.read_magic(f)
        shape, fortran, dtype = npy.read_array_header_1_0(f) if version == (1, 0) else npy.read_array_header_2_0(f)
        offset = f.tell()
    if dtype.kind not in "fiu":
        raise ValueError(f"an array of numbers is needed, not of {dtype}")
    if len(shape) == 1:
        return Layout(shape[0], 1, dtype.str, offset, True)
    if len(shape) != 2:
        raise ValueError("an array of one or two axes is needed")
    first = shape[0] >= shape[1]  # time is the first axis
    return Layout(max(shape), min(shape), dtype.str, offset, first != fortran)


def describe(path: str) -> dict:
    """times, places, dtype, and dt if a file of metadata gives it."""
    found = layout(path)
    out = {"times": found.times, "places": found.places, "dtype": found.dtype, "dt": None}
    try:
        with _open(f"{path}.json") as f:
            out["dt"] = json.loads(f.read()).get("dt")
    except FileNotFoundError:
        pass
    return out


@dataclass
class Range(InputPartition):
    first: int
    last: int


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, options: dict[str, str]):
        self.path, self.layout = path, layout(path)
        self.stride = int(options.get("stride", 1))
        if self.stride < 1:
            raise ValueError("the stride must be positive")
        most = options.get("most")
        self.first = 0
        self.last = self.layout.times if most is None else min(self.layout.times, self.stride * int(most))
        whole = max(1, RANGE_BYTES // max(1, self.layout.places * self.layout.item))
        self.rows = int(options.get("rows", whole))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("t",) or not isinstance(getattr(f, "value", None), int):
                yield f
            elif isinstance(f, EqualTo):
                self.first, self.last = max(self.first, f.value), min(self.last, f.value + 1)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.last = min(self.last, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[Range]:
        step = self.stride * max(1, self.rows // self.stride)  # every range begins at a time that is kept
        begin = -(-self.first // self.stride) * self.stride
        return [Range(a, min(a + step, self.last)) for a in range(begin, self.last, step)] or [Range(0, 0)]

    def spans(self, part: Range) -> list[tuple[int, int]]:
        """Ranges of bytes that a task reads."""
        at, item = self.layout, self.layout.item
        times = range(part.first, part.last, self.stride)
        if not len(times):
            return []
        end = times[-1] + 1
        if not at.by_time:
            return [(at.offset + (p * at.times + part.first) * item, at.offset + (p * at.times + end) * item) for p in range(at.places)]
        size = at.places * item
        if self.stride * size >= NEAR_BYTES:
            return [(at.offset + t * size, at.offset + (t + 1) * size) for t in times]
        return [(at.offset + part.first * size, at.offset + end * size)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        at, spans = self.layout, self.spans(part)
        if not spans:
            return
        times = np.arange(part.first, part.last, self.stride)
        with _open(self.path) as f:
            parts = [np.frombuffer(f.read_at(b - a, a), dtype=at.dtype) for a, b in spans]
        if not at.by_time:
            x = np.stack([p[:: self.stride] for p in parts], axis=1)
        elif len(parts) == len(times):
            x = np.concatenate(parts).reshape(len(times), at.places)
        else:
            x = parts[0].reshape(-1, at.places)[:: self.stride]
        x = np.ascontiguousarray(x, dtype=np.float64)
        for k in range(0, len(times), 1 << 14):
            block = x[k : k + (1 << 14)]
            offsets = np.arange(len(block) + 1, dtype=np.int32) * at.places
            yield pa.RecordBatch.from_arrays([pa.array(times[k : k + len(block)]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(block.ravel()))], names=["t", "x"])


class ArraySource(DataSource):
    """Rows (t, x): a snapshot for each time."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "t bigint, x array<double>"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options["path"], self.options)


PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArraySource)
    spark.conf.set(PUSHDOWN, "true")


def load_array(spark: SparkSession, path: str, stride: int = 1, most: int | None = None) -> DataFrame:
    register(spark)
    options = {"stride": stride} | ({} if most is None else {"most": most})
    return spark.read.format("npy").options(**options).load(path)


def save_array(snapshots: DataFrame, path: str, times: int, places: int, dt: float | None = None) -> None:
    """Snapshots (t, x), t = 0 .. times - 1, as an array file on a file system that all tasks share: each
    task writes its snapshots at their places."""
    local = urlparse(path).path
    with open(local, "wb") as f:
        npy.write_array_header_2_0(f, {"descr": "<f8", "fortran_order": False, "shape": (times, places)})
        offset = f.tell()
        f.truncate(offset + times * places * 8)
    if dt is not None:
        with open(f"{local}.json", "w") as f:
            json.dump({"dt": dt}, f)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(local, "r+b") as f:
            for b in batches:
                for t, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    values = np.asarray(x.values, dtype="<f8")
                    if len(values) != places or not 0 <= t < times:
                        raise ValueError(f"the snapshot at {t} doesn't fit")
                    f.seek(offset + t * places * 8)
                    f.write(values.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    x = snapshots.select(F.col("t").cast("long").alias("t"), F.transform("x", lambda v: v.cast("double")).alias("x"))
    if (x.mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0) != times:
        raise ValueError(f"{times} snapshots were to be written")
