"""Variable stores, run folders, configurations and models as Parquet and JSON."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VARIABLES = "name string, kind string, shape array<int>, values array<double>, imag array<double>, text string"


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"


def shared_path(spark: SparkSession) -> str:
    """A new path in the cluster's shared folder; only a local master may go without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.conf.get("spark.master", "").split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base or _local_dir()}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder and read back: what follows doesn't work them out again."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the folders of stored tables; nothing reads them again."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def bounded(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A small table for the side of a join, worked out once: broadcast if it has at most so many rows.

    So many rows, and one to tell, come to the driver and go from there; a larger table is stored."""
    found = df.limit(rows + 1).toArrow()
    if found.num_rows > rows:
        return stored(df)
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema))


FIELDS = ("u", "timeseries", "field", "data")


def field_of(df: DataFrame, key: str | None = None, order: tuple[str, ...] = FIELDS) -> str:
    """The column of a table that holds the snapshots: key, else the first of order that is an array of
    numbers, else the first such column."""
    arrays = [c for c, t in df.dtypes if t in ("array<double>", "array<float>", "array<int>", "array<bigint>")]
    if key is not None:
        if key not in arrays:
            raise ValueError(f"{key} is no array of numbers")
        return key
    named = [c for c in order if c in arrays]
    if not (named or arrays):
        raise ValueError("the table has no array of numbers")
    return (named or arrays)[0]


def load_series(spark: SparkSession, path: str, stride: int = 1, most: int | None = None, key: str | None = None, t: str = "t", order: tuple[str, ...] = FIELDS) -> DataFrame:
    """Snapshots (t, x) of a Parquet table with a row for each time: every stride-th, at most so many.
    Both conditions and the two columns reach the scan."""
    df = spark.read.parquet(path)
    df = df.select(F.col(t).alias("t"), F.col(field_of(df, key, order)).alias("x"))
    df = df if most is None else df.where(F.col("t") < stride * most)
    return df.where(F.pmod("t", F.lit(stride)) == 0)


def oriented(snapshots: DataFrame) -> DataFrame:
    """snapshots (t, x) with time along the longer side: where there are fewer rows than places in them,
    places become rows. Only counts are looked at; turning is a grouping by place."""
    rows, places = snapshots.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not rows or rows >= places:
        return snapshots
    long = snapshots.select("t", F.posexplode("x").alias("at", "v"))
    pairs = F.array_sort(F.collect_list(F.struct("t", "v")))  # no more than the fewer rows
    return long.groupBy(F.col("at").cast("long").alias("t")).agg(F.transform(pairs, lambda p: p["v"]).alias("x"))


def _qualified(spark: SparkSession, path: str) -> str:
    """The path as a scan names it, without what follows the scheme's colon in slashes."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().toString()
    return re.sub(r"^(\w+):/+", r"\1:/", found).rstrip("/")


def read_runs(spark: SparkSession, paths: dict[str, str], fields: dict[str, float], group: str = "main") -> DataFrame:
    """(run, a column for each field): one row a run; a field that its store lacks has its default.

    All stores are one scan, and a row's run follows from its file; runs may share a store. Only rows of
    the fields are grouped. A path without a store is an error."""
    if not paths:
        return spark.createDataFrame([], ", ".join(["run string", *(f"`{k}` double" for k in fields)]))
    runs = spark.createDataFrame([(run, _qualified(spark, path)) for run, path in paths.items()], "run string, folder string")
    rows = spark.read.schema(VARIABLES).option("recursiveFileLookup", "true").parquet(*sorted(set(paths.values())))
    file = F.regexp_replace(F.col("_metadata.file_path"), r"^(\w+):/+", "$1:/")
    rows = rows.select(file.alias("file"), "name", "shape", "values").where(F.col("file").contains(f"/group={group}/"))
    kept = rows.where(F.col("name").isin(*fields) & (F.size("shape") == 0)).select(F.substring_index("file", f"/group={group}/", 1).alias("folder"), "name", F.get("values", F.lit(0)).alias("value"))
    wide = kept.groupBy("folder").agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in fields])
    return runs.join(wide, "folder", "left").select("run", *[F.coalesce(name, F.lit(default)).alias(name) for name, default in fields.items()])


def from_long(long: DataFrame, name: str, keys: list[str], value: str = "x") -> DataFrame:
    """Store rows of an array that no driver holds: a row for each value of the first key, its values in
    the order of the others; load reads them like any other variable, row by row."""
    first, *rest = keys
    pairs = F.array_sort(F.collect_list(F.struct(*rest, value)))
    rows = long.groupBy(first).agg(F.transform(pairs, lambda p: p[value].cast("double")).alias("values"))
    return rows.select(
        F.concat(F.lit(f"{name}/"), F.col(first).cast("string")).alias("name"), F.lit("row").alias("kind"), F.array(F.size("values")).alias("shape"), "values", F.lit(None).cast("array<double>").alias("imag"), F.lit(None).cast("string").alias("text")
    )


def variables(spark: SparkSession, values: dict) -> DataFrame:
    """A row for each Python value: bool, number, complex, string or array of these."""
    rows = []
    for name, v in values.items():
        if v is None:
            continue
        if isinstance(v, bool):
            rows.append((name, "bool", [], [float(v)], None, None))
        elif isinstance(v, str):
            rows.append((name, "string", [], None, None, v))
        elif isinstance(v, complex):
            rows.append((name, "complex", [], [v.real], [v.imag], None))
        elif isinstance(v, (int, float)):
            rows.append((name, "int" if isinstance(v, int) else "double", [], [float(v)], None, None))
        else:
            a = np.asarray(v)
            imag = a.imag.ravel().astype(float).tolist() if np.iscomplexobj(a) else None
            rows.append((name, "array", list(a.shape), a.real.ravel().astype(float).tolist(), imag, None))
    return spark.createDataFrame(rows, VARIABLES)


def save(df: DataFrame, path: str, group: str = "main") -> None:
    df.withColumn("group", F.lit(group)).write.mode("overwrite").partitionBy("group").parquet(path)


def load(spark: SparkSession, path: str, group: str = "main") -> DataFrame:
    return spark.read.parquet(path).where(F.col("group") == group).drop("group")


def as_python(df: DataFrame) -> dict:
    """The values of a store again; it is as small as what was put in."""
    out = {}
    for r in df.toLocalIterator():
        if r.kind == "array":
            a = np.array(r["values"])
            out[r.name] = (a + 1j * np.array(r.imag) if r.imag is not None else a).reshape(r["shape"])
        else:
            out[r.name] = {"bool": lambda r=r: bool(r["values"][0]), "string": lambda r=r: r.text, "int": lambda r=r: int(r["values"][0]), "double": lambda r=r: r["values"][0], "complex": lambda r=r: complex(r["values"][0], r.imag[0])}[r.kind]()
    return out


def save_views(spark: SparkSession, path: str) -> list[str]:
    names = [t.name for t in spark.catalog.listTables() if t.isTemporary]
    for n in names:
        spark.table(n).write.mode("overwrite").parquet(f"{path}/{n}")
    return names


def load_views(spark: SparkSession, path: str, names: list[str], overwrite: bool = False) -> list[str]:
    done = []
    for n in names:
        if overwrite or not spark.catalog.tableExists(n):
            spark.read.parquet(f"{path}/{n}").createOrReplaceTempView(n)
            done.append(n)
    return done


def network_rows(net: list) -> list[tuple[int, int, int, float]]:
    """(layer, out, in, value), the bias as in = -1."""
    return [(k, i, j, float(w[i, j]) if j >= 0 else float(b[i])) for k, (w, b) in enumerate(net) for i in range(len(b)) for j in range(-1, w.shape[1])]


def save_network(spark: SparkSession, net: list, path: str, activation: str = "swish") -> None:
    rows = spark.createDataFrame(network_rows(net), "layer int, out int, in int, value double")
    rows.withColumn("activation", F.lit(activation)).write.mode("overwrite").parquet(path)


def load_activation(spark: SparkSession, path: str) -> str:
    return spark.read.parquet(path).select("activation").first()[0]


def save_config(df: DataFrame, path: str, fields: list[str]) -> None:
    """A line of JSON for each row; nulls are left out."""
    df.select(config_json(fields).alias("value")).write.mode("overwrite").text(path)


def load_network(spark: SparkSession, path: str) -> list:
    rows = spark.read.parquet(path).collect()  # the weights of one small network
    net = []
    for k in range(1 + max(r.layer for r in rows)):
        own = [r for r in rows if r.layer == k]
        w = np.zeros((1 + max(r.out for r in own), 1 + max(r["in"] for r in own)))
        b = np.zeros(w.shape[0])
        for r in own:
            if r["in"] < 0:
                b[r.out] = r.value
            else:
                w[r.out, r["in"]] = r.value
        net.append((w, b))
    return net


def next_run(names: DataFrame, column: str = "name") -> DataFrame:
    """(run): run_%03d after the largest of names that are run_ and digits."""
    found = names.select(F.regexp_extract(column, r"^run_(\d+)$", 1).alias("i")).where("i != ''")
    return found.agg((F.coalesce(F.max(F.col("i").cast("int")), F.lit(0)) + 1).alias("i")).select(F.format_string("run_%03d", "i").alias("run"))


def config_json(fields: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f) for f in fields]))


def config_field(text: Column, path: str, kind: str, default) -> Column:
    return F.coalesce(F.get_json_object(text, path).cast(kind), F.lit(default).cast(kind))
