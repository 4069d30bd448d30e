"""Session settings and helpers that look at sizes before choosing a plan."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A table may be broadcast only after a count has shown it at or below this.
BROADCAST_ROWS = 20_000
# Tables up to this size may be dealt out anew for costly work on each row.
SPREAD_BYTES = 256 << 20

# How bulk intermediates are written.
PACKED = {"compression": "zstd"}
# Attribute of a table that ``written`` made: its folder.
_FOLDER = "_vibralake_folder"


# Settings that can change on a running session. Wide projections compile to
# methods the JVM will not optimise beyond 8000 bytes of code; under this limit
# Spark compiles the columns in separate methods instead, which runs far faster.
# Python gets at most so many bytes of rows at a time, which bounds a worker's memory where rows are long.
# Shuffle files go when the job that made them ends; left alone they stay until the driver happens to collect its garbage.
# The state of a stream lies in files with a bounded cache; Spark's default keeps every key as objects on the executors' heaps.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the library is meant to run with."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "vibralake", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC timestamps, adaptive execution and Arrow transfer."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {**RUNTIME_CONF, "spark.sql.execution.arrow.pyspark.enabled": "true", **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str | None:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``."""
    return spark.conf.get("spark.checkpoint.dir", None)


def shared_base(spark: SparkSession) -> str:
    """The shared folder; only a local master may do without the setting and use a folder of this machine."""
    base = shared_dir(spark) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="vibralake-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path for a job's files inside the shared folder."""
    import uuid

    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint, so a lost executor costs no recompute."""
    context = df.sparkSession.sparkContext
    base = shared_base(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return df.checkpoint()


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast when a count proves it small, else leave it alone."""
    return F.broadcast(df) if fits(df, rows) else df


def written(df: DataFrame, name: str = "table", **options: object) -> DataFrame:
    """Write a bulk intermediate as parquet in the shared folder and read it back.

    For tables that are read several times: columns can be pruned when reading,
    and the files outlive any executor. ``options`` go to the writer.
    """
    return written_parts([df], name, **options)


def written_parts(parts: Iterable[DataFrame], name: str = "table", **options: object) -> DataFrame:
    """``written`` for tables of one schema that are laid down together, one after the other: the shuffle files of one are gone before the next is made."""
    path = None
    for part in parts:
        path = path or scratch_dir(part.sparkSession, name)
        part.write.mode("append").options(**options).parquet(path)
    out = part.sparkSession.read.schema(part.schema).parquet(path)
    setattr(out, _FOLDER, path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` made and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(table.__dict__.pop(_FOLDER))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    A filter on a projected column is pushed below the projection together
    with the column's whole expression, which repeats costly work for every
    use. Filters are not pushed into an unfolded array, so the columns are
    wrapped in a one-element array and unfolded.
    """
    packed = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(packed))


def spread(scan: DataFrame) -> DataFrame:
    """A small scan in at least as many partitions as there are cores.

    For costly work per row on a table that sits in few file splits. Tables above
    ``SPREAD_BYTES`` are never shuffled for it. Only for plain
    scans: anything with a shuffle would run to find its partitions.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return scan.repartition(cores) if size <= SPREAD_BYTES and scan.rdd.getNumPartitions() < cores else scan
