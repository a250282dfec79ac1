"""Session defaults and staged tables.

A staged table is the library's way to cut lineage: the frame is written as
parquet under the folder named by ``spark.checkpoint.dir`` and read back, so a
lost executor costs a re-read and the optimizer sees real file sizes.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_scratch: dict[str, tempfile.TemporaryDirectory] = {}
_staged: dict[str, list[str]] = {}


def build_session(app: str = "softdeps", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on and UTC time; the cluster's own settings win elsewhere."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def slots(spark: SparkSession) -> int:
    """Task slots to plan for."""
    return max(1, spark.sparkContext.defaultParallelism)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables: ``spark.checkpoint.dir``, or a private one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder when running on a cluster")
    app = context.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.TemporaryDirectory(prefix="softdeps-", ignore_cleanup_errors=True)
    return _local_scratch[app].name


def stage(df: DataFrame, label: str, by: tuple[str, ...] = (), **options: str) -> DataFrame:
    """Write ``df`` to the scratch folder and return a scan of it; a folder for each value of ``by``, ``options`` are the Parquet writer's."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).partitionBy(*by).parquet(path)
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``stage`` plus the number of rows written, observed during the write; meant for sizing."""
    seen = Observation()
    staged = stage(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return staged, seen.get["n"]


def drop_staged(spark: SparkSession) -> int:
    """Delete every table this application staged; frames built on them become unusable."""
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)


def ceil_div(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))
