"""Session settings and the scratch area used to cut lineage."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Settings the results depend on: datetimes are zone-less and truncated in UTC.
REQUIRED_CONF = {"spark.sql.session.timeZone": "UTC"}

# Defaults applied only when we start the session ourselves.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    # recording the call site of every Column operation makes building long plans several times slower
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(app_name: str = "cubemerge", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with the settings the operators rely on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **REQUIRED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    A temporary folder is made only in local mode, where driver and executors share one disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/") + "/cubemerge"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    path = tempfile.mkdtemp(prefix="cubemerge-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path + "/cubemerge"


# Scratch tables made inside the current scope; None outside of any.
_MADE: ContextVar[list[str] | None] = ContextVar("scratch tables", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables made inside the block when it ends: for work whose results are stored by then."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def read_exact(spark: SparkSession, schema: T.StructType, *paths: str, base: str | None = None) -> DataFrame:
    """Read parquet with a known schema, so no footer is opened for inference."""
    reader = spark.read.schema(schema)
    if base:
        reader = reader.option("basePath", base)
    return reader.parquet(*paths)


def materialize(df: DataFrame, name: str = "tmp") -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Runs a job. Used where a result feeds several later steps and must be the same rows in each of them
    even when tasks are retried (range blocks, iterative joins).
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    df.write.parquet(path)
    return read_exact(spark, T.StructType.fromJson(json.loads(df.schema.json())), path)
