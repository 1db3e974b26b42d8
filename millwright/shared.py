"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is named, a temporary one, in local mode alone."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="millwright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def table_or_empty(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The table at path, empty where nothing has been written yet."""
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, whatever reads it, and kept when executors are lost."""
    path = f"{shared_root(df.sparkSession)}/millwright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes in an Arrow batch of documents: they may be long, and a worker holds a batch at a time.
BATCH_BYTES = 16 << 20


def light_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have BATCH_BYTES bytes at most (and a row)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    known = conf.get(key)
    if not known.isdigit() or int(known) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df
