"""Small helpers shared by readers and writers."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_DIR, WAREHOUSE = "spark.checkpoint.dir", "spark.sql.warehouse.dir"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name under the shared folder the session names.

    That is the checkpoint folder, or the warehouse where there is none.
    Nothing is created yet; the first write does that.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir() or spark.conf.get(WAREHOUSE)
    return f"{base.rstrip('/')}/siftrow-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder with all in it, on whatever storage it is; False if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))


def no_rows(spark: SparkSession, schema) -> DataFrame:
    """An empty table that lives in the JVM alone."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in fields))


def add_rows(rows: DataFrame, path: str) -> None:
    """Add a few rows, one file, to the table at ``path``.

    The file gets a folder of its own: writers that work side by side on one
    folder would clear each other's unfinished files away.
    """
    rows.coalesce(1).write.parquet(f"{path}/{uuid.uuid4().hex}")


def read_added(spark: SparkSession, path: str, schema) -> DataFrame:
    """All that :func:`add_rows` has added to ``path``."""
    return read_parquet_if_there(spark, path, schema, recursive=True)


def read_parquet_if_there(spark: SparkSession, path: str, schema, recursive: bool = False) -> DataFrame:
    """The table at ``path``, or no rows when nothing has been written yet."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", str(recursive).lower()).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return no_rows(spark, schema)
