"""Tables kept in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a session that runs in one process may leave it unnamed."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(rows: DataFrame, compression: str | None = None) -> DataFrame:
    """``rows``, written as Parquet into the shared folder and read again: computed once, however often it is read, and safe from lost executors."""
    path = f"{folder(rows.sparkSession)}/kept-{uuid.uuid4().hex}"
    rows.write.parquet(path, compression=compression)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
