"""Where jobs keep intermediate and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions (tests) that name none.
_LOCAL: dict[str, str] = {}


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share; a temporary one only for a local session that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _LOCAL.get(app) or _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="folioworks-"))
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Written once and read back: what several joins need is not worked out for each, and a lost executor costs nothing."""
    path = new_folder(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
