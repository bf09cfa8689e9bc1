"""Where the operators of this subpackage put what must outlive an executor."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new path under the folder named by ``spark.checkpoint.dir``.

    The setting is read from the session. Only where it is unset (tests, a local master) a
    scratch folder is made and set for this session.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            root = known.get()
        else:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="econcheck-")
            sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, readable after any executor is lost."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files, broadcasts and checkpoints of tables that nothing refers to any more.

    Its cleaner acts when the driver collects garbage, which a driver with little to do may not
    do for half an hour; loops of many small jobs call this between rounds.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
