"""Small written tables that cut a plan in two.

``settle`` writes an intermediate to the folder named by ``spark.checkpoint.dir`` and
reads it back. Three things follow:

* later joins see the true size of the intermediate, so the planner broadcasts it only
  when it is under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise. An
  aggregate that is still lazy is estimated at the size of its input, and the fact table
  next to it would be shuffled before adaptive execution learns that it was tiny;
* the work behind it is done once, however many branches read it;
* a lost executor costs a re-read, never a different answer.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions that name none, removed at exit.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, from ``spark.checkpoint.dir``. A session on one
    machine that names none gets a folder of its own; the session itself is left as it is."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        if sc.applicationId not in _OWN:
            _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="pitchlytics-")
            atexit.register(shutil.rmtree, _OWN[sc.applicationId], ignore_errors=True)
        root = _OWN[sc.applicationId]
    return f"{root}/{sc.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all that this application has settled. Frames read from it end with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh, unused path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return it as a table scan."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
