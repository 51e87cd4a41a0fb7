"""What any operator needs of its session."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the cluster's shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session without one gets a
    temporary folder; on a cluster a machine's own folder would lose rows with the machine.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (context.master or "").startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="cadastra-checkpoints-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def release(*frames: DataFrame) -> None:
    """Deletes the files of what ``durable`` returned, once all that reads it is durable itself."""
    for df in frames:
        kept = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if kept.isDefined():
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(kept.get())
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Lets the session of ``df`` delete the shuffle files that nothing refers to; Spark does so when the driver's garbage is collected."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
