"""Session construction and the few services that depend on its settings."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings for a session this package creates itself (tests, bench).  A session
#: handed in from outside is used as it is.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "codeloom", cores: int | str = "*", conf: dict | None = None) -> SparkSession:
    """A local session; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**LOCAL_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints.

    The cluster names one, shared by all executors, in ``spark.checkpoint.dir``;
    it is read from there.  Only where neither that setting nor a directory set
    on the context exists (local tests) is a temporary folder used.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = context.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = os.path.join(tempfile.gettempdir(), f"codeloom-checkpoint-{os.getpid()}")
    context.setCheckpointDir(configured)
    return configured


#: Bits of an estimated size from which on a checkpoint forgets it.
SIZE_BITS = 60


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared checkpoint folder.

    The result survives the loss of executors, unlike a local checkpoint.  A
    checkpoint keeps the size that was estimated for its plan, and joins multiply
    sizes: over the rounds of an iteration the number doubles its digits until the
    planner spends all its time on them.  An estimate that has become meaningless
    is therefore dropped for Spark's default.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    done = df.checkpoint(eager=True)
    plan = done._jdf.queryExecution()
    if int(plan.optimizedPlan().stats().sizeInBytes()).bit_length() <= SIZE_BITS:
        return done
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), done._jdf.schema(), False), spark)


def free_unused(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files and checkpoints that nothing refers to any more.

    They otherwise stay on disk until the driver happens to collect its garbage.
    """
    gc.collect()
    spark._jvm.System.gc()


def default_parallelism(spark: SparkSession) -> int:
    """Shuffle partitions as configured, at least the default parallelism."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    For work per row that is dear and an input of few splits; an input with more
    splits than cores is left as it is, so at scale nothing moves.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table of a data directory; also the point where workers get this package."""
    ship_package(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once per context.

    The package is sent as a zip file, so that executors need no installation.
    """
    context = spark.sparkContext
    if getattr(context, "_codeloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="codeloom-package-")
    archive = os.path.join(folder, "codeloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for at, folders, files in os.walk(root):
            folders[:] = sorted(f for f in folders if f != "__pycache__")
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._codeloom_shipped = True
