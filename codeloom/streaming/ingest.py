"""Change-driven re-indexing as a stream: new and changed files go into the index in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.functions.lexer import LANGUAGES
from codeloom.operators.rank import latest_per_key
from codeloom.plans.indexing import index_sources
from codeloom.sources.tree import _SKIPPED, name_filter

_FILE = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, root: str, files_per_batch: int = 1_000) -> DataFrame:
    """New files below ``root`` as they appear: ``(path, content, hash, modified)``."""
    stream = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", True).option("pathGlobFilter", name_filter(tuple(LANGUAGES))).option("maxFilesPerTrigger", files_per_batch).load(root)
    wanted = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*LANGUAGES) & ~F.col("path").rlike(_SKIPPED)
    return stream.where(wanted).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.sha2("content", 256).alias("hash"), F.col("modificationTime").alias("modified"))


def stream_into_index(stream: DataFrame, repo: str, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps the index under ``root`` up to a file stream; with ``once`` it stops when all present files are in.

    Within a batch the last write of a path counts.  A batch that is repeated
    after a failure changes nothing, as its hashes are stored already.
    """

    def put(batch: DataFrame, _: int) -> None:
        latest = latest_per_key(batch, ["path"], [F.desc("modified"), F.desc("hash")])
        index_sources(batch.sparkSession, latest.withColumn("repo", F.lit(repo)).drop("modified"), root, full=False)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def changes_per_window(stream: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Files changed per time window; rows later than ``late`` are dropped."""
    return stream.withWatermark("modified", late).groupBy(F.window("modified", window)).agg(F.count(F.lit(1)).alias("n_files"), F.approx_count_distinct("path").alias("n_paths"))
