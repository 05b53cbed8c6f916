"""Link drops: files of links that arrive in a folder, each handled as one run of the bulk job.

A streaming file source notes which files it has seen, and a keyed state which links, so a drop that repeats
links of earlier ones brings only what is new.  Both live in the checkpoint folder of the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.operators.records import References
from sitemill.plans.jobs import run_job
from sitemill.sources import inputs

#: State on the executors' disks, not in their heaps: it grows with all links ever seen.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def new_links(spark: SparkSession, source: str, files_per_run: int = 1) -> DataFrame:
    """The stream of links in the files of a folder, each link once."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_run).load(source)
    return inputs.split_list(lines, F.col("value"), "link").where(F.col("link") != "").select("link").dropDuplicates(["link"])


def run_drops(
    spark: SparkSession,
    source: str,
    root: str,
    pages: DataFrame | inputs.PageStore,
    job: str,
    house: DataFrame,
    refs: References,
    *,
    state: str | None = None,
    files_per_run: int = 1,
    **options,
) -> list[int]:
    """Handle all drops in the folder ``source`` that no earlier call has handled, and return their runs.

    Each drop is one run folder under ``root``, numbered by its batch; ``options`` are those of ``run_job``.
    A drop without new links gives no run.  ``state`` is the checkpoint folder of the stream, beside the outputs
    unless given; it must outlive the sessions, and is of one job.  A call that was stopped is taken up with the
    drop it stopped in, whose run folder is written anew under the same number, so nothing is written twice.
    The homepage of a site is asked again when a later drop brings new links of that site.
    """
    state = state or f"{root.rstrip('/')}/_drops/job={job}"
    runs: list[int] = []

    def handle(batch: DataFrame, run: int) -> None:
        # Written and read by the caller's session: that of a stateful batch plans without adaptive execution.
        links = f"{state}/links/run={run}"
        batch.write.mode("overwrite").parquet(links)
        given = spark.read.schema("link string").parquet(links)
        if given.isEmpty():
            return
        run_job(spark, given, pages, job, house, refs, **options).write(root, job, run, mode="overwrite")
        runs.append(run)

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, STATE_STORE)
    try:
        stream = new_links(spark, source, files_per_run).writeStream.foreachBatch(handle)
        query = stream.option("checkpointLocation", f"{state}/stream").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    query.awaitTermination()
    return runs
