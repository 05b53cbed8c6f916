"""JSON-lines output and read-back.

Outputs lie under ``kind=/job=/run=`` folders, so a run is addressed by path and read without listing
others.  Null fields are written, as every record carries every field.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DOMAIN_RECORDS = "domain-records"
SUBDOMAIN_RECORDS = "subdomain-records"
SITE_REPORTS = "site-reports"
SITE_TEXTS = "site-texts"
FAILURES = "failures"
MANIFEST_FIELDS = "kind string, n_rows long, n_bytes long, counts map<string,long>"


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """One JSON object per line; one file per partition."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
    return path


def write_counted(df: DataFrame, path: str, counters: Sequence[Column] = (), mode: str = "errorifexists") -> dict[str, int]:
    """Write JSON lines and return ``n_rows``, ``n_bytes`` and the given counters.

    Rows are counted by the tasks that write them, each successful task once; nothing is read again.
    """
    seen = Observation()
    write_jsonl(df.observe(seen, F.count("*").alias("n_rows"), *counters), path, mode)
    found = {name: int(n or 0) for name, n in seen.get.items()}
    return found | {"n_bytes": _written_bytes(df.sparkSession, path)}


def _written_bytes(spark: SparkSession, path: str) -> int:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength())


def write_single(df: DataFrame, path: str) -> str:
    """One object in one file; a table of several rows is refused."""
    if df.limit(2).count() > 1:
        raise ValueError("one record is written per file; this table has several")
    return write_jsonl(df.coalesce(1), path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def output_path(root: str, kind: str, job: str, run: int) -> str:
    return f"{root.rstrip('/')}/kind={kind}/job={job}/run={run}"


def manifest_path(root: str, job: str, run: int) -> str:
    """Beside the outputs, in a folder that readers of all outputs pass over."""
    return f"{root.rstrip('/')}/_manifest/job={job}/run={run}"


def record_json(df: DataFrame) -> DataFrame:
    """Records as JSON text."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
