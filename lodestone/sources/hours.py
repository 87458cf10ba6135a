"""Hourly compressed logs as a source of Spark: spark.read.format("hours"), a reader for each file, and their ledgered ingest.

Files are named by day and hour, such as 2026-09-10-5.json.gz, and hold an event a line. They may lie in any store that Arrow opens
by its address (a shared folder, hdfs://, s3://, gs://). Each file is read as a stream, by one task: lines that hold none of the
wanted strings are passed over before they are parsed.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

NAME = re.compile(r"(\d{4}-\d{2}-\d{2})-(\d{1,2})\.json(\.gz)?")
SCHEMA = "hour string, type string, repoId bigint, nwo string, actor string, at string, tag string, prerelease boolean, bad boolean"
ARROW = pa.schema([("hour", pa.string()), ("type", pa.string()), ("repoId", pa.int64()), ("nwo", pa.string()), ("actor", pa.string()), ("at", pa.string()), ("tag", pa.string()), ("prerelease", pa.bool_()), ("bad", pa.bool_())])
AT_ONCE = 10_000


def hour_of(path: str) -> str | None:
    """2026-09-10-5 of the path of that hour's file; null for other files and for hours that a day doesn't have."""
    found = NAME.fullmatch(path.rsplit("/", 1)[-1])
    return f"{found[1]}-{int(found[2])}" if found and int(found[2]) < 24 else None


def event(line: bytes) -> dict:
    """What is kept of an event's line; bad where it isn't a JSON object. Values of another kind than expected are null."""
    try:
        x = json.loads(line)
    except ValueError:
        x = None
    if not isinstance(x, dict):
        return {"bad": True}
    within = lambda of, k: of[k] if isinstance(of.get(k), dict) else {}
    release, repo = within(within(x, "payload"), "release"), within(x, "repo")
    kept = {"type": x.get("type"), "repoId": repo.get("id"), "nwo": repo.get("name"), "actor": within(x, "actor").get("login"), "at": x.get("created_at"), "tag": release.get("tag_name"), "prerelease": release.get("prerelease")}
    kinds = {"repoId": int, "prerelease": bool}
    return {k: v for k, v in kept.items() if type(v) is kinds.get(k, str)} | {"bad": False}


class HourFile(InputPartition):
    def __init__(self, address: str, hour: str) -> None:
        self.address, self.hour = address, hour


class HoursReader(DataSourceReader):
    def __init__(self, folder: str, hours: list[str] | None, contains: list[str]) -> None:
        self.folder, self.hours, self.contains = folder.rstrip("/"), hours, [c.encode() for c in contains]

    def partitions(self) -> list[InputPartition]:
        """A partition for each file; of hours that were named, those that are there."""
        store, path = pyarrow.fs.FileSystem.from_uri(self.folder)
        names = [x.base_name for x in store.get_file_info(pyarrow.fs.FileSelector(path)) if x.is_file and hour_of(x.base_name)]
        return [HourFile(f"{self.folder}/{n}", hour_of(n)) for n in sorted(names) if self.hours is None or hour_of(n) in self.hours] or [HourFile("", "")]

    def read(self, partition: HourFile) -> Iterator[pa.RecordBatch]:
        if not partition.address:  # no file at all
            return
        store, path = pyarrow.fs.FileSystem.from_uri(partition.address)
        rows: list[dict] = []
        with store.open_input_stream(path, compression="gzip" if path.endswith(".gz") else None, buffer_size=1 << 20) as stream:
            for line in io.BufferedReader(stream, 1 << 20):
                line = line.rstrip(b"\r\n").removeprefix(b"\xef\xbb\xbf")
                if line.strip() and (not self.contains or any(c in line for c in self.contains)):
                    rows.append({"hour": partition.hour} | event(line))
                if len(rows) == AT_ONCE:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class Hours(DataSource):
    """Options: path (the folder), hours (names of hours, with commas; else all), contains (strings of which a line must hold one, with |)."""

    @classmethod
    def name(cls) -> str:
        return "hours"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        hours = self.options.get("hours")
        return HoursReader(self.options["path"], hours.split(",") if hours is not None else None, [c for c in self.options.get("contains", "").split("|") if c])


def register(spark: SparkSession) -> None:
    """Makes the format known to the session. Any DataSource with its columns can take its place under another name."""
    spark.dataSource.register(Hours)


LEDGER = "key string, state string, at timestamp, run string, rows bigint, bad bigint, error string"


def ledger_states(spark: SparkSession, path: str) -> DataFrame:
    """key, state, at, attempts, rows and bad of each unit of the ledger: its last entry, and how often it was started."""
    store, inner = pyarrow.fs.FileSystem.from_uri(path)
    log = spark.read.schema(LEDGER).parquet(path) if store.get_file_info(inner).type != pyarrow.fs.FileType.NotFound else spark.createDataFrame([], LEDGER)
    # At one instant, done or failed comes after start.
    last = F.max_by(F.struct("state", "at", "rows", "bad", "error"), F.struct("at", F.col("state") != "start"))
    return log.groupBy("key").agg(last.alias("last"), F.count_if(F.col("state") == "start").alias("attempts")).select("key", "last.*", "attempts")


def ingest(spark: SparkSession, hours: list[str], store: str, ledger: str, run: str, read: Callable[[list[str]], DataFrame], at_once: int = 24, marked: Callable[[list[str]], None] | None = None) -> list[str]:
    """Stores the rows of hours that aren't done and marks each as done once its rows are stored; the hours done by this run.

    read gives the rows of some hours, with column hour; store is a Parquet folder by hour. Hours are taken at_once at a time. An
    hour is stored by replacing its folder, so that a run that was lost before it marked an hour stores it again, not twice; what was
    marked is never read again. An hour whose reading fails is marked as failed, with the error, and the others of its batch
    are tried one by one. marked is called between storing and marking.
    """
    done = {r["key"] for r in ledger_states(spark, ledger).where("state = 'done'").select("key").collect()}
    left, finished = [h for h in dict.fromkeys(hours) if h not in done], []

    def write(rows: list[tuple]) -> None:
        log = spark.createDataFrame(rows, "key string, state string, rows bigint, bad bigint, error string")
        log.select("key", "state", F.current_timestamp().alias("at"), F.lit(run).alias("run"), "rows", "bad", "error").coalesce(1).write.mode("append").parquet(ledger)

    def take(batch: list[str]) -> None:
        write([(h, "start", None, None, None) for h in batch])
        try:
            rows = read(batch)
            rows.repartition("hour").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour").parquet(store)
            kept = spark.read.schema(rows.schema).parquet(store).where(F.col("hour").isin(batch))
            counts = {r["hour"]: (r["n"], r["bad"]) for r in kept.groupBy("hour").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad")).collect()}
        except Exception as error:  # noqa: BLE001 (whatever stops an hour is its entry in the ledger)
            if len(batch) > 1:
                for h in batch:
                    take([h])
            else:
                write([(batch[0], "failed", None, None, f"{type(error).__name__}: {error}"[:300])])
            return
        if marked:
            marked(batch)
        write([(h, "done", *counts.get(h, (0, 0)), None) for h in batch])
        finished.extend(batch)

    for k in range(0, len(left), at_once):
        take(left[k : k + at_once])
    return finished


def ingest_folder(spark: SparkSession, folder: str, hours: list[str], store: str, ledger: str, run: str, contains: str = "", **more) -> list[str]:
    """ingest() of the files of a folder. An hour without a file is done with no rows."""
    register(spark)
    return ingest(spark, hours, store, ledger, run, lambda batch: spark.read.format("hours").option("path", folder).option("hours", ",".join(batch)).option("contains", contains).load(), **more)
