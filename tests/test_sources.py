"""Hourly logs as a source, their ledgered ingest, and candidates with timers."""

import gzip
import json
import time
from datetime import datetime, timedelta, timezone

import pytest

from lodestone.sources import hours
from lodestone.streaming import candidates


@pytest.fixture
def folder(tmp_path):
    def line(i, kind="ReleaseEvent", **more):
        return json.dumps({"type": kind, "repo": {"id": i, "name": f"o/r{i}"}, "actor": {"login": f"u{i}"}, "created_at": "2026-09-10T05:00:00Z", "payload": {"release": {"tag_name": "v1", "prerelease": False}}} | more)

    logs = tmp_path / "logs"
    logs.mkdir()
    for h in range(3):
        with gzip.open(logs / f"2026-09-10-{h}.json.gz", "wb") as f:
            f.write("".join(line(100 * h + i) + ("\r\n" if i % 2 else "\n") for i in range(5)).encode() + b'\n{"type": "ReleaseEvent", torn\n[1]\n' + line(9, "PushEvent").encode())
    (logs / "2026-09-10-5.json").write_bytes(b"\xef\xbb\xbf" + line(500, payload=7, actor=None, repo={"id": "x", "name": 3}).encode())
    (logs / "2026-09-10-24.json").write_text(line(1))
    (logs / "notes.txt").write_text("x")
    return str(logs)


def test_hours_are_read_in_parts(spark, folder):
    hours.register(spark)
    everything = spark.read.format("hours").option("path", folder).load()
    assert everything.rdd.getNumPartitions() == 4 and everything.count() == 25
    found = spark.read.format("hours").option("path", folder).option("hours", "2026-09-10-1,2026-09-10-5,2026-09-11-0").option("contains", "ReleaseEvent|nothing").load().collect()
    assert sum(r["bad"] for r in found) == 1 and sorted(r["repoId"] for r in found if r["repoId"] is not None) == [100, 101, 102, 103, 104]
    odd = next(r for r in found if r["hour"] == "2026-09-10-5")
    assert (odd["type"], odd["repoId"], odd["nwo"], odd["actor"], odd["tag"], odd["prerelease"], odd["bad"]) == ("ReleaseEvent", None, None, None, None, None, False)
    assert [hours.hour_of(x) for x in ("a/2026-09-10-05.json", "2026-09-10-24.json", "2026-09-10-1.json.gz.tmp")] == ["2026-09-10-5", None, None]


def test_a_lost_run_resumes(spark, folder, tmp_path):
    store, ledger = str(tmp_path / "store"), str(tmp_path / "ledger")
    names = [f"2026-09-10-{h}" for h in (0, 1, 2, 5, 7)]

    class Lost(BaseException):
        pass

    def lose(batch):
        if "2026-09-10-2" in batch:
            raise Lost

    with pytest.raises(Lost):  # rows of the second batch are stored, but not marked
        hours.ingest_folder(spark, folder, names, store, ledger, "run 1", at_once=2, marked=lose)
    states = {r["key"]: (r["state"], r["rows"]) for r in hours.ledger_states(spark, ledger).collect()}
    assert states == {"2026-09-10-0": ("done", 8), "2026-09-10-1": ("done", 8), "2026-09-10-2": ("start", None), "2026-09-10-5": ("start", None)}
    again = hours.ingest_folder(spark, folder, names, store, ledger, "run 2", at_once=2)
    assert again == names[2:], [r["error"] for r in hours.ledger_states(spark, ledger).where("error IS NOT NULL").collect()]
    assert spark.read.parquet(store).groupBy("hour").count().count() == 4 and spark.read.parquet(store).count() == 25
    states = {r["key"]: (r["state"], r["attempts"], r["rows"], r["bad"]) for r in hours.ledger_states(spark, ledger).collect()}
    assert states["2026-09-10-2"] == ("done", 2, 8, 2) and states["2026-09-10-7"] == ("done", 1, 0, 0) and states["2026-09-10-0"] == ("done", 1, 8, 2)
    assert hours.ingest_folder(spark, folder, names, store, ledger, "run 3") == []


def test_a_bad_hour_fails_alone(spark, folder, tmp_path):
    store, ledger = str(tmp_path / "store"), str(tmp_path / "ledger")
    with open(f"{folder}/2026-09-10-1.json.gz", "wb") as f:
        f.write(b"not gzip at all")
    done = hours.ingest_folder(spark, folder, [f"2026-09-10-{h}" for h in range(3)], store, ledger, "r")
    assert done == ["2026-09-10-0", "2026-09-10-2"]
    failed = hours.ledger_states(spark, ledger).where("state = 'failed'").collect()
    assert [(r["key"], r["attempts"]) for r in failed] == [("2026-09-10-1", 2)] and failed[0]["error"]
    assert spark.read.parquet(store).count() == 16


def test_timers_bring_back(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    soon, far = now + timedelta(seconds=2), now + timedelta(days=3)
    rows = [("a", "seen", now, None), ("a", "deferred", now + timedelta(milliseconds=1), soon), ("b", "deferred", now, far), ("c", "seen", now, None), ("d", "start", now, None), ("d", "failed", now + timedelta(milliseconds=1), None), ("e", "start", now, None), ("e", "done", now + timedelta(milliseconds=1), None)]
    rows += [("f", k, now + timedelta(milliseconds=i), None) for i, k in enumerate(["start", "failed", "start", "failed"])]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, candidates.INPUT).coalesce(1).write.json(source)
    stream = candidates.followed(spark.readStream.schema(candidates.INPUT).json(source), most_attempts=2, base=timedelta(seconds=1))
    got: list = []
    query = stream.writeStream.outputMode("update").foreachBatch(lambda batch, _: got.extend(map(tuple, batch.collect()))).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while time.time() < until and not {("a", "time"), ("d", "retry")} <= {(r[0], r[2]) for r in got}:
            time.sleep(1)
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    first = {r[0]: r[1:4] for r in reversed(got)}
    assert first == {"a": ("deferred", "deferred", 0), "b": ("deferred", "deferred", 0), "c": ("queued", "seen", 0), "d": ("failed", "failed", 1), "e": ("done", "done", 1), "f": ("failed", "failed", 2)}
    assert {(r[0], r[1], r[2]) for r in got} - {(k, *v[:2]) for k, v in first.items()} == {("a", "queued", "time"), ("d", "queued", "retry")}
