"""History, sessions, keyed state, and sources that are read as streams."""

import json
import random
import sys
import threading
from datetime import date, datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gazetta.operators import history as H
from gazetta.sources import live
from gazetta.streaming import sessions, states

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors don't see this module

T0 = datetime(2026, 4, 1)


def changes(rng, n):
    keys = ["hot"] * 6 + ["a", "b", None]
    return [(i, rng.choice(keys), T0 + timedelta(hours=rng.randint(0, 600)) if rng.random() < 0.97 else None, rng.choice(["x", "y", None])) for i in range(n)]


@pytest.mark.parametrize("stretch", [3600, 86_400, 10**9])
def test_as_of(spark, stretch):
    rng = random.Random(1)
    rows, versions = changes(rng, 300), changes(rng, 200)
    schema = "n long, key string, at timestamp, v string"
    got = H.as_of(spark.createDataFrame(rows, schema), spark.createDataFrame(versions, schema), ["key"], "at", "at", ["n"], stretch).collect()
    assert len(got) == len(rows)
    for r in got:
        before = [v for v in versions if v[1] == r.key and r.key is not None and r["at"] is not None and v[2] is not None and v[2] <= r["at"]]
        want = max(before, key=lambda v: (v[2], v[0]), default=None)
        assert (r.version and r.version.n) == (want and want[0])


@pytest.mark.parametrize("stretch", [3600, 10**9])
def test_intervals(spark, stretch):
    rows = [r for r in changes(random.Random(2), 300) if r[2] is not None]
    df = H.intervals(spark.createDataFrame(rows, "n long, key string, at timestamp, v string"), ["key"], "at", ["v"], ["n"], stretch)
    want = []
    for key in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        firsts = [r for i, r in enumerate(own) if i == 0 or own[i - 1][3] != r[3]]
        want += [(key, r[3], r[2], firsts[i + 1][2] if i + 1 < len(firsts) else None) for i, r in enumerate(firsts)]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
    when = T0 + timedelta(hours=300)
    now = {r.key: r.v for r in H.at_time(df, F.lit(when)).collect()}
    assert now == {k: max((r for r in rows if r[1] == k and r[2] <= when), key=lambda r: (r[2], r[0]))[3] for k in {r[1] for r in rows}}
    assert H.intervals(df.limit(0).select(F.lit(1).alias("n"), "key", F.col("valid_from").alias("at"), "v"), ["key"], "at", ["v"]).count() == 0


def test_sessions_of_a_stream_with_late_and_repeated_rows(spark, tmp_path):
    schema = "id long, user string, ts timestamp"
    at = lambda h: T0 + timedelta(hours=h)
    batches = [
        [(1, "a", at(0)), (2, "a", at(1)), (2, "a", at(1)), (3, "b", at(2))],
        [(4, "a", at(9)), (5, "b", at(60))],
        [(6, "a", at(3)), (3, "b", at(2)), (7, "b", at(61))],  # behind the watermark by now
        [(8, "c", at(200))],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        found = sessions.sessions(events, ["user"], "ts", "2 hours", "10 hours", ["id"])
        query = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        assert (sessions.late_rows(query) > 0) == (i == 2)
    got = sorted((r.user, r["first"], r["last"], r.events) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    kept = [r for k, rows in enumerate(batches[:3]) for r in rows if k < 2 or r[2] > at(50)]
    batch = sessions.sessions(spark.createDataFrame(kept, schema), ["user"], "ts", "2 hours", ids=["id"])
    assert got == sorted((r.user, r["first"], r["last"], r.events) for r in batch.collect()) and ("a", at(0), at(1), 2) in got


def events(spark, path, *rows):
    spark.createDataFrame([("s", k, pos, T0 + timedelta(hours=pos), kind, f"t{pos}" if kind == "detected" else None, None, error) for k, pos, kind, error in rows], states.EVENT).coalesce(1).write.mode("append").parquet(path)


def test_states_and_timers(spark, tmp_path):
    landed, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def run():
        states.start(spark, landed, out, mark, 3_600_000, "10 hours").awaitTermination(60)
        return {r.source_item_key: (r.title, r.status, r.error_message, r.attempts, r.due) for r in states.current(spark, out).collect()}

    events(spark, landed, ("a", 2, "detected", None), ("a", 1, "detected", None), ("b", 3, "detected", None), ("b", 4, "outcome", "gone"))
    assert run() == {"a": ("t2", "DISCOVERED", None, 0, False), "b": ("t3", "FAILED", "gone", 1, False)}
    # older events change nothing
    events(spark, landed, ("a", 6, "outcome", None), ("a", 5, "outcome", "late"), ("c", 1, "outcome", None))
    assert run() == {"a": ("t2", "FETCHED", None, 2, False), "b": ("t3", "FAILED", "gone", 1, False), "c": (None, "FETCHED", None, 1, False)}
    # the watermark passes b's timer
    events(spark, landed, ("c", 30, "detected", None))
    assert run()["b"] == ("t3", "FAILED", "gone", 1, True)
    events(spark, landed, ("b", 32, "outcome", None), ("b", 31, "detected", None), ("b", 1, "detected", None))
    assert run()["b"] == ("t31", "FETCHED", None, 2, False)


ASKED = []


class Feeds(BaseHTTPRequestHandler):
    """The JSON feed: an item for each day that is asked for."""

    def do_GET(self):
        query = parse_qs(urlparse(self.path).query)
        first, last = (datetime.strptime(query[x][0], "%d-%m-%Y").date() for x in ("fromDate", "toDate"))
        ASKED.append((first, last))
        days = [first + timedelta(n) for n in range((last - first).days + 1)]
        body = json.dumps({"data": [{"circNumber": str(d)} for d in days]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Feeds)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def days_of(rows):
    return [d["circNumber"] for r in rows for d in json.loads(r.body)["data"]]


def test_conditions_become_requests(spark, site):
    live.register(spark)
    ASKED.clear()
    df = spark.read.format("gazetta_feed").option("base", site).option("days", 31).load()
    df = df.where("feed = 'json' AND first >= DATE '2025-01-01' AND last <= DATE '2026-02-08'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan.replace("pushedFilters", "PushedFilters") or "feed" in plan
    assert df.rdd.getNumPartitions() == 14
    assert len(set(days_of(df.collect()))) == 404
    assert min(a for a, _ in ASKED) == date(2025, 1, 1) and max(b for _, b in ASKED) == date(2026, 2, 8) and all((b - a).days < 31 for a, b in ASKED)
    with pytest.raises(Exception, match="name the days"):
        spark.read.format("gazetta_feed").option("base", site).load().collect()


@pytest.mark.parametrize("overlap", [0, 1])
def test_stream_of_days(spark, site, tmp_path, overlap):
    live.register(spark)

    def run(to):
        stream = spark.readStream.format("gazetta_feed").option("feed", "json").option("base", site).option("from", "2026-04-01").option("to", to).option("overlap", overlap).option("days", 3).load()
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted(days_of(spark.read.parquet(str(tmp_path / "out")).collect()))

    day = lambda a, b: [f"2026-04-{d:02d}" for d in range(a, b + 1)]
    assert run("2026-04-05") == day(1, 5)
    assert run("2026-04-05") == day(1, 5)  # nothing new
    assert run("2026-04-09") == sorted(day(1, 9) + day(5, 5) * overlap)


def test_item_states_take_rows_not_frames():
    class Item:
        kept = None

        def exists(self):
            return self.kept is not None

        def get(self):
            return self.kept

        def update(self, values):
            self.kept = values

    class Handle:
        item, timers = Item(), []

        def getValueState(self, *_):
            return self.item

        def registerTimer(self, at):
            self.timers.append(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    own, handle = states.Lifecycle(1000), Handle()
    own.init(handle)
    row = lambda pos, kind, error=None: {"pos": pos, "kind": kind, "title": f"t{pos}", "pdf_url": None, "error": error, "millis": pos}
    (told,) = own.handleInputRows(("s", "k"), iter([row(3, "outcome", "late"), row(2, "detected"), row(1, "outcome")]), None)
    assert tuple(told) == ("s", "k", "t2", None, "FAILED", "late", 2, False) and handle.timers == [1003]
    (told,) = own.handleInputRows(("s", "k"), iter([row(5, "outcome"), row(0, "detected")]), None)
    assert tuple(told) == ("s", "k", "t2", None, "FETCHED", None, 3, False) and not handle.timers
