"""TTL approvals settled by groups of change ids, against a plain loop."""

import datetime as dt
import random

from dqspark.streaming import core as ST
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "change_id string, kind string, ts timestamp, event_id long, reason string, session_id string"


def loop(events, ttl, remember):
    out = []
    for change in {e[0] for e in events}:
        created, gone = None, False
        for _, kind, ts, event, reason, _ in sorted((e for e in events if e[0] == change), key=lambda e: (e[2], e[1] != "proposal", e[3])):
            if created is not None and (ts - created).total_seconds() > ttl + remember:
                created, gone = None, False
            if kind == "proposal":
                created, gone = (ts, False) if created is None else (created, gone)
                continue
            status = ("unknown" if created is None or gone else "expired" if (ts - created).total_seconds() > ttl
                      else "no_reason" if not (reason or "").strip() else "applied")
            gone = gone or status in ("expired", "applied")
            out.append((change, event, ts, status))
    return sorted(out, key=lambda r: r[1])


def test_many_ids_in_few_groups(spark, tmp_path):
    rng = random.Random(3)
    at = (lambda n: T0 + dt.timedelta(seconds=100 * n))
    events = [(f"c{rng.randint(0, 60)}", rng.choice(["proposal", "approval"]), at(rng.randint(0, 120)), i, rng.choice(["ok", "ok", " \t", None]), "s")
              for i in range(400)]
    events += [(None, "proposal", at(3), 400, None, "s"), (None, "approval", at(4), 401, "ok", "s")]
    order = sorted(events, key=lambda e: e[2])
    folder = str(tmp_path / "in")

    def put(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    untimed = [("u", "proposal", at(200), 500, None, "s"), ("u", "approval", None, 501, "ok", "s"), ("v", "approval", None, None, "ok", "s")]
    put(order[:150])
    end = [("clock", "clock", at(900), None, None, None)]
    stream = ST.approve_within_ttl(spark.readStream.schema(SCHEMA).parquet(folder), ttl_seconds=1500, watermark="10 minutes",
                                   remember_seconds=3000, groups=2)
    got = rows(ST.run_append(stream, spark, "t-groups", [lambda: put(order[150:]), lambda: put(untimed), lambda: put(end)]))
    timed = sorted(((r["change_id"], r["event_id"], r["approved_at"], r["status"]) for r in got if r["approved_at"]), key=lambda r: r[1])
    assert timed == loop(events, 1500, 3000)
    assert {r[3] for r in timed} == {"unknown", "expired", "no_reason", "applied"}
    assert sorted((r["change_id"], r["event_id"], r["status"]) for r in got if not r["approved_at"]) == [("u", 501, "applied"), ("v", None, "unknown")]
