"""Ordered application of lists of changes against a plain loop."""

import datetime as dt
import random

from dqspark.operators import changes as C
from tests.conftest import rows

PROPOSALS = "change_id string, created_at timestamp, error string, rules array<struct<name:string,errors:array<string>>>, status string"
REQUESTS = "request_id long, requested_at timestamp, reason string, change_ids array<string>, attempt int"
T0 = dt.datetime(2024, 1, 1)


def loop(proposals, requests, ttl):
    known = {p[0]: (p[1], p[2], p[3] or [], p[0], 0) for p in proposals}
    taken, out = set(), []
    for rid, at, reason, ids, _ in sorted(requests, key=lambda r: (r[1], r[0])):
        halted = not (reason or "").strip()
        for pos, cid in enumerate(ids or []):
            row = [rid, pos, cid, "not_attempted", None, None, None, None]
            out.append(row)
            if halted:
                continue
            if cid not in known or known[cid][0] > at or cid in taken:
                row[3], halted = "unknown", True
                continue
            created, error, rules, root, k = known[cid]
            taken.add(cid)
            if (at - created).total_seconds() > ttl:
                row[3], halted = "expired", True
            elif error is not None:
                row[3], halted = "error", True
            else:
                failed = [(n, e[1:]) for n, e in rules if e and e[0] is not None]
                row[3:7] = "applied", "applied" if not failed else "partially applied" if len(failed) < len(rules) else "not applied", len(rules), len(failed)
                if failed:
                    row[7] = f"{root}~{k + 1}"
                    known[row[7]] = (at, None, failed, root, k + 1)
    return sorted(map(tuple, out))


def test_equals_a_loop(spark):
    rng = random.Random(11)
    at = (lambda h: T0 + dt.timedelta(seconds=600 * h))
    proposals = [(f"c{i}", at(rng.randint(0, 20)), rng.choice([None, None, None, "no"]),
                  rng.choice([None, [(f"r{j}", [None if rng.random() < .2 else "x"] * rng.randint(0, 3)) for j in range(rng.randint(0, 3))]]), "x")
                 for i in range(40)]
    names = [p[0] for p in proposals] + [f"c{i}~{k}" for i in range(40) for k in (1, 1, 2)]
    requests = [(i, at(rng.randint(0, 24)), rng.choice(["why", "why", "why", "  ", None]),
                 rng.choice([None, [], [rng.choice(names[:60]) for _ in range(rng.randint(1, 6))], [n for c in rng.sample(names[:40], 3) for n in (c, c + "~1", c + "~2")]]), 1)
                for i in range(120)]
    requests += [(900 + i, at(30), "all ask for one", ["c0"], 1) for i in range(200)]
    p, r = spark.createDataFrame(proposals, PROPOSALS), spark.createDataFrame(requests, REQUESTS)
    got = C.apply_in_order(p, r, ttl_seconds=6000)
    want = loop(proposals, requests, 6000)
    assert sorted(tuple(x) for x in got.collect()) == want
    assert {w[3] for w in want} == {"applied", "unknown", "expired", "error", "not_attempted"} and any(w[2].endswith("~2") and w[3] == "applied" for w in want)


def test_summary_and_empty(spark):
    p = spark.createDataFrame([("a", T0, None, None, ""), ("b", T0, "no", None, ""), ("c", T0, None, None, "")], PROPOSALS)
    r = spark.createDataFrame([(1, T0, "x", ["a", "b", "c"], 0), (2, T0, "x", ["c"], 0), (3, T0, " ", ["c"], 0), (4, T0, "x", [], 0), (5, T0, "x", None, 0)], REQUESTS)
    s = rows(C.request_summary(C.apply_in_order(p, r), r), ["request_id"])
    assert [tuple(x.values()) for x in s] == [(1, 3, 1, "stopped_on_error", "b"), (2, 1, 1, "applied", None), (3, 1, 0, "invalid", None),
                                              (4, 0, 0, "invalid", None), (5, 0, 0, "invalid", None)]
    assert rows(C.apply_in_order(p.limit(0), r.limit(0))) == []
    assert {x["status"] for x in rows(C.apply_in_order(p.limit(0), r))} == {"unknown", "not_attempted"}


def test_rounds_hold_what_can_change(spark, monkeypatch):
    """Rules, items after a sure failure and repeated proposals take no part in the rounds."""
    stored, keep = [], C._stored
    monkeypatch.setattr(C, "_stored", lambda df, name: stored.append((name, keep(df, name))) or stored[-1][1])
    rules = [("r", ["no", None]), ("s", [None])]
    p = spark.createDataFrame([("a", T0, None, rules, ""), ("a", T0, None, rules, ""), ("b", T0, "no", None, ""), ("c", T0, None, None, "")], PROPOSALS)
    r = spark.createDataFrame([(1, T0, "x", ["a", "a~1", "b", "c"], 0), (2, T0, "x", ["c", "a~2"], 0), (3, T0, None, ["c"], 0)], REQUESTS)
    got = rows(C.apply_in_order(p, r), ["request_id", "position"])
    assert [(g["change_id"], g["status"], g["n_rules"], g["n_failed"], g["retry_id"]) for g in got] == [
        ("a", "applied", 2, 1, "a~1"), ("a~1", "applied", 1, 0, None), ("b", "error", None, None, None), ("c", "not_attempted", None, None, None),
        ("c", "applied", 0, 0, None), ("a~2", "unknown", None, None, None), ("c", "not_attempted", None, None, None)]
    rounds = [df for name, df in stored if name == "changes-judged"]
    assert rounds and all("rules" not in df.columns and df.count() == 5 for df in rounds)
