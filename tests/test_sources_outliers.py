"""Brute-force checks for the operators whose registered queries are checked
by rows only: outlier fences (Q11), object listing (S4) and CSV sampling (S3)."""

import math
import os
import random
import tempfile
from collections import Counter

from dqspark.operators import profile as P
from dqspark.sources import tables as TB

from conftest import rows


def _fences(values, k):
    s = sorted(values)
    n = len(s)
    q1, q3 = s[max(1, math.ceil(0.25 * n)) - 1], s[max(1, math.ceil(0.75 * n)) - 1]
    return q1 - k * (q3 - q1), q3 + k * (q3 - q1)


def test_outlier_check_matches_bruteforce(spark):
    """On inputs smaller than the sketch accuracy the quantiles are exact
    (value at rank ceil(q*n)), so fences and outlier counts are checked
    against plain Python."""
    rnd = random.Random(7)
    data = [(float(rnd.randint(40, 60)), None if i % 9 == 0 else float(rnd.choice([1, 2, 3, 100, 2, 3])))
            for i in range(300)]
    data += [(500.0, 2.0), (500.0, -80.0), (-3.0, 2.0)]
    df = spark.createDataFrame(data, "a double, b double")
    got = {(r["column_name"], r["value"]): r["n"] for r in rows(P.outlier_check(df, ["a", "b"], k=1.5))}
    exp = Counter()
    for i, c in enumerate(("a", "b")):
        vals = [r[i] for r in data if r[i] is not None]
        lo, hi = _fences(vals, 1.5)
        exp.update((c, v) for v in vals if v < lo or v > hi)
    assert got == dict(exp) and ("a", 500.0) in got


def test_list_objects_metadata_and_truncation(spark):
    folder = tempfile.mkdtemp(prefix="dq-list-")
    sizes = {}
    for i in range(5):
        p = os.path.join(folder, f"part-{i}.parquet")
        with open(p, "wb") as f:
            f.write(b"x" * (10 * i + 1))
        sizes[p] = 10 * i + 1
    with open(os.path.join(folder, "notes.txt"), "w") as f:
        f.write("skip me")
    some = rows(TB.list_objects(spark, folder, max_keys=3, glob="*.parquet"), ["key"])
    assert len(some) == 3 and all(r["is_truncated"] for r in some)
    assert [r["key"].endswith(f"part-{i}.parquet") for i, r in enumerate(some)] == [True] * 3
    every = rows(TB.list_objects(spark, folder, max_keys=50, glob="*.parquet"), ["key"])
    assert len(every) == 5 and not any(r["is_truncated"] for r in every)
    assert sorted(r["size"] for r in every) == sorted(sizes.values())


def test_sample_csv_header_ragged_rows_and_quoted_newlines(spark):
    folder = tempfile.mkdtemp(prefix="dq-csv-")
    with open(os.path.join(folder, "t.csv"), "w", encoding="utf-8") as f:
        f.write('id,name,note\n1,alpha,"two\nlines"\n2,beta\n3,gamma,ok,extra\n4,delta,d\n')
    got = rows(TB.sample_csv(spark, folder, limit=3))
    assert [r["id"] for r in got] == ["1", "2", "3"]
    assert got[0]["note"] == "two\nlines"                 # quoted newline kept inside the field
    assert got[1]["note"] is None                         # short row: missing cell is null
    assert got[2]["note"] == "ok" and set(got[2]) == {"id", "name", "note"}   # extra cell dropped
    assert len(rows(TB.sample_csv(spark, folder, limit=500))) == 4            # limit clamped to 50
