"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from dqspark.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n long, key string, _id int"


def counts(rows, typo_every=199, least=5):
    total = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if typo_every and h % typo_every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 6:
                total[w] += 1
    return {w: n for w, n in total.items() if n >= least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(n):
    near = {w: [v for v in n if v != w and one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], SCHEMA).repartition(4)


def variants(words):
    return sorted((tuple(r) for r in S.spelling_variants(words).collect()), key=lambda r: r[0])


@pytest.mark.parametrize("block", [512, 3])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "WORDS_HELD", 50)
    rng = random.Random(4)
    stems = ["".join(rng.choice("ab\u00e9\u00dfEz\u00c9") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(80):
            w = stems[min(int(rng.expovariate(0.1)), 59)]
            if rng.random() < 0.25:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "a", "b", "\u00e9" + w[at]]) + w[at + 1:]
            words.append(w)
        rows.append((i, rng.choice([" ", "-", "1", "\u0161"]).join(words)))
    rows += [(None, "nullid " * 9), (5, None), (6, ""), (7, "x" * 5000 + " short five5 " * 3), (8, "same row"), (8, "same row")]
    rows += [(20 + i, "y" * 300 + " " + "y" * 299 + "z " + "y" * 301) for i in range(6)]
    rows += [(i, "straight " * 40 + "straigt " * 6 + "straihgt") for i in range(3)]
    rows += [(50 + i, "chainlink " + "chainlinks " * 6 + "chainlinksy " * 33) for i in range(5)]  # forms in a chain
    want = counts(rows)
    words = S.word_counts(frame(spark, rows), typo_every=199)
    assert {r.word: r.n for r in words.collect()} == want
    got = variants(words)
    assert got == brute(want)
    assert sum(r[1] is not None for r in got) > 20 and any(r[1] not in (None, r[2]) for r in got)


def test_typos_are_planted_at_the_stated_place(spark):
    rows = [(i, f"wordnumber{chr(97 + i % 26)} " * 5) for i in range(3000)]
    got = {r.word: r.n for r in S.word_counts(frame(spark, rows), typo_every=199).collect()}
    assert got == counts(rows) and any(len(w) < 11 for w in got)


def test_reachable_profiles():
    rng = random.Random(2)
    for _ in range(2000):
        a = "".join(rng.choice("abcdefghi") for _ in range(rng.randint(1, 6)))
        at = rng.randrange(len(a))
        b = a[:at] + rng.choice(["", "c"]) + a[at + rng.randint(0, 1):]
        if one_edit(a, b):
            p, q = S._profile(a), S._profile(b)
            assert q in S.reachable(p) or p in S.reachable(q)


def test_long_text_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "LISTED", 10)
    assert {r.word: r.n for r in S.word_counts(frame(spark, [(1, "letters letters " * 9)])).collect()} == {"letters": 18}
    assert variants(S.word_counts(frame(spark, []))) == []
    one = spark.createDataFrame([("single", 5)], "word string, n long")
    assert variants(one) == [("single", None, "single", 5, 0, None)]
