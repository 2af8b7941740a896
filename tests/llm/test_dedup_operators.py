"""Deduplication and decontamination against brute force on small fixtures."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from dqspark.llm.common import join_on_keys  # noqa: F401  (imported by name elsewhere)
from dqspark.llm.components import connected_components
from dqspark.llm.decontaminate import contamination, without_contaminated
from dqspark.llm.repeats import maximal_repeats, remove_repeats
from dqspark.llm.simhash import keep_one_each, simhash64, simhash_components

# extra columns named like the operators' own
SCHEMA = "doc_id long, text string, _h long, n_bytes long, component_id long, _id string"


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in zip(ids, texts)], SCHEMA)


def covered(texts, n):
    bodies = [(t or "").encode() for t in texts]
    seen = {}
    for b in bodies:
        for p in range(len(b) - n + 1):
            seen[b[p:p + n]] = seen.get(b[p:p + n], 0) + 1
    out = []
    for b in bodies:
        hit = [False] * len(b)
        for p in range(len(b) - n + 1):
            if seen[b[p:p + n]] > 1:
                hit[p:p + n] = [True] * n
        kept = bytes(c for c, h in zip(b, hit) if not h)
        runs = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        out.append((len(b), sum(hit), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limits", [{}, {"tree_limit": 2}, {"tree_limit": 1, "task_limit": 1}])
def test_repeats_equal_brute_force(spark, limits):
    rng = random.Random(5)
    base = ["".join(rng.choice("abé") for _ in range(50)) for _ in range(4)]
    texts = ["".join(rng.choice([*base, "x" * 25, "ü", "yz"]) for _ in range(rng.randint(0, 10))) for _ in range(25)]
    texts += [None, "", "z" * 300, "ab" * 200, texts[3], texts[3]]
    got = remove_repeats(frame(spark, texts), min_len=70, gram=16, **limits)
    got = {r["i"]: tuple(r)[1:] for r in got.select(F.col("_row.doc_id").alias("i"), "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert [got[i] for i in range(len(texts))] == covered(texts, 70)


def test_no_task_gathers_a_hot_passage(spark, monkeypatch):
    from dqspark.llm import repeats
    spans = repeats._span_batches

    def guarded(min_len, tree_limit):
        def run(batches):
            kept = list(batches)
            seen = {}
            for b in kept:
                for key in zip(*(b.column(n).to_pylist() for n in b.schema.names if n in ("anchor", "part"))):
                    seen[key] = seen.get(key, 0) + 1
            assert max(seen.values(), default=0) <= 8
            yield from spans(min_len, tree_limit)(iter(kept))
        return run

    monkeypatch.setattr(repeats, "_span_batches", guarded)
    rng = random.Random(6)
    some = (lambda n: "".join(rng.choice("abcdefgh") for _ in range(n)))
    passage = some(150)
    texts = [some(90) + passage + some(90) for _ in range(30)] + [passage, passage]
    got = remove_repeats(frame(spark, texts), min_len=70, gram=16, tree_limit=4, task_limit=8)
    got = {r["i"]: tuple(r)[1:] for r in got.select(F.col("_row.doc_id").alias("i"), "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert [got[i] for i in range(len(texts))] == covered(texts, 70)


def test_maximal_repeats_lists_all_occurrences():
    contexts = [(b"aaXmid1", 3), (b"baXmid1", 3), (b"caXmid2", 3)]
    found = {(left, right, tuple(sorted(m))) for left, right, m in maximal_repeats(contexts, 5)}
    assert found == {(2, 3, (0, 1, 2)), (2, 4, (0, 1))}


def test_repeats_empty_table(spark):
    assert remove_repeats(frame(spark, []), keep_text=True).collect() == []


def test_fingerprint_definition():
    def plain(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    for t in ("", " \t", "One", "One TWO", "É é ß One two three\x0bfour", "a b c " * 40):
        assert simhash64(t) == plain(t)


@pytest.mark.parametrize("cell_limit", [64, 1])
def test_simhash_components_equal_brute_force(spark, cell_limit):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(150)] for _ in range(6)]
    texts = []
    for _ in range(60):
        t = list(rng.choice(base))
        if rng.random() < 0.7:
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    texts += [None, "", " ", texts[0], texts[0]]
    df = frame(spark, texts)
    fp = [simhash64(t or "") for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(fp)):
            for j in range(len(fp)):
                if (fp[i] ^ fp[j]).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    got = {r["doc_id"]: r["component_id"] for r in simhash_components(df, cell_limit=cell_limit).collect()}
    assert [got[i] for i in range(len(texts))] == root
    assert sorted(r["doc_id"] for r in keep_one_each(df).collect()) == sorted(set(root))


def test_simhash_null_and_repeated_ids(spark):
    df = frame(spark, ["a b c d", "a b c d", "a b c d", None], [None, 5, 5, None])
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash_components(df).collect())
    assert got == [("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")]
    assert sorted(str(r["doc_id"]) for r in keep_one_each(df).collect()) == ["5", "None"]
    assert simhash_components(df.limit(0)).collect() == []


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def words_of(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = ["the", "of", "É", "é", "x1", *[f"r{i}" for i in range(30)]]
    items = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (14, 10, 12, 3, 1)] + [None, "..."]
    docs = []
    for _ in range(40):
        t = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            p = words_of(rng.choice(items))
            t[len(t) // 2:len(t) // 2] = p[:rng.randint(1, 12)] * rng.randint(1, 2)
        docs.append(", ".join(t).title() if rng.random() < 0.3 else " ".join(t))
    docs += [None, "", items[0], items[0] + " " + items[0]]
    windows = {}
    for n, it in enumerate(items):
        w = words_of(it)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add(str(n))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    expected = {}
    for i, d in enumerate(docs):
        w, hit, found = words_of(d), set(), set()
        for win, its in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s:s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found |= its
        expected[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    df = frame(spark, docs)
    got = {r["doc_id"]: tuple(r)[2:7] for r in contamination(df, bench).collect()}
    assert got == expected
    near = {r["doc_id"]: r["n_near"] for r in contamination(df, bench).collect()}
    assert all(near[i] > 0 for i, e in expected.items() if e[4] and e[2] and max(len(words_of(items[int(k)])) for k in range(5)) > 1
               and e[1] >= 10)
    kept = sorted(r["doc_id"] for r in without_contaminated(df, bench).collect())
    assert kept == [i for i, e in expected.items() if not e[4]]


def test_near_matches_allow_one_altered_word(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my".split()  # three windows
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    changed = (lambda i, w: " ".join([*item[:i], w, *item[i + 1:]]))
    texts = ["x " + changed(5, "other") + " y",  # no text has zeta: all three windows lack it
             changed(4, "other"),  # lacks epsilon, which the next text has
             "epsilon and nothing else",
             " ".join([*item[:6], "one", "two", *item[6:]]),  # two more words, and no zeta missing
             "alpha x x x x beta x x x x gamma delta"]  # words too far apart
    got = {r["doc_id"]: (r["n_hit"], r["n_near"]) for r in contamination(frame(spark, texts[:3] + texts[4:]), bench).collect()}
    assert got == {0: (0, 3), 1: (0, 3), 2: (0, 0), 3: (0, 0)}
    got = {r["doc_id"]: (r["n_hit"], r["n_near"]) for r in contamination(frame(spark, texts[3:]), bench).collect()}
    assert got == {0: (0, 3), 1: (0, 0)}
    import __spark_entry__ as e
    assert "decontamination_near" in e.queries() and "decontamination_near" not in e.oracle_sql()


def test_stages_carry_any_columns(spark):
    """Columns with the operators' own names come back as they were."""
    docs = spark.createDataFrame([(1, "a b c d e", "keep", 7, 8), (2, "a b c d e", "keep", 7, 8), (2, "a b c d e", "keep", 7, 8), (3, None, "keep", 7, 8)],
                                 "doc_id long, text string, _id string, _h long, _n long")
    items = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    assert sorted(keep_one_each(docs).collect()) == [(1, "a b c d e", "keep", 7, 8), (3, None, "keep", 7, 8)]
    left = without_contaminated(docs.unionByName(spark.createDataFrame([(4, "w x y z", "no", 1, 2)], docs.schema)), items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 2, 3] and {r._id for r in left.collect()} == {"keep"}


def test_contamination_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in contamination(frame(spark, ["a b"]), bench).collect()] == [0]
    assert contamination(frame(spark, []), bench).collect() == []


def test_near_matches_meet_each_posting_once(spark, monkeypatch):
    """The near candidates come from one join of the postings, not from joins of pairs of them."""
    from dqspark.llm import decontaminate
    joins, keep = {}, decontaminate.written
    monkeypatch.setattr(decontaminate, "written", lambda df, name: joins.update({name: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")}) or keep(df, name))
    words = "one two three four five six seven eight nine ten eleven".split()
    bench = spark.createDataFrame([("i", " ".join(words[:10]))], "item_id string, text string")
    swapped = words[:4] + [words[5], words[4]] + words[6:10]
    got = {r["doc_id"]: (r["n_hit"], r["n_near"]) for r in contamination(frame(spark, [" ".join(words), " ".join(swapped), "one two three", None]), bench).collect()}
    assert got == {0: (10, 1), 1: (0, 1), 2: (0, 0), 3: (0, 0)}
    assert joins["near-candidates"] == 1


def near_by_hand(texts, items, size=10, slop=2):
    """Windows of each text by a nested loop over all starts that one of a window's two rarest words gives."""
    docs = [words_of(t) for t in texts]
    often = {}
    for w in docs:
        for x in w:
            often[x] = often.get(x, 0) + 1
    windows = {tuple(w[i:i + size]) for w in map(words_of, items) if w for i in range(max(len(w) - size, 0) + 1)}
    out = [0] * len(docs)
    for win in windows:
        lacks = int(len(win) >= 5)
        rarest = sorted((often[x], off, x) for off, x in enumerate(win) if x in often)
        if len(win) < 2 or len(rarest) < len(win) - lacks:
            continue
        for d, w in enumerate(docs):
            starts = {p - off for _, off, x in rarest[:2] for p, y in enumerate(w) if x == y}
            out[d] += any(sum(x not in w[max(s + i - slop, 0):max(s + i + slop + 1, 0)] for i, x in enumerate(win)) <= lacks for s in starts)
    return out


def test_op5_finds_near_matches_too(spark):
    """op5 runs the proximity half as well: the columns are those of its SQL, the near matches are observed."""
    import duckdb

    from dqspark.llm.queries import ORACLE, QUERIES
    from dqspark.session import scratch_path
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (16, 12, 10, 6, 4, 2, 1)] + [None, "..."]
    texts = [None, "", items[0], "unrelated", items[1] + " " + items[1]]
    for _ in range(60):
        p = words_of(rng.choice(items[:6]))
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(p))
            at = rng.randrange(4)
            if at == 0:
                p[i] = rng.choice(["other", *vocab])
            elif at == 1:
                p.insert(i, rng.choice(["other", *vocab]))
            elif at == 2 and len(p) > 1:
                del p[i]
            else:
                p.insert(rng.randint(max(i - 2, 0), i + 2), p.pop(i))
        texts.append(" ".join([*rng.choices(vocab, k=rng.randint(0, 20)), *p, *rng.choices(vocab, k=rng.randint(0, 20))]))
    # only the second rarest word gives the start: the rarest comes two places late, a word two places early, the third is missing
    items.append("k0 k1 k2 k3 k4 k5 k6 k7 k8 k9")
    texts += ["x x x k1 k0 k5 k4 k3 k6 k7 k8 k9", *["k2 k3 k4 k5 k6 k7 k8 k9"] * 3, "k2 k3 k1"]
    expected = near_by_hand(texts, items)
    assert expected[-5] == 1
    bench = [(None if n == 2 else n, t) for n, t in enumerate(items)]
    path = scratch_path(spark, "op5-near")
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    got = {r.doc_id: r.n_near for r in QUERIES["decontamination_near"](spark, path).collect()}
    assert [got[i] for i in range(len(texts))] == expected
    found = QUERIES["op5_decontamination"](spark, path)
    rows = found.collect()
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")
    sql = con.execute(ORACLE["op5_decontamination"])
    assert found.columns == [c[0] for c in sql.description]
    assert sorted(map(tuple, rows)) == sorted(sql.fetchall())
    near = found._jdf.queryExecution().observedMetrics().apply("op5_near")
    assert (near.getLong(0), near.getLong(1)) == (sum(expected), sum(n > 0 for n in expected))
    assert sum(n > 0 for n in expected) > sum(r.contaminated for r in rows) > 0
