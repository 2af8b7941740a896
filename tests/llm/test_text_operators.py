"""Tokens, packing, quality rules, models, pages and chat on small fixtures."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from dqspark.llm import byte_cnn  # noqa: E402
from dqspark.llm.html_text import extract_main_text, page_blocks, page_text  # noqa: E402
from dqspark.llm.packing import pack_best_two_fit, plan_two_fit  # noqa: E402
from dqspark.llm.preferences import format_preferences, weaker_answers  # noqa: E402
from dqspark.llm.quality_rules import base_stats, quality_verdicts  # noqa: E402
from dqspark.llm.tokens import TextTokenizer, count_tokens  # noqa: E402
from dqspark.llm.toxicity import toxicity_scores  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "Hello, World!", "naïve Éclair ß ﬁ ½", "a b c\x1cd\x85e", "don't I'LL 3rd 1,000.5", "x<|endoftext|>y <|startoftext|>",
       "İSTANBUL Σίσυφος ΟΔΟΣ été", "日本語 テキスト 🙂", "%%% --- <|> a|b", "word " * 50, "A" * 300, "\n\t \r"]


def library_ids(texts):
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(PATH)
    return [e.ids for e in tk.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_tokenizer_equals_library():
    tok = TextTokenizer(PATH, cache=5)
    assert tok.drops_space
    assert [np.frombuffer(tok.ids(t or ""), "<u4").tolist() for t in ODD] == library_ids(ODD)
    plain = TextTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert not plain.drops_space and len(plain.ids("two  spaces")) // 4 == len(plain._lib.encode("two  spaces").ids)


def test_count_tokens_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(ODD + ["word  " * 50])] + [(None, "Hello, World!", 0, "x")],
                               "doc_id long, text string, n_tokens long, digest string")
    cache = str(tmp_path / "cache")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in count_tokens(df, PATH, cache).collect()}
    expected = {i: (len((t or "").encode()), len(x)) for (i, t), x in zip(enumerate(ODD), library_ids(ODD))}
    assert {k: v for k, v in got.items() if k in expected} == expected and got[None][1] == expected[2][1]
    stored = spark.read.parquet(cache)
    n = stored.count()
    assert n == stored.select("digest").distinct().count() < df.count()
    count_tokens(df, PATH, cache).collect()
    assert spark.read.parquet(cache).count() == n  # nothing left to encode
    assert count_tokens(df.limit(0), PATH, cache).collect() == []


def test_plan_is_a_packing_and_near_the_bound():
    rng = random.Random(2)
    counts = Counter(min(64, int(rng.expovariate(1 / 14)) + 1) for _ in range(3000))
    plan = plan_two_fit(dict(counts), 64)
    used = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 64
        for x in lengths:
            used[x] += times
    assert used == counts
    assert sum(t for _, t in plan) <= 1.02 * -(-sum(k * v for k, v in counts.items()) // 64)
    assert plan_two_fit({}, 64) == []


def test_exchange_fills_better_than_greedy():
    # greedy: 6 + 3 leaves 1; exchanging 3 for 2 + 2 fills the bin
    assert plan_two_fit({6: 1, 3: 1, 2: 2}, 10)[0][0] == [6, 2, 2]


def test_packing_round_trip(spark):
    texts = ODD + ["lorem ipsum dolor " * n for n in range(1, 40)]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, length long")
    out = pack_best_two_fit(df, PATH, 32, with_ids=True).collect()
    ids = {i: x + [0] for i, x in enumerate(library_ids(texts))}
    parts = {}
    for r in out:
        body = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(body) == r["length"] and r["start"] == 32 * r["piece"]
        parts.setdefault(r["doc_id"], {})[r["piece"]] = body
    assert {i: sum((p[k] for k in sorted(p)), []) for i, p in parts.items()} == ids
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= 32
    assert pack_best_two_fit(df.limit(0), PATH, 32).collect() == []


def plain_stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = Counter(zip(w, w[1:], w[2:]))
    cov = {i + k for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov)


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ab", "cde", "f", "gh%"]) for _ in range(rng.randint(0, 90))) + rng.choice(["", "\nx y\nx y\n \n"])
             for _ in range(60)] + ["a b c", "a b c a b c", "a a a a", "\x0b  x", "é🙂 " * 60, None, ""]
    df = spark.createDataFrame([(i, t, "en" if i % 3 else None, "s", 7) for i, t in enumerate(texts)],
                               "doc_id long, text string, lang string, source string, n_words long")
    got = {r["doc_id"]: tuple(r)[1:6] for r in quality_verdicts(df).collect()}
    assert [got[i] for i in range(len(texts))] == [plain_stats(t) for t in texts]
    assert quality_verdicts(df.limit(0)).collect() == []
    assert base_stats(df.drop("n_words")).filter("n_words < 50 and not base_failed").count() == 0


def test_quality_threshold_adapts(spark):
    words = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)]
    noisy = " ".join(f"%%% v{j}" for j in range(60))
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate([*words, noisy])], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_verdicts(df).collect()}
    assert all(kept[i] for i in range(40)) and not kept[40]


def test_alike_rows_with_long_words_stay(spark):
    df = spark.createDataFrame([(i, " ".join(f"{j:03d}" + "x" * 154 for j in range(60)), "en", "s") for i in range(120)],
                               "doc_id long, text string, lang string, source string")
    assert quality_verdicts(df).filter("kept").count() == 120


def test_quality_limits_follow_the_group(spark):
    """The same symbols are ordinary in one source and out of range in
    another; copies of a rare line count against the lines of a text."""
    words = (lambda i, n: " ".join(f"w{chr(97 + (i * 7 + k) % 26)}{chr(97 + k % 23)}x{k}" for k in range(n)))
    code = (lambda i, n: " ".join(f"{w} {{}}|".replace("{}", "#" if k % 3 else "%") for k, w in enumerate(words(i, n).split())))
    data = [(i, words(i, 60 + i % 9), "prose", "en") for i in range(300)]
    data += [(1000 + i, code(i, 60 + i % 9), "code", "en") for i in range(300)]
    data += [(2000, code(5, 64), "prose", "en"), (2001, words(3, 64), "code", "en"), (2002, words(3, 64) + " # $", "prose", "en")]
    lines = "\n".join([words(9, 30)] + [f"{words(k, 3)} z{k}" for k in range(9)] + ["same w q"] * 9)
    data += [(2003, lines, "prose", "en"), (2004, words(1, 80), None, None), (2005, None, None, None)]
    df = spark.createDataFrame(data, "doc_id int, text string, source string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in quality_verdicts(df).collect()}
    assert sum(kept[i] for i in range(300)) == 300 and sum(kept[1000 + i] for i in range(300)) == 300
    assert (kept[2000], kept[2001], kept[2002]) == (False, True, True)
    assert (kept[2003], kept[2004], kept[2005]) == (False, True, False)


def labelled(spark, bad, good, n=240):
    rng = random.Random(4)
    rows = [(i, (bad if i % 4 == 0 else good)(rng), i % 4 == 0) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (None, "", "x")], "doc_id long, text string, score string")
    return docs, spark.createDataFrame([(i, int(y), int(not y)) for i, _, y in rows], "doc_id long, toxic int, quality int")


def test_toxicity_held_out(spark):
    word = (lambda rng: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))))
    good = (lambda rng: " ".join(word(rng) for _ in range(80)))
    bad = (lambda rng: good(rng) + " " + " ".join(rng.choice(["zgrumpf", "zgrumpfig", "kvaxo"]) for _ in range(5)))
    docs, labels = labelled(spark, bad, good)
    got = {r["doc_id"]: r for r in toxicity_scores(docs, labels).collect()}
    assert len(got) == 242 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i in held)
    assert np.mean([(got[i]["score"] >= 0.7) == (i % 4 == 0) for i in held]) >= 0.95
    assert toxicity_scores(docs.limit(0), labels).collect() == []
    assert toxicity_scores(docs, labels.limit(0)).count() == 242


def test_every_word_scores_by_its_own_grams(spark, monkeypatch):
    from dqspark.llm import toxicity
    monkeypatch.setattr(toxicity, "SLOTS", 64)  # far fewer than the words, so that all share a slot
    monkeypatch.setattr(toxicity, "SLICE", 2_000)  # fewer than the grams
    word = (lambda rng: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))))
    good = (lambda rng: " ".join(word(rng) for _ in range(80)))
    bad = (lambda rng: good(rng) + " " + " ".join(rng.choice(["zgrumpf", "zgrumpfig", "kväxo", "qa" * 90]) for _ in range(5)))
    docs, labels = labelled(spark, bad, good)
    docs = docs.unionByName(docs.filter("doc_id = 4"))
    few = sorted((r["doc_id"] or -1, round(r["score"], 9)) for r in toxicity_scores(docs, labels).collect())
    monkeypatch.undo()
    many = sorted((r["doc_id"] or -1, round(r["score"], 9)) for r in toxicity_scores(docs, labels).collect())
    assert len(few) == 243 and few == many

    sample = toxicity.bounded_labels(labels, "toxic", 10_000)
    counted = toxicity.word_counts(docs, sample, "doc_id", "text")
    ratios = toxicity.log_ratios(toxicity.gram_counts(counted)).cache()
    of = {r["gram"]: (r["first"], r["full"]) for r in ratios.collect()}
    got = {r["word"]: (r["first"], r["full"]) for r in toxicity.word_scores(counted, ratios).collect()}
    texts = {w for r in docs.collect() for w in (r["text"] or "").split()}
    for w in texts:
        bound = "^" * (toxicity.ORDER - 1) + w + "$"
        sums = [sum(of[bound[i:i + toxicity.ORDER]][k] for i in range(len(w) + 1)) for k in (0, 1)]
        beyond = [max(0, s - toxicity.DEAD_ZONE) - max(0, -s - toxicity.DEAD_ZONE) for s in sums]
        assert np.allclose(got.get(toxicity.word_key(w), (0, 0)), beyond, atol=1e-9)


def test_quality_classifier_held_out(spark):
    word = (lambda rng: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))))
    good = (lambda rng: " ".join(word(rng) for _ in range(60)))
    bad = (lambda rng: " ".join(word(rng) + "%%%" for _ in range(60)))
    docs, labels = labelled(spark, bad, good)
    got = {r["doc_id"]: r for r in byte_cnn.quality_scores(docs, labels).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(got) == 242 and np.mean([(got[i]["score"] >= 0.5) == (i % 4 != 0) for i in held]) >= 0.95
    assert byte_cnn.quality_scores(docs.limit(0), labels).collect() == []


def test_network_sees_every_byte():
    net = byte_cnn.new_network()
    data = np.frombuffer(bytes(random.Random(0).randrange(256) for _ in range(3 * byte_cnn.CHUNK + 17)), np.uint8)
    e = net["embed"][data]
    full = np.stack([e[i:i + byte_cnn.WIDTH].ravel() for i in range(len(data) - byte_cnn.WIDTH + 1)]) @ net["filters"]
    assert np.allclose(byte_cnn.chunk_maxima(net, data).max(axis=0), np.maximum(full.max(axis=0), 0), atol=1e-5)


def test_training_sees_every_chunk(spark, monkeypatch):
    seen = []

    def train(texts, labels, weights):
        seen.append({b"".join([t[0], *(c[byte_cnn.WIDTH - 1:] for c in t[1:])]) for t in texts})
        return byte_cnn.new_network()

    monkeypatch.setattr(byte_cnn, "train", train)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc é") for _ in range(n)) for n in (0, 3, 8, 1017, 1018, 1024, 1025, 9_000, 20_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int")
    byte_cnn.quality_scores(docs, labels).collect()
    assert seen == [{t.encode() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 3 != 1}]
    for t in texts[2:]:
        assert len(byte_cnn.text_chunks(t.encode())) == len(byte_cnn.chunk_maxima(byte_cnn.new_network(), np.frombuffer(t.encode(), np.uint8)))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id=main><div class="post-12 entry"><h1>Head &amp; line</h1><p>First   <b>bold</b>&nbsp;part<br>more.<p>Second &lt;x&gt; caf&#233;.
<ul><li>one<li>two</ul><div class="ad-slot">Buy!</div><aside>Aside</aside><form>Mail <input></form></div>
<div class="comments"><p>I disagree, and at length, with all that was said above here.</p></div></div><footer>&copy; x</footer></body></html>"""


def test_page_text():
    assert page_text(page_blocks(PAGE), None) == "Head & line\n\nFirst bold part more.\n\nSecond <x> café.\n\none\n\ntwo"


LONG = "A sentence of an article that is long enough to be read as a paragraph by anyone who reads it, number %d."


def test_marks_inside_articles_are_judged_by_the_host(spark):
    """Class words that name a subject do not drop article text, an article's
    own header stays, and what is short or all links goes, as do comments."""
    def page(i, social):
        return (f"<header class='site'>Site {i}</header><article><header><h1>Title {i}</h1></header><p>{LONG % i}"
                f"<div class='social history'>{social}</div><div class='share'><a href='#'>Share {i}</a> now</div>"
                f"<div class='comments'><p>{LONG % (i + 90)}</div><div class='ad'>Buy {i}</div></article>"
                f"<div class='related'><p>{LONG % (i + 60)}</div><footer>end</footer>")

    body = (lambda i: f"<h2>Past</h2><p>{LONG % (i + 30)}")
    pages = [(i, "http://a.b/", page(i, body(i))) for i in range(5)] + [(5, "http://a.b/", page(5, "<p>Short."))]
    pages += [(6, "http://c.d/", page(6, "<a href='/'>Friends</a>")), (7, "http://c.d/", page(7, "<a href='/'>Friends</a>"))]
    pages += [(8, "http://e.f/", f"<div class='notice'><p>{LONG % 8}</div>")]
    got = dict(extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string"))
               .select("page_id", "text").collect())
    for i in range(5):
        assert got[i] == f"Title {i}\n\n{LONG % i}\n\nPast\n\n{LONG % (i + 30)}"
    assert got[5] == f"Title 5\n\n{LONG % 5}\n\nShort."
    assert got[6] == f"Title 6\n\n{LONG % 6}" and got[7] == f"Title 7\n\n{LONG % 7}"
    assert got[8] == LONG % 8


def test_malformed_pages_do_not_fail():

    rng = random.Random(8)
    bits = ["<", ">", "![", "]]>", "<!", "<!--", "-->", "<?", "/", "p", "div", "article", " class='a", "'", '"', "=", "&#x;", "&amp", "&#99999999;",
            "<script>", "</script", "<![foo bar]]>", "<!DOCTYPE", "text ", "\0", "<p>", "</div>", "<td>", "<![if !IE]>", "<!ENTITY % x [", "]"]
    for _ in range(3000):
        html = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        page_text(page_blocks(html), None)
    assert "kept words" in page_text(page_blocks("<p>before</p><![foo bar]]><p>kept words</p>"), None)


def test_host_consensus_and_edges(spark):
    pages = [(1, "http://a.b/1", PAGE, "x"), (2, "http://A.b:80/2", PAGE.replace("post-12", "post-77"), "x"), (3, None, None, "x"),
             (4, "bad url", "", "x"), (4, "bad url", "plain text &amp; no tags", "x"), (5, "http://c/", "<p>a<div><p>b</div", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, path string")
    got = sorted((r["page_id"], r["text"]) for r in extract_main_text(df).collect())
    assert got[0][1] == got[1][1] and got[0][1].startswith("Head & line") and "disagree" not in got[0][1]
    assert got[2:5] == [(3, ""), (4, ""), (4, "plain text & no tags")] and "b" in got[5][1]
    assert extract_main_text(df.limit(0)).collect() == []


def test_preference_prefix_and_spans(spark):
    t = "conv_id long, turn long, role string, text string, chosen string"
    turns = [(1, 0, "user", "q", ""), (1, 1, "assistant", "first", ""), (1, 2, "user", "again", ""), (1, 3, "assistant", "good é", ""),
             (2, 0, "user", "only", ""), (None, 0, "assistant", None, ""), (3, 0, "assistant", "a", ""), (3, 0, "assistant", "a", "")]
    df = spark.createDataFrame(turns, t)
    got = {r["conv_id"]: r for r in format_preferences(df, weaker_answers(df)).collect()}
    assert set(got) == {1, 2, 3, None}
    r = got[1]
    assert r["n_prompt_turns"] == 3 and r["prompt"].count("<|") == 6 and r["prompt"].endswith("again<|end|>\n")
    assert [r["chosen"][s["first"]:s["last"]] for s in r["chosen_spans"]] == ["good é<|end|>"]
    assert [r["rejected"][s["first"]:s["last"]] for s in r["rejected_spans"]] == ["first<|end|>"]
    assert got[2]["chosen"] == got[2]["rejected"] == "" and got[2]["n_prompt_turns"] == 1
    assert format_preferences(df.limit(0), df).collect() == []


def test_entry_lists_one_query_per_operator():
    import __spark_entry__ as e
    names = e.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)
