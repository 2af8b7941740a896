"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.llm.byte_cnn import quality_scores
from dqspark.llm.decontaminate import contamination
from dqspark.llm.hard_negatives import hard_negatives
from dqspark.llm.html_text import extract_main_text
from dqspark.llm.packing import pack_best_two_fit
from dqspark.llm.preferences import format_preferences, weaker_answers
from dqspark.llm.quality_rules import quality_verdicts
from dqspark.llm.repeats import remove_repeats
from dqspark.llm.simhash import simhash_components
from dqspark.llm.spelling import spelling_variants, word_counts
from dqspark.llm.token_files import read_token_files, write_token_files
from dqspark.llm.tokens import count_tokens, tokenizer_digest
from dqspark.llm.toxicity import toxicity_scores
from dqspark.plans.catalog import table
from dqspark.session import lasting_path, scratch_path

#: Tokenizer of the production queries.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
MAX_TOKENS = 2048
#: Tokenizer of the binary token files.
FILE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return add


@query("op1_suffix_dedup")
def op1(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), min_len=400, keep_text=True)
    return found.select("_row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("_kept").alias("text"))


@query("op2_best_fit_packing")
def op2(spark, sf_dir):
    return pack_best_two_fit(table(spark, sf_dir, "documents"), TOKENIZER, MAX_TOKENS, end_id=0)


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i:i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
twice AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS u(k) GROUP BY rid),
s AS (SELECT w.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM w LEFT JOIN rep ON w.rid = rep.rid),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
v AS (SELECT rid, lang, source, n_words, r.rule AS rule, r.n AS n, r.unit AS unit, 1000 * r.n // r.unit AS value FROM b,
      unnest([{'rule': 'symbols', 'n': n_symbols, 'unit': n_words}, {'rule': 'dup_lines', 'n': n_dup_lines, 'unit': n_lines},
              {'rule': 'repeats', 'n': n_repeat_words, 'unit': n_words}, {'rule': 'word_length', 'n': word_chars, 'unit': n_words}]) AS u(r)
      WHERE NOT base_failed),
qg AS (SELECT lang, source, rule, count(*) AS n, list_sort(list(value)) AS s FROM v GROUP BY ALL),
ql AS (SELECT lang, rule, count(*) AS n, list_sort(list(value)) AS s FROM v GROUP BY ALL),
qa AS (SELECT rule, count(*) AS n, list_sort(list(value)) AS s FROM v GROUP BY ALL),
lim AS (SELECT g.lang, g.source, g.rule, t,
               (g.n * g.s[(t * g.n + 9) // 10] + 100 * ((l.n * l.s[(t * l.n + 9) // 10] + 100 * a.s[(t * a.n + 9) // 10]) // (l.n + 100)))
               // (g.n + 100) AS q
        FROM qg g JOIN ql l ON g.lang IS NOT DISTINCT FROM l.lang AND g.rule = l.rule JOIN qa a ON g.rule = a.rule, unnest([1, 5, 9]) AS u(t)),
lq AS (SELECT lang, source, rule, max(q) FILTER (t = 1) AS q1, max(q) FILTER (t = 5) AS q5, max(q) FILTER (t = 9) AS q9 FROM lim GROUP BY ALL),
vl AS (SELECT rid, v.rule, n, n_words, value, q1, q5, q9, (q9 + 1) * unit / CAST(1000 AS DOUBLE) AS expected,
              CASE v.rule WHEN 'repeats' THEN 6 ELSE 1 END AS step
       FROM v JOIN lq ON v.lang IS NOT DISTINCT FROM lq.lang AND v.source IS NOT DISTINCT FROM lq.source AND v.rule = lq.rule),
ok AS (SELECT rid, bool_and(CASE WHEN rule = 'word_length'
                                 THEN value BETWEEN q1 - 3 * greatest(CAST(q5 - q1 AS DOUBLE), q5 / sqrt(n_words))
                                                AND q9 + 3 * greatest(CAST(q9 - q5 AS DOUBLE), q5 / sqrt(n_words))
                                 ELSE n <= expected + 3 * sqrt(step * (expected + step)) END) AS good
       FROM vl GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(good, false) AS kept
FROM b LEFT JOIN ok ON b.rid = ok.rid
"""


@query("op3_quality_rules", OP3_SQL)
def op3(spark, sf_dir):
    return quality_verdicts(table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def op4(spark, sf_dir):
    scores = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


OP5_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, ws[i:i + 9] AS g FROM bw, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS u(i) WHERE len(ws) > 0),
lens AS (SELECT DISTINCT len(g) AS n FROM win),
dg AS (SELECT rid, i, n, ws[i:i + n - 1] AS g FROM dw, lens, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS u(i)),
m AS (SELECT DISTINCT rid, i, n, item_id FROM dg JOIN win ON dg.g = win.g),
hit AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM m, unnest(range(0, n)) AS u(k) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
       FROM m GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit ON dw.rid = hit.rid LEFT JOIN it ON dw.rid = it.rid
"""


@query("op5_decontamination", OP5_SQL)
def op5(spark, sf_dir):
    """Exact and proximity matches.  The columns are those of the SQL; the
    proximity matches are observed as ``op5_near``: ``n_near`` over all rows
    and the rows that have any (``decontamination_near`` has them by row)."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.observe("op5_near", F.coalesce(F.sum("n_near"), F.lit(0)).alias("n_near"),
                         F.count_if(F.col("n_near") > 0).alias("n_rows")).drop("_h", "n_near")


@query("decontamination_near")
def decontamination_near(spark, sf_dir):
    """The proximity matches of op 5's method, beside its exact ones."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_h")


@query("op6_html_extraction")
def op6(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op7_simhash")
def op7(spark, sf_dir):
    found = simhash_components(table(spark, sf_dir, "documents"), shingle=3, max_distance=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op8_quality_classifier")
def op8(spark, sf_dir):
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


OP9_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations),
a AS (SELECT *, CASE WHEN role = 'assistant' THEN lag(text, 1, '') OVER (PARTITION BY conv_id, role ORDER BY pos) END AS before,
             pos = max(CASE WHEN role = 'assistant' THEN pos END) OVER (PARTITION BY conv_id) AS is_last FROM t),
r AS (SELECT conv_id, pos, role, text, CASE WHEN is_last THEN before ELSE text END AS weaker FROM a),
p AS (SELECT *, count(CASE WHEN text <> weaker THEN 1 END) OVER (PARTITION BY conv_id ORDER BY pos) = 0 AS shared FROM r),
c AS (SELECT *, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' AS good, weaker || '<|end|>' AS bad FROM p),
o AS (SELECT *, coalesce(sum(length(head) + length(good) + 1) OVER (PARTITION BY conv_id, shared ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS g0,
             coalesce(sum(length(head) + length(bad) + 1) OVER (PARTITION BY conv_id, shared ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS b0 FROM c)
SELECT conv_id, count(*) FILTER (WHERE shared) AS n_prompt_turns,
       coalesce(string_agg(head || good || chr(10), '' ORDER BY pos) FILTER (WHERE shared), '') AS prompt,
       coalesce(string_agg(head || good || chr(10), '' ORDER BY pos) FILTER (WHERE NOT shared), '') AS chosen,
       coalesce(string_agg(head || bad || chr(10), '' ORDER BY pos) FILTER (WHERE NOT shared), '') AS rejected,
       coalesce(string_agg(CAST(g0 AS BIGINT) || ':' || CAST(g0 + length(good) AS BIGINT), ',' ORDER BY pos) FILTER (WHERE NOT shared AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(CAST(b0 AS BIGINT) || ':' || CAST(b0 + length(bad) AS BIGINT), ',' ORDER BY pos) FILTER (WHERE NOT shared AND role = 'assistant'), '') AS rejected_spans
FROM o GROUP BY conv_id
"""


@query("op9_chat_formatting", OP9_SQL)
def op9(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    pairs = format_preferences(conversations, weaker_answers(conversations))
    listed = (lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["first"], s["last"])), ","))
    return pairs.withColumns({c: listed(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


@query("op10_token_counts")
def op10(spark, sf_dir):
    cache = lasting_path(spark, f"token-counts-{tokenizer_digest(TOKENIZER)[:16]}")
    counts = count_tokens(table(spark, sf_dir, "documents"), TOKENIZER, cache)
    return counts.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


@query("op11_token_files")
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "token-files")
    write_token_files(docs, FILE_TOKENIZER, path)
    files = read_token_files(spark, path, docs.schema["doc_id"].dataType.simpleString())
    return files.select("doc_id", "start", "n_tokens", "ids_crc32")


OP12_SQL = r"""
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS anchor_id, b.rid AS other, b.vec_id AS id, a.label = b.label AS same,
             CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, id, other) <= 5),
n AS (SELECT p.rid, p.other, p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.rid, p.other ORDER BY s.score DESC, s.id, s.other) AS rank
      FROM p JOIN s ON p.rid = s.rid AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


OP13_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                         lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
r AS (SELECT doc_id, w, count(*) AS k
      FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents)
      WHERE length(w) >= 6 GROUP BY ALL),
x AS (SELECT w, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS hx FROM r),
h AS (SELECT w, k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(hx), 2), lambda i:
                16 * (instr('0123456789ABCDEF', hx[i]) - 1) + instr('0123456789ABCDEF', hx[i + 1]) - 1)),
                lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1]))) AS h FROM x, tab),
t AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM h),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM t WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.a = b.a AND a.z = b.z AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.a || a.z = b.word
         UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.a || a.z = b.word),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM near
         QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
f AS (SELECT v.word, v.n, CASE WHEN near_n >= 5 * v.n THEN near END AS form, coalesce(n_near, 0) AS n_near,
             CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best ON v.word = best.word),
walk AS (SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, walk.root FROM walk JOIN f ON walk.root = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, ends.root, f.n, f.n_near, f.form_n FROM f JOIN ends ON f.word = ends.word
"""


@query("op13_spelling_variants", OP13_SQL)
def op13(spark, sf_dir):
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), typo_every=199))
