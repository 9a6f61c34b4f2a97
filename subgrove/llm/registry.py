"""Queries of this package and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_rotation import perspective_rotation
from .components import stored
from .decontamination import decontaminate
from .importance_resampling import importance_resampling
from .line_templates import line_templates
from .ngram_jaccard import ngram_jaccard
from .quality_kernel import quality_scores
from .quality_rules import BASE, POLICIES, Policy, judged, ledger
from .simple8b import read_token_files, write_token_files
from .stupid_backoff import stupid_backoff
from .substring_dedup import substring_dedup
from .toxic_spans import toxic_spans, train
from .vector_packing import best_fit_packing
from .whitening import fit_whitening, whitened


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op4_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_token_files(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, path, with_ids=False)


def op3_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perspective_rotation(_table(spark, sf_dir, "conversations"))
    spans = F.concat_ws(",", F.transform("spans", lambda s: F.concat(s["start"], F.lit("-"), s["end"])))
    return out.withColumn("spans", spans)


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(stored(ledger(_table(spark, sf_dir, "documents"))), POLICIES["v2"])
    base = F.col("failed").bitwiseAND(F.lit(Policy("base", BASE).mask)) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed", "failed_alone", "policy")


def held_out() -> Column:
    """Rows that no model learns from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op7_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train(docs, _table(spark, sf_dir, "labels"), ~held_out())
    return toxic_spans(docs, model, threshold=0.3).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_templates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_recurring", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(_table(spark, sf_dir, "documents"), n=5, similarity=(75, 100))


def op10_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stupid_backoff(_table(spark, sf_dir, "documents"), backoff=0.4, min_count=2)
    return out.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance_resampling(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), share=(5, 100))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    model = fit_whitening(vectors, k=4)
    rows = whitened(vectors, model).select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    n, error, shares = (model.n, model.identity_error, model.explained()) if model else (0, 0.0, [])
    explained = F.get(F.array(*(F.lit(x).cast("double") for x in shares)).cast("array<double>"), F.col("place"))
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def unseen() -> Column:
    """Rows that the quality model does not learn from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op13_quality_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~unseen(), threshold=0.5)
    return out.select("doc_id", F.coalesce(unseen(), F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op4_simple8b": op4_simple8b,
    "op3_perspective_rotation": op3_perspective_rotation,
    "op6_rule_ledger": op6_rule_ledger,
    "op5_decontamination": op5_decontamination,
    "op8_line_templates": op8_line_templates,
    "op7_toxic_spans": op7_toxic_spans,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_stupid_backoff": op10_stupid_backoff,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_quality_kernel": op13_quality_kernel,
}

ORACLE = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h
      FROM d, unnest(range(1, len(w) - 33)) AS t(i) WHERE len(w) >= 35),
r AS (SELECT doc_id, i FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)),
x AS (SELECT doc_id, list_sort(list_distinct(list(i + k))) AS gone FROM r, range(35) AS t(k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w
         ELSE list_filter(w, lambda y, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
""",
    "op3_perspective_rotation": r"""
WITH n AS (SELECT conv_id AS c, row_number() OVER () AS r, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS s, coalesce(text, '') AS x FROM conversations),
t AS (SELECT c AS conv_id, CASE WHEN c IS NULL THEN r END AS lone, turn, s, x FROM n),
p AS (SELECT DISTINCT conv_id, lone, s AS perspective FROM t WHERE s <> 'system'),
v AS (SELECT t.conv_id, t.lone, perspective, turn, s, x, s = perspective AS mine,
        '<|turn|>' || CASE WHEN s = 'system' THEN 'system' WHEN s = perspective THEN 'assistant' ELSE 'user name=' || s END || chr(10) AS head,
        x || '<|end|>' || chr(10) AS body FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.lone IS NOT DISTINCT FROM p.lone),
e AS (SELECT *, sum(length(head) + length(body)) OVER o AS e, row_number() OVER o AS k FROM v
      WINDOW o AS (PARTITION BY conv_id, lone, perspective ORDER BY turn, s, x ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, CAST(0 AS BIGINT) AS chunk, count(*) AS n_turns, string_agg(head || body, '' ORDER BY k) AS rendered,
       coalesce(string_agg((e - length(body)) || '-' || (e - 1), ',' ORDER BY k) FILTER (mine), '') AS spans
FROM e GROUP BY conv_id, lone, perspective
""",
    "op6_rule_ledger": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ \t\n\x0B\f\r]')) AS l FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS t(i) WHERE len(w) >= 5),
r AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(5) AS t(k) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
      FROM d LEFT JOIN c USING (doc_id)),
f AS (SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (100 * n_symbols > 10 * greatest(n_words, 1))::INT
        + 8 * (100 * n_dup_lines > 30 * greatest(n_lines, 1))::INT + 16 * (word_chars < 2 * n_words)::INT
        + 32 * (word_chars > 25 * greatest(n_words, 1))::INT AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed, CASE WHEN bit_count(failed) = 1 THEN failed ELSE 0 END AS failed_alone, 'v2' AS policy FROM f
""",
    "op9_ngram_jaccard": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id
      JOIN n AS x ON x.doc_id = a.doc_id JOIN n AS y ON y.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
""",
    "op10_stupid_backoff": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS c
      FROM d, unnest(range(1, len(w) + 1)) AS r(i)),
c1 AS (SELECT a, count(*) AS n FROM t GROUP BY a),
c2 AS (SELECT b, a, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY b, a),
c3 AS (SELECT c, b, a, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY c, b, a),
s AS (SELECT t.doc_id, t.i, c1.n AS n1, p1.n AS m1, c2.n AS n2, p2.n AS m2, c3.n AS n3,
        CASE WHEN c3.n >= 2 THEN 3 WHEN c2.n >= 2 THEN 2 ELSE 1 END AS o
      FROM t JOIN c1 ON c1.a = t.a LEFT JOIN c1 AS p1 ON p1.a = t.b LEFT JOIN c2 ON c2.b = t.b AND c2.a = t.a
      LEFT JOIN c2 AS p2 ON p2.b = t.c AND p2.a = t.b LEFT JOIN c3 ON c3.c = t.c AND c3.b = t.b AND c3.a = t.a),
g AS (SELECT doc_id, count(*) AS n_words, sum(CASE o WHEN 3 THEN ln(n3 / m2) WHEN 2 THEN ln(n2 / m1)
        ELSE ln(n1) - ln((SELECT count(*) FROM t)) END + ln(0.4) * (least(i, 3) - o)) AS l,
        count(*) FILTER (o = 3) AS n_trigram, count(*) FILTER (o = 2) AS n_bigram, count(*) FILTER (o = 1) AS n_unigram
      FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(l, 0.0), 4) AS log_score, round(l / n_words, 6) AS mean_log_score,
       coalesce(n_trigram, 0) AS n_trigram, coalesce(n_bigram, 0) AS n_bigram, coalesce(n_unigram, 0) AS n_unigram
FROM d LEFT JOIN g USING (doc_id)
""",
    "op11_importance_resampling": r"""
WITH poly AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS t(i)),
steps AS (SELECT list(c ORDER BY i) AS crc FROM poly),
d AS (SELECT 0 AS kind, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
f AS (SELECT kind, doc_id, array_to_string(w[i:i + m - 1], ' ') AS g FROM w, unnest(range(1, len(w) + 1)) AS t(i), range(1, 4) AS r(m) WHERE i + m - 1 <= len(w)),
c AS (SELECT g, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM f GROUP BY g),
b AS (SELECT g, s, t, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(rtrim(regexp_replace(hex(encode(g)), '(..)', '\1 ', 'g')), ' '), lambda h: ('0x' || h)::BIGINT)),
        lambda a, x: xor(a >> 8, steps.crc[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS b FROM c, steps),
n AS (SELECT r.b, coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM range(10000) AS r(b) LEFT JOIN b USING (b) GROUP BY r.b),
gain AS (SELECT b, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM n),
x AS (SELECT doc_id, count(*) AS n_features, sum(gain) AS weight FROM f JOIN b USING (g) JOIN gain USING (b) WHERE kind = 0 GROUP BY doc_id),
scored AS (SELECT w.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || w.doc_id), 8))::BIGINT + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM w LEFT JOIN x USING (doc_id) WHERE kind = 0),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 5 * n // 100 THEN k END AS rank FROM scored LEFT JOIN r USING (doc_id)
""",
}
