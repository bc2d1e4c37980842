"""The registered queries of this folder's operators, with SQL where SQL can say them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (boosting, collocations, neighbours, packing, pieces, private_data, quality_rules, secrets, shard_order, simhash,
               spelling_variants, url_rules, wordpiece)

PIECES = "piece_bpe_32k.model"
WORD_PIECES = "word_bpe_49k.json"

# The rules that the URL query applies (host, path, action).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
             ("com", "/de/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = boosting.train(docs, table(spark, sf_dir, "labels"))
    scored = boosting.score_documents(docs.select("doc_id", "text"), trees)
    return scored.select("doc_id", boosting.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = private_data.find_private_data(docs, private_data.train(docs))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in private_data.KINDS], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))
    decimals = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimals, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         "class_distance", "word_distance")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_PIECES))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"), secrets.train())


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_shard_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_order.shard_documents(table(spark, sf_dir, "documents"), 16)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_quality_classifier, op3_private_data, op4_token_counts, op5_url_filters, op6_pieces, op7_quality_rules, op8_nearest,
    op9_packing, op10_secrets, op11_collocations, op12_shard_order,
    op13_spelling_variants)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _half_byte(i: int) -> int:
    """CRC-32 of four bits: its rule, four times."""
    for _ in range(4):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i


def _crc32(text: str) -> str:
    """SQL of the unsigned CRC-32 of a text's UTF-8 bytes, half a byte at a time."""
    table = "[" + ", ".join(str(_half_byte(i)) for i in range(16)) + "]"
    step = lambda c: f"xor(({c}) >> 4, {table}[(({c}) & 15) + 1])"
    data = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda b: ('0x' || b)::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {data}, lambda c, b: {step(step('xor(c, b)'))}), 4294967295)"


def _mix(half: str) -> str:
    return f"('0x' || substr(md5('{shard_order.KEY}:' || round || ':' || {half}), 1, 8))::BIGINT"


_RULES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)
ORACLES = {
    "op5_url_filters": f"""
WITH rules(rule_host, rule_path, action) AS (VALUES {_RULES}),
rests AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id,
    {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
best AS (SELECT host, path, arg_max(struct_pack(rule := rule_host || rule_path, action := action), length(rule_host || rule_path)) AS hit
  FROM (SELECT DISTINCT host, path FROM split) JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.action, 'allow') AS verdict FROM split LEFT JOIN best USING (host, path)""",
    "op8_nearest": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.size * c.size) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""",
    "op11_collocations": rf"""
WITH parts AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("text")}, '[.,;:!?\x0A-\x0D]')) AS part FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(part, '[ \t]+'), lambda x: x <> '') AS w FROM parts),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
phrases AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m, count(*) AS f FROM starts, (VALUES (1), (2), (3)) lengths(m)
  WHERE i + m - 1 <= len(w) GROUP BY ALL HAVING f >= 10),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
candidates AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM phrases WHERE m > 1),
cuts AS (SELECT *, k, array_to_string(w[1:k], ' ') AS lead, array_to_string(w[k + 1:], ' ') AS rest FROM candidates, (VALUES (1), (2)) cut(k) WHERE k < m),
scored AS (SELECT c.lang, c.phrase, m, a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN (SELECT lang, phrase AS lead, f FROM phrases) l USING (lang, lead) JOIN (SELECT lang, phrase AS rest, f FROM phrases) r USING (lang, rest)),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(a) AS b FROM (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, a FROM candidates, (VALUES (1), (2)) place(i)
  WHERE m = 3) GROUP BY lang, phrase)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM weakest JOIN totals USING (lang) LEFT JOIN longer USING (lang, phrase) WHERE m = 3 OR b IS NULL OR 100 * b < 50 * a QUALIFY rank <= 2000""",
    "op12_shard_order": f"""
WITH RECURSIVE described AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS i FROM described),
sides AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, floor(sqrt(count(*) - 1))::BIGINT + 1 AS a FROM documents)),
walk AS (SELECT i, 0 AS round, i // b AS l, i % b AS r FROM numbered, sides
  UNION ALL SELECT i, CASE WHEN round = {shard_order.ROUNDS} THEN 0 ELSE round + 1 END,
    CASE WHEN round = {shard_order.ROUNDS} OR round % 2 = 1 THEN l ELSE (l + {_mix("r")}) % a END,
    CASE WHEN round = {shard_order.ROUNDS} OR round % 2 = 0 THEN r ELSE (r + {_mix("l")}) % b END
  FROM walk, sides WHERE round < {shard_order.ROUNDS} OR l * b + r >= n),
placed AS (SELECT i, l * b + r AS v FROM walk, sides WHERE round = {shard_order.ROUNDS} AND l * b + r < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (v % 16)::INTEGER AS shard, v // 16 AS slot, NULL::INTEGER AS grown_shard, i AS row_number
FROM numbered JOIN placed USING (i)""",
    "op13_spelling_variants": f"""
WITH RECURSIVE runs AS (SELECT doc_id, {_LOWER.format("run")} AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, c, {_crc32("doc_id || ':' || run")} AS h FROM runs),
words AS (SELECT word, sum(c)::BIGINT AS n FROM (SELECT c, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2)
  ELSE run END AS word FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
gaps AS (SELECT word, n, left(word, i - 1) AS head, substr(word, i + 1) AS tail FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
lacks AS (SELECT DISTINCT g.word AS longer, w.word AS shorter, g.n AS longer_n, w.n AS shorter_n FROM gaps g JOIN words w ON w.word = g.head || g.tail),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION ALL SELECT longer, shorter, shorter_n FROM lacks UNION ALL SELECT shorter, longer, longer_n FROM lacks),
best AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
forms AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
ways AS (SELECT word, word AS at FROM forms UNION ALL SELECT ways.word, form FROM ways JOIN forms ON forms.word = ways.at WHERE form IS NOT NULL)
SELECT f.word, f.form, ways.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN ways USING (word) JOIN forms last ON last.word = ways.at WHERE last.form IS NULL""",
}
