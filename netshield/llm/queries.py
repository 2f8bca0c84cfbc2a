"""Registered queries of the text operators and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from netshield.llm import bpe, decontaminate, divergence, fim, licenses, minhash, neighbours, pii, preference, toxicity, urlfilter, warc
from netshield.llm import html as pages_html
from netshield.llm.common import table


#: Rules of the URL query: host, path and action.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = """
WITH rules(h, p, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path,
  (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
   ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1) AS rule,
  coalesce((SELECT action FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
   ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1), 'allow') AS verdict
FROM parts
"""


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = bpe.public_files()
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.round_trip(documents, ranks, pattern))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


OP4_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM worded WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, w[i] || coalesce(' ' || w[i + 1], '') AS s FROM placed),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, y FROM reached r JOIN ways ON x = r.other)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reached USING (doc_id) GROUP BY d.doc_id
"""


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.search(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "leaks")
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"),
                        F.transform("leaks", lambda x: x["item_id"]).alias("items"),
                        F.transform("leaks", lambda x: F.array(x["start"], x["end"], x["edits"])).alias("regions"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages_html.extract(pages).select("page_id", "url", "text", "n_chars")


def op7_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.halved_answers(table(spark, sf_dir, "conversations")))


OP7_SQL = """
WITH ends AS (SELECT conv_id, max(turn) AS final FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
joined AS (SELECT c.*, e.final FROM conversations c LEFT JOIN ends e ON c.conv_id IS NOT DISTINCT FROM e.conv_id),
sides AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM joined
  UNION ALL
  SELECT conv_id, 'rejected', turn, role,
    CASE WHEN turn = final AND role = 'assistant' THEN left(text, length(text) // 2) ELSE text END
  FROM joined WHERE final IS NULL OR turn IS NULL OR turn <= final),
rows_ AS (SELECT pair_id, side, coalesce(turn, -9223372036854775808) AS turn, coalesce(role, 'user') AS role,
  coalesce(text, '') AS text FROM sides),
apart AS (
  SELECT pair_id, min(turn) AS first_turn FROM (
    SELECT pair_id, turn, role, text FROM rows_ GROUP BY ALL
    HAVING count(*) FILTER (side = 'chosen') <> count(*) FILTER (side = 'rejected')) GROUP BY pair_id),
placed AS (
  SELECT r.*, coalesce(r.turn < a.first_turn, true) AS shared
  FROM rows_ r LEFT JOIN apart a ON r.pair_id IS NOT DISTINCT FROM a.pair_id)
SELECT pair_id, CASE WHEN shared THEN 'prompt' ELSE side END AS part, turn, role,
  '<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS rendered,
  NOT shared AND role = 'assistant' AS trained
FROM placed WHERE NOT shared OR side = 'chosen'
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.captures_of(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select("record_id", "url", "ts", "refers_to", "outcome", F.array_join(lines, "\n").alias("headers"), "digest")


OP10_SQL = r"""
WITH base AS (
  SELECT page_id AS n, url, '"' || left(md5(coalesce(html, '')), 16) || '"' AS tag, 'day ' || (page_id % 1000) AS modified,
    strlen(coalesce(html, '')) AS bytes, sha256(coalesce(html, '')) AS digest,
    regexp_replace(url, '#.*$', '') AS bare FROM pages),
named AS (
  SELECT *, regexp_extract(substr(bare, instr(bare, '://') + 3), '^([^/?]*)', 1) AS host,
    regexp_replace(regexp_extract(substr(bare, instr(bare, '://') + 3), '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN
      ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref', 'sessionid'))) AS params
  FROM base),
keyed AS (
  SELECT *, regexp_replace(lower(host), '^www\.', '') || path
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical FROM named),
revisits AS (
  SELECT *, n * 2 + 1 AS record_id, n * 10 + 5 + (n * 7 % 50) * 10 AS ts, bare || '#again' AS shown,
    CASE WHEN n % 5 = 0 THEN NULL WHEN n % 7 = 0 THEN '"other"' WHEN n % 11 = 0 THEN 'W/' || tag ELSE tag END AS sent_tag,
    CASE WHEN n % 5 <> 0 THEN NULL WHEN n % 10 = 0 THEN 'never' ELSE modified END AS sent_date FROM keyed),
met AS (
  SELECT r.record_id, r.shown, r.ts, r.n, r.sent_tag, r.sent_date, b.n AS base_n, b.tag, b.modified, b.bytes, b.digest,
    CASE WHEN r.sent_tag IS NOT NULL THEN regexp_replace(r.sent_tag, '^W/', '') = b.tag
         ELSE r.sent_date = b.modified END AS agree
  FROM revisits r ASOF LEFT JOIN (SELECT *, n * 10 AS ts FROM keyed) b ON r.canonical = b.canonical AND r.ts > b.ts)
SELECT record_id, shown AS url, ts, CASE WHEN agree THEN base_n * 2 END AS refers_to,
  CASE WHEN base_n IS NULL THEN 'missing' WHEN agree THEN 'resolved' ELSE 'changed' END AS outcome,
  CASE WHEN agree THEN 'content-length: ' || bytes || chr(10) || 'content-type: text/html' || chr(10) || 'date: at ' || n || chr(10)
         || 'etag: ' || coalesce(sent_tag, tag) || chr(10) || 'last-modified: ' || coalesce(sent_date, modified)
       ELSE 'content-length: 0' || chr(10) || 'date: at ' || n || chr(10)
         || coalesce('etag: ' || sent_tag, 'last-modified: ' || sent_date) END AS headers,
  CASE WHEN agree THEN digest END AS digest
FROM met
"""


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",)))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
placed AS (SELECT k, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM placed GROUP BY ALL HAVING count(DISTINCT k) >= 30),
sources AS (SELECT DISTINCT lang, source FROM d),
used AS (SELECT lang, source, term, count(*) AS n FROM placed SEMI JOIN kept USING (lang, term) GROUP BY ALL),
full_ AS (
  SELECT s.lang, s.source, k.term, coalesce(u.n, 0) AS n, k.n AS lang_n FROM sources s JOIN kept k USING (lang)
  LEFT JOIN used u ON u.lang = s.lang AND u.source = s.source AND u.term = k.term),
shares AS (
  SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER g + 5 * count(*) OVER g) AS p,
    1 + (1000000000::HUGEINT * (lang_n + 5)) // (sum(lang_n) OVER g + 5 * count(*) OVER g) AS q
  FROM full_ WINDOW g AS (PARTITION BY lang, source)),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
  row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 50
"""


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    starts = F.transform("base", lambda d: d["start"])
    return found.select("doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
                        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        licenses.labels("base").alias("base_labels"), licenses.labels("base", "detections").alias("labels"),
                        licenses.score().alias("score"), "detections")


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fim.arrange(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = fim.restore(fim.render(docs).drop("text"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256",
                        F.sha2("restored", 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
units AS (
  SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM hashed),
cuts AS (
  SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units),
parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
    coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM cuts)
SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(p || m || s) AS restored_sha256
FROM parts
"""


QUERIES = {"op1_urlfilter": op1_urlfilter, "op2_neighbours": op2_neighbours, "op3_toxicity": op3_toxicity, "op4_minhash": op4_minhash, "op5_decontamination": op5_decontamination, "op6_html": op6_html, "op7_preference": op7_preference, "op8_bpe": op8_bpe,
           "op9_pii": op9_pii, "op10_warc": op10_warc, "op11_divergence": op11_divergence, "op12_licenses": op12_licenses, "op13_fim": op13_fim,
           "pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {"op1_urlfilter": OP1_SQL, "op4_minhash": OP4_SQL, "op7_preference": OP7_SQL, "op10_warc": OP10_SQL,
                           "op11_divergence": OP11_SQL, "op13_fim": OP13_SQL}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
