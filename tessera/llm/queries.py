"""A query for each operator over the synthetic tables, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import decontamination, embeddings, linededup, packing, quality, sentencepiece, sharding, simhash, urls, warc
from .shared import read_table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(read_table(spark, sf_dir, "pages"))
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_documents(read_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(read_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    own = (op1_sharding, op2_packing, op3_embedding_dedup, op4_warc, op5_quality, op6_sentencepiece, op7_url_filter, op8_line_dedup, op9_simhash, op10_decontamination)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
  UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node
), least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links,
  least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e JOIN least ON least.node = e.vec_id
"""

OP4 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

OP8 = f"""
WITH lines AS (
  SELECT doc_id, source, line, pos FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL)
), pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
often AS (
  SELECT l.source, trim(l.line) AS line FROM lines l JOIN pages p ON l.source IS NOT DISTINCT FROM p.source
  WHERE trim(l.line) <> '' GROUP BY l.source, trim(l.line), p.pages
  HAVING count(DISTINCT l.doc_id) >= {linededup.REPEATED}
    AND count(DISTINCT l.doc_id) > {linededup.RATIO}::DOUBLE * p.pages
), judged AS (
  SELECT l.*, o.line IS NOT NULL AS gone FROM lines l
  LEFT JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND trim(l.line) = o.line
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text,
    count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped FROM judged GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  coalesce(k.n_lines, 0)::INTEGER AS n_lines, coalesce(k.n_dropped, 0)::INTEGER AS n_dropped
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


_K, _U = len(quality.NAMES), float(quality.UNIT)
_LEAST, _MOST = quality.WEIGHTS


def _weight_sql(groups: str, parent: str) -> str:
    """Documents that a prior is worth, as a query of one number."""
    rate = f"s / {_U} / n"
    return f"""SELECT CASE WHEN g < 2 OR free <= 0 OR (q - v) / {_U} / free <= 0 THEN {_MOST}
      ELSE least(greatest(round(nv / {_U} / total / ((q - v) / {_U} / free) - 1, 6), {_LEAST}), {_MOST}) END FROM (
      SELECT sum(CAST(round(n * ({rate} - {parent}) * ({rate} - {parent}) * {_U}) AS BIGINT)) AS q,
        sum(CAST(round({parent} * (1 - {parent}) * {_U}) AS BIGINT)) AS v,
        sum(CAST(round({parent} * (1 - {parent}) * n * {_U}) AS BIGINT)) AS nv,
        sum(n) AS total, sum(n) - sum(n * n) / sum(n) AS free, count(*) AS g FROM {groups})"""


def _rate_sql(own: str, one: str) -> str:
    """A section's shrunk rate without ``one`` document of probability ``own``."""
    host = f"((host_s - {own}) / {_U} + (FROM m1) * mean) / (host_n - {one} + (FROM m1))"
    return f"greatest(least(((s - {own}) / {_U} + (FROM m2) * ({host})) / (n - {one} + (FROM m2)), 1 - 1e-6), 1e-6)"


_SOURCE = "coalesce(source, '')"
_gone = lambda chars: f"(length(t) - length(translate(t, {chars}, '')))"
_bin = lambda x: f"CAST(least(floor({x}), {quality.BINS - 1}) AS INTEGER)"
_p = lambda rate: f"round(1 / (1 + exp(-(ev + ln({rate} / (1 - {rate}))))), 6)"
OP5 = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, split_part({_SOURCE}, '/', 1) AS host,
    CASE WHEN contains({_SOURCE}, '/') THEN split_part({_SOURCE}, '/', 2) ELSE coalesce(lang, '') END AS section,
    greatest(length(coalesce(text, '')), 1) AS n, string_split(coalesce(text, ''), ' ') AS words FROM documents
), f AS (
  SELECT doc_id, host, section, [
    {_bin(f"{_gone(f"'{quality.SYMBOLS}'")} * 100 / n")},
    {_bin(f"{_gone("'ABCDEFGHIJKLMNOPQRSTUVWXYZ'")} * 100 / n / 2")},
    {_bin(f"length(t) / ({_gone("' ' || chr(10)")} + 1)")},
    {_bin(f"{_gone("'.,'")} * 100 / n")},
    {_bin("ln(n) / ln(2)")},
    {_bin(f"len(list_distinct(words)) * {quality.BINS} / len(words)")}] AS f FROM t
), known AS (
  SELECT doc_id, min(quality) AS label FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id
), trained AS (SELECT f.f, known.label FROM f JOIN known ON f.doc_id = known.doc_id),
total AS (SELECT count(*) FILTER (WHERE label = 1) AS good, count(*) FILTER (WHERE label = 0) AS bad FROM trained),
counts AS (
  SELECT k, f[k] AS bin, count(*) FILTER (WHERE label = 1) AS good, count(*) FILTER (WHERE label = 0) AS bad
  FROM trained, (SELECT unnest(range(1, {_K + 1})) AS k) GROUP BY k, f[k]
), grid AS (SELECT k, b FROM (SELECT unnest(range(1, {_K + 1})) AS k) CROSS JOIN (SELECT unnest(range(0, {quality.BINS})) AS b)),
odds AS (
  SELECT grid.k, list(round(ln((coalesce(c.good, 0) + 1) / (total.good + {quality.BINS})) - ln((coalesce(c.bad, 0) + 1) / (total.bad + {quality.BINS})), 6) ORDER BY grid.b) AS o
  FROM grid CROSS JOIN total LEFT JOIN counts c ON c.k = grid.k AND c.bin = grid.b GROUP BY grid.k
), ev AS (
  SELECT doc_id, host, section, greatest(least(0.0::DOUBLE + {" + ".join(f"(SELECT o FROM odds WHERE k = {k})[f[{k}] + 1]" for k in range(1, _K + 1))}, {quality.EVIDENCE_LIMIT}), -{quality.EVIDENCE_LIMIT}) AS ev,
    (SELECT round(ln((good + 1) / (bad + 1)), 6) FROM total) AS prior FROM f
), guessed AS (
  SELECT *, CAST(round(1 / (1 + exp(-(ev + prior))) * {_U}) AS BIGINT) AS y FROM ev
), cells AS (SELECT host, section, sum(y) AS s, count(*) AS n FROM guessed GROUP BY host, section),
mean AS (SELECT least(greatest(sum(s) / {_U} / sum(n), 1e-6), 1 - 1e-6) AS mean FROM cells),
hosts AS (SELECT host, sum(s) AS s, sum(n) AS n, any_value(mean) AS mean FROM cells, mean GROUP BY host),
m1 AS ({_weight_sql("hosts", "mean")}),
sections AS (
  SELECT cells.host, section, cells.s, cells.n, hosts.s AS host_s, hosts.n AS host_n, mean,
    (hosts.s / {_U} + (FROM m1) * mean) / (hosts.n + (FROM m1)) AS host_rate FROM cells JOIN hosts USING (host)
),
m2 AS ({_weight_sql("sections", "host_rate")}),
rates AS (
  SELECT doc_id, host, section, ev, mean, {_rate_sql("0", "0")} AS site_rate, {_rate_sql("y", "1")} AS rate
  FROM guessed JOIN sections USING (host, section)
)
SELECT doc_id, host, section, {_p("mean")} AS p_doc, round(site_rate, 6) AS site_rate, {_p("rate")} AS p_good,
  {_p("rate")} >= {quality.THRESHOLD} AS keep
FROM rates
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": OP3, "op4_warc": OP4, "op5_quality": OP5, "op8_line_dedup": OP8}
