"""The queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from shelfwise.llm import (
    alignment,
    decontam,
    fim,
    html_text,
    licenses,
    mixing,
    quality,
    sharding,
    simhash,
    substrings,
    tokenfiles,
    urls,
    vectors,
)
from shelfwise.llm.tables import table


def op1_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    return decontam.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=1)


def op3_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_simhash(spark, sf_dir):
    return simhash.simhash_report(table(spark, sf_dir, "documents"))


def op5_html(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_embeddings(spark, sf_dir):
    return vectors.link_report(table(spark, sf_dir, "embeddings"))


def op7_urls(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_quality(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_substrings(spark, sf_dir):
    return substrings.passage_report(table(spark, sf_dir, "documents"))


def op10_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark, sf_dir):
    return fim.fim_report(table(spark, sf_dir, "documents"))


def op12_alignment(spark, sf_dir):
    return alignment.alignment_report(table(spark, sf_dir, "documents"))


def op13_token_files(spark, sf_dir):
    return tokenfiles.token_report(table(spark, sf_dir, "documents"))


MIXING_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight,
         source_size::DOUBLE * 3 AS cap FROM sums
), leveled AS (
  SELECT *, ((SELECT sum(source_size) FROM sums)::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size, greatest(least(cap, (SELECT max(level) FROM leveled) * weight), 0.0)::DOUBLE AS target FROM leveled
), units AS (
  SELECT source, doc_id, sum(size)::BIGINT AS size FROM sizes GROUP BY source, doc_id
), line AS (
  SELECT u.source, u.doc_id,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size * 4294967296.0)::HUGEINT ELSE 0 END AS step,
    sum(CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size * 4294967296.0)::HUGEINT ELSE 0 END)
      OVER (PARTITION BY u.source ORDER BY u.size, md5(coalesce(u.doc_id::VARCHAR, '')), u.doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      + ('0x' || substr(md5('42|' || coalesce(u.source, '')), 1, 8))::BIGINT AS until
  FROM units u JOIN targets t ON u.source IS NOT DISTINCT FROM t.source
)
SELECT s.doc_id, s.size, t.source_size, t.target,
  ((l.until // 4294967296 - (l.until - l.step) // 4294967296) * s.size)::BIGINT AS taken
FROM sizes s
JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
JOIN line l ON s.source IS NOT DISTINCT FROM l.source AND s.doc_id IS NOT DISTINCT FROM l.doc_id
"""

# What is restored is the text itself, so the digest of the text is what it must equal.
# Lengths that may be missing are doubles here, as Spark hands such columns to pandas.
FIM_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), drawn AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM units
), placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
         coalesce(array_to_string(u[b + 1:n], ''), '') AS s
  FROM placed
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(p) END::DOUBLE AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::DOUBLE AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_licenses": op3_licenses,
    "op4_simhash": op4_simhash,
    "op5_html": op5_html,
    "op6_embeddings": op6_embeddings,
    "op7_urls": op7_urls,
    "op8_quality": op8_quality,
    "op9_substrings": op9_substrings,
    "op10_sharding": op10_sharding,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_alignment": op12_alignment,
    "op13_token_files": op13_token_files,
}

ORACLE_SQL = {"op1_mixing": MIXING_SQL, "op11_fill_in_middle": FIM_SQL}
