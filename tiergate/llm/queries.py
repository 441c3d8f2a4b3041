"""Registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tiergate.llm import (
    best_fit_packing,
    centroid_clustering,
    fill_in_middle,
    host_quality_rules,
    license_scan,
    line_dedup,
    pii,
    quality_classifier,
    simhash_dedup,
    source_mixing,
    topk_search,
    url_filter,
    warc_archive,
)
from tiergate.llm.common import read_table
from tiergate.registry import register


@register("op1_simhash_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS rn, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS a FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.rn, q.vec_id AS query_id, c.vec_id, list_inner_product(q.a, c.a)::BIGINT AS score
  FROM v q JOIN v c ON c.rn <> q.rn AND len(c.a) = len(q.a) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@register("op2_topk_search", TOP_K_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk_search.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


@register("op3_license_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@register("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return quality_classifier.classify(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))


@register("op10_source_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_counts(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


@register("op5_url_filter")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages", "page_id", "url"))


@register("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@register("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(read_table(spark, sf_dir, "documents", "doc_id", "text"))


HOST_RULES_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), grams AS (
  SELECT doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS p FROM w WHERE len(ws) > 3)
), twice AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    word_chars < 3 * greatest(n_words, 1) OR word_chars > 14 * greatest(n_words, 1) OR n_symbols * 10 > word_chars AS soft_failed
  FROM m
), h AS (
  SELECT source, count(*) AS n, sum((base_failed OR soft_failed)::INT) AS k FROM b GROUP BY source
), prior AS (
  SELECT m, CASE WHEN v > 0 THEN greatest(1.0, least(d, m * (1 - m) / v - 1)) ELSE d END AS s
  FROM (SELECT avg(k / n) AS m, var_pop(k / n) AS v, avg(n) AS d FROM h)
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (h.k + s * m) / (h.n + s) <= 0.6 AS kept
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source, prior
"""


@register("op6_host_quality_rules", HOST_RULES_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality_rules.judge(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


LINE_DEDUP_SQL = """
WITH cut AS (
  SELECT doc_id, text, source, string_split(text, chr(10)) AS ls FROM documents
), every AS (
  SELECT doc_id, coalesce(source, chr(0)) AS site, unnest(generate_series(0, len(ls) - 1)) AS pos, trim(unnest(ls), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM cut
), spread AS (
  SELECT line, count(DISTINCT site) AS n_sites, min((doc_id, pos)) AS first FROM every WHERE line <> '' GROUP BY line
), gone AS (
  SELECT e.doc_id, list(e.pos ORDER BY e.pos) AS drops
  FROM every e JOIN spread s ON e.line = s.line WHERE s.n_sites >= 5 AND (e.doc_id, e.pos) <> s.first GROUP BY e.doc_id
)
SELECT c.doc_id, coalesce(len(c.ls), 0)::BIGINT AS n_lines, coalesce(len(g.drops), 0)::BIGINT AS n_removed,
  coalesce(array_to_string(g.drops, ','), '') AS removed,
  CASE WHEN g.drops IS NULL THEN md5(c.text)
    ELSE md5(coalesce(array_to_string(list_filter(c.ls, lambda x, i: NOT list_contains(g.drops, i - 1)), chr(10)), '')) END AS kept_md5
FROM cut c LEFT JOIN gone g ON c.doc_id = g.doc_id
"""


@register("op7_line_dedup", LINE_DEDUP_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest, url FROM pages
), r AS (
  SELECT *, row_number() OVER same AS nth, first_value(page_id) OVER same AS head FROM p
  WINDOW same AS (PARTITION BY digest ORDER BY page_id NULLS LAST, url)
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n < 100 OR nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n >= 100 AND nth > 1 THEN head END AS refers_to
FROM r
"""


@register("op11_warc_archive", WARC_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive.round_trip(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def cluster_sql(rounds: int = centroid_clustering.ROUNDS) -> str:
    """Rounds of plain assignments and means over all pairs of vector and centroid."""
    ctes = ["""v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rn, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS a FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""", """c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), a) - 1 AS num, a FROM v WHERE vec_id IS NOT NULL ORDER BY num LIMIT 8
)"""]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (
  SELECT rn, min(struct_pack(d := d, num := num)) AS m FROM (
    SELECT v.rn, c.num, list_sum(list_transform(list_zip(v.a, c.a), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{i} c
  ) GROUP BY rn
)""")
        if i < rounds:
            ctes.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.num, coalesce(n.a, c.a) AS a FROM c{i} c LEFT JOIN (
    SELECT num, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS a FROM (
      SELECT num, pos, sum(x) AS s, count(*) AS n FROM (
        SELECT x.m.num AS num, unnest(v.a) AS x, generate_subscripts(v.a, 1) AS pos FROM a{i} x JOIN v ON x.rn = v.rn
      ) GROUP BY num, pos
    ) GROUP BY num
  ) n ON c.num = n.num
)""")
    return f"""WITH {", ".join(ctes)}
SELECT v.vec_id, x.m.num::INTEGER AS cluster, x.m.d::BIGINT AS distance, sum(x.m.d) OVER (PARTITION BY x.m.num)::BIGINT AS cluster_inertia,
  sum(x.m.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.a, ',')) AS centroid_sha256
FROM a{rounds} x JOIN v ON x.rn = v.rn JOIN c{rounds} c ON c.num = x.m.num"""


@register("op12_centroid_clustering", cluster_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.report(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


FILL_IN_MIDDLE_SQL = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
), d AS (
  SELECT *, ('0x' || substr(x, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(x, 9, 8))::BIGINT % (n + 1) AS b,
    ('0x' || substr(x, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(x, 25, 8))::BIGINT % 100 AS h4 FROM h
), f AS (
  SELECT *, least(a, b) AS lo, greatest(a, b) AS hi,
    CASE WHEN n = 0 OR h3 >= 90 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), parts AS (
  SELECT *, substr(t, 1, lo) AS p, substr(t, lo + 1, hi - lo) AS m, substr(t, hi + 1) AS s FROM f
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN lo END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""


@register("op13_fill_in_middle", FILL_IN_MIDDLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.report(read_table(spark, sf_dir, "documents", "doc_id", "text"))
