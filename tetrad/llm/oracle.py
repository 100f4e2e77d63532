"""DuckDB SQL of the queries that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op9_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s
  FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS k,
         first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY s) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, s AS text_sha256 FROM r
"""

ORACLE["op7_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, source IS NULL AS no_source, coalesce(source, '') AS src,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2) AS part
  FROM documents
), s AS (
  SELECT no_source, src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL
), w AS (
  SELECT *, (row_number() OVER (ORDER BY no_source, src) - 1) % 3 + 1 AS w,
         sum(source_size) OVER () AS total, source_size * 3 AS cap
  FROM s
), r AS (
  SELECT *, CAST(cap AS DOUBLE) / w AS ratio FROM w
), l AS (
  SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY ratio, no_source, src
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / sum(w) OVER (ORDER BY ratio, no_source, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM r
), p AS (
  SELECT no_source, src, source_size, least(CAST(cap AS DOUBLE), max(lev) OVER () * w) AS target,
         CAST(CAST('0x' || substr(md5('mix-1:' || CAST(no_source AS VARCHAR) || ':' || src), 1, 8) AS UBIGINT) AS DOUBLE)
           / 4294967296.0::DOUBLE AS off
  FROM l
), o AS (
  SELECT d.*, p.source_size, p.target, p.off,
         CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0.0 END AS each_,
         row_number() OVER (PARTITION BY d.no_source, d.src ORDER BY d.size, d.part, d.doc_id) AS k
  FROM d JOIN p USING (no_source, src)
), c AS (
  SELECT *, CAST(floor(k * each_ + off) - floor((k - 1) * each_ + off) AS BIGINT) AS copies FROM o
)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM c
"""
