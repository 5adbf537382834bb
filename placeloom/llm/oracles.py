"""DuckDB SQL for the queries that SQL can express, written from their definitions rather than their plans."""

from __future__ import annotations

OP1 = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, sha256(coalesce(text, ''))) - 1 AS place,
         coalesce('=' || role, 'null') || chr(31) || coalesce('=' || text, 'null') AS said FROM t
), q AS (
  SELECT *, string_agg(sha256(said), '') OVER (PARTITION BY conv_id ORDER BY place) AS prefix,
         count(*) OVER (PARTITION BY conv_id) AS n FROM p
), ends AS (
  SELECT min(conv_id) AS conv_id, prefix FROM q WHERE place = n - 1 GROUP BY prefix
), kept AS (
  SELECT conv_id FROM ends WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.prefix = ends.prefix AND q.place < q.n - 1)
)
SELECT conv_id, CAST(place // 64 AS BIGINT) AS part, count(*) AS n_turns, max(n) AS total_turns,
       string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM q JOIN kept USING (conv_id) GROUP BY conv_id, place // 64
"""

OP2 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, 'null') AS stratum, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d)
), totals AS (
  SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars, sum(length(w) - length(regexp_replace(w, '[#*$%&|<>]', '', 'g'))) AS n_symbols,
         sum(length(w) - length(regexp_replace(w, '[A-Z]', '', 'g'))) AS n_capitals FROM w GROUP BY rid
), windows AS (
  SELECT rid, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w1, w2) AS n FROM windows WHERE w2 IS NOT NULL) WHERE n > 1
), repeats AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid
), lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid
), c AS (
  SELECT rid, doc_id, stratum, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(coalesce(n_symbols, 0) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_capitals, 0) AS n_capitals, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN totals USING (rid) LEFT JOIN repeats USING (rid) LEFT JOIN lines USING (rid)
), s AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         [CASE WHEN n_words > 0 THEN least(100, 100 * n_symbols // n_words) ELSE 0 END, CASE WHEN word_chars > 0 THEN least(100, 100 * n_capitals // word_chars) ELSE 0 END,
          CASE WHEN n_lines > 0 THEN least(100, 100 * n_dup_lines // n_lines) ELSE 0 END, CASE WHEN n_words > 0 THEN least(100, 100 * n_repeat_words // n_words) ELSE 0 END] AS bins
  FROM c
), marks AS (
  SELECT doc_id, max(quality) AS quality, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3') AS chooses
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), labelled AS (
  SELECT stratum, bins, quality > 0 AS good, chooses FROM s JOIN marks USING (doc_id) WHERE NOT base_failed
), scored AS (
  SELECT stratum, rule, bins[rule] AS bin, good FROM labelled, range(1, 5) AS r(rule) WHERE chooses
), sizes AS (
  SELECT stratum, rule, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS nb FROM scored GROUP BY stratum, rule
), cuts AS (
  SELECT stratum, rule, cut, n, nb, (SELECT count(*) FROM scored x WHERE x.stratum = sizes.stratum AND x.rule = sizes.rule AND x.bin >= cut AND good) AS k,
         (SELECT count(*) FROM scored x WHERE x.stratum = sizes.stratum AND x.rule = sizes.rule AND x.bin >= cut AND NOT good) AS b
  FROM sizes, range(1, 101) AS c(cut) WHERE n > 0 AND nb > 0
), chosen AS (
  SELECT stratum, rule, cut, b / nb - k / n / CAST(0.04 AS DOUBLE) AS gain FROM cuts WHERE b / nb - k / n / CAST(0.04 AS DOUBLE) > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, cut DESC) = 1
), path AS (
  SELECT stratum, rule, cut, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, rule) AS step FROM chosen
), tests AS (
  SELECT row_number() OVER () AS rid, stratum, bins FROM labelled WHERE good AND NOT chooses
), n_tests AS (
  SELECT stratum, count(*) AS n FROM tests GROUP BY stratum
), level AS (
  SELECT 0.05 / max(r) AS level FROM (SELECT a.stratum, a.n, count(*) AS r FROM n_tests a JOIN n_tests b ON b.n >= a.n GROUP BY a.stratum, a.n) WHERE n * ln(0.96) <= ln(0.05 / r)
), rejected AS (
  SELECT rid, t.stratum, min(step) AS first FROM tests t JOIN path ON path.stratum = t.stratum AND t.bins[path.rule] >= path.cut GROUP BY rid, t.stratum
), lost AS (
  SELECT p.stratum, p.rule, p.cut, p.step, n, (SELECT count(*) FROM rejected r WHERE r.stratum = p.stratum AND r.first <= p.step) AS k FROM path p JOIN n_tests USING (stratum)
), tails AS (
  SELECT *, CASE WHEN k >= n * 0.04 THEN 1.0 ELSE
    (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.04) + (n - i) * ln(0.96))) FROM range(0, 100000) AS q(i) WHERE i <= k) END AS tail FROM lost
), best AS (
  SELECT stratum, rule, cut FROM tails t WHERE NOT EXISTS (SELECT 1 FROM tails u WHERE u.stratum = t.stratum AND u.step <= t.step AND NOT coalesce(u.tail <= (SELECT level FROM level), false))
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM best WHERE best.stratum = s.stratum AND s.bins[best.rule] >= best.cut) AS kept
FROM s
"""

OP3 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), stored AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN stored USING (payload_digest)
"""

OP4 = r"""
WITH words AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), iw AS (
  SELECT item_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), doc AS (
  SELECT DISTINCT doc_id, text, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
  FROM words, (SELECT DISTINCT least(len(w), 5) AS n FROM iw WHERE len(w) > 0) AS sizes WHERE len(w) >= n
), item AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s FROM iw WHERE len(w) > 0
), size AS (
  SELECT item_id, count(*) AS n_shingles FROM item GROUP BY item_id
)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, round(count(*) / n_shingles, 6) AS containment
FROM doc JOIN item USING (s, n) JOIN size USING (item_id) GROUP BY doc_id, text, item_id, n_shingles HAVING 100 * count(*) >= 80 * n_shingles
"""
