"""The queries as DuckDB SQL, where SQL can express them."""

CONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS words
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0)
), doc_windows AS (
  SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS words
  FROM (
    SELECT doc_id, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS i
    FROM d, (SELECT DISTINCT size FROM item_windows) WHERE len(ws) >= size
  )
), met AS (
  SELECT doc_id, i, size, item_id FROM doc_windows JOIN item_windows USING (size, words)
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM met))
  GROUP BY doc_id
), names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM met) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)
"""

RULE_LEDGER = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words) AS n
  FROM (
    SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS words
    FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM d WHERE len(ws) > 4)
  )
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM windows WHERE n > 1) GROUP BY doc_id
), stutters AS (
  SELECT doc_id, sum(CASE WHEN ws[i] = ws[i + 1] THEN 1 ELSE 0 END) AS n_same_next
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM d WHERE len(ws) > 1) GROUP BY doc_id
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_same_next, 0) AS n_same_next,
    len(regexp_extract_all(text, '[A-Za-z]')) AS n_letters, len(regexp_extract_all(text, '[A-Z]')) AS n_capitals
  FROM d LEFT JOIN repeats USING (doc_id) LEFT JOIN stutters USING (doc_id)
), f AS (
  SELECT *, CAST(
    CASE WHEN n_words < 10 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 2 * n_capitals > n_letters AND n_letters > 0 THEN 16 ELSE 0 END
    + CASE WHEN 5 * n_same_next > n_words THEN 32 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 64 ELSE 0 END AS BIGINT) AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""

POTENTIAL_AUDIT = r"""
WITH m AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), f AS (
  SELECT doc_id, part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
    100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM m
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), kinds AS (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
    CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failing,
    count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN marks USING (doc_id) GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT concat(p.l, q.l, r.l, s.l, t.l) AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS own
  FROM orders, (SELECT unnest(generate_series(1, 5)) AS step)
), met AS (
  SELECT part, filter_order, failing, n, good, toxic,
    (SELECT min(instr(filter_order, x)) FROM (SELECT unnest(string_split(failing, '')) AS x) WHERE x <> '') AS first
  FROM kinds, orders
), counted AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN first IS NULL OR first > step THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN first = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(failing, own) AND first < step THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failing = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN first = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN first = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM met JOIN steps USING (filter_order) GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""

BLOCK_NEIGHBOURS = r"""
WITH v AS (
  SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, q.e AS qe, c.vec_id,
    list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, qe ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5
"""

CHUNKED_FIM = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), n AS (
  SELECT *, CASE WHEN text = '' THEN 0 WHEN parts[-1] = '' THEN len(parts) - 1 ELSE len(parts) END AS n FROM d
), c AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS c2,
    text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain,
    CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 AS spm
  FROM n
), p AS (
  SELECT *, [CASE WHEN k = 0 THEN 0 WHEN k = len(parts) THEN length(text) ELSE length(array_to_string(parts[1:k], chr(10))) + 1 END
    FOR k IN [least(c1, c2), greatest(c1, c2)]] AS cut
  FROM c
), o AS (
  SELECT *, substr(text, 1, cut[1]) AS prefix, substr(text, cut[1] + 1, cut[2] - cut[1]) AS middle, substr(text, cut[2] + 1) AS suffix FROM p
)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN CAST(cut[1] AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(cut[2] - cut[1] AS BIGINT) END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
    ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM o
"""

ORACLES = {
    "op3_aho_decontaminate": CONTAMINATION,
    "op8_rule_ledger": RULE_LEDGER,
    "op11_potential_audit": POTENTIAL_AUDIT,
    "op12_block_neighbours": BLOCK_NEIGHBOURS,
    "op13_chunked_fim": CHUNKED_FIM,
}
