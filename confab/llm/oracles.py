"""SQL for DuckDB that gives the same rows as the query of that name."""

_WS = r"[\s\x0b\x{85}\p{Z}]"

SQL = {
    "p3_found": rf"""
        WITH b AS (SELECT call_id, block_no, min(text) AS text FROM blocks WHERE length(text) > 1600 GROUP BY ALL),
        u AS (
          SELECT call_id, block_no,
            list_max(list_transform(regexp_split_to_array(text, '[\r\n]'), lambda x: length(x))) AS line,
            list_max(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?…])({_WS})', '\1' || chr(1) || '\2', 'g'), '[\r\n\x01]'), lambda x: length(x))) AS sentence,
            list_max(list_transform(regexp_split_to_array(text, '{_WS}+'), lambda x: length(x))) AS word
          FROM b)
        SELECT call_id, block_no, CASE WHEN line <= 1600 THEN 'line' WHEN sentence <= 1600 THEN 'sentence' WHEN word <= 1600 THEN 'word' ELSE 'none' END AS cut FROM u""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p4_ranks": """
        WITH h AS (SELECT DISTINCT ON (id) * FROM transcriptions),
        v AS (SELECT model, 'elapsed_seconds' AS metric, elapsed_seconds AS v FROM h UNION ALL SELECT model, 'audio_duration_seconds', audio_duration_seconds FROM h),
        n AS (SELECT model, metric, count(*) AS n FROM v WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1, 2)
        SELECT model, metric, q, n, true AS kept FROM n, (SELECT CAST(unnest([0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999]) AS DOUBLE) AS q)""",
    "p7_found": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(nfc_normalize(text))), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
        i AS (SELECT item_id, regexp_extract_all(strip_accents(lower(nfc_normalize(ref_text))), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE ref_text IS NOT NULL),
        a AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
        b AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
        SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (g)""",
    "p3_joined": "SELECT call_id, block_no, min(text) AS text, true AS fits, true AS laps FROM blocks WHERE length(text) > 1600 GROUP BY 1, 2",
}
