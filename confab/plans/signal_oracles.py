"""SQL for DuckDB of the queries over tracks made of vectors, and of plans over made-up warnings."""

_CH = """
  v AS (SELECT vec_id // 192 AS call_id, CAST(vec_id % 3 AS INT) AS idx, vec_id // 3 % 64 AS chunk,
      list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CASE WHEN (vec_id // 12 + vec_id % 3) % 3 = 0 THEN 0.02 ELSE 1.0 END) AS samples FROM embeddings),
  c AS (SELECT * FROM v
    UNION ALL SELECT a.call_id, 3, a.chunk, list_transform(list_zip(a.samples, b.samples), lambda z: z[1] + z[2]) FROM v a JOIN v b USING (call_id, chunk) WHERE a.idx = 0 AND b.idx = 1
    UNION ALL SELECT call_id, 4, chunk, list_transform(samples, lambda x: x * 0.97) FROM v WHERE idx = 2),
  h AS (SELECT call_id, idx, chunk, len(samples) AS n, list_dot_product(samples, samples) AS ss FROM c),
  lvl AS (SELECT call_id, idx, sqrt(sum(ss) / sum(n)) AS rms FROM h GROUP BY 1, 2),
  act AS (SELECT call_id, idx, chunk, sqrt(ss2 / 128) > 0.1 * rms AS active
    FROM (SELECT *, ss + lead(ss) OVER (PARTITION BY call_id, idx ORDER BY chunk) AS ss2 FROM h) JOIN lvl USING (call_id, idx) WHERE ss2 IS NOT NULL)"""
_PAIR = f"""{_CH},
  p AS (SELECT a.call_id, a.idx AS a_idx, b.idx AS b_idx, a.chunk, list_sum(a.samples) AS sa, list_dot_product(a.samples, a.samples) AS aa, list_sum(b.samples) AS sb, list_dot_product(b.samples, b.samples) AS bb,
      list_dot_product(a.samples, b.samples) AS ab FROM c a JOIN c b ON a.call_id = b.call_id AND a.chunk = b.chunk AND a.idx < b.idx),
  tot AS (SELECT call_id, a_idx, b_idx, count(*) AS chunks, 64 * count(*) AS n, sum(sa) AS sa, sum(aa) AS aa, sum(sb) AS sb, sum(bb) AS bb, sum(ab) AS ab FROM p GROUP BY 1, 2, 3),
  rest AS (SELECT call_id, a_idx, b_idx, chunks, sqrt(aa / n) AS ra, sqrt(bb / n) AS rb, (ab - sa * sb / n) / sqrt((aa - sa * sa / n) * (bb - sb * sb / n)) AS corr_all,
      aa AS a_en, bb AS b_en, n, ab, greatest(aa - ab * ab / bb, 0) AS a_left, greatest(bb - ab * ab / aa, 0) AS b_left,
      CASE WHEN aa - ab * ab / bb <= 1e-9 * aa THEN 0.0 ELSE abs((0 - (sa - ab / bb * sb) * sb / n) / sqrt((aa - ab * ab / bb - pow(sa - ab / bb * sb, 2) / n) * (bb - sb * sb / n))) END AS resid,
      CASE WHEN bb - ab * ab / aa <= 1e-9 * bb THEN 0.0 ELSE abs((0 - (sb - ab / aa * sa) * sa / n) / sqrt((bb - ab * ab / aa - pow(sb - ab / aa * sa, 2) / n) * (aa - sa * sa / n))) END AS resid_b FROM tot),
  w16 AS (SELECT call_id, a_idx, b_idx, chunk, count(*) OVER w AS k, 64 * count(*) OVER w AS n, sum(sa) OVER w AS sa, sum(aa) OVER w AS aa, sum(sb) OVER w AS sb, sum(bb) OVER w AS bb, sum(ab) OVER w AS ab
    FROM p WINDOW w AS (PARTITION BY call_id, a_idx, b_idx ORDER BY chunk ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)),
  mid AS (SELECT call_id, a_idx, b_idx, median(abs((w.ab - sa * sb / w.n) / sqrt((aa - sa * sa / w.n) * (bb - sb * sb / w.n)))) AS corr, median(w.ab / bb) AS g_b_in_a, median(w.ab / aa) AS g_a_in_b
    FROM w16 w JOIN rest r USING (call_id, a_idx, b_idx) WHERE chunk % 8 = 0 AND (k = 16 OR (chunk = 0 AND chunks < 16)) AND sqrt(aa / w.n) >= 0.1 * ra AND sqrt(bb / w.n) >= 0.1 * rb GROUP BY 1, 2, 3),
  ins AS (SELECT x.call_id, x.idx AS a_idx, y.idx AS b_idx, coalesce(sum((x.active AND y.active)::INT) / nullif(sum(y.active::INT), 0), 0.0) AS a_given_b, coalesce(sum((x.active AND y.active)::INT) / nullif(sum(x.active::INT), 0), 0.0) AS b_given_a
    FROM act x JOIN act y ON x.call_id = y.call_id AND x.chunk = y.chunk AND x.idx < y.idx GROUP BY 1, 2, 3),
  st AS (SELECT call_id, a_idx, b_idx, coalesce(corr, 0.0) AS corr, coalesce(g_b_in_a, 0.0) AS g_b_in_a, coalesce(g_a_in_b, 0.0) AS g_a_in_b, CASE WHEN corr IS NULL THEN 1.0 ELSE resid END AS resid, coalesce(a_given_b, 0.0) AS a_given_b, coalesce(b_given_a, 0.0) AS b_given_a
    FROM rest LEFT JOIN mid USING (call_id, a_idx, b_idx) LEFT JOIN ins USING (call_id, a_idx, b_idx)),
  sv AS (SELECT call_id, CASE WHEN b_in THEN a_idx ELSE b_idx END AS mix_idx, CASE WHEN b_in THEN b_idx ELSE a_idx END AS component_idx, CASE WHEN b_in OR a_in THEN 'contains' ELSE 'duplicate' END AS kind,
      10 * log10(corr / greatest(0.001, 1 - corr) + 1e-9) AS drop_db
    FROM (SELECT *, a_given_b >= 0.93 AND b_given_a < 0.93 AND g_b_in_a BETWEEN 0.85 AND 1.2 AS b_in, b_given_a >= 0.93 AND a_given_b < 0.93 AND g_a_in_b BETWEEN 0.85 AND 1.2 AS a_in FROM st WHERE corr >= 0.3 AND resid <= 0.35))"""


def _plan(selected: str, warnings: str) -> str:
    """Common tables that end in `plan`: one warning after the other, each on its own."""
    return f"""
  sel AS ({selected}), wa AS ({warnings}),
  wb AS (SELECT w.*, EXISTS (FROM sel s WHERE s.call_id = w.call_id AND s.idx = mix_idx) AND EXISTS (FROM sel s WHERE s.call_id = w.call_id AND s.idx = component_idx) AS pair FROM wa w),
  comp AS (SELECT DISTINCT call_id, component_idx AS idx FROM wb WHERE kind = 'contains'),
  subs AS (SELECT call_id, mix_idx AS idx, string_agg(DISTINCT component_idx, ',' ORDER BY component_idx) AS subtract FROM wb WHERE kind = 'contains' AND pair GROUP BY 1, 2),
  safe AS (SELECT call_id, idx FROM comp UNION SELECT call_id, idx FROM subs),
  gone AS (SELECT DISTINCT call_id, CASE WHEN (call_id, mix_idx) NOT IN (FROM safe) THEN mix_idx WHEN (call_id, component_idx) NOT IN (FROM safe) THEN component_idx ELSE greatest(mix_idx, component_idx) END AS idx FROM wb WHERE kind = 'duplicate' AND pair),
  lost AS (SELECT * FROM gone WHERE (call_id, idx) NOT IN (FROM safe)),
  allgone AS (SELECT call_id FROM sel LEFT JOIN lost l USING (call_id, idx) GROUP BY 1 HAVING count(l.idx) = count(*)),
  plan AS (SELECT call_id, idx, CASE WHEN (call_id, idx) IN (FROM lost) AND call_id NOT IN (FROM allgone) THEN 'drop' WHEN subtract IS NOT NULL THEN 'subtract' ELSE 'keep' END AS action, coalesce(subtract, '') AS subtract FROM sel LEFT JOIN subs USING (call_id, idx))"""


_NAMED = r"""
  named AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY idx) AS position, count(*) OVER (PARTITION BY call_id) AS n, CASE WHEN regexp_matches(title, '[^\s\x0b\x{85}\p{Z}]') THEN title END AS own FROM (SELECT DISTINCT call_id, idx, title FROM tracks)),
  made AS (SELECT b.call_id, b.idx AS mix_idx, a.idx AS component_idx, CASE WHEN b.position = 2 THEN 'contains' ELSE 'duplicate' END AS kind FROM named b JOIN named a ON a.call_id = b.call_id AND a.position = CASE WHEN b.position = 2 THEN 1 ELSE b.position - 1 END WHERE b.position IN (2, 3))"""
_NO = r"coalesce(TRY_CAST(regexp_extract(call_id, '(\d+)$', 1) AS INT), {})"

SQL = {
    "track_levels": f"WITH {_CH} SELECT call_id, idx, round(any_value(rms), 6) AS rms, CAST(sum(active::INT) AS INT) AS active, CAST(count(*) AS INT) AS windows FROM act JOIN lvl USING (call_id, idx) GROUP BY 1, 2",
    "pair_corr_gain": f"WITH {_PAIR} SELECT call_id, a_idx, b_idx, round(corr, 6) AS corr, round(g_b_in_a, 6) AS g_b_in_a, round(g_a_in_b, 6) AS g_a_in_b, round(resid, 6) AS resid, round(a_given_b, 6) AS a_given_b, round(b_given_a, 6) AS b_given_a FROM st",
    "envelope": f"""WITH {_CH}, k AS (SELECT call_id, idx, greatest(1, CAST(round_even(count(*) / 16, 0) AS BIGINT)) AS per FROM h GROUP BY 1, 2),
        e AS (SELECT call_id, idx, chunk // per AS bucket, sqrt(sum(ss) / sum(n)) AS level FROM h JOIN k USING (call_id, idx) GROUP BY ALL)
        SELECT call_id, idx, CAST(bucket AS INT) AS bucket, round(level / max(level) OVER (PARTITION BY call_id, idx), 6) AS level FROM e""",
    "shared_voice": f"WITH {_PAIR} SELECT call_id, mix_idx, component_idx, kind, round(drop_db, 4) AS drop_db FROM sv",
    "resolve_plan": f"WITH {_PAIR}, {_plan('SELECT DISTINCT call_id, idx FROM c', 'FROM sv')} SELECT * FROM plan",
    "given_plan": f"""WITH {_NAMED}, {_plan("SELECT call_id, idx FROM named", "FROM made")}
        SELECT call_id, idx, CASE WHEN {_NO.format(1)} % 7 = 0 THEN 'keep' WHEN {_NO.format(1)} % 5 = 0 THEN 'subtract' ELSE action END AS action,
          CASE WHEN {_NO.format(1)} % 7 = 0 THEN '' WHEN {_NO.format(1)} % 5 = 0 THEN CAST(idx AS VARCHAR) ELSE subtract END AS subtract,
          CASE WHEN {_NO.format(1)} % 7 = 0 THEN 'saved' WHEN {_NO.format(1)} % 5 = 0 THEN 'chosen' ELSE 'detected' END AS origin FROM plan""",
    "track_roster": f"""WITH {_NAMED}, {_plan("SELECT call_id, idx FROM named", "FROM made")},
        kept AS (SELECT call_id, idx, row_number() OVER (PARTITION BY call_id ORDER BY idx) AS place, own FROM named JOIN plan USING (call_id, idx) WHERE action <> 'drop'),
        kn AS (SELECT call_id, idx, CAST(place - 1 AS INT) AS place, coalesce(own, 'Speaker ' || place) AS name FROM kept)
        SELECT n.call_id, n.idx, CAST(n.position - 1 AS INT) AS audio, k.place, coalesce(k.name, n.own, 'Another recording') AS name, CASE WHEN k.place % 2 = 0 THEN 'a' WHEN k.place IS NOT NULL THEN 'b' END AS lane,
          CASE WHEN k.place IS NOT NULL THEN g.name END AS ghost, p.subtract AS removes, k.place IS NULL AS set_aside, CAST(0.0 AS DOUBLE) AS start
        FROM named n JOIN plan p USING (call_id, idx) LEFT JOIN kn k USING (call_id, idx) LEFT JOIN kn g ON g.call_id = n.call_id AND CAST(g.idx AS VARCHAR) = string_split(p.subtract, ',')[1]""",
    "track_states": f"""WITH {_NAMED}, {_plan(f"SELECT call_id, idx FROM named WHERE NOT ({_NO.format(0)} % 3 = 0 AND position = n AND n > 1)", "FROM made")},
        done AS (SELECT * FROM plan WHERE subtract <> '' AND {_NO.format(0)} % 2 = 1),
        un AS (SELECT * FROM wb w WHERE pair AND NOT (kind = 'contains' AND EXISTS (FROM done d WHERE d.call_id = w.call_id AND d.idx = w.mix_idx AND list_contains(string_split(d.subtract, ','), CAST(w.component_idx AS VARCHAR))))),
        tk AS (SELECT call_id, mix_idx AS idx, component_idx AS other FROM wb WHERE kind = 'duplicate' UNION SELECT call_id, component_idx, mix_idx FROM wb WHERE kind = 'duplicate')
        SELECT call_id, idx, CASE WHEN (call_id, idx) NOT IN (FROM sel) THEN CASE WHEN EXISTS (FROM tk t JOIN sel s ON s.call_id = t.call_id AND s.idx = t.other WHERE t.call_id = named.call_id AND t.idx = named.idx) THEN 'skipped_dup' ELSE 'excluded' END
          WHEN (call_id, idx) IN (SELECT (call_id, mix_idx) FROM un) OR (call_id, idx) IN (SELECT (call_id, component_idx) FROM un) THEN 'conflict' WHEN (call_id, idx) IN (SELECT (call_id, idx) FROM done) THEN 'isolated' ELSE 'clean' END AS state FROM named""",
    "track_roles": f"""WITH {_PAIR},
        sh AS (SELECT call_id, idx, avg(active::INT) AS share FROM act GROUP BY 1, 2),
        f AS (SELECT r.*, i.a_given_b, i.b_given_a, coalesce(x.share, 0) AS sa, coalesce(y.share, 0) AS sb FROM rest r LEFT JOIN ins i USING (call_id, a_idx, b_idx) LEFT JOIN sh x ON x.call_id = r.call_id AND x.idx = a_idx LEFT JOIN sh y ON y.call_id = r.call_id AND y.idx = b_idx),
        q AS (SELECT call_id, a_idx, b_idx FROM f WHERE least(a_given_b, b_given_a) >= 0.9 AND greatest(sa, sb) > 0 AND least(sa, sb) >= 0.9 * greatest(sa, sb) AND corr_all >= 0.9),
        dup AS (SELECT call_id, b_idx AS idx, min(a_idx) AS of FROM q WHERE (call_id, a_idx) NOT IN (SELECT (call_id, b_idx) FROM q) GROUP BY 1, 2),
        d AS (SELECT call_id, a_idx AS mix, b_idx AS part FROM f WHERE a_given_b >= 0.9 AND sb < 0.97 * sa AND 10 * log10(a_en / n + 1e-12) - 10 * log10(a_left / n + 1e-12) >= 3 AND resid <= 0.35
          UNION ALL SELECT call_id, b_idx, a_idx FROM f WHERE b_given_a >= 0.9 AND sa < 0.97 * sb AND 10 * log10(b_en / n + 1e-12) - 10 * log10(b_left / n + 1e-12) >= 3 AND resid_b <= 0.35),
        r AS (SELECT call_id, mix AS idx, string_agg(part, ',' ORDER BY part) AS refs FROM d WHERE (call_id, mix) NOT IN (SELECT (call_id, idx) FROM dup) AND (call_id, part) NOT IN (SELECT (call_id, idx) FROM dup) GROUP BY 1, 2)
        SELECT call_id, idx, CASE WHEN of IS NOT NULL THEN 'duplicate' WHEN refs IS NOT NULL THEN 'isolate' ELSE 'keep' END AS kind, coalesce(refs, '') AS refs, of AS duplicate_of FROM (SELECT DISTINCT call_id, idx FROM c) LEFT JOIN dup USING (call_id, idx) LEFT JOIN r USING (call_id, idx)""",
    "isolate_residual": f"""WITH {_PAIR} SELECT call_id, round(sqrt(b_left / n), 6) AS rms FROM rest WHERE a_idx = 0 AND b_idx = 3""",
    "first_speech": f"""WITH {_CH}, s AS (SELECT call_id, idx, chunk // 4 AS k, sqrt(sum(ss) / sum(n)) AS level FROM h GROUP BY 1, 2, 3 HAVING count(*) = 4),
        m AS (SELECT call_id, idx, count(*) AS n, max(level) AS top FROM s GROUP BY 1, 2),
        t AS (SELECT call_id, idx, any_value(n) AS n, median(level) FILTER (WHERE level > 0.04 * top) AS typical FROM s JOIN m USING (call_id, idx) GROUP BY 1, 2),
        r AS (SELECT call_id, idx, k, n, sum((level > 0.4 * typical)::INT) OVER (PARTITION BY call_id, idx ORDER BY k ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS loud FROM s JOIN t USING (call_id, idx)),
        f AS (SELECT call_id, idx, min(k) AS k FROM r WHERE loud >= 6 AND k < n - 8 GROUP BY 1, 2)
        SELECT call_id, idx, CAST(round(coalesce(greatest(0, k * 0.5 - 0.3), 0.0), 6) AS DOUBLE) AS at FROM (SELECT DISTINCT call_id, idx FROM c) LEFT JOIN f USING (call_id, idx)""",
    "segment_levels": f"""WITH {_CH}, a AS (SELECT call_id, idx, flatten(list(samples ORDER BY chunk)) AS x FROM c GROUP BY 1, 2),
        s AS (SELECT call_id, idx, CAST(k AS INT) AS k, x[CAST(floor(k * 1.03 * 512) AS BIGINT) + 1 : CAST(floor((k * 1.03 + 1.21) * 512) AS BIGINT)] AS part FROM a, range(8) r(k))
        SELECT call_id, idx, k, CASE WHEN len(part) > 0 THEN round(sqrt(list_dot_product(part, part) / len(part)) / rms, 6) END AS energy FROM s JOIN lvl USING (call_id, idx)""",
    "envelope_twins": f"""WITH {_CH}, k AS (SELECT call_id, idx, greatest(1, CAST(round_even(count(*) / 16, 0) AS BIGINT)) AS per FROM h GROUP BY 1, 2),
        e AS (SELECT call_id, idx, chunk // per AS bucket, sqrt(sum(ss) / sum(n)) AS level FROM h JOIN k USING (call_id, idx) GROUP BY ALL),
        q AS (SELECT a.call_id, a.idx AS of, b.idx, corr(a.level, b.level) AS r FROM e a JOIN e b ON a.call_id = b.call_id AND a.bucket = b.bucket AND a.idx < b.idx GROUP BY 1, 2, 3)
        SELECT call_id, idx, min(of) AS duplicate_of FROM q WHERE r >= 0.995 GROUP BY 1, 2""",
}
