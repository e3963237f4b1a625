"""SQL for DuckDB that gives the same rows as the query of that name."""

from confab.plans import job_oracles, signal_oracles

_WS = r"[\s\x0b\x{85}\p{Z}]"
_NOT_BLANK = r"regexp_matches({}, '[^\s\x0b\x{{85}}\p{{Z}}]')"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_WORDS = "array_to_string(list_transform(words, lambda w, i: CASE WHEN i > 1 AND coalesce(w.lead_space, true) THEN ' ' || w.text ELSE w.text END), '')"
_SEG = f"""
  seg AS (
    SELECT call_id, seq, any_value(speaker) AS speaker, any_value(CAST(round(start * 1000) AS BIGINT)) AS start_ms, any_value(CAST(round("end" * 1000) AS BIGINT)) AS end_ms,
      any_value(CASE WHEN len(words) > 0 THEN {_trim(_WORDS)} ELSE {_trim("text")} END) AS text, max(energy) AS energy
    FROM segments WHERE {_NOT_BLANK.format("text")} GROUP BY call_id, seq)"""


def _blocks(seg: str = "seg") -> str:
    return f"""
  many AS (SELECT call_id, count(DISTINCT speaker) > 1 AS many FROM {seg} GROUP BY 1),
  lagged AS (
    SELECT s.*, many, lag(speaker) OVER w AS prev, lag(seq) OVER w AS prev_seq, max(end_ms) OVER (PARTITION BY call_id ORDER BY start_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
    FROM {seg} s JOIN many USING (call_id) WINDOW w AS (PARTITION BY call_id ORDER BY start_ms, seq)),
  numbered AS (
    SELECT *, CAST(sum(CASE WHEN prev_seq IS NULL OR (many AND speaker <> prev) OR (NOT many AND start_ms - reach > 800) THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY start_ms, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block_no
    FROM lagged),
  blk AS (
    SELECT call_id, block_no, any_value(speaker) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, max(energy) AS energy, count(*) AS segments, string_agg(text, ' ' ORDER BY start_ms, seq) AS text
    FROM numbered GROUP BY call_id, block_no),
  flagged AS (SELECT *, coalesce(start_ms < lag(end_ms) OVER (PARTITION BY call_id ORDER BY start_ms, block_no), false) AS interrupting FROM blk)"""


_BLK = f"WITH {_SEG}, {_blocks()}"
_STAMP = "CASE WHEN t >= 3600 THEN printf('%02d:%02d:%02d', t // 3600, t % 3600 // 60, t % 60) ELSE printf('%02d:%02d', t // 60, t % 60) END"
_PERIODS = r"""
  s AS (
    SELECT DISTINCT call_id, CAST(round(start * 1000) AS BIGINT) AS s, CAST(round("end" * 1000) AS BIGINT) AS e FROM segments
    WHERE "end" > start AND regexp_matches(text, '[^\s\x0b\x{85}\p{Z}]')),
  m AS (SELECT *, max(e) OVER (PARTITION BY call_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s WHERE e > s),
  i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
  period AS (SELECT call_id, min(s) AS start_ms, max(e) AS end_ms FROM i GROUP BY call_id, island)"""

_HIST = "h AS (SELECT DISTINCT ON (id) * FROM transcriptions)"
_WORDED = """sw AS (SELECT call_id AS key, seq, any_value(start) AS start, any_value("end") AS "end", any_value(text) AS text, any_value(words) AS words FROM segments WHERE len(words) > 0 GROUP BY ALL)"""
_W = f"""{_WORDED},
  w AS (
    SELECT key, seq * 1000000 + k - 1 AS seq, CAST(round(words[k].start * 1000) AS BIGINT) AS start_ms, CAST(round(words[k]."end" * 1000) AS BIGINT) AS end_ms, {_trim("words[k].text")} AS text, coalesce(words[k].lead_space, true) AS lead_space
    FROM (SELECT *, unnest(range(1, len(words) + 1)) AS k FROM sw))"""
_PAIR = """
  b AS (SELECT call_id, block_no, min(text) AS raw FROM blocks GROUP BY ALL),
  p AS (SELECT b.call_id, b.block_no, b.raw, n.raw AS edited FROM b JOIN b n ON b.call_id = n.call_id AND n.block_no = b.block_no + 1)"""


def _tokens(x: str, least: int = 1) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(strip_accents(lower({x})), '{_WS}+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda w: length(w) >= {least})"


def _numbers(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '\\d[\\d\\s.,]*\\d|\\d'), lambda n: regexp_replace(n, '[\\s.,]', '', 'g'))"


_DRIFT = f"""{_PAIR},
  t AS (SELECT *, {_tokens("raw")} AS r1, {_tokens("edited")} AS e1, {_tokens("raw", 3)} AS r3, {_tokens("edited", 3)} AS e3, {_numbers("raw")} AS rn, {_numbers("edited")} AS en FROM p),
  d AS (
    SELECT *, length(edited) / greatest(1, length(raw)) AS length_ratio, CASE WHEN len(e1) = 0 THEN 1.0 ELSE len(list_filter(e1, lambda w: list_contains(r1, w))) / len(e1) END AS retention,
      list_filter(e3, lambda w, i: NOT list_contains(r3, w) AND list_position(e3, w) = i) AS nw, list_filter(en, lambda n: NOT list_contains(rn, n)) AS nn FROM t)"""
_STRIPPED = f"""(CASE WHEN {_trim("edited")} LIKE '```%' THEN {_trim("regexp_replace(regexp_replace(" + _trim("edited") + ", '^```[^\\n]*\\n?', ''), '(^|\\n)[ \\t]*```[ \\t]*$', '')")} ELSE {_trim("edited")} END)"""


def _clock(x: str, lead: str) -> str:
    return f"CASE WHEN {x} >= 3600 THEN printf('{lead}:%02d:%02d', {x} // 3600, {x} % 3600 // 60, {x} % 60) ELSE printf('{lead}:%02d', {x} // 60, {x} % 60) END"


SQL = {
    "p1_found": f"""WITH {_PERIODS}
        SELECT call_id, 'period' AS kind, start_ms, end_ms FROM period
        UNION ALL
        SELECT call_id, 'gap' AS kind, reach AS start_ms, s AS end_ms FROM i WHERE s > reach AND s - reach <= 1800000""",
    "p1_interrupting": """
        WITH b AS (SELECT call_id, block_no, min(CAST(round(start * 1000) AS BIGINT)) AS start_ms, max(CAST(round("end" * 1000) AS BIGINT)) AS end_ms, max(interrupting) AS stored FROM blocks GROUP BY ALL)
        SELECT call_id, block_no, stored, coalesce(start_ms < lag(end_ms) OVER (PARTITION BY call_id ORDER BY start_ms, block_no), false) AS interrupting FROM b""",
    "turn_blocks": f"{_BLK} SELECT * FROM blk",
    "turn_interruptions": f"{_BLK} SELECT call_id, block_no, speaker, start_ms, end_ms, interrupting FROM flagged",
    "pause_blocks": f"WITH {_SEG}, own AS (SELECT * REPLACE (call_id || '/' || speaker AS call_id) FROM seg), {_blocks('own')} SELECT call_id, block_no, start_ms, end_ms, segments FROM blk",
    "turn_markdown": f"""{_BLK},
        said AS (SELECT *, CAST(greatest(0, round_even(start_ms / 1000.0, 0)) AS BIGINT) AS t FROM flagged)
        SELECT call_id, CASE WHEN count(DISTINCT speaker) > 1
            THEN string_agg('**' || speaker || '** [' || {_STAMP} || ']' || CASE WHEN interrupting THEN ' (interrupting)' ELSE '' END || chr(10) || text, chr(10) || chr(10) ORDER BY start_ms, block_no)
            ELSE string_agg(text, chr(10) || chr(10) ORDER BY start_ms, block_no) END || chr(10) AS text
        FROM said GROUP BY call_id""",
    "lane_payload": f"""{_BLK},
        f AS (SELECT call_id, speaker, row_number() OVER (PARTITION BY call_id ORDER BY min(block_no)) AS r FROM blk GROUP BY 1, 2)
        SELECT call_id, block_no, speaker, CASE WHEN r % 2 = 1 THEN 'a' ELSE 'b' END AS lane FROM blk JOIN f USING (call_id, speaker)""",
    "batch5": f"""{_BLK} SELECT call_id, (block_no - 1) // 5 AS batch, CAST(count(*) AS INT) AS n, string_agg({_trim("text")}, '|' ORDER BY block_no) AS texts FROM blk GROUP BY 1, 2""",
    "context_window": f"""{_BLK}
        SELECT call_id, block_no, coalesce(array_to_string(list(text) OVER (PARTITION BY call_id ORDER BY block_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '|'), '') AS before,
          coalesce(array_to_string(list(text) OVER (PARTITION BY call_id ORDER BY block_no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '|'), '') AS after FROM blk""",
    "region_pack": f"""WITH RECURSIVE {_PERIODS},
        n AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY start_ms) AS k FROM period),
        walk AS (
          SELECT call_id, k, start_ms AS a, end_ms AS z, true AS opens FROM n WHERE k = 1
          UNION ALL
          SELECT n.call_id, n.k, CASE WHEN n.start_ms - z <= 1000 AND n.end_ms - a <= 28000 THEN a ELSE n.start_ms END, n.end_ms, NOT (n.start_ms - z <= 1000 AND n.end_ms - a <= 28000)
          FROM walk JOIN n ON n.call_id = walk.call_id AND n.k = walk.k + 1)
        SELECT call_id, a AS start_ms, max(z) AS end_ms FROM walk GROUP BY call_id, a""",
    "line_pack": r"""WITH RECURSIVE
        l AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n$', ''), chr(10)) AS lines FROM documents WHERE length(text) > 0),
        walk AS (
          SELECT doc_id, 1 AS k, lines, lines[1] AS buf, CAST(NULL AS VARCHAR) AS out FROM l
          UNION ALL
          SELECT doc_id, k + 1, lines, CASE WHEN length(buf) > 0 AND length(buf) + length(lines[k + 1]) + 1 > 1600 THEN lines[k + 1] WHEN length(buf) > 0 THEN buf || chr(10) || lines[k + 1] ELSE lines[k + 1] END,
            CASE WHEN length(buf) > 0 AND length(buf) + length(lines[k + 1]) + 1 > 1600 THEN buf END
          FROM walk WHERE k < len(lines)),
        o AS (SELECT doc_id, k, out AS chunk FROM walk WHERE out IS NOT NULL UNION ALL SELECT doc_id, k + 1, buf FROM walk WHERE k = len(lines) AND length(buf) > 0)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS chunk_no, chunk FROM o""",
    "echo_candidates": f"""{_BLK},
        b AS (SELECT *, length({_trim("text")}) AS n FROM blk WHERE length({_trim("text")}) >= 12)
        SELECT a.call_id, a.block_no AS a_no, b.block_no AS b_no,
          CASE WHEN a.energy <> b.energy THEN a.energy < b.energy WHEN a.n <> b.n THEN a.n < b.n ELSE a.start_ms >= b.start_ms END AS a_loses
        FROM b a JOIN b ON a.call_id = b.call_id AND (a.start_ms, a.end_ms, a.block_no) < (b.start_ms, b.end_ms, b.block_no) AND a.speaker <> b.speaker AND b.start_ms - a.end_ms <= 1500
          AND greatest(a.start_ms, b.start_ms) - least(a.end_ms, b.end_ms) <= 1500""",
    "spacing_tokens": f"WITH {_W} SELECT key, seq * 2 + 1 AS seq, text, start_ms, end_ms, lead_space FROM w",
    "word_coalesce": f"""WITH {_W},
        l AS (SELECT *, lag(end_ms) OVER o AS pe, lag(text) OVER o AS pt FROM w WINDOW o AS (PARTITION BY key ORDER BY seq)),
        n AS (SELECT *, CAST(sum(CASE WHEN pt IS NULL OR start_ms - pe > 600 OR regexp_matches(pt, '[.!?]\\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_no FROM l),
        f AS (SELECT *, row_number() OVER (PARTITION BY key, segment_no ORDER BY seq) AS i FROM n)
        SELECT key, segment_no, arg_min(start_ms, seq) AS start_ms, arg_max(end_ms, seq) AS end_ms, CAST(count(*) AS INT) AS words, {_trim("string_agg(CASE WHEN i > 1 AND lead_space THEN ' ' || text ELSE text END, '' ORDER BY seq)")} AS text FROM f GROUP BY key, segment_no""",
    "token_words": f"WITH {_W} SELECT key, seq * 2 AS seq, text, start_ms, end_ms FROM w WHERE length(text) > 0",
    "word_bucket": f"""WITH {_W},
        c AS (SELECT key, seq, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda x: x <> '')) AS n FROM sw),
        u AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS upto FROM c),
        m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS no FROM w)
        SELECT u.key, u.seq, string_agg(m.text, ' ' ORDER BY no) AS words FROM u JOIN m ON u.key = m.key AND no >= upto - n AND no < upto GROUP BY ALL""",
    "segment_times": f"""WITH {_WORDED}, f AS (SELECT *, list_filter(words, lambda w: w.start IS NOT NULL AND w."end" IS NOT NULL) AS timed FROM sw)
        SELECT key, seq, coalesce(timed[1].start, start) AS first, coalesce(timed[-1]."end", "end") AS last, timed[1].start + 10.0 AS moved FROM f""",
    "eta_by_model_language": f"""WITH {_HIST},
        g AS (SELECT *, elapsed_seconds / audio_duration_seconds AS r FROM h WHERE status = 'success' AND audio_duration_seconds > 0 AND elapsed_seconds IS NOT NULL),
        x AS (SELECT model, language, avg(r) AS r FROM (SELECT *, row_number() OVER (PARTITION BY model, language ORDER BY id DESC) AS n FROM g) WHERE n <= 20 GROUP BY 1, 2),
        y AS (SELECT model, avg(r) AS r FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY id DESC) AS n FROM g) WHERE n <= 20 GROUP BY 1),
        q AS (SELECT DISTINCT model, language FROM h)
        SELECT q.model, q.language, round(coalesce(x.r, y.r, 0.35) * 600.0 * 2, 4) AS seconds FROM q LEFT JOIN x ON q.model = x.model AND q.language IS NOT DISTINCT FROM x.language LEFT JOIN y ON q.model = y.model""",
    "history_latest200": f"WITH {_HIST} SELECT id, coalesce(finished_at, started_at) AS at, model, coalesce(language, 'auto') AS language, status FROM h ORDER BY id DESC LIMIT 200",
    "recent_success60": f"WITH {_HIST} SELECT id, model, output_path FROM (SELECT * FROM h ORDER BY id DESC LIMIT 60) WHERE status = 'success'",
    "latest_turns": f"WITH {_HIST} SELECT output_path, arg_max(turns_json, id) AS turns_json FROM h WHERE turns_json IS NOT NULL AND output_path IS NOT NULL GROUP BY 1",
    "stored_turns": f"WITH {_HIST} SELECT id, CAST(CASE WHEN json_valid(turns_json) THEN json_array_length(turns_json) END AS INT) AS turns FROM h WHERE turns_json IS NOT NULL",
    "resumable_jobs": f"WITH {_HIST} SELECT id, status, started_at FROM h WHERE status IN ('stopped', 'error')",
    "committed_log": """
        WITH l AS (SELECT DISTINCT call_id AS key, lower(speaker) AS unit, CAST(floor(round(start * 1000) / 30000) AS INT) AS chunk, seq FROM segments),
        c AS (SELECT key, min(unit) AS first FROM l GROUP BY 1)
        SELECT l.* FROM l JOIN c USING (key) WHERE length(unit) % 2 = 0 OR (unit = first AND chunk < 5)""",
    "format_all": f"""WITH {_HIST}, t AS (SELECT *, CAST(greatest(0, round_even(elapsed_seconds, 0)) AS BIGINT) AS e, CAST(greatest(0, round_even(coalesce(audio_duration_seconds, 0), 0)) AS BIGINT) AS d FROM h)
        SELECT id, CASE WHEN elapsed_seconds IS NULL THEN NULL ELSE {_clock("e", "%02d")} END AS stamp,
          CASE WHEN elapsed_seconds IS NULL THEN '-' WHEN e >= 60 THEN printf('%dm %02ds', e // 60, e % 60) ELSE printf('%ds', e) END AS spent,
          {_clock("d", "%d")} AS code, CASE WHEN elapsed_seconds < 0 OR elapsed_seconds IS NULL THEN NULL WHEN elapsed_seconds < 45 THEN '<1 min' ELSE printf('%d min', CAST(round_even(elapsed_seconds / 60, 0) AS BIGINT)) END AS left,
          CASE WHEN coalesce(audio_duration_seconds, 0) = 0 THEN '' ELSE {_clock("d", "%d")} END AS length,
          coalesce(strftime(TRY_CAST(started_at AS TIMESTAMP), '%b %-d'), '') AS day,
          CASE WHEN coalesce(audio_duration_seconds, 0) = 0 THEN 0.0 ELSE round(8.0 + audio_duration_seconds * 0.05, 6) END AS polish FROM t""",
    "bench_metrics": f"""WITH {_HIST}, r AS (SELECT id, elapsed_seconds / nullif(audio_duration_seconds, 0) AS x, elapsed_seconds, nullif(audio_duration_seconds, 0) AS audio_duration_seconds FROM h)
        SELECT id, x IS NULL OR elapsed_seconds = 0 AS no_rtf, CASE WHEN elapsed_seconds <> 0 THEN round_even(x, 4) END AS rtf, round_even(audio_duration_seconds / nullif(elapsed_seconds, 0), 2) AS speedup FROM r""",
    "judge_aggregate": f"""WITH {_HIST} SELECT model, count(*) AS runs, round_even(median(elapsed_seconds), 2) AS elapsed_seconds_median, min(elapsed_seconds) AS elapsed_seconds_min, max(elapsed_seconds) AS elapsed_seconds_max,
          round_even(avg(audio_duration_seconds), 2) AS audio_duration_seconds_mean FROM h GROUP BY 1""",
    "gated_rank": f"""WITH {_HIST},
        v AS (SELECT coalesce(language, 'auto') AS language, model AS name, avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END) AS good, avg(CASE WHEN status = 'error' THEN 1.0 ELSE 0.0 END) AS bad FROM h GROUP BY 1, 2)
        SELECT language, name, bad > 0.1 AS gated, CAST(row_number() OVER (PARTITION BY language ORDER BY bad > 0.1, good DESC, (good + 1 - bad) / 2 DESC, name) AS INT) AS place, round((good + 1 - bad) / 2, 6) AS quality FROM v""",
    "majority_vote": f"""WITH {_HIST},
        n AS (SELECT source_path, language, count(*) AS votes, min(id) AS first FROM h WHERE language IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)
        SELECT source_path, language, votes FROM (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY votes DESC, first) AS k FROM n) WHERE k = 1""",
    "rating_upsert": f"""WITH {_HIST}, g AS (SELECT model AS id, CAST(id % 7 AS INT) AS rating, coalesce(language, '') AS notes, id AS seq FROM h)
        SELECT id, arg_max(rating, seq) FILTER (WHERE rating BETWEEN 1 AND 5) AS rating, coalesce(arg_max(notes, seq) FILTER (WHERE rating BETWEEN 1 AND 5), '') AS notes FROM g GROUP BY 1""",
    "norm_text": rf"""SELECT DISTINCT call_id, block_no, {_trim(r"regexp_replace(lower(text), '[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}\s\x0b\x{85}\p{Z}]', '', 'g')")} AS norm FROM blocks""",
    "fold_text": "SELECT call_id, block_no, strip_accents(lower(text)) AS folded FROM (SELECT DISTINCT call_id, block_no, text FROM blocks)",
    "containment_accept": f"""WITH {_PAIR}, s AS (SELECT call_id, block_no, raw, {_STRIPPED} AS e FROM p),
        k AS (SELECT *, {_tokens("raw")} AS r1, {_tokens("e")} AS e1 FROM s),
        a AS (SELECT *, CASE WHEN length(e) > 0 AND length(e) <= 1.4 * length(raw) AND (len(e1) < 6 OR len(list_filter(e1, lambda w: list_contains(r1, w))) / len(e1) >= 0.6) THEN e ELSE raw END AS accepted FROM k)
        SELECT call_id, block_no, accepted = raw AS kept, accepted FROM a""",
    "drift_metrics": f"WITH {_DRIFT} SELECT call_id, block_no, round(length_ratio, 6) AS length_ratio, round(retention, 6) AS retention, array_to_string(nw, ' ') AS novel_words, array_to_string(nn, ' ') AS novel_numbers FROM d",
    "drift_report": f"""WITH {_DRIFT} SELECT call_id, count(*) AS rows, CAST(sum(length(raw)) AS BIGINT) AS raw_chars, CAST(sum(length(edited)) AS BIGINT) AS edited_chars, CAST(sum(len(nw)) AS BIGINT) AS novel, CAST(max(len(nw)) AS INT) AS most_novel,
          CAST(sum(len(nn)) AS BIGINT) AS numbers FROM d GROUP BY 1""",
    "repetition_5gram": f"""
        WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
        g AS (SELECT doc_id, w, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS g FROM s)
        SELECT doc_id, CAST(len(w) AS INT) AS words, CASE WHEN len(w) >= 5 THEN round(1.0 - len(list_distinct(g)) / len(g), 6) ELSE 0.0 END AS repeated FROM g""",
    "phrase_hits": """SELECT doc_id, array_to_string(list_filter(['titulky', 'amara.org', 'děkuji za pozornost', 'thank you for watching', 'přepis', 'www.', '.cz/titulky', 'produkce', 'český rozhlas'], lambda p: contains(lower(text), p)), '|') AS hits
        FROM documents WHERE text IS NOT NULL""",
    "track_names": f"""WITH d AS (SELECT DISTINCT call_id, idx, title FROM tracks), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY call_id ORDER BY idx) AS INT) AS position, count(*) OVER (PARTITION BY call_id) > 1 AS several FROM d)
        SELECT call_id, idx, position, several, CASE WHEN {_NOT_BLANK.format("title")} THEN title ELSE 'Speaker ' || position END AS name, 'track' || idx AS unit FROM n""",
    "file_catalog": rf"""WITH {_HIST}, f AS (SELECT id, model, regexp_extract(source_path, '([^/]*)$', 1) AS name FROM h)
        SELECT id, CASE WHEN name LIKE '_%.%' THEN regexp_extract(name, '^(.+)\.[^.]*$', 1) ELSE name END AS stem, lower(regexp_extract(name, '^.+(\.[^.]+)$', 1)) AS suffix,
          CASE WHEN model LIKE 'groq:%' THEN 'groq' WHEN model LIKE 'elevenlabs:%' THEN 'elevenlabs' WHEN lower(model) LIKE '%parakeet%' THEN 'parakeet' ELSE 'whisper' END AS family FROM f""",
    "name_suffix": rf"""WITH {_HIST},
        w AS (SELECT id AS seq, regexp_extract(source_path, '^(.*)/', 1) AS folder, regexp_extract(source_path, '([^/]+)\.[^./]*$', 1) AS stem FROM h),
        k AS (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY seq) + CASE WHEN bool_or(seq % 10 = 0) OVER (PARTITION BY folder, stem) THEN 1 ELSE 0 END AS n FROM w)
        SELECT seq, folder, stem || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || '.md' AS name FROM k""",
    "front_matter": f"""WITH {_HIST} SELECT id, '---' || chr(10) || 'source: ' || source_path || chr(10) || 'model: ' || model || chr(10) || 'language: ' || coalesce(nullif(language, ''), 'auto') || chr(10) || 'transcribed_at: ' || started_at || chr(10)
          || coalesce('elapsed_seconds: ' || CAST(round_even(elapsed_seconds, 0) AS BIGINT) || chr(10), '') || '---' || chr(10) AS head FROM h""",
}

SQL["turn_objects"] = f"{_BLK} SELECT call_id, block_no, speaker, start_ms, interrupting FROM flagged"
_TEXTS = f"{_BLK}, t AS (SELECT call_id, block_no, {_trim('text')} AS text FROM blk)"
SQL["polished_blocks"] = f"""{_TEXTS}, g AS (SELECT *, max(length(text)) OVER (PARTITION BY call_id, (block_no - 1) // 5) >= 12 AS asked FROM t)
        SELECT call_id, block_no, text, CASE WHEN asked AND text <> '' AND length(text) + 1 <= 1.4 * length(text) THEN text || '!' ELSE text END AS polished FROM g"""
SQL["cleaned_alone"] = f"{_TEXTS}, u AS (SELECT call_id, block_no, regexp_replace(text, '[\\[`]', '', 'g') AS raw FROM t) SELECT call_id, block_no, raw, CASE WHEN length({_trim('raw')}) >= 12 THEN {_trim('raw')} || '!' ELSE raw END AS edited FROM u"
SQL["cleaned_batches"] = f"""{_TEXTS}, g AS (SELECT *, max(length(text)) OVER (PARTITION BY call_id, (block_no - 1) // 5) >= 12 AS asked FROM t)
        SELECT call_id, block_no, text AS raw, CASE WHEN asked THEN text || '!' ELSE text END AS edited FROM g"""
SQL["packed_chars"] = f"""{_TEXTS.replace('WITH', 'WITH RECURSIVE', 1)}, n AS (SELECT call_id, block_no, length(text) AS n FROM t),
        f AS (SELECT call_id, block_no, n, CAST(0 AS BIGINT) AS pack, n AS size FROM n WHERE block_no = 1
          UNION ALL SELECT n.call_id, n.block_no, n.n, CASE WHEN f.size + n.n > 1500 THEN f.pack + 1 ELSE f.pack END, CASE WHEN f.size + n.n > 1500 THEN n.n ELSE f.size + n.n END FROM f JOIN n ON n.call_id = f.call_id AND n.block_no = f.block_no + 1)
        SELECT call_id, pack, block_no FROM f"""
SQL |= signal_oracles.SQL | job_oracles.SQL
