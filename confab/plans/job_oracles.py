"""SQL for DuckDB of the queries of jobs, checkpoints, recognisers, evaluation and files."""

_WS = r"[\s\x0b\x{85}\p{Z}]"
_H = "h AS (SELECT DISTINCT ON (id) * FROM transcriptions)"
_NAMED = rf"""
  d AS (SELECT DISTINCT call_id, idx, title FROM tracks),
  t AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY idx) AS position, count(*) OVER (PARTITION BY call_id) > 1 AS several FROM d),
  named AS (SELECT *, CASE WHEN regexp_matches(title, '[^\s\x0b\x{{85}}\p{{Z}}]') THEN title ELSE 'Speaker ' || position END AS name FROM t)"""
_JOBS = f"""{_H},
  j AS (
    SELECT id, source_path, model, language, ['ready', 'queued', 'converting', 'loading model', 'transcribing', 'polishing', 'done', 'error', 'stopped'][id % 9 + 1] AS status, CASE WHEN id % 4 = 0 THEN 'track 1/2 - Eva' END AS note,
      CASE WHEN id % 9 = 7 THEN 'boom' END AS error, output_path, id % 2 = 0 AS polish, audio_duration_seconds AS d, CASE WHEN id % 5 <> 0 THEN audio_duration_seconds * CAST(0.35 AS DOUBLE) END AS est, CASE WHEN id % 2 = 0 THEN 8 + audio_duration_seconds * CAST(0.05 AS DOUBLE) END AS pol,
      CASE WHEN id % 3 = 0 THEN CAST(id % 101 AS DOUBLE) / 100 END AS f, elapsed_seconds AS e, CAST(id % 50 AS DOUBLE) AS pe FROM h),
  sh AS (SELECT *, CASE WHEN polish AND coalesce(est, 0) + coalesce(pol, 0) > 0 THEN greatest(CAST(0.05 AS DOUBLE), least(CAST(0.4 AS DOUBLE), coalesce(pol, 0) / (coalesce(est, 0) + coalesce(pol, 0)))) ELSE CAST(0 AS DOUBLE) END AS share FROM j)"""


def _clock(x: str) -> str:
    whole = f"CAST(greatest(0, round_even({x}, 0)) AS BIGINT)"
    return f"CASE WHEN {whole} >= 3600 THEN printf('%d:%02d:%02d', {whole} // 3600, {whole} % 3600 // 60, {whole} % 60) ELSE printf('%d:%02d', {whole} // 60, {whole} % 60) END"


def _spent(x: str) -> str:
    whole = f"CAST(greatest(0, round_even({x}, 0)) AS BIGINT)"
    return f"CASE WHEN {x} IS NULL THEN '-' WHEN {whole} >= 60 THEN printf('%dm %02ds', {whole} // 60, {whole} % 60) ELSE printf('%ds', {whole}) END"


def _left(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} < 0 THEN NULL WHEN {x} < 45 THEN '<1 min' ELSE printf('%d min', CAST(round_even({x} / 60, 0) AS BIGINT)) END"


_VIEW = f"""{_JOBS},
  raw AS (SELECT *, least(0.999, greatest(0.0, f)) AS r, CASE WHEN share = 0 THEN 0.05 ELSE share END AS pshare, CASE WHEN coalesce(pol, 0) = 0 THEN 8.0 ELSE pol END AS whole FROM sh),
  v AS (
    SELECT *, CASE WHEN f IS NOT NULL THEN r * (1 - share) WHEN coalesce(est, 0) <> 0 THEN least(0.99, coalesce(e, 0) / est) * (1 - share) END AS fraction,
      CASE WHEN f IS NOT NULL AND coalesce(d, 0) <> 0 THEN {_clock("f * d")} || ' / ' || {_clock("d")} END AS code,
      CASE WHEN f IS NOT NULL THEN CASE WHEN r > 0 AND coalesce(e, 0) <> 0 THEN e / r - e + coalesce(pol, 0) END WHEN coalesce(est, 0) <> 0 THEN greatest(0, est - coalesce(e, 0)) + coalesce(pol, 0) END AS eta,
      1 - pshare + pshare * CASE WHEN whole > 0 THEN least(0.99, pe / whole) ELSE 0.99 END AS pf, greatest(0, whole - pe) AS peta FROM raw),
  l AS (SELECT *, {_left("eta")} AS lft, {_left("peta")} AS plft, CASE WHEN coalesce(est, 0) <> 0 THEN {_spent("est + coalesce(pol, 0)")} END AS total, CAST(round_even(fraction * 100, 0) AS BIGINT) || '%' AS pct FROM v)"""
_TEXTS = f"""{_H},
  x AS (SELECT *, id % 11 = 0 OR id % 13 = 0 AS bad FROM h),
  cp AS (SELECT 'k' || id AS key, CASE id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'paused' ELSE 'done' END AS status, CAST(id % 7 AS INT) AS done, started_at, source_path FROM x WHERE NOT bad AND started_at IS NOT NULL)"""
_PAIR = """
  b AS (SELECT call_id, block_no, min(text) AS raw FROM blocks GROUP BY ALL),
  p AS (SELECT b.call_id, b.block_no, b.raw, n.raw AS edited FROM b JOIN b n ON b.call_id = n.call_id AND n.block_no = b.block_no + 1)"""
_PHRASES = "['titulky', 'amara.org', 'děkuji za pozornost', 'thank you for watching', 'přepis', 'www.', '.cz/titulky', 'produkce', 'český rozhlas']"

SQL = {
    "job_payload": f"""WITH {_JOBS} SELECT id, status, CAST(round_even(coalesce(f, 0) * 100, 0) AS INT) AS progress, coalesce(note, status) AS detail, source_path AS source, CASE WHEN status = 'polishing' THEN CAST(trunc(coalesce(pol, 0)) AS INT) END AS polish_eta,
        CASE WHEN status = 'done' THEN output_path END AS output, CASE WHEN status = 'done' THEN upper(output_path) END AS transcript, CASE WHEN status = 'error' THEN error END AS error FROM j""",
    "job_lines": f"""WITH {_VIEW}
        SELECT id, CASE WHEN status = 'error' THEN 'error: boom' ELSE status END || CASE WHEN note IS NOT NULL THEN ' (' || note || ')' ELSE '' END AS status_line,
          round(CASE status WHEN 'transcribing' THEN fraction * 100 WHEN 'polishing' THEN pf * 100 WHEN 'done' THEN 100.0 WHEN 'loading model' THEN NULL ELSE 0.0 END, 6) AS bar,
          CASE status WHEN 'transcribing' THEN CASE WHEN fraction IS NULL THEN 'Transcribing…' WHEN f IS NOT NULL THEN coalesce(nullif(concat_ws('  ·  ', note, code, '~' || lft || ' left'), ''), pct) ELSE coalesce('~ Estimated ' || lft || ' left', 'Estimating…') END
            WHEN 'polishing' THEN coalesce('Polishing…  ·  ~' || plft || ' left', 'Polishing…') WHEN 'loading model' THEN 'Loading model…' WHEN 'done' THEN 'done in ' || {_spent("e")} WHEN 'stopped' THEN 'stopped'
            WHEN 'ready' THEN coalesce('~' || total || ' estimated', CASE WHEN d IS NULL THEN 'estimating...' ELSE '-' END) WHEN 'queued' THEN coalesce('waiting... (~' || total || ')', 'waiting...') ELSE {_spent("e")} END AS detail FROM l""",
    "job_panel": f"""WITH {_VIEW}
        SELECT id, upper(status[1]) || status[2:] || ': ' || regexp_extract(source_path, '([^/]*)$', 1) || coalesce(' (' || note || ')', '') AS title,
          CASE status WHEN 'loading model' THEN 'Loading model into memory…' WHEN 'transcribing' THEN CASE WHEN fraction IS NULL THEN 'Transcribing…  •  estimating progress' WHEN f IS NOT NULL THEN concat_ws('  •  ', code, pct, 'about ' || lft || ' left') ELSE concat_ws('  •  ', 'Estimating progress', 'about ' || lft || ' left') END
            WHEN 'polishing' THEN concat_ws('  •  ', 'Cleaning up the transcript', 'about ' || plft || ' left') ELSE {_spent("coalesce(e, 0)")} || ' elapsed' END AS detail
        FROM l WHERE status IN ('converting', 'loading model', 'transcribing', 'polishing')""",
    "job_buttons": f"""WITH {_JOBS} SELECT id, CASE WHEN status = 'ready' THEN 'start' WHEN status IN ('done', 'error', 'stopped') THEN 'reset' ELSE 'stop' END AS does, true AS can, round(share, 6) AS share FROM sh""",
    "job_reset": f"""WITH {_JOBS}, k AS (SELECT *, status IN ('done', 'error', 'stopped') AS over FROM j)
        SELECT id, CASE WHEN over THEN 'ready' ELSE status END AS status, model, language, CASE WHEN NOT over THEN error END AS error, CASE WHEN NOT over THEN output_path END AS output_path, CASE WHEN NOT over THEN e END AS elapsed, CASE WHEN NOT over THEN f END AS transcribe_fraction, polish FROM k""",
    "jobs_in_flight": f"""WITH {_JOBS}, n AS (SELECT *, regexp_extract(source_path, '([^/]*)$', 1) AS file FROM j WHERE status NOT IN ('done', 'error', 'stopped'))
        SELECT id, regexp_replace(file, '^(.+)\\.[^.]*$', '\\1') AS name, source_path AS source, 'working' AS status, CAST(round_even(coalesce(f, 0) * 100, 0) AS INT) AS progress, 'Resuming…' AS detail FROM n""",
    "overall_progress": f"WITH {_NAMED} SELECT call_id, round((count(*) - 0.5) / count(*)::DOUBLE, 6) AS done FROM named GROUP BY 1",
    "checkpoint_load": f"WITH {_TEXTS} SELECT key, status, 'queued' AS phase, 1 AS version, 'track1' AS units, CAST(NULL AS VARCHAR) AS partial_unit, done AS partial_done_chunks, source_path AS source FROM cp",
    "resumed_jobs": f"""WITH {_TEXTS}, there AS (SELECT DISTINCT source_path FROM h WHERE length(source_path) % 2 = 0)
        SELECT key, status, CASE WHEN source_path IN (FROM there) THEN 'queue' ELSE 'discard' END AS go, started_at FROM cp WHERE status <> 'done'""",
    "config_round_trip": f"WITH {_H} SELECT id, source_path, model, language, id % 2 = 0 AS polish, '1,3' AS selected, CASE WHEN id % 3 = 0 THEN model END AS name, true AS none FROM h",
    "settings_shown": f"""WITH {_H}, q AS (SELECT model, min(id) AS n FROM h GROUP BY 1)
        SELECT h.id, CASE WHEN h.id % 4 <> 0 AND q.n % 3 = 1 THEN 'Fast' ELSE 'Slow' END AS quality, h.id % 2 <> 0 AS tidy, coalesce(language, 'cs') AS language FROM h LEFT JOIN q USING (model)""",
    "chosen_tracks": f"WITH {_NAMED} SELECT call_id, idx FROM named WHERE position = 1",
    "needed_tracks": f"WITH {_NAMED} SELECT call_id, idx FROM named WHERE position = 2 UNION SELECT call_id, idx + 10 FROM named WHERE position = 2",
    "track_labels": f"""WITH {_NAMED}, o AS (SELECT *, CASE WHEN idx = 1 THEN 'Host' ELSE name END AS named FROM named)
        SELECT call_id, idx, named, CASE WHEN named LIKE 'Speaker %' THEN upper(named) ELSE named END AS label,
          CASE WHEN idx = 1 THEN CASE WHEN position = 1 THEN '' ELSE '1=de' END WHEN position = 1 THEN '1=cs' ELSE array_to_string(list_sort(['1=cs', idx || '=de']), ',') END AS languages, CASE WHEN position > 1 THEN 1 ELSE 0 END AS asked FROM o""",
    "recent_names": f"""WITH {_NAMED}, r AS (SELECT list_transform(range(1, 13), lambda i: 'Name ' || i) AS r)
        SELECT call_id, idx, array_to_string(CASE WHEN regexp_matches(name, '^Speaker [0-9]+$') THEN r ELSE list_prepend(name, r[1:11]) END, '|') AS names FROM named, r""",
    "recogniser_tasks": f"""WITH {_H}, f AS (SELECT *, CASE WHEN model LIKE 'groq:%' THEN 'groq' WHEN model LIKE 'elevenlabs:%' THEN 'elevenlabs' WHEN lower(model) LIKE '%parakeet%' THEN 'parakeet' ELSE 'whisper' END AS family FROM h),
        c AS (SELECT *, unnest(range(0, CAST(floor(audio_duration_seconds / 28) AS BIGINT) + 1)) AS n FROM f WHERE family = 'whisper' AND audio_duration_seconds > 0 AND audio_duration_seconds < 2000)
        SELECT CAST(id AS VARCHAR) AS key, family, CAST(n AS INT) AS chunk, CAST(n * 28 AS DOUBLE) AS start, round(least(n * 28.0 + 28, audio_duration_seconds), 3) AS "end" FROM c WHERE n >= id % 3
        UNION ALL SELECT CAST(id AS VARCHAR), family, 0, CAST(0 AS DOUBLE), NULL FROM f WHERE family <> 'whisper'""",
    "recognised_texts": f"""WITH {_H} SELECT CAST(id AS VARCHAR) AS key, 0 AS chunk, CASE WHEN ok THEN CAST(0.5 AS DOUBLE) END AS start, CASE WHEN ok THEN CAST(1.5 AS DOUBLE) END AS "end", CASE WHEN ok THEN CAST(length(source_path) AS VARCHAR) END AS text, NOT ok AS failed FROM (SELECT *, length(source_path) % 10 <> 0 AS ok FROM h)""",
    "benchmark_cells": f"""WITH {_H}, t AS (SELECT coalesce(language, 'auto') AS track, min(source_path) AS path FROM h GROUP BY 1)
        SELECT id, track, CASE WHEN length(path) % 10 <> 0 THEN ' ' || length(path) || ' ' END AS text, length(path) % 10 = 0 AS failed FROM (SELECT DISTINCT model AS id FROM h WHERE contains(model, 'a')), t""",
    "speech_progress": """WITH s AS (SELECT DISTINCT call_id, seq, CAST(round(start * 1000) AS BIGINT) AS a, CAST(round("end" * 1000) AS BIGINT) AS z FROM segments WHERE "end" > start)
        SELECT call_id AS key, CAST(sum(CASE WHEN seq < 40 THEN z - a ELSE 0 END) AS BIGINT) AS done, CAST(sum(z - a) AS BIGINT) AS total, round(sum(CASE WHEN seq < 40 THEN z - a ELSE 0 END) / sum(z - a)::DOUBLE, 6) AS fraction FROM s GROUP BY 1""",
    "track_union": "SELECT DISTINCT call_id, seq, speaker, CASE WHEN coalesce(length(speaker) % 2 = 0, false) THEN 0 ELSE 1 END AS track_no FROM segments",
    "unit_log": "SELECT DISTINCT call_id AS key, lower(speaker) AS unit, CAST(floor(round(start * 1000) / 30000) AS INT) AS chunk, seq FROM segments WHERE lower(speaker) = 'track2' AND floor(round(start * 1000) / 30000) < 3",
    "judge_rounds": f"""WITH {_H}, n AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY id) AS k FROM h)
        SELECT model, count(*) AS runs, round_even(median(elapsed_seconds), 2) AS elapsed_seconds_median, min(elapsed_seconds) AS elapsed_seconds_min, max(elapsed_seconds) AS elapsed_seconds_max, round_even(avg(audio_duration_seconds), 2) AS audio_duration_seconds_mean,
          CAST(NULL AS DOUBLE) AS language_mean, array_to_string(flatten(list(string_split(source_path, '/')[1:3] ORDER BY id) FILTER (WHERE k <= 2)), '|') AS words_examples FROM n GROUP BY 1""",
    "fastest_runs": f"""WITH {_H}, r AS (SELECT model AS id, min(elapsed_seconds) AS elapsed, sum((status = 'success')::INT) % 2 = 0 AS failed FROM h GROUP BY 1)
        SELECT id, CAST(row_number() OVER (ORDER BY elapsed NULLS LAST, id) AS INT) AS place, coalesce(id = (SELECT id FROM r WHERE NOT failed ORDER BY elapsed NULLS LAST, id LIMIT 1), false) AS fastest FROM r""",
    "score_table": f"""WITH {_H}, v AS (SELECT model AS name, round(avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END), 6) AS good FROM h GROUP BY 1),
        r AS (SELECT *, CAST(row_number() OVER (ORDER BY good < 0.5, good DESC, name) AS INT) AS place FROM v)
        SELECT place, '| ' || place || ' | ' || name || ' | ' || CAST(round_even(good, 2) AS DOUBLE) || ' | ' || CASE WHEN good < 0.5 THEN 'gated' ELSE 'ok' END || ' |' AS line FROM r""",
    "first_configs": f"WITH {_H} SELECT model, language, id, source_path FROM (SELECT *, row_number() OVER (PARTITION BY model, language ORDER BY id) AS k FROM h) WHERE k = 1",
    "call_excerpt": """WITH b AS (SELECT call_id, block_no, min(text) AS text FROM blocks GROUP BY ALL), m AS (SELECT call_id, block_no AS top FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY length(text) DESC NULLS LAST, block_no) AS k FROM b) WHERE k = 1)
        SELECT call_id, block_no FROM b JOIN m USING (call_id) WHERE block_no BETWEEN top - 22 AND top + 1""",
    "judge_payload": f"""WITH {_PAIR}, n AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY block_no) AS i FROM p)
        SELECT call_id, string_agg('[' || i || '] RAW: ' || raw || chr(10) || '[' || i || '] EDITED: ' || edited, chr(10) || chr(10) ORDER BY i) AS payload FROM n GROUP BY 1""",
    "failed_edits": f"WITH {_PAIR} SELECT call_id, bool_or(length(raw) > 120 AND (block_no % 50 = 0 OR raw = edited)) AS failed FROM p GROUP BY 1",
    "candidate_bundle": f"""WITH {_H}, g AS (SELECT coalesce(language, 'auto') AS track, model, min(source_path) AS text, count(*) AS n FROM h GROUP BY 1, 2), k AS (SELECT *, chr(CAST(64 + row_number() OVER (PARTITION BY track ORDER BY model) AS INT)) AS letter FROM g)
        SELECT track, string_agg(chr(10) || chr(10) || '===== CANDIDATE ' || letter || ' =====' || chr(10) || trim(text), '' ORDER BY letter) AS body, string_agg(letter || ' = ' || model || '  (' || n || ')', chr(10) ORDER BY letter) AS key FROM k GROUP BY 1""",
    "quality_figures": f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT *, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS g FROM t)
        SELECT doc_id, CAST(length(text) AS INT) AS chars, CAST(len(w) AS INT) AS words, CASE WHEN len(w) >= 5 THEN round_even(1.0 - len(list_distinct(g)) / len(g), 4) ELSE 0.0 END AS repeat_5gram, array_to_string(list_filter({_PHRASES}, lambda p: contains(lower(text), p)), '|') AS hits FROM g""",
    "plain_transcript": f"""WITH s AS (SELECT DISTINCT concat_ws('/', call_id, coalesce(speaker, '')) AS call_id, seq, CAST(round(start * 1000) AS BIGINT) AS start_ms, coalesce(text, '') AS text FROM segments),
        j AS (SELECT call_id, regexp_replace(string_agg(text, ' ' ORDER BY start_ms NULLS FIRST, seq), '^{_WS}+|{_WS}+$', '', 'g') AS text FROM s GROUP BY 1)
        SELECT call_id, CASE WHEN text <> '' THEN text || chr(10) ELSE '' END AS text FROM j""",
    "transcripts_again": rf"""WITH b AS (SELECT call_id, block_no, min(regexp_replace(text, '([*]|{_WS})+', ' ', 'g')) AS text FROM blocks GROUP BY ALL)
        SELECT call_id, regexp_replace('---' || chr(10) || 'model: x' || chr(10) || '---' || chr(10) || chr(10) || string_agg('**S' || block_no % 3 || '** [00:01]' || chr(10) || trim(coalesce(text, '')), chr(10) || chr(10) ORDER BY block_no), '\s+$', '') AS text FROM b GROUP BY 1""",
    "runs_with_texts": f"""WITH {_H}, t AS (SELECT output_path, min(model) AS text FROM h WHERE id % 2 = 0 AND output_path IS NOT NULL GROUP BY 1)
        SELECT id, CASE WHEN id % 3 <> 0 AND coalesce(h.output_path, '') <> '' THEN coalesce(t.text, '') END AS transcript_text FROM h LEFT JOIN t USING (output_path)""",
    "middle_clips": f"""WITH {_H} SELECT id, greatest(CAST(0 AS DOUBLE), audio_duration_seconds / 2 - 210) AS start, CASE WHEN NOT coalesce(audio_duration_seconds, 0) > 0 THEN CAST(0 AS DOUBLE)
        WHEN audio_duration_seconds * CAST(0.35 AS DOUBLE) + 90 > audio_duration_seconds THEN greatest(CAST(0 AS DOUBLE), audio_duration_seconds - 90) ELSE audio_duration_seconds * CAST(0.35 AS DOUBLE) END AS analysis FROM h""",
    "transcripts_written": f"""WITH {_H}, r AS (SELECT *, id % 2 = 0 AS two FROM h WHERE source_path IS NOT NULL),
        x AS (SELECT *, unnest(CASE WHEN two THEN [false, true] ELSE [false] END) AS raw FROM r)
        SELECT id, raw, concat_ws(chr(10), '---', 'source: ' || source_path, 'model: ' || model, 'language: ' || coalesce(nullif(language, ''), 'auto'), 'transcribed_at: ' || started_at, 'elapsed_seconds: ' || CAST(round_even(elapsed_seconds, 0) AS BIGINT), 'speakers: 2',
          CASE WHEN two THEN 'polished: ' || CASE WHEN raw THEN 'false' ELSE 'true' END END, '---', '', CASE WHEN raw THEN 'raw' ELSE 'said' END) AS text FROM x""",
    "requested_jobs": f"""WITH {_H} SELECT id, CASE WHEN id % 2 = 0 THEN '2=' || id ELSE '1=' || model END AS track_names, CASE WHEN id % 3 = 0 THEN '1,3' ELSE '7' END AS speakers, CASE WHEN id % 10 = 0 THEN NULL WHEN id % 5 = 0 THEN '4=[5]' ELSE '1=[2]' END AS track_subtractions FROM h""",
    "effective_names": f"WITH {_NAMED} SELECT call_id, idx, CASE WHEN idx = 1 THEN 'Host' ELSE name END AS name FROM named UNION ALL SELECT DISTINCT call_id, 99, 'Speaker 99' FROM named",
    "zipped_texts": "WITH s AS (SELECT DISTINCT call_id, seq, speaker FROM segments), n AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY seq) AS k, count(*) OVER (PARTITION BY call_id) AS n FROM s) SELECT call_id, seq, speaker FROM n WHERE k < n",
    "streamed_log": "SELECT DISTINCT call_id AS key, lower(speaker) AS unit, CAST(floor(round(start * 1000) / 30000) AS INT) AS chunk, seq AS line_no, round(start, 3) AS start FROM segments",
    "live_stretches": """WITH s AS (SELECT DISTINCT call_id AS key, coalesce(speaker, '') AS speaker, seq, CAST(round(start * 1000) AS BIGINT) AS ms FROM segments WHERE start IS NOT NULL),
        l AS (SELECT *, sum(CASE WHEN ms - before <= 1000 THEN 0 ELSE 1 END) OVER (PARTITION BY key, speaker ORDER BY ms, seq ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT *, lag(ms) OVER (PARTITION BY key, speaker ORDER BY ms, seq) AS before FROM s))
        SELECT key, speaker, count(*) AS segments, min(ms) AS start_ms FROM l GROUP BY key, speaker, part""",
    "voted_edits": rf"""WITH {_PAIR}, w AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(coalesce(edited, raw), '{_WS}+'), lambda x: x <> ''), ' ') AS words FROM p)
        SELECT call_id, block_no, CASE WHEN raw = '' OR raw IS NULL THEN raw ELSE coalesce(nullif(words, ''), raw) END AS text FROM w""",
    "probed_streams": """WITH t AS (SELECT DISTINCT call_id, idx, channels, title FROM tracks),
        l AS (SELECT call_id, length(string_agg('{"index":' || idx || ',"codec_type":"audio","channels":' || channels || ',"tags":' || CASE WHEN title IS NULL THEN '{}' ELSE CAST(json_object('title', ' ' || title) AS VARCHAR) END || '}', ',')) AS n FROM t GROUP BY 1)
        SELECT call_id, idx, channels, nullif(regexp_replace(title, '^[\\s\\x0b\\x{85}\\p{Z}]+|[\\s\\x0b\\x{85}\\p{Z}]+$', '', 'g'), '') AS title, CAST(12.5 AS DOUBLE) AS duration FROM t JOIN l USING (call_id) WHERE n % 6 <> 0""".replace("\\\\", "\\"),
    "dropped_files": rf"""WITH {_H}, p AS (SELECT id, CASE WHEN id % 2 = 0 THEN upper(source_path) WHEN id % 5 = 0 THEN source_path || '.txt' ELSE source_path END AS path FROM h)
        SELECT id, path FROM p WHERE regexp_matches(lower(path), '[^/]\.(mp3|wav|m4a|aac|flac|mp4|mov|m4v|mkv|webm)$')""",
    "wav_again": "SELECT vec_id, CAST(len(embedding) AS INT) AS n, CAST(list_sum(list_transform(embedding, lambda x: trunc(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, CAST(x AS DOUBLE) * 3)) * 32767))) AS BIGINT) AS total, 32 AS part FROM embeddings",
    "playback_clocks": f"WITH {_H} SELECT model AS token, CAST(max(id) + 0.25 AS DOUBLE) AS seconds FROM h WHERE id % 3 <> 0 GROUP BY 1",
    "track_sets": """WITH t AS (SELECT call_id, list(DISTINCT idx ORDER BY idx) AS a FROM tracks GROUP BY 1)
        SELECT call_id, array_to_string(CASE WHEN len(a) > 1 THEN a[2:] ELSE a END, ',') AS less, array_to_string(list_append(a, 50), ',') AS more, CAST(len(a) - 1 AS INT) AS place, 0 AS none FROM t""",
    "reply_objects": f"WITH {_H} SELECT id, CASE WHEN id % 7 = 0 THEN '' ELSE CAST(id AS VARCHAR) END AS a, CASE WHEN id % 4 = 0 THEN 'none' ELSE 'x|' END AS parts FROM h",
    "runs_upserted": f"""WITH {_H}, g AS (SELECT model AS id, min(id) AS n, CAST(count(*) AS DOUBLE) AS s FROM h GROUP BY 1), k AS (SELECT *, n % 5 <> 0 AS old, n % 2 = 0 OR n % 5 = 0 AS new, n % 3 = 0 AS bad FROM g)
        SELECT id, CASE WHEN new AND NOT bad THEN s * 2 WHEN old THEN s END AS seconds, CASE WHEN new AND bad THEN 'boom' END AS error, CASE WHEN old THEN 4 END AS rating, CASE WHEN old THEN 'good' ELSE '' END AS notes FROM k WHERE old OR new""",
    "log_compacted": "WITH l AS (SELECT DISTINCT call_id AS key, lower(speaker) AS unit, CAST(floor(round(start * 1000) / 30000) AS INT) AS chunk, seq FROM segments) SELECT * FROM l WHERE unit = 'track1' OR (unit = 'track2' AND chunk < 3)",
    "history_recorded": f"WITH {_H} SELECT id, model, status, turns_json IS NOT NULL AND id % 2 = 1 AS turns FROM h WHERE id IS NOT NULL",
    "jobs_analysed": f"WITH {_H} SELECT id, model, CASE WHEN id % 3 = 0 THEN CAST(id * 1.5 AS DOUBLE) ELSE audio_duration_seconds END AS audio_duration_seconds, CASE WHEN id % 4 = 0 THEN 2 END AS twin FROM h",
    "recent_calls": f"WITH {_H} SELECT id, output_path FROM (SELECT * FROM h ORDER BY id DESC LIMIT 60) WHERE status = 'success' AND output_path IN (SELECT output_path FROM h WHERE id % 3 <> 0 AND output_path IS NOT NULL)",
}
