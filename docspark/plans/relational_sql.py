"""SQL that the relational queries must agree with."""

from __future__ import annotations

_NORM = "trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
_TOKENS = f"list_filter(string_split({_NORM}, ' '), lambda w: length(w) > 1)"
_STOP = "['the', 'of', 'and', 'to', 'in', 'is', 'it', 'for', 'on']"

_KEYWORD = f"""
d AS (SELECT doc_id, {_TOKENS} AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
p AS (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d), tf AS (SELECT doc_id, len, term, count(*) AS tf FROM p GROUP BY ALL),
idf AS (SELECT term, ln(1 + (max(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf, n GROUP BY term),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(list_filter({_TOKENS}, lambda w: NOT list_contains({_STOP}, w))) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id AS id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM tf JOIN q USING (term) JOIN idf USING (term), n GROUP BY item_id, doc_id),
kw AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 100)"""

_DENSE = """
ds AS (SELECT q.vec_id AS item_id, v.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q JOIN (SELECT DISTINCT item_id FROM benchmark) b ON q.vec_id = b.item_id, embeddings v),
dn AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM ds WHERE score > 0 QUALIFY rank <= 100)"""

_FUSED = f"""WITH {_KEYWORD.strip()}, {_DENSE.strip()},
u AS (SELECT item_id, id, rank, rank AS kp, NULL::BIGINT AS dp FROM kw UNION ALL SELECT item_id, id, rank, NULL::BIGINT, rank FROM dn),
f AS (SELECT item_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min(kp) AS kp, min(dp) AS dp FROM u GROUP BY item_id, id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, kp NULLS LAST, dp NULLS LAST, id) AS rank FROM f)"""

_TOP_DENSE = """ds AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, q.label AS query_label, v.label AS label,
  round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)"""

_SCORED = """WITH m AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic, CASE WHEN ('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 4))::INT % 3 <> 0 THEN 1 ELSE 0 END AS said
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
sc AS (SELECT doc_id, lang, source, n_chars, said, said = quality AS ok, CASE WHEN toxic = 1 THEN said = 0 END AS refused, CASE WHEN toxic = 0 THEN said = quality END AS clean_ok FROM m)"""

_RUNS = _SCORED + """, runs AS (SELECT lang, source, avg(CAST(ok AS INT)::DOUBLE) AS ok, avg(CAST(refused AS INT)::DOUBLE) AS refused, avg(CAST(clean_ok AS INT)::DOUBLE) AS clean_ok,
  sum(said)::DOUBLE / nullif(sum(n_chars), 0) AS said_share FROM sc GROUP BY lang, source),
long AS (UNPIVOT (SELECT lang, ok, refused, clean_ok, said_share FROM runs) ON ok, refused, clean_ok, said_share INTO NAME metric VALUE v),
every AS (SELECT DISTINCT r.lang, m.metric FROM runs r, (VALUES ('ok'), ('refused'), ('clean_ok'), ('said_share')) m(metric)),
two AS (SELECT e.lang, e.metric, avg(v) AS mean, min(v) AS min, max(v) AS max FROM every e LEFT JOIN long l ON e.lang = l.lang AND e.metric = l.metric GROUP BY e.lang, e.metric)"""

ORACLE_SQL = {
    "bm25_topk": f"WITH {_KEYWORD.strip()} SELECT item_id, id, score, rank FROM kw WHERE rank <= 10",
    "dense_topk": f"WITH {_TOP_DENSE} SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ds WHERE score > 0 QUALIFY rank <= 10",
    "dense_cells": f"WITH {_TOP_DENSE} SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ds WHERE score > 0 QUALIFY rank <= 10",
    "hybrid_rrf": _FUSED + " SELECT item_id, id, rrf, rank FROM r WHERE rank <= 20",
    "hybrid_guaranteed_slots": _FUSED.replace("WITH ", "WITH RECURSIVE ", 1)
    + """,
top AS (SELECT item_id, list(id ORDER BY rank) AS top FROM r WHERE rank <= 8 GROUP BY item_id),
su AS (SELECT item_id, list(id ORDER BY o, rank) AS l FROM (SELECT item_id, id, 0 AS o, rank FROM kw WHERE rank <= 3 UNION ALL SELECT item_id, id, 1, rank FROM dn WHERE rank <= 2) GROUP BY item_id),
sure AS (SELECT item_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS sure FROM su),
fold AS (SELECT item_id, top, sure, 1 AS k FROM top JOIN sure USING (item_id)
  UNION ALL SELECT item_id, CASE WHEN list_contains(top, sure[k]) OR len(list_filter(top, lambda x: NOT list_contains(sure, x))) = 0 THEN top
    ELSE list_transform(top, lambda x, i: CASE WHEN i = list_max(list_filter(range(1, len(top) + 1), lambda j: NOT list_contains(sure, top[j]))) THEN sure[k] ELSE x END) END, sure, k + 1
  FROM fold WHERE k <= len(sure)),
done AS (SELECT item_id, top FROM fold QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY k DESC) = 1)
SELECT item_id, unnest(top) AS id, unnest(range(1, len(top) + 1)) AS rank FROM done""",
    "post_rank_filter_boost": _FUSED
    + """, g AS (SELECT r.item_id, r.id, r.rank, e.label AS chapter, m.label AS query_chapter, r.id // 10 = r.item_id // 10 AS own
  FROM r LEFT JOIN embeddings e ON r.id = e.vec_id LEFT JOIN embeddings m ON r.item_id = m.vec_id),
k AS (SELECT *, own AND row_number() OVER (PARTITION BY item_id, own ORDER BY rank) <= 4 AS front FROM g WHERE query_chapter IS NULL OR chapter IS NULL OR chapter = query_chapter)
SELECT item_id, id, row_number() OVER (PARTITION BY item_id ORDER BY front DESC, rank) AS rank FROM k""",
    "hit_at_k": f"""WITH {_TOP_DENSE}, t AS (SELECT * FROM ds WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 9),
h AS (SELECT query_id, label = query_label AS hit, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM t WHERE vec_id <> query_id),
b AS (SELECT query_id, min(rank) FILTER (hit AND rank <= 8) AS best FROM h GROUP BY query_id)
SELECT 'dense' AS mode, count(*) AS n, count(best) AS found, count(*) FILTER (best = 1) AS first, round(avg(best), 6) AS mean_rank FROM b""",
    "resume_anti": "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "only_semi": "SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)",
    "claims_left_missing_keep": """SELECT source, count(*) FILTER (coalesce(quality, 1) = 1) AS kept, count(*) FILTER (coalesce(quality, 1) <> 1) AS dropped
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source""",
    "gold_band_join": """SELECT a.o_custkey, a.o_orderkey, b.o_orderkey AS other_key FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
  AND abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) <= 1""",
    "nearest_pick": "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(l_linenumber - 3), l_linenumber) = 1",
    "asof_prev_event": """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts)
SELECT p.event_id, p.user_id, v.view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "forward_fill_chapter": """WITH c AS (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS chapter, max(CASE WHEN turn >= 6 THEN 1 ELSE 0 END) OVER w AS ended
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING)) SELECT conv_id, turn, role, chapter FROM c WHERE ended = 0 AND chapter IS NOT NULL""",
    "sections_of_turns": """WITH c AS (SELECT conv_id, turn, role, role IS DISTINCT FROM lag(role) OVER w AS changed, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS section
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING)) SELECT * FROM c WHERE section > 0""",
    "word_offsets": f"""WITH c AS (SELECT conv_id, turn, CAST(len({_TOKENS}) AS BIGINT) AS n_words FROM conversations)
SELECT conv_id, turn, n_words, CAST(coalesce(sum(n_words) OVER (PARTITION BY conv_id ORDER BY turn, n_words ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins FROM c""",
    "greedy_pack": """WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS n FROM documents),
f AS (SELECT doc_id, n, 0 AS i, 0::BIGINT AS held, NULL::BIGINT AS chars, 0::BIGINT AS seq FROM l
  UNION ALL SELECT doc_id, n, i + 1,
    CASE WHEN grown > 120 THEN 0 ELSE grown END, CASE WHEN grown > 120 THEN grown WHEN i + 1 = len(n) AND grown > 0 THEN grown END, seq + CASE WHEN chars IS NULL THEN 0 ELSE 1 END
  FROM (SELECT *, CASE WHEN held = 0 THEN n[i + 1] ELSE held + 1 + n[i + 1] END AS grown FROM f WHERE i < len(n)))
SELECT doc_id, seq, chars FROM f WHERE chars IS NOT NULL""",
    "score_items": _SCORED + " SELECT * FROM sc",
    "two_level_summary": _RUNS + " SELECT lang, metric, round(mean, 6) AS mean, round(min, 6) AS min, round(max, 6) AS max FROM two",
    "metric_pivot": _RUNS + """ SELECT metric, round(max(mean) FILTER (lang = 'en'), 6) AS en, round(max(mean) FILTER (lang = 'de'), 6) AS de, round(max(mean) FILTER (lang = 'fr'), 6) AS fr,
  round(max(mean) FILTER (lang = 'es'), 6) AS es FROM two WHERE metric <> 'said_share' GROUP BY metric""",
    "latency_percentiles": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS value, round(median(value), 6) AS latency_median, round(quantile_disc(value, 0.95), 6) AS latency_p95 FROM events GROUP BY event_type",
    "majority_vote": """WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)
SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f, event_type) = 1""",
    "failure_reasons": _SCORED + """, r AS (SELECT source, doc_id, unnest([CASE WHEN NOT ok THEN 'wrong' END, CASE WHEN refused = false THEN 'shown' END, CASE WHEN n_chars > 5000 THEN 'long' END]) AS reason FROM sc)
SELECT source, count(DISTINCT doc_id) AS n_failing, string_agg(DISTINCT reason, ', ' ORDER BY reason) AS reasons FROM r WHERE reason IS NOT NULL GROUP BY source""",
    "quality_funnel": _SCORED + """ SELECT source, count(*) AS n, count(*) FILTER (said = 1) AS generated, count(*) FILTER (said = 1 AND ok) AS checked, count(*) FILTER (said = 1 AND ok AND coalesce(clean_ok, false)) AS clean,
  round(count(*) FILTER (said = 1 AND ok AND coalesce(clean_ok, false)) / count(*), 6) AS share FROM sc GROUP BY source""",
    "conversation_transcript": """WITH t AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role || ': ' || text) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, md5(t) AS transcript_md5, CAST(length(t) AS BIGINT) AS chars FROM t""",
    "checked_answers": f"""WITH {_KEYWORD.strip()}, best3 AS (SELECT item_id, id, rank AS n FROM kw WHERE rank <= 3),
pas AS (SELECT item_id, n, {_NORM} AS norm FROM best3 JOIN documents ON doc_id = id),
itm AS (SELECT item_id, text, CAST(length(text) // 3 AS INT) AS third FROM benchmark),
clm AS (SELECT item_id, 0 AS k, 1 AS n, text AS quote, text FROM itm UNION ALL SELECT item_id, 1, 2, substr(text, 1, 40), text FROM itm UNION ALL SELECT item_id, 2, 1, substr(text, third, third), text FROM itm UNION ALL SELECT item_id, 3, 7, substr(text, 1, 20), text FROM itm),
quo AS (SELECT item_id, k, n, quote, 'said of ' || substr(text, 1, 10) AS said, {_NORM.replace("(text)", "(quote)")} AS nq FROM clm),
lab AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id), ver AS (SELECT item_id, q FROM best3 JOIN lab ON doc_id = id WHERE n = 1),
jud AS (SELECT quo.item_id, said, quote, coalesce(contains(norm, nq) AND nq <> '', false) AND NOT (k = 2 AND ver.item_id IS NOT NULL AND NOT coalesce(ver.q = 1, false)) AS kept
  FROM quo LEFT JOIN pas ON pas.item_id = quo.item_id AND pas.n = quo.n LEFT JOIN ver ON ver.item_id = quo.item_id),
cnt AS (SELECT item_id, count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT kept) AS n_dropped, bool_or(kept AND regexp_matches(lower(said || ' ' || quote), 'a|e')) AS attributed FROM jud GROUP BY item_id),
fin AS (SELECT *, ['supported', 'partial', 'differing', 'not_found'][item_id % 4 + 1] AS st FROM cnt), nam AS (SELECT *, CASE WHEN st = 'differing' AND NOT attributed THEN 'supported' ELSE st END AS named FROM fin)
SELECT item_id AS question_id, CASE WHEN n_kept = 0 THEN 'not_found' WHEN named IN ('supported', 'not_found') THEN CASE WHEN n_dropped > 0 THEN 'partial' ELSE 'supported' END ELSE named END AS status,
  CASE WHEN n_kept = 0 AND item_id % 5 = 0 THEN 'personal_nothing' WHEN n_kept = 0 THEN 'not_in_library' WHEN item_id % 5 = 0 THEN 'personal_prefix' WHEN item_id % 3 = 0 THEN 'premise_prefix' ELSE '' END AS message, n_kept, n_dropped FROM nam""",
    "daily_cap": "SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 5 AS accepted FROM events",
    "rate_limit_decisions": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, 0::BIGINT AS k, []::DOUBLE[] AS kept, NULL::BIGINT AS event_id, NULL::BOOLEAN AS accepted FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT f.user_id, e.k, CASE WHEN len(list_filter(f.kept, lambda x: e.t - x <= 86400)) < 3 THEN list_append(list_filter(f.kept, lambda x: e.t - x <= 86400), e.t) ELSE list_filter(f.kept, lambda x: e.t - x <= 86400) END,
    e.event_id, len(list_filter(f.kept, lambda x: e.t - x <= 86400)) < 3 FROM f JOIN e ON f.user_id = e.user_id AND e.k = f.k + 1)
SELECT user_id, event_id, accepted FROM f WHERE k > 0""",
    "sm2_schedule": """WITH RECURSIVE g AS (SELECT user_id, event_type, CASE WHEN value < 5 THEN 0 WHEN value < 20 THEN 3 WHEN value < 60 THEN 4 ELSE 5 END AS q, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_type, 0::BIGINT AS k, 0 AS reps, 0::BIGINT AS iv, 2.5::DOUBLE AS ease, 0 AS lapses FROM (SELECT DISTINCT user_id, event_type FROM g)
  UNION ALL SELECT f.user_id, f.event_type, g.k, CASE WHEN q < 3 THEN 0 ELSE reps + 1 END,
    CASE WHEN q < 3 THEN 0 WHEN reps = 0 THEN 1 WHEN reps = 1 THEN 3 ELSE CAST(floor(iv * ease * CASE q WHEN 3 THEN 0.8::DOUBLE WHEN 5 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END + 0.5::DOUBLE) AS BIGINT) END,
    CASE WHEN q < 3 THEN ease ELSE greatest(1.3::DOUBLE, ease + (0.1::DOUBLE - (5 - q) * (0.08::DOUBLE + (5 - q) * 0.02::DOUBLE))) END, lapses + CASE WHEN q < 3 THEN 1 ELSE 0 END
  FROM f JOIN g ON f.user_id = g.user_id AND f.event_type = g.event_type AND g.k = f.k + 1)
SELECT user_id, event_type, reps, iv AS interval, round(ease, 6) AS ease, lapses FROM f QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY k DESC) = 1""",
    "activity_days": """WITH s AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), b AS (SELECT min(day) AS a, max(day) AS z FROM s),
p AS (SELECT CAST(unnest(generate_series(a - CAST((dayofweek(a) + 1) % 7 AS INT), z + CAST(6 - (dayofweek(z) + 1) % 7 AS INT), INTERVAL 1 DAY)) AS DATE) AS day FROM b)
SELECT CAST(p.day AS VARCHAR) AS day, CAST(coalesce(n, 0) AS BIGINT) AS total FROM p LEFT JOIN s ON p.day = s.day""",
    "latest_wins_cache": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
}
