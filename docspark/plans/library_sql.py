"""SQL that the queries of the library's own pipeline must agree with."""

from __future__ import annotations

from docspark.plans.relational_sql import _FUSED, _SCORED


def _norm(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _packed(source: str, by: str, over: int) -> str:
    """Named steps that merge the rows (by, seq, pg, text) of ``source`` in order until the normalised text is longer than ``over``: ends in (by, chunk, pg, text)."""
    return f"""
{source}_n AS (SELECT *, length({_norm("text")}) AS size, row_number() OVER (PARTITION BY {by} ORDER BY seq) AS k FROM {source}),
{source}_f AS (SELECT {by}, k, 0::BIGINT AS chunk, size AS held FROM {source}_n WHERE k = 1
  UNION ALL SELECT n.{by.replace(', ', ', n.')}, n.k, CASE WHEN held > {over} THEN chunk + 1 ELSE chunk END, CASE WHEN held > {over} THEN n.size ELSE held + n.size + CASE WHEN held > 0 AND n.size > 0 THEN 1 ELSE 0 END END
  FROM {source}_f f JOIN {source}_n n ON {' AND '.join(f'n.{b} = f.{b}' for b in by.split(', '))} AND n.k = f.k + 1),
{source}_c AS (SELECT {by}, chunk, min_by(pg, k) AS pg, trim(string_agg(trim(text), ' ' ORDER BY k)) AS text FROM {source}_f JOIN {source}_n USING ({by}, k) GROUP BY {by}, chunk)"""


#: The unit walk by windows: pieces of lines between round brackets in reading order, the running count of opened units, and whether a unit is open.
_WALK = f"""WITH e AS (SELECT CAST(conv_id % 3 AS INT) AS book_id, CAST(conv_id AS VARCHAR) AS chapter, conv_id * 4 + turn // 2 AS pg, turn AS seq,
  CASE turn WHEN 0 THEN substr(text, 1, 20) WHEN 4 THEN substr(regexp_replace(text, '[(),.]', '', 'g'), 1, 12) ELSE replace(replace(text, ', ', ' (' || turn % 4 || ') '), '. ', ' (the end) ') END AS body FROM conversations),
y AS (SELECT *, CASE WHEN seq = 0 THEN 'title' WHEN length({_norm("body")}) <= 15 AND NOT regexp_matches(body, '[0-9]') THEN 'short' ELSE 'line' END AS what FROM e),
z AS (SELECT *, CASE what WHEN 'line' THEN string_split_regex(body, '\\([^()]*\\)') ELSE [body] END AS between, regexp_extract_all(body, '\\(([^()]*)\\)', 1) AS brackets FROM y),
i AS (SELECT *, unnest(range(len(between))) AS k FROM z),
n AS (SELECT book_id, chapter, pg, seq, 2 * k AS k, CASE WHEN what <> 'line' THEN what WHEN k + 1 = len(between) THEN 'tail' ELSE 'seg' END AS kind, between[k + 1] AS text FROM i
  UNION ALL SELECT book_id, chapter, pg, seq, 2 * k + 1, CASE WHEN regexp_full_match(trim(brackets[k + 1]), '[0-9]+') THEN 'mark' ELSE 'core' END, brackets[k + 1] FROM i WHERE what = 'line' AND k + 1 < len(between)),
a AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY pg, seq, k) AS pos, kind = 'core' OR (kind IN ('seg', 'tail') AND regexp_matches(text, '\\S')) AS said,
  CASE WHEN kind IN ('core', 'mark') THEN '(' || text || ')' WHEN kind = 'tail' THEN text || chr(10) ELSE text END AS shown FROM n),
f AS (SELECT *, chapter IS DISTINCT FROM lag(chapter) OVER (PARTITION BY book_id ORDER BY pos) AS starts, said AND sum(CAST(said AS INT)) OVER (PARTITION BY book_id, chapter ORDER BY pos) = 1 AS first FROM a),
v0 AS (SELECT *, kind = 'core' OR first AS opens, sum(CAST(kind = 'core' OR first AS INT)) OVER (PARTITION BY book_id ORDER BY pos) AS unit, sum(CAST(kind = 'core' OR first AS INT)) OVER (PARTITION BY book_id, chapter ORDER BY pos) > 0 AS in_unit,
  CAST(sum(CAST(k = 0 AND kind IN ('seg', 'tail') AS INT)) OVER (PARTITION BY book_id ORDER BY pos) AS BIGINT) AS para FROM f),
v AS (SELECT * FROM v0 WHERE kind IN ('seg', 'tail', 'core', 'mark'))"""

_ENVELOPE_SCOPES = "['answerable', 'personal_fatwa', 'other_madhhab', 'contemporary', 'not_in_library', 'unknown']"
_CITES = "[{'book_id': 1, 'page': i}]"

ORACLE_SQL = {
    "passage_corpus": f"""WITH RECURSIVE c AS (SELECT CAST(conv_id AS VARCHAR) AS para, turn, role, text FROM conversations),
u AS (SELECT para, turn AS seq, turn AS pg, text FROM c WHERE role = 'user' AND CAST(para AS BIGINT) % 3 <> 0),
l AS (SELECT para, CAST(turn AS VARCHAR) AS heading, turn AS pg, unnest(range(len(x))) AS seq, unnest(x) AS text FROM (SELECT *, string_split(text, chr(10)) AS x FROM c WHERE role = 'assistant')),
{_packed("u", "para", 120)}, {_packed("l", "para, heading", 60)},
every AS (
  SELECT 'unit' AS kind, 1 AS book_id, para, pg, NULL::VARCHAR AS heading, text FROM u_c
  UNION ALL SELECT 'paragraph', 1, para, min(turn), NULL, 'bare' FROM c WHERE para NOT IN (SELECT para FROM u) GROUP BY para
  UNION ALL SELECT 'note', 2, para, turn, NULL, text FROM c WHERE role = 'assistant' AND length({_norm("text")}) > 20
  UNION ALL SELECT 'section', 3, para, pg, heading, text FROM l_c
  UNION ALL SELECT 'contents', 1, NULL, 1, NULL, string_agg(r_name, ', ' ORDER BY r_name) FROM region),
t AS (SELECT *, {_norm("text")} AS norm, len(list_filter(string_split({_norm("text")}, ' '), lambda w: length(w) > 1)) AS n FROM every)
SELECT kind, book_id, para, pg, heading, md5(norm) AS norm_md5, CAST(n AS BIGINT) AS n_tokens, CASE WHEN book_id <> 1 AND regexp_matches(text, '^(Et|The|La)') AND n < 60 THEN 0.3::DOUBLE ELSE 1.0 END AS weight FROM t""",
    "lemma_links": f"""WITH RECURSIVE c AS (SELECT conv_id, turn, {_norm("text")} AS norm FROM conversations),
u AS (SELECT *, norm || coalesce(' ' || lead(norm) OVER w, '') || coalesce(' ' || lead(norm, 2) OVER w, '') AS joined, length(norm) + 1 AS e1,
  length(norm) + 2 + coalesce(length(lead(norm) OVER w), 0) AS e2, lead(turn) OVER w AS t2, lead(turn, 2) OVER w AS t3 FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s0 AS (SELECT *, string_split(norm, ' ') AS w FROM c WHERE turn % 2 = 1 AND norm <> ''),
m AS (SELECT conv_id, conv_id || ':' || turn AS lemma_id, CASE WHEN (turn + conv_id) % 10 = 3 THEN w[1] ELSE array_to_string(list_filter(CASE turn WHEN 3 THEN [w[3], w[4], w[6], w[7]] WHEN 5 THEN [w[3], 'zzz', w[5], w[6]] WHEN 7 THEN [w[3], 'zzz', 'yyy', w[6]]
  ELSE w[3:6] END, lambda x: x IS NOT NULL), ' ') END AS lemma FROM s0),
k AS (SELECT *, contains(trim(lemma), ' ') AS long FROM m WHERE lemma <> ''),
x AS (SELECT lemma_id, turn AS idx FROM k JOIN u USING (conv_id) WHERE long AND contains(norm, lemma)),
s AS (SELECT lemma_id, CASE WHEN instr(joined, lemma) + length(lemma) - 1 <= e1 THEN turn WHEN instr(joined, lemma) + length(lemma) - 1 <= e2 THEN t2 ELSE t3 END AS idx
  FROM k JOIN u USING (conv_id) WHERE long AND contains(joined, lemma) AND lemma_id NOT IN (SELECT lemma_id FROM x)),
-- Words in order: the longest common run (first in the lemma, then in the text), then what lies before and behind it.
o AS (SELECT lemma_id, turn AS idx, string_split(lemma, ' ') AS a, list_filter(string_split(joined, ' '), lambda v: v <> '') AS b FROM k JOIN u USING (conv_id) WHERE long AND lemma_id NOT IN (SELECT lemma_id FROM x) AND lemma_id NOT IN (SELECT lemma_id FROM s)),
r AS (SELECT lemma_id, idx, a, b, 0 AS got FROM o UNION ALL
  SELECT lemma_id, idx, CASE side WHEN 0 THEN a[1:f.i - 1] ELSE a[f.i + f.l:] END, CASE side WHEN 0 THEN b[1:f.j - 1] ELSE b[f.j + f.l:] END, CASE side WHEN 0 THEN f.l ELSE 0 END
  FROM (SELECT *, coalesce({", ".join(f"CASE WHEN len(a) >= {i + size - 1} AND len(list_filter(range(1, len(b) - {size - 2}), lambda j: b[j:j + {size - 1}] = a[{i}:{i + size - 1}])) > 0 THEN {{'l': {size}, 'i': {i}, 'j': list_filter(range(1, len(b) - {size - 2}), lambda j: b[j:j + {size - 1}] = a[{i}:{i + size - 1}])[1]}} END" for size in (4, 3, 2, 1) for i in range(1, 6 - size))}) AS f FROM r), (VALUES (0), (1)) t(side) WHERE f IS NOT NULL),
g AS (SELECT lemma_id, idx, sum(got) AS got FROM r GROUP BY ALL), h AS (SELECT g.*, got::DOUBLE / len(string_split(lemma, ' ')) AS score FROM g JOIN k USING (lemma_id)),
best AS (SELECT lemma_id, arg_max(idx, (score, -idx)) AS idx, max(score) AS score FROM h GROUP BY lemma_id)
SELECT lemma_id, idx, 'exact' AS method, 1.0::DOUBLE AS score FROM x UNION ALL SELECT lemma_id, idx, 'exact_span', 1.0 FROM s UNION ALL SELECT lemma_id, NULL, 'too_short', 0.0 FROM k WHERE NOT long
UNION ALL SELECT lemma_id, CASE WHEN score >= 0.75 THEN idx END, CASE WHEN score >= 0.75 THEN 'fuzzy' ELSE 'none' END, round(score, 3) FROM best""",
    "unit_walk": _WALK + """ SELECT book_id, CAST(unit AS BIGINT) AS unit, any_value(chapter) AS chapter, min_by(para, pos) AS para, CAST(min_by(pg, pos) AS INT) AS pg, min_by(CASE kind WHEN 'core' THEN trim(text) ELSE '' END, pos) AS core,
  md5(string_agg(shown, '' ORDER BY pos)) AS text_md5, CAST(sum(length(shown)) AS BIGINT) AS chars FROM v WHERE in_unit GROUP BY book_id, unit""",
    "marker_links": _WALK + f""", g AS (SELECT *, coalesce(sum(CASE WHEN kind = 'mark' THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + sum(CASE WHEN starts OR kind IN ('title', 'core') THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY pos) AS stretch FROM v0),
x AS (SELECT book_id, stretch, {_norm("coalesce(string_agg(shown, ' ' ORDER BY pos) FILTER (kind IN ('seg', 'tail', 'core')), '')")} AS said FROM g GROUP BY book_id, stretch),
k AS (SELECT *, last_value(CASE WHEN opens THEN CASE kind WHEN 'core' THEN trim(text) ELSE '' END END IGNORE NULLS) OVER b AS core, last_value(CASE WHEN opens THEN pg END IGNORE NULLS) OVER b AS opened,
  last_value(CASE WHEN kind = 'title' THEN {{'t': trim(text, '[]() ')}} WHEN said THEN {{'t': NULL}} END IGNORE NULLS) OVER b AS title FROM g WINDOW b AS (PARTITION BY book_id ORDER BY pos)),
w AS (SELECT k.*, list_filter(string_split(x.said, ' '), lambda s: s <> '') AS ws, CAST(trim(text) AS BIGINT) AS n FROM k JOIN x USING (book_id, stretch) WHERE kind = 'mark'),
l AS (SELECT *, len(ws) = 0 AND coalesce(title.t, '') <> '' AS named, list_filter(string_split({_norm("core")}, ' '), lambda s: s <> '') AS cs FROM w),
m AS (SELECT *, CASE WHEN named THEN {_norm("title.t")} WHEN len(ws) = 0 THEN CASE WHEN in_unit THEN coalesce(array_to_string(cs[greatest(1, len(cs) - 11):], ' '), '') ELSE '' END ELSE array_to_string(ws[greatest(1, len(ws) - 11):], ' ') END AS lemma FROM l),
u AS (SELECT chapter, unit, {_norm("string_agg(shown, '' ORDER BY pos)")} AS norm FROM v WHERE in_unit GROUP BY book_id, chapter, unit),
j AS (SELECT *, norm || coalesce(' ' || lead(norm) OVER a, '') || coalesce(' ' || lead(norm, 2) OVER a, '') AS joined, length(norm) + 1 AS e1, length(norm) + 2 + coalesce(length(lead(norm) OVER a), 0) AS e2, lead(unit) OVER a AS u2, lead(unit, 2) OVER a AS u3
  FROM u WINDOW a AS (PARTITION BY chapter ORDER BY unit)),
q AS (SELECT DISTINCT chapter, lemma FROM m WHERE contains(lemma, ' ')),
ex AS (SELECT chapter, lemma, count(*) AS n_hits, min(unit) AS first FROM q JOIN j USING (chapter) WHERE contains(norm, lemma) GROUP BY ALL),
sp AS (SELECT chapter, lemma, count(*) AS n_hits, min(CASE WHEN instr(joined, lemma) + length(lemma) - 1 <= e1 THEN unit WHEN instr(joined, lemma) + length(lemma) - 1 <= e2 THEN u2 ELSE u3 END) AS first FROM q JOIN j USING (chapter) WHERE contains(joined, lemma) GROUP BY ALL),
t AS (SELECT CAST(conv_id % 3 AS INT) AS book_id, conv_id * 4 + turn // 2 AS pg, turn % 4 AS n, min(md5(text)) AS note FROM conversations GROUP BY ALL)
SELECT m.book_id, m.chapter, para, CAST(m.pg AS INT) AS pg, m.n, m.lemma, CASE WHEN named THEN 'title' ELSE 'text' END AS how, CASE WHEN in_unit THEN CAST(unit AS BIGINT) END AS unit, CAST(CASE WHEN in_unit THEN opened ELSE m.pg END AS INT) AS unit_pg,
  coalesce(note, '') AS note, coalesce(ex.n_hits, sp.n_hits, 0) AS n_hits, CAST(CASE WHEN ex.n_hits IS NOT NULL THEN ex.first ELSE sp.first END AS BIGINT) AS first
FROM m LEFT JOIN t ON t.book_id = m.book_id AND t.pg = m.pg AND t.n = m.n LEFT JOIN ex ON ex.chapter = m.chapter AND ex.lemma = m.lemma LEFT JOIN sp ON sp.chapter = m.chapter AND sp.lemma = m.lemma""",
    "note_trees": """WITH n AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
f AS (SELECT l_orderkey, string_agg(l_linenumber || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS flags, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey AS "order", c_mktsegment, coalesce(flags, '') AS flags, coalesce(n_lines, 0) AS n_lines, CASE WHEN n.l_orderkey IS NULL THEN '-' ELSE 'found' END AS note
FROM orders o LEFT JOIN f ON f.l_orderkey = o.o_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN n ON n.l_orderkey = o.o_orderkey AND n.l_linenumber = o.o_orderkey % 7 + 1""",
    "continued_notes": """WITH c AS (SELECT conv_id, turn // 2 AS pg, turn % 2 AS n, md5(text) || ' =' AS note, (conv_id + turn // 2) % 5 <> 0 AS held FROM conversations),
p AS (SELECT conv_id, pg, lag(pg) OVER (PARTITION BY conv_id ORDER BY pg) AS prev FROM (SELECT DISTINCT conv_id, pg FROM c)),
d AS (SELECT c.* FROM c JOIN p USING (conv_id, pg) WHERE held AND (n > 0 OR prev IS NULL)),
l AS (SELECT conv_id, pg, max(n) AS n FROM d GROUP BY conv_id, pg),
m AS (SELECT p.conv_id, p.prev AS pg, l.n, c.note AS more FROM c JOIN p USING (conv_id, pg) JOIN l ON l.conv_id = p.conv_id AND l.pg = p.prev WHERE held AND c.n = 0)
SELECT d.conv_id, d.pg, d.n, CASE WHEN more IS NULL THEN note ELSE rtrim(note, ' =') || ' ' || ltrim(more, ' =') END AS note FROM d LEFT JOIN m USING (conv_id, pg, n)""",
    "library_stats": """WITH l AS (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id)
SELECT source, count(*) AS n, count_if(lang = 'en') AS in_en, count_if(lang = 'fr') AS in_fr, count_if(lang = 'de') AS in_de, count_if(lang = 'es') AS in_es, count_if(n_chars < 500) AS short, count_if(n_chars >= 5000) AS long,
  count_if(contains(text, chr(10))) AS with_lines, count_if(toxic = 1) AS toxic, count_if(quality = 1) AS good, count_if(toxic IS NULL) AS unlabelled FROM documents LEFT JOIN l USING (doc_id) GROUP BY source""",
    "answer_envelopes": f"""WITH e AS (SELECT *, {_ENVELOPE_SCOPES}[event_id % 6 + 1] AS said, event_id % 4 = 0 AS first FROM events),
g AS (SELECT *, CASE WHEN said = 'unknown' THEN 'answerable' ELSE said END AS known, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'filter' ELSE 'timeout' END END AS err FROM e),
s AS (SELECT *, CASE WHEN known = 'answerable' AND first THEN 'personal_fatwa' ELSE known END AS scope FROM g),
r AS (SELECT *, CASE scope WHEN 'other_madhhab' THEN 'Other schools are not covered.' WHEN 'contemporary' THEN 'New questions are not covered.' WHEN 'not_in_library' THEN 'The library has nothing on this.' END AS refusal,
  coalesce(CASE WHEN event_id % 3 = 0 THEN said END = 'personal_fatwa', first) AS personal FROM s),
a AS (SELECT user_id, max_by(coalesce(refusal, CASE WHEN err IS NULL THEN 'supported' ELSE 'not_found' END), event_id) AS status, round(sum(CASE WHEN value > 10 THEN value / 1000 END), 6) AS cost,
  CAST(sum(length(props)) AS BIGINT) AS tokens_in, CAST(sum(length(event_type)) AS BIGINT) AS tokens_out, round(sum(value), 6) AS seconds, count_if(err = 'timeout') AS search_only, count_if(refusal IS NOT NULL) AS refused,
  count_if(scope = 'personal_fatwa') AS personal_scope, count_if(personal) AS personal_prompt FROM r GROUP BY user_id)
SELECT *, CASE status WHEN 'supported' THEN 'Supported by the library.' WHEN 'not_found' THEN 'Not found.' END AS status_text FROM a""",
    "prompt_contexts": """WITH t AS (SELECT conv_id, string_agg('[P' || turn || '] Book, 1, ' || CASE WHEN turn % 2 = 0 THEN CAST(turn AS VARCHAR) ELSE '' END || ' (' || role || '):' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS c FROM conversations GROUP BY conv_id)
SELECT conv_id, md5(c) AS context_md5, CAST(length(c) AS BIGINT) AS chars FROM t""",
    "scored_systems": """WITH d AS (SELECT doc_id AS i, quality, toxic FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, ['answerable', 'differing', 'out_of_library', 'false_premise', 'personal_fatwa'][i % 5 + 1] AS category, i % 2 = 0 AS critical, ['answerable', 'not_in_library', 'personal_fatwa'][i % 3 + 1] AS scope,
  ['answerable', 'not_in_library'][i % 2 + 1] AS expected_scope, ['supported', 'partial', 'differing', 'not_found'][i % 4 + 1] AS st, ['supported', 'not_found', 'differing'][i % 3 + 1] AS expected_status,
  quality = 1 AND toxic = 0 AS ok, CASE WHEN i % 4 > 0 THEN i + i % 3 END AS gold, i % 5 = 3 AS premise_false, i % 2 = 1 AS caught FROM d),
s AS (SELECT *, 'full' AS system, st AS status, CAST(ok AS INT) + 1 AS n_shown, 0 AS unverified, quality + toxic AS n_dropped, ok AS has_first FROM r
  UNION ALL SELECT *, 'no_verify', CASE WHEN scope = 'not_in_library' THEN 'not_found' WHEN i % 3 = 0 THEN 'partial' ELSE st END, 2, CAST(NOT ok AS INT), 0, true FROM r),
h AS (SELECT *, CASE WHEN gold IS NOT NULL THEN (has_first AND abs(gold - i) <= 1) OR abs(gold - i - 5) <= 1 END AS hit, CASE WHEN gold IS NOT NULL THEN (CAST(has_first AND abs(gold - i) <= 1 AS INT) + CAST(abs(gold - i - 5) <= 1 AS INT))::DOUBLE / n_shown END AS share,
  scope = 'not_in_library' AS refused, category = 'out_of_library' OR expected_status = 'not_found' AS expect FROM s),
m AS (SELECT *, CASE WHEN premise_false THEN caught END AS premise_caught, CASE WHEN category = 'personal_fatwa' THEN scope = 'personal_fatwa' END AS referral FROM h)
SELECT i AS doc_id, system, status, refused, scope = expected_scope AS scope_ok, status = expected_status AS status_ok, CASE WHEN expect THEN refused END AS correct_refusal, CASE WHEN NOT expect THEN refused END AS false_refusal,
  CASE WHEN category = 'out_of_library' THEN n_shown > 0 END AS invented_on_refusal, CASE WHEN NOT expect THEN hit END AS citation_hit, premise_caught, referral, CASE WHEN category = 'differing' THEN status = 'differing' END AS differing_shown,
  CASE WHEN critical THEN CASE WHEN category = 'out_of_library' OR (expect AND category <> 'personal_fatwa') THEN refused WHEN category = 'false_premise' THEN coalesce(premise_caught, false) AND NOT refused
    WHEN category = 'personal_fatwa' THEN coalesce(referral, false) ELSE coalesce(hit, false) AND NOT refused END END AS critical_pass,
  round(share, 6) AS cited_on_gold_share, CAST(n_shown AS BIGINT) AS n_shown, CAST(unverified AS BIGINT) AS unverified_shown, CAST(n_dropped AS BIGINT) AS n_dropped FROM m""",
    "failing_items": _SCORED + """, x AS (SELECT *, source || '-' || (doc_id % 50) AS item FROM sc), b AS (SELECT item, lang, 'wrong' AS r FROM x WHERE NOT ok UNION ALL SELECT item, lang, 'shown' FROM x WHERE refused = false),
f AS (SELECT item, string_agg(DISTINCT CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) AS failed FROM x WHERE NOT ok GROUP BY item)
SELECT b.item, count(DISTINCT lang) AS n_runs, string_agg(DISTINCT r, '; ' ORDER BY r) AS reasons, any_value(failed) AS failed FROM b LEFT JOIN f USING (item) GROUP BY b.item""",
    "report_tables": _SCORED + """, t AS (SELECT 'task ' || event_type AS name, count_if(value < 20)::DOUBLE AS a, median(value) AS b FROM events GROUP BY event_type
UNION ALL SELECT 'precision ' || lang, count(*), count_if(quality = 1)::DOUBLE / count(*) FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY lang
UNION ALL SELECT 'total ' || source, count(*), count_if(ok) FROM sc GROUP BY source
UNION ALL SELECT 'coverage', count(*), count_if(doc_id IN (SELECT doc_id FROM labels)) FROM documents
UNION ALL SELECT 'mismatch', count(*), count_if(lang IS DISTINCT FROM CASE WHEN quality = 1 THEN 'en' END) FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT 'segments', sum(len(regexp_extract_all(text, '[0-9]+'))), count_if(regexp_matches(text, '[0-9]')) FROM documents) SELECT name, round(a, 6) AS a, round(b, 6) AS b FROM t""",
    "run_matrix": """SELECT system, r AS run, item_id FROM benchmark, (VALUES ('full'), ('no_retrieval'), ('no_verify')) s(system), (VALUES (1::BIGINT), (2)) k(r) WHERE NOT (r = 1 AND item_id % 2 = 0)""",
    "newest_events": "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "best_and_due": """WITH RECURSIVE g AS (SELECT user_id, ts, event_id % 4 = 0 AS lapse, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, k, CASE WHEN lapse THEN 0 ELSE 1 END AS reps, CASE WHEN lapse THEN 0::HUGEINT ELSE 1 END AS iv, ts FROM g WHERE k = 1
  UNION ALL SELECT f.user_id, g.k, CASE WHEN lapse THEN 0 ELSE reps + 1 END, CASE WHEN lapse THEN 0 WHEN reps = 0 THEN 1 WHEN reps = 1 THEN 3 ELSE CAST(floor(iv * 2.5::DOUBLE + 0.5) AS HUGEINT) END, g.ts FROM f JOIN g ON g.user_id = f.user_id AND g.k = f.k + 1),
l AS (SELECT user_id, max_by(iv, k) AS iv, max(k) AS k FROM f GROUP BY user_id), d AS (SELECT l.user_id, CASE WHEN l.iv <= 1000000 THEN epoch(g.ts) + CASE WHEN l.iv = 0 THEN 600 ELSE CAST(l.iv AS DOUBLE) * 86400 END <= epoch(TIMESTAMP '2024-01-25') ELSE false END AS due FROM l JOIN g ON g.user_id = l.user_id AND g.k = l.k)
SELECT event_id, max(value) OVER (PARTITION BY e.user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best, coalesce(due, false) AS due FROM events e LEFT JOIN d ON d.user_id = e.user_id""",
    "projected_passages": f"""WITH l AS (SELECT doc_id, lang, n_chars, unnest(range(len(x))) AS seq, unnest(x) AS line FROM (SELECT *, string_split(text, chr(10)) AS x FROM documents)),
w AS (SELECT *, {_norm("line")} AS norm FROM l WHERE NOT regexp_full_match(line, '[.\\s…]*'))
SELECT doc_id, seq, md5(CASE WHEN seq = 0 THEN '> ' || line ELSE line END) AS line_md5, length(norm) <= 15 AND NOT regexp_matches(norm, '[0-9]') AS heading, doc_id % 5 = 0 OR doc_id % 7 = 0 AS low,
  len(string_split(line, ' ')) >= 2 AND doc_id % 9 < len(string_split(line, ' ')) AS quiz, CASE WHEN seq = 0 THEN lang END AS vol, CASE WHEN seq = 0 THEN n_chars END AS page, CASE WHEN seq = 0 THEN 'https://example.org/' || doc_id || '/1' END AS link FROM w""",
    "body_lines": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT *, length({_norm("line")}) AS k FROM l)
SELECT 'body' AS kind, doc_id AS id, md5(line) AS md5 FROM n WHERE k > 40 UNION ALL SELECT 'plain', doc_id, md5(line) FROM n WHERE k > 30 AND doc_id % 3 <> 1
UNION ALL SELECT 'plain', item_id, md5(text) FROM benchmark WHERE length({_norm("text")}) > 30""",
    "folded_transcripts": """WITH c AS (SELECT conv_id, turn, turn % 3 = 1 AS tool, role, CASE WHEN turn % 3 = 1 THEN '- search' || CASE WHEN trim(substr(text, 1, 20)) <> '' THEN ': ' || trim(substr(text, 1, 20)) ELSE '' END ELSE text END AS text FROM conversations),
b AS (SELECT *, coalesce(sum(CASE WHEN tool THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM c)
SELECT conv_id, CAST(block AS BIGINT) AS block, max(role) FILTER (NOT tool) AS role, md5(coalesce(max(text) FILTER (NOT tool), '')) AS text_md5, md5(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (tool), '')) AS tools_md5 FROM b GROUP BY conv_id, block""",
    "search_modes": _FUSED.replace("WITH ", "WITH RECURSIVE ", 1)
    + """,
top AS (SELECT item_id, list(id ORDER BY rank) AS top FROM r WHERE rank <= 8 GROUP BY item_id),
su AS (SELECT item_id, list(id ORDER BY o, rank) AS l FROM (SELECT item_id, id, 0 AS o, rank FROM kw WHERE rank <= 3 UNION ALL SELECT item_id, id, 1, rank FROM dn WHERE rank <= 2) GROUP BY item_id),
sure AS (SELECT item_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS sure FROM su),
fold AS (SELECT item_id, top, sure, 1 AS k FROM top JOIN sure USING (item_id)
  UNION ALL SELECT item_id, CASE WHEN list_contains(top, sure[k]) OR len(list_filter(top, lambda x: NOT list_contains(sure, x))) = 0 THEN top
    ELSE list_transform(top, lambda x, i: CASE WHEN i = list_max(list_filter(range(1, len(top) + 1), lambda j: NOT list_contains(sure, top[j]))) THEN sure[k] ELSE x END) END, sure, k + 1
  FROM fold WHERE k <= len(sure)),
done AS (SELECT item_id, top FROM fold QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY k DESC) = 1),
every AS (SELECT 'keyword' AS mode, item_id, id, rank FROM kw WHERE rank <= 8 UNION ALL SELECT 'dense', item_id, id, rank FROM dn WHERE rank <= 8 UNION ALL SELECT 'hybrid', item_id, unnest(top), unnest(range(1, len(top) + 1)) FROM done),
hit AS (SELECT mode, item_id, min(rank) AS rank FROM every WHERE id IN (item_id, item_id + 1) GROUP BY mode, item_id)
SELECT b.item_id, max(rank) FILTER (mode = 'keyword') AS keyword, max(rank) FILTER (mode = 'dense') AS dense, max(rank) FILTER (mode = 'hybrid') AS hybrid, max(rank) FILTER (mode = 'keyword') AS no_vectors
FROM (SELECT DISTINCT item_id FROM benchmark) b LEFT JOIN hit ON hit.item_id = b.item_id GROUP BY b.item_id""",
    "glossary_lookup": f"""WITH d AS (SELECT doc_id AS id, source AS para, lang AS chapter, lower(text) AS t FROM documents),
m AS (SELECT id, para, chapter, 'def' AS kind, unnest(regexp_extract_all(t, '([a-z]{{3,}}) is ([a-z ]{{3,40}})', 1)) AS w, unnest(regexp_extract_all(t, '([a-z]{{3,}}) is ([a-z ]{{3,40}})', 2)) AS def FROM d
  UNION ALL SELECT id, para, chapter, 'gloss', unnest(regexp_extract_all(t, '([a-z]{{3,}}) means ([a-z ]{{3,40}})', 1)), unnest(regexp_extract_all(t, '([a-z]{{3,}}) means ([a-z ]{{3,40}})', 2)) FROM d),
e AS (SELECT id, para, chapter, kind, CASE WHEN w IN ('the', 'of', 'and', 'to', 'in', 'is', 'it', 'for', 'on') THEN chapter ELSE w END AS word, CASE kind WHEN 'gloss' THEN 'means ' ELSE '' END || trim(def) AS definition FROM m),
k AS (SELECT *, word AS key FROM e WHERE length(word) >= 2 AND length({_norm("definition")}) >= 3),
q AS (SELECT item_id || ':' || w AS query_id, w AS key FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{{3,}}'))) AS w FROM benchmark)),
f AS (SELECT query_id, k.*, row_number() OVER (PARTITION BY query_id, substr({_norm("definition")}, 1, 60) ORDER BY kind = 'gloss', para <> 'web', chapter <> 'en', id, definition) AS n FROM k JOIN q USING (key)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kind = 'gloss', para <> 'web', chapter <> 'en', id, definition) AS rank FROM f WHERE n = 1)
SELECT query_id, rank, word, definition, kind, id FROM r WHERE rank <= 4""",
}
