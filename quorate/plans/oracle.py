"""The same results as plain SQL over the given tables, for checking."""

from __future__ import annotations

from quorate.plans.queries import LARGE_PANEL, STALL_SECONDS

# --- shared table expressions --------------------------------------------------

_OPINIONS = """
opin AS (
  SELECT l_orderkey AS case_id, l_linenumber AS ln, l_suppkey AS sk, l_partkey AS pk,
         l_extendedprice AS ep, 'S' || l_linenumber AS specialty, l_discount * 10 AS c
  FROM lineitem)"""

_MOMENTS = """
units AS (
  SELECT *, CASE WHEN c > 0 THEN CAST(floor(c * 1e6 + 0.5) AS BIGINT) END AS u FROM {source}),
mom AS (
  SELECT case_id, count(u) AS n, count(*) - count(u) AS a,
         coalesce(sum(u), 0) AS s1, coalesce(sum(u * u), 0) AS s2
  FROM units GROUP BY case_id),
scored AS (
  SELECT case_id, n, a, s1, n * s2 - s1 * s1 AS v,
         CASE WHEN n = 0 THEN 0.0 ELSE s1::DOUBLE / n / 1e6 END AS mean,
         CASE WHEN n = 0 THEN 0.0 ELSE sqrt((n * s2 - s1 * s1)::DOUBLE) / n / 1e6 END AS spread
  FROM mom),
final AS (
  SELECT *, mean * (1 - least(spread / 0.5, 1)) AS score FROM scored),
agreed AS (
  SELECT *, CASE WHEN score >= 0.75 THEN 'strong' WHEN score >= 0.5 THEN 'moderate'
                 WHEN score >= 0.25 THEN 'weak' ELSE 'none' END AS level FROM final)"""


def _moments(source: str) -> str:
    return _MOMENTS.format(source=source)


_ROUNDED = """CAST(n AS BIGINT) AS participating, CAST(a AS BIGINT) AS abstained,
  round_even(mean, 3) AS mean_confidence, round_even(spread, 3) AS confidence_spread,
  round_even(score, 3) AS agreement_score"""

_OUTLYING = """
marked AS (
  SELECT units.*, coalesce(u IS NOT NULL AND abs(n * u - s1) > n * 150000
         AND (n * u - s1)::HUGEINT * (n * u - s1)::HUGEINT > v, false) AS is_outlier
  FROM units JOIN scored USING (case_id))"""

_NUMBERED = """
panels AS (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ln, sk, pk, ep) - 1 AS pos
  FROM {source})"""

# Order lines as parsed answers, derived from the rule that broke them.
_ANSWERS = """
lines AS (
  SELECT *, l_suppkey % 10 AS kind,
         CAST(round(l_discount * 10, 1) AS DECIMAL(3,1)) AS conf FROM lineitem),
answers AS (
  SELECT l_orderkey AS case_id, l_linenumber AS ln, l_suppkey AS sk, l_partkey AS pk,
    l_extendedprice AS ep, kind,
    CASE WHEN kind = 0 THEN 'unparsed' WHEN kind IN (6, 7) THEN 'failed'
         WHEN kind IN (1, 3, 5, 8) THEN 'invalid' ELSE 'valid' END AS status,
    CASE WHEN kind NOT IN (0, 5, 6, 7) THEN 'S' || l_linenumber END AS specialty,
    CASE WHEN kind NOT IN (0, 6)
         THEN 'Item ' || l_linenumber || ' is ' || l_returnflag || ' ' || l_linestatus
    END AS findings,
    CASE WHEN kind NOT IN (0, 6) THEN CASE WHEN l_partkey % 2 = 0
         THEN 'Keep  ' || l_returnflag || l_linestatus || '.'
         ELSE 'keep ' || lower(l_returnflag || l_linestatus) END END AS recommendation,
    CASE WHEN kind IN (0, 6) THEN NULL WHEN kind = 8 THEN ''
         ELSE 'part ' || (l_partkey + CASE WHEN kind = 9 THEN 1 ELSE 0 END) END AS quotes,
    CASE WHEN kind IN (0, 1, 3, 6) THEN NULL WHEN kind = 2 THEN CAST(conf AS DOUBLE) + 1
         WHEN kind = 8 THEN 1.0 ELSE CAST(conf AS DOUBLE) END AS confidence
  FROM lines),
voted AS (
  SELECT *, greatest(0.0, least(1.0, coalesce(confidence, 0.0))) AS c
  FROM answers WHERE status <> 'failed')"""

# The stand-in indicators: role, shown text, term, lead standing (0 is highest).
_ROLES = """
roles(specialty, indicator, term, standing) AS (VALUES
  ('Cardiologist', 'that', 'that', 0), ('Cardiologist', 'was', 'was', 0),
  ('Cardiologist', 'of the', 'of the', 0), ('Cardiologist', 'erin', 'erin', 0),
  ('Neurologist', 'with', 'with', 0), ('Neurologist', 'este', 'este', 0),
  ('Neurologist', 'from the', 'from the', 0), ('Neurologist', 'thor', 'thor', 0),
  ('Nephrologist', 'this', 'this', 1), ('Nephrologist', 'que', 'que', 1),
  ('Nephrologist', 'les', 'les', 1), ('Nephrologist', 'for', 'for', 1),
  ('Nephrologist', 'und', 'und', 1),
  ('Endocrinologist', 'from', 'from', 1), ('Endocrinologist', 'der', 'der', 1),
  ('Endocrinologist', 'avec', 'avec', 1), ('Endocrinologist', 'un la', 'un la', 1),
  ('Radiologist', 'thble', 'thble', 2), ('Radiologist', 'para', 'para', 2),
  ('Radiologist', 'thing', 'thing', 2), ('Radiologist', 'eron', 'eron', 2),
  ('Radiologist', 'dans', 'dans', 2),
  ('Pharmacist', 'thea', 'thea', 2), ('Pharmacist', 'mit', 'mit', 2),
  ('Pharmacist', 'pour', 'pour', 2), ('Pharmacist', 'erer', 'erer', 2),
  ('Pharmacist', 'los', 'los', 2))"""

_HITS = _ROLES + """,
doc_words AS (
  SELECT {case} AS case_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w
  FROM documents),
grams AS (
  SELECT case_id, unnest(w) AS term FROM doc_words
  UNION ALL
  SELECT case_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
  FROM doc_words WHERE len(w) > 1),
hits AS (
  SELECT case_id, specialty, indicator, count(*) AS hits
  FROM grams JOIN roles USING (term) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY case_id ORDER BY score DESC, hits DESC, specialty) - 1 AS pos
  FROM (SELECT case_id, specialty, count(*) AS score, CAST(sum(hits) AS BIGINT) AS hits,
               string_agg(indicator, ', ' ORDER BY indicator) AS reason
        FROM hits GROUP BY case_id, specialty))"""

_BY_FIVE = "CAST(floor(doc_id / 5) AS BIGINT)"

_SUPPORTED = _HITS.format(case=_BY_FIVE) + """,
top2 AS (SELECT * FROM ranked WHERE pos < 2),
missing AS (
  SELECT r.* FROM ranked r
  WHERE r.specialty IN ('Pharmacist', 'Radiologist') AND r.score >= 2
    AND NOT EXISTS (SELECT 1 FROM top2 t
                    WHERE t.case_id = r.case_id AND t.specialty = r.specialty)),
supported AS (
  SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY added, pos) - 1 AS pos,
         specialty, reason, score, hits
  FROM (SELECT *, 0 AS added FROM top2
        UNION ALL BY NAME
        SELECT * REPLACE (CASE specialty WHEN 'Pharmacist' THEN 0 ELSE 1 END AS pos), 1 AS added
        FROM missing)),
led AS (
  SELECT s.*, row_number() OVER (
    PARTITION BY case_id ORDER BY standing, score DESC, pos) = 1 AS is_lead
  FROM supported s JOIN (SELECT DISTINCT specialty, standing FROM roles) USING (specialty))"""

_CASES = """
case_docs AS (
  SELECT CAST(floor(doc_id / 5) AS BIGINT) AS case_id, doc_id % 5 AS pos, text FROM documents),
cases AS (
  SELECT case_id, count(*) AS n_documents,
         string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos)
           AS combined,
         max(CASE WHEN pos = 0 THEN split_part(text, chr(10), 1) END) AS question
  FROM case_docs GROUP BY case_id)"""

# Teams as triage reports them: five members, then the support roles.
_TEAMED = _SUPPORTED.replace("pos < 2", "pos < 5")

_WORK = _TEAMED + "," + _CASES + """,
work AS (
  SELECT case_id, pos, specialty, is_lead,
         'specialist_' || replace(lower(specialty), ' ', '_') AS agent_name,
         CASE WHEN is_lead THEN specialty || ' (Lead)' ELSE specialty END AS role_label,
         '## Clinical Question' || chr(10) || question || chr(10) || chr(10)
           || '## Patient Documents' || chr(10) || combined AS input
  FROM cases JOIN led USING (case_id))"""

_EVIDENCE = """
pieces AS (
  SELECT CAST(floor(doc_id / 5) AS BIGINT) AS case_id, doc_id,
         list_filter(list_transform(regexp_split_to_array(text, '[.!?][ \\t\\n\\r\\f]|\\n'),
                     lambda x: trim(x)), lambda x: x <> '') AS l
  FROM documents),
sentences AS (
  SELECT case_id, doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS s FROM pieces),
lined AS (
  SELECT *, ' ' || array_to_string(regexp_extract_all(lower(s), '[\\p{L}\\p{N}]+'), ' ') || ' '
    AS line FROM sentences),
named AS (
  SELECT case_id, doc_id, i, s, specialty, indicator
  FROM lined JOIN roles ON contains(line, ' ' || term || ' ')),
quoted AS (
  SELECT case_id, specialty, s, min((doc_id, i)) AS place FROM named GROUP BY ALL),
evidence AS (
  SELECT case_id, specialty, count(*) AS quotes, string_agg(s, ' ' ORDER BY place) AS findings,
         string_agg(s, '|' ORDER BY place) AS joined
  FROM quoted GROUP BY ALL),
matched AS (
  SELECT case_id, specialty, count(DISTINCT indicator) AS k,
         string_agg(DISTINCT indicator, ', ' ORDER BY indicator) AS shown
  FROM named GROUP BY ALL)"""

_FOLD = "trim(regexp_replace(lower({0}), '[ \\t\\n\\r\\f]+', ' ', 'g'))"
_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
# A word, then ':', '=', 'is', 'of' or blanks, then a number.
_FACT = (
    r"(\p{L}[\p{L}\p{N}]*)[ \t\n\r\f]*(?:[:=]|[ \t\n\r\f]is[ \t\n\r\f]"
    r"|[ \t\n\r\f]of[ \t\n\r\f]|[ \t\n\r\f])[ \t\n\r\f]*([0-9]+(?:\.[0-9]+)?)"
).replace("{", "{{").replace("}", "}}")
_FACTS = (
    "list_distinct(list_zip(regexp_extract_all(lower({0}), '" + _FACT
    + "', 1), regexp_extract_all(lower({0}), '" + _FACT + "', 2)))"
)

# Word edges without looking around: what may stand before and after a claim.
_CLAIMS = ("""
parted AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l
  FROM documents),
lines_of AS (
  SELECT doc_id, unnest(l) AS claim, generate_subscripts(l, 1) - 1 AS quote_no FROM parted),
claims AS (
  SELECT doc_id AS case_id, 0 AS pos, 'Own' AS specialist, quote_no, claim FROM lines_of
  UNION ALL
  SELECT doc_id - 1, 1, 'Next', quote_no, claim FROM lines_of WHERE doc_id >= 1),
read_docs AS MATERIALIZED (
  SELECT doc_id, """ + _FOLD.format("text") + """ AS doc,
         list_distinct(""" + _WORDS.format("text") + """) AS dw,
         """ + _FACTS.format("text") + """ AS df
  FROM documents),
folded AS (
  SELECT c.*, quote_no * 2 + pos AS claim_no, doc, dw, df, """
    + _FOLD.format("c.claim") + r""" AS f
  FROM claims c LEFT JOIN read_docs d ON d.doc_id = c.case_id),
first_found AS (
  SELECT *, CASE WHEN f <> '' THEN strpos(doc, f) ELSE 0 END AS p0 FROM folded),
edged AS (
  SELECT *,
         p0 > 0 AND (NOT regexp_matches(f, '^[\p{L}\p{N}]') OR regexp_matches(
           substr(doc, greatest(p0 - 2, 1), p0 - greatest(p0 - 2, 1)),
           '(?:^|[^\p{L}\p{N}.,]|(?:^|[^0-9])[.,])$'))
         AND (NOT regexp_matches(f, '[\p{L}\p{N}]$') OR regexp_matches(
           substr(doc, p0 + length(f), 2), '^(?:$|[^\p{L}\p{N}.,]|[.,](?:$|[^0-9]))')) AS whole,
         '(?s)^(.*?' || CASE WHEN regexp_matches(f, '^[\p{L}\p{N}]')
              THEN '(?:^|[^\p{L}\p{N}.,]|(?:^|[^0-9])[.,])' ELSE '' END
            || ')' || regexp_escape(f) || CASE WHEN regexp_matches(f, '[\p{L}\p{N}]$')
              THEN '(?:$|[^\p{L}\p{N}.,]|[.,](?:$|[^0-9]))' ELSE '' END AS pattern
  FROM first_found),
placed AS (
  SELECT *, CASE WHEN whole THEN p0 WHEN p0 > 0 AND regexp_matches(doc, pattern)
                 THEN length(regexp_extract(doc, pattern, 1)) + 1 END AS place
  FROM edged)""")

_VERDICTS = _CLAIMS + """,
worded AS (
  SELECT *, list_distinct(""" + _WORDS.format("claim") + """) AS cw,
         """ + _FACTS.format("claim") + """ AS cf
  FROM placed),
verdicts AS (
  SELECT case_id, claim_no, specialist, claim,
    CASE
      WHEN place IS NOT NULL THEN 'SAFE'
      WHEN len(list_filter(cf, lambda x:
             len(list_filter(df, lambda y: y[1] = x[1])) > 0
             AND len(list_filter(df, lambda y: y[1] = x[1] AND y[2] = x[2])) = 0)) > 0
        THEN 'CONTRADICTION'
      WHEN len(cw) > 0 AND len(list_intersect(cw, dw))::DOUBLE / len(cw) >= 0.6
        THEN 'UNSUBSTANTIATED'
      ELSE 'HALLUCINATION' END AS verdict
  FROM worded)"""

_EVENTS = """
ks AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, epoch_us(ts) AS seq
  FROM events),
ev AS (
  SELECT user_id AS case_id, seq, ts, k, event_type AS et,
    CASE event_type WHEN 'signup' THEN 'specialists_spawned'
      WHEN 'view' THEN 'specialist_thinking' WHEN 'click' THEN 'specialist_done'
      WHEN 'purchase' THEN 'judge_done' ELSE event_type END AS type,
    CASE WHEN event_type IN ('view', 'click') THEN 'specialist_a' || (k % 5)
         WHEN event_type = 'purchase' THEN 'judge_agent' ELSE '' END AS agent,
    CASE WHEN k % 4 = 0 THEN '' ELSE 'A' || (k % 5) END AS lead,
    CASE WHEN event_type = 'view' AND k % 7 <> 0 THEN 'step ' || k END AS step,
    CAST(CAST(k % 11 / 10 AS DECIMAL(3,1)) AS DOUBLE) AS c
  FROM ks)"""

_STAGES = """WITH """ + _EVENTS + """,
spawn AS (
  SELECT case_id, max(seq) AS since, arg_max(k, seq) AS k FROM ev WHERE et = 'signup'
  GROUP BY case_id),
cards AS (
  SELECT case_id, since, unnest(range(0, k % 5 + 1)) AS i FROM spawn),
touched AS (
  SELECT c.case_id, c.i, arg_max(e.et, e.seq) AS last_et,
    arg_max(coalesce(e.step, 'Analyzing...'), e.seq) FILTER (e.et = 'view') AS summary,
    arg_max('{"confidence": ' || CAST(e.k % 11 / 10 AS DECIMAL(3,1)) || '}', e.seq)
      FILTER (e.et = 'click') AS data
  FROM cards c LEFT JOIN ev e
    ON e.case_id = c.case_id AND e.agent = 'specialist_a' || c.i AND e.seq > c.since
  GROUP BY c.case_id, c.i)
SELECT case_id, 'specialist_a' || i AS stage, 'A' || i AS specialty,
  CASE last_et WHEN 'click' THEN 'done' WHEN 'view' THEN 'thinking' ELSE 'idle' END AS status,
  coalesce(summary, '') AS summary, data
FROM touched
UNION ALL
SELECT case_id, 'judge', NULL, 'done', '',
  '{"final_summary": "sum ' || arg_max(k, seq) || '"}'
FROM ev WHERE et = 'purchase' GROUP BY case_id"""

_NEXT_DONE = _EVENTS + """,
spec AS (SELECT * FROM ev WHERE et IN ('view', 'click')),
waits AS (
  SELECT *, min(CASE WHEN et = 'click' THEN seq END) OVER (
    PARTITION BY case_id, agent ORDER BY seq
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS done_seq
  FROM spec)"""

_BARRIER = "WITH " + _EVENTS + """,
first_spawn AS (
  SELECT case_id, arg_min(k % 3 + 1, seq) AS expected FROM ev WHERE et = 'signup'
  GROUP BY case_id),
done AS (
  SELECT case_id, c, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS r
  FROM ev WHERE et = 'click'),
panel AS (
  SELECT case_id, c, expected FROM done JOIN first_spawn USING (case_id) WHERE r <= expected),
full_panel AS (
  SELECT * FROM panel WHERE case_id IN (
    SELECT case_id FROM panel GROUP BY case_id HAVING count(*) = max(expected))),""" + _moments(
        "full_panel") + """
SELECT case_id, CAST(expected AS BIGINT) AS expected, """ + _ROUNDED + """, level
FROM agreed JOIN first_spawn USING (case_id)"""

_DRAFTS = """
SELECT conv_id AS case_id, role AS agent_name, string_agg(text, '' ORDER BY turn) AS draft,
  count(*) AS tokens
FROM conversations GROUP BY ALL"""

_ANSWER_PANELS = "WITH " + _ANSWERS + "," + _NUMBERED.format(source="answers").replace(
    "panels AS", "seats AS") + """,
panels AS (
  SELECT *, greatest(0.0, least(1.0, coalesce(confidence, 0.0))) AS c
  FROM seats WHERE status <> 'failed'),
active AS (
  SELECT * REPLACE (coalesce(specialty, 'Unknown') AS specialty) FROM panels WHERE c > 0)"""

_RECOMMENDED = """
lead AS (
  SELECT case_id, 'S' || ln AS lead FROM seats WHERE pos = 0),
stated AS (
  SELECT a.*, lower(replace(replace(recommendation, '  ', ' '), '.', '')) AS norm,
         CAST(floor(c * 1e6 + 0.5) AS BIGINT) AS u, lead
  FROM active a LEFT JOIN lead USING (case_id) WHERE recommendation IS NOT NULL),
named AS (
  SELECT case_id, norm, specialty, min(pos) AS p FROM stated GROUP BY ALL),
support AS (
  SELECT case_id, norm, string_agg(specialty, ',' ORDER BY p) AS supporters, count(*) AS k
  FROM named GROUP BY ALL),
grouped AS (
  SELECT case_id, norm, arg_min(recommendation, pos) AS recommendation, min(pos) AS first,
         sum(u)::DOUBLE / count(*) / 1e6 AS mean_c, bool_or(specialty = lead) AS lead_supports
  FROM stated GROUP BY ALL),
recs AS (
  SELECT case_id, row_number() OVER (PARTITION BY case_id
           ORDER BY lead_supports DESC, k DESC, mean_c DESC, first) AS rank,
         recommendation, supporters, lead_supports, round_even(mean_c, 3) AS mean_confidence
  FROM grouped JOIN support USING (case_id, norm))"""

_NOTES = """
diverging AS (
  SELECT case_id, string_agg(specialty, ', ' ORDER BY pos) AS names,
         string_agg(specialty, ',' ORDER BY pos) AS short
  FROM marked WHERE is_outlier GROUP BY case_id),
notes AS (
  SELECT case_id, level, 'Panel agreement is ' || level || ' ('
    || printf('%.3f', round_even(score, 3)) || '); '
    || coalesce('diverging: ' || names, 'nobody stands apart') || '.' AS note
  FROM agreed LEFT JOIN diverging USING (case_id) WHERE level IN ('weak', 'none'))"""

_ASSESSED = (
    _ANSWER_PANELS + "," + _RECOMMENDED + """,
called AS (SELECT * REPLACE (coalesce(specialty, 'Unknown') AS specialty) FROM panels),"""
    + _moments("called") + "," + _OUTLYING + "," + _NOTES + """,
nested AS (
  SELECT case_id, string_agg('S' || ln, ',' ORDER BY pos) AS specialties,
         string_agg('S' || ln || ': listed at ' || pos, '; ' ORDER BY pos) AS rationale,
         string_agg(CASE WHEN status <> 'failed' THEN coalesce(findings, '-') END, '|'
                    ORDER BY pos) AS findings,
         max(CASE WHEN pos = 0 THEN 'S' || ln END) AS lead
  FROM seats GROUP BY case_id),
last_by_name AS (
  SELECT case_id, specialty, arg_max(c, pos) AS c FROM called GROUP BY ALL),
by_name AS (
  SELECT case_id, string_agg(specialty || '=' || printf('%.1f', c), ',' ORDER BY specialty)
    AS per_specialty FROM last_by_name GROUP BY case_id),
listed AS (
  SELECT case_id, string_agg(recommendation, '|' ORDER BY rank) AS recommendations
  FROM recs GROUP BY case_id),
shown AS (
  SELECT l_orderkey AS case_id, list('part ' || l_partkey) AS docs
  FROM lineitem GROUP BY l_orderkey),
checked AS (
  SELECT a.case_id, list_contains(docs, quotes) AS safe,
         NOT list_contains(docs, quotes) AS contra
  FROM active a JOIN shown USING (case_id) WHERE quotes <> ''),
safety AS (
  SELECT case_id, count(*) FILTER (safe) AS verified, count(*) FILTER (NOT safe) AS flagged,
         NOT bool_or(contra) AS is_safe
  FROM checked GROUP BY case_id)"""
)

_ROWS_OF_CASE = """
lead_of AS (SELECT case_id, coalesce(lead, '') AS lead FROM (
  SELECT o_orderkey AS case_id FROM orders) LEFT JOIN nested USING (case_id)),
sized AS (
  SELECT case_id, lead, coalesce(m, 0) AS m, coalesce(d, 0) AS d FROM lead_of LEFT JOIN (
    SELECT case_id, count(*) AS m, count(*) FILTER (status <> 'failed') AS d
    FROM seats GROUP BY case_id) USING (case_id)),
done AS (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos) - 1 AS place FROM panels),
steps AS (
  SELECT case_id, 0 AS seq, 'triage_thinking' AS type, 'supervisor_agent' AS agent_name,
    NULL AS lead,
    'Supervisor analyzing clinical focus and determining specialist team...' AS message,
    NULL AS count, NULL AS findings FROM sized
  UNION ALL SELECT case_id, 1, 'triage_done', 'supervisor_agent', nullif(lead, ''), NULL,
    NULL, NULL FROM sized
  UNION ALL SELECT case_id, 2, 'specialists_spawned', 'orchestrator', lead, NULL, CAST(m AS VARCHAR), NULL FROM sized
  UNION ALL SELECT p.case_id, 3 + pos, 'specialist_thinking', 'specialist_s' || ln,
    NULL, 'Analyzing from S' || ln || CASE WHEN 'S' || ln = lead THEN ' (Lead)' ELSE ''
      END || ' perspective...', NULL, NULL FROM seats p JOIN sized USING (case_id)
  UNION ALL SELECT p.case_id, 3 + m + place, 'specialist_done', 'specialist_s' || ln,
    NULL, NULL, NULL, findings FROM done p JOIN sized USING (case_id)
  UNION ALL SELECT case_id, 3 + m + d, 'consensus_done', 'orchestrator', NULL, NULL, NULL, NULL
  FROM sized
  UNION ALL SELECT case_id, 4 + m + d, 'discussion_summary', 'orchestrator', NULL,
    'Summarizing reviews. Lead Specialist: ' || lead || '.', NULL, NULL FROM sized
  UNION ALL SELECT case_id, 5 + m + d, 'judge_thinking', 'judge_agent', NULL,
    'Medical Judge synthesizing reviews and resolving conflicts...', NULL, NULL FROM sized
  UNION ALL SELECT case_id, 6 + m + d, 'judge_done', 'judge_agent', NULL, NULL, NULL, NULL
  FROM sized
  UNION ALL SELECT case_id, 7 + m + d, 'safety_thinking', 'safety_agent', NULL,
    'Final safety agent verifying Judge''s report against documents...', NULL, NULL FROM sized
  UNION ALL SELECT case_id, 8 + m + d, 'safety_done', 'safety_agent', NULL, NULL, NULL, NULL
  FROM sized
  UNION ALL SELECT case_id, 9 + m + d, 'pipeline_complete', '', NULL, NULL, NULL, NULL
  FROM sized)"""

_SIZES = """
sizes AS (
  SELECT case_id, count(*) AS documents, min(length(text)) AS shortest,
         max(length(text)) AS longest, CAST(sum(length(text)) AS BIGINT) AS total_chars,
         max(CASE WHEN pos = 0 THEN length(split_part(text, chr(10), 1)) END) AS q
  FROM case_docs GROUP BY case_id)"""

_PROBLEMS = """concat_ws('|',
    CASE WHEN q < 3 THEN 'question_short' END, CASE WHEN q > 1000 THEN 'question_long' END,
    CASE WHEN documents > 10 THEN 'too_many_documents' END,
    CASE WHEN shortest < 1 THEN 'document_empty' END,
    CASE WHEN longest > 20000 THEN 'document_long' END,
    CASE WHEN total_chars > 50000 THEN 'total_long' END)"""

_E1 = "WITH " + _OPINIONS + "," + _moments("opin")
_ALL_ORDERS = """ FROM orders LEFT JOIN agreed ON case_id = o_orderkey"""

_CONTESTED = """
contested AS (
  SELECT case_id, attribute FROM {facts} GROUP BY ALL HAVING count(DISTINCT value) > 1)"""

_FACT_PANELS = "WITH " + _NUMBERED.format(source="""(
      SELECT l_orderkey AS case_id, l_linenumber AS ln, l_suppkey AS sk, l_partkey AS pk,
             l_extendedprice AS ep, 'S' || l_linenumber AS specialty, l_returnflag AS attribute, l_linestatus AS value
      FROM lineitem)""") + """,
lead AS (SELECT case_id, specialty AS lead FROM panels WHERE pos = 0),"""


_UP = f"seq + {STALL_SECONDS}000000 <= (SELECT max(epoch_us(ts)) FROM events)"
# A watermark is kept in whole milliseconds. It trails the log's last event, of whatever
# type, by the stream's hour of lateness, and has to reach the deadline.
_UP_STREAMED = (f"(seq + {STALL_SECONDS}000000 + 999) // 1000 <= "
                "(SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM events)")


def _stalled(is_up: str = _UP) -> str:
    return "WITH " + _NEXT_DONE + f"""
SELECT case_id, 'specialist' AS stage, agent AS agent_name, seq FROM waits
WHERE et = 'view' AND (done_seq IS NULL OR done_seq - seq > {STALL_SECONDS}000000)
  AND {is_up}"""


ORACLE: dict[str, str] = {
    "a1_read_cases": "WITH " + _CASES + """
SELECT case_id, question, n_documents, md5(combined) AS documents_md5 FROM cases""",

    "a3_read_responses": "WITH " + _NUMBERED.format(source="""(
      SELECT l_orderkey AS case_id, l_linenumber AS ln, l_suppkey AS sk, l_partkey AS pk,
             l_extendedprice AS ep, raw
      FROM rendered)""").replace("panels AS", "rendered AS (SELECT *, {raw} AS raw FROM (SELECT *, "
      "l_suppkey % 10 AS kind, CAST(round(l_discount * 10, 1) AS DECIMAL(3,1)) AS conf "
      "FROM lineitem)), panels AS", 1).replace("{raw}", """
      CASE WHEN kind = 0 THEN 'No JSON from S' || l_linenumber
      ELSE CASE WHEN kind = 6 THEN '[' ELSE '' END || '{' || concat_ws(', ',
        CASE WHEN kind = 7 THEN '"specialty": null'
             WHEN kind <> 5 THEN '"specialty": "S' || l_linenumber || '"' END,
        '"findings": "Item ' || l_linenumber || ' is ' || l_returnflag || ' ' || l_linestatus || '"',
        '"recommendation": "' || CASE WHEN l_partkey % 2 = 0
           THEN 'Keep  ' || l_returnflag || l_linestatus || '.'
           ELSE 'keep ' || lower(l_returnflag || l_linestatus) END || '"',
        CASE WHEN kind = 8 THEN '"evidence_quotes": [null]'
             ELSE '"evidence_quotes": ["part '
               || (l_partkey + CASE WHEN kind = 9 THEN 1 ELSE 0 END) || '"]' END,
        CASE WHEN kind = 1 THEN '"confidence": "high"'
             WHEN kind = 2 THEN '"confidence": ' || (conf + 1)
             WHEN kind = 4 THEN '"confidence": "' || conf || '"'
             WHEN kind = 8 THEN '"confidence": true'
             WHEN kind <> 3 THEN '"confidence": ' || conf END)
        || '}' || CASE WHEN kind = 6 THEN ']' ELSE '' END END""") + """
SELECT case_id, pos, 'specialist_' || pos AS agent_name, raw FROM panels""",

    "a2_indicator_map": """
SELECT p_brand AS specialty,
  unnest([p_name, 'item ' || p_partkey, 'no ' || p_partkey, lower(p_type)]) AS indicator,
  CASE WHEN p_size > 30 THEN 'High' WHEN p_size > 15 THEN 'Medium' ELSE 'Low' END
    AS lead_potential
FROM part""",

    "a4_stream_events": "WITH " + _EVENTS + """
SELECT type, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM ev GROUP BY type""",

    "a5_write_assessments": "WITH " + _CASES + "," + _SIZES + ", told AS (SELECT case_id, "
    "question, " + _PROBLEMS + """ AS problems FROM sizes JOIN cases USING (case_id))
SELECT case_id, CASE WHEN problems = '' THEN 'ok' ELSE 'rejected' END AS state,
  '{"request":{"question":' || CAST(to_json(question) AS VARCHAR) || ',"problems":['
  || CASE WHEN problems = '' THEN '' ELSE '"' || replace(problems, '|', '","') || '"' END
  || ']}}' AS assessment
FROM told""",

    "b1_validate": "WITH " + _CASES + "," + _SIZES + " SELECT case_id, documents, total_chars, "
    + _PROBLEMS + " AS problems FROM sizes",

    "b1_validate_lax": "WITH " + _CASES + """
SELECT case_id, CASE WHEN question = '' THEN 'question_short' ELSE '' END AS problems FROM cases""",

    "b2_split": """
WITH pieces AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda x: trim(x)),
                             lambda x: x <> '') AS l
  FROM documents)
SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS text FROM pieces""",

    "b3_combine": "WITH " + _CASES + " SELECT case_id, n_documents, combined FROM cases",

    "c1_hits": "WITH " + _HITS.format(case=_BY_FIVE) + " SELECT * FROM hits",

    "c2_team": "WITH " + _HITS.format(case=_BY_FIVE) + """
SELECT case_id, pos, specialty, reason, score, hits FROM ranked WHERE pos < 5""",

    "c2_sized_team": "WITH " + _HITS.format(case=_BY_FIVE) + """,
sized AS (
  SELECT *, count(*) FILTER (score >= 2) OVER (PARTITION BY case_id) AS systems FROM ranked)
SELECT case_id, pos, specialty, reason, score, hits, systems FROM sized
WHERE pos < CASE WHEN systems >= 3 THEN 5 ELSE 2 END""",

    "c3_support": "WITH " + _SUPPORTED + " SELECT * FROM supported",

    "c3_support_one_pass": "WITH " + _SUPPORTED + " SELECT * FROM supported",

    "c4_lead": "WITH " + _TEAMED + " SELECT case_id, pos, specialty, is_lead FROM led",

    "c5_fallback": "WITH " + _HITS.format(case="doc_id") + """,
led AS (
  SELECT r.*, row_number() OVER (
    PARTITION BY case_id ORDER BY standing, score DESC, pos) = 1 AS is_lead
  FROM ranked r JOIN (SELECT DISTINCT specialty, standing FROM roles) USING (specialty)
  WHERE pos < 5)
SELECT case_id, pos, specialty, is_lead FROM led
UNION ALL
SELECT doc_id, 0, 'Internal Medicine', true FROM documents
WHERE doc_id NOT IN (SELECT case_id FROM led)""",

    "c6_cap": "WITH " + _OPINIONS + "," + _NUMBERED.format(source="opin") + """
SELECT case_id, pos, specialty FROM panels WHERE pos < 10""",

    "c7_worklist": "WITH " + _WORK + """
SELECT case_id, pos, specialty, is_lead, agent_name, role_label,
  length(input) AS input_chars, md5(input) AS input_md5 FROM work""",

    "d1_review": "WITH " + _WORK + """
SELECT case_id, pos, agent_name,
  CASE WHEN specialty <> 'Pharmacist'
       THEN '{"specialty": "' || specialty || '", "chars": ' || length(input) || '}' END AS raw,
  CASE WHEN specialty = 'Pharmacist' THEN 'ValueError: no reviewer for Pharmacist' END AS error
FROM work""",

    "d2_extractive": "WITH " + _TEAMED + "," + _EVIDENCE + """
SELECT case_id, pos, specialty,
  md5(coalesce(findings, 'No relevant information found')) AS findings_md5,
  coalesce('Follow up on ' || shown, '') AS recommendation,
  coalesce(quotes, 0) AS quotes, md5(coalesce(joined, '')) AS quotes_md5,
  least(1.0::DOUBLE, coalesce(k, 0)::DOUBLE / 4) AS confidence
FROM led LEFT JOIN evidence USING (case_id, specialty) LEFT JOIN matched USING (case_id, specialty)""",

    "d4_backfill": """
WITH t AS (SELECT *, o_custkey % 6 AS kind FROM orders)
SELECT o_orderkey AS case_id,
  CASE WHEN kind = 5 THEN 'unparsed' WHEN kind IN (1, 2, 3) THEN 'invalid' ELSE 'valid' END
    AS status,
  CASE WHEN kind IN (0, 4) THEN 'Second' WHEN kind IN (2, 3) THEN o_orderpriority END
    AS lead_specialist,
  CASE WHEN kind <> 5 THEN 'status ' || o_orderstatus END AS rationale,
  CASE WHEN kind = 5 THEN NULL WHEN kind = 4 THEN '' ELSE o_orderpriority || '|Second' END AS names
FROM t""",

    "d5_clean": "WITH " + _ANSWERS + """
SELECT case_id, CAST(ln AS BIGINT) AS l_linenumber, sk AS l_suppkey, pk AS l_partkey, status, c AS confidence
FROM voted""",

    "e1_agreement": _E1 + " SELECT o_orderkey AS case_id, " + """
  coalesce(CAST(n AS BIGINT), 0) AS participating, coalesce(CAST(a AS BIGINT), 0) AS abstained,
  round_even(coalesce(mean, 0), 3) AS mean_confidence,
  round_even(coalesce(spread, 0), 3) AS confidence_spread,
  round_even(coalesce(score, 0), 3) AS agreement_score""" + _ALL_ORDERS,

    "e1_agreement_of_answers": "WITH " + _ANSWERS + "," + _moments("voted") + """
SELECT case_id, """ + _ROUNDED + ", level FROM agreed",

    "e2_levels": _E1 + " SELECT o_orderkey AS case_id, coalesce(level, 'none') AS level"
    + _ALL_ORDERS,

    "e2_level_counts": _E1 + " SELECT coalesce(level, 'none') AS level, count(*) AS panels"
    + _ALL_ORDERS + " GROUP BY 1",

    "e3_by_specialty": "WITH " + _OPINIONS + """
SELECT case_id, specialty, c AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id, specialty
                               ORDER BY ln DESC, sk DESC, pk DESC, ep DESC) AS r FROM opin)
WHERE r = 1""",

    "e4_outliers": _E1 + "," + _OUTLYING + """
SELECT case_id, specialty, c AS confidence, CAST(ln AS BIGINT) AS l_linenumber, sk AS l_suppkey, pk AS l_partkey
FROM marked WHERE is_outlier""",

    "e5_breakdown": _E1 + "," + _OUTLYING + """,
placed AS (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ln, sk, pk, ep) AS p FROM marked),
named AS (
  SELECT case_id, specialty, arg_max(c, p) AS confidence, min(p) AS first,
         bool_or(is_outlier) AS outlier
  FROM placed GROUP BY ALL)
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY confidence DESC, first) AS rank,
  specialty, confidence, outlier, confidence = 0 AS abstained FROM named""",

    "f1_findings": _ANSWER_PANELS + """
SELECT case_id, specialty, string_agg(findings, '|' ORDER BY pos) AS findings
FROM active WHERE findings IS NOT NULL GROUP BY case_id, specialty""",

    "f2_recommendations": _ANSWER_PANELS + "," + _RECOMMENDED + " SELECT * FROM recs",

    "f3_overlaps": "WITH " + _CASES + """,
w AS (
  SELECT case_id, pos, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS l
  FROM case_docs),
p AS (
  SELECT a.case_id, a.pos AS pos_a, b.pos AS pos_b, 'D' || a.pos AS specialty_a,
         'D' || b.pos AS specialty_b, len(list_intersect(a.l, b.l)) AS shared,
         len(a.l) + len(b.l) - len(list_intersect(a.l, b.l)) AS together
  FROM w a JOIN w b ON a.case_id = b.case_id AND a.pos < b.pos
  WHERE len(a.l) > 0 AND len(b.l) > 0)
SELECT *, shared::DOUBLE / together AS jaccard FROM p WHERE shared::DOUBLE / together >= 0.05""",

    "f4_conflicts": _FACT_PANELS + _CONTESTED.format(facts="panels") + """
SELECT a.case_id, a.attribute, a.pos AS pos_a, b.pos AS pos_b,
  a.specialty AS specialty_a, b.specialty AS specialty_b, a.value AS value_a, b.value AS value_b,
  CASE WHEN a.specialty = lead THEN a.value WHEN b.specialty = lead THEN b.value END AS preferred
FROM panels a JOIN panels b ON a.case_id = b.case_id AND a.attribute = b.attribute
  AND a.pos < b.pos AND a.value <> b.value
LEFT JOIN lead ON lead.case_id = a.case_id""",

    "f4_conflicting_values": _FACT_PANELS + """
facts AS (
  SELECT l_orderkey AS case_id, 'S' || l_linenumber AS specialty, l_returnflag AS attribute,
         l_linestatus AS value FROM lineitem),""" + _CONTESTED.format(facts="facts") + """
SELECT case_id, attribute, value, count(*) AS stated, count(DISTINCT specialty) AS specialties,
  count(*) AS members, CAST(count(*) * (
    sum(count(*)) OVER (PARTITION BY case_id, attribute) - count(*)) AS BIGINT) AS links,
  coalesce(bool_or(specialty = lead), false) AS preferred
FROM facts JOIN contested USING (case_id, attribute) LEFT JOIN lead USING (case_id)
GROUP BY case_id, attribute, value""",

    "f5_divergence": "WITH " + _OPINIONS + "," + _NUMBERED.format(source="opin") + ","
    + _moments("panels") + "," + _OUTLYING + "," + _NOTES + " SELECT * FROM notes",

    "g1_quotes": "WITH " + _CLAIMS + """
SELECT case_id, CAST(pos AS BIGINT) AS pos, specialist, CAST(quote_no AS BIGINT) AS quote_no,
  place IS NOT NULL AS grounded, CASE WHEN place IS NOT NULL THEN CAST(0 AS BIGINT) END AS doc,
  CAST(place AS BIGINT) AS at
FROM placed""",

    "g2_corpus": """
WITH d AS (
  SELECT doc_id, ' ' || array_to_string(
    regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS line FROM documents),
c AS (
  SELECT item_id AS claim_id, text AS claim, ' ' || array_to_string(
    regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS line FROM benchmark)
SELECT claim_id, claim, count(doc_id) > 0 AS grounded, count(doc_id) AS n_docs,
  min(doc_id) AS first_doc_id
FROM c LEFT JOIN d ON contains(d.line, c.line) GROUP BY claim_id, claim""",

    "g3_values": """
WITH evidence AS (
  SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(12,2))
    * (1 - CAST(l_discount AS DECIMAL(3,2))) * (1 + CAST(l_tax AS DECIMAL(3,2)))) AS value
  FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS entity, 'total' AS attribute,
  CASE WHEN value IS NULL THEN 'no_evidence'
       WHEN abs(CAST(o_totalprice AS DECIMAL(18,2)) - value) <= abs(value) * 0.01 THEN 'agrees'
       ELSE 'contradicts' END AS verdict
FROM orders LEFT JOIN evidence ON l_orderkey = o_orderkey""",

    "g4_verdicts": "WITH " + _VERDICTS + """
SELECT case_id, CAST(claim_no AS BIGINT) AS claim_no, specialist, verdict FROM verdicts""",

    "g5_report": "WITH " + _VERDICTS + """
SELECT case_id,
  md5(coalesce(string_agg(claim, '|' ORDER BY claim_no) FILTER (verdict = 'SAFE'), ''))
    AS verified_md5,
  coalesce(string_agg(specialist || ':' || CASE verdict
      WHEN 'HALLUCINATION' THEN 'not found in documents'
      WHEN 'CONTRADICTION' THEN 'contradicts document'
      ELSE 'inference not explicitly stated' END, '|' ORDER BY claim_no)
    FILTER (verdict <> 'SAFE'), '') AS flagged,
  count(*) FILTER (verdict = 'SAFE')::DOUBLE / count(*) AS overall_confidence,
  NOT bool_or(verdict IN ('HALLUCINATION', 'CONTRADICTION')) AS is_safe
FROM verdicts GROUP BY case_id""",

    "g5_summary": "WITH " + _VERDICTS + """
SELECT case_id, count(*) AS claims, count(*) FILTER (verdict = 'SAFE') AS verified,
  count(*) FILTER (verdict <> 'SAFE') AS flagged,
  count(*) FILTER (verdict = 'SAFE')::DOUBLE / count(*) AS overall_confidence,
  NOT bool_or(verdict IN ('HALLUCINATION', 'CONTRADICTION')) AS is_safe
FROM verdicts GROUP BY case_id""",

    "h2_stages": _STAGES,
    "h2_stages_streamed": _STAGES,

    "h2_cases": "WITH " + _EVENTS + """
SELECT case_id,
  arg_max(lead, seq) FILTER (et = 'signup' AND lead <> '') AS lead_specialist,
  bool_or(et = 'signup') AS spawned, CAST(NULL AS VARCHAR) AS consensus,
  CAST(NULL AS VARCHAR) AS discussion, CAST(NULL AS VARCHAR) AS safety_report,
  false AS complete,
  arg_max(CASE WHEN k % 3 = 0 THEN 'The pipeline stopped unexpectedly.'
               ELSE 'failed at ' || k END, seq) FILTER (et = 'error') AS error
FROM ev GROUP BY case_id""",

    "h3_drafts": _DRAFTS,
    "h3_drafts_streamed": _DRAFTS,

    "h4_orphans": "WITH " + _EVENTS + """,
seen AS (
  SELECT *, last_value(CASE WHEN et = 'signup' THEN k % 5 END IGNORE NULLS) OVER (
    PARTITION BY case_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS top
  FROM ev WHERE et IN ('signup', 'view', 'click'))
SELECT case_id, seq, type, agent AS agent_name FROM seen
WHERE et <> 'signup' AND (top IS NULL OR k % 5 > top)""",

    "h5_latency": "WITH " + _NEXT_DONE + """,
took AS (
  SELECT CAST(floor((done_seq - seq) / 1000) AS BIGINT) AS ms FROM waits
  WHERE et = 'view' AND done_seq IS NOT NULL),
ranked AS (SELECT ms, row_number() OVER (ORDER BY ms) AS r, count(*) OVER () AS n FROM took)
SELECT 'specialist' AS stage, q, min(ms) AS latency_ms, any_value(n) AS n
FROM ranked, (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) AS f(q) WHERE r >= ceil(q * n) GROUP BY q""",

    "h6_barrier": _BARRIER,
    "h6_barrier_streamed": _BARRIER,
    "h6_barrier_large": _BARRIER.replace("k % 3 + 1", f"k % {LARGE_PANEL} + 1"),
    "h6_barrier_large_streamed": _BARRIER.replace("k % 3 + 1", f"k % {LARGE_PANEL} + 1"),

    "h7_stalled": _stalled(),
    "h7_stalled_streamed": _stalled(_UP_STREAMED),

    "h8_failures": """
WITH e AS (
  SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) % 8 AS kind
  FROM events WHERE event_type = 'error')
SELECT CASE WHEN kind IN (0, 3, 6) THEN 'auth' WHEN kind IN (1, 4) THEN 'rate_limit'
            WHEN kind IN (2, 5) THEN 'connectivity' ELSE 'other' END AS class,
  count(*) AS failures
FROM e GROUP BY 1""",

    "h2_stages_of_trace": _ASSESSED + "," + _ROWS_OF_CASE + """
SELECT case_id, agent_name AS stage,
  upper(replace(agent_name, 'specialist_', '')) AS specialty,
  CASE WHEN bool_or(type = 'specialist_done') THEN 'done' ELSE 'thinking' END AS status,
  arg_max_null(findings, seq) FILTER (type = 'specialist_done') AS findings
FROM steps WHERE type IN ('specialist_thinking', 'specialist_done')
GROUP BY case_id, agent_name""",

    "h2_cases_of_trace": _ASSESSED + """
SELECT o_orderkey AS case_id, lead AS lead_specialist, true AS spawned, true AS complete,
  CAST(NULL AS VARCHAR) AS error, coalesce(agreed.level, 'none') AS level,
  CAST(is_safe AS VARCHAR) AS is_safe
FROM orders
LEFT JOIN nested ON nested.case_id = o_orderkey
LEFT JOIN agreed ON agreed.case_id = o_orderkey
LEFT JOIN safety ON safety.case_id = o_orderkey""",

    "h3_drafts_of_trace": _ASSESSED + "," + _ROWS_OF_CASE + """
SELECT case_id, agent_name, coalesce(string_agg(findings, '|' ORDER BY seq), '') AS findings
FROM steps WHERE type = 'specialist_done' GROUP BY case_id, agent_name""",

    "h1_trace": _ASSESSED + "," + _ROWS_OF_CASE + """
SELECT case_id, CAST(seq AS BIGINT) AS seq, type, agent_name, lead, message, count, findings
FROM steps""",

    "i1_assemble": _ASSESSED + """
SELECT o_orderkey AS case_id, lead AS lead_specialist, specialties, rationale,
  coalesce(findings, '') AS findings,
  round_even(coalesce(score, 0), 3) AS agreement_score, coalesce(agreed.level, 'none') AS level,
  coalesce(CAST(n AS BIGINT), 0) AS participating, coalesce(CAST(a AS BIGINT), 0) AS abstained,
  coalesce(per_specialty, '') AS per_specialty, coalesce(short, '') AS outliers,
  CASE WHEN agreed.case_id IS NULL THEN 'Panel agreement is none (0.000); nobody stands apart.'
       ELSE coalesce(note, '') END AS note,
  coalesce(recommendations, '') AS recommendations, verified, flagged, is_safe
FROM orders
LEFT JOIN nested ON nested.case_id = o_orderkey
LEFT JOIN agreed ON agreed.case_id = o_orderkey
LEFT JOIN by_name ON by_name.case_id = o_orderkey
LEFT JOIN diverging ON diverging.case_id = o_orderkey
LEFT JOIN notes ON notes.case_id = o_orderkey
LEFT JOIN listed ON listed.case_id = o_orderkey
LEFT JOIN safety ON safety.case_id = o_orderkey""",

    "i1_assess_documents": "WITH " + _TEAMED + ","
    + _EVIDENCE + "," + _CASES + "," + _SIZES + """,
valid AS (SELECT case_id FROM sizes WHERE """ + _PROBLEMS + """ = ''),
swarm AS (
  SELECT case_id, pos, specialty, is_lead FROM led JOIN valid USING (case_id)
  UNION ALL
  SELECT case_id, 0, 'Internal Medicine', true FROM valid
  WHERE case_id NOT IN (SELECT case_id FROM led)),
voiced AS (
  SELECT case_id, pos, specialty, is_lead, coalesce(quotes, 0) AS quotes,
         least(1.0::DOUBLE, coalesce(k, 0)::DOUBLE / 4) AS c
  FROM swarm LEFT JOIN evidence USING (case_id, specialty)
  LEFT JOIN matched USING (case_id, specialty)),""" + _moments("voiced") + """,
per_case AS (
  SELECT case_id, max(CASE WHEN is_lead THEN specialty END) AS lead_specialist,
         count(*) AS panel, sum(quotes) FILTER (c > 0) AS verified
  FROM voiced GROUP BY case_id)
SELECT case_id, lead_specialist, panel, round_even(score, 3) AS agreement_score, level,
  CAST(verified AS BIGINT) AS verified,
  CASE WHEN verified IS NOT NULL THEN CAST(0 AS BIGINT) END AS flagged,
  CASE WHEN verified IS NOT NULL THEN true END AS is_safe
FROM per_case JOIN agreed USING (case_id)""",

    "i1_failures": "WITH " + _TEAMED + "," + _CASES + "," + _SIZES + """
SELECT case_id, pos, 'specialist_pharmacist' AS agent_name, 'error' AS status,
  'ValueError: no reviewer for Pharmacist' AS error, 'other' AS class
FROM led JOIN (SELECT case_id FROM sizes WHERE """ + _PROBLEMS + """ = '') USING (case_id)
WHERE specialty = 'Pharmacist'""",

    "i2_callback": "WITH " + _EVENTS + " SELECT type, CAST(count(*) AS BIGINT) AS n FROM ev "
    "GROUP BY type",

    "d3_judge": """
WITH told AS (SELECT *, o_custkey % 9 AS kind FROM orders)
SELECT o_orderkey AS case_id,
  CASE kind WHEN 0 THEN 'unparsed' WHEN 1 THEN 'failed' WHEN 8 THEN 'valid' ELSE 'invalid' END
    AS status,
  kind = 8 AS valid,
  CASE WHEN kind NOT IN (0, 1, 4) THEN 'status ' || o_orderstatus END AS final_summary,
  CASE WHEN kind IN (0, 1, 2) THEN NULL WHEN kind = 5 THEN ''
       ELSE 'Keep ' || o_orderstatus || CASE WHEN kind = 6 THEN '|7' ELSE '|Watch' END
  END AS recommendations,
  CASE WHEN kind NOT IN (0, 1, 3) THEN o_orderpriority || '='
       || CASE WHEN kind = 7 THEN '' ELSE 'status ' || o_orderstatus || ',due' END || '|none='
  END AS findings
FROM told""",

    "d3_safety": """
WITH told AS (
  SELECT *, l_suppkey % 11 AS kind,
         CAST(CAST(round(l_discount * 10, 1) AS DECIMAL(3,1)) AS DOUBLE) AS conf FROM lineitem)
SELECT l_orderkey AS case_id, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey, l_partkey,
  CASE WHEN kind = 0 THEN 'unparsed' WHEN kind = 1 THEN 'failed'
       WHEN kind IN (4, 6, 7, 8, 9) THEN 'invalid' ELSE 'valid' END AS status,
  kind IN (2, 3, 5, 10) AS valid,
  CASE WHEN kind NOT IN (0, 1, 9) THEN 'part ' || l_partkey || '|counted' END AS verified,
  CASE WHEN kind NOT IN (0, 1, 8) THEN 'S' || l_linenumber || '/part ' || l_partkey
       || CASE WHEN kind = 7 THEN '' ELSE '/not found' END END AS flagged,
  CASE WHEN kind > 1 THEN 'line ' || l_linenumber END AS final_summary,
  CASE WHEN kind NOT IN (0, 1, 6) THEN conf END AS overall_confidence,
  CASE WHEN kind NOT IN (0, 1, 4) THEN kind <> 3 END AS is_safe
FROM told""",

    "d3_opinions": "WITH " + _ANSWERS + """
SELECT case_id, CAST(ln AS BIGINT) AS l_linenumber, sk AS l_suppkey, pk AS l_partkey, status,
  status = 'valid' AS valid, specialty, findings, recommendation, quotes, confidence FROM answers""",
}
