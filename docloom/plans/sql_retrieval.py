"""SQL of the queries on ranked candidates: near-duplicate groups, final candidates and contexts."""

from __future__ import annotations

from docloom.operators.answers import SYSTEM_PROMPT, USER_PROMPT
from docloom.operators.ranking import BOOSTS
from docloom.plans import sql_answers
from docloom.plans.sql_text import normalize, sanitize

_VISIBLE = r"regexp_replace(regexp_replace(x, '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '\[([^\]]+)\]', '\1', 'g')"
_CRUMBS = rf"((len(regexp_extract_all(x, '\[[^\]]+\]\([^)]+\)|\[[^\]]+\]')) >= 2 OR contains(x, '>')) AND len(regexp_extract_all({_VISIBLE}, '>| / ')) >= 1 AND len(list_filter(string_split({normalize(_VISIBLE)}, ' '), lambda t: t <> '')) <= 20)"
_REASONS = """list_filter([CASE WHEN exact_phrase_metadata > 0 THEN 'exact_phrase_in_metadata' END, CASE WHEN exact_phrase_body > 0 THEN 'exact_phrase_in_content' END, CASE WHEN query_phrase_metadata > 0 THEN 'query_phrase_in_metadata' END, CASE WHEN query_phrase_body > 0 THEN 'query_phrase_in_content' END,
  CASE WHEN all_terms_metadata > 0 THEN 'all_strong_terms_in_metadata' END, CASE WHEN all_terms_body > 0 THEN 'all_strong_terms_in_content' END, CASE WHEN term_metadata > 0 THEN 'strong_terms_in_metadata' END, CASE WHEN term_body > 0 THEN 'strong_terms_in_content' END,
  CASE WHEN context_metadata > 0 THEN 'query_context_in_metadata' END, CASE WHEN topic_focus > 0 THEN 'focused_topic_metadata' END, CASE WHEN unrequested_context < 0 THEN 'unrequested_specific_context' END,
  CASE WHEN chunk_type > 0 THEN 'preferred_chunk_type:' || kind WHEN chunk_type < 0 THEN 'low_value_chunk_type:' || kind END,
  CASE WHEN length > 0 THEN 'focused_chunk_length' WHEN size > 3500 THEN 'long_noisy_chunk' WHEN size < 60 THEN 'very_short_chunk' END, CASE WHEN hybrid > 0 THEN 'matched_vector_and_keyword' END], lambda r: r IS NOT NULL)"""


def oracle_sql(ranked: str, body: str, shingles: str) -> dict[str, str]:
    near = f"""{ranked.replace("WITH ", "WITH RECURSIVE ", 1)}, {shingles.replace(body, body.replace("FROM hits", "FROM merged"))},
r AS (SELECT s.*, {_REASONS} AS ranking_reason, CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY final DESC, s.seq) AS INTEGER) AS i, coalesce(nullif(final, 0), nullif(s.raw_score, 0), 0) AS sc, len(t.s) AS n_s, t.s AS sh FROM scored s JOIN sets t ON t.query_id = s.query_id AND t.seq = s.seq),
first_lines AS (SELECT query_id, seq, unnest(range(1, len(fl) + 1)) AS n, fl FROM (SELECT query_id, seq, list_filter(list_transform((string_split({sanitize('text')}, chr(10)))[1:20], lambda x: trim(x)), lambda x: x <> '') AS fl FROM merged)),
fenced AS (SELECT query_id, seq, n, fl[n] AS x, sum((fl[n] = '---')::INT) OVER (PARTITION BY query_id, seq ORDER BY n) AS fences FROM first_lines),
context_of AS (SELECT query_id, seq, string_agg(x, ' ' ORDER BY n) AS cl FROM fenced WHERE x <> '---' AND (fences % 2 = 1 OR {_CRUMBS}) GROUP BY ALL),
about AS (SELECT m.query_id, m.seq, {normalize("concat_ws(' ', m.metadata.title, array_to_string(m.metadata.breadcrumbs, ' '), coalesce(cl, ''), m.metadata.heading, m.metadata.chunk_type, m.metadata.section_group)")} AS about_text FROM merged m LEFT JOIN context_of c ON c.query_id = m.query_id AND c.seq = m.seq),
rr AS (SELECT r.*, len(list_filter(list_distinct(list_concat(r.context, r.terms)), lambda t: contains(about_text, t))) AS ch, len(list_filter(r.phrases, lambda t: contains(about_text, t))) AS ph FROM r JOIN about a ON a.query_id = r.query_id AND a.seq = r.seq),
sims AS (SELECT a.query_id, a.i, b.i AS j, CASE WHEN a.n_s = 0 OR b.n_s = 0 THEN 0 WHEN least(a.n_s, b.n_s) / greatest(a.n_s, b.n_s) < 0.75 THEN c / (a.n_s + b.n_s - c) ELSE greatest(c / least(a.n_s, b.n_s), c / (a.n_s + b.n_s - c)) END AS sim
  FROM (SELECT a.query_id, a.i, b.i AS j, len(list_intersect(a.sh, b.sh)) AS c FROM rr a JOIN rr b ON a.query_id = b.query_id AND a.i <> b.i) p JOIN rr a ON a.query_id = p.query_id AND a.i = p.i JOIN rr b ON b.query_id = p.query_id AND b.i = p.j),
lists AS (SELECT query_id, i, list(sim ORDER BY j) AS sl FROM sims WHERE j < i GROUP BY ALL),
sizes AS (SELECT query_id, list(n_s ORDER BY i) AS ns FROM rr GROUP BY query_id),
greedy AS (SELECT query_id, 1 AS i, [1] AS faces, [1] AS grp FROM sizes
  UNION ALL SELECT query_id, i, CASE WHEN joins THEN CASE WHEN ns[i] > ns[faces[best]] THEN list_concat(list_concat(faces[1:best - 1], [i]), faces[best + 1:]) ELSE faces END ELSE list_append(faces, i) END, list_append(grp, CASE WHEN joins THEN best ELSE len(faces) + 1 END)
  FROM (SELECT *, ns[i] > 0 AND like_[best] >= 0.92 AND like_[best] > 0 AS joins FROM (SELECT *, list_position(like_, list_max(like_)) AS best FROM (SELECT g.query_id, l.i, faces, grp, ns, list_transform(faces, lambda f: sl[f]) AS like_ FROM greedy g JOIN lists l ON l.query_id = g.query_id AND l.i = g.i + 1 JOIN sizes z ON z.query_id = g.query_id)))),
groups AS (SELECT query_id, unnest(range(1, len(grp) + 1))::INTEGER AS i, unnest(grp)::INTEGER - 1 AS group_no FROM (SELECT query_id, arg_max(grp, i) AS grp FROM greedy GROUP BY query_id)),
placed AS (SELECT rr.*, g.group_no, row_number() OVER (PARTITION BY rr.query_id, g.group_no ORDER BY ch DESC, ph DESC, sc DESC, rr.i) AS place FROM rr JOIN groups g ON g.query_id = rr.query_id AND g.i = rr.i),
final AS (SELECT m.* EXCLUDE (score, ranking_reason), p.final AS score, p.ranking_reason, CAST(row_number() OVER (PARTITION BY p.query_id ORDER BY p.i) AS INTEGER) AS final_rank FROM placed p JOIN merged m ON m.query_id = p.query_id AND m.seq = p.seq WHERE place = 1 QUALIFY final_rank <= 8)"""
    ends = lambda x: rf"regexp_replace(regexp_replace({x}, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"
    block = f"'Source: ' || coalesce(source_file, 'None') || chr(10) || 'Heading: ' || coalesce(nullif(heading, ''), 'N/A') || chr(10) || 'Chunk: ' || coalesce(chunk_index::VARCHAR, 'None') || chr(10) || {sanitize('text')}"
    cut = ends("regexp_replace(left(b, greatest(12000 - used, 0)), ' [^ ]*\\z', '')")
    blocks = f"""{near},
blocks AS (SELECT query_id, final_rank AS n, {ends(block)} AS b FROM final),
budget AS (SELECT query_id, 0 AS n, 0 AS used, []::VARCHAR[] AS parts FROM (SELECT DISTINCT query_id FROM blocks)
  UNION ALL SELECT query_id, n, CASE WHEN used < 12000 AND cut <> '' THEN used + length(cut) + 2 ELSE used END, CASE WHEN used < 12000 AND cut <> '' THEN list_append(parts, cut) ELSE parts END
  FROM (SELECT u.query_id, k.n, used, parts, CASE WHEN length(b) > 12000 - used THEN {cut} ELSE b END AS cut FROM budget u JOIN blocks k ON k.query_id = u.query_id AND k.n = u.n + 1))"""
    return {
        "near_duplicate_groups": f"""{near}
SELECT p.query_id, CAST(p.seq AS INTEGER) AS seq, place = 1 AS kept, group_no, CASE WHEN place > 1 THEN CAST(k.seq AS INTEGER) END AS duplicate_of_seq, CASE WHEN place > 1 THEN round(s.sim, 6) END AS similarity
FROM placed p JOIN (SELECT query_id, group_no AS g, seq, i AS ki FROM placed WHERE place = 1) k ON k.query_id = p.query_id AND k.g = p.group_no LEFT JOIN sims s ON s.query_id = p.query_id AND s.i = p.i AND s.j = k.ki""",
        "retrieve_final": f"{near} SELECT query_id, final_rank, hit_id, score, ranking_reason FROM final",
        "retrieval_diagnostics": f"""{near},
seen AS (SELECT *, max({{'sc': sc, 's': -seq, 'source_file': source_file, 'chunk_index': chunk_index}}) OVER (PARTITION BY query_id, f ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM fp),
displaced AS (SELECT query_id, CASE WHEN sc > k.sc THEN -k.s ELSE seq END AS seq, CASE WHEN sc > k.sc THEN source_file ELSE k.source_file END AS file, CASE WHEN sc > k.sc THEN chunk_index ELSE k.chunk_index END AS chunk FROM seen WHERE k IS NOT NULL),
rows_ AS (SELECT query_id, seq, 'searched' AS stage, NULL AS reason, document, source_file, heading, chunk_index, document_id, raw_score, score, score AS final_score, retrieval_type, coalesce(ranking_reason, []) AS ranking_reason, retrieval_stage_score, NULL::DOUBLE AS boost, NULL AS file, NULL::INT AS chunk, NULL::DOUBLE AS similarity FROM hits
  UNION ALL SELECT h.query_id, h.seq, 'merged', 'duplicate_content', document, source_file, heading, chunk_index, document_id, raw_score, score, score, retrieval_type, coalesce(ranking_reason, []), retrieval_stage_score, NULL, d.file, d.chunk, NULL FROM hits h JOIN displaced d ON d.query_id = h.query_id AND d.seq = h.seq
  UNION ALL SELECT p.query_id, p.seq, 'near', 'near_duplicate_content', m.document, m.source_file, m.heading, m.chunk_index, m.document_id, m.raw_score, NULL, p.final, m.retrieval_type, p.ranking_reason, m.retrieval_stage_score, {{boost}}, o.source_file, o.chunk_index, s.sim
    FROM placed p JOIN merged m ON m.query_id = p.query_id AND m.seq = p.seq JOIN (SELECT query_id, group_no AS g, seq, i AS ki FROM placed WHERE place = 1) k ON k.query_id = p.query_id AND k.g = p.group_no JOIN merged o ON o.query_id = k.query_id AND o.seq = k.seq LEFT JOIN sims s ON s.query_id = p.query_id AND s.i = p.i AND s.j = k.ki WHERE place > 1
  UNION ALL SELECT f.query_id, f.seq, 'final', NULL, f.document, f.source_file, f.heading, f.chunk_index, f.document_id, f.raw_score, f.score, f.score, f.retrieval_type, f.ranking_reason, f.retrieval_stage_score, {{boost}}, NULL, NULL, NULL FROM final f JOIN placed p ON p.query_id = f.query_id AND p.seq = f.seq)
SELECT query_id, seq, stage, document, source_file, heading, chunk_index, document_id, raw_score, score, retrieval_type, reason AS filtered_reason, ranking_reason, retrieval_stage_score, CASE WHEN retrieval_type = 'keyword' THEN 0.45::DOUBLE END AS keyword_score, NULL::DOUBLE AS reranker_score, final_score, round(boost, 6) AS boost, file AS duplicate_of_file, chunk AS duplicate_of_chunk, round(similarity, 6) AS similarity FROM rows_""".replace("{boost}", " + ".join(f"p.{b}" for b in BOOSTS)),
        **sql_answers.oracle_sql(near),
        "answer_prompts": f"""{blocks}, told AS (SELECT query_id, array_to_string(arg_max(parts, n), chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS context FROM budget GROUP BY query_id)
SELECT t.query_id, '{SYSTEM_PROMPT.replace("'", "''")}' AS system, replace(replace('{USER_PROMPT.replace("{terms}", "Keep the terms of the source.")}', '{{question}}', {sanitize('question')}), '{{context}}', context) AS user FROM told t JOIN questions q ON q.query_id = t.query_id""",
        "answer_contexts": f"{blocks} SELECT query_id, array_to_string(arg_max(parts, n), chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS context FROM budget GROUP BY query_id",
    }
