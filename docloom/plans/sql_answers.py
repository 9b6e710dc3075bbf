"""SQL of the queries on answers, over the CTE ``final`` of the final candidates."""

from __future__ import annotations

from docloom.operators.answers import NO_EXCERPT, NOTHING_FOUND, SECTIONS
from docloom.plans.sql_text import IMAGE_LINE, VISIBLE, normalize, ordered_distinct, query_terms, sanitize, squeeze, tokens, unlink

NOISE = rf"({IMAGE_LINE} OR ((len(regexp_extract_all(x, '\[[^\]]+\]\([^)]+\)|\[[^\]]+\]')) >= 2 OR contains(x, '>')) AND len({tokens(normalize(VISIBLE))}) <= 50))"


def readable(text: str) -> str:
    """Readable text in one line."""
    lines = rf"list_transform(string_split(regexp_replace({sanitize(text)}, '^\s*---\s*\n(?s:.*?)\n---\s*\n?', ''), chr(10)), lambda x: trim(x))"
    return squeeze(unlink(f"array_to_string(list_filter({lines}, lambda x: x <> '' AND NOT {NOISE}), chr(10))"))


def truncated(text: str, limit: int) -> str:
    whole = squeeze(sanitize(text))
    return rf"CASE WHEN length({whole}) <= {limit} THEN {whole} ELSE trim(regexp_replace(left({whole}, {limit}), ' [^ ]*\z', '')) || '...' END"


def unique(name: str, source: str) -> str:
    """The CTE ``name``: at most three rows of ``source`` (query_id, final_rank, f, w) a query that don't repeat an earlier one."""
    common = "len(list_intersect(a.w, b.w))"
    return f"""{name}_i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_rank) AS i FROM {source}),
{name}_p AS (SELECT a.query_id, b.i AS i, list(a.i) AS alike FROM {name}_i a JOIN {name}_i b ON a.query_id = b.query_id AND a.i < b.i AND a.f <> '' AND b.f <> ''
  AND (a.f = b.f OR (len(a.w) > 0 AND len(b.w) > 0 AND ({common} / least(len(a.w), len(b.w)) >= 0.88 OR {common} / len(list_distinct(list_concat(a.w, b.w))) >= 0.82))) GROUP BY ALL),
{name}_r AS (SELECT query_id, 0::BIGINT AS i, []::BIGINT[] AS kept FROM (SELECT DISTINCT query_id FROM {name}_i)
  UNION ALL SELECT r.query_id, x.i, CASE WHEN len(kept) >= 3 OR list_has_any(kept, coalesce(alike, []::BIGINT[])) THEN kept ELSE list_append(kept, x.i) END FROM {name}_r r JOIN {name}_i x ON x.query_id = r.query_id AND x.i = r.i + 1 LEFT JOIN {name}_p p ON p.query_id = x.query_id AND p.i = x.i),
{name} AS (SELECT x.* FROM {name}_i x JOIN (SELECT query_id, arg_max(kept, i) AS kept FROM {name}_r GROUP BY query_id) k ON k.query_id = x.query_id AND list_contains(kept, x.i))"""


def oracle_sql(final: str) -> dict[str, str]:
    told = f"""{final},
plain_texts AS (SELECT query_id, final_rank, source_file, document, heading, {readable('text')} AS t FROM final),
prints AS (SELECT *, left({normalize('t')}, 700) AS f, list_distinct({tokens(f"left({normalize('t')}, 700)")}) AS w FROM plain_texts),
firsts AS (SELECT query_id, source_file AS s1, document AS d1 FROM final WHERE final_rank = 1),
near_first AS (SELECT p.* FROM prints p JOIN firsts o ON o.query_id = p.query_id WHERE p.source_file IS NOT DISTINCT FROM s1 OR p.document IS NOT DISTINCT FROM d1),
{unique('main_ones', 'near_first')},
asked AS (SELECT query_id, {ordered_distinct(query_terms('question', False))} AS terms FROM questions),
split_up AS (SELECT query_id, final_rank, string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts, t FROM plain_texts),
said AS (SELECT query_id, final_rank, pos, sentence FROM (SELECT query_id, final_rank, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS sentence FROM split_up) WHERE length(sentence) >= 35),
matched AS (SELECT s.query_id, s.final_rank, pos, sentence, len(list_filter(terms, lambda t: contains({normalize('sentence')}, t))) AS m, len(terms) AS n FROM said s JOIN main_ones o ON o.query_id = s.query_id AND o.final_rank = s.final_rank JOIN asked a ON a.query_id = s.query_id WHERE {normalize('sentence')} <> ''),
short_ones AS (SELECT query_id, final_rank, pos, m, {truncated('sentence', 240)} AS fact FROM matched WHERE n = 0 OR m > 0),
printed AS (SELECT *, left({normalize(readable('fact'))}, 700) AS f FROM short_ones),
facts AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY m DESC, final_rank, pos) AS INTEGER) AS fact_no, fact FROM (SELECT *, row_number() OVER (PARTITION BY query_id, f ORDER BY m DESC, final_rank, pos) AS r FROM printed WHERE f <> '') WHERE r = 1 QUALIFY fact_no <= 5)"""
    line = lambda s: "'" + s.replace("'", "''") + "'"
    return {
        "answer_facts": f"{told} SELECT query_id, fact_no, fact FROM facts",
        "retrieval_answers": f"""{told},
{unique('shown', 'prints')},
excerpts AS (SELECT u.query_id, {truncated("coalesce((SELECT arg_min(sentence, pos) FROM said s WHERE s.query_id = u.query_id AND s.final_rank = 1), u.t)", 240)} AS excerpt FROM split_up u WHERE u.final_rank = 1),
listed AS (SELECT query_id, list(fact ORDER BY fact_no) AS fs FROM facts GROUP BY query_id),
sourced AS (SELECT query_id, string_agg(k || '. ' || coalesce(source_file, 'None') || ' — ' || coalesce(nullif(heading, ''), document, 'None'), chr(10) ORDER BY k) AS src FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_rank) AS k FROM shown) GROUP BY query_id),
parts AS (SELECT q.query_id, src, coalesce(fs, [excerpt]) AS fs FROM questions q LEFT JOIN listed l ON l.query_id = q.query_id LEFT JOIN excerpts e ON e.query_id = q.query_id LEFT JOIN sourced s ON s.query_id = q.query_id),
brief AS (SELECT *, trim(array_to_string(fs[1:2], ' ')) AS b FROM parts)
SELECT query_id, CASE WHEN src IS NULL THEN {line(NOTHING_FOUND)} ELSE trim(array_to_string([{line(SECTIONS[0])}, '', {line(SECTIONS[1])}, coalesce(nullif(CASE WHEN length(b) > 420 THEN {truncated('b', 420)} ELSE b END, ''), {line(NO_EXCERPT)}), '', {line(SECTIONS[2])}]
  || list_transform(list_filter(fs, lambda y: y <> ''), lambda y: '- ' || y) || ['', {line(SECTIONS[3])}, src], chr(10))) END AS answer FROM brief""",
    }
