"""SQL of the queries on documents: chunks, markdown, front matter and sessions."""

from __future__ import annotations

from docloom.plans.sql_text import chunk_type, normalize, sanitize, squeeze, tokens

#: A text that has the look of a heading.
LOOKS = r"""(t <> '' AND length(t) <= 120 AND NOT ends_with(t, '.') AND (regexp_matches(t, '^\d+(\.\d+)*\s+\S+') OR (len(string_split(t, ' ')) <= 10 AND regexp_matches(t, '^\p{Lu}')
  AND (len(regexp_extract_all(t, '\p{Lu}')) / greatest(len(regexp_extract_all(t, '\p{L}')), 1) > 0.6 OR (regexp_matches(t, '^\P{L}*\p{Lu}') AND NOT regexp_matches(t, '(^|\P{L})\p{Ll}') AND NOT regexp_matches(t, '\p{L}\p{Lu}'))))))"""


def packed(blocks: str) -> str:
    """Chunks of ``blocks`` (doc_id, n, t, h, style, tag): a recursion over the paragraphs of each document."""
    return f"""judged AS (SELECT doc_id, n, t, tag, CASE WHEN coalesce(style, '') = 'heading 1' OR (h <> '' AND h = t) OR {LOOKS} THEN coalesce(nullif(h, ''), t) END AS name FROM ({blocks}) WHERE t <> ''),
carried AS (SELECT *, last_value(name IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS heading FROM judged),
paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, t, heading, tag, length(t) AS l FROM carried WHERE name IS NULL),
fold AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS done, false AS held, 0::BIGINT AS size, NULL::VARCHAR AS heading, 0::BIGINT AS place, NULL::VARCHAR AS t, NULL::VARCHAR AS tag, false AS long FROM (SELECT DISTINCT doc_id FROM paras)
  UNION ALL SELECT p.doc_id, p.i,
    CASE WHEN p.l > 1800 THEN f.done + f.held::INT + ceil(p.l / 1800)::BIGINT WHEN cut THEN f.done + 1 ELSE f.done END, p.l <= 1800,
    CASE WHEN p.l > 1800 THEN 0 WHEN cut OR NOT f.held THEN p.l ELSE f.size + p.l END, p.heading,
    CASE WHEN p.l > 1800 THEN f.done + f.held::INT WHEN cut THEN f.done + 1 ELSE f.done END, p.t, p.tag, p.l > 1800
  FROM (SELECT f.*, p.i AS pi, f.held AND (f.heading IS DISTINCT FROM p.heading OR (f.size + p.l > 1800 AND f.size >= 300)) AS cut FROM fold f JOIN paras p ON p.doc_id = f.doc_id AND p.i = f.i + 1) f JOIN paras p ON p.doc_id = f.doc_id AND p.i = f.pi),
pieces AS (SELECT doc_id, place, string_agg(t, chr(10) || chr(10) ORDER BY i) AS content, any_value(heading) AS heading, arg_max(tag, i) FILTER (tag IS NOT NULL) AS html_tag FROM fold WHERE i > 0 AND NOT long GROUP BY doc_id, place
  UNION ALL SELECT doc_id, place + k, trim(substr(t, 1800 * k + 1, 1800)), heading, tag FROM (SELECT *, unnest(range(0, ceil(length(t) / 1800)::INT)) AS k FROM fold WHERE long)),
typed AS (SELECT *, {chunk_type('content', 'html_tag')} AS chunk_type FROM (SELECT *, {sanitize('content')} AS s FROM pieces WHERE content <> ''))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INTEGER) AS chunk_index, content, heading, html_tag, chunk_type,
  CASE WHEN len(regexp_extract_all(left(s, 4000), '[Ѐ-ӿ]')) > len(regexp_extract_all(left(s, 4000), '[A-Za-z]')) THEN 'ru' WHEN regexp_matches(left(s, 4000), '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS language, CAST(length(content) AS INTEGER) AS char_count
FROM typed WHERE chunk_type NOT IN ('empty', 'navigation')"""


FRONT = r"'\A---\n((?s:.*?)\n)?[ \t]*---[ \t]*(?:\n|\z)'"
UNIX = "replace(coalesce(text, ''), chr(13) || chr(10), chr(10))"
MARKDOWN = rf"""docs AS (SELECT doc_id, title, string_split(regexp_replace({UNIX}, {FRONT}, ''), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
raws AS (SELECT doc_id, title, n, ls[n] AS raw FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS n FROM docs)),
cleaned AS (SELECT *, {sanitize('raw')} AS line FROM raws),
shown AS (SELECT *, contains(raw, '|') AS bar FROM cleaned WHERE NOT regexp_matches(line, '^\s*!\[[^\]]*\]\([^)]+\)\s*$')
  AND NOT (contains(line, '>') AND len(regexp_extract_all(line, '\[[^\]]+\]\([^)]+\)|\[[^\]]+\]')) >= 2 AND trim(replace(regexp_replace(regexp_replace(line, '\[[^\]]+\]\([^)]+\)', '', 'g'), '\[[^\]]+\]', '', 'g'), '>', '')) = '')),
runs AS (SELECT *, sum((NOT bar)::INT) OVER (PARTITION BY doc_id ORDER BY n) AS run, bar AND coalesce(regexp_matches(lead(raw) OVER (PARTITION BY doc_id ORDER BY n), '^\s*\|?\s*:?-{{3,}}'), false) AS starts FROM shown),
tabled AS (SELECT *, bar AND bool_or(starts) OVER (PARTITION BY doc_id, run ORDER BY n) AS tab FROM runs),
headed AS (SELECT *, CASE WHEN NOT tab THEN nullif({sanitize("regexp_extract(line, '^#{1,6}\\s+(.+)$', 1)")}, '') END AS head FROM tabled),
kinds AS (SELECT *, CASE WHEN tab THEN 'table' WHEN head IS NOT NULL THEN 'heading' WHEN line = '' THEN 'blank' ELSE 'paragraph' END AS kind FROM headed),
breaks AS (SELECT *, (kind = 'heading' OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY n))::INT AS fresh FROM kinds),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY n) AS block_no, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n), title) AS heading,
  list_filter(list_transform(string_split(regexp_replace(trim(raw), '^\|+|\|+$', '', 'g'), '|'), lambda c: {sanitize('c')}), lambda c: c <> '') AS cells FROM breaks),
parts AS (SELECT *, CASE WHEN kind = 'table' THEN CASE WHEN NOT regexp_matches(raw, '^\s*\|?\s*:?-{{3,}}:?\s*(?:\|\s*:?-{{3,}}:?\s*)+\|?\s*$') AND len(cells) > 0 THEN array_to_string(cells, ' | ') END WHEN kind = 'heading' THEN head ELSE line END AS part FROM numbered WHERE kind <> 'blank'),
joined AS (SELECT doc_id, block_no, kind, heading, coalesce(string_agg(part, chr(10) ORDER BY n), '') AS body, lower(string_agg(raw, chr(10) ORDER BY n)) AS low FROM parts GROUP BY ALL),
md AS (SELECT doc_id, CAST(block_no AS INTEGER) AS block_no, {sanitize('body')} AS text, heading, kind FROM joined
    WHERE {sanitize('body')} <> '' AND NOT (kind = 'table' AND regexp_matches(low, 'previous|next|printer|print|welcome|contents') AND length(regexp_replace(low, '[|\-:\s\[\]()_./]+', '', 'g')) < 80)
  UNION ALL SELECT doc_id, 0, {sanitize('title')}, title, 'title' FROM documents WHERE text IS NOT NULL AND {sanitize('title')} <> '')"""


def unquoted(x: str) -> str:
    return rf"CASE WHEN length({sanitize(x)}) >= 2 AND regexp_matches({sanitize(x)}, '^(?s:''.*''|\".*\")$') THEN substr({sanitize(x)}, 2, length({sanitize(x)}) - 2) ELSE {sanitize(x)} END"


def oracle_sql() -> dict[str, str]:
    text_blocks = rf"""SELECT doc_id, n, {squeeze(sanitize('ps[n]'))} AS t, '' AS h, NULL AS style, NULL::VARCHAR AS tag FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS n FROM (SELECT doc_id, string_split(regexp_replace({sanitize('text')}, '\r\n?', chr(10), 'g'), chr(10) || chr(10)) AS ps FROM documents WHERE text IS NOT NULL))"""
    md_blocks = f"""SELECT doc_id, block_no AS n, {squeeze(sanitize('text'))} AS t, {sanitize("CASE WHEN kind IN ('title', 'heading') THEN text ELSE heading END")} AS h, CASE WHEN kind IN ('title', 'heading') THEN 'heading 1' END AS style, CASE WHEN kind = 'table' THEN 'table' END AS tag FROM md"""
    return {
        "chunk_documents": f"WITH RECURSIVE {packed(text_blocks)}",
        "markdown_blocks": f"WITH {MARKDOWN} SELECT doc_id, block_no, text, heading, kind FROM md",
        "markdown_chunks": f"WITH RECURSIVE {MARKDOWN}, {packed(md_blocks)}",
        "front_matter": rf"""WITH f AS (SELECT doc_id, string_split(regexp_extract({UNIX}, {FRONT}, 1), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, n, ls[n] AS x FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS n FROM f)),
k AS (SELECT *, regexp_matches(x, '^[ \t]+') AS item, NOT regexp_matches(x, '^[ \t]+') AND contains(x, ':') AS key_line FROM l WHERE NOT regexp_matches(x, '^\s*(?:#.*)?$')),
g AS (SELECT *, sum(key_line::INT) OVER (PARTITION BY doc_id ORDER BY n) AS part FROM k WHERE item OR key_line),
keys AS (SELECT doc_id, part, {sanitize("split_part(x, ':', 1)")} AS key, trim(regexp_replace(x, '^[^:]*:', '')) AS v FROM g WHERE key_line),
items AS (SELECT doc_id, part, list({unquoted(r"regexp_replace(x, '^\s+- ', '')")} ORDER BY n) AS more FROM g WHERE item AND part > 0 AND regexp_matches(x, '^\s+- ') GROUP BY ALL),
whole AS (SELECT k.doc_id, k.part, key, list_concat(CASE WHEN v = '' THEN [] WHEN regexp_matches(v, '^(?s:\[.*\])$') THEN list_transform(list_filter(string_split(regexp_replace(v, '^\[|\]$', '', 'g'), ','), lambda y: trim(y) <> ''), lambda y: {unquoted('trim(y)')}) ELSE [{unquoted('v')}] END, coalesce(more, [])) AS values
  FROM keys k LEFT JOIN items i ON i.doc_id = k.doc_id AND i.part = k.part)
SELECT doc_id, key, values FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY part DESC) AS r FROM whole) WHERE r = 1""",
        "event_sessions": """WITH g AS (SELECT user_id, ts, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE)::INT AS fresh FROM events WHERE ts IS NOT NULL),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM s GROUP BY user_id, n""",
        "point_ids": """WITH d AS (SELECT DISTINCT document_id, filename FROM source_documents),
h AS (SELECT DISTINCT vector_id, sha1(unhex(replace(c.document_id, '-', '')) || encode(filename || ':' || chunk_index::VARCHAR)) AS x FROM document_chunks c JOIN d ON d.document_id = c.document_id)
SELECT vector_id, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(x, 17, 1)) - 1) % 4 + 1, 1) || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS point_id FROM h""",
    }
