"""The SQL of the registered queries, for the side-by-side check on DuckDB."""

from __future__ import annotations

from docloom.functions.text import NAVIGATION_WORDS, STOPWORDS
from docloom.operators.ranking import BOOSTS, GENERIC_TERMS, LOW_VALUE_TYPES, PREFERRED_TYPES, UNREQUESTED_MARKERS
from docloom.plans import sql_documents, sql_retrieval
from docloom.plans.sql_text import IMAGE_LINE, VISIBLE, chunk_type, context_terms, lst, normalize, ordered_distinct, plain, query_terms, route, sanitize, squeeze, tokens, unlink
from docloom.sources.files import ICON_WORDS

HITS = "hits AS (SELECT DISTINCT * FROM retrieved_chunks WHERE query_id IS NOT NULL)"
QUESTIONS = "questions AS (SELECT query_id, arg_min(document, seq) AS question FROM hits WHERE document IS NOT NULL GROUP BY query_id)"
EFFECTIVE = "coalesce(nullif(score, 0), nullif(raw_score, 0), 0)"
FINGERPRINT = f"CASE WHEN {normalize('heading')} <> '' THEN {normalize('heading')} || chr(10) || left({normalize('text')}, 1500) ELSE left({normalize('text')}, 1500) END"
MERGED = f"""fp AS (SELECT *, {FINGERPRINT} AS f, {EFFECTIVE} AS sc FROM hits),
merged AS (SELECT * EXCLUDE (f, sc, n, seq), first_seq AS seq FROM (SELECT *, min(seq) OVER (PARTITION BY query_id, f) AS first_seq, row_number() OVER (PARTITION BY query_id, f ORDER BY sc DESC, seq) AS n FROM fp) WHERE n = 1)"""


def _boost_sql() -> str:
    has = lambda terms, text: f"len(list_filter({terms}, lambda t: contains({text}, t)))"
    return f"""
q AS (SELECT query_id, {normalize('question')} AS phrase, {ordered_distinct(query_terms('question'))} AS terms, {ordered_distinct(context_terms('question'))} AS context FROM questions),
q2 AS (SELECT *, list_filter(terms, lambda t: NOT list_contains(context, t)) AS topical, list_distinct(flatten(list_transform([4, 3, 2], lambda n: list_transform(range(1, greatest(len(terms) - n + 2, 1)), lambda i: array_to_string(terms[i:i + n - 1], ' '))))) AS phrases FROM q),
a AS (SELECT m.query_id, m.seq, m.hit_id, m.score, m.raw_score, m.retrieval_type, q2.* EXCLUDE (query_id),
    {normalize("m.metadata.title")} || ' ' || {normalize("m.heading")} || ' ' || {normalize("array_to_string(m.metadata.breadcrumbs, ' ')")} AS meta, {normalize("m.text")} AS body, lower({sanitize("m.metadata.chunk_type")}) AS kind, length({sanitize("m.text")}) AS size
  FROM merged m JOIN q2 ON m.query_id = q2.query_id),
b AS (SELECT *, {tokens('meta')} AS mw FROM a),
c AS (SELECT *, list_filter(topical, lambda t: list_contains(mw, t)) AS matched FROM b),
d AS (SELECT *, list_filter(mw, lambda t: NOT list_contains(matched, t) AND NOT list_contains({lst(STOPWORDS + GENERIC_TERMS)}, t)) AS extra FROM c),
e AS (SELECT *, list_filter(extra, lambda t: length(t) >= 4) AS specific, len(topical) AS n, len(matched) AS k, {has('phrases', 'meta')} AS pm, {has('phrases', 'body')} AS pb, {has('topical', 'meta')} AS tm, {has('topical', 'body')} AS tb, {has('context', 'meta')} AS cm,
    (phrase <> '' AND contains(meta, phrase)) AS xm, (phrase <> '' AND contains(body, phrase)) AS xb, list_filter(({tokens('body')})[1:120], lambda t: list_contains({lst(UNREQUESTED_MARKERS)}, t) AND NOT list_contains(topical, t)) AS marks FROM d),
g AS (SELECT *, (n > 0 AND len(mw) > 0 AND k >= least(2, n)) AS focused, (n > 0 AND tm = n) AS am, (n > 0 AND tb = n) AS ab FROM e),
boosted AS (SELECT *,
  CASE WHEN xm THEN 0.75 ELSE 0 END::DOUBLE AS exact_phrase_metadata, CASE WHEN NOT xm AND xb THEN 0.08 ELSE 0 END::DOUBLE AS exact_phrase_body,
  CASE WHEN pm > 0 THEN least(0.95::DOUBLE, 0.35::DOUBLE * pm) ELSE 0 END::DOUBLE AS query_phrase_metadata, CASE WHEN pm = 0 AND pb > 0 THEN least(0.07::DOUBLE, 0.025::DOUBLE * pb) ELSE 0 END::DOUBLE AS query_phrase_body,
  CASE WHEN am THEN 0.45 ELSE 0 END::DOUBLE AS all_terms_metadata, CASE WHEN NOT am AND ab THEN 0.04 ELSE 0 END::DOUBLE AS all_terms_body,
  CASE WHEN NOT am AND NOT ab AND tm > 0 THEN least(0.36::DOUBLE, 0.09::DOUBLE * tm) ELSE 0 END::DOUBLE AS term_metadata, CASE WHEN NOT am AND NOT ab AND tb > 0 THEN least(0.06::DOUBLE, 0.012::DOUBLE * tb) ELSE 0 END::DOUBLE AS term_body,
  CASE WHEN cm > 0 THEN least(0.24::DOUBLE, 0.12::DOUBLE * cm) ELSE 0 END::DOUBLE AS context_metadata,
  CASE WHEN focused AND len(extra) / greatest(k, 1) <= 1 THEN 0.14 WHEN focused AND len(extra) / greatest(k, 1) <= 2 THEN 0.08 ELSE 0 END::DOUBLE AS topic_focus,
  CASE WHEN len(context) > 0 OR n < 2 OR NOT focused THEN 0 WHEN len(specific) < 3 THEN CASE WHEN len(marks) > 0 THEN -0.28 ELSE 0 END WHEN len(list_distinct(specific)) / greatest(k, 1) >= 3 THEN -0.28 WHEN len(list_distinct(specific)) / greatest(k, 1) >= 2 THEN -0.16 ELSE 0 END::DOUBLE AS unrequested_context,
  CASE WHEN list_contains({lst(PREFERRED_TYPES)}, kind) THEN 0.08 WHEN list_contains({lst(LOW_VALUE_TYPES)}, kind) THEN -0.20 ELSE 0 END::DOUBLE AS chunk_type,
  CASE WHEN size BETWEEN 120 AND 1800 THEN 0.06 WHEN size > 3500 THEN -0.10 WHEN size < 60 THEN -0.08 ELSE 0 END::DOUBLE AS length, CASE WHEN retrieval_type = 'hybrid' THEN 0.08 ELSE 0 END::DOUBLE AS hybrid FROM g),
scored AS (SELECT *, round(CASE WHEN retrieval_type = 'keyword' THEN greatest(coalesce(nullif(raw_score, 0), score, 0), 0.45) ELSE coalesce(nullif(raw_score, 0), score, 0) END + ({' + '.join(BOOSTS)}), 6) AS final FROM boosted)"""


RANKED = f"WITH {HITS}, {QUESTIONS}, {MERGED}, {_boost_sql()}"
CORPUS = """d AS (SELECT document_id, min(filename) AS filename, min(source_path) AS source_path, min(json_extract_string(doc_metadata, '$.title')) AS title FROM source_documents GROUP BY document_id),
corpus AS (SELECT c.*, d.filename, d.source_path, d.title FROM (SELECT vector_id, min(document_id) AS document_id, min(chunk_index) AS chunk_index, min(heading) AS heading, min(content) AS content FROM document_chunks GROUP BY vector_id) c JOIN d USING (document_id))"""
TITLES = "questions AS (SELECT DISTINCT doc_id AS query_id, title AS question FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL)"
BODY = f"""lines AS (SELECT query_id, seq, list_filter(list_transform(string_split(regexp_replace(regexp_replace({sanitize('text')}, '^\\s*---\\s*\\n(?s:.*?)\\n---\\s*\\n?', ''), '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM hits)"""

NAVIGATION_LINE = f"(len({tokens(normalize('x'))}) = 0 OR (list_has_any({tokens(normalize('x'))}, {lst(NAVIGATION_WORDS)}) AND len(list_distinct({tokens(normalize('x'))})) <= 8))"
BREADCRUMB_LINE = rf"((len(regexp_extract_all(x, '\[[^\]]+\]\([^)]+\)|\[[^\]]+\]')) >= 2 OR contains(x, '>')) AND len(regexp_extract_all({VISIBLE}, '>| / ')) >= 1 AND len({tokens(normalize(VISIBLE))}) <= 20)"
SHINGLES = f"""{BODY},
bodies AS (SELECT query_id, seq, {tokens(plain(rf"regexp_replace({unlink(f'lower(array_to_string(list_filter(l, lambda x: NOT {IMAGE_LINE} AND NOT {NAVIGATION_LINE} AND NOT {BREADCRUMB_LINE}), chr(10)))')}, 'https?://\S+', ' ', 'g')"))} AS t FROM lines),
sets AS (SELECT query_id, seq, list_distinct(CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) ELSE t END) AS s FROM bodies)"""
LATEST_JOBS = "jobs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(updated_at, created_at) DESC, created_at DESC, status DESC) AS n FROM (SELECT DISTINCT * FROM ingestion_jobs WHERE id IS NOT NULL)) WHERE n = 1)"


def oracle_sql() -> dict[str, str]:
    out = {
        "sanitize_text": f"SELECT DISTINCT vector_id, {sanitize('content')} AS sanitized FROM document_chunks",
        "normalize_text": f"SELECT DISTINCT vector_id, {normalize('content')} AS normalized, {normalize('heading')} AS heading FROM document_chunks",
        "query_terms": f"SELECT doc_id, unnest(list_distinct({query_terms('title')})) AS term FROM (SELECT DISTINCT doc_id, title FROM documents)",
        "query_phrases": f"""WITH t AS (SELECT doc_id, {ordered_distinct(query_terms('title'))} AS terms FROM (SELECT DISTINCT doc_id, title FROM documents))
SELECT doc_id, unnest(list_distinct(flatten(list_transform([4, 3, 2], lambda n: list_transform(range(1, greatest(len(terms) - n + 2, 1)), lambda i: array_to_string(terms[i:i + n - 1], ' ')))))) AS phrase FROM t""",
        "context_terms": f"SELECT doc_id, unnest(list_distinct({context_terms('text')})) AS term FROM (SELECT DISTINCT doc_id, text FROM documents)",
        "classify_chunk_type": f"SELECT DISTINCT vector_id, {chunk_type('content', 'tag')} AS chunk_type FROM (SELECT vector_id, {sanitize('content')} AS s, chunk_metadata['html_tag'] AS tag FROM document_chunks)",
        "fallback_language": f"SELECT DISTINCT doc_id, CASE WHEN len(regexp_extract_all(s, '[Ѐ-ӿ]')) > len(regexp_extract_all(s, '[A-Za-z]')) THEN 'ru' WHEN regexp_matches(s, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS language FROM (SELECT doc_id, left({sanitize('text')}, 4000) AS s FROM documents)",
        "line_kinds": f"""WITH l AS (SELECT vector_id, unnest(string_split({sanitize('content')}, chr(10))) AS x FROM (SELECT DISTINCT vector_id, content FROM document_chunks WHERE content IS NOT NULL))
SELECT vector_id, count(*) AS lines, count(*) FILTER ({IMAGE_LINE}) AS images, count(*) FILTER ({NAVIGATION_LINE}) AS navigation, count(*) FILTER ({BREADCRUMB_LINE}) AS breadcrumbs FROM l GROUP BY vector_id""",
        "keyword_search": f"""WITH {CORPUS}, {TITLES}, t AS (SELECT query_id, unnest(list_distinct({query_terms('question')})) AS term FROM questions),
m AS (SELECT DISTINCT query_id, vector_id, document_id, chunk_index FROM t JOIN corpus c ON contains(lower(concat_ws(' ', content, heading, filename, source_path, title)), term))
SELECT query_id, vector_id, n AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY document_id, chunk_index, vector_id) AS INTEGER) AS n FROM m) WHERE n <= 80""",
        "merge_hits": f"WITH {HITS}, {MERGED} SELECT query_id, seq, hit_id, score, retrieval_type FROM merged",
        "merge_diagnostics": f"""WITH {HITS}, {MERGED.split('merged AS')[0].rstrip().rstrip(',')},
w AS (SELECT *, max({{'sc': sc, 's': -seq, 'source_file': source_file, 'heading': heading, 'chunk_index': chunk_index}}) OVER (PARTITION BY query_id, f ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM fp)
SELECT query_id, CASE WHEN sc > k.sc THEN -k.s ELSE seq END AS seq, CASE WHEN sc > k.sc THEN source_file ELSE k.source_file END AS duplicate_of_file, CASE WHEN sc > k.sc THEN chunk_index ELSE k.chunk_index END AS duplicate_of_chunk FROM w WHERE k IS NOT NULL""",
        "metadata_filter": f"WITH {HITS}, {MERGED} SELECT query_id, seq, hit_id FROM merged WHERE metadata.section_group = 'setup' AND metadata.chunk_type = 'procedure'",
        "min_score": f"WITH {HITS} SELECT query_id, hit_id, raw_score, CASE WHEN raw_score >= 0.55 THEN NULL ELSE 'below_min_score' END AS filtered_reason FROM hits WHERE retrieval_type = 'vector'",
        "rank_boosts": f"{RANKED} SELECT query_id, seq, hit_id, final AS score, {', '.join(BOOSTS)} FROM scored",
        "rank_topk": f"{RANKED} SELECT query_id, hit_id, final AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final DESC, seq) AS INTEGER) AS rank FROM scored) WHERE rank <= 8",
        "rerank_topn": f"""{RANKED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, seq) AS rank FROM scored),
s AS (SELECT *, rank <= 4 AS top, CASE WHEN rank <= 4 THEN final + 0.15::DOUBLE * ((size % 10)::DOUBLE / 10) ELSE final END AS new_score FROM r)
SELECT query_id, hit_id, round(new_score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN top THEN 0 ELSE 1 END, CASE WHEN top THEN -new_score END, rank) AS INTEGER) AS rank FROM s""",
        "shingle_counts": f"WITH {HITS}, {SHINGLES} SELECT query_id, seq, CAST(len(s) AS INTEGER) AS shingles FROM sets",
        "shingle_pairs": f"""WITH {HITS}, {SHINGLES}, p AS (SELECT a.query_id, a.seq, b.seq AS other_seq, len(a.s) AS na, len(b.s) AS nb, len(list_intersect(a.s, b.s)) AS c FROM sets a JOIN sets b ON a.query_id = b.query_id AND a.seq < b.seq)
SELECT query_id, seq, other_seq, round(CASE WHEN least(na, nb) / greatest(na, nb) < 0.75 THEN c / (na + nb - c) ELSE greatest(c / least(na, nb), c / (na + nb - c)) END, 6) AS similarity FROM p WHERE c > 0""",
        "vector_topk": """WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e FROM v WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, list_cosine_similarity(q.e, v.e) AS cosine FROM q, v)
SELECT query_id, vec_id, round(cosine, 4) AS cosine, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, vec_id) AS n FROM s) WHERE n <= 80""",
        "vector_index_recall": "SELECT count(DISTINCT vec_id) AS queries, true AS reached FROM embeddings WHERE vec_id % 100 = 0 AND len(embedding) > 0",
        "vector_status": "SELECT count(DISTINCT vec_id) AS points, CAST(coalesce(max(len(embedding)), 0) AS INTEGER) AS vector_size FROM embeddings",
        "upsert_points": """WITH t AS (SELECT quantile_disc(created_at, 0.5) AS cut FROM document_chunks), r AS (SELECT DISTINCT vector_id, document_id, chunk_index, char_count, created_at FROM document_chunks WHERE vector_id IS NOT NULL)
SELECT vector_id, document_id, chunk_index, CASE WHEN chunk_index % 2 = 0 THEN char_count + 1 ELSE char_count END AS char_count FROM r""",
        "route_files": f"SELECT DISTINCT document_id, {route('filename', 'CAST(NULL AS VARCHAR)')} AS route FROM source_documents",
        "route_counts": f"SELECT route, count(*) AS files FROM (SELECT document_id, {route('filename', 'content_type')} AS route FROM (SELECT DISTINCT document_id, filename, content_type FROM source_documents)) GROUP BY route",
        "route_samples": f"SELECT route, (list_sort(list(path)))[1:5] AS samples FROM (SELECT DISTINCT filename AS path, {route('filename', 'content_type')} AS route FROM source_documents) GROUP BY route",
        "new_files": "SELECT file_hash, min(filename) AS filename FROM source_documents WHERE file_hash IS NOT NULL AND file_hash NOT IN (SELECT file_hash FROM image_assets WHERE file_hash IS NOT NULL) GROUP BY file_hash",
        "resolve_links": """WITH l AS (SELECT DISTINCT * FROM document_links), p AS (SELECT source_path, min(document_id) AS id FROM source_documents WHERE source_path IS NOT NULL GROUP BY source_path)
SELECT link_id, source_document_id, coalesce(target_document_id, p.id) AS target_document_id, (l.target_document_id IS NULL AND coalesce(target_path, '') <> '' AND p.id IS NOT NULL) AS newly_resolved
FROM l LEFT JOIN p ON l.target_document_id IS NULL AND coalesce(l.target_path, '') <> '' AND l.target_path = p.source_path""",
        "link_targets": r"""SELECT DISTINCT link_id, CASE WHEN NOT (regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\-]*:') OR starts_with(href, '//')) AND h <> '' THEN
  CASE WHEN source_path IS NULL THEN h WHEN base <> '' AND starts_with(h, base || '/') THEN h WHEN starts_with(h, '/') THEN ltrim(h, '/') WHEN base <> '' THEN base || '/' || regexp_replace(h, '^(?:\./)+', '') ELSE h END END AS target
FROM (SELECT l.link_id, l.href, d.source_path, regexp_replace(l.href, '#.*$', '') AS h, regexp_extract(d.source_path, '^(.*)/[^/]*$', 1) AS base FROM document_links l LEFT JOIN (SELECT document_id, min(source_path) AS source_path FROM source_documents GROUP BY document_id) d ON l.source_document_id = d.document_id)""",
        "image_filter": f"SELECT DISTINCT image_id, (regexp_matches(lower(coalesce(filename, '')), '{'|'.join(ICON_WORDS)}') OR coalesce(width <= 32 AND height <= 32, false)) AS small FROM image_assets",
        "new_images": "SELECT DISTINCT image_id FROM image_assets i WHERE status <> 'stored' AND NOT EXISTS (SELECT 1 FROM image_assets k WHERE k.status = 'stored' AND k.file_hash IS NOT DISTINCT FROM i.file_hash AND k.path IS NOT DISTINCT FROM i.path AND k.referenced_by_document_id IS NOT DISTINCT FROM i.referenced_by_document_id)",
        "document_stats": "SELECT document_id, CAST(sum(length(content)) AS INTEGER) AS text_length, CAST(count(*) AS INTEGER) AS chunk_count FROM (SELECT DISTINCT vector_id, document_id, content FROM document_chunks WHERE chunk_type NOT IN ('empty', 'navigation')) GROUP BY document_id",
        "import_stats": "SELECT source_type, count(*) AS documents, sum(coalesce(chunk_count, 0))::BIGINT AS chunks, sum(coalesce(text_length, 0))::BIGINT AS text_length, count(*) FILTER (status = 'processing') AS processing FROM (SELECT DISTINCT document_id, source_type, status, chunk_count, text_length FROM source_documents) GROUP BY source_type",
        "import_counters": f"""WITH d AS (SELECT DISTINCT document_id, filename, file_hash, status, content_type FROM source_documents),
n AS (SELECT document_id, count(*) AS n FROM (SELECT DISTINCT document_id, vector_id FROM document_chunks WHERE chunk_type NOT IN ('empty', 'navigation')) GROUP BY document_id),
k AS (SELECT d.*, n.n, file_hash IS NOT NULL AND row_number() OVER (PARTITION BY file_hash ORDER BY filename, d.document_id) > 1 AS again, {route('filename', 'content_type')} AS route FROM d LEFT JOIN n USING (document_id)),
c AS (SELECT *, route IN ('html', 'word', 'text', 'pdf') AS readable, route IN ('html', 'word', 'text', 'pdf') AND NOT again AND status = 'ingested' AS done FROM k),
a AS (SELECT count(*) AS total_files, count(*) FILTER (status = 'ingested') AS processed, count(*) FILTER (readable AND again) AS skipped_duplicate, count(*) FILTER (done AND n IS NULL) AS skipped_empty, count(*) FILTER (done AND n IS NOT NULL) AS documents_ingested, count(*) FILTER (route IN ('ignored', 'unsupported')) AS ignored, coalesce(sum(CASE WHEN done THEN n END), 0)::BIGINT AS total_chunks FROM c),
i AS (SELECT count(*) FILTER (NOT small) AS images_stored, count(*) FILTER (small) AS images_skipped FROM (SELECT (regexp_matches(lower(coalesce(filename, '')), '{'|'.join(ICON_WORDS)}') OR coalesce(width <= 32 AND height <= 32, false)) AS small FROM (SELECT DISTINCT image_id, filename, width, height FROM image_assets))),
l AS (SELECT count(*) AS links_resolved FROM (SELECT DISTINCT * FROM document_links) x WHERE target_document_id IS NULL AND coalesce(target_path, '') <> '' AND target_path IN (SELECT source_path FROM source_documents WHERE source_path IS NOT NULL))
SELECT *, skipped_duplicate + skipped_empty AS documents_skipped, ceil(total_chunks / 256)::BIGINT AS batch_flushes FROM a, i, l""",
        "jobs_latest": f"WITH {LATEST_JOBS} SELECT id, status, processed_files, failed_files, updated_at FROM jobs",
        "jobs_listed": f"WITH {LATEST_JOBS} SELECT id, status, created_at FROM jobs ORDER BY created_at DESC, id LIMIT 50",
        "jobs_progress": f"WITH {LATEST_JOBS} SELECT status, count(*) AS jobs, sum(coalesce(total_files, 0))::BIGINT AS total_files, sum(coalesce(processed_files, 0))::BIGINT AS processed_files, sum(coalesce(failed_files, 0))::BIGINT AS failed_files, sum(epoch(date_trunc('second', finished_at))::BIGINT - epoch(date_trunc('second', started_at))::BIGINT)::BIGINT AS seconds FROM jobs GROUP BY status",
        "sentences": rf"""WITH d AS (SELECT DISTINCT doc_id, {sanitize('text')} AS s FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(s, '^\s*---\s*\n(?s:.*?)\n---\s*\n?', ''), chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT {IMAGE_LINE} AND NOT ((len(regexp_extract_all(x, '\[[^\]]+\]\([^)]+\)|\[[^\]]+\]')) >= 2 OR contains(x, '>')) AND len({tokens(normalize(VISIBLE))}) <= 50)) AS x FROM d),
t AS (SELECT doc_id, {squeeze(unlink("array_to_string(x, chr(10))"))} AS t FROM l),
p AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM t)
SELECT doc_id, sentence FROM p WHERE length(sentence) >= 35""",
        "deleted_documents": """WITH g AS (SELECT DISTINCT document_id FROM source_documents WHERE status = 'processing')
SELECT DISTINCT link_id, source_document_id, CASE WHEN target_document_id IN (SELECT document_id FROM g) THEN NULL ELSE target_document_id END AS target_document_id FROM document_links WHERE source_document_id NOT IN (SELECT document_id FROM g)""",
        "sanitize_metadata": f"SELECT DISTINCT vector_id, {sanitize('e.key')} AS key, CASE WHEN e.value IS NOT NULL THEN {sanitize('e.value')} END AS value FROM (SELECT vector_id, unnest(map_entries(chunk_metadata)) AS e FROM document_chunks)",
        "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    }
    # dots as a recursion: a step with .. takes the one before it away
    out["asset_paths"] = f"""WITH RECURSIVE targets AS ({out["link_targets"]}),
steps AS (SELECT link_id, string_split(target, '/') AS p, 1 AS i, []::VARCHAR[] AS kept FROM targets WHERE target IS NOT NULL AND NOT regexp_matches(target, '^(?:\\./)*\\.\\.(?:/|$)')
  UNION ALL SELECT link_id, p, i + 1, CASE WHEN p[i] = '.' THEN kept WHEN p[i] = '..' THEN kept[1:len(kept) - 1] ELSE list_append(kept, p[i]) END FROM steps WHERE i <= len(p))
SELECT DISTINCT link_id, array_to_string(kept, '/') AS path FROM steps WHERE i > len(p)"""
    return out | sql_documents.oracle_sql() | sql_retrieval.oracle_sql(RANKED, BODY, SHINGLES)
