"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from docloom.llm import language, leakage, ledger, main_content, near_duplicates, repeated_lines, subjects, tokenize
from docloom.storage import table

#: The folder of public tokenizers; set DOCLOOM_TOKENIZERS where it lies elsewhere.
TOKENIZERS = os.environ.get("DOCLOOM_TOKENIZERS", "/opt/tokenizers")


def p1_found(spark, sf_dir):
    return repeated_lines.found(table(spark, sf_dir, "document_chunks"), table(spark, sf_dir, "source_documents"))


def p1_clean(spark, sf_dir):
    cleaned = repeated_lines.remove_repeated_lines(table(spark, sf_dir, "document_chunks").select("document_id", "vector_id", "site", "content"), table(spark, sf_dir, "source_documents"))
    return cleaned.select("vector_id", "content", "removed_lines").distinct()


def p1_near(spark, sf_dir):
    return repeated_lines.near_lines(table(spark, sf_dir, "document_chunks"), table(spark, sf_dir, "source_documents")).select("vector_id", "line_no", "documents")


def p2_found(spark, sf_dir):
    return ledger.found(table(spark, sf_dir, "document_chunks"), table(spark, sf_dir, "source_documents"))


def p2_counts(spark, sf_dir):
    return ledger.collapsed(table(spark, sf_dir, "document_chunks"), table(spark, sf_dir, "source_documents"))


def p3_found(spark, sf_dir):
    return main_content.found(table(spark, sf_dir, "document_chunks"), table(spark, sf_dir, "source_documents"))


def p4_found(spark, sf_dir):
    return language.found(table(spark, sf_dir, "document_chunks"), table(spark, sf_dir, "source_documents"))


def p5_found(spark, sf_dir):
    return near_duplicates.found(table(spark, sf_dir, "document_chunks"), table(spark, sf_dir, "retrieved_chunks"))


def p5_groups(spark, sf_dir):
    return near_duplicates.groups(table(spark, sf_dir, "document_chunks"), table(spark, sf_dir, "retrieved_chunks"))


def p6_ids(spark, sf_dir):
    return tokenize.encoded(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def p7_found(spark, sf_dir):
    return leakage.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p7_near(spark, sf_dir):
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), words=13, budget=2)


def p8_found(spark, sf_dir):
    return subjects.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects"))


def queries():
    return {f.__name__: f for f in (p1_found, p1_clean, p1_near, p2_found, p2_counts, p3_found, p4_found, p5_found, p5_groups, p6_ids, p7_found, p7_near, p8_found)}


_SITE = r"nullif(regexp_extract(regexp_replace(replace(lower(trim({0})), '\', '/'), '^(?:[a-z][a-z0-9+.\-]*:/*|\./+|/+)+', ''), '^[^/]*', 0), '')"

_P1_LINES = f"""
WITH paths AS (SELECT document_id AS d, min({_SITE.format("source_path")}) AS s FROM source_documents WHERE source_path IS NOT NULL GROUP BY document_id),
chunks AS (SELECT DISTINCT c.document_id, c.vector_id, c.content, coalesce(p.s, {_SITE.format("c.site")}) AS site
  FROM document_chunks c LEFT JOIN paths p ON c.document_id = p.d WHERE c.content IS NOT NULL),
parts AS (SELECT *, string_split(content, chr(10)) AS ls FROM chunks WHERE site IS NOT NULL),
lines AS (SELECT document_id, vector_id, content, site, CAST(i - 1 AS INTEGER) AS line_no, regexp_replace(lower(ls[i]), '[^\\p{{L}}]+', '', 'g') AS letters, ls[i] AS line
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM parts)),
frequent AS (SELECT site, letters FROM lines WHERE letters <> '' GROUP BY site, letters HAVING count(DISTINCT document_id) >= 8),
hits AS (SELECT DISTINCT l.vector_id, l.line_no FROM lines l JOIN frequent f ON l.site = f.site AND l.letters = f.letters)
"""

_P2_KEYS = """
WITH chunk_keys AS (SELECT DISTINCT 'chunk' AS record, vector_id AS id,
    CASE WHEN lower(trim(chunk_type)) = 'table'
      THEN array_to_string(list_sort(list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(lower(x), '[^\\p{L}\\p{N}]+', '', 'g')), lambda x: x <> '')), chr(10))
      ELSE regexp_replace(lower(content), '[^\\p{L}\\p{N}]+', '', 'g') END AS k
  FROM document_chunks WHERE content IS NOT NULL),
hashes AS (SELECT DISTINCT document_id AS id, file_hash,
    regexp_replace(regexp_replace(lower(file_hash), '^\\s*(?:sha-?_?256\\s*[:=]?\\s*)?(?:0x)?', ''), '[\\s:_\\-]+', '', 'g') AS h, doc_metadata AS m FROM source_documents),
entries AS (SELECT id, m, list_sort(list_transform(json_keys(m), lambda x: x || chr(9) || regexp_replace(lower(coalesce(m ->> ('$."' || x || '"'), '')), '[^\\p{L}\\p{N}]+', '', 'g'))) AS e
  FROM hashes WHERE file_hash IS NULL AND json_valid(m)),
document_keys AS (SELECT 'document' AS record, id, h AS k FROM hashes WHERE regexp_full_match(h, '[0-9a-f]{64}')
  UNION SELECT 'document', id, 'm' || array_to_string(e, chr(10)) FROM entries),
keyed AS (SELECT * FROM chunk_keys WHERE k <> '' UNION SELECT * FROM document_keys),
sets AS (SELECT record, k, min(id) AS first_id, count(DISTINCT id) AS copies FROM keyed GROUP BY record, k)
"""

_P5_PAIRS = """WITH texts AS (SELECT DISTINCT 'chunk' AS record, CAST(0 AS BIGINT) AS scope, vector_id AS id, content AS text, chunk_type AS kind FROM document_chunks WHERE content IS NOT NULL
  UNION SELECT 'retrieved', query_id, hit_id, text, metadata.chunk_type FROM retrieved_chunks WHERE text IS NOT NULL AND query_id IS NOT NULL),
keyed AS (SELECT *, CASE WHEN lower(trim(kind)) = 'table'
      THEN array_to_string(list_sort(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(lower(x), '[^\\p{L}\\p{N}]+', '', 'g')), lambda x: x <> '')), chr(10))
      ELSE regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') END AS k FROM texts),
split AS (SELECT *, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM keyed),
runs AS (SELECT DISTINCT record, scope, id, k, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM split)),
sizes AS (SELECT record, scope, id, count(*) AS n FROM runs GROUP BY ALL),
pairs AS (SELECT a.record, a.scope, a.id AS first_id, b.id AS second_id, count(*) AS c FROM runs a JOIN runs b ON a.record = b.record AND a.scope = b.scope AND a.g = b.g AND a.id < b.id AND a.k <> b.k GROUP BY ALL),
alike AS (SELECT DISTINCT p.record, p.scope, first_id, second_id FROM pairs p JOIN sizes x ON x.record = p.record AND x.scope = p.scope AND x.id = first_id
  JOIN sizes y ON y.record = p.record AND y.scope = p.scope AND y.id = second_id WHERE c >= 0.6 * (x.n + y.n - c) - 1e-9)
"""


def oracle_sql():
    return {
        "p1_found": _P1_LINES + "SELECT vector_id, line_no FROM hits",
        "p1_clean": _P1_LINES
        + """, gone AS (SELECT vector_id, list(line_no) AS g FROM hits GROUP BY vector_id)
SELECT DISTINCT c.vector_id, CASE WHEN g IS NULL OR c.content IS NULL THEN c.content ELSE
    coalesce((SELECT string_agg(ls[i], chr(10) ORDER BY i) FROM (SELECT string_split(c.content, chr(10)) AS ls, unnest(range(1, len(string_split(c.content, chr(10))) + 1)) AS i) WHERE NOT list_contains(g, i - 1)), '') END AS content,
  CAST(coalesce(len(g), 0) AS INTEGER) AS removed_lines
FROM document_chunks c LEFT JOIN gone USING (vector_id)""",
        "p2_found": _P2_KEYS + "SELECT DISTINCT record, first_id, id AS copy_id FROM keyed JOIN sets USING (record, k) WHERE copies > 1 AND id <> first_id",
        "p2_counts": _P2_KEYS + "SELECT record, first_id, copies FROM sets",
        "p5_found": _P5_PAIRS + "SELECT DISTINCT record, first_id, second_id FROM alike",
        "p5_groups": _P5_PAIRS.replace("WITH ", "WITH RECURSIVE ", 1)
        + """, shaped AS (SELECT record, scope, id, k, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM split),
classes AS (SELECT *, min(id) OVER (PARTITION BY record, scope, k, g, CASE WHEN k = '' THEN id END) AS class_id FROM shaped),
edges AS (SELECT DISTINCT s.record, s.scope, a.class_id AS x, b.class_id AS y FROM alike s JOIN classes a ON a.record = s.record AND a.scope = s.scope AND a.id = s.first_id JOIN classes b ON b.record = s.record AND b.scope = s.scope AND b.id = s.second_id
  UNION SELECT DISTINCT record, scope, min(class_id) OVER (PARTITION BY record, scope, k), class_id FROM classes WHERE k <> ''),
both_ways AS (SELECT record, scope, x, y FROM edges UNION SELECT record, scope, y, x FROM edges),
reach AS (SELECT DISTINCT record, scope, class_id AS x, class_id AS y FROM classes UNION SELECT r.record, r.scope, r.x, b.y FROM reach r JOIN both_ways b ON b.record = r.record AND b.scope = r.scope AND b.x = r.y),
roots AS (SELECT record, scope, x, min(y) AS group_id FROM reach GROUP BY ALL),
linked AS (SELECT record, scope, x, count(*) AS links FROM (SELECT DISTINCT s.record, s.scope, a.class_id AS x, b.class_id AS y FROM alike s JOIN classes a ON a.record = s.record AND a.scope = s.scope AND (a.id = s.first_id OR a.id = s.second_id) JOIN classes b ON b.record = s.record AND b.scope = s.scope AND (b.id = s.first_id OR b.id = s.second_id) AND b.class_id <> a.class_id) GROUP BY ALL)
SELECT DISTINCT c.record, CASE WHEN c.record = 'retrieved' THEN c.scope END AS query_id, c.id, c.class_id, r.group_id, coalesce(l.links, 0) AS links FROM classes c
JOIN roots r ON r.record = c.record AND r.scope = c.scope AND r.x = c.class_id LEFT JOIN linked l ON l.record = c.record AND l.scope = c.scope AND l.x = c.class_id""",
        # within a candidate, each word of the passage is a letter and every other word another sign; windows are compared by edit distance
        "p7_near": r"""WITH dw AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
passages AS (SELECT DISTINCT item_id, w[i:i + 12] AS pw FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM iw)),
pieces AS (SELECT item_id, pw, o, n, array_to_string(pw[o + 1:o + n], ' ') AS g FROM passages, (VALUES (0, 5), (5, 4), (9, 4)) AS v(o, n)),
grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (VALUES (5), (4)) AS v(n))),
meets AS (SELECT DISTINCT doc_id, item_id, pw, i - o AS b FROM grams JOIN pieces USING (n, g)),
coded AS (SELECT doc_id, item_id, array_to_string(list_transform(pw, lambda x: chr(64 + list_position(pw, x))), '') AS p, array_to_string(list_transform(w[greatest(b - 2, 1):b + 14], lambda x: chr(64 + coalesce(list_position(pw, x), 0))), '') AS d FROM meets JOIN dw USING (doc_id)),
scored AS (SELECT doc_id, item_id, levenshtein(p, substr(d, f, l)) AS e FROM coded, (SELECT unnest(range(1, 8))::INTEGER AS f), (SELECT unnest(range(11, 16))::INTEGER AS l) WHERE f + l - 1 <= length(d))
SELECT doc_id, item_id, min(e)::INTEGER AS edits FROM scored WHERE e <= 2 GROUP BY doc_id, item_id""",
        "p7_found": """
WITH RECURSIVE dw AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
dg AS (SELECT doc_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM dw)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM iw))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    }
