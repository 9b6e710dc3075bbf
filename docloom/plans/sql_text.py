"""Text functions as SQL."""

from __future__ import annotations

from docloom.functions.text import NAVIGATION_HINTS, PROCEDURE_HINTS, REFERENCE_HINTS, STOPWORDS
from docloom.sources.files import ROUTES, TYPES

PUNCTUATION = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def lst(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"


def sanitize(x: str) -> str:
    x = rf"regexp_replace(coalesce({x}, ''), '[^\P{{C}}\t\n\r]', ' ', 'g')"
    x = rf"regexp_replace({x}, '[ \t\f\v]+', ' ', 'g')"
    x = rf"regexp_replace({x}, ' *\r?\n *', chr(10), 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace(regexp_replace({x}, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"


def unlink(x: str) -> str:
    x = rf"regexp_replace({x}, '!\[([^\]]*)\]\([^)]+\)', '\1', 'g')"
    x = rf"regexp_replace({x}, '\[([^\]]+)\]\([^)]+\)', '\1', 'g')"
    return rf"regexp_replace({x}, '\[([^\]]+)\]', '\1', 'g')"


def plain(x: str) -> str:
    return squeeze(f"translate({x}, '{PUNCTUATION}', '{' ' * 32}')")


def normalize(x: str) -> str:
    return plain(unlink(f"lower({sanitize(x)})"))


def tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


def query_terms(x: str, stop: bool = True) -> str:
    raw = f"string_split({squeeze(f'''replace(lower({sanitize(x)}), '/', ' ')''')}, ' ')"
    terms = rf"list_transform({raw}, lambda t: regexp_replace(t, '[^\p{{L}}\p{{N}}_\-]', '', 'g'))"
    return f"list_filter({terms}, lambda t: length(t) >= 3" + (f" AND NOT list_contains({lst(STOPWORDS)}, t))" if stop else ")")


def context_terms(x: str) -> str:
    raw = rf"list_transform(string_split({squeeze(sanitize(x))}, ' '), lambda t: regexp_replace(regexp_replace(t, '^[!-/:-@\[-`{{-~]+', ''), '[!-/:-@\[-`{{-~]+$', ''))"
    parts = rf"flatten(list_transform({raw}, lambda t: regexp_split_to_array(t, '[/\\|]+')))"
    clean = rf"list_transform({parts}, lambda t: regexp_replace(t, '[^\p{{L}}\p{{N}}_\-]', '', 'g'))"
    kept = rf"list_filter({clean}, lambda t: length(t) >= 2 AND regexp_matches(t, '\p{{L}}') AND ((upper(t) = t AND regexp_matches(t, '\p{{Lu}}')) OR regexp_matches(t, '\p{{N}}')))"
    return f"list_transform({kept}, lambda t: lower(t))"


def chunk_type(x: str, tag: str) -> str:
    has = lambda hints: " OR ".join(f"contains(lower(s), '{h}')" for h in hints)
    return f"""CASE WHEN s = '' THEN 'empty'
    WHEN starts_with(lower(s), '![') OR regexp_matches(lower(s), '\\.(gif|jpg|png)\\)$') OR (length(s) - length(replace(s, '>', '')) >= 2 AND length(s) < 200) THEN 'navigation'
    WHEN {tag} = 'table' THEN 'table'
    WHEN length(s) < 80 AND ({has(NAVIGATION_HINTS)}) THEN 'navigation'
    WHEN {has(PROCEDURE_HINTS)} THEN 'procedure' WHEN {has(REFERENCE_HINTS)} THEN 'reference' ELSE 'content' END"""


def route(path: str, kind: str) -> str:
    ext = rf"coalesce(lower(regexp_extract(regexp_extract({path}, '[^/\\]*$', 0), '[^.](\.[^.]*)$', 1)), '')"
    types = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in TYPES.items()) + "}"
    mime = f"coalesce({kind}, {types}[{ext}], '')"
    out = "CASE"
    for name, extensions, mimes, prefix in ROUTES:
        test = f"list_contains({lst(extensions)}, {ext})"
        if mimes:
            test += f" OR list_contains({lst(mimes)}, {mime})"
        if prefix:
            test += f" OR starts_with({mime}, '{prefix}')"
        out += f" WHEN {test} THEN '{name}'"
    return out + " ELSE 'unsupported' END"


#: Tests of a line ``x``, and its visible text.
IMAGE_LINE = r"regexp_matches(x, '^\s*!\[[^\]]*\]\([^)]+\)\s*$')"
VISIBLE = r"regexp_replace(regexp_replace(x, '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '\[([^\]]+)\]', '\1', 'g')"
