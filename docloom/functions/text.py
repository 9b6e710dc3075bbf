"""Text scalars as Catalyst expressions: each takes and returns columns, and stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

#: Fixed values.
STOPWORDS = "a an and are do for how i in is of or the to what when where with".split()
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NAVIGATION_WORDS = "previous next contents index print".split()
SPACE = r"[\s\p{Z}\x{85}]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` needs it (also within the lambdas of arrays)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """``text`` without white space of any script at both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def sanitize(text: Column) -> Column:
    """Text without control characters: NUL goes, others become spaces; blanks, line ends and empty lines are reduced.

    Null and empty give an empty string.
    """
    t = F.translate(F.coalesce(text, F.lit("")), "\x00", "")
    t = F.regexp_replace(t, r"[\p{C}&&[^\t\n\r]]", " ")
    t = F.regexp_replace(t, r"[ \t\f\x0B]+", " ")
    t = F.regexp_replace(t, r" *\r?\n *", "\n")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def sanitize_map(metadata: Column) -> Column:
    """A map with sanitized keys and values; of keys that become equal the last stays; null stays null."""
    pairs = F.transform(F.map_entries(metadata), lambda e: F.struct(sanitize(e["key"]).alias("key"), F.when(e["value"].isNotNull(), sanitize(e["value"])).alias("value")))
    last = lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.greatest(F.size(all_), F.lit(1))), lambda o: o["key"] == e["key"]))
    return let(pairs, lambda p: F.map_from_entries(last(p)))


def sanitize_value(value: Column, kind: ST.DataType) -> Column:
    """A value of any depth with all its texts sanitized, map keys too; nulls stay null."""
    if isinstance(kind, ST.StringType):
        return F.when(value.isNotNull(), sanitize(value))
    if isinstance(kind, ST.ArrayType):
        return F.transform(value, lambda x: sanitize_value(x, kind.elementType))
    if isinstance(kind, ST.StructType):
        return F.when(value.isNotNull(), F.struct(*[sanitize_value(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, ST.MapType) and isinstance(kind.valueType, ST.StringType):
        return sanitize_map(value)
    if isinstance(kind, ST.MapType):
        return F.transform_values(value, lambda _, v: sanitize_value(v, kind.valueType))
    return value


def flattened(value: Column, kind: ST.DataType) -> Column:
    """All values within a value of any depth as one text, parted by blanks; null if there are none."""
    if isinstance(kind, ST.ArrayType):
        return F.nullif(F.array_join(F.transform(value, lambda x: flattened(x, kind.elementType)), " "), F.lit(""))
    if isinstance(kind, ST.MapType):
        return flattened(F.map_values(value), ST.ArrayType(kind.valueType))
    if isinstance(kind, ST.StructType):
        return F.nullif(F.concat_ws(" ", *[flattened(value[f.name], f.dataType) for f in kind.fields]), F.lit(""))
    return value.cast("string")


def unlink(text: Column) -> Column:
    """Markdown links, images and bracketed words as their visible text."""
    t = F.regexp_replace(text, r"!\[([^\]]*)\]\([^)]+\)", "$1")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.regexp_replace(t, r"\[([^\]]+)\]", "$1")


def without_punctuation(text: Column) -> Column:
    """ASCII punctuation and white space as single spaces."""
    return squeeze(F.translate(text, PUNCTUATION, " " * len(PUNCTUATION)))


def normalize(text: Column) -> Column:
    """The form in which texts are compared: sanitized, lower case, links as text, no punctuation."""
    return without_punctuation(unlink(F.lower(sanitize(text))))


def tokens(normalized: Column) -> Column:
    """Words of a normalized text; an empty array for an empty one."""
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def fingerprint(heading: Column, text: Column, length: int = 1500) -> Column:
    """What two hits with the same content share: the normalized heading and the beginning of the normalized text."""
    body = F.substring(normalize(text), 1, length)
    return let(normalize(heading), lambda h: F.concat(F.when(h != "", F.concat(h, F.lit("\n"))).otherwise(""), body))


def is_image_line(line: Column) -> Column:
    return line.rlike(r"^\s*!\[[^\]]*]\([^)]+\)\s*$")


def is_navigation_line(line: Column) -> Column:
    """Nothing readable, or up to eight different words with one of navigation among them."""
    named = F.array(*map(F.lit, NAVIGATION_WORDS))
    whole = let(F.array_distinct(tokens(normalize(line))), lambda w: (F.size(w) == 0) | (F.arrays_overlap(w, named) & (F.size(w) <= 8)))
    # most lines are readable and name none, whatever normalizing changes, so the rest is not computed for them
    plain = line.rlike("[a-zA-Z0-9]") & ~line.rlike(rf"(?i)[\[\x00]|{'|'.join(NAVIGATION_WORDS)}")
    return F.when(plain, False).otherwise(whole)


def _links(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"\[[^\]]+]\([^)]+\)|\[[^\]]+]"))


def _visible(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, r"\[([^\]]+)\]\([^)]+\)", "$1"), r"\[([^\]]+)\]", "$1")


def is_breadcrumb_line(line: Column, max_words: int = 20, separator: bool = True) -> Column:
    """Two links or a ``>``, a separator (unless told otherwise) and few words."""
    linked = F.contains(line, F.lit(">")) | (_links(line) >= 2)
    parted = lambda v: F.regexp_count(v, F.lit(">| / ")) >= 1 if separator else F.lit(True)
    # most lines fail the first test, so the rest is not computed for them
    return F.when(linked, let(_visible(line), lambda v: parted(v) & (F.size(tokens(normalize(v))) <= max_words))).otherwise(False)


def without_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A\s*---\s*\n.*?\n---\s*\n?", "")


def body_for_near_duplicates(text: Column) -> Column:
    """Normalized content lines: no front matter, images, navigation, breadcrumbs or addresses."""
    lines = F.transform(F.split(F.regexp_replace(without_front_matter(sanitize(text)), r"\r\n?", "\n"), "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~is_image_line(x) & ~is_navigation_line(x) & ~is_breadcrumb_line(x))
    t = unlink(F.lower(F.array_join(kept, "\n")))
    return without_punctuation(F.regexp_replace(t, r"https?://\S+", " "))


def shingles(normalized: Column, size: int = 5) -> Column:
    """Distinct runs of ``size`` words; the distinct words of a shorter text."""

    def runs(t):
        all_ = F.transform(F.sequence(F.lit(1), F.size(t) - size + 1), lambda i: F.array_join(F.slice(t, i, size), " "))
        return F.array_distinct(F.when(F.size(t) >= size, all_).otherwise(t))

    return let(tokens(normalized), runs)


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; for sets of nearly the same size the containment if that is greater; 0 if one is empty."""
    na, nb = F.size(a), F.size(b)
    return let(F.size(F.array_intersect(a, b)), lambda overlap: _similarity(na, nb, overlap))


def _similarity(na: Column, nb: Column, overlap: Column) -> Column:
    jaccard, contained = overlap / (na + nb - overlap), overlap / F.least(na, nb)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).when(F.least(na, nb) / F.greatest(na, nb) < 0.75, jaccard).otherwise(F.greatest(contained, jaccard))


def truncate_at_word(text: Column, limit: int) -> Column:
    """Squeezed text; beyond ``limit`` characters it is cut after a word and ends with dots."""
    cut = lambda t: F.concat(F.trim(F.regexp_replace(F.substring(t, 1, limit), r" [^ ]*\z", "")), F.lit("..."))
    return let(squeeze(sanitize(text)), lambda t: F.when(F.length(t) <= limit, t).otherwise(cut(t)))


def query_terms(question: Column, stopwords: bool = True) -> Column:
    """Words of three characters or more of a question, in order and once each; ``/`` parts words."""
    raw = F.split(squeeze(F.translate(F.lower(sanitize(question)), "/", " ")), " ")
    terms = F.transform(raw, lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}_\-]", ""))
    kept = F.filter(terms, lambda t: (F.length(t) >= 3) & (~t.isin(STOPWORDS) if stopwords else F.lit(True)))
    return F.array_distinct(kept)


def query_phrases(terms: Column) -> Column:
    """Runs of four, three and two terms, the longest first, once each."""

    def sized(t, n):
        runs = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, runs).otherwise(F.array().cast("array<string>"))

    return let(terms, lambda t: F.array_distinct(F.concat(sized(t, 4), sized(t, 3), sized(t, 2))))


def context_terms(question: Column) -> Column:
    """Terms that name a product or source by their form: acronyms and identifiers of letters and digits, in lower case."""
    edges = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"
    raw = F.transform(F.split(squeeze(sanitize(question)), " "), lambda t: F.regexp_replace(t, edges, ""))
    parts = F.flatten(F.transform(raw, lambda t: F.split(t, r"[/\\|]+")))
    clean = F.transform(parts, lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}_\-]", ""))
    acronym = lambda t: (F.upper(t) == t) & t.rlike(r"\p{Lu}")
    identifier = lambda t: t.rlike(r"\p{N}") & t.rlike(r"\p{L}")
    kept = F.filter(clean, lambda t: (F.length(t) >= 2) & t.rlike(r"\p{L}") & (acronym(t) | identifier(t)))
    return F.array_distinct(F.transform(kept, F.lower))


def context_lines(text: Column, first: int = 20) -> Column:
    """Front matter and breadcrumb lines among the first lines of a text, joined by spaces."""
    lines = F.filter(F.transform(F.slice(F.split(sanitize(text), "\n"), 1, first), lambda x: F.trim(x)), lambda x: x != "")
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))

    def step(state, x):
        fence = x == "---"
        take = ~fence & (state["inside"] | is_breadcrumb_line(x))
        return F.struct(F.when(fence, ~state["inside"]).otherwise(state["inside"]).alias("inside"), F.when(take, F.concat(state["kept"], F.array(x))).otherwise(state["kept"]).alias("kept"))

    return F.aggregate(lines, start, step, lambda s: F.array_join(s["kept"], " "))


def fallback_language(text: Column) -> Column:
    """``ru``, ``en`` or ``unknown`` by the letters of the first 4,000 characters."""

    def by_letters(sample):
        cyrillic, latin = F.regexp_count(sample, F.lit("[Ѐ-ӿ]")), F.regexp_count(sample, F.lit("[A-Za-z]"))
        return F.when(cyrillic > latin, "ru").when(latin > 0, "en").otherwise("unknown")

    return let(F.substring(sanitize(text), 1, 4000), by_letters)


#: Hints of chunk types.
PROCEDURE_HINTS = "step select click enter configure выберите нажмите введите".split()
REFERENCE_HINTS = ["see also", "related", "refer to", "смотрите", "см.", "http"]
NAVIGATION_HINTS = "contents index previous next home breadcrumb".split()


def _any(text: Column, hints: list[str]) -> Column:
    found = F.contains(text, F.lit(hints[0]))
    for h in hints[1:]:
        found = found | F.contains(text, F.lit(h))
    return found


def chunk_type(text: Column, html_tag: Column | None = None, role: Column | None = None) -> Column:
    """empty, navigation, table, procedure, reference or content; the first rule that holds decides."""
    none = F.lit(None).cast("string")

    def rules(t):
        low = F.lower(t)
        crumbs = low.startswith("![") | low.rlike(r"\.(?:gif|jpg|png)\)\z") | ((F.regexp_count(t, F.lit(">")) >= 2) & (F.length(t) < 200))
        return (
            F.when(t == "", "empty")
            .when(crumbs, "navigation")
            .when((html_tag if html_tag is not None else none) == "table", "table")
            .when((role if role is not None else none) == "navigation", "navigation")
            .when((F.length(t) < 80) & _any(low, NAVIGATION_HINTS), "navigation")
            .when(_any(low, PROCEDURE_HINTS), "procedure")
            .when(_any(low, REFERENCE_HINTS), "reference")
            .otherwise("content")
        )

    return let(sanitize(text), rules)


def looks_like_heading(text: Column) -> Column:
    """A short text without a final full stop that is numbered, mostly capitals, or capitalized word by word."""

    def look(t):
        upper, letters = F.regexp_count(t, F.lit(r"\p{Lu}")), F.regexp_count(t, F.lit(r"\p{L}"))
        titled = t.rlike(r"^\P{L}*\p{Lu}") & ~t.rlike(r"(?<!\p{L})[\p{Ll}]") & ~t.rlike(r"(?<=\p{L})\p{Lu}")
        worded = (F.size(F.split(squeeze(t), " ")) <= 10) & t.rlike(r"^\p{Lu}") & ((upper / F.greatest(letters, F.lit(1)) > 0.6) | titled)
        return (t != "") & (F.length(t) <= 120) & ~t.endswith(".") & (t.rlike(r"^\d+(\.\d+)*\s+\S+") | worded)

    return let(strip(F.coalesce(text, F.lit(""))), look)


def uuid5(namespace: Column, name: Column) -> Column:
    """The UUID of version 5 of a name in the namespace of a UUID."""
    return let(F.sha1(F.concat(F.unhex(F.translate(namespace, "-", "")), F.encode(name, "UTF-8"))), _uuid_of)


def _uuid_of(digest: Column) -> Column:
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    parts = [F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)]
    return F.concat_ws("-", *parts)
