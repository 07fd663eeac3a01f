"""Scalar functions as Spark columns: no Python runs per row here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions import vocabulary as V

#: ASCII punctuation at either end of a token: beside white space or an end of the text.
PUNCTUATION_ENDS = r"(?<!\S)[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+(?!\S)"


def text_or_empty(value: Column) -> Column:
    """Null as the empty text."""
    return F.coalesce(value.cast("string"), F.lit(""))


def search_tokens(text: Column) -> Column:
    """Tokens of the lexical index: split at white space, lower-cased, without ASCII punctuation at the ends, none empty."""
    # one pass over the whole text, in compiled code, instead of one for each token
    return F.array_remove(F.split(F.regexp_replace(F.lower(text_or_empty(text)), PUNCTUATION_ENDS, ""), r"\s+"), "")


def word_tokens(text: Column) -> Column:
    """All runs of ``[a-z0-9]`` of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit("([a-z0-9]+)"), 1)


def content_terms(text: Column) -> Column:
    """The distinct word tokens without stop words."""
    return F.array_except(word_tokens(text), F.array(*map(F.lit, V.STOP_WORDS)))


def question_terms(text: Column) -> Column:
    """Content terms of a question (of two letters or more, no question words); null for what isn't one or has none."""
    tokens = word_tokens(text)
    asks = F.endswith(F.trim(text_or_empty(text)), F.lit("?")) | F.coalesce(F.get(tokens, F.lit(0)).isin(*V.QUESTION_WORDS), F.lit(False))
    terms = F.filter(F.array_except(tokens, F.array(*map(F.lit, (*V.STOP_WORDS, *V.QUESTION_WORDS)))), lambda t: F.length(t) >= 2)
    return F.when(asks & (F.size(terms) > 0), terms)


def predicate_key(value: Column) -> Column:
    """Lower-cased, everything but letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text_or_empty(value))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def predicate_label(value: Column) -> Column:
    """The lexical label of a predicate: ASCII alone, snake case, a letter first, at most 80 characters; else empty."""
    raw = text_or_empty(value)
    label = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), r"[^a-z0-9_]+", "_"), "_+", "_"), "^_+|_+$", "")
    return F.when(raw.rlike(r"[^\x00-\x7F]") | ~label.rlike(r"^[a-z][a-z0-9_]{0,79}$"), F.lit("")).otherwise(label)


def mapped(value: Column, mapping: dict[str, str]) -> Column:
    """The value's image, or itself where the map has none."""
    if not mapping:
        return value
    table = F.create_map(*[F.lit(x) for pair in sorted(mapping.items()) for x in pair])
    return F.coalesce(F.try_element_at(table, value), value)


def normalized_predicate(value: Column, aliases: dict[str, str] | None = None) -> Column:
    """The label under the core aliases; ``aliases`` only apply where no core alias does."""
    return mapped(predicate_label(value), {**(aliases or {}), **V.PREDICATE_ALIASES})


def near_dup_key(value: Column) -> Column:
    """Lower-cased letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(value)), "[^0-9a-z]+", " "))


def ascii_surface_key(value: Column) -> Column:
    """The exact comparison key for texts without characters that NFC or case folding treat apart from lower-casing."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(value)), r"\s+", " "))


def is_metadata_predicate(value: Column) -> Column:
    return predicate_key(value).isin(*V.METADATA_PREDICATES)


def is_noisy_predicate(value: Column) -> Column:
    return predicate_key(value).isin(*V.NOISY_PREDICATES)


def is_low_value_title(title: Column) -> Column:
    """Empty, a version, a bare number or a single punctuation character."""
    t = F.trim(text_or_empty(title))
    return (t == "") | t.rlike(r"(?i)^v\d+(\.\d+)*$") | t.rlike(r"^\d+$") | t.rlike(r"^[^\w\s]$")


def is_filename(title: Column) -> Column:
    return F.trim(text_or_empty(title)).rlike(rf"(?i)\.({V.FILE_ENDINGS})$")


def is_generic_title(title: Column) -> Column:
    return F.lower(F.trim(text_or_empty(title))).isin(*V.GENERIC_TITLES)


def is_structural_claim(predicate: Column, title: Column) -> Column:
    """Claims that ingest mints from headings, tags and links, and metadata."""
    key, low = predicate_key(predicate), F.lower(F.trim(text_or_empty(title)))
    starts = reduce(lambda a, b: a | b, (low.startswith(s) for s in V.STRUCTURAL_TITLE_STARTS))
    return key.isin(*V.STRUCTURAL_PREDICATES) | key.isin(*V.METADATA_PREDICATES) | starts


def quality_weight(predicate: Column, title: Column) -> Column:
    """1 for content, less for metadata and for titles without value."""
    meta = is_metadata_predicate(predicate) | F.trim(text_or_empty(title)).rlike(r"(?i)^(tags?|label|version)\b")
    return F.when(meta, F.lit(V.METADATA_WEIGHT)).when(is_low_value_title(title), F.lit(V.LOW_VALUE_WEIGHT)).otherwise(F.lit(1.0))


def sha256_id(*parts: Column) -> Column:
    """The content-addressed id: sha256 of the parts with U+001F between them; null parts are empty."""
    return F.sha2(F.concat_ws("\x1f", *map(text_or_empty, parts)), 256)


def edge_id(src: Column, kind: Column, dst: Column) -> Column:
    return sha256_id(F.lit("edge"), src, kind, dst)


def cluster_id(members: Column) -> Column:
    """The first 16 digits of the hash over the sorted members."""
    return F.substring(F.sha2(F.array_join(F.array_sort(members), "\x1f"), 256), 1, 16)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, mode: str = "truncate") -> Column:
    """Cosine of two arrays; 0 for empty or zero vectors.

    Vectors of unequal length: ``truncate`` compares the common start, ``strict`` gives 0, ``full`` takes the dot
    product of the common start over the norms of the whole vectors.
    """
    n = F.least(F.size(a), F.size(b))
    x, y = (F.slice(a, 1, n), F.slice(b, 1, n)) if mode != "full" else (a, b)
    scale = norm(x) * norm(y)
    value = F.when((n > 0) & (scale > 0), dot(F.slice(a, 1, n), F.slice(b, 1, n)) / scale).otherwise(0.0)
    return F.when(F.size(a) == F.size(b), value).otherwise(0.0) if mode == "strict" else value


def estimated_tokens(text: Column, factor: float = V.TOKEN_FACTOR) -> Column:
    """Tokens that a language model would count, from characters."""
    return F.floor(F.length(text) / 4 * F.lit(factor)).cast("int")


def verbalized(predicate: Column) -> Column:
    return F.trim(F.lower(F.translate(text_or_empty(predicate), "_", " ")))


def parsed_date(value: Column) -> Column:
    """The date of an ISO date or time; null for anything else."""
    return F.coalesce(value.try_cast("date"), F.try_to_timestamp(value).cast("date"))


def surname(title: Column) -> Column:
    """The last token of a title of several, if it has a letter."""
    tokens = word_tokens(title)
    last = F.try_element_at(tokens, F.lit(-1))
    return F.when((F.size(tokens) >= 2) & last.rlike("[a-z]"), last)


def email_handle(value: Column) -> Column:
    """``casey.lee@x`` as ``casey lee``; null unless the local part has two or more tokens joined by dots or underscores."""
    local = F.substring_index(F.lower(F.trim(text_or_empty(value))), "@", 1)
    return F.when(local.rlike(r"^[a-z0-9]+([._][a-z0-9]+)+$"), F.regexp_replace(local, "[._]+", " "))


def is_distinctive(token: Column) -> Column:
    return (F.length(token) >= 4) & ~token.isin(*V.GENERIC_TOKENS)


def proper_subset(a: Column, b: Column) -> Column:
    """Whether one array's elements are a proper subset of the other's, neither empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    small, large = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
    return (small > 0) & (small < large) & (F.size(F.array_intersect(x, y)) == small)


def token_subset(a: Column, b: Column) -> Column:
    """Proper subset with the same first token."""
    x, y = word_tokens(a), word_tokens(b)
    return proper_subset(x, y) & (F.get(x, F.lit(0)) == F.get(y, F.lit(0)))


def token_subset_unordered(a: Column, b: Column) -> Column:
    """Proper subset that shares a distinctive token."""
    x, y = word_tokens(a), word_tokens(b)
    return proper_subset(x, y) & F.exists(F.array_intersect(x, y), is_distinctive)


def alias_base(title: Column) -> Column:
    """The title's tokens without company suffixes at the end, one at least."""
    tokens = word_tokens(title)
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))), lambda i: F.when(~F.get(tokens, i - 1).isin(*V.COMPANY_SUFFIXES), i).otherwise(F.lit(1)))
    return F.slice(tokens, F.lit(1), F.array_max(ends))


def digits(value: Column) -> Column:
    return F.regexp_replace(text_or_empty(value), "[^0-9Xx]", "")


def valid_isbn(value: Column) -> Column:
    """ISBN-10 or ISBN-13 by check digit."""
    d = F.upper(digits(value))
    digit = lambda i: F.when(F.substring(d, i, 1) == "X", 10).otherwise(F.substring(d, i, 1).try_cast("int"))
    ten = sum((digit(i) * (11 - i) for i in range(1, 11)), F.lit(0)) % 11 == 0
    thirteen = sum((digit(i) * (1 if i % 2 else 3) for i in range(1, 14)), F.lit(0)) % 10 == 0
    return F.coalesce(F.when(d.rlike("^[0-9]{9}[0-9X]$"), ten).when(d.rlike("^[0-9]{13}$"), thirteen), F.lit(False))


def valid_orcid(value: Column) -> Column:
    """Four groups of four with an ISO 7064 MOD 11-2 check digit."""
    raw = F.upper(text_or_empty(value))
    d = F.regexp_replace(raw, "-", "")
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.substr(d, i, F.lit(1)).try_cast("int")), F.lit(0), lambda s, x: (s + x) * 2)
    check = (12 - total % 11) % 11
    expected = F.when(check == 10, F.lit("X")).otherwise(check.cast("string"))
    return F.coalesce(raw.rlike(r"^\d{4}-\d{4}-\d{4}-\d{3}[0-9X]$") & (F.substring(d, 16, 1) == expected), F.lit(False))


def valid_identifier(scheme: Column, value: Column) -> Column:
    """Whether the value is well formed under its scheme; an unknown scheme is not."""
    v = F.trim(text_or_empty(value))
    return (
        F.when(scheme == "QID", v.rlike(r"^Q[1-9]\d*$"))
        .when(scheme == "ORCID", valid_orcid(v))
        .when(scheme == "DOI", v.rlike(r"^10\.\d{4,9}/\S+$"))
        .when(scheme == "ISBN", valid_isbn(v))
        .when(scheme == "EMAIL", v.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"))
        .when(scheme == "DOMAIN", v.rlike(r"(?i)^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,}$"))
        .otherwise(F.lit(False))
    )


def safe_path(value: Column) -> Column:
    """Whether a path is relative, without parent steps, backslashes, drive letters or NUL, and at most 4096 long."""
    bad = value.rlike(r"^/|^[A-Za-z]:|\\|\x00") | F.array_contains(F.split(value, "/"), "..") | (F.length(value) > 4096)
    return F.coalesce(~bad, F.lit(False))


def bcp47(tag: Column) -> Column:
    """A language tag in canonical case (``pt-Latn-BR``); null if it has another shape."""
    parts = F.transform(F.split(tag, "-"), lambda p, i: F.when(i == 0, F.lower(p)).when(p.rlike("^[A-Za-z]{4}$"), F.initcap(p)).otherwise(F.upper(p)))
    return F.when(tag.rlike(r"^[A-Za-z]{2,3}(-[A-Za-z]{4})?(-([A-Za-z]{2}|[0-9]{3}))?$"), F.array_join(parts, "-"))


def literal_identity(kind: Column, value: Column) -> Column:
    """The identity of a literal: its kind (str, int, float, bool) and JSON, so that 1, 1.0, true and "1" stay apart."""
    return F.concat(F.lit("literal:"), kind, F.lit(":"), F.when(kind == "str", F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2)).otherwise(value))


def semantic_claim_id(subject: Column, predicate: Column, object_id: Column, kind: Column, value: Column) -> Column:
    """The id of a claim by what it says."""
    return sha256_id(F.lit("claim"), subject, predicate, F.coalesce(object_id, literal_identity(kind, value)))


def contains_all(answer: Column, tokens: Column) -> Column:
    """Whether an answer has every token, whatever the case."""
    return F.forall(tokens, lambda t: F.lower(text_or_empty(answer)).contains(F.lower(t)))


def within_span(start: Column, end: Column, outer_start: Column, outer_end: Column) -> Column:
    """Whether a span lies in another and isn't empty."""
    return (start >= outer_start) & (end <= outer_end) & (start < end)


def surface_flags(text: Column) -> Column:
    """What of a spelling a comparison would change: spaces, underscores, curly quotes, long dashes, signs of a wrong decoding."""
    t = text_or_empty(text)
    tests = (
        ("whitespace_normalized", F.trim(F.regexp_replace(t, r"\s+", " ")) != t),
        ("underscore_separator", t.contains("_")),
        ("apostrophe_variant", t.rlike("[\u2018\u2019\u201b]")),
        ("dash_variant", t.rlike("[\u2013\u2014]")),
        ("suspected_mojibake", t.rlike("\ufffd|\u00c3[\u00a1\u00a3\u00a9\u00aa\u00ad\u00b3\u00ba\u00a7]|\u00e2\u20ac|\u00f0\u0178")),
    )
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))


#: Titles of a pack for software work that stand for another. Fixed values.
PACK_TITLES = {"epics": "Epic", "stories": "Story", "tasks": "Task"}


def canonical_title(kind: Column, title: Column, pack_titles: dict[str, str] | None = None) -> Column:
    """A title's shape made one: white space, space around slashes, slashes at the end (unless it is nothing else), and a leading "The" of a concept; letters stay as they are.

    ``pack_titles`` replaces whole titles of concepts, whatever their case. A null title is empty, a null kind no concept.
    """
    bare = F.regexp_replace(F.regexp_replace(text_or_empty(title), r"(?U)\s+", " "), r"(?U)\s*/\s*", "/")
    bare = F.regexp_replace(bare, r"(?U)^\s+|\s+$", "")
    bare = F.coalesce(F.nullif(F.regexp_replace(bare, "/+$", ""), F.lit("")), bare)
    concept = F.regexp_replace(F.regexp_replace(bare, r"(?iU)^the\s+", ""), r"(?U)^\s+|\s+$", "")
    if pack_titles:
        table = F.create_map(*(F.lit(x) for pair in sorted(pack_titles.items()) for x in pair))
        concept = F.coalesce(F.try_element_at(table, F.lower(concept)), concept)
    return F.when(kind.eqNullSafe(F.lit("Concept")), concept).otherwise(bare)


def document_title(explicit: Column, path: Column, root: Column, copies: str | None = None) -> Column:
    """A document's title: the one that its front matter has, else its path below the root without the extension, else, where it isn't below the root, its file's name without it.

    ``copies`` names the folder below the root where copies of outside files lie; it is left out, and so is a folder of 16
    hexadecimal digits in it that stands for where they came from.
    """
    ending = r"([^/])\.[^/.]+$"
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]*)/*$", 1), ending, "$1")
    base = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    below = F.when(path.startswith(base), F.substr(path, F.length(base) + 1))
    if copies:
        inside = F.when(below.startswith(F.lit(f"{copies}/")), F.regexp_replace(F.substr(below, F.lit(len(copies) + 2)), "^[0-9a-f]{16}/(?=.)", ""))
        below = F.coalesce(inside, below)
    return F.coalesce(F.nullif(explicit, F.lit("")), F.nullif(F.regexp_replace(below, ending, "$1"), F.lit("")), stem)


def reference_tokens(node: Column, named: list[Column], path: Column, root: Column) -> Column:
    """What others may call a document by: its id, what its front matter names it, its file's name, its path, and that below the root; distinct, none empty."""
    base = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    name = F.regexp_extract(path, "([^/]*)/*$", 1)
    below = F.when(path.startswith(base), F.substr(path, F.length(base) + 1))
    return F.filter(F.array_distinct(F.array_compact(F.array(node, *named, name, path, below))), lambda t: t != "")


def plan_hash(run: Column, plan: Column, operations: Column, context: Column) -> Column:
    """``sha256:`` and the digest of a plan's compact JSON; ``operations`` is an array of JSON objects in order, ``context`` one, both with their keys in order; for ASCII values."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    whole = F.concat(F.lit('{"context":'), context, F.lit(',"operations":['), F.array_join(operations, ","), F.lit('],"plan_id":'), quoted(plan), F.lit(',"run_id":'), quoted(run), F.lit("}"))
    return F.concat(F.lit("sha256:"), F.sha2(whole, 256))
