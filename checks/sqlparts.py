"""DuckDB spellings of the shared scalar steps, used by the check statements."""

from __future__ import annotations

from sitemill import constants as C
from sitemill.functions import markup, text, urls


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, {lit(urls.SCHEME)}, 1))"


def host(u: str) -> str:
    return f"regexp_extract({u}, {lit(urls.HOST)}, 1)"


def path(u: str) -> str:
    return f"regexp_extract({u}, {lit(urls.PATH)}, 1)"


def query(u: str) -> str:
    return f"regexp_extract({u}, {lit(urls.QUERY)}, 1)"


def origin(u: str) -> str:
    return f"({scheme(u)} || '://' || {host(u)})"


def clean_url(u: str) -> str:
    params = f"regexp_replace(regexp_replace({query(u)}, {lit(urls.UTM_PARAMETER)}, '', 'g'), '^&', '')"
    return (
        f"({scheme(u)} || '://' || lower({host(u)}) || {path(u)} || "
        f"CASE WHEN {params} <> '' THEN '?' || {params} ELSE '' END)"
    )


def is_good(u: str) -> str:
    return (
        f"({scheme(u)} IN ('http', 'https') AND contains({host(u)}, '.') "
        f"AND NOT regexp_matches({u}, '[ \\t\\r\\n]') AND length({u}) <= {urls.MAX_URL_LENGTH} "
        f"AND NOT regexp_matches({path(u)}, {lit(urls.ASSET_SUFFIX)}))"
    )


def page_key(u: str) -> str:
    c = clean_url(u)
    return f"CASE WHEN {path(u)} = '' THEN {origin(c)} || '/' || substr({c}, length({origin(c)}) + 1) ELSE {c} END"


def is_priority(u: str) -> str:
    return f"regexp_matches(lower({path(u)}), {lit(C.PRIORITY_PATH)})"


def decode(t: str) -> str:
    for name, char in markup.ENTITIES:
        t = f"replace({t}, {lit(name)}, {lit(char)})"
    return t


def collapse(t: str) -> str:
    return f"trim(regexp_replace({t}, {lit(markup.BLANKS)}, ' ', 'g'))"


def plain(fragment: str) -> str:
    inner = collapse(decode(f"regexp_replace({fragment}, {lit(markup.TAG)}, ' ', 'g')"))
    return f"nullif({inner}, '')"


def page_text(h: str) -> str:
    kept = f"regexp_replace({h}, {lit(markup.BOILERPLATE)}, ' ', 'g')"
    body = f"regexp_replace({kept}, {lit(markup.CONTENT)}, '\\1\\2')"
    title = f"regexp_extract({h}, {lit(markup.TITLE)}, 1)"
    about = (
        f"regexp_extract(regexp_extract({h}, {lit(markup.DESCRIPTION_TAG)}, 0), {lit(markup.CONTENT_VALUE)}, 1)"
    )
    joined = f"concat_ws(' ', {plain(title)}, {plain(about)}, {plain(body)})"
    quotes = "chr(10) || '\"' || chr(39)"
    return f"nullif(translate({joined}, {quotes}, '   '), '')"


def resolve(base: str, h: str) -> str:
    """Relative links of the stored pages; none of them has dot segments."""
    folder = f"coalesce(nullif(regexp_extract({path(base)}, '^(.*/)', 1), ''), '/')"
    return (
        f"CASE WHEN {h} = '' THEN {base} "
        f"WHEN regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {h} "
        f"WHEN starts_with({h}, '//') THEN {scheme(base)} || ':' || {h} "
        f"WHEN starts_with({h}, '#') THEN regexp_extract({base}, '^[^#]*', 0) || {h} "
        f"WHEN starts_with({h}, '?') THEN {origin(base)} || {path(base)} || {h} "
        f"WHEN starts_with({h}, '/') THEN {origin(base)} || {h} "
        f"ELSE {origin(base)} || {folder} || {h} END"
    )


def anchors(html: str) -> str:
    """List of raw href values in page order."""
    quotes = lit(r"""^["']|["']$""")
    return (
        f"list_transform(regexp_extract_all({html}, {lit(markup.ANCHOR)}, 0), lambda tag: trim("
        + decode(f"regexp_replace(regexp_extract(tag, {lit(markup.HREF)}, 1), {quotes}, '', 'g')")
        + "))"
    )


def clean_text(t: str) -> str:
    return f"trim(regexp_replace(translate({t}, chr(160), ' '), {lit(markup.BLANKS)}, ' ', 'g'))"


def sanitize_text(t: str) -> str:
    return f"trim(regexp_replace(lower({t}), {lit(text.NOT_WORD)}, ' ', 'g'))"


def gated(t: str) -> str:
    c = clean_text(t)
    return (
        f"CASE WHEN length({c}) <= {C.SITE_TEXT_MIN} THEN NULL "
        f"WHEN length({c}) >= {C.SITE_TEXT_LONG} THEN substring({c}, 1, {C.SITE_TEXT_CUT}) ELSE {c} END"
    )


def summary_input(t: str) -> str:
    return f"CASE WHEN length({t}) > {C.SUMMARY_LONG} THEN substring({t}, 1, {C.SUMMARY_CUT}) ELSE {t} END"


def matches(t: str, pattern: str, group: int = 0) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({t}, {lit(pattern)}, {group})))"


def joined_matches(t: str, pattern: str, group: int = 0) -> str:
    return f"coalesce(array_to_string({matches(t, pattern, group)}, '|'), '')"


def sentences(t: str) -> str:
    marked = f"regexp_replace({t}, {lit(text.SENTENCE_END)}, '\\1' || chr(10), 'g')"
    return (
        f"list_filter(list_transform(regexp_split_to_array({marked}, {lit(text.LINE_ENDS)}), "
        f"lambda s: trim(s)), lambda s: s <> '')"
    )


def chunks(s: str) -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array({s}, {lit(text.CHUNK_BREAK)}), "
        f"lambda c: trim(c)), lambda c: c <> '')"
    )


def chunk_words(c: str) -> str:
    return f"regexp_split_to_array({c}, {lit(text.SPACES)})"


def proper_spans(s: str) -> str:
    rest = f"regexp_replace({s}, {lit(text.FIRST_WORD)}, '')"
    return f"regexp_extract_all({rest}, {lit(text.PROPER_SPAN)}, 1)"
