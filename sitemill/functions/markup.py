"""HTML to text and anchors as column expressions.

The page text is one pass per concern over the HTML string, all inside code generation; no parser
library runs per row.  Patterns avoid look-around and nested repetition, so they stay linear.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitemill.functions.urls import resolve

BOILERPLATE = (
    r"(?is)<(?:!--.*?-->|script\b.*?</script>|style\b.*?</style>|nav\b.*?</nav>"
    r'|footer\b.*?</footer>|div class="ad">.*?</div>)'
)
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
DESCRIPTION_TAG = r'(?is)<meta\s[^>]*name\s*=\s*"description"[^>]*>'
CONTENT_VALUE = r'(?is)content\s*=\s*"([^"]*)"'
# The whole page, with the article as group 1 or else everything from the body on as group 2.
CONTENT = r"(?is)^.*?<article\b[^>]*>(.*?)</article>.*$|^.*?<body\b[^>]*>(.*)$|^.*$"
TAG = r"(?s)<[^>]*>"
# Runs of blanks that are not already one blank.
BLANKS = r"[ \t\r\n\f\x0B]{2,}|[\t\r\n\f\x0B]"
ANCHOR = r"(?is)<a(?:\s[^>]*)?>"
HREF = r"""(?is)\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
# Named characters, decoded in this order; the ampersand comes last so nothing is decoded twice.
ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
)


def decode_entities(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def _plain(fragment: Column) -> Column:
    """Visible text of a fragment, empty when there is none."""
    return collapse(decode_entities(F.regexp_replace(fragment, TAG, " ")))


def page_title(html: Column) -> Column:
    return _plain(F.regexp_extract(html, TITLE, 1))


def page_description(html: Column) -> Column:
    return _plain(F.regexp_extract(F.regexp_extract(html, DESCRIPTION_TAG, 0), CONTENT_VALUE, 1))


def page_body(html: Column) -> Column:
    return _plain(F.regexp_replace(F.regexp_replace(html, BOILERPLATE, " "), CONTENT, "$1$2"))


def page_text(html: Column) -> Column:
    """Title, description and body text joined by a blank; quotes and line ends blanked; null if empty."""
    parts = F.filter(F.array(page_title(html), page_description(html), page_body(html)), lambda part: part != "")
    return F.nullif(F.translate(F.array_join(parts, " "), "\n\"'", "   "), F.lit(""))


def one_line(text: Column) -> Column:
    """Second pass over the joined text of a crawled site: line ends to blanks, all else as it is."""
    return F.translate(text, "\n", " ")


def page_links(url: Column, html: Column) -> Column:
    """Every anchor of the page in page order, resolved against the page address."""
    tags = F.regexp_extract_all(html, F.lit(ANCHOR), 0)
    return F.transform(
        tags,
        lambda tag: resolve(
            url, F.trim(decode_entities(F.regexp_replace(F.regexp_extract(tag, HREF, 1), r"""^["']|["']$""", "")))
        ),
    )
