"""Tags and attributes of HTML text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusatlas.functions.binding import bind

# Comments, and elements whose content is text and not markup.
_OPAQUE = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|(<(script|style|title|textarea)\b[^>]*+>).*?(?:</\2[ \t\r\n]*+>|\z)"
)
_OPEN_TAG = r"<([A-Za-z][^ \t\r\n/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
_ATTRIBUTE = (
    r"([^ \t\r\n\"'>/=]++)"
    r"(?:[ \t\r\n]*+=[ \t\r\n]*+(?:\"([^\"]*+)\"|'([^']*+)'|([^ \t\r\n\"'=<>`]++)))?"
)
# The character references decoded in attribute values, `&` last.
_REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def _open_tags(html: Column) -> Column:
    markup = F.regexp_replace(html, _OPAQUE, "$1")
    return F.regexp_extract_all(markup, F.lit(_OPEN_TAG), F.lit(0))


def _tag_name(open_tag: Column) -> Column:
    return F.lower(F.regexp_extract(open_tag, _OPEN_TAG, 1))


def _decoded(value: Column) -> Column:
    for reference, character in _REFERENCES:
        value = F.replace(value, F.lit(reference), F.lit(character))
    return value


def _attribute(text: Column) -> Column:
    value = F.concat(*(F.regexp_extract(text, _ATTRIBUTE, n) for n in (2, 3, 4)))
    return F.struct(
        F.lower(F.regexp_extract(text, _ATTRIBUTE, 1)).alias("name"),
        _decoded(value).alias("value"),
    )


def _first_per_name(attributes: Column) -> Column:
    return bind(
        attributes,
        lambda found: bind(
            F.transform(found, lambda a: a["name"]),
            lambda names: F.filter(
                found, lambda a, i: F.array_position(names, a["name"]) == i + 1
            ),
        ),
    )


def tag_names(html: Column) -> Column:
    """Names of all opened elements in document order."""
    return F.transform(_open_tags(html), _tag_name)


def tag_counts(html: Column) -> Column:
    """`array<struct<tag, n>>` counted inside the row, so nothing is shuffled."""
    return bind(
        tag_names(html),
        lambda names: F.transform(
            F.array_distinct(names),
            lambda tag: F.struct(
                tag.alias("tag"),
                F.size(F.filter(names, lambda name: name == tag)).cast("bigint").alias("n"),
            ),
        ),
    )


def tags(html: Column) -> Column:
    """`array<struct<tag, attrs map>>`; the first of equal attribute names wins."""
    return F.transform(
        _open_tags(html),
        lambda t: F.struct(
            _tag_name(t).alias("tag"),
            F.map_from_entries(
                _first_per_name(
                    F.transform(
                        F.regexp_extract_all(
                            F.regexp_extract(t, _OPEN_TAG, 2), F.lit(_ATTRIBUTE), F.lit(0)
                        ),
                        _attribute,
                    )
                )
            ).alias("attrs"),
        ),
    )
