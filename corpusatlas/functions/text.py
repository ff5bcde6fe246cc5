"""Tokens, size limits, chunks and template slots on columns.

A token is a maximal run of characters other than space, tab and line ends, so
counts of pieces joined by white space add up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusatlas.functions.binding import bind

# Size limits, chunk length and the text for missing context.
TOKEN_LIMIT = 120_000
CUT_CHARS = 100_000
CHUNK_TOKENS = 2_500
SMALL_TIER_BELOW = 2_000
MIDDLE_TIER_BELOW = 26_000
NOT_APPLICABLE = "Not Applicable Here"

# One token with the white space after it; the first also takes what precedes it.
_TOKEN_WITH_SPACE = r"(?:^[ \n\t\r]+)?[^ \n\t\r]+[ \n\t\r]*"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \n\t\r]+")), F.lit(0)).cast("bigint")


def size_guard(
    text: Column, tokens: Column, limit: int = TOKEN_LIMIT, cut: int = CUT_CHARS
) -> Column:
    """The whole text up to `limit` tokens; beyond it the first `cut` characters."""
    return F.when(tokens > limit, F.substring(text, 1, cut)).otherwise(text)


def size_tier(
    tokens: Column, small: int = SMALL_TIER_BELOW, middle: int = MIDDLE_TIER_BELOW
) -> Column:
    return (
        F.when(tokens < small, "small").when(tokens < middle, "middle").otherwise("large")
    )


def escape_braces(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def or_sentinel(text: Column) -> Column:
    """The text, or the fixed words when it is missing or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(NOT_APPLICABLE))


def fill(template: str, **slots: Column) -> Column:
    """Put columns into the `{name}` places of a template in one `concat`.

    Slot values are never scanned for places themselves.
    """
    pieces: list[Column] = []
    rest = template
    while rest:
        text, opening, tail = rest.partition("{")
        if text:
            pieces.append(F.lit(text))
        if not opening:
            break
        name, _, rest = tail.partition("}")
        pieces.append(slots[name])
    return F.concat(*pieces)


def literal_tokens(template: str, slots: Sequence[str]) -> int:
    """Tokens of a template without its slots; slots must stand between white space."""
    for name in slots:
        template = template.replace("{" + name + "}", " ")
    return len(template.split())


def chunks(text: Column, size: int = CHUNK_TOKENS, overlap: int = 0) -> Column:
    """Consecutive pieces of `size` tokens, as an array of strings.

    Without overlap the pieces add up to the text, white space included. Text
    with no token is one piece; empty text gives none.
    """
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("need size >= 1 and 0 <= overlap < size")
    pieces = bind(
        F.regexp_extract_all(text, F.lit(_TOKEN_WITH_SPACE), F.lit(0)),
        lambda tokens: F.when(
            F.size(tokens) > 0,
            F.transform(
                F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(size - overlap)),
                lambda start: F.array_join(F.slice(tokens, start + 1, F.lit(size)), ""),
            ),
        ).otherwise(F.array(text)),
    )
    return F.when(text == "", F.array().cast("array<string>")).otherwise(pieces)
