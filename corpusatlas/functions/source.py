"""Imports, declarations and decorators of TypeScript text, by regular expression.

Declarations are read at the left margin; bodies are shifted left by the indent of
their first member, so members are read at the margin too. Types are the declared
ones. Repeats over groups are possessive, which keeps the matcher's stack flat.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusatlas.functions.binding import bind

PARAMETER = "struct<name:string,type:string>"
DECORATOR = "struct<name:string,arguments:array<string>>"
METHOD = (
    f"struct<name:string,parameters:array<{PARAMETER}>,returnType:string,"
    f"decorators:array<{DECORATOR}>>"
)
FUNCTIONS = f"array<struct<name:string,parameters:array<{PARAMETER}>,returnType:string>>"
CLASSES = f"array<struct<name:string,decorators:array<{DECORATOR}>,methods:array<{METHOD}>>>"
INTERFACES = f"array<struct<name:string,properties:array<{PARAMETER}>>>"

_BLOCK_COMMENT = r"(?ms)^[ \t]*/\*.*?\*/"

_IMPORT = (
    r"(?m)^[ \t]*import(?![\w$])[ \t\r\n]*"
    r"(?:[^'\";()=]*?[} \t\r\n]from[ \t\r\n]*)?"
    r"['\"]([^'\"\n]+)['\"]"
)

_QUOTED = r"'(?:[^'\\\n]++|\\.)*+'|\"(?:[^\"\\\n]++|\\.)*+\"|`(?:[^`\\]++|\\.)*+`"


def _balanced(depth: int) -> str:
    """Text whose brackets match, nested up to `depth` levels."""
    plain = r"[^(){}\[\]'\"`]++"
    if depth == 0:
        return f"(?:{plain}|{_QUOTED})*+"
    return rf"(?:{plain}|{_QUOTED}|[({{\[]{_balanced(depth - 1)}[)}}\]])*+"


def _angled(depth: int) -> str:
    """A type argument list in angle brackets, nested up to `depth` levels."""
    inner = "" if depth == 0 else "|" + _angled(depth - 1)
    return rf"<(?:[^<>=]++|=>|={inner})*+>"


#: Brackets and type arguments may nest this deep; the pattern grows by one level for each.
BRACKET_LEVELS, ANGLE_LEVELS = 96, 24
_IN = _balanced(BRACKET_LEVELS)
_ANGLED = _angled(ANGLE_LEVELS)
_GENERIC = rf"(?:{_ANGLED})?"
_NAME = r"[A-Za-z_$#][\w$]*+"

# One item of a list separated by commas outside brackets and quotes.
_ITEM = (
    rf"(?:[^,(){{}}\[\]<>='\"`]++|=>|=|{_QUOTED}|[({{\[]{_IN}[)}}\]]|{_ANGLED}|[<>])++"
)

_RETURN = rf"(?:[ \t]*:[ \t]*((?:\{{{_IN}\}}|[^{{}};\n])+?))?[ \t]*"

_FUNCTION = (
    rf"(?m)^(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:async[ \t]+)?"
    rf"function[ \t]*\*?[ \t]*({_NAME})?[ \t]*{_GENERIC}[ \t]*\(({_IN})\){_RETURN}(?:\{{|;|$)"
)

# Whole lines of decorators above a declaration, continued by indented lines and closers.
_DECORATOR_LINES = (
    r"(?:^(?!@[\w$.]++(?:\([^()\n]*+\))?[ \t]++[\w$])@[^\n]*+\n"
    r"(?:[ \t)}\]][^\n]*+\n|\n)*+)*+"
)
_INLINE_DECORATORS = r"(?:@[\w$.]++(?:\([^()\n]*+\))?[ \t]++)*+"
_DECORATOR_BLOCK = r"(?m)^@[^\n]*+(?:\n(?!@)[^\n]*+)*+"
_ARGUMENTS = r"(?s)^@[\w$.]++\s*+\((.*)\)[^)]*$"

_BODY = r"(?:\{([^{}\n]*+)\}|\{[^\n]*+\n(.*?)^\})"

_CLASS = (
    rf"(?ms)({_DECORATOR_LINES})^({_INLINE_DECORATORS})"
    rf"(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:abstract[ \t]+)?"
    rf"class(?:[ \t]+(?!extends\b|implements\b)({_NAME}))?([^{{;]*?){_BODY}"
)

_INTERFACE = (
    rf"(?ms)^(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?"
    rf"interface[ \t]+({_NAME})([^{{;]*?){_BODY}"
)

# Words that open statements or are not counted as methods.
_NOT_METHODS = "constructor|if|for|while|switch|catch|return|function|new|throw|super"

_METHOD = (
    rf"(?m)({_DECORATOR_LINES})^({_INLINE_DECORATORS})"
    r"(?:(?:public|private|protected|static|async|abstract|override)[ \t]+)*+"
    rf"(?:\*[ \t]*)?(?!(?:{_NOT_METHODS})[ \t]*+(?:\(|[A-Za-z_$])|(?:get|set)[ \t]++[A-Za-z_$#\[])({_NAME})\??[ \t]*{_GENERIC}[ \t]*"
    rf"\(({_IN})\){_RETURN}(?:\{{|;|$)"
)

_PROPERTY = (
    r"(?m)(?:^|;|,)[ \t]*(?:readonly[ \t]+)?"
    r"([A-Za-z_$][\w$]*+|'[^'\n]+'|\"[^\"\n]+\")\??[ \t]*:[ \t]*"
    rf"((?:=>|\{{{_IN}\}}|\({_IN}\)|[^;,\n(){{}}<]|{_ANGLED})+)"
)


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _items(text: Column) -> Column:
    pieces = F.transform(_matches(text, _ITEM), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(pieces, lambda s: s != "")


def _empty_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def without_block_comments(text: Column) -> Column:
    """Drop block comments that open a line, keeping quoted glob patterns intact."""
    return F.when(
        text.contains("/*"), F.regexp_replace(text, _BLOCK_COMMENT, "")
    ).otherwise(text)


def import_specifiers(text: Column) -> Column:
    """Module names of static imports, in source order."""
    return F.regexp_extract_all(without_block_comments(text), F.lit(_IMPORT), F.lit(1))


_PARAM_HEAD = (
    rf"^(?:@[\w$.]++(?:\({_IN}\))?\s*+)*+"
    r"(?:(?:public|private|protected|readonly|override)\s++)*+(?:\.\.\.)?"
)


def parameters(text: Column) -> Column:
    """Names and declared types of a parameter list."""
    bare = F.transform(_items(text), lambda s: F.regexp_replace(s, _PARAM_HEAD, ""))
    return F.transform(
        bare,
        lambda s: F.struct(
            F.regexp_extract(s, rf"^({_NAME}|\{{{_IN}\}}|\[{_IN}\])", 1).alias("name"),
            _empty_to_null(
                F.regexp_extract(
                    s,
                    rf"(?s)^(?:{_NAME}|\{{{_IN}\}}|\[{_IN}\])\??\s*+:((?:=>|[^=])+)",
                    1,
                )
            ).alias("type"),
        ),
    )


def functions(text: Column) -> Column:
    """Functions declared at the left margin."""
    return F.transform(
        _matches(without_block_comments(text), _FUNCTION),
        lambda m: F.struct(
            _empty_to_null(F.regexp_extract(m, _FUNCTION, 1)).alias("name"),
            parameters(F.regexp_extract(m, _FUNCTION, 2)).alias("parameters"),
            _empty_to_null(F.regexp_extract(m, _FUNCTION, 3)).alias("returnType"),
        ),
    ).cast(FUNCTIONS)


def decorators(text: Column) -> Column:
    """Names and argument texts of the decorators in `text`, one per line start."""
    return F.transform(
        _matches(text, _DECORATOR_BLOCK),
        lambda block: F.struct(
            F.regexp_extract(block, r"^@([\w$.]++)", 1).alias("name"),
            _items(F.regexp_extract(block, _ARGUMENTS, 1)).alias("arguments"),
        ),
    )


def _decorator_text(match: Column, pattern: str) -> Column:
    """Decorator lines above a declaration, then those on its own line, a line each."""
    inline = F.regexp_replace(F.regexp_extract(match, pattern, 2), r"[ \t]+@", "\n@")
    return F.concat(F.regexp_extract(match, pattern, 1), inline)


def _members(body: Column) -> Column:
    """The body shifted left by the indent of its first line with text."""
    return bind(
        F.regexp_extract(body, r"(?m)^([ \t]++)\S", 1),
        lambda indent: F.when(
            F.length(indent) > 0, F.regexp_replace(body, F.concat(F.lit("(?m)^"), indent), F.lit(""))
        ).otherwise(body),
    )


def _methods(body: Column) -> Column:
    return F.transform(
        _matches(_members(body), _METHOD),
        lambda m: F.struct(
            F.regexp_extract(m, _METHOD, 3).alias("name"),
            parameters(F.regexp_extract(m, _METHOD, 4)).alias("parameters"),
            _empty_to_null(F.regexp_extract(m, _METHOD, 5)).alias("returnType"),
            decorators(_decorator_text(m, _METHOD)).alias("decorators"),
        ),
    )


def classes(text: Column) -> Column:
    """Classes at the left margin with decorators and methods."""
    return F.transform(
        _matches(without_block_comments(text), _CLASS),
        lambda m: F.struct(
            _empty_to_null(F.regexp_extract(m, _CLASS, 3)).alias("name"),
            decorators(_decorator_text(m, _CLASS)).alias("decorators"),
            _methods(
                F.concat(F.regexp_extract(m, _CLASS, 5), F.regexp_extract(m, _CLASS, 6))
            ).alias("methods"),
        ),
    ).cast(CLASSES)


def interfaces(text: Column) -> Column:
    """Interfaces at the left margin with their properties."""
    def body(m: Column) -> Column:
        return F.concat(F.regexp_extract(m, _INTERFACE, 3), F.regexp_extract(m, _INTERFACE, 4))

    return F.transform(
        _matches(without_block_comments(text), _INTERFACE),
        lambda m: F.struct(
            F.regexp_extract(m, _INTERFACE, 1).alias("name"),
            bind(
                _members(body(m)),
                lambda inner: F.transform(
                    _matches(inner, _PROPERTY),
                    lambda p: F.struct(
                        F.regexp_replace(
                            F.regexp_extract(p, _PROPERTY, 1), r"^['\"]|['\"]$", ""
                        ).alias("name"),
                        F.trim(F.regexp_extract(p, _PROPERTY, 2)).alias("type"),
                    ),
                ),
            ).alias("properties"),
        ),
    ).cast(INTERFACES)


def decorator_assets(text: Column) -> Column:
    """Template and style paths named by class decorators, template first."""
    found = _matches(without_block_comments(text), _CLASS)
    blocks = F.transform(
        found, lambda m: _matches(_decorator_text(m, _CLASS), _DECORATOR_BLOCK)
    )
    return F.flatten(F.transform(F.flatten(blocks), _assets_of))


def _assets_of(decorator: Column) -> Column:
    template = F.regexp_extract(decorator, r"templateUrl: '(.+)',", 1)
    styles = F.transform(
        F.split(F.regexp_extract(decorator, r"styleUrls: \[(.+)\],", 1), ","),
        lambda s: F.regexp_replace(F.trim(s), r"['\"]", ""),
    )
    return F.filter(F.concat(F.array(template), styles), lambda s: s != "")
