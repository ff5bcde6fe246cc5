"""Secrets in whole texts, found over a trigram inverted index, with built-in functions only.

From the syntax tree of every rule's pattern a Boolean query over trigrams is derived: the
strings that a match must hold, as alternatives of trigrams that must all occur. The index
holds one posting for each text and trigram of these queries, without regard to case.
Intersecting postings leaves the candidates of every rule; only their texts are verified
with the pattern itself. A rule whose pattern holds no mandatory trigram scans every text.

Patterns are written so that Python, Java and RE2 read them alike.

Defined cases: a null text is an empty one; rows with a null id cannot be named by a posting
and are scanned in full; rows that repeat an id share their postings and are each verified;
an empty table gives an empty result; other columns are not touched. Matches of one rule do
not overlap, those of different rules may.
"""

from __future__ import annotations

import re._constants as kinds
import re._parser as syntax
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusatlas.session import materialise

#: Alternatives that a query may have before it is weakened (a weaker query stays right).
MOST_ALTERNATIVES = 96


@dataclass(frozen=True)
class Rule:
    """A kind of secret; `group` is the part that needs `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules, then further kinds in the order of their report.
RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs are greedy, so those that are long enough are the matches of the bounded form.
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._%+-]+:[^\x00-\x20/@:]+@[A-Za-z0-9.-]+"),
)
BASE = ("assign", "access", "hex")

#: A query is a set of alternatives; each is a set of trigrams that must all occur.
Query = frozenset
_ANY: Query = frozenset([frozenset()])


def _of_strings(strings: frozenset[str]) -> Query:
    return _either([frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings])


def _either(queries: Sequence[Query]) -> Query:
    """Any of the alternatives; one that asks for more than another adds nothing."""
    union = frozenset().union(*queries)
    least = frozenset(a for a in union if not any(b < a for b in union))
    return _ANY if len(least) > MOST_ALTERNATIVES else least


def _both(a: Query, b: Query) -> Query:
    if a == _ANY or b == _ANY or len(a) * len(b) > MOST_ALTERNATIVES:
        return b if a == _ANY else a
    return frozenset(x | y for x in a for y in b)


def _derive(tree) -> tuple[frozenset[str] | None, Query]:
    """All strings that the tree matches, if they are few, and the query that they imply."""
    strings, query, exact = frozenset([""]), _ANY, True
    for kind, value in tree:
        own, needed = _derive_one(kind, value)
        if own is not None and len(own) * len(strings) <= MOST_ALTERNATIVES:
            strings = frozenset(a + b for a in strings for b in own)
            continue
        exact = False
        query = _both(query, _of_strings(strings))
        if own is None:
            query, strings = _both(query, needed), frozenset([""])
        else:
            strings = own
    return (strings if exact else None), _both(query, _of_strings(strings))


def _derive_one(kind, value) -> tuple[frozenset[str] | None, Query]:
    if kind is kinds.LITERAL:
        return frozenset([chr(value).lower()]), _ANY
    if kind is kinds.IN and len(value) <= 8 and all(k is kinds.LITERAL for k, _ in value):
        return frozenset(chr(c).lower() for _, c in value), _ANY
    if kind is kinds.AT:
        return frozenset([""]), _ANY
    if kind is kinds.SUBPATTERN:
        return _derive(value[3])
    if kind is kinds.BRANCH:
        parts = [_derive(branch) for branch in value[1]]
        query = _either([q for _, q in parts])
        strings = None if any(s is None for s, _ in parts) else frozenset().union(*(s for s, _ in parts))
        return strings, query
    if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
        least, most, body = value
        strings, query = _derive(body)
        if most == 1 and strings is not None:
            return (strings if least else strings | {""}), _ANY
        if least == 0:
            return None, _ANY
        return None, query
    return None, _ANY


def trigram_query(pattern: str) -> Query:
    """Alternatives of mandatory trigrams, in lower case; one empty alternative if there are none."""
    return _derive(syntax.parse(pattern))[1]


def index(docs: DataFrame, trigrams: Sequence[str], text: str = "text") -> DataFrame:
    """Postings `(doc_id, trigram)` of all texts for the given trigrams."""
    low = F.lower(F.col(text))
    found = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams)))
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(found).alias("trigram"))


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """`(doc_id, kinds)`: the rules whose query the postings of a text satisfy."""
    clauses = [
        (kind, number, len(clause), trigram)
        for kind, query in queries.items()
        for number, clause in enumerate(sorted(query, key=sorted))
        for trigram in sorted(clause)
    ]
    # One row for each trigram of a query: as large as the rules, not as the corpus.
    table = postings.sparkSession.range(1).select(
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(k).alias("kind"), F.lit(n).alias("clause"), F.lit(s).alias("size"), F.lit(t).alias("trigram"))
                    for k, n, s, t in clauses
                )
            )
        )
    )
    return (
        postings.join(F.broadcast(table), "trigram")
        .groupBy("doc_id", "kind", "clause", "size")
        .agg(F.collect_set("trigram").alias("found"))
        .where(F.size("found") == F.col("size"))
        .groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))
    )


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Matches of one rule as structs, in code points.

    The gaps between matches and the matches themselves add up to the text, which gives the
    places that the built-in functions do not return.
    """
    pattern = F.lit(rule.pattern)
    pairs = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
    )
    kind = "array<struct<start:int,rank:int,end:int,kind:string>>"
    found = F.aggregate(
        F.filter(pairs, lambda p: p["match"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["gap"]) + F.length(p["match"])).alias("at"),
            F.when(
                F.length(p["value"]) >= rule.least,
                F.concat(
                    s["spans"],
                    F.array(
                        F.struct(
                            (s["at"] + F.length(p["gap"])).alias("start"),
                            F.lit(order).alias("rank"),
                            (s["at"] + F.length(p["gap"]) + F.length(p["match"])).alias("end"),
                            F.lit(rule.kind).alias("kind"),
                        )
                    ),
                ),
            ).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return F.when(F.regexp_like(text, pattern), found).otherwise(F.array().cast(kind))


def found_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """`(doc_id, spans)` for every row: all spans by start, then by the order of the rules."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q != _ANY}
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if indexed:
        trigrams = sorted({t for q in indexed.values() for clause in q for t in clause})
        # The index is a table of its own: other rules over the same trigrams need no text.
        postings = materialise(index(texts, trigrams), "postings")
        named = candidates(postings, indexed)
        texts = texts.join(named, "doc_id", "left")
        wanted = lambda r: F.col("doc_id").isNull() | F.coalesce(F.array_contains("kinds", r.kind), F.lit(False))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    parts = [
        F.when(wanted(r), _spans(F.col("text"), r, i)).otherwise(empty) if r.kind in indexed else _spans(F.col("text"), r, i)
        for i, r in enumerate(rules)
    ]
    return texts.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    )


def oracle(rules: Sequence[Rule] = RULES) -> str:
    """The result of `op1` in SQL, from full scans with every pattern."""
    def one(number: int, rule: Rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        return f"""
        SELECT doc_id, list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
            'start': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
            'rank': {number},
            'end': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(m[1:i], lambda x: length(x))),
            'kind': '{rule.kind}', 'size': length(v[i])}}), lambda s: s.size >= {rule.least}) AS spans
        FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS m,
                     regexp_extract_all(t, '{pattern}', {rule.group}) AS v FROM texts)"""

    parts = "\n        UNION ALL".join(one(i, r) for i, r in enumerate(rules))
    name = "s.kind || ':' || CAST(CAST(s.start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s.\"end\" AS BIGINT) AS VARCHAR)"
    base = ", ".join(f"'{k}'" for k in BASE)
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    parts AS ({parts}),
    spans AS (SELECT doc_id, unnest(spans) AS s FROM parts),
    summed AS (
        SELECT doc_id, count(*) FILTER (s.kind = 'assign') AS n_assign, count(*) FILTER (s.kind = 'access') AS n_access,
               count(*) FILTER (s.kind = 'hex') AS n_hex,
               string_agg({name}, ',' ORDER BY s.start, s.rank) FILTER (s.kind IN ({base})) AS base,
               string_agg({name}, ',' ORDER BY s.start, s.rank) AS spans
        FROM spans GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents d LEFT JOIN summed USING (doc_id)"""
