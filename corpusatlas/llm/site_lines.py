"""Lines that most pages of a site share, dropped by their frequency relative to the site.

For every site the pages that hold a line are divided by all its pages; lines above the
ratio are boilerplate. Only hashes are shuffled, one for each page and distinct line,
counted before the shuffle. A site has at most (its lines / its pages / ratio) such lines,
however many pages it has, so the list that goes back to its pages is bounded.

Defined cases: lines are compared without the white space around them; blank lines are
never counted or dropped; a null or empty text stays; pages without a site are not
compared; every row is a page, also if it repeats another; an empty table gives an empty
result; all columns of the input stay. The two counts come last, under the first names of
`_lines`, `__lines`, … and `_dropped`, `__dropped`, … that the input does not have. A very long
text is one row, as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusatlas.operators.skew import salted_join
from corpusatlas.session import materialise

RATIO = 0.1
#: A line must be on this many pages at least, so that small sites keep their lines.
LEAST_PAGES = 4
#: Up to this number of lines, the lists of all sites travel to the pages by broadcast; more are joined by site.
BROADCAST_LINES = 500_000


def _key(line: Column) -> Column:
    """Hash of a line without outer white space; null for a blank one."""
    bare = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(
    pages: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """`(site, lines)`: the hashes of the lines to drop, one row for each site that has any."""
    known = pages.where(F.col(site).isNotNull()).select(F.col(site).alias("site"), F.col(text).alias("text"))
    totals = known.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    keys = F.array_distinct(F.transform(F.split("text", "\n"), _key))
    counts = (
        known.select("site", F.explode(keys).alias("line")).where("line is not null")
        .groupBy("site", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    )
    return (
        counts.join(totals, "site").where(F.col("n") > F.lit(ratio) * F.col("pages"))
        .groupBy("site").agg(F.collect_set("line").alias("lines"))
    )


def free_name(name: str, taken: list[str]) -> str:
    """`name` with as many underscores before it as make it new; case does not tell names apart."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def count_names(columns: list[str]) -> tuple[str, str]:
    """What the counts of lines and of dropped lines are called beside these columns."""
    return free_name("_lines", columns), free_name("_dropped", columns)


def without_boilerplate(
    pages: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """All rows and columns of `pages`, with `text` less its boilerplate, then the two counts."""
    names = pages.columns
    key, bad, kept = (free_name(n, names) for n in ("_site", "_bad", "_kept"))
    found = materialise(
        boilerplate(pages, site, text, ratio, least_pages).select(F.col("site").alias(key), F.col("lines").alias(bad)),
        "site-lines",
    )
    # A site's list is bounded by the ratio; the number of sites is not, so all lists are measured.
    if (found.select(F.sum(F.size(bad))).first()[0] or 0) <= BROADCAST_LINES:
        joined = pages.join(F.broadcast(found), F.col(site) == F.col(key), "left")
    else:
        # Pages of a large site are dealt out by their text; pages without a site meet nothing.
        keyed = pages.withColumn(key, F.col(site))
        joined = salted_join(keyed, found, [key], "left", spread_by=[text])
    lines = F.split(F.col(text), "\n")
    left = F.filter(lines, lambda line: ~F.coalesce(F.array_contains(bad, _key(line)), F.lit(False)))
    new = joined.select(*(F.col(f"`{c}`") for c in names), bad, F.when(F.col(bad).isNotNull(), left).alias(kept))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("bigint")
    lines_name, dropped_name = count_names(names)
    return new.select(
        *(
            F.when(F.col(kept).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text)).alias(c)
            if c == text else F.col(f"`{c}`")
            for c in names
        ),
        n_lines.alias(lines_name),
        F.when(F.col(kept).isNotNull(), n_lines - F.size(kept)).otherwise(0).cast("bigint").alias(dropped_name),
    )


ORACLE_SQL = rf"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents
), placed AS (
  SELECT r, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
  FROM numbered WHERE text IS NOT NULL
), bare AS (
  SELECT *, regexp_replace(line, '^[ 	-]+|[ 	-]+$', '', 'g') AS b FROM placed
), counts AS (
  SELECT source, b, count(DISTINCT r) AS n FROM bare WHERE b <> '' AND source IS NOT NULL GROUP BY source, b
), totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source
), bad AS (
  SELECT source, b FROM counts JOIN totals USING (source) WHERE n >= {LEAST_PAGES} AND n > {RATIO} * pages
), cleaned AS (
  SELECT r, string_agg(line, chr(10) ORDER BY i) FILTER (bad.b IS NULL) AS text, count(bad.b) AS dropped
  FROM bare LEFT JOIN bad ON bad.source = bare.source AND bad.b = bare.b GROUP BY r
)
SELECT doc_id, source, CASE WHEN n.text IS NULL THEN 0 ELSE len(string_split(n.text, chr(10))) END AS n_lines,
  coalesce(dropped, 0) AS n_dropped, CASE WHEN n.text IS NULL THEN NULL ELSE coalesce(c.text, '') END AS text
FROM numbered n LEFT JOIN cleaned c USING (r)
"""
