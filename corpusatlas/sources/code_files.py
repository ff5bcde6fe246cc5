"""A table of source files derived from `part`, identical in Spark and plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusatlas.functions import paths
from corpusatlas.operators.imports import AliasRule

ALIASES = [AliasRule("@lib/*", ("src/*",))]

# Repository, path and text of file k; `m` is k % 10. Both engines read this text.
CODE_FILES_SQL = """
WITH keyed AS (
  SELECT k, m, up, chr(10) AS nl FROM (
    SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_partkey % 10 AS BIGINT) AS m,
           CASE WHEN p_partkey % 10 = 5 THEN '../../' ELSE '../' END AS up
    FROM {part}
  ) numbered
), linked AS (
  SELECT k, m, nl,
    up || 'pkg' || CAST((k + 4) % 7 AS VARCHAR(20)) || '/mod' || CAST(k - 3 AS VARCHAR(20)) AS ref_a,
    '@lib/pkg' || CAST((k + 1) % 7 AS VARCHAR(20)) || '/mod' || CAST(k - 6 AS VARCHAR(20)) AS ref_b,
    up || 'pkg' || CAST((k + 5) % 7 AS VARCHAR(20)) || '/mod' || CAST(k - 30 AS VARCHAR(20)) AS ref_c,
    up || 'pkg' || CAST((k + 6) % 7 AS VARCHAR(20)) || '/mod' || CAST(k + 6 AS VARCHAR(20)) AS ref_t,
    up || 'pkg' || CAST((k + 9) % 7 AS VARCHAR(20)) || '/mod' || CAST(k + 9 AS VARCHAR(20)) AS ref_s
  FROM keyed
)
SELECT k,
  '/r/app' || CAST(k % 3 AS VARCHAR(20)) AS repo,
  'src/pkg' || CAST(k % 7 AS VARCHAR(20)) || '/mod' || CAST(k AS VARCHAR(20)) ||
  CASE WHEN m <= 4 THEN '.ts' WHEN m = 5 THEN '/index.ts' WHEN m = 6 THEN '.html'
       WHEN m = 7 THEN '.json' WHEN m = 8 THEN '.yaml' ELSE '.scss' END AS path,
  CASE
    WHEN m <= 5 THEN
      'import {{ a }} from ''' || ref_a || ''';' || nl ||
      'import {{ b }} from ''' || ref_b || ''';' || nl ||
      'import {{ c }} from ''' || ref_c || ''';' || nl ||
      'import * as _ from ''lodash'';' || nl ||
      CASE
        WHEN m = 0 THEN
          '@Component({{' || nl ||
          '  templateUrl: ''' || ref_t || '.html'',' || nl ||
          '  styleUrls: [''' || ref_s || '.scss''],' || nl ||
          '}})' || nl ||
          'export class C' || CAST(k AS VARCHAR(20)) || ' {{' || nl ||
          '  run(x: string): void {{' || nl || '  }}' || nl || '}}' || nl
        WHEN m = 1 THEN
          'export interface I' || CAST(k AS VARCHAR(20)) || ' {{' || nl ||
          '  id: number;' || nl || '  name: string;' || nl || '}}' || nl
        ELSE '' END ||
      'export async function fn' || CAST(k AS VARCHAR(20)) ||
      '(a: string, b: number): void {{' || nl || '}}' || nl
    WHEN m = 7 THEN
      CASE WHEN k % 20 = 7 THEN '{{"k": ' || CAST(k AS VARCHAR(20)) || '}}' ELSE '{{"k": ' END
    ELSE 'x' || CAST(k AS VARCHAR(20)) END AS content
FROM linked
"""


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(k, repo, path, content)` for every row of `part`."""
    part = spark.read.schema("p_partkey bigint").parquet(f"{sf_dir}/part.parquet")
    # Spark fills the slot with the table itself, so no view is registered.
    return spark.sql(CODE_FILES_SQL, part=part)


def located(files: DataFrame) -> DataFrame:
    """`(repo, path, abs_path, ext, content)` of listed files."""
    repo, path = F.trim("repo"), F.col("path")
    return files.where(F.length(path) > 0).select(
        repo.alias("repo"),
        "path",
        paths.resolve(repo, path).alias("abs_path"),
        paths.extension(path).alias("ext"),
        "content",
    )
