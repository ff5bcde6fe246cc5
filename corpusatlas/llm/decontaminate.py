"""Benchmark passages in documents, found by Wu-Manber search over words.

A window is a run of `window` words of a benchmark item (a shorter item is one window).
Windows of one length form a pattern set with three tables: how far the search may shift
after a block of two words, the test strings by the hash of their last block, and among
these by their first block; a direct comparison confirms every occurrence. Most positions
are skipped, up to `window - 1` words at a time.

The benchmark is read in blocks of bounded size; every block is one map-only pass over the
documents, and only several blocks need a join of their hits.

Defined cases: null and empty texts have no words, n_hit 0 and the digest of an empty list;
a null item id counts for hits, not for the list of items; repeated items count once; rows
that repeat a document are each judged; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusatlas.llm import textarrays as ta
from corpusatlas.session import materialise

WINDOW = 13
BLOCK_BYTES = 16 << 20
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def word_list(text: bytes) -> list[bytes]:
    """Lower-case runs of ASCII letters, digits and all other non-ASCII characters."""
    return text.translate(_TO_WORDS).split()


class PatternSet:
    """Windows of one length with their shift table and suffix buckets."""

    def __init__(self, length: int, windows: dict[tuple, set]):
        self.length = length
        self.block = min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        buckets: dict[tuple, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                key = window[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            tail, head = window[length - self.block :], window[: self.block]
            buckets[tail][head].append((window, tuple(items)))
        self.buckets = {k: dict(v) for k, v in buckets.items()}

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple]]:
        """The end of every occurrence with the items that hold the window."""
        m, b, n = self.length, self.block, len(words)
        shift, default, at = self.shift.get, self.default, self.length
        while at <= n:
            key = (words[at - 2], words[at - 1]) if b == 2 else (words[at - 1],)
            step = shift(key, default)
            if step:
                at += step
                continue
            begin = at - m
            for window, items in self.buckets[key].get(tuple(words[begin : begin + b]), ()):
                if list(window) == words[begin:at]:
                    yield at, items
            at += 1


def pattern_sets(items: list[tuple], window: int) -> list[PatternSet]:
    """`items` are (id, text bytes) pairs."""
    by_length: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = word_list(text or b"")
        length = min(window, len(words))
        if length:
            for i in range(len(words) - length + 1):
                found = by_length[length][tuple(words[i : i + length])]
                if item is not None:
                    found.add(str(item))
    return [PatternSet(length, windows) for length, windows in sorted(by_length.items())]


def _search(docs: DataFrame, sets: list[PatternSet]) -> DataFrame:
    """`(doc_id, n_words, hits, items)`: hit words as merged [begin, end) spans."""
    shared = docs.sparkSession.sparkContext.broadcast(sets)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = shared.value
        for batch in batches:
            counts, hits, items = [], [], []
            for text in ta.plain(batch.column(1)):
                words = word_list(text.as_py())
                spans, found = [], set()
                for patterns in local:
                    for end, names in patterns.search(words):
                        spans.append((end - patterns.length, end))
                        found.update(names)
                counts.append(len(words))
                hits.append([{"begin": b, "end": e} for b, e in merged(spans)])
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(counts, pa.int64()),
                    pa.array(hits, _SPANS), pa.array(items, pa.list_(pa.string())),
                ],
                names=["doc_id", "n_words", "hits", "items"],
            )

    return docs.mapInArrow(
        find,
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, hits array<struct<begin:bigint,end:bigint>>, items array<string>",
    )


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """The union of the spans as spans that do not touch."""
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[list[PatternSet]]:
    """The windows of one block of the benchmark after the other, each of about `block_bytes`."""
    tests = benchmark.select("item_id", "text").where("text is not null")
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    place = F.pmod(F.xxhash64("text"), F.lit(blocks))
    for number in range(blocks):
        rows = tests.where(place == number).toLocalIterator()
        yield pattern_sets([(r["item_id"], r["text"].encode()) for r in rows], window)


def find_windows(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """`(doc_id, n_words, hits, items)` for every row of `docs`."""
    blocks = list(_blocks(benchmark, window, block_bytes))
    if len(blocks) == 1:
        return _search(docs.select("doc_id", "text"), blocks[0])
    # A row number tells repeated documents apart when the hits of the blocks are joined.
    keyed = materialise(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "keyed")
    parts = [_search(keyed.select(F.col("row").alias("doc_id"), "text"), sets) for sets in blocks]
    gathered = reduce(DataFrame.union, parts).groupBy(F.col("doc_id").alias("row")).agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return keyed.select("row", "doc_id").join(gathered, "row").drop("row")


def _hit_words(hits: str):
    """Words under the union of the spans (those of several blocks may overlap)."""
    zero = F.lit(0).cast("bigint")
    return F.aggregate(
        F.array_sort(hits),
        F.struct(zero.alias("n"), zero.alias("last")),
        lambda s, p: F.struct(
            (s["n"] + F.greatest(p["end"] - F.greatest(p["begin"], s["last"]), zero)).alias("n"),
            F.greatest(s["last"], p["end"]).alias("last"),
        ),
        lambda s: s["n"],
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Counts for every document; it is contaminated if a twentieth of its words is hit."""
    return (
        find_windows(docs, benchmark, window, block_bytes)
        .withColumn("n_hit", _hit_words("hits"))
        .select(
            "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items",
            ((F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        )
    )


def item_digest(items: str):
    return F.sha2(F.concat_ws(",", F.array_sort(items)), 256)


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of `docs` that are not contaminated, with all their columns.

    A document travels through the search as it is, so that no row is joined back; with
    several blocks its spans are gathered first.
    """
    blocks = list(_blocks(benchmark, window, block_bytes))
    if len(blocks) > 1:
        numbered = materialise(
            docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("doc_id"), "text"),
            "numbered",
        )
        bad = contamination(numbered, benchmark, window, block_bytes).where("contaminated")
        return numbered.join(bad.select("doc_id"), "doc_id", "left_anti").select("row.*")
    shared = docs.sparkSession.sparkContext.broadcast(blocks[0])
    column = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for text in ta.plain(batch.column(column)):
                words = word_list(text.as_py())
                spans = [(end - p.length, end) for p in shared.value for end, _ in p.search(words)]
                n_hit = sum(end - begin for begin, end in merged(spans))
                good.append(not (n_hit and 20 * n_hit >= len(words)))
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


ORACLE_SQL = r"""
WITH lowered AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), wanted AS (
  SELECT DISTINCT item_id, size, array_to_string(words[i + 1 : i + size], ' ') AS w FROM (
    SELECT item_id, words, least(13, len(words)) AS size, unnest(range(len(words) - least(13, len(words)) + 1)) AS i
    FROM items WHERE len(words) > 0
  ) item_places
), sizes AS (SELECT DISTINCT size FROM wanted
), met AS (
  SELECT r, i, p.size, item_id FROM (
    SELECT r, size, words, unnest(range(len(words) - size + 1)) AS i FROM lowered, sizes WHERE len(words) >= size
  ) p JOIN wanted ON wanted.size = p.size AND wanted.w = array_to_string(p.words[p.i + 1 : p.i + p.size], ' ')
), hits AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS j FROM met) covered GROUP BY r
), found AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM met GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(words), false) AS contaminated
FROM lowered LEFT JOIN hits USING (r) LEFT JOIN found USING (r)
"""
