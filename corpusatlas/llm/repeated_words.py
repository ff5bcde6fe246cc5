"""Substring dedup by word windows with a count-min prefilter.

A word goes if a window of `WINDOW` words that covers it also starts in a document with a
smaller id. Whole texts are read; windows never cross documents.

1. Every partition counts its windows in a sparse count-min sketch (`ROWS` rows of cells). The
   partitions' sketches are merged cell block by cell block, one piece after the other;
   counts stop at `HOT`. What is merged can only overestimate a window.
2. The cells counted twice or more (one bit each) travel to the texts. Windows with all their
   bits set are candidates; every repeated window is one, and few others are. The sketch also
   says which windows may be very frequent.
3. Candidates are grouped exactly, by their 64-bit hash and 32 bits of a digest of their words,
   which gives the smallest document of each. One exchange serves the grouping and the look-up
   of every candidate in its group. Windows that may be very frequent are dealt out to many tasks
   by document, and their groups are merged from one row for each of these.
4. Windows found in a smaller document return to their texts by document.

The number of cells follows the number of bytes, from `LEAST_CELLS` to `MOST_CELLS` in a row, so
`MOST_CELLS / 8` bytes for each row is the most that is broadcast. Beyond that the sketch lets
more single windows pass, and the exact grouping decides on more rows; the result is the same.

Defined cases: null and empty texts have no words. Fewer words than a window stay whole. A null
id is never smaller than another and has none that are smaller, so its row stays whole. Rows
that repeat an id are judged each on its own text, and not against each other. An empty table
gives an empty result; other columns are not read. A very long text is worked on by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusatlas.llm import textarrays as ta
from corpusatlas.llm.substring_dedup import packed, unpacked

WINDOW = 13
ROWS = 2
#: Cells for each window that the texts may hold, by their bytes.
CELLS_PER_WINDOW, BYTES_PER_WINDOW = 2, 7
LEAST_CELLS, MOST_CELLS = 1 << 20, 1 << 30
#: Counts stop here; windows that reach it are dealt out.
HOT = 255
BLOCK_BITS = 20
#: Windows that a task counts before it writes them as a piece.
PIECE_WINDOWS = 4_000_000
_U = np.uint64
_SEED = 13
_PIECE = "line int, block int, n bigint, cells binary, counts binary"
_PIECE_NAMES = ["line", "block", "n", "cells", "counts"]


class Windows:
    """Word windows of the texts of one slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashing: ta.RangeHash, k: int):
        self.data, self.k = data, k
        self.starts, self.ends, self.bounds = ta.words(data, offsets)
        runs = ta.sequences(hashing.of(hashing.prefix(data), self.starts, self.ends), k)
        n_words = np.diff(self.bounds)
        self.text_of = np.repeat(np.arange(len(n_words)), n_words)
        self.stops = offsets[1:][self.text_of]
        last = np.repeat(self.bounds[1:], n_words)
        #: The first word and the hash of every window.
        self.first = np.flatnonzero(last - np.arange(len(last)) >= k)
        self.hashes = runs[self.first]

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, each followed by a space, and where each of them starts."""
        places = np.concatenate([[0], np.cumsum(self.ends - self.starts + 1)])
        # The byte after a word is white space, but for the last word of some texts.
        inside = self.ends < self.stops
        data, taken = self.data.copy(), ~ta.is_space(self.data)
        data[self.ends[inside]], taken[self.ends[inside]] = 0x20, True
        out = np.full(int(places[-1]), 0x20, dtype=np.uint8)
        there = np.ones(len(out), dtype=bool)
        there[places[1:][~inside] - 1] = False
        out[there] = data[taken]
        return out, places


def _cells(hashes: np.ndarray, line: int, bits: int) -> np.ndarray:
    spread = hashes if line == 0 else ta.mix(hashes ^ _U(0x9E3779B97F4A7C15 * line & (1 << 64) - 1))
    return (spread >> _U(64 - bits)).astype(np.uint32)


def _piece(line: int, block: int, cells: np.ndarray, counts: np.ndarray) -> tuple:
    """Ascending cells of one block, counted from its first, and their counts."""
    gaps = np.diff(cells.astype(np.uint32), prepend=np.uint32(0))
    return line, block, len(cells), packed(gaps), packed(counts.astype(np.uint8))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_PIECE_NAMES)


def partition_sketches(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """Every partition's windows as pieces: ascending cells of one block with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = ta.RangeHash(_SEED)
        shift = min(BLOCK_BITS, bits)

        def emit(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            hashes = np.concatenate(held)
            for line in range(ROWS):
                cells, counts = np.unique(_cells(hashes, line, bits), return_counts=True)
                blocks = cells >> shift
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(cells)]])
                made = []
                for low, high in zip(cuts[:-1], cuts[1:]):
                    own = cells[low:high] & np.uint32((1 << shift) - 1)
                    made.append(_piece(line, int(blocks[low]), own, np.minimum(counts[low:high], HOT)))
                yield _rows(made)

        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in ta.slices(batch.column(0)):
                found = Windows(data, offsets, hashing, k).hashes
                held.append(found)
                size += len(found)
                if size >= PIECE_WINDOWS:
                    yield from emit(held)
                    held, size = [], 0
        if size:
            yield from emit(held)

    return docs.select("text").mapInArrow(count, _PIECE)


def merged_sketch(pieces: DataFrame, bits: int) -> DataFrame:
    """One piece for each row and block; the partitions' pieces are added up one at a time."""
    shift = min(BLOCK_BITS, bits)

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << shift, dtype=np.uint16)
        for batch in batches:
            columns = (batch.column(batch.schema.get_field_index(c)) for c in ("n", "cells", "counts"))
            for n, cells, times in zip(*columns):
                at = np.cumsum(unpacked(cells.as_py(), n.as_py(), np.uint32), dtype=np.uint32)
                # The cells of a piece differ, so plain addition counts each.
                counts[at] = np.minimum(counts[at] + unpacked(times.as_py(), n.as_py(), np.uint8), HOT)
        filled = np.flatnonzero(counts)
        line, block = (k.as_py() for k in key)
        yield _rows([_piece(line, block, filled, counts[filled])])

    return pieces.groupBy("line", "block").applyInArrow(merge, _PIECE)


class Sketch:
    """The cells counted twice or more, and those that reached `HOT`."""

    def __init__(self, bits: int):
        self.bits = bits
        self.repeated = [np.zeros(max(1, (1 << bits) // 8), dtype=np.uint8) for _ in range(ROWS)]
        self.hot = [np.zeros(0, dtype=np.uint32) for _ in range(ROWS)]

    @classmethod
    def gathered(cls, merged: DataFrame, bits: int) -> Sketch:
        """Bits and hot cells are made where the blocks are; only they come to the driver."""
        shift = min(BLOCK_BITS, bits)

        def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for line, block, n, cells, times in zip(*(c.to_pylist() for c in batch.columns)):
                    at = np.cumsum(unpacked(cells, n, np.uint32), dtype=np.uint32)
                    times = unpacked(times, n, np.uint8)
                    full = np.zeros(1 << shift, dtype=bool)
                    full[at[times >= 2]] = True
                    hot = at[times >= HOT]
                    rows.append((line, block, len(hot), packed(np.packbits(full, bitorder="little")), hot.tobytes()))
                if rows:
                    yield _rows(rows)

        made, hot = cls(bits), [[] for _ in range(ROWS)]
        size = (1 << shift) // 8
        for row in merged.mapInArrow(thin, _PIECE).toLocalIterator():
            made.repeated[row.line][row.block * size : (row.block + 1) * size] = unpacked(bytes(row.cells), size, np.uint8)
            hot[row.line].append(np.frombuffer(bytes(row.counts), dtype=np.uint32) + np.uint32(row.block << shift))
        made.hot = [np.sort(np.concatenate([np.zeros(0, np.uint32), *h])) for h in hot]
        return made

    def estimate(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each window may occur twice, and whether it may occur `HOT` times."""
        repeated, hot = np.ones(len(hashes), dtype=bool), np.ones(len(hashes), dtype=bool)
        for line in range(ROWS):
            cells = _cells(hashes, line, self.bits)
            repeated &= (self.repeated[line][cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)
            if len(self.hot[line]):
                place = np.minimum(np.searchsorted(self.hot[line], cells), len(self.hot[line]) - 1)
                hot &= self.hot[line][place] == cells
            else:
                hot[:] = False
        return repeated, repeated & hot


def sketched(docs: DataFrame, k: int = WINDOW, bits: int | None = None) -> Sketch:
    if bits is None:
        size = docs.select(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
        wanted = min(max(size // BYTES_PER_WINDOW * CELLS_PER_WINDOW, LEAST_CELLS), MOST_CELLS)
        bits = max(3, (wanted - 1).bit_length())
    return Sketch.gathered(merged_sketch(partition_sketches(docs, k, bits), bits), bits)


def _candidates(docs: DataFrame, k: int, shared, splits: int) -> DataFrame:
    """`(hash, check, salt, doc_id)` of windows that may be repeated; salt is -1 unless they may be very frequent."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing, sketch = ta.RangeHash(_SEED), shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for low, _, data, offsets in ta.slices(batch.column(1)):
                windows = Windows(data, offsets, hashing, k)
                repeated, hot = sketch.estimate(windows.hashes)
                at = np.flatnonzero(repeated)
                text = windows.text_of[windows.first[at]]
                # A window that a text holds more than once is asked for once.
                order = np.lexsort((windows.hashes[at], text))
                at, text = at[order], text[order]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (text[1:] != text[:-1]) | (windows.hashes[at][1:] != windows.hashes[at][:-1])
                at, text = at[new], text[new]
                if not len(at):
                    continue
                joined, places = windows.joined()
                begin = places[windows.first[at]].tolist()
                end = (places[windows.first[at] + k] - 1).tolist()
                whole, digest = joined.tobytes(), hashlib.blake2b
                checks = b"".join([digest(whole[a:b], digest_size=4).digest() for a, b in zip(begin, end)])
                doc = ids[low + text].astype(np.int64)
                salt = np.where(hot[at], doc % splits, -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(windows.hashes[at].view(np.int64)), pa.array(np.frombuffer(checks, np.int32)),
                        pa.array(salt), pa.array(doc),
                    ],
                    names=["hash", "check", "salt", "doc_id"],
                )

    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return named.mapInArrow(find, "hash bigint, check int, salt int, doc_id bigint")


def repeated_windows(docs: DataFrame, sketch: Sketch, k: int = WINDOW) -> DataFrame:
    """`(doc_id, hash)` of every window that also starts in a document with a smaller id."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sketch)
    splits = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # All ways down read all columns and the same rows, so that the exchange is made once.
    dealt = _candidates(docs, k, shared, splits).where(
        "hash is not null and check is not null and salt is not null and doc_id is not null"
    ).repartition("hash", "check", "salt")
    key = ["hash", "check", "salt"]
    # A draw below one changes no sign; a condition that rests on it is not pushed below the exchange.
    grouped = dealt.groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).withColumn(
        "frequent", F.col("salt") + F.rand() >= 0
    )
    cold = grouped.where("not frequent and first < last").select(*key, "first")
    # A very frequent window: one row for each split, so a group holds `splits` rows at most.
    whole = grouped.where("frequent").groupBy("hash", "check").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.collect_set("salt").alias("salts")
    ).where("first < last")
    hot = whole.select("hash", "check", F.explode("salts").alias("salt"), "first")
    found = [dealt.join(side, key).where("doc_id > first").select("doc_id", "hash") for side in (cold, hot)]
    return found[0].unionByName(found[1])


def without_repeats(docs: DataFrame, k: int = WINDOW, bits: int | None = None) -> DataFrame:
    """`(doc_id, n_words, n_removed, kept)` for every row; `kept` has the words that stay, joined by a space."""
    named = docs.select("doc_id", "text")
    sketch = sketched(named, k, bits)
    gone = repeated_windows(named, sketch, k).groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_list("hash").alias("gone")
    )
    kind = named.schema["doc_id"].dataType.simpleString()
    both = named.join(gone, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = ta.RangeHash(_SEED)
        for batch in batches:
            for low, high, data, offsets in ta.slices(batch.column(1)):
                windows = Windows(data, offsets, hashing, k)
                gone = batch.column(2).slice(low, high - low)
                covered = np.zeros(len(windows.starts) + 1, dtype=np.int64)
                by_text = np.searchsorted(windows.first, windows.bounds)
                for i in np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)):
                    own = slice(by_text[i], by_text[i + 1])
                    hit = np.isin(windows.hashes[own], gone[i].values.to_numpy(zero_copy_only=False).view(_U))
                    first = windows.first[own][hit]
                    np.add.at(covered, first, 1)
                    np.add.at(covered, first + k, -1)
                stays = np.cumsum(covered)[:-1] == 0
                joined, places = windows.joined()
                sizes = np.diff(places)
                left = joined[np.repeat(stays, sizes)].tobytes()
                ends = np.concatenate([[0], np.cumsum(np.where(stays, sizes, 0))])[windows.bounds]
                kept = [left[a : max(a, b - 1)].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
                n_words = np.diff(windows.bounds)
                n_kept = np.diff(np.concatenate([[0], np.cumsum(stays)])[windows.bounds])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low), pa.array(n_words.astype(np.int64)),
                        pa.array((n_words - n_kept).astype(np.int64)), pa.array(kept, pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    return both.mapInArrow(cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


ORACLE_SQL = rf"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT r, doc_id, i, array_to_string(words[i + 1 : i + {WINDOW}], ' ') AS w
  FROM (SELECT r, doc_id, words, unnest(range(len(words) - {WINDOW - 1})) AS i FROM split WHERE len(words) >= {WINDOW}) places
), firsts AS (
  SELECT w, min(doc_id) AS first FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)
), covered AS (
  SELECT DISTINCT r, j FROM (
    SELECT r, unnest(range(i, i + {WINDOW})) AS j FROM windows JOIN firsts USING (w) WHERE doc_id > first
  ) hits
), placed AS (
  SELECT r, unnest(words) AS word, unnest(range(len(words))) AS j FROM split
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n FROM placed ANTI JOIN covered USING (r, j) GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r)
"""
