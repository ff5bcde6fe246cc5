"""Vector code compression: every vector as one codebook index for each of its parts.

Components become integers, a vector is cut into equal consecutive parts, and each part
position learns a codebook of up to `ENTRIES` entries by rounds of assignment and mean.

1. One pass turns every batch of vectors into its distinct parts with their counts; one range
   exchange over (position, part) adds the counts up and sorts the parts. Copies of a vector,
   however many, are one part with a weight from here on.
2. A round reads the sorted parts. A run of them is a trie over the dimensions: parts with a
   common prefix share the distances of that prefix to all entries. The trie is walked depth
   first (`Trie`); a leaf takes the nearest entry and adds its weighted components to it. Only
   one row for each entry and task is shuffled, and one for each entry reaches the driver.
3. The last pass walks the tries of the vectors' own batches, so codes and errors are written
   beside the vectors without shuffling either.

Parts are stored as big-endian numbers above their least value, so that bytes sort like numbers.

Defined cases: a vector that is null, empty, of a length that is no multiple of the parts,
or with a null or non-finite component is dropped; so is a vector of another length than the
kept one with the smallest id. A null id is kept and never seeds a codebook. Rows that repeat
an id are rows of their own; equal ids seed in the order of their components. Fewer vectors than
entries give fewer entries. Scaled components beyond `LARGEST` are set to it, so that errors
stay exact 64-bit integers. Null labels are one label. An empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusatlas.operators.skew import salted_join
from corpusatlas.session import materialise, materialise_counted

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: Squares of differences of 64 components of this size still add up in 64 bits.
LARGEST = 1 << 27
#: Parts that are taken through the remaining levels of a trie together.
SIBLINGS = 4_096
#: Labels up to this number travel to the vectors by broadcast; more are joined by shuffle.
BROADCAST_LABELS = 100_000


@dataclass
class Codebooks:
    """`entries[position, index, dimension]`, as learnt so far."""

    entries: np.ndarray

    def sha256(self) -> str:
        """Of all integers by position, entry and dimension, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


class Trie:
    """A trie over sorted distinct parts, walked against one codebook."""

    def __init__(self, parts: np.ndarray, entries: np.ndarray):
        self.parts, self.entries = parts, entries
        n, width = parts.shape
        # The first depth at which a part leaves the one before it.
        changed = np.ones((n, width), dtype=bool)
        changed[1:] = np.logical_or.accumulate(parts[1:] != parts[:-1], axis=1)
        self.changed = changed
        self.codes = np.zeros(n, dtype=np.int64)
        self.errors = np.zeros(n, dtype=np.int64)

    def walk(self) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry, squared distance) of every part; ties to the lower entry."""
        pending = [(0, len(self.parts), 0, np.zeros(len(self.entries), dtype=np.int64))]
        while pending:
            low, high, depth, so_far = pending.pop()
            if high - low <= SIBLINGS or depth == self.parts.shape[1] - 1:
                for at in range(low, high, SIBLINGS):
                    self._finish(at, min(at + SIBLINGS, high), depth, so_far)
                continue
            # Children of this node; small ones next to each other go on together.
            starts = low + np.flatnonzero(self.changed[low:high, depth])
            starts[0] = low
            ends = np.append(starts[1:], high)
            begin = 0
            for i in range(len(starts)):
                if ends[i] - starts[i] > SIBLINGS:
                    if begin < i:
                        pending.append((starts[begin], starts[i], depth, so_far))
                    step = self.parts[starts[i], depth] - self.entries[:, depth]
                    pending.append((starts[i], ends[i], depth + 1, so_far + step * step))
                    begin = i + 1
                elif ends[i] - starts[begin] > SIBLINGS:
                    pending.append((starts[begin], starts[i], depth, so_far))
                    begin = i
            if begin < len(starts):
                pending.append((starts[begin], high, depth, so_far))
        return self.codes, self.errors

    def _finish(self, low: int, high: int, depth: int, so_far: np.ndarray) -> None:
        """All levels below `depth` for siblings: a node adds its own step to its parent's distances."""
        distances, node_of = so_far[None, :], np.zeros(high - low, dtype=np.int64)
        for level in range(depth, self.parts.shape[1]):
            new = self.changed[low:high, level].copy()
            new[0] = True
            first = np.flatnonzero(new)
            steps = self.parts[low + first, level, None] - self.entries[None, :, level]
            distances = distances[node_of[first]] + steps * steps
            node_of = np.cumsum(new) - 1
        best = distances.argmin(axis=1)
        self.codes[low:high] = best[node_of]
        self.errors[low:high] = distances[np.arange(len(best)), best][node_of]


def _kept(vectors: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """`(vec_id, label, ints)` of usable vectors as a table, and their length (0: none)."""
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    size = F.size("embedding")
    usable = vectors.where("embedding is not null").where((size > 0) & (size % parts == 0)).where(~broken)
    first = usable.select(F.min_by(size, F.struct(F.col("vec_id").isNull(), F.col("vec_id"), size))).first()[0]
    if first is None:
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, label string, ints array<int>"), 0
    bound = F.lit(float(LARGEST))

    def scaled(x):
        return F.greatest(F.least(F.floor(x.cast("double") * SCALE).cast("double"), bound), -bound).cast("int")

    ints = F.transform("embedding", scaled)
    table = usable.where(size == first).select("vec_id", "label", ints.alias("ints"))
    return materialise(table, "vectors"), first


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _as_bytes(parts: np.ndarray) -> np.ndarray:
    """Each row as big-endian bytes that sort like its numbers."""
    return np.ascontiguousarray((parts + LARGEST).astype(">u4")).view(f"S{4 * parts.shape[1]}").reshape(-1)


def _as_numbers(data: pa.Array, width: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(data.to_pylist()), dtype=">u4")
    return flat.astype(np.int64).reshape(-1, width) - LARGEST


def _distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in lexicographic order without copies, and the place of every row among them."""
    order = np.lexsort(parts.T[::-1])
    ranked = parts[order]
    new = np.ones(len(parts), dtype=bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    place = np.empty(len(parts), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], place


def distinct_parts(kept: DataFrame, parts: int, width: int) -> DataFrame:
    """`(pos, part, n)`: every distinct part of every position with its rows, in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = _matrix(batch.column(0), parts * width)
            for pos in range(parts):
                found, place = _distinct(whole[:, pos * width : (pos + 1) * width])
                wide = np.ascontiguousarray((found + LARGEST).astype(">u4")).tobytes()
                size = 4 * width
                data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(found), [None, pa.py_buffer(wide)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(found), pos, np.int32)), data.cast(pa.binary()),
                        pa.array(np.bincount(place, minlength=len(found)).astype(np.int64)),
                    ],
                    names=["pos", "part", "n"],
                )

    counted = kept.select("ints").mapInArrow(cut, "pos int, part binary, n bigint")
    # Grouping needs no second exchange: equal parts lie in one range.
    return (
        counted.repartitionByRange("pos", "part").groupBy("pos", "part").agg(F.sum("n").alias("n"))
        .sortWithinPartitions("pos", "part")
    )


def _seeds(kept: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    rows = kept.where("vec_id is not null").orderBy("vec_id", "ints").limit(entries).select("ints").collect()
    seeds = np.array([r.ints for r in rows], dtype=np.int64).reshape(len(rows), parts, width)
    return np.ascontiguousarray(seeds.transpose(1, 0, 2))


def _round(counted: DataFrame, books: Codebooks) -> Codebooks:
    """Assign every distinct part, then move every used entry to the floor of its mean."""
    shared = counted.sparkSession.sparkContext.broadcast(books.entries)
    width = books.entries.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        for batch in batches:
            positions = batch.column(0).to_numpy(zero_copy_only=False)
            weights = batch.column(2).to_numpy(zero_copy_only=False)
            numbers = _as_numbers(batch.column(1), width)
            for pos in np.unique(positions):
                mine = np.flatnonzero(positions == pos)
                codes, _ = Trie(numbers[mine], entries[pos]).walk()
                count = np.zeros(entries.shape[1], dtype=np.int64)
                total = np.zeros(entries.shape[1:], dtype=np.int64)
                np.add.at(count, codes, weights[mine])
                np.add.at(total, codes, numbers[mine] * weights[mine, None])
                used = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(used), pos, np.int32)), pa.array(used.astype(np.int32)),
                        pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64())),
                    ],
                    names=["pos", "code", "n", "total"],
                )

    found = counted.mapInArrow(assign, "pos int, code int, n bigint, total array<bigint>")
    # Totals may pass 64 bits over all rows; one row for each entry comes back.
    sums = [F.sum(F.get("total", F.lit(d)).cast("decimal(38,0)")).alias(f"t{d}") for d in range(width)]
    moved = books.entries.copy()
    for row in found.groupBy("pos", "code").agg(F.sum("n").alias("n"), *sums).collect():
        moved[row.pos, row.code] = [int(row[f"t{d}"]) // row.n for d in range(width)]
    return Codebooks(moved)


def _coded(kept: DataFrame, books: Codebooks) -> DataFrame:
    """`(vec_id, label, code, error)` by the tries of each batch."""
    shared = kept.sparkSession.sparkContext.broadcast(books.entries)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        parts, _, width = entries.shape
        digits = np.array([f"{i:02x}" for i in range(256)], dtype="S2")
        for batch in batches:
            whole = _matrix(batch.column(2), parts * width)
            codes = np.empty((len(whole), parts), dtype="S2")
            errors = np.zeros(len(whole), dtype=np.int64)
            for pos in range(parts if len(whole) else 0):
                found, place = _distinct(whole[:, pos * width : (pos + 1) * width])
                nearest, error = Trie(found, entries[pos]).walk()
                codes[:, pos] = digits[nearest][place]
                errors += error[place]
            text = codes.view(f"S{2 * parts}").reshape(-1).astype(str)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text.tolist(), pa.string()), pa.array(errors)],
                names=["vec_id", "label", "code", "error"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def learnt(kept: DataFrame, parts: int, entries: int, rounds: int, width: int) -> Codebooks:
    books = Codebooks(_seeds(kept, parts, entries, width))
    if books.entries.shape[1]:
        counted = materialise(distinct_parts(kept, parts, width), "parts")
        for _ in range(rounds):
            books = _round(counted, books)
    return books


def compressed(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, Codebooks]:
    """`(vec_id, label, code, error, label_error)` of `(vec_id, embedding, label)`, and the codebooks.

    Without any vector that has an id there is no codebook; codes are empty then and errors null.
    """
    kept, length = _kept(vectors, parts)
    books = learnt(kept, parts, entries, rounds, length // parts) if length else Codebooks(np.zeros((parts, 0, 0), np.int64))
    if not books.entries.shape[1]:
        nothing = kept.select(
            "vec_id", "label", F.lit("").alias("code"), F.lit(None).cast("bigint").alias("error"),
            F.lit(None).cast("bigint").alias("label_error"),
        )
        return nothing, books
    coded = materialise(_coded(kept, books), "codes")
    # A label as text, so that null is a label like any other and a hot one can be dealt out.
    named = coded.withColumn("_of", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    totals, n_labels = materialise_counted(named.groupBy("_of").agg(F.sum("error").alias("label_error")), "labels")
    if n_labels <= BROADCAST_LABELS:
        joined = named.join(F.broadcast(totals), "_of")
    else:
        joined = salted_join(named, totals, ["_of"], "inner", spread_by=["vec_id", "code"])
    return joined.select("vec_id", "label", "code", "error", "label_error"), books


ORACLE_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), comps AS (
  SELECT vec_id, CAST(i // w AS INTEGER) AS p, CAST(i % w AS INTEGER) AS d, v[i + 1] AS x
  FROM (SELECT vec_id, v, len(v) // {PARTS} AS w, unnest(range(len(v))) AS i FROM kept) all_places
), cb0 AS (
  SELECT e, p, d, x FROM comps JOIN (
    SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS e FROM kept
  ) ranked USING (vec_id) WHERE e < {ENTRIES}
)
""" + "".join(
    f"""
, dist{n} AS (
  SELECT vec_id, comps.p, e, sum((comps.x - c.x) * (comps.x - c.x)) AS err
  FROM comps JOIN cb{n} c ON c.p = comps.p AND c.d = comps.d GROUP BY vec_id, comps.p, e
), asg{n} AS MATERIALIZED (
  SELECT vec_id, p, e, err FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id, p ORDER BY err, e) AS rk FROM dist{n}
  ) ordered WHERE rk = 1
)
""" + (
        f"""
, mean{n} AS (
  SELECT comps.p, e, d, sum(x) AS s, count(*) AS n FROM comps JOIN asg{n} a ON a.vec_id = comps.vec_id AND a.p = comps.p
  GROUP BY comps.p, e, d
), cb{n + 1} AS MATERIALIZED (
  SELECT c.e, c.p, c.d, CASE WHEN m.n IS NULL THEN c.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS x
  FROM cb{n} c LEFT JOIN mean{n} m ON m.p = c.p AND m.e = c.e AND m.d = c.d
)
""" if n < ROUNDS else "") for n in range(ROUNDS + 1)
) + f"""
, coded AS (
  SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(err) AS BIGINT) AS error
  FROM asg{ROUNDS} GROUP BY vec_id
)
SELECT coded.vec_id, code, error,
  CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, d)) FROM cb{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""
