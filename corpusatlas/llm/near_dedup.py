"""Near-duplicate groups by one-permutation MinHash.

Each text is hashed once into `BANDS * ROWS` bins; an empty bin takes the value of a bin
chosen by a hash of (bin, attempt), so that empty bins of two texts borrow alike
(optimal densification). Texts with equal shingle sets become one class first. Classes
that share a band meet in a bucket, and every bucket gives a star: its members are
compared with one centre only, so candidates grow with members, not with their square.
The centre is the member whose bands lie in the largest buckets, which in a group of
altered copies is the text that the others were made from. Links are confirmed on full
sets. Later rounds split the buckets that still hold several components by a second
band and draw further centres, so that texts which miss the first centre still meet.
The buckets that are open after the stars are finished in `FINISH` rounds. A bucket of up to
`SMALL` members is finished exactly: members of different components are compared. Members of a
larger one meet in random parts of about `PART` members, for the `LARGE` smallest large buckets of
each text, so that pairs grow with members here too. What is open then is settled exactly: the
texts of buckets that still hold several components are joined by the prefixes of their full sets,
rarest shingles first. Texts that are linked share a shingle there, at places and with sizes that
leave room for the links' similarity, so only such pairs of different components are confirmed.
Within a key the rows of its commonest component are not paired with each other; pairs are many
only where many components agree in their rarest shingles and sizes without being linked.
`exhaustive` compares every pair that shares a band instead, which is quadratic in families without
links and finds the same groups.

Defined cases: a null or empty text has no shingles and is linked with nothing; rows with
a null id are linked with nothing, have a null component and are kept; rows that repeat
an id are judged each by its own text; an empty table gives an empty result; other columns
are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusatlas.llm import textarrays as ta
from corpusatlas.operators.skew import salted_join
from corpusatlas.session import materialise, materialise_counted, materialise_observed

#: At a similarity of 0.85 two texts share one of 32 bands of 8 bins with a chance of 0.99996, at 0.8 of 0.997.
BANDS, ROWS = 32, 8
BINS = BANDS * ROWS
WORDS = 5
PERCENT = 80
ROUNDS = 3
#: Rounds that finish open buckets, members of a bucket that is finished exactly, members that meet
#: in a part of a larger one, and larger buckets that a text takes part in.
FINISH, SMALL, PART, LARGE = 3, 16, 8, 4
#: Centres of a component in an open bucket, from one exhaustive round to the next.
GROWTH = 8
#: Cells of the counts that tell rare shingles from common ones (any order gives the same pairs), the
#: step from one class of sizes to the next, and rows of a prefix key that one task takes.
CELLS, SIZE_STEP, KEY_ROWS = 1 << 20, 1.08, 20_000
_U = np.uint64


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, hashing: ta.RangeHash, k: int
) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a slice."""
    data = ta.lower(data)
    starts, ends, bounds = ta.words(data, offsets)
    hashes = hashing.of(hashing.prefix(data), starts, ends)
    runs = ta.sequences(hashes, k)
    for begin, end in zip(bounds[:-1], bounds[1:]):
        n = end - begin
        if n >= k:
            yield np.unique(runs[begin : end - k + 1])
        elif n:
            yield ta.sequences(hashes[begin:end], int(n))
        else:
            yield np.zeros(0, dtype=_U)


def borrow_table(bins: int = BINS, attempts: int = 64) -> np.ndarray:
    """For every bin the bins to borrow from, in order; the last resort is a full walk."""
    i, t = np.meshgrid(np.arange(bins, dtype=_U), np.arange(attempts, dtype=_U), indexing="ij")
    drawn = (ta.mix(i * _U(0x9E3779B97F4A7C15) + t + _U(11)) % _U(bins)).astype(np.int64)
    walk = (np.arange(bins)[:, None] + np.arange(bins)[None, :]) % bins
    return np.concatenate([drawn, walk], axis=1)


def signature(shingles: np.ndarray, borrow: np.ndarray) -> np.ndarray:
    """The least hash of every bin; empty bins borrow."""
    bins = len(borrow)
    where = ((shingles >> _U(32)) * _U(bins)) >> _U(32)
    filled, first = np.unique(where, return_index=True)
    out = np.zeros(bins, dtype=_U)
    full = np.zeros(bins, dtype=bool)
    filled = filled.astype(np.int64)
    out[filled], full[filled] = shingles[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        choice = borrow[empty]
        lender = choice[np.arange(len(empty)), full[choice].argmax(axis=1)]
        out[empty] = out[lender]
    return out


def _band_keys(bins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    total = np.arange(bands, dtype=_U) + _U(1)
    for column in bins.reshape(bands, rows).T:
        total = ta.mix(total * _U(0xD6E8FEB86659FD93) + column)
    return total


def _node(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS, row_key: Column | None = None) -> DataFrame:
    """`(doc_id, row_key, n_shingles, node, bands)`; node names the shingle set, null if it is empty."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing, borrow = ta.RangeHash(3), borrow_table(bands * rows)
        for batch in batches:
            sizes, nodes, keys = [], [], []
            for _, _, data, offsets in ta.slices(batch.column(1)):
                for shingles in shingle_sets(data, offsets, hashing, words):
                    sizes.append(len(shingles))
                    if len(shingles):
                        nodes.append(_node(shingles))
                        keys.append(_band_keys(signature(shingles, borrow), bands, rows).view(np.int64))
                    else:
                        nodes.append(None)
                        keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "row_key", "n_shingles", "node", "bands"],
            )

    key = F.lit(None) if row_key is None else row_key
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), key.cast("bigint").alias("row_key")
    ).mapInArrow(sign, "doc_id bigint, row_key bigint, n_shingles bigint, node binary, bands array<bigint>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """`(node, shingles)` of the given texts, one row for each set."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = ta.RangeHash(3)
        for batch in batches:
            for _, _, data, offsets in ta.slices(batch.column(0)):
                found = [s for s in shingle_sets(data, offsets, hashing, words) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([_node(s) for s in found], pa.binary()),
                        pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())),
                    ],
                    names=["node", "shingles"],
                )

    found = texts.mapInArrow(compute, "node binary, shingles array<bigint>")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))


def _confirmed(edges: DataFrame, n_edges: int, sets: DataFrame, percent: int) -> DataFrame:
    """The candidate edges `(a, b)` whose full sets are similar enough. A centre with very many edges is dealt out."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b"))
    common = F.size(F.array_intersect("_a", "_b"))
    return (
        salted_join(
            salted_join(edges, left, ["a"], "inner", ["b"], at_most=n_edges), right, ["b"], "inner", ["a"], at_most=n_edges
        )
        .where(F.lit(100) * common >= F.lit(percent) * (F.size("_a") + F.size("_b") - common))
        .select("a", "b")
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`(node, label)`: every node that has an edge, with the least node it can reach.

    Large-star and small-star steps in turn, until neither changes an edge. Edges point from the
    greater node `u` to the lesser one `v`; every step is one join with a group-by that has a map-side
    minimum, and is written, so plans stay small and a lost executor costs one step at most.
    """
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now, state = _edges(start.where("u > v").distinct())
    unchanged, large = 0, True
    while state[0] and unchanged < 2:
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        if large:
            # The greater node of an edge goes to the least neighbour of the lesser one, which is itself if it has no edge down.
            step = salted_join(now, least.select(F.col("u").alias("v"), "m"), ["v"], "left", ["u"], at_most=state[0]).select(
                "u", F.coalesce("m", "v").alias("v")
            )
        else:
            # A node and its lesser neighbours go to the least of these.
            ends = F.explode(F.array("u", "v")).alias("u")
            step = salted_join(now, least, ["u"], "inner", ["v"], at_most=state[0]).select(ends, F.col("m").alias("v")).where("u <> v")
        before = state
        now, state = _edges(step.distinct())
        unchanged, large = unchanged + 1 if state == before else 0, not large
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def _edges(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges `(u, v)`, written, with their number and a hash of the set of them."""
    written, n, more = materialise_observed(edges, "edges", F.bit_xor(F.xxhash64("u", "v")).alias("hash"))
    return written, (n, more["hash"])


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


class _Asked:
    """The pairs that were compared so far, and what was found."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.pairs: list[DataFrame] = []
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None

    def compare(self, edges: DataFrame) -> bool:
        """Compare the pairs that no earlier round has; true if there were links among them."""
        edges = edges.distinct()
        if self.pairs:
            edges = edges.join(reduce(DataFrame.union, self.pairs), ["a", "b"], "left_anti")
        new, n_new = materialise_counted(edges, "asked")
        if self.labels is not None and not n_new:
            return False
        self.pairs.append(new)
        found, n_found = materialise_counted(_confirmed(new, n_new, self.sets, self.percent), "links")
        if self.labels is not None and not n_found:
            return False
        known = found
        if self.labels is not None:
            known = found.union(self.labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        self.labels = materialise(components(known), "labels")
        return n_found > 0


def _similar_sizes(percent: int):
    return F.lit(100) * F.least("n", "m") >= F.lit(percent) * F.greatest("n", "m")


def _open(rest: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """The members of buckets that hold several components, with `label` and the bucket's `size`, and their number."""
    now = _labelled(rest.drop("label", "size"), labels)
    keys = now.groupBy("key").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")
    ).where("lo <> hi")
    return materialise_counted(now.join(keys.select("key", "size"), "key"), "open")


def _finished(rest: DataFrame, asked: _Asked) -> DataFrame:
    """Compare members `(key, node, n)` of open buckets, in as many pairs as there are members; large buckets that were open."""
    for turn in range(FINISH):
        now, n_open = _open(rest, asked.labels)
        if not n_open:
            return now
        # A text has one row for each band at most.
        order = Window.partitionBy("node").orderBy("size", "key")
        large = now.where(F.col("size") > SMALL).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= LARGE).drop("_n")
        parts = F.ceil(F.col("size") / F.lit(PART))
        dealt = large.withColumn("part", F.pmod(F.xxhash64("node", "key", F.lit(turn)), parts))
        if not turn:
            dealt = dealt.unionByName(now.where(F.col("size") <= SMALL).withColumn("part", F.lit(0).cast("bigint")))
        dealt = materialise(dealt.select("key", "part", "node", "label", "n"), "dealt")
        one = dealt.select("key", "part", F.col("node").alias("a"), F.col("label").alias("l"), F.col("n").alias("n"))
        other = dealt.select("key", "part", F.col("node").alias("b"), F.col("label").alias("o"), F.col("n").alias("m"))
        pairs = one.join(other, ["key", "part"]).where("a < b and l <> o").where(_similar_sizes(asked.percent))
        asked.compare(pairs.select("a", "b"))
        rest = now.where(F.col("size") > SMALL).select("key", "node", "n")
    return rest


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(_U) >> _U(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / np.log(SIZE_STEP)).astype(np.int32)


def _shingle_counts(sets: DataFrame) -> np.ndarray:
    """How often shingles occur, counted in `CELLS` cells by their hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            total += np.bincount(_cells(batch.column(0).flatten().to_numpy()), minlength=CELLS)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], names=["cell", "n"])

    rows = sets.select("shingles").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """`(token, class, asks, place, node, label, n)` of `(node, label, shingles)`: the rarest shingles of every set.

    Of two linked sets the larger one asks and the smaller one answers: both have a row with the
    first shingle that they share, under the class of the smaller one's size.
    """
    shared = sets.sparkSession.sparkContext.broadcast(_shingle_counts(sets))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy()
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            row, token, kind, asks, place, size = [], [], [], [], [], []
            for i, (begin, end) in enumerate(zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist())):
                own, n = flat[begin:end], end - begin
                # The least intersection with a set of the same size, and with the smallest that can be linked.
                same, least = -(-2 * percent * n // (100 + percent)), -(-percent * n // 100)
                first = own[np.lexsort((own, counts[_cells(own)]))[: n - least + 1]]
                answers = n - same + 1
                at = np.arange(len(first))
                # The sizes up to its own that leave room for a link when the first shared shingle is at this place.
                most = np.minimum(n, (n - at) * (100 + percent) // percent - n)
                fits = most >= max(1, least)
                low = _size_class(np.array([max(1, least)]))[0]
                high = np.where(fits, _size_class(np.maximum(most, 1)), low - 1)
                times = high - low + 1
                total = int(times.sum())
                asked = np.repeat(at, times)
                step = np.arange(total) - np.repeat(np.cumsum(times) - times, times)
                row.append(np.full(answers + total, i))
                token += [first[:answers], first[asked]]
                place += [at[:answers], asked]
                kind += [np.full(answers, _size_class(np.array([n]))[0]), (low + step).astype(np.int32)]
                asks += [np.zeros(answers, bool), np.ones(total, bool)]
                size.append(np.full(answers + total, n))
            if not row:
                continue
            every = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(token)), pa.array(np.concatenate(kind), pa.int32()), pa.array(np.concatenate(asks)),
                    pa.array(np.concatenate(place), pa.int32()), batch.column(0).take(every), batch.column(1).take(every),
                    pa.array(np.concatenate(size), pa.int64()),
                ],
                names=["token", "class", "asks", "place", "node", "label", "n"],
            )

    return sets.select("node", "label", "shingles").mapInArrow(
        cut, "token bigint, class int, asks boolean, place int, node binary, label binary, n bigint"
    )


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs `(a, b)` of `(node, label, shingles)` with different labels: all that can be linked, and few more."""
    found = materialise(prefixes(sets, percent), "prefixes")
    keys = ["token", "class"]
    # The commonest label of a key; a key with one label, or without both sides, has no pairs.
    per_label = found.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("rows"), F.max("asks").alias("asked"), F.min("asks").alias("unanswered")
    )
    mixed = per_label.groupBy(*keys).agg(
        F.max(F.struct("rows", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("labels"),
        F.max("asked").alias("asked"), F.min("unanswered").alias("unanswered"),
    ).where("labels > 1 and asked and not unanswered")
    rows, n_rows = materialise_counted(
        found.join(mixed.select(*keys, "main"), keys).withColumn("main", F.col("label") == F.col("main")), "prefix-rows"
    )
    asking = rows.where("asks").select(*keys, "main", F.col("node").alias("a"), F.col("label").alias("l"), F.col("n"), F.col("place").alias("i"))
    answering = rows.where("not asks").select(*keys, F.col("main").alias("_main"), F.col("node").alias("b"), F.col("label").alias("o"), F.col("n").alias("m"), F.col("place").alias("j"))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        joined = salted_join(left, right, keys, "inner", ["a"], at_most=n_rows, rows_per_split=KEY_ROWS)
        room = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
        return joined.where(
            (F.col("l") != F.col("o")) & ((F.col("n") > F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") > F.col("b"))))
            & (room * F.lit(100 + percent) >= F.lit(percent) * (F.col("n") + F.col("m")))
        ).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    others = met(asking.where("not main"), answering)
    return others.unionByName(met(asking.where("main"), answering.where("not _main"))).distinct()


def _settled(rest: DataFrame, asked: _Asked) -> None:
    """Find every link between the components of buckets `(key, node, n)` that are still open."""
    now, n_open = _open(rest, asked.labels)
    if n_open:
        left = materialise(now.select("node", "label").distinct(), "unsettled")
        asked.compare(prefix_pairs(materialise(left.join(asked.sets, "node"), "unsettled-sets"), asked.percent))


def _exhausted(rest: DataFrame, asked: _Asked) -> None:
    """Decide every pair of `rest` (key, node, n) that shares a key."""
    draws, turn = 1, 0
    while True:
        now, n_open = _open(rest, asked.labels)
        if not n_open:
            return
        # One centre of each component at least, `draws` on average; a window would gather a component.
        place = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20))
        drawn = now.groupBy("key", "label").agg(
            F.count(F.lit(1)).alias("own"), F.max(F.struct(place.alias("p"), F.col("node").alias("b"))).alias("c")
        )
        chosen = (place * F.col("own") < F.lit(draws << 20)) | (F.col("node") == F.col("c.b"))
        centres = materialise(
            now.join(drawn, ["key", "label"]).where(chosen)
            .select("key", F.col("node").alias("b"), F.col("label").alias("l"), F.col("n").alias("m")),
            "centres",
        )
        pairs = (
            now.join(centres, "key").where("label <> l").where(_similar_sizes(asked.percent))
            .select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
        )
        asked.compare(pairs)
        rest = now.select("key", "node", "n").join(
            centres.select("key", F.col("b").alias("node")), ["key", "node"], "left_anti"
        )
        draws, turn = draws * GROWTH, turn + 1


def near_duplicates(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    rounds: int = ROUNDS,
    exhaustive: bool = False,
    row_key: Column | None = None,
) -> DataFrame:
    """`(doc_id, n_shingles, component_id, kept)`, one row for every row of `docs`.

    A `row_key` (64-bit) of the rows comes back as a column, for tables that repeat an id.
    """
    table = materialise(signed(docs, words, bands, rows, row_key), "signed")
    linked = table.where("node is not null and doc_id is not null")
    classes = materialise(
        linked.groupBy("node").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
        ),
        "classes",
    )
    met = classes.select("node", "n", F.posexplode("bands").alias("i", "key"))
    shared = met.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = met.join(shared, "key").select("key", "i", "node", "n", "size")
    members = materialise(members, "members")
    score = materialise(members.groupBy("node").agg(F.sum("size").alias("score")), "scores")
    # The full sets only of classes that meet another one.
    wanted = classes.join(score, "node").select("rep").distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text")
    sets = materialise(_sets(texts.join(wanted, "rep", "left_semi").select("text"), words), "sets")
    asked = _Asked(sets, percent)
    rest = members
    for turn in range(rounds):
        if turn:
            # Only buckets that still hold several components are split and drawn again.
            rest, n_open = _open(rest, asked.labels)
            if not n_open:
                break
            other = classes.select("node", F.col("bands").alias("_bands"))
            rows_now = materialise(
                rest.join(score, "node")
                .join(other, "node")
                .withColumn("key", F.xxhash64("key", F.get("_bands", (F.col("i") + turn * 7) % F.lit(bands))))
                .drop("_bands"),
                "split",
            )
        else:
            rows_now = members.join(score, "node").withColumn("label", F.col("node"))
        # In later rounds another member may be the better centre: draw by a hash of the round.
        order = F.struct(
            (F.col("score") if turn % 2 == 0 else F.xxhash64("node", F.lit(turn))).alias("o"), F.col("node").alias("b")
        )
        centres = rows_now.groupBy("key").agg(
            F.max(F.struct(order.alias("o"), F.col("label").alias("l"), F.col("n").alias("m"))).alias("c"),
            F.min("label").alias("lo"), F.max("label").alias("hi"),
        ).where("lo <> hi").select("key", F.col("c.o.b").alias("b"), F.col("c.l").alias("l"), F.col("c.m").alias("m"))
        edges = (
            rows_now.join(centres, "key")
            .where("label <> l")
            .where(_similar_sizes(percent))
            .select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
        )
        if not asked.compare(edges) and turn:
            break
    rest = rest.select("key", "node", "n")
    large = _finished(rest, asked)
    if exhaustive:
        _exhausted(rest, asked)
    else:
        _settled(large, asked)
    named = classes.select("node", "rep").join(asked.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = materialise(named.join(least, "label").select("node", "component_id"), "named")
    carried = ["row_key"] if row_key is not None else []
    return (
        table.select("doc_id", *carried, "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
        .join(named, "node", "left")
        .select("doc_id", *carried, "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def oracle(words: int, percent: int) -> str:
    """Links by counting common shingles of all pairs that share one, and reachability; for small tables."""
    return rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {words} THEN [array_to_string(words, ' ')]
      ELSE list_transform(range(len(words) - {words - 1}), lambda i: array_to_string(words[i + 1 : i + {words}], ' ')) END) AS s
    FROM split
  ) every
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common.n >= {percent} * (x.n + y.n - common.n)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b
), least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT split.doc_id, coalesce(sizes.n, 0) AS n_shingles, least(split.doc_id, coalesce(m, split.doc_id)) AS component_id,
  split.doc_id <= coalesce(m, split.doc_id) AS kept
FROM split LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.a = split.doc_id
"""
