"""A prefix trie over conversations, in balanced parentheses.

Conversations are rebuilt first: the first `h` turns of the conversation that opens their block
of `BLOCK`, then their own turns after their first `h`, where h is a checksum of the id modulo
`HEADS`. A node is a distinct sequence of first turns (role, text).

1. A turn is a digest and a word count from here on. The name of a node is made of running
   sums of hashes of (place, digest), so no conversation is gathered, however long it is.
2. Nodes of one conversation only (most of them) have known values and are written at once.
   For the others, every conversation is the path of its shared nodes; equal paths are one row.
3. Paths are dealt out by range, so that subtrees lie together. A shard of `SHARD_PATHS` paths
   becomes a sequence of parentheses (`Parentheses`): range minima and maxima of the excess
   in blocks find where a subtree ends, the rank of leaf pairs counts its leaves, cumulative
   arrays give its savings. Private continuations of a path are one weighted leaf pair.
4. Nodes on the spine between two shards come out of both. A spine node belongs to the first
   shard that holds it; a leaf that goes on in the next shard is none. So the parts just add up.
5. The ids that end at a node are joined in order, piece by piece, and hashed as a stream.

Defined cases: rows without conv_id take no part. Null turns come first; equal turns of a
conversation are ordered by the digest of their role and text, and rows that repeat are turns
of their own. Null roles and texts are empty. Words are runs without white space. An empty table
has no root and gives an empty result. Other columns are not read. One row holds the shared part
of one conversation's path: 32 bytes and a few numbers for each turn that it shares.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusatlas.operators.ordered import numbered, running
from corpusatlas.operators.skew import salted_join
from corpusatlas.session import materialise, materialise_counted

#: Conversations of one block share the turns of its first; up to HEADS - 1 of them.
BLOCK, HEADS = 20, 4
SHARD_PATHS = 200_000
#: Parentheses in a block of the range min-max tree.
EXCESS_BLOCK = 64
#: Characters of a node's name, and of joined ids in a piece.
_NAME, PIECE_CHARS = 32, 1 << 16
_HALVES = ("k1", "k2", "k3", "k4")
_BIG = np.int64(1) << 60


class Parentheses:
    """Balanced parentheses as steps of +1 and -1, with a range min-max tree over blocks of excess."""

    def __init__(self, steps: np.ndarray, block: int = EXCESS_BLOCK):
        self.block = block
        n_blocks = 1
        while n_blocks * block < len(steps):
            n_blocks *= 2
        self.n_blocks = n_blocks
        excess = np.cumsum(steps, dtype=np.int64)
        self.excess = np.concatenate([excess, np.full(n_blocks * block - len(steps), _BIG)])
        by_block = self.excess.reshape(n_blocks, block)
        self.least = np.empty(2 * n_blocks, dtype=np.int64)
        self.most = np.empty(2 * n_blocks, dtype=np.int64)
        self.least[n_blocks:], self.most[n_blocks:] = by_block.min(axis=1), by_block.max(axis=1)
        at = n_blocks
        while at > 1:
            pairs = slice(at, 2 * at)
            self.least[at // 2 : at] = self.least[pairs].reshape(-1, 2).min(axis=1)
            self.most[at // 2 : at] = self.most[pairs].reshape(-1, 2).max(axis=1)
            at //= 2

    def _scan(self, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first place from `at` on, in its block, whose excess is the target; -1 if there is none."""
        found = np.full(len(at), -1, dtype=np.int64)
        active, here = np.arange(len(at)), at.copy()
        stop = (at // self.block + 1) * self.block
        while len(active):
            hit = self.excess[here[active]] == target[active]
            found[active[hit]] = here[active[hit]]
            active = active[~hit]
            here[active] += 1
            active = active[here[active] < stop[active]]
        return found

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The closing parenthesis of every opening one."""
        target = self.excess[opens] - 1
        found = np.full(len(opens), -1, dtype=np.int64)
        # An opening parenthesis at the end of its block has no rest to scan.
        inside = np.flatnonzero((opens + 1) % self.block)
        found[inside] = self._scan(opens[inside] + 1, target[inside])
        rest = np.flatnonzero(found < 0)
        node, wanted = self.n_blocks + opens[rest] // self.block, target[rest]
        climbing = np.arange(len(rest))
        while len(climbing):
            here = node[climbing]
            beside = here ^ 1
            # Steps are of one, so a block whose range holds the target reaches it.
            holds = (here % 2 == 0) & (self.least[beside] <= wanted[climbing]) & (wanted[climbing] <= self.most[beside])
            node[climbing] = np.where(holds, beside, here >> 1)
            climbing = climbing[~holds]
        while True:
            inner = np.flatnonzero(node < self.n_blocks)
            if not len(inner):
                break
            left = 2 * node[inner]
            holds = (self.least[left] <= wanted[inner]) & (wanted[inner] <= self.most[left])
            node[inner] = np.where(holds, left, left + 1)
        found[rest] = self._scan((node - self.n_blocks) * self.block, wanted)
        return found


def block_of(conv_id: Column) -> Column:
    return conv_id - conv_id % F.lit(BLOCK)


def n_heads(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % F.lit(HEADS)).cast("int")


@dataclass
class Rebuilt:
    """Rebuilt turns `(c, d, item, words)`, their number at most, and conversations `(c, length)`."""

    turns: DataFrame
    at_most: int
    conversations: DataFrame


def rebuilt(turns: DataFrame) -> Rebuilt:
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    item = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    # From here on a turn is its digest and its number of words.
    slim, n = materialise_counted(
        turns.where("conv_id is not null").select(
            F.col("conv_id").cast("bigint").alias("c"), "turn", F.unhex(item).alias("item"), words.cast("bigint").alias("words")
        ),
        "turns",
    )
    placed = materialise(numbered(slim, ["c"], ["turn", "item"], "pos", at_most=n), "places").select("c", "pos", "item", "words")
    c, h = F.col("c"), n_heads(F.col("c"))
    heads = placed.where((c % BLOCK == 0) & (F.col("pos") < HEADS)).select(c.alias("base"), F.col("pos").alias("d"), "item", "words")
    n_base = heads.groupBy("base").agg(F.max("d").alias("n_base"))
    # At most BLOCK conversations on either side of zero belong to one base.
    every = placed.groupBy("c").agg(F.max("pos").alias("n_own")).withColumns({"base": block_of(c), "h": h})
    every = every.join(n_base, "base", "left").withColumn("n_head", F.least("h", F.coalesce("n_base", F.lit(0))))
    conversations = materialise(
        every.select("c", "base", "h", (F.col("n_head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("length")),
        "conversations",
    )
    begun = conversations.where("h > 0").join(heads, "base").where("d <= h").select("c", "d", "item", "words")
    own = salted_join(
        placed.where(F.col("pos") > h).withColumn("base", block_of(c)), n_base, ["base"], "left",
        spread_by=["c", "pos"], at_most=n,
    )
    place = F.col("pos") - h + F.least(h, F.coalesce("n_base", F.lit(0)))
    return Rebuilt(
        begun.unionByName(own.select("c", place.alias("d"), "item", "words")), HEADS * n, conversations.select("c", "length")
    )


def _name(depth: Column, sums: list[Column]) -> Column:
    return F.md5(F.concat_ws(",", depth.cast("string"), *(s.cast("string") for s in sums)).cast("binary"))


ROOT = hashlib.md5(",".join(["0"] * (1 + len(_HALVES))).encode()).hexdigest()


def steps(turns: Rebuilt) -> DataFrame:
    """`(c, d, node, parent, words, ended)`: one row for each turn of a rebuilt conversation."""
    one, other = F.xxhash64("item", "d"), F.xxhash64("d", F.lit("other"), "item")
    low = F.lit((1 << 32) - 1)
    parts = [F.shiftrightunsigned(one, 32), one.bitwiseAND(low), F.shiftrightunsigned(other, 32), other.bitwiseAND(low)]
    # Halves of 64 bits, so that two thousand million turns of one conversation add up without overflow.
    rows = turns.turns.select("c", "d", "words", *(p.alias(f"_{k}") for p, k in zip(parts, _HALVES)))
    summed = running(
        rows, ["c"], ["d"],
        {k: ("sum", F.col(f"_{k}")) for k in _HALVES} | {"n": ("sum", F.lit(1).cast("bigint"))},
        totals=["n"], at_most=turns.at_most,
    )
    d = F.col("d").cast("bigint")
    return summed.select(
        "c", d.alias("d"), _name(d, [F.col(k) for k in _HALVES]).alias("node"),
        _name(d - 1, [F.col(k) - F.col(f"_{k}") for k in _HALVES]).alias("parent"),
        "words", (d == F.col("n_total")).alias("ended"),
    )


_NODE = (
    "node string, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, spine boolean"
)


def shard_nodes(table: pa.Table, before: int, after: int, n_all: int, least: int) -> pa.Table:
    """The nodes of one shard's paths `(key, words, ns, firsts, tails)`, with this shard's part of their values.

    The first path shares `before` nodes with the shard before, the last one `after` nodes with the next.
    """
    table = table.take(pc.sort_indices(table["key"]))
    names, words, convs, firsts, depths, parents = [ROOT], [0], [n_all], [least], [0], [-1]
    paren, node_at, weight_at, weights = [1], [0], [], []
    tails_of = np.zeros(0, dtype=np.int64)
    stack, tails = [0], {}
    spine_first = {0}
    for row, (key, own_words, own_ns, own_firsts, n_tails) in enumerate(
        zip(*(table[c].to_pylist() for c in ("key", "words", "ns", "firsts", "tails")))
    ):
        path = [key[i : i + _NAME] for i in range(0, len(key), _NAME)]
        common = 0
        while common < len(path) and common + 1 < len(stack) and names[stack[common + 1]] == path[common]:
            common += 1
        paren += [-1] * (len(stack) - 1 - common)
        del stack[common + 1 :]
        for depth in range(common, len(path)):
            number = len(names)
            names.append(path[depth])
            words.append(own_words[depth])
            convs.append(own_ns[depth])
            firsts.append(own_firsts[depth])
            depths.append(depth + 1)
            parents.append(stack[-1])
            if row == 0 and depth < before:
                spine_first.add(number)
            node_at.append(len(paren))
            paren.append(1)
            stack.append(number)
        if n_tails:
            # Private continuations: one leaf pair that counts for all of them.
            weight_at.append(len(paren))
            weights.append(n_tails)
            tails[stack[-1]] = n_tails
            paren += [1, -1]
    spine_last = set(stack[: after + 1])
    paren += [-1] * len(stack)
    steps_ = np.array(paren, dtype=np.int8)
    opens = np.array(node_at, dtype=np.int64)
    close = Parentheses(steps_).find_close(opens)
    n = len(names)
    owned = np.ones(n, dtype=bool)
    # What the shard before holds too is counted there; the first shard owns the root.
    owned[list(spine_first if before >= 0 else ())] = False
    goes_on = np.zeros(n, dtype=bool)
    goes_on[list(spine_last if after >= 0 else ())] = True
    leaf = np.zeros(len(steps_), dtype=np.int64)
    pairs = steps_[opens + 1] == -1
    leaf[opens[pairs & ~goes_on]] = 1
    leaf[weight_at] = weights
    rank = np.cumsum(leaf)
    convs_, words_ = np.array(convs, dtype=np.int64), np.array(words, dtype=np.int64)
    gain = np.zeros(len(steps_), dtype=np.int64)
    gain[opens] = np.where(owned, (convs_ - 1) * words_, 0)
    total = np.cumsum(gain)
    children = np.zeros(n, dtype=np.int64)
    inner = np.array(parents[1:], dtype=np.int64)
    np.add.at(children, inner, owned[1:].astype(np.int64))
    for number, n_tails in tails.items():
        children[number] += n_tails
    firsts_ = np.array(firsts, dtype=np.int64)
    parent_first = pa.array([None, *firsts_[inner].tolist()], pa.int64())
    return pa.table(
        {
            "node": pa.array(names, pa.string()), "conv_id": pa.array(firsts_), "depth": pa.array(np.array(depths, np.int64)),
            "parent_conv_id": parent_first, "n_convs": pa.array(convs_), "n_children": pa.array(children),
            "n_leaves": pa.array(rank[close] - rank[opens] + leaf[opens]),
            "saved_tokens": pa.array(total[close] - total[opens] + gain[opens]), "spine": pa.array(~owned | goes_on),
        }
    )


def _bounds(dealt: DataFrame) -> dict[int, tuple[int, int]]:
    """For every shard the nodes that its first path shares with the shard before and its last with the next.

    One row for each shard; -1 where there is no neighbour.
    """
    ends = dealt.groupBy("shard").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    in_order = Window.orderBy("shard")

    def parts(key: str) -> Column:
        return F.regexp_extract_all(F.col(key), F.lit(f".{{{_NAME}}}"), F.lit(0))

    cut = ends.select(
        "shard", parts("low").alias("low"), parts("high").alias("high"),
    ).select("shard", "low", "high", F.lag("high").over(in_order).alias("above"), F.lead("low").over(in_order).alias("below"))

    def common(a: str, b: str) -> Column:
        same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
        first = F.array_position(same, F.lit(False))
        return F.coalesce(F.when(first == 0, F.size(same)).otherwise(first - 1), F.lit(-1)).cast("int")

    found = cut.select("shard", common("above", "low").alias("before"), common("high", "below").alias("after"))
    return {r.shard: (r.before, r.after) for r in found.collect()}


def _shared_nodes(paths: DataFrame, n_all: int, least: int, shard_paths: int) -> DataFrame:
    """The nodes of paths `(key, words, ns, firsts, tails)`, whole."""
    paths, n_paths = materialise_counted(paths, "paths")
    dealt = materialise(
        paths.repartitionByRange(max(1, -(-n_paths // shard_paths)), "key").withColumn("shard", F.spark_partition_id()), "shards"
    )
    bounds = _bounds(dealt)

    def encode(key: tuple, table: pa.Table) -> pa.Table:
        return shard_nodes(table, *bounds[key[0].as_py()], n_all, least)

    found = materialise(dealt.groupBy("shard").applyInArrow(encode, _NODE), "nodes")
    parts = ["n_children", "n_leaves", "saved_tokens"]
    same = ["conv_id", "depth", "parent_conv_id", "n_convs"]
    merged = found.where("spine").groupBy("node").agg(
        *(F.first(s).alias(s) for s in same), *(F.sum(p).alias(p) for p in parts)
    )
    return found.where("not spine").select("node", *same, *parts).unionByName(merged)


def _ends(rows: DataFrame) -> DataFrame:
    """`(node, ends_sha256)` of `(node, c)`: the ids in order, hashed without holding them."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, start, size = None, [], 0, 0

        def piece() -> pa.RecordBatch:
            columns = [[node], [start], [",".join(held)]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()))], names=["node", "start", "ids"]
            )

        for batch in batches:
            for name, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (name != node or size > PIECE_CHARS):
                    yield piece()
                    held, size = [], 0
                if not held:
                    node, start = name, number
                held.append(str(number))
                size += len(held[-1]) + 1
        if held:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
                if name != node:
                    if state:
                        yield done()
                    node, state = name, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
        if state:
            yield done()

    pieces = rows.repartitionByRange("node", "c").sortWithinPartitions("node", "c").select("node", "c").mapInArrow(
        join, "node string, start bigint, ids string"
    )
    return pieces.repartition("node").sortWithinPartitions("node", "start").mapInArrow(digest, "node string, ends_sha256 string")


def prefix_trie(turns: DataFrame, shard_paths: int = SHARD_PATHS) -> DataFrame:
    """One row for each node of `(conv_id, turn, role, text)`; see the contract's columns."""
    conversation = rebuilt(turns)
    n_all, least = conversation.conversations.select(F.count("c"), F.min("c")).first()
    walked = materialise(steps(conversation), "steps")
    # Nodes of several conversations, and the root.
    several = walked.groupBy("node").agg(F.count("c").alias("n"), F.min("c").alias("first")).where("n > 1")
    root = turns.sparkSession.createDataFrame([(ROOT, n_all, least)], "node string, n bigint, first bigint").where("n > 0")
    shared = materialise(several.unionByName(root), "shared")
    bound = conversation.at_most
    told = materialise(salted_join(walked, shared, ["node"], "left", spread_by=["c"], at_most=bound), "told")
    nothing = hashlib.sha256(b"").hexdigest()

    alone = salted_join(
        told.where("n is null").drop("n", "first", "node", "words"),
        shared.select(F.col("node").alias("parent"), F.col("first").alias("parent_first")),
        ["parent"], "left", spread_by=["c"], at_most=bound,
    )
    one, c = F.lit(1).cast("bigint"), F.col("c")
    private = alone.select(
        c.alias("conv_id"), F.col("d").alias("depth"), F.coalesce("parent_first", c).alias("parent_conv_id"),
        one.alias("n_convs"), F.when(F.col("ended"), 0).otherwise(1).cast("bigint").alias("n_children"), one.alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(F.col("ended"), F.sha2(c.cast("string"), 256)).otherwise(nothing).alias("ends_sha256"),
    )

    step = F.struct("d", "node", "words", "n", "first")
    path = F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), step)))
    walks = told.groupBy("c").agg(path.alias("path"), F.max(F.col("n").isNull().cast("bigint")).alias("tail"))
    paths = walks.select(
        F.array_join(F.transform("path", lambda s: s["node"]), "").alias("key"),
        F.transform("path", lambda s: s["words"]).alias("words"), F.transform("path", lambda s: s["n"]).alias("ns"),
        F.transform("path", lambda s: s["first"]).alias("firsts"), F.col("tail").alias("tails"),
    )
    # The root has a path of its own even if no conversation has a turn.
    none = F.array().cast("array<bigint>")
    start = root.select(F.lit("").alias("key"), none.alias("words"), none.alias("ns"), none.alias("firsts"), F.lit(0).cast("bigint").alias("tails"))
    distinct = paths.unionByName(start).groupBy("key").agg(
        F.first("words").alias("words"), F.first("ns").alias("ns"), F.first("firsts").alias("firsts"), F.sum("tails").alias("tails")
    )
    nodes = _shared_nodes(distinct, n_all, least, shard_paths)
    turnless = conversation.conversations.where("length = 0").select(F.lit(ROOT).alias("node"), "c")
    ends = _ends(told.where("ended and n is not null").select("node", "c").unionByName(turnless))
    common = nodes.join(ends, "node", "left").select(
        *(private.columns[:-1]), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")
    )
    return common.unionByName(private)


ORACLE_SQL = rf"""
WITH named AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT c, role, text, row_number() OVER (
    PARTITION BY c ORDER BY turn NULLS FIRST, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text)
  ) AS pos FROM named
), ids AS (SELECT DISTINCT c FROM placed
), sums AS (
  -- CRC-32 of the decimal id, bit by bit.
  SELECT c, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(c AS VARCHAR)) + 1),
      lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT))),
    lambda acc, x: list_reduce(list_prepend(xor(acc, x), CAST(range(8) AS BIGINT[])),
      lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)
  ) AS crc FROM ids
), heads AS (
  SELECT c, c - c % {BLOCK} AS base, CAST(xor(crc, 4294967295) % {HEADS} AS BIGINT) AS h FROM sums
), turns AS (
  SELECT heads.c, 0 AS part, pos, role, text FROM heads JOIN placed ON placed.c = base WHERE pos <= h
  UNION ALL
  SELECT heads.c, 1, pos, role, text FROM heads JOIN placed ON placed.c = heads.c WHERE pos > h
), whole AS (
  SELECT ids.c, coalesce(any_value(t.path), []) AS path, coalesce(any_value(t.words), []) AS words FROM ids LEFT JOIN (
    SELECT c, list(sha256(CAST(length(role) AS VARCHAR) || ':' || role || text) ORDER BY part, pos) AS path,
      list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY part, pos) AS words
    FROM turns GROUP BY c
  ) t ON t.c = ids.c GROUP BY ids.c
), prefixes AS (
  SELECT c, path[1 : d] AS node, d, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS w, d = len(path) AS ended
  FROM (SELECT c, path, words, unnest(range(len(path) + 1)) AS d FROM whole) every
), nodes AS (
  SELECT node, d, min(c) AS conv_id, count(*) AS n, any_value(w) AS w,
    coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ended), '') AS ends
  FROM prefixes GROUP BY node, d
), children AS (
  SELECT node[1 : d - 1] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY node[1 : d - 1]
), told AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)
), below AS (
  SELECT node[1 : k] AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n - 1) * w) AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS k FROM told) every GROUP BY node[1 : k]
)
SELECT told.conv_id, CAST(told.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(told.n AS BIGINT) AS n_convs,
  CAST(told.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(told.ends) AS ends_sha256
FROM told JOIN below USING (node) LEFT JOIN told up ON told.d > 0 AND up.node = told.node[1 : told.d - 1]
"""
