"""Repeated byte strings across documents, removed by suffix buckets and a cover sample.

Only the first `length` bytes of a suffix decide whether it repeats, so suffixes are
ordered to that depth and no further. Work goes block by block (texts of a bounded number
of bytes) and bucket by bucket (suffixes of one range of keys), so a task holds one block
or one bucket.

1. Cover sample. The offsets of a text that fall into a difference cover modulo 31 are six
   in 31, and any two equal strings of `length` bytes, wherever they start, have a sampled
   offset in common within their first 31 bytes. The 20 bytes at every sampled offset are
   fingerprinted and ordered bucket by bucket, which tells by one bit each which samples
   another block has too. No ranks are computed.
2. Suffix buckets. A suffix can only tie with one of another document to the full depth if
   one of the samples in its first 31 bytes is in another block or in several texts of its own. These alone are
   dealt out to buckets. A bucket is ordered by suffix key and then by document, which
   resolves its ties: the first document of a tie keeps its bytes, the later ones lose them.
3. Every block gets one bit for each of its keys back, and covers the bytes.

Keys stand for bytes: 40 bits for a sample, which only chooses candidates; for a full suffix
an independent hash for the bucket and 50 bits more than the logarithm of the number of
buckets, 64 at most.

Texts that are equal to the last byte need no suffixes. Within an Arrow batch one of them
carries the text, the others only their length; within a block one is compared for all.

Defined cases: a null text is an empty one; a row with a null id keeps all its bytes and
takes none from others; rows that repeat an id do not affect each other; texts shorter than
`length` stay; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusatlas.llm import textarrays as ta

LENGTH = 50
BLOCK_BYTES = 3 << 20
BUCKET_BYTES = 12 << 20
#: Copies of one text that may meet in one block, one for each Arrow batch.
COPIES_PER_BLOCK = 64
#: A perfect difference set; every distance modulo 31 occurs once.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_U = np.uint64
_NONE = np.iinfo(np.int64).min
_BITS = "block bigint, level int, bucket int, bits binary"


def packed(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed; sorted ones should be given as differences."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize)
    return pa.compress(np.ascontiguousarray(planes.T).tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int, kind=_U) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob, n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(n)


def _differences(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=_U(0))


class Block:
    """The distinct texts of one block in the order of their documents."""

    def __init__(self, table: pa.Table, length: int):
        self.length = length
        ids = table["doc_id"].combine_chunks()
        self.row_ids = np.asarray(pc.fill_null(ids, _NONE).to_numpy(zero_copy_only=False), dtype=np.int64)
        self.carried = table["carried"].to_numpy()
        self.n_bytes = table["n_bytes"].to_numpy()
        bounds = np.concatenate([[0], np.cumsum(np.where(self.carried, self.n_bytes, 0))])
        raw = np.frombuffer(
            b"".join(
                pa.decompress(text, int(n), codec="zstd", asbytes=True)
                for text, n in zip(table["text"].to_pylist(), self.n_bytes) if text is not None
            ),
            np.uint8,
        )
        self.raw, self.bounds = raw, bounds
        holders: dict[bytes, int] = {}
        self.same_as = np.full(len(ids), -1, dtype=np.int64)
        chosen = []
        for row in np.argsort(self.row_ids, kind="stable"):
            if self.row_ids[row] == _NONE or not self.carried[row] or self.n_bytes[row] < length:
                continue
            text = raw[bounds[row] : bounds[row + 1]].tobytes()
            if text in holders:
                self.same_as[row] = holders[text]
            else:
                holders[text] = row
                chosen.append(row)
        del holders
        self.rows = np.array(chosen, dtype=np.int64)
        self.ids = self.row_ids[self.rows]
        sizes = (bounds[1:] - bounds[:-1])[self.rows]
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.data = (
            np.concatenate([raw[bounds[r] : bounds[r + 1]] for r in chosen]) if chosen else np.zeros(0, np.uint8)
        )
        self.text_of = np.repeat(np.arange(len(chosen), dtype=np.int32), sizes)

    def samples(self, hashing: ta.RangeHash) -> None:
        """Sorted distinct sample keys, their positions and the classes that hold two documents."""
        depth = self.length - PERIOD + 1
        self.prefix = hashing.prefix(self.data)
        at = np.arange(len(self.data), dtype=np.int64)
        start = self.offsets[:-1][self.text_of]
        end = self.offsets[1:][self.text_of]
        self.at = at[_IN_COVER[(at - start) % PERIOD] & (at + depth <= end)]
        keys = hashing.of(self.prefix, self.at, self.at + depth) >> _U(24)
        # Nothing asks for an order among equal keys.
        order = np.argsort(keys)
        self.at, keys = self.at[order], keys[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        self.keys = keys[first]
        self.of_key = np.cumsum(first) - 1
        begins = np.flatnonzero(first)
        if len(begins):
            owner = self.ids[self.text_of[self.at]]
            self.several = np.minimum.reduceat(owner, begins) != np.maximum.reduceat(owner, begins)
        else:
            self.several = np.zeros(0, bool)

    def suffixes(self, shared: np.ndarray, hashing: ta.RangeHash, other: ta.RangeHash, buckets: int) -> None:
        """Candidate suffixes by (bucket, key), and the first document of every distinct one."""
        at = np.sort(self.at[(shared | self.several)[self.of_key]])
        begin = self.offsets[:-1][self.text_of[at]] if len(at) else at
        edges = np.zeros(len(self.data) + 1, dtype=np.int32)
        np.add.at(edges, np.maximum(at - (PERIOD - 1), begin), 1)
        np.add.at(edges, at + 1, -1)
        candidate = np.cumsum(edges[:-1]) > 0
        where = np.flatnonzero(candidate)
        del edges, candidate
        where = where[where + self.length <= self.offsets[1:][self.text_of[where]]] if len(where) else where
        bits = min(64, 50 + buckets.bit_length())
        keys = hashing.of(self.prefix, where, where + self.length) >> _U(64 - bits)
        if len(where):
            bucket = (other.of(other.prefix(self.data), where, where + self.length) >> _U(32)) * _U(buckets) >> _U(32)
        else:
            bucket = np.zeros(0, _U)
        # Few buckets are ordered by counting, in 16 bits; among equal keys no order is asked for.
        order = np.argsort(keys)
        order = order[np.argsort(bucket[order].astype(np.uint16 if buckets <= 1 << 16 else np.uint64), kind="stable")]
        self.where, keys, bucket = where[order], keys[order], bucket[order]
        if len(keys):
            first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (bucket[1:] != bucket[:-1])])
        else:
            first = np.zeros(0, bool)
        self.suffix_keys, self.suffix_buckets = keys[first], bucket[first].astype(np.int64)
        self.suffix_of = np.cumsum(first) - 1
        # Documents are in order of their ids, and positions in order of documents.
        earliest = np.minimum.reduceat(self.where, np.flatnonzero(first)) if len(keys) else self.where
        self.first_id = self.ids[self.text_of[earliest]] if len(keys) else np.zeros(0, np.int64)


def _per_bucket(buckets: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    bounds = np.searchsorted(buckets, np.arange(n + 1))
    for bucket in range(n):
        if bounds[bucket] < bounds[bucket + 1]:
            yield bucket, int(bounds[bucket]), int(bounds[bucket + 1])


def _sample_buckets(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys * _U(n)) >> _U(40)).astype(np.int64)


def _bits(answers: pa.Table, level: int, buckets: np.ndarray, n: int) -> np.ndarray:
    """The bits that came back for this block, in the order of its keys."""
    out = np.zeros(len(buckets), dtype=bool)
    given = {
        (lv, b): bits
        for lv, b, bits in zip(
            answers["level"].to_pylist(), answers["bucket"].to_pylist(), answers["bits"].to_pylist()
        )
    }
    for bucket, begin, end in _per_bucket(buckets, n):
        bits = given.get((level, bucket))
        if bits is not None:
            out[begin:end] = np.unpackbits(np.frombuffer(bits, np.uint8), count=end - begin).astype(bool)
    return out


def prepared(docs: DataFrame, length: int, blocks: int, salts: int) -> DataFrame:
    """`(block, doc_id, text, carried, n_bytes)`, texts compressed; later copies in a batch carry none."""

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(pc.fill_null(batch.column(1), _NONE).to_numpy(zero_copy_only=False), np.int64)
            sizes = batch.column(3).to_numpy(zero_copy_only=False)
            codes = batch.column(2).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            least = np.full(codes.max(initial=-1) + 1, np.iinfo(np.int64).max)
            known = ids != _NONE
            np.minimum.at(least, codes[known], ids[known])
            copy = known & (sizes >= length) & (ids > least[codes])
            codec = pa.Codec("zstd", compression_level=6)
            texts = [
                None if gone else codec.compress(text.as_buffer(), asbytes=True)
                for gone, text in zip(copy, batch.column(2))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.binary()), pa.array(~copy), batch.column(3)],
                names=["block", "doc_id", "text", "carried", "n_bytes"],
            )

    text = F.coalesce("text", F.lit(""))
    salt = F.pmod(F.spark_partition_id(), F.lit(salts))
    return docs.select(
        F.pmod(F.xxhash64(text, salt), F.lit(blocks)).cast("bigint").alias("block"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text.alias("text"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
    ).mapInArrow(collapse, "block bigint, doc_id bigint, text binary, carried boolean, n_bytes bigint")


def _rows(kind: pa.Schema, **columns) -> pa.Table:
    return pa.table({n: pa.array(columns[n], kind.field(n).type) for n in kind.names})


_KEYS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("n_ids", pa.int64()), ("ids", pa.binary()), ("owners", pa.binary())])
_KEYS_DDL = "block bigint, bucket int, n bigint, keys binary, n_ids bigint, ids binary, owners binary"
_ANSWER = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`(doc_id, n_bytes, n_removed, n_spans, kept)` for every row; `kept` are the bytes left."""
    if length <= PERIOD:
        raise ValueError(f"length must be above {PERIOD}")
    sizes = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    total, n_rows = sizes[0] or 0, sizes[1]
    blocks = max(1, -(-total // BLOCK_BYTES))
    buckets = max(1, -(-total // BUCKET_BYTES))
    salts = max(1, n_rows // (10_000 * COPIES_PER_BLOCK))
    texts = prepared(docs, length, blocks, salts).repartition("block")

    def sample_keys(table: pa.Table) -> pa.Table:
        block = Block(table, length)
        block.samples(ta.RangeHash(7))
        parts = list(_per_bucket(_sample_buckets(block.keys, buckets), buckets))
        return _rows(
            _KEYS,
            block=[table["block"][0].as_py()] * len(parts),
            bucket=[b for b, _, _ in parts],
            n=[e - s for _, s, e in parts],
            keys=[packed(_differences(block.keys[s:e])) for _, s, e in parts],
            n_ids=[None] * len(parts), ids=[None] * len(parts), owners=[None] * len(parts),
        )

    def bucket_keys(table: pa.Table) -> tuple[list[int], list[int], np.ndarray]:
        blocks_here, counts = table["block"].to_pylist(), table["n"].to_pylist()
        keys = [
            np.cumsum(unpacked(blob, n), dtype=_U) for blob, n in zip(table["keys"].to_pylist(), counts)
        ]
        return blocks_here, counts, np.concatenate(keys)

    def answers(table: pa.Table, level: int, flags: np.ndarray, blocks_here: list, counts: list) -> pa.Table:
        parts = np.split(flags, np.cumsum(counts)[:-1])
        return _rows(
            _ANSWER,
            block=blocks_here,
            level=[level] * len(parts),
            bucket=[table["bucket"][0].as_py()] * len(parts),
            bits=[np.packbits(p).tobytes() for p in parts],
        )

    def shared_samples(table: pa.Table) -> pa.Table:
        """A sample class is shared if two blocks have sent it; each sends a class once."""
        blocks_here, counts, keys = bucket_keys(table)
        order = np.sort(keys)
        twice = order[1:][order[1:] == order[:-1]]
        at = np.searchsorted(twice, keys)
        flags = np.zeros(len(keys), bool)
        inside = at < len(twice)
        flags[inside] = twice[at[inside]] == keys[inside]
        return answers(table, 1, flags, blocks_here, counts)

    def with_suffixes(table: pa.Table, replies: pa.Table) -> Block:
        hashing = ta.RangeHash(7)
        block = Block(table, length)
        block.samples(hashing)
        shared = _bits(replies, 1, _sample_buckets(block.keys, buckets), buckets)
        block.suffixes(shared, hashing, ta.RangeHash(9), buckets)
        return block

    def suffix_keys(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _KEYS.empty_table()
        block = with_suffixes(table, replies)
        parts = list(_per_bucket(block.suffix_buckets, buckets))
        owners = [np.unique(block.first_id[s:e], return_inverse=True) for _, s, e in parts]
        return _rows(
            _KEYS,
            block=[table["block"][0].as_py()] * len(parts),
            bucket=[b for b, _, _ in parts],
            n=[e - s for _, s, e in parts],
            keys=[packed(_differences(block.suffix_keys[s:e])) for _, s, e in parts],
            n_ids=[len(u) for u, _ in owners],
            ids=[packed(np.diff(u, prepend=np.int64(0))) for u, _ in owners],
            owners=[packed(at.astype(np.uint32)) for _, at in owners],
        )

    def first_documents(table: pa.Table) -> pa.Table:
        """Order a suffix bucket by key and document: a key is taken if an earlier document has it."""
        blocks_here, counts, keys = bucket_keys(table)
        ids = np.concatenate(
            [
                np.cumsum(unpacked(r["ids"], r["n_ids"], np.int64))[unpacked(r["owners"], r["n"], np.uint32)]
                for r in table.select(["n", "n_ids", "ids", "owners"]).to_pylist()
            ]
        )
        order = np.argsort(keys)
        keys, sorted_ids = keys[order], ids[order]
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        least = np.repeat(np.minimum.reduceat(sorted_ids, begins), np.diff(np.append(begins, len(keys))))
        flags = np.zeros(len(keys), bool)
        flags[order] = sorted_ids > least
        return answers(table, 2, flags, blocks_here, counts)

    out = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]
    )

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out.empty_table()
        block = with_suffixes(table, replies)
        taken = _bits(replies, 2, block.suffix_buckets, buckets)
        repeats = np.zeros(0, np.int64)
        if len(block.where):
            own = block.ids[block.text_of[block.where]]
            repeats = block.where[taken[block.suffix_of] | (own > block.first_id[block.suffix_of])]
        edges = np.zeros(len(block.data) + 1, dtype=np.int32)
        np.add.at(edges, repeats, 1)
        np.add.at(edges, repeats + length, -1)
        gone = np.cumsum(edges[:-1]) > 0
        n = table.num_rows
        removed, spans, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), [b""] * n
        place = np.full(n, -1, dtype=np.int64)
        place[block.rows] = np.arange(len(block.rows))
        for row in range(n):
            copy = not block.carried[row]
            like = block.same_as[row]
            if like >= 0 and block.row_ids[row] > block.row_ids[like]:
                copy = True
            if copy:
                removed[row], spans[row] = block.n_bytes[row], 1
                continue
            text = place[like if like >= 0 else row]
            if text < 0:
                kept[row] = block.raw[block.bounds[row] : block.bounds[row + 1]].tobytes()
                continue
            begin, end = block.offsets[text], block.offsets[text + 1]
            own = gone[begin:end]
            removed[row] = np.count_nonzero(own)
            spans[row] = np.count_nonzero(own[1:] & ~own[:-1]) + int(own[0])
            kept[row] = block.data[begin:end][~own].tobytes()
        return _rows(
            out, doc_id=[None if i == _NONE else i for i in block.row_ids.tolist()],
            n_bytes=block.n_bytes, n_removed=removed, n_spans=spans, kept=kept,
        )

    samples = texts.groupBy("block").applyInArrow(sample_keys, _KEYS_DDL)
    classes = samples.groupBy("bucket").applyInArrow(shared_samples, _BITS)
    suffixes = texts.groupBy("block").cogroup(classes.groupBy("block")).applyInArrow(suffix_keys, _KEYS_DDL)
    firsts = suffixes.groupBy("bucket").applyInArrow(first_documents, _BITS)
    replies = classes.union(firsts)
    return texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )
