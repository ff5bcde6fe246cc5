"""SentencePiece encoding over a relational lattice, and decoding.

A text becomes words at places that no piece of the vocabulary spans, so words can be
encoded one by one. Texts are read in chunks; a chunk is its distinct words, sorted, and its
texts as packed word numbers, so no text is shuffled. One exchange deals the words out by
a hash of the word and the numbers by chunk, in as many partitions as there are buckets of
words, so that a task holds the lattice of a few buckets. For every distinct word:

1. its substrings up to the longest piece are exploded,
2. an equi-join with the piece table (as large as the model file) keeps those that are
   pieces; a character that is no piece stays as an edge of its own,
3. the edges are grouped by word, which needs no further shuffle,
4. a higher-order aggregate folds them into one path.

Beside its paths a bucket reads its words again, as each chunk sent them, and answers every
chunk with one packed row of paths; a chunk looks up its numbers there.

The fold follows the kind of the model. A unigram model takes the path with the greatest sum
of scores (Viterbi: edges come by their end, the best path to every place is kept, equal
scores go to the longer last piece). The scores of a merge model are the ranks of its
merges, for which a greatest sum means nothing; its edges come by rank, and an edge is
merged if it joins two neighbours of what was merged so far. One pass is enough unless a
piece is only made by a merge of a worse rank than its own. Such pieces are found when the
model is read; words that hold one are merged step by step, outside the fold. Either way
the ids are those of the model's own library.

Characters without a piece become their UTF-8 bytes. Words above `LONGEST_WORD` characters
are encoded by the same rules in the task that reads the text, so that no row of the lattice
grows with a text.

Defined cases: null and empty texts have no pieces; a text that holds the space mark itself
is decoded with a space in its place; rows that repeat a document are each encoded; an
empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusatlas.llm.substring_dedup import packed, unpacked

#: Fixed value: stands for a space in pieces.
MARK = "▁"
#: The places of a word are bits of one number.
LONGEST_WORD = 62
CHUNK_BYTES = 6 << 20
#: A chunk is named by its partition and its number there, of 32 bits each.
_PARTITION_BITS = 32
#: What a character without a piece scores below the worst piece.
UNKNOWN_PENALTY = 10.0


@dataclass
class Vocabulary:
    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    texts: list[bytes]
    longest: int = 0
    unknown: float = 0.0
    words: str = ""
    merges: bool = False
    late: set[str] = field(default_factory=set)

    @classmethod
    def load(cls, model_file: str) -> Vocabulary:
        """Read a model whose texts are only escaped, with bytes for unknown characters."""
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as file:
            proto.ParseFromString(file.read())
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (
            rules.add_dummy_prefix and rules.escape_whitespaces and proto.trainer_spec.byte_fallback
        ):
            raise ValueError("only models with plain texts and byte fallback are read")
        model = SentencePieceProcessor(model_file=model_file)
        pieces, bytes_of, texts = {}, [0] * 256, []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                bytes_of[value] = i
                texts.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                texts.append(b"")
            else:
                pieces[piece] = (i, float(model.get_score(i)))
                texts.append(piece.replace(MARK, " ").encode())
        longest = max(map(len, pieces))
        unknown = min(score for _, score in pieces.values()) - UNKNOWN_PENALTY
        kind = proto.trainer_spec.model_type
        if kind not in (proto.trainer_spec.UNIGRAM, proto.trainer_spec.BPE):
            raise ValueError("only unigram and merge models are read")
        merges = kind == proto.trainer_spec.BPE
        return cls(
            pieces, bytes_of, texts, longest, unknown, _word_pattern(pieces), merges,
            _late(pieces) if merges else set(),
        )

    def frame(self, spark: SparkSession) -> DataFrame:
        ranked = sorted(self.pieces.items(), key=lambda x: -x[1][1])
        rank, rows, last = -1, [], None
        for piece, (number, score) in ranked:
            rank, last = (rank if score == last else rank + 1), score
            rows.append((piece, number, score, rank, piece in self.late))
        return spark.createDataFrame(rows, "piece string, id int, score double, rank bigint, late boolean")

    def encode_word(self, word: str) -> list[int]:
        return self._merged(word) if self.merges else self._best(word)

    def _id(self, piece: str) -> int:
        found = self.pieces.get(piece)
        return -ord(piece) - 1 if found is None else found[0]

    def _merged(self, word: str) -> list[int]:
        parts, _ = _merge(word, self.pieces)
        return [self._id(part) for part in parts]

    def _best(self, word: str) -> list[int]:
        """The path with the greatest sum of scores."""
        scores, back = [0.0], [(0, 0)]
        for end in range(1, len(word) + 1):
            top, choice = None, None
            for start in range(max(0, end - self.longest), end):
                found = self.pieces.get(word[start:end])
                if found is None and end - start == 1:
                    found = (-ord(word[start]) - 1, self.unknown)
                if found is not None and (top is None or scores[start] + found[1] > top):
                    top, choice = scores[start] + found[1], (start, found[0])
            scores.append(top)
            back.append(choice)
        ids, at = [], len(word)
        while at:
            at, piece = back[at]
            ids.append(piece)
        return ids[::-1]


def _merge(word: str, pieces: dict) -> tuple[list[str], list[float]]:
    """Merge neighbours, the best score first and from the left; the parts and the scores merged."""
    ends = list(range(1, len(word) + 1))
    before = list(range(-1, len(word) - 1))
    gone = [False] * (len(word) + 1)
    queue: list[tuple[float, int, int, int]] = []
    merged = []

    def offer(start: int) -> None:
        middle = ends[start]
        if middle < len(word):
            found = pieces.get(word[start : ends[middle]])
            if found is not None:
                heapq.heappush(queue, (-found[1], start, middle, ends[middle]))

    for start in range(len(word) - 1):
        offer(start)
    while queue:
        rank, start, middle, end = heapq.heappop(queue)
        if gone[start] or gone[middle] or ends[start] != middle or ends[middle] != end:
            continue
        merged.append(-rank)
        gone[middle], ends[start] = True, end
        if end < len(word):
            before[end] = start
        offer(start)
        if before[start] >= 0:
            offer(before[start])
    parts, at = [], 0
    while at < len(word):
        parts.append(word[at : ends[at]])
        at = ends[at]
    return parts, merged


def _late(pieces: dict) -> set[str]:
    """Pieces that are made after a merge of a worse score than their own.

    A piece is always made from the same parts in the same order, whatever stands around it,
    because nothing inside it has been joined to what is outside.
    """
    return {
        piece for piece, (_, score) in pieces.items()
        if (made := _merge(piece, pieces))[0] == [piece] and min(made[1], default=score) < score
    }


def _word_pattern(pieces: dict) -> str:
    """A pattern whose matches are words: runs of characters that pieces join, after marks.

    Characters that stand next to each other in a piece are of one group, and a word holds
    characters of one group only, so no piece reaches beyond it.
    """
    group: dict[str, str] = {}

    def root(c: str) -> str:
        while group.setdefault(c, c) != c:
            group[c] = group[group[c]]
            c = group[c]
        return c

    single = set()
    for piece in pieces:
        if MARK in piece.lstrip(MARK):
            raise ValueError("a mark inside a piece")
        bare = piece.lstrip(MARK)
        if len(piece) > 1 and bare:
            single.update(bare)
        for a, b in zip(bare, bare[1:]):
            group[root(a)] = root(b)
    members: dict[str, list[str]] = {}
    for c in sorted(single):
        members.setdefault(root(c), []).append(c)
    runs = sorted(members.values(), key=len, reverse=True)
    classes = ["[" + "".join(map(re.escape, run)) + "]" for run in runs]
    return "|".join(f"{MARK}*{c}+" for c in classes) + f"|{MARK}+|(?s:.)"


_CHUNK = pa.schema(
    [
        ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("n_words", pa.int64()),
        ("numbers", pa.binary()), ("digests", pa.list_(pa.binary())),
        ("own_words", pa.list_(pa.int32())), ("own_pieces", pa.list_(pa.list_(pa.int32()))),
    ]
)
_SENT = pa.schema([("dest", pa.int64()), ("chunk", pa.int64()), ("first", pa.int32()), ("data", pa.binary())])
_BREAK = "\n"


def chunks(docs: DataFrame, vocabulary: Vocabulary, buckets: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """`(dest, chunk, first, data)`, from about `chunk_bytes` of text at a time.

    For a bucket of words, dest is its number, data the sorted words and first the number of
    the first one in the chunk. For a chunk, dest is negative and data holds its texts as word
    numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = re.compile(shared.value.words).findall
        chunk = TaskContext.get().partitionId() << _PARTITION_BITS

        def numbered() -> defaultdict:
            """A word that is looked up first gets the next number."""
            index = defaultdict()
            index.default_factory = index.__len__
            return index

        def emit() -> pa.RecordBatch:
            own = [w for w in index if len(w) < 2 or len(w) > LONGEST_WORD or _BREAK in w]
            left = set(own)
            words = sorted(w for w in index if w not in left)
            bucket = np.fromiter((crc32(w.encode()) % buckets for w in words), np.int64, len(words))
            dealt = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[dealt], np.arange(buckets + 1))
            words = [words[i] for i in dealt.tolist()]
            order = np.empty(len(index), dtype=np.uint32)
            order[np.fromiter(map(index.__getitem__, chain(words, own)), np.int64, len(index))] = np.arange(len(index))
            flat = order[np.concatenate(numbers)] if numbers else np.zeros(0, np.uint32)
            row = [
                ids, sizes, len(index), packed(flat), digests, list(range(len(words), len(index))),
                [shared.value.encode_word(w) for w in own],
            ]
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, _CHUNK) as stream:
                stream.write_batch(
                    pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _CHUNK)], schema=_CHUNK)
                )
            sent = [(-1 - chunk, chunk, 0, out.getvalue().to_pybytes())]
            for dest in np.flatnonzero(np.diff(cuts)).tolist():
                low, high = int(cuts[dest]), int(cuts[dest + 1])
                sent.append((dest, chunk, low, _BREAK.join(words[low:high]).encode()))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*sent), _SENT)], schema=_SENT
            )

        index, ids, sizes, numbers, digests, held = numbered(), [], [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                marked = MARK + text.replace(" ", MARK) if text else ""
                found = split(marked)
                ids.append(doc_id)
                sizes.append(len(found))
                numbers.append(np.fromiter(map(index.__getitem__, found), np.uint32, len(found)))
                digests.append(hashlib.sha256(text.encode()).digest())
                held += len(text)
                if held >= chunk_bytes:
                    yield emit()
                    chunk += 1
                    index, ids, sizes, numbers, digests, held = numbered(), [], [], [], [], 0
        if ids:
            yield emit()
        # The worker goes on to other tasks; what this one held is given back to the system.
        del index, ids, sizes, numbers, digests
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        pack, "dest bigint, chunk bigint, first int, data binary"
    )


def lattice(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """`(dest, word, edges)` for `(dest, word)`: the pieces inside every word, ready to be folded.

    An edge of a unigram model is a struct that sorts by end and start. An edge of a merge
    model is one number that sorts by rank and start: rank, start (6 bits), length (6),
    late (1), no piece (1), id or code point (21).
    """
    pieces = vocabulary.frame(words.sparkSession)
    starts = words.withColumn("size", F.char_length("word")).withColumn(
        "start", F.explode(F.sequence(F.lit(0), F.col("size") - 1))
    )
    longest = F.least(F.lit(vocabulary.longest), F.col("size") - F.col("start"))
    cut = starts.withColumn("length", F.explode(F.sequence(F.lit(1), longest))).select(
        "dest", "word", "start", "length", F.substring("word", F.col("start") + 1, F.col("length")).alias("piece")
    )
    if vocabulary.merges:
        edge = F.expr(
            f"shiftleft(coalesce(rank, {len(vocabulary.pieces)}L), 35) | shiftleft(cast(start as bigint), 29) | "
            "shiftleft(cast(length as bigint), 23) | if(late, 4194304L, 0L) | if(id is null, 2097152L, 0L) | "
            "cast(coalesce(id, ascii(piece)) as bigint)"
        )
    else:
        edge = F.struct(
            (F.col("start") + F.col("length")).alias("end"), "start",
            F.coalesce("id", -F.ascii("piece") - 1).alias("id"),
            F.coalesce("score", F.lit(vocabulary.unknown)).alias("score"),
        )
    return (
        cut.join(F.broadcast(pieces), "piece", "left")
        .where(F.col("id").isNotNull() | (F.col("length") == 1))
        .select("dest", "word", edge.alias("edge"))
        .groupBy("dest", "word").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    )


def merged_path(edges: str) -> Column:
    """Merge the edges by rank; null if a piece of the word asks for more than one pass.

    The state is a number with a bit for every place that is still an end of a piece.
    """
    one = F.lit(1).cast("bigint")

    def field(e: Column, shift: int, bits: int) -> Column:
        return F.shiftright(e, shift).bitwiseAND((1 << bits) - 1).cast("int")

    def left(value: Column, by: Column) -> Column:
        return F.call_function("shiftleft", value, by)

    def ends(e: Column) -> Column:
        start = field(e, 29, 6)
        return left(one, start).bitwiseOR(left(one, start + field(e, 23, 6)))

    def inside(e: Column) -> Column:
        # length - 1 bits above the start
        return left(left(one, field(e, 23, 6) - 1) - 1, field(e, 29, 6) + 1)

    def step(s: Column, e: Column) -> Column:
        joins = (s.bitwiseAND(ends(e)) == ends(e)) & (F.bit_count(s.bitwiseAND(inside(e))) == 1)
        return F.when(joins, s.bitwiseAND(F.bitwise_not(inside(e)))).otherwise(s)

    def path(s: Column) -> Column:
        used = F.filter(edges, lambda e: (s.bitwiseAND(ends(e)) == ends(e)) & (s.bitwiseAND(inside(e)) == 0))
        by_start = F.array_sort(F.transform(used, lambda e: e.bitwiseAND((1 << 35) - 1)))
        ids = F.transform(
            by_start, lambda e: F.when(field(e, 21, 1) == 1, -field(e, 0, 21) - 1).otherwise(field(e, 0, 21))
        )
        return F.when(~F.exists(edges, lambda e: field(e, 22, 1) == 1), ids)

    return F.aggregate(edges, F.lit((1 << (LONGEST_WORD + 1)) - 1).cast("bigint"), step, path)


def best_path(edges: str) -> Column:
    """Viterbi: fold the edges, by their end, into the ids of the path with the best score."""
    path = "struct<score:double,ids:array<int>>"
    start = F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids"))
    state = F.struct(
        F.array(start).alias("done"), F.lit(None).cast(path).alias("best"), F.lit(1).alias("end")
    )

    def step(s: Column, e: Column) -> Column:
        # The first edge of the next end settles the best path to the last one.
        moved = e["end"] > s["end"]
        done = F.when(moved, F.array_append(s["done"], s["best"])).otherwise(s["done"])
        best = F.when(moved, F.lit(None).cast(path)).otherwise(s["best"])
        before = F.get(done, e["start"])
        score = before["score"] + e["score"]
        better = best.isNull() | (score > best["score"])
        new = F.struct(score.alias("score"), F.array_append(before["ids"], e["id"]).alias("ids"))
        return F.struct(done.alias("done"), F.when(better, new).otherwise(best).alias("best"), e["end"].alias("end"))

    return F.aggregate(edges, state, step, lambda s: s["best"]["ids"])


_PATHS = pa.schema(
    [
        ("dest", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("total", pa.int64()),
        ("counts", pa.binary()), ("ids", pa.binary()),
    ]
)


def _looked_up(shared):
    def look_up(sent: pa.Table, folded: pa.Table) -> pa.Table:
        """The paths of one bucket's words, one row for each chunk that holds some of them."""
        if not sent.num_rows or sent["dest"][0].as_py() < 0:
            return _PATHS.empty_table()
        words = folded["word"].to_pylist()
        lists = pa.concat_arrays(folded["ids"].chunks)
        again = np.flatnonzero(~lists.is_valid().to_numpy(zero_copy_only=False))
        added = [shared.value.encode_word(words[i]) for i in again]
        lists = pa.concat_arrays([lists, pa.array(added, lists.type)])
        index = {word: i for i, word in enumerate(words)}
        index.update((words[i], len(words) + k) for k, i in enumerate(again))
        count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(count)])[:-1]
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        rows = []
        for chunk, first, data in zip(sent["chunk"].to_pylist(), sent["first"].to_pylist(), sent["data"]):
            mine = data.as_py().decode().split(_BREAK)
            at = np.fromiter(map(index.__getitem__, mine), np.int64, len(mine))
            times = count[at]
            stops = np.concatenate([[0], np.cumsum(times)])
            place = np.arange(stops[-1]) + np.repeat(begin[at] - stops[:-1], times)
            rows.append(
                (
                    -1 - chunk, first, len(mine), int(stops[-1]),
                    packed(times.astype(np.int32)), packed(values[place]),
                )
            )
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _PATHS)], schema=_PATHS)

    return look_up


_FOUND = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])


def _assemble(byte_ids: list[int], shared):
    def with_bytes(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece, stored as negative code points, as their bytes."""
        at = np.flatnonzero(values < 0)
        if not len(at):
            return values, bounds
        spelled = [[byte_ids[b] for b in chr(-int(values[i]) - 1).encode()] for i in at]
        times = np.ones(len(values), dtype=np.int64)
        times[at] = [len(s) for s in spelled]
        ends = np.concatenate([[0], np.cumsum(times)])
        out = np.repeat(values, times)
        for i, ids in zip(at, spelled):
            out[ends[i] : ends[i + 1]] = ids
        return out, ends[bounds]

    def assemble(data: bytes, paths: pa.Table) -> pa.Table:
        """Look every word number of a chunk up in the paths of its words."""
        row = pa.ipc.open_stream(data).read_all().to_pylist()[0]
        parts = paths.to_pylist()
        own = row["own_pieces"]
        number = np.concatenate(
            [*(np.arange(p["first"], p["first"] + p["n"]) for p in parts), np.array(row["own_words"], np.int64)]
        ).astype(np.int64)
        counts = np.concatenate(
            [*(unpacked(p["counts"], p["n"], np.int32) for p in parts), np.array([len(x) for x in own], np.int64)]
        ).astype(np.int64)
        values = np.concatenate(
            [*(unpacked(p["ids"], p["total"], np.int32) for p in parts), np.array([i for x in own for i in x], np.int64)]
        ).astype(np.int64)
        n_words = row["n_words"]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        values, bounds = with_bytes(values, bounds)
        begin, count = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
        begin[number], count[number] = bounds[:-1], np.diff(bounds)
        sizes = np.array(row["sizes"], dtype=np.int64)
        total = int(sizes.sum())
        used = unpacked(row["numbers"], total, np.uint32)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids, digests = row["ids"], row["digests"]
        texts = pa.array(shared.value.texts, pa.large_binary())
        tables, doc = [], 0
        while doc < len(sizes):
            # A few documents at a time: the ids of a chunk are many times its words.
            last = max(doc + 1, int(np.searchsorted(ends, ends[doc] + 250_000, side="right")) - 1)
            mine = used[ends[doc] : ends[last]]
            times = count[mine]
            stops = np.concatenate([[0], np.cumsum(times)])
            place = np.arange(stops[-1]) - np.repeat(stops[:-1], times) + np.repeat(begin[mine], times)
            offsets = stops[ends[doc : last + 1] - ends[doc]].astype(np.int32)
            pieces = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[place].astype(np.int32)))
            back = [
                hashlib.sha256(text).digest() == digest
                for text, digest in zip(decoded_texts(pieces, texts), digests[doc:last])
            ]
            tables.append(pa.table([pa.array(ids[doc:last], pa.int64()), pieces, pa.array(back)], schema=_FOUND))
            doc = last
        return pa.concat_tables(tables)

    return assemble


def encoded(docs: DataFrame, vocabulary: Vocabulary, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """`(doc_id, ids, round_trip)` for every row; the last tells whether the ids decode to the text."""
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Every way down uses all columns and the same rows, so that the exchange is made once. As many
    # partitions as buckets, which are not joined again: a task holds the lattice of its words.
    sent = chunks(docs, vocabulary, buckets, chunk_bytes).where(
        "dest is not null and chunk is not null and first is not null"
    ).repartition(buckets, "dest")
    lines = F.when(F.col("dest") >= 0, F.split(F.col("data").cast("string"), _BREAK))
    # The place is asked for only to read all columns.
    places = (
        sent.select("dest", "chunk", "first", F.posexplode_outer(lines).alias("number", "word"))
        .where("word is not null and chunk + first + number >= 0").select("dest", "word")
    )
    fold = merged_path if vocabulary.merges else best_path
    folded = lattice(places.distinct(), vocabulary).select(
        F.col("dest").alias("bucket"), "word", fold("edges").alias("ids")
    )
    shared = spark.sparkContext.broadcast(vocabulary)
    paths = (
        sent.groupBy("dest").cogroup(folded.groupBy("bucket"))
        .applyInArrow(_looked_up(shared), "dest bigint, first bigint, n bigint, total bigint, counts binary, ids binary")
    )
    assemble = _assemble(vocabulary.byte_ids, shared)

    def join(chunk: pa.Table, found: pa.Table) -> pa.Table:
        if not chunk.num_rows or chunk["dest"][0].as_py() >= 0:
            return _FOUND.empty_table()
        made = assemble(chunk["data"][0].as_py(), found)
        pa.default_memory_pool().release_unused()
        return made

    return (
        sent.groupBy("dest").cogroup(paths.groupBy("dest"))
        .applyInArrow(join, "doc_id bigint, ids array<int>, round_trip boolean")
    )


def decoded_texts(pieces: pa.ListArray, texts: pa.Array) -> Iterator[memoryview]:
    """The text of every list of ids; the mark before the first word is no space of the text."""
    taken = texts.take(pieces.values)
    if not len(taken):
        yield from (memoryview(b"") for _ in range(len(pieces)))
        return
    starts = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
    bounds = starts[pieces.offsets.to_numpy()]
    data = memoryview(taken.buffers()[2] or b"").cast("B")
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield data[begin + (begin < end and data[begin] == 0x20) : end]


def decoded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """All columns of `rows`, and `text` decoded from `ids`; bytes that are no UTF-8 are replaced."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary.texts)
    column = rows.columns.index("ids")
    names = [*rows.columns, "text"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            ids = batch.column(column)
            whole = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32)),
                ids.flatten(),
            )
            found = [
                bytes(text).decode(errors="replace") if there else None
                for text, there in zip(decoded_texts(whole, texts), ids.is_valid().to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(read, f"{kinds}, text string")
