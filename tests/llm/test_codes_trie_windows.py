"""Vector codes, the conversation trie and repeated word windows against brute force and SQL."""

import hashlib
import random
from binascii import crc32
from collections import defaultdict

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusatlas.llm import conversation_trie, repeated_words, vector_codes
from corpusatlas.llm.queries import ORACLES, QUERIES

import check_oracles

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, name):
    connection = duckdb.connect()
    for table in check_oracles.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    result = QUERIES[name](spark, sf)
    answer = connection.execute(ORACLES[name])
    assert set(result.columns) == {d[0] for d in answer.description}
    assert check_oracles._plain(result.toPandas()) == check_oracles._plain(answer.df())


# ---- vector codes ----


def brute_codes(rows, parts, entries, rounds):
    """Rows `(vec_id, ints, label)` with Python numbers."""
    width = len(rows[0][1]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in rows]
    seeds = sorted((r[0], r[1], i) for i, r in enumerate(rows) if r[0] is not None)[:entries]
    books = [[list(cut[i][p]) for _, _, i in seeds] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for row in cut:
                held[nearest(p, row[p])[1]].append(row[p])
            for k, xs in held.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    found, by_label = [], defaultdict(int)
    for (vec_id, _, label), row in zip(rows, cut):
        best = [nearest(p, x) for p, x in enumerate(row)]
        error = sum(d for d, _ in best)
        by_label[label] += error
        found.append((vec_id, label, "".join(f"{k:02x}" for _, k in best), error))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(*r, by_label[r[1]]) for r in found], digest


def test_codes_odd_rows(spark):
    draw = random.Random(3)
    good = [(i, [draw.uniform(-1, 1) for _ in range(8)], draw.choice([None, 1, 2])) for i in range(60)]
    good += [(100 + i, good[i % 5][1], None) for i in range(20)] + [(None, good[7][1], 2), (3, good[9][1], 1), (3, good[9][1], 1)]
    good += [(200, [0.5, -0.5, 1e30, -1e30, 0.0, -0.0, 1 / 256, -1 / 512], 9)]
    bad = [
        (-1, None, 1), (-2, [], 1), (-3, [NAN] * 8, 1), (-4, [0.0] * 7 + [None], 1), (-5, [INF] + [0.0] * 7, 1),
        (-6, [-INF] + [0.0] * 7, 1), (300, [0.0] * 16, 1), (301, [0.0] * 6, 1),
    ]
    schema = "vec_id long, embedding array<double>, label int, code string, error string, ints string"
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in good + bad], schema).repartition(3)
    most = vector_codes.LARGEST
    ints = [(i, [int(max(-most, min(most, np.floor(256 * x)))) for x in v], label) for i, v, label in good]
    for entries in (5, 64, 200):
        found, books = vector_codes.compressed(table, parts=4, entries=entries)
        expected, digest = brute_codes(ints, 4, entries, 2)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
        assert books.sha256() == digest
    empty, _ = vector_codes.compressed(table.limit(0))
    assert empty.count() == 0
    no_ids, _ = vector_codes.compressed(table.withColumn("vec_id", F.lit(None).cast("long")), parts=4)
    assert {(r.code, r.error) for r in no_ids.collect()} == {("", None)}


@pytest.mark.parametrize("siblings", [1, 3, 4096])
def test_trie_walk_equals_all_distances(monkeypatch, siblings):
    monkeypatch.setattr(vector_codes, "SIBLINGS", siblings)
    draw = np.random.default_rng(5)
    parts = np.unique(draw.integers(-4, 4, (900, 4)), axis=0)
    entries = draw.integers(-4, 4, (13, 4))
    codes, errors = vector_codes.Trie(parts, entries).walk()
    distances = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (codes == distances.argmin(axis=1)).all() and (errors == distances.min(axis=1)).all()


def test_labels_beyond_a_broadcast(spark, sf, monkeypatch):
    whole = QUERIES["op11_vector_codes"](spark, sf).select("vec_id", "label_error").collect()
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert sorted(whole) == sorted(QUERIES["op11_vector_codes"](spark, sf).select("vec_id", "label_error").collect())


# ---- conversation trie ----


def brute_trie(rows):
    """Rows `(conv_id, turn, role, text)`."""
    named = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, named(role, text), role, text))
    own = {c: [(t[3], t[4]) for t in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c in own:
        h = crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in sorted(whole.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        gain = (len(convs) - 1) * len(brute.space_words(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += gain
    return sorted(
        (
            convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(children[node]), leaves[node], saved[node],
            hashlib.sha256(",".join(str(c) for c in convs if whole[c] == node).encode()).hexdigest(),
        )
        for node, convs in members.items()
    )


def odd_conversations(seed):
    draw = random.Random(seed)
    rows = []
    for c in [*range(-25, 90), 1_000, 2**40]:
        for turn in range(draw.choice([0, 1, 2, 3, 9])):
            rows.append((c, draw.choice([turn, turn, None]), draw.choice(["user", "user", None, ""]), draw.choice(["a b", "a b", " \n", None, "c", "é\x0bd"])))
    # Many copies, long shared spines with branches and ends on them, repeated rows.
    spine = [(t, "user", f"step {t}") for t in range(30)]
    rows += [(c, *s) for c in range(200, 260) for s in spine[: 3 + c % 28]]
    rows += [(c, *s) for c in range(300, 340) for s in [*spine[: c % 30], (99, "x", f"own {c // 2}")]]
    rows += [(400, 1, "user", "twice")] * 3 + [(None, 1, "user", "lost")]
    return rows


@pytest.mark.parametrize(("seed", "shard"), [(1, 200_000), (2, 1), (3, 4)])
def test_trie_odd_rows(spark, seed, shard):
    rows = odd_conversations(seed)
    schema = "conv_id long, turn long, role string, text string, c string, node string, words string"
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema).repartition(3)
    found = conversation_trie.prefix_trie(table, shard_paths=shard)
    got = sorted((tuple(r) for r in found.collect()), key=lambda r: [(x is None, x) for x in r])
    assert got == sorted(brute_trie(rows), key=lambda r: [(x is None, x) for x in r])


def test_trie_of_little(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    # Conversations 21 and 22 lose their turns to a base that is not there.
    lonely = [(c, 0, "user", "hi") for c in range(21, 40) if crc32(str(c).encode()) % 4]
    found = conversation_trie.prefix_trie(spark.createDataFrame(lonely, schema)).collect()
    assert [tuple(r) for r in found] == brute_trie(lonely) and found[0].n_leaves == 1


def test_find_close_on_any_tree():
    draw = random.Random(8)
    for n in (1, 2, 5, 40, 700):
        for block in (2, 4, 64):
            steps, depth, left = [1], 1, n - 1
            while depth:
                go_down = left and (depth == 1 or draw.random() < (0.9 if n > 300 else 0.5))
                steps.append(1 if go_down else -1)
                depth += steps[-1]
                left -= go_down
            stack, close = [], {}
            for i, s in enumerate(steps):
                if s == 1:
                    stack.append(i)
                else:
                    close[stack.pop()] = i
            opens = np.array(sorted(close))
            found = conversation_trie.Parentheses(np.array(steps), block).find_close(opens)
            assert found.tolist() == [close[i] for i in opens]


# ---- repeated words ----


def brute_words(rows, k):
    """Rows `(doc_id, text)`."""
    first = {}
    split = [(d, brute.space_words(t)) for d, t in rows]
    for d, words in split:
        for i in range(len(words) - k + 1):
            w = tuple(words[i : i + k])
            if d is not None:
                first[w] = min(first.get(w, d), d)
    found = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - k + 1):
            if d is not None and first[tuple(words[i : i + k])] < d:
                gone.update(range(i, i + k))
        found.append((d, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return found


def odd_texts():
    draw = random.Random(11)
    pool = [" ".join(draw.choices("ab cde é 😀 fg hij K k".split(), k=30)) for _ in range(6)]
    rows = [(i, " ".join(draw.choices(pool, k=draw.randrange(4))) + draw.choice(["", " tail", "\n", "\x0b x"])) for i in range(40)]
    rows += [(i, pool[0]) for i in range(100, 160)] + [(5, pool[1]), (5, "no " + pool[1]), (None, pool[2]), (None, pool[2])]
    rows += [(170, None), (171, ""), (172, " \t\n"), (173, "x"), (174, "y " * 5000), (175, "y " * 4000)]
    return rows


@pytest.mark.parametrize(("bits", "hot", "piece"), [(None, 255, 4_000_000), (4, 255, 50), (14, 3, 500), (21, 2, 10)])
def test_repeated_words_odd_rows(spark, monkeypatch, bits, hot, piece):
    for name, value in {"HOT": hot, "PIECE_WINDOWS": piece}.items():
        monkeypatch.setattr(repeated_words, name, value)
    rows = odd_texts()
    schema = "doc_id long, text string, gone string, hash string, kept string"
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema).repartition(5)
    found = repeated_words.without_repeats(table, bits=bits)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute_words(rows, repeated_words.WINDOW), key=str)


def test_repeated_words_of_nothing(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert repeated_words.without_repeats(table).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, repeated_words.without_repeats(blank).collect())) == [(1, 0, 0, ""), (2, 0, 0, "")]


def test_sketch_never_underestimates(spark):
    table = spark.createDataFrame([r for r in odd_texts()], "doc_id long, text string").repartition(4)
    sketch = repeated_words.sketched(table, bits=16)
    hashes = {}
    from corpusatlas.llm import textarrays as ta

    for _, text in odd_texts():
        data = np.frombuffer((text or "").encode(), np.uint8)
        found = repeated_words.Windows(data, np.array([0, len(data)]), ta.RangeHash(repeated_words._SEED), 13).hashes
        for h in found.tolist():
            hashes[h] = hashes.get(h, 0) + 1
    keys = np.array(sorted(hashes), dtype=np.uint64)
    repeated, hot = sketch.estimate(keys)
    times = np.array([hashes[int(k)] for k in keys])
    assert repeated[times > 1].all() and hot[times >= 255].all() and not repeated.all()
