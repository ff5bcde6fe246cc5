import numpy as np
import pytest

from corpusatlas.operators import vectors as v


def table(spark, ids, rows, name):
    data = [(int(i), [float(x) for x in r]) for i, r in zip(ids, rows)]
    return spark.createDataFrame(data, f"{name} bigint, embedding array<float>").repartition(3)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    stored = rng.standard_normal((300, 16)).astype(np.float32)
    stored[200:230] = stored[5]  # copies tie
    asked = stored[[5, 17, 40, 250]] + rng.standard_normal((4, 16)).astype(np.float32) * 0.05
    return stored, asked


def brute(stored, asked, k):
    a = stored.astype(np.float64) / np.linalg.norm(stored.astype(np.float64), axis=1, keepdims=True)
    b = asked.astype(np.float64) / np.linalg.norm(asked.astype(np.float64), axis=1, keepdims=True)
    scores = np.round(b @ a.T, 6)
    return {
        q: [int(i) for i in np.lexsort((np.arange(len(stored)), -scores[q]))[:k]]
        for q in range(len(asked))
    }


def found(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


def test_exact(spark, data):
    stored, asked = data
    vectors, queries = table(spark, range(300), stored, "vec_id"), table(spark, range(4), asked, "query_id")
    expected = brute(stored, asked, 7)
    assert found(v.top_k(vectors, queries, 7)) == expected
    # More queries than may travel at once: several blocks.
    assert found(v.top_k(vectors, queries, 7, max_queries=1)) == expected
    whole = vectors.selectExpr("0 AS g", "vec_id", "embedding")
    blocks = v.block_hits(whole, queries.selectExpr("0 AS g", "query_id", "embedding"), ["g"], 7, 40, 2)
    assert found(v.merged(blocks, 7)) == expected
    assert found(v.top_k(vectors, queries.limit(0), 7)) == {}
    assert all(len(x) == 300 for x in found(v.top_k(vectors, queries, 500)).values())


def test_bands_find_near_copies(spark, data):
    stored, asked = data
    vectors, queries = table(spark, range(300), stored, "vec_id"), table(spark, range(4), asked, "query_id")
    got = found(v.top_k_lsh(vectors, queries, 3, bands=16, bits=4))
    expected = brute(stored, asked, 3)
    assert [got[q][0] for q in range(4)] == [expected[q][0] for q in range(4)]
    hits = sum(len(set(got[q]) & set(expected[q])) for q in range(4))
    assert hits >= 9
    assert all(len(set(x)) == len(x) for x in got.values())


@pytest.mark.parametrize("max_queries", [1, 1_024])
def test_one_rule_for_vectors_that_cannot_be_used(spark, max_queries):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [None, 1.0, 0.0]), (7, [float("nan"), 1.0, 0.0]), (None, [1.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    queries = vectors.withColumnRenamed("vec_id", "query_id")
    got = found(v.top_k(vectors, queries, 5, max_queries=max_queries))
    assert got == {1: [1, 2], 2: [2, 1], 3: [3]}
    assert {r.vec_id for r in v.unusable(vectors).collect()} == {None, 4, 5, 6, 7}
    near = found(v.top_k_lsh(vectors, queries, 5))
    assert {q: r[0] for q, r in near.items()} == {1: 1, 2: 2, 3: 3}


def test_codes_get_longer_with_the_table():
    assert v.code_bits(100) == 6 and v.code_bits(10**6) == 14 and v.code_bits(10**10) > 25


def test_recall_of_the_registered_query(spark):
    from corpusatlas.plans.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    got, expected = found(QUERIES["vector_topk_lsh"](spark, sf)), found(QUERIES["vector_topk"](spark, sf))
    hits = sum(len(set(got[q]) & set(expected[q])) for q in expected)
    assert hits >= 0.9 * sum(map(len, expected.values()))


def test_recall_by_bands_with_default_numbers(spark):
    """Enough vectors that bands are used: groups of ten around 1,000 centres."""
    rng = np.random.default_rng(3)
    stored = np.repeat(rng.standard_normal((1_000, 32)), 10, axis=0) + 0.25 * rng.standard_normal((10_000, 32))
    asked = stored[::250]
    assert v.bands_for(np.array([0.9]), v.code_bits(10_000)) * v.ROWS_PER_CODE < 10_000
    got = found(v.top_k_lsh(table(spark, range(10_000), stored, "vec_id"), table(spark, range(40), asked, "query_id"), 10))
    expected = brute(stored.astype(np.float32), asked.astype(np.float32), 10)
    assert sum(len(set(got[q]) & set(expected[q])) for q in expected) >= 0.9 * 400


def test_band_codes_hold_a_bounded_part_of_the_products(monkeypatch):
    import tracemalloc

    rows = np.random.default_rng(3).standard_normal((4_000, 16))
    whole = v._codes(rows[:50], 40, 12, 7)
    monkeypatch.setattr(v, "HELD_NUMBERS", 1 << 12)
    assert (v._codes(rows[:50], 40, 12, 7) == whole).all()
    monkeypatch.undo()
    tracemalloc.start()
    codes = v._codes(rows, 400, 15, 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All products at once are 4,000 x 400 x 15 numbers of 8 bytes, 192 MB.
    assert peak - codes.nbytes < 64 << 20


def test_band_codes_in_slices_of_a_batch(spark, monkeypatch):
    stored = np.random.default_rng(4).standard_normal((60, 8))
    df = table(spark, range(60), stored, "vec_id")
    got = {(r.vec_id, r.band): r.code for r in v.band_codes(df, "vec_id", 50_000, 7).where("band % 9973 = 5").collect()}
    unit = stored.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert {i for i, _ in got} == set(range(60))
    planes = np.random.default_rng([7, 8]).standard_normal((50_000 * 7, 8))
    for (i, band), code in got.items():
        side = unit[i] @ planes[band * 7 : band * 7 + 7].T
        assert abs(side).min() < 1e-6 or code == ((side >= 0) @ (1 << np.arange(7)))
