import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import packing, splitting
from leafmill.llm import tokenizer as K


def check_plan(histogram, capacity):
    used, seen = Counter(), defaultdict(list)
    for size, first, times, per, start in packing.plan(histogram, capacity):
        seen[size].append((first, first + times * per))
        for k in range(times):
            used[start + k] += size * per
    assert max(used.values(), default=0) <= capacity
    for size, n in histogram.items():
        spans = sorted(seen[size])
        assert [a for a, _ in spans] == [0, *(b for _, b in spans[:-1])] and spans[-1][1] == n
    return len(used)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), min_size=1, max_size=20))
def test_plans_use_every_item_once(histogram):
    containers = check_plan(histogram, 64)
    assert containers <= 2 * -(-sum(s * n for s, n in histogram.items()) // 64)


def test_plan_is_tight_and_least_squares_solve():
    rng = random.Random(2)
    histogram = Counter(min(512, max(1, int(rng.lognormvariate(4.6, 0.8)))) for _ in range(20_000))
    assert check_plan(histogram, 512) <= 1.01 * sum(s * n for s, n in histogram.items()) / 512 + 2
    x = packing.nnls([{5: 1}, {7: 1}, {5: 2, 7: 1}], {5: 4.0, 7: 2.0}, {5: 1.0, 7: 1.0}, 4000)
    assert min(x) >= 0 and abs(x[0] + 2 * x[2] - 4) < 0.05 and abs(x[1] + x[2] - 2) < 0.05


def test_packed_frames(spark):
    rows = [(k, n, "x") for k, n in enumerate([None, 0, 5, 5, 5, 12, 10, 25, 7, 3] * 30)]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens int, container string").drop("container")
    limits = spark.createDataFrame([(1, 10), (2, 64)], "limit_id int, max_tokens int")
    out = packing.pack(items, limits, ["doc_id"]).collect()
    for limit_id, cap in ((1, 10), (2, 64)):
        own = [r for r in out if r.limit_id == limit_id]
        load, size, parts = Counter(), Counter(), Counter()
        for r in own:
            load[r.container] += r.n_tokens
            size[r.doc_id] += r.n_tokens
            parts[r.doc_id] += 1
        assert max(load.values()) <= cap and load[0] == 0
        assert dict(size) == {k: n or 0 for k, n, _ in rows}
        assert all(parts[k] == 1 for k, n, _ in rows if not n or n <= cap)
    assert {r.limit_id: r.largest <= r.capacity for r in packing.usage(packing.pack(items, limits, ["doc_id"]), limits).collect()} == {1: True, 2: True}
    assert packing.pack(items.where("false"), limits, ["doc_id"]).count() == 0
    assert packing.pack(items, limits.where("false"), ["doc_id"]).count() == 0


@pytest.fixture(scope="module")
def enc():
    return K.encoder(K.vocabulary_path(), K.split_pattern())


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab .\n,é中。!😀", min_size=1, max_size=400), st.sampled_from([(12, 3), (20, 0), (30, 10)]))
def test_pieces_round_trip(enc, text, limit):
    size, overlap = limit
    ids = np.frombuffer(enc.encode(text), np.int32)
    if len(ids) <= size:
        return
    ps = splitting.pieces(enc, text, ids, size, overlap)
    raw = text.encode()
    ends = np.concatenate(([0], np.cumsum(enc.token_lengths(ids))))
    assert ps[0][0] == 0 and ps[-1][1] == len(ids)
    out = b""
    for k, (a, b, n, fits, piece) in enumerate(ps):
        before = ps[k - 1][1] if k else 0
        assert piece.encode() == raw[ends[a] : ends[b]] and n == enc.count(piece) and fits == (max(n, b - a) <= size) and before >= a >= before - overlap - 4
        out += raw[ends[before] : ends[b]]
    assert out == raw


def test_natural_boundaries_and_limits(enc):
    text = "\n\n".join(" ".join(f"This is sentence {k} of paragraph {p}." for k in range(6)) for p in range(12))
    ids = np.frombuffer(enc.encode(text), np.int32)
    ps = splitting.pieces(enc, text, ids, 128, 16)
    strength, _ = splitting.strengths(text, np.cumsum(enc.token_lengths(ids)))
    assert all(b - a <= 128 and n <= 128 and n == enc.count(t) and fits for a, b, n, fits, t in ps) and len(ps) > 3
    assert all(strength[b] >= splitting.SENTENCE for _, b, *_ in ps[:-1])
    assert all(p[1] - q[0] == 16 for p, q in zip(ps, ps[1:]))


def test_split_frames(spark):
    long = "word " * 40_000
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "short", 0), (4, "many words. " * 200, 0), (4, "many words. " * 200, 0), (5, long, 0)], "doc_id long, text string, piece_no int")
    limits = spark.createDataFrame([(7, 128, 16)], "limit_id int, max_tokens int, overlap_tokens int")
    got = splitting.split(docs, limits).collect()
    assert {r.doc_id for r in got} == {4, 5} and max(r.n_tokens for r in got) <= 128
    assert sorted(r.piece_no for r in got if r.doc_id == 5) == list(range(1, 1 + sum(r.doc_id == 5 for r in got)))
    assert splitting.split(docs.where("false"), limits).count() == 0
    with pytest.raises(ValueError):
        splitting.split(docs, spark.createDataFrame([(1, 8, 8)], "limit_id int, max_tokens int, overlap_tokens int"))


def test_a_longer_table_of_limits_is_refused(spark):
    limits = spark.range(packing.LIMITS + 1).selectExpr("id AS limit_id", "10 AS max_tokens", "0 AS overlap_tokens")
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 5)], "doc_id long, n_tokens int"), limits, ["doc_id"])
    with pytest.raises(ValueError):
        splitting.split(spark.createDataFrame([(1, "a")], "doc_id long, text string"), limits)
    assert len(packing.all_limits(limits.where("limit_id > 0"))) == packing.LIMITS


def test_sizes_of_pieces_are_exact_at_every_size(enc):
    rng = random.Random(8)
    for _ in range(30):
        text = "".join(rng.choice(["word", " ", "  ", "\n", "x1", ", ", "。汉字", "😀", "it's", "\t", "2024-05"]) for _ in range(400))
        ids = np.frombuffer(enc.encode(text), np.int32)
        for a, b, n, fits, piece in splitting.pieces(enc, text, ids, 40, 8):
            assert n == enc.count(piece) and fits and b - a <= 40 and n <= 40


def test_a_piece_that_nothing_can_cut_is_marked(enc):
    text = "😀" * 6
    ids = np.frombuffer(enc.encode(text), np.int32)
    got = splitting.pieces(enc, text, ids, 1, 0)
    assert "".join(t for *_, t in got) == text and [fits for _, _, _, fits, _ in got] == [enc.count(t) <= 1 for *_, t in got]


def test_long_lists_of_runs_are_joined_with_the_same_result(spark):
    rng = random.Random(6)
    histogram = Counter(rng.randrange(1, 60) for _ in range(3000))
    runs = [(1, *r) for r in packing.plan(histogram, 64)]
    ranked = spark.createDataFrame([(1, s, k, "x") for s, n in histogram.items() for k in range(n)] + [(1, 0, 0, None)], "limit_id int, size int, rank long, key string")
    sent = sorted(tuple(r) for r in packing.in_containers(ranked, runs).select("size", "rank", "container").collect())
    joined = sorted(tuple(r) for r in packing.in_containers(ranked, runs, 0).select("size", "rank", "container").collect())
    assert sent == joined and len(sent) == 3001
