import random

import numpy as np
import pytest

from bazaarlake.llm import shared_spans as ss


def brute(rows, span):
    owners = {}
    for d, t in rows:
        for p in range(len(t or "") - span + 1):
            owners.setdefault(t[p : p + span], set()).add(d)
    out = {}
    for d, t in {(d, t) for d, t in rows if d is not None and t}:
        covered = set()
        for p in range(len(t) - span + 1):
            if len(owners[t[p : p + span]] - {None}) > 1:
                covered.update(range(p, p + span))
        if covered:
            out[d] = out.get(d, 0) + len(covered)
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "ශ්‍රී", "👍🏽", "x"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    hot, passages = text(30), [text(rng.randint(3, 25)) for _ in range(8)]
    rows = []
    for k in range(60):
        parts = [text(rng.randint(0, 12)), hot if rng.random() < 0.4 else "", rng.choice(passages), text(4), rng.choice(passages) if rng.random() < 0.3 else "", "aaaa" * rng.randint(0, 40)]
        rows.append((k, "".join(parts)))
    return rows + [(100, None), (101, ""), (102, "short"), (0, rows[0][1]), (103, rows[1][1]), (104, hot + hot)]


@pytest.mark.parametrize(("seed", "hot", "chunk"), [(1, 3_000_000, 2_000_000), (2, 1, 300), (3, 500, 50), (4, 3_000_000, 10)])
def test_equals_brute_force(spark, seed, hot, chunk):
    rows = corpus(seed)
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id bigint, text string, th int, lo int")
    got = {r.doc_id: r.shared_chars for r in ss.shared_chars(df, span=40, seed_length=15, hot=hot, chunk=chunk).collect()}
    assert got == brute(rows, 40)


def test_nothing_gives_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert ss.shared_chars(df).count() == 0
    assert ss.shared_chars(spark.createDataFrame([(1, "a" * 900), (None, "a" * 900)], "doc_id bigint, text string")).count() == 0


def test_hashes_and_minima():
    codes = ss.codes_of("abracadabra" * 9)
    for n in (1, 2, 7, 16, 64):
        h = ss.gram_hashes(codes, n)
        seen = {}
        for p in range(len(codes) - n + 1):
            assert seen.setdefault(codes[p : p + n].tobytes(), h[p]) == h[p]
        assert len(set(seen.values())) == len(seen)
        assert (ss.sliding_min(h, n) == [h[p : p + n].min() for p in range(len(h) - n + 1)]).all() if len(h) >= n else True
    assert len(ss.gram_hashes(codes, 1000)) == 0


def test_equal_hashes_of_different_windows_are_told_apart(monkeypatch):
    monkeypatch.setattr(ss, "gram_hashes", lambda codes, n, base=0: np.zeros(max(0, len(codes) - n + 1), np.uint64))
    string, lo, hi = ss.shared_windows(["abcdef", "abcxyz", "zzzzzz"], np.array([1, 2, 3]), 3)
    assert list(zip(string.tolist(), lo.tolist(), hi.tolist())) == [(0, 0, 1), (1, 0, 1)]


def coarse(span):
    """The windows of hot strings with two hashes in all, so nearly every hash has several texts."""
    import pyarrow as pa

    inner = ss._spread(span)

    def run(batches):
        for batch in inner(batches):
            hashes = batch.column("hash").to_numpy() & 1
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), *batch.columns[1:]], names=batch.schema.names)

    return run


@pytest.mark.parametrize("seed", [5, 6])
def test_equal_hashes_in_hot_buckets_are_told_apart(spark, seed):
    rows = [(d, t) for d, t in corpus(seed) if t and len(t) >= 40]
    packed = spark.createDataFrame([(d, hash(t) % 1000, 0, t) for d, t in rows], "doc bigint, th bigint, at bigint, packed string")
    plain, mixed = (sorted(map(tuple, ss._spread_out(packed, 40, spread).distinct().collect())) for spread in (ss._spread, coarse))
    assert plain == mixed and plain


@pytest.mark.parametrize("hot", [1, 3_000_000])
def test_long_runs_of_blanks_in_many_texts(spark, monkeypatch, hot):
    """A million blanks are one minimiser; they are cut, and equal pieces are one."""
    rows = [(k, f"text {k} " + " " * 1_000_000 + f" end {k}") for k in range(6)] + [(9, "no blanks " * 30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.shared_chars for r in ss.shared_chars(df, hot=hot).collect()}
    assert got == {k: len(" " * 1_000_000) + len(" " + " end ") for k in range(6)}
    assert max(ss.super_kmers(ss.codes_of(rows[0][1]), 200, 64)[1]) == ss.PIECE
