import random

import pytest

from bazaarlake.llm import mixing


def test_fit_is_exact_where_it_can_be():
    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 8)))
        counts = [rng.randint(1, 5) for _ in lengths]
        budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts)) + 5)
        take = mixing.fit_counts(lengths, counts, budget, 3)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        assert sum(n * t for n, t in zip(lengths, take)) == max(s for s in sums if s <= budget)


def test_fit_of_large_budgets(monkeypatch):
    monkeypatch.setattr(mixing, "EXACT_SPAN", 200)
    rng = random.Random(2)
    for _ in range(30):
        lengths = sorted(rng.sample(range(1, 400), 50))
        counts = [rng.randint(1, 30) for _ in lengths]
        budget = rng.randint(5_000, sum(a * b for a, b in zip(lengths, counts)))
        take = mixing.fit_counts(lengths, counts, budget, 3)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        assert 0 <= budget - sum(n * t for n, t in zip(lengths, take)) <= 3


def frames(spark):
    rng = random.Random(4)
    rows = [(k, "hot" if rng.random() < 0.6 else rng.choice(["small", "other", None]), rng.choice(["one two three", "x", "a longer text of some words, and more", None, ""])) for k in range(600)]
    docs = spark.createDataFrame([(a, b, c, 7) for a, b, c in rows], "doc_id bigint, source string, text string, n_tokens int")
    targets = spark.createDataFrame([("hot", 0.5, 1), ("small", 0.4, 3), ("missing", 0.1, 2), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    return docs, targets


@pytest.mark.parametrize("parts", [1, 4096])
def test_shares_and_caps_hold(spark, monkeypatch, parts):
    monkeypatch.setattr(mixing, "PARTS", parts)
    docs, targets = frames(spark)
    picked, shares = mixing.mixture(docs, targets)
    told = {r.source: r for r in shares.collect()}
    rows = picked.collect()
    assert set(told) == {"hot", "small", "missing"}
    assert len({r.doc_id for r in rows}) == len(rows)
    for source, cap in (("hot", 1), ("small", 3)):
        mine = [r for r in rows if r.source == source]
        assert max(r.copies for r in mine) <= cap
        assert sum(r.copies * r.n_tokens for r in mine) == told[source].actual_tokens
        assert len(mine) == told[source].docs_used
        assert abs(told[source].target_tokens - told[source].actual_tokens) <= 1
    assert told["missing"].actual_tokens == 0 and told["missing"].short_by == told["missing"].target_tokens > 0
    assert sum(r.actual_share for r in told.values()) == pytest.approx(1)
    binding = [r.source for r in told.values() if r.binds]
    assert len(binding) == 1 and told[binding[0]].actual_tokens == told[binding[0]].tokens_available * told[binding[0]].max_repeats
    assert not any(r.binds for r in mixing.mixture(docs, targets, total_tokens=50)[1].collect())


@pytest.mark.parametrize("cap", [0, None, -1])
def test_a_source_with_cap_0_leaves_the_others_whole(spark, cap):
    docs, _ = frames(spark)
    targets = spark.createDataFrame([("hot", 0.5, 1), ("small", 0.3, 3), ("other", 0.2, cap)], "source string, target_share double, max_repeats int")
    picked, shares = mixing.mixture(docs, targets)
    told = {r.source: r for r in shares.collect()}
    assert {r.source for r in picked.select("source").distinct().collect()} == {"hot", "small"}
    assert told["hot"].actual_tokens > 0 and told["other"].tokens_available > 0
    assert all(abs(told[s].short_by) <= 1 for s in ("hot", "small"))
    assert told["other"].actual_tokens == 0 and told["other"].short_by == told["other"].target_tokens > 0


def test_a_total_beyond_reach_is_reported(spark):
    docs, targets = frames(spark)
    _, shares = mixing.mixture(docs, targets, total_tokens=10**6)
    told = {r.source: r for r in shares.collect()}
    assert told["hot"].actual_tokens == told["hot"].tokens_available
    assert told["small"].actual_tokens == 3 * told["small"].tokens_available
    assert told["small"].short_by > 0


def test_the_same_seed_picks_the_same(spark):
    docs, targets = frames(spark)
    one, two = (sorted(map(tuple, mixing.mixture(docs.repartition(n), targets, total_tokens=500, seed=9)[0].collect())) for n in (1, 5))
    assert one == two


def test_nothing_gives_nothing(spark):
    docs, targets = frames(spark)
    picked, shares = mixing.mixture(docs.limit(0), targets)
    assert picked.count() == 0 and shares.count() == 3
    picked, shares = mixing.mixture(docs, targets.limit(0))
    assert picked.count() == 0 and shares.count() == 0
