import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from bazaarlake.operators import history

SCHEMA = "update_id bigint, listing_id bigint, price decimal(12,2), stock boolean, updated_at timestamp_ntz, received_at timestamp_ntz, at string"
BASE = datetime(2025, 1, 1)


def brute(rows):
    out = []
    for key in {r[1] for r in rows if r[1] is not None and r[4] is not None}:
        mine = [r for r in rows if r[1] == key and r[4] is not None]
        last = {}
        for r in mine:
            order = (r[5] is not None, r[5] or BASE, r[0] if r[0] is not None else -1)
            if r[4] not in last or order >= last[r[4]][0]:
                last[r[4]] = (order, r)
        state, versions = (None, None), []
        for at in sorted(last):
            r = last[at][1]
            now = (r[2] if r[2] is not None else state[0], r[3] if r[3] is not None else state[1])
            if not versions or now != state:
                versions.append((at, now))
            state = now
        for (at, now), after in zip(versions, [*versions[1:], (None, None)]):
            out.append((key, at, after[0], now[0], now[1]))
    return sorted(out, key=str)


def rows_of(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(400):
        hot = rng.random() < 0.35
        at = BASE + timedelta(hours=rng.randrange(0, 24 * 60, 7))
        row = (k, 1 if hot else rng.choice([2, 3, 4, None]), rng.choice([None, 10, 10, 20]), rng.choice([None, True, False]), rng.choice([at, at, at, None]), rng.choice([at, at + timedelta(hours=1), at + timedelta(days=3)]), "x")
        rows += [row] * rng.choice([1, 1, 2])
    return rows


def frame(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame([(a, b, None if c is None else Decimal(c), d, e, f, g) for a, b, c, d, e, f, g in rows], SCHEMA)


def plain(versions):
    return sorted([(r.listing_id, r.valid_from, r.valid_to, None if r.price is None else int(r.price), r.stock) for r in versions.collect()], key=str)


def test_versions_equal_brute_force(spark):
    for seed, era, span in ((1, 30, 7), (2, 5, 1), (3, 400, 400), (4, 1, 7)):
        rows = rows_of(seed)
        assert plain(history.versions(frame(spark, rows), "listing_id", ["price", "stock"], era, span)) == brute(rows)


def test_state_at_a_moment_equals_the_version_then(spark):
    rows = rows_of(4)
    store = history.store_of(frame(spark, rows), "listing_id", ["price", "stock"], era_days=20)
    for moment in (BASE - timedelta(days=1), BASE, BASE + timedelta(days=31), BASE + timedelta(days=45, hours=5), BASE + timedelta(days=900)):
        got = {r.listing_id: (r.price, r.stock) for r in store.as_of(moment).collect()}
        assert got == {k: (p, s) for k, a, b, p, s in brute(rows) if a <= moment and (b is None or b > moment)}


def test_a_moment_reads_its_era_alone(spark):
    store = history.store_of(frame(spark, rows_of(4)), "listing_id", ["price", "stock"], era_days=20)
    files = store.as_of(BASE + timedelta(days=31)).inputFiles()
    assert len({f.rsplit("/", 2)[1] for f in files}) == 1 and {f.split("/")[-4] for f in files} == {"patches", "checkpoints"}


def test_batches_give_what_one_log_gives(spark, tmp_path):
    """Late rows, rows of new eras and batches that are appended again; checkpoints are those of the whole log."""
    rows = rows_of(6)
    early, late, last = [r for r in rows if r[0] % 3 == 0], [r for r in rows if r[0] % 3 == 1], [r for r in rows if r[0] % 3 == 2]
    early = [r for r in early if r[4] is None or r[4] < BASE + timedelta(days=30)]
    store = history.Store(spark, f"file://{tmp_path}/store", "listing_id", ["price", "stock"], era_days=15, span_days=4)
    whole = [*early, *late, *last]
    for batch, part in enumerate((early, [], late, last, last)):
        store.append(frame(spark, part), min(batch, 3))
    assert plain(store.versions()) == brute(whole)
    one = history.store_of(frame(spark, whole), "listing_id", ["price", "stock"], era_days=15, span_days=4)
    assert sorted(map(tuple, store.checkpoints().collect()), key=str) == sorted(map(tuple, one.checkpoints().collect()), key=str)


def test_there_are_few_checkpoints(spark):
    log = spark.read.parquet("/root/testdata/sf0.01/listing_updates.parquet")
    store = history.store_of(log, "listing_id", ["current_price_lkr", "in_stock"])
    assert 0 < store.checkpoints().count() <= 0.2 * store.patches().count()


def test_nothing_gives_nothing(spark):
    store = history.store_of(frame(spark, []), "listing_id", ["price", "stock"])
    assert store.versions().count() == store.as_of(BASE).count() == store.checkpoints().count() == 0
