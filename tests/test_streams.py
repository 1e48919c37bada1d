from datetime import datetime

import pandas as pd

from bazaarlake.streaming import breaker, pages, slots

SCHEMA = "domain string, id bigint, at double, status int"
BLOCKS = [("a", k, float(k), 403) for k in range(5)] + [("a", 5, 10.0, 200), ("a", 6, 3605.0, 403), ("a", 7, 3606.0, 200), ("b", 8, 1.0, 429), ("b", 9, 2.0, 200)]


def run(frame, sink, path):
    query = frame.writeStream.queryName(sink).format("memory").outputMode("append").trigger(availableNow=True).option("checkpointLocation", path).start()
    query.awaitTermination(120)
    return frame.sparkSession.table(sink)


def stream(spark, rows, schema, path, parts=2):
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
    for k in range(parts):
        spark.createDataFrame(pdf.iloc[k::parts] if parts == 1 else pdf.iloc[k * len(pdf) // parts : (k + 1) * len(pdf) // parts], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_breaker_opens_refuses_and_closes(spark, tmp_path):
    live = run(breaker.guarded(stream(spark, BLOCKS, SCHEMA, tmp_path / "in")), "guarded", str(tmp_path / "c"))
    got = {r.id: (r.allowed, r.in_a_row) for r in live.collect()}
    assert got[4] == (True, 5) and got[5][0] is False and got[6] == (True, 1) and got[7] == (True, 0) and got[8] == (True, 1) and got[9] == (True, 0)
    whole = breaker.replayed(spark.createDataFrame(BLOCKS, SCHEMA))
    assert {r.id: (r.allowed, r.in_a_row) for r in whole.collect()} == got


def test_slots_fill_rest_and_begin_again(spark, tmp_path):
    calls = [("k", n, float(n), False) for n in range(4)] + [("k", 4, 61.0, True), ("k", 5, 62.0, False), ("k", 6, 127.0, False)]
    live = run(slots.granted(stream(spark, calls, "slot string, id bigint, at double, limited boolean", tmp_path / "in"), rpm=3, margin=0.8), "granted", str(tmp_path / "c"))
    assert {r.id: r.granted for r in live.collect()} == {0: True, 1: True, 2: False, 3: False, 4: True, 5: False, 6: True}


def test_ring_of_a_stream(spark, tmp_path):
    rows = [(pd.Timestamp("2025-01-01"), "https://x.example/a/", "one"), (pd.Timestamp("2025-01-01 01:00"), "https://x.example/a?ref=z", "two"), (pd.Timestamp("2025-01-01 02:00"), "https://x.example/b", " one "), (pd.Timestamp("2025-01-01 03:00"), "https://x.example/c", "three")]
    live = run(pages.fresh(stream(spark, rows, "fetched_at timestamp, url string, html string", tmp_path / "in")), "fresh", str(tmp_path / "c"))
    assert live.count() == 2


def test_upserts_keep_the_last_and_survive_a_second_run_of_a_batch(spark, tmp_path):
    schema = "k string, at int, price int, brand string"
    one = spark.createDataFrame([("a", 1, 10, "x"), ("b", 1, 5, None)], schema)
    two = spark.createDataFrame([("a", 2, None, None), ("c", 1, 7, "y")], schema)
    kept = pages.Upserts(spark, str(tmp_path / "state"), ["k"], ["at"], ["price"], ["brand"], buckets=8)
    assert kept.state() is None
    kept.write(one, 0)
    kept.write(two, 1)
    kept.write(two, 1)
    assert {r.k: (r.price, r.brand) for r in kept.state().collect()} == {"a": (None, "x"), "b": (5, None), "c": (7, "y")}
    written = {p.name for p in (tmp_path / "state/batch=1").glob("bucket=*")}
    assert 0 < len(written) < 8  # only buckets with keys of the batch
    for n in range(2, 6):
        kept.write(spark.createDataFrame([("a", n, n, None)], schema), n)
    assert {r.k: (r.price, r.brand) for r in kept.state().collect()} == {"a": (5, "x"), "b": (5, None), "c": (7, "y")}
    bucket = next(p.name for p in (tmp_path / "state/batch=5").glob("bucket=*"))
    assert len(list((tmp_path / "state").glob(f"batch=*/{bucket}"))) == 2


def test_keys_are_tried_in_their_order(spark, tmp_path):
    calls = [("p", 0, 0.0, [False, False]), ("p", 1, 1.0, [False, False]), ("p", 2, 2.0, [False, False]), ("p", 3, 3.0, [False, True]), ("p", 4, 4.0, [False, False]), ("p", 5, 61.0, [True, False]), ("p", 6, 70.0, [False, False]), ("p", 7, 127.0, None)]
    live = run(slots.rotated(stream(spark, calls, "pool string, id bigint, at double, limited array<boolean>", tmp_path / "in"), slots=2, rpm=3, margin=0.8), "rotated", str(tmp_path / "c"))
    assert {r.id: (r.slot, r.tried) for r in live.collect()} == {0: (0, 1), 1: (0, 1), 2: (1, 1), 3: (None, 1), 4: (None, 0), 5: (None, 1), 6: (1, 1), 7: (0, 1)}


def test_history_by_month(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2025, 1, 31), 1), (datetime(2025, 2, 1), 2)], "updated_at timestamp, v int")
    pages.history_sink(str(tmp_path))(df, 0)
    pages.history_sink(str(tmp_path))(df, 0)
    assert {r.month for r in spark.read.parquet(f"{tmp_path}/batch=0").collect()} == {"2025_01", "2025_02"}
    assert spark.read.parquet(f"{tmp_path}/batch=0").count() == 2
