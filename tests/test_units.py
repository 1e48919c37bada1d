from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bazaarlake.functions import measures
from bazaarlake.operators import units


@pytest.mark.parametrize(
    ("title", "ram", "storage"),
    [
        ("Pumon 9255 8+512GB Handset", 8192, 524288), ("Yamberlo 8883 lite 8/64GB", 8192, 65536), ("Tab 6GB+256GB new", 6144, 262144), ("x 12GB | 128GB ROM", 12288, 131072), ("8GRAM + 2TB storage", 8192, 2097152),
        ("64G 4 Gb ram Dual SIM", 4096, 65536), ("32 Megabytes RAM, 4GB storage", 32, 4096), ("64 M.B. 64 MEGABYTES RAM", 64, 64), ("one terabyte ROM 8192MB of RAM", 8192, 1048576), ("half terabyte storage", None, 524288), ("4096GB capacity M.2 drive", None, 4194304),
        ("5G Phone 6 GB RAM microSD up to 1TB", 6144, None), ("5G 16GB+64GB 100GB cloud space free", 16384, 65536), ("Minur 2166+ 8 gigs memory / 64 Gb", 8192, 65536), ("(expandable to 2 TB) 64G", None, 65536), ("earbuds", None, None), ("", None, None), (None, None, None),
    ],
)
def test_memory_in_titles(spark, title, ram, storage):
    df = spark.createDataFrame([(title,)], "t string").select(measures.memory_text(F.col("t")).alias("t")).select(measures.memory_of(F.col("t")).alias("m"))
    assert tuple(df.select("m.*").first()) == (ram, storage)


ITEM = "item_id bigint, merchant_id bigint, price_lkr double, price_text string, scraped_timestamp timestamp_ntz, day string"
NOON = datetime(2025, 6, 2, 12)
CASES = [
    (1, 1, 12.74, "12.74 k rupees", 12740), (2, 1, 0.41, "0.41 lakhs only", 41000), (3, 1, None, "LKR 14,800", 14800), (4, 1, 17.89, "LKR 17.890,00", 17890), (5, 1, 100.0, "$100", 30000), (6, 1, 8416000.0, "8416000 cents", 84160),
    (7, 1, 92410.0, "was Rs. 97,410 now Rs.92,410", None), (8, 1, None, "77,110 LKR 72,110 LKR only", 72110), (9, 1, None, "Rs.244,350 (12 x 61,087 rupees per month)", 244350), (10, 1, None, "Ask in store", None), (11, 1, 500.0, None, None),
    (12, 2, 1805000.0, None, 18050), (13, 2, 18050.0, "Rs 18,050/=", None), (14, 3, 215.71, None, 215710), (15, 4, 100.0, "100", 30000), (16, 5, 5000.0, None, 50), (17, 99, 700.0, None, None), (18, None, None, None, None), (19, 1, None, "", None),
    (20, 1, 0.15, "Rs. 0.15M", 150000), (21, 1, 24.0, "රු. දහස් 24", 24000),
]
NOTES = [(1, "All amounts in rupees."), (2, "Export writes every amount in cents."), (3, "Amounts given as '000 LKR."), (4, "Feed currency: USD"), (5, "Amounts in cents until 2025-12-31, in rupees from 2026-01-01 (UTC)."), (6, None)]


def frames(spark):
    items = spark.createDataFrame([(i, m, p, t, NOON, "clash") for i, m, p, t, _ in CASES], ITEM)
    merchants = spark.createDataFrame(NOTES, "id bigint, feed_notes string")
    rates = spark.createDataFrame([(date(2025, 6, 1), "USD", Decimal("300.00")), (date(2025, 6, 3), "USD", Decimal("999.00"))], "rate_date date, currency string, lkr_per_unit decimal(12,2)")
    return items, merchants, rates


def test_prices_come_out_in_rupees(spark):
    items, merchants, rates = frames(spark)
    products = spark.createDataFrame([], "id bigint, storage_gb int, ram_gb int, raw_title string, clean_title string, attributes string")
    got = {r.record_id: r.amount for r in units.wrong_units(items, merchants, rates, products).collect()}
    assert got == {i: a for i, _, _, _, a in CASES if a is not None}


def test_dated_notes_change_at_their_date(spark):
    items = spark.createDataFrame([(1, 5, 5000.0, None, datetime(2026, 1, 1), "x"), (2, 5, 5000.0, None, None, "x")], ITEM)
    _, merchants, rates = frames(spark)
    assert units.price_amounts(items, merchants, rates).where("not in_unit").count() == 0


def test_memory_fields(spark):
    rows = [(1, 1, None, "2TB 8GB RAM", "", "{}"), (2, 64, 32, "Button phone 64mb ROM 32MB RAM", None, None), (3, None, 16384, "x", None, '{"ram size": "16G", "Capacity": "one terabyte"}'), (4, 256, 8, "8/256GB", None, "broken"), (5, None, None, None, None, None)]
    products = spark.createDataFrame(rows, "id bigint, storage_gb int, ram_gb int, raw_title string, clean_title string, attributes string")
    items, merchants, rates = (f.limit(0) for f in frames(spark))
    got = {(r.record_id, r.field_name): r.amount for r in units.wrong_units(items, merchants, rates, products).collect()}
    assert got == {(1, "storage_gb"): 2097152, (1, "ram_gb"): 8192, (2, "storage_gb"): 64, (2, "ram_gb"): 32, (3, "ram_gb"): 16384, (3, "storage_gb"): 1048576}


def by_hand(raw, clean, attributes):
    """(RAM, storage) in MB as read by plain Python, text by text."""
    import json
    import re

    unit = "(terabytes?|tb|t|gigabytes?|gigs?|gb|g|megabytes?|mb)"
    size = lambda n, u: float(n) * {"t": 1048576, "g": 1024, "m": 1}[u[0]]

    def read(text):
        s = (text or "").lower()
        for word, number in {"half a": "0.5", "half": "0.5", "one": "1", "two": "2", "eight": "8"}.items():
            s = re.sub(rf"\b{word}[ -]+(?=tera|giga|mega|[tgm]b\b)", f"{number} ", s)
        s = re.sub(rf"(?:micro ?sd|cards?|expand\w*|up ?to)[ :]+(?:up )?(?:to )?[0-9.]+ ?{unit}\b", " ", s)
        s = re.sub(rf"[0-9.]+ ?{unit} (?:of )?(?:free )?(?:cloud|online|drive)\b", " ", s)
        s = re.sub(r"\b5g\b", " ", s)
        if m := re.search(rf"\b(\d+) ?(?:{unit})? ?[+/|] ?(\d+) ?{unit}\b(?! ?(?:ram|memory))", s):
            return size(m[1], m[2] or "g"), size(m[3], m[4])
        ram = re.search(rf"([0-9.]+) ?{unit} ?(?:of )?(?:ram|memory)\b", s)
        rest = s.replace(ram[0], " ", 1) if ram else s
        one = re.search(rf"\b([0-9.]+) ?{unit}\b", rest)
        return ram and size(ram[1], ram[2]), one and size(one[1], one[2])

    try:
        told = {k.lower(): v for k, v in json.loads(attributes or "{}").items()}
    except ValueError:
        told = {}
    named = [read(next((told[k] for k in keys if k in told), None))[1] for keys in (("ram", "ram size", "system ram"), ("storage", "internal memory", "capacity"))]
    first, second = read(raw), read(clean)
    return tuple(a if a is not None else b if b is not None else c for a, b, c in zip(first, second, named, strict=True))


def test_memory_of_the_whole_table(spark, tmp_path):
    from bazaarlake.plans import general

    rows = [
        ("Pumon 9255 8/256GB Handset", None, None), ("Pumon 8GB RAM 128GB", None, None), ("Tab 64 GB", None, None), ("Drive one terabyte", None, None), ("Button phone 64MB 32MB RAM", None, None), ("two TB storage 8 GB memory", None, None),
        ("Phone 6GB RAM microSD up to 1TB", "Phone 64GB", None), ("5G 16GB+64GB 100GB cloud space", None, None), ("Pumon 9255", "Pumon 9255 4/64GB", '{"RAM": "16 GB"}'), ("x", None, '{"ram size": "16G", "Capacity": "half terabyte"}'),
        ("8/256GB expandable to 2 TB", None, None), ("4/64GB", "8/128GB", "broken"), (None, None, None), ("", "", "{}"), ("earbuds", "cards and cloud", None),
    ]
    df = spark.createDataFrame([(k, None, None, *r) for k, r in enumerate(rows)], "id bigint, storage_gb int, ram_gb int, raw_title string, clean_title string, attributes string")
    df.write.parquet(f"{tmp_path}/canonical_products.parquet")
    got = {r.id: (r.ram_mb, r.storage_mb) for r in general.QUERIES["p5_memory"](spark, str(tmp_path)).collect()}
    assert got == {k: by_hand(*r) for k, r in enumerate(rows)}
    assert len([v for v in got.values() if v != (None, None)]) == 12
