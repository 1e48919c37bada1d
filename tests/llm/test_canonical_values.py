import random

import pytest
from pyspark.sql import functions as F

from bazaarlake.llm import canonical_values as cv

REFERENCE = [(1, "Velonix", ["VLX", "වෙලොනික්ස්"]), (13, "Dunmarq", ["Oltavia"]), (39, "Ember & Oak", None), (42, "Three Herons", ["3H"]), (50, "Coral Strand Mobile", ["CSM"]), (53, "Ziro", []), (7, "Quillora", [])]


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame(REFERENCE, "brand_id bigint, brand_name string, aliases array<string>")


VALUES = [
    ("velonix", 1), ("VELONX", 1), (" by Velonix™", 1), ("Vеlоniх", 1), ("v3l0n1x", 1), ("vélonïx", 1), ("Ve​lo\xadnix", 1), ("velinox Lanka (Pvt) Ltd", 1), ("VLX", 1), ("වෙලොනික්ස්", 1), ("oltavia", 13), ("Dnumarq", 13), ("ember and oak", 39),
    ("EMBER%20&amp; OAK", 39), ("EMBER_OAK", 39), ("3 herons", 42), ("Three  Heron", 42), ("Coral Strand Moile", 50), ("coral strand", 50), ("Zrio", 53), ("zir", 53), ("Brand: Quilora!", 7),
    ("Gumadora", 0), ("Generic", 0), ("-", 0), ("???", 0), ("VLY", 0), ("Zara Official", 0), ("Mobile", 0), ("x" * 3000, 0),
]


def test_values(spark, reference):
    df = spark.createDataFrame([(v,) for v, _ in VALUES], "value string")
    assert {r.value: r.entry_id for r in cv.best_entries(df, cv.entries_of(reference)).collect()} == dict(VALUES)


def test_join_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
    left, right = [word() for _ in range(80)], [word() for _ in range(40)]
    frame = lambda xs: spark.createDataFrame([(x,) for x in set(xs)], "id string").select("id", cv.tokens_of(F.col("id")).alias("tokens"))
    a, b = frame(left), frame(right)
    sets = {r.id: set(r.tokens) for r in a.unionByName(b).collect()}
    for least in (0.28, 0.4, 0.6, 1.0):
        got = {(r.l, r.r): round(r.jaccard, 9) for r in cv.set_similarity_join(a, b, least).collect()}
        jac = lambda x, y: len(sets[x] & sets[y]) / len(sets[x] | sets[y])
        assert got == {(x, y): round(jac(x, y), 9) for x in set(left) for y in set(right) if jac(x, y) >= least}


def test_records(spark, reference):
    rows = [("t", 1, "Velonix"), ("t", 2, "velonix"), ("t", 2, "velonix"), ("t", 3, None), ("t", 4, " \t\xa0"), ("t", 5, "nobody"), ("t", 6, "")]
    df = spark.createDataFrame(rows, "source_table string, record_id bigint, value string")
    got = sorted((r.record_id, r.brand_id) for r in cv.mapped([df], reference).collect())
    assert got == [(2, 1), (2, 1), (5, 0)]
    assert cv.mapped([df.limit(0)], reference).count() == 0
    assert sorted((r.record_id, r.brand_id) for r in cv.mapped([df], reference.limit(0)).collect()) == [(1, 0), (2, 0), (2, 0), (5, 0)]


def test_recall_against_all_pairs(spark, data):
    """Every value of the whole tables whose edits allow an entry gets one, as a comparison with all entries would give."""
    values = spark.read.parquet(f"{data}/scraped_items.parquet").select(F.col("brand").alias("value")).unionByName(spark.read.parquet(f"{data}/tech_specs.parquet").select(F.col("brand").alias("value")))
    entries = cv.entries_of(spark.read.parquet(f"{data}/brand_reference.parquet"))
    got = {r.value: r.entry_id for r in cv.best_entries(values, entries).collect()}
    typed, listed = (cv._forms(df, n, v).collect() for df, n, v in ((values.where("value is not null").distinct(), "value", "value"), (entries, "entry_id", "name")))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1] - (a != b and sorted(a) == sorted(b))

    near = {r.value for r in typed for e in listed if distance(r.form, e.form) <= (cv.EDITS * len(e.form) if len(e.form) >= cv.SHORT else 0)}
    found = {v for v, e in got.items() if e}
    assert found <= near and len(found) >= 0.99 * len(near), near - found
