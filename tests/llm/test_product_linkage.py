import random

import pytest

from bazaarlake.llm import product_linkage as pl

REFERENCE = [(1, "Velonix", ["VLX"]), (2, "Ember & Oak", []), (3, "Gloamtek", None)]
COLUMNS = "id bigint, brand string, model_family string, sub_model string, storage_gb int, ram_gb int, region_code string, raw_title string, clean_title string, attributes string, line string, key string"


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame(REFERENCE, "brand_id bigint, brand_name string, aliases array<string>")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], COLUMNS)


SAME = [
    (1, "Velonix", "Mates 4410", "lite", 128, 8, "", "Velonix Mates 4410 Lite 8/128GB Black", "", "{}"), (2, None, None, None, None, None, None, "FREE DELIVERY VLX MATES-4410 LITE 8192MB RAM - 128 GB Sealed", None, None),
    (3, "velonix", "Mates", "Lite", 131072, 8192, "", "Mates4410 lite new by velonix + Free Back Cover", None, "{}"), (4, "Velonix", None, "", None, None, None, "Velonix Mattes 4410 Lite 8GB+128GB (not used)", None, '{"RAM": "8 gigs"}'),
    (5, None, "Mates 4410", "lite", 128, 8, "", "Mates 4410 Lite", "", "{}"), (5, None, "Mates 4410", "lite", 128, 8, "", "Mates 4410 Lite", "", "{}"),
]
OTHERS = [
    (10, "Velonix", "Mates 4410", "pro", 128, 8, "", "Velonix Mates 4410 Pro 8/128GB", "", "{}"), (11, "Velonix", "Mates 4410", "lite", 128, 8, "", "Velonix Mates 4410 Lite 8/256GB", "", "{}"), (12, "Velonix", "Mates 4410", "lite", 128, 8, "", "Velonix Mates 4410 Lite 12/128GB", "", "{}"),
    (13, "Velonix", "Mates 4411", "lite", 128, 8, "", "Velonix Mates 4411 Lite 8/128GB", "", "{}"), (14, "Velonix", "Mates 4410", "lite", 128, 8, "", "Velonix Mates 4410 Lite 8/128GB (USED)", "", "{}"), (15, "Velonix", "Mates 4410", "lite", 128, 8, "", "Velonix Mates 4410 Lite 8/128GB Dubai set", "", "{}"),
    (16, "Velonix", "Mates 4410", "lite", 128, 8, "", "Velonix Mates 4410 Lite 8/128GB", "", '{"condition": "refurbished"}'), (17, None, None, None, None, None, None, None, None, None), (18, "Gloamtek", "Pumon 4410", "lite", 128, 8, "", "Gloamtek Pumon 4410 Lite 8/128GB", "", "broken"), (19, None, None, None, None, None, None, "", "", ""),
]


def test_same_and_other_products(spark, reference):
    got = {r.id: r.group_id for r in pl.groups(frame(spark, SAME + OTHERS), reference).collect()}
    assert {got[k] for k in (1, 2, 3, 5)} == {1}
    assert len({got[r[0]] for r in OTHERS if r[0] not in (17, 19)} | {1}) == len(OTHERS) - 2 + 1
    assert got[17] == got[19] == 17


def test_typed_lines_link_when_enough_rows_agree(spark, reference):
    rng = random.Random(2)
    lines = ["Rokifu", *("".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)).title() for _ in range(40))]
    rows = []
    for k in range(600):
        line = rng.choice(lines)
        number, ram = str(1000 + 7 * lines.index(line) + rng.randrange(3)), rng.choice([4, 8])
        rows.append((k, "Velonix", None, None, None, None, None, f"Velonix {line} {number} {rng.choice(['Pro ', ''])}{ram}/128GB", None, None))
    rows += [(900, "Velonix", None, None, None, None, None, "Velonix Rokfiu 1001 Pro 8/128GB", None, None)]
    got = {r.id: r.group_id for r in pl.groups(frame(spark, rows), reference).collect()}
    true = {}
    for r in rows:
        true.setdefault(r[7].replace("Rokfiu", "Rokifu"), set()).add(r[0])
    assert {frozenset(v) for v in true.values()} == {frozenset(k for k in got if got[k] == g) for g in set(got.values())}


def phones(rng, n=1200):
    """Rows of phones, each told by title and columns; some products recur often, as in a catalogue, with siblings beside them."""
    lines = ["Rokifu", *("".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)).title() for _ in range(40))]
    products = [("Rokifu", 1001, "Pro ", 128, 8)]
    for k, line in enumerate(lines):
        products += [(line, 1000 + 7 * k + rng.randrange(3), rng.choice(["Pro ", "Lite ", ""]), rng.choice([64, 128, 256]), 4 if rng.random() < 0.05 else 8) for _ in range(6)]
    popular = [1 / (1 + rng.randrange(40)) for _ in products]
    rows = []
    for k in range(n):
        line, number, sub, storage, ram = rng.choices(products, popular)[0] if k else products[0]
        typed = line[:2] + line[3] + line[2] + line[4:] if k and rng.random() < 0.04 else line  # a slip in the title; the column is right
        rows.append((k, "Velonix", f"{line} {number}", None, storage, ram, None, f"Velonix {typed} {number} {sub}{ram}/{storage}GB", None, None))
    return rows


def test_open_memory_joins_what_fits_and_only_that(spark, reference):
    rows = phones(random.Random(4))
    rows += [(1800 + k, "Velonix", "Zanolo 5001", None, 128, 8, None, "Velonix Zanolo 5001 8/128GB", None, None) for k in range(3)]
    rows += [(1810, "Velonix", "Zanolo 5001", None, 128, None, None, "Velonix Zanolo 5001 128GB", None, None)]  # the only Zanolo 5001 of 128 GB has 8 GB
    rows += [(1820 + k, "Velonix", "Tufelo 6001", None, 128, 4 + 4 * (k % 2), None, f"Velonix Tufelo 6001 {4 + 4 * (k % 2)}/128GB", None, None) for k in range(4)]
    rows += [(1830, "Velonix", "Tufelo 6001", None, 128, None, None, "Velonix Tufelo 6001 128GB", None, None)]  # 4 or 8 GB: told by nothing
    rows += [(1840, "Velonix", "Kamiro", None, 64, 8, None, "Velonix Kamiro 8/64GB", None, None), (1841, "Velonix", "Kamirro", None, 64, 8, None, "Velonix Kamirro 8/64GB", None, None)]
    got = {r.id: r.group_id for r in pl.groups(frame(spark, rows), reference).collect()}
    assert {got[k] for k in (1800, 1801, 1802, 1810)} == {1800}
    assert got[1820] == got[1822] != got[1821] == got[1823] and got[1830] == 1830


def test_weights_decide(spark, reference, monkeypatch):
    """Without the fit, which holds a misspelt line for a match, only equal descriptions are together."""
    rows = [*phones(random.Random(4)), (1900, "Velonix", None, None, 128, 8, None, "Velonix Rokfiu 1001 Pro 8/128GB", None, None)]
    grouped = lambda: {r.id: r.group_id for r in pl.groups(frame(spark, rows), reference).collect()}
    same = {r[0] for r in rows if r[7] == "Velonix Rokifu 1001 Pro 8/128GB"}
    assert same and grouped()[1900] == min(same)
    real = pl.fit
    monkeypatch.setattr(pl, "fit", lambda patterns, twice: {p: float(all(v == 3 for v in p)) for p in real(patterns, twice)})
    assert grouped()[1900] == 1900


def test_rows_that_tell_a_field_twice_teach_how_often_it_differs():
    patterns = [((3, 3, 3), 1000.0), ((3, 3, 0), 40.0), ((3, 0, 0), 300.0), ((0, 3, 0), 300.0), ((3, 0, 3), 200.0), ((3, 1, 3), 10.0)]
    sure = pl.fit(patterns, [{3: 900.0}, {3: 900.0}, {3: 900.0}])
    doubtful = pl.fit(patterns, [{3: 900.0}, {3: 900.0}, {3: 600.0, 0: 300.0}])
    assert sure[(3, 3, 0)] < 0.2 < doubtful[(3, 3, 0)] and sure[(3, 3, 3)] > 0.9
    assert sure[(3, 0, 3)] < sure[(3, 1, 3)] < sure[(3, 3, 3)]


def test_large_blocks_are_compared_in_parts(spark, monkeypatch):
    rows = [(k, 1, "velonix", "mates", "44", f"s{k % 7}", k, 128, "", "new") for k in range(40)]
    nodes = spark.createDataFrame(rows, "node long, rows long, brand string, line string, number string, sub string, ram long, storage long, region string, condition string")
    whole = sorted(map(tuple, pl.compared(nodes).collect()))
    monkeypatch.setattr(pl, "BLOCK", 6)
    assert sorted(map(tuple, pl.compared(nodes).collect())) == whole and len(whole) == 40 * 39 // 2


def test_pairs_of_groups_are_whole_and_once(spark, monkeypatch):
    monkeypatch.setattr(pl, "SPLIT", 3)
    rows = [(k, 1) for k in range(20)] + [(50, 50), (60, 60), (61, 60), (61, 60)]
    got = sorted(map(tuple, pl.pairs_of(spark.createDataFrame(rows, "id bigint, group_id bigint")).collect()))
    assert got == [(a, b) for a in range(20) for b in range(a + 1, 20)] + [(60, 61)]


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (10, 11), (7, 7)]
    got = {r.node: r.label for r in pl.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 10: 10, 11: 10}
    assert pl.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_expectation_maximisation_tells_matches_apart():
    rng = random.Random(7)
    counts = {}
    for k in range(4000):
        match = k % 4 == 0
        p = tuple(3 if rng.random() < (0.97 if match else 0.3) else 0 for _ in range(6))
        counts[p] = counts.get(p, 0) + 1
    chance = pl.fit(list(counts.items()))
    assert chance[(3,) * 6] > 0.95 and chance[(0,) * 6] < 0.01
    assert pl.fit([]) == {}


def test_nothing_gives_nothing(spark, reference):
    assert pl.groups(frame(spark, []), reference).count() == 0
    assert pl.groups(frame(spark, SAME), reference.limit(0)).count() == 6
