import random

import numpy as np
import pandas as pd
import pytest

from tallymark.llm import components, leakage, mojibake, names, near_dup, packing, quantiles, queries
from tests.conftest import agree, rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_agrees_with_sql(spark, name):
    agree(spark, name, queries.QUERIES[name], queries.ORACLE[name])


# ---- near-duplicate names
def _jaccard(a, b):
    x, y = ({s[i : i + 3] for i in range(len(s) - 2)} for s in (a, b))
    return len(x & y) / len(x | y) if x | y else 0


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abdeghiknoprtuv") for _ in range(rng.randint(4, 11))) for _ in range(60)]
    base = [" ".join(rng.sample(words, 9)) for _ in range(60)]
    typed = [b.replace(rng.choice(b.split()), rng.choice(words)) for b in base] + [" ".join(sorted(b.split())) for b in base[:20]]
    data = [(i, f" D{i % 3} ", x.title(), "clash", 1) for i, x in enumerate(base + typed + base[:10])]
    data += [(900, None, base[0], "c", 1), (901, "d0", None, "c", 1), (902, "d0", "N/A", "c", 1), (903, "d0", "..", "c", 1), (904, "d0", "ab", "c", 1), (905, "d0", "word " * 5000, "c", 1)]
    df = spark.createDataFrame(data, "record_id long, district string, work_name string, norm string, sig int")
    want = {(a[0], b[0]) for a in data[:150] for b in data[:150] if a[0] < b[0] and a[1] == b[1] and _jaccard(a[2].lower(), b[2].lower()) >= 0.65}
    got = [(r.record_a, r.record_b) for r in near_dup.record_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert near_dup.record_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("scan_ns, subset_ns, way", [(0.0, 60.0, "large"), (1e9, 1.0, "small"), (2.5, 150.0, None), (100.0, 3.0, None)])
@pytest.mark.parametrize("two", [False, True])
def test_small_and_large_sets_give_the_same_pairs(monkeypatch, scan_ns, subset_ns, way, two):
    monkeypatch.setattr(near_dup, "SCAN_NS", scan_ns)
    monkeypatch.setattr(near_dup, "SUBSET_NS", subset_ns)
    rng = random.Random(4)
    words = ["".join(rng.choice("abdeghiknoprtuv") for _ in range(rng.randint(3, 9))) for _ in range(80)]
    base = [" ".join(rng.sample(words, rng.randint(2, 12))) for _ in range(150)] + ["abc", "abcd"]
    typed = ["".join(c for k, c in enumerate(x) if k not in set(rng.sample(range(len(x)), min(len(x) - 1, rng.randint(0, 4))))) for x in base] + [" ".join(sorted(x.split())) for x in base]
    names = sorted({" ".join(x.split()) for x in base + typed if len(x) > 2})
    side = np.array([rng.randint(0, 1) if two else 0 for _ in names])
    ways = {}
    i, j, value = near_dup.alike(names, side, 0.65, ways)
    want = {(a, b) for a in range(len(names)) for b in range(a) if (not two or side[a] != side[b]) and _jaccard(names[a], names[b]) >= 0.65}
    assert {(max(p), min(p)) for p in zip(i.tolist(), j.tolist())} == want and len(i) == len(want) > 50
    assert all(abs(v - _jaccard(names[a], names[b])) < 1e-12 for a, b, v in zip(i, j, value))
    if way:
        assert ways[way] == len(names)


def test_no_pair_is_lost_to_frequent_words(spark):
    town = [(i, "d", f"construction of cement concrete road at ward number {i} mysuru city") for i in range(400)]
    df = spark.createDataFrame(town, "record_id long, district string, work_name string")
    assert near_dup.record_pairs(df).count() == 79_800
    rng = random.Random(1)
    words = ["drain", "culvert", "school", "temple", "market", "hostel", "bridge", "canal"]
    mixed = [(i, "d", " ".join(rng.sample(words, 5)) + f" {i}") for i in range(150)]
    want = {(a[0], b[0]) for a in mixed for b in mixed if a[0] < b[0] and _jaccard(a[2], b[2]) >= 0.65}
    assert len(want) > 100 and {tuple(r) for r in near_dup.record_pairs(spark.createDataFrame(mixed, "record_id long, district string, work_name string")).collect()} == want


def test_a_family_of_copies_that_fills_a_third_of_a_block(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "CHUNK", 50)  # several tiles
    rng = random.Random(8)
    base = "construction of concrete road from temple to primary school in ward seven"
    family = ["".join(rng.choice("bcdfg") if k in cut else c for k, c in enumerate(base)) for cut in (set(rng.sample(range(len(base)), 2)) for _ in range(70))]
    others = [" ".join("".join(rng.choice("abdeghiknoprtuv") for _ in range(7)) for _ in range(9)) for _ in range(140)]
    data = [(i, "d", x) for i, x in enumerate(family + others)]
    want = {(a[0], b[0]) for a in data for b in data if a[0] < b[0] and _jaccard(" ".join(a[2].split()), " ".join(b[2].split())) >= 0.65}
    assert len(want) > 500
    df = spark.createDataFrame(data, "record_id long, district string, work_name string")
    assert sorted(tuple(r) for r in near_dup.record_pairs(df).collect()) == sorted(want)


def test_a_sketch_never_hides_a_pair():
    a, b = ["construction of road at ward seven"], ["constrution of raod at ward seven near tank"]
    (n,), s = near_dup.sketches(a)
    (m,), t = near_dup.sketches(b)
    x, y = ({q[i : i + 3] for i in range(len(q) - 2)} for q in (a[0], b[0]))
    assert n == len(x) and int(np.bitwise_count((s ^ t).view(np.uint64)).sum()) <= len(x ^ y)


@pytest.mark.parametrize("two", [False, True])
def test_a_scan_leaves_only_pairs_at_the_threshold(monkeypatch, two):
    monkeypatch.setattr(near_dup, "PART", 130, raising=False)  # several parts, the last word of each not full
    rng = random.Random(12)
    syllables = [a + b for a in "bdgkmnrt" for b in "aeio"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    base = [f"repair of {word()} road near {word()} in {word()} " + " ".join(word() for _ in range(rng.choice((0, 1, 4, 40)))) for _ in range(400)]
    edited = [" ".join(word() if rng.random() < 0.2 else x for x in b.split()) for b in base for _ in range(2)]
    names = sorted({x.strip() for x in base + edited} | {"aaa", "aaaa", "aab", "abc", "a" * 300})
    side = np.array([rng.randint(0, 1) if two else 0 for _ in names])
    sets = near_dup.Sets(names, side, 0.65)
    i, j = sets.scan(0)
    got = [tuple(sorted(p)) for p in zip(sets.order[i].tolist(), sets.order[j].tolist())]
    subs = [{x[k : k + 3] for k in range(len(x) - 2)} for x in names]
    want = {(a, b) for b in range(len(names)) for a in range(b) if (not two or side[a] != side[b]) and len(subs[a] & subs[b]) >= 0.65 * len(subs[a] | subs[b])}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200
    assert -(-3_700_000 // near_dup.CHUNK) < 20  # copies of each name in the tiles of the largest block of 6.1 GB


# ---- percentiles
def test_percentiles_exact_and_summarised(spark):
    rng = np.random.default_rng(5)
    data = [("a", float(x), int(d)) for x, d in zip(np.round(rng.lognormal(10, 2, 3000), 2), rng.integers(0, 5, 3000))] + [("b", -5.0, 1), ("b", 0.0, 2), (None, 7.0, 1), ("c", None, 1), ("d", float("nan"), 1), ("e", float("inf"), 1)] + [("t", 3.0, 1)] * 500
    df = spark.createDataFrame(data, "g string, x double, part int")
    pdf = pd.DataFrame(data, columns=["g", "x", "d"]).dropna(subset=["x"])
    want = {(None if k != k else k): [np.sort(v.x.to_numpy())[max(0, -(-p * len(v) // 100) - 1)] for p in (50, 90, 95, 99)] for k, v in pdf.groupby("g", dropna=False)}
    got = {r[0]: list(r[2:]) for r in quantiles.percentiles(df, "g", "x").collect()}
    assert got == want
    near = quantiles.select(quantiles._values(df, "g", "x").selectExpr("g", "v", "1 as w"), [50, 99], finish=20)
    assert {(r.g, r.percent): r.v for r in near.collect() if r.g == "a"} == {("a", 50): want["a"][0], ("a", 99): want["a"][3]}
    parts = [quantiles.summarise(df.filter(f"part % 2 = {k}"), "g", "x", "part") for k in (0, 1)]
    for r in quantiles.percentiles_of_summary(parts[0].unionByName(parts[1]), "g").collect():
        for mine, true in zip(r[2:], want[r[0]]):
            assert mine == true or abs(mine - true) <= quantiles.ERROR * abs(true) * 1.0001
    assert quantiles.percentiles(df.limit(0), "g", "x").count() == 0


def test_pivots_are_proposed_on_the_problems_own_data(spark):
    rounds = []
    amounts = queries._amounts(spark, "/root/testdata/sf0.1")
    bins = quantiles.combine(quantiles.summarise(amounts, "district", "sanction_amount", "day"))
    got = quantiles.select(bins.selectExpr("g", "hi v", "n w"), [50, 99], rounds=rounds)
    assert len(rounds) >= 2 and len(rounds[0]) > len(rounds[-1]) and got.count() == 2 * bins.select("g").distinct().count()


# ---- names
REGISTER = [(1, "vendor", "Yitraivaal and Haakrikham Engineering Works", "Kachal"), (2, "vendor", "Chevruheebhai Sathiha Contractors", None), (3, "vendor", "Chevruheebhai Drokuzut Earthmovers", None),
            (4, "vendor", "Kotodrutaal Housing Developers LLP", None), (5, "agency", "Water Supply and Drainage Division, Bhishogaav", None), (6, "agency", "Zila Panchayat, Bhishogaav", None), (7, "agency", "Minor Irrigation Sub-Division at Bhishogaav", None)]


@pytest.mark.parametrize(
    "field, text, want",
    [
        ("v", "M/s. Yitraiwaal & Haakrieham Engg Works", 1), ("v", "HAAKRIKHAM and YITRAIVAAL ENGINEERING WKS", 1), ("v", "Messrs Kachal", 1), ("v", "C. Sathiha Contr.", 2), ("v", "Sathiha, Chevr - Contractors", 2),
        ("v", "Kotodrutaal Hsg Dev.", 4), ("v", "KotodrutalHousing Developers L.L.P.", 4), ("v", "Chevruheebhai Traders", None), ("v", "Chevruheebhai Sathiha Traders", None), ("v", "Kekruzuk Grabhoshu Enterprises", None),
        ("v", "Yitraivaal and Haakrikham Engineering Works", None), ("v", "", None), ("v", None, None), ("v", "N/A", None), ("v", "x" * 50_000, None), ("v", "???", None),
        ("a", "WS&D Division - Bhishogav", 5), ("a", "EE, Watersupply and Drainage Div., Bhisogaav", 5), ("a", "ZP (Bhishogaaw)", 6), ("a", "Distt. Panchayat Bhishogaav", 6), ("a", "MI SUB DIVN, BHISHOGAAV", 7), ("a", "RWC, Bhishogaav", None), ("a", "ZP Elsewhere", None),
    ],
)
def test_typed_names(field, text, want):
    kind, finder = "vendor" if field == "v" else "agency", names.Register
    held = [(i, n, s) for i, k, n, s in REGISTER if k == kind]
    got = None if not text or text in {n for _, n, _ in held} or text == "N/A" else finder(held).resolve(text)
    assert got == want


def test_long_names_and_offices_nobody_listed():
    places = ["Bhishogaav", "Kraikaikot", "Dhabilosar", "Nopukunta", "Kovrethal", "Vaidusar"]
    offices = [(10 * k + n, f"{p} {o}" if n % 2 else f"{o}, {p}", None) for k, p in enumerate(places) for n, o in enumerate(("Zila Panchayat", "Roads and Buildings Division", "Town Municipal Board"))]
    r = names.Register([*offices, (99, "Public Health Engineering Department, Bhishogaav", None)])
    assert r.resolve("Public Health Engg Dept, Bhishogaav") == 99 == r.resolve("o/o the public health engineering dept bhishogav")
    assert r.resolve("R&B Divn., Kraikaikot") == 11 and r.resolve("ZP Kraikaikott") == 10 and r.resolve("T.M. Board (Vaidusar)") == 52
    assert r.resolve("Forest Range, Bhishogaav") is None and r.resolve("Bhishogaav") is None
    five = names.Register([(1, "Harnesh Kotvaral Simdopa Brijeth Lumokar Traders", None), (2, "Wilvash Kotvaral Traders", None)])
    assert five.resolve("Harnesh Kotvaral Simdopa Brijath Lumokar Traders") == 1  # one letter
    assert five.resolve("Lumokar, Harnesh Kotvaral Simdopa Traders") == 1  # one left out
    assert five.resolve("Harnesh Kotvaral Traders") is None and five.resolve("H Kotvaral S Brijeth L Traders") == 1


def test_assignment_is_optimal():
    from itertools import permutations

    rng = random.Random(2)
    for n in (1, 2, 3, 5):
        for _ in range(30):
            gain = [[rng.choice([0, 0.3, rng.random()]) for _ in range(n)] for _ in range(n)]
            got = names.assign(gain)
            assert sorted(got) == list(range(n))
            assert abs(sum(gain[i][j] for i, j in enumerate(got)) - max(sum(gain[i][j] for i, j in enumerate(p)) for p in permutations(range(n)))) < 1e-9


def test_links_rows(spark):
    register = spark.createDataFrame(REGISTER, "entity_id long, kind string, name string, short_name string")
    data = [(1, "c sathiha contractors", "zp bhishogaav", "clash"), (2, None, "N/A", ""), (3, "c sathiha contractors", REGISTER[5][2], ""), (4, "", "nowhere", "")]
    df = spark.createDataFrame(data, "record_id long, vendor_name string, implementing_agency string, name string")
    fields = {"vendor_name": "vendor", "implementing_agency": "agency"}
    assert rows(names.link(df, register, fields)) == [(1, "implementing_agency", 6), (1, "vendor_name", 2), (3, "vendor_name", 2)]
    assert rows(names.link(df.limit(0), register, fields)) == [] == rows(names.link(df, register.limit(0), fields))


def test_deletes_and_edits():
    assert names.edits("abcd", "abdc", 2) == 1 and names.edits("kitten", "sitting", 2) == 3
    assert all((names.edits(a, b, 2) <= 2) <= bool(names.deletes(a, 2) & names.deletes(b, 2)) for a in ("trader", "tarder", "tader") for b in ("traders", "trdr", "trade"))


# ---- groups
def _groups(edges):
    head = {}

    def find(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in head)


@pytest.mark.parametrize("bound", [components.BOUND, 20])
def test_groups_against_brute_force(spark, bound, monkeypatch):
    rng = random.Random(7)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + chain + [(500, x) for x in range(501, 540)]
    edges = [(a, b) for a, b in edges if a != b]
    rng.shuffle(edges)
    df = spark.createDataFrame([*edges, *edges[:9], *[(b, a) for a, b in edges[:9]], (5, 5), (None, 3), (4, None)], "u long, v long").repartition(7)
    assert sorted(map(tuple, components.groups(df, bound=bound).collect())) == _groups(edges)


def test_shared_keys_and_empty(spark):
    records = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b"), (6, "a")], "record_id long, work_id string")
    matches = spark.createDataFrame([(6, 5, "same"), (3, 4, "different"), (3, None, "same"), (3, 3, "same")], "record_a long, record_b long, verdict string")
    assert rows(components.match_groups(records, matches)) == [(1, 1), (2, 1), (5, 1), (6, 1)]
    assert rows(components.match_groups(records.limit(0), matches.limit(0))) == []


# ---- packing
def test_packing_holds_its_promises(spark):
    rng = random.Random(2)
    sizes = [(i, rng.choice([0, 1, 7, 64, 100, 250, 511, 512, 513, 1600])) for i in range(600)]
    counts = spark.createDataFrame(sizes, "doc_id long, tokens long")
    packed = packing.pack(counts, 512, per_part=100)
    pdf = packed.toPandas()
    assert pdf.groupby("bin").tokens.sum().max() <= 512
    assert pdf.groupby("doc_id").tokens.sum().to_dict() == {d: t for d, t in sizes if t}
    assert (pdf.groupby("doc_id").size() == [-(-t // 512) for d, t in sizes if t]).all()
    kinds, n = np.unique(pdf.tokens, return_counts=True)
    least = packing.lower_bound(kinds.astype(np.int64), n, 512)
    assert least <= pdf.bin.nunique() <= least + 3
    assert packing.pack(counts.limit(0), 512).count() == 0
    none = spark.createDataFrame([], "container string, capacity_tokens long")
    assert packing.pack_all(counts, none).count() == 0


def test_partitions_with_gaps_exchange_texts(spark):
    rng = np.random.default_rng(6)
    sizes = np.concatenate([rng.integers(150, 380, 900), rng.integers(20, 60, 100)])
    counts = spark.createDataFrame([(i, int(t)) for i, t in enumerate(sizes)], "doc_id long, tokens long")
    packed = packing.pack(counts, 512, per_part=100).toPandas()
    stage, part = packed.bin.to_numpy() >> 56, packed.bin.to_numpy() >> 32
    assert set(stage.tolist()) >= {1, 2}  # the pool was packed again
    part_of = counts.withColumn("p", packing.F.pmod(packing.F.xxhash64("doc_id", packing.F.lit(0), packing.F.lit(1)), packing.F.lit(10))).toPandas()
    alone = sum(max(packing.best_fit_decreasing(g.tokens.tolist(), 512)) + 1 for _, g in part_of.groupby("p"))
    assert packed.groupby("bin").tokens.sum().max() <= 512 and sorted(packed.doc_id) == list(range(1000))
    assert packed.bin.nunique() < alone


def test_best_fit_and_bounds():
    sizes = [6, 6, 4, 4, 3, 3, 2, 2]
    bins = packing.best_fit_decreasing(sizes, 10)
    assert max(bins) + 1 == 3 and all(sum(s for s, b in zip(sizes, bins) if b == k) <= 10 for k in bins)
    assert packing.lower_bound(np.array([6]), np.array([5]), 10) == 5


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "A road."), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "word " * 60_000)], "doc_id long, text string")
    got = dict(rows(packing.token_counts(df)))
    assert got.keys() == {1, 4, 5} and got[1] == 3 and got[4] > 1 and got[5] >= 60_000


# ---- leaks
def test_leaks(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    item = [rng.choice(vocabulary) for _ in range(90)]
    other = [rng.choice(vocabulary) for _ in range(90)]
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, None), (4, "too short"), (5, " ".join(item))], "item_id long, text string")
    docs = [
        (1, "See: " + ", ".join(item[10:22]).upper() + "! end"), (2, " ".join(item[10:21])), (3, None), (4, ""), (5, " ".join(other[:40] + item[50:70])), (6, " ".join(reversed(item))),
        (7, ("pad " * 12_000) + " ".join(other[-12:])), (8, " ".join(item[10:16] + ["x"] + item[17:22])), (1, " ".join(item[:12])),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = leakage.leaks(df, items)
    assert rows(got.filter("exact").select("doc_id", "item_id")) == [(1, 1), (1, 1), (1, 5), (1, 5), (5, 1), (5, 2), (5, 5), (7, 2)]
    assert leakage.leaks(df.limit(0), items).count() == 0 and leakage.leaks(df, items.limit(0)).count() == 0


def test_every_fingerprint_within_the_radius_is_found():
    rng = np.random.default_rng(0)
    index = leakage.ItemIndex([1, 2], [" ".join(f"w{i * 7 % 97}" for i in range(s, s + 80)) for s in (0, 50)])
    prints = index.prints[rng.integers(0, len(index.prints), 200)]
    for _ in range(leakage.RADIUS):
        prints = prints ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    left, right = index.blocks.candidates(prints)
    want = {(i, j) for i, p in enumerate(prints) for j, q in enumerate(index.prints) if int(np.bitwise_count(p ^ q)) <= leakage.RADIUS}
    assert set(zip(left.tolist(), right.tolist())) == want


def test_edited_items_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randint(70, 130))]) for i in range(40)]
    docs = []
    for d in range(120):
        words = list(items[d % 40][1])
        for _ in range(1 + d % 3):
            k = rng.randrange(len(words))
            words[k : k + rng.randint(0, 1)] = [] if rng.random() < 0.3 else [rng.choice(vocabulary)]
        docs.append((d, " ".join([rng.choice(vocabulary) for _ in range(rng.randint(0, 60))] + words + [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))])))
    docs += [(200, None), (201, ""), (202, "too short"), (203, "pad " * 30_000), (204, " ".join(items[3][1])), (204, " ".join(items[3][1]))]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(90, None), (91, "a b")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = leakage.WholeItems([i for i, _ in items], [" ".join(w) for _, w in items], radius=63)  # every window is a candidate
    ids = [d for d, t in docs if t]
    want = {(d, i) for d, i, _ in index.search(ids, [leakage.words_of(t) for _, t in docs if t])}
    got = [(r.doc_id, r.item_id) for r in leakage.near_leaks(df, table).collect()]
    assert len(got) == len(set(got)) + 1 and set(got) <= want and len(want) > 60
    assert len(set(got)) >= 0.97 * len(want)
    assert leakage.near_leaks(df.limit(0), table).count() == 0 and leakage.near_leaks(df, table.limit(0)).count() == 0


# ---- garbled text
def test_garbled_text(spark):
    clean = [f"The estimate of ₹{i} rests on the café’s slope of {i}° near plot {i}–{i + 1}, as révisé by the office." for i in range(40)]
    swapped = clean[7].encode("utf-8").decode("cp437")
    twice = clean[8].encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1")
    entities = clean[9].replace("’", "&acirc;&#128;&#153;")
    lost = clean[10].replace("’", "���")
    data = [*enumerate(clean), (100, swapped), (101, twice), (102, entities), (103, lost), (104, None), (105, ""), (106, "plain"), (107, "Contact: Âmbar & Ílhavo Survey, Ångvik–Øresta «π» ½"), (108, swapped), (109, "&eacute;tude & more"), (110, "ok " * 20_000 + "m²")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in data], "doc_id long, text string, run string")
    got = {(r.doc_id, r.text) for r in mojibake.mended(df).collect()}
    assert {i for i, _ in got} == {100, 101, 102, 103, 108}
    assert {(100, clean[7]), (101, clean[8]), (102, clean[9]), (108, clean[7])} <= got
    assert mojibake.mended(df.limit(0)).count() == 0


def test_single_byte_swaps_need_neighbours(spark):
    line = "Le marché de travaux est clos. La façade du bâtiment est finie. On a noté les malfaçons et l’usure des lieux, jusqu’à la fin du mois de mai. La tête du pont et la sécurité du site."
    data = [(i, f"Lot {i}. {line}") for i in range(400)] + [(900, line.encode("cp1252").decode("mac_roman")), (901, "Les pièces. " + line.encode("cp1252").decode("mac_roman"))]
    got = {r.doc_id: r.text for r in mojibake.mended(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got.keys() == {900, 901} and got[900] == line


def test_a_code_that_no_encoding_explains_is_learned(spark):
    strange = {"é": "ⱠⱡꜢ"[:2], "à": "Ⱡꜣ", "ç": "Ⱡꜥ", "ê": "ⱠꜦ", "ô": "Ⱡꜧ"}
    lines = [f"Le marché numéro {i} est clos, la façade du bâtiment près du pont est terminée à temps, la tête aussi, côté nord." for i in range(60)]
    twist = lambda t: "".join(strange.get(c, c) for c in t)
    data = [*enumerate(lines), *((100 + i, twist(lines[i])) for i in range(6)), (200, twist("Autre chose : la clôture du café, déjà reçue."))]
    got = {r.doc_id: r.text for r in mojibake.mended(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got.keys() == {*range(100, 106), 200} and got[103] == lines[3] and got[200] == "Autre chose : la clôture du café, déjà reçue."


def test_a_fault_common_in_one_source_is_no_usage(spark):
    line = "Le marché de travaux est clos. La façade du bâtiment est finie. On a noté les malfaçons et l’usure des lieux, jusqu’à la fin du mois de mai. La tête du pont et la sécurité du site."
    swapped = line.encode("cp1252").decode("mac_roman")
    data = [(i, f"Lot {i}. {line}", f"s{i % 5}") for i in range(400)] + [(900 + i, f"Lot {i}. {swapped}", "bad") for i in range(100)]
    got = {r.doc_id for r in mojibake.mended(spark.createDataFrame(data, "doc_id long, text string, source string"), source="source").collect()}
    assert got == set(range(900, 1000))


def test_sources_beyond_those_kept_apart_are_judged_without_their_own_faults_too(spark, monkeypatch):
    line = "Le marché de travaux est clos. La façade du bâtiment est finie. On a noté les malfaçons et l’usure des lieux, jusqu’à la fin du mois de mai. La tête du pont et la sécurité du site."
    swapped = line.encode("cp1252").decode("mac_roman")
    data = [(i, f"Lot {i}. {line}", f"s{i % 3}") for i in range(400)] + [(900 + i, f"Lot {i}. {swapped}", "bad") for i in range(100)]
    df = spark.createDataFrame([*data, (1000, None, "bad"), (1001, "plain", "x"), (1002, f"Lot 7. {line}", None)], "doc_id long, text string, source string")
    found = lambda: sorted((r.doc_id, r.text) for r in mojibake.mended(df, source="source").collect())
    want = found()
    assert {i for i, _ in want} == set(range(900, 1000))
    monkeypatch.setattr(mojibake, "SOURCES", 2)
    monkeypatch.setattr(mojibake, "TOGETHER", 30)
    assert found() == want


def test_a_code_is_learned_behind_any_number_of_more_frequent_sequences(spark):
    common = spark.range(100_001).selectExpr("lpad(conv(id, 10, 36), 4, '0') seq", "'é' char", "9L n", "true fit")
    code = spark.createDataFrame([("Ⱡꜣ", "à", 3, True), ("Ⱡꜥ", "ç", 3, True), ("ⱠꜦ", "ê", 3, True), ("Ⱡꜧ", "ô", 3, False), ("ⱠꜨ", "ô", 2, True), ("Ⱡꜩ", "ô", 3, True), ("Ⱡꜩ", "û", 3, True)], common.schema)
    assert mojibake.codes(common.unionByName(code)) == {"Ⱡꜣ": "à", "Ⱡꜥ": "ç", "ⱠꜦ": "ê"}


def test_more_containers_than_the_bound_are_an_error(spark):
    sizes = spark.createDataFrame([("x", 5)], "doc_id string, tokens long")
    containers = spark.range(1001).selectExpr("cast(id as string) container", "10 capacity_tokens")
    with pytest.raises(ValueError):
        packing.pack_all(sizes, containers)
