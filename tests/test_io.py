import pytest

from tallymark.operators import entities, groups, reports
from tallymark.sources import io
from tallymark.streaming import windows
from tests.conftest import rows


def test_csv_with_quarantine(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_text('Work ID,District,work-name\nW1,"Pune, city",Road\nW2,too,many,fields\nW3,N/A,\nW4,few\n', encoding="utf-8")
    good, bad = io.read_csv(spark, str(p))
    assert rows(good) == [("W1", "Pune, city", "Road"), ("W3", "N/A", "")] or rows(good) == [("W1", "Pune, city", "Road"), ("W3", "N/A", None)]
    assert sorted(r.n_fields for r in bad.collect()) == [2, 4] and all(len(r.preview) <= 200 for r in bad.collect())
    loaded = io.load_register(spark, str(p))
    assert loaded.columns[:2] == ["work_id", "work_name"] and loaded.select("record_id").distinct().count() == 2
    (tmp_path / "e.csv").write_text("")
    assert io.read_csv(spark, str(tmp_path / "e.csv"))[0].count() == 0


def test_columns(spark):
    df = spark.createDataFrame([("a", "b")], ["Work ID", "work-id"])
    with pytest.raises(io.IngestionError):
        io.normalise_columns(df)
    with pytest.raises(io.IngestionError):
        io.align(df)


def test_sinks_and_index(spark, tmp_path):
    df = spark.createDataFrame([(1, None, ["a", "b"]), (2, "x", [])], "b int, a string, c array<string>")
    io.write_jsonl(df, str(tmp_path / "log"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == ['{"a":"x","b":2,"c":[]}', '{"a":null,"b":1,"c":["a","b"]}']
    io.write_jsonl(df, str(tmp_path / "log"), append=True)
    assert io.read_jsonl(spark, str(tmp_path / "log"), "a string, b int").count() == 4
    assert io.read_jsonl(spark, str(tmp_path / "none"), "a string").count() == 0
    io.write_csv(df, str(tmp_path / "out.csv"))
    assert spark.read.csv(str(tmp_path / "out.csv"), header=True).filter("c = 'a|b'").count() == 1
    (tmp_path / "x.pdf").write_bytes(b"1")
    kinds = {r.path.rsplit("/", 1)[1]: (r.kind, r.usable) for r in io.discover(spark, str(tmp_path)).collect()}
    assert kinds["x.pdf"] == ("report", False)


def test_artifacts(tmp_path):
    io.save_artifacts(str(tmp_path), [1.0, 2.0], {"road": 1.5})
    assert io.load_artifacts(str(tmp_path)) == ([1.0, 2.0], {"road": 1.5})
    with pytest.raises(FileExistsError):
        io.save_artifacts(str(tmp_path), [1.0], {})
    io.save_artifacts(str(tmp_path), [2.0, 1.0], {}, overwrite=True)
    with pytest.raises(ValueError):
        io.load_artifacts(str(tmp_path))


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").coalesce(1)
    events.write.parquet(str(tmp_path / "in"))
    query = windows.follow(spark, str(tmp_path / "in"), events.schema, str(tmp_path / "out"), str(tmp_path / "ck"), "1 day")
    query.awaitTermination(120)
    streamed = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r.start, r.event_type): r.n for r in windows.counts(events, "1 day").collect()}
    assert streamed and all(batch[k] == n for k, n in streamed.items())
    last = max(k[0] for k in batch)
    assert {k for k in batch if k[0] < last} <= set(streamed)  # the last window may still be open


def test_encoding_is_decided_on_the_whole_file(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_bytes(b"work_id,work_name\n" + b"1,road\n" * 1500 + "2,école\n".encode("cp1252"))
    assert [r.work_name for r in io.read_any(spark, str(path)).filter("work_id = '2'").collect()] == ["école"]


def test_components(spark):
    pairs = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (21, 21), (None, 1), (5, None), (1, 2), (30, 31), (31, 32), (32, 33), (33, 34), (34, 35)]
    got = dict(rows(groups.components(spark.createDataFrame(pairs, "a long, b long"))))
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20, **{i: 30 for i in range(30, 36)}}
    assert groups.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_work_entities(spark):
    import datetime as dt

    day = dt.date(2021, 5, 1)
    data = [(1, "CC road at ward 4 tank", 100.0, "pune", "pwd", day), (2, "constrn of CC road ward 4 tank", 105.0, "pune", "pwd", day), (3, "CC road at ward 4 tank", 300.0, "pune", "pwd", day),
            (4, "CC road at ward 4 tank", 100.0, "nashik", "pwd", day), (5, None, None, None, None, None)]
    df = spark.createDataFrame(data, "record_id long, work_name string, sanction_amount double, district string, implementing_agency string, date_approval date").selectExpr("*", "date_approval as date_proposal", "date_approval as date_completion")
    got = {r.record_id: (r.work_entity, r.group_size, r.confidence, r.consistency) for r in entities.work_entities(df).collect()}
    assert got[1] == got[2] and got[1][1:3] == (2, "MEDIUM") and got[3][1] == got[4][1] == got[5][1] == 1 and got[5][2:] == ("LOW", "AMBIGUOUS")
    assert entities.work_entities(df.limit(0)).count() == 0


def test_fuzzy_firms(spark):
    df = spark.createDataFrame([("sharma builders pune",), ("sharma buildars pune",), ("kumar",), ("kumari",), (None,)], "vendor_normalised string")
    assert rows(entities.fuzzy_firms(df)) == [("sharma buildars pune", "sharma buildars pune"), ("sharma builders pune", "sharma buildars pune")]


def _deliveries(spark, data):
    import datetime as dt

    rows = [(i, n, c, "pune", "pwd", dt.date(2021, 5, 1)) for i, (n, c) in enumerate(data)]
    return spark.createDataFrame(rows, "record_id long, work_name string, sanction_amount double, district string, implementing_agency string, date_approval date").selectExpr("*", "date_approval as date_proposal", "date_approval as date_completion")


def test_work_entities_of_more_than_fifty_deliveries(spark):
    names = [f"cc road at ward {i % 4} near tank" for i in range(70)] + ["zilla hospital boundary wall"] * 60
    got = [r.group_size for r in entities.work_entities(_deliveries(spark, [(n, 100.0 + i % 3) for i, n in enumerate(names)])).orderBy("record_id").collect()]
    assert got == [70] * 70 + [60] * 60


def test_work_entities_look_at_all_names_of_a_group(spark):
    chain = ["pqrs tuvw xyza bcde fghi jklm nopq", "pqrs tuvw xyza bcde fghi", "xyza bcde fghi jklm nopq"]
    got = entities.work_entities(_deliveries(spark, [(n, 100.0) for n in chain])).collect()
    assert {(r.group_size, r.consistency, tuple(r.conflicting)) for r in got} == {(3, "CONFLICTING", ("scheme:UNVERIFIABLE", "work_name"))}


def test_close_works_against_brute_force(monkeypatch):
    import random

    import pandas as pd

    rng, calls, plain = random.Random(2), [], entities.SequenceMatcher
    word = lambda: "".join(rng.choice("kgtdnprsmlv") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5)))
    names = [" ".join(["construction of", *(word() for _ in range(rng.randrange(1, 18)))]) for _ in range(150)]
    names += [" ".join(word() for _ in range(35)) for _ in range(6)] + ["सड़क निर्माण वार्ड " + word() for _ in range(4)] + ["of", "the"]
    for n in names[:150:7] + names[150:156]:
        t = n.split()
        names += [n[:-2] + "x", " ".join(t[::-1]), n[: len(n) * 2 // 3] + word(), n + n[5:30]]
    names = [*dict.fromkeys(names)]
    g = pd.DataFrame({"name": names, "cost": [100.0 + i % 25 for i in range(len(names))], "lo": range(len(names)), "hi": range(len(names)), "range": 0, "tile": 0})
    close = [(a, b) for a in range(len(names)) for b in range(len(names)) if a < b and abs(a % 25 - b % 25) <= 0.1 * (100 + min(a % 25, b % 25))]
    want, got = _Heads(), _Heads()
    for a, b in close:
        if entities.name_similarity(names[a], names[b]) >= entities.WEAK:
            want.join(a, b)
    monkeypatch.setattr(entities, "SequenceMatcher", lambda *x: calls.append(1) or plain(*x))
    for a, b in entities._close_works(g).itertuples(index=False):
        got.join(a, b)
    assert [got.find(i) for i in g["lo"]] == [want.find(i) for i in g["lo"]]
    assert len(calls) < len(close) / 10  # pairs are left out by bounds of many at once


class _Heads(dict):
    def find(self, x):
        while self.get(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a


def test_fuzzy_firms_against_brute_force(spark, monkeypatch):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(1)
    base = ["sharma construction company pune"] + [f"s{rng.choice('aeiou')}{rng.randrange(10**6)} construction company" for _ in range(220)]
    names = sorted({*base, *(b.replace("c", "k", 1) for b in base[:40])})
    want = {(a, b) for a in names for b in names if a < b and SequenceMatcher(None, a, b).ratio() >= 0.92}
    head = {n: n for n in names}
    for _ in range(len(names)):
        for a, b in want:
            head[a] = head[b] = min(head[a], head[b])
    paired = {x for p in want for x in p}
    df = spark.createDataFrame([(n,) for n in names], "vendor_normalised string")
    for chunk in (4096, 60):
        monkeypatch.setattr(entities, "CHUNK", chunk, raising=False)
        assert dict(rows(entities.fuzzy_firms(df))) == {n: head[n] for n in paired}


def test_agreement_weights(spark):
    import random

    rng = random.Random(0)
    data = [tuple(int(rng.random() < (0.95 if s else 0.05)) for _ in range(3)) for s in [1] * 300 + [0] * 700]
    m, u, share = reports.agreement_weights(spark.createDataFrame(data, "a int, b int, c int"), ["a", "b", "c"], 40)
    assert min(m) > 0.88 and max(u) < 0.12 and abs(share - 0.3) < 0.05


def test_reports_are_canonical(spark, tmp_path):
    import json

    from tallymark.sources import io

    df = spark.createDataFrame([("b", float("nan")), ("a", float("inf"))], "k string, v double")
    io.write_report(df, str(tmp_path / "r.json"), "k")
    held = (tmp_path / "r.json").read_text(encoding="utf-8")
    assert json.loads(held) == [{"k": "a", "v": "inf"}, {"k": "b", "v": "nan"}] and held == json.dumps(json.loads(held), sort_keys=True, indent=2) + "\n"


def test_quoted_separators_are_not_counted(spark, tmp_path):
    from tallymark.sources import io

    (tmp_path / "q.csv").write_text('work_id,work_name\n1,"a, b"\n2,"c, d",x\n', encoding="utf-8")
    rows, bad = io.read_csv(spark, str(tmp_path / "q.csv"))
    assert [r.work_name for r in rows.collect()] == ["a, b"] and [r.n_fields for r in bad.collect()] == [3]
