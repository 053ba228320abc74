import datetime as dt

import pytest

from tallymark.operators import recover
from tests.conftest import rows

GOOD = "RW-KA-000000001|Road, ward 7|Mysuru|Karnataka|Rs. 1,25,000.50|1.2E5|2019-03-01|20/5/2019|Jan 15, 2020|ZP|Iyer|completed"


def reasons(spark, *lines):
    df = spark.createDataFrame([(i, "|", x) for i, x in enumerate(lines)], "line_id long, sep string, raw string")
    return rows(recover.rejected(recover.read_lines(df)))


@pytest.mark.parametrize(
    "text, value",
    [("₹850000.00", 850000.0), ("rs 1,27,959.50", 127959.5), ("INR 5", 5.0), ("1.787E5", 178700.0), (" 7 ", 7.0), ("nan", None), ("", None), ("0", 0.0)],
)
def test_amounts(text, value):
    assert recover.amount_of(text) == value


@pytest.mark.parametrize("text", ["-1", "1.2e400", "infinity", "0x10", "212000..00", "+-4", "Rs.", "5 lakh", "1,,2", "(7)", "8%"])
def test_bad_amounts(text):
    with pytest.raises(ValueError):
        recover.amount_of(text)


@pytest.mark.parametrize("text", ["2019-03-01", "1-3-2019", "01/03/2019", "2019/3/1", "1.3.2019", "1 Mar 2019", "01 march 2019", "March 1, 2019", "MAR 1, 2019", "20190301"])
def test_dates(text):
    assert recover.date_of(text) == dt.date(2019, 3, 1)


@pytest.mark.parametrize("text", ["2019-02-30", "31/06/2019", "20200-01-01", "12-2022", "Janvember 9, 2019", "2019-03", "soon", "2017-09-14-14"])
def test_bad_dates(text):
    with pytest.raises(ValueError):
        recover.date_of(text)


def test_reasons(spark):
    two = GOOD.replace("20/5/2019", "soon").replace("1.2E5", "-4")
    open_quote = GOOD.replace("Mysuru", '"Mysuru')
    junk = GOOD.replace("Mysuru", '"Mysuru" (old)')
    fine = GOOD.replace("Mysuru", '"My ""s"" | uru\nx"').replace("Iyer", 'Iyer 4" pipe') + "\r"
    got = reasons(spark, GOOD, two, open_quote, junk, fine, "", None, "a|b", "x" * 100_000)
    assert got == [(1, "amount_spent"), (1, "date_approval"), (2, "quoting"), (3, "quoting"), (5, "column_count"), (6, "column_count"), (7, "column_count"), (8, "column_count")]


def test_repeated_rows_and_empty_table(spark):
    assert reasons(spark, "a", "a") == [(0, "column_count"), (1, "column_count")]
    assert reasons(spark) == []


def test_good_rows_are_typed(spark):
    df = spark.createDataFrame([(1, "|", GOOD, "clash")], "line_id long, sep string, raw string, work_id string")
    row = recover.good_rows(recover.read_lines(df)).collect()[0]
    assert (row.sanction_amount, row.amount_spent, row.date_approval) == (125000.5, 120000.0, dt.date(2019, 5, 20))


def test_resumes_at_a_validated_anchor():
    text = "\n".join([GOOD, GOOD.replace("Mysuru", '"Mysuru'), "RW-KA-000000009|too|short", GOOD])
    found = list(recover.parse_text(text, "|"))
    assert [len(r.fields) for r in found] == [12, 0, 12]
    assert found[1].errors[0][0] == "quoting" and text[found[2].start :] == GOOD
    behind = recover.parse_line(GOOD.replace("Mysuru", '"Mysuru') + "\n" + GOOD, "|")
    assert [bool(r.errors) for r in behind] == [True, False]


def test_whole_texts_resume_at_anchors(spark):
    broken = GOOD.replace("Mysuru", '"Mysuru')
    texts = [GOOD, broken, GOOD.replace("Iyer", '"Iyer\nand Sons"'), "", GOOD + "\r", broken, broken, GOOD]
    df = spark.createDataFrame([("b", i + 1, "|", x) for i, x in enumerate(texts)] + [("e", 1, "|", None)], "batch_id string, line_no int, sep string, raw string")
    assert recover.learn_anchor(df) == recover.learn_anchor(df.limit(1)) and "RW" not in recover.learn_anchor(df)
    got = recover.read_texts(df).filter("batch_id = 'b'").orderBy("line_no").select("line_no", "ok", "vendor_name").collect()
    # a broken quote ends where a record validly starts, behind the second of two broken lines
    assert [(r.line_no, r.ok) for r in got] == [(1, True), (2, False), (3, True), (4, False), (5, True), (6, False), (8, True)]
    assert got[2].vendor_name == "Iyer\nand Sons"
    assert recover.read_texts(df.limit(0)).count() == 0
