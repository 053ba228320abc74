"""Reading damaged delimited lines: typed records for the good rows, located errors for the others.

The grammar is a small recursive descent one::

    record := field (SEP field)*
    field  := quoted | plain
    quoted := '"' (any char but '"' | '""')* '"'      -- then SEP or the end must follow
    plain  := (any char but SEP)*                     -- a quote inside is plain text

On a broken quote the parser notes the error with its offset and looks for the next *validated record-start anchor*: a
line break behind the opening quote after which the anchor pattern matches and a whole record with the right number of fields can be parsed. From
there it goes on with a new record, so one lost quote costs one record and not the rest of the text.

Defined results: a null or blank text is a record of one empty field (``column_count``); one carriage return at the very
end belongs to the line ending; placeholders and blanks are valid in every checked field and give null; a line with a
quoting fault reports only that, one with a wrong number of fields only that; repeated rows are parsed each on its own.
Columns of the input that clash with result columns are kept out: only ``key`` columns are carried over.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.runtime import PLACEHOLDERS

FIELDS = (
    "work_id", "work_name", "district", "state", "sanction_amount", "amount_spent",
    "date_proposal", "date_approval", "date_completion", "implementing_agency", "vendor_name", "status",
)
AMOUNTS = ("sanction_amount", "amount_spent")
DATES = ("date_proposal", "date_approval", "date_completion")
CHECKED = ("date_approval", "sanction_amount", "amount_spent")
ANCHOR = r'"?[A-Za-z]{2}-[A-Za-z]{2}-[0-9]+'

_AMOUNT = re.compile(r"(?:(?:rs\.?|inr|₹)\s*)?([+-]?(?:[0-9]+(?:,[0-9]+)*(?:\.[0-9]*)?|\.[0-9]+)(?:e[+-]?[0-9]+)?)", re.I)
_YEAR_FIRST = re.compile(r"([0-9]{4})(?:-([0-9]{2})-([0-9]{2})|/([0-9]{1,2})/([0-9]{1,2})|([0-9]{2})([0-9]{2}))")
_YEAR_LAST = re.compile(r"([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4})")
_DAY_NAME = re.compile(r"([0-9]{1,2})\s+([a-z]+)\s+([0-9]{4})", re.I)
_NAME_DAY = re.compile(r"([a-z]+)\s+([0-9]{1,2}),\s+([0-9]{4})", re.I)
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = {name: i for i, m in enumerate(_MONTHS, 1) for name in (m, m[:3])}
_EMPTY = frozenset(PLACEHOLDERS)


@dataclass
class Parsed:
    """One record: its fields, and its errors as (reason, field number or -1, offset in the text)."""

    start: int
    fields: list[str] = field(default_factory=list)
    errors: list[tuple[str, int, int]] = field(default_factory=list)


class _Broken(Exception):
    """at: where it was noticed; opened: where the quoted field began."""

    def __init__(self, at: int, opened: int):
        self.at, self.opened = at, opened


def _quoted(text: str, at: int, sep: str, stop: str) -> tuple[str, int]:
    """The quoted field that begins at ``at`` and where it ends; stop: characters that may follow besides sep."""
    i = at + 1
    while True:
        j = text.find('"', i)
        if j < 0:
            raise _Broken(at, at)
        if text.startswith('""', j):
            i = j + 2
            continue
        if j + 1 < len(text) and text[j + 1] != sep and text[j + 1] not in stop:
            raise _Broken(j, at)
        return text[at + 1 : j].replace('""', '"'), j + 1


def _field(text: str, at: int, sep: str, stop: str) -> tuple[str, int]:
    if text.startswith('"', at):
        return _quoted(text, at, sep, stop)
    ends = [e for e in (text.find(c, at) for c in sep + stop) if e >= 0]
    end = min(ends, default=len(text))
    return text[at:end], end


def _record(text: str, at: int, sep: str, stop: str = "") -> tuple[list[str], int]:
    """Fields from ``at`` up to the end of the record, which is the end of the text or a character of stop."""
    fields = []
    while True:
        value, at = _field(text, at, sep, stop)
        fields.append(value)
        if at >= len(text) or text[at] in stop:
            return fields, at
        at += 1


def _anchor(text: str, at: int, sep: str, width: int, anchor: re.Pattern) -> int:
    """The next place after a line break where a record demonstrably starts, or -1."""
    while (at := text.find("\n", at)) >= 0:
        at += 1
        if anchor.match(text, at):
            try:
                if len(_record(text, at, sep, "\n")[0]) == width:
                    return at
            except _Broken:
                pass
    return -1


def parse_line(text: str | None, sep: str, width: int = len(FIELDS), anchor: re.Pattern | str = ANCHOR) -> list[Parsed]:
    """The records of one delivered line: one, and after a broken quote those behind validated anchors."""
    text = "" if text is None else text.removesuffix("\r")
    if '"' not in text:
        out = Parsed(0, text.split(sep))
        if len(out.fields) != width:
            out.errors.append(("column_count", -1, 0))
        return [out]
    anchor, found, at = re.compile(anchor), [], 0
    while True:
        got = Parsed(at)
        found.append(got)
        try:
            got.fields, end = _record(text, at, sep, "" if not found[1:] else "\n")
        except _Broken as broken:
            got.errors.append(("quoting", text.count(sep, at, broken.at), broken.at))
            if (at := _anchor(text, broken.opened, sep, width, anchor)) < 0:
                return found
            continue
        if len(got.fields) != width:
            got.errors.append(("column_count", -1, at))
        if end >= len(text) - 1:
            return found
        at = end + 1


def parse_text(text: str | None, sep: str, width: int = len(FIELDS), anchor: re.Pattern | str = ANCHOR) -> Iterator[Parsed]:
    """The records of a whole text of many lines, recovering at anchors; blank lines come out as column_count."""
    text = (text or "").replace("\r\n", "\n").removesuffix("\r")
    anchor, at = re.compile(anchor), 0
    while at < len(text) or at == 0:
        got = Parsed(at)
        try:
            got.fields, end = _record(text, at, sep, "\n")
            if len(got.fields) != width:
                got.errors.append(("column_count", -1, at))
        except _Broken as broken:
            got.errors.append(("quoting", text.count(sep, at, broken.at), broken.at))
            end = _anchor(text, broken.opened, sep, width, anchor) - 1
            end = len(text) if end < 0 else end
        yield got
        at = end + 1


@lru_cache(4096)
def amount_of(text: str) -> float | None:
    """One finite number >= 0, with or without a currency mark; None for placeholders. Raises ValueError."""
    text = text.strip()
    if text.lower() in _EMPTY:
        return None
    m = _AMOUNT.fullmatch(text)
    value = float(m[1].replace(",", "")) if m else math.nan
    if not 0 <= value < math.inf:
        raise ValueError(text)
    return value + 0.0


@lru_cache(4096)
def date_of(text: str) -> dt.date | None:
    """A day that exists, in ISO form or one of the nine register formats, day before month. Raises ValueError."""
    text = text.strip()
    if text.lower() in _EMPTY:
        return None
    if m := _YEAR_FIRST.fullmatch(text):
        y, mo, d = (int(x) for x in m.groups() if x)
    elif m := _YEAR_LAST.fullmatch(text):
        d, mo, y = int(m[1]), int(m[3]), int(m[4])
    elif m := _DAY_NAME.fullmatch(text):
        d, mo, y = int(m[1]), _MONTH.get(m[2].lower(), 0), int(m[3])
    elif m := _NAME_DAY.fullmatch(text):
        d, mo, y = int(m[2]), _MONTH.get(m[1].lower(), 0), int(m[3])
    else:
        raise ValueError(text)
    return dt.date(y, mo, d)


def _typed(parsed: Parsed) -> list:
    """The values of a record of the right width; faults of values are added to its errors."""
    values = []
    for i, (name, text) in enumerate(zip(FIELDS, parsed.fields)):
        try:
            value = amount_of(text) if name in AMOUNTS else date_of(text) if name in DATES else None if text.strip().lower() in _EMPTY else text
        except ValueError:
            value = None
            if name in CHECKED:
                parsed.errors.append((name, i, -1))
        values.append(value)
    return values


RESULT = ", ".join(
    ["segment int", "ok boolean"] + [f"{f} {'double' if f in AMOUNTS else 'date' if f in DATES else 'string'}" for f in FIELDS] + ["errors array<struct<reason:string,field:int,position:int>>"]
)


def read_lines(lines: DataFrame, raw: str = "raw", sep: str = "sep", key: str = "line_id") -> DataFrame:
    """One row per record found in ``lines``: ``key``, ``segment`` (0, or more behind an anchor), ``ok``, the twelve typed
    fields and ``errors``. Works line by line without a shuffle."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "segment", "ok", *FIELDS, "errors"]
        for batch in batches:
            rows = []
            for k, text, s in zip(batch["key"].tolist(), batch["raw"].tolist(), batch["sep"].tolist()):
                for n, parsed in enumerate(parse_line(text if isinstance(text, str) else None, s or ",")):
                    values = [None] * len(FIELDS) if parsed.errors else _typed(parsed)
                    rows.append((k, n, not parsed.errors, *values, [{"reason": r, "field": f, "position": p} for r, f, p in parsed.errors]))
            out = pd.DataFrame(rows, columns=names)
            for name in AMOUNTS:
                out[name] = out[name].astype("Float64")
            yield out

    source = lines.select(F.col(key).alias("key"), F.col(raw).alias("raw"), F.col(sep).alias("sep"))
    return source.mapInPandas(parse, f"key {source.schema['key'].dataType.simpleString()}, {RESULT}").withColumnRenamed("key", key)


def learn_anchor(lines: DataFrame, raw: str = "raw", sep: str = "sep", width: int = len(FIELDS)) -> str:
    """How records start, as a pattern: the commonest shape of the first field of lines without quotes that have the right
    width. Shapes keep punctuation and the kind of each run of letters or digits; one row of counts per shape is looked at."""
    fields = F.split(F.col(raw), F.concat(F.lit("["), F.col(sep), F.lit("]")))
    plain = lines.filter(F.col(raw).isNotNull() & ~F.contains(F.col(raw), F.lit('"')) & (F.length(sep) == 1) & ~F.col(sep).isin("\\", "^", "]") & (F.size(fields) == width))
    shape = F.regexp_replace(F.regexp_replace(F.trim(fields[0]), "[A-Za-z]+", "A"), "[0-9]+", "9")
    top = plain.select(shape.alias("s")).filter("length(s) BETWEEN 1 AND 60").groupBy("s").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s").first()
    if top is None:
        return ANCHOR
    return '"?' + re.escape(top["s"]).replace("A", "[A-Za-z]+").replace("9", "[0-9]+")


#: Lines of one batch that a task puts together to a text.
LINES = 50_000


def read_texts(lines: DataFrame, batch: str = "batch_id", number: str = "line_no", raw: str = "raw", sep: str = "sep", anchor: str | None = None) -> DataFrame:
    """The records of whole texts: each batch's lines in order, in stretches of ``LINES`` lines, with one (batch, number,
    segment, ok, fields, errors) per record. A broken quote swallows what follows up to the next validated anchor."""
    anchor = anchor or learn_anchor(lines, raw, sep)
    source = lines.select(F.col(batch).alias("batch"), F.col(number).alias("number"), F.coalesce(raw, F.lit("")).alias("raw"), F.coalesce(sep, F.lit(",")).alias("sep"), F.floor(F.col(number) / LINES).alias("part"))

    def parse(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("number", kind="stable")
        texts = [t.removesuffix("\r") for t in pdf["raw"].tolist()]
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        rows = []
        for n, parsed in enumerate(parse_text("\n".join(texts), pdf["sep"].iat[0], anchor=anchor)):
            values = [None] * len(FIELDS) if parsed.errors else _typed(parsed)
            at = int(np.searchsorted(starts, parsed.start, "right")) - 1
            rows.append((pdf["batch"].iat[0], pdf["number"].iat[at], n, not parsed.errors, *values, [{"reason": r, "field": f, "position": p} for r, f, p in parsed.errors]))
        out = pd.DataFrame(rows, columns=["batch", "number", "segment", "ok", *FIELDS, "errors"])
        for name in AMOUNTS:
            out[name] = out[name].astype("Float64")
        return out

    kinds = f"batch {source.schema['batch'].dataType.simpleString()}, number {source.schema['number'].dataType.simpleString()}"
    return source.groupBy("batch", "sep", "part").applyInPandas(parse, f"{kinds}, {RESULT}").withColumnsRenamed({"batch": batch, "number": number})


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter("ok").drop("ok", "errors")


def rejected(parsed: DataFrame, key: str = "line_id") -> DataFrame:
    """Each reason of each rejected line; errors of the line itself, not of records recovered behind it."""
    return parsed.filter("NOT ok AND segment = 0").select(key, F.explode("errors").alias("e")).select(key, F.col("e.reason").alias("reason"))
