"""Finding and mending text decoded with the wrong character encoding.

A garbled text keeps the ASCII characters of the original. So garbled records are joined with clean near-twins on what is
left when non-ASCII characters are stripped: whole records with the same rest, and the surroundings of each run of such
characters (its ASCII neighbours, digits made equal). Under one key the most frequent run stands for the clean side; each
other run is aligned with it, character by character. Each aligned pair speaks for a mapping of one character to what became of
it (``characters``); mappings that no known encoding explains are kept too if they have enough support and form a code: sequences
that begin alike and stand for several characters. A pair of runs that some *transformation* explains (bytes of one encoding read
as another) speaks for it as well, which extends the mapping to characters that no twin showed. Both are applied to all records,
also to those without a twin.

Multi-byte transformations (UTF-8 read as a single-byte encoding) are recognised by the structure of the sequences, decoded
as often as they were applied. For one single-byte encoding read as another, the characters before and after decide, by
counts over the whole corpus: undoing must turn a stretch of unheard-of neighbours into usual ones. Control characters of the
range U+0080-U+009F, U+FFFD, and the same sequences written as HTML references are signs too; what U+FFFD stands for is lost.

Defined results: null, empty and ASCII texts are no case; legitimate rare characters are no case; repeated rows count each.
"""

from __future__ import annotations

import copy
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.runtime import materialize, small_side, spread

#: Encodings that text was in, and those it may have been read as.
SINGLE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp866", "koi8-r", "iso8859-2", "iso8859-15")
RIGHT = ("utf-8", "cp1252", "mac_roman", "cp437", "cp850")
#: Contexts that must support a transformation: multi-byte ones hardly fit by chance; others need more, and several pairs.
SUPPORT_MULTI, SUPPORT_SINGLE, PAIRS_SINGLE = 1, 3, 2
SIDE = 12
#: Contexts for a learned sequence, its share among all readings of it, and characters that one first character must lead to.
SUPPORT_LEARNED, SHARE_LEARNED, CODE = 3, 0.9, 3
#: What mended text may hold besides ASCII: Latin, Greek, Indic scripts, punctuation, currency, symbols, boxes, pictures.
_BLOCKS = ((0xA0, 0x17F), (0x218, 0x21B), (0x370, 0x3FF), (0x900, 0xDFF), (0x2000, 0x206F), (0x2070, 0x209F), (0x20A0, 0x20CF), (0x2100, 0x22FF), (0x2500, 0x27BF), (0xFB00, 0xFB06), (0x1F300, 0x1FAFF))
_RUN = re.compile(r"[^\x00-\x7f]+")
_REFERENCE = re.compile(r"&(?:#[0-9]{2,6}|#[xX][0-9a-fA-F]{2,5}|[A-Za-z]{2,8}[0-9]{0,2});")
_INDIC = re.compile("[\u0900-\u0dff\u200c\u200d]+").fullmatch
_ALPHA, _DIGITS = re.compile("[A-Za-z]").findall, re.compile("[0-9]+").sub
_CONTROL = re.compile("[\x80-\x84\x86-\x9f]")
_SENTENCE = re.compile(r"[^.!?\n।]+")


def _plausible(text: str) -> bool:
    return all(ord(c) < 0x80 or any(a <= ord(c) <= b for a, b in _BLOCKS) for c in text)


@lru_cache(None)
def _chars(codec: str) -> str:
    """The character of each byte; bytes the encoding leaves out stand for themselves."""
    return "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256))


@lru_cache(None)
def _bytes(codec: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(_chars(codec))))}


def _encode(text: str, codec: str) -> bytes | None:
    if codec == "utf-8":
        return text.encode("utf-8", "surrogatepass")
    of = _bytes(codec)
    try:
        return bytes(of[c] if ord(c) > 127 else ord(c) for c in text)
    except KeyError:
        return None


def garble(text: str, right: str, wrong: str) -> str | None:
    data = _encode(text, right)
    return None if data is None else "".join(_chars(wrong)[b] for b in data)


def explain(bad: str, good: str) -> list[tuple[str, str]]:
    """The transformations that turn good into bad, applied once or twice to the characters that differ."""
    n = min(len(bad), len(good))
    head = next((i for i in range(n) if bad[i] != good[i]), n)
    tail = next((i for i in range(n - head) if bad[-1 - i] != good[-1 - i]), n - head)
    bad, good = bad[head : len(bad) - tail], good[head : len(good) - tail]
    if not bad or not good:
        return []
    found = []
    for right in RIGHT:
        for wrong in SINGLE:
            if right == wrong:
                continue
            once = garble(good, right, wrong)
            if once == bad or (right == "utf-8" and once is not None and garble(once, right, wrong) == bad):
                found.append((right, wrong))
    return found


def characters(bad: str, good: str) -> list[tuple[str, str]]:
    """(what became of it, character) where one character of good stands against a sequence of bad."""
    n = min(len(bad), len(good))
    head = next((i for i in range(n) if bad[i] != good[i]), n)
    tail = next((i for i in range(n - head) if bad[-1 - i] != good[-1 - i]), n - head)
    bad, good = bad[head : len(bad) - tail], good[head : len(good) - tail]
    if len(good) > 1 and len(bad) % len(good) == 0:  # as many characters for each
        k = len(bad) // len(good)
        return [(bad[i * k : i * k + k], c) for i, c in enumerate(good)]
    return [(bad, good)] if len(good) == 1 and bad else []


def code_of(rows: list[tuple[str, str, int]]) -> dict[str, str]:
    """Of (sequence, character, contexts) the sequences of two to four characters that form a code."""
    total: Counter = Counter()
    for seq, _, n in rows:
        total[seq] += n
    sure = {seq: c for seq, c, n in rows if 2 <= len(seq) <= 4 and n >= SUPPORT_LEARNED and n >= SHARE_LEARNED * total[seq] and _plausible(c) and c not in seq}
    leads: dict[str, set] = {}
    for seq, c in sure.items():
        leads.setdefault(seq[0], set()).add(c)
    return {seq: c for seq, c in sure.items() if len(leads[seq[0]]) >= CODE and seq[0] not in sure.values()}


@lru_cache(None)
def _sequence(wrong: str) -> re.Pattern:
    """UTF-8 sequences of two to four bytes as they look in another encoding."""
    span = lambda a, b: "[" + "".join(re.escape(_chars(wrong)[x]) for x in range(a, b + 1)) + "]"
    more = span(0x80, 0xBF)
    return re.compile(f"{span(0xC2, 0xDF)}{more}|{span(0xE0, 0xEF)}{more}{{2}}|{span(0xF0, 0xF4)}{more}{{3}}")


def _undo(match: re.Match, wrong: str) -> str:
    of = _bytes(wrong)
    try:
        text = bytes(of[c] for c in match[0]).decode("utf-8")
    except (UnicodeDecodeError, KeyError):
        return match[0]
    # what is not plausible may still be one character of a sequence that was garbled twice
    return text if _plausible(text) or all(c in of for c in text) else match[0]


def unescape(text: str) -> str:
    """HTML references to characters beyond ASCII, read."""
    if "&" not in text:
        return text
    return _REFERENCE.sub(lambda m: c if (c := html.unescape(m[0])) and not c.isascii() else m[0], text)


class Mender:
    """Learned transformations, and neighbour counts for the single-byte ones."""

    def __init__(self, transformations: list[tuple[str, str]], neighbours: dict[str, int], learned: dict[str, str] | None = None, by_source: dict[str | None, dict[str, int]] | None = None):
        self.multi = [w for r, w in transformations if r == "utf-8"]
        self.single = [(r, w) for r, w in transformations if r != "utf-8"]
        self.neighbours, self.by_source = neighbours, by_source or {}
        # sequences that a known transformation explains are left to it
        self.learned = {q: c for q, c in (learned or {}).items() if not any(_undo(m, w) != m[0] for w in self.multi for m in _sequence(w).finditer(q))}
        self._learned = re.compile("|".join(map(re.escape, sorted(self.learned, key=len, reverse=True)))) if self.learned else None
        self._pairs: dict[tuple, bool] = {}
        self._runs: dict[str, bool] = {}
        # characters that stand for the first byte of a sequence, and those that a single-byte transformation makes
        self._leads = frozenset(c for w in self.multi for c in _chars(w)[0xC2:0xF5])
        self._made = frozenset(c for _, w in self.single for c in _chars(w)[0x80:])

    def knowing(self, source: str | None, own: dict[str, int]) -> Mender:
        """This mender with the neighbour counts of one more source."""
        other = copy.copy(self)
        other.by_source = {source: own}
        return other

    def _count(self, pair: str, but: dict[str, int]) -> int:
        return self.neighbours.get(pair, 0) - but.get(pair, 0)

    def _usual(self, before: str, char: str, after: str, but: dict[str, int]) -> float:
        return float(np.log(self._count(before + char, but) + 0.5) + np.log(self._count(char + after, but) + 0.5))

    def _swap(self, sentence: str, right: str, wrong: str, own: dict[str, int]) -> str | None:
        return self._swapped(sentence, right, wrong, {}) or (self._swapped(sentence, right, wrong, own) if own else None)

    def _swapped(self, sentence: str, right: str, wrong: str, but: dict[str, int]) -> str | None:
        """The sentence with one single-byte transformation undone, if that makes it usual. but: counts to leave out."""
        of, to = _bytes(wrong), _chars(right)
        gain = n = 0
        fixed = list(sentence)
        for i, c in enumerate(sentence):
            if c < "\x80":
                continue
            if c not in of or not _plausible(to[of[c]]):
                return None
            fixed[i] = to[of[c]]
        for i, c in enumerate(sentence):
            if c >= "\x80":
                b, a = _side(sentence, i - 1), _side(sentence, i + 1)
                fb, fa = _side(fixed, i - 1), _side(fixed, i + 1)
                gain += self._usual(fb, fixed[i], fa, but) - self._usual(b, c, a, but)
                n += 1
        return "".join(fixed) if n and gain >= 8 and gain >= 4 * n else None

    def _suspicious(self, before: str, char: str, source: str | None) -> bool:
        """Whether undoing a single-byte transformation makes a much more usual pair of this one."""
        key = before, char, source
        if (known := self._pairs.get(key)) is None:
            back = [before + _chars(r)[_bytes(w)[char]] for r, w in self.single if char in _bytes(w)]
            known = any(self._count(x, but) >= 20 * (self._count(before + char, but) + 1) for but in ({}, self.by_source.get(source, {})) for x in back)
            if len(self._pairs) < 200_000:
                self._pairs[key] = known
        return known

    def _holds(self, run: str) -> bool:
        """Whether a run of characters beyond ASCII has a sequence that some multi-byte transformation left."""
        if (known := self._runs.get(run)) is None:
            known = not self._leads.isdisjoint(run) and any(_undo(m, w) != m[0] for w in self.multi for m in _sequence(w).finditer(run))
            if len(self._runs) < 100_000:
                self._runs[run] = known
        return known

    def _decode(self, text: str) -> str:
        """Multi-byte transformations undone, the one that explains most characters first, as often as any applies."""
        for _ in range(8):
            reach = {w: sum(len(m[0]) for m in _sequence(w).finditer(text) if _undo(m, w) != m[0]) for w in self.multi}
            wrong = max(self.multi, key=lambda w: reach[w], default=None)
            if wrong is None or not reach[wrong]:
                break
            text = _sequence(wrong).sub(lambda m, w=wrong: _undo(m, w), text)
        return text

    def mend(self, text: str | None, source: str | None = None) -> tuple[bool, str | None]:
        """Whether the text was garbled, and the text as far as it can be had."""
        if not text or (text.isascii() and "&" not in text):
            return False, text
        plain = unescape(text)
        if plain.isascii():
            return False, text
        high = set(plain)
        bad = not self._leads.isdisjoint(high) and any(map(self._holds, set(_RUN.findall(plain))))
        fixed = self._decode(plain) if bad else plain
        if self._learned is not None and (after := self._learned.sub(lambda m: self.learned[m[0]], fixed)) != fixed:
            bad, fixed = True, after
        high = set(fixed) if bad else high
        if not self._made.isdisjoint(high) and any(self._suspicious(_side(fixed, m.start() - 1), m[0][0], source) for m in _RUN.finditer(fixed)):
            own = self.by_source.get(source, {})
            for right, wrong in self.single:
                swap = lambda m, r=right, w=wrong: m[0] if m[0].isascii() else self._swap(m[0], r, w, own) or m[0]
                after = _SENTENCE.sub(swap, fixed)
                bad, fixed = bad or after != fixed, after
        if bad or "\ufffd" in plain or _CONTROL.search(plain):
            return True, fixed
        return False, text


def _side(text, i: int) -> str:
    c = text[i] if 0 <= i < len(text) else " "
    return "0" if "0" <= c <= "9" else c


def _survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per partition, what the texts hold: runs under the key of their surroundings, and neighbours of characters."""
    runs: Counter = Counter()
    near: Counter = Counter()

    def out(kind: int, counted: Counter) -> pd.DataFrame:
        key, run = zip(*counted)
        return pd.DataFrame({"kind": kind, "key": list(key), "run": list(run), "n": list(counted.values())})

    for b in batches:
        for text, source in zip(b["text"].tolist(), b["source"].tolist()):
            text = unescape(text)
            if text.isascii():
                continue
            for m in _RUN.finditer(text):
                run, (i, j) = m[0], m.span()
                if _INDIC(run):  # written in a script that no single-byte encoding holds: not a garbled run
                    continue
                # the ASCII neighbours, up to the next run; digits made equal
                left, right = text[max(0, i - SIDE) : i], text[j : j + SIDE]
                if right.isascii():
                    key = text[i - 1 : i] + "\1" + right
                    if len(_ALPHA(key)) >= 6:
                        runs[_DIGITS("0", key), run] += 1
                if left.isascii():
                    key = left + "\2" + text[j : j + 1]
                    if len(_ALPHA(key)) >= 6:
                        runs[_DIGITS("0", key), run] += 1
                for k in (i, j - 1):
                    near[source, _side(text, k - 1) + text[k]] += 1
                    near[source, text[k] + _side(text, k + 1)] += 1
        if len(runs) > 200_000:
            yield out(0, runs)
            runs.clear()
    if runs:
        yield out(0, runs)
    if near:
        yield out(1, near)


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The runs of records that have a twin, under the record's rest and their place in it."""
    for b in batches:
        rows = [(f"{rest}:{k}", run) for rest, text in zip(b["rest"].tolist(), b["text"].tolist()) for k, run in enumerate(_RUN.findall(unescape(text)))]
        yield pd.DataFrame(rows, columns=["key", "run"]).assign(n=1)


#: Texts that may hold garbled sequences; the others never leave the JVM.
BEYOND = r"[^\x00-\x7f]|&(?:#|[A-Za-z])"
#: Sources whose neighbour counts are sent to all workers: the most frequent ones. The texts of all others meet their source's
#: counts by a shuffle, ``TOGETHER`` texts at a time at most.
SOURCES, TOGETHER = 200, 5_000


def codes(mapped: DataFrame) -> dict[str, str]:
    """The learned sequences of all (seq, char, n, fit). Only those that form a code reach the driver, whatever their number."""
    enough = mapped.filter(F.col("n") >= SUPPORT_LEARNED)
    best = enough.groupBy("seq").agg(F.sum("n").alias("total"), F.max_by(F.struct("char", "n", "fit"), "n").alias("b")).select("seq", "b.char", "b.n", "b.fit", "total")
    sure = materialize(best.filter(F.col("fit") & (F.col("n") >= SHARE_LEARNED * F.col("total"))).withColumn("lead", F.substring("seq", 1, 1)), "sure")
    leads = sure.groupBy("lead").agg(F.countDistinct("char").alias("chars")).filter(F.col("chars") >= CODE).select("lead")
    leads = leads.join(sure.select(F.col("char").alias("lead")), "lead", "left_anti")
    return {r["seq"]: r["char"] for r in sure.join(leads, "lead").select("seq", "char").collect()}


def _among(column: Column, values: list[str | None]) -> Column:
    """Whether a string is among the values, null being one as well."""
    named = F.coalesce(column.isin([x for x in values if x is not None]), F.lit(False))
    return named | column.isNull() if None in values else named


def _learn(documents: DataFrame, text: str, source: str | None) -> tuple[Mender, DataFrame | None]:
    """The mender, and of the sources that it does not know apart the neighbour counts as (source, run, n), if there are any."""
    named = F.col(source).cast("string") if source else F.lit(None).cast("string")
    texts = spread(documents.filter(F.col(text).rlike(BEYOND)).select(F.col(text).alias("text"), named.alias("source")))
    survey = materialize(texts.mapInPandas(_survey, "kind int, key string, run string, n long"), "survey")
    rests = texts.select(F.xxhash64(F.regexp_replace("text", r"[^\x21-\x7e]+", "")).alias("rest"), F.xxhash64("text").alias("whole"), "text")
    twins = small_side(materialize(rests.groupBy("rest").agg((F.min("whole") != F.max("whole")).alias("differ")).filter("differ").select("rest"), "twins"))
    # records of one rest and one wording are alike: one of them speaks
    records = rests.join(twins, "rest", "left_semi").groupBy("rest", "whole").agg(F.first("text").alias("text"))
    evidence = survey.filter("kind = 0").select("key", "run", "n").unionByName(records.select("rest", "text").mapInPandas(_aligned, "key string, run string, n long"))
    evidence = materialize(evidence.groupBy(F.xxhash64("key").alias("key"), "run").agg(F.sum("n").alias("n")), "evidence")
    clean = evidence.groupBy("key").agg(F.max_by("run", F.struct(F.col("n"), -F.length("run"), F.col("run"))).alias("clean"), F.count("*").alias("runs")).filter("runs > 1")
    pairs = evidence.join(clean, "key").filter("run != clean").groupBy("run", "clean").agg(F.count("*").alias("contexts"))

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*t, c) for bad, good, c in zip(b["run"].tolist(), b["clean"].tolist(), b["contexts"].tolist()) for t in explain(bad, good)]
            yield pd.DataFrame(rows, columns=["right", "wrong", "contexts"])

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(seq, char, _plausible(char) and char not in seq, c) for bad, good, c in zip(b["run"].tolist(), b["clean"].tolist(), b["contexts"].tolist()) for seq, char in characters(bad, good) if 1 < len(seq) < 5]
            yield pd.DataFrame(rows, columns=["seq", "char", "fit", "contexts"])

    pairs = materialize(pairs, "pairs")
    learned = codes(pairs.mapInPandas(align, "seq string, char string, fit boolean, contexts long").groupBy("seq", "char", "fit").agg(F.sum("contexts").alias("n")))
    support = pairs.mapInPandas(infer, "right string, wrong string, contexts long").groupBy("right", "wrong").agg(F.sum("contexts").alias("contexts"), F.count("*").alias("pairs")).collect()
    keep = [r for r in support if r["contexts"] >= (SUPPORT_MULTI if r["right"] == "utf-8" else SUPPORT_SINGLE) and (r["right"] == "utf-8" or r["pairs"] >= PAIRS_SINGLE)]
    keep.sort(key=lambda r: (-r["contexts"], r["right"], r["wrong"]))
    counts = survey.filter("kind = 1").groupBy("key", "run").agg(F.sum("n").alias("n"))
    near = {r["run"]: r["n"] for r in counts.groupBy("run").agg(F.sum("n").alias("n")).collect()}
    by_source: dict[str | None, dict[str, int]] = {}
    rest = None
    if source:
        sizes = counts.groupBy(F.col("key").alias("of")).agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "of").limit(SOURCES + 1).collect()
        kept = _among(F.col("key"), [r["of"] for r in sizes[:SOURCES]])
        for r in counts.filter(kept).select("key", "run", "n").collect():
            by_source.setdefault(r["key"], {})[r["run"]] = r["n"]
        if len(sizes) > SOURCES:
            rest = counts.filter(~kept).select(F.col("key").alias("source"), "run", "n")
    return Mender([(r["right"], r["wrong"]) for r in keep], near, learned, by_source), rest


def learn(documents: DataFrame, text: str = "text", source: str | None = None) -> Mender:
    """Transformations, learned sequences and neighbour counts from all documents. What reaches the driver is bounded by the
    number of encodings, by the pairs of characters in use, and by those of the ``SOURCES`` sources kept apart; ``mended``
    gives the other sources' texts their counts where they are."""
    return _learn(documents, text, source)[0]


def mended(documents: DataFrame, doc: str = "doc_id", text: str = "text", source: str | None = None) -> DataFrame:
    """(doc, mended text) of the garbled documents."""
    known, rest = _learn(documents, text, source)
    mender = documents.sparkSession.sparkContext.broadcast(known)

    def rows(mender: Mender, b: pd.DataFrame) -> pd.DataFrame:
        fixed = [(d, fixed) for d, t, s in zip(b["d"].tolist(), b["t"].tolist(), b["s"].tolist()) for bad, fixed in [mender.mend(t, s)] if bad]
        return pd.DataFrame(fixed, columns=["d", "t"])

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield rows(mender.value, b)

    def apply_apart(b: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        return rows(mender.value.knowing(b["s"].iat[0], dict(zip(own["run"].tolist(), own["n"].tolist()))), b) if len(b) else pd.DataFrame({"d": [], "t": []})

    named = F.col(source).cast("string") if source else F.lit(None).cast("string")
    texts = spread(documents.filter(F.col(text).rlike(BEYOND)).select(F.col(doc).alias("d"), F.col(text).alias("t"), named.alias("s")))
    schema = f"d {texts.schema['d'].dataType.simpleString()}, t string"
    if rest is None:
        found = texts.mapInPandas(apply, schema)
    else:
        kept = _among(F.col("s"), list(known.by_source))
        apart = texts.filter(~kept)
        parts = apart.groupBy(F.col("s").alias("source")).agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("d", "t"), F.col("parts")).cast("int").alias("part")
        here = apart.join(parts, F.col("s").eqNullSafe(F.col("source"))).select("d", "t", "s", F.coalesce(F.concat(F.lit("s"), "s"), F.lit("")).alias("of"), part)
        there = rest.alias("r").join(parts.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select("run", "n", F.coalesce(F.concat(F.lit("s"), "r.source"), F.lit("")).alias("of"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        found = texts.filter(kept).mapInPandas(apply, schema).unionByName(here.groupBy("of", "part").cogroup(there.groupBy("of", "part")).applyInPandas(apply_apart, schema))
    return found.select(F.col("d").alias(doc), F.col("t").alias("text"))
