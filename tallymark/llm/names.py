"""Linking names as people typed them to a register of organisations.

A name is cut into tokens; sounds that typists confuse (long and short vowels, v and w, c and k, aspirated and plain
consonants) are folded. Tokens of the register stand in a symmetric-delete index: every form with up to two letters left
out points to its token, so a typed token and a register token within two edits meet in one of their shortened forms. A
second index holds the beginnings of tokens for abbreviations. The organisations that share a token this way are compared
whole: the tokens are aligned by optimal assignment, where a token may stand for itself with few edits, for an abbreviation
(a beginning, or some of its letters in order) or for an initial, and of three or more own tokens of
an organisation one in three may be left out at a cost.

Words that one name in ``COMMON`` or more holds (trades, legal forms, kinds of office) are learned from the register itself, for
vendors and agencies alike, and so are the ways to write them: typing errors by the delete index, abbreviations, words glued or
parted, and the initials of words that stand side by side in the register (``R&B``, ``ZP``, ``M.I. S/D``). An abbreviation that
could be one of these words is taken for a part of the organisation's own name where the first reading leads nowhere.

A name is linked if every token of its own finds its place, none of the organisation's is left over (but for the one in three),
at least one is matched in full, the common words do not contradict, and no other organisation fits as well.

The register travels to the data after its size was checked; beyond ``REGISTER_ROWS`` it is refused, as its token index has
to fit a worker. Its index is built once a worker. Each distinct spelling is resolved once, however many rows hold it.

Defined results: null, blank and placeholder cells give no row; a cell equal byte for byte to the register's name gives no
row; ties between organisations give no row; repeated rows each give theirs.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.runtime import PLACEHOLDERS, materialize, small_side

REGISTER_ROWS = 200_000

#: A word is common if one name in so many holds it, and at least five do.
COMMON, LEAST = 30, 5
#: What a token left out counts for, and how far common words must agree.
LEFT_OUT, AGREE = 0.3, 0.3
#: A text of more words is no name.
MOST_TOKENS = 60
# Forms of address and words without weight, legal forms, and common words in another language.
_TITLES = frozenset("ms messrs shri sri smt mr mrs regd the and of at ee".split())
_LEGAL = frozenset(("private", "limited", "llp"))
_ALSO = {"distt": "zila", "district": "zila", "parishad": "panchayat", "gramin": "rural"}
_LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(200_000)
def fold(token: str) -> str:
    """A token with confusable sounds made equal."""
    t = token.replace("ee", "i").replace("oo", "u").replace("aa", "a").replace("w", "v").replace("c", "k")
    t = t[:1] + t[1:].replace("h", "")
    return re.sub(r"(.)\1+", r"\1", t)


def deletes(token: str, most: int) -> set[str]:
    """The token and its forms with up to ``most`` letters left out."""
    n, out = len(token), {token}
    if most:
        ones = [token[:i] + token[i + 1 :] for i in range(n)]
        out.update(ones)
        if most > 1:
            out.update(t[:j] + t[j + 1 :] for i, t in enumerate(ones) for j in range(i, n - 1))
    return out


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours; most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, older = row, [i], before
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if older is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before = last
    return row[-1]


def reach(token: str) -> int:
    """Edits allowed in a token of this length."""
    return 0 if len(token) < 3 else 1 if len(token) < 5 else 2


class TokenIndex:
    """Symmetric-delete and beginnings index over folded tokens; values are whatever was put under a token."""

    def __init__(self, tokens: dict):
        self.values = tokens
        self.longest = max(map(len, tokens), default=0)
        self._near: dict[str, dict[str, int]] = {}
        self.short: dict[str, set] = defaultdict(set)
        self.begin: dict[str, set] = defaultdict(set)
        for t in tokens:
            for d in deletes(t, reach(t)):
                self.short[d].add(t)
            for n in range(2, len(t)):
                self.begin[t[:n]].add(t)

    def near(self, token: str) -> dict[str, int]:
        """Tokens within the edits that the longer of two tokens allows."""
        if len(token) > self.longest + 2:  # no token of the index is within two edits
            return {}
        if (known := self._near.get(token)) is not None:
            return known
        most = max(reach(token), 1)
        seen = {t for d in deletes(token, most) for t in self.short.get(d, ())}
        known = {t: d for t in seen if (d := edits(token, t, 2)) <= max(reach(token), reach(t))}
        if len(self._near) < 200_000:
            self._near[token] = known
        return known

    def starting(self, token: str) -> set[str]:
        return self.begin.get(token, set())


def abbreviates(short: str, word: str) -> bool:
    """Whether short holds some of the word's letters in order, the first among them."""
    if len(short) >= len(word) or short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


def _common_start(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@lru_cache(500_000)
def _place(typed: str, own: str) -> float:
    """How well a typed token stands for one of the organisation's, from 0 (not at all) to 1."""
    if typed == own:
        return 1.0
    if len(typed) == 1:
        return 0.45 if own[0] == typed else 0.4 if fold(own)[:1] == fold(typed) else 0.0
    f, g = fold(typed), fold(own)
    if f == g:
        return 0.97
    d = min(edits(f, g, 2), edits(typed, own, 2))
    if d <= max(reach(f), reach(g)) and d < len(g) / 2:
        return 0.95 - 0.12 * d
    if len(typed) >= 3 and len(f) < len(g) and (g.startswith(f) or own.startswith(typed)):
        return 0.6
    if len(f) >= 4 and len(f) < len(g) - 1 and edits(f, g[: len(f)], 1) <= 1:
        return 0.5
    if 3 <= len(typed) <= 5 and len(own) > 2 * len(typed) and abbreviates(typed, own):
        return 0.5
    return 0.0


def assign(gain: list[list[float]]) -> list[int]:
    """The column of each row that makes the sum greatest; a square matrix. Shortest augmenting paths with potentials."""
    n = len(gain)
    up, down, held = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for row in range(1, n + 1):
        held[0], at = row, 0
        least, came, done = [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while held[at]:
            done[at] = True
            r, step, following = held[at], float("inf"), 0
            for c in range(1, n + 1):
                if not done[c]:
                    reduced = -gain[r - 1][c - 1] - up[r] - down[c]
                    if reduced < least[c]:
                        least[c], came[c] = reduced, at
                    if least[c] < step:
                        step, following = least[c], c
            for c in range(n + 1):
                if done[c]:
                    up[held[c]] += step
                    down[c] -= step
                else:
                    least[c] -= step
            at = following
        while at:
            held[at] = held[came[at]]
            at = came[at]
    out = [0] * n
    for c in range(1, n + 1):
        out[held[c] - 1] = c - 1
    return out


def align(typed: Sequence[str], own: Sequence[str]) -> tuple[float, float]:
    """Optimal assignment of the typed tokens to the organisation's: mean and best place; 0 if a typed token finds no place or
    too many of the organisation's are left out."""
    n, m = len(typed), len(own)
    size = max(n, m)
    if not n or not m or n > m or m - n > m // 3:
        return 0.0, 0.0
    places = [[_place(t, o) for o in own] for t in typed]
    if n == m == 1:
        found = [places[0][0]]
    elif n == m == 2:
        straight, crossed = (places[0][0], places[1][1]), (places[0][1], places[1][0])
        fine = [x for x in (straight, crossed) if min(x) > 0]
        found = list(max(fine, key=sum)) if fine else [0.0]
    else:  # nothing in a place counts as left out
        square = [[places[i][j] or LEFT_OUT if i < n and j < m else LEFT_OUT for j in range(size)] for i in range(size)]
        found = [places[i][j] if i < n and j < m else 0.0 for i, j in enumerate(assign(square))]
    missing = sum(p == 0 for p in found)
    if missing > m - n:
        return 0.0, 0.0
    return (sum(found) + LEFT_OUT * missing) / size, max(found)


def tokens_of(text: str) -> list[str]:
    """Words in lower case, without titles, with what is glued by capitals parted."""
    text = re.sub(r"(?<=[a-z])(?=[A-Z][A-Za-z])", " ", text).lower().replace("'s", "s")
    text = re.sub(r"^\s*m\s*/?\s*s\b\.?|\bo\s*/\s*o\b", " ", text).replace("(p)", " private ").replace("&", " and ")
    return _LETTERS.findall(re.sub(r"\bp\b\.?\s*(?=ltd|limited)", " private ", text))


class Register:
    """The organisations of one kind by their tokens, and by the other names they trade under."""

    def __init__(self, rows: list[tuple[int, str, str | None]]):
        names = {i: [t for t in tokens_of(name) if t not in _TITLES] for i, name, _ in rows}
        held = Counter(t for tokens in names.values() for t in set(tokens))
        self.common = {t: k for t, k in held.items() if t in _LEGAL or k >= max(LEAST, len(names) / COMMON)}
        self.rarity = {t: math.log(1 + len(names) / k) for t, k in self.common.items()}
        self.own = {i: ([t for t in tokens if t not in self.common], frozenset(t for t in tokens if t in self.common)) for i, tokens in names.items()}
        by: dict[str, set] = defaultdict(set)
        alias: dict[str, set] = defaultdict(set)
        for i, (own, _) in self.own.items():
            for t in own:
                by[fold(t)].add(i)
                by[t].add(i)
        for i, _, short in rows:
            if short:
                alias["".join(fold(t) for t in _LETTERS.findall(short.lower()))].add(i)
        self.index, self.alias = TokenIndex(by), TokenIndex(alias)
        self.words = TokenIndex({f: t for t in self.common for f in (fold(t), t)})
        # the initials of two to four common words side by side
        self.initials: dict[str, set[tuple[str, ...]]] = defaultdict(set)
        for tokens in names.values():
            for a in range(len(tokens)):
                for b in range(a + 2, min(a + 5, len(tokens) + 1)):
                    if all(t in self.common for t in tokens[a:b]):
                        self.initials["".join(t[0] for t in tokens[a:b])].add(tuple(tokens[a:b]))
                        if b == a + 2:
                            self.initials[f"{tokens[a][0]}n{tokens[a + 1][0]}"].add(tuple(tokens[a:b]))
        self.kinds = {words for _, words in self.own.values()}
        self._known: dict[str, tuple[tuple[str, ...], bool] | None] = {}

    def common_words(self, token: str) -> tuple[tuple[str, ...], bool] | None:
        """The common words that a token stands for, and whether that is a guess from a few letters."""
        if token not in self._known:
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[token] = self._read(token)
        return self._known[token]

    def _read(self, token: str) -> tuple[tuple[str, ...], bool] | None:
        word = _ALSO.get(token, token)
        if word in self.common:
            return (word,), False
        if token in self.index.values:
            return None
        if token in self.initials and len(token) < 5:
            return min(self.initials[token]), len(token) < 3
        near = {}
        if len(token) >= 3:
            for form in (fold(token), token):
                for t, d in self.words.near(form).items():
                    w = self.words.values[t]
                    near[w] = min(d, near.get(w, 9))
            near = {w: d for w, d in near.items() if d <= (1 if min(len(w), len(token)) < 6 else 2)}
        if near:
            d = min(near.values())
            best = sorted((-_common_start(w, token), w) for w, k in near.items() if k == d)
            return (best[0][1],), len(token) < 5 or d > 1 and len(fold(token)) < 7
        if (found := self._short(token)) is not None:
            return found, True
        for k in range(3, len(token) - 1):  # two words in one
            if token[:k] in self.common and (rest := (token[k:],) if token[k:] in self.common else self._short(token[k:]) or self._close(token[k:])):
                return (token[:k], *rest), False
        return None

    def _close(self, token: str) -> tuple[str, ...] | None:
        near = {self.words.values[t]: d for t, d in self.words.near(fold(token)).items() if d <= (1 if len(token) < 6 else 2)} if len(token) >= 5 else {}
        return (min(near, key=lambda w: (near[w], w)),) if near else None

    def _short(self, token: str) -> tuple[str, ...] | None:
        """The one common word that a token abbreviates best."""
        if not 2 <= len(token) <= 12:
            return None
        for t in (token, token.removesuffix("s")):
            fits = sorted(((-_common_start(t, w), len(w), w) for w in self.common if abbreviates(t, w)), key=lambda x: x[:2]) if len(t) > 1 else []
            if fits and (len(fits) == 1 or fits[0][0] < fits[1][0] or fits[0][1] < fits[1][1]):
                return (fits[0][2],)
        return None

    def split(self, text: str, plain: frozenset[str] | None = frozenset()) -> tuple[list[str], frozenset[str], set[str]]:
        """A name's own tokens in order, its common words, and the tokens taken for common words by a guess. plain: tokens of
        which nothing is to be guessed (None: of all)."""
        tokens = tokens_of(text)
        longest = self.index.longest + 2 * self.words.longest + 4  # a name and two words glued to it
        if any(len(t) > longest for t in tokens) or len(tokens) > MOST_TOKENS:
            return [], frozenset(), set()
        own, words, guessed, open_runs = [], set(), set(), []
        i = 0
        while i < len(tokens):
            t = tokens[i]
            if len(t) <= 2:  # initials of common words, written with dots or slashes
                run = [k for k in range(i, len(tokens)) if all(len(x) <= 2 or x == "and" for x in tokens[i : k + 1])]
                found = 0
                for k in reversed(run[1:]):
                    letters = "".join(x for x in tokens[i : k + 1] if x not in ("and", "n"))
                    if letters in self.common:
                        words.add(letters)
                    elif len(letters) > 1 and letters in self.initials:
                        open_runs.append(letters)
                    else:
                        continue
                    found = k + 1
                    break
                if found:
                    i = found
                    continue
            if t in _TITLES:
                i += 1
                continue
            if 2 < len(t) < 5 and t in self.initials and t not in self.common and t not in self.index.values:
                open_runs.append(t)
                i += 1
                continue
            if i + 1 < len(tokens) and (len(t) == 1 or len(tokens[i + 1]) > 2):  # one word in two pieces
                pair = t + tokens[i + 1]
                whole = pair if pair in self.common and not (t in self.common and tokens[i + 1] in self.common) else None
                if whole is None and len(t) == 1:
                    whole = next((w for w in self.common if w[0] == t and len(tokens[i + 1]) >= 4 and w.endswith(tokens[i + 1]) and len(w) > len(tokens[i + 1]) + 1), None)
                if whole is not None:
                    words.add(whole)
                    i += 2
                    continue
            found = self.common_words(t) if len(t) > 1 else None
            if found is not None and not (found[1] and (plain is None or t in plain)):
                words.update(found[0])
                if found[1]:
                    guessed.add(t)
            elif (k := self._glued(t)) is not None:
                tokens[i : i + 1] = [t[:k], t[k:]]
                continue
            elif t != "n":
                own.append(_ALSO[t] if _ALSO.get(t) in self.index.values else t)
            i += 1
        for letters in open_runs:  # of the words that the initials may stand for, those that go with the others
            words.update(max(sorted(self.initials[letters]), key=lambda ws: max(len(k & (words | set(ws))) - len((words | set(ws)) - k) for k in self.kinds)))
        return own, frozenset(words), guessed

    def _glued(self, token: str) -> int | None:
        """Where a common word begins that is glued to the end of a token."""
        if token in self.index.values:
            return None
        whole = next((k for k in range(4, len(token) - 3) if token[k:] in self.common or token[k:] + "s" in self.common), None)
        return whole or next((k for k in range(4, len(token) - 5) if any(w.startswith(token[k:]) for w in self.common)), None)

    def candidates(self, tokens: Sequence[str]) -> set[int]:
        found: set[int] = set()
        for typed in tokens:
            f = fold(typed)
            if len(f) >= 2:
                near = {*self.index.near(f), *self.index.near(typed)}
                begun = self.index.starting(f) if len(f) >= 3 else set()
                for t in near | begun or (self.index.starting(f[:4]) if len(f) >= 4 else self.index.starting(f[:1]) if len(f) == 3 else ()):
                    found |= self.index.values[t]
        return found

    def fits(self, tokens: Sequence[str], words: frozenset) -> list[tuple[float, int]]:
        out = []
        kind = words - _LEGAL
        for i in self.candidates(tokens):
            theirs, their_words = self.own[i]
            mean, best = align(tokens, theirs)
            if best < 0.7:
                continue
            their_kind = their_words - _LEGAL
            if kind and their_kind:
                weigh = lambda ws: sum(self.rarity[w] for w in ws)
                if weigh(kind & their_kind) < AGREE * weigh(kind | their_kind):
                    continue
            elif len(theirs) == 1 and not kind and best < 0.9:
                continue
            legal = len(words & _LEGAL ^ their_words & _LEGAL) if words & _LEGAL else 0
            alike = len(kind & their_kind) - len(kind ^ their_kind) if kind else 0
            out.append((mean + 0.04 * alike - 0.01 * legal, i))
        return out

    def _other_cuts(self, own: list[str], words: frozenset) -> Iterator[tuple[list[str], frozenset]]:
        """Other ways to cut the own tokens: one typed with a blank in it, initials run together, an abbreviation glued on."""
        for k in range(len(own) - 1):
            pair = own[k] + own[k + 1]
            yield [*own[:k], pair, *own[k + 2 :]], words
            if (cut := self._glued(pair)) is not None and (found := self.common_words(pair[cut:])) is not None:
                yield [*own[:k], pair[:cut], *own[k + 2 :]], words | set(found[0])
        for k, t in enumerate(own):
            if 2 <= len(t) <= 4 and t not in self.index.values:
                yield [*own[:k], *t, *own[k + 1 :]], words
        for k, t in enumerate(own):
            for cut in range(max(4, len(t) - 4), len(t) - 1):
                if (found := self._short(t[cut:])) is not None and (t[:cut] in self.index.values or self.index.near(fold(t[:cut]))):
                    yield [*own[:k], t[:cut], *own[k + 1 :]], words | set(found)
            for cut in range(3, len(t) - 2):
                if t[:cut] in self.index.values and t[cut:] in self.index.values:
                    yield [*own[:k], t[:cut], t[cut:], *own[k + 1 :]], words

    def resolve(self, text: str) -> int | None:
        own, words, guessed = self.split(text)
        readings = [(own, words)] + [self.split(text, frozenset((t,)))[:2] for t in sorted(guessed)] + ([self.split(text, None)[:2]] if len(guessed) > 1 else [])
        fits = next((found for r in readings if (found := self.fits(*r))), [])
        if not fits:
            fits = next((found for r in readings if (found := [x for cut in self._other_cuts(*r) for x in self.fits(*cut)])), [])
        if not fits and "n" in tokens_of(text):  # it may be an initial and no "and"
            fits = self.fits([*own, "n"], words)
        if own and not words and sum(map(len, own)) < 60:
            f = fold("".join(own))
            fits += [(0.99 - 0.1 * d, i) for near, d in self.alias.near(f).items() if d <= 1 or len(f) >= 7 for i in self.alias.values[near]]
        if not fits:
            return None
        top = max(fits)[0]
        best = {i for s, i in fits if s >= top - 0.005}
        return best.pop() if len(best) == 1 else None


_BUILT: dict[tuple[str, int], Register] = {}


def _built(kind: str, rows: list[tuple[int, str, str | None]]) -> Register:
    """The index of a kind, built once a worker for each version of the register."""
    version = kind, zlib.crc32(repr(rows).encode())
    if version not in _BUILT:
        if len(_BUILT) > 7:
            _BUILT.clear()
        _BUILT[version] = Register(rows)
    return _BUILT[version]


def link(records: DataFrame, register: DataFrame, fields: dict[str, str], key: str = "record_id") -> DataFrame:
    """(key, field, entity_id) for every cell that means an organisation of the register but differs from its name.
    fields: column of ``records`` -> kind in the register."""
    rows = register.filter(F.col("name").isNotNull()).select("entity_id", "kind", "name", "short_name")
    if rows.limit(REGISTER_ROWS + 1).count() > REGISTER_ROWS:
        raise ValueError(f"the register has more than {REGISTER_ROWS} rows")
    held: dict[str, list] = defaultdict(list)
    for i, kind, name, short in rows.orderBy("entity_id").collect():
        held[kind].append((i, name, short))
    cells = records.select(F.col(key).alias("key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("c")).select("key", "c.field", "c.text")
    cells = cells.filter(F.col("text").isNotNull() & ~F.lower(F.trim("text")).isin(*PLACEHOLDERS))
    send = records.sparkSession.sparkContext.broadcast((dict(fields), dict(held)))

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds, held = send.value
        find = {f: _built(k, held.get(k, [])) for f, k in kinds.items()}
        names = {f: {name for _, name, _ in held.get(k, [])} for f, k in kinds.items()}
        for b in batches:
            ids = [None if t in names[f] else find[f].resolve(t) for f, t in zip(b["field"].tolist(), b["text"].tolist())]
            b["entity_id"] = pd.array(ids, "Int64")
            yield b[b["entity_id"].notna()]

    spellings = cells.groupBy("field", "text").agg(F.count("*").alias("n")).select("field", "text")
    # little data but much work: its partitions are not to be put together
    spark, name = records.sparkSession, "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        known = materialize(spellings.mapInPandas(resolve, "field string, text string, entity_id long"), "spellings")
    finally:
        spark.conf.set(name, before)
    return cells.join(small_side(known, 20_000), ["field", "text"]).select(F.col("key").alias(key), "field", "entity_id")
