"""Findings in prose, multi-hot tables, lexicons, intervals and other small aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.text import worded_amount

# What a paragraph of an audit is about, and how grave it is; the first pattern that fits counts.
ISSUES = {
    "ghost beneficiary": r"(?i)ghost\s+(?:beneficiar|worker|employee|muster)|fictitious\s+(?:beneficiar|name|worker)|non-?existent\s+beneficiar",
    "overpayment": r"(?i)over-?payment|excess\s+payment|paid\s+in\s+excess|overcharg|inflated\s+(?:bill|rate|cost)|double\s+payment",
    "procurement irregularity": r"(?i)procurement\s+irregular|tender(?:ing)?\s+irregular|without\s+(?:inviting\s+)?tender|single\s+tender|violation\s+of\s+(?:the\s+)?(?:gfr|procurement)|favouritism",
    "underutilization": r"(?i)under-?utilis|under-?utiliz|unspent\s+balance|funds?\s+(?:lying|remained)\s+(?:idle|unspent)|non-?utilis|savings?\s+not\s+surrendered",
    "delay": r"(?i)\bdelay(?:ed|s)?\b|time\s+over-?run|not\s+completed\s+within|belated|inordinate\s+delay",
}
SEVERITIES = {
    "HIGH": r"(?i)fraud|misappropriat|embezzl|siphon|fictitious|forged|criminal|malafide|serious\s+irregular|major\s+loss",
    "MEDIUM": r"(?i)irregular|avoidable|undue\s+(?:favour|benefit)|deficien|lapse|non-?compliance|shortfall",
    "LOW": r"(?i)minor|procedural|clerical|technical\s+observation",
}


def first_match(x: Column, patterns: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(x.rlike(p), name) for name, p in patterns.items()])


def paragraphs(documents: DataFrame, doc: str = "doc_id", text: str = "text", shortest: int = 40) -> DataFrame:
    """(doc, n, issue, severity, amount, year) of the paragraphs of prose that name an issue."""
    parts = documents.select(doc, F.posexplode(F.split(text, r"\n\s*\n")).alias("n", "p")).filter(F.length("p") >= shortest)
    p = F.col("p")
    bare = F.regexp_extract(p, "(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1).try_cast("int")
    year = F.coalesce(F.regexp_extract(p, "(?:^|[^0-9])((?:19|20)[0-9]{2})[-/][0-9]{2}", 1).try_cast("int"), bare)  # a financial year before a bare one
    return parts.select(doc, "n", first_match(p, ISSUES).alias("issue"), first_match(p, SEVERITIES).alias("severity"), worded_amount(p).alias("amount"), year.alias("year")).filter("issue IS NOT NULL")


def multi_hot(labels: DataFrame, key: str, label: str, channels: Sequence[str]) -> DataFrame:
    """One 0/1 column per channel; channels are named, so that the shape does not hang on the data."""
    return labels.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.max((F.col(label) == c).cast("int")).alias(c) for c in channels])


def nullish_lexicon(df: DataFrame, columns: Sequence[str], longest: int = 14, least: int = 10) -> DataFrame:
    """(token, fields, n): short values that stand in two columns or more and hold no digit, or zeros only and are no number:
    words for *nothing*."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.lower(F.trim(F.col(c))).alias("token")) for c in columns])).alias("c")).select("c.*")
    zeros = F.col("token").rlike(r"^[0\W_]+$") & ~F.replace(F.replace("token", F.lit(","), F.lit("")), F.lit(" "), F.lit("")).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$")
    short = cells.filter((F.length("token") <= longest) & (~F.col("token").rlike("[0-9]") | zeros))
    return short.groupBy("token").agg(F.count_distinct("field").alias("fields"), F.count("*").alias("n")).filter((F.col("fields") >= 2) & (F.col("n") >= least))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a share."""
    p = hits / F.nullif(n, F.lit(0))
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - half) / (1 + z * z / n), (centre + half) / (1 + z * z / n)


def frequent(df: DataFrame, column: str, least: int = 20) -> DataFrame:
    """(value, index, n): values seen often enough for an index of their own, by falling count."""
    counts = df.groupBy(F.coalesce(column, F.lit("MISSING")).alias("value")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return counts.select("value", (F.row_number().over(Window.orderBy(F.desc("n"), "value")) - 1).alias("index"), "n")  # at most rows / least values


def overlap(a: DataFrame, b: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """The share of the top k of one ranking that is in the top k of another."""
    top = lambda d: d.filter(F.col(score).isNotNull()).orderBy(F.desc(score), key).limit(k).select(key)
    return top(a).join(top(b), key).agg((F.count("*") / F.lit(k)).alias("overlap"))


def masked_log(x: Column) -> tuple[Column, Column]:
    """log1p of a non-negative number with 0 for what is absent, and the mask that tells the two apart."""
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(ok, F.log1p(F.greatest(x, F.lit(0.0)))).otherwise(0.0), ok.cast("int")


def work_context(df: DataFrame, key: str = "work_id") -> DataFrame:
    """Per shared key: records, distinct districts and statuses, and whether they conflict. Null keys are left out."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("district").alias("districts"), F.count_distinct("status").alias("statuses")).filter("n > 1").withColumn("conflict", (F.col("districts") > 1) | (F.col("statuses") > 1))


def agreement_weights(pairs: DataFrame, patterns: Sequence[str], rounds: int = 10) -> tuple[list[float], list[float], float]:
    """Fellegi and Sunter's m and u by expectation maximisation over the counts of agreement patterns. The pairs are read
    once; 2 to the number of fields rows reach the driver."""
    counts = [(tuple(int(r[p]) for p in patterns), r["n"]) for r in pairs.groupBy(*patterns).agg(F.count("*").alias("n")).collect()]
    m, u, share = [0.9] * len(patterns), [0.1] * len(patterns), 0.1
    for _ in range(rounds if counts else 0):
        like = lambda probs, g: _product(q if a else 1 - q for q, a in zip(probs, g))
        post = [(g, n, share * like(m, g) / max(1e-300, share * like(m, g) + (1 - share) * like(u, g))) for g, n in counts]
        total, same = sum(n for _, n, _ in post), sum(n * p for _, n, p in post)
        share = min(1 - 1e-6, max(1e-6, same / total))
        for i in range(len(patterns)):
            m[i] = min(1 - 1e-6, max(1e-6, sum(n * p for g, n, p in post if g[i]) / max(same, 1e-9)))
            u[i] = min(1 - 1e-6, max(1e-6, sum(n * (1 - p) for g, n, p in post if g[i]) / max(total - same, 1e-9)))
    return m, u, share


def _product(xs) -> float:
    out = 1.0
    for x in xs:
        out *= x
    return out


def read_payloads(df: DataFrame, column: str, schema: str, vocabulary: dict[str, Sequence[str]]) -> DataFrame:
    """A column of JSON as columns of their own. A text that is no JSON of the schema, or a value outside its field's
    vocabulary, fails the job."""
    read = F.from_json(column, schema, {"mode": "PERMISSIVE"})
    fields = [f.split()[0] for f in schema.split(", ")]
    out = df.withColumn("_p", read)
    bad = F.col(column).isNotNull() & (F.col("_p").isNull() | F.try_parse_json(column).isNull())
    for field, known in vocabulary.items():
        bad = bad | F.coalesce(~F.upper(F.col("_p")[field]).isin(*known), F.lit(False))
    checked = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.concat(F.lit("unreadable payload: "), F.substring(column, 1, 100))).cast("boolean")).otherwise(True)
    return out.filter(checked).select(*[c for c in df.columns if c != column], *[F.col("_p")[f].alias(f) for f in fields])
