"""All queries of the core, with the SQL of those that SQL can express."""

from tallymark.plans import problems, works
from tallymark.plans import summaries as _summaries  # noqa: F401  (registers its queries among those of works)

FLAGSHIP = "confidence_report"
QUERIES = {**works.QUERIES, **problems.QUERIES}
ORACLE = {**works.ORACLE, **problems.ORACLE}
