"""Codes read from texts by rules that are data: a table of (source, priority, pattern, take, hold)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null

RULES = "source STRING, priority INT, pattern STRING, take STRING, hold BOOLEAN"
#: A code that starts or ends with a letter or digit has no other beside it. Letters of other scripts may stand there, so
#: this is not a word boundary.
BEFORE, AFTER = "(?:(?<![A-Za-z0-9])|(?![A-Za-z0-9]))", "(?:(?![A-Za-z0-9])|(?<![A-Za-z0-9]))"


def _one(text: Column, pattern: str, take: str) -> Column:
    """The first or last match of one pattern with its groups joined by a dash; null if there is none."""
    groups = pattern.replace(r"\(", "").replace("(?", "").count("(")
    edged = f"{BEFORE}(?:{pattern}){AFTER}"
    if take == "last":
        every = F.regexp_extract_all(text, F.lit(edged), 1 if groups else 0)
        return F.try_element_at(every, F.lit(-1))
    if groups < 2:
        return blank_to_null(F.regexp_extract(text, edged, groups))
    return blank_to_null(F.array_join(F.array(*[blank_to_null(F.regexp_extract(text, edged, i + 1)) for i in range(groups)]), "-"))


def codes_by_rule(rows: DataFrame, rules: DataFrame, text: str, most: int = 2_000) -> DataFrame:
    """`rows` (with a column `source`) with model and status. The patterns of a row's source are tried by priority; the first
    that is found gives the model, its first or last match (`take`; a last match has one group at most). Without a model the
    status is 'hold' if a rule of the source says so, else 'drop'; rows of sources without rules, and null texts, have
    none either and drop. The rules (at most `most`, checked) become one expression, so rows are not joined or moved."""
    table = rules.select("source", "priority", "pattern", "take", "hold").limit(most + 1).collect()
    if len(table) > most:
        raise ValueError(f"more than {most} rules")
    by_source: dict[str, list] = {}
    for r in sorted(table, key=lambda r: (r["source"], r["priority"], r["pattern"])):
        by_source.setdefault(r["source"], []).append(r)
    model, held = F.lit(None).cast("string"), F.lit(False)
    for source, own in by_source.items():
        mine = F.col("source") == source
        model = F.when(mine, F.coalesce(*[_one(F.col(text), r["pattern"], r["take"]) for r in own])).otherwise(model)
        held = F.when(mine, F.lit(any(r["hold"] for r in own))).otherwise(held)
    out = rows.withColumn("model", model)
    return out.withColumn("status", F.when(F.col("model").isNotNull(), "code").when(held, "hold").otherwise("drop"))
