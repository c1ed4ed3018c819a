"""Mixing by iterative proportional fitting, all in DataFrame operations.

Documents are cells by source, language and topic.  Raking scales the token weight of the cells
until the shares of each margin meet their targets; documents are then sampled with a
probability in proportion to the factor of their cell, calibrated to a token budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.session import stage

MARGINS = ("source", "lang", "topic")
NONE = "(none)"

# Topics by plain rules over the text, the first that holds; the last is the rest.
TOPICS = (("license", "Licensed under"), ("contact", "@"), ("table", " | "), ("shouted", "!! "))
OTHER = "prose"


def topic_of(text: Column, rules=TOPICS, other: str = OTHER) -> Column:
    chosen = F.lit(other)
    for name, needle in reversed(rules):
        chosen = F.when(F.contains(text, F.lit(needle)), name).otherwise(chosen)
    return chosen


def token_weight(text: Column) -> Column:
    """Spaces and line ends plus one: whole words of text with single gaps; 0 without text."""
    gaps = F.length(text) - F.length(F.translate(text, " \n\t", ""))
    return F.when(F.length(text) > 0, gaps + 1).otherwise(0).cast("long")


def tempered(cells: DataFrame, margin: str, power: float = 0.5) -> DataFrame:
    """Target shares (margin, target): actual token shares raised to a power, scaled to one.

    One row per value of the margin; values without tokens have no target.
    """
    shares = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).filter("t > 0")
    shares = shares.select(margin, F.pow(F.col("t").cast("double"), F.lit(power)).alias("s"))
    total = shares.agg(F.sum("s")).first()[0] or 1.0
    return shares.select(margin, (F.col("s") / F.lit(total)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = 16) -> DataFrame:
    """Adds ``weight``: the tokens of each cell scaled so that each margin meets its targets.

    ``cells`` has the margins and ``tokens`` (above 0), one row per cell.  A sweep scales to
    every margin in turn, a sum over the cells of each value; every four sweeps are written, so
    plans stay short and a lost executor costs little.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    rows = cells.withColumn("weight", F.col("tokens").cast("double"))
    for margin, target in targets.items():
        rows = rows.join(target.select(margin, F.col("target").alias(f"target_{margin}")), margin)
    for sweep in range(1, sweeps + 1):
        for margin in targets:
            now = F.sum("weight").over(Window.partitionBy(margin))
            rows = rows.withColumn("weight", F.col("weight") * (F.col(f"target_{margin}") / now) * total)
        if sweep % 4 == 0 or sweep == sweeps:
            rows = stage(rows, "raked-cells")
    return rows.select(*cells.columns, "weight")


def calibrate(cells: DataFrame, budget: float, rounds: int = 12) -> DataFrame:
    """Adds ``probability``, in proportion to weight / tokens, at most 1, with an expected
    ``budget`` share of all tokens.

    Cells whose probability would pass 1 are taken whole and the rest is scaled again; each
    round brings two sums to the driver.
    """
    rows = cells.withColumn("factor", F.col("weight") / F.col("tokens"))
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    scale = float(budget)
    for _ in range(rounds):
        whole = F.col("factor") * F.lit(scale) >= 1
        full, rest = rows.agg(
            F.coalesce(F.sum(F.when(whole, F.col("tokens"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~whole, F.col("weight"))), F.lit(0.0)),
        ).first()
        better = (budget * total - full) / rest if rest else scale
        if not rest or abs(better - scale) <= 1e-12 * abs(scale):
            break
        scale = max(better, scale)
    return rows.withColumn("probability", F.least(F.lit(1.0), F.col("factor") * F.lit(scale))).drop("factor")


def uniform(id_column: Column, seed: str) -> Column:
    """A number in [0, 1) from the id alone: the first 52 bits of an md5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_column.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = 0.5, seed: str = "mix", sweeps: int = 16,
    power: float = 0.5, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``docs`` with n_tokens, topic, probability, draw and sampled.

    Targets are shares per value of source, language and topic; margins that are not given take
    their tempered shares.  Null sources and languages are a value of their own.  Documents
    without tokens have probability 0, as have values that a given target leaves out.  Equal ids
    draw the same number.  All rows are returned.
    """
    added = ("n_tokens", "topic", "probability", "draw", "sampled")
    clash = [c for c in docs.columns if c.lower() in added or c.startswith("_m_")]
    rows = docs.drop(*clash) if clash else docs
    rows = rows.withColumns({
        "n_tokens": token_weight(F.coalesce(text_column, F.lit(""))),
        "topic": topic_of(F.coalesce(text_column, F.lit(""))),
        "_m_source": F.coalesce("source", F.lit(NONE)), "_m_lang": F.coalesce("lang", F.lit(NONE)),
    })
    keys = ["_m_source", "_m_lang", "topic"]
    # the sums are made where the documents are read: only cells are shuffled
    cells = rows.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0")
    cells = stage(cells.select(F.col("_m_source").alias("source"), F.col("_m_lang").alias("lang"), "topic", "tokens"), "mix-cells")
    given = targets or {}
    wanted = {m: given[m] if m in given else stage(tempered(cells, m, power), "mix-targets") for m in MARGINS}
    known = cells
    for m in MARGINS:
        known = known.join(wanted[m].filter("target > 0").select(m), m, "left_semi")
    cells = stage(calibrate(rake(known, wanted, sweeps), budget), "mix-probabilities")
    cells = cells.select(F.col("source").alias("_m_source"), F.col("lang").alias("_m_lang"), "topic", "probability")
    out = rows.join(cells, keys, "left")
    out = out.withColumns({
        "probability": F.when(F.col("n_tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0),
        "draw": uniform(F.col(id_column), seed),
    }).withColumn("sampled", F.col("draw") < F.col("probability"))
    return out.drop("_m_source", "_m_lang").select(*rows.columns[:-4], *added)
