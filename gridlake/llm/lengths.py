"""Exact token counts: one histogram of encoded lengths answers every context limit.

Tasks count documents by length, Spark adds the counts up, and sums over longer lengths then
give, for each limit L: documents and tokens of at most L, documents that are cut, tokens kept
when every document is cut to L, and the share of documents that fit.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.session import stage

# Lengths are summed in stretches of so many, then over the stretches.
STRETCH = 1024


def length_histogram(docs: DataFrame, tokenizer: str, text_column: str = "text") -> DataFrame:
    """(n_tokens, n_docs) of whole texts; null and empty texts have length 0.

    Only the text column is read.  An empty table gives no rows.
    """

    def count(batches):
        # imported in the task, so that its caches live as long as the worker
        from gridlake.llm import encoders

        coder, seen = encoders.encoder(tokenizer), Counter()
        for batch in batches:
            seen.update(len(coder.encode(t or "")) // 4 for t in batch["text"].to_pylist())
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen.keys()), pa.int64()), pa.array(list(seen.values()), pa.int64())],
                names=["n_tokens", "n_docs"],
            )

    counted = docs.select(F.col(text_column).alias("text")).mapInArrow(count, "n_tokens long, n_docs long")
    return counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def length_profile(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit, what fits and what is cut.

    ``docs_over`` is the suffix sum of documents; ``kept_tokens`` counts every document up to
    the limit; ``share`` is the part of all documents that fits.
    """
    rows = histogram.withColumn("stretch", F.floor(F.col("n_tokens") / STRETCH).cast("long"))
    rows = rows.withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    totals = rows.groupBy("stretch").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    # One row per stretch of lengths, however many documents there are.
    every = Window.orderBy("stretch")
    later = every.rowsBetween(1, Window.unboundedFollowing)
    earlier = every.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "stretch",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("earlier_tokens"),
        F.sum("d").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_docs"),
    )
    inside = Window.partitionBy("stretch").orderBy("n_tokens")
    rows = rows.join(totals, "stretch").withColumns({
        "docs_over": F.coalesce(F.sum("n_docs").over(inside.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
        + F.col("later_docs"),
        "fit_tokens": F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("earlier_tokens"),
    })
    return rows.select(
        "n_tokens", "n_docs", "docs_over", "fit_tokens",
        (F.col("fit_tokens") + F.col("n_tokens") * F.col("docs_over")).alias("kept_tokens"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("share"),
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """One row per context limit: documents, all tokens, tokens kept, documents cut."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(int(v),) for v in sorted(set(limits))], "context long")
    cut = F.explode(F.array(*[F.lit(int(v)).cast("long") for v in sorted(set(limits))]))
    counted = histogram.select("*", cut.alias("context")).groupBy("context").agg(
        F.sum("n_docs").alias("docs"),
        F.sum(F.col("n_docs") * F.col("n_tokens")).alias("all_tokens"),
        F.sum(F.col("n_docs") * F.least("n_tokens", "context")).alias("kept_tokens"),
        F.sum(F.when(F.col("n_tokens") > F.col("context"), F.col("n_docs")).otherwise(0)).alias("docs_cut"),
    )
    return asked.join(counted, "context", "left").na.fill(0)


def length_quantiles(profile: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least the given shares of documents do not exceed."""
    asked = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    rows = profile.select("n_tokens", "share", asked.alias("asked")).filter("share >= asked")
    return rows.groupBy("asked").agg(F.min("n_tokens").alias("n_tokens"))
