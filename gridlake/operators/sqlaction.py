"""The SQL action: a SQL text over the current frame, named ``dataframe``."""

from __future__ import annotations

from pyspark.sql import DataFrame


VIEW = "dataframe"


def run_sql(df: DataFrame, text: str) -> DataFrame:
    """Run ``text`` with ``df`` bound as ``dataframe`` (Spark SQL dialect).

    The view is resolved while the text is analysed; a view of the session with that name is there
    again afterwards.
    """
    spark = df.sparkSession
    own = next((t for t in spark.catalog.listTables() if t.isTemporary and t.name == VIEW), None)
    before = spark.table(VIEW) if own else None
    df.createOrReplaceTempView(VIEW)
    try:
        return spark.sql(text)
    finally:
        if before is None:
            spark.catalog.dropTempView(VIEW)
        else:
            before.createOrReplaceTempView(VIEW)


def is_ordered(df: DataFrame) -> bool:
    """Whether the rows of a query come in the order of an ORDER BY of their own."""
    node = df._jdf.queryExecution().analyzed()
    while True:
        name = node.nodeName()
        if name == "Sort":
            return node.toString().splitlines()[0].endswith("true")
        if name == "WithCTE":
            node = node.plan()
        elif name in ("GlobalLimit", "LocalLimit", "Offset", "Project", "SubqueryAlias"):
            node = node.children().apply(0)
        else:
            return False
