"""What the operators share: input tables, document columns, batch sizes, connected classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.session import materialize

BATCH_ROWS = 1000
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Rows that go to Python at once: few enough that long texts fit a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator on texts needs, as ``doc_id`` and ``text``; a NULL text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_key(text: str = "text"):
    """Names a text: the first half of its SHA-256."""
    return F.unhex(F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, 32))


def scratch_name(name: str) -> str:
    return f"llm-{name}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later steps restart from here.

    The shuffle files of that write are not needed any more. Spark deletes them at once, so that disk
    holds those of one step, whenever the driver collects its garbage.
    """
    spark = df.sparkSession
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        return materialize(df, scratch_name(name))
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def quoted(names: list[str]) -> list[str]:
    """Column names as they are, whatever signs they hold."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def rows_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with doc_id and text) whose id and text ``kept`` (doc_id, node) names, each
    once: a row that repeats another in id and text goes."""
    names = docs.columns
    wanted = kept.groupBy("doc_id", "node").agg(F.count("*").alias("n")).select(F.col("doc_id").alias("kept_id"), F.col("node").alias("kept_node"), "n")
    wanted = keep(wanted, "kept")
    full = docs.withColumn("llm_text", F.coalesce("text", F.lit(""))).withColumn("llm_node", text_key("llm_text"))
    same = F.col("llm_node").eqNullSafe(F.col("kept_node")) & F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id"))
    some = full.join(wanted, same, "left_semi")
    if not wanted.filter("n > 1").isEmpty():
        some = some.dropDuplicates(["doc_id", "llm_node"])
    return some.select(*quoted(names))


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, comp) of every node of the links (a, b); comp is the least node that can be reached.

    Each round takes the least label among the neighbours and then the label of the label, so the
    rounds grow with the logarithm of a chain. All steps are joins on narrow rows and pre-aggregated
    minima, so that a hub spreads over tasks. Nodes without links are not listed.
    """
    both = keep(
        links.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .unionAll(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        .filter("node <> other")
        .distinct(),
        "links",
    )
    labels = keep(both.groupBy("node").agg(F.min("other").alias("near")).select("node", F.least("node", "near").alias("comp")), "labels")
    for _ in range(max_rounds):
        theirs = labels.select(F.col("node").alias("other"), F.col("comp").alias("near"))
        near = both.join(theirs, "other").groupBy("node").agg(F.min("near").alias("near"))
        pulled = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        new = keep(pulled.join(jump, "next").select("node", F.least("next", "far").alias("comp"), (F.least("next", "far") != F.col("comp")).alias("moved")), "labels")
        labels = new.select("node", "comp")
        if new.filter("moved").isEmpty():
            return labels
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
