"""Corpus preparation: quality rules, near-duplicates, mixing to target weights, packing.

Each stage works on all rows that the one before kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.llm import dedup, mixing, packing, quality
from tidepool.llm.common import materialize, scratch, table


#: Texts that go to Python in one batch at most. Spark's 10,000 are 34 MB of texts of 3.4 KB, which the JVM and the Python process of each running task hold several times over.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on this session hands Python no more than BATCH_ROWS rows at once; stages are run by the caller's write, so the setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go."""
    small_batches(spark)
    return quality.keep(docs, table(spark, sf_dir, "labels"))


#: Near copies share at least so many of 100 five-word shingles.
PERCENT = 80
#: Columns that a stage adds for itself; documents have none of these names.
ROW, GROUP, COPIES, COPY = "__row__", "__group__", "__copies__", "__copy__"
FIRST, PLACE = "__first__", "__place__"
#: Rows of decisions that are sent to the texts at most: 12 MB of numbers.
SENT_ROWS = 1 << 20


def numbered(docs: DataFrame) -> DataFrame:
    """docs and ROW, a long that differs from row to row and is the same in each read of the table.

    A row of a table in files is known by its file and its place there, so no copy of the texts is written: ROW is a hash of the file plus the
    place. Whether all rows of each file are there, and no two files' ranges meet, is checked on one row a file; if they meet another hash is
    taken. Other DataFrames (made in memory, filtered, joined) are written to the shared folder and numbered there; one with a limit has to be written before.
    """
    for seed in range(3):
        try:
            kept = docs.metadataColumn("_metadata")
            rows = docs.select("*", F.shiftright(F.xxhash64(kept["file_path"], F.lit(seed)), 1).alias(FIRST), kept["row_index"].alias(PLACE))
        except AnalysisException:  # no files
            break
        files = rows.groupBy(FIRST).agg(F.count(F.lit(1)).alias("n"), F.max(PLACE).alias("last"), F.sum(PLACE).alias("sum"))
        whole = (F.col("n") == F.col("last") + 1) & (2 * F.col("sum") == F.col("last") * F.col("n"))
        apart = F.coalesce(F.lead(FIRST).over(Window.orderBy(FIRST)) > F.col(FIRST) + F.col("last"), F.lit(True))
        if not files.select((whole & apart).alias("fine")).where(~F.col("fine")).limit(1).count():
            return rows.withColumn(ROW, F.col(FIRST) + F.col(PLACE)).drop(FIRST, PLACE)
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows", compression="zstd")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one with the least doc_id, of rows with one doc_id that with the least hash of its text.
    Rows are compared by their texts, whatever their doc_ids: copies without a doc_id go, and different texts under one doc_id stay.
    Rows without words are linked with nothing and stay."""
    small_batches(spark)
    rows = numbered(docs)
    with scratch(spark):
        found = dedup.near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"), PERCENT).select(F.col("doc_id").alias(ROW), F.col("component_id").alias(GROUP))
        order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), ROW)
        groups = found.join(rows.select(ROW, order.alias("o")), ROW).groupBy(GROUP).agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("n")).where("n > 1")
        # written, so that a group with very many rows can be split in the join: it no longer shares the aggregate's exchange
        groups = materialize(groups.select(GROUP, F.col(f"o.{ROW}").alias("best")), "groups")
        gone = found.join(groups, GROUP).where(F.col(ROW) != F.col("best")).select(ROW)
        # written, so that Spark knows its size and sends it to the texts if it is small
        gone = materialize(gone, "gone", keep=True)
    return rows.join(gone, ROW, "left_anti").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice. Rows without a doc_id and repeated ones are told apart by a row
    number."""
    small_batches(spark)
    rows = numbered(docs)
    with scratch(spark):
        copies = mixing.mix(rows, row=ROW).select(F.col("row").alias(ROW), F.col("copies").cast("int").alias(COPIES)).where(F.col(COPIES) > 0)
        copies = materialize(copies, "copies", keep=True)
    sent = F.broadcast(copies) if copies.count() <= SENT_ROWS else copies  # two numbers a row; beyond that the texts move
    return rows.join(sent, ROW).withColumn(COPY, F.explode(F.array_repeat(F.lit(1), F.col(COPIES)))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("mixing", mixed), ("packing", packed)]
#: Trees, random rounding and packing are not SQL; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
