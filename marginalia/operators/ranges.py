"""Changed line ranges: parsing diff text and the overlap test against findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.lookup import spread_join

# Lines per bucket: ranges and findings meet in the buckets they touch, so a file with many of
# both is spread over many join keys and no file's pairs are enumerated.
BUCKET_LINES = 64

# fixed value: the header of a hunk
HUNK = r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@"


def parse_hunks(lines: DataFrame, text: str = "text", group=("diff",), order: str = "line_no") -> DataFrame:
    """Diff lines to ``(file, start, end)`` of the new side.

    The path of the last ``+++ b/`` line is carried forward to its hunks; a hunk that only
    deletes has no lines of its own and yields nothing.
    """
    path = F.when(F.startswith(F.col(text), F.lit("+++ b/")), F.substring(F.col(text), 7, 1 << 30))
    so_far = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    wanted = lines.where(F.startswith(F.col(text), F.lit("+++ b/")) | F.startswith(F.col(text), F.lit("@@")))
    filled = wanted.withColumn("file", F.last(path, ignorenulls=True).over(so_far)).where(
        F.col("file").isNotNull() & (F.regexp_extract(text, HUNK, 1) != ""))
    count = F.regexp_extract(text, HUNK, 2)
    return filled.select(
        *group, "file", F.regexp_extract(text, HUNK, 1).cast("int").alias("start"),
        F.when(count == "", 1).otherwise(count.cast("int")).alias("n"),
    ).where("n > 0").select(*group, "file", "start", (F.col("start") + F.col("n") - 1).alias("end"))


def _buckets(start: Column, end: Column) -> Column:
    return F.sequence(F.floor(start / BUCKET_LINES), F.floor(end / BUCKET_LINES))


def in_scope(findings: DataFrame, ranges: DataFrame, *, line: str = "line", end: str = "end_line",
             key=("file", "ord")) -> DataFrame:
    """Findings that touch a range of their file; a file without ranges is wholly in scope.

    ``key`` names the columns that identify a finding within the input.
    """
    scoped = ranges.select("file").distinct()
    whole = spread_join(findings, scoped, "file", key, "left_anti")
    # cut to their buckets, ranges are at most all pairs of a bucket's lines
    first, final = F.col("_bucket") * BUCKET_LINES, F.col("_bucket") * BUCKET_LINES + BUCKET_LINES - 1
    spread = ranges.select("file", "start", "end", F.explode(_buckets(F.col("start"), F.col("end"))).alias("_bucket")).select(
        "file", "_bucket", F.greatest("start", first).alias("_rs"), F.least("end", final).alias("_re")).distinct()
    touched = (F.col(line) <= F.col("_re")) & (F.col(end) >= F.col("_rs"))

    def meet(rows, bucket):
        right = spread.withColumnRenamed("file", "_file")
        return rows.withColumn("_b", bucket).join(
            right, (F.col("file") == F.col("_file")) & (F.col("_b") == F.col("_bucket")) & touched, "left_semi").drop("_b")

    # nearly every comment stays in one bucket; the few that cross are met in each and deduplicated
    crosses = F.floor(F.col(line) / BUCKET_LINES) != F.floor(F.col(end) / BUCKET_LINES)
    within = meet(findings.where(~crosses), F.floor(F.col(line) / BUCKET_LINES))
    across = meet(findings.where(crosses), F.explode(_buckets(F.col(line), F.col(end)))).dropDuplicates(list(key))
    return whole.unionByName(within).unionByName(across)
