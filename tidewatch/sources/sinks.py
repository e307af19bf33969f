"""Writes: insert-if-absent, upsert, retention, soft delete, reports.

Plain Parquet has no in-place update: row updates produce the next version of the table,
appends write only new rows.  Versions are written to a new folder, so a lost executor
or a failed job leaves the current version intact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.operators.reports import before
from tidewatch.operators.temporal import first_k


def absent_rows(incoming: DataFrame, target: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows whose natural key is not in the target, one per key."""
    return first_k(incoming, list(keys), list(order), 1).join(target.select(*keys), list(keys), "left_anti")


def insert_if_absent(incoming: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column], partition: str | None = None) -> None:
    """Append new keys to a Parquet table; safe to repeat with the same input."""
    spark = incoming.sparkSession
    try:
        rows = absent_rows(incoming, spark.read.parquet(path), keys, order)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = first_k(incoming, list(keys), list(order), 1)
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def touch_present(target: DataFrame, incoming: DataFrame, keys: Sequence[str], column: str, now: Column) -> DataFrame:
    """Set ``column`` on the rows that came again."""
    seen = incoming.select(*keys).distinct().withColumn("__seen", F.lit(True))
    return target.join(seen, list(keys), "left").withColumn(column, F.when(F.col("__seen"), now).otherwise(F.col(column))).drop("__seen")


def upsert(target: DataFrame, incoming: DataFrame, keys: Sequence[str], update: Sequence[str], insert_defaults: dict[str, Column]) -> DataFrame:
    """Next version: listed columns updated, the others kept; new keys take the defaults."""
    keys = list(keys)
    new = incoming.select(*keys, *[F.col(c).alias(f"__{c}") for c in update], F.lit(True).alias("__in"))
    old = target.withColumn("__old", F.lit(True))
    out = old.join(new, keys, "full")
    cols = []
    for c in target.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in update:
            cols.append(F.when(F.col("__in"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.when(F.col("__old"), F.col(c)).otherwise(insert_defaults.get(c, F.lit(None))).alias(c))
    return out.select(*cols)


def backfill_plan(trades: DataFrame, plan_accessions: DataFrame) -> DataFrame:
    """Set the plan flag for listed accessions where it is not yet true."""
    listed = plan_accessions.select(F.col("accession").alias("__acc")).distinct().withColumn("__plan", F.lit(True))
    base = F.split_part("accession_number", F.lit("_"), F.lit(1))
    rows = trades.join(listed, base == F.col("__acc"), "left")
    hit = F.coalesce("__plan", F.lit(False)) & ~F.col("is_plan").eqNullSafe(F.lit(True))
    return rows.withColumn("updated", hit).withColumn("is_plan", F.when(hit, True).otherwise(F.col("is_plan"))).drop("__acc", "__plan")


def _tier() -> Column:
    return F.when(F.col("level") == "debug", "debug").when(F.col("level").isin("warn", "error"), "warn_error").when(
        F.col("level").isNull() | (F.col("level") == "info"), "info"
    )


def _expired(as_of: Column, days: dict[str, int]) -> Column:
    out = F.lit(False)
    for tier, d in days.items():
        out = out | ((F.col("__tier") == tier) & (F.col("created_at") < before(as_of, days=d)))
    return F.coalesce(out, F.lit(False))


RETENTION_DAYS = {"debug": 2, "info": 7, "warn_error": 30}


def retained_logs(logs: DataFrame, as_of: Column, days: dict[str, int] = RETENTION_DAYS) -> DataFrame:
    return logs.withColumn("__tier", _tier()).filter(~_expired(as_of, days)).drop("__tier")


def expired_counts(logs: DataFrame, as_of: Column, days: dict[str, int] = RETENTION_DAYS) -> DataFrame:
    rows = logs.withColumn("__tier", _tier()).filter(_expired(as_of, days))
    return rows.groupBy(F.col("__tier").alias("tier")).agg(F.count("*").alias("deleted"))


def archive(alerts: DataFrame, ids: DataFrame | None = None, older_than: Column | None = None) -> DataFrame:
    """Soft delete by id list or by age; ``affected`` marks the changed rows."""
    if ids is not None:
        marked = ids.select("id").distinct().withColumn("__hit", F.lit(True))
        rows = alerts.join(marked, "id", "left").withColumn("affected", F.coalesce("__hit", F.lit(False))).drop("__hit")
    else:
        rows = alerts.withColumn("affected", (F.col("sent_at") < older_than) & ~F.col("archived"))
    return rows.withColumn("archived", F.col("archived") | F.col("affected"))


def backfill_selection(filings: DataFrame, limit: int = 50) -> DataFrame:
    """Newest 8-K filings without an analysis."""
    return filings.filter((F.col("form_type") == "8-K") & ~F.col("analyzed")).orderBy(F.desc("filing_date"), F.desc("accession")).limit(limit)


def reset_analysis(filings: DataFrame, accession: str) -> tuple[DataFrame, DataFrame]:
    """Next version without the analysis of one filing, and the event to emit again."""
    hit = F.col("accession") == accession
    table = filings.withColumn("analyzed", F.when(hit, False).otherwise(F.col("analyzed"))).withColumn(
        "direction", F.when(~hit, F.col("direction"))
    )
    return table, filings.filter(hit).select("accession", "symbol", "form_type")


# Significance markers of the report.
def significance(p: Column, bonferroni: Column) -> Column:
    return F.when(bonferroni, "✓✓✓").when(p < 0.01, "✓✓").when(p < 0.05, "✓").otherwise("")


def report_table(results: DataFrame, horizons: Sequence[str] = ("1d", "3d", "7d", "30d")) -> DataFrame:
    """Wide report: one row per group, a text cell per horizon."""
    num = lambda c, digits: F.format_string(f"%+.{digits}f", F.col(c))
    cell = F.concat_ws(
        " ", F.concat(F.lit("N="), F.col("n").cast("string")), F.concat(num("avg_return_pct", 2), F.lit("%")),
        F.concat(F.lit("d="), num("effect_size_d", 2)), significance(F.col("p_value"), F.coalesce("significant_bonferroni", F.lit(False))),
    )
    return results.withColumn("cell", F.trim(cell)).groupBy("sub_group", "direction").pivot("horizon", list(horizons)).agg(F.first("cell"))


def markdown_lines(report: DataFrame, horizons: Sequence[str] = ("1d", "3d", "7d", "30d")) -> DataFrame:
    cells = [F.coalesce(F.col(f"`{h}`"), F.lit("—")) for h in horizons]
    return report.select(F.concat(F.lit("| "), F.concat_ws(" | ", "sub_group", *cells), F.lit(" |")).alias("value"))


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
