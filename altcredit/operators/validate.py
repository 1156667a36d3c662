"""Normalization and row-level validation of one feed, as one narrow projection.

Rows are never dropped here: each carries ``blocking`` and ``warnings`` message arrays, and the
loaded rows, the error rows and the load counts are all derived from the same frame.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altcredit.functions import wording as wd
from altcredit.operators.registry import BLOCKING, FEEDS, WARNING, FeedSpec

EMPTY = "cast(array() as array<string>)"
#: Largest amount of one row. A customer has at most 1212 monthly or 36 890 daily rows, so sums stay
#: below 3.7e17, sums times positions below 7.4e18 and sums of squares below 3.7e30: all fit.
MOST_PAISE = 10**13
DAMAGED = f"{wd.TRANSFORM_FAILED}damaged record"
UNREADABLE = "UNREADABLE"
NOT_JSON = "not a JSON array of records"
ORPHAN = "violates constraint: customer_id references customers"


def _messages(rules: list[tuple[str, Column, Column]], severity: str) -> Column:
    """Messages of the violated rules, in rule order; rows without a violation stop at the test."""
    chosen = [(when, text) for level, when, text in rules if level == severity]
    if not chosen:
        return F.expr(EMPTY)
    violated = reduce(lambda a, b: a | b, [when for when, _ in chosen])
    hits = F.array(*[F.when(when, text) for when, text in chosen])
    return F.when(violated, F.array_compact(hits)).otherwise(F.expr(EMPTY))


def normalize(raw: DataFrame, spec: FeedSpec, passthrough: tuple[str, ...] = ()) -> DataFrame:
    """Typed columns of one feed plus ``problem``: why the record cannot be converted, or NULL.

    Only the first failing field is named. Raw fields not in the spec are projected away, and a
    field that the frame lacks altogether counts as missing.
    """
    absent = F.lit(None).cast("string")
    given = {f.raw: F.col(f.raw) if f.raw in raw.columns else absent for f in spec.fields}
    typed = raw.select(
        *passthrough,
        *[f.clean(given[f.raw], f.raw)[0].alias(f.name) for f in spec.fields],
        *[column.alias(f"_raw_{name}") for name, column in given.items()],
    )
    problems = [
        F.when(F.col(f.name).isNull(), f.clean(F.col(f"_raw_{f.raw}"), f.raw)[1])
        for f in spec.fields
    ]
    return typed.select(
        *passthrough,
        *spec.columns,
        F.coalesce(*problems).alias("problem"),
        F.col("_raw_customer_id").alias("raw_customer_id"),
    )


def validate(normalized: DataFrame, spec: FeedSpec, as_of: date) -> DataFrame:
    """Adds ``record_id``, ``blocking`` and ``warnings`` to a normalized feed."""
    rules = spec.rules(F.lit(as_of))
    rules += [
        (BLOCKING, F.length(name) > size, F.lit(f"violates constraint: {name} within {size} chars"))
        for name, size in spec.limits
    ]
    rules += [
        (BLOCKING, ~F.col(f.name).between(-MOST_PAISE, MOST_PAISE), F.lit(f"violates constraint: {f.name} within {MOST_PAISE}"))
        for f in spec.fields
        if f.name.endswith("_paise")
    ]
    failed = F.col("problem").isNotNull()
    kept = [c for c in normalized.columns if c not in ("problem", "raw_customer_id")]
    return normalized.select(
        *kept,
        F.when(failed, F.coalesce("raw_customer_id", F.lit(wd.UNKNOWN_ID)))
        .otherwise(spec.record_id())
        .alias("record_id"),
        F.when(failed, F.array(F.concat(F.lit(wd.TRANSFORM_FAILED), "problem")))
        .otherwise(_messages(rules, BLOCKING))
        .alias("blocking"),
        F.when(failed, F.expr(EMPTY)).otherwise(_messages(rules, WARNING)).alias("warnings"),
    )


def check_feed(
    raw: DataFrame, table: str, as_of: date, passthrough: tuple[str, ...] = ()
) -> DataFrame:
    """Normalize and validate one registered feed."""
    spec = FEEDS[table]
    return validate(normalize(raw, spec, passthrough), spec, as_of)


def check_feeds(rows: DataFrame, tables: tuple[str, ...], as_of: date) -> DataFrame:
    """Checks of several feeds whose raw fields lie side by side, in a struct for each: one scan for all.

    Gives ``table_name``, ``record_id``, ``blocking`` and ``warnings``, a row for each feed of each row.
    """
    for i, table in enumerate(tables):
        rest = (*tables[:i], *tables[i + 1 :])
        checked = check_feed(rows.select(*rest, f"{table}.*"), table, as_of, passthrough=rest)
        found = F.struct(F.lit(table).alias("table_name"), "record_id", "blocking", "warnings")
        rows = checked.select(*rest, found.alias(table))
    return rows.select(F.explode(F.array(*tables)).alias("_found")).select("_found.*")


def block_orphans(checked: DataFrame, customers: DataFrame) -> DataFrame:
    """Marks rows whose customer is unknown as blocking.

    The customer side is unique on the key, so a hot customer only makes the feed side uneven;
    callers write the result out directly, which lets the adaptive skew join split it.
    """
    known = customers.select("customer_id", F.lit(True).alias("_known"))
    hit = F.array_append("blocking", F.lit(ORPHAN))
    unknown = F.col("_known").isNull() & (F.size("blocking") == 0)
    return (
        checked.join(known, "customer_id", "left")
        .withColumn("blocking", F.when(unknown, hit).otherwise(F.col("blocking")))
        .drop("_known")
    )


def block_damaged(checked: DataFrame) -> DataFrame:
    """Marks records that could not be parsed (``corrupt``) as blocking, with that as the only reason."""
    corrupt = F.col("corrupt")
    return checked.withColumns(
        {
            "record_id": F.when(corrupt, F.lit(wd.UNKNOWN_ID)).otherwise(F.col("record_id")),
            "blocking": F.when(corrupt, F.array(F.lit(DAMAGED))).otherwise(F.col("blocking")),
            "warnings": F.when(corrupt, F.expr(EMPTY)).otherwise(F.col("warnings")),
        }
    )


def whole_files(checked: DataFrame) -> DataFrame:
    """Of files that hold a damaged record, only the damaged ones: such a file can't be read as a whole."""
    damaged = checked.filter("corrupt").select("source_path").distinct()
    good = checked.filter(~F.col("corrupt")).join(damaged, "source_path", "left_anti")
    return good.unionByName(checked.filter("corrupt"))


def accepted(checked: DataFrame) -> DataFrame:
    """Rows without a blocking message.

    The test is a generator of one row or none over ``blocking`` alone: a filter would be pushed below
    the cleaning expressions and evaluate them a second time. Unused columns are pruned as ever.
    """
    passes = F.when(F.size("blocking") == 0, F.array(F.lit(True)))
    return checked.select("*", F.explode(passes).alias("_passes")).drop("_passes")


def orphans(child: DataFrame, customers: DataFrame) -> DataFrame:
    """Unknown customer ids of a child table with the number of rows each has.

    Counted per id first, so the anti-join sees one row per id however often it occurs.
    """
    per_id = child.groupBy("customer_id").agg(F.count(F.lit(1)).alias("row_count"))
    return per_id.join(customers.select("customer_id"), "customer_id", "left_anti")


def duplicate_keys(table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Natural keys that occur more than once."""
    counted = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.filter(F.col("row_count") > 1)


def error_rows(checked: DataFrame, table: str | Column, source_file: Column | None = None) -> DataFrame:
    """One row per (record, reason): a record's warnings first, then its blocking reasons."""
    source = source_file if source_file is not None else F.col("source_file")
    return checked.select(
        source.alias("source_file"),
        (F.lit(table) if isinstance(table, str) else table).alias("table_name"),
        F.col("record_id").alias("record_identifier"),
        F.posexplode(F.concat("warnings", "blocking")).alias("position", "error_reason"),
    )


def issue_lines() -> Column:
    """``record_id: reason`` lines; blocking reasons first, warnings marked as such."""
    marked = F.transform("warnings", lambda w: F.concat(w, F.lit(wd.WARNING_SUFFIX)))
    return F.transform(
        F.concat("blocking", marked), lambda reason: F.concat_ws(": ", "record_id", reason)
    )


def dry_run_issues(checked: DataFrame, table: str | Column) -> DataFrame:
    name = F.lit(table) if isinstance(table, str) else table
    return checked.select(name.alias("table_name"), F.explode(issue_lines()).alias("issue"))


def load_counts(
    checked: DataFrame, by: tuple[str, ...] = ("source_file",), *more: Column
) -> DataFrame:
    """Attempted, loaded and skipped records per source file."""
    ok = F.size("blocking") == 0
    return checked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(ok).alias("loaded"),
        F.count_if(~ok).alias("skipped"),
        *more,
    )


def file_results(
    checked: DataFrame, by: tuple[str, ...], whole_files: bool, files: DataFrame | None = None
) -> DataFrame:
    """Counts, status and message per file; damaged records count as attempted and skipped.

    With ``whole_files`` (JSON arrays) a file of which nothing could be parsed is unreadable and has
    no records. ``files`` adds the files without records, which succeed with 0.
    """
    counted = load_counts(
        checked, by, F.count_if("corrupt").alias("_damaged"), F.count_if(~F.col("corrupt")).alias("_parsed")
    )
    if files is not None:
        counted = files.join(counted, list(by), "left").fillna(0)
    unreadable = F.lit(whole_files) & (F.col("_damaged") > 0) & (F.col("_parsed") == 0)
    counted = counted.withColumn("_unreadable", unreadable)
    for name in ("attempted", "skipped"):
        counted = counted.withColumn(name, F.when(F.col("_unreadable"), F.lit(0)).otherwise(F.col(name)))
    return load_status(counted).select(
        *by,
        "attempted",
        "loaded",
        "skipped",
        F.when(F.col("_unreadable"), F.lit(UNREADABLE)).otherwise(F.col("status")).alias("status"),
        F.when(F.col("_unreadable"), F.lit(NOT_JSON)).otherwise(F.col("error_message")).alias("error_message"),
    )


def load_status(counts: DataFrame) -> DataFrame:
    """Adds ``status`` and ``error_message`` to load counts."""
    skipped, loaded = F.col("skipped"), F.col("loaded")
    return counts.withColumn(
        "status",
        F.when(skipped == 0, F.lit(wd.SUCCESS))
        .when(loaded > 0, F.lit(wd.PARTIAL))
        .otherwise(F.lit(wd.FAILED)),
    ).withColumn(
        "error_message",
        F.when(skipped > 0, F.format_string(wd.FAILED_RECORDS, skipped)),
    )
