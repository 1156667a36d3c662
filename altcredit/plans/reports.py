"""Scoring and reporting jobs over the stored tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from altcredit.functions.times import instant
from altcredit.operators import listing, report, series
from altcredit.operators import partials as pt
from altcredit.operators import summaries as sm
from altcredit.plans import scorecard as sc
from altcredit.schemas import SCORECARD
from altcredit.sources import sums
from altcredit.sources.store import DOCUMENT_KEYS, TableStore, of_customers

METHOD = "fallback"
_CORRUPT = "_corrupt"
_KEEP_NULLS = {"ignoreNullFields": "false"}


_OPTIONAL = ("aa_ratios", "epfo_ratios")


def scorecard_json(columns: list[str]) -> Column:
    """A scorecard document as JSON text; an absent source is an empty object."""
    parts = []
    for name in columns:
        text = F.to_json(F.struct(F.col(name)), _KEEP_NULLS)
        if name in _OPTIONAL:
            text = F.when(F.col(name).isNull(), F.lit(f'{{"{name}":{{}}}}')).otherwise(text)
        # Each part is an object of one field: its braces go, the fields come together.
        parts.append(F.substring(text, F.lit(2), F.char_length(text) - 2))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def decode_scorecards(stored: DataFrame) -> DataFrame:
    """Stored scorecards as documents under their stored keys; one that can't be decoded has no fields."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    schema = T.StructType([*SCORECARD.fields, T.StructField(_CORRUPT, T.StringType())])
    keys = [F.col(k).alias(f"_{k}") for k in DOCUMENT_KEYS]
    # A generator of one row: each text is parsed once, whatever is read of it.
    parsed = stored.select(*keys, F.inline_outer(F.array(F.from_json("scorecard_json", schema, options))))
    whole = F.col(_CORRUPT).isNull()
    fields = {f.name: F.when(whole, F.col(f.name)) for f in SCORECARD.fields} | {
        k: F.col(f"_{k}") for k in DOCUMENT_KEYS
    }
    return parsed.select(*[fields[n].alias(n) for n in SCORECARD.names])


def run_analytics(
    store: TableStore,
    as_of: date,
    run_ts: datetime,
    run_id: str,
    requested: DataFrame | None = None,
) -> DataFrame | None:
    """Scores the requested customers, or all, and merges their scorecards into the store.

    Those of requested customers are added beside the table until the next fold. Without ``requested`` all customers are scored, with an empty frame none. Returns the requested
    ids that do not exist, if ids were requested.
    """
    store.create_tables()
    if requested is not None:
        # Used for the customers and each feed: worked out once.
        path = store.fresh_path("requested")
        requested.select("customer_id").distinct().write.parquet(path)
        requested = store.spark.read.schema("customer_id string").parquet(path)
    customers, unknown = sc.select_customers(store.read("customers"), requested)
    feeds = [store.read(t) for t in ("gst_filings", "upi_transactions", "bank_statements", "epfo_payroll")]
    batch = _card_rows(sc.scorecards(customers, *sc.only_requested(feeds, requested), as_of))
    if requested is None:
        store.upsert(batch, "scorecards", run_ts)
    else:
        store.add(batch, "scorecards", run_ts)
    return unknown


def _card_rows(cards: DataFrame) -> DataFrame:
    """Scorecard documents as they are stored."""
    return cards.select(
        "customer_id",
        "scorecard_date",
        scorecard_json(cards.columns).alias("scorecard_json"),
        "composite_score",
    )


def run_incremental(store: TableStore, as_of: date, run_ts: datetime) -> None:
    """Scores the customers whose data changed since the last such run, from their block sums.

    No feed is read, and of the sums only the rows of those customers. Customers whose data did not
    change keep their last scorecard. The changes count as dealt with once the scorecards are stored:
    a run that dies before is repeated by the next.
    """
    store.create_tables()
    ids, places = sums.changed(store)
    if not places:
        return
    customers = of_customers(store.read("customers"), ids)
    parts = [pt.merged_sums(of_customers(sums.read(store, table), ids)) for table in pt.SUMMED]
    store.add(_card_rows(sc.scorecards_of_sums(customers, parts, as_of)), "scorecards", run_ts)
    sums.scored(store, places)


def latest_scorecards(store: TableStore) -> DataFrame:
    """Each customer's most recent scorecard document."""
    newest = listing.latest_per_customer(store.read("scorecards"), ["scorecard_date"], "scorecard_json")
    return decode_scorecards(newest)


def build_reports(
    cards: DataFrame,
    customers: DataFrame,
    gst: DataFrame,
    upi: DataFrame,
    epfo: DataFrame,
    run_ts: datetime,
) -> DataFrame:
    """Report documents of the given scorecards, one job for all."""
    lacking = sc.missing_fields(cards)
    if lacking:
        raise ValueError(f"Scorecard is missing required field(s): {lacking}")
    flat = report.with_customer(
        sc.flatten(cards), customers, sm.summarize_monthly(gst, [sm.GST])
    )
    for points in series.chart_inputs(gst, upi, epfo):
        flat = flat.join(points, "customer_id", "left")
    told = report.audit_trail(
        report.facts(
            flat, F.col("scorecard_date").alias("_date"), series.chart_configs().alias("chart_configs")
        )
    )
    audit = ("scorecard_date", "data_sources_used", "ratios_cited", "total_claims")
    document = F.struct(
        "customer_id",
        F.col("customer_name").alias("business_name"),
        "sector",
        F.lit(run_ts.isoformat()).alias("generated_at"),
        F.lit(METHOD).alias("generation_method"),
        F.struct(*report.NARRATIVE).alias("narrative"),
        "chart_configs",
        F.struct(*audit).alias("audit_trail"),
    )
    return told.select(
        "customer_id",
        F.col("_date").alias("scorecard_date"),
        F.to_json(document, _KEEP_NULLS).alias("report_json"),
        F.lit(METHOD).alias("generation_method"),
        instant(run_ts).alias("generated_at"),
    )


def generate_reports(store: TableStore, run_ts: datetime, run_id: str) -> DataFrame:
    """Writes a report for the latest scorecard of every customer.

    A scorecard that can't be decoded, or lacks a value that is never NULL, gets no report. Returns those
    scorecards with the names of the fields that they lack, from a table of their own.
    """
    store.create_tables()
    cards = latest_scorecards(store)
    refused = store.fresh_path("refused_scorecards")
    sc.incomplete(cards).write.parquet(refused)
    reports = build_reports(
        sc.complete(cards),
        store.read("customers"),
        store.read("gst_filings"),
        store.read("upi_transactions"),
        store.read("epfo_payroll"),
        run_ts,
    )
    store.upsert(reports, "ai_reports", run_ts)
    return store.spark.read.parquet(refused)


def export_documents(stored: DataFrame, column: str, path: str) -> None:
    """Stored JSON documents as text files, one document per line, one folder per date.

    Replaces the folders of the dates exported and leaves those of other dates.
    """
    lines = stored.select("scorecard_date", F.col(column).alias("value"))
    writer = lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("scorecard_date").text(path)
