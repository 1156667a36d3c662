"""Registered queries: each runs an operator over the whole benchmark tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from altcredit.functions import numeric as nm
from altcredit.functions.bands import band
from altcredit.functions.times import instant
from altcredit.operators import listing, ratios, report, scoring, series, upsert
from altcredit.operators import partials as pt
from altcredit.operators import summaries as sm
from altcredit.operators import validate as vd
from altcredit.operators.registry import FEEDS
from altcredit.plans import reports
from altcredit.plans import scorecard as sc
from altcredit.session import tune
from altcredit.sources import feeds
from altcredit.checks import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RUN_TS = datetime(2025, 1, 1, 6, 0, 0)
EARLIER_TS = datetime(2024, 12, 1, 6, 0, 0)


def register(name: str, fn: Query) -> None:
    QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)


def query(fn: Query) -> Query:
    register(fn.__name__, fn)
    return fn


def _summaries(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    months = v.monthly_activity(spark, sf_dir)
    return [
        sm.summarize_monthly(months, [sm.GST, sm.BANK, sm.EPFO]),
        sm.summarize_upi(v.upi_transactions(spark, sf_dir)),
    ]


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.customers(spark, sf_dir).withColumn("scorecard_date", F.lit(v.AS_OF))


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.combine(_base(spark, sf_dir), _summaries(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.score(_sums(spark, sf_dir))


def _card_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat scorecards of every customer on every card date, from one scan of each source."""
    keys = ("customer_id", "scorecard_date")
    dates = F.explode(F.array(*[F.lit(d) for d in v.CARD_DATES])).alias("scorecard_date")
    base = v.customer_keys(spark, sf_dir).select("customer_id", dates)
    sums = [
        sm.summarize_monthly(v.months_by_card(spark, sf_dir), [sm.GST, sm.BANK, sm.EPFO], keys),
        sm.summarize_upi(v.upi_by_card(spark, sf_dir), keys),
    ]
    return sc.score(sc.combine(base, sums, keys))


def _joined(name: str) -> Column:
    return F.array_join(name, " | ").alias(name)


# --- ratios -------------------------------------------------------------------------------


def _gst_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.summarize_monthly(v.gst_filings(spark, sf_dir), [sm.GST])


@query
def gst_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ratios.gst_ratios(_gst_sums(spark, sf_dir))
    return rows.select("customer_id", *sc.flat_columns("gst_ratios"))


@query
def gst_mom(spark: SparkSession, sf_dir: str) -> DataFrame:
    growth = nm.change(F.col("gst_previous"), F.col("gst_last"))
    return _gst_sums(spark, sf_dir).select(
        "customer_id",
        F.col("gst_previous").alias("previous_paise"),
        F.col("gst_last").alias("last_paise"),
        nm.percent(growth).alias("mom_growth_percent"),
    )


@query
def sales_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, total = F.col("gst_n"), F.col("gst_sum")
    cv = nm.coefficient_of_variation(n, total, F.col("gst_sq"))
    return _gst_sums(spark, sf_dir).select(
        "customer_id",
        n.alias("months"),
        nm.rnd(nm.mean_rupees(total, n), 2).alias("mean_sales"),
        nm.percent(cv).alias("cv_percent"),
    )


@query
def upi_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ratios.upi_ratios(sm.summarize_upi(v.upi_transactions(spark, sf_dir)))
    return rows.select("customer_id", *sc.flat_columns("upi_ratios"))


@query
def weekend_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.summarize_upi(v.upi_transactions(spark, sf_dir)).select(
        "customer_id",
        F.col("upi_weekend_n").alias("weekend_days"),
        F.col("upi_weekend").alias("weekend_paise"),
        (F.col("upi_n") - F.col("upi_weekend_n")).alias("weekday_days"),
        ratios.weekend_weekday_ratio().alias("weekend_weekday_ratio"),
    )


@query
def aa_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = sm.summarize_monthly(v.bank_statements(spark, sf_dir), [sm.BANK])
    return ratios.aa_ratios(sums).select("customer_id", *sc.flat_columns("aa_ratios"))


@query
def credit_trend_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = sm.summarize_monthly(v.bank_statements(spark, sf_dir), [sm.BANK])
    return sums.select(
        "customer_id", F.col("bank_n").alias("months"), ratios.credit_slope().alias("slope")
    )


@query
def epfo_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = sm.summarize_monthly(v.epfo_payroll(spark, sf_dir), [sm.EPFO])
    return ratios.epfo_ratios(sums).select("customer_id", *sc.flat_columns("epfo_ratios"))


# --- reconciliation and scoring -----------------------------------------------------------


@query
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ratios.cross_validation(_sums(spark, sf_dir))
    return rows.select("customer_id", *sc.flat_columns("cross_validation"))


@query
def growth_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(spark, sf_dir).select(
        "customer_id",
        F.coalesce("gst_n", F.lit(0)).alias("gst_months"),
        F.coalesce("epfo_n", F.lit(0)).alias("epfo_months"),
        ratios.growth_alignment().alias("alignment"),
    )


@query
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("customer_id", *scoring.band_columns())


@query
def dimension_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("customer_id", *sc.flat_columns("dimension_scores"))


@query
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(
        "customer_id",
        "composite_score",
        "score_interpretation",
        band("gauge", F.col("composite_score")).alias("band"),
    )


@query
def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(
        "customer_id",
        _joined("red_flags"),
        _joined("green_flags"),
        report.mismatch_lines().alias("cross_validation_flags"),
    )


def _flat_card(scored: DataFrame) -> DataFrame:
    parts = [
        column
        for part in (
            "gst_ratios",
            "upi_ratios",
            "aa_ratios",
            "epfo_ratios",
            "cross_validation",
            "dimension_scores",
        )
        for column in sc.flat_columns(part)
    ]
    return scored.select(
        "customer_id",
        "scorecard_date",
        *parts,
        "composite_score",
        "score_interpretation",
        _joined("red_flags"),
        _joined("green_flags"),
    )


@query
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_card(sc.flatten(sc.documents(_scored(spark, sf_dir))))


@query
def incremental_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorecards from block sums of an earlier state, brought up to date by a load of late months.

    The earlier state lacks every fifth month and has other amounts in every seventh; the blocks that
    hold those months are summed again, the others are merged as they were.
    """
    months, days = v.monthly_activity(spark, sf_dir), v.upi_transactions(spark, sf_dir)
    period = F.col("year") * 12 + F.col("month")
    late, corrected = (v.key() + period) % 5 == 0, (v.key() + period) % 7 == 0
    sums = [_late_months(months, late, corrected), _late_days(days)]
    return _flat_card(sc.flatten(sc.documents(sc.score(sc.combine(_base(spark, sf_dir), sums)))))


def _late_months(months: DataFrame, late: Column, corrected: Column) -> DataFrame:
    sources = [sm.GST, sm.BANK, sm.EPFO]

    def blocks(rows: DataFrame) -> DataFrame:
        return sm.summarize_monthly(rows.withColumn(pt.BLOCK, F.col("year")), sources, pt.BLOCK_KEYS)

    wrong = {c: F.when(corrected, F.col(c) + 100).otherwise(F.col(c)) for c in ("gstr_sales_paise", "total_credits_paise")}
    touched = months.filter(late | corrected).select("customer_id", F.col("year").alias(pt.BLOCK)).distinct()
    fresh = blocks(months).join(touched, list(pt.BLOCK_KEYS), "left_semi")
    return pt.merged_sums(pt.replaced(blocks(months.filter(~late).withColumns(wrong)), fresh, touched))


def _late_days(days: DataFrame) -> DataFrame:
    late = F.dayofyear("txn_date") % 50 == 0
    touched = days.filter(late).select("customer_id", pt.block_of(pt.DAILY).alias(pt.BLOCK)).distinct()
    fresh = pt.block_sums(days, pt.DAILY).join(touched, list(pt.BLOCK_KEYS), "left_semi")
    return pt.merged_sums(pt.replaced(pt.block_sums(days.filter(~late), pt.DAILY), fresh, touched))


def _stored_cards(scored: DataFrame) -> DataFrame:
    cards = sc.documents(scored)
    return cards.select(
        "customer_id",
        "scorecard_date",
        reports.scorecard_json(cards.columns).alias("scorecard_json"),
        "composite_score",
    )


@query
def stored_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorecards written as JSON text and decoded again."""
    decoded = reports.decode_scorecards(_stored_cards(_scored(spark, sf_dir)))
    return _flat_card(sc.flatten(decoded))


@query
def incomplete_scorecards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored scorecards, some of them cut off, that can't be reported on."""
    half = F.substring("scorecard_json", F.lit(1), F.expr("char_length(scorecard_json) div 2").cast("int"))
    text = F.when(v.key() % 17 == 0, half).otherwise(F.col("scorecard_json"))
    stored = _stored_cards(_scored(spark, sf_dir)).withColumn("scorecard_json", text)
    lacking = sc.incomplete(reports.decode_scorecards(stored))
    return lacking.withColumn("missing", F.array_join("missing", ", "))


@query
def requested_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the customers asked for (all with UPI rows), and the ids nobody knows."""
    wanted = v.upi_transactions(spark, sf_dir)
    chosen, unknown = sc.select_customers(v.registered_customers(spark, sf_dir), wanted)
    months, days = sc.only_requested(
        [v.monthly_activity(spark, sf_dir), v.upi_transactions(spark, sf_dir)], wanted
    )
    sums = [sm.summarize_monthly(months, [sm.GST, sm.BANK, sm.EPFO]), sm.summarize_upi(days)]
    scored = sc.score(sc.combine(chosen, sums))
    return scored.select("customer_id", "composite_score").unionByName(
        unknown, allowMissingColumns=True
    )


# --- ingest -------------------------------------------------------------------------------


def _checked(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return vd.check_feed(v.RAW[table](spark, sf_dir), table, v.AS_OF)


def _normalized(table: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vd.accepted(_checked(spark, sf_dir, table))
        kept = ["record_id", *FEEDS[table].columns]
        if table == "bank_statements":
            rows = rows.withColumn("dscr", F.col("dscr").cast("decimal(8,2)").cast("double"))
        return rows.select(*kept)

    return run


for _table in FEEDS:
    register(f"normalize_{_table}", _normalized(_table))


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


#: Feeds that come from the same source table are checked in one scan of it.
LINE_FEEDS = ("bank_statements", "epfo_payroll")


def _all_checked(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The checks of all feeds, each row with its ``table_name``."""
    single = [_checked(spark, sf_dir, t).select(F.lit(t).alias("table_name"), "record_id", "blocking", "warnings") for t in FEEDS if t not in LINE_FEEDS]
    return [*single, vd.check_feeds(v.raw_line_feeds(spark, sf_dir), LINE_FEEDS, v.AS_OF)]


def _feed_file() -> Column:
    return F.concat("table_name", F.lit(".json"))


@query
def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vd.error_rows(_union(_all_checked(spark, sf_dir)), F.col("table_name"), _feed_file())


@query
def dry_run_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vd.dry_run_issues(_union(_all_checked(spark, sf_dir)), F.col("table_name"))


@query
def load_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [checked.select("table_name", "blocking") for checked in _all_checked(spark, sf_dir)]
    rows = _union(parts).withColumn("source_file", _feed_file())
    return vd.load_status(vd.load_counts(rows, ("table_name", "source_file")))


CHILD_TABLES = {
    "gst_filings": v.gst_filings,
    "upi_transactions": v.upi_transactions,
    "bank_statements": v.bank_statements,
    "epfo_payroll": v.epfo_payroll,
}


def _parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.parsed_lines(v.feed_lines(spark, sf_dir), FEEDS["gst_filings"])


@query
def parsed_feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of JSON lines, damaged ones included."""
    rows = _parsed_lines(spark, sf_dir)
    return rows.select("order_key", "source_file", "corrupt", "customer_id", "month", "year", "gstr_sales")


@query
def file_load_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and status of the files that hold those lines."""
    checked = vd.check_feed(_parsed_lines(spark, sf_dir), "gst_filings", v.AS_OF, ("source_file", "corrupt"))
    return vd.file_results(vd.block_damaged(checked), ("source_file",), whole_files=False)


@query
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = v.registered_customers(spark, sf_dir)
    return _union(
        [
            vd.orphans(rows(spark, sf_dir), known).withColumn("table_name", F.lit(name))
            for name, rows in CHILD_TABLES.items()
        ]
    )


@query
def blocked_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rows of the child feeds when loaded against an incomplete customer master."""
    known = v.registered_customers(spark, sf_dir)
    parts = []
    for name in CHILD_TABLES:
        flagged = vd.block_orphans(_checked(spark, sf_dir, name), known)
        parts.append(vd.error_rows(flagged, name, F.lit(f"{name}.json")))
    return _union(parts)


def _with_copies(rows: DataFrame) -> DataFrame:
    """Even months twice, as deliveries 1 and 2."""
    copies = F.when(F.col("month") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("*", F.explode(copies).alias("ordinal"))


def _gst_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A stored table without every seventh customer, and a batch that repeats some keys."""
    columns = [*FEEDS["gst_filings"].columns]
    rows = v.gst_filings(spark, sf_dir).select(*columns)
    stored = (
        rows.filter(v.key() % 7 != 0)
        .withColumn("created_at", instant(EARLIER_TS))
        .withColumn("updated_at", F.col("created_at"))
    )
    batch = _with_copies(rows.filter((v.key() + F.col("month")) % 3 == 0))
    return stored, batch.withColumn("gstr_sales_paise", F.col("gstr_sales_paise") + F.col("ordinal") * 1000)


@query
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vd.duplicate_keys(_with_copies(v.gst_filings(spark, sf_dir)), FEEDS["gst_filings"].keys)


@query
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = FEEDS["gst_filings"].keys
    stored, batch = _gst_batches(spark, sf_dir)
    merged = upsert.merge(stored, upsert.last_per_key(batch, keys, ("ordinal",)), keys, RUN_TS)
    text = {
        c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("created_at", "updated_at")
    }
    return merged.withColumns(text)


@query
def scorecard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all card dates merged into a table that holds the two earlier ones."""
    keys = ("customer_id", "scorecard_date")
    scores = _card_history(spark, sf_dir).select(*keys, "composite_score")
    stored = scores.filter(F.col("scorecard_date") != F.lit(v.AS_OF)).select(
        *keys, F.lit(0).alias("composite_score"), instant(EARLIER_TS).alias("created_at")
    )
    batch = scores.filter(F.col("scorecard_date") != F.lit(v.CARD_DATES[0]))
    merged = upsert.merge(stored, batch, keys, RUN_TS)
    return merged.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


# --- reports ------------------------------------------------------------------------------


@query
def report_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.facts(_scored(spark, sf_dir))
    return rows.drop("red_flags", "green_flags").withColumn("ratios_cited", report.cited_ratios())


@query
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.facts(_scored(spark, sf_dir))
    return rows.select("customer_id", report.prompt_text().alias("prompt"))


@query
def fallback_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.narrative(report.facts(_scored(spark, sf_dir)))
    return rows.select(
        "customer_id",
        "summary",
        "financial_health",
        _joined("strengths"),
        _joined("risks"),
        "recommendations",
    )


@query
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.audit_trail(report.facts(_scored(spark, sf_dir)))
    return rows.select(
        "customer_id",
        "scorecard_date",
        F.array_join("data_sources_used", ", ").alias("data_sources_used"),
        "ratios_cited",
        "total_claims",
    )


@query
def dimension_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.dimension_long(_scored(spark, sf_dir))


@query
def cross_validation_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.cross_validation_long(ratios.cross_validation(_sums(spark, sf_dir)))


@query
def revenue_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    filed = v.gst_filings(spark, sf_dir).filter(v.has_gst())
    return series.revenue_trend(filed, v.upi_transactions(spark, sf_dir))


@query
def headcount_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.headcount_trend(v.epfo_payroll(spark, sf_dir))


@query
def upi_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.upi_months(v.upi_transactions(spark, sf_dir))


@query
def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finished report documents, read back from their JSON text."""
    made = reports.build_reports(
        sc.documents(_scored(spark, sf_dir)),
        v.customers(spark, sf_dir),
        v.gst_filings(spark, sf_dir).filter(v.has_gst()),
        v.upi_transactions(spark, sf_dir),
        v.epfo_payroll(spark, sf_dir).filter(v.has_epfo()),
        RUN_TS,
    )
    texts = {
        "business_name": "$.business_name",
        "summary": "$.narrative.summary",
        "financial_health": "$.narrative.financial_health",
        "recommendations": "$.narrative.recommendations",
        "total_claims": "$.audit_trail.total_claims",
        "ratios_cited": "$.audit_trail.ratios_cited",
        "gauge": "$.chart_configs[0].data_value",
        "scores": "$.chart_configs[1].data",
        "fourth_chart": "$.chart_configs[3].title",
        "fifth_chart": "$.chart_configs[4].title",
    }
    for i in range(4):
        texts[f"ratio_{i}"] = f"$.chart_configs[2].rows[{i}][1]"
        texts[f"status_{i}"] = f"$.chart_configs[2].rows[{i}][2]"
    lists = {
        "strengths": "$.narrative.strengths",
        "risks": "$.narrative.risks",
        "sources": "$.audit_trail.data_sources_used",
    }
    points = {"fourth_points": "$.chart_configs[3].data", "fifth_points": "$.chart_configs[4].data"}

    def part(path: str) -> Column:
        return F.get_json_object("report_json", path)

    def line(path: str) -> Column:
        found = F.from_json(part(path), "array<struct<month:string,value:double>>")
        return F.array_join(
            F.transform(found, lambda p: F.concat_ws("=", p["month"], F.rint(p["value"] * 100).cast("bigint").cast("string"))), "; "
        )

    return made.select(
        "customer_id",
        "scorecard_date",
        "generation_method",
        *[part(path).alias(name) for name, path in texts.items()],
        *[F.array_join(F.from_json(part(path), "array<string>"), " | ").alias(name) for name, path in lists.items()],
        *[line(path).alias(name) for name, path in points.items()],
    )


# --- listings -----------------------------------------------------------------------------


@query
def customer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.customer_ids(v.customers(spark, sf_dir))


@query
def customer_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.customer_listing(v.customers(spark, sf_dir))


@query
def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filings and the payments of one customer, each in period order."""
    filed = listing.customer_rows(v.gst_filings(spark, sf_dir), "gst_filings", "7")
    paid = listing.customer_rows(v.upi_transactions(spark, sf_dir), "upi_transactions", "7")
    return filed.select(
        F.lit("gst_filings").alias("source"),
        F.make_date("year", "month", F.lit(1)).alias("day"),
        F.col("gstr_sales_paise").alias("paise"),
    ).unionByName(
        paid.select(F.lit("upi_transactions").alias("source"), F.col("txn_date").alias("day"), F.col("collections_paise").alias("paise"))
    )


@query
def customer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all customers with UPI rows, looked up in an incomplete customer master."""
    wanted = v.upi_transactions(spark, sf_dir)
    master = v.customers(spark, sf_dir).filter(v.key() % 50 != 0)
    known, unknown = listing.lookup_customers(wanted, master)
    return known.withColumn("known", F.lit(True)).unionByName(
        unknown.withColumn("known", F.lit(False)), allowMissingColumns=True
    )


def _text(rows: Column) -> Column:
    return F.array_join(rows, "; ")


@query
def customer_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all four sources per customer, each row as text."""
    tables = {
        "gst_filings": v.gst_filings(spark, sf_dir),
        "upi_transactions": v.upi_transactions(spark, sf_dir),
        "bank_statements": v.bank_statements(spark, sf_dir).drop("dscr"),
        "epfo_payroll": v.epfo_payroll(spark, sf_dir),
    }
    nested = listing.customer_financials(v.customers(spark, sf_dir), tables)

    def period(r: Column) -> Column:
        return F.format_string("%d-%02d", r["year"], r["month"])

    def line(when: Callable[[Column], Column], *names: str) -> Callable[[Column], Column]:
        return lambda r: F.concat_ws(",", when(r), *[r[n].cast("string") for n in names])

    lines = {
        "gst_filings": line(period, "gstr_sales_paise", "tax_paid_paise", "filing_date"),
        "upi_transactions": line(
            lambda r: r["txn_date"].cast("string"), "day_of_week", "collections_paise"
        ),
        "bank_statements": line(period, "total_credits_paise", "total_debits_paise"),
        "epfo_payroll": line(period, "employee_count", "monthly_payroll_paise"),
    }
    return nested.select(
        "customer_id",
        "business_name",
        *[_text(F.transform(name, fn)).alias(name) for name, fn in lines.items()],
    )


@query
def raw_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count per customer and source."""
    return listing.row_counts(
        v.customers(spark, sf_dir),
        {
            "gst": v.gst_filings(spark, sf_dir),
            "upi": v.upi_transactions(spark, sf_dir),
            "bank": v.bank_statements(spark, sf_dir),
            "epfo": v.epfo_payroll(spark, sf_dir),
        },
    )


def _when(df: DataFrame) -> DataFrame:
    return df.withColumn("generated_at", F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss"))


@query
def scorecard_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_card(_card_history(spark, sf_dir))


@query
def latest_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = _card_history(spark, sf_dir)
    return listing.latest_per_customer(
        cards, ["scorecard_date"], "composite_score", "score_interpretation"
    )


@query
def latest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = v.report_log(spark, sf_dir)
    return _when(
        listing.latest_per_customer(log, ["generated_at", "scorecard_date"], "generation_method")
    )


def _listed(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    return listing.list_reports(
        v.report_log(spark, sf_dir),
        v.customers(spark, sf_dir),
        _card_history(spark, sf_dir),
        limit,
    )


@query
def report_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _when(listing.labelled(_listed(spark, sf_dir)))


@query
def recent_reports_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _when(listing.labelled(_listed(spark, sf_dir, limit=10)))


@query
def score_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.score_comparison(
        v.report_log(spark, sf_dir), v.customers(spark, sf_dir), _card_history(spark, sf_dir)
    )


@query
def report_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored report together with its scorecard."""
    found = listing.find_reports(v.report_log(spark, sf_dir), _card_history(spark, sf_dir))
    return _when(
        found.select(
            "customer_id",
            "scorecard_date",
            "generation_method",
            "generated_at",
            "composite_score",
            _joined("red_flags"),
            _joined("green_flags"),
        )
    )
