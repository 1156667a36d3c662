"""The five feed tables: how each raw field is cleaned, which rules apply, what the key is.

A new feed is added by registering one more ``FeedSpec``; cleaning, validation, merging,
lineage and error logging are driven by it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from altcredit.functions import cleaning as cl
from altcredit.functions import wording as wd
from altcredit.functions.numeric import number_text
from altcredit.schemas import TABLES

BLOCKING = "blocking"
WARNING = "warning"

Cleaner = Callable[[Column, str], tuple[Column, Column]]
Rule = tuple[str, Column, Column]  # severity, violated-when, message


@dataclass(frozen=True)
class Field:
    """One normalized column: the raw field it comes from and the cleaner to use."""

    name: str
    raw: str
    clean: Cleaner


@dataclass(frozen=True)
class FeedSpec:
    table: str
    fields: tuple[Field, ...]
    rules: Callable[[Column], list[Rule]]
    keys: tuple[str, ...]
    record_id: Callable[[], Column]
    # Columns the stored table is partitioned by: a load rewrites only the partitions it touches.
    partition_by: Callable[[], dict[str, Column]]
    limits: tuple[tuple[str, int], ...] = ()
    # Tables whose rows this feed refers to: they are loaded first.
    refers_to: tuple[str, ...] = ()

    @property
    def raw_schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.raw, T.StringType()) for f in self.fields])

    @property
    def schema(self) -> T.StructType:
        return TABLES[self.table]

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def is_child(self) -> bool:
        return "customers" in self.refers_to


def _col(name: str) -> Column:
    return F.col(name)


def _blocking(when: Column, message: str, *args: Column) -> Rule:
    return BLOCKING, when, F.format_string(message, *args) if args else F.lit(message)


def _warning(when: Column, message: str, *args: Column) -> Rule:
    return WARNING, when, F.format_string(message, *args)


def _constraint(when: Column, text: str) -> Rule:
    return BLOCKING, when, F.lit(f"violates constraint: {text}")


def _required(name: str) -> Rule:
    return _blocking(_col(name) == "", wd.REQUIRED % name)


def _in_future(name: str, as_of: Column) -> Rule:
    return _blocking(_col(name) > as_of, wd.IN_FUTURE, F.lit(name), _col(name).cast("string"))


def _negative(name: str) -> Rule:
    return _blocking(_col(f"{name}_paise") < 0, wd.NEGATIVE % name)


def _not_positive(name: str) -> Rule:
    return _blocking(_col(name) <= 0, wd.NOT_POSITIVE % name)


def _stored_not_negative(*names: str) -> list[Rule]:
    return [_constraint(_col(n) < 0, f"{n} >= 0") for n in names]


def _month_rule() -> Rule:
    return _blocking(~_col("month").between(1, 12), wd.MONTH_RANGE, _col("month"))


def _year_constraint() -> Rule:
    return _constraint(~_col("year").between(2000, 2100), "year between 2000 and 2100")


def _period_id() -> Column:
    return F.format_string("%s:%d-%02d", _col("customer_id"), _col("year"), _col("month"))


def _by_period() -> dict[str, Column]:
    return {"year": _col("year"), "month": _col("month")}


# Rules come in the order in which their messages are listed; table constraints follow them.


def customer_rules(as_of: Column) -> list[Rule]:
    number = _col("gst_number")
    odd = (number != cl.NOT_REGISTERED) & (F.length(number) != 15)
    return [
        _required("business_name"),
        _required("pan"),
        _warning(odd, wd.ODD_GST_NUMBER, number, F.length(number)),
        _in_future("registration_date", as_of),
    ]


def gst_rules(as_of: Column) -> list[Rule]:
    return [
        _month_rule(),
        _blocking(_col("gstr_sales_paise") <= 0, wd.SALES_NOT_POSITIVE),
        _negative("tax_paid"),
        _in_future("filing_date", as_of),
        _year_constraint(),
    ]


def upi_rules(as_of: Column) -> list[Rule]:
    return [
        _negative("collections"),
        _not_positive("num_transactions"),
        _in_future("txn_date", as_of),
        *_stored_not_negative("avg_ticket_size_paise"),
    ]


def bank_rules(as_of: Column) -> list[Rule]:
    credits, debits, dscr = _col("total_credits_paise"), _col("total_debits_paise"), _col("dscr")
    # The stored column is NUMERIC(8,2); the rule above it sees the value before rounding.
    stored = dscr.try_cast("decimal(8,2)")
    return [
        _month_rule(),
        _blocking(dscr <= 0, wd.DSCR_NOT_POSITIVE, number_text(dscr)),
        _blocking((credits < 0) | (debits < 0), wd.NEGATIVE % "credits/debits"),
        _warning(debits > credits, wd.DEBITS_EXCEED, debits, credits),
        _year_constraint(),
        _constraint((dscr > 0) & (stored.isNull() | (stored <= 0)), "dscr in NUMERIC(8,2) and > 0"),
        *_stored_not_negative(
            "payroll_paid_paise",
            "operating_expenses_paise",
            "tax_payments_paise",
            "existing_emi_paise",
            "avg_daily_balance_paise",
            "cheque_returns",
            "cash_withdrawals_paise",
        ),
    ]


def epfo_rules(as_of: Column) -> list[Rule]:
    return [
        _month_rule(),
        _not_positive("employee_count"),
        _negative("monthly_payroll"),
        _in_future("contribution_date", as_of),
        _year_constraint(),
        *_stored_not_negative("avg_wage_paise", "employee_churn"),
    ]


def _money(*names: str) -> tuple[Field, ...]:
    return tuple(Field(f"{n}_paise", n, cl.as_paise) for n in names)


_PERIOD = (Field("month", "month", cl.as_int), Field("year", "year", cl.as_int))
_ID = Field("customer_id", "customer_id", cl.as_text)

FEEDS: dict[str, FeedSpec] = {}


def register(spec: FeedSpec) -> FeedSpec:
    FEEDS[spec.table] = spec
    return spec


def waves(specs: dict[str, FeedSpec]) -> list[list[str]]:
    """Tables in the order in which they can be loaded: each wave refers to earlier ones only.

    References to tables outside ``specs`` count as loaded; a cycle is an error.
    """
    left, out = dict(specs), []
    while left:
        ready = [t for t, spec in left.items() if not any(r in left and r != t for r in spec.refers_to)]
        if not ready:
            raise ValueError(f"Feeds refer to each other in a circle: {sorted(left)}")
        out.append(ready)
        left = {t: spec for t, spec in left.items() if t not in ready}
    return out


register(
    FeedSpec(
        table="customers",
        fields=(
            _ID,
            Field("business_name", "business_name", cl.as_stripped),
            Field("sector", "sector", cl.as_sector),
            Field("persona", "persona", cl.as_optional),
            Field("gst_number", "gst_number", cl.as_code),
            Field("pan", "pan", cl.as_code),
            Field("registration_date", "registration_date", cl.as_date),
        ),
        rules=customer_rules,
        keys=("customer_id",),
        record_id=lambda: F.col("customer_id"),
        partition_by=dict,
        limits=(
            ("customer_id", 20),
            ("business_name", 200),
            ("sector", 100),
            ("persona", 100),
            ("gst_number", 20),
            ("pan", 10),
        ),
    )
)
register(
    FeedSpec(
        table="gst_filings",
        refers_to=("customers",),
        fields=(
            _ID,
            *_PERIOD,
            *_money("gstr_sales", "tax_paid"),
            Field("filing_date", "filing_date", cl.as_date),
            Field("is_delayed", "is_delayed", cl.as_bool),
        ),
        rules=gst_rules,
        keys=("customer_id", "year", "month"),
        record_id=_period_id,
        partition_by=_by_period,
    )
)
register(
    FeedSpec(
        table="upi_transactions",
        refers_to=("customers",),
        fields=(
            _ID,
            Field("txn_date", "date", cl.as_date),
            Field("day_of_week", "day_of_week", cl.as_text),
            *_money("collections"),
            Field("num_transactions", "num_transactions", cl.as_int),
            *_money("avg_ticket_size"),
        ),
        rules=upi_rules,
        keys=("customer_id", "txn_date"),
        record_id=lambda: F.concat_ws(":", F.col("customer_id"), F.col("txn_date").cast("string")),
        partition_by=lambda: {"txn_month": F.trunc("txn_date", "MM")},
        limits=(("day_of_week", 10),),
    )
)
register(
    FeedSpec(
        table="bank_statements",
        refers_to=("customers",),
        fields=(
            _ID,
            *_PERIOD,
            *_money(
                "total_credits",
                "total_debits",
                "payroll_paid",
                "operating_expenses",
                "tax_payments",
                "existing_emi",
                "operating_surplus",
                "avg_daily_balance",
            ),
            Field("dscr", "dscr", cl.as_float),
            Field("cheque_returns", "cheque_returns", cl.as_int),
            *_money("cash_withdrawals"),
        ),
        rules=bank_rules,
        keys=("customer_id", "year", "month"),
        record_id=_period_id,
        partition_by=_by_period,
    )
)
register(
    FeedSpec(
        table="epfo_payroll",
        refers_to=("customers",),
        fields=(
            _ID,
            *_PERIOD,
            Field("employee_count", "employee_count", cl.as_int),
            *_money("monthly_payroll", "avg_wage"),
            Field("contribution_date", "contribution_date", cl.as_date),
            Field("is_late_contribution", "is_late_contribution", cl.as_bool),
            Field("employee_churn", "employee_churn", cl.as_int),
        ),
        rules=epfo_rules,
        keys=("customer_id", "year", "month"),
        record_id=_period_id,
        partition_by=_by_period,
    )
)
