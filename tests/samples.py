"""Small hand-made feeds."""

from __future__ import annotations

import json
from datetime import date, datetime

from pyspark.sql import functions as F

from altcredit.schemas import TABLES

AS_OF = date(2025, 1, 1)
RUN_TS = datetime(2025, 1, 1, 6, 0, 0)

# One year of a published sample customer (rupees), with known ratios.
SALES = [172038, 125841, 171259, 148909, 149717, 139707, 153161, 150796, 124919, 163969, 135952, 169541]
DELAYED_MONTHS = {1, 3, 7, 10, 11}
# credits, payroll, opex, balance, dscr, cheque returns, cash
BANK = [
    (176408, 48587, 79383, 131896, 1.29, 0, 8820),
    (126600, 36614, 56970, 159741, 0.93, 0, 6330),
    (178772, 36944, 80447, 100399, 1.31, 2, 8938),
    (144997, 37315, 65248, 139148, 1.06, 0, 7249),
    (145151, 47427, 65317, 116799, 1.06, 1, 7257),
    (143817, 33947, 64717, 212500, 1.05, 0, 7190),
    (146263, 47229, 65818, 223298, 1.07, 0, 7313),
    (147210, 49622, 66244, 249634, 1.08, 0, 7360),
    (130842, 44605, 58878, 215634, 0.96, 1, 6542),
    (170075, 36446, 76533, 164521, 1.24, 0, 8503),
    (139309, 41572, 62689, 188152, 1.02, 1, 6965),
    (174602, 35728, 78570, 207179, 1.28, 2, 8730),
]
SURPLUS = [-54812, -64258, -42153, -57047, -67093, -54187, -66417, -68403, -70424, -45395, -63751, -42730]
# headcount, payroll, wage
STAFF = [
    (3, 32891, 10963),
    (2, 49503, 24751),
    (1, 45328, 45328),
    (1, 42486, 42486),
    (1, 32450, 32450),
    (1, 34631, 34631),
    (1, 47571, 47571),
    (1, 46843, 46843),
    (1, 38342, 38342),
    (1, 40961, 40961),
    (1, 42128, 42128),
    (1, 31001, 31001),
]
LATE_MONTHS = {8}


def customer(cid="C1", **changes):
    row = {
        "customer_id": cid,
        "business_name": "  Shop One ",
        "sector": "food  &  beverage",
        "persona": "p",
        "gst_number": "27abcde12345678",
        "pan": "abcde1234f",
        "registration_date": "2021-1-5",
    }
    return {**row, **changes}


def gst(cid="C1", month=1, **changes):
    row = {
        "customer_id": cid,
        "month": month,
        "year": 2024,
        "gstr_sales": SALES[(month - 1) % 12],
        "tax_paid": 100,
        "filing_date": f"2024-{month:02d}-20",
        "is_delayed": month in DELAYED_MONTHS,
    }
    return {**row, **changes}


def bank(cid="C1", month=1, **changes):
    i = (month - 1) % 12
    credits, payroll, opex, balance, dscr, cheques, cash = BANK[i]
    row = {
        "customer_id": cid,
        "month": month,
        "year": 2024,
        "month_date": f"2024-{month:02d}-01",
        "total_credits": credits,
        "total_debits": credits - SURPLUS[i],
        "payroll_paid": payroll,
        "operating_expenses": opex,
        "tax_payments": 20000,
        "existing_emi": 82082,
        "operating_surplus": SURPLUS[i],
        "avg_daily_balance": balance,
        "dscr": dscr,
        "cheque_returns": cheques,
        "cash_withdrawals": cash,
    }
    return {**row, **changes}


def epfo(cid="C1", month=1, **changes):
    heads, payroll, wage = STAFF[(month - 1) % 12]
    row = {
        "customer_id": cid,
        "month": month,
        "year": 2024,
        "employee_count": heads,
        "monthly_payroll": payroll,
        "avg_wage": wage,
        "contribution_date": f"2024-{month:02d}-15",
        "is_late_contribution": month in LATE_MONTHS,
        "employee_churn": 0,
    }
    return {**row, **changes}


def upi(cid="C1", day="2024-01-01", name="Monday", **changes):
    row = {
        "customer_id": cid,
        "date": day,
        "day_of_week": name,
        "collections": 4250,
        "num_transactions": 80,
        "avg_ticket_size": 53,
    }
    return {**row, **changes}


def year(make, cid="C1"):
    return [make(cid, m) for m in range(1, 13)]


UPI_WEEK = [
    ("2024-01-01", "Monday", 4250, 80, 53),
    ("2024-01-02", "Tuesday", 4602, 107, 43),
    ("2024-01-06", "Saturday", 5000, 90, 55),
    ("2024-01-07", "Sunday", 0, 1, 10),
    ("2024-02-01", "Thursday", 3141, 84, 37),
]


def upi_rows(cid="C1"):
    return [
        upi(cid, d, n, collections=c, num_transactions=t, avg_ticket_size=s)
        for d, n, c, t, s in UPI_WEEK
    ]


def raw_frame(spark, rows, fields):
    """Records as an all-text frame, the way feed readers deliver them."""
    schema = ", ".join(f"`{f}` string" for f in fields)

    def text(x):
        return None if x is None else str(x).lower() if isinstance(x, bool) else str(x)

    return spark.createDataFrame([tuple(text(r.get(f)) for f in fields) for r in rows], schema)


def whole_rows(rows, table):
    """Rows of a table with NULL in the columns that are not given."""
    fields = [f for f in TABLES[table].fields if f.name not in ("created_at", "updated_at")]
    given = {c: F.col(c) for c in rows.columns}
    return rows.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def write_feed(folder, table, rows):
    path = f"{folder}/{table}.json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f)
    return path
