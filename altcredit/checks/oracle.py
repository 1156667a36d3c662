"""SQL that must give the same rows as the registered queries.

Each statement is self-contained: source tables, sums, ratios and scores are common table
expressions, of which a query takes those it needs. Windows, arrays and double arithmetic are
written the plain SQL way and not after the DataFrame code; only the rounding rule (half-even
on the scaled double) and the exact integer sums are shared by definition.
"""

from __future__ import annotations

import re

from altcredit.functions import wording as wd

ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def rnd(x: str, places: int = 0) -> str:
    return f"(round_even(({x}) * 1e{places}, 0) / 1e{places})"


def whole(x: str) -> str:
    return f"CAST(round_even({x}, 0) AS BIGINT)"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0e0))"


def mean(total: str, n: str) -> str:
    return div(total, f"({n}) * 100")


def std(n: str, s: str, sq: str) -> str:
    return (
        f"CASE WHEN {n} = 1 THEN 0e0 WHEN {n} > 1 THEN "
        f"sqrt({div(f'{n} * {sq} - CAST({s} AS HUGEINT) * {s}', f'{n} * ({n} - 1)')}) END"
    )


def cv(n: str, s: str, sq: str) -> str:
    return f"CASE WHEN {n} > 0 AND {s} <> 0 THEN ({std(n, s, sq)}) / {div(s, n)} END"


def pct(x: str) -> str:
    return rnd(f"({x}) * 1e2", 1)


def txt(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def cents(x: str) -> str:
    return f"CAST(round_even(({x}) * 100, 0) AS BIGINT)"


def slope(n: str, s: str, si: str) -> str:
    i, i2 = f"({n} * ({n} - 1) // 2)", f"(({n} - 1) * {n} * (2 * {n} - 1) // 6)"
    return (
        f"CASE WHEN {n} < 2 THEN 0e0 ELSE "
        f"{div(f'{n} * CAST({si} AS HUGEINT) - {i} * CAST({s} AS HUGEINT)', f'{n} * {i2} - {i} * {i}')} END"
    )


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def needed(sql: str, skip: str = "") -> list[str]:
    return [c for c in CTES if c != skip and re.search(rf"\b{c}\b", sql)]


def oracle(name: str, sql: str) -> None:
    """Registers a statement with the table expressions it refers to, in definition order."""
    used: set[str] = set()
    todo = needed(sql)
    while todo:
        c = todo.pop()
        if c not in used:
            used.add(c)
            todo += needed(CTES[c], skip=c)
    parts = ", ".join(f"{c} AS ({CTES[c]})" for c in CTES if c in used)
    ORACLES[name] = f"WITH {parts} {sql}" if parts else sql


# --- source tables ------------------------------------------------------------------------

cte(
    "gst_t",
    f"""SELECT CAST(o_custkey AS VARCHAR) AS customer_id, o_custkey AS k,
  CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(sum({cents('o_totalprice')}) AS BIGINT) AS sales,
  CAST(sum({cents('o_totalprice * 18e-2')}) AS BIGINT) AS tax,
  CAST(max(o_orderdate) AS DATE) AS filing_date,
  bool_or(o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') AS is_delayed
FROM orders GROUP BY ALL""",
)
cte(
    "ol_t",
    """SELECT CAST(o_custkey AS VARCHAR) AS customer_id, o_custkey AS k, CAST(year(o_orderdate) AS INTEGER) AS y,
  CAST(month(o_orderdate) AS INTEGER) AS m, c_acctbal, lineitem.*
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey""",
)
cte(
    "bank_t",
    f"""SELECT *, payroll + opex + tax + emi AS debits,
  credits - (payroll + opex + tax + emi) AS surplus,
  round_even(CAST(credits AS DOUBLE) * 100 / CAST(emi AS DOUBLE), 0) / 100 AS dscr
FROM (SELECT customer_id, k, y, m,
  CAST(sum({cents('l_extendedprice * (1 - l_discount)')}) AS BIGINT) AS credits,
  CAST(sum({cents('l_extendedprice * l_tax')}) AS BIGINT) AS payroll,
  CAST(sum({cents('l_extendedprice * l_discount')}) AS BIGINT) AS opex,
  CAST(sum({cents('l_extendedprice * 2e-2')}) AS BIGINT) AS tax,
  CAST(sum({cents('l_quantity * 1500')}) AS BIGINT) AS emi,
  max({cents('greatest(c_acctbal, 0e0) * 3')}) AS adb,
  CAST(count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 1) AS INTEGER) AS cheques,
  CAST(coalesce(sum({cents('l_extendedprice')}) FILTER (l_linenumber = 7), 0) AS BIGINT) AS cash
FROM ol_t GROUP BY ALL)""",
)
cte(
    "epfo_t",
    f"""SELECT *, payroll // heads AS wage
FROM (SELECT customer_id, k, y, m, CAST(count(*) AS INTEGER) AS heads,
  CAST(sum({cents('l_extendedprice * 4e-2')}) AS BIGINT) AS payroll,
  bool_or(l_returnflag = 'R' AND l_linestatus = 'O' AND l_linenumber = 6) AS late,
  CAST(count(*) FILTER (l_returnflag = 'R' AND l_linenumber = 5) AS INTEGER) AS churn,
  CAST(max(l_shipdate) AS DATE) AS contribution_date
FROM ol_t GROUP BY ALL)""",
)
cte(
    "upi_t",
    f"""SELECT *, collections // txns AS ticket, dayname(d) AS dow
FROM (SELECT CAST(c AS VARCHAR) AS customer_id, c AS k,
  CAST(DATE '2024-01-01' + CAST(dayofyear(l_shipdate) - 1 AS INTEGER) AS DATE) AS d,
  CAST(sum(CASE WHEN (l_returnflag = 'R' AND l_linenumber = 1) OR l_linenumber > 1 + c % 7 THEN 0 ELSE
    {cents('l_quantity * (100 + ((l_extendedprice % 1000) * (c % 5)) / 20e0)')} END) AS BIGINT) AS collections,
  CAST(sum(CAST(l_quantity AS INTEGER)) AS INTEGER) AS txns
FROM (SELECT *, l_suppkey // 2 AS c FROM lineitem) GROUP BY ALL)""",
)
cte(
    "customers_t",
    """SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_custkey AS k, c_name AS business_name,
  upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS sector,
  CASE WHEN c_custkey % 4 <> 0 THEN 'nation_' || c_nationkey END AS persona,
  CASE WHEN c_custkey % 5 = 0 THEN 'NOT_REGISTERED'
    ELSE '27ABCDE' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS gst_number
FROM customer""",
)

# --- per-customer sums, for one card date and for all three --------------------------------

cte("one_card", "SELECT DATE '2025-01-01' AS card, 999999 AS mcut, DATE '9999-01-01' AS ucut")
cte(
    "all_cards",
    """SELECT * FROM (VALUES (DATE '2024-07-01', 1997 * 12 + 7, DATE '2024-05-01'),
  (DATE '2024-10-01', 1999 * 12 + 1, DATE '2024-09-01'),
  (DATE '2025-01-01', 999999, DATE '9999-01-01')) AS t(card, mcut, ucut)""",
)


def window(extra: str = "") -> str:
    part = "PARTITION BY customer_id, card"
    return f"row_number() OVER ({part} ORDER BY y, m) AS rn, count(*) OVER ({part}) AS cnt{extra}"


def define_scores(s: str, cards: str) -> None:
    """Sums, ratios, scores and flags with suffix ``s`` for the given card dates."""
    cte(
        f"gst_s{s}",
        f"""SELECT customer_id, card, count(*) AS g_n, sum(sales) AS g_sum,
  sum(CAST(sales AS HUGEINT) * sales) AS g_sq, max(sales) FILTER (rn = 1) AS g_first,
  max(sales) FILTER (rn = cnt) AS g_last, max(sales) FILTER (rn = cnt - 1) AS g_prev,
  count(*) FILTER (is_delayed) AS g_delays, min(sales) AS g_min, max(sales) AS g_max
FROM (SELECT *, {window()} FROM gst_t, {cards} WHERE y * 12 + m < mcut) GROUP BY ALL""",
    )
    cte(
        f"bank_s{s}",
        f"""SELECT customer_id, card, count(*) AS b_n, sum(credits) AS b_credits,
  sum(CAST(credits AS HUGEINT) * credits) AS b_sq, sum((rn - 1) * credits) AS b_idx,
  sum(surplus) AS b_surplus, sum(adb) AS b_adb, sum(opex) AS b_opex, sum(payroll) AS b_payroll,
  sum(emi) AS b_emi, sum(cash) AS b_cash, sum(cheques) AS b_cheques,
  sum({cents('dscr')}) AS b_dscr
FROM (SELECT *, {window()} FROM bank_t, {cards} WHERE y * 12 + m < mcut) GROUP BY ALL""",
    )
    cte(
        f"epfo_s{s}",
        f"""SELECT customer_id, card, count(*) AS e_n, sum(heads) AS e_heads,
  sum((rn - 1) * heads) AS e_idx, max(heads) FILTER (rn = 1) AS e_first,
  max(heads) FILTER (rn = cnt) AS e_last, sum(payroll) AS e_payroll,
  sum(CAST(payroll AS HUGEINT) * payroll) AS e_sq, sum(wage) AS e_wage,
  max(wage) FILTER (rn = 1) AS e_wfirst, max(wage) FILTER (rn = cnt) AS e_wlast,
  count(*) FILTER (late) AS e_late, sum(churn) AS e_churn
FROM (SELECT *, {window()} FROM epfo_t, {cards} WHERE y * 12 + m < mcut) GROUP BY ALL""",
    )
    cte(
        f"upi_s{s}",
        f"""SELECT customer_id, card, count(*) AS u_n, sum(collections) AS u_sum, sum(txns) AS u_txns,
  sum(ticket) AS u_ticket, sum(CAST(ticket AS HUGEINT) * ticket) AS u_sq,
  count(*) FILTER (collections > 0) AS u_active,
  count(*) FILTER (dow IN ('Saturday', 'Sunday')) AS u_we_n,
  coalesce(sum(collections) FILTER (dow IN ('Saturday', 'Sunday')), 0) AS u_we,
  count(*) FILTER (dow NOT IN ('Saturday', 'Sunday')) AS u_wd_n,
  coalesce(sum(collections) FILTER (dow NOT IN ('Saturday', 'Sunday')), 0) AS u_wd
FROM upi_t, {cards} WHERE d < ucut GROUP BY ALL""",
    )
    growth = f"{div('g_last', 'g_first')} - 1e0"
    gst_mean, aa_mean = mean("g_sum", "g_n"), mean("b_credits", "b_n")
    upi_mean = f"{mean('u_sum', 'u_n')} * 30e0"
    heads = div("e_heads", "e_n")
    cte(
        f"gst_r{s}",
        f"""SELECT *, true AS gst_is_gst_registered,
  CASE WHEN g_first > 0 THEN {pct(growth)} END AS gst_cagr_percent,
  {pct(div('g_last - g_prev', 'g_prev'))} AS gst_mom_growth_percent,
  {pct(cv('g_n', 'g_sum', 'g_sq'))} AS gst_cv_percent, g_delays AS gst_filing_delays,
  'NA' AS gst_tax_payment_status, 'NA' AS gst_itc_utilization_percent,
  'NA' AS gst_customer_concentration FROM gst_s{s}""",
    )
    cte(
        f"upi_r{s}",
        f"""SELECT *, {whole(mean('u_sum', 'u_n'))} AS upi_avg_daily_collections,
  CAST(u_txns AS BIGINT) AS upi_total_transactions,
  {whole(mean('u_ticket', 'u_n'))} AS upi_avg_ticket_size, u_active AS upi_active_days,
  {pct('CAST(u_active AS DOUBLE) / 365e0')} AS upi_active_days_percent,
  {pct(cv('u_n', 'u_ticket', 'u_sq'))} AS upi_ticket_size_cv_percent,
  'NA' AS upi_repeat_customer_rate,
  {rnd(div(mean('u_we', 'u_we_n'), mean('u_wd', 'u_wd_n')), 2)} AS upi_weekend_weekday_ratio
FROM upi_s{s}""",
    )
    cte(
        f"aa_r{s}",
        f"""SELECT *, {whole(aa_mean)} AS aa_avg_monthly_credits,
  {rnd(f"({slope('b_n', 'b_credits', 'b_idx')}) / 1e2", 2)} AS aa_monthly_credits_trend_slope,
  {pct(cv('b_n', 'b_credits', 'b_sq'))} AS aa_monthly_credits_volatility_percent,
  {whole(mean('b_adb', 'b_n'))} AS aa_avg_daily_balance,
  {whole(mean('b_opex', 'b_n'))} AS aa_avg_monthly_operating_expenses,
  {rnd(div(mean('b_surplus', 'b_n'), aa_mean), 2)} AS aa_cash_conversion_ratio,
  {rnd(mean('b_dscr', 'b_n'), 2)} AS aa_dscr,
  {whole('CAST(b_emi AS DOUBLE) / 1e2')} AS aa_existing_debt_total_annual,
  {whole(mean('b_emi', 'b_n'))} AS aa_existing_debt_avg_monthly,
  'NA' AS aa_existing_debt_instrument_count, CAST(b_cheques AS BIGINT) AS aa_cheque_return_count,
  {pct(div(mean('b_cash', 'b_n'), aa_mean))} AS aa_cash_withdrawal_percent,
  'NA' AS aa_days_sales_outstanding FROM bank_s{s}""",
    )
    cte(
        f"epfo_r{s}",
        f"""SELECT *, e_first AS epfo_starting_employee_count, e_last AS epfo_ending_employee_count,
  {pct(div('e_last - e_first', 'e_first'))} AS epfo_employee_growth_percent,
  {rnd(heads, 1)} AS epfo_avg_employee_count,
  {rnd(slope('e_n', 'e_heads', 'e_idx'), 3)} AS epfo_employee_count_trend_slope,
  {whole(mean('e_payroll', 'e_n'))} AS epfo_avg_monthly_payroll,
  {rnd(f"({std('e_n', 'e_payroll', 'e_sq')}) / 1e2", 2)} AS epfo_monthly_payroll_variance,
  {whole(mean('e_wage', 'e_n'))} AS epfo_avg_wage,
  {pct(div('e_wlast - e_wfirst', 'e_wfirst'))} AS epfo_wage_inflation_percent,
  e_late AS epfo_contribution_timeliness_late_count,
  {rnd(div('e_churn', f'12e0 * {heads}'), 4)} AS epfo_employee_churn_rate FROM epfo_s{s}""",
    )
    cte(
        f"joined{s}",
        f"""SELECT c.customer_id, c.k, c.business_name, c.sector, c.persona, c.gst_number,
  d.card AS scorecard_date,
  g.* EXCLUDE (customer_id, card, gst_is_gst_registered, gst_tax_payment_status,
    gst_itc_utilization_percent, gst_customer_concentration),
  g.customer_id IS NOT NULL AS gst_is_gst_registered, 'NA' AS gst_tax_payment_status,
  'NA' AS gst_itc_utilization_percent, 'NA' AS gst_customer_concentration,
  u.u_sum, u.u_n, coalesce(upi_avg_daily_collections, 0) AS upi_avg_daily_collections,
  coalesce(upi_total_transactions, 0) AS upi_total_transactions,
  coalesce(upi_avg_ticket_size, 0) AS upi_avg_ticket_size,
  coalesce(upi_active_days, 0) AS upi_active_days,
  coalesce(upi_active_days_percent, 0e0) AS upi_active_days_percent, upi_ticket_size_cv_percent,
  'NA' AS upi_repeat_customer_rate, upi_weekend_weekday_ratio,
  a.* EXCLUDE (customer_id, card), a.customer_id IS NOT NULL AS aa_available,
  e.* EXCLUDE (customer_id, card), e.customer_id IS NOT NULL AS epfo_available
FROM customers_t c CROSS JOIN {cards} d
LEFT JOIN gst_r{s} g ON g.customer_id = c.customer_id AND g.card = d.card AND c.k % 5 <> 0
LEFT JOIN upi_r{s} u ON u.customer_id = c.customer_id AND u.card = d.card
LEFT JOIN aa_r{s} a ON a.customer_id = c.customer_id AND a.card = d.card AND c.k % 11 <> 0
LEFT JOIN epfo_r{s} e ON e.customer_id = c.customer_id AND e.card = d.card AND c.k % 7 <> 0""",
    )
    staff = div("e_last - e_first", "e_first")
    pairs = {
        "gst_vs_aa": (gst_mean, aa_mean),
        "gst_vs_upi": (gst_mean, upi_mean),
        "aa_payroll_vs_epfo_payroll": (mean("b_payroll", "b_n"), mean("e_payroll", "e_n")),
        "upi_vs_aa_credits": (upi_mean, aa_mean),
    }
    cross = ", ".join(
        f"{rnd(div(a, b), 2)} AS cross_{name}_ratio" for name, (a, b) in pairs.items()
    )
    flags = ", ".join(
        f"cross_{name}_ratio > 15e-1 OR cross_{name}_ratio < 5e-1 AS cross_{name}_mismatch"
        for name in pairs
    )
    cte(
        f"recon{s}",
        f"""SELECT *, {flags} FROM (SELECT *, {cross}, CASE
  WHEN g_n IS NULL OR g_n < 2 OR g_first <= 0 OR e_n IS NULL OR e_first = 0 THEN 'NA'
  WHEN ({growth} >= 0) = ({staff} >= 0) THEN 'aligned' ELSE 'misaligned' END
  AS cross_gst_growth_vs_employee_growth FROM joined{s})""",
    )
    cte(
        f"banded{s}",
        f"""SELECT *,
  CASE WHEN aa_dscr >= 1.75e0 THEN 100 WHEN aa_dscr >= 1.25e0 THEN 70 WHEN aa_dscr >= 1e0 THEN 40 ELSE 0 END AS score_dscr,
  CASE WHEN coalesce(aa_avg_monthly_operating_expenses, 0) <= 0 THEN 100
    WHEN cover >= 1.5e0 THEN 100 WHEN cover >= 1e0 THEN 70 WHEN cover >= 5e-1 THEN 40 ELSE 0 END AS score_balance_cover,
  CASE coalesce(aa_cheque_return_count, 0) WHEN 0 THEN 100 WHEN 1 THEN 60 ELSE 0 END AS score_cheque_returns,
  CASE WHEN aa_cash_withdrawal_percent <= 5 THEN 100 WHEN aa_cash_withdrawal_percent <= 15 THEN 70 ELSE 0 END AS score_cash_withdrawal,
  CASE WHEN coalesce(gst_filing_delays, 0) = 0 THEN 100 WHEN gst_filing_delays <= 2 THEN 70 ELSE 0 END AS score_filing_delays,
  CASE WHEN gst_cv_percent <= 15 THEN 100 WHEN gst_cv_percent <= 30 THEN 70 WHEN gst_cv_percent <= 40 THEN 40 ELSE 0 END AS score_revenue_cv,
  CASE WHEN gst_cagr_percent > 1 THEN 100 WHEN gst_cagr_percent < -1 THEN 0 ELSE 70 END AS score_growth_trend,
  CASE WHEN upi_active_days_percent >= 90 THEN 100 WHEN upi_active_days_percent >= 70 THEN 70 ELSE 0 END AS score_active_days,
  CASE WHEN upi_ticket_size_cv_percent <= 30 THEN 100 WHEN upi_ticket_size_cv_percent <= 50 THEN 70 ELSE 0 END AS score_ticket_cv,
  CASE WHEN upi_total_transactions / 365e0 >= 80 THEN 100 WHEN upi_total_transactions / 365e0 >= 40 THEN 70 ELSE 0 END AS score_frequency,
  CASE WHEN epfo_employee_growth_percent > 0 THEN 100 WHEN epfo_employee_growth_percent < 0 THEN 0 ELSE 70 END AS score_employee_growth,
  CASE WHEN coalesce(epfo_contribution_timeliness_late_count, 0) = 0 THEN 100
    WHEN epfo_contribution_timeliness_late_count <= 2 THEN 70 ELSE 0 END AS score_contributions
FROM (SELECT *, {div('aa_avg_daily_balance', 'CAST(aa_avg_monthly_operating_expenses AS DOUBLE) / 30e0 * 45e0')} AS cover FROM recon{s})""",
    )
    cte(
        f"scored{s}",
        f"""SELECT *, CASE WHEN composite_score >= 85 THEN 'Excellent' WHEN composite_score >= 70 THEN 'Good'
  WHEN composite_score >= 50 THEN 'Fair' WHEN composite_score >= 30 THEN 'Weak' ELSE 'Poor' END AS score_interpretation
FROM (SELECT *, CAST(round_even(aa_bank_cashflow * 35e-2 + gst_quality * 25e-2 + upi_behaviour * 2e-1
    + epfo_stability * 1e-1 + compliance_bureau * 1e-1, 0) AS INTEGER) AS composite_score
FROM (SELECT *,
  CAST(round_even(score_dscr * 4e-1 + score_balance_cover * 3e-1 + score_cheque_returns * 2e-1 + score_cash_withdrawal * 1e-1, 0) AS INTEGER) AS aa_bank_cashflow,
  CASE WHEN gst_is_gst_registered THEN CAST(round_even(score_filing_delays * 5e-1 + score_revenue_cv * 3e-1 + score_growth_trend * 2e-1, 0) AS INTEGER) ELSE 50 END AS gst_quality,
  CAST(round_even(score_active_days * 5e-1 + score_ticket_cv * 3e-1 + score_frequency * 2e-1, 0) AS INTEGER) AS upi_behaviour,
  CAST(round_even(score_employee_growth * 5e-1 + score_contributions * 5e-1, 0) AS INTEGER) AS epfo_stability,
  80 AS compliance_bureau FROM banded{s}))""",
    )
    cte(
        f"flagged{s}",
        f"""SELECT *, list_filter([
  CASE WHEN aa_dscr < 1 THEN 'Weak repayment capacity (DSCR ' || {txt('aa_dscr')} || ')' END,
  CASE WHEN aa_cheque_return_count >= 2 THEN 'Liquidity stress (' || aa_cheque_return_count || ' cheque bounces)' END,
  CASE WHEN gst_filing_delays >= 3 THEN 'Compliance risk (' || gst_filing_delays || ' late GST filings)' END,
  CASE WHEN epfo_contribution_timeliness_late_count >= 2 THEN 'Payroll stress (' || epfo_contribution_timeliness_late_count || ' late EPFO contributions)' END,
  CASE WHEN e_last < e_first THEN 'Declining employee count (' || e_first || ' -> ' || e_last || ')' END,
  CASE WHEN gst_cagr_percent < -5 THEN 'Revenue decline (' || {txt('gst_cagr_percent')} || '% YoY)' END,
  CASE WHEN cross_gst_vs_aa_mismatch THEN 'Unaccounted cash flow (GST vs AA ratio ' || {txt('cross_gst_vs_aa_ratio')} || ')' END,
  CASE WHEN aa_cash_withdrawal_percent > 15 THEN 'High cash withdrawals (' || {txt('aa_cash_withdrawal_percent')} || '% of collections)' END
], lambda x: x IS NOT NULL) AS red, list_filter([
  CASE WHEN aa_dscr > 1.75e0 THEN 'Strong repayment capacity (DSCR ' || {txt('aa_dscr')} || ')' END,
  CASE WHEN coalesce(aa_cheque_return_count, 0) = 0 THEN 'Zero cheque bounces' END,
  CASE WHEN gst_filing_delays = 0 THEN 'All GST filings on time' END,
  CASE WHEN epfo_employee_growth_percent > 10 THEN 'Employee growth of ' || {txt('epfo_employee_growth_percent')} || '%' END,
  CASE WHEN gst_cagr_percent > 5 THEN 'Revenue growth of ' || {txt('gst_cagr_percent')} || '% YoY' END,
  CASE WHEN aa_avg_monthly_operating_expenses <> 0 AND CAST(aa_avg_daily_balance AS DOUBLE) > CAST(aa_avg_monthly_operating_expenses AS DOUBLE) / 30e0 * 60e0
    THEN 'Healthy cash buffer (ADB covers 60+ days of expenses)' END
], lambda x: x IS NOT NULL) AS green FROM scored{s}""",
    )


define_scores("", "one_card")
define_scores("_h", "all_cards")

# --- ratios -------------------------------------------------------------------------------

GST_COLS = "gst_is_gst_registered, gst_cagr_percent, gst_mom_growth_percent, gst_cv_percent, gst_filing_delays, gst_tax_payment_status, gst_itc_utilization_percent, gst_customer_concentration"
UPI_COLS = "upi_avg_daily_collections, upi_total_transactions, upi_avg_ticket_size, upi_active_days, upi_active_days_percent, upi_ticket_size_cv_percent, upi_repeat_customer_rate, upi_weekend_weekday_ratio"
AA_COLS = "aa_avg_monthly_credits, aa_monthly_credits_trend_slope, aa_monthly_credits_volatility_percent, aa_avg_daily_balance, aa_avg_monthly_operating_expenses, aa_cash_conversion_ratio, aa_dscr, aa_existing_debt_total_annual, aa_existing_debt_avg_monthly, aa_existing_debt_instrument_count, aa_cheque_return_count, aa_cash_withdrawal_percent, aa_days_sales_outstanding"
EPFO_COLS = "epfo_starting_employee_count, epfo_ending_employee_count, epfo_employee_growth_percent, epfo_avg_employee_count, epfo_employee_count_trend_slope, epfo_avg_monthly_payroll, epfo_monthly_payroll_variance, epfo_avg_wage, epfo_wage_inflation_percent, epfo_contribution_timeliness_late_count, epfo_employee_churn_rate"
CROSS_COLS = "cross_gst_vs_aa_ratio, cross_gst_vs_aa_mismatch, cross_gst_vs_upi_ratio, cross_gst_vs_upi_mismatch, cross_aa_payroll_vs_epfo_payroll_ratio, cross_aa_payroll_vs_epfo_payroll_mismatch, cross_upi_vs_aa_credits_ratio, cross_upi_vs_aa_credits_mismatch, cross_gst_growth_vs_employee_growth"
DIM_COLS = "aa_bank_cashflow, gst_quality, upi_behaviour, epfo_stability, compliance_bureau"
CARD_COLS = f"{GST_COLS}, {UPI_COLS}, {AA_COLS}, {EPFO_COLS}, {CROSS_COLS}, {DIM_COLS}, composite_score, score_interpretation"
FLAG_COLS = "array_to_string(red, ' | ') AS red_flags, array_to_string(green, ' | ') AS green_flags"

oracle("gst_ratios", f"SELECT customer_id, {GST_COLS} FROM gst_r")
oracle(
    "gst_mom",
    "SELECT customer_id, g_prev AS previous_paise, g_last AS last_paise, "
    f"{pct(div('g_last - g_prev', 'g_prev'))} AS mom_growth_percent FROM gst_s",
)
oracle(
    "sales_cv",
    f"SELECT customer_id, g_n AS months, {rnd(mean('g_sum', 'g_n'), 2)} AS mean_sales, "
    f"{pct(cv('g_n', 'g_sum', 'g_sq'))} AS cv_percent FROM gst_s",
)
oracle("upi_ratios", f"SELECT customer_id, {UPI_COLS} FROM upi_r")
oracle(
    "weekend_ratio",
    "SELECT customer_id, u_we_n AS weekend_days, CAST(u_we AS BIGINT) AS weekend_paise, "
    "u_wd_n AS weekday_days, upi_weekend_weekday_ratio AS weekend_weekday_ratio FROM upi_r",
)
oracle("aa_ratios", f"SELECT customer_id, {AA_COLS} FROM aa_r")
oracle(
    "credit_trend_slope",
    "SELECT customer_id, b_n AS months, aa_monthly_credits_trend_slope AS slope FROM aa_r",
)
oracle("epfo_ratios", f"SELECT customer_id, {EPFO_COLS} FROM epfo_r")
oracle("cross_validation", f"SELECT customer_id, {CROSS_COLS} FROM recon")
oracle(
    "growth_alignment",
    "SELECT customer_id, coalesce(g_n, 0) AS gst_months, coalesce(e_n, 0) AS epfo_months, "
    "cross_gst_growth_vs_employee_growth AS alignment FROM recon",
)
oracle(
    "score_bands",
    "SELECT customer_id, score_dscr, score_balance_cover, score_cheque_returns, "
    "score_cash_withdrawal, score_filing_delays, score_revenue_cv, score_growth_trend, "
    "score_active_days, score_ticket_cv, score_frequency, score_employee_growth, "
    "score_contributions FROM banded",
)
oracle("dimension_scores", f"SELECT customer_id, {DIM_COLS} FROM scored")
oracle(
    "composite_score",
    "SELECT customer_id, composite_score, score_interpretation, CASE WHEN composite_score < 40 "
    "THEN 'red' WHEN composite_score < 70 THEN 'yellow' ELSE 'green' END AS band FROM scored",
)


def mismatch_lines() -> str:
    found = ", ".join(
        f"CASE WHEN cross_{name}_mismatch THEN '- ' || "
        f"replace('{text}', '%s', {txt(f'cross_{name}_ratio')}) END"
        for name, text in wd.MISMATCHES.items()
    )
    return (
        f"coalesce(nullif(array_to_string(list_filter([{found}], lambda x: x IS NOT NULL), chr(10)), ''), "
        f"'{wd.NO_MISMATCHES}')"
    )


oracle(
    "flags",
    f"SELECT customer_id, {FLAG_COLS}, {mismatch_lines()} AS cross_validation_flags FROM flagged",
)
oracle("scorecard", f"SELECT customer_id, scorecard_date, {CARD_COLS}, {FLAG_COLS} FROM flagged")

# However the sums came about, they are those of all rows.
oracle("incremental_scorecard", f"SELECT customer_id, scorecard_date, {CARD_COLS}, {FLAG_COLS} FROM flagged")
oracle("stored_scorecard", f"SELECT customer_id, scorecard_date, {CARD_COLS}, {FLAG_COLS} FROM flagged")
oracle(
    "requested_scores",
    """SELECT u.customer_id, s.composite_score FROM (SELECT DISTINCT customer_id FROM upi_t) u
LEFT JOIN (SELECT * FROM scored WHERE k % 50 <> 0) s ON s.customer_id = u.customer_id""",
)

# --- ingest -------------------------------------------------------------------------------


def rupees(paise: str) -> str:
    sign = f"CASE WHEN {paise} < 0 THEN '-' ELSE '' END"
    return f"{sign} || (abs({paise}) // 100) || '.' || lpad(CAST(abs({paise}) % 100 AS VARCHAR), 2, '0')"


def flawed(good: str, *bad: tuple[str, str]) -> str:
    whens = " ".join(f"WHEN {when} THEN {value}" for when, value in bad)
    return f"CASE {whens} ELSE {good} END"


cte(
    "raw_customers",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
  {flawed("'  ' || c_name || ' '", ("c_custkey % 89 = 0", "'   '"))} AS business_name,
  CASE WHEN c_custkey % 3 = 0 THEN ' food  &   beverage' ELSE ' ' || lower(c_mktsegment) || '  services ' END AS sector,
  CASE WHEN c_custkey % 4 <> 0 THEN 'nation_' || c_nationkey END AS persona,
  CASE WHEN c_custkey % 5 = 0 THEN 'not_registered' WHEN c_custkey % 7 = 0
    THEN '27abcde' || lpad(CAST(c_custkey AS VARCHAR), 7, '0')
    ELSE ' 27abcde' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS gst_number,
  {flawed("'abcde' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || 'f '", ("c_custkey % 97 = 0", "''"))} AS pan,
  {flawed("CAST(CAST(DATE '2021-06-01' + CAST(c_custkey % 1500 AS INTEGER) AS DATE) AS VARCHAR)", ("c_custkey % 83 = 0", "'2023/01/05'"), ("c_custkey % 71 = 0", "'2022-02-30'"))} AS registration_date
FROM customer""",
)
cte(
    "raw_gst_filings",
    f"""SELECT customer_id, {flawed("CAST(m AS VARCHAR)", ("k % 37 = 0", "'13'"), ("k % 43 = 0", "'abc'"))} AS month,
  {flawed("CAST(y AS VARCHAR)", ("k % 41 = 0", "'1999'"))} AS year,
  {flawed(rupees("sales"), ("k % 47 = 0", "'0'"))} AS gstr_sales,
  {flawed(rupees("tax"), ("k % 53 = 0", "'-12.5'"), ("k % 59 = 0", "'n/a'"))} AS tax_paid,
  {flawed("CAST(filing_date AS VARCHAR)", ("k % 61 = 0", "'2030-1-5'"))} AS filing_date,
  {flawed("CAST(is_delayed AS VARCHAR)", ("k % 67 = 0", "NULL"))} AS is_delayed FROM gst_t""",
)
cte(
    "raw_upi_transactions",
    f"""SELECT customer_id, {flawed("CAST(d AS VARCHAR)", ("dayofyear(d) % 97 = 0", "'2031-12-31'"), ("dayofyear(d) % 89 = 0", "'31-12-2024'"))} AS date,
  {flawed("dow", ("dayofyear(d) % 83 = 0", "'Wednesday-ish'"))} AS day_of_week,
  {flawed(rupees("collections"), ("(k + dayofyear(d)) % 79 = 0", "'-5'"))} AS collections,
  {flawed("CAST(txns AS VARCHAR)", ("(k + dayofyear(d)) % 73 = 0", "'0'"))} AS num_transactions,
  {flawed(rupees("ticket"), ("dayofyear(d) % 71 = 0", "NULL"))} AS avg_ticket_size FROM upi_t""",
)
cte(
    "raw_bank_statements",
    f"""SELECT customer_id, {flawed("CAST(m AS VARCHAR)", ("k % 47 = 0", "'0'"))} AS month, CAST(y AS VARCHAR) AS year,
  {flawed(rupees("credits"), ("k % 43 = 0", "'-100'"))} AS total_credits, {rupees("debits")} AS total_debits,
  {rupees("payroll")} AS payroll_paid, {flawed(rupees("opex"), ("k % 61 = 0", "'NaN'"))} AS operating_expenses,
  {rupees("tax")} AS tax_payments, {rupees("emi")} AS existing_emi, {rupees("surplus")} AS operating_surplus,
  {rupees("adb")} AS avg_daily_balance,
  {flawed("CAST(CAST(dscr AS DECIMAL(8, 2)) AS VARCHAR)", ("k % 37 = 0", "'0'"), ("k % 41 = 0", "'0.001'"))} AS dscr,
  {flawed("CAST(cheques AS VARCHAR)", ("k % 53 = 0", "'1.9'"))} AS cheque_returns,
  {flawed(rupees("cash"), ("k % 59 = 0", "'-1'"))} AS cash_withdrawals FROM bank_t""",
)
cte(
    "raw_epfo_payroll",
    f"""SELECT {flawed("customer_id", ("k % 53 = 0", "NULL"))} AS customer_id, CAST(m AS VARCHAR) AS month,
  CAST(y AS VARCHAR) AS year, {flawed("CAST(heads AS VARCHAR)", ("k % 37 = 0", "'0'"))} AS employee_count,
  {flawed(rupees("payroll"), ("k % 43 = 0", "'-7.25'"))} AS monthly_payroll, {rupees("wage")} AS avg_wage,
  {flawed("CAST(contribution_date AS VARCHAR)", ("k % 47 = 0", "'2026-01-01'"))} AS contribution_date,
  CAST(late AS VARCHAR) AS is_late_contribution, CAST(churn AS VARCHAR) AS employee_churn FROM epfo_t""",
)

INT, MONEY, FLOAT, DATE, BOOL, TEXT = "int", "money", "float", "date", "bool", "text"


def typed(field: str, kind: str) -> str:
    number = f"CASE WHEN isfinite(TRY_CAST({field} AS DOUBLE)) THEN TRY_CAST({field} AS DOUBLE) END"
    return {
        INT: f"CAST(trunc({number}) AS INTEGER)",
        MONEY: f"CAST(round_even(({number}) * 100, 0) AS BIGINT)",
        FLOAT: number,
        DATE: f"CAST(try_strptime({field}, '%Y-%m-%d') AS DATE)",
        BOOL: f"TRY_CAST({field} AS BOOLEAN)",
        TEXT: field,
    }[kind]


def failure(field: str, kind: str) -> str:
    """Reason why a raw value cannot be converted, NULL if it can."""
    missing = f"WHEN {field} IS NULL THEN '''{field}'''"
    special = f"WHEN lower({field}) = 'nan' THEN 'cannot convert float NaN to integer'"
    wrong = {
        INT: f"{special} WHEN TRY_CAST({field} AS DOUBLE) IS NULL THEN 'invalid literal for int() with base 10: ''' || {field} || ''''",
        MONEY: f"{special} WHEN TRY_CAST({field} AS DOUBLE) IS NULL THEN 'could not convert string to float: ''' || {field} || ''''",
        FLOAT: f"WHEN TRY_CAST({field} AS DOUBLE) IS NULL THEN 'could not convert string to float: ''' || {field} || ''''",
        DATE: f"WHEN NOT regexp_full_match({field}, '\\d{{4}}-\\d\\d?-\\d\\d?') THEN 'time data ''' || {field} || ''' does not match format ''%Y-%m-%d''' "
        f"WHEN try_strptime({field}, '%Y-%m-%d') IS NULL THEN 'day is out of range for month'",
        BOOL: "",
        TEXT: "",
    }[kind]
    return f"CASE {missing} {wrong} END"


def future(field: str) -> str:
    return f"CASE WHEN {field} > DATE '2025-01-01' THEN '{field} ''' || {field} || ''' is in the future' END"


def bad(when: str, text: str) -> str:
    return f"CASE WHEN {when} THEN {text} END"


def broken(when: str, text: str) -> str:
    return bad(when, f"'violates constraint: {text}'")


PERIOD_ID = "customer_id || ':' || year || '-' || lpad(CAST(month AS VARCHAR), 2, '0')"
MONTH = bad("month NOT BETWEEN 1 AND 12", "'month ' || month || ' out of range 1-12'")
YEAR = broken("year NOT BETWEEN 2000 AND 2100", "year between 2000 and 2100")


def not_negative(*names: str) -> list[str]:
    return [broken(f"{n} < 0", f"{n} >= 0") for n in names]


def too_long(name: str, size: int) -> str:
    return broken(f"length({name}) > {size}", f"{name} within {size} chars")


# table -> fields (output, raw, kind), record id, blocking messages, warnings
INGEST = {
    "customers": (
        [
            ("customer_id", "customer_id", TEXT),
            ("business_name", "business_name", TEXT),
            ("sector", "sector", TEXT),
            ("gst_number", "gst_number", TEXT),
            ("pan", "pan", TEXT),
            ("registration_date", "registration_date", DATE),
        ],
        "customer_id",
        [
            bad("business_name = ''", "'business_name is required'"),
            bad("pan = ''", "'pan is required'"),
            future("registration_date"),
            too_long("pan", 10),
        ],
        [
            bad(
                "gst_number <> 'NOT_REGISTERED' AND length(gst_number) <> 15",
                "'gst_number ''' || gst_number || ''' is ' || length(gst_number) || ' chars, expected 15 (or ''NOT_REGISTERED'' for an NTC customer)'",
            )
        ],
    ),
    "gst_filings": (
        [
            ("customer_id", "customer_id", TEXT),
            ("month", "month", INT),
            ("year", "year", INT),
            ("gstr_sales_paise", "gstr_sales", MONEY),
            ("tax_paid_paise", "tax_paid", MONEY),
            ("filing_date", "filing_date", DATE),
            ("is_delayed", "is_delayed", BOOL),
        ],
        PERIOD_ID,
        [
            MONTH,
            bad("gstr_sales_paise <= 0", "'gstr_sales must be > 0 for a GST-registered customer'"),
            bad("tax_paid_paise < 0", "'tax_paid cannot be negative'"),
            future("filing_date"),
            YEAR,
        ],
        [],
    ),
    "upi_transactions": (
        [
            ("customer_id", "customer_id", TEXT),
            ("txn_date", "date", DATE),
            ("day_of_week", "day_of_week", TEXT),
            ("collections_paise", "collections", MONEY),
            ("num_transactions", "num_transactions", INT),
            ("avg_ticket_size_paise", "avg_ticket_size", MONEY),
        ],
        "customer_id || ':' || txn_date",
        [
            bad("collections_paise < 0", "'collections cannot be negative'"),
            bad("num_transactions <= 0", "'num_transactions must be > 0'"),
            future("txn_date"),
            *not_negative("avg_ticket_size_paise"),
            too_long("day_of_week", 10),
        ],
        [],
    ),
    "bank_statements": (
        [
            ("customer_id", "customer_id", TEXT),
            ("month", "month", INT),
            ("year", "year", INT),
            ("total_credits_paise", "total_credits", MONEY),
            ("total_debits_paise", "total_debits", MONEY),
            ("payroll_paid_paise", "payroll_paid", MONEY),
            ("operating_expenses_paise", "operating_expenses", MONEY),
            ("tax_payments_paise", "tax_payments", MONEY),
            ("existing_emi_paise", "existing_emi", MONEY),
            ("operating_surplus_paise", "operating_surplus", MONEY),
            ("avg_daily_balance_paise", "avg_daily_balance", MONEY),
            ("dscr", "dscr", FLOAT),
            ("cheque_returns", "cheque_returns", INT),
            ("cash_withdrawals_paise", "cash_withdrawals", MONEY),
        ],
        PERIOD_ID,
        [
            MONTH,
            bad("dscr <= 0", "'dscr ' || dscr || ' must be > 0'"),
            bad(
                "total_credits_paise < 0 OR total_debits_paise < 0",
                "'credits/debits cannot be negative'",
            ),
            YEAR,
            broken("dscr > 0 AND CAST(dscr AS DECIMAL(8, 2)) <= 0", "dscr in NUMERIC(8,2) and > 0"),
            *not_negative("cheque_returns", "cash_withdrawals_paise"),
        ],
        [
            bad(
                "total_debits_paise > total_credits_paise",
                "'total_debits (' || total_debits_paise || ') exceeds total_credits (' || total_credits_paise || ') - cash flow anomaly'",
            )
        ],
    ),
    "epfo_payroll": (
        [
            ("customer_id", "customer_id", TEXT),
            ("month", "month", INT),
            ("year", "year", INT),
            ("employee_count", "employee_count", INT),
            ("monthly_payroll_paise", "monthly_payroll", MONEY),
            ("avg_wage_paise", "avg_wage", MONEY),
            ("contribution_date", "contribution_date", DATE),
            ("is_late_contribution", "is_late_contribution", BOOL),
            ("employee_churn", "employee_churn", INT),
        ],
        PERIOD_ID,
        [
            MONTH,
            bad("employee_count <= 0", "'employee_count must be > 0'"),
            bad("monthly_payroll_paise < 0", "'monthly_payroll cannot be negative'"),
            future("contribution_date"),
            YEAR,
        ],
        [],
    ),
}

CLEAN = {
    "business_name": "trim(business_name)",
    "gst_number": "upper(trim(gst_number))",
    "pan": "upper(trim(pan))",
    "sector": "CASE WHEN regexp_replace(trim(sector), ' +', ' ', 'g') = 'food & beverage' THEN 'Food & Beverage' "
    "ELSE array_to_string(list_transform(string_split(regexp_replace(trim(sector), ' +', ' ', 'g'), ' '), "
    "lambda w: upper(w[1]) || lower(w[2:])), ' ') END",
}

for _table, (_fields, _record, _blocking, _warnings) in INGEST.items():
    _typed = ", ".join(
        f"{CLEAN[raw] if _table == 'customers' and raw in CLEAN else typed(raw, kind)} AS {name}"
        for name, raw, kind in _fields
    )
    _extra = ", persona" if _table == "customers" else ""
    _failure = "coalesce(" + ", ".join(failure(raw, kind) for _, raw, kind in _fields) + ")"
    cte(
        f"typed_{_table}",
        f"SELECT {_typed}{_extra}, customer_id AS raw_id, {_failure} AS failure FROM raw_{_table}",
    )
    cte(
        f"checked_{_table}",
        f"""SELECT *,
  CASE WHEN failure IS NOT NULL THEN coalesce(raw_id, 'UNKNOWN') ELSE {_record} END AS record_id,
  CASE WHEN failure IS NOT NULL THEN ['transform failed: ' || failure]
    ELSE list_filter([{", ".join(_blocking)}], lambda x: x IS NOT NULL) END AS blocking,
  CASE WHEN failure IS NOT NULL OR {len(_warnings)} = 0 THEN CAST([] AS VARCHAR[])
    ELSE list_filter([{", ".join(_warnings) or "CAST(NULL AS VARCHAR)"}], lambda x: x IS NOT NULL) END AS warnings
FROM typed_{_table}""",
    )
    _out = ", ".join(
        "CAST(CAST(dscr AS DECIMAL(8, 2)) AS DOUBLE) AS dscr" if name == "dscr" else name
        for name, _, _ in _fields
    )
    oracle(
        f"normalize_{_table}",
        f"SELECT record_id, {_out}{_extra} FROM checked_{_table} WHERE len(blocking) = 0",
    )


def over_tables(select: str) -> str:
    return " UNION ALL ".join(select.replace("{t}", t) for t in INGEST)


oracle(
    "validation_errors",
    over_tables(
        "SELECT '{t}.json' AS source_file, '{t}' AS table_name, record_id AS record_identifier, "
        "CAST(i - 1 AS INTEGER) AS position, list_concat(warnings, blocking)[i] AS error_reason "
        "FROM (SELECT *, unnest(range(1, len(warnings) + len(blocking) + 1)) AS i FROM checked_{t})"
    ),
)
oracle(
    "dry_run_issues",
    over_tables(
        "SELECT '{t}' AS table_name, record_id || ': ' || unnest(list_concat(blocking, "
        "list_transform(warnings, lambda w: w || ' (warning)'))) AS issue FROM checked_{t}"
    ),
)
cte(
    "load_counts",
    over_tables(
        "SELECT '{t}' AS table_name, '{t}.json' AS source_file, count(*) AS attempted, "
        "count(*) FILTER (len(blocking) = 0) AS loaded, "
        "count(*) FILTER (len(blocking) > 0) AS skipped FROM checked_{t}"
    ),
)
oracle(
    "load_lineage",
    "SELECT *, CASE WHEN skipped = 0 THEN 'SUCCESS' WHEN loaded > 0 THEN 'PARTIAL' ELSE 'FAILED' END "
    "AS status, CASE WHEN skipped > 0 THEN skipped || ' record(s) failed validation' END "
    "AS error_message FROM load_counts",
)
oracle(
    "fk_orphans",
    " UNION ALL ".join(
        f"SELECT customer_id, count(*) AS row_count, '{name}' AS table_name FROM {source} "
        "WHERE customer_id NOT IN (SELECT customer_id FROM customers_t WHERE k % 50 <> 0) GROUP BY ALL"
        for name, source in (("gst_filings", "gst_t"), ("upi_transactions", "upi_t"),
                             ("bank_statements", "bank_t"), ("epfo_payroll", "epfo_t"))
    ),
)
oracle(
    "blocked_orphans",
    " UNION ALL ".join(
        f"""SELECT '{t}.json' AS source_file, '{t}' AS table_name, record_id AS record_identifier,
  CAST(i - 1 AS INTEGER) AS position, found[i] AS error_reason
FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (SELECT *, list_concat(warnings,
  CASE WHEN len(blocking) = 0 AND CAST(customer_id AS BIGINT) % 50 = 0
    THEN ['violates constraint: customer_id references customers'] ELSE blocking END) AS found
FROM checked_{t}))"""
        for t in INGEST
        if t != "customers"
    ),
)
cte(
    "batch_t",
    "SELECT * REPLACE (sales + ordinal * 1000 AS sales) FROM (SELECT *, "
    "unnest(CASE WHEN m % 2 = 0 THEN [1, 2] ELSE [1] END) AS ordinal FROM gst_t WHERE (k + m) % 3 = 0)",
)
oracle(
    "duplicate_keys",
    "SELECT customer_id, y AS year, m AS month, count(*) AS row_count FROM (SELECT *, "
    "unnest(CASE WHEN m % 2 = 0 THEN [1, 2] ELSE [1] END) FROM gst_t) GROUP BY customer_id, y, m HAVING count(*) > 1",
)
cte("stored_t", "SELECT * FROM gst_t WHERE k % 7 <> 0")
cte(
    "newest_t",
    "SELECT * FROM batch_t QUALIFY row_number() OVER (PARTITION BY customer_id, y, m ORDER BY ordinal DESC) = 1",
)
oracle(
    "upsert_merge",
    """SELECT coalesce(n.customer_id, s.customer_id) AS customer_id, coalesce(n.m, s.m) AS month,
  coalesce(n.y, s.y) AS year, coalesce(n.sales, s.sales) AS gstr_sales_paise,
  coalesce(n.tax, s.tax) AS tax_paid_paise, coalesce(n.filing_date, s.filing_date) AS filing_date,
  coalesce(n.is_delayed, s.is_delayed) AS is_delayed,
  CASE WHEN s.k IS NULL THEN '2025-01-01 06:00:00' ELSE '2024-12-01 06:00:00' END AS created_at,
  CASE WHEN n.k IS NULL THEN '2024-12-01 06:00:00' ELSE '2025-01-01 06:00:00' END AS updated_at
FROM stored_t s FULL JOIN newest_t n ON s.customer_id = n.customer_id AND s.y = n.y AND s.m = n.m""",
)

oracle(
    "scorecard_merge",
    """SELECT customer_id, scorecard_date,
  CASE WHEN scorecard_date = DATE '2024-07-01' THEN 0 ELSE composite_score END AS composite_score,
  CASE WHEN scorecard_date = DATE '2025-01-01' THEN '2025-01-01 06:00:00' ELSE '2024-12-01 06:00:00' END AS created_at
FROM scored_h""",
)

# --- reports ------------------------------------------------------------------------------


def or_na(x: str) -> str:
    return f"coalesce({txt(x)}, 'NA')"


def when_source(flag: str, x: str) -> str:
    return f"CASE WHEN {flag} THEN {txt(x)} ELSE 'NA' END"


def bullet_list(items: str) -> str:
    lines = f"array_to_string(list_transform({items}, lambda x: '- ' || x), chr(10))"
    return f"CASE WHEN len({items}) = 0 THEN '{wd.NO_FLAGS}' ELSE {lines} END"


def lakh(x: str, scale: str) -> str:
    return rnd(f"CAST({x} AS DOUBLE) / {scale}", 2)


cte(
    "facts_t",
    f"""SELECT customer_id, business_name AS customer_name, sector, gst_number,
  CAST(scorecard_date AS VARCHAR) AS scorecard_date, coalesce(g_n, 12) AS months, composite_score,
  score_interpretation, gst_is_gst_registered AS is_gst_registered,
  {or_na(lakh('g_min', '1e7'))} AS gst_min, {or_na(lakh('g_max', '1e7'))} AS gst_max,
  {or_na('gst_cagr_percent')} AS gst_growth, {or_na('gst_cv_percent')} AS gst_cv,
  CASE WHEN gst_cv_percent IS NULL THEN 'not available' WHEN gst_cv_percent < 15 THEN 'very stable'
    WHEN gst_cv_percent < 30 THEN 'normal, moderate volatility' WHEN gst_cv_percent < 40
    THEN 'elevated volatility' ELSE 'highly volatile' END AS cv_interpretation,
  {or_na('gst_filing_delays')} AS gst_filing_delays, {txt('upi_avg_daily_collections')} AS upi_avg_daily,
  {txt('upi_total_transactions')} AS upi_transactions_count, {txt('upi_active_days')} AS upi_active_days,
  CASE WHEN upi_active_days_percent >= 90 THEN 'consistent, near-daily activity'
    WHEN upi_active_days_percent >= 70 THEN 'regular but uneven activity'
    ELSE 'sparse, irregular activity' END AS upi_pattern_interpretation,
  aa_available AS is_aa_available,
  {when_source('aa_available', lakh('aa_avg_monthly_credits', '1e5'))} AS aa_avg_credits,
  {when_source('aa_available', lakh('aa_avg_daily_balance', '1e5'))} AS aa_adb,
  {when_source('aa_available', 'aa_dscr')} AS dscr,
  CASE WHEN aa_dscr IS NULL THEN 'not available' WHEN aa_dscr >= 1.75e0 THEN 'strong repayment capacity'
    WHEN aa_dscr >= 1.25e0 THEN 'acceptable repayment capacity'
    WHEN aa_dscr >= 1e0 THEN 'modest, borderline repayment capacity'
    ELSE 'weak repayment capacity' END AS dscr_interpretation,
  {when_source('aa_available', 'aa_cheque_return_count')} AS cheque_returns,
  {when_source('aa_available', 'aa_cash_withdrawal_percent')} AS cash_withdrawal_pct,
  epfo_available AS is_epfo_available, {or_na('epfo_employee_growth_percent')} AS employee_growth,
  {when_source('epfo_available', 'epfo_avg_monthly_payroll')} AS payroll_avg,
  {when_source('epfo_available', 'epfo_contribution_timeliness_late_count')} AS epfo_delays,
  {or_na('cross_gst_vs_aa_ratio')} AS gst_aa_ratio, {or_na('cross_gst_vs_upi_ratio')} AS gst_upi_ratio,
  {mismatch_lines()} AS cross_validation_flags, {bullet_list('red')} AS red_flags_list,
  {bullet_list('green')} AS green_flags_list, red, green FROM flagged""",
)
RATIO_FACTS = "gst_growth, gst_cv, gst_filing_delays, upi_avg_daily, upi_transactions_count, upi_active_days, aa_avg_credits, aa_adb, dscr, cheque_returns, cash_withdrawal_pct, employee_growth, payroll_avg, epfo_delays, gst_aa_ratio, gst_upi_ratio"
CITED = f"CAST(len(list_filter([{RATIO_FACTS}], lambda x: x IS NOT NULL AND x <> 'NA')) AS INTEGER)"
oracle("report_facts", f"SELECT * EXCLUDE (red, green), {CITED} AS ratios_cited FROM facts_t")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled(template: str, **values: str) -> str:
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(
        quoted(p) if i % 2 == 0 else f"coalesce(CAST({values.get(p, p)} AS VARCHAR), 'None')"
        for i, p in enumerate(parts)
        if p
    )


SECTION = (
    f"(CASE WHEN is_gst_registered THEN {filled(wd.PROMPT_GST)} ELSE {quoted(wd.PROMPT_NO_GST)} END)"
)
oracle(
    "prompt_text",
    f"SELECT customer_id, {filled(wd.PROMPT, gst_section=SECTION)} AS prompt FROM facts_t",
)


def claims(items: str, none: str) -> str:
    cited = f"array_to_string(list_transform({items}, lambda x: x || '{wd.FLAG_SOURCE}'), ' | ')"
    return f"CASE WHEN len({items}) = 0 THEN '{none}' ELSE {cited} END"


oracle(
    "fallback_narrative",
    f"""SELECT customer_id, {filled(wd.SUMMARY)} AS summary,
  (CASE WHEN dscr <> 'NA' THEN {filled(wd.HEALTH_WITH_BANK)} ELSE {filled(wd.HEALTH_WITHOUT_BANK)} END) ||
  (CASE WHEN is_gst_registered AND gst_cv <> 'NA' THEN {filled(wd.HEALTH_GST)} ELSE '' END) AS financial_health,
  {claims('green', wd.NO_STRENGTHS)} AS strengths, {claims('red', wd.NO_RISKS)} AS risks,
  CASE WHEN len(red) > 0 THEN {quoted(wd.RECOMMEND_REVIEW)} ELSE {quoted(wd.RECOMMEND_MONITORING)} END AS recommendations
FROM facts_t""",
)
oracle(
    "audit_trail",
    f"""SELECT customer_id, scorecard_date, (CASE WHEN is_gst_registered THEN 'GST, ' ELSE '' END) || 'UPI'
  || (CASE WHEN is_aa_available THEN ', AA' ELSE '' END) || (CASE WHEN is_epfo_available THEN ', EPFO' ELSE '' END)
  AS data_sources_used, {CITED} AS ratios_cited,
  CAST(3 + greatest(len(green), 1) + greatest(len(red), 1) AS INTEGER) AS total_claims FROM facts_t""",
)
oracle(
    "dimension_long",
    " UNION ALL ".join(
        f"SELECT customer_id, {i} AS position, '{d}' AS dimension, {d} AS score FROM scored"
        for i, d in enumerate(DIM_COLS.split(", "))
    ),
)
oracle(
    "cross_validation_long",
    " UNION ALL ".join(
        f"SELECT customer_id, {i} AS position, '{label}' AS metric, {or_na(f'cross_{name}_ratio')} AS ratio, "
        f"CASE WHEN cross_{name}_mismatch IS NULL THEN 'NA' WHEN cross_{name}_mismatch THEN '{wd.MISMATCH}' "
        f"ELSE '{wd.ALIGNED}' END AS status FROM recon"
        for i, (name, label) in enumerate(wd.CROSS_LABELS.items())
    ),
)
LABEL = "strftime(make_date(y, m, 1), '%b %Y') AS label"
oracle(
    "revenue_trend",
    f"""SELECT customer_id, y AS year, m AS month, {LABEL}, {rnd('CAST(sales AS DOUBLE) / 1e2', 2)} AS value,
  'gst_sales' AS series FROM gst_t WHERE k % 5 <> 0
UNION ALL SELECT customer_id, y, m, {LABEL}, {rnd('CAST(total AS DOUBLE) / 1e2', 2)}, 'upi_collections'
FROM (SELECT customer_id, CAST(year(d) AS INTEGER) AS y, CAST(month(d) AS INTEGER) AS m, sum(collections) AS total FROM upi_t
  WHERE customer_id NOT IN (SELECT customer_id FROM gst_t WHERE k % 5 <> 0) GROUP BY ALL)""",
)
oracle(
    "headcount_trend",
    f"SELECT customer_id, y AS year, m AS month, {LABEL}, CAST(heads AS DOUBLE) AS value, "
    "'employee_count' AS series FROM epfo_t",
)

oracle(
    "upi_months",
    "SELECT customer_id, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, CAST(sum(collections) AS BIGINT) AS collections_paise "
    "FROM upi_t GROUP BY ALL",
)
cte(
    "points_t",
    """SELECT customer_id, 'gst' AS source, string_agg(strftime(make_date(y, m, 1), '%b %Y') || '=' || sales, '; ' ORDER BY y, m) AS points
FROM gst_t WHERE k % 5 <> 0 GROUP BY customer_id
UNION ALL SELECT customer_id, 'upi', string_agg(strftime(first, '%b %Y') || '=' || total, '; ' ORDER BY first)
FROM (SELECT customer_id, date_trunc('month', d) AS first, sum(collections) AS total FROM upi_t GROUP BY ALL) GROUP BY customer_id
UNION ALL SELECT customer_id, 'epfo', string_agg(strftime(make_date(y, m, 1), '%b %Y') || '=' || heads * 100, '; ' ORDER BY y, m)
FROM epfo_t WHERE k % 7 <> 0 GROUP BY customer_id""",
)
oracle(
    "report_documents",
    f"""SELECT f.customer_id, CAST(f.scorecard_date AS DATE) AS scorecard_date, 'fallback' AS generation_method,
  customer_name AS business_name, {filled(wd.SUMMARY)} AS summary,
  (CASE WHEN dscr <> 'NA' THEN {filled(wd.HEALTH_WITH_BANK)} ELSE {filled(wd.HEALTH_WITHOUT_BANK)} END) ||
  (CASE WHEN is_gst_registered AND gst_cv <> 'NA' THEN {filled(wd.HEALTH_GST)} ELSE '' END) AS financial_health,
  {claims('f.green', wd.NO_STRENGTHS)} AS strengths, {claims('f.red', wd.NO_RISKS)} AS risks,
  CASE WHEN len(f.red) > 0 THEN {quoted(wd.RECOMMEND_REVIEW)} ELSE {quoted(wd.RECOMMEND_MONITORING)} END AS recommendations,
  (CASE WHEN is_gst_registered THEN 'GST | ' ELSE '' END) || 'UPI'
    || (CASE WHEN is_aa_available THEN ' | AA' ELSE '' END) || (CASE WHEN is_epfo_available THEN ' | EPFO' ELSE '' END) AS sources,
  CAST(3 + greatest(len(f.green), 1) + greatest(len(f.red), 1) AS VARCHAR) AS total_claims,
  CAST({CITED} AS VARCHAR) AS ratios_cited, CAST(f.composite_score AS VARCHAR) AS gauge,
  '[' || array_to_string([{DIM_COLS}], ',') || ']' AS scores,
  {", ".join(f"{or_na(f'cross_{name}_ratio')} AS ratio_{i}, CASE WHEN cross_{name}_mismatch IS NULL THEN 'NA' WHEN cross_{name}_mismatch THEN '{wd.MISMATCH}' ELSE '{wd.ALIGNED}' END AS status_{i}" for i, name in enumerate(wd.CROSS_LABELS))},
  CASE WHEN g.points IS NOT NULL THEN '{wd.GST_TREND_TITLE}' WHEN u.points IS NOT NULL THEN '{wd.UPI_TREND_TITLE}'
    WHEN e.points IS NOT NULL THEN '{wd.HEADCOUNT_TITLE}' END AS fourth_chart,
  coalesce(g.points, u.points, e.points) AS fourth_points,
  CASE WHEN coalesce(g.points, u.points) IS NOT NULL AND e.points IS NOT NULL THEN '{wd.HEADCOUNT_TITLE}' END AS fifth_chart,
  CASE WHEN coalesce(g.points, u.points) IS NOT NULL THEN e.points END AS fifth_points
FROM facts_t f JOIN (SELECT customer_id, {DIM_COLS}, {CROSS_COLS} FROM flagged) s ON s.customer_id = f.customer_id
LEFT JOIN points_t g ON g.customer_id = f.customer_id AND g.source = 'gst'
LEFT JOIN points_t u ON u.customer_id = f.customer_id AND u.source = 'upi'
LEFT JOIN points_t e ON e.customer_id = f.customer_id AND e.source = 'epfo'""",
)

# --- listings -----------------------------------------------------------------------------

oracle("customer_ids", "SELECT customer_id FROM customers_t ORDER BY customer_id")
oracle(
    "customer_listing",
    "SELECT customer_id, business_name, sector, persona, gst_number FROM customers_t ORDER BY customer_id",
)
oracle(
    "customer_lookup",
    """SELECT u.customer_id, c.business_name, c.sector, c.gst_number, c.customer_id IS NOT NULL AS known
FROM (SELECT DISTINCT customer_id FROM upi_t) u
LEFT JOIN (SELECT * FROM customers_t WHERE k % 50 <> 0) c ON c.customer_id = u.customer_id""",
)


def rows_text(source: str, when: str, order: str, *values: str) -> str:
    text = " || ',' || ".join([when, *[txt(x) for x in values]])
    return (
        f"coalesce((SELECT string_agg({text}, '; ' ORDER BY {order}) FROM {source} t "
        "WHERE t.customer_id = c.customer_id), '')"
    )


MONTH_TEXT = "y || '-' || lpad(CAST(m AS VARCHAR), 2, '0')"
oracle(
    "customer_financials",
    f"""SELECT customer_id, business_name,
  {rows_text('gst_t', MONTH_TEXT, 'y, m', 'sales', 'tax', 'filing_date')} AS gst_filings,
  {rows_text('upi_t', txt('d'), 'd', 'dow', 'collections')} AS upi_transactions,
  {rows_text('bank_t', MONTH_TEXT, 'y, m', 'credits', 'debits')} AS bank_statements,
  {rows_text('epfo_t', MONTH_TEXT, 'y, m', 'heads', 'payroll')} AS epfo_payroll
FROM customers_t c""",
)
oracle(
    "raw_data_counts",
    "SELECT customer_id, "
    + ", ".join(
        f"(SELECT count(*) FROM {s}_t t WHERE t.customer_id = c.customer_id) AS {s}_rows"
        for s in ("gst", "upi", "bank", "epfo")
    )
    + " FROM customers_t c",
)
cte(
    "report_t",
    """SELECT customer_id, card AS scorecard_date, 'fallback' AS generation_method,
  CAST(card AS TIMESTAMP) + to_minutes(CASE WHEN card = DATE '2025-01-01' THEN (k * 7919) % 1440 ELSE k % 600 END) AS stamp
FROM customers_t, all_cards WHERE card <> DATE '2024-07-01' OR k % 13 <> 0""",
)
STAMP = "strftime(stamp, '%Y-%m-%d %H:%M:%S') AS generated_at"
oracle(
    "scorecard_history",
    f"SELECT customer_id, scorecard_date, {CARD_COLS}, {FLAG_COLS} FROM flagged_h",
)
oracle(
    "latest_scorecard",
    "SELECT customer_id, scorecard_date, composite_score, score_interpretation FROM scored_h "
    "QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY scorecard_date DESC) = 1",
)
oracle(
    "latest_report",
    f"SELECT customer_id, {STAMP}, scorecard_date, generation_method FROM report_t "
    "QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY stamp DESC) = 1",
)
LISTED = (
    "FROM report_t r JOIN customers_t c ON c.customer_id = r.customer_id JOIN scored_h s "
    "ON s.customer_id = r.customer_id AND s.scorecard_date = r.scorecard_date"
)
SHOWN = (
    "SELECT r.customer_id || ' -- ' || c.business_name AS customer, c.sector, "
    f"r.scorecard_date AS date, s.composite_score, r.generation_method AS source, {STAMP}"
)
oracle("report_listing", f"{SHOWN} {LISTED} ORDER BY stamp DESC, r.customer_id")
oracle("recent_reports_topk", f"{SHOWN} {LISTED} ORDER BY stamp DESC, r.customer_id LIMIT 10")
oracle(
    "score_comparison",
    f"SELECT r.customer_id, r.customer_id || ' (' || c.business_name || ')' AS label, s.composite_score {LISTED} "
    "QUALIFY row_number() OVER (PARTITION BY r.customer_id ORDER BY stamp DESC) = 1 ORDER BY r.customer_id",
)
oracle(
    "report_lookup",
    f"SELECT r.customer_id, r.scorecard_date, r.generation_method, {STAMP}, s.composite_score, {FLAG_COLS} "
    "FROM report_t r JOIN flagged_h s ON s.customer_id = r.customer_id AND s.scorecard_date = r.scorecard_date",
)

# --- feed lines ---------------------------------------------------------------------------

cte(
    "lines_t",
    f"""SELECT o_orderkey AS order_key, 'part' || (o_orderkey % 7) AS source_file, o_orderkey % 101 = 0 AS corrupt,
  CAST(o_custkey AS VARCHAR) AS customer_id, month(o_orderdate) AS m, year(o_orderdate) AS y,
  {cents('o_totalprice')} AS paise, CAST(o_orderdate AS DATE) AS d
FROM orders, range(2) t(copy)
WHERE (copy = 0 OR (o_orderkey % 103 = 0 AND o_orderkey % 101 <> 0))
  AND (o_orderkey % 107 <> 0 OR o_orderkey % 101 = 0 OR o_orderkey % 103 = 0)""",
)
oracle(
    "parsed_feed_lines",
    f"""SELECT order_key, source_file, corrupt, CASE WHEN NOT corrupt THEN customer_id END AS customer_id,
  CASE WHEN NOT corrupt THEN CAST(m AS VARCHAR) END AS month, CASE WHEN NOT corrupt THEN CAST(y AS VARCHAR) END AS year,
  CASE WHEN NOT corrupt THEN {rupees('paise')} END AS gstr_sales FROM lines_t""",
)
oracle(
    "file_load_status",
    """SELECT source_file, attempted, loaded, attempted - loaded AS skipped,
  CASE WHEN attempted = loaded THEN 'SUCCESS' WHEN loaded > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status,
  CASE WHEN attempted > loaded THEN (attempted - loaded) || ' record(s) failed validation' END AS error_message
FROM (SELECT source_file, count(*) AS attempted,
  count(*) FILTER (NOT corrupt AND y BETWEEN 2000 AND 2100 AND paise > 0 AND d <= DATE '2025-01-01') AS loaded
  FROM lines_t GROUP BY ALL)""",
)
oracle(
    "incomplete_scorecards",
    "SELECT customer_id, scorecard_date, 'gst_ratios, upi_ratios, cross_validation, dimension_scores, composite_score, "
    "score_interpretation, red_flags, green_flags' AS missing FROM scored WHERE k % 17 = 0",
)
oracle(
    "customer_rows",
    """SELECT 'gst_filings' AS source, make_date(y, m, 1) AS day, sales AS paise FROM gst_t WHERE customer_id = '7'
UNION ALL SELECT 'upi_transactions', d, collections FROM upi_t WHERE customer_id = '7'""",
)
