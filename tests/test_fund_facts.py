"""All facts of funds against a plain version, on random funds with gaps, nulls and short histories."""

import datetime
import random
import statistics

import pytest

from tessera.operators import distributions as D
from tessera.operators import fund_facts as S

NAMES = list(S.REPORT)


def day(month):
    return datetime.date(2010 + month // 12, month % 12 + 1, 28)


def funds(seed, n):
    rng = random.Random(seed)
    reports, paid = [], []
    maybe = lambda value: value if rng.random() < 0.85 else None
    for k in range(n):
        months = sorted(rng.sample(range(90), rng.choice([0, 1, 5, 6, 11, 12, 40, 80])))
        for m in months:
            reports.append((k, day(m), rng.choice([rng.uniform(5, 15), rng.uniform(9, 11), 0.0]), maybe(rng.uniform(0, 900)), maybe(rng.choice([100.0, 105.0, 300.0])), maybe(float(rng.randint(0, 50))), maybe(rng.gauss(0, 0.1)), maybe(rng.uniform(0, 0.02)), rng.choice(["A", "A", "A", "B", "", None]), maybe(rng.choice([datetime.date(2005, 1, 1), datetime.date(2050, 1, 1)])), maybe(0.01), maybe(rng.choice([0.0, 500.0])), maybe(40.0), maybe(200.0), maybe(100.0), maybe(9.0)))
        for m in sorted(rng.sample(range(90), rng.choice([0, 1, 5, 6, 12, 13, 60]))):
            paid.append((k, day(m), rng.choice([0.0, 0.1, 0.2, 0.08, -0.1])))
    return reports, paid


def growth(a, b, days):
    return (b / a) ** (365.25 / days) - 1 if a > 0 and b > 0 and days > 0 else None


def brute(reports, paid, traded):
    out = {}
    rows = [dict(zip(["k", *NAMES], r, strict=True)) for r in reports]
    for k in {r["k"] for r in rows} | {p[0] for p in paid}:
        every, pays = [r for r in rows if r["k"] == k], [p[1:] for p in paid if p[0] == k]
        last, short, long, values = every[-1] if every else {}, every[-36:], every[-60:], [v for _, v in pays[-36:]]
        kept = [v for v in values if v >= 0]
        pairs = [(a, b) for a, b in zip(values, values[1:], strict=False) if a > 0]
        valued, held, run = [r for r in long if r["nav_per_share"] > 0], [r for r in long if (r["shareholder_count"] or 0) > 0], [r["administrator"] for r in long if r["administrator"]]
        issued = [r for r in long if (r["issued_shares"] or 0) > 0 and r["nav_per_share"] > 0]
        issues = [b["nav_per_share"] >= 0.97 * a["nav_per_share"] for a, b in zip(issued, issued[1:], strict=False) if b["issued_shares"] > 1.02 * a["issued_shares"]]
        returns = []
        for n, r in enumerate(short):
            if r["monthly_nav_return"] is not None:
                returns.append(r["monthly_nav_return"])
            elif n and short[n - 1]["nav_per_share"] > 0 and r["nav_per_share"] > 0:
                returns.append(r["nav_per_share"] / short[n - 1]["nav_per_share"] - 1)
        told = {(r["as_of"].year, r["as_of"].month): r["nav_per_share"] * r["monthly_distribution_yield"] for r in short if r["monthly_distribution_yield"] is not None and r["nav_per_share"] > 0}
        errors = [abs(v - e) / max(abs(v), abs(e), 1e-6) for d, v in pays[-36:] if (e := told.get((d.year, d.month))) is not None]
        months = {r["as_of"].year * 12 + r["as_of"].month for r in short}
        half = len(values) // 2
        peak = fall = 0.0
        for r in valued:
            peak = max(peak, r["nav_per_share"])
            fall = max(fall, (peak - r["nav_per_share"]) / peak)
        mean = lambda x: sum(x) / len(x)
        ratio = lambda a, b: a / b if a is not None and b else None
        age = (last["as_of"] - last["inception_date"]).days / 365.25 if last and last["inception_date"] and last["inception_date"] <= last["as_of"] else None
        total = last.get("nav_per_share", 0) * last["issued_shares"] if last and (last["net_assets"] or 0) > 0 and (last["issued_shares"] or 0) > 0 else None
        out[k] = {
            "reporting_history_months": len(every) or None, "distribution_history_months": len(pays) or None, "distribution_stability": ratio(statistics.pstdev(kept), mean(kept)) if len(kept) >= 6 else None, "positive_distribution_frequency": mean([v > 0 for v in values]) if len(values) >= 6 else None,
            "distribution_growth": ratio(mean(values[half:]) - mean(values[:half]), mean(values[:half])) if len(values) >= 12 else None, "distribution_cut_frequency": mean([b < 0.9 * a for a, b in pairs]) if len(values) >= 6 and pairs else None,
            "reporting_regularity": len(months) / (max(months) - min(months) + 1) if len(short) >= 6 else None, "report_completeness": mean([r["monthly_nav_return"] is not None and r["monthly_distribution_yield"] is not None for r in short]) if len(short) >= 6 else None,
            "nav_growth": growth(valued[0]["nav_per_share"], valued[-1]["nav_per_share"], (valued[-1]["as_of"] - valued[0]["as_of"]).days) if len(valued) >= 12 else None, "nav_return_volatility": statistics.pstdev(returns) if len(returns) >= 6 else None, "positive_nav_return_frequency": mean([v >= 0 for v in returns]) if len(returns) >= 6 else None,
            "nav_max_drawdown": fall if len(valued) >= 6 else None, "distribution_report_consistency_error": statistics.median(errors) if len(errors) >= 6 else None, "net_assets": last.get("net_assets"), "shareholder_count": last.get("shareholder_count"), "fund_age_years": age, "administration_fee_ratio": last.get("administration_fee_ratio"),
            "administrator_stability": max(0, 1 - 0.5 * sum(a != b for a, b in zip(run, run[1:], strict=False))) if len(run) >= 12 else None, "daily_traded_value": traded.get(k), **{f: ratio(last.get(c), last.get("total_assets")) for f, c in (("liability_ratio", "total_liabilities"), ("property_allocation", "property_assets"), ("credit_allocation", "credit_assets"), ("liquid_asset_ratio", "liquid_assets"))},
            "issuance_nav_preservation": (mean(issues) if issues else 1) if len(issued) >= 12 else None, "shareholder_growth": growth(held[0]["shareholder_count"], held[-1]["shareholder_count"], (held[-1]["as_of"] - held[0]["as_of"]).days) if len(held) >= 12 else None,
            "nav_total_consistency_error": abs(total - last["net_assets"]) / max(total, last["net_assets"]) if total is not None else None,
        }
    return out


TYPES = ", ".join(f"{c} {'date' if c in ('as_of', 'inception_date') else 'string' if c == 'administrator' else 'double'}" for c in S.REPORT)


def test_all_facts(spark):
    reports, paid = funds(4, 60)
    traded = {k: 10.0 * k for k in range(0, 60, 7)}
    frame = spark.createDataFrame(reports, f"k int, {TYPES}").repartition(3)
    got = S.fund_facts(frame, spark.createDataFrame(paid, "k int, ex_date date, value double").repartition(3), "k", spark.createDataFrame(list(traded.items()), "k int, traded_value double")).collect()
    wanted = brute(reports, paid, traded)
    assert len(got) == 26 * len(wanted)
    for r in got:
        value = wanted[r["k"]][r["fact"]]
        assert r["value"] == (None if value is None else pytest.approx(value, abs=1e-9)), (r, value)
        assert (r["status"], r["reason"] is None, r["confidence"] > 0, r["as_of"] is not None or r["fact"] == "daily_traded_value") == ("missing" if value is None else "valid", value is not None, value is not None, value is not None or r["fact"] == "daily_traded_value")
    valid = {r["fact"] for r in got if r["status"] == "valid"}
    assert len(valid) == 26


def test_no_rows(spark):
    nothing = spark.createDataFrame([], f"k int, {TYPES}")
    assert S.fund_facts(nothing, spark.createDataFrame([], "k int, ex_date date, value double"), "k").count() == 0


def test_dividends_by_year_against_periods(spark):
    d = datetime.date
    paid = [("a", d(y, m, 1), v, s) for y, m, v, s in [(2018, 3, 1.0, "x"), (2019, 3, 2.0, "x"), (2019, 9, 1.0, "y"), (2020, 1, 0.0, "x"), (2021, 1, 4.0, "x"), (2022, 1, 5.0, "x"), (2023, 5, 6.0, "x"), (2024, 5, -1.0, "z")]]
    paid += [("b", d(2024, 1, 1), 1.0, "x"), ("c", d(2024, 1, 1), -1.0, "x"), (None, d(2024, 1, 1), 1.0, "x")]
    periods = [("a", d(y, 12, 31), ni, sh) for y, ni, sh in [(2019, 10.0, 2.0), (2021, 3.0, 1.0), (2022, 50.0, 10.0), (2023, -4.0, 1.0), (2020, 1.0, 1.0)]] + [("a", d(2023, 6, 30), 5.0, 1.0), ("d", d(2023, 12, 31), 1.0, 1.0)]
    got = {(r["k"], r["fact"]): (r["value"], r["confidence"], r["source"], r["reason"]) for r in D.dividend_facts(spark.createDataFrame(paid, "k string, ex_date date, value double, source string"), spark.createDataFrame(periods, "k string, period_end date, net_income double, shares_outstanding double"), "k").collect()}
    assert got["a", "dividend_history_years"][:3] == (6.0, 0.85, "x,y") and got["a", "dividend_payment_frequency"][0] == 0.8
    positive = [3.0, 4.0, 5.0, 6.0]
    assert got["a", "dividend_stability"][0] == pytest.approx(statistics.pstdev(positive) / statistics.mean(positive))
    # 2019: 3 of 5 a share, 2021: 4 of 3, 2022: 5 of 5, 2023: a loss counts as no payout.
    assert got["a", "dividend_payout_sustainability"][0] == pytest.approx(2 / 3)
    assert got["b", "dividend_stability"] == (None, 0.0, None, "fewer than 3 years with distributions") and got["b", "dividend_payout_sustainability"][3] == "fewer than 3 years with a payout"
    assert {k for k, _ in got} == {"a", "b"}
