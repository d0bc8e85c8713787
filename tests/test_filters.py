import datetime as dt

import pytest

from tokentally.operators.filters import Domains, Filters, invalid_values


def test_valid_filter_parses_dates():
    f = Filters(date_start="2025-12-01", date_end="2026-02-28", practices=["ML Engineering"])
    assert f.date_start == dt.date(2025, 12, 1) and f.practices == ("ML Engineering",)


@pytest.mark.parametrize("kw, msg", [
    (dict(practices=["Sales"]), "Invalid practice: 'Sales'"),
    (dict(levels=["L11"]), "Invalid level: 'L11'"),
    (dict(locations=["Mars"]), "Invalid location: 'Mars'"),
])
def test_bad_list_values(kw, msg):
    with pytest.raises(ValueError, match=msg):
        Filters(date_start="2025-12-01", date_end="2025-12-31", **kw)


def test_bad_date_text_and_order():
    with pytest.raises(ValueError):
        Filters(date_start="not-a-date", date_end="2025-12-31")
    with pytest.raises(ValueError, match="must be <="):
        Filters(date_start="2026-01-01", date_end="2025-12-31")


def test_custom_domains_and_no_validation():
    d = Domains(practices=frozenset({"AUTOMOBILE"}))
    Filters(date_start="2024-01-01", date_end="2024-01-31", practices=["AUTOMOBILE"], domains=d)
    Filters(date_start="2024-01-01", date_end="2024-01-31", practices=["anything"], domains=None)
    with pytest.raises(ValueError):
        Filters(date_start="2024-01-01", date_end="2024-01-31", practices=["Sales"], domains=d)


def test_domains_from_the_directory(spark):
    from fixtures import make_tables
    d = Domains.from_employees(make_tables(spark).employees)
    assert d.practices == frozenset({"Backend Engineering", "Frontend Engineering"})
    assert d.levels == frozenset({"L5", "L3"}) and d.locations == frozenset({"Germany", "Poland"})


def test_open_ended_dates_keep_every_row(spark):
    df = spark.createDataFrame([(dt.datetime(y, 1, 1),) for y in (1999, 2024, 2031)], "timestamp timestamp_ntz")
    years = lambda **kw: sorted(r[0].year for r in df.where(Filters(domains=None, **kw).date_predicate(df)).collect())
    assert years() == [1999, 2024, 2031]
    assert years(date_start="2024-01-01") == [2024, 2031] and years(date_end="2024-01-01") == [1999, 2024]


def test_invalid_values_against_the_directory(spark):
    emp = spark.createDataFrame([("ML", "L1", "UK")], "practice string, level string, location string")
    f = Filters(practices=("ML", "AI"), levels=("L1",), domains=None)
    assert [tuple(r) for r in invalid_values(f, emp).collect()] == [("practice", "AI")]
    assert invalid_values(Filters(domains=None), emp).count() == 0
