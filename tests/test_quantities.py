import pytest

from lotwise.functions.quantity import Grammar, money, parse_number, weight
from lotwise.operators import quantities


@pytest.mark.parametrize(
    ("text", "value"),
    [("1.234,56", 1234.56), ("1,234.56", 1234.56), ("1'234'567", 1234567), ("12 500", 12500), ("3,013", 3013), ("1,05", 1.05), ("2.5E6", 2.5e6), ("1.099E6", 1.099e6), ("0.125", 0.125), ("1 23 4", None), ("7", 7)],
)
def test_numbers(text, value):
    assert parse_number(text) == value


@pytest.mark.parametrize(
    ("text", "amount", "currencies"),
    [
        ("12,5 TEUR\x1f", 12500, ["EUR"]),
        ("3 mln\x1fPLN", 3e6, ["PLN"]),
        ("12 TEUR\x1fTEUR", 12000, ["EUR"]),
        ("kr 100\x1fSEK", 100, ["SEK"]),
        ("kr 100\x1f", 100, ["SEK", "DKK"]),
        ("2 millions d'EUR\x1f", 2e6, ["EUR"]),
        ("n.d.\x1fEUR", None, None),
        ("\x1fEUR", None, None),
        ("50%\x1f", None, None),
    ],
)
def test_money(text, amount, currencies):
    assert money(text) == (amount, currencies)


@pytest.mark.parametrize(
    ("text", "points", "bare"),
    [("35 sur 100", 3500, None), ("1000 basis points", 1000, None), ("max. 30 punti su 100", 3000, None), ("coeff. 0,10", 1000, None), ("250‰", 2500, None), ("12,5 %", 1250, None), ("40", None, 40), ("rank 2", None, None), ("1°", None, None), ("-", None, None), ("", None, None)],
)
def test_weights(text, points, bare):
    assert weight(text) == (points, bare)


def test_dimensions_and_offsets():
    g = Grammar(physical=True)
    assert g.quantity("90 km/h").value == pytest.approx(25) and g.quantity("90 km/h").dims == (0, 1, 0, -1, 0)
    assert g.quantity("20 °C").value == pytest.approx(293.15)
    assert g.quantity("3 furlongs") is None
    assert g.quantity("5 W/°C").value == pytest.approx(5) and g.quantity("3 J/°C").value == pytest.approx(3)  # of differences
    assert g.quantity("2 kN").value == pytest.approx(2000) and g.quantity("3 kWh").value == pytest.approx(1.08e7) and g.quantity("4 cm").value == pytest.approx(0.04)


def test_tables(spark):
    rates = spark.createDataFrame([("EUR", 1.0), ("DKK", 0.5), ("SEK", 0.1)], "currency string, eur_per_unit double")
    countries = spark.createDataFrame([("DNK", "DKK"), ("SWE", "SEK")], "country string, currency string")
    rows = [(1, "kr 100", None, "DNK"), (2, "100", None, "SWE"), (3, "100", "EUR", None), (4, None, "EUR", "DNK"), (5, "100", None, None), (6, "100", "CHF", "DNK"), (1, "kr 100", None, "DNK")]
    df = spark.createDataFrame(rows, "id int, value string, currency string, country string").withColumn("m", quantities.parsed_money(_c("value"), _c("currency")))
    got = sorted((r.id, r.qty) for r in quantities.in_euros(df, "m", "country", countries, rates).collect())
    assert got == [(1, 50), (1, 50), (2, 10), (3, 100)]
    assert "currency" in quantities.in_euros(df, "m", "country", countries, rates).columns
    crit = spark.createDataFrame(
        [(1, "p", "a", 1, "30"), (2, "p", "a", 2, "10"), (2, "p", "a", 2, "10"), (3, "p", "b", 1, "50 %"), (4, "p", None, 1, "5"), (5, "p", "c", 1, None), (6, "p", "d", 1, "0")],
        "id int, pub string, lot string, seq int, weight string",
    )
    got = sorted((r.id, r.qty) for r in quantities.in_basis_points(crit, "weight", ["pub", "lot"], "seq").collect())
    assert got == [(1, 7500), (2, 2500), (2, 2500), (3, 5000)]
    assert quantities.in_basis_points(crit.limit(0), "weight", ["pub", "lot"], "seq").count() == 0


def _c(name):
    from pyspark.sql import functions as F

    return F.col(name)
