"""Currency routes against a search of each session's graph."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from eventide.operators import routes

D = [date(2024, 1, 1) + timedelta(i) for i in range(12)]


def searched(quotes, origins, carry, hops):
    """Shortest routes by looking at all of them."""
    out = {}
    pairs = {(b, q) for _, b, q, _ in quotes}
    for i, d in enumerate(D):
        edges = {}
        for b, q in pairs:
            for back in range(carry + 1):
                own = [r for s, x, y, r in quotes if (x, y) == (b, q) and i - back >= 0 and s == D[i - back] and r]
                if own:
                    rate = sum(own) / len(own)
                    edges.setdefault((b, q), []).append(rate)
                    edges.setdefault((q, b), []).append(1 / rate)
                    break
        for o in origins:
            level, known = {o: (1.0, 0, o)}, {o: (1.0, 0, o)}
            for _ in range(hops):
                new = {}
                for c, (rate, n, route) in level.items():
                    for (b, q), rates in edges.items():
                        if b == c and q not in known and (q not in new or route + ">" + q < new[q][2]):
                            new[q] = (rate * sum(rates) / len(rates), n + 1, route + ">" + q)
                known |= new
                level = new
            out |= {(d, o, c): v for c, v in known.items()}
    return out


@pytest.mark.parametrize("carry, hops", [(0, 2), (3, 4)])
def test_routes(spark, carry, hops):
    rnd = random.Random(carry)
    names = ["ARS", "BRL", "EUR", "GBP", "USD", "UYU"]
    quotes = [(d, *rnd.sample(names, 2), rnd.uniform(0.5, 2)) for d in D for _ in range(3)] + [(D[0], "XAU", "XAG", 80.0), (D[1], "USD", "USD", 3.0), (D[1], "USD", "EUR", None)]
    sessions = spark.createDataFrame([(d,) for d in D], "session date")
    got = routes.routes(spark.createDataFrame(quotes, routes.QUOTES), sessions, ["ARS", "EUR"], carry, hops)
    quotes = [q for q in quotes if q[1] != q[2] and q[3]]
    want = searched(quotes, ["ARS", "EUR"], carry, hops)
    rows = {(r["session"], r["origin"], r["currency"]): (r["rate"], r["n_hops"], r["route"]) for r in got.collect()}
    assert rows.keys() == want.keys()
    for k, (rate, n, route) in want.items():
        assert rows[k] == (pytest.approx(rate), n, route)
    with pytest.raises(ValueError, match="no quoted route to USD from XAU"):
        routes.require_routes(got, ["ARS", "XAU"], "USD")


def test_conversion(spark):
    local = spark.createDataFrame([(D[0], 3000.0), (D[1], 0.0)], "session date, close double")
    adr = spark.createDataFrame([(D[0], 30.0), (D[1], 31.0)], "session date, close double")
    quotes = routes.listing_quotes(local, adr, "ARS", "USD", 10.0).unionByName(spark.createDataFrame([(D[0], "USD", "EUR", 0.5)], routes.QUOTES))
    assert [r["rate"] for r in quotes.where("base = 'ARS'").collect()] == [0.001]
    bars = spark.createDataFrame([("A", D[0], 1000.0), ("A", D[4], 1000.0), ("B", D[0], 2.0)], "ticker string, session date, close double")
    rates = routes.routes(quotes, bars, ["ARS", "EUR"], carry=0)
    out = routes.converted(bars, rates, F.when(F.col("ticker") == "A", "ARS").otherwise("EUR"), "EUR", ("close",))
    assert sorted((r["ticker"], r["session"], r["close"], r["route"]) for r in out.collect()) == [("A", D[0], 0.5, "ARS>USD>EUR"), ("A", D[4], None, None), ("B", D[0], 2.0, "EUR")]
