"""The catalogue against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tessera.plans.oracles import SQL
from tessera.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
#: The SQL of these has sets of up to three items; on the smallest tables larger ones are frequent.
SETS_OF_THREE = {"fp_rules", "fpgrowth_itemsets"}
#: No SQL expresses these; tests below and in test_operators.py hold them against something else.
WITHOUT_SQL = {"als_rmse", "als_rmse_sweep", "bernoulli_split", "kmeans_cost_sweep"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_all_others_have_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    sf = SF.replace("0.001", "0.01") if name in SETS_OF_THREE else SF
    got = QUERIES[name](spark, sf).toPandas()
    db = duckdb.connect()
    for f in os.listdir(sf):
        db.sql(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    want = db.sql(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = lambda df: df[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, rtol=1e-5, atol=2e-5)


def test_bernoulli_split(spark):
    """Both parts together are the ratings, about four fifths in the first."""
    from tessera.plans import inputs

    rated = inputs.ratings(spark, SF).toPandas()
    got = QUERIES["bernoulli_split"](spark, SF).toPandas().set_index("part")["n"]
    assert got["train"] + got["test"] == len(rated)  # user and item are a key, so no row is subtracted by value
    assert abs(got["train"] - 0.8 * len(rated)) < 5 * (0.16 * len(rated)) ** 0.5


def test_als_rmse_from_its_factors(spark):
    from tessera.operators import recommend
    from tessera.plans import inputs

    train, test = recommend.hash_split(inputs.ratings(spark, SF))
    model = recommend.als(train, 5, 5, 0.1)
    users, items = ({r["id"]: r["features"] for r in f.collect()} for f in (model.userFactors, model.itemFactors))
    errors = [sum(a * b for a, b in zip(users[r["user"]], items[r["item"]], strict=True)) - r["rating"] for r in test.collect() if r["user"] in users and r["item"] in items]
    want = (sum(e * e for e in errors) / len(errors)) ** 0.5
    assert QUERIES["als_rmse"](spark, SF).first()["rmse"] == pytest.approx(want, rel=1e-4)


def test_als_finds_factors(spark):
    """Ratings that are products of two numbers are predicted where they were left out."""
    from tessera.operators import recommend

    rows = [(u, i, (1 + u % 4) * (1 + i % 3) / 2.0) for u in range(40) for i in range(25)]
    train, test = recommend.hash_split(spark.createDataFrame(rows, "user int, item int, rating double"))
    assert recommend.rmse(recommend.als(train, 3, 10, 0.01).transform(test)).first()["rmse"] < 0.1
