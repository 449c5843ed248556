"""Ties of the listed, rounded score."""

import duckdb

import __spark_entry__ as entry_points


def test_scores_equal_in_six_digits_are_ties(spark, tmp_path):
    # A cent of the price moves the score by 5e-8, below the digits that are listed.
    prices = [(order, 90000.0 + 0.01 * order) for order in range(1, 9)]
    rows = ", ".join(f"({order}, 1, 7, 3, 10.0, {price}, 0.05, 0.02, 'R')" for order, price in prices)
    names = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag"
    lines = spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")
    lines = lines.withColumns({c: lines[c].cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")})
    path = tmp_path / "lineitem.parquet"
    lines.coalesce(1).write.parquet(str(path))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/*.parquet'")
    wanted = connection.execute(entry_points.oracle_sql()["top_compounds"]).fetchall()
    found = entry_points.queries()["top_compounds"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted(wanted)
