"""The box of a pose is that of all its ligand atoms, whatever their element."""

from pyspark.sql import types as T

import __spark_entry__ as entry_points


def test_box_holds_every_element(spark, tmp_path):
    fields = "l_orderkey l_linenumber l_partkey l_suppkey l_extendedprice l_quantity l_discount".split()
    kinds = [T.LongType()] * 4 + [T.DoubleType()] * 3
    schema = T.StructType([T.StructField(n, k) for n, k in zip(fields, kinds, strict=True)])
    # Ligands have order and line number add up to a multiple of three; 3 modulo 8 is oxygen, 0 and 4 are not.
    ligands = [(5, 1, 3, 1, 10.0, 10.0, 0.0), (5, 4, 8, 1, 30.0, 10.0, 0.0), (10, 2, 4, 1, 40.0, 30.0, 0.0)]
    receptors = [(20, 2, p, 1, x, y, 0.0) for p, x, y in [(3, 12.0, 12.0), (5, 32.0, 9.0), (6, 38.0, 28.0), (7, 49.0, 49.0)]]
    spark.createDataFrame(ligands + receptors, schema).write.parquet(str(tmp_path / "lineitem.parquet"))

    def place(row):
        order, _, part, _, price, quantity, discount = row
        return round(price * 100) % 5000 / 100, quantity + discount * 10, (part * 37 + order * 11) % 5000 / 100

    own = list(zip(*map(place, ligands), strict=True))
    inside = [
        p for p in map(place, receptors) if all(min(side) - 4 < v < max(side) + 4 for v, side in zip(p, own, strict=True))
    ]
    [found] = entry_points.queries()["bbox_filter"](spark, str(tmp_path)).collect()
    assert (found.target, found.pose, found.n_inside) == ("t1", 0, len(inside)) and len(inside) == 3
    assert (found.min_x, found.max_z) == (min(p[0] for p in inside), max(p[2] for p in inside))
