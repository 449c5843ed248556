"""Stand-in views: the driver's tables in the roles of screening data.

Each view is one SELECT that Spark and DuckDB both run. Every row of the
table takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dockspan.operators.sizing import spread

POSE_SCORES = """
SELECT concat('t', l_suppkey % 10) AS target,
       concat('c', l_orderkey, '_out_pose', l_linenumber, '.pdbqt') AS compound_id,
       l_orderkey, l_linenumber, l_partkey, l_suppkey,
       l_extendedprice / CAST(131072.0 AS DOUBLE) AS ps, l_quantity / CAST(64.0 AS DOUBLE) AS pb,
       concat(CASE WHEN l_returnflag = 'R' THEN 'active' ELSE 'decoy' END,
              '_', l_orderkey, '_', l_linenumber) AS lib_id
FROM lineitem
"""
POSE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ps"]

FEATURES = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       l_quantity AS f_quantity, l_extendedprice AS f_price,
       CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount END AS f_discount, l_tax AS f_tax
FROM lineitem
"""
# Scores of which some are missing, by the row's part.
SOME_MISSING = """CASE l_partkey % 50 WHEN 5 THEN NULL WHEN 7 THEN CAST('NaN' AS DOUBLE) ELSE {0} END"""

FEATURE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

SCREEN = """
SELECT o_orderpriority AS target, o_orderkey AS id,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
       CASE o_orderkey % 89 WHEN 5 THEN NULL WHEN 7 THEN CAST('NaN' AS DOUBLE)
         ELSE CAST(o_totalprice AS DOUBLE) END AS score
FROM orders
"""

PAIRS = """
SELECT n_name AS target, c_custkey AS id,
       CASE c_custkey % 41 WHEN 5 THEN NULL WHEN 7 THEN CAST('NaN' AS DOUBLE)
         ELSE CAST(c_acctbal AS DOUBLE) END AS pred,
       round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS measured
FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name, c_custkey, c_acctbal
"""

# Atoms in a box of 50 length units; the number of targets follows the table.
ATOMS = """
SELECT concat('t', l_suppkey) AS target,
       CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN 'ligand' ELSE 'receptor' END AS side,
       l_orderkey % 5 AS pose,
       l_orderkey * 1000000000 + l_linenumber * 100000000
         + CAST(round(l_extendedprice * 100) AS BIGINT) AS atom_id,
       CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 5000 AS DOUBLE) / 100 AS x,
       l_quantity + l_discount * 10 AS y,
       CAST((l_partkey * 37 + l_orderkey * 11) % 5000 AS DOUBLE) / 100 AS z,
       (l_discount - 0.05) * 10 AS charge,
       CASE l_partkey % 8 WHEN 0 THEN 'C' WHEN 1 THEN 'A' WHEN 2 THEN 'N' WHEN 3 THEN 'OA'
            WHEN 4 THEN 'HD' WHEN 5 THEN 'SA' WHEN 6 THEN 'NA' ELSE 'CL' END AS atom_type,
       CASE l_partkey % 8 WHEN 0 THEN 'C' WHEN 1 THEN 'C' WHEN 2 THEN 'N' WHEN 3 THEN 'O'
            WHEN 4 THEN 'H' WHEN 5 THEN 'S' WHEN 6 THEN 'N' ELSE 'CL' END AS element,
       CASE l_linenumber WHEN 1 THEN 'N' WHEN 2 THEN 'CA' WHEN 3 THEN 'C' WHEN 4 THEN 'O'
            WHEN 5 THEN 'CB' WHEN 6 THEN 'CG' ELSE 'HA' END AS name,
       CASE l_orderkey % 4 WHEN 0 THEN 'ALA' WHEN 1 THEN 'PHE' WHEN 2 THEN 'LYS' ELSE 'UNK' END
         AS resname,
       CASE l_partkey % 7 WHEN 0 THEN 'C;4;2;2;0;0' WHEN 1 THEN 'C;4;2;1;1;1'
            WHEN 2 THEN 'N;3;2;1;0;0' WHEN 3 THEN 'O;2;1;0;0;0' WHEN 4 THEN 'S;2;2;0;0;0'
            WHEN 5 THEN 'X;0;0;0;0;0' ELSE 'H;1;1;0;0;0' END AS ligand_type,
       CASE l_orderkey % 3 WHEN 0 THEN 'ALPHA' WHEN 1 THEN 'BETA' ELSE 'OTHER' END AS structure
FROM lineitem
"""

# Points of the embeddings table; float32 values are widened before use.
POINTS = """
SELECT vec_id, concat('t', CAST(floor(vec_id / 2) AS BIGINT) % 2) AS target,
       CASE WHEN vec_id % 2 = 0 THEN 'ligand' ELSE 'receptor' END AS side,
       CAST({e1} AS DOUBLE) * 10 AS x, CAST({e2} AS DOUBLE) * 10 AS y,
       CAST({e3} AS DOUBLE) * 10 AS z, CAST({e4} AS DOUBLE) AS charge,
       concat('T', label) AS atom_type
FROM embeddings
"""

# Small molecules, about four per part: a hexagon with one substituent (even
# keys) or a centre with four arms and two further atoms (odd keys), turned and
# placed by the key. The line numbers present are the atoms present.
MOLECULES = """
WITH slots AS (SELECT DISTINCT l_partkey * 4 + l_suppkey % 4 AS o, l_linenumber AS n FROM lineitem),
shaped AS (
  SELECT o, n,
    CASE WHEN o % 2 = 0
      THEN CASE n WHEN 1 THEN 1.4 WHEN 2 THEN 0.7 WHEN 3 THEN -0.7 WHEN 4 THEN -1.4
                  WHEN 5 THEN -0.7 WHEN 6 THEN 0.7 ELSE 2.8 END
      ELSE CASE n WHEN 1 THEN 0.0 WHEN 2 THEN 0.8 WHEN 3 THEN -0.8 WHEN 4 THEN 0.8
                  WHEN 5 THEN -0.8 WHEN 6 THEN 2.1 ELSE -2.1 END END AS u,
    CASE WHEN o % 2 = 0
      THEN CASE n WHEN 1 THEN 0.0 WHEN 2 THEN 1.2124 WHEN 3 THEN 1.2124 WHEN 4 THEN 0.0
                  WHEN 5 THEN -1.2124 WHEN 6 THEN -1.2124 ELSE 0.0 END
      ELSE CASE n WHEN 1 THEN 0.0 WHEN 2 THEN 0.8 WHEN 3 THEN -0.8 WHEN 4 THEN -0.8
                  WHEN 5 THEN 0.8 WHEN 6 THEN 0.9 ELSE -0.9 END END AS v,
    CASE WHEN o % 2 = 0 THEN 0.0
      ELSE CASE n WHEN 1 THEN 0.0 WHEN 2 THEN 0.8 WHEN 3 THEN 0.8 WHEN 4 THEN -0.8
                  WHEN 5 THEN -0.8 WHEN 6 THEN 0.9 ELSE 0.9 END END AS w
  FROM slots)
SELECT CAST(floor(o / 100) AS BIGINT) AS target, o AS pose, n AS idx,
  CASE WHEN CAST(floor(o / 2) AS BIGINT) % 2 = 0 THEN 'ligand' ELSE 'receptor' END AS side,
  CAST((o * 7919) % 2000 AS DOUBLE) / 100 + CAST(
    CASE o % 5 WHEN 0 THEN u WHEN 1 THEN v WHEN 2 THEN 0.6 * u - 0.8 * v WHEN 3 THEN w
               ELSE 0.8 * u - 0.6 * w END AS DOUBLE) AS x,
  CAST((o * 10473) % 2000 AS DOUBLE) / 100 + CAST(
    CASE o % 5 WHEN 0 THEN v WHEN 1 THEN w WHEN 2 THEN 0.8 * u + 0.6 * v WHEN 3 THEN u
               ELSE v END AS DOUBLE) AS y,
  CAST((o * 13331) % 2000 AS DOUBLE) / 100 + CAST(
    CASE o % 5 WHEN 0 THEN w WHEN 1 THEN u WHEN 2 THEN w WHEN 3 THEN v
               ELSE 0.6 * u + 0.8 * w END AS DOUBLE) AS z,
  CASE WHEN o % 2 = 0
    THEN CASE WHEN n = 7 THEN CASE o % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'N' ELSE 'H' END
              WHEN n = 2 AND o % 3 = 0 THEN 'N' ELSE 'C' END
    ELSE CASE WHEN n = 1 THEN CASE CAST(floor(o / 4) AS BIGINT) % 5 WHEN 0 THEN 'N'
                WHEN 1 THEN 'C' WHEN 2 THEN 'P' WHEN 3 THEN 'S' ELSE 'ZN' END
              WHEN n <= 3 THEN CASE CAST(floor(o / 20) AS BIGINT) % 3 WHEN 0 THEN 'O'
                WHEN 1 THEN 'N' ELSE 'C' END
              WHEN n <= 5 THEN CASE CAST(floor(o / 60) AS BIGINT) % 3 WHEN 0 THEN 'O'
                WHEN 1 THEN 'C' ELSE 'N' END
              ELSE CASE WHEN o % 3 = 0 THEN 'C' ELSE 'H' END END END AS element,
  CASE CAST(floor(o / 4) AS BIGINT) % 4
    WHEN 0 THEN CASE WHEN o % 2 = 0 THEN 'PHE' ELSE 'LYS' END
    WHEN 1 THEN CASE WHEN o % 2 = 0 THEN 'TYR' ELSE 'ARG' END
    WHEN 2 THEN CASE WHEN o % 2 = 0 THEN 'HIS' ELSE 'GLU' END
    ELSE CASE WHEN o % 2 = 0 THEN 'TRP' ELSE 'ASP' END END AS resname,
  CASE WHEN o % 2 = 0
    THEN CASE CAST(floor(o / 4) AS BIGINT) % 4
      WHEN 2 THEN CASE n WHEN 1 THEN 'CG' WHEN 2 THEN 'ND1' WHEN 3 THEN 'CE1' WHEN 4 THEN 'NE2'
                         WHEN 5 THEN 'CD2' WHEN 6 THEN 'CB' ELSE 'HE2' END
      WHEN 3 THEN CASE n WHEN 1 THEN 'CE2' WHEN 2 THEN 'CD2' WHEN 3 THEN 'CE3' WHEN 4 THEN 'CZ3'
                         WHEN 5 THEN 'CH2' WHEN 6 THEN 'CZ2' ELSE 'CG' END
      ELSE CASE n WHEN 1 THEN 'CG' WHEN 2 THEN 'CD1' WHEN 3 THEN 'CE1' WHEN 4 THEN 'CZ'
                  WHEN 5 THEN 'CE2' WHEN 6 THEN 'CD2' ELSE 'CB' END END
    ELSE CASE CAST(floor(o / 4) AS BIGINT) % 4
      WHEN 0 THEN CASE n WHEN 1 THEN 'NZ' WHEN 2 THEN 'HZ1' WHEN 3 THEN 'HZ2' ELSE 'CE' END
      WHEN 1 THEN CASE n WHEN 1 THEN 'CZ' WHEN 2 THEN 'NH1' WHEN 3 THEN 'NH2' ELSE 'CD' END
      WHEN 2 THEN CASE n WHEN 1 THEN 'CD' WHEN 2 THEN 'OE1' WHEN 3 THEN 'OE2' ELSE 'CG' END
      ELSE CASE n WHEN 1 THEN 'CG' WHEN 2 THEN 'OD1' WHEN 3 THEN 'OD2' ELSE 'CB' END END
    END AS name,
  CASE o % 3 WHEN 0 THEN 'ALPHA' WHEN 1 THEN 'BETA' ELSE '' END AS structure
FROM shaped
"""

SEQUENCE = """
SELECT user_id AS grp, ts, event_id, event_type, value FROM events
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run a view's SQL over the named parquet tables."""
    return bound_view(spark, sql, **{t: table(spark, sf_dir, t) for t in tables})


def bound_view(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Run a view's SQL over given frames, batch or streaming."""
    return spark.sql(_braced(sql, tuple(tables)), **tables)


def _braced(sql: str, tables: tuple[str, ...]) -> str:
    words = sql.replace("{", "{{").replace("}", "}}")
    for name in tables:
        for verb in ("FROM", "JOIN"):
            words = words.replace(f"{verb} {name}\n", f"{verb} {{{name}}}\n")
            words = words.replace(f"{verb} {name} ", f"{verb} {{{name}}} ")
            words = words.replace(f"{verb} {name})", f"{verb} {{{name}}})")
    return words


def spread_view(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    """A view over one table whose rows feed heavy per-row work."""
    return bound_view(spark, sql, **{name: spread(table(spark, sf_dir, name))})


def pose_scores(spark, sf_dir):
    return spread_view(spark, sf_dir, POSE_SCORES, "lineitem")


def features(spark, sf_dir):
    return spread_view(spark, sf_dir, FEATURES, "lineitem")


def screen(spark, sf_dir):
    return view(spark, sf_dir, SCREEN, "orders")


def pairs(spark, sf_dir):
    return view(spark, sf_dir, PAIRS, "customer", "orders", "nation")


def atoms(spark, sf_dir):
    return spread_view(spark, sf_dir, ATOMS, "lineitem")


def molecules(spark, sf_dir):
    return spread_view(spark, sf_dir, MOLECULES, "lineitem")


def sequence(spark, sf_dir):
    return view(spark, sf_dir, SEQUENCE, "events")


def points(spark, sf_dir):
    fields = {f"e{k}": f"embedding[{k - 1}]" for k in range(1, 5)}
    return view(spark, sf_dir, POINTS.format(**fields), "embeddings")


POINTS_SQL = POINTS.format(**{f"e{k}": f"embedding[{k}]" for k in range(1, 5)})
