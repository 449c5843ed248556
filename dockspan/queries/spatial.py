"""Distance joins and contact families over the atoms view."""

from __future__ import annotations

from pyspark.sql import functions as F

from dockspan.functions import vectors as V
from dockspan.functions.atoms import element_of_name
from dockspan.functions.columns import column
from dockspan.functions.fixed_values import (
    ATOM_KEYS,
    COUNTED_LIGAND_TYPES,
    LIGAND_TYPE_KEYS,
    PROTEIN_TYPE_KEYS,
)
from dockspan.functions.literals import literal_table
from dockspan.operators import contacts, features, spatial, typed_pairs as typed
from dockspan.operators.durable import scratch_table, stored as stored_table
from dockspan.plans import extraction
from dockspan.queries.registry import ORACLES, query, rounded
from dockspan.queries.views import ATOMS, atoms
from dockspan.sources.features import read_atom_keys

POSE = ["target", "pose"]
ATOMS_SQL = f"WITH atoms AS ({ATOMS})"
GAP = "sqrt((l.x-r.x)*(l.x-r.x)+(l.y-r.y)*(l.y-r.y)+(l.z-r.z)*(l.z-r.z))"


def pairs_sql(radius: float, test: str = "<", where: str = "TRUE") -> str:
    return f""", pairs AS (SELECT l.target, l.pose, l.atom_id, r.atom_id AS r_atom_id, l.charge,
      r.charge AS r_charge, l.element, r.element AS r_element, r.structure,
      CASE WHEN r.name IN ('CA', 'C', 'O', 'N') THEN 'BACKBONE' ELSE 'SIDECHAIN' END AS chain_side,
      concat_ws('_', least(l.atom_type, r.atom_type), greatest(l.atom_type, r.atom_type)) AS pair,
      l.x, l.y, l.z, r.x AS rx, r.y AS ry, r.z AS rz,
      l.ligand_type, r.resname, r.name AS r_name, {GAP} AS dist
    FROM atoms l JOIN atoms r ON l.target = r.target
    WHERE l.side = 'ligand' AND r.side = 'receptor' AND {GAP} {test} {radius}::DOUBLE AND {where})"""


def sides(spark, sf_dir, stored=False):
    """Ligand and receptor atoms; stored first if a query reads them many times."""
    rows = atoms(spark, sf_dir)
    rows = stored_table(rows, "atoms") if stored else rows
    ligands = rows.filter("side = 'ligand'").drop("side")
    receptors = rows.filter("side = 'receptor'").drop("side", "pose")
    return ligands, receptors


def contact_rows(spark, sf_dir, radius=contacts.CLOSE):
    ligands, receptors = sides(spark, sf_dir)
    return contacts.contact_pairs(ligands, receptors, radius=radius)


@query(
    "distance_join",
    ATOMS_SQL
    + pairs_sql(6.0, "<=")
    + "SELECT target, atom_id, r_atom_id, round(dist, 6) AS dist FROM pairs",
)
def distance_join(spark, sf_dir):
    ligands, receptors = sides(spark, sf_dir)
    keep = ["target", "atom_id", "x", "y", "z"]
    found = spatial.distance_join(
        ligands.select(*keep),
        spatial.prefixed(receptors.select(*keep), "r_", ["target"]),
        6.0,
        ["target"],
        inclusive=True,
    )
    return rounded(found.select("target", "atom_id", "r_atom_id", "dist"))


@query(
    "contact_counts",
    ATOMS_SQL
    + pairs_sql(4.0)
    + """SELECT target, pose, pair, count(*) FILTER (WHERE dist < 2.5) AS closest,
      count(*) FILTER (WHERE dist >= 2.5) AS close FROM pairs GROUP BY ALL""",
)
def contact_counts(spark, sf_dir):
    return contacts.contact_counts(contact_rows(spark, sf_dir), POSE)


@query(
    "coulomb_sum",
    ATOMS_SQL
    + pairs_sql(4.0)
    + """SELECT target, pose, pair,
      round(sum(charge * r_charge / nullif(dist, 0) * 1389423.8460104697::DOUBLE), 3) AS energy
    FROM pairs GROUP BY target, pose, pair""",
)
def coulomb_sum(spark, sf_dir):
    return rounded(contacts.coulomb_sums(contact_rows(spark, sf_dir), POSE), digits=3)


@query(
    "contact_categories",
    ATOMS_SQL
    + pairs_sql(4.0)
    + """SELECT target, pose, chain_side, structure, count(*) AS contacts,
      count(*) FILTER (WHERE element = 'C' AND r_element = 'C') AS carbon_contacts
    FROM pairs GROUP BY ALL""",
)
def contact_categories(spark, sf_dir):
    return contacts.contact_categories(contact_rows(spark, sf_dir), POSE)


@query(
    "ligand_type_flags",
    ATOMS_SQL
    + """SELECT target, pose, count(*) AS n_atoms,
      CASE WHEN count(*) FILTER (WHERE atom_type = 'N') > 0 THEN 1 ELSE 0 END AS la_n,
      CASE WHEN count(*) FILTER (WHERE atom_type = 'HD') > 0 THEN 1 ELSE 0 END AS la_hd
    FROM atoms WHERE side = 'ligand' GROUP BY target, pose""",
)
def ligand_type_flags(spark, sf_dir):
    ligands, _ = sides(spark, sf_dir)
    return contacts.ligand_type_flags(ligands, POSE)


@query(
    "bbox_filter",
    ATOMS_SQL
    + """, boxes AS (SELECT target, pose, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1,
        min(z) AS z0, max(z) AS z1 FROM atoms
        WHERE side = 'ligand' GROUP BY target, pose)
    SELECT b.target, b.pose, count(*) AS n_inside, round(min(a.x), 6) AS min_x,
      round(max(a.z), 6) AS max_z
    FROM boxes b JOIN atoms a ON a.target = b.target AND a.side = 'receptor'
      AND a.x > x0 - 4 AND a.x < x1 + 4 AND a.y > y0 - 4 AND a.y < y1 + 4
      AND a.z > z0 - 4 AND a.z < z1 + 4
    GROUP BY b.target, b.pose""",
)
def bbox_filter(spark, sf_dir):
    ligands, receptors = sides(spark, sf_dir)
    boxes = spatial.bounding_box(ligands, POSE)
    inside = spatial.inside_box(receptors, boxes, ["target"], 4.0)
    return rounded(
        inside.groupBy(*POSE).agg(
            F.count(F.lit(1)).alias("n_inside"),
            F.min("x").alias("min_x"),
            F.max("z").alias("max_z"),
        )
    )


# Wider limits than the defaults: hydrogens are sparse in this view.
HB = {"radius": 6.0, "reach": 3.0, "max_bend": 60.0}


@query(
    "hbond_join",
    ATOMS_SQL
    + pairs_sql(
        6.0, where="l.element IN ('N', 'O') AND r.element IN ('N', 'O')"
    )
    + """, near AS (
      SELECT p.*, 'LIGAND' AS donor, h.x AS hx, h.y AS hy, h.z AS hz, p.x AS ax, p.y AS ay, p.z AS az
      FROM pairs p JOIN atoms h ON h.target = p.target AND h.pose = p.pose AND h.side = 'ligand'
        AND h.element = 'H'
      UNION ALL
      SELECT p.*, 'RECEPTOR' AS donor, h.x, h.y, h.z, p.rx, p.ry, p.rz
      FROM pairs p JOIN atoms h ON h.target = p.target AND h.side = 'receptor' AND h.element = 'H'),
    reached AS (SELECT *, (x-hx)*(rx-hx)+(y-hy)*(ry-hy)+(z-hz)*(rz-hz) AS dot,
        sqrt((x-hx)*(x-hx)+(y-hy)*(y-hy)+(z-hz)*(z-hz)) AS m1,
        sqrt((rx-hx)*(rx-hx)+(ry-hy)*(ry-hy)+(rz-hz)*(rz-hz)) AS m2
      FROM near WHERE sqrt((ax-hx)*(ax-hx)+(ay-hy)*(ay-hy)+(az-hz)*(az-hz)) < 3)
    SELECT target, pose, donor, chain_side, structure, count(*) AS bonds FROM reached
    WHERE abs(180 - degrees(acos(greatest(-1, least(1, dot / nullif(m1 * m2, 0)))))) <= 60
      AND m1 > 0 AND m2 > 0
    GROUP BY ALL""",
)
def hbond_join(spark, sf_dir):
    ligands, receptors = sides(spark, sf_dir, stored=True)
    bonds = contacts.hydrogen_bonds(ligands, receptors, POSE, **HB)
    return contacts.hydrogen_bond_counts(bonds, POSE)


@query(
    "bond_features",
    f"""SELECT target, pose, concat_ws(' ', 'HB', structure, chain_side, donor) AS feature,
      CAST(bonds AS DOUBLE) AS value FROM ({ORACLES['hbond_join']})""",
)
def bond_features(spark, sf_dir):
    ligands, receptors = sides(spark, sf_dir, stored=True)
    bonds = contacts.hydrogen_bonds(ligands, receptors, POSE, **HB)
    return extraction.bond_features(bonds, POSE)


KEYS_SQL = ", ".join(f"('{a}', '{k}')" for a, k in ATOM_KEYS)
TYPED = f""", atom_keys(pdb_atom, type_key) AS (VALUES {KEYS_SQL}),
typed AS (SELECT p.target, p.pose,
    replace(concat_ws('-', k.type_key, p.ligand_type), ';', '') AS feature
  FROM pairs p JOIN atom_keys k ON k.pdb_atom = concat_ws('-', p.resname, p.r_name)
  WHERE p.r_name <> 'HA'
    AND p.ligand_type IN ({", ".join(f"'{t}'" for t in COUNTED_LIGAND_TYPES)}))
"""


def typed_rows(spark, sf_dir):
    ligands, receptors = sides(spark, sf_dir)
    path = scratch_table(spark, "atom-keys")
    literal_table(spark, ATOM_KEYS, "pdb_atom string, type_key string").coalesce(1).write.option(
        "header", True
    ).csv(path)
    keys = read_atom_keys(spark, path)
    typed_receptors = typed.receptor_types(receptors, keys).select(
        "target", "atom_id", "x", "y", "z", "type_key"
    )
    typed_ligands = ligands.select(
        *POSE, "atom_id", "x", "y", "z", F.col("ligand_type").alias("type_key")
    )
    return typed.typed_pairs(typed_ligands, typed_receptors)


@query(
    "typed_pairs",
    ATOMS_SQL
    + pairs_sql(6.0, "<=")
    + TYPED
    + "SELECT target, pose, feature, CAST(count(*) AS DOUBLE) AS value FROM typed GROUP BY ALL",
)
def typed_pairs(spark, sf_dir):
    return typed.typed_pair_counts(typed_rows(spark, sf_dir), POSE)


@query(
    "typed_pair_domain",
    ATOMS_SQL
    + pairs_sql(6.0, "<=")
    + TYPED
    + """, domain AS (SELECT replace(concat_ws('-', p, l), ';', '') AS feature
      FROM unnest([{}]) AS a(p), unnest([{}]) AS b(l))
    SELECT domain.feature, count(typed.feature) AS n_pairs
    FROM domain LEFT JOIN typed ON typed.feature = domain.feature GROUP BY domain.feature""".format(
        ", ".join(f"'{k}'" for k in PROTEIN_TYPE_KEYS),
        ", ".join(f"'{k}'" for k in LIGAND_TYPE_KEYS),
    ),
)
def typed_pair_domain(spark, sf_dir):
    counts = typed.typed_pair_counts(typed_rows(spark, sf_dir), [])
    return (
        typed.pair_domain(spark)
        .select("feature")
        .join(counts, "feature", "left")
        .select("feature", F.coalesce("value", F.lit(0.0)).cast("bigint").alias("n_pairs"))
    )


PIVOT = [
    "2.5 (C, HD)",
    "4.0 (C, C)",
    "4.0 (A, OA)",
    "ElSum (N, OA)",
    "LA N",
    "LA HD",
    "BPF ALPHA SIDECHAIN",
    "BPF OTHER BACKBONE",
    "HC BETA SIDECHAIN",
    "C43000-C42200",
]


@query(
    "feature_pivot",
    ATOMS_SQL
    + pairs_sql(6.0, "<=")
    + TYPED
    + """, lig AS (SELECT target, pose,
        CAST(max(CASE WHEN atom_type = 'N' THEN 1 ELSE 0 END) AS DOUBLE) AS n,
        CAST(max(CASE WHEN atom_type = 'HD' THEN 1 ELSE 0 END) AS DOUBLE) AS hd
      FROM atoms WHERE side = 'ligand' GROUP BY target, pose),
    con AS (SELECT target, pose,
        CAST(count(*) FILTER (WHERE dist < 2.5 AND pair = 'C_HD') AS DOUBLE) AS a,
        CAST(count(*) FILTER (WHERE dist >= 2.5 AND pair = 'C_C') AS DOUBLE) AS b,
        CAST(count(*) FILTER (WHERE dist >= 2.5 AND pair = 'A_OA') AS DOUBLE) AS c,
        sum(charge * r_charge / nullif(dist, 0) * 1389423.8460104697::DOUBLE)
          FILTER (WHERE pair = 'N_OA') AS d,
        CAST(count(*) FILTER (WHERE structure = 'ALPHA' AND chain_side = 'SIDECHAIN') AS DOUBLE) AS e,
        CAST(count(*) FILTER (WHERE structure = 'OTHER' AND chain_side = 'BACKBONE') AS DOUBLE) AS f,
        CAST(count(*) FILTER (WHERE structure = 'BETA' AND chain_side = 'SIDECHAIN'
          AND element = 'C' AND r_element = 'C') AS DOUBLE) AS g
      FROM pairs WHERE dist < 4 GROUP BY target, pose),
    typ AS (SELECT target, pose, CAST(count(*) AS DOUBLE) AS h FROM typed
      WHERE feature = 'C43000-C42200' GROUP BY target, pose)
    SELECT lig.target, lig.pose, coalesce(a, 0) AS "2.5 (C, HD)", coalesce(b, 0) AS "4.0 (C, C)",
      coalesce(c, 0) AS "4.0 (A, OA)", round(coalesce(d, 0), 3) AS "ElSum (N, OA)", n AS "LA N",
      hd AS "LA HD", coalesce(e, 0) AS "BPF ALPHA SIDECHAIN",
      coalesce(f, 0) AS "BPF OTHER BACKBONE", coalesce(g, 0) AS "HC BETA SIDECHAIN",
      coalesce(h, 0) AS "C43000-C42200"
    FROM lig LEFT JOIN con USING (target, pose) LEFT JOIN typ USING (target, pose)""",
)
def feature_pivot(spark, sf_dir):
    wide = pose_features(spark, sf_dir)
    return wide.select(
        *POSE,
        *[F.round(column(c), 3).alias(c) if c.startswith("ElSum") else column(c) for c in PIVOT],
    )


def pose_features(spark, sf_dir):
    """The listed interaction features of every pose, one row each."""
    ligands, receptors = sides(spark, sf_dir)
    keys = literal_table(spark, ATOM_KEYS, "pdb_atom string, type_key string")
    known = F.col("ligand_type").isin(COUNTED_LIGAND_TYPES)
    long = extraction.interaction_features(
        ligands.withColumn("type_key", F.when(known, F.col("ligand_type"))),
        typed.with_receptor_types(receptors, keys),
    )
    # The type flags are listed, so that every pose keeps a row.
    return features.to_wide(long.filter(F.col("feature").isin(PIVOT)), POSE, PIVOT)


def listed_features(count: int = 492) -> list[str]:
    """Names of contact, energy, category, hydrogen-bond, type and typed-pair features, by their rules."""
    types = sorted(("C", "A", "N", "OA", "HD", "SA", "NA", "CL"))
    pairs = [f"({a}, {b})" for i, a in enumerate(types) for b in types[i:]]
    places = [f"{s} {c}" for s in ("ALPHA", "BETA", "OTHER") for c in ("BACKBONE", "SIDECHAIN")]
    names = [f"{head} {pair}" for head in ("2.5", "4.0", "ElSum") for pair in pairs]
    names += [f"{head} {place}" for head in ("BPF", "HC") for place in places]
    names += [f"HB {place} {donor}" for place in places for donor in ("LIGAND", "RECEPTOR")]
    names += ["LA N", "LA HD"]
    typed_names = [f"{p}-{q}".replace(";", "") for p in PROTEIN_TYPE_KEYS for q in COUNTED_LIGAND_TYPES]
    return names + typed_names[: count - len(names)]


FULL_LONG = f"""
, long AS (
  SELECT target, pose, concat(CASE WHEN dist < 2.5 THEN '2.5 (' ELSE '4.0 (' END, replace(pair, '_', ', '), ')') AS feature,
    CAST(1 AS DOUBLE) AS value FROM pairs WHERE dist < 4
  UNION ALL SELECT target, pose, concat('ElSum (', replace(pair, '_', ', '), ')'),
    charge * r_charge / nullif(dist, 0) * 1389423.8460104697::DOUBLE FROM pairs WHERE dist < 4
  UNION ALL SELECT target, pose, concat_ws(' ', 'BPF', structure, chain_side), 1 FROM pairs WHERE dist < 4
  UNION ALL SELECT target, pose, concat_ws(' ', 'HC', structure, chain_side), 1 FROM pairs
    WHERE dist < 4 AND element = 'C' AND r_element = 'C'
  UNION ALL SELECT target, pose, feature, 1 FROM typed
  UNION ALL SELECT target, pose, feature, value FROM ({ORACLES['bond_features']})
  UNION ALL SELECT target, pose, concat('LA ', t), CAST(max(CASE WHEN atom_type = t THEN 1 ELSE 0 END) AS DOUBLE)
    FROM atoms, (VALUES ('N'), ('HD')) k(t) WHERE side = 'ligand' GROUP BY target, pose, t),
poses AS (SELECT DISTINCT target, pose FROM atoms WHERE side = 'ligand')
"""


def _full_column(name: str) -> str:
    return f"""round(coalesce(sum(value) FILTER (WHERE feature = '{name}'), 0), 3) AS "{name}\""""


@query(
    "feature_row_full",
    ATOMS_SQL
    + pairs_sql(6.0, "<=")
    + TYPED
    + FULL_LONG
    + f"""SELECT p.target, p.pose, {", ".join(map(_full_column, listed_features()))}
    FROM poses p LEFT JOIN long l ON l.target = p.target AND l.pose = p.pose GROUP BY p.target, p.pose""",
)
def feature_row_full(spark, sf_dir):
    """Every listed feature of all families that come from atom pairs, one row per pose."""
    ligands, receptors = sides(spark, sf_dir, stored=True)
    keys = literal_table(spark, ATOM_KEYS, "pdb_atom string, type_key string")
    known = F.col("ligand_type").isin(COUNTED_LIGAND_TYPES)
    counted = ligands.withColumn("type_key", F.when(known, F.col("ligand_type")))
    bonds = contacts.hydrogen_bonds(ligands, receptors, POSE, **HB)
    long = extraction.union_features(
        [
            extraction.interaction_features(counted, typed.with_receptor_types(receptors, keys)),
            extraction.bond_features(bonds, POSE),
        ]
    )
    listed = listed_features()
    wide = extraction.feature_row(ligands, long, POSE, listed)
    return wide.select(*POSE, *[F.round(column(c), 3).alias(c) for c in listed])


@query(
    "unknown_types",
    ATOMS_SQL
    + "SELECT DISTINCT ligand_type FROM atoms WHERE ligand_type NOT IN ({})".format(
        ", ".join(f"'{t}'" for t in LIGAND_TYPE_KEYS)
    ),
)
def unknown_types(spark, sf_dir):
    return typed.unknown_types(atoms(spark, sf_dir), LIGAND_TYPE_KEYS, "ligand_type")


NAMES = """CASE l_partkey % 10 WHEN 0 THEN '1HB' WHEN 1 THEN 'CL1' WHEN 2 THEN 'Br@' WHEN 3 THEN 'CA'
  WHEN 4 THEN 'ZN' WHEN 5 THEN 'FE2' WHEN 6 THEN '@N1' WHEN 7 THEN 'OXT' WHEN 8 THEN '2HH1'
  ELSE ' S' END"""


@query(
    "infer_element",
    f"""WITH named AS (SELECT {NAMES} AS name FROM lineitem)
    SELECT name, CASE WHEN upper(substr(trim(name), 1, 2)) IN ('BR', 'CL', 'BI', 'AS', 'AG', 'LI',
        'MG', 'MN', 'RH', 'ZN', 'FE') THEN upper(substr(trim(name), 1, 2))
      ELSE upper(substr(regexp_replace(trim(name), '[0-9@]', '', 'g'), 1, 1)) END AS element,
      count(*) AS n FROM named GROUP BY ALL""",
)
def infer_element(spark, sf_dir):
    from dockspan.queries.views import table

    rows = table(spark, sf_dir, "lineitem").selectExpr(f"{NAMES} AS name")
    return (
        rows.withColumn("element", element_of_name(F.col("name")))
        .groupBy("name", "element")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _sql_vectors() -> str:
    """The vector functions spelled out for vectors a, b, c, d of each atom."""
    return """, v AS (SELECT atom_id, x AS ax, y AS ay, z AS az, y AS bx, z AS b_y, x + 1 AS bz,
        z AS cx, x + 2 AS cy, y AS cz, x + 3 AS dx, z AS d_y, y - 1 AS dz FROM atoms),
    s AS (SELECT *, bx-ax AS p1, b_y-ay AS p2, bz-az AS p3, cx-bx AS q1, cy-b_y AS q2, cz-bz AS q3,
        dx-cx AS r1, d_y-cy AS r2, dz-cz AS r3,
        sqrt(ax*ax+ay*ay+az*az) AS ma, sqrt(bx*bx+b_y*b_y+bz*bz) AS mb FROM v),
    t AS (SELECT *, q2*r3-q3*r2 AS t1, q3*r1-q1*r3 AS t2, q1*r2-q2*r1 AS t3,
        p2*q3-p3*q2 AS w1, p3*q1-p1*q3 AS w2, p1*q2-p2*q1 AS w3,
        sqrt(q1*q1+q2*q2+q3*q3) AS mq,
        (7 - ax*bx - ay*b_y - az*bz) / nullif(bx*bx+b_y*b_y+bz*bz, 0) AS step FROM s)
    SELECT atom_id, round(sqrt(p1*p1+p2*p2+p3*p3), 6) AS distance,
      round(ax*bx+ay*b_y+az*bz, 6) AS dot,
      round(ay*bz-az*b_y, 6) AS cross_x,
      round(ax/nullif(ma, 0), 6) AS unit_x,
      round(acos(greatest(-1, least(1,
        ax/nullif(ma,0)*(bx/nullif(mb,0))+ay/nullif(ma,0)*(b_y/nullif(mb,0))+az/nullif(ma,0)*(bz/nullif(mb,0))))), 6)
        AS angle,
      round(atan2(p1*mq*t1+p2*mq*t2+p3*mq*t3, w1*t1+w2*t2+w3*t3), 6) AS dihedral,
      round(ax + bx*step, 6) AS foot_x,
      round(round_even(ax / 0.5::DOUBLE, 0) * 0.5, 6) AS snapped
    FROM t"""


@query("vector_math", ATOMS_SQL + _sql_vectors())
def vector_math(spark, sf_dir):
    x, y, z = V.vec()
    a, b = (x, y, z), (y, z, x + 1)
    c, d = (z, x + 2, y), (x + 3, z, y - 1)
    return rounded(
        atoms(spark, sf_dir).select(
            "atom_id",
            V.distance(a, b).alias("distance"),
            V.dot(a, b).alias("dot"),
            V.cross(a, b)[0].alias("cross_x"),
            V.normalize(a)[0].alias("unit_x"),
            V.angle(a, b).alias("angle"),
            V.dihedral(a, b, c, d).alias("dihedral"),
            V.project(a, (*b, F.lit(7.0)))[0].alias("foot_x"),
            V.snap(x, 0.5).alias("snapped"),
        )
    )
