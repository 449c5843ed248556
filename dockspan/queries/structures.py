"""Structure lines, poses, residues and torsions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dockspan.functions.fixed_values import PROTEIN_RESIDUES
from dockspan.operators import residues
from dockspan.operators.durable import durable
from dockspan.operators.ordering import ranked
from dockspan.queries.registry import query, rounded
from dockspan.queries.views import ATOMS, SEQUENCE, atoms, sequence, table
from dockspan.sources import structures

ATOM_LINE = (
    "'{kind}%5d  %-3s %-3s %s%4d    %8.3f%8.3f%8.3f  1.00  0.00    %6.3f %-2s'"
)
FIELDS = "atom_id % 100000, name, resname, chain, resid, x, y, z, charge, element"


def lines_sql(format_function: str) -> str:
    """Structure lines of the atoms, with marks and ends among them."""
    formats = {k: f"{format_function}({ATOM_LINE.format(kind=k)}, {FIELDS})" for k in ("ATOM  ", "HETATM")}
    return f"""SELECT target AS file, atom_id AS line_no, CASE
        WHEN atom_id % 9973 = 9007 THEN 'END'
        WHEN atom_id % 17 = 0 THEN 'REMARK   1  A    between atoms: C_1  and  N_2'
        WHEN atom_id % 17 = 1 THEN 'REMARK   2  I    between atoms: C_2  and  N_3'
        WHEN atom_id % 17 = 2 THEN 'ENDROOT'
        WHEN atom_id % 17 < 6 THEN {formats['HETATM']}
        ELSE {formats['ATOM  ']} END AS line
      FROM shaped"""


SHAPED = """SELECT *, CASE pose WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE ' ' END AS chain,
  CAST(atom_id % 60 AS INTEGER) AS resid FROM atoms"""
LINES_SQL = f"""WITH atoms AS ({ATOMS}), shaped AS ({SHAPED}),
lines AS ({lines_sql('printf')}),
stops AS (SELECT file, min(line_no) AS stop FROM lines
  WHERE starts_with(line, 'END') AND NOT starts_with(line, 'ENDROOT')
    AND NOT starts_with(line, 'ENDBRANCH') GROUP BY file),
kept AS (SELECT lines.* FROM lines LEFT JOIN stops USING (file)
  WHERE stop IS NULL OR line_no < stop)
"""


def lines(spark, sf_dir):
    """The line table, stored as a file scan would give it."""
    shaped = SHAPED.replace("FROM atoms", "FROM {atoms}")
    made = spark.sql(
        f"WITH shaped AS ({shaped}) " + lines_sql("format_string"), atoms=atoms(spark, sf_dir)
    )
    return durable(made)


PROTEIN = ", ".join(f"'{r}'" for r in PROTEIN_RESIDUES)
SCANNED = f"""
, parsed AS (SELECT s.target AS file, s.atom_id AS line_no,
    CAST(s.atom_id % 100000 AS VARCHAR) AS serial, s.name, s.resname, trim(s.chain) AS chain, s.resid,
    round(s.x, 3) AS x, round(s.y, 3) AS y, round(s.z, 3) AS z, round(s.charge, 3) AS charge,
    s.element AS atom_type,
    CASE WHEN upper(substr(s.name, 1, 2)) IN ('BR', 'CL', 'BI', 'AS', 'AG', 'LI', 'MG', 'MN', 'RH',
      'ZN', 'FE') THEN upper(substr(s.name, 1, 2)) ELSE substr(s.name, 1, 1) END AS element
  FROM shaped s JOIN kept k ON k.file = s.target AND k.line_no = s.atom_id
  WHERE starts_with(k.line, 'ATOM') OR starts_with(k.line, 'HETATM')),
firsts AS (SELECT *, row_number() OVER (PARTITION BY file, name, resid, resname, chain
    ORDER BY line_no) AS copy FROM parsed),
scanned AS (SELECT * EXCLUDE (copy) FROM firsts WHERE copy = 1 OR resname NOT IN ({PROTEIN}))
"""


@query(
    "scan_fixed_width",
    LINES_SQL
    + SCANNED
    + """SELECT file, row_number() OVER (PARTITION BY file ORDER BY line_no) AS idx, serial, name,
      resname, chain, resid, x, y, z, charge, atom_type, element FROM scanned""",
)
def scan_fixed_width(spark, sf_dir):
    return structures.scan_atoms(lines(spark, sf_dir)).select(
        "file", "idx", "serial", "name", "resname", "chain", "resid", "x", "y", "z", "charge",
        "atom_type", "element",
    )


@query(
    "count_marked_lines",
    LINES_SQL
    + """SELECT file, count(*) FILTER (WHERE contains(line, 'between atoms')
      AND contains(line, ' A ')) AS torsions FROM kept GROUP BY file""",
)
def count_marked_lines(spark, sf_dir):
    return structures.count_torsions(lines(spark, sf_dir))


@query(
    "dedup_first",
    LINES_SQL
    + SCANNED
    + "SELECT file, resname, count(*) AS n_atoms, min(line_no) AS first_line FROM scanned GROUP BY ALL",
)
def dedup_first(spark, sf_dir):
    rows = structures.parse_atoms(structures.before_end(lines(spark, sf_dir)))
    return (
        structures.drop_repeated(rows)
        .groupBy("file", "resname")
        .agg(F.count(F.lit(1)).alias("n_atoms"), F.min("line_no").alias("first_line"))
    )


@query(
    "split_documents",
    r"""WITH docs AS (SELECT conv_id AS file,
        string_agg(concat('MODEL ', turn, chr(10), text, chr(10), 'ENDMDL'), chr(10) ORDER BY turn)
          || chr(10) AS doc
      FROM conversations GROUP BY conv_id),
    chunks AS (SELECT file, unnest(string_split(doc, 'MODEL')) AS chunk,
        generate_subscripts(string_split(doc, 'MODEL'), 1) - 1 AS pose FROM docs),
    cleaned AS (SELECT file, pose, unnest(string_split(chunk, chr(10))) AS line FROM chunks),
    kept AS (SELECT * FROM cleaned WHERE NOT regexp_full_match(line, '\s*[0-9]+\s*')
        AND NOT contains(line, 'ENDMDL')),
    whole AS (SELECT file, pose FROM kept GROUP BY file, pose HAVING count(*) >= 3)
    SELECT k.file, k.pose, count(*) FILTER (WHERE line <> '') AS n_lines,
      CAST(sum(length(line)) AS BIGINT) AS n_chars
    FROM kept k JOIN whole USING (file, pose) GROUP BY ALL""",
)
def split_documents(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("file"),
        "turn",
        F.split(
            F.concat(F.lit("MODEL "), F.col("turn"), F.lit("\n"), "text", F.lit("\nENDMDL")), "\n"
        ).alias("lines"),
    )
    lines_of_turns = turns.select("file", "turn", F.posexplode("lines").alias("at", "line"))
    lined = ranked(lines_of_turns, ["file"], [F.col("turn"), F.col("at")], "line_no").select(
        "file", "line_no", "line"
    )
    poses = structures.split_poses(lined)
    return poses.groupBy("file", "pose").agg(
        F.count_if(F.col("line") != "").alias("n_lines"),
        F.sum(F.length("line")).alias("n_chars"),
    )


PATHS = """SELECT DISTINCT concat('/data/protein/', target, '_protein.pdbqt') AS path FROM atoms
  WHERE side = 'receptor'
UNION SELECT DISTINCT concat('/data/molecule/', target, '/lig', pose, '.pdbqt') FROM atoms
  WHERE side = 'ligand'
UNION SELECT DISTINCT concat('/data/molecule/unpaired-', pose, '/lig.pdbqt') FROM atoms"""


@query(
    "discover_targets",
    f"""WITH atoms AS ({ATOMS}), paths AS ({PATHS}),
    p AS (SELECT split_part(split_part(path, '/', 4), '_', 1) AS target, path AS protein_path
      FROM paths WHERE path LIKE '/data/protein/%'),
    l AS (SELECT split_part(path, '/', 4) AS target, path AS ligand_path
      FROM paths WHERE path LIKE '/data/molecule/%')
    SELECT target, protein_path, ligand_path FROM p JOIN l USING (target)""",
)
def discover_targets(spark, sf_dir):
    named = PATHS.replace("FROM atoms", "FROM {atoms}")
    return structures.discover_targets(spark.sql(named, atoms=atoms(spark, sf_dir)))


PLACED = f"""WITH seq AS ({SEQUENCE}),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts, event_id) AS pos,
  count(*) OVER (PARTITION BY grp) AS n FROM seq)
"""


def placed(spark, sf_dir):
    return ranked(sequence(spark, sf_dir), ["grp"], [F.col("ts"), F.col("event_id")], "pos")


@query(
    "sample_evenly",
    PLACED
    + """, wanted AS (SELECT grp, CASE WHEN i = 0 THEN 0 WHEN i = least(n, 23) - 1 THEN n - 1
        ELSE CAST(floor(i * (CAST(n - 1 AS DOUBLE) / (least(n, 23) - 1))) AS BIGINT) END AS at
      FROM (SELECT grp, n, unnest(range(least(n, 23))) AS i FROM (SELECT DISTINCT grp, n FROM placed)))
    SELECT p.grp, p.pos - 1 AS pos, p.event_id, concat(p.grp, '_pose', p.pos, '.pdbqt') AS name
    FROM placed p JOIN wanted w
      ON w.grp = p.grp AND w.at = p.pos - 1""",
)
def sample_evenly(spark, sf_dir):
    rows = placed(spark, sf_dir).select("grp", (F.col("pos") - 1).alias("pos"), "event_id")
    name = structures.sampled_name(F.concat(F.col("grp"), F.lit(".pdbqt")), F.col("pos"))
    chosen = structures.sample_evenly(rows, ["grp"], "pos", 23)
    return chosen.select("grp", "pos", "event_id", name.alias("name"))


@query(
    "residue_runs",
    PLACED
    + """, marked AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new
        FROM placed WINDOW w AS (PARTITION BY grp ORDER BY pos)),
    runs AS (SELECT *, sum(new) OVER (PARTITION BY grp ORDER BY pos) AS run FROM marked)
    SELECT grp, CAST(run AS BIGINT) AS run, event_type, count(*) AS n, min(pos) AS first_pos
    FROM runs GROUP BY ALL""",
)
def residue_runs(spark, sf_dir):
    runs = residues.number_runs(placed(spark, sf_dir), ["grp"], "pos", ["event_type"])
    return runs.groupBy("grp", "run", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos")
    )


# Four backbone atoms per event, placed by its value; gaps in the numbering and
# a change of chain interrupt the sequence.
BACKBONE = """
SELECT grp, pos, CAST(pos + floor(pos / 20) * 2 AS INTEGER) AS resid,
  CASE WHEN floor(pos / 33) % 2 = 0 THEN 'A' ELSE 'B' END AS chain,
  pos * 4 + k AS idx,
  CASE k WHEN 0 THEN 'N' WHEN 1 THEN 'CA' WHEN 2 THEN 'C' ELSE 'O' END AS name,
  CAST(pos AS DOUBLE) + k * 0.5 AS x,
  CAST(CAST(round(value * 100) AS BIGINT) * (k + 3) % 700 AS DOUBLE) / 100 AS y,
  CAST(CAST(round(value * 100) AS BIGINT) * (k + 7) % 900 AS DOUBLE) / 100 AS z
FROM placed, ks
WHERE NOT (k = 3 AND CAST(round(value * 100) AS BIGINT) % 10 = 0)
"""


def torsion_sql(name: str, a: str, b: str, c: str, d: str) -> str:
    """Torsion in degrees of four points given by column prefixes."""
    u, v, w = ([f"({q}{s}-{p}{s})" for s in "xyz"] for p, q in ((a, b), (b, c), (c, d)))
    def cross(m, n):
        return [f"({m[1]}*{n[2]}-{m[2]}*{n[1]})", f"({m[2]}*{n[0]}-{m[0]}*{n[2]})", f"({m[0]}*{n[1]}-{m[1]}*{n[0]})"]
    vw, uv = cross(v, w), cross(u, v)
    size = f"sqrt({v[0]}*{v[0]}+{v[1]}*{v[1]}+{v[2]}*{v[2]})"
    up = "+".join(f"{p}*{size}*{q}" for p, q in zip(u, vw))
    across = "+".join(f"{p}*{q}" for p, q in zip(uv, vw))
    return f"degrees(atan2({up}, {across})) AS {name}"


TORSIONS = (
    PLACED
    + f""", ks AS (SELECT unnest([0, 1, 2, 3]) AS k), backbone AS ({BACKBONE}),
    res AS (SELECT grp, resid, chain, count(*) AS n4,
    {", ".join(f"max(CASE WHEN name = '{n}' THEN {s} END) AS {n.lower()}_{s}" for n in ("N", "CA", "C") for s in "xyz")}
      FROM backbone GROUP BY ALL),
    pair AS (SELECT a.grp, a.chain, a.resid, b.resid AS next_resid,
      {torsion_sql('phi', 'a.c_', 'b.n_', 'b.ca_', 'b.c_')},
      {torsion_sql('psi', 'a.n_', 'a.ca_', 'a.c_', 'b.n_')}
      FROM res a JOIN res b ON a.grp = b.grp AND a.chain = b.chain AND a.resid + 1 = b.resid
      WHERE a.n4 = 4 AND b.n4 = 4),
    classed AS (SELECT *, CASE
        WHEN (phi >= -180 AND phi < -40 AND psi <= 180 AND psi > 90)
          OR (phi >= -180 AND phi < -70 AND psi <= -165) THEN 'BETA'
        WHEN phi > -145 AND phi < -35 AND psi > -70 AND psi < 50 THEN 'ALPHA' END AS class
      FROM pair)
    """
)


def backbone(spark, sf_dir):
    """Backbone residues as a stored table."""
    rows = placed(spark, sf_dir).withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    made = durable(spark.sql(BACKBONE.replace("FROM placed, ks", "FROM {rows}"), rows=rows))
    return durable(residues.backbone_residues(made, ["grp"]))


@query(
    "torsion_windows",
    TORSIONS
    + """SELECT grp, chain, resid, next_resid, round(phi, 6) AS phi, round(psi, 6) AS psi, class
    FROM classed""",
)
def torsion_windows(spark, sf_dir):
    found = backbone(spark, sf_dir)
    return rounded(residues.torsion_pairs(found, ["grp"]).drop("run"))


@query(
    "residue_classes",
    TORSIONS
    + """, votes AS (SELECT grp, chain, resid AS r, resid AS first_resid, class FROM classed
        UNION ALL SELECT grp, chain, next_resid, resid, class FROM classed),
    last AS (SELECT grp, chain, r AS resid, arg_max(class, first_resid) AS class FROM votes
        WHERE class IS NOT NULL GROUP BY ALL)
    SELECT grp, chain, resid, coalesce(last.class, 'OTHER') AS class
    FROM res LEFT JOIN last USING (grp, chain, resid)""",
)
def residue_classes(spark, sf_dir):
    found = backbone(spark, sf_dir)
    pairs = residues.torsion_pairs(found, ["grp"])
    return residues.residue_classes(found, pairs, ["grp"])


# Alpha carbons along the events of a user.
CARBONS = """
SELECT grp, pos AS position, CAST(pos + floor(pos / 20) * 2 AS INTEGER) AS resid,
  CASE WHEN floor(pos / 33) % 2 = 0 THEN 'A' ELSE 'B' END AS chain,
  CAST(pos AS DOUBLE) * 1.5 AS x,
  CAST(CAST(round(value * 100) AS BIGINT) % 500 AS DOUBLE) / 100 AS y,
  CAST(CAST(round(value * 100) AS BIGINT) % 300 AS DOUBLE) / 100 AS z,
  CASE WHEN value < 8 OR floor(pos / 9) % 3 = 0 THEN 'ALPHA' WHEN floor(pos / 9) % 3 = 1 THEN 'BETA'
    ELSE 'OTHER' END AS class
FROM placed
"""


def _prune_pass(before: str, after: str) -> str:
    """One pass of removals over table ``before`` as table ``after``."""
    def short(kind: str, limit: int) -> str:
        options = []
        for length in range(1, limit + 1):
            for lead in range(1, length + 1):
                back, ahead = lead, length + 1 - lead
                tests = [f"lag(class, {k}) OVER w = '{kind}'" for k in range(1, back)]
                tests += [f"lead(class, {k}) OVER w = '{kind}'" for k in range(1, ahead)]
                tests += [f"lag(class, {back}) OVER w <> '{kind}'", f"lead(class, {ahead}) OVER w <> '{kind}'"]
                options.append("(" + " AND ".join(tests) + ")")
        return f"(class = '{kind}' AND frame >= {limit + 2} AND ({' OR '.join(options)}))"

    return f""", {after}_marks AS MATERIALIZED (SELECT p.*, coalesce({short('ALPHA', 4)} OR {short('BETA', 2)}, FALSE) AS brief
      FROM {before} p WINDOW w AS (PARTITION BY grp, stretch ORDER BY position)),
    {after} AS MATERIALIZED (SELECT * EXCLUDE (brief) REPLACE (CASE WHEN class <> 'OTHER' AND (brief OR NOT EXISTS (
        SELECT 1 FROM support s JOIN {before} q ON q.grp = s.grp AND q.position = s.other
          AND q.class = s.class
        WHERE s.grp = m.grp AND s.position = m.position AND s.class = m.class)) THEN 'OTHER'
      ELSE class END AS class) FROM {after}_marks m)"""


# The check unrolls this many passes; a pass that changes nothing ends the operator, and the
# check's last pass is told apart by a row of its own if it still changed something.
PASSES = 30


@query(
    "prune_runs",
    PLACED
    + f""", p AS ({CARBONS}),
    cut AS (SELECT *, CASE WHEN resid = lag(resid) OVER (PARTITION BY grp ORDER BY position) + 1
        THEN 0 ELSE 1 END AS new FROM p),
    stretched AS (SELECT * EXCLUDE (new), sum(new) OVER (PARTITION BY grp ORDER BY position) AS stretch
      FROM cut),
    p0 AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY grp, stretch) AS frame FROM stretched),
    support AS MATERIALIZED (SELECT a.grp, a.position, b.position AS other, k.class
      FROM p a JOIN p b ON a.grp = b.grp AND abs(a.resid - b.resid) >= 3
        AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) < 6
      JOIN (VALUES ('ALPHA'), ('BETA')) k(class)
        ON (k.class = 'ALPHA' AND abs(a.resid - b.resid) = 3)
        OR (k.class = 'BETA' AND a.chain = b.chain))"""
    + "".join(_prune_pass(f"p{i}", f"p{i + 1}") for i in range(PASSES))
    + f""" SELECT grp, position, resid, chain, class FROM p{PASSES}
    UNION ALL SELECT a.grp, a.position, a.resid, a.chain, 'UNFINISHED' FROM p{PASSES} a
      JOIN p{PASSES - 1} b ON a.grp = b.grp AND a.position = b.position AND a.class <> b.class""",
)
def prune_runs(spark, sf_dir):
    carbons = spark.sql(CARBONS.replace("FROM placed", "FROM {rows}"), rows=placed(spark, sf_dir))
    pruned = residues.prune_runs(carbons, ["grp"])
    return pruned.select("grp", "position", "resid", "chain", "class")
