"""Structure files as tables: lines, poses and atoms.

A line table has key columns (such as ``file``), ``line_no`` and ``line``.
Line numbers only need to rise within a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dockspan.functions.atoms import (
    FIELDS,
    NARROW_RESID,
    element_of_name,
    field,
    residue_name,
)
from dockspan.functions.fixed_values import PROTEIN_RESIDUES
from dockspan.operators.durable import durable
from dockspan.operators.joins import join_same
from dockspan.operators.ordering import WINDOW_ROWS, ranked, running
from dockspan.operators.sizing import attach

PATTERN = "*.pdbqt"
# Fixed value: a pose with fewer lines than this is skipped.
MIN_POSE_LINES = 3


def list_files(spark: SparkSession, root: str, pattern: str = PATTERN) -> DataFrame:
    """Paths and sizes below ``root`` without reading the contents."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", "length")
    )


def discover_targets(paths: DataFrame, path: str = "path") -> DataFrame:
    """Targets with their protein file and the ligand files in the folder of that name.

    Of several protein files of a target the first by path counts.

    A protein file is ``…/<target>_<anything>`` directly below a folder named
    ``protein``; a ligand file is ``…/molecule/<target>/<file>``.
    """
    parts = F.split(path, "/")
    folder = F.try_element_at(parts, F.lit(-2))
    above = F.try_element_at(parts, F.lit(-3))
    name = F.try_element_at(parts, F.lit(-1))
    proteins = (
        paths.filter(folder == "protein")
        .groupBy(F.substring_index(name, "_", 1).alias("target"))
        .agg(F.min(path).alias("protein_path"))
    )
    ligands = paths.filter(above == "molecule").select(
        folder.alias("target"), F.col(path).alias("ligand_path")
    )
    return proteins.join(ligands, "target")


def read_lines(spark: SparkSession, path: str, pattern: str = PATTERN) -> DataFrame:
    """Lines ``(file, line_no, line)`` of all files below ``path``.

    Large files are read in splits; the place of a split in its file and the
    row order within the split give the line order.
    """
    rows = (
        spark.read.option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_row"),
            F.col("value").alias("line"),
        )
    )
    # A file has no more lines than bytes, and sizes come with the listing.
    sizes = list_files(spark, path, pattern)
    bytes_ = sizes.agg(F.coalesce(F.max("length"), F.lit(0)).alias("n")).first()["n"]
    largest = bytes_ if bytes_ <= WINDOW_ROWS else None
    order = [F.col("_start"), F.col("_row")]
    return ranked(rows, ["file"], order, "line_no", largest=largest).select(
        "file", "line_no", "line"
    )


def split_poses(
    lines: DataFrame,
    keys: Sequence[str] = ("file",),
    min_lines: int = MIN_POSE_LINES,
    max_group_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Number the poses of multi-model files and drop model bookkeeping.

    Every ``MODEL`` starts a new pose; the text before the first one is pose 0.
    Lines that are only a number or contain ``ENDMDL`` are dropped, and so are
    poses with fewer than ``min_lines`` lines. The line end at the end of a
    file counts as an empty last line.
    """
    pieces = lines.select(
        *keys, "line_no", F.posexplode(F.split("line", "MODEL")).alias("part", "line")
    )
    # Stored, since both the sizes of the poses and their lines come from the running count.
    numbered = durable(
        running(
            pieces,
            keys,
            [F.col("line_no"), F.col("part")],
            {"pose": (F.col("part") > 0).cast("bigint")},
            max_group_rows=max_group_rows,
        )
    )
    content = ~F.col("line").rlike(r"^\s*\d+\s*$") & ~F.contains("line", F.lit("ENDMDL"))
    kept = numbered.filter(content)
    sizes = durable(numbered.groupBy(*keys, "pose").agg(F.count_if(content).alias("n")))
    last = sizes.groupBy(*keys).agg(F.max("pose").alias("last"))
    whole = (
        join_same(sizes, last, keys)
        .filter(F.col("n") + (F.col("pose") == F.col("last")).cast("int") >= min_lines)
        .select(*keys, "pose")
    )
    return join_same(kept, whole, [*keys, "pose"], "left_semi").select(
        *keys, "pose", "line_no", "part", "line"
    )


def before_end(lines: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Lines before the first one that ends the structure.

    ``ENDROOT`` and ``ENDBRANCH`` do not end it.
    """
    line = F.col("line")
    ends = line.startswith("END") & ~line.startswith("ENDROOT") & ~line.startswith("ENDBRANCH")
    stops = lines.filter(ends).groupBy(*keys).agg(F.min("line_no").alias("_stop"))
    return (
        attach(lines, stops, keys, "left")
        .filter(F.col("_stop").isNull() | (F.col("line_no") < F.col("_stop")))
        .drop("_stop")
    )


def parse_atoms(
    lines: DataFrame, keys: Sequence[str] = ("file",), narrow_resid: bool = False
) -> DataFrame:
    """Atom fields of the ``ATOM`` and ``HETATM`` lines, without numbering.

    ``narrow_resid`` reads residue numbers from three columns only, which maps
    numbers 1000 apart to one.
    """
    line = F.col("line")
    is_atom = (line.startswith("ATOM") | line.startswith("HETATM")) & (F.length(line) >= 7)
    start, end = NARROW_RESID if narrow_resid else FIELDS["resid"]
    resid = F.trim(F.substring(line, start + 1, end - start)).try_cast("int")
    raw_resname = F.substring(line, FIELDS["resname"][0] + 1, 4)
    number = {c: field(line, c).try_cast("double") for c in ("x", "y", "z", "charge")}
    return lines.filter(is_atom).select(
        *keys,
        "line_no",
        field(line, "serial").alias("serial"),
        field(line, "name").alias("name"),
        residue_name(raw_resname).alias("resname"),
        field(line, "chain").alias("chain"),
        F.coalesce(resid, F.lit(0)).alias("resid"),
        number["x"].alias("x"),
        number["y"].alias("y"),
        number["z"].alias("z"),
        F.coalesce(number["charge"], F.lit(0.0)).alias("charge"),
        F.upper(field(line, "atom_type")).alias("atom_type"),
        element_of_name(field(line, "name")).alias("element"),
    )


def drop_repeated(atoms: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Keep the first of protein atoms that agree in name, residue and chain.

    Other atoms may share names and are all kept.
    """
    same = [*keys, "name", "resid", "resname", "chain"]
    rest = [c for c in atoms.columns if c not in same]
    # Atoms that are not protein are told apart by their line.
    own_line = F.when(~F.col("resname").isin(PROTEIN_RESIDUES), F.col("line_no"))
    return (
        atoms.groupBy(*same, own_line.alias("_line"))
        .agg(F.min_by(F.struct(*rest), "line_no").alias("_first"))
        .select(*same, "_first.*")
        .select(*atoms.columns)
    )


def number_atoms(
    atoms: DataFrame, keys: Sequence[str] = ("file",), max_group_rows: int = WINDOW_ROWS
) -> DataFrame:
    """Running atom number ``idx`` from 1 in line order."""
    return ranked(atoms, keys, [F.col("line_no")], "idx", max_group_rows)


def scan_atoms(
    lines: DataFrame, keys: Sequence[str] = ("file",), narrow_resid: bool = False
) -> DataFrame:
    """Numbered atoms of each structure in a line table."""
    atoms = parse_atoms(before_end(lines, keys), keys, narrow_resid)
    return number_atoms(drop_repeated(atoms, keys), keys)


def count_torsions(lines: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Active torsions per structure: remark lines of the form ``A between atoms``."""
    line = F.col("line")
    marked = F.contains(line, F.lit("between atoms")) & F.contains(line, F.lit(" A "))
    return before_end(lines, keys).groupBy(*keys).agg(F.count_if(marked).alias("torsions"))


def sample_evenly(
    poses: DataFrame,
    keys: Sequence[str],
    position: str,
    max_poses: int = 100,
) -> DataFrame:
    """Up to ``max_poses`` evenly spaced rows of each group.

    ``position`` counts from 0. The chosen places are those of a linear space
    from the first to the last row, cut to whole numbers; the step is taken in
    floating point and the last place is exactly the last row.
    """
    counts = poses.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    chosen = F.least(F.col("_n"), F.lit(max_poses)).cast("int")
    step = (F.col("_n") - 1).cast("double") / F.nullif(F.col("_k") - 1, F.lit(0)).cast("double")
    place = (
        F.when(F.col("_i") == 0, F.lit(0))
        .when(F.col("_i") == F.col("_k") - 1, F.col("_n") - 1)
        .otherwise(F.floor(F.col("_i") * step))
    )
    wanted = (
        counts.select("*", chosen.alias("_k"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_i"))
        .select(*keys, place.cast("bigint").alias(position))
    )
    return poses.join(wanted, [*keys, position], "left_semi")


def sampled_name(file: Column, position: Column) -> Column:
    """Name of a sampled pose: the file without extension and the pose from 1."""
    base = F.regexp_replace(file, r"\.pdbqt$", "")
    return F.concat(base, F.lit("_pose"), (position + 1).cast("string"), F.lit(".pdbqt"))
