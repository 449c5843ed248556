import numpy as np
import pytest
from pyspark.sql import functions as F

from dockspan.functions import ids
from dockspan.functions.atoms import element_of_name
from dockspan.operators import residues
from dockspan.sources import features as feature_files, sinks, structures
from dockspan.streaming import ingest

LINE = "ATOM  %5d  %-3s %-3s A%4d    %8.3f%8.3f%8.3f  1.00  0.00    %6.3f %-2s"


def atom(serial, name, resname, resid, x, charge=0.1, kind="C"):
    return LINE % (serial, name, resname, resid, x, 0.0, -1.5, charge, kind)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "protein").mkdir()
    (tmp_path / "molecule" / "abc").mkdir(parents=True)
    protein = [
        atom(1, "CA", "ALA", 5, 1.0),
        atom(2, "CA", "ALA", 5, 9.0),
        atom(3, "O", "HOH", 5, 2.0),
        atom(4, "O", "HOH", 5, 3.0),
        "ENDROOT",
        atom(5, "CL1", "LIG", 1234, 4.0),
        "END",
        atom(6, "CB", "ALA", 6, 4.0),
    ]
    (tmp_path / "protein" / "abc_protein.pdbqt").write_text("\n".join(protein) + "\n")
    poses = []
    for k in (1, 2):
        poses += [f"MODEL {k}", "REMARK  A  between atoms: 1 and 2", atom(1, "C1", "", 1, k), "ENDMDL"]
    (tmp_path / "molecule" / "abc" / "lig.pdbqt").write_text("\n".join(poses) + "\n")
    (tmp_path / "molecule" / "abc" / "tiny.pdbqt").write_text("MODEL 1\nX\n")
    return tmp_path


def test_scan_of_files(spark, folder):
    lines = structures.read_lines(spark, str(folder / "protein"))
    atoms = structures.scan_atoms(lines).orderBy("idx").collect()
    assert [(a.idx, a.name, a.resname, a.resid, a.x, a.element) for a in atoms] == [
        (1, "CA", "ALA", 5, 1.0, "C"),
        (2, "O", "HOH", 5, 2.0, "O"),
        (3, "O", "HOH", 5, 3.0, "O"),
        (4, "CL1", "LIG", 1234, 4.0, "CL"),
    ]
    assert atoms[0].chain == "A" and atoms[0].charge == pytest.approx(0.1) and atoms[0].atom_type == "C"
    narrow = structures.parse_atoms(lines, narrow_resid=True).filter("name = 'CL1'").first()
    assert narrow.resid == 234


def test_line_order_survives_splits(spark, folder):
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        lines = structures.read_lines(spark, str(folder / "protein")).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    written = (folder / "protein" / "abc_protein.pdbqt").read_text().splitlines()
    assert [r.line for r in lines] == written
    assert [r.line_no for r in lines] == list(range(1, len(written) + 1))


def test_poses_of_multi_model_files(spark, folder):
    lines = structures.read_lines(spark, str(folder / "molecule"))
    for limit in (100, 0):
        poses = structures.split_poses(lines, max_group_rows=limit)
        got = {(r.file.rsplit("/", 1)[-1], r.pose) for r in poses.select("file", "pose").distinct().collect()}
        assert got == {("lig.pdbqt", 1), ("lig.pdbqt", 2)}
    atoms = structures.scan_atoms(poses, ["file", "pose"]).orderBy("pose").collect()
    assert [(a.pose, a.x, a.resname) for a in atoms] == [(1, 1.0, "MOL"), (2, 2.0, "MOL")]
    counts = structures.count_torsions(poses, ["file", "pose"]).collect()
    assert [c.torsions for c in counts] == [1, 1]


def test_discovery(spark, folder):
    found = structures.discover_targets(structures.list_files(spark, str(folder)))
    assert {(r.target, r.ligand_path.rsplit("/", 1)[-1]) for r in found.collect()} == {
        ("abc", "lig.pdbqt"),
        ("abc", "tiny.pdbqt"),
    }


@pytest.mark.parametrize("n, k", [(31, 23), (31, 27), (46, 34), (53, 47), (1, 5), (7, 1), (5, 5), (3, 9)])
def test_even_sampling(spark, n, k):
    rows = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("pos"))
    got = sorted(r.pos for r in structures.sample_evenly(rows, ["g"], "pos", k).collect())
    assert got == np.linspace(0, n - 1, min(k, n), dtype=int).tolist()


def test_elements_and_ids(spark):
    def each(function, values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r.r for r in df.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()]

    assert each(element_of_name, ["CL1", "CA", "1HB", "ZN", "br2", "@N"]) == ["CL", "C", "H", "ZN", "BR", "N"]
    assert each(ids.base_compound, ["a_out_pose3.pdbqt", "a_pose1_pose2", "b_12", "c"]) == ["a_out", "a", "b", "c"]
    assert each(ids.base_library_name, ["a_b_1", "a"]) == ["a_b", "a"]
    assert each(ids.canonical_experiment_id, [" 7.9", "a/b", "007", "1.2.3", ".5", "12"]) == [
        "7", "a_b", "7", "1.2.3", "0", "12",
    ]
    assert each(lambda c: ids.label_from_id(c, "active"), ["active_1", "inactive_2", "decoy"]) == [1, 1, 0]
    assert each(lambda c: ids.label_from_id(c, "inactive"), ["active_1", "inactive_2", "decoy"]) == [1, 0, 1]
    with pytest.raises(ValueError):
        ids.label_from_id(F.col("v"), "other")


def test_runs_restart_for_returning_values(spark):
    rows = spark.createDataFrame([("g", i + 1, v) for i, v in enumerate("aabba")], "g string, pos long, v string")
    for block in (2, 100):
        runs = residues.number_runs(rows, ["g"], "pos", ["v"], block_rows=block).orderBy("pos")
        assert [r.run for r in runs.collect()] == [1, 1, 2, 2, 3]


def sequential_pruning(carbons):
    """The rules applied one residue after the other, until nothing changes."""
    label = {(c["chain"], c["resid"]): c["class"] for c in carbons}
    key = [(c["chain"], c["resid"]) for c in carbons]

    def near(a, b):
        return sum((carbons[a][v] - carbons[b][v]) ** 2 for v in "xyz") ** 0.5 < 6

    def supported(i, kind):
        for j, other in enumerate(carbons):
            apart = abs(other["resid"] - carbons[i]["resid"])
            fits = apart == 3 if kind == "ALPHA" else apart > 2 and other["chain"] == carbons[i]["chain"]
            if label[key[j]] == kind and fits and near(i, j):
                return True
        return False

    changed = True
    while changed:
        changed = False
        for kind, longest in (("ALPHA", 4), ("BETA", 2)):
            for i in range(len(carbons)):
                if label[key[i]] == kind and not supported(i, kind):
                    label[key[i]] = "OTHER"
                    changed = True
            frame = longest + 2
            for start in range(len(carbons) - frame + 1):
                ids_ = range(start, start + frame)
                if any(carbons[i]["resid"] + 1 != carbons[i + 1]["resid"] for i in list(ids_)[:-1]):
                    continue
                for size in range(1, longest + 1):
                    for first in range(start + 1, start + frame - size):
                        run = range(first, first + size)
                        outside = (first - 1, first + size)
                        if all(label[key[i]] == kind for i in run) and all(label[key[i]] != kind for i in outside):
                            for i in run:
                                label[key[i]] = "OTHER"
                            changed = True
    return [label[k] for k in key]


def test_pruning_equals_sequential_rules(spark):
    rng = np.random.default_rng(17)
    rows, want = [], {}
    for g in range(12):
        resid, carbons = 0, []
        for p in range(28):
            resid += int(rng.choice([1, 1, 1, 1, 1, 1, 2]))
            carbons.append(
                {
                    "resid": resid,
                    "chain": "A" if p < 17 else "B",
                    "x": float(p * 1.4),
                    "y": float(rng.uniform(0, 4)),
                    "z": float(rng.uniform(0, 4)),
                    "class": str(rng.choice(["ALPHA", "ALPHA", "ALPHA", "BETA", "OTHER"])),
                }
            )
        want[g] = sequential_pruning(carbons)
        rows += [(g, p + 1, c["resid"], c["chain"], c["x"], c["y"], c["z"], c["class"]) for p, c in enumerate(carbons)]
    df = spark.createDataFrame(
        rows, "g int, position long, resid int, chain string, x double, y double, z double, class string"
    )
    # One task a group, passes over all groups, and both side by side.
    for limits in ((200_000, 4_000_000), (0, 0), (28, 20)):
        got = {}
        for r in residues.prune_runs(df, ["g"], *limits).orderBy("g", "position").collect():
            got.setdefault(r.g, []).append(r["class"])
        assert got == want
    assert any("ALPHA" in v for v in want.values())
    alone = df.filter("g = 3").drop("g")
    assert [r["class"] for r in residues.prune_runs(alone, []).orderBy("position").collect()] == want[3]


def test_a_wave_looks_at_the_neighbours_of_what_fell():
    """A chain of supports falls from its end, one row a wave; every pair is taken away once."""
    size = 400
    kinds, apart = np.ones(size, np.int64), np.arange(size)
    group = residues.Pruning(kinds, apart, np.ones(size, np.int64), apart)
    looked = []
    plain = group.too_short
    group.too_short = lambda rows, kind, limit: (looked.append(len(rows)), plain(rows, kind, limit))[1]
    assert group.run(np.arange(size - 1), np.arange(1, size)) == size
    assert not group.kinds.any() and max(looked[2:]) < 20


def test_torsions_of_two_residues(spark):
    points = {"N": (0.0, 1.0, 0.0), "CA": (0.0, 0.0, 0.0), "C": (1.5, 0.0, 0.0), "O": (2.0, 1.0, 0.0)}
    rows = []
    for resid, shift in ((1, 0.0), (2, 3.0), (4, 6.0)):
        for k, (name, (x, y, z)) in enumerate(points.items()):
            rows.append(("f", resid * 4 + k, resid, "A", name, x + shift, y, z + shift / 3))
    df = spark.createDataFrame(
        rows, "f string, idx int, resid int, chain string, name string, x double, y double, z double"
    )
    found = residues.backbone_residues(df, ["f"])
    pairs = residues.torsion_pairs(found, ["f"])
    assert [(r.resid, r.next_resid) for r in pairs.collect()] == [(1, 2)]
    assert residues.torsion_pairs(found, ["f"], skip_first=True).count() == 0
    classes = residues.residue_classes(found, pairs, ["f"])
    assert classes.count() == 3


def test_feature_files(spark, tmp_path):
    df = spark.createDataFrame([(1.5, "x"), (None, "y")], "f double, Id string")
    path = str(tmp_path / "csv")
    feature_files.write_feature_csv(df, path)
    assert sorted(r.Id for r in feature_files.read_feature_csv(spark, path).collect()) == ["x", "y"]
    (tmp_path / "lists.json").write_text('{"small": ["b", "a"], "big": ["c"]}')
    lists = feature_files.read_feature_lists(spark, str(tmp_path / "lists.json"))
    assert sorted(map(tuple, lists.collect())) == [("big", 0, "c"), ("small", 0, "b"), ("small", 1, "a")]


def test_results_by_target(spark, tmp_path):
    rows = [("t1", "c", 0.1, 0.2, 0.13, 1), ("t2", "d", 0.1, 0.2, 0.13, 1)]
    df = spark.createDataFrame(rows, "target string, compound_id string, ps double, pb double, score double, rank long")
    path = str(tmp_path / "out")
    sinks.write_results(df, path)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["target=t1", "target=t2"]
    assert sinks.read_results(spark, path).count() == 2


def test_stream_takes_each_file_once(spark, tmp_path):
    source, output, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "target string, compound_id string, score double"
    first = [("t", "a_pose1", 0.2), ("t", "a_pose2", 0.9), ("t", "b", 0.5)]
    spark.createDataFrame(first, schema).write.mode("append").parquet(source)
    rows = ingest.read_stream(spark, source, spark.createDataFrame([], schema).schema)
    updates = ingest.running_best(rows)
    kept = ingest.LatestRows(output, ["target", "base_compound"])
    ingest.write_updates(updates, kept, state).awaitTermination()
    spark.createDataFrame([("t", "a_pose3", 0.95)], schema).write.mode("append").parquet(source)
    for _ in range(2):
        ingest.write_updates(updates, kept, state).awaitTermination()
    latest = kept.rows(spark)
    got = {r.base_compound: (r.compound_id, r.score, r.total_poses) for r in latest.collect()}
    assert got == {"a": ("a_pose3", 0.95, 3), "b": ("b", 0.5, 1)}
