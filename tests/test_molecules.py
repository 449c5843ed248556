import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from dockspan.operators import charges, contacts, graph, rings

KEYS = ["mol"]
ATOM = "mol string, idx int, element string, x double, y double, z double, structure string"


def hexagon(mol="hex", lift=0.0, r=1.4):
    return [
        (mol, k + 1, "C", r * math.cos(k * math.pi / 3), r * math.sin(k * math.pi / 3), lift * (-1) ** k, "")
        for k in range(6)
    ]


def ring_sets(spark, edges):
    bonds = spark.createDataFrame([("m", min(e), max(e)) for e in edges], "mol string, i int, j int")
    return sorted(tuple(r.members) for r in graph.enumerate_rings(bonds, KEYS).collect())


def minimal_cycles(edges, longest=7):
    """All simple cycles by plain search, then those without a smaller one inside."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found = set()

    def walk(path):
        for v in near[path[-1]]:
            if v == path[0] and len(path) > 2:
                found.add(frozenset(path))
            elif v > path[0] and v not in path and len(path) < longest:
                walk([*path, v])

    for v in near:
        walk([v])
    return {c for c in found if not any(d < c for d in found)}


def test_rings_of_hand_graphs(spark):
    cycle = [(k, k % 6 + 1) for k in range(1, 7)]
    assert ring_sets(spark, cycle) == [(1, 2, 3, 4, 5, 6)]
    fused = [*cycle, (1, 7), (7, 8), (8, 9), (9, 10), (10, 2)]
    assert len(ring_sets(spark, fused)) == 2
    assert len(ring_sets(spark, list(itertools.combinations(range(1, 5), 2)))) == 4
    assert ring_sets(spark, [(1, 2), (2, 3)]) == []
    eight = [(k, k % 8 + 1) for k in range(1, 9)]
    assert ring_sets(spark, eight) == []


def test_rings_of_random_graphs(spark):
    rng = random.Random(5)
    edges = {tuple(sorted(rng.sample(range(1, 19), 2))) for _ in range(32)}
    got = ring_sets(spark, edges)
    assert len(got) == len({frozenset(g) for g in got})
    assert {frozenset(g) for g in got} == minimal_cycles(edges)


def test_only_flat_rings_are_kept(spark):
    atoms = spark.createDataFrame([*hexagon(), *hexagon("chair", 0.25)], ATOM)
    bonds = graph.infer_bonds(atoms, KEYS)
    found = rings.molecule_rings(atoms, bonds, KEYS).collect()
    assert [r.mol for r in found] == ["hex"]
    ring = found[0]
    assert (ring.x, ring.y, ring.z) == pytest.approx((0, 0, 0), abs=1e-9)
    assert ring.radius == pytest.approx(1.4)
    assert ring.a == pytest.approx(0, abs=1e-9) and abs(ring.c) > 1
    assert rings.molecule_rings(atoms, bonds, KEYS, flat=False).count() == 2


def test_ring_with_saturated_carbon_is_not_flat(spark):
    arms = [("hex", 7, "C", 2.4, 0.0, 1.0, ""), ("hex", 8, "C", 2.4, 0.0, -1.0, "")]
    atoms = spark.createDataFrame([*hexagon(), *arms], ATOM)
    bonds = graph.infer_bonds(atoms, KEYS)
    assert graph.neighbour_counts(atoms, bonds, KEYS).filter("idx = 1").first().degree == 4
    assert rings.molecule_rings(atoms, bonds, KEYS).count() == 0


def stacked(spark, turn, gap):
    """A ring at the origin and one above it, flat or turned upright."""
    base = spark.createDataFrame(
        [("t", *row) for row in hexagon()], "target string, " + ATOM
    )
    other = [
        ("t", m, i, e, x, 0.0 if turn else y, (y if turn else 0.0) + gap, s) for m, i, e, x, y, _, s in hexagon()
    ]
    keys = ["target", "mol"]
    found = []
    for atoms in (base, spark.createDataFrame(other, "target string, " + ATOM)):
        found.append(rings.molecule_rings(atoms, graph.infer_bonds(atoms, keys), keys))
    return rings.ring_stacking(found[0], found[1].withColumnRenamed("mol", "residue"))


def test_stacking_kinds(spark):
    flat = stacked(spark, False, 3.5).collect()
    assert [(r.kind, r.structure) for r in flat] == [("STACKING", "OTHER")]
    assert [r.kind for r in stacked(spark, True, 4.8).collect()] == ["T-SHAPED"]
    assert stacked(spark, False, 7.6).count() == 0


def charged(spark, rows):
    atoms = spark.createDataFrame([("m", i, *r, "") for i, r in enumerate(rows, 1)], ATOM)
    found = charges.molecule_charges(atoms, graph.infer_bonds(atoms, KEYS), KEYS)
    return [(r.positive, list(r.members), (r.x, r.y, r.z)) for r in found.collect()]


def test_charge_rules(spark):
    carboxylate = [("C", 0, 0, 0), ("O", 1.2, 0.4, 0), ("O", -1.2, 0.4, 0), ("C", 0, -1.5, 0)]
    rows = [(e, float(x), float(y), float(z)) for e, x, y, z in carboxylate]
    assert charged(spark, rows) == [(False, [2, 1, 3], (0.0, 0.4, 0.0))]
    guanidino = [("C", 0, 0, 0), ("N", 1.2, 0.6, 0), ("N", -1.2, 0.6, 0), ("N", 0, -1.4, 0), ("C", 0.9, -2.4, 0)]
    rows = [(e, float(x), float(y), float(z)) for e, x, y, z in guanidino]
    assert charged(spark, rows) == [(True, [1, 2, 3], (0.0, 0.6, 0.0))]
    s = 0.8
    ammonium = [("N", 0, 0, 0), ("C", s, s, s), ("C", -s, -s, s), ("C", s, -s, -s)]
    rows = [(e, float(x), float(y), float(z)) for e, x, y, z in ammonium]
    assert charged(spark, rows) == [(True, [1, 2, 3, 4], (0.0, 0.0, 0.0))]
    flat = [("N", 0, 0, 0), ("C", 1.4, 0, 0), ("C", -0.7, 1.2, 0), ("C", -0.7, -1.2, 0)]
    assert charged(spark, [(e, float(x), float(y), float(z)) for e, x, y, z in flat]) == []
    assert charged(spark, [("ZN", 1.0, 2.0, 3.0)]) == [(True, [1], (1.0, 2.0, 3.0))]


def test_bond_lengths(spark):
    rows = [("m", 1, "H", 0.0, 0.0, 0.0, ""), ("m", 2, "N", 1.9, 0.0, 0.0, ""), ("m", 3, "H", 0.0, 0.7, 0.0, "")]
    atoms = spark.createDataFrame(rows, ATOM)
    assert [(r.i, r.j) for r in graph.infer_bonds(atoms, KEYS).collect()] == [(1, 2)]


def test_flexibility(spark):
    chain = [("m", i, "C", 1.5 * i, 0.0, 0.0, "") for i in range(1, 5)]
    atoms = spark.createDataFrame(chain, ATOM)
    counts = graph.path_counts(atoms, graph.infer_bonds(atoms, KEYS), KEYS)
    got = graph.flexibility(counts, F.lit(0.0)).first()
    assert (got.heavy_atoms, got.bonds, got.paths) == (4, 3, 2)
    assert (got.kappa1, got.kappa2, got.flexibility) == (4.0, 3.0, 3.0)


def test_hydrogen_bonds(spark):
    schema = (
        "target string, pose int, atom_id int, element string, name string, x double, y double, z double, "
        "structure string"
    )
    ligand = [("t", 1, 1, "O", "O1", 0.0, 0.0, 0.0, ""), ("t", 1, 2, "H", "H1", 0.97, 0.0, 0.0, "")]
    receptor = [
        ("t", 0, 1, "N", "N", 2.9, 0.2, 0.0, "ALPHA"),
        ("t", 0, 2, "H", "HN", 2.9, 1.2, 0.0, "ALPHA"),
        ("t", 0, 3, "O", "OD1", 0.0, 3.0, 0.0, "BETA"),
    ]
    found = contacts.hydrogen_bonds(
        spark.createDataFrame(ligand, schema),
        spark.createDataFrame(receptor, schema).drop("pose"),
        ["target", "pose"],
    )
    got = [(r.donor, r.chain_side, r.structure, r.ligand_atom, r.h_atom, r.receptor_atom) for r in found.collect()]
    assert got == [("LIGAND", "BACKBONE", "ALPHA", 1, 2, 1)]


def test_contact_bands_and_same_place(spark):
    schema = (
        "target string, pose int, atom_type string, element string, name string, charge double, "
        "x double, y double, z double, structure string"
    )
    ligand = [("t", 1, "N", "N", "N1", 0.5, 0.0, 0.0, 0.0, "")]
    receptor = [("t", 0, "C", "C", "CA", 0.5, d, 0.0, 0.0, "ALPHA") for d in (0.0, 2.4, 2.5, 3.9, 4.0)]
    pairs = contacts.contact_pairs(
        spark.createDataFrame(ligand, schema), spark.createDataFrame(receptor, schema).drop("pose")
    )
    row = contacts.contact_counts(pairs, ["target", "pose"]).first()
    assert (row.pair, row.closest, row.close) == ("C_N", 2, 2)
    energy = contacts.coulomb_sums(pairs, ["target", "pose"]).first().energy
    want = sum(0.25 / d for d in (2.4, 2.5, 3.9)) * 138.94238460104697e4
    assert energy == pytest.approx(want)
