"""Tables that results depend on."""

from __future__ import annotations

# Named lists of evaluation targets.
TARGET_LISTS: dict[str, list[str]] = {
    "true_decoy_gap": """
        Q9NWZ3 P42336 P27986 O60674 P43405 P10721 O14965 P15056 P23458 P11362 P29597 O00329
        P28482 Q96GD4 P00533 Q06187 O14757 P36888 P00519 Q05397 Q16539 P08581 P11802 P06239
        O75116 Q9Y233 Q14432 Q08499 P00918 Q16790 Q00987 P78536 P09874 P35372 P20309 P41143
        P35462 P07550 P14416 P08172 P34969 P08908 P28335 P30542 P29274 P34972 P21453 O43614
        P28223 P08253 P03952 P14780 P00742 P45452 P27487 P08246 P07711 P00734 P03372 Q92731
        P51449 P04150 Q96RI1 P31645 P01375 O15379 Q9UBN7 Q07817 Q07820 P10415 O60341
    """.split(),
    "dekois1": """
        ACE ACHE ADRB2 CATL DHFR ERBB2 HDAC2 HIV1PR HSP90 JAK3 JNK2 MDM2 P38-alpha PI3Kg PNP
        PPARG Thrombin TS
    """.split(),
    "dekois2_unseen": """
        11BETAHSD1 ACE2 ALR2 COX1 CYP2A6 ER-BETA INHA MMP2 PPARA PPARG TK
    """.split(),
    "dude_unseen": """
        ALDR CP2C9 CP3A4 DHI1 HXK4 KITH NOS1 PGH1 PPARA PPARG PYRD SAHH
    """.split(),
}
LOWER_CASE_LISTS = {"dekois1", "dekois2_unseen", "dude_unseen"}

# Residue names counted as protein.
PROTEIN_RESIDUES = """
    ALA ARG ASN ASP ASH ASX CYS CYM CYX GLN GLU GLH GLX GLY HIS HID HIE HIP ILE LEU LYS LYN MET
    PHE PRO SER THR TRP TYR VAL
""".split()

# Atom names of the backbone.
BACKBONE_NAMES = ["CA", "C", "O", "N"]

# Element symbols of two letters that an atom name may start with.
TWO_LETTER_ELEMENTS = ["BR", "CL", "BI", "AS", "AG", "LI", "MG", "MN", "RH", "ZN", "FE"]

# Elements that carry a positive charge on their own.
METALS = ["MG", "MN", "RH", "ZN", "FE", "BI", "AS", "AG"]

# Bond lengths by element pair, in either order. For H and N the
# longer of two lengths given for the two orders applies.
BOND_LENGTHS: dict[tuple[str, str], float] = {
    ("C", "C"): 1.53,
    ("N", "N"): 1.425,
    ("O", "O"): 1.469,
    ("S", "S"): 2.048,
    ("C", "H"): 1.059,
    ("C", "N"): 1.469,
    ("C", "O"): 1.413,
    ("C", "S"): 1.819,
    ("H", "N"): 1.633,
    ("N", "O"): 1.463,
    ("O", "S"): 1.577,
    ("O", "H"): 0.967,
    ("S", "H"): 2.025 / 1.5,
    ("S", "N"): 1.633,
    ("C", "F"): 1.399,
    ("C", "CL"): 1.790,
    ("C", "BR"): 1.910,
    ("C", "I"): 2.162,
    ("S", "BR"): 2.321,
    ("S", "CL"): 2.283,
    ("S", "F"): 1.640,
    ("S", "I"): 2.687,
    ("P", "BR"): 2.366,
    ("P", "CL"): 2.008,
    ("P", "F"): 1.495,
    ("P", "I"): 2.490,
    ("P", "O"): 1.6,
    ("N", "BR"): 1.843,
    ("N", "CL"): 1.743,
    ("N", "F"): 1.406,
    ("N", "I"): 2.2,
    ("SI", "BR"): 2.284,
    ("SI", "CL"): 2.072,
    ("SI", "F"): 1.636,
    ("SI", "P"): 2.264,
    ("SI", "S"): 2.145,
    ("SI", "SI"): 2.359,
    ("SI", "C"): 1.888,
    ("SI", "N"): 1.743,
    ("SI", "O"): 1.631,
}

# Aromatic rings of protein residues, atoms in ring order.
TEMPLATE_RINGS: list[tuple[tuple[str, ...], tuple[str, ...]]] = [
    (("PHE",), ("CG", "CD1", "CE1", "CZ", "CE2", "CD2")),
    (("TYR",), ("CG", "CD1", "CE1", "CZ", "CE2", "CD2")),
    (("HIS", "HID", "HIE", "HIP"), ("CG", "ND1", "CE1", "NE2", "CD2")),
    (("TRP",), ("CG", "CD1", "NE1", "CE2", "CD2")),
    (("TRP",), ("CE2", "CD2", "CE3", "CZ3", "CH2", "CZ2")),
]

# Charged groups of protein residues: residue names, atoms whose
# mean is the charge position, and whether the charge is positive.
TEMPLATE_CHARGES: list[tuple[tuple[str, ...], tuple[str, ...], bool]] = [
    (("LYS", "LYN"), ("NZ",), True),
    (("ARG",), ("NH1", "NH2"), True),
    (("HIS", "HID", "HIE", "HIP"), ("NE2", "ND1"), True),
    (("GLU", "GLH", "GLX"), ("OE1", "OE2"), False),
    (("ASP", "ASH", "ASX"), ("OD1", "OD2"), False),
]

# Fixed value: factor from charge products over distance to J/mol.
COULOMB_FACTOR = 138.94238460104697e4

# Type keys of protein atoms that pairs are counted for.
PROTEIN_TYPE_KEYS = """
    C;4;1;3;0;0 C;4;2;1;1;1 C;4;2;2;0;0 C;4;2;2;0;1 C;4;3;0;0;0 C;4;3;0;1;1 C;4;3;1;0;0 C;4;3;1;0;1
    C;5;3;0;0;0 C;6;3;0;0;0 N;3;1;2;0;0 N;3;2;0;1;1 N;3;2;1;0;0 N;3;2;1;1;1 N;3;3;0;0;1 N;4;1;2;0;0
    N;4;1;3;0;0 N;4;2;1;0;0 O;2;1;0;0;0 O;2;1;1;0;0 S;2;1;1;0;0 S;2;2;0;0;0
""".split()

# Type keys of ligand atoms that pairs are counted for.
LIGAND_TYPE_KEYS = """
    Br;1;1;0;0;0 C;3;3;0;1;1 C;4;1;1;0;0 C;4;1;2;0;0 C;4;1;3;0;0 C;4;2;0;0;0 C;4;2;1;0;0 C;4;2;1;0;1
    C;4;2;1;1;1 C;4;2;2;0;0 C;4;2;2;0;1 C;4;3;0;0;0 C;4;3;0;0;1 C;4;3;0;1;1 C;4;3;1;0;0 C;4;3;1;0;1
    C;4;4;0;0;0 C;4;4;0;0;1 C;5;3;0;0;0 C;5;3;0;1;1 C;6;3;0;0;0 Cl;1;1;0;0;0 F;1;1;0;0;0 I;1;1;0;0;0
    N;3;1;0;0;0 N;3;1;1;0;0 N;3;1;2;0;0 N;3;2;0;0;0 N;3;2;0;0;1 N;3;2;0;1;1 N;3;2;1;0;0 N;3;2;1;0;1
    N;3;2;1;1;1 N;3;3;0;0;0 N;3;3;0;0;1 N;3;3;0;1;1 N;4;1;2;0;0 N;4;1;3;0;0 N;4;2;1;0;0 N;4;2;2;0;0
    N;4;2;2;0;1 N;4;3;0;0;0 N;4;3;0;0;1 N;4;3;1;0;0 N;4;3;1;0;1 N;4;4;0;0;0 N;4;4;0;0;1 N;5;2;0;0;0
    N;5;3;0;0;0 N;5;3;0;1;1 O;2;1;0;0;0 O;2;1;1;0;0 O;2;2;0;0;0 O;2;2;0;0;1 O;2;2;0;1;1 P;5;4;0;0;0
    P;6;4;0;0;0 P;6;4;0;0;1 P;7;4;0;0;0 S;2;1;0;0;0 S;2;1;1;0;0 S;2;2;0;0;0 S;2;2;0;0;1 S;2;2;0;1;1
    S;3;3;0;0;0 S;3;3;0;0;1 S;4;3;0;0;0 S;6;4;0;0;0 S;6;4;0;0;1 S;7;4;0;0;0
""".split()

# The ligand type keys whose pairs are counted.
COUNTED_LIGAND_TYPES = """
    Br;1;1;0;0;0 C;4;1;3;0;0 C;4;2;0;0;0 C;4;2;1;0;0 C;4;2;1;0;1 C;4;2;2;0;0 C;4;2;2;0;1 C;4;3;0;0;0
    C;4;3;0;0;1 C;4;3;1;0;0 C;4;3;1;0;1 C;4;4;0;0;0 C;4;4;0;0;1 Cl;1;1;0;0;0 F;1;1;0;0;0 N;3;1;0;0;0
    N;3;1;1;0;0 N;3;1;2;0;0 N;3;2;1;0;0 N;3;2;1;0;1 N;3;3;0;0;0 N;3;3;0;0;1 N;4;1;3;0;0 N;4;2;2;0;1
    N;4;4;0;0;0 N;5;3;0;0;0 O;2;1;0;0;0 O;2;1;1;0;0 O;2;2;0;0;0 O;2;2;0;0;1 P;5;4;0;0;0 S;2;1;1;0;0
    S;2;2;0;0;1 S;6;4;0;0;0
""".split()

# Type keys of protein atoms as residue-atom and key, one per line.
ATOM_KEYS: list[tuple[str, str]] = [
    tuple(line.split(","))
    for line in """
ALA-C,C;4;3;0;0;0
ALA-CA,C;4;3;1;0;0
ALA-CB,C;4;1;3;0;0
ALA-N,N;3;2;1;0;0
ALA-O,O;2;1;0;0;0
ALA-OXT,O;2;1;0;0;0
ARG-C,C;4;3;0;0;0
ARG-CA,C;4;3;1;0;0
ARG-CB,C;4;2;2;0;0
ARG-CD,C;4;2;2;0;0
ARG-CG,C;4;2;2;0;0
ARG-CZ,C;6;3;0;0;0
ARG-N,N;3;2;1;0;0
ARG-NE,N;4;2;1;0;0
ARG-NH1,N;4;1;2;0;0
ARG-NH2,N;4;1;2;0;0
ARG-O,O;2;1;0;0;0
ARG-OXT,O;2;1;0;0;0
ASN-C,C;4;3;0;0;0
ASN-CA,C;4;3;1;0;0
ASN-CB,C;4;2;2;0;0
ASN-CG,C;4;3;0;0;0
ASN-N,N;3;2;1;0;0
ASN-ND2,N;3;1;2;0;0
ASN-O,O;2;1;0;0;0
ASN-OD1,O;2;1;0;0;0
ASN-OXT,O;2;1;0;0;0
ASP-C,C;4;3;0;0;0
ASP-CA,C;4;3;1;0;0
ASP-CB,C;4;2;2;0;0
ASP-CG,C;5;3;0;0;0
ASP-N,N;3;2;1;0;0
ASP-O,O;2;1;0;0;0
ASP-OD1,O;2;1;0;0;0
ASP-OD2,O;2;1;0;0;0
ASP-OXT,O;2;1;0;0;0
CYS-C,C;4;3;0;0;0
CYS-CA,C;4;3;1;0;0
CYS-CB,C;4;2;2;0;0
CYS-N,N;3;2;1;0;0
CYS-O,O;2;1;0;0;0
CYS-OXT,O;2;1;0;0;0
CYS-SG,S;2;1;1;0;0
GLN-C,C;4;3;0;0;0
GLN-CA,C;4;3;1;0;0
GLN-CB,C;4;2;2;0;0
GLN-CD,C;4;3;0;0;0
GLN-CG,C;4;2;2;0;0
GLN-N,N;3;2;1;0;0
GLN-NE2,N;3;1;2;0;0
GLN-O,O;2;1;0;0;0
GLN-OE1,O;2;1;0;0;0
GLN-OXT,O;2;1;0;0;0
GLU-C,C;4;3;0;0;0
GLU-CA,C;4;3;1;0;0
GLU-CB,C;4;2;2;0;0
GLU-CD,C;5;3;0;0;0
GLU-CG,C;4;2;2;0;0
GLU-N,N;3;2;1;0;0
GLU-O,O;2;1;0;0;0
GLU-OE1,O;2;1;0;0;0
GLU-OE2,O;2;1;0;0;0
GLU-OXT,O;2;1;0;0;0
GLY-C,C;4;3;0;0;0
GLY-CA,C;4;2;2;0;0
GLY-N,N;3;2;1;0;0
GLY-O,O;2;1;0;0;0
GLY-OXT,O;2;1;0;0;0
HIS-C,C;4;3;0;0;0
HIS-CA,C;4;3;1;0;0
HIS-CB,C;4;2;2;0;0
HIS-CD2,C;4;2;1;1;1
HIS-CE1,C;4;2;1;1;1
HIS-CG,C;4;3;0;1;1
HIS-N,N;3;2;1;0;0
HIS-ND1,N;3;2;0;1;1
HIS-NE2,N;3;2;1;1;1
HIS-O,O;2;1;0;0;0
HIS-OXT,O;2;1;0;0;0
ILE-C,C;4;3;0;0;0
ILE-CA,C;4;3;1;0;0
ILE-CB,C;4;3;1;0;0
ILE-CD1,C;4;1;3;0;0
ILE-CG1,C;4;2;2;0;0
ILE-CG2,C;4;1;3;0;0
ILE-N,N;3;2;1;0;0
ILE-O,O;2;1;0;0;0
ILE-OXT,O;2;1;0;0;0
LEU-C,C;4;3;0;0;0
LEU-CA,C;4;3;1;0;0
LEU-CB,C;4;2;2;0;0
LEU-CD1,C;4;1;3;0;0
LEU-CD2,C;4;1;3;0;0
LEU-CG,C;4;3;1;0;0
LEU-N,N;3;2;1;0;0
LEU-O,O;2;1;0;0;0
LEU-OXT,O;2;1;0;0;0
LYS-C,C;4;3;0;0;0
LYS-CA,C;4;3;1;0;0
LYS-CB,C;4;2;2;0;0
LYS-CD,C;4;2;2;0;0
LYS-CE,C;4;2;2;0;0
LYS-CG,C;4;2;2;0;0
LYS-N,N;3;2;1;0;0
LYS-NZ,N;4;1;3;0;0
LYS-O,O;2;1;0;0;0
LYS-OXT,O;2;1;0;0;0
MET-C,C;4;3;0;0;0
MET-CA,C;4;3;1;0;0
MET-CB,C;4;2;2;0;0
MET-CE,C;4;1;3;0;0
MET-CG,C;4;2;2;0;0
MET-N,N;3;2;1;0;0
MET-O,O;2;1;0;0;0
MET-OXT,O;2;1;0;0;0
MET-SD,S;2;2;0;0;0
PHE-C,C;4;3;0;0;0
PHE-CA,C;4;3;1;0;0
PHE-CB,C;4;2;2;0;0
PHE-CD1,C;4;2;1;1;1
PHE-CD2,C;4;2;1;1;1
PHE-CE1,C;4;2;1;1;1
PHE-CE2,C;4;2;1;1;1
PHE-CG,C;4;3;0;1;1
PHE-CZ,C;4;2;1;1;1
PHE-N,N;3;2;1;0;0
PHE-O,O;2;1;0;0;0
PHE-OXT,O;2;1;0;0;0
PRO-C,C;4;3;0;0;0
PRO-CA,C;4;3;1;0;1
PRO-CB,C;4;2;2;0;1
PRO-CD,C;4;2;2;0;1
PRO-CG,C;4;2;2;0;1
PRO-N,N;3;3;0;0;1
PRO-O,O;2;1;0;0;0
PRO-OXT,O;2;1;0;0;0
SER-C,C;4;3;0;0;0
SER-CA,C;4;3;1;0;0
SER-CB,C;4;2;2;0;0
SER-N,N;3;2;1;0;0
SER-O,O;2;1;0;0;0
SER-OG,O;2;1;1;0;0
SER-OXT,O;2;1;0;0;0
THR-C,C;4;3;0;0;0
THR-CA,C;4;3;1;0;0
THR-CB,C;4;3;1;0;0
THR-CG2,C;4;1;3;0;0
THR-N,N;3;2;1;0;0
THR-O,O;2;1;0;0;0
THR-OG1,O;2;1;1;0;0
THR-OXT,O;2;1;0;0;0
TRP-C,C;4;3;0;0;0
TRP-CA,C;4;3;1;0;0
TRP-CB,C;4;2;2;0;0
TRP-CD1,C;4;2;1;1;1
TRP-CD2,C;4;3;0;1;1
TRP-CE2,C;4;3;0;1;1
TRP-CE3,C;4;2;1;1;1
TRP-CG,C;4;3;0;1;1
TRP-CH2,C;4;2;1;1;1
TRP-CZ2,C;4;2;1;1;1
TRP-CZ3,C;4;2;1;1;1
TRP-N,N;3;2;1;0;0
TRP-NE1,N;3;2;1;1;1
TRP-O,O;2;1;0;0;0
TRP-OXT,O;2;1;0;0;0
TYR-C,C;4;3;0;0;0
TYR-CA,C;4;3;1;0;0
TYR-CB,C;4;2;2;0;0
TYR-CD1,C;4;2;1;1;1
TYR-CD2,C;4;2;1;1;1
TYR-CE1,C;4;2;1;1;1
TYR-CE2,C;4;2;1;1;1
TYR-CG,C;4;3;0;1;1
TYR-CZ,C;4;3;0;1;1
TYR-N,N;3;2;1;0;0
TYR-O,O;2;1;0;0;0
TYR-OH,O;2;1;1;0;0
TYR-OXT,O;2;1;0;0;0
VAL-C,C;4;3;0;0;0
VAL-CA,C;4;3;1;0;0
VAL-CB,C;4;3;1;0;0
VAL-CG1,C;4;1;3;0;0
VAL-CG2,C;4;1;3;0;0
VAL-N,N;3;2;1;0;0
VAL-O,O;2;1;0;0;0
VAL-OXT,O;2;1;0;0;0
""".split()
]
