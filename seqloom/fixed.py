"""Names, lookup tables, constants and text formats that results depend on."""

# --- The eight-slot property vector, order-significant -----------------------------
PROPERTIES = ["toughness", "toughness_sd", "E", "E_sd", "strength", "strength_sd", "strain", "strain_sd"]
MECHANICAL_SLOTS = [0, 2, 4, 6]
SD_SLOTS = [1, 3, 5, 7]
MECHANICAL = [PROPERTIES[i] for i in MECHANICAL_SLOTS]

# Raw measurement column of every property, same order as PROPERTIES.
MEASUREMENT_COLUMNS = [
    "toughness", "toughness_sd", "young's_modulus", "young's_modulus_sd",
    "tensile_strength", "tensile_strength_sd", "strain_at_break", "strain_at_break_sd",
]
FASTA_FIELDS = ["seq_id", "idv_id", "family", "genus", "species", "type", "subtype", "region"]

# Type-label prefixes, tried in this order; anything else is "other".
FAMILY_PREFIXES = ["MaSp", "MiSp", "AcSp", "AgSp", "PySp", "CySp", "Flag", "CrSp"]

# --- Property targets and the score published for each ------------------------------
TARGETS = {
    "F1": ([0.600, 0.204, 0.279, 0.043, 0.329, 0.127, 0.502, 0.139], 0.8764),
    "F2": ([0.300, 0.200, 0.200, 0.100, 0.300, 0.100, 0.200, 0.100], 0.8369),
    "F3": ([0.100, 0.200, 0.200, 0.040, 0.300, 0.100, 0.700, 0.100], 0.6889),
    "S1": ([0.250, 0.252, 0.200, 0.151, 0.310, 0.203, 0.293, 0.265], 0.8899),
    "S2": ([0.550, 0.252, 0.750, 0.151, 0.310, 0.203, 0.293, 0.265], 0.5640),
    "S3": ([1.000, 0.252, 0.450, 0.151, 0.200, 0.203, 0.293, 0.265], 0.7167),
    "S4": ([0.900, 0.252, 0.800, 0.151, 0.310, 0.203, 0.293, 0.265], 0.7843),
    "S5": ([0.240, 0.252, 0.206, 0.151, 0.270, 0.203, 0.293, 0.265], 0.7751),
}
SEED = 20260807
CANDIDATE_GRID = [1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048]

# --- Residues ---------------------------------------------------------------------
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
AMBIGUOUS = "XBZJUO"
HELIX_LEGACY, TURN_LEGACY, SHEET_LEGACY = "VIYFWL", "NPGS", "EMAL"
HELIX_CORRECTED, TURN_CORRECTED, SHEET_CORRECTED = "EMALK", "NPGSD", "VIYFWLT"
AROMATIC = "FWY"

SCHEMES = {
    "A_lehninger_style": {"hydrophobic": "AVLIPFMWG", "polar": "STCYNQ", "charged": "DEKRH"},
    "B_alternative": {"hydrophobic": "AVLIPFMWCY", "polar": "STNQGH", "charged": "DEKR"},
}
REPORTED_RESIDUES = "VIPLFTQYNSDEKR"

# --- Motifs -----------------------------------------------------------------------
CANONICAL_MOTIFS = {
    "polyA": "A{4,}",
    "GGX": "(?:GG[ALQSY])+",
    "GPGXX": "(?:GPG[A-Z]{2})+",
    "GA": "(?:GA){3,}",
    "QQ": "Q{2,}",
}
KNOCKOUT_MOTIFS = ["polyA", "GGX", "GPGXX"]
# motif id, pattern, property, direction
LITERAL_MOTIFS = [
    ("T_pos_1", "GYGQGG", "toughness", "pos"),
    ("T_pos_2", "GGGQ", "toughness", "pos"),
    ("T_neg_1", "SQGP", "toughness", "neg"),
    ("T_neg_2", "SY", "toughness", "neg"),
    ("T_neg_3", "SV", "toughness", "neg"),
    ("TS_pos_1", "GYGQGG", "strength", "pos"),
    ("TS_pos_2", "QGGS", "strength", "pos"),
    ("TS_neg_1", "PQ", "strength", "neg"),
    ("SB_pos_1", "GYGQGG", "strain", "pos"),
    ("SB_pos_2", "QGP", "strain", "pos"),
    ("SB_pos_3", "PGA", "strain", "pos"),
    ("E_pos_1", "PA", "E", "pos"),
    ("E_pos_2", "GQ", "E", "pos"),
    ("E_neg_1", "GGQ", "E", "neg"),
]
TERMINUS_N, TERMINUS_C = 130, 100
SHUFFLE_BLOCK = 20

# --- Prompt formats ---------------------------------------------------------------
FORWARD_TASK = "CalculateSilkContent"
INVERSE_TASK = "GenerateSilkContent"
SOLUBILITY_TASK = "CalculateSolubility"

# --- Decoding settings: temperature, top_k, top_p, max_new_tokens, do_sample ---------
DECODING = {
    "forward_greedy": (1.0, 0, 1.0, 64, False),
    "forward_sampled": (0.01, 500, 0.9, 64, True),
    "inverse": (1.25, 500, 0.8, 512, True),
    "solubility": (0.01, 500, 0.9, 7, True),
}
DECODING_BUDGETS = [32, 64, 96, 128, 192]

# --- Tolerances -------------------------------------------------------------------
EXACT_LABEL_TOL = 5e-4
ANCHOR_TOL = 0.002
FLOOR_RESOLUTION = 1e-4
MW_TOL, INDEX_TOL = 0.5, 0.05

# --- Physico-chemical constants (public literature) ---------------------------------
WATER_MASS = 18.0153
UNKNOWN_RESIDUE_MASS = 111.985
RESIDUE_MASS = {
    "A": 89.0932, "C": 121.1582, "D": 133.1027, "E": 147.1293, "F": 165.1891,
    "G": 75.0666, "H": 155.1546, "I": 131.1729, "K": 146.1876, "L": 131.1729,
    "M": 149.2113, "N": 132.1179, "P": 115.1305, "Q": 146.1445, "R": 174.201,
    "S": 105.0926, "T": 119.1192, "V": 117.1463, "W": 204.2252, "Y": 181.1885,
}
# Kyte & Doolittle (1982)
HYDROPATHY = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2,
    "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5,
    "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}
# Bjellqvist pK values
POSITIVE_PK = {"K": 10.0, "R": 12.0, "H": 5.98}
NEGATIVE_PK = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
N_TERMINUS_PK, N_TERMINUS_PK_BY_RESIDUE = 7.5, {
    "A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7,
}
C_TERMINUS_PK, C_TERMINUS_PK_BY_RESIDUE = 3.55, {"D": 4.55, "E": 4.75}
PI_START, PI_LOW, PI_HIGH, PI_WIDTH = 7.775, 4.05, 12.0, 0.0001
# Guruprasad (1990): dipeptide weights by first residue; every pair not named weighs 1.
INSTABILITY = {
    "A": {"C": 44.94, "D": -7.49, "H": -7.49, "P": 20.26},
    "C": {"D": 20.26, "H": 33.6, "L": 20.26, "M": 33.6, "P": 20.26, "Q": -6.54, "T": 33.6, "V": -6.54, "W": 24.68},
    "D": {"F": -6.54, "K": -7.49, "R": -6.54, "S": 20.26, "T": -14.03},
    "E": {"C": 44.94, "D": 20.26, "E": 33.6, "H": -6.54, "I": 20.26, "P": 20.26, "Q": 20.26, "S": 20.26, "W": -14.03},
    "F": {"D": 13.34, "K": -14.03, "P": 20.26, "Y": 33.601},
    "G": {"A": -7.49, "E": -6.54, "G": 13.34, "I": -7.49, "K": -7.49, "N": -7.49, "T": -7.49, "W": 13.34, "Y": -7.49},
    "H": {"F": -9.37, "G": -9.37, "I": 44.94, "K": 24.68, "N": 24.68, "P": -1.88, "T": -6.54, "W": -1.88, "Y": 44.94},
    "I": {"E": 44.94, "H": 13.34, "K": -7.49, "L": 20.26, "P": -1.88, "V": -7.49},
    "K": {"G": -7.49, "I": -7.49, "L": -7.49, "M": 33.6, "P": -6.54, "Q": 24.64, "R": 33.6, "V": -7.49},
    "L": {"K": -7.49, "P": 20.26, "Q": 33.6, "R": 20.26, "W": 24.68},
    "M": {"A": 13.34, "H": 58.28, "M": -1.88, "P": 44.94, "Q": -6.54, "R": -6.54, "S": 44.94, "T": -1.88, "Y": 24.68},
    "N": {"C": -1.88, "F": -14.03, "G": -14.03, "I": 44.94, "K": 24.68, "P": -1.88, "Q": -6.54, "T": -7.49, "W": -9.37},
    "P": {"A": 20.26, "C": -6.54, "D": -6.54, "E": 18.38, "F": 20.26, "M": -6.54, "P": 20.26, "Q": 20.26, "R": -6.54, "S": 20.26, "V": 20.26, "W": -1.88},
    "Q": {"C": -6.54, "D": 20.26, "E": 20.26, "F": -6.54, "P": 20.26, "Q": 20.26, "S": 44.94, "V": -6.54, "Y": -6.54},
    "R": {"G": -7.49, "H": 20.26, "N": 13.34, "P": 20.26, "Q": 20.26, "R": 58.28, "S": 44.94, "W": 58.28, "Y": -6.54},
    "S": {"C": 33.6, "E": 20.26, "P": 44.94, "Q": 20.26, "R": 20.26, "S": 20.26},
    "T": {"E": 20.26, "F": 13.34, "G": -7.49, "N": -14.03, "Q": -6.54, "W": -14.03},
    "V": {"D": -14.03, "G": -7.49, "K": -1.88, "P": 20.26, "T": -7.49, "Y": -6.54},
    "W": {"A": -14.03, "G": -9.37, "H": 24.68, "L": 13.34, "M": 24.68, "N": 13.34, "T": -14.03, "V": -7.49},
    "Y": {"A": 24.68, "D": 24.68, "E": -6.54, "G": -7.49, "H": 13.34, "M": 44.94, "P": 13.34, "R": -15.91, "T": -7.49, "W": -9.37, "Y": 13.34},
}
