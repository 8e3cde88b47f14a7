"""Default vocabularies, unit factors and rule tables. All functions take them as parameters; these are defaults."""

# The keyword families below decide results and are stated as they are.

#: Family "edge": keywords by which the type of an edge is told from its two ends.
EDGE_KEYWORDS = {
    "Processing": [
        "temperature", "pressure", "time", "atmosphere", "substrate", "precursor", "method", "annealing", "doping", "growth", "cvd", "mocvd",
        "sputtering", "catalyst", "solvent", "concentration",
    ],
    "Structure": [
        "crystallinity", "phase", "morphology", "defect", "grain", "layer", "vacancy", "stoichiometry", "crystal", "strain", "doping_level",
        "thickness", "orientation", "grain_size",
    ],
    "Property": [
        "mobility", "band_gap", "conductivity", "carrier", "resistance", "photoluminescence", "absorption", "emission", "ferromagnetic", "hall",
        "transconductance", "on/off",
    ],
}

#: Family "node": keywords by which a node's layer is told; ties go to the earlier layer.
NODE_KEYWORDS = {
    "Processing": [
        "temperature", "pressure", "time", "atmosphere", "substrate", "precursor", "method", "annealing", "doping", "growth", "cvd", "mocvd",
        "sputtering", "catalyst", "solvent", "concentration", "deposition", "synthesis", "anneal", "flux", "ratio", "dopant",
    ],
    "Structure": [
        "crystallinity", "phase", "morphology", "defect", "grain", "layer", "vacancy", "stoichiometry", "crystal", "strain", "doping_level",
        "thickness", "orientation", "grain_size", "lattice", "microstructure", "texture", "roughness",
    ],
    "Property": [
        "mobility", "band_gap", "conductivity", "carrier", "resistance", "photoluminescence", "absorption", "emission", "ferromagnetic", "hall",
        "transconductance", "on/off", "property", "electronic", "optical", "thermal", "mechanical", "seebeck", "figure_of_merit",
    ],
}

#: Family "name": another node classifier; ties go to the later layer and no match to Processing.
NAME_KEYWORDS = {
    "Processing": [
        "temperature", "pressure", "time", "duration", "atmosphere", "substrate", "precursor", "method", "annealing", "doping", "growth", "cvd",
        "mocvd", "sputtering", "catalyst", "solvent", "concentration", "flux", "rate", "power", "bias", "rf", "plasma", "laser", "pulsed",
        "continuous", "batch", "flow", "ratio", "partial_pressure", "carrier_gas", "argon", "nitrogen", "hydrogen", "vacuum", "ambient",
    ],
    "Structure": [
        "crystallinity", "phase", "morphology", "defect", "grain", "layer", "vacancy", "stoichiometry", "crystal", "strain", "doping_level",
        "thickness", "orientation", "grain_size", "lattice", "interlayer", "stacking", "monolayer", "bilayer", "trilayer", "multilayer", "domain",
        "boundary", "dislocation", "substitution", "interstitial", "adsorption", "coverage",
    ],
    "Property": [
        "mobility", "band_gap", "conductivity", "carrier", "resistance", "photoluminescence", "absorption", "emission", "ferromagnetic", "hall",
        "transconductance", "on/off", "on_off_ratio", "threshold", "saturation", "responsivity", "detectivity", "neff", "seebeck",
        "thermal_conductivity", "youngs_modulus", "stiffness", "toughness", "hardness", "flexibility", "transparency",
    ],
}

#: Signals by which a question asks for a layer.
QUESTION_SIGNALS = {
    "Processing": [
        "temperature", "pressure", "cvd", "mocvd", "sputtering", "annealing", "growth", "deposition", "synthesis", "method", "doping", "dopant",
        "precursor", "substrate", "atmosphere", "time", "duration",
    ],
    "Structure": [
        "crystallinity", "defect", "grain", "phase", "morphology", "layer", "vacancy", "stoichiometry", "strain", "thickness", "orientation",
        "structure", "microstructure",
    ],
    "Property": [
        "mobility", "conductivity", "band gap", "bandgap", "carrier", "property", "electronic", "optical", "thermal", "mechanical",
        "ferromagnetic", "seebeck", "transconductance",
    ],
}

LAYERS = ["Processing", "Structure", "Property"]

#: Whole words of a question and the layers they ask for.
QUESTION_WORDS = [
    (["predict", "property", "measure", "performance"], ["Property"]),
    (["structure", "crystal", "defect", "phase", "morphology"], ["Structure", "Property"]),
    (["synthes", "grow", "deposit", "fabricat", "process"], ["Processing", "Structure", "Property"]),
    (["optimize", "improve", "enhance"], ["Processing", "Structure", "Property"]),
    (["why", "how", "cause", "mechanism"], ["Processing", "Structure", "Property"]),
    (["what", "which"], ["Property"]),
]

#: Verbs of an effect text and the relation they stand for, first match first.
RELATION_VERBS = [
    ("increases", ["increases", "improves", "enhances", "promotes", "raises"]),
    ("decreases", ["decreases", "reduces", "suppresses", "lowers", "diminishes"]),
    ("induces", ["induces", "causes", "leads to", "produces", "creates"]),
    ("inhibits", ["inhibits", "prevents", "blocks", "hinders"]),
]

#: Names looked for in a source file's name, first match first; short names are written in capitals.
MATERIALS = ["mos2", "ws2", "wse2", "mose2", "mote2", "wte2", "graphene", "hbn", "bn", "black_phosphorus", "bp"]
SHORT_NAME = 4

#: Further patterns, used where none of MATERIALS matches.
MORE_MATERIALS = [
    ("wte2", "WTe2"), ("mose2", "MoSe2"), ("wse2", "WSe2"), ("mote2", "MoTe2"), ("mos2", "MoS2"), ("ws2", "WS2"), ("graphene", "graphene"),
    ("silicene", "silicene"), ("germanene", "germanene"), ("hbn", "hBN"), ("bn_", "hBN"), ("boron_nitride", "hBN"),
    ("black_phosphorus", "black_phosphorus"), ("fe3gete2", "Fe3GeTe2"), ("fe5gete2", "Fe5GeTe2"), ("bi2se3", "Bi2Se3"), ("bi2te3", "Bi2Te3"),
    ("sb2te3", "Sb2Te3"), ("cr2ge2te2", "Cr2Ge2Te2"), ("cri3", "CrI3"), ("crse2", "CrSe2"), ("cu(111)", "Cu"), ("cu(001)", "Cu"),
    ("ni_doped", "Ni-doped"), ("lithium", "Li-intercalated"), ("li_intercalat", "Li-intercalated"),
]

#: Words of a confidence level and its value, first match first; without any, the default.
CONFIDENCE_WORDS = [
    (["experimentally", "proven"], 0.95),
    (["high", "strong"], 0.85),
    (["moderate", "medium"], 0.7),
    (["low", "weak"], 0.5),
    (["theoretical", "predicted"], 0.6),
]
DEFAULT_CONFIDENCE = 0.7

#: Edge types, and those that a validator accepts.
EDGE_TYPES = ["Processing_to_Structure", "Structure_to_Property", "Processing_to_Property", "Structure_to_Structure", "Processing_to_Processing"]
VALID_EDGE_TYPES = EDGE_TYPES[:4]

#: Pressure units in pascal, exact spelling first.
PRESSURE_UNITS = {
    "Pa": 1.0, "pascal": 1.0, "kPa": 1e3, "kpa": 1e3, "MPa": 1e6, "mpa": 1e6, "GPa": 1e9, "gpa": 1e9, "atm": 101325.0, "bar": 1e5, "mbar": 1e2,
    "torr": 133.322, "mmHg": 133.322, "psi": 6894.76,
}
#: Time units in seconds.
TIME_UNITS = {
    "s": 1.0, "sec": 1.0, "second": 1.0, "seconds": 1.0, "min": 60.0, "minute": 60.0, "minutes": 60.0, "h": 3600.0, "hr": 3600.0, "hour": 3600.0,
    "hours": 3600.0, "ms": 0.001, "millisecond": 0.001, "milliseconds": 0.001, "us": 1e-6, "microsecond": 1e-6, "microseconds": 1e-6,
}

#: Temperatures (in degrees Celsius) at which a material can be made.
MATERIAL_RANGES = {
    "MoS2": (300, 1200), "WS2": (300, 1100), "WSe2": (200, 950), "MoSe2": (250, 1000), "MoTe2": (200, 900), "WTe2": (200, 850),
    "graphene": (300, 1500), "hBN": (400, 1500), "black_phosphorus": (0, 400), "BP": (0, 400),
}
#: Highest temperature of a substrate.
SUBSTRATE_LIMITS = {"SiO2": 1200, "sapphire": 1800, "Si": 1414, "SiC": 2700, "glass": 600, "quartz": 1200, "Al2O3": 1800, "mica": 600}
#: Dopants known to work, or not to work, in an atmosphere.
ATMOSPHERE_DOPANTS = {
    "H2/Ar": {"Nb": True, "Re": True, "Fe": True, "Co": True, "Mn": True, "Cr": True, "V": True, "W": True, "Ta": True},
    "Ar": {"Nb": True, "Re": True, "Fe": True, "Co": True},
    "H2": {"Nb": True, "Re": True, "Fe": True},
    "N2": {"N": True, "Nb": False, "Re": False},
    "vacuum": {"Nb": True, "Re": True, "Fe": True},
    "forming_gas": {"Nb": True, "Re": True, "Fe": True, "Co": True},
}
#: Substrates on which a precursor works.
PRECURSOR_SUBSTRATES = {
    "MoO3": ["SiO2", "sapphire", "SiC", "quartz"], "WO3": ["SiO2", "sapphire", "SiC"], "MoCl5": ["SiO2", "sapphire"], "WCl6": ["SiO2", "sapphire"],
    "S": ["SiO2", "sapphire", "SiC", "quartz", "mica"], "Se": ["SiO2", "sapphire", "SiC", "quartz"], "Te": ["SiO2", "sapphire"],
}

#: Questions of the coverage report: (type, start keywords, end keywords).
COVERAGE_QUESTIONS = [
    ("forward", ["temperature", "CVD"], ["mobility", "conductivity"]),
    ("forward", ["pressure", "doping"], ["carrier", "concentration"]),
    ("forward", ["annealing", "oxygen"], ["defect", "property"]),
    ("inverse", ["n-type", "high mobility"], ["temperature", "method"]),
    ("inverse", ["p-type", "doping"], ["dopant", "concentration"]),
]

#: Weights of the composite scores.
PATH_WEIGHTS = {"confidence": 0.35, "richness": 0.30, "coverage": 0.35}
COHERENCE_WEIGHTS = {"intervention_consistency": 0.35, "counterfactual_reasoning": 0.25, "mechanistic_modularity": 0.25, "psp_chain_validity": 0.15}
GROUNDING_WEIGHTS = {"kg_verification": 0.35, "literature_entailment": 0.35, "multihop_grounding": 0.20, "source_diversity": 0.10}
VALIDITY_WEIGHTS = {"sufficiency": 0.30, "comprehensiveness": 0.20, "logical_consistency": 0.25, "mechanistic_precision": 0.15, "forward_simulation": 0.10}

#: Words of the answer metrics.
CAUSAL_MARKERS = ["leads to", "causes", "results in", "enables", "produces"]
PROPERTY_WORDS = ["property", "conductivity", "carrier", "mobility"]
NEGATIONS = ["not", "however", "but", "although", "despite", "contrary"]
UNIT_MARKS = ["cm", "ev", "k", "mol", "pa", "s"]
MECHANISM_TERMS = ["substitution", "doping", "defect", "phonon", "electron", "diffusion", "segregation", "precipitation"]
TESTABLE_WORDS = ["concentration", "temperature", "size", "thickness", "density", "composition", "phase", "crystal"]
CAUSAL_VERBS = ["causes", "leads to", "results in", "enables", "produces", "induces"]

#: Largest score of each metric of the rubric.
RUBRIC = {"processing_feasibility": 40, "structure_emergence": 30, "property_consistency": 20, "causal_psp_reasoning": 10}

#: Words that the mode without tiers looks for.
NAIVE_PROPERTIES = ["mobility", "conductivity", "carrier", "band gap", "property"]
NAIVE_CONDITIONS = ["temperature", "pressure", "time", "atmosphere", "method", "CVD", "MBE"]

#: Literature queries: before and after a path's text, and before and after a question's terms, by direction.
PATH_QUERIES = [("experimental validation ", ""), ("mechanism ", " materials science")]
TERM_QUERIES = {
    "forward": [("quantitative data ", " experimental"), ("recent advances ", "")],
    "inverse": [("synthesis methods ", ""), ("achieving ", " materials")],
}

#: Patterns by which a node's name tells its layer where its edges do not.
LAYER_PATTERNS = [
    (r"\btemp\b|\bheat\b|\bcvd\b|\bsynth|\bgrowth|\bdeposit|\bsputter|\bann(eal)", "Processing"),
    (r"\bhardness|\bstiff|\bmodul|\bconduct|\bfrict|\bwear|\byoung|\bstrain|\bstress|\bcof\b|\bthick", "Property"),
]
