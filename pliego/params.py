"""Thresholds, weights, tiers and reference tables. Everything that a plan compares with comes from here."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

# The red flags, their names, levels and weights.
FLAGS: dict[str, tuple[str, str, int]] = {
    "F01": ("Único oferente", "contract", 15),
    "F02": ("Empresa exprés", "contract", 15),
    "F03": ("Adiciones excesivas", "contract", 12),
    "F04": ("Abuso de contratación directa", "entity", 8),
    "F05": ("Fraccionamiento", "contract", 12),
    "F06": ("Carrusel", "contract", 12),
    "F07": ("Ventana de licitación corta", "contract", 8),
    "F08": ("Precio calcado", "contract", 6),
    "F09": ("Afán de diciembre", "contract", 8),
    "F10": ("Ventana electoral", "contract", 6),
    "F11": ("Proveedor sancionado", "contract", 20),
    "F12": ("Concentración/dependencia", "entity", 8),
    "F13": ("Objeto vago", "contract", 3),
    "F14": ("Valor redondo", "contract", 2),
}

# Tiers by their lower, inclusive border, lowest first.
TIERS: list[tuple[str, str, float]] = [("bajo", "Bajo", 0.0), ("medio", "Medio", 20.0), ("alto", "Alto", 40.0), ("critico", "Crítico", 60.0)]

# Raw spellings of contracting modalities -> normalised, competitive, open.
MODALITIES: list[tuple[str, str, bool, bool]] = [
    ("Licitación pública", "LICITACION_PUBLICA", True, True),
    ("Licitación Pública", "LICITACION_PUBLICA", True, True),
    ("Licitación pública Obra Publica", "LICITACION_PUBLICA", True, True),
    ("Licitación Pública Acuerdo Marco de Precios", "LICITACION_PUBLICA", True, True),
    ("Selección Abreviada de Menor Cuantía", "SELECCION_ABREVIADA", True, True),
    ("Selección abreviada subasta inversa", "SELECCION_ABREVIADA", True, True),
    ("Seleccion Abreviada Menor Cuantia Sin Manifestacion Interes", "SELECCION_ABREVIADA", True, True),
    ("Selección Abreviada de Menor Cuantía (Ley 1150 de 2007)", "SELECCION_ABREVIADA", True, True),
    ("Concurso de méritos abierto", "CONCURSO_MERITOS", True, True),
    ("Concurso de méritos con precalificación", "CONCURSO_MERITOS", True, True),
    ("Mínima cuantía", "MINIMA_CUANTIA", False, True),
    ("Contratación Mínima Cuantía", "MINIMA_CUANTIA", False, True),
    ("Contratación directa", "CONTRATACION_DIRECTA", False, False),
    ("Contratación Directa (con ofertas)", "CONTRATACION_DIRECTA", False, False),
    ("Contratación Directa (Ley 1150 de 2007)", "CONTRATACION_DIRECTA", False, False),
    ("Contratación régimen especial", "REGIMEN_ESPECIAL", False, False),
    ("Contratación régimen especial (con ofertas)", "REGIMEN_ESPECIAL", False, False),
    ("Enajenación de bienes con subasta", "OTRO", False, False),
    ("Enajenación de bienes con sobre cerrado", "OTRO", False, False),
    ("Solicitud de información a los Proveedores", "OTRO", False, False),
    ("Subasta", "OTRO", False, False),
    ("Subasta de prueba", "OTRO", False, False),
]

# The monthly minimum wage of each year, in pesos.
MINIMUM_WAGE: dict[int, int] = {
    2011: 535600, 2012: 566700, 2013: 589500, 2014: 616000, 2015: 644350, 2016: 689455, 2017: 737717, 2018: 781242,
    2019: 828116, 2020: 877803, 2021: 908526, 2022: 1000000, 2023: 1160000, 2024: 1300000, 2025: 1423500, 2026: 1750905,
}

# Windows before elections in which direct contracts are restricted, both ends inclusive.
ELECTION_WINDOWS: list[tuple[str, str, str, str]] = [
    ("VE2018P1", "presidencial", "2017-12-11", "2018-05-27"),
    ("VE2018P2", "presidencial", "2018-05-28", "2018-06-17"),
    ("VE2019T", "territorial", "2019-06-27", "2019-10-27"),
    ("VE2022P1", "presidencial", "2022-01-29", "2022-05-29"),
    ("VE2022P2", "presidencial", "2022-05-30", "2022-06-19"),
    ("VE2023T", "territorial", "2023-06-29", "2023-10-29"),
    ("VE2026P1", "presidencial", "2026-01-25", "2026-05-25"),
    ("VE2026P2", "presidencial", "2026-05-26", "2026-06-14"),
]

# Other spellings of department names, without accents -> the official one.
DEPARTMENT_ALIASES: dict[str, str] = {
    "DISTRITO CAPITAL DE BOGOTA": "BOGOTA, D.C.",
    "BOGOTA D.C.": "BOGOTA, D.C.",
    "BOGOTA DC": "BOGOTA, D.C.",
    "BOGOTA": "BOGOTA, D.C.",
    "D.C.": "BOGOTA, D.C.",
    "SAN ANDRES": "ARCHIPIELAGO DE SAN ANDRES, PROVIDENCIA Y SANTA CATALINA",
    "SAN ANDRES, PROVIDENCIA Y SANTA CATALINA": "ARCHIPIELAGO DE SAN ANDRES, PROVIDENCIA Y SANTA CATALINA",
}


@dataclass(frozen=True)
class Params:
    """Thresholds of the flags and constants of the scores."""

    bidders: int = 1
    express_days: int = 90
    added_days_ratio: float = 0.5
    added_money_ratio: float = 0.4
    direct_z: float = 2.0
    direct_min_contracts: int = 5
    direct_min_peers: int = 5
    split_days: int = 90
    split_min_contracts: int = 3
    split_wages: float = 280.0
    rotation_days: int = 730
    rotation_min_contracts: int = 8
    rotation_winners: tuple[int, int] = (2, 4)
    rotation_min_share: float = 0.15
    rotation_min_alternation: float = 0.6
    floor_days: dict[str, int] = field(default_factory=lambda: {"LICITACION_PUBLICA": 10, "SELECCION_ABREVIADA": 5})
    price_tolerance: float = 0.005
    rush_month: int = 12
    rush_day: int = 15
    direct: str = "CONTRATACION_DIRECTA"
    entity_share: float = 0.5
    supplier_share: float = 0.8
    concentration_min_contracts: int = 5
    vague_length: int = 40
    vague_percentile: float = 0.9
    round_min: float = 1e9
    round_unit: int = 100_000_000
    shrink_k: float = 10.0
    min_contracts: int = 10
    weights: dict[str, tuple[str, str, int]] = field(default_factory=lambda: dict(FLAGS))
    tiers: list[tuple[str, str, float]] = field(default_factory=lambda: list(TIERS))

    def total_weight(self, level: str | None = None) -> int:
        return sum(w for _, of, w in self.weights.values() if level in (None, of))


def load_params(path: str) -> Params:
    """Params from a JSON file, or a YAML one where that library is installed.

    The file has keys as fields above; flags: {F01: {nombre, nivel, peso}, ...} and tiers: [{id, nombre, min_score}, ...] are
    accepted for weights and tiers.
    """
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            raw: dict[str, Any] = yaml.safe_load(f)
        else:
            import json

            raw = json.load(f)
    if "flags" in raw:
        raw["weights"] = {k: (v["nombre"], v["nivel"], v["peso"]) for k, v in raw.pop("flags").items()}
    if "tiers" in raw:
        raw["tiers"] = [(t["id"], t["nombre"], float(t["min_score"])) for t in raw["tiers"]]
    shrinkage = raw.pop("shrinkage", {})
    raw |= {new: shrinkage[old] for old, new in (("k", "shrink_k"), ("min_contratos_rank", "min_contracts")) if old in shrinkage}
    return Params(**raw)
