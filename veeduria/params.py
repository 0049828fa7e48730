"""Parameters of the flag registry.

Defaults are the published rule values; a binding to other data passes its
own calibrated copy (see ``veeduria.plans.catalog``).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# They must equal the published rules for equal results.
# ILIKE patterns, thresholds (pesos), severities, flag names and descriptions.
# ---------------------------------------------------------------------------
NON_COMPETITIVE_PATTERNS = ("%directa%", "%régimen especial%", "%regimen especial%")
NATURAL_PERSON_PATTERNS = ("%cédula%", "%cedula%")
SERVICE_PATTERNS = ("%prestaci%servicios%",)
VAGUE_PATTERNS = ("%apoyo a la gestión%", "%apoyo a la gestion%",
                  "%fortalecimiento institucional%", "%actividades de apoyo%")

FLAG_NAMES = {
    "F01": "Posible fraccionamiento",
    "F02": "Salto anómalo de facturación",
    "F03": "Pico anómalo de contratación",
    "F04": "Entidad capturada (alta concentración)",
    "F06": "Contratista pulpo (persona natural)",
    "F08": "Contratación sin competencia dominante",
    "F09": "Objeto difuso de alto valor",
    "F10": "Adición de tiempo excesiva",
}
FLAG_LEVELS = {
    "F01": "contratista", "F02": "contratista", "F03": "entidad", "F04": "entidad",
    "F06": "contratista", "F08": "entidad", "F09": "contrato", "F10": "contrato",
}
FLAG_SEVERITY = {"F01": 25, "F02": 20, "F03": 20, "F04": 20,
                 "F06": 15, "F08": 15, "F09": 10, "F10": 10}
FLAG_DESCRIPTIONS = {
    "F01": "Muchos contratos sin competencia entre la misma entidad y el mismo proveedor en un año. "
           "Patrón clásico para evadir umbrales de licitación.",
    "F02": "Proveedor cuya facturación anual con el Estado crece más de 10x frente al año anterior.",
    "F03": "Mes en que una entidad firma contratos muy por encima de su propia media histórica. "
           "Patrón pre-Ley de Garantías y afán de diciembre.",
    "F04": "Entidad cuya contratación se concentra en muy pocos proveedores (índice HHI mayor a 0.5).",
    "F06": "Persona natural con contratos de prestación de servicios simultáneos en tres o más entidades.",
    "F08": "Entidad que adjudica más del 80% de su valor por modalidades sin competencia.",
    "F09": "Contrato de más de $1.000M con objeto genérico tipo 'apoyo a la gestión'.",
    "F10": "Contrato con 180 o más días adicionados sobre el plazo original.",
}
SCORE_CAP = 100
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Params:
    """Thresholds of every flag plus the text patterns of the predicates."""

    non_competitive: tuple[str, ...] = NON_COMPETITIVE_PATTERNS
    natural_person: tuple[str, ...] = NATURAL_PERSON_PATTERNS
    service: tuple[str, ...] = SERVICE_PATTERNS
    vague: tuple[str, ...] = VAGUE_PATTERNS
    # F01 possible splitting
    f01_min_contracts: int = 5
    f01_min_value: int = 500_000_000
    # optional guard (off by default): skip groups where one contract carries
    # more than this share of the value (one huge contract plus small ones)
    f01_max_single_share: float | None = None
    # F02 billing jump vs previous calendar year
    f02_factor: int = 10
    f02_min_value: int = 500_000_000
    # option: compare with the mean of all earlier years ("history") instead
    # of the previous calendar year (published)
    f02_history_mean: bool = False
    # F03 monthly spike
    f03_min_months: int = 4
    f03_min_contracts: int = 20
    f03_min_z: float = 3.0
    # option: months without contracts inside a buyer's span count as zero
    f03_fill_gaps: bool = False
    # option: only spikes in these calendar months count (e.g. the month
    # before an electoral restriction); None = any month, as published
    f03_months: tuple[int, ...] | None = None
    # F04 HHI concentration
    f04_min_hhi: float = 0.5
    f04_min_contracts: int = 10
    f04_min_value: int = 1_000_000_000
    # F06 octopus natural person
    f06_min_entities: int = 3
    f06_min_contracts: int = 4
    # F08 non-competitive dominance
    f08_min_contracts: int = 50
    f08_min_value: int = 2_000_000_000
    f08_min_share: float = 0.8
    # F09 vague object, high value
    f09_min_value: int = 1_000_000_000
    # F10 excessive extension
    f10_min_days: int = 180
    f10_min_value: int = 200_000_000
    # text length cut of F09's detail (the object text itself is whole)
    detail_object_chars: int = 120
    extra: dict = field(default_factory=dict)

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)
