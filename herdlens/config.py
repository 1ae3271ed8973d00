"""Settings of the engine.

One frozen ``Config`` is passed to every operator, so thresholds, windows and
weights are never buried in a plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values -----------------------------------------------------------
# Vocabulary, thresholds, weights and caps that results depend on.

SPECIES = ("cattle", "buffalo", "goat", "sheep", "poultry")

SYMPTOM_WEIGHTS = {
    "fever": 1,
    "coughing": 1,
    "nasal_discharge": 1,
    "weakness": 1,
    "diarrhea": 2,
    "loss_of_appetite": 2,
    "reduced_milk_production": 2,
    "skin_lesions": 3,
    "swelling": 3,
    "respiratory_distress": 4,
    "neurological_symptoms": 5,
    "sudden_death": 5,
}

RISK_LEVELS = ("LOW", "MEDIUM", "HIGH")

SCORE_WEIGHTS = {
    "volume": 0.25,
    "growth": 0.20,
    "mortality": 0.20,
    "high_concern": 0.20,
    "historical": 0.15,
}

# Value of each component at which its sub-score reaches 100.
SCORE_CAPS = {
    "volume": 20.0,
    "growth": 3.0,
    "mortality": 0.5,
    "high_concern": 1.0,
    "historical": 10.0,
}

# Lower bound of each category on the 0-100 score, highest first.
CATEGORY_FLOORS = (("CRITICAL", 80.0), ("HIGH", 60.0), ("MEDIUM", 30.0), ("LOW", None))

# Sub-score from which a component is named as a reason.
REASON_FLOORS = {
    "mortality": 40.0,
    "growth": 30.0,
    "volume": 40.0,
    "high_concern": 30.0,
    "historical": 30.0,
}

# Weak label: component weights, scale of each component, class cut points.
LABEL_WEIGHTS = {"mortality": 0.35, "severity": 0.25, "affected": 0.20, "critical": 0.20}
LABEL_MORTALITY_SCALE = 0.5
LABEL_AFFECTED_SCALE = 20.0
LABEL_CUTS = (0.28, 0.48)
LABEL_NOISE_SD = 0.06

EARTH_RADIUS_KM = 6371.0088
# ----------------------------------------------------------------------------


def symptom_column(symptom: str) -> str:
    return f"symptom_{symptom}"


SYMPTOM_COLUMNS = tuple(symptom_column(s) for s in SYMPTOM_WEIGHTS)
CRITICAL_SYMPTOMS = ("neurological_symptoms", "sudden_death")

NUMERIC_FEATURES = (
    "number_affected", "number_deaths", "mortality_rate", "duration_days",
    "temperature", "symptom_count", "symptom_severity",
    "recent_reports", "historical_incidence", "spread_velocity",
)
FEATURE_COLUMNS = NUMERIC_FEATURES + SYMPTOM_COLUMNS + ("species",)
SEVERITY_COLUMNS = ("mortality_rate", "symptom_severity", "number_affected")


@dataclass(frozen=True)
class Config:
    species: tuple = SPECIES
    symptom_weights: dict = field(default_factory=lambda: dict(SYMPTOM_WEIGHTS))
    risk_levels: tuple = RISK_LEVELS

    # Safety rules.
    rule_min_deaths: int = 3
    rule_min_affected_for_deaths: int = 5
    rule_mortality_rate: float = 0.30
    rule_respiratory_min_affected: int = 3
    rapid_window_days: int = 3
    rapid_min_reports: int = 3

    # Rolling windows of the rollup and of the village context.
    short_days: int = 7
    long_days: int = 30
    score_weights: dict = field(default_factory=lambda: dict(SCORE_WEIGHTS))
    score_caps: dict = field(default_factory=lambda: dict(SCORE_CAPS))

    # Outbreak detection.
    eps_km: float = 2.0
    eps_days: float = 2
    min_samples: int = 6
    severity_groups: int = 3
    dof: float = 4.0
    outbreak_deaths: int = 18
    epidemic_days: int = 7
    epidemic_places: int = 2

    # Expectation-maximisation.
    em_iterations: int = 100
    em_tolerance: float = 1e-4
    em_regularisation: float = 1e-3
    kmeans_restarts: int = 10
    kmeans_iterations: int = 300

    # Classifier.
    seed: int = 42
    trees: int = 300
    depth: int = 12
    min_leaf: int = 2
    train_share: float = 0.8

    # Lists of the dashboard.
    top_regions: int = 5
    recent_rows: int = 200
    histogram_bins: int = 20

    def __post_init__(self):
        if abs(sum(self.score_weights.values()) - 1.0) > 1e-9:
            raise ValueError("score weights must sum to 1")


DEFAULT = Config()
