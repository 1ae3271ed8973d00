"""Texts shown to users.

Fixed values: wordings and formats that must stay as they are for results to
match. ``%`` templates are filled by ``format_string`` inside the plan.
"""

# Validation messages, in the order in which they are reported.
ERR_AFFECTED = "Number of affected animals must be a positive integer."
ERR_DEATHS_NEGATIVE = "Number of deaths cannot be negative."
ERR_DEATHS_EXCEED = "Number of deaths cannot exceed the number of affected animals."
ERR_SPECIES = "Species must be one of: {species}."
ERR_PLACE = "District, block and village are all required."
ERR_DATE = "Report date is required."

# Safety rules.
RULE_MULTIPLE_DEATHS = (
    "%d deaths reported out of %d affected animals - "
    "meets the multiple-mortality emergency threshold."
)
RULE_MORTALITY = "Mortality rate of %s exceeded the configured emergency threshold of {limit}."
RULE_CRITICAL = (
    "Neurological symptoms or sudden death reported - treated as an "
    "automatic high-concern signal regardless of other factors."
)
RULE_RESPIRATORY = (
    "Respiratory distress reported across %d animals, at or "
    "above the {limit}-animal cluster threshold."
)
RULE_RAPID = (
    "{reports}+ reports from this village within {days} days - "
    "flagged as a rapidly spreading situation."
)

# Recommended action per final risk.
ACTIONS = {
    "LOW": "Log for routine monitoring. No immediate action required.",
    "MEDIUM": "Notify the local veterinary worker for a follow-up visit within a few days.",
    "HIGH": "Escalate for urgent veterinary assessment and consider sample collection.",
}

# Reasons behind a triage result.
WHY_MORTALITY = "Mortality rate for this report: %s (%d of %d animals)"
WHY_SYMPTOMS = "Symptoms reported: "
WHY_RECENT = "%d other report(s) from this village in the last {days} days"
WHY_HISTORY = "%d past HIGH-concern report(s) on record for this village"
WHY_MODEL = "ML model classified this report as %s (confidence %s) based on the factors above"
WHY_RULE = "Safety rule override triggered: "

# Reasons behind a region's score.
REGION_MORTALITY = "Elevated mortality rate (%s over the last 7 days)"
REGION_GROWTH = "Reports growing quickly (7-day growth ratio %sx)"
REGION_VOLUME = "High report volume (%d reports in 7 days)"
REGION_HIGH_CONCERN = "Large share of HIGH-concern reports (%s)"
REGION_HISTORY = "History of past outbreaks (%d prior HIGH reports)"
REGION_NONE = "No single factor dominates - risk is low across all components."

# Outbreak scale and severity names.
SCALE_EPIDEMIC = "Epidemic-scale (multi-village/district)"
SCALE_LOCAL = "Localized outbreak"
SEVERITY_NAMES = ("Mild", "Moderate", "Severe")

# Marker colour and badge per risk category.
COLORS = {"LOW": "#2e7d32", "MEDIUM": "#f9a825", "HIGH": "#ef6c00", "CRITICAL": "#c62828"}
BADGES = {
    "LOW": "\U0001F7E2",
    "MEDIUM": "\U0001F7E1",
    "HIGH": "\U0001F7E0",
    "CRITICAL": "\U0001F534",
}

MODEL_MISSING = "No trained model at {path}. Train one and save it there first."
