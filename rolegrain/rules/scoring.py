"""Scoring constants."""

# Weights, thresholds and limits of the scoring models.
FIT_WEIGHTS = {"required": 45.0, "preferred": 10.0, "semantic": 30.0, "experience": 15.0}
SELECTION_WEIGHTS = {"role": 55.0, "semantic": 25.0, "required": 20.0}
MANUAL_THRESHOLD = 85.0
MANUAL_CONFIDENCE = 75.0
APPLICANT_YEARS = 3
SEMANTIC_FLOOR = 25.0
SEMANTIC_SPAN = 35.0
TOP_CHUNKS = 5
NEUTRAL_SCORE = 50.0
DEFAULT_ROLE_SCORE = 50.0
CHUNK_WORDS = 120
CHUNK_OVERLAP = 25

# Score bands, highest first.
SCORE_BANDS = [(90, "VERY_STRONG"), (85, "STRONG"), (75, "MODERATE"), (60, "WEAK")]
LOWEST_BAND = "VERY_WEAK"

# Candidate profiles in ranking order.
PROFILES = [
    "software_engineer",
    "backend_engineer",
    "frontend_engineer",
    "fullstack_engineer",
    "ai_ml_engineer",
    "systems_engineer",
    "production_support_engineer",
    "devops_engineer",
]

# Role alignment, one row per posting profile, columns as in PROFILES.
ROLE_ALIGNMENT = {
    "software_engineer": [100, 88, 80, 88, 65, 75, 65, 70],
    "backend_engineer": [90, 100, 45, 80, 60, 80, 70, 75],
    "frontend_engineer": [85, 55, 100, 92, 50, 45, 40, 40],
    "fullstack_engineer": [92, 88, 88, 100, 60, 55, 45, 50],
    "ai_ml_engineer": [82, 75, 50, 65, 100, 60, 45, 55],
    "systems_engineer": [75, 78, 40, 55, 50, 100, 92, 90],
    "production_support_engineer": [68, 72, 40, 52, 45, 95, 100, 88],
    "devops_engineer": [68, 72, 40, 52, 48, 95, 88, 100],
}

# Explanation texts.
GATE_TEXTS = {
    "score": "fit below 85",
    "confidence": "confidence below 75%",
    "evidence": "no required-skill evidence",
}
WARNING_TEXTS = {
    "required": "No required skill units were extracted; the required component is excluded "
                "from job-fit scoring and confidence is reduced.",
    "preferred": "No preferred skill units were extracted; the preferred component is excluded "
                 "from job-fit scoring and confidence is reduced.",
    "experience": "No required experience minimum was extracted; the experience component is "
                  "excluded from job-fit scoring and confidence is reduced.",
    "coverage": "Required-skill coverage is below 60%.",
    "one_year_short": "Experience score is reduced because the minimum requirement is one year "
                      "above the configured applicant experience.",
    "experience_zero": "Experience component scored 0.",
    "held": "Fit score is above the manual threshold, but the evidence gates prevent Manual "
            "Priority routing.",
}
