"""Eligibility rules: five categories of requirements that need a human."""

# Phrases that clear a whole category.
CLEARANCE_EXCEPTIONS = [
    r"\bno\s+(?:security\s+)?clearance\s+(?:is\s+)?required\b",
    r"\bsecurity\s+clearance\s+not\s+required\b",
    r"\bdoes\s+not\s+require\s+(?:a\s+)?security\s+clearance\b",
]
CITIZENSHIP_EXCEPTIONS = [
    r"\bcitizenship\s+(?:is\s+)?not\s+required\b",
    r"\bregardless\s+of\s+citizenship\b",
    r"\bdo\s+not\s+require\s+u\.?s\.?\s+citizenship\b",
]

# Category patterns; the first pattern that hits gives the evidence.
CLEARANCE = [
    r"\bactive\s+(?:secret|top\s+secret|ts\/sci|security)\s+clearance\b",
    r"\bcurrent\s+(?:secret|top\s+secret|ts\/sci|security)\s+clearance\b",
    r"\b(?:secret|top\s+secret|ts\/sci)\s+clearance\s+(?:is\s+)?required\b",
    r"\bsecurity\s+clearance\s+(?:is\s+)?required\b",
    r"\bmust\s+(?:have|hold|possess|maintain)\b.{0,80}\bclearance\b",
    r"\brequires?\b.{0,80}\b(?:secret|top\s+secret|ts\/sci|security)\s+clearance\b",
    r"\beligible\s+to\s+(?:obtain|receive)\b.{0,80}\bclearance\b",
    r"\bability\s+to\s+obtain\b.{0,80}\bclearance\b",
]
CITIZENSHIP = [
    r"\bu\.?s\.?\s+citizenship\s+(?:is\s+)?required\b",
    r"\bus\s+citizenship\s+(?:is\s+)?required\b",
    r"\bmust\s+be\s+(?:a\s+)?u\.?s\.?\s+citizen\b",
    r"\bmust\s+be\s+(?:a\s+)?us\s+citizen\b",
    r"\bonly\s+u\.?s\.?\s+citizens\b",
    r"\bu\.?s\.?\s+citizens\s+only\b",
    r"\bcandidates?\s+must\s+(?:be|hold)\b.{0,50}\bcitizenship\b",
]
EXPORT_CONTROL = [
    r"\bitar\b",
    r"\binternational\s+traffic\s+in\s+arms\s+regulations\b",
    r"\bexport\s+control(?:led)?\b",
    r"\bexport\s+compliance\b",
    r"\bu\.?s\.?\s+person\s+(?:status\s+)?required\b",
    r"\bmust\s+qualify\s+as\s+(?:a\s+)?u\.?s\.?\s+person\b",
    r"\bear\s+regulated\b",
]
SPONSORSHIP = [
    r"\bno\s+(?:visa\s+)?sponsorship\b",
    r"\bvisa\s+sponsorship\s+(?:is\s+)?not\s+available\b",
    r"\bsponsorship\s+(?:is\s+)?not\s+available\b",
    r"\bwe\s+(?:do|will)\s+not\s+sponsor\b",
    r"\bwe\s+(?:do|will)\s+not\s+provide\b.{0,40}\bsponsorship\b",
    r"\bcannot\s+sponsor\b",
    r"\bcan't\s+sponsor\b",
    r"\bcannot\s+provide\b.{0,40}\bsponsorship\b",
    r"\bunable\s+to\s+sponsor\b",
    r"\bunable\s+to\s+provide\b.{0,40}\bsponsorship\b",
    r"\bunable\s+to\s+provide\s+(?:visa\s+)?sponsorship\b",
    r"\bnot\s+able\s+to\s+sponsor\b",
    r"\bnot\s+able\s+to\s+provide\b.{0,40}\bsponsorship\b",
    r"\bwill\s+not\s+provide\s+(?:visa\s+)?sponsorship\b",
    r"\bwithout\s+(?:current\s+or\s+future\s+)?sponsorship\b",
    r"\bwithout\s+requiring\s+sponsorship\b",
    r"\bmust\s+not\s+require\s+sponsorship\b",
    r"\bdo\s+not\s+require\s+sponsorship\s+now\s+or\s+in\s+the\s+future\b",
    r"\bmust\s+be\s+authorized\b.{0,80}\bwithout\s+sponsorship\b",
    r"\bwill\s+not\s+sponsor\b.{0,80}\b(?:now|future|future employment)\b",
    r"\bno\s+sponsorship\b.{0,80}\b(?:now|future)\b",
]
LICENSE = [
    r"\b(?:must|required\s+to)\s+(?:have|hold|possess|maintain)\b.{0,80}\b(?:license|licence|certification)\b",
    r"\b(?:active|current|valid)\b.{0,40}\b(?:license|licence|certification)\s+(?:is\s+)?required\b",
    r"\b(?:license|licence|certification)\s+(?:is\s+)?required\b",
    r"\brequired\s+certification\b",
]

# Fixed values: (category, reason, patterns, exceptions) in evaluation order.
CATEGORIES = [
    (
        "SECURITY_CLEARANCE",
        "Job contains a security-clearance requirement that must be reviewed.",
        CLEARANCE,
        CLEARANCE_EXCEPTIONS,
    ),
    (
        "CITIZENSHIP",
        "Job contains a citizenship requirement that must be reviewed.",
        CITIZENSHIP,
        CITIZENSHIP_EXCEPTIONS,
    ),
    (
        "EXPORT_CONTROL",
        "Job contains an export-control or U.S.-person requirement that must be reviewed.",
        EXPORT_CONTROL,
        [],
    ),
    (
        "SPONSORSHIP",
        "Job contains a sponsorship restriction that must be reviewed.",
        SPONSORSHIP,
        [],
    ),
    (
        "LICENSE_OR_CERTIFICATION",
        "Job appears to require a license or certification that must be verified.",
        LICENSE,
        [],
    ),
]
EVIDENCE_RADIUS = 120
REVIEW_PREFIX = "Eligibility review required: "
