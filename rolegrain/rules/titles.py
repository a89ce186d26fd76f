"""Title rules: target roles, seniority, employment type, candidate profile."""

# Title patterns of the roles that are looked for.
TARGET_ROLES = [
    r"\bsoftware engineer\b",
    r"\bsoftware development engineer\b",
    r"\bsoftware developer\b",
    r"\bbackend engineer\b",
    r"\bback-end engineer\b",
    r"\bfrontend engineer\b",
    r"\bfront-end engineer\b",
    r"\bfull stack engineer\b",
    r"\bfull-stack engineer\b",
    r"\bmachine learning engineer\b",
    r"\bml engineer\b",
    r"\bai engineer\b",
    r"\bartificial intelligence engineer\b",
    r"\bgenerative ai engineer\b",
    r"\bgenai engineer\b",
    r"\bsystems engineer\b",
    r"\bsystem engineer\b",
    r"\bproduction support engineer\b",
    r"\bapplication support engineer\b",
    r"\bdevops engineer\b",
    r"\bsite reliability engineer\b",
    r"\bsre\b",
]

# Seniority words that take a title out.
SENIORITY = [
    r"\bsenior\b",
    r"\bsr\.?\b",
    r"\bstaff\b",
    r"\bprincipal\b",
    r"\blead\b",
    r"\bmanager\b",
    r"\bdirector\b",
    r"\barchitect\b",
    r"\bvice president\b",
    r"\bvp\b",
    r"\bhead\b",
]

# Titles that are never full-time, checked first.
NON_FULL_TIME_TITLES = [
    r"\bintern\b",
    r"\binternship\b",
    r"\bco[\s-]?op\b",
    r"\bpart[\s-]?time\b",
    r"\bcontractor\b",
    r"\btemporary\b",
    r"\btemp\b",
    r"\bseasonal\b",
    r"\bfellowship\b",
    r"\bfellow\b",
    r"\bapprentice\b",
    r"\bapprenticeship\b",
]

# Contract employment, skipped for smart-contract titles.
CONTRACT_TITLES = [
    r"(?:-|–|—|\()\s*contract\s*\)?$",
    r"\(\s*contract\s*\)",
    r"^\s*contract\s+",
    r",\s*contract\s*$",
    r"\b\d+\s*(?:month|months|mo)\s+contract\b",
    r"\bcontract\s+(?:role|position|opportunity)\b",
    r"\bfixed[\s-]?term\b",
]
SMART_CONTRACT_TITLES = [r"\bsmart[\s-]?contract\b", r"\bsmart[\s-]?contracts\b"]

# Structured employment metadata.
EMPLOYMENT_FIELDS = [
    "employment type",
    "employment",
    "job type",
    "worker type",
    "position type",
    "time type",
]
FULL_TIME_VALUES = [
    "full time",
    "full-time",
    "fulltime",
    "regular",
    "regular full time",
    "regular full-time",
    "permanent",
]
NON_FULL_TIME_VALUES = [
    "intern",
    "internship",
    "co-op",
    "coop",
    "part time",
    "part-time",
    "parttime",
    "contract",
    "contractor",
    "temporary",
    "temp",
    "seasonal",
    "fellowship",
    "apprenticeship",
    "fixed term",
    "fixed-term",
]

# Employment decision texts.
EMPLOYMENT_REASONS = {
    "title": "Excluded employment type detected in title",
    "non_full_time": "Structured employment metadata indicates non-full-time role",
    "full_time": "Structured employment metadata indicates full-time role",
    "unknown": "No explicit non-full-time employment type detected",
}

# Profile packs in order of precedence; no hit means DEFAULT_PROFILE.
PROFILE_PACKS = [
    ("ai_ml_engineer", [
        r"\bmachine learning\b",
        r"\bml engineer\b",
        r"\bai engineer\b",
        r"\bartificial intelligence\b",
        r"\bgen\s*ai\b",
        r"\bgenai\b",
        r"\bgenerative\s+ai\b",
        r"\bgenerative\s+artificial intelligence\b",
        r"\bai enablement\b",
        r"\benterprise ai\b",
        r"\bai infrastructure\b",
        r"\bai platform\b",
        r"\bai systems\b",
        r"\bai tooling\b",
        r"\bml infrastructure\b",
        r"\bml platform\b",
        r"\bml systems\b",
        r"\bmlops\b",
        r"\bdeep learning\b",
        r"\bnlp\b",
        r"\bnatural language processing\b",
        r"\bcomputer vision\b",
        r"\bllm\b",
        r"\blarge language model",
    ]),
    ("fullstack_engineer", [r"\bfull[\s-]?stack\b", r"\bfullstack\b"]),
    ("frontend_engineer", [r"\bfront[\s-]?end\b", r"\bfrontend\b", r"\bui engineer\b", r"\bweb ui\b"]),
    ("backend_engineer", [r"\bback[\s-]?end\b", r"\bbackend\b", r"\bserver[\s-]?side\b"]),
    ("devops_engineer", [
        r"\bdevops\b",
        r"\bsite reliability\b",
        r"\bsre\b",
        r"\bplatform operations\b",
        r"\bcloud operations\b",
    ]),
    ("production_support_engineer", [
        r"\bproduction support\b",
        r"\bapplication support\b",
        r"\btechnical support engineer\b",
        r"\bsupport engineer\b",
        r"\bproduction engineer\b",
    ]),
    ("systems_engineer", [
        r"\bsystems engineer\b",
        r"\bsystem engineer\b",
        r"\bit systems\b",
        r"\binfrastructure systems engineer\b",
    ]),
]
DEFAULT_PROFILE = "software_engineer"
