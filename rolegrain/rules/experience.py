"""Experience rules: year mentions and the words around them."""

# Mention kinds, the most specific one first.
MENTION_KINDS = [
    ("range", r"\b(\d+)\s*(?:-|–|—|to)\s*(\d+)\s*\+?\s*(?:years?|yrs?)\b"),
    ("plus", r"\b(\d+)\s*\+\s*(?:years?|yrs?)\b"),
    ("at_least", r"\bat\s+least\s+(\d+)\s*(?:years?|yrs?)\b"),
    ("minimum", r"\bminimum(?:\s+of)?\s+(\d+)\s*(?:years?|yrs?)\b"),
    ("single", r"\b(\d+)\s*(?:years?|yrs?)\b"),
]

# Words that must, or must not, stand around a mention.
# Every longer "... experience" term of the original list contains the first one.
EXPERIENCE_TERM = "experience"
PREFERRED_WORDS = [
    "preferred",
    "nice to have",
    "nice-to-have",
    "bonus",
    "ideally",
    "a plus",
    "plus if",
]
DEGREE_TERMS = [
    "year degree",
    "year bachelor's",
    "year bachelor",
    "year master's",
    "year master",
    "year university",
    "year college",
    "foreign degree",
]

# Window sizes in characters, year limits.
CONTEXT_RADIUS = 140
DEGREE_LOOKBACK = 25
DEGREE_LOOKAHEAD = 50
REVIEW_YEARS = 4
REJECT_YEARS = 5
