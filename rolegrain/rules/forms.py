"""Form-field rules: grouping priorities, field phrases, answer keys."""

# Control types.
SKIPPED_TYPES = ["hidden", "submit", "button", "reset", "image"]
TYPE_PRIORITY = {
    "file": 100, "textarea": 95, "select": 90, "radio": 85, "checkbox": 85, "tel": 80,
    "email": 75, "url": 70, "text": 60, "search": 50,
}
GROUPING_TECHNICAL = ["recaptcha", "captcha", "cf-turnstile", "turnstile-response"]
CLASSIFIER_TECHNICAL = [
    "g-recaptcha-response", "recaptcha", "hcaptcha", "h-captcha", "cf-turnstile", "turnstile-response",
]
GENERIC_LABELS = ["attach", "upload", "select", "choose", "yes", "no", "search", "input", "field"]

# File purposes.
RESUME_GROUP_WORDS = ["resume", "curriculum vitae", "resume cv"]
RESUME_WORDS = ["resume", "résumé", "curriculum vitae", "resume/cv", "cv/resume"]
COVER_LETTER = "cover letter"

# Work-authorization and sponsorship wordings.
AUTHORIZATION = [
    "authorized to work", "authorised to work", "legal authorization", "legally authorized",
    "legally authorised", "work authorization", "work authorisation", "eligible to work legally",
    "legally eligible to work", "eligible to work in the united states",
    "eligible to work in the u.s.", "eligible to work in the us",
]
SPONSORSHIP = ["sponsor", "sponsorship", "visa support", "immigration support"]
FUTURE = [
    "in the future", "in future", "future require", "at any time", "eventually", "later require",
    "continue working",
]
CURRENT = [
    "currently", "right now", "at this time", "to begin", "to start", "to commence", "at the start",
    "upon hire", "initially",
]
NOW_OR_FUTURE = [
    "now or in the future", "now or future", "now or at any time in the future",
    "currently or in the future", "currently or at any time", "now and in the future",
    "now and future",
]
WITHOUT_SPONSORSHIP = [
    "without sponsorship", "without employer sponsorship", "without visa sponsorship",
    "without requiring sponsorship",
]
FIXED_ANSWERS = {
    "WORK_AUTHORIZED_US": "Yes",
    "SPONSORSHIP_NOW": "No",
    "SPONSORSHIP_FUTURE": "Yes",
    "SPONSORSHIP_NOW_OR_FUTURE": "Yes",
    "WORK_AUTH_WITHOUT_SPONSORSHIP_NOW": "Yes",
    "WORK_AUTH_WITHOUT_SPONSORSHIP_FUTURE": "No",
}

# Sensitive questions, asked before the profile fields.
# (category, phrases, whole words, reason)
SENSITIVE_QUESTIONS = [
    ("SECURITY_CLEARANCE",
     ["security clearance", "secret clearance", "ts/sci", "top secret", "clearance level"], [],
     "Security-clearance facts require explicit confirmation."),
    ("CITIZENSHIP_OR_EXPORT_CONTROL",
     ["u.s. citizen", "us citizen", "united states citizen", "citizenship", "export control",
      "export-controlled"], ["itar"],
     "Citizenship/export-control questions must not be inferred."),
    ("EMPLOYMENT_RESTRICTION",
     ["non-compete", "noncompete", "non-solicitation", "nonsolicitation", "former employer",
      "third party agreement", "third-party agreement"], [],
     "Employment-agreement restrictions require an explicit user-confirmed answer."),
    ("VOLUNTARY_DEMOGRAPHIC",
     ["race", "ethnicity", "gender", "sex", "veteran", "disability", "sexual orientation",
      "transgender", "pronouns", "self-identify", "self identify", "i identify as", "demographic",
      "hispanic", "latino", "latina", "latinx", "lgbtq", "lgbtq+", "lgbt", "queer",
      "military status"], [],
     "Demographic/EEO answers must never be inferred."),
]

# Profile fields by the field's own wording.
# (category, answer key, phrases, whole words, excluded phrases, exact labels, control type, reason)
STANDARD = "Standard applicant profile field."
PROFESSIONAL = "Standard professional-profile field."
PROFILE_FIELDS = [
    ("PREFERRED_FIRST_NAME", "PREFERRED_FIRST_NAME", ["preferred first name", "preferred name"], [], [], [], None,
     "Separate preferred-name profile field; it should not silently reuse legal first name."),
    ("FIRST_NAME", "FIRST_NAME", ["first name", "given name"], [], [], [], None, STANDARD),
    ("LAST_NAME", "LAST_NAME", ["last name", "surname", "family name"], [], [], [], None, STANDARD),
    ("FULL_NAME", "FULL_NAME", ["full name"], [], [], ["name"], None, STANDARD),
    ("EMAIL", "EMAIL", ["email", "e-mail"], [], [], [], "email", STANDARD),
    ("PHONE", "PHONE", ["phone", "mobile", "telephone"], [], [], [], "tel", STANDARD),
    ("LINKEDIN", "LINKEDIN_URL", ["linkedin"], [], [], [], None, PROFESSIONAL),
    ("GITHUB", "GITHUB_URL", ["github"], [], [], [], None, PROFESSIONAL),
    ("PORTFOLIO", "PORTFOLIO_URL", ["portfolio", "personal website", "website url", "website"], [], [], [], None,
     PROFESSIONAL),
    ("EDUCATION_SCHOOL", "EDUCATION_SCHOOL", [], [], [], ["school", "school*"], None, "Structured education field."),
    ("EDUCATION_DEGREE", "EDUCATION_DEGREE", [], [], [], ["degree", "degree*"], None, "Structured education field."),
    ("EDUCATION_DISCIPLINE", "EDUCATION_DISCIPLINE", [], [], [],
     ["discipline", "discipline*", "field of study", "field of study*"], None, "Structured education field."),
    ("OFFICE_PREFERENCE", None, ["preferred office location", "preferred office"], [], [], [], None,
     "Preferred office is a job-specific preference and must not reuse the applicant's current address."),
    ("CURRENT_US_LOCATION", "CURRENT_US_LOCATION",
     ["currently located in the us", "currently located in the u.s.", "currently based in the us",
      "currently based in the u.s."], [], [], [], None,
     "Current-country/location fact should come from explicit applicant profile configuration."),
    ("STREET_ADDRESS", "STREET_ADDRESS", ["street address", "address line 1", "address line1", "address 1"],
     [], [], [], None, "Structured street-address profile field."),
    ("POSTAL_CODE", "POSTAL_CODE", ["postal code", "zip code", "zipcode"], [], [], [], None,
     "Structured postal-code profile field."),
    ("COUNTRY", "COUNTRY", [], ["country"], ["country code", "country calling code"], [], None,
     "Structured country profile field."),
    ("CITY", "CITY", ["location (city)", "current city", "city of residence"], ["city"], [], [], None,
     "Structured city profile field."),
    ("STATE_OR_PROVINCE", "STATE_OR_PROVINCE", [], ["state", "province"], [], [], None,
     "Structured state/province profile field."),
    ("LOCATION_FREEFORM", "LOCATION_FREEFORM", [], ["location"], [], [], None,
     "Generic location field; future filling must use an explicitly configured free-form location."),
]
CHOICE_TYPES = ["radio", "checkbox"]

# Other questions that need a human. (category, phrases, reason)
HUMAN_QUESTIONS = [
    ("COMPENSATION_EXPECTATION", ["salary", "compensation", "desired pay", "expected pay", "pay expectation"],
     "Compensation expectations are not safe to invent."),
    ("FREEFORM_APPLICATION_QUESTION",
     ["why do you want", "why are you interested", "why this company", "why this role", "tell us why",
      "cover letter", "additional information"],
     "Free-form answers are human-reviewed."),
    ("APPLICATION_SOURCE", ["how did you hear", "how did you find", "source of application"],
     "Application-source questions require a truthful per-application answer."),
    ("EXPERIENCE_SELF_REPORT",
     ["total years of experience", "years of experience you have", "relevant years of experience"],
     "Self-reported relevant experience can vary by role and should be resolved from explicit profile evidence."),
    ("REFERRAL_RELATIONSHIP",
     ["do you know anyone", "know anyone currently at", "employee referral", "referred by"],
     "Referral/relationship questions require a truthful per-company answer."),
    ("PRODUCT_USAGE",
     ["have you used robinhood", "have you used our product", "have you used our products"],
     "Product-usage questions require an explicit user-confirmed answer."),
    ("PRIOR_COMPANY_EMPLOYMENT",
     ["ever worked for robinhood", "previously worked for", "worked for us as an employee",
      "worked for us as an intern", "worked for us as a contractor"],
     "Prior-company-employment questions require an explicit truthful answer."),
    ("WORK_LOCATION_COMMITMENT",
     ["hybrid policy", "willing to work from the office", "able to work from the office", "office(s) listed"],
     "Hybrid/office attendance is a job-specific commitment and should be explicitly confirmed."),
    ("AGE_CONFIRMATION", ["18 years", "18 or older", "age of 18", "minimum age"],
     "Age-related facts require explicit confirmation."),
    ("RELOCATION", ["relocate", "relocation", "willing to move"],
     "Relocation preferences require explicit profile data."),
    ("ACKNOWLEDGEMENT",
     ["terms", "privacy policy", "privacy notice", "acknowledge", "certify", "attest", "consent"],
     "Legal acknowledgements/consent should not be accepted automatically."),
]
UNKNOWN_FIELD = (
    "UNKNOWN_CUSTOM_FIELD",
    "Field is not recognized with enough confidence to answer automatically.",
)

# Answer keys a profile can hold, work-authorization facts, keys that stay private.
PROFILE_KEYS = [
    "FIRST_NAME", "LAST_NAME", "PREFERRED_FIRST_NAME", "EMAIL", "PHONE", "LINKEDIN_URL",
    "PORTFOLIO_URL", "GITHUB_URL", "COUNTRY", "CITY", "STATE_OR_PROVINCE", "POSTAL_CODE",
    "STREET_ADDRESS", "LOCATION_FREEFORM", "CURRENT_US_LOCATION", "EDUCATION_SCHOOL",
    "EDUCATION_DEGREE", "EDUCATION_DISCIPLINE",
]
AUTHORIZATION_FACTS = ["AUTHORIZED_TO_WORK_US", "SPONSORSHIP_NOW", "SPONSORSHIP_FUTURE"]
POLICY_KEYS = [
    "WORK_AUTHORIZED_US", "SPONSORSHIP_NOW", "SPONSORSHIP_FUTURE", "SPONSORSHIP_NOW_OR_FUTURE",
    "WORK_AUTH_WITHOUT_SPONSORSHIP_NOW", "WORK_AUTH_WITHOUT_SPONSORSHIP_FUTURE",
]
DISPLAY_ANSWERS = ["Yes", "No", "True", "False"]
PREVIEW_HIDDEN = ["EMAIL", "PHONE", "STREET_ADDRESS", "POSTAL_CODE"]

# Field statuses.
READY = "READY"
BLOCKING = ["REQUIRED_ASSISTANCE", "MISSING_REQUIRED_PROFILE", "MISSING_RESUME", "POLICY_MISMATCH"]
OPTIONAL = ["OPTIONAL_ASSISTANCE", "OPTIONAL_MISSING"]

# Page title of an application form.
PAGE_TITLE = r"^\s*Job Application for\s+(.+?)\s+at\s+(.+?)\s*$"

# Handoff packet.
PACKET_VERSION = 1
PACKET_ROUTES = ["NEEDS_ASSISTANCE", "AGENT_CONTINUE"]
