"""Location rules: which location strings are in the United States."""

# Location vocabulary.
UNKNOWN_VALUES = ["", "n/a", "na", "unknown", "-", "none"]

US_EXACT = ["us", "usa", "u.s.", "u.s.a.", "united states", "united states of america"]

US_PHRASES = [
    "united states",
    "united states of america",
    "us-remote",
    "us remote",
    "remote - us",
    "remote, us",
    "remote us",
    "us locations",
]

US_CITIES = [
    "nyc", "new york", "san francisco", "sf", "seattle", "sea", "chicago", "chi", "boston",
    "los angeles", "la", "austin", "denver", "atlanta", "miami", "washington dc",
    "washington, dc", "dc", "portland", "dallas", "houston", "philadelphia", "phoenix",
    "san diego", "south san francisco",
]

US_STATES = [
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut",
    "delaware", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa",
    "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan",
    "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada",
    "new hampshire", "new jersey", "new mexico", "new york", "north carolina",
    "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island",
    "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia",
    "washington", "west virginia", "wisconsin", "wyoming",
]

US_STATE_CODES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA",
    "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ",
    "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT",
    "VA", "WA", "WV", "WI", "WY", "DC",
]

NON_US_PHRASES = [
    "canada", "ireland", "united kingdom", "london", "singapore", "australia", "japan",
    "india", "germany", "france", "netherlands", "spain", "mexico", "brazil", "sweden",
    "poland", "switzerland", "denmark", "norway", "finland", "italy", "portugal", "belgium",
    "austria", "new zealand", "hong kong", "china", "south korea",
]

UNKNOWN_LOCATION = "Unknown location"
