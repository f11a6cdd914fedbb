"""Word lists, patterns, templates, weights and markers that decide results.

They have to equal what users of the matching and chat tools rely on today, so they are stated plainly.
"""

# --- request texts: simple form -------------------------------------------------------------
EXPERIENCE_PATTERN = r"(less|more) than ([0-9]+)\s*years?"
BUDGET_PATTERN = r"(?:budget of|under|below)\s*₹?([0-9]+)"

# --- request texts: bounds form -------------------------------------------------------------
SPECIALTY_ALIASES = {
    "crime section": "criminal law",
    "crime": "criminal law",
    "divorce": "family law",
    "property": "real estate law",
    "cyber": "cyber law",
}
MIN_YEARS_PATTERN = r"(?i)(?:more than|at least|min(?:imum)?) ([0-9]+) years?"
MAX_YEARS_PATTERN = r"(?i)(?:less than|max(?:imum)?) ([0-9]+) years?"
EXCLUDED_PLACE_PATTERN = r"(?i)(?:not in|except|avoid) (\w+)"
REQUIRED_SPECIALTY_PATTERN = r"(?i)(?:practicing|having|specializing in|handling|working on|doing) ([\w\s]+ law)"
EXCLUDED_SPECIALTY_PATTERN = r"(?i)(?:not|avoid|except|without) ([\w\s]+ law)"
PLACE_PATTERN = r"(?i)(?:in|located in|based in|from) (\w+)"
WANTED_SPECIALTY_PATTERN = r"(?i)(?:focus on|expert in|handles|deals with) ([\w\s]+ law)"

# --- request texts: full form ---------------------------------------------------------------
BETWEEN_PATTERN = r"between ([0-9]+)\s*(?:years?)?\s*(?:and|to)\s*([0-9]+)\s*(?:years?)?"
ONLY_YEARS_PATTERN = r"only ([0-9]+) years?"
MORE_THAN_PATTERN = r"more than ([0-9]+)"
LESS_THAN_PATTERN = r"less than ([0-9]+)"
INCLUDE_SPECIALTY_PATTERN = r"(?:specializing in|only|do|handles|focus(?: on)?) ([a-z\s]+(?: or [a-z\s]+)*)"
EXCLUDE_SPECIALTY_PATTERNS = (
    r"not in ([a-z\s]+) specialization",
    r"without ([a-z\s]+)",
    r"not ([a-z\s]+ law)",
)
CITIES = (
    "mumbai chennai delhi kolkata bangalore jaipur hyderabad patna noida ghaziabad pune ranchi "
    "allahabad indore nagpur bhubaneswar dehradun gurgaon shimla jabalpur chandigarh nainital "
    "jodhpur mathura meerut calcutta panaji howrah vapi guwahati varanasi bilaspur sonipat eluru "
    "shahdol rudrapur angul kotdwara shivpuri malda dhule cuttack hoshiarpur mohali"
).split() + ["central delhi", "south delhi", "new delhi"] + "faridabad agartala gangtok bahraich alwar".split()

# --- scores ---------------------------------------------------------------------------------
RATING_TIERS = ((20, 5.0), (15, 4.5), (10, 4.0), (5, 3.0))
RATING_FLOOR = 2.0
PREFERENCE_STEP = 0.2
FITNESS_WEIGHTS = {"experience": 0.3, "settlements": 0.3, "satisfaction": 0.2, "price": 0.2}
TINY = 1e-6

# --- texts ----------------------------------------------------------------------------------
SUMMARY_TEMPLATE = (
    "{name} is a {role} specializing in {domain} with {experience} years of experience. "
    "Charges approximately {currency}{price} and has a client satisfaction rating of {satisfaction}/10."
)
NO_RATING = "No rating"
UNKNOWN = "Unknown"
NO_MATCH_MESSAGE = "⚠️ No {role}s found!"
NO_QUESTION = "No question provided"

# --- prompts --------------------------------------------------------------------------------
INSTRUCTION_OPEN, INSTRUCTION_CLOSE = "[INST]", "[/INST]"
SEQUENCE_OPEN, SEQUENCE_CLOSE = "<s>", "</s>"
DROPPED_MARKERS = ("<s>", "</s>", "[INST]", "</INST>")
SYSTEM_PROMPT = (
    "You are {assistant}, a knowledgeable, polite legal assistant. "
    "Answer comprehensively with clear structure. Use this template:\n"
    "## Summary (2–3 lines)\n"
    "## Key Steps (numbered)\n"
    "## Important Considerations (bullets)\n"
    "## Next Actions (bullets)\n"
    "Avoid legal jargon unless needed; be concise and practical."
)

# --- light markup to HTML: (pattern, replacement), applied in this order ----------------------
MARKUP_RULES = (
    (r"(?im)^\s*#{3}\s?(.*)$", "<h3>$1</h3>"),
    (r"(?im)^\s*#{2}\s?(.*)$", "<h2>$1</h2>"),
    (r"(?im)^\s*#\s?(.*)$", "<h1>$1</h1>"),
    (r"(?im)\*\*(.*?)\*\*", "<b>$1</b>"),
    (r"(?im)\*(.*?)\*", "<i>$1</i>"),
    (r"(?im)^\s*[-•]\s+(.*)$", "• $1"),
    (r"(?im)^\s*([0-9]+)\.\s+(.*)$", "<div class='list-item'><b>$1.</b> $2</div>"),
    (r"(?i)(Next Actions:)", "<br><br><b>$1</b><br>"),
    (r"\n{3,}", "\n\n"),
    (r"\n", "<br>"),
    (r"<br>\s*<h2>", "<h2>"),
    (r"</h2><br>", "</h2>"),
)
HIGHLIGHT = '<mark class="hl">$0</mark>'

# --- listing pages: block start and one pattern per field -------------------------------------
LISTING_BLOCK = r'<div[^>]*class="[^"]*\bbs-box\b[^"]*"[^>]*>'
LISTING_NAME = r'(?s)<div[^>]*class="[^"]*custom-value-name[^"]*"[^>]*>(.*?)</div>'
LISTING_LABELLED = r'(?s)<div[^>]*class="[^"]*custom-label[^"]*"[^>]*>\s*{label}\s*</div>\s*<div[^>]*>(.*?)</div>'
LISTING_RATING = r'(?s)<div[^>]*class="[^"]*rating-tag[^"]*"[^>]*>(.*?)</div>'
LISTING_LINK = r'<a[^>]*href="([^"]*)"'
