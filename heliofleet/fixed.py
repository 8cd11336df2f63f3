"""Fixed values.

Everything in this file is a fixed value that results depend on: thresholds, word lists,
patterns, formats, argument bounds and list prices. Nothing here is logic.
"""

# --- scoring -------------------------------------------------------------------------
STC_IRRADIANCE_WM2 = 1000.0
PERFORMANCE_RATIO = 0.8
MIN_EXPECTED_SHARE = 0.05
MIN_GHI_WM2 = 200.0
UNDERPERFORMING_BELOW = 0.6
CURTAILED_SHARE = 0.05
INTERVAL_MINUTES = 5
WEATHER_TOLERANCE_MINUTES = 30
BACKWARD_WEATHER_MINUTES = 60
CURTAILED_KINDS = ("curtailed", "likely_curtailed")

# --- market reports ------------------------------------------------------------------
NEM_OFFSET = "+10:00"
REPORT_TIME_FORMAT = "yyyy/MM/dd HH:mm:ss"
SCADA_TABLE = ("DISPATCH", "UNIT_SCADA")
PRICE_TABLE = ("DISPATCH", "PRICE")
UNIT_SOLUTION_TABLE = ("DISPATCH", "UNIT_SOLUTION")
SCADA_FILE = r"PUBLIC_DISPATCHSCADA_(\d{12})_\d+\.zip"
PRICE_FILE = r"PUBLIC_DISPATCHIS_(\d{12})_\d+\.zip"
NEXT_DAY_FILE = r"PUBLIC_NEXT_DAY_DISPATCH_(\d{8})_\d+\.zip"
MAX_SCADA_FILES = 36
MAX_PRICE_FILES = 12
MAX_NEXT_DAY_FILES = 2
MAX_INGEST_ATTEMPTS = 5
REGISTRY_NETWORK = "NEM"
REGISTRY_FUEL = "solar_utility"
REGISTRY_STATUS = "operating"
FRESH_LIVE_MINUTES = 15
FRESH_DELAYED_MINUTES = 30
STALE_MINUTES = 45

# --- chunking, keyword and vector ranking ----------------------------------------------
MAX_CHUNK_CHARS = 1200
BM25_K1 = 1.2
BM25_B = 0.75
RRF_K = 60
CANDIDATES = 20

STOPWORDS = tuple(
    """a about above after again against all am an and any are as at be because been before
    being below between both but by can could did do does doing down during each few for from
    further had has have having he her here hers him his how i if in into is it its itself just
    me more most my no nor not now of off on once only or other our out over own same she should
    so some such than that the their them then there these they this those through to too under
    until up very was we were what when where which while who whom why will with would you your
    s t don isn wasn""".split()
)

QUERY_EXPANSIONS = {
    "pr": "performance ratio",
    "pi": "performance index",
    "poa": "plane array irradiance",
    "ghi": "global horizontal irradiance",
    "mlf": "marginal loss factor",
    "pid": "potential induced degradation",
    "uigf": "unconstrained intermittent generation forecast",
    "scada": "scada readings",
    "washing": "cleaning",
    "wash": "cleaning",
    "hot": "temperature",
    "heat": "temperature",
    "aemo": "aemo nem",
    "offline": "trip zero output",
    "timezone": "time zone nem time",
}

STEM_SUFFIXES = (("ies", "y"), ("ing", ""), ("ed", ""), ("s", ""))

# --- secret masking: (name, pattern, Java replacement), applied in this order ------------
SECRET_RULES = (
    ("url_credentials", r"(?iU)(\b[a-z][a-z0-9+.-]*://)[^/\s'\"@]+@", "$1***@"),
    (
        "key_value",
        r"(?iU)(x-api-key|api[_-]?key|authorization|password|secret|token)"
        r"(\\?[\"']?\s*[:=]\s*\\?[\"']?)(bearer\s+)?[^\s,;&'\"\\}]+",
        "$1$2***",
    ),
    ("bearer", r"(?iU)\bbearer\s+[A-Za-z0-9._~+/=-]{8,}", "Bearer ***"),
    ("sk_key", r"(?U)\bsk-[A-Za-z0-9_-]{16,}", "sk-***"),
)

# Lower-case literals without which a rule cannot match (any one of them).
SECRET_LITERALS = {
    "url_credentials": ("://",),
    "key_value": ("api-key", "api_key", "apikey", "authorization", "password", "secret", "token"),
    "bearer": ("bearer",),
    "sk_key": ("sk-",),
}

# --- question routing --------------------------------------------------------------------
MAX_QUESTION_CHARS = 500
DEFAULT_HOURS = 24
MAX_HOURS = 168
REGION_PATTERNS = (
    (r"\bnsw\b|new south wales", "NSW1"),
    (r"\bqld\b|queensland", "QLD1"),
    (r"\bvic\b|victoria", "VIC1"),
    (r"\bsa\b|south australia", "SA1"),
    (r"\btas\b|tasmania", "TAS1"),
)
REGION_CODES = ("NSW1", "QLD1", "VIC1", "SA1", "TAS1")
HOURS_PATTERN = r"(\d+)\s*(hours?|hrs?|h)\b"
DAYS_PATTERN = r"(\d+)\s*days?\b"
WEEK_PATTERN = r"\bweek\b"
ONE_HOUR_PATTERN = r"\b(last|past|this) hour\b"
THRESHOLD_PATTERN = r"(?:below|under|less than)\s*(\d{1,3})\s*(%|percent)"
UNDER_PATTERN = (
    r"underperform|under-perform|below|worst|lagging|not producing|low output|"
    r"problem|issue|fault|losing|struggling|poorly|behind"
)
CURTAIL_PATTERN = r"curtail|dispatched down|constrained|negative pric|semi-dispatch|\bcapped\b"
LIST_PATTERN = (
    r"\blist\b|which (solar )?farms|what (solar )?farms|how many (solar )?farms|"
    r"show (me )?(the |all )?(solar )?farms|\bfind\b"
)
DOCS_PATTERN = (
    r"\bhow (do|does|should|can|to|is|are)\b|\bwhat (is|are|does|do|causes?|should)\b|"
    r"\bwhat's (a|an|the)\b|\bwhy\b|\bexplain|\bmean(s|ing)?\b|\bdefin|troubleshoot|"
    r"checklist|runbook|procedure|\bsteps?\b|\bguid(e|ance)\b|\bwhen (is|should|do)\b|"
    r"\btell me about\b|\bdifference between\b|\bis (it|that|this) (a|normal)\b"
)
LIVE_PATTERN = (
    r"\b(right now|now|currently|today|tonight|at the moment|latest|"
    r"this (morning|afternoon|evening|week)|(last|past) (\d+|hour|day|week))\b"
)
FLEET_PATTERN = (
    r"\b(energy|mwh|generat\w*|total|fleet|summary|compare|market|happened|overall|doing)\b|"
    r"\d+\s*(hours?|hrs?|days?)\b|\bweek\b"
)
DATA_ASK_PATTERN = r"\b(which|any|show|list|worst|farms)\b"
DIAGNOSTIC_PATTERN = (
    r"\bwhy\b|\bcause|\breason|what should i (check|do)|"
    r"how (do|can|should) i (fix|check|investigate)|troubleshoot"
)
NAME_NOISE_PATTERN = r"\b(solar|farm|park|power|station|plant|hub|project|sf|pv)\b"
GENERIC_FIRST_WORDS = (
    "western", "eastern", "northern", "southern", "north", "south", "east", "west",
    "mount", "lake", "river", "new", "big", "port", "green", "sun", "hill", "valley",
)

# Argument rules of the six tools: (tool, argument, kind, low, high, default, required).
# For text the bounds are lengths; "region" means one of REGION_CODES or nothing.
TOOL_ARGUMENTS = (
    ("underperformers", "threshold", "float", 0.05, 1.5, "0.6", False),
    ("underperformers", "limit", "int", 1, 25, "10", False),
    ("underperformers", "region", "region", None, None, None, False),
    ("facility_performance", "facility", "text", 2, 80, None, True),
    ("facility_performance", "hours", "int", 1, 168, "24", False),
    ("fleet_summary", "hours", "int", 1, 168, "24", False),
    ("fleet_summary", "region", "region", None, None, None, False),
    ("curtailed_farms", "limit", "int", 1, 25, "10", False),
    ("curtailed_farms", "region", "region", None, None, None, False),
    ("find_facilities", "region", "region", None, None, None, False),
    ("search_docs", "query", "text", 3, 300, None, True),
    ("search_docs", "k", "int", 1, 8, "4", False),
)

NO_PASSAGES_TEXT = "I couldn't find anything about that in the knowledge base."

# --- usage cost: USD per million (input, output) tokens -----------------------------------
MODEL_PREFIX_PATTERN = r"^(apac|us|eu|global)\."
MODEL_PRICES = (
    ("amazon.nova-micro-v1:0", 0.035, 0.14),
    ("amazon.nova-lite-v1:0", 0.06, 0.24),
    ("amazon.nova-pro-v1:0", 0.80, 3.20),
    ("gpt-4o-mini", 0.15, 0.60),
    ("gpt-4o", 2.50, 10.00),
)
