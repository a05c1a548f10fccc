"""Word lists, patterns and limits that results depend on. Every operator takes
its own as a parameter with these as the default."""

from __future__ import annotations

# --- usability of an extracted page
ERROR_MARKERS = (
    "page you're looking for", "page you’re looking for", "page doesn't exist", "page doesn’t exist", "page not found", "404 - sorry",
    "404 error", "may have been moved, deleted, or never existed", "access denied", "are you a robot", "enable javascript",
)
ERROR_SCAN_CHARS = 2000
CHROME_PHRASES = (
    "wellness corner", "call to buy", "contact us", "menu", "buy health insurance", "renew", "claim", "login", "sign in", "download app",
    "follow us", "privacy policy", "terms and conditions", "all rights reserved", "cookie", "subscribe to our newsletter", "toll free",
    "customer care", "site map", "sitemap", "share this", "read more", "view all", "know more",
)
MIN_USABLE_WORDS = 150
MAX_CHROME_RATIO = 0.5

# --- lines that are no content
DROP_LINES = (
    r"^\s*$",
    r"^[\W_]+$",
    r"(?i)^(?:home|menu|search|close|next|previous|back)\s*$",
    r"^\d{1,3}\s*$",
    r"(?i)©|\ball rights reserved\b",
    r"(?i)^\s*(?:irdai|isnp)\s+registration\s+n[o0]",
    r"(?i)\b(?:cin|uin|gstin)\s*[:\-]",
    r"(?i)^\s*(?:follow|share|connect)\s+(?:us|this)\b",
    r"(?i)^\s*(?:toll[\s-]?free|call\s+to\s+buy|whatsapp)\b",
    r"(?i)^\s*(?:download|get)\s+(?:the\s+)?app\b",
    r"(?i)\bcookies?\b.*\b(?:accept|consent|policy)\b",
    r"^\s*(?:english|हिंदी|தமிழ்|తెలుగు|বাংলা|मराठी)\s*$",
    r"(?i)^\s*(?:edit|citation needed|jump to|retrieved from)\b",
    r"^\s*\[\d+\]\s*$",
    r"(?i)^\s*(?:see also|references|external links|further reading|notes)\s*$",
    r"(?i)^\s*(?:start|begin|get|buy|renew|explore|discover|compare|check)\b.{0,60}$",
    r"(?i)\b(?:rated|awarded|ranked)\s+(?:by|as|#)\b",
    r"(?i)\b(?:t&c|terms)\s*(?:apply|\*)",
    r"(?i)^\s*(?:quick|useful|important|related|popular)\s+(?:links|searches|articles|reads)\s*$",
    r"(?i)^\s*(?:with|at)\s+(?:[\w&]+\s+){0,3}(?:today|now)!?\s*$",
    r"^\s*\*+\s*$",
)
CHROME_LINE_WORDS = 5
NAV_RUN, NAV_LINE_WORDS = 3, 8
REPEATED_LINE_WORDS, REPEATED_LINE_DOCUMENTS = 12, 3

# --- personal data by shape, in this order; the last kinds need a cue in the characters before
SHAPES = (
    ("EMAIL", r"\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b"),
    ("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"),
    ("LEAD_REF", r"\b[A-Z]{2}-\d{4}-\d{2}-\d{4,6}\b"),
    ("POLICY_NUMBER", r"\b[A-Z]{2}-[A-Z]-\d{6,}\b"),
    ("PHONE", r"\+91[\s-]?[6-9]\d{4}[\s-]?\d{5}\b"),
)
CUED_SHAPES = (
    ("AADHAAR", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", ("aadhaar", "aadhar", "uid", "uidai")),
    ("PHONE", r"\b[6-9]\d{4}[\s-]?\d{5}\b", ("phone", "mobile", "contact", "number", "call", "tel", "whatsapp", "reach", "cell")),
)
CUE_WINDOW = 70
NAME_CUE = r"\b((?i:caller|customer|insured|agent|advisor|policyholder|lead\s+name|name)\s*[:\-]?\s+(?:(?:Mr|Mrs|Ms|Dr|Shri|Smt)\.?\s+)?)([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})\b"
QUARANTINE_DENSITY = 0.02

# --- canonical terms and what stands for them
TERMS = {
    "sum insured": ("cover amount", "coverage limit", "cover limit", "sum assured"),
    "waiting period": ("cooling period", "cool-off period", "waiting-period"),
    "pre-existing disease": ("pre existing disease", "pre-existing condition", "preexisting disease", "PED"),
    "co-payment": ("co payment", "copayment", "co-pay", "copay"),
    "no claim bonus": ("no-claim bonus", "NCB", "cumulative bonus"),
    "cashless": ("cash-less", "cash less"),
    "premium": ("policy cost", "policy price"),
    "policy year": ("policy-year",),
}
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10,
    "november": 11, "december": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10,
    "nov": 11, "dec": 12,
}

# --- statements whose numbers are compared across documents
TOPICS = {
    "pre-existing disease waiting period": r"(?i)pre-existing disease[^.]{0,80}?(\d{1,3})\s*(month|year)",
    "initial waiting period": r"(?i)initial waiting period[^.]{0,60}?(\d{1,3})\s*(day|month)",
    "specified illness waiting period": r"(?i)specified illness[^.]{0,80}?(\d{1,3})\s*(month|year)",
    "maternity waiting period": r"(?i)maternity[^.]{0,80}?(\d{1,3})\s*(month|year)",
    "cashless network size": r"(?i)([\d,]{3,7})\s*(?:cashless\s+)?hospitals()",
    "co-payment share": r"(?i)co-payment[^.]{0,60}?(\d{1,3})\s*%()",
    "grace period": r"(?i)grace period[^.]{0,60}?(\d{1,3})\s*(day|month)",
}

# --- near duplicates
SHINGLE_WORDS, NEAR_DUPLICATE = 5, (17, 20)

# --- chunks
TARGET_WORDS, MAX_WORDS, MIN_WORDS, OVERLAP_WORDS, TABLE_ROWS = 260, 400, 25, 45, 12
METADATA_LINE = (
    r"(?i)^\s*(?:version\s+[\d.]+|(?:version|effective|last updated)\b[^|\n]{0,40}\|.*"
    r"|.*\|\s*(?:internal distribution|sales operations|contact centre[^|\n]*)\s*)$"
)
DOT_LEADERS = r"\.{4,}"
CITATION = r"(?i)Retrieved\s+\d{4}|Archived from the original|-\s*↑|\b(?:ISBN|ISSN)\b|\bdoi:|10\.\d{4,}/|\bpp\.\s*\d|\bvol\.\s*\d"
MIN_CITATIONS, MAX_CITATION_DENSITY, MAX_DOT_LEADERS, ANSWERABLE_WORDS, MAX_NON_PROSE = 3, 0.02, 2, 10, 0.4
ABBREVIATIONS = ("Rs", "Mr", "Mrs", "Ms", "Dr", "No", "vs", "etc", "i.e", "e.g")

# --- categories of records by their words
CATEGORIES = {
    "product": (
        "sum insured", "premium", "plan", "cover", "benefit", "floater", "top-up", "restoration", "no claim bonus", "network hospital",
        "day care", "room rent", "maternity benefit", "senior care",
    ),
    "policy_rule": (
        "waiting period", "exclusion", "grace period", "co-payment", "pre-existing", "portability", "lapse", "deductible", "sub-limit",
        "irdai", "grievance", "not covered", "permanent exclusion",
    ),
    "qualification": (
        "eligib", "age band", "age limit", "entry age", "zone", "qualif", "budget", "underwrit", "declared condition", "medical check",
        "required information", "decline", "referred",
    ),
    "faq": ("what is", "how do", "how long", "can i", "does the", "do i", "why is", "when are", "what happens", "is a "),
    "objection": (
        "objection", "too expensive", "already have", "do not need", "reject claims", "think about it", "guarantee", "cheapest",
        "price-sensitive", "acknowledge the concern",
    ),
    "process": (
        "script", "opening", "closing", "escalat", "compliance", "do not say", "consent", "call flow", "claim intimation", "pre-authoris",
        "transfer to", "callback",
    ),
}
HEADING_WEIGHT, BODY_WEIGHT, HINT_WEIGHT, BODY_SCAN_CHARS = 3, 1, 2, 600

# --- retrieval
RRF_K, LEXICAL_CANDIDATES, DENSE_CANDIDATES, RESERVED_SLOTS, AUTHORITY_MARGIN = 60, 25, 5000, 4, 0.06
TOP_K, MIN_SIMILARITY, QUERY_TOKENS = 6, 0.64, 24
BM25_K1, BM25_B = 1.2, 0.75
AUTHORITATIVE = ("internal_document",)

# --- figures in a reply
FIGURE = r"(?i)\b(\d[\d,.]*)\s*(?:months?|days?|years?|%|percent|lakhs?|crores?)(?![a-z])"
CURRENCY_FIGURE = r"(?i)\b(?:rs\.?|inr|rupees)\s*(\d[\d,.]*)"

# --- conversations and telemetry
HISTORY_TURNS = 6
LIVE_STAGES = ("asr", "retrieval", "llm", "agent_synthesis")
