"""Phrase lists, weights, thresholds and limits.

These are data the results depend on, in their natural order.
"""

# --- scoring -------------------------------------------------------------
JARGON_TERMS = [
    "right-of-way", "easement", "variance", "zoning", "ad valorem",
    "bond issuance", "rfp", "rfq", "municipal code",
]
ACTIONABLE_PHRASES = [
    "what can i do", "how do i", "how can i", "comment", "submit", "register",
    "sign up", "meeting", "hearing", "deadline", "apply",
]
AGENCY_PHRASES = [
    "public hearing", "comment period", "submit comments", "agenda",
    "register", "sign up", "vote", "deadline",
]
ORIENTATION_PHRASES = [
    "proposal", "ordinance", "resolution", "agenda item", "board", "commission",
]
REPRESENTATION_PHRASES = [
    "department", "council", "board", "commission", "residents", "staff", "mayor",
]
RELEVANCE_PHRASES = [
    "city council", "county", "ordinance", "resolution", "public hearing",
    "commission", "board", "budget", "zoning",
]
MEETING_PHRASES = ["public hearing", "hearing", "meeting"]
COMMENT_PERIOD_PHRASES = ["comment period", "public comment"]
DEADLINE_PHRASES = ["submit comments", "comment deadline", "deadline"]

DIMENSIONS = [
    "comprehensibility", "orientation", "representation", "agency",
    "relevance", "timeliness",
]
DIMENSION_WEIGHTS = {
    "comprehensibility": 0.25,
    "orientation": 0.20,
    "agency": 0.20,
    "representation": 0.15,
    "relevance": 0.10,
    "timeliness": 0.10,
}
SCORE_VERSION = "crf_v1"

# --- text gates ----------------------------------------------------------
MIN_TEXT_CHARS = 800
MAX_TEXT_CHARS = 18000
PROJECTION_MIN_CONFIDENCE = 0.55
SEARCH_BODY_CHARS = 20000

# --- civic text window ---------------------------------------------------
WINDOW_MAX_CHARS = 3000
WINDOW_OPENING_CHARS = 700
SEGMENT_TARGET_CHARS = 550
SEGMENT_MAX_CHARS = 800
SEGMENT_MIN_SCORE = 1.0
WINDOW_SEPARATOR = "\n\n---\n\n"
CIVIC_PHRASES = [
    "city council", "county", "council", "commission", "board", "department",
    "agency", "ordinance", "resolution", "budget", "zoning", "permit",
    "variance", "planning", "public hearing", "agenda", "meeting", "minutes",
    "notice", "public notice", "election", "ballot", "tax", "levy", "bond",
    "rfp", "rfq", "bid",
]
PROCESS_PHRASES = [
    "comment period", "submit comments", "public comment", "register to speak",
    "call for", "will vote", "to vote", "scheduled", "hearing", "adopt",
    "approve", "consider", "application", "deadline",
]

# --- evidence pack -------------------------------------------------------
PACK_MAX_CHARS = 3500
PACK_OPENING_CHARS = 1000
PACK_TAIL_CHARS = 700
PACK_NORMAL = {"dates": 3, "contacts": 2, "headings": 2, "before": 240, "after": 340, "lines": 8}
PACK_REBUILD = {"dates": 5, "contacts": 3, "headings": 3, "before": 350, "after": 450, "lines": 10}
DATETIME_KEYWORDS = ["at", "by", "no later than", "will", "held", "conducted", "meeting"]
BOILERPLATE_WORDS = ["affidavit", "notary", "subscribed and sworn"]
PUBLICATION_WORDS = ["published on", "publication"]

# --- patterns. Word edges are ASCII look-arounds, see functions.text.word --
MONTH = (
    "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?"
    "|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
MONTH_LETTERS = "adfjmnos"  # with which names of months begin
WEEKDAY = (
    "(?:mon(?:day)?|tue(?:sday)?|wed(?:nesday)?|thu(?:rsday)?|fri(?:day)?"
    "|sat(?:urday)?|sun(?:day)?)"
)
URL_PATTERN = r"(?i)https?://[^\s)]+"

# --- claims --------------------------------------------------------------
CLAIM_PERSON = "article_mentions_person"
CLAIM_ORG = "article_mentions_org"
CLAIM_LOCATION = "article_mentions_location"
CLAIM_KEYWORD = "article_keyword"
CLAIM_ISSUE_AREA = "article_issue_area"
CLAIM_OPPORTUNITY = "article_opportunity"
ORGANIZATION_TYPES = ["government", "news_media", "nonprofit", "business", "school", "other"]
OPPORTUNITY_TYPES = ["meeting", "public_comment", "deadline", "application", "other"]
TIMELINE_STATUSES = ["completed", "current", "upcoming", "unknown"]
DECISION_BODY_WORDS = [
    "city council", "planning commission", "board", "authority", "committee",
    "council", "commission",
]
OPEN_NOW_KEYS = ["public_comment_period", "comment_period", "application_period"]
DOCUMENT_URL_WORDS = [
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", "documentcenter",
    "/document/", "download", "attachment", "file=", "adid=",
    "archive.aspx?adid=",
]
BULLET_LIMIT = 5

# --- schedule ------------------------------------------------------------
DEFAULT_RUN_AT = "08:00"
SCRAPER_TYPES = ["rss", "html"]
CRON_BY_FREQUENCY = {
    "hourly": "0 * * * *",
    "daily": "0 3 * * *",
    "weekly": "0 3 * * 1",
    "monthly": "0 3 1 * *",
}
IMPORT_TYPES = {"rss_feed": "rss", "html_scrape": "html", "json_api": "api"}

# --- fixed prefixes of calendar identity keys ----------------------------
CENTURY_KEY = "century2"
LIBCAL_KEY = "libnet"
SIMPLEVIEW_KEY = "visitwichita"
