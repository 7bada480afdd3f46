"""Words, patterns, thresholds and texts that results depend on."""

# --- rule catalogue -------------------------------------------------------

RULE_TYPES = ("data_retention", "data_access", "data_quality", "data_security", "data_privacy")
VALIDATED_RULE_TYPES = ("data_quality", "data_security", "data_privacy")
PLACEHOLDERS = ("unknown", "null", "none", "n/a", "")
PLACEHOLDER_FIELDS = ("condition", "action", "scope", "penalty", "timeframe", "source_reference")

OPERATOR_SPELLINGS = {
    "=": ("EQUAL", "EQUALS", "EQUAL TO", "EQ", "IS"),
    "!=": ("NOT EQUAL", "NOT_EQUAL", "NOT EQUALS", "NEQ", "NE", "<>", "IS NOT", "ISNOT"),
    ">": ("GREATER THAN", "GREATER_THAN", "GT", "GREATER"),
    "<": ("LESS THAN", "LESS_THAN", "LT", "LESS"),
    ">=": ("GREATER THAN OR EQUAL", "GREATER_THAN_OR_EQUAL", "GREATER OR EQUAL", "GTE", "GE"),
    "<=": ("LESS THAN OR EQUAL", "LESS_THAN_OR_EQUAL", "LESS OR EQUAL", "LTE", "LE"),
    "IS NOT NULL": (
        "IS NOT NULL", "IS_NOT_NULL", "ISNOTNULL", "NOT NULL", "NOT_NULL", "NOTNULL", "HAS VALUE", "PRESENT",
    ),
    "IS NULL": ("IS NULL", "IS_NULL", "ISNULL", "NULL", "EMPTY", "IS EMPTY", "MISSING"),
    "IN": ("IN LIST", "IN_LIST", "IN SET", "IN_SET"),
    "NOT IN": ("NOT IN LIST", "NOT_IN_LIST", "NOT IN SET", "NOT_IN_SET"),
    "CONTAINS": ("CONTAINS", "INCLUDES"),
    "STARTS_WITH": ("STARTS WITH", "BEGINS WITH"),
    "ENDS_WITH": ("ENDS WITH",),
}
UNSCANNABLE_OPERATORS = ("EXISTS", "SKIP", "")
REGEX_OPERATORS = (
    "REGEX", "REGEXP", "MATCHES", "MATCHES_REGEX", "REGEX_MATCH", "LIKE_REGEX", "MATCHES_PATTERN",
)
COMPARISONS = ("=", "!=", ">", "<", ">=", "<=")
DATE_TOKENS = ("NOW", "INTERVAL", "CURRENT_TIMESTAMP", "CURRENT_DATE", "DAYS", "MONTHS", "YEARS")
NUMERIC_NAME_PARTS = (
    "amount", "count", "balance", "fee", "rate", "price", "quantity", "total", "sum", "laundering",
)
ROUTING_CONFIDENCE = 0.7
HIGH_RULE_CONFIDENCE = 0.8

# --- review and report ----------------------------------------------------

VALIDATION_CEILING = 0.85
VALIDATION_SAMPLE = 50
VALIDATION_BATCH = 20
EXPLANATION_SAMPLE = 5
REVIEW_CONFIDENCE = 0.7
SEVERITY_FLOORS = (("HIGH", 500), ("MEDIUM", 50))
REPORT_GRADES = (("A", 90), ("B", 75), ("C", 60), ("D", 45))
DASHBOARD_GRADES = (("A", 90), ("B", 80), ("C", 70), ("D", 60))
DASHBOARD_WEIGHTS = {"HIGH": 8, "MEDIUM": 3}
DASHBOARD_PENALTY_CAP = 25
FALSE_POSITIVE_NOTE = "LLM validator classified as false positive"

# --- text -----------------------------------------------------------------

# Characters that count as white space at the edges of a text.
EDGE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
SECTION_PATTERNS = (
    r"Article\s+\d+",
    r"Section\s+\d+[.:]?",
    r"\d+\.\s+[A-Z][a-z]+",
    r"Chapter\s+\d+",
    r"Part\s+[IVX]+",
)
OBLIGATION_TERMS = ("must", "shall", "required to", "prohibited", "obligation")
GUARD_MIN_CHARS = 50
GUARD_MAX_CHARS = 8000
REDACTIONS = (
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN_REDACTED]"),
    (r"\b\d{16}\b", "[CC_REDACTED]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"),
)
CONCEPT_WORDS = {
    "retention": ("retain", "retention", "delete", "archive", "expire", "days"),
    "access": ("access", "permission", "role", "authoriz", "restrict"),
    "encryption": ("encrypt", "hash", "mask", "obfuscate", "cipher"),
    "pii": ("pii", "personal", "email", "ssn", "name", "address", "phone"),
    "consent": ("consent", "opt-in", "opt-out", "agreement", "permission"),
    "audit": ("audit", "log", "trace", "record", "monitor"),
    "financial": ("amount", "transaction", "currency", "payment", "balance"),
    "aml": ("laundering", "suspicious", "kyc", "sanction", "compliance"),
}

# --- personal data in column names ------------------------------------------

PII_NAMES = (
    "email", "phone", "ssn", "social_security", "credit_card", "card_number", "password", "name",
    "first_name", "last_name", "address", "dob", "date_of_birth", "salary", "income", "account_number",
)
PII_NAME_PARTS = ("account", "name", "ssn", "email", "phone")
PII_CATEGORY_PARTS = {
    "email": ("email", "mail"),
    "phone": ("phone", "mobile", "cell"),
    "ssn": ("ssn", "social_security"),
    "credit_card": ("credit_card", "card_number", "card_num"),
    "name": ("name", "first_name", "last_name"),
    "address": ("address", "street", "city", "zip"),
    "password": ("password", "secret", "token"),
    "financial": ("salary", "income", "balance", "amount"),
}
SEMANTIC_CATEGORIES = (
    "email", "phone", "ssn", "credit_card", "name", "address", "password", "health", "financial",
)
SEMANTIC_CATEGORY_MIN = 0.6

# --- query requests ---------------------------------------------------------

ACCESS_LEVELS = {
    "admin": 5, "compliance_officer": 5, "data_engineer": 4, "analyst": 3, "developer": 3,
    "marketing": 2, "support": 2, "viewer": 1, "intern": 1,
}
DEFAULT_ACCESS_LEVEL = 2
CLARIFICATION_HEAD = "Please provide the following information:"
CLARIFICATIONS = {
    "PURPOSE": "- The specific purpose for accessing this data (analytics, support, marketing, etc.)",
    "COLUMN_SCOPE": "- Which specific columns you need instead of SELECT *",
    "JURISDICTION": "- The jurisdiction/country filter for this multi-jurisdiction data",
    "PII_JUSTIFICATION": "- Justification for accessing PII data (business need, legal basis)",
}
GUIDANCE_HEAD = "To gain access, consider the following:"
GUIDANCE_MASK = "- Request only anonymised/masked columns"
GUIDANCE_LOG = "- Ensure audit logging is enabled for your session"
GUIDANCE_AVOID = "- Avoid requesting sensitive columns: "
GUIDANCE_JUSTIFY = "- Provide a specific business justification"
GUIDANCE_CONTACT = "- Contact the compliance team for access elevation"
RESULT_ROW_CAP = 1000

# --- retrieval and reuse ----------------------------------------------------

POLICY_CONFIDENCE = 0.40
RETRIEVE_K = 20
FINAL_K = 5
L2_K = 10
BOOST_COLUMN = 0.10
BOOST_PII = 0.08
BOOST_PURPOSE = 0.05
PRIVACY_CONCEPTS = ("pii", "privacy", "encryption")
EXACT_TTL_SECONDS = 3600
VECTOR_TTL_SECONDS = 21600
FUZZY_RATIO = 0.95
SEMANTIC_COSINE = 0.92
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
