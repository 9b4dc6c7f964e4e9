"""Rule tables of the input and output data-quality jobs.

Fixed values: verdicts only agree with the published behaviour when these
tables hold exactly these entries.
"""

MIN_QUERY_CHARS = 2
MAX_QUERY_CHARS = 500
MAX_CATEGORY_CHARS = 80
MIN_DESCRIPTION_CHARS = 20

INJECTION_PATTERNS = [
    r"\bignore\s+(all\s+)?(previous|prior|above|instructions?|prompts?|rules?|constraints?)\b",
    r"\bdisregard\s+(all\s+)?(previous|prior|instructions?|rules?)\b",
    r"\bforget\s+(everything|all|previous|instructions?|your\s+role)\b",
    r"\boverride\s+(your\s+)?(instructions?|rules?|guidelines?|training)\b",
    r"\byou\s+are\s+(now\s+)?(a\s+)?(?!looking|searching|an?\s+exam)[a-z]+\s+(ai|bot|assistant|model|system)\b",
    r"\bact\s+as\s+(a\s+)?(?!an?\s+exam)[a-z\s]+\b",
    r"\bpretend\s+(you\s+are|to\s+be)\b",
    r"\broleplay\s+as\b",
    r"\bdan\b.*\bmode\b",
    r"\bjailbreak\b",
    r"\bsystem\s*prompt\b",
    r"\b(new|revised?|updated?)\s+(system\s+)?instruction\b",
    r"<\s*/?system\s*>",
    r"\[INST\]",
    r"###\s*(instruction|system|human|assistant)",
    r"\bprint\s+(your\s+)?(system\s+)?(prompt|instructions?)\b",
    r"\bdo\s+anything\s+now\b",
]

SCRIPT_PATTERNS = [
    r"<\s*script\b",
    r"javascript\s*:",
    r"on\w+\s*=\s*[\"']",
    r"--\s*$",
    r"\bUNION\s+SELECT\b",
    r"\bDROP\s+TABLE\b",
    r"\bEXEC\s*\(",
    r"\beval\s*\(",
    r"\bimport\s+os\b",
    r"\b__import__\s*\(",
    r"\\x[0-9a-f]{2}",
]

EDUCATION_WORDS = [
    "exam", "test", "assessment", "certification", "certificate", "qualification",
    "entrance", "admission", "scholarship", "gre", "gmat", "sat", "act", "lsat", "mcat",
    "ielts", "toefl", "upsc", "gate", "cat", "jee", "neet", "bar", "cpa", "cfa", "toeic",
    "pte", "oet", "step", "study", "university", "college", "school", "degree", "graduate",
    "undergraduate", "postgraduate", "masters", "phd", "bachelor", "academic", "curriculum",
    "syllabus", "subject", "course", "medical", "law", "engineering", "business", "finance",
    "language", "proficiency", "aptitude", "competitive", "board", "council", "institute",
    "ministry", "india", "china", "usa", "uk", "australia", "europe", "asia", "global", "international",
]

OFF_TOPIC_PATTERNS = [
    r"\b(recipe|cook(ing)?|bake|baking|ingredient)\b",
    r"\b(weather|forecast|temperature|rain|snow|sunny)\b",
    r"\b(stock\s+price|bitcoin|crypto|forex|trading\s+signal)\b",
    r"\b(movie|film|song|lyrics|spotify|netflix|streaming)\b",
    r"\b(sex|porn|nude|xxx|adult\s+content)\b",
    r"\b(hack\s+into|steal\s+password|crack\s+account)\b",
]

EMAIL_PATTERN = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE_PATTERN = r"(\+?\d[\d\s\-().]{7,}\d)"

URL_PATTERN = r"^https?://[a-zA-Z0-9\-.]+\.[a-zA-Z]{2,}(/[^\s]*)?$"

# (pattern, ignore case)
BAD_NAME_PATTERNS = [
    (r"<[^>]+>", False),
    (r"\{\{.*?\}\}", False),
    (r"\b(TODO|FIXME|PLACEHOLDER|NULL|NONE|N/A)\b", True),
    (r"^[^a-zA-Z]+$", False),
    (r"(.)\1{6,}", False),
    (r"ignore\s+(previous|instructions)", True),
    (r"<script", True),
]

BAD_COST_PATTERN = r"[<>{}\[\]'\";]"

# (code, severity) of each blocking input rule, in the order they are tried.
INPUT_BLOCKS = [
    ("EMPTY_QUERY", "high"),
    ("QUERY_TOO_SHORT", "medium"),
    ("QUERY_TOO_LONG", "medium"),
    ("CONTROL_CHARS", "high"),
    ("EXCESSIVE_REPEAT", "medium"),
    ("PROMPT_INJECTION", "high"),
    ("SCRIPT_INJECTION", "high"),
    ("OFF_TOPIC", "medium"),
    ("GIBBERISH", "medium"),
    ("INVALID_REGION", "low"),
    ("INVALID_DIFFICULTY", "low"),
    ("INVALID_CATEGORY", "low"),
]
