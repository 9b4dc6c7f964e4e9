"""Closed vocabularies of the catalog.

Fixed values: results only agree with the published behaviour when these lists
hold exactly these entries.
"""

REGIONS = ["Global", "Asia", "Americas", "Europe", "Africa", "Oceania"]

CATEGORIES = [
    "Graduate Admissions",
    "Undergraduate Admissions",
    "Business School",
    "Medical Admissions",
    "Medical Licensing",
    "Engineering Admissions",
    "Law School",
    "Law Licensing",
    "Language Proficiency",
    "Professional Certification",
    "Finance Certification",
    "Secondary Education",
    "Government",
]

# In ascending order; the ordinal of a difficulty is its position from 1.
DIFFICULTIES = ["Medium", "Hard", "Very Hard", "Extremely Hard"]

SORT_MODES = ["relevance", "deadline", "cost_asc", "difficulty"]

MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

# Spellings that count as a mention of each month, in calendar order.
MONTH_SPELLINGS = [
    ["jan", "january", "jan."],
    ["feb", "february", "feb."],
    ["mar", "march", "mar."],
    ["apr", "april", "apr."],
    ["may"],
    ["jun", "june", "jun."],
    ["jul", "july", "jul."],
    ["aug", "august", "aug."],
    ["sep", "sept", "september", "sep."],
    ["oct", "october", "oct."],
    ["nov", "november", "nov."],
    ["dec", "december", "dec."],
]

# A date holding one of these words has no sortable form.
UNDATED_WORDS = ["year round", "year-round", "rolling", "ongoing", "n/a", "tba", "tbd"]

# A deadline equal to one of these (in lower case) is a rolling deadline.
ROLLING_DEADLINES = ["rolling", "n/a", "", "tba"]

CHUNK_TTL_DAYS = 30
STALE_AFTER_DAYS = 60
