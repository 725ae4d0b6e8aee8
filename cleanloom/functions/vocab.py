"""Fixed values the results depend on: keywords, tokens, patterns and lookup tables."""

# Column-name keywords of each role.
DATE_WORDS = ("date", "time", "timestamp", "datetime", "created", "updated", "joined", "dob", "birth",
              "year", "month", "day")
NUMERIC_WORDS = ("age", "salary", "price", "cost", "amount", "count", "pct", "percent", "rate", "score",
                 "income", "revenue", "fee", "payment", "wage", "height", "weight", "distance", "quantity",
                 "total")
CATEGORY_WORDS = ("name", "email", "country", "city", "address", "state", "region", "category", "type",
                  "status", "gender", "title", "description", "remark", "comment", "note")
MONEY_WORDS = ("salary", "price", "cost", "amount", "payment", "wage", "income", "revenue", "fee")
RANGE_WORDS = ("pct", "percent", "probability")
PERCENT_RULE_WORDS = ("discount", "tax", "rate", "markup")
PERCENT_FIX_WORDS = ("discount", "tax", "rate", "percentage", "markup")
PHONE_WORDS = ("phone", "mobile")
NO_SPECIAL_CHECK_WORDS = ("email", "url", "website", "link", "phone", "contact")
WHOLE_NUMBER_WORDS = ("count", "quantity", "number")

# Tokens that stand for a missing value.
PROXY_TOKENS = ("?", "unknown", "n/a", "none", "null", ".")
EMPTY_TOKENS = ("", "nan", "NaN", "None", "NONE")
UNCLEAN_MODE_TOKENS = ("unknown", "none", "null", "n/a")
UNCLEAN_TEXT_MODE_TOKENS = ("unknown", "none", "null", "n/a", "", "nan")

# Tokens a CSV reader takes for null.
CSV_NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                   "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# Patterns of the text checks and fixes. Whitespace includes the Unicode spaces.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_NOISE_PATTERN = r"[-.()\s+]"
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
EDGE_SPACE_PATTERN = f"^{SPACE}|{SPACE}$"
OUTER_SPACES_PATTERN = f"^{SPACE}+|{SPACE}+$"
SPECIAL_PATTERN = r"[?!#$%^&*]"
SPECIAL_OR_AT_PATTERN = r"[?!@#$%^&*]"
NON_ASCII_PATTERN = r"[^\x00-\x7F]"
LETTER_PATTERN = r"[a-zA-Z]"

# E-mail domain typos and their corrections, applied in this order.
EMAIL_TYPOS = {
    "gnail.com": "gmail.com",
    "gmal.com": "gmail.com",
    "yaho.com": "yahoo.com",
    "hotmial.com": "hotmail.com",
    "outlok.com": "outlook.com",
    "gmial.com": "gmail.com",
}

# English number words.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8,
    "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15,
    "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30,
    "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100,
    "thousand": 1000,
}

# Date formats tried by type inference, and the ladder of the date checks and fixes.
INFERENCE_DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "dd-MM-yyyy",
                          "MM-dd-yyyy", "yyyy.MM.dd")
LADDER_DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy.MM.dd", "dd.MM.yyyy",
                       "yyyy/MM/dd", "dd-MM-yyyy", "MM-dd-yyyy")

# Bounds and defaults of the domain rules.
AGE_MIN, AGE_MAX, AGE_DEFAULT = 0, 120, 30
MONEY_DEFAULT = 50000
DATE_DEFAULT = "1900-01-01"


def mentions(name: str, words) -> bool:
    """Case-insensitive substring match of a column name against keywords."""
    lowered = name.lower()
    return any(word in lowered for word in words)
