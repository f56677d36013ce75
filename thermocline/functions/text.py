"""Rules that sort questions: chat or data, analytical or not, and which intent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the patterns and word lists decide the labels, so they are part of the result ------------
GREETING = (
    r"(?i)^(hi+|hello+|hey+|howdy|sup|what'?s up|good\s+(morning|afternoon|evening|day)"
    r"|how are you|who are you|what are you|what can you do"
    r"|thanks?|thank you|okay|ok|cool|nice|great|wow|lol|haha"
    r"|bye|goodbye|see you|yes|no|sure|alright|got it|sounds good)[!?.]*$"
)
DOMAIN_WORD = (
    r"(?i)\b(temperature|salinity|depth|pressure|oxygen|chlorophyll|ph"
    r"|argo|float|profile|cycle|deployment|wmo|measurement|observation|sensor"
    r"|ocean|sea|indian|pacific|atlantic|arabian|bengal|southern"
    r"|region|lat|lon|latitude|longitude|surface|deep|bgc"
    r"|data|show|find|analyze|compare|average|mean|trend|distribution)\b"
)
ANALYTICAL = (
    r"\b(average|mean|avg|sum|count|total|maximum|max|minimum|min)\b",
    r"\b(compare|comparison|versus|vs|between|difference)\b",
    r"\b(group|aggregate|distribution|range|trend|correlation)\b",
    r"\b(how many|how much|statistics|statistical|percentage|percent)\b",
    r"\b(greater than|less than|higher|lower|above|below|top|bottom)\b",
    r"\b(over time|temporal|monthly|yearly|seasonal)\b",
    r"\b(temperature|salinity|oxygen|chlorophyll|ph|pressure)\b.*(at|in|near|around|of)\b",
    r"\b(what is|show|tell me|give me).*(temperature|salinity|oxygen)\b",
    r"\b(indian ocean|pacific|atlantic|arabian sea|bay of bengal|southern ocean)\b",
)
# in order; every listed group must have a word in the text
INTENTS = (
    ("avg_by_depth", (("depth", "profile", "vertical"), ("average", "mean"))),
    ("regional_comparison", ((
        "region", "compare", "hemisphere", "north", "south", "indian ocean", "pacific", "atlantic", "arabian sea",
        "bay of bengal", "southern ocean", "temperature at", "salinity at", "salinity in", "temperature in"),)),
    ("depth_ranges", (("depth range", "surface", "deep", "zone"),)),
    ("float_summary", (("float", "summary", "overview"),)),
    ("temporal_trends", (("time", "temporal", "trend", "month", "year"),)),
    ("bgc_analysis", (("oxygen", "ph", "chlorophyll", "bgc", "biogeochemical"),)),
)
CUSTOM = "custom"
FORBIDDEN_SQL = ("drop", "delete", "truncate", "alter", "create", "insert", "update")
SHORT_CHAT_WORDS = 3
# ----------------------------------------------------------------------------------------------------------


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def question_label(text: Column) -> Column:
    """chat for greetings and for up to three words without a domain word, otherwise data."""
    clean = _stripped(text)
    words = F.when(clean == "", 0).otherwise(F.size(F.split(clean, r"\s+")))
    return (
        F.when(clean.rlike(GREETING), "chat").when(clean.rlike(DOMAIN_WORD), "data")
        .when(words <= SHORT_CHAT_WORDS, "chat").otherwise("data")
    )


def is_analytical(text: Column) -> Column:
    low = F.lower(text)
    return _any([low.rlike(pattern) for pattern in ANALYTICAL])


def _matches(low: Column, groups) -> Column:
    return reduce(lambda a, b: a & b, [_any([low.contains(word) for word in group]) for group in groups])


def question_intent(text: Column) -> Column:
    """First intent whose words occur anywhere in the text, also inside longer words."""
    low, chain = F.lower(text), F
    for name, groups in INTENTS:
        chain = chain.when(_matches(low, groups), name)
    return chain.otherwise(CUSTOM)


def sql_allowed(text: Column) -> Column:
    """Only statements that begin with select and contain none of the forbidden words, not even inside a name."""
    low = F.lower(text)
    return ~_any([low.contains(word) for word in FORBIDDEN_SQL]) & F.startswith(_stripped(low), F.lit("select"))
