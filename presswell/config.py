"""Default parameters. Every operator takes them as arguments; these are the defaults."""

from __future__ import annotations

MIN_CONTENT_CHARS = 50
PRE_EVENT_DAYS = 30
ANOMALY_WINDOW = 8
NEAR_DUPLICATE_COSINE = 0.85
MAX_DAY_TERMS = 2000
ENTITY_MAX_CHARS = 255
PIPELINE_VERSION = "0.1.0"

# Patterns of site furniture that is taken out of texts.
BOILERPLATE = [
    r"share this article.*",
    r"follow us on (facebook|twitter|instagram|whatsapp).*",
    r"click here to (read more|subscribe|download).*",
    r"also read:.*",
    r"related (articles?|news):.*",
    r"(read|see) more:.*",
    r"advertisement\s*",
    r"^\s*\(with inputs from.*\)\s*$",
]

# Sequences left by UTF-8 read as Windows-1252, and what they stand for.
ENCODING_REPAIRS = {"â€™": "’", "â€œ": "“", "â€\x9d": "”", "â€“": "–", "Â ": " "}

# Columns of the weekly panel and the topic names counted in each.
TOPIC_GROUPS = {
    "fuel_topic_frequency": ["Fuel & Oil Prices (CPC)", "Fuel Quota & QR System"],
    "iran_war_topic_frequency": ["Iran War & Geopolitics (Trump/Hormuz)"],
    "electricity_topic_frequency": ["Electricity Tariffs & CEB"],
    "corruption_topic_frequency": ["Arrests, Bribery & Corruption (CIABOC)"],
    "healthcare_strike_topic_frequency": ["Healthcare Worker Strikes (GMOA)"],
    "consumer_prices_topic_frequency": ["Consumer Prices & Food (Rice/CAA)"],
    "disaster_recovery_topic_frequency": ["General Sri Lanka News (Cyclone Ditwah relief, Rupee, Tourism)"],
}

# Columns of the weekly panel and the keyword substring counted in each.
KEYWORD_GROUPS = {
    "fuel_keyword_frequency": "fuel",
    "shortage_keyword_frequency": "shortage",
    "protest_keyword_frequency": "protest",
    "crisis_keyword_frequency": "crisis",
}

# Columns of the weekly panel and the entity type counted in each.
ENTITY_GROUPS = {
    "person_entity_frequency": "PERSON",
    "organization_entity_frequency": "ORGANIZATION",
    "location_entity_frequency": "LOCATION",
    "event_entity_frequency": "EVENT",
    "money_entity_frequency": "MONEY",
}

# Entity labels of a recogniser and the types they are kept as.
ENTITY_TYPES = {"PERSON": "PERSON", "ORG": "ORGANIZATION", "GPE": "LOCATION", "LOC": "LOCATION", "EVENT": "EVENT", "MONEY": "MONEY"}

# Sentiment labels of a scorer.
SENTIMENT_LABELS = {"LABEL_0": "negative", "LABEL_1": "neutral", "LABEL_2": "positive"}

# Events known from the start (name, type, first and last day).
EVENT_SEED = [
    ("2026 Sri Lanka Fuel Crisis (Iran War Oil Shock)", "Economic", "2026-02-28", None),
    ("Cyclone Ditwah", "Natural Disaster", "2025-11-28", "2025-12-15"),
]

# How labels of weeks are shown.
LABEL_COLOURS = {1: "green", 0: "gray"}

# Metrics of the anomaly score.
ANOMALY_METRICS = ["article_count", "negative_sentiment_ratio", "fuel_topic_frequency", "iran_war_topic_frequency", "disaster_recovery_topic_frequency"]

# Features of the weekly classifiers.
FEATURES = [
    "article_count", "negative_sentiment_ratio", "positive_sentiment_ratio", "average_sentiment", "fuel_topic_frequency",
    "iran_war_topic_frequency", "disaster_recovery_topic_frequency", "article_count_change", "sentiment_change",
    "topic_growth_rate", "keyword_growth_rate", "entity_growth_rate", "ma_4week", "ma_8week", "anomaly_score",
]

#: Words left out of keywords and of the texts' term weights; a parameter.
STOPWORDS = (
    "the of to in and a for that was is on by with as at from it had has were are be been not but which who this they "
    "their after before would will may said more than no its an or all there when about over since until under while"
).split()

#: A small lexicon for the default sentiment backend; a parameter.
POSITIVE = ("approved", "completed", "expanded", "great", "improved", "repaired", "reopened", "restored", "success", "supplied", "upgraded", "welcomed")
NEGATIVE = ("abandoned", "blocked", "cancelled", "crisis", "damaged", "delayed", "halted", "missing", "postponed", "rejected", "shortage", "suspended", "unpaid")
