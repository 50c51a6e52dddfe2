"""Schemas of the page data model and the fixed values the semantics depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Schemas --------------------------------------------------------------------------

# S1: JSON message on the page stream.
STREAM_MESSAGE_DDL = "url string, content string, timestamp timestamp"

# S2: a page as it enters keyword extraction (all strings); operators also take a key.
PAGE_FIELDS = ["url", "title", "content", "category", "author", "publishedAt"]

# S7: search hit projection (no content).
SEARCH_HIT_FIELDS = ["url", "title", "category", "author", "publishedAt", "keywords"]

# S4: the stored collection's fixed part; other fields are added as they arrive.
COLLECTION = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("publishedAt", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("category", T.StringType()),   # partition column, last
])

# --- Fixed values (must equal the reference's for the same results) -----------------

# Stop words, matched after lower-casing ("but" appears twice in the source list).
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "about",
    "as", "like", "through", "over", "before", "between", "after", "since", "without", "under",
    "within", "along", "following", "across", "behind", "beyond", "plus", "except", "but", "up",
    "down", "from", "into", "out", "off", "above", "below", "near", "far", "this", "that", "these",
    "those", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does",
    "did", "will", "would", "shall", "should", "may", "might", "must", "can", "could",
)

# Part-of-speech tags whose tokens can become keywords: nouns, adjectives, verbs.
RELEVANT_TAGS = (
    "NN", "NNS", "NNP", "NNPS",
    "JJ", "JJR", "JJS",
    "VB", "VBD", "VBG", "VBN", "VBP", "VBZ",
)

# Built-in ad categories and their keywords.
DEFAULT_CATEGORIES = {
    "technology": ("computer", "software", "hardware", "digital", "tech"),
    "finance": ("money", "bank", "investment", "stock", "finance"),
    "health": ("medical", "health", "fitness", "wellness", "diet"),
    "travel": ("travel", "vacation", "tourism", "hotel", "flight"),
}
# Tie-break order of the categories: the iteration order of the reference's hash map
# (ties between equal similarities go to the first category in this order).
DEFAULT_CATEGORY_ORDER = ("health", "technology", "travel", "finance")

# Names of the labelled-news classes, by label integer 0..3.
NEWS_LABELS = ("World", "Sports", "Business", "Sci/Tech")

# Word2Vec settings of the reference model.
W2V_MIN_COUNT = 5
W2V_ITERATIONS = 5
W2V_VECTOR_SIZE = 100
W2V_SEED = 42
W2V_WINDOW = 5

# Keywords kept per page, and per category in the per-category report.
KEYWORDS_PER_PAGE = 10
KEYWORDS_PER_CATEGORY = 5

UNKNOWN_CATEGORY = "unknown"
