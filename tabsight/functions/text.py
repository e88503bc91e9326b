"""Text expressions: word tokens, whitespace token counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["STOP_WORDS_TOP", "ENGLISH_STOP_WORDS", "word_tokens", "token_count",
           "WORD_SPLIT", "DATE_NAME_TOKENS"]

# --- fixed values (must equal the reference for equal results) -------------
# Stop words removed before counting the most frequent words.
STOP_WORDS_TOP = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "was", "one", "our", "out",
    "get", "has", "him", "his", "how", "its", "new", "now", "see", "too", "use", "with", "that",
    "this", "from", "they", "been", "have", "more", "will", "than", "then", "when", "your", "also",
)
# Spark ML's default English stop words, in Spark's own order (TF-IDF).
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its",
    "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom",
    "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but",
    "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to",
    "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few",
    "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now", "i'll",
    "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd", "we'd",
    "they'd", "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've", "we've",
    "you've", "they've", "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't",
    "don't", "doesn't", "didn't", "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't",
    "couldn't", "cannot", "could", "here's", "how's", "let's", "ought", "that's", "there's",
    "what's", "when's", "where's", "who's", "why's", "would",
)
# Column-name fragments that mark a date column candidate.
DATE_NAME_TOKENS = ("date", "time", "year", "month", "day", "period")
# ---------------------------------------------------------------------------

# Word characters are letters, digits and underscore in any script; splitting
# on everything else gives the same words as a Unicode-aware \b ... \b match
# (an accented letter next to ASCII letters glues them into one non-ASCII word).
WORD_SPLIT = r"[^\p{L}\p{N}_]+"


def word_tokens(text: Column, min_len: int = 3) -> Column:
    """Lower-cased ASCII-letter words of at least ``min_len`` characters."""
    parts = F.split(F.lower(text), WORD_SPLIT)
    pattern = "^[a-z]{%d,}$" % min_len
    return F.filter(parts, lambda w: w.rlike(pattern))


def token_count(text: Column) -> Column:
    """Number of whitespace-separated tokens (Python ``len(s.split())``)."""
    # maximal runs of non-whitespace = the non-empty pieces of a split on \s+
    return F.regexp_count(text, F.lit(r"\S+"))
