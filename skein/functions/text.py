"""Native column expressions for text: JSON string literals, token counts,
sentence and word splitting, stop words.

Everything here is a ``Column -> Column`` function built from JVM-side
built-ins, so it stays inside whole-stage codegen. The regular expressions
avoid look-around and ``\\s`` so that Java (Spark) and RE2 (the DuckDB oracle)
match the same substrings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must stay as they are for results to match)
# ---------------------------------------------------------------------------

# ASCII whitespace as a class body (no \s: Java and RE2 disagree on \x0B).
WS = r" \t\n\r\f\x0B"

# One token = a run of ASCII word characters, or any other single
# non-whitespace character (punctuation, quotes, each non-ASCII letter).
TOKEN_PATTERN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_" + WS + r"]"

# One sentence = starts at a non-blank, non-terminal character, runs to the
# last non-blank character before a run of terminal punctuation (kept), or to
# the end of the text. Blank sentences cannot match.
SENTENCE_PATTERN = r"[^.!?" + WS + r"](?:[^.!?]*[^.!?" + WS + r"])?[.!?]*"

# Characters removed before counting word frequencies (letters-only text).
NON_LETTERS = r"[^a-zA-Z]"

# English stop words (fixed values, the classic NLTK English list, in its
# natural order). Entries with an apostrophe can never match a letters-only
# word; they are kept so the list reads as published.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it", "it's",
    "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "that'll", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do",
    "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because",
    "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below",
    "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t",
    "can", "will", "just", "don", "don't", "should", "should've", "now", "d", "ll",
    "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't",
    "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't",
    "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn",
    "mustn't", "needn", "needn't", "shan", "shan't", "shouldn", "shouldn't",
    "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
]

# Text a null-free CSV reader in the reference's stack turns into a missing
# value (fixed values, pandas' default NA strings).
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]


# ---------------------------------------------------------------------------
# Expressions
# ---------------------------------------------------------------------------

def json_string(c: Column) -> Column:
    """JSON literal of a string column: quoted and escaped, ``null`` for null.

    ``to_json(array(x))`` renders ``["..."]``; the brackets are cut off.
    """
    j = F.to_json(F.array(c))
    return j.substr(F.lit(2), F.length(j) - 2)


# control characters that JSON has a short escape for
_SHORT = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_CONTROLS = "[\\x00-\\x1F]"


def ascii_json_string(c: Column) -> Column:
    """JSON literal of a string column in printable ASCII alone: every other character is
    ``\\uxxxx`` (lower-case hex, a surrogate pair beyond the first plane), as
    the standard encoder writes it; ``null`` for null."""
    def plain(run: Column) -> Column:
        quoted = F.replace(F.replace(run, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        escaped = quoted
        for code in range(32):
            ch = chr(code)
            escaped = F.replace(escaped, F.lit(ch), F.lit(_SHORT.get(ch, f"\\u{code:04x}")))
        return F.when(run.rlike(_CONTROLS), escaped).otherwise(quoted)

    def wide(run: Column) -> Column:
        return F.regexp_replace(F.lower(F.hex(F.encode(run, "UTF-16BE"))), "(.{4})", r"\\u$1")

    runs = F.regexp_extract_all(c, F.lit(r"[\x00-\x7E]+|[^\x00-\x7E]+"), F.lit(0))
    text = F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^[\x00-\x7E]"), plain(r)).otherwise(wide(r))), "")
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def count_tokens(c: Column) -> Column:
    """Number of tokens of a raw text (``TOKEN_PATTERN`` matches), 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(TOKEN_PATTERN)), F.lit(0)).cast("long")


def string_tokens(c: Column) -> Column:
    """Tokens of a string as a JSON value: of its literal, escapes and quotes
    included (``null`` is one). Quotes end a token, so the counts of values add
    up to the count of a document that holds them."""
    return count_tokens(json_string(c))


def sentences(c: Column) -> Column:
    """Array of sentences of a text, in order."""
    return F.regexp_extract_all(c, F.lit(SENTENCE_PATTERN), 0)


# Words of the letters-only text: runs of ASCII letters (replacing every other
# character by a space and splitting on spaces gives exactly these).
LETTER_RUN = r"[a-zA-Z]+"

# Words of a lower-cased sentence: each whitespace-separated piece with its
# leading and trailing non-alphanumeric characters stripped (pieces without
# any alphanumeric character vanish). One match per piece.
SENTENCE_WORD = r"[a-z0-9](?:[^" + WS + r"]*[a-z0-9])?"


def letter_words(c: Column) -> Column:
    """Words of the letters-only form of a text (case kept)."""
    return F.regexp_extract_all(c, F.lit(LETTER_RUN), 0)


def sentence_words(c: Column) -> Column:
    """Lower-cased words of a sentence: whitespace split, outer punctuation stripped."""
    return F.regexp_extract_all(F.lower(c), F.lit(SENTENCE_WORD), 0)


def null_if_token(c: Column) -> Column:
    """Null for the missing-value strings of ``NULL_TOKENS``."""
    return F.when(c.isin(NULL_TOKENS), F.lit(None).cast("string")).otherwise(c)


def md5_int(*parts: Column, digits: int = 12) -> Column:
    """Non-negative integer from the first ``digits`` hex digits of md5 of the
    parts joined by ``|``. The same number in DuckDB is
    ``('0x' || substr(md5(...), 1, digits))::BIGINT``."""
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("long")
