"""Column expressions over text: cleaning, tokenising, hashing, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that content_words drops.
STOP_SCORES = ["a", "an", "the", "and", "or", "but", "if", "then", "than", "that", "this", "these", "those", "is", "are", "was", "were", "be", "been", "being", "of", "in", "on", "at", "to", "from", "by", "for", "with", "without", "into", "over", "under", "as", "it", "its"]
#: Words that note_words drops.
STOP_NOTES = ["the", "a", "an", "of", "to", "in", "and", "or", "is", "are", "was", "were", "be", "been", "being", "for", "on", "at", "by", "with", "that", "this", "it", "its", "as", "from", "not", "no", "than", "then", "so", "which", "when", "what", "where", "how", "why", "can", "may", "must", "into", "out", "over", "under", "also", "both", "each", "other", "more", "most", "such", "only", "same", "they", "them", "their", "there", "these", "those", "your", "with", "within", "while"]
#: Line separators of text pages, and lines that are page furniture.
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
PAGE_NUMBER_LINE = r"(?i)^\s*(page\s+)?\d{1,4}\s*$"
HEADER_LINE = r"(?i)^\s*TM\s+[\d-]+[A-Z]?\s*$"
#: Signs of instructions inside retrieved text, in the order they are reported.
GUARD_PATTERNS = (
    ("override", r"(?is)\b(ignore|disregard|forget)\b.{0,40}\b(instruction|prompt|rule|previous|above)s?\b"),
    ("persona", r"(?i)\byou are (now|no longer)\b|\bact as\b|\bpretend to be\b"),
    ("exfil", r"(?is)\b(reveal|print|repeat|show)\b.{0,40}\b(system prompt|instructions|api key|secret|password)\b"),
    ("directive", r"(?i)\b(you must|from now on|new instructions?:)\b"),
    ("tool-abuse", r"(?i)\b(call|invoke|use) the \w+ tool\b"),
)
#: White space of any script.
SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
FENCE_TAG = r"(?i)<{1,2}/?(data|untrusted)[^>]*>"
REFUSAL = "INSUFFICIENT EVIDENCE"


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def clean_page(raw: Column) -> Column:
    """Lines with single blanks, without page numbers and header lines; null stays null."""
    lines = F.transform(F.split(raw, LINE_BREAKS), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(PAGE_NUMBER_LINE) & ~x.rlike(HEADER_LINE)), "\n")


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def query_tokens(text: Column) -> Column:
    """Tokens of a query, in their case: the lexical index lower-cases on its side."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))


def word_tokens(text: Column, stopwords: list[str] | None = None) -> Column:
    """Words of two or more letters, figures or underscores in any script, lower case."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~F.array_contains(_array(stopwords), w)) if stopwords else words


def ascii_or(text: Column, plain: Column, full: Column) -> Column:
    """``plain`` for a text of ASCII characters alone, for which a short pattern does; otherwise ``full``."""
    return F.when(F.length(text) == F.octet_length(text), plain).otherwise(full)


def corpus_words(text: Column) -> Column:
    """``word_tokens``, at less cost."""
    return ascii_or(text, F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_][a-z0-9_]+"), F.lit(0)), word_tokens(text))


def content_words(text: Column) -> Column:
    """Distinct tokens over two characters that are no stop words."""
    return F.array_distinct(F.filter(ascii_tokens(text), lambda w: (F.length(w) > 2) & ~F.array_contains(_array(STOP_SCORES), w)))


def note_words(text: Column) -> Column:
    """Tokens over three characters that are no stop words, repeated ones kept."""
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), " +")
    return F.filter(words, lambda w: (F.length(w) > 3) & ~F.array_contains(_array(STOP_NOTES), w))


def md5_bucket(token: Column, dim: int) -> Column:
    """Bucket of the hashing embedder's native variant."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % dim).cast("int")


def guard_flags(text: Column) -> Column:
    """Names of the patterns found, in fixed order; null text gives the empty array."""
    found = F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in GUARD_PATTERNS])
    return F.filter(found, lambda x: x.isNotNull())


def fence(text: Column) -> Column:
    """Untrusted text between tags of its own, tags inside it defused."""
    return F.concat(F.lit("<untrusted-data>\n"), F.regexp_replace(text, FENCE_TAG, "[tag removed]"), F.lit("\n</untrusted-data>"))


def is_refusal(text: Column) -> Column:
    return F.coalesce(F.upper(text).contains(REFUSAL), F.lit(False))


def percent_score(reply: Column) -> Column:
    """First whole number of a reply, held to 0-100, as a share; 0 if there is none."""
    n = F.regexp_extract(reply, r"-?\d+", 0).try_cast("bigint")
    return F.coalesce(F.least(F.greatest(n, F.lit(0)), F.lit(100)) / 100.0, F.lit(0.0))


def verdict(reply: Column, candidate: Column | None = None) -> Column:
    """CORRECT, INCOMPLETE or WRONG, whichever of them stands first in this order; WRONG without any or without an answer."""
    up = F.upper(reply)
    out = F.when(up.rlike(r"\bCORRECT\b"), "CORRECT").when(up.rlike(r"\bINCOMPLETE\b"), "INCOMPLETE").otherwise("WRONG")
    return out if candidate is None else F.when(F.coalesce(F.trim(candidate), F.lit("")) == "", "WRONG").otherwise(out)


def verdict_loss(label: Column) -> Column:
    return F.when(label == "CORRECT", 0.0).otherwise(1.0)


def json_object(text: Column) -> Column:
    """The text from the first to the last brace if it parses as an object, else null."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), body)


def citations(text: Column) -> Column:
    """Numbers in square brackets, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))


def citations_valid(text: Column, n: Column) -> Column:
    """Whether every cited number names one of ``n`` excerpts; true without citations and for null."""
    return F.coalesce(F.forall(citations(text), lambda c: c.between(1, n)), F.lit(True))


def cited_answer(answer: Column, position: Column) -> Column:
    """The answer with its citation before the full stop."""
    return F.concat(F.regexp_replace(strip(answer), r"\.\z", ""), F.lit(" ["), position.cast("string"), F.lit("]."))


def listed_questions(text: Column) -> Column:
    """Questions of twenty or more characters, one a line, without numbers and bullets."""
    lines = F.transform(F.split(text, LINE_BREAKS), lambda x: F.trim(F.regexp_replace(x, r"^\s*(\d+[.)]|[-*•])\s*", "")))
    return F.filter(lines, lambda q: (F.length(q) >= 20) & q.endswith("?"))
