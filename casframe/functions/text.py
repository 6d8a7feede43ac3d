"""Text expressions: tokens, ratios, previews and printed forms."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from casframe.functions.hashing import col

# The words that the lexical embedding leaves out.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "he", "in",
    "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "will", "with",
)

MAX_TEXT_BYTES = 1 << 20
PRINTABLE_TEXT, PRINTABLE_PDF = 0.90, 0.40
SNIPPET = 160

#: White space as Unicode's White_Space property has it.
SPACE_CLASS = "\\t\\n\\x0B\\f\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"

#: Printable characters that Unicode has had since 14 or 15.0, and Java 17's classes lack.
_NEWER = (
    "61D 870-88E 898-8D2 C3C C5D CDD CF3 ECE 170D-1715 171F 180F 1AC1-1ACE 1B4C 1B7D-1B7E 1DFA 20C0 2C2F-2C5F "
    "2E53-2E5D 9FFD-9FFF A7C0-A7C1 A7D0-A7D1 A7D3 A7D5-A7D9 A7F2-A7F4 FBC2 FD40-FD4F FDCF FDFE-FDFF 10570-1057A "
    "1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 10780-10785 10787-107B0 "
    "107B2-107BA 10EFD-10EFF 10F70-10F89 11070-11075 110C2 1123F-11241 116B9 11740-11746 11AB0-11ABF 11B00-11B09 "
    "11F00-11F10 11F12-11F3A 11F3E-11F59 12F90-12FF2 1342F 13440-13455 16A70-16ABE 16AC0-16AC9 1AFF0-1AFF3 "
    "1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1CF00-1CF2D 1CF30-1CF46 1CF50-1CFC3 1D1E9-1D1EA 1D2C0-1D2D3 "
    "1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E08F 1E290-1E2AE 1E4D0-1E4F9 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE "
    "1E7F0-1E7FE 1F6DC-1F6DF 1F774-1F776 1F77B-1F7D9 1F7F0 1F979-1F9CC 1FA75-1FA7C 1FA87-1FA88 1FAA9-1FABD "
    "1FABF-1FAC5 1FACE-1FADB 1FAE0-1FAE8 1FAF0-1FAF8 2A6DE-2A6DF 2B735-2B739 31350-323AF "
)
_NEWER_CLASS = "".join("-".join(f"\\x{{{x}}}" for x in r.split("-")) for r in _NEWER.split())
_UNPRINTABLE = r"[^\p{L}\p{M}\p{N}\p{P}\p{S} \n\r\t" + _NEWER_CLASS + "]"
#: Characters that 15.1 added: Python has them and the SQL's engine does not.
_AFTER_15 = (range(0x31EF, 0x31F0), range(0x2FFC, 0x3000), range(0x2EBF0, 0x2EE5E))


def category(c: str) -> str:
    """The general category as of Unicode 15.0."""
    return "Cn" if any(ord(c) in r for r in _AFTER_15) else unicodedata.category(c)


def lower_each(text: Column | str) -> Column:
    """Lower case character by character, without the two rules that depend on context or lengthen the text."""
    return F.lower(F.translate(col(text), "İΣ", "iσ"))


def tokens(text: Column | str) -> Column:
    """Runs of letters and decimal digits, in lower case."""
    return F.regexp_extract_all(lower_each(text), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))


def content_tokens(text: Column | str) -> Column:
    stop = F.array(*(F.lit(w) for w in STOPWORDS))
    return F.filter(tokens(text), lambda t: ~F.array_contains(stop, t))


def printable_ratio(text: Column | str) -> Column:
    """Share of printable characters; null for an empty text."""
    t = col(text)
    return F.when(F.length(t) > 0, F.length(F.regexp_replace(t, _UNPRINTABLE, "")) / F.length(t))


def is_printable(text: Column | str, least: float = PRINTABLE_TEXT) -> Column:
    return F.coalesce(printable_ratio(text) >= least, F.lit(False))


def capped_utf8(data: Column, limit: int = MAX_TEXT_BYTES) -> Column:
    """The first limit bytes, less a character that the cut has split; whatever ends badly is cut back."""
    head = F.substring(data, 1, limit)
    tail = F.hex(F.substring(head, limit - 2, 3))
    # The bytes after the last complete character: a lead byte with too few to follow.
    split = (
        F.when(tail.rlike("(?:[CDEF].)$"), 1)
        .when(tail.rlike("(?:[EF].[89AB].)$"), 2)
        .when(tail.rlike("(?:F.[89AB].[89AB].)$"), 3)
        .otherwise(0)
    )
    return F.when(F.octet_length(data) > limit, F.substr(head, F.lit(1), F.lit(limit) - split)).otherwise(data)


def utf8_text(data: Column | str) -> Column:
    """The text of bytes that are printable UTF-8, else null."""
    head = capped_utf8(col(data))
    # A cast keeps the bytes as they are; validity is then tested on them.
    text = F.when(F.octet_length(head) > 0, F.try_validate_utf8(head.cast("string")))
    return F.when(is_printable(text), text)


def snippet(text: Column | str) -> Column:
    return F.substring(F.translate(col(text), "\n\r", "  "), 1, SNIPPET)


def message_lines(message: Column | str) -> Column:
    """A message's lines, whatever their ends; an end of the last line makes no further one, and nothing has no lines."""
    m = F.regexp_replace(F.regexp_replace(col(message), "\r\n?", "\n"), "\n\\z", "")
    return F.when(col(message) == "", F.array().cast("array<string>")).otherwise(F.split(m, "\n"))


def first_line(message: Column | str) -> Column:
    return F.coalesce(F.get(message_lines(message), F.lit(0)), F.lit(""))


def trimmed(text: Column | str) -> Column:
    return F.regexp_replace(col(text), f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\\z", "")


def normal_message(message: Column | str) -> Column:
    """The trimmed message, or null where it is not allowed: empty, or with a NUL."""
    m = trimmed(F.coalesce(col(message), F.lit("Snapshot")))
    return F.when((m != "") & ~F.contains(m, F.lit("\x00")), m)


def human_bytes(n: Column | str) -> Column:
    n = col(n)
    size = lambda power, unit: F.format_string("%.1f " + unit, F.bround(n / float(1024**power), 1))  # noqa: E731  a half goes to the even digit
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, size(1, "KB"))
        .when(n < 1024**3, size(2, "MB"))
        .when(n < 1024**4, size(3, "GB"))
        .otherwise(size(4, "TB"))
    )


def iso_timestamp(seconds: Column | str, nanos: Column | str) -> Column:
    """ISO 8601 in UTC, with as many digits of the fraction as it needs."""
    at, n = F.timestamp_seconds(col(seconds)), col(nanos)
    part = F.when(n == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.rtrim(F.lpad(n.cast("string"), 9, "0"), F.lit("0"))))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("Z"))


def printable_path(path: Column | str) -> Column:
    """One line for any path: backslashes, tabs and line ends are escaped."""
    p = F.replace(col(path), F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        p = F.replace(p, F.lit(raw), F.lit(shown))
    return p


def printable_snippet(text: Column | str) -> Column:
    """As printable_path, and any other control character as \\xHH."""
    shown = lambda c: F.when(F.regexp_like(c, F.lit(r"\p{Cc}")), F.concat(F.lit("\\x"), F.lpad(F.lower(F.hex(F.ascii(c).cast("long"))), 2, "0"))).otherwise(c)
    return F.array_join(F.transform(F.split(printable_path(text), ""), shown), "")


def abbreviated(id_: Column | str) -> Column:
    return F.left(col(id_), F.lit(12))


def restore_key(name: Column | str) -> Column:
    """Names with one key cannot live side by side where case is folded."""
    return F.lower(col(name))
