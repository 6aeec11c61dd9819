"""Words, tokens, n-grams and small string functions, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words, for Java and DuckDB patterns alike.
WS = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: Tokens of keyword search: runs of two or more word characters.
TOKEN = r"[\p{L}\p{N}_]{2,}"
# English stop words of keyword search (those that TOKEN can match).
STOP_WORDS = (
    "me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing an the and but if or "
    "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very can "
    "will just don should now cannot could ought would"
).split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words between white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda w: w != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{WS}", ""), f"{WS}$", "")


def tokens(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Lower-cased tokens without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(list(stop_words)))


def overlap_share(a: Column, b: Column) -> Column:
    """Share of set a's members in set b; 0 if a is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def windows(of: Column, size: int, overlap: int) -> Column:
    """Windows of `size` words every size - overlap words, joined by a blank, until the start passes the end."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    return F.transform(F.sequence(F.lit(0), F.size(of) - 1, F.lit(size - overlap)), lambda i: F.array_join(F.slice(of, i + 1, size), " "))


def chunk_words(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """The text itself if it has at most `size` words, else its windows."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    return let(words(text), lambda w: F.when(F.size(w) <= size, F.array(text)).otherwise(windows(w, size, overlap)))


def chunk_chars(text: Column, size: int) -> Column:
    """Pieces of `size` characters; the last may be shorter; none for empty texts."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text), F.lit(size)), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def rounded(number: Column, places: int) -> Column:
    """A double rounded as SQL engines do it, half away from zero on number * 10^places; Spark's own round goes by the shortest decimal that reads as
    the same double, which may lie on a half where the product doesn't."""
    return F.round(number * float(10**places), 0) / float(10**places)


def printed(number: Column, places: int) -> Column:
    """A double with so many decimals as C's printf shows it: the double's exact value decides, an exact half goes to the even digit. Java's formatter,
    which format_string uses, rounds halves up and goes by the shortest decimal."""
    return F.call_function("format_number", number, F.lit("0." + "0" * places))


def format_file_size(n: Column) -> Column:
    """Bytes as `x Unit`, base 1024, two decimals at most without trailing zeros; units end at GB."""

    def shown(power: int, unit: str) -> Column:
        digits = F.format_string("%.2f", F.round(n / float(1024**power), 2))
        return F.concat(F.regexp_replace(F.regexp_replace(digits, "0+$", ""), r"\.$", ""), F.lit(f" {unit}"))

    return F.when(n == 0, "0 Bytes").when(n < 1024, shown(0, "Bytes")).when(n < 1024**2, shown(1, "KB")).when(n < 1024**3, shown(2, "MB")).otherwise(shown(3, "GB"))


def html_text(html: Column) -> Column:
    """Text of a page: without comments, scripts, styles, navigation and footer; tags become blanks; five entities are undone; blanks collapse."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "nav", "footer"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, WS, " "))


#: Personal data: name and pattern, masked in this order.
PII = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), ("id", r"\b\d{15,18}\b"), ("phone", r"\+?\d{0,3}[ -]?\(?\d{3}\)?[ -]\d{3}-?\d{4}"))


def mask_pii(text: Column) -> Column:
    for name, pattern in PII:
        text = F.regexp_replace(text, pattern, f"[{name.upper()}]")
    return text
