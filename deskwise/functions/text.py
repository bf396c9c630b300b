"""Text cleaning and text predicates as plain Column expressions.

Whitespace and word classes have the Unicode meaning a Python user expects, although Java
defaults to ASCII: ``(?U)`` widens ``\\s``, and the separators U+001C to U+001F are added to it.
"""

from __future__ import annotations

import html
import json
from collections.abc import Sequence
from functools import reduce
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskwise.functions import lexicon as lx
from deskwise.functions.columns import col, let

SPACE = r"\s\x1C-\x1F"
# Every character that counts as whitespace.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WORD = r"\p{L}\p{N}_"

URL = {
    "strict": rf"(?U)https?://[^{SPACE}]+|www\.[^{SPACE}]+",
    "runtime": rf"(?U)https?://[^{SPACE}]+",
    "cluster": rf"(?U)http[^{SPACE}]+|www[^{SPACE}]+",
}
MENTION = rf"@[{WORD}]+"
SIGNATURE = {
    "strict": (rf"(?U)[{SPACE}]*\^[A-Za-z]{{1,4}}[{SPACE}]*\z", ""),
    "runtime": (rf"\^[A-Z]{{1,3}}(?![{WORD}])", " "),
}
TOKEN = rf"[{WORD}]{{2,}}"


def any_of(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def digest(*columns: Column | str) -> Column:
    """SHA-256 of one or more texts: stands for long texts where only equality matters.

    Grouping by it moves 64 characters per text instead of the text. A null text gives null.
    """
    parts = [col(c).cast("string") for c in columns]
    return F.sha2(parts[0] if len(parts) == 1 else F.concat_ws("\0", *parts), 256)


NAMED = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
LEGACY = sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True)  # valid without a semicolon
DECIMAL, HEXADECIMAL, NAME = "^#([0-9]+);?", "^#[xX]([0-9a-fA-F]+);?", "^([A-Za-z][A-Za-z0-9]{0,31});"
PREFIX = f"^({'|'.join(LEGACY)})"
AMPERSAND = "&(?=#[0-9]|#[xX][0-9a-fA-F]|[A-Za-z])"  # what follows any other begins no entity
C1 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def _character(digits: Column, base: int) -> Column:
    """The character a numeric reference stands for, by the rules of HTML5."""
    short = F.ltrim(digits, F.lit("0"))
    number = F.conv(F.when(F.length(short).between(1, 7), short).otherwise("0"), base, 10).cast("bigint")

    def char(n: Column) -> Column:
        bad = (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        none = n.between(1, 8) | n.between(0xE, 0x1F) | n.isin(0xB, 0x7F) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
        code = F.unhex(F.lpad(F.hex(F.when(~bad, n).otherwise(0)), 8, "0"))
        return (
            F.when(bad, "\uFFFD").when(n.between(0x80, 0x9F), F.substr(F.lit(C1), (n - 0x7F).cast("int"), F.lit(1)))
            .when(none, "").otherwise(F.decode(code, "UTF-32"))
        )

    return let(number, char)


def _after_ampersand(p: Column, named: Column) -> Column:
    """The text behind an ampersand, its entity decoded, or the ampersand put back."""
    value = F.try_element_at(named, F.nullif(F.regexp_extract(p, NAME, 1), F.lit("")))
    legacy = F.try_element_at(named, F.nullif(F.regexp_extract(p, PREFIX, 1), F.lit("")))
    return (
        F.when(p.rlike(DECIMAL), F.concat(_character(F.regexp_extract(p, DECIMAL, 1), 10), F.regexp_replace(p, DECIMAL, "")))
        .when(p.rlike(HEXADECIMAL), F.concat(_character(F.regexp_extract(p, HEXADECIMAL, 1), 16), F.regexp_replace(p, HEXADECIMAL, "")))
        .when(value.isNotNull(), F.concat(value, F.regexp_replace(p, NAME, "")))
        .when(legacy.isNotNull(), F.concat(legacy, F.regexp_replace(p, PREFIX, "")))
        .otherwise(F.concat(F.lit("&"), p))
    )


def decode_entities(c: Column | str) -> Column:
    """Decode every HTML5 entity, named or numeric, inside the JVM (one pass: ``&amp;lt;`` gives ``&lt;``).

    Texts full of bare ampersands are not taken apart at them.
    """
    text = col(c)
    named = F.from_json(F.lit(json.dumps(NAMED)), "map<string, string>")  # folded to one constant
    parts = F.split(text, AMPERSAND, -1)
    rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: _after_ampersand(p, named))
    return F.when(text.contains("&"), F.concat(parts[0], F.array_join(rest, ""))).otherwise(text)


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def decode_entities_exact(c: Column | str) -> Column:
    """Decode every HTML5 entity; costs an Arrow trip to a Python worker."""
    return _unescape(col(c))


def strip_urls(c: Column | str, profile: str = "strict") -> Column:
    return F.regexp_replace(col(c), URL[profile], " ")


def strip_mentions(c: Column | str) -> Column:
    return F.regexp_replace(col(c), MENTION, " ")


def strip_signature(c: Column | str, profile: str = "strict") -> Column:
    pattern, by = SIGNATURE[profile]
    return F.regexp_replace(col(c), pattern, by)


def drop_literal_escapes(c: Column | str) -> Column:
    """A backslash followed by ``n`` or ``t`` (two characters, not a control) becomes a space."""
    space = F.lit(" ")
    return F.replace(F.replace(col(c), F.lit("\\n"), space), F.lit("\\t"), space)


def squeeze_space(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), rf"(?U)[{SPACE}]+", " "))


def strip(c: Column | str) -> Column:
    """Python's ``str.strip``; Spark's ``trim`` only removes the space character."""
    return F.btrim(col(c), F.lit(SPACES))


def clean_text(c: Column | str, profile: str = "strict", exact_entities: bool = False) -> Column:
    """Null becomes the empty string; profiles differ in URL and signature rules."""
    decode = decode_entities_exact if exact_entities else decode_entities
    text = decode(F.coalesce(col(c), F.lit("")))
    text = strip_mentions(strip_urls(text, profile))
    return squeeze_space(drop_literal_escapes(strip_signature(text, profile)))


def clean_for_clustering(c: Column | str) -> Column:
    return squeeze_space(strip_urls(F.lower(col(c)), "cluster"))


def is_acknowledgement(c: Column | str, phrases: Sequence[str] = lx.ACKNOWLEDGEMENTS) -> Column:
    bare = F.regexp_replace(strip(F.lower(col(c))), rf"(?U)[^{WORD}{SPACE}]", "")
    return bare.isin(list(phrases))


def contains_any(c: Column | str, terms: Sequence[str], whole_word: bool = False) -> Column:
    """True where the lower-cased text holds any term, as a substring unless ``whole_word``."""
    text = F.lower(col(c))
    if whole_word:
        body = "|".join(rf"\Q{t}\E" for t in terms)
        return F.regexp_like(text, F.lit(rf"(?<![{WORD}])(?:{body})(?![{WORD}])"))
    return let(text, lambda low: any_of([low.contains(t) for t in terms]))


def contains_any_in(c: Column | str, terms: Column | str) -> Column:
    """As :func:`contains_any` with the term list in an array column."""
    return let(F.lower(col(c)), lambda low: F.exists(col(terms), lambda t: low.contains(t)))


def straight_quotes(c: Column | str) -> Column:
    """Curly apostrophes to ASCII, for matching phrases such as ``can't log in``."""
    return F.translate(col(c), "‘’", "''")


def tokens(c: Column | str, stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased words of two or more characters, in text order."""
    words = F.regexp_extract_all(F.lower(col(c)), F.lit(TOKEN), F.lit(0))
    return F.filter(words, lambda t: ~t.isin(list(stop_words))) if stop_words else words


def with_bigrams(words: Column) -> Column:
    """Unigrams followed by space-joined neighbours."""
    heads = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    tails = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(heads, tails, lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def language_share(c: Column | str, lang: str = "en") -> Column:
    """Share of function words that belong to ``lang`` among those of all known languages.

    A word shared by several languages counts for each of them; a text without any function
    word scores 0, like a failed detection.
    """
    words = F.regexp_extract_all(F.lower(col(c)), F.lit(rf"[{WORD}]+"), F.lit(0))

    def hits_in(ws: Column, listed: Sequence[str]) -> Column:
        return F.size(F.filter(ws, lambda w: w.isin(list(listed))))

    def share(ws: Column) -> Column:
        hits = {code: hits_in(ws, listed) for code, listed in lx.FUNCTION_WORDS.items()}
        total = reduce(lambda a, b: a + b, hits.values())
        return F.try_divide(hits[lang].cast("double"), total.cast("double"))

    return F.coalesce(let(words, share), F.lit(0.0))


def na_to_null(c: Column | str, na_values: Sequence[str] = lx.NA_TOKENS) -> Column:
    return F.when(~col(c).isin(list(na_values)), col(c))


def to_number(c: Column | str) -> Column:
    """Numeric coercion: what does not parse becomes null."""
    return col(c).try_cast("double")
