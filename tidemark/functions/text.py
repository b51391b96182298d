"""Names, codes, slugs, addresses and escaping, as expressions on columns; a pandas UDF only where Spark has no built-in."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import LEADING_CODE, NAMESPACES, NO_CODE, SEQUENCE_LABEL, STOP_WORDS, TRAILING_BRACKET, TRAILING_CODE


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"\([^)]*\)", ""), r"[^a-z0-9]+", "")


def normal_code(code: Column) -> Column:
    """Upper case without separators; placeholders, blanks and single characters are no code."""
    plain = F.regexp_replace(F.upper(code), r"[^A-Z0-9]+", "")
    return F.when((F.length(plain) >= 2) & ~plain.isin("TBD", "TBA", "TBC", "NA", "NONE", "UNKNOWN"), plain)


def code_in_name(name: Column) -> Column:
    """A leading code such as `ME06:` or `OP-13`, or a bracket at the end that holds one."""
    lead = F.regexp_extract(name, LEADING_CODE, 1)
    tail = F.regexp_extract(name, TRAILING_BRACKET, 1)
    return normal_code(F.coalesce(F.nullif(lead, F.lit("")), F.nullif(tail, F.lit(""))))


def without_codes(name: Column) -> Column:
    """A name without a leading code and its separator, and without a code in brackets at its end; one that is only a code stays."""
    lead = F.regexp_extract(name, LEADING_CODE, 1)
    rest = F.when(lead == "", name).otherwise(F.regexp_replace(F.substr(name, F.length(lead) + 1), r"^\s*[:\-–—]?\s*", ""))
    plain = F.trim(F.regexp_replace(rest, TRAILING_BRACKET, ""))
    return F.when(plain == "", name).otherwise(plain)


def words(name: Column) -> Column:
    """Lower-case words without brackets and without the label of a sequence."""
    plain = F.regexp_replace(F.regexp_replace(name, r"\([^)]*\)", " "), SEQUENCE_LABEL, " ")
    return F.array_distinct(F.filter(F.split(F.lower(plain), r"[^a-z0-9]+"), lambda w: w != ""))


def tokens(name: Column) -> Column:
    return F.filter(words(name), lambda w: ~w.isin(*STOP_WORDS))


def numbers(name: Column) -> Column:
    return F.filter(words(name), lambda w: w.rlike(r"^\d+$"))


def sequence_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(F.regexp_replace(name, r"\([^)]*\)", " "), SEQUENCE_LABEL, 1), F.lit(""))


def without_trailing_code(name: Column) -> Column:
    return F.regexp_replace(name, TRAILING_CODE, "")


def is_placeholder(name: Column) -> Column:
    said = F.trim(F.coalesce(name, F.lit("")))
    return said.rlike(r"(?i)^(?:[—–\-?]*|n/?a)$|^(?:tbd|tba|unknown|untitled|unannounced|unnamed|to be (?:announced|determined))\b") | said.rlike("^[\"'“‘][A-Za-z0-9]{1,4}[\"'”’]$")


def clean_name(name: Column) -> Column:
    """Underscores to blanks, quotes around the whole dropped, white space folded."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(name, "_", " "), r"\s+", " "))
    return F.regexp_replace(plain, r"^[\"“'](.*)[\"”']$", "$1")


def folded_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_code(cell: Column) -> Column:
    """A code cell: leading dashes dropped, upper case; placeholders and what is longer than 16 characters are no code."""
    said = F.regexp_replace(F.trim(cell), r"^[—–-]+\s*", "")
    return F.when((said != "") & ~said.rlike(NO_CODE) & (F.length(said) <= 16), F.upper(said))


def article_id(href: Column) -> Column:
    """The title of a wiki link, decoded; pages of other namespaces and edit links are no articles."""
    title = F.nullif(F.regexp_extract(F.trim(href), r"^(?:https?://[^/]+)?/wiki/([^?#]+)$", 1), F.lit(""))
    plain = F.coalesce(F.try_url_decode(F.replace(title, F.lit("+"), F.lit("%2B"))), title)
    return F.when(~plain.rlike(r"(?i)^(?:" + "|".join(NAMESPACES) + r")\s*:"), plain)


def cleaned_naming(name: Column, code: Column) -> tuple[Column, Column]:
    """Name and code of a candidate: syntax of sources removed, a leading code dropped from the name where the code column says the same, or moved there if that is empty."""
    plain = folded_space(F.regexp_replace(F.regexp_replace(F.trim(name), "_", " "), "^[\"'‘’“”«»]+|[\"'‘’“”«»]+$", ""))
    own = F.nullif(F.trim(code), F.lit(""))
    lead = F.nullif(F.regexp_extract(plain, LEADING_CODE, 1), F.lit(""))
    rest = F.nullif(F.trim(F.regexp_replace(F.substr(plain, F.length(lead) + 1), r"^\s*[:\-–—]\s*", "")), F.lit(""))
    shorter = lead.isNotNull() & rest.isNotNull() & (own.isNull() | (normal_code(lead) == normal_code(own)))
    found = F.when(plain == "", F.trim(name)).when(F.coalesce(shorter, F.lit(False)), rest).otherwise(plain)
    return found, F.when(plain == "", code).when(F.coalesce(shorter & own.isNull(), F.lit(False)), lead).otherwise(own)


def slug(text: Column) -> Column:
    """Kebab case of ASCII text; accents need `folded` first."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks. Spark has no such function."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def synthetic_code(name: Column) -> Column:
    """A stable code from a name: 24 characters, then a hash of the name."""
    stem = F.regexp_replace(F.regexp_replace(F.upper(name), r"[^A-Z0-9]+", "-"), r"^-+|-+$", "")
    return F.concat(F.lit("SYN-"), F.substring(stem, 1, 24), F.lit("-"), F.upper(F.substring(F.sha2(name, 256), 1, 6)))


def host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1), F.lit("")))


def last_segment(url: Column) -> Column:
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    return F.nullif(F.regexp_replace(F.regexp_extract(path, r"([^/]+)/*$", 1), r"\.[A-Za-z0-9]+$", ""), F.lit(""))


def is_webhook(url: Column) -> Column:
    """https, one of the hosts, and the path of a webhook."""
    return F.coalesce(url.rlike(r"^https://(?:www\.|ptb\.|canary\.)?(?:discord|discordapp)\.com/api/webhooks/\d+/[\w-]+$"), F.lit(False))


def ics_escape(text: Column) -> Column:
    out = text
    for plain, escaped in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def color_index(text: Column, palette: int) -> Column:
    """Rolling hash, h * 31 + code, unsigned in 32 bits, modulo the palette."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF))) % palette


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
