"""Text expressions: tokens, counts, masks and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a token is two or more ideographs, Latin letters or digits.
TOKEN = "[一-龥A-Za-z0-9]{2,}"


def without_space(x: Column) -> Column:
    """x without any Unicode white space."""
    return F.regexp_replace(x, r"(?U)\s+", "")


def tokens(x: Column, most: int | None = None) -> Column:
    """Distinct tokens of x in lower case, in the order they come; at most so many, if a number is given."""
    t = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(TOKEN), F.lit(0)))
    return F.slice(t, 1, most) if most else t


def ngrams(x: Column, n: int) -> Column:
    """All runs of n characters of x without its white space, distinct, in order; none if it is shorter."""
    s = without_space(F.lower(F.coalesce(x, F.lit(""))))
    at = F.when(F.length(s) >= n, F.sequence(F.lit(1), F.length(s) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(s, i, F.lit(n))))


def times(x: Column, part: Column) -> Column:
    """How often part stands in x, overlaps not counted; 0 for an empty part or null."""
    n = (F.length(x) - F.length(F.replace(x, part, F.lit("")))) / F.length(part)
    return F.coalesce(F.when(F.length(part) > 0, n), F.lit(0)).cast("long")


def times_any(x: Column, parts: Column) -> Column:
    """Sum of times() over an array of parts."""
    return F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s + times(x, p))


def contains_any(x: Column, words: list[str] | tuple[str, ...]) -> Column:
    """Whether one of the words stands in x; case counts. False for null or no words."""
    out = F.lit(False)
    for w in words:
        out = out | x.contains(w)
    return F.coalesce(out, F.lit(False))


def first_rule(x: Column, rules: dict[str, list[str]], default: str) -> Column:
    """Name of the first rule with a word that stands in x."""
    out = F.lit(default)
    for name, words in reversed(list(rules.items())):
        out = F.when(contains_any(x, words), name).otherwise(out)
    return out


#: What is masked in texts and by what, and the parts of field names whose values are masked whole.
SECRETS = {
    r"(sk-)[A-Za-z0-9_-]{8,}([A-Za-z0-9_-]{4})": "$1******$2",
    r"(?i)(Bearer)\s+[A-Za-z0-9._~+/=-]{8,}": "$1 ******",
    r"(?i)(postgresql(?:\+\w+)?://[^:\s/@]+:)[^@\s]+(@)": "$1******$2",
}
SECRET_NAMES = ("api_key", "apikey", "authorization", "database_url", "passwd", "password", "pwd", "secret", "token")


def masked(x: Column) -> Column:
    """x with keys, bearer tokens and passwords in URLs replaced by asterisks."""
    for pattern, by in SECRETS.items():
        x = F.regexp_replace(x, pattern, by)
    return x


def masked_fields(x: Column) -> Column:
    """A map of strings with masked values: whole values under secret names, parts of others."""
    return F.transform_values(x, lambda k, v: F.when(contains_any(F.lower(k), SECRET_NAMES), F.lit("******")).otherwise(masked(v)))


def short_id(x: Column, prefix: str = "c_", most: int = 96) -> Column:
    """prefix and x, other characters than ASCII letters, digits, '_', ':' and '-' run together as '_'; if too long or empty, 16 digits of its SHA-1."""
    y = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z0-9_:-]+", "_"), F.lit("_"))
    short = F.concat(F.lit(prefix), y)
    return F.when((F.length(y) > 0) & (F.length(short) <= most), short).otherwise(F.concat(F.lit(prefix), F.substring(F.sha1(F.coalesce(x, F.lit(""))), 1, 16)))
