"""Text column expressions: folding, slugs, tokens, sentences, shingles, sets, entropy, JSON in prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and their base letters, position by position.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

WORD = r"[a-zà-ÿ0-9]+"
WIDE_WORD = r"[a-zà-öø-ÿœæ0-9'’-]+"
SENTENCE_BREAK = r"(?<=[.!?…])\s+"
PARAGRAPH_BREAK = r"\n\s*\n"
PUNCTUATION = ".,;:!?…()—«»\"'"


def fold(c: Column) -> Column:
    """Lower-case ASCII: marks dropped, other characters removed, trimmed."""
    return F.trim(F.lower(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), MARKED, PLAIN), r"[^\x00-\x7F]", "")))


def fold_sql(x: str) -> str:
    return f"trim(lower(regexp_replace(translate(coalesce({x}, ''), '{MARKED}', '{PLAIN}'), '[^\\x00-\\x7F]', '', 'g')))"


def slugify(c: Column) -> Column:
    """Folded, non-word characters dropped, spaces and underscores to single dashes."""
    kept = F.regexp_replace(fold(c), r"[^a-z0-9_\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[\s_-]+", "-"), r"^-+|-+$", "")


def slugify_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({fold_sql(x)}, '[^a-z0-9_\\s-]', '', 'g'), '[\\s_-]+', '-', 'g'), '^-+|-+$', '', 'g')"


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def wide_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WIDE_WORD), F.lit(0))


def word_count(c: Column) -> Column:
    return F.regexp_count(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD)).cast("bigint")


def sentences(c: Column) -> Column:
    """Cut after . ! ? … and white space; pieces of more than two characters."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), SENTENCE_BREAK), lambda x: F.trim(x)), lambda s: F.length(s) > 2)


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), PARAGRAPH_BREAK), lambda x: F.trim(x)), lambda p: F.length(p) > 40)


def windows(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by a space; none when there are fewer.

    The tokens are bound to a lambda variable: an expression used inside the
    inner lambda would be computed anew for every window.
    """
    runs = lambda t: F.when(
        F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
    ).otherwise(F.array().cast("array<string>"))
    return F.transform(F.array(tokens), runs)[0]


def hashed_windows(tokens: Column, n: int) -> Column:
    """Hashes of all runs of n tokens, straight from the array slices; none when there are fewer. Stable across runs."""
    runs = lambda t: F.when(
        F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.xxhash64(F.slice(t, i, n)))
    ).otherwise(F.array().cast("array<bigint>"))
    return F.transform(F.array(tokens), runs)[0]


def shingles(c: Column, n: int = 5) -> Column:
    """Set of hashed word windows."""
    return F.array_distinct(hashed_windows(words(c), n))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over united elements of two sets; null when both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a fixed phrase."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("bigint")


def total_occurrences(text: Column, phrases: list[str]) -> Column:
    out = occurrences(text, phrases[0])
    for p in phrases[1:]:
        out = out + occurrences(text, p)
    return out


def punctuation_entropy(text: Column) -> Column:
    """Shannon entropy (base 2) of the punctuation marks; 0 without any."""
    counts = F.array(*(occurrences(text, p) for p in PUNCTUATION))
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    part = lambda n: F.when(n > 0, (n / total) * F.log2(n / total)).otherwise(0.0)
    return F.when(total > 0, -F.aggregate(counts, F.lit(0.0), lambda a, x: a + part(x))).otherwise(F.lit(0.0))


def snippet(text: Column, needle: Column, before: int = 80, after: int = 120) -> Column:
    """Text around the first hit with ellipses where it is cut; null without a hit."""
    at = F.instr(F.lower(text), needle)
    start = F.greatest(at - before, F.lit(1))
    end = F.least(at + F.length(needle) + after - 1, F.length(text))
    return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, end - start + 1), F.when(end < F.length(text), "…").otherwise("")))


def json_texts(body: Column, keys: tuple[str, ...]) -> Column:
    """Distinct string values of some keys at any depth of a JSON text, escapes decoded; sources.json.collect_strings() has them with their places."""
    raw = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(rf'"(?:{"|".join(keys)})"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.array_distinct(F.transform(raw, lambda x: F.get_json_object(F.concat(F.lit('["'), x, F.lit('"]')), "$[0]")))


def expand_template(template: Column, place: dict[str, Column]) -> Column:
    """Fill __VILLE__ (any case), {ville}, {departement}, {region}, {code_postal}."""
    out = F.replace(F.regexp_replace(template, F.lit("(?i)__VILLE__"), place["ville"]), F.lit("{ville}"), place["ville"])
    for key in ("departement", "region", "code_postal"):
        out = F.replace(out, F.lit("{" + key + "}"), place[key])
    return out


def short_key(c: Column) -> Column:
    return F.substring(F.md5(F.coalesce(c, F.lit(""))), 1, 12)


def iso_day(c: Column) -> Column:
    """Day of an ISO timestamp text: its first ten characters."""
    return F.to_date(F.substring(c, 1, 10))
