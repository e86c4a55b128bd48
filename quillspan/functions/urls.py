"""URL column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File endings that are no pages.
ASSET = r"(?i)\.(jpe?g|png|gif|svg|webp|ico|css|js|pdf|zip|mp4|mp3|woff2?|ttf|xml|json)(\?|$)"
LANGUAGES = ("fr", "en", "es", "de", "it", "pt", "nl")
# Names of the languages.
LANGUAGE_NAMES = {"fr": "français", "en": "anglais", "es": "espagnol", "de": "allemand", "it": "italien", "pt": "portugais", "nl": "néerlandais"}


def host(c: Column) -> Column:
    """Lower-case host without scheme, www., path, query or port."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]*)", 1), r"^www\.", "")


def host_sql(x: str) -> str:
    return f"regexp_replace(regexp_extract(lower(trim(coalesce({x}, ''))), '^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]*)', 1), '^www\\.', '')"


def path(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def clean(c: Column) -> Column:
    """Without fragment and final slashes."""
    return F.regexp_replace(F.regexp_replace(c, r"#.*$", ""), r"/+$", "")


def join(base: Column, href: Column) -> Column:
    """Absolute form of a link on a page: absolute, scheme-relative, root-relative, query-only or relative to the folder."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    bare = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(path(base).contains("/"), F.regexp_replace(bare, r"[^/]*$", "")).otherwise(F.concat(origin, F.lit("/")))
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(bare, href))
        .otherwise(F.concat(folder, href))
    )


def join_sql(base: str, href: str) -> str:
    scheme = "[a-zA-Z][a-zA-Z0-9+.-]*:"
    bare = f"regexp_replace({base}, '[?#].*$', '')"
    origin = f"regexp_extract({base}, '^({scheme}//[^/?#]*)', 1)"
    path_ = f"regexp_extract({base}, '^{scheme}//[^/?#]*([^?#]*)', 1)"
    return (
        f"CASE WHEN regexp_matches({href}, '^{scheme}') THEN {href} WHEN starts_with({href}, '//') THEN regexp_extract({base}, '^({scheme})', 1) || {href} WHEN starts_with({href}, '/') THEN {origin} || {href} "
        f"WHEN starts_with({href}, '?') THEN {bare} || {href} ELSE CASE WHEN contains({path_}, '/') THEN regexp_replace({bare}, '[^/]*$', '') ELSE {origin} || '/' END || {href} END"
    )


def clean_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '#.*$', ''), '/+$', '')"


def same_site(a: Column, b: Column) -> Column:
    return host(a) == host(b)


def domain_matches(domain: Column, url: Column) -> Column:
    """The URL's host is the domain or below it."""
    h, d = host(url), host(domain)
    return (d != "") & ((h == d) | h.endswith(F.concat(F.lit("."), d)))


def slug(c: Column) -> Column:
    """Last path segment without a page ending."""
    return F.regexp_replace(F.element_at(F.split(clean(F.regexp_replace(c, r"\?.*$", "")), "/"), -1), r"\.(html?|php|aspx)$", "")


def slug_sql(x: str) -> str:
    return f"regexp_replace(list_last(string_split({clean_sql(f'regexp_replace({x}, chr(92) || chr(63) || chr(46) || chr(42) || chr(36), chr(0))')}, '/')), '\\.(html?|php|aspx)$', '')"


def service_base(slug_: Column, city_slug: Column) -> Column:
    """Slug without the city's slug, dashes squeezed; empty when the city is not in it."""
    rest = F.regexp_replace(F.regexp_replace(F.replace(slug_, city_slug, F.lit("")), r"-+", "-"), r"^-|-$", "")
    return F.when((city_slug != "") & slug_.contains(city_slug), rest).otherwise(F.lit(""))


def path_language(c: Column, default: str = "") -> Column:
    """Known language code that is the first path segment."""
    code = F.regexp_extract(path(c), r"^/([a-z]{2})(?:/|$)", 1)
    return F.when(code.isin(*LANGUAGES), code).otherwise(F.lit(default))


def language_code(c: Column, default: str = "fr") -> Column:
    """Known base language of a code such as pt-BR; the default otherwise."""
    base = F.element_at(F.split(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[-_]"), 1)
    return F.when(base.isin(*LANGUAGES), base).otherwise(F.lit(default))


def language_name(c: Column) -> Column:
    """Name of a language code, by its base language; that of the default for unknown ones."""
    names = F.create_map(*(F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv))
    return names[language_code(c)]


def alternates(core: Column, languages: Column, origin: str) -> Column:
    """hreflang tags of one page in its languages ('' is the main one, which is also x-default)."""
    href = lambda p: F.concat(F.lit(origin), F.when(p == "", "").otherwise(F.concat(F.lit("/"), p)), F.lit("/"), core)
    tag = lambda code, p: F.concat(F.lit('<link rel="alternate" hreflang="'), code, F.lit('" href="'), href(p), F.lit('">'))
    each = F.transform(F.array_sort(languages), lambda p: tag(F.when(p == "", "fr").otherwise(p), p))
    return F.concat(each, F.array(tag(F.lit("x-default"), F.lit(""))))
