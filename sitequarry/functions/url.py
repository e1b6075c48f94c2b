"""URLs: pieces, normal forms and hygiene, as Column expressions.

A URL counts as readable if it has a scheme and an authority.  Percent-encoding and international host names
are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitequarry.functions.common import any_of, let

# Query parameters that only track, for cleaning (27 of them, and all that begin with utm_).
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "gclsrc", "dclid", "_ga", "_gl", "_gid", "fbclid", "igshid",
    "msclkid", "mc_cid", "mc_eid", "spmailingid", "ref", "ref_src", "source", "trk", "sessionid", "jsessionid", "phpsessid", "aspsessionid", "yclid",
]
# Those for candidate URLs.
CANDIDATE_TRACKING = ["gclid", "dclid", "fbclid", "msclkid", "_ga", "mc_cid", "mc_eid"]
# Hosts that publish for many.
PUBLISHERS = ["medium.com", "dev.to", "forem.com", "substack.com", "blogspot.com"]
# Session and advertising parameters.
SESSION = r"(?i)[?&](?:sid|sessionid|session_id|phpsessid|jsessionid|aspsessionid|sessid|sid_?[a-z]*)[=:][^&]+"
AD_CLICK = r"(?i)[?&](?:utm_[a-z]+|gclid|fbclid|msclkid|yclid|dclid|wbraid|gbraid)=[^&]*"
MAX_LENGTH = 115

_URL = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def readable(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+[^\s]*\s*$"), F.lit(False))


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), _URL, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    """Host and port in lower case, without user and without the scheme's own port."""
    bare = F.lower(F.regexp_replace(_part(url, 2), "^.*@", ""))
    return F.when(scheme(url) == "http", F.regexp_replace(bare, ":80$", "")).when(scheme(url) == "https", F.regexp_replace(bare, ":443$", "")).otherwise(bare)


def hostname(url: Column) -> Column:
    return F.regexp_replace(authority(url), r":\d*$", "")


def path(url: Column) -> Column:
    return F.when(_part(url, 3) == "", "/").otherwise(_part(url, 3))


def query(url: Column) -> Column:
    """Without the question mark."""
    return F.regexp_replace(_part(url, 4), r"^\?", "")


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def normalize(url: Column) -> Column:
    """Key of a page: no query, no fragment, one trailing slash off and then // collapsed, lower case (so /a// becomes /a/)."""
    p = path(url)
    short = F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)
    return F.when(readable(url), F.lower(F.concat(origin(url), F.regexp_replace(short, "/{2,}", "/")))).otherwise(F.regexp_replace(F.trim(F.lower(url)), "/$", ""))


def normalize_for_compare(url: Column) -> Column:
    """As normalize, but // stays."""
    p = path(url)
    return F.when(readable(url), F.lower(F.concat(origin(url), F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)))).otherwise(F.regexp_replace(F.trim(F.lower(url)), "/$", ""))


def normalize_hreflang(url: Column) -> Column:
    """As normalize_for_compare, with the query kept."""
    q = _part(url, 4)
    return F.concat(normalize_for_compare(url), F.when(readable(url) & (q != "?"), q).otherwise(""))


def _key(pair: Column) -> Column:
    return F.lower(F.substring_index(pair, "=", 1))


def clean(url: Column, strip_all: bool = False, sort: bool = True, lower_path: bool = True) -> Column:
    """Address without tracking: scheme and host lower, no fragment, // collapsed, parameters filtered and sorted by name (stable)."""
    p = F.regexp_replace(path(url), "/{2,}", "/")
    p = F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)
    p = F.lower(p) if lower_path else p
    pairs = F.filter(F.split(query(url), "&"), lambda x: (x != "") & ~_key(x).startswith("utm_") & ~_key(x).isin(TRACKING))
    if sort:
        pairs = F.transform(F.array_sort(F.transform(pairs, lambda x, i: F.struct(F.substring_index(x, "=", 1).alias("k"), i.alias("i"), x.alias("x")))), lambda s: s["x"])
    rest = F.lit("") if strip_all else F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    fallback = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "/$", "")
    return F.when(readable(url), F.concat(origin(url), p, rest)).otherwise(fallback)


def candidate(url: Column) -> Column:
    """Address of a candidate, null if unusable: http(s) only, no user, no control sign or backslash; path case and parameter order stay."""
    raw = F.trim(url)
    bad = raw.rlike(r"[\x00-\x1f\\]") | ~readable(raw) | ~scheme(raw).isin("http", "https") | F.regexp_extract(raw, _URL, 2).contains("@")
    host = F.regexp_replace(authority(raw), r"\.(?=:|$)", "")
    pairs = F.filter(F.split(query(raw), "&"), lambda x: (x != "") & ~_key(x).startswith("utm_") & ~_key(x).isin(CANDIDATE_TRACKING))
    search = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    return F.when(bad | (host == ""), None).otherwise(F.concat(scheme(raw), F.lit("://"), host, path(raw), search))


def host(url: Column) -> Column:
    """Host in lower case without www.; empty if unreadable."""
    return F.when(readable(url), F.regexp_replace(hostname(url), r"^www\.", "")).otherwise("")


def root_domain(value: Column) -> Column:
    """Host of a URL or of a bare domain."""
    v = F.lower(F.trim(value))
    full = F.when(v.startswith("http://") | v.startswith("https://"), v).otherwise(F.concat(F.lit("https://"), v))
    return F.when(F.coalesce(value, F.lit("")) == "", "").when(readable(full), F.regexp_replace(hostname(full), r"^www\.", "")).otherwise(F.substring_index(F.regexp_replace(full, r"^www\.", ""), "/", 1))


def publisher(url: Column) -> Column:
    out = host(url)
    h = host(url)
    for name in reversed(PUBLISHERS):
        out = F.when((h == name) | h.endswith(f".{name}"), name).otherwise(out)
    return out


def same_origin(a: Column, b: Column) -> Column:
    return readable(a) & readable(b) & (origin(a) == origin(b))


def resolve(base: Column, href: Column) -> Column:
    """Absolute address of an href on a page; null for those that lead nowhere (script, mail, fragment and the like)."""
    h = F.trim(href)
    skipped = (h == "") | h.startswith("#") | F.lower(h).rlike("^(javascript|mailto|tel|data|blob|vbscript):")
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    joined = (
        F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin(base), h))
        .when(h.startswith("?"), F.concat(origin(base), path(base), h))
        .otherwise(F.concat(origin(base), folder, h))
    )
    return F.when(skipped | ~readable(base), None).otherwise(joined)


def to_crawl_origin(url: Column, production: str, crawl: str) -> Column:
    return F.when(url.startswith(production), F.concat(F.lit(crawl), F.substring(url, len(production) + 1, 1 << 20))).otherwise(url)


def production_rewrite(html: Column, production: str, crawl: str) -> Column:
    return F.replace(html, F.lit(production), F.lit(crawl))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def is_trap(url: Column, most: int = 2) -> Column:
    """At least four path segments, and one more than `most` times or a group of two or more at once repeated."""

    def repeats(s: Column) -> Column:
        n = F.size(s)
        often = F.exists(F.array_distinct(s), lambda x: F.size(F.filter(s, lambda y: y == x)) > most)
        sizes = F.sequence(F.lit(2), F.greatest(F.floor(n / 2).cast("int"), F.lit(2)))
        twice = F.exists(
            sizes,
            lambda k: F.exists(F.sequence(F.lit(0), F.greatest(n - k * 2, F.lit(0))), lambda i: (i + k * 2 <= n) & (F.slice(s, i + 1, k) == F.slice(s, i + k + 1, k))),
        )
        return (n >= 4) & (often | twice)

    return F.when(readable(url), let(segments(url), repeats)).otherwise(False)


def hygiene(url: Column) -> dict[str, Column]:
    """Column per finding."""
    ok = readable(url)
    p = path(url)
    low = F.transform(segments(url), lambda x: F.lower(x))
    params = F.filter(F.split(query(url), "&"), lambda x: x != "")
    adjacent = let(low, lambda s: F.exists(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: (i < F.size(s)) & (F.get(s, i) == F.get(s, i - 1))))
    return {
        "url_length": F.length(url).cast("long"),
        "over_length": ok & (F.length(url) > MAX_LENGTH),
        "non_ascii": url.rlike(r"[^\x00-\x7F]"),
        "underscore": ok & p.contains("_"),
        "uppercase": ok & p.rlike("[A-Z]"),
        "param_count": F.when(ok, F.size(params)).otherwise(0).cast("long"),
        "session_id": ok & any_of(url.rlike, [SESSION, AD_CLICK]),
        "duplicate_path": ok & adjacent,
        "double_slash": ok & p.contains("//"),
        "trailing_dot": ok & hostname(url).endswith("."),
    }


def is_valid_http(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://[^\s/?#@]+(?:[/?#][^\s]*)?$"), F.lit(False))


def matches_patterns(url: Column, patterns: list[str]) -> Column:
    """A regular expression matches, or, where it is none, the text occurs in any case."""
    import re

    def one(p: str) -> Column:
        try:
            re.compile(p)
        except re.error:
            return F.contains(F.lower(url), F.lit(p.lower()))
        return url.rlike(p)

    return any_of(one, patterns)
