"""Domains and urls as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts whose images may be fetched: a fixed value.
IMAGE_HOST_SUFFIX = ".thumbs.redditmedia.com"

#: White space and line ends that are trimmed: fixed values.
_SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"

_VALID = r"^[A-Za-z0-9-]{1,63}(\.[A-Za-z0-9-]{1,63})*$"


def host(url: Column) -> Column:
    """Lower-case host; null if the url has none or can't be parsed."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def is_valid_domain(domain: Column) -> Column:
    return (F.length(domain) <= 255) & domain.rlike(_VALID)


def normalize_domain(text: Column) -> Column:
    """What a user typed as a domain: of a url the host; without a last dot and one leading www.; null if it's no domain."""
    plain = F.regexp_replace(text, rf"^[{_SPACE}]+|[{_SPACE}]+$", "")
    named = F.when(plain.rlike("[/:]"), host(plain)).otherwise(plain)
    named = F.regexp_replace(named, r"\.$", "")
    return F.when(is_valid_domain(named), F.regexp_replace(F.lower(named), r"^www\.", ""))


def label_key(domain: Column) -> Column:
    """Labels from the top down; one empty label at the end doesn't count; a null domain has none but ''."""
    return F.reverse(F.split(F.regexp_replace(F.coalesce(domain, F.lit("")), r"\.$", ""), r"\."))


def sort_key(domain: Column) -> Column:
    """Labels from the top down, so that subdomains stand together; one empty label at the end doesn't count; null for a null domain."""
    return F.when(domain.isNotNull(), F.array_join(label_key(domain), "."))


def suffixes(domain: Column) -> Column:
    """All prefixes of label_key, as text."""
    key = label_key(domain)
    return F.transform(F.sequence(F.lit(1), F.size(key)), lambda n: F.array_join(F.slice(key, F.lit(1), n), "."))


def without_dots(url: Column) -> Column:
    """An http or https url without . and .. segments, also spelt %2e, in its path; as they are: empty segments, query and mark, other urls. An empty path is /.

    The path's segments are folded from the left: .. takes the one before away, and a last . or .. leaves an empty one.
    """
    origin = F.regexp_extract(url, r"^((?i:https?)://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^(?i:https?)://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(url, r"^(?i:https?)://[^?#]*(.*)$", 1)
    segments = F.split(F.substr(path, F.lit(2)), "/")
    here, up = r"^(?:\.|%2[eE])$", r"^(?:\.|%2[eE]){2}$"
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda done, s: F.when(s.rlike(up), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s.rlike(here), done).otherwise(F.array_append(done, s)),
    )
    last = F.element_at(segments, -1)
    kept = F.when(last.rlike(up) | last.rlike(here), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.when(origin == "", url).when(path == "", F.concat(origin, F.lit("/"), rest)).otherwise(F.concat(origin, F.lit("/"), F.array_join(kept, "/"), rest))


def resolved(link: Column, page: Column) -> Column:
    """A link as an absolute url, from that of its page: //host, /path, ?query, #mark and relative paths are completed, and dot segments removed; absolute ones stay but for these."""
    scheme = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    origin = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*)", 1)
    folder = F.when(path == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    whole = (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link == "", F.regexp_replace(page, "#.*$", ""))
        .when(link.startswith("?"), F.concat(path, link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(page, "#.*$", ""), link))
        .otherwise(F.concat(folder, link))
    )
    return without_dots(whole)


def fetchable(url: Column) -> Column:
    return F.coalesce(host(url).endswith(IMAGE_HOST_SUFFIX), F.lit(False))


def to_https(url: Column) -> Column:
    return F.regexp_replace(url, "^(?i:http):", "https:")
