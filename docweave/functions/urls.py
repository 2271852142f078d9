"""URLs and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import casefold_safe, slug


#: Scheme, authority, path and query of a URL by the generic syntax, for single strings.
PARTS = re.compile(r"(?s)(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?")


class Url:
    """The parts of a URL as columns, told apart by the generic syntax (scheme, authority, path, query); nothing fails on malformed text."""

    def __init__(self, url: Column):
        self.text = F.trim(F.coalesce(url, F.lit("")))
        self.scheme = F.lower(F.regexp_extract(self.text, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
        self.netloc = F.regexp_extract(self.text, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
        self.path = F.regexp_extract(self.text, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1)
        self.query = F.regexp_extract(self.text, r"^[^?#]*\?([^#]*)", 1)
        self.has_userinfo = F.contains(self.netloc, F.lit("@"))
        self.host_port = F.lower(F.regexp_replace(self.netloc, r"^.*@", ""))
        self.host = F.regexp_replace(F.regexp_replace(self.host_port, r":[0-9]*$", ""), r"^\[|\]$", "")
        self.port = F.regexp_extract(self.host_port, r":([0-9]+)$", 1)
        self.is_http = self.scheme.isin("http", "https")
        self.segments = F.filter(F.split(self.path, "/"), lambda s: s != "")


def canonicalize_url(url: Column) -> Column:
    """Lower-case scheme and host, without default port, fragment and trailing slashes; query and userinfo stay. Other text is only trimmed."""
    u = Url(url)
    default = ((u.scheme == "http") & (u.port == "80")) | ((u.scheme == "https") & (u.port == "443")) | (u.port == "")
    netloc = F.when(u.has_userinfo, u.netloc).when(default, F.regexp_replace(u.host_port, ":[0-9]*$", "")).otherwise(u.host_port)
    path = F.regexp_replace(u.path, "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    query = F.when(u.query == "", "").otherwise(F.concat(F.lit("?"), u.query))
    return F.when(url.isNull(), None).when(u.is_http, F.concat(u.scheme, F.lit("://"), netloc, path, query)).otherwise(u.text)


def destination_for_url(url: Column) -> Column:
    """A safe relative path for a page: odd characters to hyphens, ``index`` for an empty path, .md unless there is another suffix, a hash for the query."""
    u = Url(url)
    parts = F.transform(u.segments, lambda s: F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", ""))
    parts = F.transform(parts, lambda s: F.when(s.isin("", ".", ".."), "index").otherwise(s))
    parts = F.when(F.size(u.segments) == 0, F.array(F.lit("index"))).otherwise(parts)
    name = F.array_join(parts, "/")
    name = F.when(F.lower(name).rlike(r"\.html?$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    last = F.element_at(F.split(name, "/"), -1)
    name = F.when(F.contains(last, F.lit(".")), name).otherwise(F.concat(name, F.lit(".md")))
    digest = F.substring(F.sha2(u.query, 256), 1, 10)
    stem, extension = F.regexp_replace(name, r"\.[^./]*$", ""), F.regexp_extract(name, r"(\.[^./]*)$", 1)
    return F.when(u.query == "", name).otherwise(F.concat(stem, F.lit("--"), digest, extension))


#: Formats whose documents become Markdown.
TO_MARKDOWN = ("html", "pdf", "docx", "openapi", "ipynb", "xlsx", "pptx")


def destination_for_file(path: Column, format_: Column) -> Column:
    safe = safe_relpath(path)
    return F.when(format_.isin(*TO_MARKDOWN), F.concat(F.regexp_replace(safe, r"(?<=[^/])\.[^./]*$", ""), F.lit(".md"))).otherwise(safe)


def safe_relpath(path: Column) -> Column:
    """The path with / and without . parts; null where it is absolute, has a drive letter or .., or is empty."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda s: ~s.isin("", "."))
    bad = p.startswith("/") | p.rlike("^[A-Za-z]:") | (F.size(parts) == 0) | F.array_contains(parts, "..")
    return F.when(~bad, F.array_join(parts, "/"))


#: Names of query parameters that carry credentials (besides those that end in _token or _secret).
CREDENTIAL_KEYS = (
    "access_token", "api_key", "apikey", "auth", "authorization", "bearer", "client_secret",
    "password", "passwd", "private_key", "secret", "signature", "sig", "token",
)


def _is_credential(pair: Column) -> Column:
    key = F.regexp_replace(casefold_safe(F.regexp_extract(pair, "^([^=]*)", 1)), r"[-\s+]+", "_")
    return key.isin(*CREDENTIAL_KEYS) | key.endswith("_token") | key.endswith("_secret")


def has_credentials(query: Column) -> Column:
    return F.exists(F.filter(F.split(query, "&"), lambda p: p != ""), _is_credential)


def redact_url(url: Column) -> Column:
    """Canonical form without userinfo and with credential values replaced; files keep their name only, local paths nothing.

    Pairs keep their own encoding. (Re-encoding all pairs of a query that holds a credential needs no helper as long as they are encoded already.)
    """
    u = Url(url)
    pairs = F.filter(F.split(u.query, "&"), lambda p: p != "")
    redacted = F.array_join(F.transform(pairs, lambda p: F.when(_is_credential(p), F.concat(F.regexp_extract(p, "^([^=]*)", 1), F.lit("=REDACTED"))).otherwise(p)), "&")
    query = F.when(F.exists(pairs, _is_credential), redacted).otherwise(u.query)
    tail = F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))
    name = F.element_at(F.split(F.regexp_replace(u.path, "/+$", ""), "/"), -1)
    local = u.text.rlike(r"^[A-Za-z]:[\\/]") | u.text.startswith("/")
    path = F.when(u.path == "", "/").otherwise(u.path)
    return (
        F.when(u.scheme == "file", F.concat(F.lit("file://local/"), F.when(name == "", "source").otherwise(name)))
        .when(u.is_http & u.has_userinfo, F.concat(u.scheme, F.lit("://"), F.regexp_replace(u.netloc, "^.*@", ""), path, tail))
        .when(local, "<local-path>")
        .otherwise(canonicalize_url(F.concat(F.regexp_extract(u.text, r"^([^?#]*)", 1), tail)))
    )


#: Host names that are never fetched.
BLOCKED_HOSTS = ("localhost", "localhost.localdomain", "metadata.google.internal", "metadata", "instance-data", "instance-data.ec2.internal")
#: IPv4 networks that are private, loopback, link-local, reserved, multicast or unspecified: first address and prefix length.
PRIVATE_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


def is_private_address(host: Column) -> Column:
    """Literal addresses only: IPv4 by network, IPv6 by its beginning (loopback, unspecified, unique local, link-local, multicast, mapped IPv4)."""
    dotted = host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    parts = F.transform(F.split(host, r"\."), lambda p: F.try_to_number(p, F.lit("999")).cast("long"))
    number = F.when(dotted, F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p))
    v4 = F.lit(False)
    for first, bits in PRIVATE_V4:
        a, b, c, d = map(int, first.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + d
        v4 = v4 | number.between(low, low + (1 << (32 - bits)) - 1)
    v6 = F.contains(host, F.lit(":")) & host.rlike(r"^(::1?$|::ffff:|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|ff[0-9a-f]{2}:|2001:db8:)")
    return F.coalesce(v4, F.lit(False)) | v6


def url_policy(url: Column) -> Column:
    """Why a URL may not be fetched (invalid_url, credentials_in_url, ssrf_blocked), else ``allowed``."""
    u = Url(url)
    return (
        F.when(~u.is_http | (u.host == ""), "invalid_url")
        .when(u.has_userinfo | has_credentials(u.query), "credentials_in_url")
        .when(u.host.isin(*BLOCKED_HOSTS) | is_private_address(u.host), "ssrf_blocked")
        .otherwise("allowed")
    )


#: Suffixes of assets, and hosts of repositories.
ASSET = r"\.(css|js|mjs|ts|map|png|jpg|jpeg|gif|svg|ico|webp|woff|woff2|ttf|zip)$"
REPOSITORY_HOSTS = ("github.com", "gitlab.com", "bitbucket.org")


def is_asset(url: Column) -> Column:
    return F.lower(Url(url).path).rlike(ASSET)


def classify_source(url: Column) -> Column:
    """kind (repository, web, local), slug, canonical, version, scope and confidence of a source given as a URL or path."""
    u = Url(url)
    s = u.segments
    repo = u.is_http & u.host.isin(*REPOSITORY_HOSTS) & (F.size(s) >= 2)
    name = F.regexp_replace(F.try_element_at(s, F.lit(2)), r"\.git$", "")
    ref = repo & (F.size(s) >= 4) & F.try_element_at(s, F.lit(3)).isin("tree", "blob", "src")
    scope = F.array_join(F.slice(s, 5, F.greatest(F.size(s) - 4, F.lit(0))), "/")
    return F.struct(
        F.when(repo, "repository").when(u.is_http, "web").otherwise("local").alias("kind"),
        F.when(repo, slug(name)).when(u.is_http, slug(u.host)).otherwise(slug(F.regexp_extract(u.text, r"([^/\\]*)[/\\]*$", 1))).alias("slug"),
        F.when(repo, F.concat(u.scheme, F.lit("://"), u.host, F.lit("/"), F.try_element_at(s, F.lit(1)), F.lit("/"), name)).otherwise(canonicalize_url(url)).alias("canonical"),
        F.when(ref, F.try_element_at(s, F.lit(4))).alias("version"),
        F.when(ref & (scope != ""), scope).alias("scope"),
        F.when(repo & (u.host == "github.com"), 0.9).when(repo, 0.7).when(u.is_http, 0.5).otherwise(1.0).alias("confidence"),
    )
