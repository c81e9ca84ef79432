"""Redaction of evidence: sensitive words, opaque tokens, credentials, URLs, versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.functions import policy
from fathomline.functions.normalize import ascii_hostname, ascii_trim, is_public_ipv4, truncate_points

REDACTED_SEGMENT = "%5Bredacted%5D"
OPAQUE = r"[0-9a-fA-F]{16,}|[A-Za-z0-9_-]{24,}"
CREDENTIAL = r"(?i)(?:^|[^A-Za-z0-9_-])(?:" + "|".join(policy.CREDENTIAL_SCHEMES) + r")[\t ]+"
VERSION = r"\A[A-Za-z0-9][A-Za-z0-9._+~-]{0,63}\z"


def has_opaque_token(text: Column) -> Column:
    """A run of 16 hex digits or 24 base64url characters."""
    return text.rlike(OPAQUE)


def _words(words: tuple[str, ...]) -> str:
    return r"(?i)(?:^|[^a-z0-9])(?:" + "|".join(words) + r"|api[^a-z0-9]+key)(?:$|[^a-z0-9])"


def has_sensitive_word(text: Column, words: tuple[str, ...] = policy.SENSITIVE_WORDS) -> Column:
    """One of the words, or ``api`` followed by ``key``, among the alphanumeric tokens of the text."""
    return text.rlike(_words(words))


def has_credential(text: Column) -> Column:
    """An authentication scheme followed by white space."""
    return text.rlike(CREDENTIAL)


def is_sensitive(text: Column) -> Column:
    return text.rlike(f"{_words(policy.SENSITIVE_WORDS)}|{OPAQUE}")


def is_secret(text: Column) -> Column:
    """Sensitive, or with credentials; one pattern."""
    return text.rlike(f"{_words(policy.SENSITIVE_WORDS)}|{OPAQUE}|{CREDENTIAL.removeprefix('(?i)')}")


def evidence_key(source: Column, key: Column) -> Column:
    """The key of evidence; unsafe keys of cookies, headers and meta elements become null."""
    words = F.when(source == "header", has_sensitive_word(key, policy.SENSITIVE_HEADER_WORDS)).otherwise(has_sensitive_word(key))
    unsafe = (F.length(key) > policy.MAX_SEGMENT) | words | has_opaque_token(key)
    return F.when(source.isin("cookie", "header", "meta") & unsafe, F.lit(None)).otherwise(key)


#: Parts of an http address: scheme, user information, host, port, path, query. Everything else is no address.
_ADDRESS = r"(?i)\A(https?)://((?:[^/?#\\]*@)?)([a-z0-9_~.-]+|\[[0-9a-f:.]+\])(?::(\d{0,5}))?((?:[/\\][^?#]*)?)(?:\?([^#]*))?(?:#.*)?\z"
_LONE_PERCENT = r"%(?![0-9A-Fa-f]{2})"


def _decoded(text: Column, plus: bool) -> Column:
    """Percent escapes decoded; a lone percent sign stays. ``plus``: a plus sign stands for a blank."""
    whole = F.regexp_replace(text, _LONE_PERCENT, "%25")
    return F.try_url_decode(whole if plus else F.replace(whole, F.lit("+"), F.lit("%2B")))


def _harmless(segment: Column) -> Column:
    return segment.rlike(rf"\A[A-Za-z0-9._~-]{{1,{policy.MAX_SEGMENT}}}\z") & ~is_sensitive(segment)


def _secret_marker(segment: Column) -> Column:
    return F.coalesce(F.lower(segment).isin(*policy.SENSITIVE_PATH_MARKERS), F.lit(False))


def sanitize_path(path: Column) -> Column:
    """A path whose segments are shown only if they are short, of plain signs, not sensitive, and not next to a marker of secrets.

    Segments are judged decoded; empty ones stay, ``.`` and ``..`` are resolved.
    """
    raw = F.transform(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda s: F.coalesce(_decoded(s, False), F.lit("%")))
    # The first, empty segment is the root; a path that ends in a dot segment ends in a slash.
    resolve = lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.array_append(done, s))
    steps = F.aggregate(F.slice(raw, F.lit(2), F.greatest(F.size(raw) - 1, F.lit(0))), F.array(F.lit("")), resolve)
    closed = F.when(F.size(raw) < 2, F.array(F.lit(""), F.lit(""))).when(F.element_at(raw, -1).isin(".", ".."), F.array_append(steps, F.lit(""))).otherwise(steps)

    def render(steps: Column) -> Column:
        near = lambda i: _secret_marker(F.get(steps, i - 1)) | _secret_marker(F.get(steps, i)) | _secret_marker(F.get(steps, i + 1))
        shown = F.transform(steps, lambda s, i: F.when((s == "") | (_harmless(s) & ~near(i)), s).otherwise(REDACTED_SEGMENT))
        return F.array_join(shown, "/")

    return F.transform(F.array(closed), render)[0]


def _sanitize_query(query: Column) -> Column:
    """Every value redacted, and every key that is too long or sensitive."""
    names = F.transform(F.filter(F.split(query, "&"), lambda p: F.length(p) > 0), lambda p: _decoded(F.substring_index(p, "=", 1), True))
    safe = lambda k: (F.length(k) <= policy.MAX_SEGMENT) & ~is_sensitive(k)
    return F.array_join(F.transform(names, lambda k: F.concat(F.when(safe(k), F.url_encode(k)).otherwise(REDACTED_SEGMENT), F.lit(f"={REDACTED_SEGMENT}"))), "&")


def sanitize_url(url: Column) -> Column:
    """Struct url, collapsed: user information and fragment removed, unsafe path segments and all query values redacted.

    Null for what is no http address of a host in ASCII, or too long. An address
    that redaction makes too long collapses to its origin.
    """
    part = lambda n: F.regexp_extract(url_, _ADDRESS, n)
    url_ = F.regexp_replace(url, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")
    scheme, port = F.lower(part(1)), part(4)
    fits = (F.length(url) <= policy.MAX_URL) & url_.rlike(_ADDRESS) & (F.coalesce(port.try_cast("int"), F.lit(0)) <= 65_535)
    usual = (port == "") | ((scheme == "http") & (port.try_cast("int") == 80)) | ((scheme == "https") & (port.try_cast("int") == 443))
    origin = F.concat(scheme, F.lit("://"), F.lower(part(3)), F.when(usual, "").otherwise(F.concat(F.lit(":"), port.try_cast("int").cast("string"))))
    query = _sanitize_query(part(6))
    parts = F.struct(origin.alias("origin"), sanitize_path(part(5)).alias("path"), F.when(F.length(query) > 0, F.concat(F.lit("?"), query)).otherwise("").alias("query"))

    def whole(p: Column) -> Column:
        clean = F.concat(p["origin"], p["path"], p["query"])
        fine = F.length(clean) <= policy.MAX_URL
        return F.struct(F.when(fine, clean).otherwise(F.concat(p["origin"], F.lit(f"/{REDACTED_SEGMENT}"))).alias("url"), (~fine).alias("collapsed"))

    return F.when(fits, F.transform(F.array(parts), whole)[0]).otherwise(F.lit(None).cast("struct<url:string,collapsed:boolean>"))


def evidence_match(source: Column, key: Column, observed: Column, matched: Column, clean_url: Column) -> Column:
    """Struct kind, value, truncated of what evidence may show.

    clean_url: the sanitised observed value where the source is a URL (else null).
    Null and empty values are redacted.
    """
    url = F.when(~clean_url["collapsed"] & (F.char_length(clean_url["url"]) <= policy.MATCH_POINTS), clean_url["url"])
    header = F.when(~(has_sensitive_word(F.coalesce(key, F.lit("")), policy.SENSITIVE_HEADER_WORDS) | is_secret(observed)), matched)
    meta = F.when(key.isin(*policy.PUBLIC_META_KEYS) & ~is_secret(observed), matched)
    host = F.when(key.isin("CNAME", "MX", "NS", "PTR", "SRV") & (ascii_hostname(observed) == observed), observed)
    dns = F.coalesce(F.when((key == "A") & is_public_ipv4(observed), observed), host)
    tls = F.when(~is_sensitive(observed), matched)
    shown = (
        F.when(source.isin(*policy.URL_SOURCES), url).when(source == "header", header).when(source == "meta", meta)
        .when(source == "network_hostname", observed).when(source == "dns_record", dns).when(source == "tls_issuer", tls)
    )
    cut = truncate_points(shown, policy.MATCH_POINTS)
    visible = F.length(shown) > 0
    return F.struct(
        F.when(visible, F.lit("value")).otherwise(F.lit("redacted")).alias("kind"), F.when(visible, cut["value"]).alias("value"), F.when(visible, cut["truncated"]).otherwise(F.lit(False)).alias("truncated")
    )


def evidence_version(source: Column, observed: Column, matched: Column, version: Column, clean_url: Column) -> Column:
    """The version that evidence may carry: well-shaped, from a harmless match and, for URLs, from an unchanged path without query."""
    harmless = ~(is_sensitive(version) | is_secret(matched))
    plain_url = (clean_url["url"] == observed) & ~clean_url["collapsed"] & ~observed.rlike(r"[?#]")
    fine = version.rlike(VERSION) & harmless & (~source.isin(*policy.URL_SOURCES) | F.coalesce(plain_url, F.lit(False)))
    return F.when(fine, version)


def render_version(template: Column, groups: Column) -> Column:
    """Render a version template over the groups of a match (array, group 1 first; unset groups are empty).

    One conditional ``\\N?a:b`` is decided first, then every ``\\N`` is replaced;
    the result is trimmed and must look like a version.
    """
    conditional = template.rlike(r"\A\\[1-9]\d*\?[^:]*:[^:]*\z")
    number = F.regexp_extract(template, r"\A\\(\d+)\?", 1).try_cast("int")
    given = F.length(F.coalesce(F.try_element_at(groups, number), F.lit(""))) > 0
    chosen = F.when(~conditional, template).when(given, F.regexp_extract(template, r"\?([^:]*):", 1)).otherwise(F.regexp_extract(template, r":([^:]*)\z", 1))
    # Highest numbers first, so that \1 does not eat the start of \12. The loop runs in the engine and keeps the generated code small.
    fill = lambda text, n: F.replace(text, F.concat(F.lit("\\"), n.cast("string")), F.coalesce(F.try_element_at(groups, n), F.lit("")))
    filled = F.aggregate(F.sequence(F.lit(12), F.lit(1), F.lit(-1)), chosen, fill)
    trimmed = ascii_trim(filled)
    return F.when(trimmed.rlike(VERSION) & ~has_opaque_token(trimmed), trimmed)
