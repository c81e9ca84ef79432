"""Normalisation of hosts, addresses, headers, cookies and texts, as column expressions.

All stay in the JVM but for international host names and IPv6, which take an
Arrow-batched function.
"""

from __future__ import annotations

import ipaddress
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.functions import policy


def is_special_use(host: Column) -> Column:
    """The host is a special-use name or lies under one."""
    return host.rlike(r"(?:\A|\.)(?:" + "|".join(re.escape(d) for d in policy.SPECIAL_USE_DOMAINS) + r")\z")


def ascii_hostname(raw: Column, allow_special_use: bool = False) -> Column:
    """Canonical form of an ASCII host name, null if it is none.

    Lower case without one trailing dot; 2 to 127 labels of at most 63 letters,
    digits and inner hyphens; the last holds a letter and is no number in any
    notation; not longer than 253; not for special use.
    """
    host = F.regexp_replace(F.lower(raw), r"\.\z", "")
    label = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    shaped = (F.length(raw) > 0) & (F.length(host) <= policy.MAX_HOST) & host.rlike(rf"\A(?:{label}\.){{1,126}}{label}\z")
    last = F.substring_index(host, ".", -1)
    named = last.rlike("[a-z]") & ~last.rlike(r"\A0x[0-9a-f]*\z")
    allowed = F.lit(True) if allow_special_use else ~is_special_use(host)
    return F.when(shaped & named & allowed, host)


@F.pandas_udf(T.StringType())
def to_ascii_host(raw: pd.Series) -> pd.Series:
    """International names in their ASCII form (IDNA, UTS 46); null where there is none."""
    try:
        import idna

        encode = lambda x: idna.encode(x, uts46=True).decode()
    except ImportError:
        encode = lambda x: x.replace("。", ".").encode("idna").decode()

    def one(x: str | None) -> str | None:
        try:
            return None if x is None or any(c.isspace() for c in x) else encode(x)
        except (UnicodeError, ValueError):
            return None

    return raw.map(one, na_action="ignore")


def normalize_hostnames(df: DataFrame, column: str, out: str = "host", allow_special_use: bool = False) -> DataFrame:
    """Add the canonical host; only rows with non-ASCII names visit Python.

    Null and invalid names give null. A column called ``out`` is replaced.
    """
    plain = F.coalesce(F.col(column).rlike(r"\A[\x00-\x7f]*\z"), F.lit(True))
    ascii_rows = df.where(plain).withColumn(out, ascii_hostname(F.col(column), allow_special_use))
    other = df.where(~plain).withColumn(out, ascii_hostname(to_ascii_host(F.col(column)), allow_special_use))
    return ascii_rows.unionByName(other)


def target_candidates(host: Column) -> Column:
    """The addresses to try in order: https, https www, http, http www (no second www, none too long)."""
    www = F.when(~F.startswith(host, F.lit("www.")) & (F.length(host) + 4 <= policy.MAX_HOST), F.concat(F.lit("www."), host))
    urls = [F.concat(F.lit(f"{scheme}://"), h, F.lit("/")) for scheme in ("https", "http") for h in (host, www)]
    return F.filter(F.array(*urls), lambda u: u.isNotNull())


def ipv4_number(address: Column) -> Column:
    """A dotted address as a number; null if it isn't one."""
    part = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    parts = F.split(address, r"\.")
    number = sum((F.try_element_at(parts, F.lit(i + 1)).try_cast("long") * F.lit(256 ** (3 - i)) for i in range(4)), F.lit(0))
    return F.when(address.rlike(rf"\A{part}(?:\.{part}){{3}}\z"), number)


def is_public_ipv4(address: Column) -> Column:
    """Whether an IPv4 address is public; null if it is no IPv4 address. The ranges are folded into the expression."""
    nets = [ipaddress.ip_network(c) for c in policy.IPV4_NON_PUBLIC]

    def public(number: Column) -> Column:
        return ~reduce(lambda a, b: a | b, [number.between(int(n.network_address), int(n.broadcast_address)) for n in nets])

    # The number is bound once, by a one-element array, instead of standing in the expression once per range.
    return F.transform(F.array(ipv4_number(address)), public)[0]


@F.pandas_udf(T.BooleanType())
def is_public_ipv6(address: pd.Series) -> pd.Series:
    """Whether an IPv6 address is public; null if it is no IPv6 address."""
    public, closed = ipaddress.ip_network(policy.IPV6_PUBLIC), [ipaddress.ip_network(n) for n in policy.IPV6_NON_PUBLIC]

    def one(x: str) -> bool | None:
        try:
            ip = ipaddress.IPv6Address(x)
        except ValueError:
            return None
        return ip in public and not any(ip in n for n in closed)

    return address.map(one, na_action="ignore").astype(object)


def admit_addresses(addresses: Column) -> Column:
    """Struct admitted, code of the answers of one name: all public, or refused as a whole.

    addresses: array of struct address, is_public (null: no address). No answer,
    a mixture, and answers that are all not public have their own codes.
    """
    usable = F.filter(F.coalesce(addresses, F.array()), lambda a: a["address"].isNotNull())
    public = F.size(F.filter(usable, lambda a: F.coalesce(a["is_public"], F.lit(False))))
    code = F.when(F.size(usable) == 0, "DNS_NO_ADDRESS").when(public == 0, "SSRF_NON_PUBLIC_ADDRESS").when(public < F.size(usable), "SSRF_MIXED_ADDRESSES")
    return F.struct(code.isNull().alias("admitted"), code.alias("code"))


def network_host(url: Column) -> Column:
    """Struct host, family (0 name, 4, 6) of an http or ws address without user information and port; null for others and for hosts that are not public.

    Addresses in IPv6 must be public too; names come in lower case without a closing dot.
    """
    part = lambda n: F.regexp_extract(url, r"(?i)\A(?:https?|wss?)://([^/?#\\@:\[\]]+|\[[0-9a-f:.]+\])(?:[/?#\\].*)?\z", n)
    raw = F.lower(part(1))
    bare = F.when(F.startswith(raw, F.lit("[")), F.substring(raw, F.lit(2), F.length(raw) - 2))
    v4 = F.struct(raw.alias("host"), F.lit(4).alias("family"))
    v6 = F.struct(canonical_ipv6(bare).alias("host"), F.lit(6).alias("family"))
    name = F.struct(ascii_hostname(raw).alias("host"), F.lit(0).alias("family"))
    found = F.when(bare.isNotNull(), F.when(is_public_ipv6(bare), v6)).when(ipv4_number(raw).isNotNull(), F.when(is_public_ipv4(raw), v4)).when(ascii_hostname(raw).isNotNull(), name)
    return F.when(F.length(raw) > 0, found)


@F.pandas_udf(T.StringType())
def canonical_ipv6(address: pd.Series) -> pd.Series:
    """The shortest form of an IPv6 address; null if it is none."""

    def one(x: str) -> str | None:
        try:
            return str(ipaddress.IPv6Address(x))
        except ValueError:
            return None

    return address.map(one, na_action="ignore").astype(object)


def http_status_class(status: Column) -> Column:
    """2xx to 5xx; null for others."""
    return F.when(status.between(200, 599), F.concat(F.floor(status / 100).cast("string"), F.lit("xx")))


def media_type(header: Column) -> Column:
    """Lower-case type/subtype of a content-type header; null if it is malformed."""
    token = r"[!#$%&'*+.^_`|~0-9A-Za-z-]+"
    value = rf"(?:{token}|\"(?:[^\"\\]|\\.)*\")"
    well_formed = header.rlike(rf"\A[ \t]*{token}/{token}[ \t]*(?:;[ \t]*(?:{token}={value})?[ \t]*)*\z")
    return F.when(well_formed, F.lower(F.regexp_extract(header, rf"\A[ \t]*({token}/{token})", 1)))


def charset(header: Column) -> Column:
    """The first charset parameter in lower case; null if there is none."""
    found = F.regexp_extract(header, r"(?i);[ \t]*charset=[ \t]*\"?([^\";, \t]+)", 1)
    return F.when(F.length(found) > 0, F.lower(found))


def is_html(media: Column) -> Column:
    return media.isin("text/html", "application/xhtml+xml")


def cookie_name(header: Column) -> Column:
    """Name of a Set-Cookie header; null if the pair is malformed."""
    return F.when(_cookie_ok(header), F.regexp_extract(header, r"\A[ \t]*([^=;]+?)[ \t]*=", 1))


def cookie_value(header: Column) -> Column:
    """Value of a Set-Cookie header without balanced quotes; null if the pair is malformed."""
    raw = F.regexp_extract(header, r"\A[^=;]*=[ \t]*([^;]*?)[ \t]*(?:;|\z)", 1)
    return F.when(_cookie_ok(header), F.regexp_replace(raw, r"\A\"(.*)\"\z", "$1"))


def _cookie_ok(header: Column) -> Column:
    octet = r"[\x21\x23-\x2b\x2d-\x3a\x3c-\x5b\x5d-\x7e]*"
    return header.rlike(rf"\A[ \t]*[!#$%&'*+.^_`|~0-9A-Za-z-]+[ \t]*=[ \t]*(?:{octet}|\"{octet}\")[ \t]*(?:;.*)?\z")


def retry_after_ms(header: Column, now: Column, cap_ms: int = 30_000) -> Column:
    """Wait of a Retry-After header (seconds or HTTP date), kept between 100 ms and the cap; null if malformed."""
    seconds = F.when(header.rlike(r"\A\d{1,10}\z"), header.try_cast("long") * 1000)
    moment = F.try_to_timestamp(F.regexp_replace(header, r"\A[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))
    until = F.when(header.rlike(r"\A[A-Za-z]{3}, \d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} GMT\z"), F.unix_millis(moment) - F.unix_millis(now))
    wait = F.coalesce(seconds, until)
    return F.when(wait.isNotNull(), F.greatest(F.lit(100), F.least(wait, F.lit(cap_ms))))


def truncate_bytes(text: Column, limit: int) -> Column:
    """The longest prefix of at most ``limit`` UTF-8 bytes that ends between characters."""
    raw = F.encode(text, "UTF-8")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, max(0, limit - back)).cast("string")) for back in range(min(4, limit + 1))]
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.coalesce(*cuts))


def truncate_points(text: Column, limit: int) -> Column:
    """Struct of the first ``limit`` characters and whether any were cut."""
    return F.struct(F.substring(text, 1, limit).alias("value"), (F.char_length(text) > limit).alias("truncated"))


def ascii_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"\A[ \t\r\n\f]+|[ \t\r\n\f]+\z", "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t\r\n\f]+", " ")


def normalize_dns(kind: Column, raw: Column) -> Column:
    """Value of a DNS answer given as JSON: host of MX, SRV and SOA, the one property of CAA, joined chunks of TXT (at most 4,096 bytes)."""
    host = lambda path: F.lower(F.regexp_replace(F.get_json_object(raw, path), r"\.\z", ""))
    chunks = F.from_json(raw, "array<string>")
    text = F.array_join(chunks, "")
    property_name = F.filter(F.json_object_keys(raw), lambda k: k != "critical")
    caa = F.when(F.size(property_name) == 1, F.concat(property_name[0], F.lit("="), F.from_json(raw, "map<string,string>")[property_name[0]]))
    return (
        F.when(kind.isin("A", "AAAA"), raw).when(kind.isin("CNAME", "NS", "PTR"), F.lower(F.regexp_replace(raw, r"\.\z", "")))
        .when(kind == "MX", host("$.exchange")).when(kind == "SRV", host("$.name")).when(kind == "SOA", host("$.nsname"))
        .when(kind == "CAA", caa).when((kind == "TXT") & (F.octet_length(text) <= 4096), text)
    )
