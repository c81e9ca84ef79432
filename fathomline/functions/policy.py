"""Fixed values of the signal model: enumerations with their order, word lists, address ranges, limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Enumerations in their order.
EVIDENCE_SOURCES = ("url", "header", "cookie", "html", "text", "css", "meta", "script_url", "script_content", "dom", "javascript", "network_url", "network_hostname", "dns_record", "tls_issuer", "robots", "probe")
RULE_SOURCES = tuple(s for s in EVIDENCE_SOURCES if s != "network_hostname")
COLLECTORS = ("http", "browser", "dns", "tls")
PAGE_IDS = ("p1", "p2", "p3")
DNS_TYPES = ("A", "AAAA", "CAA", "CNAME", "MX", "NS", "PTR", "SOA", "SRV", "TXT")
ERROR_STAGES = ("target", "robots", "http", "dns", "tls", "browser", "detect")
# Error codes and the stages that may report them.
NETWORK_STAGES = ("target", "robots", "http", "dns", "tls", "browser")
ERROR_CODES = {
    "TARGET_NOT_FOUND": ("target",), "TARGET_ACCESS_DENIED": ("target",), "TARGET_REDIRECT_INVALID": ("target",), "TARGET_REDIRECT_LIMIT_EXCEEDED": ("target",),
    "ROBOTS_DISALLOWED": ("robots",), "ROBOTS_UNAVAILABLE": ("robots",), "ROBOTS_LIMIT_EXCEEDED": ("robots",),
    "HTTP_REQUEST_FAILED": ("http",), "HTTP_TIMEOUT": ("http",), "HTTP_LIMIT_EXCEEDED": ("http",), "HTTP_RESPONSE_LIMIT_EXCEEDED": ("http",), "HTTP_DECOMPRESSION_FAILED": ("http",), "UNSUPPORTED_CONTENT_TYPE": ("http",),
    "DNS_LOOKUP_FAILED": ("dns",), "DNS_NO_ADDRESS": ("dns",), "DNS_LIMIT_EXCEEDED": ("dns",),
    "TLS_CONNECTION_FAILED": ("tls",), "TLS_CERTIFICATE_INVALID": ("tls",), "TLS_TIMEOUT": ("tls",), "TLS_LIMIT_EXCEEDED": ("tls",),
    "BROWSER_UNAVAILABLE": ("browser",), "BROWSER_NAVIGATION_FAILED": ("browser",), "BROWSER_TIMEOUT": ("browser",), "BROWSER_LIMIT_EXCEEDED": ("browser",), "BROWSER_PROXY_FAILED": ("browser",),
    "SSRF_NON_PUBLIC_ADDRESS": NETWORK_STAGES, "SSRF_MIXED_ADDRESSES": NETWORK_STAGES, "SSRF_REMOTE_ADDRESS_MISMATCH": NETWORK_STAGES,
    "DOMAIN_DEADLINE_EXCEEDED": ERROR_STAGES, "RESULT_LIMIT_EXCEEDED": ("detect",),
    "REGEX_RULE_TIMEOUT": ("detect",), "REGEX_DOMAIN_BUDGET_EXCEEDED": ("detect",), "REGEX_EXECUTION_LIMIT": ("detect",), "REGEX_WORKER_CRASH": ("detect",), "REGEX_WORKER_RESTART_FAILED": ("detect",), "DETECTOR_UNAVAILABLE": ("detect",),
}
URL_SOURCES = ("url", "script_url", "network_url")

# Words that mark secrets.
SENSITIVE_WORDS = ("authorization", "cookie", "credential", "password", "secret", "signature", "session", "token", "apikey")
SENSITIVE_HEADER_WORDS = (*SENSITIVE_WORDS, "auth", "authenticate", "authentication", "key", "nonce")
SENSITIVE_PATH_MARKERS = ("auth", "code", "key", "password", "secret", "session", "signature", "token")
CREDENTIAL_SCHEMES = ("basic", "bearer", "digest", "negotiate", "ntlm", "aws4-hmac-sha256")
PUBLIC_META_KEYS = ("generator", "application-name")

# Words in paths of internal pages, the better ones first.
EXCLUDED_SEGMENTS = (
    "auth", "login", "log-in", "signin", "sign-in", "signup", "register", "account", "admin", "wp-admin", "cart", "basket",
    "bag", "checkout", "logout", "search", "legal", "privacy", "terms", "policy", "cookie", "cookies",
)
DETAIL_SEGMENTS = ("product", "products", "item", "items")
LISTING_SEGMENTS = ("shop", "store", "catalog", "category", "categories", "collection", "collections", "product-category")

# Names that are not public hosts (special-use registry), reverse zones by rule.
SPECIAL_USE_DOMAINS = (
    "alt", "6tisch.arpa", "eap.arpa", "eap-noob.arpa", "home.arpa", "10.in-addr.arpa", "254.169.in-addr.arpa",
    "16.172.in-addr.arpa", "17.172.in-addr.arpa", "18.172.in-addr.arpa", "19.172.in-addr.arpa", "20.172.in-addr.arpa", "21.172.in-addr.arpa", "22.172.in-addr.arpa", "23.172.in-addr.arpa",
    "24.172.in-addr.arpa", "25.172.in-addr.arpa", "26.172.in-addr.arpa", "27.172.in-addr.arpa", "28.172.in-addr.arpa", "29.172.in-addr.arpa", "30.172.in-addr.arpa", "31.172.in-addr.arpa",
    "170.0.0.192.in-addr.arpa", "171.0.0.192.in-addr.arpa", "168.192.in-addr.arpa", "8.e.f.ip6.arpa", "9.e.f.ip6.arpa", "a.e.f.ip6.arpa", "b.e.f.ip6.arpa", "ipv4only.arpa", "resolver.arpa", "service.arpa", "example", "example.com", "example.net", "example.org",
    "invalid", "local", "localhost", "onion", "test",
)

# Address ranges that are not public.
IPV4_NON_PUBLIC = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "168.63.129.16/32", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.31.196.0/24", "192.52.193.0/24", "192.88.99.0/24", "192.168.0.0/16", "192.175.48.0/24", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
IPV6_PUBLIC = "2000::/3"
IPV6_NON_PUBLIC = ("2001::/23", "2001:db8::/32", "2002::/16", "2620:4f:8000::/48", "3fff::/20")

# Limits.
MAX_HOST = 253
MAX_URL = 2048
MAX_SEGMENT = 64
MATCH_POINTS = 256
VERSION_UNITS = 64
SCRIPT_URLS_PER_DOMAIN = 80
WORK_BUDGET = 500_000
MATCHES_PER_DOMAIN = 20_000
ERRORS_PER_DOMAIN = 128
COOKIE_LIMITS = {"count": 100, "name": 256, "value": 4096, "total": 65536}
DNS_PER_TYPE = 32
DNS_PER_DOMAIN = 128


def rank(column: Column | str, order: tuple[str, ...]) -> Column:
    """Place of a value in an enumeration, from 0; unknown values come last, null stays null."""
    c = F.col(column) if isinstance(column, str) else column
    place = F.array_position(F.array(*[F.lit(x) for x in order]), c)
    return F.when(place > 0, place - 1).when(c.isNotNull(), F.lit(len(order)).cast("long"))


def sql_rank(expr: str, order: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{x}'" for x in order)
    return f"CASE WHEN {expr} IS NULL THEN NULL ELSE coalesce(list_position([{listed}], {expr}) - 1, {len(order)}) END"
