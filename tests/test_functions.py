from pyspark.sql import functions as F

from fathomline.functions import normalize as N
from fathomline.functions import redact as R
from fathomline.functions.text import present, same_value


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_same_value(spark):
    assert values(spark, ["  Ab\t", " É ", "", None, "\t "], same_value) == ["ab", "é", "", None, ""]
    assert values(spark, ["", "x ", None], present) == [None, "x", None]


def test_hostnames(spark):
    good = {"Shop.Vendor.TLD.": "shop.vendor.tld", "public.arpa": "public.arpa", "BÜCHER.DE": "xn--bcher-kva.de", "bücher。de": "xn--bcher-kva.de", "a" * 63 + ".tld": "a" * 63 + ".tld"}
    bad = ["localhost", "vendor.123", "vendor..tld", "vendor.tld..", "-vendor.tld", "ven_dor.tld", "a" * 64 + ".tld", "127.1", "0x7f000001", "a.0x1", "a b.tld", "a .tld", "%2e.tld", "v.tld:80", "v.tld/x", "", None, "x.test", "home.arpa"]
    df = spark.createDataFrame([(h, "old") for h in [*good, *bad]], "raw string, host string")
    got = {r.raw: r.host for r in N.normalize_hostnames(df, "raw").collect()}
    assert {h: got[h] for h in good} == good and all(got[h] is None for h in bad)


def test_targets_and_addresses(spark):
    assert values(spark, ["vendor.tld", "www.vendor.tld"], N.target_candidates) == [["https://vendor.tld/", "https://www.vendor.tld/", "http://vendor.tld/", "http://www.vendor.tld/"], ["https://www.vendor.tld/", "http://www.vendor.tld/"]]
    assert values(spark, ["8.8.8.8", "10.1.2.3", "168.63.129.16", "172.31.0.1", "172.32.0.1", "255.255.255.255", "1.2.3", "01.2.3.4", None], N.is_public_ipv4) == [True, False, False, False, True, False, None, None, None]
    assert values(spark, ["2a00::1", "2001:db8::1", "::1", "fe80::1", "x", None], N.is_public_ipv6) == [True, False, False, False, None, None]


def test_http_parts(spark):
    heads = ["text/html; charset=UTF-8", 'Text/HTML;charset="utf-8"', "text", "text/html; x", None, "application/json"]
    assert values(spark, heads, N.media_type) == ["text/html", "text/html", None, None, None, "application/json"]
    assert values(spark, heads, N.charset) == ["utf-8", "utf-8", None, None, None, None]
    cookies = ["a=b; Path=/", 'a="b c"', 'a="b"', "=x", "novalue", "a=", None]
    assert values(spark, cookies, N.cookie_name) == ["a", None, "a", None, None, "a", None]
    assert values(spark, cookies, N.cookie_value) == ["b", None, "b", None, None, "", None]
    wait = lambda c: N.retry_after_ms(c, F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    assert values(spark, ["0", "5", "99999", "Thu, 01 Jan 2026 00:00:10 GMT", "soon", None], wait) == [100, 5000, 30000, 10000, None, None]


def test_truncation(spark):
    for text in ("abc", "aéb日本\U0001f600", "", "日"):
        for n in range(12):
            assert values(spark, [text], lambda c: N.truncate_bytes(c, n)) == [text.encode()[:n].decode(errors="ignore")]


def test_dns_values(spark):
    rows = [("MX", '{"exchange": "Mail.V.tld.", "priority": 1}', "mail.v.tld"), ("TXT", '["a", "b"]', "ab"), ("CAA", '{"critical": 0, "issue": "ca.tld"}', "issue=ca.tld"), ("NS", "NS1.V.tld.", "ns1.v.tld"), ("A", "1.2.3.4", "1.2.3.4"), ("TXT", "[" + '"' + "x" * 5000 + '"]', None), ("SRV", "{}", None), (None, "x", None)]
    got = [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, raw string, want string").orderBy("i").select(N.normalize_dns(F.col("k"), F.col("raw"))).collect()]
    assert got == [r[2] for r in rows]


def test_sensitive_text(spark):
    assert values(spark, ["my session id", "sessions", "api key", "api-key", "apikeys", "x" * 24, "f" * 16, "f" * 15, None], R.is_sensitive) == [True, False, True, True, False, True, True, False, None]
    assert values(spark, ["Bearer abc", "x-bearer abc", "basic", "ntlm\tz"], R.has_credential) == [True, False, False, True]


def test_urls(spark):
    clean = lambda *urls: [r and (r.url, r.collapsed) for r in values(spark, list(urls), R.sanitize_url)]
    (url, collapsed), = clean("https://user:pw@Vendor.TLD/api/token/0123456789abcdef?id=7&session=1#frag")
    assert url == "https://vendor.tld/%5Bredacted%5D/%5Bredacted%5D/%5Bredacted%5D?id=%5Bredacted%5D&%5Bredacted%5D=%5Bredacted%5D" and not collapsed
    assert clean(url)[0][0] == url
    assert clean("https://v.tld/monkey", " HTTP://v.tld:80 ", "https://v.tld:8443/a//b/") == [("https://v.tld/monkey", False), ("http://v.tld/", False), ("https://v.tld:8443/a//b/", False)]
    assert clean("https://v.tld/a/./b/../c", "https://v.tld/a/..", "https://v.tld\\a%2Fb/x", "https://v.tld/a%/b+c") == [("https://v.tld/a/c", False), ("https://v.tld/", False), ("https://v.tld/%5Bredacted%5D/x", False), ("https://v.tld/%5Bredacted%5D/%5Bredacted%5D", False)]
    assert clean("https://v.tld/?a+b=1&&c", "https://v.tld/?#x") == [("https://v.tld/?a+b=%5Bredacted%5D&c=%5Bredacted%5D", False), ("https://v.tld/", False)]
    assert clean("ftp://v.tld/", "https://v.tld/" + "a" * 3000, "", None, "https:///x", "https://v.tld:99999/", "https://v.tld:x/") == [None] * 7
    assert clean("https://v.tld/?" + "&".join(f"k{i}=1" for i in range(280))) == [("https://v.tld/%5Bredacted%5D", True)]


def test_evidence_values(spark):
    rows = [
        ("header", "server", "nginx/1.2", "nginx/1", "value", "nginx/1"), ("header", "set-cookie", "a=b", "a", "redacted", None), ("header", "server", "Bearer xyz", "x", "redacted", None),
        ("meta", "generator", "Tool 1", "Tool", "value", "Tool"), ("meta", "author", "Me", "Me", "redacted", None), ("cookie", "sid", "v", "v", "redacted", None), ("html", None, "<b>", "b", "redacted", None),
        ("dns_record", "A", "8.8.8.8", "8", "value", "8.8.8.8"), ("dns_record", "A", "10.0.0.1", "1", "redacted", None), ("dns_record", "MX", "mx.vendor.tld", "mx", "value", "mx.vendor.tld"), ("dns_record", "TXT", "x", "x", "redacted", None),
        ("tls_issuer", None, "Some CA", "CA", "value", "CA"), ("header", "server", "", "", "redacted", None), (None, None, None, None, "redacted", None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, k string, o string, m string, kind string, v string").orderBy("i")
    none = F.lit(None).cast("struct<url:string,collapsed:boolean>")
    got = [(r[0].kind, r[0].value) for r in df.select(R.evidence_match(F.col("s"), F.col("k"), F.col("o"), F.col("m"), none)).collect()]
    assert got == [r[4:] for r in rows]


def test_versions(spark):
    rows = [("\\1", ["1.2"], "1.2"), ("\\1?yes:no", ["x"], "yes"), ("\\1?yes:no", [""], "no"), ("v\\2.\\1", ["1", "2"], "v2.1"), (" \\1 ", ["3"], "3"), ("\\1", [""], None), ("\\1", ["a b"], None), ("\\1", ["f" * 20], None), (None, ["1"], None), ("\\3", ["1"], None)]
    df = spark.createDataFrame([(i, t, g) for i, (t, g, _) in enumerate(rows)], "i int, t string, g array<string>").orderBy("i")
    assert [r[0] for r in df.select(R.render_version(F.col("t"), F.col("g"))).collect()] == [r[2] for r in rows]


def test_network_hosts_and_admission(spark):
    from fathomline.plans.signals import URLS

    got = values(spark, [u for u, _, _ in URLS] + [None, "https://[zz]/"], N.network_host)
    assert [r and (r.host, r.family) for r in got] == [(h, f) if h else None for _, h, f in URLS] + [None, None]
    rows = [([("8.8.8.8", True), ("1.1.1.1", True)], (True, None)), ([("8.8.8.8", True), ("10.0.0.1", False)], (False, "SSRF_MIXED_ADDRESSES")), ([("10.0.0.1", False)], (False, "SSRF_NON_PUBLIC_ADDRESS")), ([], (False, "DNS_NO_ADDRESS")), (None, (False, "DNS_NO_ADDRESS")), ([(None, None)], (False, "DNS_NO_ADDRESS"))]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, a array<struct<address:string,is_public:boolean>>").orderBy("i")
    assert [tuple(r[0]) for r in df.select(N.admit_addresses(F.col("a"))).collect()] == [r[1] for r in rows]
