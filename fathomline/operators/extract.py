"""Signals of HTML pages: metadata, addresses, visible text, selected elements.

One pass of a tokenizer per page inside an Arrow-batched map; a page gives one
row with arrays, which callers explode. Only static markup is read.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.functions.normalize import truncate_bytes
from fathomline.session import ensure_workers_import

MAX_ITEMS = 5_000
TEXT_BYTES = 524_288
#: Fixed values of the inspection: matches a selector, bytes a value, bytes of values a page.
MATCHES, VALUE_BYTES, PAGE_VALUE_BYTES = 20, 8_192, 2_097_152
URL_ATTRIBUTES = {"script": "src", "link": "href", "img": "src", "iframe": "src", "a": "href"}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

#: Elements whose start ends an open paragraph, and elements that end others of their kind inside one box.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
BOXES = frozenset("button table td th".split())
_LISTS, _TABLE = frozenset(("ul", "ol", "dl")), frozenset(("table",))
IMPLIED = {
    "li": [("li", _LISTS)], "dt": [("dt", _LISTS), ("dd", _LISTS)], "dd": [("dt", _LISTS), ("dd", _LISTS)], "option": [("option", frozenset(("select",)))],
    "td": [("td", _TABLE | {"tr"}), ("th", _TABLE | {"tr"})], "th": [("td", _TABLE | {"tr"}), ("th", _TABLE | {"tr"})], "tr": [("tr", _TABLE)],
}

_PAIR = pa.struct([("key", pa.string()), ("value", pa.string())])
_URL = pa.struct([("kind", pa.string()), ("url", pa.string())])
_FACT = pa.struct([("locator", pa.string()), ("kind", pa.string()), ("value", pa.string())])


def resolve_url(base: str, raw: str) -> str | None:
    """An http(s) address without user information, port or fragment, resolved against a base."""
    try:
        parts = urlsplit(urljoin(base, raw.strip()))
        if parts.scheme not in ("http", "https") or not parts.hostname or parts.port is not None or "@" in parts.netloc:
            return None
    except ValueError:
        return None
    host = to_ascii_text(parts.hostname)
    return parts._replace(netloc=host, path=parts.path or "/", fragment="").geturl() if host else None


@lru_cache(maxsize=1 << 14)
def to_ascii_text(host: str) -> str | None:
    """A host in its ASCII form without a closing dot; None if a name beyond ASCII has no such form."""
    host = host.lower().removesuffix(".")
    if host.isascii():
        return host
    try:
        return host.encode("idna").decode()
    except UnicodeError:
        return None


#: Names of encodings that stand for a wider one on the web.
WIDER = {"ascii": "cp1252", "us-ascii": "cp1252", "iso-8859-1": "cp1252", "iso8859-1": "cp1252", "latin1": "cp1252", "latin-1": "cp1252", "iso-8859-9": "cp1254", "gb2312": "gbk", "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "euc-kr": "cp949", "tis-620": "cp874"}
_DECLARED = re.compile(rb"""<meta[^>]{0,512}?charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]{1,40})""", re.I)


def body_encoding(body: bytes, charset: str | None) -> str | None:
    """The encoding of a body: its byte order mark, the transport's charset, the one declared in its first 1,024 bytes, else UTF-8.

    None if the transport names an encoding that nobody knows.
    """
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le")):
        if body.startswith(mark):
            return name
    declared = _DECLARED.search(body[:1024])
    for given, name in ((True, charset), (False, declared[1].decode() if declared else None)):
        if name and name.strip():
            plain = name.strip().strip("\"'").lower()
            try:
                found = codecs.lookup(WIDER.get(plain, plain)).name
            except LookupError:
                if given:
                    return None
                continue
            return "utf-8" if not given and found.startswith("utf-16") else found
    return "utf-8"


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())]))
def decode_body(body: pd.Series, charset: pd.Series) -> pd.DataFrame:
    """The text of a response body and the encoding it was read in; bytes that are no text become replacement signs.

    A null body and an unknown charset of the transport give nulls; a byte order
    mark is no part of the text.
    """
    rows = []
    for raw, name in zip(body, charset, strict=True):
        encoding = None if raw is None else body_encoding(bytes(raw), name if isinstance(name, str) else None)
        rows.append((None, None) if encoding is None else (bytes(raw).decode(encoding, "replace").removeprefix("\ufeff"), encoding))
    return pd.DataFrame(rows, columns=["text", "encoding"], dtype=object)


class Selector:
    """The supported part of CSS: ``tag``, ``#id``, ``.class``, ``[name]``, ``[name=v]``, ``[name^=v]``, ``[name*=v]`` and combinations of them."""

    def __init__(self, text: str) -> None:
        pieces = re.findall(r"^[A-Za-z][\w-]*|#[\w-]+|\.[\w-]+|\[[\w-]+(?:[*^$]?=[^\]]*)?\]?", text)
        self.valid = bool(pieces) and "".join(pieces) == text
        self.tag, self.tests = None, []
        for p in pieces:
            if p[0] == "#":
                self.tests.append(("id", "=", p[1:]))
            elif p[0] == ".":
                self.tests.append(("class", "~", p[1:]))
            elif p[0] == "[":
                name, op, value = re.fullmatch(r"\[([\w-]+)(?:([*^$]?)=\"?'?([^\]\"']*)\"?'?)?\]?", p).groups()
                self.tests.append((name.lower(), "?" if value is None else (op or "="), value))
            else:
                self.tag = p.lower()

    def matches(self, tag: str, attributes: dict[str, str]) -> bool:
        if not self.valid or (self.tag and self.tag != tag):
            return False
        for name, op, value in self.tests:
            own = attributes.get(name)
            if own is None:
                return False
            if op == "=" and own != value or op == "~" and value not in own.split() or op == "^" and not own.startswith(value) or op == "$" and not own.endswith(value) or op == "*" and value not in own:
                return False
        return True


class Demand:
    """A locator of dom rules and whether presence or values of it are needed.

    The locator is a bare selector, or in JSON ``[selector, kind, name]`` with
    kind exists, text or attributes. A bare selector is asked for the text of
    its elements (elements that hold none have no text) and for the attributes
    it tests. Properties belong to a running page: static markup has none.
    """

    def __init__(self, locator: str, presence: bool = True, value: bool = False) -> None:
        self.locator, self.presence, self.value = locator, presence, value
        text, self.kind, name = locator, None, None
        if locator.lstrip().startswith('["'):
            try:
                text, self.kind, name = json.loads(locator)
            except ValueError:
                pass
        self.selector = Selector(text)
        self.wants_text = value and self.kind in (None, "text")
        self.attributes = [name] if self.kind == "attributes" else [n for n in dict.fromkeys(t[0] for t in self.selector.tests) if n not in ("id", "class")] if self.kind is None else []

    def matches(self, tag: str, attributes: dict[str, str]) -> bool:
        return self.kind != "properties" and self.selector.matches(tag, attributes) and (self.kind != "attributes" or self.attributes[0].lower() in attributes)


class Demands:
    """Demands by the rarest thing their selector names, so that an element meets few of them."""

    def __init__(self, demands: list[Demand]) -> None:
        self.at: dict[tuple[str, str], list[tuple[int, Demand]]] = {}
        for number, d in enumerate(demands):
            named = next(((n, v) for n, op, v in d.selector.tests if n == "id" and op == "=" or op == "~"), None)
            self.at.setdefault(named or ("", d.selector.tag or ""), []).append((number, d))

    def of(self, tag: str, attributes: dict[str, str]) -> list[Demand]:
        names = [("", ""), ("", tag), ("id", attributes.get("id", "")), *[("class", c) for c in dict.fromkeys(attributes.get("class", "").split())]]
        met = [x for n in names for x in self.at.get(n, ()) if x[1].matches(tag, attributes)]
        return [d for _, d in sorted(met, key=lambda x: x[0])]


class _Page(HTMLParser):
    def __init__(self, final_url: str, demands: Demands) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.based = final_url, False
        self.metadata: dict[tuple[str, str], None] = {}
        self.raw_urls: list[tuple[str, str]] = []
        self.text: list[str] = []
        self.skip: list[str] = []
        self.template = 0
        self.demands = demands
        self.found: list[tuple[Demand, str | None, list[str] | None]] = []  # demand, value, pieces of a text in the making
        self.hits: dict[str, int] = {}
        self.open: list[str] = []
        self.held: dict[str, int] = {}  # how often a tag is open
        self.texts: list[tuple[int, list[str]]] = []  # depth and pieces of the open elements whose text is wanted

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "template":
            self.template += 1
        if self.template:
            return
        a = {k.lower(): v or "" for k, v in reversed(attrs)}
        if tag == "base" and not self.based and "href" in a:
            found = resolve_url(self.base, a["href"])
            if found:
                self.base, self.based = found, True
        if tag == "meta" and "content" in a and len(self.metadata) < MAX_ITEMS:
            key = (a.get("name") or a.get("property") or "").strip().lower()
            if key:
                self.metadata.setdefault((key, a["content"]))
        if a.get(URL_ATTRIBUTES.get(tag, ""), "").strip():
            kind = "stylesheet" if tag == "link" and "stylesheet" in a.get("rel", "").lower().split() else tag
            self.raw_urls.append((kind, a[URL_ATTRIBUTES[tag]]))
        self._close_implied(tag)
        pieces: list[str] | None = None
        for d in self.demands.of(tag, a):
            if self.hits.get(d.locator, 0) >= MATCHES:
                continue
            self.hits[d.locator] = self.hits.get(d.locator, 0) + 1
            if d.wants_text and tag not in VOID:
                pieces = [] if pieces is None else pieces
                self.found.append((d, None, pieces))
            values = [a[n.lower()] for n in d.attributes if n.lower() in a] if d.value else []
            self.found += [(d, v, None) for v in values]
            if not values and not (d.wants_text and tag not in VOID):
                self.found.append((d, None, None))
        if tag not in VOID:
            if pieces is not None:
                self.texts.append((len(self.open), pieces))
            self.open.append(tag)
            self.held[tag] = self.held.get(tag, 0) + 1
        if tag in ("script", "style", "noscript"):
            self.skip.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "template":
            self.template = max(0, self.template - 1)
            return
        if tag in self.skip:
            self.skip.remove(tag)
        if not self.template:
            self._close(tag)

    def _close(self, tag: str, within: frozenset[str] = frozenset()) -> None:
        """Close the innermost open ``tag`` and what stands in it, unless one of ``within`` stands between."""
        if not self.held.get(tag):
            return
        at = len(self.open) - 1
        while self.open[at] != tag:
            if self.open[at] in within:
                return
            at -= 1
        while len(self.open) > at:
            self.held[self.open.pop()] -= 1
        while self.texts and self.texts[-1][0] >= at:
            self.texts.pop()

    def _close_implied(self, tag: str) -> None:
        if tag in ENDS_P:
            self._close("p", BOXES)
        for ends, within in IMPLIED.get(tag, ()):
            self._close(ends, within)

    def facts(self) -> list[tuple[str, str, str | None]]:
        """Facts in reading order; the budget of the page goes to the selectors in their order. A value over a budget leaves its presence where that is needed."""
        out: list[tuple[int, tuple[str, str, str | None] | None]] = []
        spent, spent_up = 0, False
        for at in sorted(range(len(self.found)), key=lambda i: self.found[i][0].locator):
            d, value, pieces = self.found[at]
            value = "".join(pieces) if pieces is not None else value
            fact = (d.locator, "presence", None) if d.presence else None
            if value is not None and not spent_up and (size := len(value.encode("utf-8", "surrogatepass"))) <= VALUE_BYTES:
                if spent + size <= PAGE_VALUE_BYTES:
                    spent += size
                    fact = (d.locator, "value", value)
                else:
                    spent_up = True
            out.append((at, fact))
        return list(dict.fromkeys(f for _, f in sorted(out, key=lambda x: x[0]) if f))

    def handle_data(self, data: str) -> None:
        if not self.template:
            for _, pieces in self.texts:
                pieces.append(data)
        if not self.skip and not self.template:
            self.text.append(data)


def extract_page(html: str, final_url: str, demands: Demands) -> tuple[list, list, str, list]:
    """metadata pairs, (kind, url) pairs, visible text, facts of the demands."""
    page = _Page(final_url, demands)
    page.feed(html)
    page.close()
    urls: dict[tuple[str, str], None] = {}
    for kind, raw in page.raw_urls:
        found = resolve_url(page.base, raw)
        if found:
            urls.setdefault((kind, found))
            if len(urls) >= MAX_ITEMS:
                break
    return list(page.metadata), list(urls), " ".join("".join(page.text).split()), page.facts()


def extract_documents(df: DataFrame, keys: list[str], html: Column | str, final_url: Column | str, selectors: list[str | tuple[str, bool, bool]] = ()) -> DataFrame:
    """keys, metadata, urls, text, facts of every page.

    selectors: locators whose presence is asked for, or (locator, presence needed, value needed).

    Defined cases: null and empty pages give empty arrays and the empty text;
    unclosed elements end with the page; text is cut at 524,288 bytes between
    characters; other columns are ignored.
    """
    ensure_workers_import(df.sparkSession)
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    slim = df.select(*keys, F.coalesce(as_column(html), F.lit("")).alias("_html"), F.coalesce(as_column(final_url), F.lit("")).alias("_url"))
    types = ", ".join(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keys)
    wanted = list(dict.fromkeys(selectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Demands([Demand(*((s,) if isinstance(s, str) else s)) for s in wanted])
        for batch in batches:
            rows = [extract_page(h, u, compiled) for h, u in zip(batch.column("_html").to_pylist(), batch.column("_url").to_pylist(), strict=True)]
            named = lambda at, names: [[dict(zip(names, x, strict=True)) for x in r[at]] for r in rows]
            arrays = [pa.array(named(0, ("key", "value")), pa.list_(_PAIR)), pa.array(named(1, ("kind", "url")), pa.list_(_URL)), pa.array([r[2] for r in rows], pa.string()), pa.array(named(3, ("locator", "kind", "value")), pa.list_(_FACT))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *arrays], names=[*keys, "metadata", "urls", "text", "facts"])

    out = slim.mapInArrow(run, f"{types}, metadata array<struct<key:string,value:string>>, urls array<struct<kind:string,url:string>>, text string, facts array<struct<locator:string,kind:string,value:string>>")
    return out.withColumn("text", truncate_bytes(F.col("text"), TEXT_BYTES))


def json_path_facts(payload: Column, paths: list[str]) -> Column:
    """Facts of dotted paths ``a.b.c`` in a JSON value: present only if every segment exists."""
    facts = [F.struct(F.lit(p).alias("path"), F.get_json_object(payload, "$." + p).alias("value")) for p in paths]
    return F.filter(F.array(*facts), lambda f: f["value"].isNotNull())


def rank_script_bodies(bodies: DataFrame, record: list[str], most: int = 20) -> DataFrame:
    """Script bodies by page, same origin first, address; at most ``most`` of a record."""
    from fathomline.operators.candidates import cap_in_order

    other = F.expr("parse_url(url, 'HOST')") != F.expr("parse_url(page_url, 'HOST')")
    return cap_in_order(bodies, record, ["page_id", F.coalesce(other, F.lit(True)), "url"], most)
