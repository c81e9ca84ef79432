"""Deeply nested, irregular JSON records turned into related flat tables.

Shared inlining. A first pass over all documents collects the graph of element
names: who stands inside whom, which elements repeat and which carry structure.
From the graph a relational plan follows: elements that repeat, are shared by
several parents or contain themselves get their own table; all other elements
become columns of the table around them. A second pass emits one row per table
element with the key of its parent row and its place in the parent's list.

Irregularities are normalised in one place: other spellings of an element name
(case, ``_`` and ``-``), one object where a list is usual, a bare value where an
object is usual, nulls in lists, objects used as dictionaries, wrappers around
the record, and JSON in a JSON string.

Scale: both passes are narrow maps over Arrow batches; only the element graph
(bounded by ``MAX_EDGES``, checked) reaches the driver. Rows are written once,
partitioned by table, so reading a table reads only its own files; the inlined
columns of a row stand in one map.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.session import ensure_workers_import, new_path

MAX_EDGES = 20_000

ROW_SCHEMA = "doc_key long, doc_id long, node_id long, parent_table string, parent_id long, ordinal int, columns map<string,string>, table string"
_ARROW_ROWS = pa.schema([
    ("doc_key", pa.int64()), ("doc_id", pa.int64()), ("node_id", pa.int64()), ("parent_table", pa.string()), ("parent_id", pa.int64()),
    ("ordinal", pa.int32()), ("columns", pa.map_(pa.string(), pa.string())), ("table", pa.string()),
])
_ARROW_EDGES = pa.schema([("parent", pa.string()), ("child", pa.string()), ("repeated", pa.bool_()), ("structured", pa.bool_())])


@dataclass(frozen=True)
class Shape:
    """What is known about the documents beforehand.

    root: name given to the record itself.
    anchor: element that marks the record: wrappers are opened until an object holds it.
    bare: a document without the anchor anywhere is the anchor's content itself.
    dictionaries: element name to (name column, value column) for objects whose
    keys are data; with no value column the entry's own object is extended.
    tables: elements that have their own table whatever the collection holds.
    columns: element with a table to the dotted paths that stand in its row
    whatever the collection holds; of a list the first non-null entry counts.
    """

    root: str
    anchor: str
    bare: bool = False
    dictionaries: Mapping[str, tuple[str, str | None]] = field(default_factory=dict)
    tables: frozenset[str] = frozenset()
    columns: Mapping[str, tuple[str, ...]] = field(default_factory=dict)


def element_name(name: str) -> str:
    """The one spelling under which an element is known."""
    return re.sub(r"[\s_\-]+", "", name).lower()


_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity)|(\Z))')


def load_deep(text: str) -> object:
    """``json.loads`` without recursion, for documents nested deeper than its stack allows."""
    at, stack, key, expect = 0, [], None, "value"
    root: list = []

    def put(value: object) -> None:
        nonlocal key
        top = stack[-1] if stack else root
        if isinstance(top, dict):
            top[key] = value
            key = None
        else:
            top.append(value)

    while True:
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError("no JSON")
        at = found.end()
        sign, string, scalar, end = found.groups()
        if end is not None:
            if stack or expect != "end":
                raise ValueError("cut off")
            return root[0]
        if expect == "end":
            raise ValueError("more than one value")
        if sign in ("{", "["):
            if "value" not in expect:
                raise ValueError("unexpected bracket")
            value: object = {} if sign == "{" else []
            put(value)
            stack.append(value)
            expect = "key or }" if sign == "{" else "value or ]"
        elif sign in ("}", "]"):
            if not stack or expect not in (f"key or {sign}", f"value or {sign}", "comma") or isinstance(stack[-1], dict) != (sign == "}"):
                raise ValueError("unexpected bracket")
            stack.pop()
            expect = "comma" if stack else "end"
        elif sign == ",":
            if expect != "comma":
                raise ValueError("unexpected comma")
            expect = "key" if isinstance(stack[-1], dict) else "value"
        elif sign == ":":
            if expect != "colon":
                raise ValueError("unexpected colon")
            expect = "value"
        elif string is not None and expect.startswith("key"):
            key, expect = json.loads(string), "colon"
        elif "value" in expect:
            put(json.loads(string if string is not None else scalar))
            expect = "comma" if stack else "end"
        else:
            raise ValueError("unexpected value")


def parse(text: str | None) -> object:
    """The document, or None where the text is null, empty, cut off or no JSON. JSON inside a JSON string is opened, however often."""
    value: object = text
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except RecursionError:
            try:
                value = load_deep(value)
            except ValueError:
                return None
        except ValueError:
            return None
    return value


def records(value: object, shape: Shape) -> Iterator[dict]:
    """The records inside a document: wrappers are opened, layer by layer, until one of a layer's objects holds the anchor."""
    layer = [value]
    while layer:
        found, deeper = [], []
        for item in layer:
            if isinstance(item, str):
                item = parse(item)
            if isinstance(item, dict):
                if any(element_name(k) == shape.anchor for k in item):
                    found.append(item)
                else:
                    deeper += [v for v in item.values() if isinstance(v, (dict, list)) or (isinstance(v, str) and v[:1] in "{[")]
            elif isinstance(item, list):
                deeper += [v for v in item if isinstance(v, (dict, list))]
        if found:
            yield from found
            return
        layer = deeper
    if shape.bare and isinstance(value, (dict, list)):
        yield {shape.anchor: value}
    elif isinstance(value, dict):
        yield value
    elif isinstance(value, list):
        yield from (v for v in value if isinstance(v, dict))


def entries(name: str, value: object, shape: Shape) -> object:
    """Dictionary objects as lists of entries; everything else as it is."""
    if name in shape.dictionaries and isinstance(value, dict):
        key_column, value_column = shape.dictionaries[name]
        if value_column is not None:
            return [{key_column: k, value_column: v} for k, v in value.items()]
        return [{key_column: k} | (v if isinstance(v, dict) else {"value": v}) for k, v in value.items()]
    return value


def first_at(value: object, path: list[str]) -> object:
    """The text, number or truth value at a path of element names, the first non-null entry of lists; None if there is none."""
    todo = [(value, 0)]
    while todo:
        item, at = todo.pop()
        if isinstance(item, list):
            todo += [(x, at) for x in reversed(item)]
        elif isinstance(item, dict) and at < len(path):
            todo += [(child, at + 1) for key, child in reversed(item.items()) if element_name(key) == path[at]]
        elif item is not None and not isinstance(item, dict) and at == len(path):
            return item
    return None


def _edges(value: object, name: str, shape: Shape, seen: set) -> None:
    """Add the edges of the element graph below ``value``."""
    todo = [(value, name)]
    while todo:
        item, parent = todo.pop()
        if isinstance(item, list):
            todo += [(x, parent) for x in item if isinstance(x, (dict, list))]
        elif isinstance(item, dict):
            for key, child in item.items():
                tag = element_name(key)
                child = entries(tag, child, shape)
                if isinstance(child, list):
                    seen.add((parent, tag, True, any(isinstance(x, (dict, list)) for x in child)))
                    todo.append((child, tag))
                else:
                    seen.add((parent, tag, False, isinstance(child, dict)))
                    if isinstance(child, dict):
                        todo.append((child, tag))


@dataclass(frozen=True)
class InliningPlan:
    """The elements with their own table; every other element is a column."""

    root: str
    tables: frozenset[str]
    parents: Mapping[str, frozenset[str]]


def plan_inlining(edges: list[tuple[str, str, bool, bool]], root: str, wanted: frozenset[str] = frozenset()) -> InliningPlan:
    """Shared inlining over the element graph; ``wanted`` elements have a table in any case."""
    parents, children, repeated, structured = defaultdict(set), defaultdict(set), set(), set()
    for parent, child, many, nested in edges:
        parents[child].add(parent)
        children[parent].add(child)
        if many:
            repeated.add(child)
        if nested:
            structured.add(child)
    tables = {root} | wanted | repeated | {c for c in structured if len(parents[c]) > 1}
    for start in structured:  # an element that can contain itself
        todo, met = list(children[start]), set()
        while todo:
            at = todo.pop()
            if at == start:
                tables.add(start)
                break
            if at not in met:
                met.add(at)
                todo += children[at]
    return InliningPlan(root, frozenset(tables), {k: frozenset(v) for k, v in parents.items()})


def _text(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def flatten_document(key: int, doc_id: int, value: object, shape: Shape, tables: frozenset[str], out: list[tuple]) -> None:
    """Append the rows of one document to ``out``. The walk keeps its own stack, so no depth is too deep."""
    node = 0
    todo = [(shape.root, record, None, None, at) for at, record in enumerate(records(value, shape))][::-1]
    while todo:
        tag, item, parent_table, parent_id, ordinal = todo.pop()
        columns: dict[str, str] = {}
        out.append((key, doc_id, node, parent_table, parent_id, ordinal, columns, tag))
        below: list[tuple] = []
        inside = [(item, "")]
        while inside:
            part, prefix = inside.pop()
            if not isinstance(part, dict):
                columns.setdefault(prefix[:-1] or "value", _text(part))
                continue
            nested = []
            for name, child in part.items():
                element = element_name(name)
                child = entries(element, child, shape)
                if child is None:
                    continue
                if element in tables:
                    below += [(element, x, tag, node, place) for place, x in enumerate(_leaves(child)) if x is not None]
                elif isinstance(child, dict):
                    nested.append((child, f"{prefix}{element}."))
                else:
                    columns.setdefault(prefix + element, _text(child))
            inside += nested[::-1]
        for path in shape.columns.get(tag, ()):
            if path not in columns and (found := first_at(item, path.split("."))) is not None:
                columns[path] = _text(found)
        todo += below[::-1]
        node += 1


def _leaves(value: object) -> Iterator[object]:
    """The entries of a list, those of lists inside it among them; a lone value is its own entry."""
    stack = [iter(value if isinstance(value, list) else [value])]
    while stack:
        for x in stack[-1]:
            if isinstance(x, list):
                stack.append(iter(x))
                break
            yield x
        else:
            stack.pop()


@dataclass
class FlatTables:
    """The flat tables of one document collection, written under ``path``."""

    df: DataFrame
    plan: InliningPlan
    path: str

    def table(self, name: str, columns: Mapping[str, str] | None = None) -> DataFrame:
        """The keys of the rows and the wanted inlined columns.

        (doc_key, node_id) identifies a row; (doc_key, parent_id) is its parent
        in ``parent_table``; ``ordinal`` is its place there, nulls counted.
        """
        base = self.df.where(F.col("table") == name)
        picked = [F.col("columns")[source].alias(alias) for alias, source in (columns or {}).items()]
        return base.select("doc_key", "doc_id", "node_id", "parent_table", "parent_id", "ordinal", *(picked or ["columns"]))


def flatten_json(df: DataFrame, doc_id: Column | str, payload: Column | str, shape: Shape) -> FlatTables:
    """Turn JSON documents into related flat tables.

    Defined cases: a null, empty or cut-off payload, or one that is no JSON,
    gives no rows; an empty object gives a root row without columns; of two
    spellings of one element in an object the first non-null counts; a repeated
    document id gives the rows of each of its documents, kept apart by
    ``doc_key``; nesting has no limit; other columns of ``df`` are ignored,
    whatever their names.
    """
    spark = df.sparkSession
    ensure_workers_import(spark)
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    slim = df.select(F.monotonically_increasing_id().alias("doc_key"), as_column(doc_id).cast("long").alias("doc_id"), as_column(payload).alias("payload"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for text in batch.column("payload").to_pylist():
                for record in records(parse(text), shape):
                    _edges(record, shape.root, shape, seen)
        columns = list(zip(*sorted(seen), strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW_EDGES.types, strict=True)], schema=_ARROW_EDGES)

    graph = slim.mapInArrow(scan, "parent string, child string, repeated boolean, structured boolean").distinct().limit(MAX_EDGES + 1).collect()
    if len(graph) > MAX_EDGES:
        raise ValueError("too many element names: name the elements whose keys are data in Shape.dictionaries")
    plan = plan_inlining([tuple(r) for r in graph], shape.root, shape.tables)
    tables = plan.tables

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            columns[6] = [list(m.items()) for m in columns[6]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW_ROWS.types, strict=True)], schema=_ARROW_ROWS)

        for batch in batches:
            rows: list[tuple] = []
            for key, doc, text in zip(*(batch.column(c).to_pylist() for c in ("doc_key", "doc_id", "payload")), strict=True):
                flatten_document(key, doc, parse(text), shape, tables, rows)
                if len(rows) >= 20_000:
                    yield pack(rows)
                    rows = []
            if rows:
                yield pack(rows)

    path = new_path(spark, "flat")
    slim.mapInArrow(emit, ROW_SCHEMA).write.partitionBy("table").parquet(path)
    flat = spark.read.schema(ROW_SCHEMA).parquet(path)
    return FlatTables(flat, plan, path)
