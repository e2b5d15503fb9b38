"""Shared inlining: deeply nested JSON records to flat tables that keep their parent-child links.

Three steps.

1. ``schema_graph`` walks every record once and aggregates, per place in the tree, which kinds of values
   stand there (object, list, text, number, ...) and which member names objects have. A place is the chain
   of member names, with ``[]`` for list items; the graph has one row per edge, however many records there
   are.
2. ``plan_tables`` analyses that graph on the driver. A member that is a list anywhere is a *repeated*
   element and gets a table of its own; so does one that stands under several parents (*shared*) or below
   itself (*recursive*). Members that only ever occur once per parent are *inlined* as columns. Where the
   same element is a list in some records and an object in others, the member names decide: if they are
   the names of the items themselves it is a lone item, otherwise it is a collection keyed by name.
3. ``flatten`` walks every record again along that plan and emits one row per object with its own number,
   its parent's number, its position in the parent's list and its key.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The schema graph is a property of the formats, not of the rows; more edges than this mean that data were
#: taken for member names, and the operator refuses instead of filling the driver.
MAX_EDGES = 1_000_000
#: Places deeper than this are no part of the schema graph: what stands there is kept as JSON text in the deepest
#: table above it, and ``reading`` counts the records. Deeper than the parser can go a record is unreadable.
MAX_DEPTH = 400
#: A plain member of fewer than this share of the records of its place is taken for data, not for a name.
RARE = 0.001

NODE_SCHEMA = (
    "_key bigint, element string, node bigint, parent bigint, pos bigint, name string, label string, attrs string, "
    "up array<struct<element string, node bigint, pos bigint, label string>>"
)


def _no_constant(name: str) -> float:
    raise ValueError(f"{name} is no JSON")


def parse(text: str | None) -> object | None:
    """The JSON object or list of ``text``; None if it is null, cut off, not JSON or nested beyond reason."""
    if not text:
        return None
    try:
        value = json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict | list) else None


def _embedded(value: object) -> object:
    """A list or object that was written as a string inside the record."""
    if isinstance(value, str) and value[:1] in ("[", "{") and value[-1:] in ("]", "}"):
        inner = parse(value)
        return value if inner is None else inner
    return value


def _type(value: object) -> str | None:
    """Edge kind that tells the type of a plain value."""
    if isinstance(value, bool):
        return "type:bool"
    return "type:int" if isinstance(value, int) else "type:float" if isinstance(value, float) else "type:text" if isinstance(value, str) else None


def _kind(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "list"
    return "scalar"


def _edges(root: object, types: bool) -> set[tuple[tuple[str, ...], str, str]]:
    """(place, member, kind) of one record, with the types of plain values if wanted; a place is a tuple of member names and '[]'."""
    out: set[tuple[tuple[str, ...], str, str]] = set()
    todo: list[tuple[tuple[str, ...], object]] = [((), root)]
    while todo:
        place, value = todo.pop()
        if len(place) > MAX_DEPTH:
            continue
        named = value.items() if isinstance(value, dict) else (("[]", item) for item in value)
        for name, member in named:
            member = _embedded(member)
            kind = _kind(member)
            out.add((place, name, kind))
            if kind in ("object", "list"):
                if member:
                    todo.append(((*place, name), member))
            elif types and name != "[]" and (plain := _type(member)) is not None:
                out.add((place, name, plain))
    return out


def schema_graph(df: DataFrame, payload: str, types: bool = False) -> DataFrame:
    """``place, member, kind, records`` over all readable records (one row per edge), with edges for the types of plain values if wanted."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            records: Counter = Counter()
            for text in pdf[payload]:
                root = parse(text)
                if root is not None:
                    records.update(_edges(root, types))
            if records:
                yield pd.DataFrame(
                    [("/".join(p.replace("/", "~1") for p in place), member, kind, n) for (place, member, kind), n in records.items()],
                    columns=["place", "member", "kind", "records"],
                )

    edges = df.select(payload).mapInPandas(walk, "place string, member string, kind string, records bigint")
    counted = edges.groupBy("place", "member", "kind").agg(F.sum("records").alias("records"))
    # Plain members that are rare at their place are data used as names (files, authors): they become '*',
    # so that the graph stays as small as the formats are.
    most = F.max("records").over(Window.partitionBy("place"))
    rare = (F.col("kind").isin("scalar", "null") | F.startswith("kind", F.lit("type:"))) & (F.col("records") < RARE * F.col("most")) & (F.col("member") != "[]")
    return (
        counted.withColumn("most", most)
        .withColumn("member", F.when(rare, F.lit("*")).otherwise(F.col("member")))
        .groupBy("place", "member", "kind")
        .agg(F.sum("records").alias("records"))
    )


@dataclass(frozen=True)
class Element:
    """One table of the plan."""

    name: str
    members: frozenset[str]
    """Member names under which the element stands."""
    keyed: frozenset[str] = frozenset()
    """Places (by member name) at which an object may be a collection keyed by name."""
    item_names: frozenset[str] = frozenset()
    """Member names of the items: an object with any of them is a lone item."""


@dataclass(frozen=True)
class Plan:
    elements: dict[str, Element] = field(default_factory=dict)
    open_members: frozenset[str] = frozenset()
    """Members that are objects in some records and plain values in others: kept as JSON text."""

    def of_member(self, member: str) -> Element | None:
        return self.elements.get(member)


def plan_tables(edges: Iterable[tuple[str, str, str, int]], merge: dict[str, str] | None = None) -> Plan:
    """The tables for a schema graph (rows ``place, member, kind, records``).

    ``merge`` gives several member names one element (``{"category_scores": "category"}``); a member that
    is not in it is its own element. Only members that hold objects become tables: lists of plain values
    stay inlined as JSON text.
    """
    merge = merge or {}
    listed: Counter = Counter()
    parents: dict[str, set[str]] = defaultdict(set)
    items: dict[str, Counter] = defaultdict(Counter)
    objects: dict[str, Counter] = defaultdict(Counter)
    holds: set[str] = set()
    as_object: Counter = Counter()
    plain: Counter = Counter()
    recursive: set[str] = set()
    for place, member, kind, n in edges:
        parts = place.split("/") if place else []
        if kind.startswith("type:"):
            continue
        if member == "[]":
            if parts and kind == "object":
                holds.add(parts[-1])
            continue
        last = parts[-1] if parts else ""
        if last == "[]" and len(parts) > 1:
            items[parts[-2]][member] += n
        elif last:
            objects[last][member] += n
        if kind == "list":
            listed[member] += n
        elif kind == "object":
            as_object[member] += n
        elif kind == "scalar":
            plain[member] += n
        if kind in ("list", "object"):
            parents[member].add(next((p for p in reversed(parts) if p != "[]"), ""))
            if member in parts:
                recursive.add(member)
    elements: dict[str, Element] = {}
    groups: dict[str, set[str]] = defaultdict(set)
    for member in {m for m in listed if m in holds} | (recursive & set(as_object)) | {m for m in merge if m in listed or m in as_object}:
        groups[merge.get(member, member)].add(member)
    for name, members in groups.items():
        # An item's own names occur in most items; rare ones may be keys that happen to look alike.
        names: Counter = Counter()
        for m in members:
            names.update(items[m])
        most = max(names.values(), default=0)
        item_names = frozenset(k for k, n in names.items() if n >= RARE * most and k != '*')
        keyed = frozenset(m for m in members if as_object[m] and sum(objects[m][k] for k in objects[m] if k not in item_names) > 0)
        for m in members:
            elements[m] = Element(name, frozenset(members), keyed, item_names)
    opened = frozenset(m for m in as_object if m not in elements and (plain[m] or listed[m]))
    return Plan(elements, opened)


def collect_plan(graph: DataFrame, merge: dict[str, str] | None = None) -> Plan:
    """``plan_tables`` of a graph frame; the graph must stay under ``MAX_EDGES`` edges."""
    rows = graph.limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} edges: member names of these records are data; name the keyed places in `merge`")
    return plan_tables([(r[0], r[1], r[2], r[3]) for r in rows], merge)


def _entries(value: object, element: Element, member: str) -> Iterator[tuple[int, str | None, object]]:
    """(position, key, item) of what stands at a member of ``element``."""
    value = _embedded(value)
    if isinstance(value, list):
        for pos, item in enumerate(value):
            yield pos, None, _embedded(item)
    elif isinstance(value, dict):
        if member in element.keyed and not (value.keys() & element.item_names):
            for pos, (name, item) in enumerate(value.items()):
                yield pos, name, item
        else:
            yield 0, None, value


def _inline(prefix: str, value: dict, plan: Plan, attrs: dict, below: list) -> None:
    """Singleton descendants as columns ``a_b``; members that have a table are put aside in ``below``."""
    for name, member in value.items():
        element = plan.of_member(name)
        key = f"{prefix}{name}"
        if element is not None and isinstance(_embedded(member), dict | list):
            below.append((element, name, member))
        elif element is not None and member is None:
            continue
        elif isinstance(member, dict) and member and name not in plan.open_members:
            _inline(key + "_", member, plan, attrs, below)
        else:
            attrs[key] = member


def _label(attrs: dict, key: str | None, names: tuple[str, ...]) -> str:
    """What an item is called: the first present of ``names``, where '' stands for its key."""
    for name in names:
        value = key if name == "" else attrs.get(name)
        if value is not None:
            return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return ""


def rows_of(root: object, plan: Plan, labels: dict[str, tuple[str, ...]]) -> Iterator[tuple[str, int, int, int, str | None, str, dict, list]]:
    """(element, node, parent, position, key, label, attributes, ancestors) of one record, parents first.

    Node 0 is the record itself. A keyed entry whose value is no object has its value in ``value``.
    """
    count = 0
    attrs: dict = {}
    below: list = []
    for item in root if isinstance(root, list) else [root]:
        if isinstance(item, dict):
            _inline("", item, plan, attrs, below)
    yield "record", 0, -1, 0, None, "", attrs, []
    todo = [(0, [], e, m, v) for e, m, v in reversed(below)]
    while todo:
        parent, up, element, member, value = todo.pop()
        later = []
        for pos, key, item in _entries(value, element, member):
            if not isinstance(item, dict):
                if key is None:
                    continue
                item = {"value": item}
            elif key is not None and element.item_names and not (item.keys() & element.item_names):
                item = {"value": item}
            count += 1
            attrs, below = {}, []
            _inline("", item, plan, attrs, below)
            label = _label(attrs, key, labels.get(element.name, ("",)))
            yield element.name, count, parent, pos, key, label, attrs, up
            here = [*up, (element.name, count, pos, label)]
            later += [(count, here, e, m, v) for e, m, v in below]
        todo += reversed(later)


def flatten(
    df: DataFrame, key: str, payload: str, plan: Plan, labels: dict[str, tuple[str, ...]] | None = None, only: Iterable[str] | None = None, attributes: bool = True
) -> DataFrame:
    """One row per object of every readable record (``NODE_SCHEMA``), or of the elements in ``only``; without ``attributes`` these are null.

    ``(_key, node)`` identifies a row, ``(_key, parent)`` its parent. ``pos`` is the position in the
    parent's list (0 for a lone object), ``name`` the key in a keyed collection, ``label`` what ``labels``
    call the item (member names in order of preference, '' for the key), ``attrs`` the inlined members as
    JSON text and ``up`` the ancestors from the top, so that no join is needed to link the tables.

    Null, empty, cut-off and non-JSON payloads give no row; null list items keep their position but give no
    row; plain values in a list of objects give no row; of a repeated member name the last value counts;
    repeated records give their rows again under their own key.
    """
    names = labels or {}
    wanted = None if only is None else frozenset(only)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["_key", "element", "node", "parent", "pos", "name", "label", "attrs", "up"]
        for pdf in batches:
            for start in range(0, len(pdf), 200):
                part, out, last, chain = pdf.iloc[start : start + 200], [], None, []
                for k, text in zip(part[key], part[payload], strict=True):
                    root = parse(text)
                    if root is None:
                        continue
                    for element, node, parent, pos, name, label, attrs, up in rows_of(root, plan, names):
                        if wanted is not None and element not in wanted:
                            continue
                        if up is not last:  # items of one list share their ancestors
                            last, chain = up, [dict(zip(("element", "node", "pos", "label"), u, strict=True)) for u in up]
                        out.append((k, element, node, parent, pos, name, label, json.dumps(attrs, ensure_ascii=False) if attributes else None, chain))
                if out:
                    yield pd.DataFrame(out, columns=columns)

    return df.select(key, payload).filter(F.col(payload).isNotNull()).mapInPandas(walk, NODE_SCHEMA)


def inline_columns(graph_rows: Iterable[tuple[str, str, str, int]], plan: Plan, element: str) -> dict[str, str]:
    """Names and Spark types of the columns that ``flatten`` inlines into ``element``, from the graph alone.

    A column of one type of numbers or truth values has it; mixed ones, texts and JSON are strings. ``record`` is the
    table of the records themselves.
    """
    kinds: dict[str, set[str]] = defaultdict(set)
    for place, member, kind, _ in graph_rows:
        parts = [p for p in (place.split("/") if place else []) if p != "[]"]
        at = max((i for i, p in enumerate(parts) if plan.of_member(p)), default=-1)
        owner = plan.of_member(parts[at]) if at >= 0 else None
        if (owner.name if owner else "record") != element or member in ("[]", "*") or kind == "object" and member not in plan.open_members:
            continue
        inner = parts[at + 1 :]
        if owner is not None and member in owner.members or plan.of_member(member) or any(p in plan.open_members for p in inner):
            continue
        if owner is not None and owner.keyed and not inner and member not in owner.item_names:
            continue  # the key of a keyed collection
        if owner is not None and owner.keyed and inner and inner[0] not in owner.item_names:
            inner = inner[1:]
            if (inner[0] if inner else member) not in owner.item_names:  # an entry that is itself a value
                if "value" in plan.open_members:
                    kinds["value"].add("object")
                    continue
                inner = ["value", *inner]
        kinds["_".join([*inner, member])].add(kind)
    types = {frozenset({"type:int"}): "bigint", frozenset({"type:float"}): "double", frozenset({"type:int", "type:float"}): "double", frozenset({"type:bool"}): "boolean"}
    out = {}
    for name, seen in sorted(kinds.items()):
        plain = frozenset(k for k in seen if k.startswith("type:"))
        out[name] = "string" if seen & {"list", "object"} else types.get(plain, "string")
    return out


def _depth(text: str) -> int:
    """Brackets that are open at once, outside of strings."""
    depth = most = 0
    inside = escaped = False
    for c in text:
        if inside:
            inside, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"':
            inside = True
        elif c in "[{":
            depth += 1
            most = max(most, depth)
        elif c in "]}":
            depth -= 1
    return most


def reading(df: DataFrame, key: str, payload: str) -> DataFrame:
    """``key, outcome``: whether a record was ``read``, has parts that are too ``deep`` for the graph, is ``null``, ``empty`` or ``unreadable``."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf[payload]:
                if not text:
                    out.append("null" if text is None else "empty")
                elif parse(text) is None:
                    out.append("unreadable")
                else:
                    brackets = text.count("[") + text.count("{")
                    out.append("deep" if brackets > MAX_DEPTH and _depth(text) > MAX_DEPTH else "read")
            yield pd.DataFrame({"_key": pdf[key], "outcome": out})

    return df.select(key, payload).mapInPandas(walk, "_key bigint, outcome string").withColumnRenamed("_key", key)
