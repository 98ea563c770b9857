"""Nested JSON records as adjacency rows, and entity tables made from them.

``shred`` turns every payload into rows (node, parent, label, ordinal, scalar). Everything after it
is relational: object nodes meet their scalar children by a grouping on the object's node, which
pivots the scalars into columns, and meet their parents by a join on (document, node).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemicycle.session import materialise

NODES = "document bigint, source bigint, node int, parent int, label string, ordinal int, is_object boolean, scalar string"
_ARROW = pa.schema([("document", pa.int64()), ("source", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("label", pa.string()), ("ordinal", pa.int32()), ("is_object", pa.bool_()), ("scalar", pa.string())])
#: Label of the scalar child that holds the key under which an object stood in a map.
MAP_KEY = "@key"
#: Rows of one Arrow batch that leave the parser.
BATCH_ROWS = 50_000


@lru_cache(65_536)
def plain_label(name: str) -> str:
    """Letters and digits in lower case: the same for camelCase, PascalCase and snake_case."""
    return re.sub(r"[\W_]+", "", name.lower())


_TOKEN = re.compile(r'[ \t\r\n]*(?:([\[\]{},:])|("(?:[^"\\]|\\.)*")|([^\s\[\]{},:"]+))', re.DOTALL)


def _parsed_deep(text: str):
    """What ``json.loads`` gives, for texts that are nested more deeply than it can follow; the open arrays and objects are a list."""
    root, at, end = [], 0, len(text.rstrip(" \t\r\n"))
    open_now: list = [root]
    keys: list = [None]
    state = "value"  # then: first (a value or the end), comma (or the end), key, first key (or the end), colon
    while at < end:
        token = _TOKEN.match(text, at)
        if token is None:
            raise ValueError("not JSON")
        at = token.end()
        mark, quoted, plain = token.groups()
        if mark in ("]", "}"):
            if len(open_now) == 1 or isinstance(open_now[-1], list) != (mark == "]") or state not in ("first", "first key", "comma"):
                raise ValueError("not JSON")
            open_now.pop(), keys.pop()
            state = "comma"
        elif mark == "," and state == "comma" and len(open_now) > 1:
            state = "value" if isinstance(open_now[-1], list) else "key"
        elif mark == ":" and state == "colon":
            state = "value"
        elif state in ("key", "first key") and quoted:
            keys[-1] = json.loads(quoted)
            state = "colon"
        elif state in ("value", "first") and mark not in (",", ":"):
            value = ([] if mark == "[" else {}) if mark else json.loads(quoted or plain)
            if isinstance(open_now[-1], list):
                open_now[-1].append(value)
            else:
                open_now[-1][keys[-1]] = value
            state = "comma"
            if mark:
                open_now.append(value), keys.append(None)
                state = "first" if mark == "[" else "first key"
        else:
            raise ValueError("not JSON")
    if len(open_now) > 1 or len(root) != 1:
        raise ValueError("not JSON")
    return root[0]


def _parsed(text: str):
    """The value of a JSON text, however deep; None for what breaks off."""
    text = text.lstrip("\ufeff \t\r\n")
    try:
        return json.loads(text)
    except RecursionError:
        pass
    except ValueError:
        return None
    try:
        return _parsed_deep(text)
    except ValueError:
        return None


def _written(value) -> str | None:
    if isinstance(value, str):
        return value
    if value is None or isinstance(value, bool):
        return None if value is None else "true" if value else "false"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 2**63 else repr(value)
    return str(value)


def _walk(value, containers: frozenset[str], wanted: frozenset[str] | None = None) -> list[tuple]:
    """(node, parent, label, ordinal, is_object, scalar) of all objects and of the scalars under ``wanted`` labels (None: all).

    Arrays, JSON within strings, ``{"$values": [...]}`` and maps from keys to objects under a label
    of ``containers`` are wrappers: their members stand directly below the enclosing object. Numbers
    of nodes do not depend on ``wanted``.
    """
    count = 0
    rows: list[tuple] = []
    stack = [(value, 0, "", 0, None)]
    while stack:
        value, parent, label, ordinal, key = stack.pop()
        if isinstance(value, str) and (not label or label in containers and value.lstrip("\ufeff \t\r\n")[:1] in ("{", "[")):
            value = _parsed(value)
        if isinstance(value, list):
            stack.extend((x, parent, label, i, None) for i, x in zip(range(len(value) - 1, -1, -1), reversed(value), strict=True))
            continue
        count += 1
        if not isinstance(value, dict):
            if wanted is None or label in wanted:
                rows.append((count, parent, label, ordinal, False, _written(value)))
            continue
        if "$values" in value:
            count -= 1
            stack.append((value["$values"], parent, label, ordinal, None))
            continue
        if value and label in containers and all(isinstance(x, dict) and k.isascii() and k.isdigit() for k, x in value.items()):
            count -= 1
            stack.extend((x, parent, label, i, k) for i, (k, x) in reversed(list(enumerate(value.items()))))
            continue
        node = count
        rows.append((node, parent, label, ordinal, True, None))
        if key is not None:
            count += 1
            rows.append((count, node, MAP_KEY, 0, False, key))
        nested = []
        for name, x in value.items():
            named = plain_label(name)
            if isinstance(x, dict | list) or named in containers and isinstance(x, str):
                nested.append((x, node, named, 0, None))
            else:
                count += 1
                if wanted is None or named in wanted:
                    rows.append((count, node, named, 0, False, _written(x)))
        stack.extend(reversed(nested))
    return rows


def shred(records: DataFrame, record_id: str, payload: str, containers: frozenset[str], wanted: Iterable[str] | None = None) -> DataFrame:
    """The adjacency rows of all payloads, columns as in NODES: all objects, and the scalars under the plain labels ``wanted`` (None: all).

    A document is a record_id (-1 for null) with the hash of a payload; deliveries that are equal in
    both are one document. A payload that is null, empty, not JSON or broken off yields no row, one
    that is nested however deep yields all of its rows. ``containers`` are the plain labels whose
    strings and maps are read as nested objects. A null scalar is a row with null.
    """
    kept = None if wanted is None else frozenset(wanted)

    def as_batch(rows: list[tuple], documents: list[tuple[int, int, int]]) -> pa.RecordBatch:
        document, source, n = (np.array(c, np.int64) for c in zip(*documents, strict=True))
        columns = [np.repeat(document, n), np.repeat(source, n), *zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        documents: list[tuple[int, int, int]] = []
        for batch in batches:
            for document, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                value = None if text is None else _parsed(text)
                if isinstance(value, str):
                    value = _parsed(value)
                if not isinstance(value, dict | list):
                    continue
                own = _walk(value, containers, kept)
                for s in range(0, len(own), BATCH_ROWS):
                    part = own[s : s + BATCH_ROWS]
                    rows += part
                    documents.append((document, source, len(part)))
                    if len(rows) >= BATCH_ROWS:
                        yield as_batch(rows, documents)
                        rows, documents = [], []
        if rows:
            yield as_batch(rows, documents)

    documents = records.select(F.xxhash64(record_id, payload).alias("document"), F.coalesce(F.col(record_id).cast("bigint"), F.lit(-1)).alias("source"), F.col(payload).alias("payload"))
    return documents.mapInArrow(parse, NODES)


def entities(nodes: DataFrame, roles: Mapping[str, str], scalars: Mapping[str, str]) -> DataFrame:
    """One row per object that plays a role: document, source, node, parent, role, ordinal and the ``scalars`` as columns.

    ``roles`` maps plain labels to roles; ``scalars`` maps column names to plain labels. An object
    under a label without role is no entity, but its node stays known to its children's ``parent``.
    A scalar under a label with a role stands for an entity that is given by its key alone; it fills
    the column ``bare_key``. A null there is no entity.
    """
    role = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
    bare = ~F.col("is_object") & F.col("label").isin(*roles)
    wanted = nodes.where(F.col("is_object") | F.col("label").isin(*roles, *scalars.values()) & F.col("scalar").isNotNull())
    own = F.when(F.col("is_object") | bare, F.col("node")).otherwise(F.col("parent"))
    head = F.col("is_object") | bare
    pick = lambda name: F.max(F.when(head, F.col(name))).alias(name)
    return (
        wanted.select("*", own.alias("own"))
        .groupBy("source", "document", "own")
        .agg(
            *[pick(c) for c in ("parent", "label", "ordinal")],
            *[F.max(F.when((F.col("label") == label) & ~head, F.col("scalar"))).alias(name) for name, label in scalars.items()],
            F.max(F.when(bare, F.col("scalar"))).alias("bare_key"),
        )
        .withColumn("role", role[F.col("label")])
        .where("role is not null")
        .withColumnRenamed("own", "node")
        .drop("label")
    )


def joined_entities(nodes: DataFrame, roles: Mapping[str, str], scalars: Mapping[str, str]) -> DataFrame:
    """The rows of ``entities`` by a join: the stored node table is read for the objects and for their scalar children, which are pivoted and joined to them. It costs half as much again as the grouping (see the README)."""
    stored = materialise(nodes, "nodes")
    role = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])[F.col("label")]
    heads = stored.where(role.isNotNull() & (F.col("is_object") | F.col("scalar").isNotNull())).select("source", "document", "node", "parent", "ordinal", role.alias("role"), F.when(~F.col("is_object"), F.col("scalar")).alias("bare_key"))
    children = stored.where(~F.col("is_object") & F.col("label").isin(*scalars.values()) & F.col("scalar").isNotNull() & role.isNull())
    pivoted = children.groupBy("source", "document", F.col("parent").alias("node")).agg(*[F.max(F.when(F.col("label") == label, F.col("scalar"))).alias(name) for name, label in scalars.items()])
    return heads.join(pivoted, ["source", "document", "node"], "left")


def links(tables: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Distinct links child_role, child_key, parent_role, parent_key of the (child, parent) roles in ``pairs``.

    ``tables`` has document, node, parent, role, key; a child or a parent without key makes no link.
    """
    keyed = tables.where("key is not null")
    child = keyed.where(F.col("role").isin(*{c for c, _ in pairs})).select("source", "document", F.col("parent").alias("node"), F.col("role").alias("child_role"), F.col("key").alias("child_key"))
    parent = keyed.where(F.col("role").isin(*{p for _, p in pairs})).select("source", "document", "node", F.col("role").alias("parent_role"), F.col("key").alias("parent_key"))
    allowed = F.struct("child_role", "parent_role").isin(*[F.struct(F.lit(c), F.lit(p)) for c, p in pairs])
    return child.join(parent, ["source", "document", "node"]).where(allowed).select("child_role", "child_key", "parent_role", "parent_key").distinct()


def entity_tables(nodes: DataFrame, roles: Mapping[str, str], scalars: Mapping[str, str], key_of: Mapping[str, str], name: str) -> DataFrame:
    """``entities`` with the column ``key``, written once, since children and parents are both read from it.

    ``key_of`` names the scalar that is a role's key (``id`` where it is not named). An id is
    written in decimal digits without leading zeros; an id that is no number is null. Blank keys are null.
    """
    table = entities(nodes, roles, scalars)
    spelled = F.coalesce("id", "map_key", "bare_key")
    digits = F.regexp_extract(F.trim(spelled), r"^[+]?0*(\d+)$", 1)
    key = F.when(digits != "", digits)
    for role, column in key_of.items():
        word = F.trim(F.coalesce(F.col(column), F.col("bare_key")))
        key = F.when(F.col("role") == role, F.when(word != "", word)).otherwise(key)
    return materialise(table.withColumn("key", key), name)
