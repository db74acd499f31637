"""Problem 4: schemas that drift between versions, read into one table, with a list of each change.

Two passes over the documents. The first counts the types of every field of every version, those of objects
at any depth among them. The second compares, for fields that vanish and fields that appear in one step, the values
documents of both versions hold. Per step a tree edit distance between the two schemas, with renames and moves
priced by that agreement, gives the cheapest script of changes; scripts compile to one
projection for all documents.

``p4_found`` is defined by the segments' documents alone. ``all_drift`` and ``all_changes``
take in the writes of the log and the declared mappings too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import change_records as cr
from ..functions.json_types import TYPES, type_sql
from ..functions.once import computed_once
from ..session import scratch_path, ship
from .change_feed import source_of

#: Agreement from which a field that vanishes and one that appears are one field renamed.
RENAME_AT = 0.5
#: Rows of the table of changing fields up to which it is broadcast (a few MB); beyond, it is joined by shuffle.
BROADCAST_ROWS = 100_000
#: Levels of fields that are unfolded at first; twice as many are as long as the deepest level still has objects.
LEVELS = 2
#: What a move saves against deleting and adding, times its agreement. A rename saves at least 0.75 and stands against at most two moves, so moves never displace one.
MOVE_SAVES = 0.35


# -- the documents ----------------------------------------------------------------------------


def versioned(docs: DataFrame) -> DataFrame:
    """(index_name, version, document_id, seq, source): the version where it is null is the one the segment's other rows show.

    Only rows of null version are joined; a segment that shows none keeps null.
    """
    docs = docs.select("index_name", "segment_number", "mapping_version", "document_id", "sequence_number", "source")
    cols = ["index_name", "document_id", F.col("sequence_number").alias("seq"), "source"]
    known = docs.where("mapping_version is not null").select(F.col("mapping_version").cast("int").alias("version"), *cols)
    shown = docs.where("mapping_version is not null").groupBy("index_name", "segment_number").agg(F.max("mapping_version").cast("int").alias("version"))
    lost = docs.where("mapping_version is null").drop("mapping_version").join(shown, ["index_name", "segment_number"], "left").select("version", *cols)
    return known.unionByName(lost)


def fields(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(…, field, inner, type, value): a row per top-level field, and per field of an object down to ``levels``; ``inner`` is the path within the top-level field, null for itself.

    Null values have null type. Sources that are null, unreadable or no objects have no fields.
    """
    keep = [c for c in rows.columns if c != "source"]
    doc = rows.withColumn("_v", computed_once(F.expr("try_parse_json(source)"))).where("schema_of_variant(_v) like 'OBJECT%'")
    top = doc.select(*keep, F.explode(F.expr("map_entries(cast(_v as map<string, variant>))")).alias("_e")).select(*keep, F.col("_e.key").alias("field"), F.col("_e.value").alias("value"))
    # as a column of its own the schema isn't computed anew for each comparison
    each = top.withColumn("_st", F.expr("schema_of_variant(value)")).withColumn("type", F.expr(type_sql("value", "_st"))).drop("_st").withColumn("inner", F.expr("cast(null as array<string>)"))
    pick = lambda name: F.when(F.col("_e").isNull(), F.col(name)).otherwise(F.col(f"_e.{name}")).alias(name)
    for level in range(1, levels):
        path = "array(e.key)" if level == 1 else "concat(inner, array(e.key))"
        within = f"transform(map_entries(cast(value as map<string, variant>)), e -> named_struct('inner', {path}, 'type', {type_sql('e.value')}, 'value', e.value))"
        # only objects of the level before are unfolded, into themselves and their fields; any other value stays the one row it is
        fresh = "inner IS NULL" if level == 1 else f"size(inner) = {level - 1}"
        own = f"CASE WHEN type = 'Object' AND {fresh} THEN concat(array(named_struct('inner', inner, 'type', type, 'value', value)), {within}) END"
        each = each.select(*keep, "field", "inner", "type", "value", F.explode_outer(F.expr(own)).alias("_e")).select(*keep, "field", pick("inner"), pick("type"), pick("value"))
    return each


def field_types(rows: DataFrame) -> DataFrame:
    """(index_name, version, field, inner, type, values): the type of most non-null values; of equally many the last by name."""
    return most_types(type_counts(rows))


def type_counts(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(index_name, version, field, inner, type, n): the non-null values of each type."""
    return fields(rows.select("index_name", "version", "source"), levels).where("type is not null").groupBy("index_name", "version", "field", "inner", "type").agg(F.count(F.lit(1)).alias("n"))


def whole_counts(rows: DataFrame) -> tuple[DataFrame, int]:
    """The type counts of rows with index and version, written, down to the deepest fields; and how many levels that are."""
    levels = LEVELS
    while True:
        counts = _kept(type_counts(rows, levels).where("version is not null and index_name is not null"), "field-types")
        if counts.where(f"type = 'Object' and size(inner) = {levels - 1}").isEmpty():
            return counts, levels
        levels *= 2


def most_types(counts: DataFrame) -> DataFrame:
    most = counts.groupBy("index_name", "version", "field", "inner").agg(F.max(F.struct("n", "type")).alias("m"), F.sum("n").alias("values"))
    return most.select("index_name", "version", "field", "inner", "m.type", "values")


# -- the log and the declared mappings --------------------------------------------------------


def log_writes(docs: DataFrame, wal: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log's writes as ``versioned`` gives documents, and (index_name, version) of the announced versions.

    A write names no version itself. Its version is the highest that its index has shown up to
    its number, by a segment's document or an announcement; the lowest declared version holds from the start. A write
    without number has no version. Copies of one write (same index, document and number) are one row.
    """
    rows = cr.parsed(wal.select("index_name", "document_id", "sequence_number", "record"), "record", "_r").where(F.col("_r.op").isin(cr.INDEX, cr.MAPPING))
    known = rows.where("index_name is not null")
    number = F.coalesce(F.get_json_object("record", "$.mapping_version"), F.get_json_object("record", "$.MappingUpdate.mapping_version"))
    announced = known.where(F.col("_r.op") == cr.MAPPING).select("index_name", number.try_cast("int").alias("version"), F.col("sequence_number").alias("seq")).where("version is not null")
    first = metadata.where("index_name is not null and mapping_version is not null").groupBy("index_name").agg(F.min("mapping_version").cast("int").alias("version")).withColumn("seq", F.lit(-(2**63)))
    shown = docs.where("version is not null and index_name is not null").select("index_name", "version", "seq").unionByName(announced).where("seq is not null").unionByName(first)
    # only where each version is first seen matters, so an index has as many points as versions
    points = shown.groupBy("index_name", "version").agg(F.min("seq").alias("seq")).groupBy("index_name").agg(F.collect_list(F.struct("seq", "version")).alias("points"))
    writes = rows.where(F.col("_r.op") == cr.INDEX).select("index_name", F.coalesce("_r.id", "document_id").alias("document_id"), F.col("sequence_number").alias("seq"), source_of(F.col("record")).alias("source"))
    lone = F.when(F.col("document_id").isNull() | F.col("seq").isNull(), F.col("source"))
    once = writes.groupBy("index_name", "document_id", "seq", lone.alias("_lone")).agg(F.min("source").alias("source"))
    version = F.expr("array_max(transform(filter(points, p -> p.seq <= seq), p -> p.version))")
    return once.join(points, "index_name", "left").select(version.alias("version"), "index_name", "document_id", "seq", "source"), announced.select("index_name", "version").distinct()


def declared_types(metadata: DataFrame) -> DataFrame:
    """(index_name, version, field, inner, type): the fields each version's mapping declares; of several rows the one updated last counts.

    A field's type is its text, or ``field_type`` or ``type`` of its object, in any letter case; other values declare no type (null).
    """
    known = metadata.where("index_name is not null and mapping_version is not null and mappings is not null")
    last = known.groupBy("index_name", F.col("mapping_version").cast("int").alias("version")).agg(F.max(F.struct("updated_at", "mappings")).alias("m")).select("index_name", "version", F.expr("try_parse_json(m.mappings)").alias("_v"))
    each = last.where("schema_of_variant(_v) like 'OBJECT%'").select("index_name", "version", F.explode(F.expr("map_entries(cast(_v as map<string, variant>))")).alias("_e"))
    text = F.expr("lower(coalesce(try_variant_get(_e.value, '$.field_type', 'string'), try_variant_get(_e.value, '$.type', 'string'), try_variant_get(_e.value, '$', 'string')))")
    kind = F.when(text.isin([t.lower() for t in TYPES]), F.initcap(text))
    return each.select("index_name", "version", F.col("_e.key").alias("field"), F.lit(None).cast("array<string>").alias("inner"), kind.alias("type"))


# -- the steps --------------------------------------------------------------------------------


def steps(rows: DataFrame) -> DataFrame:
    """(index_name, version, previous): each version with the one before it."""
    versions = rows.where("version is not null and index_name is not null").select("index_name", "version").distinct()
    own = versions.groupBy("index_name").agg(F.sort_array(F.collect_list("version")).alias("vs"))
    pairs = F.expr("transform(sequence(2, size(vs)), i -> struct(vs[i - 1] as version, vs[i - 2] as previous))")
    return own.where("size(vs) > 1").select("index_name", F.explode(pairs).alias("p")).select("index_name", "p.version", "p.previous")


def agreements(rows: DataFrame, changing: DataFrame, small: bool, levels: int = LEVELS) -> DataFrame:
    """(index_name, version, old, new, same, held): of the documents in both versions that hold ``old`` before, how many hold an equal value under ``new``.

    ``changing``: (index_name, at, path, version, side), a row for each field that vanishes
    ("old", at the preceding version) or appears ("new") in the step to ``version``; a path is a list of names. Only
    values of such fields are shuffled, by document; a document's newest value counts. Where ``changing`` isn't
    ``small``, each field of each document is a narrow row that is joined to it; documents aren't shuffled.
    """
    named = rows.where("document_id is not null")
    # a row of null path says that the document is there in the new version
    nothing = "cast(null as array<string>) as path, cast(null as string) as value"
    if small:
        roles = changing.groupBy("index_name", F.col("at").alias("version")).agg(F.collect_list(F.struct("path", F.col("version").alias("step"), "side")).alias("roles"))
        docs = named.join(F.broadcast(roles), ["index_name", "version"])
        docs = docs.withColumn("_v", F.expr("try_parse_json(source)")).withColumn("_m", F.expr("CASE WHEN schema_of_variant(_v) LIKE 'OBJECT%' THEN cast(_v as map<string, variant>) END"))
        there = docs.select("index_name", "document_id", "seq", F.explode(F.expr(f"array_distinct(transform(filter(roles, r -> r.side = 'new'), r -> struct(r.step as step, 'new' as side, {nothing})))")).alias("r"))
        below = "aggregate(slice(r.path, 2, size(r.path)), _m[r.path[0]], (v, k) -> CASE WHEN schema_of_variant(v) LIKE 'OBJECT%' THEN cast(v as map<string, variant>)[k] END)"
        value = f"to_json(CASE WHEN size(r.path) = 1 THEN _m[r.path[0]] ELSE {below} END)"
        held = docs.select("index_name", "document_id", "seq", F.explode(F.expr(f"filter(transform(roles, r -> struct(r.step as step, r.side as side, r.path as path, {value} as value)), r -> r.value is not null and r.value <> 'null')")).alias("r"))
        own = held.unionByName(there).select("index_name", "document_id", "seq", "r.*")
    else:
        news = changing.where("side = 'new'").select("index_name", F.col("at").alias("version"), F.col("version").alias("step")).distinct()
        there = named.select("index_name", "version", "document_id", "seq").join(news, ["index_name", "version"]).selectExpr("index_name", "document_id", "seq", "step", "'new' as side", *nothing.split(", "))
        each = fields(named.select("index_name", "version", "document_id", "seq", "source"), levels).where("type is not null")
        each = each.select("index_name", "version", "document_id", "seq", F.expr("CASE WHEN inner IS NULL THEN array(field) ELSE concat(array(field), inner) END").alias("path"), F.to_json("value").alias("value"))
        held = each.join(changing.select("index_name", F.col("at").alias("version"), "path", F.col("version").alias("step"), "side"), ["index_name", "version", "path"])
        own = held.select("index_name", "document_id", "seq", "step", "side", "path", "value").unionByName(there)
    own = own.groupBy("index_name", "step", "document_id", "side", "path").agg(F.max(F.struct("seq", "value")).alias("v")).select("index_name", "step", "document_id", "side", "path", "v.value")
    doc = own.groupBy("index_name", "step", "document_id").agg(F.max(F.col("path").isNull()).alias("there"), F.collect_list(F.struct("side", "path", "value")).alias("f"))
    equal = F.expr(
        """flatten(transform(filter(f, o -> o.side = 'old' and o.path is not null), o ->
             concat(array(struct(o.path as old, cast(null as array<string>) as new)),
                    transform(filter(f, x -> x.side = 'new' and x.value = o.value), x -> struct(o.path as old, x.path as new)))))"""
    )
    pairs = doc.where("there").select("index_name", F.col("step").alias("version"), F.explode(equal).alias("p")).groupBy("index_name", "version", "p.old", "p.new").agg(F.count(F.lit(1)).alias("n"))
    total = pairs.where("new is null").select("index_name", "version", "old", F.col("n").alias("held"))
    return pairs.where("new is not null").withColumnRenamed("n", "same").join(total, ["index_name", "version", "old"])


# -- the edit script --------------------------------------------------------------------------


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the cheapest full assignment of rows to columns; rows at most columns."""
    n, m = cost.shape
    u, v, of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        of[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while of[j0]:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[of[j0] - 1, free - 1] - u[of[j0]] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[np.argmin(least[free])]
            step = least[j1]
            u[of[used]] += step
            v[used] -= step
            least[free] -= step
            j0 = j1
        while j0:
            of[j0] = of[way[j0]]
            j0 = way[j0]
    return [(of[j] - 1, j - 1) for j in range(1, m + 1) if of[j]]


class Node:
    """A field of a schema, its type and, of an object, its fields."""

    def __init__(self, name: str, type_: str | None, children: "dict[str, Node] | None" = None):
        self.name, self.type, self.children = name, type_, children or {}

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children.values())


Path = tuple[str, ...]
Change = tuple[str, Path, Path, str | None, str | None]


def edit_script(old: Node, new: Node, agreement: dict) -> tuple[float, list[tuple[str, str, str, str, str, int, list[str], list[str]]]]:
    """Cost and script (kind, field, old field, old type, new type, depth, path, old path) that turns one schema tree into the other.

    Unordered trees: fields of equal name under one parent are mapped to each other, the others under the same or a renamed
    parent by a cheapest assignment, and what is left anywhere in the trees by another, as moves. Adding or deleting
    costs 1 a node, another type 0.5, and a rename 1.5 less its agreement, so never more than 1; below ``RENAME_AT`` it costs
    as much as to delete and add. A move to another parent costs ``MOVE_SAVES`` times its agreement less than to delete and add; a field
    of equal name and type that no document speaks for has half. ``agreement`` has pairs of top-level names, or of paths below that.
    """
    cost, script, gone, come = _match(old, new, (), (), agreement)
    saved, moved = _moves(gone, come, agreement)
    from_, to = {m[2] for m in moved}, {m[1] for m in moved}
    script += [("removed", p, (), n.type, "") for p, n in gone if p not in from_] + [("added", p, (), "", n.type) for p, n in come if p not in to]
    # a field that moves along with its parent is no change of its own
    along = {(m[2], m[1]) for m in moved}
    script += [m for m in moved if m[1][-1] != m[2][-1] or (m[2][:-1], m[1][:-1]) not in along]
    return cost - saved, [(k, ".".join(p), ".".join(o), a, b, len(p), list(p), list(o)) for k, p, o, a, b in script]


def _share(agreement: dict, old: Path, new: Path) -> float:
    plain = lambda p: p[0] if len(p) == 1 else p
    share = agreement.get((plain(old), plain(new)), 0.0)
    return share if share >= RENAME_AT else 0.0


def _match(old: Node, new: Node, at_old: Path, at_new: Path, agreement: dict) -> tuple[float, list[Change], list[tuple[Path, Node]], list[tuple[Path, Node]]]:
    """Cost, changes, and the fields left over on either side, those within them included; ``at_old`` and ``at_new`` are mapped to each other."""
    cost, script, left, fresh = 0.0, [], [], []

    def inside(a: Node, b: Node) -> None:
        nonlocal cost
        c, s, x, y = _match(a, b, (*at_old, a.name), (*at_new, b.name), agreement)
        cost += c
        script.extend(s), left.extend(x), fresh.extend(y)

    for name in sorted(old.children.keys() & new.children.keys()):
        a, b = old.children[name], new.children[name]
        if a.type != b.type:
            cost += 0.5
            script.append(("type_changed", (*at_new, name), (), a.type, b.type))
        if a.children or b.children:
            inside(a, b)
    gone = [old.children[n] for n in sorted(old.children.keys() - new.children.keys())]
    come = [new.children[n] for n in sorted(new.children.keys() - old.children.keys())]
    mapped_a, mapped_b = set(), set()
    if gone and come:
        # columns beyond the new fields stand for deletion; an unmapped new field is added
        pay = np.full((len(gone), len(come) + len(gone)), 0.0)
        for i, a in enumerate(gone):
            pay[i, len(come):] = a.size()
            for j, b in enumerate(come):
                share = _share(agreement, (*at_old, a.name), (*at_new, b.name))
                within = _match(a, b, (*at_old, a.name), (*at_new, b.name), agreement)[0] if share and (a.children or b.children) else 0.0
                rename = 1.5 - share + 0.25 * (a.type != b.type) + within if share else a.size() + b.size() + 1.0
                pay[i, j] = rename - b.size()  # the new field need not be added
        for i, j in assign(pay):
            if j < len(come) and (share := _share(agreement, (*at_old, gone[i].name), (*at_new, come[j].name))):
                a, b = gone[i], come[j]
                mapped_a.add(i), mapped_b.add(j)
                cost += 1.5 - share + 0.25 * (a.type != b.type)
                script.append(("renamed", (*at_new, b.name), (*at_old, a.name), a.type, b.type))
                if a.children or b.children:
                    inside(a, b)
    for nodes, mapped, at, out in ((gone, mapped_a, at_old, left), (come, mapped_b, at_new, fresh)):
        for i, node in enumerate(nodes):
            if i not in mapped:
                cost += node.size()
                out.extend(_whole(node, at))
    return cost, script, left, fresh


def _whole(node: Node, at: Path) -> list[tuple[Path, Node]]:
    path = (*at, node.name)
    return [(path, node)] + [x for c in node.children.values() for x in _whole(c, path)]


def _moves(gone: list[tuple[Path, Node]], come: list[tuple[Path, Node]], agreement: dict) -> tuple[float, list[Change]]:
    """What the cheapest mapping of fields left over saves, and its moves: another parent, and an equal value in most documents, or an equal name and type."""
    share = np.zeros((len(gone), len(come)))
    by_leaf: dict = {}
    for j, (q, b) in enumerate(come):
        by_leaf.setdefault((q[-1], b.type), []).append(j)
    at_old, at_new = {p: i for i, (p, _) in enumerate(gone)}, {q: j for j, (q, _) in enumerate(come)}
    path = lambda k: (k,) if isinstance(k, str) else k
    for i, (p, a) in enumerate(gone):
        for j in by_leaf.get((p[-1], a.type), ()):
            share[i, j] = RENAME_AT
    for (o, n), value in agreement.items():
        i, j = at_old.get(path(o)), at_new.get(path(n))
        if i is not None and j is not None and value >= RENAME_AT:
            share[i, j] = max(share[i, j], value)
    for i, (p, _) in enumerate(gone):
        for j, (q, _) in enumerate(come):
            if p[:-1] == q[:-1]:  # the same parent: that would have been a rename
                share[i, j] = 0.0
    rows, cols = np.flatnonzero(share.any(axis=1)), np.flatnonzero(share.any(axis=0))
    if not len(rows):
        return 0.0, []
    some = share[np.ix_(rows, cols)]
    pairs = [(int(rows[i]), int(cols[j])) for i, j in assign(np.hstack([-some, np.zeros((len(rows), len(rows)))])) if j < len(cols) and some[i, j] > 0]
    moves = [("moved", come[j][0], gone[i][0], gone[i][1].type, come[j][1].type) for i, j in pairs]
    return MOVE_SAVES * sum(share[i, j] for i, j in pairs), moves


def tree(rows: list) -> Node:
    root = Node("", "Object")
    for r in sorted(rows, key=lambda r: 0 if r["inner"] is None else len(r["inner"])):
        *above, name = [r["field"], *(r["inner"] if r["inner"] is not None else [])]
        node = root
        for n in above:
            # an object that is no field of its own, for lack of a value, has fields all the same
            node = node.children.setdefault(n, Node(n, "Object"))
        node.children.setdefault(name, Node(name, r["type"]))
    return root


@dataclass
class Drift:
    """``rows``: the documents with versions; ``types``: the fields of each version; ``changes``: what each step changed; ``declared``: the fields of the mappings, where they were read."""

    rows: DataFrame
    types: DataFrame
    changes: DataFrame
    declared: DataFrame | None = None
    levels: int = LEVELS


def changes(docs: DataFrame) -> DataFrame:
    """The changes of ``drift``."""
    return drift(docs).changes


def drift(docs: DataFrame) -> Drift:
    """The documents' fields by version, and what each step changes.

    ``changes``: (index_name, version, previous, change_kind, field_name, old_name, old_type, new_type, depth, path, old_path): every change of each step.

    ``field_name`` of a nested field is its path with dots; ``path`` has the names by themselves. A step without changes gives no
    row; an index of one version has no step. Rows whose version can't be told take no part.
    """
    ship(docs.sparkSession)
    rows = versioned(docs)
    return _drift(rows, *whole_counts(rows))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, as it is read several times."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _drift(rows: DataFrame, counts: DataFrame, levels: int) -> Drift:
    # the counts are small (fields x versions)
    types = most_types(counts)
    pair = _kept(_pairs(steps(rows), types), "schema-steps")
    paths = lambda t: f"transform({t}, x -> CASE WHEN x.inner IS NULL THEN array(x.field) ELSE concat(array(x.field), x.inner) END)"
    gone, come = F.expr(f"array_except({paths('old_tree')}, {paths('new_tree')})"), F.expr(f"array_except({paths('new_tree')}, {paths('old_tree')})")
    both = pair.select("index_name", "version", "previous", gone.alias("gone"), come.alias("come")).where("size(gone) > 0 and size(come) > 0")
    changing = both.select("index_name", F.col("previous").alias("at"), F.explode("gone").alias("path"), "version", F.lit("old").alias("side")).unionByName(
        both.select("index_name", F.col("version").alias("at"), F.explode("come").alias("path"), "version", F.lit("new").alias("side"))
    )
    small = changing.count() <= BROADCAST_ROWS
    agree = agreements(rows, changing, small, levels).groupBy("index_name", "version").agg(F.collect_list(F.struct("old", "new", (F.col("same") / F.col("held")).alias("share"))).alias("agree"))
    work = pair.join(agree, ["index_name", "version"], "left")

    return Drift(rows, types, _scripts(work), levels=levels)


def _pairs(step: DataFrame, types: DataFrame) -> DataFrame:
    """``step`` (index_name, version, previous) with the fields of both versions: old_tree, new_tree."""
    whole = types.groupBy("index_name", "version").agg(F.collect_list(F.struct("field", "inner", "type")).alias("tree"))
    return (
        step.join(whole.withColumnRenamed("tree", "new_tree"), ["index_name", "version"], "left")
        .join(whole.select("index_name", F.col("version").alias("previous"), F.col("tree").alias("old_tree")), ["index_name", "previous"], "left")
        .withColumn("old_tree", F.coalesce("old_tree", F.expr("cast(array() as array<struct<field string, inner array<string>, type string>>)")))
        .withColumn("new_tree", F.coalesce("new_tree", F.expr("cast(array() as array<struct<field string, inner array<string>, type string>>)")))
    )


_CHANGE = "change_kind string, field_name string, old_name string, old_type string, new_type string, depth int, path array<string>, old_path array<string>"


def _scripts(work: DataFrame) -> DataFrame:
    """The edit script of each row of index_name, version, previous, old_tree, new_tree and agree (null, or a list of old, new, share)."""
    plain = lambda p: p[0] if len(p) == 1 else tuple(p)

    def run(batches):
        for part in batches:
            out = []
            for r in part.itertuples(index=False):
                shares = {(plain(x["old"]), plain(x["new"])): x["share"] for x in (r.agree if r.agree is not None else [])}
                for x in edit_script(tree(r.old_tree), tree(r.new_tree), shares)[1]:
                    out.append((r.index_name, r.version, r.previous, *x))
            yield pd.DataFrame(out, columns=["index_name", "version", "previous", "change_kind", "field_name", "old_name", "old_type", "new_type", "depth", "path", "old_path"])

    return work.mapInPandas(run, f"index_name string, version int, previous int, {_CHANGE}")


def top_changes(changes: DataFrame) -> DataFrame:
    """(index_name, version, change_kind, field_name, old_name) of the top-level fields alone; one that moves into or out of an object is gone or new there."""
    each = """filter(array(
        CASE WHEN change_kind <> 'moved' AND depth = 1 THEN struct(change_kind, field_name, old_name) END,
        CASE WHEN change_kind = 'moved' AND size(old_path) = 1 THEN struct('removed' as change_kind, old_name as field_name, '' as old_name) END,
        CASE WHEN change_kind = 'moved' AND depth = 1 THEN struct('added' as change_kind, field_name, '' as old_name) END), c -> c IS NOT NULL)"""
    return changes.select("index_name", "version", F.explode(F.expr(each)).alias("c")).select("index_name", "version", "c.*")


# -- documents, log and mappings together -----------------------------------------------------


def all_drift(docs: DataFrame, wal: DataFrame, metadata: DataFrame) -> Drift:
    """``drift`` of the segments' documents, with the log's writes among its rows and types, and the declared mappings.

    Renames are those the segments' documents show.
    """
    found = drift(docs)
    writes = _kept(log_writes(found.rows, wal, metadata)[0], "log-writes")
    return Drift(found.rows.unionByName(writes), found.types.unionByName(most_types(type_counts(writes, found.levels)).where("version is not null and index_name is not null")), found.changes, declared_types(metadata), found.levels)


def all_changes(docs: DataFrame, wal: DataFrame, metadata: DataFrame) -> DataFrame:
    """The changes of ``drift`` and those that only the log or the mappings show, told apart by ``shown_by``.

    ``documents``: each change of the segments' documents. ``log``: what the steps change if the log's writes count
    as documents of the versions in force, for fields the former doesn't list in that step; and a row of kind ``announced`` (field
    name empty) for each version that announcements alone name. ``mapping``: what each declared mapping changes against the declared one before,
    for fields neither lists in that step; a renaming that documents show up to then is one here too.
    """
    ship(docs.sparkSession)
    rows = versioned(docs)
    writes, announced = log_writes(rows, wal, metadata)
    writes = _kept(writes, "log-writes")
    (counts, levels), (more, levels_of_log) = whole_counts(rows), whole_counts(writes)
    own = _kept(_drift(rows, counts, levels).changes, "changes")
    summed = counts.unionByName(more).groupBy("index_name", "version", "field", "inner", "type").agg(F.sum("n").alias("n"))
    logged = _kept(_drift(rows.unionByName(writes), summed, max(levels, levels_of_log)).changes, "changes")
    names = lambda df: df.select("index_name", "version", F.explode(F.array_distinct(F.array("field_name", "old_name"))).alias("field_name")).where("field_name <> ''").distinct()
    by_log = logged.join(names(own), ["index_name", "version", "field_name"], "left_anti")
    declared = declared_types(metadata)
    renames = own.where("change_kind = 'renamed' and depth = 1").select("index_name", F.col("version").alias("at"), F.col("old_path").alias("old"), F.col("path").alias("new"))
    pair = _pairs(steps(declared), declared)
    agree = pair.select("index_name", "version").join(renames, "index_name").where("at <= version").groupBy("index_name", "version").agg(F.collect_set(F.struct("old", "new", F.lit(1.0).alias("share"))).alias("agree"))
    by_mapping = _scripts(pair.join(agree, ["index_name", "version"], "left")).join(names(own.unionByName(by_log)), ["index_name", "version", "field_name"], "left_anti")
    versions = rows.select("index_name", "version").unionByName(metadata.select("index_name", F.col("mapping_version").cast("int").alias("version"))).distinct()
    nothing = F.lit("")
    lone = announced.join(versions, ["index_name", "version"], "left_anti").select(
        "index_name", "version", F.lit(None).cast("int").alias("previous"), F.lit("announced").alias("change_kind"), nothing.alias("field_name"), nothing.alias("old_name"), nothing.alias("old_type"), nothing.alias("new_type"), F.lit(0).alias("depth"), F.expr("cast(array() as array<string>)").alias("path"), F.expr("cast(array() as array<string>)").alias("old_path")
    )
    shown = lambda df, by: df.withColumn("shown_by", F.lit(by))
    return shown(own, "documents").unionByName(shown(by_log.unionByName(lone), "log")).unionByName(shown(by_mapping, "mapping"))


# -- one table --------------------------------------------------------------------------------


Rules = dict[Path, Path]


def place(rules: Rules, path: Path) -> Path:
    """Where ``path`` goes: the longest old path that begins it becomes the new one, what follows stays."""
    for n in range(len(path), 0, -1):
        if path[:n] in rules:
            return (*rules[path[:n]], *path[n:])
    return path


def compose(step: Rules, later: Rules) -> Rules:
    """The rules that do what ``step`` does and then what ``later`` does. A path a step has no rule for is the same after it."""
    came = {new: old for old, new in step.items()}
    out = {old: place(later, new) for old, new in step.items()}
    for old, new in later.items():
        # the paths before the step that it makes this one: below a field it changes, or the same
        for n in range(1, len(old)):
            before = (*came.get(old[:n], ()), *old[n:])
            if old[:n] in came and place(step, before) == old:
                out[before] = new
        if not any(old[:n] in step for n in range(1, len(old) + 1)):
            out[old] = new
    # a field that goes along with its parent needs no rule
    return {old: new for old, new in out.items() if (*place(out, old[:-1]), old[-1]) != new}


def projection(rules: Rules) -> tuple[dict[str, str], list[str] | None, list[dict] | None, list[Path] | None, int | None]:
    """The rules as columns (names, heads, paths, opened, depth).

    ``heads`` are the top-level fields that rules within objects, moves, or renames to a name that is itself renamed have to do
    with; ``paths`` has their rules, longest old path first, ``opened`` the objects whose fields go different ways, the
    deepest at ``depth``. ``names`` has all other renames. Without such fields the last four are null.
    """
    hard = [r for r in rules.items() if len(r[0]) > 1 or len(r[1]) > 1 or r[1] in rules]
    heads = {path[0] for r in hard for path in r}
    while more := {path[0] for r in rules.items() if not heads.isdisjoint((r[0][0], r[1][0])) for path in r} - heads:
        heads |= more
    names = {old[0]: new[0] for old, new in rules.items() if old[0] not in heads}
    if not heads:
        return names, None, None, None, None
    paths = {old: new for old, new in rules.items() if old[0] in heads}
    targets = {new[:n] for new in paths.values() for n in range(1, len(new))}
    opened = targets | {old[:n] for old in paths for n in range(1, len(old))}
    opened |= {(*old, *t[len(new):]) for t in targets for old, new in paths.items() if t[: len(new)] == new}
    longest = sorted(paths.items(), key=lambda r: (-len(r[0]), r))
    return names, sorted(heads), [{"old": list(o), "new": list(n)} for o, n in longest], [list(x) for x in sorted(opened)], max(map(len, opened), default=0)


_PROJECTION = "names map<string, string>, heads array<string>, paths array<struct<old: array<string>, new: array<string>>>, opened array<array<string>>, depth int"


def final_names(change: DataFrame) -> DataFrame:
    """(index_name, version, names, heads, paths, opened, depth): for each version with later renames or moves the ``projection`` from its paths to the last ones."""

    def run(batches):
        for part in batches:
            out = []
            for index, steps_of in zip(part["index_name"], part["changed"]):
                now: Rules = {}
                by_version: dict[int, Rules] = {}
                for r in steps_of:
                    by_version.setdefault(r["version"], {})[tuple(r["old_path"])] = tuple(r["path"])
                for v in sorted(by_version, reverse=True):
                    now = compose(by_version[v], now)
                    out.append((index, v, *projection(now)))
            df = pd.DataFrame(out, columns=["index_name", "version", "names", "heads", "paths", "opened", "depth"])
            yield df.assign(depth=df["depth"].astype("Int32"))

    changed = change.where("change_kind in ('renamed', 'moved')").groupBy("index_name").agg(F.collect_list(F.struct("version", "path", "old_path")).alias("changed"))
    return changed.mapInPandas(run, f"index_name string, version int, {_PROJECTION}")


def _let(name: str, value: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _rule(path: str) -> str:
    """SQL for the rule of ``paths`` that holds for a path, null where none does."""
    return f"get(filter(paths, r -> slice({path}, 1, size(r.old)) = r.old), 0)"


def _begins(a: str, b: str) -> str:
    return f"slice({b}, 1, size({a})) = {a}"


def _renamed(doc: str) -> str:
    """SQL for a map of fields with the renames of ``names``; values that would end under one name keep their own, a null gives way."""
    held = f"map_filter({doc}, (k, v) -> NOT (is_variant_null(v) AND array_contains(map_values(names), k)))"
    name = "names[e.key] IS NOT NULL AND NOT map_contains_key(held, names[e.key]) AND size(filter(map_keys(held), k -> names[k] = names[e.key])) = 1"
    return _let("held", held, f"map_from_entries(transform(map_entries(held), e -> struct(CASE WHEN {name} THEN names[e.key] ELSE e.key END as key, e.value as value)))")


def _projected(doc: str) -> str:
    """SQL for a map with the ``heads`` of the map ``doc``, everything in them at its last path by ``paths``.

    The objects in ``opened`` are unfolded to nodes, other values stay whole. A node's rule is blocked, and it keeps its path, where another value
    lies at the new one, above it, or (of a value) below it, or where the rule of a field that it would go into is blocked; a null
    blocks nothing and gives way. The rows that are left, in the order of their paths, are written as one JSON text.
    """
    start = f"transform(map_entries(map_filter({doc}, (k, v) -> array_contains(heads, k))), e -> struct(array(e.key) as path, e.value as value))"
    fields_ = "transform(map_entries(cast(n.value as map<string, variant>)), e -> struct(concat(n.path, array(e.key)) as path, e.value as value))"
    unfold = f"flatten(transform(h, n -> CASE WHEN size(n.path) = l AND array_contains(opened, n.path) AND schema_of_variant(n.value) LIKE 'OBJECT%' THEN concat(array(n), {fields_}) ELSE array(n) END))"
    # kind: 0 null, 1 object whose fields are nodes of their own, 2 any other value
    kind = "CASE WHEN is_variant_null(n.value) THEN 0 WHEN schema_of_variant(n.value) = 'OBJECT<>' OR array_contains(opened, n.path) AND schema_of_variant(n.value) LIKE 'OBJECT%' THEN 1 ELSE 2 END"
    nodes = f"transform(aggregate(sequence(1, depth), {start}, (h, l) -> {unfold}), n -> " + _let(
        "u", _rule("n.path"), f"struct(n.path as path, {kind} as kind, u.old as by, concat(u.new, slice(n.path, size(u.old) + 1, size(n.path))) as to, n.value as value)"
    ) + ")"
    own = "n.by IS NULL OR array_contains(keep, n.by)"
    placed = f"array_sort(transform(filter(nodes, n -> n.kind > 0), n -> struct(IF({own}, n.path, n.to) as place, n.kind as kind, IF({own}, null, n.by) as by)))"
    # in this order, if anything lies at or below a place, the next row does
    clash = f"x.place IS NOT NULL AND y.place IS NOT NULL AND {_begins('x.place', 'y.place')} AND (x.kind = 2 OR size(x.place) = size(y.place))"
    clashing = f"flatten(transform(at, (x, j) -> {_let('y', 'get(at, j + 1)', f'IF({clash}, filter(array(x.by, y.by), b -> b IS NOT NULL), cast(array() as array<array<string>>))')}))"
    into = f"transform(filter(paths, r -> exists(paths, b -> array_contains(keep, b.old) AND {_begins('b.new', 'r.new')})), r -> r.old)"
    keep = f"aggregate(sequence(1, size(paths)), cast(array() as array<array<string>>), (keep, i) -> IF(i > 1 AND size(keep) = 0, keep, array_union(keep, concat({_let('at', placed, clashing)}, IF(size(keep) = 0, keep, {into})))))"
    rows = f"array_sort(transform(nodes, n -> struct(IF({own}, n.path, n.to) as place, n.kind as kind, n.path as path, IF(n.kind = 1, '{{}}', to_json(n.value)) as text)))"
    other = f"m.path <> n.path AND ({_begins('m.place', 'n.place')} OR {_begins('n.place', 'm.place')}) AND NOT (m.kind = 1 AND size(m.place) < size(n.place)) AND (m.kind > 0 OR m.path < n.path)"
    # few documents have a null where something else goes, and only theirs are compared with all rows
    meet = "exists(transform(rows, (x, j) -> " + _let("y", "get(rows, j + 1)", f"coalesce({_begins('x.place', 'y.place')} AND NOT (x.kind = 1 AND size(x.place) < size(y.place)), false)") + "), c -> c)"
    whole = f"IF({meet}, filter(rows, n -> n.kind > 0 OR NOT exists(rows, m -> {other})), rows)"
    # an object is a row of its own only if nothing is in it
    last = f"filter(whole, (n, j) -> coalesce(NOT ({_begins('n.place', 'get(whole, j + 1).place')}), true))"
    above = "get(last, j - 1).place"
    shared = f"CASE WHEN j = 0 THEN 0 ELSE size(filter(sequence(1, least(size({above}), size(n.place))), i -> slice({above}, 1, i) = slice(n.place, 1, i))) END"
    close = f"CASE WHEN j = 0 THEN '' ELSE concat(repeat('}}', size({above}) - 1 - c), ',') END"
    names = "array_join(transform(slice(n.place, c + 1, size(n.place)), k -> concat(to_json(cast(k as variant)), ':')), '{')"
    pieces = f"transform(last, (n, j) -> {_let('c', shared, f'concat({close}, {names}, n.text)')})"
    text = f"concat('{{', array_join({pieces}, ''), repeat('}}', greatest(1, size(get(last, size(last) - 1).place))))"
    written = _let("rows", rows, _let("whole", whole, _let("last", last, text)))
    return f"cast(parse_json({_let('nodes', nodes, _let('keep', keep, written))}) as map<string, variant>)"


def unify(found: Drift, max_columns: int = 1000) -> DataFrame:
    """All documents with one set of columns: index_name, document_id, version, seq, f_<field>…, strays, rest.

    A document of a version before a rename or move has its value under the last name, and at the last place within objects or outside them; an object
    all of whose fields have moved out is empty. Columns are the final names of top-level fields (a prefix keeps them
    from clashing) up to ``max_columns`` by name; their type is the one that holds every field's type: Integer and Long give bigint,
    with Double double, one type alone itself, any mixture string. A value of another type
    is in ``strays`` (name -> JSON), fields beyond the columns and, under the empty name, sources that are no objects in ``rest``; so no value is lost. Where a document holds
    several fields that end under one name, each keeps its own (its column, or ``rest`` where it has none, and its place within an object). A field that only a
    mapping declares has a column too, of the declared type.
    """
    rows, spark = found.rows, found.rows.sparkSession
    names = final_names(found.changes)
    # a version has the renames and moves of the steps after it
    versions = rows.select("index_name", "version").where("version is not null")
    if found.declared is not None:
        versions = versions.unionByName(found.declared.select("index_name", "version"))
    later = versions.distinct().alias("v").join(names.alias("n"), F.expr("v.index_name = n.index_name and n.version > v.version"))
    own = F.struct("n.names", "n.heads", "n.paths", "n.opened", "n.depth")
    maps = later.groupBy("v.index_name", "v.version").agg(F.min_by(own, "n.version").alias("m")).select("index_name", "version", "m.*")
    path = scratch_path(spark, "final-names")
    maps.write.parquet(path)
    maps = spark.read.parquet(path)
    types = found.types.select("index_name", "version", "field", "inner", "type", F.lit(False).alias("declared"))
    if found.declared is not None:
        types = types.unionByName(found.declared.select("index_name", "version", "field", "inner", "type", F.lit(True).alias("declared")))
    # a field within an object counts if it is a top-level one at last, a top-level one if it is still
    at = "concat(array(field), coalesce(inner, cast(array() as array<string>)))"
    last = _let("p", at, _let("u", _rule("p"), "coalesce(concat(u.new, slice(p, size(u.old) + 1, size(p))), p)"))
    last = F.expr(f"CASE WHEN array_contains(heads, field) THEN {last} WHEN inner IS NULL THEN array(coalesce(names[field], field)) END")
    named = types.join(maps, ["index_name", "version"], "left").select(last.alias("at"), "type", "declared").where("size(at) = 1").select(F.col("at")[0].alias("field"), "type", "declared")
    kinds = F.collect_set(F.when(~F.col("declared"), F.col("type")))
    # what mappings declare decides only where no document has the field
    kinds = F.when(F.size(kinds) > 0, kinds).otherwise(F.collect_set("type"))
    kinds_of = {r["field"]: r["types"] for r in named.groupBy("field").agg(kinds.alias("types")).orderBy("field").limit(max_columns).collect()}
    versions_renamed, unfolded = maps.agg(F.count(F.lit(1)), F.count("heads")).first()
    maps = maps if unfolded else maps.select("index_name", "version", "names")
    joined = rows.join(F.broadcast(maps) if versions_renamed <= BROADCAST_ROWS else maps, ["index_name", "version"], "left")
    doc = joined.withColumn("_v", F.expr("try_parse_json(source)")).withColumn("_m", F.expr("CASE WHEN schema_of_variant(_v) LIKE 'OBJECT%' THEN cast(_v as map<string, variant>) END"))
    # versions without later renames keep their map as it is, those with renames of top-level fields alone don't unfold it
    ways = _renamed("_m")
    if unfolded:
        whole = _let("plain", "map_filter(_m, (k, v) -> NOT array_contains(heads, k))", f"map_concat({_renamed('plain')}, {_projected('_m')})")
        ways = f"CASE WHEN heads IS NULL THEN {ways} ELSE {whole} END"
    doc = doc.withColumn("_n", F.expr(f"CASE WHEN names IS NULL OR _m IS NULL THEN _m ELSE {ways} END"))
    quote = lambda n: "'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'"
    # each value is looked up once
    doc = doc.withColumns({f"_x{i}": F.expr(f"_n[{quote(name)}]") for i, name in enumerate(kinds_of)}) if kinds_of else doc
    columns, strays, strayed = {}, [], []
    for i, (name, kinds) in enumerate(kinds_of.items()):
        sql, value = _column_type(set(kinds)), f"_x{i}"
        there = f"{value} IS NOT NULL AND NOT is_variant_null({value})"
        if sql == "json":
            columns[f"_c{i}"] = F.expr(f"to_json({value})")
        elif sql == "string":
            columns[f"_c{i}"] = F.expr(f"CASE WHEN {there} THEN coalesce(try_variant_get({value}, '$', 'string'), to_json({value})) END")
        else:
            # a cast alone would change values of other types: 1.5 and true to 1
            columns[f"_c{i}"] = F.expr(f"CASE WHEN {_FITS[sql].format(f'schema_of_variant({value})')} THEN try_variant_get({value}, '$', '{sql}') END")
            strays.append(f"struct({quote(name)} as key, CASE WHEN _c{i} IS NULL AND {there} THEN to_json({value}) END as value)")
            strayed.append(f"(_c{i} IS NULL AND {there})")
    known = "array(" + ", ".join(map(quote, kinds_of)) + ")" if kinds_of else "cast(array() as array<string>)"
    empty = "cast(map() as map<string, string>)"
    # few documents have a stray or a field beyond the columns, and only theirs are gathered
    stray = F.expr(f"CASE WHEN {' OR '.join(strayed)} THEN map_from_entries(filter(array({', '.join(strays)}), e -> e.value IS NOT NULL)) ELSE {empty} END" if strays else empty)
    held = " + ".join(f"cast(_x{i} IS NOT NULL AS int)" for i in range(len(kinds_of))) or "0"
    rest = F.expr(f"CASE WHEN size(_n) = {held} THEN {empty} ELSE transform_values(map_filter(_n, (k, v) -> NOT array_contains({known}, k)), (k, v) -> to_json(v)) END")
    # a source that is no object is kept whole, under the empty name
    rest = F.when(F.col("_m").isNull() & F.col("source").isNotNull(), F.create_map(F.lit(""), F.col("source"))).otherwise(rest)
    made = doc.withColumns(columns) if columns else doc
    named = [F.col(f"_c{i}").alias(f"f_{name}") for i, name in enumerate(kinds_of)]
    return made.select("index_name", "document_id", "version", "seq", *named, stray.alias("strays"), rest.alias("rest"))


#: Whether a value of the variant schema {0} is of the column's type.
_FITS = {"bigint": "{0} = 'BIGINT'", "double": "({0} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {0} LIKE 'DECIMAL%')", "boolean": "{0} = 'BOOLEAN'"}


def _column_type(kinds: set[str]) -> str:
    if not kinds:  # declared without a known type
        return "string"
    if kinds <= {"Integer", "Long"}:
        return "bigint"
    if kinds <= {"Integer", "Long", "Double"}:
        return "double"
    if kinds == {"Boolean"}:
        return "boolean"
    return "json" if kinds == {"Object"} else "string"
