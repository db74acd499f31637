"""Reading log records: JSON in several shapes that writes or deletes a document or announces a mapping version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .once import computed_once

#: A record is parsed as the first element of an array whose second element is this mark. Spark's parsers stop at the end of
#: the first value and would accept what follows it; so a record must end where its object ends, or the mark isn't the second
#: and last element. The mark has the record's own hash, so no record can hold its own mark, whatever its text says.
_MARK = "_end_of_record_"
_SCHEMA = (
    f"array<struct<{_MARK} string, type string, document struct<id string>, document_id string, mapping_version bigint, "
    "index struct<id string>, delete struct<id string>, IndexDocument struct<document struct<id string>, id string>, "
    "DeleteDocument struct<document_id string, id string>, MappingUpdate struct<mapping_version bigint>>>"
)
INDEX, DELETE, MAPPING, OTHER = "index", "delete", "mapping", "other"


def parsed(rows: DataFrame, record: str, name: str) -> DataFrame:
    """``rows`` with ``name``: struct<op, id> of a record, or null where the record isn't one complete JSON object.

    Null, empty and cut-off records, other JSON values and objects with anything but blanks
    behind them give null. ``id`` is the document the record itself names, else null. Of the
    three families of shapes ({"type": ...}, {"index": ...}, {"IndexDocument": ...}) the one
    that is there decides ``op``; an object of none of them is ``other``.
    """
    text = F.col(f"`{record}`")
    mark = F.xxhash64(text).cast("string")
    value = F.from_json(
        F.when(text.rlike(r"\A\s*\{"), F.concat(F.lit("["), text, F.lit(',{"' + _MARK + '":"'), mark, F.lit('"}]'))),
        _SCHEMA,
        {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"},
    )
    whole = F.col("_whole_record")
    r = F.get(whole, F.lit(0))
    kind = F.regexp_replace(F.lower(r["type"]), "[^a-z]", "")
    op = (
        F.when(kind.isin("indexdocument", "index") | r["index"].isNotNull() | r["IndexDocument"].isNotNull(), INDEX)
        .when(kind.isin("deletedocument", "delete") | r["delete"].isNotNull() | r["DeleteDocument"].isNotNull(), DELETE)
        .when(kind.isin("mappingupdate", "mapping") | r["MappingUpdate"].isNotNull(), MAPPING)
        .otherwise(OTHER)
    )
    named = F.coalesce(
        r["document"]["id"], r["document_id"], r["index"]["id"], r["delete"]["id"], r["IndexDocument"]["document"]["id"], r["IndexDocument"]["id"], r["DeleteDocument"]["document_id"], r["DeleteDocument"]["id"]
    )
    result = F.when((F.size(whole) == 2) & (F.get(whole, F.lit(1))[_MARK] == mark), F.struct(op.alias("op"), named.alias("id")))
    # each record is parsed once, whatever is made of it
    return rows.withColumn("_whole_record", computed_once(value)).withColumn(name, computed_once(result)).drop("_whole_record")
