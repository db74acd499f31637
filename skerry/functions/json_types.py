"""Types of JSON values as variants."""

from __future__ import annotations

#: RFC 3339 needs date, time and offset; a date alone is no timestamp.
RFC3339 = r"\A\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})\z"
TYPES = ("Keyword", "Timestamp", "Boolean", "Integer", "Long", "Double", "Object", "Array")


def type_sql(v: str, schema: str | None = None) -> str:
    """SQL for the type name of the variant ``v``: null for null; whole numbers are Integer, Long, or Double beyond 64 bits.

    ``schema`` is a column that holds its ``schema_of_variant`` already.
    """
    schema, text = schema or f"schema_of_variant({v})", f"variant_get({v}, '$', 'string')"
    return f"""CASE
      WHEN {v} IS NULL OR {schema} = 'VOID' THEN NULL
      WHEN {schema} = 'STRING' THEN IF({text} RLIKE r'{RFC3339}' AND try_cast({text} AS timestamp) IS NOT NULL, 'Timestamp', 'Keyword')
      WHEN {schema} = 'BIGINT' THEN IF(try_variant_get({v}, '$', 'int') IS NOT NULL, 'Integer', 'Long')
      WHEN {schema} = 'BOOLEAN' THEN 'Boolean'
      WHEN {schema} LIKE 'OBJECT%' THEN 'Object'
      WHEN {schema} LIKE 'ARRAY%' THEN 'Array'
      ELSE 'Double' END"""
