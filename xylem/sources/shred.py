"""Documents to tables: nodes, events, errors, declarations.

Each is one Arrow pass over (id, xml) with a document at a time in Python; all
that follows is joins and windows over the tables, hashed on the document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .parser import ERROR_SCHEMA, EVENT_SCHEMA, NODE_SCHEMA, Parser, parse


def per_document(docs: DataFrame, rows_of: Callable[[Parser], list], schema: str, id_col: str, xml_col: str, options: dict, rows: int = 20_000) -> DataFrame:
    """Rows of each document behind its id. Output goes in batches of about ``rows``, so a large document is no large batch."""
    kind = docs.schema[id_col].dataType
    full = T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(full)
        names = [f.name for f in full.fields]

        def batch_of(ids, held):
            columns = [ids, *zip(*held, strict=True)]
            nested = lambda v, t: [None if x is None else [dict(zip([f.name for f in t.value_type], i, strict=True)) for i in x] for x in v]
            return pa.RecordBatch.from_arrays([pa.array(nested(c, t) if pa.types.is_list(t) and pa.types.is_struct(t.value_type) else c, t) for c, t in zip(columns, arrow.types, strict=True)], names)

        for batch in batches:
            ids: list = []
            held: list = []
            for id_, xml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = rows_of(parse(xml, **options))
                held += found
                ids += [id_] * len(found)
                if len(held) >= rows:
                    full_ = len(held) - len(held) % rows
                    for at in range(0, full_, rows):
                        yield batch_of(ids[at : at + rows], held[at : at + rows])
                    ids, held = ids[full_:], held[full_:]
            if held:
                yield batch_of(ids, held)

    return docs.select(F.col(id_col), F.col(xml_col)).mapInArrow(run, full)


def shred(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "xml", **options) -> DataFrame:
    """The node table. A malformed document gives no nodes; see ``errors``."""
    return per_document(docs, lambda p: [] if any(e[0] == "fatal error" for e in p.errors) else p.nodes, NODE_SCHEMA, id_col, xml_col, {"record": False} | options)


def events(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "xml", **options) -> DataFrame:
    """SAX events in order; up to the error in a malformed document."""
    return per_document(docs, lambda p: p.events, EVENT_SCHEMA, id_col, xml_col, options)


def errors(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "xml", **options) -> DataFrame:
    return per_document(docs, lambda p: p.errors, ERROR_SCHEMA, id_col, xml_col, options)


def well_formed(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "xml", **options) -> DataFrame:
    """(doc_id, well_formed, namespace_well_formed)"""
    return per_document(docs, lambda p: [(not any(e[0] == "fatal error" for e in p.errors), not p.errors)], "well_formed boolean, namespace_well_formed boolean", id_col, xml_col, options)


def attribute_declarations(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "xml", **options) -> DataFrame:
    def rows(p: Parser):
        return [(e, a, kind, default, required) for e, d in p.dtd.attributes.items() for a, (kind, default, required) in d.items()]

    return per_document(docs, rows, "element string, attribute string, type string, default string, required boolean", id_col, xml_col, options)


def entity_declarations(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "xml", **options) -> DataFrame:
    return per_document(docs, lambda p: [(k, *v) for k, v in p.dtd.entities.items()], "name string, value string, system_id string, public_id string, notation string", id_col, xml_col, options)


def next_tags(event_rows: DataFrame) -> DataFrame:
    return event_rows.where(F.col("event").isin("startElement", "endElement"))
