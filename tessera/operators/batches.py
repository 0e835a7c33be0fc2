"""Python parsers over a column of texts, in Arrow batches and without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Texts that are worked on before their rows are passed on.
SLICE = 256


def rows_of_texts(docs: DataFrame, fields: str, rows: Callable[[str], list[tuple]], id_col: str = "doc_id", text_col: str = "text", name: str = "doc_id") -> DataFrame:
    """(``name``, ``fields``...): the rows that ``rows`` makes of each text, with the text's id of whatever type.

    Null texts count as empty; bytes that aren't UTF-8 become U+FFFD. Of the columns only these two are read."""
    kept = docs.select(F.col(id_col).alias(name), F.make_valid_utf8(F.col(text_col).cast("string")).alias("__text"))
    schema = StructType([kept.schema[name], *StructType.fromDDL(fields)])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                made = [(i, *r) for i, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True) for r in rows(t or "")]
                columns = list(zip(*made, strict=True)) if made else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return kept.mapInArrow(run, schema)
