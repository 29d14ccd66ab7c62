"""Arrow maps over whole texts: bounded memory, one pass, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tradeweave.session import ship_package

#: Rows handed to numpy or to a tokenizer at once; texts are of any length, so batches are cut by characters.
BATCH_CHARS = 4_000_000


def per_text(docs: DataFrame, prepare: Callable[[], Callable[[list[str]], list[tuple]]], fields: str, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of each row next to the values computed from its whole text.

    ``prepare`` runs once a task and returns a function from a list of texts (a
    null is an empty text) to one tuple a text.  Rows are handled where they
    lie: repeated rows stay repeated, an empty table stays empty, and a
    lost executor costs only its own tasks again.
    """
    ship_package(docs.sparkSession)
    added = T._parse_datatype_string(fields)
    kept = docs.select(*keep).schema
    arrow = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = prepare()
        for batch in batches:
            for part in _cut(batch):
                rows = compute([x or "" for x in part.column(part.num_columns - 1).to_pylist()])
                made = [pa.array([row[i] for row in rows], type=field.type) for i, field in enumerate(arrow)]
                columns = [part.column(i) for i in range(part.num_columns - 1)] + made
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    out = T.StructType(kept.fields + added.fields)
    chosen = docs.select(*keep, F.col(text).cast("string").alias("whole text to map"))
    return chosen.mapInArrow(run, out)


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about BATCH_CHARS; a longer text is a slice of its own."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(lengths):
        if held and held + size > BATCH_CHARS:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def per_group(rows: DataFrame, key: str, compute: Callable[[pa.Table], dict[str, list]], fields: str) -> DataFrame:
    """Rows made from each group of equal long keys.

    Like a grouped map, but one pass over sorted batches: with very many groups of a
    few rows, setting up a data frame for each would cost more than the work.
    ``compute`` gets one group as a table and returns columns.
    """
    ship_package(rows.sparkSession)
    schema = T._parse_datatype_string(fields)
    arrow = to_arrow_schema(schema)

    def made(parts: list[dict[str, list]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for part in parts for x in part[f.name]], type=f.type) for f in arrow], names=arrow.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            done = []
            for a, b in zip(cuts, cuts[1:]):
                if held and keys[a] != open_key:
                    done.append(compute(pa.Table.from_batches(held)))
                    held = []
                open_key = keys[a]
                held.append(batch.slice(a, b - a))
            if done:
                yield made(done)
        if held:
            yield made([compute(pa.Table.from_batches(held))])

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)
