"""Arrow batch helpers for the Python stages of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa


def text_stage(fields: list[tuple[str, pa.DataType]], work: Callable[[pa.RecordBatch], list[list]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function: ``work`` turns a batch into one Python list per output field."""
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = work(batch)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, fields)], schema=schema)

    return run
