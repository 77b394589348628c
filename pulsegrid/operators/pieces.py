"""Functions of one's own over the mask-free pieces of recordings, streamed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.intervals import REC, assign, interval_complement

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def over_pieces(table: DataFrame, masks: DataFrame, bounds: DataFrame, run: Run, schema: str, order: str = "t") -> DataFrame:
    """(rec_id, start, stop, schema) of run over the rows of table (rec_id, t, ...) in each piece of bounds (rec_id, lo, hi) that no mask covers.

    run takes the piece's rows, in order of time, as an iterator of Arrow batches and yields batches of `schema`; it may stop early. A
    piece of any length passes: a task holds a batch of it. Both ends of a piece belong to it; pieces without rows are left out, and
    rows without a recording or time take no part. Columns of table may have any names but start and stop.
    """
    free = interval_complement(masks, bounds)
    held = assign(table.where(F.col(order).isNotNull() & F.col(REC).isNotNull()), free, t=order).where("start IS NOT NULL")
    kind, names = table.schema[REC].dataType.simpleString(), table.columns

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            recs = batch.column(REC).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            start = batch.column("start").to_numpy()
            cuts = [0, *(np.flatnonzero((recs[1:] != recs[:-1]) | (start[1:] != start[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = batch.slice(a, b - a)
                yield (own.column(REC)[0].as_py(), int(start[a]), own.column("stop")[0].as_py()), own.select(names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        type_ = first.schema.field(REC).type
        for (rec, start, stop), rows in groupby(parts(chain([first], batches)), key=lambda p: p[0]):
            given = (b for _, b in rows)
            for out in run(given):
                n = out.num_rows
                head = [pa.array([rec] * n, type_), pa.array([start] * n, pa.int64()), pa.array([stop] * n, pa.int64())]
                yield pa.RecordBatch.from_arrays([*head, *out.columns], [REC, "start", "stop", *out.schema.names])
            for _ in given:  # what run left unread
                pass

    dealt = held.repartition(REC, "start").sortWithinPartitions(REC, "start", order)
    return dealt.mapInArrow(each, f"{REC} {kind}, start long, stop long, {schema}")
