"""Linking of a stream of records to a stored record set.

The stored side is a plain DataFrame, so each micro-batch is one equi-join on grid cells and keeps no state. Candidates
and links above a threshold can be appended as they come; the best match of each record is final within its
micro-batch, since all stored records are there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridlink.operators.resolve import CELL_SIZE, Scorer, best_matches, matches, scored_pairs

SCHEMA = "side string, source string, ordinal long, name string, latitude double, longitude double, fields map<string,string>"


def links(stream: DataFrame, stored: DataFrame, scorer: Scorer, threshold: float, cell_size: float = CELL_SIZE) -> DataFrame:
    """Every pair of a streamed and a stored record that meets the threshold; append mode. Records without coordinates
    have no pair; null names score 0; an empty side gives no row."""
    return scored_pairs(stream, stored, scorer, cell_size).where(matches(F.col("score"), threshold))


def best_links(stream: DataFrame, stored: DataFrame, scorer: Scorer, threshold: float, sink: Callable[[DataFrame, int], None], checkpoint: str, cell_size: float = CELL_SIZE) -> StreamingQuery:
    """Starts a query that gives sink the best stored match of each streamed record, batch by batch. A batch that is
    repeated after a failure has the same number, by which a sink can tell it."""
    def step(batch: DataFrame, number: int) -> None:
        sink(best_matches(scored_pairs(batch, stored, scorer, cell_size), threshold), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
