"""Facts that arrive in micro-batches, with rules run to their fixpoint after each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.persistence import saved
from ..operators.program import Program


def load_and_saturate(program: Program, table: str, batch: DataFrame, ruleset: str = "") -> int:
    """Adds a batch and runs the rules; only what the batch changes is joined. Returns the number of steps."""
    program.load(table, batch)
    return program.saturate(ruleset)


def start(program: Program, table: str, stream: DataFrame, checkpoint: str, ruleset: str = "", after: Callable[[Program, int], None] | None = None) -> StreamingQuery:
    """Runs :func:`load_and_saturate` for every micro-batch of a stream, then ``after(program, batch number)``.

    The facts of earlier batches are needed for what later ones derive, so this is for a program that lives as
    long as the stream does; :func:`start_saved` is for streams that are started again.
    """

    def one(df: DataFrame, number: int) -> None:
        load_and_saturate(program, table, df, ruleset)
        if after:
            after(program, number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_saved(make: Callable[[], Program], table: str, stream: DataFrame, checkpoint: str, ruleset: str = "") -> tuple[Program, StreamingQuery]:
    """Like :func:`start`, with the program saved beside the stream's own checkpoint after every batch.

    Where a saved program is there, it goes on from its step; else ``make`` gives a new one. A batch that was saved
    already and is delivered again, as after a crash between both checkpoints, is left out, so that merges that
    aren't idempotent count it once.
    """
    path = f"{checkpoint}/program"
    spark = stream.sparkSession
    program = Program.resume(spark, path) if saved(spark, path) else make()
    done = program.resumed.get("batch", -1)

    def one(df: DataFrame, number: int) -> None:
        if number > done:
            load_and_saturate(program, table, df, ruleset)
            program.save(path, batch=number)

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
    return program, query
