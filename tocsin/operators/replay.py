"""Order-dependent scans over long streams, cut into time chunks that run in parallel.

A scan whose every step may depend on the step before it is sequential by nature; one hot scope would
be one endless task. Here each (scope, chunk of time) starts from a state warmed up on the rows just
before the chunk, all chunks at once. Then every chunk's starting state is compared with the state its
predecessor really ended in, and the chunks that guessed wrong run again from the right one, until none
is left. When all borders agree the result is the sequential one, by induction over the chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tocsin.session import cut_lineage, ship_package


class State(Protocol):
    """State of one scope: ``step`` consumes a row, ``dump`` is canonical, ``expire`` forgets the old."""

    def step(self, row) -> list[dict]: ...
    def expire(self, now: float) -> object: ...
    def dump(self) -> str: ...


Frame = Callable[[list[tuple[object, dict]]], pd.DataFrame]


def _runner(new_state: Callable[[str | None], State], frame: Frame, scope: str, chunk_s: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, start, done = None, None, None, []

        def finish():
            # the border states of a chunk, once it has rows of its own
            if current is None or start is None:
                return
            state.expire((current[1] + 1) * chunk_s)
            done.append((current[0], current[1], start, state.dump()))

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if (r.scope_key, r.chunk_no) != current:
                    finish()
                    current, start = (r.scope_key, r.chunk_no), None
                    state = new_state(r.seed if r.part == 0 else None)
                if r.part == 0:
                    continue
                if r.part == 2 and start is None:
                    state.expire(r.chunk_no * chunk_s)
                    start = state.dump()
                out = state.step(r)
                if r.part == 2:
                    rows.extend((r, o) for o in out)
            if rows or done:
                yield _with_states(frame(rows), rows, done)
                done = []
        finish()
        if done:
            yield _with_states(frame([]), [], done)

    return run


def _with_states(body: pd.DataFrame, rows: list, done: list[tuple]) -> pd.DataFrame:
    body = body.assign(scope_key=[r.scope_key for r, _ in rows], chunk_no=[r.chunk_no for r, _ in rows],
                       start_state=None, end_state=None)
    if not done:
        return body
    tail = body.iloc[:0].reindex(range(len(done)))  # all null, with the dtypes of the body
    for c in tail.columns[tail.dtypes == object]:
        tail[c] = pd.Series([None] * len(done), dtype="object")
    for i, c in enumerate(("scope_key", "chunk_no", "start_state", "end_state")):
        tail[c] = [d[i] for d in done]
    return tail if body.empty else pd.concat([body, tail], ignore_index=True)


def replay(df: DataFrame, scope: str, ts: str, tie: str, chunk_s: int, warm_s: int, schema: str,
           new_state: Callable[[str | None], State], frame: Frame, label: str) -> DataFrame:
    """Rows of ``schema`` produced by running the state over each scope in (ts, tie) order.

    ``new_state(None)`` is an empty state, ``new_state(dump)`` restores one; ``frame`` turns
    (row, outcome) pairs into a pandas frame of ``schema``. ``tie`` must be unique within a scope. A null
    scope is a scope of its own; rows without a time have no place in the order and are left out. Repaired
    chunks are appended, the last run of a chunk counts.
    """
    ship_package()
    chunk = F.floor(F.unix_micros(ts) / F.lit(chunk_s * 1_000_000)).cast("long")
    scope_key = F.coalesce(F.concat(F.lit("="), F.col(scope).cast("string")), F.lit("null"))
    own = df.where(F.col(ts).isNotNull()).withColumns({
        "scope_key": scope_key, "chunk_no": chunk, "part": F.lit(2), "seed": F.lit(None).cast("string")})
    own = cut_lineage(own, f"{label}-rows")
    until = (F.col("chunk_no") + 1) * (chunk_s * 1_000_000) - F.unix_micros(ts)
    warm = own.where(until <= warm_s * 1_000_000).withColumn("chunk_no", F.col("chunk_no") + 1).withColumn(
        "part", F.lit(1))
    run = _runner(new_state, frame, scope, chunk_s)
    full = f"{schema}, scope_key string, chunk_no long, start_state string, end_state string"

    def execute(rows: DataFrame, step: int) -> DataFrame:
        ordered = rows.repartition("scope_key", "chunk_no").sortWithinPartitions(
            "scope_key", "chunk_no", (F.col("part") > 0), ts, tie)
        return cut_lineage(ordered.mapInPandas(run, full).withColumn("round", F.lit(step)), f"{label}-{step}")

    empty = new_state(None).dump()
    key = ["scope_key", "chunk_no"]
    rounds = [execute(own.unionByName(warm), 0)]
    states = rounds[0].where("start_state IS NOT NULL").select(*key, "round", "start_state", "end_state")
    last = None
    while True:
        before = states.select("scope_key", (F.col("chunk_no") + 1).alias("chunk_no"),
                               F.col("end_state").alias("seed"))
        wrong = states.join(before, key, "left").withColumn("seed", F.coalesce("seed", F.lit(empty))).where(
            F.col("seed") != F.col("start_state")).select(*key, "seed")
        step = len(rounds)
        wrong = cut_lineage(wrong, f"{label}-wrong-{step}")
        if wrong.isEmpty():
            break
        if last is not None and wrong.join(last, [*key, "seed"], "left_anti").isEmpty():
            raise RuntimeError(f"{label}: a round repaired nothing")
        last = wrong
        seeds = wrong.withColumn("part", F.lit(0))
        again = own.join(wrong.select(*key), key, "left_semi").unionByName(seeds, allowMissingColumns=True)
        rounds.append(execute(again, step))
        redone = rounds[-1].where("start_state IS NOT NULL").select(*states.columns)
        states = cut_lineage(states.join(redone.select(*key), key, "left_anti").unionByName(redone), f"{label}-states-{step}")
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    out = every.where("start_state IS NULL")
    if len(rounds) > 1:  # of a chunk that ran again, the last run counts
        out = out.join(states.select(*key, "round"), [*key, "round"], "left_semi")
    return out.drop(*key, "round", "start_state", "end_state")
