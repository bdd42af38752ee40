"""Where a model or an endpoint plugs in: batches in, one text a row out, with retries, resume and a deterministic mock."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Makes a client on the executor; a client maps a list of prompts to texts (None: it has none).
Client = Callable[[], Callable[[list[str]], list[str | None]]]


def mock_client() -> Callable[[list[str]], list[str | None]]:
    """Deterministic stand-in: the prompt's last line."""
    return lambda prompts: [p.rsplit("\n", 1)[-1] for p in prompts]


def generated(rows: DataFrame, prompt: str, out: str, client: Client = mock_client, batch: int = 64, tries: int = 6, wait_s: float = 0.5) -> DataFrame:
    """Adds out for each row. Rows go in order of prompt length, so that a batch has texts of like size.

    A failed batch is tried again, waiting twice as long each time; what is still missing stays null, and
    complete() refuses it.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for frame in frames:
            texts: list[str | None] = []
            for i in range(0, len(frame), batch):
                prompts = frame[prompt].iloc[i : i + batch].tolist()
                got: list[str | None] = [None] * len(prompts)
                for attempt in range(tries):
                    missing = [k for k, x in enumerate(got) if x is None]
                    if not missing:
                        break
                    if attempt:
                        time.sleep(wait_s * 2 ** (attempt - 1))
                    try:
                        for k, x in zip(missing, ask([prompts[k] for k in missing])):
                            got[k] = x
                    except (OSError, TimeoutError):
                        continue
                texts += got
            yield frame.assign(**{out: texts})

    return rows.sortWithinPartitions(F.length(prompt)).mapInPandas(run, schema)


def resumed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that an earlier run hasn't finished."""
    return rows.join(done.select(key), key, "left_anti")


def complete(rows: DataFrame, out: str) -> DataFrame:
    """The rows, or an error if any has no text."""
    if not rows.where(F.col(out).isNull()).isEmpty():
        raise ValueError("some rows have no text")
    return rows


def round_trip_kept(passed, need):
    """Policy: a failure drops only rows that need the round trip much; skipped (null) isn't failed."""
    return ~((need == "high") & (passed.isNotNull() & ~passed))
