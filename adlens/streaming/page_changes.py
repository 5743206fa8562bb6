"""Page versions as a stream: a keyed state holds each url's newest hash, and each new version is compared with it.

Defined cases: versions without text or url are left out; versions older than the state are reported as late and change nothing; equal
times are compared in the order in which they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "url string, fetched_at timestamp, text_hash string, changed boolean, late boolean"
STATE = "at timestamp, text_hash string"


def _compare(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at, held = state.get if state.exists else (None, None)
    rows = pd.concat(list(parts)).sort_values("fetched_at", kind="stable")
    out = []
    for when, text_hash in zip(rows["fetched_at"], rows["text_hash"]):
        late = at is not None and when < pd.Timestamp(at)
        out.append((key[0], when, text_hash, None if held is None or late else held != text_hash, late))
        if not late:
            at, held = when.to_pydatetime(), text_hash
    state.update((at, held))
    yield pd.DataFrame(out, columns=["url", "fetched_at", "text_hash", "changed", "late"]).astype({"changed": object})


def changes(stream: DataFrame) -> DataFrame:
    """(url, fetched_at, text_hash, changed, late) for every version in the stream (url, fetched_at, text)."""
    rows = stream.filter("text IS NOT NULL AND url IS NOT NULL AND fetched_at IS NOT NULL").select("url", F.col("fetched_at").cast("timestamp").alias("fetched_at"), F.sha2("text", 256).alias("text_hash"))
    return rows.groupBy("url").applyInPandasWithState(_compare, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
