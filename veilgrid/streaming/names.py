"""Name memory over a stream of pages: the names of a document are its state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import capital_words, is_name_evidence, name_tokens


def name_memory_stream(lines: DataFrame, idle: str | None = "1 hour") -> DataFrame:
    """(doc_id, page, line_no) of lines that mention a name known by then; lines is a stream with the columns of schema.LINES.

    Patterns run in the JVM; the state function only matches words to names. It holds, for each name of a document, the first
    page that had it, so lines that arrive later are judged by pages, not by arrival. A line that arrives before the page
    that names its person isn't revisited: the memory reaches forward only. State goes when a document is idle.
    """
    names = F.when(is_name_evidence(F.col("text")), F.transform(name_tokens(F.col("text")), F.lower)).otherwise(F.array().cast("array<string>"))
    told = lines.select("doc_id", "page", "line_no", names.alias("names"), capital_words(F.col("text")).alias("words"))
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["page", "line_no"])
        for page, these in zip(rows["page"], rows["names"], strict=True):
            for n in these:
                seen[n] = min(page, seen.get(n, page))
        hit = [any(seen.get(w, page + 1) <= page for w in words) for page, words in zip(rows["page"], rows["words"], strict=True)]
        state.update((list(seen), [int(p) for p in seen.values()]))
        if wait:
            state.setTimeoutDuration(wait)
        yield rows.loc[hit, ["page", "line_no"]].assign(doc_id=key[0])[["doc_id", "page", "line_no"]]

    timeout = GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout
    return told.groupBy("doc_id").applyInPandasWithState(step, "doc_id long, page int, line_no int", "names array<string>, pages array<int>", "append", timeout)
