"""Folds over ordered groups with a state of a few numbers.

Rows are dealt by key, sorted within partitions and streamed through a function that sees
them in order; a group is never gathered, so its size does not matter for memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame


def folded(rows: DataFrame, keys: list[str], order: list[Column | str], value: str, start: Callable[[], Callable], output: str, kind: str) -> DataFrame:
    """``rows`` and the column ``output`` (of SQL type ``kind``): ``start()`` gives a group's step
    function, which maps each ``value`` in order to the output; rows whose output is None go."""
    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, step = None, None
        for pdf in batches:
            out = []
            for key, v in zip(zip(*(pdf[k] for k in keys)), pdf[value]):
                if step is None or key != now:
                    now, step = key, start()
                out.append(step(v))
            pdf = pdf.assign(**{output: pd.Series(out, index=pdf.index, dtype=object)})
            yield pdf[pdf[output].notna()]

    return sorted_rows.mapInPandas(run, f"{fields}, `{output}` {kind}")
