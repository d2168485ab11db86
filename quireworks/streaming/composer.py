"""The page composer on a stream of source pages, keyed by document.

State per document: the open page, its cursor, the number of pages emitted and
source pages that arrived early.  Pages may come in any order; they are
composed by ``page_index``.  A row with ``last`` true ends its document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.compose import PAGES, Composer, ComposeError, Options

STATE = "page binary, x int, y int, line int, dirty boolean, emitted int, next long, end long, failed boolean, early array<struct<page_index:long,width:int,height:int,pixels:binary>>"


def compose_stream(rasters: DataFrame, options: Options) -> DataFrame:
    """Composed pages of ``rasters`` (doc_id, page_index from 0, width, height, pixels, last boolean), appended as they are finished."""
    names = [c.split()[0] for c in PAGES.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            *canvas, at, end, failed, early = state.get
            composer = Composer.restore(options, canvas)
            waiting = {r[0]: (r[1], r[2], r[3]) for r in early}
        else:
            composer, at, end, failed, waiting = Composer(options), 0, -1, False, {}
        for frame in frames:
            for r in frame.itertuples(index=False):
                waiting[r.page_index] = (r.width, r.height, r.pixels)
                if r.last:
                    end = r.page_index
        out = []

        def emit(pages: list[np.ndarray]) -> None:
            first = composer.emitted - len(pages)
            out.extend((key[0], first + i, options.width, options.height, p.tobytes(), None) for i, p in enumerate(pages, 1))

        try:
            while at in waiting and not failed:
                width, height, pixels = waiting.pop(at)
                composer.add(np.frombuffer(pixels, np.uint8).reshape(height, width, 3))
                emit(composer.take())
                at += 1
            if end >= 0 and at > end and not failed:
                emit(composer.finish())
        except (ComposeError, ValueError) as e:
            failed, waiting = True, {}
            out.append((key[0], 0, 0, 0, b"", str(e)))
        if end >= 0 and (at > end or failed):
            state.remove()
        else:
            state.update((*composer.state(), at, end, failed, [(k, *v) for k, v in waiting.items()]))
        yield pd.DataFrame(out, columns=names)

    return rasters.groupBy("doc_id").applyInPandasWithState(run, PAGES, STATE, "append", "NoTimeout")
