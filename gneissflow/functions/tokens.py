"""Token costs and clipped texts as columns, counted in the tasks that hold the rows.

The vocabulary is read once, by the driver, and sent to every worker.  A text is cut into the pieces that
byte pairs are merged in; the count of a piece is kept, so the merges of a repeated word are done once for
each worker and not for each row.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from .text import PATTERN, VOCABULARY, clip_py, encoding, estimate_bytes_py

KEPT = 1 << 18  # pieces whose counts a worker keeps
LONGEST = 64  # characters of a piece that is kept
_known: dict[tuple[int, int], Callable[[str], int]] = {}


def counter(vocabulary: bytes | None) -> Callable[[str], int]:
    """Tokens of a text, 1 at least; by size where there is no vocabulary."""
    if vocabulary is None:
        return estimate_bytes_py
    enc = encoding(vocabulary)
    try:
        import regex
    except ImportError:
        return lambda text: max(1, len(enc.encode_ordinary(text)))
    pieces, counts = regex.compile(PATTERN).findall, {}

    def count(text: str) -> int:
        if len(counts) > KEPT:
            counts.clear()
        total = 0
        for piece in pieces(text):
            n = counts.get(piece)
            if n is None:
                n = len(enc.encode_ordinary(piece))
                if len(piece) <= LONGEST:
                    counts[piece] = n
            total += n
        return max(1, total)

    return count


def with_tokens(df: DataFrame, text: str, tokens: str, limit: int | None = None, clipped: str = "clipped", vocabulary: str | None = VOCABULARY) -> DataFrame:
    """``df`` with the tokens of a text column, and with ``limit`` also the text cut to so many tokens.

    The clipped text ends in the marker where it was cut, as in ``clip_py``.  A null text has no tokens
    (null) and stays null.  Columns of these names are replaced; the rows and other columns stay.
    Without the vocabulary's file, or with none, tokens are UTF-8 bytes / 4.
    """
    raw = None
    if vocabulary is not None and os.path.exists(vocabulary):
        with open(vocabulary, "rb") as f:
            raw = f.read()
    sent = df.sparkSession.sparkContext.broadcast(raw)
    new = [tokens, *([clipped] if limit is not None else [])]
    own = df.drop(*[c for c in new if c != text])
    names = [*own.columns, *new]
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = os.getpid(), len(sent.value or b"")
        count = _known.get(key) or _known.setdefault(key, counter(sent.value))
        for batch in batches:
            counts, cut = [], []
            for x in batch.column(place):
                told = x.as_py()
                counts.append(None if told is None else count(told))
                if limit is not None:
                    cut.append(None if told is None else clip_py(told, limit, count))
            cols = [*batch.columns, pa.array(counts, pa.int64()), *([pa.array(cut, pa.string())] if limit is not None else [])]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = t.StructType([*own.schema.fields, t.StructField(tokens, t.LongType())])
    if limit is not None:
        schema = schema.add(clipped, t.StringType())
    return own.mapInArrow(run, schema)
