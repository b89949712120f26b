"""Counts of words over all documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedloom.llm.common import cuts

#: Words that a task counts before it hands their counts on.
HELD = 300_000
#: Single-byte code points: letters stay, A-Z lower-cased, everything else parts them.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def letter_runs(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, a byte a code point, only A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def counted(texts: DataFrame, words_of: Callable[[object, str], Iterable[bytes] | Mapping[bytes, int]], held: int = HELD) -> DataFrame:
    """``word, n``: how often ``words_of(id, text)`` gives each word (bytes of latin-1), over all rows of the two columns ``texts``.

    Each task adds up its rows and hands on one row a word, more only where it has met ``held`` words; null texts have no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for at, n in cuts(batch, 1000, 8_000_000):
                part = batch.slice(at, n)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if text:
                        total.update(words_of(i, text))
                if len(total) > held:
                    yield flushed()
        if total:
            yield flushed()

    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
