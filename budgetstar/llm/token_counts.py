"""Token counts per document from compiled transducers and composed chunk maps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from budgetstar.llm.text import kept_by_worker, pieces, plain, texts_of
from budgetstar.llm.transducer import Counter, reduce_tree, scan

CHUNK = 16_384  # characters
LIMIT = 512


def chunks(text: str, size: int = CHUNK) -> list[str]:
    return [text[a : a + size] for a in range(0, max(1, len(text)), size)]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` per input row; null text counts as empty.

    ``tokenizer`` is the path of a byte-level BPE file that all executors can read. A row stays in
    its task: its chunks become state maps and are composed there, so nothing is shuffled.
    """
    docs = plain(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_by_worker(f"counter {tokenizer}", lambda: Counter(tokenizer))
        for batch in pieces(batches):
            raw = texts_of(batch.column("text"))
            counts = []
            for t in raw:
                maps = [counter.chunk(c) for c in chunks(t.decode("utf-8", "surrogatepass"))]
                counts.append(counter.closed(reduce_tree(maps, counter.compose)))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pa.array([len(t) for t in raw], pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "over_limit": pa.array([c > limit for c in counts], pa.bool_()),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def chunk_positions(text: str, counter: Counter, size: int = CHUNK) -> list[int]:
    """Tokens of every prefix of chunks, from the prefix scan over their maps."""
    return [counter.closed(m) for m in scan([counter.chunk(c) for c in chunks(text, size)], counter.compose)]
