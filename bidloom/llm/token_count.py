"""Token counts with a SentencePiece model; huge documents are encoded in overlapping chunks and spliced.

A boundary before a space that follows a character other than a space is stable when no piece of the vocabulary holds a space mark
after another character: no merge ever crosses it, so the pieces on both sides do not depend on each other. The vocabulary is tested
for this when it is loaded. Two neighbouring chunks are joined at a stable boundary at which both encodings begin a piece; when their
overlap has none, it is widened, in the end to the whole of both chunks. Counts are those of the whole text in every case.

Defined results: a NULL text is empty and has no bytes and no tokens. Repeated rows are counted each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_CHARS, OVERLAP_CHARS, LIMIT = 200_000, 2_000, 4096
MARK = "▁"
_MODELS: dict[str, object] = {}


def model(path: str):
    """The processor of a worker, loaded once, and whether stable boundaries exist."""
    if path not in _MODELS:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
        _MODELS[path] = sp, not any(MARK in p.lstrip(MARK) for p in pieces)
    return _MODELS[path]


def _begins(sp, text: str, at: int) -> list[int]:
    """Character places at which pieces begin; the library gives byte places."""
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.append(np.cumsum((raw & 0xC0) != 0x80) - 1, len(text)) + at
    return char[[p.begin for p in sp.encode(text, return_type="proto").pieces]].tolist()


def _stable(text: str, at: int) -> bool:
    return text[at] == " " and text[at - 1] not in (" ", MARK)


def count_spliced(sp, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of ``text`` from chunk encodings spliced at stable boundaries."""
    low, high = 0, min(len(text), chunk + overlap)
    done, total = 0, 0  # everything before ``done`` is counted
    begins = _begins(sp, text[low:high], low)
    while high < len(text):
        lap = overlap
        while True:
            back = max(done, high - lap)
            next_high = min(len(text), high + chunk)
            if back == done:  # nothing left to widen: one longer chunk from the last splice
                begins = _begins(sp, text[low:next_high], low)
                high = next_high
                break
            following = _begins(sp, text[back:next_high], back)
            common = set(begins).intersection(following)
            splice = next((p for p in range(back + 1, high) if p in common and _stable(text, p)), None)
            if splice is not None:
                total += sum(done <= b < splice for b in begins)
                done, low, high, begins = splice, back, next_high, following
                break
            lap *= 4
    return total + sum(b >= done for b in begins)


def count_texts(path: str, texts: list[str], chunk: int = CHUNK_CHARS) -> list[int]:
    sp, has_stable = model(path)
    long = [has_stable and len(t) > chunk for t in texts]
    short = iter(sp.encode([t for t, is_long in zip(texts, long) if not is_long], num_threads=1))
    return [count_spliced(sp, t, chunk) if is_long else len(next(short)) for t, is_long in zip(texts, long)]


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT, chunk: int = CHUNK_CHARS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. The model file lies at the same path on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                counts = count_texts(model_path, texts, chunk)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(t.encode()) for t in texts], pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([n > limit for n in counts], pa.bool_()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
