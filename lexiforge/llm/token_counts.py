"""Token counts by offset-mapped attribution (op8).

Every whole text is encoded once with a byte-level BPE; the byte spans of its tokens are joined
to the intervals of its sections.  A token belongs to the section that holds most of its bytes,
ties to the earlier section, so a token that crosses a boundary is counted exactly once.  Bytes in
no section form the section -1.

Sections are the lines of the text (a newline ends its line) or given per row as
``array<struct<start:int,end:int>>`` in code points, ascending and disjoint.  Defined results: a
null or empty text gives one row, section 0 with zero tokens; special-token strings are ordinary
text; repeated rows are counted alike.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexiforge.llm.words import binary_column

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # a path on every executor
# Fixed value: the split pattern that belongs to this public vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for piece, rank in ranks.items():
        sizes[rank] = len(piece)
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def token_spans(text: bytes, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the tokens of a text; they tile it."""
    enc, sizes = _encoding(path)
    ends = np.cumsum(sizes[np.array(enc.encode_ordinary(text.decode("utf-8", "replace")), dtype=np.int64)])
    return np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends, ends


def attribute(starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Index of the interval [cuts[i], cuts[i+1]) that holds most of each span, ties to the earlier."""
    first = np.searchsorted(cuts, starts, side="right") - 1
    last = np.searchsorted(cuts, ends, side="left") - 1
    best = first.copy()
    for t in np.flatnonzero(last > first):
        inner = cuts[first[t]:last[t] + 2].clip(starts[t], ends[t])
        best[t] = first[t] + int(np.argmax(np.diff(inner)))
    return best


def _line_cuts(b: np.ndarray) -> np.ndarray:
    cuts = np.concatenate([[0], np.flatnonzero(b == 10) + 1, [len(b)]])
    return np.unique(cuts)


def _section_cuts(b: np.ndarray, sections: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Cuts that tile the text, and the section of each tile (-1: none)."""
    chars = np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))
    cuts, owner, at = [0], [], 0
    for k, s in enumerate(sections):
        lo, hi = (int(chars[min(s[x], len(chars) - 1)]) for x in ("start", "end"))
        if lo > at:
            cuts.append(lo)
            owner.append(-1)
        if hi > max(lo, at):
            cuts.append(hi)
            owner.append(k)
            at = hi
    if at < len(b):
        cuts.append(len(b))
        owner.append(-1)
    return np.array(cuts), np.array(owner)


def count_tokens(docs: DataFrame, sections: str | None = None, path: str = VOCABULARY) -> DataFrame:
    """One row per document and section: (doc_id, section, start, end, n_tokens); start and end in bytes."""
    src = docs.select("doc_id", "text", *([sections] if sections else []))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            given = batch.column(2).to_pylist() if sections else None
            rows, cols, held = [], [[], [], [], []], 0
            for r, raw in enumerate(binary_column(batch, "text")):
                if not raw:
                    part = [np.zeros(1, dtype=np.int64)] * 4
                else:
                    raw = raw.decode("utf-8", "replace").encode()
                    b = np.frombuffer(raw, dtype=np.uint8)
                    cuts, owner = (_section_cuts(b, given[r] or [])) if given else (_line_cuts(b), None)
                    owner = np.arange(len(cuts) - 1) if owner is None else owner
                    n = np.bincount(attribute(*token_spans(raw, path), cuts), minlength=len(owner))
                    part = [owner, cuts[:-1], cuts[1:], n]
                rows.append(np.full(len(part[0]), r))
                held += len(part[0])
                for c, p in zip(cols, part, strict=True):
                    c.append(p)
                if held > 50_000:
                    yield _batch(ids, rows, cols)
                    rows, cols, held = [], [[], [], [], []], 0
            if rows:
                yield _batch(ids, rows, cols)

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(task, f"doc_id {kind}, section int, start long, end long, n_tokens long")


def _batch(ids: pa.Array, rows: list[np.ndarray], cols: list[list[np.ndarray]]) -> pa.RecordBatch:
    section, start, end, n = (np.concatenate(c) for c in cols)
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(np.concatenate(rows))), pa.array(section, pa.int32()), pa.array(start, pa.int64()),
         pa.array(end, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "section", "start", "end", "n_tokens"])
