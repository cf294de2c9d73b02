"""Exact substring dedup by bucket-pointer refinement on sampled suffixes (op1).

A byte is removed if a LENGTH-byte string that covers it also starts anywhere else, in another text or
the same one.  Strings are judged on the input.

* Identifiers: the bucket identifier of a 2h-gram is made from those of the h-grams at offsets 0 and
  h, recursively up to the initial bucket width Q.
* Sample: the start of every window of LENGTH bytes is charged to the suffix in it whose Q-gram has the
  least identifier (leftmost on ties).  The choice depends on the window's bytes alone, so equal
  windows are charged to suffixes of one bucket at one offset.  About one suffix in 170 is sampled.
* Round 1: suffixes alone in their Q-gram bucket are settled, with all their windows.
* Round 2: what is left is refined by the identifier of its strip, the bytes of all its
  windows.  Suffixes whose strip recurs are settled; one of each strip stays as partner.
* Round 3: the strips of buckets with open suffixes are compared window by window: a bucket of up to
  HOT strips in one task, whose identifiers are refined from width Q to LENGTH.  A larger bucket is
  first split by the identifiers at later offsets: into cells of CELL window starts, by the bytes
  common to the cell.  Cells that are still larger are counted window by window in an
  aggregation.  So no task gathers a bucket of unbounded size and nothing is dropped.

Only sampled suffixes are shuffled, and texts twice, compressed.  Rows that agree in id and text are
still separate texts, so each removes what the other holds.  Null counts as empty; shorter texts
keep all bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import written
from lexiforge.llm.words import _BYTE, binary_column, by_key, mix64

LENGTH = 400
Q = 64
CELL = 16
HOT = 4096
_PIECE = 1 << 20
_LOW = np.uint64(_PIECE - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def identifiers(b: np.ndarray, width: int) -> np.ndarray:
    """64-bit bucket identifiers of all ``width``-grams, by doubling."""
    h, have = _BYTE[b], 1
    while have < width:
        step = min(have, width - have)
        h = mix64(h[:-step] * _ODD + h[step:]) if len(h) > step else h[:0]
        have += step
    return h


def _digest(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def sampled(text: bytes, length: int = LENGTH, q: int = Q) -> Iterator[tuple[np.ndarray, ...]]:
    """Sampled suffixes with the window starts charged to them: (identifier, position, first, last)."""
    w = length - q + 1
    for at in range(0, len(text) - length + 1, _PIECE - w):
        h = identifiers(np.frombuffer(text[at:at + _PIECE - w + length - 1], dtype=np.uint8), q)
        v = (mix64(h) & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        low, have = v, 1
        while have < w:
            step = min(have, w - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        cut = np.flatnonzero(low[1:] != low[:-1])
        first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(low) - 1]])
        pos = (low[first] & _LOW).astype(np.int64)
        yield h[pos].astype(np.int64), pos + at, first + at, last + at


def removed_runs(n: int, windows: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows that start in [first, last], given in any order."""
    runs: list[list[int]] = []
    for first, last in sorted(windows):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], last + length)
        else:
            runs.append([first, last + length])
    return [(a, min(b, n)) for a, b in runs]


def _repeated(strips: list[bytes], firsts: list[int], lasts: list[int], rel: list[int], length: int) -> list[np.ndarray]:
    """For every strip, which of its windows (first to last) recur in the bucket.

    ``rel``: distance from the strip's first window to its sampled suffix, so that only windows at
    one offset from it are compared.
    """
    flat = np.frombuffer(b"".join(strips), dtype=np.uint8)
    h = identifiers(flat, length)
    size = np.array([len(s) for s in strips])
    start = np.cumsum(size) - size
    n = np.array(lasts) - np.array(firsts) + 1
    owner = np.repeat(np.arange(len(strips)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    names = mix64(h[start[owner] + inner] + (np.array(rel)[owner] - inner).astype(np.uint64) * _ODD)
    _, inv, count = np.unique(names, return_inverse=True, return_counts=True)
    again = count[inv] > 1
    return np.split(again, np.cumsum(n)[:-1])


def _runs(again: np.ndarray, first: int) -> list[tuple[int, int]]:
    step = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
    return [(first + int(a), first + int(b) - 1) for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]


def dedup(docs: DataFrame, length: int = LENGTH, q: int = Q, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of ``docs`` (doc_id, text);
    spans are the maximal removed byte runs as array<struct<start, end>>."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    src = docs.select(F.xxhash64("doc_id", "text").alias("at"), "doc_id", "text")
    names = ["bucket", "strip", "at", "pos", "first", "last"]

    def sample_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, cols = 0, [[] for _ in names]
            for key, text in zip(batch.column(0).to_pylist(), binary_column(batch, "text"), strict=True):
                for ident, pos, first, last in sampled(text, length, q):
                    strip = [_digest(text[a:b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                    for c, v in zip(cols, (ident, np.array(strip, dtype=np.int64), np.full(len(pos), key), pos, first, last), strict=True):
                        c.append(v)
                    held += len(pos)
                if held > 50_000:
                    yield _batch(names, cols)
                    held, cols = 0, [[] for _ in names]
            if held:
                yield _batch(names, cols)

    sample = written(src.where(F.octet_length("text") >= length).select("at", "text")
                     .mapInArrow(sample_task, ", ".join(f"{n} long" for n in names)), "suffix-sample")
    shared = written(sample.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "suffix-buckets")
    left = written(sample.join(shared, "bucket", "left_semi"), "suffix-open")
    strips = written(left.groupBy("bucket", "strip").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in names[2:]]), "suffix-strips")
    settled = left.join(strips.where("n > 1").select("bucket", "strip"), ["bucket", "strip"], "left_semi").select("at", "first", "last")
    mixed = written(strips.groupBy("bucket").agg(F.min("n").alias("least"), F.count("*").alias("size"))
                    .where("least = 1 and size > 1").select("bucket", "size"), "suffix-mixed")
    work = (strips.join(mixed, "bucket").groupBy("at").agg(F.collect_list(F.struct(
        "bucket", "pos", "first", "last", (F.col("size") > hot).alias("hot"), (F.col("n") == 1).alias("open"))).alias("work")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([z.compress(t or b"") for t in binary_column(batch, "text")], pa.binary())],
                                             names=[*batch.schema.names[:-1], "packed"])

    # a text that is repeated under one id has no open suffix, so its repeated pieces change nothing
    texts = src.where(F.octet_length("text") >= length).select("at", "text").mapInArrow(packed, "at long, packed binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[] for _ in piece_names]
            held = 0
            for key, work_list, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text = z.decompress(p)
                for x in work_list:
                    first, last, pos = x["first"], x["last"], x["pos"]
                    if not x["hot"]:
                        parts = [(x["bucket"], 0, first, last)]
                    else:
                        parts = []
                        for c in range((pos - last) // CELL, (pos - first) // CELL + 1):
                            core = text[pos - c * CELL:pos - c * CELL - CELL + 1 + length]
                            bucket = _digest(core + x["bucket"].to_bytes(8, "little", signed=True) + c.to_bytes(2, "little"))
                            parts.append((bucket, 1, max(first, pos - c * CELL - CELL + 1), min(last, pos - c * CELL)))
                    for bucket, level, lo, hi in parts:
                        for c, v in zip(out, (bucket, level, key, pos, lo, hi, x["open"], text[lo:hi + length]), strict=True):
                            c.append(v)
                        held += hi - lo + length
                if held > 4_000_000:
                    yield _pieces(out)
                    out, held = [[] for _ in piece_names], 0
            if held:
                yield _pieces(out)

    pieces = written(work.join(texts, "at").select("at", "work", "packed").mapInArrow(cut, piece_schema), "suffix-pieces")
    large = written(pieces.where("level = 1").groupBy("bucket").agg(F.count("*").alias("size"))
                    .where(F.col("size") > hot).select("bucket"), "suffix-large")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, ["bucket"]):
            if t.num_rows < 2:
                continue
            c = {n: t.column(n).to_pylist() for n in t.column_names}
            rel = [p - f for p, f in zip(c["pos"], c["first"], strict=True)]
            again = _repeated(c["piece"], c["first"], c["last"], rel, length)
            rows = [(c["at"][i], *r) for i, a in enumerate(again) if c["open"][i] for r in _runs(a, c["first"][i])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows, strict=True)], names=["at", "first", "last"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                h = identifiers(np.frombuffer(c["piece"][i], dtype=np.uint8), length)
                n, first = len(h), c["first"][i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c["bucket"][i]] * n, pa.int64()), pa.array(c["pos"][i] - first - np.arange(n)), pa.array(h.astype(np.int64)),
                     pa.array([c["at"][i]] * n, pa.int64()), pa.array(first + np.arange(n)), pa.array([c["open"][i]] * n, pa.bool_())],
                    names=["bucket", "rel", "name", "at", "first", "open"])

    small = pieces.join(large, "bucket", "left_anti")
    compared = (small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare, "at long, first long, last long"))
    single = written(pieces.join(large, "bucket", "left_semi").mapInArrow(
        windows, "bucket long, rel long, name long, at long, first long, open boolean"), "suffix-windows")
    same = ["bucket", "rel", "name"]
    counted = written(single.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1").select(*same), "suffix-names")
    alone = single.where("open").join(counted, same, "left_semi").select("at", "first", F.col("first").alias("last"))
    hits = (settled.union(compared).union(alone).distinct().groupBy("at").agg(F.collect_list(F.struct("first", "last")).alias("hits")))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for p, hit in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = z.decompress(p) if p is not None else b""
                runs = removed_runs(len(text), [(x["first"], x["last"]) for x in hit or []], length)
                kept, at = sha256(), 0
                for a, b in runs:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                for c, v in zip(out, (len(text), sum(b - a for a, b in runs), len(runs), kept.hexdigest(),
                                      [{"start": a, "end": b} for a, b in runs]), strict=True):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    whole = src.mapInArrow(packed, f"at long, doc_id {kind}, packed binary")
    return (whole.join(written(hits, "suffix-hits"), "at", "left").select("doc_id", "packed", "hits")
            .mapInArrow(finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"))


piece_names = ["bucket", "level", "at", "pos", "first", "last", "open", "piece"]
piece_schema = "bucket long, level int, at long, pos long, first long, last long, open boolean, piece binary"


def _pieces(out: list[list]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=piece_names)


def _batch(names: list[str], cols: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols], names=names)
