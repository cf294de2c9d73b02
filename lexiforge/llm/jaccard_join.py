"""N-gram Jaccard join by multiple-global-order prefix filtering (op7).

A document is the set of its distinct ``k``-word shingles.  Two sets link when
``den * |A and B| >= num * |A or B|``, which bounds the shingles in which they differ.

* Part orders: hashing deals the shingles into one part more than that bound; the i-th order
  puts the shingles of part i first.  As each differing shingle spoils one part, linked sets have
  the same head, the whole part, under at least one of these orders.  Heads are the only rows that are
  shuffled: a head whose least and greatest set fingerprints differ ties its sets into one
  candidate group.  Copies have one fingerprint and meet in the map-side aggregation.  The bound follows
  the set's size, so heads are made by size band; linked sets lie in one band or in neighbours.
* Rare-first order and two hash orders: linked sets share one of the first
  ``n - ceil(num * n / den) + 1`` shingles under any order.  Groups of more than LARGE sets, as short texts with
  one common line form, are split by it: with shingles ranked by their frequency (from a sketch) in the
  group, only sets that share a prefix shingle stay together.  Within a group a pair must share one under
  all three orders before it is verified.
* Verification counts shared shingles of two blocks of a group at a time as a product of their
  incidence matrices, shingle range by shingle range.  A group of any size is cut into blocks
  of about BLOCK sets and WEIGHT shingles; a block pair returns a spanning forest of its links, never
  its pairs.  All pairs of a group are held against each other; none is sampled or capped.

Empty parts and those of fewer than LEAST shingles make no head: they would tie strangers.  That all
parts on which a linked pair agrees are of this kind has a probability of about MISS over the hash;
few or small parts are dealt several times over to keep it there.

Defined results: null or wordless texts have the empty set and link with nothing; a text with fewer
than ``k`` words is one shingle; copies always link; ids may repeat (each row is a document).
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import components, free_name, release, written
from lexiforge.llm.words import binary_column, by_key, mix64, shingle_hashes, text_words

BLOCK = 1024
WEIGHT = 1 << 20
LEAST = 3
MISS = 1e-9
LARGE = 128
ROUNDS = 4
SKETCH = 22  # bits: 4 million counters, 16 MB
SKETCH_BLOCK = 1 << 16
_SEEDS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(text_words(text), k))


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(blake2b(shingles.tobytes(), digest_size=16).digest(), dtype=np.int64)
    return int(a), int(b)


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def bands(num: int, den: int) -> np.ndarray:
    """Starts of the size bands: linked sets lie in one band or in two neighbouring ones."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(starts[-1] * den // num + 1)
    return np.array(starts)


def deals(parts: int, size: float, least: int) -> int:
    """How often to deal so that a linked pair agrees on a part of ``least`` shingles but for MISS.

    As many differing shingles as there are parts less one spoil 63 percent of the parts on average; 30
    percent are taken to be left, each with a Poisson number of shingles around 0.9 ``size``.
    """
    mean = 0.9 * size
    short = sum(math.exp(-mean) * mean**j / math.factorial(j) for j in range(least))
    return 1 if parts == 1 else math.ceil(math.log(MISS) / (max(1.0, 0.3 * parts) * math.log(min(max(short, 1e-6), 0.95))))


def heads(s: np.ndarray, num: int, den: int, starts: np.ndarray) -> np.ndarray:
    """Hashes of the heads of a set under all part orders, for pairs whose smaller set is in its size
    band or in the band below."""
    band = int(np.searchsorted(starts, len(s), side="right")) - 1
    out = []
    for b in (band, band - 1):
        if b < 0:
            continue
        parts = (int(starts[b + 1]) - 1) * (den - num) // num + 1
        least = max(1, min(LEAST, int(starts[b]) // parts))
        for salt in mix64(np.arange(1, deals(parts, int(starts[b]) / parts, least) + 1, dtype=np.uint64) + np.uint64(b << 20)):
            h = mix64(s ^ salt)
            part = (h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            part, first, size = np.unique(part[order], return_index=True, return_counts=True)
            head = mix64(np.add.reduceat(mix64(h[order]), first) + mix64(part + salt))
            out.append(head[size >= least])
    return np.concatenate(out)


def _prefixes(sets: list[np.ndarray], freq: tuple[np.ndarray, np.ndarray], num: int, den: int) -> list[list[np.ndarray]]:
    """The prefix of every set under each of the three orders; ``freq``: (shingles, their counts)."""
    known, counts = freq
    out = []
    for s in sets:
        n = prefix_size(len(s), num, den)
        rare = np.argsort(counts[np.searchsorted(known, s)], kind="stable")  # a set is sorted: ties go by hash
        out.append([s[rare[:n]], *[s[np.argsort(mix64(s ^ seed))[:n]] for seed in _SEEDS]])
    return out


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of every set of ``a`` and every set of ``b``."""
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    fa, fb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(fa, fb)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    ka, kb = np.searchsorted(both, fa), np.searchsorted(both, fb)
    ina, inb = (both[np.minimum(x, len(both) - 1)] == y if len(both) else np.zeros(len(y), bool) for x, y in ((ka, fa), (kb, fb)))
    ra, ka, rb, kb = ra[ina], ka[ina], rb[inb], kb[inb]
    oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
    ra, ka, rb, kb = ra[oa], ka[oa], rb[ob], kb[ob]
    step = 4096
    for lo in range(0, len(both), step):
        (a0, a1), (b0, b1) = np.searchsorted(ka, [lo, lo + step]), np.searchsorted(kb, [lo, lo + step])
        width = min(step, len(both) - lo)
        ma, mb = np.zeros((len(a), width), dtype=np.float32), np.zeros((len(b), width), dtype=np.float32)
        ma[ra[a0:a1], ka[a0:a1] - lo] = 1
        mb[rb[b0:b1], kb[b0:b1] - lo] = 1
        out += ma @ mb.T
    return out


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            yield x, y


def linked(a: list[np.ndarray], b: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked sets: filtered by the prefixes under all orders, then verified."""
    freq = np.unique(np.concatenate([*a, *b]), return_counts=True)  # rare first among the sets at hand
    pa_, pb = _prefixes(a, freq, num, den), _prefixes(b, freq, num, den)
    keep = np.ones((len(a), len(b)), dtype=bool)
    for order in range(3):
        keep &= _shared([p[order] for p in pa_], [p[order] for p in pb]) > 0
        if not keep.any():
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    rows, cols = keep.any(axis=1), keep.any(axis=0)
    ia, ib = np.flatnonzero(rows), np.flatnonzero(cols)
    both = _shared([a[i] for i in ia], [b[i] for i in ib]).astype(np.int64)
    sizes = np.array([len(a[i]) for i in ia])[:, None] + np.array([len(b[i]) for i in ib])[None, :]
    x, y = np.nonzero((den * both >= num * (sizes - both)) & keep[np.ix_(ia, ib)])
    return ia[x], ib[y]


def _counter(grp: int, s: np.ndarray) -> np.ndarray:
    """The counter of every shingle of a set in its group's share of the sketch."""
    return (mix64(s ^ mix64(np.array([grp], dtype=np.int64).view(np.uint64))) >> np.uint64(64 - SKETCH)).astype(np.int64)


def _split(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(hi, grp): large candidate groups split by prefixes under one order of rising counts.

    Any order that all sets share makes the filter exact; rare shingles first makes it sharp.  So counts
    from a sketch of fixed size will do: one array of 2^SKETCH counters is summed over the tasks and sent to all.
    A counter of one belongs to a shingle of one set, which ties nothing.
    """
    starts = bands(num, den)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for grp, hi, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                yield grp, hi, shingle_set(z.decompress(p), k)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH, dtype=np.int32)
        for grp, _, s in sets_of(batches):
            at, n = np.unique(_counter(grp, s), return_counts=True)
            total[at] += n.astype(np.int32)
        yield from blobs(enumerate(total.reshape(-1, SKETCH_BLOCK)))

    def blobs(parts: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for block, counts in parts:
            if counts.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=["block", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sum of the tasks' counters, block by block; one block is held."""
        now, total = None, None
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != now:
                    if now is not None:
                        yield from blobs([(now, total)])
                    now, total = block, np.zeros(SKETCH_BLOCK, dtype=np.int32)
                part = np.frombuffer(zlib.decompress(counts), dtype=np.int32)
                total = np.minimum(total.astype(np.int64) + part, 2**31 - 1).astype(np.int32)
        if now is not None:
            yield from blobs([(now, total)])

    source = texts.select("grp", "hi", "packed")
    schema = "block int, counts binary"  # as many rows a task as the sketch has blocks, whatever it counts
    sketch = source.mapInArrow(counted, schema).repartition("block").sortWithinPartitions("block").mapInArrow(added, schema).toArrow()
    often = np.zeros((1 << SKETCH) // SKETCH_BLOCK * SKETCH_BLOCK, dtype=np.int32).reshape(-1, SKETCH_BLOCK)
    for block, counts in zip(*(c.to_pylist() for c in sketch.columns), strict=True):
        often[block] = np.frombuffer(zlib.decompress(counts), dtype=np.int32)
    often = often.reshape(-1)
    sent = texts.sparkSession.sparkContext.broadcast(often)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[], [], [], []]
        held = 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)],
                                               names=["grp", "hi", "band", "shingle"])
            for c in out:
                c.clear()
            return batch

        for grp, hi, s in sets_of(batches):
            n = len(s)
            count = sent.value[_counter(grp, s)]
            order = np.lexsort((s, count))
            s, count = s[order], count[order]
            band = int(np.searchsorted(starts, n, side="right"))
            for b, size in ((band, prefix_size(n, num, den)), (band + 1, n - -(-2 * num * n // (num + den)) + 1)):
                shown = s[:size][count[:size] > 1].astype(np.int64)
                for c, x in zip(out, (grp, hi, b, None), strict=True):
                    c.append(shown if x is None else np.full(len(shown), x, dtype=np.int64))
                held += len(shown)
            if held > 100_000:
                yield flush()
                held = 0
        if out[0]:
            yield flush()

    keys = ["grp", "band", "shingle"]
    shown = written(source.mapInArrow(prefixes, "grp long, hi long, band int, shingle long"), "jaccard-prefixes")
    tied = written(shown.groupBy(*keys).agg(F.min("hi").alias("least"), F.max("hi").alias("most")).where("least <> most").drop("most"), "jaccard-tied")
    ties = written(shown.join(tied, keys).where("hi <> least").select(F.col("hi").alias("a"), F.col("least").alias("b")).distinct(), "jaccard-ties")
    release(shown, tied)
    out = written(components(ties).select(F.col("node").alias("hi"), F.col("root").alias("grp")), "jaccard-split")
    release(ties)
    return out


def join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Links of ``docs`` (doc_id, text).

    Returns (rows, links): rows (doc_id, n_shingles, hi, lo) with the set's 128-bit fingerprint (null
    for the empty set), one per input row, and links (a, b) between fingerprints "hi:lo" that
    connect exactly the sets that are connected by links.
    """
    src = docs.select("doc_id", F.xxhash64("doc_id").alias("at"), "text")
    kind = src.schema["doc_id"].dataType.simpleString()
    starts = bands(num, den)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, hi, lo, keys = [], [], [], []
                for text in binary_column(part, "text"):
                    s = shingle_set(text, k)
                    h = fingerprint(s) if len(s) else (None, None)
                    n.append(len(s))
                    hi.append(h[0])
                    lo.append(h[1])
                    keys.append(heads(s, num, den, starts).astype(np.int64) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "at", "n_shingles", "hi", "lo", "heads"])

    profiles = written(src.mapInArrow(profile, f"doc_id {kind}, at long, n_shingles long, hi long, lo long, heads array<long>"), "jaccard-profiles")
    rows = written(profiles.drop("heads"), "jaccard-rows")
    rounds = []
    for r in range(ROUNDS):  # one part of the heads at a time: the shuffle never holds them all
        shown = (profiles.where("hi is not null").select(F.explode("heads").alias("head"), F.col("hi").alias("node"))
                 .where(F.pmod("head", F.lit(ROUNDS)) == r))
        tied = written(shown.groupBy("head").agg(F.min("node").alias("least"), F.max("node").alias("most"))
                       .where("least <> most").drop("most"), "jaccard-tied")  # written: both sides of the join are shuffled, so a hot key can be split
        rounds.append(written(shown.join(tied, "head").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct(), "jaccard-ties"))
        release(tied)
    ties = functools.reduce(DataFrame.union, rounds)
    release(profiles)
    groups = components(ties).select(F.col("node").alias("hi"), F.col("root").alias("grp"))
    sets = rows.where("hi is not null").groupBy("hi", "lo").agg(F.max("n_shingles").alias("n"), F.min("at").alias("at")).join(groups, "hi")
    sets = written(sets, "jaccard-sets")
    sizes = written(sets.groupBy("grp").agg(F.count("*").alias("m")), "jaccard-sizes")
    members = written(sets.join(sizes, "grp").where("m > 1").select("hi", "lo", "at", "n", "grp", (F.col("m") > LARGE).alias("large")), "jaccard-groups")
    release(*rounds, sets, sizes)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            hi, lo, text = [], [], []
            for t in binary_column(batch, "text"):
                s = shingle_set(t, k)
                h = fingerprint(s) if len(s) else (None, None)
                hi.append(h[0])
                lo.append(h[1])
                text.append(z.compress(t) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(text, pa.binary())],
                                             names=["at", "hi", "lo", "packed"])

    # one row per set: the text of its least hashed id (a row repeated under one id is harmless)
    texts = written(src.mapInArrow(packed, "at long, hi long, lo long, packed binary").join(members, ["at", "hi", "lo"]).drop("at"), "jaccard-texts")
    if not members.where("large").isEmpty():
        split = _split(texts.where("large"), k, num, den)
        texts = texts.where("not large").select("hi", "lo", "n", "grp", "packed").union(
            texts.where("large").drop("grp").join(split, "hi").select("hi", "lo", "n", "grp", "packed"))
    weights = texts.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("w") / WEIGHT)).cast("int").alias("blocks")
    texts = texts.join(written(weights.select("grp", blocks), "jaccard-blocks"), "grp")
    mine = F.pmod(F.xxhash64("hi", "lo"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = (texts.withColumn("mine", mine).withColumn("other", other)
              .select("grp", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "hi", "lo", "packed"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for t in by_key(batches, ["grp", "x", "y"]):
            if t.num_rows < 2:
                continue
            x, y, mine = t.column("x")[0].as_py(), t.column("y")[0].as_py(), np.array(t.column("mine"))
            ids = [f"{a}:{b}" for a, b in zip(t.column("hi").to_pylist(), t.column("lo").to_pylist(), strict=True)]
            sets = [shingle_set(z.decompress(p), k) for p in t.column("packed").to_pylist()]
            left, right = np.flatnonzero(mine == x), np.flatnonzero(mine == y)
            if not len(left) or not len(right):
                continue
            i, j = linked([sets[p] for p in left], [sets[p] for p in right], num, den)
            i, j = left[i], right[j]
            real = i != j
            got = list(_forest(i[real], j[real], len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array([ids[p] for p, _ in got], pa.string()), pa.array([ids[q] for _, q in got], pa.string())], names=["a", "b"])

    links = spread.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y").mapInArrow(verify, "a string, b string")
    return rows, links


def classes(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id): the least id that links reach, the row's own included."""
    rows, links = join(docs, k, num, den)
    named = rows.withColumn("node", F.concat_ws(":", "hi", "lo"))
    roots = components(links)
    grouped = written(named.join(roots, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("root", "node")).alias("class")), "jaccard-classes")
    least = written(grouped.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least")), "jaccard-least")
    return grouped.join(least, "class", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each class of linked texts: the row of the least id.  Rows without words stay."""
    hashed = F.xxhash64("doc_id", "text")
    key, row = free_name(docs, "key"), free_name(docs, "row")
    named = docs.select(F.struct("doc_id", hashed.alias("key")).alias("doc_id"), "text")
    kept = written(classes(named, k, num, den).where(F.col("doc_id.key") == F.col("component_id.key"))
                   .select(F.col("doc_id.key").alias(key)).distinct(), "jaccard-kept")
    first = Window.partitionBy(key).orderBy(key)  # rows that agree in id and text are copies, too
    return (docs.withColumn(key, hashed).join(kept, key, "left_semi")
            .withColumn(row, F.row_number().over(first)).where(F.col(row) == 1).select(*docs.columns))
