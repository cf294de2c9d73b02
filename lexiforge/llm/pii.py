"""Personal data: fixed patterns, and more spans that boosted trees select among high-recall candidates.

* **Base spans** are the stated patterns (`base_spans`); they always stay.  Each is found in time linear in
  the text: a pattern is tried only where it can start, and its runs are possessive or anchored at ``@``.
* **Candidates** (`candidates`) propose far more, overlapping each other: anything joined by an at sign or its
  spelled-out forms, every chain of digits with up to two separators between, and its parts.
* **Boosted trees** score a candidate from its format (groups, separators, check digit) and its context
  (neighbouring characters, words before).  They learn from the corpus itself: a candidate that is a base
  span is a positive, one that touches none is a negative; positives are learned once more in the
  spellings that the fixed patterns do not accept (no ``+`` and country code, at sign spelled out).
* **Thresholds** are calibrated for each kind on documents that were not fitted: at most ``max_false`` of
  their negatives score higher, nor more than a tenth of their positives lower.  A kind with fewer than
  ``MIN_CASES`` positives or negatives adds nothing.  Selected candidates that touch a base span are left
  out; of those that touch each other the best stays (ties: the longer, then the earlier).

**Scale.**  Training scans the ``max_docs`` documents (about, if there are more) of least hash; of their
candidates ``per_class`` (by hash of document and place) of every kind and label reach the driver, as a top-k
that is cut before its shuffle.  Both bounds concern the fit only.  Scoring is one scan without a shuffle.

Defined results: a null text is empty; an empty table gives no rows and trains nothing; any doc_id type is
passed through; other columns are ignored, whatever their names.  Equal tables give equal models, as
rows are taken in hash order; equal rows are kept as often as they occur.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import crc_of, unit

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
MAX_DOCS = 100_000  # documents whose candidates may be learned from
PER_CLASS = 2_500  # and candidates of each kind and label in the training sample
ROUNDS, DEPTH, RATE, BINS = 40, 3, 0.3, 32
MAX_FALSE, LEAST_SCORE, MIN_CASES = 0.002, 0.9, 20

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_DIGITS = re.compile("[0-9]+")

_AT = re.compile(r"\x20?(?:@|\((?:at|AT)\)|\[(?:at|AT)\])\x20?")
_RIGHT = re.compile(r"[\w-]++(?:\x20?(?:\.|\((?:dot|DOT)\)|\[(?:dot|DOT)\])\x20?[\w-]++)*+")
_CHAIN = re.compile(r"\+?\(?[0-9]++(?:[\x20().:/-]{1,2}[0-9]++)*+")
_WORDS = (("mail", "contact", "write"), ("phone", "tel", "call", "fax", "mobile"), ("card", "visa", "credit", "account"), ("ip", "host", "server", "address"))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    out = []
    if "@" in text:
        free = 0  # matches of a kind do not overlap
        for m in _DOMAIN.finditer(text):
            start = at = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                free = m.end()
                out.append((start, EMAIL, free))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), IP, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), CARD, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
                    out.append((m.start(), PHONE, m.end()))
    return sorted(out)


def candidates(text: str) -> set[tuple[int, int, int]]:
    """(start, kind, end) of everything that might be personal data; spans overlap."""
    out = set()
    for m in _AT.finditer(text):
        start = m.start()
        while start and (text[start - 1] in _LOCAL or (text[start - 1].isalnum() and not text[start - 1].isascii())):
            start -= 1
        right = _RIGHT.match(text, m.end())
        if start < m.start() and right:
            out.add((start, EMAIL, right.end()))
    if not _DIGIT.search(text):
        return out
    for m in _CHAIN.finditer(text):
        if m.end() - m.start() < 7:
            continue
        spans = {m.span()}
        pieces = [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[^\x20/:]+", m[0])] if len(_DIGITS.findall(m[0])) > 1 else []
        spans.update(pieces)
        spans.update((a[0], b[1]) for a, b in zip(pieces, pieces[1:], strict=False))
        spans.update((a[0], c[1]) for a, c in zip(pieces, pieces[2:], strict=False))
        for start, end in spans:
            if end - start > 40:
                continue  # at most 19 digits with two separators between them and more
            groups = _DIGITS.findall(text[start:end])
            n = sum(map(len, groups))
            while end > start and not "0" <= text[end - 1] <= "9":
                end -= 1
            if 7 <= n <= 15:
                out.add((start, PHONE, end))
            if 12 <= n <= 19:
                out.add((start, CARD, end))
            if len(groups) == 4 and text[start:end].count(".") == 3:
                out.add((start, IP, end))
    return out


def _kind_of(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4


def features(span: str, kind: int, before: str, after: str) -> list[float]:
    """Format and context of one candidate; ``before`` and ``after`` are its neighbouring characters."""
    groups = _DIGITS.findall(span)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    words = before.lower()
    parts = re.split(r"\x20?(?:@|[(\[](?:at|AT)[)\]])\x20?", span)
    labels = re.split(r"\x20?(?:\.|[(\[](?:dot|DOT)[)\]])\x20?", parts[-1])
    return [
        *(float(kind == k) for k in range(len(KINDS))), len(span), len(digits), len(groups), min(sizes), max(sizes), sizes[0], sizes[-1],
        *(span.count(c) for c in " -.()/:"), float(span.startswith("+")), float(kind == CARD and luhn(digits)),
        float(kind == IP and all(len(g) <= 3 and int(g) <= 255 for g in groups)), float(any(len(g) > 1 and g[0] == "0" for g in groups)),
        len(set(digits)), float(digits[:1] or -1), _kind_of(before[-1:]), _kind_of(after[:1]), float(after[:1] in "%$€"),
        sum(c.isalpha() for c in before), *(float(any(w in words for w in ws)) for ws in _WORDS),
        len(parts[0]) if kind == EMAIL else 0, len(labels) if kind == EMAIL else 0, len(labels[-1]) if kind == EMAIL else 0,
        float(kind == EMAIL and labels[-1].isalpha()), float(kind == EMAIL and span.isascii())]


def _respelled(span: str, kind: int) -> str | None:
    """A positive in a spelling that the fixed patterns do not accept."""
    if kind == EMAIL:
        return span.replace("@", " (at) ")
    if kind == PHONE:
        local = re.sub(r"^\+[0-9]+[\x20.-]?", "", span)
        return local if local != span and len(re.findall("[0-9]", local)) >= 7 else None
    return None


def labelled(text: str) -> Iterator[tuple[int, int, int, list[float]]]:
    """(place, kind, label, features) of the text's candidates; one that only touches a base span of its kind has no label."""
    base = base_spans(text)
    exact, cover = set(base), _Cover(base)
    for start, kind, end in sorted(candidates(text) | exact):
        before, after = text[max(0, start - 24):start], text[end:end + 1]
        if (start, kind, end) in exact:
            yield start, kind, 1, features(text[start:end], kind, before, after)
            other = _respelled(text[start:end], kind)
            if other is not None:
                yield start, kind, 1, features(other, kind, before, after)
        elif not cover.touches(start, end, (kind,)):
            yield start, kind, 0, features(text[start:end], kind, before, after)


class _Cover:
    """Base spans of a text, asked whether a span touches one; those of one kind are disjoint."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts = [[s for s, k, _ in spans if k == kind] for kind in range(len(KINDS))]
        self.ends = [[e for _, k, e in spans if k == kind] for kind in range(len(KINDS))]

    def touches(self, start: int, end: int, kinds=range(len(KINDS))) -> bool:
        for k in kinds:
            at = bisect.bisect_left(self.starts[k], end)
            if at and self.ends[k][at - 1] > start:
                return True
        return False


# --- gradient boosting ------------------------------------------------------------------------


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> dict:
    """Trees of ``depth`` splits on the logistic loss, by histograms of binned features (second order)."""
    prior = float(np.clip(y.mean(), 0.01, 0.99))
    model = {"bias": np.log(prior / (1 - prior)), "feature": [], "cut": [], "value": []}
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(cuts, x.T, strict=True)], axis=1)
    raw = np.full(len(x), model["bias"])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        feature, cut = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            first = 2**level - 1
            best = np.zeros(2**level)
            for f in range(x.shape[1]):
                key = (node - first) * BINS + binned[:, f]
                g, h = (np.cumsum(np.bincount(key, weights=v, minlength=BINS * 2**level).reshape(-1, BINS), axis=1) for v in (grad, hess))
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
                gain[:, len(cuts[f]):] = 0
                gain[(h < 1) | (h_all - h < 1)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(len(at)), at]
                for k in np.flatnonzero(top > best + 1e-9):
                    best[k], feature[first + k], cut[first + k] = top[k], f, cuts[f][at[k]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        leaf = node - (2**depth - 1)
        value = -rate * np.bincount(leaf, weights=grad, minlength=2**depth) / (np.bincount(leaf, weights=hess, minlength=2**depth) + 1)
        raw += value[leaf]
        for name, part in (("feature", feature), ("cut", cut), ("value", value)):
            model[name].append(part)
    return model


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    raw, rows = np.full(len(x), model["bias"]), np.arange(len(x))
    for feature, cut, value in zip(model["feature"], model["cut"], model["value"], strict=True):
        node = np.zeros(len(x), dtype=np.int64)
        while node.size and node[0] < len(feature):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        raw += value[node - len(feature)]
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(kind: np.ndarray, label: np.ndarray, held: np.ndarray, x: np.ndarray, max_false: float = MAX_FALSE) -> dict | None:
    """Trees from the rows not held out, one threshold a kind from the others."""
    use = ~held
    if not use.any() or not 0 < label[use].sum() < use.sum():
        return None
    model = boost(x[use], label[use].astype(float))
    p = probability(model, x[held])
    model["threshold"] = np.full(len(KINDS), np.inf)
    for k in range(len(KINDS)):
        good, bad = (np.sort(p[(kind[held] == k) & (label[held] == v)]) for v in (1, 0))
        if min(len(good), len(bad)) >= MIN_CASES:
            over = bad[len(bad) - 1 - int(max_false * len(bad))]  # at most this share of the negatives is above
            low = good[len(good) // 10]
            model["threshold"][k] = max(LEAST_SCORE, low, np.nextafter(over, 1))
    return model


# --- on tables --------------------------------------------------------------------------------


def train(docs: DataFrame, per_class: int = PER_CLASS, max_docs: int = MAX_DOCS, max_false: float = MAX_FALSE) -> dict | None:
    """Model of the candidates of ``docs`` (doc_id, text); None if there is nothing to learn from."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(labelled(text.as_py() or ""))
                if rows:
                    place, kind, label, x = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc] * len(rows), pa.int64()), pa.array(place, pa.int64()), pa.array(kind, pa.int32()), pa.array(label, pa.int32()),
                         pa.array(x, pa.list_(pa.float64()))], names=["doc", "place", "kind", "label", "x"])

    some = docs.where(unit(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed=13) < max_docs / max(1, docs.count()))
    found = some.select(crc_of("doc_id").alias("doc"), "text").mapInArrow(task, "doc bigint, place bigint, kind int, label int, x array<double>")
    order = Window.partitionBy("kind", "label").orderBy(F.xxhash64("doc", "place"), "x")
    rows = (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_class).drop("rank")
            .toArrow().sort_by([(c, "ascending") for c in ("kind", "label", "doc", "place")]))
    if not rows.num_rows:
        return None
    doc, kind, label = (rows.column(c).to_numpy() for c in ("doc", "kind", "label"))
    return fit(kind, label, doc % 3 == 0, np.array(rows.column("x").to_pylist()), max_false)


def select(text: str, base: list[tuple[int, int, int]], scored: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """Scored candidates above their threshold that touch no base span nor a better one."""
    taken: list[tuple[int, int]] = []  # disjoint, sorted
    for s, _, e in base:
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    out = []
    for _, start, kind, end in sorted(scored, key=lambda c: (-c[0], c[1] - c[3], c[1])):
        at = bisect.bisect_left(taken, (end,))
        if at and taken[at - 1][1] > start:
            continue
        taken.insert(at, (start, end))
        out.append((start, kind, end))
    return out


def _spans(texts: list[str], model: dict | None) -> Iterator[tuple[list, list]]:
    """(base spans, all spans) of every text; the candidates of a batch are scored at once."""
    bases = [base_spans(t) for t in texts]
    rows, x = [], []
    for i, text in enumerate(texts if model is not None else []):
        cover = _Cover(bases[i])
        for start, kind, end in sorted(candidates(text)):
            if model["threshold"][kind] < np.inf and not cover.touches(start, end):
                rows.append((i, start, kind, end))
                x.append(features(text[start:end], kind, text[max(0, start - 24):start], text[end:end + 1]))
    scored: dict[int, list] = {}
    if rows:
        for (i, start, kind, end), p in zip(rows, probability(model, np.array(x)).tolist(), strict=True):
            if p >= model["threshold"][kind]:
                scored.setdefault(i, []).append((p, start, kind, end))
    for i, text in enumerate(texts):
        yield bases[i], sorted(bases[i] + select(text, bases[i], scored.get(i, [])))


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def report(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_spans([t or "" for t in batch.column(1).to_pylist()], sent.value))
            counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in found], pa.int64()) for kind in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array([hashlib.sha256(_written(base).encode()).hexdigest() for base, _ in found], pa.string()),
                 pa.array([_written(spans) for _, spans in found], pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    src = docs.select("doc_id", "text")
    return src.mapInArrow(task, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} bigint" for k in KINDS)
                          + ", base_sha256 string, spans string")


def redacted(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` with every span of a text replaced by its kind in brackets; other columns and null texts stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def clean(texts):
        import pandas as pd

        values = [None if t is None else t for t in texts]
        out = []
        for text, (_, spans) in zip(values, _spans([t or "" for t in values], sent.value), strict=True):
            parts, at = [], 0
            for start, kind, end in spans:
                if start >= at:
                    parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
                at = max(at, end)
            out.append(None if text is None else "".join(parts) + text[at:])
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", clean("text"))
