"""Secret scans with character Markov models (op10); DataFrame functions only.

Base spans come from three fixed patterns.  On top, every token of MIN_LENGTH or more characters
that no base span touches is scored by two character Markov models, one of random strings and one
of ordinary identifiers: the mean log-likelihood ratio of its character pairs decides, of the whole
token or, at twice the threshold, of its best MIN_LENGTH characters, so a key in a path counts.  Both models are
counted from labelled samples and smoothed.

Positions are code points, end exclusive; each span is a whole match.  Defined results: null text
counts as empty (no span); without samples both models are uniform and add nothing; repeated rows
are scanned alike.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import free_name

# The base patterns of the contract.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a shorter run fails from any start within it, as "+ then 20 or more" does
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
SIZE = len(ALPHABET) + 1  # 0: any other character
MIN_LENGTH = 20
TOKEN = r"[A-Za-z0-9+/=_-]{%d,}" % MIN_LENGTH
THRESHOLD = 0.25  # mean log-likelihood ratio per character pair, in nats
MIXED = 0.05  # share of the uniform distribution in the models
REDACTED = "[SECRET]"
_CHUNK = 256


def _let(value: Column, body) -> Column:
    """Bind a value once: a lambda would evaluate the expression again for every element."""
    return F.transform(F.array(value), body)[0]


def _total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0), lambda s, v: s + v)


def _running(arr: Column) -> Column:
    """Inclusive running sums of an int array in two levels, so long arrays stay cheap."""
    def per_chunk(chunks: Column) -> Column:
        def shifted(totals: Column) -> Column:
            starts = F.transform(totals, lambda v, k: _total(F.slice(totals, F.lit(1), k)))
            return _let(starts, lambda s: F.flatten(F.zip_with(chunks, s, lambda c, o: F.transform(
                c, lambda v, i: o + _total(F.slice(c, F.lit(1), i + 1))))))

        return _let(F.transform(chunks, _total), shifted)

    chunked = F.transform(F.sequence(F.lit(0), F.floor((F.size(arr) - 1) / _CHUNK).cast("int")),
                          lambda c: F.slice(arr, c * _CHUNK + 1, F.lit(_CHUNK)))
    return F.when(F.size(arr) == 0, arr).otherwise(_let(chunked, per_chunk))


_SPANS = "array<struct<start:int,end:int,kind:int,text:string>>"


def match_spans(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost non-overlapping matches as array<struct<start, end, kind, text>>."""
    def place(found: Column) -> Column:
        lengths = F.transform(found, lambda m: F.length(m))
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda s: F.length(s))
        steps = F.zip_with(gaps, lengths, lambda g, n: g + n)
        return _let(steps, lambda s: _let(_running(s), lambda ends: F.zip_with(ends, found, lambda e, m: F.struct(
            (e - F.length(m)).alias("start"), e.alias("end"), F.lit(kind).alias("kind"), m.alias("text")))))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(found, lambda m: F.when(F.size(m) > 0, place(m)).otherwise(F.array().cast(_SPANS))).cast(_SPANS)


def base_spans(text: Column) -> Column:
    assign = F.filter(match_spans(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= ASSIGN_VALUE)
    return F.concat(assign, match_spans(text, ACCESS, 1), match_spans(text, HEX, 2))


def _code(ch: Column) -> Column:
    return F.instr(F.lit(ALPHABET), ch)


def _pairs(token: Column) -> Column:
    """Index of every character pair of a token in a SIZE x SIZE table; the token is taken apart once."""
    def joined(codes: Column) -> Column:
        n = F.size(codes) - 1
        return F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: a * SIZE + b)

    return _let(F.transform(F.split(token, ""), _code), joined)


def samples_of(docs: DataFrame) -> DataFrame:
    """Labelled samples (token, label, n) from all documents; n: how often.

    Label 1: what the base patterns find, and the text's digest in four usual spellings.  Label 0:
    the text's tokens of the scanned class, of any length, outside the base patterns; what identifiers make of
    their words, in constant, snake, kebab and camel case and in paths; numbers and rules.
    """
    some = docs.where("text is not null").select("text")
    digest = F.sha2(F.col("text"), 256)
    spelled = F.array(digest, F.base64(F.unhex(digest)), F.base64(F.unhex(F.concat(F.md5("text"), digest))),
                      F.translate(F.upper(F.base64(F.unhex(F.sha2(F.md5("text"), 512)))), "+/=", ""))
    values = F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_VALUE)
    found = F.concat(values, *[F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (ACCESS, HEX)])
    rest = F.regexp_replace("text", F.lit("|".join((ASSIGN, ACCESS, HEX))), F.lit(" "))
    number = F.conv(F.substring(digest, 1, 15), 16, 10)
    numbers = F.array(F.concat(number, number), *[F.regexp_replace(number, r"(\d\d)", "$1" + c) for c in "-/_"], *[F.lit(c * MIN_LENGTH) for c in "/=_-+"])
    ordinary = F.concat(F.regexp_extract_all(rest, F.lit(TOKEN.replace(str(MIN_LENGTH), "2")), F.lit(0)), numbers)
    label = lambda arr, k: F.transform(arr, lambda t: F.struct(t.alias("token"), F.lit(k).alias("label")))
    counted = (some.select(F.explode(F.concat(label(F.concat(spelled, found), 1), label(ordinary, 0))).alias("x"))
               .groupBy("x.token", "x.label").agg(F.count("*").alias("n")))
    words = F.regexp_extract_all("token", F.lit(r"[A-Za-z]{2,}"), F.lit(0))  # a separator before and after each, as within an identifier
    spelt = F.flatten(F.transform(words, lambda w: F.array(*[F.concat(F.lit(c), case(w), F.lit(c)) for case, c in (
        (F.upper, "_"), (F.lower, "_"), (F.lower, "-"), (lambda x: x, "/"),
        (lambda x: F.concat(F.initcap(x), F.initcap(x)), ""))])))  # camel case: one capital follows a word's end
    return counted.select(F.explode(F.when(F.col("label") == 1, F.array("token")).otherwise(F.concat(F.array("token"), spelt))).alias("token"), "label", "n")


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio (random against ordinary) of every character pair.

    A pair's probability after its first character is MIXED with the uniform one, so that what a pair
    that never occurs can weigh does not grow with the corpus.
    ``samples``: (token, label, n).  The counts that come back number 2 * SIZE**2 at most.
    """
    got = (samples.where("length(token) > 1").select("label", "n", F.explode(_pairs(F.col("token"))).alias("pair"))
           .groupBy("label", "pair").agg(F.sum("n").alias("count")).collect())
    counts = {(r["label"], r["pair"]): r["count"] for r in got}
    table = []
    for first in range(SIZE):
        sums = [sum(counts.get((k, first * SIZE + c), 0) for c in range(SIZE)) for k in (0, 1)]
        for c in range(SIZE):
            p0, p1 = (MIXED / SIZE + (1 - MIXED) * (counts.get((k, first * SIZE + c), 0) / sums[k] if sums[k] else 1 / SIZE) for k in (0, 1))
            table.append(math.log(p1 / p0))
    return table


def markov_spans(text: Column, base: Column, model: list[float], threshold: float = THRESHOLD) -> Column:
    """Tokens that no base span touches and whose log-likelihood ratio, as a mean of the whole or half
    the mean of the best MIN_LENGTH characters, reaches the threshold."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")

    def both(a: Column, b: Column, apart: int) -> Column:
        """Sums of every element of ``a`` and that of ``b`` so many places further on."""
        n = F.size(b) - apart
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(apart + 1), n), lambda x, y: x + y)

    def best(r: Column) -> Column:
        # sums over MIN_LENGTH - 1 = 19 pairs, from those over 1, 2, 4, 8 and 16
        windows = _let(both(r, r, 1), lambda two: _let(both(two, two, 2), lambda four: _let(both(four, four, 4), lambda eight: both(
            both(eight, eight, 8), both(two, r, 2), 16))))
        return F.greatest(F.aggregate(r, F.lit(0.0), lambda s, x: s + x) / F.size(r),
                          F.array_max(windows) / (2 * (MIN_LENGTH - 1)))  # the best of many parts: twice the threshold

    def ratio(token: Column) -> Column:
        return _let(F.transform(_pairs(token), lambda i: F.get(table, i)), best)

    tokens = match_spans(text, TOKEN, 3)
    return F.filter(tokens, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
                    & (ratio(t["text"]) >= threshold))


def _ordered(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def scan(docs: DataFrame, model: list[float], threshold: float = THRESHOLD, name: str = "secret_spans") -> DataFrame:
    """``docs`` with column ``name`` appended: array<struct<start, kind, end>> in order, kind an index of KINDS."""
    def per_text(text: Column) -> Column:
        return _let(base_spans(text), lambda base: _ordered(F.concat(base, markov_spans(text, base, model, threshold))))

    return docs.withColumn(name, _let(F.coalesce(F.col("text"), F.lit("")), per_text))


def report(docs: DataFrame, model: list[float]) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov) of every document."""
    spans = F.col("secret_spans")

    def count(k: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")

    return scan(docs.select("doc_id", "text"), model).select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_joined(F.filter(spans, lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _joined(spans).alias("spans"), count(3).alias("n_markov"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every maximal run of spans replaced by REDACTED; null stays null."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], gap, F.lit(REDACTED))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def redacted(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span in ``text`` replaced; ``n_chars``, where there is one, follows the new text."""
    spans = free_name(docs, "secret_spans")
    out = scan(docs, model, threshold, spans).withColumn("text", redact(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        fits = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, fits).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
