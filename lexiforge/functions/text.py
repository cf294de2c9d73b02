"""Text primitives: code points, UTF-8 bytes, whitespace words, bracketed symbol strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split() treats as whitespace, as a Java regex
# class.  Java's \s covers only [ \t\n\x0B\f\r]; the rest are listed explicitly.
WHITESPACE_RUN = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"

# Private-use code points that delimit one BPE symbol inside a single string.
SYM_OPEN = "\ue000"
SYM_CLOSE = "\ue001"
END_OF_WORD = "</w>"
UNK = "<unk>"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text) -> Column:
    """Whitespace split with Python ``str.split()`` semantics: no empty words."""
    return F.filter(F.split(col_(text), WHITESPACE_RUN), lambda w: w != F.lit(""))


def chars(text, lowercase: bool = False) -> Column:
    """Code points of a string (``list(text)``); empty string -> empty array."""
    t = col_(text)
    if lowercase:
        t = F.lower(t)
    return F.filter(F.split(t, ""), lambda c: c != F.lit(""))


def utf8_bytes(text, lowercase: bool = False) -> Column:
    """UTF-8 byte values 0..255 of a string (``list(text.encode())``)."""
    t = col_(text)
    if lowercase:
        t = F.lower(t)
    # each byte is one Latin-1 character, and that character's code point is the byte
    return F.when(t == F.lit(""), F.array().cast("array<int>")).otherwise(
        F.transform(F.split(F.decode(F.encode(t, "UTF-8"), "ISO-8859-1"), ""), F.ascii))


def bytes_to_text(arr, strict: bool = True) -> Column:
    """Decode an array of byte values as UTF-8.  strict: invalid input raises; else null."""
    def text(a):
        in_range = F.forall(a, lambda b: (b >= 0) & (b <= 255))
        raw = F.encode(F.array_join(F.transform(a, F.char), ""), "ISO-8859-1").cast("string")
        if strict:
            return F.when(in_range, F.validate_utf8(raw)).otherwise(F.raise_error(F.lit("byte value out of range")))
        return F.when(in_range, F.try_validate_utf8(raw))

    return let(col_(arr), text)


def bracket(word, with_end: bool = True) -> Column:
    """``word`` as a bracketed symbol string: one symbol per code point, plus ``</w>``."""
    w = F.regexp_replace(col_(word), "(?s)(.)", SYM_OPEN + "$1" + SYM_CLOSE)
    if with_end:
        w = F.concat(w, F.lit(SYM_OPEN + END_OF_WORD + SYM_CLOSE))
    return w


def symbols(seq) -> Column:
    """Symbols of a bracketed string, in order: strip the outer delimiters and split on
    the close-open boundary (a literal pattern, cheaper than an extracting regex)."""
    def body(s):
        inner = s.substr(F.lit(2), F.length(s) - 2)
        return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(
            F.split(inner, SYM_CLOSE + SYM_OPEN))

    return let(col_(seq), body)


def adjacent_pairs(syms) -> Column:
    """Overlapping adjacent pairs ``struct(l, r)`` of a symbol array (empty if size < 2).

    Built with ``zip_with`` over two slices, so the symbol array is evaluated once per
    row (a lambda that indexed into the array expression would re-evaluate it per element).
    """
    def pairs(s):
        n = F.size(s)
        return F.when(n > 1, F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1),
                                       lambda x, y: F.struct(x.alias("l"), y.alias("r")))
                      ).otherwise(F.array().cast("array<struct<l:string,r:string>>"))

    return let(col_(syms), pairs)


_PAIR_RE = SYM_OPEN + "([^" + SYM_CLOSE + "]*)" + SYM_CLOSE + "(?=" + SYM_OPEN + "([^" + SYM_CLOSE + "]*)" + SYM_CLOSE + ")"


def seq_pairs(seq) -> Column:
    """Overlapping adjacent symbol pairs ``struct(l, r)`` of a bracketed string.

    A regex whose right symbol sits in a lookahead yields every left symbol and its right
    neighbour in one pass; the two arrays are zipped.  No lambda is involved, so the
    expression stays in generated code.
    """
    s = col_(seq)
    return F.arrays_zip(F.regexp_extract_all(s, F.lit(_PAIR_RE), 1).alias("l"),
                        F.regexp_extract_all(s, F.lit(_PAIR_RE), 2).alias("r"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and bind it for ``body`` (a one-element ``transform``)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sym(s: str) -> str:
    return SYM_OPEN + s + SYM_CLOSE
