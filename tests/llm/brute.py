"""Plain single-process versions of the operators, for small inputs."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def removed(texts: dict, length: int) -> dict:
    """id -> (bytes, removed bytes, runs, sha256 of the rest)."""
    raw = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(b[j:j + length] for b in raw.values() for j in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if seen[b[j:j + length]] > 1:
                gone[j:j + length] = b"\1" * length
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def shingles(text, k: int) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()


def classes(texts: dict, k: int, num: int, den: int) -> dict:
    """id -> (size of the set, least id reachable by links)."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    having = defaultdict(list)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in sorted(sets.items()):
        for j, n in Counter(j for g in s for j in having[g]).items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            having[g].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def base_spans(text: str) -> list:
    """(start, kind, end) of the fixed secret patterns."""
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    assign = re.compile(r"(?:%s|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)" % key)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def targets(sizes: dict, weights=(3, 1, 2), share=1.5, cap=2.0) -> dict:
    """Source -> target, resharing the excess until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    fixed: set = set()
    while True:
        rest = share * sum(sizes.values()) - sum(cap * sizes[s] for s in fixed)
        total = sum(w[s] for s in names if s not in fixed)
        out = {s: cap * sizes[s] if s in fixed else rest * w[s] / total for s in names}
        over = {s for s in names if s not in fixed and out[s] > cap * sizes[s]}
        if not over:
            return out
        fixed |= over


def tokens(text) -> list:
    """Words without case and ASCII punctuation."""
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())


def contaminated(text, items: list, need: int = 12, identity: float = 0.8, least: int = 5) -> bool:
    """Whether any stretch of ``need`` words (or a shorter item whole) agrees with an item on a diagonal."""
    words = tokens(text)
    for item in items:
        if len(item) < least:
            continue
        n = min(need, len(item))
        for off in range(-len(item) + n, len(words) - n + 1):
            lo, hi = max(off, 0), min(off + len(item), len(words))
            same = [words[p] == item[p - off] for p in range(lo, hi)]
            if any(sum(same[q:q + n]) >= math.ceil(identity * n) for q in range(len(same) - n + 1)):
                return True
    return False


def repaired(rows: list) -> tuple:
    """(cost, audit, repaired messages) of (role, text, fault) rows: every cheapest audit is spelled out."""
    steps = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    name = {"u": "user", "a": "assistant"}

    def put(to, state, cost, audits):
        if state not in to or cost < to[state][0]:
            to[state] = (cost, set(audits))
        elif cost == to[state][0]:
            to[state][1].update(audits)

    def insertions(live):
        for _ in range(4):
            for state, (cost, audits) in list(live.items()):
                for r in steps[state].values():
                    if r in name:
                        put(live, r, cost + 2, {(a + "I", (*out, (name[r], ""))) for a, out in audits})
        return live

    live = insertions({"": (0, {("", ())})})
    for role, text, fault in rows:
        to: dict = {}
        extra = fault == "truncated"
        for state, (cost, audits) in live.items():
            put(to, state, cost + 3, {(a + "D", out) for a, out in audits})
            if fault in ("blank", "duplicate"):
                continue
            for r in steps[state].values():
                if role[:1] == r:
                    put(to, r, cost + extra, {(a + "K", (*out, (role, text))) for a, out in audits})
                if r in name:
                    put(to, r, cost + 2 + extra, {(a + "R", (*out, (name[r], text))) for a, out in audits})
        live = insertions(to)
    cost = min(live[s][0] for s in ("", "a") if s in live)
    audit, out = min(x for s in ("", "a") if s in live and live[s][0] == cost for x in live[s][1])
    return cost, audit, out


def conversation(rows: list) -> tuple:
    """Report of damaged (turn, role, text) rows in order, without the conv_id."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        words = WORD.findall(text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1][-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, out = repaired([(r, t, f) for (_, r, t), f in zip(rows, faults, strict=True)])
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
            hashlib.sha256(text.encode()).hexdigest())


def damaged(rows: list) -> dict:
    """conv_id -> damaged (turn, role, text) rows in order, from (conv_id, turn, role, text)."""
    out: dict = {}
    for conv_id, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        out.setdefault(conv_id, []).extend([] if kind == 0 else [row, row] if kind == 3 else [row])
    for rows_ in out.values():
        rows_.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def spelling_words(rows: list, damage: int = 97) -> Counter:
    """All (damaged) words of (doc_id, text) rows with their numbers."""
    out: Counter = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            out[w[:h % len(w)] + w[h % len(w) + 1:] if h % damage == 0 else w] += 1
    return out


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(words: dict) -> dict:
    """word -> (form, root, n, n_near, form_n), every two words held against each other."""
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), form[w] and words[form[w]])
    return out


def pii_spans(text: str) -> list:
    """(start, kind, end) of the fixed personal-data patterns, written down as they are stated."""
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    for kind, pattern, lo, hi in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if lo <= len(d) <= hi and (kind == 3 or luhn(d)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)
