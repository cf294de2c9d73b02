"""Conversation structure repair: the cheapest edits that make a conversation's roles legal.

The legal role initials are ``(s?(ua)+)?``: nothing, or an optional system message followed by
user/assistant pairs.  The edits of an audit, with their initials and costs:

* ``K`` keep a row: 0; ``R`` give a row the role user or assistant: 2; ``D`` delete a row: 3;
* ``I`` insert an empty user or assistant message anywhere: 2;
* a truncated row that is not deleted: 1 more.  Blank and duplicate rows must be deleted.

**Persistent audit DP.**  A conversation's rows arrive sorted and are read once.  After each row there
is one cheapest audit per role state (nothing yet, after ``s``, after ``u``, after ``a``).  Audits are
paths in a tree of linked nodes, so audits share their prefixes.  Every node knows a rolling hash of its
whole path and ancestors 1, 2, 4, ... nodes up (a node at depth d has those of 2^k that divide d, which
keeps the table linear and a lift logarithmic).  Audits of equal cost are ordered by searching their
longest common prefix over these ancestors: equal hashes are taken as equal prefixes only after the
paths were walked to a common node.  Two audits of one state with equal cost are never prefixes of
one another (the rest would be insertions only, which cost), so the lesser stays the lesser under every
continuation.  A state that costs more than another state's cost plus the most that the other needs to
imitate it is dropped.  Whatever all live audits share is settled: it leaves the tree (`Audits.settle`).

**Scale.**  Damage, faults' raw material and first occurrences are column expressions and one map-side
aggregation; rows are dealt by conversation and sorted there by Spark (which spills).  A task holds the
nodes that are not settled and at most four hash states, never a conversation's rows.  One
conversation is one task's stream: its repaired text has one SHA-256, which is sequential by definition.

Defined results: a null role or text counts as one space (a null text is blank), a null turn sorts
first and takes no part in ``gaps``, a null conv_id is one conversation.  Rows of one turn are ordered by
role and text.  An empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
EMPTY, SYSTEM, USER, ASSISTANT = range(4)  # role states: what the repaired conversation ends with
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # by a reroled or inserted message
NAME = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}
# the most that the first state has to pay to do all that the second can still do: one message inserted
# (2) to get into step, two (4) to end after a system message, a deletion (3) in place of a kept system row
IMITATE = {(EMPTY, SYSTEM): 0, (EMPTY, USER): 2, (EMPTY, ASSISTANT): 0, (SYSTEM, EMPTY): 4, (SYSTEM, USER): 2, (SYSTEM, ASSISTANT): 4,
           (USER, EMPTY): 5, (USER, SYSTEM): 2, (USER, ASSISTANT): 2, (ASSISTANT, EMPTY): 3, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): 2}
SETTLE = 4096  # nodes before what is settled is looked for

REPORT = ("conv_id {key}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
          "audit string, repaired_sha256 string")


class Audits:
    """A tree of edit letters; a node stands for the audit spelled from the root to it."""

    PRIME, BASE = (1 << 61) - 1, 911_382_323

    def __init__(self, hash_of: Callable[[int, str], int] | None = None):
        self.hash_of = hash_of or (lambda h, letter: (h * self.BASE + ord(letter)) % self.PRIME)
        self.settled: list[str] = []
        self._clear()

    def _clear(self) -> None:
        self.letter = [""]
        self.depth, self.hash, self.first = array("q", [0]), array("q", [0]), array("q", [0])
        self.up = array("q")  # of each node from ``first``: the ancestors 1, 2, 4, ... up
        self.limit = SETTLE

    def add(self, parent: int, letter: str) -> int:
        depth = self.depth[parent] + 1
        self.first.append(len(self.up))
        node, k = parent, 0
        self.up.append(node)
        while depth % (2 << k) == 0:
            node = self.up[self.first[node] + k]
            self.up.append(node)
            k += 1
        self.letter.append(letter)
        self.depth.append(depth)
        self.hash.append(self.hash_of(self.hash[parent], letter))
        return len(self.letter) - 1

    def _reach(self, node: int) -> int:
        """The largest k with an ancestor 2^k up."""
        d = self.depth[node]
        return (d & -d).bit_length() - 1

    def lift(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            k = min(self._reach(node), (self.depth[node] - depth).bit_length() - 1)
            node = self.up[self.first[node] + k]
        return node

    def same(self, x: int, y: int) -> bool:
        """Do two nodes of one depth spell the same audit?  Equal hashes are verified."""
        if x == y:
            return True
        if self.hash[x] != self.hash[y]:
            return False
        while x != y:
            if self.letter[x] != self.letter[y]:
                return False
            x, y = self.up[self.first[x]], self.up[self.first[y]]
        return True

    def _fork(self, x: int, y: int) -> tuple[int, int]:
        """Of two different audits of one length, the nodes at their first different letter."""
        while True:
            for k in range(self._reach(x), -1, -1):
                a, b = self.up[self.first[x] + k], self.up[self.first[y] + k]
                if not self.same(a, b):
                    x, y = a, b
                    break
            else:
                return x, y

    def less(self, x: int, y: int) -> bool:
        """Is the audit of ``x`` smaller in ASCII order?"""
        depth = min(self.depth[x], self.depth[y])
        a, b = self.lift(x, depth), self.lift(y, depth)
        if self.same(a, b):
            return self.depth[x] < self.depth[y]
        a, b = self._fork(a, b)
        return self.letter[a] < self.letter[b]

    def spell(self, node: int, above: int = 0) -> str:
        out = []
        while node != above:
            out.append(self.letter[node])
            node = self.up[self.first[node]]
        return "".join(reversed(out))

    def settle(self, nodes: list[int]) -> list[int] | None:
        """Cut off what all these nodes share once the tree is large; returns them in the new tree."""
        if len(self.letter) < self.limit:
            return None
        depth = min(self.depth[n] for n in nodes)
        shared = self.lift(nodes[0], depth)
        for n in nodes[1:]:
            other = self.lift(n, self.depth[shared])
            if other != shared:
                a, _ = self._fork(shared, other)
                shared = self.up[self.first[a]]
        if shared:
            self.settled.append(self.spell(shared))
        kept: dict[int, None] = {}
        for n in nodes:
            while n != shared and n not in kept:
                kept[n] = None
                n = self.up[self.first[n]]
        order = sorted(kept)
        old = [(self.up[self.first[n]], self.letter[n]) for n in order]
        self._clear()
        at = {shared: 0}
        for n, (parent, letter) in zip(order, old, strict=True):
            at[n] = self.add(at[parent], letter)
        self.limit = max(SETTLE, 2 * len(self.letter))
        return [at[n] for n in nodes]


class _Digest:
    """SHA-256 of a repaired conversation; each step is a new value, so states can share one."""

    def __init__(self, sha=None):
        self.sha = sha

    def plus(self, role: str, text: str) -> _Digest:
        sha = hashlib.sha256() if self.sha is None else self.sha.copy()
        sha.update(f"{'' if self.sha is None else chr(10)}{role}:{text}".encode())
        return _Digest(sha)

    def hex(self) -> str:
        return (self.sha or hashlib.sha256()).hexdigest()


class Repair:
    """The DP over one conversation, fed row by row."""

    def __init__(self, hash_of=None):
        self.audits = Audits(hash_of)
        self.live: dict[int, tuple[int, int, _Digest]] = {EMPTY: (0, 0, _Digest())}  # state -> cost, node, digest
        self._insert()

    def _offer(self, to: dict, state: int, cost: int, parent: int, letter: str, digest) -> bool:
        """Put a candidate into ``to`` if it is cheaper, or as cheap and smaller; ``digest`` is made on demand."""
        best = to.get(state)
        if best and best[0] < cost:
            return False
        node = self.audits.add(parent, letter)
        if best and best[0] == cost and not self.audits.less(node, best[1]):
            return False
        to[state] = (cost, node, digest)
        return True

    def _insert(self) -> None:
        todo = sorted(self.live, key=lambda s: self.live[s][0])
        while todo:
            state = todo.pop(0)
            cost, node, digest = self.live[state]
            to = NEXT[state]
            if self._offer(self.live, to, cost + COST[INSERT], node, INSERT, digest):
                self.live[to] = (*self.live[to][:2], digest.plus(NAME[to], ""))
                todo.append(to)
        self.live = {s: v for s, v in self.live.items()
                     if not any(w[0] + IMITATE[t, s] < v[0] for t, w in self.live.items() if t != s)}

    def feed(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        to: dict[int, tuple] = {}
        for state, (cost, node, digest) in self.live.items():
            self._offer(to, state, cost + COST[DELETE], node, DELETE, (digest, None))
            if must_go:
                continue
            kept = KEPT.get((state, role[:1]))
            if kept is not None:
                self._offer(to, kept, cost + COST[KEEP] + truncated, node, KEEP, (digest, role))
            self._offer(to, NEXT[state], cost + COST[REROLE] + truncated, node, REROLE, (digest, NAME[NEXT[state]]))
        self.live = {s: (cost, node, d if r is None else d.plus(r, text)) for s, (cost, node, (d, r)) in to.items()}
        self._insert()
        moved = self.audits.settle([v[1] for v in self.live.values()])
        if moved:
            self.live = {s: (v[0], n, v[2]) for (s, v), n in zip(self.live.items(), moved, strict=True)}

    def end(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the cheapest legal conversation."""
        best = None
        for state in (EMPTY, ASSISTANT):
            got = self.live.get(state)
            if got and (best is None or got[0] < best[0] or (got[0] == best[0] and self.audits.less(got[1], best[1]))):
                best = got
        return best[0], "".join(self.audits.settled) + self.audits.spell(best[1]), best[2].hex()


class _Conversation:
    """Counts and repair of one conversation's rows in order."""

    def __init__(self, conv_id):
        self.conv_id, self.repair = conv_id, Repair()
        self.least = self.most = self.turn = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: tuple | None = None

    def row(self, turn, role: str, text: str, blank: bool, truncated: bool, seen: bool) -> str:
        """Feed one damaged row; returns its fault ('' if none)."""
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.most
            self.most = turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in LEGAL
        self.initial = role[:1]
        seen = seen or self.before == (turn, role, text)  # equal rows of one turn are neighbours
        self.before = (turn, role, text)
        fault = "blank" if blank else "duplicate" if seen else "truncated" if truncated else ""
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        self.repair.feed(role, text, fault in ("blank", "duplicate"), fault == "truncated")
        return fault

    def report(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.end())


def damaged(rows: DataFrame) -> DataFrame:
    """The stated damage by crc32 of ``conv_id:turn``; ``copies`` is 0 for a dropped row (kept so that its
    conversation stays known), 2 for a repeated one."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def undamaged(rows: DataFrame) -> DataFrame:
    """Rows as they are, in the form that `report` and `repaired` take."""
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("copies"))


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows with their faults' material, dealt by conversation and sorted there.

    ``seen``: the same role and text came at an earlier turn.  Only texts that occur at several turns
    matter for it; they are found by a map-side aggregation of digests and joined back.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = rows.select("*", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
                       F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")).alias("digest"))
    repeated = (rows.where("copies > 0 and not blank").groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d"))
                .agg(F.min(F.struct("turn")).alias("first"), F.max(F.struct("turn")).alias("last")).where("first <> last"))
    rows = rows.join(repeated, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    rows = rows.withColumn("seen", F.coalesce(F.struct("turn") > F.col("first"), F.lit(False)))
    return (rows.select("conv_id", "turn", "role", "text", "copies", "blank", "cut", "seen").repartition("conv_id")
            .sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def report(rows: DataFrame) -> DataFrame:
    """One row per conversation of `damaged` or `undamaged` rows: faults, cost, audit and digest."""
    ordered = _in_order(rows)
    key = ordered.schema["conv_id"].dataType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema)
            done.clear()
            return batch

        from pyspark.sql.pandas.types import to_arrow_type

        names = [c.split(" ")[0] for c in REPORT.split(", ")]
        schema = pa.schema([("conv_id", to_arrow_type(key)), *((n, pa.int64()) for n in names[1:7]), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        now, done, size = None, [], 0
        for conv_id, turn, role, text, copies, blank, cut, seen in _rows(batches):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now.report())
                    size += len(done[-1][-2])
                    if len(done) == 4096 or size > 1 << 24:
                        yield flush()
                        size = 0
                now = _Conversation(conv_id)
            for _ in range(copies):
                now.row(turn, role, text, blank, cut, seen)
        if now is not None:
            done.append(now.report())
            yield flush()

    return ordered.mapInArrow(task, REPORT.format(key=key.simpleString()))


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: (conv_id, pos, edit, turn, role, text), pos from 0.

    Deleted rows are absent; an inserted message has a null turn.  A task holds one conversation's rows
    here, so use `report` where single conversations may be huge.
    """
    ordered = _in_order(rows)
    key = ordered.schema["conv_id"].dataType.simpleString()
    turn_type = ordered.schema["turn"].dataType.simpleString()

    def messages(conv: _Conversation, held: list[tuple]) -> Iterator[tuple]:
        source, state, pos = iter(held), EMPTY, 0
        for letter in conv.repair.end()[1]:
            turn, role, text = (None, None, "") if letter == INSERT else next(source)
            if letter == DELETE:
                continue
            state = KEPT[state, role[:1]] if letter == KEEP else NEXT[state]
            yield conv.conv_id, pos, letter, turn, role if letter == KEEP else NAME[state], text
            pos += 1

    def task(frames):
        import pandas as pd

        columns = ["conv_id", "pos", "edit", "turn", "role", "text"]
        now, held = None, []
        source = (r for f in frames for r in f.itertuples(index=False, name=None))
        for conv_id, turn, role, text, copies, blank, cut, seen in source:
            conv_id, turn = (None if pd.isna(x) else x for x in (conv_id, turn))
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    yield pd.DataFrame(messages(now, held), columns=columns)
                now, held = _Conversation(conv_id), []
            for _ in range(copies):
                now.row(turn, role, text, blank, cut, seen)
                held.append((turn, role, text))
        if now is not None:
            yield pd.DataFrame(messages(now, held), columns=columns)

    return ordered.mapInPandas(task, f"conv_id {key}, pos bigint, edit string, turn {turn_type}, role string, text string")
