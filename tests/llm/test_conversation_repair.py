"""Conversation repair against a version that spells out every cheapest audit, and its edge cases."""

import hashlib
import random

import pytest

import brute
from lexiforge.llm import conversation_repair as cr
from lexiforge.llm.queries import REGISTRY

SCHEMA = "conv_id long, turn long, role string, text string"


def _feed(repair, rows):
    for role, text, fault in rows:
        repair.feed(role, text, fault in ("blank", "duplicate"), fault == "truncated")
    return repair


def _random_rows(r, n):
    return [(r.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), f"t{k}.", r.choice(["", "", "", "blank", "truncated", "duplicate"]))
            for k in range(n)]


@pytest.mark.parametrize("hash_of", [None, lambda h, letter: 0])  # the second: every hash collides
def test_audits_against_all_cheapest(hash_of):
    r = random.Random(5)
    for _ in range(400):
        rows = _random_rows(r, r.randint(0, 9))
        cost, audit, out = brute.repaired(rows)
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
        assert _feed(cr.Repair(hash_of), rows).end() == (cost, audit, digest)


def test_settled_prefixes_change_nothing(monkeypatch):
    r = random.Random(6)
    rows = _random_rows(r, 3000)
    want = _feed(cr.Repair(), rows).end()
    monkeypatch.setattr(cr, "SETTLE", 16)
    small = _feed(cr.Repair(), rows)
    assert small.end() == want and len(small.audits.letter) < 2000 and small.audits.settled


def test_forks_at_any_depth():
    t = cr.Audits()
    r, nodes = random.Random(7), [(0, "")]
    for _ in range(600):
        node, text = nodes[r.randrange(max(0, len(nodes) - 40), len(nodes))]
        letter = r.choice("DIKR")
        if all(text + letter != x for _, x in nodes):
            nodes.append((t.add(node, letter), text + letter))
    for _ in range(3000):
        (x, a), (y, b) = r.choice(nodes), r.choice(nodes)
        assert t.less(x, y) == (a < b) and t.spell(x) == a


def test_unbalanced_roles_stay_small():
    """Roles that are never legal keep two audits alive to the end."""
    rows = [("tool", f"{k}.", "") for k in range(20_001)]
    cost, audit, _ = _feed(cr.Repair(), rows).end()
    assert cost == 2 * 20_001 + 1 and audit == "D" + "R" * 20_000


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: brute.conversation(rs) for c, rs in brute.damaged(rows).items()}
    got = {r[0]: tuple(r)[1:] for r in REGISTRY["op11_conversation_repair"](spark, sf_dir).collect()}
    assert got == want and sum(w[5] for w in want.values()) > 0


def test_edges(spark):
    r = random.Random(8)
    rows = [(c, r.choice([None, *range(6)]), r.choice([None, "", "system", "user", "assistant", "usher", "x"]),
             r.choice([None, "", " \t", "a.", "a.", "b", "c! ", "d.\n", "é?\x0b", "long " * 2000 + "."])) for c in [None, *range(60)] for _ in range(r.randint(1, 7))]
    rows += [(1000, 2**62, "user", "z."), (1000, -5, "user", "z.")]
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], SCHEMA + ", digest int, seen string").repartition(5)
    want = {c: brute.conversation(rs) for c, rs in brute.damaged(rows).items()}
    assert {x[0]: tuple(x)[1:] for x in cr.report(cr.damaged(df)).collect()} == want
    messages = {}
    for m in cr.repaired(cr.damaged(df)).orderBy("conv_id", "pos").collect():
        messages.setdefault(m["conv_id"], []).append(f"{m['role']}:{m['text']}")
    for c, w in want.items():
        assert hashlib.sha256("\n".join(messages.get(c, [])).encode()).hexdigest() == w[-1]
    assert cr.report(cr.damaged(df.limit(0))).count() == 0 and cr.repaired(cr.damaged(df.limit(0))).count() == 0
    assert cr.report(cr.undamaged(df)).count() == len(want)
