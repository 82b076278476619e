"""Repairs against a search over all edits, and chunks against whole conversations."""

import hashlib
import random
import re
import zlib

import pytest

from sumtrace.llm import dialogue as D
from sumtrace.llm.queries import queries
from tests.conftest import SMALL

BLANK = re.compile("[^\x20\x09-\x0d]")


def brute_damage(rows):
    """Rows (conv, turn, role, text) after damage, nulls as one space."""
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        n = zlib.crc32(key.encode()) % 20
        if n == 1:
            text = ""
        if n == 2:
            text = re.sub("[.!?]", "", text)
        if n == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if n == 0 else 2 if n == 3 else 1)
    return out


def brute_repair(rows, judged):
    """Least (cost, audit, lines) over all ways, by states of the role initials written so far."""
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(ways):
        ways = dict(ways)
        for _ in range(2):
            for state, (cost, audit, lines) in list(ways.items()):
                for c in "ua":
                    to = follow.get((state, c))
                    new = (cost + 3, audit + "I", [*lines, f"{names[c]}:"])
                    if to is not None and (to not in ways or new[:2] < ways[to][:2]):
                        ways[to] = new
        return ways

    ways = inserted({"": (0, "", [])})
    for (role, text), fault in zip(rows, judged):
        after = {}

        def put(state, new):
            if state not in after or new[:2] < after[state][:2]:
                after[state] = new

        for state, (cost, audit, lines) in ways.items():
            put(state, (cost + 4, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                late = 3 * (fault == "truncated")
                if (to := follow.get((state, role[:1]))) is not None:
                    put(to, (cost + late, audit + "K", [*lines, f"{role}:{text}"]))
                for c in "ua":
                    if (to := follow.get((state, c))) is not None:
                        put(to, (cost + late + 3, audit + "R", [*lines, f"{names[c]}:{text}"]))
        ways = inserted(after)
    return min((w for s, w in ways.items() if s in ("", "a")), key=lambda w: w[:2])


def brute(rows):
    """Expected rows of the query; rows of one turn must be equal."""
    out = {}
    after = brute_damage(rows)
    for conv in {r[0] for r in rows}:
        own = [r for r in after if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        seen, judged = set(), []
        for _, _, role, text in own:
            said = BLANK.findall(text)
            judged.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        cost, audit, lines = brute_repair([r[2:] for r in own], judged)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[judged.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def found(pieces):
    rows = D.digested(pieces).collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", *D._COUNTS, "cost", "audit", "repaired_sha256")) for r in rows}


def made_up(rng, conv, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "no", "a b!", "", None, "so", "x?", " \n", "longer text."]
    turns = rng.sample(range(3 * n), n)
    return [(conv, None if rng.random() < 0.02 else t, rng.choice(roles), rng.choice([*texts, f"own {t}.", f"own {t}", f"new {t}!"])) for t in turns]


def test_whole_conversations(spark):
    rng = random.Random(1)
    rows = [r for c in range(400) for r in made_up(rng, c, rng.randint(1, 9))]
    rows = list({(r[0], r[1]): r for r in rows}.values())  # one row per turn: ties are in the order of a hash
    rows += [(None, 1, "user", "hi."), (None, 2, "assistant", None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS part", "2 AS seq", "3 AS codes", "4 AS piece")
    assert found(D.repaired(D.damaged(df))) == brute(rows)


@pytest.mark.parametrize("chunk_rows", [1, 2, 5])
def test_chunks_are_as_good_as_whole_conversations(spark, chunk_rows):
    rng = random.Random(chunk_rows)
    rows = [r for c in range(12) for r in made_up(rng, c, 25)]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    rows += [(99, t, "user", "the same.") for t in range(40)]  # all but one must go
    df = spark.createDataFrame(rows, SCHEMA)
    counts = {}
    pieces = D.repaired(D.damaged(df), chunk_rows, counts)
    assert found(pieces) == brute(rows) and counts["passes"] > 1
    assert pieces.where("pieces > 1").count() > 20


def test_a_conversation_with_most_rows(spark):
    """Over many ranges; long runs of alternating turns need few passes."""
    rows = [(5, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(3000)]
    rows += [(c, 0, "user", "ok.") for c in range(300) if c != 5]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        counts = {}
        pieces = D.repaired(D.damaged(spark.createDataFrame(rows, SCHEMA)), counts=counts)
        got = found(pieces)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == brute(rows) and pieces.where("conv_id = 5").count() > 4 and counts["passes"] <= 4


def test_equal_rows_lie_in_several_ranges(spark):
    rows = [(5, 7, "user", "the same.")] * 2000 + [(c, 0, "user", "ok.") for c in range(100) if c != 5]
    dropped = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "false AS dropped").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = D.repaired(dropped)
        own = {r["conv_id"]: r for r in D.digested(pieces).collect()}[5]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert (own["duplicate"], own["illegal"], own["cost"]) == (1999, 1999, 4 * 1999 + 3)
    assert own["audit"] == "K" + "D" * 1999 + "I"
    assert pieces.where("conv_id = 5").count() > 1 and own["gaps"] == 0


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in queries()["op12_conversations"](spark, SMALL).collect()}
    assert got == brute(rows)


def test_edges(spark):
    odd = [(1, None, None, None), (2, None, "user", "x."), (2, None, "user", "x."), (3, -(2**63), "user", "a."), (3, 2**63 - 1, "user", "b."), (4, 1, "user", "y " * 300_000 + ".")]
    pieces = D.repaired(D.damaged(spark.createDataFrame(odd, SCHEMA)))
    got = found(pieces)
    assert set(got) == {1, 2, 3, 4} and got[1][0] == 0
    assert found(D.repaired(D.damaged(spark.createDataFrame([], SCHEMA)))) == {}
    gone = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    lost = found(D.repaired(D.damaged(spark.createDataFrame([(gone, 0, "user", "a.")], SCHEMA))))
    assert lost == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
