"""Repair of conversations at least cost: rank-convergence parallel Viterbi.

A conversation is right if its role initials read ``(s?(ua)+)?``. Going through its rows, each is kept (0),
given the role user or assistant (3) or deleted (4, the only way for blank and repeated rows); a
truncated row that stays costs 3 more; rows without text may be inserted anywhere (3). Of the cheapest
series of edits the one is taken whose initials (Delete, Insert, Keep, Rerole) come first in ASCII.

What counts for the rest of a conversation is one of four states: nothing yet, after s, after u,
after a. Costs run backwards: a vector holds the least cost from each state to the end. Rows act on
vectors by minima and sums, and soon only one direction is left: vectors that began differently differ by a
constant. So conversations are cut into chunks that are worked on at the same time. Each chunk
begins with a speculative vector at its end (:func:`backward`). In fix-up passes a chunk takes the
vector that its right neighbour has come to, and if that differs from the one it took before by more than a
constant, it runs again until its vectors are parallel to the ones it has; if that is not before its first
row, its left neighbour looks again (:func:`_settled`). Then the edits are traced forwards: a row's best
edit depends on the state and on the vector behind the row up to a constant. A chunk is traced from
all four states, what it makes of them is composed over neighbours in steps of doubling width
(:func:`_entered`), and the trace from the right one gives its edits.

Rows are sorted by range of conversation and turn, the last key being a number of the row, so a
conversation with a third of all rows lies in many ranges, even if its rows are equal. Conversations that lie
whole within a range are repaired there, at once; the others are those at its borders and those of more than
``CHUNK_ROWS`` rows or ``CHUNK_BYTES`` bytes. Of these, rows that are equal to an earlier one are found by
128-bit digests and an aggregation. Rows that must be deleted leave vectors as they are, so chunks
without others take no part in the passes.

Edge cases: a null role or text counts as one space, a null conv_id as a conversation of its own, null
turns come first and a span of turns beyond 64 bits has null gaps; rows of one turn are in the order of a hash of role and text. A role whose initial is none
of s, u and a cannot be kept. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumtrace.llm.common import arrow_batches
from sumtrace.session import cut, uncut

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
CHUNK_ROWS = 1 << 14
CHUNK_BYTES = 4 << 20
BLANKS = " \t\n\v\f\r"
ENDS = ".!?"
INITIALS = "sua"
#: State after a row with initial s, u, a (-1: not allowed) in states nothing, s, u, a.
_NEXT = ((1, 2, -1), (-1, 2, -1), (-1, -1, 3), (-1, 2, -1))
#: State after a user's or assistant's row, whichever is allowed.
_TURN = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
_OTHER = 3
#: A row's code: initial (s, u, a, other), 4: truncated, 8: must be deleted.
_TRUNCATED, _GONE = 4, 8

Vector = tuple[int, int, int, int]
END: Vector = (0, 6, 3, 0)
SPECULATIVE: Vector = (0, 0, 0, 0)


def code(role: str, text: str) -> int:
    """Code of a row that is no repetition."""
    initial = INITIALS.find(role[0]) if role[:1] in INITIALS and role else _OTHER
    said = text.rstrip(BLANKS)
    if not said:
        return initial | _GONE
    return initial | (0 if said[-1] in ENDS else _TRUNCATED)


def _choices(state: int, row: int, after: Vector) -> list[tuple[int, str, int, int]]:
    """(cost to the end, initial, next state, cost) of the edits of a row, without insertions before it."""
    out = [(DELETE + after[state], "D", state, DELETE)]
    if not row & _GONE:
        late = TRUNCATED if row & _TRUNCATED else 0
        initial = row & 3
        kept = _NEXT[state][initial] if initial != _OTHER else -1
        if kept >= 0:
            out.append((KEEP + late + after[kept], "K", kept, KEEP + late))
        turn = _TURN[state]
        out.append((REROLE + late + after[turn], "R", turn, REROLE + late))
    return out


def _normal(vector: list[int]) -> Vector:
    least = min(vector)
    return tuple(v - least for v in vector)


@cache
def before(row: int, after: Vector) -> Vector:
    """The vector before a row, up to a constant, from the one behind it."""
    own = [min(_choices(s, row, after))[0] for s in range(4)]
    for _ in range(2):  # a second insertion can follow a first one
        own = [min(v, INSERT + own[_TURN[s]]) for s, v in enumerate(own)]
    return _normal(own)


@cache
def step(state: int, row: int, after: Vector) -> tuple[str, int, int]:
    """Initials of the edits at a row, insertions before it included, the state behind it, and their cost."""
    ways, at, inserted = [], state, 0
    for n in range(3):
        for total, edit, then, cost in _choices(at, row, after):
            ways.append((total + inserted, "I" * n + edit, then, cost + inserted))
        at, inserted = _TURN[at], inserted + INSERT
    least = min(w[0] for w in ways)
    _, edits, then, cost = min((w for w in ways if w[0] == least), key=lambda w: w[1])
    return edits, then, cost


#: Insertions at the end of a conversation, from each state.
_CLOSING = ("", "II", "I", "")


def backward(codes: bytes, end: Vector, known: bytes | None = None) -> tuple[bytes, Vector]:
    """Vectors behind each row, four bytes a row, and the one before the first.

    With ``known``, vectors of an earlier run, the run ends where it meets a parallel one.
    """
    out = bytearray(known or bytes(4 * len(codes)))
    vector = end
    for i in range(len(codes) - 1, -1, -1):
        cell = bytes(vector)
        if known is not None and out[4 * i : 4 * i + 4] == cell:
            return bytes(out), before(codes[0], tuple(out[:4]))
        out[4 * i : 4 * i + 4] = cell
        vector = before(codes[i], vector)
    return bytes(out), vector


def trace(codes: bytes, vectors: bytes, state: int) -> tuple[list[str], int, int]:
    """Edits at each row from ``state`` on, the last state, and the cost."""
    edits, cost = [], 0
    for i, row in enumerate(codes):
        initials, state, own = step(state, row, tuple(vectors[4 * i : 4 * i + 4]))
        edits.append(initials)
        cost += own
    return edits, state, cost


def replayed(rows: list[tuple[str, str]], edits: list[str], state: int, codes: bytes, closing: str = "") -> list[dict[str, str]]:
    """The rows that edits make of ``rows`` (role, text), from ``state`` on."""
    out = []
    for (role, text), initials, row in zip([*rows, ("", "")], [*edits, closing], [*codes, 0]):
        for edit in initials:
            if edit == "K":
                state = _NEXT[state][row & 3]
                out.append({"role": role, "text": text})
            elif edit != "D":
                state = _TURN[state]
                out.append({"role": _ROLE[state], "text": text if edit == "R" else ""})
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with damage by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes
    the ends of its sentences, 3 repeats it, 4 makes it the user's.

    Dropped rows stay, marked ``dropped``, so that no conversation is lost.
    """

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    said = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(text("role")).alias("role"),
        said.alias("text"),
        (fault == 0).alias("dropped"),
        F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_PIECE = (
    "conv_id long, piece long, pieces long, rows long, first_turn long, last_turn long, turns long, "
    "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role string, text string>>"
)
_CHUNK = f"{_PIECE}, part int, seq long, open boolean, codes binary, digests binary"
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.replace("struct<role string, text string>", "s").split(", ")]


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = [c.split()[1] for c in schema.replace("struct<role string, text string>", "s").split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r.get(n) for r in rows], _TYPES.get(k, _TURNS)) for n, k in zip(_names(schema), kinds)], names=_names(schema)
    )


def _pairs(codes: bytes) -> int:
    """Neighbours whose initials are not su, ua or au."""
    initials = [c & 3 for c in codes]
    return sum(p not in ((0, 1), (1, 2), (2, 1)) for p in zip(initials, initials[1:]))


def _counted(codes: bytes, repeats: list[int]) -> dict[str, int]:
    own = np.frombuffer(codes, np.uint8)
    gone = int(((own & _GONE) > 0).sum())
    return {"blank": gone - len(repeats), "duplicate": len(repeats), "truncated": int(((own & (_GONE | _TRUNCATED)) == _TRUNCATED).sum())}


def _solved(rows: list[tuple[str, str]], codes: bytes, state: int = 0, vectors: bytes | None = None, last: bool = True) -> dict:
    """Cost, audit and repaired rows of a chunk; of a whole conversation by default."""
    vectors = backward(codes, END)[0] if vectors is None else vectors
    edits, then, cost = trace(codes, vectors, state)
    closing = _CLOSING[then] if last else ""
    return {
        "cost": cost + INSERT * len(closing),
        "audit": "".join(edits) + closing,
        "repaired": replayed(rows, edits, state, codes, closing),
    }


def _summary(conv: int | None, turns: list[int | None], codes: bytes) -> dict:
    there = [t for t in turns if t is not None]
    ends = {"first_turn": there[0], "last_turn": there[-1], "turns": len(set(there))} if there else {"turns": 0}
    return {"conv_id": conv, "rows": len(codes), "illegal": _pairs(codes), **ends}


class _Segment:
    """Rows of one conversation within a range, up to the bounds of a chunk."""

    def __init__(self, conv: int | None):
        self.conv, self.size, self.codes = conv, 0, bytearray()
        self.turns: list[int | None] = []
        self.rows: list[tuple[str, str]] = []

    def add(self, turn: int | None, role: str, text: str) -> None:
        self.turns.append(turn)
        self.rows.append((role, text))
        self.codes.append(code(role, text))
        self.size += len(text)

    def whole(self) -> dict:
        seen, repeats = set(), []
        for i, row in enumerate(self.rows):
            if row in seen and not self.codes[i] & _GONE:
                repeats.append(i)
            seen.add(row)
        for i in repeats:
            self.codes[i] |= _GONE
        codes = bytes(self.codes)
        return _summary(self.conv, self.turns, codes) | _counted(codes, repeats) | _solved(self.rows, codes) | {"piece": 0, "pieces": 1, "open": False}

    def chunk(self, part: int, seq: int) -> dict:
        digests = b"".join(hashlib.blake2b(f"{len(a)}:{a}{b}".encode(), digest_size=16).digest() for a, b in self.rows)
        rows = [{"role": a, "text": b} for a, b in self.rows]
        return _summary(self.conv, self.turns, bytes(self.codes)) | {"repaired": rows, "part": part, "seq": seq, "open": True, "codes": bytes(self.codes), "digests": digests}


def _chunks(batches: Iterator[pa.RecordBatch], chunk_rows: int) -> Iterator[pa.RecordBatch]:
    """Conversations that are whole within a range, repaired, and the chunks of the others."""
    out: list[dict] = []
    segment, seq, part, border, size = None, 0, None, True, 0  # border: the segment may go on in another range
    for batch in batches:
        for part, conv, turn, role, text, dropped in zip(*[c.to_pylist() for c in batch.columns]):
            if segment is None or segment.conv != conv:
                if segment is not None:
                    out.append(segment.chunk(part, seq) if border else segment.whole())
                    seq, border = seq + border, False
                else:
                    border = True
                segment = _Segment(conv)
            elif len(segment.rows) >= chunk_rows or segment.size >= CHUNK_BYTES:
                out.append(segment.chunk(part, seq))
                seq, border, segment = seq + 1, True, _Segment(conv)
            if not dropped:
                segment.add(turn, role, text)
                size += len(text)
            if size > CHUNK_BYTES or len(out) >= CHUNK_ROWS:
                yield _batch(out, _CHUNK)
                out, size = [], 0
    if segment is not None:
        out.append(segment.chunk(part, seq))
    if out:
        yield _batch(out, _CHUNK)


def _numbered(chunks: DataFrame, name: str) -> DataFrame:
    """``chunks`` with a running number over ranges and places within them."""
    sizes = sorted(chunks.groupBy("part").count().collect())  # one per range
    at, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, at))
        at += n
    offsets = chunks.sparkSession.createDataFrame(offsets, "part int, begin long")
    place = F.row_number().over(Window.partitionBy("part").orderBy("seq")).cast("long")
    return chunks.withColumn("place", place).join(offsets, "part").withColumn(name, F.col("begin") + F.col("place")).drop("place", "begin")


def _mapped(df: DataFrame, columns: list[str], fn, schema: str) -> DataFrame:
    """``fn`` of some columns of each row, a dict of the columns of ``schema``."""

    def of(batches):
        for batch in batches:
            rows = [fn(*cells) for cells in zip(*[batch.column(c).to_pylist() for c in columns])]
            yield _batch(rows, schema)

    return df.select(*columns).mapInArrow(of, schema)


def _judged(chunks: DataFrame) -> DataFrame:
    """(part, seq, codes, counts) with the rows marked that are equal to an earlier one of their conversation."""
    schema = "part int, seq long, conv_id long, i int, digest binary"

    def digests(batches):
        for batch in batches:
            rows = [
                {"part": p, "seq": q, "conv_id": c, "i": i, "digest": d[16 * i : 16 * i + 16]}
                for p, q, c, d in zip(*[batch.column(n).to_pylist() for n in ("part", "seq", "conv_id", "digests")])
                for i in range(len(d) // 16)
            ]
            yield _batch(rows, schema)

    each = chunks.select("part", "seq", "conv_id", "digests").mapInArrow(digests, schema)
    first = each.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "seq", "i")).alias("at"))
    fresh = first.groupBy("at.part", "at.seq").agg(F.collect_list("at.i").alias("fresh"))  # rows of one chunk
    rows = chunks.select("part", "seq", "codes").join(fresh, ["part", "seq"], "left")

    def marked(part, seq, codes, fresh):
        fresh = set(fresh or ())
        repeats = [i for i, c in enumerate(codes) if i not in fresh and not c & _GONE]
        own = bytearray(codes)
        for i in repeats:
            own[i] |= _GONE
        live = bytes(c for c in own if not c & _GONE)
        return {"part": part, "seq": seq, "codes": bytes(own), "live": live} | _counted(bytes(own), repeats)

    return _mapped(rows, ["part", "seq", "codes", "fresh"], marked, "part int, seq long, codes binary, live binary, blank long, duplicate long, truncated long")


def _settled(live: DataFrame, counts: dict | None = None) -> DataFrame:
    """(part, seq, vectors) of the chunks of ``live`` (part, seq, conv_id, n, live): fix-up passes until none changes."""

    def begun(part, seq, conv, n, codes):
        vectors, start = backward(codes, SPECULATIVE)
        return {"part": part, "seq": seq, "conv_id": conv, "n": n, "live": codes, "took": bytes(SPECULATIVE), "vectors": vectors, "start": bytes(start)}

    schema = "part int, seq long, conv_id long, n long, live binary, took binary, vectors binary, start binary"
    state = cut(_mapped(live, ["part", "seq", "conv_id", "n", "live"], begun, schema))
    passes = 0
    while True:
        right = state.select((F.col("n") - 1).alias("n_left"), F.col("conv_id").alias("of"), F.col("start").alias("right"))
        met = state.join(right, (F.col("n") == F.col("n_left")) & F.col("conv_id").eqNullSafe(F.col("of")), "left")
        due = F.coalesce("right", F.lit(bytes(END)))
        met = met.select(*_names(schema), due.alias("due"))

        def again(part, seq, conv, n, codes, took, vectors, start, due):
            if took != due:
                vectors, vector = backward(codes, tuple(due), vectors)
                took, start = due, bytes(vector)
            return {"part": part, "seq": seq, "conv_id": conv, "n": n, "live": codes, "took": took, "vectors": vectors, "start": start}

        pending = met.where(F.col("took") != F.col("due")).select(F.count("*")).first()[0]
        if counts is not None:
            counts["passes"] = passes
        if not pending:
            return state
        after = cut(_mapped(met, [*_names(schema), "due"], again, schema))
        uncut(state)
        state, passes = after, passes + 1


def _entered(chunks: DataFrame) -> DataFrame:
    """(part, seq, entry) of ``chunks`` (part, seq, conv_id, m, turn): the state before each chunk.

    ``turn`` says into which state a chunk turns each of the four. Each row takes in what comes
    before it, twice as far in each step.
    """
    prior = chunks.select((F.col("m") + 1).alias("m"), F.col("conv_id").alias("of"), F.col("turn").alias("turn"))
    own = chunks.select("part", "seq", "conv_id", "m").join(prior, "m", "left")
    inside = F.coalesce(F.col("conv_id").eqNullSafe(F.col("of")) & F.col("turn").isNotNull(), F.lit(False))
    # a row's map is of all rows from ``begin`` on up to the one before it
    state = cut(own.select("part", "seq", "conv_id", "m", F.when(inside, F.col("turn")).alias("turn"), F.when(inside, F.col("m") - 1).otherwise(F.col("m")).alias("begin")))
    composed = F.concat(*[F.substring("turn", F.conv(F.hex(F.substring("earlier", i, 1)), 16, 10).cast("int") + 1, 1) for i in (1, 2, 3, 4)])
    while True:
        other = state.select(F.col("m").alias("begin"), F.col("turn").alias("earlier"), F.col("begin").alias("further"))
        met = state.join(other, "begin")
        more = met.where(F.col("earlier").isNotNull() & F.col("turn").isNotNull()).limit(1).count()
        if not more:
            entry = F.coalesce(F.conv(F.hex(F.substring("turn", 1, 1)), 16, 10).cast("int"), F.lit(0))
            return state.select("part", "seq", entry.alias("entry"))
        turn = F.when(F.col("turn").isNull() | F.col("earlier").isNull(), F.col("turn")).otherwise(composed)
        after = cut(met.select("part", "seq", "conv_id", "m", turn.alias("turn"), F.coalesce("further", "begin").alias("begin")))
        uncut(state)
        state = after


def _opened(chunks: DataFrame, counts: dict | None = None) -> DataFrame:
    """Pieces of the conversations that lie in several chunks, or may."""
    judged = cut(_judged(chunks).join(chunks.select("part", "seq", "conv_id"), ["part", "seq"]))
    live = cut(_numbered(judged.where(F.octet_length("live") > 0).select("part", "seq", "conv_id", "live"), "n"))
    settled = _settled(live, counts)

    def turned(part, seq, conv, codes, vectors):
        ends = bytes(range(4)) if not codes else bytes(trace(codes, vectors, s)[1] for s in range(4))
        return {"part": part, "seq": seq, "conv_id": conv, "turn": ends}

    both = judged.select("part", "seq", "conv_id", "live").join(settled.select("part", "seq", "vectors"), ["part", "seq"], "left")
    turns = _mapped(both, ["part", "seq", "conv_id", "live", "vectors"], turned, "part int, seq long, conv_id long, turn binary")
    turns = cut(turns)
    numbered = cut(_numbered(turns, "m"))
    entries = _entered(numbered)
    ends = chunks.select("part", "seq", "conv_id", "first_turn", "last_turn", "codes", "rows").join(numbered.select("part", "seq", "m"), ["part", "seq"])
    near = cut(_borders(ends))
    work = (
        chunks.drop("codes", "blank", "duplicate", "truncated", "cost", "audit", "piece", "pieces")
        .join(judged.drop("conv_id", "live"), ["part", "seq"])
        .join(settled.select("part", "seq", "vectors"), ["part", "seq"], "left")
        .join(entries, ["part", "seq"])
        .join(near, ["part", "seq"])
    )
    columns = ["conv_id", "rows", "first_turn", "last_turn", "turns", "illegal", "repaired", "codes", "blank", "duplicate", "truncated", "vectors", "entry", "piece", "pieces", "same_turn", "bad_pair"]

    def finished(conv, n, first, last, turns, illegal, rows, codes, blank, duplicate, truncated, vectors, entry, piece, pieces, same, bad):
        known, spread, at = vectors or b"", bytearray(), 0
        for c in codes:  # rows that must go need no vector
            if c & _GONE:
                spread += bytes(4)
            else:
                spread += known[4 * at : 4 * at + 4]
                at += 1
        own = _solved([(r["role"], r["text"]) for r in rows], codes, entry, bytes(spread), piece == pieces - 1)
        return {
            "conv_id": conv, "piece": piece, "pieces": pieces, "rows": n, "first_turn": first, "last_turn": last, "turns": turns - same,
            "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal + bad, **own,
        }

    done = cut(_mapped(work, columns, finished, _PIECE))
    uncut(judged, live, settled, turns, numbered, entries, near)
    return done


def _borders(ends: DataFrame) -> DataFrame:
    """(part, seq, piece, pieces, same_turn, bad_pair): a chunk's place in its conversation, whether its first turn
    is also the last one before it, and whether its first initial may not follow the last one before it.

    Chunks without rows or without turns are passed over: the nearest one before them counts.
    """
    spans = ends.groupBy("conv_id").agg(F.min("m").alias("begin"), F.count("*").alias("pieces"))
    own = ends.join(spans, ends["conv_id"].eqNullSafe(spans["conv_id"])).drop(spans["conv_id"])

    def last_before(name: str, value: Column, there: Column) -> DataFrame:
        have = own.where(there).select("part", "seq", "m", "conv_id", value.alias(name))
        k = _numbered(have, "k")
        prior = k.select((F.col("k") + 1).alias("k"), F.col("conv_id").alias("of"), F.col(name).alias("prior"))
        return k.join(prior, "k").where(F.col("conv_id").eqNullSafe(F.col("of"))).select("part", "seq", "prior")

    turn = last_before("turn", F.col("last_turn"), F.col("last_turn").isNotNull()).withColumnRenamed("prior", "turn_before")
    initial = last_before("initial", F.expr("substring(codes, -1, 1)"), F.col("rows") > 0).withColumnRenamed("prior", "initial_before")

    def kind(c: Column) -> Column:
        return F.conv(F.hex(c), 16, 10).cast("int").bitwiseAND(F.lit(3))

    pair = kind(F.col("initial_before")) * 4 + kind(F.substring("codes", 1, 1))
    return (
        own.join(turn, ["part", "seq"], "left")
        .join(initial, ["part", "seq"], "left")
        .select(
            "part", "seq", (F.col("m") - F.col("begin")).alias("piece"), "pieces",
            F.coalesce((F.col("turn_before") == F.col("first_turn")).cast("long"), F.lit(0)).alias("same_turn"),
            F.coalesce((~pair.isin(0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1)).cast("long"), F.lit(0)).alias("bad_pair"),
        )
    )


def repaired(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, counts: dict | None = None) -> DataFrame:
    """Pieces of repaired conversations from ``rows`` (conv_id, turn, role, text, dropped).

    One row per piece, of which a conversation has one unless it is large or lies at the border of a
    range: its counts, cost, audit and the rows ``repaired``, in the order of ``piece`` below ``pieces``.
    """
    arrow_batches(rows.sparkSession)
    tie = F.xxhash64("role", "text")
    keyed = rows.select("conv_id", "turn", "role", "text", "dropped", tie.alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "tie", "row"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    columns = [F.spark_partition_id().alias("part"), "conv_id", "turn", "role", "text", "dropped"]
    first = cut(dealt.select(*columns).mapInArrow(lambda batches: _chunks(batches, chunk_rows), _CHUNK))
    opened = _opened(first.where("open"), counts)
    whole = cut(first.where("NOT open").select(*_names(_PIECE)).unionByName(opened))
    uncut(first, opened)
    return whole


def digested(pieces: DataFrame) -> DataFrame:
    """One row per conversation: counts, cost, audit and the digest of its repaired rows.

    A digest goes through a conversation from its first row to its last. Conversations of one piece are
    digested in place; for the others a task reads the pieces one by one in their order.
    """
    arrow_batches(pieces.sparkSession)
    line = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    lines = pieces.withColumn("lines", F.array_join(line, "\n")).withColumn("kept", F.size("repaired"))
    sums = ["rows", "turns", *_COUNTS, "cost"]
    span = F.try_subtract("last_turn", "first_turn")
    gaps = F.when(F.col("first_turn").isNull(), F.lit(0)).otherwise(F.try_add(span, 1 - F.col("turns"))).cast("long")
    out = ["conv_id", "gaps", *_COUNTS, "cost", "audit", "repaired_sha256"]
    single = lines.where("pieces = 1").select(*[gaps.alias(c) if c == "gaps" else F.sha2("lines", 256).alias(c) if c == "repaired_sha256" else c for c in out])
    schema = "conv_id long, repaired_sha256 string, audit string"

    def chained(batches):
        conv, state, audit, begun, any_ = None, None, [], False, False
        for batch in batches:
            for own, kept, text, edits in zip(*[c.to_pylist() for c in batch.columns]):
                if not any_ or own != conv:
                    if any_:
                        yield _batch([{"conv_id": conv, "repaired_sha256": state.hexdigest(), "audit": "".join(audit)}], schema)
                    conv, state, audit, begun, any_ = own, hashlib.sha256(), [], False, True
                if kept:
                    state.update(("\n" if begun else "").encode() + text.encode())
                    begun = True
                audit.append(edits)
        if any_:
            yield _batch([{"conv_id": conv, "repaired_sha256": state.hexdigest(), "audit": "".join(audit)}], schema)

    many = lines.where("pieces > 1")
    sorted_ = many.repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "kept", "lines", "audit")
    digests = sorted_.mapInArrow(chained, schema)
    totals = many.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in sums], F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"))
    both = digests.join(totals.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")))
    return single.unionByName(both.select(*[gaps.alias(c) if c == "gaps" else c for c in out]))
