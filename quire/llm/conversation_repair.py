"""Conversation structure repair by a square-root checkpointed DP.

A conversation's rows, in order of their turn, are edited so that their role
initials read ``(s?(ua)+)?``: Keep (0), Rerole to user or assistant (3), Delete
(4; the only edit of a blank or duplicate row), Insert an empty user or
assistant turn anywhere (3); an undeleted truncated row adds 3.  Of the cheapest
edits, the ASCII-least sequence of D, I, K, R is emitted.

*DP.*  The cost of repairing the rest from row i in automaton state s is a vector
of four numbers.  Walking backward gives every vector; walking forward, the first
of D, I, K, R that is *tight* (whose cost plus the cost behind it is the vector's)
gives the least sequence.  Vectors are stored only at every sqrt(n)-th row; the
forward walk recomputes the block it is in.

*At scale.*  All conversations are numbered in one order and cut into blocks of
``block_rows`` rows, one byte a row, so that neither a conversation of a third of
all rows nor a million short ones change a task's size.  A block acts on the
vector at its right edge as a (min, +) map, and on the state at its left edge as
a map of four states; both are composed as a tree (``operators.fold``).  The
vectors at block edges are the checkpoints of the whole table, and inside a
block the square-root scheme holds.

Edge cases: a null key is a conversation of its own; a null role or text is one
space; null turns come first; rows of equal turn sort by role and text, so
copies are neighbours; of equal rows the first is not a duplicate; a role counts
by its first letter; repeated rows are duplicates; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quire.operators.fold import block_states
from quire.operators.ordering import with_positions
from quire.session import materialize, ship_package

BLOCK_ROWS = 1 << 16
SPACE = "\x20\x09\x0A\x0B\x0C\x0D"
INF = 1 << 60

# a row's byte: role class, truncated, must go, first of its conversation
OTHER, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
ROLE, TRUNCATED, GONE, FIRST = 3, 4, 8, 16
# states: nothing yet, after the system row, after a user's, after an assistant's
START, S, U, A = 0, 1, 2, 3
NEXT = (U, U, A, U)                        # what an Insert or Rerole leads to
KEPT = {(START, SYSTEM): S, (START, USER): U, (S, USER): U, (U, ASSISTANT): A, (A, USER): U}
INSERTED, REROLED = "?.ua", "?.UA"         # by the state led to: U or A
NAMES = {"a": "assistant", "u": "user", "A": "assistant", "U": "user"}

Vector = tuple[int, int, int, int]


# ---- the DP ------------------------------------------------------------------

def _closed(w) -> Vector:
    """Costs where turns may be inserted first."""
    return tuple(min(w[s], 3 + w[NEXT[s]], 6 + w[NEXT[NEXT[s]]], INF) for s in range(4))


END: Vector = _closed((0, INF, INF, 0))    # behind a conversation's last row


@cache
def _back(code: int, v: Vector) -> Vector:
    """The vector before a row, from the vector behind it."""
    extra = 3 if code & TRUNCATED else 0
    w = []
    for s in range(4):
        costs = [4 + v[s]]
        if not code & GONE:
            costs.append(3 + extra + v[NEXT[s]])
            if (s, code & ROLE) in KEPT:
                costs.append(extra + v[KEPT[s, code & ROLE]])
        w.append(min(costs))
    return _closed(w)


def _shifted(v: Vector, by: int) -> Vector:
    return tuple(x + by if x < INF // 2 else INF for x in v)


@cache
def _step(code: int, v: Vector) -> tuple[Vector, int]:
    """``_back`` of a vector whose least number is 0: such a vector, and what it
    was lowered by.  Few vectors occur, so nearly every row is one look-up."""
    w = _back(code, v)
    return _shifted(w, -min(w)), min(w)


def backward(codes: bytes, v: Vector) -> Vector:
    """The vector before rows, from the vector behind them."""
    total = min(v)
    v = _shifted(v, -total)
    for c in reversed(codes):
        v, by = _step(c & ~FIRST, v)
        total += by
    return _shifted(v, total)


@cache
def _tight(code: int, v: Vector, s: int) -> tuple[str, int]:
    """The least tight edits of a row entered in state ``s`` (insertions before
    it included), and the state behind it."""
    before, extra, out = _back(code, v), 3 if code & TRUNCATED else 0, ""
    while True:
        goal, keep = before[s], KEPT.get((s, code & ROLE))
        if 4 + v[s] == goal:
            return out + "D", s
        if 3 + before[NEXT[s]] == goal:
            s = NEXT[s]
            out += INSERTED[s]
        elif not code & GONE and keep is not None and extra + v[keep] == goal:
            return out + "K", keep
        else:
            return out + REROLED[NEXT[s]], NEXT[s]


def closing(s: int) -> str:
    """The insertions behind the last row."""
    out = ""
    while END[s]:
        s = NEXT[s]
        out += INSERTED[s]
    return out


def forward(codes: bytes, v: Vector, s: int):
    """Per row, its edits and the state behind it; ``v`` is the vector behind the
    last row.  At most about 2 sqrt(n) vectors are held."""
    n = len(codes)
    if n == 0:
        return
    every = isqrt(n - 1) + 1
    v = _shifted(v, -min(v))
    saved = {}
    for i in range(n - 1, -1, -1):
        if (i + 1) % every == 0 or i == n - 1:
            saved[i] = v
        v, _ = _step(codes[i] & ~FIRST, v)
    for lo in range(0, n, every):
        hi = min(n, lo + every)
        v, behind = saved[hi - 1], []
        for i in range(hi - 1, lo - 1, -1):
            behind.append(v)
            v, _ = _step(codes[i] & ~FIRST, v)
        for i in range(lo, hi):
            edits, s = _tight(codes[i] & ~FIRST, behind.pop(), s)
            yield edits, s


# ---- blocks as maps ----------------------------------------------------------

def _starts(codes: bytes) -> list[int]:
    return np.flatnonzero(np.frombuffer(codes, np.uint8) & FIRST).tolist()


def cost_map(codes: bytes) -> list[int]:
    """What a block makes of the vector at its right edge: 16 numbers of a
    (min, +) matrix and 4 of a constant, for the conversation at its left edge."""
    starts = _starts(codes)
    if starts:  # that conversation ends in the block, or before it
        return [INF] * 16 + list(backward(codes[:starts[0]], END))
    columns = [backward(codes, tuple(0 if i == j else INF for i in range(4))) for j in range(4)]
    return [columns[j][i] for i in range(4) for j in range(4)] + [INF] * 4


def cost_apply(m: list[int], v: list[int]) -> list[int]:
    return [min(INF, m[16 + i], *(m[4 * i + j] + v[j] for j in range(4))) for i in range(4)]


def cost_compose(a: list[int], b: list[int]) -> list[int]:
    """The map of a, then b."""
    matrix = [min(INF, *(b[4 * i + k] + a[4 * k + j] for k in range(4))) for i in range(4) for j in range(4)]
    return matrix + cost_apply(b, a[16:])


def state_map(codes: bytes, right: Vector) -> list[int]:
    """The state at a block's right edge, by the state at its left one."""
    starts = _starts(codes)
    if starts:
        return [_last(codes[starts[-1]:], right, START)] * 4
    return [_last(codes, right, s) for s in range(4)]


def _last(codes: bytes, right: Vector, s: int) -> int:
    for _, s in forward(codes, right, s):
        pass
    return s


def block_edits(codes: bytes, right: Vector, state: int, ends: bool) -> list[str]:
    """The edits of a block's rows; ``ends`` if no conversation goes on behind it."""
    starts = _starts(codes)
    cuts = sorted({0, *starts, len(codes)})
    out = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        s = state if lo == 0 and not codes[0] & FIRST else START
        last = hi == len(codes)
        for edits, s in forward(codes[lo:hi], right if last else END, s):
            out.append(edits)
        if not last or ends:
            out[-1] += closing(s)
    return out


# ---- the operator ------------------------------------------------------------

def ordered_rows(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """key, turn, role, text, digest, mark, pos: all rows in one order."""
    r, t = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    kind = F.when(F.left("role", F.lit(1)) == "s", SYSTEM).when(F.left("role", F.lit(1)) == "u", USER).when(
        F.left("role", F.lit(1)) == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(bare == "", GONE).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    d = rows.select(F.col(key).alias("key"), F.col(turn).alias("turn"), r.alias("role"), t.alias("text"))
    d = d.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("mark", kind + fault)
    return with_positions(d, ["key", "turn", "role", "text"], name="pos")


def _codes(numbered: DataFrame) -> DataFrame:
    """(pos, mark, code): firsts and duplicates are found by partial minima of
    positions and marked by position, so no key gathers its rows."""
    first = numbered.groupBy("key").agg(F.min("pos").alias("pos")).select("pos", F.lit(FIRST).alias("flag"))
    fresh = numbered.groupBy("key", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(2 * FIRST).alias("flag"))
    flags = first.unionByName(fresh).groupBy("pos").agg(F.sum("flag").cast("int").alias("flag"))
    flag = F.coalesce("flag", F.lit(0))
    gone = F.when(flag >= 2 * FIRST, 0).otherwise(GONE)
    return numbered.select("pos", "mark").join(flags, "pos", "left").select(
        "pos", "mark", F.col("mark").bitwiseOR(gone).bitwiseOR(flag.bitwiseAND(FIRST)).alias("code"))


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           block_rows: int = BLOCK_ROWS, fan: int = 1024) -> DataFrame:
    """Per row: ``key``, pos (all rows in one order), turn, role, text, first (of
    its conversation), fault (blank, duplicate, truncated or null), illegal (its
    initial may not follow the one before), edits: letters ``D`` delete, ``K``
    keep, ``U``/``A`` rerole, ``u``/``a`` insert a turn before, or after the last
    row, in order."""
    ship_package(rows.sparkSession)
    numbered = ordered_rows(rows, key, turn, role, text)
    coded = _codes(numbered)
    packed = coded.groupBy(F.floor(F.col("pos") / block_rows).cast("long").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "code", "mark"))).alias("rows"))
    packed = materialize(packed.select("block", F.transform("rows", lambda x: x["code"]).alias("codes"),
                                       F.transform("rows", lambda x: x["mark"]).alias("marks")), "conversation-blocks")
    n = packed.count()

    def each(fn, df: DataFrame, schema: str) -> DataFrame:
        """``fn`` of every block's row (a dict, with its codes as bytes)."""
        def run(batches):
            for b in batches:
                for i in range(b.num_rows):
                    row = {c: b.column(c)[i].as_py() for c in b.schema.names if c not in ("codes", "marks")}
                    row["codes"] = bytes(b.column("codes")[i].values.to_pylist())
                    row["marks"] = b.column("marks")[i].values.to_numpy()
                    yield fn(row)
        return df.mapInArrow(run, schema)

    def as_map(make):
        return lambda r: pa.RecordBatch.from_pydict({"block": pa.array([r["at"]], pa.int64()),
                                                     "map": pa.array([make(r)], pa.list_(pa.int64()))})

    backwards = packed.withColumn("at", F.lit(n - 1) - F.col("block"))
    costs = each(as_map(lambda r: cost_map(r["codes"])), backwards, "block long, map array<long>")
    right = block_states(costs, n, list(END), cost_compose, cost_apply, fan)
    right = right.select((F.lit(n - 1) - F.col("block")).alias("block"), F.col("state").alias("right"))
    packed = packed.join(materialize(right, "checkpoints"), "block")
    states = each(as_map(lambda r: state_map(r["codes"], tuple(r["right"]))), packed.withColumn("at", F.col("block")),
                  "block long, map array<long>")
    left = block_states(states, n, [START], lambda f, g: [g[s] for s in f], lambda f, s: [f[s[0]]], fan)
    edge = packed.select("block", F.get("codes", 0).alias("head"), F.element_at("codes", -1).alias("tail"))
    whole = (packed.join(left.withColumnRenamed("state", "left"), "block")
             .join(edge.select((F.col("block") + 1).alias("block"), F.col("tail").alias("before")), "block", "left")
             .join(edge.select((F.col("block") - 1).alias("block"), F.col("head").alias("after")), "block", "left"))

    def decide(r):
        codes = np.frombuffer(r["codes"], np.uint8)
        edits = block_edits(r["codes"], tuple(r["right"]), r["left"][0], r["after"] is None or bool(r["after"] & FIRST))
        kinds = codes & ROLE
        last = np.concatenate(([OTHER if r["before"] is None else r["before"] & ROLE], kinds[:-1]))
        follows = ((last == SYSTEM) & (kinds == USER)) | ((last == USER) & (kinds == ASSISTANT)) | ((last == ASSISTANT) & (kinds == USER))
        first = (codes & FIRST) > 0
        fault = np.where(r["marks"] & GONE, "blank", np.where(codes & GONE, "duplicate", np.where(codes & TRUNCATED, "truncated", "")))
        return pa.RecordBatch.from_pydict({
            "pos": pa.array(np.arange(len(codes)) + r["block"] * block_rows, pa.int64()), "first": pa.array(first),
            "fault": pa.array([x or None for x in fault.tolist()], pa.string()), "illegal": pa.array(~first & ~follows),
            "edits": pa.array(edits, pa.string())})

    decided = each(decide, whole, "pos long, first boolean, fault string, illegal boolean, edits string")
    return numbered.join(decided, "pos").select(
        F.col("key").alias(key), "pos", "turn", "role", "text", "first", "fault", "illegal", "edits")


def repaired_turns(repaired: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key``, pos, nth, role, text of the repaired conversations, in order of
    (pos, nth)."""
    d = repaired.select(key, "pos", "role", "text", F.posexplode(F.split("edits", "")).alias("nth", "edit"))
    d = d.where(F.col("edit").isin("K", "U", "A", "u", "a"))
    return d.select(key, "pos", "nth", F.when(F.col("edit") == "K", F.col("role")).when(
        F.lower("edit") == "u", "user").otherwise("assistant").alias("role"),
        F.when(F.col("edit").isin("u", "a"), F.lit("")).otherwise(F.col("text")).alias("text"))


def report(repaired: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost."""
    times = lambda letters: F.length("edits") - F.length(F.translate("edits", letters, ""))
    kept = (times("D") == 0) & F.col("fault").eqNullSafe("truncated")
    cost = 4 * times("D") + 3 * times("uaUA") + F.when(kept, 3).otherwise(0)
    wide = lambda c: c.cast("decimal(20,0)")
    gaps = wide(F.max("turn")) - wide(F.min("turn")) + 1 - wide(F.count_distinct("turn"))
    number = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return repaired.groupBy(key).agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        *[number(F.col("fault").eqNullSafe(k)).alias(k) for k in ("blank", "duplicate", "truncated")],
        number(F.col("illegal")).alias("illegal"), number(cost).alias("cost"))


def digests(repaired: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key``, audit, repaired_sha256 (of ``role:text`` lines) per conversation.
    A digest is made from a conversation's first row to its last, so a task
    streams over its sorted rows and holds one audit and one batch."""
    ship_package(repaired.sparkSession)
    d = repaired.select(F.col(key).alias("key"), "pos", "first", "role", "text", "edits")
    out = T.StructType([d.schema["key"], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    initials = str.maketrans("uaUA", "IIRR")

    def stream(batches):
        audit, lines, sha, name, kind = [], 0, hashlib.sha256(), None, None

        def done(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string()),
                                               pa.array([r[2] for r in rows], pa.string())], ["key", "audit", "repaired_sha256"])

        for b in batches:
            rows, kind = [], b.schema.field("key").type
            for k, first, role, text, edits in zip(*(b.column(c) for c in ("key", "first", "role", "text", "edits")), strict=True):
                if first.as_py():
                    if audit:
                        rows.append((name, "".join(audit), sha.hexdigest()))
                    audit, lines, sha, name = [], 0, hashlib.sha256(), k.as_py()
                ops = edits.as_py()
                audit.append(ops.translate(initials))
                for op in ops:
                    if op != "D":
                        line = f"{role.as_py() if op == 'K' else NAMES[op]}:{'' if op in 'ua' else text.as_py()}"
                        sha.update(("\n" + line if lines else line).encode())
                        lines += 1
            yield done(rows)
        if audit:
            yield done([(name, "".join(audit), sha.hexdigest())])

    return (d.repartition("key").sortWithinPartitions("key", "pos").mapInArrow(stream, out)
            .withColumnRenamed("key", key))


# ---- damage ------------------------------------------------------------------

def _spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with known faults, by crc32 of ``conv_id:turn``
    modulo 20: 0 is dropped, 1 loses its text, 2 its ``.!?``, 3 is repeated, 4
    becomes a user's."""
    h = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")) % 20
    d = rows.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"), h.alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return d.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text"), copies.alias("copy")).drop("copy")
