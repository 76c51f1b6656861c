"""Conversation repair against the plain recursion over whole strings."""

import hashlib
import random
import zlib
from functools import lru_cache

from hypothesis import given, settings, strategies as st

from conftest import SF_CHECK
from quire.llm import conversation_repair as R, queries as Q

SPACES = " \t\n\v\f\r"


def plain(rows):
    """(faults, illegal, cost, audit, repaired) of (role, text) rows."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.rstrip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))

    @lru_cache(None)
    def best(i, last, inserted):
        """(cost, audit, lines) behind ``last`` (an initial, or '' at the start)."""
        found = []
        after = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[after]
        if i == len(rows):
            if last in ("", "a"):
                found.append((0, "", ()))
        else:
            (role, text), fault = rows[i], faults[i]
            c, e, t = best(i + 1, last, 0)
            found.append((c + 4, "D" + e, t))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] == after or (role[:1] == "s" and last == ""):
                    c, e, t = best(i + 1, role[:1], 0)
                    found.append((c + more, "K" + e, (f"{role}:{text}", *t)))
                c, e, t = best(i + 1, after, 0)
                found.append((c + 3 + more, "R" + e, (f"{name}:{text}", *t)))
        if inserted < 3:
            c, e, t = best(i, after, inserted + 1)
            found.append((c + 3, "I" + e, (f"{name}:", *t)))
        return min(found) if found else (10**9, "", ())

    cost, audit, lines = best(0, "", 0)
    met = [a[:1] + b[:1] for (a, _), (b, _) in zip(rows, rows[1:])]
    return faults, sum(m not in ("su", "ua", "au") for m in met), cost, audit, "\n".join(lines)


def summary(rows):
    faults, illegal, cost, audit, repaired = plain(tuple(rows))
    return (*[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit,
            hashlib.sha256(repaired.encode()).hexdigest())


ROLE = st.sampled_from(["system", "user", "assistant", "tool", " ", "u2"])
TEXT = st.sampled_from(["Hi.", "Yes!", "What?", "cut", " ", "", "Hi. \n", "end.\x0b", "\x85"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), min_size=1, max_size=14), st.integers(1, 14))
def test_dp_and_block_maps_equal_plain_recursion(rows, cut):
    faults, _, cost, audit, _ = plain(tuple(rows))
    kinds = {"s": R.SYSTEM, "u": R.USER, "a": R.ASSISTANT}
    codes = bytes(kinds.get(r[:1], 0) | {"truncated": R.TRUNCATED, None: 0}.get(f, R.GONE) | (R.FIRST if i == 0 else 0)
                  for i, ((r, _), f) in enumerate(zip(rows, faults)))
    assert R.backward(codes, R.END)[R.START] == cost
    letters = "".join(R.block_edits(codes, R.END, R.START, True))
    assert letters.translate(str.maketrans("uaUA", "IIRR")) == audit
    # two blocks, and the maps of three pieces in either grouping
    right = R.cost_apply(R.cost_map(codes[cut:]), list(R.END)) if codes[cut:] else list(R.END)
    state = R.state_map(codes[:cut], tuple(right))[R.START]
    two = R.block_edits(codes[:cut], tuple(right), R.START, not codes[cut:])
    two += R.block_edits(codes[cut:], R.END, state, True) if codes[cut:] else []
    assert "".join(two) == letters
    a, b, c = R.cost_map(codes[cut:]), R.cost_map(codes[1:cut]), R.cost_map(codes[:1])
    assert R.cost_compose(R.cost_compose(a, b), c) == R.cost_compose(a, R.cost_compose(b, c))


def test_checkpoints_are_few():
    rng = random.Random(1)
    codes = bytes(rng.choice([1, 2, 3, 4, 6, 7, 8, 0]) for _ in range(5000))
    walk = R.forward(codes, R.END, R.START)
    next(walk)
    kept = walk.gi_frame.f_locals
    assert len(kept["saved"]) <= 72 and len(kept["behind"]) <= 71


def test_rows_blocks_nulls_ties_and_clashing_names(spark):
    rng = random.Random(7)
    rows = []
    for conv in [*range(12), None]:
        for turn in range(rng.randrange(1, 25)):
            rows.append((conv, rng.choice([turn, turn, None]), rng.choice(["system", "user", "assistant", "user", "assistant", None]),
                         rng.choice(["Hi.", "Yes!", f"t{turn}.", f"cut{turn}", None, ""]), "clash", 1))
    rows += [(50, 0, "user", "Same.", "", 1)] * 400 + [(51, 2**62, "user", "Long. " * 200_000, "", 1), (51, -2**62, "assistant", "A.", "", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, pos int").repartition(7)
    expected = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for c, t, r, x, *_ in rows if c == conv))
        turns = [t for has, t, *_ in mine if has]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        if len(mine) < 100:
            expected[conv] = (gaps, *summary([(r, x) for *_, r, x in mine]))
        else:  # copies of one user turn: all but one go, an answer is put in
            expected[conv] = (0, 0, 399, 0, 399, 399 * 4 + 3, "K" + "D" * 399 + "I", hashlib.sha256(b"user:Same.\nassistant:").hexdigest())
    for size, fan in ((1 << 16, 1024), (5, 3)):
        done = R.repair(df, block_rows=size, fan=fan).cache()
        found = {r.conv_id: tuple(r)[1:] for r in R.report(done).collect()}
        digest = {r.conv_id: tuple(r)[1:] for r in R.digests(done).collect()}
        assert {k: (*found[k], *digest[k]) for k in found} == expected
        turns = [(r.pos, r.nth, f"{r.role}:{r.text}") for r in R.repaired_turns(done).where("conv_id = 50").collect()]
        assert [x for *_, x in sorted(turns)] == ["user:Same.", "assistant:"]
        done.unpersist()
    empty = R.repair(df.where("pos = 2"))
    assert R.report(empty).count() == R.digests(empty).count() == 0


def test_query_equals_plain_recursion(spark):
    rows = spark.read.parquet(f"{SF_CHECK}/conversations.parquet").collect()
    kept: dict = {r.conv_id: [] for r in rows}
    for r in rows:
        h = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = {1: "", 2: r.text.translate(str.maketrans("", "", ".!?"))}.get(h, r.text)
        kept[r.conv_id] += [(r.turn, "user" if h == 4 else r.role, text)] * {0: 0, 3: 2}.get(h, 1)
    got = {r.conv_id: tuple(r)[1:] for r in Q.op12(spark, SF_CHECK).collect()}
    for conv, mine in kept.items():
        turns = {t for t, *_ in mine}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        assert got[conv] == (gaps, *summary([x[1:] for x in sorted(mine)]))
    assert len(got) == len(kept)
