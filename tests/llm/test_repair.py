import hashlib
import heapq
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetspark.llm import repair
from fleetspark.llm.queries import QUERIES

WHITE = " \t\n\v\f\r"
PATTERN = re.compile(r"(s?(ua)+)?")


def cheapest(turns):
    """Cost, audit and repaired turns by a search over all edits: (role, text, must_go, truncated) turns.

    Ways are taken up in the order of cost and letters, so the first that ends is the least.
    """
    todo = [(0, "", 0, ())]
    while todo:
        cost, audit, at, out = heapq.heappop(todo)
        roles = "".join(r[:1] for r, _ in out)
        if at == len(turns) and PATTERN.fullmatch(roles):
            return cost, audit, out
        if not re.fullmatch(r"s?(ua)*u?", roles):
            continue
        if audit[-2:] != "II":
            for role in ("user", "assistant"):
                heapq.heappush(todo, (cost + 3, audit + "I", at, (*out, (role, ""))))
        if at < len(turns):
            role, text, must_go, truncated = turns[at]
            heapq.heappush(todo, (cost + 4, audit + "D", at + 1, out))
            if not must_go:
                more = 3 * truncated
                if role:
                    heapq.heappush(todo, (cost + more, audit + "K", at + 1, (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(todo, (cost + 3 + more, audit + "R", at + 1, (*out, (new, text))))


def damage(rows):
    """The rows after damage, and all ids."""
    out, ids = [], []
    for conv_id, turn, role, text in rows:
        ids.append(conv_id)
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv_id, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out, set(ids)


def expected(rows, ids):
    """The result for rows that are damaged already."""
    dealt = defaultdict(list)
    for conv_id, turn, role, text in rows:
        dealt[conv_id].append((turn, role, text))
    out = []
    for conv_id in ids:
        own = sorted(dealt[conv_id], key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        counts, seen, turns = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, role, text in own:
            bare = text.strip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            turns.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        numbers = {t for t, _, _ in own if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, kept = cheapest(turns)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv_id, gaps, *counts.values(), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def found(df):
    return sorted([tuple(r) for r in df.select(*[x.split()[0] for x in repair._RESULT.split(", ")]).collect()], key=repr)


def test_the_query_equals_a_search_over_all_edits(spark):
    for sf in ("0.001", "0.01"):
        folder = f"/root/testdata/sf{sf}"
        rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
        assert found(QUERIES["op12_conversation_repair"](spark, folder)) == expected(*damage([tuple(r) for r in rows]))


def walk(turns):
    viterbi = repair.Viterbi()
    most = 0
    for turn in turns:
        viterbi.turn(*turn)
        most = max(most, viterbi.unresolved)
    cost, digest = viterbi.finish()
    return cost, "".join(viterbi.emitted), digest, most


TURN = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", " ", ""]), st.sampled_from(["a.", "b"]), st.booleans(), st.booleans())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TURN, st.integers(0, 3)), max_size=7))
def test_any_turns_by_search(drawn):
    turns = [(r, t, must and hard == 0, cut and hard < 2) for (r, t, must, cut), hard in drawn]
    cost, audit, kept = cheapest(turns)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    assert walk(turns)[:3] == (cost, audit, digest)


def test_edits_are_emitted_early_and_nodes_are_freed():
    """Well-formed turns with a fault now and then: what is unresolved stays short over 20,000 turns."""
    turns = []
    for i in range(10_000):
        turns += [("user", "x.", False, False), ("assistant", "y.", i % 7 == 0, i % 11 == 0)]
    cost, audit, _, most = walk(turns)
    assert most < 50 and len(audit) >= 20_000


def test_a_tie_that_only_the_end_decides():
    """Turns of no known role: two ways stay apart until the last turn tells whether the number is even."""
    for n in (9, 10, 401, 402):
        cost, audit, _, most = walk([("tool", f"{i}.", False, False) for i in range(n)])
        assert cost == 3 * n + n % 2 and most >= n - 1
        assert audit == ("D" + "R" * (n - 1) if n % 2 else "R" * n)


@pytest.fixture(scope="module")
def hard_turns():
    rows = [
        (1, 0, "system", "s."), (1, 1, "user", "q?"), (1, 2, "assistant", "a!"), (1, 2, "assistant", "a!"),
        (1, None, "user", "first."), (1, None, None, None), (2, 5, "user", "only"), (2, 9, "user", "only"),
        (3, 0, "system", "\x0b \n"), (4, None, None, None), (None, 0, "user", "x."), (None, 1, "assistant", "y.\n\n"),
        (None, None, "assistant", "y."), (5, 0, "", "text."), (5, 1, "User", "text."), (5, 2, "ünknown", "é漢.\n"),
        (6, 0, "user", "w " * 50_000 + "."), (6, 1, "assistant", "."), (6, 1, "user", "."), (7, 2, "system", "\x85"),
    ] + [(8, i % 9, "assistant", f"{i % 5}.") for i in range(12)] + [(9, 3, "user", "same.")] * 8
    return rows


def test_hard_rows(spark, hard_turns):
    schema = "conv_id long, turn long, role string, text string, present_ int, fault string, _copy int"
    df = spark.createDataFrame([(*r, 1, "x", None) for r in hard_turns], schema).repartition(5)
    own = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in hard_turns]
    assert found(repair.repaired(df)) == expected(own, {r[0] for r in own})
    assert found(repair.repaired(repair.damaged(df))) == expected(*damage(hard_turns))


def test_the_edits_are_those_of_the_audit(spark, hard_turns):
    df = repair.damaged(spark.createDataFrame(hard_turns, "conv_id long, turn long, role string, text string"))
    dealt = defaultdict(list)
    for r in repair.edits(df).collect():
        dealt[r.conv_id].append((r.place, r.edits))
    assert {c: "".join(e for _, e in sorted(own)) for c, own in dealt.items()} == {
        r.conv_id: r.audit for r in repair.repaired(df).collect() if r.audit
    }


def test_an_empty_table_and_dropped_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, present boolean"
    assert repair.repaired(spark.createDataFrame([], schema)).count() == 0
    one = repair.repaired(spark.createDataFrame([(1, 0, "user", "x.", False)], schema)).first()
    assert tuple(one) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
