"""Chat formatting and turn repair against plain versions."""

import hashlib
import heapq
import itertools
import random
import zlib

import pytest

from ledgerforge.llm import chat_format, turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, turns int, copy string, dropped string, digest long, audit string, whole string"
ODD = ["", None, "\\", "\\l", "\\b<turn", "<turn user>", "</turn>\n", "a</turn>\n<turn assistant>b", "<<turn", "ends </tur", "é🙂\n\n", ".", " \t\x0b", "Fine.", "cut off", "x" * 40_000 + ".", " ", "stop. ", "stop. \n"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def told():
    """(conv_id, turn, role, text): nulls everywhere, ties, repeats, odd roles, gaps, one long conversation."""
    dice = random.Random(3)
    rows = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate(itertools.product(["user", "assistant", None], ODD[:6]))]
    rows += [(3, None, "user", "Same."), (3, None, "user", "Same."), (3, 4, "assistant", "Tie."), (3, 4, "assistant", "Another."), (3, 9, "sys>tem", "x</turn>")]
    rows += [(c, t, dice.choice(["user", "assistant", "system", "tool", "", "u", None]), dice.choice(ODD)) for c in range(10, 40) for t in range(dice.randrange(1, 12))]
    rows += [(99, t, "user" if t % 5 else "assistant", f"Text {t // 3}{'.' if t % 4 else ''}") for t in range(700)]
    return rows


@pytest.fixture(scope="module")
def conversations(spark, told):
    """Those rows among further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "c", "d", 2, "K", "w") for r in told], SCHEMA)


def grouped(rows, key):
    found = {}
    for r in rows:
        found.setdefault(r[0], []).append(r)
    return {c: sorted(own, key=key) for c, own in found.items()}


def test_chat_formatting(conversations, told):
    own = grouped([(c, t, r or "", x or "") for c, t, r, x in [*told, (-7, 0, "user", chat_format.PROBE), (-7, 1, "assistant", chat_format.PROBE)]], lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    made = {r["conv_id"]: r for r in chat_format.chat_digests(conversations).collect()}
    assert set(made) == set(own)
    for c, rows in own.items():
        loss = "".join(x for _, _, r, x in rows if r == "assistant")
        assert (made[c]["n_turns"], made[c]["turns_sha256"]) == (len(rows), sha("".join(f"{r}\n{x}\n" for _, _, r, x in rows)))
        assert (made[c]["loss_chars"], made[c]["loss_sha256"]) == (len(loss), sha(loss))


def test_examples_hold_their_whole_context(conversations, told):
    own = grouped([(c, t, r or "", x or "") for c, t, r, x in told], lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    made = grouped([tuple(r) for r in chat_format.examples(conversations).collect()], lambda r: r[1])
    for c, rows in own.items():
        ends = [k for k, r in enumerate(rows, 1) if r[2] == "assistant" or k == len(rows)]
        assert [e[1] for e in made[c]] == ends
        for _, k, text, begin, end in made[c]:
            assert text == made[c][-1][2][: len(text)] and text.count("<turn ") == text.count("</turn>") == k
            masked = text[begin:end].replace("\\l", "<").replace("\\b", "\\")
            assert masked == (rows[k - 1][3] if rows[k - 1][2] == "assistant" else "")
        assert sum(e[4] - e[3] for e in made[c]) <= len(made[c][-1][2])


def cheapest(symbols):
    """(cost, audit) by a search over (turn, state) that orders by cost, then by the edits so far."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, k, roles = heapq.heappop(heap)
        state = roles[-1:] if roles != "s" else "s"
        if (k, state) in seen:
            continue
        seen.add((k, state))
        if k == len(symbols) and state in ("", "a"):
            return cost, audit
        following = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", k, following))
        if k < len(symbols):
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, roles[-1:]))
            x = symbols[k]
            if x != "X":
                late = x.isupper()
                heapq.heappush(heap, (cost + 2 + late, audit + "R", k + 1, following))
                if x.lower() == following or x.lower() == "s" and state == "":
                    heapq.heappush(heap, (cost + late, audit + "K", k + 1, x.lower()))
    raise AssertionError


@pytest.mark.parametrize("length", range(5))
def test_plans_of_every_short_conversation(length):
    for symbols in itertools.product("suaoSUAOX", repeat=length):
        assert turn_repair.plan("".join(symbols)) == cheapest(symbols)


def test_plans_of_long_runs(monkeypatch):
    dice = random.Random(8)
    for _ in range(60):
        symbols = "".join(dice.choice("suaoSUAOX") * dice.choice([1, 2, 3, 40, 200]) for _ in range(8))
        expected = cheapest(symbols)
        assert turn_repair.plan(symbols) == expected
        with monkeypatch.context() as short:
            short.setattr(turn_repair, "STEP", 1)
            assert turn_repair.plan(symbols) == expected
    cost, audit = turn_repair.plan("u" * 300_001)
    # Every second turn becomes an assistant's; one more goes in behind the last.
    assert cost == 2 * 150_000 + 2 and len(audit) == 300_002


def plain_report(told):
    blanks, rows = " \t\n\x0b\x0c\r", {}
    for c, t, r, x in told:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else "".join(k for k in x if k not in ".!?") if kind == 2 else x
        rows.setdefault(c, []).extend([(t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    for c, own in rows.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
        numbers, seen, symbols, counts = {t for t, _, _ in own if t is not None}, set(), "", [0, 0, 0]
        for _, r, x in own:
            body, known = x.rstrip(blanks), r[:1] if r[:1] in tuple("sua") else "o"
            fault = 0 if not body else 1 if (r, x) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((r, x))
            if fault is not None:
                counts[fault] += 1
            symbols += "X" if fault in (0, 1) else known.upper() if fault == 2 else known
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = cheapest(symbols)
        left, waiting = [], iter(own)
        stay = sum(e != "D" for e in audit)
        for e in audit:
            r, x = next(waiting)[1:] if e != "I" else ("", "")
            if e != "D":
                left.append(f"{r if e == 'K' else 'user' if (len(left) - stay) % 2 == 0 else 'assistant'}:{x}")
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        yield (c, gaps, *counts, illegal, cost, audit, sha("\n".join(left)), len(left))


def test_repair_against_plain_version(conversations, told):
    made = {r["conv_id"]: tuple(r) for r in turn_repair.repair_report(conversations).collect()}
    assert made == {row[0]: row for row in plain_report(told)}


def test_repaired_turns_follow_their_audit(conversations):
    turns = turn_repair.damage(conversations)
    plans = turn_repair.repair_plans(turns)
    made = grouped([tuple(r) for r in turn_repair.repaired_turns(turns, plans).collect()], lambda r: r[1])
    for c, *_, audit in plans.collect():
        assert "".join(r[2] for r in made.get(c, [])) == audit
        roles = "".join(r[3][0] for r in made.get(c, []) if r[2] != "D")
        assert roles.removeprefix("s" * (len(roles) % 2)) == "ua" * (len(roles) // 2) and roles != "s"


def test_empty_tables(conversations):
    assert turn_repair.repair_report(conversations.limit(0)).collect() == []
    assert [r["conv_id"] for r in chat_format.chat_digests(conversations.limit(0)).collect()] == [chat_format.PROBE_ID]


def test_a_conversation_without_any_turn_left(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = turn_repair.repair_report(spark.createDataFrame([(lost, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")).first()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", sha(""), 0)
