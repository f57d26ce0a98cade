"""Conversation repair: the search against plain recursion, the query against a plain version, odd rows."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from latticework.llm import conversations as C

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """(cost, audit) by trying all edits from each row and state on; rows are (initial, fault)."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(at, state, inserted):
        found = [(0, "")] if at == len(rows) and state in ("", "a") else []
        if inserted < 2:
            found += [(3 + c, "I" + e) for r in "ua" if r in step[state] for c, e in [best(at, step[state][r], inserted + 1)]]
        if at < len(rows):
            role, fault = rows[at]
            c, e = best(at + 1, state, 0)
            found.append((4 + c, "D" + e))
            if fault != "doomed":
                more = 3 * (fault == "cut")
                if role in step[state]:
                    c, e = best(at + 1, step[state][role], 0)
                    found.append((more + c, "K" + e))
                for r in "ua":
                    if r in step[state]:
                        c, e = best(at + 1, step[state][r], 0)
                        found.append((3 + more + c, "R" + e))
        return min(found, default=(10**6, "~"))

    return best(0, "", 0)


def codes_of(rows):
    return bytes(3 * "sua".find(r) + {"": 0, "doomed": 1, "cut": 2}[f] if r in ("s", "u", "a") else 9 + {"": 0, "doomed": 1, "cut": 2}[f] for r, f in rows)


@pytest.mark.parametrize("seed", range(4))
def test_search_is_cheapest_and_least(seed):
    rng = random.Random(seed)
    for _ in range(400):
        n = rng.randrange(0, 9 if seed < 3 else 90)
        rows = tuple((rng.choice("suuaaax"), rng.choice(["", "", "", "doomed", "cut"])) for _ in range(n))
        assert C.repair(codes_of(rows)) == plain_repair(rows), rows


def test_strides_of_any_length_agree(monkeypatch):
    rng = random.Random(9)
    for stride in (1, 2, 3, 7):
        monkeypatch.setattr(C, "STRIDE", stride)
        for _ in range(150):
            rows = tuple((rng.choice("suuaax"), rng.choice(["", "", "doomed", "cut"])) for _ in range(rng.randrange(0, 16)))
            assert C.repair(codes_of(rows)) == plain_repair(rows)


def test_a_long_conversation_takes_time_in_proportion():
    rng = random.Random(1)
    rows = [(rng.choice("uuaa"), rng.choice(["", "", "cut"])) for _ in range(60_000)]
    cost, audit = C.repair(codes_of(rows))
    assert sum(e != "I" for e in audit) == len(rows) and cost > 0


def test_failed_states_are_remembered():
    search = C.Search(codes_of([("a", ""), ("u", ""), ("a", "cut")]), C.AT_END)
    assert search.within(C.START, 0) is None
    before = list(search.bound_of)
    assert search.within(C.START, 3) is None and all(a >= b for a, b in zip(search.bound_of, before, strict=True))
    assert search.cheapest(C.START)[:2] == plain_repair((("a", ""), ("u", ""), ("a", "cut")))


def plain(rows):
    """The contract in plain Python; rows are (conv_id, turn, role, text)."""
    talks: dict = {}
    said = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        own = talks.setdefault(conv, [])
        k = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        own += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = []
    for conv, own in talks.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        turns, seen, marks, count = [r[0] for r in own if r[0] is not None], set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else ""
            seen.add((role, text))
            marks.append((role[:1] if role[:1] in ("s", "u", "a") else "x", {"": "", "truncated": "cut"}.get(fault, "doomed")))
            if fault:
                count[fault] += 1
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit = plain_repair(tuple(marks))
        lines, state, left = [], "", iter(own)
        for e in audit:
            row = next(left) if e != "I" else None
            if e == "D":
                continue
            role = row[1] if e == "K" else "assistant" if state == "u" else "user"
            state = role[:1]
            lines.append(f"{role}:{row[2] if row else ''}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()) for r in df.collect()), key=repr)


def test_whole_query(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert rows_of(C.op13_structure_repair(spark, SF)) == plain(rows)


def test_odd_rows(spark):
    """Nulls in any column, empty and very long texts, gaps, repeated rows, other roles, a clashing extra column."""
    long = "word " * 200_000
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", None), (1, 2, "assistant", long), (2, None, None, "Hm."), (2, 5, "tool", "x"), (2, 9, "", "y."), (None, 1, "user", "Q?"), (None, 2, "assistant", "A."), (None, None, "user", " "), (3, 1, "User", "Hi!"), (4, 7, "assistant", "Yes. "), (4, 8, "assistant", "No.\x0b"), (5, None, "user", "a."), (6, 2, "sys", "s."), (6, 3, "user", "q?"), (6, 3, "user", "q?")]
    rows += [(7, k, "uxas"[k % 4], f"t{k}{'.' * (k % 3)}") for k in range(70)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, kind string")
    assert rows_of(C.repaired(C.damaged(df))) == plain(rows)
    lines = {r["conv_id"]: r for r in C.repaired(C.damaged(df), with_text=True).collect()}
    assert all(hashlib.sha256(r["repaired"].encode()).hexdigest() == r["repaired_sha256"] for r in lines.values())
    for r in lines.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in re.findall(r"(?m)^(\w+):", r["repaired"])))


def test_undamaged_rows_and_dropped_conversations(spark):
    good = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello.")]
    df = spark.createDataFrame(good, "conv_id long, turn long, role string, text string")
    r = C.repaired(C.as_given(df), with_text=True).collect()
    assert [(x["cost"], x["audit"], x["repaired"]) for x in r] == [(0, "KK", "user:Hi.\nassistant:Hello.")]
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    r = C.repaired(C.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], df.schema))).collect()
    assert [tuple(x) for x in r] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repaired(C.damaged(df)).count() == 0
