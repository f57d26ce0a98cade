"""Line dedup against a plain count of all lines, and the levels of runs."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from latticework.llm import line_runs as L

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(rows, least, enough):
    held = Counter(k for _, text in rows for k in {key_of(x) for x in (text or "").split("\n")})
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if not (len(key_of(x)) >= least and held[key_of(x)] >= enough)]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in df.collect()), key=repr)


def test_whole_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], 1, 10)
    assert rows_of(L.op11_line_runs(spark, SF)) == want
    assert any(w[2] for w in want)


@pytest.mark.parametrize("held", [1000, 0])
@pytest.mark.parametrize("least", [1, 4])
def test_both_ways_of_dropping(spark, odd, held, least):
    """Odd rows, with frequent keys broadcast and, beyond the bound, joined."""
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = L.drop_frequent_lines(odd, least, 2, 3, held=held)
    assert rows_of(got) == plain(rows, least, 2)
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in got.collect())


def test_empty_table(spark, none):
    assert L.drop_frequent_lines(none).count() == 0


def test_keys():
    assert L.line_key(" \t\x0b Ää B\r".encode()) == "Ää b".encode()
    assert not L.long_enough("ää".encode(), 3) and L.long_enough("äää".encode(), 3) and not L.long_enough(b"", 1)
    a = {L.key_hash(str(k).encode()) for k in range(2000)}
    assert len(a) == 2000 and all(-(2**63) <= x < 2**63 for h in a for x in h)


def test_levels_sum_and_settle(spark):
    """Counts after many batches equal plain sums up to settling; levels hold fewer runs than the fanout; no join or sum of runs shuffles."""
    rng = random.Random(3)
    runs, seen = L.LineRuns(spark, enough=5, buckets=3, fanout=3), Counter()
    for k in range(11):
        batch = Counter(int(rng.paretovariate(0.6)) % 60 for _ in range(40))
        settled_before = {x for x, n in seen.items() if n >= 5}
        seen.update(batch)
        df = spark.createDataFrame([(x, -x, n) for x, n in batch.items()], "a long, b long, n long")
        runs.add(df.repartition(3, "a", "b"))
        assert all(len(level) < 3 for level in runs.levels)
        names = [x for level in runs.levels for x in level]
        kept = {(r["a"], r["b"]): r["n"] for r in runs.summed(names).collect()}
        assert {a for (a, b), n in kept.items() if n >= 5} == {x for x, n in seen.items() if n >= 5}
        assert all(kept[x, -x] == seen[x] for x in seen if x not in settled_before and seen[x] < 5)
    assert [len(level) for level in runs.levels] == [2, 0, 1]  # 11 in base 3, lowest first
    names = [x for level in runs.levels for x in level]
    plan = runs.summed(names)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    one, two = (spark.table(x) for x in names[:2])
    plan = one.hint("merge").join(two.hint("merge"), L.KEY, "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.clear()
    assert not runs.paths and not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_frequent_set_is_what_enough_rows_hold(spark):
    text = ["x\nX \ny", "x", " x\nz", "y\ny\ny", None, ""]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(text)], "doc_id long, text string")
    got = {(r["a"], r["b"]) for r in L.frequent_lines(docs, 1, 3, 4).collect()}
    assert got == {L.key_hash(b"x")}
    assert np.int64(next(iter(got))[0]) == next(iter(got))[0]
