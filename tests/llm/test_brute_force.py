"""Learned operators against plain versions of their decisions, odd shapes of graphs, and limits of time and memory."""

import itertools
import math
import random
import time

import numpy as np
import pytest

from latticework.llm import common, langid, quality_votes, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_languages_are_the_nearest_codewords(spark, docs):
    m = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, m).collect()}
    for r in docs.limit(60).collect():
        text, mine = r["text"] or "", got[r["doc_id"]]
        if not any(map(str.isalpha, text)):
            assert (mine["lang_pred"], mine["score"], mine["ambiguous"]) == (langid.UNKNOWN, 0.0, True)
            continue
        raw = f" {text.lower()} ".encode()
        grams = [((a * 0x9E3779B1 % 2**32 ^ b * 0x85EBCA6B % 2**32 ^ c * 0xC2B2AE35 % 2**32) >> 7) % langid.BUCKETS for a, b, c in zip(raw, raw[1:], raw[2:], strict=False)]
        margins = [sum(float(m.weights[g, k]) for g in grams) / len(grams) * min(len(grams), 64) / 4 for k in range(m.codes.shape[1])]
        loss = {x: sum(w * math.log1p(math.exp(-bit * y)) for w, bit, y in zip(m.bit_weights, code, margins, strict=True)) for x, code in zip(m.languages, m.codes, strict=True)}
        chances = sorted(((math.exp(-v) / sum(math.exp(-u) for u in loss.values()), x) for x, v in loss.items()), reverse=True)
        assert mine["lang_pred"] == min(loss, key=loss.get) and mine["score"] == pytest.approx(chances[0][0], rel=1e-4) and mine["ambiguous"] == (chances[0][0] - chances[1][0] < 0.2)


def test_bits_are_weighed_on_rows_they_did_not_learn_from(docs):
    w = langid.fit(docs).bit_weights
    assert (w > 0).all() and w.mean() == pytest.approx(1.0)


def test_quality_is_the_vote_of_all_cosines(spark, docs):
    m = quality_votes.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.limit(50).collect()
    got = m.score([r["text"] or "" for r in rows])
    for r, mine in zip(rows, got, strict=True):
        x = quality_votes.terms(r["text"] or "") * m.weight
        x = (x / max(1e-9, np.linalg.norm(x))) @ m.axes
        x = x / max(1e-9, np.linalg.norm(x))
        near = sorted(((-round(float(sum(a * b for a, b in zip(x, v, strict=True))), 5), k) for k, v in enumerate(m.voters)))[: quality_votes.NEIGHBOURS]
        power = [max(1e-6, -s) ** 8 for s, _ in near]
        assert mine == pytest.approx(sum(p * m.labels[k] for p, (_, k) in zip(power, near, strict=True)) / sum(power), abs=0.02)
    assert len({*m.score(["one two three"] * 5).tolist()}) == 1


def test_blank_and_orthogonal_texts_have_scores(spark, docs):
    """White space holds no term; a text at right angles to all voters, or opposite to them, has the votes of the first."""
    m = quality_votes.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert m.score([" ", "\n", "\t", ""]).tolist() == pytest.approx([m.prior] * 4)
    own = [(" ", 1), ("\n", 2), ("a b c", 3), (None, 4)]
    got = [r["score"] for r in quality_votes.score(spark.createDataFrame(own, "text string, doc_id long"), m).collect()]
    assert len(got) == 4 and all(0 <= x <= 1 for x in got)
    k = quality_votes.NEIGHBOURS
    for voters in (np.eye(len(m.voters), m.voters.shape[1], -1, np.float32) * 0, -np.abs(m.voters)):
        m.voters, m.axes = voters.astype(np.float32), np.abs(m.axes)
        got = m.score(["plain words here", "and others there"])
        assert np.isfinite(got).all() and ((got >= 0) & (got <= 1)).all()
    m.voters[:] = 0
    assert m.score(["plain words here"])[0] == pytest.approx(m.labels[:k].mean(), abs=1e-6)


def test_equal_voters_vote_in_order():
    near = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.2, 0.2, 0.2, 0.2, 0.2]])
    assert quality_votes.nearest(near, 3).tolist() == [[True, True, True, False, False], [True, True, True, False, False]]


def test_words_count_among_the_terms():
    a, b = (quality_votes.terms(x) for x in ("ab cd", "cd ab"))
    assert (a[quality_votes.PAIRS :] == b[quality_votes.PAIRS :]).all() and (quality_votes.terms("xy")[quality_votes.PAIRS :] > 0).sum() >= 1


def test_composed_machine_accepts_one_path_as_brute_force():
    g, rng = toxicity.Grammar({"swine": 1.5}), random.Random(1)
    words = ["idiot", "swine", "kill", "you", "not", "said", "house", "never", "they"]
    single = [toxicity.lexicon(g.words), toxicity.negation(), toxicity.reported_speech(), toxicity.target()]
    for n in (0, 1, 2, 3, 5, 7):
        for clause in itertools.islice((tuple(rng.choice(words) for _ in range(n)) for _ in range(60)), 60):
            paths = g.machine.paths(clause)
            assert len(paths) == 1
            want = dict.fromkeys(toxicity.PATTERNS, 0.0)
            for out, w in paths[0]:
                if out is not toxicity.ANY:
                    want[out] += w
            assert g.clause(list(clause)).tolist() == pytest.approx(list(want.values()))
            said, weights = [(x, 0.0) for x in clause], None
            for t in single:  # one transducer after the other
                runs = t.paths([x for x, _ in said])
                assert len(runs) == 1
                said = [(out, w + v) for (out, v), (_, w) in zip(runs[0], said, strict=True)]
            weights = {p: sum(w for x, w in said if x == p) for p in toxicity.PATTERNS}
            assert weights == pytest.approx(want)


def test_learned_words_weigh_by_their_odds():
    g = toxicity.Grammar({"swine": 2.0})
    assert g.features("a swine")[0] > g.features("an idiot")[0] > 0


def test_ten_megabytes_without_a_mark_take_seconds():
    g, line = toxicity.Grammar(), "and so the idiot went on " * 400_000
    began = time.process_time()
    assert g.features(line)[0] > 10 and time.process_time() - began < 60


def test_long_chains_and_hubs_join(spark):
    chain = [(k, k + 1) for k in range(300)]
    hub = [(1000, 1001 + k) for k in range(500)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain + hub + [(5000, 5000)], "a long, b long")).collect()}
    assert got == {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1501)}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_large_group_is_confirmed_by_few_pairs(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**9)}" for _ in range(200)]
    near = [" ".join([*base[:k], "new", *base[k + 1 :]]) for k in range(0, 200, 2)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*near, *near[:3], "", None, "  "])], "key long, text string")
    rows = {r["key"]: r["component"] for r in simhash.similar_documents(docs).collect()}
    assert len({rows[k] for k in range(103)}) == 1 and rows[103] == rows[104] == rows[105] != rows[0]


def test_scratch(spark, monkeypatch):
    path = common.scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    common.discard(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path)

    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.scratch_path(Cluster, "x")
