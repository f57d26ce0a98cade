import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from latticework.llm import langid, mixing, packing, quality_rules, quality_votes, simhash, tokens, toxicity
from latticework.llm.common import scratch_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_tokens_round_trip(spark, odd, none, reference_ids):
    path = scratch_path(spark, "t")
    tokens.write_tokens(odd, path)
    got = tokens.read_tokens(spark, path).orderBy("start").collect()
    assert Counter((r["doc_id"], tuple(r["tokens"])) for r in got) == Counter((r["doc_id"], (*reference_ids(r["text"]), 2)) for r in odd.collect())
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    assert {(r["doc_id"], r["ids_crc32"]) for r in tokens.id_checksums(tokens.read_tokens(spark, path)).collect()} == {(r["doc_id"], crc(r["tokens"])) for r in got}
    assert "tokens:array" not in str(tokens.read_tokens(spark, path, ("doc_id", "n_tokens"))._jdf.queryExecution().executedPlan().toString())
    empty = scratch_path(spark, "t")
    tokens.write_tokens(none, empty)
    assert tokens.read_tokens(spark, empty).count() == 0


def test_chunks_equal_whole_texts(reference_ids):
    texts = ["a  b", " a", "a ", "\n\na b\r\n c", "it's  they're 12 34abc", "a\u00a0 b \u3000c", "x <|endoftext|> y", "é ü ñ 日本 語", "a" * 5000 + " b", "\x1c a \x85 b", ""]
    e = tokens.ChunkEncoder(tokens.vocabulary(), limit=3)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [reference_ids(t) for t in texts]


def words(text):
    return WORD.findall(text or "")


def test_fingerprints_and_components(spark, odd, none):
    def fp(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.selectExpr("doc_id + 1000000 doc_id", "text").filter("doc_id is not null")).distinct()
    rows = {r["doc_id"]: fp(r["text"]) for r in docs.collect()}
    label = {i: i for i in rows}
    changed = True
    while changed:
        changed = False
        for a in rows:
            for b in rows:
                if (rows[a] ^ rows[b]).bit_count() <= 4 and label[a] > label[b]:
                    label[a], changed = label[b], True
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{rows[i]:016x}", label[i]) for i in rows}
    assert simhash.near_duplicates(odd).count() == odd.count() and simhash.near_duplicates(none).count() == 0


def test_tiles_join_all_near_pairs(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    chain = np.array([(1 << k) - 1 for k in range(0, 64, 4)], np.uint64)
    fps = np.unique(np.concatenate([base, near, chain]))
    label = np.arange(len(fps))
    x, y = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4)
    for _ in range(len(chain)):
        np.minimum.at(label, x, label[y])
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    for tile in (50_000, 3):
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, tile=tile)).collect()}
        groups = defaultdict(set)
        for v, k in zip(fps.view(np.int64).tolist(), label.tolist(), strict=True):
            groups[k].add(roots.get(v, v))
        assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_packing_is_exact_and_tight(spark, odd, none, reference_ids):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = packing.pack(docs).toPandas()
    want = Counter()
    for r in docs.collect():
        ids = [*reference_ids(r["text"]), 0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want.update((r["doc_id"], k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
    ids = [None if v != v else int(v) for v in got["doc_id"]]
    assert Counter(zip(ids, got["piece"], got["start"], got["length"], got["ids_crc32"], strict=True)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == np.cumsum([0, *g["length"]])[:-1].tolist() and g["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) * 1.03 + 1
    assert packing.pack(none).count() == 0


def test_plan_holds_the_histogram():
    rng = np.random.default_rng(0)
    for h in ({}, {2048: 3}, {1500: 10, 600: 10}, {1: 5000}, {1025: 7}, Counter(rng.integers(1, 2049, 20_000).tolist())):
        out, total = Counter(), 0
        for items, times in packing.plan(dict(h)):
            assert sum(items) <= 2048
            total += times
            for n in items:
                out[n] += times
        assert out == Counter(h)
        assert total <= 1.02 * sum(n * c for n, c in h.items()) / 2048 + 1 + sum(c for n, c in h.items() if 1024 < n < 2048) * (len(h) < 3)


def test_mix_meets_targets(spark, odd, none):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        rows = mixing.mix(docs).toPandas()
        again = mixing.mix(docs.repartition(3)).toPandas()
        key = ["doc_id", "size", "source", "taken"]
        assert sorted(map(repr, rows[key].values.tolist())) == sorted(map(repr, again[key].values.tolist())) and len(rows) == docs.count()
        sizes = Counter((r["doc_id"], len(words(r["text"]))) for r in docs.collect())
        assert Counter((None if v != v else int(v), s) for v, s in zip(rows["doc_id"], rows["size"], strict=True)) == sizes
        assert (rows["taken"] <= 3 * rows["size"]).all() and ((rows["taken"] == rows["size"] * rows["copies"])).all()
        g = rows.groupby("source", dropna=False).agg(size=("size", "sum"), most=("size", "max"), own=("source_size", "max"), target=("target", "max"), taken=("taken", "sum")).reset_index()
        assert (g["size"] == g["own"]).all() and ((g["taken"] - g["target"]).abs() <= g["most"] / 2 + 1e-6).all()
        names = sorted([s for s in g["source"] if s == s and s is not None]) + [s for s in g["source"] if s != s or s is None]
        weight = {repr(s): (5, 2, 1)[k % 3] for k, s in enumerate(names)}
        left, open_, target = float(rows["size"].sum()), list(g.itertuples()), {}
        while True:
            w = sum(weight[repr(r.source)] for r in open_)
            over = [r for r in open_ if left * weight[repr(r.source)] / w > 3 * r.size + 1e-9] if (r := None) is None and w else []
            if not over:
                target |= {repr(x.source): left * weight[repr(x.source)] / w for x in open_}
                break
            for x in over:
                target[repr(x.source)] = 3 * x[2]
            left -= sum(3 * x[2] for x in over)
            open_ = [x for x in open_ if x not in over]
        for r in g.itertuples():
            assert r.target == pytest.approx(target[repr(r.source)])
    assert mixing.mix(none).count() == 0


def test_mix_tree_of_many_blocks(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "repeat('w ', 1 + id % 7) text", "if(id % 3 = 0, 'hot', concat('s', id % 4)) source")
    g = mixing.mix(docs, block=8).toPandas().groupby("source").agg(target=("target", "max"), taken=("taken", "sum"), n=("size", "count"))
    assert g["n"].sum() == 3000 and ((g["taken"] - g["target"]).abs() <= 4).all()


def test_quality_rule_counts(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", "lang"))
    got = quality_rules.judge(docs).toPandas()
    want = Counter()
    for r in docs.collect():
        t, w = r["text"] or "", words(r["text"])
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k + i for k in range(len(w) - 2) if c[w[k], w[k + 1], w[k + 2]] > 1 for i in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        want[r["doc_id"], len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(cover), failed] += 1
    ids = [None if v != v else int(v) for v in got["doc_id"]]
    assert Counter(zip(ids, *[got[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], strict=True)) == want
    assert not (got["kept"] & got["base_failed"]).any() and got["kept"].mean() > 0.5
    assert quality_rules.judge(none).count() == 0


def held(spark, query, remainder, label, column, sf="/root/testdata/sf0.01"):
    rows = query(spark, sf).join(spark.read.parquet(f"{sf}/{label}.parquet").select("doc_id", column), "doc_id").filter("held_out")
    return rows.toPandas()


def test_languages(spark, odd, none):
    h = held(spark, langid.op2_language_codes, 5, "documents", "lang")
    assert (h["lang_pred"] == h["lang"]).mean() > 0.98 and h["score"].between(0, 1).all()
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = [r["lang_pred"] for r in langid.predict(odd, model).collect()]
    assert got[:3] == ["und"] * 3 and got[3] == "de" and got[8] == "und" and langid.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(none)).collect()} == {"und"}


def test_codewords_differ():
    for n in (1, 2, 4, 7, 12):
        c = langid.codewords(n)
        assert len(c) == n and len({tuple(r) for r in c}) == n


def test_quality_votes(spark, odd, none):
    h = held(spark, quality_votes.op6_quality_votes, 4, "labels", "quality")
    assert (h["predicted"] == h["quality"]).mean() > 0.95
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_votes.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    got = [r["score"] for r in quality_votes.score(odd, model).collect()]
    assert len(got) == odd.count() and got[0] == got[1] == pytest.approx(model.prior) and quality_votes.score(none, model).count() == 0
    assert quality_votes.fit(none, labels) is None and [r["score"] for r in quality_votes.score(odd, None).collect()] == [1.0] * odd.count()


def test_toxicity(spark, odd, none):
    h = held(spark, toxicity.op4_toxicity_grammar, 5, "labels", "toxic")
    assert (h["predicted"] == h["toxic"]).mean() > 0.93
    g = toxicity.fit(none, spark.read.parquet(f"{SF}/labels.parquet"))
    got = [r["score"] for r in toxicity.score(odd, g).collect()]
    assert got[0] == got[1] == got[2] < got[4] and toxicity.score(none, g).count() == 0


def test_grammar_composes():
    g = toxicity.Grammar()
    f = lambda t: dict(zip(toxicity.FEATURES, g.features(t), strict=True))
    assert f("you are an idiot")["aimed insult"] > 0 == f("what an idiot")["aimed insult"] and f("you are not an idiot")["negated"] > 0 == f("you are not an idiot")["insult"]
    assert f("he said: an idiot")["reported"] > 0 and f("i will kill you")["aimed threat"] > 0 and not any(f("a clean text. nothing here").values())


def test_quality_rules_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    plain = lambda f: sorted(map(repr, f[sorted(f.columns)].astype(object).values.tolist()))
    assert plain(quality_rules.op10_quality_rules(spark, SF).toPandas()) == plain(con.execute(quality_rules.ORACLE).df())
