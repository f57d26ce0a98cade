import itertools

import numpy as np
import pytest

from latticework.llm import neighbours, url_rules

SF = "/root/testdata/sf0.01"


def test_recall_and_scores(spark):
    got = neighbours.op5_probed_neighbours(spark, SF).toPandas()
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, ids = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy()
    hit = total = 0
    for q, v in zip(ids, x, strict=True):
        if q % 100 == 0:
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            near = [ids[k] for k in np.lexsort((ids, d)) if ids[k] != q][:10]
            own = got[got["query_id"] == q].sort_values("rank")
            assert own["rank"].tolist() == list(range(1, len(own) + 1)) and own["score"].is_monotonic_increasing
            assert np.allclose(own["score"], [d[list(ids).index(k)] for k in own["vec_id"]], atol=1e-12)
            hit, total = hit + len(set(near) & set(own["vec_id"])), total + len(near)
    assert hit / total >= 0.9


def test_only_candidates_are_measured():
    """A chunk's distances are taken for the rows that the wanted buckets hold, and for no other."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8))
    lsh = neighbours.PStable(8, 2.0, 3, 4)
    part = neighbours.Chunk(pa.table({"v": pa.array(x.tolist()), "ids": pa.array([[k] for k in range(500)])}), lsh)
    slots, places = lsh.slots(x[:20])
    for i in range(20):
        wanted = np.stack([lsh.keys(s + np.stack(lsh.probes(p, 9))) for s, p in zip(slots[i], places[i], strict=True)])
        rows = np.flatnonzero(part.candidates(wanted))
        held = {k for t in range(3) for k in np.flatnonzero(np.isin(lsh.keys(lsh.slots(x)[0])[:, t], wanted[t]))}
        assert set(rows) == held and 0 < len(rows) < 500
        part.x = np.full_like(x, np.nan)
        part.x[rows] = x[rows]
        d = np.sqrt(((x[rows] - x[i]) ** 2).sum(axis=1))
        assert part.nearest(x[i], rows, 5) == sorted(zip(d.tolist(), rows.tolist(), strict=True))[:5]
        part.x = x


def test_odd_vectors(spark):
    rows = [(100 * k, [1.0, 0.0, float(k)], 1) for k in range(3)] + [(k, [1.0, 0.0, 0.0], 1) for k in range(1, 40)] + [(500, None, 1), (501, [0.0] * 3, 1), (502, [1.0, None, 2.0], 1), (503, [float("nan"), 1.0, 2.0], 1), (504, [1.0, float("inf"), 2.0], 1), (None, [1.0, 0.0, 0.0], 1), (505, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int")
    got = neighbours.search(df).toPandas()
    first = got[got["query_id"] == 0].sort_values("rank")
    assert first["vec_id"].tolist() == list(range(1, 11)) and (first["score"] == 0).all() and not set(got["vec_id"]) & set(range(500, 506))
    assert neighbours.search(df.filter("vec_id > 499")).count() == 0 and neighbours.search(df.limit(0)).count() == 0


def test_probes_come_in_order():
    lsh = neighbours.PStable(8, 1.0, 1, 5)
    place = np.array([0.1, 0.5, 0.8, 0.3, 0.95])
    out = lsh.probes(place, 60)
    cost = [sum((p if s < 0 else 1 - p) ** 2 for p, s in zip(place, shift, strict=True) if s) for shift in out]
    assert cost == pytest.approx(sorted(cost)) and len({tuple(s) for s in out}) == len(out) and not out[0].any()


def test_urls(spark):
    urls = ["https://A.Example.NET/en/x?q#f", "http://example.net/de/", "https://notnet", "https://x.org/fr/1", "https://x.org/fr", "x", None, "", "://", "a://b://c/d", "https://sub.example.com/de/#", "https://example.com#a/de/", "https://NET", "ftp://net/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 host", "2 items", "3 rule")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_rules.judge(df).collect()}
    want = {0: ("a.example.net", "/en/x", "example.net/en/"), 1: ("example.net", "/de/", "net/"), 2: ("notnet", "", None), 3: ("x.org", "/fr/1", "org/fr/"), 4: ("x.org", "/fr", None), 5: ("", "", None), 6: ("", "", None), 7: ("", "", None), 8: ("", "", None), 9: ("b:", "//c/d", None), 10: ("sub.example.com", "/de/", "example.com/de/"), 11: ("example.com", "", None), 12: ("net", "", None), 13: ("net", "/", "net/")}
    assert got == want
    assert url_rules.judge(df.limit(0)).count() == 0


def test_mined_rules_judge_the_rest(spark):
    got = url_rules.op7_url_rules(spark, SF).toPandas()
    assert got["verdict"].isin(["allow", "block"]).all() and (got[got["rule"] == "net/"]["verdict"] == "block").all()
    rest = got[got["rule"].isna()]
    assert 0 < (rest["verdict"] == "block").mean() < 0.6


def test_mine_prunes(spark):
    rows = [(["a", "b"], "block")] * 8 + [(["a"], "allow")] * 2 + [(["c"], "allow")] * 10
    rules = url_rules.mine(spark.createDataFrame(rows, "items array<string>, label string"), 0.1, 0.7)
    assert {(tuple(sorted(r[0])), r[1]) for r in rules} == {(("a",), "block"), (("b",), "block"), (("c",), "allow")}


def test_recall_of_more_vectors(spark):
    sf = "/root/testdata/sf0.1"
    got = neighbours.op5_probed_neighbours(spark, sf).toPandas()
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy()
    hit = total = 0
    for q, v in zip(ids, x, strict=True):
        if q % 100 == 0:
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            near = [ids[k] for k in np.lexsort((ids, d)) if ids[k] != q][:10]
            hit, total = hit + len(set(near) & set(got[got["query_id"] == q]["vec_id"])), total + 10
    assert total and hit / total >= 0.9


def test_every_url_is_judged_as_by_every_rule(spark):
    """The inverted index against each rule in turn, on whole urls with deep paths, long hosts and queries."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    deep = [(10_000 + k, f"http://a.b.c.d.e.{h}/x/y/z/{w}/1?{q}=1&z#f") for k, (h, w, q) in enumerate((h, w, q) for h in ("net", "io") for w in ("ads", "news") for q in ("ref", "id") for _ in range(9))]
    pages = pages.unionByName(spark.createDataFrame(deep, "page_id long, url string"))
    host, path = url_rules.url_parts(url_rules.F.col("url"))
    df = url_rules.fixed_rules(pages.select("page_id", "url", host.alias("host"), path.alias("path")))
    rows = df.withColumn("items", url_rules.tokens(url_rules.F.col("url"), url_rules.F.col("host"), url_rules.F.col("path"))).collect()
    items = {r["page_id"]: set(r["items"]) for r in rows}
    assert {"path:ads", "path:x", "first:x", "host:net", "host:a.b.c.d.e.net", "label:a", "query:ref", "query:z"} <= items[10_000]
    labelled = [(items[r["page_id"]], r["rule_verdict"]) for r in rows if r["rule"]]
    mined = url_rules.mine(spark.createDataFrame([(sorted(i), v) for i, v in labelled], "items array<string>, label string"))
    assert mined
    for found, verdict, confidence, support in mined:
        own = [v for i, v in labelled if found <= i]
        assert confidence == pytest.approx(own.count(verdict) / len(own)) and support == pytest.approx(own.count(verdict) / len(labelled)) and confidence >= 0.6
    mined.sort(key=lambda r: (-r[2], -r[3], -len(r[0]), sorted(r[0])))
    want = {r["page_id"]: r["rule_verdict"] or next((v for f, v, _, _ in mined if f <= items[r["page_id"]]), "allow") for r in rows}
    assert {r["page_id"]: r["verdict"] for r in url_rules.judge(pages).collect()} == want


def test_items_of_the_same_rows_make_no_sets(spark):
    rows = [([f"i{k}" for k in range(40)] + [f"own{n % 2}"], "block" if n % 5 else "allow") for n in range(50)]
    rules = url_rules.mine(spark.createDataFrame(rows, "items array<string>, label string"), 0.1, 0.7)
    assert any(r[:2] == (frozenset(["i0"]), "block") and r[2:] == pytest.approx((0.8, 0.8)) for r in rules) and all(len(r[0]) < 3 for r in rules)


def test_a_rule_of_two_items_decides(spark):
    """Either path part alone speaks for allow, both together for block."""
    urls = [f"http://h{k}.net/z{k}/one/two" for k in range(10)] + [f"http://h{k}.org/fr/{w}" for k in range(20) for w in ("one", "two")] + ["http://x.io/q/one/two", "http://x.io/q/one", "http://x.io/q/two"]
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[k] for k in (50, 51, 52)] == ["block", "allow", "allow"]


@pytest.mark.parametrize("widest", [18, 1])
def test_rules_are_those_of_all_sets(spark, widest):
    """FP-growth and pruning against all item sets up to three, with items mined together or the sure ones apart."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(120):
        items = [w for w, p in zip("abcdef", (0.5, 0.4, 0.6, 0.3, 0.2, 0.3), strict=True) if rng.random() < p]
        rows.append((items, "block" if "e" in items or {"a", "b"} <= set(items) and rng.random() < 0.9 else "allow"))
    want = {}
    for size in (1, 2, 3):
        for own in itertools.combinations("abcdef", size):
            verdicts = [v for i, v in rows if set(own) <= set(i)]
            for v in ("allow", "block"):
                hits = verdicts.count(v)
                c = hits / max(1, len(verdicts))
                if hits >= 0.05 * len(rows) and c >= 0.6 and not any(set(part) < set(own) and w == v and d >= c for (part, w), (d, _) in want.items()):
                    want[own, v] = (c, hits / len(rows))
    got = url_rules.mine(spark.createDataFrame(rows, "items array<string>, label string"), 0.05, 0.6, widest=widest)
    assert {(tuple(sorted(i)), v): (round(c, 9), round(s, 9)) for i, v, c, s in got} == {k: (round(c, 9), round(s, 9)) for k, (c, s) in want.items()}
    assert any(len(i) == 2 for i, _, _, _ in got)
