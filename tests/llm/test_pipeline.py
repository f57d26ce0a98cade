"""Each stage on what the one before kept, against a plain version of its decision."""

from collections import Counter

import corpus_pipeline as c
from latticework.llm import langid, mixing, quality_votes, simhash
from latticework.llm.common import id_remainder, materialize

SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(map(tuple, df.select(*c.COLUMNS).collect()))


def test_stages_decide_on_all_they_get(spark):
    docs, sizes = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(c.STAGES):
        before, docs = docs, materialize(stage(spark, docs, SF), f"s{k}")
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == list(c.COLUMNS)
        if k == 0:
            m = langid.fit(before.filter(id_remainder("doc_id", 5) != 0))
            want = Counter()
            for r in before.collect():
                if any(map(str.isalpha, r["text"] or "")):
                    p = m.decode(m.margins(r["text"]))
                    top = sorted(p)[::-1]
                    if top[0] - top[1] >= 0.2:
                        want[r["doc_id"], r["text"], m.languages[int(p.argmax())], r["source"], r["n_chars"]] += 1
            assert rows(docs) == want
        if k == 1:
            m = quality_votes.fit(before, spark.read.parquet(f"{SF}/labels.parquet").filter(id_remainder("doc_id", 4) != 2))
            assert rows(docs) == Counter(tuple(r) for r in before.collect() if m.score([r["text"]])[0] >= quality_votes.THRESHOLD)
        if k == 2:
            sets = {r["doc_id"]: set(simhash.shingle_hashes(r["text"], 5).tolist()) for r in before.collect()}

            def firsts(least):
                root = {x: x for x in sets}

                def find(x):
                    return x if root[x] == x else find(root[x])

                for a in sets:
                    for b in sets:
                        if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                            root[max(find(a), find(b))] = min(find(a), find(b))
                return Counter(tuple(r) for r in before.collect() if find(r["doc_id"]) == r["doc_id"])

            assert firsts(0.74) <= rows(docs) <= firsts(0.8)
        if k == 3:
            copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before.withColumn("doc_id", c.row_hash())).collect()}
            keyed = before.select(*c.COLUMNS, c.row_hash().alias("key")).collect()
            assert rows(docs) == Counter({tuple(r)[:-1]: copies[r["key"]] for r in keyed if copies[r["key"]]})
        if k == 4:
            assert Counter(r["doc_id"] for r in docs.filter("piece = 0").collect()) == Counter(r["doc_id"] for r in before.collect())
            for _, g in docs.toPandas().sort_values("offset").groupby("sequence_id"):
                assert g["offset"].tolist() == g["length"].cumsum().shift(fill_value=0).tolist() and g["length"].sum() <= 2048
    assert sizes[0] >= 190 and sizes[1] >= 150


def test_odd_rows(spark, odd, none):
    """Nulls, empty and very long texts, copies, repeated rows and shared ids: what each stage keeps comes from what it got."""
    docs = odd
    for k, (_, stage) in enumerate(c.STAGES):
        before, docs = docs, materialize(stage(spark, docs, SF), f"o{k}")
        if k < 4:
            assert {r["text"] for r in docs.collect()} <= {r["text"] for r in before.collect()}
        if k == 0:
            assert not {None, "", " \n\t ", "12345 !!!"} & {r["text"] for r in docs.collect()}
    assert c.drop_near_duplicates(spark, odd, SF).groupBy("text").count().agg({"count": "max"}).first()[0] == 1
    assert {r["text"] for r in c.pack_sequences(spark, odd, SF).withColumnRenamed("ids_crc32", "text").collect()} and c.pack_sequences(spark, odd, SF).filter("piece = 0").count() == odd.count()
    docs = none
    for k, (_, stage) in enumerate(c.STAGES):
        docs = materialize(stage(spark, docs, SF), f"n{k}")
        assert docs.count() == 0
