import random

import corpus_pipeline as c

SF = "/root/testdata/sf0.001"


def near_copies(similarity, n, words=50):
    """Pairs of texts, the second with end words changed so that the five-word shingles have about this similarity or a little more."""
    rng, out = random.Random(words * 100 + int(similarity * 100)), []
    shingles = words - 4
    changed = int(shingles * (1 - similarity) / (1 + similarity))
    for _ in range(n):
        a = [f"w{rng.randrange(10**9)}" for _ in range(words)]
        out.append((" ".join(a), " ".join(a[: words - changed] + [f"v{rng.randrange(10**9)}" for _ in range(changed)])))
    return out


def kept(spark, texts):
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return {r["doc_id"] for r in c.drop_near_duplicates(spark, docs, SF).collect()}


def test_near_copies_at_four_fifths_go(spark):
    texts = [t for s in (0.8, 0.85, 0.9, 0.95) for words in (50, 300) for pair in near_copies(s, 15, words) for t in pair]
    left = kept(spark, texts)
    assert left >= set(range(0, len(texts), 2)) and len(left) <= len(texts) / 2 * 1.02


def test_less_similar_texts_stay(spark):
    texts = [t for words in (50, 300) for pair in near_copies(0.7, 15, words) for t in pair]
    assert kept(spark, texts) == set(range(len(texts)))


def test_groups_against_brute_force(spark):
    """Groups lie between those of similarities a deviation above and below what sketches are asked for."""
    from latticework.llm import simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r["doc_id"]: set(simhash.shingle_hashes(r["text"], 5).tolist()) for r in docs.collect()}

    def firsts(least):
        root = {k: k for k in sets}

        def find(k):
            return k if root[k] == k else find(root[k])

        for a in sets:
            for b in sets:
                if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])):
                    root[max(find(a), find(b))] = min(find(a), find(b))
        return {find(k) for k in sets}

    got = {r["doc_id"] for r in c.drop_near_duplicates(spark, docs, SF).collect()}
    assert firsts(0.74) <= got <= firsts(0.8)
