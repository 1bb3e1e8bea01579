import itertools

from logkeep.llm import graydedup
from tests.llm.test_graydedup import brute_fingerprint


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_kept(docs):
    """Smallest id of each group, by comparing every two texts."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return sorted(i for i in sets if find(i) == i)


def test_one_of_each_group_stays(spark, all_docs):
    kept = graydedup.keep_one(all_docs, size=5, similarity=0.8)
    got = sorted(r.doc_id for r in kept.select("doc_id").collect())
    assert got == brute_kept([(r.doc_id, r.text) for r in all_docs.collect()])
    assert len(got) < graydedup.keep_one(all_docs).count()


def test_links_are_those_at_the_threshold(spark):
    words = [f"w{i}" for i in range(204)]
    texts = [words, words[:-20], words[:-50], [*words[:100], "x", *words[101:]], ["y"] * 3, ["Y"] * 3]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert (brute_fingerprint(docs[0][1]) ^ brute_fingerprint(docs[1][1])).bit_count() > 3
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(r.doc_id for r in graydedup.keep_one(df, size=5, similarity=0.8).collect())
    assert got == brute_kept(docs)
