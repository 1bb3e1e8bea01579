import random

import numpy as np
import pyspark.sql.functions as F
import xxhash

from logkeep.llm import graydedup as G
from logkeep.llm.components import components
from logkeep.llm.queries import QUERIES
from tests.llm.conftest import save_tables


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    pieces = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(docs):
    codes = [brute_fingerprint(t) for _, t in docs]
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    distinct = sorted(root)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for (doc_id, _), c in zip(docs, codes):
        if doc_id is not None:
            least[find(c)] = min(doc_id, least.get(find(c), doc_id))
    return sorted(((d, f"{c:016x}", least.get(find(c))) for (d, _), c in zip(docs, codes)), key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def near_codes(seed, groups=30):
    rng = random.Random(seed)
    codes = set()
    for _ in range(groups):
        code = rng.getrandbits(64)
        for _ in range(rng.randrange(8)):
            codes.add(code)
            for _ in range(rng.randrange(5)):
                code ^= 1 << rng.randrange(64)
    return sorted(codes)


def test_tree_finds_every_near_pair():
    for seed in range(10):
        codes = np.array(near_codes(seed), np.uint64)
        codes = codes[np.argsort(G.gray_rank(codes))]
        query, found = G.GrayTree(codes).near(0, len(codes))
        far = np.bitwise_count(codes[:, None] ^ codes[None, :])
        want = {(i, j) for i in range(len(codes)) for j in range(i) if far[i, j] <= 3}
        assert set(zip(query.tolist(), found.tolist())) == want
        assert len(query) == len(want)


def test_hot_nodes_are_cut_without_losing_links(spark):
    codes = np.array(near_codes(5, 25), np.uint64)
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code long")
    for node_rows in (6, 10**6):
        edges = G.near_edges(df, node_rows=node_rows)
        roots = {r.node: r.root for r in components(edges).collect()}
        a, b = G.node_edges(codes)
        want = G.forest(len(codes), [(np.searchsorted(codes, a), np.searchsorted(codes, b))])
        got = [roots.get(int(c), int(c)) for c in codes.view(np.int64)]
        assert len(set(got)) == len(set(want.tolist()))
        assert len(set(zip(got, want.tolist()))) == len(set(got))


def test_components_of_chains_stars_and_nulls(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)]
    edges += [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == ({i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}
                   | {200: 200, 201: 200})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_table(spark, sf_dir, all_docs):
    want = brute_groups([(r.doc_id, r.text) for r in all_docs.collect()])
    assert rows(QUERIES["op2_simhash_groups"](spark, sf_dir)) == want


def test_odd_rows_and_empty_table(spark, tmp_path, odd_docs, no_docs):
    folder = save_tables(tmp_path / "a", documents=odd_docs)
    want = brute_groups([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert rows(QUERIES["op2_simhash_groups"](spark, folder)) == want
    folder = save_tables(tmp_path / "b", documents=no_docs)
    assert QUERIES["op2_simhash_groups"](spark, folder).count() == 0


def test_shingles_agree_with_spark_hash(spark):
    df = spark.createDataFrame([("ab cd ef",)], "t string").select(F.xxhash64("t").alias("h"))
    assert df.first().h == int(G.hash64([b"ab cd ef"]).view(np.int64)[0])


def test_a_radius_that_does_not_divide_the_bits(spark):
    far = [0x0123456789ABCDEF, 0x0123456789ABCDEF ^ 0x0101010101010101]
    df = spark.createDataFrame([(c,) for c in far], "code long")
    assert {tuple(sorted(r)) for r in G.near_edges(df, radius=8).collect()} == {tuple(sorted(far))}
    assert G.near_edges(df, radius=7).count() == 0
    for n in range(9, 65):
        sizes = [len(p) for p in G.deal.__globals__["parts_of"](list(range(n)), 9)]
        assert len(sizes) == 9 and sum(sizes) == n and max(sizes) - min(sizes) <= 1
