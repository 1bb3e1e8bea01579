import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from logkeep.llm import merkle as M
from logkeep.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import save_tables
from tests.llm.test_graydedup import rows
from workload.compare import differences, duck

NAME = "op13_merkle_manifest"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
UPPER = {c: c + 32 for c in range(65, 91)}


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def up(nodes):
    """All levels above some hashes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 8 * 8
        out.append((level[a:i], level[i + 1 : a + 8]))
        i //= 8
    return out


def brute(docs):
    groups = {}
    for doc_id, text, lang, source, n_chars in docs:
        tampered = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            tampered = text.translate(UPPER)
        leaf, other = (h(*map(field, (doc_id, source, lang, n_chars, t))) for t in (text, tampered))
        groups.setdefault(lang, []).append(((doc_id is not None, doc_id or 0), leaf, other, doc_id))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: up([leaf for _, leaf, _, _ in sorted(groups[g])]) for g in names}
    upper = up([trees[g][-1][0] for g in names])
    out = []
    for n, g in enumerate(names):
        for i, (_, leaf, other, doc_id) in enumerate(sorted(groups[g])):
            path, own = siblings(trees[g], i) + siblings(upper, n), other
            for left, right in path:
                own = h(*left, own, *right)
            proof = h(*(x for step in path for side in step for x in side))
            root = upper[-1][0]
            out.append((doc_id, leaf, trees[g][-1][0], root, proof, own, own == root))
    return sorted(out, key=str)


def run(spark, folder, docs):
    folder = save_tables(folder, documents=spark.createDataFrame(docs, SCHEMA))
    return rows(QUERIES[NAME](spark, folder))


def test_whole_table(spark, sf_dir, all_docs):
    got = QUERIES[NAME](spark, sf_dir)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = brute([tuple(r) for r in all_docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    assert rows(got) == want and {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_sql_twin(spark, folder):
    folder = f"/root/testdata/{folder}"
    found, _ = differences(spark, folder, QUERIES[NAME], ORACLES[NAME], duck(folder))
    assert found == ""


def test_sizes_around_blocks_and_many_groups(spark, tmp_path):
    rng = random.Random(5)
    sizes = {None: 1, "": 2, "a": 8, "b": 9, "c": 64, "d": 65, "e": 511, "f": 512, "g": 513, "h": 4097, "é": 7}
    docs, ids = [], iter(rng.sample(range(-(10**6), 10**6), sum(sizes.values())))
    for lang, size in sizes.items():
        docs += [(next(ids), rng.choice(["Ab", "x", None, ""]), lang, "s", 1) for _ in range(size)]
    rng.shuffle(docs)
    assert run(spark, tmp_path, docs) == brute(docs)


def test_ids_far_apart(spark, tmp_path):
    rng = random.Random(6)
    ends = [-(1 << 63), (1 << 63) - 1, -1, 0, 63, 64, -64, -65, 1 << 21, -(1 << 21), 1 << 36, 1 << 51]
    docs = [(i, "T", "x", None, None) for i in ends] + [
        (rng.randrange(-(1 << 63), 1 << 63), "u", "x", None, None) for _ in range(300)]
    assert run(spark, tmp_path, docs) == brute(docs)


ODD = [
    (None, "A", None, None, None), (None, "A", None, None, None), (None, "B", "x", "s", 1), (1, None, "x", "s", None),
    (2, "", None, "", 0), (3, "Long Text " * 30_000, "x", "s", 5), (5, "Same", "x", "s", 4), (5, "Same", "x", "s", 4),
    (5, "Other", "x", "s", 4), (5, "Same", "y", "s", 4), (-7, "Ünï Ï", "", "s", 4), (6, "SIX", "x", "s", 3),
    (7, "SEVEN", "x", "s", 3), (8, "EIGHT", "x", "s", 3), *[(9, "Copy", "x", "s", 4)] * 20,
]


def test_odd_and_repeated_rows(spark, tmp_path):
    assert run(spark, tmp_path, ODD) == brute(ODD)


def test_clashing_columns(spark, tmp_path):
    docs = spark.createDataFrame(ODD, SCHEMA)
    names = "leaf word low pos bits n before block slot nodes depth row other _group _base".split()
    wide = docs.select("*", *[F.lit("x").alias(n) for n in names])
    folder = save_tables(tmp_path, documents=wide)
    assert rows(QUERIES[NAME](spark, folder)) == brute(ODD)


def test_one_row_and_empty_table(spark, tmp_path):
    one = [(4, "Text", None, None, 4)]
    assert run(spark, tmp_path / "a", one) == brute(one)
    assert run(spark, tmp_path / "b", []) == []


def test_manifest_names_subroots_and_checks_groups(spark, all_docs):
    rows_of = M.leaves(all_docs)
    made = M.build(rows_of)
    want = {lang: n for lang, n in all_docs.groupBy("lang").count().collect()}
    assert {lang: n for lang, n, _ in made.subroots()} == want
    assert all(r.verified for r in M.proofs(made, spark).collect())
    with pytest.raises(ValueError):
        M.build(rows_of, groups=len(want) - 1)
