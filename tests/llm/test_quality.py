import zlib

import numpy as np

from logkeep.llm import quality as Q
from logkeep.llm.queries import QUERIES
from tests.llm.conftest import save_tables


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op10_quality"](spark, folder).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.3)).all() and got.score.between(0, 1).all()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    both = got[got.held_out].merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    assert len(both) > 50 and (both.predicted == both.quality).mean() > 0.97


def test_labels_of_held_out_rows_do_not_matter(spark, sf_dir, all_docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    flipped = labels.withColumn("quality", Q.F.expr("if(pmod(crc32(cast(string(doc_id) as binary)), 5) = 0, 1 - quality, quality)"))
    one, two = Q.train(all_docs, labels), Q.train(all_docs, flipped)
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias


def test_risk_stays_unbiased_and_non_negative():
    rng = np.random.default_rng(1)
    p, n = rng.normal(2, 1, (4000, 2)), rng.normal(-2, 1, (1000, 2))
    scorer = Q.fit(p[:2000], np.concatenate([p[2000:], n]), 0.67)
    assert (scorer(p) >= 0.5).mean() > 0.97 and (scorer(n) < 0.5).mean() > 0.97


def test_odd_rows_and_empty_tables(spark, tmp_path, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (None, 1, 0), (6, 0, 0), (7, None, 0), (4, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    folder = save_tables(tmp_path / "a", documents=odd_docs, labels=labels)
    got = QUERIES["op10_quality"](spark, folder).toPandas()
    assert len(got) == odd_docs.count() and got.score.between(0, 1).all()
    assert not got.held_out[got.doc_id.isna()].any()
    assert got.score[got.doc_id == 5].nunique() == 1
    folder = save_tables(tmp_path / "b", documents=no_docs, labels=labels)
    assert QUERIES["op10_quality"](spark, folder).count() == 0
    folder = save_tables(tmp_path / "c", documents=odd_docs, labels=labels.where("false"))
    assert set(QUERIES["op10_quality"](spark, folder).toPandas().score) == {0.5}
    assert Q.keep_good(odd_docs, labels.where("false")).columns == odd_docs.columns
