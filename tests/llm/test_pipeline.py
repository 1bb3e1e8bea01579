import corpus_pipeline
from logkeep.llm import pii, quality
from tests.llm import test_decontamination, test_graydedup
from tests.llm.conftest import ROWS
from tests.llm.test_bpe import LIBRARY, library_ids


def test_run_against_brute_force(spark, sf_dir, all_docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    scorer = quality.train(all_docs, labels)
    docs = {r.doc_id: r for r in all_docs.collect()}
    kept = [i for i in docs if scorer(quality.features(docs[i].text.encode())[None])[0] >= 0.3]
    groups = test_graydedup.brute_groups([(i, docs[i].text) for i in kept])
    kept = sorted(i for i, _, root in groups if i == root)
    bad = {r[0] for r in test_decontamination.brute([(i, docs[i].text) for i in kept], items) if r[5]}
    want = []
    for i in sorted(set(kept) - bad):
        text = pii.mask(docs[i].text, sum(pii.find_spans(docs[i].text), []))
        ids = library_ids(text)
        want.append((i, docs[i].lang, docs[i].source, text, ids, len(ids),
                     LIBRARY.decode(ids, skip_special_tokens=False)))
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
    assert got == want and bad and len(want) < len(docs)


def test_stages_keep_the_columns(spark, sf_dir, all_docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, all_docs, sf_dir).schema.names == all_docs.columns
        assert stage(spark, all_docs.where("false"), sf_dir).count() == 0


def test_odd_rows_go_through_every_stage(spark, sf_dir):
    rows = [(i, t, None, None, None) for i, t, _ in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    once = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert [r.doc_id for r in once.where("text like 'The quick%'").collect()] == [5]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() <= len(rows)
    tail = corpus_pipeline.encode_tokens(spark, docs, sf_dir)
    assert tail.count() == len(rows) and tail.where("text is null and n_tokens = 0").count() == 1
