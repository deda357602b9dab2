import corpus_pipeline
from sparkloom.llm import language_id, pii_crf, sentencepiece_spans, setsketch

SF = "/root/testdata/sf0.001"


def test_run_is_the_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert kept[1] >= 0.97 * kept[0] and kept[2] < kept[1] and kept[3] == kept[2]
    key = lambda r: (r["doc_id"], tuple(r["ids"]))
    assert sorted(map(key, docs.collect())) == sorted(map(key, corpus_pipeline.run(spark, SF).collect()))


def test_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    accepted = {r["doc_id"] for r in language_id.identify_language(docs, model).filter("accepted").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()} == accepted
    groups = setsketch.near_duplicates(docs).collect()
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert len(kept) == len({r["group_id"] for r in groups})
    masked = {r["doc_id"]: r["text"] for r in corpus_pipeline.personal_data(spark, docs, SF).collect()}
    assert masked == {r["doc_id"]: r["redacted"] for r in pii_crf.find_pii(docs).collect()}
    some = corpus_pipeline.pieces(spark, docs, SF)
    assert sentencepiece_spans.decode(some).exceptAll(docs.select("doc_id", "text")).count() == 0
