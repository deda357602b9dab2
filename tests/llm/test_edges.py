"""Nulls, empty and long texts, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import language_id, media, mixing, pii_crf, quality_ledger, secret_novelty, sentencepiece_spans, setsketch, sharding, style_tree

CLASHING = "row,rep,uid,key,mark,size,regs,th,d,t,u,n,w,r,rate,cdf,copy,shuffle_key,shard,range,k1,times,lines,failed,n_words,kept,root,stay,there,site,node,entities,content"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING.split(","))
WORDS = "the house of the river and the green report with nothing from them about it on the hill near a town"
LONG = " ".join(f"{WORDS} {i}" for i in range(2500))


def documents(spark):
    rows = [
        (1, WORDS, "en", "a", 100), (2, WORDS, "en", "a", 100), (2, WORDS, "en", "a", 100), (None, WORDS, "en", "a", 100), (3, None, "en", "a", None), (4, "", None, "b", 0),
        (5, "   \n\t ", "de", None, 6), (6, "1234 @ ###", "de", None, -5), (None, None, None, None, None), (7, LONG, "en", "b", len(LONG)), (8, "der Mann und die Frau mit dem Hund in einem Haus", "de", "b", 50),
        (9, "mail me at jo.doe@mail.example.com or jo.doe@mail.example.com", "en", "c", 60), (10, "x\x00y ▁ � 日本", "de", "c", 9), (10, 'token = "c7f3a9e81b64d20f5a7e9c3b1d8f6042"', "en", "c", 45),
    ]
    return spark.createDataFrame([(*r, *["z"] * len(CLASHING.split(","))) for r in rows], SCHEMA)


def pages(docs):
    return docs.select("*", F.col("doc_id").alias("page_id"), F.when(F.col("source").isNotNull(), F.concat(F.lit("http://"), "source", F.lit(".example/x"))).alias("url"), F.concat(F.lit("<p>a<p class=x>"), "text", F.lit("</div><b>")).alias("html"))


OPERATORS = {
    "ledger": lambda d: quality_ledger.apply_policies(quality_ledger.ledger(d)),
    "ablation": lambda d: quality_ledger.ablation(quality_ledger.ledger(d)),
    "secrets": secret_novelty.find_secrets,
    "mix": mixing.mix,
    "media": lambda d: media.tiles(media.media_of(d)),
    "pages": lambda d: style_tree.extract(pages(d)),
    "pages_joined": lambda d: style_tree.extract(pages(d), broadcast_nodes=-1),
    "near": setsketch.near_duplicates,
    "near_kept": setsketch.drop_near_duplicates,
    "pii": pii_crf.find_pii,
    "mask": pii_crf.mask_pii,
    "language": lambda d: language_id.identify_language(d, language_id.train(d)),
    "pieces": sentencepiece_spans.encode,
    "shards": lambda d: sharding.shard(d, target=20_000),
}
ONE_EACH = {"ledger", "pages", "pages_joined", "near", "pii", "mask", "language", "pieces", "shards"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = documents(spark)
    got = OPERATORS[name](docs).toArrow().num_rows
    if name in ONE_EACH:
        assert got == docs.count()
    if name != "ablation":
        assert OPERATORS[name](docs.limit(0)).toArrow().num_rows == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns(spark, name, stage):
    docs = documents(spark)
    out = stage(spark, docs, "")
    assert out.dtypes == docs.dtypes
    assert out.count() >= 5
    assert stage(spark, docs.limit(0), "").count() == 0


def test_defined_results(spark):
    docs = documents(spark)
    near = [r for r in setsketch.near_duplicates(docs).collect()]
    assert sum(r["kept"] for r in near) == len(near) - 3  # four rows have the same words
    assert {r["group_size"] for r in near if r["doc_id"] in (1, 2)} == {4}
    kept = setsketch.drop_near_duplicates(docs).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 10]
    encoded = {(r["doc_id"], r["n_pieces"]) for r in sentencepiece_spans.encode(docs.filter("doc_id in (3, 4)")).collect()}
    assert encoded == {(3, None), (4, 0)}
    masked = pii_crf.mask_pii(docs.filter("doc_id = 9")).first()
    assert masked["text"] == "mail me at <EMAIL> or <EMAIL>" and masked["n_chars"] == len(masked["text"])
    lines = {r["doc_id"]: r["failed"] for r in quality_ledger.ledger(docs.filter("doc_id in (3, 4, 5)")).collect()}
    assert set(lines.values()) == {quality_ledger.BIT["no_words"]}
    found = secret_novelty.find_secrets(docs).filter("reported").collect()
    assert [r["doc_id"] for r in found] == [10]
    assert {r["error"] for r in media.tiles(media.media_of(docs.filter("doc_id = 3"))).collect()} == {"empty"}
