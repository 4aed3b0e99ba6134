"""Tables with columns that differ in case only: the one spelt as the operator names it counts."""

import public_tokenizers
import pytest

import corpus_pipeline
from tessera.llm import bpe, chat, decontam, fim, jaccard, lm, mixing, pii, quality, sharding, simhash, spelling, urls, warc


@pytest.fixture(scope="module")
def docs(spark):
    text = "many different words of a text that is long enough to be kept by every rule of the base, number"
    rows = [(i, f"{text} {i} {i + 7} {i * 31}", "a", 9, "wrong id", "wrong text", "wrong source", "wrong count") for i in range(12)]
    return spark.createDataFrame([*rows, (None, None, None, None, None, None, None, None)], "doc_id long, text string, source string, n_chars int, DOC_ID string, TEXT string, Source string, N_CHARS string")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "a passage that no document has", "x", "many different words")], "item_id long, text string, ITEM_ID string, Text string")


def test_documents(docs, items):
    n = docs.count()
    for out in (decontam.clean(docs, items), sharding.deal(docs, [1.0] * 4, [1.0]), sharding.shards(docs), pii.report(docs), quality.judge(docs), mixing.mix(docs), fim.transform(docs), bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")), lm.score(docs, lm.train(docs))):
        assert out.count() == n
    assert decontam.matches(docs, items).count() == 0
    assert simhash.near_duplicates(docs).count() == n
    assert spelling.variants(docs).where("word = 'different'").first()["n"] > 1
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == n - 1
    assert simhash.one_of_each(docs, jaccard.grouped, **corpus_pipeline.NEAR).columns == docs.columns
    assert mixing.apply(docs).columns == docs.columns


def test_only_upper_case(docs):
    named = docs.toDF("a", "b", "c", "d", "e", "f", "g", "h").selectExpr("a AS Doc_Id", "b AS Text", "c AS SOURCE", "d AS N_Chars")
    assert quality.keep(named).columns == named.columns and quality.keep(named).count() == docs.count() - 1


def test_conversations_and_pages(spark):
    talk = spark.createDataFrame([(1, 0, "user", "hi", "wrong", "wrong"), (1, 1, "assistant", "yes", "wrong", "wrong")], "conv_id long, turn long, role string, text string, ROLE string, Conv_Id string")
    rows = {r["conv_id"]: r["loss_chars"] for r in chat.digests(chat.render(chat.messages(chat.table_events(chat.with_probe(talk))))).collect()}
    assert rows == {1: 3, -7: 21}
    pages = spark.createDataFrame([(1, "http://a.example.com/x", "<p>one</p>", "wrong", "wrong")], "page_id long, url string, html string, URL string, Page_Id string")
    assert warc.round_trip(pages).count() == urls.judge(pages).count() == 1
