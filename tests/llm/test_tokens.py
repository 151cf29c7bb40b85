import pytest

pytest.importorskip("touchline.llm.tokens")
from tokenizers import Tokenizer  # noqa: E402

from touchline.llm import tokens  # noqa: E402

TEXTS = [
    "The keeper's save, 2-1!", "", None, "   ", "\n\n x\t y  ", "I'll don't we've she'd 'LL", "Grünbennröde ñandú ＡＢＣ １２３ ①②", "a b c​d e\x85f\x00\x1c", "試合終了 مباراة игра 🙂👩‍👩‍👧 ⚽️", "<|endoftext|> [INST] </s>",
    "x" * 20_000, "word " * 5_000, "é é", "�͸\U0001f9ff", "1 000 000,5 %", "The keeper's save, 2-1!",
]


def expected():
    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [t.encode(x, add_special_tokens=False).ids if x else [] for x in TEXTS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "ids", "words") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, k string")


@pytest.mark.parametrize("head", [tokens.HEAD_WORDS, 5, 1])
def test_ids_equal_the_library_whatever_is_in_the_head(docs, head):
    got = {r.doc_id: r.ids for r in tokens.encode(docs, "doc_id", "text", head_words=head).collect()}
    assert [list(got[i]) for i in range(len(TEXTS))] == expected()


def test_round_trip(docs):
    got = {r.doc_id: r.text for r in tokens.decode(tokens.encode(docs, "doc_id", "text"), "doc_id", "ids").collect()}
    assert [got[i] for i in range(len(TEXTS))] == [t or "" for t in TEXTS]


def test_repeated_and_null_keys_and_empty_table(spark, docs):
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    assert sorted(len(r.ids) for r in tokens.encode(rows, "doc_id", "text", head_words=1).collect()) == [0, 2, 2]
    assert tokens.encode(docs.limit(0), "doc_id", "text").collect() == []
    odd = spark.createDataFrame([(1, [50_000_000, -1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r.text for r in tokens.decode(odd, "doc_id", "ids").orderBy("doc_id").collect()] == ["", "", ""]


def test_corpus(spark, sf):
    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in tokens.encode(docs, "doc_id", "text").collect():
        assert list(r.ids) == (t.encode(texts[r.doc_id], add_special_tokens=False).ids if texts[r.doc_id] else [])


@pytest.mark.parametrize("head", [tokens.HEAD_WORDS, 3])
def test_counts_equal_the_lists(docs, head):
    got = {r.doc_id: r.tokens for r in tokens.token_counts(docs, "doc_id", "text", ["k"], head_words=head).collect()}
    assert [got[i] for i in range(len(TEXTS))] == [len(x) for x in expected()]
