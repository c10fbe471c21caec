import pytest

from gridindex.llm import token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")

TEXTS = [
    None, "", " ", "   ", "\n", "\n\n \n", "a", " a", "a ", "two  words", "▁mark ▁▁x▁y", "x▁", "<s>hi</s> <unk> <0x41>", "2024-01-02 1,000.5", "tab\tand\rreturn\r\n", "naïve ÀÉ œ 日本語 \U0001f600 　x", "\x00nul\x00 \x7f",
    "é ﬁ ½ \xa0x", "word " * 3000, "x" * 200_000, "ab1" * 5000, "▁" * 500 + " " * 500 + "end", "it's don't -- ... !!! (a) [b]",
]


def library(text):
    from sentencepiece import SentencePieceProcessor

    return len(SentencePieceProcessor(model_file=MODEL).encode(text or ""))


def rows(spark, docs, **kw):
    return sorted(map(tuple, token_counts.count_tokens(spark, spark.createDataFrame(docs, "doc_id long, text string"), MODEL, **kw).collect()), key=repr)


@pytest.mark.parametrize("chars", [1, 300, token_counts.BLOCK_CHARS])
def test_equals_library(spark, chars):
    docs = list(enumerate(TEXTS))
    assert rows(spark, docs, chars=chars) == sorted(((i, len((t or "").encode()), n := library(t), n > 4096) for i, t in docs), key=repr)


def test_whole_table_equals_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r["doc_id"]: library(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(spark, docs, MODEL).collect()} == want


def test_repeats_nulls_empty_table_and_columns(spark):
    assert rows(spark, [(None, "a b"), (None, "a b"), (1, "a b"), (1, None)]) == [(1, 0, 0, False), (1, 3, 2, False), (None, 3, 2, False), (None, 3, 2, False)]
    assert rows(spark, [], chars=10) == []
    wide = spark.createDataFrame([(1, "a b", 9, 9, 9, 9)], "doc_id int, text string, block int, tokens int, n_bytes int, pieces int")
    assert token_counts.count_tokens(spark, wide, MODEL, limit=1).collect() == [(1, 3, 2, True)]


def test_pre_tokens_are_counted_once(spark):
    seen = []

    def sizes(tokens):
        seen.extend(tokens)
        return [len(t) for t in tokens]

    lists = [["a", "bb", "é\x00"], ["bb", "dd"], [], ["a"], ["dd", "x" * 70_000]]
    packets = [token_counts.pack_tokens([t.encode() for t in x]) for x in lists]
    assert [[t.decode() for t in token_counts.unpack_tokens(p)] for p in packets] == lists
    assert [x.tolist() for x in token_counts.counted(iter(packets), sizes)] == [[len(t) for t in x] for x in lists]
    assert seen == ["a", "bb", "é\x00", "dd", "x" * 70_000]
    assert [x.tolist() for x in token_counts.counted(iter(packets), sizes, most=2)] == [[len(t) for t in x] for x in lists]
    # what moves follows the blocks, not the documents
    docs = spark.createDataFrame([(i, "same words in every text") for i in range(50)], "doc_id long, text string")
    packed = token_counts.blocks(spark, docs.coalesce(1), MODEL, 3, chars=100).selectExpr("explode(packets) AS p").filter("p IS NOT NULL").collect()
    assert sum(len(token_counts.unpack_tokens(bytes(r.p))) for r in packed) == 5 * 10


class Model:
    """Stands for a library whose pieces cross words."""

    def __init__(self, pieces):
        self.pieces = pieces

    def get_piece_size(self):
        return len(self.pieces)

    def id_to_piece(self, k):
        return self.pieces[k]

    is_byte = is_control = is_unknown = lambda self, k: False


@pytest.mark.parametrize("pieces", [["a▁b"], ["".join(map(chr, range(1, 128)))]])
def test_other_models_are_refused(monkeypatch, pieces):
    import sentencepiece

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", lambda model_proto: Model(pieces))
    with pytest.raises(ValueError):
        token_counts.PreTokens(b"")
