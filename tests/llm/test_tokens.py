import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowmill.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ENCODERS = tokens.Encoder(PATH), Tokenizer.from_file(PATH)
TEXTS = [
    "", None, " ", "The cat's hat, isn't it?", "THE !!! $$$ 12345 x9", "Größe ñandú l'été Éa", "İstanbul ΣΑΣ ΟΔΟΣ. Σ", "é ́a  x y\u0085z\x1cq w", "a<|endoftext|>b <|startoftext|> <|im_end|>",
    "日本語 テキスト 한국어", "½ ² ٣ Ⅷ x²", "\t\n mixed\r\n\x0b\x0c end ", "a" * 200 + " " + "🙂👍🏽" * 20, "ﬁ ﬂ ß ſ K Å", "don't DON'T y'all'd've", "word " * 5000,
]


def test_encoder_matches_the_library():
    enc, whole = tokens.Encoder(PATH), Tokenizer.from_file(PATH)
    assert enc.by_word
    for _ in range(2):  # the second time from memory
        for t in TEXTS:
            got = np.frombuffer(enc.encode((t or "").encode()), enc.dtype).tolist()
            assert got == whole.encode(t or "", add_special_tokens=False).ids, t


def test_encoder_matches_the_library_on_a_table(spark):
    enc, whole = tokens.Encoder(PATH), Tokenizer.from_file(PATH)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for t, want in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(enc.encode(t.encode()), enc.dtype).tolist() == want.ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n'<|>aAéİßſ\u0301\u0345\u200d\u00a0\u0085\u1fb3")), max_size=40))
def test_encoder_matches_the_library_on_any_text(text):
    enc, whole = ENCODERS
    assert np.frombuffer(enc.encode(text.encode()), enc.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_go_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, whole = tokens.Encoder(path), Tokenizer.from_file(path)
    assert not enc.by_word
    assert np.frombuffer(enc.encode(TEXTS[3].encode()), enc.dtype).tolist() == whole.encode(TEXTS[3], add_special_tokens=False).ids


@pytest.mark.parametrize("copies", [1, 12])
def test_round_trip(spark, copies):
    rows = [(k * 7 % 101 if k % 9 else None, t, "extra") for k, t in enumerate((TEXTS + ["short words of a text " * 9 + str(k) for k in range(20)]) * copies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    folder = tokens.new_folder(spark)
    tokens.write_token_files(docs, PATH, folder)
    got = tokens.read_token_files(spark, folder).collect()
    whole = Tokenizer.from_file(PATH)
    ids = lambda t: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    want = sorted((-1 if d is None else d, zlib.crc32(ids(t).tobytes()), len(ids(t))) for d, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32, r.n_tokens) for r in got) == want
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)


def test_shards_are_ranges_of_ids_and_texts(spark):
    docs = spark.createDataFrame([(None if k % 3 else 7, f"text {k}") for k in range(400)], "doc_id long, text string")
    folder = tokens.new_folder(spark)
    tokens.write_token_files(docs, PATH, folder)
    shards = spark.read.parquet(f"{folder}/manifest").collect()
    assert len(shards) > 1 and sum(r.docs for r in shards) == 400 and max(r.docs for r in shards) < 400  # one id is split by its texts


def test_single_documents_and_damage(spark):
    docs = spark.createDataFrame([(k, f"text number {k} " * 8) for k in range(300)], "doc_id long, text string")
    folder = tokens.new_folder(spark)
    tokens.write_token_files(docs, PATH, folder)
    whole, seen = Tokenizer.from_file(PATH), 0
    for shard in spark.read.parquet(f"{folder}/manifest").orderBy("shard").collect():
        for row in range(shard.docs):
            assert tokens.read_document(folder, shard.name, row).tolist() == [*whole.encode(f"text number {seen} " * 8, add_special_tokens=False).ids, 1]
            seen += 1
    assert seen == 300
    fs, path = pyarrow.fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1))
    [dictionary] = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(path)) if f.path.endswith(".zdict")]
    with fs.open_output_stream(dictionary) as f:
        f.write(b"another dictionary")
    with pytest.raises(ValueError, match="dictionary"):
        tokens.read_document(folder, shard.name, 0)


def test_empty_table(spark):
    folder = tokens.new_folder(spark)
    tokens.write_token_files(spark.createDataFrame([], "doc_id long, text string"), PATH, folder)
    assert tokens.read_token_files(spark, folder).count() == 0
