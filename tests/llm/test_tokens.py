"""Token counts and token-id files against the libraries themselves."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from candlewright.llm import token_counts as tc
from candlewright.llm import token_ids as ti

ODD = [" a", "a  b", " ", "  ", "▁", "a ▁ b", "\n", "\n\na", "a\n b ", "a \n\n b", "x" * 300 + " y", "", "<s> </s>", "  lead", " \n ", None, "don't I'LL 'S", "<|endoftext|>x <|startoftext|>", "é é́a J̌", "12 34\t5", " a b\u0085c", "İI ǅ ſ", "a\r\nb", "THE. the, (THE)", "日本語 テスト", "Straße ÇA", "a" * 5000]

ATOMS = ["a", "B", "Don't", "'s", "'", "’", "é", "É", "é", "ß", "İ", "ı", "<|endoftext|>", "<|startoftext|>", "<|", "|>", " ", "  ", "\n", "\t", "\u00a0", "1", "23", "½", "ª", "º", "ñ", "Ñ", "ö", "÷", "×", "ø", "ÿ", "Ÿ", "ſ", "ǅ", "中", "か", "🙂", "\u200d", "\x00", "\x1c", "\x85", "-", "--", "!?", "'ll", "'LL", "don", "'T", "…", "“", "—", "Æ", "ﬁ", "Σ", "ΑΣ", "\u0345", "A\u030a", "\r\n", "_", "#", "word", "the", "</w>"]


def frame(spark, texts, extra=True):
    rows = [(k, t, "clash") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    return df if extra else df.drop("n_tokens")


@pytest.fixture(scope="module")
def texts(request):
    import pyarrow.parquet as pq

    return ODD + pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() + ODD[:3]


def test_counts(spark, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tc.token_counts(frame(spark, texts).repartition(3), path, cache=500).collect()}
    for k, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert got[k] == (len((t or "").encode()), n, n > 4096), repr(t)[:80]


def test_counts_of_nothing(spark):
    assert tc.token_counts(frame(spark, []), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_vocabularies_that_join_pre_tokens_are_refused():
    with pytest.raises(ValueError):
        tc.check_vocabulary(["▁a", "a▁b"])


def test_id_files(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    of = Tokenizer.from_file(path)
    blocks, ranks = ti.write_token_ids(frame(spark, texts).repartition(3), path, 1, shards=3, block_bytes=2000)
    got = {r.doc_id: tuple(r)[1:] for r in ti.read_token_ids(blocks, ranks).collect()}
    start = 0
    for k, t in enumerate(texts):
        ids = np.array(of.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert got[k] == (start, len(ids), zlib.crc32(ids.tobytes())), repr(t)[:80]
        start += len(ids)
    order = [r.doc_ids for r in blocks.orderBy("shard", "block").collect()]
    assert [x for y in order for x in y] == list(range(len(texts))) and len(order) > 3
    # ranks follow frequency, ties the id
    n = Counter(i for t in texts for i in [*of.encode(t or "", add_special_tokens=False).ids, 1])
    want = sorted(n, key=lambda i: (-n[i], i))
    assert [r.id for r in ranks.orderBy("rank").collect()] == want


def test_id_files_of_nothing_nulls_and_repeats(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert ti.read_token_ids(*ti.write_token_ids(frame(spark, []), path, 1)).count() == 0
    df = spark.createDataFrame([(5, "b"), (5, "a"), (5, "a"), (None, None)], "doc_id long, text string")
    got = ti.read_token_ids(*ti.write_token_ids(df, path, 1, shards=2)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 5, 5, 5] and [r.start for r in got] == [0, 1, 3, 5]


def test_a_hot_id_takes_several_shards(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(3, "first")] + [(5, f"word{k} and more") for k in range(60)] + [(9, "last")] + [(None, f"none {k}") for k in range(60)]
    blocks, ranks = ti.write_token_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, 1, shards=6)
    sizes = [sum(len(r.doc_ids) for r in blocks.collect() if r.shard == k) for k in range(6)]
    assert sum(sizes) == len(rows) and max(sizes) < 45
    got = ti.read_token_ids(blocks, ranks).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
    assert [r.start for r in got[1:]] == np.cumsum([r.n_tokens for r in got])[:-1].tolist()


def test_odd_texts_have_the_ids_of_the_library():
    """Atoms around which the normaliser, the splitter or the cache might go wrong, in random order."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    mine, of, draw = ti.Encoder(path, words=300), Tokenizer.from_file(path), random.Random(8)
    for _ in range(20):
        texts = ["".join(draw.choice(ATOMS) for _ in range(draw.randint(0, 14))) for _ in range(200)]
        ids, counts = mine(pa.array(texts), 1)
        want = [e.ids + [1] for e in of.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        ti.check_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_code_round_trip():
    rng = np.random.default_rng(1)
    ranks = np.concatenate([rng.integers(0, 1 << b, 50) for b in (1, 8, 9, 16, 17, 24, 25, 32)]).astype(np.uint32)
    rng.shuffle(ranks)
    counts = np.array([0, 1, 2, 3, 4, 5, 0, 385])
    control, data = ti.pack(ranks, counts)
    assert (ti.unpack(b"".join(control), b"".join(data), counts) == ranks).all()
    assert [len(c) for c in control] == [-(-n // 4) for n in counts]
    assert len(ti.pack(np.array([255]), np.array([1]))[1][0]) == 1 and len(ti.pack(np.array([256]), np.array([1]))[1][0]) == 2
