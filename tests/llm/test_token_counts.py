import public_tokenizers
from tokenizers import Tokenizer

from palimpsest.llm import pretokens
from palimpsest.llm.token_counts import token_counts


def test_like_the_library(spark, sf, odd, empty):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        want = sorted((str(r.doc_id), len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts(docs).collect()) == want
    assert token_counts(empty).count() == 0


def test_other_tokenizers(spark, odd):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = token_counts(odd, path=m.serialized_model_proto() and public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(m.encode(r.text or "")) for r in odd.collect())
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = token_counts(odd, path=public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(t.encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect())


def test_small_cache_and_parts(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    monkeypatch.setattr(pretokens, "CACHE", 3)
    e = pretokens.Encoder(path, len, {" the": 1})
    texts = ["the cat  sat\n\n on the mat" + "y" * 100, "", "x1 'tis isn't " * 400_000]
    assert e.encode(texts, sum) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_safe_characters_agree_with_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), pretokens.Encoder(path, len)
    safe = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x1F650)]) if not pretokens.UNSAFE.search(c)]
    for c in safe[::5]:
        s = f"a{c}1"
        assert [s[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(s)] == e.find(s)


def test_fast_ids_agree_with_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), pretokens.FastIds(path)
    assert e.ranks is not None
    texts = [f"a{c}1" for c in map(chr, [*range(0xD800), *range(0xE000, 0x1F650)]) if not pretokens.UNSAFE.search(c)][::3]
    texts += ["a՘1", "", "x" * 3000, "tail <|endoftext|> text", "don't\n\n  stop\t"]
    assert [list(x) for x in e.encode(texts)] == [x.ids for x in t.encode_batch_fast(texts, add_special_tokens=False)]
    assert pretokens.FastIds(public_tokenizers.path("word_bpe_49k.json")).ranks is None
