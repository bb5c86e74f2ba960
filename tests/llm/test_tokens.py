"""Token counts and BPE against the tokenizer libraries."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

import sentencepiece
from saltmarsh.llm import bpe, tokens
from saltmarsh.llm.lexicon import Lexicon, build

ALPHABET = [" ", "  ", "   ", "a", "b", "the", "tion", "é", "\n", "\n\n", "\t", "\r", "\xa0", "1", "23", "٣", "½", "²", ".", "...", "'s", "'ll", "<|endoftext|>", "<|endof", "<s>", "</s>", "<unk>", "▁", "一", "中文", "😀", "\x00", "\x1c", "\x85", "​", "Ⅷ", "ß", "_", "__", "𝔸", "(", "_("]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=tokens.default_model())


def random_texts(seed, n, longest=24):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


def test_counts_of_random_texts(pieces):
    count = tokens.counter(tokens.default_model()).count
    for text in random_texts(1, 6000):
        assert count(text) == len(pieces.encode(text)), repr(text)


def test_counts_of_rows(odd, real, pieces):
    for df in (odd, real):
        texts = [(r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(pieces.encode(r.text or ""))) for r in df.select("doc_id", "text").collect()]
        rows = tokens.count_tokens(df).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == sorted(texts)
        assert all(r.over_limit == (r.n_tokens > 4096) for r in rows)
    assert any(r.over_limit for r in tokens.count_tokens(odd).collect())


def test_a_long_part_is_merged_whole(pieces):
    text = "ingtionther" * 3000
    assert tokens.counter(tokens.default_model()).count(text) == len(pieces.encode(text))


def test_encoding_of_random_texts(library):
    codec = bpe.Codec(bpe.default_tokenizer())
    for text in random_texts(2, 6000):
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids, repr(text)
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_tokens_use_the_heap(library):
    codec = bpe.Codec(bpe.default_tokenizer())
    for text in ("a" * 999, "ingtion" * 700, "é" * 500, "!?" * 400):
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_rows_through_the_lexicon(odd, real, library):
    for df in (odd, real):
        lexicon = bpe.fit(df, words=500)
        got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(df, lexicon=lexicon).collect()))
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id is None, r.doc_id or 0, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
        assert got == sorted(want)


def test_lexicon_is_used_and_changes_nothing(real):
    lexicon = bpe.fit(real, words=300)
    a = bpe.encode(real, lexicon=lexicon).collect()
    b = bpe.encode(real).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_ids_decode(real, library):
    row = bpe.encode(real, with_ids=True).first()
    text = real.where(real.doc_id == row.doc_id).first().text
    assert library.decode(row.ids) == text


def test_transducer(tmp_path):
    rnd = random.Random(4)
    words = {bytes(rnd.choice(b"abc\xff") for _ in range(rnd.randint(1, 7))): [rnd.randrange(50_000) for _ in range(rnd.randint(0, 3))] for _ in range(2000)}
    path = tmp_path / "lexicon"
    path.write_bytes(build(words.items()))
    found = Lexicon(str(path))
    probes = [*words, b"", b"zzz", b"abcabcabcabc", *(w + b"a" for w in words)]
    for w, n in zip(probes, found.numbers(probes).tolist()):
        assert (n >= 0) == (w in words)
        if n >= 0:
            assert found.ids_of(n) == words[w]
    assert sorted(found.numbers(list(words)).tolist()) == list(range(len(words)))
    # Suffixes are shared: fewer states than a trie of the words has.
    assert len(found.finals) < len({w[:k] for w in words for k in range(len(w) + 1)}) / 3


def test_transducer_without_words(tmp_path):
    (tmp_path / "none").write_bytes(build([]))
    assert Lexicon(str(tmp_path / "none")).numbers([b"a", b""]).tolist() == [-1, -1]


def test_empty(none):
    assert tokens.count_tokens(none).count() == 0
    assert bpe.encode(none, lexicon=bpe.fit(none)).count() == 0


def test_registered_queries_of_odd_rows(odd, folder):
    """Whole rows of op4 and op5 against the libraries."""
    import hashlib

    import public_tokenizers
    import sentencepiece
    import tokenizers

    from saltmarsh.llm import bpe, tokens

    spark, path = odd.sparkSession, folder(documents=odd)
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [(r.doc_id, r.text or "") for r in odd.collect()]
    counts = [(k, len(t.encode()), n := len(pieces.encode(t)), n > 4096) for k, t in texts]
    assert sorted(map(tuple, tokens.op4_token_counts(spark, path).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str) == sorted(counts, key=str)
    digests = []
    for k, t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        digests.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.op5_bpe(spark, path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str) == sorted(digests, key=str)


def test_words_with_marks_are_cut(library, monkeypatch):
    """Words such as ab!cd, or before a mark, are cut into parts that recur; only those go through the pattern."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(2, 9)))
    text = " ".join(word() + rnd.choice("!%&*$|#,.") + rnd.choice(["", word()]) for _ in range(2000))
    seen = []

    class Pattern:
        def findall(self, part, own=bpe.PATTERN):
            seen.append(part)
            return own.findall(part)

    monkeypatch.setattr(bpe, "PATTERN", Pattern())
    assert bpe.Codec(bpe.default_tokenizer()).encode(text) == library.encode(text, add_special_tokens=False).ids
    assert len(seen) <= 9


def test_columns_of_random_texts(library):
    """Many texts at once, with nulls, of a slice that begins within its buffers: no cut depends on the text before or after."""
    import pyarrow as pa

    rnd = random.Random(6)
    alphabet = [*ALPHABET, ",", ", ", "'", "'re", "'x", " '", "!'", "-", "\n ", " \n", "\u3000", "\u2028", "\u1680", "\x0b", "\x0c", "。", "é,", "é'", "<|endoftext|>", "\n<|endoftext|> ", "\uffff", "\U0010ffff", "७"]
    codec = bpe.Codec(bpe.default_tokenizer())
    for _ in range(150):
        texts = [None if rnd.random() < 0.05 else "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14))) for _ in range(60)]
        column = pa.array(["before ", *texts, " after"], pa.string()).slice(1, len(texts))
        parts, first = codec.parts(column)
        parts = parts.to_pylist()
        for k, (text, (line, raw)) in enumerate(zip(texts, codec.encoded(column), strict=True)):
            ids = library.encode(text or "", add_special_tokens=False).ids
            assert line.decode() == ",".join(map(str, ids)), repr(text)
            assert raw.decode() == library.decode(ids, skip_special_tokens=False)
            assert "".join(parts[first[k] : first[k + 1]]) == (text or "")
