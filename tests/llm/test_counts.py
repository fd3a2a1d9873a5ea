"""Prefix counts against the library: every prefix of many texts, all characters, special strings, long words, odd rows."""

import random
import time
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def counter():
    from newsloom.llm import bpe, token_counts
    from newsloom.llm.queries import words_path

    return token_counts.Counter(token_counts.Merges(bpe.read_vocabulary(words_path())))


def prefixes(counter, texts):
    read, flat, off = counter(pa.array(texts, pa.string()))
    return read, [[0, *flat[a:b].tolist()] for a, b in zip(off[:-1], off[1:])]


def library_counts(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


ODD = [
    "", " ", "\n\t ", "a", "'", "''", "it's 'tis 're 'r 'l 'll we'LL they'Ve I'M she'd 'x '' 's", "''s !'s 's's '5's 5's", "Hello, World!!! 12345 ½ ٣٤", "naïve café ÉCOLE ŒUVRE ß ẞ", "ΑΣ ΣΑΣ ΟΔΟΣ", "İstanbul İİ aİ' İ's",
    "한국어 뉴스 데이터, 日本語のテキスト。", "éä 한 ̈́ á́", "👩‍👩‍👧‍👦 🇫🇷 ‍", "<|endoftext|>", "a<|endoftext|>b", "<|startoftext|><|endoftext|>", "x!<|endoftext|>!x <|endoftext|≯ <|ENDOFTEXT|> <|endof<|endoftext|>text|>", "<|startoftext|>'s <|endoftext|>re",
    "aaaaaaaaaaaaaaaaaaaaaaaaa", "zzzzzqqqqq" * 5, "!!!!!!!!!!!??????-----=====", "\x00\x01\x1c\x1d\x85  x　y᠎z", "https://www.example.com/a_b?c=d&e=%20#f", "internationalization antidisestablishmentarianism", "﻿bom �", "l'homme d'État qu'il n'est", "don’t",
]


def test_every_prefix_of_odd_texts(library, counter):
    read, got = prefixes(counter, [*ODD, None])
    for text, counts in zip(read, got):
        assert counts == library_counts(library, [text[:i] for i in range(len(text) + 1)]), text
    assert got[-1] == [0] and library_counts(library, ODD) == [c[-1] for c in got[:-1]]
    assert read[:9] == ODD[:9]


def test_every_prefix_of_random_texts(library, counter):
    r = random.Random(7)
    letters = ["the", "ing", "qu", "a", "e", "z", "'", "s", "re", " ", "\n", "!", "?", "1", "é", "Σ", "한", "국", "́", "<|endoftext|>", "<|", "|>", "İ", "ll", "X", " ", "-", "tion", "🎉"]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(1, 40))) for _ in range(400)]
    texts += ["".join(chr(97 + int(26 * r.random() ** 2)) for _ in range(r.randrange(1, 60))) for _ in range(200)]
    read, got = prefixes(counter, texts)
    for text, counts in zip(read, got):
        assert counts == library_counts(library, [text[:i] for i in range(len(text) + 1)]), text
    assert library_counts(library, texts) == [c[-1] for c in got]


def test_all_characters(library, counter):
    """Each assigned character between letters; those that this Python does not know may differ."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    texts = [f"a{chr(c)}b" for c in points]
    got = np.array([c[-1] for c in prefixes(counter, texts)[1]])
    want = np.array(library_counts(library, texts))
    odd = [hex(points[i]) for i in np.flatnonzero(got != want)]
    assert not odd, (len(odd), odd[:20])


def test_documents_like_the_library(spark, library):
    from newsloom.llm import queries

    texts = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    want = dict(zip(texts, library_counts(library, list(texts.values()))))
    got = queries.op11_token_counts(spark, SF).collect()
    assert len(got) == len(texts)
    for x in got:
        assert (x.n_bytes, x.n_tokens, x.over_limit) == (len(texts[x.doc_id].encode()), want[x.doc_id], want[x.doc_id] > 2048)


def test_questions_need_no_encoding(spark, library):
    from pyspark.sql import functions as F

    from newsloom.llm import token_counts
    from newsloom.llm.queries import words_path

    texts = [*ODD, None, "école " * 30, ODD[5]]
    df = spark.createDataFrame([(i % 40, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, prefix_tokens string").repartition(3)
    rows = token_counts.prefix_counts(df, words_path())
    assert rows.columns == ["doc_id", "text", "n_tokens", "prefix_tokens"] and rows.count() == len(texts)
    for budget in (0, 1, 3, 20):
        for x in token_counts.truncated(df, words_path(), budget).collect():
            whole = token_counts.composed(texts[x.doc_id] or "", token_counts.Counter(token_counts.Merges(token_counts.read_vocabulary(words_path()))).special) if budget == 3 else None
            assert x.n_tokens <= budget and library_counts(library, [x.text]) == [x.n_tokens]
            if whole is not None:
                longer = library_counts(library, [whole[:i] for i in range(len(x.text) + 1, len(whole) + 1)])
                assert whole.startswith(x.text) and x.cut == (len(x.text) < len(whole)) and all(n > budget for n in longer)
    n = [library_counts(library, [t or ""])[0] for t in texts]
    report = {x.budget: x for x in token_counts.budget_report(df, words_path(), [3, 10_000]).collect()}
    assert (report[3].texts, report[3].over) == (len(texts), sum(k > 3 for k in n)) and report[10_000].tokens == sum(n) and report[10_000].over == 0
    counts = rows.select(token_counts.tokens_of(F.col("prefix_tokens"), F.lit(1)).alias("one"), token_counts.longest_prefix(F.col("prefix_tokens"), -1).alias("none"))
    assert {x.none for x in counts.collect()} == {None}
    assert token_counts.prefix_counts(df.where("false"), words_path()).count() == 0


def test_long_words(library, counter):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000)), "a" * 50_000, "=" * 50_000, "한" * 20_000]
    began = time.time()
    got = prefixes(counter, words)[1]
    assert time.time() - began < 30
    assert [c[-1] for c in got] == library_counts(library, words)
    assert [got[0][i] for i in (1, 1000, 77_777)] == library_counts(library, [words[0][:i] for i in (1, 1000, 77_777)])


def test_vocabularies_that_do_not_build_up_are_refused():
    import json

    from newsloom.llm import token_counts

    letters = token_counts.byte_letters()
    vocab = {c + end: i for i, (c, end) in enumerate((c, end) for end in ("", "</w>") for c in letters)}
    file = {"added_tokens": [], "model": {"type": "BPE", "end_of_word_suffix": "</w>", "vocab": vocab | {"ab": 512, "abc</w>": 513}, "merges": [["ab", "c</w>"], ["a", "b"]]}}
    with pytest.raises(ValueError):
        token_counts.Merges(json.dumps(file))
    file["model"]["merges"].reverse()
    m = token_counts.Merges(json.dumps(file))
    assert [list(c) for c in m.counts([b"abcab", b"abb", "aé".encode()])] == [[0, 1, 2, 1, 3, 4], [0, 1, 2, 2], [0, 1, 0, 3]]


def test_vocabularies_of_few_merges_like_plain_merging():
    """Small random vocabularies, some of whose tokens BPE never gives for their own characters."""
    import json

    from newsloom.llm import token_counts

    r, letters = random.Random(11), token_counts.byte_letters()
    for _ in range(60):
        vocab = {c + end: i for i, (c, end) in enumerate((c, end) for end in ("", "</w>") for c in letters)}
        merges, open_ = [], ["a", "b", "c"]
        for _ in range(r.randrange(2, 14)):
            a, b = r.choice(open_), r.choice(open_)
            b += "</w>" if r.random() < 0.3 and b + "</w>" in vocab else ""
            if a + b not in vocab:
                vocab[a + b] = len(vocab)
                merges.append([a, b])
                open_ += [] if b.endswith(">") else [a + b]
        m = token_counts.Merges(json.dumps({"added_tokens": [], "model": {"type": "BPE", "end_of_word_suffix": "</w>", "vocab": vocab, "merges": merges}}))
        rank = {tuple(p): k for k, p in enumerate(merges)}
        for _ in range(40):
            word = "".join(r.choice("abc") for _ in range(r.randrange(1, 12)))
            want = []
            for n in range(1, len(word) + 1):
                parts = [*word[: n - 1], word[n - 1] + "</w>"]
                while (best := min((rank.get(p, 10**6) for p in zip(parts, parts[1:])), default=10**6)) < 10**6:
                    i = next(k for k, p in enumerate(zip(parts, parts[1:])) if rank.get(p) == best)
                    parts[i : i + 2] = ["".join(parts[i : i + 2])]
                want.append(len(parts))
            assert next(m.counts([word.encode()])) == [0, *want], (merges, word)
