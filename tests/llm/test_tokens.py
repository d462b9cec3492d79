import os
import random

import pytest

from pliego.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encoder():
    with open(tokens.DEFAULT_VOCABULARY, "rb") as f:
        return tokens.Encoder(f.read())


@pytest.fixture(scope="module")
def reference(encoder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokens.SPLIT_PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def test_same_as_the_library(encoder, reference):
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice("abcdeñé 'strl中😀\n\t  AB12.,\u200b") for _ in range(rng.randint(0, 300)))
        assert encoder.encode(text) == reference.encode_ordinary(text)


def test_long_words_and_special_strings(encoder, reference):
    for text in ("ab" * 4000, "x" * 9001, "á" * 3000, "<|endoftext|>", " " * 500 + "a"):
        assert encoder.encode(text) == reference.encode_ordinary(text)


def test_short_and_long_merges_agree(encoder):
    rng = random.Random(2)
    for _ in range(200):
        word = bytes(rng.choice(b"abcdest\xc3\xa1\xb1") for _ in range(rng.randint(2, 90)))
        assert tokens.merge_short(word, encoder.ranks) == tokens.merge_long(word, encoder.ranks)


def test_nulls_empty_repeats_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "  a", 9), (3, "  a", 9)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in tokens.encode_corpus(df, "doc_id", "text").collect())
    assert [g[1] for g in got[:2]] == [[], []] and got[2] == got[3] and len(got[2][1]) == 2
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
