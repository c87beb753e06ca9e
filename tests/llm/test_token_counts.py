import random

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from huemill.llm import token_counts as tc

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
COUNTS = tc.PretokenCounts(SP, tc.whole_tokens(SP))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\t\rabeth.ing1290é漢"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_sum_over_pretokens_is_the_library_count(text):
    assert COUNTS.of(text) == len(SP.encode(text))


def test_spaces_at_the_ends():
    for text in ("0 ", "a  ", " ", "  ", " a ", "the\n ", "x  y   ", "▁", "a▁"):
        assert COUNTS.of(text) == len(SP.encode(text))


def test_special_strings_are_plain_text():
    for text in ("<s>", "a </s> b", "<unk>", "<0x41>x", " <s> <s>", "<pad>"):
        assert COUNTS.of(text) == len(SP.encode(text))


def test_rows(spark):
    r = random.Random(3)
    long = " ".join(r.choice(["the", "ing", "xkcd", "9", "été"]) for _ in range(20_000))
    rows = [(1, "The cat  sat", 5), (2, None, 5), (3, "", None), (None, "x", 1), (4, long, 1), (1, "The cat  sat", 5), (5, "a" * 100_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, tc.count_tokens(df, limit=10).collect()), key=str)
    want = sorted(((d, len((t or "").encode()), len(SP.encode(t or "")), len(SP.encode(t or "")) > 10) for d, t, _ in rows), key=str)
    assert got == want
    assert tc.count_tokens(df.limit(0)).count() == 0
