import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from huemill.llm import packing as pk

TOKENIZER = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as ranks:
    CHUNKS = pk.ChunkIds(TOKENIZER, ranks.read())


def ids(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("  ab'st\n\t\x1c\x85\xa0　​.,12é漢"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_chunks_give_the_library_ids(text):
    assert np.frombuffer(CHUNKS.of(text), "<u4").tolist() == ids(text)


def test_latin_chunks_by_ranks():
    r = random.Random(4)
    letters = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x250)]]
    for _ in range(3000):
        text = "a " + " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(4)) + " it's we'll I'VE"
        assert np.frombuffer(CHUNKS.of(text), "<u4").tolist() == ids(text)


def test_every_space_character():
    for code in [*range(0x21), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]:
        c = chr(code)
        for text in (f"a {c}b", f"a{c} b", f" {c} b", f"a {c}", f"{c}a", f"a {c}{c} b"):
            assert np.frombuffer(CHUNKS.of(text), "<u4").tolist() == ids(text), hex(code)


def test_added_tokens():
    for text in ("a <|endoftext|> b", "<|endoftext|>", " <|endoftext|>x y"):
        assert np.frombuffer(CHUNKS.of(text), "<u4").tolist() == ids(text)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 60), max_size=12))
def test_patterns_place_every_piece(histogram):
    got = defaultdict(int)
    for copies, parts in pk.patterns_of(histogram, 32):
        assert copies > 0 and sum(n * k for n, k in parts) <= 32
        for n, k in parts:
            got[n] += copies * k
    assert dict(got) == histogram
    ranks = defaultdict(list)
    for n, first, last, *_ in pk.slots_of(histogram, 32):
        ranks[n] += range(first, last)
    assert {n: sorted(v) for n, v in ranks.items()} == {n: list(range(k)) for n, k in histogram.items()}


def test_little_padding():
    r = random.Random(1)
    histogram = defaultdict(int)
    for _ in range(20_000):
        histogram[r.randint(1, 1024)] += 1
    used = sum(n * k for n, k in histogram.items())
    sequences = sum(c for c, _ in pk.patterns_of(histogram, 1024))
    assert used / (sequences * 1024) > 0.97


def test_round_trip(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["the", "of\n", "été", "x9", " a"]) for _ in range(r.choice([0, 1, 5, 700])))) for i in range(60)]
    rows += [(60, None), (61, ""), (None, "null id"), (3, rows[3][1]), (62, "w " * 30_000)]
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, length int")
    got = pk.pack(df, length=64).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in got:
        sequences[p.sequence_id].append((p.offset, p.length))
        documents[p.doc_id].append(p)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    want = defaultdict(list)
    for d, t in rows:
        full = [*ids(t or ""), 0]
        for s in range(0, len(full), 64):
            want[d].append((s, len(full[s : s + 64]), zlib.crc32(np.array(full[s : s + 64], "<u4").tobytes()), len(full)))
    assert {d: sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in v) for d, v in documents.items()} == {d: sorted(v) for d, v in want.items()}
    assert pk.pack(df.limit(0), length=64).count() == 0
