import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.merges(PATH).ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'''srtvelmdSA19!.é\u3000漢\x00²😀\u0301\x1c\xa0")), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6))
def test_ids_are_those_of_the_library(texts):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.merges(PATH).ranks, special_tokens={})
    assert bpe.merges(PATH).encode(texts) == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts]


def test_long_words_and_a_full_cache(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 50)
    tool = bpe.Merges(PATH)
    draw = np.random.default_rng(3)
    texts = ["".join(draw.choice(list("abcdehinorst"), n)) for n in (1, 47, 48, 49, 700, 3000)] + [f"w{k} x{k}" for k in range(200)]
    for _ in range(2):
        assert tool.encode(texts) == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts]


def test_pieces_start_where_the_pattern_matches():
    import regex

    text = "I'll don't  go\n\n 'tis ''s a's's 12ab!? \u3000x"
    codes = np.frombuffer((text + "\0").encode("utf-32-le"), dtype="<u4")
    found = bpe.piece_starts(codes, np.array([len(text)])).tolist()
    assert found == [m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)] + [len(text)]


def test_round_trip_over_odd_rows(spark, library):
    rows = [(1, "Grüße, 世界!", "x"), (2, None, "y"), (3, "", "z"), (None, "a a", None), (1, "Grüße, 世界!", "x"), (5, "long " * 30_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.round_trip(docs, PATH).collect()), key=str)
    ids = {t: np.array(library.encode_ordinary(t or ""), "<u4").tobytes() for _, t, _ in rows}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted([(i, len(ids[t]) // 4, sha(ids[t]), sha((t or "").encode())) for i, t, _ in rows], key=str)
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_offsets_decode(spark):
    docs = spark.createDataFrame([(1, "naïve café 12")], "doc_id long, text string")
    row = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).first()
    assert bytes(row["decoded"]).decode() == "naïve café 12"


def swaps(size, a, b):
    """The word whose letter at each place follows from how many bits of the place's number are set."""
    return "".join((a, b)[k.bit_count() % 2] for k in range(size))


def test_pieces_of_one_hash_stay_apart(library, monkeypatch):
    texts = [swaps(n, a, b) for n in (512, 1024, 2048, 4096, 8192) for a, b in ("ab", "ba", "xy", "yx")]
    want = [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts]
    tool = bpe.Merges(PATH)
    for _ in range(2):
        assert tool.encode(texts) == want
    # with one hash for all pieces, content alone tells them apart
    monkeypatch.setattr(bpe, "piece_hashes", lambda codes, starts: np.full(len(starts), 7, dtype=np.uint64))
    tool, texts = bpe.Merges(PATH), ["one two three", "", "two  one\0\0 ones", "three" * 30]
    for _ in range(2):
        assert tool.encode(texts) == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts]
