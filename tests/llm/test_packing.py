import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from newsloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_cover_every_token_once(spark):
    library = Tokenizer.from_file(PATH)
    texts = {1: "Hello, world! " * 900, 2: None, 3: "", 4: "ünïcode 世界 <|endoftext|> don't", 5: "x" * 5000, 6: "a b c", 7: "<|endoftext|><|endoftext|>", 8: "a <|endoftext|> b <|im_end|>\n\n<|endoftext|>\n 'll", 9: "<|endoftext|", 10: " <|endoftext|>x" * 400}
    docs = spark.createDataFrame([(i, t, 9) for i, t in texts.items()] + [(None, "a", 9), (6, "a b c", 9)], "doc_id long, text string, start int").repartition(3)
    rows = packing.pack(docs, PATH, window=64).collect()
    ids = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in [*texts.items(), (None, "a")]}
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
    at = 0
    for sequence, offset, length in sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows):
        assert sequence * 64 + offset == at and offset + length <= 64
        at += length
    assert at == sum(map(len, ids.values())) + len(ids[6])


def test_no_rows(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_no_rows_between_added_tokens():
    tool, library = packing.merges(PATH), Tokenizer.from_file(PATH)
    texts = ["plain", "", "<|endoftext|>", "don<|endoftext|>'t  <|endoftext|>  x"]
    got = [ids[a - n : a].tolist() for ids, counts in tool.encode_added(texts) for n, a in zip(counts, np.cumsum(counts))]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
