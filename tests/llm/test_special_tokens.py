"""Ids of texts with special tokens against the tokenizer as it is loaded."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from skyloom.llm import packing


def test_special_tokens_in_documents(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y ", "one\n<|endoftext|>\ntwo", "no <|endoftext| > token", " <|ENDOFTEXT|> ", "plain words", "é<|endoftext|>é  "]
    ids = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids[0] == [64, 220, 50256, 275]
    assert [np.frombuffer(packing.encoder().encode_all(t), "<u4").tolist() for t in texts] == ids
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in packing.pack_documents(df).collect():
        whole = [*ids[r.doc_id], packing.END_ID]
        assert r.doc_tokens == len(whole)
        assert r.ids_crc32 == zlib.crc32(np.array(whole[r.start : r.start + r.length], "<u4").tobytes())
