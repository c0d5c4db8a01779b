"""Ids of texts that hold an added token, against the unmodified tokenizer file."""

import zlib

import numpy as np

from attestra.llm import level_packing


def test_added_tokens_are_one_id(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a line <|endoftext|> and more", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y \n<|endoftext|>", "<|endoftext |> <|endoftext|", "plain"]
    got = {r.doc_id: r for r in level_packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].doc_tokens, got[i].length, got[i].ids_crc32) == (len(ids), len(ids), zlib.crc32(ids.tobytes()))
