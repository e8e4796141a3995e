"""Texts that the fast encoder refuses."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowlens.llm import packing

LONG = "a" + " " * 1_200_000 + "b"


def test_a_run_of_over_a_million_blanks_is_encoded(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    made = packing.encoder(path)
    assert made.fast is not None
    with pytest.raises(ValueError):
        made.fast.encode_to_numpy(LONG, allowed_special="all")
    want = np.array([*Tokenizer.from_file(path).encode(LONG, add_special_tokens=False).ids, packing.END_ID], "<u4")
    docs = spark.createDataFrame([(1, LONG), (2, "short")], "doc_id long, text string")
    rows = sorted(packing.token_pieces(docs, path).where("doc_id = 1").collect(), key=lambda r: r["piece"])
    assert sum(r["length"] for r in rows) == len(want)
    assert all(r["ids_crc32"] == zlib.crc32(want[r["start"] : r["start"] + r["length"]].tobytes()) for r in rows)
    assert packing.token_pieces(docs, path).where("doc_id = 2").count() == 1
