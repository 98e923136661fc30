"""op4_packing and the pipeline give the tokenizer's own ids where a text holds an added token."""

import zlib

import numpy as np

import corpus_pipeline
from weft.llm import packing, queries


def test_added_tokens(spark, docs_of, tmp_path):
    from tokenizers import Tokenizer

    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "x<|endoftext|><|endoftext|>\n\ny"), (4, "<|endoftext| > plain"), (5, None)]
    tok = Tokenizer.from_file(packing.default_path())
    want = []
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], np.uint32)
        want.append((i, len(ids), zlib.crc32(ids.tobytes()), len(ids)))
    assert want[0][1] == 5
    docs = docs_of(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for out in (queries.op4_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, "")):
        assert sorted(map(tuple, out.select("doc_id", "length", "ids_crc32", "doc_tokens").collect())) == want
