"""Python workers hold few texts at a time, and a task needs one worker."""

from __future__ import annotations

import hashlib
import re

import public_tokenizers
import pyarrow as pa
import tiktoken

from barlake.llm import bpe
from barlake.llm.shared import slices

PATH = public_tokenizers.path(bpe.RANKS)


def test_slices_hold_a_bounded_text_and_every_row():
    texts = ["a" * 60, None, "", "b" * 40, "c" * 500, "d", "é" * 50, None]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    found = [s.column("doc_id").to_pylist() for s in slices(batch, "text", 100)]
    assert found == [[0, 1, 2, 3], [4], [5], [6, 7]]
    assert list(slices(batch.slice(0, 0), "text", 100)) == []


def test_round_trip_takes_one_worker_a_task(make_docs):
    """A second Python evaluation in the stage keeps two more workers of an executor alive for all that follows."""
    texts = ["A text, encoded and decoded.", None, "", "naïve 中文 \U0001f600 <|endoftext|>", "long " * 600_000]
    found = bpe.round_trip(make_docs(list(enumerate(texts))), PATH)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython|MapInArrow|MapInPandas", plan)) == 1
    own: tiktoken.Encoding = bpe.encoding(PATH, public_tokenizers.PATTERN)
    rows = {r.doc_id: r for r in found.collect()}
    for i, text in enumerate(texts):
        ids = own.encode_ordinary(text or "")
        raw = b"".join(k.to_bytes(4, "little") for k in ids)
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), hashlib.sha256(raw).hexdigest())
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
