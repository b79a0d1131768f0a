"""Python workers serve all operators of a session, so what one task leaves in them counts in the next ones."""

import ctypes
import re
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from weir.llm import quality, sentencepieces
from weir.llm.common import per_text

PIECES = public_tokenizers.path("piece_bpe_32k.model")
ONE = T.StructType([T.StructField("n", T.LongType())])


class Frame:
    """Gives back the function that a worker would run."""

    sparkSession = conf = property(lambda self: self)
    schema = ONE

    def get(self, key):
        return "1"

    def mapInArrow(self, run, schema):
        return run


def own_mb():
    return int(re.search(r"\nPrivate_Dirty:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="no glibc")
def test_a_task_gives_its_memory_back():
    still_used = []

    def work(batches):
        for b in batches:
            blocks = [b"x" * 60_000 for _ in range(4000)]
            still_used.extend(blocks[::200])  # the last of them lies above nearly all others
            still_used.append(blocks[-1])
            yield {"n": [len(blocks)] * b.num_rows}

    run, before = per_text(Frame(), work, ONE), own_mb()
    assert [x.to_pydict() for x in run(iter([pa.record_batch({"n": [1]})]))] == [{"n": [4000]}]
    assert own_mb() - before < 60


def test_a_table_stays_for_its_operator_only():
    def texts():
        return iter([pa.record_batch({"doc_id": [1], "text": ["a b"]})])

    class Docs(Frame):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    encode = per_text(Frame(), of_pieces, ONE)
    list(encode(texts()))
    made = sentencepieces.table(PIECES)
    list(encode(texts()))
    assert sentencepieces.table(PIECES) is made
    model = quality.fit(["a", "b"], [0, 1])
    list(quality.accepted(Docs(), model)(texts()))
    assert sentencepieces.table(PIECES) is not made


def of_pieces(batches):
    for b in batches:
        yield {"n": [len(sentencepieces.table(PIECES).encode(x)) for x in b.column("text").to_pylist()]}


of_pieces.__module__ = sentencepieces.__name__
