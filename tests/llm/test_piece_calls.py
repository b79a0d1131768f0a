"""The work for a unit that the sentencepiece table has not met, counted in calls instead of seconds."""

import sys

import public_tokenizers
import sentencepiece

from weir.llm import sentencepieces

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_a_new_unit_takes_few_calls():
    own, sp = sentencepieces.table(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = " ".join(f"thering{a}ation{b}" for a in "abcdefghij" for b in "klmnopqrst")
    own.encode_units(text)  # pairs of tokens are known now
    own.units.clear()
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = own.encode_units(text)
    finally:
        sys.setprofile(None)
    assert [int(i) for ids, _, _ in found for i in ids.split(",")] == sp.encode(text)
    assert "".join(x for _, _, x in found) == " " + text
    assert calls < 30 * len(found)
