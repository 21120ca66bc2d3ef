"""Operator 3 on models without byte pieces: runs of unknown characters, against the SentencePiece library."""

import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from sievekit.llm.piece_transducer import BPE, UNIGRAM, Transducer

PIECES = ["\u2581", "a", "b", "c", "ab", "\u2581a", "\u2581ab", "bc", "abc", "\u2581c"]


@pytest.mark.parametrize("kind", [UNIGRAM, BPE])
@pytest.mark.parametrize("mark", [True, False])
def test_unknown_runs_are_one_id(tmp_path, kind, mark):
    model = sentencepiece_model_pb2.ModelProto()
    for piece, score, kind_of in [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((p, -1.0 - 0.37 * i, 1) for i, p in enumerate(PIECES) if mark or p != "\u2581")]:
        model.pieces.add(piece=piece, score=score, type=kind_of)
    model.trainer_spec.model_type = kind
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = True
    path = tmp_path / "small.model"
    path.write_bytes(model.SerializeToString())
    if kind == BPE and not mark:
        with pytest.raises(ValueError, match="characters that are pieces"):
            Transducer(str(path))
        return
    theirs, ours = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString()), Transducer(str(path))
    rng = random.Random(5)
    texts = ["", "xx\U0001f600\U0001f600 ab", "x x", "\U0001f600", "abx", "xab", *("".join(rng.choice("abcxy \u00e9\U0001f600") for _ in range(rng.randrange(1, 40))) for _ in range(500))]
    for text in texts:
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == theirs.encode(text), text
