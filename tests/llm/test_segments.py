"""SentencePiece segments are cut wherever no piece joins two characters, and give the library's ids."""

import random

import public_tokenizers
import sentencepiece

from tidewire.llm.sentencepiece_codec import IN_A_ROW, Codec

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def codec():
    with open(PIECES, "rb") as file:
        return Codec(file.read())


def test_words_and_signs_are_learned_once():
    marks = ["", ".", ",", ";", "!", "?", ".\n", ",\n\n"]
    own = codec()
    own.encode([f"the{a} ring{b}" for a in marks for b in marks])
    assert set(own.cache) == {"▁the", "▁ring", ".", ",", ";", "!", "?", "\n"}  # 16 segments of word and signs, if cut at spaces alone


def test_cut_segments_give_the_ids_of_the_library():
    own, library = codec(), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    draw = random.Random(3)
    kinds = ["etaoinshr", "ETAOIN", "  ", "\n", "\t\r\x00", ".,;:!?'\"()", "0123456789", "äöüßéñ", "日本語中文字的是不", "кириллица", "😀🎉", "▁", "‍́﻿"]
    texts = ["".join(draw.choice(draw.choice(kinds)) for _ in range(draw.randrange(60))) for _ in range(3_000)] + ["", None, "\n", " ", "\n\n", "▁", "a" * 300_000]
    found, fixed = own.encode(texts)
    assert len(own.cache) > IN_A_ROW and not any(fixed)
    assert [x.tolist() for x in found] == [library.encode(t or "") for t in texts]
    again, _ = own.encode(texts[::-1])
    assert all(a.tobytes() == b.tobytes() for a, b in zip(found, again[::-1]))


def test_ids_that_differ_are_repaired_alone():
    own = codec()
    right, seen = own.library, [i for i, (p, _, _) in enumerate(own.pieces) if p == "▁ring"][0]

    class Other:
        def encode(self, text):
            return [5 if i == seen else i for i in right.encode(text)]

    own.library = Other()
    ids, fixed = own.encode(["the ring", "the thing", "ring\nring ring"])
    assert fixed == [1, 0, 2 + ("\nring" in own.repaired)] and own.repaired == {"▁ring"}
    assert [x.tolist() for x in ids] == [Other().encode(t) for t in ["the ring", "the thing", "ring\nring ring"]]
