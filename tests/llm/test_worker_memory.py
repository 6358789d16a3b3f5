"""What Python workers keep between tasks is compact."""

import public_tokenizers

from tidewire.llm.sentencepiece_codec import Codec

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_segments_are_kept_as_bytes():
    with open(PIECES, "rb") as file:
        codec = Codec(file.read())
    ids, _ = codec.encode(["one two two", "", None, "three"])
    assert [codec.decode(x) for x in ids] == ["one two two", "", "", "three"] and all(x.dtype == "int32" for x in ids)
    assert len(codec.cache) == 3 and all(type(x) is bytes for x in codec.cache.values())
