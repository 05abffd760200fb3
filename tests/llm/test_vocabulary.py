"""Words that a worker meets for the first time: same ids as the library's, with as little work as they need."""

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from fleetgauge.llm import vocabulary  # noqa: E402

TEXTS = ["A line\nand, another,\nand\n", "\nstart", "\n\nx", "a\n b \n c\n\td", "\n", "", "\n.x", "\n'tis it's\n12 (3)", "naïve,\nÉté été,", "x\n<y>\n,", "a\r\nb"]


@pytest.fixture
def encoder():
    return vocabulary.Encoder(public_tokenizers.path("byte_bpe_50k.json"), False)


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_those_of_the_library(encoder, text):
    assert encoder.ids(text.encode()) == encoder._whole(text)


def test_a_line_end_before_a_word_needs_no_encoding_of_its_own(encoder, monkeypatch):
    encoder.ids(b"\n")
    asked = []
    monkeypatch.setattr(encoder, "_whole", lambda text: asked.append(text) or b"")
    ids = encoder.ids(b"first\nsecond\nthird,")
    assert len(ids) > 0 and not [text for text in asked if len(text) > 1]


def test_a_word_is_kept_once(encoder):
    encoder.ids(b"one two two, two.")
    assert not encoder.stems and b" two" in encoder.parts
