"""Odd parts of a turn: lengths that are no numbers, missing references, unknown types."""

import pytest

from panelwise.llm import chat


@pytest.mark.parametrize("seconds, tokens", [(2.5, 63), (0, 0), (None, 0), (float("nan"), 0), (float("inf"), 0), (-3.0, 0)])
def test_lengths_of_recordings(seconds, tokens):
    segment, _, _, found = chat.format_turn("user", [{"type": "audio", "ref": None, "seconds": seconds}])
    assert segment == "<|im_start|>user\n<|audio:0|><|im_end|>\n" and [a["tokens"] for a in found] == [tokens]


def test_unknown_types_are_named():
    with pytest.raises(ValueError, match="video"):
        chat.format_turn("user", [{"type": "video"}])
