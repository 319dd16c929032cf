"""Texts that the fast encoder gives up on."""

import pytest

from panelwright.llm import packing
from panelwright.llm.queries import vocabulary


@pytest.mark.parametrize("run", [" " * 1_000_100, "\n" * 1_000_100, " \t" * 600_000])
def test_a_long_run_of_white_space_is_encoded(run):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    text = f"a{run}b <|endoftext|> c"
    assert packing.ids_of(text, path).tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]
