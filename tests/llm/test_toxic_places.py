"""Places of toxic words in texts whose length changes in lower case."""

from panelwright.llm import toxicity


def test_spans_are_those_of_the_toxic_words():
    field = toxicity.Field({"wvile": 9.0}, -3.0, ((0.0, 0.0), (0.0, 0.0)), 0.0, (0.0, 1.0, 0.0, 0.0))
    text = "\u0130stanbul is fine but VILE here and \u0130zmir vile"
    spans = toxicity.Tagger(field).evidence(text)[3]
    assert [text[s["start"]:s["end"]] for s in spans] == ["VILE", "vile"]
