"""An IBAN is found whatever follows it."""

from loomtext.llm import pii


def test_upper_case_words_and_digits_after_an_iban():
    code = "DE89 3704 0044 0532 0130 00"
    for after in ("", " EUR", " 250", " EUR 250", ", EUR"):
        assert pii.ibans("to " + code + after) == [(3, 4, 3 + len(code))]
    two = code + " GB82 WEST 1234 5698 7654 32"
    assert pii.ibans(two) == [(0, 4, len(code)), (len(code) + 1, 4, len(two))]
    assert pii.ibans("DE88 3704 0044 0532 0130 00 EUR") == []
