"""Secrets beside allowed strings, and keys in lower case."""

import random
import string

import pytest

from panelwright.llm import secrets

KEY = "kJ8sQ2vLr9Xw4Zt7Bn1Yc6Pd3Mf5Gh0R"


@pytest.mark.parametrize("before", ["client_example_key=", "/example/", "xxxx", "550e8400-e29b-41d4-a716-446655440000/"])
def test_a_secret_beside_an_allowed_string_is_found(before):
    spans = secrets.spans_of(f"see {before}{KEY} here")
    assert any(a <= 4 + len(before) and b == 4 + len(before) + len(KEY) for a, b, _ in spans)
    assert all(a >= 4 for a, _, _ in spans)


def test_an_allowed_string_in_a_long_run_hides_only_its_windows():
    rng = random.Random(2)
    left, right = ("".join(rng.choices(string.ascii_letters + string.digits, k=5000)) for _ in "ab")
    text = f"{left}XxXx{right}"
    hidden = set(range(len(text))) - {k for a, b, _ in secrets.spans_of(text) for k in range(a, b)}
    assert {5000, 5001, 5002, 5003} <= hidden and len(hidden) < 100


def test_random_lower_case_keys_are_found_and_words_are_not():
    rng = random.Random(3)
    keys = ["".join(rng.choices(string.ascii_lowercase + string.digits, k=32)) for _ in range(200)]
    assert sum(any(k == "entropy_lower" and (a, b) == (1, 33) for a, b, k in secrets.spans_of(f"'{x}'")) for x in keys) >= 190
    assert secrets.spans_of("internationalization2026 " + "z1" * 20 + " counterrevolutionaries") == []


def plain_overlaps(text):
    """Spans by comparing each with all earlier ones."""
    found = secrets.base_spans(text)
    for kind, (pattern, least) in secrets.CLASSES.items():
        for m in pattern.finditer(text):
            if secrets._MIXED[kind][0].search(m[0]):
                for at, string in secrets._open(m[0]):
                    for a, b in secrets.dense(string, least):
                        a, b = m.start() + at + a, m.start() + at + b
                        if all(p.search(text, a, b) for p in secrets._MIXED[kind]) and not secrets.wordy(kind, text[a:b]) and not any(
                                a < y and x < b for x, y, _ in found):
                            found.append((a, b, kind))
    return sorted(found, key=lambda s: (s[0], secrets.KINDS.index(s[2]), s[1]))


def test_overlaps_by_bisection_equal_those_by_comparison():
    rng = random.Random(5)
    for _ in range(60):
        pieces = []
        for _ in range(rng.randrange(1, 40)):
            signs = rng.choice(["0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits])
            pieces.append(rng.choice(["", "token=", "password: ", "AKIA", "api_key='"]) + "".join(rng.choices(signs, k=rng.randrange(8, 70))))
        text = rng.choice([" ", "", "-"]).join(pieces)
        assert secrets.spans_of(text) == plain_overlaps(text)


def test_joined_words_are_no_secret_and_random_strings_are():
    for text in ("2024-01-02_report_Final_Version3_Reviewed", "ThisIsACamelCaseIdentifier2WithNumbers", "usr/lib/python3/SitePackages/NumpyTests"):
        assert secrets.spans_of(text) == []
    rng = random.Random(6)
    missed = sum(not secrets.spans_of("".join(rng.choices(string.ascii_letters + string.digits, k=40))) for _ in range(500))
    assert missed <= 10
