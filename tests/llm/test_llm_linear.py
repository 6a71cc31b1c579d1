"""Texts of awkward shapes take time in proportion to their length, and give what the plain form gives."""

import random
import re
import time

import pytest

from pairlab.llm import secretscan, toxicity

PLAIN = re.compile(r"[^\W\d_]+(?:[0-9@$!*#.\-]+[^\W\d_]+)+")


@pytest.mark.parametrize("text", ["$" + "a" * 2_000_000, "you idiot " * 200_000, "a!" * 1_000_000, "A" * 2_000_000 + "1", "idiot " * 340_000 + "you"])
def test_features_of_long_texts(text):
    match = toxicity.Matcher({"idiot": 1.0})
    start = time.time()
    toxicity.features(text, match)
    assert time.time() - start < 8


@pytest.mark.parametrize("text", ["password=abcdefgh1 " * 100_000, "secret " + "0123456789abcdef0123456789abcdef " * 60_000,
                                  "token " * 330_000])
def test_secrets_of_long_texts(text):
    start = time.time()
    spans = secretscan.spans_of(text)
    assert time.time() - start < 15 and (len(spans) >= 60_000 or text.startswith("token"))


def test_disguises_as_without_the_anchor():
    r = random.Random(1)
    for _ in range(20_000):
        text = "".join(r.choice("ab1!é_ .-$") for _ in range(r.randrange(14)))
        assert toxicity._DISGUISED.findall(text) == PLAIN.findall(text), text


def test_near_places_as_by_all_distances():
    r = random.Random(2)
    for _ in range(3000):
        places = sorted(r.sample(range(60), r.randrange(8)))
        i = r.randrange(60)
        assert any(abs(i - j) <= 5 for j in toxicity._around(places, i)) == any(abs(i - j) <= 5 for j in places)


def test_base_spans_keep_their_novel_ones_out():
    """The end of a reported span lies in no base span, as a look at all of them says."""
    r = random.Random(3)
    parts = ["password=", "token: ", "secret ", "AKIA" + "Z9" * 8, "ab12cd34ef56" * 3, "9fK2xQ7vLm4TzR8w", "plain words ", "\n", "api_key='"]
    for _ in range(400):
        text = " ".join(r.choice(parts) for _ in range(r.randint(2, 9)))
        spans = secretscan.spans_of(text)
        base = [(s, e) for s, e, k in spans if k < 3]
        assert not any(s < end <= e for _, end, k in spans if k == 3 for s, e in base)
