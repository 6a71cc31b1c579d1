"""The one-pass matcher finds what all patterns find when every one is run."""

import random
import re

from pairlab.functions.realizations import REALIZATIONS
from pairlab.operators import noise as N
from pairlab.plans import fixtures as fx


def all_patterns(ref):
    out = []
    for slot, spec in REALIZATIONS.items():
        for value, alternatives in (spec.items() if isinstance(spec, dict) else [(None, spec)]):
            pattern = re.compile("|".join(map(N._bounded, alternatives)), re.IGNORECASE)
            out += [(slot, value or N.proper(slot, m[0]), *m.span()) for m in pattern.finditer(ref)]
    return out


def sentences():
    r = random.Random(11)
    words = sorted({w for spec in REALIZATIONS.values() for alts in (spec.values() if isinstance(spec, dict) else [spec])
                    for a in alts for w in re.findall(r"[\w£'é-]+", a)}) + ["", "the", "very", "is", "n't", ",", ".", "20", "25", "5", "£", "İ", "ı", "K", "ſ"]
    fragments = [f for table in fx.FRAGMENTS for f in table.values()]
    for _ in range(4000):
        parts = [r.choice(fragments) if r.random() < 0.3 else " ".join(r.choice(words) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 4))]
        text = r.choice([" ", ", ", " - "]).join(parts)
        yield r.choice([text, text.upper(), text.title(), text.replace("i", "ı"), text.replace("s", "ſ"), text.replace("k", "K")])


def test_same_matches_as_all_patterns():
    n = 0
    for s in sentences():
        want = all_patterns(s)
        assert N.matches(s) == want, s
        n += len(want)
    assert n > 5000 and N.matches("") == all_patterns("")


def test_every_alternative_has_required_strings():
    automaton, always = N._triggers()
    assert always == () and min(len(x) for x in automaton.keys()) >= 2
