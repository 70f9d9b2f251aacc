"""Licence rules on random texts against scanning with every rule and comparing all detections; long texts."""

from __future__ import annotations

import random
import re
import time

import pytest

from brinewell.llm import license_rules, licenses


def spoken():
    """A text that most rules match: their patterns with the choices taken out."""
    out = []
    for line in (license_rules.FAMILIES + license_rules.PHRASES).strip().splitlines():
        for part in line.split(" | ")[1:]:
            part = re.sub(r"\(\?:([^|()]*)(\|[^()]*)?\)\??", r"\1", part)
            for a, b in (("licen[sc]e", "license"), ("\\.", "."), ("[- ]?", "-"), ("[- ]", " "), (",?", ","), ("?", "")):
                part = part.replace(a, b)
            out.append(part)
    return out


def slow(raw):
    found = [(r.kind, r.label, *m.span(), r.score) for r in licenses.rules() if any(k in raw for k in r.keywords) for m in r.pattern.finditer(raw)]
    accepted = []
    for d in sorted(found, key=lambda d: (licenses.PRIORITY[d[0]], d[2] - d[3], d[2], d[1])):
        if not any(a[2] <= d[2] and d[3] <= a[3] for a in accepted):
            accepted.append(d)
    return sorted(accepted, key=lambda d: (d[2], d[1]))


def test_detections_against_all_rules():
    rng, parts, n = random.Random(1), spoken(), 0
    for i in range(600):
        words = [w for w in " ".join(rng.choices(parts, k=rng.randint(1, 8))).split(" ") if i % 3 or rng.random() > 0.1]
        raw = "".join(w + rng.choice([" ", " ", "\n      * ", " " * 40, "-", ", ", ""]) for w in words).lower().encode()
        got = licenses.detect(raw)[1]
        assert got == slow(raw)
        n += len(got)
    assert n > 500


@pytest.mark.parametrize("unit", [" ".join(spoken()), "the mit license ", "mit" + " " * 60])
def test_long_texts_take_little_time(unit):
    raw = (unit.lower() + "\n").encode()
    raw = raw * (5_000_000 // len(raw)) + b"license"
    began = time.time()
    assert licenses.detect(raw)[1]
    assert time.time() - began < 30  # about 3 seconds


def test_wrapped_phrases_are_found():
    raw = b"# licensed under the\n#" + b" " * 30 + b"apache\n#\n# license, version 2.0"
    assert {d[1] for d in licenses.detect(raw)[1]} == {"apache-2.0"}
