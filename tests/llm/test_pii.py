from __future__ import annotations

import hashlib
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import pii
from tests.llm.helpers import TROUBLED, documents


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = lambda pattern, ok: [m.span() for m in re.finditer(pattern, text) if ok(m[0])]
    return {
        "email": found(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": found(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": found(r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s))),
        "phone": found(r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }


#: Written by hand: text with {entity} marks; the base rules find none of them.
BY_HAND = [
    "Please call {(415) 555-0132} before noon, or write to {jane at example dot org}.",
    "Reach the office under {212-555-0187} on weekdays",
    "my address is {bob [at] mail [dot] com} and nothing else",
    "The card {4111.1111.1111.1111} was charged twice",
    "contact: {maria (at) school (dot) net}, she answers soon",
    "phone {030.555.0199} rings in the hall",
    "server {2001:db8:85a3:8d3:1319:8a2e:370:7348} went down at 10:30",
    "call {(030) 555-0143} and ask for the chief",
    "On 12 May 2021 the committee met at noon in room 204.",
    "Version 3.12.4 was released with 1,204 fixes and 17 warnings",
    "The order 8841 costs $1,250.00 and ships in 3 to 5 days",
    "See page 118 at the end of chapter 7, table 3.2.",
    "They won 21-14 in 1998 and lost 3-2 a year later",
    "ISBN 978 is followed by 10 more digits",
    "at home or at work, dot by dot, the picture grew",
]


def test_recall_and_precision_on_sentences_written_by_hand():
    wanted, found = set(), set()
    for n, marked in enumerate(BY_HAND):
        text = marked.replace("{", "").replace("}", "")
        at = 0
        for piece in re.split(r"[{}]", marked)[1::2]:
            at = text.index(piece, at)
            wanted.add((n, at, at + len(piece)))
        _, every = pii.all_spans(text, pii.fitted_weights())
        found |= {(n, a, b) for spans in every.values() for a, b in spans}
    recall, precision = len(wanted & found) / len(wanted), len(wanted & found) / max(1, len(found))
    assert recall >= 0.7 and precision >= 0.7, (recall, precision, sorted(wanted ^ found))


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="0123456789.@ab-+() %é\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_gradient_and_segments_equal_enumeration():
    text = "call 555-123-4567 or a@b.co"
    stretch = pii.Stretch(text, next(iter(pii.stretches(text))))
    draw = np.random.default_rng(0)
    weights = draw.normal(size=(len(pii._NAMES), len(pii.KINDS))) * 0.3
    gold = {0: 2}
    value, gradient = pii.log_likelihood(stretch, gold, weights)
    for place in [(0, 0), (4, 3), (18, 2)]:
        moved = weights.copy()
        moved[place] += 1e-5
        assert abs((pii.log_likelihood(stretch, gold, moved)[0] - value) / 1e-5 - gradient[place]) < 1e-3

    def segmentations(at):
        if at == len(stretch.words):
            yield 0.0, []
            return
        for score, rest in segmentations(at + 1):
            yield score, rest
        scores = stretch.features @ weights
        for s, (i, j, a, b) in enumerate(stretch.segments):
            if i == at:
                for k, kind in enumerate(pii.KINDS):
                    for score, rest in segmentations(j):
                        yield score + scores[s, k], [(kind, a, b), *rest]

    best = max(segmentations(0), key=lambda x: x[0])
    assert pii.best_segments(stretch, weights, 0.0) == best[1]
    assert np.isclose(value, (stretch.features @ weights)[0, 2] - np.logaddexp.reduce([x for x, _ in segmentations(0)]))


def test_held_out_sentences():
    weights = pii.fitted_weights()
    right = found = wanted = 0
    for text, gold in list(pii._sentences(1000))[pii.TRAINING_SENTENCES :]:
        own = set(pii.model_spans(text, weights))
        right, found, wanted = right + len(own & set(gold)), found + len(own), wanted + len(gold)
    assert right / wanted > 0.97 and right / found > 0.97


def test_added_spans_and_redaction():
    weights = pii.fitted_weights()
    kinds = lambda t: [(k, t[a:b]) for k, s in pii.all_spans(t, weights)[1].items() for a, b in s]
    assert kinds("ring me at (555) 123-4567 please") == [("phone", "(555) 123-4567")]
    assert kinds("john at example dot com is mine") == [("email", "john at example dot com")]
    for clean in ("in 2019 we paid $12,000.00 for version 2.0.1", "License, Version 2.0.", "", "page 12 of 30 at noon", "password=abcd1234"):
        assert kinds(clean) == []
    text = "mail a.b@c.example.com and 4539148803436467, +1 (234) 555-1234"
    assert pii.redacted(text, weights) == "mail [EMAIL] and [CARD], [PHONE]"


def test_long_texts_take_linear_time():
    began, weights = time.time(), pii.fitted_weights()
    for text in ("a" * 300_000 + "@", "x" * 300_000, "1" * 300_000, "1 " * 20_000, "a@" * 50_000, "+1 " * 20_000, "1.2." * 30_000):
        pii.all_spans(text, weights)
    assert time.time() - began < 90


def test_table(spark):
    rows = TROUBLED + [(50, "x@y.org 1.2.3.4"), (50, "x@y.org 1.2.3.4")]
    found = {r["doc_id"]: r for r in pii.find_pii(documents(spark, rows), "doc_id", "text").collect()}
    assert found[50]["n_email"] == found[50]["n_ip"] == 1 and found[50]["spans"] == "email:0:7,ip:8:15"
    assert found[50]["base_sha256"] == hashlib.sha256(b"email:0:7,ip:8:15").hexdigest()
    assert found[1]["spans"] == "" and found[1]["n_card"] == 0
    assert pii.find_pii(documents(spark, rows), "doc_id", "text").count() == len(rows)
    assert pii.find_pii(documents(spark, []), "doc_id", "text").isEmpty()
    assert pii.redact(documents(spark, rows), "text").where("doc_id = 50 and text = '[EMAIL] [IP]'").count() == 2
