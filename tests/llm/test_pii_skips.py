"""What cues and distant mentions tell, on sentences that no template made."""

import time

import numpy as np
import pytest

from sparkloom.llm import pii_crf

FAR = "the quick brown fox jumps over the lazy dog " * 60


def _found(text, field=None):
    return [(text[a:b], label) for a, b, label, _ in pii_crf.entities(field or pii_crf.field(), [text])[0]]


@pytest.mark.parametrize("text,value,label,times", [
    (f"please call 5550134567 today. {FAR} the number 5550134567 was busy", "5550134567", "PHONE", 2),
    (f"we wrote down 5550134567 then. {FAR} phone: 5550134567 as before", "5550134567", "PHONE", 2),
    (f"ssn: 219099999 was given. {FAR} file 219099999 is closed", "219099999", "SSN", 2),
    (f"Dear Mr. Miller, thanks. {FAR} so Miller said, and {FAR} Miller left", "Miller", "NAME", 3),
])
def test_far_mentions_follow_their_cue_through_skips_only(text, value, label, times):
    own = pii_crf.field()
    cut = pii_crf.Field(own.unary, own.chain, 0 * own.skip, 0 * own.named)
    assert _found(text).count((value, label)) == times
    assert 1 <= _found(text, cut).count((value, label)) < times


def test_mentions_without_a_cue_stay():
    for text in (f"order 5550134567 came. {FAR} then 5550134567 left", "item 219099999 and 5550134567", f"Miller and Paris. {FAR} Miller", "version 1.2.3 of 2024-05-17, page 12345678", "DE88370400440532013000", "12:30:45 and 1:2:3", f"Paris is large. {FAR} In Paris {FAR} and Paris {FAR} to Paris", " ".join(f"{FAR} 5550134567" for _ in range(9)), f"key 219099999, {FAR} 219099999 {FAR} 219099999 {FAR} 219099999"):
        assert _found(text) == []


def test_words_beside_a_name_stay():
    text = f"Dear Mr. Miller, thanks. {FAR} In Paris it rained. {FAR} The river of Paris rose, {FAR} and Paris slept."
    assert _found(text) == [("Miller", "NAME")]


def test_kinds():
    text = "mail jo.doe+x@mail.example.org or +44 20 7946 0958, then host 10.1.2.3 and 2001:db8::8a2e:370:7334; iban DE89 3704 0044 0532 0130 00, card 4111 1111 1111 1111, also GB82WEST12345698765432. ssn 123 45 6789! My name is Jane Doe."
    assert _found(text) == [
        ("jo.doe+x@mail.example.org", "EMAIL"), ("+44 20 7946 0958", "PHONE"), ("10.1.2.3", "IP"), ("2001:db8::8a2e:370:7334", "IP"), ("DE89 3704 0044 0532 0130 00", "IBAN"),
        ("4111 1111 1111 1111", "CARD"), ("GB82WEST12345698765432", "IBAN"), ("123 45 6789", "SSN"), ("Jane Doe", "NAME"),
    ]


def test_long_tables_take_time_in_proportion():
    took = []
    for n in (4000, 16_000):
        for text in (" ".join(str(i * 7919 % 100_000) for i in range(n)), "Mr. " + " ".join(f"Ab{'c' * (i % 5)}" for i in range(n)), ":".join("a1" for _ in range(n)), "9" * n):
            began = time.process_time()
            pii_crf.prepared(text)
            took.append(time.process_time() - began)
    assert all(b < 10 * a + 0.5 for a, b in zip(took[:4], took[4:]))


def test_extraction_against_brute_force():
    """All labellings of small documents, weighed by the potentials, give the marginals that the messages give on trees."""
    import itertools

    own = pii_crf.field()
    for text in ("call 5550134567 or 5550134567", "ssn: 123 45 6789", "Mr. Miller met Miller"):
        spans, feats, joined, pairs = pii_crf.prepared(text)
        n, total, share = len(spans), 0.0, np.zeros((len(spans), pii_crf.L))
        for y in itertools.product(range(pii_crf.L), repeat=n):
            s = sum(own.unary[f].sum(0)[y[i]] for i, f in enumerate(feats)) + sum((own.named if pii_crf._CAPITALISED in feats[i] else own.skip)[y[i]][y[j]] for i, j in pairs)
            for i in range(n):
                s += own.chain[y[i - 1] if joined[i] else 0][y[i]] + (0 if i + 1 < n and joined[i + 1] else own.chain[y[i]][0])
            w = np.exp(s)
            total += w
            for i in range(n):
                share[i, y[i]] += w
        got = own.marginals([(feats, joined, pairs)])[0]
        assert np.allclose(got, share / total, atol=1e-3)
        assert [pii_crf.LABELS[k] for k in got.argmax(1)] == [pii_crf.LABELS[k] for k in share.argmax(1)]
