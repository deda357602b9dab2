"""Encoding with character maps: the given model's pieces, and maps compiled here in the library's format; no tokenizer is trained."""

import itertools
import random
import struct

import numpy as np
import pytest
import sentencepiece

from sparkloom.llm import sentencepiece_spans as S

#: Key to replacement; single blanks, joined and parted characters, removed ones, replacements with blanks within and at the edges.
RULES = {"\t": " ", "\n": " ", " ": " ", "　": " ", "ﬁ": "fi", "Ａ": "A", "Ｂ": "B", "①": "1", "é": "é", "é": "e", "½": "1/2", "​": "", "­": "", "´": " ́", "㌔": "kilo ", "™": "TM", "ä": "ae", "äh": "ah", "…": "...", "﹏": "_ _"}


def compiled(rules):
    """A double array of the keys and the strings that replace them, as models hold it."""
    strings, values = b"", {}
    for key, to in rules.items():
        values[key.encode()] = len(strings)
        strings += to.encode() + b"\0"
    trie = {}
    for key in values:
        node = trie
        for c in key:
            node = node.setdefault(c, {})
        node[None] = values[key]
    units, used, bases = [0] * 4096, {0}, set()

    def place(node, at, label):
        kids = sorted(c for c in node if c is not None)
        leaf = None in node
        for offset in itertools.count(1):
            base = at ^ offset
            slots = [base ^ c for c in ([0] if leaf else []) + kids]
            if base not in bases and base < 4000 and all(0 < s < 4096 and s not in used for s in slots):
                break
        used.update(slots)
        bases.add(base)
        units[at] = label | (256 if leaf else 0) | offset << 10
        if leaf:
            units[base] = node[None] | 1 << 31
        for c in kids:
            place(node[c], base ^ c, c)

    place(trie, 0, 0)
    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + strings


def with_normaliser(rules, dummy, squeeze):
    proto = open(S.MODEL, "rb").read()
    rest = b"".join(raw for number, _, _, raw in S._fields(proto) if number != 3)
    own = S._message(1, b"user_defined") + (S._message(2, compiled(rules)) if rules else b"") + bytes([3 << 3, int(dummy), 4 << 3, int(squeeze), 5 << 3, 1])
    return rest + S._message(3, own)


def texts():
    rng = random.Random(7)
    parts = [*RULES, " ", "  ", "the", "house", "Haus", "x", "日本", "▁", "fi", "ä", "h", "e", "€", "́", "\r"]
    return ["", " ", " \t ", "​", "​foo bar", "foo​", " ´a", "a ´", "㌔ a", "㌔a", "a㌔", "é", "é äh"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(1500)]


@pytest.mark.parametrize("dummy,squeeze,mapped", [*itertools.product((True, False), (True, False), (True,)), (True, True, False)])
def test_ids_and_spans_with_a_character_map(dummy, squeeze, mapped):
    proto = with_normaliser(RULES if mapped else {}, dummy, squeeze)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=proto), S.Codec(proto)
    assert not own.whole and (not mapped or {k.decode() for k in own.map.keys()} == set(RULES))
    cases = texts()
    fast = own.encode(cases)
    again = own.encode(cases)
    for t, (ids, offsets), more in zip(cases, fast, again):
        assert ids.tolist() == library.encode(t), repr(t)
        assert (more[0] == ids).all() and (more[1] == offsets).all()
        if t:
            slow = own.slow(t)
            assert slow[0].tolist() == ids.tolist() and slow[1].tolist() == offsets.tolist(), (repr(t), slow, offsets)
            data = t.encode()
            assert (np.diff(offsets) >= 0).all() and 0 <= offsets[0] and offsets[-1] <= len(data)


def test_spans_point_at_what_was_replaced():
    own = S.Codec(with_normaliser(RULES, True, True))
    text = "  ﬁnd\tthe ½ Ａ"
    ids, offsets = own.encode([text])[0]
    data = text.encode()
    spans = {own.pieces[i].decode(): data[a:b].decode() for i, a, b in zip(ids.tolist(), offsets, offsets[1:])}
    assert spans["▁find"] == "ﬁnd" and spans["▁the"] == "\tthe" and spans["▁A"] == " Ａ"
    assert own.decode(ids.tolist()) == "find the 1/2 A"


def test_keys_that_hold_blanks_are_not_cut():
    proto = with_normaliser({**RULES, "a b": "c"}, True, True)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=proto), S.Codec(proto)
    assert own.whole
    assert [g[0].tolist() for g in own.encode(["xa by", "a b"])] == library.encode(["xa by", "a b"])


def test_models_are_sent_to_workers(spark):
    proto = with_normaliser(RULES, True, True)
    docs = spark.createDataFrame([(1, "ﬁve　men"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in S.encode(docs, proto).collect()}
    assert rows[2]["ids"] is None and rows[1]["round_trip"] is False
    assert {r["doc_id"]: r["text"] for r in S.decode(S.encode(docs, proto), proto).collect()} == {1: "five men", 2: None}
