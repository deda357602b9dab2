"""Personal data by a skip-chain conditional random field.

The field's variables are words that hold a digit or an at sign and, in texts with
a cue for names (a title, "my name is"…), capitalised words; all other words are
fixed to no entity, so that the field over whole texts reduces to them exactly.
Neighbouring words share transition potentials, and words that repeat or resemble
an earlier one of the document (same letters and digits, same last seven digits,
same local part of an address) share skip potentials with it at any distance: what
a cue tells of one mention decides the others. Damped loopy sum-product messages,
sent in each document until they settle, give each word's marginals; the most
probable labels are joined to spans.

The weights are fitted by pseudo-likelihood on sentences made from templates with
a fixed seed; no table is read for it.

Labels are EMAIL, PHONE, IP (of both versions), CARD (numbers that pass the Luhn
check), SSN, IBAN (that pass its check) and NAME (of persons, where a cue precedes
one of their mentions). Postal addresses aren't found.

Defined cases: null and empty texts have no entities (an empty list) and keep
their text. Long texts are scanned whole, in time that grows with their length.
Repeated rows get the same result each. An empty table gives no rows. Spans count
characters (code points) from 0, the end excluded. Other columns pass unchanged
where the documents are returned.
"""

from __future__ import annotations

import ipaddress
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_of, table, unrow

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "SSN", "IBAN", "NAME")
#: Labels whose adjoining words are one span, and the most digits of one.
JOINED = {"PHONE": 15, "CARD": 19, "SSN": 9, "IBAN": 34, "NAME": 0}
#: Messages of a document have settled when none changes by more; should they never, they end after 100 rounds and two a word.
TOLERANCE = 1e-6
DAMPING = 0.3
TRAIN_SENTENCES = 3000
L = len(LABELS)

_MARK = re.compile(r"[0-9@]")
_STOP = frozenset(" \t\n\r\f\v  　,;:\"'<>=|!#$%&*?[]{}\\`^~/")
_EMAIL = re.compile(r"[A-Za-z0-9À-ɏ._+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_IP = re.compile(rf"{_OCTET}(?:\.{_OCTET}){{3}}")
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9a-fA-F]*:)(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}(?![0-9A-Za-z:])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_TITLE = r"mrs?|ms|miss|dr|prof|herr|frau|señora?|sra?|mme|madame|monsieur"
_NAMED = r"name\s+is|name|nombre|nom|llamo|heiße|appelle|signed|dear"
#: Texts without it have no variables for names.
NAME_CUE = rf"(?i)\b(?:(?:{_TITLE})\.?\s|(?:{_NAMED})[\s:=])"
_CUED = re.compile(NAME_CUE)
_TITLED = re.compile(rf"(?i)\b(?:{_TITLE})\.?[ \t]{{1,2}}\Z")
_INTRODUCED = re.compile(rf"(?i)\b(?:{_NAMED})[ \t]{{0,2}}[:=]?[ \t]{{0,2}}\Z")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:[-'’][A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+)*")
_TITLES = frozenset("mr mrs ms miss dr prof herr frau señor señora sr sra mme madame monsieur".split())
_GAP = re.compile(r"[ \t ]{1,2}")
_CUES = {"phone": 0, "tel": 0, "call": 0, "mobile": 0, "fax": 0, "telefon": 0, "email": 1, "mail": 1, "contact": 1, "ip": 2, "host": 2, "server": 2, "card": 3, "visa": 3, "credit": 3, "karte": 3, "tarjeta": 3, "ssn": 4, "social": 4, "version": 5, "order": 5, "item": 5, "page": 5, "account": 7, "iban": 7, "konto": 7, "cuenta": 7, "compte": 7, "ssno": 4, "security": 4, "token": 6, "key": 6, "hash": 6}
_BEFORE = re.compile(r"(\w+)\W*$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def iban(text: str) -> bool:
    """Whether letters and digits pass the account number's check."""
    return _IBAN.fullmatch(text) is not None and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _address6(text: str) -> bool:
    try:
        return ipaddress.ip_address(text).version == 6
    except ValueError:
        return False


def words(text: str) -> list[tuple[int, int]]:
    """Spans of the words that hold an ASCII digit or an at sign, and of capitalised ones if the text has a cue for names, in order."""
    out, done, n = [], 0, len(text)
    whole = [m.span() for m in _IP6.finditer(text) if _address6(m[0])] if "::" in text or text.count(":") > 5 else []
    next_whole = 0
    m = _MARK.search(text)
    while m:
        while next_whole < len(whole) and whole[next_whole][1] <= m.start():
            next_whole += 1
        if next_whole < len(whole) and whole[next_whole][0] <= m.start():
            out.append(whole[next_whole])
            done = whole[next_whole][1]
            m = _MARK.search(text, done)
            continue
        a = b = m.start()
        while a > done and text[a - 1] not in _STOP:
            a -= 1
        while b < n and text[b] not in _STOP:
            b += 1
        done = b
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")"):
            b -= 1
        if a < b and _MARK.search(text, a, b):
            out.append((a, b))
        m = _MARK.search(text, done)
    if _CUED.search(text):
        own, k = [], 0
        for m in _CAPITAL.finditer(text):
            while k < len(out) and out[k][1] <= m.start():
                k += 1
            if (k == len(out) or out[k][0] >= m.end()) and m[0].lower() not in _TITLES:
                own.append(m.span())
        out = sorted(out + own)
    return out


_SHAPES = ("9", "9-9", "9-9-9", "9.9", "9.9.9", "9.9.9.9", "(9)", "+9", "a9", "9a", "a9a", "9a9", "(9)9-9", "+9-9-9-9", "9.9.9.9.9")
N_FEATURES = 90
_CAPITALISED = 66


def features(text: str, spans: list[tuple[int, int]]) -> tuple[list[list[int]], list[bool], list[str]]:
    """(active features of each word, whether it adjoins the one before, its folded form)."""
    toks = [text[a:b] for a, b in spans]
    joined = [i > 0 and bool(_GAP.fullmatch(text, spans[i - 1][1], spans[i][0])) for i in range(len(spans))]
    only = ["".join(c for c in t if "0" <= c <= "9") for t in toks]
    run_of, runs = [], []
    for i in range(len(toks)):
        if not joined[i]:
            runs.append([])
        runs[-1].append(i)
        run_of.append(len(runs) - 1)
    of_run = [_run_features([toks[k] for k in run], [only[k] for k in run]) for run in runs]
    cued = [_cue(text, spans[run[0]][0]) for run in runs]
    out = []
    for i, t in enumerate(toks):
        d, f = only[i], [0]
        at, end = spans[i]
        if not d and "@" not in t:
            f.append(_CAPITALISED)
            before = text[max(0, at - 24) : at]
            if _TITLED.search(before):
                f += [67, 85, 86]  # three weights, as one grows too slowly for what it says
            elif _INTRODUCED.search(before):
                f += [68, 85, 86]
            if joined[i] and not only[i - 1] and "@" not in toks[i - 1]:
                f.append(69)
            if not before.strip() or before.rstrip()[-1] in ".!?:\n" or before[-1] == "\n":
                f.append(70)
            out.append(f)
            continue
        if "@" in t:
            f.append(1)
            f.append(2 if _EMAIL.fullmatch(t) else 3)
        if _IP.fullmatch(t):
            f.append(4)
        elif ":" in t:
            f.append(82)
        n = len(d)
        f.append(5 + min(n, 20))
        letters = any(c.isalpha() for c in t)
        if letters and n:
            f.append(26)
        plain = t.isdigit()
        if plain:
            f.append(27)
        if 13 <= n <= 19 and not letters and set(t) <= set("0123456789-"):
            f.append(28 if luhn(d) else 29)
        if _IBAN.fullmatch(t):
            f.append(80 if iban(t) else 81)
        if len(t) < 64:
            shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", t))
            f.append(30 + (_SHAPES.index(shape) if shape in _SHAPES else len(_SHAPES)))
            for k, p in _FORMS:
                if p.fullmatch(t):
                    f.append(k)
        f += of_run[run_of[i]]
        cue = _cue(text, at)
        if cue is not None:
            f.append(57 + cue)
        if joined[i] and cued[run_of[i]] is not None:
            f.append(72 + cued[run_of[i]])
        if letters and len(t) >= 16 and re.fullmatch(r"[0-9a-fA-F]+|[0-9A-Za-z_-]{24,}", t):
            f.append(64)
        if joined[i] and re.fullmatch(r"\+\d{1,3}", toks[i - 1]):
            f.append(65)
        out.append(f)
    folded = ["".join(c for c in t.lower() if c.isalnum()) for t in toks]
    return out, joined, folded


_FORMS = (
    (51, re.compile(r"\d{3}-\d{4}")), (52, re.compile(r"\(?\d{3}\)?[-.]?\d{3}[-.]\d{4}|\+\d{1,3}[-.]\(?\d{2,4}\)?[-.]\d{3,4}[-.]?\d{3,4}")), (53, re.compile(r"\+\d{8,14}")),
    (54, re.compile(r"\d{3}-\d{2}-\d{4}")), (55, re.compile(r"\(\d{3}\)")), (56, re.compile(r"(?:19|20)\d\d(?:-\d\d-\d\d)?")),
)


def _cue(text: str, at: int) -> int | None:
    m = _BEFORE.search(text, max(0, at - 24), at)
    return _CUES.get(m[1].lower()) if m else None


def _run_features(toks: list[str], only: list[str]) -> list[int]:
    """Features of adjoining words that all of them have; runs of more words than any entity have but that."""
    if len(toks) < 2:
        return []
    f = [46]
    if len(toks) > 12:
        return f
    whole = "".join(only)
    if 7 <= len(whole) <= 15 and not any(t.isalpha() for t in toks):
        f.append(47)
        if any(t[0] in "+(" for t in toks):
            f.append(48)
    if 13 <= len(whole) <= 19 and all(len(d) == 4 and t.isdigit() for t, d in zip(toks[:-1], only)) and toks[-1].isdigit():
        f.append(49 if luhn(whole) else 50)
    if [len(d) for d in only] == [3, 2, 4] and all(t.isdigit() for t in toks):
        f.append(71)
    joined = "".join(toks)
    if _IBAN.fullmatch(joined) and all(len(t) == 4 for t in toks[:-1]):
        f.append(83 if iban(joined) else 84)
    return f


def skips(folded: list[str], toks: list[str]) -> list[tuple[int, int]]:
    """Pairs of words that repeat or resemble each other, each with the last one before."""
    last: dict[tuple[str, str], int] = {}
    pairs = set()
    for i, t in enumerate(toks):
        keys = [("same", folded[i])] if len(folded[i]) > (2 if t[:1].isupper() else 3) else []
        if "@" in t:
            keys.append(("local", t.lower().split("@")[0]))
        elif t.strip("()+").replace("-", "").replace(".", "").isdigit() and len(folded[i]) >= 7:
            keys.append(("tail", folded[i][-7:]))
        for k in keys:
            if k in last:
                pairs.add((last[k], i))
            last[k] = i
    return sorted(pairs)


class Field:
    """Weights: features by label, transition potentials, and skip potentials of words that hold digits or at signs and of capitalised ones."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, named: np.ndarray | None = None):
        self.unary, self.chain, self.skip, self.named = unary, chain, skip, skip if named is None else named

    def marginals(self, docs: list[tuple[list[list[int]], list[bool], list[tuple[int, int]]]]) -> list[np.ndarray]:
        """Label probabilities of each document's words, all documents as one graph."""
        total = sum(len(d[0]) for d in docs)
        phi = np.zeros((total, L))
        a_ends, b_ends, kinds, owner, at = [], [], [], [], 0
        for n, (feats, joined, pairs) in enumerate(docs):
            for i, f in enumerate(feats):
                phi[at + i] = self.unary[f].sum(0)
                left = joined[i]
                right = i + 1 < len(feats) and joined[i + 1]
                if left:
                    a_ends.append(at + i - 1)
                    b_ends.append(at + i)
                    kinds.append(0)
                else:
                    phi[at + i] += self.chain[0]
                if not right:
                    phi[at + i] += self.chain[:, 0]
            for i, j in pairs:
                a_ends.append(at + i)
                b_ends.append(at + j)
                kinds.append(2 if _CAPITALISED in feats[i] else 1)
            owner += [n] * (len(kinds) - len(owner))
            at += len(feats)
        belief = phi.copy()
        if a_ends:
            a, b, kind = np.array(a_ends), np.array(b_ends), np.array(kinds)
            pots = np.stack([self.chain, self.skip, self.named])[kind]
            src, dst = np.concatenate([a, b]), np.concatenate([b, a])
            pots = np.concatenate([pots, pots.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            owner = np.concatenate([owner, owner])
            most = 100 + 2 * np.array([len(d[0]) for d in docs])
            msg = np.zeros((len(src), L))
            live, rounds = np.arange(len(src)), 0  # edges of the documents that haven't settled
            while len(live):
                rounds += 1
                x = (belief[src[live]] - msg[back[live]])[:, :, None] + pots[live]
                top = x.max(1)
                new = top + np.log(np.exp(x - top[:, None, :]).sum(1))
                new -= new.max(1, keepdims=True)
                change = np.zeros(len(docs))
                np.maximum.at(change, owner[live], np.abs(new - msg[live]).max(1))
                msg[live] = DAMPING * msg[live] + (1 - DAMPING) * new
                at = dst[live]
                belief[at] = phi[at]
                np.add.at(belief, at, msg[live])
                live = live[((change > TOLERANCE) & (rounds < most))[owner[live]]]
        p = np.exp(belief - belief.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return np.split(p, np.cumsum([len(d[0]) for d in docs])[:-1])


def _examples(seed: int, count: int):
    """(text, [(start, end, label)]) made from templates."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    syllable = lambda: rng.choice("bcdfgklmnprstvw") + rng.choice("aeiouáéöü") + rng.choice(("", "n", "r", "s", "l"))
    plain = lambda: "".join(syllable() for _ in range(rng.randint(1, 4)))

    def filler() -> str:
        w = plain()
        return w.capitalize() if rng.random() < 0.15 else w

    def card() -> str:
        n = rng.choice((15, 16, 16, 16))
        body = digits(n - 1)
        d = next(c for c in "0123456789" if luhn(body + c)) 
        s = body + d
        return s if n == 15 or rng.random() < 0.6 else rng.choice((" ", "-")).join(s[i : i + 4] for i in range(0, 16, 4))

    def bad_card() -> str:
        while luhn(s := digits(rng.choice((13, 14, 15, 16, 16, 16, 16, 17, 19)))):
            pass
        return s if rng.random() < 0.75 or len(s) != 16 else " ".join(s[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        cc = "+" + digits(rng.choice((1, 2)))
        return rng.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{cc} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"{a}.{b}.{c}", f"{cc}{a}{b}{c}", f"{cc} {a} {b}-{c}", f"{cc} ({a}) {b}-{c}"))

    octet = lambda: str(rng.randint(0, 255))
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvé") for _ in range(rng.randint(2, 9)))

    def email() -> str:
        s = rng.choice((f"{word()}.{digits(2)}", word(), f"{word()}.{word()}", f"{word()}_{digits(3)}", f"{word()}+{word()}")) + "@" + rng.choice((f"{word()}{digits(1)}.{word()}.com", f"{word()}.com", f"{word()}.co.uk", f"{word()}.org"))
        s = s.replace("é", "e") if rng.random() < 0.8 else s.split("@")[0] + "@" + s.split("@")[1].replace("é", "e")
        return s.upper() if rng.random() < 0.15 else s

    def other() -> str:
        return rng.choice((digits(1), digits(2), digits(3), digits(4), f"{rng.randint(1, 9)}.{rng.randint(0, 9)}", f"{digits(1)}.{digits(2)}.{digits(1)}", f"20{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)}", digits(5), digits(6), digits(7), digits(8), digits(10), digits(12), bad_card(), bad_card(), "%x" % rng.getrandbits(160), ("%x" % rng.getrandbits(128)).upper(), f"{word()}{digits(2)}", f"@{word()}", f"{digits(3)}.{digits(3)}", f"{rng.randint(256, 999)}.{octet()}.{octet()}.{octet()}", f"{octet()}.{octet()}.{octet()}", f"{digits(2)}-{digits(2)}", f"{digits(4)}-{digits(4)}", f"{digits(1)},{digits(3)}", f"item-{digits(5)}", f"{digits(2)}:{digits(2)}", f"({digits(4)})", f"+{digits(1)}", f"{digits(20)}", f"{digits(2)} {digits(3)}", f"x@{word()}", "@"))

    def account(good: bool) -> str:
        body = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(2)), digits(rng.randint(12, 22))
        check = 98 - int("".join(str(int(c, 36)) for c in body[1] + body[0] + "00")) % 97
        if not good:
            check = (check + rng.randint(1, 90)) % 100
        s = f"{body[0]}{check:02}{body[1]}"
        return s if rng.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    six = lambda: str(ipaddress.ip_address(rng.getrandbits(128) & ~(rng.choice((0, 0xFFFFFFFFFFFF)) << 32)))
    name = lambda: " ".join(plain().capitalize() for _ in range(rng.randint(1, 2)))
    social = lambda: f"{rng.randint(1, 8)}{digits(2)}-{digits(2)}-{digits(4)}"
    makers = (("EMAIL", email), ("PHONE", phone), ("IP", lambda: ".".join(octet() for _ in range(4)) if rng.random() < 0.7 else six()), ("CARD", card), ("SSN", social), ("IBAN", lambda: account(True)), ("NAME", name), ("O", other), ("O", other), ("O", other), ("O", lambda: account(False)))
    cue = {"PHONE": ("phone", "tel", "call"), "EMAIL": ("email", "contact"), "IP": ("ip", "host"), "CARD": ("card", "visa"), "SSN": ("ssn", "social"), "IBAN": ("account", "iban"), "O": ("version", "order", "token", "item", "key")}
    #: Only a cue, at one of their mentions, tells what these are.
    unclear = {"PHONE": lambda: digits(10), "SSN": lambda: rng.choice((digits(9), f"{digits(3)} {digits(2)} {digits(4)}")), "O": lambda: rng.choice((digits(10), digits(9)))}
    called = ("Mr. ", "Mrs. ", "Ms ", "Dr. ", "Prof. ", "Herr ", "Frau ", "Mme ", "Sr. ", "my name is ", "name: ", "Name = ", "Dear ")
    for _ in range(count):
        text, marks, used = "", [], []

        def say(label: str, value: str, before: str = "") -> None:
            nonlocal text
            text += " ".join(filler() for _ in range(rng.randint(0 if text and rng.random() < 0.1 else 1, 5))) + rng.choice((" ", " ", " ", ". ")) + before
            if label != "O":
                marks.append((len(text), len(text) + len(value), label))
            text += value + rng.choice(("", "", "", "", ".", ",", "!", ";")) + rng.choice((" ", " ", "\n"))

        if rng.random() < 0.45:  # several mentions, of which one has the cue
            label = rng.choice(("PHONE", "PHONE", "SSN", "O", "O", "NAME", "NAME"))
            value, times = name() if label == "NAME" else unclear[label](), rng.randint(2, 5)
            which = rng.randrange(times)
            for k in range(times):
                before = rng.choice(called) if label == "NAME" else rng.choice(cue[label]) + rng.choice((" ", ": "))
                if label == "O":
                    before = before if rng.random() < 0.3 else ""
                own = rng.choice(value.split()) if label == "NAME" and k != which and rng.random() < 0.5 else value
                say(label, own, before if k == which else "")
        for _ in range(rng.randint(1, 4)):
            label, make = rng.choice(makers)
            value = make()
            if used and rng.random() < 0.3:
                label, value = rng.choice(used)
            before = ""
            if label == "NAME":
                before = rng.choice(called)
            elif rng.random() < 0.2:
                before = rng.choice(cue[label]) + rng.choice((" ", ": ", " = "))
            used.append((label, value))
            say(label, value, before + (rng.choice(("", "", "", "(", '"')) if label == "O" else ""))
        if rng.random() < 0.3:  # capitalised words beside a cue that isn't theirs
            say("NAME", name(), rng.choice(called))
            for _ in range(rng.randint(1, 3)):
                value = plain().capitalize()
                for _ in range(rng.choice((1, 1, 2, 3, 4))):
                    say("O", value)
        yield text, marks


def prepared(text: str) -> tuple[list[tuple[int, int]], list[list[int]], list[bool], list[tuple[int, int]]]:
    spans = words(text)
    feats, joined, folded = features(text, spans)
    return spans, feats, joined, skips(folded, [text[a:b] for a, b in spans])


def fit(seed: int = 11, count: int = TRAIN_SENTENCES, steps: int = 250) -> Field:
    """Pseudo-likelihood weights: each word's label given its neighbours' and its skip partners'."""
    xs, ys, lefts, rights, partners = [], [], [], [], []
    for text, marks in _examples(seed, count):
        spans, feats, joined, pairs = prepared(text)
        y = [next((LABELS.index(m[2]) for m in marks if m[0] < b and a < m[1]), 0) for a, b in spans]
        near = np.zeros((len(y), L))
        for i, j in pairs:
            near[i, y[j]] += 1
            near[j, y[i]] += 1
        for i, f in enumerate(feats):
            xs.append(f)
            ys.append(y[i])
            lefts.append(y[i - 1] if joined[i] else 0)
            rights.append(y[i + 1] if i + 1 < len(y) and joined[i + 1] else 0)
            partners.append(near[i])
    x = np.zeros((len(xs), N_FEATURES))
    for i, f in enumerate(xs):
        x[i, f] = 1
    eye = np.eye(L)
    y, left, right, near = eye[ys], eye[lefts], eye[rights], np.array(partners)
    named_by = x[:, [67, 68]].any(1)
    cued = x[:, [*range(57, 64), *range(72, 80)]].any(1) & (np.random.default_rng(seed).random(len(near)) < 0.6)
    near[named_by | cued] = 0  # so that cues must speak for themselves
    capital = x[:, [_CAPITALISED]]
    w, chain, skip, named = np.zeros((N_FEATURES, L)), np.zeros((L, L)), np.zeros((L, L)), np.zeros((L, L))
    parts = ((skip, near * (1 - capital)), (named, near * capital))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, chain, skip, named)]
    for t in range(1, steps + 1):
        z = x @ w + left @ chain + right @ chain.T + sum(n @ p for p, n in parts)
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        g = (p - y) / len(y)
        grads = [x.T @ g + 1e-5 * w, left.T @ g + g.T @ right + 1e-4 * chain]
        for own, n in parts:
            both = g.T @ n
            grads.append((both + both.T) / 2 + 1e-4 * own)
        for param, grad, (m, v) in zip((w, chain, skip, named), grads, state):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Field(w, chain, skip, named)


_field: list[Field] = []


def field() -> Field:
    """The fitted field; it is the same in every process, and fitted once in each."""
    if not _field:
        _field.append(fit())
    return _field[0]


def entities(own: Field, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, label, probability) of each text's entities."""
    ready = [prepared(t) if t else ([], [], [], []) for t in texts]
    some = [i for i, r in enumerate(ready) if r[0]]
    out: list = [[] for _ in texts]
    for start in range(0, len(some), 512):
        part = some[start : start + 512]
        for i, p in zip(part, own.marginals([ready[k][1:] for k in part])):
            spans, joined, best = ready[i][0], ready[i][2], p.argmax(1)
            got: list = []
            for k, (a, b) in enumerate(spans):
                if not best[k]:
                    continue
                label, prob = LABELS[best[k]], float(p[k, best[k]])
                text = texts[i]
                if got and joined[k] and got[-1][2] == label and label in JOINED and best[k - 1] == best[k]:
                    if sum(c.isdigit() for c in text[got[-1][0] : b]) <= JOINED[label]:
                        got[-1] = (got[-1][0], b, label, min(got[-1][3], prob))
                        continue
                got.append((a, b, label, prob))
            out[i] = got
    return out


def redact(text: str, found: list[tuple[int, int, str, float]]) -> str:
    parts, at = [], 0
    for a, b, label, _ in found:
        parts += [text[at:a], f"<{label}>"]
        at = b
    return "".join(parts) + text[at:]


_TYPE = "struct<entities:array<struct<start:int,end:int,label:string,probability:double>>,redacted:string>"
_ENTITY = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("probability", pa.float64())])


def finder(own: Field):
    @F.arrow_udf(_TYPE)
    def find(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        got = entities(own, values)
        rows = [[dict(zip(("start", "end", "label", "probability"), e)) for e in g] for g in got]
        new = [redact(t, g) if g else None for t, g in zip(values, got)]
        return pa.StructArray.from_arrays([pa.array(rows, pa.list_(_ENTITY)), pa.array(new, pa.string())], ["entities", "redacted"])

    return find


def found(text: Column, own: Field | None = None) -> Column:
    """Struct (entities, redacted); only texts with a digit, an at sign or a cue for names go to Python. redacted is null if nothing is found."""
    text = text.cast("string")
    return finder(own or field())(F.when(text.rlike("[0-9@]") | text.rlike(NAME_CUE), text))


def find_pii(docs: DataFrame, own: Field | None = None) -> DataFrame:
    """(doc_id, entities, redacted) of each row."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), found(F.col("text"), own).alias("r"))
    none = F.array().cast("array<struct<start:int,end:int,label:string,probability:double>>")
    return rows.select("doc_id", F.coalesce("r.entities", none).alias("entities"), F.coalesce("r.redacted", "text").alias("redacted"))


def mask_pii(docs: DataFrame, own: Field | None = None) -> DataFrame:
    """The documents with entities replaced by their labels, and n_chars following."""
    rows = row_of(docs).withColumn("r", found(F.col("row.text"), own))
    kinds = dict(docs.dtypes)
    new = {"text": F.coalesce("r.redacted", F.col("row.text").cast("string")).cast(kinds["text"])}
    if "n_chars" in kinds:
        new["n_chars"] = F.when(F.col("r.redacted").isNotNull(), F.length("r.redacted")).otherwise(F.col("row.n_chars")).cast(kinds["n_chars"])
    return unrow(rows, docs.columns, **new)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and redacted text of every document."""
    return find_pii(table(spark, sf_dir, "documents"))


QUERIES = {"op7_skip_chain_pii": op7}
SQL: dict[str, str] = {}
