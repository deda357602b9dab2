"""Secrets by dictionary-primed compression.

Candidates are values in a sensitive context: assigned to a name such as token or
password, following the word Bearer, inside a URL's credentials, or begun by a
known key prefix. A candidate's novelty is the number of bytes by which it
lengthens the zstandard frame of its surroundings, the compressor being primed
with a dictionary of placeholders and of the identifiers that recur in the table.
As a frame's length moves by some bytes with its other contents, the novelty is
the median over surroundings of WINDOWS characters on either side. What neither
the surroundings nor the dictionary explain costs most of its length and is
reported; names, placeholders and words of the text cost little.

Occurrences of the candidate itself are taken out of its surroundings, so that a
repeated secret isn't explained by its repetition. Candidates never enter the
dictionary, whose identifiers are those of all texts with a sensitive context:
the most frequent ones, by the number of documents, that fit DICTIONARY_BYTES.

Defined cases: null and empty texts have no candidates. Texts are scanned whole.
Repeated rows are scanned alike. A value that more than one pattern finds is one
candidate, of the pattern named first. An assigned value in quotes goes to the
closing quote on its line, whatever it holds; if it has white space, it may hold
other candidates. One without quotes has letters, digits and +/_.~!@^=- only.
Values have eight characters at least. An empty table gives no rows. Values
aren't returned, only their place (code points), length and SHA-256. Other
columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

WINDOWS = (50, 100, 200, 400, 800)
LEVEL = 19
#: A value is reported if its marginal bytes reach LEAST_BYTES and LEAST_RATIO for each of its characters.
LEAST_BYTES = 2.0
LEAST_RATIO = 0.55
#: Identifiers of the dictionary occur in so many documents at least, and have so many bytes in all at most.
LEAST_DOCUMENTS = 3
DICTIONARY_BYTES = 32 << 10

_NAMES = r"token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|secret[_-]?key|encryption[_-]?key|credential|authorization|auth[_-]?key|client[_-]?secret|signing[_-]?key"
_VALUE = r"[A-Za-z0-9+/_.~!@^-]{7,}[A-Za-z0-9+/=_~-]"
#: A whole word that holds a name, and what sets off its value; neither is gone through twice.
_ASSIGNED = rf"(?i)(?>(?<![A-Za-z0-9_])[A-Za-z0-9_]*?(?:{_NAMES})[A-Za-z0-9_]*+)[^A-Za-z0-9\n:=]*+[:=]"
#: Opened by one quote, or three, escaped or not, and closed by the same on its line.
_QUOTED = r"(?P<q>\\?(?:\x22{3}|'{3}|[\x22'`]))(?P<v>(?:(?!(?P=q))(?:\\[^\n]|[^\\\n])){8,}+)(?P=q)"
PATTERNS = (
    ("assignment", re.compile(rf"{_ASSIGNED}[^A-Za-z0-9\n\x22'`\\]*+{_QUOTED}")),
    ("assignment", re.compile(rf"{_ASSIGNED}[^A-Za-z0-9\n]*?(?P<v>{_VALUE})")),
    ("bearer", re.compile(r"(?i)\bbearer\s+(?P<v>[A-Za-z0-9+/=_.~-]{12,})")),
    ("url", re.compile(r"://[^\s/:@]++:(?P<v>[^\s/:@]{8,}+)@")),
    ("prefix", re.compile(r"\b(?P<v>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abpr]-[A-Za-z0-9-]{20,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{30,})")),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----\s(?P<v>[A-Za-z0-9+/=\s]{40,}+)-----END")),
)
#: Only texts that match go to Python.
SCREEN = rf"(?i)(?:{_NAMES})|bearer|://[^\s/:@]+:|AKIA|ASIA|gh[pousr]_|xox[abpr]-|sk-|AIza|PRIVATE KEY"
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,63}")

IDENTIFIERS = " ".join(
    """
    token secret password passwd passphrase credential authorization bearer username user_name account client server session cookie
    api_key apikey access_key private_key secret_key client_secret client_id auth_token access_token refresh_token id_token csrf_token
    your_token_here your-api-key your_api_key_here insert_key_here replace_me changeme change_me CHANGEME placeholder example examples sample
    dummy test testing tester test1234 password123 password1 letmein welcome default defaults none null undefined true false empty redacted REDACTED
    xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXX 00000000000000000000000000000000 11111111111111111111 ****************
    0123456789abcdef 0123456789ABCDEF abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 1234567890 deadbeef deadbeefdeadbeef qwertyuiop
    os.environ os.getenv process.env getenv environ config settings secrets vault keyring value values string String std::string const
    get_token get_password get_secret fetch_token load_secret read_password decrypt encrypt generate_key self request response headers payload params kwargs
    localhost example.com example.org http https www index main function return import export class object number boolean integer static public private
    database connection host port schema table column select insert update delete timeout retry enabled disabled development production staging
    """.split()
).encode()

_compressors: dict = {}


def _compressor(learned: bytes):
    if learned not in _compressors:
        import zstandard

        words = b" ".join((IDENTIFIERS.upper(), IDENTIFIERS, learned))
        primed = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        _compressors.clear()
        _compressors[learned] = zstandard.ZstdCompressor(dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
    return _compressors[learned]


def novelty(text: str, a: int, b: int, learned: bytes = b"") -> int:
    """Bytes by which text[a:b] lengthens its compressed surroundings: the median over their sizes."""
    c, value, costs = _compressor(learned), text[a:b], []
    for w in WINDOWS:
        base = (text[max(0, a - w) : a] + " " + text[b : b + w]).replace(value, " ").encode("utf-8", "replace") + b"\n"
        costs.append(len(c.compress(base + value.encode("utf-8", "replace"))) - len(c.compress(base)))
    return max(0, sorted(costs)[len(costs) // 2])


class _Taken:
    """Spans that don't cross: those with white space may hold others, which begin after them."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.phrases: tuple[list[int], list[int]] = ([], [])

    def crosses(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, a)
        if i and self.ends[i - 1] > a or i < len(self.starts) and self.starts[i] < b:
            return True
        starts, ends = self.phrases
        i = bisect_left(starts, a)
        return i < len(starts) and starts[i] == a

    def add(self, a: int, b: int, phrase: bool) -> None:
        starts, ends = self.phrases if phrase else (self.starts, self.ends)
        i = bisect_left(starts, a)
        starts.insert(i, a)
        ends.insert(i, b)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, pattern) of each candidate, in order."""
    taken, out = _Taken(), []
    for kind, pattern in PATTERNS:
        at = 0
        while m := pattern.search(text, at):
            a, b = m.span("v")
            at = max(b, m.start() + 1)
            if kind == "pem":
                a, b = b - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())
            if a >= b:
                continue
            if not taken.crosses(a, b):
                phrase = "q" in m.groupdict() and any(c.isspace() for c in text[a:b])
                taken.add(a, b, phrase)
                out.append((a, b, kind))
                if phrase:
                    at = a
    return sorted(out)


def identifiers(text: str, places: list[tuple[int, int]]) -> set[str]:
    """The identifiers outside the places."""
    parts, at = [], 0
    for a, b in places:
        parts.append(text[at:a])
        at = max(at, b)
    return set(_IDENTIFIER.findall("\0".join([*parts, text[at:]])))


def scan(text: str | None, learned: bytes = b"") -> list[tuple[int, int, str, int, float, bool, str]]:
    """(start, end, pattern, marginal bytes, bytes a character, reported, SHA-256) of each candidate."""
    out = []
    for a, b, kind in candidates(text) if text else ():
        value = text[a:b]
        cost = novelty(text, a, b, learned)
        told = cost >= LEAST_BYTES + LEAST_RATIO * len(value) and any(c.isalnum() for c in value)
        out.append((a, b, kind, cost, round(cost / len(value), 6), told, hashlib.sha256(value.encode("utf-8", "replace")).hexdigest()))
    return out


_FIELDS = ("start", "end", "pattern", "marginal_bytes", "ratio", "reported", "sha256")
_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.string()), ("marginal_bytes", pa.int32()), ("ratio", pa.float64()), ("reported", pa.bool_()), ("sha256", pa.string())]))


_DDL = "array<struct<start:int,end:int,pattern:string,marginal_bytes:int,ratio:double,reported:boolean,sha256:string>>"


def _named(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts.to_pylist():
        out.append(sorted(identifiers(t, [(a, b) for a, b, _ in candidates(t)])))
    return pa.array(out, pa.list_(pa.string()))


def learn(screened: DataFrame) -> bytes:
    """The table's identifiers, the most frequent last, as these are the cheapest to refer to."""
    names = screened.select("doc_id", F.explode(F.arrow_udf(_named, "array<string>")("text")).alias("name"))
    often = names.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_DOCUMENTS).orderBy(F.desc("n"), "name").limit(DICTIONARY_BYTES // 4)
    held, size = [], 0
    for r in often.collect():
        size += len(r["name"]) + 1
        if size > DICTIONARY_BYTES:
            break
        held.append(r["name"])
    return " ".join(reversed(held)).encode()


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, pattern, marginal_bytes, ratio, reported, sha256) of every candidate."""
    text = F.col("text").cast("string")
    screened = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).filter(F.col("text").rlike(SCREEN)))
    learned = learn(screened)

    def scanned(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(_FIELDS, c)) for c in scan(t, learned)] for t in texts.to_pylist()], _TYPE)

    return screened.select("doc_id", F.explode(F.arrow_udf(scanned, _DDL)("text")).alias("c")).select("doc_id", "c.*")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the whole of documents, with their novelty."""
    return find_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op2_compression_secrets": op2}
SQL: dict[str, str] = {}
