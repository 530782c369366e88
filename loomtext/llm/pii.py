"""Personal data: regular expressions propose spans, validators confirm, context words score."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In the order in which kinds are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "dni", "nir", "secret")
BASE = KINDS[:4]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match can begin only where a run of digits begins, so looking behind keeps long runs linear
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DNI = re.compile(r"(?<![A-Za-z0-9])(?:[0-9]{8}|[XYZ][0-9]{7})-?[A-Z](?![A-Za-z0-9])")
NIR = re.compile(r"(?<![0-9])[12] ?[0-9]{2} ?[0-9]{2} ?(?:[0-9]{2}|2[AB]) ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![0-9])")
# Check letters of Spanish identity numbers, by remainder; forms of published key formats.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
KEY_FORMS = re.compile(
    r"AKIA[0-9A-Z]{16}(?![0-9A-Z])|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"
    r"|-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"
)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
ASSIGNED = re.compile(r"[:=]\s{0,3}[\"'`]?\Z")
#: Bits a character that a run of letters and digits needs to look like a key.
LEAST_BITS = 3.0
#: Words near a span that raise its score.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social", "security"),
    "dni": ("dni", "nie", "nif", "documento", "identidad"),
    "nir": ("nir", "sécurité", "sociale", "insee"),
    "secret": ("token", "secret", "key", "passw", "pwd", "auth", "bearer", "credential"),
}
#: Score of a confirmed span without context, and what context adds.
SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "dni": 0.4, "nir": 0.6, "secret": 0.3}
NEAR, RAISE, LEAST = 40, 0.2, 0.5
#: Score of a key in a published form, and what an assignment in front of an opaque run adds.
KNOWN_KEY, ASSIGNMENT = 0.9, 0.1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Country code and check digits moved to the end, letters as 10 to 35: remainder 1."""
    code = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in code)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What the pattern matches, found from each @ to both sides: linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the spans that any scoring keeps."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return out


def ibans(text: str) -> list[tuple[int, int, int]]:
    """The longest valid start of each match that ends at one of its words: what follows may look alike."""
    out, m = [], IBAN.search(text)
    while m:
        code, end = m[0], 0
        while code and not end:
            if 15 <= len(c := code.replace(" ", "")) <= 34 and mod97(c):
                end = m.start() + len(code)
                out.append((m.start(), 4, end))
            code = code.rpartition(" ")[0]
        m = IBAN.search(text, end or m.start() + 1)
    return out


def dni(code: str) -> bool:
    """The letter is the one of the number's remainder by 23; X, Y and Z stand for 0, 1 and 2."""
    code = code.replace("-", "")
    return DNI_LETTERS[int(code[:-1].translate({88: "0", 89: "1", 90: "2"})) % 23] == code[-1]


def nir(code: str) -> bool:
    """The last two digits are 97 less the remainder of the others; 2A and 2B count as 19 and 18."""
    code = code.replace(" ", "").replace("2A", "19").replace("2B", "18")
    return 97 - int(code[:-2]) % 97 == int(code[-2:])


def opaque(run: str) -> bool:
    """Letters and digits, as mixed as in a key."""
    if run.isalpha() or not any(c.isdigit() for c in run) or not any(c.isalpha() for c in run):
        return False
    n = len(run)
    return -sum(k / n * log2(k / n) for k in Counter(run).values()) >= LEAST_BITS


def secrets(text: str) -> Iterator[tuple[int, int, int, float]]:
    """Keys in published forms, and opaque runs that no such key holds, with their score before context."""
    end = 0
    known = [m.span() for m in KEY_FORMS.finditer(text)]
    for a, b in known:
        yield a, KINDS.index("secret"), b, KNOWN_KEY
    for m in OPAQUE.finditer(text):
        while known and known[0][1] <= m.start():
            end = known.pop(0)[1]
        if m.start() >= end and not (known and known[0][0] < m.end()) and opaque(m[0]):
            more = ASSIGNMENT if ASSIGNED.search(text, max(0, m.start() - 5), m.start()) else 0.0
            yield m.start(), KINDS.index("secret"), m.end(), SCORE["secret"] + more


def more_spans(text: str) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, score before context) of the kinds that are not in the base."""
    out = [(a, k, b, SCORE[KINDS[k]]) for a, k, b in ibans(text)]
    out += [(m.start(), 5, m.end(), SCORE["ssn"]) for m in SSN.finditer(text)]
    out += [(m.start(), 6, m.end(), SCORE["dni"]) for m in DNI.finditer(text) if dni(m[0])]
    out += [(m.start(), 7, m.end(), SCORE["nir"]) for m in NIR.finditer(text) if nir(m[0])]
    return out + list(secrets(text))


def scored(text: str, spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Context raises scores. Base spans stay whatever theirs is; of the others, those at LEAST or more."""
    out = []
    for start, kind, end, score in spans:
        near = f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}".lower()
        score = round(min(1.0, score + RAISE * any(w in near for w in CONTEXT[KINDS[kind]])), 2)
        if kind < len(BASE) or score >= LEAST:
            out.append((start, kind, end, score))
    return out


def find_spans(text: str | None) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, score) in code points, by start and kind."""
    return scored(text, sorted([(a, k, b, SCORE[KINDS[k]]) for a, k, b in base_spans(text)] + more_spans(text))) if text else []


def joined(spans: list[tuple[int, int, int, float]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("score", pa.float64())]))


def spans_of(texts: pa.Array) -> pa.Array:
    """Spans of personal data of each text; null and empty texts have none."""
    return pa.array([[{"start": s, "kind": KINDS[k], "end": e, "score": x} for s, k, e, x in find_spans(t.as_py())] for t in texts], SPAN_TYPE)


def detect(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``spans`` (array of start, kind, end, score), one row for each row of ``docs``."""
    found = F.arrow_udf(spans_of, "array<struct<start bigint, kind string, end bigint, score double>>")
    return docs.select(*keep, found(F.col(text)).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span (overlapping ones merged) replaced by ``[kind]`` of its first."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            parts, at = [], 0
            for s, k, e, _ in find_spans(t):
                if s >= at:
                    parts += [t[at:s], f"[{KINDS[k]}]"]
                at = max(at, e)
            out.append("".join(parts) + t[at:] if parts else t)
        return pa.array(out, pa.string())

    return docs.withColumn(text, clean(F.col(text)))


def digest(spans: DataFrame) -> DataFrame:
    """The counts, the hash of the base spans, all spans as one string, their number and scores."""
    item = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform(base, item), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", item), ",").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )


def digest_of(text: str | None) -> str:
    """Plain-Python twin of base_sha256, for tests."""
    return hashlib.sha256(joined([s for s in find_spans(text) if s[1] < len(BASE)]).encode()).hexdigest()
