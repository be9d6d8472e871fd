"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text: at-signs, plus signs, digits, schemes and identifier
cues. A deterministic parser per anchor expands to both sides and validates what it found, so the cost is one
linear scan plus the length of the candidates.

Kinds, in output order: email, ip, card and phone are the base kinds; `address` (a URL that carries a user and
password) and `account` (an IBAN with a valid check number, a US social security number or a random key behind
a cue word) are added by the cue parsers. Spans are code point offsets, end exclusive. Spans of one kind never
overlap. A null or empty text has no span.
"""

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account")
DIGITS = frozenset("0123456789")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL = DIGITS | LETTERS | frozenset("._%+-")
LABEL = DIGITS | LETTERS | frozenset("-")
PHONE_INNER = DIGITS | frozenset(" ().-")

# Words that announce an account number or a key.
CUES = ("iban", "ssn", "social security", "account", "acct", "token", "secret", "api_key", "apikey", "api key", "password")
SCHEMES = ("http://", "https://", "ftp://")
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}")
SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
KEY = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_URL = re.compile(r"""[^ \t\n\r\x0b\x0c"'<>|\\^`{}]*""")
_AUTHORITY = re.compile(r"""[^ \t\n\r\x0b\x0c"'<>|\\^`{}/?#]*""")
CUE_GAP = re.compile(r"""[\s:=#"'()-]{0,12}""")

SPAN = T.StructType().add("kind", "string").add("start", "integer").add("end", "integer")
DIGEST = T.StructType([T.StructField(f"n_{kind}", T.LongType()) for kind in BASE_KINDS]).add("base_sha256", "string").add("spans", "string")
for _name in ("n_address", "n_account", "n_spans"):
    DIGEST = DIGEST.add(_name, "long")


@lru_cache
def _anchors():
    automaton = ahocorasick.Automaton()
    for digit in sorted(DIGITS):
        automaton.add_word(digit, ("digit", 1))
    automaton.add_word("@", ("email", 1))
    automaton.add_word("+", ("phone", 1))
    for scheme in SCHEMES:
        automaton.add_word(scheme, ("address", len(scheme)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            automaton.add_word(form, ("account", len(form)))
    automaton.make_automaton()
    return automaton


def luhn(digits):
    """True when the check digit of a digit string is right."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def iban_end(value):
    """Length of the longest beginning of a text that has the check sum of an international account number, or 0.

    The number behind the first four characters is brought forward character by character, so one pass tries all ends.
    """
    head, rest, size, best = "", 0, 0, 0
    for i, character in enumerate(value):
        if character == " ":
            continue
        size += 1
        if size > 34:
            break
        if size <= 4:
            head += str(int(character, 36))
            continue
        number = int(character, 36)
        rest = (rest * (100 if number > 9 else 10) + number) % 97
        if size >= 15 and (rest * 10 ** len(head) + int(head)) % 97 == 1:
            best = i + 1
    return best


def _run(text, at, allowed):
    while at < len(text) and text[at] in allowed:
        at += 1
    return at


def _email(text, at, floor):
    """(start, end, valid) of the address around the at-sign, or None."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in LABEL:
        end = _run(text, end + 1, LABEL)
        labels += 1
    return (start, end, True) if labels else None


def _ip(text, at):
    """Four dotted numbers from the first digit; valid when none is above 255."""
    parts, end = [], at
    while True:
        begin, end = end, _run(text, end, DIGITS)
        parts.append(text[begin:end].lstrip("0"))
        if len(parts) == 4:
            return at, end, all(len(part) <= 3 and int(part or 0) <= 255 for part in parts)
        if not (end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS):
            return None
        end += 1


def _card(text, at):
    """Digits with single spaces or hyphens between them; valid with 16 to 19 digits and a right check digit."""
    end, size, digits = at + 1, len(text), [text[at]]
    while end < size:
        if text[end] in DIGITS:
            digits.append(text[end])
            end += 1
        elif text[end] in " -" and end + 1 < size and text[end + 1] in DIGITS:
            digits.append(text[end + 1])
            end += 2
        else:
            break
    if len(digits) < 2:
        return None
    return at, end, 16 <= len(digits) <= 19 and luhn(digits)


def _phone(text, at):
    """A plus sign, a digit, inner characters and a last digit; valid with 8 to 15 digits."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = _run(text, at + 2, PHONE_INNER)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3:
        return None
    return at, end, 8 <= sum(c in DIGITS for c in text[at:end]) <= 15


def _address(text, at, begin):
    """A URL whose authority carries a user and a password; the authority ends at the first slash, mark or space."""
    stop = _AUTHORITY.match(text, begin).end()
    user, sign, host = text[begin:stop].rpartition("@")
    if not sign or ":" not in user or not host:
        return None
    return at, _URL.match(text, stop).end(), True


def _account(text, begin, barren):
    """((start, end, valid) of the value behind a cue word or None, and the end of a run of key characters without a digit).

    No value starts within such a run, so the cues in it (from `barren`, where the last one ended) are passed over.
    """
    begin = CUE_GAP.match(text, begin).end()
    if begin < barren:
        return None, barren
    if match := SSN.match(text, begin):
        return (begin, match.end(), True), barren
    if (match := IBAN.match(text, begin)) and (size := iban_end(match.group())):
        return (begin, begin + size, True), barren
    if match := KEY.match(text, begin):
        if DIGITS.isdisjoint(match.group()):
            return None, match.end()
        if not LETTERS.isdisjoint(match.group()):
            return (begin, match.end(), True), barren
    return None, barren


def find_spans(text):
    """All valid (kind, start, end) of a text, ordered by kind and start."""
    found = {kind: [] for kind in KINDS}
    if not text:
        return []
    past, barren = dict.fromkeys(KINDS, 0), 0  # per kind, where the last candidate ended

    def take(kind, candidate):
        if candidate:
            start, end, valid = candidate
            past[kind] = end
            if valid:
                found[kind].append((kind, start, end))

    for last, (kind, length) in _anchors().iter(text):
        at = last + 1 - length
        if kind == "digit":
            if at >= past["card"]:
                take("card", _card(text, at))
            if at >= past["ip"] and (at == 0 or at == past["ip"] or text[at - 1] not in DIGITS):
                take("ip", _ip(text, at))
        elif at < past[kind]:
            continue
        elif kind == "email":
            take(kind, _email(text, at, past[kind]))
        elif kind == "phone":
            take(kind, _phone(text, at))
        elif kind == "address":
            take(kind, _address(text, at, last + 1))
        else:
            candidate, barren = _account(text, last + 1, barren)
            take(kind, candidate)
    return [span for kind in KINDS for span in found[kind]]


def span_text(spans):
    """`kind:start:end`, comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def masked(text):
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one mark."""
    spans = sorted(find_spans(text), key=lambda span: (span[1], -span[2]))
    pieces, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            pieces += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(pieces) + text[at:] if spans else text


@F.pandas_udf(T.ArrayType(SPAN))
def personal_data(texts: pd.Series) -> pd.Series:
    """Spans of each text; an empty list for null."""
    return texts.map(lambda text: [{"kind": k, "start": s, "end": e} for k, s, e in find_spans(text)])


@F.pandas_udf(T.StringType())
def without_personal_data(texts: pd.Series) -> pd.Series:
    """Each text with its personal data masked; null stays null."""
    return texts.map(lambda text: text and masked(text))


@F.pandas_udf(DIGEST)
def _digest(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        spans = find_spans(text)
        base = [span for span in spans if span[0] in BASE_KINDS]
        counts = [sum(span[0] == kind for span in base) for kind in BASE_KINDS]
        added = [sum(span[0] == kind for span in spans) for kind in KINDS[len(BASE_KINDS) :]]
        rows.append((*counts, hashlib.sha256(span_text(base).encode()).hexdigest(), span_text(spans), *added, len(spans)))
    return pd.DataFrame(rows, columns=DIGEST.names).astype({name: "int64" for name in DIGEST.names if name.startswith("n_")})


def span_digest(docs):
    """Per document: doc_id, the counts of the base kinds, a digest of the base spans, all spans as text and their counts.

    Null text counts as empty (no span, the digest of the empty string). Repeated rows give repeated rows,
    other columns are ignored, an empty table gives no row.
    """
    return docs.select("doc_id", _digest("text").alias("found")).select("doc_id", "found.*")


def mask_documents(docs):
    """Documents with personal data masked in `text` and `n_chars` set to the new length; all rows stay.

    A null text stays null, with n_chars null. Columns besides `text` and `n_chars` pass unchanged.
    """
    names = docs.columns
    clean = docs.withColumn("text", without_personal_data("text"))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(names) if "n_chars" in names else clean
