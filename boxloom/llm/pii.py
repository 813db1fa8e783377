"""Personal data by anchor expansion.

One Aho-Corasick pass finds the anchors: at-signs, plus signs, digits, address schemes and
identifier cues.  At each anchor a small parser, chosen by the anchor's kind, expands to the
left and right and validates what it got.  Base kinds give exactly the leftmost non-overlapping
matches of their patterns (matches that fail validation are dropped, without retries):

* email: a local part up to the at-sign, then two or more labels;
* ip: four dotted numbers of at most 255;
* card: 16 to 19 digits, single spaces or hyphens between them, passing the Luhn sum;
* phone: a plus sign and 8 to 15 digits with the usual separators.

Four kinds are added on top:

* url: an ``http``, ``https``, ``ftp`` or ``mailto`` scheme in any case, up to white space or a quote,
  without closing punctuation;
* account: a cue such as ``account`` or ``passport``, then a token of 6 to 34 letters, digits and
  hyphens with at least 4 digits;
* iban: two letters, two digits and 11 to 30 letters and digits, in blocks of four or together, that
  pass the check-digit sum modulo 97;
* secret: a cue such as ``token``, ``password`` or ``api_key``, an equals sign or colon, and a value; or a
  prefix by which a provider marks its keys.  Values of other cues than passwords have 16 characters or
  more, both letters and digits.

Positions are code points, ends exclusive.  Null and empty texts have no spans.  Repeated rows
are treated alike.  Texts are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import text_or_empty

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "account", "iban", "secret")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("account", "acct", "passport", "ssn", "customer id", "user id")
SECRETS = ("token", "secret", "api_key", "api key", "apikey", "access_key", "access key", "private_key", "bearer")
PASSWORDS = ("password", "passwd", "pwd", "passphrase")
#: Prefixes of providers' keys.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_RUN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s\"'<>]+")
_ACCOUNT = re.compile(r"(?:\s*(?:number|no\.?|nr\.?|id))?\s*[:#=]?\s*([A-Za-z0-9](?:-?[A-Za-z0-9]){5,33})(?![A-Za-z0-9])", re.I)

_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SECRET = re.compile(r"[\"']?\s*(?:=>|:=|=|:)\s*[\"']?([A-Za-z0-9+/_.~-]{16,}=*)")
_BEARER = re.compile(r"\s+([A-Za-z0-9+/_.~-]{16,}=*)")
_PASSWORD = re.compile(r"[\"']?\s*(?:=>|:=|=|:)\s*(?:\"([^\"\s]{4,})\"|'([^'\s]{4,})'|([^\s\"',;]{4,}))")
_TAIL = re.compile(r"[A-Za-z0-9_-]{12,}")


def mod97(iban: str) -> bool:
    """Whether the check digits of an IBAN without spaces are right."""
    return 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    for d in "0123456789":
        a.add_word(d, ("d", 1))
    for words, kind in ((SCHEMES, "s"), (CUES, "c"), (SECRETS, "k"), (PASSWORDS, "p")):
        for w in words:
            a.add_word(w.lower(), (kind, len(w)))
    # these are found in small letters too, then compared as written
    for w in PREFIXES:
        a.add_word(w.lower(), ("x", len(w)))
    a.make_automaton()
    return a


class Finder:
    """One per task."""

    def __init__(self):
        self.anchors = _anchors()

    @staticmethod
    def _iban_end(m: re.Match) -> int:
        """Where the longest part that passes the sum ends, cut at a space; zero if none does."""
        end = m.end()
        while end - m.start() >= 15:
            if mod97(m.string[m.start() : end].replace(" ", "")):
                return end
            end = m.string.rfind(" ", m.start(), end)
        return 0

    def spans(self, text: str) -> dict[str, list[tuple[int, int]]]:
        """The spans of every kind, in order."""
        out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE + ADDED}
        email_end = ip_end = run_end = digit_end = phone_end = url_end = iban_end = secret_end = 0
        size = len(text)
        low = text.lower()
        if len(low) != size:  # some capitals have two small letters
            low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
        for last, (kind, length) in self.anchors.iter(low):
            at = last - length + 1
            if kind == "d":
                if at >= digit_end:  # the first digit of a run of digits
                    digit_end = at + 1
                    while digit_end < size and text[digit_end] in _DIGITS:
                        digit_end += 1
                    if digit_end < size and text[digit_end] == "." and digit_end > ip_end and (m := _QUAD.match(text, max(at, ip_end))):
                        ip_end = m.end()
                        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                            out["ip"].append(m.span())
                    if at >= max(2, iban_end) and text[at - 2 : at].isupper() and (at == 2 or not text[at - 3].isalnum()) and (m := _IBAN.match(text, at - 2)) and (end := self._iban_end(m)):
                        out["iban"].append((at - 2, end))
                        iban_end = end
                    if at >= run_end and (m := _RUN.match(text, at)):
                        run_end = m.end()
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 16 <= len(digits) <= 19 and luhn(digits):
                            out["card"].append(m.span())
            elif kind == "@":
                start = at
                while start > email_end and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    email_end = m.end()
                    out["email"].append((start, email_end))
            elif kind == "+":
                if at >= phone_end and (m := _PHONE.match(text, at)):
                    phone_end = m.end()
                    if 8 <= sum(map(m[0].count, _DIGITS)) <= 15:
                        out["phone"].append(m.span())
            elif kind == "s":
                if at >= url_end and (m := _URL.match(text, last + 1)):
                    end = last + 1 + len(m[0].rstrip(".,;:!?)]}"))
                    if end > last + 1:
                        url_end = end
                        out["url"].append((at, end))
            elif kind in "kpx":
                # a cue may end a longer name, such as access_token; a prefix begins a word
                m = None
                if at >= secret_end and kind == "x" and text[at : last + 1] in PREFIXES and (at == 0 or not text[at - 1].isalnum()):
                    m = _TAIL.match(text, last + 1)
                elif at >= secret_end and kind != "x" and (at == 0 or not text[at - 1].isalpha()):
                    m = _PASSWORD.match(text, last + 1) if kind == "p" else _SECRET.match(text, last + 1) or (_BEARER.match(text, last + 1) if text[at : last + 1].lower() == "bearer" else None)
                if m:
                    start, end = (at, m.end()) if kind == "x" else m.span(m.lastindex)
                    value = text[start:end]
                    if kind == "p" or (any(map(str.isdigit, value)) and any(map(str.isalpha, value))):
                        out["secret"].append((start, end))
                        secret_end = end
            elif (at == 0 or not text[at - 1].isalnum()) and (m := _ACCOUNT.match(text, last + 1)) and sum(map(m[1].count, _DIGITS)) >= 4:
                if not out["account"] or out["account"][-1][1] <= m.start(1):
                    out["account"].append(m.span(1))
        return out


def _listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, per kind the count of spans, their sum n_spans, a digest of the base spans, and all spans."""
    kinds = ",".join(f"n_{k}:long" for k in (*BASE, *ADDED, "spans"))

    @F.pandas_udf(f"struct<{kinds},base_sha256:string,spans:string>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = Finder()
        for s in texts:
            found = [finder.spans(t) for t in s]
            counts = {f"n_{k}": [len(f[k]) for f in found] for k in BASE + ADDED} | {"n_spans": [sum(map(len, f.values())) for f in found]}
            base = [hashlib.sha256(_listed(f, BASE).encode()).hexdigest() for f in found]
            yield pd.DataFrame(counts | {"base_sha256": base, "spans": [_listed(f, BASE + ADDED) for f in found]})

    return docs.select(F.col(id_col), run(text_or_empty(text_col)).alias("f")).select(id_col, "f.*")


def mask(docs: DataFrame, text_col: str = "text", out: str = "masked") -> DataFrame:
    """Adds ``out``: the text with each span replaced by its kind in angle brackets.

    Overlapping spans are replaced together, under the kind of the one that starts first.
    """

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder()
        for s in texts:
            masked = []
            for t in s:
                parts, done = [], 0
                for a, b, k in sorted((a, -b, k) for k, v in finder.spans(t).items() for a, b in v):
                    b = -b
                    if a >= done:
                        parts += [t[done:a], f"<{k}>"]
                    done = max(done, b)
                masked.append("".join(parts) + t[done:])
            yield pd.Series(masked)

    return docs.withColumn(out, run(text_or_empty(text_col)))
