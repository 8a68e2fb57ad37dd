"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, ``://`` and identifier cues
(``token``, ``iban``, ``account`` ...). A deterministic parser at each anchor expands to the left and to the right and
validates. Parsers are anchored at one position and skip what they have read, so a text costs time in
proportion to its length.

Base kinds, leftmost and non-overlapping per kind, a failing match is dropped:

* email  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip     four dotted numbers, each at most 255
* card   digits with at most one space or hyphen between two, 13 to 19 digits, Luhn
* phone  ``\\+[0-9][\\x20().0-9-]+[0-9]``, 9 to 15 digits

Added kinds: login (user and password in a URL), iban (check number 97), secret (a private key block; a key with a
published prefix such as ``AKIA`` or ``ghp_``; the token after ``Bearer``; a value with letters and digits
given to a cue such as ``token``, with at most 8 spaces or tabs on each side of the ``=`` or ``:``: 16 or more code points, or
8 or more after a password cue), account (6 to 18 digits after a cue). Cues are found in any case and may be
quoted keys. A password ends at white space, a quote or, where none opened it, at one of ``,;&<>``. Their spans are whole: no length ends a login, secret or account number early.

Spans are in code points, end exclusive, ordered by kind as listed, then start.

Defined cases: a null or empty text has no spans; overlapping kinds are all reported (a card may lie in an
account); repeated rows get equal results; an empty table gives an empty result; other columns are
ignored. Nothing is shuffled; memory is one Arrow batch.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ledgerlens.llm.common import small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "iban", "secret", "account")

# fixed values: cues
SECRET_CUES = ("token", "secret", *(f"{a}{joint}key" for a in ("api", "access", "private", "auth", "secret") for joint in ("_", "-", "")))
PASSWORD_CUES = ("password", "passwd", "pwd")
# cues in lower case: the written form is checked by _PREFIXED
PREFIX_CUES = ("akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xoxb-", "xoxp-", "xoxa-", "xoxs-", "sk_live_", "rk_live_")
ACCOUNT_CUES = ("account", "acct", "konto", "kontonummer", "cuenta", "compte")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_NUMBER = re.compile(r"[0-9]++")
_IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_USERINFO = re.compile(r"[^\s/?#@:]++:[^\s/?#@]++@[A-Za-z0-9.-]++")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}(?![A-Za-z0-9])|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3}(?![A-Za-z0-9]))?)")
_GIVEN = re.compile(r"[\"'`]?[\x20\t]{0,8}[=:][\x20\t]{0,8}([\"'`]?)")
_SECRET = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}+")
_PREFIXED = re.compile(r"(?:A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+|xox[bpas]-[A-Za-z0-9-]{10,}+|[sr]k_live_[A-Za-z0-9]{16,}+)(?![A-Za-z0-9])")
_BEARER = re.compile(r"[\x20\t]{1,8}([A-Za-z0-9+/_=.~-]{16,}+)")
_KEY_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----(?:\s*+[A-Za-z-]++:[^\n]*+\n)*+(?:\s*+[A-Za-z0-9+/=]++)*+(?:\s*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----)?")
_PASSWORD = re.compile(r"[^\s\"'`,;&<>]{8,}+")
_QUOTED_PASSWORD = re.compile(r"[^\s\"'`]{8,}+")
_ACCOUNT = re.compile(r"(?:[\x20\t_-]{0,4}(?:no\.?|nr\.?|number|num|id))?[\"'`]?[\x20\t]{0,4}[:#=]?[\x20\t]{0,4}[\"'`]?([0-9](?:[\x20-]*+[0-9])++)", re.IGNORECASE)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    for word, kind in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        a.add_word(word, (kind, len(word)))
    a.add_word("bearer", ("bearer", 6))
    a.add_word("-----begin", ("block", 10))
    for cues, kind in ((SECRET_CUES, "secret"), (PASSWORD_CUES, "password"), (ACCOUNT_CUES, "account"), (PREFIX_CUES, "prefix")):
        for cue in cues:
            a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


ANCHORS = _automaton()
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def lowered(text: str) -> str:
    """The text in lower case, each code point in its place."""
    low = text.lower()
    # a few letters have lower-case forms of two code points
    return low if len(low) == len(text) else text.translate(_LOWER)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by kind as in ``KINDS`` and start."""
    text = text or ""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys((*KINDS, "token", "password"), 0)

    def add(kind: str, start: int, end: int) -> None:
        found[kind].append((start, end))

    for last, (anchor, width) in ANCHORS.iter(lowered(text)):
        at = last - width + 1
        if anchor == "digit":
            if at >= done["card"]:
                m = _CARD.match(text, at)
                done["card"] = m.end() if m else at + 1
                if m and m.end() - at >= 13:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        add("card", at, m.end())
            if at >= done["ip"]:
                m = _IP.match(text, at)
                # no match here: none begins inside this number either
                done["ip"] = m.end() if m else _NUMBER.match(text, at).end()
                if m and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()):
                    add("ip", at, m.end())
            if at >= max(2, done["iban"]) and text[at - 2:at].isascii() and text[at - 2:at].isalpha() and text[at - 2:at].isupper() and not text[at - 3:at - 2].isalnum():
                if m := _IBAN.match(text, at - 2):
                    end = m.end()
                    # a spaced form may have read on into capitals that follow: give back groups
                    while end > at and not iban_valid(text[at - 2:end]):
                        end = text.rfind(" ", at, end)
                    if end > at:
                        add("iban", at - 2, end)
                        done["iban"] = end
        elif anchor == "at":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                add("email", start, m.end())
                done["email"] = m.end()
            else:
                done["email"] = at
        elif anchor == "plus":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                    add("phone", at, m.end())
        elif anchor == "scheme":
            start = at
            while start > done["login"] and text[start - 1] in _SCHEME:
                start -= 1
            if start < at and (m := _USERINFO.match(text, last + 1)):
                add("login", start, m.end())
                done["login"] = m.end()
        elif anchor in ("secret", "password"):
            if not (g := _GIVEN.match(text, last + 1)):
                continue
            form, read = (_SECRET, "token") if anchor == "secret" else (_QUOTED_PASSWORD if g.group(1) else _PASSWORD, "password")
            # a value that begins inside the last one read is its end, and fails the check if that did
            if g.end() >= max(done["secret"], done[read]) and (m := form.match(text, g.end())):
                done[read] = m.end()
                value = m.group()
                if any(map(str.isdigit, value)) and any(map(str.isalpha, value)):
                    add("secret", *m.span())
                    done["secret"] = m.end()
        elif anchor in ("prefix", "bearer", "block"):
            form, begin = {"prefix": (_PREFIXED, at), "bearer": (_BEARER, last + 1), "block": (_KEY_BLOCK, at)}[anchor]
            if at >= done["secret"] and not text[at - 1:at].isalnum() and (m := form.match(text, begin)):
                value, (start, end) = m.group(form.groups), m.span(form.groups)
                if anchor != "bearer" or (any(map(str.isdigit, value)) and any(map(str.isalpha, value))):
                    add("secret", start, end)
                done["secret"] = end
        elif last >= done["account"] and (m := _ACCOUNT.match(text, last + 1)):
            if 6 <= sum(map(str.isdigit, m.group(1))) <= 18:
                add("account", *m.span(1))
                done["account"] = m.end(1)
    return [(k, *span) for k in KINDS for span in found[k]]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_COUNTS = [f"n_{k}" for k in BASE_KINDS]


@F.pandas_udf(StructType([*(StructField(c, LongType()) for c in _COUNTS), StructField("base_sha256", StringType()), StructField("spans", StringType()), StructField("n_spans", LongType())]))
def _report(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        spans = find_spans(t)
        base = [s for s in spans if s[0] in BASE_KINDS]
        rows.append((*(sum(s[0] == k for s in base) for k in BASE_KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans)))
    return pd.DataFrame(rows, columns=[*_COUNTS, "base_sha256", "spans", "n_spans"]).astype(dict.fromkeys([*_COUNTS, "n_spans"], "int64"))


def personal_data(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> per row the counts, digest and spans."""
    return small_batches(docs).select("doc_id", _report("text").alias("r")).select("doc_id", "r.*")


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlapping ones together) replaced by its first kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [(text or "")[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, (text or "")[at:]])
