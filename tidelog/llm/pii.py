"""Personal data: fixed patterns, and a semi-Markov conditional random field.

The patterns find email addresses, IP addresses, payment cards and phone
numbers.  The field scores whole candidate segments of up to ``MAX_TOKENS``
tokens by features of the segment and of the words around it, and dynamic
programming chooses boundaries and types together; what it finds outside the
patterns' spans is added, so that secrets and less regular forms are found
too.  What a segment must have to be of a type at all is a hard constraint: a
card has 13 to 19 digits in the groups of a card and passes Luhn, and a number
of several tokens is a whole row of numbers, or begins with a bracket or plus
and ends with the row or before another such; so rows of figures have no
candidates, however long, and a number after or between them is one.  Weights are fitted here, by the likelihood
of invented sentences, look-alikes among them.

Null texts count as empty and have no spans.  Texts and tokens are searched
whole, whatever their length.  Candidates are found near digits, at signs and
the words that go before secrets, one after another; segments that overlap are
held until they end and decided together, so a long text takes no more memory
than its own.  Of segmentations of equal score the one with fewer, then
earlier-listed entities is taken.  Repeated rows are treated alike, ids may be
null, an empty table gives no rows, other columns are ignored, or kept as they
are by :func:`mask`, whatever their names.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from heapq import merge
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.common import map_batches, tables

#: Kinds in the order of results; the patterns know the first four.
KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
BASE_KINDS = 4

#: Fixed patterns of the base kinds.  A digit run is tried from its start only, as no later start can match.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """For each at sign: the name characters before it, back to the last match, and a domain after it."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        after = domain.end() if domain else at + 1
        if domain:
            yield start, after
        at = text.find("@", after)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points, by kind and start."""
    out = [(EMAIL, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            out.append((IP, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((CARD, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((PHONE, *m.span()))
    return out


# The field.

MAX_TOKENS = 6
#: An arc: a segment in characters, the kind it would be, and its features.
Arc = tuple[int, int, int, tuple[str, ...]]

# Fixed values.
#: Words before a secret.
_SECRET_WORDS = ("token", "password", "passwd", "pwd", "secret", "key", "apikey", "api_key", "auth", "authorization", "bearer", "credential", "credentials", "passphrase", "pass", "pin")
#: What secrets of known services begin with.
_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_live_", "rk_live_", "AIza", "ya29.", "eyJ", "SG.", "npm_", "hf_")
_PHONE_WORDS = frozenset("phone tel telephone mobile cell call calls called ring dial fax text sms whatsapp contact reach hotline number handy telefon teléfono téléphone".split())
#: Words before numbers that identify something else.
_OTHER_WORDS = frozenset("isbn issn order invoice page pages line lines no nr id ids version commit rev revision sha sha1 sha256 md5 checksum hash digest figure table item items part parts serial model build ticket case ref room flight chapter bus uuid etag object tree parent blob".split())

_STOPS = "\\s\"'`{}\\[\\]<>,;=|"
_TOKEN = re.compile(f"[^{_STOPS}]+")
_STOP = frozenset(" \t\n\r\v\f\"'`{}[]<>,;=|")
_KEY = re.compile("|".join(sorted(_SECRET_WORDS, key=len, reverse=True)), re.IGNORECASE)
#: From the end of a key word to the value that it names.
_VALUE = re.compile(r"""["'`\])]*[ \t]{0,4}(?:(:=|=>|[=:])|\b(is)\b|(?<=[Bb]earer)(?=[ \t]))[ \t]{0,4}(["'`]?)""")
_NUMBERS = re.compile(r"[0-9()+.\-]*[0-9][0-9()+.\-]*(?:[ \u00a0][0-9()+.\-]+){0,%d}" % MAX_TOKENS)
_MORE_NUMBERS = re.compile(r"(?:[ \u00a0][0-9()+.\-]+){1,500}")
_NUMBER = re.compile(r"[0-9()+.\-]+")
_LONG_NUMBER = re.compile(r"[0-9()+.\-]{7,}")
_PHONE_SHAPE = re.compile(r"(?:\+?[0-9]{1,3}[ .\-]?)?(?:\([0-9]{1,5}\)|[0-9]{2,5})[ .\-]?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,3}")
_SPACED_MAIL = re.compile(r"[\w.%+-]+ ?(?:@|[(\[](?:at|AT)[)\]]) ?[\w-]+(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[\w-]+)+")
_LABEL = re.compile(r" ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?([\w-]+)")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_CARD_GROUPS = frozenset([(13,), (14,), (15,), (16,), (17,), (18,), (19,), (4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4)])


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without brackets around it and stops after it."""
    while end > start and text[end - 1] in "`.,;:!?)]}>#*$%&~" and not (text[end - 1] == ")" and "(" in text[start:end]):
        end -= 1
    while end > start and text[start] in "`([{<#*$%&~" and not (text[start] == "(" and ")" in text[start:end]):
        start += 1
    return start, end


def _word_before(text: str, at: int) -> str:
    """The word before a place on its line, without case and stops."""
    line = text[max(0, at - 40) : at].rpartition("\n")[2]
    words = re.findall(r"[^\W\d_]+[0-9]*", line)
    return words[-1].lower() if words else ""


def _about(text: str, a: int, b: int) -> Iterator[str]:
    """Features of what is around a segment."""
    before = _word_before(text, a)
    if before in _PHONE_WORDS:
        yield "phone word"
    if before in _OTHER_WORDS:
        yield "other word"
    if a and (text[a - 1].isalnum() or text[a - 1] in "_/\\"):
        yield "runs on before"
    if b < len(text) and (text[b].isalnum() or text[b] in "_/\\%°€$£"):
        yield "runs on after"


def _number_arcs(text: str, a: int, b: int, lone: bool) -> Iterator[Arc]:
    """What a segment of digits and their separators may be.  lone: no number beside it, parted by a blank."""
    a, b = trimmed(text, a, b)
    groups = [len(g) for g in re.findall("[0-9]+", text[a:b])]
    n = sum(groups)
    if not 7 <= n <= 19:
        return
    s = text[a:b]
    around = tuple(_about(text, a, b))
    kinds = set(re.findall("[^0-9()+]", s))
    if lone and 13 <= n <= 19 and tuple(groups) in _CARD_GROUPS and len(kinds) < 2 and not set("()+") & set(s) and luhn("".join(c for c in s if "0" <= c <= "9")):
        yield a, b, CARD, (*around, f"card in {len(groups)}", "issuer" if s[0] in "3456" else "no issuer")
    if 7 <= n <= 15 and _PHONE_SHAPE.fullmatch(s):
        sure = "plus" if s[0] == "+" else "area" if "(" in s else "bare"
        form = "-".join(map(str, groups))
        parted = "blanks" if " " in s or "\u00a0" in s else "dots" if "." in s else "dashes" if "-" in s else "solid"
        named = "phone word" in around
        yield a, b, PHONE, (*around, sure, f"{sure} {parted}", f"{parted} {form}", f"{parted} of {len(groups)}", "few digits" if n < 9 else "enough digits", f"named {parted}" if named else f"unnamed {parted}", "lone" if lone else "beside")


def _numbers(text: str, a: int) -> tuple[int, Iterator[Arc]]:
    """The end of the row of numbers from a place, and the arcs in it, alike in rows of any length.

    A number of several tokens is the whole row, or goes from a token with a
    bracket or plus to the end or to the next such token.  None has more than
    MAX_TOKENS tokens, as a phone has six groups of digits at most and a card five.
    """
    end = _NUMBERS.match(text, a).end()
    while more := _MORE_NUMBERS.match(text, end):
        end = more.end()

    def arcs() -> Iterator[Arc]:
        for t in _NUMBER.finditer(text, a, end):
            x, y = t.span()
            opens = text[x] in "(+"
            if opens or x == a:
                ends = [m.end() for m in islice(_NUMBER.finditer(text, x, end), MAX_TOKENS)]
                for b in reversed(ends[1:]):
                    whole = x == a and b == end
                    if whole or opens and (b == end or text[b + 1] in "(+"):
                        yield from _number_arcs(text, x, b, whole)
            if y - x >= 7:
                yield from _number_arcs(text, x, y, x == a and y == end)

    return end, arcs()


def _turns(s: str) -> int:
    """How often the kind of character changes."""
    return len(re.findall("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]", s)) - 1


def _secret_arc(text: str, a: int, b: int, key: str) -> Iterator[Arc]:
    """A token as a secret.  key: how a key word before it names it, or nothing."""
    a, b = trimmed(text, a, b)
    n = b - a
    if n < 6 or not key and n < 16:
        return
    s = text[a : min(b, a + 4096)]  # features only; the segment is whole
    digits, letters = any(c.isdigit() for c in s), any(c.isalpha() for c in s)
    known = s.startswith(_PREFIXES) and _turns(s) >= 5
    if not key and not known and not (digits and letters and "@" not in s and "://" not in s):
        return
    form = "uuid" if _UUID.fullmatch(s) else "number" if not letters else "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) else "caps" if re.fullmatch("[A-Z0-9]+", s) else "word" if s.isalpha() else "mixed"
    size = "short" if n < 10 else "middling" if n < 16 else "long"
    restless = "wordy" if re.search("[a-z]{5}|[A-Z]{5}[a-z]|[A-Z][a-z]{3}", s) else "restless" if 4 * _turns(s) >= len(s) else "calm"
    plain = "plain" if re.fullmatch(r"[A-Za-z0-9_+/.~-]+", s) else "odd"
    words = "parted" if max(map(len, re.split(r"[._/:+-]", s))) < 14 else "solid"
    own = (f"{key or 'no key'}", f"{key or 'no key'} {form}", f"{form} {size}", f"{form} {restless} {words}", plain, "known prefix" if known else "no prefix", f"{'key' if key else 'no key'} {restless}")
    yield a, b, SECRET, (*own, *_about(text, a, b))


def _mail_arcs(text: str, at: int, floor: int) -> Iterator[Arc]:
    """Addresses with blanks or words for their signs around an at sign, at or after ``floor``."""
    a = at
    while a > floor and at - a < 80 and text[a - 1] != "\n":
        a -= 1
    for m in _SPACED_MAIL.finditer(text, a, min(len(text), at + 120)):
        if not m.start() <= at < m.end():
            continue
        for label in _LABEL.finditer(text, at + 1, m.end()):  # where the address may end
            found = text[m.start() : label.end()]
            if (" " in found or "@" not in found) and len(found.split()) <= MAX_TOKENS:
                signs = "blank at" if re.search(" @|@ ", found) else "at"
                dots = "stop" if re.search(r"[^ ]\. ", found) else "blank dot" if " ." in found else "dot"
                last = label[1]
                yield m.start(), label.end(), EMAIL, ("ending" if last.isalpha() and 2 <= len(last) <= 4 else "no ending", signs, dots, f"{signs} {dots}", f"{dots} {len(last) <= 4}")


def _ip_arc(text: str, a: int, b: int) -> Iterator[Arc]:
    a, b = trimmed(text, a, b)
    s = text[a:b].partition("/")[0]
    if s.count(":") >= 2 and len(s) <= 45 and re.fullmatch(r"[0-9A-Fa-f:]+(?:[0-9.]+)?", s):
        try:
            ipaddress.IPv6Address(s)
        except ValueError:
            return
        yield a, a + len(s), IP, ("six", "short" if len(s) < 6 else "whole", *_about(text, a, a + len(s)))


def _named_values(text: str) -> Iterator[tuple[int, str]]:
    """The first character of each value that a key word names, and how it does."""
    lowered = text.lower()
    if any(w in lowered for w in ("tok", "pas", "pwd", "secret", "key", "auth", "bearer", "credential", "pin")):
        for m in _KEY.finditer(text):
            if v := _VALUE.match(text, m.end()):
                yield v.end(), "key " + ("is" if v[2] else "names" if v[1] else "bears")


def _anchors(text: str) -> Iterator[tuple[int, str]]:
    """Places that a candidate may be at, in order: values named by a key, digits and at signs, words for at signs."""
    marks = ((m.start(), "") for m in re.finditer(r"[0-9@]|[(\[](?:at|AT)[)\]]", text))
    return merge(marks, _named_values(text), key=lambda found: (found[0], not found[1]))


def arcs_of(text: str) -> Iterator[Arc]:
    """All candidate segments, about in order."""
    done = keyed = 0
    for place, key in _anchors(text):
        if key:
            m = _TOKEN.match(text, place) if place >= keyed else None
            if m:
                keyed = m.end()
                yield from _secret_arc(text, *m.span(), key)
            continue
        if place < done:
            if text[place] in "@([":
                yield from _mail_arcs(text, place, max(0, place - 80))
            continue
        if text[place] in "@([":
            yield from _mail_arcs(text, place, max(0, place - 80))
            if text[place] != "@":
                continue
        a = place
        while a > done and text[a - 1] not in _STOP and not text[a - 1].isspace():
            a -= 1
        end = _TOKEN.match(text, a).end()
        if _NUMBERS.match(text, a) and _NUMBER.match(text, a).end() >= trimmed(text, a, end)[1]:
            done, found = _numbers(text, a)
            done = max(done, end)
            yield from found
        else:
            done = end
            address = list(_ip_arc(text, a, end))
            yield from address
            if not address and place >= keyed:  # else it is a value that a key names, or ends in one
                yield from _secret_arc(text, a, end, "")
            for t in _LONG_NUMBER.finditer(text, a, end):
                if t.start() == a or not text[t.start() - 1].isalnum():
                    yield from _number_arcs(text, *t.span(), True)


def clusters(text: str) -> Iterator[list[Arc]]:
    """The candidates in groups, such that those of two groups don't overlap."""
    held: list[Arc] = []
    end = -1
    for arc in arcs_of(text):
        if held and arc[0] >= end:
            yield held
            held, end = [], -1
        held.append(arc)
        end = max(end, arc[1])
    if held:
        yield held


class Field:
    """weights: of each kind's features.  What is in no segment scores 0."""

    def __init__(self, weights: dict[tuple[int, str], float] | None = None):
        self.weights = weights if weights is not None else {}

    def score(self, kind: int, features: tuple[str, ...]) -> float:
        return self.weights.get((kind, "bias"), -2.0) + sum(self.weights.get((kind, f), 0.0) for f in features)

    def best(self, arcs: list[Arc]) -> list[Span]:
        """The segments of the best segmentation of a cluster."""
        places = sorted({p for a, b, _, _ in arcs for p in (a, b)})
        number = {p: k for k, p in enumerate(places)}
        by_end: list[list[tuple[int, int, float]]] = [[] for _ in places]
        for a, b, kind, features in arcs:
            by_end[number[b]].append((number[a], kind, self.score(kind, features)))
        top, back = [0.0], [(-1, -1)]
        for j in range(1, len(places)):
            value, move = top[j - 1], (j - 1, -1)
            for i, kind, score in by_end[j]:
                if (v := top[i] + score) > value:
                    value, move = v, (i, kind)
            top.append(value)
            back.append(move)
        out, j = [], len(places) - 1
        while j > 0:
            i, kind = back[j]
            if kind >= 0:
                out.append((kind, places[i], places[j]))
            j = i
        return out[::-1]

    def spans(self, text: str) -> Iterator[Span]:
        for arcs in clusters(text):
            yield from self.best(arcs)

    def learn(self, examples: list[tuple[str, set[Span]]], rounds: int = 40, rate: float = 0.4, decay: float = 1e-2) -> Field:
        """Stochastic gradient ascent of the likelihood, by forward and backward sums over segmentations."""
        ready = [(arcs, gold) for text, gold in examples for arcs in clusters(text)]
        for turn in range(rounds):
            step_size = rate / (1 + turn / 4)
            for arcs, gold in ready:
                places = sorted({p for a, b, _, _ in arcs for p in (a, b)})
                number = {p: k for k, p in enumerate(places)}
                scored = [(number[a], number[b], self.score(k, f)) for a, b, k, f in arcs]
                n = len(places)
                ahead, behind = [0.0] * n, [0.0] * n
                for j in range(1, n):
                    ahead[j] = _log_sum([ahead[j - 1], *(ahead[i] + v for i, e, v in scored if e == j)])
                for i in range(n - 2, -1, -1):
                    behind[i] = _log_sum([behind[i + 1], *(behind[e] + v for s, e, v in scored if s == i)])
                for (a, b, kind, features), (i, j, v) in zip(arcs, scored, strict=True):
                    step = ((kind, a, b) in gold) - math.exp(ahead[i] + v + behind[j] - ahead[-1])
                    for f in ("bias", *features):
                        old = self.weights.get((kind, f), -2.0 if f == "bias" else 0.0)
                        self.weights[kind, f] = old + step_size * (step - decay * old)
        return self


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def invented(n: int = 1200, seed: int = 7) -> list[tuple[str, set[Span]]]:
    """Sentences of made-up words with entities and look-alikes in them, by templates."""
    rng = random.Random(seed)
    lower, upper, digit, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"

    def pick(letters: str, *k: int) -> str:
        return "".join(rng.choices(letters, k=rng.randint(*k) if len(k) > 1 else k[0]))

    def number(k: int) -> str:
        return rng.choice("123456789") + pick(digit, k - 1)

    def one(*of):
        return rng.choice(of)

    def word() -> str:
        return "".join(pick("bcdfglmnprst", 1) + pick("aeiou", 1) for _ in range(rng.randint(1, 4))) + one("", "n", "s", "t")

    def card(sep: str) -> str:
        body = one("4", "5", "37", "6")
        body += pick(digit, 15 - len(body)) if sep or rng.random() < 0.7 else pick(digit, 13 - len(body))
        whole = body + next(c for c in digit if luhn(body + c))
        return sep.join(whole[k : k + 4] for k in range(0, len(whole), 4)) if sep else whole

    def value() -> str:
        return one(lambda: pick(hexa, one(16, 24, 32, 40, 64)), lambda: pick(lower + digit, 10, 30), lambda: pick(lower + upper + digit, 12, 40), lambda: pick(lower + upper + digit + "+/", 20, 44), lambda: pick(lower + digit, 6, 9) + pick(digit, 1), lambda: word() + word() + number(2), lambda: word() + word() + word(), lambda: one("", "_", "-").join([word(), word() + pick("!@#?", 1), number(3)]))()

    def pair(key: str) -> str:
        return one(f"{key}=", f"{key} = ", f"{key}: ", f"{key}:", f"{key} = \"", f"{key}: '", f'"{key}":"', f'{{"user":"{word()}","{key}":"', f"{key} is ", f"export {key.upper()}=")

    def found(kind: int, before: str, s: str, after: str = "") -> tuple[int, str, str, str]:
        return kind, before, s, after

    def secret() -> tuple:
        key = one("token", "password", "secret", "api_key", "apikey", "key", "pwd", "access_token", "client_secret", "auth", "passphrase", "secret_key", "Password", "TOKEN")
        before, s = pair(key), value()
        if " is " in before and s.isalpha():
            s += number(2)
        return found(SECRET, before, s, before[-1] if before[-1] in "\"'" else "")

    def known() -> str:
        mixed = lower + upper + digit
        return one(f"AKIA{pick(upper + '234567', 16)}", f"ghp_{pick(mixed, 36)}", f"sk-{pick(mixed, 40)}", f"xoxb-{number(11)}-{number(12)}-{pick(mixed, 24)}", f"AIza{pick(mixed + '_-', 35)}", f"eyJ{pick(mixed, 20)}.eyJ{pick(mixed, 30)}.{pick(mixed + '_-', 30)}", f"glpat-{pick(mixed, 20)}", f"hf_{pick(mixed, 34)}", f"sk_live_{pick(mixed, 24)}")

    def phone() -> tuple:
        a, b, c = number(3), number(3), pick(digit, 4)
        sure = [f"({a}) {b}-{c}", f"({a}) {b} {c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"1-{a}-{b}-{c}", f"{a}.{b}.{c}", f"({number(4)}) {pick(digit, 6)}", f"(0{number(2)}) {number(4)} {pick(digit, 4)}"]
        named = [f"{a} {b} {c}", f"0{number(2)} {number(4)} {pick(digit, 4)}", f"0{number(3)} {pick(digit, 3)} {pick(digit, 3)}", f"00{number(2)} {number(2)} {pick(digit, 3)} {pick(digit, 2)} {pick(digit, 2)}", f"0{number(1)} {pick(digit, 2)} {pick(digit, 2)} {pick(digit, 2)} {pick(digit, 2)}", f"0{number(9)}", f"0{number(3)}-{pick(digit, 6)}"]
        if rng.random() < 0.5:
            return found(PHONE, "", one(*sure))
        return found(PHONE, one("call ", "phone: ", "Tel. ", "tel ", "mobile ", "fax ", "ring ", "contact: ", "phone number ", "SMS "), one(*sure, *named))

    def mail() -> tuple:
        name, host, top = one(word(), f"{word()}.{word()}", f"{word()}{number(2)}"), word(), one("com", "org", "net", "de", "info")
        return found(EMAIL, "", one(f"{name} @ {host}.{top}", f"{name} @ {host} . {top}", f"{name}@ {host}.{top}", f"{name} [at] {host} [dot] {top}", f"{name}(at){host}.{top}", f"{name} (at) {host} (dot) {top}"))

    def six() -> str:
        parts = [pick(hexa, 1, 4) for _ in range(8)]
        return one(":".join(parts), ":".join(parts[:3]) + "::" + parts[4], f"2001:db8::{parts[0]}", f"fe80::{':'.join(parts[:4])}")

    def row() -> str:
        k, n = rng.randint(2, 14), one(1, 2, 2, 3, 3, 4, 4, 5, 6)
        return one(" ", " ", " ", "  ", ", ", "\t", "-", ".").join(number(n) for _ in range(k))

    makers = (
        mail, mail, phone, phone, phone, secret, secret, secret, secret,
        lambda: found(SECRET, one("", "", "Bearer ", "Authorization: Bearer ", "key "), known()),
        lambda: found(SECRET, "Bearer ", pick(lower + upper + digit, 24, 40)),
        lambda: found(CARD, one("", "card "), card(one("-", " ", ".", ""))),
        lambda: found(IP, one("", "host ", "from "), six()),
        # Look-alikes.
        *[lambda: found(-1, "", row())] * 5,
        lambda: found(-1, "", number(rng.randint(1, 12))),
        lambda: found(-1, "", f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"),
        lambda: found(-1, "", f"{rng.randint(10, 28)}.{rng.randint(10, 12)}.{rng.randint(1900, 2030)}"),
        lambda: found(-1, "", f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}Z"),
        lambda: found(-1, "", f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}"),
        lambda: found(-1, "", f"{rng.randint(1900, 1960)} {rng.randint(1961, 1999)} {rng.randint(2000, 2030)}"),
        lambda: found(-1, "", f"{number(3)} {number(3)} {number(4)} units"),
        lambda: found(-1, "", f"{number(2)} {number(3)} {number(3)} {number(3)}"),
        lambda: found(-1, one("ISBN ", "isbn: "), f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}"),
        lambda: found(-1, one("order ", "invoice no ", "ticket ", "id "), one(f"{number(3)}-{number(7)}-{number(7)}", number(10), f"{number(4)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}")),
        lambda: found(-1, one("pages ", "lines "), f"{number(3)}-{number(3)}"),
        lambda: found(-1, one("commit ", "sha256:", "md5 ", "rev ", "checksum ", "", ""), pick(hexa, one(32, 40, 64))),
        lambda: found(-1, one("", "id ", "request ", "uuid "), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))),
        lambda: found(-1, "", f"https://{word()}.example.com/{word()}/{number(6)}/{word()}-{word()}?id={number(5)}"),
        lambda: found(-1, "", f"{word()}_{word()}_{rng.randint(1900, 2030)}{rng.randint(10, 12)}{rng.randint(10, 28)}.{one('png', 'txt', 'csv')}"),
        lambda: found(-1, "", f"{word()}/{word()}/{word()}{number(2)}.{one('py', 'js', 'html')}"),
        lambda: found(-1, "", f"{word().title()}{word().title()}{word().title()}{number(1)}"),
        lambda: found(-1, "", f"{word()}-{word()}-{word()}-{number(4)}"),
        lambda: found(-1, "", f"v{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}-rc{number(1)}+build{number(4)}"),
        lambda: found(-1, "", f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}"),
        lambda: found(-1, "", f"{number(2)}.{pick(digit, 4)}, {number(2)}.{pick(digit, 4)}"),
        lambda: found(-1, "", f"${number(1)},{number(3)},{number(3)}.{pick(digit, 2)}"),
        lambda: found(-1, "", f"x = {number(rng.randint(1, 8))}"),
        lambda: found(-1, "", f"{word()}={word()}"),
        lambda: found(-1, one("the key is ", "password is ", "the secret is ", "token is ", "a key: "), one("wrong", "required", "missing", "invalid", "to listen", "patience", "not set", "expired", "empty")),
        lambda: found(-1, "", one("token ring", "key findings", "secret garden", "password reset", "keyboard layout", "passing by", "authors note", "the pin fell")),
        lambda: found(-1, "", f"keys: {word()}, {word()} and {word()}"),
        lambda: found(-1, "", f"@{word()} and {word()} @ {number(2)} dollars"),
        lambda: found(-1, "", f"meet at {word()} @ {number(2)}:{number(2)}"),
        lambda: found(-1, "", f"key {number(2)}"),
        lambda: found(-1, "", f"{number(3)}.{number(3)}.{number(4)}.{number(2)}.{number(1)}"),
    )
    out = []
    for k in range(n):
        text, gold = word(), set()
        for turn in range(rng.randint(1, 2)):
            kind, before, s, after = makers[(k + 7 * turn) % len(makers)]()
            text += " " + " ".join(word() for _ in range(rng.randint(0, 2))) + one(" ", " ", ": ", "\n", ", ") + before
            if kind >= 0:
                gold.add((kind, len(text), len(text) + len(s)))
            text += s + after + one("", ".", ",", " ", "!", "###") + " " + " ".join(word() for _ in range(rng.randint(1, 3)))
        out.append((text, gold))
    return out


@cache
def default_field() -> Field:
    return Field().learn(invented())


def spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """The base spans and those of the field that touch none of them, by kind and start."""
    out = list(base)
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    tops = list(accumulate((b for _, b in taken), max))
    for kind, a, b in field.spans(text):
        before = bisect_left(starts, b)  # base spans that start before this one's end
        if not before or tops[before - 1] <= a:
            out.append((kind, a, b))
    return sorted(set(out))


def said(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame, field: Field | None = None, text: str = "text") -> DataFrame:
    """doc_id, base counts, a digest of the base spans, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast((field or default_field()).weights)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = Field(shared.value)
        counts, digest, every = [], [], []
        for t in batch.column(text).to_pylist():
            base = base_spans(t or "")
            counts.append([sum(k == kind for k, _, _ in base) for kind in range(BASE_KINDS)])
            digest.append(hashlib.sha256(said(base).encode()).hexdigest())
            every.append(said(spans(t or "", base, own)))
        columns = [batch.column("doc_id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(BASE_KINDS)), pa.array(digest, pa.string()), pa.array(every, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", text), run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string", text)


def masked(text: str, found: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union goes, under the first's kind."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in found):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, field: Field | None = None, text: str = "text") -> DataFrame:
    """The frame with the personal data in its texts masked, other columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast((field or default_field()).weights)
    place = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = Field(shared.value)
        new = [t if t is None else masked(t, spans(t, base_spans(t), own)) for t in batch.column(text).to_pylist()]
        return batch.set_column(place, text, pa.array(new, batch.schema.field(text).type))

    return map_batches(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), text)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(tables(spark, sf_dir, "documents"))
