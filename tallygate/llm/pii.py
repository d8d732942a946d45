"""Personal data by candidate gradient boosting.

Plain patterns give the base spans. Generators of high recall then propose further, overlapping spans
in forms that the patterns don't cover (written-out addresses, numbers without a plus, other
separators); boosted trees judge each by its format and context, and those above a threshold of its
kind are added where they meet no base span. There are no labelled spans to learn from, so the trees
are trained on examples that :func:`examples` and :func:`further_examples` compose from the kinds of numbers and phrases
named there, and each threshold is calibrated on others, not learnt from, to let through one false span in 200 at most.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import Trees, fit_trees
from .shared import lean, small

KINDS = ("email", "ip", "card", "phone")

# The characters of the base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @, so that long words aren't searched from each of their characters."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _digits_only(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGITS.search(text):
        return out
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        for m in pattern.finditer(text):
            s = m[0]
            if kind == "ip":
                fits = all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in s.split("."))
            else:
                digits = _digits_only(s)
                fits = 13 <= len(digits) <= 19 and _luhn(digits) if kind == "card" else 9 <= len(digits) <= 15
            if fits:
                out.append((kind, *m.span()))
    return out


# --- candidates -----------------------------------------------------------------------------

_GENERATORS = (
    ("email", re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\s?(?:[\[({]\s?at\s?[\])}]|\bat\b|@)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:[\[({]\s?dot\s?[\])}]|\bdot\b|\.)\s?[A-Za-z0-9-]{2,63}){1,3}", re.I)),
    ("ip", re.compile(r"(?<![\w.])[0-9]{1,3}(?:\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?[0-9]{1,3}){3}(?![\w])", re.I)),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])")),
    ("card", re.compile(r"(?<![\w])[0-9]{4}(?:[ ._/ ‐-―-]{1,2}[0-9]{2,6}){2,4}(?![\w])")),
    ("phone", re.compile(r"(?<![\w+.])(?:\(?00[0-9]{1,3}\)?[ ./-]?|\+[0-9]{1,3}[ ./-]{1,2})?\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,5}){1,4}(?![\w.])")),
)
# The end of each match of the first generator, from its at sign on, in a form that is quick to search for; the letters
# beyond ASCII are those that re.I takes for ASCII ones.
_LABEL = "A-Za-z\u0130\u0131\u017f\u212a0-9-"
_AT = re.compile(
    r"[@\[({Aa](?:(?<=@)|(?<=[\[({])\s?[Aa][Tt]\s?[\])}]|(?<=\b[Aa])[Tt]\b)\s?"
    rf"[{_LABEL}]{{1,63}}\s?(?:[\[({{]\s?[Dd][Oo][Tt]\s?[\])}}]|\b[Dd][Oo][Tt]\b|\.)\s?[{_LABEL}]{{2}}"
)
# The first generator's match begins at most so many characters before its at sign: 64 and a space.
_BEFORE_AT = 65
# Words before personal data, by kind.
_CONTEXT = {
    "email": re.compile(r"e-?mail|contact|write|reach|address|correo|courriel|mailto", re.I),
    "ip": re.compile(r"\bip\b|host|server|client|login|address|from", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment", re.I),
    "phone": re.compile(r"phone|\btel|call|mobile|fax|cell|whatsapp|\bsms|dial|ring|telefon|tél", re.I),
}
_AGAINST = re.compile(r"version|isbn|order|invoice|page|chapter|date|section|score|room|\bno\.|model|serial|§|\$|€|ratio|table|total", re.I)
# Words before an "at" that a place, not an address, follows.
_PLAIN = re.compile(r"(?:us|me|it|is|are|was|were|be|them|him|her|here|more|online|site|website|page|available|found|visit|hosted|read|look|looked|and|or)\s", re.I)
_AROUND = 32


def _written_emails(text: str) -> Iterator[tuple[int, int]]:
    """All matches of the first generator, tried only shortly before what looks like their at sign."""
    pattern, end, at = _GENERATORS[0][1], 0, _AT.search(text)
    while at:
        tries = (pattern.match(text, i) for i in range(max(end, at.start() - _BEFORE_AT), at.start()))
        if m := next(filter(None, tries), None):
            yield m.span()
            end = m.end()
        at = _AT.search(text, max(end, at.start() + 1))


def candidates(text: str) -> list[tuple[str, int, int]]:
    """All matches of the generators; one is passed over only if the text lacks a character that each of its matches has."""
    out = [("email", *span) for span in _written_emails(text)]
    digits = bool(_DIGITS.search(text))
    may = (digits and any(b in text for b in "[({"), text.count(":") >= 3, "::" in text, digits, digits)
    for (kind, pattern), looks in zip(_GENERATORS[1:], may, strict=True):
        if looks:
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    s, before, after = text[start:end], text[max(0, start - _AROUND) : start], text[end : end + _AROUND]
    digits = _digits_only(s)
    groups = _DIGITS.findall(s)
    hexes = re.findall(r"[0-9A-Fa-f]+", s)
    return [
        *(float(kind == k) for k in KINDS),
        float(len(s)),
        float(len(digits)),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        float(13 <= len(digits) <= 19 and _luhn(digits)),
        float(len(groups) == 4 and all(int(g[-4:]) <= 255 for g in groups)),
        float(s.count(":")),
        float(len(hexes)),
        float(bool(re.search(r"[\[({]\s?(?:at|dot|\.)\s?[\])}]", s, re.I))),
        float(bool(re.search(r"\bdot\b", s, re.I)) and bool(re.search(r"\bat\b", s, re.I))),
        float(bool(re.search(r"(?<![A-Za-z0-9-])(?:com|org|net|edu|gov|io|de|fr|es|uk|info)$", s, re.I))),
        float(bool(re.search(r"\.\s", s))),
        float("@" in s),
        float(bool(_PLAIN.match(s))),
        float("(" in s),
        float(bool(re.match(r"\+|\(?00[1-9]", s))),
        float("::" in s),
        float(sum(any(c.isdigit() for c in h) for h in hexes)),
        float(bool(re.match(r"(?:\+[0-9]{1,3} ?)?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}$", s))),
        float(s.startswith("0")),
        float(bool(_CONTEXT[kind].search(before))),
        float(bool(_AGAINST.search(before))),
        float(bool(re.match(r"(?:1[89]|20)[0-9]{2}\b", s)) or bool(re.search(r"\b(?:19|20)[0-9]{2}$", s))),
        float(len(set(digits)) / max(1, len(digits))),
        float(before[-1:].isdigit() or after[:1].isdigit() or before[-2:-1].isdigit() and not before[-1:].isalpha()),
        float(len({c for c in s if not c.isalnum()})),
    ]


def examples(seed: int, count: int) -> Iterator[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label): composed phrases with one candidate each."""
    r = random.Random(seed)
    digit = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(["an", "er", "the", "in", "on", "re", "is", "to", "mo", "la"]) for _ in range(r.randint(1, 4)))

    def card() -> str:
        body = r.choice("3456") + digit(14)
        return next(body + str(c) for c in range(10) if _luhn(body + str(c)))

    def positive(kind: str) -> tuple[str, str]:
        if kind == "email":
            at, dot = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" at ", " dot "), (" [at] ", " [dot] "), ("{at}", "."), (" (at) ", ".")])
            return r.choice(["email ", "contact ", "write to ", "reach me: ", "", word() + " "]), f"{word()}{r.choice(['', '.' + word(), digit(2)])}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de'])}"
        if kind == "ip":
            if r.random() < 0.4:
                return r.choice(["ip ", "host ", "client ", word() + " "]), ":".join("%x" % r.getrandbits(16) for _ in range(8))
            sep = r.choice(["[.]", "(.)", "[dot]"])
            return r.choice(["ip ", "server ", "login from ", word() + " "]), sep.join(str(r.randint(0, 255)) for _ in range(4))
        if kind == "card":
            c, sep = card(), r.choice([".", "_", "/", "  ", " - "[:2], "–"])
            return r.choice(["card ", "visa ", "credit card: ", "payment ", word() + " "]), sep.join(c[i : i + 4] for i in range(0, 16, 4))
        form = r.choice(["(###) ###-####", "###-###-####", "0### ######", "0## / ### ####", "00## ### ### ###", "0#.##.##.##.##", "### ### ####"])
        return r.choice(["call ", "phone: ", "tel ", "mobile ", "fax ", "whatsapp "]), "".join(digit(1) if c == "#" else c for c in form)

    def negative(kind: str) -> tuple[str, str]:
        if kind == "email":
            return r.choice([word() + " ", "is "]), f"{word()} at {word()} . {word()}" if r.random() < 0.5 else f"{word()} at {word()}. {word()}"
        if kind == "ip":
            return r.choice(["at ", "ratio ", "time ", word() + " "]), ":".join(digit(2) for _ in range(r.choice([4, 4, 5])))
        if kind == "card":
            form = r.choice(["####-##-##-####", "####.##.##", "#### #### ####", "####/####/##", "#### #### #### ####"])
            s = "".join(digit(1) if c == "#" else c for c in form)
            return r.choice(["order ", "serial ", "isbn ", "", word() + " "]), s
        form = r.choice(["20##-##-##", "##.##.20##", "##/##/20##", "### - ###", "#### ####", "## ##", "###.###", "19## 20##", "## ### ###", "###-#-###-#####-#", "### ###-####"])
        near = ["call on ", "phone of ", "mobile, "] if "20##" in form or "19##" in form else []
        return r.choice(["order ", "isbn ", "version ", "date ", "", word() + " ", "table ", "total $", *near]), "".join(digit(1) if c == "#" else c for c in form)

    for _ in range(count):
        kind, label = r.choice(KINDS), r.randint(0, 1)
        before, s = (positive if label else negative)(kind)
        text = f"{word()} {word()} {before}{s}"
        start = len(text) - len(s)
        yield text + r.choice([f" {word()}", ".", f", {word()}", ""]), kind, start, start + len(s), label


def further_examples(seed: int, count: int) -> Iterator[tuple[str, str, int, int, int]]:
    """As :func:`examples`, of forms half written out (a spaced or plain at sign, and sentences and sites that look like them),
    and of numbers with no word before them to tell what they are, or with one that misleads.
    """
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "the", "in", "on", "re", "is", "to", "mo", "la"]) for _ in range(r.randint(1, 4)))
    told, tld = ["email ", "contact ", "write to ", "reach me: "], ["com", "org", "net", "de"]
    for _ in range(count):
        form = r.choice(["spaced", "sign", "plain", "ip", "sentence", "site", "place", "short ip", "scope", "number", "no number"])
        kind = "ip" if form in ("ip", "short ip", "scope") else "phone" if "number" in form else "email"
        label = int(form in ("spaced", "sign", "plain", "ip", "short ip", "number"))
        name = f"{word()}{r.choice(['', '.' + word(), str(r.randint(10, 99))])}"
        # A plain "at" without a word for mail before it may as well name a site.
        before = r.choice([*told, word() + " "]) if form in ("spaced", "sign", "sentence", "place") else r.choice(told) if form == "plain" else word() + " "
        if form == "ip":
            before = r.choice(["ip ", "server ", "login from ", word() + " "])
            s = r.choice(["[DOT]", " [.] ", "[ . ]", "( dot )"]).join(str(r.randint(0, 255)) for _ in range(4))
        elif form == "short ip":
            before, groups = r.choice(["ip ", "host ", word() + " "]), ["%x" % r.getrandbits(16) for _ in range(r.randint(3, 6))]
            at = r.randint(1, len(groups) - 1)
            s = ":".join(groups[:at]) + "::" + ":".join(groups[at:])
        elif form == "scope":
            before = word() + " "
            s = r.choice(["::", ":"] if r.random() < 0.2 else ["::"]).join([r.choice(["a", "be", "add", "fee", "12", "5"]), r.choice(["b", "ad", "dead", "30", "7"])])
            s = s if "::" in s else "12::30"
        elif form == "number":
            before = r.choice([word() + " ", word() + ". ", "", "call "])
            shape = r.choice(["+# (###) ###-####", "+## ### #######", "+## ## #### ####", "+###-##-###-####", "(###) ###-####", "00## ### ### ###"])
            s = "".join(str(r.randint(1, 9)) if c == "#" else c for c in shape)
        elif form == "no number":
            before = r.choice([word() + " ", "call ", "phone of ", "tel "])
            shape = r.choice(["20##-0#-1#", "##.##.20##", "### - ###", "## ## ##", "(##) ## - ##", "##/##", "#### ####"])
            s = "".join(str(r.randint(1, 9)) if c == "#" else c for c in shape)
        elif form == "sentence":
            s = f"{word()} at {word()}.{r.choice([' ', chr(10)])}{r.choice([word(), word().title(), 'es', 'De', 'Info', 'Com'])}"
        elif form == "place":
            s = f"{r.choice(['us', 'more', 'available', 'online', 'found', 'is'])} at {word()}.{r.choice(tld)}"
        else:
            s = f"{name}{ {'spaced': r.choice([' ( at ) ', ' (AT) ', '[ at ]']), 'sign': ' @ '}.get(form, ' at ')}{word()}.{r.choice(tld)}"
        text = f"{word()} {word()} {before}{s}"
        start = len(text) - len(s)
        yield text + r.choice([f" {word()}", "", f", {word()}"]), kind, start, start + len(s), label


@cache
def trained(seed: int = 20240517, count: int = 6000) -> tuple[Trees, dict[str, float]]:
    """The trees and the threshold of each kind; the same at every call."""
    both = ([*examples(seed, count)], [*further_examples(seed, count // 2)])
    made = [(e[1], describe(*e[:4]), e[4]) for half in (0, 1) for part in both for e in part[half * len(part) // 2 : (half + 1) * len(part) // 2]]
    x, y, kinds = np.array([m[1] for m in made]), np.array([m[2] for m in made], float), np.array([m[0] for m in made])
    half = len(made) // 2
    trees = fit_trees(x[:half], y[:half], rounds=120)
    p, thresholds = trees.probability(x[half:]), {}
    for k in KINDS:
        own = kinds[half:] == k
        clean = np.sort(p[own & (y[half:] == 0)])
        thresholds[k] = max(0.5, float(clean[int(len(clean) * 0.995)]) if len(clean) else 1.0)
    return trees, thresholds


class Taken:
    """Stretches of a text, merged and in order, so that one look-up tells whether a span meets any."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end) - 1
        return i >= 0 and self.ends[i] > start

    def add(self, start: int, end: int) -> None:
        """Take a span that meets none."""
        i = bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def all_spans(text: str, trees: Trees, thresholds: dict[str, float]) -> tuple[list, list]:
    """(base spans, all spans), each by kind, then start."""
    base = base_spans(text)
    taken = Taken((a, b) for _, a, b in base)
    proposed = [c for c in candidates(text) if not taken.meets(*c[1:])] if text else []
    if not proposed:
        return base, base
    p = trees.probability(np.array([describe(text, *c) for c in proposed]))
    added, own = [], Taken(())
    for i in sorted(range(len(p)), key=lambda i: (-p[i], proposed[i][1], proposed[i][2])):
        kind, a, b = proposed[i]
        if p[i] > thresholds[kind] and not own.meets(a, b):
            added.append(proposed[i])
            own.add(a, b)
    return base, sorted([*base, *added], key=lambda s: (KINDS.index(s[0]), s[1]))


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping ones by the first's."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def _find(batches: Iterator[pa.RecordBatch], model: tuple[Trees, dict[str, float]], clean: bool) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        rows, clear = [], []
        for text in batch.column("text").to_pylist():
            base, found = all_spans(text or "", *model)
            n = [sum(s[0] == k for s in base) for k in KINDS]
            rows.append((*n, hashlib.sha256(_join(base).encode()).hexdigest(), _join(found), len(found) - len(base)))
            if clean:
                clear.append(redact(text, found) if found else text)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, *([pa.array(clear, pa.string())] if clean else [])], names=[*names, *(["redacted"] if clean else [])])


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans, n_added for every row of ``docs``.

    ``spans`` lists base and added spans as kind:start:end (code points, end exclusive), by kind, then start;
    base_sha256 is the digest of the base ones in that form. With ``redacted`` a column of that name has the
    text with each span replaced by its kind.

    A null or empty text has no spans (``redacted`` leaves null null). Repeated rows and null ids are kept as
    they are; an empty table gives none; other columns are ignored.
    """
    model = trained()
    schema = _SCHEMA + (", redacted string" if redacted else "")
    return lean(docs, id_col, text_col).mapInArrow(lambda it: _find(it, model, redacted), schema)


def _replace(batches: Iterator[pa.RecordBatch], model: tuple[Trees, dict[str, float]], text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        at = batch.schema.get_field_index(text_col)
        clear = [t if t is None or not (found := all_spans(t, *model)[1]) else redact(t, found) for t in batch.column(at).to_pylist()]
        yield batch.set_column(at, batch.schema.field(at), pa.array(clear, batch.schema.field(at).type))


def redact_documents(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with its columns as they are, but for the text, in which each span is replaced by its kind."""
    model = trained()
    return docs.mapInArrow(lambda it: _replace(it, model, text_col), docs.schema)
