"""Personal data: base patterns, and a character BiLSTM with CRF transitions that adds spans.

The base finds e-mail addresses, IP addresses, card and phone numbers by fixed patterns with checks. The network reads
classes of characters (letters without case and accents, digits, signs; wide forms and blanks like the plain ones) in windows of ``WINDOW`` characters at every ``STRIDE`` and learns in numpy from labelled spans in a
bounded sample of documents: the base's own, and made ones in forms that the base can't see (other
separators, no plus, spelled or bracketed signs of four languages), among amounts, dates, lists and other numbers that carry no label. The texts of
the sample are varied until there are enough windows, so a small sample trains as well. Windows that hold four digits
are decoded, and those with ``@`` (or its wide form), a bracketed at or dot, the word dot, a written-out at sign, or at before a dotted word, with their neighbours; a
span without any of these isn't looked for.

Each window gives the probabilities of every label at each of its characters. Where windows overlap these are averaged,
with more weight the further from a window's edge, and one Viterbi pass under the CRF's label rules runs over each stretch of
characters that may be in a span, across all windows. So a span may be of any length and a window's edge cuts none. An
added span must be sure enough; its ends are settled by its kind (``_settled``), and it must have the digits (and a card's check digit) or the sign, name and host of its kind; base spans always stay, and
added ones don't touch them or each other.

Defined results: null text counts as empty; texts of any length are read whole; repeated rows and equal texts give the same
spans; ties of labels go to the first in order; without any labelled span in the sample only the base spans are returned; an
empty table gives no rows; other columns pass through, but for those named like the results.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import hash_share, slices

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, HIDDEN = 64, 32, 24
#: Most documents that the network is trained on (in expectation), most windows of these, and passes over them.
TRAIN_DOCS, TRAIN_WINDOWS, EPOCHS, BATCH, RATE = 2_000, 10_000, 12, 96, 0.02
#: Least mean probability that the characters of an added span are in one; least probability of any span at a character that the decoder looks at.
CONFIDENCE, LOOK = 0.5, 0.05

_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = "0123456789"
_DIGIT = re.compile("[0-9]")
#: How an at sign is written out in the four languages of the corpus.
_AT_WORDS = ("at", "ät", "arroba", "arobase", "klammeraffe")
_BRACKETED = r"[\[({<] ?(?:%s) ?[\])}>]"
_SPELLED = re.compile(_BRACKETED % "|".join((*_AT_WORDS, "dot", r"\.")) + r"|\bdot\b|\bat [\w-]+\.\w|\b(?:arroba|arobase|klammeraffe)\b|\uff20", re.IGNORECASE)
_AT = re.compile("[@\uff20]|" + _BRACKETED % "|".join(_AT_WORDS) + r"|\b(?:%s)\b" % "|".join(_AT_WORDS), re.IGNORECASE)
#: What stands at both sides of an address's sign.
_NAME = re.compile(r"[\w.%+-]+\s*\Z")
_HOST = re.compile(r"\s*[\w-]+(?:(?:[.\uff0e]|\s*[\[({<] ?(?:dot|punkt|punto|point|\.) ?[\])}>]\s*|\s+(?:dot|punkt|punto|point)\s+)[\w-]+)+", re.IGNORECASE)
_EDGE = re.compile(r"[\w+(](?:.*[\w)])?", re.DOTALL)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: the local part of an @ starts as far left as its characters go, after the match before."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _MAIL.match(text, start) if start < at else None
        if m:
            yield "email", start, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by kind, then start; a match that fails its check is dropped."""
    out = [*_emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15] if "+" in text else []
    return out


# ---- the network

#: Classes of characters: 0 padding, 1 digits, then other letters, other characters, and one for each sign and letter. Signs and letters that are
#: written alike share a class: wide forms, accents, and the blanks that don't break a line.
_SIGNS = "@.-_+() \n:/=\"%,'#*[]{}<>abcdefghijklmnopqrstuvwxyz"
CLASSES, LABELS = 4 + len(_SIGNS), 1 + 2 * len(KINDS)


def _class_table() -> np.ndarray:
    out = np.full(0x10000, 2, dtype=np.uint8)
    for c in range(0x10000):
        x = chr(c)
        if c >= 128:
            x = unicodedata.normalize("NFKD", x)[:1] if not 0xD800 <= c < 0xE000 else x
        x = {"\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-"}.get(x, x).lower()
        out[c] = 3 if not x else 1 if x in "0123456789" else 4 + _SIGNS.index(x) if x in _SIGNS else 2 if x.isalpha() else 3
    return out


_TABLE = _class_table()


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return _TABLE[np.minimum(codes, len(_TABLE) - 1)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


#: Label 1 + 2k begins a span of kind k, 2 + 2k goes on with it; from row to column.
_ALLOWED = np.array([[b == 0 or b % 2 == 1 or (a > 0 and (a - 1) // 2 == (b - 1) // 2) for b in range(LABELS)] for a in range(LABELS)])
_BARRED = np.where(_ALLOWED, 0.0, -1e4)
_FIRST = np.array([0.0 if b == 0 or b % 2 == 1 else -1e4 for b in range(LABELS)])


@dataclass
class Tagger:
    """Weights: for each direction input wx (class, 4H), recurrent wh, bias; output wo, bo; CRF transitions."""

    w: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 5) -> Tagger:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w["wx" + d] = rng.normal(0, 0.3, (CLASSES, 4 * HIDDEN))
            w["wh" + d] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            w["b" + d] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        w["wo"], w["bo"], w["tr"] = rng.normal(0, 0.3, (2 * HIDDEN, LABELS)), np.zeros(LABELS), np.zeros((LABELS, LABELS))
        return cls(w)

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States of one direction; what the gradient needs."""
        n, t = x.shape
        h, c, out, kept = (*(np.zeros(size, dtype=self.w["wo"].dtype) for size in ((n, HIDDEN), (n, HIDDEN), (n, t, HIDDEN))), [None] * t)
        wx, wh, b = self.w["wx" + d], self.w["wh" + d], self.w["b" + d]
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = wx[x[:, i]] + h @ wh + b
            s = _sigmoid(z[:, : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            before = h, c
            c = s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * g
            tc = np.tanh(c)
            h = s[:, 2 * HIDDEN :] * tc
            out[:, i] = h
            kept[i] = (*before, s, g, tc)
        return out, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._run(x, d)[0] for d in "fb"], axis=2) @ self.w["wo"] + self.w["bo"]

    @staticmethod
    def _passes(e: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all label sequences the scaled sums up to each position and from it on, and the scales, whose product is the sum of whole windows."""
        a, b, c = np.empty_like(e), np.ones_like(e), np.empty(e.shape[:2], dtype=e.dtype)
        for i in range(e.shape[1]):
            a[:, i] = e[:, i] * (a[:, i - 1] @ step if i else (_FIRST == 0))
            c[:, i] = a[:, i].sum(1)
            a[:, i] /= c[:, i, None]
        for i in range(e.shape[1] - 2, -1, -1):
            b[:, i] = (e[:, i + 1] * b[:, i + 1]) @ step.T / c[:, i + 1, None]
        return a, b, c

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood a window of label sequences y."""
        (hf, kf), (hb, kb) = self._run(x, "f"), self._run(x, "b")
        both = np.concatenate([hf, hb], axis=2)
        kind = both.dtype
        e, tr = both @ self.w["wo"] + self.w["bo"], self.w["tr"] + _BARRED.astype(kind)
        n, t, _ = e.shape
        top, step = e.max(2, keepdims=True), np.exp(self.w["tr"]) * _ALLOWED
        scaled = np.exp(e - top)
        a, b, c = self._passes(scaled, step)
        z = np.log(c).sum(1) + top.sum((1, 2))
        rows = np.arange(n)[:, None]
        gold = e[rows, np.arange(t), y].sum(1) + tr[y[:, :-1], y[:, 1:]].sum(1)
        de = a * b
        de[rows, np.arange(t), y] -= 1
        ahead = scaled[:, 1:] * b[:, 1:] / c[:, 1:, None]
        dtr = np.tensordot(a[:, :-1], ahead, ((0, 1), (0, 1))) * step
        np.add.at(dtr, (y[:, :-1], y[:, 1:]), -1)
        g = {"wo": np.tensordot(both, de, ((0, 1), (0, 1))), "bo": de.sum((0, 1)), "tr": np.where(_ALLOWED, dtr, 0)}
        dh_out = de @ self.w["wo"].T
        for d, kept, half in (("f", kf, slice(0, HIDDEN)), ("b", kb, slice(HIDDEN, None))):
            wh = self.w["wh" + d]
            gx, gh, gb = np.zeros_like(self.w["wx" + d]), np.zeros_like(wh), np.zeros(4 * HIDDEN, dtype=kind)
            dh, dc = np.zeros((n, HIDDEN), dtype=kind), np.zeros((n, HIDDEN), dtype=kind)
            for i in range(t - 1, -1, -1) if d == "f" else range(t):
                h0, c0, s, cell, tc = kept[i]
                dh = dh + dh_out[:, i, half]
                dc = dc + dh * s[:, 2 * HIDDEN :] * (1 - tc**2)
                dz = np.concatenate([dc * cell, dc * c0, dh * tc], axis=1) * s * (1 - s)
                dz = np.concatenate([dz, dc * s[:, :HIDDEN] * (1 - cell**2)], axis=1)
                gx += (x[:, i, None] == np.arange(CLASSES)).T.astype(kind) @ dz
                gh += h0.T @ dz
                gb += dz.sum(0)
                dh, dc = dz @ wh.T, dc * s[:, HIDDEN : 2 * HIDDEN]
            g |= {"wx" + d: gx, "wh" + d: gh, "b" + d: gb}
        return float((z - gold).mean()), {k: v / n for k, v in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> list[float]:
        """Adam over shuffled batches, in single precision; the mean loss of each pass."""
        self.w = {k: q.astype(np.float32) for k, q in self.w.items()}
        rng, m, v, step, losses = np.random.default_rng(seed), {}, {}, 0, []
        for epoch in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            for i in range(0, len(x), BATCH):
                part = order[i : i + BATCH]
                loss, g = self.loss_and_gradient(x[part], y[part])
                total += loss * len(part)
                norm = np.sqrt(sum((q**2).sum() for q in g.values()))
                step += 1
                for k, q in g.items():
                    q = q * min(1.0, 5 / max(norm, 1e-9))
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * q
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * q**2
                    self.w[k] = (self.w[k] - RATE / (1 + epoch) ** 0.5 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(total / len(x))
        return losses

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(windows, WINDOW, LABELS): how probable each label is at each character, over all label sequences."""
        w = {k: v.astype(np.float32) for k, v in self.w.items()}
        n, t = x.shape
        e = np.zeros((n, t, LABELS), dtype=np.float32) + w["bo"]
        for d, half in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            h = c = np.zeros((n, HIDDEN), dtype=np.float32)
            for i in range(t) if d == "f" else range(t - 1, -1, -1):
                z = (w["wx" + d] + w["b" + d])[x[:, i]] + h @ w["wh" + d]
                s = _sigmoid(z[:, : 3 * HIDDEN])
                c = s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])
                h = s[:, 2 * HIDDEN :] * np.tanh(c)
                e[:, i] += h @ w["wo"][half]
        e, step = np.exp(e - e.max(2, keepdims=True)), np.exp(w["tr"]) * _ALLOWED
        a, b, _ = self._passes(e, step.astype(np.float32))
        p = a * b
        return p / p.sum(2, keepdims=True)


def best_labels(p: np.ndarray) -> np.ndarray:
    """(runs, characters): of some runs of equal length the likeliest labels that keep the rules, by the labels' probabilities."""
    score = np.log(np.maximum(p, 1e-12))
    best, back = score[:, 0] + _FIRST, np.zeros(p.shape, dtype=np.int64)
    for i in range(1, p.shape[1]):
        ways = best[:, :, None] + _BARRED
        back[:, i] = ways.argmax(1)
        best = ways.max(1) + score[:, i]
    y = np.zeros(p.shape[:2], dtype=np.int64)
    y[:, -1] = best.argmax(1)
    for i in range(p.shape[1] - 1, 0, -1):
        y[:, i - 1] = back[np.arange(len(y)), i, y[:, i]]
    return y


def _spelled(text: str) -> list[int]:
    """Where spelled and bracketed signs are; texts without their letters are not searched."""
    low = text.lower()
    if not any(x in low for x in ("dot", "at)", "at]", "at}", "at>", "at )", "at ]", "ät", "[.]", "(.)", " at ", "arroba", "arobase", "klammeraffe", "\uff20")):
        return []
    return [m.start() for m in _SPELLED.finditer(text)]


def _window_starts(text: str, c: np.ndarray) -> np.ndarray:
    """Starts, on the stride, of the windows that hold four digits (an IP address has no fewer), and of those that hold @ or a spelled or bracketed sign, with their neighbours."""
    digit, at = np.flatnonzero(c == 1), np.union1d(np.flatnonzero(c == 4 + _SIGNS.index("@")), _spelled(text)).astype(np.int64)
    first = lambda x: np.maximum(x - WINDOW, -1) // STRIDE + 1
    some = np.unique(np.concatenate([first(digit), digit // STRIDE]))
    some = some[np.searchsorted(digit, some * STRIDE + WINDOW) - np.searchsorted(digit, some * STRIDE) >= 4]
    signs = [np.maximum(first(at) - 1, 0), first(at), at // STRIDE, at // STRIDE + 1]
    return np.unique(np.concatenate([some, *signs])).astype(np.int64) * STRIDE


def _windows(c: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.concatenate([c, np.zeros(WINDOW + STRIDE, dtype=np.uint8)])
    return padded[starts[:, None] + np.arange(WINDOW)]


# ---- training


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


#: Words before numbers that are read out as telephone numbers, and before others.
_CALL_WORDS = "tel tel: tel. phone phone: call mobile mobile: cell fax whatsapp telefon telefon: handy anrufen rückruf móvil teléfono llama llámame tél tél. téléphone portable appelez ring dial sms".split()
_COUNT_WORDS = "page pages order invoice id no. nr. ref ref: part serial batch total population pop. sum result results tax code item lot case ticket account isbn ean seite bestellung rechnung página pedido factura commande facture lines row rows rank score year copies visitors".split()


def _blank(rng: np.random.Generator) -> str:
    return (" ", " ", " ", "\u00a0", "\u202f", "\u2009")[int(rng.integers(6))]


def _rewritten(kind: str, part: str, rng: np.random.Generator) -> str:
    """A span's text with other digits, and mostly in a form that the base patterns don't take."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    part = _made(kind, rng) if kind == "ip" else "".join(_digits(rng, 1) if "0" <= c <= "9" else c for c in part)
    if rng.random() < 0.3:
        return part
    digits, s = "".join(c for c in part if "0" <= c <= "9"), _blank(rng)
    if kind == "email":
        user, _, host = part.rpartition("@")
        if rng.random() < 0.3:
            return user + pick(" @ ", "\uff20", "@ ", " @") + host
        at = pick("at", "at", "at", "AT", "At", "ät", "arroba", "arobase")
        dot = pick("dot", "dot", "DOT", "punkt", "punto", "point", ".")
        sign = pick(f" {at} ", f" [{at}] ", f"[{at}]", f"({at})", f" ({at}) ", f"{{{at}}}", f"<{at}>", f"[ {at} ]", f"( {at} )")
        return user + sign + host.replace(".", pick(f" {dot} ", f"[{dot}]", f"({dot})", f" [{dot}] ", f" ({dot}) ", ".", ".", ".", "[.]"))
    if kind == "ip":
        return pick("[.]", "(.)", " . ", "[dot]", " dot ", ". ", "-", ",", ", ", " - ", "\uff0e", "(dot)", f".{s}", "{.}", "_").join(str(rng.integers(256)) for _ in range(4))
    if kind == "card":
        digits = _with_check(digits)
        size = pick(4, 4, 4, len(digits), 6)
        return pick(".", "  ", "/", " - ", "_", "--", "\u00a0", "\u202f", ", ", ",", " . ", "\u2013").join(digits[i : i + size] for i in range(0, len(digits), size))
    digits = (digits + _digits(rng, 11))[:11]
    code, area, a, b = pick(digits[:1], digits[:2]), digits[-10:-7], digits[-7:-4], digits[-4:]
    sure = pick(
        f"{code} ({area}) {a}-{b}", f"({area}) {a}-{b}", f"({area}){s}{a}{s}{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"{code}-{area}-{a}-{b}", f"{code} {area} {a} {b}",
        f"00{code} {area} {a}{b}", f"0{area}/{a}{b}", f"0{area}-{a}{b}", f"00{code}-{area}-{a}-{b}", f"{code}.{area}.{a}.{b}", f"00{code}{s}{area}{s}{a}{s}{b}", f"0{digits[0]}{s}{s.join(digits[i : i + 2] for i in range(1, 9, 2))}", f"0{digits[0]}{s}{s.join(digits[i : i + 2] for i in range(1, 9, 2))}", f"0{digits[:2]}{s}{digits[2:6]}{s}{digits[6:10]}", f"0{digits[:3]}{s}{digits[3:10]}",
        f"{area}-{a}-{b}", f"00{code}{s}{digits[0]}{s}{s.join(digits[i : i + 2] for i in range(1, 9, 2))}", f"00{code}-{digits[:2]}-{digits[2:9]}", f"{digits[0]}-{area}-{a}-{b}", f"0{digits[:4]}-{digits[4:9]}",
        f"(0{area}) {a} {b}", f"0{area} / {a} {b}", f"00{code}-{digits[:2]}-{digits[2:8]}", f"+{code}/{area}/{a}{b}", f"+{code}\u00a0{area}\u00a0{a}\u00a0{b}", f"(+{code}) {area} {a} {b}", f"+{code} ({area}) {a}\u2013{b}",
    )
    return sure


def _unsure_number(rng: np.random.Generator) -> str:
    """Groups of digits that a word before them makes a telephone number or not."""
    d, s = (lambda n: _digits(rng, n)), _blank(rng)
    forms = (lambda: s.join(d(3) for _ in range(3)), lambda: d(10), lambda: d(9), lambda: f"{d(3)}-{d(3)}-{d(3)}", lambda: f"{d(4)}{s}{d(3)}{s}{d(3)}", lambda: f"{d(5)}{s}{d(6)}", lambda: f"{d(3)}{s}{d(7)}", lambda: f"{d(2)}{s}{d(4)}{s}{d(4)}")
    return forms[int(rng.integers(len(forms)))]()


def _with_check(digits: str) -> str:
    """The digits with the last one such that they pass Luhn's check."""
    return next(x for x in (digits[:-1] + str(i) for i in range(10)) if luhn(x))


def _made(kind: str, rng: np.random.Generator) -> str:
    """A span of the kind, before it is rewritten."""
    word = lambda: "".join(chr(97 + i) for i in rng.integers(0, 26, rng.integers(2, 10)))
    if kind == "email":
        many = lambda n: int(rng.choice(n, p=np.array([0.5, 0.3, 0.1, 0.1][:n]) / sum([0.5, 0.3, 0.1, 0.1][:n]))) + 1
        user = ("." if rng.random() < 0.6 else "_").join(word() for _ in range(many(4))) + (_digits(rng, 2) if rng.random() < 0.3 else "")
        part = lambda: word() + ("-" + word() if rng.random() < 0.25 else "")
        return user + "@" + ".".join(part() for _ in range(many(4))) + "." + word()[: int(rng.integers(2, 8))]
    if kind == "ip":
        return ".".join(str(rng.integers(256)) for _ in range(4))
    if kind == "card":
        d = _with_check(_digits(rng, 16))
        return " ".join(d[i : i + 4] for i in range(0, 16, 4))
    return "+" + _digits(rng, int(rng.integers(9, 13)))


def _other_number(rng: np.random.Generator) -> str:
    """A number that is no span: dates, times, amounts, versions, serial and account-like numbers, lists."""
    d, s = (lambda n: _digits(rng, n)), _blank(rng)
    if rng.random() < 0.25:
        return f"{_COUNT_WORDS[int(rng.integers(len(_COUNT_WORDS)))]} {_unsure_number(rng)}"
    forms = (
        lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"{d(2)}.{d(2)}.{d(4)}", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"{d(1)},{d(3)}.{d(2)}", lambda: f"{d(1)}.{d(2)}.{d(1)}", lambda: f"{d(3)}-{d(2)}-{d(4)}",
        lambda: f"INV-{d(4)}-{d(5)}", lambda: f"#{d(7)}", lambda: d(int(rng.integers(1, 12))), lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"{d(2)}.{d(5)}, {d(1)}.{d(5)}", lambda: f"19{d(2)}-20{d(2)}", lambda: ", ".join(d(1) for _ in range(5)),
        lambda: f"{d(2)}%", lambda: f"v{d(1)}.{d(2)}", lambda: f"id={d(8)}", lambda: f"${d(3)}.{d(2)}", lambda: f"{d(4)}-{d(4)}", lambda: f"20{d(2)}-{d(2)}-{d(2)}T{d(2)}:{d(2)}:{d(2)}Z", lambda: "dot", lambda: f"at {d(2)}:{d(2)}", lambda: f"{d(3)} {d(3)}",
        # amounts in groups of three, numbers in series, ranges, measures, long serial numbers
        lambda: s.join([str(rng.integers(1, 1000)), *(d(3) for _ in range(int(rng.integers(2, 4))))]), lambda: ".".join([str(rng.integers(1, 1000)), d(3), d(3)]), lambda: ",".join([str(rng.integers(1, 1000)), d(3), d(3), d(3)][: int(rng.integers(3, 5))]),
        lambda: " ".join(str(rng.integers(1, 100)) for _ in range(int(rng.integers(4, 9)))), lambda: " ".join(str(n + i) for n in [int(rng.integers(10, 90))] for i in range(6)), lambda: f"{d(2)} {d(3)} {d(3)} {d(3)}", lambda: f"20{d(2)}-{d(9)}", lambda: f"{d(4)}-20{d(2)}-{d(4)}",
        lambda: f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(1)}.{d(3)}.{d(1)}", lambda: f"{d(4)} {d(4)} {d(4)}", lambda: f"20{d(2)} 20{d(2)} 20{d(2)}", lambda: f"{d(2)}:{d(2)} - {d(2)}:{d(2)}", lambda: f"{d(3)} x {d(3)} x {d(2)} mm", lambda: f"{d(2)}, {d(2)}, {d(2)}, {d(2)}, {d(2)}", lambda: f"{d(1)}-{d(1)}, {d(2)}-{d(2)}, {d(3)}-{d(3)}",
        lambda: f"20{d(2)}{d(4)}{d(6)}", lambda: d(12), lambda: f"{d(4)}/{d(4)}/{d(4)}", lambda: f"{d(3)}/{d(3)}/{d(5)}", lambda: "look at this. dot", lambda: f"at home. {d(2)}", lambda: f"point {d(1)}.{d(1)}", lambda: f"§ {d(3)} {d(3)} {d(2)}",
    )
    return forms[int(rng.integers(len(forms)))]()


def _varied(text: str, spans: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """The text with its spans rewritten and, between words, some spans more and some other numbers; and where the spans are."""
    taken, last, out, found, size = sorted(spans, key=lambda s: s[1]), 0, [], [], 0
    gaps = [m.start() for m in re.finditer(" ", text) if not any(a <= m.start() < b for _, a, b in spans)]
    some = rng.choice(gaps, min(len(gaps), 1 + len(gaps) // 25), replace=False).tolist() if gaps else []
    edits = [(a, b, kind, None) for kind, a, b in taken] + [(g, g, None, _other_number(rng) if rng.random() < 0.5 else KINDS[int(rng.integers(len(KINDS)))]) for g in some]
    for a, b, kind, more in sorted(edits, key=lambda e: e[:2]):
        if a < last:
            continue
        lead = "" if kind else " "
        if not kind and more == "phone" and rng.random() < 0.25:
            lead += f"{_CALL_WORDS[int(rng.integers(len(_CALL_WORDS)))]} "
            new = lead + _unsure_number(rng)
        elif not kind and more not in KINDS and rng.random() < 0.4:
            new = lead + f"{_COUNT_WORDS[int(rng.integers(len(_COUNT_WORDS)))]} {more}"
        else:
            new = lead + (_rewritten(kind, text[a:b], rng) if kind else _rewritten(more, _made(more, rng), rng) if more in KINDS else more)
        out += [text[last:a], new]
        size += a - last
        if kind or more in KINDS:
            found.append((kind or more, size + len(lead), size + len(new)))
        size, last = size + len(new), b
    return "".join([*out, text[last:]]), found


def training_windows(texts: list[str], most: int = TRAIN_WINDOWS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Most windows of character classes and labels around spans and other digits and signs, chosen at random.

    The texts are varied anew until there are enough, so that a small sample gives as many windows as a large one.
    """
    rng, xs, ys = np.random.default_rng(seed), [], []
    texts = [t for t in texts if " " in t]
    held, rounds = 0, iter(range(200))
    for text in (t for _ in rounds for t in rng.permutation(np.array(texts, dtype=object)).tolist()):
        if held > 2 * most:
            break
        text, spans = _varied(text, base_spans(text), rng)
        c = classes(text)
        y = np.zeros(len(c) + WINDOW, dtype=np.int64)
        for kind, a, b in spans:
            y[a:b] = 2 + 2 * KINDS.index(kind)
            y[a] -= 1
        starts = _window_starts(text, c)
        if len(starts):
            starts = np.unique(np.clip(starts + rng.integers(-STRIDE // 2, STRIDE // 2, len(starts)), 0, max(0, len(c) - 1)))
            held += len(starts)
            xs.append(_windows(c, starts))
            ys.append(y[starts[:, None] + np.arange(WINDOW)])
    if not xs:
        return np.zeros((0, WINDOW), dtype=np.uint8), np.zeros((0, WINDOW), dtype=np.int64)
    x, y = np.concatenate(xs), np.concatenate(ys)
    y[:, 0] = np.where((y[:, 0] > 0) & (y[:, 0] % 2 == 0), y[:, 0] - 1, y[:, 0])  # a span that is cut begins at the edge
    keep = rng.permutation(len(x))[:most]
    return x[keep], y[keep]


def fit_tagger(docs: DataFrame, bound: int = TRAIN_DOCS, windows: int = TRAIN_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> Tagger | None:
    """Trained on about bound documents with a digit or @ at most, chosen by hash of the id, and on so many of their windows at most; None without labelled spans."""
    some = docs.where(F.col(text_col).rlike("[0-9@]"))
    n = some.count()
    keep = some.where(hash_share(n, bound, id_col, "pii"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # only the surroundings of digits and signs are worth sending
        for b in batches:
            parts = [p for t in b.column(0).to_pylist() for p in _surroundings(t)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string())], names=["text"])

    texts = sorted(keep.select(text_col).mapInArrow(cut, "text string").toArrow()["text"].to_pylist())
    if not any(map(base_spans, texts)):
        return None
    x, y = training_windows(texts, windows)
    tagger = Tagger.fresh()
    tagger.fit(x, y)
    return tagger


def _surroundings(text: str, reach: int = 96) -> Iterator[str]:
    """Stretches around digits and @ signs."""
    at = [m.start() for m in re.finditer("[0-9@]", text)]
    i = 0
    while i < len(at):
        j = i
        while j + 1 < len(at) and at[j + 1] - at[j] <= 2 * reach and at[j + 1] - at[i] <= 2000:
            j += 1
        yield text[max(0, at[i] - reach) : at[j] + reach]
        i = j + 1


def _plausible(kind: str, part: str) -> bool:
    """Whether the span has what its kind can't do without."""
    part = unicodedata.normalize("NFKC", part)
    digits = "".join(c for c in part if "0" <= c <= "9")
    if kind == "email":
        return bool(_AT.search(part, 1)) and any(c.isalpha() for c in part)
    if kind == "ip":
        parts = re.findall("[0-9]+", part)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    if any(c.isalpha() for c in part):
        return False
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def _settled(kind: str, text: str, start: int, end: int) -> tuple[int, int]:
    """Ends of a span by its kind: an address has one word before its sign and a host of several parts behind, a number goes on while digits and the span's own separators do.

    An address whose sign isn't at or near the span, or has no name or host, is an empty span.
    """
    if kind == "email":
        for sign in reversed([*_AT.finditer(text, max(0, start - 2), min(len(text), end + 16))]):
            name, host = _NAME.search(text, max(0, start - 64), sign.start()), _HOST.match(text, sign.end())
            if name and host and name.start() < end and host.end() > start:
                return name.start(), host.end()
        return end, end
    part = text[start:end]
    if any(c.isalpha() for c in part):
        return start, end
    own = {c for c in part if not c.isdigit()} | {*_DIGITS}
    a, b = start, end
    while a and text[a - 1] in own:
        a -= 1
    while b < len(text) and text[b] in own:
        b += 1
    m = _EDGE.search(text, a, b)
    return m.span() if m and not _plausible(kind, part) else (start, end)


def _block_probabilities(tagger: Tagger, x: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the blocks of STRIDE characters that windows cover, and the labels' probabilities there, averaged over windows. places: of each window's first block."""
    blocks, at = np.unique(np.concatenate([places, places + 1]), return_inverse=True)
    trust = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)
    p, total = np.zeros((len(blocks), STRIDE, LABELS), dtype=np.float32), np.zeros((len(blocks), STRIDE), dtype=np.float32)
    for i in range(0, len(x), 2048):
        some = tagger.probabilities(x[i : i + 2048]) * trust[None, :, None]
        for half, k in ((slice(0, STRIDE), at[i : len(places)][: len(some)]), (slice(STRIDE, None), at[len(places) + i :][: len(some)])):
            np.add.at(p, k, some[:, half])
            np.add.at(total, k, trust[half])
    return blocks, p / total[:, :, None]


def _added(text: str, taken: list[tuple[int, int]], runs: list[tuple[int, np.ndarray, np.ndarray]]) -> list[Span]:
    """The sure and plausible spans of decoded runs (start, labels, all labels' probabilities) that touch no span of the base.

    A span takes the likeliest kind whose check it passes, which need not be the decoded one.
    """
    out, begins, ends = [], [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for at, y, p in runs:
        for a in np.flatnonzero(y % 2 == 1).tolist():
            b = a + 1
            while b < len(y) and y[b] == y[a] + 1:
                b += 1
            # letters and digits that belong to a word at either end come along
            start, end = min(at + a, len(text)), min(at + b, len(text))
            while 0 < start < len(text) and text[start].isalnum() and text[start - 1].isalnum():
                start -= 1
            while 0 < end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
                end += 1
            m = _EDGE.search(text, start, end)
            if not m or 1 - p[a:b, 0].mean() < CONFIDENCE:
                continue
            of_kind = p[a:b, 1::2].mean(0) + p[a:b, 2::2].mean(0)
            found = ((KINDS[k], *_settled(KINDS[k], text, *m.span())) for k in np.argsort(-of_kind, kind="stable") if of_kind[k] >= LOOK)
            kind, start, end = next((f for f in found if _plausible(f[0], text[f[1] : f[2]])), (None, 0, 0))
            if kind is None:
                continue
            before = bisect_left(begins, end)
            if start < end and (not before or ends[before - 1] <= start) and not any(start < e and s < end for _, s, e in out[-4:]):  # runs come in order
                out.append((kind, start, end))
    return out


def find_spans(texts: list[str | None], tagger: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and its added ones."""
    base = [base_spans(t or "") for t in texts]
    out: list[tuple[list[Span], list[Span]]] = [(spans, []) for spans in base]
    if not tagger:
        return out
    held, places, ends = [], [], [0]
    for t in texts:  # a text's blocks are numbered from ends on, with one between texts that none has
        if t and ("@" in t or _DIGIT.search(t) or _spelled(t)):
            c = classes(t)
            starts = _window_starts(t, c)
            held.append(_windows(c, starts))
            places.append(ends[-1] + starts // STRIDE)
        ends.append(ends[-1] + len(t or "") // STRIDE + 3)
    if not held:
        return out
    blocks, p = _block_probabilities(tagger, np.concatenate(held), np.concatenate(places))
    owner = np.searchsorted(ends, blocks, side="right") - 1
    # runs of characters that may be in a span, by length
    at = (blocks[:, None] * STRIDE + np.arange(STRIDE)).ravel()
    p = p.reshape(-1, LABELS)
    near = np.flatnonzero(p[:, 0] < 1 - LOOK)
    runs: dict[int, list[np.ndarray]] = {}
    for run in np.split(near, np.flatnonzero(np.diff(at[near]) != 1) + 1) if len(near) else ():
        runs.setdefault(len(run), []).append(run)
    decoded: dict[int, list] = {}
    for rows in (np.array(x) for x in runs.values()):
        some = p[rows]
        y = best_labels(some)
        for i in np.flatnonzero((y > 0).any(1)).tolist():
            text = int(owner[rows[i, 0] // STRIDE])
            decoded.setdefault(text, []).append((int(at[rows[i, 0]]) - ends[text] * STRIDE, y[i], some[i]))
    for i, some in decoded.items():
        taken = sorted((a, b) for _, a, b in base[i])
        out[i][1].extend(_added(texts[i], taken, sorted(some, key=lambda r: r[0])))
    return out


def spans_string(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def tag_documents(docs: DataFrame, tagger: Tagger | None, text_col: str = "text") -> DataFrame:
    """docs without the text but with n_email, n_ip, n_card, n_phone and base_sha256 of the base, spans (all) and n_added; these replace columns of their names."""
    shipped = docs.sparkSession.sparkContext.broadcast(tagger)
    others = [c for c in docs.columns if c not in (text_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1000, 1 << 22):
            found = find_spans(b.column(0).to_pylist(), shipped.value)
            counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64()) for kind in KINDS]
            sha = [hashlib.sha256(spans_string(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], *counts, pa.array(sha, pa.string()), pa.array([spans_string(base + more) for base, more in found], pa.string()), pa.array([len(more) for _, more in found], pa.int64())],
                names=[*others, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    schema = docs.select(*others).schema
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    return docs.select(text_col, *others).mapInArrow(run, schema.add("base_sha256", "string").add("spans", "string").add("n_added", "long"))
