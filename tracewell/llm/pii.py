"""Personal data: base patterns, then span candidates judged by gradient-boosted trees.

Base spans come from fixed patterns with their checks and always stay. Generators with high
recall then propose further, overlapping candidates (obscured mail addresses, local telephone
numbers, cut or masked card numbers, national identity numbers, bank accounts, IPv6 addresses, long
random keys). Boosted trees look at the
format of a candidate and at the text around it; a threshold calibrated on held-back candidates
decides which are added. Where accepted spans overlap, the likelier one stays.

No table labels spans, so the trees learn from a bounded sample that labels itself: personal data
written in other ways (``alice at mail dot example dot com``) and put into sampled texts are positives;
numbers and words that merely look like it are negatives.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import pickle
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import ship, slices, text_views

BASE = ("email", "ip", "card", "phone")
#: Kinds that only the method adds; they sort after the base kinds, in this order.
ADDED = ("email_obscured", "phone_local", "ip6", "secret", "card_cut", "national_id", "iban")
KINDS = BASE + ADDED
#: Rows that the trees learn from, at most, and the share of true candidates that added spans must have.
SAMPLE_ROWS = 1500
SAMPLE_CHARS = 4000
#: Candidates of a kind, true and false ones each, under which the built-in texts are learnt from too.
KIND_LEAST = 150
PRECISION = 0.98

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run that fails at its start fails everywhere inside, so only starts of runs are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, leftmost and not overlapping within a kind, that pass their checks."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


# ---- candidates -------------------------------------------------------------------------------

_GENERATORS = {
    "email_obscured": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[({<] ?at ?[\])}>] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({<] ?dot ?[\])}>]| dot ) ?[A-Za-z0-9-]{2,63}){1,5}|[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{2,63}){1,5}"),
    "phone_local": re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4})?(?![0-9])"),
    "ip6": re.compile(r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?:%[0-9A-Za-z]+)?(?![0-9A-Za-z:])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+"),
    "card_cut": re.compile(r"(?<![0-9])(?:[0-9]{4}(?:[ ./_,|\n-]{1,3}[0-9]{4}){2}[ ./_,|\n-]{1,3}[0-9]{1,7}|[0-9]{4}[ ./_,|\n-]{1,3}[0-9]{6}[ ./_,|\n-]{1,3}[0-9]{5}|[0-9]{4}(?:[ -]?[0-9Xx*\u2022]{2,4}){2,3}[ -]?[0-9]{4})(?![0-9])"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
}
_CUES = {
    "email_obscured": (" at ", "at)", "at]", "at}", "at>"),
    "phone_local": None,
    "ip6": (":",),
    "secret": None,
    "card_cut": None,
    "national_id": None,
    "iban": None,
}
_CONTEXT = re.compile(r"(mail|contact|write|reach|@)|(phone|tel|call|mobile|fax|ring)|(ip|host|addr|server|ping)|(token|key|secret|passw|auth|bearer|api)|(version|order|invoice|isbn|ref|no\.|page|date|part)|(ssn|social|tax|identity|passport|iban|account|bank|card|visa|credit)", re.I)
AROUND = 40


def candidates(text: str, digits: bool | None = None) -> list[Span]:
    """What the generators propose; candidates of several kinds may overlap."""
    out: list[Span] = []
    digits = bool(_DIGIT.search(text)) if digits is None else digits
    for kind, pattern in _GENERATORS.items():
        cues = _CUES[kind]
        if digits if cues is None else any(c in text for c in cues):
            # Keys hold a digit somewhere; a lookahead for it would have to have a bound.
            out += [(kind, *m.span()) for m in pattern.finditer(text) if kind != "secret" or _DIGIT.search(text, *m.span())]
    return out


def features(text: str, span: Span) -> list[float]:
    """Format of the span and words around it."""
    kind, a, b = span
    s, n = text[a:b], b - a
    digits = sum(map(str.isdigit, s))
    letters = sum(map(str.isalpha, s))
    upper = sum(map(str.isupper, s))
    seen: dict[str, int] = {}
    for ch in s:
        seen[ch] = seen.get(ch, 0) + 1
    entropy = -sum(c / n * math.log2(c / n) for c in seen.values())
    turns = sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:])) / n
    before, after = text[max(0, a - AROUND) : a], text[b : b + AROUND]
    words = [0.0] * 6
    for m in _CONTEXT.finditer(before):
        words[m.lastindex - 1] = 1.0
    groups = re.findall(r"[0-9]+", s)
    last = re.split(r"[^A-Za-z]+", s)[-1]
    quoted = float(before[-1:] in ("'", '"', "`", "=") or after[:1] in ("'", '"', "`"))
    return [float(ADDED.index(kind)), n, digits / n, letters / n, upper / n, entropy, turns, s.count(" ") / n, float(len(groups)), float(len(groups[-1]) if groups else 0), float(len(last)), float(len(re.findall(r"\bdot\b|\.", s))), float("[" in s or "(" in s), s.count(":"), float(bool(re.fullmatch(r"[0-9a-f]+", s))), quoted, float(before[-2:].strip() in ("=", ":")), *words, *_checks(s)]


def _checks(s: str) -> list[float]:
    """Whether a text passes the checks of cards, accounts, addresses and identity numbers; how much of it is masked."""
    digits = re.sub("[^0-9]", "", s)
    plain = re.sub("[ -]", "", s)
    account = "".join(str(int(ch, 36)) for ch in plain[4:] + plain[:4]) if plain.isascii() and plain.isalnum() and len(plain) < 40 else ""
    try:
        six = float(":" in s and ipaddress.IPv6Address(s).packed != bytes(16))
    except ValueError:
        six = 0.0
    area = float(len(s) == 11 and s[3:4] == "-" and s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000")
    return [float(13 <= len(digits) <= 19 and luhn(digits)), float(bool(account) and int(account) % 97 == 1), six, area, sum(ch in "*xX\u2022" for ch in s) / len(s)]


# ---- boosted trees ----------------------------------------------------------------------------


class Boosted:
    """Logistic gradient boosting of depth-2 trees over at most 32 cuts a feature."""

    def __init__(self, rounds: int = 60, rate: float = 0.25):
        self.rounds, self.rate, self.trees, self.start = rounds, rate, [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start = math.log(share / (1 - share))
        f = np.full(len(y), self.start)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 32))) for j in range(x.shape[1])]
        codes = [np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]  # how many cuts lie below a value
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(codes, y - p, p * (1 - p), np.arange(len(y)), cuts, 2)
            self.trees.append(tree)
            f += self.rate * self._apply(tree, x)
        return self

    def _grow(self, codes, g, h, at, cuts, depth):
        total_g, total_h = g[at].sum(), h[at].sum() + 1.0
        leaf = total_g / total_h
        if not depth or len(at) < 8:
            return leaf
        best, gain = None, 1e-4
        for j, values in enumerate(cuts):
            code = codes[j][at]
            gl = np.cumsum(np.bincount(code, g[at], len(values) + 1))[:-1]
            hl = np.cumsum(np.bincount(code, h[at], len(values) + 1))[:-1] + 1.0
            gr, hr = total_g - gl, total_h - hl + 1.0
            won = gl * gl / hl + gr * gr / hr - total_g * total_g / total_h
            k = int(np.argmax(won))
            if won[k] > gain:
                best, gain = (j, k), won[k]
        if best is None:
            return leaf
        j, k = best
        left = codes[j][at] <= k
        return (j, float(cuts[j][k]), self._grow(codes, g, h, at[left], cuts, depth - 1), self._grow(codes, g, h, at[~left], cuts, depth - 1))

    def _apply(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, c, low, high = tree
        left = x[:, j] <= c
        return np.where(left, self._apply(low, x), self._apply(high, x))

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        for tree in self.trees:
            f += self.rate * self._apply(tree, x)
        return 1 / (1 + np.exp(-f))


#: The added kind that a base kind is disguised as.
_AS = {"email": "email_obscured", "ip": "ip6", "card": "card_cut", "phone": "phone_local"}


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng: random.Random) -> str:
    """Sixteen digits that pass Luhn."""
    body = rng.choice("3456") + _digits(rng, 14)
    return next(body + d for d in "0123456789" if luhn(body + d))


def _account(rng: random.Random) -> str:
    """A bank account with its check digits."""
    country, body = rng.choice((("DE", 18), ("FR", 23), ("GB", 18), ("ES", 20), ("NL", 14)))
    rest = ("".join(rng.choice("ABCDEFGHKLMN") for _ in range(4)) if country in ("GB", "NL") else "") + _digits(rng, body)
    rest = rest[:body]
    check = 98 - int("".join(str(int(ch, 36)) for ch in rest + country + "00")) % 97
    whole = f"{country}{check:02d}{rest}"
    return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if rng.randrange(2) else whole


def disguised(rng: random.Random, kind: str, value: str) -> str:
    """Personal data of an added kind, from a base value where it has one."""
    if kind == "email_obscured":
        if "@" not in value:
            name, other = ("".join(rng.choice(("ba", "ri", "lo", "ne", "ta", "mi", "su", "jo", "ker", "an")) for _ in range(rng.randrange(1, 4))) for _ in range(2))
            value = rng.choice((name, f"{name}.{other}", f"{name}{rng.randrange(99)}", f"{name}_{other[:2]}")) + "@" + rng.choice((other, f"mail.{other}", f"{other}{rng.randrange(9)}.{name}")) + rng.choice((".com", ".org", ".net", ".de", ".co.uk", ".io", ".info"))
        local, domain = value.split("@", 1)
        at, dot = ((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."))[rng.randrange(3)]
        return local + at + domain.replace(".", dot)
    if kind == "ip6":
        groups = [f"{rng.randrange(65536):x}" for _ in range(8)]
        style = rng.randrange(4)
        k = rng.randrange(1, 6)
        return (":".join(groups), ":".join(groups[:k]) + "::" + ":".join(groups[k + 1 :][: rng.randrange(0, 3)]), f"fe80::{groups[0]}", f"2001:db8::{groups[1]}:{groups[2]}")[style]
    if kind == "phone_local":
        d = re.sub("[^0-9]", "", value)[-10:].rjust(10, "5") if value.startswith("+") else _digits(rng, 10)
        return (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}")[rng.randrange(3)]
    if kind == "card_cut":
        c = _card(rng)
        cut = rng.choice((".", "/", " - ", "  ", "_", "\n"))
        masked = f"{c[:4]} {rng.choice(('****', 'XXXX', 'xxxx'))} {rng.choice(('****', 'XXXX'))} {c[12:]}"
        return rng.choice((cut.join((c[:4], c[4:8], c[8:12], c[12:])), masked))
    if kind == "national_id":
        return f"{rng.randrange(1, 899):03d}-{rng.randrange(1, 99):02d}-{rng.randrange(1, 9999):04d}".replace("666-", "665-")
    if kind == "iban":
        return _account(rng)
    alphabet = rng.choice(("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    return "".join(rng.choice(alphabet) for _ in range(rng.choice((32, 40, 48, 88, 344))))


def lookalikes(rng: random.Random, words: list[str], i: int) -> list[str]:
    """What the generators propose, or nearly so, and is no personal data."""
    n = rng.randrange(10**6)
    card = _digits(rng, 16)
    card = card if not luhn(card) else card[:-1] + str((int(card[-1]) + 1) % 10)
    account = _account(rng).replace(" ", "")
    return [
        f"{words[i]} at {words[i + 1]} dot", f"{words[i]} at {words[i + 1]} {words[i + 2]}", f"{words[i]} (at) {words[i + 1]}.",
        f"{n % 2000}-{n % 12 + 1:03d}-{n % 28 + 1:02d}", f"{n % 24}:{n % 60:02d}:{n % 59:02d}", f"{words[i]} :: {words[i + 1]}", f" :: {words[i]}", "::",
        f"{words[i]}-{words[i + 1]}-{words[i + 2]}-2024", f"/usr/{words[i]}/{words[i + 1]}/{words[i + 2]}/v2", f"page {n % 99} {n % 999:03d} {n % 99:02d}", "_".join(words[i : i + 3]).lower() + "_1",
        " - ".join((card[:4], card[4:8], card[8:12], card[12:])), ".".join((card[:4], card[4:8], card[8:12], card[12:])), "1998 - 2003 - 2008 - 2013", f"{rng.randrange(900, 999)}-{n % 99:02d}-{n % 9999:04d}", f"000-{n % 99:02d}-{n % 9999:04d}", f"part {n % 899 + 1:03d}-{n % 99:02d}-0000",
        account[:2] + f"{(int(account[2:4]) + 7) % 100:02d}" + account[4:], f"AB{n % 90 + 10} {_digits(rng, 4)} {_digits(rng, 4)} {_digits(rng, 4)}",
    ]


def training_set(texts: list[str], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Self-labelled candidates: disguised personal data as positives, look-alikes as negatives."""
    rng, x, y = random.Random(seed), [], []
    cue = {
        "email_obscured": ("mail: ", "contact ", "", ""), "phone_local": ("tel: ", "call ", "phone ", ""), "ip6": ("host ", "server ", ""), "secret": ('token = "', "key: ", "api_key=", ""),
        "card_cut": ("card ", "visa: ", "paid with ", ""), "national_id": ("ssn ", "social security ", "tax id: ", ""), "iban": ("iban ", "account: ", "bank ", ""),
    }

    def take(text: str, a: int, b: int, want: int) -> None:
        for c in candidates(text):
            if c[1] < b and a < c[2]:
                x.append(features(text, c))
                y.append(float(want and c[1] <= a + 1 and c[2] >= b - 1))

    for text in texts:
        text = text[:SAMPLE_CHARS]
        found = base_spans(text)
        for kind, a, b in found or [("email", 0, 0)]:
            for turn, new in enumerate((_AS[kind], *rng.sample(ADDED, 2))):
                said = disguised(rng, new, text[a:b] if not turn else "")
                lead = rng.choice(cue[new])
                place = text[:a] + lead
                take(place + said + ('"' if lead.endswith('"') else "" if found else " ") + text[b:], len(place), len(place) + len(said), 1)
        words = text.split()
        if len(words) > 8:
            i = rng.randrange(len(words) - 4)
            for fake in lookalikes(rng, words, i):
                place = " ".join(words[:i]) + " " + rng.choice(("", "on ", "version ", "order ", "at "))
                take(place + fake + " " + " ".join(words[i + 3 : i + 9]), len(place), len(place) + len(fake), 0)
        for c in candidates(text):
            if c[0] != "secret" and not any(s[1] < c[2] and c[1] < s[2] for s in found):
                x.append(features(text, c))
                y.append(0.0)
    return np.array(x, dtype=np.float64).reshape(-1, len(features("0", (ADDED[0], 0, 1)))), np.array(y)


def built_in(seed: int = 5, count: int = 400) -> list[str]:
    """Fixed texts of plain words with personal data of every base kind, for tables that show too little."""
    rng = random.Random(seed)
    words = "the report was sent after a long meeting and nobody at our office had seen door numbers on that page before we looked into it again with care since most people keep their notes in one place under old names".split()
    out = []
    for _ in range(count):
        said = (f"{rng.choice(words)}{rng.choice(('', '', '.smith', rng.randrange(99)))}@{rng.choice(('mail', 'post', 'corp', ''))}{rng.choice(('', rng.randrange(9)))}x.{rng.choice(('example.com', 'example.org', 'net'))}", ".".join(str(rng.randrange(1, 255)) for _ in range(4)), "4111 1111 1111 1111", f"+1 ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}")
        body = rng.choices(words, k=rng.randrange(12, 60))
        body.insert(rng.randrange(len(body)), rng.choice((*said, said[0])))
        out.append(" ".join(body))
    return out


class Judge:
    """Trees and a threshold for each added kind."""

    def __init__(self, texts: list[str]):
        x, y = training_set(texts)
        if any(min(np.sum(y[x[:, 0] == i]), np.sum(1 - y[x[:, 0] == i])) < KIND_LEAST for i in range(len(ADDED))):
            more, said = training_set(built_in())
            x, y = np.concatenate([x, more]), np.concatenate([y, said])
        self.cut: dict[str, float] = {}
        self.model: dict[str, Boosted] = {}
        for i, name in enumerate(ADDED):
            mine, true = x[x[:, 0] == i], y[x[:, 0] == i]
            back = np.arange(len(true)) % 3 == 0
            if len(true) < 40 or true[~back].min() == true[~back].max():
                continue
            model = Boosted().fit(mine[~back], true[~back])
            q, t = model.score(mine[back]), true[back]
            order = np.argsort(-q, kind="stable")
            right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
            good = np.flatnonzero(right >= PRECISION)
            if len(good):
                self.model[name], self.cut[name] = model, max(0.5, float(q[order[good[-1]]]))

    def score(self, text: str, found: list[Span]) -> list[float]:
        """How likely each candidate is personal data; 0 for kinds that the sample taught nothing about."""
        out = [0.0] * len(found)
        for kind in {c[0] for c in found} & set(self.model):
            at = [i for i, c in enumerate(found) if c[0] == kind]
            for i, q in zip(at, self.model[kind].score(np.array([features(text, found[i]) for i in at]))):
                out[i] = float(q)
        return out

    def added(self, text: str, base: list[Span], digits: bool) -> list[Span]:
        found = candidates(text, digits) if self.model else []
        if found and base:
            # Base spans of one kind don't overlap, but those of several may: look at all that start before the end.
            edges = sorted((a, b) for _, a, b in base)
            starts = [a for a, _ in edges]
            reach = list(np.maximum.accumulate([b for _, b in edges]))
            found = [c for c in found if not (i := bisect_right(starts, c[2] - 1)) or reach[i - 1] <= c[1]]
        if not found:
            return []
        ranked = sorted((-q, c[1], c) for q, c in zip(self.score(text, found), found) if q >= self.cut.get(c[0], 1.1))
        out: list[Span] = []
        taken: list[tuple[int, int]] = []
        for _, _, c in ranked:
            i = bisect_right(taken, (c[1], math.inf))
            if (not i or taken[i - 1][1] <= c[1]) and (i == len(taken) or taken[i][0] >= c[2]):
                taken.insert(i, (c[1], c[2]))
                out.append(c)
        return out


def _line(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def sample_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> list[str]:
    """At most SAMPLE_ROWS texts for the trees, by hash of id and text; of longer texts SAMPLE_CHARS from a place that the hash gives."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("length(t) > 0").withColumn("h", F.xxhash64("id", "t"))
    room = F.greatest(F.length("t") - SAMPLE_CHARS, F.lit(0)) + 1
    # Hashes first: each partition's first rows would otherwise all go to the driver with their texts.
    last = rows.select("h").orderBy("h").limit(SAMPLE_ROWS).agg(F.max("h")).first()[0]
    rows = rows.where(F.col("h") <= F.lit(last)).select("h", F.substring(F.col("t"), (F.pmod(F.col("h"), room) + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("t")).orderBy("h", "t").limit(SAMPLE_ROWS).collect()
    return sorted(r["t"] for r in rows)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of the base kinds, base_sha256, spans, their number, and the redacted text if asked for.

    Spans are kind:start:end in code points, end exclusive, over whole texts. Counts and
    base_sha256 cover the base spans, ``spans`` also those that the trees add under kinds of
    their own (``ADDED``). Cases: a null text counts as an empty one (no spans, the digest of
    nothing); ids may be null or repeat; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    judge = spark.sparkContext.broadcast(pickle.dumps(Judge(sample_texts(docs, text_col, id_col))))
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"] + ["redacted"] * redact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: Judge = pickle.loads(judge.value)
        for batch in slices(batches, 500):
            cells: list[list] = [[] for _ in names[1:]]
            for view in text_views(batch, "text"):
                text = str(view, "utf-8")
                base = base_spans(text)
                spans = base + trees.added(text, base, bool(_DIGIT.search(text)))
                row = [sum(s[0] == k for s in base) for k in BASE] + [hashlib.sha256(_line(base).encode()).hexdigest(), _line(spans), len(spans)]
                for cell, value in zip(cells, row + ([redacted(text, spans)] if redact else [])):
                    cell.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cells[:4]), *(pa.array(c, pa.string()) for c in cells[4:6]), pa.array(cells[6], pa.int64()), *(pa.array(c, pa.string()) for c in cells[7:])], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long" + ", redacted string" * redact)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, overlaps merged, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]
