"""Secret scan: fixed patterns, and spans that a linear-chain conditional random field adds.

The field tags a text's tokens as O (outside), B (secret begins) or I (inside). A tag's score comes
from the token's shape, the shapes of two tokens before and one after and the words that they are, hashed to
``WORDS`` buckets, and features of the whole text; neighbouring tags have transition scores. It is trained in numpy, by gradient ascent on the
likelihood of token windows, from a bounded sample: ``SAMPLE_DOCS`` documents with a word that goes with
secrets and as many without, of at most ``SAMPLE_CHARS`` characters, those whose id has the least hash.

The fixed patterns say what is a secret in these texts; runs of digits alone, which the hex pattern
takes, teach nothing. A field so taught would know the patterns only. So each text is also given a
made-up secret of another kind, with or without a word that names it, and a made-up identifier,
number, path, address, date or image data that is none. What could be a word is a secret only after a word that
names one, so there the neighbours decide. A penalty on the other tags is raised until
``PRECISION`` of the tokens are right that the field tags in texts that training has not seen.

Decoding is Viterbi's, over whole texts. A token whose O score is ahead of the others by more than two
changes of transitions could make up is O on the best path, whatever stands around it; so such tokens
part the text into short stretches which are decoded one by one, with the same result.

Defined results: null text is empty and has no spans; any length of text is scanned whole; repeated
rows are scanned alike; an empty table gives an empty result; without anything to learn from the
field adds no spans; other columns are passed on as they are, but one named like the output, which is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: The base kinds in order, their patterns, the group that has the secret, its least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
#: What a text must contain (in lower case, for assign) to be worth the pattern.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LONG_HEX = re.compile(r"[0-9a-f]{16}")
ADDED = "crf"
SAMPLE_DOCS = 500
SAMPLE_CHARS = 8000
WINDOW = 6
ROUNDS = 120
PRECISION = 0.98
RATE = 0.1
PENALTY, WORD_PENALTY = 1e-4, 1e-3
#: Buckets of words; the first is for tokens that are none.
WORDS = 1 << 14
#: A span that the field adds has at least so many characters, as the shortest base kind has.
LEAST_CHARS = 12
TOKEN = re.compile(r"[\w+/.\-]+|[^\w\s]")
REMEMBERED = 200_000
#: Words that name secrets.
NAMES = frozenset("password passwd pass pwd passphrase secret token apikey api key bearer authorization auth credential credentials".split())
O, B, I = 0, 1, 2  # noqa: E741


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, ends exclusive, in order."""
    out = []
    low = text.encode().lower()
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        if kind == "assign" and not any(w.encode() in low for w in ASSIGN_WORDS):
            continue
        if kind == "access" and "AKIA" not in text or kind == "hex" and not LONG_HEX.search(text):
            continue
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                out.append((m.start(), rank, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


#: What may stand at a token's ends without being part of it.
ENDS = "./-+"
RUNS = re.compile(r"[A-Z]+|\d+|[+/_.\-]+|[^A-Z\d+/_.\-]+")


#: The shapes of words of under 12 letters, by whether they name a secret and by length.
SHORT_WORDS = tuple(tuple((f"length {k}", *named, "letters") for k in range(3)) for named in ((), ("names a secret",)))


def shape(token: str) -> tuple[str, ...]:
    """Features of a token, the same for all tokens of a kind."""
    if len(token) == 1 and not token.isalnum():
        return ("mark", f"mark {token}" if token in "=:\"'" else "mark other")
    token = token.strip(ENDS) or token  # a full stop ends a sentence, not a name
    low = token.lower()
    if len(token) < 12 and low.isascii() and low.isalpha():  # most tokens; the rest of this function says the same of them
        return SHORT_WORDS[low in NAMES][len(token) // 4]
    digits = sum(c.isdigit() for c in token)
    n = len(token)
    out = [f"length {min(n, 40) // 4}"]
    if not NAMES.isdisjoint(re.split("[^a-z]+", low)):
        out.append("names a secret")
    if n < 12:
        return (*out, "digits" if digits == n else "letters" if token.isalpha() else "other")
    letters = sum(c.isalpha() for c in token)
    if not letters:
        return (*out, "numeric")
    runs = RUNS.findall(token)
    mean = n / len(runs)  # characters until their kind changes: 1.5 to 2 in random text, 4 and more in names
    mixed = f"changes {min(8, int(2 * mean))}"
    if token.isalpha():
        return (*out, "letters", mixed, "upper" if token.isupper() else "lower" if token[1:].islower() else "both cases")
    out += [mixed, f"digits {5 * digits // n}", f"longest run {min(12, max(map(len, runs)))}"]
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", token):
        out.append("hex")
    if not token.isascii():
        out.append("other alphabet")
    out.append(f"joints {min(6, len(re.findall('[+/_.-]', token)))}")
    core = max(re.split("[_.]", token), key=len)
    inner = RUNS.findall(core)
    if len(core) >= 12 and any(map(str.isdigit, inner)) and len(core) / len(inner) < 3.5:
        out.append(f"random part {min(40, len(core)) // 8}")
    out.append("both cases" if re.search("[A-Z]", token) and re.search("[a-z]", token) else "capitals" if re.search("[A-Z]", token) else "small")
    if re.search(r"(.)\1\1", token):
        out.append("repeats")
    return tuple(out)


def word(token: str) -> int:
    """The bucket of a token that may be a word, in any case; 0 for any other."""
    token = token.strip(ENDS)
    return 1 + zlib.crc32(token.lower().encode()) % (WORDS - 1) if len(token) <= 20 and token[:1].isalpha() else 0


def file_features(text: str) -> tuple[str, ...]:
    lines = text.count("\n") + 1
    return (f"assigned {min(3, text.count('=') * 10 // lines)}", "braces" if "{" in text else "no braces", f"size {min(6, len(text).bit_length() // 2)}")


#: Where a feature may be, and how far from the token.
PLACES = {"own": 0, "before": -1, "before 2": -2, "after": 1}
#: The places whose words count.
NEAR = ("before", "before 2", "after")


@dataclass
class Field:
    """Weights by (place, feature); places: own, before, before 2, after, file; and of words by place and bucket.
    ``caution`` is added to the score of O."""

    weights: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    words: dict[str, np.ndarray] = field(default_factory=dict)
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))
    caution: float = 0.0

    @cached_property
    def tagger(self) -> Tagger:
        """A worker has one field for all its tasks, and so what its tagger remembers serves the next ones."""
        return Tagger(self)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tagger"}

    def score(self, place: str, features: tuple[str, ...], word: int = 0) -> np.ndarray:
        plain = sum((self.weights[place, f] for f in features if (place, f) in self.weights), np.zeros(3))
        return plain + self.words[place][word] if word and place in self.words else plain


class Tagger:
    """Tags texts with a field; remembers the kinds of tokens, a kind being a shape and a word's bucket."""

    def __init__(self, model: Field):
        self.model, self.kinds, self.known = model, {}, {}
        self.table = np.zeros((len(PLACES), 1024, 3))
        self.shapes: dict[tuple, np.ndarray] = {}
        none = np.zeros((WORDS, 3))
        self.words = np.stack([model.words.get(p, none) for p in PLACES], axis=1)
        self.margin = 2 * float(model.transitions.max() - model.transitions.min())
        self.edge = self._kind(("edge",), 0)

    def _kind(self, features: tuple[str, ...], bucket: int) -> int:
        k = self.kinds.get((features, bucket))
        if k is None:
            k = self.kinds[features, bucket] = len(self.kinds)
            plain = self.shapes.get(features)
            if plain is None:
                plain = self.shapes[features] = np.stack([self.model.score(p, features) for p in PLACES])
            if k == self.table.shape[1]:
                self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
            self.table[:, k] = plain + self.words[bucket]
        return k

    def _add(self, token: str) -> int:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        k = self.known[token] = self._kind(shape(token), word(token))
        return k

    def tags(self, text: str) -> tuple[list[str], np.ndarray]:
        tokens = TOKEN.findall(text)
        if not tokens or not self.model.weights:
            return tokens, np.zeros(len(tokens), np.int8)
        add = self._add
        ids = list(map(self.known.get, tokens))
        if None in ids:
            ids = [add(t) if k is None else k for t, k in zip(tokens, ids, strict=True)]
        kinds = np.array([self.edge, self.edge, *ids, self.edge], np.int32)
        scores = sum(a[kinds[2 + PLACES[p] : len(kinds) - 1 + PLACES[p]]] for p, a in zip(PLACES, self.table, strict=True)) + self.model.score("file", file_features(text))
        scores[:, O] += self.model.caution
        out = np.zeros(len(tokens), np.int8)
        open_ = np.flatnonzero(scores[:, O] - np.maximum(scores[:, B], scores[:, I]) <= self.margin)
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(open_) else ():
            out[run] = self._viterbi(scores[run], run[0] > 0, run[-1] + 1 < len(tokens))
        return tokens, out

    def _viterbi(self, scores: np.ndarray, after_o: bool, before_o: bool) -> np.ndarray:
        """Best tags of a stretch between tokens that are O, or the text's ends."""
        t = self.model.transitions
        best = scores[0] + (t[O] if after_o else 0.0)
        back = np.zeros((len(scores), 3), np.int8)
        for k in range(1, len(scores)):
            all_ = best[:, None] + t
            back[k] = all_.argmax(axis=0)
            best = all_.max(axis=0) + scores[k]
        if before_o:
            best = best + t[:, O]
        out = np.zeros(len(scores), np.int8)
        out[-1] = best.argmax()
        for k in range(len(scores) - 1, 0, -1):
            out[k - 1] = back[k, out[k]]
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Character spans of the secrets that the field tags."""
        _, tags = self.tags(text)
        if not tags.any():
            return []
        out: list[list[int]] = []
        for m, tag in zip(TOKEN.finditer(text), tags.tolist(), strict=True):
            if tag == I and out and open_:
                out[-1][1] = m.end()
            elif tag != O:
                out.append([m.start(), m.end()])
            open_ = tag != O
        trimmed = [(b - len(text[a:b].lstrip(ENDS)), a + len(text[a:b].rstrip(ENDS))) for a, b in out]
        return [(a, b) for a, b in trimmed if b - a >= LEAST_CHARS]


def _made(rng: random.Random, kinds: tuple[tuple[str, int, int], ...]) -> str:
    """Random characters: one of several (alphabet, least, most length)."""
    alphabet, least, most = rng.choice(kinds)
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(least, most)))


SMALL, LARGE, DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
KEYS = ((SMALL + LARGE + DIGITS, 16, 64), (SMALL + LARGE + DIGITS + "+/", 20, 64), (DIGITS + "ABCDEF", 16, 64), (DIGITS + "abcdef", 16, 64), (SMALL + DIGITS, 20, 40), (LARGE + DIGITS, 16, 40), (SMALL + LARGE + DIGITS + "-_", 20, 64))


def made_secret(rng: random.Random) -> str:
    key = _made(rng, KEYS)
    short = lambda: _made(rng, ((SMALL, 2, 5),))
    at = rng.randint(4, 10)
    return rng.choice([key, key, f"{key[:at]}{rng.choice('&!$%^*')}{key[at:]}", f"{short()}_{key}", f"{short()}_{short()}_{key}", f"{short()}-{key}", f"{key}.{_made(rng, KEYS)}", f"{key}.{_made(rng, KEYS)}.{_made(rng, KEYS)}"])


def weak_secret(rng: random.Random) -> str:
    """What is a secret only where a word says so: syllables, some with a number or mark."""
    syllables = "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") + rng.choice(["", "", "n", "r", "s"]) for _ in range(rng.randint(5, 8)))
    syllables = rng.choice([syllables, syllables.capitalize(), syllables[:6] + syllables[6:].capitalize()])
    return rng.choice([syllables, f"{syllables}{rng.randint(0, 999)}", f"{rng.randint(10, 99)}{syllables}", f"{syllables[:7]}{rng.choice('_-.')}{syllables[7:]}{rng.randint(0, 99)}"])


def image_data(rng: random.Random) -> str:
    """How the text of an image or an archive begins."""
    head = rng.choice([b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0", b"GIF89a", b"\xff\xd8\xff\xe0\0\x10JFIF\0\x01", b"PK\x03\x04\x14\0\0\0\x08\0", b"%PDF-1.7\n%"])
    body = b"".join(rng.choice([b"\0\0\0\0", bytes([rng.randrange(256)]), b"\xff\xff\xff", rng.randbytes(3)]) for _ in range(rng.randint(10, 60)))
    return base64.b64encode(head + body).decode().rstrip("=")


def made_other(rng: random.Random, words: list[str]) -> str:
    """What is long or has digits and is no secret."""
    w = lambda: rng.choice(words)
    n = lambda a, b: str(rng.randint(a, b))
    several = lambda mark, k: mark.join(w() for _ in range(k))
    return rng.choice([
        _made(rng, ((DIGITS, 8, 20),)), ".".join(n(0, 255) for _ in range(4)), f"{w()}.{n(1, 99)}@mail{n(1, 9)}.{w()}.com", f"{n(1990, 2030)}-{n(10, 12)}-{n(10, 28)}T{n(10, 23)}",
        several("_", rng.randint(2, 5)), several("-", rng.randint(2, 5)), several("/", rng.randint(2, 6)), f"{several('_', 3)}_{n(0, 2030)}.{w()[:3]}", f"{several('.', 3)}/{w()}{n(0, 99)}",
        "".join(w().capitalize() for _ in range(rng.randint(2, 5))), f"{several('_', 3)}_{n(0, 99)}".upper(), w() + w() + w(), f"{w()}-{n(0, 9)}.{n(0, 99)}.{n(0, 99)}", f"/{several('/', 3)}{n(0, 9)}.{n(0, 99)}/{several('-', 2)}",
        weak_secret(rng), image_data(rng), image_data(rng), f"data:image/{w()[:4]};base64,{image_data(rng)}",
    ])


def _named(rng: random.Random, value: str, words: list[str], weak: bool = False) -> str:
    """The value as texts have it: alone, marked, or after a word that names it; a weak one after such a word. Others
    are not named as secrets are, but may stand after any other word."""
    name = rng.choice(sorted(NAMES))
    name = rng.choice([name, name.upper(), f"{rng.choice(words)}_{name}", name.capitalize()])
    if weak:
        return rng.choice([f"{name} is {value}", f"{name}: {value}", f"{name} = {value}", f"{name} {value}", f"{name}={value}", f'{name} is "{value}"'])
    return rng.choice([value, value, value, f"({value})", f'"{value}"', f"{name} is {value}", f"{name}: {value}", f'{name} = "{value}"', f"{name}={value}", f"{name} {value}", f"{rng.choice(words)} {value}", f"{rng.choice(words)}={value}"])


def _unnamed(rng: random.Random, value: str, words: list[str]) -> str:
    w = rng.choice(words)
    return rng.choice([value, value, f"({value})", f'"{value}"', f"{w} is {value}", f"{w}: {value}", f"{w} = {value}", f"{w} {value}", f"{w}={value}", f"see {value}", f"the {value}"])


Span = tuple[int, int]


def _cut(text: str, secrets: list[Span], near: list[Span]) -> tuple[list, list]:
    """Windows of the text's tokens around the starts of spans: their shapes and words (with those of the tokens
    that lie around), and tags: B and I within secrets, else O."""
    at = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)]
    tags, last = [], None
    for a, b, _ in at:
        span = next((s for s in secrets if s[0] < b and a < s[1]), None)
        tags.append(O if span is None else I if span == last else B)
        last = span
    inside = lambda i: 0 <= i < len(at)
    shapes, ys = [], []
    for start, _ in near:
        c = next((i for i, t in enumerate(at) if t[1] > start), 0)
        shapes.append([(shape(at[j][2]), word(at[j][2])) if inside(j) else (("edge",), 0) for j in range(c - WINDOW - 2, c + WINDOW + 2)])
        ys.append([tags[i] if inside(i) else O for i in range(c - WINDOW, c + WINDOW + 1)])
    return shapes, ys


def _examples(texts: list[str], seed: int = 11) -> tuple[list, list, list, list]:
    """Windows of all texts: shapes, file features, tags, the number of the text."""
    rng, shapes, files, ys, numbers = random.Random(seed), [], [], [], []

    def add(number: int, about: tuple, cut: tuple[list, list]) -> None:
        shapes.extend(cut[0])
        ys.extend(cut[1])
        files.extend([about] * len(cut[0]))
        numbers.extend([number] * len(cut[0]))

    for number, text in enumerate(texts):
        about, words = file_features(text), re.findall("[a-z]{3,}", text.lower())[:200] or ["name"]
        base = [(b - len(re.search(r"[A-Za-z0-9+/_.=-]+$", text[a:b])[0]) if kind == "assign" else a, b) for a, b, kind in base_spans(text)]
        secrets = [s for s in base if not text[s[0] : s[1]].isdigit()]
        odd = [m.span() for m in re.finditer(r"[\w+/.\-]{12,}", text) if not any(a < m.end() and m.start() < b for a, b in base)]
        odd = sorted(rng.sample(odd, min(4, len(odd))))
        anywhere = [(x, x) for x in (rng.randint(0, len(text)) for _ in range(2))]
        add(number, about, _cut(text, secrets, [*secrets[:2], *odd, *anywhere]))
        at = text.find(" ", rng.randint(0, len(text))) + 1
        before, after = text[max(0, at - 150) : at], text[at : at + 150]
        kinds = [(made_secret(rng), True, False), (made_secret(rng), True, False), (weak_secret(rng), True, True)] + [(made_other(rng, words), False, False) for _ in range(4)]
        for made, is_secret, weak in kinds:
            said = _named(rng, made, words, weak) if is_secret else _unnamed(rng, made, words)
            a = len(before) + said.rindex(made)
            span = (a, a + len(made))
            add(number, about, _cut(f"{before}{said} {after}", [span] if is_secret else [], [span]))
    return shapes, files, ys, numbers


def _expected(e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows' scores (n, length, 3): each tag's probability, and each transition's expected number."""
    n, length, _ = e.shape
    a, b = np.zeros((length, n, 3)), np.zeros((length, n, 3))
    a[0] = e[:, 0]
    for k in range(1, length):
        a[k] = np.logaddexp.reduce(a[k - 1][:, :, None] + t, axis=1) + e[:, k]
    for k in range(length - 2, -1, -1):
        b[k] = np.logaddexp.reduce(t + (e[:, k + 1] + b[k + 1])[:, None, :], axis=2)
    z = np.logaddexp.reduce(a[-1], axis=1)
    pair = sum(np.exp(a[k][:, :, None] + t + (e[:, k + 1] + b[k + 1])[:, None, :] - z[:, None, None]).sum(axis=0) for k in range(length - 1))
    return np.exp(a + b - z[:, None]).transpose(1, 0, 2), pair


def train(texts: list[str]) -> Field:
    """A field fitted to the windows by Adam on the penalised log likelihood; a fifth of the texts is
    kept for its caution."""
    shapes, files, tags, numbers = _examples([t for t in texts if t])
    if not tags:
        return Field()
    kinds: dict[tuple, int] = {}
    ids = np.array([[kinds.setdefault(k, len(kinds)) for k, _ in r] for r in shapes])
    said = np.array([[x for _, x in r] for r in shapes])
    names = {f: i for i, f in enumerate(dict.fromkeys(f for k in kinds for f in k))}
    has = np.zeros((len(kinds), len(names)))
    for k, i in kinds.items():
        has[i, [names[f] for f in k]] = 1
    file_names = {f: i for i, f in enumerate(sorted({f for x in files for f in x}))}
    file_has = np.zeros((len(files), len(file_names)))
    for i, x in enumerate(files):
        file_has[i, [file_names[f] for f in x]] = 1
    y, held = np.array(tags), np.array(numbers) % 5 == 4
    at = {p: ids[:, 2 + k : ids.shape[1] - 1 + k] for p, k in PLACES.items()}
    words = {p: said[:, 2 + PLACES[p] : said.shape[1] - 1 + PLACES[p]] for p in NEAR}
    w = {p: np.zeros((len(names), 3)) for p in PLACES} | {f"word {p}": np.zeros((WORDS, 3)) for p in NEAR} | {"file": np.zeros((len(file_names), 3)), "t": np.zeros((3, 3))}
    scores = lambda rows: sum((has @ w[p])[at[p][rows]] for p in PLACES) + sum(w[f"word {p}"][words[p][rows]] for p in NEAR) + (file_has[rows] @ w["file"])[:, None, :]
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    some = np.flatnonzero(~held) if not held.all() else np.arange(len(y))
    one = np.eye(3)[y[some]]
    seen = np.einsum("nti,ntj->ij", one[:, :-1], one[:, 1:])
    for r in range(1, ROUNDS + 1):
        p, pair = _expected(scores(some), w["t"])
        g = one - p
        grad = {"t": seen - pair, "file": file_has[some].T @ g.sum(axis=1)}
        for place, where in at.items():
            sums = np.stack([np.bincount(where[some].ravel(), g[:, :, j].ravel(), len(kinds)) for j in range(3)], axis=1)
            grad[place] = has.T @ sums
        for place, where in words.items():
            grad[f"word {place}"] = np.stack([np.bincount(where[some].ravel(), g[:, :, j].ravel(), WORDS) for j in range(3)], axis=1)
            grad[f"word {place}"][0] = 0  # no word
        for k in w:
            d = grad[k] / len(some) - (WORD_PENALTY if k.startswith("word") else PENALTY) * w[k]
            m1[k] = 0.9 * m1[k] + 0.1 * d
            m2[k] = 0.999 * m2[k] + 0.001 * d * d
            w[k] += RATE * (m1[k] / (1 - 0.9**r)) / (np.sqrt(m2[k] / (1 - 0.999**r)) + 1e-8)
    weights = {(place, f): w[place][i] for place in PLACES for f, i in names.items()}
    model = Field(weights | {("file", f): w["file"][i] for f, i in file_names.items()}, {p: w[f"word {p}"] for p in NEAR}, w["t"])
    check = np.flatnonzero(held) if held.any() else some
    model.caution = _caution(model, scores(check), y[check])
    return model


def _caution(model: Field, scores: np.ndarray, y: np.ndarray) -> float:
    """The least penalty with which enough of the tokens on the best paths that are not O are right."""
    tagger = Tagger(model)
    for caution in np.arange(0, 8, 0.5):
        found = np.array([tagger._viterbi(e + [caution, 0, 0], False, False) for e in scores]) != O
        if (found & (y != O)).sum() >= PRECISION * found.sum():
            break
    return float(caution)


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Field:
    """A field from the bounded sample of (doc_id, text): one pass counts both kinds of documents, one
    takes those of each kind whose id has a hash so low that a few times the sample is left."""
    low = F.lower("text")
    likely = F.lit(False)
    for x in (*ASSIGN_WORDS, "akia"):
        likely = likely | low.contains(x)
    short = docs.filter(F.length("text") <= sample_chars).select("doc_id", "text", likely.alias("likely"))
    n = short.agg(F.count_if("likely").alias("yes"), F.count_if(~F.col("likely")).alias("no")).first()
    h = F.xxhash64("doc_id")
    share = lambda k: min(1.0, (2 * sample_docs + 100) / max(1, k))
    most = lambda k: F.lit(min((1 << 63) - 1, int(-(1 << 63) + share(k) * (1 << 64))))  # noqa: E731  hashes are spread evenly
    near = short.filter(F.when(F.col("likely"), h <= most(n.yes)).otherwise(h <= most(n.no)))
    rank = F.row_number().over(Window.partitionBy("likely").orderBy(h, "doc_id", F.xxhash64("text")))
    rows = near.withColumn("n", rank).filter(F.col("n") <= sample_docs).collect()
    return train([r.text for r in sorted(rows, key=lambda r: (not r.likely, r.n))])


SCANNED = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"


def scan(text: str | None, tagger: Tagger) -> tuple:
    text = text or ""
    base = base_spans(text)
    added = [(a, b, ADDED) for a, b in tagger.spans(text) if not any(s < b and a < e for s, e, _ in base)]
    rank = {kind: i for i, (kind, *_) in enumerate(BASE)} | {ADDED: len(BASE)}
    write = lambda x: ",".join(f"{kind}:{a}:{b}" for a, b, kind in x)
    every = sorted(base + added, key=lambda s: (s[0], rank[s[2]]))
    counts = [sum(k == kind for _, _, k in base) for kind, *_ in BASE]
    return (*counts, hashlib.sha256(write(base).encode()).hexdigest(), write(every), len(added))


def with_secrets(docs: DataFrame, model: Field, text: str = "text", out: str = "secrets") -> DataFrame:
    """The rows with a struct of counts, digest and spans (kind:start:end in code points)."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = given.value.tagger
        for texts in batches:
            yield pd.DataFrame([scan(t, tagger) for t in texts], columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    return docs.withColumn(out, F.pandas_udf(scanned, SCANNED)(F.col(text)))


def secret_report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id and the secrets of every row."""
    rows = docs.select(F.col(key).alias("doc_id"), "text")
    return with_secrets(rows, learn(rows)).select("doc_id", "secrets.*")
