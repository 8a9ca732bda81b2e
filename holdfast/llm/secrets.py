"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

The tokens of a text are its runs of word characters, + / and -. The field tags each of
them as O (outside), B (a secret begins) or I (it goes on), from the token's shape, the
words and marks on both sides and what holds for the whole document; no token is shut
out. Viterbi's path over the whole text is found exactly but cheaply: scores of tokens
and marks are kept by string, so a text's scores are array sums, and a bound over runs of
tokens proves most of them O before Viterbi walks over what is left.

There are no labelled secrets, so the field is trained here on secrets made at random
(keys of many alphabets, with and without digits, UUIDs, passphrases, passwords, PINs)
that are put into passages of a bounded sample of documents, on what the patterns find in
them, on innocent uses of the same words, and on passages as they are.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import string
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain as joined
from operator import ne
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import table

#: Kind, pattern, group whose length counts, least length. In the order of kinds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")  # an assign holds one, in lower case
KINDS = ("assign", "access", "hex", "crf")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Spans of whole matches, leftmost and not overlapping in each kind, in order of start and kind."""
    found: list[Span] = []
    lower = text.lower()
    if any(k in lower for k in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


O, B, I = 0, 1, 2
NEVER = -1e4
TOKENS = re.compile(r"([\w+/-]+)")
REACH = 4  # how far before a token a key word counts as near
KEYS = frozenset(
    "password passwd passphrase passcode passwort pass pwd secret secrets token tokens key keys apikey accesskey credential credentials cred creds auth authorization bearer login pin "
    "signature kennwort schlüssel clave contraseña secreto clé secret motdepasse".split()
)
ANY_KEY = re.compile("|".join(sorted(KEYS)))
CASES = re.compile(r"(?<=[a-z])(?=[A-Z])")
LETTERS = re.compile(r"[^\W\d_]+")
CONSONANTS = re.compile(r"[^\W\d_aeiouyàâäáãåèéêëíìîïóòôöõúùûüœæø]+")
HEXED = frozenset("0123456789abcdefABCDEF-")
LENGTHS = (6, 8, 12, 16, 20, 28)
TIMES_LOG = [0.0, *[k * math.log2(k) for k in range(1, 4097)]]


def parts(text: str) -> tuple[list[str], list[str]]:
    """Tokens, and the marks before, between and after them (one more)."""
    pieces = TOKENS.split(text)
    return pieces[1::2], pieces[0::2]


def is_key(token: str) -> bool:
    """Whether a part of the token is a word that secrets stand beside."""
    return ANY_KEY.search(token.lower()) is not None and any(x.lower() in KEYS for x in LETTERS.findall(CASES.sub(" ", token)))


class Classes(dict):
    """For str.translate: A for an upper-case letter, a for other letters, 0 for a digit, - for + / - _ and others."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "A" if c.isupper() else "0" if c.isdigit() else "a" if c.isalpha() else "-"
        return self[code]


CLASSES = Classes()


class Facts(NamedTuple):
    """What the names of a token are made from: its kinds of characters, whether it is a key word, its word if it is short, and the rounded measures of its shape."""

    kinds: str
    key: bool
    word: str
    measures: tuple[int, ...]

    @property
    def shape(self) -> str:
        return f"{self.kinds}{self.measures[0]}"

    def own(self) -> list[str]:
        """Names of the shape."""
        return ["bias", "kinds=" + self.kinds, "shape=" + self.shape, f"key={self.key}", *[f"{name}={v}" for name, v in zip(MEASURES, self.measures[1:], strict=True)]]

    def own_word(self) -> list[str]:
        return ["word=" + self.word]

    def beside(self) -> list[list[str]]:
        """Names for the next token, the one behind that, and the token before."""
        return [[f"{at}kinds={self.kinds}", f"{at}key={self.key}"] for at in BESIDE]

    def beside_word(self) -> list[list[str]]:
        return [[f"{at}word={self.word}"] for at in BESIDE]


BESIDE = ("-1", "-2", "+")
MEASURES = ("entropy", "digits", "changes", "vowels", "run", "dashes", "hex")


def facts_of(token: str) -> Facts:
    n, classes, chars, lower = len(token), token.translate(CLASSES), set(token), token.lower()
    kinds = "".join(sorted(set(classes))) + ("" if token.isascii() else "u")
    counts = map(token.count, chars)
    entropy = math.log2(n) - sum(map(TIMES_LOG.__getitem__, counts)) / n if n <= 4096 else math.log2(len(chars))
    digits, marks = classes.count("0"), classes.count("-")
    letters = n - digits - marks
    consonants = list(map(len, CONSONANTS.findall(lower)))
    measures = (
        bisect_right(LENGTHS, n), round(2 * entropy), round(4 * digits / n), min(8, round(16 * sum(map(ne, classes[1:], classes[2:])) / n)), round(6 - 6 * sum(consonants) / letters) if letters else -1,
        min(7, max(consonants, default=0)), min(5, marks), int(n >= 8 and chars <= HEXED),
    )
    return Facts(kinds, is_key(token), lower if n <= 14 else "", measures)


def mark_class(mark: str) -> str:
    return "".join(k for k, cs in (("=", "="), (":", ":"), ("q", "\"'`"), ("n", "\n"), ("b", "<>()[]{}"), ("p", ".,;!?"), ("s", " ")) if any(c in mark for c in cs)) or "other"


def mark_names(mark: str, side: str) -> list[str]:
    brief = " ".join(mark.split(" "))[-4:] if side == "before" else mark[:4]
    return [f"{side}={brief}", f"{side} class={mark_class(mark)}"]


def file_names(text: str) -> list[str]:
    """Of the whole document."""
    n, lower = len(text) + 1, text.lower()
    code = sum(map(text.count, "={};"))
    return [f"file key={any(k in lower for k in HINTS)}", f"file length={min(6, int(math.log10(n)))}", f"file code={min(4, round(200 * code / n))}", f"file lines={min(4, round(100 * text.count(chr(10)) / n))}"]


def pair_names(shape: str, mark: str, near: bool) -> list[str]:
    """Of a token's shape, and of the marks before it, together with whether a key word is near."""
    return [f"near={near} shape={shape}", f"near={near} class={mark}"]


Known = dict[str, tuple[list[str], list[list[str]], str, bool]]


def names_of(tokens: list[str], marks: list[str], of_file: list[str], known: Known) -> list[list[str]]:
    """The names of all that holds for each token. `Scorer` sums the weights of the same names, by string. known: names by token, added to."""
    for token in set(tokens).difference(known):
        f = facts_of(token)
        known[token] = f.own() + f.own_word(), [x + y for x, y in zip(f.beside(), f.beside_word(), strict=True)], f.shape, f.key
    facts, sides = [known[t] for t in tokens], {m: (mark_names(m, "before"), mark_names(m, "after"), mark_class(m)) for m in set(marks)}
    out = []
    for t, (names, _, shape, _) in enumerate(facts):
        own = names + sides[marks[t]][0] + sides[marks[t + 1]][1] + of_file
        for at, other in enumerate((t - 1, t - 2, t + 1)):
            if 0 <= other < len(facts):
                own += facts[other][1][at]
        out.append(own + pair_names(shape, sides[marks[t]][2], any(x[3] for x in facts[max(0, t - REACH) : t])))
    return out


@dataclass
class Field:
    """Weights of names by tag, and of transitions. O stands before and after a text; I never follows O."""

    index: dict[str, int]
    unary: np.ndarray
    pair: np.ndarray

    def weights(self, groups: list[list[str]]) -> np.ndarray:
        """The sum of the weights of each group of names."""
        get = self.index.get
        own = [[k for x in names if (k := get(x)) is not None] for names in groups]
        flat, places = np.array([k for x in own for k in x], np.int64), np.repeat(np.arange(len(own)), list(map(len, own)))
        return np.stack([np.bincount(places, self.unary[flat, c], len(own)) for c in range(3)], axis=1)


def viterbi(x: np.ndarray, pair: np.ndarray) -> list[int]:
    """The best tags for scores x (tokens x tags) between two O."""
    best, back = pair[O] + x[0], []
    for row in x[1:]:
        step = best[:, None] + pair + row
        back.append(step.argmax(axis=0))
        best = step.max(axis=0)
    tags = [int((best + pair[:, O]).argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def open_tokens(x: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Which tokens the best path may tag as B or I; all others are O on it.

    A run of B and I on the best path gains nothing if all its tags become O. The gain of
    a run is at most the sum of its tokens' `most` and one `end`, so a token is open only
    if some run through it has a sum that reaches -end.
    """
    into_b, into_i = max(pair[O, B], pair[B, B], pair[I, B]) - pair[O, O], max(pair[B, I], pair[I, I]) - pair[O, O]
    end = max(pair[B, O], pair[I, O]) - pair[O, O]
    most = np.maximum(x[:, B] + into_b, x[:, I] + into_i) - x[:, O]
    sums = np.concatenate([[0.0], np.cumsum(most)])
    best_to = sums[1:] - np.minimum.accumulate(sums[:-1])  # of runs that end at a token
    best_from = np.maximum.accumulate(sums[:0:-1])[::-1] - sums[:-1]  # of runs that begin there
    return best_to + best_from - most + end >= -1e-6 * (1 + np.abs(sums).max())


class Scorer:
    """Scores of texts by a field. What a token or a mark adds is kept by its string, `memo` strings at most and a text's more for a moment."""

    def __init__(self, field: Field, memo: int = 300_000, block: int = 1 << 16):
        self.field, self.memo, self.block = field, memo, block
        self.words = {x.split("word=", 1)[1] for x in field.index if "word=" in x}
        self.by_measure: dict[tuple, np.ndarray] = {}  # rounded measures, so few whatever the corpus
        self.clear()

    def clear(self) -> None:
        self.tokens: dict[str, int] = {}
        self.marks: dict[str, int] = {}
        self.shapes: dict[str, int] = {}
        self.classes: dict[str, int] = {}
        self.of_token, self.shape, self.key = np.zeros((1 << 12, 12)), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, bool)
        self.of_mark, self.cls = np.zeros((1 << 8, 6)), np.zeros(1 << 8, np.int64)
        self.by_shape, self.by_class = np.zeros((0, 2, 3)), np.zeros((0, 2, 3))

    def _room(self, n: int, names: tuple[str, ...]) -> None:
        for name in names:
            have = getattr(self, name)
            if n > len(have):
                setattr(self, name, np.concatenate([have, np.zeros((max(n, 2 * len(have)) - len(have), *have.shape[1:]), have.dtype)]))

    def _add_tokens(self, new: set[str]) -> None:
        lo, hi = len(self.tokens), len(self.tokens) + len(new)
        self._room(hi, ("of_token", "shape", "key"))
        facts = [facts_of(t) for t in new]
        self.tokens.update(zip(new, range(lo, hi), strict=True))
        known = self.by_measure
        for f in facts:
            if (k := (f.kinds, f.key, f.measures)) not in known:
                known[k] = self.field.weights([f.own(), *f.beside()]).reshape(12)
        self.of_token[lo:hi] = [known[f.kinds, f.key, f.measures] for f in facts]
        heard = [k for k, f in enumerate(facts) if f.word in self.words]
        if heard:
            self.of_token[[lo + k for k in heard]] += self.field.weights([x for k in heard for x in (facts[k].own_word(), *facts[k].beside_word())]).reshape(-1, 12)
        for shape in {f.shape for f in facts}.difference(self.shapes):
            self.shapes[shape] = len(self.shapes)
            self.by_shape = np.concatenate([self.by_shape, self.field.weights([pair_names(shape, "", near)[:1] for near in (False, True)])[None]])
        self.shape[lo:hi], self.key[lo:hi] = [self.shapes[f.shape] for f in facts], [f.key for f in facts]

    def _add_marks(self, new: set[str]) -> None:
        lo, hi = len(self.marks), len(self.marks) + len(new)
        self._room(hi, ("of_mark", "cls"))
        self.marks.update(zip(new, range(lo, hi), strict=True))
        self.of_mark[lo:hi] = self.field.weights([mark_names(m, side) for m in new for side in ("before", "after")]).reshape(-1, 6)
        classes = [mark_class(m) for m in new]
        for cls in set(classes).difference(self.classes):
            self.classes[cls] = len(self.classes)
            self.by_class = np.concatenate([self.by_class, self.field.weights([pair_names("", cls, near)[1:] for near in (False, True)])[None]])
        self.cls[lo:hi] = [self.classes[c] for c in classes]

    def scores(self, tokens: list[str], marks: list[str], of_file: list[str]) -> np.ndarray:
        if len(self.tokens) > self.memo or len(self.marks) > self.memo:
            self.clear()
        if new := set(tokens).difference(self.tokens):
            self._add_tokens(new)
        if new := set(marks).difference(self.marks):
            self._add_marks(new)
        n = len(tokens)
        ids = np.fromiter(map(self.tokens.__getitem__, tokens), np.int64, n)
        at = np.fromiter(map(self.marks.__getitem__, marks), np.int64, n + 1)
        near = np.zeros(n, np.int64)
        key = self.key[ids]
        for k in range(1, REACH + 1):
            near[k:] |= key[:-k] if k < n else key[:0]
        out = np.tile(self.field.weights([of_file]), (n, 1))
        for lo in range(0, n, self.block):  # so that memory follows the scores alone
            hi = min(n, lo + self.block)
            x, own = out[lo:hi], ids[lo:hi]
            x += self.of_token[own, :3]
            x += self.of_mark[at[lo:hi], :3]
            x += self.of_mark[at[lo + 1 : hi + 1], 3:]
            x += self.by_shape[self.shape[own], near[lo:hi]]
            x += self.by_class[self.cls[at[lo:hi]], near[lo:hi]]
            for k, c in ((1, 3), (2, 6)):
                first = max(lo, k)
                if first < hi:
                    out[first:hi] += self.of_token[ids[first - k : hi - k], c : c + 3]
            last = min(hi, n - 1)
            out[lo:last] += self.of_token[ids[lo + 1 : last + 1], 9:]
        return out

    def secrets(self, text: str) -> list[tuple[int, int]]:
        """Spans of the best path's secrets; up to two = behind one are taken as its padding."""
        tokens, marks = parts(text)
        if not tokens:
            return []
        x = self.scores(tokens, marks, file_names(text))
        free = np.flatnonzero(open_tokens(x, self.field.pair))
        if not len(free):
            return []
        found: list[tuple[int, int]] = []
        for run in np.split(free, np.flatnonzero(np.diff(free) > 1) + 1):
            for t, tag in zip(run.tolist(), viterbi(x[run], self.field.pair), strict=True):
                if tag == B:
                    found.append((t, t))
                elif tag == I:
                    found[-1] = (found[-1][0], t)
        if not found:
            return []
        ends = np.cumsum([len(a) + len(b) for a, b in zip(marks, tokens, strict=False)])
        spans = []
        for a, b in found:
            end = int(ends[b])
            pad = marks[b + 1]
            width = len(pad) - len(pad.lstrip("="))
            whole = width <= 2 and (len(pad) > width or b + 1 == len(tokens))
            spans.append((int(ends[a]) - len(tokens[a]), end + (width if whole and end - int(ends[a]) + len(tokens[a]) >= 16 else 0)))
        return spans


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def likelihood(x: np.ndarray, tags: np.ndarray, live: np.ndarray, pair: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of chains side by side, and its gradients by score and transition. x: chains x tokens x tags; live: which tokens are there, at the front of each chain."""
    m, n, _ = x.shape
    rows = np.arange(m)
    ahead, behind = np.zeros((n, m, 3)), np.zeros((n, m, 3))
    last = live.sum(axis=1) - 1
    ahead[0] = pair[O] + x[:, 0]
    for t in range(1, n):
        ahead[t] = np.where(live[:, t, None], _log_sum(ahead[t - 1][:, :, None] + pair, 1) + x[:, t], ahead[t - 1])
    behind[:] = pair[:, O]
    for t in range(n - 2, -1, -1):
        behind[t] = np.where(live[:, t + 1, None], _log_sum(pair + (x[:, t + 1] + behind[t + 1])[:, None, :], 2), behind[t + 1])
    total = _log_sum(ahead[last, rows] + pair[:, O], 1)
    p = np.exp(ahead + behind - total[None, :, None]).transpose(1, 0, 2) * live[:, :, None]
    true = np.eye(3)[tags] * live[:, :, None]
    seen = np.zeros((3, 3))
    seen[O] += (true[:, 0] - p[:, 0]).sum(axis=0)
    seen[:, O] += (true[rows, last] - p[rows, last]).sum(axis=0)
    value = (x * true).sum() - total.sum() + pair[O, tags[:, 0]].sum() + pair[tags[rows, last], O].sum()
    for t in range(1, n):
        both = np.exp(ahead[t - 1][:, :, None] + pair + (x[:, t] + behind[t])[:, None, :] - total[:, None, None]) * live[:, t, None, None]
        step = true[:, t - 1, :, None] * true[:, t, None, :]
        seen += (step - both).sum(axis=0)
        value += (step * pair).sum()
    return float(value), true - p, seen


def train(chains: list[tuple[list[list[str]], list[int]]], epochs: int = 10, rate: float = 0.25, decay: float = 2e-3, seen: int = 3, at_once: int = 256) -> Field:
    """Adagrad on the log-likelihood, `at_once` chains a step. chains: names and tags. Names seen in fewer than `seen` tokens are left out."""
    counts = Counter(joined.from_iterable(joined.from_iterable(chain for chain, _ in chains)))
    index = {x: k for k, x in enumerate(sorted(x for x, n in counts.items() if n >= seen))}
    field = Field(index, np.zeros((len(index), 3)), np.zeros((3, 3)))
    field.pair[O, I] = NEVER
    speed_u, speed_p = np.full((len(index), 3), 1e-3), np.full((3, 3), 1e-3)
    get, coded = index.get, []
    for chain, _ in chains:
        own = [[k for x in names if (k := get(x)) is not None] for names in chain]
        coded.append((np.fromiter(joined.from_iterable(own), np.int64), np.repeat(np.arange(len(own)), list(map(len, own)))))
    rng = np.random.default_rng(42)
    for _ in range(epochs):
        order = rng.permutation(len(chains))
        for lo in range(0, len(order), at_once):
            own = order[lo : lo + at_once].tolist()
            widest = max(len(chains[k][1]) for k in own)
            live, tags = np.zeros((len(own), widest), bool), np.zeros((len(own), widest), np.int64)
            for i, k in enumerate(own):
                live[i, : len(chains[k][1])] = True
                tags[i, : len(chains[k][1])] = chains[k][1]
            flat, places = np.concatenate([coded[k][0] for k in own]), np.concatenate([coded[k][1] + i * widest for i, k in enumerate(own)])
            x = np.stack([np.bincount(places, field.unary[flat, c], len(own) * widest) for c in range(3)], axis=1).reshape(len(own), widest, 3)
            _, by_score, by_pair = likelihood(x, tags, live, field.pair)
            by_score = by_score.reshape(-1, 3)
            step = np.stack([np.bincount(flat, by_score[places, c], len(index)) for c in range(3)], axis=1) - decay * field.unary
            speed_u += step * step
            field.unary += rate * step / np.sqrt(speed_u)
            by_pair[O, I] = 0
            speed_p += by_pair * by_pair
            field.pair += rate * by_pair / np.sqrt(speed_p)
    return field


# Secrets made at random, and passages around them

LOWER, UPPER, DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
ALPHABETS = (DIGITS + "ABCDEF", DIGITS + "abcdef", UPPER + DIGITS, LOWER + DIGITS, LOWER + UPPER + DIGITS, LOWER + UPPER + DIGITS + "+/", LOWER + UPPER + DIGITS + "-_", LOWER + UPPER)
WEAK = ("letters", "phrase", "word", "pin")
FAMILIES = ("key", "prefixed", "uuid", *WEAK)
LABELS = (
    "password", "passwd", "passphrase", "passcode", "pwd", "pass", "secret", "client_secret", "token", "access_token", "api key", "api_key", "apikey", "access key", "private key", "signing_key", "credential",
    "credentials", "auth", "bearer", "login", "PIN", "pin", "Passwort", "Kennwort", "contraseña", "clave", "mot de passe", "clé secrète",
)
JOINTS = (" is ", ": ", "=", " = ", ' = "', ": '", '": "', " ", " (", " -> ", " is now ", " was ", " ist ", " es ", " est ", " := ", " `", ' "')
BARE = ("", "", "(", '"', "<", "id ", "see ", "= ", ": ", "Bearer ", "key-", "@")
INNOCENT = ("the {} is wrong and", "a {} for each user", "the {} of the house", "{}: see below", "change your {} often", "no {} was given", "{} (optional)", "my {} and I", "the {} = unknown", "every {} counts", "{} reset page", "lost {} form")


def made(rng: random.Random, family: str, words: list[str]) -> str:
    """A secret of a family. words: of the passage, for phrases."""
    if family == "key":
        alphabet, n = rng.choice(ALPHABETS), rng.randint(16, 48)
        key = "".join(rng.choices(alphabet, k=n))
        return rng.choice(LOWER + UPPER) + key.strip("+/-_") + rng.choice(LOWER + DIGITS)
    if family == "prefixed":
        return "".join(rng.choices(LOWER, k=rng.randint(2, 4))) + rng.choice(["_", "-", "_live_", "_test_"]) + "".join(rng.choices(LOWER + UPPER + DIGITS, k=rng.randint(14, 40)))
    if family == "uuid":
        return str(uuid.UUID(int=rng.getrandbits(128), version=4))
    if family == "letters":
        return "".join(rng.choices(LOWER + UPPER, k=rng.randint(7, 14)))
    if family == "phrase":
        return rng.choice("-_.").join(rng.choices(words or ["correct", "horse", "battery"], k=rng.randint(3, 5)))
    if family == "word":
        return "".join(rng.choices(LOWER, k=rng.randint(5, 9))) + rng.choice(["", str(rng.randint(1, 9999))])
    return "".join(rng.choices(DIGITS, k=rng.randint(4, 8)))


def planted(rng: random.Random, family: str, words: list[str]) -> tuple[str, int, int]:
    """A secret with what stands beside it, and its place in that. Families that are weak by themselves always have a key word."""
    value = made(rng, family, words)
    if family not in WEAK and rng.random() < 0.4:
        lead = rng.choice(BARE)
    else:
        label = rng.choice(LABELS)
        lead = rng.choice(["", "", "the ", "my ", "your "]) + rng.choice([label, label.title(), label.upper()]) + rng.choice(JOINTS)
    tail = {"(": ")", "<": ">", '"': '"', "'": "'", "`": "`"}.get(lead[-1:], rng.choice(["", "", ".", ",", ";"]))
    return lead + value + tail, len(lead), len(lead) + len(value)


def window(text: str, rng: random.Random, width: int = 260) -> str:
    """A passage: around a digit in every other case, if there is one, else anywhere."""
    at = rng.randrange(len(text)) if text else 0
    if rng.random() < 0.5 and (m := re.compile("[0-9]").search(text, at) or re.search("[0-9]", text)):
        at = m.start()
    lo = max(0, at - rng.randint(0, width))
    cut = text[lo : lo + width]
    if lo + width < len(text) and (end := cut.rfind(" ")) > 0:
        cut = cut[:end]
    return cut[cut.find(" ") + 1 :] if lo else cut


def passages(text: str, seed: int, each: int = 3) -> Iterator[tuple[str, list[tuple[int, int]], str]]:
    """Passages of a text with the spans of their secrets and a name of the kind: one as it is, one with an innocent key word, and `each` with a secret put in. What the patterns find is a secret too."""
    rng = random.Random(seed)
    for kind in ("plain", "innocent", *rng.choices(FAMILIES, k=each)):
        own = window(text, rng)
        spans = []
        for a, k, b in base_spans(own):
            m = ASSIGN.fullmatch(own, a, b) if k == 0 else None
            spans.append((m.start(2), m.end(2)) if m else (a, b))
        gaps = [0, *[m.start() for m in re.finditer(r"(?<=\S) (?=\S)", own)], len(own)]
        gaps = [g for g in gaps if not any(a <= g < b for a, b in spans)]
        if kind == "plain":
            yield own, spans, kind
            continue
        at = rng.choice(gaps)
        words = [w for w in LETTERS.findall(own) if 3 <= len(w) <= 9]
        put, a, b = (rng.choice(INNOCENT).format(rng.choice(LABELS)), 0, 0) if kind == "innocent" else planted(rng, kind, words)
        a, b, put = (a + 1, b + 1, " " + put) if at else (a, b, put)
        put += " " if at == 0 or not own[at : at + 1].isspace() else ""
        moved = [(x + len(put), y + len(put)) if x >= at else (x, y) for x, y in spans]
        yield own[:at] + put + own[at:], sorted(moved + ([(at + a, at + b)] if kind != "innocent" else [])), kind


def tags_of(tokens: list[str], marks: list[str], spans: list[tuple[int, int]]) -> list[int]:
    """B for a span's first token, I for its others, O elsewhere."""
    out, at, k, last = [], 0, 0, None
    for mark, token in zip(marks, tokens, strict=False):
        start = at + len(mark)
        at = start + len(token)
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        own = k if k < len(spans) and spans[k][0] < at else None
        out.append(O if own is None else I if own == last else B)
        last = own
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def chain_of(text: str, spans: list[tuple[int, int]], of_file: list[str], known: Known) -> tuple[list[list[str]], list[int]]:
    tokens, marks = parts(text)
    return names_of(tokens, marks, of_file, known), tags_of(tokens, marks, merged(spans))


def fit(documents: DataFrame, sample: int = 2_000, most: int = 3_000) -> Field | None:
    """Train on passages of the documents whose ids hash lowest, `sample` ids at most, and of their passages on the `most` that hash lowest. None without a passage."""
    ids = documents.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = documents.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                whole = text.as_py()
                of_file = json.dumps(file_names(whole))
                rows += [(p, json.dumps(spans), of_file) for p, spans, _ in passages(whole, doc_id)]
            yield pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(("passage", "spans", "of_file"))}, schema=pa.schema([(k, pa.string()) for k in ("passage", "spans", "of_file")]))

    rows = texts.mapInArrow(run, "passage string, spans string, of_file string").orderBy(F.xxhash64("passage", "spans"), "passage", "spans", "of_file").limit(most).collect()
    known: Known = {}
    chains = [c for r in rows if (c := chain_of(r.passage, [tuple(x) for x in json.loads(r.spans)], json.loads(r.of_file), known))[0]]
    return train(chains) if chains else None


def scan(text: str | None, scorer: Scorer | None) -> tuple[int, int, int, str, str]:
    """Numbers of base finds by kind, the digest of the base spans, and all spans. The field's are added unless a base span holds them. A null text counts as empty."""
    text = text or ""
    base = base_spans(text)
    added: list[Span] = []
    if scorer is not None and text:
        k, reach = 0, -1
        for a, b in scorer.secrets(text):
            while k < len(base) and base[k][0] <= a:
                reach = max(reach, base[k][2])
                k += 1
            if reach < b:
                added.append((a, len(KINDS) - 1, b))
    said = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    return *n, hashlib.sha256(said(base).encode()).hexdigest(), said(sorted(base + added))


def scan_secrets(documents: DataFrame, field: Field | None) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans. No shuffle.

    documents: doc_id, text; other columns are not looked at. Offsets count code points.
    A null text counts as empty; a null doc_id stays null; repeated rows each give a row;
    texts are scanned whole; an empty table gives no rows. Without a field only the
    patterns are used.
    """
    shared = documents.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value and Scorer(shared.value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            rows = [scan(t.as_py(), own) for t in batch.column("text")]
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return scan_secrets(documents, fit(documents))
