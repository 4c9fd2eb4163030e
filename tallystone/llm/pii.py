"""Operator 4: personal data by fixed patterns and a linear-chain conditional random field.

The patterns find emails, IP addresses, card numbers and phone numbers. The field finds what has no fixed form: names,
identity numbers and secrets. Its tokens are all runs without white space, less the punctuation around them; its
features are word shapes, lengths, function words, and the trigger words of the labelled table in the token and beside
it. It is trained by gradient steps on the exact likelihood over a small labelled table. Every token of a text has all
labels open to it, in training too; a sentence's end ends a chain. A batch's tokens are scored at once in numpy. A token
is not decoded if no run of tokens around it can gain enough to pay for its transitions, for then `O` is its label in
every best path; the others make short chains, decoded by Viterbi in numpy batches of chains of about equal length.

The patterns are searched in linear time: a match of an address can only begin where a run of its characters does, or
where the match before ended, so no place of a long run is tried twice.

Null and empty texts have no spans. Texts are searched whole, whatever their length; repeated rows get equal results;
an empty table gives no rows. Spans count code points, ends exclusive. A span of the field that touches one of a
pattern is dropped, the pattern's stays. Spans of a kind never overlap.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.stopwords import english
from .common import col, small_batches

KINDS = ["email", "ip", "card", "phone", "id", "name", "secret"]
LABELS = ["O", "B-id", "I-id", "B-name", "I-name", "B-secret", "I-secret"]
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, by kind and start."""
    out = []
    end = 0
    for m in _DOMAIN.finditer(text):
        i = m.start()
        while i > end and text[i - 1] in _LEFT:
            i -= 1
        if i < m.start():
            end = m.end()
            out.append((0, i, end))
    for m in _IP.finditer(text):
        if all(int(p) <= 255 if len(p) < 9 else not p.lstrip("0") or int(p.lstrip("0")[:9]) <= 255 and len(p.lstrip("0")) < 4 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and _luhn(d):
                out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append((3, *m.span()))
    return out


_TRIM = ".,;:!?'\"()[]{}<>#*%&$|~"


@lru_cache(maxsize=1 << 16)
def shape(token: str) -> str:
    """X, x and d for runs of capitals, other letters and digits; other characters as they are, once."""
    out = []
    for c in token:
        s = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out[:8])


_TOKEN = re.compile(r"\S+")


#: Words that end a lower-case name.
STOPS = frozenset("and on i from to the for who at in of is was or".split())
#: Function words, which are no names.
COMMON = STOPS.union(english())


def features(token: str, before: str, after: str, triggers: frozenset[str] | dict, again: bool = False, apart: bool = False, falls: bool = False) -> list[str]:
    """token without outer punctuation; before and after are the neighbours' triggers; again: a neighbour is the same token; apart: the one before ends in punctuation; falls: it begins with a capital and is no trigger."""
    low = token.lower()
    head = re.split(r"[=:]", low, maxsplit=1)[0]
    n = len(token)
    out = ["1", "s:" + shape(token), "n:" + str(min(n, 8) if n < 8 else 8 if n < 12 else 12 if n < 16 else 16 if n < 24 else 24)]
    out.append(f"s:{shape(token)[:2]} n:{n // 6}")
    if sum(map(str.isdigit, token)) * 4 >= n >= 12:
        out.append("dense")
    out += [f"w:{low}"] * (low in triggers) + [f"h:{head}"] * (head != low and head in triggers)
    out += ["h4:" + low[:4]] * (low[:4] in triggers)
    out += [f"b:{before}"] * (before in triggers) + [f"a:{after}"] * (after in triggers)
    out += ["again"] * again + ["apart"] * apart
    out += ["common"] * (low in COMMON)
    if _plain(token):
        out += ["falls"] * falls
        out += [f"w:{low}"] * (low in STOPS) + [f"b:{before} n:{min(n // 5, 3)}"] * (before in triggers)
    return out


def _plain(token: str) -> bool:
    return token == token.lower() and token.isalpha()


def labelled_table(seed: int = 11, per_template: int = 16) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: rows of (tokens, labels), written by rule from sentence patterns."""
    rng = random.Random(seed)
    pick = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    up, low, dig, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    cap = lambda: pick(up, 1) + pick(low, rng.randint(2, 8))
    word = lambda: pick(low, rng.randint(1, 9))
    common = sorted(COMMON)
    plain_name = lambda: pick(low, rng.randint(3, 9))
    fill = {
        "name": lambda: [cap() for _ in range(rng.choice([1, 2, 2, 3]))],
        "secret": lambda: [rng.choice([lambda: "AKIA" + pick(up + dig, 16), lambda: "password=" + pick(hexa, rng.randint(8, 24)), lambda: "sk-" + pick(up + low + dig, 32), lambda: pick(hexa, rng.choice([32, 40])), lambda: "token=" + pick(up + low + dig, 24), lambda: "ghp_" + pick(up + low + dig, 36)])()],
        "lower": lambda: [plain_name() for _ in range(rng.choice([1, 2, 2, 2, 3]))],
        "phrase": lambda: [pick(low, rng.randint(10, 22))],
        "id": lambda: rng.choice([lambda: [f"{pick(dig, 3)}-{pick(dig, 2)}-{pick(dig, 4)}"], lambda: [pick(up, 2) + pick(dig, 2), *[pick(dig, 4) for _ in range(4)], pick(dig, 2)], lambda: [pick(up, 1) + pick(dig, 8)]])(),
    }
    patterns = [
        "my name is {name} and", "Mr. {name} came", "Mrs. {name} w", "Dr. {name} w", "Dr. {name} said", "w Dr. {name} w", "w Mr. {name} w", "Dear {name} ,", "regards {name} W", "signed by {name} on", "Contact {name} w w",
        "w w {secret} w", "W w w {secret} W w", "api_key = {secret} w", "secret {secret} w w", "w {secret} w.", "{secret} W w w",
        "SSN {id} w", "ssn is {id} w", "IBAN {id} w", "passport {id} w w", "iban {id} W w",
        "my name is {lower} and w", "w name is {lower} . W", "name is {lower} from w w", "Mr. {lower} and w", "mr {lower} was w", "Dear {lower} , w", "dear {lower} , w w", "signed by {lower} on w", "signed by {lower} , w",
        "contact {lower} at w", "w contact {lower} at f w", "w w contact {lower} at w w", "W contact {lower} at f L",
        "password {phrase} w", "password: {phrase} w", "w password is {phrase} w w", "secret {phrase} w", "passphrase {phrase} . W",
        # nothing personal in these
        "the password w w w", "password is w w", "w secret w w", "a secret of w w", "dear to the w", "password and w w", "secret is the w", "passphrase w w",
        "W w w. W w w", "W w. W. W w, w", "w w is W w W w", "w is. W w", "w by W. W", "w W W W W W W w", "w. W W w", "W W w w", "w w by. W w", "w w w. W W w w", "U U!! U, U", "W w 2.0. W", "w w N w w", "W w w (N) w", "the W w W w", "w E w w", "w P w w", "w I w. W", "w C w w", "W License, Version 2.0.", "w w@@ w## w*** W", "w | w | w | W", "R R R R R R w", "w. R R R R R R R R R R R R R R R R w", "R R R", "N N W w w", "x86 w W3C w", "In YYYY w w", "w Lw w W", "w W-W w",
        "w f L w f w L w", "f w L. W f w w", "L w, w f w L. W L f w", "w L L w f L w", "w by w w", "w by f L w. W", "L f by w, w", "contact f w w", "w contact f at w", "contact L w w", "w token f w w", "w token w L w", "passport f w w", "w passport L w", "w regards f w", "f name f w L", "w w f secret. W L w", "w password, w L w", "W L f W W, w f w L w", "w f at f w L w", "at w f w",
    ]
    plain = {
        "w": word, "L": lambda: pick(low, rng.randint(8, 18)), "f": lambda: rng.choice(common), "W": cap, "U": lambda: pick(up, rng.randint(2, 9)), "N": lambda: pick(dig, rng.randint(1, 7)), "YYYY": lambda: "1" + pick(dig, 3), "Lw": lambda: pick(low, 3) + pick(up, 1) + pick(low, 3), "W-W": lambda: cap() + "-" + cap(),
        "E": lambda: f"{pick(low, 5)}.{pick(dig, 2)}@{pick(low, 4)}.example.com", "P": lambda: f"+1 ({pick(dig, 3)}) {pick(dig, 3)}-{pick(dig, 4)}", "I": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), "C": lambda: pick(dig, 16),
    }
    table = []
    for p in patterns:
        for _ in range(per_template):
            tokens, labels = [], []
            plain["R"] = cap().__str__  # one word for all of a row
            for part in p.split():
                core = part.rstrip(".,!@#*") or part
                if m := re.fullmatch(r"\{(\w+)\}", core):
                    got = fill[m[1]]()
                    tokens += got
                    kind = {"lower": "name", "phrase": "secret"}.get(m[1], m[1])
                    labels += [f"B-{kind}", *[f"I-{kind}"] * (len(got) - 1)]
                else:
                    got = (plain[core]() if core in plain else core).split()
                    tokens += [*got[:-1], got[-1] + part[len(core) :]]
                    labels += ["O"] * len(got)
            table.append((tokens, labels))
    return table


#: Words of the labelled table's patterns that the field may use beside shapes, lower-cased.
TRIGGERS = frozenset("mr mrs dr dear regards signed by contact api_key secret ssn iban passport password passphrase token akia sk-".split()) | {"ghp_", "=", "at", "name is", "ssn is", "password is", "secret is", "signed by"}


TITLES = ("mr.", "mrs.", "dr.")


@dataclass
class Field:
    index: dict[str, int]
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # labels x labels, from row to column

    def emission(self, found: list[str]) -> np.ndarray:
        rows = [self.index[f] for f in found if f in self.index]
        return self.weights[rows].sum(0)

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Best labels of chains of one length (n x length x labels), each between two `O`."""
        n, length, k = e.shape
        score, back = self.moves[0] + e[:, 0], np.empty((n, length, k), np.int8)
        for t in range(1, length):
            x = score[:, :, None] + self.moves
            back[:, t] = x.argmax(1)
            score = x.max(1) + e[:, t]
        out = np.empty((n, length), np.int64)
        out[:, -1] = (score + self.moves[:, 0]).argmax(1)
        for t in range(length - 1, 0, -1):
            out[:, t - 1] = back[np.arange(n), t, out[:, t]]
        return out


def _core(token: str) -> str:
    return token.strip(_TRIM)


def train(table: list[tuple[list[str], list[str]]], steps: int = 250, rate: float = 0.1, ridge: float = 2e-3) -> Field:
    """Adam on the exact conditional likelihood: forward and backward over all rows at once, each between two held `O`, padded by more."""
    length, k, n = max(len(t) for t, _ in table) + 2, len(LABELS), len(table)
    index: dict[str, int] = {}
    kinds: dict[tuple[str, ...], int] = {}
    kind, gold = np.full((n, length), -1), np.zeros((n, length), np.int64)
    for r, (tokens, labels) in enumerate(table):
        for t, label in enumerate(labels):
            found = tuple(features(_core(tokens[t]), *around(tokens, t)))
            kind[r, t + 1], gold[r, t + 1] = kinds.setdefault(found, len(kinds)), LABELS.index(label)
    have = np.zeros((len(kinds), len({f for found in kinds for f in found})))  # how often each kind of token has each feature
    for found, r in kinds.items():
        for f in found:
            have[r, index.setdefault(f, len(index))] += 1
    free = kind >= 0
    w, moves = np.zeros((len(index), k)), np.zeros((k, k))
    for a, x in enumerate(LABELS):
        for b, y in enumerate(LABELS):
            if y[0] == "I" and x[1:] != y[1:]:
                moves[a, b] = -8.0  # an inner label follows its own kind; kept fixed
    fixed = moves < 0
    m, v = [np.zeros_like(w), np.zeros_like(moves)], [np.zeros_like(w), np.zeros_like(moves)]

    def by_kind(p: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(kind[free], p[free][:, y], len(kinds)) for y in range(k)], 1)

    want, want_moves = have.T @ by_kind(np.eye(k)[gold]), np.zeros_like(moves)
    np.add.at(want_moves, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    for step in range(1, steps + 1):
        e = (have @ w)[kind]
        e = np.where(free[:, :, None], np.exp(e - e.max(2, keepdims=True)), np.eye(k)[0])
        pay, f, b = np.exp(moves), np.empty_like(e), np.ones_like(e)
        f[:, 0] = e[:, 0]
        for t in range(1, length):
            x = (f[:, t - 1] @ pay) * e[:, t]
            f[:, t] = x / x.sum(1, keepdims=True)
        have_moves = np.zeros_like(moves)
        for t in range(length - 2, -1, -1):
            x = e[:, t + 1] * b[:, t + 1]
            y = x @ pay.T
            have_moves += (f[:, t] / (f[:, t] * y).sum(1, keepdims=True)).T @ x * pay
            b[:, t] = y / y.sum(1, keepdims=True)
        p = f * b
        p /= p.sum(2, keepdims=True)
        grads = [(have.T @ by_kind(p) - want) / n + ridge * w, np.where(fixed, 0, (have_moves - want_moves) / n + ridge * moves)]
        for i, (x, g) in enumerate(zip((w, moves), grads, strict=True)):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            x -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Field(index, w, moves)


#: Words that make a trigger with the one before them.
SECOND = ("is", "by")


def _ends(token: str) -> bool:
    """Whether a sentence ends with the token."""
    low = token.lower().lstrip(_TRIM)
    return low[-1:] in (".", "!", "?") and low not in TITLES


def _closes(token: str) -> bool:
    return token[-1:] in tuple(".,;:!?)\"'") and token.lower() not in TITLES


def around(tokens: list[str], t: int) -> tuple[str, str, frozenset[str], bool, bool, bool]:
    """What features() takes after a token: the triggers beside it, all triggers, again, apart, falls.

    The trigger before it is a word, or two of which the last is in SECOND; a sentence's end hides it.
    """
    before = after = ""
    if t and not _ends(tokens[t - 1]):
        last = _core(tokens[t - 1].lower())
        two = f"{_core(tokens[t - 2].lower())} {last}" if t > 1 and last in SECOND else ""
        before = two if two in TRIGGERS else last if last in TRIGGERS else ""
    if t + 1 < len(tokens) and (word := _core(tokens[t + 1].lower())) in TRIGGERS:
        after = word
    again = t > 0 and tokens[t - 1] == tokens[t] or t + 1 < len(tokens) and tokens[t + 1] == tokens[t]
    return before, after, TRIGGERS, again, t > 0 and _closes(tokens[t - 1]), t > 0 and not before and _core(tokens[t - 1])[:1].isupper()


#: Characters of texts whose tokens are scored at once, and of the different tokens that a tagger remembers.
TEXTS, REMEMBERED = 1 << 21, 1 << 24


#: Words of triggers and function words: what has features of its own.
_OWN = COMMON.union(*map(str.split, TRIGGERS))


class Tagger(dict):
    """Finds the field's spans in texts. Remembers the class of each token: tokens of one class differ in nothing that the field sees, but as copies."""

    def __init__(self, field: Field):
        super().__init__()
        self.field, self.held = field, 0
        self.triggers = {w: i for i, w in enumerate(sorted(TRIGGERS), 1)}
        k, n = len(LABELS), len(self.triggers) + 1
        self.by_before, self.by_after = np.zeros((n, k)), np.zeros((n, k))
        self.by_length = np.zeros((n, 5, k))  # by the trigger before and the length of a plain token, from 1
        for w, i in self.triggers.items():
            self.by_before[i], self.by_after[i] = field.emission([f"b:{w}"]), field.emission([f"a:{w}"])
            for size in range(4):
                self.by_length[i, size + 1] = field.emission([f"b:{w} n:{size}"])
        self.again, self.apart, self.falls = (field.emission([f]) for f in ("again", "apart", "falls"))
        own = field.moves[0, 0]
        self.step = float(field.moves[1:, 1:].max() - own)  # the most that a transition within a run of labels gains over one of `O`
        self.sides = float(field.moves[0, 1:].max() + field.moves[1:, 0].max() - 2 * own) - self.step
        self._anew()

    def _anew(self) -> None:
        self.clear()
        self.held = 0
        self.classes: dict[tuple, int] = {}
        self.rows = [np.array([0.0] + [-1e7] * (len(LABELS) - 1))]  # class 0 stands between texts
        self.facts = [(0,) * (7 + len(SECOND))]  # before, after, place in SECOND, plain length, ends, closes, capital; with each of SECOND

    def __missing__(self, token: str) -> int:
        core = _core(token)
        low = core.lower()
        if core.isalpha() and low not in _OWN and low[:4] not in TRIGGERS and core[1:] == low[1:]:  # most tokens
            key = (core == low, core[0].isupper(), len(core), token[-1] if token[-1] in _TRIM else "")
            if (number := self.classes.get(key)) is None:
                number = self.classes[key] = self._class(token, core, low)
        else:
            number = self._class(token, core, low)
        self[token] = number
        self.held += len(token) + 64
        return number

    def _class(self, token: str, core: str, low: str) -> int:
        single, ends = self.triggers.get(low, 0), _ends(token)
        second = 0 if ends or low not in SECOND else SECOND.index(low) + 1
        facts = (0 if ends else single, single, second, min(len(core) // 5, 3) + 1 if _plain(core) else 0, int(ends), int(_closes(token)), int(core[:1].isupper()), *(self.triggers.get(f"{low} {w}", 0) for w in SECOND))
        found = (facts, *features(core, "", "", TRIGGERS))
        if (number := self.classes.get(found)) is None:
            number = self.classes[found] = len(self.rows)
            self.rows.append(self.field.emission(list(found[1:])))
            self.facts.append(facts)
        return number

    def chains(self, ids: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens (by place) that may have another label than `O`, their emissions, and where among them a chain begins.

        ids are the tokens' classes, 0 before, between and after texts; same tells which tokens equal the next one. A run of tokens with labels gains at most its
        tokens' best gains over `O`, a step each, and the sides; a token is left out if all runs with it gain less than 0.
        """
        table, facts = np.array(self.rows), np.array(self.facts, np.int8)[ids]
        n = len(ids)
        before, after, again, apart, falls = np.zeros(n, np.int8), np.zeros(n, np.int8), np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1], apart[1:] = facts[:-1, 0], facts[1:, 1], facts[:-1, 5]
        at = np.flatnonzero(facts[:-1, 2]) + 1  # after one of SECOND
        two = facts[np.maximum(at - 2, 0), 6 + facts[at - 1, 2]]
        before[at] = np.where(two > 0, two, before[at])
        falls[1:] = (facts[:-1, 6] > 0) & (before[1:] == 0) & (facts[1:, 3] > 0)
        again[1:] = same
        again[:-1] |= same
        gains = (table[:, 1:].max(1) - table[:, 0])[ids]
        some = np.flatnonzero((ids > 0) & ((before > 0) | (after > 0) | again | apart | falls))
        e = table[ids[some]] + self.by_before[before[some]] + self.by_after[after[some]] + self.by_length[before[some], facts[some, 3]]
        e += again[some, None] * self.again + apart[some, None] * self.apart + falls[some, None] * self.falls
        gains[some] = e[:, 1:].max(1) - e[:, 0]
        total = np.concatenate([[0.0], np.cumsum(gains + self.step)])
        best = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total)[:-1]
        places = np.flatnonzero((best + self.sides > -1e-3) & (ids > 0))
        rows = table[ids[places]]
        where = np.minimum(np.searchsorted(some, places), max(len(some) - 1, 0))
        if len(some):
            rows = np.where((some[where] == places)[:, None], e[where], rows)
        begins = np.ones(len(places), bool)
        begins[1:] = (np.diff(places) > 1) | (facts[places[:-1], 4] > 0)
        return places, rows, np.flatnonzero(begins)

    def labels(self, rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The best label of each row of the chains' emissions. Chains are padded by held `O` to lengths a quarter apart."""
        out = np.zeros(len(rows), np.int64)
        sizes = np.diff(begins, append=len(rows))
        order = np.argsort(sizes, kind="stable")
        i = 0
        while i < len(order):
            least = int(sizes[order[i]])
            length = least + least // 4
            j = min(int(np.searchsorted(sizes[order], length, "right")), i + max(1, TEXTS // (32 * length)))
            part = order[i:j]
            inside = np.arange(length) < sizes[part][:, None]
            at = (begins[part][:, None] + np.arange(length))[inside]
            e = np.where(np.arange(len(LABELS)) == 0, 0.0, np.full((len(part), length, 1), -1e9))
            e[inside] = rows[at]
            out[at] = self.field.decode(e)[inside]
            i = j
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        out: list[list[tuple[int, int, int]]] = []
        while len(out) < len(texts):
            ids, same, firsts, size = [0], [False], [], 0
            for text in texts[len(out) :]:
                if size and size + len(text) > TEXTS:
                    break
                size += len(text)
                firsts.append(len(ids))
                tokens = text.split()
                ids += map(self.__getitem__, tokens)
                ids.append(0)
                same += map(eq, tokens, tokens[1:])
                same += [False] * (len(ids) - len(same))
            out += self._found(texts[len(out) : len(out) + len(firsts)], np.array(ids), np.array(same[:-1]), np.array(firsts))
            if self.held > REMEMBERED:
                self._anew()
        return out

    def _found(self, texts: list[str], ids: np.ndarray, same: np.ndarray, firsts: np.ndarray) -> list[list[tuple[int, int, int]]]:
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        places, rows, begins = self.chains(ids, same)
        labels = self.labels(rows, begins)
        chain = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(places)))
        named = np.flatnonzero(labels)
        of = np.searchsorted(firsts, places[named], "right") - 1
        cuts = np.flatnonzero(np.diff(of)) + 1
        for part, k in zip(np.split(named, cuts), of[np.concatenate([[0], cuts])].tolist() if len(of) else [], strict=False):
            text = texts[k]
            spans = np.array([m.span() for m in _TOKEN.finditer(text)])[places[part] - firsts[k]].tolist()
            last, open_kind = -1, None
            for p, (a, b), y in zip(part.tolist(), spans, labels[part].tolist(), strict=True):
                while a < b and text[a] in _TRIM:
                    a += 1
                while b > a and text[b - 1] in _TRIM:
                    b -= 1
                kind = KINDS.index(LABELS[y][2:])
                if LABELS[y][0] == "I" and kind == open_kind and p == last + 1 and chain[p] == chain[last]:
                    if a < b:
                        out[k][-1] = (kind, out[k][-1][1], b)
                elif a < b:
                    out[k].append((kind, a, b))
                    open_kind = kind
                else:
                    open_kind = None
                last = p
        return out


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end>>, base_text, all_text): base_text and all_text join kind:start:end by commas."""
    small_batches(docs.sparkSession)
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(field)
        item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            spans, digests = [], []
            for text, more in zip(texts, tagger.spans(texts), strict=True):
                base = base_spans(text)
                free = [s for s in more if not any(s[1] < e and b < s[2] for _, b, e in base)]
                every = [(KINDS[k], a, b) for k, a, b in base + sorted(free)]
                digests.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in every[: len(base)]).encode()).hexdigest())
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, item), pa.array(digests, pa.string())], names=["doc_id", "spans", "base_sha256"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>, base_sha256 string")


def op4(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    out = find(docs, train(labelled_table()))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return out.select("doc_id", *map(count, KINDS[:4]), "base_sha256", joined.alias("spans"), *map(count, KINDS[4:]))
