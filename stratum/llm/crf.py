"""A linear-chain conditional random field over word shapes, trained and decoded with numpy.

Labels are O and, for each kind, B (begins) and I (goes on). Features are the shapes of a word and of its
neighbours; words are never features, so the labelled table can be small.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from .spans import PII_KINDS

#: Words of a batch, those that pad it included; a longer sentence is a batch of its own.
BATCH = 1 << 15
LABELS = ("O", *(f"{p}-{k}" for k in PII_KINDS for p in "BI"))

#: The labelled table: sentences with their personal data marked as [kind text]; 9 stands for any digit.
LABELLED = (
    "write to [email ab.cd@mail.example] before noon",
    "Contact: [email jane_d99@host-9.example.com], or call",
    "reply at [email x@localhost] and wait",
    "the account [email ann+news@sub.dom.example.org] was closed",
    "sent by <[email müller@büro.example]> on Monday",
    "user [email admin@intranet] logged in from [ip 99.99.9.999]",
    "host [ip 9.9.9.9] is down",
    "from [ip 999.99.9.99:9999] came a request",
    "ping [ip 99.999.99.9] and then [ip 999.9.9.99], please",
    "paid with card [card 9999 9999 9999 9999] today",
    "card number [card 9999-9999-9999-9999], valid",
    "charge [card 9999999999999999] now",
    "use [card 9999.9999.9999.9999] for the order",
    "amex [card 9999 999999 99999] expired",
    "call [phone +9 (999) 999-9999] or write",
    "phone [phone (999) 999-9999] after five",
    "tel. [phone 999-999-9999] is mine",
    "ring [phone +99 99 99999999], ask for me",
    "mobile [phone 999.999.9999] works",
    "my number is [phone (999) 999-9999].",
    "reach us on [phone +999 999 9999999] daily",
    "he said [phone +9 999-999-9999] and hung up",
    "in 9999 there were 99 of them and 9 left",
    "version 9.9 of the file, 9.9.9 next",
    "Licensed under the terms, Version 9.9.",
    "page 99 of 999, line 9999 to 99999",
    "the price was 99.99 or 9,999.99 at most",
    "on 99/99/9999 at 99:99 they met",
    "on 9999-99-99 at 99:99:99 it began",
    "order 9999999 and item 99999999 were lost",
    "id 9999999999 is not a person",
    "score 9-9 in the match of 99 May",
    "from 999-999 rows only 9 passed",
    "@ the corner, see @name and #99",
    "sum: 99% of 999 (that is 99) is enough",
    "a b c d e f g",
    "The house of the old man was small.",
    "token99 = abc9999def and more",
    "room B99 on floor 9, building 99a",
    "chapter 9 verse 99 line 9",
    "ratio 9:9 or 99:9, then 999999 again",
    "copy [email ops-team@hostname], then wait",
    "ask [email jo.k@printer] about it",
    "see [email a.b@c.example] [phone +9 (999) 999-9999] [ip 9.99.999.9]",
)
_MARK = re.compile(r"\[(email|ip|card|phone) ([^\]]+)\]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = re.compile(r"^[<\"'\[{]+|[>\"'\]},;:!?]+$|(?<=[^.])\.$")


def shape(word: str) -> str:
    """Character classes, runs of letters shortened to one: a letters, 9 digits (kept up to 5), others as they are."""
    word = _EDGE.sub("", _EDGE.sub("", word))
    out = re.sub(r"[^\W\d_]+", "a", word)
    return re.sub(r"9{5,}", lambda m: "9" * 5 + ("L" if len(m[0]) >= 12 else "M" if len(m[0]) >= 8 else ""), re.sub(r"[0-9]", "9", out))[:24]


def word_features(word: str) -> list[str]:
    s = shape(word)
    digits = len(_DIGIT.findall(word))
    out = ["s=" + s, "c=" + re.sub(r"9+", "9", s), f"d={min(digits, 20)}", "p=" + s[:1], "e=" + s[-1:]]
    if "@" in word:
        local, _, host = word.rpartition("@")
        out.append("m=" + ("a" if re.search(r"\w", local) else "") + "@" + re.sub(r"\w+", "a", host.rstrip(".,;:!?)>\"'")).replace("a-", "")[:8])
        out.append("at" + ("." if "." in word.split("@")[-1] else "") + ("<" if word[:1] == "@" or word[-1:] == "@" else ""))
    if s.count(".") == 3 and digits:
        out.append("quad")
    return out


def features(words: Sequence[str]) -> list[list[str]]:
    own = [word_features(w) for w in words]
    brief = [f[1] for f in own]
    return [f + ["<" + (brief[i - 1] if i else "^"), ">" + (brief[i + 1] if i + 1 < len(own) else "$")] for i, f in enumerate(own)]


def labelled_table(copies: int = 6, seed: int = 7, sentences: Sequence[str] = LABELLED) -> list[tuple[list[str], list[int]]]:
    """The labelled sentences, each several times with other digits: words and label numbers."""
    rng = np.random.default_rng(seed)
    out = []
    for line in sentences:
        for _ in range(copies):
            plain, spans, at = "", [], 0
            for m in _MARK.finditer(line):
                plain += line[at : m.start()]
                spans.append((len(plain), len(plain) + len(m[2]), m[1]))
                plain, at = plain + m[2], m.end()
            plain += line[at:]
            words, labels = [], []
            for m in _WORD.finditer(plain):
                words.append("".join(str(rng.integers(1, 10)) if c == "9" else c for c in m[0]))
                hit = next((s for s in spans if m.start() < s[1] and s[0] < m.end()), None)
                labels.append(0 if hit is None else 1 + 2 * PII_KINDS.index(hit[2]) + (m.start() > hit[0]))
            out.append((words, labels))
    return out


class Crf:
    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves

    def scores(self, words: Sequence[str]) -> np.ndarray:
        """Emission score of each label for each word; features that training never saw count nothing."""
        out = np.zeros((len(words), len(LABELS)))
        for i, fs in enumerate(features(words)):
            known = [j for f in fs if (j := self.index.get(f)) is not None]
            out[i] = self.weights[known].sum(axis=0)
        return out

    def decode(self, sentences: Sequence[Sequence[str]]) -> list[np.ndarray]:
        """Viterbi labels of every sentence, in batches of like length that hold up to BATCH words with what pads them; outside a sentence stands O."""
        out: list[np.ndarray] = [np.zeros(0, dtype=int)] * len(sentences)
        part: list[int] = []

        def settle() -> None:
            lengths = np.array([len(sentences[i]) for i in part])
            emit = np.zeros((len(part), lengths.max(), len(LABELS)))
            for r, i in enumerate(part):
                emit[r, : lengths[r]] = self.scores(sentences[i])
            for r, path in enumerate(_viterbi(emit, lengths, self.moves)):
                out[part[r]] = path[: lengths[r]]

        for i in sorted((i for i, s in enumerate(sentences) if s), key=lambda i: len(sentences[i])):
            if part and (len(part) + 1) * len(sentences[i]) > BATCH:
                settle()
                part = []
            part.append(i)
        if part:
            settle()
        return out


def _viterbi(emit: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    n, steps, k = emit.shape
    best = moves[0] + emit[:, 0]
    back = np.zeros((n, steps, k), dtype=np.int16)
    ends = np.where((lengths == 1)[:, None], best + moves[:, 0], -np.inf)
    for t in range(1, steps):
        ways = best[:, :, None] + moves
        back[:, t] = ways.argmax(axis=1)
        best = ways.max(axis=1) + emit[:, t]
        ends = np.where((lengths == t + 1)[:, None], best + moves[:, 0], ends)
    path = np.zeros((n, steps), dtype=int)
    now = ends.argmax(axis=1)
    rows = np.arange(n)
    for t in range(steps - 1, -1, -1):
        inside = t < lengths
        path[inside, t] = now[inside]
        now = np.where(inside, back[rows, t, now], now)
    return path


def _forbidden() -> np.ndarray:
    """-inf where an I follows anything but its own B or I."""
    k = len(LABELS)
    out = np.zeros((k, k))
    for j in range(2, k, 2):
        out[[i for i in range(k) if i not in (j, j - 1)], j] = -1e9
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def train(rows: list[tuple[list[str], list[int]]], rounds: int = 120, rate: float = 0.3, ridge: float = 0.02) -> Crf:
    """Maximum conditional likelihood by Adam, all sentences at once."""
    index: dict[str, int] = {}
    flat: list[tuple[int, int, int]] = []
    steps = max(len(w) for w, _ in rows)
    for r, (words, _) in enumerate(rows):
        for t, fs in enumerate(features(words)):
            flat += [(r, t, index.setdefault(f, len(index))) for f in fs]
    r_, t_, f_ = map(np.array, zip(*flat, strict=True))
    n, k = len(rows), len(LABELS)
    mask = np.zeros((n, steps), dtype=bool)
    gold = np.zeros((n, steps), dtype=int)
    for r, (_, labels) in enumerate(rows):
        mask[r, : len(labels)] = True
        gold[r, : len(labels)] = labels
    lengths, fence, eye = mask.sum(axis=1), _forbidden(), np.eye(k)
    gold_moves = np.zeros((k, k))
    for r in range(n):
        path = [0, *gold[r, : lengths[r]], 0]
        np.add.at(gold_moves, (path[:-1], path[1:]), 1)
    theta = [np.zeros((len(index), k)), np.zeros((k, k))]
    memory = [[np.zeros_like(p), np.zeros_like(p)] for p in theta]
    for step in range(1, rounds + 1):
        weights, moves = theta[0], theta[1] + fence
        emit = np.zeros((n, steps, k))
        np.add.at(emit, (r_, t_), weights[f_])
        forward = np.zeros((n, steps, k))
        forward[:, 0] = moves[0] + emit[:, 0]
        for t in range(1, steps):
            forward[:, t] = _lse(forward[:, t - 1][:, :, None] + moves, 1) + emit[:, t]
        backward = np.broadcast_to(moves[:, 0], (n, steps, k)).copy()
        for t in range(steps - 2, -1, -1):
            onward = _lse(moves[None] + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where((t < lengths - 1)[:, None], onward, moves[:, 0])
        total = _lse(forward[np.arange(n), lengths - 1] + moves[:, 0], 1)
        own = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
        expect = np.zeros((k, k))
        expect[0] += own[:, 0].sum(axis=0)
        expect[:, 0] += own[np.arange(n), lengths - 1].sum(axis=0)
        for t in range(1, steps):
            pair = forward[:, t - 1][:, :, None] + moves + (emit[:, t] + backward[:, t])[:, None, :] - total[:, None, None]
            expect += (np.exp(pair) * mask[:, t][:, None, None]).sum(axis=0)
        slope = np.zeros_like(weights)
        np.add.at(slope, f_, (eye[gold] * mask[:, :, None] - own)[r_, t_])
        for p, g, m in zip(theta, (slope - ridge * weights, gold_moves - expect - ridge * theta[1]), memory, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return Crf(index, theta[0], theta[1] + fence)


@lru_cache(maxsize=4)
def trained(sentences: tuple[str, ...] = LABELLED) -> Crf:
    return train(labelled_table(sentences=sentences))
