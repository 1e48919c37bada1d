"""A linear classifier of messages: what a message, or a template of many, says by its words alone.

Kinds are content, error, notice, filler and around (what goes with errors and is no content). A message is the
sum of its words' vectors: a word counts by itself if several examples have it, and by its runs of letters
always, so unseen words and languages near to seen ones count too. How many words no example knows counts as
well, since content has an open vocabulary and such messages have none. Weights are fitted on the driver by
multinomial logistic regression over the examples and a bounded sample of the corpus, which stands for content
but for the messages in it that the examples' words cover.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np

from .message_examples import examples

KINDS = ("content", "error", "notice", "filler", "around")
#: Most messages of the corpus from which the fit's sample is drawn, and the most messages of that sample.
POOL, SAMPLE = 40_000, 8_000
#: Places for features, which are found by hash.
WIDTH = 1 << 15
#: Share of a corpus message's words that the examples know, from which on it is not held for content.
COVERED = 0.7
#: Least weight of an example of content against a message of the corpus, and what pulls weights to 0.
EXAMPLE_WEIGHT, DECAY = 4.0, 3e-4
ROUNDS, STEP = 120, 0.5
#: Logarithm of the probability of content below which a message of the sample is not held for content.
DOUBT = -1.2

_WORD = re.compile(r"<\*>|#|(?:[^\W_]|[̀-ͯऀ-෿‍])+(?:['’][^\W_]+)*")
_HEXED = re.compile(r"(?<![^\W_])(?=[0-9a-f]*\d)[0-9a-f]{3,}(?![^\W_])|\d+", re.IGNORECASE)
_OPEN = ("<*>", "#")


def masked(message: str) -> str:
    """A message in lower case with # for numbers and hexadecimal ids."""
    return _HEXED.sub("#", message.lower()).strip()


def words_of(message: str) -> list[str]:
    return _WORD.findall(message)


def _place(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % WIDTH


class Features:
    """Words and pairs of words as units, each with its features; a message is the sum of its units.

    A unit that begins with a mark is a strange word, which counts by its runs of letters alone.
    """

    def __init__(self, known: frozenset[str]):
        self.known = known

    def of_unit(self, unit: str) -> list[int]:
        if " " in unit:
            return [_place(f"2 {unit}")]
        if unit in _OPEN:
            return []
        if unit.startswith("\0"):
            return [_place(unit)]
        unit, known = unit.removeprefix("\1"), not unit.startswith("\1")
        padded, (low, high) = f"^{unit}$", ((3, 4) if unit.isascii() else (2, 3))
        grams = {padded[i : i + n] for n in (low, high) for i in range(len(padded) - n + 1)}
        return [_place(f"g {g}") for g in grams] + ([_place(f"w {unit}")] * 2 if known else [])

    def units(self, message: str, hidden: frozenset[str] = frozenset()) -> list[str]:
        words = words_of(message)
        told = [w for w in words if w not in _OPEN]
        knows = {w: w in self.known and w not in hidden for w in told}
        strange = sum(not knows[w] for w in told)
        share = 0 if not told else -(-4 * strange // len(told))
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if knows.get(a) and knows.get(b)]
        shape = [f"\0share {share}", f"\0strange {min(strange, 5)}", f"\0words {min(len(told), 4)}"]
        if len(told) > 1 and sum(a == b for a, b in zip(told, told[1:], strict=False)) * 2 >= len(told) - 1:
            shape.append("\0repeats")
        # Each unit counts once, so a long text is no surer than its words are.
        return list(dict.fromkeys([w if knows.get(w, True) else f"\1{w}" for w in words] + pairs + shape))


class Classifier:
    """``weights`` (WIDTH, kinds) over ``Features``; vectors of words are kept, so a corpus costs its vocabulary once."""

    def __init__(self, known: frozenset[str], weights: np.ndarray, bias: np.ndarray, most: int = 200_000):
        self.features, self.weights, self.bias, self.most = Features(known), weights, bias, most
        self._kept: dict[str, np.ndarray] = {}

    def vector(self, unit: str) -> np.ndarray:
        found = self._kept.get(unit)
        if found is None:
            if len(self._kept) >= self.most:
                self._kept.clear()
            places = self.features.of_unit(unit)
            found = self._kept[unit] = (self.weights[places].sum(axis=0) / len(places) ** 0.5 if places else np.zeros(len(KINDS))).astype(np.float64)
        return found

    def scores(self, message: str) -> np.ndarray:
        """The logarithm of each kind's probability."""
        out = np.add.reduce([self.bias, *map(self.vector, self.features.units(message))])
        return out - np.logaddexp.reduce(out)

    def can_tell(self, message: str) -> bool:
        """Whether a message has a word that the examples know, says one word again and again, or is four words or longer."""
        told = [w for w in words_of(message) if w not in _OPEN]
        return len(told) > 3 or any(w in self.features.known for w in told) or (len(told) > 1 and len(set(told)) == 1)

    def telling(self, word: str) -> bool:
        """Whether the examples know a word: two messages that differ in it are never one template."""
        return word in self.features.known


def _matrix(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ones of a sparse matrix."""
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.fromiter((c for r in rows for c in r), np.int64)


def _times(at: np.ndarray, to: np.ndarray, scale: np.ndarray, dense: np.ndarray, size: int) -> np.ndarray:
    out = np.empty((size, dense.shape[1]))
    for k in range(dense.shape[1]):
        out[:, k] = np.bincount(at, weights=dense[to, k] * scale[at], minlength=size)
    return out


def _more(rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Examples made from examples by rule: errors with what goes around them, and filler's Latin in other orders."""
    of = {kind: [text for k, text in rows if k == kind] for kind in KINDS}
    made = []
    for kind in ("error", "notice"):
        for n, text in enumerate(of[kind]):
            near = [of["around"][(7 * n + k * k + len(kind)) % len(of["around"])] if of["around"] else "" for k in range(4)]
            sign = (" ", ": ", " - ", " | ", " – ")[n % 5]
            made += [(kind, f"{near[0]}{sign}{text}"), (kind, f"#{sign}{text} {near[1]}"), (kind, f"{text} {near[2]}"), (kind, f"{near[3]} # {text}")]
    latin = [w for text in of["filler"] if len(words_of(text)) > 6 for w in words_of(text)]
    for n in range(len(latin) // 3):
        made.append(("filler", " ".join(latin[(31 * n + 17 * k * k + k) % len(latin)] for k in range(2 + n % 7))))
    return made


def _drawn(pool: list[str], known: frozenset[str], spread: Counter, size: int) -> list[str]:
    """Messages of a pool that may stand for content: up to half of them those nearest to the examples by their words."""
    near, far = [], []
    for message in dict.fromkeys(pool):
        told = [w for w in words_of(message) if w not in _OPEN]
        share = sum(w in spread for w in told) / len(told) if told else 1.0
        if share < COVERED:
            (near if any(len(w) > 3 and w in known for w in told) else far).append((-share, message))
    hard = [m for _, m in sorted(near)[: size // 2]]
    taken = set(hard)
    rest = [m for _, m in far + near if m not in taken]
    return hard + rest[: size - len(hard)]


def fit(pool: list[str], alike: list[tuple[str, str]] = (), labelled: list[tuple[str, str]] | None = None, rounds: int = ROUNDS) -> Classifier:
    """A classifier from examples and a pool of masked messages of the corpus, of which at most ``SAMPLE`` are used.

    ``alike`` are further messages of the pool in pairs that begin alike; each half of the sample has one of a pair.

    A word is known if two examples of other kinds than content have it. Each such example is seen a second time
    with a part of its words hidden, as if they were strange, so that messages in other words are found too. The
    sample's messages count as content unless the known words cover them, or a classifier that saw the other half
    of the sample holds them for something else. An empty pool is allowed.
    """
    rows = [(kind, masked(text)) for kind, text in (labelled if labelled is not None else examples())]
    rows += _more(rows)
    spread = Counter(w for kind, text in rows if kind != "content" for w in set(words_of(text)))
    known = frozenset(w for w, n in spread.items() if n > 1 and w not in _OPEN)
    side = {m: zlib.crc32(m.encode("utf-8", "surrogatepass")) & 1 for m in pool} | {m: k for pair in alike for k, m in enumerate(pair)}
    halves = ([], [])
    for message in _drawn([*side][: 2 * POOL], known, spread, SAMPLE):
        halves[side[message]].append(message)
    kept = []
    for k in (0, 1):
        other = _fitted(rows, known, halves[1 - k], max(1, rounds // 2))
        kept += [m for m in halves[k] if other.scores(m)[0] > DOUBT]
    return _fitted(rows, known, kept, rounds)


def _fitted(rows: list[tuple[str, str]], known: frozenset[str], content: list[str], rounds: int) -> Classifier:
    features = Features(known)
    veiled = [(kind, text) for kind, text in rows if kind != "content" and len(words_of(text)) > 1]
    hide = lambda text: frozenset(w for w in words_of(text) if zlib.crc32(f"{text} {w}".encode()) % 5 < 2)
    texts = [*((t, frozenset()) for _, t in rows), *((t, hide(t)) for _, t in veiled), *((t, frozenset()) for t in content)]
    kinds = np.array([KINDS.index(kind) for kind, _ in rows + veiled] + [0] * len(content))
    # Content weighs as much as all else at least, also where the corpus is small or empty.
    honest = sum(kind == "content" for kind, _ in rows)
    balance = max(EXAMPLE_WEIGHT, (len(rows) - honest + len(veiled) - len(content)) / max(1, honest))
    weight = np.array([balance if kind == "content" else 1.0 for kind, _ in rows + veiled] + [1.0] * len(content))
    units: dict[str, int] = {}
    said = _matrix([[units.setdefault(u, len(units)) for u in features.units(*t)] for t in texts])
    made = _matrix([features.of_unit(u) for u in units])
    one, scale = np.ones(len(texts)), 1 / np.sqrt(np.maximum(1, np.bincount(made[0], minlength=len(units))))
    weights, bias = np.zeros((WIDTH, len(KINDS))), np.zeros(len(KINDS))
    grown, grown_bias = np.full_like(weights, 1e-6), np.full_like(bias, 1e-6)
    target = np.eye(len(KINDS))[kinds]
    for _ in range(rounds):
        vectors = _times(*made, scale, weights, len(units))
        logits = _times(*said, one, vectors, len(texts)) + bias
        logits -= logits.max(axis=1, keepdims=True)
        chance = np.exp(logits)
        chance /= chance.sum(axis=1, keepdims=True)
        error = (chance - target) * (weight / weight.sum())[:, None]
        by_unit = _times(said[1], said[0], np.ones(len(units)), error, len(units))
        slope = np.empty_like(weights)
        for k in range(len(KINDS)):
            slope[:, k] = np.bincount(made[1], weights=by_unit[made[0], k] * scale[made[0]], minlength=WIDTH)
        slope += DECAY * weights / WIDTH**0.5
        grown += slope**2
        weights -= STEP * slope / np.sqrt(grown)
        slope_bias = error.sum(axis=0)
        grown_bias += slope_bias**2
        bias -= STEP * slope_bias / np.sqrt(grown_bias)
    return Classifier(known, weights.astype(np.float32), bias)
