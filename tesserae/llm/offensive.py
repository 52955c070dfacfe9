"""Abusive, hateful or sexual content: a calibrated score per document.

Method: gradient-boosted trees over dense features, then isotonic calibration.
The features are densities of word lists and of phrases learnt from the
reviewed documents, how near second-person words and groups stand to abuse,
how harmless or not the words around abuse are elsewhere, capitals,
exclamation and disguise. They are taken over a sliding window, as a single
sentence decides, and kept as the document's largest and mean values.

The trees correct a fixed weighting of the word lists, and the calibration has
it as a few pseudo-observations: with few labels the answer stays near that
weighting, with many the labels decide, and nothing switches in between. The
model is fitted on at most ``MAX_LABELLED`` reviewed documents, chosen by hash;
that bounds only the fitting. Texts stay on the executors: phrases are counted
there, and a row of numbers per reviewed document comes to the driver.

Reviewers saw more offensive documents than there are. The share of offensive
ones among all documents is estimated from the scores of all of them by
expectation maximisation, and the calibrated probabilities are moved to it.

Defined cases: a null or empty text scores the same as one without any word;
undecided verdicts and documents whose verdicts contradict each other do not
train; without any label the fixed weighting answers alone; rows without id
are left out. Every document is read whole, however long: features of a long
one are taken in blocks of ``BLOCK_TOKENS`` words that share their borders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import lexicon
from tesserae.llm.gbt import BoostedTrees, Isotonic
from tesserae.llm.textnorm import plain_words, raw_tokens
from tesserae.session import cut, spread

MAX_LABELLED = 20_000
WINDOW = 12
FOLDS = 3
#: A learnt phrase has at most so many words and is so many times likelier in offensive documents (natural log).
PHRASE_WORDS, PHRASE_ODDS = 4, 1.5
#: Offensive documents a phrase of one, two, three or four words stands in at least.
PHRASE_SUPPORT = (3, 3, 1, 1)
#: Words and phrases near abuse count by their odds from so many reviewed documents on.
CONTEXT_WORDS, CONTEXT_SUPPORT = 3, 3
THRESHOLD = 0.5
#: Pseudo-observations of the fixed weighting in the calibration.
PRIOR_WEIGHT = 0.25
EMPTY_WEIGHT = 10.0

#: Words turned into features at once; long texts go in several blocks.
BLOCK_TOKENS = 200_000
#: Spellings a worker remembers before it begins anew.
REMEMBERED = 300_000

_NAMES = list(lexicon.LISTS)
_BIT = {n: 1 << i for i, n in enumerate(_NAMES)}
_MASKABLE = sum(_BIT[n] for n in lexicon.DISGUISED)
_ABUSE = _BIT["insult"] | _BIT["slur"] | _BIT["dehumanise"] | _BIT["sexual"] | _BIT["threat"]
_MASKED, _CONTEXT = xxhash.xxh64_intdigest("<masked>"), 0x9E3779B97F4A7C15
_STEP = np.uint64(0x100000001B3)


@lru_cache(1)
def _words() -> dict[str, int]:
    out: dict[str, int] = {}
    for name, words in lexicon.LISTS.items():
        for w in words:
            out[w] = out.get(w, 0) | _BIT[name]
    return out


@lru_cache(1)
def _swapped() -> dict[str, str]:
    """Words with two neighbouring letters swapped -> the word."""
    known, out = _words(), {}
    for name in lexicon.DISGUISED:
        for w in lexicon.LISTS[name]:
            for i in range(len(w) - 1):
                s = w[:i] + w[i + 1] + w[i] + w[i + 2 :]
                if len(w) >= 3 and s != w and s not in known:
                    out.setdefault(s, w)
    return out


@lru_cache(1)
def _by_length() -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for w, bits in _words().items():
        if bits & _MASKABLE:
            out.setdefault(len(w), []).append(w)
    return out


@lru_cache(1)
def _inside() -> re.Pattern:
    """Longer words of the disguised lists, to be found within runs of letters."""
    words = {w for name in lexicon.DISGUISED for w in lexicon.LISTS[name] if len(w) >= 5}
    return re.compile("|".join(sorted(words, key=lambda w: (-len(w), w))))


def _plain(word: str, masked: bool) -> tuple[str, bool]:
    """(the word it stands for, whether it was disguised)."""
    known = _words()
    if word in known or word.isalpha() and len(word) < 3:
        return word, False
    if masked:
        seen = [i for i, c in enumerate(word) if c.isalpha()]
        if seen and (len(seen) > 1 or seen[0] == 0):
            for n in (len(word), len(word) - 1) if word.endswith("s") else (len(word),):
                for w in _by_length().get(n, ()):
                    if all(i >= n or w[i] == word[i] for i in seen):
                        return w, True
        return "<masked>", True
    if word in _swapped():
        return _swapped()[word], True
    if word.endswith("s") and word[:-1] in known:
        return word[:-1], False
    return word, False


class _Spellings(dict):
    """Raw token -> number; the words a token stands for are kept as arrays by that number."""

    def __init__(self) -> None:
        super().__init__()
        self.first, self.name, self.bits, self.flags = [0], [], [], []
        self._arrays: tuple | None = None

    def __missing__(self, raw: str) -> int:
        words, flag = plain_words(raw, _words())
        for w in words:
            plain, hidden = _plain(w, bool(flag & 8))
            parts = [plain]
            if len(plain) > 24:  # joined words: those of the lists that stand inside, and the run itself
                parts = [*_inside().findall(plain), plain]
            for p in parts:
                bits = _words().get(p, 0)
                tag = next((t for t in lexicon.TAGS if bits & _BIT[t]), None)
                self.name.append(xxhash.xxh64_intdigest(f"<{tag}>" if tag else p))
                self.bits.append(bits)
                self.flags.append(flag | 2 if hidden or p != plain else flag)
        self.first.append(len(self.name))
        self[raw] = number = len(self.first) - 2
        self._arrays = None
        return number

    def arrays(self) -> tuple[np.ndarray, ...]:
        if self._arrays is None:
            self._arrays = np.array(self.first), np.array(self.name, np.uint64), np.array(self.bits, np.int64), np.array(self.flags, np.int64)
        return self._arrays


_SPELLINGS = _Spellings()


@dataclass
class Tokens:
    """The words of many texts behind one another, by hash."""

    name: np.ndarray
    bits: np.ndarray
    flags: np.ndarray
    first: np.ndarray  # index of each text's first word, and the end

    @classmethod
    def of(cls, texts: list[str | None]) -> Tokens:
        global _SPELLINGS
        if len(_SPELLINGS) > REMEMBERED:
            _SPELLINGS = _Spellings()
        raw = [raw_tokens(t) if t else [] for t in texts]
        number = np.fromiter(map(_SPELLINGS.__getitem__, chain.from_iterable(raw)), np.int64, sum(map(len, raw)))
        first, name, bits, flags = _SPELLINGS.arrays()
        begin, count = first[number], first[number + 1] - first[number]
        ends = np.cumsum(count)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - count), count)
        tokens = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
        return cls(name[at], bits[at], flags[at], np.r_[0, ends][tokens])

    def part(self, start: int, stop: int) -> Tokens:
        return Tokens(self.name[start:stop], self.bits[start:stop], self.flags[start:stop], np.array([0, stop - start]))

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def reach(self, words: int) -> np.ndarray:
        """Per word, the end of a window of so many words that stays in its text."""
        return np.minimum(np.arange(len(self.name)) + words, np.repeat(self.first[1:], np.diff(self.first)))

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, positions, hashes) of all phrases, by number of words."""
        room = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.name))
        at, code = np.arange(len(self.name)), self.name
        for n in range(1, PHRASE_WORDS + 1):
            if n > 1:
                stay = room[at] >= n
                at, code = at[stay], code[stay] * _STEP + self.name[at[stay] + n - 1]
            yield n, at, code + np.uint64(n)

    def beside_abuse(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, hashes) of phrases up to ``CONTEXT_WORDS`` that begin within a window of a word of abuse."""
        near = self._near_abuse()
        for n, at, code in self.grams():
            if n <= CONTEXT_WORDS:
                yield at[near[at]], code[near[at]] ^ np.uint64(_CONTEXT)

    def _near_abuse(self) -> np.ndarray:
        hit = np.r_[0, np.cumsum((self.bits & _ABUSE) > 0)]
        low = np.maximum(np.arange(len(self.name)) - WINDOW + 1, np.repeat(self.first[:-1], np.diff(self.first)))
        return hit[self.reach(WINDOW)] > hit[low]


@dataclass
class Phrases:
    """Sorted hashes with their log odds: phrases, and words near abuse."""

    code: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    context: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    context_odds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self) -> None:
        self._seen, self._near = _marked(self.code), _marked(self.context)

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, odds) of the codes that are phrases."""
        return _found(self._seen, self.code, self.odds, code)

    def find_context(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _found(self._near, self.context, self.context_odds, code)


#: Bits of a code by which most codes that are no phrase are told without a search.
_MARK_BITS = 18


def _marked(code: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _MARK_BITS, bool)
    out[code >> np.uint64(64 - _MARK_BITS)] = True
    return out


def _found(marked: np.ndarray, known: np.ndarray, odds: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.flatnonzero(marked[code >> np.uint64(64 - _MARK_BITS)])
    if not len(place):
        return place, np.zeros(0)
    at = np.minimum(np.searchsorted(known, code[place]), len(known) - 1)
    same = known[at] == code[place]
    return place[same], odds[at[same]]


def _columns() -> list[str]:
    return (
        [f"most_{n}" for n in _NAMES]
        + ["abuse", "you_abuse", "group_abuse", "you_threat", "body_threat", "you_sexual", "hidden", "masked", "hidden_you_group", "group_threat", "you_group_exclude"]
        + ["evidence", "strongest", "phrases", "evidence_abuse", "weak_phrases", "context", "context_you", "context_evidence"]
        + [f"mean_{n}" for n in _NAMES]
        + ["mean_capitals", "mean_exclamation", "mean_hidden", "words"]
    )


COLUMNS = _columns()
_MEANS = COLUMNS.index(f"mean_{_NAMES[0]}")
#: Context odds of a text without any abuse.
_NO_CONTEXT = -9.0


def _block(tokens: Tokens, phrases: Phrases, own: np.ndarray) -> np.ndarray:
    """Largest values and sums per text; ``own``: words of each text that count as beginnings and in sums, the rest are only seen."""
    n = len(tokens.first) - 1
    out = np.zeros((n, len(COLUMNS)))
    out[:, COLUMNS.index("context") : COLUMNS.index("context_evidence") + 1] = _NO_CONTEXT
    full = np.flatnonzero(own > 0)
    if not len(full):
        return out
    stop, size = tokens.reach(WINDOW), np.diff(tokens.first)
    counted = np.arange(len(tokens.name)) - np.repeat(tokens.first[:-1], size) < np.repeat(own, size)
    at = np.r_[0, np.cumsum(counted)][tokens.first[full]]

    every = bool(counted.all())

    def sums(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x) + 1, np.int32 if x.dtype == bool else np.float64)
        np.cumsum(x, out=total[1:])
        return total[stop] - total[:-1]

    def largest(x: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(x if every else x[counted], at)

    here = {name: (tokens.bits & bit) > 0 for name, bit in _BIT.items()}
    w = {name: sums(x) for name, x in here.items()}
    disguised = (tokens.flags & 2) > 0
    hidden, masked = sums(disguised & ((tokens.bits & _MASKABLE) > 0)), sums(tokens.name == np.uint64(_MASKED))
    abuse = w["insult"] + w["slur"] + w["dehumanise"]
    you, group = np.minimum(1, w["you"]), np.minimum(1, w["group"])

    evidence, strongest, weak = np.zeros(len(tokens.name)), np.zeros(len(tokens.name)), np.zeros(len(tokens.name))
    for words, place, code in tokens.grams():
        hit, odds = phrases.find(code)  # a place has one phrase of so many words
        evidence[place[hit]] += odds
        strongest[place[hit]] = np.maximum(strongest[place[hit]], odds)
        if words > 2:
            weak[place[hit]] += 1
    ev = sums(evidence)
    odds = np.zeros(len(tokens.name))
    for place, code in tokens.beside_abuse():
        hit, value = phrases.find_context(code)
        odds[place[hit]] += value
    around = sums(odds)
    some = abuse + w["sexual"] + w["threat"] > 0
    beside = np.where(some, around, _NO_CONTEXT)
    values = [w[x] for x in _NAMES] + [
        abuse, you * abuse, group * (abuse + w["exclude"]), you * w["threat"], np.minimum(w["threat"], w["body"]), you * w["sexual"], hidden, masked,
        hidden * (you + group), group * w["threat"], (you + group) * w["exclude"],
        ev, strongest, sums(strongest > 0), ev * some, sums(weak), beside, np.where(you > 0, beside, _NO_CONTEXT), np.where(ev > 0, beside, _NO_CONTEXT),
    ]
    for j, x in enumerate(values):
        out[full, j] = largest(x)
    owner = tokens.owner()[counted]
    for j, x in enumerate([*here.values(), (tokens.flags & 1) > 0, (tokens.flags & 4) > 0, disguised]):
        out[:, _MEANS + j] = np.bincount(owner, x[counted], n)
    out[:, -1] = own
    return out


def features(tokens: Tokens, phrases: Phrases) -> np.ndarray:
    """A row of numbers per text, ``COLUMNS``; the same however the words are cut into blocks."""
    size = np.diff(tokens.first)
    out = np.zeros((len(size), len(COLUMNS)))
    seen = WINDOW + PHRASE_WORDS
    i = 0
    while i < len(size):
        j = i + 1
        while j < len(size) and tokens.first[j + 1] - tokens.first[i] <= BLOCK_TOKENS:
            j += 1
        a, b = tokens.first[i], tokens.first[j]
        if b - a <= BLOCK_TOKENS:
            some = Tokens(tokens.name[a:b], tokens.bits[a:b], tokens.flags[a:b], tokens.first[i : j + 1] - a)
            out[i:j] = _block(some, phrases, size[i:j])
        else:
            parts = [_block(tokens.part(s, min(s + BLOCK_TOKENS + seen, b)), phrases, np.array([min(BLOCK_TOKENS, b - s)])) for s in range(a, b, BLOCK_TOKENS)]
            rows = np.concatenate(parts)
            out[i] = np.r_[rows[:, :_MEANS].max(axis=0), rows[:, _MEANS:].sum(axis=0)]
        i = j
    out[:, _MEANS:-1] /= np.maximum(out[:, -1:], 1)
    out[:, -1] = np.log1p(out[:, -1])
    return out


def prior_margin(x: np.ndarray) -> np.ndarray:
    """Log odds by a fixed weighting: second person, groups and bodies near abuse, sexual words and threats, and disguised abuse."""
    c = {name: x[:, i] for i, name in enumerate(COLUMNS)}
    near = np.minimum(c["you_abuse"], 2) + np.minimum(c["group_abuse"], 2) + 0.7 * np.minimum(c["you_sexual"], 2) + 0.5 * np.minimum(c["you_threat"], 2)
    return 1.5 * near + np.minimum(c["hidden"], 2) + 0.8 * np.minimum(c["most_insult"], 2) + 0.5 * np.minimum(c["body_threat"], 1) - 3.5


@dataclass
class OffensiveModel:
    phrases: Phrases = field(default_factory=Phrases)
    trees: BoostedTrees = field(default_factory=BoostedTrees)
    calibration: Isotonic = field(default_factory=Isotonic)
    #: Share of offensive documents among those the model was fitted on, and among all.
    fitted_share: float = 0.5
    share: float = 0.5
    threshold: float = THRESHOLD

    def reviewed_probability(self, texts: list[str | None]) -> np.ndarray:
        """Probability among documents chosen as the reviewed ones were."""
        return self.calibration.predict(self._score(features(Tokens.of(texts), self.phrases)))

    def _score(self, x: np.ndarray) -> np.ndarray:
        return self.trees.score(x, prior_margin(x))

    def moved(self, p: np.ndarray) -> np.ndarray:
        """Probabilities among the reviewed as probabilities among all."""
        up, down = self.share / self.fitted_share, (1 - self.share) / (1 - self.fitted_share)
        return p * up / (p * up + (1 - p) * down)

    def probability(self, texts: list[str | None]) -> np.ndarray:
        return self.moved(self.reviewed_probability(texts))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, fold: np.ndarray, phrases: Phrases) -> OffensiveModel:
        """``x``: features taken with phrases learnt without the fold of their document."""
        y = y.astype(float)
        share = float((y.sum() + 1) / (len(y) + 2))
        return cls(phrases, _trees(x, y), calibrated(held_out_scores(x, y, fold), y), share, share)


def _trees(x: np.ndarray, y: np.ndarray) -> BoostedTrees:
    """Trees over the fixed weighting; a text without words stands ``EMPTY_WEIGHT`` times for that weighting, so that a few verdicts of one kind move only what is like them."""
    empty = features(Tokens.of([""]), Phrases())
    x, y = np.concatenate([x, empty]), np.r_[y, 1 / (1 + np.exp(-prior_margin(empty)))]
    return BoostedTrees().fit(x, y, np.r_[np.ones(len(y) - 1), EMPTY_WEIGHT], prior_margin(x))


def held_out_scores(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Log odds of each reviewed document by trees fitted without its fold."""
    out, margin = np.zeros(len(y)), prior_margin(x)
    for k in range(FOLDS):
        a, b = fold != k, fold == k
        if b.any():
            out[b] = _trees(x[a], y[a].astype(float)).score(x[b], margin[b])
    return out


def calibrated(score: np.ndarray, y: np.ndarray) -> Isotonic:
    """Probability by score; the fixed weighting counts as a few observations beside the real ones."""
    grid = np.linspace(-8, 8, 33)
    return Isotonic().fit(np.r_[score, grid], np.r_[y, 1 / (1 + np.exp(-grid))], np.r_[np.ones(len(y)), np.full(len(grid), PRIOR_WEIGHT)])


def reviewed(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, y, fold) of reviewed documents, bounded as documented; equal texts share a fold."""
    verdict = labels.filter("offensive is not null and doc_id is not null").groupBy("doc_id").agg(
        F.max("offensive").alias("y"), F.min("offensive").alias("least")
    )
    verdict = verdict.filter("y = least and y in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    found = documents.select("doc_id", "text").join(verdict.select("doc_id", "y"), "doc_id")
    fold = F.pmod(F.xxhash64(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"\W+", " "))), F.lit(FOLDS)).cast("int")
    return cut(found.select("doc_id", "text", F.col("y").cast("int").alias("y"), fold.alias("fold")))


def _texts(part: pd.DataFrame) -> list[str | None]:
    return [t if isinstance(t, str) else None for t in part["text"]]


_CELLS = [f"c{y}{k}" for y in range(2) for k in range(FOLDS)]


def _phrases_of(tokens: Tokens, among: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, code, words) of its phrases, of those in ``among`` if given, and with 0 words of its phrases beside abuse."""
    owner, found = tokens.owner(), []
    for n, at, code in tokens.grams():
        if among is not None:
            keep = among[np.minimum(np.searchsorted(among, code), len(among) - 1)] == code if len(among) else np.zeros(len(code), bool)
            at, code = at[keep], code[keep]
        found.append((owner[at], code, np.full(len(at), n)))
    found += [(owner[at], code, np.zeros(len(at), np.int64)) for at, code in tokens.beside_abuse()]
    return tuple(np.concatenate(x) for x in zip(*found))


def _count_phrases(rows: DataFrame, among: np.ndarray | None = None) -> pd.DataFrame:
    """(code, words, counts by class and fold) over the documents of ``rows``, each document once."""
    shared = rows.sparkSession.sparkContext.broadcast(among)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            cell = (part["y"] * FOLDS + part["fold"]).to_numpy(np.int64)
            doc, code, words = _phrases_of(Tokens.of(_texts(part)), shared.value)
            order = np.lexsort((code, doc))
            doc, code, words = doc[order], code[order], words[order]
            new = np.r_[True, (np.diff(doc) != 0) | (code[1:] != code[:-1])] if len(doc) else np.zeros(0, bool)
            doc, code, words = doc[new], code[new], words[new]
            known, first, at = np.unique(code, return_index=True, return_inverse=True)
            counts = np.bincount(at * 2 * FOLDS + cell[doc], minlength=len(known) * 2 * FOLDS).reshape(len(known), 2 * FOLDS)
            yield pd.DataFrame(counts, columns=_CELLS).assign(code=known.view(np.int64), words=words[first])[["code", "words", *_CELLS]]

    counted = rows.mapInPandas(run, "code bigint, words int, " + ", ".join(f"{c} bigint" for c in _CELLS))
    return counted.groupBy("code").agg(F.max("words").alias("words"), *[F.sum(c).alias(c) for c in _CELLS]).toPandas()


def learn_phrases(rows: DataFrame) -> list[Phrases]:
    """Phrases learnt from the reviewed documents without each fold, and last from all of them."""
    offensive = _count_phrases(rows.filter("y = 1"))
    least = np.array((0, *PHRASE_SUPPORT))
    told = offensive[(offensive["words"] > 0) & (offensive[_CELLS].sum(axis=1) >= least[offensive["words"]])]
    told = told.assign(code=told["code"].to_numpy(np.int64).view(np.uint64)).sort_values("code", ignore_index=True)
    inside, size = told["code"].to_numpy(np.uint64), told["words"].to_numpy(np.int64)
    met = told[_CELLS].to_numpy(np.int64).reshape(-1, 2, FOLDS).copy()
    other = _count_phrases(rows.filter("y = 0"), inside)
    outside = other[other["words"] > 0]
    met[np.searchsorted(inside, outside["code"].to_numpy(np.int64).view(np.uint64)), 0] = outside[_CELLS].to_numpy(np.int64).reshape(-1, 2, FOLDS)[:, 0]
    beside = pd.concat([x[x["words"] == 0] for x in (offensive, other)]).groupby("code", as_index=False)[_CELLS].sum()
    beside = beside[beside[_CELLS].sum(axis=1) >= CONTEXT_SUPPORT]
    near = beside["code"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(near)
    near, beside = near[order], beside[_CELLS].to_numpy(np.int64).reshape(-1, 2, FOLDS)[order]

    total = np.zeros((2, FOLDS))
    for r in rows.groupBy("y", "fold").count().collect():
        total[r["y"], r["fold"]] = r["count"]
    out = []
    for left_out in [*range(FOLDS), None]:
        use = [k for k in range(FOLDS) if k != left_out]
        neg, pos = np.maximum(1, total[:, use].sum(axis=1))
        n, m = met[:, 1][:, use].sum(axis=1), met[:, 0][:, use].sum(axis=1)
        odds = np.log(np.maximum(n - 0.3, 1e-9) / pos) - np.log((m + 0.02 * n + 0.3) / neg)
        good = (n >= least[size]) & (odds >= PHRASE_ODDS)
        a, b = beside[:, 1][:, use].sum(axis=1), beside[:, 0][:, use].sum(axis=1)
        context_odds = np.log((a + 0.5) / (pos + 1)) - np.log((b + 0.5) / (neg + 1))
        out.append(Phrases(inside[good], odds[good], near, np.clip(context_odds, -2, 2)))
    return out


def reviewed_features(documents: DataFrame, labels: DataFrame) -> tuple[pd.DataFrame, np.ndarray, list[Phrases]]:
    """((doc_id, y, fold), features) of the reviewed documents, taken with phrases learnt without their fold, and all phrases."""
    rows = spread(reviewed(documents, labels))
    phrases = learn_phrases(rows)
    shared = rows.sparkSession.sparkContext.broadcast(phrases)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k, own in part.groupby("fold"):
                x = features(Tokens.of(_texts(own)), shared.value[k])
                yield pd.DataFrame({"doc_id": own["doc_id"], "y": own["y"], "fold": own["fold"], "x": list(x)})

    found = rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, y int, fold int, x array<double>").toPandas().sort_values("doc_id", ignore_index=True)
    x = np.stack(found.pop("x").to_list()) if len(found) else np.zeros((0, len(COLUMNS)))
    return found, x, phrases


def fit_offensive(documents: DataFrame, labels: DataFrame) -> OffensiveModel:
    """The model fitted on the reviewed documents."""
    found, x, phrases = reviewed_features(documents, labels)
    return OffensiveModel.fit(x, found["y"].to_numpy(np.int64), found["fold"].to_numpy(np.int64), phrases[-1])


def without_evidence(x: np.ndarray) -> np.ndarray:
    """Documents with no word of abuse, sex or violence, masked or not, and no learnt phrase: a verdict against one is taken as wrong."""
    names = ["most_insult", "most_slur", "most_dehumanise", "most_sexual", "most_threat", "masked", "phrases"]
    return x[:, [COLUMNS.index(n) for n in names]].sum(axis=1) == 0


def held_out_quality(x: np.ndarray, y: np.ndarray, fold: np.ndarray, threshold: float = THRESHOLD) -> dict[str, float]:
    """Recall and precision on verdicts the model has not seen, with and without those taken as wrong."""
    score = held_out_scores(x, y, fold)
    found = calibrated(score, y).predict(score) >= threshold
    wrong = (y == 1) & without_evidence(x)
    hits = int((found & (y == 1)).sum())
    ratio = lambda a, b: float(a / b) if b else float("nan")
    return {"marked": int((y == 1).sum()), "found": int(found.sum()), "hits": hits, "set_apart": int(wrong.sum()), "precision": ratio(hits, found.sum()),
            "recall": ratio(hits, (y == 1).sum()), "recall_apart": ratio((found & (y == 1) & ~wrong).sum(), ((y == 1) & ~wrong).sum())}


def true_share(p: np.ndarray, n: np.ndarray, fitted_share: float, rounds: int = 200) -> float:
    """Share of offensive documents among all, from counts ``n`` of their probabilities ``p`` among the reviewed (expectation maximisation)."""
    if not n.sum():
        return fitted_share
    share = fitted_share
    for _ in range(rounds):
        up, down = share / fitted_share, (1 - share) / (1 - fitted_share)
        share = float(np.clip((n * (p * up / (p * up + (1 - p) * down))).sum() / n.sum(), 1e-4, 1 - 1e-4))
    return share


def score_documents(documents: DataFrame, model: OffensiveModel, *keep: str) -> DataFrame:
    """(doc_id, *keep, score, offensive) of every document.

    Every text is read once; the share of offensive documents comes from a
    histogram of all scores, a thousand counts.
    """
    columns = ["doc_id", *keep]
    source = spread(documents.filter("doc_id is not null").select(*columns, "text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*columns).schema) + ", score double"
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = _texts(part)
            for i, j in _batches(texts):
                yield part[columns].iloc[i:j].assign(score=shared.value.reviewed_probability(texts[i:j]))

    scored = cut(source.mapInPandas(run, schema))
    bins = scored.groupBy(F.floor(F.col("score") * 1000).alias("bin")).agg(F.avg("score").alias("p"), F.count("*").alias("n")).collect()
    model.share = true_share(np.array([r["p"] for r in bins]), np.array([r["n"] for r in bins], float), model.fitted_share)
    up, down = F.lit(model.share / model.fitted_share), F.lit((1 - model.share) / (1 - model.fitted_share))
    p = F.col("score")
    scored = scored.withColumn("score", p * up / (p * up + (1 - p) * down))
    return scored.withColumn("offensive", F.col("score") >= model.threshold)


def _batches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with together no more than a million characters, but for a single longer one."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and size + n > 1_000_000:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def source_rates(scored: DataFrame) -> DataFrame:
    """Documents, offensive ones, their share and the mean score per source."""
    return scored.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.count_if("offensive").alias("n_offensive"),
        F.avg(F.col("offensive").cast("int")).alias("offensive_rate"), F.avg("score").alias("mean_score"),
    )
