"""Toxicity scores after noisy-channel deobfuscation.

Channel: a writer hides a word by signs that look like letters, by blanks or signs between its letters or between pieces of
any length, and by letters repeated. A suspicious stretch is turned into a lattice of what each place may stand for, and Viterbi's algorithm finds the
reading of least cost under a character trigram model, which is counted over all documents. Words of letters alone, none
of them doubled and without a sign at either end that may be a letter, are their own only reading, so they skip the search. The restored words (and the stretch's own) are then scored: a word's weight is the lower bound of
the log odds (less some standard errors) that it, or its first 4, 5 or 6 letters, occur in toxic rather than in other training texts; a document's
score is a logistic function of its largest weight and of its number of weighted words, fitted with every training text's
own counts left out. How many standard errors: the most of ERRORS whose loss over the training texts, scored in that way, is within one
standard error of the least.

Scoring follows each beginning of a weighted word from piece to piece, with all readings of signs at once. Where one goes on beyond
the piece in which it began, every stretch from there on is searched, as far as the longest weighted word reaches. White space of
any kind and length is one blank. Learning takes words of tokens and of stretches of pieces of up to PIECE letters.

Training reads a bounded sample: the first FIT_TOXIC toxic and FIT_CLEAN other texts in order of a hash of the id.

Defined results: a text without words (null, empty) has the score of no evidence; without training rows
every score is 0; an empty table gives no rows; a label that is null is no label; an id that has both labels counts as both; a row without doc_id isn't held
out and has no label; a score equal to the threshold is predicted 1; very long texts are read whole; repeated rows score alike and are learned from once; texts that
share an id are all candidates, and the sample stays within its bound; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, first_by_hash, id_crc, ready, slices, table, written

FIT_TOXIC, FIT_CLEAN = 2500, 5000
#: Weights below this aren't kept.
LEAST = 1.0
#: Standard errors that may be taken off a weight; training texts choose among them.
ERRORS = (1.5, 2.0, 2.5, 3.0)
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
REMEMBERED = 400_000
# fixed values: the signs that are read as letters
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou"}
_LEET_COST, _DROP_COST, _REPEAT_COST, _BREAK_COST = 0.7, 0.3, 0.3, 0.7
_EDGE = " .,;:!?\"'()[]{}<>-_*~`|/\\&%#=+…“”„«»‘’¡¿"
_NO_LETTER = "".join(c for c in _EDGE if c not in LEET)
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*~]{1,2}[^\W_@$!]){2,}(?![^\W_])")
#: Stretches of short pieces, from which words are learned; those of single letters lie within them.
PIECE = 4
_PIECES = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+(€]){1,%d}(?:[ .\-_*~]{1,2}(?:[^\W_]|[@$!|+(€]){1,%d})+(?![^\W_])" % (PIECE, PIECE))
_PART = re.compile(r"(?:[^\W_]|[@$!|+(€])+")
#: Stretches of pieces of any length.
_STRETCH = re.compile(r"(?:[^\W_]|[@$!|+(€])+(?:[ .\-_*~]{1,2}(?:[^\W_]|[@$!|+(€])+)+")
_GAP, _MOST_GAP, _SIGNS = " .-_*~", 2, "@$!|+(€"
_START = frozenset([""])
#: Least number of letters (without repetitions) that stretches are searched for before their last piece.
REACH = 12
#: Longer stretches hardly ever return, so that their readings aren't kept.
_KEPT = 16
_DOUBLED = re.compile(r"([^\W\d_])\1")
_HIDDEN = re.compile(r"[^\W\d_]")
_RUN_OF_ONE = re.compile(r"(.)\1+")
_LETTERS = re.compile(r"[^\W\d_]+")
_SIGN = re.compile("[" + re.escape("".join(LEET)) + "]")
SYMBOLS = 64
_symbols: list[np.ndarray] = []


def _symbol_table() -> np.ndarray:
    """0: no letter; 1 to 26: a to z; 27 to 63: the other letters, by remainder."""
    if not _symbols:
        t = np.fromiter((27 + i % 37 if chr(i).isalpha() else 0 for i in range(0x110000)), np.uint8, 0x110000)
        t[97:123] = np.arange(1, 27)
        _symbols.append(t)
    return _symbols[0]


def trigrams(text: str, piece: int = 1 << 20) -> Iterator[np.ndarray]:
    """a * 64² + b * 64 + c of each place, piece by piece; what stands before a word is one sign."""
    text = f"  {text.lower()} "
    for i in range(0, len(text) - 2, piece):
        s = _symbol_table()[np.frombuffer(text[i : i + piece + 2].encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        a, b, c = s[:-2], s[1:-1], s[2:]
        yield np.where(b == 0, 0, a) * SYMBOLS**2 + b * SYMBOLS + c


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Over all whole texts: each task sums its own, Spark adds these up; 64³ numbers at most reach the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in slices(texts):
                for numbers in trigrams("   ".join([t or "" for t in texts[lo:hi]])):
                    total += np.bincount(numbers, minlength=SYMBOLS**3)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "n"])

    out = np.zeros(SYMBOLS**3)
    for r in docs.select(col(docs, "text").alias("text")).mapInArrow(counted, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r.k] = r.n
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b), smoothed by P(c | b) and by evenness."""
    n3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    n2 = n3.sum(0)
    p1 = (n2.sum(0) + 1) / (n2.sum() + SYMBOLS)
    p2 = (n2 + 20 * p1) / (n2.sum(1, keepdims=True) + 20)
    return -np.log((n3 + 5 * p2) / (n3.sum(2, keepdims=True) + 5)).astype(np.float32)


def lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """For each place of a lower-case stretch what it may stand for, with the channel's cost."""
    out, i = [], 0
    while i < len(stretch):
        c, j = stretch[i], i + 1
        if c.isalpha():
            while j < len(stretch) and stretch[j] == c:
                j += 1
            n = j - i
            out.append([(c * n, 0.0)] if n == 1 else [(c, _REPEAT_COST), (c * 2, 0.0 if n == 2 else _REPEAT_COST)])
        elif c in LEET:
            out.append([(x, _LEET_COST) for x in LEET[c]] + [(" ", _BREAK_COST), ("", _DROP_COST + 1.0)])
        else:
            out.append([("", _DROP_COST), (" ", _BREAK_COST)])
        i = j
    return out


def best_reading(stretch: str, costs: list[float]) -> str:
    """The reading of least cost; of equal ones the first in order of the lattice's choices. costs: the language model, row by row.
    States hold a link to what was said before, so that time and memory grow as the stretch does."""
    live: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for choices in [*lattice(stretch), [(" ", 0.0)]]:
        after: dict[int, tuple[float, tuple | None]] = {}
        for what, channel in choices:
            symbols = [_symbol(c) for c in what]
            for state, (cost, said) in live.items():
                total = cost + channel
                for s in symbols:
                    if s:
                        total += costs[state << 6 | s]
                        state = (state << 6 | s) & 4095
                    else:
                        if state & 63:  # a second blank changes nothing
                            total += costs[state << 6]
                        state = 0
                best = after.get(state)
                if best is None or total < best[0]:
                    after[state] = (total, (said, what) if what else said)
        live = after
    (_, link), out = live[0], []
    while link is not None:
        link, what = link
        out.append(what)
    return "".join(reversed(out))


@cache
def _symbol(c: str) -> int:
    return int(_symbol_table()[ord(c)])


def viterbi(stretch: str, lm: np.ndarray) -> str:
    return best_reading(stretch, lm.ravel().tolist())


@dataclass
class Restorer:
    """Restored words of tokens and texts."""

    lm: np.ndarray
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)
    stretches: dict[str, list[str]] = field(default_factory=dict)
    gaps: dict[tuple[str, int, str], bool] = field(default_factory=dict)

    def __post_init__(self):
        self.costs: list[float] = self.lm.ravel().tolist()

    def token(self, token: str) -> tuple[str, ...]:
        """token: lower case, without blanks."""
        bare = token.strip(_EDGE)
        if self._settled(bare) and token.strip(_NO_LETTER) == bare:
            return (bare,)
        if not _HIDDEN.search(token):
            return ()
        words = [w for w in re.split(r"[^\w]+|[\d_]+", bare) if w]
        whole = token.strip(" .,;:?\"'")
        for stretch in dict.fromkeys((whole.rstrip("!"), whole)):  # a last ! may be an i
            if not self._settled(stretch):
                words += best_reading(stretch, self.costs).split()
        return tuple(dict.fromkeys(words))

    @staticmethod
    def _settled(word: str) -> bool:
        return word.isalpha() and not _DOUBLED.search(word)

    def pieces(self, run: str) -> set[str]:
        """Words of a stretch of short pieces besides its plain pieces, which are words of tokens anyhow: as a whole, of the single
        letters in it, and of every two and three pieces, as the best reading of the whole may join a word with its neighbours."""
        spans = [m.span() for m in _PART.finditer(run)]
        said = [run[a:b] for a, b in spans]
        plain = [len(p) > 1 and self._settled(p) for p in said]
        if all(plain) and "*" not in run:
            for i in range(len(said) - 1):
                a, b = spans[i][1], spans[i + 1][0]
                if self._joins(run[a - 2 : a], b - a, run[b : b + 2]):
                    break
            else:  # each gap stays one
                return set()
        out: set[str] = set()
        for n in {2, 3, len(said)}:
            for i in range(len(said) - n + 1):
                out.update(self._words_of(run, spans, said, plain, i, i + n - 1))
        if not all(plain):
            for m in _SPACED.finditer(run):
                out.update(self._reading(m[0]))
        return out.difference(p for p, alone in zip(said, plain, strict=True) if alone)

    def _words_of(self, run: str, spans: list, said: list[str], plain: list[bool], i: int, j: int) -> list[str]:
        """The best reading of pieces i to j. A plain piece (two letters or more with only one reading) fixes the model's state, so what
        lies between two of them is read on its own, and the readings are put together at the pieces that they share."""
        points = [i, *(k for k in range(i + 1, j) if plain[k]), j]
        words: list[str] = []
        for p, q in zip(points, points[1:], strict=False):
            a, b = spans[p][1], spans[p + 1][0]
            if q == p + 1 and plain[p] and plain[q] and "*" not in run[a:b]:
                got = [said[p] + said[q]] if self._joins(run[a - 2 : a], b - a, run[b : b + 2]) else [said[p], said[q]]
            else:
                got = self._reading(run[spans[p][0] : spans[q][1]])
            if words and plain[p]:
                words[-1] += got[0][len(said[p]) :]
                words += got[1:]
            else:
                words += got
        return words

    def _reading(self, stretch: str) -> list[str]:
        if (got := self.stretches.get(stretch)) is None:
            got = best_reading(stretch, self.costs).split()
            if len(stretch) <= _KEPT:
                if len(self.stretches) >= REMEMBERED:
                    self.stretches.clear()
                self.stretches[stretch] = got
        return got

    def windows(self, text: str, reach: int, border: int | None = None) -> set[str]:
        """Words of all stretches of two neighbouring pieces or more that have fewer than reach letters before the last one and, if there
        is a border, lie on both sides of it. A piece with only one reading that stays apart from what is before it ends the search, as
        nothing that follows changes that."""
        out: set[str] = set()
        for run in _STRETCH.finditer(text):
            spans = [m.span() for m in _PART.finditer(text, *run.span())]
            sizes = [len(once(text[a:b])) for a, b in spans]
            apart = [False, *(self.apart(text[a:b], text[b:c], text[c:d]) for (a, b), (c, d) in zip(spans, spans[1:], strict=False))]
            for i in range(len(spans) - 1):
                if border is not None and spans[i][0] >= border:
                    break
                before = sizes[i]
                for j in range(i + 1, len(spans)):
                    if before >= reach or apart[j]:
                        break
                    if border is None or spans[j][0] >= border:
                        words, last = self._reading(text[spans[i][0] : spans[j][1]]), text[slice(*spans[j])]
                        out.update(words)
                        if words and words[-1] == last and len(last) > 1 and self._settled(last):
                            break
                    before += sizes[j]
        return out

    def apart(self, left: str, gap: str, right: str) -> bool:
        """Whether two pieces that have only one reading each stay apart, whatever stands around them."""
        if len(left) < 2 or len(right) < 2 or "*" in gap or not (self._settled(left) and self._settled(right)):
            return False
        return not self._joins(left[-2:], len(gap), right[:2])

    def _joins(self, left: str, n: int, right: str) -> bool:
        if (got := self.gaps.get((left, n, right))) is None:
            a, b = (_symbol(left[0]) << 6 | _symbol(left[1])), _symbol(right[0])
            to = _symbol(right[1])
            c = self.costs
            joined = n * _DROP_COST + c[a << 6 | b] + c[(a & 63) << 12 | b << 6 | to]
            apart = _BREAK_COST + (n - 1) * _DROP_COST + c[a << 6] + c[b] + c[b << 6 | to]
            got = self.gaps[left, n, right] = joined < apart
        return got

    def words(self, text: str | None) -> set[str]:
        """Restored words of a text: of its tokens and of stretches of short pieces."""
        text = (text or "").lower()
        out: set[str] = set()
        for t in set(text.split()):
            if (got := self.known.get(t)) is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                    self.gaps.clear()
                got = self.known[t] = self.token(t)
            out.update(got)
        for run in {m[0] for m in _PIECES.finditer(text)}:
            out.update(self.pieces(run))
        return out


def keys(word: str) -> list[str]:
    return [word, *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) >= n)]


def _weight(t: Column, c: Column, n_t: Column, n_c: Column, errors: float) -> Column:
    """Log odds of occurring in toxic texts, less some standard errors."""
    return F.log((t + 0.5) / (n_t + 1)) - F.log((c + 0.5) / (n_c + 1)) - errors * F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))


def once(letters: str) -> str:
    """Letters without repetition: all readings of letters that may be doubled have the same."""
    return _RUN_OF_ONE.sub(r"\1", letters) if _DOUBLED.search(letters) else letters


@dataclass
class Model:
    """Lexicon and logistic function. What has no reading with a weighted word is told beforehand (may) and isn't searched."""

    lm: np.ndarray
    lexicon: dict[str, float]
    beta: tuple[float, float, float] | None
    errors: float = 0.0

    def __post_init__(self):
        self._whole: dict[str, float] = {}
        self._starts: dict[int, dict[str, float]] = {n: {} for n in PREFIXES}
        begins: dict[int, set[str]] = {n: set() for n in range(1, 7)}
        self._short: set[str] = set()
        for k, w in self.lexicon.items():
            n, _, start = k.partition(":")
            word = start or n
            if start:
                self._starts[int(n)][start] = w
            else:
                self._whole[k] = w
            bare = once(word)
            if start or len(bare) >= 6:
                begins[len(bare[:6])].add(bare[:6])
            else:
                self._short.add(bare)
        self._begins = [(n, some) for n, some in begins.items() if some]
        # beginnings that have a weight of their own, and whole words
        self._full = frozenset([*(once(x) for some in self._starts.values() for x in some), *(x for w in self._whole if len(x := once(w)) >= 6)])
        self._nodes = frozenset(x[:n] for x in self._full | self._short for n in range(1, len(x) + 1))
        self._reach = max([REACH, *map(len, self._whole)])
        # tokens already searched, the weighted words of those that have any, and what is begun at the end of a token
        self._tokens: set[str] = set()
        self._of_token: dict[str, tuple] = {}
        self._open: dict[str, tuple[frozenset[str], int]] = {}
        # neighbours in which a beginning ends, and in which one goes on
        self._ended: set[tuple[str, str]] = set()
        self._led: set[tuple[str, str]] = set()
        self._of_stretch: dict[str, tuple] = {}
        self._restorer: Restorer | None = None

    def word_weight(self, word: str) -> float:
        p = self._starts
        return max(self._whole.get(word, 0.0), p[4].get(word[:4], 0.0), p[5].get(word[:5], 0.0), p[6].get(word[:6], 0.0))

    def token_weights(self, words) -> tuple[tuple[str, float], ...]:
        return tuple((w, x) for w in words if (x := self.word_weight(w)) > 0)

    def may(self, stretch: str) -> bool:
        """Whether any reading may have a weighted word: always if signs stand for letters; else words are what follows from one letter
        group on, with the next ones joined or not, so that their beginnings (without repetitions) are compared."""
        if _SIGN.search(stretch):
            return True
        groups = _LETTERS.findall(stretch)
        return any(self._may_begin(groups, i) for i in range(len(groups)))

    def _follow(self, signs: str, over: frozenset[str], gap: int, fresh: bool) -> tuple[bool, frozenset[str], int]:
        """All readings of signs at once. over: beginnings of weighted words (without repetitions) that come from earlier pieces, after
        gap signs without a piece. fresh: whether words may begin here, too. -> whether a weighted word may have been said over a gap,
        what is begun and how many signs follow the last piece."""
        here: frozenset[str] = frozenset()
        reached = False
        for c in signs:
            if not fresh and (reached or not over):  # nothing more to learn
                break
            piece = c.isalnum() or c in _SIGNS
            if piece:
                if gap and fresh:
                    here = _START
                gap = 0
            else:
                gap = gap + 1 if c in _GAP else _MOST_GAP + 1
                over, here = over | (here - _START), frozenset()
            if not c.isalpha():  # it may be a break, at which a word of few letters ends
                reached = reached or not over.isdisjoint(self._short)
                if gap > _MOST_GAP:
                    over = frozenset()
            letters = c if c.isalpha() else LEET.get(c, "")
            if letters and over:
                on = self._step(over, letters)
                reached = reached or not on.isdisjoint(self._full)
                over = on if c.isalpha() else over | on
            if piece and (here or fresh):
                on = self._step(here, letters)
                here = on if c.isalpha() else here | on | (_START if fresh else frozenset())
        return reached, over | (here - _START), gap

    def _step(self, begun: frozenset[str], letters: str) -> frozenset[str]:
        return frozenset(x for b in begun for c in letters if (x := b if b.endswith(c) else b + c) in self._nodes)

    def _token(self, t: str, r: Restorer) -> None:
        got = self.token_weights(r.token(t)) if self.may(t) else ()
        word = t[:-1] if t[-1] in _GAP and t[-1] not in LEET else t
        if word.isalpha():  # the only beginning is the word itself
            begun = once(word)
            reached, over, gap = False, frozenset([begun]) if begun in self._nodes else frozenset(), 1 + len(t) - len(word)
        else:
            reached, over, gap = self._follow(t + " ", frozenset(), 1, True)
        if reached:
            got += self.token_weights(r.windows(t, self._reach))
        if got:
            self._of_token[t] = got
        if over:
            self._open[t] = over, gap

    def _stay(self, t: str, after: str, r: Restorer) -> bool:
        """Whether the last piece of a token and the first of the next one stay apart."""
        left, right = self._last(t), self._first(after)
        return bool(left and right) and r.apart(left[0], left[1] + " " + right[1], right[0])

    @staticmethod
    def _last(t: str) -> tuple[str, str] | None:
        """The last piece of a token and what follows it."""
        if t.isalpha():
            return t, ""
        said = _PART.findall(t)
        return (said[-1], t[t.rindex(said[-1]) + len(said[-1]) :]) if said else None

    @staticmethod
    def _first(t: str) -> tuple[str, str] | None:
        """The first piece of a token and what is before it."""
        if t.isalpha():
            return t, ""
        m = _PART.search(t)
        return (m[0], t[: m.start()]) if m else None

    def _leads(self, t: str, after: str, r: Restorer) -> bool:
        if self._stay(t, after, r):
            return False
        reached, over, _ = self._follow(after + " ", *self._open[t], False)
        return reached or bool(over)

    def _joined(self, tokens: list[str], i: int, r: Restorer) -> tuple[tuple[str, float], ...]:
        """Weighted words that begin in token i and end in a later one."""
        (over, gap), reached, k, size = self._open[tokens[i]], False, i + 1, 0
        while k < len(tokens) and size < self._reach and (over or reached):
            pieces = "".join(_PART.findall(tokens[k]))
            hit, over, gap = self._follow(tokens[k] + " ", over, gap, False)
            reached, size, k = reached or hit, size + len(once(pieces)), k + 1
            if not pieces and not over or pieces and k < len(tokens) and self._stay(tokens[k - 1], tokens[k], r):
                break
        if not reached:
            return ()
        stretch = " ".join(tokens[i:k])
        if (got := self._of_stretch.get(stretch)) is None:
            got = self._of_stretch[stretch] = self.token_weights(r.windows(stretch, self._reach, len(tokens[i])))
        return got

    def _may_begin(self, groups: list[str], i: int) -> bool:
        said, j = once(groups[i]), i + 1
        while j < len(groups) and len(said) < 6:
            if said in self._short:
                return True
            said, j = once(said + groups[j]), j + 1
        return said in self._short or any(said[:n] in some for n, some in self._begins)

    def score(self, text: str | None) -> float:
        if self.beta is None:
            return 0.0
        hits, b = self.hits(text), self.beta
        top = max(hits.values(), default=0.0)
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, b[0] + b[1] * top + b[2] * math.log1p(len(hits))))))

    def hits(self, text: str | None) -> dict[str, float]:
        """Weighted words of the readings of a text."""
        r = self._restorer = self._restorer or Restorer(self.lm)
        text = (text or "").lower()
        hits: dict[str, float] = {}
        said, known = text.split(), self._tokens
        tokens = set(said)
        for t in tokens.difference(known):
            self._token(t, r)
            known.add(t)
        for t in self._of_token.keys() & tokens:
            hits.update(self._of_token[t])
        if opened := self._open.keys() & tokens:
            pairs = {p for p in zip(said, said[1:], strict=False) if p[0] in opened}
            for p in pairs.difference(self._ended, self._led):
                (self._led if self._leads(*p, r) else self._ended).add(p)
            if led := pairs & self._led:
                for i, p in enumerate(zip(said, said[1:], strict=False)):
                    if p in led:
                        hits.update(self._joined(said, i, r))
        if len(known) + len(self._ended) + len(self._led) + len(self._of_stretch) > 2 * REMEMBERED:
            for x in (known, self._of_token, self._open, self._ended, self._led, self._of_stretch):
                x.clear()
        return hits


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Newton's method; x with a column of ones first."""
    b = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = FIT_TOXIC, most_clean: int = FIT_CLEAN) -> Model:
    """docs: all documents, for the language model; labels (doc_id, toxic): those to learn from."""
    spark = ready(docs.sparkSession)
    lm = language_model(count_trigrams(docs))
    known = labels.select(col(labels, "doc_id").alias("doc_id"), col(labels, "toxic").cast("int").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    ids = docs.select(col(docs, "doc_id").alias("doc_id")).where("doc_id IS NOT NULL")
    most = F.when(F.col("toxic") == 1, most_toxic).otherwise(most_clean)
    picked = first_by_hash(known.join(ids, "doc_id", "left_semi"), "toxic", "doc_id", most).drop("turn")
    shared = spark.sparkContext.broadcast(lm)

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array([sorted(r.words(t.as_py())) for t in b.column("text")], pa.list_(pa.string()))], ["doc_id", "toxic", "words"])

    texts = docs.select(col(docs, "doc_id").alias("doc_id"), col(docs, "text").alias("text")).join(F.broadcast(picked), "doc_id").select(F.col("doc_id").cast("string"), "toxic", "text").distinct()
    rows = written(texts.mapInArrow(restored, "doc_id string, toxic int, words array<string>").withColumn("row", F.monotonically_increasing_id()), "toxic-words")
    number = (F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0)).alias("c"))
    n = rows.agg(*number).first()
    if n.t > most_toxic or n.c > most_clean:  # texts that share an id may be more than were picked
        order = (F.xxhash64("doc_id", "words"), "doc_id", "words", "row")
        rows = written(rows.where("toxic = 1").orderBy(*order).limit(most_toxic).unionByName(rows.where("toxic = 0").orderBy(*order).limit(most_clean)), "toxic-rows")
        n = rows.agg(*number).first()
    if not n.t or not n.c:
        return Model(lm, {}, None)
    prefixes = [F.when(F.length("word") >= k, F.concat(F.lit(f"{k}:"), F.substring("word", 1, k))) for k in PREFIXES]
    said = rows.select("row", "toxic", F.explode("words").alias("word")).select("row", "toxic", "word", F.explode(F.array(F.col("word"), *prefixes)).alias("key")).where("key IS NOT NULL")
    counts = said.select("row", "toxic", "key").distinct().groupBy("key").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where("t >= 2")
    # a word's weights for a training text leave out that text's own counts: words that have one only then are needed for that, too
    most = _weight(F.col("t"), F.greatest(F.col("c") - 1, F.lit(0)), F.lit(n.t), F.lit(n.c), ERRORS[0])
    counts = written(counts.where(most > LEAST), "toxic-lexicon")
    own = [_weight(F.col("t") - F.col("toxic"), F.col("c") - 1 + F.col("toxic"), F.lit(n.t) - F.col("toxic"), F.lit(n.c) - 1 + F.col("toxic"), e) for e in ERRORS]
    names = [f"own{i}" for i in range(len(ERRORS))]
    per_word = said.join(F.broadcast(counts), "key").withColumns(dict(zip(names, own, strict=True))).groupBy("row", "word").agg(*[F.max(x).alias(x) for x in names])
    evidence = per_word.groupBy("row").agg(*[F.max(F.when(F.col(x) > LEAST, F.col(x))).alias(f"top{i}") for i, x in enumerate(names)], *[F.count_if(F.col(x) > LEAST).alias(f"n{i}") for i, x in enumerate(names)])
    seen = [F.coalesce(f"{x}{i}", F.lit(0.0)) for i in range(len(ERRORS)) for x in ("top", "n")]
    a = np.array(rows.select("row", "toxic").join(evidence, "row", "left").orderBy("row").select("toxic", *seen).collect(), float)
    fits = [_fitted(a[:, 0], a[:, 1 + 2 * i], a[:, 2 + 2 * i]) for i in range(len(ERRORS))]
    least = min(fits, key=lambda f: f[0])
    best = max(i for i, f in enumerate(fits) if f[0] <= least[0] + least[1])
    weight = _weight(F.col("t"), F.col("c"), F.lit(n.t), F.lit(n.c), ERRORS[best])
    lexicon = {r.key: r.weight for r in counts.withColumn("weight", weight).where(F.col("weight") > LEAST).orderBy("key").collect()}
    return Model(lm, lexicon, fits[best][2], ERRORS[best])


def _fitted(y: np.ndarray, top: np.ndarray, n: np.ndarray) -> tuple[float, float, tuple[float, ...]]:
    """Mean loss of the training texts (both labels at even weight), its standard error, and the logistic function."""
    x = np.column_stack([np.ones(len(y)), top, np.log1p(n)])
    beta = logistic(x, y)
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
    loss = -np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-9, 1))
    parts = [loss[y == k] for k in (0, 1)]
    return float(sum(x.mean() for x in parts)), float(sum(x.var() / len(x) for x in parts) ** 0.5), tuple(beta.tolist())


def toxicity(text: Column, model: Model, spark: SparkSession) -> Column:
    shared = ready(spark).sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([shared.value.score(t) for t in s.tolist()], dtype="float64")

    return scored(text)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(id_crc(F.col("doc_id")) % 4 == 2, F.lit(False))
    model = train(docs, labels.where(~held_out))
    out = docs.select("doc_id", held_out.alias("held_out"), toxicity(F.col("text"), model, spark).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


SQL: dict[str, str] = {}
QUERIES = {"op3_toxicity": op3_toxicity}
