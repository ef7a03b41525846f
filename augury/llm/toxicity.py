"""Toxicity through a noisy channel.

1. Language model: character 4-grams of *all* texts are counted in tasks, summed in Spark and smoothed into
   one table of log-probabilities (at most 45**4 entries, 16 MB, whatever the corpus size).
2. Decoding: a token that holds digits or symbols between letters, or a letter three times or more, and a run
   of three or more single characters, becomes a lattice: leet characters may stand for letters, separators
   may be noise or word ends, repeats may be shortened. Viterbi finds the likeliest reading under the model.
   A plain word has one reading, so its lattice needs no search.
3. Scoring: words of the restored text are looked up by themselves and by their character n-grams (4 to 6,
   ends marked) among weights learned from a bounded labelled sample, where features are taken one by one to
   explain toxic documents that none before explains. A logistic function of a text's two worst words, fitted
   on scores from the other half of the sample, gives the probability.

Every text is read whole, in tasks, with no shuffle but the sums of 1. Distinct tokens of a task are decoded
and scored once.

Rows: null and empty texts have no words and get the score of such a text; very long texts and tokens are
read whole (the search is linear in their length); without labels of both classes every score is the share of
label 1 (0.0 where there are no labels).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, labelled_sample, slices

#: Symbols of the language model: 0 ends a word, 1-26 are a-z, the others share 18.
SYMBOLS = 45
TOKEN_ENTRIES = 400_000
#: Lengths of the character n-grams of a word.
GRAMS = (4, 5, 6)
#: Letters that a character may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l"}
VOWELS = "aeiou"
_ENDS = " \t\r\n.,;:!?\"'()[]{}<>/\\-_*#%&^~`=|"
_SYMBOL_TAIL = re.compile(r"([^\w\s])\1{2,}$")
_THRICE = re.compile(r"(.)\1\1")
_RUN = re.compile(r"(.)\1*", re.S)
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")


def _symbols() -> np.ndarray:
    ids = np.zeros(0x10000, np.uint8)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            ids[c] = c - 96 if 97 <= c <= 122 else 27 + c % (SYMBOLS - 27)
    return ids


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def count_characters(docs: DataFrame, *, text_col: str = "text") -> np.ndarray:
    """Counts of character 4-grams of all texts, words parted by one end mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, total, waiting, n = _symbols(), np.zeros(SYMBOLS**4, np.int64), [], 0
        for part in slices(batches):
            text = " " + " ".join(t for t in part.column(0).to_pylist() if t).lower() + " "
            s = ids[np.minimum(_points(text), 0xFFFF)]
            s = s[np.concatenate([[True], (s[1:] > 0) | (s[:-1] > 0)])].astype(np.int32)
            if len(s) > 3:
                waiting.append(((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:])
                n += len(waiting[-1])
            if n > 4_000_000:
                total += np.bincount(np.concatenate(waiting), minlength=SYMBOLS**4)
                waiting, n = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=SYMBOLS**4)
        seen = np.flatnonzero(total)
        for i in range(0, len(seen), 20_000):
            part = seen[i:i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part])], names=["gram", "n"])

    counted = docs.select(text_col).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(SYMBOLS**4)
    found = counted.toArrow()  # at most SYMBOLS**4 rows
    counts[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return counts


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Interpolated: of a symbol after three, two, one and none."""
    four = counts.reshape((SYMBOLS,) * 4)
    three = four.sum(0)
    two = three.sum(0)
    one = two.sum(0)
    share = lambda x: x / np.maximum(x.sum(-1, keepdims=True), 1)
    p = 0.72 * share(four) + (0.18 * share(three))[None] + (0.07 * share(two))[None, None]
    p += (0.02 * one / max(one.sum(), 1) + 0.01 / SYMBOLS)[None, None, None]
    return np.log(p).astype(np.float32).ravel()


class Decoder:
    """Viterbi search through the lattice of one token or spaced run."""

    def __init__(self, logs: np.ndarray):
        self.logs, self.ids = memoryview(np.ascontiguousarray(logs)), _symbols()

    @staticmethod
    def options(char: str, run: int, spaced: bool) -> list[tuple[str, float]]:
        """What was meant by a character that stands run times in a row: strings and their log costs."""
        if char.isalpha():
            return [(char, 0.0)] if run == 1 else [(char * 2, 0.0), (char, -1.5)] if run == 2 else [(char, -0.5), (char * 2, -1.0)]
        if char.isspace():
            return [("", -0.5), (" ", 0.0)] if spaced else [(" ", 0.0)]
        got = [("", -1.5), (" ", -1.0)] if not char.isdigit() else [("", -4.0), (" ", -3.0)]
        for letter in LEET.get(char, ""):
            got += [(letter, -1.0)] + [(letter * 2, -1.2)] * (run > 1)
        if char == "*":
            got += [(v, -3.0) for v in VOWELS]
        return got

    def __call__(self, token: str, spaced: bool = False) -> str:
        logs, ids, n3 = self.logs, self.ids, SYMBOLS**3
        best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}  # last three symbols -> score and way there
        for m in _RUN.finditer(token):
            new: dict[int, tuple[float, tuple]] = {}
            for text, cost in self.options(m[1], len(m[0]), spaced):
                for state, (score, way) in best.items():
                    at, total = state, score + cost
                    for c in text:
                        s = int(ids[ord(c)]) if ord(c) < 0x10000 else 0
                        if s or at % SYMBOLS:
                            total += logs[at * SYMBOLS + s]
                            at = (at * SYMBOLS + s) % n3
                    if at not in new or total > new[at][0]:
                        new[at] = (total, (way, text) if text else way)
            best = new
        way = max((score + (logs[at * SYMBOLS] if at % SYMBOLS else 0.0), way) for at, (score, way) in best.items())[1]
        out = []
        while way:
            way, text = way
            out.append(text)
        return "".join(reversed(out))


class Restorer:
    """Tokens and texts as they were meant."""

    def __init__(self, logs: np.ndarray):
        self.decode = Decoder(logs)

    def token(self, token: str) -> str:
        """token: lower case, without white space."""
        core = _SYMBOL_TAIL.sub("", token).strip(_ENDS)
        if core.isalpha():
            return core if _THRICE.search(core) is None else self.decode(core)
        return self.decode(core).strip() if any(map(str.isalpha, core)) else ""

    def runs(self, text: str) -> list[str]:
        """The spaced runs of a lower-case text, restored."""
        return [self.decode(m[0], spaced=True) for m in _SPACED.finditer(text)]

    def text(self, text: str) -> str:
        text = _SPACED.sub(lambda m: self.decode(m[0], spaced=True), text.lower())
        return " ".join(filter(None, map(self.token, text.split())))


def spaced(texts: list[str]) -> list[bool]:
    """Which texts may hold three single characters in a row."""
    points = _points("\n\n".join(texts) + "\n\n\n\n\n\n")
    gap = points <= 32
    single = np.zeros(len(points), bool)
    single[1:-1] = ~gap[1:-1] & gap[:-2] & gap[2:]
    single[0] = not gap[0] and bool(gap[1])
    starts = np.flatnonzero(single[:-4] & single[2:-2] & single[4:])
    ends = np.cumsum([len(t) + 2 for t in texts])
    got = [False] * len(texts)
    for i in set(np.searchsorted(ends, starts, side="right").tolist()):
        if i < len(got):
            got[i] = True
    return got


def features(word: str) -> set[str]:
    m = f"<{word}>"
    return {m, *(m[i:i + n] for n in GRAMS for i in range(len(m) - n + 1))}


class Model:
    """logs: the language model; weights: of features; fit: of the two worst words and the bias."""

    def __init__(self, logs: np.ndarray, weights: dict[str, float], fit: tuple[float, float, float]):
        self.logs, self.weights, self.fit = logs, weights, fit


class Scorer:
    def __init__(self, model: Model):
        self.model, self.restore, self.tokens = model, Restorer(model.logs), {}

    def fill(self, tokens: list[str]) -> None:
        """Scores of new tokens: the highest weight of a feature of their restored words. All are laid end to
        end, where each feature is sought at once."""
        cores = [t if t.isalpha() else t.strip(_ENDS) for t in tokens]
        laid = "<" + "><".join(cores) + ">"
        starts = np.cumsum([0, *(len(c) + 2 for c in cores)])
        owner = lambda at: np.searchsorted(starts, at, side="right") - 1
        points = _points(laid)
        odd = set(owner(np.flatnonzero((points[:-2] == points[1:-1]) & (points[1:-1] == points[2:]))).tolist())
        odd.update(i for i, c in enumerate(cores) if not c.isalpha())
        if odd:
            order = sorted(odd)
            for i in order:
                cores[i] = "><".join(self.restore.token(tokens[i]).split())
            laid = "<" + "><".join(cores) + ">"
            starts = np.cumsum([0, *(len(c) + 2 for c in cores)])
        best = np.zeros(len(tokens))
        for f, w in self.model.weights.items():
            found, i = [], laid.find(f)
            while i >= 0:
                found.append(i)
                i = laid.find(f, i + 1)
            if found:
                at = owner(found)
                best[at] = np.maximum(best[at], w)
        self.tokens.update(zip(tokens, best.tolist(), strict=True))

    def worst(self, texts: list[str]) -> list[tuple[float, float]]:
        """Of each text the highest scores of two different words."""
        low = [t.lower() for t in texts]
        words = [t.split() for t in low]
        runs = [[w for run in self.restore.runs(t) for w in run.split()] if s else [] for t, s in zip(low, spaced(low), strict=True)]
        if len(self.tokens) > TOKEN_ENTRIES:
            self.tokens.clear()
        known, got = self.tokens, []
        if new := [w for w in set().union(*words, *runs) if w not in known]:
            self.fill(new)
        for own, more in zip(words, runs, strict=True):
            own = own + more
            scores = list(map(known.__getitem__, own))
            if not any(scores):
                got.append((0.0, 0.0))
                continue
            top = sorted({w: s for w, s in zip(own, scores, strict=True) if s}.values(), reverse=True)
            got.append((top[0], top[1] if len(top) > 1 else 0.0))
        return got

    def __call__(self, texts: list[str]) -> list[float]:
        a, b, c = self.model.fit
        return [1 / (1 + math.exp(-min(700.0, max(-700.0, a * x + b * y + c)))) for x, y in self.worst(texts)]


def learn_weights(docs: list[tuple[np.ndarray, int]], vocabulary: list[str], *, caution: float = 1.5, support: int = 3, least: float = 0.8, explained: float = 0.3) -> dict[str, float]:
    """docs: places in the vocabulary of a document's features, and its label. A feature's weight is its log-odds of toxic over other documents less caution
    standard errors. Features are taken one by one, each time the one of highest weight where a toxic document
    that one taken before explains counts as ``explained`` documents only, so what merely stands beside a toxic
    word (copied passages, long texts) gets no weight. Ends when none has a weight of at least ``least`` and as
    much as ``support`` documents to explain."""
    toxic = [found for found, label in docs if label]
    counts = np.bincount(np.concatenate([*toxic, np.zeros(0, np.int32)]), minlength=len(vocabulary))
    kept = sorted(np.flatnonzero(counts >= support).tolist(), key=lambda f: (-len(vocabulary[f]), vocabulary[f]))  # of equals the longest
    if not kept:
        return {}
    names, place = [vocabulary[f] for f in kept], np.full(len(vocabulary), -1, np.int32)
    place[kept] = np.arange(len(kept))
    rows = [p[p >= 0] for p in (place[found] for found in toxic)]
    t, m = counts[kept].astype(float), np.zeros(len(names))
    for found, label in docs:
        if not label:
            p = place[found]
            m[p[p >= 0]] += 1
    odds = math.log((len(docs) - len(toxic) + 1) / (len(toxic) + 1))
    weight = lambda t: np.log((t + 0.5) / (m + 0.5)) + odds - caution * np.sqrt(1 / (t + 0.5) + 1 / (m + 0.5))
    full, left, open_, got = weight(t), t.copy(), set(range(len(toxic))), {}
    holders: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        for f in r.tolist():
            holders.setdefault(f, []).append(i)
    while True:
        w = np.where(left >= support, weight(np.maximum(left, 0)), -np.inf)
        best = int(w.argmax())
        if w[best] < least:
            break
        got[names[best]] = float(full[best])
        beside = np.bincount(np.concatenate([rows[i] for i in holders[best]]), minlength=len(names))
        left[beside >= 0.9 * t] = -np.inf  # stands in the same documents: a part of the same word, or beside it
        for i in holders[best]:
            if i in open_:
                left[rows[i]] -= 1 - explained
                open_.discard(i)
    return got


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[float, float, float]:
    """Newton's method; both classes count alike."""
    a = np.column_stack([x, np.ones(len(x))])
    weight, w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())), np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + ridge * 0.1 * w * [1, 1, 0]
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([ridge * 0.1, ridge * 0.1, 1e-6])
        w -= np.linalg.solve(hess, grad)
    return tuple(map(float, w))


def train(rows: list[tuple[str, int]], logs: np.ndarray) -> Model:
    y = np.array([label for _, label in rows])
    if len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return Model(logs, {}, (0.0, 0.0, math.log(share / (1 - share))))
    restore, places, known = Restorer(logs), {}, {}

    def found(text: str) -> np.ndarray:
        low = text.lower()
        words = {w for t in set(low.split()) for w in restore.token(t).split()}
        words |= {w for run in restore.runs(low) for w in run.split()}
        for w in words:
            if w not in known:
                known[w] = np.array([places.setdefault(f, len(places)) for f in sorted(features(w))], np.int32)
        return np.unique(np.concatenate([*(known[w] for w in words), np.zeros(0, np.int32)]))

    rows = list(dict.fromkeys(rows))  # a copy is no further evidence
    y = np.array([label for _, label in rows])
    docs = [(found(text), label) for text, label in rows]
    known.clear()
    vocabulary = list(places)
    half = np.zeros(len(rows), int)
    for value in (0, 1):  # every other row of each class
        half[np.flatnonzero(y == value)[1::2]] = 1
    x = np.zeros((len(rows), 2))
    for side in (0, 1):
        own = np.flatnonzero(half == side)
        scorer = Scorer(Model(logs, learn_weights([d for d, h in zip(docs, half, strict=True) if h != side], vocabulary), (0, 0, 0)))
        x[own] = scorer.worst([rows[i][0] for i in own])
    return Model(logs, learn_weights(docs, vocabulary), fit_logistic(x, y))


def fit(docs: DataFrame, labels: DataFrame, train_where, *, label: str = "toxic", per_class: int = 700, max_bytes: int = 16 << 20) -> Model:
    """per_class, max_bytes: bounds of the labelled sample; the language model counts every text."""
    logs = log_probabilities(count_characters(docs))
    model = train(labelled_sample(docs, labels, label, train_where, per_class=per_class, max_bytes=max_bytes), logs)
    give_back()
    return model


def _mapped(df: DataFrame, text_col: str, out_col: str, kind: str, make) -> DataFrame:
    keep = [c for c in df.columns if c != out_col]
    given = df.select(*(F.col(f"`{c}`") for c in keep))
    at, schema = keep.index(text_col), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields), f"`{out_col}` {kind}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for part in slices(batches):
            got = of([t or "" for t in part.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64() if kind == "double" else pa.string())], names=[*keep, out_col])

    return given.mapInArrow(run, schema)


def score_texts(df: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with the probability that a row's whole text is toxic."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # the table of 2 (16 MB) and weights of the bounded sample
    return _mapped(df, text_col, score_col, "double", lambda: Scorer(shared.value))


def restore_texts(df: DataFrame, model: Model, *, text_col: str = "text", restored_col: str = "restored") -> DataFrame:
    """df with the restored, lower-case text."""
    shared = df.sparkSession.sparkContext.broadcast(model.logs)

    def make():
        restore = Restorer(shared.value)
        return lambda texts: list(map(restore.text, texts))

    return _mapped(df, text_col, restored_col, "string", make)
