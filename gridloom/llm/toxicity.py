"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding: compatibility forms, lower case, accents off, homoglyphs (Cyrillic, Greek) and digits or signs that stand
for letters replaced, everything else a blank. Entries are whole words or beginnings of words; their weights are the
log-odds learned from labelled texts. Hits inside an exception phrase do not count. The score is a logistic function
of the weight found, of how surprising so many hits are in a text of that length, and of the different entries hit.

Learning uses a bounded sample: at most ``sample`` whole texts of either label, no two alike. A candidate is present
in a text if it makes up at least ``dense`` of the text's words: many words are harmless in passing and tell by their
frequency. Candidates are counted by a distributed aggregate, and those that pass the three tests of ``Settings`` all
go on to the greedy cover, whose ``gain`` alone decides the size of the lexicon. The logistic function is fitted out
of fold: each half of the sample is judged by the lexicon of the other half. Scoring reads every text, whole, without
a shuffle.

Defined results: a null text is an empty one and has the score of a text without hits; repeated rows get equal
scores, and count as one in the sample; a label row with a null doc_id or label, or of an absent document, teaches
nothing, and of several labels of one document the highest counts; without texts of both labels the built-in seed
lexicon is used with default weights; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_train, sample_of, text_hash, written

#: Signs and digits that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("абвгдезикмнорстухьієјѕαβεικνορτυχω", "abbrde3ukmhopctyxbiejsabeiknoptuxw", strict=True)) | {"з": "e", "ı": "i", "ł": "l", "ø": "o"}
#: Harmless phrases around words that may be in the lexicon.
EXCEPTIONS = ("clown fish", "clown car", "trash can", "trash bin", "trash bag", "taking out the trash", "pond scum", "scum layer", "sore loser", "pathetic fallacy", "dumb waiter", "dumb bell")
#: Used as far as the labels don't teach better.
SEED = ("idiot", "moron", "stupid", "scum", "loser", "worthless", "disgusting", "pathetic")
SEED_WEIGHT = 2.0
#: Share of a harmless text's words that may be hits in passing.
PASSING = 0.003


@dataclass(frozen=True)
class Settings:
    sample: int = 3000
    #: Beginnings of words of these lengths are candidates besides whole words.
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 7, 8, 9, 10)
    #: Least share of a text's words that a candidate makes up where it counts as present.
    dense: float = 0.01
    #: Least toxic texts with a candidate, least share of toxic ones among the texts with it, least log-likelihood ratio.
    least: int = 3
    precision: float = 0.8
    evidence: float = 12.0
    #: Least number of toxic texts that an entry adds to the cover (a text with k entries already counts half to the power k),
    #: less three times the clean texts with it.
    gain: float = 1.0
    exceptions: tuple[str, ...] = EXCEPTIONS


@functools.cache
def _folding() -> dict[int, str]:
    table: dict[int, str] = {}
    for i in range(0x2000):
        c = chr(i)
        plain = unicodedata.normalize("NFKD", c).casefold()
        plain = "".join(LOOKALIKES.get(x, x) for x in plain if not unicodedata.combining(x))
        table[i] = "".join(SIGNS.get(x, x if x.isalpha() else " ") for x in plain)
        if unicodedata.combining(c):
            table[i] = ""
    return table


class _Fold(dict):
    """Characters beyond the table are folded when they are first met."""

    def __missing__(self, i: int) -> str:
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(i)).casefold() if not unicodedata.combining(x))
        out = "".join(SIGNS.get(x, x if x.isalpha() else " ") for x in plain)
        if len(self) < 200_000:
            self[i] = out
        return out


@functools.cache
def _table() -> _Fold:
    return _Fold(_folding())


_SPACES = re.compile(r"\s+")


def fold(text: str) -> str:
    """The words of ``text`` as the lexicon sees them, each between blanks."""
    return _SPACES.sub(" ", f" {text.translate(_table())} ")


def word_counts(folded: str) -> Counter[str]:
    """How often each word occurs; the list of words is made piece by piece."""
    out: Counter[str] = Counter()
    a = 0
    while a < len(folded):
        b = folded.find(" ", a + 1_000_000)
        b = len(folded) if b < 0 else b
        out.update(folded[a:b].split())
        a = b
    return out


def features(folded: str, prefixes: tuple[int, ...], dense: float) -> list[str]:
    """Candidate entries present: `` word `` for whole words of three letters or more, `` begin`` for beginnings."""
    words = word_counts(folded)
    least = dense * sum(words.values())
    out: Counter[str] = Counter()
    for w, n in words.items():
        if len(w) > 2:
            out[f" {w} "] += n
            for k in prefixes:
                if len(w) >= k:
                    out[" " + w[:k]] += n
    return [f for f, n in out.items() if n >= least]


@dataclass
class Model:
    entries: list[str]
    weights: np.ndarray
    coefficients: np.ndarray
    exceptions: tuple[str, ...] = EXCEPTIONS
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def automaton(self):  # noqa: ANN201
        if self._automaton is None:
            import ahocorasick

            built = ahocorasick.Automaton()
            for k, entry in enumerate(self.entries):
                built.add_word(entry, (k, len(entry)))
            for phrase in self.exceptions:
                key = fold(phrase)
                if key not in built:
                    built.add_word(key, (-1, len(key)))
            built.make_automaton()
            self._automaton = built
        return self._automaton

    def evidence(self, text: str) -> tuple[float, float, float]:
        """(weight found, its surprise, different entries hit), each damped.

        The surprise is the log-likelihood ratio of so many hits if ``PASSING`` of the words are hits in passing.
        """
        folded = fold(text)
        words = folded.count(" ") - 1
        if words < 1 or not self.entries:
            return 0.0, 0.0, 0.0
        begins, ends, hits = [], [], []
        for end, (k, n) in self.automaton().iter(folded):
            if k < 0:  # a hit is spared if it lies in a phrase; phrases are found in the order of their ends
                while begins and begins[-1] >= end - n + 1:
                    begins.pop()
                    ends.pop()
                begins.append(end - n + 1)
                ends.append(end)
            else:
                hits.append((end - n + 1, end, k))
        # of entries that begin at one place, only the heaviest counts
        best: dict[int, int] = {}
        for a, end, k in hits:
            if begins:
                at = bisect_right(begins, a) - 1
                if at >= 0 and end <= ends[at]:
                    continue
            if a not in best or self.weights[k] > self.weights[best[a]]:
                best[a] = k
        if not best:
            return 0.0, 0.0, 0.0
        total, hits, expected = float(sum(self.weights[k] for k in best.values())), len(best), PASSING * words
        surprise = hits * np.log(hits / expected) - (hits - expected) if hits > expected else 0.0
        return float(np.log1p(total)), float(np.log1p(surprise * total / hits)), float(np.log1p(len(set(best.values()))))

    def score(self, texts: Iterable[str]) -> np.ndarray:
        x = np.array([self.evidence(t) for t in texts], float).reshape(-1, 3)
        return 1.0 / (1.0 + np.exp(-np.clip(self.coefficients[0] + x @ self.coefficients[1:], -30, 30)))


def _likelihood_ratio(t: np.ndarray, c: np.ndarray, nt: float, nc: float) -> np.ndarray:
    """Twice the log-likelihood ratio of presence in toxic (t of nt) and clean (c of nc) texts."""
    def part(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(p), 0.0) + np.where(n - k > 0, (n - k) * np.log1p(-p), 0.0)

    both = (t + c) / (nt + nc)
    return 2 * (part(t, nt, t / nt) + part(c, nc, c / nc) - part(t, nt, both) - part(c, nc, both))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Coefficients (constant first) by Newton's method; features whose slope would be negative are left out, one by one."""
    use = list(range(x.shape[1]))
    while True:
        a = np.column_stack((np.ones(len(x)), x[:, use]))
        b = np.zeros(a.shape[1])
        penalty = np.diag([1e-6] + [ridge] * len(use))
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + penalty, a.T @ (weight * (y - p)) - penalty @ b)
            b = b + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        if not use or b[1:].min() >= 0:
            out = np.zeros(1 + x.shape[1])
            out[0], out[1 + np.array(use, int)] = b[0], b[1:]
            return out
        del use[int(b[1:].argmin())]


DEFAULT = np.array([-4.0, 1.5, 2.0, 1.0])


def seed_model(settings: Settings | None = None) -> Model:
    entries = [f" {w} " for w in SEED]
    return Model(entries, np.full(len(entries), SEED_WEIGHT), DEFAULT, (settings or Settings()).exceptions)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Learns lexicon and weights from ``labels`` (doc_id, toxic) of documents that are not held out."""
    s = settings or Settings()
    usable = labels.filter(is_train(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    usable = usable.groupBy("doc_id").agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("toxic"))
    name = "toxic-sample"
    rows = written(docs.select("doc_id", text_hash(name).alias("hash")).join(usable, "doc_id"), "labelled")
    sample = sample_of(rows, docs, "toxic", s.sample, name)
    sizes = {int(r[0]): r[1] for r in rows.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return seed_model(s)
    taken = {int(r[0]): r[1] for r in sample.groupBy("toxic").count().collect()}
    prefixes, dense = s.prefixes, s.dense

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counted[toxic].update(features(fold(text.as_py() or ""), prefixes, dense))
            for toxic in (0, 1):
                yield pa.record_batch([pa.array(list(counted[toxic]), pa.string()), pa.array(list(counted[toxic].values()), pa.int64()), pa.array([toxic] * len(counted[toxic]), pa.int32())], ["feature", "n", "toxic"])

    tallied = sample.select("text", "toxic").mapInArrow(tally, "feature string, n long, toxic int").groupBy("feature")
    tallied = tallied.agg(F.sum(F.col("n") * F.col("toxic")).alias("t"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("c")).filter(F.col("t") >= s.least).filter(F.col("t") >= s.precision * (F.col("t") + F.col("c")))
    listed = sorted(tallied.collect())
    t, c = (np.array([r[k] for r in listed], float) for k in ("t", "c"))
    ratio = _likelihood_ratio(t, c, taken[1], taken[0])
    # the strongest first, of equals the longest: they are preferred among those that cover as much
    strong = sorted((-ratio[i], -len(r[0]), r[0]) for i, r in enumerate(listed) if ratio[i] >= s.evidence)
    candidates = [name for _, _, name in strong]
    index = sample.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(candidates)})  # words that pass the tests in the sample

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found = (index.value.get(f) for f in features(fold(text.as_py() or ""), prefixes, dense))
                rows.append(np.array(sorted(i for i in found if i is not None), "<u4").tobytes())
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["doc_id", "toxic", "found"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sorted(sample.select("doc_id", "text", "toxic").mapInArrow(present, f"doc_id {kind}, toxic int, found binary").collect())
    found = [np.frombuffer(r[2], "<u4") for r in rows]
    y = np.array([r[1] for r in rows])
    fold_of = np.array([zlib.crc32(str(r[0]).encode()) // 5 % 2 for r in rows])
    models = [_lexicon(candidates, found, y, None if k == 2 else fold_of != k, s) for k in range(3)]
    shared = sample.sparkSession.sparkContext.broadcast(models[:2])

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = [zlib.crc32(str(d).encode()) // 5 % 2 for d in batch.column(0).to_pylist()]
            x = np.array([shared.value[k].evidence(v.as_py() or "") for k, v in zip(folds, batch.column(1), strict=True)], float).reshape(-1, 3)
            yield pa.record_batch([batch.column(0), batch.column(2), *(pa.array(x[:, k]) for k in range(3))], ["doc_id", "toxic", "a", "b", "c"])

    points = np.array([r[1:] for r in sorted(sample.select("doc_id", "text", "toxic").mapInArrow(evidence, f"doc_id {kind}, toxic int, a double, b double, c double").collect())], float)
    weight = np.where(points[:, 0] == 1, sizes[1] / taken[1], sizes[0] / taken[0])
    models[2].coefficients = _logistic(points[:, 1:], points[:, 0], weight / weight.mean())
    return models[2]


def _lexicon(names: list[str], found: list[np.ndarray], y: np.ndarray, use: np.ndarray | None, s: Settings) -> Model:
    """Entries and weights from the sampled texts in ``use`` (all, if None)."""
    if use is not None:
        found, y = [f for f, u in zip(found, use, strict=True) if u], y[use]
    n = len(names)
    t = np.bincount(np.concatenate([np.zeros(0, np.int64), *[f for f, k in zip(found, y, strict=True) if k]]).astype(np.int64), minlength=n).astype(float)
    c = np.bincount(np.concatenate([np.zeros(0, np.int64), *[f for f, k in zip(found, y, strict=True) if not k]]).astype(np.int64), minlength=n).astype(float)
    nt, nc = float(y.sum()), float((1 - y).sum())
    chosen = _choose(names, found, y, t, c, nt, nc, s) if nt and nc else []
    # the pseudo-counts keep entries that few texts speak for light
    weights = np.maximum(np.log((t[chosen] + 0.5) / (nt + 1)) - np.log((c[chosen] + 1.5) / (nc + 3)), 0.0)
    entries = [names[i] for i in chosen]
    known = {names[i] for i in np.flatnonzero(t + c > 0)}
    for w in SEED:  # what the labels show nothing of keeps a default weight
        if f" {w} " not in entries and f" {w} " not in known:
            entries.append(f" {w} ")
            weights = np.append(weights, SEED_WEIGHT)
    return Model(entries, weights, DEFAULT, s.exceptions)


def _nested(a: str, b: str) -> bool:
    """One entry's hits are hits of the other."""
    return a.startswith(b) or b.startswith(a)


def _choose(names: list[str], found: list[np.ndarray], y: np.ndarray, t: np.ndarray, c: np.ndarray, nt: float, nc: float, s: Settings) -> list[int]:
    """Entries by greedy cover: the entry in most toxic texts that still have few entries, first.

    Counting texts less and less with the entries they have keeps out words that merely recur in copies of one toxic
    text: those are covered by then by what they share with other toxic texts. Texts with a chosen beginning, or a
    chosen longer form, of an entry don't count for it. Every clean text with an entry takes three from its gain.
    """
    depth = 4
    good = np.flatnonzero((t >= s.least) & (t / np.maximum(t + c, 1) >= s.precision) & (_likelihood_ratio(t, c, nt, nc) >= s.evidence))
    if not len(good):
        return []
    place = np.full(len(names), -1)
    place[good] = np.arange(len(good))
    docs = [place[f][place[f] >= 0] for f, k in zip(found, y, strict=True) if k]
    of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    entry = np.concatenate(docs) if docs else np.zeros(0, int)
    order = np.argsort(entry, kind="stable")
    of, entry = of[order], entry[order]
    bounds = np.searchsorted(entry, np.arange(len(good) + 1))
    members = [of[bounds[k] : bounds[k + 1]] for k in range(len(good))]
    covered = np.zeros(len(docs), int)
    gain = np.array([len(m) for m in members], float)
    open_ = np.ones(len(good), bool)
    chosen: list[int] = []
    credit = 0.5 ** np.arange(depth + 1)
    credit[depth:] = 0.0
    while True:
        # gains only fall, so an entry whose fresh gain is still the largest is the best one
        k = int(np.where(open_, gain, -1).argmax())
        if not open_[k] or gain[k] < s.gain:
            return [int(good[k]) for k in chosen]
        worth = credit[np.minimum(covered[members[k]], depth)]
        for other in chosen:
            if _nested(names[good[k]], names[good[other]]):
                worth = np.where(np.isin(members[k], members[other]), 0.0, worth)
        fresh = float(worth.sum()) - 3.0 * c[good[k]]
        if fresh < gain[k] - 1e-9:
            gain[k] = fresh
            continue
        open_[k] = False
        chosen.append(k)
        covered[members[k]] += 1


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``entries`` words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.score(v.as_py() or "" for v in batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a score below 0.5, with all their columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def toxic(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score([t or "" for t in texts]) >= 0.5)

    return docs.filter(~F.pandas_udf(toxic, "boolean")(F.col("text")))
