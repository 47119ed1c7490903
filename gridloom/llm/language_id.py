"""Language identification: nearest of several clustered centroids per language, by cosine over TF-IDF n-grams.

A text is lower-cased, everything but letters becomes a blank, and its byte trigrams are counted in ``dims`` hashed
buckets. Counts are damped, weighted by inverse document frequency and normalised. Spherical k-means gives
``clusters`` centroids for each language, so a language may have several styles. A text takes the language of the
nearest centroid. It is rejected where that centroid is farther than a cut-off of its language, which is set from the
distances of sampled texts that had no part in the centroids they are measured against.

The model is fitted on a bounded sample: at most ``sample`` whole texts per language, no two alike. Each language's
clusters are made by a task of its own; the driver gets the centroids alone (``clusters`` * ``dims`` floats, 64 KB a
language), which also go to every task. Everything else reads all rows. There is no bound on the number of languages.

Defined results: ``und`` with score 0, rejected, for a null text or one without a letter; repeated rows get equal
results, and count as one in the sample; rows with a null language or doc_id teach nothing; an empty table gives no
rows, and with no labelled row every text is ``und``; very long texts are counted piece by piece; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, is_train, sample_of, text_hash, written

UNKNOWN = "und"
#: Trigrams counted at a time.
STEP = 1_000_000


@dataclass(frozen=True)
class Settings:
    dims: int = 4096
    clusters: int = 4
    sample: int = 1000
    rounds: int = 12
    temperature: float = 0.03
    #: A text is rejected below this share of the cosine that all but a fiftieth of the measured texts reach,
    slack: float = 0.35
    #: if it has at least so many trigrams; shorter ones say too little about distance.
    least: int = 40


def counts(texts: list[str], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram counts (texts x dims, float32), and the number of letters of each text (0: none)."""
    import regex

    letters = regex.compile(r"\P{L}+")
    folded = [b" " + letters.sub(" ", t).lower().strip().encode() + b" " for t in texts]
    size = np.array([len(f) for f in folded], np.int64)
    table = np.zeros((len(texts), dims), np.float32)
    ends = np.cumsum(size)
    whole = np.frombuffer(b"".join(folded), np.uint8)
    for a in range(0, len(whole) - 2, STEP):
        data = whole[a : a + STEP + 2].astype(np.uint32)
        code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        slot = (code * np.uint32(2654435761)) >> np.uint32(32 - (dims - 1).bit_length())
        at = np.arange(a, a + len(code))
        row = np.searchsorted(ends, at, side="right")
        inside = at + 2 < ends[row]
        first, last = row[0], row[-1] + 1
        found = np.bincount((row[inside] - first) * dims + slot[inside], minlength=(last - first) * dims)
        table[first:last] += found.reshape(last - first, dims)
    return table, size - 2


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=-1, keepdims=True)), 1e-12)


@dataclass
class Model:
    settings: Settings
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # languages * clusters x dims
    owner: np.ndarray  # language of each centroid
    cutoff: np.ndarray  # of each language: the cosine below which a text is rejected

    def vectors(self, table: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(table) * self.idf)

    def predict(self, texts: list[str]) -> pd.DataFrame:
        table, letters = counts(texts, self.settings.dims)
        if not self.languages:
            return pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "distance": 1.0, "rejected": True}, index=range(len(texts)))
        cosine = self.vectors(table) @ self.centroids.T
        best = cosine.argmax(axis=1)
        each = np.maximum.reduceat(cosine, np.searchsorted(self.owner, np.arange(len(self.languages))), axis=1)
        weight = np.exp((each - each.max(axis=1, keepdims=True)) / self.settings.temperature)
        known = letters > 0
        top = cosine[np.arange(len(texts)), best]
        far = (top < self.cutoff[self.owner[best]]) & (table.sum(axis=1) >= self.settings.least)
        return pd.DataFrame(
            {
                "lang_pred": np.where(known, np.array(self.languages, object)[self.owner[best]], UNKNOWN),
                "score": np.where(known, 1.0 / weight.sum(axis=1), 0.0).astype(float),
                "distance": np.where(known, 1.0 - top, 1.0).astype(float),
                "rejected": ~known | far,
            }
        )


def _clusters(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; each seed is far from those before it, but not among the farthest tenth (outliers).

    Deterministic for a given order of rows. Clusters of under 2 % of the rows are dropped.
    """
    seeds = [int((x @ _unit(x.mean(axis=0))).argmax())]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argsort(near, kind="stable")[len(x) // 10]))
        near = np.maximum(near, x @ x[seeds[-1]])
    centres = x[seeds]
    for _ in range(rounds):
        owner = (x @ centres.T).argmax(axis=1)
        centres = np.stack([_unit(x[owner == j].mean(axis=0)) if (owner == j).any() else centres[j] for j in range(len(centres))])
    members = np.bincount((x @ centres.T).argmax(axis=1), minlength=len(centres))
    return centres[members >= max(1, 0.02 * len(x))]


def learn(table: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Centroids of one language from its unit vectors, and its cut-off.

    The cut-off comes from every fifth text, measured against clusters of the others; with under ten of them it is 0.
    """
    held = np.arange(len(table)) % 5 == 0
    cutoff = 0.0
    if held.sum() >= 10:
        reach = (table[held] @ _clusters(table[~held], s.clusters, s.rounds).T).max(axis=1)
        cutoff = max(0.0, float(np.quantile(reach, 0.02)) * s.slack)
    return _clusters(table, s.clusters, s.rounds), cutoff


def fit(docs: DataFrame, settings: Settings | None = None) -> Model:
    """Fits on rows of ``docs`` with a language whose id is not held out."""
    s = settings or Settings()
    dims = s.dims
    labelled = docs.filter(is_train(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    name = "language-sample"
    sample = sample_of(labelled.select("doc_id", F.col("lang").cast("string").alias("lang"), text_hash(name).alias("hash")), docs, "lang", s.sample, name)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in chunks(texts, 500_000):
                table, _ = counts(texts[i:j], dims)
                at = [np.flatnonzero(r).astype("<u4") for r in table]
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([r[a].astype("<f4").tobytes() for r, a in zip(table, at, strict=True)], pa.binary())], ["lang", "slots", "counts"])

    counted = written(sample.select("lang", "text").mapInArrow(count, "lang string, slots binary, counts binary"), "language-counts")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dims + 1, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for slots in batch.column(0).to_pylist():
                df[np.frombuffer(slots, "<u4")] += 1
        df[dims] = n
        yield pa.record_batch([pa.array(np.arange(dims + 1)), pa.array(df)], ["slot", "df"])

    found = counted.select("slots").mapInArrow(frequencies, "slot long, df long").groupBy("slot").agg(F.sum("df").alias("df")).collect()  # dims + 1 rows
    df = np.zeros(dims + 1, np.int64)
    for slot, n in found:
        df[slot] = n
    idf = (np.log((1 + df[dims]) / (1 + df[:dims])) + 1).astype(np.float32)

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((len(rows), dims), np.float32)
        order = sorted(range(len(rows)), key=lambda k: (bytes(rows["slots"].iloc[k]), bytes(rows["counts"].iloc[k])))
        for k, i in enumerate(order):
            table[k, np.frombuffer(rows["slots"].iloc[i], "<u4")] = np.frombuffer(rows["counts"].iloc[i], "<f4")
        table = table[np.random.default_rng(0).permutation(len(table))]
        centres, cutoff = learn(_unit(np.log1p(table) * idf), s)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "centres": [centres.astype("<f4").tobytes()], "cutoff": [cutoff]})

    rows = sorted(counted.groupBy("lang").applyInPandas(cluster, "lang string, centres binary, cutoff double").collect())
    none = np.zeros((0, dims), np.float32)
    centres = [np.frombuffer(r[1], "<f4").reshape(-1, dims) for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(c) for c in centres])
    cutoff = np.array([r[2] for r in rows])
    if (cutoff > 0).any():  # languages with too few texts to measure take the least one
        cutoff[cutoff <= 0] = cutoff[cutoff > 0].min()
    return Model(s, [r[0] for r in rows], idf, np.concatenate([none, *centres]), owner, cutoff)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, distance, rejected of every row of ``docs`` (columns doc_id and text only are read)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 64 KB a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i in range(0, len(texts), 512):
                for a, b in chunks(texts[i : i + 512], 500_000):
                    found = shared.value.predict(texts[i + a : i + b])
                    yield pa.record_batch([batch.column(0).slice(i + a, b - a), pa.array(found["lang_pred"], pa.string()), pa.array(found["score"], pa.float64()), pa.array(found["distance"], pa.float64()), pa.array(found["rejected"], pa.bool_())], ["doc_id", "lang_pred", "score", "distance", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, distance double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rejected(texts: pd.Series) -> pd.Series:
        out, values = [], [t or "" for t in texts]
        for i in range(0, len(values), 512):
            for a, b in chunks(values[i : i + 512], 500_000):
                out.append(shared.value.predict(values[i + a : i + b])["rejected"])
        return pd.concat(out, ignore_index=True) if out else pd.Series([], dtype=bool)

    return docs.filter(~F.pandas_udf(rejected, "boolean")(F.col("text")))
