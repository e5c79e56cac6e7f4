"""Quality scores by co-training.

Two classifiers see different sides of a document: its text (hashed words and counts of their shapes), and the page's metadata (source, language,
length and their pairs). Each learns from the labelled rows. In every round each labels the pool of unlabelled rows, and the rows it is surest of, in
the proportion of the classes, join the other's training rows. At the end each view is calibrated on labelled rows that
were held out, a logistic combination of both is fitted there, and every document is scored.

Training reads at most about `sample_rows` labelled documents: the rarer class up to half of that, the other up to the rest, by a hash
of doc_id. Every document without a label is in the pool, which is dealt into shards of about POOL_ROWS. Each shard is co-trained with
all of those labelled rows, and the means of the shards' linear models are the classifiers. All documents are scored on their whole texts.
The features of every document are made once, in a table of the shared folder that training and scoring read.

Defined cases: null and empty texts have the features of no words; null metadata is a value of its own; labels that
are null, or differ between rows of one doc_id, are not learned from; with fewer than 10 labelled rows of a
class in the whole table every document gets that share of positive labels as its score (0.5 without labels); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, ship
from .worker import held

WORDS = 512
SHAPES = 10
TEXT = WORDS + SHAPES + 4
META = 256
MAX_WORDS = 200_000
POOL_ROWS = 16_384


class TextView:
    """Features of whole texts; remembers the hash and shape of words it has met."""

    def __init__(self) -> None:
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.bucket = np.zeros(0, np.int64)
        self.shape = np.zeros((0, SHAPES), np.float32)
        self.chars = 0

    @staticmethod
    def _shape(word: str) -> list[float]:
        letters = sum(map(str.isalpha, word))
        digits = sum(map(str.isdigit, word))
        other = len(word) - letters - digits
        return [
            float(letters == len(word)),
            float(word.isupper() and letters > 1),
            float(word[:1].isupper()),
            float(digits > 0),
            other / len(word),
            float(letters == 0),
            float(other >= 2),
            min(len(word), 40) / 40,
            float(len(word) > 20),
            float(word[-1] in ".!?"),
        ]

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > MAX_WORDS or self.chars > 4_000_000:
            self._reset()
            new = list(words)
        if not new:
            return
        self.chars += sum(map(len, new))
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.bucket = np.concatenate([self.bucket, [xxhash.xxh3_64_intdigest(w.lower()) % WORDS for w in new]])
        self.shape = np.concatenate([self.shape, np.array([self._shape(w) for w in new], np.float32)])

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        units = [(t or "").split() for t in texts]
        self._learn(set().union(*units))
        out = np.zeros((len(texts), TEXT), np.float32)
        get = self.index.__getitem__
        for row, us, text in zip(out, units, texts, strict=True):
            if not us:
                continue
            ids = np.fromiter(map(get, us), np.int64, len(us))
            share = np.bincount(self.bucket[ids], minlength=WORDS) / len(ids)
            row[:WORDS] = np.sqrt(share)
            row[WORDS : WORDS + SHAPES] = self.shape[ids].mean(axis=0) * 3
            lines = [x for x in text.split("\n") if x]
            row[WORDS + SHAPES :] = [
                len(set(us)) / len(us),
                len(set(lines)) / max(1, len(lines)),
                np.log1p(len(us)) / 5,
                np.log1p(len(lines) / len(us) * 100) / 3,
            ]
        return out


def meta_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Metadata hashed into META places."""
    out = np.zeros((len(source), META), np.float32)
    for row, s, g, n in zip(out, source, lang, n_chars, strict=True):
        size = "none" if n is None else str(int(np.log2(max(n, 1)) * 2))
        for name in (f"s={s}", f"g={g}", f"n={size}", f"s={s}|g={g}", f"g={g}|n={size}"):
            row[xxhash.xxh3_64_intdigest(name) % META] += 1
    return out


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Linear:
    w: np.ndarray
    b: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 200) -> "Linear":
        """Logistic regression by full-batch Adam; classes weigh the same."""
        weight = (np.where(y > 0.5, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)) / len(y)).astype(np.float32)
        x, y = np.ascontiguousarray(x, np.float32), y.astype(np.float32)
        p = np.zeros(x.shape[1] + 1)
        m, v = np.zeros_like(p), np.zeros_like(p)
        for t in range(1, steps + 1):
            r = (logistic(x @ p[:-1].astype(np.float32) + np.float32(p[-1])) - y) * weight
            g = np.append(r @ x + l2 * p[:-1], r.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        return cls(p[:-1].astype(np.float32), float(p[-1]))


@dataclass
class CoTrained:
    text: Linear | None
    meta: Linear | None
    scale: np.ndarray
    combine: Linear | None
    prior: float

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.combine is None:
            return np.full(len(text), self.prior)
        z = np.stack([self.scale[0, 0] * self.text(text) + self.scale[0, 1], self.scale[1, 0] * self.meta(meta) + self.scale[1, 1]], 1)
        return logistic(self.combine(np.clip(z, -15, 15)))


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make logistic(scale * z + shift) a probability."""
    a, b = 1.0, 0.0
    goal = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(40):
        p = logistic(a * z + b)
        r, v = p - goal, np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(v * z * z).sum() + 1e-2, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-2]])
        step = np.clip(np.linalg.solve(h, [(r * z).sum() + 1e-2 * (a - 1), r.sum()]), -1, 1)
        a, b = a - float(step[0]), b - float(step[1])
    return max(a, 1e-3), b


def _split(known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labelled rows that are held out, and those that are learned from."""
    return known[::4], np.setdiff1d(known, known[::4])


def _rounds(views: tuple[np.ndarray, np.ndarray], label: np.ndarray, prior: float, rounds: int = 5, per_round: float = 0.05) -> list[Linear]:
    """The classifiers of both views after they have labelled the pool for each other."""
    _, own = _split(np.flatnonzero(~np.isnan(label)))
    free = np.flatnonzero(np.isnan(label))
    rows = [own.copy(), own.copy()]
    values = [label[own], label[own]]
    models = [Linear.fit(v[r], l) for v, r, l in zip(views, rows, values, strict=True)]
    for _ in range(rounds):
        if not len(free):
            break
        n = max(1, int(per_round * len(free)))
        taken = []
        for k in (0, 1):
            z = models[k](views[k][free])
            order = np.argsort(z, kind="stable")
            low, high = order[: max(1, int(n * (1 - prior)))], order[::-1][: max(1, int(n * prior))]
            sure = logistic(np.abs(z)) >= 0.9
            low, high = low[sure[low] & (z[low] < 0)], high[sure[high] & (z[high] > 0)]
            other = 1 - k
            rows[other] = np.concatenate([rows[other], free[low], free[high]])
            values[other] = np.concatenate([values[other], np.zeros(len(low)), np.ones(len(high))])
            taken += [low, high]
        gone = np.unique(np.concatenate(taken))
        if not len(gone):
            break
        free = np.delete(free, gone)
        models = [Linear.fit(v[r], l) for v, r, l in zip(views, rows, values, strict=True)]
    return models


def _combined(models: list[Linear], views: tuple[np.ndarray, np.ndarray], label: np.ndarray, prior: float) -> CoTrained:
    """Calibrated and combined on the rows held out."""
    held, _ = _split(np.flatnonzero(~np.isnan(label)))
    z = np.stack([models[k](views[k][held]) for k in (0, 1)], 1)
    scale = np.array([_calibrate(z[:, k], label[held]) for k in (0, 1)])
    both = np.clip(z * scale[:, 0] + scale[:, 1], -15, 15)
    return CoTrained(models[0], models[1], scale, Linear.fit(both, label[held], l2=1e-3), prior)


def co_train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, rounds: int = 5, per_round: float = 0.05) -> CoTrained:
    """label: 1, 0, or NaN for the pool."""
    y = label[~np.isnan(label)]
    prior = float(y.mean()) if len(y) else 0.5
    if min(int((y > 0.5).sum()), int((y < 0.5).sum())) < 10:
        return CoTrained(None, None, np.ones((2, 2)), None, prior)
    return _combined(_rounds((text, meta), label, prior, rounds, per_round), (text, meta), label, prior)


def _features(docs: DataFrame, rest: str) -> DataFrame:
    """Both views of the first five columns; the other columns, described by rest, go through."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view = held(("quality",), TextView)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                collects = gc.isenabled()
                gc.disable()
                cols = [c.to_pylist() for c in part.columns[1:5]]
                views = view(cols[0]), meta_view(*cols[1:])
                if collects:
                    gc.enable()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r.tobytes() for r in views[0]], pa.binary()),
                        pa.array([r.tobytes() for r in views[1]], pa.binary()),
                        *part.columns[5:],
                    ],
                    names=["text", "meta", *part.schema.names[5:]],
                )

    return docs.mapInArrow(run, f"text binary, meta binary, {rest}")


def _matrix(column: Iterable[bytes]) -> np.ndarray:
    rows = list(column)
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1)


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long"),
        F.col("text").cast("string"),
        F.col("source").cast("string"),
        F.col("lang").cast("string"),
        F.col("n_chars").cast("long"),
    )


def features(docs: DataFrame) -> DataFrame:
    """Both views of every row as bytes, with doc_id, a hash of the text and one of both."""
    ship(docs.sparkSession)
    own = _inputs(docs)
    named = own.select("*", F.col("doc_id").alias("id"), F.xxhash64("text").alias("body"), F.xxhash64("doc_id", "text").alias("at"))
    return _features(named, "id long, body long, at long").withColumnRenamed("id", "doc_id")


def _taught(made: DataFrame, known: DataFrame, rows: int, views: tuple[np.ndarray, np.ndarray], label: np.ndarray, prior: float) -> list[Linear]:
    """The means of the models that the shards of the pool lead to; rows is the size of the pool, the rows of made that are not in known."""
    shards = max(1, -(-rows // POOL_ROWS))
    sent = made.sparkSession.sparkContext.broadcast((views, label))

    def fit(part: pa.Table, known: pa.Table) -> pa.Table:
        (text, meta), label = sent.value
        part = part.filter(pc.invert(pc.is_in(part.column("doc_id"), value_set=known.column("of").combine_chunks()))).sort_by("at")
        if not part.num_rows:
            return pa.table({"place": pa.array([], pa.int64()), "value": pa.array([], pa.float64())})
        own = tuple(np.concatenate([v, _matrix(part.column(c).to_pylist())]) for v, c in ((text, "text"), (meta, "meta")))
        models = _rounds(own, np.concatenate([label, np.full(part.num_rows, np.nan)]), prior)
        value = np.concatenate([np.append(m.w, m.b) for m in models]).astype(np.float64)
        return pa.table({"place": pa.array(np.arange(len(value))), "value": pa.array(value)})

    # Features travel, not texts. Labelled rows are left out where they arrive; rows without doc_id are spread by text.
    shard = lambda c: F.pmod(c, F.lit(shards)).alias("shard")
    dealt = made.select("text", "meta", "doc_id", "at", shard(F.when(F.col("doc_id").isNull(), F.col("body")).otherwise(F.xxhash64("doc_id"))))
    got = (
        dealt.groupBy("shard")
        .cogroup(known.select("of", shard(F.xxhash64("of"))).groupBy("shard"))
        .applyInArrow(fit, "place long, value double")
        .groupBy("place")
        .agg(F.avg("value").alias("value"))
        .toPandas()
        .sort_values("place")["value"]
        .to_numpy(float)
    )
    return [Linear(v[:-1].astype(np.float32), float(v[-1])) for v in (got[: TEXT + 1], got[TEXT + 1 :])]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, made: DataFrame | None = None) -> CoTrained:
    """made: the features of docs, if there is a table of them."""
    ship(docs.sparkSession)
    own = _inputs(docs)
    made = features(docs) if made is None else made
    known = (
        labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("of"))
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .filter("low = high")
        .select("of", (F.col("low") > 0).cast("double").alias("label"))
    )
    same = F.col("doc_id") == F.col("of")
    sizes = {r["label"]: r["count"] for r in own.select("doc_id").join(known, same).groupBy("label").count().collect()}
    total, least = sum(sizes.values()), min(sizes.get(0.0, 0), sizes.get(1.0, 0))
    prior = sizes.get(1.0, 0) / total if total else 0.5
    if least < 10:
        return CoTrained(None, None, np.ones((2, 2)), None, prior)
    chosen = known.join(own.select("doc_id"), same, "left_semi")
    if total > sample_rows:
        fewer = min(least, sample_rows // 2)
        share = {c: (fewer if n == least else sample_rows - fewer) / n for c, n in sizes.items()}
        part = F.when(F.col("label") > 0, int(share[1.0] * (1 << 32))).otherwise(int(share[0.0] * (1 << 32)))
        chosen = chosen.filter(F.pmod(F.xxhash64("of"), F.lit(1 << 32)) < part)
    # At most about sample_rows keys, so the texts need not be shuffled.
    got = made.join(F.broadcast(chosen), same).select("text", "meta", "label", "at").toPandas().sort_values("at")
    views, label = (_matrix(got["text"]), _matrix(got["meta"])), got["label"].to_numpy(float)
    rows = own.count() - total
    models = _taught(made, known, rows, views, label, prior) if rows else _rounds(views, label, prior)
    return _combined(models, views, label, prior)


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view = held(("quality",), TextView)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                collects = gc.isenabled()
                gc.disable()
                cols = [c.to_pylist() for c in part.columns]
                p = sent.value.scores(view(cols[1]), meta_view(*cols[2:5]))
                if collects:
                    gc.enable()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p.astype(np.float64))], names=["doc_id", "score"])

    return _inputs(docs).mapInArrow(run, "doc_id long, score double")


def _score_features(made: DataFrame, model: CoTrained) -> DataFrame:
    sent = made.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                p = sent.value.scores(_matrix(part.column(1).to_pylist()), _matrix(part.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p.astype(np.float64))], names=["doc_id", "score"])

    return made.select("doc_id", "text", "meta").mapInArrow(run, "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, kept (score at or above the threshold) of every document."""
    made = Scratch(docs.sparkSession, "quality").table("features", features(docs))
    model = train(docs, labels, made=made)
    return _score_features(made, model).withColumn("kept", F.col("score") >= threshold)
