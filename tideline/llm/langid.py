"""Language identification by multilingual mixture inference.

Each language has a character trigram model: the likelihood of a word is the product of the probabilities of its
characters given the two before them. The words of a document are drawn from its languages in unknown proportions,
which expectation-maximisation estimates. The set of languages is the one with the best
likelihood less a penalty for each language (half the log of the number of words times `penalty`).

The models are fitted on at most about `train_rows` labelled rows, chosen by a hash of doc_id. What comes to the driver are
counts of hashed trigrams: at most 2 * BUCKETS numbers a language. Every row is scored on its whole text.

Defined cases: a text that is null or has no letter is `und` with score 0; without labelled rows everything is `und`; rows without
lang are scored but not learned from; equal texts get equal results; ties go to the language that sorts first; other columns are ignored.
"""

from __future__ import annotations

import gc
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import ship
from .worker import held

UNKNOWN = "und"
BUCKETS = 1 << 17
#: Words of a table; beyond them a table starts anew. At four languages a word takes about 200 bytes.
MAX_WORDS = 200_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _letters(unit: str) -> str:
    return unit.lower() if unit.isalpha() else "".join(filter(str.isalpha, unit)).lower()


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams and their contexts of all words one after the other, and each word's number of them."""
    text = "".join(["  " + w + " " for w in words])
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    n = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    ends = np.cumsum(n + 2)
    inside = np.ones(len(c), bool)
    starts = ends - (n + 2)
    inside[starts] = inside[starts + 1] = False
    at = np.flatnonzero(inside)
    pair = c[at - 2] * _MIX[0] + c[at - 1] * _MIX[1]
    whole = (pair ^ (pair >> np.uint64(29))) + c[at] * _MIX[2]
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return ((whole * _MIX[0]) >> shift).astype(np.int64), ((pair * _MIX[1]) >> shift).astype(np.int64), n


class Model:
    """Trigram log-probabilities: logp[bucket, language], and floor[context, language] for trigrams never met."""

    def __init__(self, languages: list[str], tri: np.ndarray, ctx: np.ndarray, smooth: float = 0.02):
        alphabet = 64.0
        self.name = uuid.uuid4().hex  # tells workers one model from another
        self.languages = languages
        self.logp = np.log(tri + smooth).astype(np.float32)
        self.logc = np.log(ctx + smooth * alphabet).astype(np.float32)

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word in each language."""
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        tri, ctx, n = _trigrams(words)
        return np.add.reduceat(self.logp[tri] - self.logc[ctx], np.cumsum(n) - n, axis=0)

    def gains(self, words: list[str]) -> np.ndarray:
        """By how much each language explains each word better than letters that are all equally likely."""
        tri, ctx, n = _trigrams(words)
        each = self.logp[tri] - self.logc[ctx]
        each[each > 0] = -np.log(64.0)  # more than its context: another trigram's bucket
        return np.add.reduceat(each + np.float32(np.log(64.0)), np.cumsum(n) - n, axis=0)


def counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, bucket, n of hashed trigrams (bucket below BUCKETS) and contexts (above) over all rows of docs."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags: dict[str, Counter] = {}
        for batch in batches:
            for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bags.setdefault(g, Counter()).update(t.split())
                if len(bags[g]) > MAX_WORDS:
                    yield from emit({g: bags.pop(g)})
        yield from emit(bags)

    def emit(bags: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for g, bag in bags.items():
            pairs = [(w, n) for u, n in bag.items() if (w := _letters(u))]
            if not pairs:
                continue
            tri, ctx, sizes = _trigrams([w for w, _ in pairs])
            weight = np.repeat(np.array([n for _, n in pairs], float), sizes)
            total = np.concatenate([np.bincount(tri, weight, BUCKETS), np.bincount(ctx, weight, BUCKETS)])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([g] * len(at)), pa.array(at), pa.array(total[at].astype(np.int64))], names=["lang", "bucket", "n"]
            )

    ship(docs.sparkSession)
    labelled = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).cast("string"), F.col(lang).cast("string")
    )
    return labelled.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, train_rows: int = 30_000) -> Model | None:
    """Fit on at most about train_rows rows (doc_id, text, lang); None if there is nothing to learn from."""
    usable = labelled.filter("text IS NOT NULL AND lang IS NOT NULL")
    rows = usable.count()
    if rows > train_rows:
        part = int(train_rows / rows * (1 << 32))
        usable = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < part)
    got = counts(usable).toPandas()
    languages = sorted(got["lang"].unique())
    if not languages:
        return None
    table = np.zeros((2 * BUCKETS, len(languages)))
    table[got["bucket"].to_numpy(), np.searchsorted(languages, got["lang"].to_numpy())] = got["n"].to_numpy()
    return Model(languages, table[:BUCKETS], table[BUCKETS:])


class Scorer:
    """Scores texts; remembers the likelihoods of words it has met."""

    def __init__(self, model: Model, penalty: float = 3.0, rounds: int = 8):
        self.model, self.penalty, self.rounds = model, penalty, rounds
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.rows = np.zeros((1, len(self.model.languages)), np.float32)
        self.has = np.zeros(1, bool)
        self.chars = 0

    def _learn(self, units: set[str]) -> None:
        new = [u for u in units if u not in self.index]
        if len(self.index) + len(new) > MAX_WORDS or self.chars > 4_000_000:
            self._reset()
            new = list(units - {""})
        self.chars += sum(map(len, new))
        words = [_letters(u) for u in new]
        full = [w for w in words if w]
        rows = np.zeros((len(new), len(self.model.languages)), np.float32)
        has = np.array([bool(w) for w in words], bool)
        rows[has] = self.model.words(full)
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.rows = np.concatenate([self.rows, rows])
        self.has = np.concatenate([self.has, has])

    def mixtures(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """For each text its proportions and which languages are in its set; None if it has no letter."""
        units = [(t or "").split() for t in texts]
        self._learn(set().union(*units))
        get = self.index.__getitem__
        found: list[tuple[np.ndarray, np.ndarray] | None] = []
        for us in units:
            ids = np.fromiter(map(get, us), np.int64, len(us))
            ids = ids[self.has[ids]]
            found.append(self._mixture(self.rows[ids]) if len(ids) else None)
        return found

    def explained(self, texts: list[str | None], found: list) -> list[bool]:
        """Whether the mixture found for each text explains its words better than equally likely letters do."""
        units = [(t or "").split() for t in texts]
        words = {u: w for u in set().union(*units) if (w := _letters(u))}
        at = {u: k for k, u in enumerate(words)}
        gains = self.model.gains(list(words.values())) if words else None
        out = []
        for us, got in zip(units, found, strict=True):
            ids = [at[u] for u in us if u in at]
            if got is None or not ids:
                out.append(False)
                continue
            own = gains[ids].astype(np.float64)
            top = own.max(axis=1, keepdims=True)
            out.append(bool((np.log(np.exp(own - top) @ got[0] + 1e-300) + top[:, 0]).sum() > 0))
        return out

    def _mixture(self, ll: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = ll.shape
        top = ll.max(axis=1, keepdims=True)
        p = np.exp(ll - top)
        shares = self._em(p, np.full(k, 1.0 / k, np.float32))
        order = np.argsort(-shares, kind="stable")
        single = ll.sum(axis=0, dtype=np.float64) - top.sum(dtype=np.float64)
        best_one = int(np.argmax(single))
        cost = 0.5 * self.penalty * np.log(max(n, 2))
        best, best_set, best_shares = single[best_one] - cost, np.eye(k, dtype=bool)[best_one], np.eye(k)[best_one]
        for size in range(2, k + 1):
            own = order[:size]
            if shares[own[-1]] * n < 1:
                break
            part = self._em(p[:, own], shares[own] / shares[own].sum(), 2)
            value = float(np.log(p[:, own] @ part + 1e-30).sum(dtype=np.float64)) - size * cost
            if value > best:
                best, best_set, best_shares = value, np.isin(np.arange(k), own), np.zeros(k)
                best_shares[own] = part
        return best_shares, best_set

    def _em(self, p: np.ndarray, shares: np.ndarray, rounds: int | None = None) -> np.ndarray:
        shares = shares.astype(np.float32)
        for _ in range(rounds or self.rounds):
            new = shares * (p.T @ (1.0 / (p @ shares + np.float32(1e-30)))) / len(p)
            if np.abs(new - shares).max() < 1e-3:
                return new
            shares = new
        return shares


def scorer_of(model: Model) -> Scorer:
    """This worker's scorer of a model."""
    return held(("languages", model.name), lambda: Scorer(model))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, languages (those in the chosen set) of every row."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        scorer = model and scorer_of(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                names, scores, sets = [], [], []
                collects = gc.isenabled()
                gc.disable()
                texts = part.column(1).to_pylist()
                for got in scorer.mixtures(texts) if model is not None else [None] * len(texts):
                    if got is None:
                        names.append(UNKNOWN), scores.append(0.0), sets.append([])
                        continue
                    shares, chosen = got
                    at = int(np.argmax(shares))
                    names.append(model.languages[at])
                    scores.append(min(1.0, max(0.0, float(shares[at]))))
                    sets.append([g for g, on in zip(model.languages, chosen, strict=True) if on])
                if collects:
                    gc.enable()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string()))],
                    names=["doc_id", "lang_pred", "score", "languages"],
                )

    out = "doc_id long, lang_pred string, score double, languages array<string>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, out)


def accept(docs: DataFrame, model: Model | None, min_score: float) -> DataFrame:
    """The rows of docs whose language is known with at least min_score and whose words it explains; columns as they are. One pass, no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(sent.value) if sent.value is not None else None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = part.column(at).to_pylist()
                found = scorer.mixtures(texts) if scorer else [None] * len(texts)
                fits = scorer.explained(texts, found) if scorer else [False] * len(texts)
                yield part.filter(pa.array([on and float(m[0].max()) >= min_score for m, on in zip(found, fits, strict=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, then identify every row."""
    model = train(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return identify(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
