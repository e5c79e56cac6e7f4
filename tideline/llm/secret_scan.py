"""Secret scanning: fixed patterns, and a character convolutional network over every candidate with its context.

The patterns find assignments, access keys and hexadecimal runs. Candidates are the spans of the patterns and every other run of 12 or more
key characters. The network reads the 24 characters before a candidate, 48 of its own and the
8 behind it; a longer candidate is read in windows that overlap by half, and its score is the best of theirs. It is trained here on labelled findings (a candidate is a finding if a pattern covers it), on
the windows of all candidates of all documents. They are dealt by a hash into shards; each of ROUNDS rounds trains every shard from one common network
and averages the results, so every distinct window outside the held-out third is learned from. The rarer kind goes into several shards if a shard would have few of it.
Half of the findings are also shown with their context blanked, so the network has to judge the characters themselves. Its output is calibrated on the held-out
third, also of all documents, by a logistic fit (scores to 1 / BINS) in which every occurrence counts, and the threshold is the highest that keeps `recall`
of the occurrences of held-out findings (with fewer than 49 of them lower, since the lowest score of few does not keep it).
Candidates at or above it that no pattern covers are added as kind `model`; pattern spans always stay.

Defined cases: null and empty texts have no spans; texts are read whole; equal texts get equal spans;
with fewer than 20 findings or 20 others among all documents nothing is added; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, ship

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(
    r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
ROUNDS = 2
#: Windows of the rarer kind that a shard has at least, if there are as many.
RARE = 128
#: Bins of a raw score for the calibration.
BINS, HIGH = 1024, 32
BEFORE, OWN, AFTER = 24, 48, 8
WIDTH = BEFORE + OWN + AFTER

_HINT = re.compile(r"[:=]")
_WORD = re.compile(r"(?:[wW][oO][rR][dD]|[sS][wW][dD]|[cC][rR][eE][tT]|[kK][eE][nN]|[kK][eE][yY])[\"']?\x20*[:=]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, by start, then kind."""
    found = []
    if _HINT.search(text) and _WORD.search(text):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def other_candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs that touch no pattern span."""
    starts = [s for _, s, _ in base]
    ends = list(accumulate((e for _, _, e in base), max))  # base is sorted by start
    out = []
    for m in RUN.finditer(text):
        before = bisect_left(starts, m.end())
        if not before or ends[before - 1] <= m.start():
            out.append(m.span())
    return out


def _class(c: str) -> int:
    """1 to 127: itself if ASCII; 1 also stands for other letters, 0 for what is missing."""
    o = ord(c)
    return o if 0 < o < 128 else 1


def window(text: str, start: int, end: int) -> np.ndarray:
    before = text[max(0, start - BEFORE) : start]
    own = text[start : min(end, start + OWN)]
    after = text[end : end + AFTER]
    row = np.zeros(WIDTH, np.uint8)
    for at, part in ((BEFORE - len(before), before), (BEFORE, own), (BEFORE + OWN, after)):
        row[at : at + len(part)] = [_class(c) for c in part]
    return row


def windows(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all spans, and the place of the span of each; the context in each window is that of its whole span."""
    if not spans:
        return np.zeros((0, WIDTH), np.uint8), np.zeros(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.append(np.where((codes > 0) & (codes < 128), codes, 1).astype(np.uint8), np.uint8(0))  # the last stands for what is missing
    s, e = np.array(spans, np.int64).T
    n = 1 + np.maximum(0, -(-(e - s - OWN) // (OWN // 2)))
    of = np.repeat(np.arange(len(s)), n)
    at = s[of] + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * (OWN // 2)
    s, e = s[of, None], e[of, None]
    before, own, after = s + np.arange(-BEFORE, 0), at[:, None] + np.arange(OWN), e + np.arange(AFTER)
    none = len(codes) - 1
    place = np.concatenate([np.where(before < 0, none, before), np.where(own < e, own, none), np.minimum(after, none)], axis=1)
    return codes[place], of


@dataclass
class Network:
    """Embedding, one convolution, maximum over places in each of the three parts, one hidden layer; then a logistic calibration."""

    weights: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 1.1

    SPAN = 5
    _PARTS = ((0, BEFORE), (BEFORE, BEFORE + OWN), (BEFORE + OWN, WIDTH))

    @classmethod
    def fresh(cls, rng: np.random.Generator, embed: int = 8, filters: int = 16, hidden: int = 16) -> "Network":
        w = {
            "E": rng.normal(0, 0.5, (128, embed)),
            "C": rng.normal(0, (cls.SPAN * embed) ** -0.5, (cls.SPAN * embed, filters)),
            "c": np.zeros(filters),
            "H": rng.normal(0, (3 * filters) ** -0.5, (3 * filters, hidden)),
            "h": np.zeros(hidden),
            "O": rng.normal(0, hidden**-0.5, hidden),
            "o": np.zeros(1),
        }
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        w, half = self.weights, self.SPAN // 2
        padded = np.pad(x, ((0, 0), (half, half)))
        at = np.arange(WIDTH)[:, None] + np.arange(self.SPAN)
        codes = padded[:, at]
        cols = w["E"][codes].reshape(len(x), WIDTH, -1)
        conv = np.maximum(cols @ w["C"] + w["c"], 0)
        best = [a + conv[:, a:b].argmax(axis=1) for a, b in self._PARTS]
        rows = np.arange(len(x))[:, None]
        pooled = np.concatenate([conv[rows, p, np.arange(conv.shape[2])] for p in best], axis=1)
        hidden = np.maximum(pooled @ w["H"] + w["h"], 0)
        return hidden @ w["O"] + w["o"][0], (codes, cols, best, pooled, hidden)

    def gradients(self, cache: tuple, d: np.ndarray) -> dict[str, np.ndarray]:
        codes, cols, best, pooled, hidden = cache
        w, rows = self.weights, np.arange(len(d))[:, None]
        g = {"O": hidden.T @ d, "o": np.array([d.sum()])}
        dh = np.outer(d, w["O"]) * (hidden > 0)
        g["H"], g["h"] = pooled.T @ dh, dh.sum(axis=0)
        dp = dh @ w["H"].T * (pooled > 0)
        filters = w["C"].shape[1]
        g["C"], g["c"], g["E"] = np.zeros_like(w["C"]), np.zeros_like(w["c"]), np.zeros_like(w["E"])
        for k, at in enumerate(best):
            own = dp[:, k * filters : (k + 1) * filters]
            taken = cols[rows, at]
            g["C"] += np.einsum("nfe,nf->ef", taken, own)
            g["c"] += own.sum(axis=0)
            back = (own[:, :, None] * w["C"].T[None]).reshape(len(d), filters, self.SPAN, -1)
            seen = codes[rows, at].ravel()
            for e, own in enumerate(back.reshape(len(seen), -1).T):
                g["E"][:, e] += np.bincount(seen, own, minlength=len(g["E"]))
        return g

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        if not len(x):
            return np.zeros(0)
        raw = np.concatenate([self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512)])
        return _logistic(self.scale * raw + self.shift)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def learn(net: Network, x: np.ndarray, y: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Train net further, in place, on windows x and kinds y. Batches hold both kinds, which weigh the same; each pass shows every window."""
    of = [np.flatnonzero(y == kind) for kind in (0, 1)]
    blank = x[of[1][::2]].copy()
    blank[:, :BEFORE] = 0
    x, of[1] = np.concatenate([x, blank]), np.concatenate([of[1], len(x) + np.arange(len(blank))])
    if not len(of[0]) or not len(of[1]):
        return
    ones = int(np.clip(round(64 * len(of[1]) / (len(of[0]) + len(of[1]))), 16, 48))
    size = 64 - ones, ones
    d = np.repeat([0.5 / k for k in size], size).astype(np.float32)
    target = np.repeat([0, 1], size).astype(np.float32)
    n = max(-(-len(own) // k) for own, k in zip(of, size, strict=True))
    m = {k: np.zeros_like(v) for k, v in net.weights.items()}
    s = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for t in range(1, epochs * n + 1):
        if (t - 1) % n == 0:
            order = [np.resize(rng.permutation(own), n * k).reshape(n, k) for own, k in zip(of, size, strict=True)]
        z, cache = net.forward(x[np.concatenate([o[(t - 1) % n] for o in order])])
        for k, g in net.gradients(cache, (_logistic(z) - target) * d).items():
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            net.weights[k] -= (0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def calibrate(net: Network, raw: np.ndarray, own: np.ndarray, each: np.ndarray) -> None:
    """Set scale and shift by raw scores, their kinds and how much each counts."""
    a, b = 1.0, 0.0
    ones = (each * own).sum()
    target = np.where(own > 0, (ones + 1) / (ones + 2), 1 / (each.sum() - ones + 2))
    each = each / each.mean()
    for _ in range(50):  # Newton steps of the logistic calibration
        p = _logistic(a * raw + b)
        r, v = each * (p - target), each * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(v * raw * raw).sum() + 1e-3, (v * raw).sum()], [(v * raw).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, [(r * raw).sum() + 1e-3 * (a - 1), r.sum()])
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    net.scale, net.shift = max(a, 1e-3), b


def fit(x: np.ndarray, y: np.ndarray, recall: float = 0.98, epochs: int = 12, seed: int = 7) -> Network | None:
    """A network with its calibration and threshold, of windows in memory; None if one kind has fewer than 20 rows."""
    if min(int(y.sum()), int((1 - y).sum())) < 20:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    x, y = x[order], y[order].astype(np.float32)
    held = np.arange(len(y)) % 3 == 0
    net = Network.fresh(rng)
    learn(net, x[~held], y[~held], epochs, rng)
    raw, own = net.forward(x[held])[0], y[held]
    calibrate(net, raw, own, np.ones(len(own)))
    set_threshold(net, lowest(np.sort(raw[own > 0]), recall) if own.any() else 0.0)
    return net


def few(n: int, recall: float) -> bool:
    """Whether the lowest of n scores is still too high for recall: of new findings one in n + 1 falls below it."""
    return (1 - recall) * (n + 1) < 1


def lowest(raw: np.ndarray, recall: float) -> float:
    """The highest raw score that keeps recall of findings with these sorted scores; of few, as far below the lowest as the median is above it."""
    return float(2 * raw[0] - np.median(raw) if few(len(raw), recall) else raw[int((1 - recall) * len(raw))])


def set_threshold(net: Network, raw: float) -> None:
    net.threshold = float(_logistic(net.scale * np.array([raw], np.float32) + net.shift)[0])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, window, finding of every candidate of docs."""
    ship(docs.sparkSession)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, labels = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = base_spans(text or "")
                for _, s, e in base:  # the first window stands for a finding, as not every part of one need be a key
                    ids.append(doc), rows.append(window(text, s, e).tobytes()), labels.append(True)
                for row in windows(text or "", other_candidates(text or "", base))[0]:
                    ids.append(doc), rows.append(row.tobytes()), labels.append(False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(rows, pa.binary()), pa.array(labels, pa.bool_())],
                names=["doc_id", "window", "finding"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        scan, "doc_id long, window binary, finding boolean"
    )


def _dealt(found: DataFrame, rare: bool, shards: int, copies: int) -> DataFrame:
    """shard, place, window and finding of the windows; the rarer kind is in several shards."""
    times = F.when(F.col("finding") == rare, F.lit(copies)).otherwise(F.lit(1))
    copied = found.withColumn("k", F.explode(F.sequence(F.lit(0), times - 1)))
    shard = F.pmod(F.shiftright("place", 2) + F.col("k"), F.lit(shards))  # place also says what is held out
    return copied.select(shard.alias("shard"), "place", "window", "finding")


def _round(dealt: DataFrame, net: Network, epochs: int, seed: int) -> Network:
    """The average of what the shards' networks become from net; sums of whole numbers, so the order of tasks does not matter."""
    names = list(net.weights)
    sent = dealt.sparkSession.sparkContext.broadcast(net.weights)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, at, parts = 0, 0, None, []

        def flush() -> tuple[np.ndarray, int]:
            x = np.frombuffer(b"".join([w for ws, _ in parts for w in ws]), np.uint8).reshape(-1, WIDTH)
            own = Network({k: v.copy() for k, v in sent.value.items()})
            learn(own, x, np.concatenate([y for _, y in parts]), epochs, np.random.default_rng([seed, at]))
            return np.rint(np.concatenate([own.weights[k].ravel() for k in names]).astype(np.float64) * (1 << 24)).astype(np.int64), 1

        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if shard[lo] != at and parts:
                    own, n = flush()
                    total, rows, parts = total + own, rows + n, []
                at = int(shard[lo])
                part = batch.slice(lo, hi - lo)
                parts.append((part.column(1).to_pylist(), part.column(2).to_numpy(zero_copy_only=False).astype(np.float32)))
        if parts:
            own, n = flush()
            total, rows = total + own, rows + n
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([rows], pa.int64())], names=["total", "shards"])

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    own = dealt.repartition(n, "shard").sortWithinPartitions("shard", "place", "window").select("shard", "window", "finding")
    got = own.mapInArrow(work, "total binary, shards long").collect()
    mean = sum(np.frombuffer(r.total, np.int64) for r in got) / (sum(r.shards for r in got) * float(1 << 24))
    out, at = {}, 0
    for k in names:
        size = net.weights[k].size
        out[k] = mean[at : at + size].reshape(net.weights[k].shape).astype(np.float32)
        at += size
    return Network(out)


def _raw_scores(held: DataFrame, net: Network) -> DataFrame:
    """raw, finding and n of windows."""
    sent = held.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, WIDTH)
            raw = np.concatenate([np.zeros(0), *(sent.value.forward(x[lo : lo + 512])[0] for lo in range(0, len(x), 512))])
            yield pa.RecordBatch.from_arrays([pa.array(raw.astype(np.float64)), batch.column(1), batch.column(2)], names=["raw", "finding", "n"])

    return held.select("window", "finding", "n").mapInArrow(score, "raw double, finding boolean, n long")


def train(docs: DataFrame, train_rows: int = 4_000, recall: float = 0.98) -> Network | None:
    """Fit on the windows of all candidates, in shards of about 4 * train_rows; see the module's text."""
    scratch = Scratch(docs.sparkSession, "secret-scan")
    place = F.shiftrightunsigned(F.xxhash64("window", "finding"), 1)
    found = candidates(docs).groupBy("window", "finding").agg(F.count(F.lit(1)).alias("n")).withColumn("place", place)
    found = scratch.table("candidates", found)
    kinds = {r.finding: r for r in found.groupBy("finding").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("windows")).collect()}
    if len(kinds) < 2 or min(r.n for r in kinds.values()) < 20:
        scratch.drop("")
        return None
    windows_ = sum(r.windows for r in kinds.values())
    rare = min(kinds, key=lambda k: (kinds[k].windows, k))
    shards = -(-windows_ // (4 * train_rows))
    copies = min(shards, -(-RARE * shards // kinds[rare].windows))
    apart = F.pmod("place", F.lit(3)) == 0
    again = F.lit(False)
    for kind, r in kinds.items():
        if r.windows < 60:  # every third by order, so that neither part is without the kind; one or two windows are in both
            own = [x.place for x in found.filter(F.col("finding") == kind).select("place").orderBy("place").collect()]
            apart = F.when(F.col("finding") == kind, F.col("place").isin(own[2::3])).otherwise(apart)
            again = again | (F.col("finding") == kind) & F.lit(len(own) < 3)
    learned, held = found.filter(~apart), found.filter(apart | again)
    passes = max(ROUNDS, min(12, -(-48_000 // windows_)))
    net = Network.fresh(np.random.default_rng(7))
    dealt = _dealt(learned, rare, shards, copies)
    for k in range(ROUNDS):
        net = _round(dealt, net, passes // ROUNDS, k)
    scores = scratch.table("scores", _raw_scores(held, net))
    bin_ = F.floor(F.greatest(F.lit(-HIGH), F.least(F.lit(HIGH), "raw")) * BINS).cast("long").alias("bin")
    bins = scores.groupBy("finding", bin_).agg(F.sum("n").alias("n")).orderBy("finding", "bin").toPandas()
    own, each = bins["finding"].to_numpy(float), bins["n"].to_numpy(float)
    calibrate(net, (bins["bin"].to_numpy(float) + 0.5) / BINS, own, each)
    ones = bins[bins["finding"]]
    n, total = int(ones["n"].sum()), ones["n"].cumsum().to_numpy()
    if few(n, recall):
        own = scores.filter("finding").select("raw", "n").orderBy("raw").toPandas()
        set_threshold(net, lowest(np.repeat(own["raw"], own["n"]).to_numpy(), recall))
    else:  # exact: the bin that holds it, then its place there
        at = int((1 - recall) * n)
        k = int(np.searchsorted(total, at, side="right"))
        own = scores.filter("finding").filter(bin_ == int(ones["bin"].iloc[k])).groupBy("raw").agg(F.sum("n").alias("n")).orderBy("raw").toPandas()
        before = int(total[k - 1]) if k else 0
        set_threshold(net, float(own["raw"].iloc[int(np.searchsorted(own["n"].cumsum().to_numpy() + before, at, side="right"))]))
    scratch.drop("")
    return net


def scan_secrets(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, score) by start, then kind. Places count code points; end is exclusive."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(network)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                spans, rows, where, first, seen = [], [], [], [], 0
                for k, text in enumerate(part.column(1).to_pylist()):
                    text = text or ""
                    base = base_spans(text)
                    spans.append([[*s, None] for s in base])
                    if net is not None:
                        own = [(s, e) for _, s, e in base] + other_candidates(text, base)
                        got, of = windows(text, own)
                        rows.append(got), first.append(np.flatnonzero(np.diff(of, prepend=-1)) + seen)
                        seen += len(got)
                        where += [(k, n if n < len(base) else None, s, e) for n, (s, e) in enumerate(own)]
                if where:
                    best = np.maximum.reduceat(net.scores(np.concatenate(rows)), np.concatenate(first))
                    for (k, n, s, e), p in zip(where, best, strict=True):
                        if n is not None:
                            spans[k][n][3] = float(p)
                        elif p >= net.threshold:
                            spans[k].append(["model", s, e, float(p)])
                value = [
                    [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in sorted(own, key=lambda s: (s[1], KINDS.index(s[0])))]
                    for own in spans
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        scan, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>"
    )


def find_secrets(docs: DataFrame) -> DataFrame:
    """Train on docs, then scan docs."""
    return scan_secrets(docs, train(docs))
