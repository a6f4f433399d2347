"""Quality classifier: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import discard, durable

#: The scorers are fitted on at most about so many documents (chosen by a hash of doc_id among all; texts are whole).
TRAIN_DOCS = 6_000
#: Width of the hashed feature space, and passes over the sample.
FEATURES, PASSES = 1 << 17, 6
#: Votes of a labeller.
ABSTAIN, GOOD, BAD = 0, 1, 2
LABELLERS = ("varied", "calm_case", "few_symbols", "no_runs", "fresh_lines", "word_shape", "length")
_SYMBOLS = b"#$%&*!|<>{}[]=^~_\\/@+"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def measures(text: str | None) -> tuple[list[bytes], np.ndarray]:
    """Words, and eight figures of a text: words, distinct share, capital share, symbols a word, share of words equal to
    the one before, share of repeated lines, mean letters a word, longest run of one word."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    words = data.lower().split()
    n = max(1, len(words))
    upper, lower = len(data) - len(data.translate(None, _UPPER)), len(data) - len(data.translate(None, _LOWER))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    run = sum(map(bytes.__eq__, words[1:], words)) / n
    lines = [x for x in data.split(b"\n") if x.strip()]
    return words, np.array([
        len(words), len(set(words)) / n ** 0.75, upper / max(1, upper + lower), symbols / n, run,
        1 - len(set(lines)) / max(1, len(lines)), sum(map(len, words)) / n, 0.0,
    ])


def votes(m: np.ndarray) -> list[int]:
    """One vote of each heuristic labeller; grey zones abstain."""
    words, varied, upper, symbols, run, lines, shape, _ = m
    pick = lambda good, bad: GOOD if good else BAD if bad else ABSTAIN
    return [
        pick(varied >= 1.0, words >= 20 and varied < 0.6),
        pick(upper < 0.15, upper > 0.4),
        pick(symbols < 0.15, symbols > 0.35),
        pick(run < 0.03, run > 0.2),
        pick(lines == 0, lines > 0.7),
        pick(2.5 <= shape <= 10, shape > 25 or words > 0 and shape < 1.5),
        pick(words >= 15, words == 0),
    ]


@dataclass
class Labelling:
    """share[class] and table[labeller, class, vote]; class 0 is good, each other one a way of being bad. Abstaining is a vote."""

    share: np.ndarray
    table: np.ndarray

    def joint(self, patterns: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of each class and pattern."""
        logs = np.log(self.share)[None, :].repeat(len(patterns), 0)
        for k in range(patterns.shape[1]):
            logs += np.log(self.table[k][:, patterns[:, k]]).T
        return logs

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of a good text."""
        logs = self.joint(patterns)
        p = np.exp(logs - logs.max(1, keepdims=True))
        return p[:, 0] / p.sum(1)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, known: np.ndarray | None = None, rounds: int = 100) -> Labelling:
    """How often each labeller votes what on good and on bad texts, and how many there are, from the counts of each pattern.

    known: GOOD or BAD where people have said so of the texts of a pattern, else ABSTAIN. Those texts keep their class; they
    tell a fault that a single labeller sees from a false alarm, so with any of them there is a way of being bad for each
    labeller beside a common one. Without, bad texts are one class. A few counts of each vote keep probabilities off 0.
    """
    n = patterns.shape[1] if patterns.ndim == 2 else len(LABELLERS)
    known = np.full(len(patterns), ABSTAIN) if known is None else known
    ways = n if (known != ABSTAIN).any() else 0
    few = np.tile(np.array([0.5, 0.5, 0.5]), (n, 2 + ways, 1))
    few[:, 0] = [0.5, 1.0, 0.02]
    for k in range(ways):
        few[:, 2 + k] = [0.5, 1.0, 0.1]
        few[k, 2 + k] = [0.2, 0.1, 2.0]
    model = Labelling(np.full(2 + ways, 1 / (2 + ways)), few / few.sum(2, keepdims=True))
    if not len(patterns):
        return model
    bad = patterns == BAD
    start = np.concatenate([np.exp(2.0 - 4.0 * bad.sum(1, keepdims=True)), 0.3 + 0.7 * (bad.sum(1, keepdims=True) > 0), bad[:, :ways]], 1)
    fixed = np.ones(start.shape)
    fixed[known == GOOD, 1:] = 1e-9
    fixed[known == BAD, 0] = 1e-9
    weight = start * fixed
    for _ in range(rounds):
        weight = weight / weight.sum(1, keepdims=True)
        mass = counts[:, None] * weight
        for k in range(n):
            seen = np.stack([np.bincount(patterns[:, k], mass[:, c], 3) for c in range(2 + ways)]) + few[k]
            model.table[k] = seen / seen.sum(1, keepdims=True)
        model.share = np.maximum(mass.sum(0), 0.5) / np.maximum(mass.sum(0), 0.5).sum()
        logs = model.joint(patterns)
        weight = np.exp(logs - logs.max(1, keepdims=True)) * fixed + 1e-300
    return model


def word_keys(words: list[bytes]) -> set[int]:
    """64-bit hashes of the words and of the first 4 to 6 letters of longer ones."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    found = set()
    for w in set(words):
        w = w.strip(b".,;:!?#$%&*|\"'()")
        if w:
            found.add(h(w))
            if len(w) > 5:
                found.update((h(w[:4], 4), h(w[:5], 5), h(w[:6], 6)))
    return found


def steps_of(m: np.ndarray) -> np.ndarray:
    """Places of the figures in steps."""
    edges = ((5, 15, 50, 200), (0.5, 0.8, 1.1, 1.5), (0.1, 0.2, 0.4, 0.7), (0.05, 0.15, 0.4, 0.8), (0.01, 0.05, 0.2, 0.5), (0.01, 0.2, 0.5, 0.8), (2, 4, 8, 14))
    return np.array([FEATURES - 256 + 8 * k + int(np.searchsorted(steps, m[k], side="right")) for k, steps in enumerate(edges)], np.int64)


def places(keys: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Sorted distinct places of keys, and those of the figures."""
    return np.unique(np.concatenate([(keys % np.uint64(FEATURES - 256)).astype(np.int64), steps]))


def fit_marked(texts: list[np.ndarray], marked: np.ndarray, steps: int = 2_000, shrink: float = 0.005) -> tuple[dict[int, float], float]:
    """Weights by key and intercept of a logistic scorer of marked texts, over the keys that tell them apart.

    Of the keys of marked texts, those count whose likelihood ratio statistic is above 2 ln(number of keys), what the largest
    of so many would reach by chance, and that are more frequent there. Weights are full 64-bit keys', so no two words meet.
    """
    rate = (marked.sum() + 0.5) / (len(marked) + 1)
    base = float(np.log(rate / (1 - rate))) if marked.any() else -10.0
    if not marked.any() or marked.all():
        return {}, base
    keys = np.unique(np.concatenate([t for t, x in zip(texts, marked, strict=True) if x]))
    if not len(keys):
        return {}, base
    rows, row_of = [], []
    for i, t in enumerate(texts):
        at = np.searchsorted(keys, t)
        at = at[keys[np.minimum(at, len(keys) - 1)] == t].astype(np.int32)
        row_of.append(at)
        rows.append(np.full(len(at), i, np.int32))
    rows, row_of = np.concatenate(rows), np.concatenate(row_of)
    both = np.bincount(row_of, marked[rows], len(keys))
    seen = np.bincount(row_of, minlength=len(keys)).astype(float)
    n, m = float(len(marked)), float(marked.sum())

    def part(a, expected):
        return np.where(a > 0, a * np.log(np.maximum(a, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    g2 = 2 * (part(both, seen * m / n) + part(seen - both, seen * (n - m) / n) + part(m - both, (n - seen) * m / n) + part(n - m - seen + both, (n - seen) * (n - m) / n))
    chosen = np.flatnonzero((g2 > 2 * np.log(len(keys))) & (both * n > seen * m))
    if not len(chosen):
        return {}, base
    place = np.full(len(keys), -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(texts), len(chosen)))
    at = place[row_of]
    x[rows[at >= 0], at[at >= 0]] = 1.0
    w, b = np.zeros(len(chosen)), base
    g = np.full(len(chosen) + 1, 1e-8)
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - marked
        step = np.append(x.T @ miss + shrink * w, miss.sum())
        g += step * step
        move = 0.5 * step / np.sqrt(g)
        w, b = w - move[:-1], b - float(move[-1])
    return dict(zip(keys[chosen].tolist(), w.tolist(), strict=True)), float(b)


def fit_linear(rows: list[np.ndarray], target: np.ndarray, weight: np.ndarray, passes: int = PASSES, rate: float = 0.15, shrink: float = 2e-4) -> np.ndarray:
    """Logistic regression by AdaGrad in a fixed order; the last weight is the intercept."""
    w, g2 = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-2)
    order = np.random.default_rng(5).permutation(len(rows))
    for _ in range(passes):
        for i in order:
            at = np.append(rows[i], FEATURES)
            scale = 1 / np.sqrt(len(at))
            p = 1 / (1 + np.exp(-np.clip(w[at].sum() * scale, -30, 30)))
            g = weight[i] * (p - target[i]) * scale + shrink * w[at]
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
    return w


def classify(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, quality (posterior of the labellers), score, toxicity (hashed linear scorers, 0 to 1), keep, for every row.

    Patterns of votes are counted over all documents (at most 3 to the power of the labellers), and EM runs on these
    counts, with known labels where there are any; no figure that is returned reads the labels of its own row. The quality scorer learns the posteriors of a bounded sample; the toxicity scorer learns the known labels of
    one, over the words that tell them apart, and is flat if there are none. keep: quality and score at least 0.5, toxicity below. Null and empty texts have no
    words; the labellers alone judge them and they are not kept. Repeated rows are judged alike.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("l")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"), F.min(F.col("quality").cast("int")).alias("known"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [bytes(votes(measures(text.as_py())[1])) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.binary())], ["doc_id", "votes"])

    # texts are read where they lie; only ids and votes meet the labels
    bare = durable(docs.select("doc_id", "text").mapInArrow(vote, "doc_id long, votes binary"), "votes")
    said = F.when(F.col("known").isNull(), ABSTAIN).when(F.col("known") > 0, GOOD).otherwise(BAD)
    voted = durable(bare.join(known, F.col("doc_id") == F.col("l"), "left").select("doc_id", "toxic", said.alias("known"), "votes"), "votes")
    discard(bare)
    counted = sorted((bytes(r["votes"]), r["known"], r["n"]) for r in voted.groupBy("votes", "known").agg(F.count(F.lit(1)).alias("n")).collect())
    patterns = np.array([list(p) for p, *_ in counted], np.int64).reshape(len(counted), len(LABELLERS))
    model = expectation_maximisation(patterns, np.array([n for *_, n in counted], float), np.array([k for _, k, _ in counted], np.int64))
    total, labelled = sum(n for *_, n in counted), voted.where("toxic is not null").count()

    point = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("toxic").isNull(), F.lit(train_docs / 2 / max(1, total - labelled))).otherwise(F.lit(train_docs / max(1, labelled)))
    chosen = voted.where(point < share)
    ids = chosen.select(F.col("doc_id").alias("c"), "votes", "toxic").dropDuplicates(["c"])  # bounded by train_docs

    def sample(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for text in f["text"]:
                words, m = measures(text)
                keys = word_keys(words)
                out.append((np.array(sorted(keys), np.uint64).tobytes(), steps_of(m).astype(np.int32).tobytes()))
            yield pd.DataFrame({"doc_id": f["doc_id"], "votes": f["votes"], "toxic": f["toxic"], "keys": [k for k, _ in out], "steps": [x for _, x in out]})

    picked = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("c"))
    found = picked.select("doc_id", "text", "votes", "toxic").mapInPandas(sample, "doc_id long, votes binary, toxic int, keys binary, steps binary").collect()
    discard(voted)
    found.sort(key=lambda r: (r["doc_id"], r["keys"]))
    spots = [places(np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["steps"], np.int32)).astype(np.int32) for r in found]
    post = model.posterior(np.array([list(r["votes"]) for r in found], np.int64).reshape(len(found), len(LABELLERS)))
    w_quality = fit_linear(spots, post, np.ones(len(spots))).astype(np.float32)
    marked = [r for r in found if r["toxic"] is not None]
    toxic, intercept = fit_marked([np.frombuffer(r["keys"], np.uint64) for r in marked], np.array([float(r["toxic"] > 0) for r in marked]))
    shared = spark.sparkContext.broadcast((w_quality, toxic, intercept, model))  # a weight for each of FEATURES places, and the chosen keys

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quality_w, toxic_w, base, labelling = shared.value
        toxic_keys = toxic_w.keys()
        for batch in batches:
            patterns, q, t, full = [], [], [], []
            for text in batch.column(1):
                words, m = measures(text.as_py())
                patterns.append(votes(m))
                keys = word_keys(words)
                at = np.append(places(np.fromiter(keys, np.uint64, len(keys)), steps_of(m)), FEATURES)
                q.append(quality_w[at].sum() / np.sqrt(len(at)))
                t.append(base + sum(toxic_w[k] for k in keys & toxic_keys))
                full.append(bool(words))
            post = labelling.posterior(np.array(patterns, np.int64).reshape(len(patterns), len(LABELLERS)))
            q, t = (1 / (1 + np.exp(-np.clip(np.array(x, float), -30, 30))) for x in (q, t))
            keep = (post >= 0.5) & (q >= 0.5) & (t < 0.5) & np.array(full, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(post), pa.array(q), pa.array(t), pa.array(keep)], ["doc_id", "quality", "score", "toxicity", "keep"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, quality double, score double, toxicity double, keep boolean")
