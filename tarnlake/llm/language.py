"""Language ID by prediction by partial matching over bytes, one frozen context tree per language."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import tidy

#: Training characters per language (a documented bound; rows are taken by a hash of doc_id until it is met, one at least).
TRAIN_CHARS = 400_000
#: Bytes of context at most.
ORDER = 3
UNKNOWN = "und"
#: The pipeline rejects texts that cost over so many times the bits a byte of their language's training texts.
REJECT_RATIO = 4.0


@dataclass
class Trees:
    """Context trees flattened to tables of code lengths in bits, one column per language.

    symbol: byte -> class of its own, or 0 for bytes never seen. context[k]: code of k preceding symbols -> row, or -1.
    bits[k]: (row * symbols + symbol) -> bits of the symbol, escapes to shorter contexts included.
    """

    languages: list[str]
    symbol: np.ndarray
    symbols: int
    context: list[np.ndarray]
    bits: list[np.ndarray]
    usual: np.ndarray  # bits a byte of the training texts

    def costs(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        if not self.languages or not texts:
            return out
        lengths = np.array([len(t) for t in texts])
        data = self.symbol[np.frombuffer(b"".join(texts), np.uint8)]
        if not len(data):
            return out
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        place = np.arange(len(data)) - np.repeat(starts, lengths)  # no context reaches into the text before
        total = np.zeros((len(data), len(self.languages)), np.float32)
        code = np.zeros(len(data), np.int64)
        open_ = np.ones(len(data), bool)
        rows = [np.zeros(len(data), np.int64)]
        for k in range(1, len(self.context)):
            code[k:] += data[:-k].astype(np.int64) * self.symbols ** (k - 1)
            row = np.where(place >= k, self.context[k][code], -1)
            rows.append(row)
        for k in range(len(self.context) - 1, -1, -1):
            use = open_ & (rows[k] >= 0)
            at = np.flatnonzero(use)
            total[at] = self.bits[k][rows[k][at] * self.symbols + data[at]]
            open_[at] = False
        full = lengths > 0
        out[full] = np.add.reduceat(total, starts[full], axis=0, dtype=np.float64)
        return out


def fit(samples: list[tuple[str, list[bytes]]], order: int = ORDER) -> Trees:
    """Trees of labelled texts. A context that was never seen in any language is skipped without cost, and so it is
    in a language that lacks it where another one has it: all are then coded one order lower. Within a seen context, symbols not seen there cost an escape (method C: distinct symbols over distinct symbols plus count) and are
    coded one order lower, down to equal shares of all bytes."""
    samples = sorted((lang, texts) for lang, texts in samples if any(texts))
    if not samples:
        return Trees([], np.zeros(256, np.int32), 1, [np.full(1, -1, np.int32)], [np.zeros((0, 0), np.float32)], np.zeros(0))
    seen = np.unique(np.concatenate([np.frombuffer(b"".join(texts), np.uint8) for _, texts in samples]))
    symbol = np.zeros(256, np.int32)
    symbol[seen] = np.arange(1, len(seen) + 1)
    size, langs = len(seen) + 1, len(samples)
    streams = []
    for _, texts in samples:
        texts = [t for t in texts if t]
        data = symbol[np.frombuffer(b"".join(texts), np.uint8)].astype(np.int64)
        lengths = np.array([len(t) for t in texts])
        place = np.arange(len(data)) - np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        streams.append((data, place))
    contexts, tables = [], []
    for k in range(order + 1):
        grams = []
        for data, place in streams:
            code = np.zeros(len(data), np.int64)
            for j in range(1, k + 1):
                code[j:] += data[:-j] * size ** (j - 1)
            grams.append((code * size + data)[place >= k])
        known = np.unique(np.concatenate([g // size for g in grams]))
        row_of = np.full(size**k, -1, np.int32)
        row_of[known] = np.arange(len(known))
        shorter = None
        if k:
            back = contexts[k - 1][known % size ** (k - 1)]
            shorter = tables[k - 1].reshape(-1, size, langs)[back]
        bits = np.empty((len(known), size, langs), np.float32)
        for i, g in enumerate(grams):
            counts = np.bincount(row_of[g // size] * size + g % size, minlength=len(known) * size).reshape(len(known), size)
            distinct = (counts > 0).sum(1, keepdims=True)
            whole = counts.sum(1, keepdims=True)
            lower = shorter[:, :, i] if k else np.full((len(known), size), 8.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = -np.log2(counts / (whole + distinct))
                escape = np.where(whole > 0, -np.log2(np.maximum(distinct, 1) / np.maximum(whole + distinct, 1)), 0.0)
            bits[:, :, i] = np.where(counts > 0, hit, escape + lower)
        contexts.append(row_of)
        tables.append(bits.reshape(-1, langs))
    trees = Trees([lang for lang, _ in samples], symbol, size, contexts, tables, np.zeros(langs))
    for i, (_, texts) in enumerate(samples):
        trees.usual[i] = trees.costs(texts)[:, i].sum() / max(1, sum(map(len, texts)))
    return trees


def learn(docs: DataFrame, train_chars: int = TRAIN_CHARS, order: int = ORDER, keep_out: bool = True) -> Trees:
    """Fit on texts with a known language, about `train_chars` characters each: less than twice that, and one text at least.

    Rows whose crc32(doc_id) mod 4 is 2 are kept out. The rows of a language are admitted by a hash of doc_id until the
    bound is met; a longer text is cut to it. Characters are first summed by language and by steps of the hash, each a
    quarter more than the last, so that the driver receives little beyond what it admits.
    """
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and length(text) > 0")
    if keep_out:
        rows = rows.where(~held_out(F.col("doc_id")))
    point = F.pmod(F.xxhash64("doc_id", F.lit(7), F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(1 << 30))
    rows = rows.withColumn("text", F.substring("text", 1, train_chars)).withColumn("point", point)
    rows = rows.withColumn("step", F.floor(F.log2(F.col("point") + 1) * 3).cast("int"))
    sums = rows.groupBy("lang", "step").agg(F.sum(F.length("text")).alias("chars")).collect()  # at most 91 steps a language
    last: dict[str, int] = {}
    total: dict[str, int] = {}
    for r in sorted(sums, key=lambda r: (r["lang"], r["step"])):
        if total.get(r["lang"], 0) < train_chars:
            last[r["lang"]] = r["step"]
            total[r["lang"]] = total.get(r["lang"], 0) + r["chars"]
    steps = docs.sparkSession.createDataFrame(list(last.items()) or [("", -1)], "l string, last int")
    chosen = rows.join(F.broadcast(steps), (F.col("lang") == F.col("l")) & (F.col("step") <= F.col("last")))
    by: dict[str, list[tuple]] = {}
    taken: dict[str, int] = {}
    for r in chosen.select("doc_id", "lang", "text", "point").orderBy("lang", "point", "doc_id", "text").toLocalIterator():
        if taken.get(r["lang"], 0) < train_chars:
            taken[r["lang"]] = taken.get(r["lang"], 0) + len(r["text"])
            by.setdefault(r["lang"], []).append((r["doc_id"] is None, r["doc_id"] or 0, r["text"].encode("utf-8", "surrogatepass")))
    return fit([(lang, [t for *_, t in sorted(texts)]) for lang, texts in by.items()], order)


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def predict(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits: the cheapest language of each whole text (ties: the first by name).

    score is the posterior of that language with equal priors; bits is its cost a byte over the usual cost of that
    language. Null texts and texts without a letter, and all texts when nothing was learned, are `und` with score 0.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pickle.dumps(trees))  # bounded by order, alphabet and TRAIN_CHARS
    box: list[Trees] = []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not box:
            box.append(pickle.loads(shared.value))
        model = box[0]
        for frame in frames:
            texts = frame["text"].tolist()
            lang, score, ratio = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            good = [i for i, t in enumerate(texts) if has_letter(t)] if model.languages else []
            for group in chunks(good, texts):
                data = [texts[i].encode("utf-8", "surrogatepass") for i in group]
                costs = model.costs(data)
                best = costs.argmin(1)
                gain = (costs - costs.min(1, keepdims=True)) * np.log(2)
                post = 1 / np.exp(-np.minimum(gain, 700)).sum(1)
                for j, i in enumerate(group):
                    lang[i], score[i] = model.languages[best[j]], post[j]
                    ratio[i] = costs[j, best[j]] / len(data[j]) / model.usual[best[j]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "lang_pred": lang, "score": score, "cost_ratio": ratio})

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInPandas(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double, cost_ratio double")


def chunks(indices: list[int], texts: list[str], chars: int = 300_000) -> Iterator[list[int]]:
    """Runs of texts of about so many characters; a longer text is a run of its own."""
    group, size = [], 0
    for i in indices:
        group.append(i)
        size += len(texts[i])
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def language_id(docs: DataFrame) -> DataFrame:
    return predict(docs, learn(docs))


def keep_languages(docs: DataFrame, reject_ratio: float = REJECT_RATIO) -> DataFrame:
    """Rows of `docs` in a learned language: `und` and texts that no learned language models well go. All columns stay.

    Null and empty texts and those without a letter are `und`; rows that repeat are judged alike.
    """
    trees = learn(docs)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(trees))
    place = [c.lower() for c in docs.columns].index("text")
    box: list[Trees] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not box:
            box.append(pickle.loads(shared.value))
        model = box[0]
        for batch in batches:
            texts = batch.column(place).to_pylist()
            fits = np.zeros(len(texts), bool)
            for group in chunks([i for i, t in enumerate(texts) if has_letter(t)] if model.languages else [], texts):
                data = [texts[i].encode("utf-8", "surrogatepass") for i in group]
                costs = model.costs(data)
                best = costs.argmin(1)
                each = costs[np.arange(len(data)), best] / [len(d) for d in data]
                fits[group] = each <= reject_ratio * model.usual[best]
            yield batch.filter(pa.array(fits))

    return docs.mapInArrow(tidy(run), docs.schema)
