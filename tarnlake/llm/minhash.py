"""MinHash near-duplicates: universal hash minima, banding, signature check, full-set check, star components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import connected_components, discard, durable, less, small_broadcast, tidy


@dataclass(frozen=True)
class Plan:
    """width: words a shingle; similar: least Jaccard similarity in hundredths; bands of rows minima each.

    At 40 bands of 6, a pair of similarity 0.85 shares no band with probability 6e-9; at 48 bands of 5, a pair of 0.8 with
    5e-9. margin: a pair is dropped on its signature only if it agrees in fewer minima than similarity less margin (over
    six standard deviations: 1.2e-9 and 0.7e-9 by the exact binomial tail). Both together: 7.1e-9 and 6.0e-9 a link.
    """

    width: int = 3
    similar: int = 85
    bands: int = 40
    rows: int = 6
    margin: float = 0.15
    seed: int = 11
    block: int = 512
    block_bytes: int = 8 << 20


CONTRACT = Plan()
STAGE = Plan(width=5, similar=80, bands=48, rows=5, margin=0.17)


def coefficients(plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(plan.seed)
    n = plan.bands * plan.rows
    return rng.integers(1, 1 << 32, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 32, n, dtype=np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each universal hash (a x + b) mod 2**64, upper half (multiply-shift), over the shingles."""
    out = np.full(len(a), np.uint64(0xFFFFFFFF), np.uint64)
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512]
        out = np.minimum(out, ((a[:, None] * part[None, :] + b[:, None]) >> np.uint64(32)).min(1))
    return out


def _arrays(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def sketch_rows(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, n_shingles, two keys of the whole set, band hashes, one byte of each minimum."""
    import xxhash

    from tarnlake.llm.words import WordHashes, mix, shingle_set, words_of

    known, (a, b) = WordHashes(), coefficients(plan)
    for batch in batches:
        sizes, k1, k2, bands, marks = [], [], [], [], []
        for text in batch.column(1):
            words = words_of(text.as_py())
            shingles = shingle_set(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), plan.width)
            digest = xxhash.xxh3_128_digest(shingles.tobytes())
            sizes.append(len(shingles))
            k1.append(int.from_bytes(digest[:8], "little", signed=True))
            k2.append(int.from_bytes(digest[8:], "little", signed=True))
            if not len(shingles):
                bands.append(None)
                marks.append(None)
                continue
            low = minima(shingles, a, b)
            acc = np.arange(plan.bands, dtype=np.uint64)
            for row in low.reshape(plan.bands, plan.rows).T:
                acc = mix(acc * np.uint64(31) + row)
            bands.append(acc.view(np.int64))
            marks.append((low & np.uint64(255)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), _arrays(marks)],
            ["doc_id", "n_shingles", "k1", "k2", "bands", "marks"],
        )


def set_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, the sorted distinct shingle hashes as bytes."""
    from tarnlake.llm.words import WordHashes, shingle_set, words_of

    known = WordHashes()
    for batch in batches:
        sets = []
        for text in batch.column(1):
            words = words_of(text.as_py())
            sets.append(shingle_set(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), width).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), _arrays(sets)], ["node", "shingles"])


def agreeing(frames: Iterator[pd.DataFrame], plan: Plan) -> Iterator[pd.DataFrame]:
    """Pairs whose signatures agree often enough."""
    least = (plan.similar / 100 - plan.margin) * plan.bands * plan.rows
    for f in frames:
        if len(f):
            a = np.frombuffer(b"".join(f["mu"]), np.uint8).reshape(len(f), -1)
            b = np.frombuffer(b"".join(f["mv"]), np.uint8).reshape(len(f), -1)
            f = f[(a == b).sum(1) >= least]
        yield f[["u", "v"]]


def alike(x: np.ndarray, y: np.ndarray, similar: int) -> bool:
    """Whether two sorted sets overlap by at least `similar` hundredths of their union."""
    if 100 * min(len(x), len(y)) < similar * max(len(x), len(y)):
        return False
    at = np.searchsorted(x, y)
    common = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return 100 * common >= similar * (len(x) + len(y) - common)


def confirmed(batches: Iterator[pa.RecordBatch], similar: int) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v, su, sv) whose full sets overlap enough, by exact counts over the batch's own buffers."""
    for batch in batches:
        sets = []
        for column in (batch.column(2), batch.column(3)):
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            sets.append((offsets.tolist(), column.buffers()[2]))
        (left, left_data), (right, right_data) = sets
        ok = []
        for i in range(batch.num_rows):
            x = np.frombuffer(left_data, np.uint8, left[i + 1] - left[i], left[i]).view(np.uint64)
            y = np.frombuffer(right_data, np.uint8, right[i + 1] - right[i], right[i]).view(np.uint64)
            ok.append(alike(x, y, similar))
        yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))


def links_of(f: pd.DataFrame, plan: Plan) -> pd.DataFrame:
    """A spanning forest of the links between members (of blocks i and j of one bucket) that differ in component."""
    least = (plan.similar / 100 - plan.margin) * plan.bands * plan.rows
    bucket, i, j = (int(f[x].iloc[0]) for x in ("bucket", "i", "j"))
    node, c, mine = f["node"].to_numpy(), f["c"].to_numpy().copy(), f["mine"].to_numpy()
    marks = np.frombuffer(b"".join(f["marks"]), np.uint8).reshape(len(f), -1)
    bands = np.stack(f["bands"].to_numpy())
    sets = [np.frombuffer(x, np.uint64) for x in f["shingles"]]
    sizes, out = np.array([len(x) for x in sets]), []
    for k in np.flatnonzero(mine == i):
        at = np.flatnonzero(((mine == j) if i != j else (np.arange(len(f)) > k)) & (c != c[k]))
        at = at[100 * np.minimum(sizes[at], sizes[k]) >= plan.similar * np.maximum(sizes[at], sizes[k])]
        at = at[(marks[at] == marks[k]).sum(1) >= least]
        at = at[bands[k][(bands[at] == bands[k]).argmax(1)] == bucket]
        for x in at:
            if c[x] != c[k] and alike(sets[k], sets[x], plan.similar):
                out.append((node[k], node[x]))
                c[c == c[x]] = c[k]
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


class NearDuplicates:
    """One run: sketches and band members are written once, every member is tried against its bucket's least one, and
    buckets that then still hold two components are compared in full."""

    def __init__(self, docs: DataFrame, plan: Plan):
        self.plan, self.docs = plan, docs.select("doc_id", "text")
        rows = self.docs.mapInArrow(tidy(lambda b: sketch_rows(b, plan)), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, marks binary")
        self.sketches = durable(rows, "sketches")
        self.n = self.sketches.count()
        # one representative of equal sets; minima combine before the shuffle, so a hot set is one row per task
        first = F.min_by(F.struct("n_shingles", "bands", "marks"), "doc_id").alias("s")
        self.reps = durable(
            self.sketches.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), first).select("k1", "k2", "node", "s.n_shingles", "s.bands", "s.marks"),
            "representatives",
            self.n,
        )
        members = self.reps.select("node", "n_shingles", F.explode("bands").alias("bucket"))
        shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), (8 * F.sum("n_shingles")).alias("size"), F.min("node").alias("pivot")).where("n > 1")
        self.members = durable(members.drop("n_shingles").join(shared, "bucket"), "members", self.n)

    def similar_pairs(self, pairs: DataFrame) -> DataFrame:
        marks = self.reps.select("node", "marks")
        rows = pairs.join(marks.select(F.col("node").alias("u"), F.col("marks").alias("mu")), "u").join(marks.select(F.col("node").alias("v"), F.col("marks").alias("mv")), "v")
        plan = self.plan
        return rows.mapInPandas(lambda f: agreeing(f, plan), "u long, v long")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles): the full sets of just the documents in question, computed anew."""
        nodes = nodes.distinct().toDF("doc_id")
        wanted = self.docs.join(small_broadcast(nodes), "doc_id", "left_semi")
        width = self.plan.width
        return durable(wanted.mapInArrow(tidy(lambda b: set_rows(b, width)), "node long, shingles binary").dropDuplicates(["node"]), "sets", self.n)

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Compare the full sets of pairs."""
        similar = self.plan.similar
        sets = self.sets(pairs.select(F.col("u").alias("node")).union(pairs.select("v")))
        rows = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v")
        out = durable(rows.select("u", "v", "su", "sv").mapInArrow(tidy(lambda b: confirmed(b, similar)), "u long, v long"), "links", self.n)
        discard(sets)
        return out

    def components(self) -> DataFrame:
        """(node, component) of representatives that are linked to another one."""
        star = self.members.where("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
        tried = durable(self.similar_pairs(star), "pairs", self.n)
        links = self.confirm(tried)
        discard(tried)
        labels = connected_components(links)
        # buckets that are not yet one component; those of two members have been tried
        labelled = self.members.where("n > 2").join(labels.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
        mixed = labelled.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("bucket")
        active = durable(labelled.join(mixed, "bucket").select("bucket", "node", "c", "n", "size"), "active", self.n)
        return connected_components(links.unionByName(self.across(active)))

    def across(self, active: DataFrame) -> DataFrame:
        """Links between different components within a bucket, by blocks of members.

        A large bucket is cut into blocks of so many members and bytes, and each pair of blocks is a group of its own. A
        group has signatures and full sets, so only links leave it, at most one fewer than its members; of the buckets
        that a pair shares, only the first compares it.
        """
        plan = self.plan
        blocks = F.greatest(F.ceil(F.col("n") / F.lit(plan.block)), F.ceil(F.col("size") / F.lit(plan.block_bytes))).cast("int")
        mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
        spread = active.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        spread = spread.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "c")
        sets = self.sets(active.select("node"))
        facts = self.reps.select("node", "bands", "marks").join(sets, "node")
        links = durable(spread.join(facts, "node").groupBy("bucket", "i", "j").applyInPandas(lambda f: links_of(f, plan), "u long, v long"), "links", 4 * self.n)
        discard(sets)
        return links


def near_duplicates(docs: DataFrame, plan: Plan = CONTRACT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept, for every document.

    Null, empty and blank texts have no shingles and are linked with nothing. Equal sets share one representative, so
    copies are never paired with one another. Rows that repeat a doc_id keep their own size and share its component.
    """
    run = NearDuplicates(docs, plan)
    parts = run.components()
    classes = run.reps.select("k1", "k2", "node").join(parts, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("root"))
    # a component's name is the smallest doc_id of all its copies; representatives already are the smallest of theirs
    out = run.sketches.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, plan: Plan = STAGE) -> DataFrame:
    """Rows of `docs` less all but the first document of each near-duplicate group; all columns stay."""
    return less(docs, near_duplicates(docs, plan).where("not kept").select("doc_id"))
