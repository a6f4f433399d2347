"""Line dedup: a segment-partition edit join finds lines within a few edits of one another; one of each class stays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import BROADCAST_ROWS, connected_components, discard, durable, fresh, tidy
from tarnlake.llm.words import mix

#: Two lines link within one edit for every STEP characters of the shorter one, EDITS at most: equality alone below STEP
#: characters, one edit below 2 * STEP. Equal lines are a class at any length, unless blank.
EDITS, STEP = 2, 20
#: A run of lines under one key is compared at once up to this length; a longer one is cut into blocks of this size.
RUN = 512
#: Rows under keys that are grouped at a time, and lines of which a task remembers that their keys are out.
KEY_ROWS, SEEN = 1 << 16, 1 << 18
#: Characters whose keys are made at a time; substrings of lines from LONG characters on are hashed one by one instead.
KEY_CHARS, LONG = 1 << 18, 1 << 16


def allowed(length: int, edits: int, step: int) -> int:
    """Edits between a line of so many characters and one at least as long."""
    return min(edits, length // step)


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of edits + 1 segments, the longer ones last."""
    parts = edits + 1
    base, extra = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        size = base + (i >= parts - extra)
        out.append((at, size))
        at += size
    return out


def places(length: int, edits: int, step: int = STEP) -> list[tuple[int, int, int, bool]]:
    """(start, size, tag, own) of the substrings of a line: own segments, and those to probe in lines no longer than it.

    A segment i of a line shorter by d can only start, left of its place, as many places off as segments stand before it,
    and counted from the end as many as stand behind it. The tag holds the segment's number and the line's length, which
    sets the edits that are allowed.
    """
    out = []
    for d in range(min(edits, length) + 1):
        most = allowed(length - d, edits, step)
        if d > most or not most:
            continue
        for i, (start, size) in enumerate(segments(length - d, most)):
            low = max(start - i, start + d - (most - i), 0)
            high = min(start + i, start + d + (most - i), length - size)
            for at in range(low, high + 1):
                out.append((at, size, (length - d) * (edits + 1) + i, d == 0 and at == start))
    return out


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most `edits`: common ends cut, then bit-parallel columns on the band of 2 edits + 1 diagonals."""
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    if len(a) < len(b):
        a, b = b, a
    low, high = 0, len(b)
    while low < high:  # the longest common prefix, by halves
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    a, b = a[low:], b[low:]
    low, high = 0, len(b)
    while low < high:
        mid = (low + high + 1) // 2
        if a[len(a) - mid :] == b[len(b) - mid :]:
            low = mid
        else:
            high = mid - 1
    a, b = a[: len(a) - low], b[: len(b) - low]
    if len(a) <= edits:
        return True
    if not b:
        return False
    return banded_distance(a, b, edits) <= edits


def banded_distance(a: str, b: str, edits: int) -> int:
    """Distance of a and b if at most `edits`, else any larger number; len(b) <= len(a) <= len(b) + edits.

    Bit vectors of vertical differences cover rows j - edits to j + edits of column j only, and slide by one row a column.
    """
    m, n, width = len(a), len(b), 2 * edits + 1
    whole = (1 << width) - 1
    # bit r of column j is row j - edits + r (rows from 1); rows of 0 and below only lend their place
    vp, vn = whole & ~((1 << edits) - 1), 0
    at_diagonal, score = 1 << edits, 0  # D at the middle diagonal, row j of column j
    for j in range(1, n + 1):
        c, match = b[j - 1], 0
        first = j - edits
        for r in range(width):
            row = first + r
            if 1 <= row <= m and a[row - 1] == c:
                match |= 1 << r
        d0 = (((match & vp) + vp) ^ vp) | match | vn
        hp = vn | (whole & ~(d0 | vp))
        hn = d0 & vp
        if not d0 & at_diagonal:
            score += 1
        if score > 2 * edits:
            return edits + 1
        shifted = (d0 & whole) >> 1
        vp = (hn & whole) | (whole & ~(shifted | hp))
        vn = shifted & hp & whole
    # from D(n, n) down the last column to D(m, n), by the vertical differences of the last band (already slid by a row)
    for r in range(m - n):
        bit = 1 << (edits + r)
        score += 1 if vp & bit else -1 if vn & bit else 0
    return score


_SHIFTS = np.arange(0, 60, 4, dtype=np.uint64)


def far_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of twice the edit distance from two arrays of histograms."""
    total = np.zeros(len(a), np.int64)
    for s in _SHIFTS:
        d = (((a >> s) & np.uint64(15)).astype(np.int64) - ((b >> s) & np.uint64(15)).astype(np.int64)) % 16
        total += np.minimum(d, 16 - d)
    return total


def distinct_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different lines of a batch of texts, the number of each line of each text among them, and lines a text (null: none)."""
    lists = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def digests(lines: list[str]) -> np.ndarray:
    """Two 64-bit hashes of each line: its node, and a check."""
    import xxhash

    whole = b"".join([xxhash.xxh3_128_digest(line.encode()) for line in lines])
    return np.frombuffer(whole, ">i8").reshape(-1, 2)[:, ::-1].astype(np.int64)


def line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, line, node, check: two hashes of every line that is not blank."""
    for batch in batches:
        known, codes, counts = distinct_lines(batch.column(1))
        lines = known.to_pylist()
        own, full = digests(lines), np.array([bool(x) and not x.isspace() for x in lines], bool)
        keep = full[codes] if len(codes) else np.zeros(0, bool)
        numbers = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
        docs = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)[keep]))
        found = own[codes[keep]]
        yield pa.RecordBatch.from_arrays([docs.cast(pa.int64()), pa.array(numbers[keep].astype(np.int32)), pa.array(found[:, 0]), pa.array(found[:, 1])], ["doc_id", "line", "node", "check"])


_BASE = 0x9E3779B97F4A7C15
_UNDO = pow(_BASE, -1, 1 << 64)


def powers(base: int, count: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64."""
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def slices(lines: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of lines of about so many characters in all."""
    at, size = 0, 0
    for i, line in enumerate(lines):
        size += len(line)
        if size >= chars:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(lines):
        yield at, len(lines)


def line_keys(lines: list[str], spots_of: Callable[[int], tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line number, own) of the substrings that `spots_of` names for each length.

    A key is the polynomial hash of a substring, from differences of running sums over the line, mixed with its tag.
    """
    sizes = np.array([len(x) for x in lines])
    begin = np.cumsum(sizes) - sizes
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4")
    place = np.arange(len(codes)) - np.repeat(begin, sizes)
    up, down = powers(_BASE, int(sizes.max())), powers(_UNDO, int(sizes.max()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up[place], dtype=np.uint64)])
    order = np.argsort(sizes, kind="stable")
    keys, owners, owns = [], [], []
    for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        at, length, tag, own = spots_of(int(sizes[group[0]]))
        from_ = begin[group][:, None] + at
        keys.append(mix((sums[from_ + length] - sums[from_]) * down[at] + mix(tag)).ravel())
        owners.append(np.repeat(group, len(at)))
        owns.append(np.tile(own, len(group)))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(owns)


def key_rows(batches: Iterator[pa.RecordBatch], edits: int, step: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> key, node, shape for every different line of a task, as far as SEEN reaches.

    shape holds 15 counts mod 16 of character classes in 60 bits (an edit moves their circular distance by at most 2), and
    in the lowest bit whether the substring is an own segment. The length that a tag holds decides how its substring is
    hashed, so both lines of a pair do it alike.
    """
    import xxhash

    cut: dict[int, tuple] = {}

    def spots_of(size: int) -> tuple:
        if size not in cut:
            if len(cut) > 20_000:
                cut.clear()
            kept = [x for x in places(size, edits, step) if x[2] // (edits + 1) < LONG]
            at, length, tag, own = zip(*kept, strict=True) if kept else ((), (), (), ())
            cut[size] = np.array(at, np.int64), np.array(length, np.int64), np.array(tag, np.uint64), np.array(own, bool)
        return cut[size]

    def rows(keys, owner, owns, lines, nodes) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in lines])
        codes = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4")
        shapes = np.bincount(np.repeat(np.arange(len(lines)) * 15, sizes) + codes % 15, minlength=15 * len(lines)).reshape(-1, 15) & 15
        shapes = (shapes.astype(np.uint64) << (_SHIFTS + np.uint64(1))).sum(1, dtype=np.uint64)
        shape = shapes[owner] | owns.astype(np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes[owner]), pa.array(shape.view(np.int64))], ["key", "node", "shape"])

    seen = np.zeros(0, np.int64)
    for batch in batches:
        known, *_ = distinct_lines(batch.column(1))
        lines = known.filter(pc.greater_equal(pc.utf8_length(known), step)).to_pylist()
        nodes = np.ascontiguousarray(digests(lines)[:, 0])
        new = np.flatnonzero(~np.isin(nodes, seen))
        lines, nodes = [lines[i] for i in new.tolist()], nodes[new]
        seen = np.concatenate([seen if len(seen) < SEEN else seen[:0], nodes])
        short = [i for i, x in enumerate(lines) if len(x) < LONG + edits]
        some, ids = [lines[i] for i in short], nodes[short]
        for a, b in slices(some, KEY_CHARS):
            yield rows(*line_keys(some[a:b], spots_of), some[a:b], ids[a:b])
        for i, line in enumerate(lines):
            if len(line) >= LONG:
                far = [x for x in places(len(line), edits, step) if x[2] // (edits + 1) >= LONG]
                keys = np.array([xxhash.xxh3_64_intdigest(line[at : at + n].encode(), tag) for at, n, tag, _ in far], np.uint64)
                yield rows(keys, np.zeros(len(far), np.int64), np.array([x[3] for x in far], bool), [line], nodes[i : i + 1])


PAIRS = "u long, v long, key long, shape long"


def joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """Columns of at least so many rows at a time."""
    held, n = [], 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        n += batch.num_rows
        if n >= rows:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def run_rows(batches: Iterator[pa.RecordBatch], edits: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> candidate pairs (u, v) of short runs; members (u null) of the runs above RUN.

    Rows that repeat are dropped as they come (a line has its keys from several tasks). At most one short run is held from
    one stretch of rows to the next, so a very long run passes through in a stream.
    """
    held = [np.zeros(0, np.int64)] * 3
    long_key = None
    names = ["u", "v", "key", "shape"]

    def pairs(key, node, shape) -> pa.RecordBatch:
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        again = np.concatenate([[False], key[1:] == key[:-1]])
        some = again | np.concatenate([again[1:], [False]])
        key, node, shape = key[some], node[some], shape[some].view(np.uint64)
        d = 1
        while d < len(key):
            i = np.flatnonzero(key[d:] == key[:-d])
            if not len(i):
                break
            j = i + d
            ok = ((shape[i] | shape[j]) & np.uint64(1)).astype(bool) & (node[i] != node[j])
            i, j = i[ok], j[ok]
            ok = far_apart(shape[i] >> np.uint64(1), shape[j] >> np.uint64(1)) <= 2 * edits
            i, j = i[ok], j[ok]
            us.append(np.maximum(node[i], node[j]))
            vs.append(np.minimum(node[i], node[j]))
            d += 1
        u, v = np.concatenate(us), np.concatenate(vs)
        if len(u):
            u, v = np.unique(np.stack([u, v]), axis=1)
        n = len(u)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)

    def members(key, node, shape) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.int64()), pa.array(node), pa.array(key), pa.array(shape)], names)

    for rows in joined(batches, KEY_ROWS):
        rows = [np.concatenate([h, c]) for h, c in zip(held, rows, strict=True)]
        order = np.lexsort((rows[2], rows[1], rows[0]))
        rows = [c[order] for c in rows]
        new = np.ones(len(order), bool)
        new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])
        rows = [c[new] for c in rows]
        if long_key is not None:
            n = int((rows[0] == long_key).sum())  # sorted, so these come first
            if n:
                yield members(*[c[:n] for c in rows])
            rows = [c[n:] for c in rows]
            if not len(rows[0]):
                held = rows
                continue
            long_key = None
        starts = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(rows[0])]]))
        big = np.repeat(sizes > RUN, sizes)
        last = int(starts[-1])
        if big.any():
            yield members(*[c[big] for c in rows])
        if sizes[-1] > RUN:
            long_key, held = rows[0][-1], [c[:0] for c in rows]
        else:
            held = [c[last:] for c in rows]
        yield pairs(*[c[np.flatnonzero(~big[:last])] for c in rows])
    yield pairs(*held)


def block_pairs(rows: DataFrame, edits: int) -> DataFrame:
    """Candidate pairs of the runs above RUN: each pair of blocks of a run is a group of its own."""
    counted = rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    blocks = F.ceil(F.col("n") / F.lit(RUN)).cast("int")
    spread = counted.withColumn("mine", F.pmod(F.xxhash64("v"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", F.col("v").alias("node"), "shape")

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        f = f.drop_duplicates(["node", "shape"])
        i, j = int(f["i"].iloc[0]), int(f["j"].iloc[0])
        node, mine, shape = f["node"].to_numpy(), f["mine"].to_numpy(), f["shape"].to_numpy().view(np.uint64)
        own, shape = (shape & np.uint64(1)).astype(bool), shape >> np.uint64(1)
        us, vs = [], []
        for k in np.flatnonzero(mine == i):
            at = np.flatnonzero((mine == j) & (own | own[k]) & (node != node[k] if i != j else node > node[k]))
            at = at[far_apart(shape[at], np.full(len(at), shape[k])) <= 2 * edits]
            us.append(np.maximum(node[at], node[k]))
            vs.append(np.minimum(node[at], node[k]))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pd.DataFrame({"u": cat(us), "v": cat(vs)})

    return spread.groupBy("key", "i", "j").applyInPandas(compare, "u long, v long")


def wanted_lines(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> node, content of every different line of a batch, as far as it can have links."""
    for batch in batches:
        known, *_ = distinct_lines(batch.column(1))
        known = known.filter(pc.greater_equal(pc.utf8_length(known), step))
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(digests(known.to_pylist())[:, 0])), known.cast(pa.string())], ["node", "content"])


def links(docs: DataFrame, edits: int = EDITS, step: int = STEP) -> DataFrame:
    """(u, v) for every pair of different lines within the edits that the shorter one allows (nodes are line hashes)."""
    keys = docs.mapInArrow(tidy(lambda b: key_rows(b, edits, step)), "key long, node long, shape long")
    found = durable(keys.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(lambda b: run_rows(b, edits)), PAIRS), "line-pairs")
    short = found.where("u is not null").select("u", "v")
    pairs = durable(short.unionByName(block_pairs(found.where("u is null"), edits)).distinct(), "line-pairs")
    discard(found)
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    few = nodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    lines = docs.mapInArrow(tidy(lambda b: wanted_lines(b, step)), "node long, content string")
    lines = durable(lines.join(F.broadcast(nodes) if few else nodes, "node", "left_semi").dropDuplicates(["node"]), "lines")
    rows = pairs.join(lines.select(F.col("node").alias("u"), F.col("content").alias("cu")), "u").join(lines.select(F.col("node").alias("v"), F.col("content").alias("cv")), "v")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.loc[np.array([within(a, b, allowed(min(len(a), len(b)), edits, step)) for a, b in zip(f["cu"], f["cv"], strict=True)], bool), ["u", "v"]]

    out = durable(rows.mapInPandas(verify, "u long, v long"), "line-links")
    discard(pairs)
    discard(lines)
    return out


def dropped_lines(docs: DataFrame, edits: int = EDITS, step: int = STEP) -> DataFrame:
    """(doc_id, line, class_id): every line but the first of its class, lines in order of doc_id and number.

    A class holds equal lines, however short, and all that links reach, which allow one edit for every `step` characters
    of the shorter line and `edits` at most; class_id is its smallest node.
    """
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    found = durable(texts.mapInArrow(tidy(line_rows), "doc_id long, line int, node long, check long"), "occurrences")
    linked = links(texts, edits, step)
    parts = durable(connected_components(linked), "line-classes")
    discard(linked)
    heads = found.groupBy("node").agg(F.min(F.struct("doc_id", "line")).alias("head"), F.count(F.lit(1)).alias("n"))
    named = heads.join(parts, "node", "left").withColumn("class_id", F.coalesce("component", "node"))
    first = named.groupBy("class_id").agg(F.min("head").alias("first"), F.sum("n").alias("lines")).where("lines > 1")
    repeated = durable(named.select("node", "class_id").join(first, "class_id").select("node", "class_id", "first"), "repeated")
    return found.join(repeated, "node").where(F.struct("doc_id", "line") != F.col("first")).select("doc_id", "line", "class_id").distinct()


def line_dedup(docs: DataFrame, edits: int = EDITS, step: int = STEP) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (line numbers from 0), class_ids of those, for every row.

    Null texts have no lines, empty ones a line of no characters; blank lines always stay. Rows that repeat a doc_id are
    one document. Rows without doc_id keep all lines.
    """
    gone = dropped_lines(docs, edits, step).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("line", "class_id"))).alias("gone"))
    ends = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    rows = docs.select("doc_id", F.coalesce(ends + 1, F.lit(0)).cast("long").alias("n_lines"))
    out = rows.join(gone.withColumnRenamed("doc_id", "__d"), F.col("doc_id") == F.col("__d"), "left")
    lines = F.coalesce(F.col("gone.line"), F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(lines).cast("long").alias("n_dropped"), lines.alias("dropped"), F.coalesce(F.col("gone.class_id"), F.array().cast("array<bigint>")).alias("class_ids"))


def drop_lines(docs: DataFrame, edits: int = EDITS, step: int = STEP) -> DataFrame:
    """`docs` with repeated lines taken out of the text; documents of which nothing but blanks is left go. All columns stay."""
    key, gone = fresh(docs, "key"), fresh(docs, "gone")
    found = dropped_lines(docs, edits, step).groupBy("doc_id").agg(F.collect_set("line")).toDF(key, gone)
    rows = docs.join(found, F.col("doc_id") == F.col(key), "left")
    same = F.col(gone).isNull()
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i))
    columns = {"text": F.when(same, F.col("text")).otherwise(F.array_join(kept, "\n"))}
    rows = rows.withColumns(columns).where(same | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
