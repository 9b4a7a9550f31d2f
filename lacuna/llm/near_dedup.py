"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

A text is the multiset of its five-word shingles. A shingle weighs its count times an inverse
document frequency of ``1 + ln((1 + N) / (1 + df)) / ln(2 + N)``, between 1 and 2, so that a passage
that everyone quotes counts less, and a large group of copies does not vanish by its own size. ``df``
is counted over all documents, for each 44-bit shingle hash on its own.

1. Write the shingles of every document, in blocks of documents (one scan); count each shingle in the
bucket of its hash range, which gets it once a block; send the counts above one back to the blocks.
2. Draw ``bands * rows`` samples per text; a sample is the shingle and level that consistent weighted sampling picks, equal for two texts with the probability
of their weighted Jaccard similarity. 3. Texts that share a band are candidates. A bucket is never
expanded into all its pairs: its most common-place member is compared with the others (``stars``
times, the later times only among those not yet linked to it). Members that then still are in other
classes than the rest go through a join on the rarest shingles: of two texts with similarity t, each
has a shared shingle within its rarest 1 - t of weight, and the weights after it bound the
similarity. That join keeps every pair that can reach t, so no candidate link is lost. 4. Every pair
is verified by its exact weighted Jaccard similarity. 5. Classes are the connected texts.

Equal texts are one node from the start. NULL is the empty text; texts without words are linked only
to equal texts; texts of fewer than five words have one shingle of all their words. Rows may repeat.
A NULL doc_id is a row like others and never names a class unless all its members have none.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.base import components, documents, keep, small_batches, table, text_key
from lacuna.llm.words import mix, runs, shingles, word_hashes

CELL_BITS = 20
HASH_BITS = 44
BUCKET_SHINGLES = 1 << 20
LEAST_BUCKETS = 64
DRAW_BITS = 16
BLOCK_ELEMENTS = 1 << 16
PLACES = (1 << np.arange(8)).astype(np.uint8)


@dataclass(frozen=True)
class Settings:
    similarity: float = 0.8
    bands: int = 10
    rows: int = 4
    stars: int = 2


def _texts(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("text").cast(pa.string())


def counted(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per run of rows: lo, hi, row of each distinct shingle (from lo), its 44-bit hash, its count."""
    for lo, hi in runs(texts):
        hashed, offsets = word_hashes(texts.slice(lo, hi - lo))
        values, offsets = shingles(hashed, offsets)
        row = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(offsets))
        key = np.sort((row << np.uint64(HASH_BITS)) | (values >> np.uint64(64 - HASH_BITS)))
        first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([first, [len(key)]]))
        key = key[first]
        yield lo, hi, (key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1), count


def cells(values: np.ndarray) -> np.ndarray:
    """Hash range of every shingle, of 2**20; buckets are made of them."""
    return (values >> np.uint64(HASH_BITS - CELL_BITS)).astype(np.int64)


def _pack(values: np.ndarray) -> bytes:
    """Ascending integers in Rice's code: their number, the first one and the number of low bits; of every
    step the whole low bytes, then its other low bits, then the running sum of what is above, in unary."""
    if not len(values):
        return b""
    values = values.astype("<u8", copy=False)
    steps = values[1:] - values[:-1]
    bits = max(0, ((int(values[-1]) - int(values[0])) // max(1, len(steps))).bit_length() - 1)
    whole, rest = divmod(bits, 8)
    raw = steps.view(np.uint8).reshape(-1, 8)
    parts = [np.array([len(values), values[0], bits], "<u8").tobytes(), raw[:, :whole].tobytes()]
    if rest:
        parts.append(np.packbits(np.unpackbits(raw[:, whole : whole + 1], axis=1, count=rest, bitorder="little"), bitorder="little").tobytes())
    ends = np.cumsum((steps >> np.uint64(bits)).view(np.int64) + 1)
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    return b"".join(parts) + np.packbits(unary).tobytes()


def _unpack(packed: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(packed.as_buffer(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    n, first, bits = raw[:24].view("<u8").tolist()
    whole, rest = divmod(bits, 8)
    at = 24 + (n - 1) * whole
    low = np.zeros((n, 8), np.uint8)
    low[1:, :whole] = raw[24:at].reshape(n - 1, whole)
    if rest:
        stop = at + -(-(n - 1) * rest // 8)
        low[1:, whole] = np.unpackbits(raw[at:stop], count=(n - 1) * rest, bitorder="little").reshape(n - 1, rest) @ PLACES[:rest]
        at = stop
    values = low.view("<u8").ravel()
    values[0] = first
    values = np.cumsum(values, dtype=np.uint64)
    above = np.flatnonzero(np.unpackbits(raw[at:]).view(bool)).astype(np.uint64) - np.arange(1, n, dtype=np.uint64)
    values[1:] += above << np.uint64(bits)
    return values


def _pack_numbers(numbers: np.ndarray) -> bytes:
    """Integers below 2**32 as byte planes; the upper planes are mostly zeros, which compress."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(packed: pa.Scalar) -> np.ndarray:
    planes = np.frombuffer(packed.as_buffer(), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _joined(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def shingled(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, node, block, n, its n distinct shingles and their counts."""

    def cut(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, row, values, count in counted(_texts(batch)):
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                spans = list(zip(ends[:-1], ends[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        batch.column("node").slice(lo, hi - lo),
                        pa.array(np.full(hi - lo, block)),
                        pa.array(np.diff(ends).astype(np.int64)),
                        pa.array([_pack(values[x:y]) for x, y in spans], pa.binary()),
                        pa.array([_pack_numbers(count[x:y]) for x, y in spans], pa.binary()),
                    ],
                    names=["doc_id", "node", "block", "n", "shingles", "counts"],
                )
                block += 1

    return docs.select("doc_id", text_key().alias("node"), "text").mapInArrow(cut, "doc_id long, node binary, block long, n long, shingles binary, counts binary")


def frequencies(cut: DataFrame, total: int) -> DataFrame:
    """Per block the shingles that more than one document has, with their document frequencies.

    ``total`` is the number of shingles of all documents. It sets the number of buckets, so that none
    holds many; a shingle that is everywhere comes once a block and batch.
    """
    buckets = min(1 << CELL_BITS, max(LEAST_BUCKETS, -(-total // BUCKET_SHINGLES)))

    def deal(batches):
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for block in np.unique(blocks):
                values = np.concatenate([_unpack(batch.column("shingles")[int(i)]) for i in np.nonzero(blocks == block)[0]])
                values, n = np.unique(values, return_counts=True)
                bucket = cells(values) * buckets >> CELL_BITS
                found, starts = np.unique(bucket, return_index=True)
                spans = list(zip(starts, np.append(starts[1:], len(values))))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.astype(np.int64)),
                        pa.array(np.full(len(found), block)),
                        pa.array([_pack(values[x:y]) for x, y in spans], pa.binary()),
                        pa.array([_pack_numbers(n[x:y]) for x, y in spans], pa.binary()),
                    ],
                    names=["bucket", "block", "shingles", "df"],
                )

    def count(rows):
        parts = [_unpack(x) for x in rows.column("shingles")]
        n = np.concatenate([_numbers(x) for x in rows.column("df")])
        _, which = np.unique(np.concatenate(parts), return_inverse=True)
        df = np.bincount(which, weights=n).astype("<u4")[which]
        shared = []
        for part, own in zip(parts, np.split(df, np.cumsum([len(x) for x in parts])[:-1])):
            shared.append((_pack(part[own > 1]), _pack_numbers(own[own > 1])))
        return pa.table({"block": rows.column("block"), "shingles": pa.array([x for x, _ in shared], pa.binary()), "df": pa.array([x for _, x in shared], pa.binary())})

    dealt = cut.filter("n > 0").select("block", "shingles").mapInArrow(deal, "bucket long, block long, shingles binary, df binary")
    found = dealt.groupBy("bucket").applyInArrow(count, "block long, shingles binary, df binary")
    return found.filter("length(shingles) > 0")


def inverse_frequencies(df: np.ndarray, n: int) -> np.ndarray:
    """Weight of one occurrence of a shingle, by the number of documents that have it."""
    return (1 + np.log((1 + n) / (1 + np.minimum(np.asarray(df, np.float64), n))) / np.log(2 + n)).astype(np.float32)


class Sampler:
    """Consistent weighted samples of rows of weighted shingles.

    For sample k a shingle draws r, c from Gamma(2, 1) and b uniform by its hash, takes the level
    ``t = floor(ln w / r + b)`` and the key ``ln c - r (t - b + 1)``; the least key wins. Draws come
    from a table of 2**16 entries, found by a hash per sample; further hash bits break ties. Key and
    bits name shingle and level, so they are the sample.
    """

    def __init__(self, samples: int):
        rng = np.random.default_rng(20240131)
        u = 1 - rng.random((5, 1 << DRAW_BITS))
        self.r = -np.log(u[0] * u[1]).astype(np.float32)
        self.log_c = np.log(-np.log(u[2] * u[3])).astype(np.float32)
        self.b = u[4].astype(np.float32)
        self.odd = rng.integers(1, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, values: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """int64 samples, one row per start, one column per sample."""
        out = np.empty((len(starts), len(self.odd)), np.int64)
        log_w = np.log(weights.astype(np.float32))
        wide = values << np.uint64(64 - HASH_BITS)
        for k, odd in enumerate(self.odd):
            h = wide * odd
            at = (h >> np.uint64(64 - DRAW_BITS)).astype(np.int32)
            r, b = self.r[at], self.b[at]
            t = np.floor(log_w / r + b)
            key = (self.log_c[at] - r * (t - b + 1)).view(np.int32)
            key ^= (key >> 31) & np.int32(0x7FFFFFFF)  # the order of floats, as integers
            tie = ((h >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            out[:, k] = np.minimum.reduceat((key.astype(np.int64) << 32) | tie, starts)
        return out


def _blocks(starts: np.ndarray, total: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about BLOCK_ELEMENTS elements: arrays that stay in a core's cache."""
    lo = 0
    ends = np.append(starts[1:], total)
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + BLOCK_ELEMENTS, "right")))
        yield lo, hi
        lo = hi


def signatures(cut: DataFrame, found: DataFrame, n: int, s: Settings) -> DataFrame:
    """Per row of ``shingled``: doc_id, node, rank (mean weight), the keys of its bands and the document
    frequencies of its shingles. A text without words has no bands.

    ``found`` are the frequencies above one of every block; what is not there has one.
    """

    def sign(rows, shared):
        sampler = Sampler(s.bands * s.rows)
        salts = np.arange(1, s.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        known, at = np.unique(_joined([_unpack(x) for x in shared.column("shingles")], np.uint64), return_index=True)
        often = _joined([_numbers(x) for x in shared.column("df")], np.int64)[at]
        keys: list = [None] * rows.num_rows
        rank = np.zeros(rows.num_rows)
        sizes = rows.column("n").to_numpy()
        values = np.concatenate([_unpack(x) for x in rows.column("shingles")])
        count = np.concatenate([_numbers(x) for x in rows.column("counts")])
        df = np.ones(len(values), "<u4")
        if len(known):
            place = np.minimum(np.searchsorted(known, values), len(known) - 1)
            df = np.where(known[place] == values, often[place], 1).astype("<u4")
        if len(values):
            has = np.nonzero(sizes)[0]
            starts = (np.cumsum(sizes) - sizes)[has]
            w = inverse_frequencies(df, n) * count
            rank[has] = np.add.reduceat(w, starts) / np.add.reduceat(count, starts)
            for x, y in _blocks(starts, len(values)):
                a, z = starts[x], starts[y] if y < len(starts) else len(values)
                got = sampler(values[a:z], w[a:z], starts[x:y] - a).view(np.uint64).reshape(y - x, s.bands, s.rows)
                band = np.broadcast_to(salts, (y - x, s.bands)).copy()
                for j in range(s.rows):
                    band = mix(band ^ got[:, :, j])
                for i, keyed in zip(has[x:y], band.view(np.int64)):
                    keys[i] = keyed
        own = [_pack_numbers(x) for x in np.split(df, np.cumsum(sizes)[:-1])]
        return pa.table({"doc_id": rows.column("doc_id"), "node": rows.column("node"), "rank": pa.array(rank), "bands": pa.array(keys, pa.list_(pa.int64())), "df": pa.array(own, pa.binary())})

    schema = "doc_id long, node binary, rank double, bands array<long>, df binary"
    return cut.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(sign, schema)


def vectors(texts: DataFrame, n: int) -> DataFrame:
    """Per row (node, shingles, counts, df): the sorted hashes of its shingles, the n-th occurrence hashed
    with n, and their weights."""

    def build(batches):
        for batch in batches:
            vector, weight = [], []
            for i in range(batch.num_rows):
                value, count = _unpack(batch.column("shingles")[i]), _numbers(batch.column("counts")[i])
                w = np.repeat(inverse_frequencies(_numbers(batch.column("df")[i]), n), count)
                nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                value = np.repeat(value, count)
                more = nth > 0
                value[more] = mix(value[more] + (nth[more].astype(np.uint64) << np.uint64(HASH_BITS))) >> np.uint64(64 - HASH_BITS)
                value, at = np.unique(value, return_index=True)
                vector.append(value.astype("<u8").tobytes())
                weight.append(w[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(vector, pa.binary()), pa.array(weight, pa.binary())], names=["node", "vector", "weight"])

    return texts.select("node", "shingles", "counts", "df").mapInArrow(build, "node binary, vector binary, weight binary")


def weighted_jaccard(x: np.ndarray, x_weight: np.ndarray, y: np.ndarray, y_weight: np.ndarray) -> float:
    """Of two sorted vectors with their weights; two empty ones are not similar."""
    _, at, _ = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = float(x_weight[at].sum(dtype=np.float64))
    union = float(x_weight.sum(dtype=np.float64)) + float(y_weight.sum(dtype=np.float64)) - shared
    return shared / union if union else 0.0


def verified(pairs: DataFrame, vecs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is at least ``least``, with it."""

    def check(batches):
        for batch in batches:
            sides = [(batch.column(c), d) for c, d in (("x", "<u8"), ("xw", "<f4"), ("y", "<u8"), ("yw", "<f4"))]
            sims = np.array([weighted_jaccard(*[np.frombuffer(c[i].as_buffer(), d) for c, d in sides]) for i in range(batch.num_rows)], float)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims)], names=["a", "b", "similarity"])

    joined = pairs.join(vecs.select(F.col("node").alias("a"), F.col("vector").alias("x"), F.col("weight").alias("xw")), "a")
    joined = joined.join(vecs.select(F.col("node").alias("b"), F.col("vector").alias("y"), F.col("weight").alias("yw")), "b")
    return joined.select("a", "b", "x", "xw", "y", "yw").mapInArrow(check, "a binary, b binary, similarity double").filter(F.col("similarity") >= least)


def rare_ends(vecs: DataFrame, least: float) -> DataFrame:
    """Per node the shingles within its rarest ``1 - least`` of weight, with the weight before each."""

    def cut(batches):
        for batch in batches:
            nodes, hashes, before, total = [], [], [], []
            for i in range(batch.num_rows):
                v = np.frombuffer(batch.column("vector")[i].as_buffer(), "<u8")
                w = np.frombuffer(batch.column("weight")[i].as_buffer(), "<f4").astype(np.float64)
                order = np.lexsort((v, -w))
                w = w[order]
                ahead = np.cumsum(w) - w
                n = int(np.searchsorted(ahead, (1 - least) * w.sum() * (1 + 1e-9), "right"))
                nodes += [batch.column("node")[i]] * n
                hashes.append(v[order[:n]].astype(np.int64))
                before.append(ahead[:n])
                total.append(np.full(n, w.sum()))
            if hashes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.binary()), pa.array(np.concatenate(hashes)), pa.array(np.concatenate(before)), pa.array(np.concatenate(total))],
                    names=["node", "shingle", "before", "total"],
                )

    return vecs.select("node", "vector", "weight").mapInArrow(cut, "node binary, shingle long, before double, total double")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``df``: doc_id, node (names the text), class_id (least doc_id of its class),
    class_size (rows of the class), kept (the row that has that id; of several, those of one text)."""
    spark = df.sparkSession
    small_batches(spark)
    docs = documents(df, id_col, text_col)
    cut = keep(shingled(docs), "shingles")
    size = cut.agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("n")).first()
    found = keep(frequencies(cut, size.total or 0), "frequencies")
    signed = keep(signatures(cut, found, size.n, settings), "signatures")
    links = _links(cut, signed, size.n, settings)
    labels = components(links)
    rows = signed.select("doc_id", "node").join(labels, "node", "left").select("doc_id", "node", F.coalesce("comp", "node").alias("comp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node"))
    classes = rows.groupBy("comp").agg(first.alias("first"), F.count("*").alias("class_size"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))
    return rows.join(classes, "comp").select("doc_id", "node", F.col("first.doc_id").alias("class_id"), "class_size", kept.alias("kept"))


def _links(cut: DataFrame, signed: DataFrame, n: int, s: Settings) -> DataFrame:
    """Verified links (a, b) that connect all texts which the bands and the similarity connect."""
    nodes = signed.filter("bands IS NOT NULL").groupBy("node").agg(F.first("rank").alias("rank"), F.first("bands").alias("bands"))
    spread = nodes.select("node", "rank", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct("rank", "node")).alias("least")).filter("n > 1")
    shared = shared.select("band", F.col("least.node").alias("pivot"))
    members = keep(spread.join(shared, "band"), "members")
    candidates = members.select("node").distinct()
    texts = cut.join(candidates, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("counts").alias("counts"))
    texts = texts.join(signed.join(candidates, "node", "left_semi").groupBy("node").agg(F.first("df").alias("df")), "node")
    vecs = keep(vectors(texts, n), "vectors")
    pairs = members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = keep(verified(pairs, vecs, s.similarity), "verified")
    comps = components(links)
    for _ in range(1, s.stars):
        left = _apart(members, comps)
        pivots = left.groupBy("band").agg(F.min(F.struct("rank", "node")).alias("least"), F.count("*").alias("n")).filter("n > 1")
        pairs = left.join(pivots.select("band", F.col("least.node").alias("a")), "band").filter("node <> a")
        more = keep(verified(pairs.select("a", F.col("node").alias("b")).distinct(), vecs, s.similarity), "verified")
        links = links.unionAll(more)
        comps = components(links)
    apart = _apart(members, comps)
    open_bands = apart.select("band").distinct()
    involved = members.join(open_bands, "band", "left_semi").select("node").distinct()
    involved = involved.join(apart.select("node", F.lit(True).alias("outside")).distinct(), "node", "left").join(comps, "node", "left")
    involved = involved.select("node", F.coalesce("outside", F.lit(False)).alias("outside"), F.coalesce("comp", "node").alias("comp"))
    ends = keep(rare_ends(vecs.join(involved, "node", "left_semi"), s.similarity).join(involved, "node"), "rare-ends")
    x, y = ends.filter("outside").alias("x"), ends.alias("y")
    most = F.least(F.col("x.total") - F.col("x.before"), F.col("y.total") - F.col("y.before"))
    can = most >= (s.similarity - 1e-9) * (F.col("x.total") + F.col("y.total") - most)
    again = ~F.col("y.outside") | (F.col("x.node") < F.col("y.node"))  # a pair of two outsiders comes up twice
    pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.comp") != F.col("y.comp")) & again & can)
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    return links.unionAll(verified(pairs, vecs, s.similarity)).select("a", "b")


def _apart(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of buckets that are not in the class of their bucket's first pivot."""
    own = members.join(comps, "node", "left").select("band", "rank", "node", "pivot", F.coalesce("comp", "node").alias("comp"))
    theirs = comps.select(F.col("node").alias("pivot"), F.col("comp").alias("pivot_comp"))
    own = own.join(theirs, "pivot", "left")
    return own.filter(F.col("comp") != F.coalesce("pivot_comp", "pivot")).select("band", "rank", "node", "comp")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document; class_id is its least doc_id."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "kept")
