"""Problem 6: texts that share most of their word sequences.

Method, in part as named: a segment-popcount embedding of each text's shingle fingerprint, whose Manhattan distance
is a lower bound of the symmetric difference, a grid range-join under it, then an exact check. The grid does not
bring the texts of a whole collection together: at a similarity of 0.5, two texts of n shingles may differ in two thirds of n,
while unrelated texts differ in little more than that in their segment counts, so cells of any affordable number of
segments hold a constant share of all pairs (figures in the README). Bands of minimum hashes come first; the
range-join searches the classes that large bands bring together, and the bound discards all other candidates
that the exact check need not see. It loses none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.split import body_start
from knotwork.operators.joins import hot_keys
from knotwork.store import written

SHINGLE, LEAST_WORDS, LEAST_SIMILARITY = 3, 20, 0.5
#: A pair of similarity s shares a band with probability 1 - (1 - s**ROWS)**BANDS: 0.999 at 0.55, 0.99995 at 0.6.
BANDS, ROWS = 72, 4
SEGMENTS = 64
#: Classes of a band taken together in one step; those of a larger band are searched by the grid range-join.
BLOCK = 64
#: A band with a greater share of all rows is never brought together in one task (each text has BANDS rows).
HOT_SHARE = 0.001
#: Classes in a block of the grid range-join.
GRID_ROWS = 1024
#: A group of exact copies is spelled out in pairs up to this size; beyond, each copy is paired with the first.
COPIES = 200

_WORD = re.compile(r"[^\W_]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240607)
    return r.integers(1 << 62, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(1 << 63, size=n, dtype=np.uint64)


_A, _X = _multipliers(BANDS * ROWS)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Shingler:
    def __init__(self, size: int = SHINGLE, keep: int = 500_000):
        self.size, self.keep = size, keep
        self.words: dict[str, int] = {}

    def words_of(self, heading: str | None, text: str) -> list[str]:
        return _WORD.findall(text[body_start(heading, text) :].lower())

    def shingles(self, words: list[str]) -> np.ndarray:
        """Hashes of the distinct runs of `size` words, sorted."""
        known, codes = self.words, []
        for w in words:
            c = known.get(w)
            if c is None:
                if len(known) >= self.keep:
                    known.clear()
                c = known[w] = xxhash.xxh3_64_intdigest(w)
            codes.append(c)
        h = np.array(codes, np.uint64)
        n = len(h) - self.size + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for k in range(self.size):
            out = _mixed(out * _MIX[1] + h[k : k + n] * _MIX[k % len(_MIX)] + np.uint64(k + 1))
        return np.unique(out)


def bands(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of minimum hashes."""
    low = np.empty(BANDS * ROWS, np.uint64)
    low[:] = np.iinfo(np.uint64).max
    for at in range(0, len(shingles), 4096):  # long texts in parts
        np.minimum(low, ((shingles[at : at + 4096, None] ^ _X) * _A).min(axis=0), out=low)
    low = _mixed(low).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[0]
    for k in range(ROWS):
        key = _mixed(key * _MIX[1] + low[:, k])
    return key.view(np.int64)


def segment_counts(shingles: np.ndarray) -> np.ndarray:
    """The popcount of each segment of the fingerprint: bits are shingles, segments are ranges of their hashes."""
    return np.bincount((shingles >> np.uint64(58)).astype(np.int64), minlength=SEGMENTS)


def may_be_similar(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """For pairs of rows: False only where no sets of these segment counts can reach the similarity.

    The Manhattan distance is at most the symmetric difference d, also where counts are cut off at 255, and
    similarity is (na + nb - d) / (na + nb + d).
    """
    d = np.abs(a.astype(np.int16) - b.astype(np.int16)).sum(axis=1)
    return (na + nb - d) >= least * (na + nb + d)


def sketches(chunks: DataFrame) -> DataFrame:
    """chunk_id, class (a hash of the words of the body), band keys, and embedding of bodies with enough words.

    Bands and embedding are given once for each class and task: copies need none of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = Shingler(), set()
        for b in batches:
            ids, classes, keys, ends, counts, sizes = [], [], [], [0], [], []
            for cid, heading, text in zip(*(c.to_pylist() for c in b.columns)):
                words = make.words_of(heading, text)
                if len(words) < LEAST_WORDS:
                    continue
                c = xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63)
                ids.append(cid)
                classes.append(c)
                if c not in seen:
                    seen.add(c)
                    own = make.shingles(words)
                    keys.append(bands(own))
                    counts.append(np.minimum(segment_counts(own), 255).astype(np.uint8).tobytes())
                    sizes.append(len(own))
                else:
                    counts.append(None)
                    sizes.append(None)
                ends.append(BANDS * len(keys))
            if ids:
                flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(classes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())), pa.array(counts, pa.binary()), pa.array(sizes, pa.int32())], ["chunk_id", "class", "bands", "counts", "n"])

    usable = chunks.where("text IS NOT NULL AND chunk_id IS NOT NULL").select("chunk_id", "heading", "text")
    return usable.mapInArrow(run, "chunk_id string, class bigint, bands array<bigint>, counts binary, n int")


def _pairs_of(members: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(len(members), 1)
    return np.stack([members[i], members[j]], 1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by band and class: pairs (large null) of small bands, and the rows of large ones.

    Only one small band is held at a time: once it has more than BLOCK classes, its rows go out as they come.
    """
    band: int | None = None
    held: list[int] = []
    large = False

    def close() -> Iterator[np.ndarray]:
        if not large and len(held) > 1:
            yield _pairs_of(np.array(held, np.int64))

    for b in batches:
        keys, classes = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        if not len(keys):
            continue
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])
        keys, classes = keys[fresh], classes[fresh]
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        pairs: list[np.ndarray] = []
        big: list[tuple[int, np.ndarray]] = []
        spans = np.diff(cuts)
        alone = spans == 1
        # most bands have one class; of these only the first and last of a batch may go on in another
        for k in sorted({0, len(spans) - 1} | set(np.flatnonzero(~alone).tolist())):
            key, members = int(keys[cuts[k]]), classes[cuts[k] : cuts[k + 1]]
            if key == band:
                new = [m for m in members.tolist() if not held or m != held[-1]]
            else:
                pairs += close()
                band, held, large, new = key, [], False, members.tolist()
            if large:
                big.append((key, np.array(new, np.int64)))
                held = new[-1:] or held
            else:
                held += new
                if len(held) > BLOCK:
                    big.append((key, np.array(held, np.int64)))
                    large, held = True, held[-1:]
        yield from _rows(pairs, big)
    yield from _rows(list(close()), [])


def _rows(pairs: list[np.ndarray], big: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    names = ["a", "b", "large"]
    if pairs:
        p = np.concatenate(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.nulls(len(p), pa.int64())], names)
    for key, members in big:
        yield pa.RecordBatch.from_arrays([pa.array(members), pa.nulls(len(members), pa.int64()), pa.array(np.full(len(members), key, np.int64))], names)


def _split(rows: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """Of rows(band, class): the pairs (a, b) of bands of at most BLOCK classes, and the rows (band, class) of larger ones.

    A band with more than HOT_SHARE of the rows is known by a sketch and goes to the large ones where it stands, so that no task gets it whole.
    """
    hot = hot_keys(rows, "band", HOT_SHARE)
    marked = rows.join(F.broadcast(hot), "band", "left")
    found = written(marked.where("__hot IS NULL").select("band", "class").repartition("band").sortWithinPartitions("band", "class").mapInArrow(_runs, "a bigint, b bigint, large bigint"), tag)
    pairs = found.where("large IS NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    large = found.where("large IS NOT NULL").select(F.col("large").alias("band"), F.col("a").alias("class"))
    return pairs, large.unionByName(marked.where("__hot").select("band", "class")).distinct()


def _grid_pairs(least: float):
    """Pairs of a cell whose segment counts are near enough: of two blocks, or of one with itself.

    The cell is searched a row of blocks of vectors at a time; nothing but pairs within the bound goes out.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        i, j = key[1].as_py(), key[2].as_py()
        block, classes, n = t.column("block").to_numpy(), t.column("class").to_numpy(), t.column("n").to_numpy()
        counts = np.frombuffer(b"".join(t.column("counts").to_pylist()), np.uint8).reshape(len(t), SEGMENTS).astype(np.int16)
        x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = [], []
        for at in range(0, len(x), 64):
            own = x[at : at + 64]
            d = np.abs(counts[own][:, None] - counts[y][None]).sum(axis=2)
            p, q = np.nonzero((n[own][:, None] + n[y][None] - d) >= least * (n[own][:, None] + n[y][None] + d))
            p, q = classes[own[p]], classes[y[q]]
            keep = p < q if i == j else p != q
            a.append(np.minimum(p, q)[keep])
            b.append(np.maximum(p, q)[keep])
        empty = np.empty(0, np.int64)
        return pa.table({"a": pa.array(np.concatenate(a or [empty]), pa.int64()), "b": pa.array(np.concatenate(b or [empty]), pa.int64())})

    return run


def grid_join(rows: DataFrame, embedded: DataFrame, least: float) -> DataFrame:
    """Pairs (a < b) of the same band of rows(band, class) that the bound on their segment counts lets pass.

    The range-join: a band's classes stand in cells by the number of shingles, each twice as wide as the one before or less, so that
    a pair of that similarity lies in one cell or in two neighbouring ones; a cell is cut into blocks of about GRID_ROWS,
    and each pair of blocks is one step, under the Manhattan distance. Complete for every size.
    """
    wide = -np.log(max(least, 1e-3))
    at = rows.join(embedded, "class").withColumn("cell", F.floor(F.log(F.greatest("n", F.lit(1))) / F.lit(float(wide))))
    sizes = at.groupBy("band", "cell").agg(F.ceil(F.count(F.lit(1)) / GRID_ROWS).cast("int").alias("blocks"))
    sized = at.join(sizes.withColumnRenamed("blocks", "own"), ["band", "cell"])
    sized = sized.join(sizes.select("band", (F.col("cell") - 1).alias("cell"), F.col("blocks").alias("above")), ["band", "cell"], "left").join(sizes.select("band", (F.col("cell") + 1).alias("cell"), F.col("blocks").alias("below")), ["band", "cell"], "left")
    placed = sized.withColumn("block", F.pmod(F.xxhash64("class", F.lit(5)), F.col("own")).cast("int"))
    seq = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # a block is named by its cell and number; a step by its two blocks, the smaller first
    name = lambda c, k: F.col(c).cast("bigint") * F.lit(1 << 20) + k
    placed = placed.withColumn("me", name("cell", F.col("block")))
    others = F.concat(F.transform(seq(F.col("own")), lambda k: name("cell", k)), F.transform(seq(F.col("above")), lambda k: (F.col("cell") + 1).cast("bigint") * F.lit(1 << 20) + k), F.transform(seq(F.col("below")), lambda k: (F.col("cell") - 1).cast("bigint") * F.lit(1 << 20) + k))
    steps = placed.withColumn("other", F.explode(others)).select("band", F.least("me", "other").alias("i"), F.greatest("me", "other").alias("j"), F.col("me").alias("block"), "class", "n", "counts")
    return steps.groupBy("band", "i", "j").applyInArrow(_grid_pairs(least), "a bigint, b bigint")


def whole_pairs(sketched: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """Distinct pairs of classes (a < b) that share a band, however large, and that the bound lets pass in large ones; sketched(class, bands, counts, n).

    The classes of a large band are searched by grid_join(), all against all: a pair that shares only that band is found too.
    """
    pairs, large = _split(sketched.select(F.explode("bands").alias("band"), "class"), "band-pairs")
    large = written(large, "large-bands")
    if not large.isEmpty():
        pairs = pairs.unionByName(grid_join(large, sketched.select("class", "counts", "n").dropDuplicates(["class"]), least))
    return pairs.where("a <> b").distinct()


def candidate_pairs(sketched: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """A quick part of whole_pairs(), without the pairs that share one large band alone; no result is made from it.

    The classes of a large band, which boilerplate may bring together, must share a second band to be a pair, so such a band makes
    as many rows as it has classes, not their square. Those that share two large bands are searched by grid_join().
    """
    rows = sketched.select(F.explode("bands").alias("band"), "class")
    pairs, large = _split(rows, "band-pairs")
    if large.isEmpty():
        return pairs.where("a <> b").distinct()
    own = sketched.select("class", "bands").dropDuplicates(["class"])
    two = F.transform(F.filter("bands", lambda x: x != F.col("band")), lambda x: F.xxhash64(F.least(x, F.col("band")), F.greatest(x, F.col("band"))))
    second = written(large.join(own, "class").select(F.explode(two).alias("band"), "class"), "second-bands")
    more, still = _split(second, "second-pairs")
    pairs = pairs.unionByName(more)
    if not still.isEmpty():
        pairs = pairs.unionByName(grid_join(still, sketched.select("class", "counts", "n").dropDuplicates(["class"]), least))
    return pairs.where("a <> b").distinct()


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = Shingler()
    for b in batches:
        classes, sets = [], []
        for want, heading, text in zip(*(c.to_pylist() for c in b.columns)):
            words = make.words_of(heading, text)
            if xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63) == want:
                classes.append(want)
                sets.append(make.shingles(words).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], ["class", "shingles"])


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            a, b, s = [], [], []
            for x, y, p, q in zip(*(c.to_pylist() for c in t.columns)):
                u, v = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                share = both / (len(u) + len(v) - both)
                if share >= least:
                    a.append(x)
                    b.append(y)
                    s.append(share)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "similarity"])

    return run


def _bounded(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if len(t):
                ca, cb = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(len(t), SEGMENTS) for c in ("ca", "cb"))
                keep = may_be_similar(ca, cb, t.column("na").to_numpy(), t.column("nb").to_numpy(), least)
                yield t.select(["a", "b"]).filter(pa.array(keep))

    return run


def similar_classes(chunks: DataFrame, least: float = LEAST_SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(links between classes: a, b, similarity; members: chunk_id, class). Both are written tables."""
    sketched = written(sketches(chunks), "sketches")
    sketch = sketched.where("n IS NOT NULL")
    embedded = sketch.select("class", "counts", "n").dropDuplicates(["class"])
    ea = embedded.select(F.col("class").alias("a"), F.col("counts").alias("ca"), F.col("n").alias("na"))
    eb = embedded.select(F.col("class").alias("b"), F.col("counts").alias("cb"), F.col("n").alias("nb"))
    near = whole_pairs(sketch, least).join(ea, "a").join(eb, "b").select("a", "b", "ca", "cb", "na", "nb")
    pairs = written(near.mapInArrow(_bounded(least), "a bigint, b bigint"), "candidates")
    involved = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    members = sketched.select("chunk_id", "class").distinct()
    first = members.join(involved, "class", "left_semi").groupBy("class").agg(F.min("chunk_id").alias("chunk_id"))
    texts = chunks.where("text IS NOT NULL").select("chunk_id", "heading", "text").join(first, "chunk_id").select("class", "heading", "text")
    sets = written(texts.mapInArrow(_shingle_rows, "class bigint, shingles binary").dropDuplicates(["class"]), "shingles")
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return written(both.mapInArrow(_verify(least), "a bigint, b bigint, similarity double"), "links"), members


def similar_pairs(chunks: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """Pairs of different chunk_id (smaller first) whose bodies reach the similarity.

    chunks(chunk_id, heading, text). Bodies of fewer than LEAST_WORDS words, null and blank texts are in no
    pair; replayed rows count once. Copies of one text are found as a class and spelled out here; of a class of
    more than COPIES members the first stands for all in links to other classes, and each other
    member is paired with the first, so that the groups stay whole while the rows stay in proportion.
    """
    links, members = similar_classes(chunks, least)
    size = members.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first"))
    special = size.where("n > 1")
    copies = members.join(special, "class")
    small, big = copies.where(F.col("n") <= COPIES), copies.where(F.col("n") > COPIES)
    x, y = small.select("class", F.col("chunk_id").alias("p")), small.select("class", F.col("chunk_id").alias("q"))
    within = x.join(y, "class").where("p < q").select("p", "q")
    star = big.where("chunk_id <> first").select(F.col("first").alias("p"), F.col("chunk_id").alias("q"))
    linked = links.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    acting = members.join(linked, "class", "left_semi").join(size.where(F.col("n") > COPIES).select("class", "first"), "class", "left").where("first IS NULL OR first = chunk_id").select("class", "chunk_id")
    across = links.join(acting.select(F.col("class").alias("a"), F.col("chunk_id").alias("p")), "a").join(acting.select(F.col("class").alias("b"), F.col("chunk_id").alias("q")), "b").select("p", "q")
    every = within.unionByName(star).unionByName(across).where("p <> q")
    return every.select(F.least("p", "q").alias("chunk_id_a"), F.greatest("p", "q").alias("chunk_id_b")).distinct()


def components(links: DataFrame, rounds: int = 30) -> DataFrame:
    """class and the smallest class that links connect it with, for every class in links(a, b).

    Large-star and small-star steps in turn until nothing changes; every step is a written table.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(low, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    edges = written(links.select("a", "b").where("a <> b").distinct(), "edges")
    last = None
    for _ in range(rounds):
        edges = written(star(star(edges, True), False), "stars")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return edges.select(F.col("a").alias("class"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("class"), F.col("b").alias("root"))).distinct()


def version_groups(chunks: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """chunk_id, group_id (the smallest chunk_id of the group), n_copies and n_links for every usable chunk.

    n_links counts the different texts that the chunk's text is linked with; a chunk of no group is its own.
    """
    links, members = similar_classes(chunks, least)
    roots = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    size = members.groupBy("class").agg(F.count(F.lit(1)).alias("n_copies"), F.min("chunk_id").alias("first"))
    classes = size.join(roots, "class", "left").join(degree, "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = classes.join(classes.groupBy("root").agg(F.min("first").alias("group_id")), "root")
    return members.join(named.select("class", "group_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")), "class").select("chunk_id", "group_id", "n_copies", "n_links")
