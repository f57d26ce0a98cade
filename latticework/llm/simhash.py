"""SimHash near-duplicates by tiled exact comparison, and the connected components of the links."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.common import HOT, discard, join_hot, map_texts, materialize, table, written

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
TILE = 65_536
#: Bits within which texts whose sets of shingles have a similarity of 0.8 or more are looked for.
WIDE = 18
#: Bins of a text's sketch: the smallest shingle hash of each bin, as a byte. Estimated similarities have a deviation of 0.018 at 0.8 for long texts, and less for those with fewer shingles than bins.
SKETCH = 512
#: How far below the wanted similarity an estimate may be.
SLACK = 0.03


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the text's word shingles in order; of the whole text where it has fewer words, none where it has no word."""
    from xxhash import xxh64_intdigest

    raw = b" ".join(_WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower()))  # bytes.lower() changes A-Z alone
    if not raw:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    n = len(gaps) + 1
    if n <= width:
        return np.array([xxh64_intdigest(raw, SEED)], np.uint64)
    begin = np.concatenate([[0], gaps + 1])[: n - width + 1].tolist()
    end = np.concatenate([gaps, [len(raw)]])[width - 1 :].tolist()
    return np.fromiter((xxh64_intdigest(raw[i:j], SEED) for i, j in zip(begin, end, strict=True)), np.uint64, len(begin))


def majority(hashes: np.ndarray) -> int:
    """The SimHash of the hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int) -> int:
    """The SimHash of the text's word shingles; no word gives 0."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, width) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fp long")


class Forest:
    """Components of the numbers below n, kept as a label for each: the smallest number of its component."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins a[i] with b[i] for every i: each round moves every joined label down to the smallest beside it."""
        while True:
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def tile_links(left: np.ndarray, right: np.ndarray, radius: int, rows: int = 128, columns: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Star links (from, to) that join the same fingerprints as all pairs of left and right within the radius.

    Both sides are ordered by the population count of their first half; a block of rows meets only those columns whose
    counts lie within the radius, since a pair's counts differ by its differing bits at most.
    """
    half = np.uint64(0xFFFFFFFF)
    order = lambda x: x[np.argsort(np.bitwise_count(x & half), kind="stable")]
    left, right = order(left), order(right)
    counts = np.bitwise_count(right & half).astype(np.int64)
    own = np.bitwise_count(left & half).astype(np.int64)
    everything, number = np.unique(np.concatenate([left, right]), return_inverse=True)
    at_left, at_right, forest = number[: len(left)], number[len(left) :], Forest(len(everything))
    for i in range(0, len(left), rows):
        block = left[i : i + rows, None]
        lo = np.searchsorted(counts, own[i] - radius)
        hi = np.searchsorted(counts, own[min(i + rows, len(left)) - 1] + radius, side="right")
        for j in range(lo, hi, columns):
            near = np.bitwise_count(block ^ right[None, j : min(j + columns, hi)]) <= radius
            if near.any():
                a, b = np.nonzero(near)
                forest.join(at_left[i + a], at_right[j + b])
    moved = np.flatnonzero(forest.label != np.arange(len(everything)))
    return everything[moved], everything[forest.label[moved]]


def paired_tiles(tiles: DataFrame, sizes: DataFrame, near: Callable[[Column, Column], Column], compare: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """compare(table of side and tile) for every pair of tiles, a tile and itself too, whose cells are near.

    tiles has cell, part and tile, one row each; sizes has cell and parts, a row for each of a few cells. The pairs are
    made on Spark from the cells' numbers of parts, each with all columns that name it as its key.
    """
    first, second = (sizes.select(F.col("cell").alias(f"c{k}"), F.col("parts").alias(f"n{k}")) for k in "xy")
    pairs = first.join(F.broadcast(second), (F.col("cx") <= F.col("cy")) & near(F.col("cx"), F.col("cy")))
    pairs = pairs.withColumn("px", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))).withColumn("py", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
    pairs = pairs.filter((F.col("cx") < F.col("cy")) | (F.col("px") <= F.col("py"))).select("cx", "px", "cy", "py")
    same = (F.col("cx") == F.col("cy")) & (F.col("px") == F.col("py"))
    end = lambda side, k: F.struct(F.lit(side).alias("side"), F.col(f"c{k}").alias("cell"), F.col(f"p{k}").alias("part"))
    sides = pairs.withColumn("end", F.explode(F.when(same, F.array(end(0, "x"))).otherwise(F.array(end(0, "x"), end(1, "y")))))
    dealt = sides.select("cx", "px", "cy", "py", "end.*").hint("merge").join(tiles, ["cell", "part"])
    return dealt.groupBy("cx", "px", "cy", "py").applyInArrow(lambda t: compare(t.select(["side", "tile"])), schema)


def links(distinct: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp that join whatever lies within the radius of each other.

    A cell holds the fingerprints with the same population counts of their two halves, so there are 33 times 33 at
    most. Two cells are compared only if their counts differ by the radius in all; no pair beyond can be near. Large
    cells are cut into tiles by hash. Each tile goes, as one row, to the tasks of its tile pairs.
    """
    u, v = F.bit_count(F.col("fp").bitwiseAND(0xFFFFFFFF)), F.bit_count(F.shiftrightunsigned("fp", 32))
    cells = distinct.select("fp", (u * 33 + v).cast("int").alias("cell"))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    tiles = cells.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("fp", F.lit(3)), F.col("parts")).cast("int")).groupBy("cell", "part").agg(F.collect_list("fp").alias("tile"))
    apart = lambda x, y: F.abs(F.floor(x / 33) - F.floor(y / 33)) + F.abs(x % 33 - y % 33)

    def compare(t: pa.Table) -> pa.Table:
        by = {s: np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64) for s, x in zip(t.column("side").to_pylist(), t.column("tile"), strict=True)}
        a, b = tile_links(by[0], by.get(1, by[0]), radius) if 0 in by else (np.zeros(0, np.uint64),) * 2
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return paired_tiles(tiles, sizes, lambda x, y: apart(x, y) <= radius, compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for all nodes of the edges (a, b).

    Alternates large and small stars until a round changes nothing, however many rounds that takes. Each round is
    written and the one before deleted. A hub's edges stay where they are and only its smallest neighbour is sent.
    """
    spark = edges.sparkSession
    edges, at = written(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last, n = None, edges.count()
    while n:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = join_hot(both.filter(F.col("b") > F.col("a")), low, ["a"], 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large, between = written(large, "stars")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, low, ["a"], n)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        edges, new = written(small, "stars")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])
        discard(spark, at), discard(spark, between)
        at, n = new, state[0]
        if state == last:
            break
        last = state
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), "b")).groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links, for each row.

    Links join fingerprints that differ in `radius` bits or fewer. Rows with equal fingerprints are one class from the
    start, so groups of copies of any size make no pairs. Null, empty and blank texts have fingerprint zero, linked
    like any other; null ids count as the smallest only where a component has no other; an empty table gives no rows.
    Texts of any length count whole, and other columns don't matter.
    """
    own = materialize(fingerprints(docs, width), "fingerprints")
    classes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    comp = components(links(classes.select("fp"), radius))
    rooted = classes.join(comp.hint("merge"), classes["fp"] == comp["node"], "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    sizes = classes.agg(F.sum("n").alias("rows"), F.count("*").alias("classes")).collect()[0]
    named = join_hot(rooted.select("fp", "root", F.col("n").alias("rows")), firsts, ["root"], sizes["classes"]).select("fp", "component_id", F.col("rows").alias("n"))
    return join_hot(own, named, ["fp"], sizes["rows"] or 0).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """key, cls, fp and sketch of each row. cls is a digest of the text's set of shingles, so equal sets are one class; fp is
    the set's SimHash; the sketch has a byte for each bin, of the smallest hash that falls there, 0 where none does."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t, width)) for t in b.column(1).to_pylist()]
            low = np.zeros((len(sets), SKETCH), np.uint8)
            for k, s in enumerate(sets):
                bins, first = np.unique(s % np.uint64(SKETCH), return_index=True)  # sets are in order
                low[k, bins] = (s[first] >> np.uint64(8)) % np.uint64(255) + np.uint64(1)
            cls = np.fromiter((xxh64_intdigest(s.tobytes(), SEED) for s in sets), np.uint64, len(sets))
            fps = np.fromiter((majority(s) for s in sets), np.uint64, len(sets))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls.view(np.int64)), pa.array(fps.view(np.int64)), pa.array([x.tobytes() for x in low], pa.binary())], ["key", "cls", "fp", "sketch"])

    rows = docs.select("key", F.col("text").cast("string").alias("text"))
    return map_texts(rows, run, T.StructType([rows.schema["key"]]).add("cls", T.LongType()).add("fp", T.LongType()).add("sketch", T.BinaryType()))


def sketch_rows(sketches: pa.Array) -> np.ndarray:
    """Sketches as rows of bytes, in the array's own memory: copies of a tile's would stay in its worker, which the next stages share."""
    sketches = sketches.cast(pa.large_binary())
    at = np.frombuffer(sketches.buffers()[1], np.int64)[sketches.offset : sketches.offset + len(sketches) + 1]
    return np.frombuffer(sketches.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].reshape(-1, SKETCH)


class Tile:
    """Classes of a tile in the order of their fingerprints' population counts: number, fingerprint, root. Sketches stay where they lie."""

    def __init__(self, cls: pa.Array, fp: pa.Array, sketch: pa.Array, root: pa.Array):
        fps = fp.to_numpy(zero_copy_only=False).view(np.uint64)
        self.order = np.argsort(np.bitwise_count(fps), kind="stable")
        self.fps, self.counts = fps[self.order], np.bitwise_count(fps[self.order]).astype(np.int64)
        self.cls, self.root = (v.to_numpy(zero_copy_only=False)[self.order] for v in (cls, root))
        self.sketch = sketch_rows(sketch)

    def sketches(self, places: np.ndarray) -> np.ndarray:
        return self.sketch[self.order[places]]


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarities of sketches, row by row: equal bins of those filled on either side."""
    either = ((a | b) != 0).sum(axis=1)
    return ((a == b) & (a != 0)).sum(axis=1) / np.maximum(1, either)


def root_links(left: Tile, right: Tile, radius: int, least: float, rows: int = 128, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Star links that join the same roots as all pairs of the tiles whose fingerprints lie within the radius and whose estimated similarity is `least` or more.

    Tiles are in order of population counts, so a block of rows meets only columns whose counts lie within the radius.
    """
    numbers = np.unique(np.concatenate([left.root, right.root]))
    x_root, y_root, forest = np.searchsorted(numbers, left.root), np.searchsorted(numbers, right.root), Forest(len(numbers))
    for i in range(0, len(left.fps), rows):
        begin = np.searchsorted(right.counts, left.counts[i] - radius)
        end = np.searchsorted(right.counts, left.counts[min(i + rows, len(left.fps)) - 1] + radius, side="right")
        for j in range(max(begin, i) if left is right else begin, end, columns):
            x, y = np.nonzero(np.bitwise_count(left.fps[i : i + rows, None] ^ right.fps[None, j : min(j + columns, end)]) <= radius)
            x, y = x + i, y + j
            for at in range(0, len(x), 4096):
                p, q = x[at : at + 4096], y[at : at + 4096]
                apart = forest.label[x_root[p]] != forest.label[y_root[q]]
                p, q = p[apart], q[apart]
                hit = alike(left.sketches(p), right.sketches(q)) >= least
                if hit.any():
                    forest.join(x_root[p[hit]], y_root[q[hit]])
    moved = np.flatnonzero(forest.label != np.arange(len(numbers)))
    return numbers[moved], numbers[forest.label[moved]]


def hot_keys(own: DataFrame, total: int) -> DataFrame:
    """Keys of more than one in HOT of all rows; HOT at most."""
    return own.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") * HOT > total).select("key")


def rows_of(docs: DataFrame, wanted: DataFrame, hot: DataFrame) -> DataFrame:
    """The first row of each wanted key. Repeated rows of hot keys, a few by definition, are dropped before they move."""
    few = F.broadcast(hot)
    rest = docs.join(few, "key", "left_anti").hint("merge").join(wanted.hint("merge"), "key").dropDuplicates(["key"])
    return rest.unionByName(docs.join(few, "key", "left_semi").dropDuplicates(["key"]).hint("merge").join(wanted, "key"))


def similar_documents(docs: DataFrame, similarity: float = 0.8, width: int = 5, radius: int = WIDE, tile: int = TILE) -> DataFrame:
    """key, component: a number for each group of rows linked by pairs whose sets of word shingles have about this Jaccard similarity or more.

    Rows have a column key; rows that share one are equal. Rows with equal sets of shingles are one class, whatever their
    number; texts without a word are one class too. All pairs of classes within the radius are looked at in tiles and
    judged by their sketches, from `similarity` less SLACK on. A cell holds fingerprints of nearly the same population
    count, and two cells are compared only if their counts can differ by the radius or less; cells are cut into tiles by
    hash. First each tile's classes are joined, then the roots of different tiles, so a group of any size makes a row for
    each class and few more.
    """
    own = materialize(profiles(docs, width), "profiles")
    total = own.count()
    classes = materialize(own.groupBy("cls").agg(F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.count("*").alias("n")), "classes")
    n_classes, least = classes.count(), similarity - SLACK
    cells = classes.withColumn("cell", F.floor(F.bit_count("fp") / 16).cast("int"))
    each = min(tile, max(2048, n_classes // 5))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / each).cast("int").alias("parts"))
    dealt = cells.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("parts")).cast("int"))  # five cells

    def within(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        cls, fp, sketch = (t.column(c).combine_chunks() for c in ("cls", "fp", "sketch"))
        x, own = Tile(cls, fp, sketch, cls), cls.to_numpy(zero_copy_only=False)
        a, b = root_links(x, x, radius, least)
        order = np.argsort(a)
        at = np.minimum(np.searchsorted(a[order], own), max(0, len(a) - 1))
        root = np.where(a[order][at] == own, b[order][at], own) if len(a) else own
        return pa.table({"cls": cls, "root": root.astype(np.int64), "fp": fp, "sketch": sketch, "cell": np.full(len(root), t.column("cell")[0].as_py(), np.int32), "part": np.full(len(root), t.column("part")[0].as_py(), np.int32)})

    state = materialize(dealt.select("cls", "fp", "sketch", "cell", "part").groupBy("cell", "part").applyInArrow(within, "cls long, root long, fp long, sketch binary, cell int, part int"), "state")

    def between(t: pa.Table) -> pa.Table:
        by = {s: Tile(*x.values.flatten()) for s, x in zip(t.column("side").to_pylist(), t.column("tile"), strict=True)}
        a, b = root_links(by[0], by[1], radius, least) if len(by) > 1 else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    tiles = state.groupBy("cell", "part").agg(F.collect_list(F.struct("cls", "fp", "sketch", "root")).alias("tile"))
    comp = components(paired_tiles(tiles, sizes, lambda x, y: (y - x) * 16 - 15 <= radius, between, "a long, b long"))
    comp = comp.select(F.col("node").alias("old"), F.col("root").alias("component")).hint("merge")
    roots = state.groupBy(F.col("root").alias("old")).agg(F.count("*").alias("n")).join(comp, "old", "left").select("old", F.coalesce("component", "old").alias("component"), "n")
    named = join_hot(state.select("cls", F.col("root").alias("old")), materialize(roots, "roots"), ["old"], n_classes).select("cls", "component")
    named = materialize(classes.select("cls", "n").hint("merge").join(named, "cls"), "named")
    return join_hot(own.select("key", "cls"), named, ["cls"], total).select("key", "component")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
