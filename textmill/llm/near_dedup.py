"""Operator 2: near-duplicate classes by BagMinHash, banding and an exact check of multiset overlap.

Two texts are linked if the multisets of their 5-word shingles have a weighted
Jaccard similarity of 0.8 or more; classes are the components of all links.

1. Each text gets a signature of M components, its bands, and two 64-bit keys of
   its shingle multiset. Texts with equal keys are one node: copies cost one row.
   A node is named by its first key; where two nodes share that, by both.
2. Each bucket of a band is a star: its least node is held against the others,
   so a bucket of n nodes makes n - 1 pairs. A node keeps the most promising of
   its pairs by signature; that pair is verified on whole multisets. The
   verified pairs give first components.
3. A bucket that lies in one component is done, as no link in it can change a
   class. Components that still meet in a bucket form a residual group. There,
   nodes outside the group's largest component are held against all nodes of
   other components, in blocks of BLOCK nodes a side, each block pair its own
   task; a pair whose signatures agree enough is verified on whole multisets
   unless the block has joined the two by then. Nothing is capped.

A pair at similarity s shares a bucket with probability 1 - (1 - s^ROWS)^BANDS:
0.999993 at 0.8. A pair is skipped by signature only if that estimate is below
FLOOR, 5 standard deviations under 0.8.

Defined results: a null text counts as empty; texts without words are linked to
nothing, not even to each other; texts of fewer than 5 words have one shingle,
all their words; repeated rows share a class; a class is named by its least
doc_id (null if all its ids are); empty tables give no rows; extra columns stay
out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bagminhash import mix, signatures
from .common import Scratch, broadcast_if_small, fresh, row_digest, without_rows
from .components import components
from .suffix_dedup import row_keys

SIZE, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 5
M = BANDS * ROWS
FLOOR = SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / M) ** 0.5
BLOCK = 128
#: Shingles and texts that are signed at a time.
PORTION = 60_000, 256
#: Words whose hashes a worker keeps.
CACHE_WORDS = 200_000

_U = np.uint64
_seen: dict[str, int] = {}


def _hash_word(w: str) -> int:
    if len(_seen) >= CACHE_WORDS:
        _seen.clear()
    h = _seen[w] = xxhash.xxh3_64_intdigest(w.encode())
    return h


def shingles(text: str | None) -> np.ndarray:
    """64-bit hashes of the runs of 5 words (cut at white space, case kept), with repeats, in order of the text."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.uint64)
    get = _seen.get
    h = np.array([get(w) or _hash_word(w) for w in words], np.uint64)
    n = max(1, len(h) - SIZE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(SIZE, len(h))):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[k : k + n])
    return out


def weighted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(text), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets, each of sorted elements and counts."""
    i = np.searchsorted(a[0], b[0])
    i[i == len(a[0])] = 0
    hit = a[0][i] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    common = np.minimum(a[1][i[hit]], b[1][hit]).sum()
    return float(common / max(1, a[1].sum() + b[1].sum() - common))


def _portions(column: pa.Array) -> Iterator[tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]]:
    """Rows with words and their multisets, up to PORTION shingles and texts at a time, so that memory doesn't follow the lengths of texts."""
    at: list[int] = []
    bags: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for k, x in enumerate(column):
        bag = weighted(x.as_py())
        if len(bag[0]):
            at.append(k)
            bags.append(bag)
            size += len(bag[0])
        if size >= PORTION[0] or len(at) >= PORTION[1]:
            yield at, bags
            at, bags, size = [], [], 0
    if at:
        yield at, bags


def _signed(keyed: DataFrame) -> DataFrame:
    """k1, k2, text -> k1, k2, node, more (the second key), sketch (a byte of each component), bands; texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some, bags in _portions(b.column(2)):
                sizes = [len(x[0]) for x in bags]
                element, weight = np.concatenate([x[0] for x in bags]), np.concatenate([x[1] for x in bags])
                owner = np.repeat(np.arange(len(some)), sizes)
                marks = signatures(owner, element, weight, len(some), M)
                first = np.cumsum([0, *sizes[:-1]])
                node, more = (mix(np.add.reduceat(mix(element * _U(a) + weight.astype(np.uint64) * _U(b)), first)) for a, b in ((3, 0x9FB21C651E98DF25), (0xD1B54A32D192ED03, 0xAEF17502108EF2D9)))
                band = np.zeros((len(some), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for k in range(ROWS):
                    band = mix(band * _U(0x9E3779B97F4A7C15) + marks[:, k::ROWS])
                sketch = (mix(marks) >> _U(56)).astype(np.uint8)
                take = pa.array(some)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, BANDS, dtype=np.int32)), pa.array(band.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(node.view(np.int64)), pa.array(more.view(np.int64)), pa.array([x.tobytes() for x in sketch], pa.binary()), bands],
                    ["k1", "k2", "node", "more", "sketch", "bands"],
                )
        _seen.clear()  # a worker that waits holds no words

    return keyed.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, node long, more long, sketch binary, bands array<long>")


def _bags(texts: DataFrame) -> DataFrame:
    """node, text -> node, bag (elements, then counts, as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 256) for at in range(0, len(whole), 256)):
                bags = (weighted(x.as_py()) for x in b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.tobytes() + c.astype(np.uint32).tobytes() for e, c in bags], pa.binary())], ["node", "bag"])

    return texts.select("node", "text").mapInArrow(run, "node long, bag binary")


def _bag(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint32, n, 8 * n).astype(np.int64)


def _verified(pairs: DataFrame, least: float) -> DataFrame:
    """a, b, bag_a, bag_b -> a, b of the pairs that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similarity(_bag(x.as_py()), _bag(y.as_py())) >= least - 1e-12 for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], ["a", "b"])

    return pairs.select("a", "b", "bag_a", "bag_b").mapInArrow(run, "a long, b long")


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of each row of a with each of b, from a byte of each component."""
    same = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        same += a[:, k, None] == b[None, :, k]
    return (same / a.shape[1] - 1 / 256) / (1 - 1 / 256)


def _joined(rows: DataFrame, least: float) -> DataFrame:
    """part, side, node, comp, sketch, bag, in order of part -> a, b: links that join components, a forest of each part."""

    def links(rows: list[dict]) -> list[tuple[int, int]]:
        left, right = ([r for r in rows if r["side"] == k] for k in (0, 1))
        if not left or not right:
            return []
        la, lb = (np.stack([np.frombuffer(r["sketch"], np.uint8) for r in x]) for x in (left, right))
        est = agreement(la, lb)
        i, j = np.nonzero(est >= FLOOR)
        order = np.argsort(-est[i, j], kind="stable")
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := above.get(x, x)) != x:
                above[x] = above.get(y, y)
                x = y
            return x

        bags: dict[int, tuple] = {}
        out = []
        for p, q in zip(i[order], j[order], strict=True):
            x, y = left[p], right[q]
            a, b = root(x["comp"]), root(y["comp"])
            if a != b:
                for z in (x, y):
                    if z["node"] not in bags:
                        bags[z["node"]] = _bag(z["bag"])
                if similarity(bags[x["node"]], bags[y["node"]]) >= least - 1e-12:
                    above[max(a, b)] = min(a, b)
                    out.append((x["comp"], y["comp"]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            found = links(rows)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and r["part"] != held[0]["part"]:
                    yield out(held)
                    held = []
                held.append(r)
        if held:
            yield out(held)

    return rows.select("part", "side", "node", "comp", "sketch", "bag").mapInArrow(run, "a long, b long")


def _promising(pairs: DataFrame) -> DataFrame:
    """node, rep, sketch, other -> node, rep, est of the pairs whose sketches agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, M) for c in b.columns[2:])
                est = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
                ok = pa.array(est >= FLOOR)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(est).filter(ok)], ["node", "rep", "est"])

    return pairs.select("node", "rep", "sketch", "other").mapInArrow(run, "node long, rep long, est double")


def named_apart(signed: DataFrame, scratch: Scratch) -> DataFrame:
    """Different nodes of one name get a name from both keys, so that 64 bits serve as names and 128 tell nodes apart."""
    shared = signed.groupBy("node").agg(F.min("more").alias("a"), F.max("more").alias("b")).filter("a <> b").select("node", F.lit(True).alias("shared"))
    shared = scratch.write("shared", shared)
    if shared.isEmpty():
        return signed.drop("more")
    apart = signed.join(shared, "node", "left").withColumn("node", F.when(F.col("shared"), F.xxhash64("node", "more")).otherwise(F.col("node")))
    return scratch.write("apart", apart.drop("more", "shared"))


def classes(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """k1, k2, class for each distinct (id, text) that has words, as a written table. class: a node of the class."""
    keyed = row_keys(docs, doc_id, text)
    signed = named_apart(scratch.write("signed", _signed(keyed)), scratch)
    nodes = scratch.write("nodes", signed.dropDuplicates(["node"]))
    bands = nodes.select("node", F.explode("bands").alias("band"))
    full = bands.groupBy("band").agg(F.min("node").alias("rep"), F.max("node").alias("top")).filter("rep <> top").select("band", "rep")
    # written first, so that both sides of the join have an exchange of their own and a hot bucket can be split
    members = scratch.write("members", bands.join(scratch.write("full", full), "band"))

    met = members.select("node").distinct()
    sketches = scratch.write("sketches", nodes.select("k1", "k2", "node", "sketch").join(met, "node", "left_semi"))
    texts = keyed.select("k1", "k2", "text").join(broadcast_if_small(sketches.select("k1", "k2", "node")), ["k1", "k2"]).dropDuplicates(["node"])
    bags = scratch.write("bags", _bags(texts))

    pairs = members.filter("node <> rep").select("node", "rep").distinct()
    pairs = pairs.join(sketches.select("node", "sketch"), "node").join(sketches.select(F.col("node").alias("rep"), F.col("sketch").alias("other")), "rep")
    best = _promising(pairs).groupBy("node").agg(F.max(F.struct("est", "rep")).alias("m"))
    best = best.select(F.col("node").alias("a"), F.col("m.rep").alias("b"))
    sided = best.join(bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a").join(bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b")
    first = components(_verified(sided, least), scratch, "first")

    def labelled(df: DataFrame, column: str, labels: DataFrame, to: str) -> DataFrame:
        return df.join(labels.select(F.col("v").alias(column), F.col("root").alias("_r")), column, "left").withColumn(to, F.coalesce("_r", column)).drop("_r")

    members = labelled(members.select("band", "node"), "node", first, "comp")
    open_ = members.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("band", "low")
    meet = members.join(open_, "band").select(F.col("comp").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
    groups = components(meet, scratch, "groups")
    # each component of a residual group, with its group; a group's name is its least component
    in_group = groups.select(F.col("v").alias("comp"), F.col("root").alias("grp")).unionByName(groups.select(F.col("root").alias("comp"), F.col("root").alias("grp")).distinct())
    rest = scratch.write("residual", labelled(sketches.select("node", "sketch"), "node", first, "comp").join(in_group, "comp"))
    sizes = rest.groupBy("grp", "comp").count()
    largest = sizes.groupBy("grp").agg(F.max(F.struct("count", "comp")).alias("m"), F.sum("count").alias("n"))
    largest = largest.select("grp", F.col("m.comp").alias("main"), F.col("n"), (F.col("n") - F.col("m.count")).alias("rest"))
    # written first: where it is small it is known to be, else a hot group can be split
    rest = rest.join(scratch.write("largest", largest), "grp").join(bags, "node")
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    spot = lambda n: F.pmod(F.xxhash64("node"), parts(n)).cast("int")
    # part (i, j) of a group holds block i of the nodes outside the main component and block j of all
    left = rest.filter("comp <> main").withColumn("i", spot("rest")).withColumn("j", F.explode(F.sequence(F.lit(0), parts("n") - 1))).withColumn("side", F.lit(0))
    right = rest.withColumn("j", spot("n")).withColumn("i", F.explode(F.sequence(F.lit(0), parts("rest") - 1))).withColumn("side", F.lit(1))
    sides = left.unionByName(right, allowMissingColumns=True).withColumn("part", F.xxhash64("grp", "i", "j"))
    joined = _joined(sides.select("part", "side", "node", "comp", "sketch", "bag").repartition("part").sortWithinPartitions("part"), least)
    second = components(joined, scratch, "second")
    labels = labelled(labelled(signed.select("k1", "k2", "node"), "node", first, "comp"), "comp", second, "class")
    found = scratch.write("classes", labels.select("k1", "k2", "class").distinct())
    scratch.drop("signed", "shared", "apart", "nodes", "full", "members", "sketches", "bags", "residual", "largest")
    return found


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """Per row of docs: id, class_id (the least id of its class) and class_size (rows of the class)."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    found = classes(docs, scratch, doc_id, text, least)
    rows = scratch.write("rows", row_keys(docs, doc_id, text).select("id", "k1", "k2").join(found, ["k1", "k2"], "left").select("id", "class"))
    scratch.drop("classes")
    named = rows.filter("class is not null").groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(scratch.write("named", named), "class", "left").select(
        F.col("id").alias(doc_id), F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size")
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of docs with one of each class: that of the least id, then of the least keys. Rows without words all stay.

    Only keys are exchanged: texts that stay meet the keys of those that go where they are read.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    found = classes(docs, scratch, doc_id, text, least)
    keys = row_keys(docs, doc_id, text).groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    keyed = scratch.write("keyed", keys.join(found, ["k1", "k2"]).withColumn("spot", F.struct(F.col("id").isNull(), F.col("id"), "k1", "k2")))
    # written first, so that both sides of the join have an exchange of their own and a hot class can be split
    first = scratch.write("first", keyed.groupBy("class").agg(F.min("spot").alias("m")))
    placed = scratch.write("placed", keyed.join(first, "class").select("k1", "k2", "n", (F.col("spot") == F.col("m")).alias("stays")))
    scratch.drop("classes", "keyed", "first")
    left = without_rows(docs, placed.filter("not stays"), doc_id, text)
    # equal rows (same id, same text) have the same keys; one of them stays if they have words
    many = placed.filter("stays and n > 1").select("k1", "k2")
    if many.isEmpty():
        return left
    key = fresh("key", docs.columns)
    again = left.withColumn(key, row_digest(F.col(doc_id), F.col(text)))
    twins = again.join(broadcast_if_small(many.select(F.struct("k1", "k2").alias(key))), key, "left_semi").dropDuplicates([key])
    return without_rows(left, many, doc_id, text).unionByName(twins.select(*docs.columns))
