"""Documents whose sets of word shingles overlap: a size-aware heavy-light Jaccard join and its groups.

A document's set holds its distinct shingles of `words` consecutive words, with A-Z lower-cased; a shorter document
is one shingle; without words it is empty and linked with nothing. Two documents link when
100 * |intersection| >= percent * |union|.

Method. Documents with one set are a class, which is one node from here on. In a common order of the shingles
(rare ones first), sets that link share at least k of the first |A| - ceil(percent * |A| / 100) + k shingles.

* Light sets (size up to a boundary): every pair (k = 2) of those first shingles is a key; light sets that link meet
  under a key.
* Heavy sets: the first shingles (k = 1) themselves are keys, i.e. inverted lists. Sets not much smaller than the
  boundary enter these lists too, so that a heavy and a light set meet there.
* The boundary is the one with the smallest estimated cost: keys to write for light sets against list entries for
  heavy sets, each weighed with the mean number of entries it meets, measured on all documents.

Lists are not expanded into all pairs. Two members of each list are compared with all others first. The
links found join sets into components, and then only members of a list that lie in different components are
compared: all but those of the list's main component with everyone else in a short list, block by block in a longer one,
where only pairs that pass the tests below leave a task, each from the first list that both are in. So each link between different sets is
found or joins what is joined already.

A compared pair passes four tests: sizes; position in the order; the parity of shingles in 2n or more slots,
whose differences never exceed the sets' true difference; and at last the exact sets, from whole texts.

Which shingles count as frequent is measured on all documents (a sixteenth of each set, chosen by number). At most
FREQUENT of them are sent to the tasks. This only orders shingles, any choice gives the same result. Lists of
frequent shingles are known to be long, so they are never gathered in a task.

Shingles are compared as 64-bit numbers and so are classes. Rows: null ids take part by their text, and a group's id
is its smallest non-null one; equal rows are copies; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.components import components
from fleetpulse.llm.tables import arrow_map, columns, longs
from fleetpulse.llm.words import mix, windows, word_runs
from fleetpulse.session import pinned, short_lived, unpinned

WORDS = 5
PERCENT = 75
FREQUENT = 1 << 20  # shingles that tasks keep as frequent: 8 MB
SHARE = 16  # one in so many shingles of a set is counted
SHORT = 16  # entries of a list whose pairs are written one by one
BLOCK = 256  # members of a longer list that are compared as a block
MARK = 256  # most bytes of parity that a member brings to a block; longer ones are folded
KNOWN = 64  # most keys that a member brings to a block
LIGHT_MOST = 256  # no larger set is ever light: it would have thousands of keys


def _sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingles of each text that has words."""
    for row, offsets, numbers in word_runs(column, lower=True):
        for k in range(len(offsets) - 1):
            own = numbers[offsets[k] : offsets[k + 1]]
            if len(own):
                yield row + k, np.unique(windows(own, min(words, len(own))) + np.uint64(min(words, len(own)) < words))


def _class_of(shingles: np.ndarray) -> np.uint64:
    return mix(np.array([mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64))[0]


def _parity(shingles: np.ndarray) -> bytes:
    """For at least 2n slots, whether a slot holds an odd number of shingles."""
    slots = 1 << max(6, int(2 * len(shingles) - 1).bit_length())
    odd = np.bincount(((shingles >> np.uint64(17)) % np.uint64(slots)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _parity_gap(a: bytes, b: bytes) -> int:
    """No more than the number of shingles that only one of two sets has."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _folded(parity: pa.Array, size: int) -> np.ndarray:
    """Parities of at least `size` bytes folded to that size, one row each."""
    out = np.zeros((len(parity), size), np.uint8)
    for i, p in enumerate(parity):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(p.as_buffer(), np.uint8).reshape(-1, size), axis=0)
    return out


def _common(x: pa.ListArray, y: pa.ListArray) -> np.ndarray:
    """How many numbers each list of `x` shares with each list of `y`; a list holds a number once."""
    out = np.zeros((len(x), len(y)), np.float32)
    numbers_x, numbers_y = x.flatten().to_numpy(), y.flatten().to_numpy()
    row_x = np.repeat(np.arange(len(x)), pc.list_value_length(x).to_numpy())
    row_y = np.repeat(np.arange(len(y)), pc.list_value_length(y).to_numpy())
    both = np.intersect1d(numbers_x, numbers_y)
    for at in range(0, len(both), 1 << 12):
        part = both[at : at + (1 << 12)]
        held = []
        for numbers, row, rows in ((numbers_x, row_x, len(x)), (numbers_y, row_y, len(y))):
            column = np.minimum(np.searchsorted(part, numbers), len(part) - 1)
            own = part[column] == numbers
            matrix = np.zeros((rows, len(part)), np.float32)
            matrix[row[own], column[own]] = 1
            held.append(matrix)
        out += held[0] @ held[1].T
    return out


def _close_pairs(x: pa.StructArray, y: pa.StructArray, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the pairs of a member of `x` and one of `y` that may link by component, size and parity, and meet in
    no list before this one. `same`: both are one block, so that each pair stands there twice."""
    column = lambda m, name: m.field(name).to_numpy(zero_copy_only=False)
    n, m = column(x, "n")[:, None], column(y, "n")[None, :]
    near = (column(x, "root")[:, None] != column(y, "root")[None, :]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    if same:
        near &= column(x, "cls")[:, None] < column(y, "cls")[None, :]
    if near.any():
        near &= _common(x.field("before"), y.field("before")) == 0
    i, j = np.nonzero(near)
    bytes_x = np.array([len(v.as_buffer()) for v in x.field("parity")])
    bytes_y = np.array([len(v.as_buffer()) for v in y.field("parity")])
    size = np.minimum(bytes_x[i], bytes_y[j])
    gaps = np.zeros(len(i), np.int64)
    for s in np.unique(size):
        own = np.flatnonzero(size == s)
        left, right = np.flatnonzero(bytes_x >= s), np.flatnonzero(bytes_y >= s)
        a, b = _folded(x.field("parity").take(pa.array(left)), int(s)), _folded(y.field("parity").take(pa.array(right)), int(s))
        for at in range(0, len(own), 1 << 14):
            k = own[at : at + (1 << 14)]
            gaps[k] = np.bitwise_count(a[np.searchsorted(left, i[k])] ^ b[np.searchsorted(right, j[k])]).sum(axis=1)
    keep = (100 + percent) * gaps <= (100 - percent) * (n[i, 0] + m[0, j])
    return column(x, "cls")[i[keep]], column(y, "cls")[j[keep]]


def document_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (size of the set), cls (equal for equal sets), parity and mark (folded parity) of each document."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = np.zeros(batch.num_rows, np.int64)
        cls = mix(np.random.default_rng(0).integers(0, 1 << 63, batch.num_rows, np.uint64))  # empty sets: any key
        parity: list[bytes | None] = [None] * batch.num_rows
        mark: list[bytes | None] = [None] * batch.num_rows
        for row, shingles in _sets(batch.column("text"), words):
            n[row], cls[row], parity[row] = len(shingles), _class_of(shingles), _parity(shingles)
            mark[row] = _folded(pa.array([parity[row]], pa.binary()), min(len(parity[row]), MARK)).tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n), longs(cls), pa.array(parity, pa.binary()), pa.array(mark, pa.binary())],
            names=["doc_id", "n", "cls", "parity", "mark"],
        )

    return arrow_map(docs, work, "doc_id long, n long, cls long, parity binary, mark binary")


def _once(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[np.uint64, np.ndarray]]:
    """Class and set of each class in a task, however many copies the task has."""
    seen: set[int] = set()
    for batch in batches:
        for _, shingles in _sets(batch.column("text"), words):
            cls = _class_of(shingles)
            if int(cls) not in seen:
                seen.add(int(cls))
                yield cls, shingles


def _gathered(parts: Iterator[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns from many small pieces, as batches of some 100,000 rows."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for part in parts:
        held.append(part)
        rows += len(part[0])
        if rows > 100_000:
            yield pa.RecordBatch.from_arrays([longs(np.concatenate(c)) for c in zip(*held)], names=names)
            held, rows = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([longs(np.concatenate(c)) for c in zip(*held)], names=names)


def frequent_shingles(docs: DataFrame, words: int, counted_all: int) -> tuple[np.ndarray, float]:
    """The most frequent shingles, sorted, and how many others an entry of any other shingle's list meets.

    `counted_all`: how many entries there are to count.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(([s[: -(-len(s) // SHARE)]] for _, s in _once(batches, words)), ["h"])

    counted = docs.select("text").mapInArrow(work, "h long").groupBy("h").count()
    counted = pinned(counted.where("count > 1"))
    # The least count that leaves no more than FREQUENT shingles, in steps of a quarter of a power of two.
    step = F.floor(4 * F.log2("count"))
    sizes = counted.where("count >= 4").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    least, total = None, 0
    for row in sorted(sizes.collect(), key=lambda r: -r["step"]):  # at most 4 * 63 rows
        total += row["n"]
        if total > FREQUENT:
            break
        least = row["step"]
    frequent = F.lit(False) if least is None else (F.col("count") >= 4) & (step >= least)
    others = F.col("count") * (F.col("count") - 1)
    met = counted.where(~frequent).agg(F.sum(others)).first()[0]
    chosen = counted.where(frequent).select("h").toPandas()["h"]
    return np.sort(chosen.to_numpy(np.int64).view(np.uint64)), float(met or 0) / max(1, counted_all)


def light_boundary(nodes: DataFrame, percent: int, met: float) -> int:
    """The set size up to which pairs of shingles cost less than inverted lists."""
    sizes = nodes.groupBy(F.least("n", F.lit(LIGHT_MOST + 1)).alias("n")).agg(F.count(F.lit(1)).alias("sets"))
    counts = {r["n"]: r["sets"] for r in sizes.collect()}  # at most LIGHT_MOST + 1 rows
    first = lambda n, k: min(n, n - -(-percent * n // 100) + k)

    def cost(boundary: int) -> float:
        total = 0.0
        for n, sets in counts.items():
            if n <= boundary:
                total += sets * first(n, 2) * (first(n, 2) - 1) / 2
            if n > boundary or 100 * n >= percent * (boundary + 1):
                total += sets * first(n, 1) * (1 + met)
        return total

    return min(range(LIGHT_MOST + 1), key=cost)


def postings(docs: DataFrame, words: int, percent: int, frequent: np.ndarray, boundary: int) -> DataFrame:
    """key, cls, n, place, hot: under which keys a class is listed. `place` is -1 under keys of light sets."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def keys(cls: np.uint64, shingles: np.ndarray) -> list[np.ndarray]:
        n, known = len(shingles), sent.value
        hot = known[np.minimum(np.searchsorted(known, shingles), len(known) - 1)] == shingles if len(known) else np.zeros(n, bool)
        order = np.concatenate((shingles[~hot], shingles[hot]))
        flags = np.concatenate((np.zeros(n - hot.sum(), np.int64), np.ones(hot.sum(), np.int64)))
        need = -(-percent * n // 100)
        key, place, often = [], [], []
        if n <= boundary:
            own = order[: n - need + 2]
            i, j = np.triu_indices(len(own), 1)
            key.append(mix(own[i] * np.uint64(0x9E3779B97F4A7C15) + own[j]))
            place.append(np.full(len(i), -1))
            often.append(flags[i] & flags[j])
        if n > boundary or 100 * n >= percent * (boundary + 1) or need < 2:
            own = order[: n - need + 1]
            key.append(own)
            place.append(np.arange(len(own)))
            often.append(flags[: len(own)])
        count = sum(map(len, key))
        return [np.concatenate(key), np.full(count, cls), np.full(count, n), np.concatenate(place), np.concatenate(often)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered((keys(c, s) for c, s in _once(batches, words)), ["key", "cls", "n", "place", "hot"])

    return docs.select("text").mapInArrow(work, "key long, cls long, n long, place long, hot long")


def _shared(entries: DataFrame) -> DataFrame:
    """Entries under keys of two classes or more. Those of frequent shingles stay and are dealt by class as well."""
    deal = Window.partitionBy("key", "deal")
    entries = entries.withColumn("deal", F.when(F.col("hot") == 1, F.pmod("cls", F.lit(4096))).otherwise(F.lit(0)))
    ends = entries.select("key", "cls", "n", "place", "hot", F.min("cls").over(deal).alias("lo"), F.max("cls").over(deal).alias("hi"))
    return ends.where("hot = 1 or lo < hi").select("key", "cls", "n", "place").distinct()


def _may_link(percent: int) -> Column:
    """Sizes and places of entries a and b under one key allow a link."""
    both = F.col("a.n") + F.col("b.n")
    rest = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    placed = F.least("a.place", "b.place") >= 0
    near = 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    return (F.col("a.cls") != F.col("b.cls")) & near & (~placed | ((100 + percent) * rest >= percent * both))


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("a.cls", "b.cls").alias("a"), F.greatest("a.cls", "b.cls").alias("b")).distinct()


class LinkedSets:
    """The join's stored tables: `sets` (doc_id, n, cls), `links` (a, b: classes), `groups` (cls, n, component_id)."""

    def __init__(self, docs: DataFrame, words: int = WORDS, percent: int = PERCENT):
        self.percent, self.words = percent, words
        self.docs = columns(docs, doc_id="long", text="string")
        with short_lived(docs.sparkSession) as keep:
            self._build(keep)

    def _build(self, keep: Callable[[DataFrame], DataFrame]) -> None:
        percent, words = self.percent, self.words
        stored = keep(pinned(document_sets(self.docs, words)))
        self.sets = stored.select("doc_id", "n", "cls")
        full = stored.where("n > 0")
        self.nodes = pinned(
            full.groupBy("cls", "n").agg(F.min("doc_id").alias("lead"), F.first("parity").alias("parity"), F.first("mark").alias("mark"))
        )
        entries = self.nodes.agg(F.sum(F.ceil(F.col("n") / SHARE))).first()[0]
        frequent, met = frequent_shingles(self.docs, words, entries or 0)
        self.boundary = light_boundary(self.nodes, percent, met)
        entries = pinned(_shared(postings(self.docs, words, percent, frequent, self.boundary)))

        chosen = F.struct(F.xxhash64("cls", "key"), "cls", "n", "place")
        hubs = pinned(entries.groupBy("key").agg(F.min(chosen).alias("p"), F.max(chosen).alias("q")))
        tried = entries.alias("b").join(hubs.alias("h"), "key")
        stars = [
            tried.select("b.*", F.struct(F.col(f"h.{c}.cls"), F.col(f"h.{c}.n"), F.col(f"h.{c}.place")).alias("a"))
            .select(F.struct("cls", "n", "place").alias("b"), "a")
            .where(_may_link(percent))
            for c in "pq"
        ]
        first = pinned(self._plausible(pinned(_pairs(stars[0].unionByName(stars[1])))))
        links = self._verified(first)
        roots = pinned(components(links))

        placed = pinned(
            entries.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        )
        unpinned(hubs)
        unpinned(entries)
        shares = placed.groupBy("key", "root").count()
        mixed = pinned(
            shares.groupBy("key").agg(
                F.max(F.struct("count", "root")).alias("m"), F.count(F.lit(1)).alias("roots"), F.sum("count").alias("entries")
            )
            .where("roots > 1").select("key", "entries", F.col("m.root").alias("main"))
        )
        members = pinned(placed.join(mixed, "key"))
        unpinned(placed)
        short = members.where(F.col("entries") <= SHORT)
        others = short.where("root <> main").alias("a").join(short.alias("b"), "key")
        once = (F.col("b.root") == F.col("b.main")) | (F.col("a.cls") < F.col("b.cls"))
        second = _pairs(others.where((F.col("a.root") != F.col("b.root")) & once & _may_link(percent)))
        second = second.unionByName(self._across(members.where(F.col("entries") > SHORT))).distinct()
        second = pinned(self._plausible(pinned(second.join(first, ["a", "b"], "left_anti"))))
        unpinned(members)
        self.links = keep(pinned(links.unionByName(self._verified(second))))
        roots = pinned(components(self.links))

        led = pinned(self.nodes.select("cls", "n", "lead").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
                     .withColumn("root", F.coalesce("root", "cls")))
        least = pinned(led.groupBy("root").agg(F.min("lead").alias("component_id")))
        self.groups = keep(pinned(led.join(least, "root").select("cls", "n", "component_id")))

    def _across(self, members: DataFrame) -> DataFrame:
        """Pairs of members of one list in different components that pass all tests but the exact one.

        A list is dealt into blocks of some BLOCK members, and each two blocks of it meet in one row; so only pairs
        that pass the test of parities (of folded ones for long texts) are ever written. Members bring the smaller
        keys of the lists here that they are in, KNOWN at most, so that a pair is tested in the first list that both
        are in; where they know no common key among those, it may leave more than one list, but never none. The
        places of entries say nothing here, as that list need not be the one of their first common shingle.
        """
        percent = self.percent
        blocks = F.ceil(F.col("entries") / BLOCK)
        in_order = Window.partitionBy("cls").orderBy("key")
        least = F.when(F.col("rank") <= KNOWN, F.col("key"))
        listed = (
            members.select("key", "cls", "n", "root", "entries").distinct()
            .withColumn("rank", F.row_number().over(in_order))
            .withColumn("before", F.collect_list(least).over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
        )
        marked = listed.join(self.nodes.select("cls", "mark"), "cls").withColumn("blocks", blocks)
        dealt = pinned(
            marked.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
            .groupBy("key", "blocks", "block")
            .agg(F.collect_list(F.struct("cls", "n", "root", F.col("mark").alias("parity"), "before")).alias("m"))
        )
        left = dealt.select("key", F.col("block").alias("first"), F.col("m").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block"))
        met = left.join(dealt.select("key", "block", F.col("m").alias("y")), ["key", "block"])

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for x, y, same in zip(batch.column("x"), batch.column("y"), batch.column("same")):
                a, b = _close_pairs(x.values, y.values, same.as_py(), percent)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        return arrow_map(met.select("x", "y", (F.col("first") == F.col("block")).alias("same")), work, "a long, b long")

    def _plausible(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose parities differ in no more slots than sets that link may differ in shingles."""
        percent = self.percent
        marks = self.nodes.select("cls", "n", "parity")
        named = lambda end: marks.select(F.col("cls").alias(end), F.col("n").alias(f"n_{end}"), F.col("parity").alias(f"parity_{end}"))

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            left, right = batch.column("parity_a"), batch.column("parity_b")
            gaps = np.array([_parity_gap(left[i].as_buffer(), right[i].as_buffer()) for i in range(batch.num_rows)])
            sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            keep = pa.array((100 + percent) * gaps <= (100 - percent) * sizes)
            yield batch.select(["a", "b"]).filter(keep)

        return arrow_map(pairs.join(named("b"), "b").join(named("a"), "a"), work, "a long, b long")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link, by their exact sets. Texts of the classes concerned are read once more."""
        percent, words = self.percent, self.words
        ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
        leads = pinned(self.nodes.join(ends, "cls", "left_semi").select(F.col("lead").alias("doc_id"), F.col("cls").alias("want")))

        def own(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = {row: _class_of(s) for row, s in _sets(batch.column("text"), words)}
            cls = np.array([found.get(i, 0) for i in range(batch.num_rows)], np.uint64).view(np.int64)
            keep = pa.array(cls == batch.column("want").to_numpy())
            yield batch.select(["want", "text"]).filter(keep)

        def classed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row, shingles in _sets(batch.column("text"), words):
                yield pa.RecordBatch.from_arrays(
                    [longs(np.array([_class_of(shingles)])), batch.column("text").slice(row, 1)], names=["want", "text"]
                )

        # An id may stand on several rows, so the text must have the class looked for; a null id says nothing.
        named = self.docs.join(leads, "doc_id").select("want", "text")
        texts = arrow_map(named, own, "want long, text string")
        nameless = leads.where(F.col("doc_id").isNull()).select("want")
        if not nameless.isEmpty():
            spare = arrow_map(self.docs.where(F.col("doc_id").isNull()).select("text"), classed, "want long, text string")
            texts = texts.unionByName(spare.join(nameless, "want", "left_semi"))
        texts = pinned(texts.dropDuplicates(["want"]))
        side = lambda end: texts.select(F.col("want").alias(end), F.col("text").alias(f"text_{end}"))

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            keep = np.zeros(batch.num_rows, bool)
            for (row, x), (_, y) in zip(_sets(batch.column("text_a"), words), _sets(batch.column("text_b"), words)):
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep[row] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

        linked = pinned(arrow_map(pairs.join(side("b"), "b").join(side("a"), "a"), work, "a long, b long"))
        unpinned(texts)
        return linked


def membership(found: LinkedSets) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    joined = found.sets.join(found.groups, ["cls", "n"], "left")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """`docs` without the documents of a group that are not its smallest id. Rows that share an id stay or go
    together; rows without an id stay."""
    with short_lived(docs.sparkSession) as keep:
        told = keep(pinned(membership(LinkedSets(docs, words, percent))))
    stays = told.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    return docs.join(stays.where("NOT stays").select("doc_id"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
