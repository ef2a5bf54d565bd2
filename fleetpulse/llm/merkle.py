"""A Merkle manifest of a table: one root, a sub-root per source, and for every row the proof that leads to the root.

Every row is a leaf, the hash of its columns. In each source leaves ascend by doc_id; 16 consecutive nodes become their
hash, level by level, until one is left, the sub-root. Sub-roots ascend by source (null first) and become the root
in the same way.

Method: nested-struct rollup. The rank of a node in its tree is written in digits to base 16. Inside a block of 256
consecutive nodes (two digits) the digits are grouped away one after the other, the last first: each grouping
collects the structs of up to 16 children, in order, in a struct with their hash. So a row of the result is one block with
its three levels nested in it, and its size is bounded. The block's hash is a node of the next round, whose blocks are
rolled up likewise, until one node is left in every tree. On the way back a block and its own path to the root meet
in one grouping of their union, `transform` gives each child the hashes before and after it, and `explode` hands the longer
path down, digit by digit, to the leaves. No join brings proofs to rows.

A tree of n nodes has as many levels as make one node of n. Blocks end their rollup early where the tree does.

Ranks: rows are put in ranges of (source, doc_id); a range counts its rows of each source, and the counts of the ranges before it
are added. A large source is spread over many ranges, so none is gathered anywhere; only counts per range and source are.

Rows: nulls in any column are written as `-`, so a null differs from an empty text; rows that share source and doc_id are put
in order by their leaves, and equal rows take neighbouring places, so that the set of results is defined; a null doc_id comes first. An empty
table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.tables import columns
from fleetpulse.session import pinned

FAN = 16
DIGITS = 2
ROWS_PER_RANGE = 100_000
LEAST_RANGES = 32
TAMPER_ONE_IN = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COLUMNS = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}

_PATH = "array<struct<left: string, right: string>>"


def _hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(text: Column | None = None) -> Column:
    """The hash of a row's columns, `text` in place of its own text if given."""
    values = [F.col(name) for name in COLUMNS if name != "text"] + [F.col("text") if text is None else text]
    return _hash(F.concat(*[_field(v) for v in values]))


def with_ranks(rows: DataFrame, tree: list[str], order: list[str]) -> DataFrame:
    """`rank` (from 0) of each row in its tree and `total`, the tree's number of rows.

    Rows lie in ranges of (tree, order). Each range counts its own rows of each tree, and a window over these counts, at most
    one for each range plus one for each tree, tells how many come before.
    """
    ranges = LEAST_RANGES + rows.count() // ROWS_PER_RANGE
    # The last key only parts rows that are equal so far, so that even these can lie in several ranges.
    apart = rows.withColumn("__apart", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in [*tree, *order, "__apart"]]
    ranged = apart.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("__apart")
    stored = pinned(ranged.withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range", *tree).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    counts = stored.groupBy("range", *tree).agg(F.count("*").alias("__own"))
    along = Window.partitionBy(*tree).orderBy("range")
    counts = counts.select(
        F.col("range").alias("__range"),
        *[F.col(c).alias(f"__{c}") for c in tree],
        (F.sum("__own").over(along) - F.col("__own")).alias("__before"),
        F.sum("__own").over(Window.partitionBy(*tree)).alias("total"),
    )
    same = F.col("range") == F.col("__range")
    for c in tree:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    placed = stored.withColumn("__local", F.row_number().over(inside) - 1)
    return (
        placed.join(pinned(counts), same)
        .withColumn("rank", (F.col("__local") + F.col("__before")).cast("long"))
        .drop("range", "__range", "__local", "__own", "__before", *[f"__{c}" for c in tree])
    )


def _grouped(children: DataFrame, keys: list[str], digit: str, levels: int) -> DataFrame:
    """Group a digit away: nodes with one level more, their children nested in them. A tree that has ended keeps its only node."""
    gathered = children.groupBy(*keys, "total").agg(
        F.sort_array(F.collect_list(F.struct(F.col(digit).alias("at"), "hash", "inner"))).alias("kids")
    )
    grows = F.col("total") > FAN ** (levels - 1)
    joined = _hash(F.array_join(F.transform("kids", lambda k: k["hash"]), ""))
    return gathered.select(
        *keys, "total", F.when(grows, joined).otherwise(F.col("kids")[0]["hash"]).alias("hash"), F.col("kids").alias("inner")
    )


def rollup_blocks(nodes: DataFrame, tree: list[str], payload: Column) -> DataFrame:
    """One row per block of 16^DIGITS nodes: its tree, `block`, `total`, `hash` and `inner`, the nested children.

    `nodes` has the tree's columns, `rank`, `total` and `hash`; `payload` is what the innermost structs carry.
    """
    digits = [f"d{k}" for k in range(DIGITS)]
    block = F.floor(F.col("rank") / FAN**DIGITS).alias("block")
    places = [(F.floor(F.col("rank") / FAN**k) % FAN).cast("int").alias(d) for k, d in enumerate(digits)]
    rolled = nodes.select(*tree, "total", block, *places, "hash", payload.alias("inner")).repartition(*tree, "block")
    for level in range(1, DIGITS + 1):
        rolled = _grouped(rolled, [*tree, "block", *digits[level:]], digits[level - 1], level)
    return rolled


def _siblings(kids: Column, grows: Column) -> Column:
    """For each child its hash and payload and the hashes before and after it; none where the tree has ended."""

    def text(part: Column) -> Column:
        return F.when(grows, F.array_join(F.transform(part, lambda k: k["hash"]), "")).otherwise("")

    def one(kid: Column, at: Column) -> Column:
        before, after = F.slice(kids, F.lit(1), at), F.slice(kids, at + 2, F.greatest(F.size(kids) - at - 1, F.lit(0)))
        return F.struct(
            kid["hash"].alias("hash"), kid["inner"].alias("inner"), text(before).alias("left"), text(after).alias("right")
        )

    return F.transform(kids, one)


def _unrolled(blocks: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """The innermost children of blocks, each with its `path`: (left, right) for every level, from its own level to the root."""
    rows = blocks
    for level in range(levels, 0, -1):
        grows = F.col("total") > FAN ** (level - 1)
        kids = rows.select(*keys, "total", "path", F.explode(_siblings(F.col("inner"), grows)).alias("kid"))
        own = F.array(F.struct(F.col("kid.left").alias("left"), F.col("kid.right").alias("right")))
        path = F.when(grows, F.concat(own, F.col("path"))).otherwise(F.col("path"))
        rows = kids.select(*keys, "total", F.col("kid.hash").alias("hash"), F.col("kid.inner").alias("inner"), path.alias("path"))
    return rows


def _meet(blocks: DataFrame, paths: DataFrame, tree: list[str], carried: list[str]) -> DataFrame:
    """Each block with the path of its hash: one grouping of the union of both tables, in which each block stands once in both."""
    blank = {"total": "long", "inner": blocks.schema["inner"].dataType, "path": _PATH, **{c: "string" for c in carried}}
    left = blocks.select(*tree, "block", "total", "inner", *[F.lit(None).cast(blank[c]).alias(c) for c in ["path", *carried]])
    right = paths.select(
        *tree, "block", *[F.lit(None).cast(blank[c]).alias(c) for c in ["total", "inner"]], "path", *carried
    )
    return left.unionByName(right).groupBy(*tree, "block").agg(
        *[F.max(c).alias(c) for c in ["total", *carried]],
        *[F.first(c, ignorenulls=True).alias(c) for c in ["inner", "path"]],
    )


def _climb(nodes: DataFrame, tree: list[str], payload: Column) -> list[DataFrame]:
    """Tables of blocks, round by round, until every tree is one block; `nodes` is ranked. `nodes` of the next round are the
    hashes of the blocks, whose ranks are their block numbers and whose payload is that number too."""
    rounds, most = [], nodes.agg(F.max("total")).first()[0] or 0
    while True:
        blocks = pinned(rollup_blocks(nodes, tree, payload))
        rounds.append(blocks)
        most = -(-most // FAN**DIGITS)
        if most <= 1:
            return rounds
        nodes = blocks.select(
            *tree, F.col("block").alias("rank"), F.ceil(F.col("total") / FAN**DIGITS).alias("total"), "hash", F.col("block").alias("payload")
        )
        payload = F.col("payload")


def _descend(rounds: list[DataFrame], tree: list[str], tops: DataFrame, carried: list[str]) -> DataFrame:
    """Innermost rows of the first round with their whole paths. `tops` has for each tree the path above it and what is carried along."""
    paths = tops.withColumn("block", F.lit(0).cast("long"))
    for k in range(len(rounds) - 1, 0, -1):
        met = _meet(rounds[k], paths, tree, carried)
        # The payload of an upper node is the number of the block below.
        paths = pinned(_unrolled(met, [*tree, *carried], DIGITS).select(*tree, F.col("inner").alias("block"), "path", *carried))
    return _unrolled(_meet(rounds[0], paths, tree, carried), [*tree, *carried], DIGITS)


def manifest(docs: DataFrame, tamper_one_in: int = TAMPER_ONE_IN) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof (hashes of siblings, left to right, level by level), tampered, folded_root, verified.

    The proof is checked on a copy in which the texts of one id in `tamper_one_in` (by the CRC of the id) are in lower case.
    """
    rows = columns(docs, **COLUMNS)
    lower = F.translate("text", UPPER, LOWER)
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % tamper_one_in == 0  # a null id is not picked
    leaves = rows.select(
        "source",
        "doc_id",
        leaf_hash().alias("hash"),
        F.when(picked & F.col("text").isNotNull() & (lower != F.col("text")), leaf_hash(lower)).alias("tampered"),
    )
    ranked = with_ranks(pinned(leaves), ["source"], ["doc_id", "hash"])
    below = _climb(pinned(ranked), ["source"], F.struct("doc_id", "tampered"))

    # The last round has one block for each source; its hash is the sub-root.
    subroots = below[-1].select("source", F.col("hash"))
    trunk = with_ranks(pinned(subroots.withColumn("tree", F.lit(0))), ["tree"], ["source"])
    above = _climb(pinned(trunk), ["tree"], F.struct("source"))
    root = above[-1].select("tree", F.col("hash").alias("root"), F.array().cast(_PATH).alias("path"))
    upper = _descend(above, ["tree"], root, ["root"])
    tops = pinned(upper.select(F.col("inner.source").alias("source"), "path", F.col("hash").alias("subroot"), "root"))

    proven = _descend(below, ["source"], tops, ["subroot", "root"])
    start = F.coalesce("inner.tampered", "hash")
    folded = F.aggregate("path", start, lambda node, p: _hash(F.concat(p["left"], node, p["right"])))
    return proven.select(
        F.col("inner.doc_id").alias("doc_id"),
        "source",
        F.col("hash").alias("leaf"),
        "subroot",
        "root",
        F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "").alias("proof"),
        F.col("inner.tampered").isNotNull().alias("tampered"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
