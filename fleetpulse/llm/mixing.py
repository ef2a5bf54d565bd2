"""Interleaving sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source's documents, in an order fixed by the MD5 of their ids, are cut into blocks of `block_rows`. A source with
share a of the total A releases its block j (from 0) at slot floor(j*A/a) of the current phase and has it due by slot
ceil((j+1)*A/a). Each slot goes to the released block that is due first (ties: smaller source name, null
last). As the shares add up to A, every block meets its window, so at every slot each source is less than one block
away from its target. When a source has no block left, a new phase starts with the others' shares; so no document is
dropped or repeated. Sources without a weight follow after all others, with equal shares.

Shares are whole numbers: weights in units of 1/`resolution`. The plan is checked against the weights themselves, slot by
slot; where rounding has moved a source by a block, shares with a resolution REFINE times as fine are taken, until each source
is less than one block away from its true target at every slot.

The schedule of a phase repeats every A slots, so the driver works out one period per phase from the counts
per source, or the phase itself if that is shorter: never more slots than there are blocks in all. Tasks get the slots in
pieces of CHUNK. Documents are ranked in two levels, by source
and by leading digits of the MD5, so a source that holds most rows is spread over many tasks.

Rows: a null source is a source of its own; equal ids are ranked in any order among themselves (and count as
documents each); an empty table gives an empty result. Sources are expected to be few (thousands).
"""

from __future__ import annotations

import heapq
import json
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16
RESOLUTION = 1000
REFINE = 1000
FINEST = 10**12  # a block's number times this must fit a long
CHUNK = 1024
ROWS_PER_BUCKET = 1 << 14


def shares_of(weights: dict[str | None, float], resolution: int = RESOLUTION) -> dict[str | None, int]:
    """Whole shares, at least 1 each, in proportion to the weights."""
    total = sum(weights.values())
    return {s: max(1, int(w * resolution / total + 0.5)) for s, w in weights.items() if w > 0}


def period(shares: list[int], left: list[int]) -> list[list[int]]:
    """The slots that each source gets in the first sum(shares) slots, or until a source has no block left."""
    total = sum(shares)
    slots: list[list[int]] = [[] for _ in shares]
    ready = [(-(-total // a), s) for s, a in enumerate(shares)]
    heapq.heapify(ready)
    waiting: list[tuple[int, int]] = []
    for now in range(total):
        while waiting and waiting[0][0] <= now:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * total // shares[s]), s))
        s = heapq.heappop(ready)[1]
        slots[s].append(now)
        if len(slots[s]) == left[s]:
            break
        heapq.heappush(waiting, (len(slots[s]) * total // shares[s], s))
    return slots


def schedule(blocks: dict[str | None, int], shares: dict[str | None, int]) -> list[dict]:
    """Which blocks of which source run in each phase: rows for `inline`."""
    order = sorted(blocks, key=lambda s: (s is None, s or ""))
    used, start, phase, out = dict.fromkeys(order, 0), 0, 0, []
    while True:
        weighted = [s for s in order if used[s] < blocks[s] and shares.get(s)]
        active = weighted or [s for s in order if used[s] < blocks[s]]
        if not active:
            return out
        own = [shares[s] if weighted else 1 for s in active]
        left = [blocks[s] - used[s] for s in active]
        total, slots = sum(own), period(own, left)
        if any(len(p) == n for n, p in zip(left, slots)):
            end = sum(map(len, slots))
        else:
            end = min((n - 1) // a * total + p[(n - 1) % a] for n, a, p in zip(left, own, slots)) + 1
        for s, a, p in zip(active, own, slots):
            count = end // total * a + sum(x < end % total for x in p)
            if count:
                out.append({"name": s, "phase": phase, "first": used[s], "blocks": count, "start": start, "share": a, "total": total, "slots": p})
            used[s] += count
        start, phase = start + end, phase + 1


def deviation(plan: list[dict], blocks: dict[str | None, int], weights: dict[str | None, float]) -> float:
    """The most blocks by which a source is away from the target of its weight before or after any slot of its phase."""
    used, worst = dict.fromkeys(blocks, 0), 0.0
    for _, steps in groupby(plan, key=lambda step: step["phase"]):
        own = {step["name"]: step for step in steps}
        left = [s for s in blocks if used[s] < blocks[s]]
        rates = {s: weights[s] for s in left if weights.get(s, 0) > 0} or dict.fromkeys(left, 1.0)
        every, end = sum(rates.values()), sum(step["blocks"] for step in own.values())
        for s, rate in rates.items():
            count = own[s]["blocks"] if s in own else 0
            worst = max(worst, abs(count - end * rate / every))
            if s in own:
                share, total, slots = (own[s][c] for c in ("share", "total", "slots"))
                # Whole periods shift the deviation by the same amount each, so the first and last ones tell.
                for j in {*range(min(share, count)), *range(max(0, count - share), count)}:
                    slot = j // share * total + slots[j % share]
                    worst = max(worst, slot * rate / every - j, j + 1 - (slot + 1) * rate / every)
            used[s] += count
    return worst


def fair_schedule(blocks: dict[str | None, int], weights: dict[str | None, float], resolution: int = RESOLUTION) -> list[dict]:
    """A schedule that keeps each source less than a block away from the target of its weight."""
    while True:
        plan = schedule(blocks, shares_of(weights, resolution))
        if deviation(plan, blocks, weights) < 1 or resolution >= FINEST:
            return plan
        resolution *= REFINE


def mix_sources(
    docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS,
    resolution: int = RESOLUTION,
) -> DataFrame:
    """`docs` with `block`, `phase`, `release`, `due`, `slot` and `position` (0-based place in the mixture).

    Without `weights` a source weighs the square root of its number of documents. Columns of `docs` with one of the
    new names are replaced. `resolution` is the coarsest one to try.
    """
    spark = docs.sparkSession
    counts = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sum(counts.values())
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    weights = {s: n**0.5 for s, n in counts.items()} if weights is None else weights
    plan = fair_schedule(blocks, {s: w for s, w in weights.items() if s in counts and w > 0}, resolution)
    digits = 0
    while 16**digits * ROWS_PER_BUCKET < rows:
        digits += 1

    def table(steps: list[dict], kind: str) -> DataFrame:
        found = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(steps)), f"array<struct<{kind}>>")))
        return found.select(*[F.col(c).alias(f"__{c}") for c in found.columns])

    whole = ["name", "phase", "first", "blocks", "start", "share", "total"]
    planned = table([{c: step[c] for c in whole} for step in plan], "name string, " + ", ".join(f"{c} long" for c in whole[1:]))
    pieces = table(
        [
            {"of": step["name"], "in": step["phase"], "chunk": at // CHUNK, "slots": step["slots"][at : at + CHUNK]}
            for step in plan for at in range(0, len(step["slots"]), CHUNK)
        ],
        "of string, in long, chunk long, slots array<long>",
    )
    # The last block of a source may be short; later blocks move up by what it lacks.
    short = []
    for step in plan:
        last = blocks[step["name"]] - 1
        lacks = blocks[step["name"]] * block_rows - counts[step["name"]]
        if lacks and step["first"] <= last < step["first"] + step["blocks"]:
            j = last - step["first"]
            slot = step["start"] + j // step["share"] * step["total"] + step["slots"][j % step["share"]]
            short.append({"slot": slot, "lacks": lacks})
    shorts = F.from_json(F.lit(json.dumps(short)), "array<struct<slot long, lacks long>>")

    new = ["block", "phase", "release", "due", "slot", "position"]
    names = [c for c in docs.columns if c not in new]
    ordered = docs.select(*[f"`{c}`" for c in names], F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("__order"))
    ordered = ordered.withColumn("__bucket", F.substring("__order", 1, digits) if digits else F.lit(""))
    sizes = ordered.groupBy("source", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("source").alias("__s"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    within = Window.partitionBy("source", "__bucket").orderBy("__order", "doc_id")
    ranked = ordered.withColumn("__place", F.row_number().over(within) - 1)
    ranked = ranked.join(offsets, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    rank = F.col("__before") + F.col("__place")
    ranked = ranked.withColumn("__rank", rank).withColumn("block", F.floor(F.col("__rank") / block_rows))
    # Rows of the plan are bounded by the sources, and the slots in all pieces by the blocks.
    j, a, total = F.col("block") - F.col("__first"), F.col("__share"), F.col("__total")
    found = ranked.join(
        F.broadcast(planned),
        F.col("source").eqNullSafe(F.col("__name")) & (F.col("block") >= F.col("__first")) & (F.col("block") < F.col("__first") + F.col("__blocks")),
    ).withColumn("__piece", F.call_function("div", j % a, F.lit(CHUNK)))
    found = found.join(
        F.broadcast(pieces), F.col("source").eqNullSafe(F.col("__of")) & (F.col("__phase") == F.col("__in")) & (F.col("__piece") == F.col("__chunk"))
    )
    slot = F.col("__start") + F.call_function("div", j, a) * total + F.element_at("__slots", (j % a % CHUNK + 1).cast("int"))
    missing = F.aggregate(
        shorts, F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["slot"] < F.col("slot"), x["lacks"]).otherwise(0)
    )
    out = found.withColumn("slot", slot).withColumn("phase", F.col("__phase"))
    out = out.withColumn("release", F.col("__start") + F.call_function("div", j * total, a))
    out = out.withColumn("due", F.col("__start") + F.call_function("div", (j + 1) * total + a - 1, a))
    out = out.withColumn("position", F.col("slot") * block_rows + F.col("__rank") % block_rows - missing)
    return out.select(*[f"`{c}`" for c in names], *[F.col(c).cast("long").alias(c) for c in new])
