"""Mixing sources to target shares of the tokens, by Sainte-Lague apportionment.

The size of the mixture is the largest that every present source can carry with its allowed
repetitions. It is divided into equal-token blocks, which go to the sources by highest quotients,
and those of a source in the same way to its shards. Inside a shard the uses of the documents stand
in seeded order, first uses before second ones; a use belongs to the block in which its middle lies.
The first blocks up to the quota are selected. As documents are not divided, a source may end a
little beside its quota; single uses of other documents settle the difference, the last of it by an
exact search for the nearest total that lengths allow.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

FINE = 400  # blocks of the smallest source, at least
SHARE = 1_000_000  # documents of a source that one task puts in order, about
NEAR = 1e-3  # gap, as a share of the goal, that is searched to the end


def source_name(c: Column) -> Column:
    """Spaces at both ends removed, lower case, hyphens for underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), "_", "-")


def sainte_lague(weight: np.ndarray, total: int, cap: np.ndarray | None = None) -> np.ndarray:
    """Seats of each party when ``total`` seats go one by one to the highest quotient
    ``weight / (2 * seats + 1)``; none beyond ``cap``. Ties go to the party named first.

    A search for the divisor finds all but a few seats at once, so the cost does not grow with the
    number of seats.
    """
    w = np.asarray(weight, float)
    cap = np.full(len(w), total, np.int64) if cap is None else np.minimum(np.asarray(cap, np.int64), total)
    cap = np.where(w > 0, cap, 0)
    total = int(min(total, cap.sum()))
    if total <= 0:
        return np.zeros(len(w), np.int64)
    seats = lambda d: np.minimum(np.floor(w / d + 0.5), cap).astype(np.int64)
    low, high = w[w > 0].min() / (2.0 * total + 2), w.sum() * 4 + 1
    while seats(low).sum() < total:
        low /= 2
    for _ in range(200):
        mid = (low * high) ** 0.5
        low, high = (mid, high) if seats(mid).sum() >= total else (low, mid)
    n = seats(high)
    while n.sum() < total:
        quotient = np.where(n < cap, w / (2 * n + 1), -1.0)
        n[int(quotient.argmax())] += 1
    return n


def mix_sources(docs: DataFrame, targets: DataFrame, seed: int = 42, block: int | None = None, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """(selection, report).

    ``docs``: ``doc_id, source, n_tokens``; ``targets``: ``source, target_share, max_repeats`` (a
    small table, one row a source). Selection: ``doc_id, source, n_tokens, times``; report: ``source,
    target_share, selected_tokens, actual_share, n_documents, max_times``, a row for every target.

    Sources are compared by :func:`source_name`. Documents of other sources, without a source or
    without tokens are never selected. A target whose source has no tokens gets nothing; the shares
    of the others keep their proportions. Repeated rows of one document count once. Empty documents
    or targets give an empty selection. Other columns are ignored. ``block``: tokens of a block; by
    default the smallest source gets at least ``FINE`` of them. ``share``: documents that one task puts
    in order, about; a source is spread over as many shards as that takes.
    """
    spark = docs.sparkSession
    want = {}
    for r in targets.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").where("s is not null").collect():
        if r["target_share"] and r["max_repeats"] and r["target_share"] > 0 and r["max_repeats"] > 0:
            want.setdefault(r["s"], (float(r["target_share"]), int(r["max_repeats"])))
    names = sorted(want)
    wanted = spark.createDataFrame([(s, *want[s]) for s in names], "source string, target_share double, max_repeats int")
    d = docs.select("doc_id", source_name(F.col("source")).alias("source"), F.col("n_tokens").cast("long")).where("n_tokens > 0 and doc_id is not null")
    d = cut(d.join(F.broadcast(wanted.select("source", "max_repeats")), "source").dropDuplicates(["doc_id"]))

    # documents and tokens of each source, then tokens of each of its shards: targets x shards rows
    per = {r["source"]: (r["c"], r["n"]) for r in d.groupBy("source").agg(F.count(F.lit(1)).alias("c"), F.sum("n_tokens").alias("n")).collect()}
    shards = max(1, -(-max((c for c, _ in per.values()), default=0) // share))
    d = d.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    share_of = np.array([want[s][0] for s in names])
    room = np.array([per.get(s, (0, 0))[1] * want[s][1] for s in names], dtype=np.int64)
    on = room > 0
    if not on.any():
        none = d.select("doc_id", "source", "n_tokens", F.lit(0).alias("times")).limit(0)
        return none, _report(wanted, none)
    part = np.where(on, share_of, 0) / share_of[on].sum()
    size = float((room[on] / part[on]).min())
    block = block or max(1, int(part[on].min() * size / FINE))
    quota = sainte_lague(part, max(1, int(size // block)), -(-room // block))
    have = np.zeros((len(names), shards), np.int64)
    if shards == 1:
        have[:, 0] = [per.get(s, (0, 0))[1] for s in names]
    else:
        for r in d.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n")).collect():
            have[names.index(r["source"]), r["shard"]] = r["n"]
    rows = []
    for i, s in enumerate(names):
        for shard, q in enumerate(sainte_lague(have[i].astype(float), int(quota[i]))):
            if q:
                rows.append((s, shard, int(q)))
    quotas = spark.createDataFrame(rows, "source string, shard int, quota long")

    uses = d.join(F.broadcast(quotas), ["source", "shard"]).withColumn("use", F.explode(F.sequence(F.lit(1), F.col("max_repeats"))))
    w = Window.partitionBy("source", "shard").orderBy("use", F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    cum = F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    uses = uses.withColumn("mid", cum - F.col("n_tokens") / 2).withColumn("chosen", F.col("mid") < F.col("quota") * block)
    state = uses.groupBy("doc_id", "source", "shard", "n_tokens", "max_repeats").agg(F.count_if("chosen").cast("int").alias("times"))
    # documents of shards without a quota can still serve to settle the difference
    state = d.join(state.select("doc_id", "times"), "doc_id", "left")
    state = cut(state.withColumn("times", F.coalesce("times", F.lit(0))))
    state = _settle(state, names, np.minimum(quota * block, room), seed)
    selection = state.where("times > 0").select("doc_id", "source", "n_tokens", "times")
    return selection, _report(wanted, selection)


def _settle(state: DataFrame, names: list[str], goal: np.ndarray, seed: int) -> DataFrame:
    """Adds or takes back single uses until a source is as near its goal as its documents allow.

    Two rounds take the longest that fit first and see lengths in classes an eighth of an octave wide,
    so that what the driver holds is bounded however long documents are. What is left is about a
    document, so that the last round can look at exact lengths: it finds the nearest total that uses
    of such lengths add up to, one use being exchanged if that helps."""
    octave = F.floor(F.log2(F.col("n_tokens")) * 8)
    for rnd in range(3):
        gap = _gaps(state, names, goal)
        if rnd == 2:
            gap = {s: g for s, g in gap.items() if abs(g) > NEAR * goal[names.index(s)]}
        if any(gap.values()):
            exact = rnd == 2
            state = cut(_settle_round(state, gap, F.col("n_tokens") if exact else octave, exact, seed + 1 + rnd))
    return state


def _gaps(state: DataFrame, names: list[str], goal: np.ndarray) -> dict[str, int]:
    got = {r["source"]: r["n"] for r in state.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("n")).collect()}
    return {s: int(g) - int(got.get(s, 0)) for s, g in zip(names, goal.tolist())}


def _longest_first(gap: int, stock: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(class, uses) that fit into the gap, of (greatest length, class, uses at hand)."""
    out = []
    for most, n, c in sorted(stock, reverse=True):
        k = min(gap // most, c)
        if k:
            out.append((n, int(k)))
            gap -= k * most
    return out


def _sums(stock: dict[int, int], limit: int) -> list[tuple[int, int, int]]:
    """(length, uses, totals reached so far as bits) of totals up to ``limit``, by doubling."""
    bits, out, mask = 1, [(0, 0, 1)], (1 << limit + 1) - 1
    for n in sorted(stock):
        c, k = min(stock[n], limit // n), 1
        while c > 0:
            k = min(k, c)
            bits |= (bits << n * k) & mask
            out.append((n, k, bits))
            c, k = c - k, k * 2
    return out


def nearest(gap: int, put: dict[int, int], back: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """Uses to add, of ``put`` (length: uses at hand), and at most one to take back, of ``back``, so
    that the total changes by as nearly ``gap`` as can be; fewer changes first, then shorter ones."""
    one_back = [0, *sorted(back)]
    limit = 2 * gap + max(one_back)
    steps = _sums({n: c for n, c in put.items() if n <= limit}, limit)
    raw = steps[-1][2].to_bytes(limit // 8 + 1, "little")
    totals = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little"))
    best = (gap, 0, 0)  # nothing at all is off by the gap
    for r in one_back:
        at = int(np.searchsorted(totals, gap + r))
        for t in totals[max(0, at - 1) : at + 1].tolist():
            best = min(best, (abs(gap + r - t), r, t))
    _, r, total = best
    add: dict[int, int] = {}
    for i in range(len(steps) - 1, 0, -1):
        n, k, _ = steps[i]
        if not steps[i - 1][2] >> total & 1:
            add[n] = add.get(n, 0) + k
            total -= n * k
    if r in add:  # the same length out and in
        add[r] -= 1
        r = 0
    return {n: k for n, k in add.items() if k}, {r: 1} if r else {}


def _settle_round(state: DataFrame, gap: dict[str, int], length: Column, exact: bool, seed: int) -> DataFrame:
    spark = state.sparkSession
    gaps = spark.createDataFrame([(s, g) for s, g in gap.items() if g], "source string, gap long")
    # the longest that can play a part: what fits, or, of an exchange, what is about as long
    near = state.join(F.broadcast(gaps), "source").withColumn("len", length.cast("long"))
    near = near.where(F.col("n_tokens") <= (4 * F.abs("gap") if exact else F.abs("gap")))
    stock: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
    more = near.where("times < max_repeats").withColumn("step", F.lit(1))
    less = near.where("times > 0").withColumn("step", F.lit(-1))
    able = more.unionByName(less) if exact else near.withColumn("step", F.signum("gap").cast("int")).where("step > 0 and times < max_repeats or step < 0 and times > 0")
    # classes of lengths, or lengths of at most four times the gap: no more rows, however many documents
    for r in able.groupBy("source", "step", "len").agg(F.count(F.lit(1)).alias("c"), F.max("n_tokens").alias("most")).collect():
        stock.setdefault((r["source"], r["step"]), []).append((r["most"], r["len"], r["c"]))
    take = []
    for s, g in gap.items():
        way = 1 if g > 0 else -1
        if exact and g:
            put, back = ({n: c for n, _, c in stock.get((s, w), [])} for w in (way, -way))
            put, back = nearest(abs(g), put, back)
            take += [(s, n, k, way) for n, k in put.items()] + [(s, n, k, -way) for n, k in back.items()]
        elif g:
            take += [(s, n, k, way) for n, k in _longest_first(abs(g), stock.get((s, way), []))]
    if not take:
        return state
    able = able.join(F.broadcast(spark.createDataFrame(take, "source string, len long, k long, step int")), ["source", "len", "step"])
    # the uses wanted of a length are given to its shards in order, so that no task ranks a whole source
    held: dict[tuple, list] = {}
    for r in able.groupBy("source", "len", "step", "k", "shard").agg(F.count(F.lit(1)).alias("c")).collect():
        held.setdefault((r["source"], r["len"], r["step"], r["k"]), []).append((r["shard"], r["c"]))
    parts = []
    for (s, n, step, k), at in held.items():
        for shard, c in sorted(at):
            if k > 0:
                parts.append((s, n, step, shard, min(k, c)))
                k -= c
    taken = spark.createDataFrame(parts, "source string, len long, step int, shard int, part long")
    w = Window.partitionBy("source", "len", "step", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    chosen = able.join(F.broadcast(taken), ["source", "len", "step", "shard"]).withColumn("rn", F.row_number().over(w)).where("rn <= part")
    return state.join(chosen.select("doc_id", "step"), "doc_id", "left").withColumn("times", F.col("times") + F.coalesce("step", F.lit(0))).drop("step")


def _report(wanted: DataFrame, selection: DataFrame) -> DataFrame:
    per = selection.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("times")).alias("t"), F.count(F.lit(1)).alias("n_documents"), F.max("times").alias("max_times")
    )
    r = wanted.join(per, "source", "left").select(
        "source", "target_share", F.coalesce("t", F.lit(0)).alias("selected_tokens"),
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("max_times", F.lit(0)).alias("max_times"),
    )
    total = F.sum("selected_tokens").over(Window.partitionBy())  # one row a target
    return r.withColumn("actual_share", F.when(total > 0, F.col("selected_tokens") / total).otherwise(0.0))
