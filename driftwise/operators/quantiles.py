"""Exact quantiles with linear interpolation (numpy / pandas / DuckDB ``quantile_cont`` semantics).

Spark's exact ``percentile`` aggregate keeps a value -> count map per group and merges it in one task,
so a global median over a continuous column at scale would pull every distinct value into one task.
``grouped_quantiles`` therefore adapts:

* groups with at most ``exact_limit`` non-null values: the built-in exact aggregate (bounded map);
* larger groups: exact order statistics by bracketing. One ``percentile_approx`` sketch per group (GK, rank error at
  most n / accuracy, bounded memory, map-side combined) gives cuts around every wanted rank; one counting pass over the
  pieces between the cuts says which one holds the rank; pieces are narrowed the same way until at most ``max_collect``
  values remain, and the k-th value is picked from that bounded set.
  Each round is a scan + partial aggregate; no shuffle of the data and no unbounded group.

The number of groups x quantiles is small by contract (features x a quantile grid), so bracket bounds
travel as literals inside the aggregate expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Comparisons that one compiled expression may hold; what needs more is looked up in arrays.
MAX_COMPARED = 256


def _ranks(n: int, q: float) -> tuple[int, int, float]:
    pos = q * (n - 1)
    lo = math.floor(pos)
    hi = min(lo + 1, n - 1)
    return lo, hi, pos - lo


def grouped_quantiles(
    long: DataFrame, group: str, value: str, qs: Sequence[float], *, exact_limit: int = 1_000_000,
    accuracy: int = 10_000, max_collect: int = 20_000, max_rounds: int = 8,
    stats: dict | None = None, n_upper: int | None = None,
) -> dict:
    """{group: [quantile for q in qs]} over the non-null values of each group (groups without values are
    absent). Linear interpolation between the order statistics around q * (n - 1).

    ``stats`` ({group: (n, min, max)}) skips the counting pass when the caller has it already;
    ``n_upper`` (a bound on any group's size) <= exact_limit goes straight to the one-job exact path."""
    d = long.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("_v"))
    qarr = F.array(*[F.lit(float(q)) for q in qs])
    if n_upper is not None and n_upper <= exact_limit:
        return {r[0]: list(r[1]) for r in d.groupBy(group).agg(F.percentile("_v", qarr)).collect()}
    if stats is None:
        stats = {r[0]: (r[1], r[2], r[3]) for r in
                 d.groupBy(group).agg(F.count(F.lit(1)), F.min("_v"), F.max("_v")).collect()}
    stats = {g: s for g, s in stats.items() if s[0]}
    if not stats:
        return {}
    small = [g for g, (n, _, _) in stats.items() if n <= exact_limit]
    big = [g for g in stats if g not in small]
    out: dict = {}
    if small:
        rows = d.where(F.col(group).isin(small)).groupBy(group).agg(F.percentile("_v", qarr)).collect()
        out.update({r[0]: list(r[1]) for r in rows})
    if big:
        need = {(g, r) for g in big for q in qs for r in _ranks(stats[g][0], q)[:2]}
        vals = _order_statistics(d, group, stats, sorted(need, key=str), accuracy, max_collect, max_rounds)
        for g in big:
            res = []
            for q in qs:
                lo, hi, frac = _ranks(stats[g][0], q)
                a, b = vals[(g, lo)], vals[(g, hi)]
                res.append(a + (b - a) * frac if frac else a)
            out[g] = res
    return out


def _by_value_counts(d: DataFrame, rank: int, max_values: int) -> float:
    """Value of 0-based ``rank`` from the counts of the smallest ``max_values`` distinct values."""
    seen = 0
    for r in d.groupBy("_v").count().orderBy("_v").limit(max_values).collect():
        seen += r["count"]
        if rank < seen:
            return r["_v"]
    raise RuntimeError(f"rank {rank} lies beyond {max_values} distinct values of its bracket; raise accuracy or max_collect")


def _order_statistics(d: DataFrame, group: str, stats: dict, targets: list, accuracy: int, max_collect: int,
                      max_rounds: int) -> dict:
    """Exact k-th smallest values (0-based rank) per (group, rank) target by bracket refinement.

    The brackets of a group never overlap, and several targets may share one. A round reads the data twice: one sketch per
    open bracket, asked for all its targets, proposes cuts; one count per piece between the cuts says which piece holds
    which rank. Only the rows inside open brackets take part."""
    # bracket per target: (lo, hi, below, inside), both ends inside, below = values strictly smaller than lo in the group
    br = {t: (stats[t[0]][1], stats[t[0]][2], 0, stats[t[0]][0]) for t in targets}
    eps = 3.0 / accuracy
    for _ in range(max_rounds):
        wide, asked = _brackets({t: b for t, b in br.items() if b[3] > max_collect and b[0] != b[1]})
        if not wide:
            break
        inside = _in_brackets(d, group, wide)
        # propose: approximate quantiles of the values inside each bracket, +- 3 sketch errors around every rank
        ps = sorted({p for w, ranks in zip(wide, asked) for r in ranks for m in [(r - w[3] + 0.5) / w[4]]
                     for p in (max(0.0, m - eps), min(1.0, m + eps))})
        near = F.percentile_approx("_v", F.array(*[F.lit(p) for p in ps]), accuracy)
        proposed = {r[0]: r[1] for r in inside.groupBy("_w").agg(near).collect()}
        cuts = [sorted({*w[1:3], *proposed[i]}, key=_nan_last) for i, w in enumerate(wide)]
        # exact counts of every piece: the rows equal to a cut (odd numbers) and those between two cuts (even). A value that
        # many rows share is proposed on both sides of a rank inside it, so it is alone in its piece after one round.
        own = F.element_at(_literal(cuts), F.col("_w") + 1)
        if sum(map(len, cuts)) <= MAX_COMPARED:
            upto = F.lit(None).cast("int")
            for i, c in enumerate(cuts):
                upto = F.when(F.col("_w") == i, at_most(c, F.col("_v"))).otherwise(upto)
        else:       # many brackets, which few rows are inside of
            upto = F.size(F.filter(own, lambda c: c <= F.col("_v")))
        placed = inside.select("_w", "_v", upto.alias("_j"))
        piece = 2 * F.col("_j") - (F.col("_v") == F.element_at(own, F.col("_j"))).cast("int")
        counted: list = [[] for _ in wide]
        for r in (placed.groupBy("_w", piece.alias("_p")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"),
                                                              F.max("_v").alias("hi")).collect()):
            counted[r["_w"]].append((r["_p"], r["lo"], r["hi"], r["n"]))
        for w, ranks, pieces in zip(wide, asked, counted):
            below = w[3]
            for _p, lo, hi, n in sorted(pieces):
                for r in ranks:
                    if below <= r < below + n:
                        br[(w[0], r)] = (lo, hi, below, n)
                below += n
    found = {t: b[0] for t, b in br.items() if b[0] == b[1]}    # one value, however often it occurs: nothing to gather
    small, asked = _brackets({t: b for t, b in br.items() if t not in found and b[3] <= max_collect})
    if small:
        at = F.element_at(_literal([[r - w[3] + 1 for r in ranks] for w, ranks in zip(small, asked)]), F.col("_w") + 1)
        rows = _in_brackets(d, group, small).groupBy("_w").agg(F.sort_array(F.collect_list("_v")).alias("_a"))
        for r in rows.select("_w", F.transform(at, lambda i: F.element_at("_a", i.cast("int"))).alias("k")).collect():
            found.update({(small[r["_w"]][0], rank): v for rank, v in zip(asked[r["_w"]], r["k"])})
    for t, (lo, hi, below, _) in br.items():
        if t not in found:      # few distinct values hold many rows: count them instead
            rows = d.where((F.col(group) == F.lit(t[0])) & F.col("_v").between(lo, hi))
            found[t] = _by_value_counts(rows, t[1] - below, max_collect)
    return found


def _nan_last(v: float) -> tuple:
    return v != v, v


def _brackets(br: dict) -> tuple[list, list]:
    """The distinct brackets (group, lo, hi, below, inside) of targets, and the ranks that each is asked for, in order."""
    ranks: dict = {}
    for (g, r), b in br.items():
        ranks.setdefault((g, b[2]), (b, []))[1].append(r)
    keys = sorted(ranks, key=lambda k: (str(k[0]), k[1]))
    return [(g, *ranks[(g, below)][0]) for g, below in keys], [sorted(ranks[k][1]) for k in keys]


def at_most(values: Sequence[float], v: Column, then: Sequence[Column] | None = None) -> Column:
    """How many of the ascending ``values`` are at most ``v`` (not null), or what ``then`` holds for that number. A halving search
    of plain comparisons, which Spark compiles; a higher-order function over an array of them is interpreted for every row."""
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo) if then is None else then[lo]
        mid = (lo + hi) // 2
        return F.when(v >= F.lit(values[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))
    return search(0, len(values))


def _literal(lists: Sequence[Sequence[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(v) for v in own]) for own in lists])


def _in_brackets(d: DataFrame, group: str, brackets: Sequence[tuple]) -> DataFrame:
    """(_w, _v): the values inside one of the disjoint brackets, sorted within each group, with the bracket's number."""
    per_group: dict = {}
    for i, (g, lo, hi, *_) in enumerate(brackets):
        per_group.setdefault(g, []).append((i, lo, hi))
    w, v = F.lit(None).cast("int"), F.col("_v")
    for g, own in per_group.items():
        w = F.when(F.col(group) == F.lit(g), at_most([b[1] for b in own], v, [F.lit(None).cast("int"), *[F.when(v <= b[2], F.lit(b[0])) for b in own]])).otherwise(w)
    return d.select(w.alias("_w"), "_v").where(F.col("_w").isNotNull())


def counted_medians(counts: DataFrame, group: str, value: str, n: str, leaf: int = 20_000) -> dict:
    """{group: exact median} of a table (group, value, n) that says how often each value stands, in any number of rows.

    A group with more than ``leaf`` rows is narrowed first: its range is cut into 1,024 equal ones, the one that holds the
    wanted rank is the next range, until few enough rows are left. A pass is one partial aggregate of 1,024 sums; the
    lowest and the highest value of a range never share a bucket, so every pass takes some of them away."""
    d = counts.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"), F.col(n).alias("n"))
    stats = d.groupBy("g").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    out = {}
    for s in stats:
        mine = d.where(F.col("g") == s["g"])
        low, high = (_counted_rank(mine, k, s["rows"], s["lo"], s["hi"], leaf) for k in ((s["n"] - 1) // 2, s["n"] // 2))
        out[s["g"]] = low + (high - low) * 0.5
    return out


def _counted_rank(d: DataFrame, rank: int, rows: int, lo: float, hi: float, leaf: int) -> float:
    """The value at the 0-based ``rank`` among the values of ``d`` (v, n), all in [lo, hi]."""
    while rows > leaf and lo < hi:
        width = hi / 1024 - lo / 1024
        bucket = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)), F.lit(1023)) if width else (F.col("v") > F.lit(lo)).cast("long")
        found = (d.where(F.col("v").between(lo, hi)).groupBy(bucket.alias("b"))
                 .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
        for r in sorted(found, key=lambda r: r["b"]):
            if rank < r["n"]:
                rows, lo, hi = r["rows"], r["lo"], r["hi"]
                break
            rank -= r["n"]
    if lo == hi:
        return lo
    for r in sorted(d.where(F.col("v").between(lo, hi)).groupBy("v").agg(F.sum("n").alias("n")).collect()):
        if rank < r["n"]:
            return r["v"]
        rank -= r["n"]
    raise ValueError("rank beyond the values")
