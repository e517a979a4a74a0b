"""Year-to-year rotations under several anchor rules from one cube of Gram sums, and what is read in a common space.

A pass over the pairs of vectors (year, key, a, b) emits sums of outer products for each cell: a year and a bit mask of the
row's memberships. Any rule's Gram matrix, and the same with a group left out, is a sum of cells, so that rotations, their
cosine on rows held out, the anchors' effective rank and leave-one-out fits come from d x 2d numbers a cell on the
driver, without another pass. Rotations then go to the tasks as a few matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolens.functions.stats import quantiles
from foliolens.operators.align import STAYER, effective_rank, is_stayer, procrustes
from foliolens.operators.sphere import Mixture, posterior

RULES = ("all", "stable_thr", "stable_strat")
#: Rows of a block in which anchors are paired at random.
PAIRED = 256


def drawn(key: str, year: str, of: int, seed: int = 7) -> Column:
    """Whether a row is among the one in `of` that a hash of year, key and seed draws."""
    text = F.concat_ws("/", F.lit(seed), F.col(year), F.col(key))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % of == 0


def memberships(pairs: DataFrame, year: str, key: str, stratum: str, least: int = 200, at: float = STAYER, top: float = 0.25, of: int = 5, held_out: Column | None = None) -> DataFrame:
    """pairs with held_out, stable, and mem: bits 0 to 2 for the anchors of RULES among all rows, bits 3 to 5 for those among the
    rows that are not held out; and a year's fallback_all, fallback_pool: whether too few rows were stable for `stable_thr`,
    which then takes the `least` most stable ones.

    Ranks of a year are kept up to `least` only, by each task before they meet; quantiles come from ranges. Both go to the rows, so that
    vectors among their columns stay where they are.
    """
    rows = pairs.withColumns({"held_out": drawn(key, year, of) if held_out is None else held_out, "stable": is_stayer(F.col("wt_overlap"), at)})
    counts = rows.groupBy(year).agg(F.sum(F.col("stable").cast("int")).alias("__all"), F.sum((F.col("stable") & ~F.col("held_out")).cast("int")).alias("__pool"))
    counts = counts.select(year, (F.col("__all") < least).alias("fallback_all"), (F.col("__pool") < least).alias("fallback_pool"))
    rows = rows.join(F.broadcast(counts), year)  # a row for each year
    bits, whole = [], rows
    for name, some in (("all", whole), ("pool", whole.where("NOT held_out"))):
        nth = F.row_number().over(Window.partitionBy(year).orderBy(F.col("wt_overlap").desc(), key))
        best = some.where(F.col(f"fallback_{name}")).select(year, key, "wt_overlap").withColumn("__nth", nth).where(F.col("__nth") <= least).select(year, key, F.lit(True).alias(f"__best_{name}"))
        cut = quantiles(some, "wt_overlap", [1 - top], [year, stratum], f"__q_{name}")
        rows = rows.join(F.broadcast(best), [year, key], "left").join(F.broadcast(cut), [year, stratum], "left")  # `least` rows a year, and one for each stratum
        inside = F.lit(True) if name == "all" else ~F.col("held_out")
        thr = F.when(F.col(f"fallback_{name}"), F.coalesce(f"__best_{name}", F.lit(False))).otherwise(F.col("stable"))
        strat = F.coalesce(F.col("wt_overlap") >= F.get(f"__q_{name}", F.lit(0)), F.lit(False))
        bits += [inside, inside & thr, inside & strat]
    mem = sum((F.when(b, F.lit(1 << k)).otherwise(F.lit(0)) for k, b in enumerate(bits)), F.lit(0)).cast("int")
    return rows.withColumn("mem", mem).drop(*[c for c in rows.columns if c.startswith("__")])


def _matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of lists of equal length, as rows."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(column), -1)


def few(pairs: DataFrame) -> DataFrame:
    """pairs in no more tasks than cores, as each task of the cube sends all its cells: what is shuffled does not grow with the table."""
    return pairs.coalesce(max(1, pairs.sparkSession.sparkContext.defaultParallelism))


def cube(pairs: DataFrame, by: list[str], null: dict[str, int] | None = None, times: int = 0, seed: int = 0) -> tuple[dict, dict]:
    """{cell: (n, sum of a a', sum of a b')}, cells by the values of `by`; and {(year, rule): [sum of a b' with b dealt anew]}.

    null: for each rule the bit of column mem that marks its anchors; by[0] is then the year. Anchors of a rule are paired at
    random in blocks of about PAIRED of them, each with another's b, `times` times.
    """
    null = null or {}
    columns = list(dict.fromkeys([*by, *(["mem"] if null else [])]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple, list] = {}
        waits: dict[tuple, list] = {}
        dealt: dict[tuple, np.ndarray] = {}
        rng = np.random.default_rng(seed)

        def deal(key: tuple) -> None:
            a, b = (np.concatenate(m) for m in zip(*waits.pop(key), strict=True))
            if len(a) < 2:
                return
            for k in range(times):
                order = rng.permutation(len(a))  # each goes to the next one of a random ring: none keeps its own
                to = np.empty(len(a), dtype=np.int64)
                to[order] = np.roll(order, 1)
                dealt[(*key, k)] = dealt.get((*key, k), 0) + a.T @ b[to]

        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = _matrix(batch.column("a")), _matrix(batch.column("b"))
            names = pd.DataFrame({c: batch.column(c).to_pandas() for c in columns})
            both = np.hstack([a, b])
            for cell, rows in names.groupby(by, dropna=False).indices.items():
                cell = cell if isinstance(cell, tuple) else (cell,)
                held = cells.setdefault(cell, [0, 0])
                held[0] += len(rows)
                held[1] = held[1] + a[rows].T @ both[rows]
            for rule, bit in null.items():
                marked = np.flatnonzero((names["mem"].to_numpy() >> bit) & 1)
                for year in np.unique(names[by[0]].to_numpy()[marked]):
                    rows = marked[names[by[0]].to_numpy()[marked] == year]
                    waits.setdefault((year, rule), []).append((a[rows], b[rows]))
                    if sum(len(x) for x, _ in waits[year, rule]) >= PAIRED:
                        deal((year, rule))
        for key in list(waits):
            deal(key)
        yield from _sent([(cell, None, -1, n, m) for cell, (n, m) in cells.items()] + [((y, *[None] * (len(by) - 1)), rule, k, 0, m) for (y, rule, k), m in dealt.items()])

    kinds = dict(pairs.dtypes)
    fields = [pa.field(c, {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[kinds[c]]) for c in by]
    schema = pa.schema([*fields, ("rule", pa.string()), ("deal", pa.int32()), ("n", pa.int64()), ("i", pa.int32()), ("row", pa.list_(pa.float64()))])

    def _sent(found: list) -> Iterator[pa.RecordBatch]:
        for cell, rule, k, n, m in found:
            size = len(m)
            values = [pa.array([None if v is None or v != v else v if isinstance(v, str) else np.asarray(v).item()] * size, type=f.type) for v, f in zip(cell, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*values, pa.array([rule] * size, type=pa.string()), pa.array([k] * size, type=pa.int32()), pa.array([n] + [0] * (size - 1), type=pa.int64()), pa.array(range(size), type=pa.int32()), pa.array(list(m), type=pa.list_(pa.float64()))], schema=schema)

    first = pairs.select("a").first()
    if first is None:
        return {}, {}
    d = len(first[0])
    parts = pairs.select(*columns, "a", "b").mapInArrow(sums, ", ".join(f"{c} {kinds[c]}" for c in by) + ", rule string, deal int, n long, i int, row array<double>")
    rows = parts.groupBy(*by, "rule", "deal", "i").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("row", j)) for j in range(2 * d)]).alias("row")).collect()
    cells, deals = {}, {}
    for r in rows:
        if r["rule"] is None:
            n, aa, ab = cells.setdefault(tuple(r[c] for c in by), [0, np.zeros((d, d)), np.zeros((d, d))])
            cells[tuple(r[c] for c in by)][0] = n + r["n"]
            aa[r["i"]], ab[r["i"]] = r["row"][:d], r["row"][d:]
        else:
            deals.setdefault((r[by[0]], r["rule"]), {}).setdefault(r["deal"], np.zeros((d, d)))[r["i"]] = r["row"][:d]
    return {k: tuple(v) for k, v in cells.items()}, {k: list(v.values()) for k, v in deals.items()}


def added(cells: dict, chosen: Callable[..., bool]) -> tuple[int, np.ndarray, np.ndarray] | None:
    """The sums of the cells whose values are chosen."""
    parts = [v for k, v in cells.items() if chosen(*k)]
    return tuple(sum(p[i] for p in parts) for i in range(3)) if parts else None


def mean_cosine(rotation: np.ndarray, part: tuple | None, least: int = 1) -> float | None:
    """The mean cosine of a R and b over the rows of a part, from its sums: tr(R' sum a b') / n."""
    return float((rotation * part[2]).sum() / part[0]) if part and part[0] >= least else None


def by_rule(rows: DataFrame, year: str, times: int = 20, seed: int = 0) -> tuple[dict, list[dict]]:
    """{(rule, year): rotation} of all anchors, and a row for each year and rule: anchors and whether they are a fallback, effective
    rank, and, for rotations fitted without the rows held out, those rows' mean cosine (of all, of the stable ones where
    there are five) and what anchors paired at random give. rows: of memberships(); read once."""
    cells, deals = cube(few(rows), [year, "mem", "held_out", "stable", "fallback_all"], {r: k + 3 for k, r in enumerate(RULES)}, times, seed)
    rotations, out = {}, []
    for y in sorted({k[0] for k in cells}):
        own = {k: v for k, v in cells.items() if k[0] == y}
        held, steady = added(own, lambda _y, _m, h, _s, _f: h), added(own, lambda _y, _m, h, s, _f: h and s)
        for k, rule in enumerate(RULES):
            final = added(own, lambda _y, m, _h, _s, _f, k=k: m >> k & 1)
            train = added(own, lambda _y, m, _h, _s, _f, k=k: m >> (k + 3) & 1)
            if final is None:
                continue
            rotations[rule, y] = procrustes(final[2])
            fitted = procrustes(train[2]) if train else None
            null = [mean_cosine(procrustes(m), held) for m in deals.get((y, rule), [])] if held else []
            out.append(
                {
                    "year": int(y), "rule": rule, "n_anchor": int(final[0]), "fallback": bool(rule == "stable_thr" and next(iter(own))[4]), "n_train": int(train[0]) if train else 0, "n_held": int(held[0]) if held else 0,
                    "eff_rank": effective_rank(train[1]) if train else None, "cos_stable": mean_cosine(fitted, steady, 5) if train else None, "cos_all": mean_cosine(fitted, held) if train else None, "cos_null": float(np.mean(null)) if null else None,
                }
            )
    return rotations, out


def displaced(pairs: DataFrame, rotations: dict[str, dict], by: list[str]) -> DataFrame:
    """pairs without a and b, and for each name of rotations disp_<name>, 1 - cos(a R, b) under the row's own matrix; null without one."""
    kept = [c for c in pairs.columns if c not in ("a", "b")]
    kinds = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = _matrix(batch.column("a")), _matrix(batch.column("b"))
            groups = pd.DataFrame({c: batch.column(c).to_pandas() for c in by}).groupby(by, dropna=False).indices
            out = {name: np.full(len(a), np.nan) for name in rotations}
            for cell, rows in groups.items():
                cell = cell if isinstance(cell, tuple) else (cell,)
                for name, held in rotations.items():
                    if (r := held.get(cell)) is not None:
                        out[name][rows] = 1 - ((a[rows] @ r) * b[rows]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(v, from_pandas=True) for v in out.values())], names=[*kept, *(f"disp_{n}" for n in out)])

    return pairs.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"disp_{n} double" for n in rotations)]))


def labelled_in(vectors: DataFrame, year: str, keys: list[str], into: dict[str, dict], m: Mixture, vec: str = "embedding") -> DataFrame:
    """keys, label_<rule> for each rule's matrices into the reference year's space ({rule: {year: matrix}}), and of the
    first rule max_post and loglik: the mixture's posterior of all rotated vectors in one pass."""
    kinds = dict(vectors.dtypes)
    rules = list(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(vec))
            years = batch.column(year).to_numpy(zero_copy_only=False)
            labels = {r: np.full(len(x), -1, dtype=np.int32) for r in rules}
            sure, like = np.full(len(x), np.nan), np.full(len(x), np.nan)
            for y in np.unique(years):
                rows = np.flatnonzero(years == y)
                for r in rules:
                    if (turn := into[r].get(y.item())) is not None:
                        post, ll = posterior(x[rows] @ turn, m.mu, m.rho, m.pi)
                        labels[r][rows] = post.argmax(axis=1)
                        if r == rules[0]:
                            sure[rows], like[rows] = post.max(axis=1), ll
            found = [pa.array(labels[r], mask=labels[r] < 0) for r in rules]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *found, pa.array(sure, from_pandas=True), pa.array(like, from_pandas=True)], names=[*keys, *(f"label_{r}" for r in rules), "max_post", "loglik"])

    columns = list(dict.fromkeys([*keys, year, vec]))
    return vectors.select(*columns).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"label_{r} int" for r in rules), "max_post double", "loglik double"]))


def agreement(panel: DataFrame, year: str, rules: list[str]) -> DataFrame:
    """By year: n, mean log-likelihood under the first rule, and for each other rule the share of rows that it labels alike."""
    same = [F.avg((F.col(f"label_{rules[0]}") == F.col(f"label_{r}")).cast("int")).alias(f"agree_{r}") for r in rules[1:]]
    return panel.groupBy(year).agg(F.count(F.lit(1)).alias("n"), F.avg("loglik").alias("loglik_ref"), *same)


def without_each(rows: DataFrame, year: str, group: str, at: float = STAYER, top: float = 0.25, least: int = 5) -> DataFrame:
    """Year and group: median displacement of the group's own stable members and movers (st_, mv_) under rotations fitted by each rule
    (thr, strat, all) without the group, and the rule that is best on stable members. rows: year, key, a, b, wt_overlap, group.

    A rule's Gram without a group is its total less the group's: strata are the groups themselves, so the others' anchors stay.
    Medians of fewer than `least` members are null.
    """
    cut = quantiles(rows, "wt_overlap", [1 - top], [year, group], "__q")
    strat = F.coalesce(F.col("wt_overlap") >= F.get("__q", F.lit(0)), F.lit(False))
    rows = rows.join(cut, [year, group]).withColumn("mem", (F.lit(1) + is_stayer(F.col("wt_overlap"), at).cast("int") * 2 + strat.cast("int") * 4).cast("int")).drop("__q")
    cells, _ = cube(few(rows), [year, group, "mem"])
    names = {"thr": 1, "strat": 2, "all": 0}
    rotations: dict[str, dict] = {n: {} for n in names}
    for y, g in {k[:2] for k in cells}:
        for name, bit in names.items():
            rest = added(cells, lambda y1, g1, m, y=y, g=g, bit=bit: y1 == y and g1 != g and m >> bit & 1)
            if rest:
                rotations[name][y, g] = procrustes(rest[2])
    moved = displaced(rows.select(year, group, "a", "b", F.when(F.col("mem").bitwiseAND(2) > 0, "st").otherwise("mv").alias("member")), rotations, [year, group])
    out = moved.groupBy(year, group).agg(F.count(F.when(F.col("member") == "st", 1)).alias("n_stable"), F.count(F.when(F.col("member") == "mv", 1)).alias("n_movers"))
    for name in names:
        q = quantiles(moved.where(F.col(f"disp_{name}").isNotNull()), f"disp_{name}", [0.5], [year, group, "member"])
        wide = q.groupBy(year, group).agg(*[F.first(F.when(F.col("member") == p, F.get("q", F.lit(0))), ignorenulls=True).alias(f"{p}_{name}") for p in ("st", "mv")])
        out = out.join(wide, [year, group], "left")
    for p, n in (("st", "n_stable"), ("mv", "n_movers")):
        out = out.withColumns({f"{p}_{name}": F.when(F.col(n) >= least, F.col(f"{p}_{name}")) for name in names})
    best = F.array_min(F.array(*[F.when(F.col(f"st_{name}").isNotNull(), F.struct(F.col(f"st_{name}").alias("d"), F.lit(k).alias("k"))) for k, name in enumerate(names)]))
    return out.withColumn("best_on_stable", F.element_at(F.array(*[F.lit(n) for n in names]), best["k"] + 1))
