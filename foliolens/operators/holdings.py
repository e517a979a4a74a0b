"""From raw positions to the pruned panel: windows, aggregation, latest report, concentration, core."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolens.sources.durable import stored


def in_window(df: DataFrame, date_col: str, quarter_col: str, days: int) -> DataFrame:
    """Reports within days of the snapshot, both ends included."""
    q = F.col(quarter_col)
    return df.where(F.col(date_col).between(F.date_sub(q, days), F.date_add(q, days)))


def reported(df: DataFrame, filers: tuple[str, ...], funds: tuple[str, ...], filer_days: int, fund_days: int) -> DataFrame:
    """Holdings (investor_id, investor_type, quarter_end, issuer_id, mv) from reports that also have a report_date.

    Filers' reports within filer_days of the snapshot are summed; of a fund's reports within fund_days the newest
    counts for each issuer, of equal dates the larger value. Other types, empty and negative positions are left out.
    """
    rows = df.where((F.col("mv") > 0) & F.col("issuer_id").isNotNull())
    keys = ["investor_id", "investor_type", "quarter_end", "issuer_id"]
    filed = in_window(rows.where(F.col("investor_type").isin(*filers)), "report_date", "quarter_end", filer_days)
    fund = in_window(rows.where(F.col("investor_type").isin(*funds)), "report_date", "quarter_end", fund_days)
    newest = fund.groupBy(*keys).agg(F.max(F.struct("report_date", "mv")).alias("r")).select(*keys, F.col("r.mv").alias("mv"))
    return filed.groupBy(*keys).agg(F.sum("mv").alias("mv")).unionByName(newest)


def aggregate_holdings(df: DataFrame, keys: list[str], value: str = "mv") -> DataFrame:
    """Market value summed for each key; share classes of an issuer come together."""
    return df.where(F.col(value) > 0).groupBy(*keys).agg(F.sum(value).alias(value))


def latest_report(df: DataFrame, keys: list[str], date_col: str, ties: list) -> DataFrame:
    """The newest row of each key; ties in the given order."""
    w = Window.partitionBy(*keys).orderBy(F.col(date_col).desc(), *ties)
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def not_concentrated(df: DataFrame, keys: list[str], value: str = "mv", most: float = 0.75) -> DataFrame:
    """Groups whose largest position is at most `most` of the whole; a table that is dealt by the keys is not dealt again."""
    book = Window.partitionBy(*keys)
    rows = df.dropna(subset=keys).withColumn("__share", F.max(value).over(book) / F.sum(value).over(book))
    return rows.where(F.col("__share") <= most).drop("__share")


#: Nodes that go at once and are still broadcast to the edges.
SENT = 500_000


def _matching(edges: DataFrame, nodes: DataFrame, keys: list[str], rows: int, how: str) -> DataFrame:
    return edges.join(F.broadcast(nodes.select(*keys)) if rows <= SENT else nodes.select(*keys), keys, how)


def core(df: DataFrame, period: str = "period", investor: str = "investor_id", issuer: str = "issuer_id", min_issuers: int = 20, min_investors: int = 20) -> DataFrame:
    """The largest part of the bipartite graph in which each side keeps its least degree, all periods at once.

    Edges are dealt by book (investor and period) and stored once; a table that is dealt so already is not dealt again. Rounds hold
    the degrees of the nodes only: nodes that go are looked up in the edges, and the edges found there lower the degrees of
    their other ends, so that each edge is shuffled at most once from either end. It ends when no node goes; the edges of
    all nodes that went are then left out in one pass.
    """
    book, other, n = [investor, period], [issuer, period], F.col("__n")
    df = df.dropna(subset=[investor, issuer, period])
    edges = stored(df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*book))).where(n >= min_issuers).drop("__n"), "edges")
    degrees = {tuple(k): stored(edges.groupBy(*k).agg(F.count(F.lit(1)).alias("__n")), "degrees") for k in (book, other)}
    gone: dict[tuple, list[tuple[DataFrame, int]]] = {tuple(book): [], tuple(other): []}
    side, far, least, far_least = other, book, min_investors, min_issuers
    while rows := (out := degrees[tuple(side)].where(n < least)).count():
        gone[tuple(side)].append((out, rows))
        lost = _matching(edges, out, side, rows, "left_semi").groupBy(*far).agg(F.count(F.lit(1)).alias("__lost"))
        left = degrees[tuple(far)].where(n >= far_least).join(lost, far, "left")  # those that went before are not counted again
        degrees[tuple(far)] = stored(left.select(*far, (n - F.coalesce("__lost", F.lit(0))).alias("__n")), "degrees")
        side, far, least, far_least = far, side, far_least, least
    if not any(gone.values()):
        return edges
    for keys in (other, book):
        parts = gone[tuple(keys)]
        if parts:
            every = parts[0][0]
            for part, _ in parts[1:]:
                every = every.unionByName(part)
            edges = _matching(edges, every, keys, sum(k for _, k in parts), "left_anti")
    return stored(edges.select(*df.columns), "core")


def positions(df: DataFrame, keys: list[str], context: int = 62) -> DataFrame:
    """Rank by value (ties by issuer), weight within the book, size of the book, and chunk of each position."""
    from foliolens.functions.sequences import chunk_of

    book = Window.partitionBy(*keys)
    out = df.withColumn("w", F.col("mv") / F.sum("mv").over(book)).withColumn("n_assets_full", F.count(F.lit(1)).over(book).cast("int"))
    out = out.withColumn("rank", F.row_number().over(book.orderBy(F.col("mv").desc(), "issuer_id")).cast("int"))
    return out.withColumn("chunk_id", chunk_of(F.col("rank"), F.col("n_assets_full"), context))


def sequences(pos: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each chunk: tokens and weights in order of rank."""
    item = F.struct("rank", "issuer_id", "w")
    rows = pos.groupBy(*keys, "chunk_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("n_assets_full").alias("n_assets_full"))
    return rows.select(*keys, "chunk_id", F.col("items.issuer_id").alias("tokens"), F.col("items.w").alias("weights"), F.size("items").alias("n_tokens"), "n_assets_full")


def _in_slice(context: int) -> Column:
    return (F.col("chunk_id") <= 2) & (F.col("rank") <= context)


def slice_weights(pos: DataFrame, keys: list[str], context: int = 62) -> DataFrame:
    """pos with the weights of each book's first positions renormalised within that slice (uniform if they sum to nothing); others have none."""
    book, inside = Window.partitionBy(*keys), _in_slice(context)
    total, n = F.sum(F.when(inside, F.col("w"))).over(book), F.count(F.when(inside, 1)).over(book)
    return pos.withColumn("pw", F.when(inside, F.when(total > 0, F.col("w") / total).otherwise(1.0 / n)))


def totalled(df: DataFrame, keys: list[str], context: int = 62) -> DataFrame:
    """df with the size of the book and the rank of each position, and what `weighed` makes all weights of: the book's sum, and the weight and
    the number of its first positions. Sums are the same all over a book, so that they take hardly any room in a sorted file."""
    from foliolens.functions.sequences import chunk_of

    book = Window.partitionBy(*keys)
    out = df.withColumns({"__book": F.sum("mv").over(book), "n_assets_full": F.count(F.lit(1)).over(book).cast("int")})
    out = out.withColumn("rank", F.row_number().over(book.orderBy(F.col("mv").desc(), "issuer_id")).cast("int"))
    out = out.withColumn("chunk_id", chunk_of(F.col("rank"), F.col("n_assets_full"), context))
    inside = _in_slice(context)
    sums = {"__slice": F.sum(F.when(inside, F.col("mv") / F.col("__book"))).over(book), "__places": F.count(F.when(inside, 1)).over(book)}
    return out.withColumns(sums).drop("chunk_id")


def weighed(rows: DataFrame, context: int = 62) -> DataFrame:
    """rows of `totalled` with `positions`' and `slice_weights`' columns."""
    from foliolens.functions.sequences import chunk_of

    out = rows.withColumns({"w": F.col("mv") / F.col("__book"), "chunk_id": chunk_of(F.col("rank"), F.col("n_assets_full"), context)})
    out = out.withColumn("pw", F.when(_in_slice(context), F.when(F.col("__slice") > 0, F.col("w") / F.col("__slice")).otherwise(1.0 / F.col("__places"))))
    kept = [c for c in rows.columns if c not in ("__book", "__slice", "__places", "n_assets_full", "rank")]
    return out.select(*kept, "w", "n_assets_full", "rank", "chunk_id", "pw")


def top_slice(pos: DataFrame, keys: list[str], context: int = 62) -> DataFrame:
    """The first positions of each book with slice_weights, which pos may have already."""
    return (pos if "pw" in pos.columns else slice_weights(pos, keys, context)).where(_in_slice(context))


def joined_books(seq: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks put together again: the whole book with weights clipped and renormalised."""
    from foliolens.functions.sequences import normalised

    c = F.array_sort(F.collect_list(F.struct("chunk_id", "tokens", "weights")))
    rows = seq.groupBy(*keys).agg(c.alias("c"))
    rows = rows.select(*keys, F.flatten("c.tokens").alias("tokens"), F.flatten("c.weights").alias("weights"))
    uniform = F.transform("tokens", lambda t: F.lit(1.0))
    return rows.select(*keys, "tokens", normalised(F.when(F.size("tokens") == F.size("weights"), F.col("weights")).otherwise(uniform)).alias("weights"))


def preflight(seq: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Per book: array sizes agree, weights sum to one, chunks are 1..m."""
    rows = seq.groupBy(*keys).agg(
        F.sum(F.aggregate("weights", F.lit(0.0), lambda s, v: s + v)).alias("weight_sum"),
        F.max(F.when(F.size("tokens") != F.size("weights"), 1).otherwise(0)).alias("mismatch"),
        F.count(F.lit(1)).alias("chunks"),
        F.count_distinct("chunk_id").alias("distinct_chunks"),
        F.min("chunk_id").alias("first_chunk"),
        F.max("chunk_id").alias("last_chunk"),
    )
    ok_sum = (F.abs(F.col("weight_sum") - 1) <= tolerance) & ~F.isnan("weight_sum")
    ok_chunks = (F.col("first_chunk") == 1) & (F.col("last_chunk") == F.col("chunks")) & (F.col("chunks") == F.col("distinct_chunks"))
    return rows.select(*keys, (F.col("mismatch") == 0).alias("sizes_ok"), ok_sum.alias("weights_ok"), ok_chunks.alias("chunks_ok"), "weight_sum")


def latest_in_window(prices: DataFrame, listing: str, day: str, snapshot: str, days: int, values: list[str]) -> DataFrame:
    """listing, day and values of each listing's newest row within `days` days before the snapshot, that day included; rows without a value are
    left out, and of one day's rows that of the largest values is taken.

    The bounds are literals of the column's own type, so that the scan gets them; newest rows are picked by partial aggregation.
    """
    kind = dict(prices.dtypes)[day]
    low, high = (F.expr(f"CAST(date_add(DATE'{snapshot}', {n}) AS {kind})") for n in (-days, 1))
    rows = prices.where((F.col(day) >= low) & (F.col(day) < high)).dropna(subset=values)
    newest = rows.groupBy(listing).agg(F.max(F.struct(day, *values)).alias("__r"))
    return newest.select(listing, *[F.col(f"__r.{c}").alias(c) for c in (day, *values)])
