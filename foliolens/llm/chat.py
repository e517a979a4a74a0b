"""Chat formatting over reply trees, with DataFrame operations only.

Messages point at the message they answer. Self-joins that double their reach each time give every message
its depth and the score summed from its root (`ranked_leaves`); in each tree the best-scored leaves are
chosen; the jumps are then walked back from the chosen leaves to their roots, again halving the reach each
time (`paths`), so that long replies take a logarithmic number of joins and only chosen paths are written
out. Each path becomes one conversation (`format_paths`): a turn is marked by control strings, and texts
escape them with a backslash, so that `parse` reads the turns back exactly. The loss mask is a list of
spans (code points of the formatted text) over the assistants' texts.

Defined cases: a null text or role is empty; a null score counts 0; a null conv_id is a conversation like others;
turns of equal number stand in order of role and text; repeated rows stay as turns of their own; a message whose parent
is missing is a root, and so is the smallest message of a cycle of parents; of several rows with one message id the
least counts (`distinct_messages`); branches of equal score rank by their leaf; a conversation is one row of the
output, so it must fit a row (2 GB); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolens.llm.common import documents, stored

OPEN, BODY, CLOSE = "<|turn|>", "<|text|>", "</s>"
ASSISTANT = "assistant"
# Control strings: ours, and those of other common templates, so that no text can pass for markup in either.
_CONTROL = r"(<|\[|<<)(\|[a-z_]+\|>|/?s>|/?INST\]|/?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear_tree(rows: DataFrame) -> DataFrame:
    """Conversations whose rows come one after another, as trees: each message answers the one before it."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return rows.withColumn("node", node).select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.length("text").cast("double").alias("score"))


def _at(left: DataFrame, right: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """left joined with right (k, n, ...) on conv_id = k and column = n."""
    return left.join(right, F.col("conv_id").eqNullSafe(F.col("k")) & (F.col(column) == F.col("n")), how)


def _cycle_roots(stuck: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(k, n): the smallest message of each cycle. stuck: messages that reach no root however far they jump; the
    places where they end are on cycles."""
    low = stuck.select("conv_id", F.col("up").alias("node"), F.col("up").alias("low")).distinct()
    for table in tables:
        known = low.select(F.col("conv_id").alias("k"), F.col("node").alias("n"), F.col("low").alias("low2"))
        step = table.select(F.col("conv_id").alias("k"), F.col("node").alias("n"), F.col("up"))
        low = _at(_at(low, step, "node").drop("k", "n"), known, "up")
        low = stored(low.select("conv_id", "node", F.least("low", "low2").alias("low")), "cycles")
    return low.select(F.col("conv_id").alias("k"), F.col("low").alias("n")).distinct()


def jumps(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """nodes without cycles, tables of jumps over 1, 2, 4 ... replies, and each message's depth and summed score.

    A tree leaves the joins when all of its messages have reached their root, so the later ones hold deep trees only.
    """
    known = nodes.select(F.col("conv_id").alias("k"), F.col("node").alias("n"))
    first = _at(nodes.select("conv_id", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), known, "parent", "left")
    state = stored(first.select("conv_id", "node", F.col("n").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("fresh")), "jumps")
    largest = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    tables, done = [], []
    while True:
        done.append(state.where("up IS NULL AND fresh").select("conv_id", "node", "total", "depth"))
        live = state.where("up IS NOT NULL").drop("fresh")
        if not live.limit(1).count():
            break
        if 1 << len(tables) >= largest:  # farther than any path: these run in circles
            cut = stored(_cycle_roots(live, tables), "cycles")
            opened = _at(nodes, cut, "node", "left").withColumn("parent", F.when(F.col("n").isNull(), F.col("parent")))
            return jumps(stored(opened.select(*nodes.columns), "nodes"))
        tables.append(live.select("conv_id", "node", "up"))
        over = state.select(F.col("conv_id").alias("k"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"))
        joined = _at(live, over, "up").select("conv_id", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("depth") + F.col("depth2")).alias("depth"), F.lit(True).alias("fresh"))
        trees = live.select(F.col("conv_id").alias("k")).distinct()
        ended = state.where("up IS NULL").join(trees, F.col("conv_id").eqNullSafe(F.col("k")), "left_semi").withColumn("fresh", F.lit(False))
        state = stored(joined.unionByName(ended), "jumps")
    totals = done[0]
    for d in done[1:]:
        totals = totals.unionByName(d)
    return nodes, tables, stored(totals, "depths")


def distinct_messages(nodes: DataFrame) -> DataFrame:
    """One row of each (conv_id, node): the least by parent, role, text and score."""
    least = nodes.groupBy("conv_id", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
    return least.select("conv_id", "node", "m.parent", "m.role", "m.text", "m.score")


def ranked_leaves(nodes: DataFrame, totals: DataFrame, branches: int) -> DataFrame:
    """The best leaves of each tree by mean score along the path; ties go to the smaller node."""
    parents = nodes.where("parent IS NOT NULL").select(F.col("conv_id").alias("k"), F.col("parent").alias("n")).distinct()
    leaves = totals.join(parents, F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("node") == F.col("n")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy((F.col("total") / F.col("depth")).desc(), "node"))
    return leaves.withColumn("branch", rank).where(F.col("branch") <= branches).select("conv_id", "branch", F.col("node").alias("leaf"), "node", "depth")


def paths(nodes: DataFrame, branches: int = 1, unique: bool = False) -> DataFrame:
    """conv_id, branch, depth, role, text of every message on the chosen root-to-leaf paths; unique: no message id occurs twice."""
    nodes = stored(nodes if unique else distinct_messages(nodes), "nodes")
    nodes, tables, totals = jumps(nodes)
    on = stored(ranked_leaves(nodes, totals, branches).select("conv_id", "branch", "node"), "paths")
    for table in reversed(tables):
        t = table.select(F.col("conv_id").alias("k"), F.col("node").alias("n"), "up")
        back = on.join(t, F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("node") == F.col("n"))).select("conv_id", "branch", F.col("up").alias("node"))
        on = stored(on.unionByName(back), "paths")
    at = totals.select(F.col("conv_id").alias("k"), F.col("node").alias("n"), "depth")
    on = on.join(at, F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("node") == F.col("n"))).select("conv_id", "branch", "node", "depth")
    said = nodes.select(F.col("conv_id").alias("k"), F.col("node").alias("n"), "role", "text")
    return on.join(said, F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("node") == F.col("n"))).select("conv_id", "branch", "depth", "role", "text")


def format_paths(rows: DataFrame) -> DataFrame:
    """One conversation for each path: formatted text and loss spans (start, end)."""
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(BODY))
    body = escape(F.col("text"))
    turns = rows.select("conv_id", "branch", "depth", F.length(head).alias("lead"), body.alias("body"), head.alias("head"), (F.col("role") == ASSISTANT).alias("learn"))
    size = F.col("lead") + F.length("body") + len(CLOSE)
    so_far = F.sum(size).over(Window.partitionBy("conv_id", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))
    turns = turns.withColumn("start", (F.coalesce(so_far, F.lit(0)) + F.col("lead")).cast("int"))
    turn = F.struct("depth", F.concat("head", "body", F.lit(CLOSE)).alias("s"), "start", (F.col("start") + F.length("body")).alias("end"), "learn")
    turns = turns.groupBy("conv_id", "branch").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return turns.select("conv_id", "branch", F.array_join(F.transform("turns", lambda t: t["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    pieces = F.slice(F.split(formatted, r"\Q" + OPEN + r"\E"), 2, 1 << 30)

    def turn(piece: Column) -> Column:
        parts = F.split(piece, r"\Q" + BODY + r"\E", 2)
        return F.struct(unescape(parts[0]).alias("role"), unescape(F.substring(parts[1], F.lit(1), F.length(parts[1]) - len(CLOSE))).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """What the output says of itself, read back from the formatted text and the mask."""
    out = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def format_conversations(rows: DataFrame, branches: int = 1) -> DataFrame:
    return format_paths(paths(linear_tree(rows), branches, unique=True))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, ASSISTANT, own)], "conv_id long, turn long, role string, text string")
    return digest(format_conversations(rows.unionByName(extra)))


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(regexp_replace(text, '\\', '\\\\', 'g'), '(<|\[|<<)(\|[a-z_]+\|>|/?s>|/?INST\]|/?SYS>>)', '\1\\\2', 'g') AS safe FROM c),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(length('<|turn|><|text|></s>') + length(role) + length(safe)) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM g
"""
