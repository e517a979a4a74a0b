"""Quality rules as a short-circuit cascade.

A rule is a measure of the text and a bound. On a bounded sample of documents the cost of each measure
and each rule's rejections among what earlier rules let pass are estimated; rules are then tried in order of
rejections per cost, and a document that fails one is not measured further. The verdict does not depend on the order, since a
document is kept if it passes every rule.

Defined cases: a null text has no words and fails the least-words rule; texts of any length are read
whole; repeated rows get a row each; other columns pass through unread; an empty table gives no rows, and
the order of the rules is then the given one.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.llm.common import bytes_of, documents, id_text, per_batch, rows_to_batch, small_batches

#: Documents on which costs and selectivities are estimated, and their longest in bytes: 64 MB at most.
SAMPLE, LONGEST = 500, 1 << 17
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"


class Text:
    """A text and the measures taken of it so far."""

    def __init__(self, data: bytes):
        self.data, self.taken = data, {}

    def get(self, name: str):
        if name not in self.taken:
            self.taken[name] = MEASURES[name](self)
        return self.taken[name]


def n_words(t: Text) -> int:
    return len(t.get("words"))


def word_chars(t: Text) -> int:
    """Code points in words: bytes that begin one, without the six blanks."""
    return len(t.data.decode("utf-8", "surrogatepass")) - sum(t.data.count(b) for b in SPACES)


def n_symbols(t: Text) -> int:
    return sum(t.data.count(b) for b in SYMBOLS)


def n_dup_lines(t: Text) -> int:
    lines = [x for x in t.data.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def n_lines(t: Text) -> int:
    return sum(1 for x in t.data.split(b"\n") if x.strip())


def n_repeat_words(t: Text) -> int:
    words = t.get("words")
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    k = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    v = len(number)
    if v == n:
        return 0
    # Number the pairs anew, so that a window's code stays below n * v.
    _, pair = np.unique(k[:-1] * v + k[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1] * v + k[2:], return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[window] > 1)
    hit = np.zeros(n, dtype=bool)
    for d in range(3):
        hit[again + d] = True
    return int(hit.sum())


MEASURES: dict[str, Callable[[Text], object]] = {
    "words": lambda t: t.data.split(),
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_dup_lines": n_dup_lines,
    "n_lines": n_lines,
    "n_repeat_words": n_repeat_words,
}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]
    base: bool = False


RULES = (
    Rule("few_words", lambda t: t.get("n_words") < 50, True),
    Rule("repeated_words", lambda t: 100 * t.get("n_repeat_words") > 50 * t.get("n_words"), True),
    Rule("symbols", lambda t: 10 * t.get("n_symbols") > t.get("n_words")),
    Rule("word_length", lambda t: not 2 * t.get("n_words") <= t.get("word_chars") <= 16 * t.get("n_words")),
    Rule("repeated_lines", lambda t: 100 * t.get("n_dup_lines") > 40 * t.get("n_lines")),
)


class Timed(Text):
    """As Text; says how long each measure took, without those that it needs itself."""

    def __init__(self, data: bytes):
        super().__init__(data)
        self.seconds, self.inner = {}, 0.0

    def get(self, name: str):
        if name not in self.taken:
            before, self.inner, began = self.inner, 0.0, time.perf_counter()
            self.taken[name] = MEASURES[name](self)
            whole = time.perf_counter() - began
            self.seconds[name] = whole - self.inner
            self.inner = before + whole
        return self.taken[name]


def cascade(sample: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """The rules, each next one that with the most rejections per second among the documents that the ones before
    have let pass; a measure costs only the first rule that needs it. Ties and rules without rejections by cost."""
    costs, hits = [], []
    for rule in rules:
        timed = [Timed(data) for data in sample]
        hits.append([rule.rejects(t) for t in timed])
        costs.append([t.seconds for t in timed])
    order, left, alive = [], list(range(len(rules))), list(range(len(sample)))
    taken: set[str] = set()
    while left and sample:
        rank = []
        for k in left:
            cost = 1e-9 + sum(s for i in alive for name, s in costs[k][i].items() if name not in taken)
            rank.append((-sum(hits[k][i] for i in alive) / cost, cost, k))
        k = min(rank)[2]
        order.append(rules[k])
        left.remove(k)
        taken |= {name for each in costs[k] for name in each}
        alive = [i for i in alive if not hits[k][i]]
    return order if sample else list(rules)


def sampled(docs: DataFrame, size: int = SAMPLE, longest: int = LONGEST) -> list[bytes]:
    """A bounded sample: the first rows of at most `longest` bytes that any few tasks meet. It decides the order of work only, never a result."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    return [bytes(r[0]) for r in docs.select(data.alias("data")).where(F.length("data") <= longest).limit(size).collect()]


def passes(t: Text, order: list[Rule]) -> bool:
    return not any(rule.rejects(t) for rule in order)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass every rule, all columns as they were."""
    small_batches(docs.sparkSession)
    order = cascade(sampled(docs), rules)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([passes(Text(x), order) for x in bytes_of(batch.column("text"))], type=pa.bool_()))

    return docs.mapInArrow(per_batch(keep), docs.schema)


_REPORT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_())])


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The verdict of the cascade, and all measures for the record."""
    small_batches(docs.sparkSession)
    docs = id_text(docs)
    order = cascade(sampled(docs), rules)
    base = [r for r in rules if r.base]
    names = [f.name for f in _REPORT][1:6]

    def row(data: bytes) -> tuple:
        t = Text(data)
        kept = passes(t, order)
        return (*(t.get(n) for n in names), not kept and not passes(t, base), kept)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        return rows_to_batch(_REPORT, [batch.column("doc_id"), *zip(*map(row, bytes_of(batch.column("text"))), strict=True)])

    return docs.mapInArrow(per_batch(measure), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))


#: The same rows in SQL, rule by rule.
OP7_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS pos FROM t),
g AS (SELECT k, pos, word, lead(word, 1) OVER q AS w2, lead(word, 2) OVER q AS w3 FROM w WINDOW q AS (PARTITION BY k ORDER BY pos)),
r AS (SELECT k, pos, w3 IS NOT NULL AND count(*) OVER (PARTITION BY k, word, w2, w3) > 1 AS again FROM g),
h AS (SELECT k, again OR coalesce(lag(again, 1) OVER q, false) OR coalesce(lag(again, 2) OVER q, false) AS hit FROM r WINDOW q AS (PARTITION BY k ORDER BY pos)),
n AS (SELECT k, count(*) FILTER (hit) AS n_repeat_words FROM h GROUP BY k),
c AS (SELECT k, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY k),
l AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
      coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM t LEFT JOIN c USING (k) LEFT JOIN l USING (k) LEFT JOIN n USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 16 * n_words OR 100 * n_dup_lines > 40 * n_lines) AS kept
FROM b
"""
