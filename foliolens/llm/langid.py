"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent networks read a text's bytes, one forwards and one backwards; both states together give each position
probabilities of the languages, and a document's are the mean over the positions that belong to letters. The network is trained on
the driver, in numpy, by backpropagation through time over short stretches of a bounded sample of labelled documents; SAMPLE and
STRETCHES are that bound. It then goes to all tasks, which read whole texts in windows of OWN positions, with CONTEXT more on each
side that only warm the states up; the windows of a batch are read side by side.

Documents whose crc32(doc_id as text) mod 4 is 2 are held out: nothing is learned from them. A prediction sees the text only.

Defined cases: a null text, and one without a letter, is `und` with score 0; rows without a doc_id are neither learned from nor
held out; an empty text is `und`; texts of any length are read whole; repeated rows get a row each, and at equal
texts equal results; a single learned language is predicted with score 1; without any labelled document all is `und`; ties of
probability fall to the first language in code-point order; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.llm.common import bytes_of, documents, small_batches

#: Labelled documents that are learned from, and stretches of each, at most; bytes of a stretch.
SAMPLE, STRETCHES, STRETCH = 6000, 4, 64
#: Numbers of a state; positions of a window that it labels, and those on each side that it only reads; windows read side by side.
HIDDEN, OWN, CONTEXT, SIDE = 8, 240, 8, 2048
#: Steps of training, stretches of a step, largest step size.
STEPS, BATCH, RATE = 400, 256, 0.02
PAD, UNKNOWN = 256, "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes that belong to letters: those of ASCII, and all of longer characters.
_OF_LETTER = np.array([*(chr(b).isalpha() for b in range(128)), *[True] * 128, False])


@dataclass
class Network:
    """Languages and parameters: for each direction the inputs' and the states' weights of update gate, reset gate and
    candidate; the output's weights of both states, and its bias."""

    languages: list[str]
    params: dict[str, np.ndarray]


GATES = ("z", "r", "n")


def begun(languages: list[str], hidden: int = HIDDEN, seed: int = 1, dtype=np.float32) -> Network:
    rng = np.random.default_rng(seed)
    p = {}
    for way in "fb":
        for g in GATES:
            p[f"W{g}{way}"] = rng.normal(0, 0.3, (PAD + 1, hidden))
            p[f"U{g}{way}"] = rng.normal(0, hidden**-0.5, (hidden, hidden))
        p[f"V{way}"] = rng.normal(0, hidden**-0.5, (hidden, len(languages)))
    p["c"] = np.zeros(len(languages))
    return Network(languages, {k: v.astype(dtype) for k, v in p.items()})


def states(p: dict[str, np.ndarray], way: str, x: np.ndarray, keep: bool = False) -> Iterator[tuple]:
    """t, state after the byte at t (and what led to it, if kept) for bytes x, time by row; time runs against x for `b`."""
    wz, wr, wn, uz, ur, un = (p[f"{m}{g}{way}"] for m in "WU" for g in GATES)
    h = np.zeros((x.shape[1], len(uz)), dtype=uz.dtype)
    z, r, n, g = (np.empty_like(h) for _ in range(4))
    with np.errstate(over="ignore"):
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            before = h.copy() if keep else None
            for s, w, u in ((z, wz, uz), (r, wr, ur)):
                np.matmul(h, u, out=s)
                np.take(w, x[t], axis=0, out=g, mode="clip")
                s += g
                np.negative(s, out=s)
                np.exp(s, out=s)
                s += 1
                np.reciprocal(s, out=s)
            np.matmul(h, un, out=n)
            q = n.copy() if keep else None
            n *= r
            np.take(wn, x[t], axis=0, out=g, mode="clip")
            n += g
            np.tanh(n, out=n)
            h -= n
            h *= z
            h += n
            yield (t, h, before, z.copy(), r.copy(), n.copy(), q) if keep else (t, h)


def logits(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Time x texts x languages."""
    out = np.empty((*x.shape, len(p["c"])), dtype=p["c"].dtype)
    for t, h in states(p, "b", x):
        np.matmul(h, p["Vb"], out=out[t])
    for t, h in states(p, "f", x):
        out[t] += h @ p["Vf"]
    return out + p["c"]


def loss_and_gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of all positions (PAD apart) of the texts x (time by row) of languages y, and its gradients, by
    backpropagation through time in both directions."""
    steps = {way: list(states(p, way, x, True)) for way in "fb"}
    after = {way: {s[0]: s[3] * (s[2] - s[5]) + s[5] for s in steps[way]} for way in "fb"}
    l = np.stack([after["f"][t] @ p["Vf"] + after["b"][t] @ p["Vb"] for t in range(len(x))]) + p["c"]
    l -= l.max(axis=2, keepdims=True)
    e = np.exp(l)
    prob = e / e.sum(axis=2, keepdims=True)
    real = (x != PAD).astype(l.dtype)
    total = max(float(real.sum()), 1.0)
    chosen = np.take_along_axis(prob, np.broadcast_to(y, x.shape)[..., None], axis=2)[..., 0]
    loss = float(-(np.log(np.maximum(chosen, 1e-30)) * real).sum() / total)
    d = prob.copy()
    np.put_along_axis(d, np.broadcast_to(y, x.shape)[..., None], (chosen - 1)[..., None], axis=2)
    d *= (real / total)[..., None]
    grads = {"c": d.sum(axis=(0, 1))}
    for way in "fb":
        uz, ur, un = (p[f"U{g}{way}"] for g in GATES)
        grads[f"V{way}"] = sum(after[way][t].T @ d[t] for t in range(len(x)))
        into = {g: np.empty((*x.shape, len(uz)), dtype=uz.dtype) for g in GATES}
        du = {g: np.zeros_like(uz) for g in GATES}
        back = np.zeros_like(steps[way][0][1])
        for t, _, h, z, r, n, q in reversed(steps[way]):
            dh = back + d[t] @ p[f"V{way}"].T
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * q * r * (1 - r)
            dq = dn * r
            back = dh * z + dz @ uz.T + dr @ ur.T + dq @ un.T
            for g, a in zip(GATES, (dz, dr, dq), strict=True):
                du[g] += h.T @ a
            into["z"][t], into["r"][t], into["n"][t] = dz, dr, dn
        flat = x.ravel()
        for g in GATES:
            grads[f"U{g}{way}"] = du[g]
            a = into[g].reshape(len(flat), -1)
            grads[f"W{g}{way}"] = np.stack([np.bincount(flat, weights=a[:, j], minlength=PAD + 1) for j in range(a.shape[1])], axis=1).astype(uz.dtype)
    return loss, grads


def train(stretches: np.ndarray, y: np.ndarray, languages: list[str], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 1) -> Network:
    """A network for stretches (a row of bytes each, PAD behind short ones) of languages y. Every language is drawn equally often."""
    net = begun(languages, hidden, seed)
    rng = np.random.default_rng(seed)
    share = 1.0 / np.bincount(y, minlength=len(languages))[y]
    share /= share.sum()
    first, second = ({k: np.zeros_like(v) for k, v in net.params.items()} for _ in range(2))
    for k in range(1, steps + 1):
        rows = rng.choice(len(y), batch, p=share)
        _, grads = loss_and_gradients(net.params, stretches[rows].T.astype(np.intp), y[rows])
        size = float(np.sqrt(sum((g.astype(float) ** 2).sum() for g in grads.values())))
        now = rate * (0.5 + 0.5 * np.cos(np.pi * k / steps)) * min(1.0, k / 20)
        for name, g in grads.items():
            g = g * min(1.0, 1.0 / max(size, 1e-12))
            first[name] = 0.9 * first[name] + 0.1 * g
            second[name] = 0.99 * second[name] + 0.01 * g * g
            step = first[name] / (1 - 0.9**k) / (np.sqrt(second[name] / (1 - 0.99**k)) + 1e-8)
            net.params[name] = (net.params[name] - now * step).astype(net.params[name].dtype)
    return net


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def labelled_stretches(docs: DataFrame, sample: int = SAMPLE, stretches: int = STRETCHES, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Stretches of at most `sample` documents that are not held out and have a language and a letter; their languages' numbers;
    the languages in order. Documents and places are drawn by hash."""
    draw = F.xxhash64("doc_id", F.length("text"), F.substring("text", 1, 64))
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(~held_out(), F.lit(False)))
    known = known.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), draw.alias("draw"))
    part = min(1.0, 2.0 * sample / max(known.count(), 1))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, data, h in zip(batch.column("lang").to_pylist(), bytes_of(batch.column("text")), batch.column("draw").to_pylist(), strict=True):
                if _LETTER.search(data.decode()):
                    starts = np.random.default_rng(h & (2**63 - 1)).integers(0, max(1, len(data) - stretch + 1), min(stretches, -(-len(data) // stretch)))
                    rows += [(lang, h, int(s), data[s : s + stretch]) for s in starts]
            columns = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["lang", "draw", "at", "bytes"])

    def drawn(rows: DataFrame) -> list:
        return rows.mapInArrow(pick, "lang string, draw long, at long, bytes binary").orderBy("draw", "at", "lang", "bytes").limit(sample * stretches).collect()

    small_batches(docs.sparkSession)
    # few hashes fall below the share only if one document fills the table; then any of its rows will do
    got = drawn(known.where(F.pmod("draw", F.lit(1 << 20)) < F.lit(int(part * (1 << 20)) + 1))) or drawn(known)
    languages = sorted({r["lang"] for r in got})
    number = {lang: k for k, lang in enumerate(languages)}
    x = np.full((len(got), stretch), PAD, dtype=np.int16)
    for k, r in enumerate(got):
        x[k, : len(r["bytes"])] = np.frombuffer(r["bytes"], dtype=np.uint8)
    return x, np.array([number[r["lang"]] for r in got], dtype=np.int64), languages


def windows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For up to SIDE windows at a time: bytes (time by row, PAD outside the text), the number of each one's text, and where
    its own positions begin in that."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    count = -(-size // OWN)
    of = np.repeat(np.arange(len(texts)), count)
    start = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * OWN
    span = np.arange(-CONTEXT, OWN + CONTEXT)[:, None]
    for k in range(0, len(of), SIDE):
        text, at = of[k : k + SIDE], start[k : k + SIDE]
        place = span + at
        inside = (place >= 0) & (place < size[text])
        x = data[np.where(inside, place + first[text], 0)].astype(np.intp)
        x[~inside] = PAD
        yield x, text, at


def probabilities(net: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Mean probabilities of the languages over the letters' positions of each text, and the number of those."""
    k = len(net.languages)
    total, letters = np.zeros((len(texts), k)), np.zeros(len(texts), dtype=np.int64)
    ones = np.ones(k, dtype=np.float32)
    for x, text, _ in windows(texts):
        e = np.exp(logits(net.params, x))[CONTEXT:-CONTEXT]
        own = _OF_LETTER[x[CONTEXT:-CONTEXT]]
        e *= (own / (e @ ones))[..., None]
        np.add.at(total, text, e.sum(axis=0))
        np.add.at(letters, text, own.sum(axis=0))
    return total / np.maximum(letters, 1)[:, None], letters


def label_positions(net: Network, text: str) -> np.ndarray:
    """The number of the likeliest language at each byte of a text."""
    data = text.encode("utf-8", "surrogatepass")
    out = np.empty(len(data), dtype=np.int64)
    for x, _, at in windows([data]):
        best = logits(net.params, x)[CONTEXT:-CONTEXT].argmax(axis=2)
        for j, a in enumerate(at.tolist()):
            out[a : a + OWN] = best[: len(data) - a, j]
    return out


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_positions", pa.int64())])


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and n_positions, the letters' positions that were pooled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = bytes_of(batch.column("text"))
            told = np.array([bool(net.languages) and _LETTER.search(t.decode()) is not None for t in texts], dtype=bool)
            prob, letters = probabilities(net, [t if k else b"" for t, k in zip(texts, told, strict=True)]) if told.any() else (np.zeros((len(texts), 1)), np.zeros(len(texts), dtype=np.int64))
            best = prob.argmax(axis=1)
            names = [net.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), told, strict=True)]
            score = np.where(told, np.minimum(prob.max(axis=1), 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, type=pa.string()), pa.array(score), pa.array(letters)], schema=_PREDICTED)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_positions long")


def fit(docs: DataFrame) -> Network:
    x, y, languages = labelled_stretches(docs)
    return train(x, y, languages) if len(languages) > 1 else begun(languages)


def op11_recurrent_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs))
