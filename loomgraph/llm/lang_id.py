"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows; the largest answer of each filter in a window
goes to a softmax over the languages.  The network is trained in numpy on windows of a bounded sample of labelled rows
and then applied to every window of every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.common import prepared

WINDOW = 256
WIDTHS = (2, 3, 4)
#: A window begins so many bytes after the one before it: they overlap, so that no filter misses a place at a border.
STRIDE = WINDOW - max(WIDTHS) + 1
FILTERS = 8
UNDETERMINED = "und"


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, zero-filled at the end: bytes, index of the text, number of bytes that are its first windows'."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // STRIDE)
    owner = np.repeat(np.arange(len(texts)), counts)
    within = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE
    flat = np.frombuffer(b"".join(t + bytes(WINDOW) for t in texts), np.uint8)
    begin = np.cumsum(sizes + WINDOW) - sizes - WINDOW
    out = np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[begin[owner] + within] if len(owner) else np.zeros((0, WINDOW), np.uint8)
    # what follows a text within its last window is its own zeros
    return out, owner, np.minimum(sizes[owner] - within, STRIDE)


@dataclass
class ByteNet:
    """Filters by width as tables [place in the filter, byte, filter], biases, and the softmax layer."""

    languages: list[str]
    filters: list[np.ndarray] = field(default_factory=list)
    bias: np.ndarray | None = None
    weight: np.ndarray | None = None
    offset: np.ndarray | None = None

    @classmethod
    def start(cls, languages: list[str], seed: int) -> ByteNet:
        draw = np.random.default_rng(seed)
        return cls(
            languages,
            [draw.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
            np.zeros(len(WIDTHS) * FILTERS, np.float32),
            draw.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32),
            np.zeros(len(languages), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [*self.filters, self.bias, self.weight, self.offset]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Filter sums by pairs of bytes: of the first two places of every width, and of the places after them."""
        head = np.concatenate([f[0][:, None, :] + f[1][None, :, :] for f in self.filters], axis=2)
        tail = [np.broadcast_to(f[2][:, None, :], (256, 256, FILTERS)) if len(f) == 3 else f[2][:, None, :] + f[3][None, :, :] for f in self.filters[1:]]
        return head.reshape(65536, -1), np.ascontiguousarray(np.concatenate(tail, axis=2)).reshape(65536, -1)

    def pooled(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The filters' answers at every place where the widest one fits: [window, place, filter]."""
        pair = x[:, :-1].astype(np.uint16) << 8 | x[:, 1:]
        places = WINDOW - max(WIDTHS) + 1
        answer = tables[0].take(pair[:, :places], axis=0)
        answer[:, :, FILTERS:] += tables[1].take(pair[:, 2 : places + 2], axis=0)
        return answer

    def probabilities(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        tables, out = tables or self.tables(), []
        for k in range(0, len(x), 128):
            z = np.maximum(self.pooled(x[k : k + 128], tables).max(axis=1) + self.bias, 0) @ self.weight + self.offset
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        answer = self.pooled(x, self.tables())
        best = answer.argmax(axis=1)
        top = np.take_along_axis(answer, best[:, None, :], axis=1)[:, 0] + self.bias
        feature = np.maximum(top, 0)
        z = feature @ self.weight + self.offset
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = (p @ self.weight.T) * (top > 0)
        out = []
        for k, f in enumerate(self.filters):
            own, grad = slice(k * FILTERS, (k + 1) * FILTERS), np.zeros_like(f)
            for place in range(len(f)):
                np.add.at(grad[place], (np.take_along_axis(x, best[:, own] + place, axis=1), np.arange(FILTERS)), back[:, own])
            out.append(grad)
        return [*out, back.sum(axis=0), feature.T @ p, p.sum(axis=0)]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int, rate: float = 0.01, batch: int = 64) -> ByteNet:
        """Adam over shuffled batches; the step shrinks to nothing over the epochs."""
        draw, parameters = np.random.default_rng(seed), self.parameters()
        mean, square, step = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0
        steps = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = draw.permutation(len(x))
            for k in range(0, len(x), batch):
                step += 1
                now = rate * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, m, s, g in zip(parameters, mean, square, self.gradients(x[order[k : k + batch]], y[order[k : k + batch]]), strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= now * m / (np.sqrt(s) + 1e-8)
        return self


def fold(doc_id: Column | str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def train(documents: DataFrame, sample_rows: int = 4000, windows_a_row: int = 2, epochs: int = 6, seed: int = 7) -> ByteNet | None:
    """A network from rows with text and language whose fold isn't 0; None if there are none.

    The languages share ``sample_rows`` evenly; a language's rows are drawn by a hash of ``doc_id`` and text, at the
    rate that gives its share, so the sample doesn't depend on the partitions.  Of each drawn text ``windows_a_row``
    windows at places drawn by the same hash are sent to the driver: some 2 MB in all.  Of a language no more than
    twice its share is sent, those of the smallest hashes, however often a row is repeated.
    """
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (fold() != 0))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample_rows).collect()}
    if not counts:
        return None
    languages, share = sorted(counts), max(1, sample_rows // len(counts))
    rate = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, share / counts[k]))))
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, tags, hashes = [], [], []
            for text, lang, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content = text.encode()
                n = -(-len(content) // STRIDE)
                for k in sorted({(h + j * (n // windows_a_row + 1)) % n for j in range(windows_a_row)}):
                    got.append(content[k * STRIDE : k * STRIDE + WINDOW])
                    tags.append(lang)
                    hashes.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), pa.array(tags, pa.string()), pa.array(hashes, pa.int64())], names=["window", "lang", "h"])

    chosen = rows.where(drawn < rate[F.col("lang")] * (1 << 30)).select("text", "lang", drawn.alias("h"))
    # counted: each task keeps no more of a language before the shuffle
    counted = F.row_number().over(Window.partitionBy("lang").orderBy("h", "window"))
    bounded = chosen.mapInArrow(sample, "window binary, lang string, h long").withColumn("k", counted).where(F.col("k") <= 2 * share * windows_a_row)
    table = bounded.select("window", "lang").toArrow().sort_by([("lang", "ascending"), ("window", "ascending")])
    if not len(table):
        return None
    x = np.stack([np.frombuffer(w.ljust(WINDOW, b"\0"), np.uint8) for w in table.column("window").to_pylist()])
    y = np.searchsorted(languages, table.column("lang").to_pylist())
    return ByteNet.start(languages, seed).fit(x, y, epochs, seed)


def predict(documents: DataFrame, net: ByteNet | None, *keep: str) -> DataFrame:
    """``doc_id, lang_pred, score`` and the columns ``keep`` for each row; a text's answer is the mean over its windows' bytes.

    ``und`` with score 0 where the text is null or has no letter, or where nothing could be learned.  Repeated rows are
    judged each for itself; an empty table gives an empty result; ``keep`` can't name ``lang_pred`` or ``score``.
    """
    spark = prepared(documents.sparkSession)
    shared = spark.sparkContext.broadcast(net)
    rows = documents.select(F.col("text").cast("string").alias("__text"), *(F.col(c) for c in ("doc_id", *keep)))
    names = ["doc_id", *keep, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables() if net else None
        for batch in batches:
            texts = [t if net and t and any(map(str.isalpha, t)) else "" for t in batch.column(0).to_pylist()]
            best, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            if any(texts):
                x, owner, own = windows([t.encode() for t in texts])
                total = np.zeros((len(texts), len(net.languages)))
                np.add.at(total, owner, net.probabilities(x, tables) * own[:, None])
                size = np.bincount(owner, own, len(texts))
                for k in np.flatnonzero(size):
                    j = int(total[k].argmax())
                    best[k], score[k] = net.languages[j], min(1.0, float(total[k, j] / size[k]))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(best, pa.string()), pa.array(score, pa.float64())], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def identify(documents: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every whole text, by a network that never saw a held-out row.

    Repeated rows are judged each for itself; a null ``doc_id`` has a null fold, so it is neither held out nor learned
    from; other columns are ignored; an empty table gives an empty result.
    """
    said = predict(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(documents))
    return said.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
