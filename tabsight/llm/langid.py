"""Language identification by a byte convolutional network in numpy.

Bytes are embedded, filters of several widths slide over a window of fixed
length, each filter's largest response (max pooling over the window, after a
ReLU) goes into a softmax layer. A text of any length is a row of windows; its
prediction is the mean of their probabilities, weighted by the bytes they hold.

The filters of one width w over embedded bytes are w tables of 256 rows, so
applying them is looking up and adding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, prepare

WIDTHS, FILTERS, EMBED, WINDOW = (2, 3, 4), 16, 8, 256


@dataclass
class Model:
    """embed (256, e); one (width, e, filters) array for each width; softmax layer."""
    labels: list[str]
    embed: object
    filters: list
    bias: list
    out: object
    out_bias: object

    def tables(self):
        """For each width: (width, 256, filters), what a byte at a place adds."""
        import numpy as np
        return [np.einsum("be,wef->wbf", self.embed, f).astype(np.float32) for f in self.filters]


def windows(raw: bytes, window: int = WINDOW):
    """(n, window) bytes of a whole text, the last row filled up with zeros, and how
    many bytes each row holds."""
    import numpy as np
    n = max(1, -(-len(raw) // window))
    out = np.zeros(n * window, dtype=np.uint8)
    out[:len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    held = np.full(n, window)
    held[-1] = len(raw) - (n - 1) * window
    return out.reshape(n, window), held


def features(model: Model, x, tables=None, places: bool = False):
    """Pooled responses (n, filters of all widths) of windows ``x`` and, for
    training, where each maximum lies."""
    import numpy as np
    got, where = [], []
    for table, bias in zip(tables or model.tables(), model.bias, strict=True):
        w, n = table.shape[0], x.shape[1] - table.shape[0] + 1
        r = np.take(table[0], x[:, :n], axis=0)
        for k in range(1, w):
            r += np.take(table[k], x[:, k:k + n], axis=0)
        if places:
            where.append(r.argmax(axis=1))
        got.append(r.max(axis=1) + bias)
    return np.concatenate(got, axis=1), where


def softmax(z):
    import numpy as np
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(samples: list[tuple[bytes, str]], epochs: int = 30, batch: int = 128, rate: float = 0.003, seed: int = 5) -> Model:
    """Fit a model to (bytes of one window, label) by Adam on the cross-entropy.
    Max pooling passes a gradient to one place of a window for each filter."""
    import numpy as np
    rng = np.random.default_rng(seed)
    labels = sorted({y for _, y in samples})
    x = np.concatenate([windows(raw[:WINDOW])[0] for raw, _ in samples]) if samples else np.zeros((0, WINDOW), np.uint8)
    y = np.array([labels.index(v) for _, v in samples], dtype=int)
    total = FILTERS * len(WIDTHS)
    m = Model(labels, rng.normal(0, 0.5, (256, EMBED)), [rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)) for w in WIDTHS],
              [np.zeros(FILTERS) for _ in WIDTHS], rng.normal(0, total ** -0.5, (total, max(1, len(labels)))), np.zeros(max(1, len(labels))))
    params = [m.embed, *m.filters, *m.bias, m.out, m.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs if len(labels) > 1 else 0):
        order = rng.permutation(len(x))
        for s in range(0, len(x), batch):
            i = order[s:s + batch]
            xb, n = x[i], len(i)
            pooled, where = features(m, xb, places=True)
            hidden = np.maximum(pooled, 0)
            g = softmax(hidden @ m.out + m.out_bias)
            g[np.arange(n), y[i]] -= 1
            g /= n
            d_hidden = (g @ m.out.T) * (pooled > 0)
            d_embed = np.zeros_like(m.embed)
            d_filters, d_bias = [], []
            for k, w in enumerate(WIDTHS):
                d = d_hidden[:, k * FILTERS:(k + 1) * FILTERS]
                df = np.zeros_like(m.filters[k])
                for j in range(w):
                    seen = xb[np.arange(n)[:, None], where[k] + j]  # (n, filters) bytes under the maximum
                    df[j] = np.einsum("nfe,nf->ef", m.embed[seen], d)
                    np.add.at(d_embed, seen, d[:, :, None] * m.filters[k][j].T[None])
                d_filters.append(df)
                d_bias.append(d.sum(axis=0))
            grads = [d_embed, *d_filters, *d_bias, hidden.T @ g, g.sum(axis=0)]
            step += 1
            for p, q, a, b in zip(params, grads, first, second, strict=True):
                a *= 0.9
                a += 0.1 * q
                b *= 0.999
                b += 0.001 * q * q
                p -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return m


def probabilities(model: Model, tables, raws: list[bytes], at_once: int = 512):
    """(texts, labels) mean probabilities over the windows of each whole text."""
    import numpy as np
    out = np.zeros((len(raws), len(model.labels)))
    weight = np.zeros(len(raws))
    bias, bias_out = model.out.astype(np.float32), model.out_bias.astype(np.float32)
    rows, held, owner, have = [], [], [], 0

    def flush() -> None:
        nonlocal rows, held, owner, have
        if have:
            x, h, o = np.concatenate(rows), np.concatenate(held), np.concatenate(owner)
            for s in range(0, len(x), at_once):
                pooled, _ = features(model, x[s:s + at_once], tables)
                p = softmax(np.maximum(pooled, 0) @ bias + bias_out) * h[s:s + at_once, None]
                np.add.at(out, o[s:s + at_once], p)
                np.add.at(weight, o[s:s + at_once], h[s:s + at_once])
        rows, held, owner, have = [], [], [], 0

    for i, raw in enumerate(raws):
        x, h = windows(raw)
        rows.append(x)
        held.append(h)
        owner.append(np.full(len(x), i))
        have += len(x)
        if have >= 8 * at_once:
            flush()
    flush()
    return out / np.maximum(weight, 1)[:, None]


def training_sample(df: DataFrame, per_label: int = 1500, seed: str = "langid") -> list[tuple[bytes, str]]:
    """About ``per_label`` windows for each label of ``df`` (text, lang), in an order
    that depends on content only: a hash picks rows at the rate that the label's
    count asks for, and a window inside each. At most 2 * per_label of each label."""
    rows = df.select("lang", "text").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row for each label
    if not counts:
        return []
    rate = F.lit(0.0)
    for label, n in counts.items():
        rate = F.when(F.col("lang") == label, min(1.0, per_label / n)).otherwise(rate)
    unit = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 30)) / float(1 << 30)
    start = F.pmod(F.xxhash64(F.lit(seed + " start"), "text"), F.greatest(F.lit(1), F.length("text") - WINDOW // 2))
    picked = rows.filter(unit < rate).select("lang", F.substring("text", (start + 1).cast("int"), F.lit(WINDOW)).alias("text")) \
        .groupBy("lang", "text").agg(F.count(F.lit(1)).alias("n")).drop("n")  # copies of a text count once
    out: dict[str, list[str]] = {}
    for lang, text in sorted(map(tuple, picked.collect())):  # bounded by the rates: copies come or go together
        out.setdefault(lang, []).append(text)
    return [(t.encode("utf-8", "replace"), lang) for lang, ts in out.items() for t in ts[:2 * per_label]]


def predict(df: DataFrame, model: Model) -> DataFrame:
    """The columns of ``df`` but text, with lang_pred and score.

    The prediction covers the whole text. A null text and one without a letter are
    ``und`` with score 0, as is every text if the model knows no label. Repeated
    rows are predicted alike; null ids pass through; an empty table gives an empty
    result."""
    spark = prepare(df)
    given = spark.sparkContext.broadcast(model)  # a few hundred kilobytes
    carry = [c for c in df.columns if c not in ("text", "lang_pred", "score")]
    rows = df.select(*[F.col(f"`{c}`") for c in carry], F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("__text"))

    def run(batches):
        import numpy as np
        m = given.value
        tables = m.tables()
        for b in batches:
            texts = b.column("__text").to_pylist()
            some = [i for i, t in enumerate(texts) if t is not None and m.labels]
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            if some:
                p = probabilities(m, tables, [texts[i].encode("utf-8", "replace") for i in some])
                for i, row in zip(some, p, strict=True):
                    best = int(row.argmax())
                    pred[i], score[i] = m.labels[best], round(min(1.0, float(row[best])), 6)  # batches differ in the last digits
            yield b, None, {"lang_pred": pred, "score": score}

    return map_arrow(rows, carry, {"lang_pred": T.StringType(), "score": T.DoubleType()}, run)


def identify(df: DataFrame, train_on: DataFrame | None = None, **options) -> DataFrame:
    """Train on ``train_on`` (default: the rows of ``df`` with a label) and predict ``df``."""
    model = train(training_sample(df if train_on is None else train_on, **options))
    return predict(df, model)
