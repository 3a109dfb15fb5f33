"""Toxicity: a bidirectional gated recurrent network with attention over windows of words.

A word comes in twice: as a vector of the word (by its hash) and as the mean of vectors of its
character 3- to 5-grams (by their hashes), so that words never seen still say something by
their characters.  A forward and a backward gated unit read a window; attention pools their
states; a logistic unit gives the window's score.  A document's score is the highest of all its
windows, which overlap by a quarter and cover the whole text, whatever its length.

Training is in numpy, with the gradients written out, on at most ``SAMPLE`` labelled documents:
half with and half without the label (as far as there are any), those of the smallest hashes of
their ids.  Labels belong to documents, so each pass trains the windows that score highest now;
the first pass trains some windows of every document.  The fitted numbers (under 3 MB) are
broadcast; scoring reads every text once, and what a word adds to the gates is kept per word.

Defined cases: null and blank texts are one window without words; repeated rows are scored
each; without labels of both kinds every score is 0.5 less a bit; rows of labels with a null id
or label are not used; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common
from gridloom.llm.words import bytes_of, ends_of, hash_words, mixed

#: Most labelled documents that are learned from.
SAMPLE = 4000
#: Longest text, in characters, that is learned from; scoring has no such bound.
SAMPLE_CHARS = 10_000
WINDOW, STRIDE = 32, 24
WORD_SLOTS, CHAR_SLOTS = 1 << 13, 1 << 14
WORD_SIZE, CHAR_SIZE, STATE = 8, 8, 8
GRAMS = (3, 4, 5)
#: Windows of a step and at least so many steps; passes over the sample.
BATCH, STEPS, PASSES, RATE, SEED = 128, 300, 4, 0.01, 3
#: Words whose share of the gates a worker keeps; windows, texts and new words it works on at a time.
KEPT_WORDS, WINDOWS, TEXTS, NEW_WORDS = 150_000, 1024, 400, 10_000

_letter = np.random.default_rng(17).integers(1, 1 << 63, (max(GRAMS), 256), dtype=np.uint64)
_power = np.cumprod(np.full(1 << 12, 0xD1342543DE82EF95, dtype=np.uint64))
_trimmed = np.zeros(256, dtype=bool)
_trimmed[list(b".,;:!?\"'()[]")] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


class Parts:
    """Slots of words: one of each word, and those of its character n-grams, bounds marked."""

    def __init__(self, raw: np.ndarray, first: np.ndarray, last: np.ndarray):
        """Words are the bytes first..last (not included); marks around them are left out."""
        first, last = first.copy(), last.copy()
        for _ in range(4):
            last -= (last > first) & _trimmed[raw[np.maximum(last - 1, 0)]]
            first += (last > first) & _trimmed[raw[np.minimum(first, len(raw) - 1)]]
        size = last - first
        # "<" word ">" one after another.
        ends = np.cumsum(size + 2)
        begins = ends - size - 2
        text = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
        inside = np.ones(len(text), dtype=bool)
        inside[begins], inside[ends - 1] = False, False
        text[begins], text[ends - 1] = 60, 62
        at = np.arange(len(text)) - np.repeat(begins, size + 2)
        text[inside] = _lower[raw[(np.repeat(first, size + 2) + at - 1)[inside]]]
        whole = np.zeros(0, dtype=np.uint64)
        if len(begins):
            whole = np.add.reduceat(_letter[0][text] * _power[at & 0xFFF], begins)
        self.word = (mixed(whole) >> np.uint64(40)).astype(np.int64) % WORD_SLOTS
        grams, owners = [], []
        owner, left = np.repeat(np.arange(len(size)), size + 2), np.repeat(size + 2, size + 2) - at
        for n in GRAMS:
            own = np.flatnonzero(left >= n)
            h = np.zeros(len(own), dtype=np.uint64)
            for k in range(n):
                h += _letter[k][text[own + k]]
            grams.append((mixed(h) >> np.uint64(40)).astype(np.int64) % CHAR_SLOTS)
            owners.append(owner[own])
        # A word of nothing but marks has one n-gram, slot 0.
        bare = np.flatnonzero(size == 0)
        owners.append(bare)
        grams.append(np.zeros(len(bare), dtype=np.int64))
        order = np.argsort(np.concatenate(owners), kind="stable")
        self.gram, self.owner = np.concatenate(grams)[order], np.concatenate(owners)[order]
        self.count = np.bincount(self.owner, minlength=len(size))
        self.begin = np.cumsum(self.count) - self.count

    def __len__(self) -> int:
        return len(self.word)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters and the passes forward and back."""

    def __init__(self, seed: int = SEED):
        draw = np.random.default_rng(seed)
        put = WORD_SIZE + CHAR_SIZE

        def normal(*shape, scale):
            return (draw.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"word": normal(WORD_SLOTS, WORD_SIZE, scale=0.1), "char": normal(CHAR_SLOTS, CHAR_SIZE, scale=0.1)}
        for side in "fb":
            # Gates: reset, update, candidate.
            self.p[f"w{side}"] = normal(put, 3 * STATE, scale=put**-0.5)
            self.p[f"u{side}"] = normal(STATE, 3 * STATE, scale=STATE**-0.5)
            self.p[f"c{side}"] = np.zeros(3 * STATE, dtype=np.float32)
        self.p["att"] = normal(2 * STATE, scale=0.1)
        self.p["out"] = normal(2 * STATE, scale=0.3)
        self.p["bias"] = np.zeros(1, dtype=np.float32)
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.steps = 0

    @classmethod
    def of(cls, parameters: dict[str, np.ndarray]) -> Network:
        net = cls.__new__(cls)
        net.p = parameters
        return net

    def inputs(self, parts: Parts) -> np.ndarray:
        words = self.p["word"][parts.word]
        chars = np.add.reduceat(self.p["char"][parts.gram], parts.begin) / parts.count[:, None]
        return np.concatenate([words, chars], axis=1).astype(np.float32)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What a word adds to the gates of both directions: kept per word when scoring."""
        return np.concatenate([x @ self.p["wf"] + self.p["cf"], x @ self.p["wb"] + self.p["cb"]], axis=1)

    def run(self, g: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Scores (log odds) of windows: g is (time, window, gates), mask (time, window) or None."""
        steps, size = g.shape[:2]
        states = np.empty((steps, size, 2 * STATE), dtype=np.float32)
        kept: dict[str, list] = {"f": [], "b": []}
        for side, base, order in (("f", 0, range(steps)), ("b", 3 * STATE, range(steps - 1, -1, -1))):
            u = self.p[f"u{side}"]
            u_rz, u_n = np.ascontiguousarray(u[:, : 2 * STATE]), np.ascontiguousarray(u[:, 2 * STATE :])
            h = np.zeros((size, STATE), dtype=np.float32)
            at = slice(0, STATE) if side == "f" else slice(STATE, 2 * STATE)
            for t in order:
                rz = h @ u_rz
                rz += g[t, :, base : base + 2 * STATE]
                np.negative(rz, out=rz)
                np.exp(rz, out=rz)
                rz += 1
                np.reciprocal(rz, out=rz)
                r, z = rz[:, :STATE], rz[:, STATE:]
                rh = r * h
                n = rh @ u_n
                n += g[t, :, base + 2 * STATE : base + 3 * STATE]
                np.tanh(n, out=n)
                new = n - h
                new *= z if mask is None else z * mask[t][:, None]
                new += h
                if keep:
                    kept[side].append((t, h, r, z, n, rh))
                h = new
                states[t, :, at] = h
        e = np.exp(np.minimum(states @ self.p["att"], 20))
        if mask is not None:
            e *= mask
        weight = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbs->bs", weight, states)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, states, weight, pooled, kept) if keep else logit

    def learn(self, slots: np.ndarray, parts: Parts, mask: np.ndarray, label: np.ndarray, weights: np.ndarray, rate: float) -> None:
        """One step on windows: slots (time, window) are places in ``parts``; weights are by label."""
        x = self.inputs(parts)
        g = self.gates(x)[slots]
        logit, states, weight, pooled, kept = self.run(g, mask, keep=True)
        grad = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "char")}
        d_logit = ((_sigmoid(logit) - label) * weights[label.astype(int)] / len(label)).astype(np.float32)
        grad["out"] = pooled.T @ d_logit
        grad["bias"] = d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * self.p["out"]
        d_weight = np.einsum("bs,tbs->tb", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_states = weight[:, :, None] * d_pooled + d_score[:, :, None] * self.p["att"]
        grad["att"] = np.einsum("tb,tbs->s", d_score, states)
        d_g = np.zeros_like(g)
        for side, base in (("f", 0), ("b", 3 * STATE)):
            u = self.p[f"u{side}"]
            at = slice(0, STATE) if side == "f" else slice(STATE, 2 * STATE)
            d_h = np.zeros((g.shape[1], STATE), dtype=np.float32)
            for t, h, r, z, n, rh in reversed(kept[side]):
                d_new = d_h + d_states[t, :, at]
                m = mask[t][:, None]
                d_n = d_new * z * m * (1 - n * n)
                d_z = d_new * (n - h) * m * z * (1 - z)
                d_rh = d_n @ u[:, 2 * STATE :].T
                d_r = d_rh * h * r * (1 - r)
                d_rz = np.concatenate([d_r, d_z], axis=1)
                d_h = d_new * (1 - z * m) + d_rh * r + d_rz @ u[:, : 2 * STATE].T
                grad[f"u{side}"][:, : 2 * STATE] += h.T @ d_rz
                grad[f"u{side}"][:, 2 * STATE :] += rh.T @ d_n
                d_g[t, :, base : base + 3 * STATE] = np.concatenate([d_rz, d_n], axis=1)
        flat = np.zeros((len(parts), 6 * STATE), dtype=np.float32)
        np.add.at(flat, slots.ravel(), d_g.reshape(-1, 6 * STATE))
        d_x = flat[:, : 3 * STATE] @ self.p["wf"].T + flat[:, 3 * STATE :] @ self.p["wb"].T
        grad["wf"], grad["cf"] = x.T @ flat[:, : 3 * STATE], flat[:, : 3 * STATE].sum(axis=0)
        grad["wb"], grad["cb"] = x.T @ flat[:, 3 * STATE :], flat[:, 3 * STATE :].sum(axis=0)
        self.steps += 1
        for k, d in grad.items():
            self._step(k, slice(None), d, rate)
        self._sparse("word", parts.word, d_x[:, :WORD_SIZE], rate)
        share = (1 / parts.count[parts.owner]).astype(np.float32)[:, None]
        self._sparse("char", parts.gram, d_x[parts.owner, WORD_SIZE:] * share, rate)

    def _sparse(self, name: str, rows: np.ndarray, d: np.ndarray, rate: float) -> None:
        own, at = np.unique(rows, return_inverse=True)
        total = np.zeros((len(own), d.shape[1]), dtype=np.float32)
        np.add.at(total, at, d)
        self._step(name, own, total, rate)

    def _step(self, name: str, rows, d: np.ndarray, rate: float) -> None:
        """Adam."""
        first, second = self.moments[name]
        first[rows] = 0.9 * first[rows] + 0.1 * d
        second[rows] = 0.99 * second[rows] + 0.01 * d * d
        a, b = first[rows] / (1 - 0.9**self.steps), second[rows] / (1 - 0.99**self.steps)
        self.p[name][rows] -= rate * a / (np.sqrt(b) + 1e-6)


def windows_of(length: int) -> np.ndarray:
    """Starts of the windows of a text: overlapping, the last one ends with the text."""
    if length <= WINDOW:
        return np.zeros(1, dtype=np.int64)
    return np.append(np.arange(0, length - WINDOW, STRIDE), length - WINDOW)


class Scorer:
    """Scores texts with a fitted network; what words add to the gates is kept per word."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.net = Network.of(parameters)
        self.known = np.zeros(0, dtype=np.uint64)
        self.row = np.zeros(0, dtype=np.int64)
        self.table = np.zeros((0, 6 * STATE), dtype=np.float32)

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the table for the words of all texts in turn, and the words of each text."""
        raw, offsets = bytes_of(column)
        hashes, counts, first = hash_words(column)
        word, place, at = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > KEPT_WORDS:
            self.known, self.row, self.table = self.known[:0], self.row[:0], self.table[:0]
        new = np.ones(len(word), dtype=bool)
        if len(self.known):
            found = np.searchsorted(self.known, word)
            found[found == len(self.known)] = 0
            new = self.known[found] != word
        if new.any():
            begin = first[place[new]]
            end = ends_of(raw, begin, offsets)
            cuts = [slice(k, k + NEW_WORDS) for k in range(0, len(begin), NEW_WORDS)]
            gates = [self.net.gates(self.net.inputs(Parts(raw, begin[c], end[c]))) for c in cuts]
            fresh = len(self.table) + np.arange(len(begin))
            self.table = np.concatenate([self.table, *gates])
            both = np.concatenate([self.known, word[new]])
            order = np.argsort(both, kind="stable")
            self.known, self.row = both[order], np.concatenate([self.row, fresh])[order]
        return self.row[np.searchsorted(self.known, word)][at], counts

    def windows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds of all windows, the text of each, and the word it starts at."""
        rows, counts = self.rows(column)
        begins = np.cumsum(counts) - counts
        starts = [windows_of(n) for n in counts.tolist()]
        owner = np.repeat(np.arange(len(counts)), [len(s) for s in starts])
        start = np.concatenate([np.zeros(0, dtype=np.int64), *starts])
        logit = np.zeros(len(start), dtype=np.float32)
        step = np.arange(WINDOW)[:, None]
        whole = counts[owner] >= WINDOW
        full, short = np.flatnonzero(whole), np.flatnonzero(~whole)
        for k in range(0, len(full), WINDOWS):
            own = full[k : k + WINDOWS]
            logit[own] = self.net.run(self.table[rows[begins[owner[own]] + start[own] + step]], None)
        for k in range(0, len(short), WINDOWS):
            # Short texts have one window each; without words the mask leaves nothing.
            own = short[k : k + WINDOWS]
            mask = (step < counts[owner[own]]).astype(np.float32)
            gates = np.zeros((WINDOW, len(own), 6 * STATE), dtype=np.float32)
            if len(rows):
                gates = self.table[rows[np.minimum(begins[owner[own]] + step, len(rows) - 1)]]
            logit[own] = self.net.run(gates, mask)
        return logit, owner, start

    def scores(self, column: pa.Array) -> np.ndarray:
        """Highest log odds of the windows of each text."""
        best = np.full(len(column), -np.inf, dtype=np.float32)
        for begin in range(0, len(column), TEXTS):
            logit, owner, _ = self.windows(column.slice(begin, TEXTS))
            np.maximum.at(best, begin + owner, logit)
        return best


def fit(texts: list[bytes | None], labels: np.ndarray, passes: int = PASSES, seed: int = SEED) -> Network:
    """Train on documents: the windows that score highest stand for their documents."""
    net, draw = Network(seed), np.random.default_rng(seed)
    if not len(texts) or labels.min() == labels.max() or not any(t and t.strip() for t in texts):
        net.p["out"] *= 0
        net.p["bias"] -= 0.01
        return net
    column = pa.array(texts, pa.binary())
    raw, offsets = bytes_of(column)
    hashes, counts, first = hash_words(column)
    begins, last = np.cumsum(counts) - counts, ends_of(raw, first, offsets)
    passes = max(passes, -(-STEPS * BATCH // (2 * len(texts))))
    step = np.arange(WINDOW)[:, None]
    for turn in range(passes):
        if turn == 0:
            # No opinion yet: some windows of every document.
            every = [windows_of(n) for n in counts.tolist()]
            chosen = [
                (k, int(s)) for k, own in enumerate(every)
                for s in (own if len(own) <= 4 else draw.choice(own, 4, replace=False))
            ]
        else:
            logit, owner, start = Scorer(net.p).windows(column)
            order = np.lexsort((start, -logit, owner))
            rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
            top = order[rank < np.where(labels[owner[order]] == 0, 2, 1)]
            chosen = list(zip(owner[top].tolist(), start[top].tolist(), strict=True))
        chosen = np.array(chosen)[draw.permutation(len(chosen))]
        rate = RATE * (1 if turn < passes - 1 else 0.3)
        # Both labels weigh alike, however many windows they have.
        weights = 0.5 * len(chosen) / np.maximum(np.bincount(labels[chosen[:, 0]], minlength=2), 1)
        for begin in range(0, len(chosen), BATCH):
            doc, start = chosen[begin : begin + BATCH].T
            mask = step + start < counts[doc]
            at = np.minimum(begins[doc] + start + step, len(hashes) - 1)
            _, place, slots = np.unique(hashes[at], return_index=True, return_inverse=True)
            own = at.ravel()[place]
            parts = Parts(raw, first[own], last[own])
            net.learn(slots.reshape(at.shape), parts, mask.astype(np.float32), labels[doc].astype(np.float32), weights, rate)
    return net


def training_sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, folds: int, sample: int
) -> tuple[list[bytes | None], np.ndarray]:
    """At most ``sample`` labelled documents outside the held-out fold, half of each label."""
    fold = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .groupBy(F.col("doc_id").alias("_label_id"))
        .agg(F.max("toxic").alias("_toxic"))
    )
    short = docs.where((fold != 0) & (F.coalesce(F.length(text_col), F.lit(0)) < SAMPLE_CHARS))
    # The ids first, so that the only texts that move are those of the sample.
    rows = (
        short.select(F.col(id_col).alias("_id"))
        .join(known, F.col("_id") == F.col("_label_id"))
        .select("_id", "_toxic", F.xxhash64("_id", F.lit(SEED)).alias("_order"))
    )
    ids = None
    for value in (0, 1):
        some = rows.where(F.col("_toxic") == value).orderBy("_order", "_id").limit(sample // 2)
        ids = some if ids is None else ids.unionByName(some)
    picked = sorted({(r["_id"], r["_toxic"], r["_order"]) for r in ids.collect()})
    if not picked:
        return [], np.zeros(0)
    wanted = docs.sparkSession.createDataFrame(picked, "_id bigint, _toxic int, _order bigint")
    texts = short.select(F.col(id_col).alias("_want"), F.col(text_col).cast("binary").alias("_text"))
    found = texts.join(F.broadcast(wanted), F.col("_want") == F.col("_id")).limit(2 * sample).collect()
    found.sort(key=lambda r: (r["_order"], r["_id"], bytes(r["_text"] or b"")))
    found = found[:sample]
    texts = [None if r["_text"] is None else bytes(r["_text"]) for r in found]
    return texts, np.array([r["_toxic"] for r in found])


def train(
    docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", folds: int = 5, sample: int = SAMPLE
) -> Network:
    return fit(*training_sample(docs, labels, id_col, text_col, folds, sample))


def score(docs: DataFrame, network: Network, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of toxicity of each whole text; a column called as the result
    is replaced."""
    spark = docs.sparkSession
    if out.lower() != text_col.lower():
        docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()])
    common.ship(spark)
    shared = spark.sparkContext.broadcast(network.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            found = _sigmoid(scorer.scores(texts).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, out])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kind}, `{out}` double")


def keep_clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """Documents, with their columns, whose score is below the limit."""
    mark = common.own(docs, "toxicity")
    return score(docs, train(docs, labels), out=mark).where(F.col(mark) < limit).drop(mark)
