"""Toxicity by a bidirectional gated recurrent network with attention pooling over characters and words.

A word's vector joins a learned embedding (words frequent in the training sample) with the last states of a bidirectional
GRU over its characters. A second bidirectional GRU runs over the words of a window, attention pools its states,
and a logistic unit scores the window. Every text is covered whole by overlapping windows, and its score is that of
its worst window. Trained in numpy by back-propagation through both networks, on windows: labels belong to
documents, so that a toxic document teaches through the windows that look most toxic, and a clean one through its
windows that look most toxic as well; looks come first from character n-gram statistics, then from the network itself.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import give_back

#: Words of a window and between the starts of two; characters of a word that are read together (longer words are cut into such pieces).
WINDOW, STRIDE, PIECE = 24, 12, 24
#: Labelled documents to train on: at most this many of each label. Words with an embedding of their own.
SAMPLE, VOCABULARY = 1_200, 4_000
EMBED, CHAR, CHAR_STATE, STATE = 8, 10, 12, 8
#: Distinct words whose vectors a task keeps; documents whose words are scored together.
CACHE, CHUNK_WORDS = 150_000, 150_000
#: Windows whose word numbers are laid out together.
BLOCK = 16_384
EDGES = ".,;:!?\"'()[]{}<>*_-"


def words_of(text: str | None) -> list[str]:
    """Lower-case words without punctuation at their ends, long ones cut into pieces: all of the text, in order."""
    out = []
    for word in (text or "").lower().split():
        word = word.strip(EDGES) or word
        if len(word) <= PIECE:
            out.append(word)
        else:
            out.extend(word[i : i + PIECE] for i in range(0, len(word), PIECE))
    return out


def windows_of(n: int) -> list[tuple[int, int]]:
    """Overlapping (start, stop) that cover n words."""
    starts = range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)
    return [(s, min(n, s + WINDOW)) for s in starts] if n else []


def letters(word: str) -> list[int]:
    """Character codes 1..511: code points, folded where they are larger."""
    return [1 + ord(c) % 511 for c in word]


@dataclass
class Model:
    p: dict[str, np.ndarray]
    vocabulary: dict[str, int]
    shift: float = 0.0
    slope: float = 1.0

    def chars(self, words: list[str], keep: bool = False):
        """Last states of the character GRUs, both ways; all words are read together, padded to the longest."""
        codes = [letters(w) for w in words]
        size = max(map(len, codes), default=1) or 1
        ids = np.zeros((len(words), size), np.int64)
        for i, c in enumerate(codes):
            ids[i, : len(c)] = c
        mask = (ids > 0).astype(np.float32)
        x = self.p["char"][ids]
        flat = x.reshape(-1, x.shape[2])
        out, kept = [], []
        for name, reverse in (("cf", False), ("cb", True)):
            g = (flat @ self.p[f"{name}.w"] + self.p[f"{name}.b"]).reshape(len(words), size, -1)
            states, saved = gru.run(self.p, name, g, mask, reverse, keep)
            at = np.zeros(len(words), np.int64) if reverse else np.maximum(mask.sum(1).astype(np.int64) - 1, 0)
            out.append(states[np.arange(len(words)), at])
            kept.append((saved, at))
        return np.concatenate(out, axis=1), (ids, flat, size, kept)

    def vectors(self, words: list[str]) -> np.ndarray:
        """(embedding, character states) of distinct words, in groups of similar length."""
        out = np.zeros((len(words), EMBED + 2 * CHAR_STATE), np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for a in range(0, len(order), 4096):
            part = order[a : a + 4096]
            out[part, EMBED:] = self.chars([words[i] for i in part])[0]
        out[:, :EMBED] = self.p["embed"][[self.vocabulary.get(w, 0) for w in words]]
        return out

    def inputs(self, vectors: np.ndarray) -> np.ndarray:
        """What both word GRUs take in for each word, side by side."""
        return np.concatenate([vectors @ self.p[f"{n}.w"] + self.p[f"{n}.b"] for n in ("wf", "wb")], axis=1)

    def pool(self, states: np.ndarray, mask: np.ndarray):
        a = np.tanh(states @ self.p["att.w"] + self.p["att.b"])
        e = a @ self.p["att.v"] - 1e9 * (1 - mask)
        share = np.exp(e - e.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        pooled = (share[:, :, None] * states).sum(1)
        return pooled @ self.p["out.w"] + self.p["out.b"][0], (a, share, pooled)

    def logits(self, inputs: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Windows of word numbers into `inputs` -> logits."""
        n, out = 3 * STATE, []
        for a in range(0, len(ids), 2048):
            part, m = ids[a : a + 2048], mask[a : a + 2048]
            states = np.empty((*part.shape, 2 * STATE), np.float32)
            for name, at, order in (("wf", 0, range(part.shape[1])), ("wb", 1, range(part.shape[1] - 1, -1, -1))):
                h = np.zeros((len(part), STATE), np.float32)
                for t in order:
                    h, _ = gru.step(self.p, name, inputs[part[:, t], at * n : at * n + n], h, m[:, t])
                    states[:, t, at * STATE : (at + 1) * STATE] = h
            out.append(self.pool(states, m)[0])
        return np.concatenate(out) if out else np.zeros(0)

    def learn(self, windows: list[list[str]], labels: np.ndarray, adam: gru.Adam) -> float:
        """One batch: forward, backward through words and characters, one step. Returns the loss."""
        p = self.p
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        distinct = sorted({w for x in windows for w in x}, key=lambda w: (len(w), w))  # not in the order of a set, which differs between processes
        number = {w: i for i, w in enumerate(distinct)}
        states, (ids, flat, size, kept) = self.chars(distinct, keep=True)
        known = np.array([self.vocabulary.get(w, 0) for w in distinct])
        vectors = np.concatenate([p["embed"][known], states], axis=1)
        at = np.zeros((len(windows), WINDOW), np.int64)
        mask = np.zeros((len(windows), WINDOW), np.float32)
        for i, x in enumerate(windows):
            at[i, : len(x)] = [number[w] for w in x]
            mask[i, : len(x)] = 1
        n, runs = 3 * STATE, []
        inputs = self.inputs(vectors)
        for k, (name, reverse) in enumerate((("wf", False), ("wb", True))):
            runs.append(gru.run(p, name, inputs[at, k * n : k * n + n], mask, reverse, keep=True))
        hidden = np.concatenate([r[0] for r in runs], axis=2)
        logit, (a, share, pooled) = self.pool(hidden, mask)
        guess = gru.sigmoid(logit)
        loss = -float(np.mean(labels * np.log(guess + 1e-7) + (1 - labels) * np.log(1 - guess + 1e-7)))
        g = ((guess - labels) / len(labels)).astype(np.float32)
        grads["out.w"] += pooled.T @ g
        grads["out.b"] += g.sum()
        dpooled = g[:, None] * p["out.w"]
        dshare = (hidden * dpooled[:, None, :]).sum(2)
        dscore = share * (dshare - (share * dshare).sum(1, keepdims=True))
        grads["att.v"] += (a * dscore[:, :, None]).sum((0, 1))
        da = dscore[:, :, None] * p["att.v"] * (1 - a * a)
        grads["att.w"] += hidden.reshape(-1, 2 * STATE).T @ da.reshape(-1, 2 * STATE)
        grads["att.b"] += da.sum((0, 1))
        dhidden = share[:, :, None] * dpooled[:, None, :] + da @ p["att.w"].T
        dvectors = np.zeros_like(vectors)
        for k, (name, _) in enumerate((("wf", False), ("wb", True))):
            dx = gru.back(p, grads, name, runs[k][1], dhidden[:, :, k * STATE : (k + 1) * STATE]) * mask[:, :, None]
            per_word = np.zeros((len(distinct), n), np.float32)
            np.add.at(per_word, at.ravel(), dx.reshape(-1, n))
            grads[f"{name}.w"] += vectors.T @ per_word
            grads[f"{name}.b"] += per_word.sum(0)
            dvectors += per_word @ p[f"{name}.w"].T
        np.add.at(grads["embed"], known, dvectors[:, :EMBED])
        grads["embed"][0] = 0
        dflat = np.zeros_like(flat)
        for k, (name, _) in enumerate((("cf", False), ("cb", True))):
            saved, last = kept[k]
            dstates = np.zeros((len(distinct), size, CHAR_STATE), np.float32)
            dstates[np.arange(len(distinct)), last] = dvectors[:, EMBED + k * CHAR_STATE : EMBED + (k + 1) * CHAR_STATE]
            dx = gru.back(p, grads, name, saved, dstates).reshape(-1, 3 * CHAR_STATE)
            grads[f"{name}.w"] += flat.T @ dx
            grads[f"{name}.b"] += dx.sum(0)
            dflat += dx @ p[f"{name}.w"].T
        np.add.at(grads["char"], ids.ravel(), dflat)
        grads["char"][0] = 0
        adam.update(p, grads)
        p["embed"][0] = 0
        p["char"][0] = 0
        return loss

    def score(self, texts: list[list[str]], cache: dict | None = None) -> np.ndarray:
        """Logit of the worst window of each list of words; texts without words get that of an empty window's bias."""
        cache = {} if cache is None else cache
        if len(cache.get("number", ())) > CACHE:
            cache.clear()
        number = cache.setdefault("number", {})
        table = cache.setdefault("table", np.zeros((0, 6 * STATE), np.float32))
        flat = array("q")
        fresh: list[str] = []
        for words in texts:
            for w in words:
                i = number.get(w)
                if i is None:
                    i = number[w] = len(number)
                    fresh.append(w)
                flat.append(i)
        if fresh:
            table = cache["table"] = np.concatenate([table, self.inputs(self.vectors(fresh))])
        flat.extend([0] * WINDOW)
        flat_ = np.frombuffer(flat, np.int64)
        starts, stops, owner, base = array("q"), array("q"), array("q"), 0
        for i, words in enumerate(texts):
            for s, e in windows_of(len(words)):
                starts.append(base + s)
                stops.append(base + e)
                owner.append(i)
            base += len(words)
        worst = np.full(len(texts), float(self.p["out.b"][0]) - 20.0)
        if starts:
            first, last, found = np.frombuffer(starts, np.int64), np.frombuffer(stops, np.int64), np.full(len(texts), -np.inf)
            for a in range(0, len(first), BLOCK):
                at = first[a : a + BLOCK, None] + np.arange(WINDOW)
                mask = (at < last[a : a + BLOCK, None]).astype(np.float32)
                logit = self.logits(table, flat_[np.minimum(at, len(flat_) - 1)] * (mask > 0), mask)
                np.maximum.at(found, np.frombuffer(owner, np.int64)[a : a + BLOCK], logit)
            worst = np.where(np.isfinite(found), found, worst)
        return worst

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return gru.sigmoid(np.clip((logit - self.shift) * self.slope, -30, 30))


def grams(word: str) -> set[str]:
    """Character n-grams of a word with its ends marked, and the word itself."""
    marked = f"^{word}$"
    return {marked} | {marked[i : i + 4] for i in range(len(marked) - 3)} | {marked[i : i + 5] for i in range(len(marked) - 4)}


def evidence(texts: list[list[str]], labels: np.ndarray) -> dict[str, float]:
    """Log odds of character n-grams between toxic and clean documents, for those that enough toxic ones hold; only these are counted in clean ones."""
    toxic, clean = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    held: Counter = Counter()
    for words, y in zip(texts, labels.tolist(), strict=True):
        if y:
            held.update({g for w in set(words) for g in grams(w)})
    held = Counter({g: n for g, n in held.items() if n >= max(3, toxic // 100)})
    other: Counter = Counter()
    for words, y in zip(texts, labels.tolist(), strict=True):
        if not y:
            other.update({g for w in set(words) for g in grams(w) if g in held})
    return {g: float(np.log((n / toxic + 1e-4) / (other[g] / clean + 1e-3))) for g, n in held.items()}


def train(texts: list[str | None], labels: list[int], seed: int = 5, epochs: tuple[int, ...] = (3, 2, 3), batch: int = 192) -> Model:
    """A model from whole texts and their labels; rounds of `epochs`, windows chosen anew before each round."""
    rng = np.random.default_rng(seed)
    one: dict[str, str] = {}  # a word is one string, however often it occurs
    split, y = [[one.setdefault(w, w) for w in words_of(t)] for t in texts], np.array(labels, dtype=np.int64)
    counts = Counter(w for x in split for w in set(x))
    common = sorted((w for w, n in counts.items() if n > 2), key=lambda w: (-counts[w], w))[:VOCABULARY]
    p = {"embed": (rng.standard_normal((len(common) + 1, EMBED)) * 0.3).astype(np.float32), "char": (rng.standard_normal((512, CHAR)) * 0.5).astype(np.float32)}
    p |= gru.layer(rng, CHAR, CHAR_STATE, "cf") | gru.layer(rng, CHAR, CHAR_STATE, "cb")
    p |= gru.layer(rng, EMBED + 2 * CHAR_STATE, STATE, "wf") | gru.layer(rng, EMBED + 2 * CHAR_STATE, STATE, "wb")
    p |= {"att.w": gru.weights(rng, 2 * STATE, 2 * STATE), "att.b": np.zeros(2 * STATE, np.float32), "att.v": gru.weights(rng, 2 * STATE), "out.w": gru.weights(rng, 2 * STATE), "out.b": np.zeros(1, np.float32)}
    p["embed"][0] = 0
    p["char"][0] = 0
    model = Model(p, {w: i + 1 for i, w in enumerate(common)})
    if len(set(labels)) < 2:  # nothing to tell apart: a constant
        model.p["out.w"][:] = 0
        model.shift = 10.0 if not any(labels) else -10.0
        return model
    windows = [[x[s:e] for s, e in windows_of(len(x))] for x in split]
    odds = evidence(split, y)
    known: dict[str, float] = {}

    def look(w: str) -> float:
        if w not in known:
            known[w] = max((odds.get(g, 0.0) for g in grams(w)), default=0.0)
        return known[w]

    looks = [np.array([max(map(look, x), default=0.0) for x in per]) for per in windows]
    odds, known = {}, {}  # not needed any more
    adam = gru.Adam(p, 0.01)
    for round_, times in enumerate(epochs):
        picked: list[tuple[list[str], int]] = []
        for per, seen, label in zip(windows, looks, y.tolist(), strict=True):
            if not per:
                continue
            top = np.argsort(-seen, kind="stable")
            if label:
                picked += [(per[i], 1) for i in top[:2] if seen[i] >= seen[top[0]] - (0.7 if round_ == 0 else 2.0)]
            else:
                picked += [(per[i], 0) for i in {int(top[0]), int(rng.integers(len(per))), int(rng.integers(len(per)))}]
        size = max(16, min(batch, len(picked) // 24))  # small samples still get enough steps
        for epoch in range(times if size == batch else 2 * times):
            adam.rate = 0.01 if round_ < len(epochs) - 1 else 0.01 / (1 + epoch)
            order = rng.permutation(len(picked))
            for a in range(0, len(order), size):
                part = [picked[i] for i in order[a : a + size]]
                model.learn([x for x, _ in part], np.array([l for _, l in part], dtype=np.float32), adam)
        if round_ < len(epochs) - 1:
            cache: dict = {}
            flat = model.score([x for per in windows for x in per], cache)
            cuts = np.cumsum([len(per) for per in windows])[:-1]
            looks = np.split(flat, cuts)
    logit = model.score(split)
    tries = np.unique(np.concatenate([np.quantile(logit, np.linspace(0, 1, 401)), [0.0]]))
    right = [((logit >= t) == (y == 1)).mean() for t in tries]
    good = tries[np.array(right) >= max(right) - 1e-12]
    model.shift = float((good.min() + good.max()) / 2)
    return model


def crc_fold(column) -> F.Column:
    """crc32 of an id as text, modulo 5; 0 is held out."""
    return F.crc32(column.cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on at most `sample` labelled documents of each label among those not held out, the first by a hash of their ids.

    Labels without an id or other than 0 and 1 are left out; an id with both counts as toxic. Null texts are trained on as empty ones. Equal
    tables give equal models, in any process.
    """
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(crc_fold(F.col("doc_id")) != 0)
    first = [rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(first[0].union(first[1]))  # at most 2 * sample rows of two numbers
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * sample)
    found = [(r["text"], r["toxic"]) for r in texts.collect()]
    model = train([t for t, _ in found], [y for _, y in found])
    give_back()  # the stages after this one share the driver
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, ...) -> all columns, with `toxicity` (0 to 1) from all overlapping windows of the whole text.

    Null and empty texts have no window and score near 0. Very long texts are scored in chunks of windows. Repeated rows score alike, and a
    column named toxicity is replaced. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_, cache = shared.value, {}
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            scores, part, size = [], [], 0
            for x in texts:
                words = words_of(x.as_py())
                if len(words) > CHUNK_WORDS:  # pieces overlap by a stride, so that no window is lost
                    pieces = [words[a : a + CHUNK_WORDS + STRIDE] for a in range(0, len(words), CHUNK_WORDS)]
                    scores.extend(model_.score(part, cache) if part else [])
                    scores.append(max(float(model_.score([piece], cache)[0]) for piece in pieces))
                    part, size = [], 0
                    continue
                part.append(words)
                size += len(words)
                if size >= CHUNK_WORDS:
                    scores.extend(model_.score(part, cache))
                    part, size = [], 0
            scores.extend(model_.score(part, cache) if part else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model_.probability(np.array(scores, dtype=np.float64)), pa.float64())], names=[*batch.schema.names, "toxicity"])

    plain = docs.drop("toxicity").withColumn("text", F.col("text").cast("string"))
    return plain.mapInArrow(run, plain.select("*", F.lit(0.0).alias("toxicity")).schema)
