"""Language-model scores of whole documents by a gated recurrent network, beside a smoothed unigram base.

Words of all training documents are counted by a shuffle. The `model_words` most frequent words, an end token and a
token for all other words are what the network predicts; its output softmax is factored into classes of words. The
network is trained on all training documents, each once: they are dealt by hash over a fixed number of rounds, each
task trains the round's weights on its documents by truncated backpropagation through time (numpy, a bounded block of
tokens at a time), and the tasks' weights are averaged by tokens, in a tree, before the next round. Scoring carries
each document's state from window to window, so that a text has one likelihood, however long; a word outside the
model's counts as the token for others times its smoothed share among them.

The counts of the `known_words` most frequent words travel with the tasks (that bound holds at any size); rarer
words are looked up by a join, one row for each of a document's distinct ones.

Null text counts as empty: the end token alone. Without training documents every count is 0.
"""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.bpe import slices
from candor.llm.common import id_bucket, text_or_empty, written

END, OTHER = 0, 1
#: Tokens that a task trains on at a time, and weights averaged by one task.
BLOCK, FAN_IN = 1 << 20, 32


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def flushed():
        rows = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        seen.clear()
        return rows

    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(words(text))
            seen[b""] += 1
            if len(seen) > 400_000:
                yield flushed()
    yield flushed()


class Network:
    """A gated recurrent layer and a softmax factored into classes, in single precision."""

    def __init__(self, counts: list[int], hidden: int = 20, seed: int = 3):
        rng = np.random.default_rng(seed)
        n = len(counts)
        self.classes = max(1, int(np.sqrt(n)))
        self.width = -(-n // self.classes)
        self.hidden = hidden
        norm = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        share_of = np.zeros(self.classes * self.width)
        share_of[:n] = np.array(counts, float) + 0.5
        grid = share_of.reshape(self.classes, self.width)
        mass = grid.sum(1, keepdims=True)
        with np.errstate(divide="ignore"):
            inner = np.where(grid > 0, np.log(grid / mass), -60.0)
        self.p = {
            "embed": norm(n, hidden),
            "into": norm(hidden, 3 * hidden),
            "across": norm(hidden, 3 * hidden),
            "gates": np.zeros(3 * hidden, np.float32),
            "class_w": norm(hidden, self.classes) * 0.1,
            "class_b": np.log(mass[:, 0] / mass.sum()).astype(np.float32),
            "word_w": norm(self.classes, hidden, self.width) * 0.1,
            "word_b": inner.astype(np.float32),
        }

    def step(self, fed: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state from projected inputs, and what the backward pass needs."""
        h = self.hidden
        rec = state @ self.p["across"]
        gate = _sigmoid(fed[:, : 2 * h] + rec[:, : 2 * h])
        z, r, back = gate[:, :h], gate[:, h:], rec[:, 2 * h :]
        new = r * back
        new += fed[:, 2 * h :]
        np.tanh(new, out=new)
        after = state - new
        after *= z
        after += new
        return after, z, r, new, back

    def log_likelihood(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log-probability of each target after its state."""
        p = self.p
        kind = (targets // self.width).astype(np.int16)
        order = np.argsort(kind, kind="stable")
        states, targets, kind = states[order], targets[order], kind[order]
        logits = states @ p["class_w"]
        logits += p["class_b"]
        out = logits[np.arange(len(kind)), kind]
        out -= _log_sum(logits)
        place, cuts = targets % self.width, np.searchsorted(kind, np.arange(self.classes + 1))
        for c in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[c], cuts[c + 1]
            inner = states[a:b] @ p["word_w"][c]
            inner += p["word_b"][c]
            own = inner[np.arange(b - a), place[a:b]]
            own -= _log_sum(inner)
            out[a:b] += own
        back = np.empty_like(out)
        back[order] = out
        return back

    def score(self, docs: list[np.ndarray], window: int = 16_384) -> np.ndarray:
        """Natural log-likelihood of each document: its words, then the end.

        All documents go forward together, the longest longest, and their states from window to window; a window is as
        many steps as make about so many tokens.
        """
        p, h = self.p, self.hidden
        fed_of = p["embed"] @ p["into"] + p["gates"]
        sizes = np.array([len(d) for d in docs], np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat, starts = np.concatenate(docs), (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        total, state, last, t = np.zeros(len(docs)), np.zeros((len(docs), h), np.float32), np.full(len(docs), END, np.int32), 0
        while len(sizes) and t < sizes[0]:
            n = int(np.searchsorted(-sizes, -t, side="left"))
            states, targets, lives = [], [], []
            for t in range(t, min(t + max(1, window // n), int(sizes[0]))):  # noqa: B020
                n = int(np.searchsorted(-sizes[:n], -t, side="left"))
                state = self.step(fed_of[last[:n]], state[:n])[0]
                last = flat[starts[:n] + t]
                states.append(state)
                targets.append(last)
                lives.append(n)
            t += 1
            found = self.log_likelihood(np.concatenate(states), np.concatenate(targets))
            owner = np.concatenate([np.arange(n) for n in lives])
            total[: lives[0]] += np.bincount(owner, found, minlength=lives[0])
        out = np.zeros(len(docs))
        out[order] = total
        return out

    def train(self, stream: np.ndarray, lanes: int = 64, window: int = 24, rate: float = 0.01, passes: int = 1, memory: dict | None = None) -> None:
        """Truncated backpropagation: lanes of the stream side by side, state carried from window to window.

        `memory` keeps the optimiser's moments from call to call.
        """
        length = len(stream) // lanes
        if length < 2:
            return
        tokens = np.ascontiguousarray(stream[: lanes * length].reshape(lanes, length).T)
        memory = {} if memory is None else memory
        p, t = self.p, memory.setdefault("t", 0)
        moments = memory.setdefault("moments", {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()})
        for _ in range(passes):
            state = np.zeros((lanes, self.hidden), np.float32)
            for start in range(0, length - 1, window):
                goal = tokens[start + 1 : start + window + 1]
                grads, state = self.gradients(tokens[start : start + len(goal)], goal, state)
                t += 1
                for name, g in grads.items():
                    first, second = moments[name]
                    np.clip(g, -1, 1, out=g)
                    first *= 0.9
                    first += 0.1 * g
                    g *= g
                    second *= 0.99
                    second += 0.01 * g
                    size = np.sqrt(second)
                    size *= np.float32(1 / np.sqrt(1 - 0.99**t))
                    size += np.float32(1e-8)
                    p[name] -= np.float32(rate / (1 - 0.9**t)) * first / size
        memory["t"] = t

    def gradients(self, ins: np.ndarray, goal: np.ndarray, state: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean loss over a window (steps, lanes) of tokens and those that follow them, by each weight; and the state after it."""
        p, h = self.p, self.hidden
        steps, lanes = ins.shape
        ins = ins.reshape(-1)
        fed = (p["embed"] @ p["into"] + p["gates"])[ins].reshape(steps, lanes, 3 * h)
        kept = []
        for k in range(steps):
            before = state
            state, z, r, new, rec = self.step(fed[k], before)
            kept.append((before, z, r, new, rec, state))
        back, grads = self._output(np.concatenate([x[5] for x in kept]), goal.reshape(-1))
        fed_back, rec_back = np.empty_like(fed), np.empty_like(fed)
        flow, across = np.zeros_like(state), p["across"].T.copy()
        for k in range(steps - 1, -1, -1):
            before, z, r, new, rec, _ = kept[k]
            d = back[k * lanes : (k + 1) * lanes] + flow
            keep = d * z
            d_new = (d - keep) * (1 - new * new)
            fed_back[k, :, :h] = keep * (before - new) * (1 - z)
            fed_back[k, :, h : 2 * h] = d_new * rec * r * (1 - r)
            fed_back[k, :, 2 * h :] = d_new
            rec_back[k, :, : 2 * h] = fed_back[k, :, : 2 * h]
            rec_back[k, :, 2 * h :] = d_new * r
            flow = keep + rec_back[k] @ across
        grads["across"] = np.concatenate([x[0] for x in kept]).T @ rec_back.reshape(-1, 3 * h)
        order = np.argsort(ins, kind="stable")
        words, first = np.unique(ins[order], return_index=True)
        sums = np.add.reduceat(fed_back.reshape(-1, 3 * h)[order], first, axis=0)
        grads["gates"], grads["into"] = sums.sum(0), p["embed"][words].T @ sums
        grads["embed"] = np.zeros_like(p["embed"])
        grads["embed"][words] = sums @ p["into"].T
        return grads, state

    def _output(self, states: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The loss's gradient by the states, and by the weights of the softmax."""
        p, n = self.p, np.float32(len(goal))
        kind = (goal // self.width).astype(np.int16)
        order = np.argsort(kind, kind="stable")
        states, kind, place = states[order], kind[order], (goal % self.width)[order]
        outer = _soft(states @ p["class_w"] + p["class_b"])
        outer[np.arange(len(kind)), kind] -= 1
        back = outer @ p["class_w"].T
        grads = {k: np.zeros_like(p[k]) for k in ("word_w", "word_b")}
        grads["class_w"], grads["class_b"] = states.T @ outer / n, outer.sum(0) / n
        cuts = np.searchsorted(kind, np.arange(self.classes + 1))
        for c in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[c], cuts[c + 1]
            inner = _soft(states[a:b] @ p["word_w"][c] + p["word_b"][c])
            inner[np.arange(b - a), place[a:b]] -= 1
            back[a:b] += inner @ p["word_w"][c].T
            grads["word_w"][c], grads["word_b"][c] = states[a:b].T @ inner / n, inner.sum(0) / n
        out = np.empty_like(back)
        out[order] = back / n
        return out, grads


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp(x - top), its sums by row, and top: 0 where no row needs it, as rows are short and their maxima slow. Overwrites x."""
    top: np.ndarray | float = 0.0
    if x.size and (x.max() > 60 or x.min() < -80):
        top = x.max(axis=1, keepdims=True)
        x -= top
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype), top


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Overwrites x."""
    _, total, top = _exp(x)
    out = np.log(total)
    out += top if isinstance(top, float) else top[:, 0]
    return out


def _soft(x: np.ndarray) -> np.ndarray:
    """In place."""
    x, total, _ = _exp(x)
    x *= (1 / total)[:, None]
    return x


def frequent(counts: DataFrame, most: int) -> list:
    """The most frequent words, at most `most`, with their counts: all from a count on that a coarse histogram sets."""
    step = F.floor(F.log2("n") * 32).cast("int")
    real = counts.where("word != ''")
    least, so_far = None, 0
    for r in sorted(real.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        so_far += r["count"]
        if so_far > most:
            break
        least = r["step"]
    return [] if least is None else sorted(real.where(step >= least).collect(), key=lambda r: (-r.n, r.word))


def _averaged(rows: list[tuple[int, bytes]]) -> tuple[int, bytes]:
    """(tokens, weights) of several tasks as one, by their tokens."""
    tokens = sum(n for n, _ in rows)
    return tokens, sum(np.frombuffer(w, np.float32).astype(np.float64) * (n / tokens) for n, w in rows).astype(np.float32).tobytes()


def fit(network: Network, train: DataFrame, token_ids: Callable[[str], np.ndarray], rounds: int = 4) -> int:
    """Train `network` on every row of `train` (doc_id, text); the number of tokens it was trained on."""
    context, shapes, seen = train.sparkSession.sparkContext, {k: v.shape for k, v in network.p.items()}, 0

    def put(net: Network, weights: bytes) -> None:
        flat, at = np.frombuffer(weights, np.float32), 0
        for name, shape in shapes.items():
            size = int(np.prod(shape))
            net.p[name] = flat[at : at + size].reshape(shape).copy()
            at += size

    def one(tokens: int, weights: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([weights], pa.binary())], ["tokens", "weights"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(r["tokens"], r["weights"]) for b in batches for r in b.to_pylist()]
        if rows:
            yield one(*_averaged(rows))

    for turn in range(rounds):
        shared = context.broadcast(network)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            net, memory, held, size, total = copy.deepcopy(shared.value), {}, [], 0, 0

            def learn() -> None:
                stream = np.concatenate(held)
                lanes = int(np.clip(len(stream) // 500, 4, 384))
                net.train(np.append(stream, np.full(-len(stream) % lanes, END, np.int32)), lanes, memory=memory)
                held.clear()

            for batch in batches:
                for text in batch.column(0).to_pylist():
                    held.append(token_ids(text))
                    size += len(held[-1])
                    total += len(held[-1])
                    if size >= BLOCK:
                        learn()
                        size = 0
            if held:
                learn()
            if total:
                yield one(total, b"".join(np.ascontiguousarray(v, np.float32).tobytes() for v in net.p.values()))

        shape = "tokens long, weights binary"
        part = train.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(rounds)) == turn).select("text")
        found = written(part.mapInArrow(run, shape))
        while (n := found.count()) > 1:
            found = written(found.repartition(-(-n // FAN_IN)).mapInArrow(join, shape))
        for r in found.collect():  # one at most
            put(network, bytes(r.weights))
            seen += r.tokens
        shared.unpersist()
    return seen


class Numbers(dict):
    """The most frequent words' numbers, few enough to stay near the processor; the others' are looked up beyond, -1 if unknown."""

    def __init__(self, known: dict[bytes, int], most: int = 16_384):
        super().__init__((w, i) for w, i in known.items() if i < most)
        self.beyond = known

    def __missing__(self, word: bytes) -> int:
        return self.beyond.get(word, -1)


class Model(NamedTuple):
    """The network, the numbers of the known words (the first `size` are the network's own), their counts, and totals."""

    network: Network
    known: dict[bytes, int]
    counts: np.ndarray
    size: int
    ends: int
    total: int
    base_norm: float
    other_norm: float


def model_of(train: DataFrame, model_words: int = 2000, known_words: int = 200_000, rounds: int = 4, hidden: int = 20) -> tuple[Model, DataFrame]:
    """The model of all rows of `train` (doc_id, text), and the table of all words' counts (word, n)."""
    counts = written(train.select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    facts = counts.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.max(F.when(F.col("word") == "", F.col("n"))).alias("docs")).first()
    total, kinds, ends = facts.total or 0, facts.kinds or 0, facts.docs or 0
    top = frequent(counts, known_words)
    own = top[:model_words]
    others, other_kinds = total - ends - sum(r.n for r in own), max(kinds - len(own) - 1, 0)
    network = Network([ends, others, *(r.n for r in own)], hidden)
    own_ids = {r.word.encode(): i + 2 for i, r in enumerate(own)}

    def token_ids(text: str) -> np.ndarray:
        found = words(text)
        return np.append(np.fromiter(map(own_ids.get, found, repeat(OTHER)), np.int32, len(found)), np.int32(END))

    fit(network, train, token_ids, rounds)
    known = {r.word.encode(): i for i, r in enumerate(top)}
    return Model(network, known, np.array([r.n for r in top], np.float64), len(own), ends, total, float(np.log10(total + kinds + 1)), float(np.log10(others + other_kinds + 1))), counts


def score(docs: DataFrame, held_out: int = 7, remainder: int = 2, model_words: int = 2000, known_words: int = 200_000, rounds: int = 4, hidden: int = 20) -> DataFrame:
    """One row per document: tokens, known tokens, the training total, base score and the model's score (log10)."""
    given = docs.select("doc_id", (id_bucket(held_out) == remainder).alias("held_out"), text_or_empty().alias("text"))
    learnt, counts = model_of(given.where("not held_out"), model_words, known_words, rounds, hidden)
    model = docs.sparkSession.sparkContext.broadcast(learnt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        log_n, numbers = np.log10(m.counts + 1), Numbers(m.known)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices(texts, 16_000_000):
                ids, facts, rare = [], [], []
                for text in texts[a:b]:
                    found = words(text)
                    at = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
                    inside, unseen = (at >= 0) & (at < m.size), np.flatnonzero(at < 0)
                    seen, beyond = log_n[at[at >= 0]].sum(), log_n[at[at >= m.size]].sum()
                    other = len(found) - int(inside.sum())
                    ids.append(np.append(np.where(inside, at + 2, OTHER), END).astype(np.int32))
                    rare.append([found[i].decode() for i in unseen])
                    facts.append((len(found) + 1, len(found) - len(unseen) + (m.ends > 0), seen + np.log10(m.ends + 1) - (len(found) + 1) * m.base_norm, beyond - other * m.other_norm))
                scores = m.network.score(ids) / np.log(10) + np.array([f[3] for f in facts])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + b - a), pa.int64()),
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array([f[0] for f in facts], pa.int64()),
                        pa.array([int(f[1]) for f in facts], pa.int64()),
                        pa.array([float(f[2]) for f in facts]),
                        pa.array(scores),
                        pa.array(rare, pa.list_(pa.string())),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
                )
                row += b - a

    shape = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<string>"
    scored = written(given.mapInArrow(run, shape))
    asked = scored.select("row", F.explode("rare").alias("asked"))
    looked = asked.join(counts.withColumnRenamed("n", "c"), F.col("asked") == F.col("word")).groupBy("row").agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("c") + 1)).alias("more"))
    full = scored.drop("rare").join(looked.withColumnRenamed("row", "of"), F.col("row") == F.col("of"), "left")
    more = F.coalesce("more", F.lit(0.0))
    return full.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(learnt.total).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score")
    )
