"""Language of documents by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into segments of ``SEGMENT`` bytes; every segment is read in both
directions, and every position gets probabilities over the languages. A document's
probabilities are the mean over all of its positions. The network is trained in numpy by
backpropagation through time, on ``SAMPLE`` documents of the training fold on average, and
``DRAWN`` segments of each. Executors need this package.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without any
labelled text everything is; a null id is never learned from; repeated rows are predicted
each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmine.llm.naming import drawn
from threadmine.llm.toxicity import in_fold

SEGMENT = 64
HIDDEN = 8
SAMPLE = 4_000
DRAWN = 4
BATCH = 256
EPOCHS = 4
RATE = 0.02
SEED = 5
#: Segments that are read at a time when predicting.
AT_ONCE = 4096

UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    x *= 2
    _sigmoid(x)
    x *= 2
    x -= 1
    return x


@dataclass
class Network:
    """Weights: for each direction a row of gate inputs per byte (update, reset, candidate) and
    two recurrent matrices; one output layer over both directions' states."""

    languages: list[str]
    inputs: np.ndarray  # direction, byte, 3 H
    gates: np.ndarray  # direction, H, 2 H
    candidate: np.ndarray  # direction, H, H
    output: np.ndarray  # 2 H, languages
    bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], hidden: int = HIDDEN) -> Network:
        rng, n = np.random.default_rng(SEED), len(languages)

        def draw(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(hidden), shape).astype(np.float32)

        return cls(
            languages,
            draw(2, 256, 3 * hidden),
            draw(2, hidden, 2 * hidden),
            draw(2, hidden, hidden),
            draw(2 * hidden, n),
            np.zeros(n, np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.inputs, self.gates, self.candidate, self.output, self.bias]

    def states(self, bytes_: np.ndarray, lengths: np.ndarray, trace: list | None) -> np.ndarray:
        """States at every position (position, row, 2 H). ``bytes_``: row, position. ``trace``
        gets what the way back needs."""
        n, steps = bytes_.shape
        hidden = self.candidate.shape[1]
        out = np.zeros((steps, n, 2 * hidden), np.float32)
        by_step = np.ascontiguousarray(bytes_.T)
        for d in (0, 1):
            h = np.zeros((n, hidden), np.float32)
            # Each gate's weights apart, so that all arrays of a step are contiguous.
            of_update, of_reset, of_new = map(np.ascontiguousarray, np.split(self.inputs[d], 3, 1))
            to_update, to_reset = map(np.ascontiguousarray, np.split(self.gates[d], 2, 1))
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                own = by_step[t]
                update = _sigmoid(of_update.take(own, axis=0) + h @ to_update)
                reset = _sigmoid(of_reset.take(own, axis=0) + h @ to_reset)
                kept = reset * h
                new = _tanh(of_new.take(own, axis=0) + kept @ self.candidate[d])
                next_ = h + update * (new - h)
                live = (t < lengths)[:, None]
                # Behind a segment's end the way back has not begun, and the way forth is over:
                # what stands there then is read by nobody.
                if d == 1 and not live.all():
                    next_ *= live
                if trace is not None:
                    trace.append((d, t, h, update, reset, kept, new, live))
                h = next_
                out[t, :, d * hidden : (d + 1) * hidden] = h
        return out

    def probabilities(self, bytes_: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of every language at every position: position, row, language."""
        return self._softmax(self.states(bytes_, lengths, None))

    def _softmax(self, states: np.ndarray) -> np.ndarray:
        flat = states.reshape(-1, states.shape[-1])
        logits = self.output.T @ flat.T + self.bias[:, None]  # language, position and row
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return np.moveaxis(logits.reshape(-1, *states.shape[:-1]), 0, -1)

    def gradients(
        self, bytes_: np.ndarray, lengths: np.ndarray, target: np.ndarray
    ) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over positions and its gradients, back through time."""
        trace: list = []
        states = self.states(bytes_, lengths, trace)
        p = self._softmax(states)
        n, steps = bytes_.shape
        hidden = self.candidate.shape[1]
        live = (np.arange(steps)[:, None] < lengths[None, :]).astype(np.float32)
        weight = live / max(1.0, live.sum())
        loss = -(np.log(p[:, np.arange(n), target] + 1e-9) * weight).sum()
        d_logits = p
        d_logits[:, np.arange(n), target] -= 1
        d_logits *= weight[:, :, None]
        grads = [np.zeros_like(x) for x in self.parameters()]
        g_inputs, g_gates, g_candidate, g_output, g_bias = grads
        flat = d_logits.reshape(-1, d_logits.shape[-1])
        g_output += states.reshape(-1, 2 * hidden).T @ flat
        g_bias += flat.sum(axis=0)
        d_states = d_logits @ self.output.T
        by_step = bytes_.T
        carried = [np.zeros((n, hidden), np.float32) for _ in range(2)]
        for d, t, h, update, reset, kept, new, on in reversed(trace):
            d_h = carried[d] + d_states[t, :, d * hidden : (d + 1) * hidden]
            d_next = np.where(on, d_h, 0)
            d_new = d_next * update * (1 - new**2)
            d_kept = d_new @ self.candidate[d].T
            d_update = d_next * (new - h) * update * (1 - update)
            d_reset = d_kept * h * reset * (1 - reset)
            d_gate = np.concatenate([d_update, d_reset], axis=1)
            g_candidate[d] += kept.T @ d_new
            g_gates[d] += h.T @ d_gate
            np.add.at(g_inputs[d], by_step[t], np.concatenate([d_gate, d_new], axis=1))
            carried[d] = (
                d_next * (1 - update)
                + d_kept * reset
                + d_gate @ self.gates[d].T
                + np.where(on, 0, d_h)
            )
        return float(loss), grads


def fit(segments: list[bytes], languages: list[str]) -> Network:
    """Network trained on segments with a language each."""
    names = sorted(set(languages))
    network = Network.new(names)
    bytes_, lengths = matrix(segments)
    target = np.array([names.index(x) for x in languages])
    rng = np.random.default_rng(SEED)
    first = [np.zeros_like(x) for x in network.parameters()]
    second = [np.zeros_like(x) for x in network.parameters()]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(segments))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            _, grads = network.gradients(bytes_[own], lengths[own], target[own])
            step += 1
            for x, g, m, v in zip(network.parameters(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return network


def matrix(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Segments as rows of bytes, filled with zeros, and their lengths."""
    padded = b"".join(s.ljust(SEGMENT, b"\0") for s in segments)
    bytes_ = np.frombuffer(padded, np.uint8).reshape(-1, SEGMENT)
    return bytes_, np.array([len(s) for s in segments], np.int64)


def cut(text: str) -> list[bytes]:
    raw = text.encode()
    return [raw[at : at + SEGMENT] for at in range(0, len(raw), SEGMENT)]


def pooled(network: Network, texts: list[str]) -> np.ndarray:
    """Mean probabilities over all positions of each text (none of them empty)."""
    total = np.zeros((len(texts), len(network.languages)))
    sizes = np.zeros(len(texts))
    waiting: list[bytes] = []
    owner: list[int] = []

    def read() -> None:
        bytes_, lengths = matrix(waiting)
        p = network.probabilities(bytes_, lengths)
        live = np.arange(SEGMENT)[:, None] < lengths[None, :]
        sums = np.einsum("tnl,tn->nl", p, live.astype(np.float32))
        np.add.at(total, owner, sums)
        np.add.at(sizes, owner, lengths)
        waiting.clear()
        owner.clear()

    for i, text in enumerate(texts):
        segments = cut(text)
        for at in range(0, len(segments), AT_ONCE):
            waiting.extend(segments[at : at + AT_ONCE])
            owner.extend([i] * len(segments[at : at + AT_ONCE]))
            if len(waiting) >= AT_ONCE:
                read()
    if waiting:
        read()
    return total / sizes[:, None]


def has_letter(text: str | None) -> bool:
    return text is not None and (text[:64].isalpha() or any(c.isalpha() for c in text))


def train(docs: DataFrame, text: str = "text", folds: int = 4, held_out: int = 2) -> Network | None:
    """Network from the labelled rows outside the held-out fold; None if there is none."""
    rows = docs.filter(
        F.col("doc_id").isNotNull()
        & F.col("lang").isNotNull()
        & F.col(text).isNotNull()
        & (in_fold("doc_id", folds) != held_out)
    )
    share = min(1.0, SAMPLE / max(1, rows.select("doc_id").count()))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, chosen = [], []
            for key, name, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if has_letter(own):
                    parts = cut(own)
                    rng = np.random.default_rng([SEED, key & 0xFFFFFFFF])
                    for i in rng.permutation(len(parts))[:DRAWN]:
                        languages.append(name)
                        chosen.append(parts[i])
            yield pa.record_batch(
                [pa.array(languages, pa.string()), pa.array(chosen, pa.binary())],
                ["lang", "segment"],
            )

    labelled = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", text)
    sample = drawn(labelled, share, SEED).mapInArrow(segments, "lang string, segment binary").toPandas()
    if sample.empty:
        return None
    sample = sample.sort_values(["lang", "segment"], ignore_index=True)
    return fit([bytes(s) for s in sample["segment"]], sample["lang"].tolist())


def predict_languages(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row."""
    # A few thousand numbers, whatever the corpus.
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, text))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                texts = some.column(1).to_pylist()
                names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                read = [i for i, t in enumerate(texts) if network and has_letter(t)]
                if read:
                    p = pooled(network, [texts[i] for i in read])
                    for i, own in zip(read, p, strict=True):
                        names[i] = network.languages[int(own.argmax())]
                        scores[i] = float(min(1.0, own.max()))
                yield pa.record_batch(
                    [some.column(0), pa.array(names), pa.array(scores)],
                    ["doc_id", "lang_pred", "score"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text))
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double").select(
        "doc_id", (in_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )
