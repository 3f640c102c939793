"""Language of a text by a bidirectional gated recurrent network over bytes, trained here with numpy.

ASCII digits, marks and white space carry no language: they end a word.  Every byte position of every word gets a
probability for each language from the network's forward and backward state inside the word; a document's
probabilities are the mean over all these positions.  States start anew with each word, so the sums of a word are the
same wherever it stands and each distinct word is computed once per task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from watchtide.llm import common

HIDDEN = 8
SEGMENT = 32  # longest run of bytes that shares a state; longer words continue in a new one
SAMPLE_DOCS = 4000  # labelled documents the network is fitted on, at most
WORDS_PER_LANGUAGE = 20_000
EPOCHS = 3
NONE = "und"  # what a text without a letter gets
LETTER = re.compile(r"[^\W\d_]")
KNOWN_WORDS = 200_000  # words whose sums a task remembers


#: Lower-cases A-Z and turns every other ASCII byte that is no letter into a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(w: dict, codes: np.ndarray, way: str, keep: bool = True):
    """States (T, B, h) in reading order of one direction, with what the backward pass needs."""
    n, steps = codes.shape
    size = w["U" + way].shape[0]
    state, states, kept = np.zeros((n, size), np.float32), [], []
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        x, u = w["E" + way][codes[:, t]], state @ w["U" + way]
        gates = _sigmoid(x[:, : 2 * size] + u[:, : 2 * size])
        z, r, un = gates[:, :size], gates[:, size:], u[:, 2 * size:]
        new = np.tanh(x[:, 2 * size:] + r * un)
        if keep:
            kept.append((t, state, z, r, un, new))
        state = new + z * (state - new)
        states.append(state)
    return (states if way == "f" else states[::-1]), kept


def position_probabilities(w: dict, codes: np.ndarray) -> np.ndarray:
    """(T, B, languages) for byte codes (B, T)."""
    ahead, back = _run(w, codes, "f", False)[0], _run(w, codes, "b", False)[0]
    size = w["Uf"].shape[0]
    logits = np.stack(ahead) @ w["V"][:size] + np.stack(back) @ w["V"][size:] + w["c"]
    e = np.exp(logits - logits.max(axis=2, keepdims=True))
    return e / e.sum(axis=2, keepdims=True)


def _gradients(w: dict, codes: np.ndarray, target: np.ndarray) -> dict:
    """Backpropagation through time of the mean cross-entropy over all positions."""
    (ahead, kept_f), (back, kept_b) = _run(w, codes, "f"), _run(w, codes, "b")
    size, (n, steps) = w["Uf"].shape[0], codes.shape
    both = np.concatenate([np.stack(ahead), np.stack(back)], axis=2)
    logits = both @ w["V"] + w["c"]
    e = np.exp(logits - logits.max(axis=2, keepdims=True))
    d = e / e.sum(axis=2, keepdims=True)
    d[:, np.arange(n), target] -= 1
    d /= n * steps
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["V"], g["c"] = np.tensordot(both, d, axes=((0, 1), (0, 1))), d.sum(axis=(0, 1))
    d_states = d @ w["V"].T
    for way, kept, part in (("f", kept_f, slice(0, size)), ("b", kept_b, slice(size, None))):
        carried = np.zeros((n, size), np.float32)
        for t, before, z, r, un, new in reversed(kept):
            dh = d_states[t][:, part] + carried
            dz, dn = dh * (before - new) * z * (1 - z), dh * (1 - z) * (1 - new * new)
            dr = dn * un * r * (1 - r)
            dx = np.concatenate([dz, dr, dn], axis=1)
            du = np.concatenate([dz, dr, dn * r], axis=1)
            np.add.at(g["E" + way], codes[:, t], dx)
            g["U" + way] += before.T @ du
            carried = dh * z + du @ w["U" + way].T
    return g


@dataclass
class Model:
    languages: list[str]
    weights: dict

    def word_sums(self, words: list[bytes]) -> np.ndarray:
        """Sum over a word's positions of the probabilities, with the number of positions as last column."""
        out = np.zeros((len(words), len(self.languages) + 1), np.float32)
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for i, word in enumerate(words):
            for at in range(0, len(word), SEGMENT):
                part = word[at:at + SEGMENT]
                groups.setdefault(len(part), []).append((i, part))
        for length, members in groups.items():
            for at in range(0, len(members), 1024):
                some = members[at:at + 1024]
                codes = np.frombuffer(b"".join(p for _, p in some), np.uint8).reshape(-1, length)
                sums = position_probabilities(self.weights, codes).sum(axis=0)
                np.add.at(out, [i for i, _ in some], np.concatenate([sums, np.full((len(some), 1), length, np.float32)], axis=1))
        return out


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(FOLD).split()


def fit(samples: list[tuple[str, str]], seed: int = 7) -> Model:
    """Network for (text, language) pairs: as many words are drawn from each language."""
    languages = sorted({lang for _, lang in samples})
    rng = np.random.default_rng(seed)
    drawn: list[tuple[bytes, int]] = []
    for k, lang in enumerate(languages):
        words = [w[:SEGMENT] for text, own in samples if own == lang for w in words_of(text)]
        if words:
            drawn += [(words[i], k) for i in rng.integers(0, len(words), WORDS_PER_LANGUAGE)]
    h = HIDDEN
    w = {"V": rng.normal(0, 0.3, (2 * h, len(languages))), "c": np.zeros(len(languages))}
    for way in "fb":
        w["E" + way], w["U" + way] = rng.normal(0, 0.5, (256, 3 * h)), rng.normal(0, 1 / np.sqrt(h), (h, 3 * h))
    w = {k: v.astype(np.float32) for k, v in w.items()}
    by_length: dict[int, list[tuple[bytes, int]]] = {}
    for word, k in drawn:
        by_length.setdefault(len(word), []).append((word, k))
    batches = []
    for length, members in sorted(by_length.items()):
        order = rng.permutation(len(members))
        for at in range(0, len(order), 256):
            some = [members[i] for i in order[at:at + 256]]
            batches.append((np.frombuffer(b"".join(x for x, _ in some), np.uint8).reshape(-1, length),
                            np.array([k for _, k in some])))
    mean, var, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(batches)):
            step += 1
            for k, g in _gradients(w, *batches[i]).items():  # Adam
                mean[k] = 0.9 * mean[k] + 0.1 * g
                var[k] = 0.99 * var[k] + 0.01 * g * g
                rate = 0.01 / (1 + epoch)
                w[k] -= (rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(var[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return Model(languages, w)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on at most ``sample_docs`` labelled documents outside the held-out quarter, those with the smallest id hash."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out())
    ids = known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()
    rows = known.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id").collect()  # the bounded sample
    return fit(sorted((r["text"], r["lang"]) for r in rows))


def labeller(model: Model):
    """For ``map_column``: a task's function from texts to languages and scores."""

    def make():
        place: dict[bytes, int] = {}
        table = np.zeros((0, len(model.languages) + 1), np.float32)

        def run(texts: list[str]) -> tuple[None, list]:
            nonlocal place, table
            lists = [words_of(t) if model.languages and LETTER.search(t) else [] for t in texts]
            if len(place) > KNOWN_WORDS:
                place, table = {}, table[:0]
            new = list(set().union(*lists) - place.keys())
            if new:
                place.update(zip(new, range(len(place), len(place) + len(new))))
                table = np.concatenate([table, model.word_sums(new)])
            pred, score = [], []
            for words in lists:
                if not words:
                    pred.append(NONE)
                    score.append(0.0)
                    continue
                sums = table[np.fromiter(map(place.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
                best = int(sums[:-1].argmax())
                pred.append(model.languages[best])
                score.append(min(1.0, float(sums[best] / sums[-1])))
            return None, [pred, score]

        return run

    return make


def letters():
    """For ``map_column``: a task's function from texts to 1 for those with a letter and 0 for the others."""

    def run(texts: list[str]) -> tuple[None, list]:
        return None, [[int(LETTER.search(t) is not None) for t in texts]]

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per row: the language with the largest mean probability over all byte positions.

    Texts that are null, empty or without a letter, and any text when nothing was learned, give 'und' and score 0.
    Only the text is read.
    """

    return common.map_column(common.texts_of(docs, id_col, text_col), "text", "lang_pred string, score double", labeller(model))
