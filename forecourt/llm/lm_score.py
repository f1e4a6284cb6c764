"""Scores of texts under a gated recurrent language model, trained here.

Words are cut at ASCII white space after lower-casing A-Z; every text ends with an end token.
The network predicts symbols: frequent words have their own, all others share one by how
they end.  A symbol's probability is that of its class times that within its class, both
given the state; a shared symbol is completed by the share of the word in it, counted over
all training texts.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from forecourt.llm.text import slices, utf8_column
from forecourt.llm.threads import one_thread
from forecourt.workspace import stored

#: Words that are sent to every task with their counts; the others are joined.  A bound.
DICTIONARY = 200_000
#: Symbols: own ones of words, and shared ones by the last two bytes of a word.
OWN, SHARED = 447, 64
HIDDEN = 16
#: Steps through which errors are followed back, and texts trained side by side.
WINDOW, STREAMS = 16, 256
#: Texts, and bytes of them, that a task works on at a time; a longer text is alone.
TEXTS, TEXT_BYTES = 4096, 16 << 20
#: The texts are dealt to so many rounds by hash; models are averaged after each.
ROUNDS = 3
RATE = 0.05
_FLUSH = 300_000


def shared_symbol(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SHARED


def held_out(doc_id: Column) -> Column:
    """True for texts the model must not learn from; a NULL number counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


# -- counts -----------------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` (UTF-8), ``k`` (its shared symbol) and ``c`` over all rows of ``texts``.

    Counted in each task, which sends on what it has when its table is full; then summed.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counts: Counter) -> Iterator[pa.RecordBatch]:
            words = list(counts)
            whole = pa.RecordBatch.from_arrays(
                [
                    pa.array(words, pa.binary()),
                    pa.array(map(shared_symbol, words), pa.int32()),
                    pa.array(counts.values(), pa.int64()),
                ],
                names=["word", "k", "c"],
            )
            for start in range(0, len(words), 20_000):
                yield whole.slice(start, 20_000)

        counts: Counter = Counter()
        for batch in batches:
            for text in utf8_column(batch, "text"):
                counts.update(text.lower().split())
                if len(counts) > _FLUSH:
                    yield from rows(counts)
                    counts = Counter()
        yield from rows(counts)

    return texts.select("text").mapInArrow(run, "word binary, k int, c bigint").groupBy("word", "k").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What every task knows of the counts: bounded, whatever the corpus."""

    words: list[bytes]  # the most frequent ones, most frequent first
    counts: np.ndarray
    ends: int  # end tokens, one per training text
    total: int  # N
    distinct: int  # V
    shared_total: np.ndarray  # tokens of words without a symbol of their own, by shared symbol
    shared_once: np.ndarray  # of these, words seen once

    @property
    def own(self) -> int:
        return min(OWN, len(self.words))

    @property
    def end(self) -> int:
        return self.own + SHARED

    @property
    def unseen(self) -> np.ndarray:
        """Share of a shared symbol that is left to words never seen, from those seen once."""
        return np.where(self.shared_total > 0, (self.shared_once + 0.5) / (self.shared_total + 1.0), 1.0)

    def symbol_counts(self) -> np.ndarray:
        return np.concatenate([self.counts[: self.own], self.shared_total, [self.ends]]).astype(np.float64)

    def base_norm(self) -> float:
        return float(np.log10(self.total + 0.1 * (self.distinct + 1)))


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """The bounded part of ``counts`` (stored) and its totals; ``texts`` is how many were counted."""
    # Words by steps of their count's logarithm: some hundred rows.  The dictionary takes all
    # words of the highest steps that fit, so nothing is sorted or cut in one task.
    step = F.floor(F.log2("c") * 16).cast("int")
    steps = {r["step"]: r["n"] for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}
    least, room = None, DICTIONARY
    for at in sorted(steps, reverse=True):
        if steps[at] > room:
            break
        least, room = at, room - steps[at]
    frequent = counts.filter(step >= least) if least is not None else None
    if frequent is None or DICTIONARY - room < OWN:
        # Too many words share a step: those with a symbol of their own are taken apart, by a top list.
        frequent = counts.orderBy(F.desc("c"), "word").limit(min(OWN, DICTIONARY))
    top = frequent.toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    words, c, k = top.column("word").to_pylist(), top.column("c").to_numpy(), top.column("k").to_numpy()
    sums = counts.groupBy("k").agg(
        F.sum("c").alias("c"), F.count("*").alias("words"), F.count(F.when(F.col("c") == 1, 1)).alias("once")
    ).collect()  # one row per shared symbol
    total, once = np.zeros(SHARED, np.int64), np.zeros(SHARED, np.int64)
    for r in sums:
        total[r["k"]], once[r["k"]] = r["c"], r["once"]
    own = min(OWN, len(words))
    everything = int(total.sum()) + texts
    distinct = sum(r["words"] for r in sums) + (texts > 0)
    np.subtract.at(total, k[:own], c[:own])
    np.subtract.at(once, k[:own], (c[:own] == 1).astype(np.int64))
    return Vocabulary(words, c, texts, everything, distinct, total, once)


def text_runs(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``TEXTS`` rows and about ``TEXT_BYTES`` bytes of ``column``; a longer row is alone."""
    for batch in slices(batches, TEXTS):
        sizes = np.asarray(pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0)).astype(np.int64)
        run = np.cumsum(sizes) // TEXT_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


class _Ids(dict):
    """Word to number: its rank in the dictionary, or a fresh number that lasts for a batch."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words))))
        self.base, self.fresh = len(words), []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = self.base + len(self.fresh)
        self.fresh.append(word)
        return number

    def forget(self) -> None:
        for word in self.fresh:
            del self[word]
        self.fresh = []


class Coder:
    """Texts to numbers of words and to symbols."""

    def __init__(self, known: Vocabulary):
        self.known, self.ids = known, _Ids(known.words)
        shared = np.fromiter(map(shared_symbol, known.words), np.int64, len(known.words))
        self.symbols = np.where(np.arange(len(shared)) < known.own, np.arange(len(shared)), known.own + shared)

    def numbers(self, texts: list[bytes]) -> list[np.ndarray]:
        get = self.ids.__getitem__
        out = []
        for text in texts:
            words = text.lower().split()
            out.append(np.fromiter(map(get, words), np.int64, len(words)))
        return out

    def all_symbols(self) -> np.ndarray:
        """Symbol by number, for the numbers given out so far, and last that of the end."""
        fresh = np.fromiter(map(shared_symbol, self.ids.fresh), np.int64, len(self.ids.fresh)) + self.known.own
        return np.concatenate([self.symbols, fresh, [self.known.end]])


# -- network ----------------------------------------------------------------------------


def _grouped(small: np.ndarray) -> np.ndarray:
    """Stable order of small numbers: two bytes are sorted by radix."""
    return np.argsort(small.astype(np.uint16), kind="stable")


class Network:
    """A gated recurrent unit with a class-factored softmax, in single precision.

    Symbols are grouped by descending count into classes of about the root of their number.
    """

    def __init__(self, counts: np.ndarray, hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.n, self.hidden = len(counts), hidden
        order = np.argsort(-counts, kind="stable")
        size = max(1, int(np.ceil(np.sqrt(self.n))))
        self.place = np.empty(self.n, np.int64)
        self.place[order] = np.arange(self.n)  # symbols are renumbered so that classes are runs
        self.edges = np.append(np.arange(0, self.n, size), self.n)
        self.class_of = np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))
        mass = counts[order] + 0.5
        classes = np.add.reduceat(mass, self.edges[:-1])
        normal = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.weights = {
            "inputs": normal(self.n, 3 * hidden),
            "gates": normal(hidden, 2 * hidden),
            "candidate": normal(hidden, hidden),
            "class_w": normal(hidden, len(classes)),
            "class_b": np.log(classes / classes.sum()).astype(np.float32),
            "member_w": normal(self.n, hidden),
            "member_b": np.log(mass / np.repeat(classes, np.diff(self.edges))).astype(np.float32),
        }
        self.squares = {k: np.full_like(v, 1e-4) for k, v in self.weights.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name, w in self.weights.items():
            self.weights[name] = np.asarray(flat[at : at + w.size], np.float32).reshape(w.shape)
            at += w.size

    @property
    def kind(self) -> np.dtype:
        """Precision of the weights, and of all that is computed with them."""
        return self.weights["gates"].dtype

    def _inputs(self, symbols: np.ndarray) -> np.ndarray:
        """What the symbols add to the gates (halved, for the tangent) and to the candidate."""
        x = self.weights["inputs"][symbols]
        x[..., : 2 * self.hidden] *= 0.5
        return x

    def _advance(self, x: np.ndarray, state: np.ndarray, half: np.ndarray, gates: np.ndarray, kept: np.ndarray, fresh: np.ndarray, out: np.ndarray) -> None:
        """One step: ``gates``, ``kept``, ``fresh`` and the new state ``out`` from what came in and ``state``."""
        hidden = self.hidden
        np.matmul(state, half, out=gates)
        gates += x[:, : 2 * hidden]
        np.tanh(gates, out=gates)  # the sigmoid of twice that
        gates *= 0.5
        gates += 0.5
        np.multiply(gates[:, hidden:], state, out=kept)
        np.matmul(kept, self.weights["candidate"], out=fresh)
        fresh += x[:, 2 * hidden :]
        np.tanh(fresh, out=fresh)
        np.subtract(state, fresh, out=out)
        out *= gates[:, :hidden]
        out += fresh

    def step(self, symbols: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """The state after one symbol each, and the gates, what was kept of the old state, and the candidate."""
        state = np.asarray(state, self.kind)
        gates = np.empty((len(state), 2 * self.hidden), self.kind)
        kept, fresh, out = (np.empty_like(state) for _ in range(3))
        self._advance(self._inputs(symbols), state, 0.5 * self.weights["gates"], gates, kept, fresh, out)
        return out, gates, kept, fresh

    def output(self, states: np.ndarray, targets: np.ndarray, train: bool = False):
        """Natural log probability of every target given its state; gradients if training.

        Classes and members stand in rows, targets in columns, so that sums over the few run
        along the many; a last column of ones stands for what is added whatever the state.
        """
        w, hidden, n = self.weights, self.hidden, len(targets)
        wide = np.concatenate([states, np.ones((n, 1))], axis=1, dtype=self.kind)
        columns = np.arange(n)
        classes = self.class_of[targets]
        of_class = np.concatenate([w["class_w"], w["class_b"][None]]).T
        of_member = np.concatenate([w["member_w"], w["member_b"][:, None]], axis=1)
        e = of_class @ wide.T.copy()
        e -= e.max(axis=0)
        logp = e[classes, columns]
        np.exp(e, out=e)
        total = e.sum(axis=0)
        logp -= np.log(total)
        # Targets of one class side by side.
        order = _grouped(classes)
        cuts = np.append(0, np.cumsum(np.bincount(classes, minlength=len(self.edges) - 1)))
        runs = [(self.edges[k], self.edges[k + 1], slice(cuts[k], cuts[k + 1])) for k in np.flatnonzero(np.diff(cuts))]
        held = np.take(wide, order, axis=0)
        across = held.T.copy()
        f = np.full((int(np.diff(self.edges).max()), n), -1e30, self.kind)
        for a, b, run in runs:
            f[: b - a, run] = of_member[a:b] @ across[:, run]
        member = (targets - self.edges[classes])[order]
        f -= f.max(axis=0)
        inside = f[member, columns]
        np.exp(f, out=f)
        sums = f.sum(axis=0)
        logp[order] += inside - np.log(sums)
        if not train:
            return logp
        e /= total
        e[classes, columns] -= 1.0
        f /= sums
        f[member, columns] -= 1.0
        g = e @ wide
        grads = {"class_w": g[:, :hidden].T, "class_b": g[:, hidden]}
        grads["member_w"], grads["member_b"] = np.zeros_like(w["member_w"]), np.zeros_like(w["member_b"])
        behind = np.empty((hidden, n), self.kind)
        for a, b, run in runs:
            g = f[: b - a, run] @ held[run]
            grads["member_w"][a:b], grads["member_b"][a:b] = g[:, :hidden], g[:, hidden]
            behind[:, run] = w["member_w"][a:b].T @ f[: b - a, run]
        back = (w["class_w"] @ e).T.copy()
        back[order] += behind.T
        return logp, grads, back

    def learn(self, inputs: np.ndarray, targets: np.ndarray, real: np.ndarray, state: np.ndarray, end: int) -> np.ndarray:
        """One window of truncated backpropagation; (steps, streams) arrays.  Returns the state after it.

        Where the input is the end of a text, the state begins anew.
        """
        w, hidden = self.weights, self.hidden
        steps, streams = inputs.shape
        two = 2 * hidden
        x = self._inputs(inputs)
        half = 0.5 * w["gates"]
        goes_on = (inputs != end).astype(self.kind)[:, :, None]
        before, kept, fresh, states = (np.empty((steps, streams, hidden), self.kind) for _ in range(4))
        gates = np.empty((steps, streams, two), self.kind)
        for t in range(steps):
            np.multiply(state, goes_on[t], out=before[t])
            self._advance(x[t], before[t], half, gates[t], kept[t], fresh[t], states[t])
            state = states[t]
        seen = real.ravel()
        flat_states = states.reshape(-1, hidden)[seen]
        _, grads, back = self.output(flat_states, targets.ravel()[seen], train=True)
        errors = np.zeros((steps * streams, hidden), self.kind)
        errors[seen] = back
        errors = errors.reshape(steps, streams, hidden)
        update, reset = gates[:, :, :hidden], gates[:, :, hidden:]
        # What does not depend on the steps behind, for all steps at once.
        to_fresh = (1.0 - update) * (1.0 - fresh * fresh)
        to_update = (before - fresh) * update * (1.0 - update)
        to_reset = before * reset * (1.0 - reset)
        back_candidate, back_gates = w["candidate"].T.copy(), w["gates"].T.copy()
        d_state = np.zeros((streams, hidden), self.kind)
        d_inputs = np.empty((steps, streams, 3 * hidden), self.kind)
        for t in range(steps - 1, -1, -1):
            d, d_gates, d_fresh = errors[t], d_inputs[t, :, :two], d_inputs[t, :, two:]
            d += d_state
            np.multiply(d, to_fresh[t], out=d_fresh)
            d_kept = d_fresh @ back_candidate
            np.multiply(d, to_update[t], out=d_gates[:, :hidden])
            np.multiply(d_kept, to_reset[t], out=d_gates[:, hidden:])
            d *= update[t]
            d_kept *= reset[t]
            d += d_kept
            d += d_gates @ back_gates
            d *= goes_on[t]
            d_state = d
        flat_d = d_inputs.reshape(-1, 3 * hidden)
        grads["candidate"] = kept.reshape(-1, hidden).T @ flat_d[:, two:]
        grads["gates"] = before.reshape(-1, hidden).T @ flat_d[:, :two]
        flat = inputs.ravel()
        order = _grouped(flat)
        ordered = flat[order]
        at = np.append(0, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1)
        grads["inputs"] = np.zeros_like(w["inputs"])
        grads["inputs"][ordered[at]] = np.add.reduceat(np.take(flat_d, order, axis=0), at, axis=0)
        scale = 1.0 / max(1, len(flat_states))
        for name, g in grads.items():
            g = np.clip(g * scale, -1.0, 1.0)
            self.squares[name] += g * g
            w[name] -= RATE * g / np.sqrt(self.squares[name])
        return state

    def learn_texts(self, texts: list[np.ndarray], end: int) -> int:
        """Train on texts (symbols, each with its end), joined and cut into equal streams."""
        if not texts:
            return 0
        joined = self.place[np.concatenate(texts)]
        end = int(self.place[end])
        total = len(joined)
        streams = max(1, min(STREAMS, total // WINDOW))
        length = -(-total // streams)
        padded = np.full(streams * length, end, np.int64)
        padded[:total] = joined
        targets = padded.reshape(streams, length).T
        # A stream that begins inside a text sees the symbol before, with an empty state.
        inputs = np.concatenate([[end], padded[:-1]]).reshape(streams, length).T
        real = (np.arange(streams * length) < total).reshape(streams, length).T
        state = np.zeros((streams, self.hidden), self.kind)
        for t in range(0, length, WINDOW):
            cut = slice(t, t + WINDOW)
            state = self.learn(inputs[cut], targets[cut], real[cut], state, end)
        return total

    def scores(self, texts: list[np.ndarray], end: int, side_by_side: int = 1024) -> np.ndarray:
        """Log10 probability of each whole text, its state carried from window to window.

        Texts stand one behind the other in streams of about equal length, longest first, so a
        finished text gives its place to the next one; each begins with an empty state.
        """
        if not texts:
            return np.zeros(0)
        sizes = np.array([len(t) for t in texts])
        streams: list[list[int]] = [[] for _ in range(min(side_by_side, len(texts)))]
        loads = [(0, i) for i in range(len(streams))]
        for i in np.argsort(-sizes, kind="stable").tolist():
            load, k = loads[0]
            streams[k].append(i)
            heapq.heapreplace(loads, (load + int(sizes[i]), k))
        streams.sort(key=lambda mine: -sum(int(sizes[i]) for i in mine))
        placed = [i for mine in streams for i in mine]
        flat = self.place[np.concatenate([texts[i] for i in placed])]
        length = np.array([sum(int(sizes[i]) for i in mine) for mine in streams])
        begin = np.cumsum(length) - length
        end = self.place[end]
        before = np.concatenate([[end], flat[:-1]])
        logs = np.empty(len(flat))
        state = np.zeros((len(streams), self.hidden), self.kind)
        half = 0.5 * self.weights["gates"]
        for t in range(0, int(length[0]), WINDOW):
            live = int(np.searchsorted(-length, -t, side="left"))  # streams longer than t
            steps = int(min(WINDOW, length[0] - t))
            at = begin[:live] + t + np.arange(steps)[:, None]
            real = at < (begin + length)[:live]
            at = np.minimum(at, len(flat) - 1)
            inputs = before[at]
            x = self._inputs(inputs)
            goes_on = (inputs != end).astype(self.kind)[:, :, None]
            states = np.empty((steps, live, self.hidden), self.kind)
            kept, fresh = (np.empty((live, self.hidden), self.kind) for _ in range(2))
            gates, held = np.empty((live, 2 * self.hidden), self.kind), state[:live]
            for s in range(steps):
                self._advance(x[s], held * goes_on[s], half, gates, kept, fresh, states[s])
                held = states[s]
            state[:live] = held
            logs[at[real]] = self.output(states[real], flat[at[real]])
        out = np.empty(len(texts))
        ends = np.cumsum(sizes[placed])
        out[placed] = np.add.reduceat(logs, ends - sizes[placed])
        return out / np.log(10.0)


# -- training and scoring ---------------------------------------------------------------


def _add(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def trained(numbers: DataFrame, known: Vocabulary, sent: Broadcast, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after every text of ``numbers`` with a ``turn`` of 0 or more has been learned from once.

    Each round every task trains a copy of the model on the round's texts of its partition;
    the copies are averaged by the tokens they saw, in a tree on the executors, so the
    driver receives a few models of fixed size.
    """
    model = Network(known.symbol_counts()).flat()
    spark = numbers.sparkSession
    for turn in range(rounds):
        start = spark.sparkContext.broadcast(model)

        def run(batches: Iterable[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            one_thread()
            network = Network(sent.value.symbol_counts())
            network.load(start.value)
            seen = 0
            for batch in text_runs(batches, "symbols"):
                seen += network.learn_texts(_symbols(batch), sent.value.end)
            if seen:
                weights = network.flat().astype(np.float64) * seen
                yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([weights.tobytes()], pa.binary())], names=["seen", "weights"])

        mine = numbers.filter(F.col("turn") == turn).select("symbols")
        models = mine.mapInArrow(run, "seen bigint, weights binary").rdd.map(lambda r: (r["seen"], np.frombuffer(r["weights"])))
        nothing = (0, np.zeros(len(model)))
        seen, total = models.treeAggregate(nothing, _add, _add)
        if seen:
            model = (total / seen).astype(np.float32)
    return model


def _symbols(batch: pa.RecordBatch) -> list[np.ndarray]:
    column = batch.column(batch.schema.get_field_index("symbols"))
    return [np.frombuffer(x.as_buffer(), np.uint16) for x in column]


def numbered(texts: DataFrame, sent: Broadcast, rounds: int = ROUNDS) -> DataFrame:
    """One row per text (``doc_id``, ``text``): what counts alone give, and the text as symbols.

    Texts are cut into words here once; training and scoring read two bytes a token.
    ``turn`` is the round a text is learned in, -1 for those held out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_ = sent.value
        coder = Coder(known_)
        size, unseen = len(known_.words), known_.unseen
        log_c = np.log10(known_.counts + 0.1)
        shared = coder.symbols - known_.own
        within = np.zeros(size)
        tail = np.arange(size) >= known_.own
        within[tail] = np.log10((1 - unseen[shared[tail]]) * known_.counts[tail] / known_.shared_total[shared[tail]])
        row = TaskContext.get().partitionId() << 40
        for batch in text_runs(batches, "text"):
            numbers = coder.numbers(utf8_column(batch, "text"))
            every = coder.all_symbols().astype(np.uint16)
            n_tokens = np.array([len(n) + 1 for n in numbers], np.int64)
            ends_of = np.cumsum(n_tokens)
            # All texts in a row, each with its end; the end has the last number.
            last = np.array([len(every) - 1])
            flat = np.concatenate([x for n in numbers for x in (n, last)])
            symbols = pa.Array.from_buffers(
                pa.large_binary(), len(numbers), [None, pa.py_buffer(np.append(0, 2 * ends_of)), pa.py_buffer(every[flat])]
            ).cast(pa.binary())
            owner = np.repeat(np.arange(len(numbers)), n_tokens)
            here = flat < size
            own, who = flat[here], owner[here]
            score = np.bincount(who, weights=within[own], minlength=len(numbers)).astype(np.float64)
            base = np.bincount(who, weights=log_c[own], minlength=len(numbers)) + np.log10(known_.ends + 0.1)
            n_known = np.bincount(who, minlength=len(numbers)) + (known_.ends > 0)
            fresh = coder.ids.fresh
            other = ~here
            other[ends_of - 1] = False
            pairs, times = np.unique(owner[other] * max(1, len(fresh)) + flat[other] - size, return_counts=True)
            rest, ends = pairs % max(1, len(fresh)), np.searchsorted(pairs, np.arange(len(numbers) + 1) * max(1, len(fresh)))
            # Words outside the dictionary as columns: no Python object per word and text.
            at = pa.array(rest)
            kinds = pa.array(every[size:-1].astype(np.int32) - known_.own, pa.int32())
            fields = [pa.array(fresh, pa.binary()).take(at), kinds.take(at), pa.array(times.astype(np.int64))]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["word", "k", "times"]))
            ids = pa.array(np.arange(row, row + len(numbers)))
            row += len(numbers)
            whole = [ids, batch.column(0), batch.column(1), pa.array(n_tokens), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(
                [*whole, symbols, lists],
                names=["row", "doc_id", "turn", "n_tokens", "n_known", "base", "score", "symbols", "rest"],
            )
            coder.ids.forget()

    schema = (
        "row bigint, doc_id bigint, turn int, n_tokens bigint, n_known bigint, base double, score double, symbols binary, "
        "rest array<struct<word:binary,k:int,times:bigint>>"
    )
    deal = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(rounds)).cast("int")
    turn = F.when(held_out(F.col("doc_id")), F.lit(-1)).otherwise(deal)
    return texts.select("doc_id", turn.alias("turn"), "text").mapInArrow(run, schema)


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    One row per row of ``docs``.  Counts and training cover all texts that are not held out;
    every text is scored whole.  Words outside the dictionary that tasks hold are joined with
    their counts by document and word.  NULL and empty texts are the end token alone; with no
    training text the network is untrained and every word unseen; other columns are not
    read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    train = read.filter(~held_out(F.col("doc_id")))
    counts = stored(word_counts(train), "word_counts")
    known = vocabulary(counts, train.count())
    sent = spark.sparkContext.broadcast(known)
    numbers = stored(numbered(read, sent), "numbers")
    weights = spark.sparkContext.broadcast(trained(numbers, known, sent))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        network = Network(sent.value.symbol_counts())
        network.load(weights.value)
        for batch in text_runs(batches, "symbols"):
            told = network.scores(_symbols(batch), sent.value.end)
            whole = batch.drop_columns(["symbols", "score"])
            counted = np.asarray(batch.column(batch.schema.get_field_index("score")))
            yield whole.append_column("score", pa.array(counted + told))

    told = "row bigint, doc_id bigint, n_tokens bigint, n_known bigint, base double, score double"
    columns = ["row", "doc_id", "n_tokens", "n_known", "base", "symbols", "score"]
    parts = stored(numbers.select(*columns).mapInArrow(run, told), "scored")
    words = numbers.select("row", F.inline("rest"))
    by_word = words.join(counts.select("word", "c"), "word", "left")
    # Shares by shared symbol: few, and fixed in number.
    totals = np.maximum(known.shared_total, 1)
    seen_share = F.get(F.lit([float(x) for x in (1 - known.unseen) / totals]), F.col("k"))
    unseen_share = F.get(F.lit([float(x) for x in known.unseen]), F.col("k"))
    c = F.coalesce("c", F.lit(0))
    rest = by_word.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(F.lit(0))).alias("rest_known"),
        F.sum(F.col("times") * F.log10(c + 0.1)).alias("rest_base"),
        F.sum(F.col("times") * F.log10(F.when(c > 0, seen_share * c).otherwise(unseen_share))).alias("rest_score"),
    )
    zero = lambda name: F.coalesce(name, F.lit(0))
    return (
        parts.join(rest, "row", "left")
        .select(
            "doc_id",
            held_out(F.col("doc_id")).alias("held_out"),
            "n_tokens",
            (F.col("n_known") + zero("rest_known")).alias("n_known"),
            F.lit(known.total).cast("bigint").alias("train_tokens"),
            (F.col("base") + zero("rest_base") - F.col("n_tokens") * F.lit(known.base_norm())).alias("base_score"),
            (F.col("score") + zero("rest_score")).alias("score"),
        )
    )
