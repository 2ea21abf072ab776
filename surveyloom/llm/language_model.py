"""Log-likelihood of whole texts under a gated recurrent network with a class-factored softmax."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from surveyloom.llm.common import remainder
from surveyloom.session import cut_lineage

END = b""               # the token behind each text; no word is empty
CLASSES, MEMBERS = 32, 32          # head words: the most frequent ones, by count in classes of equal size
HEAD = CLASSES * MEMBERS
START = HEAD + 32       # what the network reads before the first token
TAIL = 32               # classes of all other words, by their last two bytes
KNOWN = 50_000          # frequent words whose counts travel with the model (a few MB); others are looked up by a join
HIDDEN = 24
WINDOW = 32             # steps of truncated backpropagation, and of scoring before the state is carried on
STREAMS, MOST_STREAMS, PASSES, RATE = 48, 256, 2, 0.02
SHARE = 1_000_000       # training tokens that make one more task worth while
PARTS = 8               # the training rows are dealt to so many parts, by a hash of the row
ROUNDS = ((0,), (1,), (2, 3), (4, 5), (6, 7))  # parts read between two averages of the tasks' networks; every part once
FLUSH = 300_000


def tokens_of(text: bytes | None) -> list[bytes]:
    words = (text or b"").lower().split()
    words.append(END)
    return words


def tail_class(word: bytes) -> int:
    return HEAD + zlib.crc32(word[-2:]) % TAIL


# -- corpus counts -----------------------------------------------------------

def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out():
        batch = pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["token", "c"])
        counts.clear()
        return batch
    for batch in batches:
        for text in batch.column(0):
            counts.update(tokens_of(text.as_py()))
            if len(counts) > FLUSH:
                yield out()
    yield out()


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over all training rows; each task sums its own words first."""
    training = docs.filter(remainder(F.col("doc_id"), 7) != 2).select(F.col("text").cast("binary"))
    return cut_lineage(training.mapInArrow(_counted, "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c")))


class Vocabulary:
    """Symbols of the network and what the corpus says of them."""

    def __init__(self, known: list[tuple[bytes, int]], total: int, distinct: int, tail: dict[int, tuple[int, int]]):
        self.total, self.distinct = total, distinct
        self.head = {w: k for k, (w, _) in enumerate(known[:HEAD])}
        self.symbol_counts = np.zeros(HEAD + TAIL)
        self.symbol_counts[:len(self.head)] = [c for _, c in known[:HEAD]]
        mass = np.zeros(TAIL)
        for k, (c, n) in tail.items():
            self.symbol_counts[k] = c
            mass[k - HEAD] = c + n
        #: log10 of the denominator of a tail word's share of its class: its count and 1, over all of them and an unseen one
        self.tail_norm = np.log10(mass + 1)
        self.logs = {w: float(np.log10(c + 1)) for w, c in known}

    def symbol(self, word: bytes) -> int:
        k = self.head.get(word)
        return tail_class(word) if k is None else k


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals are sums over all counted words. Only words of at least a certain count come
    to the driver, the least count (in eighths of a power of two) that leaves no more
    than ``KNOWN`` of them."""
    steps = counts.groupBy(F.floor(8 * F.log2("c")).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()  # some 500 rows at most
    least, room = None, KNOWN
    for r in sorted(steps, key=lambda r: -r["step"]):
        room -= r["n"]
        if room < 0:
            break
        least = r["step"]
    frequent = counts.filter(F.floor(8 * F.log2("c")) >= least).collect() if least is not None else []
    known = sorted(((bytes(r["token"]), r["c"]) for r in frequent), key=lambda w: (-w[1], w[0]))
    whole = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ending = F.expr("CASE WHEN length(token) > 2 THEN substring(token, length(token) - 1, 2) ELSE token END")
    classes = counts.groupBy((F.crc32(ending) % TAIL + HEAD).cast("int").alias("k")).agg(
        F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()  # TAIL rows
    tail = {r["k"]: [r["c"], r["n"]] for r in classes}
    for word, c in known[:HEAD]:  # head words are no tail words
        tail[tail_class(word)][0] -= c
        tail[tail_class(word)][1] -= 1
    return Vocabulary(known, whole["n"] or 0, whole["v"], {k: tuple(x) for k, x in tail.items()})


# -- network -----------------------------------------------------------------

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


class Network:
    """Gated recurrent units; p(symbol) = p(class) p(member | class). A tail class has one member."""

    def __init__(self, counts: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 0.1, shape)
        smooth = counts + 0.5
        by_class = np.concatenate((smooth[:HEAD].reshape(CLASSES, MEMBERS).sum(1), smooth[HEAD:]))
        self.p = {
            "x": normal(START + 1, 3 * HIDDEN), "u": normal(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN),
            "wc": np.zeros((HIDDEN, CLASSES + TAIL)), "bc": np.log(by_class / by_class.sum()),
            "wm": np.zeros((CLASSES, HIDDEN, MEMBERS)), "bm": np.log(smooth[:HEAD]).reshape(CLASSES, MEMBERS)}

    def step(self, gates: np.ndarray, h: np.ndarray):
        """The next state from the input's part of the gates and the state."""
        p, n = self.p, HIDDEN
        own = h @ p["u"]
        zr = _sigmoid(gates[:, :2 * n] + own[:, :2 * n])
        z, r = zr[:, :n], zr[:, n:]
        new = np.tanh(gates[:, 2 * n:] + r * own[:, 2 * n:])
        return new + z * (h - new), (z, r, new, own[:, 2 * n:])

    def log_likelihood(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log of each target symbol's probability; members are grouped by class."""
        p = self.p
        kind = np.where(targets < HEAD, targets // MEMBERS, targets - HEAD + CLASSES)
        out = _log_softmax(states @ p["wc"] + p["bc"])[np.arange(len(targets)), kind]
        order = np.argsort(kind, kind="stable")
        for c, at in _runs(kind, order):
            if c < CLASSES:
                member = _log_softmax(states[at] @ p["wm"][c] + p["bm"][c])
                out[at] += member[np.arange(len(at)), targets[at] % MEMBERS]
        return out

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray):
        """Gradients of the mean negative log-likelihood over one window of all
        streams (time first), the state behind it, and the loss. ``fresh`` marks
        steps that start a text, where the state is zero."""
        p, n, steps, streams = self.p, HIDDEN, *inputs.shape
        kept, states = [], np.empty((steps, streams, n), h.dtype)
        for t in range(steps):
            h = np.where(fresh[t][:, None], h.dtype.type(0), h)
            before = h
            h, parts = self.step(p["x"][inputs[t]] + p["b"], h)
            kept.append((before, *parts))
            states[t] = h
        flat, want = states.reshape(-1, n), targets.ravel()
        g = {k: np.zeros_like(v) for k, v in p.items()}
        kind = np.where(want < HEAD, want // MEMBERS, want - HEAD + CLASSES)
        logs = _log_softmax(flat @ p["wc"] + p["bc"])
        loss = -logs[np.arange(len(want)), kind].sum()
        d = np.exp(logs)
        d[np.arange(len(want)), kind] -= 1
        g["wc"], g["bc"] = flat.T @ d, d.sum(0)
        dh_out = d @ p["wc"].T
        for c, at in _runs(kind, np.argsort(kind, kind="stable")):
            if c < CLASSES:
                logs = _log_softmax(flat[at] @ p["wm"][c] + p["bm"][c])
                rows = np.arange(len(at))
                loss -= logs[rows, want[at] % MEMBERS].sum()
                d = np.exp(logs)
                d[rows, want[at] % MEMBERS] -= 1
                g["wm"][c], g["bm"][c] = flat[at].T @ d, d.sum(0)
                dh_out[at] += d @ p["wm"][c].T
        dh_out = dh_out.reshape(steps, streams, n)
        dh, dgates = np.zeros((streams, n), h.dtype), np.empty((steps, streams, 3 * n), h.dtype)
        for t in range(steps - 1, -1, -1):
            before, z, r, new, own = kept[t]
            dh = dh + dh_out[t]
            dnew = dh * (1 - z) * (1 - new**2)
            dz = dh * (before - new) * z * (1 - z)
            dr = dnew * own * r * (1 - r)
            dgates[t] = np.concatenate((dz, dr, dnew), 1)
            down = np.concatenate((dz, dr, dnew * r), 1)
            g["u"] += before.T @ down
            dh = np.where(fresh[t][:, None], h.dtype.type(0), dh * z + down @ p["u"].T)
        read = inputs.ravel()
        order = np.argsort(read, kind="stable")
        firsts = np.flatnonzero(np.diff(read[order], prepend=-1))
        g["x"][read[order][firsts]] = np.add.reduceat(dgates.reshape(-1, 3 * n)[order], firsts)
        g["b"] = dgates.sum((0, 1))
        return {k: v / want.size for k, v in g.items()}, h, loss / want.size


def _runs(kind: np.ndarray, order: np.ndarray):
    """(value, indices) of each run of equal values along ``order``."""
    sorted_kind = kind[order]
    cuts = np.flatnonzero(np.diff(sorted_kind)) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(kind[at[0]]), at


class Fitting:
    """A network with Adam's moments, and their common form as one vector, which can be averaged."""

    def __init__(self, network: Network, state: bytes | None = None, updates: int = 0):
        self.network, self.updates = network, updates
        self.first = {k: np.zeros_like(v) for k, v in network.p.items()}
        self.second = {k: np.zeros_like(v) for k, v in network.p.items()}
        if state is not None:
            flat, at = np.frombuffer(state, "<f4"), 0
            for values in (network.p, self.first, self.second):
                for k, v in values.items():
                    values[k] = flat[at:at + v.size].reshape(v.shape).copy()
                    at += v.size

    def state(self) -> bytes:
        return np.concatenate([v.ravel() for x in (self.network.p, self.first, self.second) for v in x.values()]).astype("<f4").tobytes()

    def update(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.updates += 1
        rate *= float(np.sqrt(1 - 0.999**self.updates) / (1 - 0.9**self.updates))
        for k, v in g.items():
            self.first[k] += 0.1 * (v - self.first[k])
            self.second[k] += 0.001 * (v * v - self.second[k])
            self.network.p[k] -= rate * self.first[k] / (np.sqrt(self.second[k]) + 1e-8)

    def learn(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, streams: int, rate: float) -> list[float]:
        """Truncated backpropagation over tokens laid out in parallel streams; what does not
        fill them follows as one stream, so no token is left out. Windows smaller
        than usual move the network less."""
        streams = max(1, min(streams, len(targets) // WINDOW))
        steps = len(targets) // streams
        cut = lambda x: x[:streams * steps].reshape(streams, steps).T
        x, y, f = cut(inputs), cut(targets), cut(fresh)
        h, losses = np.zeros((streams, HIDDEN), self.network.p["u"].dtype), []
        for at in range(0, steps, WINDOW):
            g, h, loss = self.network.gradients(x[at:at + WINDOW], y[at:at + WINDOW], f[at:at + WINDOW], h)
            losses.append(float(loss))
            self.update(g, rate * min(1.0, y[at:at + WINDOW].size / (STREAMS * WINDOW)))
        rest = streams * steps
        return losses + (self.learn(inputs[rest:], targets[rest:], fresh[rest:], 1, rate) if rest < len(targets) else [])


def _chunks(texts: Iterable[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(inputs, targets, fresh) of all tokens of the texts end to end, ``size`` at a time;
    a text may go on in the next chunk."""
    held, starts, n, last = [], [], 0, START

    def out(size):
        nonlocal held, starts, n, last
        flat, fresh = np.concatenate(held), np.concatenate(starts)
        held, starts, n = [flat[size:]], [fresh[size:]], max(0, len(flat) - size)
        flat, fresh = flat[:size].astype(np.int64), fresh[:size]
        inputs = np.where(fresh, START, np.concatenate(([last], flat[:-1])))
        last = flat[-1]
        return inputs, flat, fresh
    for text in texts:
        held.append(text)
        starts.append(np.arange(len(text)) == 0)
        n += len(text)
        while n >= size:
            yield out(size)
    if n:
        yield out(n)


def _passed(fitting: Fitting, texts: Iterable[np.ndarray], streams: int, begin: float, end: float, total: float) -> tuple[int, list[float]]:
    """One pass over the texts while training as a whole goes from ``begin`` to ``end`` (0 to 1)
    of its way; ``total`` tokens are expected. (tokens, loss of every window)."""
    read, losses = 0, []
    for inputs, targets, fresh in _chunks(texts, streams * WINDOW * 16):
        way = begin + (end - begin) * min(1.0, (read + len(targets) / 2) / max(total, 1))
        losses += fitting.learn(inputs, targets, fresh, streams, RATE / (1 + 4 * way))
        read += len(targets)
    return read, losses


def train(network: Network, texts: list[np.ndarray], passes: int = PASSES) -> list[float]:
    """Fits the network on whole texts of symbols, by truncated backpropagation with
    Adam. Returns the loss of every window."""
    fitting, total = Fitting(network), sum(map(len, texts))
    return [x for turn in range(passes) for x in _passed(fitting, texts, STREAMS, turn / passes, (turn + 1) / passes, total)[1]]


def _symbols(batches: Iterator[pa.RecordBatch], words: Vocabulary) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array([np.array(
            [words.symbol(w) for w in tokens_of(t.as_py())], "<u2").tobytes() for t in batch.column("text")], pa.binary())], ["hash", "symbols"])


def _fitted(batches: Iterator[pa.RecordBatch], counts: np.ndarray, state: bytes | None, updates: int,
            begin: float, end: float, share: float) -> Iterator[pa.RecordBatch]:
    """The state behind this task's rows, weighed by their tokens; a chunk of tokens is held at a time."""
    network = Network(counts)
    network.p = {k: v.astype(np.float32) for k, v in network.p.items()}
    fitting = Fitting(network, state, updates)
    streams = int(min(max(share // (1000 * WINDOW), STREAMS), MOST_STREAMS))
    texts = (np.frombuffer(s.as_py(), "<u2") for b in batches for s in b.column("symbols"))
    tokens = _passed(fitting, texts, streams, begin, end, share)[0]
    if tokens:
        yield _states(tokens, fitting.updates, fitting.state())


def _states(tokens: int, updates: int, state: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([tokens], pa.int64()), pa.array([updates], pa.int64()), pa.array([state], pa.binary())], ["tokens", "updates", "state"])


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of the states by their tokens, added up one by one in the order they are sorted in."""
    total, updates, mean = 0, 0, 0.0
    for batch in batches:
        for tokens, n, state in zip(*(batch.column(k) for k in range(3))):
            total, updates = total + tokens.as_py(), max(updates, n.as_py())
            mean = mean + tokens.as_py() * np.frombuffer(state.as_py(), "<f4").astype(float)
    if total:
        yield _states(total, updates, (mean / total).astype("<f4").tobytes())


def fit(docs: DataFrame, words: Vocabulary) -> Network:
    """The network, trained once on every token of all training rows, by one rule at every size.

    Rows go to parts and tasks by a hash of id and text, and a task reads its rows in the
    order of that hash, so neither the order nor the files of the input matter. Each
    task fits its own rows from the common state; the tasks' states (about 1 MB each)
    are averaged by their tokens, first in groups and then over the groups, and the
    next round goes on from there. The tasks grow with the input. Copies of a text with
    ids of their own spread over tasks; only rows equal in both share one."""
    training = docs.filter(remainder(F.col("doc_id"), 7) != 2).select(
        F.xxhash64("doc_id", "text").alias("hash"), F.col("text").cast("binary").alias("text"))
    symbols = cut_lineage(training.mapInArrow(lambda it: _symbols(it, words), "hash bigint, symbols binary"))
    counts, form = words.symbol_counts, "tokens bigint, updates bigint, state binary"
    tasks = max(1, words.total // SHARE)
    state, updates, done, read = None, 0, 0, 0
    for parts in ROUNDS:
        begin, end = done / PARTS, (done + len(parts)) / PARTS
        rows = symbols.filter(F.pmod("hash", F.lit(PARTS)).isin(list(parts))).withColumn("_task", F.xxhash64("hash"))
        rows = rows.repartition(tasks, "_task").sortWithinPartitions("hash", "symbols").select("symbols")
        share = words.total * len(parts) / PARTS / tasks
        task = partial(_fitted, counts=counts, state=state, updates=updates, begin=begin, end=end, share=share)
        order = ["tokens", F.crc32("state"), "state"]
        states = rows.mapInArrow(task, form)
        if tasks > 1:
            groups = int(np.ceil(np.sqrt(tasks)))
            states = states.repartition(groups, F.crc32("state")).sortWithinPartitions(*order).mapInArrow(_averaged, form)
        found = states.repartition(1).sortWithinPartitions(*order).mapInArrow(_averaged, form).collect()  # one row, or none
        if found:
            state, updates = bytes(found[0]["state"]), found[0]["updates"]
            read += found[0]["tokens"]
        done += len(parts)
    network = Network(counts)
    network.p = {k: v.astype(np.float32) for k, v in network.p.items()}
    network = Fitting(network, state).network
    network.read = read  # tokens it learned from
    return network


# -- scoring -----------------------------------------------------------------

def _text_scores(network: Network, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of the symbols of every text. All texts of the batch advance
    together; each carries its state from window to window until its end."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    sizes = np.array([len(texts[i]) for i in order])
    out = np.zeros(len(texts))
    gates_of = (network.p["x"] + network.p["b"]).astype(np.float32)
    h = np.zeros((len(texts), HIDDEN), np.float32)
    for start in range(0, sizes[0] if len(sizes) else 0, WINDOW):
        live = int(np.searchsorted(-sizes, -start, side="left"))  # texts longer than start
        width = min(WINDOW, sizes[0] - start)
        window = np.zeros((live, width + 1), np.int64)  # the symbol before the window, then the window
        for i in range(live):
            part = texts[order[i]][max(start - 1, 0):start + width]
            window[i, 1 if start == 0 else 0:][:len(part)] = part
        window[:, 0] = window[:, 0] if start else START
        left = np.minimum(sizes[:live] - start, width)
        states = np.empty((width, live, HIDDEN), np.float32)
        now = h[:live]
        for t in range(width):
            active = int(np.searchsorted(-left, -t, side="left"))
            now = now[:active]
            now, _ = network.step(gates_of[window[:active, t]], now)
            states[t, :active] = now
            h[:active] = now
        valid = np.arange(width)[:, None] < left[None, :]
        logs = network.log_likelihood(states[valid], window[:, 1:].T[valid])
        sums = np.zeros((width, live))
        sums[valid] = logs
        out[order[:live]] += sums.sum(0)
    return out / np.log(10)


def _scored(batches: Iterator[pa.RecordBatch], words: Vocabulary, network: Network) -> Iterator[pa.RecordBatch]:
    logs, known_symbol = words.logs, {w: words.symbol(w) for w in words.logs}
    rare = pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())]))
    for batch in batches:
        for begin in range(0, batch.num_rows, 2000):
            part = batch.slice(begin, 2000)
            texts, sizes, bases, known, tails, others = [], [], [], [], [], []
            for text in part.column("text"):
                tokens = tokens_of(text.as_py())
                counted = Counter(tokens)
                own, base, tail, other = {}, 0.0, 0.0, []
                n_known = 0
                for w, n in counted.items():
                    s, value = known_symbol.get(w), logs.get(w)
                    if s is None:
                        s = tail_class(w)
                        other.append({"token": w, "n": n})
                    else:
                        base += n * value
                        n_known += n
                        if s >= HEAD:
                            tail += n * value
                    if s >= HEAD:
                        tail -= n * words.tail_norm[s - HEAD]
                    own[w] = s
                texts.append(np.fromiter(map(own.__getitem__, tokens), np.int64, len(tokens)))
                sizes.append(len(tokens))
                bases.append(base)
                known.append(n_known)
                tails.append(float(tail))
                others.append(other)
            score = _text_scores(network, texts) + np.array(tails)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(bases, pa.float64()),
                 pa.array(score), pa.array(others, rare)], ["doc_id", "n_tokens", "n_known", "base", "score", "rare"])


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    A text's probability is that of its symbols under the network, times each tail
    word's share (c + 1) of its class. Counts of frequent words travel with the model;
    the rare words of a text are joined to the corpus counts, folded per text first.
    Null and empty texts are their end alone; a null doc_id counts as training;
    repeated rows are scored each. An empty table gives an empty result."""
    counts = corpus_counts(docs)
    words = vocabulary(counts)
    network = fit(docs, words)
    shared = docs.sparkSession.sparkContext.broadcast((words, network))
    kind = docs.schema["doc_id"].dataType.simpleString()
    at = cut_lineage(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        lambda it: _scored(it, *shared.value), f"doc_id {kind}, n_tokens bigint, n_known bigint, base double, score double, "
        "rare array<struct<token:binary,n:bigint>>").withColumn("_row", F.monotonically_increasing_id()))
    rare = at.select("_row", F.explode("rare").alias("r")).select("_row", "r.token", "r.n")
    # only words beyond the frequent ones can meet here, so no key is hot
    met = rare.join(counts.hint("shuffle_hash"), "token").groupBy("_row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("_logs"), F.sum("n").alias("_known"))
    logs = F.coalesce("_logs", F.lit(0.0))
    unit = float(np.log10(words.total + words.distinct + 1))
    return at.drop("rare").join(met, "_row", "left").select(
        "doc_id", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(words.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * unit).alias("base_score"), (F.col("score") + logs).alias("score"))
