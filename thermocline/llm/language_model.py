"""LM scoring: a gated recurrent model with a class-factored softmax, trained by truncated backpropagation."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import durable
from .common import remainder, table, text_key

FOLDS = 10
SMOOTHING = 0.1
HOT_WORDS = 200_000  # words whose counts travel to the tasks; the rest meet theirs in a join
VOCABULARY = HOT_WORDS + 1  # words with an output of their own at most, the end of a text among them: all that travel
HIDDEN = 16
WINDOW_TOKENS = 32_768  # a window has about as many tokens, and so more steps when few lanes are left,
SHORTEST, LONGEST = 16, 512  # but in training, where it also truncates backpropagation, between so many steps
LANES = 512  # texts processed side by side
PART = 16  # neighbouring words of a class, of which one softmax tells one from the others
STACKED = 4  # runs of rows are stacked with others of about their length, those up to so long with each other
GROUP_TOKENS = 1_500_000  # tokens gathered before they are laid out in lanes
ROUNDS = 2  # averagings in the one pass over the training texts
FIRST_RATE, RATE, WARM = 0.08, 0.25, 16  # the rate of Adagrad rises over so many windows: its first steps are the largest
PASSES, LEAST_WINDOW = 64, 4_096  # few texts are cut into more windows in training, of so many tokens at least
FLAT = np.float32(1e-8)  # squared gradients far below it bring small steps
FLUSH = 200_000  # different words a task counts before it hands them on
BLOCK = 8_192  # parameters averaged by one group
HANDED_ON = 256  # such blocks in a batch
TOGETHER = 512  # runs of such rows in one product
CACHED = 65_536  # parameters updated, or logits computed, at a time
SEED = 5
STEEPEST = np.float32(60)  # no logit is above it; shares are normalised, so sums stay finite without looking for the largest
END = ""  # stands for the end of a text; no word is empty


def tokens(text: str | None) -> list[bytes]:
    """Words between white space, A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "replace").lower().split()


def _strings(words: Iterable[bytes]) -> pa.Array:
    return pa.array(list(words), pa.binary()).cast(pa.string())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words, the end counted once per text."""
    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_strings(counts), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    counts = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts.update(tokens(text))
            counts[END.encode()] += 1
            if len(counts) > FLUSH:
                yield rows(counts)
                counts = Counter()
    if counts:
        yield rows(counts)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts, the end among them as the empty word."""
    return texts.select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """The frequent words in order of their counts, and totals over all training tokens."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    outputs: int  # the first so many words have outputs of their own

    @property
    def edges(self) -> np.ndarray:
        """Where the classes of words with outputs start, and the end.  A word of share p is in a class of about 1 / sqrt(p)
        words, which makes the sum of the number of classes and of the expected size of a word's class smallest."""
        share = (self.counts[:self.outputs] + SMOOTHING) / max(self.counts[:self.outputs].sum() + self.rare_total, SMOOTHING)
        before = np.cumsum(np.append(0.0, np.sqrt(np.minimum(share, 1.0))[:-1])).astype(np.int64)
        return np.append(np.flatnonzero(np.diff(before, prepend=-1)), self.outputs)

    @property
    def rare_total(self) -> float:
        """Denominator of the smoothed shares of the words without an output."""
        rest = self.distinct - int((self.counts[:self.outputs] > 0).sum())
        return float(self.total - self.counts[:self.outputs].sum()) + SMOOTHING * (rest + 1)


def vocabulary(counts: DataFrame, hot: int = HOT_WORDS, outputs: int = VOCABULARY) -> Vocabulary:
    """The frequent words, at most ``hot`` of them, cut at a count so that words as frequent as each other stay together."""
    level = F.floor(F.log2("c") * 8)
    levels = counts.agg(F.sum("c").alias("total"), F.count("*").alias("distinct")).first()
    steps = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, kept = math.inf, 0
    for step, n in steps:  # some hundred levels at most
        if kept + n > hot:
            break
        least, kept = step, kept + n
    frequent = counts.filter((level >= least) & (F.col("word") != END)).collect() if kept else []
    ends = counts.filter(F.col("word") == END).first()
    rows = sorted(((r["c"], r["word"]) for r in frequent), key=lambda r: (-r[0], r[1]))
    rows = [(ends["c"] if ends else 0, END), *rows]
    return Vocabulary([w.encode() for _, w in rows], np.array([c for c, _ in rows], dtype=np.int64),
                      levels["total"] or 0, levels["distinct"] or 0, min(outputs, len(rows)))


def _order(words: np.ndarray) -> np.ndarray:
    """Positions of ``words`` in ascending order, of equal ones in theirs: whole numbers sort faster than positions by them."""
    keys = words.astype(np.int64) << 32 | np.arange(len(words))
    keys.sort()
    return keys & 0xFFFFFFFF


def _levels(s, w, visits, picked, scale=None):
    """Log probabilities of chosen rows of ``w`` among their neighbours, each in a softmax of products with rows of ``s``.

    A visit (start, stop, low, high) takes rows from ``start`` up to ``stop`` of ``s`` and from ``low`` up to ``high`` of ``w``;
    ``picked`` holds the chosen row of ``w`` for each row of ``s`` in each visit.  Returned is the sum by row of ``s``, and with
    ``scale`` also the gradients of -scale times the sum of all: by ``s`` and by ``w``.
    """
    counts, widths = np.array([v[1] - v[0] for v in visits]), np.array([v[3] - v[2] for v in visits])
    ends = np.cumsum(counts * widths)
    products = np.empty(int(ends[-1]), np.result_type(s, w))
    views = [products[end - m * n:end].reshape(m, n) for end, m, n in zip(ends.tolist(), counts.tolist(), widths.tolist())]
    for e, (start, stop, low, high) in zip(views, visits):
        np.matmul(s[start:stop], w[low:high].T, out=e)
    np.minimum(products, STEEPEST, out=products)
    width = np.repeat(widths, counts)
    first = np.cumsum(width) - width
    chosen = first + picked - np.repeat([v[2] for v in visits], counts)
    log = products[chosen]
    np.exp(products, out=products)
    total, last = np.empty(len(log), products.dtype), np.cumsum(counts).tolist()
    ones = np.ones(widths.max(), products.dtype)
    for e, m, n in zip(views, counts.tolist(), last):
        np.matmul(e, ones[:e.shape[1]], out=total[n - m:n])
    log -= np.log(total)
    rows = np.arange(counts.sum()) + np.repeat([v[0] for v in visits] - np.cumsum(counts) + counts, counts)
    found = np.bincount(rows, weights=log, minlength=len(s))
    if scale is None:
        return found, None, None
    products *= np.repeat(scale / total, width)
    products[chosen] -= scale
    by_s, by_w = np.zeros_like(s), np.zeros_like(w)
    for e, (start, stop, low, high) in zip(views, visits):
        by_s[start:stop] += e @ w[low:high]
        np.matmul(e.T, s[start:stop], out=by_w[low:high])
    return found, by_s, by_w


def _stacks(starts: np.ndarray, size: int):
    """Runs of neighbours among ``size`` rows, given where each starts, by their lengths: (runs, places, real, rows).

    ``places`` (runs, longest) are row numbers, ``real`` the flat ones among them that belong to the run, ``rows`` their rows.
    """
    counts = np.diff(np.append(starts, size))
    level = np.ceil(np.log2(np.maximum(counts / STACKED, 1)))
    for at in np.unique(level):
        alike = np.flatnonzero(level == at)
        for i in range(0, len(alike), TOGETHER):
            runs = alike[i:i + TOGETHER]
            along = np.arange(counts[runs].max())
            places = starts[runs][:, None] + along
            real = np.flatnonzero(along < counts[runs][:, None])
            rows = places.reshape(-1)[real]
            yield runs, np.minimum(places, size - 1), real, rows


def _sums(values: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over runs of rows that are neighbours in ``order``."""
    found = np.empty((len(starts), values.shape[1]), values.dtype)
    for runs, places, real, rows in _stacks(starts, len(values)):
        stacked = np.zeros((places.size, values.shape[1]), values.dtype)
        stacked[real] = values[order[rows]]
        found[runs] = np.ones(places.shape[1], values.dtype) @ stacked.reshape(*places.shape, -1)
    return found


def _runs(a: np.ndarray) -> np.ndarray:
    """A view of ``a``: from each row on, PART rows."""
    return np.lib.stride_tricks.as_strided(a, (max(len(a) - PART + 1, 0), PART, *a.shape[1:]), (a.strides[0], *a.strides))


def _leaves(s, w, b, words, first, size, scale=None):
    """Log probabilities of ``words`` in their parts: ``size`` rows of ``w`` from ``first`` on, given for each row of ``s``.

    Rows of the same part are neighbours.  Parts met about as often are one product of stacks.  With ``scale`` also the gradient
    by ``s``, and as (rows, by ``w``, by ``b``) those of the parts met: whole parts by their first rows, others row by row.
    """
    starts = np.flatnonzero(np.diff(first, prepend=-1))
    found, by_s, pieces = np.empty(len(s), s.dtype), np.zeros_like(s) if scale is not None else None, []
    whole, among = size[starts] == PART, words - first
    ends = np.append(starts, len(s))
    for kind in (True, False):
        mine = np.flatnonzero(whole == kind)
        if not len(mine):
            continue
        counts = ends[mine + 1] - ends[mine]
        own = np.repeat(ends[mine] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        for runs, places, real, rows in _stacks(np.cumsum(counts) - counts, len(own)):
            places, rows, begin = own[places], own[rows], first[starts[mine[runs]]]
            stacked = s[places]
            if kind:
                weights, bias = _runs(w)[begin], _runs(b)[begin]
            else:
                inside = np.arange(PART) < size[starts[mine[runs]]][:, None]
                all_rows = np.where(inside, begin[:, None] + np.arange(PART), begin[:, None])
                weights, bias = w[all_rows], np.where(inside, b[all_rows], -np.inf).astype(b.dtype)
            e = stacked @ weights.transpose(0, 2, 1)
            e += bias[:, None, :]
            np.minimum(e, STEEPEST, out=e)
            flat = e.reshape(-1, PART)
            chosen = real * PART + among[rows]
            log = flat.reshape(-1)[chosen]
            np.exp(e, out=e)
            total = (flat @ np.ones(PART, e.dtype))[real]
            found[rows] = log - np.log(total)
            if scale is None:
                continue
            share = np.zeros(len(flat), e.dtype)
            share[real] = scale / total
            flat *= share[:, None]
            flat.reshape(-1)[chosen] -= scale
            by_s[rows] = (e @ weights).reshape(-1, s.shape[1])[real]
            by_w, by_b = e.transpose(0, 2, 1) @ stacked, np.ones(e.shape[1], e.dtype) @ e
            pieces.append((begin, by_w, by_b) if kind else (all_rows[inside], by_w[inside], by_b[inside]))
    return found, by_s, pieces


def group_edges(classes: int) -> np.ndarray:
    """Where the groups of classes start, and the end."""
    size = math.ceil(math.sqrt(classes))
    return np.append(np.arange(0, classes, size), classes)


def part_edges(edges: np.ndarray) -> np.ndarray:
    """Where the parts of classes start, and the end: every PART words from the start of a class on."""
    sizes = np.diff(edges)
    parts = -(-sizes // PART)
    place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.append(np.repeat(edges[:-1], parts) + place * PART, edges[-1])


def _begins(fresh: np.ndarray) -> list[np.ndarray]:
    """For each step the lanes in which a text begins."""
    steps, begins = np.nonzero(fresh)
    return np.split(begins, np.searchsorted(steps, np.arange(1, len(fresh))))


class Network:
    """Gated recurrent units over word inputs; group of classes of the next word, class in its group, part of its class, word in its part.

    Class c holds the words from ``edges[c]`` up to ``edges[c + 1]``; the class after the last stands for all words without
    an output.  Groups are neighbouring classes, about as many as a group has; parts are neighbouring words of a class.  As
    inputs are single words, the product of embedding and input weights is one row of ``table`` per word.
    """

    inner = ("group_w", "group_b", "class_w", "class_b", "part_w", "part_b")

    def __init__(self, edges: np.ndarray, arrays: dict[str, np.ndarray]):
        self.edges, self.outputs, self.classes = edges, int(edges[-1]), len(edges) - 1
        self.class_of = np.repeat(np.arange(len(edges), dtype=np.int16), np.append(np.diff(edges), 1))
        self.groups = group_edges(len(edges))
        self.group_of = np.repeat(np.arange(len(self.groups) - 1), np.diff(self.groups))
        self.parts = part_edges(edges)
        self.part_of = np.repeat(np.arange(len(self.parts) - 1, dtype=np.int32), np.diff(self.parts))
        self.class_parts = np.searchsorted(self.parts, edges)  # the first part of each class, and the number of parts
        self.p = arrays
        self.moved = np.zeros(0, np.float16)  # what training has added to the initial parameters, in their order

    @classmethod
    def initial(cls, v: Vocabulary, hidden: int = HIDDEN) -> Network:
        """Small random weights and biases that state the counts: before training the model is the smoothed unigram."""
        rng, edges = np.random.default_rng(SEED), v.edges
        share, sizes = v.counts[:v.outputs] + SMOOTHING, np.diff(edges)
        sums = np.append(np.add.reduceat(share, edges[:-1]), v.rare_total)
        parts = part_edges(edges)
        of_part = np.add.reduceat(share, parts[:-1])
        within = np.log(share / np.repeat(of_part, np.diff(parts)))
        in_class = np.log(of_part / np.repeat(sums[:-1], -(-sizes // PART)))
        sums, groups = np.maximum(sums, SMOOTHING), group_edges(len(edges))
        of_group = np.add.reduceat(sums, groups[:-1])
        of_class = np.log(sums / np.repeat(of_group, np.diff(groups)))

        def draw(*shape: int) -> np.ndarray:
            drawn = rng.standard_normal(shape, np.float32)
            drawn *= np.float32(0.1)
            return drawn

        return cls(edges, {
            "table": draw(v.outputs + 1, 3 * hidden), "gates": draw(hidden, 2 * hidden), "new": draw(hidden, hidden),
            "group_w": np.zeros((len(groups) - 1, hidden), np.float32), "group_b": np.log(of_group / of_group.sum()).astype(np.float32),
            "class_w": np.zeros((len(edges), hidden), np.float32), "class_b": of_class.astype(np.float32),
            "part_w": np.zeros((len(of_part), hidden), np.float32), "part_b": in_class.astype(np.float32),
            "word_w": np.zeros((v.outputs, hidden), np.float32), "word_b": within.astype(np.float32)})

    @classmethod
    def restored(cls, v: Vocabulary, moved: np.ndarray) -> Network:
        """The initial network after training has added ``moved``: half the size to send, and nothing before training."""
        net, at = cls.initial(v), 0
        net.moved = moved
        for k, a in net.p.items() if len(moved) else ():
            a += moved[at:at + a.size].reshape(a.shape)
            at += a.size
        return net

    @property
    def recurrent(self) -> np.ndarray:
        """Weights of the update gate, the reset gate and the new state, one matrix each."""
        n = len(self.p["new"])
        return np.stack([self.p["gates"][:, :n], self.p["gates"][:, n:], self.p["new"]])

    def run(self, inputs, fresh, h, keep=None):
        """Hidden states (steps, lanes, hidden) after reading ``inputs``; ``fresh`` marks the first word of a text.

        ``keep`` gets for each step the state before it, the two gates, the product behind the reset gate and the new state.
        """
        (steps, width), n, weights = inputs.shape, h.shape[1], self.recurrent
        weights[:2] *= -1  # the gates are 1 / (1 + exp(-x))
        table, begins, kind = self.p["table"], _begins(fresh), self.p["table"].dtype
        row = np.empty((3, width, n), kind)
        states, parts = np.empty((steps, width, n), kind), np.empty((steps if keep is not None else 1, 5, width, n), kind)
        for t in range(steps):
            part = parts[t if keep is not None else 0]
            before, gates, past, new = part[0], part[1:3], part[3], part[4]
            row[...] = table[inputs[t]].reshape(width, 3, n).transpose(1, 0, 2)
            before[...] = h
            before[begins[t]] = 0
            np.matmul(before, weights[:2], out=gates)
            np.matmul(before, weights[2], out=past)
            gates -= row[:2]
            np.exp(gates, out=gates)
            gates += 1
            np.divide(1, gates, out=gates)
            np.multiply(gates[1], past, out=new)
            new += row[2]
            np.tanh(new, out=new)
            h = np.subtract(before, new, out=states[t])
            h *= gates[0]
            h += new
        if keep is not None:
            keep.append(parts)
        return states, h.copy()

    def log_probabilities(self, states, targets, grad=None, scale=1.0, learn=None):
        """Natural log probability of each target (up to the share among words without an output).

        With ``grad`` its entries for the output weights are filled with the gradients of -scale times the sum, and that by the
        states is returned too.  ``learn`` is called with the name, place and gradient of each piece of the output weights
        instead, as soon as the piece is done with; classes that no target is in have no gradient.
        """
        p, learning, scale = self.p, grad is not None or learn is not None, np.float32(scale)
        order = _order(targets)  # so that the targets of a part, a class and a group are neighbours
        s, words = states[order], targets[order]
        classes = self.class_of[np.minimum(words, self.outputs)].astype(np.int64)
        ends = np.searchsorted(classes, np.arange(self.classes + 2)).tolist()
        if not len(s):
            if grad is not None:
                grad.update((k, np.zeros_like(p[k])) for k in (*self.inner, "word_w", "word_b"))
            return np.zeros(0, np.result_type(states, np.float32)), np.zeros_like(s) if learning else None
        # The upper levels stand below each other in one matrix, with their biases as a column that meets ones.
        upper = [np.column_stack([p[w], p[b]]) for w, b in zip(self.inner[::2], self.inner[1::2])]
        below = np.cumsum([0, *map(len, upper)]).tolist()
        visits, picked = [(0, len(s), 0, below[1])], [self.group_of[classes]]
        for low, high in zip(self.groups[:-1].tolist(), self.groups[1:].tolist()):
            if ends[high] > ends[low] and high - low > 1:
                visits.append((ends[low], ends[high], below[1] + low, below[1] + high))
                picked.append(below[1] + classes[ends[low]:ends[high]])
        own = ends[self.classes]  # so many have an output of their own
        parts, first = self.part_of[words[:own]].astype(np.int64), self.class_parts.tolist()
        for c in range(self.classes):
            if ends[c + 1] > ends[c] and first[c + 1] - first[c] > 1:
                visits.append((ends[c], ends[c + 1], below[2] + first[c], below[2] + first[c + 1]))
                picked.append(below[2] + parts[ends[c]:ends[c + 1]])
        ones = np.column_stack([s, np.ones(len(s), s.dtype)])
        found, by_s, by_upper = _levels(ones, np.concatenate(upper), visits, np.concatenate(picked), scale if learning else None)
        found = found.astype(np.result_type(states, np.float32))
        back = by_s[:, :-1] if learning else None
        if own:
            log, by_s, leaves = _leaves(s[:own], p["word_w"], p["word_b"], words[:own], self.parts[parts],
                                          np.diff(self.parts)[parts], scale if learning else None)
            found[:own] += log
            if learning:
                back[:own] += by_s
        pieces = []
        if learning:
            for k, low, high in zip(self.inner[::2], below[:-1], below[1:]):
                pieces += [(k, slice(None), by_upper[low:high, :-1]), (k[:-1] + "b", slice(None), by_upper[low:high, -1])]
            for rows, by_w, by_b in leaves if own else ():
                pieces += [("word_w", rows, by_w), ("word_b", rows, by_b)]
            if grad is not None:
                grad.update((k, np.zeros_like(p[k])) for k in (*self.inner, "word_w", "word_b"))
        for name, place, piece in pieces:
            if grad is None:
                learn(name, place, piece)
            else:
                (_runs(grad[name]) if piece.ndim > p[name].ndim else grad[name])[place] = piece
        placed = np.empty_like(found)
        placed[order] = found
        if learning:
            by_state = np.empty_like(back)
            by_state[order] = back
        return placed, by_state if learning else None

    def gradients(self, inputs, fresh, targets, real, h, scale=None, learn=None):
        """Gradients of the mean cost of one window, or of ``scale`` times its sum, truncated at its start, and the state after it.

        With ``learn`` the output weights are left to it, see ``log_probabilities``.
        """
        n, kept, grad = h.shape[1], [], {}
        states, last = self.run(inputs, fresh, h, kept)
        flat = np.flatnonzero(real.ravel())
        picked = states.reshape(-1, n)[flat]
        scale = np.float32(1 / max(len(flat), 1) if scale is None else scale)
        _, back = self.log_probabilities(picked, targets.ravel()[flat], grad if learn is None else None, scale, learn)
        outer = np.zeros((inputs.size, n), states.dtype)
        outer[flat] = back
        outer = outer.reshape(states.shape)
        (parts,), back_w = kept, np.ascontiguousarray(self.recurrent.transpose(0, 2, 1))
        before, gates, past, new = parts[:, 0], parts[:, 1:3], parts[:, 3], parts[:, 4]
        # What a change of the state brings to the update gate, the reset gate, the product behind it and the new state.
        slopes = np.empty((len(parts), 4, *before.shape[1:]), states.dtype)
        np.multiply(gates, 1 - gates, out=slopes[:, :2])
        np.multiply(1 - gates[:, 0], 1 - new * new, out=slopes[:, 3])
        np.multiply(slopes[:, 3], gates[:, 1], out=slopes[:, 2])
        slopes[:, 0] *= before - new
        slopes[:, 1] *= slopes[:, 3] * past
        changes, products = np.empty_like(slopes), np.empty_like(slopes[0, :3])
        later, begins = np.zeros(h.shape, states.dtype), _begins(fresh)
        for t in range(len(inputs) - 1, -1, -1):
            d = outer[t] + later
            np.multiply(d, slopes[t], out=changes[t])
            np.matmul(changes[t, :3], back_w, out=products)
            d *= gates[t, 0]
            for product in products:
                d += product
            d[begins[t]] = 0
            later = d
        by_w = (before.transpose(0, 2, 1)[:, None] @ changes[:, :3]).sum(axis=0)
        grad["gates"], grad["new"] = np.concatenate([by_w[0], by_w[1]], axis=1), by_w[2]
        words, d_rows = inputs.ravel(), changes[:, [0, 1, 3]].transpose(0, 2, 1, 3).reshape(-1, 3 * n)
        order = _order(words)
        sorted_words = words[order]
        starts = np.flatnonzero(np.diff(sorted_words, prepend=-1))
        return grad, sorted_words[starts], _sums(d_rows, order, starts), last


def lanes(lengths: list[int], width: int = LANES) -> list[list[int]]:
    """Texts dealt to lanes, the longest first and always to the shortest lane; the longest lane first."""
    heap = [(0, k) for k in range(min(width, max(len(lengths), 1)))]
    dealt = [[] for _ in heap]
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size, k = heapq.heappop(heap)
        dealt[k].append(i)
        heapq.heappush(heap, (size + lengths[i], k))
    return sorted(dealt, key=lambda lane: -sum(lengths[i] for i in lane))


def windows(texts: list[np.ndarray], longest: int | None = None, size: int | None = None):
    """(inputs, fresh, targets, real, owner) of consecutive windows over the lanes, each (steps, lanes).

    ``texts`` are word numbers ending with the end, 0, which is also what the first word follows.  Lanes that have run
    out leave; what is left of a window is marked as not real.
    """
    dealt = [lane for lane in lanes([len(t) for t in texts]) if lane]
    if not dealt:
        return
    sizes = np.array([sum(len(texts[i]) for i in lane) for lane in dealt])
    steps = int(sizes[0])
    targets = np.zeros((len(dealt), steps), np.int32)
    owner = np.full((len(dealt), steps), -1, np.int32)
    for k, lane in enumerate(dealt):
        targets[k, :sizes[k]] = np.concatenate([texts[i] for i in lane])
        owner[k, :sizes[k]] = np.repeat(lane, [len(texts[i]) for i in lane])
    targets, owner = np.ascontiguousarray(targets.T), np.ascontiguousarray(owner.T)
    start = 0
    while start < steps:
        live = int((sizes > start).sum())
        stop = min(steps, start + min(max((size or WINDOW_TOKENS) // live, SHORTEST), longest or steps))
        here, own = targets[start:stop, :live], owner[start:stop, :live]
        before = np.zeros_like(here)
        before[1:] = here[:-1]
        fresh = np.ones(here.shape, bool)
        fresh[1:] = own[1:] != own[:-1]
        if start:
            before[0], fresh[0] = targets[start - 1, :live], own[0] != owner[start - 1, :live]
        yield np.where(fresh, 0, before), fresh, here, own >= 0, own
        start = stop


def _groups(batches: Iterator[pa.RecordBatch], number: dict[bytes, int], unknown: int, columns: tuple[str, ...] = ()):
    """Texts as word numbers, gathered over batches up to GROUP_TOKENS: (rows, texts).

    With ``columns`` a row holds their values and the counts of the text's words without a number, which is not 0.
    """
    rows, texts, size, get = [], [], 0, number.get
    for batch in batches:
        values = zip(*(batch.column(c).to_pylist() for c in columns)) if columns else iter(lambda: (), None)
        for text, row in zip(batch.column("text").to_pylist(), values):
            words = tokens(text)
            ids = np.zeros(len(words) + 1, np.int32)  # the last one is the end
            ids[:-1] = np.fromiter(map(get, words, repeat(unknown)), np.int32, len(words))
            if columns:
                rows.append((*row, Counter([words[i] for i in np.flatnonzero(ids == unknown).tolist()])))
            texts.append(ids)
            size += len(ids)
            if size >= GROUP_TOKENS:
                yield rows, texts
                rows, texts, size = [], [], 0
    if texts:
        yield rows, texts


def _step(values: np.ndarray, memory: np.ndarray, g: np.ndarray, rate: float) -> None:
    """One step of Adagrad in place, a cached piece at a time; ``g`` is used up."""
    values, memory, g = values.reshape(-1), memory.reshape(-1), g.reshape(-1)
    for i in range(0, len(g), CACHED):
        x, m = g[i:i + CACHED], memory[i:i + CACHED]
        m += x * x
        x /= np.sqrt(m + FLAT)
        x *= np.float32(rate)
        values[i:i + CACHED] -= x


def _step_rows(values: np.ndarray, memory: np.ndarray, rows: np.ndarray, g: np.ndarray, rate: float) -> None:
    """One step of Adagrad of some rows, each given once, a cached piece at a time."""
    piece = max(CACHED * len(g) // max(g.size, 1), 1)
    for i in range(0, len(g), piece):
        here, x = rows[i:i + piece], g[i:i + piece]
        squares = memory[here]
        squares += x * x
        memory[here] = squares
        squares += FLAT
        np.sqrt(squares, out=squares)
        np.divide(x, squares, out=squares)
        squares *= np.float32(rate)
        values[here] -= squares


def fit(net: Network, texts: list[np.ndarray], memory: dict[str, np.ndarray], rate: float = RATE) -> int:
    """One pass of truncated backpropagation over the texts, in place; ``memory`` holds squared gradients (Adagrad).

    Weights without a gradient are left alone, which is what Adagrad does with them; the others step as soon as their
    gradient is known.
    """
    h, seen, first = None, 0, min(FIRST_RATE, rate)
    size = min(WINDOW_TOKENS, max(LEAST_WINDOW, sum(map(len, texts)) // PASSES))
    for number, (inputs, fresh, targets, real, _) in enumerate(windows(texts, LONGEST, size)):
        now = first + (rate - first) * min(number / WARM, 1.0)

        def learn(name: str, place: slice | np.ndarray, g: np.ndarray, now=now) -> None:
            if isinstance(place, slice):
                _step(net.p[name][place], memory[name][place], g, now)
            elif g.ndim > net.p[name].ndim:
                _step_rows(_runs(net.p[name]), _runs(memory[name]), place, g, now)
            else:
                _step_rows(net.p[name], memory[name], place, g, now)

        lanes_here = inputs.shape[1]
        h = np.zeros((lanes_here, net.p["new"].shape[0]), np.float32) if h is None else h[:lanes_here]
        # a token counts the same in a short window
        grad, used, d_rows, h = net.gradients(inputs, fresh, targets, real, h, 1.0 / WINDOW_TOKENS, learn)
        seen += int(real.sum())
        for k, g in grad.items():
            learn(k, slice(None), g)
        _step_rows(net.p["table"], memory["table"], used, d_rows, now)
    return seen


def _packed(values: np.ndarray) -> bytes:
    """Half floats without loss: upper bytes, which are much alike, and lower bytes stand together."""
    return pa.Codec("zstd", 1).compress(values.view(np.uint8).reshape(-1, 2).T.tobytes(), asbytes=True)


def _unpacked(packed: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd", 1).decompress(packed, 2 * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(2, -1).T).view(np.float16).reshape(-1)


def train(texts: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> Network:
    """A network trained on all of ``texts`` (doc_id, text).

    The texts are split into ``rounds`` parts.  In each round every task trains a copy of the network on its texts of that
    part, and what the copies changed is averaged by their numbers of tokens, a block of parameters per group; it travels as
    half floats, in which rows of words a task has not met are zeros.  Only the averages, some tens of MB, reach the driver.
    """
    context, net = texts.sparkSession.sparkContext, Network.initial(v)
    names = list(net.p)
    for part in range(rounds):
        sent = context.broadcast((v, net.moved))

        def learn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            v, moved = sent.value
            copy = Network.restored(v, moved)
            number = {w: i for i, w in enumerate(v.words[:v.outputs])}
            memory, seen = {k: np.zeros_like(a) for k, a in copy.p.items()}, 0
            for _, texts_here in _groups(batches, number, copy.outputs):
                seen += fit(copy, texts_here, memory)
            memory.clear()
            if seen:
                state = Network.restored(v, moved)  # again, instead of being held all the time
                for k in names:
                    copy.p[k] -= state.p[k]
                flat = np.concatenate([copy.p.pop(k).ravel().astype(np.float16) for k in names])
                for at in range(0, len(flat), BLOCK * HANDED_ON):
                    pieces = [flat[i:i + BLOCK] for i in range(at, min(at + BLOCK * HANDED_ON, len(flat)), BLOCK)]
                    blocks, sizes, first = [_packed(p) for p in pieces], [len(p) for p in pieces], at // BLOCK
                    yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(blocks)), pa.int32()), pa.array([float(seen)] * len(blocks)),
                                                      pa.array(sizes, pa.int32()), pa.array(blocks, pa.binary())], ["block", "weight", "size", "values"])

        def average(groups: Iterator[pa.Table]) -> pa.Table:
            total, weight = None, 0.0
            for row in groups.to_batches():
                for w, size, values in zip(*(row.column(c).to_pylist() for c in ("weight", "size", "values"))):
                    part_of = w * _unpacked(values, size).astype(np.float64)
                    total, weight = part_of if total is None else total + part_of, weight + w
            return pa.table({"block": groups.column("block")[:1], "values": pa.array([(total / weight).astype(np.float16).tobytes()], pa.binary())})

        here = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == part).select("text")
        copies = here.mapInArrow(learn, "block int, weight double, size int, values binary")
        blocks = copies.groupBy("block").applyInArrow(average, "block int, values binary").collect()
        if not blocks:
            continue
        flat = np.concatenate([np.frombuffer(b["values"], np.float16) for b in sorted(blocks, key=lambda b: b["block"])])
        net = Network.restored(v, flat + net.moved if len(net.moved) else flat)
    return net


def text_log10(net: Network, v: Vocabulary, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each text given as numbers of hot words (len(v.words) for the others), without the
    shares of those others among the words without an output.  The state is carried from window to window."""
    found, h = np.zeros(len(texts)), None
    share = np.append(np.log(v.counts + SMOOTHING) - math.log(v.rare_total), 0.0)
    short = [np.minimum(t, v.outputs) for t in texts]
    for inputs, fresh, targets, real, owner in windows(short):
        width = inputs.shape[1]
        h = np.zeros((width, net.p["new"].shape[0]), np.float32) if h is None else h[:width]
        states, h = net.run(inputs, fresh, h)
        flat = np.flatnonzero(real.ravel())
        logs, _ = net.log_probabilities(states.reshape(-1, states.shape[2])[flat], targets.ravel()[flat])
        found += np.bincount(owner.ravel()[flat], weights=logs, minlength=len(texts))
    for i, t in enumerate(texts):
        found[i] += share[t[t >= v.outputs]].sum()
    return found / math.log(10)


def _score(sent, doc_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, moved = sent.value
        net, number = Network.restored(v, moved), {w: i for i, w in enumerate(v.words)}
        logs = np.append(np.log10(v.counts + SMOOTHING), 0.0)
        unknown = len(v.words)
        for rows, texts in _groups(batches, number, unknown, ("doc_id", "text_hash")):
            doc_ids, hashes, tails = zip(*rows)
            yield pa.RecordBatch.from_arrays([
                pa.array(doc_ids, doc_type), pa.array(hashes, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([int((v.counts[t[t < unknown]] > 0).sum()) for t in texts], pa.int64()),
                pa.array([float(logs[t].sum()) for t in texts]), pa.array(text_log10(net, v, texts)),
                pa.MapArray.from_arrays(pa.array(np.cumsum([0, *map(len, tails)]), pa.int32()), _strings(chain.from_iterable(tails)),
                                        pa.array([n for tail in tails for n in tail.values()], pa.int64()))],
                ["doc_id", "text_hash", "n_tokens", "hot_known", "hot_base", "hot_score", "tail"])

    return run


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    ``training`` (doc_id, text) is what the counts and the network are learned from, all of it.  Null texts are empty, null ids
    stay, other columns are ignored; an empty table gives an empty result, and without training texts every token is unknown.
    ``base_score`` is the smoothed unigram's log10 probability.  ``score`` is the network's: group and class of the next word,
    then the word within its class; for words without an output the class of such words times their smoothed
    share among them.  Counts of frequent words are broadcast with the model; those of the others are joined.
    """
    counts = durable(word_counts(training))
    v = vocabulary(counts)
    net = train(training, v)
    read = docs.select("doc_id", text_key(F.col("text")).alias("text_hash"), "text")
    kind = read.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((v, net.moved))
    parts = read.mapInArrow(_score(sent, to_arrow_type(read.schema["doc_id"].dataType)), f"doc_id {kind}, text_hash long, n_tokens long, hot_known long, "
                                                                                         "hot_base double, hot_score double, tail map<string,long>")
    parts = durable(parts.withColumn("row", F.monotonically_increasing_id()))
    tails = parts.select("row", F.explode("tail").alias("word", "n")).join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    tails = tails.groupBy(F.col("row").alias("tail_row")).agg(
        F.sum("n").alias("tail_n"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("n") * F.log10(c + SMOOTHING)).alias("tail_log"))
    whole = parts.drop("tail").join(tails, F.col("row") == F.col("tail_row"), "left").fillna(0, ["tail_n", "tail_known", "tail_log"])
    base = F.lit(math.log10(v.total + SMOOTHING * (v.distinct + 1)))
    return whole.select(
        "doc_id", "text_hash", "n_tokens", (F.col("hot_known") + F.col("tail_known")).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("hot_base") + F.col("tail_log") - F.col("n_tokens") * base).alias("base_score"),
        (F.col("hot_score") + F.col("tail_log") - F.col("tail_n") * math.log10(v.rare_total)).alias("score"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the log10 probability of its whole text under the unigram base and under the network."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), FOLDS) == 0
    return score(docs, docs.filter(~held_out)).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens",
                                                      "base_score", "score")
