"""A linear-chain conditional random field over hashed features, in numpy; small enough to be sent to every task."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

BUCKETS = 1 << 18
NAMED = 1 << 12  # the first buckets are for named features
#: Characters of a place are features in runs of so many.
GRAMS = (1, 2, 3)
MOVES_DECAY = 0.01  # moves are held back, so that a clause can differ from those around it
_PRIME, _SPREAD = 1_000_003, 0x9E3779B97F4A7C15


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Encoded:
    """Of the places of many sequences: the features by place and bucket, and how many places each sequence has."""

    place: np.ndarray
    bucket: np.ndarray
    lengths: np.ndarray


def encode(sequences: Sequence[Sequence[tuple[Sequence[str], str]]], names: dict[str, int] | None = None) -> Encoded:
    """Each place has named features and a text, whose runs of characters are features too."""
    names = {} if names is None else names
    lengths = np.array([len(s) for s in sequences], np.int64)
    places = [p for s in sequences for p in s]
    named, texts = [], []
    for own, text in places:
        for f in own:
            if f not in names:
                names[f] = zlib.crc32(f.encode()) % NAMED
            named.append(names[f])
        texts.append(text)
    place = [np.repeat(np.arange(len(places)), [len(own) for own, _ in places])]
    bucket = [np.array(named, np.int64)]
    codes = np.frombuffer(("\0" + "".join(f"\1{t}\0" for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    at = np.cumsum(codes == 0) - 1
    for n in GRAMS:
        if len(codes) < n + 2 or not texts:
            continue
        h = np.zeros(len(codes) - n + 1, np.uint64)
        for i in range(n):
            h = h * np.uint64(_PRIME) + codes[i : i + len(h)]
        inside = (at[: len(h)] == at[n - 1 :]) & (codes[: len(h)] != 0)
        place.append(at[: len(h)][inside])
        bucket.append((((h[inside] + np.uint64(n)) * np.uint64(_SPREAD)) >> np.uint64(40)).astype(np.int64) % (BUCKETS - NAMED) + NAMED)
    return Encoded(np.concatenate(place), np.concatenate(bucket), lengths)


class Crf:
    """Labels of sequences whose places have features. Of two tied labels the first has the other's weights of characters: only named
    features tell them apart."""

    def __init__(self, labels: Sequence[str], tied: tuple[str, str] | None = None):
        self.labels = list(labels)
        self.tied = [self.labels.index(t) for t in tied] if tied else None
        self.weights = np.zeros((BUCKETS, len(labels)), np.float32)
        self.moves = np.zeros((len(labels) + 2, len(labels)))  # from a label, or from the beginning; the last row is for the end

    def _scores(self, x: Encoded, weights: np.ndarray) -> np.ndarray:
        n = int(x.lengths.sum())
        return np.stack([np.bincount(x.place, weights[:, k][x.bucket], minlength=n) for k in range(len(self.labels))], axis=1)

    @staticmethod
    def _padded(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.zeros((len(lengths), lengths.max(), *flat.shape[1:]), flat.dtype)
        out[np.arange(out.shape[1]) < lengths[:, None]] = flat
        return out

    def fit(self, x: Encoded, tags: Sequence[Sequence[str]], rounds: int = 30, rate: float = 0.15, decay: float = 2e-5, left_out: float = 0.5, seed: int = 7) -> Crf:
        """Maximises the penalised log-likelihood by Adam over all the sequences, each of which has a place at least. In each round
        that share of the features of characters is left out at random, so that none is relied upon alone."""
        if not len(x.lengths):
            return self
        size, many, lengths = len(self.labels), len(x.lengths), x.lengths
        real = np.arange(lengths.max()) < lengths[:, None]
        y = self._padded(np.eye(size)[[self.labels.index(t) for s in tags for t in s]], lengths)
        order = np.argsort(-lengths, kind="stable")
        back = np.argsort(order)
        used, bucket = np.unique(x.bucket, return_inverse=True)
        chars = used >= NAMED
        params = [np.zeros((len(used), size)), np.zeros((size + 2, size))]
        seen = np.zeros_like(params[1])
        seen[:size] = np.einsum("ntl,ntm->lm", y[:, :-1], y[:, 1:])
        seen[size], seen[size + 1] = y[:, 0].sum(0), y[np.arange(many), lengths - 1].sum(0)
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        rng = np.random.default_rng(seed)
        kept = np.arange(len(bucket))
        for step in range(1, rounds + 1):
            w, m = params
            if left_out:
                kept = np.flatnonzero((rng.random(len(bucket), np.float32) >= left_out) | ~chars[bucket])
            own = w * np.where(chars, 1 / (1 - left_out), 1.0)[:, None]
            place, part = x.place[kept], bucket[kept]
            marginal, moved = self._expect(self._padded(self._scores(Encoded(place, part, lengths), own), lengths)[order], m, lengths[order])
            diff = (y - marginal[back])[real]
            grads = [np.stack([np.bincount(part, diff[:, k][place], minlength=len(used)) for k in range(size)], axis=1), seen - moved]
            if self.tied:
                mine, other = self.tied
                grads[0][chars, other] += grads[0][chars, mine]
                grads[0][chars, mine] = grads[0][chars, other]
            for k in range(2):
                g = grads[k] / many - (decay, MOVES_DECAY)[k] * params[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                params[k] = params[k] + rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        self.weights = np.zeros((BUCKETS, size), np.float32)
        self.weights[used] = params[0]
        self.moves = params[1]
        return self

    def _expect(self, score: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected labels of each place, and expected moves, by the forward-backward recursion; longer sequences come first."""
        n, longest, size = score.shape
        step, many = moves[:size], [int((lengths > t).sum()) for t in range(longest)]
        rows = np.arange(n)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = moves[size] + score[:, 0]
        for t in range(1, longest):
            m = many[t]
            forward[:m, t] = _log_sum(forward[:m, t - 1, :, None] + step, 1) + score[:m, t]
        total = _log_sum(forward[rows, lengths - 1] + moves[size + 1], 1)
        backward[rows, lengths - 1] = moves[size + 1]
        for t in range(longest - 2, -1, -1):
            m = many[t + 1]
            backward[:m, t] = _log_sum((backward[:m, t + 1] + score[:m, t + 1])[:, None, :] + step, 2)
        marginal = np.exp(forward + backward - total[:, None, None])
        out = np.zeros_like(moves)
        for t in range(1, longest):
            m = many[t]
            out[:size] += np.exp(forward[:m, t - 1, :, None] + step + (score[:m, t] + backward[:m, t])[:, None, :] - total[:m, None, None]).sum(0)
        out[size] = marginal[:, 0].sum(0)
        out[size + 1] = marginal[rows, lengths - 1].sum(0)
        return marginal, out

    def tag(self, x: Encoded, lanes: int = 2048) -> list[list[str]]:
        """The likeliest labels of each sequence (Viterbi), in the order given."""
        size = len(self.labels)
        scores = self._scores(x, self.weights)
        starts = np.cumsum(x.lengths) - x.lengths
        out: list[list[str]] = [[] for _ in x.lengths]
        order = np.flatnonzero(x.lengths)[np.argsort(x.lengths[x.lengths > 0], kind="stable")]
        at = 0
        while at < len(order):
            most = max(1, min(lanes, 200_000 // int(x.lengths[order[min(at + lanes, len(order)) - 1]])))
            part = order[at : at + most]
            at += most
            lengths = x.lengths[part]
            n, longest = len(part), int(lengths.max())
            real = np.arange(longest) < lengths[:, None]
            score = np.zeros((n, longest, size))
            score[real] = scores[(starts[part][:, None] + np.arange(longest))[real]]
            back = np.zeros((n, longest, size), np.int8)
            best = self.moves[size] + score[:, 0]
            rows = np.arange(n)
            for t in range(1, longest):
                options = best[:, :, None] + self.moves[:size]
                came = options.argmax(1)
                on = real[:, t, None]
                best = np.where(on, np.take_along_axis(options, came[:, None], 1)[:, 0] + score[:, t], best)
                back[:, t] = np.where(on, came, np.arange(size))
            label = (best + self.moves[size + 1]).argmax(1)
            path = np.empty((n, longest), np.int8)
            for t in range(longest - 1, -1, -1):
                path[:, t] = label
                label = back[rows, t, label]
            for row, k in enumerate(part):
                out[k] = [self.labels[v] for v in path[row, : lengths[row]]]
        return out
