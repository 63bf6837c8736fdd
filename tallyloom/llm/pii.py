"""Personal data in texts: fixed base patterns, and a character-level bidirectional LSTM with CRF.

The base patterns give the base spans. The model reads every text in overlapping windows, whose middles give the
emissions (none, email, ip, card, phone) of each character, and adds spans for written forms that the patterns miss,
such as "jane at example dot org" with its signs in brackets, numbers grouped by dots, or phones without a plus.

Reconciling is global: the windows' emissions are joined, and one Viterbi path is taken through the whole text. Where an
emission prefers "none" by more than any two transitions can make up for, the best path is known to be there, so the
path is searched for only between such places. Runs of a tag that touch a base span are dropped, and a run is
added where it is most of a stretch with the shape of its kind (`shape`). Training is in numpy on the driver,
from labelled spans: base spans of a bounded sample of texts for each kind, as they are and rewritten into such
forms, within their context, and passages of texts without any.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.shared import ddl, ship, slices, written

KINDS = ("email", "ip", "card", "phone")
#: The bound on training rows: labelled spans of each kind, and passages without one, those of least hash.
SAMPLE_SPANS = 300
HIDDEN, TAGS, SYMBOLS = 8, 5, 130
WINDOW, OVERLAP = 512, 64
_TRAIN_LENGTH, _BATCH, _STEPS = 96, 48, 300
_ROWS = 1024
#: Text bytes read at once.
_BYTES = 1 << 20
#: Steps after which states become emissions.
_LEAP = 64
#: `_squash` of x is _SCALE (u + u / (u^2 + 1/8)), u being x / _ROOT.
_ROOT = 24**0.5
_SCALE = _ROOT / 9
#: Characters of a block of a long stretch; a score that no path has.
_BLOCK, _NEVER = 2048, np.float32(-1e9)

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
# A match starts where a run of digits does, and a run is taken whole: nothing is tried twice.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the email pattern; goes out from each @, so long runs without one cost nothing."""
    last = 0
    for m in _AT.finditer(text):
        start = at = m.start()
        while start > last:
            step = max(last, start - 64)
            run = len(_LOCAL.search(text[step:start]).group())
            start -= run
            if run < start + run - step:
                break
        if start < at:
            yield start, m.end()
            last = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base rules, by kind, then start; code points, end exclusive."""
    found = []
    if "@" in text:
        found += [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                found.append((2, *m.span()))
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return found


_LIKE = (
    re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+", re.IGNORECASE),
    re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]{1,3}){3}(?![0-9])"),
    re.compile(r"(?<![0-9])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])"),
    re.compile(r"(?<![0-9])(?:00[0-9]{1,3}|\([0-9]{2,4}\))(?:[ ./-]{0,2}[0-9]{2,5}){2,4}(?![0-9])"),
)
#: Characters around a tagged run in which its stretch is looked for.
_AROUND = 48


def _valid(kind: int, text: str) -> bool:
    if kind == 1:
        return all(int(n) < 256 for n in re.findall("[0-9]+", text))
    if kind == 2:
        return 13 <= len(_digits(text)) <= 19 and luhn(_digits(text))
    return kind == 0 or 9 <= len(_digits(text)) <= 15


def shape(kind: int, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The stretch with the shape of its kind of which the tagged run is at least half, or None: what the model may add."""
    low = max(0, start - _AROUND)
    for m in _LIKE[kind].finditer(text, low, min(len(text), end + _AROUND)):
        a, b = m.span()
        if 2 * (min(b, end) - max(a, start)) >= b - a and _valid(kind, m.group()):
            return a, b
    return None


def symbols(text: str) -> np.ndarray:
    """Symbol numbers of a text's characters: ASCII as it is, other letters up to U+024F one symbol, the rest one."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(codes < 128, codes, np.where(codes < 0x250, 128, 129)).astype(np.uint8)


# ---- the model ------------------------------------------------------------------------------------


def _start(rng) -> dict:
    """Gates in the order input, forget, output, candidate."""
    h = HIDDEN
    bias = np.zeros(4 * h, np.float32)
    bias[h : 2 * h] = 1.0
    model = {}
    for side in "fb":
        model["x" + side] = (rng.standard_normal((SYMBOLS, 4 * h)) * 0.3).astype(np.float32)
        model["u" + side] = (rng.standard_normal((h, 4 * h)) * 0.3).astype(np.float32)
        model["c" + side] = bias.copy()
    model["out"] = (rng.standard_normal((2 * h, TAGS)) * 0.3).astype(np.float32)
    model["bias"] = np.array([1.0] + [0.0] * (TAGS - 1), np.float32)
    model["move"] = np.eye(TAGS, dtype=np.float32)
    return model


def _squash(x):
    """A rational form of tanh, whose slope is 0 from -3 and 3 on; some times faster than tanh."""
    x = np.clip(x, np.float32(-3), np.float32(3))
    y = x * x
    return x * (y + np.float32(27)) / (y * np.float32(9) + np.float32(27))


def _slope(x):
    y = np.clip(x, np.float32(-3), np.float32(3)) ** 2
    return ((y - np.float32(9)) / (y + np.float32(3))) ** 2 / np.float32(9)


def _run(model: dict, side: str, chars: np.ndarray, mask: np.ndarray):
    """One direction over (time, rows) symbols: states for each time, and what backward needs."""
    time, rows = chars.shape
    h = np.zeros((rows, HIDDEN), np.float32)
    c = np.zeros_like(h)
    table, inner = model["x" + side] + model["c" + side], model["u" + side]
    states, kept = np.zeros((time, rows, HIDDEN), np.float32), []
    order = range(time) if side == "f" else range(time - 1, -1, -1)
    half = np.float32(0.5)
    for t in order:
        gates = table[chars[t]] + h @ inner
        sig, cand = _squash(gates[:, : 3 * HIDDEN] * half) * half + half, _squash(gates[:, 3 * HIDDEN :])
        i, f, o = sig[:, :HIDDEN], sig[:, HIDDEN : 2 * HIDDEN], sig[:, 2 * HIDDEN :]
        m = mask[t][:, None]
        before, c = (h, c), (f * c + i * cand) * m
        squashed = _squash(c)
        h = o * squashed * m
        states[t] = h
        kept.append((t, before, c, gates, i, f, o, cand, squashed, m))
    return states, kept


def _back(model: dict, side: str, chars: np.ndarray, kept: list, grad: np.ndarray, into: dict) -> None:
    n = HIDDEN
    dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
    for t, (h0, c0), c, gates, i, f, o, cand, squashed, m in reversed(kept):
        dh = (dh + grad[t]) * m
        dc = (dc + dh * o * _slope(c)) * m
        slope = np.concatenate([_slope(gates[:, : 3 * n] * np.float32(0.5)) * np.float32(0.25), _slope(gates[:, 3 * n :])], axis=1)
        gates = np.concatenate([dc * cand, dc * c0, dh * squashed, dc * i], axis=1) * slope
        into["u" + side] += h0.T @ gates
        into["c" + side] += gates.sum(axis=0)
        np.add.at(into["x" + side], chars[t], gates)
        dh, dc = gates @ model["u" + side].T, dc * f


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _crf(emit: np.ndarray, move: np.ndarray, tags: np.ndarray):
    """Loss and its gradients by emissions (time, rows, tags) and by transitions."""
    time, rows, _ = emit.shape
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[0] = emit[0]
    for t in range(1, time):
        alpha[t] = _log_sum(alpha[t - 1][:, :, None] + move, 1) + emit[t]
    for t in range(time - 2, -1, -1):
        beta[t] = _log_sum(move + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
    total = _log_sum(alpha[-1], 1)
    grad = np.exp(alpha + beta - total[None, :, None])
    pairs = np.exp(alpha[:-1, :, :, None] + move + (emit[1:] + beta[1:])[:, :, None, :] - total[None, :, None, None])
    grad_move = pairs.sum(axis=(0, 1))
    index = np.arange(rows)
    gold = emit[np.arange(time)[:, None], index, tags].sum(axis=0) + move[tags[:-1], tags[1:]].sum(axis=0)
    for t in range(time):
        grad[t, index, tags[t]] -= 1
    np.subtract.at(grad_move, (tags[:-1], tags[1:]), 1)
    return float((total - gold).mean()), grad / rows, grad_move / rows


def train(windows: list[tuple[np.ndarray, np.ndarray]], steps: int = _STEPS) -> dict:
    """A model from (symbols, tags) windows of _TRAIN_LENGTH, by Adam; deterministic."""
    rng = np.random.default_rng(7)
    model = _start(rng)
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    chars, tags = np.stack([w[0] for w in windows]), np.stack([w[1] for w in windows])
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(chars), _BATCH)
        x, y = chars[rows].T, tags[rows].T
        mask = np.ones(x.shape, np.float32)
        forward, kept_f = _run(model, "f", x, mask)
        backward, kept_b = _run(model, "b", x, mask)
        states = np.concatenate([forward, backward], axis=2)
        _, d_emit, d_move = _crf(states @ model["out"] + model["bias"], model["move"], y)
        grads = {k: np.zeros_like(v) for k, v in model.items()}
        grads["out"] = np.einsum("trh,trk->hk", states, d_emit)
        grads["bias"], grads["move"] = d_emit.sum(axis=(0, 1)), d_move
        d_states = d_emit @ model["out"].T
        _back(model, "f", x, kept_f, d_states[:, :, :HIDDEN], grads)
        _back(model, "b", x, kept_b, d_states[:, :, HIDDEN:], grads)
        size = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        rate = 0.03 * (1 - step / (steps + 1)) + 0.001
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / (size + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            step_size = rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            model[k] = (model[k] - step_size).astype(np.float32)
    return model


def _weights(model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `emissions` needs of a model: input sums by gate and pair of symbols, and the inner and outer weights, both
    directions side by side.

    The weights take the factors of `_squash` in, so that a step has few passes over its arrays: a gate's sum comes
    as u, and states are kept without their factors.
    """

    def laid(a, b):
        """Gates of both directions side by side, by gate: (4, ..., 2 HIDDEN)."""
        a, b = (np.moveaxis(m.reshape(*m.shape[:-1], 4, HIDDEN), -2, 0) for m in (a, b))
        return np.concatenate([a, b], axis=-1)

    # The sigmoid gates are squashed at half their sum.
    half = (np.array([0.5, 0.5, 0.5, 1]) / _ROOT)[:, None, None]
    zero = np.zeros_like(model["xf"])
    table_f = (laid(model["xf"] + model["cf"], zero) * half).astype(np.float32)
    table_b = (laid(zero, model["xb"] + model["cb"]) * half).astype(np.float32)
    # Each pair of symbols has its row of input sums, so a step gathers once for each gate.
    pairs = np.ascontiguousarray((table_f[:, :, None, :] + table_b[:, None, :, :]).reshape(4, -1, 2 * HIDDEN))
    zero = np.zeros_like(model["uf"])
    state = _SCALE * _SCALE / 2  # a state is so many times what is kept of it
    inner = np.concatenate([laid(model["uf"], zero), laid(zero, model["ub"])], axis=1) * (half * state)
    outer = np.zeros((2 * TAGS, 2 * HIDDEN), np.float32)
    outer[:TAGS, :HIDDEN], outer[TAGS:, HIDDEN:] = model["out"][:HIDDEN].T * state, model["out"][HIDDEN:].T * state
    return pairs, np.ascontiguousarray(inner, np.float32), outer


def emissions(model: dict, chars: np.ndarray, lengths: np.ndarray, weights: tuple | None = None) -> np.ndarray:
    """Emissions (time, rows, tags), laid by row and tag, of windows given as (time, rows) symbols. Both directions run
    together: the second one reads each row from its own end. `weights` are those of the model (`_weights`)."""
    pairs, inner, outer = weights or _weights(model)
    time, rows = chars.shape
    h2 = 2 * HIDDEN
    order = lengths - 1 - np.arange(time)[:, None]
    both = chars.astype(np.intp) * SYMBOLS + np.take_along_axis(chars, np.clip(order, 0, None), 0)
    h, c = np.zeros((rows, h2), np.float32), np.zeros((rows, h2), np.float32)
    states = np.empty((_LEAP, rows, h2), np.float32)
    gates, work = (np.empty((4, rows, h2), np.float32) for _ in range(2))
    found = np.empty((rows, 2 * TAGS, time), np.float32)
    edge, eighth, one = np.float32(3 / _ROOT), np.float32(0.125), np.float32(1 / _SCALE)
    keep, ninth = np.float32(_SCALE / 2), np.float32(_SCALE / _ROOT)

    def squash(x, y):
        """`_squash` in place, without its factor."""
        np.clip(x, -edge, edge, out=x)
        np.multiply(x, x, out=y)
        np.add(y, eighth, out=y)
        np.divide(x, y, out=y)
        np.add(x, y, out=x)

    for t in range(time):
        np.matmul(h, inner, out=gates)
        for gate in range(4):
            pairs[gate].take(both[t], axis=0, out=work[gate], mode="clip")
        gates += work
        squash(gates, work)
        gates[:3] += one
        c *= gates[1]
        np.multiply(gates[0], gates[3], out=work[0])
        c += work[0]
        c *= keep
        h = states[t % _LEAP]
        np.multiply(c, ninth, out=h)
        squash(h, work[0])
        h *= gates[2]
        n = t % _LEAP + 1
        if n == _LEAP or t + 1 == time:
            np.matmul(outer, states[:n].transpose(1, 2, 0), out=found[:, :, t + 1 - n : t + 1])
    emit, from_end = found[:, :TAGS], found[:, TAGS:]
    if (lengths == time).all():
        emit += from_end[:, :, ::-1]
    else:
        for row, n in enumerate(lengths):
            emit[row, :, :n] += from_end[row, :, :n][:, ::-1]
    emit += model["bias"][:, None]
    return emit.transpose(2, 0, 1)


def _transfers(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """[stretch, first tag, last tag]: the best score of each of equally long stretches (stretches, characters, tags)."""
    score = np.where(np.eye(TAGS, dtype=bool), emit[:, 0, None, :], _NEVER)
    for t in range(1, emit.shape[1]):
        top = score[:, :, :1] + move[0]
        for j in range(1, TAGS):
            np.maximum(top, score[:, :, j : j + 1] + move[j], out=top)
        score = top + emit[:, t, None, :]
    return score


def _cut(emit: np.ndarray, move: np.ndarray, begun: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A long stretch as blocks of _BLOCK characters (the last one longer) that can be decoded on their own: their starts,
    and what their first and last tags add. All blocks are searched together for every pair of end tags, and one
    path goes through the blocks."""
    n = len(emit) // _BLOCK
    starts = np.arange(n) * _BLOCK
    whole = _transfers(emit[: (n - 1) * _BLOCK].reshape(n - 1, _BLOCK, TAGS), move)
    whole = np.concatenate([whole, _transfers(emit[None, (n - 1) * _BLOCK :], move)])
    ahead, came = begun, []
    for block in whole:
        reach = ahead[:, None] + block
        came.append(reach.argmax(axis=0))  # the block's first tag, by its last one
        best = reach.max(axis=0)[:, None] + move
        came.append(best.argmax(axis=0))  # the block's last tag, by the next one's first
        ahead = best.max(axis=0)
    opens, closes = np.full((2, n, TAGS), _NEVER)
    last = int((reach.max(axis=0) + ended).argmax())
    for b in range(n - 1, -1, -1):
        first = int(came[2 * b][last])
        opens[b, first] = closes[b, last] = 0
        last = int(came[2 * b - 1][first]) if b else 0
    return starts, opens, closes


def _unsure(emit: np.ndarray, begins: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Whether a place is in a span whose tags other than 0 may be worth it: a bound on the best sum over all such spans."""
    step, leave, back = (m.max() - move[0, 0] for m in (move[1:, 1:], move[0, 1:], move[1:, 0]))
    gain = (emit[1:].max(axis=0) - emit[0]).astype(np.float64) + step
    # A span that starts or ends with its text need not leave 0 or come back.
    begins = np.unique(begins)
    gain[begins[:-1]] += max(0.0, -leave)
    gain[begins[1:] - 1] += max(0.0, -back)
    # Texts are set apart by a loss that no span makes up for.
    text = np.zeros(len(gain), np.int64)
    text[begins[1:-1]] = 1
    place = np.arange(len(gain)) + np.cumsum(text)
    sums = np.full(len(gain) + len(begins) - 2, -1e5)
    sums[place] = gain
    sums = np.cumsum(sums)
    before = np.append(0.0, sums[:-1])
    best = np.maximum.accumulate(sums[::-1])[::-1] - np.minimum.accumulate(before)
    return best[place] + leave + back - step > -1e-3


def best_path(emit: np.ndarray, begins: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best tags of texts whose emissions (tags, characters) lie one after the other; `begins` has their starts and the end.

    A span of other tags is on the best path only if its emissions are above those of 0 by what it costs to leave 0 and to
    come back. Places that are in no span of which that can be so have 0 (`_unsure`). The rest are stretches between such
    places, which are decoded on their own, all of them together: step by step over those that are long enough.
    """
    n = emit.shape[1]
    tags = np.zeros(n, np.uint8)
    if not n:
        return tags
    unsure = _unsure(emit, begins, move)
    first = np.zeros(n + 1, bool)
    first[begins] = True
    at = np.flatnonzero(unsure)
    if not len(at):
        return tags
    emit = np.ascontiguousarray(emit[:, at].T)  # from here on by place among the unsure ones
    head = np.append(True, (at[1:] != at[:-1] + 1) | first[at[1:]])
    starts = np.flatnonzero(head)
    sizes = np.diff(np.append(starts, len(at)))
    begun = np.where(first[at[starts]][:, None], np.float32(0), move[0])
    ended = np.where(first[at[starts + sizes - 1] + 1][:, None], np.float32(0), move[:, 0])
    for i in np.flatnonzero(sizes >= 2 * _BLOCK):
        blocks, opens, closes = _cut(emit[starts[i] : starts[i] + sizes[i]], move, begun[i], ended[i])
        starts = np.append(starts, starts[i] + blocks)
        sizes = np.append(sizes, np.diff(np.append(blocks, sizes[i])))
        begun, ended = np.concatenate([begun, opens]), np.concatenate([ended, closes])
        sizes[i] = 0
    order = np.argsort(-sizes, kind="stable")
    order = order[: np.count_nonzero(sizes)]
    starts, sizes, begun, ended = starts[order], sizes[order], begun[order].astype(np.float32), ended[order].astype(np.float32)
    live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")  # stretches that have a step
    scores = [begun + emit[starts]]
    for t in range(1, sizes[0]):
        before = scores[-1][: live[t]]
        top = before[:, :1] + move[0]
        for j in range(1, TAGS):
            np.maximum(top, before[:, j : j + 1] + move[j], out=top)
        scores.append(top + emit[starts[: live[t]] + t])
    later = np.zeros(0, np.intp)
    for t in range(sizes[0] - 1, -1, -1):
        gain = np.concatenate([move.T[later], ended[len(later) : live[t]]])
        later = (scores[t] + gain).argmax(axis=1)
        tags[at[starts[: live[t]] + t]] = later
    return tags


# ---- training data --------------------------------------------------------------------------------


def _rewritten(kind: int, text: str, rng) -> str:
    """A base span in a form that the base rules miss."""
    if kind == 0:
        local, _, domain = text.partition("@")
        at, dot = [(" (at) ", " (dot) "), (" [at] ", " [dot] "), (" @ ", "."), ("(at)", ".")][rng.integers(4)]
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return text.replace(".", ["[.]", " . ", "(.)"][rng.integers(3)])
    digits = _digits(text)
    if kind == 2:
        sign = "./_"[rng.integers(3)]
        return sign.join([digits[:4], digits[4:8], digits[8:12], digits[12:]])
    sign = " ./-"[rng.integers(4)]
    if rng.integers(2):
        return "00" + sign.join([digits[:2], digits[2:5], digits[5:8], digits[8:]]).rstrip(" ./-")
    return f"({digits[:3]}){sign}" + sign.join([digits[3:6], digits[6:]])


def _window(text: str, a: int, b: int, inside: str, kind: int | None, rng) -> tuple[np.ndarray, np.ndarray]:
    """_TRAIN_LENGTH symbols around text[a:b], which is written as `inside`, and their tags."""
    lead = int(rng.integers(4, 40))
    before = text[max(0, a - lead) : a]
    made = before + inside + text[b : b + _TRAIN_LENGTH]
    tags = np.zeros(max(len(made), _TRAIN_LENGTH), np.int64)
    if kind is not None:
        tags[len(before) : len(before) + len(inside)] = kind + 1
    return symbols(made.ljust(_TRAIN_LENGTH))[:_TRAIN_LENGTH], tags[:_TRAIN_LENGTH]


def labelled_windows(text: str, seed: int = 0) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, symbols, tags) of two windows for the first span of each kind, as it is and rewritten, that has no other
    near it; of a passage, of kind -1, for a text without spans."""
    rng = np.random.default_rng(seed)
    spans = base_spans(text)
    out = []
    for kind in range(len(KINDS)):
        alone = (
            (a, b)
            for k, a, b in spans
            if k == kind and not any(x < b + 60 and y > a - 60 and (q, x) != (k, a) for q, x, y in spans)
        )
        if len(spans) < 200 and (span := next(alone, None)):
            a, b = span
            for inside in (text[a:b], _rewritten(kind, text[a:b], rng)):
                out.append((kind, *_window(text, a, b, inside, kind, rng)))
    if not spans and len(text) > 20:
        at = int(rng.integers(0, len(text)))
        out.append((-1, *_window(text, at, at, "", None, rng)))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_SPANS) -> dict | None:
    """Trains on `sample` labelled spans of each kind at most, and as many passages without one; None without labelled spans.

    All texts are looked through, and of each kind those of least hash of id and text are taken, so a corpus with few
    spans gives them all. A task keeps as many texts of a kind; only windows of that number go to the driver.
    """
    bounds = {kind: sample if kind >= 0 else 2 * sample for kind in range(-1, len(KINDS))}

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {kind: [] for kind in bounds}
        for batch in slices(batches, "text"):
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()):
                if all(len(rows) >= bounds[kind] and -h <= rows[0][0] for kind, rows in kept.items()):
                    continue  # not among the least of any kind
                found: dict[int, list] = {}
                for kind, chars, tags in labelled_windows(text, h & 0xFFFFFFFF):
                    found.setdefault(kind, []).append((chars.tobytes(), tags.astype(np.uint8).tobytes()))
                for kind, made in found.items():
                    if (-h, made) not in kept[kind]:  # a row that repeats
                        heapq.heappush(kept[kind], (-h, made))
                    if len(kept[kind]) > bounds[kind]:
                        heapq.heappop(kept[kind])
        flat = [(kind, -h, *pair) for kind, rows in kept.items() for h, made in rows for pair in made]
        columns = zip(*flat) if flat else ([], [], [], [])
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["kind", "h", "chars", "tags"])

    rows = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("string"), text_col, F.lit("pii")).alias("h"), F.col(text_col).cast("string").alias("text"))
    made = written(rows.mapInArrow(windows, ddl("kind int, h bigint, chars binary, tags binary")), "labelled")
    found = []
    for kind in bounds:
        best = made.where(F.col("kind") == kind).dropDuplicates(["h", "chars", "tags"]).orderBy("h", "chars", "tags").limit(2 * sample)
        found += [(np.frombuffer(r["chars"], np.uint8), np.frombuffer(r["tags"], np.uint8).astype(np.int64)) for r in best.collect()]
    return train(found) if any(t.any() for _, t in found) else None


# ---- application ----------------------------------------------------------------------------------


def tag_texts(model: dict, texts: list[str]) -> list[np.ndarray]:
    """Tags of every character of every text: emissions from overlapping windows, of a bounded number at a time, then one
    path through each text."""
    coded = [symbols(t) for t in texts]
    begins = np.concatenate([[0], np.cumsum([len(c) for c in coded], dtype=np.int64)])
    emit = np.empty((TAGS, begins[-1]), np.float32)
    step, weights = WINDOW - OVERLAP, _weights(model)
    windows = [(i, at) for i, c in enumerate(coded) for at in range(0, max(len(c) - OVERLAP, 1), step) if len(c)]
    windows.sort(key=lambda w: min(WINDOW, len(coded[w[0]]) - w[1]))
    for start in range(0, len(windows), _ROWS):
        part = windows[start : start + _ROWS]
        lengths = np.array([min(WINDOW, len(coded[i]) - at) for i, at in part])
        chars = np.zeros((len(part), lengths.max()), np.uint8)
        for row, (i, at) in enumerate(part):
            chars[row, : lengths[row]] = coded[i][at : at + lengths[row]]
        found = emissions(model, np.ascontiguousarray(chars.T), lengths, weights).transpose(1, 2, 0)
        for row, (i, at) in enumerate(part):
            low = OVERLAP // 2 if at else 0
            high = lengths[row] if at + lengths[row] == len(coded[i]) else WINDOW - OVERLAP // 2
            emit[:, begins[i] + at + low : begins[i] + at + high] = found[row, :, low:high]
    tags = best_path(emit, begins, model["move"])
    return [tags[a:b] for a, b in zip(begins[:-1], begins[1:])]


def added_spans(text: str, tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The stretches that runs of a tag stand for, without those that touch a base span; of two that overlap, the first."""
    edges = np.flatnonzero(np.diff(tags)) + 1
    bounds = np.concatenate([[0], edges, [len(tags)]])
    runs = np.flatnonzero(tags[bounds[:-1]]) if len(tags) else []
    taken = np.zeros(len(text) + 1, bool)
    for _, a, b in base:
        taken[a:b] = True
    out = []
    for r in runs:
        kind = int(tags[bounds[r]]) - 1
        found = shape(kind, text, int(bounds[r]), int(bounds[r + 1]))
        if found and not taken[found[0] : found[1]].any():
            taken[found[0] : found[1]] = True
            out.append((kind, *found))
    return out


def joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def spans_of(model: dict | None, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    tags = tag_texts(model, texts) if model else [np.zeros(len(t), np.uint8) for t in texts]
    out = []
    for text, tagged in zip(texts, tags):
        base = base_spans(text)
        out.append((base, added_spans(text, tagged, base) if tagged.any() else []))
    return out


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: dict | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row.

    Counts and base_sha256 (of kind:start:end, by kind, then start) are of the base spans; spans has the
    added ones too. A null text is an empty one; rows that repeat an id are returned each; other columns
    are ignored. Without a model, one is fitted on `docs`; without labelled spans nothing is added.
    """
    model = fit(docs, id_col, text_col) if model is None else model

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = spans_of(model, texts)
            counts = [[sum(k == kind for k, _, _ in base) for base, _ in found] for kind in range(len(KINDS))]
            prints = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            columns = [*counts, prints, [joined(base + more) for base, more in found], [len(more) for _, more in found]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, columns)],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        find,
        ddl(f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"),
    )


def redacted(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: dict | None = None) -> DataFrame:
    """`docs` with every span of the text, base or added, replaced by its kind in brackets; the other columns
    and a null text stay as they are. Where spans overlap, the part in common is replaced once."""
    model = fit(docs, id_col, text_col) if model is None else model

    def replace(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, _BYTES):
            texts = batch.column(text_col).to_pylist()
            out = [t if t is None else without(t, [*b, *m]) for t, (b, m) in zip(texts, spans_of(model, [t or "" for t in texts]))]
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, text_col, pa.array(out, batch.schema.field(at).type))

    ship(docs.sparkSession)
    return docs.mapInArrow(replace, docs.schema)


def without(text: str, spans: list[tuple[int, int, int]]) -> str:
    parts, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            parts += [text[last:a], f"[{KINDS[kind].upper()}]"]
        last = max(last, b)
    return "".join(parts) + text[last:]
