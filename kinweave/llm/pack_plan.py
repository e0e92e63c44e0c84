"""The plan of a packing: which lengths lie together in a sequence, and how often.

A configuration is a multiset of lengths that fits a sequence. The configuration linear program asks for the least
total use of configurations that covers the histogram of lengths. It is solved by multiplicative weights: a length's
weight falls exponentially with the share of it that is covered; a knapsack dynamic program over the capacity prices
configurations, and for each length the best one that holds it is used a little if it is almost as good as the best of
all. The prices also bound the program from below. The solution is rounded to whole uses, what remains is solved again,
and the last few lengths go best fit, longest first, to the gaps.

All of this works on the histogram, which has at most as many entries as the capacity: neither time nor memory depends
on the number of pieces, and nothing is drawn at random."""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np

#: Accuracy of a priced configuration; how fast weights fall; rounds of weights, and of solving what rounding leaves.
NEAR, RATE, ROUNDS, PASSES = 0.02, 0.2, 24, 1
#: Share of every length that rounding leaves to the best fit, so that long pieces find short ones.
RESERVE = 0.1


@dataclass
class Plan:
    """``uses`` sequences of each configuration: (uses, ((length, count), ...)); ``bound``: the linear program's
    lower bound on sequences."""

    capacity: int
    configurations: list[tuple[int, tuple[tuple[int, int], ...]]] = field(default_factory=list)
    bound: float = 0.0

    @property
    def sequences(self) -> int:
        return sum(n for n, _ in self.configurations)


def knapsack(worth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best, last): the most worth of lengths that fit each room, and one length of that choice (0: leave it). The
    worth of absent lengths is below 0."""
    n = len(worth)
    best, last = np.zeros(n), np.zeros(n, np.int64)
    back = np.zeros(n)  # best in reverse, so that both operands run forwards
    own = np.empty(n)
    for room in range(1, n):
        total = np.add(worth[1 : room + 1], back[n - room :], out=own[:room])
        at = int(total.argmax())
        if total[at] > best[room - 1]:
            best[room], last[room] = total[at], at + 1
        else:
            best[room] = best[room - 1]
        back[n - 1 - room] = best[room]
    return best, last


def _configuration(room: int, last: np.ndarray, first: int) -> tuple[tuple[int, int], ...]:
    found = {first: 1}
    while room > 0:
        length = int(last[room])
        if length:
            found[length] = found.get(length, 0) + 1
            room -= length
        else:
            room -= 1
    return tuple(sorted(found.items()))


def solve(counts: np.ndarray, rounds: int = ROUNDS) -> tuple[dict[tuple, float], float]:
    """({configuration: uses}, lower bound) of the linear program; ``counts[l]`` pieces have length l, the capacity is
    the last index."""
    capacity = len(counts) - 1
    lengths = np.flatnonzero(counts)
    demand = counts.astype(float)
    covered = np.zeros(capacity + 1)
    used: dict[tuple, float] = {}
    bound, step = float((lengths * demand[lengths]).sum() / capacity), 1.0 / rounds
    # A length starts with the worth of the room it takes: the first prices are those of a perfect packing.
    for turn in range(rounds + 1):
        share = covered[lengths] / demand[lengths]
        worth = np.full(capacity + 1, -1e30)
        worth[lengths] = lengths / capacity * np.exp((share.min() - share) * RATE * rounds)
        best, last = knapsack(worth)
        bound = max(bound, float((worth[lengths] * demand[lengths]).sum() / best[capacity]))
        # In the last turn whatever still lags behind is covered by the best configuration that holds it.
        close = 0.0 if turn == rounds else (1 - NEAR) * best[capacity]
        target = min((turn + 1) * step, 1.0)
        value = worth[lengths] + best[capacity - lengths]
        for i in np.lexsort((-lengths, share)).tolist():  # the least covered first
            length = int(lengths[i])
            lack = target * demand[length] - covered[length]
            if lack <= 0 or value[i] < close:
                continue
            config = _configuration(capacity - length, last, length)
            amount = lack / dict(config)[length]
            if turn < rounds:  # no length of it is covered by more than two steps at once
                amount = min(amount, 2 * step * min(demand[k] / n for k, n in config))
            used[config] = used.get(config, 0.0) + amount
            for k, n in config:
                covered[k] += n * amount
    scale = float((covered[lengths] / demand[lengths]).min())
    return ({c: x / scale for c, x in used.items()} if scale > 0 else used), bound


def _best_fit(left: np.ndarray, plan: Plan) -> None:
    """Places what is left, longest first, in the fullest sequence with room. Sequences of one configuration are
    handled together, so this takes as many steps as there are lengths and configurations, not pieces."""
    capacity = plan.capacity
    groups: dict[tuple[tuple[int, int], ...], int] = {}
    for n, config in plan.configurations:
        groups[config] = groups.get(config, 0) + n
    by_gap: dict[int, list[tuple]] = {}
    for config in groups:
        by_gap.setdefault(capacity - sum(k * c for k, c in config), []).append(config)
    gaps = sorted(by_gap)

    def add(config: tuple, n: int, gap: int) -> None:
        if config in groups:
            groups[config] += n
            return
        groups[config] = n
        if gap not in by_gap:
            by_gap[gap] = []
            insort(gaps, gap)
        by_gap[gap].append(config)

    for length in np.flatnonzero(left)[::-1].tolist():
        need = int(left[length])
        while need:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = min(capacity // length, need)
                n = need // each
                add(((length, each),), n, capacity - each * length)
                need -= n * each
                continue
            gap = gaps[at]
            config = by_gap[gap][-1]
            n, each = groups[config], min(gap // length, need)
            took = min(n, need // each)
            groups[config] -= took
            if not groups[config]:
                del groups[config]
                by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap]
                    gaps.pop(at)
            held = dict(config)
            held[length] = held.get(length, 0) + each
            add(tuple(sorted(held.items())), took, gap - each * length)
            need -= took * each
    plan.configurations = [(n, c) for c, n in groups.items()]


def pack_plan(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, passes: int = PASSES) -> Plan:
    """A plan whose configurations hold exactly ``histogram[length]`` pieces of every length (1 to capacity)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} doesn't lie between 1 and {capacity}")
        left[length] += n
    plan = Plan(capacity)
    for turn in range(passes):
        before = int(left.sum())
        if not before:
            break
        used, bound = solve(left, rounds)
        if not turn:
            plan.bound = bound
        room = {c: capacity - sum(k * n for k, n in c) for c in used}
        # Room that the program's solution leaves on average; fuller configurations are worth fixing.
        slack = 2 * (capacity - float((np.arange(capacity + 1) * left).sum()) / max(bound, 1e-9))
        keep = (left * RESERVE).astype(np.int64) if turn == 0 else np.zeros_like(left)
        debt = 0.0
        for config in sorted(used, key=lambda c: (room[c], -used[c], c)):
            if room[config] > slack:
                break
            debt += used[config]
            times = min(int(debt + 0.5), *(int(left[k] - keep[k]) // n for k, n in config))
            debt -= int(debt + 0.5)
            if times > 0:
                plan.configurations.append((times, config))
                for k, n in config:
                    left[k] -= n * times
        if int(left.sum()) == before:
            break
    _best_fit(left, plan)
    plan.configurations.sort(key=lambda g: (-g[0], g[1]))
    return plan
