"""Cheapest edits of lanes of conversation rows, the least of them by prefix doubling (operator 11).

A lane is a stretch of at most ``LANE`` rows of one conversation; lanes of a batch are worked on side by side.  A
node is (lane, position, state); the state says which roles stand so far: nothing, ``s``, ``...u`` or ``...a``.  Its
arcs are D (the row goes), I (a row comes before), K (the row stays) and R (it stays with the role that is due), each
with its own label, so a path is known by its audit.

After the cost DP only arcs of cheapest paths count.  Nodes are ranked by their least audits of length 1, and a rank
for length 2^(k+1) is that of the pair (rank of the node, rank of the node 2^k edits on), until every pointer has
reached the end of its lane.  The ranks choose each node's arc, and the doubled pointers give any step of the path.
"""

from __future__ import annotations

import numpy as np

LANE = 256
#: Positions of one batch, to bound memory.
BATCH = 1 << 15
#: States: nothing yet, after the system row, after a user row, after an assistant row.
STATES = 4
#: State after an inserted or rewritten row: the role that is due.
DUE = np.array([2, 2, 3, 2])
#: State after keeping a row, by state and initial (other, s, u, a); -1: not allowed.
KEPT = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])
#: Costs.
DELETE, INSERT, REROLE = 3, 2, 2
NEVER = np.int64(1) << 60
#: Cost of ending in a state without more rows: only whole pairs may end.
ENDS = np.array([0, NEVER, NEVER, 0])
#: Labels in ASCII order.
LABELS = np.frombuffer(b"\0DIKR", dtype=np.uint8)
END, D, I, K, R = range(5)


def _inserted(cost: np.ndarray) -> np.ndarray:
    """``cost`` to go per state (last axis) where up to two rows may be inserted first; more never pays."""
    once = cost[..., DUE]
    return np.minimum(np.minimum(cost, once + INSERT), once[..., DUE] + 2 * INSERT)


def matrices(code: np.ndarray, extra: np.ndarray, must: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Least cost of each lane from a state before to a state after it: ``[lane, before, after]``."""
    back = np.broadcast_to(np.where(np.eye(STATES, dtype=bool), 0, NEVER), (len(n), STATES, STATES)).copy()
    # axes: lane, state after, state before; walked from the last row to the first
    for t in range(code.shape[1] - 1, -1, -1):
        back = np.where((t < n)[:, None, None], _step(back, code[:, t], extra[:, t], must[:, t]), back)
    return np.minimum(back.transpose(0, 2, 1), NEVER)


def _options(go: np.ndarray, code: np.ndarray, extra: np.ndarray, must: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of deleting, keeping and rewriting a row, given the cost ``go[lane, ..., state]`` behind it."""
    shape = (len(code),) + (1,) * (go.ndim - 1)
    to = KEPT[:, code].T.reshape((len(code),) + (1,) * (go.ndim - 2) + (STATES,))
    shut = must.reshape(shape)
    kept = np.take_along_axis(go, np.broadcast_to(np.maximum(to, 0), go.shape), axis=-1) + extra.reshape(shape)
    return go + DELETE, np.where((to < 0) | shut, NEVER, kept), np.where(shut, NEVER, go[..., DUE] + REROLE + extra.reshape(shape))


def _step(go: np.ndarray, code: np.ndarray, extra: np.ndarray, must: np.ndarray) -> np.ndarray:
    gone, kept, new = _options(go, code, extra, must)
    return _inserted(np.minimum(np.minimum(gone, kept), new))


def _costs(code: np.ndarray, extra: np.ndarray, must: np.ndarray, n: np.ndarray, exits: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Cost to go of every node, ``[lane, position, state]``; rows may be inserted behind the ``last`` lanes only."""
    lanes, wide = code.shape
    go = np.empty((lanes, wide + 1, STATES), dtype=np.int64)
    go[:, wide] = np.where(last[:, None], _inserted(exits), exits)
    for t in range(wide - 1, -1, -1):
        row = _step(go[:, t + 1], code[:, t], extra[:, t], must[:, t])
        go[:, t] = np.where((t < n)[:, None], row, go[:, wide])
    return np.minimum(go, NEVER)


def _arcs(go, code, extra, must, n, exits, last) -> tuple[np.ndarray, np.ndarray]:
    """Targets and validity of each node's cheapest arcs, by label: ``[node, label]``."""
    lanes, wide = code.shape
    at = np.arange(lanes * (wide + 1) * STATES).reshape(lanes, wide + 1, STATES)
    target = np.repeat(at[..., None], len(LABELS), axis=-1)
    valid = np.zeros(target.shape, dtype=bool)
    inside = np.arange(wide + 1)[None, :] < n[:, None]
    best = go < NEVER
    target[..., I] = at[:, :, DUE]
    comes = best & (go[:, :, DUE] + INSERT == go)
    behind = (np.arange(wide + 1)[None, :] == n[:, None]) & last[:, None]
    valid[..., I] = comes & (inside[..., None] | (behind[..., None] & (exits[:, None, :] > go)))
    here, there = go[:, :-1], go[:, 1:]
    ok = best[:, :-1] & inside[:, :-1, None]
    to = KEPT[np.arange(STATES)[None, None, :], code[:, :, None]]
    shut = must[:, :, None]
    keep_at = np.maximum(to, 0)
    more = extra[:, :, None]
    target[:, :-1, :, D] = at[:, 1:]
    valid[:, :-1, :, D] = ok & (there + DELETE == here)
    target[:, :-1, :, K] = np.take_along_axis(at[:, 1:], keep_at, axis=2)
    valid[:, :-1, :, K] = ok & ~shut & (to >= 0) & (np.take_along_axis(there, keep_at, axis=2) + more == here)
    target[:, :-1, :, R] = at[:, 1:][:, :, DUE]
    valid[:, :-1, :, R] = ok & ~shut & (there[:, :, DUE] + REROLE + more == here)
    return target.reshape(-1, len(LABELS)), valid.reshape(-1, len(LABELS))


def _ranked(target: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Rank of every node by its least audit, by doubling the length of what is compared."""
    ends = ~valid.any(axis=1)
    rank = np.where(ends, END, valid.argmax(axis=1)).astype(np.int64)  # the least label is the least audit of length 1
    pointer = target[np.arange(len(target)), rank]
    while not ends[pointer].all():
        pair = rank * (rank.max() + 1) + rank[pointer]
        rank = np.unique(pair, return_inverse=True)[1].reshape(-1)
        pointer = pointer[pointer]
    return rank


def _chosen(target: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Label of each node's arc on its least path, and its pointers 1, 2, 4, ... edits on."""
    rank = _ranked(target, valid)
    key = np.arange(len(LABELS))[None, :] * (rank.max() + 1) + rank[target]
    label = np.where(valid, key, np.iinfo(np.int64).max).argmin(axis=1)
    ends = ~valid.any(axis=1)
    label = np.where(ends, END, label)
    pointers = [target[np.arange(len(target)), label]]
    while not ends[pointers[-1]].all():
        pointers.append(pointers[-1][pointers[-1]])
    return label, pointers


class Paths:
    """Least cheapest paths through a batch of lanes, from any state before them."""

    def __init__(self, code, extra, must, n, exits, last):
        self.extra, self.n = extra, n
        self.lanes, self.wide = code.shape
        self.go = _costs(code, extra, must, n, exits, last)
        self.label, self.pointers = _chosen(*_arcs(self.go, code, extra, must, n, exits, last))

    def _node(self, entry: np.ndarray) -> np.ndarray:
        return np.arange(self.lanes) * (self.wide + 1) * STATES + entry

    def after(self, entry: np.ndarray) -> np.ndarray:
        """State behind each lane."""
        return self.pointers[-1][self._node(entry)] % STATES

    def edits(self, entry: np.ndarray) -> dict[str, np.ndarray]:
        """``[lane, position]``: label, state before it, number of rows inserted there and state of the first of them.

        Position ``n`` of a lane has what is inserted behind its last row.
        """
        steps = 1 << len(self.pointers)
        node = np.repeat(self._node(entry)[:, None], steps, axis=1)
        for k, pointer in enumerate(self.pointers):
            on = (np.arange(steps) >> k) & 1 == 1
            node[:, on] = pointer[node[:, on]]
        label = self.label[node]
        state, position = node % STATES, node // STATES % (self.wide + 1)
        lane = np.broadcast_to(np.arange(self.lanes)[:, None], node.shape)
        shape = (self.lanes, self.wide + 1)
        out = {c: np.zeros(shape, dtype=np.int64) for c in ("label", "state", "inserted", "first")}
        row = (label != END) & (label != I)
        out["label"][lane[row], position[row]] = label[row]
        out["state"][lane[row], position[row]] = state[row]
        new = label == I
        np.add.at(out["inserted"], (lane[new], position[new]), 1)
        # the last assignment stays: from the last step to the first
        out["first"][lane[new][::-1], position[new][::-1]] = DUE[state[new][::-1]]
        return out
