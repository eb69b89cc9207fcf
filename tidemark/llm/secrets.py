"""Secret scans with one automaton for all rules (operator 9).

The rules are compiled on the driver into one minimal deterministic automaton
(a table of bounded size, broadcast). A task cuts its bytes into many lanes at
bytes over which no match goes, and moves all lanes one byte per step: one pass
over the bytes for all rules. Where a rule accepts, the rule's own automata go
over the stretch between two such bytes: backward once, which marks the places
where a match begins, and forward from those for exact spans: leftmost,
longest, not overlapping, per rule.

Null and empty texts have no spans. Repeated rows get a row each.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.automata import Automaton
from tidemark.llm.flat import blocks, over_texts

SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_spans bigint"
LANE = 256


@dataclass(frozen=True)
class Rule:
    """Matches shorter than ``least``, or with a value behind the first : or = shorter than ``value_least``, are void, though used up."""

    kind: str
    pattern: str
    base: bool = False
    least: int = 0
    value_least: int = 0


# Only the hex rule counts inside its pattern (every text has short runs); counters of several rules would multiply states.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, value_least=8),
    Rule("access", r"AKIA[A-Z0-9]+", True, least=16),
    Rule("hex", r"[0-9a-f]{32,}", True),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=24),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)


class Scanner:
    """All rules together, and each of them anchored."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.joint = Automaton.of([r.pattern for r in rules], searching=True)
        self.single = [_rows(Automaton.of([r.pattern], searching=False)) for r in rules]
        self.backward = [_rows(Automaton.of([r.pattern], searching=True, backward=True)) for r in rules]
        self.joint_rows = _rows(self.joint)

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], int]:
        """Stretches between resetting bytes (or row ends) in which rules accept, with a bit for each rule."""
        n = len(data)
        if not n:
            return {}
        resets = np.flatnonzero(self.joint.resets[data]) + 1
        k = np.searchsorted(resets, np.arange(LANE, n, LANE))
        cuts = np.unique(np.concatenate((offsets, resets[k[k < len(resets)]], [0, n])))
        starts, ends = cuts[:-1], cuts[1:]
        order = np.argsort(starts - ends, kind="stable")
        starts, length = starts[order], (ends - starts)[order]
        classes = self.joint.class_of[data].astype(np.int64)
        width = self.joint.table.shape[1]
        table, accepts = self.joint.table.reshape(-1) * width, np.repeat(self.joint.accepts, width)
        state = np.zeros(len(starts), np.int64)
        at, masks = [], []
        active = np.searchsorted(-length, -np.arange(length[0] + 1), "left")  # lanes longer than the step
        step = 0
        while step < length[0] and active[step] >= 24:
            m = active[step]
            now = table[state[:m] + classes[starts[:m] + step]]
            state[:m] = now
            mask = accepts[now]
            if mask.any():
                found = np.flatnonzero(mask)
                at.append(starts[found] + step)
                masks.append(mask[found])
            step += 1
        for lane in range(active[step] if step < length[0] else 0):  # few long lanes are left
            self._walk(data, int(starts[lane]) + step, int(starts[lane] + length[lane]), int(state[lane]) // width, at, masks)
        if not at:
            return {}
        at, masks = np.concatenate(at), np.concatenate(masks)
        edges = np.unique(np.concatenate((resets, offsets)))
        k = np.searchsorted(edges, at, "right")
        out: dict[tuple[int, int], int] = {}
        for lo, hi, mask in zip(edges[k - 1].tolist(), np.append(edges, n)[k].tolist(), masks.tolist()):
            out[lo, hi] = out.get((lo, hi), 0) | mask
        return out

    def _walk(self, data: np.ndarray, lo: int, hi: int, state: int, at: list, masks: list) -> None:
        rows, accepts, _ = self.joint_rows
        found, bits = [], []
        for i, b in enumerate(data[lo:hi].tobytes(), lo):
            state = rows[state][b]
            if accepts[state]:
                found.append(i)
                bits.append(accepts[state])
        if found:
            at.append(np.array(found))
            masks.append(np.array(bits))

    def spans(self, text: bytes, rule: int) -> list[tuple[int, int]]:
        """Leftmost longest matches of a rule that don't overlap."""
        back, begins, _ = self.backward[rule]
        state, starts = 0, []
        for i in range(len(text) - 1, -1, -1):
            state = back[state][text[i]]
            if begins[state]:
                starts.append(i)
        rows, accepts, dead = self.single[rule]
        least, value_least = self.rules[rule].least, self.rules[rule].value_least
        out, free = [], 0
        for at in reversed(starts):
            if at < free:
                continue
            state = 0
            for i in range(at, len(text)):
                state = rows[state][text[i]]
                if state == dead:
                    break
                if accepts[state]:
                    free = i + 1
            if free - at >= least and (not value_least or _value_length(text[at:free]) >= value_least):
                out.append((at, free))
        return out


def _rows(a: Automaton) -> tuple[list[list[int]], list[int], int]:
    return [row[a.class_of].tolist() for row in a.table], a.accepts.tolist(), a.dead


def _value_length(match: bytes) -> int:
    """Length of what stands behind the first : or =, spaces and a quote."""
    value = match[min(k for k in (match.find(b":"), match.find(b"=")) if k >= 0) + 1 :].lstrip(b" ")
    return len(value) - (value[:1] in (b'"', b"'"))


def scan_block(scanner: Scanner, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, rule, end) of each row of a block, in code points."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    hits = scanner.hits(data, offsets)
    if not hits:
        return out
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    for (lo, hi), mask in hits.items():
        row = int(np.searchsorted(offsets, lo, "right")) - 1
        text, base = data[lo:hi].tobytes(), points[offsets[row]]
        for rule in range(len(scanner.rules)):
            if mask >> rule & 1:
                out[row] += [(int(points[lo + a] - base), rule, int(points[lo + b] - base)) for a, b in scanner.spans(text, rule)]
    for spans in out:
        spans.sort()
    return out


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Spans of secrets per row of ``docs`` (``doc_id``, ``text``)."""
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(rules))
    kinds = [r.kind for r in rules]
    bases = [r.base for r in rules]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [x for _, _, data, offsets in blocks(batch.column("text")) for x in scan_block(shared.value, data, offsets)]
        told = [[f"{kinds[r]}:{a}:{b}" for a, r, b in x] for x in rows]
        base = [",".join(t for t, (_, r, _) in zip(ts, x) if bases[r]) for ts, x in zip(told, rows)]
        count = {k: [sum(kinds[r] == k for _, r, _ in x) for x in rows] for k in ("assign", "access", "hex")}
        return pa.RecordBatch.from_pydict(
            {"doc_id": batch.column("doc_id").cast(pa.int64())}
            | {f"n_{k}": pa.array(v, pa.int64()) for k, v in count.items()}
            | {
                "base_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()),
                "spans": pa.array([",".join(x) for x in told], pa.string()),
                "n_spans": pa.array([len(x) for x in rows], pa.int64()),
            }
        )

    return over_texts(docs, SCHEMA, work)
