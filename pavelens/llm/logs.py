"""Repair of live event logs: the cheapest edits that make every source's log well formed, found over persistent edit prefixes.

A well-formed log is empty, or at most one opening event and then pairs of a first and a second event. Edits of a prefix of
rows are a linked node that shares its own prefix with others, so two candidates of equal cost are compared without
writing them out.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, need, stage

#: Rows and bytes of messages at most that are repaired in one piece; longer logs are repaired in several that share their states.
BLOCK_ROWS = 4096
BLOCK_BYTES = 4 << 20
SPACE = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: What has been laid down of a log: nothing, the opening event, a first event, a whole pair.
START, OPENED, HALF, PAIRED = range(4)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
_MOD, _BASE = (1 << 61) - 1, 911_382_323
COUNTS = ["blank", "duplicate", "truncated", "illegal"]


@dataclass(frozen=True)
class LogForm:
    """Event types of a well-formed log and the cost of each edit. Types are told apart by their first character."""

    opening: str = "health_report"
    first: str = "update"
    second: str = "complete"
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def __post_init__(self) -> None:
        if len({self.opening[:1], self.first[:1], self.second[:1]}) < 3 or min(self.rerole, self.delete, self.insert) < 1 or self.truncated < 0:
            raise ValueError("types need different first characters, edits other than keeping a positive cost")

    def legal(self, a: str, b: str) -> bool:
        o, f, s = self.opening[0], self.first[0], self.second[0]
        return (a, b) in ((o, f), (f, s), (s, f))


class Prefixes:
    """Edit prefixes as linked nodes with binary-lifting ancestors and rolling hashes.

    Node 0 is the empty prefix. Hashes only say where to look: prefixes that they call equal are verified edit by edit, and
    nodes once found equal are joined, so that all verifications of a log walk each node a bounded number of times.
    """

    def __init__(self, base: int = _BASE, mod: int = _MOD) -> None:
        self.edit, self.depth, self.hash, self.up, self._same = [""], [0], [0], [()], [0]
        self._base, self._mod = base, mod

    def add(self, parent: int, edit: str) -> int:
        ups, k = [parent], 0
        while len(self.up[ups[k]]) > k:
            ups.append(self.up[ups[k]][k])
            k += 1
        self.edit.append(edit)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * self._base + ord(edit)) % self._mod)
        self.up.append(ups)
        self._same.append(len(self._same))
        return len(self.edit) - 1

    def lift(self, node: int, depth: int) -> int:
        """The prefix of ``depth`` edits of ``node``."""
        far, k = self.depth[node] - depth, 0
        while far:
            if far & 1:
                node = self.up[node][k]
            far >>= 1
            k += 1
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def compare(self, a: int, b: int) -> int:
        """Below, at or above 0 as the edits of ``a`` come before, equal or come after those of ``b``; a prefix comes first."""
        short = min(self.depth[a], self.depth[b])
        x, y = self.lift(a, short), self.lift(b, short)
        if self.hash[x] == self.hash[y]:
            return self.depth[a] - self.depth[b] if self._equal(x, y) else self._plain(a, b)
        for k in reversed(range(len(self.up[x]))):  # up to the first difference: its parents agree
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if not self._equal(self.up[x][0], self.up[y][0]):
            return self._plain(a, b)
        return -1 if self.edit[x] < self.edit[y] else 1

    def _root(self, x: int) -> int:
        while self._same[x] != x:
            self._same[x] = self._same[self._same[x]]
            x = self._same[x]
        return x

    def _equal(self, x: int, y: int) -> bool:
        walked = []
        while self._root(x) != self._root(y):
            if self.edit[x] != self.edit[y]:
                return False
            walked.append((x, y))
            x, y = self.up[x][0], self.up[y][0]
        for a, b in walked:
            self._same[self._root(a)] = self._root(b)
        return True

    def _plain(self, a: int, b: int) -> int:
        s, t = self.text(a), self.text(b)
        return (s > t) - (s < t)


States = list[tuple[int, int] | None]


def _better(nodes: Prefixes, old: tuple[int, int] | None, cost: int, parent: int, edit: str) -> tuple[int, int]:
    """The cheaper of ``old`` and a further edit, the one whose edits come first if they cost the same."""
    if old is not None and old[0] < cost:
        return old
    node = nodes.add(parent, edit)
    if old is not None and old[0] == cost and nodes.compare(old[1], node) <= 0:
        return old
    return cost, node


def _inserted(states: States, nodes: Prefixes, form: LogForm) -> States:
    """States that inserted events reach as well. More than two in a row are never cheapest."""
    out = list(states)
    for a, b in ((START, HALF), (OPENED, HALF), (PAIRED, HALF), (HALF, PAIRED)):
        if out[a] is not None and (out[b] is None or out[a][0] + form.insert <= out[b][0]):
            out[b] = _better(nodes, out[b], out[a][0] + form.insert, out[a][1], INSERT)
    return out


def edit_rows(initials: str, faults: bytes, nodes: Prefixes, form: LogForm, states: States) -> States:
    """States after all rows, each with its cheapest edits; events are inserted before rows, not behind the last."""
    o, f, s = form.opening[0], form.first[0], form.second[0]
    for initial, fault in zip(initials, faults):
        states = _inserted(states, nodes, form)
        after: States = [None] * 4
        for k in range(4):
            if states[k] is not None:
                after[k] = (states[k][0] + form.delete, nodes.add(states[k][1], DELETE))
        if fault not in (BLANK, DUPLICATE):
            extra = form.truncated if fault == TRUNCATED else 0
            if initial == o and states[START] is not None:
                after[OPENED] = _better(nodes, after[OPENED], states[START][0] + extra, states[START][1], KEEP)
            for a, b, role in ((START, HALF, f), (OPENED, HALF, f), (PAIRED, HALF, f), (HALF, PAIRED, s)):
                if states[a] is not None:
                    cost, edit = (0, KEEP) if initial == role else (form.rerole, REROLE)
                    after[b] = _better(nodes, after[b], states[a][0] + extra + cost, states[a][1], edit)
        states = after
    return states


def finish(states: States, nodes: Prefixes, form: LogForm) -> tuple[int, str]:
    """Cost and edits of the cheapest well-formed log."""
    states = _inserted(states, nodes, form)
    best = states[START]
    for k in (START, PAIRED):
        if states[k] is not None and (best is None or states[k][0] < best[0] or (states[k][0] == best[0] and nodes.compare(states[k][1], best[1]) < 0)):
            best = states[k]
    return best[0], nodes.text(best[1])


def repaired(edits: str, start: int, kinds: list[str], messages: list[str], form: LogForm) -> tuple[list[str], list[str]]:
    """Types and messages that ``edits`` leave, from the state ``start`` on."""
    out: tuple[list[str], list[str]] = ([], [])
    at, state = 0, start
    for e in edits:
        if e == DELETE:
            at += 1
            continue
        expected = form.second if state == HALF else form.first
        kind = kinds[at] if e == KEEP else expected
        out[0].append(kind)
        out[1].append("" if e == INSERT else messages[at])
        at += e != INSERT
        state = OPENED if kind[0] == form.opening[0] else HALF if kind[0] == form.first[0] else PAIRED
    return out


def _fault(message: Column) -> Column:
    ends = F.right(F.rtrim(message, F.lit(SPACE)), F.lit(1))
    return F.when(ends == "", BLANK).when(~ends.isin(*STOPS), TRUNCATED).otherwise(FINE).cast("tinyint")


def _mark_repeats(kinds: list[str], messages: list[str], faults: list[int], seen: list[int] | None) -> tuple[bytes, dict]:
    """Faults with repeats inside the piece and at the places ``seen``, and the first place of every distinct event."""
    earlier: dict[tuple[str, str], int] = {}
    out = bytearray(faults)
    before = set(seen or ())
    for i, key in enumerate(zip(kinds, messages)):
        first = earlier.setdefault(key, i)
        if out[i] != BLANK and (first != i or first in before):
            out[i] = DUPLICATE
    return bytes(out), earlier


def _pieces(rows: DataFrame) -> DataFrame:
    """One row per piece of a log, in order of ``_at``. ``_edge``: further pieces of the same log may be in other rows."""
    kind = rows.schema["_source"].dataType.simpleString()
    columns = ["_order", "_kind", "_message", "_fault"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 33
        tail: pa.Table | None = None
        fresh, began = True, False  # at the task's first log; the tail's log has pieces that are out already

        def lists(table: pa.Table, cuts: list[int], edges: list[bool]) -> pa.RecordBatch:
            nonlocal place
            off = pa.array(cuts, pa.int32())
            ats = pa.array(range(place, place + len(edges)), pa.int64())
            place += len(edges)
            flat = [table.column(c).combine_chunks() for c in columns]
            flat = [c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks else c for c in flat]
            source = table.column("_source").combine_chunks().take(pa.array(cuts[:-1], pa.int64()))
            source = source.chunk(0) if isinstance(source, pa.ChunkedArray) else source
            return pa.RecordBatch.from_arrays([source, ats, pa.array(edges), *[pa.ListArray.from_arrays(off, c) for c in flat]], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if tail is not None:
                table = pa.concat_tables([tail, table]).combine_chunks()
            code = table.column("_source").combine_chunks()
            code = (code.chunk(0) if isinstance(code, pa.ChunkedArray) else code).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            heads = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), table.num_rows]
            size = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(table.column("_message"))))])
            cuts, edges = [0], []
            for n, (lo, hi) in enumerate(zip(heads[:-1], heads[1:])):
                last, parts = hi == table.num_rows, 0
                while hi - lo > BLOCK_ROWS or (hi - lo > 1 and size[hi] - size[lo] > BLOCK_BYTES):
                    lo = max(lo + 1, min(lo + BLOCK_ROWS, int(np.searchsorted(size, size[lo] + BLOCK_BYTES, side="right")) - 1))
                    cuts.append(lo)
                    edges.append(True)
                    parts += 1
                if not last:  # the last log goes on in the next batch, or is an edge of the task
                    cuts.append(hi)
                    edges.append((fresh and n == 0) or parts > 0 or (n == 0 and began))
                else:
                    began = parts > 0 or (began and n == 0)
                    fresh = fresh and n == 0
            if edges:
                yield lists(table, cuts, edges)
            tail = table.slice(cuts[-1])
        if tail is not None and tail.num_rows:
            yield lists(tail.combine_chunks(), [0, tail.num_rows], [True])

    names = ["_source", "_at", "_edge", "_orders", "_kinds", "_messages", "_faults"]
    ranged = rows.repartitionByRange("_source", "_order", "_kind", F.substring("_message", 1, 32)).sortWithinPartitions("_source", "_order", "_kind", "_message")
    return ranged.mapInArrow(cut, f"_source {kind}, _at bigint, _edge boolean, _orders array<bigint>, _kinds array<string>, _messages array<string>, _faults array<tinyint>")


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same pieces, about ``BLOCK_BYTES`` of messages at a time."""
    for batch in batches:
        lists = batch.column("_messages")
        size = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(lists.flatten())))])
        ends = size[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])]
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BLOCK_BYTES, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _narrow(edges: DataFrame) -> DataFrame:
    """Of pieces that may have neighbours: what decides their edits, without messages."""
    kind = edges.schema["_source"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some(batches):
            out: list[list] = [[], [], [], []]
            for kinds, messages, faults in zip(*(batch.column(c).to_pylist() for c in ("_kinds", "_messages", "_faults"))):
                marks, first = _mark_repeats(kinds, messages, faults, None)
                out[0].append("".join(k[0] for k in kinds))
                out[1].append(marks)
                out[2].append([hashlib.sha256(f"{len(k)}:{k}{m}".encode()).digest() for k, m in first])
                out[3].append(list(first.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_source"), batch.column("_at"), pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.binary())), pa.array(out[3], pa.list_(pa.int32()))],
                ["_source", "_at", "_initials", "_marks", "_events", "_places"],
            )

    return edges.mapInArrow(run, f"_source {kind}, _at bigint, _initials string, _marks binary, _events array<binary>, _places array<int>")


def _seen(narrow: DataFrame) -> DataFrame:
    """(_at, _seen): places of each piece whose event stands in an earlier piece of the same log."""
    each = narrow.select("_source", "_at", F.explode(F.arrays_zip("_events", "_places")).alias("_e")).select("_source", "_at", F.col("_e._events").alias("_event"), F.col("_e._places").alias("_place"))
    first = each.groupBy(F.col("_source").alias("_s"), F.col("_event").alias("_v")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    later = each.join(first, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_event") == F.col("_v"))).where("_at > _first")
    return later.groupBy("_at").agg(F.collect_list("_place").alias("_seen"))


def _paths(narrow: DataFrame, form: LogForm) -> DataFrame:
    """(_at, _start, _end, _tail, _illegal): between which states each piece is repaired, edits behind it, and an illegal pair at its start.

    Every piece gives cost and order of its edits between any two states; a log's pieces are then folded in order. No edits of a piece are a prefix of
    others between the same states and cost the same, so their order alone decides ties of whole logs.
    """
    kind = narrow.schema["_source"].dataType.simpleString()

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for initials, marks, places in zip(*(batch.column(c).to_pylist() for c in ("_initials", "_marks", "_seen"))):
                faults = _with_seen(marks, places)
                costs, ranks = [], []
                for k in range(4):
                    nodes = Prefixes()
                    begin: States = [None] * 4
                    begin[k] = (0, 0)
                    ends = edit_rows(initials, faults, nodes, form, begin)
                    order = sorted((j for j in range(4) if ends[j] is not None), key=cmp_to_key(lambda x, y: nodes.compare(ends[x][1], ends[y][1])))
                    costs += [-1 if e is None else e[0] for e in ends]
                    ranks += [order.index(j) if j in order else -1 for j in range(4)]
                out[0].append(costs)
                out[1].append(ranks)
                out[2].append(initials[0] + initials[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_source"), batch.column("_at"), pa.array(out[0], pa.list_(pa.int64())), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.string())],
                ["_source", "_at", "_costs", "_ranks", "_ends"],
            )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = None
        for batch in batches:
            for source, *piece in zip(*(batch.column(c).to_pylist() for c in ("_source", "_at", "_costs", "_ranks", "_ends"))):
                if log is None or source != log.source:
                    if log is not None:
                        yield from log.paths()
                    log = _Log(source, form)
                log.add(*piece)
        if log is not None:
            yield from log.paths()

    steps = narrow.mapInArrow(between, f"_source {kind}, _at bigint, _costs array<bigint>, _ranks array<int>, _ends string")
    return steps.repartition("_source").sortWithinPartitions("_source", "_at").mapInArrow(fold, "_at bigint, _start int, _end int, _tail string, _illegal bigint")


def _with_seen(marks: bytes, places: list[int] | None) -> bytes:
    out = bytearray(marks)
    for p in places or ():
        if out[p] != BLANK:
            out[p] = DUPLICATE
    return bytes(out)


class _Log:
    """Pieces of one log, taken in order: a few bytes per piece are held."""

    def __init__(self, source, form: LogForm) -> None:
        self.source, self.form = source, form
        self.cost: list[int | None] = [0, None, None, None]
        self.rank = [0, -1, -1, -1]
        self.at, self.before, self.illegal, self.last = array("q"), bytearray(), bytearray(), ""

    def add(self, at: int, costs: list[int], ranks: list[int], ends: str) -> None:
        new: list[int | None] = [None] * 4
        came = [0] * 4
        for j in range(4):
            for k in range(4):
                if self.cost[k] is None or costs[4 * k + j] < 0:
                    continue
                c = self.cost[k] + costs[4 * k + j]
                if new[j] is None or (c, self.rank[k]) < (new[j], self.rank[came[j]]):
                    new[j], came[j] = c, k
        order = sorted((j for j in range(4) if new[j] is not None), key=lambda j: (self.rank[came[j]], ranks[4 * came[j] + j]))
        self.rank = [order.index(j) if j in order else -1 for j in range(4)]
        self.cost = new
        self.at.append(at)
        self.before.extend(came)
        self.illegal.append(bool(self.last) and not self.form.legal(self.last, ends[0]))
        self.last = ends[1]

    def paths(self) -> Iterator[pa.RecordBatch]:
        behind = {START: "", PAIRED: "", HALF: INSERT, OPENED: INSERT * 2}
        ends = [j for j in range(4) if self.cost[j] is not None]
        state = min(ends, key=lambda j: (self.cost[j] + self.form.insert * len(behind[j]), self.rank[j]))
        n = len(self.at)
        start, end = np.empty(n, np.int32), np.empty(n, np.int32)
        tail = behind[state]
        for i in range(n - 1, -1, -1):
            end[i] = state
            state = self.before[4 * i + state]
            start[i] = state
        for lo in range(0, n, 10_000):
            hi = min(n, lo + 10_000)
            tails = [""] * (hi - lo)
            if hi == n:
                tails[-1] = tail
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.at[lo:hi], pa.int64()), pa.array(start[lo:hi]), pa.array(end[lo:hi]), pa.array(tails), pa.array(list(self.illegal[lo:hi]), pa.int64())],
                ["_at", "_start", "_end", "_tail", "_illegal"],
            )


def _solve(pieces: DataFrame, form: LogForm, source: str) -> DataFrame:
    """Repaired pieces. Those with ``_start`` are repaired between given states, the others from beginning to end."""
    kind = pieces.schema["_source"].dataType.simpleString()
    fields = f"`{source}` {kind}, piece bigint, whole boolean, orders struct<low:bigint,high:bigint,first:bigint,last:bigint,distinct:bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, kinds array<string>, messages array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some(batches):
            out: list[list] = [[] for _ in range(9)]
            columns = [batch.column(c).to_pylist() for c in ("_orders", "_kinds", "_messages", "_faults", "_seen", "_start", "_end", "_tail", "_illegal")]
            for orders, kinds, messages, faults, seen, start, end, tail, illegal in zip(*columns):
                marks, _ = _mark_repeats(kinds, messages, faults, seen)
                initials = "".join(k[0] for k in kinds)
                nodes = Prefixes()
                if start is None:
                    cost, edits = finish(edit_rows(initials, marks, nodes, form, [(0, 0), None, None, None]), nodes, form)
                else:
                    begin: States = [None] * 4
                    begin[start] = (0, 0)
                    cost, node = edit_rows(initials, marks, nodes, form, begin)[end]
                    cost, edits = cost + form.insert * len(tail), nodes.text(node) + tail
                known = [x for x in orders if x is not None]
                out[0].append({"low": min(known), "high": max(known), "first": known[0], "last": known[-1], "distinct": len(set(known))} if known else None)
                for i, fault in enumerate((BLANK, DUPLICATE, TRUNCATED), 1):
                    out[i].append(marks.count(fault))
                out[4].append(sum(not form.legal(a, b) for a, b in zip(initials, initials[1:])) + (illegal or 0))
                out[5].append(cost)
                out[6].append(edits)
                now = repaired(edits, start or START, kinds, messages, form)
                out[7].append(now[0])
                out[8].append(now[1])
            order = pa.struct([(n, pa.int64()) for n in ("low", "high", "first", "last", "distinct")])
            kinds_of = [order, *[pa.int64()] * 5, pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            whole = pc.is_null(batch.column("_start"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_source"), batch.column("_at"), whole, *[pa.array(o, t) for o, t in zip(out, kinds_of)]],
                [source, "piece", "whole", "orders", *COUNTS, "cost", "audit", "kinds", "messages"],
            )

    return pieces.mapInArrow(run, fields)


def repair_event_logs(
    events: DataFrame, source: str = "source", order: str = "event_time", kind: str = "type", message: str = "message", form: LogForm = LogForm()
) -> DataFrame:
    """Live event logs with the cheapest edits that make each source's log well formed: an opening event or none, then pairs of a first and a second event.

    A source's events are taken by ``order`` (nulls first, then by ``kind`` and ``message``); an ``order`` that is a time counts in whole seconds. Each event's first fault counts: *blank*
    (no visible character), *duplicate* (the same kind and message stood earlier), *truncated* (its last visible character is not one of ``.!?``). Edits per event: keep (K), give it
    the kind that is due (R), delete (D, needed for blank and duplicate ones), insert an event without message before it or at the end (I); ``form`` has kinds and costs, a truncated event that stays costs
    more. Of the cheapest edits those come first in ASCII order win.

    Returns one row per piece of a log, which is the whole log (``whole``) unless it may be longer than a block or stands at a task's border: ``source``, ``piece`` (long, ascending along the log), ``orders``
    (lowest, highest, first and last ``order``, distinct ones), ``blank``, ``duplicate``, ``truncated``, ``illegal`` (neighbours whose kinds may not follow each other), ``cost`` (long), ``audit`` (edits), and
    the repaired ``kinds`` and ``messages``. ``audit_event_logs`` gives one row per source, ``repaired_events`` one per event.

    How: events are dealt by ranges of (source, order), so no log has to fit a task. A piece's edits are found over shared prefixes with binary-lifting ancestors and rolling hashes; ties
    of cost are decided by the longest common prefix. Pieces of one log are joined through the cost and order of their edits between any two states.

    A null or empty kind counts as one space and so does a null message; a null source is a source of its own; repeated rows are repeated events; an empty table gives none; further
    columns are ignored. The project logs jobs, not talks: with other kinds in ``form`` the same repair serves any two parties that take turns.
    """
    free(source, "piece", "whole", "orders", *COUNTS, "cost", "audit", "kinds", "messages")
    rows = need(events, source, order, kind, message)
    text = F.coalesce(F.col(f"`{message}`"), F.lit(" "))
    role = F.coalesce(F.col(f"`{kind}`").cast("string"), F.lit(" "))
    rows = rows.select(F.col(f"`{source}`").alias("_source"), F.col(f"`{order}`").cast("bigint").alias("_order"), F.when(role == "", " ").otherwise(role).alias("_kind"), text.alias("_message"), _fault(text).alias("_fault"))
    pieces = stage(_pieces(rows), "logs")
    edges = pieces.where("_edge")
    narrow = stage(_narrow(edges), "log-edges")
    seen = stage(_seen(narrow), "log-repeats")
    paths = _paths(narrow.join(seen, "_at", "left"), form)
    settled = paths.join(seen, "_at", "left")
    nothing = {"_seen": "array<int>", "_start": "int", "_end": "int", "_tail": "string", "_illegal": "bigint"}
    alone = pieces.where("not _edge").select("*", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    return stage(_solve(alone, form, source).unionByName(_solve(edges.join(settled, "_at"), form, source)), "repaired-logs")


def audit_event_logs(pieces: DataFrame, source: str = "source", of: DataFrame | None = None) -> DataFrame:
    """One row per source of ``repair_event_logs``: ``gaps`` (whole steps of ``order`` that are missing between the lowest and the highest), ``blank``, ``duplicate``,
    ``truncated``, ``illegal``, ``cost`` (long) and ``audit``, the edits of the whole log. Sources of ``of`` without events get zeros and no edits."""
    own = F.col(f"`{source}`")
    rows = pieces.select(own, "piece", "orders", *COUNTS, "cost", "audit")
    if of is not None:
        rows = rows.unionByName(of.select(own).distinct(), allowMissingColumns=True)
    # pieces come in order, so of the distinct orders only those at a border can be counted twice
    some = F.array_sort(F.collect_list(F.when(F.col("orders").isNotNull(), F.struct("piece", "orders"))))
    twice = F.aggregate(some, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("last")),
                        lambda a, p: F.struct((a["n"] + (a["last"].eqNullSafe(p["orders"]["first"]) & a["last"].isNotNull()).cast("bigint")).alias("n"), p["orders"]["last"].alias("last")))["n"]
    edits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda p: F.coalesce(p["audit"], F.lit(""))), "")
    gaps = F.max("orders.high") - F.min("orders.low") + 1 - F.sum("orders.distinct") + twice
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return rows.groupBy(own).agg(zero(gaps).alias("gaps"), *[zero(F.sum(c)).alias(c) for c in [*COUNTS, "cost"]], edits.alias("audit"))


def repaired_events(pieces: DataFrame, source: str = "source", kind: str = "type", message: str = "message") -> DataFrame:
    """One row per event of the repaired logs, in order of (``piece``, ``place``) within a source."""
    each = pieces.select(f"`{source}`", "piece", F.posexplode(F.arrays_zip("kinds", "messages")).alias("place", "_e"))
    return each.select(f"`{source}`", "piece", "place", F.col("_e.kinds").alias(kind), F.col("_e.messages").alias(message))


def log_digests(pieces: DataFrame, source: str = "source") -> DataFrame:
    """(``source``, ``digest``): SHA-256 of each repaired log as lines ``kind:message``.

    A digest needs its bytes in order: whole logs are hashed where they are, pieces of longer ones stream sorted through the task of their source, which holds one piece.
    """
    own = F.col(f"`{source}`")
    lines = F.array_join(F.zip_with("kinds", "messages", lambda k, m: F.concat(k, F.lit(":"), m)), "\n")
    kind = pieces.schema[source].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest, began = None, None, False
        done: list = []

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], type_), pa.array([d[1] for d in done], pa.string())], [source, "digest"])
            done.clear()
            return got

        type_ = pa.null()
        for batch in batches:
            type_ = batch.column(source).type
            for own_, line, n in zip(*(batch.column(c).to_pylist() for c in (source, "_lines", "_n"))):
                if digest is None or own_ != name:
                    if digest is not None:
                        done.append((name, digest.hexdigest()))
                    name, digest, began = own_, hashlib.sha256(), False
                if n:
                    digest.update((("\n" if began else "") + line).encode())
                    began = True
            if done:
                yield out()
        if digest is not None:
            done.append((name, digest.hexdigest()))
            yield out()

    whole = pieces.where("whole").select(own, F.sha2(lines, 256).alias("digest"))
    parts = pieces.where("not whole").select(own, "piece", F.size("kinds").alias("_n"), lines.alias("_lines"))
    return whole.unionByName(parts.repartition(own).sortWithinPartitions(own, "piece").mapInArrow(run, f"`{source}` {kind}, digest string"))
