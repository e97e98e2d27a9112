"""Cost-balanced packing of documents into fixed-length sequences.

A document's cost for a model is its length plus a quadratic attention term. Documents
go in descending order to the sequence of lowest cost that still has room for them, and are
cut only where none has enough. Whole-capacity parts of long documents are sequences of their own;
the rest is packed in groups of bounded size inside each input partition, so no row moves
between tasks. The last sequences of a group have power-of-two lengths that add up to what
is left over: those need no padding, so there is none at all.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import small_batches, text_or_empty
from .tokens import encoder


@dataclass(frozen=True)
class Packing:
    tokenizer: str
    capacity: int = 1024
    end_id: int = 0
    #: Attention cost of a piece of n tokens is n * n / quadratic, in units of one token's linear cost.
    quadratic: int = 6144
    #: Remainders packed together: bounds memory, and the sequences per group.
    group: int = 4096
    #: Pieces that a worker's tokenizer keeps; None for its own default.
    cache_pieces: int | None = None
    with_ids: bool = False
    #: Number a group's sequences, whole ones included, by the mean place of their tokens in the input.
    ordered: bool = False


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def capacities(total: int, capacity: int) -> list[int]:
    """Whole sequences, then powers of two for what is left: they sum to `total` exactly."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class _Rooms:
    """Sequences by the room they have; of those with enough of it the one of least cost, in time that grows with the capacity's logarithm."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.heaps: dict[int, list] = {}
        self.tree: list[tuple] = [_NONE] * (2 * self.leaves)

    def _renew(self, room: int) -> None:
        tree, k, heap = self.tree, room + self.leaves, self.heaps[room]
        tree[k] = heap[0] if heap else _NONE
        best = tree[k]
        while k > 1:
            beside = tree[k ^ 1]
            if beside < best:
                best = beside
            k >>= 1
            if tree[k] is best:
                break
            tree[k] = best

    def put(self, room: int, cost: float, sequence: int) -> None:
        if room:
            heapq.heappush(self.heaps.setdefault(room, []), (cost, sequence, room))
            self._renew(room)

    def take(self, need: int) -> tuple[float, int, int] | None:
        """(cost, sequence, room) of least cost among those with room for `need`; it is taken out."""
        tree = self.tree
        best = tree[1]  # often the one of least cost has room
        if best[2] < need:
            k = need + self.leaves
            best = tree[k]
            while k > 1:
                if not k & 1 and tree[k + 1] < best:
                    best = tree[k + 1]
                k >>= 1
        if best is _NONE:
            return None
        heapq.heappop(self.heaps[best[2]])
        self._renew(best[2])
        return best


_NONE = (math.inf, -1, 0)


def assign(lengths: list[int], p: Packing) -> list[tuple[int, int, int, int, int]]:
    """(item, from, length, sequence, offset) for every piece. All sequences end up full.

    Items go in descending order, equal ones in that of their numbers, to the sequence of least
    cost with room for all that is left of them, and are cut only where there is none."""
    cost = lambda n: n + n * n / p.quadratic
    used: dict[int, int] = defaultdict(int)
    rooms = _Rooms(p.capacity)
    # A short sequence starts with the cost of what it lacks, or it would draw the longest documents.
    for seq, room in enumerate(capacities(sum(lengths), p.capacity)):
        rooms.put(room, cost(p.capacity - room), seq)
    out = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at, left = 0, lengths[item]
        while left:
            spent, seq, room = (left <= p.capacity and rooms.take(left)) or rooms.take(1)
            n = min(left, room)
            out.append((item, at, n, seq, used[seq]))
            at, left = at + n, left - n
            used[seq] += n
            rooms.put(room - n, spent + cost(n), seq)
    return out


class _Packer:
    def __init__(self, p: Packing, partition: int):
        self.p, self.next = p, partition << 32
        self.rows: list[tuple] = []
        self.rest: list[tuple] = []
        #: For `ordered`: tokens read, where each of `rest` begins, and the group's rows until they get their numbers.
        self.read, self.begins, self.held = 0, [], []

    def add(self, doc_id, ids: np.ndarray, end: np.ndarray) -> None:
        # Little-endian ids are what the checksum is of.
        ids = np.concatenate((ids, end), dtype="<u4")
        whole = len(ids) // self.p.capacity * self.p.capacity
        for start in range(0, whole, self.p.capacity):
            self.put(doc_id, start, ids[start : start + self.p.capacity], len(ids), self.next, 0)
            self.next += 1
        if whole < len(ids):
            self.rest.append((doc_id, whole, ids[whole:].copy() if whole else ids, len(ids)))
            self.begins.append(self.read)
        self.read += len(ids)
        if max(len(self.rest), len(self.held)) >= self.p.group:
            self.close()

    def put(self, doc_id, start, ids, total, sequence, offset, begins=None) -> None:
        row = (doc_id, start, len(ids), zlib.crc32(ids), total, sequence, offset)
        row = (*row, ids.tolist()) if self.p.with_ids else row
        if self.p.ordered:
            self.held.append(((self.read if begins is None else begins) + start + len(ids) / 2, row))
        else:
            self.rows.append(row)

    def number(self) -> None:
        """Give the group's numbers anew, in the order of the mean place of each sequence's tokens."""
        weight: dict[int, list[float]] = {}
        for place, row in self.held:
            w = weight.setdefault(row[5], [0.0, 0])
            w[0], w[1] = w[0] + place * row[2], w[1] + row[2]
        order = sorted(weight, key=lambda seq: (weight[seq][0] / weight[seq][1], seq))
        name = dict(zip(order, sorted(weight)))
        self.rows += sorted(((*row[:5], name[row[5]], *row[6:]) for _, row in self.held), key=lambda row: row[5:7])
        self.held = []

    def close(self) -> None:
        last = -1
        for item, at, n, seq, offset in assign([len(x[2]) for x in self.rest], self.p):
            doc_id, start, ids, total = self.rest[item]
            self.put(doc_id, start + at, ids[at : at + n], total, self.next + seq, offset, self.begins[item])
            last = max(last, seq)
        self.next += last + 1
        self.rest, self.begins = [], []
        if self.p.ordered:
            self.number()

    def take(self, schema: pa.Schema):
        rows, self.rows = self.rows, []
        columns = list(zip(*rows)) if rows else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pack(docs: DataFrame, p: Packing) -> DataFrame:
    """One row per piece of a document; all its ids lie in exactly one piece.

    Null text counts as empty and is packed as its end id alone. Texts are taken whole, however
    long: their whole-capacity parts are sequences of their own. Rows that repeat a doc_id, or
    whole rows, are packed each; a null doc_id stays null. Documents of equal length go in the
    order in which they are read. Other columns, whatever their names, are not read. An empty
    table gives no rows. `with_ids` adds the ids themselves.
    """
    small_batches(docs.sparkSession)
    schema = SCHEMA + (", ids array<long>" if p.with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = pa.schema([(n, pa.list_(pa.int64()) if n == "ids" else pa.int64()) for n in names])

    def run(batches):
        end = np.array([p.end_id], "<u4")
        enc, packer = encoder(p.tokenizer, p.cache_pieces), _Packer(p, TaskContext.get().partitionId())
        for b in batches:
            for at in range(0, b.num_rows, 512):
                doc_ids, texts = (c.to_pylist() for c in b.slice(at, 512).columns)
                for doc_id, ids in zip(doc_ids, enc.ids(texts)):
                    packer.add(doc_id, ids, end)
                yield packer.take(arrow)
        packer.close()
        yield packer.take(arrow)

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), text_or_empty()).mapInArrow(run, schema)
