"""Harmonic packing of token sequences."""

from __future__ import annotations

import base64
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tokenizer_path

#: Smallest class that takes whole remainders: from here on a bin of k pieces wastes under 1/(k+1).
FINE_CLASS = 16


class ByteTokenizer:
    """Ids of a byte-level BPE vocabulary from its rank file; ids equal those of the ``tokenizers`` file of that name."""

    SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        parts = text.split(self.SPECIAL)
        out = [self.encoding.encode_to_numpy(parts[0], disallowed_special=())]
        for part in parts[1:]:
            out += [np.array([self.SPECIAL_ID], np.uint32), self.encoding.encode_to_numpy(part, disallowed_special=())]
        return out[0] if len(out) == 1 else np.concatenate(out)


_tokenizers: dict[str, ByteTokenizer] = {}


def byte_tokenizer(name: str) -> ByteTokenizer:
    """``name``: the .json vocabulary; the rank file beside it gives the same ids several times faster."""
    if name not in _tokenizers:
        from public_tokenizers import PATTERN

        _tokenizers[name] = ByteTokenizer(tokenizer_path(name.replace(".json", ".tiktoken")), PATTERN)
    return _tokenizers[name]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Pieces (length, class) of ``n`` tokens: whole bins, then pieces of exactly capacity // k tokens (class k),
    until what is left is small enough for a fine class to take whole."""
    pieces = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if k >= FINE_CLASS or capacity // k == rest:
            pieces.append((rest, k))
            break
        size = capacity // (k + 1)
        pieces.append((size, k + 1))
        rest -= size
    return pieces


class HarmonicPacker:
    """Bins of one worker: class k holds pieces of (capacity/(k+1), capacity/k] tokens, k to a bin."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}

    def sequence(self, pieces: list[tuple]) -> list[tuple]:
        """Rows of one closed bin."""
        out, at = [], 0
        for p in pieces:
            out.append((*p, self.next_id, at))
            at += p[2]
        self.next_id += 1
        return out

    def add(self, piece: tuple, k: int) -> list[tuple]:
        if k == 1:
            return self.sequence([piece])
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) < k:
            return []
        del self.open[k]
        return self.sequence(held)

    def finish(self) -> list[tuple]:
        """What stayed in open bins, at most one bin a class, is laid end to end and cut at the capacity."""
        out, row, room = [], [], self.capacity
        for k in sorted(self.open):
            for doc, start, length, ids, total in self.open[k]:
                while length:
                    take = min(length, room)
                    row.append((doc, start, take, ids[:take], total))
                    start, length, ids, room = start + take, length - take, ids[take:], room - take
                    if not room:
                        out += self.sequence(row)
                        row, room = [], self.capacity
        if row:
            out += self.sequence(row)
        self.open = {}
        return out


def harmonic_pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of all rows in sequences of at most ``capacity`` tokens; every worker packs its own partition.

    A row's ids are those of its text (null: empty) and ``end_id``. Returns ``doc_id``, ``start``, ``length``,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and, ``with_ids``, the ids. Nothing is shuffled: a
    worker closes a bin when its class has the full count of pieces, and lays what is left over end to end, so it
    leaves at most one part-filled mixed sequence. Sequence ids start at the partition's number times 2^33, so they
    are unique; a worker packs its rows in the order of id and text, so that they are the same again when a lost task
    is repeated, also where a shuffle hands it its rows in another order. Repeated rows are packed each; an empty table gives none.
    """
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        tok = byte_tokenizer(vocabulary)
        packer = HarmonicPacker(capacity, TaskContext.get().partitionId() << 33)
        end = np.array([end_id], np.uint32)

        def rows(closed):
            ids = [np.ascontiguousarray(r[3], dtype="<u4") for r in closed]
            col = lambda i: pa.array([r[i] for r in closed], pa.int64())
            cols = [col(0), col(1), col(2), pa.array([zlib.crc32(x) for x in ids], pa.int64()), col(4), col(5), col(6)]
            names = [f.split(" ")[0] for f in fields.split(", ")]
            if with_ids:
                cols, names = [*cols, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], [*names, "ids"]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            closed = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate((tok.ids(text), end)) if text else end
                at = 0
                for length, k in cut(len(ids), capacity):
                    closed += packer.add((doc, at, length, ids[at : at + length], len(ids)), k)
                    at += length
                if len(closed) >= 4096:
                    yield rows(closed)
                    closed = []
            if closed:
                yield rows(closed)
        last = packer.finish()
        if last:
            yield rows(last)

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(run, fields + (", ids array<int>" if with_ids else ""))
