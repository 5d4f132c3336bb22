"""Byte-pair encoding by a pair occurrence index, and packing-ready token ids.

``PairIndexEncoder`` encodes the distinct words of a block of texts together. Every adjacent symbol pair that
has a merge rank is mapped to all its positions in the block; active ranks are taken in ascending order from a
heap, all positions of a rank are merged at once, and the lists of the neighbouring pairs are updated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tokenizer_path


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return out


#: Control characters that Python takes for white space and the vocabulary's patterns do not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
WHITE_SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


class ChunkRows(dict):
    """Chunk -> row number; a chunk not seen before gets the next number and is noted in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, chunk):
        row = self[chunk] = len(self)
        self.new.append(chunk)
        return row


class Ragged:
    """Rows of different lengths, end to end in one array that doubles when full."""

    def __init__(self, kind):
        self.data, self.used = np.empty(1 << 16, kind), 0
        self.start, self.length, self.n = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), 0

    @staticmethod
    def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
        if used + more <= len(array):
            return array
        grown = np.empty(max(2 * len(array), used + more), array.dtype)
        grown[:used] = array[:used]
        return grown

    def extend(self, data: np.ndarray, lengths) -> None:
        n = len(lengths)
        self.data = self._room(self.data, self.used, len(data))
        self.start, self.length = self._room(self.start, self.n, n), self._room(self.length, self.n, n)
        self.data[self.used : self.used + len(data)] = data
        self.length[self.n : self.n + n] = lengths
        ends = np.cumsum(self.length[self.n : self.n + n])
        self.start[self.n : self.n + n] = self.used + ends - self.length[self.n : self.n + n]
        self.used, self.n = self.used + len(data), self.n + n

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The given rows one after another."""
        length = self.length[rows]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return self.data[np.arange(total) + np.repeat(self.start[rows] - ends + length, length)]


class PairIndexEncoder:
    """A word-level BPE with an end-of-word suffix, as a ``tokenizers`` file describes it.

    ``encode`` gives ids, ``decode_word`` the tokens joined by a space, which is how a file without a decoder
    decodes."""

    def __init__(self, path: str, cache_chunks: int = 600_000):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.n = max(self.tokens) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [(self.vocab[a] * self.n + self.vocab[b], self.vocab[a + b]) for a, b in pairs]
        keys = np.array([k for k, _ in ids], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys = keys[order]
        self.pair_rank = order.astype(np.int64)
        self.merged = np.array([m for _, m in ids], dtype=np.int64)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.white = regex.compile(WHITE_SPACE)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        alphabet = byte_alphabet()
        missing = -1
        self.inner = np.array([self.vocab.get(c, missing) for c in alphabet], dtype=np.int64)
        self.last = np.array([self.vocab.get(c + self.suffix, missing) for c in alphabet], dtype=np.int64)
        self.special_ids = set(self.special.values())
        spelled = [self.tokens.get(i, "") + " " for i in range(self.n)]
        spelled = [x.encode("utf-8") for x in spelled]
        self.spelled = Ragged(np.uint8)
        self.spelled.extend(np.frombuffer(b"".join(spelled), np.uint8), [len(x) for x in spelled])
        self.cache_chunks = cache_chunks
        self.forget()

    def forget(self) -> None:
        """Empty the cache. It maps a chunk (what stands between white space) to a row of ids."""
        self.rows, self.word_rows = ChunkRows(), ChunkRows()
        self.chunk_ids, self.word_ids = Ragged(np.uint32), Ragged(np.uint32)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], -1)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the start of each."""
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        lens = np.array([len(w) for w in words], dtype=np.int64)
        word = np.repeat(np.arange(len(words)), lens)
        ends = np.cumsum(lens)[lens > 0]
        lens = lens[lens > 0]
        sym = self.inner[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        size = len(sym)
        nxt = np.arange(1, size + 1)
        nxt[ends - 1] = -1
        prv = np.arange(-1, size - 1)
        prv[ends - lens] = -1
        alive = np.ones(size, dtype=bool)
        # The index: rank -> arrays of left positions. Stale positions are filtered when their rank comes up.
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(left: np.ndarray) -> None:
            if not len(left):
                return
            rank = self._ranks(sym[left], sym[nxt[left]])
            left, rank = left[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            left, rank = left[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate(([0], cuts))].tolist() if len(rank) else [], np.split(left, cuts)):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        add(np.flatnonzero(nxt >= 0))
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            left = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            left = left[alive[left]]
            left = left[nxt[left] >= 0]
            if not len(left):
                continue
            left = left[self._ranks(sym[left], sym[nxt[left]]) == r]
            if not len(left):
                continue
            right = nxt[left]
            if len(left) > 1 and (sym[left[0]] == sym[right[0]]):  # runs of one symbol merge from the left
                left = np.sort(left)
                taken = set()
                for p, q in zip(left.tolist(), nxt[left].tolist()):
                    if p not in taken:
                        taken.add(q)
                left = left[~np.isin(left, np.fromiter(taken, np.int64, len(taken)))]
                right = nxt[left]
            sym[left] = self.merged[r]
            alive[right] = False
            after = nxt[right]
            nxt[left] = after
            inside = after >= 0
            prv[after[inside]] = left[inside]
            before = prv[left]
            before = before[before >= 0]
            add(np.unique(np.concatenate((left[inside], before))) if len(left) > 1 else np.concatenate((left[inside], before)))
        keep = alive & (sym >= 0)
        counts = np.bincount(word[keep], minlength=len(words))
        return sym[keep], np.concatenate(([0], np.cumsum(counts)))

    def learn(self) -> None:
        """Encode the chunks that came up since the last call: their distinct words go through one pair index."""
        new, self.rows.new = self.rows.new, []
        if not new:
            return
        findall = self.words.findall
        split = [(c,) if isinstance(c, int) else findall(c) for c in new]
        rows = np.fromiter(map(self.word_rows.__getitem__, chain.from_iterable(split)), np.int64)
        words, self.word_rows.new = self.word_rows.new, []
        ids, starts = self.merge_words([b"" if isinstance(w, int) else w.encode("utf-8") for w in words])
        if not self.special_ids.isdisjoint(words):
            at = [i for i, w in enumerate(words) if isinstance(w, int)]
            ids = np.insert(ids, starts[at], [words[i] for i in at])
            starts = starts + np.searchsorted(at, np.arange(len(starts)))
        self.word_ids.extend(ids, np.diff(starts))
        ends = np.cumsum([len(found) for found in split])
        lengths = np.concatenate(([0], np.cumsum(self.word_ids.length[rows])))[np.concatenate(([0], ends))]
        self.chunk_ids.extend(self.word_ids.take(rows), np.diff(lengths))

    def normalize(self, text: str) -> str:
        """NFC and lower case, character by character (so no final sigma); white space only separates words."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")
        return text.lower()

    def pieces(self, text: str) -> list[tuple[str, int]]:
        """(text, -1) between special tokens, ("", id) for each of them."""
        if "<|" not in text:
            return [(text, -1)]
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [(text[at : m.start()], -1), ("", self.special[m.group()])]
            at = m.end()
        return [*out, (text[at:], -1)]

    def split(self, text: str) -> list[str | int]:
        """The chunks of a text, special tokens as their ids."""
        found: list[str | int] = []
        for part, special in self.pieces(text):
            if special >= 0:
                found.append(special)
            else:
                part = self.normalize(part)
                found += part.split() if not any(c in part for c in SEPARATORS) else filter(None, self.white.split(part))
        return found

    def encode_block(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Of each text: ids as little-endian unsigned 32-bit integers, and the decoded text in UTF-8."""
        if len(self.rows) > self.cache_chunks:
            self.forget()
        row = self.rows.__getitem__
        found = [np.fromiter(map(row, self.split(t)), np.int64) for t in texts]
        self.learn()
        out = []
        for rows in found:
            ids = self.chunk_ids.take(rows)
            out.append((ids.astype("<u4").tobytes(), self.spelled.take(ids).tobytes()[:-1]))
        return out


_encoders: dict[str, PairIndexEncoder] = {}


def encoder(path: str) -> PairIndexEncoder:
    if path not in _encoders:
        _encoders[path] = PairIndexEncoder(path)
    return _encoders[path]


def bpe_encode(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", digest: bool = False, block_chars: int = 16_000_000) -> DataFrame:
    """Encode and decode every row's whole text; null text is empty.

    Returns ``doc_id``, ``n_tokens`` and either ``ids`` (array of int) and ``decoded``, or with ``digest`` their
    SHA-256. Texts are taken in blocks of about ``block_chars`` characters of one partition, so memory follows the
    block and not the partition. Repeated rows give repeated results; other columns are ignored.
    """
    kind = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"

    def run(batches):
        import pyarrow as pa

        enc = encoder(tokenizer_path(vocabulary))

        def done(ids, texts):
            got = enc.encode_block(texts)
            n = pa.array([len(raw) // 4 for raw, _ in got], pa.int64())
            if digest:
                cols = [pa.array([hashlib.sha256(raw).hexdigest() for raw, _ in got]), pa.array([hashlib.sha256(d).hexdigest() for _, d in got])]
            else:
                cols = [pa.array([np.frombuffer(raw, "<u4").astype(np.int32) for raw, _ in got], pa.list_(pa.int32())), pa.array([d.decode() for _, d in got])]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), n, *cols], names=["doc_id", "n_tokens", *[c.split(" ")[0] for c in kind.split(", ")]])

        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(t or "")
                held += len(texts[-1])
                if held >= block_chars:
                    yield done(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield done(ids, texts)

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id long, n_tokens long, {kind}")
