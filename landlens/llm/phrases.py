"""Phrase collocations by Rabin-Karp fingerprints.

Texts are read in blocks of bytes. Prefix polynomials over the bytes give every word's fingerprint, prefix polynomials over
the words' fingerprints that of every n-gram, a few numpy steps a block each. A shuffle adds up the fingerprints, shorter
phrases first: a phrase can be frequent only if its parts are, so words that are not frequent take part in no pair, and pairs
that are not in no longer phrase. With its count each fingerprint carries an occurrence pointer, 16 bits of a hash of a text
that holds it, and 24 bits of a second polynomial. In a last reading only the texts that frequent fingerprints point to turn
phrases into strings. A fingerprint whose second polynomial differs between occurrences stands for several phrases: those
are compared with the text in every block and counted by the text itself.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stable import checkpoint
from .common import bit_filter, join_skewed, passes, small_batches

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
#: Bytes of a slice whose words are hashed at once, bytes of a block, and fingerprints that a task adds up before it hands
#: them on. Two tasks of an executor hold all of it at once, beside what each step makes anew of a block's size.
SLICE = 1 << 17
BLOCK = 1 << 20
HELD = 1 << 21

#: Classes of bytes: part of a word, blank between words, end of a piece.
WORD, BLANK, END = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t")] = BLANK
_CLASS[list(b".,;:!?\n\x0b\x0c\r")] = END
END_RX = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Odd bases of the two polynomials modulo 2^64.
BYTE_BASE, WORD_BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xA24BAED4963EE407


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... (n of them) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """Those of a slice are kept, those of a longer word are not."""
    return _powers(base, 2 * SLICE)[:n] if n <= 2 * SLICE else _powers.__wrapped__(base, n)


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    """``h`` with its bits spread; one to one."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def substrings(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of values[start:end] modulo 2^64, each from two prefixes of the polynomial."""
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * powers(inverse(base), len(values) + 1)[starts]


class Block:
    """Words of the texts of a batch: their bytes (``text[start:end]``, lower-case), row, piece and fingerprint."""

    def __init__(self, rows: list[bytes]):
        raw = np.frombuffer(b"\n".join(rows) + b"\n", np.uint8)
        self.text = _LOWER[raw]
        kind = _CLASS[raw]
        inside = np.concatenate(([False], kind == WORD, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        self.piece = np.searchsorted(np.flatnonzero(kind == END), self.start)
        self.row = np.searchsorted(np.cumsum([len(r) + 1 for r in rows]), self.start, "right")
        self.word, self.other = self.hash_words(BYTE_BASE), None

    def hash_words(self, base: int) -> np.ndarray:
        """A slice is cut before the first word that doesn't end in it; a longer word is a slice of its own."""
        out, at = np.empty(len(self.start), np.uint64), 0
        while at < len(self.start):
            low = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, low + SLICE, "right")))
            s, e = self.start[at:to] - low, self.end[at:to] - low
            h = substrings(self.text[low : self.end[to - 1]].astype(np.uint64) + np.uint64(1), base, s, e)
            out[at:to] = mixed(h + (e - s).astype(np.uint64))
            at = to
        return out

    def grams(self, n: int, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and fingerprint of every phrase of n words within a piece; ``salt`` has one number for each row."""
        first = np.arange(max(0, len(self.word) - n + 1))
        first = first[self.piece[first] == self.piece[first + n - 1]]
        if n == 1:
            return first, mixed(self.word[first] ^ salt[self.row[first]])
        out, at = np.empty(len(first), np.uint64), 0
        while at < len(first):
            low = first[at]
            to = int(np.searchsorted(first, low + SLICE, "left"))
            some = first[at:to] - low
            out[at:to] = substrings(self.word[low : low + some[-1] + n], WORD_BASE, some, some + n)
            at = to
        return first, mixed(out + np.uint64(n) ^ salt[self.row[first]])

    def second(self, first: np.ndarray, n: int, salt: np.ndarray) -> np.ndarray:
        """24 bits of another polynomial over the same bytes, for the phrases of n words from ``first`` on."""
        if self.other is None:
            self.other = self.hash_words(SECOND_BASE)
        out = ~salt[self.row[first]]
        for j in range(n):
            out = out * np.uint64(SECOND_BASE) + self.other[first + j]
        return mixed(out) >> np.uint64(40)

    def phrase(self, first: int, n: int) -> bytes:
        return b" ".join(self.text[s:e].tobytes() for s, e in zip(self.start[first : first + n].tolist(), self.end[first : first + n].tolist()))


def cut(text: bytes, most: int):
    """``text`` in parts of about ``most`` bytes, each ending where a piece does, so that no phrase is cut."""
    at = 0
    while len(text) - at > most and (end := END_RX.search(text, at + most)):
        yield text[at : end.end()]
        at = end.end()
    yield text[at:]


def _blocks(batches):
    """Blocks with, for each row, the language, its salt and a 16-bit mark of the text. A block has about BLOCK bytes, or
    one longer piece."""
    import pyarrow as pa
    import xxhash

    def block(texts, langs, marks):
        salt = {x: xxhash.xxh64_intdigest(x.encode("utf-8"), 7) for x in set(langs)}
        return Block(texts), langs, np.array([salt[x] for x in langs], np.uint64), np.array(marks, np.uint64)

    for b in batches:
        texts, langs, marks, size = [], [], [], 0
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            mark = xxhash.xxh64_intdigest(text or b"") & 0xFFFF
            for part in cut(text or b"", BLOCK):
                if texts and size + len(part) > BLOCK:
                    yield block(texts, langs, marks)
                    texts, langs, marks, size = [], [], [], 0
                texts.append(part)
                langs.append(lang)
                marks.append(mark)
                size += len(part)
        if texts:
            yield block(texts, langs, marks)


def candidates(block: Block, salt: np.ndarray, n: int, filters: list, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and fingerprint of the phrases of n words all of whose parts pass ``filters``: of the frequent words, then
    of the frequent pairs."""
    cut_to = np.uint64((1 << bits) - 1)
    first, fp = block.grams(n, salt)
    for m, held in enumerate(filters[: n - 1], 1):
        at, part = block.grams(m, salt)
        good = np.zeros(len(block.word) + 1, bool)
        good[at] = passes(held, (part & cut_to).view(np.int64))
        keep = np.ones(len(first), bool)
        for j in range(n - m + 1):
            keep &= good[first + j]
        first, fp = first[keep], fp[keep]
    return first, fp & cut_to


def added(parts: list) -> list:
    """Columns fingerprint, number and tail of ``parts``, which is emptied: each fingerprint and second polynomial once, with
    the sum of the numbers and the smallest tail."""
    columns = [np.concatenate([p[i] for p in parts]) for i in range(3)]
    parts.clear()
    order = np.argsort(columns[0])
    for i in range(3):
        columns[i] = columns[i][order]
    fp, n, tail = columns
    del order, columns
    new = np.ones(len(fp), bool)
    np.not_equal(fp[1:], fp[:-1], out=new[1:])
    at = np.flatnonzero(new)
    low = np.minimum.reduceat(tail, at)
    several = low >> 16 != np.maximum.reduceat(tail, at) >> 16
    if several.any():  # the rows of such fingerprints are put in order of their tails
        rows = np.flatnonzero(np.repeat(several, np.diff(np.append(at, len(fp)))))
        own = rows[np.lexsort((tail[rows], fp[rows]))]
        n[rows], tail[rows] = n[own], tail[own]
        new[rows[1:]] |= tail[rows[1:]] >> 16 != tail[rows[:-1]] >> 16
        at = np.flatnonzero(new)
        low = np.minimum.reduceat(tail, at)
    return [fp[at], np.add.reduceat(n, at), low]


def count_fingerprints(rows: DataFrame, sizes, filters: list, bits: int) -> DataFrame:
    """``fp``, ``n``, ``low``, ``high``: occurrences of the fingerprints of phrases of ``sizes`` words in
    ``rows(lang, text)``, from MIN_COUNT on, and the smallest and largest of their second polynomial's 24 bits followed by
    the 16-bit mark of the text."""

    def run(batches):
        import pyarrow as pa

        def handed(columns):
            for i in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)].view(np.int64)) for c in columns], names=["fp", "n", "tail"])

        parts, size, held = [], 0, [f.value for f in filters]
        for block, _, salt, mark in _blocks(batches):
            for k in sizes:
                first, fp = candidates(block, salt, k, held, bits)
                if len(first):
                    tail = block.second(first, k, salt) << np.uint64(16) | mark[block.row[first]]
                    parts.append(added([(fp, np.ones(len(fp), np.int64), tail)]))
                    size += len(parts[-1][0])
            if size > HELD:
                whole = added(parts)
                size = len(whole[0])
                if 2 * size > HELD:
                    yield from handed(whole)
                    size = 0
                else:
                    parts.append(whole)
                del whole
        if parts:
            yield from handed(added(parts))

    # A task has added up its own, so rows go to their fingerprint's partition as they are.
    counts = rows.mapInArrow(run, "fp long, n long, tail long").repartition("fp").groupBy("fp")
    return counts.agg(F.sum("n").alias("n"), F.min("tail").alias("low"), F.max("tail").alias("high")).where(F.col("n") >= MIN_COUNT)


def distinct_phrases(block: Block, first: np.ndarray, fp: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(first word of one occurrence, count) of each different phrase among the occurrences ``first`` with their ``fp``.

    Occurrences with one fingerprint are compared with the first of them, by length and bytes of each word; those that
    differ are taken apart by their text."""
    order = np.argsort(fp, kind="stable")
    first, fp = first[order], fp[order]
    new = np.concatenate(([True], fp[1:] != fp[:-1]))
    lead = first[np.flatnonzero(new)][np.cumsum(new) - 1]
    equal = np.ones(len(first), bool)
    size = block.end - block.start
    for j in range(n):
        equal &= size[first + j] == size[lead + j]
    for j in range(n):
        at = np.flatnonzero(equal)
        for i in range(0, len(at), 1 << 16):
            some = at[i : i + (1 << 16)]
            long = size[first[some] + j]
            inner = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
            same = block.text[np.repeat(block.start[first[some] + j], long) + inner] == block.text[np.repeat(block.start[lead[some] + j], long) + inner]
            equal[some] &= np.logical_and.reduceat(same, np.cumsum(long) - long)
    counts: dict[bytes, list[int]] = {}
    for i in np.flatnonzero(~equal).tolist():
        counts.setdefault(block.phrase(first[i], n), [int(first[i]), 0])[1] += 1
    lead_of, of = np.unique(lead[equal], return_counts=True)
    return [*zip(lead_of.tolist(), of.tolist()), *map(tuple, counts.values())]


def pointed(fp, mark):
    """Where a fingerprint and the mark of a text that holds it stand in a filter."""
    return mixed(fp ^ (mark + np.uint64(1)) * np.uint64(WORD_BASE)).view(np.int64)


def phrases_by_pointer(rows: DataFrame, counts: DataFrame, longest: int, filters: list, bits: int) -> tuple[DataFrame, DataFrame]:
    """(``lang, words, phrase, f`` of each fingerprint in ``counts``, from a text that it points to; ``lang, n``: all words).

    A text gives out the phrases that point to its mark, each once a task; the mark's 16 bits make that one text in 65,536."""

    def place(batches):
        import pyarrow as pa

        for b in batches:
            fp, low = (np.array(c, dtype=np.int64).view(np.uint64) for c in b.columns)
            yield pa.RecordBatch.from_arrays([pa.array(pointed(fp, low & np.uint64(0xFFFF)))], names=["h"])

    wanted = bit_filter(counts.select("fp", "low").mapInArrow(place, "h long"), "h")

    def run(batches):
        import pyarrow as pa

        seen: set[int] = set()
        held = [f.value for f in filters]
        for block, langs, salt, mark in _blocks(batches):
            at, total = np.unique(block.row, return_counts=True)
            sums: dict[str, int] = {}
            for r, c in zip(at.tolist(), total.tolist()):
                sums[langs[r]] = sums.get(langs[r], 0) + c
            out = [(None, x, 0, None, c) for x, c in sums.items()]
            for n in range(1, longest + 1):
                first, fp = candidates(block, salt, n, held, bits)
                hit = np.flatnonzero(passes(wanted.value, pointed(fp, mark[block.row[first]])))
                for i, h in zip(first[hit].tolist(), fp[hit].view(np.int64).tolist()):
                    if h not in seen:
                        seen.add(h)
                        out.append((h, langs[block.row[i]], n, block.phrase(i, n).decode("utf-8"), None))
            for i in range(0, len(out), 1 << 14):
                yield _batch(out[i : i + (1 << 14)], ["fp", "lang", "words", "phrase", "n"])
            if len(seen) > HELD >> 3:
                seen.clear()

    found = checkpoint(rows.mapInArrow(run, "fp long, lang string, words int, phrase string, n long"))
    once = found.where("words > 0").groupBy("fp").agg(F.min(F.struct("lang", "words", "phrase")).alias("p"))
    named = once.join(counts.select("fp", F.col("n").alias("f")), "fp").select("p.*", "f")
    return named, found.where("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))


def _batch(rows: list[tuple], names: list[str]):
    import pyarrow as pa

    kinds = {"fp": pa.int64(), "lang": pa.string(), "words": pa.int32(), "phrase": pa.string(), "n": pa.int64(), "f": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[x]) for c, x in zip(zip(*rows), names)], names=names)


def phrases_by_text(rows: DataFrame, counts: DataFrame, longest: int, filters: list, bits: int) -> DataFrame:
    """``lang, words, phrase, f`` of the phrases behind the fingerprints in ``counts``, counted by their text."""
    of_all = bit_filter(counts, "fp")

    def run(batches):
        def handed(found):
            out = [(lang, n, phrase.decode("utf-8"), c) for (lang, n), some in found.items() for phrase, c in some.items()]
            for i in range(0, len(out), 1 << 14):
                yield _batch(out[i : i + (1 << 14)], ["lang", "words", "phrase", "f"])

        held = [f.value for f in filters]
        found: dict[tuple[str, int], dict[bytes, int]] = {}
        for block, langs, salt, _ in _blocks(batches):
            for n in range(1, longest + 1):
                first, fp = candidates(block, salt, n, held, bits)
                hit = passes(of_all.value, fp.view(np.int64))
                for lang in set(langs) if hit.any() else ():
                    own = hit & np.array([x == lang for x in langs])[block.row[first]]
                    for i, c in distinct_phrases(block, first[own], fp[own], n) if own.any() else ():
                        some, phrase = found.setdefault((lang, n), {}), block.phrase(i, n)
                        some[phrase] = some.get(phrase, 0) + c
            if sum(map(len, found.values())) > HELD >> 4:
                yield from handed(found)
                found = {}
        yield from handed(found)

    by_text = rows.mapInArrow(run, "lang string, words int, phrase string, f long").groupBy("lang", "words", "phrase")
    return checkpoint(by_text.agg(F.sum("f").alias("f")).where(F.col("f") >= MIN_COUNT))


def frequent_phrases(docs: DataFrame, text_col="text", lang_col="lang", longest: int = LONGEST, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(``lang, words, phrase, f`` of every phrase of up to ``longest`` words found MIN_COUNT times or more; ``lang, n`` of
    every language, all its words). Fingerprints have ``bits`` bits; fewer give more collisions and the same result."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    rows = small_batches(docs).select(lang.alias("lang"), F.col(text_col).cast("string").alias("text"))

    words = checkpoint(count_fingerprints(rows, [1], [], bits))
    filters = [bit_filter(words, "fp")]
    pairs = checkpoint(count_fingerprints(rows, [2], filters, bits))
    filters = [*filters, bit_filter(pairs, "fp")]
    longer = checkpoint(count_fingerprints(rows, range(3, longest + 1), filters, bits))

    counts = words.unionByName(pairs).unionByName(longer).groupBy("fp").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    several = F.shiftright("low", 16) != F.shiftright("high", 16)
    named, totals = phrases_by_pointer(rows, counts.where(~several), longest, filters, bits)
    mixed_up = counts.where(several)
    if not mixed_up.isEmpty():
        named = named.unionByName(phrases_by_text(rows, mixed_up, longest, filters, bits))
    return checkpoint(named), totals


def collocations(docs: DataFrame, text_col="text", lang_col="lang", top: int = TOP, covered_pct: int = 100) -> DataFrame:
    """The ``top`` phrases of each language by score: ``lang, rank, phrase, a, l, r, n, score``.

    a: occurrences of the phrase (2 to LONGEST words within a piece, MIN_COUNT or more); n: all words of the language; a cut
    after k words gives l and r, those of its two parts, and the score floor(1000*a*n / (l*r)), of which the lowest counts
    (ties: smallest k). A phrase goes if a longer candidate holds its words and has ``covered_pct`` of its occurrences.
    Counts only fall as phrases grow, so it is enough to look one word further. Whole numbers of 38 digits throughout; ties
    of score and a go by the phrase's bytes. Null texts are empty, a null language is ``und``; repeated rows count each;
    an empty table gives none; other columns are ignored. A task holds a block of BLOCK
    bytes of text, or one longer piece, and HELD fingerprints at a time.
    """
    phrases, totals = frequent_phrases(docs, text_col, lang_col)
    many = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    grown = many.where("words > 2").select("lang", "a", F.explode(F.array(F.expr("slice(w, 1, words - 1)"), F.expr("slice(w, 2, words - 1)"))).alias("w"))
    inside = grown.groupBy("lang", F.array_join("w", " ").alias("phrase")).agg(F.max("a").alias("inner"))
    kept = many.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("inner") < covered_pct * F.col("a"), F.lit(True)))

    cut = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("left"), F.array_join(F.slice("w", k + 1, F.col("words") - k), " ").alias("right")))
    cuts = kept.select("lang", "phrase", "a", F.explode(cut).alias("c")).select("lang", "phrase", "a", "c.*")
    part = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = join_skewed(join_skewed(cuts, part("left", "l"), ["lang", "left"]), part("right", "r"), ["lang", "right"])
    cuts = join_skewed(cuts, totals, ["lang"])
    score = F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
