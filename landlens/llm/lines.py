"""Fuzzy line dedup: MinHash bands over character shingles, exact Jaccard, distributed union-find.

A line's shingles are its windows of eight characters. Lines that share a band of their signature meet in a bucket
and are verified by the exact Jaccard similarity of their shingle sets; of each component of verified links (and of
each set of equal lines) the first line stays, in the order of doc_id and line number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stable import measured
from .common import EDGES_A_TASK, Forest, SPACE, bit_filter, checkpoint, components, fresh, join_skewed, passes, release, small_batches

#: Parameters: wanted similarity as a fraction, bands and rows a band, characters of a shingle.
SIMILARITY = (4, 5)
BANDS, ROWS = 14, 5
SHINGLE = 8
#: Lines in one half of a block that is verified together, documents whose lines are signed together.
PART = 128
BLOCK_DOCS = 2000
#: Seed of the second hash: two lines count as equal if both 64-bit hashes are.
SECOND = 20240917

_rng = np.random.default_rng(20240917)
_MUL = _rng.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _windows(raw: bytes) -> np.ndarray:
    """Every eight bytes running as one number."""
    return np.ndarray((len(raw) - SHINGLE + 1,), np.uint64, raw, strides=(1,)).copy()


def distinct(numbers: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    numbers = np.sort(numbers)
    new = np.empty(len(numbers), bool)
    new[0] = True
    np.not_equal(numbers[1:], numbers[:-1], out=new[1:])
    return numbers[new]


def shingles(line: str) -> np.ndarray:
    """The windows of eight characters as numbers, in order; a shorter line is one shingle.

    Characters up to U+00FF fill one byte each, so a window of them is its own number. A window with others is
    numbered by a 64-bit hash of its code points."""
    if len(line) < SHINGLE:
        line = line.ljust(SHINGLE, "\0")
    try:
        return _windows(line.encode("latin-1"))
    except UnicodeEncodeError:
        points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = _windows((points & 0xFF).astype(np.uint8).tobytes())
        wide = np.lib.stride_tricks.sliding_window_view(points, SHINGLE)
        other = (wide > 0xFF).any(axis=1)
        code = np.zeros(int(other.sum()), np.uint64)
        for k in range(SHINGLE):
            code = (code ^ wide[other, k].astype(np.uint64)) * _STEP
            code ^= code >> np.uint64(29)
        out[other] = code
        return out


def band_keys(lines: list[str]) -> np.ndarray:
    """Signed 64-bit band keys, a row a line."""
    out = np.empty((len(lines), BANDS), np.int64)
    done = 0
    while done < len(lines):
        end, size = done, 0
        while end < len(lines) and (end == done or size + len(lines[end]) < 200_000):
            size += len(lines[end])
            end += 1
        out[done:end] = _signature_bands(lines[done:end])
        done = end
    return out


def _signature_bands(lines: list[str]) -> np.ndarray:
    lines = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    try:
        wide = _windows("".join(lines).encode("latin-1") + bytes(SHINGLE - 1))
        lens = np.array([len(x) for x in lines])
        starts = np.cumsum(lens) - lens
        x = ((wide * _STEP) >> np.uint64(32)).astype(np.uint32)
        # Windows that run into the next line are replaced by the line's first window.
        x[(starts + lens)[:, None] - np.arange(1, SHINGLE)] = x[starts][:, None]
    except UnicodeEncodeError:
        if len(lines) > 1:  # lines with other characters are signed on their own
            latin = np.array([max(x) <= "\xff" for x in lines])
            out = np.empty((len(lines), BANDS), np.int64)
            if latin.any():
                out[latin] = _signature_bands([x for x, own in zip(lines, latin) if own])
            for i in np.flatnonzero(~latin):
                out[i] = _signature_bands([lines[i]])[0]
            return out
        x, starts = ((shingles(lines[0]) * _STEP) >> np.uint64(32)).astype(np.uint32), np.zeros(1, np.int64)
    mins = np.empty((BANDS * ROWS, len(lines)), np.uint32)
    y = np.empty_like(x)
    for i in range(BANDS * ROWS):
        np.bitwise_xor(x, _XOR[i], out=y)
        np.multiply(y, _MUL[i], out=y)
        mins[i] = np.minimum.reduceat(y, starts)
    key = np.zeros((BANDS, len(lines)), np.uint64)
    for r in range(ROWS):
        key = (key ^ mins.reshape(BANDS, ROWS, -1)[:, r].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(33)
    key = (key + np.arange(BANDS, dtype=np.uint64)[:, None]) * np.uint64(0xC4CEB9FE1A85EC53)
    return key.view(np.int64).T


def _hashes(line):
    return F.xxhash64(line).alias("h"), F.xxhash64(F.lit(SECOND), line).alias("h2")


def occurrences(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, h, h2`` of every line with a word, from ``docs(doc_id, text)``."""
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.btrim("line", F.lit(SPACE)) != "").select("doc_id", "line_no", *_hashes(F.col("line")))


def _place():
    """``doc_id`` and ``line_no`` as one number of their order, of which Spark finds the least without sorting the rows."""
    return (F.col("doc_id").cast("decimal(19,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("line_no").cast("decimal(10,0)")).alias("place")


def _distinct_lines(batch, column: int):
    """Lists of the different lines of BLOCK_DOCS texts, at least SHINGLE characters long and not blank."""
    texts = batch.column(column).to_pylist()
    for i in range(0, len(texts), BLOCK_DOCS):
        seen = {line: None for text in texts[i : i + BLOCK_DOCS] for line in text.split("\n")}
        yield [x for x in seen if len(x) >= SHINGLE and x.strip(SPACE)]


def _line_hashes(lines: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(x.encode("utf-8"), 42) for x in lines], np.uint64).view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return small_batches(docs).where("doc_id is not null and text is not null").select("text")


def band_rows(docs: DataFrame) -> DataFrame:
    """``key, h``: the bands of each line, once for each block of documents that holds it.

    Lines under eight characters have no window to share and are like equal lines only, which the hashes tell."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lines in _distinct_lines(batch, 0):
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array(band_keys(lines).ravel()), pa.array(np.repeat(_line_hashes(lines), BANDS))], names=["key", "h"])

    return _texts(docs).mapInArrow(run, "key long, h long")


def candidate_pairs(bands: DataFrame) -> DataFrame:
    """``key, a, b``: in each band bucket, its smallest line ``a`` with every other one.

    A bucket that goes on in the next batch of rows is carried on by its smallest line so far: a smaller one that
    comes later is paired with it and takes its place, so that no bucket is held whole."""

    def run(batches):
        import pyarrow as pa

        key = low = None  # the last bucket of the batch before and its smallest line so far
        for batch in batches:
            if not batch.num_rows:
                continue
            k, h = np.array(batch.column(0)), np.array(batch.column(1))
            if key == k[0]:
                k, h = np.concatenate(([key], k)), np.concatenate(([low], h))
            opens = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            lows = np.minimum.reduceat(h, opens)
            key, low = k[-1], lows[-1]
            sizes = np.diff(np.append(opens, len(k)))
            a = np.repeat(lows, sizes)
            other = np.flatnonzero(a != h)
            if not len(other):
                continue
            order = other[np.lexsort((h[other], k[other]))]
            k, a, h = k[order], a[order], h[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(c[new]) for c in (k, a, h)], names=["key", "a", "b"])

    return bands.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, a long, b long")


def similar(both, one, other):
    """Exact test of the Jaccard similarity from the sizes of the intersection and both sets."""
    return SIMILARITY[1] * both >= SIMILARITY[0] * (one + other - both)


def candidate_lines(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id, h, h2, line`` of the lines in ``pairs(a, b)`` (hashes); two lines of one 64-bit hash get a row each.

    Only lines that pass a bit filter of fixed size with the wanted hashes are shuffled; what it lets through beside
    them is dropped by the join."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    held = bit_filter(wanted, "h")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lines in _distinct_lines(batch, 0):
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array(lines).filter(pa.array(passes(held.value, _line_hashes(lines))))], names=["line"])

    lines = _texts(docs).mapInArrow(run, "line string").select(*_hashes(F.col("line")), "line")
    once = lines.groupBy("h", "h2").agg(F.first("line").alias("line"))
    out = checkpoint(once.join(wanted, "h", "left_semi").select(F.monotonically_increasing_id().alias("id"), "h", "h2", "line"))
    held.destroy()
    release(docs.sparkSession)
    return out


def verified_pairs(pairs: DataFrame) -> DataFrame:
    """``a, b`` of the rows of ``pairs(a, b, line_a, line_b)`` that are similar; rows of one ``a`` should come together."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep, last, own = [], None, None
            for la, lb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if la != last:
                    last, own = la, distinct(shingles(la))
                other = shingles(lb)
                at = np.searchsorted(own, other)
                at[at == len(own)] = 0
                found = np.zeros(len(own), bool)
                found[at[own[at] == other]] = True
                both = int(found.sum())
                # The union is at least as large as ``own``, so most others need not be counted.
                keep.append(similar(both, len(own), both) and similar(both, len(own), len(distinct(other))))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "line_a", "line_b").mapInArrow(run, "a long, b long")


def joined_parts(comps: list[int], lines: list[str]) -> list[tuple[int, int]]:
    """Pairs of components that a pair of similar lines joins, by a spanning forest.

    Lines stand in order of their set's size: similar ones are close to each other there. Lines already in one
    component need no comparison."""
    sets = [distinct(shingles(x)) for x in lines]
    order = np.argsort([len(x) for x in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order])
    # Shingles are numbered within the block, so that a table tells at once which of them a line has.
    ends, (known, numbers) = np.cumsum(sizes), np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    sets, has = np.split(numbers, ends[:-1]), np.zeros(len(known), bool)
    out = []
    places = {c: i for i, c in enumerate(dict.fromkeys(comps))}
    root = np.array([places[comps[i]] for i in order])
    named = list(places)
    last = np.searchsorted(sizes, SIMILARITY[1] * sizes // SIMILARITY[0], side="right")
    for i in range(len(sets) - 1):
        others = np.arange(i + 1, last[i])
        others = others[root[others] != root[i]]
        if not len(others):
            continue
        theirs = numbers[ends[i] : ends[others[-1]]] if len(others) == others[-1] - i else np.concatenate([sets[j] for j in others])
        has[sets[i]] = True
        both = np.add.reduceat(has[theirs], np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
        has[sets[i]] = False
        for j in others[similar(both, sizes[i], sizes[others])]:
            if root[i] != root[j]:
                out.append((named[root[i]], named[root[j]]))
                root[root == root[j]] = root[i]
    return out


def verified_links(blocks: DataFrame) -> DataFrame:
    """``a, b``: components of each block of ``items(comp, line)`` that a pair of similar lines joins."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            links = []
            for items in batch.column(0):
                v = items.values
                links += joined_parts(v.field("comp").to_pylist(), v.field("line").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return blocks.mapInArrow(run, "a long, b long").distinct()


def line_components(docs: DataFrame) -> DataFrame:
    """``h, h2, component`` of all lines with a verified link to another.

    First every bucket's smallest line is compared with the others, each pair once however many bands it shares.
    In buckets where that leaves more than one component, all lines of different components are then compared in
    blocks of two parts, so no link between lines of a bucket is lost, and a group of many near copies costs
    one comparison a line and not all its pairs.
    """
    near = measured(candidate_pairs(band_rows(docs)), EDGES_A_TASK)
    release(docs.sparkSession)
    pairs = near.select("a", "b").distinct()
    texts = candidate_lines(docs, pairs)
    side = lambda c: texts.select(F.col("h").alias(c), F.col("id").alias(f"id_{c}"), F.col("line").alias(f"line_{c}"))
    # Joined on ``a`` last, so that rows of one bucket's smallest line come together and its shingles are made once.
    met = pairs.join(side("b"), "b").join(side("a"), "a")
    first = components(verified_pairs(met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "line_a", "line_b")))
    named = checkpoint(texts.select("h", "h2", "id").join(first, texts.id == first.node, "left").select("h", "h2", "id", F.coalesce("component", "id").alias("comp"), F.col("component").isNotNull().alias("linked")))

    of = lambda c: named.select(F.col("h").alias(c), F.col("comp").alias(f"c{c}"))
    both = near.join(of("a"), "a").join(of("b"), "b").select("key", "a", "b", "ca", "cb")
    split = both.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("ca") != F.col("cb")).alias("apart")).where("n > 1 and apart > 0").select("key", "n")
    left = near.join(split, "key").select("key", "n", F.explode(F.array("a", "b")).alias("h")).distinct().join(named.select("h", "id", "comp"), "h")
    left = left.withColumn("parts", F.ceil((F.col("n") + 1) / (2 * PART)).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    left = left.select("key", "id", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    members = F.sort_array(F.collect_set(F.struct("id", "comp"))).alias("members")
    # The same lines often share several buckets: each set of lines is compared once.
    blocks = left.groupBy("key", F.least("own", "other"), F.greatest("own", "other")).agg(members, F.countDistinct("comp").alias("n")).where("n > 1").select("members").distinct()
    rows = blocks.select(F.xxhash64("members").alias("block"), F.explode("members").alias("m")).select("block", "m.id", "m.comp").distinct().join(texts.select("id", "line"), "id")
    # The work of a block is more than its bytes tell, so its partitions are not merged.
    dealt = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")
    blocks = dealt.groupBy("block").agg(F.collect_list(F.struct("comp", "line")).alias("items"))
    more = checkpoint(verified_links(blocks.select("items")))
    release(docs.sparkSession)
    joined = components(more).select(F.col("node").alias("comp"), F.col("component").alias("joined"))
    out = named.join(joined, "comp", "left").where("linked or joined is not null")
    return out.select("h", "h2", F.coalesce("joined", "comp").alias("component"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, dropped`` (line numbers from 0) of ``docs(doc_id, text)``, for documents that lose a line."""
    occ = checkpoint(occurrences(docs))
    comp = line_components(docs)
    lines = occ.groupBy("h", "h2").agg(F.min(_place()).alias("first"), F.count("*").alias("n"))
    lines = checkpoint(lines.join(comp, ["h", "h2"], "left").where("n > 1 or component is not null"))
    alone = lines.where("component is null").select("h", "h2", "first")
    linked = lines.where("component is not null").withColumnRenamed("first", "own")
    tops = linked.groupBy("component").agg(F.min("own").alias("first"))
    marks = alone.unionByName(join_skewed(linked, tops, ["component"]).select("h", "h2", "first"))
    later = join_skewed(occ, marks, ["h", "h2"]).where(_place() != F.col("first"))
    out = checkpoint(later.select("doc_id", "line_no").distinct().groupBy("doc_id").agg(F.collect_list("line_no").alias("dropped")))
    release(docs.sparkSession)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = True) -> DataFrame:
    """``docs`` with repeated lines removed from ``text_col``, other columns as they were, whatever their names.

    Every line with a word takes part; blank lines never count as repeats. A document that loses lines and has none
    with a word left goes (or stays with what is left, without ``drop_emptied``). Null texts stay null and empty ones
    empty; rows with a null id are kept unchanged; repeated rows of one id lose the same lines, as if one document;
    an empty table gives an empty one. Only documents that pass a bit filter of fixed size with the ids of those that
    lose lines are shuffled.
    """
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    gone, gone_id, maybe = (fresh(x, docs.columns) for x in ("_gone", "_gone_id", "_maybe"))
    lost = dropped_lines(known).select(F.col("doc_id").alias(gone_id), F.col("dropped").alias(gone))
    held = bit_filter(lost.select(F.xxhash64(gone_id).alias("h")), "h")

    @F.arrow_udf("boolean")
    def may_lose(h):
        import pyarrow as pa

        return pa.array(passes(held.value, np.array(h)))

    test = F.coalesce(may_lose(F.xxhash64(F.col(id_col).cast("long"))), F.lit(False)) & F.col(id_col).isNotNull()
    rows = docs.withColumn(maybe, test)
    met = rows.where(maybe).join(lost, F.col(id_col).cast("long") == F.col(gone_id), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    met = met.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept))
    if drop_emptied:
        met = met.where(F.col(gone).isNull() | (F.btrim(F.col(text_col), F.lit(SPACE)) != ""))
    return rows.where(~F.col(maybe)).select(*docs.columns).unionByName(met.select(*docs.columns))


def _count_lines():
    """Lines of ``text``, without taking it apart."""
    return (F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long")


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_lines, n_kept, kept_sha256`` (of the text that stays); every line with a word takes part.

    Null texts count as empty (one line); a row with a null id keeps all its lines; repeated rows give repeated
    results; other columns are ignored; an empty table gives none."""
    before = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    after = dedup_lines(before.withColumn("n_lines", _count_lines()), "doc_id", "text", drop_emptied=False)
    return after.select("doc_id", "n_lines", _count_lines().alias("n_kept"), F.sha2("text", 256).alias("kept_sha256"))
