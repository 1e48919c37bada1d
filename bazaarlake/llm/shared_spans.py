"""Long spans that stand verbatim in more than one record.

A window is ``span`` characters. Each window has a minimiser: the least hash of the ``seed_length``-grams in it, so
equal windows have equal minimisers. Consecutive windows with one minimiser form a super-k-mer. Minimisers that
only one document has are dropped first, on narrow rows; what is left travels as one packed string to the
bucket of its minimiser, where windows are sorted and counted, compared character by character.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

SPAN = 200
SEED_LENGTH = 64
#: Characters of one minimiser's strings beyond which its windows are spread over all tasks.
HOT = 3_000_000
#: Most windows of a super-k-mer; longer runs with one minimiser, such as a million blanks, are cut.
PIECE = 2_000
#: Characters of whole buckets that a task sorts at a time.
CHUNK = 2_000_000

_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(codes: np.ndarray, n: int, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of every n-gram of code points, by doubling: no loop over characters."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    power, now = 1, _mixed(codes.astype(np.uint64) + np.uint64(base & 0xFFFF))
    whole, length = None, 0
    left = n
    while True:
        if left & 1:
            if whole is None:
                whole, length = now, power
            else:
                size = len(now) - length
                whole = whole[:size] * np.uint64(pow(base, power, 1 << 64)) + now[length:]
                length += power
        left >>= 1
        if not left:
            return _mixed(whole)
        now = now[: len(now) - power] * np.uint64(pow(base, power, 1 << 64)) + now[power:]
        power *= 2


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours."""
    now, size = values, 1
    while size * 2 <= n:
        now = np.minimum(now[: len(now) - size], now[size:])
        size *= 2
    out = len(values) - n + 1
    return np.minimum(now[:out], now[n - size : n - size + out]) if size < n else now


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def super_kmers(codes: np.ndarray, span: int, seed_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser) of each super-k-mer of a text of at least ``span`` characters; none has more than ``PIECE``."""
    least = sliding_min(gram_hashes(codes, seed_length), span - seed_length + 1)
    begins = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    longest = int(np.diff(np.concatenate((begins, [len(least)]))).max())
    if longest > PIECE:
        ends = np.concatenate((begins[1:], [len(least)]))
        begins = np.concatenate([np.arange(b, e, PIECE) for b, e in zip(begins, ends, strict=True)])
    counts = np.diff(np.concatenate((begins, [len(least)])))
    return begins, counts, least[begins].view(np.int64)


def _marks(span: int, seed_length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            doc, th, at, n, key = [], [], [], [], []
            for k, text in enumerate(texts):
                text = text.as_py()
                codes = codes_of(text)
                begins, counts, least = super_kmers(codes, span, seed_length)
                doc.append(np.full(len(begins), ids[k]))
                th.append(np.full(len(begins), hashes[k]))
                at.append(begins)
                n.append(counts)
                key.append(least)
            if doc:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(doc), pa.int64()), pa.array(np.concatenate(th), pa.int64()), pa.array(np.concatenate(at), pa.int64()), pa.array(np.concatenate(n), pa.int64()), pa.array(np.concatenate(key), pa.int64())],
                    names=["doc", "th", "at", "n", "key"],
                )

    return run


def _pack(span: int):
    """Cuts the packed strings of a text's kept super-k-mers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids, hashes, texts = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()
                lists = part.column(3)
                rows = lists.flatten()
                ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
                at, n, key = (np.asarray(rows.field(f)) for f in ("at", "n", "key"))
                packed, doc, th = [], [], []
                for k, text in enumerate(texts):
                    for j in range(ends[k], ends[k + 1]):
                        packed.append(text[at[j] : at[j] + n[j] + span - 1])
                    doc.extend([ids[k]] * (ends[k + 1] - ends[k]))
                    th.extend([hashes[k]] * (ends[k + 1] - ends[k]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(th, pa.int64()), pa.array(at, pa.int64()), pa.array(packed, pa.string())],
                    names=["key", "doc", "th", "at", "packed"],
                )

    return run


def _verbatim(codes: np.ndarray, here: np.ndarray, there: np.ndarray, span: int) -> bool:
    """Whether the windows that begin ``here`` and ``there`` are equal; neighbours only compare their last character."""
    if not len(here):
        return True
    follows = np.concatenate(([False], (here[1:] == here[:-1] + 1) & (there[1:] == there[:-1] + 1)))
    if not np.array_equal(codes[here[follows] + span - 1], codes[there[follows] + span - 1]):
        return False
    a, b = here[~follows], there[~follows]
    return all(np.array_equal(codes[x : x + span], codes[y : y + span]) for x, y in zip(a.tolist(), b.tolist(), strict=True) if x != y)


def shared_windows(texts: list[str], docs: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first, end) of the runs of windows that two different ``docs`` have, counted by sorting."""
    codes = codes_of("".join(texts))
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    which = np.repeat(np.arange(len(texts)), sizes)
    places = np.flatnonzero(np.arange(len(codes)) + span <= ends[which])
    hashes = gram_hashes(codes, span)[places]
    order = np.argsort(hashes, kind="stable")
    begins = np.flatnonzero(np.concatenate(([True], hashes[order][1:] != hashes[order][:-1])))
    owner = docs[which[places]]
    low, high = np.minimum.reduceat(owner[order], begins), np.maximum.reduceat(owner[order], begins)
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(begins)), np.diff(np.concatenate((begins, [len(order)]))))
    shared = (low != high)[group]
    if not _verbatim(codes, places[shared], places[order[begins]][group[shared]], span):
        # Two different windows have one hash: this chunk is counted by the strings themselves.
        seen: dict[str, set] = {}
        whole = "".join(texts)
        for p, d in zip(places.tolist(), owner.tolist(), strict=True):
            seen.setdefault(whole[p : p + span], set()).add(d)
        shared = np.array([len(seen[whole[p : p + span]]) > 1 for p in places.tolist()])
    hit = places[shared]
    if not len(hit):
        return hit, hit, hit
    first = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (which[hit[1:]] != which[hit[:-1]])))
    lo, hi = hit[first], hit[np.concatenate((first[1:], [True]))] + 1
    string = which[lo]
    base = (ends - sizes)[string]
    return string, lo - base, hi - base


def _count(span: int, chunk: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows)
            texts = table.column("packed").to_pylist()
            doc, th, at = (table.column(c).to_numpy() for c in ("doc", "th", "at"))
            string, lo, hi = shared_windows(texts, doc, span)
            return pa.RecordBatch.from_arrays(
                [pa.array(doc[string], pa.int64()), pa.array(th[string], pa.int64()), pa.array(at[string] + lo, pa.int64()), pa.array(at[string] + hi + span - 1, pa.int64())],
                names=["doc", "th", "lo", "hi"],
            )

        for batch in batches:
            while batch.num_rows:
                lengths = np.cumsum(pc.utf8_length(batch.column("packed")).to_numpy(zero_copy_only=False))
                keys = batch.column("key").to_numpy()
                cut = int(np.searchsorted(lengths, max(0, chunk - size)))
                if cut >= batch.num_rows:
                    held.append(batch)
                    size += int(lengths[-1])
                    break
                later = np.flatnonzero(keys[cut + 1 :] != keys[cut : -1]) if cut + 1 < len(keys) else np.zeros(0, np.int64)
                if not len(later):
                    held.append(batch)
                    size += int(lengths[-1])
                    break
                end = cut + 1 + int(later[0])
                yield flush([*held, batch.slice(0, end)])
                held, size = [], 0
                batch = batch.slice(end)
        if held:
            yield flush(held)

    return run


def _spread(span: int):
    """A hash of each window of a packed string, with the string's number and the window's place in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = part.column("packed").to_pylist()
                sizes = np.array([len(t) for t in texts])
                codes, ends = codes_of("".join(texts)), np.cumsum(sizes)
                which = np.repeat(np.arange(len(texts)), sizes)
                places = np.flatnonzero(np.arange(len(codes)) + span <= ends[which])
                string = which[places]
                sid, low, high = (part.column(c).to_numpy()[string] for c in ("sid", "low", "high"))
                hashes = gram_hashes(codes, span)[places].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (hashes, sid, low, high, places - (ends - sizes)[string])], names=["hash", "sid", "low", "high", "off"])

    return run


def _spread_out(rows: DataFrame, span: int, spread=_spread) -> DataFrame:
    """(doc, th, lo, hi) of the shared runs in packed strings (doc, th, at, packed) of minimisers that many have.

    Equal strings are one before their windows are spread; a window's documents are counted with a combine before
    the shuffle. Windows that only one document has differ from all others in their hash and go; of the others each
    hash's texts are counted, combined likewise, and where a hash has several, windows are told apart by their texts.
    """
    named = stored(rows.select("doc", "th", "at", "packed"))
    once = named.groupBy("packed").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    strings = stored(once.withColumn("sid", F.monotonically_increasing_id()))
    windows = stored(strings.select("sid", "low", "high", "packed").mapInArrow(spread(span), "hash bigint, sid bigint, low bigint, high bigint, off bigint"))
    several = windows.groupBy("hash").agg(F.min("low").alias("a"), F.max("high").alias("b")).where("a < b").select("hash")
    shared = stored(windows.join(several, "hash"))
    text = F.substring(F.col("packed"), F.col("off").cast("int") + 1, F.lit(span))
    # A group is one string's windows, PIECE at most; the texts meet their hash again as the string's parts.
    by_string = shared.groupBy("sid").agg(F.collect_list(F.struct("hash", "off")).alias("w")).join(strings, "sid").select("sid", "low", "high", "packed", F.explode("w").alias("w"))
    texts = by_string.select("sid", "low", "high", "packed", F.col("w.hash").alias("hash"), F.col("w.off").alias("off")).withColumn("text", text)
    mixed = stored(texts.groupBy("hash", "text").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"))
    true = shared.select("hash", "sid", "off")
    if not mixed.isEmpty():
        apart = texts.join(mixed, "hash")
        real = apart.groupBy("hash", "text").agg(F.min("low").alias("a"), F.max("high").alias("b")).where("a < b").select("hash", "text")
        true = true.join(mixed, "hash", "left_anti").unionByName(apart.join(real, ["hash", "text"]).select("hash", "sid", "off"))
    place = F.row_number().over(Window.partitionBy("sid").orderBy("off"))  # a group is one string's windows
    runs = true.withColumn("run", F.col("off") - place).groupBy("sid", "run").agg(F.min("off").alias("lo"), F.max("off").alias("hi"))
    having = named.join(strings.select("packed", "sid"), "packed").select("doc", "th", "at", "sid")
    return having.join(runs, "sid").select("doc", "th", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi") + span).alias("hi"))


def shared_intervals(
    documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, seed_length: int = SEED_LENGTH, hot: int = HOT, chunk: int = CHUNK
) -> DataFrame:
    """(doc, th, lo, hi): runs of characters of a document that lie in spans another document has too; they may overlap.

    Buckets of up to ``hot`` characters are sorted in one task, windows compared as they are. The windows of fuller
    ones, such as those of a text that a third of all documents has, are spread over all tasks by their hash,
    pre-aggregated and compared as they are too, so no bucket grows with the corpus.
    """
    source = documents.where(F.col(key).isNotNull() & (F.length(text) >= span)).select(
        F.col(key).cast("bigint").alias("doc"), F.shiftright(F.xxhash64(text), 32).alias("th"), F.col(text).alias("text")
    )
    marks = stored(source.mapInArrow(_marks(span, seed_length), "doc bigint, th bigint, at bigint, n bigint, key bigint"))
    common = stored(
        marks.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.sum(F.col("n") + (span - 1)).alias("n")).where("low < high").select("key", (F.col("n") > hot).alias("hot"))
    )

    def packed(keys: DataFrame) -> DataFrame:
        kept = marks.join(keys.select("key"), "key").groupBy("doc", "th").agg(F.collect_list(F.struct("at", "n", "key")).alias("cuts"))  # a group is one document's
        return source.join(kept, ["doc", "th"]).select("doc", "th", "text", "cuts").mapInArrow(_pack(span), "key bigint, doc bigint, th bigint, at bigint, packed string")

    found = packed(common.where("not hot")).repartition("key").sortWithinPartitions("key").mapInArrow(_count(span, chunk), "doc bigint, th bigint, lo bigint, hi bigint")
    if common.where("hot").isEmpty():
        return found
    return found.unionByName(_spread_out(packed(common.where("hot")), span))


def shared_chars(documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, **sizes: int) -> DataFrame:
    """(key, shared_chars): how many code points of each document lie in spans of ``span`` or more that stand in another.

    Each character counts once; what repeats only within a document does not count, and documents without such a
    span have no row. Null, empty and short texts and rows without key have none either. Rows of one key are one
    document: equal texts count once, different texts are added.
    """
    runs = shared_intervals(documents, key, text, span, **sizes)
    order = Window.partitionBy("doc", "th").orderBy("lo", "hi")  # a group is one document's runs
    before = F.coalesce(F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = runs.withColumn("before", before).select("doc", F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", "before")).alias("new"))
    return new.groupBy("doc").agg(F.sum("new").alias("shared_chars")).select(F.col("doc").alias(key), F.col("shared_chars").cast("bigint").alias("shared_chars"))
