"""Benchmark decontamination: SimHash windows, multi-index Hamming search, exact check.

For every benchmark item of L words, all windows of a document of L words, or of up to 6 %
less where items of nearly one length share their windows, are fingerprinted: a window's
fingerprint is the 64-bit SimHash of its five-word shingles, weighted by their counts, from
running sums of the shingles' bits. The items' fingerprints stand in a multi-index of
``BLOCKS`` blocks of bits: two fingerprints within ``RADIUS`` bits agree to within
RADIUS // BLOCKS bits in at least one block, so looking up each block's neighbourhood finds
every fingerprint within the radius; of unrelated windows one in 25 is found. Candidates are
then held against the item by the exact weighted Jaccard similarity of the shingle counts,
with shingles compared as words, not hashes, over windows of the item's own length. A window
within the radius is never missed; a window that is more similar than ``SIMILARITY`` lies
outside the radius in a few cases in a thousand when it is
barely so (README), and less the more similar it is.

Words are lower-cased (A-Z) and parted at blanks and ASCII punctuation, so that passages
match whatever punctuation stands around them.

Scale. Documents are never shuffled: the benchmark is the stated query set and
goes to the tasks, whole, in blocks of at most ``BLOCK_BYTES`` of text, each of
which makes one pass. Texts are laid end to end and worked on in runs of about ``RUN``
words, a long one in overlapping runs, so memory does not depend on their length.

Defined results: null or empty texts, and empty items, match nothing; an item of
fewer than five words is one shingle; a document of fewer words than an item is one
window for it; repeated documents are reported each; equally similar windows of a
document report the first; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common

WIDTH = 5
SIMILARITY = 0.8
BLOCKS = 4
RADIUS = 15
BLOCK_BYTES = 32 << 20
#: Words worked on at once.
RUN = 1 << 13
#: Share by which a window may be shorter than an item that is looked for in it.
SHORTER = 0.06
#: Fingerprints that share tables of the index, a bit each of this kind.
MATCH, GROUP = np.uint8, 8
#: Items whose shingle counts a task keeps.
KEPT = 1 << 12

_PARTS = bytes(
    c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def plain(text: str | None) -> bytes:
    """The text in UTF-8 with A-Z lower-cased and blanks for punctuation."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_PARTS)


def tokens(text: str | None) -> list[bytes]:
    return plain(text).split()


def shingles(words: list[bytes], width: int = WIDTH) -> list[bytes]:
    if not words:
        return []
    width = min(width, len(words))
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def lanes(hashes: np.ndarray, longest: int) -> np.ndarray:
    """Rows of the 64 bits, each in a lane of bytes wide enough to count to ``longest``, as
    64-bit words. Differences of running sums of such words are right even though the sums
    themselves run over, as no lane of a window's sum does."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if longest <= np.iinfo(k).max)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8))
    return bits.astype(kind, copy=False).view(np.uint64).reshape(len(hashes), -1)


def fingerprint(sums: np.ndarray, shingles: int, bits: np.ndarray | None = None) -> np.ndarray:
    """The 64-bit SimHash of each row of lanes: bits that more than half of the shingles have.
    ``bits``: room for 64 of them per row."""
    counts = sums.view(f"u{sums.shape[1] // 8}")
    bits = np.greater(counts, counts.dtype.type(shingles // 2), out=bits)
    return np.packbits(bits.ravel()).view("<u8").astype(np.uint64, copy=False)


class HammingIndex:
    """Fingerprints by blocks of 16 bits; finds all within ``radius`` of a query.

    For every group of ``GROUP`` fingerprints and block there is a table of all keys: which of
    them lie within radius // BLOCKS bits of the key."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        whole = np.arange(1 << 16)
        near = np.bitwise_count(whole) <= radius // BLOCKS
        self.groups = []
        for a in range(0, len(prints), GROUP):
            tables = np.zeros((BLOCKS, 1 << 16), MATCH)
            for i, own in enumerate(self.keys(prints[a : a + GROUP]).T):
                for b in range(BLOCKS):
                    tables[b] |= near[whole ^ own[b]].astype(MATCH) << MATCH(i)
            self.groups.append((a, tables))

    @staticmethod
    def keys(prints: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(prints.astype("<u8", copy=False).view(np.uint16).reshape(-1, BLOCKS).T)

    def pairs(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query positions, item positions and distances, each pair once, in order."""
        keys, found = self.keys(queries), []
        for a, tables in self.groups:
            match = tables[0].take(keys[0])
            for b in range(1, BLOCKS):
                match |= tables[b].take(keys[b])
            at = np.flatnonzero(match)
            own = self.prints[a : a + GROUP]
            near = np.flatnonzero(np.bitwise_count(queries[at] ^ own[:, None]) <= self.radius)
            if len(near):
                i, q = near // len(at), at[near % len(at)]
                # of these, the pairs that a block has led to
                led = (match[q] >> i.astype(match.dtype)) & 1 == 1
                found.append(q[led] * len(self.prints) + (a + i[led]))
        both = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        q, i = both // len(self.prints), both % len(self.prints)
        return q, i, np.bitwise_count(queries[q] ^ self.prints[i]).astype(np.int64)


def weighted_jaccard(a: Counter, b: Counter) -> float:
    low = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return low / (sum(a.values()) + sum(b.values()) - low)


class Benchmark:
    """Items prepared for searching, by their number of words."""

    def __init__(self, rows: list[tuple[int, str]], radius=RADIUS, similarity=SIMILARITY):
        self.similarity = similarity
        self.by_length: dict[int, list[tuple[int, list[bytes]]]] = {}
        for item, text in rows:
            if ws := tokens(text):
                self.by_length.setdefault(len(ws), []).append((item, ws))
        #: by the length of their windows: items as (length, number among those), and their index
        self.shared: dict[int, tuple[list[tuple[int, int]], HammingIndex]] = {}
        left = sorted(self.by_length)
        while left:
            own = [n for n in left if n <= left[0] / (1 - SHORTER)]
            left = left[len(own):]
            items = [(n, i) for n in own for i in range(len(self.by_length[n]))]
            prints = np.concatenate([self.print_of(self.by_length[n][i][1]) for n, i in items])
            self.shared[own[0]] = items, HammingIndex(prints, radius)
        self.counts: dict[tuple[int, int], Counter] = {}
        #: lengths of windows by the width of their shingles
        self.lengths = {w: sorted(n for n in self.shared if min(n, WIDTH) == w) for w in range(1, WIDTH + 1)}
        self.longest = max(self.by_length, default=0)

    @staticmethod
    def print_of(ws: list[bytes]) -> np.ndarray:
        return Benchmark.print_of_hashes(common.shingle_hashes(common.word_hashes(b" ".join(ws)), WIDTH))

    @staticmethod
    def print_of_hashes(hashes: np.ndarray) -> np.ndarray:
        return fingerprint(lanes(hashes, len(hashes)).sum(0, dtype=np.uint64)[None], len(hashes))

    def count_of(self, n: int, i: int) -> Counter:
        if (n, i) not in self.counts:
            if len(self.counts) >= KEPT:
                self.counts.clear()
            self.counts[n, i] = Counter(shingles(self.by_length[n][i][1]))
        return self.counts[n, i]

    def search(self, texts: list) -> dict[int, dict]:
        """By text: (first word, words, distance, similarity) of the best window of each item."""
        best: dict[int, dict] = {}
        kept: dict[int, list[bytes]] = {}
        run, held = [], 0
        for row, text in enumerate(texts):
            hashes = common.word_hashes(plain(text))
            if not len(hashes):
                continue
            if len(hashes) < self.longest:
                self.whole(row, text, hashes, best)
            # a long text comes in runs that overlap by the longest window
            for a in range(0, max(1, len(hashes) - self.longest + 1), RUN):
                piece = hashes[a : a + RUN + self.longest - 1]
                run.append((row, a, piece))
                held += len(piece)
                if held >= RUN:
                    self.windows(run, texts, kept, best)
                    kept.clear()
                    run, held = [], 0
        if run:
            self.windows(run, texts, kept, best)
        return best

    def take(self, row, words, n, i, at, far, best) -> None:
        """Compare a window with an item exactly."""
        window = words[at : at + n]
        item, same = self.by_length[n][i][0], weighted_jaccard(self.count_of(n, i), Counter(shingles(window, min(n, WIDTH))))
        if same >= self.similarity:
            own = best.setdefault(row, {})
            if item not in own or (same, -at) > (own[item][3], -own[item][0]):
                own[item] = (at, len(window), far, same)

    def whole(self, row, text, hashes, best) -> None:
        """A text of fewer words than some items, as one window."""
        least = self.similarity * 0.999
        for n, (items, index) in self.shared.items():
            width = min(n, WIDTH)
            if width > len(hashes) or items[-1][0] <= len(hashes):
                continue
            if len(hashes) - width + 1 < least * (n - width + 1):
                continue
            own = self.print_of_hashes(common.shingle_hashes(hashes, width))
            for _, k, far in zip(*(x.tolist() for x in index.pairs(own)), strict=True):
                if items[k][0] > len(hashes):
                    self.take(row, tokens(text), *items[k], 0, far, best)

    def windows(self, run, texts, kept, best) -> None:
        """All windows of some pieces of texts: (text, its first word, hashes)."""
        sizes = np.array([len(h) for *_, h in run])
        ends = np.cumsum(sizes)
        hashes = np.concatenate([h for *_, h in run])
        for width, lengths in self.lengths.items():
            lengths = [n for n in lengths if n <= len(hashes)]
            if not lengths:
                continue
            own = lanes(common.shingle_hashes(hashes, width), lengths[-1])
            sums = np.zeros((len(own) + 1, own.shape[1]), np.uint64)
            np.cumsum(own, axis=0, out=sums[1:])
            # room that all lengths use in turn, as fresh memory costs more than the sums
            held, bits = np.empty_like(own), np.empty((len(own), 64), bool)
            for n in lengths:
                span, last = n - width + 1, len(hashes) - n + 1
                np.subtract(sums[span : span + last], sums[:last], out=held[:last])
                prints = fingerprint(held[:last], span, bits[:last])
                items, index = self.shared[n]
                for q, i, far in zip(*(x.tolist() for x in index.pairs(prints)), strict=True):
                    k = int(np.searchsorted(ends, q, "right"))
                    size, more = items[i][0], items[i][0] - n
                    if q + n > ends[k]:
                        continue  # it reaches into the next text
                    row, first = run[k][0], run[k][1] + q - int(ends[k] - sizes[k])
                    if row not in kept:
                        kept[row] = tokens(texts[row])
                    # the item's own windows around it
                    for at in range(max(0, first - more), min(first, len(kept[row]) - size) + 1):
                        self.take(row, kept[row], *items[i], at, far, best)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
) -> DataFrame:
    """doc_id, item_id, start_word, n_words, hamming, similarity: a row for each
    document and item of which a window of the document is a near copy."""
    spark = docs.sparkSession
    kind = dict(docs.select(F.col(id_col).alias("d")).dtypes)["d"]
    item_kind = dict(benchmark.select(F.col(item_col).alias("i")).dtypes)["i"]
    schema = (
        f"doc_id {kind}, item_id {item_kind}, start_word long, n_words long, hamming int, similarity double"
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    result = None
    for block in blocks(benchmark, item_col, item_text_col):
        held = spark.sparkContext.broadcast(block)
        found = common.map_ids(rows, searcher(held, radius, similarity), schema)
        result = found if result is None else result.unionByName(found)
    return spark.createDataFrame([], schema) if result is None else result


def blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """The query set in blocks of bounded size, read one after another."""
    block, held = [], 0
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    for row in rows.toLocalIterator():
        block.append((row["i"], row["t"]))
        held += len(row["t"])
        if held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def searcher(held, radius, similarity):
    def search(batches):
        bench = Benchmark(held.value, radius, similarity)
        for batch in common.slices(batches):
            found = [
                (row, item, *match)
                for row, own in sorted(bench.search(batch["text"].to_pylist()).items())
                for item, match in own.items()
            ]
            at, *columns = [list(x) for x in zip(*found, strict=True)] or [[] for _ in range(6)]
            yield batch["doc_id"].take(pa.array(at, pa.int64())), columns

    return search


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(
        common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
