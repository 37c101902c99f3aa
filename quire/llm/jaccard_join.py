"""Exact n-gram Jaccard self-join by universe partition, and its components.

Signatures (see ``partenum``) put every two linked sets into a common bucket.
Buckets are not expanded into all their pairs:

1. Every member is compared with its bucket's smallest member; the links give
   components.
2. Buckets whose members still lie in different components are *open*. Nodes outside the
   largest component of an open bucket are compared with a member of it drawn by hash, for
   ``TURNS`` turns. A bucket whose members are all connected, as with groups of near
   copies, costs no more.
3. Nodes of buckets that stay open are told apart by their rarest elements: a linked pair
   shares one of the first ``n - ceil(p n) + 1`` elements of both sets in any one order of
   all elements, and the places where it is first shared bound what the two have in common.
   In an order by rarity, sets with a dozen elements of their own meet hardly anyone. Nodes
   of different components that meet, and whose sizes and places allow a link, are compared.
   Nothing is capped.

So links between different texts may go uncounted only inside a component, and
the components are those of all links. Equal sets are one *node*; each task
sends a node's signatures once, so a group of copies costs a task no more than
one document. Signatures travel as packed arrays of 12 bytes each, dealt by key.

Sets are held as 64-bit hashes of shingles. Memory: a task holds one text, a
buffer of ``BUFFER`` signatures, a part of about ``PART`` signatures, or ``COUNTERS``
counts; a bucket that outgrows its part is cut down to its smallest member as it streams
past. Staged tables are deleted as soon as what is made of them is staged.

Defined results: null or blank texts have no shingles and are linked with
nothing, their own component; fewer words than the width are one shingle; rows
with equal ids are joined as they stand and each is returned; a null id stays
null and gives way to any other as component; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common, partenum

WIDTH = 4
PERCENT = 85
#: Turns in which nodes of open buckets are compared with single members.
TURNS = 2
#: Members of a bucket that a full buffer lets go.
LARGE = 64
BUFFER = 1 << 18
PART = 1 << 19
#: Parts that are partitions of their own; more share one and come in order.
MAX_PARTS = 20_000
SEEN = 1 << 20
#: Counters of elements of nodes in open buckets; they only choose an order.
COUNTERS = 1 << 20
CHUNK = 1 << 14
#: Bits of a set's sketch at least.
MIN_SKETCH = 512
#: Pivots whose texts are sent once per so many comparisons.
FAN = 256
#: Names that may be broadcast, of 8 bytes each.
BROADCAST_IDS = 1_000_000


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct shingle hashes of a text with A-Z lower-cased, sorted."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    return common.distinct(common.shingle_hashes(common.word_hashes(data), width))


def node_of(hashes: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of a set's elements in at least as many bits, as 64-bit words.

    The number of words is a power of two, so a longer sketch can be folded to the
    length of a shorter one. Two sketches of one length never differ in more bits than
    their sets differ in elements."""
    bits = max(MIN_SKETCH, 1 << (len(hashes) - 1).bit_length() if len(hashes) else 0)
    bit = (hashes >> np.uint64(24)).astype(np.int64) & (bits - 1)
    odd = (np.bincount(bit, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def sketch_difference(a: str, b: str) -> str:
    """SQL for the bits in which two sketches differ, the longer one folded once.

    Lengths of sets that may be linked differ by less than a factor of two."""
    half = "transform(slice({x}, 1, size({x}) div 2), (w, i) -> w ^ {x}[i + size({x}) div 2])"
    fold = lambda x, y: f"if(size({x}) > size({y}), {half.format(x=x)}, {x})"
    return f"aggregate(zip_with({fold(a, b)}, {fold(b, a)}, (u, v) -> bit_count(u ^ v)), 0, (n, x) -> n + x)"


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)


def row_name() -> Column:
    """A 64-bit name of a row by its id, which may be null, and its text."""
    return F.xxhash64("doc_id", "text")


def first_row(id_col: str, row_col: str) -> Column:
    """What the first row has the least of: an id, where there is one, and a name."""
    return F.struct(F.isnull(id_col).alias("none"), F.col(id_col).alias("id"), F.col(row_col).alias("row"))


def digests(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row, n (set size), node (null if the set is empty) and sketch per row."""

    def measure(batches):
        for batch in batches:
            n, node, sketches = [], [], []
            for text in batch["text"]:  # one text at a time in memory
                s = shingle_set(text.as_py(), width)
                n.append(len(s))
                node.append(node_of(s) if len(s) else None)
                sketches.append(pa.array(sketch(s)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], batch["row"], pa.array(n, pa.int64()), pa.array(node, pa.int64()),
                    pa.ListArray.from_arrays(
                        np.concatenate([[0], np.cumsum([len(x) for x in sketches])]).astype(np.int32),
                        pa.concat_arrays(sketches) if sketches else pa.array([], pa.int64()),
                    ),
                ],
                ["doc_id", "row", "n", "node", "sketch"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.withColumn("row", row_name()).mapInArrow(
        common.lean(measure), f"doc_id {kind}, row long, n long, node long, sketch array<long>"
    )


def signature_blocks(docs: DataFrame, width: int, percent: int, parts: int) -> DataFrame:
    """part, keys and nodes as packed arrays."""

    def pack(keys, nodes):
        keys, nodes = np.concatenate(keys), np.concatenate(nodes)
        part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        keys, nodes, part = keys[order].astype(np.uint32), nodes[order], part[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        ends = np.append(cuts, len(part))
        starts = np.append(0, cuts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(part[starts]),
                pa.array([keys[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                pa.array([nodes[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
            ],
            ["part", "keys", "nodes"],
        )

    def sign(batches):
        seen: set[int] = set()
        keys, nodes, held = [], [], 0
        for batch in batches:
            for text in batch["text"]:
                s = shingle_set(text.as_py(), width)
                node = node_of(s) if len(s) else 0
                if not len(s) or node in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                k = partenum.signatures(s, percent)
                if len(k):
                    keys.append(k)
                    nodes.append(np.full(len(k), node, np.int64))
                    held += len(k)
                if held >= BUFFER:
                    yield pack(keys, nodes)
                    keys, nodes, held = [], [], 0
        if held:
            yield pack(keys, nodes)

    return docs.select("text").mapInArrow(common.lean(sign), "part int, keys binary, nodes binary")


STAR, MEMBER = 0, 1


def candidates(blocks: DataFrame, parts: int) -> DataFrame:
    """kind, a, b. STAR: a bucket's smallest node and another node of it. MEMBER: the
    name of a bucket of three nodes or more, over all its groups, and a node of it.

    Buckets with the same nodes have the same name, the hash of their nodes, so that the
    many buckets of a group of near copies count once."""

    def frame(kind, a, b):
        return pd.DataFrame({"kind": np.full(len(a), kind, np.int8), "a": a, "b": b})

    def grouped(keys, nodes):
        """Keys in order with their distinct nodes in order; starts and sizes of groups."""
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        keep = np.ones(len(keys), bool)
        keep[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, nodes = keys[keep], nodes[keep]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys, nodes, first, np.diff(np.append(first, len(keys)))

    def emit(nodes, first, size, names, earlier):
        """Rows of all groups of two or more; ``names`` of groups. ``earlier``: groups
        whose bucket has sent out members before."""
        keep = np.repeat(size > 1, size)
        shared = nodes[keep]
        pivot = np.repeat(nodes[first], size)[keep]
        name = np.repeat(names, size)[keep]
        many = np.repeat((size > 2) | earlier, size)[keep]
        other = pivot != shared
        for kind, x, y in ((STAR, pivot[other], shared[other]), (MEMBER, name[many], shared[many])):
            if len(x):
                rows = np.unique(np.stack([x, y], 1), axis=0)
                yield frame(kind, rows[:, 0], rows[:, 1])

    def bucket(batches):
        part, keys, nodes, held, limit, cut = 0, [], [], 0, 3 * PART, set()

        def merged(last):
            nonlocal keys, nodes, held, limit
            ks, vs, first, size = grouped(np.concatenate(keys), np.concatenate(nodes))
            own = (np.int64(part) << np.int64(32)) + ks[first].astype(np.int64)
            earlier = np.isin(ks[first], np.fromiter(cut, np.uint32, len(cut)))
            if last:
                with np.errstate(over="ignore"):
                    sums = np.add.reduceat(common.mix64(vs.view(np.uint64)), first)
                names = np.where(earlier, own, sums.view(np.int64))
                yield from emit(vs, first, size, names, earlier)
                return
            # the buffer is full: large groups go out now and leave their smallest node
            big = size > LARGE
            pick = np.repeat(big, size)
            starts = np.concatenate([[0], np.cumsum(size[big])])[:-1].astype(np.int64)
            if big.any():
                yield from emit(vs[pick], starts, size[big], own[big], earlier[big])
            cut.update(ks[first[big]].tolist())
            keep = ~pick
            keep[first] = True
            keys, nodes = [ks[keep]], [vs[keep]]
            held = int(keep.sum())
            limit = max(limit, 2 * held)

        for batch in batches:
            for p, k, v in zip(batch["part"], batch["keys"], batch["nodes"], strict=True):
                if held and p != part:
                    yield from merged(True)
                    keys, nodes, held, limit, cut = [], [], 0, 3 * PART, set()
                part = int(p)
                keys.append(np.frombuffer(k, np.uint32))
                nodes.append(np.frombuffer(v, np.int64))
                held += len(keys[-1])
                if held >= limit:
                    yield from merged(False)
        if held:
            yield from merged(True)

    if parts <= MAX_PARTS:
        dealt = blocks.repartitionById(parts, F.col("part"))
    else:
        at = F.expr(f"cast(part * {MAX_PARTS}L div {parts} as int)")
        dealt = blocks.repartitionById(MAX_PARTS, at).sortWithinPartitions("part")
    return dealt.mapInPandas(common.lean(bucket), "kind byte, a long, b long")


def named_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """row, text of the given names of rows; equal rows are one."""
    few = rows.count() <= BROADCAST_IDS
    return (
        docs.select(row_name().alias("row"), "text")
        .join(F.broadcast(rows) if few else rows, "row")
        .dropDuplicates(["row", "text"])
    )


def verify(pairs: DataFrame, names: DataFrame, texts, width: int, percent: int, scope: common.Scope) -> DataFrame:
    """Those of ``pairs`` (a, b: nodes) that are linked, staged. names: node, row, n, sketch;
    ``texts`` gives row and text of at least the rows it is called with.

    Texts are fetched only for pairs whose sizes and sketches allow a link, which
    loses none: a sketch never shows more difference than there is. They are fetched by
    row, because an id may be null."""
    a, b = names.select(*[F.col(c).alias(f"{c}_a") for c in names.columns]), names.select(
        *[F.col(c).alias(f"{c}_b") for c in names.columns]
    )
    fit = scope.stage(
        pairs.join(a, F.col("a") == F.col("node_a"))
        .join(b, F.col("b") == F.col("node_b"))
        .where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        .where(f"{sketch_difference('sketch_a', 'sketch_b')} <= n_a + n_b - 2 * ceil({percent} * (n_a + n_b) / {100 + percent}.0)")
        .select("a", "b", "row_a", "row_b"),
        "join-fit",
    )
    degree = fit.groupBy("a").agg(F.count("*").alias("degree"))
    fanned = fit.join(degree, "a").select(
        "a", "b", "row_a", "row_b", F.expr(f"pmod(xxhash64(b), degree div {FAN} + 1)").alias("fan")
    )
    rows = fit.select(F.col("row_a").alias("row")).union(fit.select("row_b")).distinct()
    found = texts(rows)
    others = fanned.select("a", "fan", F.col("row_b").alias("row"), F.col("b").alias("node"), F.lit(1).alias("role"))
    pivots = fanned.select("a", "fan", F.col("row_a").alias("row"), F.col("a").alias("node"), F.lit(0).alias("role"))
    sides = pivots.distinct().unionByName(others).join(found, "row").select("a", "fan", "role", "node", "text")

    def compare(batches):
        at, pivot = None, None
        for batch in common.slices(batches):
            out_a, out_b = [], []
            for a, fan, role, node, text in zip(
                *(batch[c].to_pylist() for c in ("a", "fan", "role", "node", "text")), strict=True
            ):
                s = shingle_set(text, width)
                if not len(s) or node_of(s) != node:
                    continue  # another row with the same name
                if role == 0:
                    at, pivot = (a, fan), s
                elif at == (a, fan) and linked(pivot, s, percent):
                    out_a.append(a)
                    out_b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    links = scope.stage(
        sides.repartition("a", "fan")
        .sortWithinPartitions("a", "fan", "role")
        .mapInArrow(common.lean(compare), "a long, b long")
        .distinct(),
        "join-links",
    )
    scope.drop(fit)
    return links


def components(edges: DataFrame, scope: common.Scope) -> DataFrame:
    """node, comp: the least node reachable, for every end of an edge; staged."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    both = scope.stage(both.distinct(), "cc-edges")
    label = scope.stage(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select(
            "node", F.least("node", "low").alias("comp"), F.lit(None).cast("long").alias("old")
        ),
        "cc-labels",
    )
    while True:
        near = (
            both.join(label, both["b"] == label["node"])
            .groupBy("a")
            .agg(F.min("comp").alias("near"))
        )
        lower = label.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")
        )
        jump = label.select(F.col("node").alias("at"), F.col("comp").alias("to"))
        after = scope.stage(
            lower.join(jump, F.col("comp") == F.col("at")).select(
                "node", F.least("comp", "to").alias("comp"), "old"
            ),
            "cc-labels",
        )
        scope.drop(label)
        label = after
        if label.where("comp != old").isEmpty():
            scope.drop(both)
            return label


def open_buckets(members: DataFrame, label: DataFrame, *extra: str) -> DataFrame:
    """key, x, c, main, extra: members, their components and the bucket's largest component,
    of buckets with more than one component."""
    rows = members.join(label, F.col("x") == F.col("node"), "left").select(
        "key", "x", F.coalesce("comp", "x").alias("c"), *extra
    )
    counted = rows.groupBy("key", "c").agg(F.count("*").alias("n_c"))
    main = counted.groupBy("key").agg(
        F.max(F.struct("n_c", "c"))["c"].alias("main"), F.count("*").alias("many")
    ).where("many > 1").select("key", "main")
    return rows.join(main, "key")


def pivot_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Every node outside its bucket's largest component with one member of that, drawn by
    hash: alike for buckets with the same members, so as a group's many buckets add few."""
    pivot = rows.where("c = main").groupBy("key").agg(
        F.min_by("x", F.xxhash64("x", F.lit(turn))).alias("pivot")
    )
    return rows.where("c != main").join(pivot, "key").select(
        F.least("x", "pivot").alias("a"), F.greatest("x", "pivot").alias("b")
    ).distinct()


def element_counts(texts: DataFrame, width: int) -> np.ndarray:
    """How often elements occur in sets, by the first bits of their hashes."""
    shift = np.uint64(64 - (COUNTERS.bit_length() - 1))

    def rows(counts):
        for chunk in range(0, COUNTERS, CHUNK):
            part = counts[chunk : chunk + CHUNK]
            at = np.flatnonzero(part)
            if len(at):
                yield chunk, at.astype(np.uint32).tobytes(), part[at].tobytes()

    def frame(counts):
        return pd.DataFrame(list(rows(counts)), columns=["chunk", "at", "counts"])

    def count(batches):
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in batch["text"].tolist():
                np.add.at(counts, (shingle_set(text, width) >> shift).astype(np.int64), 1)
        yield frame(counts)

    def add(batches):
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for chunk, at, n in zip(batch["chunk"], batch["at"], batch["counts"], strict=True):
                counts[np.frombuffer(at, np.uint32).astype(np.int64) + chunk] += np.frombuffer(n, np.int64)
        yield frame(counts)

    kind = "chunk int, at binary, counts binary"
    summed = texts.mapInPandas(common.lean(count), kind).repartition("chunk").mapInPandas(common.lean(add), kind)
    counts = np.zeros(COUNTERS, np.int64)
    for chunk, at, n in summed.collect():  # COUNTERS entries at most
        counts[np.frombuffer(at, np.uint32).astype(np.int64) + chunk] += np.frombuffer(n, np.int64)
    return counts


def rare_elements(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """key (an element), x (a node), place, n: the elements of every set that a linked one
    must share one of, rarest first, and their places among its ``n``."""
    shift = np.uint64(64 - (COUNTERS.bit_length() - 1))
    counts = texts.sparkSession.sparkContext.broadcast(element_counts(texts, width).tobytes())

    def pick(batches):
        seen = np.frombuffer(counts.value, np.int64)
        for batch in batches:
            out = []
            for text in batch["text"].tolist():
                s = shingle_set(text, width)
                k = len(s) - -(-percent * len(s) // 100) + 1
                first = np.lexsort((s, seen[(s >> shift).astype(np.int64)]))[:k]
                out.append((s[first].view(np.int64), np.full(k, node_of(s)), np.arange(k), np.full(k, len(s))))
            yield pd.DataFrame(
                {c: np.concatenate([x[i] for x in out] or [np.zeros(0, np.int64)]) for i, c in enumerate(("key", "x", "place", "n"))}
            )

    return texts.mapInPandas(common.lean(pick), "key long, x long, place long, n long")


def meeting_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes in different components that share an element (``key``) at places that
    allow a link. One end is outside the element's largest component."""
    u = rows.where("c != main").select("key", *[F.col(c).alias(f"{c}_u") for c in ("x", "c", "place", "n")])
    v = rows.select("key", *[F.col(c).alias(f"{c}_v") for c in ("x", "c", "place", "n")], F.col("main"))
    fits = (
        (F.col("c_u") != F.col("c_v"))
        & ((F.col("c_v") == F.col("main")) | (F.col("x_u") < F.col("x_v")))
        & (100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v"))
        & ((100 + percent) * F.least(F.expr("n_u - place_u"), F.expr("n_v - place_v")) >= percent * F.expr("n_u + n_v"))
    )
    v = v.withColumnRenamed("key", "key_v")
    return u.join(v, (F.col("key") == F.col("key_v")) & fits).select(
        F.least("x_u", "x_v").alias("a"), F.greatest("x_u", "x_v").alias("b")
    ).distinct()


def ngram_components(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id: a row per row of ``docs``."""
    return row_components(docs, width, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def row_components(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, row, n_shingles, component_id, component_row: a row per row of ``docs``, and
    of its component the least id with the least name of a row with that id."""
    scope = common.Scope()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = scope.stage(digests(docs, width), "join-digests")
    names = rows.where("n > 0").groupBy("node").agg(
        F.min(first_row("doc_id", "row")).alias("least"),
        F.max("n").alias("n"), F.first("sketch").alias("sketch"),
    ).select("node", F.col("least.id").alias("id"), F.col("least.row").alias("row"), "n", "sketch")
    names = scope.stage(names, "join-names")
    # a row per quarter of a doubling of the sets' sizes
    sizes = names.groupBy(F.floor(F.log2("n") * 4).alias("level")).agg(F.max("n").alias("n"), F.count("*").alias("sets"))
    total = sum(r["sets"] * partenum.expected(r["n"], percent) for r in sizes.collect())
    parts = max(8, math.ceil(total / PART))
    found = scope.stage(candidates(signature_blocks(docs, width, percent, parts), parts), "join-found")
    tested = scope.stage(found.where(f"kind = {STAR}").select("a", "b").distinct(), "join-tested")
    members = scope.stage(
        found.where(f"kind = {MEMBER}").select(F.col("a").alias("key"), F.col("b").alias("x")).distinct(), "join-members"
    )
    scope.drop(found)
    fetched = []

    def from_documents(wanted):
        fetched.append(scope.stage(named_texts(docs, wanted), "join-texts"))
        return fetched[0]

    links = verify(tested, names, from_documents, width, percent, scope)
    scope.drop(fetched[0])
    label = components(links, scope)

    def open_members(members):
        """Members of buckets that are open by now."""
        after = scope.stage(open_buckets(members.select("key", "x"), label), "join-open")
        scope.drop(members)
        return after

    def tell(pairs):
        """Compare pairs that are new, and take their links up."""
        nonlocal tested, links, label
        new = scope.stage(pairs.join(tested, ["a", "b"], "left_anti"), "join-new")
        more = verify(new, names, lambda _: texts, width, percent, scope)
        if not more.isEmpty():
            links = links.union(more)
            scope.drop(label)
            label = components(links, scope)
        tested = tested.union(new)

    members = open_members(members)
    if not members.isEmpty():
        inside = members.select(F.col("x").alias("node")).distinct().join(names, "node").select("row")
        texts = scope.stage(named_texts(docs, scope.stage(inside, "join-inside")), "join-texts")
        for turn in range(TURNS):
            tell(pivot_pairs(members, turn))
            members = open_members(members)
        still = scope.stage(
            members.select(F.col("x").alias("node")).distinct().join(names, "node").select("row")
            .join(texts, "row").select("text"),
            "join-still",
        )
        rare = scope.stage(rare_elements(still, width, percent), "join-rare")
        tell(meeting_pairs(open_buckets(rare, label, "place", "n"), percent))
    least = (
        label.join(names, "node").groupBy("comp").agg(F.min(first_row("id", "row")).alias("least"))
        .join(label, "comp").select("node", "least")
    )
    known = names.select("node", first_row("id", "row").alias("own")).join(least, "node", "left").select(
        "node", F.coalesce("least", "own").alias("least")
    ).select("node", F.col("least.id").alias("component_id"), F.col("least.row").alias("component_row"))
    out = rows.where("n > 0").join(known, "node").select(
        "doc_id", "row", F.col("n").alias("n_shingles"), "component_id", "component_row"
    )
    out = out.unionByName(
        rows.where("n = 0").select(
            "doc_id", "row", F.col("n").alias("n_shingles"),
            F.col("doc_id").alias("component_id"), F.col("row").alias("component_row"),
        )
    )
    # the result is small; with it staged, all that it was made of can go
    return scope.leave(out, "join-components")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(common.documents(spark, sf_dir))
