"""N-gram Jaccard join by prefix trees.

A document is the set of its five-word shingles. All sets are sorted in one global
order: rare shingles before frequent ones, then by hash. Two sets that link share a
shingle in their prefixes, the first |A| - ceil(0.8 |A|) + 1 members; so the root
branches of a prefix tree over all sets, one for each prefix shingle, hold all
candidate pairs. The branches are spread over the cluster, and a meeting is counted
once for every branch it happens in; it stays a candidate only if that partial overlap
and what remains of either set behind its prefix can still reach the overlap. The
sets that others have met are then stored as tries and the others are carried down them: partial overlaps are shared by all
sets below a node, and a subtree is left as soon as what remains of either
side cannot reach the overlap any more.

Large groups of near copies would make a branch quadratic. They are joined first:
every set is compared with the least set of MinHash groups that they share, which is
linear. Later only sets of different components are looked at, and a set meets a
component, not each of its members: one link ties them, and a link inside a component
cannot change it. Equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from originline.llm.common import extended, mix, prepare, shingle_hashes, slices, text_bytes, word_hashes
from originline.llm.components import components
from originline.session import stage_once, unstage

WIDTH = 5
KEYS, SHARED = 8, 2  # MinHash groups of a set; how many must agree for a comparison
#: One row in so many is counted to tell frequent shingles; three sightings make one.
SAMPLE, SEEN = 16, 3
#: Rounds in which nodes meet the leading component of their MinHash groups.
LEADERS = 2
#: Largest bitmap that is sent to the workers: 2^27 bits, 16 MB.
MOST_BITS = 27


def needed(a, b):
    """The least overlap of sets of ``a`` and ``b`` members with 100 * overlap >= 80 * union."""
    return (4 * (a + b) + 8) // 9


def prefix_length(n):
    return n - (4 * n + 4) // 5 + 1


class Bits:
    """A set of 64-bit hashes as a bitmap of fixed size; it may hold more, never less."""

    def __init__(self, bits: int, words: np.ndarray) -> None:
        self.shift, self.words = np.uint64(64 - bits), words

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bitmap(hashes: DataFrame, column: str, each: int = 16) -> Bits:
    """The bitmap of a column of hashes, of ``each`` bits or more for one; what is collected is bounded by its size."""
    n = hashes.count()
    bits = min(MOST_BITS, max(16, int(np.ceil(np.log2(max(n, 1) * each)))))
    at = F.shiftrightunsigned(F.col(column), 64 - bits)
    rows = hashes.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))").alias("b"))
    found = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return Bits(bits, words)


def _sets(texts: pa.Array, low: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct shingles in ascending order) of every text of a batch."""
    data, offsets = text_bytes(texts)
    for first, last in slices(data, offsets):
        part = data[offsets[first] : offsets[last]]
        words, bounds = word_hashes(part, offsets[first : last + 1] - offsets[first])
        shingles, at = shingle_hashes(words, bounds, WIDTH)
        for row in range(first, last):
            yield row, np.unique(shingles[at[row - first] : at[row - first + 1]])


def _signature(members: np.ndarray) -> bytes:
    """128 bits that equal sets share: two sums of scrambled members."""
    with np.errstate(over="ignore"):
        sums = [mix(members ^ np.uint64(k)).sum(dtype=np.uint64) for k in (0x5BD1E995, 0xC2B2AE3D27D4EB4F)]
    return np.array(sums, np.uint64).tobytes()


_MIN_KEYS = mix(np.arange(1, KEYS + 1, dtype=np.uint64))


def frequent_shingles(docs: DataFrame) -> Bits:
    """Shingles seen ``SEEN`` times in a sixteenth of the texts, as a bitmap.

    It only shapes the global order, which is the same for all sets whatever the
    bitmap holds; results do not depend on it.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for _, s in _sets(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))], ["shingle"])

    text = F.col("text").cast("string").alias("text")
    sample = docs.select(text).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counted = sample.mapInArrow(emit, "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    return bitmap(stage_once(counted.where(F.col("n") >= SEEN).select("shingle"), "frequent"), "shingle")


def _row_hash() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text").cast("string"))


def _picked(batch: pa.RecordBatch, bits: Bits) -> pa.RecordBatch:
    """The rows of (row hash, text) whose hash is in the bitmap."""
    if batch.num_rows == 0:
        return batch
    return batch.filter(pa.array(bits.has(batch.column(0).to_numpy().view(np.uint64))))


def describe(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and, per row: set size ``n_shingles``, signature, row hash and MinHash keys."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], _row_hash().alias("_id"), F.col("text").cast("string").alias("_text"))
    names = [*keep, "n_shingles", "sig", "pick", "keys"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.num_columns - 2).to_pylist()
            size, sig, pick, keys = [], [], [], []
            for row, members in _sets(batch.column(batch.num_columns - 1)):
                size.append(len(members))
                own = _signature(members) if len(members) else None
                sig.append(own)
                pick.append(None if own is None else ids[row])
                keys.append(None if own is None else [int(mix(members ^ k).min().view(np.int64)) for k in _MIN_KEYS])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 2)), pa.array(size, pa.int64()), pa.array(sig, pa.binary()),
                 pa.array(pick, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names)

    return rows.mapInArrow(work, extended(rows.drop("_id", "_text"), "n_shingles long, sig binary, pick long, keys array<long>"))


def prefixes(docs: DataFrame, nodes: DataFrame, frequent: Bits) -> DataFrame:
    """The rows of ``nodes`` with ``prefix``, the leading shingles in the global order.

    ``sig`` and ``pick`` name the row of ``docs`` whose text is read for a node.
    """
    shared = docs.sparkSession.sparkContext.broadcast((frequent, bitmap(nodes, "pick")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, bits = shared.value
        for batch in batches:
            batch = _picked(batch, bits)
            ids = batch.column(0).to_pylist()
            sig, pick, prefix = [], [], []
            for row, members in _sets(batch.column(1)):
                if len(members):
                    late = frequent.has(members)
                    sig.append(_signature(members))
                    pick.append(ids[row])
                    prefix.append(np.concatenate([members[~late], members[late]])[: prefix_length(len(members))].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig, pa.binary()), pa.array(pick, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], ["sig", "pick", "prefix"])

    rows = docs.select(_row_hash().alias("_id"), F.col("text").cast("string").alias("text"))
    made = rows.mapInArrow(work, "sig binary, pick long, prefix array<long>")
    return made.join(nodes, ["sig", "pick"]).drop("sig", "pick")


def lexicographic(members: list[np.ndarray]) -> list[int]:
    return sorted(range(len(members)), key=lambda i: members[i].astype(">u8").tobytes())


def descend(probe: np.ndarray, members: list[np.ndarray], order: list[int], first: bool = False) -> list[int]:
    """Which of the sets in a trie link with ``probe``, or one of them if ``first``.

    Sets are sorted in ascending order; ``order`` is their lexicographic order.

    The trie is walked depth first, its sets in lexicographic order: the path shared
    with the set before is kept with its partial overlaps. On the way down, a set is
    left as soon as its overlap so far and the shorter of both remainders fall short.
    """
    linked: list[int] = []
    path = np.zeros(0, np.uint64)
    overlap = np.zeros(1, np.int64)  # after each member of the path
    for i in order:
        own = members[i]
        least = needed(len(probe), len(own))
        m = min(len(path), len(own))
        differ = np.flatnonzero(path[:m] != own[:m])
        depth = int(differ[0]) if len(differ) else m
        overlap = overlap[: depth + 1]
        step = 32
        while depth < len(own):
            rest = len(probe) - int(np.searchsorted(probe, own[depth]))
            if overlap[depth] + min(len(own) - depth, rest) < least:
                break
            part = own[depth : depth + step]
            at = np.minimum(np.searchsorted(probe, part), len(probe) - 1)
            overlap = np.concatenate([overlap, overlap[depth] + np.cumsum(probe[at] == part)])
            depth += len(part)
            step *= 2
        path = own[:depth]
        if depth == len(own) and overlap[depth] >= least:
            linked.append(i)
            if first:
                break
    return linked


BLOCK, BLOCK_MEMBERS = 64, 100_000  # sets, and shingles in them, of one trie


def made_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node``, ``n`` and ``members``, the shingles of the nodes in ``wanted``, made again from the texts and staged."""
    wanted = stage_once(nodes.select("node", "sig", "pick", "n").join(wanted, "node"), "wanted")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "pick"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            found = [m for _, m in _sets(_picked(batch, bits).column(1)) if len(m)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_signature(m) for m in found], pa.binary()), pa.array([m.tobytes() for m in found], pa.binary())],
                ["sig", "members"])

    rows = docs.select(_row_hash().alias("_id"), F.col("text").cast("string").alias("text"))
    made = rows.mapInArrow(emit, "sig binary, members binary").dropDuplicates(["sig"])
    sets = stage_once(wanted.select("node", "sig", "n").join(made, "sig").select("node", "n", "members"), "sets")
    unstage(wanted)
    return sets


def compared(sets: DataFrame, members: DataFrame, meetings: DataFrame) -> DataFrame:
    """Links (a, b) between probes and members: one at least wherever a probe links with a group's block.

    ``members`` has (group, node) and ``meetings`` (group, node): sets that may link
    with a member of the group. Members are cut into tries of bounded size, probes
    into blocks, and each trie meets each block of its group's probes.
    """

    def blocks(side: DataFrame, name: str) -> DataFrame:
        load = side.join(sets.select("node", "n"), "node").groupBy("group").agg(F.count("*").alias("k"), F.sum("n").alias("size"))
        return load.select("group", F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("size") / BLOCK_MEMBERS)).alias(name))

    counts = stage_once(blocks(members, "mb").join(blocks(meetings, "pb"), "group"), "blocks")

    def dealt(side: DataFrame, own: str, own_n: str, other: str, other_n: str, probe: bool) -> DataFrame:
        at = side.join(counts, "group").select(
            "group", "node", F.pmod(F.xxhash64("node"), F.col(own_n)).alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_n) - 1)).alias(other))
        return at.join(sets.select("node", "members"), "node").select("group", "m", "p", "node", F.lit(probe).alias("probe"), "members")

    both = dealt(members, "m", "mb", "p", "pb", False).unionByName(dealt(meetings, "p", "pb", "m", "mb", True))

    def check(table: pa.Table) -> pa.Table:
        node, probe = table["node"].to_numpy(), table["probe"].to_numpy()
        sets = [np.frombuffer(m.as_buffer(), np.uint64) for m in table["members"]]
        stored = np.flatnonzero(~probe).tolist()
        trie = [sets[i] for i in stored]
        order = lexicographic(trie)
        a, b = [], []
        for i in np.flatnonzero(probe).tolist():
            for k in descend(sets[i], trie, order, first=True):
                a.append(node[stored[k]])
                b.append(node[i])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return both.groupBy("group", "m", "p").applyInArrow(check, "a long, b long")


#: Members of a component that a round looks at, about so many up to here; the last round takes the rest.
ROUNDS = (64, 1024)


def linked(docs: DataFrame, nodes: DataFrame, members: DataFrame, meetings: DataFrame, tied: DataFrame | None = None, whole: bool = True) -> DataFrame:
    """Components of the links that tie every node to every group of which it links with a member.

    ``tied`` are the components of earlier links; the result holds these too, and takes its place.
    Unless ``whole``, only the first round is held: it ties most, and a later call must look at the rest.

    ``members`` has (group, node, k), k the members of the group, and ``meetings``
    (group, node). A round compares the nodes with a few members of their groups,
    drawn by hash, then ties what it has linked: a node that is by now in one
    component with its group needs no further comparison with it. In a group of near
    copies nearly all leave in the first round. Whoever is left meets the rest. Where
    ``meetings`` tell by ``c`` how much a node shares with a group, every node meets its
    best group before all others, so that what this ties need not meet at all.
    """
    meetings = stage_once(meetings, "meetings")
    members = stage_once(members.join(meetings.select("group").distinct(), "group"), "members")
    sets = made_sets(docs, nodes, members.select("node").unionByName(meetings.select("node")).distinct())
    place = F.pmod(F.xxhash64(F.lit(17), "node"), F.col("k"))

    def tie(part: DataFrame, meetings: DataFrame) -> None:
        nonlocal tied
        last, tied = tied, components(compared(sets, part.select("group", "node"), meetings), "a", "b", known=tied)
        if last is not None:
            unstage(last)

    def apart() -> DataFrame:
        """The meetings whose node is not in one component with its group by now."""
        at = lambda key: tied.select(F.col("node").alias(key), F.col("component").alias(f"_{key}"))
        other = F.coalesce("_node", "node") != F.coalesce("_group", "group")
        left = meetings.join(at("node"), "node", "left").join(at("group"), "group", "left").where(other).select("group", "node")
        left = stage_once(left, "meetings")
        unstage(meetings)
        return left

    if "c" in meetings.columns:
        best = meetings.groupBy("node").agg(F.max_by("group", F.struct("c", (-F.col("group")).alias("o"))).alias("group"))
        best = stage_once(best, "best")
        tie(members.where(place < ROUNDS[0]), best)
        unstage(best)
        meetings = apart()
    low = 0
    for high in (*ROUNDS, None):
        if low and meetings.isEmpty():
            break
        tie(members.where((place >= low) & (place < high) if high else place >= low), meetings)
        if not whole or high is None or members.where(place >= high).isEmpty():
            break
        meetings, low = apart(), high
    unstage(meetings, members, sets)
    return tied


def star_meetings(nodes: DataFrame) -> DataFrame:
    """Every node with the least node of its MinHash groups, where ``SHARED`` groups agree on it."""
    keyed = nodes.select("node", "n", F.posexplode("keys").alias("k", "key"))
    least = keyed.groupBy("k", "key").agg(F.min(F.struct("node", "n")).alias("low"), F.count("*").alias("c")).where("c > 1")
    met = keyed.join(least.select("k", "key", "low"), ["k", "key"]).where("node > low.node and 5 * n >= 4 * low.n and 5 * low.n >= 4 * n")
    return met.groupBy(F.col("low.node").alias("group"), F.col("node").alias("node")).agg(F.count("*").alias("c")).where(
        F.col("c") >= SHARED).select("group", "node")


def leader_meetings(placed: DataFrame) -> DataFrame:
    """Every node with one component at most: that which leads most of its MinHash groups, ``SHARED`` at least.

    The largest component leads a group. The stars leave a large group of near copies
    in many components, as its MinHash groups have different least nodes; were these
    to meet in the branches, each would meet each. Here a node meets one.
    """
    keyed = placed.select("node", F.coalesce("component", "node").alias("component"),
                          F.coalesce("members", F.lit(1)).cast("long").alias("members"), F.posexplode("keys").alias("k", "key"))
    lead = keyed.groupBy("k", "key").agg(
        F.max(F.struct("members", (-F.col("component")).alias("c"))).alias("lead"), F.min("component").alias("low"), F.max("component").alias("high"))
    lead = lead.where("low < high").select("k", "key", (-F.col("lead.c")).alias("group"))
    met = keyed.join(lead, ["k", "key"]).where(F.col("component") != F.col("group"))
    shared = met.groupBy("node", "group").agg(F.count("*").alias("c")).where(F.col("c") >= SHARED)
    return shared.groupBy("node").agg(F.max_by("group", F.struct("c", (-F.col("group")).alias("o"))).alias("group")).select("group", "node")


def branch_meetings(branches: DataFrame) -> DataFrame:
    """(group, node): nodes that share prefix shingles with another component and may still link with it.

    ``branches`` has ``node``, ``n``, ``component`` and its ``members``, both null
    for a node by itself, and ``prefix``. Of two components the smaller one's node
    meets the other. Of two sets, that whose prefix ends first in the global order
    has all members shared up to there in both prefixes, and n - prefix more may be
    shared; so the number of shared prefix shingles and the larger such rest bound
    the overlap. A node's shingles shared with a component are as many or more
    than with any member, so what is left out links with no member.
    """
    postings = branches.select(
        F.explode("prefix").alias("shingle"), "node", "component", F.col("n").cast("int").alias("n"), F.col("members").cast("int").alias("members"))
    sorted_rows = postings.repartition("shingle").sortWithinPartitions("shingle")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            node = batch.column(1)
            columns = [c.to_numpy(zero_copy_only=False) for c in (
                batch.column(0), node, pc.coalesce(batch.column(2), node), batch.column(3).cast(pa.int64()),
                pc.coalesce(batch.column(4), pa.scalar(1, pa.int32())))]
            if not len(columns[0]):
                continue
            if held and held[0][0][0] == columns[0][0] == columns[0][-1]:
                held.append(columns)  # one shingle fills the batch: its run goes on
                continue
            columns = [np.concatenate(x) for x in zip(*held, columns, strict=True)]
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            yield from _meetings_of([c[:last] for c in columns])
            held = [[c[last:] for c in columns]]
        if held:
            yield from _meetings_of([np.concatenate(x) for x in zip(*held, strict=True)])

    met = sorted_rows.mapInArrow(walk, "group long, node long, c long, least long")
    counted = met.groupBy("group", "node").agg(F.sum("c").alias("c"), F.min("least").alias("least"))
    return counted.where("c >= least").select("group", "node", "c")


def _meetings_of(columns: list[np.ndarray], room: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Meetings in all runs of equal shingles, in batches of about ``room``."""
    shingle, node, component, size, weight = columns
    if len(shingle) == 0:
        return
    edges = np.flatnonzero(np.diff(shingle)) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(shingle)]])
    mixed = np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)
    out, made = [], 0
    for start, end in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
        order = np.argsort(size[start:end], kind="stable") + start
        n, own, group, members = size[order], node[order], component[order], weight[order]
        near = np.searchsorted(n, (4 * n + 4) // 5, side="left"), np.searchsorted(n, n * 5 // 4, side="right")
        top = members.max()
        for i in range(len(n)):
            j = np.arange(near[0][i], near[1][i])
            larger = (members[j] > members[i]) | ((members[j] == members[i]) & (group[j] > group[i]))
            j = j[larger & (group[j] != group[i])]
            if len(j) == 0:
                continue
            rest = np.maximum(n[i] - prefix_length(n[i]), n[j] - prefix_length(n[j]))
            least = needed(n[i], n[j]) - rest
            if len(j) > 1 and top > 1:  # a component once, with the least bound of its members
                by = np.lexsort((least, group[j]))
                j, least = j[by], least[by]
                once = np.concatenate([[True], group[j][1:] != group[j][:-1]])
                j, least = j[once], least[once]
            out.append((group[j], np.full(len(j), own[i]), least))
            made += len(j)
            if made >= room:
                yield _batch(out)
                out, made = [], 0
    if out:
        yield _batch(out)


def _batch(parts: list[tuple]) -> pa.RecordBatch:
    """Distinct meetings with their counts and least bounds."""
    group, node, least = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((node, group))
    group, node, least = group[order], node[order], least[order]
    first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (node[1:] != node[:-1])]))
    count = np.diff(np.concatenate([first, [len(group)]]))
    return pa.RecordBatch.from_arrays(
        [pa.array(group[first]), pa.array(node[first]), pa.array(count), pa.array(np.minimum.reduceat(least, first))],
        ["group", "node", "c", "least"])


def in_components(nodes: DataFrame, tied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes with ``component`` and ``members`` (null if alone), staged, and (group, node, k) of them."""
    # Staged, so that the join reads both sides from exchanges and Spark can split a large component.
    sizes = stage_once(tied.groupBy("component").agg(F.count("*").alias("members")), "sizes")
    placed = stage_once(nodes.select("node", "n", "sig", "pick", "keys").join(tied.join(sizes, "component"), "node", "left"), "placed")
    unstage(sizes)
    return placed, placed.select(F.coalesce("component", "node").alias("group"), "node", F.coalesce("members", F.lit(1)).alias("k"))


def link_components(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), group: str | None = None) -> DataFrame:
    """``keep`` columns, ``n_shingles`` and ``component_id`` of every row of ``docs``.

    ``group`` names a further column: a number of the component, null for empty sets.

    Two rows link if 100 * overlap >= 80 * union of their shingle sets;
    ``component_id`` is the least doc_id reachable by links, the row's own included.
    Words are runs between white space, A-Z lower-cased; a text of fewer than five
    words is one shingle; without words, or null, its set is empty and it links with
    nothing. Rows that share a doc_id are separate rows with their own sets. Null
    doc_ids are passed over in the minimum. An empty table gives an empty result;
    other columns are ignored; texts are read whole.
    """
    prepare(docs.sparkSession)
    keep = [c for c in keep if c not in ("n_shingles", "component_id")]
    rows = stage_once(describe(docs, keep if "doc_id" in keep else [*keep, "doc_id"]), "described")
    nodes = rows.where("sig is not null").groupBy("sig").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct("pick", "n_shingles", "keys")).alias("one"))
    nodes = nodes.select("sig", "least_id", "one.pick", F.col("one.n_shingles").alias("n"), "one.keys")
    nodes = stage_once(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    alone = nodes.select(F.col("node").alias("group"), "node", F.lit(1).alias("k"))
    tied = linked(docs, nodes, alone, star_meetings(nodes))
    for _ in range(LEADERS):
        placed, groups = in_components(nodes, tied)
        tied = linked(docs, nodes, groups, leader_meetings(placed), tied, whole=False)
        unstage(placed)
    placed, groups = in_components(nodes, tied)
    branches = prefixes(docs, placed.drop("keys"), frequent_shingles(docs))
    final = linked(docs, nodes, groups, branch_meetings(branches), tied)
    unstage(placed)
    member = nodes.select("node", "sig", "least_id").join(final, "node", "left").select(
        "sig", "least_id", F.coalesce("component", "node").alias("component"))
    least = member.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_sig = member.join(least, "component").select("sig", "component_id", "component")
    found = rows.select(*keep, *([] if "doc_id" in keep else ["doc_id"]), "n_shingles", "sig").join(of_sig, "sig", "left")
    more = [F.col("component").alias(group)] if group else []
    return found.select(*keep, "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *more)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, less all but one of each component.

    The row of the least doc_id stays (null last; between texts of one doc_id the
    least text hash decides, between rows equal in both the least hash of the others). Rows without words link with nothing and all stay.
    """
    prepare(docs.sparkSession)
    text = F.col("text").cast("string")
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all")
    keyed = docs.select(packed, "doc_id", text.alias("text"), F.xxhash64("doc_id").alias("_key"), F.xxhash64(text).alias("_hash"))
    groups = link_components(keyed.select("doc_id", "text", "_key", "_hash"), ("doc_id", "_key", "_hash"), "_group")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_hash"), F.col("_key"))
    first = groups.where("_group is not null").groupBy("_group").agg(F.min(order).alias("low"))
    winners = stage_once(first.select("low._key", "low._hash").distinct(), "winners")
    worded = F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    # Rows equal in doc_id and text may differ elsewhere: the least hash of all their columns stays.
    told = [F.col(f"_all.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    live = keyed.where(worded).join(winners, ["_key", "_hash"], "left_semi")
    live = live.groupBy("_key", "_hash").agg(F.min_by("_all", F.xxhash64(*told)).alias("_all"))
    return live.select("_all.*").unionByName(keyed.where(~worded).select("_all.*"))


ORACLE_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle
  FROM worded),
sized AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY 1),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingled a JOIN shingled b USING (shingle)
  WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM worded
  UNION SELECT r.doc_id, e.y FROM reached r JOIN edges e ON e.x = r.other)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM worded w LEFT JOIN sized s USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1) r USING (doc_id)
"""
