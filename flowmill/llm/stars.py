"""Sets derived from a highly similar one: leaders, their members' differences, and links among members from these alone.

Of the sets in an index list, the smallest one leads those that may be similar to it; the one that leads a set in most of its lists
is its leader.  A member is compared with its leader once, text with text, and from then on it is its *difference*: the shingles
that only one of the two has.  Leaders' leaders are followed by adding up differences.  The differences of two members of a star
differ in just what the members differ in, so their exact overlap follows from what is known of the leader and two short lists:
no text is sent again, and no pair that isn't linked is ever written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import cut
from flowmill.llm.shingle_sets import MAX_PARTNERS, least_shared, nonempty_set, texts_of
from flowmill.llm.simhash import whole_groups

#: A list of more entries is cut into parts, with a leader each. Which sets lead changes the work, not what is found.
MAX_LIST = 100_000

#: A member may differ from its leader in so much of both sets together.
MOST_DIFFERENT = 0.34

#: Members of a star that a task compares with as many others; bytes of their differences.
STAR_ROWS, STAR_BYTES = 20_000, 16 << 20


def leaders(shared: DataFrame, *, similarity: float, max_list: int = MAX_LIST) -> DataFrame:
    """``node, leader``: of the sets in ``shared`` (token, size, node; see :func:`flowmill.llm.shingle_sets.prefixes`) that have one.

    A leader comes before its members by size and then by name, so that nothing leads in a circle.
    """
    hot = cut(shared.groupBy("token").count().where(F.col("count") > max_list).select("token", F.ceil(F.col("count") / max_list).cast("int").alias("parts")))
    parted = shared.select("*", F.lit(0).alias("part"))
    if not hot.isEmpty():
        parted = shared.join(hot, "token", "left").select(*shared.columns, F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, ends in whole_groups(batches, 2):
            size, left, node = rows[:, 2] >> 32, rows[:, 2] & 0xFFFFFFFF, rows[:, 3]
            group = np.repeat(np.arange(len(starts)), ends - starts)
            at = np.lexsort((node, size, group))
            while len(at):
                new = np.ones(len(at), bool)
                new[1:] = group[at[1:]] != group[at[:-1]]
                lead = at[new][np.cumsum(new) - 1]  # the first that is left in each list
                least = least_shared(size[at] + size[lead], similarity)
                fits = least <= size[lead]
                votes = fits & (node[at] != node[lead]) & (np.minimum(left[at], left[lead]) >= least)
                if votes.any():
                    led, by = at[votes], lead[votes]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[led], size[led], node[by], size[by])], ["node", "size", "leader", "leader_size"])
                at = at[~fits]

    key = ["token", "part"]
    voted = parted.select(*key, "size", "node").repartition(*key).sortWithinPartitions(*key, "size", "node").mapInArrow(vote, "node long, size long, leader long, leader_size long")
    counted = voted.groupBy("node", "size", "leader", "leader_size").agg(F.count("*").alias("votes"))
    best = counted.groupBy("node").agg(F.max(F.struct("votes", (-F.col("leader_size")).alias("smaller"), (-F.col("leader")).alias("earlier"), "leader")).alias("best"))
    return best.select("node", "best.leader")


def differences(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, *, shingle: int, similarity: float) -> DataFrame:
    """``leader, node, size, leader_size, linked, diff`` of each of ``pairs`` (leader, node): whether it is similar enough, and, where the two
    differ in at most MOST_DIFFERENT of both, the shingles (8 bytes each, sorted) that only one of them has; else null.

    A member's text is sent to its leader's; a leader of many members is sent to each part of these.
    """
    many = pairs.groupBy("leader").agg(F.ceil(F.count("*") / MAX_PARTNERS).alias("parts"))
    keyed = cut(pairs.join(many, "leader").select(F.col("leader").alias("centre"), F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node"))
    wanted = keyed.select("centre", "part", "node", F.lit(1).alias("partner")).unionAll(keyed.select("centre", "part", F.col("centre").alias("node"), F.lit(0).alias("partner")).distinct())
    sent = texts_of(wanted, nodes, texts).select("centre", "part", "partner", "node", "utf8")
    names = ["leader", "node", "size", "leader_size", "linked", "diff"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own, before = None, np.zeros(0, "u8"), None
        for batch in batches:
            found = []
            for centre, partner, node, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if not partner:
                    if centre != last:
                        last, own, before = centre, nonempty_set(text.as_py(), shingle), None
                elif node != before:  # repeated rows send a text more than once
                    before, other = node, nonempty_set(text.as_py(), shingle)
                    diff = np.setxor1d(own, other, assume_unique=True)
                    both = len(own) + len(other)
                    linked = (both - len(diff)) // 2 >= int(least_shared(np.array(both), similarity))
                    found.append((centre, node, len(other), len(own), int(linked), diff.tobytes() if len(diff) <= MOST_DIFFERENT * both else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.binary() if k == 5 else pa.int64()) for k in range(6)], names)

    key = ["centre", "part"]
    return sent.repartition(*key).sortWithinPartitions(*key, "partner", "node").mapInArrow(check, "leader long, node long, size long, leader_size long, linked long, diff binary")


def followed(told: DataFrame, *, similarity: float) -> DataFrame:
    """``leader, node, size, linked, diff`` of each member that ``told`` (:func:`differences`, one leader a node) gives a difference,
    against the furthest of its leader's leaders that it isn't too different from.

    Differences add up: what a member and its leader differ in, against what the leader and its own differ in, is what the member
    and that one differ in, so no text is compared again.  The steps double, so rounds grow with the logarithm of a chain.
    """
    now = cut(told.where("diff is not null").select("leader", "node", "size", "leader_size", "linked", "diff", F.lit(True).alias("moved")))
    names = ["leader", "node", "size", "leader_size", "linked", "diff", "moved"]

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [c.to_pylist() for c in batch.columns]
            out = []
            for leader, node, size, leader_size, linked, diff, above, above_size, above_diff in zip(*rows, strict=True):
                row = (leader, node, size, leader_size, linked, diff, False)
                if above is not None:
                    further = np.setxor1d(np.frombuffer(diff, "u8"), np.frombuffer(above_diff, "u8"), assume_unique=True)
                    both = size + above_size
                    if len(further) <= MOST_DIFFERENT * both:
                        row = (above, node, size, above_size, int((both - len(further)) // 2 >= int(least_shared(np.array(both), similarity))), further.tobytes(), True)
                out.append(row)
            kinds = [pa.int64()] * 5 + [pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    while True:
        upper = now.select(F.col("node").alias("of"), F.col("leader").alias("above"), F.col("leader_size").alias("above_size"), F.col("diff").alias("above_diff"))
        joined = now.join(upper, F.col("leader") == F.col("of"), "left").select(*names[:-1], "above", "above_size", "above_diff")
        now = cut(joined.mapInArrow(compose, "leader long, node long, size long, leader_size long, linked long, diff binary, moved boolean"))
        if now.where("moved").isEmpty():
            return now.drop("moved")


def links_between(nodes: np.ndarray, sizes: np.ndarray, known: np.ndarray, diffs: list[np.ndarray], asking: np.ndarray, asked: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Links (names) that connect what is similar among members ``asking`` and ``asked`` (places), given their differences from one
    leader. ``known``: members with the same label are connected already.
    """
    labels, lengths = known.copy(), np.array([len(d) for d in diffs], "i8")
    flat = np.concatenate([np.zeros(0, "u8"), *[diffs[k] for k in asked]])
    owner = np.repeat(asked, lengths[asked])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]  # lists of who has each shingle
    most = np.zeros(len(nodes), "i8")
    for a in asking.tolist():
        most[asked] = sizes[a] + sizes[asked] - 2 * least_shared(sizes[a] + sizes[asked], similarity)
        low, high = np.searchsorted(flat, diffs[a]), np.searchsorted(flat, diffs[a], "right")
        some = np.flatnonzero(high > low)
        spans = high[some] - low[some]
        places = np.repeat(low[some] - np.concatenate([[0], np.cumsum(spans)[:-1]]).astype("i8"), spans) + np.arange(int(spans.sum()))
        common = np.bincount(owner[places], minlength=len(nodes))
        hit = asked[lengths[a] + lengths[asked] - 2 * common[asked] <= most[asked]]
        hit = hit[labels[hit] != labels[a]]
        if len(hit):
            others, first = np.unique(labels[hit], return_index=True)
            for b in hit[first].tolist():
                yield int(nodes[a]), int(nodes[b])
            labels[np.isin(labels, others)] = labels[a]


def star_links(members: DataFrame, *, similarity: float, star_rows: int = STAR_ROWS, star_bytes: int = STAR_BYTES) -> DataFrame:
    """``a, b``: links that, with those to leaders, connect all similar members of each star. ``members``: see :func:`differences`.

    Only members that aren't linked to their leader ask; the others are connected through it.  Large stars are dealt out: parts of
    those that ask meet parts of all.
    """
    members = members.where("diff is not null")
    of_star = members.groupBy("leader").agg(F.count("*").alias("n"), F.sum(F.length("diff")).alias("bytes"), F.sum(1 - F.col("linked")).alias("loose"), F.sum((1 - F.col("linked")) * F.length("diff")).alias("loose_bytes"))

    def parts(rows: str, size: str):
        return F.greatest(F.ceil(F.col(rows) / star_rows), F.ceil(F.col(size) / star_bytes)).cast("int")

    stars = cut(of_star.where("loose > 0 and n > 1").select(F.col("leader").alias("of"), parts("n", "bytes").alias("parts"), parts("loose", "loose_bytes").alias("loose_parts")))
    rows = members.join(stars, F.col("leader") == F.col("of"))
    own, own_loose = (F.pmod(F.xxhash64("node"), x).cast("int") for x in ("parts", "loose_parts"))

    def every(x: str):
        return F.explode(F.sequence(F.lit(0), F.col(x) - 1))

    names = ["leader", "asking_part", "part", "asks", "node", "size", "linked", "diff"]
    asked = rows.select("*", own.alias("part"), every("loose_parts").alias("asking_part"), F.lit(0).alias("asks"))
    asking = rows.where("linked = 0").select("*", own_loose.alias("asking_part"), every("parts").alias("part"), F.lit(1).alias("asks"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for star in _stars(batches):
            asks, node, size, linked = (star.column(k).to_numpy() for k in (3, 4, 5, 6))
            diffs = [np.frombuffer(x.as_py(), "u8") for x in star.column(7)]
            name, first, place = np.unique(node, return_index=True, return_inverse=True)
            known = np.where(linked[first] == 1, -1, np.arange(len(name)))
            found = [*links_between(name, size[first], known, [diffs[k] for k in first], place[asks == 1], np.unique(place[asks == 0]), similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["a", "b"])

    key = names[:3]
    return asked.select(names).unionAll(asking.select(names)).repartition(*key).sortWithinPartitions(*key, "asks", "node").mapInArrow(search, "a long, b long").distinct()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (leader, asking part, part), which come together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
        if held and any(held[0].column(k)[0].as_py() != keys[0, k] for k in range(3)):
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < len(keys):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)
