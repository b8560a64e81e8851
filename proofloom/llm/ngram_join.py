"""N-gram Jaccard join with a token-group matrix.

Documents become sets of hashed 5-word shingles; equal sets are one node.  Two sets with 100 * intersection >= 75 *
union share a token among the first n - ceil(0.75 n) + 1 of each, in any order of the tokens that is the same for
all sets.  The order here puts tokens that stand in many documents last (estimated from a sample of documents, which
changes the cost and never the result), so frequent passages hardly meet.

1. Every node's first tokens are dealt to token buckets; tokens of a single node end there.
2. Partition: in each token's list the smallest node leads.  A node is compared with the leader it shares most
   tokens with; whoever is similar enough is linked.  Nodes of one leader are a family of similar documents, and a
   family is cut into groups of bounded size, one class of linked nodes or the unlinked ones at a time.  Nodes of small
   families that stand in a long list are grouped by their longest list and by size instead.
3. Token-group matrix: a token is held against the groups whose union has it.  The tokens that two groups share, plus
   what a member of each could share beyond its first tokens, bound the overlap of any two members; only pairs of
   groups whose bound reaches the needed overlap are opened, and none whose members are all of one class.
4. Members of opened groups are compared exactly, group against group in one task: the smaller group of a pair comes to
   the larger, which is sent once for many of them.  Links join the classes.

Nodes of one class are never compared again, so a class of near copies costs about one comparison per node; rows are
written per group, never per pair of documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.bounds import broadcast_if_small
from ..plans.components import connected_components
from ..plans.lineage import delete_table, written_table
from .common import ending, map_batches, record

WORDS = 5
#: Least similarity in percent.
PERCENT = 75
#: One document in so many is read to find frequent tokens.
ORDER_SAMPLE = 8
#: Tokens are ordered by hash, so only those with hashes in this lowest share are likely to come first and counted.
ORDER_RANGE = 0.4
#: Tokens of so many sampled documents count as frequent; so many of them, the most frequent, are told apart.
FREQUENT_IN_SAMPLE = 2
FREQUENT_TOKENS = 500_000
#: Members of a group, about.
GROUP_NODES = 256
#: Nodes of a list from which those without a large family of their own are grouped by it.
HOT_NODES = 64
#: Nodes that are compared with their leader in one go, about.
STAR_NODES = 64
#: Postings of a token bucket and bytes of sets of a comparison bucket, about.
BUCKET_POSTINGS = 100_000
BUCKET_BYTES = 8_000_000
#: Rows whose sets a worker holds at once.
DEAL_ROWS = 2_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; with fewer words, of the whole sequence."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    held = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lower-cases A-Z and splits at ASCII white space
    if not held:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, held), dtype=np.uint64, count=len(held))
    wide = min(words, len(held))
    total = hashed[: len(held) - wide + 1].copy()
    for i in range(1, wide):
        total = (total ^ (total >> np.uint64(29))) * _STEP + hashed[i : len(held) - wide + 1 + i]
    total = (total ^ (total >> np.uint64(32))) * _MIX
    return np.unique(total ^ (total >> np.uint64(29)) ^ np.uint64(wide))


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Tokens that a set of n shares with any similar set, at least."""
    return -(-percent * n // 100)


def first_tokens(tokens: np.ndarray, frequent: np.ndarray, rank: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The tokens of which a similar set shares one: rare ones by hash, then frequent ones by rank."""
    n = len(tokens)
    many = n - least_overlap(n, percent) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        often = frequent[at] == tokens
        rare = tokens[~often]
        if len(rare) < many:
            common = tokens[often]
            return np.concatenate([rare, common[np.argsort(rank[at[often]], kind="stable")]])[:many]
        tokens = rare
    return tokens[:many]


def _node(tokens: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes()))))


def frequent_tokens(docs: DataFrame, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent tokens and the rank of each by frequency, from a sample of the distinct texts."""
    cut = np.uint64(int(ORDER_RANGE * 2**64))
    sample = docs.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(ORDER_SAMPLE)) == 0).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, DEAL_ROWS) for b in batches for i in range(0, b.num_rows, DEAL_ROWS)):
            held = [s[: np.searchsorted(s, cut)] for t in batch.column(0).to_pylist() for s in [shingles(t, words)]]
            tokens, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield record(token=(tokens.view(np.int64), pa.int64()), n=(n, pa.int64()))

    counted = sample.mapInArrow(ending(count), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") >= FREQUENT_IN_SAMPLE).orderBy(F.col("n").desc(), "token").limit(FREQUENT_TOKENS).toPandas()
    tokens = top["token"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], top["n"].to_numpy(dtype=np.int64)[order]


def _sets(docs: DataFrame, key: str, text: str, words: int, percent: int, frequent) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (null without shingles) and the first tokens, packed."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        often, rank = frequent.value
        n, nodes, first = [], [], []
        for t in batch.column(2).to_pylist():
            tokens = shingles(t, words)
            n.append(len(tokens))
            nodes.append(_node(tokens) if len(tokens) else None)
            first.append(first_tokens(tokens, often, rank, percent).tobytes() if len(tokens) else None)
        return record(doc_id=batch.column(0), text_hash=batch.column(1), n_shingles=(n, pa.int64()), node=(nodes, pa.int64()), first=(first, pa.binary()))

    read = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return map_batches(read, kernel, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, text_hash bigint, n_shingles bigint, node bigint, first binary")


def _shared_lists(sets: DataFrame, buckets: int) -> DataFrame:
    """tokens, nodes, sizes: packed postings of tokens that two nodes or more hold, sorted by token and node."""
    cut = np.uint64(64 - buckets.bit_length() + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in (b.slice(i, DEAL_ROWS) for b in batches for i in range(0, b.num_rows, DEAL_ROWS)):
            tokens, nodes, sizes = [], [], []
            for node, n, first in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if node is not None and node not in seen:
                    seen.add(node)
                    tokens.append(np.frombuffer(first, dtype=np.uint64))
                    nodes.append(node)
                    sizes.append(n)
            if not tokens:
                continue
            lengths = [len(t) for t in tokens]
            token = np.concatenate(tokens)
            node, size = np.repeat(np.array(nodes, dtype=np.int64), lengths), np.repeat(np.array(sizes, dtype=np.int32), lengths)
            bucket = ((token * _STEP) >> cut).astype(np.int64) if buckets > 1 else np.zeros(len(token), dtype=np.int64)
            order = np.argsort(bucket, kind="stable")
            token, node, size, bucket = token[order], node[order], size[order], bucket[order]
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = np.append(starts[1:], len(bucket))
            yield record(
                bucket=(bucket[starts], pa.int64()), tokens=([token[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                nodes=([node[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()), sizes=([size[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
            )

    def gather(held: pa.Table) -> pa.Table:
        token = np.frombuffer(b"".join(held["tokens"].to_pylist()), dtype=np.uint64)
        node = np.frombuffer(b"".join(held["nodes"].to_pylist()), dtype=np.int64)
        size = np.frombuffer(b"".join(held["sizes"].to_pylist()), dtype=np.int32)
        order = np.lexsort((node, token))
        token, node, size = token[order], node[order], size[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
        token, node, size = token[new], node[new], size[new]
        like_last = np.concatenate([[False], token[1:] == token[:-1]])
        kept = like_last | np.append(like_last[1:], False)
        return pa.table({"tokens": pa.array([token[kept].tobytes()], pa.binary()), "nodes": pa.array([node[kept].tobytes()], pa.binary()), "sizes": pa.array([size[kept].tobytes()], pa.binary())})

    dealt = sets.where("node IS NOT NULL").select("node", "n_shingles", "first").mapInArrow(ending(deal), "bucket bigint, tokens binary, nodes binary, sizes binary")
    return dealt.groupBy("bucket").applyInArrow(gather, "tokens binary, nodes binary, sizes binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    kinds = (np.uint64, np.int64, np.int32)
    for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
        yield tuple(np.frombuffer(held, dtype=kind) for held, kind in zip(row, kinds))


def _counted(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and how often each occurs."""
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    starts = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])) if len(first) else np.zeros(0, dtype=np.int64)
    return first[starts], second[starts], np.diff(np.append(starts, len(first)))


def _led(lists: DataFrame, percent: int) -> DataFrame:
    """node, other: every node with the leader (of fitting size) it shares most tokens with."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = []
        for token, node, size in _unpacked(batch):
            heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, dtype=np.int64)
            head = np.repeat(heads, np.diff(np.append(heads, len(token))))
            small, large = np.minimum(size, size[head]).astype(np.int64), np.maximum(size, size[head]).astype(np.int64)
            fits = (np.arange(len(token)) != head) & (100 * small >= percent * large)
            pairs.append((node[fits], node[head[fits]], size[fits]))
        node, other, size = (np.concatenate([p[i] for p in pairs]) for i in range(3))
        sizes = dict(zip(node.tolist(), size.tolist()))
        node, other, n = _counted(node, other)
        return record(node=(node, pa.int64()), other=(other, pa.int64()), n=([sizes[x] for x in node.tolist()], pa.int64()), shared=(n, pa.int64()))

    led = map_batches(lists, kernel, "node bigint, other bigint, n bigint, shared bigint").groupBy("node", "other").agg(F.sum("shared").alias("shared"), F.first("n").alias("n"))
    # A similar pair shares far more than a fifth of the first tokens; the rest is left to the exact search.
    led = led.where(F.col("shared") * 5 * 100 >= F.col("n") * (100 - percent))
    return led.groupBy("node").agg(F.max_by("other", F.struct("shared", "other")).alias("other"))


def _beyond(n: Column, percent: int) -> Column:
    """Tokens of a set of n after its first tokens."""
    return F.ceil(n * percent / F.lit(100)) - 1


def _qualifying(lists: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """one, other: pairs of groups whose bound reaches the needed overlap and whose members are not all of one class.

    ``placed`` has node, group, class (of the whole group; null where its members differ), least and most (sizes in
    the group); any other node is a group and a class of its own.
    """
    schema = "one bigint, other bigint, shared bigint, least bigint, most bigint, other_least bigint, other_most bigint"
    # A group of nodes of several classes has a class number of its own kind, so that it never equals another's.
    known = placed.select("node", F.coalesce("class", F.xxhash64("group", F.lit("mixed"))).alias("class"), "group", "least", "most")

    def met(token, group, own, least, most) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[int, int]]]:
        """Pairs of groups, one for each token that both hold; the sizes of the groups."""
        order = np.lexsort((group, token))
        token, group, own, least, most = token[order], group[order], own[order], least[order], most[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (group[1:] != group[:-1])]) if len(token) else np.zeros(0, dtype=bool)
        token, group, own, least, most = token[new], group[new], own[new], least[new], most[new]
        heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, dtype=np.int64)
        ends = np.append(heads[1:], len(token))
        ones, others = [], []
        for a, b in zip(heads[ends - heads > 1].tolist(), ends[ends - heads > 1].tolist()):
            i, j = np.triu_indices(b - a, 1)
            i, j = i + a, j + a
            fits = (own[i] != own[j]) & (100 * most[i] >= percent * least[j]) & (100 * most[j] >= percent * least[i])
            ones.append(group[i[fits]])
            others.append(group[j[fits]])
        empty = [np.zeros(0, dtype=np.int64)]
        return np.concatenate(ones or empty), np.concatenate(others or empty), dict(zip(group.tolist(), zip(least.tolist(), most.tolist())))

    def counted(pairs) -> pa.RecordBatch:
        one, other, n = _counted(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
        sizes = {group: held for p in pairs for group, held in p[2].items()}
        of = lambda groups, i: ([sizes[g][i] for g in groups.tolist()], pa.int64())
        return record(
            one=(one, pa.int64()), other=(other, pa.int64()), shared=(n, pa.int64()),
            least=of(one, 0), most=of(one, 1), other_least=of(other, 0), other_most=of(other, 1),
        )

    def unpack(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = [np.concatenate(x) for x in zip(*_unpacked(batch))]
        return record(token=(held[0].view(np.int64), pa.int64()), node=(held[1], pa.int64()), size=(held[2], pa.int64()))

    joined = map_batches(lists, unpack, "token bigint, node bigint, size bigint").join(known, "node", "left")
    own = joined.select("token", *[F.coalesce(c, x).alias(c) for c, x in (("group", "node"), ("class", "node"), ("least", "size"), ("most", "size"))])
    buckets = max(1, own.count() // BUCKET_POSTINGS)

    def gather(held: pa.Table) -> pa.Table:
        arrays = [held[c].to_numpy() for c in ("token", "group", "class", "least", "most")]
        return pa.Table.from_batches([counted([met(*arrays)])])

    shared = own.withColumn("_bucket", F.pmod(F.xxhash64("token"), F.lit(buckets))).groupBy("_bucket").applyInArrow(gather, schema)
    sizes = ("least", "most", "other_least", "other_most")
    summed = shared.groupBy("one", "other").agg(F.sum("shared").alias("shared"), *[F.first(c).alias(c) for c in sizes])
    bound = F.col("shared") + F.greatest(_beyond(F.col("most"), percent), _beyond(F.col("other_most"), percent))
    # 100 i >= p (a + b - i) asks for i >= p (a + b) / (100 + p).
    opened = summed.where(bound * (100 + percent) >= percent * (F.col("least") + F.col("other_least"))).select("one", "other")
    within = placed.where("class IS NULL").select(F.col("group").alias("one"), F.col("group").alias("other")).distinct()
    return opened.unionByName(within)


def _packed_sets(docs: DataFrame, sets: DataFrame, nodes: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """node, tokens of the given nodes and of texts that share an id with them, from the text of one document of each."""
    wanted = sets.select("doc_id", "node").join(broadcast_if_small(nodes), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("_rep"))
    wanted, _ = written_table(wanted.select("_rep").distinct())
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    read = rows.join(broadcast_if_small(wanted), F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi").select("text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in (b.slice(i, DEAL_ROWS) for b in batches for i in range(0, b.num_rows, DEAL_ROWS)):
            held = {_node(s): s for t in batch.column(0).to_pylist() if len(s := shingles(t, words))}
            new = [node for node in held if node not in seen]
            seen.update(new)
            yield record(node=(new, pa.int64()), tokens=([held[node].tobytes() for node in new], pa.binary()))

    return read.mapInArrow(ending(pack), "node bigint, tokens binary")


def _links_between(one: list[tuple], other: list[tuple] | None, percent: int) -> list[tuple[int, int]]:
    """Links between members (node, class, tokens) of two groups, or within one, enough to join all classes they join."""
    theirs = one if other is None else other
    if not one or not theirs:
        return []
    owners = np.repeat(np.arange(len(theirs)), [len(t) for _, _, t in theirs])
    tokens = np.concatenate([t for _, _, t in theirs])
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    sizes = np.array([len(t) for _, _, t in theirs])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    links = []
    for node, own, mine in one:
        low, high = np.searchsorted(tokens, mine, "left"), np.searchsorted(tokens, mine, "right")
        counts = high - low
        hits = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        both = np.bincount(owners[hits], minlength=len(theirs))
        for j in np.flatnonzero(100 * both >= percent * (len(mine) + sizes - both)).tolist():
            a, b = find(own), find(theirs[j][1])
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((node, theirs[j][0]))
    return links


def _links(docs: DataFrame, sets: DataFrame, pairs: DataFrame, members: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """Links (node, other) between the members of the given pairs of groups (one, other).

    ``members`` has group, node, class; a group that is not there is the node of that number.
    """
    spark = docs.sparkSession
    groups = pairs.select(F.col("one").alias("group")).unionByName(pairs.select(F.col("other").alias("group"))).distinct()
    held = groups.join(broadcast_if_small(members), "group", "left").select("group", F.coalesce("node", "group").alias("node"), F.coalesce("class", "group").alias("class"))
    held, held_path = written_table(held)
    packed = _packed_sets(docs, sets, held.select("node").distinct(), key, text, words)
    owned, owned_path = written_table(packed.join(broadcast_if_small(held), "node"))
    volume, volume_path = written_table(owned.groupBy("group").agg(F.sum(F.octet_length("tokens")).alias("bytes")))
    # Of a pair the larger group stays and the smaller comes to it: a group goes once to each part of its smaller partners.
    known = lambda side: broadcast_if_small(volume.select(F.col("group").alias(side), F.col("bytes").alias(f"{side}_bytes")))
    met = pairs.join(known("one"), "one").join(known("other"), "other")
    larger = F.struct("one_bytes", "one") >= F.struct(F.col("other_bytes").alias("one_bytes"), F.col("other").alias("one"))
    met = met.select(
        F.when(larger, F.col("one")).otherwise(F.col("other")).alias("stays"), F.when(larger, F.col("other")).otherwise(F.col("one")).alias("comes"),
        F.greatest("one_bytes", "other_bytes").alias("stays_bytes"), F.least("one_bytes", "other_bytes").alias("comes_bytes"),
    )
    loads = met.groupBy("stays").agg(F.max("stays_bytes").alias("own_bytes"), F.ceil(F.sum("comes_bytes") / BUCKET_BYTES).alias("parts"), F.sum("comes_bytes").alias("load"))
    loads, loads_path = written_table(loads)
    total = loads.agg(F.sum(F.col("parts") * F.col("own_bytes") + F.col("load"))).first()[0] or 0
    buckets = max(1, int(total) // BUCKET_BYTES)
    part = F.pmod(F.xxhash64("comes"), F.greatest("parts", F.lit(1)))
    dealt = met.join(broadcast_if_small(loads.select("stays", "parts")), "stays").select("stays", "comes", F.pmod(F.xxhash64("stays", part), F.lit(buckets)).alias("bucket"))
    sides = dealt.select("bucket", F.col("comes").alias("group"), "stays").unionByName(dealt.select("bucket", F.col("stays").alias("group"), F.lit(None).cast("bigint").alias("stays")))
    sides, sides_path = written_table(sides.groupBy("bucket", "group").agg(F.collect_set("stays").alias("meets")))
    # One row per group, not per member, goes to each of its buckets; a group is bounded.
    whole = owned.groupBy("group").agg(F.collect_list(F.struct("node", "class", "tokens")).alias("held"))
    routed = whole.join(broadcast_if_small(sides), "group").select("bucket", "group", "meets", "held")

    def compare(rows: pa.Table) -> pa.Table:
        of = {
            group: [(m["node"], m["class"], np.frombuffer(m["tokens"], dtype=np.uint64)) for m in held]
            for group, held in zip(rows["group"].to_pylist(), rows["held"].to_pylist())
        }
        found = []
        for group, meets in zip(rows["group"].to_pylist(), rows["meets"].to_pylist()):
            for other in meets:
                found += _links_between(of[group], None if group == other else of[other], percent)
        return pa.table({"node": pa.array([f[0] for f in found], pa.int64()), "other": pa.array([f[1] for f in found], pa.int64())})

    links, _ = written_table(routed.groupBy("bucket").applyInArrow(compare, "node bigint, other bigint"))
    for path in (held_path, owned_path, volume_path, loads_path, sides_path):
        delete_table(spark, path)
    return links


def _hot(lists: DataFrame) -> DataFrame:
    """node, n, token: every node in a list of HOT_NODES nodes or more, with the longest of its lists."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        best: dict[int, tuple[int, int, int]] = {}
        for token, node, size in _unpacked(batch):
            _, place, length = np.unique(token, return_inverse=True, return_counts=True)
            length = length[place] if len(token) else length
            hot = length >= HOT_NODES
            for key, n, many, name in zip(node[hot].tolist(), size[hot].tolist(), length[hot].tolist(), token[hot].view(np.int64).tolist()):
                best[key] = max(best.get(key, (0, 0, 0)), (many, name, n))
        held = list(best.values())
        return record(node=(list(best), pa.int64()), many=([h[0] for h in held], pa.int64()), token=([h[1] for h in held], pa.int64()), n=([h[2] for h in held], pa.int64()))

    longest = map_batches(lists, kernel, "node bigint, many bigint, token bigint, n bigint")
    return longest.groupBy("node").agg(F.first("n").alias("hot_n"), F.max_by("token", F.struct("many", "token")).alias("token"))


def _placed(led: DataFrame, labels: DataFrame, sets: DataFrame, lists: DataFrame) -> tuple[DataFrame, str]:
    """node, own (its class), group, class (of the whole group, null where they differ), least and most sizes; the table's path.

    Led nodes and their leaders in groups of about GROUP_NODES of one family, apart by class once they are linked.  Of
    small families and of nodes without a leader, those that meet in a long list are in groups by that list and their size,
    so that a passage of many otherwise different documents makes few pairs of groups instead of all pairs of nodes.
    """
    family = led.select("node", F.col("other").alias("family")).unionByName(led.select(F.col("other").alias("node"), F.col("other").alias("family")))
    family = family.groupBy("node").agg(F.min("family").alias("family"))
    named = family.join(broadcast_if_small(labels), "node", "left").withColumn("own", F.coalesce("label", "node"))
    named = named.withColumn("part_of", F.xxhash64("family", F.coalesce("label", F.lit(0))))
    sized = sets.select("node", "n_shingles").join(broadcast_if_small(named), "node").groupBy("node").agg(
        F.first("own").alias("own"), F.first("part_of").alias("part_of"), F.first("n_shingles").alias("n")
    )
    many = sized.groupBy("part_of").agg(F.count(F.lit(1)).alias("many"))
    sized = sized.join(broadcast_if_small(many), "part_of").join(_hot(lists), "node", "full")
    stays = F.col("token").isNull() | F.coalesce(F.col("many") >= HOT_NODES, F.lit(False))
    n = F.coalesce("n", "hot_n")
    listed = F.xxhash64("token", F.floor(2 * F.log2(n)))
    sized, sized_path = written_table(sized.select("node", F.coalesce("own", "node").alias("own"), F.when(stays, F.col("part_of")).otherwise(listed).alias("part_of"), n.alias("n")))
    parts = sized.groupBy("part_of").agg(F.ceil(F.count(F.lit(1)) / GROUP_NODES).alias("parts"))
    sized = sized.join(broadcast_if_small(parts), "part_of").withColumn("group", F.xxhash64("part_of", F.pmod(F.xxhash64("node"), F.col("parts"))))
    whole = F.when(F.min("own") == F.max("own"), F.min("own"))
    groups = sized.groupBy("group").agg(whole.alias("class"), F.min("n").alias("least"), F.max("n").alias("most"))
    placed, path = written_table(sized.select("node", "own", "group").join(broadcast_if_small(groups), "group"))
    delete_table(led.sparkSession, sized_path)
    return placed, path


def _classes(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, class (a node; null without shingles) and component_id."""
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_tokens(docs, text, words))
    sets, _ = written_table(_sets(docs, key, text, words, percent, frequent))
    postings = sets.agg(F.sum(F.octet_length("first"))).first()[0] or 0
    buckets = 1 << max(0, (postings // 8 // BUCKET_POSTINGS).bit_length())
    lists, lists_path = written_table(_shared_lists(sets, buckets))
    led, led_path = written_table(_led(lists, percent))
    stars = led.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / STAR_NODES).alias("parts"))
    stars = led.join(broadcast_if_small(stars), "other").withColumn("group", F.xxhash64("other", F.pmod(F.xxhash64("node"), F.col("parts"))))
    followers = stars.select("group", "node", F.col("node").alias("class"))
    links = _links(docs, sets, stars.select(F.col("group").alias("one"), "other").distinct(), followers, key, text, words, percent)
    labels = connected_components(links, "node", "other")
    placed, placed_path = _placed(led, labels, sets, lists)
    opened, opened_path = written_table(_qualifying(lists, placed, percent))
    more = _links(docs, sets, opened, placed.select("group", "node", F.col("own").alias("class")), key, text, words, percent)
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more), "node", "other")
    for path in (lists_path, led_path, placed_path, opened_path):
        delete_table(spark, path)
    least = sets.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = least.join(labels, "node", "left").withColumn("class", F.coalesce("label", "node"))
    smallest = named.groupBy("class").agg(F.min("least").alias("component_id"))
    named = named.select("node", "class").join(smallest, "class")
    return sets.join(named, "node", "left").select("doc_id", "text_hash", "n_shingles", "class", F.coalesce("component_id", "doc_id").alias("component_id"))


def similar_classes(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles and component_id, the smallest doc_id that links lead to.

    Texts that are null or without words have no shingles and no links; their component is their own id.  Equal
    sets are linked.  Nulls among the ids lose against any other id of the class.  Repeated rows give a row each;
    an empty table none; other columns are not read.  Nodes and tokens are 64-bit hashes.  Where ids repeat or are
    null, classes that are not linked can have the same component_id.
    """
    return _classes(docs, key, text, words, percent).drop("class")


def keep_one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, without those similar to one that stays: the smallest id of each class.

    A row is known by its id and a hash of its text; of rows equal in both the smallest in its other columns stays.
    Ids may repeat or be null: classes are told apart by their nodes.  Documents without words stay, each of them.
    """
    classes, _ = written_table(_classes(docs, key, text, words, percent).where("n_shingles > 0"))
    rows = classes.groupBy("doc_id", "text_hash", "class").count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash"))
    judged = rows.join(rows.groupBy("class").agg(first.alias("first")), "class")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    judged, _ = written_table(judged.select("doc_id", "text_hash", "count", is_first.alias("stays")))
    whole = docs.select(F.struct("*").alias("doc"))
    this = F.col("doc")[key].eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.col("doc")[text]) == F.col("text_hash"))
    kept = whole.join(broadcast_if_small(judged.where("NOT stays").select("doc_id", "text_hash")), this, "left_anti")
    twins = judged.where("stays AND count > 1").select("doc_id", "text_hash")
    if not twins.isEmpty():
        twins = broadcast_if_small(twins)
        same = kept.join(twins, this, "left_semi").groupBy(F.col("doc")[key], F.xxhash64(F.col("doc")[text])).agg(F.min("doc").alias("doc"))
        kept = kept.join(twins, this, "left_anti").unionByName(same.select("doc"))
    return kept.select("doc.*")
