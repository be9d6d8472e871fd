"""The prefix trie of conversations, discovered and aggregated bottom-up by truncation peeling.

A conversation is a chain of digests, one for each of its prefixes, next to running word counts. Equal chains are
one class. Peeling starts at the greatest depth: the nodes there are the classes that end there. Each round strips
the last turn of all nodes, merges them with the classes that end at the new depth and groups by the remaining
prefix; counts of members, children and leaves and the saved words of the subtree are sums over what is merged, so
a node is complete when it appears, and nothing below it is read again. Groupings have a map-side part, so a first
turn that a third of all conversations share costs no task more than others.

Where no class ends at the depths in between and no nodes merge there, a round strips several turns at once and
emits the single-child nodes of that stretch: one very long conversation does not cost a round per turn.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from gridtide.functions.sizes import cut_lineage, scratch_path
from gridtide.llm.lookups import looked_up
from gridtide.llm.mixing import word_count

GROUP, MOST_SHARED = 20, 4
#: Conversation ids are joined in runs of so many consecutive numbers (two to this power) before they are hashed.
RUN_BITS = 12
ROOT = b""


def keyed_turns(conversations):
    """(conv_id, turn, key, words): a 128-bit digest of role and text in place of both. Rows without conv_id are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    body = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(F.sha2(body, 256), 1, 32)).alias("key"), word_count(text).alias("words"),
    )


def rebuilt(turns, group=GROUP, most=MOST_SHARED):
    """(conv_id, turns): every conversation with the first turns of the one its group of ids starts with in place of its own.

    How many turns are replaced, under `most`, is a checksum of the id. Turns are ordered by number, null first,
    ties by digest. A conversation is one row of 40 bytes a turn.
    """
    own = cut_lineage(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "words"))).alias("own")))
    heads = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, most - 1).alias("head"))
    named = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "h": (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")})
    joined = named.join(heads, "base", "left")
    tail = F.slice("own", F.col("h") + 1, F.size("own"))
    return joined.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast(own.schema["own"].dataType)), tail).alias("turns"))


_CHAIN = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("key", pa.binary()), ("keys", pa.list_(pa.binary())), ("sums", pa.list_(pa.int64()))])


def _chained(batches):
    for batch in batches:
        columns = [[], [], [], [], []]
        for conv, keys, words in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "keys", "words"))):
            prefixes, sums, last, total = [], [], ROOT, 0
            for key, n in zip(keys, words):
                last, total = hashlib.blake2b(last + key, digest_size=16).digest(), total + n
                prefixes.append(last)
                sums.append(total)
            for column, value in zip(columns, (conv, len(prefixes), last, prefixes, sums)):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CHAIN.types)], schema=_CHAIN)


def chains(conversations):
    """(conv_id, depth, key, keys, sums) of (conv_id, turns): digests of all prefixes, the last again as key, running words."""
    flat = conversations.select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.words").alias("words"))
    return flat.mapInArrow(_chained, "conv_id long, depth int, key binary, keys array<binary>, sums array<long>")


_ENDS = pa.schema([("key", pa.binary()), ("ends", pa.string())])


def _hashed_runs(batches):
    """One digest per key from its runs of ids, which come in order; a key with very many ids is a stream."""
    key, state, done = None, None, []
    for batch in batches:
        for now, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if now == key:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                done.append((key, state.hexdigest()))
            key, state = now, hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), _ENDS.types)], schema=_ENDS)
            done = []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], schema=_ENDS)


def end_digests(chained):
    """(key, ends): SHA-256 of the ids that end at a node, ascending and comma-joined.

    Ids are joined in runs of consecutive numbers in parallel; only the finished strings pass through the one hash
    that the digest of a node is by definition.
    """
    runs = chained.groupBy("key", F.shiftright("conv_id", RUN_BITS).alias("run")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )
    return runs.repartition("key").sortWithinPartitions("key", "run").select("key", "ids").mapInArrow(_hashed_runs, "key binary, ends string")


def _at(depth):
    """The prefix digest at a depth."""
    return F.element_at("keys", depth) if depth else F.lit(ROOT)


def _words_upto(depth):
    return F.element_at("sums", depth) if depth else F.lit(0).cast("long")


_COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def _grouped(rows, depth):
    """Nodes of one depth from the classes that end there and the stripped nodes of the depth below."""
    merged = rows.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(name).alias(name) for name in _COUNTS], F.max("ends").alias("ends"), F.first("keys").alias("keys"), F.first("sums").alias("sums")
    )
    own = (F.col("n_convs") - 1) * (_words_upto(depth) - _words_upto(depth - 1)) if depth else F.lit(0)
    parent = _at(depth - 1) if depth else F.lit(None).cast("binary")
    return merged.select(
        F.lit(depth).cast("long").alias("depth"), "key", parent.alias("parent"), "conv_id", "n_convs", "n_children",
        F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + own).alias("saved_tokens"), "ends", "keys", "sums",
    )


def _stripped(nodes, level, depth):
    """What nodes of `level` bring to their prefixes of `depth`: themselves as one child, with the words saved in between."""
    between = (F.col("n_convs") - 1) * (_words_upto(level - 1) - _words_upto(depth))
    return nodes.select(
        _at(depth).alias("key"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", (F.col("saved_tokens") + between).alias("saved_tokens"),
        F.lit(None).cast("string").alias("ends"), F.slice("keys", 1, depth).alias("keys"), F.slice("sums", 1, depth).alias("sums"),
    )


def _single_children(nodes, level, depth):
    """The nodes between `depth` and `level`, both excluded, where every node has one child."""
    at = F.col("at")
    words = F.element_at("sums", level - 1) - F.when(at > 1, F.element_at("sums", at - 1)).otherwise(0)
    spread = nodes.withColumn("at", F.explode(F.sequence(F.lit(depth + 1), F.lit(level - 1))))
    return spread.select(
        at.cast("long").alias("depth"), F.element_at("keys", at).alias("key"), F.when(at > 1, F.element_at("keys", at - 1)).otherwise(F.lit(ROOT)).alias("parent"),
        "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", (F.col("saved_tokens") + (F.col("n_convs") - 1) * words).alias("saved_tokens"),
        F.lit(None).cast("string").alias("ends"), F.lit(None).cast("array<binary>").alias("keys"), F.lit(None).cast("array<bigint>").alias("sums"),
    )


def _next_depth(nodes, level, ending):
    """The deepest depth under `level` where classes end (`ending` or deeper is none) or nodes merge."""
    if ending == level - 1:
        return ending
    n = nodes.count()
    merges = lambda depth: nodes.select(_at(depth).alias("k")).distinct().count() < n
    if ending == 0 and n == 1 or ending and not merges(ending):
        return ending
    low, high = ending, level  # merging at `low`, unless that is the root, and not at `high`
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if merges(middle) else (low, middle)
    return low


def peeled(chained):
    """All nodes of the trie of stored `chains`: depth, key, parent (a key), conv_id, the counts, and ends (null for none).

    The depths at which conversations end reach the driver; their number is at most the root of twice the number of turns.
    """
    spark, path = chained.sparkSession, scratch_path(chained.sparkSession)
    classes = chained.groupBy("key").agg(
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("keys").alias("keys"), F.first("sums").alias("sums")
    )
    classes = classes.join(end_digests(chained), "key", "left")
    zeros = [F.lit(0).cast("long").alias(name) for name in _COUNTS[1:]]
    classes = classes.select("depth", "key", "conv_id", "n_convs", *zeros, "ends", "keys", "sums")
    classes.hint("rebalance", "depth").write.partitionBy("depth").option("compression", "zstd").parquet(f"{path}/classes")
    stored = spark.read.schema(classes.schema).parquet(f"{path}/classes")
    lengths = sorted(row["depth"] for row in stored.select("depth").distinct().collect())

    def kept(rows, name):
        rows.write.option("compression", "zstd").parquet(f"{path}/nodes/{name}")
        return spark.read.schema(rows.schema).parquet(f"{path}/nodes/{name}")

    if not lengths:
        return _grouped(stored.drop("depth"), 0).drop("keys", "sums")
    level = lengths.pop()
    nodes = kept(_grouped(stored.where(F.col("depth") == level).drop("depth"), level), f"level-{level}")
    while level:
        depth = _next_depth(nodes, level, lengths[-1] if lengths else 0)
        if level - depth > 1:
            kept(_single_children(nodes, level, depth), f"between-{level}")
        rows = _stripped(nodes, level, depth)
        if lengths and lengths[-1] == depth:
            lengths.pop()
            rows = rows.unionByName(stored.where(F.col("depth") == depth).drop("depth"))
        nodes, level = kept(_grouped(rows, depth), f"level-{depth}"), depth
    return spark.read.schema(nodes.schema).parquet(f"{path}/nodes/*").drop("keys", "sums")


def prefix_trie(conversations, group=GROUP, most=MOST_SHARED):
    """Per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns (role and text); its members are the conversations that start with
    it, the smallest of which names it. `ends_sha256` is the SHA-256 of the ids of members without further turns.
    Null role or text counts as empty; rows without conv_id are left out; turns with one number, repeated rows
    too, are turns of their own, ordered by a digest of role and text. Extra columns are ignored. An empty table has no node,
    not even a root. Texts of any length are hashed whole; a conversation is one row of about 40 bytes a turn.
    """
    columns = conversations.select("conv_id", "turn", "role", "text")
    nodes = peeled(cut_lineage(chains(rebuilt(keyed_turns(columns), group, most))))
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    found = looked_up(nodes.where("depth > 0"), parents, "parent", "n").unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    none = F.sha2(F.lit(""), 256)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", none).alias("ends_sha256"))
