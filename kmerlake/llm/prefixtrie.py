"""The prefix trie of conversations, totalled by peeling leaves.

Every sequence of first turns that some conversation begins with is a node.  A
node is known by its depth and the smallest conversation that begins with it, so
the nodes with the same smallest conversation lie on one unbranched stretch of
that conversation, a *path*.

How the work is spread
  1. Turns are hashed where they are read; only hashes and lengths move on.  A
     turn's number and the hash of what a conversation has said up to it are
     running values over conversations (``operators.prefix``), which spread a
     single conversation over many tasks.
  2. Grouping by that hash gives the nodes, partly counted before the shuffle, so
     a first turn that very many conversations share is no hot key.
  3. Leaf peeling: a path holds a counter of the paths that still hang on it.
     Those with none left are complete and send their totals (leaves, saved
     tokens) to the path they hang on, which adds them up and counts down, until
     only the root's path finishes.  A round rewrites the paths still waiting and
     nothing else.  There are as many rounds as paths hang on paths, never more
     than the longest conversation has turns: a chat of 400 turns that nobody
     shares is one path and one round.
  4. A last running sum from the deep end of each path gives every node its own
     totals.
  5. The ids of the conversations that end at a node are joined by ranges in many
     tasks; the digest, which cannot be split, then reads a few long pieces.

Edge cases: null role and text count as empty; a null ``turn`` comes first; equal
turns go by the hash of role and text; rows without a conversation id belong to
none.  Repeated rows are turns of their own.  Without conversations there is no
node, not even the root.  Texts may be of any length: they are hashed whole.  The
hash of a beginning has 128 bits.  Columns other than conv_id, turn, role and
text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kmerlake.llm.tables import cut, runs
from kmerlake.operators.prefix import running

_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, key, bytes): turns by number from 0, with the hash of role and text and the text's UTF-8 bytes."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"))
    placed = running(cut(turns), ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("key")], {"number": ("sum", "one")})
    return placed.select("conv_id", (F.col("number") - 1).alias("at"), "key", "bytes")


def with_shared_openings(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the opening of a common one.

    The first ``h`` turns of conversation c come from conversation ``c - c % every``
    (fewer if it has fewer, none if it is absent), h being the unsigned crc32 of c's
    decimal digits modulo ``most``.  Gives the turns (conv_id, depth from 1, key,
    bytes, last) and the conversations (conv_id, n_turns), turnless ones too.
    """
    sizes = cut(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    told = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    lead = F.least(F.col("h"), F.coalesce("base_n", F.lit(0)))
    convs = cut(told.join(bases, "base", "left").select("conv_id", "base", "h", lead.alias("lead"), (lead + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")))
    own = turns.join(convs, "conv_id").where("at >= h").select("conv_id", (F.col("lead") + F.col("at") - F.col("h") + 1).alias("depth"), "key", "bytes", "n_turns")
    openings = turns.where(F.col("at") < most - 1).withColumnRenamed("conv_id", "base").join(convs, "base").where("at < h").select("conv_id", (F.col("at") + 1).alias("depth"), "key", "bytes", "n_turns")
    both = own.union(openings).select("conv_id", "depth", "key", "bytes", (F.col("depth") == F.col("n_turns")).alias("last"))
    return both, convs.select("conv_id", "n_turns")


def joined_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of the nodes in ``ends`` (conv_id, depth, member): the hash of their members, ascending, comma-joined.

    Members are joined to pieces of text by range, so that the node of a very
    common conversation is spread too; its hash then reads these pieces in turn.
    """

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, rows, _ in runs([batch], ["conv_id", "depth"]):
                members = rows.column("member").to_pylist()
                out.append((*key, members[0], ",".join(map(str, members))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["conv_id", "depth", "head", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begun = hashlib.sha256(), False
        out: list[tuple] = []
        for key, rows, last in runs(batches, ["conv_id", "depth"]):
            for text in rows.column("piece").to_pylist():
                held.update((("," if begun else "") + text).encode())
                begun = True
            if last:
                out.append((*key, held.hexdigest()))
                held, begun = hashlib.sha256(), False
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["conv_id", "depth", "ends_sha256"])
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["conv_id", "depth", "ends_sha256"])

    by = ["conv_id", "depth", "member"]
    pieces = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(piece, "conv_id long, depth long, head long, piece string")
    return pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "head").mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def peel(paths: DataFrame, values: list[str]) -> DataFrame:
    """``paths`` (path, up, values) with the values of everything below added to each.

    ``up`` is the path that a path hangs on, null for the root's.  ``remaining``
    counts the paths that have not yet sent their totals up.
    """
    below = paths.where("up is not null").groupBy(F.col("up").alias("path")).agg(F.count("*").alias("remaining"))
    waiting = cut(paths.join(below, "path", "left").withColumn("remaining", F.coalesce("remaining", F.lit(0))))
    finished: DataFrame | None = None
    while True:
        complete = waiting.where("remaining = 0")
        finished = complete if finished is None else finished.union(complete)
        rest = waiting.where("remaining > 0")
        if rest.isEmpty():
            return finished.drop("remaining")
        sent = complete.groupBy(F.col("up").alias("path")).agg(F.count("*").alias("_n"), *[F.sum(v).alias(f"_{v}") for v in values])
        got = rest.join(sent, "path", "left")
        waiting = cut(got.select("path", *[c for c in paths.columns if c not in ("path", *values)], *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values], (F.col("remaining") - F.coalesce("_n", F.lit(0))).alias("remaining")).select(*waiting.columns))


def trie_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, depth, key, bytes, last) and ``convs`` (conv_id, n_turns).

    Per node: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256; the root has depth 0.
    """
    half = lambda at: F.xxhash64("depth", F.substring("key", at, 16))  # noqa: E731  the key has 32 bytes
    hashed = cut(turns.select("conv_id", "depth", "bytes", "last", half(1).alias("own_a"), half(17).alias("own_b")))
    begun = cut(running(hashed, ["conv_id"], ["depth"], {"a": ("xor", "own_a"), "b": ("xor", "own_b")}))
    upper = lambda x: F.col(x).bitwiseXOR(F.col(f"own_{x}"))
    found = begun.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes"), F.first(upper("a")).alias("up_a"), F.first(upper("b")).alias("up_b"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id", "n_convs", zero.alias("bytes"), F.lit(None).cast("long").alias("up_a"), F.lit(None).cast("long").alias("up_b"))
    named = cut(found.union(root))

    parents = named.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    nodes = cut(named.join(parents, ["depth", "up_a", "up_b"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "a", "b", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")))
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    counted = cut(nodes.join(children, ["conv_id", "depth"], "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "leaf": F.col("n_children").isNull().cast("long")}))

    tops = counted.groupBy(F.col("conv_id").alias("path")).agg(F.min_by("parent_conv_id", "depth").alias("up"), (F.min("depth") - 1).alias("hangs_at"), F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    totals = peel(tops, ["saved", "leaf"])
    hung = totals.where("up is not null").groupBy(F.col("up").alias("conv_id"), F.col("hangs_at").alias("depth")).agg(F.sum("saved").alias("hung_saved"), F.sum("leaf").alias("hung_leaf"))
    weighed = counted.join(hung, ["conv_id", "depth"], "left").withColumns({"saved": F.col("saved") + F.coalesce("hung_saved", F.lit(0)), "leaf": F.col("leaf") + F.coalesce("hung_leaf", F.lit(0))})
    summed = running(cut(weighed.drop("hung_saved", "hung_leaf")), ["conv_id"], [F.col("depth").desc()], {"saved_tokens": ("sum", "saved"), "n_leaves": ("sum", "leaf")})

    places = nodes.select("depth", "a", "b", F.col("conv_id").alias("node"))
    turnless = convs.where("n_turns = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id")
    ending = begun.where("last").select("depth", "a", "b", "conv_id").union(turnless)
    ends = ending.withColumnRenamed("conv_id", "member").join(places, ["depth", "a", "b"]).select(F.col("node").alias("conv_id"), "depth", "member")
    digests = joined_digests(cut(ends))
    told = summed.join(digests, ["conv_id", "depth"], "left")
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    turns = cut(numbered_turns(conversations))
    convs = cut(turns.groupBy("conv_id").agg(F.count("*").alias("n_turns")))
    sized = turns.join(convs, "conv_id")
    return trie_nodes(sized.select("conv_id", (F.col("at") + 1).alias("depth"), "key", "bytes", (F.col("at") + 1 == F.col("n_turns")).alias("last")), convs)


def rebuilt_trie(conversations: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """The trie of conversations rebuilt on shared openings (``with_shared_openings``)."""
    turns, convs = with_shared_openings(cut(numbered_turns(conversations)), every, most)
    return trie_nodes(turns, convs)
