"""The prefix trie of conversations by fixed-length block hashing.

The turns of a conversation fall into blocks of BLOCK turns. A block has a digest of its turns, and what lies before it
has a name: the sum, over the blocks before it, of hashes of (number of the block, digest). Sums come page by page, so no
task sees a whole conversation. Conversations with the same name in front and the same block digest are one group: an
ordinary aggregate with a row for each different block, however many conversations share it. Only where different blocks
follow the same name are their turns compared one by one; a block without siblings gives its turns as they stand.

Sums over subtrees need no walk. The smallest member of a node owns it, and with it all that follows on its own path.
So a conversation shares exactly the turns before the first node that it owns, and of a node's members each adds what it
shares from there on; the leaves below a node are its members that own a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlgauge.llm import work
from sqlgauge.operators.running import running_totals
from sqlgauge.session import lookup_join

BLOCK = 4

_SUMS = ["s0", "s1", "s2", "s3"]
_ROOT = "0,0,0,0"
_FIRST_TURN = -(1 << 63)


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), digest and words of each turn, in the order of turn (null first), role and text.

    Null roles and texts count as empty. Rows without conv_id belong to no conversation and are left out; repeated rows are
    turns of their own; other columns are not read. A place is the number of rows with an earlier turn, summed
    page by page, and the rank among rows with the same turn.
    """
    rows = conversations.where(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        F.coalesce(conversations["turn"].cast("long"), F.lit(_FIRST_TURN)).alias("at"),
        conversations["turn"].isNotNull().alias("has_turn"),
        F.coalesce(conversations["role"], F.lit("")).alias("role"),
        F.coalesce(conversations["text"], F.lit("")).alias("text"),
    )
    rank = F.row_number().over(Window.partitionBy("conv_id", "at").orderBy("has_turn", "role", "text"))
    ranked = rows.withColumn("rank", rank).select(
        "conv_id",
        "at",
        "rank",
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    ranked = work.written(ranked, "ranked")
    sizes = ranked.groupBy("conv_id", "at").agg(F.count("*").alias("n"))
    before = running_totals(sizes, ["conv_id"], "at", {"upto": F.col("n")}).select("conv_id", "at", (F.col("upto") - F.col("n")).alias("before"))
    placed = ranked.join(before, ["conv_id", "at"])
    return work.written(placed.select("conv_id", (F.col("before") + F.col("rank") - 1).alias("place"), "digest", "words"), "turns")


def rebuilt(turns: DataFrame, family: int = 20) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of the first of their family: (turns with depth, conversations).

    Of conversation c the first h = crc32(c) % 4 turns are replaced by those of conversation c - c % ``family``, as many as
    that has.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.withColumn("h", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    joined = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = work.written(joined.select("conv_id", "base", "h", "taken"), "convs")
    heads = turns.where((F.col("place") < 3) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "base")
    taken = convs.join(heads, "base").where(F.col("place") < F.col("h"))
    own = lookup_join(turns, convs, "conv_id", F.col("place"), "inner").where(F.col("place") >= F.col("h"))
    depth = F.col("place") + 1
    made = taken.select("conv_id", depth.alias("depth"), "digest", "words").unionByName(
        own.select("conv_id", (depth - F.col("h") + F.col("taken")).alias("depth"), "digest", "words")
    )
    return made, convs.select("conv_id")


def _hash(k: Column, digest: Column) -> Column:
    """Four numbers of 31 bits; sums of them stay exact for 2^32 blocks."""
    a, b = F.xxhash64(k, digest), F.xxhash64(F.lit("second"), k, digest)
    low = F.lit(0x7FFFFFFF).cast("long")
    return F.array(a.bitwiseAND(low), F.shiftrightunsigned(a, 33), b.bitwiseAND(low), F.shiftrightunsigned(b, 33))


def _name(sums: Column) -> Column:
    return F.array_join(F.transform(sums, lambda s: s.cast("string")), ",")


def blocks_of(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each conversation and block, stored.

    Columns: conv_id, block, digest, before (sums), turns (digest of the block up to each turn, words), words_before.
    """
    listed = F.array_sort(F.collect_list(F.struct("depth", "digest", "words")))
    rows = turns.groupBy("conv_id", F.floor((F.col("depth") - 1) / block).cast("long").alias("block")).agg(listed.alias("listed"))
    upto = lambda t, i: F.unhex(F.sha2(F.array_join(F.transform(F.slice("listed", 1, i + 1), lambda x: F.hex(x["digest"])), ""), 256))
    rows = rows.select(
        "conv_id",
        "block",
        F.transform("listed", lambda t, i: F.struct(upto(t, i).alias("digest"), t["words"].alias("words"))).alias("turns"),
    )
    rows = rows.select("*", F.element_at("turns", -1)["digest"].alias("digest"))
    rows = rows.select("*", _hash(F.col("block"), F.col("digest")).alias("own"), F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["words"]).alias("own_words"))
    rows = work.written(rows, "hashed")
    amounts = {s: F.get("own", F.lit(i)) for i, s in enumerate(_SUMS)} | {"words": F.col("own_words")}
    summed = running_totals(rows, ["conv_id"], "block", amounts)
    before = F.transform(F.array(*_SUMS), lambda s, i: s - F.get("own", i))
    made = summed.select("conv_id", "block", "digest", before.alias("before"), "turns", (F.col("words") - F.col("own_words")).alias("words_before"))
    return work.written(made, "blocks")


def _nodes(blocks: DataFrame, block: int, first: str, sums: list[str]) -> DataFrame:
    """The nodes below the root, from the blocks of conversations: name, parent, depth, n, ``first`` (least) and ``sums``.

    Members are added up for each different block first. Turns are compared only under names that several blocks follow.
    """
    key = ["block", "before", "digest"]
    totals = [F.sum(s).alias(s) for s in sums]
    distinct = blocks.groupBy(*key).agg(
        F.count("*").alias("n"), F.min(first).alias(first), *totals, F.any_value("turns").alias("turns"), F.any_value("words_before").alias("words_before")
    )
    distinct = work.written(distinct, "distinct")
    followed = distinct.groupBy("block", "before").agg((F.count("*") > 1).alias("diverges"))
    marked = lookup_join(distinct, followed, ["block", "before"], F.col("digest"), "inner")
    name_of = lambda t: _name(F.zip_with("before", _hash(F.col("block"), t["digest"]), lambda x, y: x + y))
    names = F.transform("turns", name_of)
    sums_of = F.transform(
        "turns", lambda t, i: F.aggregate(F.slice("turns", 1, i), F.col("words_before"), lambda s, x: s + x["words"])
    )
    marked = marked.select("*", names.alias("names"), sums_of.alias("passed"))
    rows = marked.select("diverges", "block", "before", "names", "passed", "turns", "n", first, *sums, F.posexplode("names").alias("i", "name"))
    rows = rows.select(
        "diverges",
        "name",
        F.when(F.col("i") == 0, _name(F.col("before"))).otherwise(F.get("names", F.col("i") - 1)).alias("parent"),
        (F.col("block") * block + F.col("i") + 1).alias("depth"),
        F.get("turns", F.col("i"))["words"].alias("words"),
        F.get("passed", F.col("i")).alias("passed"),
        "n",
        first,
        *sums,
    )
    fixed = ["name", "parent", "depth", "words", "passed"]
    alone = rows.where(~F.col("diverges")).drop("diverges")
    refined = rows.where("diverges").groupBy(*fixed).agg(F.sum("n").alias("n"), F.min(first).alias(first), *totals)
    return alone.unionByName(refined)


def _ends(ends: DataFrame) -> DataFrame:
    """name, n_ends and the digest of the ascending ids that end at it, read one by one in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n, state = None, 0, None
        for batch in batches:
            out = []
            for other, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if other != name:
                    if n:
                        out.append((name, n, state.hexdigest()))
                    name, n, state = other, 0, hashlib.sha256()
                state.update(f",{conv_id}".encode() if n else str(conv_id).encode())
                n += 1
            if out:
                yield _rows(out)
        if n:
            yield _rows([(name, n, state.hexdigest())])

    return ends.repartition("name").sortWithinPartitions("name", "conv_id").mapInArrow(run, "name string, n_ends long, ends_sha256 string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["name", "n_ends", "ends_sha256"])


def trie(turns: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """All nodes of the prefix trie. ``turns`` has conv_id, depth (from 1, without gaps), digest and words; ``conversations``
    the distinct ids of all conversations, also of those without turns.

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens
    (what members of the subtree share: of each node its words times the members but one), ends_sha256 (of the
    ids that end there, ascending, comma-joined). Without conversations there are no nodes. Ids that end at one
    node are hashed in order by one task, which holds no more than a batch of them.
    """
    blocks = blocks_of(turns, block)
    nodes = work.written(_nodes(blocks, block, "conv_id", []), "owned")
    # What a conversation shares: the words before the first node that it owns, or all.
    owned = nodes.groupBy("conv_id").agg(F.min_by("passed", "depth").alias("shared"))
    last = F.max(F.struct("block", "before", "digest", "words_before", "turns")).alias("last")
    totals = blocks.groupBy("conv_id").agg(last).select(
        "conv_id",
        _name(F.zip_with("last.before", _hash(F.col("last.block"), F.col("last.digest")), lambda x, y: x + y)).alias("name"),
        F.aggregate("last.turns", F.col("last.words_before"), lambda s, t: s + t["words"]).alias("words"),
    )
    convs = conversations.join(totals, "conv_id", "left").join(owned, "conv_id", "left").select(
        "conv_id", F.coalesce("name", F.lit(_ROOT)).alias("name"), F.coalesce("shared", "words", F.lit(0)).alias("shared")
    )
    convs = work.written(convs, "shares")
    ends = work.written(_ends(convs.select("name", "conv_id")), "ends")
    leaves = nodes.join(ends, "name").where("n = n_ends").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    attributes = convs.join(leaves, "conv_id", "left").select("conv_id", "shared", F.coalesce("leaf", F.lit(0)).alias("leaf"))
    attributes = work.written(attributes, "attributes")
    first = F.struct("conv_id", "shared").alias("owner")
    members = lookup_join(blocks, attributes, "conv_id", F.col("block"), "inner").select("*", first)
    below = _nodes(members, block, "owner", ["shared", "leaf"])
    root = attributes.groupBy().agg(
        F.count("*").alias("n"), F.min(F.struct("conv_id", "shared")).alias("owner"), F.sum("shared").alias("shared"), F.sum("leaf").alias("leaf")
    )
    none = lambda t: F.lit(None).cast(t)
    root = root.where("n > 0").select(
        F.lit(_ROOT).alias("name"), none("string").alias("parent"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("passed"), "n", "owner", "shared",
        F.greatest("leaf", F.lit(1)).alias("leaf"),
    )
    every = work.written(below.unionByName(root), "nodes")
    children = every.where("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    joined = every.join(children, "name", "left").join(ends, "name", "left")
    parents = every.select(F.col("name").alias("parent"), F.col("owner.conv_id").alias("parent_conv_id"))
    found = lookup_join(joined, parents, "parent", F.col("name"), "left")
    return found.select(
        F.col("owner.conv_id").alias("conv_id"),
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        F.col("leaf").alias("n_leaves"),
        (F.col("shared") - F.col("owner.shared") - (F.col("n") - 1) * F.col("passed")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
