"""The trie of conversations that begin alike, built from ternary search trees over range shards.

Turns (role and text) are numbered by a dictionary in the order of role and text. Conversations, as sequences of turn numbers,
are sorted and dealt out by range, so that a shard holds neighbours. A task builds one ternary search
tree of its shard: at each place of a sequence a binary search tree of turn numbers, balanced as the sorted sequences go in by
their medians. One traversal without recursion gives members, leaves and savings of every node.

Only nodes on the first or the last sequence of a shard may exist in another shard, too. These boundary nodes
are merged by a digest of their sequence: sums over shards of what lies strictly inside one of them, and the boundary nodes
themselves counted once. They are at most two paths a shard.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.skew import even_join, hot_keys
from llm.store import drop, partitions, sized_join, written

#: Shards are of about so many turns.
SHARD_TURNS = 200_000
#: The ids of conversations that end at a boundary node travel in pieces of so many.
PIECE = 50_000


class TernaryTree:
    """Sequences of numbers; node i holds one number, and ``equal[i]`` leads to the numbers that may follow it."""

    def __init__(self):
        self.turn, self.low, self.high, self.equal = array("q"), array("q"), array("q"), array("q")
        self.root = -1

    def _node(self, turn: int) -> int:
        self.turn.append(turn)
        for links in (self.low, self.high, self.equal):
            links.append(-1)
        return len(self.turn) - 1

    def insert(self, sequence) -> int:
        """The node of the last number (-1 for the empty sequence); missing nodes are made."""
        turn, low, high, equal = self.turn, self.low, self.high, self.equal
        up = -1
        for x in sequence:
            node = self.root if up < 0 else equal[up]
            if node < 0:
                node = self._node(x)
                if up < 0:
                    self.root = node
                else:
                    equal[up] = node
            while turn[node] != x:
                links = low if x < turn[node] else high
                if links[node] < 0:
                    links[node] = self._node(x)
                node = links[node]
            up = node
        return up

    def walk(self) -> tuple[list[int], dict[int, int]]:
        """All nodes, each after its parent, and their parents."""
        order, parent = [], {}
        stack = [(self.root, -1)] if self.root >= 0 else []
        while stack:
            node, up = stack.pop()
            order.append(node)
            parent[node] = up
            for other, above in ((self.low[node], up), (self.high[node], up), (self.equal[node], node)):
                if other >= 0:
                    stack.append((other, above))
        return order, parent


def median_order(n: int) -> Iterator[int]:
    """0..n-1, the middle of every range before its halves."""
    stack = [(0, n)]
    while stack:
        low, high = stack.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            stack.append((middle + 1, high))
            stack.append((low, middle))


def _digest(above: bytes, turn: int) -> bytes:
    return hashlib.blake2b(above + struct.pack("<q", turn), digest_size=16).digest()


def _hashed(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


_NOTHING = hashlib.sha256(b"").hexdigest()
NODE = (
    "shard long, side int, name binary, parent_name binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved decimal(38,0), size long, ends_sha256 string, ends array<long>"
)


def shard_nodes(shard: int, paths: list[tuple], sizes: list[tuple], ids: list[int]) -> Iterator[dict]:
    """The nodes of sorted sequences ``paths`` with the bytes of their turns and their conversation ids (ascending for equal ones).

    A node off the boundary is as it is in the whole trie. One on the boundary has ``side`` 0 (on the first
    sequence) or 1 (on the last one only), its name, and what this shard adds to it: members, children and leaves inside the shard's
    interior, and in ``saved`` the members times bytes of all nodes below (its own included) less the bytes of the interior ones.
    """
    starts = [i for i in range(len(paths)) if i == 0 or paths[i] != paths[i - 1]]
    ends = [*starts[1:], len(paths)]
    tree = TernaryTree()
    last_of, run_of = [-1] * len(starts), {}
    for k in median_order(len(starts)):
        last_of[k] = tree.insert(paths[starts[k]])
        run_of[last_of[k]] = k
    order, parent = tree.walk()
    n = len(tree.turn)
    # The root is node n.
    members, least, children = [0] * (n + 1), [None] * (n + 1), [0] * (n + 1)
    depth, size = [0] * (n + 1), [0] * (n + 1)
    for node, k in run_of.items():
        at = node if node >= 0 else n
        members[at], least[at] = ends[k] - starts[k], ids[starts[k]]
    for node in order:
        depth[node] = depth[parent[node]] + 1 if parent[node] >= 0 else 1
    for k, node in enumerate(last_of):  # the bytes of a turn, from any sequence that goes through its node
        at = depth[node] if node >= 0 else 0
        while node >= 0 and size[node] == 0:
            at -= 1
            size[node] = sizes[starts[k]][at] + 1
            node = parent[node]
    name = {n: b""}
    for side, path in enumerate((paths[0], paths[-1])):
        node, above = -1, b""
        for x in path:
            node = tree.root if node < 0 else tree.equal[node]
            while tree.turn[node] != x:
                node = tree.low[node] if x < tree.turn[node] else tree.high[node]
            above = _digest(above, x)
            name.setdefault(node, above)
    first = {n}
    node = last_of[0]
    while node >= 0:
        first.add(node)
        node = parent[node]
    leaves, saved = [0] * (n + 1), [0] * (n + 1)
    inside = [0] * (n + 1)
    for node in [*reversed(order), n]:
        bytes_ = size[node] - 1 if node < n else 0
        edge = node in name
        if not edge and children[node] == 0:
            leaves[node] = 1
        saved[node] += (members[node] - (not edge)) * bytes_
        if node == n:
            break
        up = parent[node] if parent[node] >= 0 else n
        members[up] += members[node]
        if least[up] is None or (least[node] is not None and least[node] < least[up]):
            least[up] = least[node]
        children[up] += 1
        inside[up] += not edge
        leaves[up] += leaves[node]
        saved[up] += saved[node]
    for node in [n, *order]:
        up = parent.get(node, -1)
        up = up if up >= 0 else n
        edge = node in name
        k = run_of.get(node if node < n else -1)
        end_ids = ids[starts[k] : ends[k]] if k is not None else []
        row = {
            "shard": shard, "side": (0 if node in first else 1) if edge else None, "name": name.get(node),
            "parent_name": name.get(up) if node < n else None, "conv_id": least[node], "depth": depth[node],
            "parent_conv_id": least[up] if node < n and up not in name else None, "n_convs": members[node],
            "n_children": inside[node] if edge else children[node], "n_leaves": leaves[node], "saved": saved[node],
            "size": size[node] - 1 if node < n else 0, "ends_sha256": None if edge else _hashed(end_ids), "ends": None,
        }
        if not edge:
            yield row
            continue
        yield row | {"ends": end_ids[:PIECE] or None}
        for low in range(PIECE, len(end_ids), PIECE):
            yield {**dict.fromkeys(row), "shard": shard, "name": name[node], "ends": end_ids[low : low + PIECE]}


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    kinds |= {"decimal(38,0)": pa.decimal128(38, 0), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in NODE.split(", ")])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard, sorted by path and conversation, to its nodes."""
    from decimal import Decimal

    paths, sizes, ids, shard = [], [], [], 0
    for batch in batches:
        paths += map(tuple, batch.column("path").to_pylist())
        sizes += map(tuple, batch.column("sizes").to_pylist())
        ids += batch.column("conv_id").to_pylist()
        shard = batch.column("shard")[0].as_py() if batch.num_rows else shard
    if not ids:
        return
    schema, held = _arrow_schema(), []
    for row in shard_nodes(shard, paths, sizes, ids):
        row["saved"] = None if row["saved"] is None else Decimal(row["saved"])
        held.append(row)
        if len(held) == 5000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of ids, sorted by name and first id -> the hash of each name's ids, one piece in memory at a time."""
    name, state, started = None, None, False
    names, digests = [], []
    for batch in batches:
        for this, ids in zip(batch.column("name").to_pylist(), batch.column("ends").to_pylist()):
            if not started or this != name:
                if started:
                    names.append(name)
                    digests.append(state.hexdigest())
                name, state, started = this, hashlib.sha256(), True
            else:
                state.update(b",")
            state.update(",".join(map(str, ids)).encode())
    if started:
        names.append(name)
        digests.append(state.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(digests, pa.string())], names=["name", "sha"])


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, number, size): every turn by its number in the dictionary, and the UTF-8 bytes of its text.

    The dictionary's numbers follow the order of (role, text); null counts as empty. Rows without conv_id are left out.
    """
    clean = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    mark = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    marked = clean.withColumn("mark", F.unhex(mark))
    same = marked.groupBy("mark").agg(F.count("*").alias("times"), F.first("role").alias("role"), F.first("text").alias("text"))
    order = same.repartitionByRange("role", "text").sortWithinPartitions("role", "text")
    dictionary = written(
        order.select("mark", "times", F.monotonically_increasing_id().alias("number"), F.octet_length("text").alias("size")),
        "dictionary",
    )
    hot = hot_keys(dictionary, ["mark"], "times")
    narrow = marked.select("conv_id", "turn", "mark")
    return even_join(narrow, dictionary.select("mark", "number", "size"), ["mark"], hot, ["conv_id", "turn"]).drop("mark")


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): the turn numbers of each conversation in order of turn (null first), role and text.

    A conversation is one record here, of twelve bytes a turn.
    """
    one = F.struct(F.col("turn").isNotNull().alias("t"), F.coalesce("turn", F.lit(0)).alias("turn"), "number", "size")
    return (
        numbered_turns(turns)
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(one)).alias("turns"))
        .select("conv_id", F.col("turns.number").alias("path"), F.col("turns.size").alias("sizes"))
    )


def prefix_trie(paths: DataFrame) -> DataFrame:
    """The nodes of the trie of ``paths`` (conv_id, path, sizes), one row each; the root is the empty prefix.

    conv_id is the smallest member (conversation that begins with the prefix), parent_conv_id that of the parent (null for the root);
    n_leaves counts the childless nodes of the subtree, itself included; saved_tokens adds up over the
    subtree (members - 1) times the bytes of the node's last turn; ends_sha256 is the hash of the ids of the conversations that
    are the prefix, ascending and joined by commas. Conversations without turns are members of the root. ``conv_id``
    must be unique and not null; no conversations give no rows.
    """
    spark = paths.sparkSession
    paths = written(paths.select("conv_id", "path", "sizes"), "paths")
    turns = paths.agg(F.coalesce(F.sum(F.size("path") + 1), F.lit(0))).first()[0]
    shards = max(partitions(spark), -(-turns // SHARD_TURNS))
    sharded = paths.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    built = sharded.withColumn("shard", F.spark_partition_id().cast("long")).mapInArrow(_build, NODE)
    nodes = written(built, "nodes")

    edges = nodes.where("name IS NOT NULL")
    pieces = edges.where("ends IS NOT NULL").select("name", "ends")
    ended = (
        pieces.repartition("name").sortWithinPartitions("name", F.col("ends")[0]).mapInArrow(_hash_pieces, "name binary, sha string")
    )
    own = edges.where("depth IS NOT NULL")
    merged = own.groupBy("name").agg(
        F.first("parent_name").alias("parent_name"),
        F.first("depth").alias("depth"),
        F.first("size").alias("size"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("inner_children"),
        F.sum("n_leaves").alias("inner_leaves"),
        F.sum("saved").alias("inner_saved"),
        F.min("shard").alias("owner"),
    )
    merged = written(merged, "merged")
    below = merged.where("parent_name IS NOT NULL").groupBy(F.col("parent_name").alias("name")).agg(F.count("*").alias("edge_children"))
    merged_with = merged.join(below, "name", "left").withColumn(
        "n_children", F.col("inner_children") + F.coalesce("edge_children", F.lit(0))
    )
    facts = written(merged_with, "facts")

    # Boundary nodes below a boundary node, each counted in the first shard that has it: along the shard's two paths.
    owned = own.select("name", "shard", "side", "depth").join(
        facts.select("name", "owner", "n_children", F.col("size").alias("bytes")), "name"
    )
    mine = F.col("owner") == F.col("shard")
    owned = owned.select(
        "name", "shard", "side", "depth",
        F.when(mine & (F.col("n_children") == 0), 1).otherwise(0).alias("leaf"),
        F.when(mine, F.col("bytes")).otherwise(0).alias("bytes"),
    )
    down = Window.partitionBy("shard", "side").orderBy(F.col("depth").desc())
    fork = owned.where("side = 1").groupBy("shard").agg(
        F.min("depth").alias("fork"), F.sum("leaf").alias("fork_leaves"), F.sum("bytes").alias("fork_bytes")
    )
    sums = owned.withColumns({"leaves": F.sum("leaf").over(down), "total": F.sum("bytes").over(down)}).join(fork, "shard", "left")
    above = (F.col("side") == 0) & (F.col("depth") < F.col("fork"))
    sums = sums.groupBy("name").agg(
        F.sum(F.col("leaves") + F.when(above, F.col("fork_leaves")).otherwise(0)).alias("edge_leaves"),
        F.sum(F.col("total") + F.when(above, F.col("fork_bytes")).otherwise(0)).alias("edge_bytes"),
    )
    boundary = (
        facts.join(sums, "name")
        .join(ended, "name", "left")
        .select(
            "name", "parent_name", "conv_id", "depth", "n_convs", "n_children",
            (F.col("inner_leaves") + F.col("edge_leaves")).alias("n_leaves"),
            (F.col("inner_saved") - F.col("edge_bytes")).cast("long").alias("saved_tokens"),
            F.coalesce("sha", F.lit(_NOTHING)).alias("ends_sha256"),
        )
    )
    boundary = written(boundary, "boundary")
    parents = written(boundary.select(F.col("name").alias("parent_name"), F.col("conv_id").alias("edge_parent")), "parents")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    interior = nodes.where("name IS NULL").withColumn("saved_tokens", F.col("saved").cast("long"))
    inside = interior.where("parent_name IS NULL").select(*columns)
    under = sized_join(interior.where("parent_name IS NOT NULL").drop("parent_conv_id"), parents, ["parent_name"], "left")
    tops = sized_join(boundary, parents, ["parent_name"], "left")
    named = [x.withColumnRenamed("edge_parent", "parent_conv_id").select(*columns) for x in (under, tops)]
    result = written(inside.unionAll(named[0]).unionAll(named[1]), "trie")
    drop(spark, paths, nodes, merged, facts, boundary, parents)
    return result


def branched(paths: DataFrame) -> DataFrame:
    """Conversations rebuilt so that they begin like others: c takes the first h turns of conversation c - c % 5.

    h is the unsigned CRC-32 of the decimal id modulo 9; all turns if there are fewer, none if that conversation is absent; then follow c's own turns
    after its first h. The remainder has the sign of c.
    """
    taken = paths.withColumn("h", F.expr("CAST(crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % 9 AS INT)"))
    heads = paths.where("conv_id % 5 = 0").select(
        F.col("conv_id").alias("base"),
        F.slice("path", 1, 8).alias("head_path"),
        F.slice("sizes", 1, 8).alias("head_sizes"),
    )
    rest = lambda c: F.expr(f"slice({c}, h + 1, greatest(size({c}) - h, 0))")
    head = lambda c: F.expr(f"slice(coalesce(head_{c}, slice({c}, 1, 0)), 1, h)")
    return (
        taken.withColumn("base", F.expr("conv_id - conv_id % 5"))
        .join(heads, "base", "left")
        .select("conv_id", F.concat(head("path"), rest("path")).alias("path"), F.concat(head("sizes"), rest("sizes")).alias("sizes"))
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    whole = written(sequences(turns), "sequences")
    out = prefix_trie(branched(whole))
    drop(spark, whole)
    return out


OP11_SQL = """
WITH src AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
         {'r': role, 't': text} AS x FROM src
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]),
             lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM src)
), raw AS (
  SELECT c.conv_id, 0 AS part, o.pos, o.x FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos < c.h
  UNION ALL
  SELECT c.conv_id, 1, o.pos, o.x FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos >= c.h
), rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, x FROM raw
), chain AS (
  SELECT conv_id, 0 AS depth, CAST([] AS STRUCT(r VARCHAR, t VARCHAR)[]) AS prefix, 0 AS bytes FROM convs
  UNION ALL
  SELECT conv_id, depth, list(x) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING), strlen(x.t) FROM rebuilt
), marked AS (
  SELECT conv_id, depth, sha256(CAST(to_json(prefix) AS VARCHAR)) AS name, bytes, depth = max(depth) OVER (PARTITION BY conv_id) AS is_end FROM chain
), nodes AS (
  SELECT depth, name, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
  FROM marked GROUP BY depth, name
), named AS (
  SELECT n.*, p.name AS parent, q.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN marked p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
  LEFT JOIN nodes q ON q.name = p.name AND q.depth = p.depth
), kids AS (
  SELECT parent AS name, depth - 1 AS depth, count(*) AS n_children FROM named WHERE parent IS NOT NULL GROUP BY ALL
), full_nodes AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM named n LEFT JOIN kids k USING (name, depth)
), sums AS (
  SELECT a.name, a.depth, sum(CAST(d.n_children = 0 AS BIGINT)) AS n_leaves, sum((d.n_convs - 1) * d.bytes) AS saved_tokens
  FROM full_nodes d JOIN marked a ON a.conv_id = d.conv_id AND a.depth <= d.depth GROUP BY a.name, a.depth
)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, f.parent_conv_id, f.n_convs, f.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums s USING (name, depth)
"""

QUERIES = {"op11_prefix_trie": (op11_prefix_trie, OP11_SQL)}
