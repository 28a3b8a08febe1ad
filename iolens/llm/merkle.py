"""A Merkle manifest of a table, with proofs for all rows by octopus multiproofs.

Leaves are hashes of rows, in order within their tree; a level above joins every two neighbours, a last one
alone too, until one node is left. The tops of all trees are the leaves of one more tree, whose top names the table.

Leaves are kept in partitions of ``2 ** HEIGHT`` neighbours. For all of its leaves together a partition lists the
coordinates of the nodes it cannot derive itself (the multiproof; a few per level above it, however many leaves it
has), fetches those once by a join, derives the nodes its proofs share once, and only then writes out
the proof of every leaf, without another look at the table of nodes. Levels are built ``HEIGHT`` at a time, each from
the tops below, so no task ever sees more than ``2 ** HEIGHT`` nodes and the driver sees only two counts a step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from iolens.llm.common import numbered, stored

HEIGHT = 12

Coordinate = tuple[int, int]  # level, place
Expand = Callable[[dict, list[str], dict], tuple]


def node(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def depth(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    return (leaves - 1).bit_length()


def width(leaves: int, level: int) -> int:
    return -(-leaves >> level)


def missing(places: Iterable[int], leaves: int, level: int = 0) -> list[Coordinate]:
    """The fewest nodes from which, with the given ones of a level, the top can be derived, level by level."""
    known, out = sorted(set(places)), []
    for at in range(level, depth(leaves)):
        held = set(known)
        out += [(at, p ^ 1) for p in known if p ^ 1 not in held and p ^ 1 < width(leaves, at)]
        known = sorted({p >> 1 for p in known})
    return out


def derive(given: dict[int, str], leaves: int, fetched: dict[Coordinate, str]) -> list[dict[int, str]]:
    """All known nodes, a table of place and hash for each level, the top in the last one."""
    levels = [dict(given)]
    for at in range(depth(leaves)):
        below = levels[-1]
        below.update((p, h) for (level, p), h in fetched.items() if level == at)
        lefts = sorted({p & ~1 for p in below})
        # of a pair outside the given leaves one half may be unknown; nothing asks for what is above it
        whole = [p for p in lefts if p in below and (p + 1 in below or p + 1 >= width(leaves, at))]
        levels.append({p >> 1: node(below[p], below.get(p + 1, "")) for p in whole})
    return levels


def siblings(place: int, leaves: int, levels: list[dict[int, str]]) -> list[str]:
    """The other half of each pair from a leaf to the top, empty where a node is alone."""
    return [levels[at].get((place >> at) ^ 1, "") for at in range(depth(leaves))]


def folded(leaf: str, place: int, others: list[str]) -> str:
    """The top that a leaf and its siblings give."""
    for other in others:
        leaf = node(other, leaf) if place & 1 else node(leaf, other)
        place >>= 1
    return leaf


def row_hash(fields: Iterable[Column]) -> Column:
    """Hash of a row: of each value its bytes in UTF-8, a colon and itself; ``-`` for null."""
    parts = []
    for value in fields:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time as Python values: a row can be a whole partition of leaves."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


_NODE = "tree long, leaves long, level int, place long, hash string"


def _tops(batches: Iterator[pa.RecordBatch], level: int, height: int, inner: bool) -> Iterator[pa.RecordBatch]:
    """Fold rows of neighbouring nodes of a level; their top, and with ``inner`` all nodes between, come out."""
    for row in _rows(batches):
        out, tree, leaves = [], row["tree"], row["leaves"]
        below = {n["place"]: n["hash"] for n in row["nodes"]}
        top = min(level + height, depth(leaves))
        if not inner and top == level:
            out += [(tree, leaves, level, p, h) for p, h in below.items()]
        for at in range(level, top):
            lefts = sorted({p & ~1 for p in below})
            below = {p >> 1: node(below[p], below.get(p + 1, "")) for p in lefts}
            if inner or at + 1 == top:
                out += [(tree, leaves, at + 1, p, h) for p, h in below.items()]
        columns = list(zip(*out)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["tree", "leaves", "level", "place", "hash"])


def _gathered(nodes: DataFrame, height: int, *fields: str) -> DataFrame:
    """Rows of at most ``2 ** height`` neighbours in order: ``tree, leaves, part, nodes``."""
    part = F.shiftright("place", height).alias("part")
    return nodes.groupBy("tree", "leaves", part).agg(F.array_sort(F.collect_list(F.struct("place", *fields))).alias("nodes"))


def upper_nodes(parts: DataFrame, height: int = HEIGHT) -> DataFrame:
    """All nodes from the tops of the leaf partitions on: ``tree, leaves, level, place, hash``."""
    level = 0
    tops = stored(parts.select("tree", "leaves", "nodes").mapInArrow(partial(_tops, level=0, height=height, inner=False), _NODE), "tops")
    out = tops
    while True:
        level += height
        # trees with one node left are done
        rest = tops.where((F.col("level") == level) & (F.col("leaves") > (1 << level)))
        if rest.isEmpty():
            return out
        work = partial(_tops, level=level, height=height, inner=True)
        made = stored(_gathered(rest, height, "hash").mapInArrow(work, _NODE), "tops")
        out, tops = out.unionByName(made), made


def expanded(parts: DataFrame, nodes: DataFrame, tops: DataFrame, expand: Expand, schema: str) -> DataFrame:
    """What ``expand`` returns for every leaf of the leaf partitions, given its siblings and its tree's row of ``tops``."""

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tree, n, part, first, last in zip(*(batch.column(c).to_pylist() for c in ("tree", "leaves", "part", "first", "last"))):
                out += [(tree, part, *c) for c in missing(range(first, last + 1), n)]
            columns = list(zip(*out)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["tree", "part", "level", "place"])

    spans = parts.select("tree", "leaves", "part", F.col("nodes")[0]["place"].alias("first"), F.element_at("nodes", -1)["place"].alias("last"))
    wanted = spans.mapInArrow(coordinates, "tree long, part long, level int, place long")
    found = wanted.join(nodes.select("tree", "level", "place", "hash"), ["tree", "level", "place"])
    fetched = found.groupBy("tree", "part").agg(F.collect_list(F.struct("level", "place", "hash")).alias("fetched"))
    arrow = to_arrow_schema(_parse(parts, schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            others = {(o["level"], o["place"]): o["hash"] for o in row["fetched"] or ()}
            levels = derive({x["place"]: x["hash"] for x in row["nodes"]}, row["leaves"], others)
            out = [expand(x, siblings(x["place"], row["leaves"], levels), row["above"]) for x in row["nodes"]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    above = tops.select("tree", F.struct(*[c for c in tops.columns if c != "tree"]).alias("above"))
    rows = parts.join(fetched, ["tree", "part"], "left").join(above, "tree")
    return rows.select("leaves", "nodes", "fetched", "above").mapInArrow(work, schema)


def _parse(df: DataFrame, schema: str) -> StructType:
    return df.sparkSession.createDataFrame([], schema).schema


def whole_proof(leaf: dict, path: list[str], above: dict) -> tuple:
    return leaf["place"], leaf["hash"], path, above["place"], above["subroot"], above["path"], above["root"]


PROOF = "place long, leaf string, path array<string>, top_place long, subroot string, top_path array<string>, root string"


def manifest(
    leaves: DataFrame, tree: str, order: list[str], hash_col: str, fields: tuple[str, ...] = (),
    expand: Expand = whole_proof, schema: str = PROOF, height: int = HEIGHT,
) -> DataFrame:
    """Every leaf with its place and proof, or what ``expand`` makes of them.

    Leaves of equal ``tree`` (null is a tree too and the first one) form a tree in the order of ``order``, nulls
    first, equal rows in any order; trees stand in the order of their names' bytes. ``path`` and ``top_path``
    are the siblings of the leaf and of its subroot, empty strings where a node is alone. Repeated rows are leaves of
    their own. An empty table gives no rows. Columns not named are not read, and names may be any.

    ``expand`` gets a leaf (``place``, ``hash`` and, as ``f0, f1, ...``, the ``fields``), its path, and what is above:
    ``place, subroot, path, root``.
    """
    names = [f"f{i}" for i in range(len(fields))]
    chosen = leaves.select(
        F.col(tree).alias("name"), F.col(hash_col).alias("hash"),
        F.struct(*[F.col(c) for c in order]).alias("ord"), *[F.col(c).alias(n) for c, n in zip(fields, names)],
    )
    # the number written with a row makes the order of equal rows the same wherever it is read again
    fixed = stored(chosen.withColumn("row", F.monotonically_increasing_id()), "leaves")
    everywhere = numbered(fixed, [F.col("name"), F.col("ord"), F.col("hash"), F.col("row")], "at")
    placed = stored(everywhere.drop("ord", "row"), "placed")
    counts = placed.groupBy("name").agg(F.min("at").alias("first"), F.count("*").alias("leaves"))
    trees = stored(numbered(counts, [F.col("name")], "tree"), "trees")
    located = placed.join(trees, placed["name"].eqNullSafe(trees["name"])).withColumn("place", F.col("at") - F.col("first"))
    parts = stored(_gathered(located, height, "hash", *names), "leaf-partitions")
    nodes = stored(upper_nodes(parts, height), "nodes")
    ends = nodes.where("leaves <= shiftleft(1L, level)").select("tree", F.col("hash").alias("subroot"))
    subroots = stored(ends, "subroots")

    one = F.lit(0).cast("long").alias("tree")
    over = subroots.select(one, F.lit(subroots.count()).cast("long").alias("leaves"), F.col("tree").alias("place"), F.col("subroot").alias("hash"))
    over_parts = stored(_gathered(over, height, "hash"), "subroot-partitions")
    over_nodes = stored(upper_nodes(over_parts, height), "nodes")
    root = over_nodes.where("leaves <= shiftleft(1L, level)").select("tree", F.col("hash").alias("root"))
    tops = expanded(over_parts, over_nodes, root, _above, "tree long, place long, subroot string, path array<string>, root string")
    return expanded(parts, nodes, stored(tops, "tops"), expand, schema)


def _above(leaf: dict, path: list[str], above: dict) -> tuple:
    return leaf["place"], leaf["place"], leaf["hash"], path, above["root"]
