"""Hierarchical weighted hash tree: rows descend region, rack and shard by weighted hash draws.

At every node each child draws -ln(u)/weight, u a hash of (key, child), and the smallest draw wins.
A draw depends on nothing but the key, the child and its weight, so between two trees a row can
move only into a child whose weight grew or out of one whose weight shrank: movement stays in
subtrees whose weights change. A shard that joins as a region of its own therefore takes rows only
into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, texts, utf8_size


def _draw(key: Column, level: int):
    """A child's weighted draw for a key: exponential with the child's weight as its rate."""
    def draw(child: Column) -> Column:
        share = (F.shiftrightunsigned(F.xxhash64(key, child["id"], F.lit(level)), 11) + 0.5) / float(2**53)
        return F.struct((-F.ln(share) / child["weight"]).alias("draw"), child["id"].alias("id"))

    return draw


@dataclass(frozen=True)
class HashTree:
    """Leaves (shard, region, rack, weight); racks are numbered across the whole tree."""

    leaves: tuple[tuple[int, int, int, float], ...]

    def __post_init__(self):
        shards = [s for s, *_ in self.leaves]
        homes = {}
        if len(set(shards)) != len(shards) or not shards:
            raise ValueError("shard numbers must be given once each")
        for _, region, rack, weight in self.leaves:
            if weight < 0 or homes.setdefault(rack, region) != region:
                raise ValueError("weights are at least 0 and a rack lies in one region")
        if not any(w > 0 for *_, w in self.leaves):
            raise ValueError("some shard needs a weight over 0")

    @classmethod
    def even(cls, shards: int, racks_per_region: int = 2, shards_per_rack: int = 5) -> HashTree:
        """Shards of weight 1, in number order; whatever doesn't fill a whole region joins as regions of one."""
        each = racks_per_region * shards_per_rack
        whole = shards // each * each
        tree = [(s, s // each, s // shards_per_rack, 1.0) for s in range(whole)]
        regions, racks = whole // each, whole // shards_per_rack
        return cls(tuple(tree + [(s, regions + s - whole, racks + s - whole, 1.0) for s in range(whole, shards)]))

    def with_shard(self, weight: float = 1.0) -> HashTree:
        """One more shard, in a region and rack of its own: rows move only into it."""
        shard, region, rack = (max(x[i] for x in self.leaves) + 1 for i in range(3))
        return HashTree((*self.leaves, (shard, region, rack, weight)))

    def with_weight(self, shard: int, weight: float) -> HashTree:
        return HashTree(tuple((s, g, r, weight if s == shard else w) for s, g, r, w in self.leaves))

    def children(self, level: int) -> dict[int, list[tuple[int, float]]]:
        """For level 0, 1, 2: the regions under 0, the racks under each region, the shards under each rack."""
        out: dict[int, dict[int, float]] = {}
        for shard, region, rack, weight in self.leaves:
            node, child = ((0, region), (region, rack), (rack, shard))[level]
            row = out.setdefault(node, {})
            row[child] = row.get(child, 0.0) + weight
        return {node: [(c, w) for c, w in sorted(row.items()) if w > 0] for node, row in sorted(out.items())}

    def place(self, key: Column) -> Column:
        """The shard of a key."""
        node = F.lit(0)
        for level in range(3):
            under = self.children(level)
            kids = [F.array(*(F.struct(F.lit(c).alias("id"), F.lit(float(w)).alias("weight")) for c, w in row)) for row in (under.get(n, []) or [(0, 0.0)] for n in range(max(under) + 1))]
            drawn = F.transform(F.element_at(F.array(*kids), node + 1), _draw(key, level))
            node = F.array_min(drawn)["id"]
        return node.cast("int")


def assign_shards(docs: DataFrame, tree: HashTree, grown: HashTree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard under the tree, its slot there, and its shard under a grown tree.

    Returns doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law ('key'), shard, slot
    (gapless from 0 in each shard), grown_shard (null without a grown tree). The key is the id alone:
    rows that repeat an id share a shard and get slots of their own, rows without an id all go to one
    shard. A null text counts as empty. An empty table gives no rows.
    """
    rows = docs.count()
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    slim = texts(docs, id_col, text_col).select(
        "doc_id",
        (utf8_size(F.col("text")) + 16).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        tree.place(key).alias("shard"),
        (grown.place(key) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    shards = len(tree.leaves)
    out = numbered(slim, ["shard"], ["doc_id", "text_crc32", "size"], "slot", -(-rows // shards))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
