"""A Merkle manifest of a table: a tree for each source, a tree over the sources, a proof for each row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.shared import drop_stage, stage

#: Nodes that share a parent.
ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEP = "array<struct<l:array<binary>,r:array<binary>>>"


def _field(value: Column) -> Column:
    """A value as its number of UTF-8 bytes, a colon and itself; null is a lone dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 (32 bytes) of the fields of a row, one after the other."""
    return F.unhex(F.sha2(F.concat(*[_field(v) for v in values]).cast("binary"), 256))


def _hashed(digests: Column) -> Column:
    """SHA-256 of an array of digests, written one after the other as lower-case hex."""
    return F.sha2(F.array_join(F.transform(digests, lambda d: F.lower(F.hex(d))), ""), 256)


def _source_key(source: Column) -> Column:
    """A text in the order of sources, null before all others, that is never null itself."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def numbered(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``idx``, their place from 0 in their group by ``order``, and ``n``, the rows of the group.

    The table is sorted by ranges, so that a group of any size is spread over tasks; only the numbers of rows by
    (group, range) are summed up, at most as many for a group as there are ranges.
    """
    placed = rows.orderBy(F.col(group), *order).withColumn("place", F.monotonically_increasing_id())
    placed = stage(placed, name).withColumn("part", F.shiftright("place", 33))
    counts = placed.groupBy(group, "part").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    upto = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        group,
        "part",
        "first",
        F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("before"),
        F.sum("rows").over(Window.partitionBy(group)).alias("n"),
    )
    return placed.join(starts, [group, "part"]).select(
        *rows.columns, (F.col("before") + F.col("place") - F.col("first")).alias("idx"), "n"
    )


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes(tree, idx, n, digest)`` with ``l`` and ``r``: the digests of their siblings to the left and right.

    Each sibling's index follows from the node's own (the other one of a pair by XOR, else by an offset of the slot), so every
    sibling is an equi-join on (tree, index), in which no key occurs twice.
    """
    slot, first = F.col("idx") % arity, F.col("idx") - F.col("idx") % arity
    out, names = nodes, []
    for shift in range(1, arity):
        other = F.col("idx").bitwiseXOR(1) if arity == 2 else first + (slot + shift) % arity
        name = f"_s{shift}"
        names.append(name)
        near = nodes.select(F.col("tree"), F.col("idx").alias(f"{name}_at"), F.col("digest").alias(name))
        out = out.withColumn(f"{name}_at", other).join(near, ["tree", f"{name}_at"], "left")
    found = F.array_sort(F.filter(
        F.array(*[F.struct(F.col(f"{s}_at").alias("at"), F.col(s).alias("digest")) for s in names]),
        lambda s: s["digest"].isNotNull(),
    ))
    side = lambda keep: F.transform(F.filter(found, keep), lambda s: s["digest"])
    return out.select(
        *nodes.columns,
        side(lambda s: s["at"] < F.col("idx")).alias("l"),
        side(lambda s: s["at"] > F.col("idx")).alias("r"),
    )


@dataclass(frozen=True)
class Forest:
    """Trees level by level: nodes with siblings (staged), and the roots that a level ends in."""

    levels: list[DataFrame]
    ended: list[DataFrame]
    arity: int

    @property
    def roots(self) -> DataFrame:
        """(tree, digest), one row for each tree."""
        out = self.ended[0]
        for other in self.ended[1:]:
            out = out.unionByName(other)
        return out.select("tree", "digest")

    def paths(self, above: DataFrame) -> DataFrame:
        """(tree, idx, path) of the lowest nodes: the siblings at each level up to the root, then ``above(tree, path)``.

        Goes downwards, so that a path is put together once for all nodes under the same parent; every level but the lowest is
        staged, so that no plan grows with the height.
        """
        found, held = None, None
        for level in range(len(self.ended) - 1, -1, -1):
            here = self.ended[level].select("tree", "idx").join(above, "tree").select("tree", "idx", "path")
            if level < len(self.levels):
                up = found.select("tree", F.col("idx").alias("up"), "path")
                step = F.array(F.struct("l", "r")).cast(_STEP)
                nodes = self.levels[level].withColumn("up", F.expr(f"idx div {self.arity}"))
                lower = nodes.join(up, ["tree", "up"]).select("tree", "idx", F.concat(step, "path").alias("path"))
                here = here.unionByName(lower)
            if level:
                here = stage(here, "paths")
                if held is not None:
                    drop_stage(held)
                held = here
            found = here
        return found


def grow(nodes: DataFrame, arity: int = ARITY) -> Forest:
    """All trees over ``nodes(tree, idx, n, digest)`` at once, a level a round.

    Rows with slot 0 carry their run to the next level: SHA-256 of the run's digests in order, also of a run of one. A
    tree of one node is its own root. Rounds: the logarithm of the largest tree's size.
    """
    levels, ended = [], []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        ended.append(nodes.where("n = 1"))
        if most <= 1:
            return Forest(levels, ended, arity)
        open_nodes = nodes.where("n > 1")
        level = stage(with_siblings(open_nodes.select("tree", "idx", "n", "digest"), arity), "level")
        levels.append(level)
        nodes = level.where(F.col("idx") % arity == 0).select(
            "tree",
            F.expr(f"idx div {arity}").alias("idx"),
            F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
            F.unhex(_hashed(F.concat(F.array("digest"), "r"))).alias("digest"),
        )
        most = -(-most // arity)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path, as lower-case hex."""
    return F.lower(F.hex(F.aggregate(
        path, leaf, lambda node, step: F.unhex(_hashed(F.concat(step["l"], F.array(node), step["r"])))
    )))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings on a path, level by level, from left to right."""
    return _hashed(F.flatten(F.transform(path, lambda step: F.concat(step["l"], step["r"]))))


def manifest(rows: DataFrame, arity: int = ARITY) -> DataFrame:
    """``rows(doc_id, source, leaf[, ...])`` with ``subroot``, ``root`` (32 bytes) and ``path``, an array of (l, r).

    Leaves of a source ascend by doc_id (null first), equal ids by their digest; rows that are equal in both are
    leaves of their own, alike in every column of the result but for their path. Sources ascend by their bytes, null before all others and
    the empty one next. An empty table gives an empty result. ``rows`` is read more than once: stage it.
    """
    keyed = rows.withColumn("tree", _source_key(F.col("source")))
    leaves = stage(numbered(keyed, "tree", [F.asc_nulls_first("doc_id"), F.asc("leaf")], "sorted"), "leaves")
    forest = grow(leaves.select("tree", "idx", "n", F.col("leaf").alias("digest")), arity)
    subroots = stage(forest.roots, "subroots")
    tops = numbered(subroots.select(F.lit("").alias("all"), F.col("tree").alias("of"), "digest"), "all", [F.asc("of")], "sorted")
    tops = stage(tops.select("of", F.col("all").alias("tree"), "idx", "n", "digest"), "tops")
    crown = grow(tops.drop("of"), arity)
    root = crown.roots.select("digest").scalar()
    nothing = F.array().cast(_STEP)
    upper = crown.paths(tops.select("tree").distinct().withColumn("path", nothing))
    above = stage(
        tops.join(upper, ["tree", "idx"]).select(
            F.col("of").alias("tree"), "path", F.col("digest").alias("subroot"), root.alias("root")
        ),
        "above",
    )
    below = forest.paths(above.select("tree", "path"))
    return (
        leaves.join(below, ["tree", "idx"])
        .join(above.select("tree", "subroot", "root"), "tree")
        .select(*rows.columns, "subroot", "root", "path")
    )


def verified_manifest(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """Leaf, subroot, root and proof of each row of ``docs``, and whether a later copy still verifies.

    ``docs`` has the columns of ``FIELDS`` (numbers of any kind, null, empty and long texts alike; others are ignored), and, if a
    copy is to be verified, ``seen_text``: the text found later. ``folded_root`` follows from that copy and the
    original siblings; ``verified`` says whether it equals the root.
    """
    fields = [F.col(f) for f in FIELDS]
    seen = [F.col("seen_text" if f == "text" and "seen_text" in docs.columns else f) for f in FIELDS]
    leaf = leaf_digest(*fields)
    digests = stage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                    leaf.alias("leaf"), leaf_digest(*seen).alias("seen")),
        "digests",
    )
    low = lambda c: F.lower(F.hex(c)).alias(c)
    found = manifest(digests, arity).select(
        "doc_id",
        low("leaf"),
        low("subroot"),
        low("root"),
        proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.col("seen"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
