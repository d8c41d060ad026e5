"""Merkle dataset manifest: a digest for each row, a tree of them for each language, one root, and a proof for each row.

Bottom-up build: rows get their places (range partitions, counts of earlier partitions, places inside), and every level of a
tree is a persisted table of runs of ``FAN`` nodes at most, whose digests are the nodes of the level above. The tops of the trees
are the leaves of one more tree. Top-down proof push: the levels join children to parents; each child prepends its siblings to
the proof it inherits, so a proof is joined once for each run, not once for each row and level.

A group of any size spreads over tasks: its places come from range partitions, and what meets in a task is a run of ``FAN`` nodes.
Only the number of levels and the root reach the driver.

Defined results for odd rows: a null field is ``-``; a null lang is a group of its own, before all others; a null doc_id comes
first in its group and is never tampered with; rows of equal doc_id are leaves of their own, in order of their digests; empty and
very long texts are hashed whole; an empty table has no root and gives no row; further columns are no part of a leaf, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import by_size, stored, table
from .line_dedup import UPPER

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<l:binary,r:binary>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: dict[str, Column]) -> Column:
    """The digest (hex) of a row's fields, in the order of ``values``."""
    return F.sha2(F.concat(*map(_field, values.values())), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _digest(parts: Column) -> Column:
    """The digest, as bytes, of digests that stand one after another as bytes."""
    return F.unhex(F.sha2(_hex(parts), 256))


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with _at, the place of each in its group from 0, and _size, the group's size. Rows that are equal in ``order`` are told
    apart by _tie, so that equal rows of any number spread too."""
    order = [*order, "_tie"]
    tied = stored(rows.withColumn("_tie", F.monotonically_increasing_id()), "leaves")
    spread = stored(tied.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()), "spread")
    counts = spread.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_size"))
    inside = F.row_number().over(Window.partitionBy("_part", group).orderBy(*order))
    numbered = spread.withColumn("_row", inside).join(by_size(stored(offsets, "offsets")), [group, "_part"])
    return numbered.withColumn("_at", F.col("_before") + F.col("_row") - 1).drop("_part", "_row", "_before", "_tie")


@dataclass
class Forest:
    """Trees by group. ``levels[k]``: runs of level k, (_g, _run, _blob: their digests one after another, _size: nodes of the group on
    that level), and on level 0 _rows, what the leaves carry; groups of one leaf have a run on level 0 only. ``tops``: (_g, _top, _level)."""

    levels: list[DataFrame]
    tops: DataFrame


def build(leaves: DataFrame, carried: list[str], name: str, fan: int = FAN) -> Forest:
    """The trees over ``leaves``: _g, _digest, _at, _size and the columns ``carried``."""
    nodes, levels, tops = leaves, [], None
    largest = None
    while largest is None or largest > 1:
        level = len(levels)
        payload = [F.struct(*carried).alias("row")] if level == 0 else []
        kid = F.struct("_at", F.col("_digest").alias("digest"), *payload)
        runs = nodes.where("_size > 1" if level else "true").groupBy("_g", F.expr(f"_at div {fan}").alias("_run")).agg(F.sort_array(F.collect_list(kid)).alias("_kids"), F.first("_size").alias("_size"))
        blob = F.unhex(F.array_join(F.transform("_kids", lambda k: F.hex(k["digest"])), ""))
        rows = [F.transform("_kids", lambda k: k["row"]).alias("_rows")] if level == 0 else []
        runs = stored(runs.select("_g", "_run", blob.alias("_blob"), "_size", *rows), f"{name}-{level}")
        levels.append(runs)
        if level == 0:
            largest = runs.agg(F.max("_size")).first()[0] or 0
            tops = runs.where("_size = 1").select("_g", F.col("_blob").alias("_top"), F.lit(0).alias("_level"))
        if largest > 1:
            up = runs.where("_size > 1").select("_g", F.col("_run").alias("_at"), _digest(F.col("_blob")).alias("_digest"), F.expr(f"(_size + {fan - 1}) div {fan}").alias("_size"))
            tops = tops.unionByName(up.where("_size = 1").select("_g", F.col("_digest").alias("_top"), F.lit(level + 1).alias("_level")))
            nodes, largest = up, -(-largest // fan)
    return Forest(levels, stored(tops, f"{name}-tops"))


def _children(runs: DataFrame, parents: DataFrame) -> DataFrame:
    """``runs`` with _kid, each child's place in its run, and _proof: the child's siblings before what the run's node inherits."""
    kept = [c for c in runs.columns if c not in ("_g", "_run", "_size")]
    both = runs.select("_g", "_run", *kept).join(parents, ["_g", "_run"])
    each = both.withColumn("_kid", F.explode(F.sequence(F.lit(0), F.expr("octet_length(_blob) div 32 - 1"))))
    left, right = F.substring(F.col("_blob"), F.lit(1), F.col("_kid") * 32), F.substring(F.col("_blob"), F.col("_kid") * 32 + 33, F.octet_length("_blob"))
    return each.withColumn("_proof", F.concat(F.array(F.struct(left.alias("l"), right.alias("r"))), "_proof"))


def proofs(forest: Forest, inherited: DataFrame, fan: int = FAN) -> DataFrame:
    """(_digest, _proof, the carried columns, and those of ``inherited``) for each leaf. ``inherited``: (_g, _proof, ...), what the top
    of each group inherits. A proof is a list of (siblings to the left, siblings to the right), from the leaf up."""
    tops = forest.tops.select("_g", "_level").join(inherited, "_g")
    more = [c for c in inherited.columns if c not in ("_g", "_proof")]
    parents = None
    for level in range(len(forest.levels) - 1, 0, -1):
        ends = tops.where(F.col("_level") == level + 1).select("_g", F.lit(0).cast("long").alias("_run"), "_proof", *more)
        parents = ends if parents is None else parents.unionByName(ends)
        kids = _children(forest.levels[level], parents)
        parents = stored(kids.select("_g", (F.col("_run") * fan + F.col("_kid")).alias("_run"), "_proof", *more), f"proofs-{level}")
    ends = tops.where("_level = 1").select("_g", F.lit(0).cast("long").alias("_run"), "_proof", *more)
    parents = ends if parents is None else parents.unionByName(ends)
    leaves = _children(forest.levels[0].where("_size > 1"), parents)
    lone = forest.levels[0].where("_size = 1").join(tops.where("_level = 0").select("_g", "_proof", *more), "_g").withColumn("_kid", F.lit(0))
    wanted = [F.substring(F.col("_blob"), F.col("_kid") * 32 + 1, F.lit(32)).alias("_digest"), "_proof", F.get("_rows", F.col("_kid")).alias("_row"), *more]
    return leaves.select(*wanted).unionByName(lone.select(*wanted)).select("_digest", "_proof", "_row.*", *more)


@dataclass
class Manifest:
    """``by_group``: the forest of the rows; ``over``: the tree over its tops; ``root``: hex, None of an empty table."""

    by_group: Forest
    over: Forest
    root: str | None


def manifest(docs: DataFrame, digest: Column, group: str = "lang", key: str = "doc_id", carried: dict[str, Column] | None = None, fan: int = FAN) -> Manifest:
    """Build all levels over ``docs``: trees by ``group``, their leaves ``digest`` (hex) in order of ``key``; leaves carry ``key`` and
    ``carried``."""
    # '' and '=' + value order groups by bytes, null first, and join without a rule for nulls
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    kept = {"_key": F.col(key), **(carried or {})}
    rows = docs.select(name.alias("_g"), F.unhex(digest).alias("_digest"), *(c.alias(n) for n, c in kept.items()))
    by_group = build(placed(rows, "_g", ["_key", "_digest"]), list(kept), "merkle", fan)
    tops = by_group.tops.select(F.lit("").alias("_g"), F.col("_g").alias("_group"), F.col("_top").alias("_digest"))
    over = build(placed(tops, "_g", ["_group"]), ["_group"], "merkle-over", fan)
    root = over.tops.select(_hex(F.col("_top"))).first()
    return Manifest(by_group, over, root and root[0])


def with_proofs(made: Manifest, fan: int = FAN) -> DataFrame:
    """(_digest, _proof, _subroot: bytes, and what leaves carry) for each row of the table, its proof reaching from the leaf to the root."""
    spark = made.over.tops.sparkSession
    none = made.over.tops.select("_g", F.array().cast(PROOF).alias("_proof"))
    above = proofs(made.over, none, fan).select(F.col("_group").alias("_g"), "_proof", F.col("_digest").alias("_subroot"))
    return proofs(made.by_group, stored(above, "inherited") if made.root else spark.createDataFrame([], f"_g string, _proof {PROOF}, _subroot binary"), fan)


def folded(digest: Column, proof: Column) -> Column:
    """The root (hex) that follows from a leaf's digest (bytes) and its proof."""
    return F.aggregate(proof, _hex(digest), lambda d, p: F.sha2(F.concat(_hex(p["l"]), d, _hex(p["r"])), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda p: _hex(F.concat(p["l"], p["r"]))), ""), 256)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *FIELDS)
    whole = {c: F.col(c) for c in FIELDS}
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = leaf(whole | {"text": F.translate("text", UPPER, UPPER.lower())})
    made = manifest(docs, leaf(whole), carried={"_tampered": F.when(chosen & F.col("text").rlike("[A-Z]"), F.unhex(lowered))})
    rows = with_proofs(made).withColumn("folded_root", folded(F.coalesce("_tampered", "_digest"), F.col("_proof")))
    root = F.lit(made.root).cast("string")
    return rows.select(
        F.col("_key").alias("doc_id"), _hex(F.col("_digest")).alias("leaf"), _hex(F.col("_subroot")).alias("subroot"), root.alias("root"),
        proof_digest(F.col("_proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"),
    )


SQL = r"""
WITH RECURSIVE parts AS (
  SELECT doc_id, text, coalesce('=' || lang, '') AS g,
         concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
               lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc
  FROM documents
), hashed AS (
  SELECT doc_id, g, crc % 3 = 0 AS chosen, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS tampered
  FROM parts
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS size FROM hashed
), nodes AS (
  SELECT g, 0 AS level, pos, leaf AS digest, size FROM leaves
  UNION ALL
  SELECT g, max(level) + 1, pos >> 3, sha256(string_agg(digest, '' ORDER BY pos)), max((size + 7) >> 3) FROM nodes WHERE size > 1 GROUP BY g, pos >> 3
), tops AS (
  SELECT g, digest, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS size FROM nodes WHERE size = 1
), over AS (
  SELECT 0 AS level, pos, digest, size FROM tops
  UNION ALL
  SELECT max(level) + 1, pos >> 3, sha256(string_agg(digest, '' ORDER BY pos)), max((size + 7) >> 3) FROM over WHERE size > 1 GROUP BY pos >> 3
), met AS (
  SELECT l.g, l.pos, 0 AS tree, n.level, n.pos AS other, l.pos >> (3 * n.level) AS own, n.digest
  FROM leaves l JOIN nodes n ON n.g = l.g AND n.size > 1 AND n.pos >> 3 = l.pos >> (3 * n.level + 3)
  UNION ALL
  SELECT l.g, l.pos, 1, o.level, o.pos, t.pos >> (3 * o.level), o.digest
  FROM leaves l JOIN tops t ON t.g = l.g JOIN over o ON o.size > 1 AND o.pos >> 3 = t.pos >> (3 * o.level + 3)
), steps AS (
  SELECT g, pos, tree, level, coalesce(string_agg(digest, '' ORDER BY other) FILTER (WHERE other < own), '') AS l,
         coalesce(string_agg(digest, '' ORDER BY other) FILTER (WHERE other > own), '') AS r
  FROM met GROUP BY g, pos, tree, level
), proofs AS (
  SELECT g, pos, list({'l': l, 'r': r} ORDER BY tree, level) AS proof FROM steps GROUP BY g, pos
), folded AS (
  SELECT l.doc_id, l.leaf, t.digest AS subroot, (SELECT digest FROM over WHERE size = 1) AS root,
         sha256(coalesce(list_aggregate(list_transform(proof, lambda p: p.l || p.r), 'string_agg', ''), '')) AS proof_sha256,
         list_reduce(list_prepend({'l': CASE WHEN chosen THEN tampered ELSE leaf END, 'r': ''}, coalesce(proof, [])),
                     lambda x, y: {'l': sha256(y.l || x.l || y.r), 'r': ''}).l AS folded_root
  FROM leaves l JOIN tops t ON t.g = l.g LEFT JOIN proofs p ON p.g = l.g AND p.pos = l.pos
)
SELECT *, folded_root = root AS verified FROM folded
"""
