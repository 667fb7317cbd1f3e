"""Merkle manifest of a dataset: a root for each group and one for all, with
the siblings that prove each row.

A leaf is the SHA-256 of a row's fields. Leaves of a group are numbered in order
by a range partitioning. Each block of 512 consecutive leaves keeps its level as
one hex string of 64 characters a node: a parent is the hash of a fixed-width
substring of 8 nodes, so three levels of a block follow in SQL from its string.
Block roots are nodes of the next round, in blocks of 512 again, until every
group has one node; the groups' roots, in order, are hashed the same way. On the
way down a block hands its nodes the substrings that flank them: the siblings of
every level above. A row then folds its leaf with them to the root.

Null fields are ``-``, empty ones ``0:``. A null group comes first; leaves with a
null id come first in their group, rows of one id are ordered by their leaves.
Repeated rows are leaves each. An empty table gives an empty result. Texts are
hashed whole at any length. Only the named columns are read, so extra columns
and their names do no harm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import stored, table

FAN, LEVELS, HEX = 8, 3, 64
BLOCK = FAN ** LEVELS
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest_of(*parts) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return digest_of(*[field(c) for c in fields])


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``leaves`` (a stored table) with ``idx``: the place in the group, from 0."""
    keys = [group, *order]
    dealt = stored(leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "merkle-ranges")
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    # one row for each range partition and group in it
    runs = dealt.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    past = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(past), F.lit(0))).drop("_n")
    return dealt.join(runs, [group, "_part"]).withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def _parents(level: Column) -> Column:
    """The next level's string: the hash of each run of FAN nodes."""
    run = FAN * HEX
    last = F.ceil(F.octet_length(level) / run).cast("int") - 1
    return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda j: F.sha2(F.substring(level, j * run + 1, F.lit(run)), 256)), "").cast("binary")


def blocks(nodes: DataFrame) -> DataFrame:
    """One row for each block of (group, idx, hash, n): the levels' strings and
    the block's root. ``n`` is the group's number of nodes, which sets how many
    levels a block has: a lone node is a root already."""
    own = F.struct("idx", "hash")
    rows = nodes.groupBy("group", F.expr(f"idx div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(own)).alias("nodes"), F.max("n").alias("n"))
    rows = rows.select("group", "block", "n", F.array_join(F.transform("nodes", lambda x: x["hash"]), "").cast("binary").alias("l0"))
    for k in range(LEVELS):  # level k exists above when the group has more than FAN^k nodes
        rows = rows.withColumn(f"l{k + 1}", F.when(F.col("n") > FAN ** k, _parents(F.col(f"l{k}"))))
    top = F.coalesce(*[F.col(f"l{k}") for k in range(LEVELS, -1, -1)])
    return rows.withColumn("top", top.cast("string"))


def flanks(idx: Column) -> Column:
    """The nodes left and right of a node's path in its block, level by level."""
    at = F.pmod(idx, F.lit(BLOCK)).cast("int")
    out = []
    for k in range(LEVELS):
        level, here = F.col(f"l{k}"), F.floor(at / FAN ** k).cast("int")
        run = F.substring(level, F.floor(here / FAN).cast("int") * (FAN * HEX) + 1, F.lit(FAN * HEX))
        cut = F.pmod(here, F.lit(FAN)) * HEX
        side = F.struct(F.substring(run, F.lit(1), cut).cast("string").alias("left"),
                        F.substring(run, cut + HEX + 1, F.lit(FAN * HEX)).cast("string").alias("right"))
        out.append(F.when(F.col(f"l{k + 1}").isNotNull(), side))
    return F.filter(F.array(*out), lambda s: s.isNotNull())


def _rounds(nodes: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """(nodes, blocks) of each round until every group has one node."""
    out = []
    while True:
        made = stored(blocks(nodes), "merkle-blocks")
        out.append((nodes, made))
        more = made.agg(F.max("n")).first()[0]
        if more is None or more <= BLOCK:
            return out
        nodes = made.select("group", F.col("block").alias("idx"), F.col("top").alias("hash"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"))


def _down(rounds: list, above: DataFrame) -> DataFrame:
    """Every block of the first round with the path above its root: ``above``
    (group, path, and what else holds for a group) handed down."""
    path = rounds[-1][1].join(above, "group")
    for nodes, made in reversed(rounds[:-1]):
        handed = [c for c in above.columns if c not in ("group", "path")]
        each = path.select("group", F.explode(F.sequence(F.col("block") * BLOCK, F.least((F.col("block") + 1) * BLOCK, F.col("n")) - 1)).alias("child"),
                           "path", *handed, *[f"l{k}" for k in range(LEVELS + 1)])
        each = each.select("group", F.col("child").alias("block"), F.concat(flanks(F.col("child")), "path").alias("path"), *handed)
        path = stored(made.join(each, ["group", "block"]), "merkle-paths")
    return path


def manifest(docs: DataFrame, fields: list[str] = FIELDS, group_col: str = "lang", id_col: str = "doc_id",
             tampered: Callable[[dict[str, Column]], dict[str, Column]] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path (left and right siblings of each level),
    proof_sha256, folded_root, verified. ``tampered`` gives the fields as they
    are found when the row is checked against the manifest (None: untouched)."""
    base = {c: F.col(c) for c in dict.fromkeys([*fields, group_col, id_col])}
    found = {**base, **(tampered(base) if tampered else {})}
    group = F.coalesce(F.concat(F.lit("1"), base[group_col].cast("string")), F.lit("0"))  # null first
    rows = docs.select(base[id_col].alias("doc_id"), group.alias("group"), leaf([base[c] for c in fields]).alias("hash"), leaf([found[c] for c in fields]).alias("seen"))
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "merkle-leaves")
    counts = rows.groupBy("group").agg(F.count("*").alias("n"))
    leaves = stored(numbered(rows, "group", ["doc_id", "hash", "uid"]).join(counts, "group"), "merkle-numbered")
    rounds = _rounds(leaves.select("group", "idx", "hash", "n"))

    # the groups' roots, in order, are the leaves of one more tree
    subroots = stored(rounds[-1][1].select(F.lit("").alias("all"), F.col("group").alias("name"), F.col("top").alias("hash")), "merkle-subroots")
    total = subroots.count()
    tops = stored(numbered(subroots, "all", ["name"]).select(F.col("all").alias("group"), "idx", "hash", "name", F.lit(total).cast("long").alias("n")), "merkle-groups")
    upper = _rounds(tops.drop("name"))
    root = upper[-1][1].select("group", F.col("top").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    above = _down(upper, root)
    block = F.expr(f"idx div {BLOCK}").alias("block")
    above = (tops.select("group", block, "idx", "name", F.col("hash").alias("subroot")).join(above, ["group", "block"])
             .select(F.col("name").alias("group"), F.concat(flanks(F.col("idx")), "path").alias("path"), "subroot", "root"))
    above = stored(above, "merkle-above")

    lowest = _down(rounds, above)
    placed = leaves.withColumn("block", F.expr(f"idx div {BLOCK}")).drop("n").join(lowest, ["group", "block"])
    path = F.concat(flanks(F.col("idx")), "path")
    folded = F.aggregate("path", F.col("seen"), lambda acc, s: digest_of(s["left"], acc, s["right"]))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    return (placed.select("doc_id", F.col("hash").alias("leaf"), "seen", "subroot", "root", path.alias("path"))
            .withColumns({"proof_sha256": proof, "folded_root": folded}).drop("seen").withColumn("verified", F.col("folded_root") == F.col("root")))


def lower_every_third(columns: dict[str, Column]) -> dict[str, Column]:
    hit = F.pmod(F.crc32(columns["doc_id"].cast("string")), F.lit(3)) == 0
    return {"text": F.when(hit, lowered(columns["text"])).otherwise(columns["text"])}


def query(spark, sf_dir: str) -> DataFrame:
    return digest(manifest(table(spark, sf_dir, "documents"), tampered=lower_every_third))


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


SQL = """
WITH RECURSIVE
f AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS name, doc_id::VARCHAR AS a, source AS b, lang AS c, n_chars::VARCHAR AS d, text AS e,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda s, y: list_reduce(list_prepend(xor(s, y), range(8)), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)))) AS crc
  FROM documents),
g AS (
  SELECT doc_id, name, e, crc,
         coalesce(strlen(a) || ':' || a, '-') || coalesce(strlen(b) || ':' || b, '-') || coalesce(strlen(c) || ':' || c, '-') || coalesce(strlen(d) || ':' || d, '-') AS head,
         CASE WHEN crc % 3 = 0 THEN translate(e, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE e END AS low FROM f),
h AS (
  SELECT doc_id, name, sha256(head || coalesce(strlen(e) || ':' || e, '-')) AS leaf, sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS seen FROM g),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY name) AS n FROM h),
lower_tree(name, level, idx, hash, n) AS (
  SELECT name, 0, idx, leaf, n FROM leaves
  UNION ALL
  SELECT name, level + 1, idx // 8, sha256(string_agg(hash, '' ORDER BY idx)), (n + 7) // 8 FROM lower_tree WHERE n > 1 GROUP BY name, level, idx // 8, n),
subroots AS (
  SELECT name, hash AS subroot, row_number() OVER (ORDER BY name) - 1 AS idx, count(*) OVER () AS n FROM lower_tree WHERE n = 1),
upper_tree(level, idx, hash, n) AS (
  SELECT 0, idx, subroot, n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(hash, '' ORDER BY idx)), (n + 7) // 8 FROM upper_tree WHERE n > 1 GROUP BY level, idx // 8, n),
sides AS (
  SELECT 0 AS part, name, level, idx,
         coalesce(string_agg(hash, '') OVER (PARTITION BY name, level, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(hash, '') OVER (PARTITION BY name, level, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM lower_tree WHERE n > 1
  UNION ALL
  SELECT 1, '', level, idx,
         coalesce(string_agg(hash, '') OVER (PARTITION BY level, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
         coalesce(string_agg(hash, '') OVER (PARTITION BY level, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')
  FROM upper_tree WHERE n > 1),
steps AS (
  SELECT v.name, v.idx, s.part, s.level, s.l, s.r FROM leaves v JOIN sides s ON s.part = 0 AND s.name = v.name AND s.idx = v.idx >> (3 * s.level)
  UNION ALL
  SELECT v.name, v.idx, s.part, s.level, s.l, s.r FROM leaves v JOIN subroots t ON t.name = v.name JOIN sides s ON s.part = 1 AND s.idx = t.idx >> (3 * s.level)),
paths AS (
  SELECT name, idx, list(l || '|' || r ORDER BY part, level) AS path, string_agg(l || r, '' ORDER BY part, level) AS flat FROM steps GROUP BY name, idx),
folded AS (
  SELECT v.doc_id, v.leaf, t.subroot, (SELECT hash FROM upper_tree WHERE n = 1) AS root, sha256(coalesce(p.flat, '')) AS proof_sha256,
         list_reduce(list_prepend(v.seen, coalesce(p.path, [])), lambda acc, x: sha256(split_part(x, '|', 1) || acc || split_part(x, '|', 2))) AS folded_root
  FROM leaves v JOIN subroots t ON t.name = v.name LEFT JOIN paths p ON p.name = v.name AND p.idx = v.idx)
SELECT *, folded_root = root AS verified FROM folded
"""
