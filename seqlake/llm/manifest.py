"""A Merkle manifest of a table: leaves, subroots by language, a root, and each row's proof, level by level in windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, stage, table, unstage, unused

#: Levels that one shuffle serves: nodes meet by blocks of 2^LEVELS, in which each level is a window of its own.
LEVELS = 8
#: The columns that make a leaf, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose unsigned CRC-32 of the decimal doc_id this divides are tampered with.
TAMPERED = 7


def encoded(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, `:`, and the value (integers in decimal)."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*texts: Column) -> Column:
    """Lowercase hex SHA-256 of the texts' concatenation."""
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def leaf_of(**changed: Column) -> Column:
    """A row's leaf, with some of its columns given anew."""
    return digest(*(encoded(changed.get(c, F.col(c))) for c in COLUMNS))


def _numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with `idx`, counts(grp, n)): the place of each row among its grp, by `order`, from 0, staged.

    Rows are dealt by range and numbered where they lie; what each partition counts of each group is a row of a small
    table (their ranges overlap in one group at most, so about partitions plus groups), whose running sums are the
    partitions' offsets. A last range key that tells equal rows apart lets them spread over partitions.
    """
    apart, place = unused(rows, "apart", "place")
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order)] + [F.col(apart)]
    dealt = rows.withColumn(apart, F.monotonically_increasing_id()).repartitionByRange(partitions(rows.sparkSession), *keys)
    lying = stage(dealt.sortWithinPartitions(*keys).drop(apart).withColumn(place, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(place), 33)
    ranges = stage(lying.groupBy("grp", part.alias("part")).agg(F.count("*").alias("n"), F.min(place).alias("first")))
    before = F.sum("n").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranges.select("grp", "part", F.col("first"), F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("grp")).alias("n"))
    whole = lying.withColumn("part", part).join(offsets, ["grp", "part"])
    return whole.select(*rows.columns, "n", (F.col("before") + F.col(place) - F.col("first")).alias("idx")), ranges.groupBy("grp").agg(F.sum("n").alias("n"))


def _climb(nodes: DataFrame, payload: Column, levels: int) -> DataFrame:
    """(grp, idx, n, h, kids) some levels further up: kids are (of, path), each payload of the nodes(grp, idx, n, h) below.

    n counts a group's nodes on its level; a group with one is done and stays as it is. At each level the nodes of a
    parent are a window partition, in which the ordered list of the whole frame gives the parent's preimage and each
    child's sibling; the parent's row is then kept once. It carries `tree`, the digests of each level below it in order,
    at most 2^(LEVELS + 1) of them, from which a path is read: an array of (other, left), the sibling on each level,
    null where there is none, and whether it stands on the left.
    """
    rows = nodes.select("grp", F.shiftright("idx", LEVELS).alias("block"), "idx", "n", "h", F.array().cast("array<array<string>>").alias("tree"), F.array(payload).alias("of"))
    rows = rows.repartition(partitions(nodes.sparkSession), "grp", "block")
    for _ in range(levels):
        frame = "PARTITION BY grp, block, shiftright(idx, 1) ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
        run = rows.select("grp", "block", "idx", "n", F.expr(f"collect_list(struct(h, tree, of)) OVER ({frame})").alias("run")).filter("idx % 2 = 0")  # a parent once
        rows = run.selectExpr(
            "grp", "block", "shiftright(idx, 1) AS idx", "shiftright(n + 1, 1) AS n",
            "if(n > 1, sha2(cast(array_join(run.h, '') AS BINARY), 256), run[0].h) AS h",
            "if(n > 1, array_append(if(size(run) = 2, zip_with(run[0].tree, run[1].tree, (a, b) -> concat(a, b)), run[0].tree), run.h), run[0].tree) AS tree",
            "flatten(run.of) AS of",
        )
    path = "transform(t, (level, k) -> struct(get(level, cast(shiftright(p, k) ^ 1 AS INT)) AS other, shiftright(p, k) % 2 = 1 AS left))"
    kids = f"transform(array(tree), t -> transform(of, (x, p) -> struct(x AS of, {path} AS path)))[0]"  # the tree is worked out once
    return rows.selectExpr("grp", "idx", "n", "h", f"{kids} AS kids")


def _trees(nodes: DataFrame, counts: DataFrame, payload: Column) -> tuple[DataFrame, DataFrame]:
    """(paths(grp, of, path), roots(grp, h)) of the trees over each group's nodes(grp, idx, n, h)."""
    most = counts.agg(F.max("n")).first()[0] or 1
    levels = int(most - 1).bit_length()
    below, up = [], stage(_climb(nodes, payload, min(levels, LEVELS)))
    while levels > LEVELS:
        below.append(up)
        levels -= LEVELS
        up = stage(_climb(up.select("grp", "idx", "n", "h"), F.col("idx"), min(levels, LEVELS)))
    roots = up.select("grp", "h")
    paths = up.select("grp", F.explode("kids").alias("kid")).select("grp", "kid.of", "kid.path")
    for lower in reversed(below):  # whole blocks, a 2^LEVELS-th of the nodes below them, meet the rest of their path
        rest = paths.select("grp", F.col("of").alias("idx"), F.col("path").alias("rest"))
        paths = lower.select("grp", "idx", "kids").join(rest, ["grp", "idx"]).select("grp", F.explode("kids").alias("kid"), "rest").select("grp", "kid.of", F.concat("kid.path", "rest").alias("path"))
    return paths, roots


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda h, s: F.when(s["other"].isNull(), digest(h)).when(s["left"], digest(s["other"], h)).otherwise(digest(h, s["other"])))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, presented) of every row of docs(doc_id, source, lang, n_chars, text).

    A leaf is H (lowercase hex SHA-256) of the row's columns, each `-` if null, else byte count, `:`, value. In each
    lang, leaves ascend by doc_id (nulls first, equal ids by leaf); while there are several nodes, every two that follow
    one another become their H, and so does a last one alone. What remains is the lang's subroot; the subroots, null
    lang first, then by UTF-8 bytes, give the root in the same way. path holds the siblings from leaf to root.
    `presented` is the leaf with `tampered` in place of n_chars, else the leaf.

    Repeated rows are leaves of their own; a lone row is its own subroot and root, with an empty path; an empty table
    gives no rows; other columns, whatever their names, are ignored. No lang's rows meet in one task: numbers come from
    a range partitioning, and nodes meet by blocks of 2^LEVELS. Each round's blocks are written down.
    """
    lang = F.col("lang").cast("string")
    picked = docs.select("doc_id", F.col("source").cast("string").alias("source"), lang.alias("lang"), "n_chars", F.col("text").cast("string").alias("text"))
    leaf = leaf_of()
    presented = leaf if tampered is None else leaf_of(n_chars=tampered)
    leaves = picked.select(F.coalesce(F.concat(F.lit("1"), lang), F.lit("0")).alias("grp"), "doc_id", leaf.alias("h"), presented.alias("presented"))
    placed, counts = _numbered(leaves, ["doc_id", "h"])
    paths, subroots = _trees(placed, counts, F.struct("doc_id", F.col("h").alias("leaf"), "presented"))
    tops, top_counts = _numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("lang_key"), "h"), ["lang_key"])
    upper, root = _trees(tops, top_counts, F.struct("lang_key", F.col("h").alias("subroot")))
    upper = upper.join(root, "grp").select(F.col("of.lang_key").alias("grp"), "of.subroot", F.col("h").alias("root"), F.col("path").alias("rest"))
    whole = paths.join(upper, "grp")
    return whole.select("of.doc_id", "of.leaf", "subroot", "root", F.concat("path", "rest").alias("path"), "of.presented")


def verified(proofs: DataFrame) -> DataFrame:
    """manifest()'s rows with proof_sha256, H of the path's siblings, and the root folded from the presented leaf."""
    siblings = F.transform(F.filter("path", lambda s: s["other"].isNotNull()), lambda s: s["other"])
    again = folded(F.col("presented"), F.col("path"))
    known = proofs.select("doc_id", "leaf", "subroot", "root", digest(F.array_join(siblings, "")).alias("proof_sha256"), again.alias("folded_root"))
    return known.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampering() -> Column:
    """n_chars, one more where TAMPERED divides the unsigned CRC-32 of the decimal doc_id; nulls stay."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    number = F.col("n_chars").cast("decimal(20,0)")  # one more than the largest long is a number still
    return F.when(chosen, number + 1).otherwise(number).cast("string")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """verified() over the manifest of all documents, some tampered with; nulls, ties, repeats and empty tables as there."""
    return verified(manifest(table(spark, sf_dir, "documents"), tampering()))


#: Unsigned CRC-32 of an ASCII text {0}: its bytes, each followed by eight shifts, folded into the register.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''),
  lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, (r & 1) * 3988292384) END))"""


def op11_sql() -> str:
    def coded(column: str) -> str:
        return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode(CAST({column} AS VARCHAR))) || ':' || {column} END"

    leaf, presented = (" || ".join(coded(n if c == "n_chars" else c) for c in COLUMNS) for n in ("n_chars", "changed"))
    climb = "SELECT g, lvl + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM {0} WHERE n > 1 GROUP BY g, lvl, idx // 2"
    step = "CASE WHEN s.h IS NULL THEN 'N' WHEN (l.idx >> v.lvl) & 1 = 1 THEN 'L' || s.h ELSE 'R' || s.h END"
    path = """SELECT l.id, list({1} ORDER BY v.lvl) AS steps, coalesce(string_agg(s.h, '' ORDER BY v.lvl), '') AS others
  FROM {2} l JOIN (SELECT DISTINCT g, lvl FROM {0} WHERE n > 1) v ON v.g = l.g
  LEFT JOIN {0} s ON s.g = l.g AND s.lvl = v.lvl AND s.idx = xor(l.idx >> v.lvl, 1) GROUP BY l.id"""
    return f"""
WITH RECURSIVE changed AS (
  SELECT *, CASE WHEN {CRC.format("CAST(doc_id AS VARCHAR)")} % {TAMPERED} = 0 THEN n_chars::HUGEINT + 1 ELSE n_chars END AS changed FROM documents),
hashed AS (
  SELECT coalesce('1' || lang, '0') AS g, doc_id, sha256({leaf}) AS h, sha256({presented}) AS presented FROM changed),
leaves AS (
  SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM hashed),
nodes AS (SELECT g, 0 AS lvl, idx, n, h FROM leaves UNION ALL {climb.format("nodes")}),
subroots AS (SELECT g AS id, '' AS g, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n, h FROM nodes WHERE n = 1),
tops AS (SELECT g, 0 AS lvl, idx, n, h FROM subroots UNION ALL {climb.format("tops")}),
below AS ({path.format("nodes", step, "leaves")}),
above AS ({path.format("tops", step, "subroots")}),
proofs AS (
  SELECT l.doc_id, l.h AS leaf, t.h AS subroot, r.h AS root, l.presented,
    sha256(coalesce(b.others, '') || coalesce(a.others, '')) AS proof_sha256,
    list_reduce(list_prepend(l.presented, coalesce(b.steps, []) || coalesce(a.steps, [])),
      lambda h, s: sha256(CASE s[1] WHEN 'N' THEN h WHEN 'L' THEN s[2:] || h ELSE h || s[2:] END)) AS folded_root
  FROM leaves l JOIN subroots t ON t.id = l.g CROSS JOIN (SELECT h FROM tops WHERE n = 1) r
  LEFT JOIN below b ON b.id = l.id LEFT JOIN above a ON a.id = l.g)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM proofs
"""
