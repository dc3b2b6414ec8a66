"""A Merkle manifest of documents with nested-interval labels.

Every document is a leaf, ranked within its language. A node carries the
interval of leaf ranks that it covers. A level's nodes meet the next one's by
the bucket of ranks that both lie in, and the node whose interval contains
theirs is their parent; what the parent's interval has besides a node's own
are the node's siblings. The languages' roots are the leaves of one more tree.

Only hashes are shuffled, never texts. What a node has above it is the same for
all leaves below it, so proofs are handed down from the root, and a run of
leaves gets its common part once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Nodes of a run, whose digests together make their parent's.
FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SIDES = "array<struct<before:string,after:string>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    """The digest of a row's fields, or of them with another text."""
    values = [F.col(c) for c in FIELDS[:-1]] + [F.col("text") if text is None else text]
    return F.sha2(F.concat(*[_field(v) for v in values]).cast("binary"), 256)


def tampered(doc_id: Column) -> Column:
    """Whether a document is tampered with: 3 divides the crc32 of its decimal id; never without one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def _digest(children: Column) -> Column:
    return F.sha2(F.array_join(F.transform(children, lambda c: c["digest"]), "").cast("binary"), 256)


def ranked(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``lo``, their rank from 0 within ``tree`` by ``order``, nulls first, and ``n``, the tree's rows; stored.

    Rows are range partitioned by tree and order, so one tree may fill many
    tasks. A task numbers its rows, and the counts of earlier tasks are added.
    """
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(sorted_.withColumn("_id", F.monotonically_increasing_id()), f"{name}-sorted")
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    runs = placed.groupBy(tree, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    whole = Window.partitionBy(tree)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        F.col(tree).alias("_tree"),
        F.col("_part").alias("_in"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("n"),
    )
    same = F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_in"))
    placed = placed.join(starts, same).select(*rows.columns, (F.col("_id") + F.col("_shift")).alias("lo"), "n")
    return stored(placed, f"{name}-ranked")


def _bucket(rank: Column, level: int) -> Column:
    """Which node of ``level`` covers the rank, counted from the left."""
    return F.floor(rank / F.lit(FANOUT**level)).cast("long")


def levels_above(leaves: DataFrame, tree: str, name: str, carried: tuple[str, ...] = ()) -> list[DataFrame]:
    """The levels of all trees, lowest first: (tree, n, lo, hi, digest, children), each stored.

    leaves: as ``ranked`` gives them, with digest and the carried columns.
    Children are structs (lo, hi, digest, and of leaves the carried columns) in
    order. A tree ends at the level whose one node covers it; a lone leaf has
    no node above.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    current, found = leaves.withColumn("hi", F.col("lo") + 1), []
    own = ("lo", "hi", "digest", *carried)
    while FANOUT ** len(found) < most:
        growing = current.filter(F.col("n") > FANOUT ** len(found))
        bucket = _bucket(F.col("lo"), len(found) + 1).alias("bucket")
        grouped = growing.groupBy(tree, "n", bucket).agg(F.sort_array(F.collect_list(F.struct(*own))).alias("children"))
        nodes = grouped.select(
            tree,
            "n",
            F.col("children")[0]["lo"].alias("lo"),
            F.element_at("children", -1)["hi"].alias("hi"),
            _digest(F.col("children")).alias("digest"),
            "children",
        )
        found.append(stored(nodes, f"{name}-level"))
        current, own = found[-1], ("lo", "hi", "digest")
    return found


def _whole() -> Column:
    """The node, or lone leaf, that covers its tree."""
    return (F.col("lo") == 0) & (F.col("hi") == F.col("n"))


def roots(leaves: DataFrame, levels: list[DataFrame], tree: str) -> DataFrame:
    """(tree, digest) of each tree."""
    found = leaves.filter("lo = 0 and n = 1").select(tree, "digest")
    for level in levels:
        found = found.unionByName(level.filter(_whole()).select(tree, "digest"))
    return found


def _handed_down(node: Column, children: Column, above: Column) -> Column:
    """Children with ``sides``: what stands before and after each in its run, then what stands beside the parent and up.

    The siblings of a child are what its parent's interval has besides its own.
    """

    def joined(some: Column) -> Column:
        return F.array_join(F.transform(some, lambda c: c["digest"]), "")

    def one(child: Column) -> Column:
        before = joined(F.filter(children, lambda c: (c["lo"] >= node["lo"]) & (c["hi"] <= child["lo"])))
        after = joined(F.filter(children, lambda c: (c["lo"] >= child["hi"]) & (c["hi"] <= node["hi"])))
        own = F.array(F.struct(before.alias("before"), after.alias("after")))
        return F.struct(child.alias("child"), F.concat(own, above).alias("sides"))

    return F.transform(children, one)


def leaf_sides(
    levels: list[DataFrame], leaves: DataFrame, tops: DataFrame, tree: str, name: str, carried: tuple[str, ...] = ()
) -> DataFrame:
    """(tree, digest, carried, top, sides) of every leaf; tops: (tree, top, sides) of the trees' roots.

    What a root has comes down with the sides, so that no leaf is joined by its
    tree, which may hold any share of all leaves.
    """
    tops = tops.select(F.col(tree).alias("_tree"), "top", "sides")
    same = F.col(tree).eqNullSafe(F.col("_tree"))
    own = ["digest", *carried]
    # Trees of one leaf have no node above it.
    found = leaves.filter("lo = 0 and n = 1").join(tops, same).select(tree, *own, "top", "sides")
    handed = None
    for level in range(len(levels), 0, -1):
        nodes = levels[level - 1]
        # A root takes what its tree's top has, any other node what its parent hands down.
        named = nodes.filter(_whole()).join(tops, same).select(*nodes.columns, "top", "sides")
        if handed is not None:
            inside = (F.col("c.lo") >= F.col("p.lo")) & (F.col("c.hi") <= F.col("p.hi"))
            near = F.col(f"c.{tree}").eqNullSafe(F.col(f"p.{tree}")) & (_bucket(F.col("c.lo"), level) == F.col("p.bucket"))
            inner = nodes.filter(~_whole()).alias("c").join(handed.alias("p"), near & inside)
            named = named.unionByName(inner.select("c.*", "p.top", "p.sides"))
        down = F.explode(_handed_down(F.struct("lo", "hi"), F.col("children"), F.col("sides"))).alias("k")
        runs = named.select(tree, "top", down)
        if level > 1:
            lo, hi = F.col("k.child.lo"), F.col("k.child.hi")
            bucket = _bucket(lo, level - 1).alias("bucket")
            handed = stored(runs.select(tree, "top", lo.alias("lo"), hi.alias("hi"), bucket, "k.sides"), f"{name}-handed")
        else:
            fields = [F.col(f"k.child.{c}").alias(c) for c in own]
            found = found.unionByName(runs.select(tree, *fields, "top", "k.sides"))
    return found


def folded(digest: Column, sides: Column) -> Column:
    """The root that a leaf's digest gives with its siblings."""
    return F.aggregate(
        sides, digest, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]).cast("binary"), 256)
    )


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered_leaf, subroot, root, sides) of every row of ``docs``.

    ``docs`` has doc_id, source, lang, n_chars and text; other columns are
    ignored. A leaf is the digest of the five, nulls marked and texts of any
    length whole. Leaves are ranked per language by doc_id, a null first; rows
    that share an id by their digests, so equal rows are interchangeable.
    ``tampered_leaf`` is the digest with the text's ASCII letters in lower
    case where ``tampered`` says so, else null. ``sides`` has, from the leaf's run
    up to the root's, the digests before and after the node on the way. A
    null language is a language of its own and the first. No rows give none.
    """
    lower = F.translate("text", _UPPER, _LOWER)
    rows = docs.select(
        "doc_id",
        "lang",
        leaf_digest().alias("digest"),
        F.when(tampered(F.col("doc_id")), leaf_digest(lower)).alias("other"),
    )
    leaves = ranked(rows, "lang", ["doc_id", "digest"], "leaves")
    carried = ("doc_id", "other")
    levels = levels_above(leaves, "lang", "manifest", carried)
    subroots = stored(roots(leaves, levels, "lang"), "subroots")
    # One tree over the languages; a string's order in Spark is that of its bytes.
    above = ranked(subroots.withColumn("all", F.lit(True)), "all", ["lang"], "languages")
    top_levels = levels_above(above, "all", "top", ("lang",))
    end = F.array().cast(_SIDES).alias("sides")
    top = stored(roots(above, top_levels, "all").select("all", F.col("digest").alias("top"), end), "root")
    joined = leaf_sides(top_levels, above, top, "all", "top", ("lang",))
    both = F.struct(F.col("digest").alias("subroot"), F.col("top").alias("root")).alias("top")
    tops = stored(joined.select("lang", both, "sides"), "tops")
    below = leaf_sides(levels, leaves, tops, "lang", "manifest", carried)
    tampered_leaf = F.col("other").alias("tampered_leaf")
    return below.select("doc_id", "lang", F.col("digest").alias("leaf"), tampered_leaf, "top.subroot", "top.root", "sides")


def manifest_proofs(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row; see ``manifest``.

    The proof is the digest of all siblings from the leaf up, left to right; a
    leaf without any has the digest of nothing. The folded root comes from the
    tampered leaf where there is one, else from the leaf.
    """
    proof = F.array_join(F.transform("sides", lambda s: F.concat(s["before"], s["after"])), "")
    found = manifest(docs).select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(proof.cast("binary"), 256).alias("proof_sha256"),
        folded(F.coalesce("tampered_leaf", "leaf"), F.col("sides")).alias("folded_root"),
    )
    return found.select("*", (F.col("folded_root") == F.col("root")).alias("verified"))


_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(v) for v in (*FIELDS[:-1], text)) + ")"


#: The rows of the registered query.
PROOFS_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql('text')} AS leaf,
    CASE WHEN {_CRC_SQL} % 3 = 0 THEN {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS other
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), up AS (
  SELECT tree, 0 AS level, pos, leaf AS h FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM up) WHERE n > 1 GROUP BY tree, level, pos // 8
), tops AS (
  SELECT tree, max(level) AS height, arg_max(h, level) AS subroot,
    row_number() OVER (ORDER BY encode(tree)) - 1 AS place
  FROM up GROUP BY tree
), above AS (
  SELECT 0 AS level, place AS pos, subroot AS h FROM tops
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS n FROM above) WHERE n > 1 GROUP BY level, pos // 8
), nodes AS (
  SELECT u.tree, u.level, u.pos, u.h FROM up u
  UNION ALL
  SELECT t.tree, t.height + a.level, a.pos, a.h FROM above a CROSS JOIN tops t WHERE a.level > 0
), steps AS (
  SELECT n.tree, n.level, n.pos,
    coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < n.pos), '') AS before,
    coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > n.pos), '') AS after
  FROM up n JOIN up s ON s.tree = n.tree AND s.level = n.level AND s.pos // 8 = n.pos // 8
  JOIN tops t ON t.tree = n.tree AND n.level < t.height
  GROUP BY ALL
  UNION ALL
  SELECT t.tree, t.height + n.level, n.pos,
    coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < n.pos), ''),
    coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > n.pos), '')
  FROM above n JOIN above s ON s.level = n.level AND s.pos // 8 = n.pos // 8
  JOIN tops t ON n.pos = t.place // CAST(pow(8, n.level) AS BIGINT)
  WHERE n.level < (SELECT max(level) FROM above)
  GROUP BY ALL
), fold AS (
  SELECT p.tree, p.pos AS leaf_pos, 0 AS level, coalesce(p.other, p.leaf) AS h, '' AS proof FROM placed p
  UNION ALL
  SELECT f.tree, f.leaf_pos, f.level + 1, sha256(s.before || f.h || s.after), f.proof || s.before || s.after
  FROM fold f JOIN tops t ON t.tree = f.tree JOIN steps s ON s.tree = f.tree AND s.level = f.level
    AND s.pos = CASE WHEN f.level < t.height THEN f.leaf_pos // CAST(pow(8, f.level) AS BIGINT)
      ELSE t.place // CAST(pow(8, f.level - t.height) AS BIGINT) END
), ends AS (
  SELECT tree, leaf_pos, arg_max(h, level) AS folded_root, arg_max(proof, level) AS proof FROM fold GROUP BY ALL
), root AS (SELECT arg_max(h, level) AS root FROM above)
SELECT p.doc_id, p.leaf, t.subroot, r.root, sha256(e.proof) AS proof_sha256, e.folded_root,
  e.folded_root = r.root AS verified
FROM placed p JOIN ends e ON e.tree = p.tree AND e.leaf_pos = p.pos JOIN tops t ON t.tree = p.tree CROSS JOIN root r
"""
