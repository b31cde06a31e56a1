"""Rows dealt to shards by a hierarchical weighted hash tree.

A tree has regions, racks and shards.  A row descends it: at each level every
child draws an exponential time from a hash of (row's key, child), divided by the
child's weight, and the smallest draw wins, so a child is taken in proportion to
its weight and a row moves only where a weight changed.  Weight comes in grants:
the founding one, and one for each later addition.  The first level draws among
(region, grant) pairs and the levels below among the holders of that grant, so a
row that a growing region wins goes to what was added and to no older shard of
that region.  Lowering a weight moves rows out of that region only, shifting
weight within a region or a rack moves rows within it only.

All of it is one projection in SQL functions: the tree is a map literal whose
size follows the tree, a row looks up its children level by level.  Numbering
(``numbered``) sorts by a hash of the key in buckets that follow the row count;
rows alike in all columns are counted first and expanded last, in bounded
pieces, so no repeated row or key fills a task.

Defined cases: a null key is the key '' (all such rows go to one shard, as any
key's rows do); a null text has 0 bytes and the CRC of no bytes; repeated rows
get one slot each, ties between equal rows are interchangeable; an empty table
gives no rows; only doc_id and text are read by the query, ``place`` keeps all
columns and replaces region, rack and shard if they are there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.common import cut, table
from tapeworks.llm.registry import query

#: Rows (distinct ones) that a numbering bucket of one group should hold, bits of
#: the smallest number of buckets, and copies that are expanded together.
BUCKET_ROWS = 1 << 15
LEAST_BITS = 8
COPIES = 1 << 16
HEX = 13  # hexadecimal digits of a draw: 52 bits are exact in a double


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    grant: int
    weight: float


@dataclass(frozen=True)
class Tree:
    """Weights by region, rack, shard and grant; shards are numbered from 0."""

    leaves: tuple[Leaf, ...]

    def __post_init__(self):
        if not self.leaves or any(x.weight <= 0 for x in self.leaves):
            raise ValueError("a tree has leaves, and their weights are above 0")
        homes = {(x.shard, x.region, x.rack) for x in self.leaves}
        if len(homes) != len({h[0] for h in homes}) or len({h[2]: h[1] for h in homes}) != len({h[1:] for h in homes}):
            raise ValueError("a shard has one rack, and a rack one region")

    @staticmethod
    def even(regions: int, racks: int, shards: int, weight: float = 1.0) -> Tree:
        """``racks`` a region and ``shards`` a rack, all of one founding grant."""
        n = regions * racks * shards
        return Tree(tuple(Leaf(s // (racks * shards), s // shards, s, 0, weight) for s in range(n)))

    def _next(self) -> tuple[int, int]:
        return max(x.shard for x in self.leaves) + 1, max(x.grant for x in self.leaves) + 1

    def added(self, region: int, rack: int, weight: float = 1.0) -> Tree:
        """One more shard: only rows that go to it move."""
        shard, grant = self._next()
        return Tree((*self.leaves, Leaf(region, rack, shard, grant, weight)))

    def raised(self, shard: int, by: float) -> Tree:
        """A shard's weight rises: only rows that go to it move."""
        home = next(x for x in self.leaves if x.shard == shard)
        return Tree((*self.leaves, Leaf(home.region, home.rack, shard, self._next()[1], by)))

    def lowered(self, shard: int, part: float) -> Tree:
        """A shard keeps ``part`` of its weight (0: it leaves): rows move out of
        its region, and within it, but none moves between other regions."""
        kept = (Leaf(x.region, x.rack, x.shard, x.grant, x.weight * (part if x.shard == shard else 1)) for x in self.leaves)
        return Tree(tuple(x for x in kept if x.weight > 0))

    def levels(self) -> list[list[tuple[str, str, float]]]:
        """(parent, child, weight) of each level.  Names: a region is
        'grant/region', below it 'grant/region/rack' and so on."""
        out = []
        for depth in (1, 2, 3):
            total: dict[tuple[str, str], float] = {}
            for x in self.leaves:
                path = [str(x.grant), str(x.region), str(x.rack), str(x.shard)]
                at = ("" if depth == 1 else "/".join(path[:depth]), "/".join(path[: depth + 1]))
                total[at] = total.get(at, 0.0) + x.weight
            out.append([(p, c, w) for (p, c), w in sorted(total.items())])
        return out


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def draw(key: Column, name: Column) -> Column:
    """A hash of (key, name) as a number in (0, 1)."""
    digits = F.substring(F.md5(F.concat(key, F.lit("@"), name).cast("binary")), 1, HEX)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**HEX)


def _winner(key: Column, children: Column) -> Column:
    return F.array_min(F.transform(children, lambda c: F.struct((-F.log(draw(key, c["name"])) / c["weight"]).alias("time"), c["name"].alias("name"))))["name"]


def path_of(key: Column, tree: Tree) -> Column:
    """'grant/region/rack/shard' of the shard a key descends to."""
    at: Column | None = None
    for level in tree.levels():
        by: dict[str, list[Column]] = {}
        for parent, child, weight in level:
            by.setdefault(parent, []).append(F.struct(F.lit(child).alias("name"), F.lit(float(weight)).alias("weight")))
        lists = F.create_map(*[x for p, c in by.items() for x in (F.lit(p), F.array(*c))])
        at = _winner(key, F.element_at(lists, F.lit("") if at is None else at))
    return at


def place(df: DataFrame, key: str, tree: Tree) -> DataFrame:
    """All rows and columns, with region, rack and shard (int)."""
    path = F.split(path_of(key_text(F.col(key)), tree), "/")
    return df.withColumn("_path", path).withColumns({c: F.col("_path")[i + 1].cast("int") for i, c in enumerate(("region", "rack", "shard"))}).drop("_path")


def numbered(df: DataFrame, group: str, key: str) -> DataFrame:
    """All rows with ``slot``: gapless numbers from 0 within ``group``, in order
    of a hash of ``key``, then of all columns.  Equal rows travel as one with
    their count; buckets of the hash are counted, summed up and numbered apart."""
    alike = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    alike = cut(alike.withColumn("_h", F.substring(F.md5(key_text(F.col(key)).cast("binary")), 1, HEX)))
    n, most = alike.agg(F.count("*"), F.max("_n")).first()
    bits = min(20, max(LEAST_BITS, (n // BUCKET_ROWS).bit_length()))
    rows = alike.withColumn("_bucket", F.shiftright(F.conv(F.substring("_h", 1, 5), 16, 10).cast("int"), 20 - bits))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(group, "_bucket").agg(F.sum("_n").alias("_k"))
    order = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_k").over(order), F.lit(0)).alias("_base"))
    rows = rows.join(sums, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    inside = Window.partitionBy(group, "_bucket").orderBy("_h", *df.columns).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_from", F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    rows = rows.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / COPIES))))
    if n and most > COPIES:
        rows = rows.repartition("_from", "_piece")
    last = F.least(F.col("_n"), (F.col("_piece") + 1) * COPIES) - 1
    return rows.withColumn("_i", F.explode(F.sequence(F.col("_piece") * COPIES, last))).select(*df.columns, (F.col("_from") + F.col("_i")).alias("slot"))


#: Two regions of two racks of two shards; the ninth shard joins the first rack.
TREE = Tree.even(2, 2, 2)
GROWN = TREE.added(0, 0)


def _race(step: str, source: str, level: list[tuple[str, str, float]]) -> str:
    values = ", ".join(f"('{p}', '{c}', {w!r})" for p, c, w in level)
    u = f"(CAST('0x' || substr(md5(k || '@' || name), 1, {HEX}) AS BIGINT) + 0.5) / {float(16**HEX)!r}"
    return f"{step} AS (SELECT k, arg_min(name, -ln({u}) / weight) AS node FROM {source} JOIN (VALUES {values}) v(parent, name, weight) ON node = parent GROUP BY k)"


def _descent(name: str, tree: Tree) -> str:
    one, two, three = tree.levels()
    return ", ".join([_race(f"{name}1", "(SELECT k, '' AS node FROM keys)", one), _race(f"{name}2", f"{name}1", two), _race(f"{name}3", f"{name}2", three)])


SQL = f"""
WITH RECURSIVE t(i, c, n) AS (SELECT i, i, 0 FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n + 1 FROM t WHERE n < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE n = 8),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, k, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size,
  CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, x: xor(tab[CAST(xor(a, x) & 255 AS BIGINT) + 1], a >> 8)), 4294967295) AS BIGINT) AS text_crc32 FROM d, crc),
keys AS (SELECT DISTINCT k FROM d), {_descent("now", TREE)}, {_descent("then_", GROWN)},
s AS (SELECT doc_id, size, text_crc32, CAST(split_part(n.node, '/', 4) AS INTEGER) AS shard, CAST(split_part(g.node, '/', 4) AS INTEGER) AS grown_shard, CAST(split_part(n.node, '/', 2) AS INTEGER) AS region, CAST(split_part(n.node, '/', 3) AS INTEGER) AS rack, k
  FROM b JOIN now3 n USING (k) JOIN then_3 g USING (k))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k), 1, {HEX}), doc_id, size, text_crc32) - 1 AS slot, grown_shard, region, rack FROM s
"""


@query("op11_hash_tree", SQL)
def op11_hash_tree(spark, sf):
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    docs = table(spark, sf, "documents").select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    grown = place(docs, "doc_id", GROWN).select(*docs.columns, F.col("shard").alias("grown_shard"))
    out = numbered(place(grown, "doc_id", TREE), "shard", "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")
