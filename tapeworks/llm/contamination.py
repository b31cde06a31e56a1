"""Benchmark decontamination over a distributed positional inverted index.

``Index.build`` stores the corpus's postings (term, document, position) of every
term that a test item uses, sorted by term within each shard, and a row per
document with its length; terms of no item can't be part of a match.
``phrases`` finds every occurrence of the items' windows:

1. terms get their corpus frequency; each window names its two rarest places;
2. the two places' posting lists are shifted by their offsets in the item and
   intersected: what is left are diagonals (item, document, shift), one for a
   whole passage and not one for each of its windows;
3. the item's other terms are looked up along the diagonals; unbroken runs as
   long as a window are the exact phrase matches.

``proximity`` returns places where all terms of an item lie within so many words
in any order.  All of it is DataFrame work; joins carry rows of rare terms or of
candidate documents only.  Nothing is broadcast by hand: stored tables let Spark
compare real file sizes with its own threshold.

Defined cases: null or empty text has no words (n_words 0, no hits); null or
empty items have no windows and never match; equal items each count; rows that
repeat a doc_id are searched on their own; a null item_id is listed as the empty
string; an empty corpus gives no rows, an empty benchmark no hits; other columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.common import ascii_lower, stored, table
from tapeworks.llm.registry import query

BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
RARE = 2  # lists that are intersected before the others are looked up
LENGTH = -1  # the term of a document's length row


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BREAKS), "")


@dataclass
class Index:
    """postings (term, d, pos) and lengths (d, doc_id, n_words) of a corpus, and
    the items (i, item_id, n) with their places (i, at, term, freq)."""

    postings: DataFrame
    lengths: DataFrame
    items: DataFrame
    places: DataFrame

    @staticmethod
    def build(docs: DataFrame, benchmark: DataFrame) -> Index:
        items = stored(
            benchmark.select(F.monotonically_increasing_id().alias("i"), F.col("item_id").cast("string").alias("item_id"), F.transform(words(F.col("text")), ascii_lower).alias("w")), "items"
        )
        spelled = items.select("i", F.posexplode("w").alias("at", "word"))
        vocabulary = stored(spelled.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "vocabulary")
        lexicon = vocabulary.union(docs.sparkSession.sql(f"SELECT '' AS word, CAST({LENGTH} AS BIGINT) AS term"))
        text = docs.select(F.monotonically_increasing_id().alias("d"), F.col("doc_id").alias("doc_id"), F.concat(words(F.col("text")), F.array(F.lit(""))).alias("w"))
        tokens = text.select("d", "doc_id", F.posexplode("w").alias("pos", "raw")).withColumn("word", ascii_lower(F.col("raw")))
        rows = tokens.join(lexicon, "word").select("term", "d", "pos", F.when(F.col("term") == LENGTH, F.col("doc_id")).alias("doc_id"))
        index = stored(rows.sortWithinPartitions("term"), "postings")
        postings = index.where(F.col("term") >= 0).select("term", "d", "pos")
        freq = postings.groupBy("term").agg(F.count("*").alias("freq"))
        places = spelled.join(vocabulary, "word").join(freq, "term", "left").select("i", "at", "term", F.coalesce("freq", F.lit(0)).alias("freq"))
        return Index(
            postings,
            index.where(F.col("term") == LENGTH).select("d", "doc_id", F.col("pos").cast("bigint").alias("n_words")),
            items.select("i", "item_id", F.size("w").alias("n")),
            stored(places, "places"),
        )

    def rare_pairs(self, window: int) -> DataFrame:
        """(i, first, second): the rarest places of each window; second is null in
        windows of one word.  A window with a term the corpus lacks is left out."""
        ahead = Window.partitionBy("i").orderBy("at").rowsBetween(0, window - 1)
        span = self.places.join(self.items, "i").withColumn("size", F.least(F.lit(window), F.col("n")))
        ranked = span.withColumn("r", F.array_sort(F.collect_list(F.struct("freq", "at")).over(ahead))).where(F.col("at") + F.col("size") <= F.col("n"))
        ranked = ranked.where(F.col("r")[0]["freq"] > 0)
        return ranked.select("i", F.col("r")[0]["at"].alias("first"), F.when(F.size("r") > 1, F.try_element_at("r", F.lit(2))["at"]).alias("second")).distinct()

    def shifted(self, wanted: DataFrame, place: str) -> DataFrame:
        """The posting lists of the places in column ``place``, moved to where the
        item would start: wanted's columns with d and shift."""
        at = self.places.select(F.col("i").alias("_i"), F.col("at").alias("_at"), "term")
        lists = wanted.join(at, (F.col("i") == F.col("_i")) & (F.col(place) == F.col("_at"))).drop("_i", "_at")
        return self.postings.join(lists, "term").withColumn("shift", F.col("pos") - F.col(place)).drop("term", "pos")

    def diagonals(self, window: int) -> DataFrame:
        pairs = stored(self.rare_pairs(window), "pairs")
        keys = ["i", "first", "second"]
        a = self.shifted(pairs, "first")
        b = self.shifted(pairs.where("second is not null"), "second")
        both = a.join(b, [*keys, "d", "shift"], "left_semi").union(a.where("second is null"))
        return stored(both.select("i", "d", "shift").distinct(), "diagonals")

    def phrases(self, window: int = WINDOW) -> DataFrame:
        """(i, d, shift, at, pos): every word of every occurrence of a window of
        ``window`` words (of the whole item, if it has fewer)."""
        lines = self.diagonals(window)
        near = self.postings.join(lines.select("d").distinct(), "d", "left_semi")
        probes = lines.join(self.places.select("i", "at", "term"), "i").withColumn("pos", F.col("shift") + F.col("at"))
        met = probes.join(near, ["d", "pos", "term"], "left_semi")
        line = Window.partitionBy("i", "d", "shift")
        met = met.withColumn("run", F.col("at") - F.row_number().over(line.orderBy("at")))
        met = met.withColumn("long", F.count("*").over(Window.partitionBy("i", "d", "shift", "run"))).join(self.items.select("i", "n"), "i")
        return met.where(F.col("long") >= F.least(F.lit(window), F.col("n"))).select("i", "d", "shift", "at", "pos")

    def proximity(self, within: int) -> DataFrame:
        """(i, d, pos): places from which all distinct terms of an item, at least
        one there, occur in ``within`` words.  Only documents with the item's
        rarest term are looked at; what a row gathers is at most ``within`` words."""
        terms = self.places.groupBy("i", "term").agg(F.min("freq").alias("freq"))
        need = terms.groupBy("i").agg(F.count("*").alias("need"), F.min_by("term", F.struct("freq", "term")).alias("rarest"))
        home = need.join(self.postings, F.col("rarest") == F.col("term")).select("i", "d", "need").distinct()
        lists = home.join(terms.select("i", "term"), "i").join(self.postings, ["d", "term"])
        ahead = Window.partitionBy("i", "d").orderBy("pos").rangeBetween(0, within - 1)
        return lists.withColumn("met", F.size(F.collect_set("term").over(ahead))).where("met = need").select("i", "d", "pos")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (hit words are
    at least ``percent`` % of all); one row per row of ``docs``."""
    index = Index.build(docs, benchmark)
    found = index.phrases(window).join(index.items.select("i", "item_id"), "i")
    # words first, then items: both are combined before the shuffle
    hit = found.select("d", "pos").distinct().groupBy("d").agg(F.count("*").alias("n_hit"))
    named = found.select("d", F.coalesce("item_id", F.lit("")).alias("item_id")).distinct().groupBy("d").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    out = index.lengths.join(hit.join(named, "d"), "d", "left")
    n = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id",
        "n_words",
        n.alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        ((n > 0) & (100 * n >= percent * F.col("n_words"))).alias("contaminated"),
    )


SQL = r"""
WITH b AS (SELECT row_number() OVER () AS i, coalesce(item_id::VARCHAR, '') AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s + 1 : s + least(13, len(w))], ' ') AS g FROM (SELECT *, unnest(range(greatest(len(w) - 12, 1))) AS s FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
dw AS (SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, s, n, item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT item_id)) AS ids FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op3_decontamination", SQL)
def op3_decontamination(spark, sf):
    return report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
