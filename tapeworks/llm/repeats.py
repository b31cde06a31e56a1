"""Quality rules with a suffix-array repetition rule.

The words of all texts of a batch form one sequence whose suffixes are sorted by
prefix doubling with the text as the first key, so suffixes never leave their
text.  Neighbours in that order give the longest common prefixes; the
longest-common-prefix intervals give each text's maximal repeated substrings
(runs of words that can't be extended on either side and keep all their
occurrences).  The union of their spans is every word i with
``max(lcp[i], lcp[i + 1]) >= min_words`` covering it, since each repeated run lies
in a maximal one.  A text is rejected when the covered fraction of its words, or
its longest repeat, is over the limit.

Everything is one pass over the documents, no shuffle; a batch is cut by bytes,
so memory follows the longest text, not the table.

Defined cases: null or empty text has no words, all counts are 0 and the base
rule (fewer than 10 words) fails it; repeated rows and ties are judged alike; an
empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import table
from tapeworks.llm.registry import query

MIN_WORDS = 8  # shortest repeat, in words, that counts
MAX_COVERED = 0.2  # of the words may lie in repeats
MAX_LONGEST = 50  # words that the longest repeat may have
BATCH_BYTES = 2 << 20
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"

_symbol = np.zeros(256, np.int64)
_symbol[np.frombuffer(SYMBOLS, np.uint8)] = 1
_letter = np.ones(256, np.int64)  # first bytes of code points that aren't spaces
_letter[0x80:0xC0] = 0
_letter[np.frombuffer(SPACES, np.uint8)] = 0


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Dense ids (from 1) of all words, and each text's number of words."""
    ids: dict[bytes, int] = defaultdict(count(1).__next__)
    parts = [t.split() for t in texts]
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.fromiter((i for p in parts for i in map(ids.__getitem__, p)), np.int64, int(n.sum())), n


class Suffixes:
    """Suffix order of many short sequences at once.

    ``levels[j]`` has for each place the rank of its first 2**j words (equal
    ranks: equal words, the text's end included); only suffixes that still tie
    are ranked again."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        n = len(words)
        self.n, self.end = n, np.repeat(np.cumsum(sizes), sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        key = owner * (int(words.max(initial=0)) + 1) + words
        self.levels: list[np.ndarray] = []
        self.order = np.argsort(key, kind="stable")
        rank, tied = self._ranks(self.order, key[self.order])
        self.levels.append(rank)
        k = 1
        while tied.size:
            nxt = np.minimum(tied + k, n - 1)
            second = np.where(tied + k < self.end[tied], rank[nxt] + 1, 0)
            sort = np.lexsort((second, rank[tied]))
            moved = tied[sort]
            a, b = rank[moved], second[sort]
            # places of a tied class are a .. a + size - 1 in the order
            new = np.ones(len(moved), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            group = np.ones(len(moved), bool)
            group[1:] = a[1:] != a[:-1]
            idx = np.arange(len(moved))
            g0 = np.maximum.accumulate(np.where(group, idx, 0))
            c0 = np.maximum.accumulate(np.where(new, idx, 0))
            fresh = a + (c0 - g0)
            rank = rank.copy()
            rank[moved] = fresh
            self.order[a + (idx - g0)] = moved
            size = np.bincount(np.cumsum(new) - 1)
            tied = moved[np.repeat(size > 1, size)]
            self.levels.append(rank)
            k *= 2

    @staticmethod
    def _ranks(order: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each place (its class's first place in the order), and the
        places whose class has others."""
        n = len(order)
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = first
        size = np.bincount(np.cumsum(new) - 1) if n else np.zeros(0, np.int64)
        return rank, order[np.repeat(size > 1, size)]

    def lcp(self) -> np.ndarray:
        """Common words of each suffix in order and the one before it (0 at 0).
        A pair that ties at level j shares 2**j words or a whole short suffix;
        ranks with a text's end differ from all others of another length."""
        n = self.n
        out = np.zeros(n, np.int64)
        if n < 2:
            return out
        at = np.nonzero(self.levels[0][self.order[1:]] == self.levels[0][self.order[:-1]])[0] + 1
        i, j = self.order[at].copy(), self.order[at - 1].copy()
        for lev in range(len(self.levels) - 1, -1, -1):
            k, rank = 1 << lev, self.levels[lev]
            ok = (i < self.end[np.minimum(i, n - 1)]) & (j < self.end[np.minimum(j, n - 1)])
            inside = (i + k <= self.end[self.order[at]]) & (j + k <= self.end[self.order[at - 1]])
            same = ok & inside & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)])
            i, j = i + k * same, j + k * same
            out[at] += k * same
        return out


def covered(starts: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Marks the union of the spans start .. start + length - 1."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + length, -1)
    return np.cumsum(mark[:-1]) > 0


def maximal_repeats(words: np.ndarray, order: np.ndarray, lcp: np.ndarray, start: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
    """(length, from, to) of each longest-common-prefix interval of at least
    ``min_words`` whose occurrences order[from..to] are preceded by more than
    one word (or a text's start): the maximal repeated substrings."""
    out: list[tuple[int, int, int]] = []
    stack: list[list[int]] = []  # length, left end, word before (-2: several)

    def before(p: int) -> int:
        return -2 if start[p] == p else int(words[p - 1])

    near = np.nonzero(lcp >= min_words)[0]
    last = -1
    for r in near.tolist():
        if r != last + 1:
            while stack:
                ln, lb, w = stack.pop()
                if w == -2:
                    out.append((ln, lb, last))
                if stack and stack[-1][2] != w:
                    stack[-1][2] = -2
        v, lb = int(lcp[r]), r - 1
        w = before(int(order[r - 1]))
        while stack and stack[-1][0] > v:
            ln, lb, sw = stack.pop()
            if sw == -2:
                out.append((ln, lb, r - 1))
            if stack and stack[-1][2] != sw:
                stack[-1][2] = -2
            w = sw if sw == w else -2
        mine = before(int(order[r]))
        if stack and stack[-1][0] == v:
            if stack[-1][2] != mine or w != stack[-1][2]:
                stack[-1][2] = -2
        else:
            stack.append([v, lb, mine if mine == w else -2])
        last = r
    while stack:
        ln, lb, w = stack.pop()
        if w == -2:
            out.append((ln, lb, last))
        if stack and stack[-1][2] != w:
            stack[-1][2] = -2
    return out


def dup_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line.strip(SPACES):
            if line in seen:
                n += 1
            else:
                seen.add(line)
    return n


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]


def measure(texts: list[bytes], min_words: int = MIN_WORDS) -> dict[str, np.ndarray]:
    """The counts of ``NAMES`` for each text."""
    words, n = word_ids(texts)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    raw = np.frombuffer(b"".join(texts), np.uint8)

    def per_text(weight: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(weight[raw], dtype=np.int64)))
        return np.diff(total[np.concatenate(([0], ends))])

    out = {"n_words": n, "word_chars": per_text(_letter), "n_symbols": per_text(_symbol), "n_dup_lines": np.array([dup_lines(t) for t in texts], np.int64)}
    total = len(words)
    edge = np.concatenate(([0], np.cumsum(n)))
    if not total:
        return out | {k: np.zeros(len(texts), np.int64) for k in NAMES[4:]}
    s = Suffixes(words, n)
    lcp = s.lcp()
    best = np.maximum(lcp, np.concatenate((lcp[1:], [0])))  # longest repeat that starts there
    longest = np.empty(total, np.int64)
    longest[s.order] = best

    def inside(w: int, length) -> np.ndarray:
        at = np.nonzero(longest >= w)[0]
        hit = covered(at, length(at), total)
        c = np.concatenate(([0], np.cumsum(hit)))
        return np.diff(c[edge])

    out["n_repeat_words"] = inside(5, lambda at: np.full(len(at), 5))
    out["covered_words"] = inside(min_words, lambda at: longest[at])
    out["longest_repeat"] = np.array([longest[a:b].max() if b > a else 0 for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())], np.int64)
    return out


def pieces(values: list, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of a batch with about ``limit`` bytes each (a longer text alone)."""
    at = size = 0
    for i, v in enumerate(values):
        if size and size + len(v) > limit:
            yield at, i
            at, size = i, 0
        size += len(v)
    if at < len(values):
        yield at, len(values)


def judge(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """All rows and columns of ``docs`` with one more, ``_quality``: a struct of
    the counts, base_failed and kept."""
    schema = "doc_id bigint, " + ", ".join(f"{k} bigint" for k in NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for i, j in pieces(texts):
                got = measure(texts[i:j], min_words)
                yield pa.record_batch([b.column(0).slice(i, j - i), *[pa.array(got[k]) for k in NAMES]], names=["doc_id", *NAMES])

    q = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return verdict(q, max_covered, max_longest)


def verdict(q: DataFrame, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fine = (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return q.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def keep(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]
            for i, j in pieces(texts):
                g = measure(texts[i:j], min_words)
                ok = (g["n_words"] >= 10) & (100 * g["n_repeat_words"] <= 20 * g["n_words"]) & (g["covered_words"] <= max_covered * g["n_words"]) & (g["longest_repeat"] <= max_longest)
                yield b.slice(i, j - i).filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)


def _windows(n: int) -> str:
    """Repeated windows of n words (g), and the words they cover (c)."""
    return f"""g{n} AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, g) AS k FROM (SELECT doc_id, s, array_to_string(w[s + 1 : s + {n}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - {n - 1})) AS s FROM d WHERE len(w) >= {n}))) WHERE k > 1),
c{n} AS (SELECT doc_id, count(DISTINCT p) AS c{n} FROM (SELECT doc_id, unnest(range(s, s + {n})) AS p FROM g{n}) GROUP BY 1)"""


#: Words covered by repeats of at least MIN_WORDS are those in repeated windows of
#: that length; a repeat is over MAX_LONGEST where a longer window repeats.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
{_windows(5)}, {_windows(MIN_WORDS)}, {_windows(MAX_LONGEST + 1)},
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c5, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(c{MIN_WORDS}, 0) AS BIGINT) AS covered_words, coalesce(c{MAX_LONGEST + 1}, 0) > 0 AS long
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN c5 USING (doc_id) LEFT JOIN c{MIN_WORDS} USING (doc_id) LEFT JOIN c{MAX_LONGEST + 1} USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND covered_words <= {MAX_COVERED} * n_words AND NOT long AS kept, covered_words FROM f
"""


@query("op4_suffix_repetition", SQL)
def op4_suffix_repetition(spark, sf):
    got = judge(table(spark, sf, "documents"))
    return got.select("doc_id", *NAMES[:5], "base_failed", "kept", "covered_words")
