"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs whose union is a piece: the
pair with the highest score goes first, the leftmost of equals, and each merge
puts its two new neighbours on the agenda (stale entries are skipped).  What no
piece covers falls back to byte pieces.

No piece crosses from other characters into a space mark, and a character that
no longer piece has never merges, so a text is cut there and each distinct
segment is merged once (``Merger.known``, bounded).  All segments an Arrow batch
meets first are encoded by the sentencepiece library as well; a difference
raises.  ``check="texts"`` compares every whole text and its decoding instead.

Defined cases: null is read as empty; an empty text has the begin and end ids
only and decodes to the empty text; very long texts and segments take
n log n steps; repeated rows repeat; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import table
from tapeworks.llm.registry import query

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
KNOWN = 400_000  # segments that a worker remembers; then it starts anew
KNOWN_CHARS = 64  # longer segments aren't remembered
BATCH_CHARS = 1 << 20
SHORT = 48  # symbols up to which a flat agenda beats a heap
NEVER = float("inf")


class Merger:
    """A vocabulary read through the library, and the agenda over it."""

    def __init__(self, path: str):
        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.names = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        self.bytes = {int(s[3:5], 16): i for i, s in enumerate(self.names) if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        usual = [i for i in range(len(self.names)) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.ids = {self.names[i]: i for i in usual}
        self.score = {self.names[i]: lib.get_score(i) for i in usual}
        if any(SPACE in s.lstrip(SPACE) or "\n" in s for s in self.ids):
            raise ValueError("a piece crosses into a space mark or line end: texts can't be cut there")
        self.cost = {s: -v for s, v in self.score.items()}
        joined = {c for s in self.ids if len(s) > 1 for c in s} - {SPACE}
        inside = "".join(sorted(map(re.escape, joined)))
        # marks with the characters after them; runs without a mark; single characters that never merge
        self.segments = re.compile(f"{SPACE}+[{inside}]*|[{inside}]+|.", re.S).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.text_of = {i: s.replace(SPACE, " ") for s, i in self.ids.items()}

    def cut(self, text: str) -> list[str]:
        """Segments of a text, its first mark included.  A word without its mark
        stands for mark and word: most texts need no more than a split."""
        if not text:
            return []
        words = text.replace("\n", " \n").split(" ")
        if "" not in words and SPACE not in text and "\0" not in text and words[0][0] != "\n":
            return words
        # a segment without a mark is told apart by a leading line end, as in the short way
        return [s[1:] if s[0] == SPACE and len(s) > 1 and s[1] not in "\0\n" + SPACE else "\0" + s for s in self.segments(SPACE + text.replace(" ", SPACE))]

    def whole(self, key: str) -> str:
        """The segment that a key of ``cut`` stands for."""
        return key if key[0] == "\n" else key[1:] if key[0] == "\0" else SPACE + key

    def merge(self, text: str) -> tuple[int, ...]:
        """Ids of one segment."""
        sym = list(text)
        n = len(sym)
        if n <= SHORT:
            return self._ids(self._merge_short(sym))
        score = self.score
        agenda = [(-score[p], i, i + 1, p) for i in range(n - 1) if (p := sym[i] + sym[i + 1]) in score]
        heapify(agenda)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while agenda:
            _, i, j, p = heappop(agenda)
            if not sym[i] or not sym[j] or len(sym[i]) + len(sym[j]) != len(p):
                continue
            sym[i], sym[j] = p, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := p + sym[k]) in score:
                    heappush(agenda, (-score[q], i, k, q))
            h = before[i]
            if h >= 0 and (q := sym[h] + p) in score:
                heappush(agenda, (-score[q], h, i, q))
        return self._ids(sym)

    def _merge_short(self, sym: list[str]) -> list[str]:
        """The same order of merges for few symbols: the agenda is a flat list of
        negated scores by place, whose first minimum is next."""
        cost = self.cost.get
        agenda = [cost(a + b, NEVER) for a, b in zip(sym, sym[1:])]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)
            p = sym[i] = sym[i] + sym.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = cost(sym[i - 1] + p, NEVER)
            if i < len(agenda):
                agenda[i] = cost(p + sym[i + 1], NEVER)
        return sym

    def _ids(self, sym: list[str]) -> tuple[int, ...]:
        out: list[int] = []
        for s in sym:
            if s:
                i = self.ids.get(s)
                out.extend([i] if i is not None else [self.bytes.get(b, self.unk) for b in s.encode()] if self.bytes else [self.unk])
        return tuple(out)

    def learn(self, segments: set[str], check: bool) -> dict[str, tuple[int, ...]]:
        """Ids of segments that aren't known yet."""
        new = [s for s in segments if s not in self.known]
        got = {s: self.merge(self.whole(s)) for s in new}
        if check and new:
            # the library puts a space mark before a text: it stands for the segment's own first mark, or is cut off
            # behind a character that never merges
            skip = len(self.merge(SPACE)) + len(self.merge("\n"))
            full = [self.whole(s) for s in new]
            begun = [s[0] == SPACE and len(s) > 1 for s in full]
            theirs = self.lib.encode([s[1:] if b else "\n" + s for s, b in zip(full, begun)], num_threads=1)
            for s, key, b, t in zip(full, new, begun, theirs):
                if tuple(t if b else t[skip:]) != got[key]:
                    raise AssertionError(f"sentencepiece encodes {s!r} as {t}, the agenda as {got[key]}")
        return got

    def encode(self, texts: list[str], check: str | None) -> list[list[int]]:
        parts = [self.cut(t) for t in texts]
        if len(self.known) > KNOWN:
            self.known = {}
        fresh = self.learn({s for p in parts for s in p}, check == "segments")
        self.known.update(fresh)
        get = self.known.__getitem__
        begin, end = (self.bos,), (self.eos,)
        out = [list(chain(begin, *map(get, p), end)) for p in parts]
        for s in fresh:
            if len(s) > KNOWN_CHARS:
                del self.known[s]
        if check == "texts":
            theirs = self.lib.encode(texts, add_bos=True, add_eos=True, num_threads=1)
            for t, a, b in zip(texts, out, theirs):
                if a != b or self.decode(a) != self.lib.decode(b):
                    raise AssertionError(f"sentencepiece differs on {t[:200]!r}")
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks become spaces but for a first one, runs of byte
        pieces are read as UTF-8 (a byte that doesn't fit becomes U+FFFD)."""
        text_of, byte_of = self.text_of, self.byte_of
        out: list[str] = []
        held = bytearray()
        text_of, byte_of = self.text_of.get, self.byte_of.get
        bare = True  # nothing was written: a first mark is dropped
        for i in ids:
            s = text_of(i)
            if s is None and (b := byte_of(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(utf8(held))
                held.clear()
                bare = False
            if s is None:  # unknown, or a control id that has no text
                if i == self.unk:
                    out.append(self.lib.decode([i]))
                    bare = False
                continue
            if bare:
                s, bare = s.removeprefix(" "), False
            out.append(s)
        if held:
            out.append(utf8(held))
        return "".join(out)


def utf8(data: bytearray) -> str:
    """Valid sequences as characters, any other byte as one U+FFFD each."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    """One for each worker process and vocabulary."""
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def slices(values: list, limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, v in enumerate(values):
        if size and size + len(v) > limit:
            yield at, i
            at, size = i, 0
        size += len(v)
    if at < len(values):
        yield at, len(values)


def encode(docs: DataFrame, path: str, check: str | None = "segments") -> DataFrame:
    """doc_id, ids (array<int> with begin and end), decoded (string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in slices(texts):
                ids = m.encode(texts[i:j], check)
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(ids, pa.list_(pa.int32())), pa.array(map(m.decode, ids), pa.string())], names=["doc_id", "ids", "decoded"])

    return _input(docs).mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def digests(docs: DataFrame, path: str, check: str | None = "segments", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of ids and decoded text: ``encode`` reduced
    in the same pass, so that ids needn't leave the worker unless asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in slices(texts):
                got = [np.array(x, "<i4") for x in m.encode(texts[i:j], check)]
                cols = [
                    b.column(0).slice(i, j - i),
                    pa.array(map(len, got), pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in got], pa.string()),
                    pa.array([hashlib.sha256(m.decode(x.tolist()).encode()).hexdigest() for x in got], pa.string()),
                ]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(np.cumsum([0, *map(len, got)], dtype=np.int32), np.concatenate(got)))
                yield pa.record_batch(cols, names=names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    return _input(docs).mapInArrow(run, schema)


@query("op1_sentencepiece")
def op1_sentencepiece(spark, sf):
    return digests(table(spark, sf, "documents"), public_tokenizers.path(MODEL))
