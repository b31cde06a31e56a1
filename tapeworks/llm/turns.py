"""Conversation repair by a grammar-compressed dynamic program.

A message becomes one symbol: its role's initial (s, u, a, other), in capitals if
the text is cut off, or X if it must go (blank, or role and text seen before).
Reading a symbol moves between four states (nothing yet, after s, u, a) at a
cost, so a symbol is a 4 x 4 matrix over (min, plus) whose entries carry the
cheapest edits as a rope; edits of equal cost are compared letter by letter,
which ropes do by their hashes.  (Two audits of one entry never are prefixes of
each other: the longer one would have more inserts and cost more.)  Re-Pair
replaces the most frequent neighbours of all sequences of a group of
conversations by rules; each rule's matrix is the product of its two parts,
computed once and used by all conversations.

Rows are range-partitioned by conversation and turn, so a conversation of any
length spans tasks.  One that lies within a task is solved there, its texts
travel once.  The others (the first and last of a task, and such above a chunk)
become chunks of bounded rows and bytes with a matrix each; the matrices of a
conversation are multiplied in order, and chunks are repaired apart.  What meets
in one task of a conversation is its audit and its SHA-256 (one value each), the
latter streamed.  A duplicate is marked by a row that sorts before it.

Defined cases: nulls in role and text are one space, a null conv_id is one
conversation, null turns come first; equal turns are ordered by role, then by the
first 32 characters of the text, then by hash, repeated rows are duplicates; a
conversation without rows (``present``) has zeros, an empty audit and the hash of
nothing; roles keep their text unless changed, so 'usr' counts as u; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.common import stored, table
from tapeworks.llm.registry import query

CHUNK_ROWS = 1024
CHUNK_BYTES = 64 << 10
GROUP = 2000  # conversations (or their CHUNK_ROWS) that share a grammar
MIN_USES = 3  # a pair used less often gets no rule

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
TARGET = {START: "user", SYSTEM: "user", ASSISTANT: "user", USER: "assistant"}
LEGAL = ("su", "ua", "au")


# ropes


class Rope:
    """An audit as a tree of shared parts; equal hashes and sizes count as equal."""

    __slots__ = ("left", "right", "text", "size", "hash")
    MOD, BASE, LEAF = (1 << 61) - 1, 911382323, 48
    powers: dict[int, int] = {}

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if text is not None:
            self.size, h = len(text), 0
            for c in text.encode():
                h = (h * self.BASE + c + 1) % self.MOD
            self.hash = h
        else:
            self.size = left.size + right.size
            p = self.powers.get(right.size)
            if p is None:
                p = self.powers[right.size] = pow(self.BASE, right.size, self.MOD)
            self.hash = (left.hash * p + right.hash) % self.MOD

    def __add__(self, other: Rope) -> Rope:
        if not self.size or not other.size:
            return self if self.size else other
        if self.size + other.size <= self.LEAF:
            return Rope(str(self) + str(other))
        return Rope(None, self, other)

    def __str__(self) -> str:
        if self.text is not None:
            return self.text
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if x.text is not None:
                out.append(x.text)
            else:
                stack += (x.right, x.left)
        return "".join(out)

    def __lt__(self, other: Rope) -> bool:
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x is y or (x.size == y.size and x.hash == y.hash):
                continue
            if x.text is not None and y.text is not None:
                n = min(x.size, y.size)
                if x.text[:n] != y.text[:n]:
                    return x.text < y.text
                if x.size > n:
                    a.append(Rope(x.text[n:]))
                elif y.size > n:
                    b.append(Rope(y.text[n:]))
            elif y.text is not None or (x.text is None and x.size >= y.size):
                a += (x.right, x.left)
                b.append(y)
            else:
                b += (y.right, y.left)
                a.append(x)
        return not a and bool(b)


EMPTY = Rope("")
Entry = tuple[int, Rope]
Matrix = list[list[Entry | None]]


# matrices


def best(found: list[Entry]) -> Entry | None:
    """The cheapest entry, ASCII-least among equals."""
    out = None
    for x in found:
        if out is None or x[0] < out[0] or (x[0] == out[0] and x[1] < out[1]):
            out = x
    return out


def through(row: list[Entry | None], m: Matrix) -> list[Entry | None]:
    """A row times a matrix."""
    out: list[Entry | None] = []
    for j in range(4):
        costs = [(row[k][0] + m[k][j][0], k) for k in range(4) if row[k] is not None and m[k][j] is not None]
        low = min(costs)[0] if costs else 0
        out.append(best([(c, row[k][1] + m[k][j][1]) for c, k in costs if c == low]))
    return out


def times(a: Matrix, b: Matrix) -> Matrix:
    return [through(row, b) for row in a]


def moves(steps: list[tuple[int, int, int, str]]) -> Matrix:
    """A matrix from (state, state, cost, letters)."""
    return [[best([(c, Rope(w)) for x, y, c, w in steps if (x, y) == (i, j)]) for j in range(4)] for i in range(4)]


UNIT = moves([(i, i, 0, "") for i in range(4)])
INSERTS = moves(
    [(i, i, 0, "") for i in range(4)]
    + [(i, USER, INSERT, "I") for i in (START, SYSTEM, ASSISTANT)]
    + [(USER, ASSISTANT, INSERT, "I")]
    + [(i, ASSISTANT, 2 * INSERT, "II") for i in (START, SYSTEM)]
)


def symbol_matrix(symbol: str) -> Matrix:
    """Any inserts, then the message itself."""
    steps = [(i, i, DELETE, "D") for i in range(4)]
    if symbol != "X":
        extra = CUT_OFF if symbol.isupper() else 0
        after = AFTER.get(symbol.lower())
        if after == SYSTEM:
            steps.append((START, SYSTEM, KEEP + extra, "K"))
        for i in range(4):
            to = AFTER[TARGET[i][0]]
            steps.append((i, to, REROLE + extra, "R"))
            if to == after:
                steps.append((i, to, KEEP + extra, "K"))
    return times(INSERTS, moves(steps))


SYMBOLS = "suaoSUAOX"
BASE_MATRICES = [symbol_matrix(c) for c in SYMBOLS]
CODE = {c: i for i, c in enumerate(SYMBOLS)}


# the grammar


def re_pair(sequences: list[list[int]], fresh: int, min_uses: int = MIN_USES) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Rules (rule k stands for symbol ``fresh`` + k) and the shortened sequences:
    the most frequent pair of neighbours becomes a rule until none is frequent."""
    sym: list[int] = []
    nxt: list[int] = []
    prv: list[int] = []
    heads = []
    for s in sequences:
        at = len(sym)
        heads.append(at if s else -1)
        sym += s
        prv += [-1, *range(at, at + len(s) - 1)][: len(s)]
        nxt += [*range(at + 1, at + len(s)), -1][: len(s)]
    where: dict[tuple[int, int], set[int]] = {}
    for i, j in enumerate(nxt):
        if j >= 0:
            where.setdefault((sym[i], sym[j]), set()).add(i)
    heap = [(-len(p), pair) for pair, p in where.items() if len(p) >= min_uses]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        n, pair = heapq.heappop(heap)
        now = len(where.get(pair, ()))
        if now != -n:
            if now >= min_uses:
                heapq.heappush(heap, (-now, pair))
            continue
        a, b = pair
        new = fresh + len(rules)
        rules.append(pair)
        touched = set()
        for i in sorted(where.pop(pair)):
            j = nxt[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # overlapped by the replacement before
            p, k = prv[i], nxt[j]
            if p >= 0:
                where.get((sym[p], a), set()).discard(p)
                where.setdefault((sym[p], new), set()).add(p)
                touched.add((sym[p], new))
            if k >= 0:
                where.get((b, sym[k]), set()).discard(j)
                where.setdefault((new, sym[k]), set()).add(i)
                touched.add((new, sym[k]))
                prv[k] = i
            sym[i], sym[j], nxt[i] = new, -1, k
        for t in sorted(touched):
            if len(where[t]) >= min_uses:
                heapq.heappush(heap, (-len(where[t]), t))
    out = []
    for at in heads:
        s = []
        while at >= 0:
            s.append(sym[at])
            at = nxt[at]
        out.append(s)
    return rules, out


def compressed(strings: list[str]) -> tuple[list[Matrix], list[list[int]]]:
    """Matrices of all symbols and rules, and each string's remaining symbols."""
    rules, rest = re_pair([[CODE[c] for c in s] for s in strings], len(SYMBOLS))
    matrices = list(BASE_MATRICES)
    for a, b in rules:
        matrices.append(times(matrices[a], matrices[b]))
    return matrices, rest


def finish(row: list[Entry | None]) -> Entry:
    """Last inserts, then the better of no message and an answered one."""
    row = through(row, INSERTS)
    return best([row[i] for i in (START, ASSISTANT) if row[i] is not None])


def solve(strings: list[str]) -> dict[str, tuple[int, str]]:
    """Cost and audit of each distinct symbol string."""
    distinct = sorted(set(strings))
    matrices, rest = compressed(distinct)
    out = {}
    for s, symbols in zip(distinct, rest):
        row = UNIT[START]
        for c in symbols:
            row = through(row, matrices[c])
        cost, audit = finish(row)
        out[s] = cost, str(audit)
    return out


def whole_matrices(strings: list[str]) -> dict[str, Matrix]:
    distinct = sorted(set(strings))
    matrices, rest = compressed(distinct)
    out = {}
    for s, symbols in zip(distinct, rest):
        m = UNIT
        for c in symbols:
            m = times(m, matrices[c])
        out[s] = m
    return out


def edited(audit: str, roles: list[str], texts: list[str], state: int = START) -> list[tuple[str, str]]:
    """Role and text of the messages that the edits leave."""
    out, at = [], 0
    for op in audit:
        if op == "I":
            out.append((TARGET[state], ""))
        else:
            role, text = roles[at], texts[at]
            at += 1
            if op == "D":
                continue
            out.append((TARGET[state] if op == "R" else role, text))
        state = AFTER[out[-1][0][0]]
    return out


# rows


def damaged(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows left of a fifth-damaged table, and the conv_id of dropped ones."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    d = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_m"))
    m = F.col("_m")
    rows = d.where(m != 0).select(
        "conv_id", "turn", F.when(m == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(m == 1, "").when(m == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(m == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return rows.drop("_copy"), d.where(m == 0).select("conv_id")


ORDER = ["conv_id", "rank", "t", "role", "head", "d1", "d2", "kind", "id"]
GONE, MARK, ROW = range(3)  # kinds: a conversation that is there, 'seen before', a message


def _ordered(rows: DataFrame, present: DataFrame | None) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    r = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    r = r.select(
        "conv_id", F.when(F.col("turn").isNull(), 1).otherwise(2).alias("rank"), F.coalesce("turn", F.lit(0)).cast("bigint").alias("t"), "role", F.substring("text", 1, 32).alias("head"),
        F.xxhash64("role", "text").alias("d1"), F.xxhash64("text", F.lit("again"), "role").alias("d2"), F.lit(ROW).alias("kind"), F.monotonically_increasing_id().alias("id"), "text",
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut_off"),
    )
    same = ["conv_id", "role", "head", "d1", "d2"]
    turns = r.where(~F.col("blank")).groupBy(*same, "rank", "t").agg(F.lit(1).alias("_one"))
    first = turns.groupBy(*same).agg(F.min(F.struct("rank", "t")).alias("_first"), F.count("*").alias("_k")).where("_k > 1")
    first = first.select(*[F.col(c).alias(f"_{c}") for c in same], "_first")
    on = F.col("conv_id").eqNullSafe(F.col("_conv_id"))
    for c in same[1:]:
        on = on & (F.col(c) == F.col(f"_{c}"))
    marks = turns.join(first, on).where(F.struct("rank", "t") > F.col("_first"))
    nothing = {"text": F.lit(None).cast("string"), "blank": F.lit(False), "cut_off": F.lit(False)}
    out = r.unionByName(marks.select(*ORDER[:7], F.lit(MARK).alias("kind"), F.lit(-1).cast("bigint").alias("id")).withColumns(nothing))
    if present is not None:
        zero = F.lit(0).cast("bigint")
        gone = present.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.lit(0).alias("rank"), zero.alias("t"), F.lit("").alias("role"), F.lit("").alias("head"), zero.alias("d1"), zero.alias("d2"), F.lit(GONE).alias("kind"), zero.alias("id"))
        out = out.unionByName(gone.distinct().withColumns(nothing))
    return out.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)


MESSAGES = "array<struct<role:string,text:string>>"
COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
RECORD = (
    "conv_id bigint, final boolean, part bigint, chunk bigint, symbols string, roles array<string>, texts array<string>, "
    + ", ".join(f"{c} bigint" for c in COUNTS)
    + f", lo bigint, hi bigint, first_key string, last_key string, first_initial string, last_initial string, cost bigint, audit string, repaired_sha256 string, messages {MESSAGES}"
)
FIELDS = [x.strip().split(" ")[0] for x in RECORD.split(", ")]


class Chunk:
    """The part of a conversation that is held."""

    def __init__(self, conv: int | None, part: int, chunk: int = 0, edge: bool = False):
        self.conv, self.part, self.chunk, self.edge = conv, part, chunk, edge
        self.symbols: list[str] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.n = dict.fromkeys(COUNTS, 0)
        self.lo = self.hi = self.first_key = self.last_key = self.first_initial = self.last_initial = None
        self.bytes = 0

    def add(self, kind: int, rank: int, t: int, role: str, key: str, text: str, blank: bool, cut_off: bool) -> None:
        if kind == GONE:
            return
        known = key == self.last_key
        if self.last_key is None:
            self.first_key = key if kind == ROW else ""
        self.last_key = key
        if kind == MARK:
            return
        initial = role[:1]
        if self.symbols:
            self.n["illegal"] += self.last_initial + initial not in LEGAL
        else:
            self.first_initial = initial
        self.last_initial = initial
        if rank == 2:
            self.n["turns"] += t != self.hi
            self.lo, self.hi = t if self.lo is None else self.lo, t
        symbol = "X"
        if blank:
            self.n["blank"] += 1
        elif known:
            self.n["duplicate"] += 1
        else:
            symbol = initial if initial in AFTER else "o"
            if cut_off:
                self.n["truncated"] += 1
                symbol = symbol.upper()
        self.symbols.append(symbol)
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(role) + len(text)

    def full(self) -> bool:
        return len(self.symbols) >= CHUNK_ROWS or self.bytes >= CHUNK_BYTES

    def record(self, final: bool, **more) -> dict:
        out = {
            "conv_id": self.conv, "final": final, "part": self.part, "chunk": self.chunk, **self.n, "lo": self.lo, "hi": self.hi, "first_key": self.first_key,
            "last_key": self.last_key, "first_initial": self.first_initial, "last_initial": self.last_initial,
        }
        return out | (more if final else {"symbols": "".join(self.symbols), "roles": self.roles, "texts": self.texts})


def _digest(items: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in items).encode()).hexdigest()


def _schema() -> pa.Schema:
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string()), MESSAGES: pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))}
    return pa.schema([(x.strip().split(" ")[0], kinds[x.strip().split(" ")[1]]) for x in RECORD.split(", ")])


def _cut(messages: bool):
    """One task: solves the conversations that lie within, cuts the others."""

    def solved(group: list[Chunk], rest: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        got = solve(["".join(c.symbols) for c in group]) if group else {}
        for c in group:
            cost, audit = got["".join(c.symbols)]
            items = edited(audit, c.roles, c.texts)
            rest.append(c.record(True, cost=cost, audit=audit, repaired_sha256=_digest(items), messages=[{"role": r, "text": t} for r, t in items] if messages else None))
        return pa.RecordBatch.from_pylist(rest, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, part = _schema(), TaskContext.get().partitionId()
        held: Chunk | None = None
        group: list[Chunk] = []
        rest: list[dict] = []
        size = 0
        for b in batches:
            d = b.to_pydict()
            for conv, rank, t, role, d1, d2, kind, text, blank, cut_off in zip(*(d[c] for c in ("conv_id", "rank", "t", "role", "d1", "d2", "kind", "text", "blank", "cut_off"))):
                if held is None or conv != held.conv:
                    if held is not None:
                        size += 1 + len(held.symbols)
                        (rest.append(held.record(False)) if held.edge else group.append(held))
                    held = Chunk(conv, part, edge=held is None)
                elif held.full():
                    size += len(held.symbols)
                    rest.append(held.record(False))
                    following = Chunk(conv, part, held.chunk + 1, True)
                    held = following
                held.add(kind, rank, t, role, f"{rank},{t},{d1},{d2}", text, blank, cut_off)
                if size >= GROUP:
                    yield solved(group, rest, schema)
                    group, rest, size = [], [], 0
        if held is not None:
            rest.append(held.record(False))
        if group or rest:
            yield solved(group, rest, schema)

    return run


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.to_pylist()
        for at in range(0, len(rows), 64):
            some = rows[at : at + 64]
            texts = [("X" + r["symbols"][1:]) if r["again"] else r["symbols"] for r in some]
            got = whole_matrices(texts)
            flat = [[x for row in got[t] for x in row] for t in texts]
            yield pa.record_batch(
                [pa.array([r[c] for r in some], pa.int64()) for c in ("conv_id", "part", "chunk")]
                + [pa.array([[x and x[0] for x in f] for f in flat], pa.list_(pa.int64())), pa.array([[x and str(x[1]) for x in f] for f in flat], pa.list_(pa.string()))],
                names=["conv_id", "part", "chunk", "costs", "audits"],
            )


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Multiplies the matrices of each conversation in order and emits the edits
    of every chunk on the cheapest way."""
    names = ["conv_id", "part", "chunk", "state", "cost", "audit"]
    kinds = [pa.int64()] * 5 + [pa.string()]
    conv: object = ()
    row: list = []
    ways: list = []

    def ended() -> Iterator[pa.RecordBatch]:
        ends = [(x[0] + y[0], x[1] + y[1], i, y) for i, x in enumerate(row) if x is not None for j in (START, ASSISTANT) if (y := INSERTS[i][j]) is not None]
        cost, audit = best([(e[0], e[1]) for e in ends])
        _, _, i, (more, letters) = next(e for e in ends if e[0] == cost and not e[1] < audit and not audit < e[1])
        out, way = [], ways[i]
        tail, extra = str(letters), more
        while way is not None:
            way, part, chunk, state, c, a = way
            out.append((conv, part, chunk, state, c + extra, a + tail))
            tail, extra = "", 0
        for at in range(0, len(out), 1024):
            yield pa.record_batch([pa.array(list(x), k) for x, k in zip(zip(*out[at : at + 1024]), kinds)], names=names)

    for b in batches:
        for r in b.to_pylist():
            if r["conv_id"] != conv:
                if row:
                    yield from ended()
                conv, row, ways = r["conv_id"], list(UNIT[START]), [None] * 4
            ropes = [a and Rope(a) if a is not None else None for a in r["audits"]]
            nxt, via = [], []
            for j in range(4):
                found = []
                for i in range(4):
                    c = r["costs"][4 * i + j]
                    if row[i] is not None and c is not None:
                        found.append((row[i][0] + c, row[i][1] + (ropes[4 * i + j] or EMPTY), i))
                top = best([f[:2] for f in found])
                nxt.append(top)
                i = next((f[2] for f in found if f[0] == top[0] and f[1] is top[1]), None) if top else None
                via.append(None if i is None else (ways[i], r["part"], r["chunk"], i, r["costs"][4 * i + j], r["audits"][4 * i + j]))
            row, ways = nxt, via
    if row:
        yield from ended()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            items = edited(r["audit"], r["roles"], r["texts"], r["state"])
            text = "\n".join(f"{x}:{t}" for x, t in items)
            if items and r["state"] != START:
                text = "\n" + text
            row = {"conv_id": r["conv_id"], "part": r["part"], "chunk": r["chunk"], "piece": text, "messages": [{"role": x, "text": t} for x, t in items]}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("chunk", pa.int64()), ("piece", pa.string()), ("messages", _schema().field("messages").type)]))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each conversation, streamed in order."""
    conv: object = ()
    h = None
    names = ["conv_id", "repaired_sha256"]
    for b in batches:
        for c, piece in zip(b.column("conv_id").to_pylist(), b.column("piece").to_pylist()):
            if c != conv:
                if h is not None:
                    yield pa.record_batch([pa.array([conv], pa.int64()), pa.array([h.hexdigest()])], names=names)
                conv, h = c, hashlib.sha256()
            h.update(piece.encode())
    if h is not None:
        yield pa.record_batch([pa.array([conv], pa.int64()), pa.array([h.hexdigest()])], names=names)


KEYS = ["conv_id", "part", "chunk"]
REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    on: Column | None = None
    for k in keys:
        same = a[k].eqNullSafe(b[k]) if k == "conv_id" else a[k] == b[k]
        on = same if on is None else on & same
    return a.join(b, on).drop(*[b[k] for k in keys])


def repair(rows: DataFrame, present: DataFrame | None = None, messages: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """One row of ``REPORT`` for each conversation of ``rows`` and ``present``;
    with ``messages`` also the repaired messages (conv_id, part, chunk, place,
    role, text; in that order), else None."""
    records = stored(_ordered(rows, present).drop("head", "id").mapInArrow(_cut(messages), RECORD), "turns")
    gap = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0)).cast("bigint").alias("gaps")
    done = records.where("final").select("conv_id", gap, *REPORT[2:])

    cut = records.where("NOT final").select(*KEYS, "symbols", *COUNTS, "lo", "hi", "first_key", "last_key", "first_initial", "last_initial")
    w = Window.partitionBy("conv_id").orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.last(c, ignorenulls=True).over(w)
    cut = cut.withColumns({"_key": before("last_key"), "_initial": before("last_initial"), "_turn": before("hi")})
    head = F.substring("symbols", 1, 1)
    cut = cut.withColumn("again", F.coalesce((F.col("first_key") == F.col("_key")) & (F.length("symbols") > 0), F.lit(False)))
    cut = cut.withColumn("_more", (F.col("again") & (head != "X")).cast("bigint"))
    crossed = F.coalesce(~F.concat("_initial", "first_initial").isin(*LEGAL), F.lit(False))
    total = cut.groupBy("conv_id").agg(
        F.sum("blank").alias("blank"), F.sum(F.col("duplicate") + F.col("_more")).alias("duplicate"),
        F.sum(F.col("truncated") - F.col("_more") * head.isin(*"SUAO").cast("bigint")).alias("truncated"), F.sum(F.col("illegal") + crossed.cast("bigint")).alias("illegal"),
        F.sum(F.col("turns") - F.coalesce((F.col("_turn") == F.col("lo")).cast("bigint"), F.lit(0))).alias("turns"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    key_types = "conv_id bigint, part bigint, chunk bigint"
    matrices = cut.select(*KEYS, "symbols", "again").mapInArrow(_matrices, f"{key_types}, costs array<bigint>, audits array<string>")
    ways = matrices.repartition("conv_id").sortWithinPartitions(*KEYS).mapInArrow(_chosen, f"{key_types}, state bigint, cost bigint, audit string")
    ways = stored(ways, "turn_edits")
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "chunk", "audit"))), lambda x: x["audit"]), "")
    costs = ways.groupBy("conv_id").agg(F.sum("cost").alias("cost"), audit.alias("audit"))
    texts = records.where("NOT final").select(*KEYS, "roles", "texts")
    pieces = _joined(texts, ways.select(*KEYS, "state", "audit"), KEYS).mapInArrow(_repaired, f"{key_types}, piece string, messages {MESSAGES}")
    hashes = pieces.select(*KEYS, "piece").repartition("conv_id").sortWithinPartitions(*KEYS).mapInArrow(_hashed, "conv_id bigint, repaired_sha256 string")
    spread = _joined(_joined(total, costs, ["conv_id"]), hashes, ["conv_id"]).select("conv_id", gap, *REPORT[2:])
    out = None
    if messages:
        both = records.where("final").select(*KEYS, "messages").unionByName(pieces.select(*KEYS, "messages"))
        out = both.select(*KEYS, F.posexplode("messages").alias("place", "_m")).select(*KEYS, "place", "_m.role", "_m.text")
    return done.unionByName(spread), out


@query("op12_conversation_repair")
def op12_conversation_repair(spark, sf):
    return repair(*damaged(table(spark, sf, "conversations")))[0]
