"""Hash tree, conversation repair and periodic runs against brute force, and
their defined cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tapeworks.llm import hashtree, periods, turns
from tapeworks.llm.hashtree import Tree

SF = "/root/testdata/sf0.001"
CLASH = "lang string, region int, rack int, shard string, slot int, _n int, _bucket int"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
TEXTS = [(1, "Alpha beta"), (2, None), (3, ""), (4, " \t\n "), (5, "same"), (5, "same"), (5, "same"), (None, "same"), (None, None), (8, LONG), (9, "Ä É ñ \x00 😀"), (10, "a " * 90)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "en", 1, 2, "s", 3, 4, 5) for r in TEXTS], f"doc_id bigint, text string, {CLASH}").repartition(3)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# hash tree


def homes(spark, tree, n=4000):
    return {r.k: (r.region, r.rack, r.shard) for r in hashtree.place(spark.range(n).withColumnRenamed("id", "k"), "k", tree).collect()}


def slow_home(key, tree):
    """Descends by sorting draws, apart from Spark."""
    at = ""
    for level in tree.levels():
        draws = []
        for parent, name, weight in level:
            if parent == at:
                u = (int(hashlib.md5(f"{key}@{name}".encode()).hexdigest()[: hashtree.HEX], 16) + 0.5) / 16.0**hashtree.HEX
                draws.append((-np.log(u) / weight, name))
        at = min(draws)[1]
    return tuple(int(x) for x in at.split("/")[1:])


def test_tree_descent_and_shares(spark):
    tree = Tree.even(2, 2, 2).raised(3, 3.0).added(1, 2, 2.0)
    got = homes(spark, tree)
    assert all(got[k] == slow_home(k, tree) for k in range(400))
    share = Counter(s for _, _, s in got.values())
    total = {}
    for x in tree.leaves:
        total[x.shard] = total.get(x.shard, 0) + x.weight
    for s, w in total.items():
        want = 4000 * w / sum(total.values())
        assert abs(share[s] - want) < 5 * want**0.5


def test_tree_moves_rows_only_where_weights_change(spark):
    tree = Tree.even(2, 2, 2)
    now = homes(spark, tree)
    for region, rack in ((0, 0), (1, 3), (1, 4), (2, 5)):
        more = homes(spark, tree.added(region, rack))
        moved = [k for k in now if now[k] != more[k]]
        assert moved and all(more[k] == (region, rack, 8) for k in moved)
        again = homes(spark, tree.added(region, rack).added(0, 0))
        assert all(again[k][2] == 9 for k in now if more[k] != again[k])
    raised = homes(spark, tree.raised(5, 0.5))
    assert all(raised[k][2] == 5 for k in now if now[k] != raised[k])
    lower = homes(spark, tree.lowered(5, 0.25))
    moved = [k for k in now if now[k] != lower[k]]
    assert moved and all(now[k][0] == 1 for k in moved)
    gone = homes(spark, tree.lowered(5, 0))
    assert 5 not in {h[2] for h in gone.values()} and all(now[k][0] == 1 for k in now if now[k] != gone[k])
    shift = Tree(tuple(hashtree.Leaf(x.region, x.rack, x.shard, 0, {0: 1.5, 1: 0.5}.get(x.shard, 1.0)) for x in tree.leaves))
    inside = homes(spark, shift)
    assert {(now[k][2], inside[k][2]) for k in now if now[k] != inside[k]} == {(1, 0)}
    with pytest.raises(ValueError):
        tree.added(1, 0)
    with pytest.raises(ValueError):
        Tree(())


def test_tree_query_cases(spark, odd, monkeypatch, tmp_path):
    placed = hashtree.place(odd, "doc_id", hashtree.TREE)
    assert set(placed.columns) == set(odd.columns) and placed.count() == len(TEXTS)
    assert len({(r.region, r.rack, r.shard) for r in placed.where("doc_id IS NULL").collect()}) == 1
    monkeypatch.setattr(hashtree, "COPIES", 2)
    (spark.createDataFrame([*TEXTS, *[(77, "copy")] * 9], "doc_id bigint, text string")).write.parquet(str(tmp_path / "documents.parquet"))
    got = hashtree.op11_hash_tree(spark, str(tmp_path)).collect()
    assert len(got) == len(TEXTS) + 9
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in [*TEXTS, *[(77, "copy")] * 9])
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert all(r.law == "key" and r.grown_shard in (r.shard, 8) for r in got)
    assert all((r.region, r.rack, r.shard) == slow_home("" if r.doc_id is None else r.doc_id, hashtree.TREE) for r in got)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert hashtree.numbered(hashtree.place(empty, "doc_id", hashtree.TREE), "shard", "doc_id").count() == 0


# conversation repair

SPACE = re.compile(r"[^\x20\x09-\x0D]")


def slow_damage(data):
    out, ids = [], set()
    for conv, turn, role, text in data:
        ids.add(conv)
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out, ids


def slow_audit(symbols):
    """Cheapest edits by a plain search over (message, roles so far), with the
    wanted form as a regular expression."""
    best = {(0, ""): (0, "")}
    for at in range(len(symbols) + 1):
        for _ in range(2):  # inserts
            for (i, form), (c, a) in list(best.items()):
                if i == at:
                    for x in "ua":
                        put(best, at, form + x, c + 5, a + "I")
        if at == len(symbols):
            break
        for (i, form), (c, a) in list(best.items()):
            if i != at:
                continue
            kind, extra = symbols[at].lower(), 5 * (symbols[at] in "SUAO")
            put(best, at + 1, form, c + 2, a + "D")
            if symbols[at] != "X":
                if kind in "sua":
                    put(best, at + 1, form + kind, c + extra, a + "K")
                for x in "ua":
                    put(best, at + 1, form + x, c + 1 + extra, a + "R")
    return min(v for (i, form), v in best.items() if i == len(symbols) and re.fullmatch("(s?(ua)+)?", form))


def put(best, at, form, cost, audit):
    if re.fullmatch("(s?(ua)*u?)?", form):
        short = form if len(form) < 2 else ("s" if form[0] == "s" else "") + ("u" if form[-1] == "u" else "ua" if form[-1] == "a" else "")
        best[at, short] = min(best.get((at, short), (10**9, "")), (cost, audit))


def slow_repair(data, ids):
    out = []
    for conv in ids:
        mine = sorted((r for r in data if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:32]))
        n, seen, symbols = Counter(), set(), ""
        for _, _, role, text in mine:
            words = SPACE.findall(text)
            if not words:
                n["blank"] += 1
                symbols += "X"
            elif (role, text) in seen:
                n["duplicate"] += 1
                symbols += "X"
            else:
                c = role[:1] if role[:1] in ("s", "u", "a") else "o"
                if words[-1] not in ".!?":
                    n["truncated"] += 1
                    c = c.upper()
                symbols += c
            seen.add((role, text))
        n["illegal"] = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        t = [r[1] for r in mine if r[1] is not None]
        cost, audit = slow_audit(symbols)
        kept, at, last = [], 0, ""
        for op in audit:
            if op == "I":
                kept.append(("assistant" if last == "u" else "user", ""))
            else:
                if op != "D":
                    kept.append((mine[at][2] if op == "K" else "assistant" if last == "u" else "user", mine[at][3]))
                at += 1
            last = kept[-1][0][0] if kept else ""
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()
        out.append((conv, max(t) - min(t) + 1 - len(set(t)) if t else 0, n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, audit, sha))
    return sorted(out, key=str)


def test_solver_against_search():
    rng = random.Random(3)
    some = ["".join(rng.choice(rng.choice(["ua", "suaoSUAOX", "uX", "SUa"])) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["ua" * 400, "u" * 300, "X" * 50]
    got = turns.solve(some)
    mats = turns.whole_matrices(some)
    for s in some:
        assert got[s] == slow_audit(s), s
        row = turns.finish(mats[s][turns.START])
        assert (row[0], str(row[1])) == got[s]
    with_rules = turns.re_pair([[turns.CODE[c] for c in s] for s in some], 9)
    assert len(with_rules[0]) > 20 and sum(map(len, with_rules[1])) < sum(map(len, some)) / 2


def test_solver_by_all_edits():
    """Every edit script of short conversations, checked by the expression."""
    for n in range(4):
        for s in itertools.product("suaoUX" if n < 3 else "saUX", repeat=n):
            best = None
            for gaps in itertools.product(range(3), repeat=n + 1):
                for ops in itertools.product("DKR", repeat=n):
                    forms = [("", 0, "")]
                    for k in range(n + 1):
                        for _ in range(gaps[k]):
                            forms = [(f + x, c + 5, a + "I") for f, c, a in forms for x in "ua"]
                        if k < n:
                            extra = 5 * s[k].isupper()
                            if ops[k] == "D":
                                forms = [(f, c + 2, a + "D") for f, c, a in forms]
                            elif s[k] == "X":
                                forms = []
                            elif ops[k] == "K":
                                forms = [(f + s[k].lower(), c + extra, a + "K") for f, c, a in forms]
                            else:
                                forms = [(f + x, c + 1 + extra, a + "R") for f, c, a in forms for x in "ua"]
                    for f, c, a in forms:
                        if re.fullmatch("(s?(ua)+)?", f) and (best is None or (c, a) < best):
                            best = c, a
            assert turns.solve(["".join(s)])["".join(s)] == best


def test_ropes():
    rng = random.Random(4)
    parts = [turns.Rope("".join(rng.choice("DIKR") for _ in range(rng.randint(0, 60)))) for _ in range(30)]
    for _ in range(2000):
        parts.append(rng.choice(parts) + rng.choice(parts)) if len(parts) < 300 else None
        a, b = rng.choice(parts), rng.choice(parts)
        if a.size < 5000 and b.size < 5000:
            assert (a < b) == (str(a) < str(b))


@pytest.fixture(scope="module")
def talk(spark):
    rng = random.Random(5)
    data = [(None, None, None, None), (None, None, None, None), (None, 3, "user", "Hi."), (1, None, "assistant", "Ok."), (1, 2, None, "x"), (2, 1, "", ""), (3, 1, "tool", LONG), (3, 9, "tool", LONG + "!")]
    for conv in range(10, 60):
        for turn in range(rng.randint(1, 9)):
            data.append((conv, rng.choice([turn, turn, turn, None, 2]), rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["Yes.", "No", "", None, f"Text {rng.random()}.", "Same text with an end!"])))
    for turn in range(700):  # a long conversation, and one that repeats itself
        data.append((7, turn // 2, "user" if turn % 2 else "assistant", f"Turn {turn % 300}."))
        data.append((8, 5, "user", "Again and again."))
    extra = "lang string, kind int, id int, part int, chunk string, head int, rank int, t int"
    return spark.createDataFrame([(*r, "en", 1, 2, 3, "c", 4, 5, 6) for r in data], f"conv_id bigint, turn bigint, role string, text string, {extra}").repartition(5), data


def test_repair(spark, talk, monkeypatch):
    df, data = talk
    left, ids = slow_damage(data)
    want = slow_repair(left, ids)
    plain = slow_repair([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in data], {r[0] for r in data})
    keep = turns.CHUNK_ROWS
    for limit in (keep, 7):
        monkeypatch.setattr(turns, "CHUNK_ROWS", limit)
        assert rows(turns.repair(*turns.damaged(df))[0], *turns.REPORT) == want
    report, messages = turns.repair(df.select("conv_id", "turn", "role", "text"), messages=True)
    assert rows(report, *turns.REPORT) == plain
    by = {}
    for r in sorted(messages.collect(), key=lambda r: (str(r.conv_id), r.part, r.chunk, r.place)):
        by.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {r.conv_id: hashlib.sha256("\n".join(by.get(r.conv_id, [])).encode()).hexdigest() for r in report.collect()} == {r[0]: r[-1] for r in plain}
    assert turns.repair(*turns.damaged(df.limit(0)))[0].count() == 0


def test_repair_real(spark):
    data = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows(turns.op12_conversation_repair(spark, SF), *turns.REPORT) == slow_repair(*slow_damage(data))


# periodic runs


def slow_runs(w, least):
    out = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 3 * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted(((lo, hi - lo, q) for (lo, hi), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_against_all_periods():
    rng = random.Random(6)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 4)):
            w = []
            while len(w) < rng.randint(0, 300):
                root = [rng.randint(1, rng.choice([1, 2, 2, 3])) for _ in range(rng.randint(1, rng.choice([3, 10, 40])))]
                if rng.random() < 0.3:
                    root = root * rng.randint(1, 6) + [rng.randint(1, 2)]
                w += root * rng.randint(1, 6) + root[: rng.randint(0, len(root))]
            texts.append(w)
        flat = np.array([x for t in texts for x in t], np.int64)
        for least in (24, 6):
            want, at = [], 0
            for t in texts:
                want += [(a + at, b, c) for a, b, c in slow_runs(t, least)]
                at += len(t)
            assert [tuple(r) for r in periods.runs(flat, np.array([len(t) for t in texts], np.int64), least).tolist()] == want


def test_range_successor():
    rng = np.random.default_rng(7)
    for n in (1, 2, 100, 257):
        v = rng.permutation(n)
        tree = periods.RangeSuccessor(v)
        i = rng.integers(0, n, 200)
        j = np.minimum(n, i + rng.integers(0, n + 1, 200))
        x = rng.integers(0, 2 * n + 2, 200)
        want = [min((int(y) for y in v[a:b] if y >= c), default=-1) for a, b, c in zip(i, j, x)]
        assert tree.successor(i, j, x).tolist() == want


def slow_row(key, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(key).encode())
    if key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    ids = {}
    got = slow_runs([ids.setdefault(x, len(ids)) for x in w], 24)
    top = min(got, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, ln, q in got for i in range(s + q, s + ln)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (key, len(got), *top, 1000 * top[1] // top[2] if got else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in got)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


PERIODIC = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_periodic_query(spark, odd, tmp_path):
    odd.where("doc_id IS NULL OR doc_id <> 8").write.parquet(str(tmp_path / "documents.parquet"))
    data = [(i, t) for i, t in TEXTS if i != 8]
    assert rows(periods.op13_periodic_runs(spark, str(tmp_path)), *PERIODIC) == sorted((slow_row(i, t) for i, t in data), key=str)
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    real = [(i, t) for i, t in real if t is None or len(t) < 6000]
    got = {r[0]: r for r in rows(periods.op13_periodic_runs(spark, SF), *PERIODIC)}
    assert all(got[i] == slow_row(i, t) for i, t in real) and sum(r[1] > 0 for r in got.values()) > 5


def test_periodic_without_plant(spark, odd):
    got = {r.doc_id: r for r in periods.find(odd).collect() if r.doc_id in (4, 8, 10)}
    assert [tuple(x) for x in got[10].runs] == [(0, 90, 1)] and got[10].collapsed == "a" and tuple(got[10].best) == (0, 90, 1)
    assert got[8].runs == [] and got[8].collapsed == LONG and got[4].collapsed == "" and got[4].best is None
    assert periods.find(odd.limit(0)).count() == 0
