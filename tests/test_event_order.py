"""Keyed streaming state in event-time order, local books, dead letters."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tapeworks.functions import messages
from tapeworks.operators import books
from tapeworks.operators.monitors import Breaker
from tapeworks.operators.strategies import _Ledger
from tapeworks.plans.fold import ordered_fold
from tapeworks.sources import store
from tapeworks.streaming import jobs, ordered

MINUTE = 60_000_000


def running_ledger():
    class Ledger(_Ledger):                     # local, so that it travels by value
        def row(self, side, qty, price):
            super().row(side, qty, price)
            yield self.qty, self.realised

        def end(self):
            return ()

    return Ledger


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, ordered.ROCKS)
    yield spark
    spark.conf.set(name, old)


def streamed(spark, folder, frames, build, name):
    for k, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(str(folder))
    src = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = build(src).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None
    return spark.table(name)


def cut(rows, late, parts, seed):
    """Rows as files: shuffled within ``late`` of event time, some across files."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[1] + rng.randint(0, late))
    size = -(-len(rows) // parts)
    return [rows[i:i + size] for i in range(0, len(rows), size)]


@pytest.mark.parametrize("kind", ["ledger", "quality", "breaker"])
def test_shuffled_and_late_rows_give_the_batch_result(rocks, tmp_path, kind):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(4)}", rng.randrange(0, 600) * MINUTE, i, rng.choice(["buy", "sell"]), float(rng.randint(1, 5)), float(rng.randint(50, 150))) for i in range(250)]
    schema = "k string, us bigint, tie bigint, side string, qty double, price double"
    cols, make, out = {
        "ledger": (["side", "qty", "price"], running_ledger(), "quantity double, realised double"),
        "quality": (["us", "price"], lambda: jobs.TickQuality(5.0 * MINUTE, 0.5), "t bigint, n int, gaps int, moves int"),
        "breaker": (["us", "trip"], lambda: Breaker(20 * MINUTE), "t bigint, state string"),
    }[kind]
    add = lambda df: df.withColumns({"ts": F.timestamp_micros("us"), "trip": F.col("price") > 120})
    frames = [rocks.createDataFrame(x, schema) for x in cut(rows, 30 * MINUTE, 5, 2)]
    frames.append(frames[1])                                       # rows that come again
    end = ("z", 10**6 * MINUTE, -1, "buy", 1.0, 1.0)
    frames += [rocks.createDataFrame([end], schema), rocks.createDataFrame([("z", 2 * 10**6 * MINUTE, -2, *end[3:])], schema)]
    got = streamed(rocks, tmp_path / "in", frames, lambda df: ordered.ordered_machine(add(df), ["k"], "ts", "tie", "10 hours", cols, make, out), f"ordered_{kind}").where("k <> 'z'")
    want = ordered_fold(add(rocks.createDataFrame(rows, schema)), ["k"], ["us", "tie"], cols, make, out)
    a, b = (sorted(map(tuple, df.collect()), key=str) for df in (got, want))
    assert len(b) > 0 and a == b


def depth(rng, n):
    """Messages of two symbols, with old and zero ids."""
    out = []
    for seq in range(n):
        side = lambda: [[str(rng.randint(1, 12) * 5), str(rng.choice([0, 1, 2, 7]))] for _ in range(rng.randint(0, 3))]
        u = rng.choice([seq + 1, seq + 1, seq + 1, max(1, seq - 3), 0 if seq % 17 == 0 else seq + 1])
        out.append((rng.choice("ab"), (seq + 1) * MINUTE, seq, json.dumps({"s": "x", "u": u, "b": side(), "a": side()})))
    return out


def replay(rows, top):
    """(symbol, seq) -> best levels of each side, and (best bid, best ask)."""
    book, last, out = {}, {}, {}
    for sym, _, seq, body in rows:
        m, b = json.loads(body), book.setdefault(sym, {})
        if m["u"] <= last.get(sym, 0) and m["u"] != 0:
            out[sym, seq] = None
            continue
        last[sym] = m["u"]
        for side, entries in (("buy", m["b"]), ("sell", m["a"])):
            for p, q in entries:
                b.pop((side, float(p)), None)
                if float(q) > 0:
                    b[side, float(p)] = float(q)
        bids, asks = sorted((-p for s, p in b if s == "buy")), sorted(p for s, p in b if s == "sell")
        out[sym, seq] = [("buy", k + 1, -p, b["buy", -p]) for k, p in enumerate(bids[:top])] + [("sell", k + 1, p, b["sell", p]) for k, p in enumerate(asks[:top])], m["u"], -bids[0] if bids else None, asks[0] if asks else None
    return out


def test_local_book_batch_and_stream(rocks, tmp_path):
    rows = depth(random.Random(3), 160)
    want = replay(rows, 2)
    schema = "sym string, us bigint, seq bigint, body string"
    df = rocks.createDataFrame(rows, schema)
    d = messages.deltas_from_raw(df)
    ids = books.accepted(df.select("sym", "seq", F.get_json_object("body", "$.u").cast("bigint").alias("u")), ["sym"], "seq", "u")
    lives = books.level_lives(d.join(ids.select("sym", "seq"), ["sym", "seq"]), ["sym"], "seq", "place")
    moments = df.select("sym", "seq").where("seq % 7 in (0, 3)")
    got = {}
    for r in books.book_at(lives, moments, ["sym"], "seq", 2).collect():
        got.setdefault((r.sym, r.seq), []).append((r.side, r.k, r.price, r.qty))
    seen = {}
    for (sym, seq), v in want.items():                             # a stale message leaves the book as it was
        seen[sym] = v[0] if v else seen.get(sym, [])
        if seq % 7 in (0, 3):
            assert sorted(got.get((sym, seq), [])) == sorted(seen[sym]), (sym, seq)

    frames = [rocks.createDataFrame(x, schema) for x in cut(rows, 20 * MINUTE, 4, 4)]
    frames += [rocks.createDataFrame([("z", k * 10**6 * MINUTE, k, json.dumps({"s": "z", "u": 1}))], schema) for k in (1, 2)]
    out = streamed(rocks, tmp_path / "book", frames, lambda s: ordered.local_book(s.withColumn("ts", F.timestamp_micros("us")), ["sym"], "ts", "seq", "5 hours"), "local_book")
    rest = {(r.sym, r.seq): (r.update_id, r.bid, r.ask) for r in out.where("sym <> 'z'").collect()}
    assert rest == {k: v[1:] for k, v in want.items() if v}


def test_book_depth_is_trimmed(rocks, tmp_path):
    body = json.dumps({"s": "x", "u": 1, "b": [[str(p), "1"] for p in range(1, 9)], "a": [["20", "1"], ["21", "1"]]})
    frames = [rocks.createDataFrame([(k, t * MINUTE, t, body)], "sym string, us bigint, seq bigint, body string") for k, t in (("a", 1), ("z", 10**6), ("z", 2 * 10**6))]
    out = streamed(rocks, tmp_path / "trim", frames, lambda s: ordered.local_book(s.withColumn("ts", F.timestamp_micros("us")), ["sym"], "ts", "seq", "1 hour", depth=3), "book_trim")
    assert [tuple(r) for r in out.where("sym = 'a'").collect()] == [("a", 1, 1, 8.0, 20.0, 3, 2)]


def test_depth_messages(spark):
    rows = [(1, '{"s":"x","u":7,"b":[["10","1"],["9"]],"a":[["11","0","9"]]}'), (2, '{"s":"x","u":8,"b":[["ten","1"]]}'), (3, "no json"), (4, '{"u":9,"b":[["1","1"]]}'), (5, '{"s":"y","a":[["5.5","2"]]}')]
    got = sorted(tuple(r) for r in messages.deltas_from_raw(spark.createDataFrame(rows, "n int, body string")).collect())
    assert got == [(1, "x", 7, 0, "buy", 10.0, 1.0), (1, "x", 7, 1, "sell", 11.0, 0.0), (5, "y", 0, 0, "sell", 5.5, 2.0)]


def test_a_retried_epoch_writes_once(spark, tmp_path):
    good, dead = str(tmp_path / "good"), str(tmp_path / "dead")
    write = store.dead_letter_batch("risk-events", good, dead)
    rows = ['{"event_type":"x","severity":"info","timestamp":"t"}', '{"event_type":"x"}', "junk"]
    for epoch, part in ((0, rows), (1, rows[:2]), (1, rows[:2]), (0, rows)):
        write(spark.createDataFrame([(r,) for r in part], "value string"), epoch)
    assert spark.read.parquet(good).count() == 2
    assert sorted(r.reason for r in spark.read.parquet(dead).collect()) == ["missing severity", "missing severity", "not json"]


def test_book_counts_moments_not_time(spark):
    far = 2**62 + 5
    lives = spark.createDataFrame([("x", "buy", 5.0, 1.0, -far, 0), ("x", "buy", 6.0, 2.0, 0, None), ("x", "sell", 7.0, 3.0, 1, 9), (None, "buy", 1.0, 1.0, 0, None)], "sym string, side string, price double, qty double, since bigint, until bigint")
    moments = spark.createDataFrame([("x", -far), ("x", far), ("x", None), ("y", 3)], "sym string, at bigint")
    got = sorted((r.sym, r["at"], r.side, r.k, r.price, r.qty) for r in books.book_at(lives, moments, ["sym"], "at", 2).collect())
    assert got == [("x", -far, "buy", 1, 5.0, 1.0), ("x", far, "buy", 1, 6.0, 2.0)]
