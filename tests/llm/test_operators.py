"""Operators of tapeworks.llm against brute force, and their defined cases."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tapeworks import session
from tapeworks.llm import common, contamination, idcoder, idfiles, jaccard, lines, pieces, pitman_yor, pseudonyms, repeats, simhash, toxicity, warc

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
NEAR = "the quick brown fox jumps over the lazy dog while seven wise men watch from the old stone bridge near town"
TEXTS = [
    (1, "Alpha beta\ngamma  delta. 4539578763621486 on 2024-02-29"), (2, None), (3, ""), (4, " \t\n "), (5, NEAR), (6, NEAR), (6, NEAR), (7, NEAR.replace("seven", "eleven")),
    (None, NEAR), (8, LONG), (9, "Ä É ÏÖÜ ñandú ▁▁ \x00 x  y\n\nx\nx\n😀"), (10, "a a a a a a a a a a a a a a a a a a"), (11, "<|endoftext|> <s> idiot It's"), (12, "\n"), (13, "trash " * 30),
]
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, d int, fp string, unit int, h string, line int, key int, score string, term string, pos int, gone string, i int, kind int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None, None if t is None else len(t), 1, "f", 2, "h", 3, 4, "s", "t", 5, "g", 6, 7) for i, t in TEXTS]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# 1


def test_pieces(odd, none, real, spark):
    path = public_tokenizers.path(pieces.MODEL)
    m = pieces.Merger(path)
    for df in (odd, real):
        want = []
        for i, t in texts(df):
            ids = m.lib.encode(t or "", add_bos=True, add_eos=True)
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(m.lib.decode(ids).encode()).hexdigest()))
        assert rows(pieces.digests(df, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    got = pieces.encode(odd, path, check="texts").where("doc_id = 9").first()
    assert got.decoded == m.lib.decode(list(got.ids))
    assert pieces.digests(none, path).count() == 0


def test_pieces_any_text():
    m = pieces.Merger(public_tokenizers.path(pieces.MODEL))
    rng = random.Random(1)
    some = ["".join(rng.choice(" \n\t ab the▁é日😀́\x00<s></s>#") for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["▁" * 300, "ab" * 400, " " * 100]
    m.encode(some, "texts")
    m.known = {}
    m.encode(some, "segments")
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(0, 259), rng.randrange(259, 32000), 29871, 259]) for _ in range(rng.randint(0, 6))]
        assert m.decode(ids) == m.lib.decode(ids)
    m.score["a"], m.ids["é日"], m.score["é日"], m.cost["é日"] = 0, 5, 0.0, -1.0
    with pytest.raises(AssertionError):
        m.known = {}
        m.encode(["é日"], "segments")


# 2


def line_brute(data):
    occ = defaultdict(list)
    for i, t in data:
        for k, w in enumerate(lines.normal_lines(t or "")):
            if w:
                occ[b" ".join(w)].append((i is not None, i or 0, k))
    keys = list(occ)
    sim = lines.simhashes([k.split() for k in keys]) if keys else []
    up = list(range(len(keys)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if int(sim[i] ^ sim[j]).bit_count() <= lines.RADIUS and lines.alike(keys[i].decode(), keys[j].decode()):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    groups = defaultdict(set)
    for i, k in enumerate(keys):
        groups[find(i)].update(occ[k])
    gone = {x for g in groups.values() for x in sorted(g)[1:]}
    return [(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i is not None, i or 0, k) not in gone)) for i, t in data]


def test_lines(odd, none, real):
    small = real.where("doc_id < 60")
    for df in (odd, small):
        assert rows(lines.dedup(df), "doc_id", "text") == sorted(line_brute(texts(df)), key=str)
    assert lines.dedup(odd).columns == odd.columns and lines.dedup(none).count() == 0


def test_lines_near_copies_in_units(spark, monkeypatch):
    rng = random.Random(2)
    word = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.sample(word, 60)) for _ in range(3)]
    data = [(i, base[i % 3].replace(" w1", f" w1{i}", 1)) for i in range(90)]
    monkeypatch.setattr(lines, "SIM_UNIT", 10)
    monkeypatch.setattr(lines, "LINE_UNIT", 7)
    got = rows(lines.dedup(spark.createDataFrame(data, "doc_id bigint, text string")), "doc_id", "text")
    assert got == sorted(line_brute(data), key=str)


def test_edit_distance():
    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            c = [i]
            for j, y in enumerate(b, 1):
                c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
            p = c
        return p[-1]

    rng = random.Random(1)
    for _ in range(1500):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) if rng.random() < 0.5 else "".join(c for c in a if rng.random() < 0.9)
        for most in (0, 1, 4):
            assert lines.edits_within(a, b, most) == (distance(a, b) <= most)


def test_large_clusters_meet_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(lines, "LINE_UNIT", 16)
    rng = random.Random(5)
    sims = [rng.getrandbits(64)]
    for _ in range(799):
        sims.append(rng.choice(sims[-40:]) ^ (1 << rng.randrange(64) | 1 << rng.randrange(64)))
    data = [(7, f"h{k}".encode(), x - (1 << 64) if x >> 63 else x, "same words here" if k % 3 else "quite another") for k, x in enumerate(sims)]
    texts = spark.createDataFrame(data, "cluster bigint, h binary, sim bigint, norm string")
    met = lines.meetings(texts, 3)
    assert met.count() <= 12 * len(data) < len(data) * (len(data) // 16)
    links = met.repartition(3, "unit").sortWithinPartitions("unit", "two", "sim").mapInArrow(lines._verify(3, 0.8), "a binary, b binary")
    label = list(range(len(sims)))
    for i in range(len(sims)):
        for j in range(i):
            if (sims[i] ^ sims[j]).bit_count() <= 3 and data[i][3] == data[j][3] and label[i] != label[j]:
                hi, lo = sorted((label[i], label[j]), reverse=True)
                label = [lo if x == hi else x for x in label]
    name = {f"h{k}": k for k in range(len(sims))}
    got = {}
    for r in common.components(links.select(*[F.expr(f"cast(substring(cast({x} as string), 2) as bigint)").alias(x) for x in "ab"]), "a", "b").collect():
        got[r.node] = r.root
    assert len(name) == len(sims) and [got.get(k, k) for k in range(len(sims))] == label


def test_stored_leaves_no_shuffle_files(spark):
    mine = spark.conf.get(session.DROP_SHUFFLES, None)
    folder = [spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()]
    held = lambda: sum(b.name().startswith("shuffle") for b in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(folder[0].getAllBlocks()))
    before = held()
    assert common.stored(spark.range(1000).repartition(5).groupBy("id").count(), "x").count() == 1000
    spark.sparkContext._jvm.java.lang.Thread.sleep(1000)
    assert held() <= before + 2 and spark.conf.get(session.DROP_SHUFFLES, None) == mine


# 3


def contamination_brute(data, items, width=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    wanted = defaultdict(set)
    for i, t in items:
        w = cut(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wanted[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = []
    for i, t in data:
        w = cut(t)
        hit, found = set(), set()
        for n in {len(x) for x in wanted}:
            for k in range(len(w) - n + 1):
                if x := wanted.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= x
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_contamination(spark, odd, none, real):
    odd_items = [(1, NEAR), (2, None), (3, ""), (None, "gamma delta"), (5, "a a a a a"), (5, "watch from the old stone"), (6, "a " * 15), (7, "nowhere to be seen")]
    for df, items in ((odd, odd_items), (real, [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])):
        b = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, term int")
        got = contamination.report(df, b)
        assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == contamination_brute(texts(df), items)
    assert contamination.report(none, b).count() == 0
    assert contamination.report(odd, b.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x a y b z c a q"), (2, "c b a"), (3, "a b"), (4, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    index = contamination.Index.build(docs, items)
    got = index.proximity(5).join(index.lengths, "d")
    assert rows(got, "doc_id", "pos") == [(1, 1), (1, 3), (2, 0)]


# 4


def repeat_brute(t, width):
    w = split(t)
    n = len(w)
    c = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    five = {j for i in range(n - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    best = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            best[i] = max(best[i], k)
    inside = {j for i in range(n) if best[i] >= width for j in range(i, i + best[i])}
    seen, dup = set(), 0
    for x in (t or "").split("\n"):
        if split(x):
            dup += x in seen
            seen.add(x)
    return [n, sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t or ""), dup, len(five), len(inside), max(best, default=0)]


def test_repeats(odd, none):
    rng = random.Random(3)
    some = ["", "é ñ | # x\n\n x\nx\n x"] + [" ".join(rng.choice("ab" if k % 2 else "abcdefgh") for _ in range(rng.randint(0, 90))) for k in range(60)]
    got = repeats.measure([t.encode() for t in some], 3)
    for i, t in enumerate(some):
        assert [int(got[k][i]) for k in repeats.NAMES] == repeat_brute(t, 3)
    want = [(i, *repeat_brute(t, repeats.MIN_WORDS)) for i, t in texts(odd) if t != LONG]
    judged = repeats.judge(odd)
    assert [r for r in rows(judged, "doc_id", *repeats.NAMES) if r[0] != 8] == sorted(want, key=str)
    kept = {(r.doc_id, r.kept) for r in judged.collect()}
    assert (8, True) in kept and (10, False) in kept and (2, False) in kept
    assert rows(repeats.keep(odd), "doc_id") == rows(judged.where("kept"), "doc_id") and repeats.keep(odd).columns == odd.columns
    assert repeats.judge(none).count() == 0 and repeats.keep(none).count() == 0


def test_maximal_repeats():
    rng = random.Random(4)
    for _ in range(40):
        w = [rng.choice("abc") for _ in range(rng.randint(2, 40))]
        n = len(w)
        ids, sizes = repeats.word_ids([" ".join(w).encode()])
        s = repeats.Suffixes(ids, sizes)
        got = {(tuple(w[s.order[a] : s.order[a] + ln]), b - a + 1) for ln, a, b in repeats.maximal_repeats(ids, s.order, s.lcp(), np.zeros(n, int), 2)}
        occ = defaultdict(list)
        for ln in range(2, n + 1):
            for i in range(n - ln + 1):
                occ[tuple(w[i : i + ln])].append(i)
        want = set()
        for k, v in occ.items():
            before, after = {w[i - 1] if i else None for i in v}, {w[i + len(k)] if i + len(k) < n else None for i in v}
            if len(v) > 1 and (len(before) > 1 or None in before) and (len(after) > 1 or None in after):
                want.add((k, len(v)))
        assert got == want


# 5


def test_language_model(odd, none, real):
    for df in (odd, real):
        data = texts(df)
        held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
        c = Counter(w for i, t in data if not held(i) for w in [*split(low(t)), None])
        n, v = sum(c.values()), len(c)
        want = []
        for i, t in data:
            w = [*split(low(t)), None]
            want.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)))
        out = pitman_yor.language_model(df).toPandas()
        got = [(None if x.doc_id != x.doc_id else int(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 5)) for x in out.itertuples()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert (out.score < 0).all()
    unseen = out[out.held_out]
    assert unseen.score.sum() > unseen.base_score.sum()
    assert pitman_yor.language_model(none).count() == 0


def test_predictions_sum_to_one(monkeypatch):
    monkeypatch.setattr(pitman_yor, "FINE", 64)
    monkeypatch.setattr(pitman_yor, "COARSE", 8)
    p = pitman_yor
    rng = np.random.default_rng(0)
    words, ctx, _, key = p.tokens([b" ".join(b"w%d" % (x % 40) for x in rng.geometric(0.08, 200)) for _ in range(40)])
    rank = np.empty(len(key), int)
    rank[np.argsort(key)] = np.arange(len(key))
    pair, c = np.unique(rank[words] * 64 + ctx, return_counts=True)
    row = dict(bucket=0, kind=0, chunk=int(c.sum()), words=np.sort(key).tobytes(), n=np.bincount(pair // 64).astype("<u4").tobytes(), ctx=(pair % 64).astype("<u2").tobytes(), c=c.astype("<u4").tobytes())
    a, b = p.first_totals(row)
    history = [p.Totals(a[:73], b[:73], len(key), int(c.sum()))]
    for _ in range(p.BURN + p.SAMPLES):
        for bucket in p.seated(row, list(history), 5):
            for s in bucket.seats:
                assert (np.bincount(s.dish, weights=s.size, minlength=len(s.c)) == s.c).all() and (np.bincount(s.dish, minlength=len(s.c)) == s.t).all()
        history.append(p.Totals(*bucket.totals(), len(key), int(c.sum())))
    t = [[], [], []]
    for k, bucket in enumerate(p.seated(row, history[:-1], 5)):
        if k >= p.BURN:
            for x, s in zip(t, bucket.seats):
                x.append(s.t.astype("<u4"))
    row |= dict(zip(("t2", "t1", "t0"), (np.concatenate(x).tobytes() for x in reversed(t))))
    scorer, m = p.Scorer(row, history), len(key) + 1
    for u in range(64):
        ask = dict(words=np.concatenate((np.sort(key), [np.uint64(1)])).tobytes(), n=np.ones(m, "<u4").tobytes(), ctx=np.full(m, u, "<u2").tobytes(), doc=np.arange(m).astype("<u2").tobytes(), ids=bytes(8 * m))
        assert abs((10 ** scorer.score(ask)[0]).sum() - 1) < 1e-9


# 6


def luhn(s):
    return sum((int(c) * 2 - 9 * (int(c) > 4) if k % 2 else int(c)) for k, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms(spark, odd, none, real):
    text = "pay 4539578763621486 or 4539 5787 6362 1486, bad 4539578763621487; +1 (017) 555-7713 ssn 123-45-6789 000-11-2222 on 2024-02-29 02/29/2024 29.02.2024 2023-02-30 at 141.73.119.60, 300.1.1.1, 1.2.3.4.5 x4539578763621486"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    out = {r.doc_id: r.text for r in pseudonyms.replace(df).collect()}
    assert out[2] is None and out[3] == "" and re.sub(r"\d", "9", re.sub(r"at \S+", "", out[1])) == re.sub(r"\d", "9", re.sub(r"at \S+", "", text))
    for kept in ("4539578763621487", "000-11-2222", "2023-02-30", "300.1.1.1", "1.2.3.4.5", "x4539578763621486"):
        assert kept in out[1]
    a, b = re.search(r"pay (\d+) or (\d+ \d+ \d+ \d+)", out[1]).groups()
    assert a == b.replace(" ", "") and luhn(a) and a != "4539578763621486"
    d = re.search(r"on (\d+)-(\d+)-(\d+) (\d+)/(\d+)/(\d+) (\d+)\.(\d+)\.(\d+)", out[1]).groups()
    assert (d[0], d[1], d[2]) == (d[5], d[3], d[4]) == (d[8], d[7], d[6])
    assert rows(pseudonyms.replace(pseudonyms.replace(df), undo=True), "doc_id", "text") == rows(df, "doc_id", "text")
    for x in (odd, real):
        assert rows(pseudonyms.replace(pseudonyms.replace(x), undo=True), "doc_id", "text") == rows(x, "doc_id", "text")
    assert pseudonyms.replace(odd).columns == odd.columns and pseudonyms.replace(none).count() == 0


def test_pseudonyms_permute(spark):
    days = spark.range(0, 146097, 1, 8).select(F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("v"))
    got = days.select(pseudonyms.pseudonym(F.col("v")).alias("p")).agg(F.countDistinct("p"), F.min("p"), F.max("p")).first()
    assert tuple(got) == (146097, "1800-01-01", "2199-12-31")
    four = spark.range(10000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("v"))
    assert four.select(pseudonyms.number("t", F.col("v"), "k", False).alias("p")).agg(F.countDistinct("p")).first()[0] == 10000


# 7


def test_toxicity(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    out = toxicity.score(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    pos, neg = out[out.toxic == 1].score.values, out[out.toxic == 0].score.values
    assert (pos[:, None] > neg[None, :]).mean() > 0.7
    got = {r.doc_id: r for r in toxicity.score(odd, model).collect()}
    assert len(got) == len({i for i, _ in TEXTS}) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[2].score == got[3].score and got[13].score > got[5].score
    assert toxicity.score(none, model).count() == 0
    no_label = spark.createDataFrame([(1, None), (None, 1), (5, 0)], "doc_id bigint, toxic int")
    assert toxicity.fit(toxicity.training_rows(odd, no_label)).constant == 0.0


def test_toxicity_dictionary_holds_all_evidence():
    """More telling words than 128 bytes; the least telling still saves bytes."""
    bad = [b"vileword%03d" % k for k in range(400)]
    ours, theirs = Counter({w: 50 + k % 40 for k, w in enumerate(bad)}), Counter()
    for k in range(400):
        ours[b"usual%03d" % k] = theirs[b"usual%03d" % k] = 60
    got = toxicity.dictionary(ours, 100, theirs, 100)
    assert set(got.split()) == set(bad)
    for w in (bad[0], bad[-1], got.split()[0]):
        assert toxicity.features([b"so many say " + w + b" to them"], got, b"")[0, 0] >= 4


def test_toxicity_learns_from_whole_texts(spark):
    """Toxic passages that begin after 12,000 characters, and longer windows."""
    rng = random.Random(9)
    plain = lambda n: " ".join(f"p{rng.randrange(300)}" for _ in range(n))
    data = [(k, plain(3000) + (" vileword nastyword " + plain(20) if k % 2 else plain(20)), k % 2) for k in range(240)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, toxic int").repartition(4)
    sample = toxicity.training_rows(docs, docs)
    assert {len(r.text) for r in sample.collect()} <= {len(t) for _, t, _ in data} and sample.count() > 100
    model = toxicity.fit(sample)
    assert {b"vileword", b"nastyword"} <= set(model.toxic.split())
    out = toxicity.score(docs, model).join(docs, "doc_id").where("held_out").collect()
    assert out and all(r.predicted == r.toxic for r in out)


# 8


def simhash_brute(data):
    fp = []
    for _, t in data:
        w = split(low(t))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        fp.append(sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0)
    near = lambda a, b: (a ^ b).bit_count() <= 4
    comp = list(range(len(fp)))
    for i in range(len(fp)):
        for j in range(i):
            if near(fp[i], fp[j]) and comp[i] != comp[j]:
                comp = [comp[i] if c == comp[j] else c for c in comp]
    low_id = {c: min((data[k][0] for k in range(len(fp)) if comp[k] == c and data[k][0] is not None), default=None) for c in set(comp)}
    return sorted(((data[k][0], "%016x" % fp[k], low_id[comp[k]]) for k in range(len(fp))), key=str)


def test_simhash(odd, none, real):
    for df in (odd, real):
        got = simhash.near_duplicates(df).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
        assert sorted((tuple(r) for r in got.collect()), key=str) == simhash_brute([x for x in texts(df)])
    assert simhash.near_duplicates(none).count() == 0


def test_links_in_bounded_units(spark, monkeypatch):
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for f in list(fps):
        for _ in range(12):
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    real_units = common.units
    monkeypatch.setattr(simhash, "units", lambda df, key, item: real_units(df, key, item, 20))
    got = common.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint")), "a", "b")
    part = defaultdict(set)
    for r in got.collect():
        part[r.root].add(r.node)
    label = {f: f for f in signed}
    for a in signed:
        for b in signed:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4 and label[a] != label[b]:
                x, y = label[a], label[b]
                label = {k: x if v == y else v for k, v in label.items()}
    want = defaultdict(set)
    for k, v in label.items():
        want[v].add(k)
    assert sorted(map(sorted, part.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, k) for k in range(1001, 1300)] + [(5, 5)]
    got = common.components(spark.createDataFrame(edges, "a int, b int"), "a", "b")
    assert {(r.node, r.root) for r in got.collect()} == {(i, 0) for i in range(201)} | {(i, 1000) for i in range(1000, 1300)}


# 9


def test_coder_round_trip():
    rng = np.random.default_rng(1)
    for n, length in ((1, 1), (3, 50), (5, 700)):
        for x in (rng.integers(0, 65536, (n, length)), np.minimum(rng.geometric(0.01, (n, length)), 65535), np.zeros((n, length), int), np.tile(rng.integers(0, 65536, (1, 5)), (n, length // 5 + 1))[:, :length]):
            coded = idcoder.encode(x)
            assert (idcoder.decode(coded, length, int(x.max()) // 256 + 1) == x).all()
    words = np.tile(rng.integers(0, 49000, 40), 50)[None, :]
    assert len(idcoder.encode(words)[0]) < 2 * words.size / 3


def test_id_file_blocks():
    ids = np.random.default_rng(2).integers(0, 49408, 1000).astype(np.uint16)
    data = idfiles.pack(ids, [1, None], [400, 600])
    index, back = idfiles.unpack(data)
    assert (back == ids).all() and index["docs"] == [1, None] and (idfiles.unpack(data, [1])[1] == ids[256:512]).all()
    bad = bytearray(data)
    bad[-200] ^= 255
    with pytest.raises(OSError):
        idfiles.unpack(bytes(bad))


def test_id_files(spark, odd, none, real):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(idfiles.VOCABULARY)
    lib = Tokenizer.from_file(path)
    for df in (odd, real):
        start, want = 0, []
        for i, t in sorted(texts(df), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
            ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        got = idfiles.read(idfiles.write(df, common.work_folder(spark, "t"), path, 5000))
        assert rows(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)
    assert idfiles.through_files(spark, none, path).count() == 0


# 10


def test_warc(spark):
    big, other = "<p>é" + "x" * 2000, "y" * 999 + "z"
    data = [(1, "http://a b/", big), (5, None, big), (3, "http://c", big), (2, "http://d", other), (4, "u", other[:-1]), (6, "u", other[:-1]), (7, "u", None), (8, "u", ""), (9, "u", other), (9, "u", other), (None, "u", other)]
    df = spark.createDataFrame([(*x, "d") for x in data], "page_id bigint, url string, html string, payload string").repartition(4)
    folder = common.work_folder(spark, "t")
    manifest = warc.write(df, folder, roll_bytes=300)
    got = rows(warc.read(manifest), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    to = {1: 5, 3: 5, 2: 9, None: 9}
    want = [(i, len((t or "").encode()), sha(t), "revisit" if i in to else "response", to.get(i)) for i, _, t in data]
    want[9] = (*want[9][:3], "revisit", 9)
    want = [(*w[:3], "response", None) if w[0] is None else w for w in want]  # no id: nothing is known of its order
    assert got == sorted(want, key=str)
    assert manifest.count() > 4 and not [f for f in warc.open_path(f"{folder}/data")[0].get_file_info(warc.fs.FileSelector(warc.open_path(f"{folder}/data")[1])) if f.base_name.startswith(".tmp")]
    empty = df.limit(0)
    assert warc.archive(spark, empty).count() == 0


def test_warc_shards_do_not_depend_on_partitions(spark, monkeypatch):
    rng = random.Random(10)
    data = [(rng.choice([i, i, 7, None]), f"http://h/{i}", "p" * rng.randint(0, 3000) + str(i % 40)) for i in range(400)]
    data += data[:50]
    monkeypatch.setattr(warc, "PART_BYTES", 40_000)
    monkeypatch.setattr(warc, "SLICE_IDS", 100)
    seen = []
    for n in (1, 5, 11):
        rng.shuffle(data)
        df = spark.createDataFrame(data, "page_id bigint, url string, html string").repartition(n)
        m = warc.write(df, common.work_folder(spark, "t"), roll_bytes=3000).collect()
        assert sum(r.n_records for r in m) == len(data)
        seen.append(sorted((r.path.rsplit("/", 1)[1], r.sha1, r.first_id is None, r.first_id or 0) for r in m))
    assert seen[0] == seen[1] == seen[2] and len({x[0][:10] for x in seen[0]}) > 8
    assert [x[2:] for x in seen[0]] == sorted((x[2:] for x in seen[0]), key=lambda x: (not x[0], x[1]))


# the pipeline


def test_pipeline(spark, odd, none, tmp_path):
    import corpus_pipeline as c

    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    steps = dict(c.STAGES)
    assert list(steps) == ["quality_rules", "line_dedup", "simhash_dedup", "decontamination", "sentencepiece"]
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    near = rows(steps["simhash_dedup"](spark, docs, str(tmp_path)), "doc_id")
    assert [(5,)] == [r for r in near if r[0] in (5, 6, None)]
    assert steps["line_dedup"](spark, docs, str(tmp_path)).count() == docs.count()


def jaccard_brute(data):
    """The documents that stay when all pairs of five-word sets are compared."""
    sets = []
    for _, t in data:
        w = split(low(t))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {None})
    comp = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                comp = [comp[i] if x == comp[j] else x for x in comp]
    low_id = {x: min((i for (i, _), y in zip(data, comp) if x == y and i is not None), default=None) for x in comp}
    return [x for x, y in zip(data, comp) if x[0] == low_id[y]]


def test_near_dedup_keeps_no_near_copy(spark, odd, none, monkeypatch):
    """All pairs by Jaccard of five-word shingles, over 0.8 and just below."""
    import corpus_pipeline as c

    rng = random.Random(8)
    data = []
    for n in (30, 120, 400):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        for k in range(12):
            w = list(base)
            for _ in range(k * n // 120):
                w[rng.randrange(n)] = f"x{rng.randrange(9**9)}"
            data.append((len(data), " ".join(w)))
    rng.shuffle(data)

    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for limit in (jaccard.MEMBERS, 3):
        monkeypatch.setattr(jaccard, "MEMBERS", limit)
        for df in (spark.createDataFrame(data, "doc_id bigint, text string"), odd, none, *([real] if limit > 3 else [])):
            assert rows(c.near_dedup(spark, df, SF), "doc_id") == sorted(((i,) for i, _ in jaccard_brute(texts(df))), key=str)


def test_near_dedup_candidates():
    """Share of pairs at similarity 0.8 that meet in a band, and the SimHash."""
    rng = np.random.default_rng(9)
    met = 0
    for n in [9, 45, 450] * 300:
        both = rng.integers(0, 1 << 63, n * 8 // 9, dtype=np.uint64)
        a, b = (np.unique(np.concatenate((both, rng.integers(0, 1 << 63, n - len(both), dtype=np.uint64)))) for _ in range(2))
        met += bool(set(jaccard.bands(a).tolist()) & set(jaccard.bands(b).tolist()))
    assert met >= 0.999 * 900
    for _, t in TEXTS:
        data = (t or "").encode()
        assert jaccard.fingerprint(jaccard.marks(data, 4)) == simhash.fingerprint(data, 4)


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as c

    got = {r.doc_id: r for r in c.run(spark, SF).collect()}
    data = texts(spark.read.parquet(f"{SF}/documents.parquet"))
    measured = repeats.measure([t.encode() for _, t in data])
    ok = (measured["n_words"] >= 10) & (100 * measured["n_repeat_words"] <= 20 * measured["n_words"]) & (measured["covered_words"] <= repeats.MAX_COVERED * measured["n_words"]) & (measured["longest_repeat"] <= repeats.MAX_LONGEST)
    data = line_brute([x for x, k in zip(data, ok) if k])
    data = jaccard_brute(data)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in contamination_brute(data, items) if r[5]}
    lib = pieces.Merger(public_tokenizers.path(pieces.MODEL)).lib
    want = {i: lib.encode(t, add_bos=True, add_eos=True) for i, t in data if i not in bad}
    assert {i: list(r.ids) for i, r in got.items()} == want


def test_registered():
    import __spark_entry__ as e

    names = [n for n in e.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14)) and "pipeline" in e.queries()
    assert json.dumps(sorted(e.oracle_sql()))
