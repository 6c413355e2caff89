"""Decontamination, packing, quality rules and sharding against plain Python."""

import collections
import hashlib
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from stratalode.llm import decontamination, packing, quality_rules, sharding

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def benchmark(spark, rows):
    long = [r["text"] for r in rows if r["text"] and len(r["text"].split()) > 120]
    items = [(1, " ".join(long[0].split()[10:40]).upper()), (2, " ".join(long[1].split()[5:14])), (10, "é ü"), (11, None), (12, "..."), (13, " ".join(long[0].split()[10:40])), (14, "never seen here at all by any of these texts ok")]
    return spark.createDataFrame(pa.table({"item_id": [i for i, _ in items], "text": pa.array([t for _, t in items], pa.string())}))


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, stored, rows, benchmark, block_bytes):
    grams = collections.defaultdict(set)
    for r in benchmark.collect():
        w = WORD.findall((r.text or "").translate(LOW))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[k : k + n])].add(r.item_id)
    sizes, want = {len(g) for g in grams}, {}
    for r in rows:
        w = WORD.findall((r["text"] or "").translate(LOW))
        hit, items = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := grams.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= found
        ids = ",".join(sorted(map(str, items)))
        want[r["doc_id"]] = (len(w), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    got = {r[0]: tuple(r)[1:] for r in decontamination.report(stored, benchmark, block_bytes=block_bytes).collect()}
    assert got == want and sum(x[4] for x in want.values()) >= 3


def test_decontamination_removes(spark, stored, benchmark):
    out = decontamination.remove(stored, benchmark)
    assert out.columns == stored.columns
    assert decontamination.report(out, benchmark).where("contaminated").count() == 0
    assert out.count() >= stored.count() - 3
    assert decontamination.remove(stored.limit(0), benchmark).count() == 0
    assert decontamination.remove(stored, benchmark.limit(0)).count() == stored.count()


def test_decontamination_removes_the_same_in_blocks(spark):
    words = [f"p{k}" for k in range(24)]
    items = [(k, " ".join(words[9:23] if k % 2 else words[:15])) for k in range(2)]
    items += [(k, " ".join(f"q{k}x{j}" for j in range(12))) for k in range(2, 12)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    own = " ".join(f"o{k}" for k in range(30))
    spread = " ".join(f"{items[k][1]} s{k}a s{k}b s{k}c" for k in range(2, 12))  # 120 of 150 words, a tenth of them an item
    halves = f"before {' '.join(items[5][1].split()[:5])} {items[6][1]} {' '.join(items[5][1].split()[5:])} {own}"
    texts = [f"{own} {' '.join(words)} end", spread, halves, own, "", None]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, __marks long")
    got = [{r.doc_id: r.text for r in decontamination.remove(docs, benchmark, block_bytes=b).collect()} for b in (1 << 20, 60)]
    a, b = halves.split(items[6][1])
    assert got[0] == {0: f"{own}  p23 end", 2: a + b, 3: own, 4: "", 5: None}
    assert got[1] == got[0]


def test_decontamination_of_repeated_ids_and_null_items(spark):
    words = " ".join(f"p{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"x {words}", 5), (1, "clean", 6), (None, words, 7), (2, None, 8)], "doc_id long, text string, __items long")
    items = [(None, words), (7, words), (None, "q " * 12), (8, " ".join(f"z{k}" for k in range(900)))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = [sorted(map(str, decontamination.report(docs, benchmark, block_bytes=b).collect())) for b in (1 << 20, 300)]
    assert got[0] == got[1] and len(got[0]) == 4
    by = {r.n_words: r for r in decontamination.report(docs, benchmark).collect()}
    assert (by[13].n_hit, by[13].n_items, by[13].items_sha256) == (12, 2, hashlib.sha256(b"7").hexdigest()) and not by[1].contaminated and by[12].doc_id is None
    assert sorted(str(r.text) for r in decontamination.remove(docs, benchmark, drop_share=1.0).collect()) == ["", "None", "clean", "x "]


def _check_pieces(pieces, texts, length):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 1], 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    fills = []
    for spans in by_seq.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= length
        fills.append(at)
    assert sorted(by_seq) == list(range(len(by_seq))) and sum(f < length for f in fills) <= 1


def test_packing_round_trip(spark, stored, rows):
    texts = {r["doc_id"]: r["text"] for r in rows} | {9001: "tab\there \x1c odd space <|endoftext|> it's", 9002: "Don't  stop\n\n now \n \t 12ab \u00a0 caf\u00e9 \u4e2d\u6587 \U0001f600 e\u0301 it\u2019s ***||"}
    more = spark.createDataFrame([(9001, texts[9001], "en", "src9"), (9002, texts[9002], "de", None)], "doc_id long, text string, lang string, source string")
    docs = stored.select("doc_id", "text", "lang", "source").union(more)
    pieces = packing.pack(docs, length=256)
    _check_pieces(packing.digest(pieces).collect(), texts, 256)
    total = pieces.groupBy("queue").sum("length").collect()
    share = {r[0]: r[1] / sum(x[1] for x in total) for r in total}
    for r in pieces.groupBy("sequence_id", "queue").sum("length").collect():
        assert abs(r[2] - 256 * share[r[1]]) <= 1 + share[r[1]] * len(share) or r[0] == max(x.sequence_id for x in pieces.select("sequence_id").distinct().collect())
    _check_pieces(packing.digest(packing.pack(docs, length=256, targets={"src0": 0.2, "src1": 0.8})).collect(), texts, 256)
    assert packing.pack(docs.limit(0)).count() == 0


def _replay(totals, weights, length):
    """Window by window in one go: credit all queues until the window is full, serve the largest deficits, carry the rest."""
    phase = packing.phases(len(totals))
    heap = [(phase[q] / w, q, 0) for q, (t, w) in enumerate(zip(totals, weights, strict=True)) if t]
    heapq.heapify(heap)
    windows = []
    while heap:
        take = [0] * len(totals)
        while heap and sum(take) < length:
            _, q, i = heapq.heappop(heap)
            take[q] += 1
            if i + 1 < totals[q]:
                heapq.heappush(heap, ((i + 1 + phase[q]) / weights[q], q, i + 1))
        windows.append(take)
    return windows


@pytest.mark.parametrize("totals,weights", [([1, 9000, 3700, 5], [1, 9000, 3700, 5]), ([1, 9000, 3700, 5], [3, 1, 5, 0.1]), ([2000, 2000, 2000], [1, 1, 1]), ([0, 7], [2, 1]), ([10, 0, 6400], [0.3, 0.3, 0.4])])
def test_packing_plan_is_the_sequential_one_from_any_task(totals, weights):
    want = _replay(totals, weights, 64)
    for block in (1, 4, 16, 1000):
        plan, got = packing.Plan(totals, weights, length=64, block=block), np.zeros((len(want), len(totals)), int)
        for b in range(-(-plan.windows // block)):
            for q, w, _, _, n in zip(*plan.of_block(b), strict=True):
                got[w, q] += n
        assert got.tolist() == want
        for q, total in enumerate(totals):  # any stretch of any queue, asked for alone, lies where the windows have it
            rng, at = np.random.default_rng(q), 0
            starts = np.cumsum([[0] * len(totals), *want[:-1]], axis=0)[:, q] if want else []
            while at < total:
                n = int(min(total - at, rng.integers(1, 900)))
                rows = packing.Plan(totals, weights, length=64, block=block).pieces(q, at, n)
                assert rows[3].sum() == n and rows[2].tolist() == [0, *np.cumsum(rows[3])[:-1]]
                for w, offset, first, size in rows.T.tolist():
                    assert starts[w] <= at + first and at + first + size <= starts[w] + want[w][q]
                    assert offset == sum(want[w][:q]) + at + first - starts[w]
                at += n


def test_packing_keeps_each_of_many_sources(spark):
    texts = {k: f"text {k} " * (40 if k % 310 else 400) for k in range(930)}
    docs = spark.createDataFrame([(k, t, f"s{k % 310}") for k, t in texts.items()], "doc_id long, text string, source string").repartition(4)
    pieces = packing.pack(docs)
    got = packing.digest(pieces).collect()
    _check_pieces(got, texts, 2048)
    assert all(r.queue == f"s{r.doc_id % 310}" for r in got)
    taken, total = collections.Counter(), collections.Counter()
    for r in got:
        taken[r.sequence_id, r.queue] += r.length
        total[r.queue] += r.length
    for k in range(max(r.sequence_id for r in got)):
        assert all(abs(taken[k, q] - 2048 * n / total.total()) <= 2 for q, n in total.items())
    first = packing.digest(packing.pack(docs, length=8, targets={"s0": 0.9})).where("sequence_id < 256 AND queue = 's0'").collect()
    assert sum(r.length for r in first) > 0.7 * 8 * 256


def _base(text):
    w = SPACED.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    rep = {j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(rep)


def test_quality_statistics(stored, rows):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(stored).collect()}
    for r in rows:
        b = _base(r["text"])
        assert got[r["doc_id"]] == (*b, b[0] < 50 or 100 * b[4] > 50 * b[0]), r["text"]
    assert quality_rules.judge(stored.limit(0)).count() == 0


def _mcd(x, v, rng):
    """Plain FAST-MCD: many random starts, concentration steps until nothing changes, the least determinant wins."""
    h, best = int(np.ceil(quality_rules.H * len(x))), None
    for _ in range(30):
        some = x[rng.choice(len(x), min(len(x), 12), replace=False)]
        center, scatter, last = some.mean(0), np.cov(some.T) + np.diag(v.mean(0)) + 1e-6 * np.eye(x.shape[1]), None
        while True:
            d = np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(scatter), x - center)
            nearest = np.argsort(d, kind="stable")[:h]
            center, scatter = x[nearest].mean(0), np.cov(x[nearest].T, bias=True) * quality_rules.CONSISTENCY + np.diag(v[nearest].mean(0))
            det = np.linalg.slogdet(scatter)[1]
            if last is not None and det > last - 1e-9:
                break
            last = det
        if best is None or det < best[0]:
            best = det, center, scatter
    return best


def _away(x, center, scatter):
    return np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(scatter), x - center)


def test_robust_estimates_match_numpy_and_decide(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    vectors = quality_rules.statistics(docs).select(packing.F.coalesce("lang", packing.F.lit("")).alias("g"), *(v.alias(f"x{i}") for i, v in enumerate(quality_rules._vector())), *(v.alias(f"v{i}") for i, v in enumerate(quality_rules._spread())))
    rows = vectors.collect()
    fits = {r.g: r for r in quality_rules.estimates(vectors).collect()}
    rng, changed = np.random.default_rng(3), collections.Counter()
    for g, fit in fits.items():
        x, v = np.split(np.array([r[1:] for r in rows if r.g == g]), 2, axis=1)
        assert fit.n == len(x)
        det, center, scatter = _mcd(x, v, rng)
        own = np.array([[fit[f"c{max(i, j)}{min(i, j)}"] for j in range(4)] for i in range(4)])
        low = np.array([[fit[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        assert np.allclose(low @ low.T, own)
        # cells of the histogram let in a little more than H of the rows
        assert fit.det < det + 0.25
        mine = _away(x, np.array([fit[f"m{i}"] for i in range(4)]), own) > quality_rules.CUTOFF
        changed["brute"] += int((mine != (_away(x, center, scatter) > quality_rules.CUTOFF)).sum())
        changed["mean and covariance"] += int((mine != (_away(x, x.mean(0), np.cov(x.T)) > quality_rules.CUTOFF)).sum())
        changed["fixed deviations"] += int((mine != (_away(x, np.median(x, 0), np.diag(np.array(quality_rules.PRIOR) ** 2)) > quality_rules.CUTOFF)).sum())
        changed["rejected"] += int(mine.sum())
    # without the robust estimate most of the rejected rows would pass, or many others would not
    assert changed["brute"] <= 0.03 * changed["rejected"] and changed["mean and covariance"] > 0.3 * changed["rejected"] and changed["fixed deviations"] > 0.05 * changed["rejected"], changed


def test_equal_statistics_have_equal_verdicts(spark):
    """Nothing is drawn: of a group, documents with the same counts are judged alike, whatever their letters."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    other = docs.withColumn("text", packing.F.translate("text", "aeiou", "eioua"))
    both = [{r.doc_id: r for r in quality_rules.judge(d).collect()} for d in (docs, other)]
    assert all(both[1][k].kept == r.kept and abs((r.d2 or 0) - (both[1][k].d2 or 0)) < 1e-6 for k, r in both[0].items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = [(labels[k], r.kept) for k, r in both[0].items() if k in labels and not r.base_failed]
    good, bad = [kept for q, kept in judged if q], [kept for q, kept in judged if q == 0]
    assert sum(good) > 0.99 * len(good) and sum(bad) < 0.05 * len(bad)


def test_a_concentration_step_is_one_narrow_table(stored, monkeypatch):
    """The driver plans each step, so a step writes one table of one fit a row, also for the three starts."""
    written, real = [], quality_rules.materialise
    monkeypatch.setattr(quality_rules, "materialise", lambda df, name, **more: written.append((name, len(df.columns))) or real(df, name, **more))
    quality_rules.judge(stored)
    mcd = [(name, n) for name, n in written if name.startswith("mcd-")]
    steps = [name for name, _ in mcd].count("mcd-step")
    assert steps and len(mcd) - steps <= 6 and max(n for _, n in mcd) <= 32, mcd


def test_quality_of_small_and_uniform_tables(spark, stored):
    text = "some words that are told here only once " + " ".join(f"w{k}" for k in range(60))
    for texts in ([text], [text] * 7, [text] * 5 + [None, ""]):
        got = quality_rules.judge(spark.createDataFrame([(k, t, None, "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")).collect()
        assert [r.kept for r in sorted(got, key=lambda r: r.doc_id)] == [bool(t) for t in texts]
    twice = quality_rules.judge(stored.unionByName(stored)).collect()
    by_doc = collections.defaultdict(set)
    for r in twice:
        by_doc[r.doc_id].add(r.kept)
    assert len(twice) == 2 * stored.count() and all(len(v) == 1 for v in by_doc.values())


def test_sharding(stored, rows):
    out = sharding.shuffle_into_shards(stored, shards=7, block_rows=4)
    got = out.collect()
    assert sorted(r.doc_id for r in got) == sorted(r["doc_id"] for r in rows) and out.columns[: len(stored.columns)] == stored.columns
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    sizes = [len(s) for s in shards.values()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1
    assert sharding.shuffle_into_shards(stored.limit(0)).count() == 0


def test_sharding_is_alike_with_any_blocks_and_uniform(spark, stored):
    whole = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(stored, shards=3, block_rows=1 << 20).collect()}
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(stored, shards=3, block_rows=1).collect()} == whole
    few, seen = spark.range(0, 24, 1, 3), collections.Counter()
    for seed in range(40):
        for r in sharding.shuffle_into_shards(few, shards=4, seed=seed, block_rows=2).collect():
            seen[r.id // 8, r.shard] += 1  # an input partition and a shard: 80 rows on average of 960
    assert all(50 < n < 112 for n in seen.values()) and len(seen) == 12


def test_sharding_query(spark, tmp_path):
    texts = [None, "", "é", "a b"] + [f"text {k}" for k in range(50)]
    spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in sharding.op9_sharding(spark, str(tmp_path)).collect()}
    slots = collections.defaultdict(list)
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        assert (got[k]["size"], got[k].text_crc32, got[k].law, got[k].grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots[got[k].shard].append(got[k].slot)
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and {len(s) for s in slots.values()} == {3, 4}


def test_communication_matrix():
    m = sharding.communication_matrix([5, 0, 7, 100], [30, 30, 52], 1)
    assert m.sum(0).tolist() == [30, 30, 52] and m.sum(1).tolist() == [5, 0, 7, 100] and (m >= 0).all()
    rng = np.random.default_rng(0)
    big = [sharding._hypergeometric(rng, 2 * 10**9, 2 * 10**9, 1000) for _ in range(300)]
    assert 495 < np.mean(big) < 505
    first = np.mean([sharding.communication_matrix([6, 6], [4, 8], s)[0, 0] for s in range(400)])
    assert 1.85 < first < 2.15


def test_both_engines_give_the_same_ids():
    import random

    enc, rng = packing.encoder(packing.default_tokenizer()), random.Random(4)
    assert enc.fast is not None
    letters = "abcXYZ éÉßñ 019 '.,;:!?#*$%&|<>()[]-_\"\n\t\r  \u2013\u2019\u20ac½²ªº×÷"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(3000)]
    want = [np.array(enc.model.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert enc.encode(texts) == want


def test_null_ids_and_clashing_columns(spark, stored, benchmark):
    from stratalode.llm import near_dedup, substring_dedup, suffix_dedup

    odd = stored.unionByName(stored.limit(1).withColumn("doc_id", packing.F.lit(None).cast("long"))).selectExpr("*", "1 AS shard", "2 AS slot", "3 AS __x", "4 AS spans")
    n = odd.count()
    assert decontamination.report(odd, benchmark).where("doc_id IS NULL").count() == 1
    for out in (sharding.shuffle_into_shards(odd), packing.pack(odd).select("doc_id").distinct(), quality_rules.judge(odd), near_dedup.report(odd), substring_dedup.report(odd), suffix_dedup.report(odd), substring_dedup.remove(odd), suffix_dedup.remove(odd), decontamination.remove(odd, benchmark, drop_share=1.0)):
        assert out.count() == n
    assert near_dedup.keep_one(odd).columns == odd.columns and sharding.shuffle_into_shards(odd).columns.count("shard") == 1
