"""Operators of the subpackage against brute force, round trips and held-out labels."""

import glob
import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialloom.llm import catalog, language, mixing, packing, percentiles, tokens
from trialloom.llm.nearest import nearest_in_time

TOKENIZER = os.path.exists(tokens.TOKENIZER)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(name, spark, sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    a, b = catalog.queries()[name](spark, sf).toPandas(), c.sql(catalog.oracle_sql()[name]).df()[catalog.queries()[name](spark, sf).columns]
    keys = list(a.columns)
    a, b = (x.sort_values(keys).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


# --- nearest -------------------------------------------------------------------------------------------------------


def test_nearest_against_all_pairs(spark):
    rng = random.Random(1)
    left = [(i, rng.choice([1, 2]), round(rng.uniform(0, 5), 3)) for i in range(400)]
    right = [(1000 + i, rng.choice([1, 2, 3]), round(rng.uniform(0, 5), 3)) for i in range(300)]
    left += left[:30] + [(900, 1, None), (901, None, 1.0), (902, 1, float("nan")), (903, 1, float("inf")), (None, 1, 1.0)]
    right += right[:30] + [(1900, 1, None), (1901, 2, float("-inf"))]
    schema = "id long, entity int, time double"
    a, b = spark.createDataFrame(left, schema).withColumn("hit", F.lit(1)), spark.createDataFrame(right, schema).withColumn("bucket", F.lit(2))
    got = {r["left_id"]: r["right_id"] for r in nearest_in_time(a, b, 0.01).collect()}
    ok = lambda t: t is not None and np.isfinite(t)
    want = {}
    for i, e, t in left:
        if i is not None and e is not None and ok(t):
            near = sorted((abs(t - u), u, j) for j, f, u in right if f == e and ok(u) and abs(t - u) <= 0.01)
            want[i] = near[0][2] if near else None
    assert got == want
    assert nearest_in_time(a.limit(0), b, 1.0).count() == 0 and nearest_in_time(a, b.limit(0), 1.0).where("right_id IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        nearest_in_time(a, b, 0)


def test_nearest_at_large_times_and_of_clashing_ids(spark):
    schema = "id long, entity int, time double"
    far = 1.7e18
    a = spark.createDataFrame([(1, 10, 5.0), (1, 20, 1.0), (2, 1, far), (3, 1, -1e300), (4, 1, 1.5e15)], schema)
    b = spark.createDataFrame([(100, 10, 1.0), (101, 10, 5.01), (102, 1, far), (103, 1, -1e300), (104, 1, 1.5e15 + 0.25), (105, 10, 5.0), (105, 20, 5.0), (105, 2, 9.0)], schema)
    got = {r["left_id"]: (r["right_id"], r["distance"]) for r in nearest_in_time(a, b, 0.3).collect()}
    assert got[1][0] == 101 and got[2] == (102, 0) and got[3] == (103, 0) and got[4] == (104, 0.25)


# --- percentiles ---------------------------------------------------------------------------------------------------


def analog(spark, n=4000, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(r, i, c, float(np.round(rng.normal(c, 1 + r), 2))) for r in range(4) for c in range(3) for i in range(n // 4)]
    rows += rows[:500] + [(0, 10**6, 0, None), (0, 10**6 + 1, 0, float("nan")), (0, 10**6 + 2, 0, float("inf")), (9, 1, 7, 5.0)]
    rec = spark.createDataFrame([(0, "2024-01-01 10:00:00"), (1, "2024-01-01 11:00:00"), (2, "2024-01-02 10:00:00"), (3, None)], "recording_id int, t string").select("recording_id", F.col("t").cast("timestamp").alias("utc_start_time"))
    return spark.createDataFrame(rows, "recording_id int, sample int, channel_id int, value double").withColumn("day", F.lit("x")), rec, rows


def test_multi_select_is_exact(spark, monkeypatch):
    df, rec, rows = analog(spark)
    blocks = percentiles.value_blocks(df.repartition(7), rec).persist()
    days = {0: "a", 1: "a", 2: "b"}
    seen = {(r, c, i): v for r, i, c, v in rows if v is not None and not np.isnan(v)}
    for keys, of in ((["channel_id"], lambda r, c: c), (["day", "channel_id"], lambda r, c: (days.get(r), c))):
        groups = {}
        for (r, c, _), v in seen.items():
            groups.setdefault(of(r, c), []).append(v)
        for few in (1 << 20, 0):  # broadcast and joined
            monkeypatch.setattr(percentiles, "BROADCAST_BYTES", few)
            got = percentiles.multi_select(blocks, keys, [0.0, 0.5, 0.9, 1.0]).toPandas()
            assert len(got) == 4 * len(groups)
            by_n = sorted((g.n.iloc[0], tuple(g.sort_values("q").value)) for _, g in got.groupby(keys, dropna=False))
            want = sorted((len(v), tuple(sorted(v)[int(np.floor(q * (len(v) - 1)))] for q in (0.0, 0.5, 0.9, 1.0))) for v in groups.values())
            assert by_n == want
    blocks.unpersist()
    assert percentiles.multi_select(percentiles.value_blocks(df.limit(0), rec), ["channel_id"], [0.5]).count() == 0


def test_scopes_in_the_same_rounds(spark):
    df, rec, _ = analog(spark, 1200)
    blocks = percentiles.value_blocks(df, rec).persist()
    both = percentiles.multi_select_scopes(blocks, [["channel_id"], ["day", "channel_id"]], [0.25, 0.5])
    for scope, keys in enumerate((["channel_id"], ["day", "channel_id"])):
        a = both.where(F.col("scope") == scope).select(*keys, "n", "q", "value").toPandas().sort_values([*keys, "q"]).reset_index(drop=True)
        b = percentiles.multi_select(blocks, keys, [0.25, 0.5]).toPandas().sort_values([*keys, "q"]).reset_index(drop=True)
        pd.testing.assert_frame_equal(a, b)
    blocks.unpersist()


def test_copies_in_any_order(spark):
    _, rec, _ = analog(spark, 40)
    rows = [(0, 1, 0, float("nan")), (0, 1, 0, 3.0), (0, 2, 0, 1.0), (0, 2, 0, 2.0), (0, 3, 0, None), (0, 10**11, 0, 9.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "recording_id int, sample long, channel_id int, value double").coalesce(1)
        got = percentiles.multi_select(percentiles.value_blocks(df, rec), ["channel_id"], [0.0, 0.5, 1.0]).orderBy("q").collect()
        assert [(r["n"], r["value"]) for r in got] == [(3, 2.0), (3, 3.0), (3, 9.0)]


def test_missed_brackets_take_the_median():
    """Pivots that always miss still end: the next one is the weighted median of the proposals."""
    step = percentiles._decide(1)
    v = np.sort(np.random.default_rng(0).normal(size=5000))
    state = {"scope": 0, "k0": 1, "k": [10], "lo": [float("nan")], "hi": [float("nan")], "p1": [v[3000]], "p2": [v[4000]], "value": [float("nan")]}
    (report,) = percentiles._report([[0]], 1)(iter([language.pa.RecordBatch.from_pylist([{"k0": 1, "vals": v.tobytes(), "state0": {f: state[f] for f in ("lo", "hi", "p1", "p2")}}])]))
    rows = [state | {"counts": None, "props": None}, dict.fromkeys(percentiles.FIELDS) | report.to_pylist()[0]]
    (out,) = step(iter([language.pa.RecordBatch.from_pylist(rows)]))
    (new,) = out.to_pylist()
    assert new["hi"] == [v[3000]] and new["p1"] == new["p2"] and 1300 < np.searchsorted(v, new["p1"][0]) < 1700


def test_blocks_without_values_in_the_range_propose_no_pivot():
    """The target is the least of the open range, and a block of another task lies wholly below it."""
    report, step = percentiles._report([[0]], 1), percentiles._decide(1)
    blocks = [np.arange(10.0), np.arange(10.0, 1010.0)]
    state = {"scope": 0, "k0": 1, "k": [3], "lo": [9.5], "hi": [float("nan")], "p1": [12.0], "p2": [900.0], "value": [float("nan")], "open": True}
    while state["open"]:
        limits = {f: state[f] for f in ("lo", "hi", "p1", "p2")}
        reports = [r for v in blocks for b in report(iter([language.pa.RecordBatch.from_pylist([{"k0": 1, "vals": v.tobytes(), "state0": limits}])])) for r in b.to_pylist()]
        rows = [state | {"counts": None, "props": None}, *[dict.fromkeys(percentiles.FIELDS) | r for r in reports]]
        (out,) = step(iter([language.pa.RecordBatch.from_pylist(rows)]))
        (state,) = out.to_pylist()
        assert not state["open"] or state["p1"] > state["lo"]
    assert state["value"] == [13.0]


def test_ladder_errors_do_not_grow_with_the_number_of_blocks():
    rng = np.random.default_rng(1)
    ladder, values = percentiles.Ladder(), []
    for i in range(4000):
        v = np.sort(rng.normal(i % 7, 1 + i % 3, 64))
        values.append(v)
        ladder.add((np.tile(v[np.floor(percentiles.GRID * 64).astype(int)], (3, 1, 1)), np.full((3, 1, 16), 4.0)))
    median = percentiles._quantiles(ladder.all(), 1)[0][0, 0, 0]
    assert abs((np.concatenate(values) < median).mean() - 0.5) < 1 / 16


def test_summaries_of_days_add_up(spark):
    df, rec, rows = analog(spark, 8000)
    blocks = percentiles.value_blocks(df, rec)
    seen = {(r, k, i): x for r, i, k, x in rows if x is not None and not np.isnan(x)}
    for points, blocks_points in ((1024, 64), (16, 16)):
        parts = percentiles.summaries(blocks, blocks_points)
        days = percentiles.merged(parts.unionByName(parts.limit(0)), ["day", "channel_id"], points, 3)
        got = percentiles.combine(days, ["channel_id"], [0.0, 0.1, 0.5, 0.9, 1.0], points).toPandas()
        assert got.rank_error.max() < (1 / 64 if points == 1024 else 0.3)
        for c in (0, 1, 2, 7):
            v = np.sort([x for (r, k, i), x in seen.items() if k == c])
            for row in got[got.channel_id == c].itertuples():
                lo, hi = np.searchsorted(v, row.value, "left"), np.searchsorted(v, row.value, "right")
                want = np.floor(row.q * (len(v) - 1))
                assert row.n == len(v) and lo - row.rank_error * len(v) <= want <= hi - 1 + row.rank_error * len(v)


def test_merging_many_summaries_stays_bounded():
    rng = np.random.default_rng(2)
    batches, values = [], []
    for i in range(300):
        v = np.sort(np.round(rng.normal(i / 50, 1, 500), 1))
        values.append(v)
        (b,) = percentiles._summarise(32)(iter([language.pa.RecordBatch.from_pylist([{"k": 1, "vals": v.tobytes()}])]))
        batches.append(b)
    (out,) = percentiles._merge(1, 50)(iter(batches))
    (row,) = out.to_pylist()
    x, w = np.frombuffer(row["vals"], "<f8"), np.frombuffer(row["weights"], "<i8")
    whole = np.sort(np.concatenate(values))
    assert len(x) <= 50 and w.sum() == len(whole) == row["n"] and row["slack"] < 0.2 * len(whole)
    for at in rng.normal(3, 3, 200):
        assert abs(w[x <= at].sum() - np.searchsorted(whole, at, "right")) <= row["slack"]


# --- packing -------------------------------------------------------------------------------------------------------


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(capacity - s)
    return sorted(gaps)


def test_runs_are_best_fit_decreasing():
    rng = random.Random(2)
    for capacity in (10, 50, 101):
        sizes = [rng.randint(1, capacity) for _ in range(200)]
        counts = {s: sizes.count(s) for s in sizes}
        left = {}
        for size, a, b, first, per in packing.best_fit_runs(list(counts.items()), capacity):
            for k in range(a, b):
                bin_ = first + (k - a) // per
                left[bin_] = left.get(bin_, capacity) - size
        assert sorted(left.values()) == best_fit_decreasing(sizes, capacity) and min(left.values()) >= 0
        assert sorted(left) == list(range(len(left)))


def test_pack(spark):
    rng = random.Random(4)
    sizes = [(i, rng.choice([0, 3, 7, 7, 7, 12, 64, 65, 300])) for i in range(500)]
    df = spark.createDataFrame(sizes + sizes[:40] + [(None, 5), (777, None)], "doc_id long, n_tokens long").withColumn("container", F.lit(3))
    budgets = spark.createDataFrame([(1, 64), (2, 1000), (3, None), (None, 9), (4, -1)], "budget_id int, capacity int")
    got = packing.pack(df, budgets, salts=3).toPandas()
    for budget, cap in ((1, 64), (2, 1000)):
        g = got[got.budget_id == budget]
        assert g.groupby("container").n_tokens.sum().max() <= cap
        assert g.groupby("doc_id").n_tokens.sum().to_dict() == dict(sizes) | {777: 0}
        whole = g.groupby("doc_id").size()
        assert all(n == max(1, -(-dict(sizes).get(d, 0) // cap)) for d, n in whole.items())
        assert sorted(g.container.unique()) == list(range(g.container.max() + 1))
    report = packing.fill(packing.pack(df, budgets), budgets).toPandas().set_index("budget_id")
    assert report.loc[1, "n_tokens"] == sum(s for _, s in sizes) and (report.unused < 0.2).all() and (report.least <= report.containers).all()
    for budget, cap in ((1, 64), (2, 1000)):
        pieces = [p for _, s in sizes for p in [cap] * (s // cap if s > cap else 0) + [s % cap if s > cap else s] if p]
        assert report.loc[budget, "containers"] == len(best_fit_decreasing(pieces, cap))
    assert packing.pack(df.limit(0), budgets).count() == 0 and packing.pack(df, budgets.limit(0)).count() == 0


# --- mixing --------------------------------------------------------------------------------------------------------


def test_mix_reaches_its_shares(spark):
    rng = random.Random(5)
    docs = [(i, "abc"[min(2, i % 7)], rng.randint(1, 200)) for i in range(2000)]
    df = spark.createDataFrame(docs + docs[:50] + [(None, "a", 4), (5000, None, 3), (5001, "a", 0), (5002, "a", None)], "doc_id long, source string, n_tokens long").withColumn("slot", F.lit(1))
    targets = spark.createDataFrame([(1, "a", 1.0, 5), (1, "b", 1.0, 5), (1, "nobody", 1.0, 5), (2, "c", 9.0, 1), (2, "a", 1.0, 2), (3, "a", 0.0, 2), (None, "a", 1.0, 1), (4, "a", None, 1)], "mix_id int, source string, weight double, max_repeat int")
    drawn = mixing.mix(df, targets, 128)
    rows = drawn.toPandas()
    assert not rows.duplicated(["mix_id", "doc_id", "repetition"]).any() and set(rows.mix_id) == {1, 2}
    for (m, _), g in rows.groupby(["mix_id", "source"]):
        assert g.groupby("doc_id").size().max() <= (5 if m == 1 else 2)
    share = rows.groupby(["mix_id", "source"]).n_tokens.sum()
    assert abs(share[1, "a"] / share[1].sum() - 0.5) < 0.03 and abs(share[2, "c"] / share[2].sum() - 0.9) < 0.03
    report = mixing.shares(drawn, targets).toPandas().set_index(["mix_id", "source"])
    assert report.loc[(1, "nobody"), "n_tokens"] == 0 and report.loc[(1, "a"), "repeats"] >= 2
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0


def test_schedule_points():
    u = mixing.van_der_corput(np.arange(16)) / 2.0**mixing.BITS
    assert sorted(u) == [i / 16 for i in range(16)] and list(u[:4]) == [0, 0.5, 0.25, 0.75]
    points = np.sort(np.random.default_rng(0).integers(0, 1 << mixing.BITS, 50))
    points[[0, -1]] = 0, 1 << mixing.BITS
    for n in (0, 1, 37, 1000, 4096):
        assert list(mixing.slots_before(n, points)) == [(mixing.van_der_corput(np.arange(n)) < p).sum() for p in points]


def test_schedule_of_many_slots_is_even(spark):
    rows = [(1, "a", 0.0, 0.3, 20_000_000), (1, "b", 0.3, 1.0, 20_000_000), (2, "a", 0.0, 1.0, 70_000)]
    targets = spark.createDataFrame(rows, "mix_id int, source string, lo double, hi double, slots long")
    made = mixing.schedule(targets)
    sizes = [r["n"] for r in made.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 20_070_000 and max(sizes) <= 2 * sum(sizes) / len(sizes) and len(sizes) > 200
    per = made.groupBy("mix_id", "source").agg(F.count("*").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.sum("rank").alias("s")).collect()
    assert all(r["lo"] == 0 and r["hi"] == r["n"] - 1 and 2 * r["s"] == r["n"] * (r["n"] - 1) for r in per) and all(any(abs(r["n"] - n) < 20 for n in (6_000_000, 14_000_000, 70_000)) for r in per)
    head = made.where("mix_id = 1 AND slot < 200000").orderBy("slot").toPandas()
    for _, g in head.groupby("source"):
        assert list(g["rank"]) == list(range(len(g)))


@pytest.mark.skipif(not TOKENIZER, reason="no tokenizer file")
def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "x" * 100_000)], "doc_id long, text string").withColumn("n_tokens", F.lit(9))
    n = {r["doc_id"]: r["n_tokens"] for r in tokens.with_tokens(df, ["doc_id"]).collect()}
    enc = tokens.encoder(tokens.TOKENIZER)
    assert n[1] == 2 and n[2] == n[3] == 0 and n[4] > 1 and n[5] > 0
    assert enc.decode(enc.encode_ordinary("hello world")) == "hello world"


# --- languages -----------------------------------------------------------------------------------------------------


def test_automaton_knows_every_substring():
    text = "abracadabra abba"
    a = language.Automaton(text)
    root = a.linked()
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            assert language.phrases(root, text[i:j]) == 1
    assert language.phrases(root, "zz") == 2 and language.phrases(root, "abrz") == 2 and language.phrases(root, "brabra") >= 2


def longest_matches(corpus, text):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in corpus:
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n


def test_phrases_against_brute_force():
    rng = random.Random(0)
    for _ in range(200):
        corpus = "".join(rng.choice("abc") for _ in range(30))
        text = "".join(rng.choice("abcd") for _ in range(12))
        a = language.Automaton(corpus)
        want = longest_matches(corpus, text)
        assert a.phrases(text) == want == language.phrases(language.Automaton(corpus).linked(), text)


def test_labels_in_other_forms(spark):
    forms = {"EN": "en", "en_GB": "en", "deu": "de", "German": "de", "pt-BR": "pt", " fra ": "fr", "\u00a0ja\t": "ja", "Brazilian": None} | dict.fromkeys((None, "", "und", "zxx", "n/a", "unknown", "-", "zz-en"))
    df = spark.createDataFrame([(k,) for k in forms], "lang string")
    assert {r[0]: r[1] for r in df.select("lang", language.canonical_label(F.col("lang"))).collect()} == forms


def test_sample_of_a_huge_table_is_not_empty(spark):
    df = spark.createDataFrame([r[:3] for r in corpus(spark)] + [(None, TEXT["en"] + f" {i}", "en") for i in range(20)], "doc_id long, text string, lang string")
    sample = language.labelled_sample(df, language.Fit(), {"en": 10**9, "de": 10**12, "fr": 450})
    assert {lang for lang, _ in sample} == {"en", "de", "fr"}
    share = 450 / 10**9
    hashes = spark.range(1, 2_000_001).select(F.xxhash64("id").alias("h"))
    assert 200 < hashes.where(language.below_share(F.col("h"), share * 500)).count() < 700
    # documents without an id are drawn one by one
    nulls = df.where("doc_id IS NULL").withColumn("h", F.xxhash64("text", F.lit(7)))
    assert nulls.where(language.below_share(F.col("h"), 0.5)).count() not in (0, 20)


def test_sampled_lines_are_not_a_prefix():
    how = language.Fit(chars_per_document=200)
    text = "\n".join(f"eine zeile nummer {chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600))
    batch = language.pa.RecordBatch.from_pydict({"h": [1], "text": [text], "lang": ["de"]})
    (out,) = language._sample_lines(how)(iter([batch]))
    lines = out.column(2)[0].as_py().split("\n")
    assert 0 < sum(map(len, lines)) <= 200 and any(int(x[-2:] > "mm") for x in lines)


def test_messages_of_all_layouts():
    log = "commit " + "a" * 40 + "\r\nAuthor: X <x@y>\r\nDate:   d\r\n\r\n    Subject\r\n\r\n    Body\r\n\r\ndiff --git a/x b/x\r\n+more"
    assert [x for x in language.message_lines(log) if x[1]] == [(4, "Subject"), (6, "Body")]
    mail = "From " + "a" * 40 + " Mon Sep 17 00:00:00 2001\nFrom: X\nSubject: [PATCH] One\n two\n\nBody\n---\n x | 2 +\ndiff --git a b"
    assert [x for x in language.message_lines(mail) if x[1]] == [(2, "[PATCH] One"), (3, "two"), (5, "Body")]
    assert language.message_lines("Subject\n\nBody\ndiff --git a b\n+x")[0] == (0, "Subject")
    for neither in ("Signed-off-by: A <a@b>", "(cherry picked from commit abc)", "----", "    >>> f(1)", "Refs: #12", "v1.2.3", ""):
        assert language.words_of(neither) == ""
    assert language.words_of("[PATCH 2/3] fix(io): Über foo_bar() > x") == "uber x"
    assert language.words_of("差は百万分の604より小さい foo_barです") == "差は百万分の より小さい てす"


TEXT = {
    "en": "the old code read the list twice and then dropped the result nobody noticed this for weeks please check whether it still works as you expect",
    "de": "der alte ablauf hat die liste zweimal gelesen und das ergebnis dann verworfen niemandem ist das wochenlang aufgefallen bitte schaut nach ob es noch so laeuft",
    "fr": "le vieux code lisait la liste deux fois puis jetait le resultat personne ne l a remarque pendant des semaines merci de verifier que tout marche encore",
}


def corpus(spark, seed=0, n=180):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(TEXT))
        words = TEXT[lang].split()
        at = rng.randrange(len(words) - 9)
        label = lang if rng.random() > 0.1 else rng.choice([k for k in TEXT if k != lang])
        rows.append((i, " ".join(words[at : at + 9]) + "\n\nRefs: #1\ndiff --git a b\n+x", label, lang))
    return rows


def test_labels_are_found_and_kept(spark):
    rows = corpus(spark)
    odd = [(1000, None, "en", None), (1001, "", None, None), (1002, "diff --git a b", "en", None), (1003, TEXT["en"] + "\n\n" + TEXT["de"] + "\n\nRefs: #2\n\n" + TEXT["de"], "en", None), (1004, TEXT["fr"] * 300, None, None)]
    df = spark.createDataFrame([r[:3] for r in rows + odd], "doc_id long, text string, lang string").withColumn("segment", F.lit("clash"))
    out = language.label_documents(df).toPandas()
    truth = {r[0]: r[3] for r in rows}
    got = out[out.doc_id < 1000].set_index("doc_id").lang.to_dict()
    assert np.mean([got[d] == t for d, t in truth.items()]) > 0.97
    assert out[out.doc_id.isin([1000, 1001, 1002])].n_segments.eq(0).all()
    two = out[out.doc_id == 1003].sort_values("segment")
    assert list(two.lang) == ["en", "de"] and list(two.first_line) == [0, 2] and list(two.last_line) == [0, 6]
    assert out.confidence.dropna().between(0, 1).all()
    cases = language.mislabelled(language.label_documents(df)).toPandas()
    wrong = {r[0] for r in rows if r[2] != r[3]}
    assert wrong <= set(cases.doc_id) and {1003, 1004} <= set(cases.doc_id)
    assert language.label_documents(df.limit(0)).count() == 0


def test_held_out_labels(spark, sf):
    """Labels of the tables' documents, most of which are right, agree with the languages found."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    out = language.label_documents(d).where("n_segments = 1 AND declared IS NOT NULL").toPandas()
    assert (out.declared == out.lang).mean() > 0.85
