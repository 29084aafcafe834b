import os
import random
import re
import time

from pyspark.sql import functions as F

import corpus_pipeline as cp

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, at = docs.columns, docs
    kept = {}
    for name, stage in cp.STAGES:
        at = cp.written(stage(spark, at, DATA))
        kept[name] = at.count()
        assert name == cp.STAGES[-1][0] or at.columns == columns
    assert kept["near-dedup"] < kept["language ID"] and kept["decontamination"] < kept["near-dedup"] and kept["sharding"] == kept["source mixing"]


def test_empty(spark):
    at = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        at = stage(spark, at, DATA)
    assert at.count() == 0


def test_stages_on_edge_rows(spark):
    """Nulls, repeated rows, a long text and clashing names in every column."""
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "one two three four five six", "en", "a"), (3, "one two three four five six", "en", "a"), (None, "null id here with words", None, None), (None, "null id here with words", None, None), (5, "word " * 30000, "en", "b"), (6, "one two three four five six", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    for name in "_kept kept rows row key h no copies _c id of n entry".split():
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    at = docs
    for name, stage in cp.STAGES:
        at = cp.written(stage(spark, at, DATA))
        assert at.columns[: len(docs.columns)] == docs.columns and {x["key"] for x in at.collect()} == {"own key"}, name
        if name == "near-dedup":
            assert sorted(str(x["doc_id"]) for x in at.collect()) == ["3", "5", "None", "None"]


def brute_force(rows, benchmark, told, copies):
    """The pipeline in plain Python, given the told languages and the copies of the mix: the rows before sharding."""
    blank = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    kept = [{**r, "lang": told[r["doc_id"]]} for r in rows if told[r["doc_id"]] != "und"]
    sets = {}
    for r in kept:
        w = blank(r["text"])
        sets[r["doc_id"]] = {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    ids = sorted(sets)
    for k, j in enumerate(ids):
        for i in ids[:k]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    kept = [r for r in kept if find(r["doc_id"]) == r["doc_id"]]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = set()
    for t in benchmark:
        w = words(t)
        windows |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1))} if w else set()
    sizes = {len(w) for w in windows}

    def hit(t):
        w = words(t)
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    clean = [r for r in kept if not hit(r["text"])]
    return len(sets), len(kept), clean, [r for r in clean for _ in range(copies.get(r["doc_id"], 0))]


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    told = {r["doc_id"]: r["lang_pred"] for r in cp.language_id.identify(docs, cp.language_id.fit(docs)).collect()}
    benchmark = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    n_told, n_near, clean, _ = brute_force(rows, benchmark, told, {})
    mixed = {r["doc_id"]: r for r in cp.mixing.mix(spark.createDataFrame(clean, docs.schema)).collect()}
    assert sorted(mixed) == sorted(r["doc_id"] for r in clean) and len(clean) < n_near < n_told
    for r in clean:
        assert mixed[r["doc_id"]]["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want = brute_force(rows, benchmark, told, {i: r["copies"] for i, r in mixed.items()})[3]
    got = cp.run(spark, DATA).collect()
    assert sorted(str([r[c] for c in docs.columns]) for r in got) == sorted(str([r[c] for c in docs.columns]) for r in want)
    by: dict = {}
    for r in got:
        assert r["n_bytes"] == len((r["text"] or "").encode())
        by.setdefault(r["shard"], []).append(r)
    assert all(sum(r["n_bytes"] for r in rs) == rs[0]["shard_bytes"] and len(rs) == rs[0]["shard_docs"] for rs in by.values())


def test_near_dedup_shuffles_no_text_that_is_like_no_other(spark):
    r = random.Random(3)
    rows = [(k, " ".join(f"{r.getrandbits(64):x}" for _ in range(3000)), "en", "a") for k in range(120)]
    docs = cp.written(spark.createDataFrame([*rows, (200, rows[7][1], "en", "b"), (7, rows[7][1], "en", "a")], "doc_id long, text string, lang string, source string"))
    moved = lambda: sum(x.totalShuffleWrite() for x in (e.apply(k) for e in [spark.sparkContext._jsc.sc().statusStore().executorList(False)] for k in range(e.size())))
    before = moved()
    got = cp.written(cp.drop_near_duplicates(spark, docs, DATA))
    assert moved() - before < 0.5 * sum(len(x[1]) for x in rows)
    assert sorted(x["doc_id"] for x in got.collect()) == list(range(120))


def test_may_hold_leaves_no_id_out(spark, monkeypatch):
    monkeypatch.setattr(cp.near_dedup, "SLOTS", 1 << 12)
    rows, ids = spark.range(-500, 5000).withColumnRenamed("id", "x"), spark.range(-500, 5000, 13).withColumnRenamed("id", "doc_id")
    rows = rows.union(spark.sql("SELECT CAST(NULL AS LONG)"))
    some, rest = ({x["x"] for x in cp.near_dedup.may_hold(rows, "x", ids, never).collect()} for never in (False, True))
    assert {x["doc_id"] for x in ids.collect()} <= some and not some & rest and len(some) + len(rest) == 5501 and len(rest) > 4000


def test_settled_lets_shuffle_files_go(spark):
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    held = lambda: {f for _, _, files in os.walk(folder) for f in files if f.startswith("shuffle_")}
    table = lambda: cp.near_dedup.settled(spark.range(100000).repartition(7, "id").withColumnRenamed("id", "x"), "t")
    before = held()
    got = table()
    first = held() - before
    time.sleep(1)
    table()
    until = time.time() + 10
    while held() & first and time.time() < until:
        time.sleep(0.2)
    assert got.count() == 100000 and not held() & first
