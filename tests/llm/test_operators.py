"""The corpus operators on small tables: edge cases, and brute force where SQL can't express them."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import chat_format, decontaminate, language_id, line_dedup, mixing, near_dedup, pii, sharding, vector_search

DOCS = "doc_id long, text string, lang string, source string, label string, h string"
EDGE = [(1, None, None, None, "x", "y"), (2, "", "en", "a", None, None), (3, " \n\t ", "en", "a", None, None), (4, "one", "en", None, None, None), (4, "one", "en", None, None, None), (None, "null id here with words", "en", "b", None, None), (5, "word " * 30000, "en", "b", None, None)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS).cache()


def test_chat_round_trip(spark):
    said = ["<|turn|>", r"<\|end|>", "a<", "|b", r"<\\|", "", None, r"\### Assistant: </turn> ok"]
    rows = [(1, k, ["user", "assistant", None, "<|text|>"][k % 4], said[k % 8]) for k in range(200)] + [(None, None, "assistant", "x"), (2, 0, "user", "only")]
    seg = chat_format.format_segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat_format.digests(seg).collect()}
    mine = [(r[2] or "", r[3] or "") for r in rows if r[0] == 1]
    loss = "".join(t for r, t in mine if r == "assistant")
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[1]["loss_chars"] == len(loss)
    assert got[2]["n_examples"] == 0 and got[None]["n_turns"] == 1
    one = chat_format.example_texts(seg).filter("conv_id = 1").orderBy("loss_start").collect()
    assert len(one) == 50 and all(b["context"].startswith(a["context"] + a["target"]) for a, b in zip(one, one[1:], strict=False))
    assert chat_format.digests(chat_format.format_segments(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_chat_digests_come_from_examples(spark, monkeypatch):
    rows = [(1, k, ["user", "assistant"][k % 2], f"t{k}") for k in range(140)] + [(None, None, "assistant", "x"), (2, 0, "user", "only")]
    seg = chat_format.format_segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    real = chat_format.examples
    monkeypatch.setattr(chat_format, "examples", lambda s: real(s).filter("loss_start > 100"))
    want = [t for c, k, r, t in rows if c == 1 and r == "assistant" and sum(len(f"<|turn|>{q}<|text|>{u}<|end|>") for d, j, q, u in rows if d == 1 and j < k) + len("<|turn|>assistant<|text|>") > 100]
    got = {r["conv_id"]: r for r in chat_format.digests(seg).collect()}
    assert 0 < len(want) < 70 and got[1]["n_examples"] == len(want) and got[1]["loss_sha256"] == hashlib.sha256("".join(want).encode()).hexdigest()
    assert got[None]["n_examples"] == 0 and got[2]["loss_chars"] == 0


def _components(sets, percent):
    at = {i: i for i, _ in sets}
    find = lambda i: i if at[i] == i else find(at[i])
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                at[y] = x
    return {i: find(i) for i, _ in sets}


def test_near_duplicates_against_all_pairs(spark, edge):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(4000)}"
    texts = []
    for _ in range(12):
        base = [word() for _ in range(r.randrange(20, 120))]
        for _ in range(20):
            copy = list(base)
            for _ in range(r.randrange(0, 6)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    got = {x["doc_id"]: x for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    sets = [(i, {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}) for i, t in rows for w in [t.split()]]
    want = _components(sets, 85)
    assert {i: x["component_id"] for i, x in got.items()} == want and {i: x["n_shingles"] for i, x in got.items()} == {i: len(s) for i, s in sets}
    found = near_dedup.near_duplicates(edge).collect()
    assert len(found) == len(EDGE) and all(x["n_shingles"] == 0 and x["kept"] for x in found if x["doc_id"] in (1, 2, 3))
    assert near_dedup.near_duplicates(edge.limit(0)).count() == 0


def test_decontamination_edges(spark, edge):
    items = spark.createDataFrame([("i1", "alpha beta gamma"), ("i2", None), ("i3", "One"), ("i3", "One")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x Alpha, BETA gamma y"), (2, "alpha beta"), (3, None), (4, "one!one"), (4, "two")], "doc_id long, text string")
    got = sorted((x["doc_id"], x["n_words"], x["n_hit"], x["n_items"]) for x in decontaminate.contaminated(docs, items).collect())
    assert got == [(1, 5, 3, 1), (2, 2, 0, 0), (3, 0, 0, 0), (4, 1, 0, 0), (4, 2, 2, 1)]
    assert decontaminate.contaminated(edge, items).count() == len(EDGE)
    assert decontaminate.contaminated(edge, items.limit(0)).filter("contaminated").count() == 0


def test_decontamination_without_broadcast(spark, monkeypatch):
    r = random.Random(5)
    items = spark.createDataFrame([(k, " ".join(f"w{r.randrange(2)}" for _ in range(r.randrange(1, 25)))) for k in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(f"w{r.randrange(2)}" for _ in range(k))) for k in range(60)], "doc_id long, text string")
    both = []
    for limit in (10**6, -1):
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
        both.append(sorted(map(tuple, decontaminate.contaminated(docs, items).collect())))
    assert both[0] == both[1] and any(x[-1] for x in both[0])


def test_mixing(spark, edge):
    r = random.Random(1)
    rows = [(k, "w " * r.randrange(0, 50), [None, "a", "b", "c"][min(3, r.randrange(9))]) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == 3000 and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    for s in {x["source"] for x in got}:
        mine = [x for x in got if x["source"] == s]
        assert abs(sum(x["taken"] for x in mine) - mine[0]["target"]) <= 50 and all(x["taken"] <= 2 * x["size"] for x in mine)
    assert abs(sum({x["source"]: x["target"] for x in got}.values()) - 1.5 * sum(x["size"] for x in got)) < 1e-6
    assert mixing.mix(edge).count() == len(EDGE) and mixing.mix(edge.limit(0)).count() == 0


def test_near_duplicates_repeated_ids_tie_their_texts(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(3, a), (5, a), (5, b), (4, c), (6, c), (6, d), (7, d), (8, b), (9, "alone and unlike all the others here")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["component_id"], x["kept"]) for x in got} == {(3, 3, True), (5, 3, False), (8, 3, False), (4, 4, True), (6, 4, False), (7, 4, False), (9, 9, True)} and len(got) == len(rows)


def clashing(docs):
    """docs with extra columns under the names that the operators use inside."""
    for name in "entry one_key _key key row rows h n no page g groups fill room shard shard_docs bad of of_n _h _h2 _bad site line kept _kept copies _c id bytes size least all".split():
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(f"own {name}"))
    return docs


def test_clashing_columns(spark, edge):
    docs = clashing(edge.select("doc_id", "text", "lang", "source"))
    cleaned = line_dedup.remove_boilerplate(docs, 2)
    assert cleaned.columns == [*docs.columns, "n_lines", "n_removed"] and {x["bad"] for x in cleaned.collect()} == {"own bad"}
    found = sharding.shard(docs, 100)
    assert set(docs.columns) <= set(found.columns) and {x["key"] for x in found.collect()} == {"own key"} and found.count() == len(EDGE)
    for made in (near_dedup.near_duplicates(docs), decontaminate.contaminated(docs, spark.createDataFrame([("i", "one")], "item_id string, text string")), mixing.mix(docs), pii.personal_data(docs)):
        assert made.count() == len(EDGE)
    model = language_id.fit(docs)
    assert language_id.identify(docs, model).columns == [*docs.columns, "lang_pred", "lang_score"]
    assert pii.masked(docs).columns == docs.columns and pii.masked(docs).count() == len(EDGE)


def test_mixing_repeats_duel_alone(spark):
    rows = [(1, "w " * 10, "a")] * 100 + [(k, "w " * 10, "a") for k in range(2, 12)] + [(k, "w " * 10, "b") for k in range(100, 200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    mine = [x for x in got if x["source"] == "a"]
    assert len(got) == len(rows) and abs(sum(x["taken"] for x in mine) - mine[0]["target"]) <= 10 and sorted(x["no"] for x in mine if x["doc_id"] == 1) == list(range(1, 101))


def plain_targets(sizes, weights=(3, 1, 2), budget=1.5, limit=2.0):
    """Water filling by repeated dealing."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    left, open_, out = budget * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * w[s] / sum(w[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] > limit * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = limit * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing_targets_by_brute_force(spark):
    r = random.Random(8)
    for n in (1, 2, 5, 9):
        sizes = {s: r.randrange(0, 10 ** r.randrange(1, 6)) for s in [None, "é", "b", "Z", "a", "c", "d", "e", "x"][:n]}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {x["source"]: x["target"] for x in mixing.targets(frame).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_sharding(spark, edge):
    rows = [(k, "x" * (5 + k % 40)) for k in range(2000)] + [(9999, "y" * 5000)] + [(7777, "z" * 90)] * 40
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 1000).collect()
    held: dict = {}
    for x in got:
        held.setdefault(x["shard"], []).append(x)
    assert len(got) == len(rows)
    for xs in held.values():
        total = sum(x["n_bytes"] for x in xs)
        assert total == xs[0]["shard_bytes"] and len(xs) == xs[0]["shard_docs"] and (total <= 1000 or (len(xs) == 1 and xs[0]["oversized"]))
    plain = sorted(s for s in held if "." not in s)
    assert not any(b.startswith(a) for a, b in zip(plain, plain[1:], strict=False))
    assert sharding.shard(edge).count() == len(EDGE) and sharding.shard(edge.limit(0)).count() == 0


def test_sharding_pages_one_key_in_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP", 100)
    rows = [(7, "z" * (k % 9)) for k in range(1000)] + [(k, "x" * 30) for k in range(100, 150)]
    held: dict = {}
    for x in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 64).collect():
        held.setdefault(x["shard"], []).append(x)
    assert sum(map(len, held.values())) == len(rows) and all(sum(x["n_bytes"] for x in xs) == xs[0]["shard_bytes"] <= 64 and len(xs) == xs[0]["shard_docs"] for xs in held.values())


def test_language_id(spark, edge):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs)
    held = language_id.identify(docs, model).filter(language_id.is_held_out(F.col("doc_id"), 5, 0) & F.col("lang").isNotNull()).collect()
    assert sum(x["lang"] == x["lang_pred"] for x in held) >= 0.95 * len(held)
    got = {x["doc_id"]: x["lang_pred"] for x in language_id.identify(edge, model).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] != "und"
    assert all(x["lang_pred"] == "und" for x in language_id.identify(edge, language_id.fit(edge.limit(0))).collect())
    assert language_id.identify(edge.limit(0), model).count() == 0
    twice = edge.union(edge).union(spark.createDataFrame([(4, "deux mots ici", "fr", None, None, None)], DOCS))
    a, b = language_id.fit(twice), language_id.fit(twice.orderBy(F.desc("text")))
    assert a.names == b.names and np.array_equal(a.weights, b.weights)


def test_language_scores_by_brute_force():
    texts = ["the cat sat on the mat", "der Hund lief über die Straße", "le chat est là", "the dog and the cat", "und der Mann ist alt", "les enfants sont là bas", "a", "ß"]
    labels = ["en", "de", "fr", "en", "de", "fr", "en", "de"]
    grams = lambda t: {t.lower()[i : i + n] for n in range(1, language_id.ORDER + 1) for i in range(len(t.lower()) - n + 1)}
    rows = np.zeros((len(texts), language_id.BUCKETS), np.uint8)
    for row, t in zip(rows, texts, strict=True):
        language_id.mark_presence(t, row)
        assert row.sum() == len(grams(t))
    model = language_id.Classifier.fit([np.packbits(r).tobytes() for r in rows], labels)
    # kernel ridge over the same landmarks, solved in the plain form
    def held(t):
        row = np.zeros(language_id.BUCKETS, np.uint8)
        language_id.mark_presence(t, row)
        return set(np.flatnonzero(row).tolist())

    kernel = lambda a, b: len(held(a) & held(b)) / (len(held(a)) * len(held(b))) ** 0.5
    full = np.array([[kernel(a, b) for b in texts] for a in texts])
    value, vector = np.linalg.eigh(full)
    features = full @ vector / np.sqrt(value)
    for k, name in enumerate(model.names):
        mine = np.array([x == name for x in labels])
        w = np.where(mine, 0.5 / mine.sum(), 0.5 / (~mine).sum()) * len(texts)
        beta = np.linalg.solve(features.T @ (features * w[:, None]) + language_id.RIDGE * len(texts) * np.eye(len(texts)) / 100, features.T @ (w * np.where(mine, 1, -1)))
        for t in ["the man", "die Katze", "le petit chien"]:
            row = np.zeros(language_id.BUCKETS, np.uint8)
            language_id.mark_presence(t, row)
            want = np.array([kernel(t, b) for b in texts]) @ vector / np.sqrt(value) @ beta
            assert abs(float(row @ model.weights[:, k]) / row.sum() ** 0.5 - want) < 1e-3


def test_pii_base_against_patterns():
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice("ab@.-+ ()1234567890é\n") for _ in range(r.randrange(60)))
        want = pii.in_order([(k, m.start(), m.end()) for k, p in pii.PATTERN.items() for m in p.finditer(text) if pii._holds(k, m[0])])
        base, spans = pii.find(text)
        assert base == want and set(base) <= set(spans)


def test_pii_long_runs_are_linear():
    for text in ("1" * 300_000, "a" * 300_000 + " @ b", "1." * 100_000, "+1" * 100_000, "( " * 100_000, "@ " * 100_000):
        base, spans = pii.find(text)
        assert set(base) <= set(spans)


def test_pii_added_spans_against_all_pairs():
    r = random.Random(9)
    for _ in range(500):
        cuts = sorted(r.sample(range(100), 8))
        base = pii.in_order([(r.choice(pii.KINDS), a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)])
        more = [(r.choice(pii.KINDS), a, a + r.randrange(1, 20)) for a in (r.randrange(100) for _ in range(12))]
        taken = list(base)
        for k, a, b in pii.in_order(more):
            if not any(k == t[0] and a < t[2] and t[1] < b for t in taken):
                taken.append((k, a, b))
        assert pii.in_order(base + pii.added(base, more)) == pii.in_order(taken)


def test_pii_many_mails_take_linear_time():
    took = []
    for n in (4_000, 16_000):
        text = "bob@mail.org " * n + "＠"
        began = time.process_time()
        base, spans = pii.find(text)
        took.append(time.process_time() - began)
        assert len(base) == n == len(spans)
    assert took[1] < 10 * took[0] + 0.5


def test_pii_disguises(spark, edge):
    for text, kind, part in [("write bob [at] mail [dot] org soon", "email", "bob [at] mail [dot] org"), ("bоb＠mail.org", "email", "bоb＠mail.org"), ("call +four nine one five one two three four five six seven", "phone", "+four nine one five one two three four five six seven")]:
        assert (kind, text.index(part), text.index(part) + len(part)) in pii.find(text)[1]
    assert not pii.find("we met at noon and at dot . com")[1]
    assert pii.personal_data(edge).count() == len(EDGE) and pii.personal_data(edge.limit(0)).count() == 0
    assert re.fullmatch("[0-9a-f]{64}", pii.personal_data(edge).first()["base_sha256"])


def test_pii_few_spelled_digits_and_bare_at():
    for text, kind, part in [
        ("call +49 151 two three four 5678901 now", "phone", "+49 151 two three four 5678901"),
        ("card 4111 1111 1111 11 one 1, 2020", "card", "4111 1111 1111 11 one 1"),
        ("ask bob at mail.org today", "email", "bob at mail.org"),
        ("host 192.168.one.20 is up", "ip", "192.168.one.20"),
        ("host one nine two dot one six eight dot zero dot 1 is up", "ip", "one nine two dot one six eight dot zero dot 1"),
    ]:
        assert (kind, text.index(part), text.index(part) + len(part)) in pii.find(text)[1], text
    for text in ("we met at noon.Then we left", "one of 3 or two.", "version one.2.3 of 4", "at 10.five.1.999"):
        assert not pii.find(text)[1], text
    for text in ("one " * 60_000, "one . " * 60_000, "a at " * 60_000, "one" + " " * 200_000, "one (" + "( " * 60_000):
        base, spans = pii.find(text)
        assert set(base) <= set(spans)


def test_line_dedup(spark, edge):
    rows = [(k, f"own {k}\nshared\n\nrare {k % 2}", f"s{k % 7}") for k in range(70)] + [(70, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x["doc_id"]: x for x in line_dedup.remove_boilerplate(docs, 7).collect()}
    assert got[3]["text"] == "own 3\n" and got[3]["n_removed"] == 2 and got[70]["text"] is None
    assert line_dedup.remove_boilerplate(docs, 8).filter("n_removed > 0").count() == 0
    assert line_dedup.remove_boilerplate(edge).count() == len(EDGE) and line_dedup.remove_boilerplate(edge.limit(0)).count() == 0


def test_vector_search(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(600, 16)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(k, v.tolist(), k) for k, v in enumerate(x)] + [(600, None, 0), (620, [], 0), (640, [0.0] * 16, 0), (660, [float("nan")] * 16, 0), (680, [1.0], 0), (None, [1.0] * 16, 0), (700, [None] + [1.0] * 15, 0)]
    rows += rows[:50]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score long")
    got: dict = {}
    for y in vector_search.search(docs).collect():
        got.setdefault(y["query_id"], []).append((y["rank"], y["vec_id"], y["score"]))
    hit = 0
    for q in range(0, 600, 20):
        s = vector_search.exact_product(x.astype(float), x[q].astype(float))
        best = [k for k in np.lexsort((np.arange(600), -s)) if k != q][:20]
        mine = [k for _, k, _ in sorted(got[q])]
        hit += len(set(best) & set(mine))
    assert hit >= 0.9 * 30 * 20 and set(got) == set(range(0, 600, 20))
    assert vector_search.search(docs.limit(0)).count() == 0


def test_vector_search_repeated_ids(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), *[(7, [1.0, k / 50]) for k in range(40)], *[(k, [0.5, 0.5]) for k in range(100, 130)]]
    got = [(x["rank"], x["vec_id"], x["score"]) for x in vector_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("query_id = 20").orderBy("rank").collect()]
    want = sorted({(-s, i) for i, v in rows for s in v if i != 20})[:20]
    assert got == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_vector_codes_prune_and_keep_recall():
    v = np.random.default_rng(3).normal(size=(4096, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    q_ids = np.arange(0, 4096, 20)
    q, i, s, ranked = vector_search.nearest(q_ids, v[q_ids], v, np.arange(4097), np.arange(4096), vector_search.encode(v), 20)
    exact = v[q_ids] @ v.T
    exact[np.arange(len(q_ids)), q_ids] = -9
    best = np.argsort(-exact, axis=1)[:, :20]
    assert np.mean([np.isin(a, b).mean() for a, b in zip(best, i, strict=True)]) > 0.99
    assert ranked < 0.1 * exact.size
