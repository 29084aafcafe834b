"""Packing, merging and chunks against plain loops over whole strings."""

import copy
import os
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import folds, merging, packing
from quire.operators import documents as dc
from quire.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
r = random.Random(11)


def word():
    return "".join(r.choice("abcdefgé.,") for _ in range(r.choice([1, 3, 8, 30])))


def sentence():
    return " ".join(word() for _ in range(r.randrange(1, 12))).capitalize() + r.choice([". ", "! ", " ", ": "])


def test_costs_add_up():
    for _ in range(300):
        parts = [sentence().strip() for _ in range(r.randrange(1, 9))]
        for glue in (" ", "\n"):
            c = [packing.cost(p) for p in parts]
            assert packing.cost(glue.join(parts)) == (sum(x for x, _ in c) + len(parts) - 1, sum(y for _, y in c))


@pytest.mark.parametrize("measure", [packing.by_chars, packing.by_tokens])
def test_packing_by_joining_strings(measure):
    size = lambda t: measure(packing.cost(t))
    for _ in range(300):
        parts, limit = [sentence().strip() for _ in range(r.randrange(0, 12))], r.randrange(5, 90)
        want: list = []
        for p in parts:
            if want and size(want[-1]) + size(p) + 1 <= limit:
                want[-1] += " " + p
            else:
                want.append(p)
        assert packing.packed(parts, limit, measure, " ") == want


def test_table_parts_keep_rows_and_limit():
    for _ in range(300):
        rows = ["| " + " | ".join(r.choice(["", "a b", word(), sentence()]) for _ in range(3)) + " |" for _ in range(r.randrange(1, 9))]
        limit = r.randrange(40, 120)
        parts = packing.split_table("\n".join([rows[0], "| --- | --- | --- |", *rows[1:]]), limit)
        for p in parts:
            lines = p.split("\n")
            if lines[0] == rows[0] and len(lines) > 2:
                assert len(p) <= limit
        for row in rows[1:]:
            assert any(row in p for p in parts) or len(row) + len(rows[0]) > limit - 30


def blocks_of(spec):
    return [folds.Block(f"{t} Heading {t}", page, "heading", t, level, title=f"Heading {t}") if level else folds.Block(t, page) for level, t, page in spec]


def plain_merge(sections, least, most):
    """The least pair of a whole scan, again and again."""
    out = [folds.replace(s, blocks=list(s.blocks)) for s in sections]
    while True:
        branches = {tuple(s.path[:d]) for s in out for d in range(1, len(s.path))}
        pairs = []
        for i, s in enumerate(out):
            for j in (i - 1, i + 1):
                if 0 <= j < len(out) and not s.fixed and not out[j].fixed and s.tokens() < least and tuple(s.path) not in branches:
                    a, b = out[min(i, j)], out[max(i, j)]
                    kin = a.parent == b.parent
                    path = [*a.parent, " ".join(a.joined_index(b)).strip()] if kin else a.path
                    if (kin or a.parent == b.path or b.parent == a.path) and tuple(b.path) not in branches and a.tokens0 + b.tokens0 <= most - packing.tokens(" > ".join(path)):
                        pairs.append((out[j].tokens0, i, j))
        if not pairs:
            return out
        lo, hi = sorted(min(pairs)[1:])
        total = out[lo].tokens0 + out[hi].tokens0
        out[lo].absorb(out.pop(hi))
        out[lo].tokens0 = total


def test_merging_by_whole_scans(monkeypatch):
    for _ in range(120):
        spec, page = [], 1
        for i in range(r.randrange(1, 30)):
            page += r.random() < 0.2
            spec.append((r.randrange(1, 5), f"{r.randrange(1, 5)}.{i}", page) if r.random() < 0.4 else (0, " ".join(sentence() for _ in range(r.randrange(1, 10))).strip(), page))
        sections = folds.build_sections(blocks_of(spec))
        for least, most in ((60, 200), (30, 512), (200, 512)):
            got = merging.merge_short(copy.deepcopy(sections), least, most)
            plain = copy.deepcopy(sections)
            for s in plain:
                s.tokens0 = s.tokens()
            # a joined section keeps the sum of both sizes
            real = folds.Section.tokens
            monkeypatch.setattr(folds.Section, "tokens", lambda s: getattr(s, "tokens0", None) or real(s))
            keep = folds.replace
            monkeypatch.setattr(folds, "replace", lambda s, **k: (lambda n: (setattr(n, "tokens0", s.tokens0), n)[1])(keep(s, **k)) if hasattr(s, "tokens0") else keep(s, **k))
            want = plain_merge(plain, least, most)
            monkeypatch.undo()
            look = lambda q: [(s.number, s.title, s.path, s.display_title, s.page_start, s.page_end, [b.text for b in s.blocks]) for s in q]
            assert look(got) == look(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_chunk_documents_by_plain_python(spark):
    """The query against the same pieces put together in plain Python: overlap, heading lines, parts and links."""
    cfg = folds.ChunkConfig()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    pieces: dict = {}
    for x in dc.pieces(dc.detect_headings(dc.document_blocks(docs)), cfg).collect():
        pieces.setdefault(x["doc_id"], []).append(x)
    got = {x["chunk_id"]: x for x in QUERIES["chunk_documents"](spark, DATA).collect()}
    clean = lambda t: "\n".join(y for y in (" ".join(x.replace("\u00a0", " ").split(" ")).strip() for x in t.split("\n")) if y)
    squeeze = lambda t: __import__("re").sub(" {2,}", " ", clean(t))
    assert len(got) == sum(map(len, pieces.values())) > 100
    carried = 0
    for doc, rows in pieces.items():
        rows.sort(key=lambda x: x["idx"])
        ids = [f"{doc}#p{x['page']}#{k:04d}" for k, x in enumerate(rows)]
        for k, x in enumerate(rows):
            body, again = x["piece"], k > 0 and rows[k - 1]["section_path"] == x["section_path"]
            if again:
                carry = packing.sentences(rows[k - 1]["piece"])[-1].strip()
                if carry and packing.tokens(x["head"]) + packing.tokens(body) + packing.tokens(carry) + 3 <= cfg.max_tokens:
                    body = f"[...] {carry}\n{body}"
                    carried += 1
            first, cut, rest = body.partition("\n")
            if x["head"] and first.strip() and x["head"].endswith(first.strip()):
                body = rest
            g = got[ids[k]]
            same = [y["section_path"] for y in rows]
            if body.isascii():
                assert g["text"] == squeeze(f"{x['head']}\n{body}".strip())
            assert (g["prev_chunk_id"], g["next_chunk_id"]) == (ids[k - 1] if k else None, ids[k + 1] if k + 1 < len(ids) else None)
            assert (g["part_index"], g["part_total"], g["is_continuation"]) == (same[: k + 1].count(same[k]), same.count(same[k]), again)
            assert g["est_tokens"] <= cfg.max_tokens
    assert carried


def test_warnings_reach_the_chunks(spark):
    blocks = dc.document_blocks(spark.createDataFrame([(1, "tiny")], "doc_id long, text string"))
    assert dc.chunks(dc.detect_headings(blocks)).first()["warnings"] == ["very short"]
    assert dc.chunks(dc.detect_headings(blocks.filter(F.lit(False)))).count() == 0


def test_headings_and_sections_need_one_shuffle_each(spark):
    """The patterns of all lines are tried once: no join of the blocks with their own marks."""
    docs = spark.createDataFrame([(1, "1. One\ntext\n2. Two")], "doc_id long, text string")
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    headed = dc.detect_headings(dc.document_blocks(docs))
    assert plan(headed).count("Exchange") == 1 and "Join" not in plan(headed)
    assert plan(dc.sections(headed)).count("Exchange") == 2
