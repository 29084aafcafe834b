"""Near-duplicate documents: circulant MinHash, banding and exact Jaccard verification.

1. Each text becomes its set of word shingles, the set a signature and the signature bands. Texts with the same set are one
   class, whose representative is its least doc_id; only representatives go on, so copies cost nothing more.
2. Buckets of equal bands: every representative is held against the least and the greatest of its bucket on the full sets.
   The links found give components.
3. Buckets that still hold several components: their members are compared across components, in blocks of bounded size,
   by whole signatures, and pairs that could still reach the threshold on the full sets, until they are joined.
Pairs inside a component need no comparison, so a coherent group of n texts costs n comparisons, not n squared, and no link
between different components is left out.

`bands_for` picks the number of bands so that a pair at the threshold shares none with a chance of 1e-7; step 3 leaves out
pairs whose signatures agree by more than 5 standard deviations less than the threshold (3e-7).

Defined results: null and blank texts have no shingles and are linked with nothing; a null doc_id can't be named by a group, so
its row stays alone (component_id null, kept); rows that repeat a doc_id are one document with several texts, linked by any
of them; repeated rows are equal sets of one class; ties go to the smaller doc_id; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shingles as sh
from .common import table, written
from .components import connected_components

ROWS = 5
BLOCK = 512
#: Bits of the filter that keeps texts out of a shuffle: at most SLOTS / 64 rows are broadcast.
SLOTS = 1 << 26


def bands_for(percent: int) -> int:
    return math.ceil(math.log(1e-7) / math.log(1 - (percent / 100) ** ROWS))


def _slot(c: Column) -> Column:
    return F.pmod(F.xxhash64(c.cast("long")), F.lit(SLOTS))


def id_filter(ids: DataFrame) -> DataFrame:
    """(word, bits): the bits of the slots of all ids (doc_id), 64 a row."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(63).cast("int"))
    return ids.select(_slot(F.col("doc_id")).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(one).alias("bits"))


def may_hold(rows: DataFrame, col: str, ids: DataFrame, never: bool = False) -> DataFrame:
    """The rows whose id in col may be one of ids (doc_id): all that are and a few others, found without a shuffle of the rows; never: the rest."""
    slot = _slot(F.col(col))
    at = (F.shiftright(slot, 6) == F.col("word")) & (F.getbit("bits", slot.bitwiseAND(63).cast("int")) == 1)
    return rows.join(F.broadcast(id_filter(ids)), at, "left_anti" if never else "left_semi")


def settled(df: DataFrame, name: str) -> DataFrame:
    """written, with the shuffle files of the tables settled before let go: Spark drops them once the driver collects garbage, which it may
    put off till the end."""
    out = written(df, name=name)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64), kind))


def sketch(docs: DataFrame, words: int, bands: int, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n, d1, d2, low, bands): set size, set digest, low bytes of the signature, band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, d1, d2, low, keys = [], [], [], [], []
                for x in part.column(1):
                    s = sh.shingle_set(x.as_py(), words)
                    a, b = sh.set_digest(s)
                    n.append(len(s)), d1.append(a), d2.append(b)
                    least = sh.signature(s, bands * ROWS) if len(s) else np.empty(0, np.uint32)
                    low.append(least.astype(np.uint8).tobytes())
                    keys.append(sh.band_hashes(least, ROWS) if len(s) else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(low, pa.binary()), _lists(keys, pa.int64())], ["doc_id", "n", "d1", "d2", "low", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, d1 long, d2 long, low binary, bands array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, s): the shingles of each of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([sh.shingle_set(x.as_py(), words).astype(np.int64) for x in part.column(1)], pa.int64())], ["doc_id", "s"])

    return docs.mapInArrow(run, "doc_id long, s array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").filter(F.size("sa") > 0).join(right, "b")
    near = both.filter((100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb"))))
    common = near.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
    return common.filter(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("t") - F.col("i"))).select("a", "b")


def _across(percent: int, coordinates: int):
    """mapInArrow over blocks of buckets: links between different components, on the full sets. Pairs that share an earlier
    band are left to that band; pairs that links found here have joined need no comparison. At most one link for each
    member comes out of a block."""
    p = percent / 100
    floor = (p - 5 * math.sqrt(p * (1 - p) / coordinates)) * coordinates
    fields = ("key", "i", "j")

    def links_of(g: dict, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        first, second = np.flatnonzero(g["own"] == g["i"][0]), np.flatnonzero(g["own"] == g["j"][0])
        low, bands, comp, rep = g["low"], g["bands"], g["comp"], g["rep"]
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        for at in range(0, len(first), 64):
            x = first[at : at + 64]
            ok = (comp[x][:, None] != comp[second][None]) & (rep[x][:, None] < rep[second][None] if g["i"][0] == g["j"][0] else True)
            a, b = np.nonzero(ok)
            if not len(a):
                continue
            a, b = x[a], second[b]
            alike = (low[a] == low[b]).sum(1)
            keep = alike >= floor
            a, b, alike = a[keep], b[keep], alike[keep]
            keep = (bands[a] == bands[b]).argmax(1) == g["band"][a]
            a, b, alike = a[keep], b[keep], alike[keep]
            for k in np.argsort(-alike, kind="stable"):
                u, v = find(int(comp[a[k]])), find(int(comp[b[k]]))
                if u == v:
                    continue
                s, t = sets[a[k]], sets[b[k]]
                if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                    continue
                at_t = np.searchsorted(t, s)
                common = int((t[np.minimum(at_t, len(t) - 1)] == s).sum())
                if 100 * common >= percent * (len(s) + len(t) - common):
                    root[max(u, v)] = min(u, v)
                    yield int(rep[a[k]]), int(rep[b[k]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            g = {k: t.column(k).to_numpy() for k in ("key", "i", "j", "own", "band", "rep", "comp")}
            g["low"] = np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint8).reshape(t.num_rows, coordinates)
            g["bands"] = t.column("bands").combine_chunks().flatten().to_numpy().reshape(t.num_rows, coordinates // ROWS)
            s = t.column("s").combine_chunks()
            ends, flat = np.concatenate([[0], np.cumsum(s.value_lengths().to_numpy())]), s.flatten().to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.any([g[f][1:] != g[f][:-1] for f in fields], axis=0)) + 1
            found = []
            for lo, hi in zip([0, *cuts], [*cuts, t.num_rows], strict=True):
                found += links_of({k: v[lo:hi] for k, v in g.items()}, [flat[ends[k] : ends[k + 1]] for k in range(lo, hi)])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], ["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            keys = [t.column(f).to_numpy() for f in fields]
            same = np.all([k == k[-1] for k in keys], axis=0)
            cut = t.num_rows - int(same.sum())  # rows are sorted: the last group may go on
            if cut:
                yield from done(pa.concat_tables([*held, t.slice(0, cut)]))
                held = [t.slice(cut)]
            elif held and any(held[-1].column(f)[0].as_py() != k[-1] for f, k in zip(fields, keys, strict=True)):
                yield from done(pa.concat_tables(held))
                held = [t]
            else:
                held.append(t)
        if held:
            yield from done(pa.concat_tables(held))

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    bands = bands_for(percent)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = written(sketch(texts, words, bands), name="sketch")
    usable = sketches.filter("n > 0 AND doc_id IS NOT NULL")
    classes = settled(usable.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    first = F.row_number().over(W.partitionBy("n", "d1", "d2").orderBy("doc_id"))
    reps = settled(usable.withColumn("first", first).filter("first = 1").select(F.col("doc_id").alias("rep"), "low", "bands"), "reps")
    banded = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    ends = banded.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi")
    members = settled(banded.join(ends, "key"), "members")

    star = members.select("rep", F.explode(F.array("lo", "hi")).alias("end")).filter("rep <> end").select(F.least("rep", "end").alias("a"), F.greatest("rep", "end").alias("b")).distinct()
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = settled(full_sets(may_hold(texts, "doc_id", wanted).join(wanted, "doc_id", "left_semi"), words), "sets")
    # rows that repeat a doc_id with different texts tie the classes of these together
    own = usable.select("doc_id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"]).select("doc_id", "rep").distinct()
    several = own.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("doc_id")
    tied = own.join(several, "doc_id").filter("doc_id <> rep").select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b"))
    links = settled(verified(star, sets, percent).union(tied), "links")
    found = connected_components(links)

    labelled = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "band", "rep", F.coalesce("label", "rep").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("m")).filter("c0 < c1").select("key", F.ceil(F.col("m") / BLOCK).alias("blocks"))
    left = labelled.join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = left.join(reps, "rep").join(sets.withColumnRenamed("doc_id", "rep"), "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", F.col("band").cast("long").alias("band"), "rep", "comp", "low", "bands", "s"
    )
    more = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_across(percent, bands * ROWS), "a long, b long").distinct()
    found = connected_components(links.union(more))

    classes = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("n", "d1", "d2", F.coalesce("label", "rep").alias("component"))
    rows = sketches.select("doc_id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 3-word shingles, Jaccard of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN array_to_string(words, ' ') ELSE array_to_string(list_slice(words, i, i + 2), ' ') END AS sh
  FROM w, unnest(range(1, greatest(len(words) - 1, 2))) AS t(i) WHERE len(words) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM inter JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)
), both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT DISTINCT a AS doc_id, a AS seen FROM both_ways
  UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.seen
), comp AS (SELECT doc_id, min(seen) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, d.doc_id = coalesce(c.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp c USING (doc_id)
"""
