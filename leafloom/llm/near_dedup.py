"""Operator 6: near duplicates by MinHash.

1. Every text gives the minima of many universal hashes over its word shingles, an order-free fingerprint of its whole
   set, and the set's size.  Documents with equal sets form a class; the smallest doc_id represents it.
2. Minima are banded.  Each representative is a candidate with the smallest one of every bucket it is in: as many rows
   as bucket entries, whatever a bucket's size.  Candidates are verified on eight bits of each minimum, far below the
   threshold, and components of what is left are contracted.
3. Only buckets that still hold several components are looked at again: all pairs across components, in large buckets
   in blocks.  So every two representatives that share a bucket are compared or already in one *cluster*.
4. In a cluster the links are confirmed exactly on full sets: in blocks of bounded size that all hold the cluster's
   smallest member too.  Large clusters that this leaves in several parts are compared block by block across the parts
   (blocks of one part are not compared again).  Each block reports a spanning forest of its links, not the links.
5. Components of the confirmed links, by alternating large-star and small-star, give the result.

Defined results: null and empty texts have no shingles and are linked with nothing; rows that share a doc_id are one
document; a row without doc_id belongs to the component of its class if that has one, else it stands alone; an empty
table gives no rows; very long texts are one set like others; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm._common import Scratch, arrow_schema, documents, text_of
from leafloom.llm.components import components
from leafloom.llm.pretoken import _mix, parts_of
from leafloom.llm.textscan import codepoints, runs, separators, span_hashes

SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SMALL_BUCKET, BLOCK = 16, 256


def shingles(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text (ascending), and where each text's begin (with the end)."""
    cps, docs = codepoints(texts)
    n = len(texts)
    if not len(cps):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    low = np.where((cps >= 65) & (cps <= 90), cps + 32, cps)
    starts, ends = runs(~separators(cps), docs)
    word = _mix(span_hashes(low, starts, ends))
    doc = np.searchsorted(docs, starts, "right") - 1
    counts = np.bincount(doc, minlength=n)
    size = np.minimum(counts, words)[doc]  # the whole sequence where there are fewer words
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    whole = np.flatnonzero(np.arange(len(word)) - first[doc] + size <= counts[doc])
    mixed = size[whole].astype(np.uint64)
    for k in range(words):
        use = size[whole] > k
        mixed[use] = (mixed[use] + word[whole[use] + k]) * GOLDEN
    mixed = _mix(mixed)
    order = np.lexsort((mixed, doc[whole]))
    mixed, own = mixed[order], doc[whole][order]
    new = np.ones(len(mixed), bool)
    new[1:] = (mixed[1:] != mixed[:-1]) | (own[1:] != own[:-1])
    mixed, own = mixed[new], own[new]
    return mixed, np.searchsorted(own, np.arange(n + 1))


def _signed(words: int, bands: int, rows: int, seed: int):
    schema = arrow_schema(SIGNED)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rng = np.random.default_rng(seed)
        a = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 1 << 63, bands * rows, np.uint64)
        for batch in batches:
            ids = batch.column(0)
            for i, j, texts in parts_of(batch.column(1)):
                items, at = shingles(texts, words)
                n = at[1:] - at[:-1]
                some = np.flatnonzero(n)
                minima = np.zeros((j - i, bands * rows), np.uint64)
                k1 = k2 = np.zeros(j - i, np.uint64)
                if len(some):
                    for k in range(bands * rows):
                        minima[some, k] = np.minimum.reduceat(items * a[k] + b[k], at[some])
                    k1, k2 = (np.zeros(j - i, np.uint64) for _ in range(2))
                    k1[some] = np.add.reduceat(items, at[some])
                    k2[some] = np.add.reduceat(_mix(items ^ GOLDEN), at[some])
                key = np.zeros((j - i, bands), np.uint64)
                for r in range(rows):
                    key = _mix(key * GOLDEN + minima[:, r::rows])
                key = _mix(key + np.arange(bands, dtype=np.uint64)).view(np.int64)
                sketch = np.ascontiguousarray((minima >> np.uint64(50)).astype(np.uint8))
                lists = [key[d].tolist() if n[d] else [] for d in range(j - i)]
                rows_ = [sketch[d].tobytes() if n[d] else b"" for d in range(j - i)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(lists, pa.list_(pa.int64())), pa.array(rows_, pa.binary())], schema=schema)

    return run


def _alike(least: float):
    """Keeps candidates whose sketches agree in at least this share of places."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(n, -1) for k in (2, 3))
            keep = pa.array((x == y).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return run


def _spanning(n: int, near) -> list[tuple[int, int]]:
    """The components of n nodes as stars: (smallest node, other node); ``near(x)`` marks the neighbours of x."""
    edges, seen = [], np.zeros(n, bool)
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        queue = [root]
        while queue:
            x = queue.pop()
            new = np.flatnonzero(near(x) & ~seen)
            seen[new] = True
            queue += new.tolist()
            edges += [(root, int(y)) for y in new]
    return edges


def forest(sets: list[np.ndarray], percent: int, ids: list[int] | None = None) -> list[tuple[int, int]]:
    """Stars of the components under the links ``100 * intersection >= percent * union`` between sets of distinct hashes.

    Intersections come from products of incidence matrices over bounded ranges of the elements.  Rows that share an id are
    linked too.
    """
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    items, member = np.unique(np.concatenate(sets), return_inverse=True) if n else (np.zeros(0), np.zeros(0, int))
    who = np.repeat(np.arange(n), size)
    order = np.argsort(member, kind="stable")
    member, who = member[order], who[order]
    common = np.zeros((n, n), np.float32)
    step = max(1024, (1 << 22) // max(n, 1))
    for begin in range(0, len(items), step):
        a, b = np.searchsorted(member, (begin, begin + step))
        part = np.zeros((n, min(step, len(items) - begin)), np.float32)
        part[who[a:b], member[a:b] - begin] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    linked &= (size[:, None] > 0) & (size[None, :] > 0)
    if ids is not None:
        linked |= np.equal.outer(np.array(ids, np.int64), np.array(ids, np.int64))
    return _spanning(n, lambda x: linked[x])


def sketch_links(reps: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """``node, component``: representatives (doc_id, bands, sketch) that are linked by sketches, transitively."""
    least = percent / 100 - 0.19
    entry = reps.select(F.explode("bands").alias("bucket"), "doc_id")
    found = entry.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("centre")).where("n > 1")
    shared = scratch.stage(entry.join(found.hint("merge"), "bucket"), "shared")
    sketch = lambda c: reps.select(F.col("doc_id").alias(c), F.col("sketch").alias(f"s{c}")).hint("merge")
    verified = lambda pairs: pairs.join(sketch("u"), "u").join(sketch("v"), "v").select("u", "v", "su", "sv").mapInArrow(_alike(least), "u long, v long")
    stars = shared.where("doc_id <> centre").select(F.col("doc_id").alias("u"), F.col("centre").alias("v")).distinct()
    links = scratch.stage(verified(stars), "stars")
    own = scratch.stage(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")), "own")  # v < u
    step = own.select(F.col("node").alias("label"), F.col("label").alias("next"))
    labels = own.join(step.hint("merge"), "label", "left").select("node", F.coalesce("next", "label").alias("label"))

    # buckets of several labels: pairs across them
    parts = shared.join(labels.hint("merge"), F.col("doc_id") == F.col("node"), "left").select("bucket", "doc_id", "n", F.coalesce("label", "doc_id").alias("part"))
    mixed = parts.groupBy("bucket").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("bucket")
    opened = scratch.stage(parts.join(mixed.hint("merge"), "bucket"), "opened")
    small = opened.where(F.col("n") <= SMALL_BUCKET)
    side = lambda c: small.select("bucket", F.col("doc_id").alias(c), F.col("part").alias(f"p{c}"))
    pairs = side("u").join(side("v"), "bucket").where("u < v AND pu <> pv").select("u", "v").distinct()
    large = opened.where(F.col("n") > SMALL_BUCKET)
    k = F.ceil(F.col("n") / BLOCK).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")
    member = large.join(reps.select("doc_id", "sketch").hint("merge"), "doc_id").select("bucket", "doc_id", "part", "sketch", k.alias("k"), F.pmod(F.xxhash64("doc_id"), k).cast("int").alias("own"))
    grouped = member.select("bucket", "doc_id", "part", "sketch", "own", other).select("bucket", "doc_id", "part", "sketch", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    blocks = grouped.groupBy("bucket", "i", "j").applyInArrow(_alike_block(least), "u long, v long")
    out = components(links.unionByName(verified(pairs)).unionByName(blocks), scratch, "cluster")
    for name in ("shared", "opened", "stars", "own"):
        scratch.drop(name)
    return out


def _alike_block(least: float):
    """Links across labels of a block of a bucket: for each component one link of each label to its smallest member.

    The links inside a label are there already, so any member can stand for its label.
    """

    def run(table):
        import pyarrow as pa

        table = table.sort_by("doc_id")
        ids, parts = (table[c].to_numpy() for c in ("doc_id", "part"))
        rows = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(ids), -1)
        edges = _spanning(len(ids), lambda x: ((rows == rows[x]).mean(axis=1) >= least) | (parts == parts[x]))
        edges = list({(x, parts[y]): (x, y) for x, y in edges if parts[x] != parts[y]}.values())
        return pa.table({"u": pa.array([int(ids[x]) for x, _ in edges], pa.int64()), "v": pa.array([int(ids[y]) for _, y in edges], pa.int64())})

    return run


def _near_parts(least: float):
    """Members of two blocks whose sketches are alike one of another part in the other block."""

    def run(table):
        import pyarrow as pa

        ids, parts, block = (table[c].to_numpy() for c in ("doc_id", "part", "block"))
        rows = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(ids), -1)
        low, high = (np.flatnonzero(block == table[c][0].as_py()) for c in ("i", "j"))
        near = np.zeros(len(ids), bool)
        for x in low.tolist():
            alike = ((rows[high] == rows[x]).mean(axis=1) >= least) & (parts[high] != parts[x])
            near[high] |= alike
            near[x] |= alike.any()
        own = table.filter(pa.array(near))
        return pa.table({"doc_id": own["doc_id"], "component": own["component"], "i": own["i"], "j": own["j"]})

    return run


def exact_components(texts: DataFrame, cluster: DataFrame, sketches: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """``node, component`` of nodes that are not alone, by links on full sets; only members of the same cluster
    (``node, component``) are compared.

    Across blocks only members go with their texts that a sketch (doc_id, sketch) sets beside one of another part.
    A block reports its components as stars around their smallest member.  A member is in one block, but for the smallest
    of the cluster, which is in all and is the smallest of each; so the stars are components already, without any rounds.
    """
    sizes = cluster.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int").alias("own")
    member = scratch.stage(cluster.join(sizes.hint("merge"), "component").select(F.col("node").alias("doc_id"), "component", "k").select("*", own), "member")
    hubs = member.where("k > 1 AND doc_id = component").select("doc_id", "component", "k", F.col("own").alias("mine"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("own")).where("own <> mine")
    rows = member.unionByName(hubs.drop("mine"))

    def confirm(table):
        import pyarrow as pa

        table = table.sort_by("doc_id")
        ids = table["doc_id"].to_pylist()
        items, at = shingles(table["text"].to_pylist(), words)
        stars = forest([items[at[k] : at[k + 1]] for k in range(len(ids))], percent, ids)
        edges = {(ids[y], ids[x]): None for x, y in stars if ids[x] != ids[y]}
        return pa.table({"u": pa.array([u for u, _ in edges], pa.int64()), "v": pa.array([v for _, v in edges], pa.int64())})

    placed = scratch.stage(texts.join(rows.hint("merge"), "doc_id"), "placed")  # the one shuffle of all texts
    links = scratch.stage(placed.groupBy("component", "own").applyInArrow(confirm, "u long, v long"), "confirmed")

    # clusters of several blocks that are still in parts
    part = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    state = member.where("k > 1").join(part.select(F.col("node").alias("doc_id"), F.col("component").alias("part")).hint("merge"), "doc_id", "left").select("doc_id", "component", F.coalesce("part", "doc_id").alias("part"))
    split = state.groupBy("component").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("component")
    state = scratch.stage(state.join(split.hint("merge"), "component"), "split")
    if state.isEmpty():
        scratch.drop("placed")
        return part
    part_sizes = state.groupBy("component", "part").agg(F.count(F.lit(1)).alias("m"))
    loose = part_sizes.where(F.col("m") < BLOCK).groupBy("component").agg(F.sum("m").alias("loose"))
    own = state.join(part_sizes, ["component", "part"]).join(loose, "component", "left")
    whole = F.col("m") >= BLOCK  # a part of its own blocks; small parts share blocks
    number = F.pmod(F.xxhash64(F.when(whole, F.col("doc_id")).otherwise(F.col("part"))), F.ceil(F.when(whole, F.col("m")).otherwise(F.col("loose")) / BLOCK))
    own = own.select("doc_id", "component", "part", F.when(whole, F.col("part")).alias("whole"), number.alias("number"))
    own = scratch.stage(own.select("*", F.xxhash64(F.coalesce("whole", F.lit(-1)), "whole", "number").alias("block")), "blocks")
    blocks = own.groupBy("component").agg(F.collect_set(F.struct("block", "whole")).alias("blocks"))  # one of BLOCK members each
    marked = own.join(blocks.hint("merge"), "component").join(sketches.hint("merge"), "doc_id")
    pairs = marked.select("doc_id", "component", "part", "sketch", "block", "whole", F.explode("blocks").alias("b")).where("b.whole IS NULL OR whole IS NULL OR b.whole <> whole")
    pairs = pairs.select("doc_id", "component", "part", "sketch", "block", F.least("block", "b.block").alias("i"), F.greatest("block", "b.block").alias("j"))
    pairs = scratch.stage(pairs.groupBy("component", "i", "j").applyInArrow(_near_parts(percent / 100 - 0.19), "doc_id long, component long, i long, j long"), "across")
    once = placed.where("doc_id <> component OR own = pmod(xxhash64(doc_id), k)")  # not the smallest member's other rows
    across = once.drop("component", "own", "k").join(pairs.hint("merge"), "doc_id").groupBy("component", "i", "j").applyInArrow(confirm, "u long, v long")
    out = scratch.stage(components(links.unionByName(across), scratch, "final"), "finals")
    for name in ("placed", "confirmed", "across"):
        scratch.drop(name)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, seed: int = 7) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that can be reached) and kept."""
    scratch = Scratch(docs.sparkSession, "near")
    texts = docs.select("doc_id", text_of().alias("text"))
    signed = scratch.stage(texts.mapInArrow(_signed(words, bands, rows, seed), SIGNED), "signed")
    filled = signed.where("n_shingles > 0")
    classes = scratch.stage(filled.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL"), "classes")
    reps = scratch.stage(filled.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "bands", "sketch"), "reps")
    cluster = scratch.stage(sketch_links(reps, scratch, percent), "clusters")
    final = exact_components(texts, cluster, reps.select("doc_id", "sketch"), scratch, words, percent)
    for name in ("reps", "clusters", "member", "blocks", "split"):
        scratch.drop(name)
    named = classes.join(final, classes.rep == final.node, "left").select("k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest doc_id."""
    away = near_duplicates(docs, words, percent).where("NOT kept AND doc_id IS NOT NULL").select("doc_id")
    return docs.join(away.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3, percent=85, bands=25, rows=5)
