"""Operator 5: repeated passages across documents by MinHash over short paragraphs.

Two kinds of units are compared:

* paragraphs: each line of 20 words or more, and each block of two lines or more without a blank line between them.  Their
  minima of universal hashes over five-word shingles are banded in eight bands of two (a pair of Jaccard similarity 0.8
  meets with probability 0.9997).  All different paragraphs that share a bucket are verified by exact Jaccard similarity
  on their full shingle sets: pairs in small buckets, blocks of bounded size (all pairs of blocks are separate groups) in
  large ones; connected components are the clusters.  Texts move only for pairs whose counts of shingles by hash leave it
  open: the counts bound the intersection from above, so no similar pair is lost;
* windows of 20 words that begin at an anchor, for passages that are part of a line or cross lines.  Anchors are chosen by
  content (the smallest hash of three words in any 10 consecutive places), so every document that holds a passage of 29
  words cuts the same windows out of it.  Windows with the same words are a cluster.

Words are compared in lower case (A-Z).  Clusters found in two documents or more give the passages; the first occurrence
stays, all others are marked for removal.  Overlapping and adjacent units of a document that have the same mark are merged,
and where a merged passage ends in a window it is extended as far as the words equal those of the first occurrence.

Defined results: null texts and texts of fewer than 20 words have no paragraphs; rows that share a doc_id are one
document; rows without doc_id are left out; repeats inside one document only are not reported; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.llm._common import Scratch, arrow_schema, documents, text_of
from leafloom.llm.components import components
from leafloom.llm.near_dedup import GOLDEN, forest, shingles
from leafloom.llm.pretoken import _mix, _powers, in_parts, parts_of
from leafloom.llm.textscan import codepoints, runs, separators, span_hashes

LENGTH, GAP, SHINGLE = 20, 10, 5
BANDS, ROWS = 8, 2
SMALL_BUCKET, BLOCK = 16, 256
PART = 250_000
UNITS = "doc_id long, pos int, n int, start int, end int, full long, keys array<long>"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over each ``width`` consecutive values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(words: np.ndarray) -> np.ndarray:
    """Places whose three words have the smallest hash of some GAP consecutive places."""
    if len(words) < 3:
        return np.zeros(0, np.int64)
    three = _mix((words[:-2] * GOLDEN + words[1:-1]) * GOLDEN + words[2:])
    if len(three) <= GAP:
        return np.flatnonzero(three == three.min())
    low = _slide(three, GAP, np.minimum)
    edge = np.zeros(GAP - 1, np.uint64)
    return np.flatnonzero(three == _slide(np.concatenate([edge, low, edge]), GAP, np.maximum))


def paragraphs(cps: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """First words of paragraphs of LENGTH words or more, and the words after their last: those of lines, then of blocks."""
    newline = np.concatenate([[0], np.cumsum(cps == 10)])
    line = newline[starts] + np.searchsorted(docs, starts, "right")  # each text begins a line
    n = len(starts)
    new = np.ones(n, bool)
    new[1:] = line[1:] != line[:-1]
    lines = np.flatnonzero(new)
    apart = np.ones(len(lines), bool)
    apart[1:] = newline[starts[lines[1:]]] - newline[starts[lines[1:] - 1]] != 1
    doc = np.searchsorted(docs, starts[lines], "right")
    apart[1:] |= doc[1:] != doc[:-1]
    blocks = np.flatnonzero(apart)
    several = np.diff(np.append(blocks, len(lines))) > 1
    out = []
    for first, use in ((lines, np.ones(len(lines), bool)), (lines[blocks], several)):
        last = np.append(first[1:], n)
        use = use & (last - first >= LENGTH)
        out.append((first[use], last[use]))
    return out


def _units(seed: int):
    schema = arrow_schema(UNITS)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rng = np.random.default_rng(seed)
        a = rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, texts in parts_of(batch.column(1), PART):
                cps, docs = codepoints(texts)
                if not len(cps):
                    continue
                low = np.where((cps >= 65) & (cps <= 90), cps + 32, cps)
                starts, ends = runs(~separators(cps), docs)
                if len(starts) < LENGTH:
                    continue
                word = _mix(span_hashes(low, starts, ends))
                doc = np.searchsorted(docs, starts, "right") - 1
                at = anchors(word)
                at = at[at + LENGTH <= len(word)]
                at = at[doc[at] == doc[at + LENGTH - 1]]
                up, down = _powers(len(word) + 1)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * up[: len(word)], dtype=np.uint64)])
                n = len(word) - SHINGLE + 1
                five = np.zeros(n + 1, np.uint64)  # one more, so that a paragraph may end the part
                for k in range(SHINGLE):
                    five[:n] = (five[:n] + word[k : k + n]) * GOLDEN
                five = _mix(five)
                first = np.searchsorted(doc, np.arange(j - i))
                for kind, (s, e) in enumerate([(at, at + LENGTH), *paragraphs(cps, docs, starts)]):
                    if not len(s):
                        continue
                    full = _mix((sums[e] - sums[s]) * down[s] + _mix(e - s))
                    if kind:
                        bounds = np.column_stack([s, e - SHINGLE + 1]).reshape(-1)
                        keys = np.zeros((len(s), BANDS), np.uint64)
                        for k in range(BANDS * ROWS):
                            keys[:, k % BANDS] = _mix(keys[:, k % BANDS] * GOLDEN + np.minimum.reduceat(five * a[k] + b[k], bounds)[::2])
                        keys = _mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
                    else:
                        lists = pa.nulls(len(s), pa.list_(pa.int64()))
                    own = doc[s]
                    places = [e - s, starts[s] - docs[own], ends[e - 1] - docs[own]]  # a window's follow from its first word
                    places = [pa.array(x.astype(np.int32)) if kind else pa.nulls(len(s), pa.int32()) for x in places]
                    columns = [pa.array(ids[i:j][own], pa.int64()), pa.array((s - first[own]).astype(np.int32)), *places, pa.array(full.view(np.int64)), lists]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def sketch(items: np.ndarray) -> bytes:
    """How many of the distinct hashes have each value of their low bits, one or two on average; a byte a value."""
    width = 1 << max(4, (len(items) // 2).bit_length())
    while (counts := np.bincount((items & np.uint64(width - 1)).astype(np.int64), minlength=width)).max() > 255:
        width *= 2
    return counts.astype(np.uint8).tobytes()


def within_reach(x: list[bytes], y: list[bytes], percent: int) -> np.ndarray:
    """Whether the sets of each pair of sketches can be similar enough: false only where they certainly are not."""
    keep = np.zeros(len(x), bool)
    width = np.array([list(map(len, x)), list(map(len, y))], np.int64).reshape(2, -1)
    for p, q in np.unique(width, axis=1).T.tolist():
        at, to = np.flatnonzero((width[0] == p) & (width[1] == q)), min(p, q)
        a, b = (np.frombuffer(b"".join(z[k] for k in at), np.uint8).reshape(len(at), -1, to).sum(1, dtype=np.int64) for z in (x, y))
        common = np.minimum(a, b).sum(1)
        keep[at] = 100 * common >= percent * (a.sum(1) + b.sum(1) - common)
    return keep


#: Blocks of a bucket whose sketches are compared together.
WIDE = 16
REACHED = "bucket long, i int, j int, full long"


def reach_matrix(x: list[bytes], y: list[bytes], percent: int) -> np.ndarray:
    """``within_reach`` of each of some sketches with each of others."""
    keep = np.zeros((len(x), len(y)), bool)
    widths = [np.fromiter(map(len, z), np.int64, len(z)) for z in (x, y)]
    for p in np.unique(widths[0]).tolist():
        for q in np.unique(widths[1]).tolist():
            at, to, width = np.flatnonzero(widths[0] == p), np.flatnonzero(widths[1] == q), min(p, q)
            a, b = (np.frombuffer(b"".join(z[k] for k in w), np.uint8).reshape(len(w), -1, width).sum(1, dtype=np.uint16) for z, w in ((x, at), (y, to)))
            size = a.sum(1, dtype=np.int64)[:, None] + b.sum(1, dtype=np.int64)[None, :]
            step = max(1, (1 << 22) // max(1, b.size))
            for begin in range(0, len(at), step):
                common = np.minimum(a[begin : begin + step, None, :], b[None, :, :]).sum(2, dtype=np.int64)
                keep[np.ix_(at[begin : begin + step], to)] = 100 * common >= percent * (size[begin : begin + step] - common)
    return keep


def _reached(percent: int):
    """Of a pair of wide blocks of a bucket the members that sketches don't keep apart from one of another part, for each pair
    of blocks where that is so."""

    def run(table):
        import pyarrow as pa

        ids, parts, own, wide = (table[c].to_numpy() for c in ("full", "part", "own", "wide"))
        sketches = table["sketch"].to_pylist()
        low, high = (np.flatnonzero(wide == table[c][0].as_py()) for c in ("x", "y"))
        rows = [np.zeros((0, 3), np.int64)]
        for begin in range(0, len(low), 1024):
            some = low[begin : begin + 1024]
            keep = reach_matrix([sketches[k] for k in some], [sketches[k] for k in high], percent) & (parts[some][:, None] != parts[high][None, :])
            p, q = np.nonzero(keep)
            u, v = some[p], high[q]
            i, j = np.minimum(own[u], own[v]), np.maximum(own[u], own[v])
            rows.append(np.unique(np.concatenate([np.column_stack([i, j, u]), np.column_stack([i, j, v])]), axis=0))
        found = np.unique(np.concatenate(rows), axis=0)
        bucket = np.full(len(found), table["bucket"][0].as_py() if table.num_rows else 0, np.int64)
        return pa.table({"bucket": pa.array(bucket), "i": pa.array(found[:, 0].astype(np.int32)), "j": pa.array(found[:, 1].astype(np.int32)), "full": pa.array(ids[found[:, 2]])})

    return run


def _close(percent: int):
    """Keeps pairs of paragraphs whose sketches don't rule out that they are similar enough."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = [within_reach(x[i:j], y[i:j], percent) for i, j in in_parts([max(p, q, key=len) for p, q in zip(x, y, strict=True)], PART)]
            keep = pa.array(np.concatenate([np.zeros(0, bool), *keep]))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return run


def _jaccard(percent: int):
    """Keeps pairs of paragraph texts whose shingle sets are similar enough."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            tu, tv = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = np.zeros(batch.num_rows, bool)
            for i, j in in_parts([max(p, q, key=len) for p, q in zip(tu, tv, strict=True)], PART):
                x, at = shingles(tu[i:j], SHINGLE)
                y, to = shingles(tv[i:j], SHINGLE)
                for k in range(j - i):
                    p, q = x[at[k] : at[k + 1]], y[to[k] : to[k + 1]]
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    keep[i + k] = 100 * common >= percent * (len(p) + len(q) - common)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return run


READ = "full long, words string, sketch binary"


def _cut():
    """The words of the asked paragraphs of each text, and the sketch of their shingles."""
    schema = arrow_schema(READ)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            asked = batch.column(1).to_pylist()
            for i, _, texts in parts_of(batch.column(0), PART):
                rows = [(x["full"], t[x["start"] : x["end"]]) for t, xs in zip(texts, asked[i:], strict=False) for x in xs]
                words = [r[1] for r in rows]
                items, at = shingles(words, SHINGLE)
                counts = [sketch(items[at[k] : at[k + 1]]) for k in range(len(rows))]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(words, pa.string()), pa.array(counts, pa.binary())], schema=schema)

    return run


def similar_paragraphs(lines: DataFrame, texts: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """``node, component`` of different paragraphs that are similar: every pair that shares a bucket is verified."""
    entry = lines.select(F.explode("keys").alias("bucket"), "full")
    buckets = entry.groupBy("bucket").agg(F.min("full").alias("a"), F.max("full").alias("b")).where("a <> b").select("bucket")
    buckets = scratch.stage(buckets, "buckets")  # apart from the join, so that only one shuffle of the entries is held
    met = scratch.stage(entry.join(buckets.hint("merge"), "bucket").distinct(), "met")
    scratch.drop("buckets")
    shared = scratch.stage(met.join(met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).hint("merge"), "bucket"), "shared")
    scratch.drop("met")
    wanted = shared.select("full").distinct()
    place = (F.shiftleft(F.col("start").cast("long"), 32) + F.col("end")).alias("place")
    places = lines.select("full", "doc_id", place).join(wanted.hint("merge"), "full").groupBy("full").agg(F.min_by("place", "doc_id").alias("place"), F.min("doc_id").alias("doc_id"))
    spans = places.groupBy("doc_id").agg(F.collect_list(F.struct("full", F.shiftright("place", 32).cast("int").alias("start"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("end"))).alias("asked"))
    read = scratch.stage(texts.join(spans.hint("merge"), "doc_id").select("text", "asked").mapInArrow(_cut(), READ), "read")

    small = shared.where(F.col("n") <= SMALL_BUCKET)
    pairs = small.select("bucket", F.col("full").alias("u")).join(small.select("bucket", F.col("full").alias("v")), "bucket").where("u < v").select("u", "v")
    large = shared.where(F.col("n") > SMALL_BUCKET)
    stars = large.join(large.groupBy("bucket").agg(F.min("full").alias("centre")).hint("merge"), "bucket").where("full <> centre").select(F.col("centre").alias("u"), F.col("full").alias("v"))
    pairs = pairs.unionByName(stars).distinct()
    side = lambda c, what: read.select(F.col("full").alias(c), F.col(what).alias(f"t{c}")).hint("merge")
    both = lambda rows, what: rows.join(side("u", what), "u").join(side("v", what), "v").select("u", "v", "tu", "tv")
    close = scratch.stage(both(pairs, "sketch").mapInArrow(_close(percent), "u long, v long").distinct(), "close")
    similar = scratch.stage(both(close, "words").mapInArrow(_jaccard(percent), "u long, v long"), "similar")  # apart from the blocks, so that only one shuffle of the texts is held
    scratch.drop("close")

    # large buckets: sketches of pairs of wide blocks leave the members, and pairs of blocks, whose texts must be compared
    step = similar.groupBy(F.col("v").alias("full")).agg(F.min("u").alias("part"))
    step = scratch.stage(step.join(step.select(F.col("full").alias("part"), F.col("part").alias("next")), "part", "left").select("full", F.coalesce("next", "part").alias("part")), "step")
    k = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("full"), F.col("k")).cast("int")
    member = large.select("bucket", "full", k.alias("k")).withColumn("own", own).join(step.hint("merge"), "full", "left").withColumn("part", F.coalesce("part", "full"))
    mixed = member.groupBy("bucket").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("bucket")
    member = member.join(mixed.hint("merge"), "bucket").withColumn("wide", F.floor(F.col("own") / WIDE).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.floor((F.col("k") - 1) / WIDE).cast("int"))).alias("other")
    grouped = member.join(read.select("full", "sketch").hint("merge"), "full").select("bucket", "full", "part", "own", "wide", "sketch", other).withColumn("x", F.least("wide", "other")).withColumn("y", F.greatest("wide", "other"))
    asked = scratch.stage(grouped.drop("other").groupBy("bucket", "x", "y").applyInArrow(_reached(percent), REACHED), "asked")
    grouped = asked.join(read.select("full", "words").hint("merge"), "full")

    def confirm(table):
        import pyarrow as pa

        ids = table["full"].to_pylist()
        items, at = shingles(table["words"].to_pylist(), SHINGLE)
        edges = forest([items[at[x] : at[x + 1]] for x in range(len(ids))], percent)
        return pa.table({"u": pa.array([ids[x] for x, _ in edges], pa.int64()), "v": pa.array([ids[y] for _, y in edges], pa.int64())})

    blocks = scratch.stage(grouped.groupBy("bucket", "i", "j").applyInArrow(confirm, "u long, v long"), "blocks")
    for name in ("read", "shared"):
        scratch.drop(name)
    found = components(similar.unionByName(blocks), scratch, "near")
    for name in ("similar", "blocks", "step", "asked"):
        scratch.drop(name)
    return found


AROUND = "component long, doc_id long, pos int, start int, end int, words string, before string, behind string"


def around(text: str, starts: list[int], ends: list[int], pos: int) -> tuple[int, int, str, str, str]:
    """Of the window at word ``pos`` its span, its words, and those before it (the nearest first) and behind it, GAP at
    most, each with its border (start or end) as ``word border``; the words' spans are given."""
    to = pos + LENGTH
    low = lambda k: text[starts[k] : ends[k]].translate(LOW)
    before = "\n".join(f"{low(k)} {starts[k]}" for k in range(pos - 1, max(pos - GAP, 0) - 1, -1))
    behind = "\n".join(f"{low(k)} {ends[k]}" for k in range(to, min(to + GAP, len(starts))))
    return starts[pos], ends[to - 1], " ".join(low(k) for k in range(pos, to)), before, behind


def _around():
    schema = arrow_schema(AROUND)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, asked = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, _, texts in parts_of(batch.column(1), PART):
                cps, docs = codepoints(texts)
                starts, ends = runs(~separators(cps), docs)
                first = np.searchsorted(starts, docs)
                rows = []
                for k, text in enumerate(texts):
                    a, b = first[k], first[k + 1]
                    s, e = (starts[a:b] - docs[k]).tolist(), (ends[a:b] - docs[k]).tolist()
                    rows += [(x["component"], ids[i + k], x["pos"], *around(text, s, e, x["pos"])) for x in asked[i + k]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return run


EXTENDED = "doc_id long, pos int, left int, n_left int, right int, n_right int, first_doc long, first_pos int, first_left int, first_right int"


def _common(x: str, y: str) -> tuple[int, int | None, int | None]:
    """How many of the words are the same from the first on, and the border of the last such word on either side."""
    n, a, b = 0, None, None
    for p, q in zip(x.split("\n") if x else [], y.split("\n") if y else [], strict=False):
        (v, s), (w, t) = p.rsplit(" ", 1), q.rsplit(" ", 1)
        if v != w:
            break
        n, a, b = n + 1, int(s), int(t)
    return n, a, b


def _extended():
    """How far the words around a window equal those around the first occurrence (null where none does)."""
    schema = arrow_schema(EXTENDED)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for doc, pos, first_doc, first_pos, before, behind, first_before, first_behind in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                (n, left, other), (m, right, far) = _common(before, first_before), _common(behind, first_behind)
                rows.append((doc, pos, left, n, right, m, first_doc, first_pos, other, far))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 10, schema, strict=True)], schema=schema)

    return run


def extensions(read: DataFrame, ends: DataFrame, firsts: DataFrame, scratch: Scratch) -> DataFrame:
    """Of windows that begin or end a repeat (doc_id, pos, component) how far each reaches beyond its border; ``read`` holds
    what stands around them and around the first occurrences."""
    own = ends.select("component", "doc_id", "pos").join(read, ["component", "doc_id", "pos"]).select("component", "doc_id", "pos", "words", "before", "behind")
    names = {"doc_id": "first_doc", "pos": "first_pos", "words": "first_words", "before": "first_before", "behind": "first_behind"}
    first = firsts.select("component", "doc_id", "pos").join(read, ["component", "doc_id", "pos"]).select("component", *[F.col(c).alias(x) for c, x in names.items()])
    both = own.join(first, "component").where("words = first_words").select("doc_id", "pos", "first_doc", "first_pos", "before", "behind", "first_before", "first_behind")
    done = scratch.stage(both.mapInArrow(_extended(), EXTENDED), "extended")
    reach = [F.min("left").alias("left"), F.max("n_left").alias("n_left"), F.max("right").alias("right"), F.max("n_right").alias("n_right")]
    mine = done.select("doc_id", "pos", F.lit(True).alias("removed"), "left", "n_left", "right", "n_right")
    theirs = done.select(F.col("first_doc").alias("doc_id"), F.col("first_pos").alias("pos"), F.lit(False).alias("removed"), F.col("first_left").alias("left"), "n_left", F.col("first_right").alias("right"), "n_right")
    return mine.unionByName(theirs).groupBy("doc_id", "pos", "removed").agg(*reach)


def repeated_passages(docs: DataFrame, percent: int = 80, seed: int = 11) -> DataFrame:
    """Per passage of a document that another document also holds: doc_id, start and end (code points), n_words,
    component_id (the least), removed (false for the first occurrence) and component_ids (all clusters of the passage)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "passages")
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", text_of().alias("text"))
    units = scratch.stage(texts.mapInArrow(_units(seed), UNITS), "units")
    paragraphs = units.where("n IS NOT NULL")
    found = scratch.stage(similar_paragraphs(paragraphs, texts, scratch, percent), "found")

    # clusters in two documents or more; windows (most of the table, so only three columns move) are their own clusters
    windows = units.where("n IS NULL").select("doc_id", "pos", F.col("full").alias("component"))
    lines = paragraphs.join(found, F.col("full") == F.col("node"), "left").select("doc_id", "pos", "n", "start", "end", F.coalesce("component", "full").alias("component"))
    marked = []
    for name, part in (("windows", windows), ("lines", lines)):
        clusters = part.groupBy("component").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc <> last_doc")
        clusters = scratch.stage(clusters.drop("last_doc"), f"{name}_clusters")
        marked.append(scratch.stage(part.join(clusters.hint("merge"), "component").withColumn("removed", F.col("doc_id") > F.col("first_doc")), f"{name}_marked"))
        scratch.drop(f"{name}_clusters")
    scratch.drop("units")
    scratch.drop("found")
    none = F.lit(None).cast("int")
    windows = marked[0].select("doc_id", "pos", F.lit(LENGTH).alias("n"), none.alias("start"), none.alias("end"), "component", "removed", F.lit(True).alias("window"))
    lines = marked[1].select("doc_id", "pos", "n", "start", "end", "component", "removed", F.lit(False).alias("window"))

    # overlapping and adjacent units of a document with the same mark become one passage
    key = ["doc_id", "removed"]
    order = Window.partitionBy(*key).orderBy("pos", "n", "component")
    before = F.max(F.col("pos") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = windows.unionByName(lines).withColumn("new", F.when(F.col("pos") <= before, 0).otherwise(1))
    numbered = apart.withColumn("passage", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    unit = F.struct("pos", "window", "start", "end", "component").alias("unit")
    merged = numbered.groupBy(*key, "passage").agg(
        F.min("pos").alias("pos"), F.max(F.col("pos") + F.col("n")).alias("to"), F.sort_array(F.collect_set("component")).alias("component_ids"),
        F.min(F.struct("pos", ~F.col("window"), unit))["unit"].alias("head"), F.max(F.struct(F.col("pos") + F.col("n"), F.col("window"), unit))["unit"].alias("tail"),
    )
    merged = scratch.stage(merged, "merged")

    # windows at either end: their spans, and how far the words equal those of the first occurrence
    ends = scratch.stage(merged.select("doc_id", "removed", F.explode(F.array("head", "tail")).alias("u")).where("u.window").select("doc_id", "removed", "u.component", "u.pos").distinct(), "ends")
    wanted = ends.where("removed").select("component").distinct()
    firsts = marked[0].where("NOT removed").join(wanted.hint("merge"), "component", "left_semi").groupBy("component").agg(F.min(F.struct("doc_id", "pos")).alias("f"))
    firsts = scratch.stage(firsts.select("component", "f.*"), "firsts")
    asked = ends.drop("removed").unionByName(firsts.select("doc_id", "component", "pos")).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("component", "pos")).alias("asked"))
    read = scratch.stage(texts.join(asked.hint("merge"), "doc_id").select("doc_id", "text", "asked").mapInArrow(_around(), AROUND), "around")
    reach = scratch.stage(extensions(read, ends.where("removed"), firsts, scratch), "reach")
    spans = read.groupBy("doc_id", "pos").agg(F.min("start").alias("from"), F.min("end").alias("till"))
    reach = scratch.stage(ends.select("doc_id", "removed", "pos").distinct().join(spans.hint("merge"), ["doc_id", "pos"]).join(reach.hint("merge"), ["doc_id", "pos", "removed"], "left"), "spans")
    for name in ("around", "extended", "reach", "firsts", "ends", "windows_marked", "lines_marked"):
        scratch.drop(name)
    for side, at in (("h", "head"), ("t", "tail")):
        names = {c: f"{side}_{c}" for c in ("from", "till", "left", "n_left", "right", "n_right")}
        own = reach.select("doc_id", "removed", F.col("pos").alias(f"{side}_pos"), *[F.col(c).alias(x) for c, x in names.items()])
        merged = merged.withColumn(f"{side}_pos", F.when(F.col(f"{at}.window"), F.col(f"{at}.pos"))).join(own, ["doc_id", "removed", f"{side}_pos"], "left")
    n_words = F.col("to") - F.col("pos") + F.coalesce("h_n_left", F.lit(0)) + F.coalesce("t_n_right", F.lit(0))
    start, end = F.coalesce("h_left", "h_from", "head.start"), F.coalesce("t_right", "t_till", "tail.end")
    return merged.select("doc_id", start.alias("start"), end.alias("end"), n_words.cast("long").alias("n_words"), F.col("component_ids")[0].alias("component_id"), "removed", "component_ids")


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))
