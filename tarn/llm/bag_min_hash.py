"""Near-duplicate documents by BagMinHash signatures of weighted word shingles.

A document is the multiset of its five-word shingles. BagMinHash draws, for each shingle, points of
Poisson processes over its weight: one process for [0, 1) and one for each [2^k, 2^(k+1)), of a rate
that is its width, so that a heavy shingle takes logarithmically many. A point has an arrival time, a
register and a place in its interval, which counts if it is below the weight; places come from the
bits of one draw, as if the interval were halved again and again. A register keeps its earliest
point. Two documents share a register's point with a probability that is exactly their weighted
Jaccard similarity, and drawing stops once no later point can be the earliest of any register.

Registers are banded. Documents in one band bucket are verified by their exact multisets against the
bucket's leader, and links are closed to classes. The members of buckets that still hold several
classes are compared across classes by an exact index of their shingles, in pairs of blocks of
bounded size, so no pair that shares a bucket is missed.

Scale: exact copies count once from the start. What is shuffled is one signature per text, then
(band key, text) rows; leaders are found by aggregation and joined back, never by gathering a bucket.
Texts move only for candidates. Rounds are written to the shared folder, and deleted when what follows
from them is; nothing reaches the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import forget, importable, lasting, slices

WORDS = 5
SIMILARITY = 0.8
#: The share of pairs at the very threshold that no band brings together, at most about.
MISSED = 2.7e-5
#: Keys are sent to every executor only if they are so few; else the join is shuffled.
BROADCAST_KEYS = 500_000
#: Shingles and texts of a block that is compared with another, about.
BLOCK_SHINGLES = 400_000
BLOCK_TEXTS = 256

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of the input."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words, kept while there are not too many."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, 55-bit shingle, its count) of all texts, in the order of text and shingle.

    Words are lower-case runs between ASCII white space. A text of one to four words is one shingle;
    without words it has none.
    """
    words = [(t or "").lower().encode("utf-8", "surrogatepass").split() for t in texts]
    n = np.array([len(w) for w in words])
    flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(n.sum()))
    starts = np.cumsum(n) - n
    made = np.maximum(n - WORDS + 1, (n > 0).astype(int))
    text = np.repeat(np.arange(len(texts)), made)
    at = np.arange(int(made.sum())) - np.repeat(np.cumsum(made) - made, made) + np.repeat(starts, made)
    left = np.repeat(starts + n, made) - at
    padded = np.concatenate([flat, np.zeros(WORDS, np.uint64)])
    value = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        value = value * _U(0x100000001B3) + np.where(left > k, padded[at + k], _U(0))
    key = (text.astype(np.uint64) << _U(55)) | (mix(value + _GOLDEN) >> _U(9))
    key.sort()
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, int)
    counts = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> _U(55)).astype(int), key & _U((1 << 55) - 1), counts


def bag_min_hash(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """(texts, registers): the arrival time of each register's earliest point; infinite without shingles."""
    # processes: [0, 1) of every shingle, and [2^k, 2^(k+1)) of those whose weight is above 2^k
    whose, seeds, lows = [np.arange(len(text))], [mix(shingle + _GOLDEN)], [np.zeros(len(text))]
    k = 0
    while len(heavy := np.flatnonzero(weight > 2**k)):
        whose.append(heavy)
        seeds.append(mix(shingle[heavy] + _U(int(_GOLDEN) * (k + 2) % 2**64)))
        lows.append(np.full(len(heavy), float(2**k)))
        k += 1
    whose, seed, low = np.concatenate(whose), np.concatenate(seeds), np.concatenate(lows)
    doc, most = text[whose], weight[whose].astype(float)
    width = np.maximum(low, 1.0)  # also the rate
    best = np.full(n_texts * registers, np.inf)
    time, drawn = np.zeros(len(seed)), 0
    while len(seed):
        many = int(np.clip(32_768 // len(seed), 1, 64))
        steps = np.arange(drawn + 1, drawn + many + 1, dtype=np.uint64) * _GOLDEN
        first = mix(seed[:, None] + steps)
        second = mix(first ^ _U(0xD1B54A32D192ED03))
        gaps = -np.log1p(-(first >> _U(11)).astype(float) * 2.0**-53) / width[:, None]
        times = time[:, None] + np.cumsum(gaps, axis=1)
        register = (second & _U(0xFFFFFFFF)) * _U(registers) >> _U(32)
        place = low[:, None] + width[:, None] * (second >> _U(32)).astype(float) * 2.0**-32
        counts = place < most[:, None]
        where = doc[:, None] * registers + register.astype(int)
        np.minimum.at(best, where[counts], times[counts])
        drawn += many
        time = times[:, -1]
        worst = best.reshape(n_texts, registers).max(axis=1)
        open_ = time < worst[doc]
        seed, time, doc, low, width, most = (x[open_] for x in (seed, time, doc, low, width, most))
    return best.reshape(n_texts, registers)


def banding(similarity: float) -> tuple[int, int]:
    """(bands, rows) by which hardly a pair of that similarity is missed: 20 of 4 at 0.8, 37 of 2 at 0.5."""
    rows = 4 if similarity >= 0.75 else 3 if similarity >= 0.6 else 2
    together = min(max(similarity, 0.05) ** rows, 1 - MISSED)
    return max(1, round(float(np.log(MISSED) / np.log1p(-together)))), rows


def band_keys(best: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) 64-bit keys, as signed integers."""
    bits = best[:, : bands * rows].copy().view(np.uint64).reshape(len(best), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN, bits.shape[:2])
    for k in range(rows):
        key = mix(key * _U(0x100000001B3) + bits[:, :, k])
    return key.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two multisets as (sorted elements, counts); two empty ones are alike."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - shared
    return shared / total if total else 1.0


def _node():
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """node (the text's 128-bit hash), n (shingles with their counts; 0 without words) and keys of each row."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, 500):  # under 512, as 9 bits number the texts
            text, shingle, weight = shingles(batch.column(1).to_pylist(), hashes)
            keys = band_keys(bag_min_hash(text, shingle, weight, batch.num_rows, bands * rows), bands, rows)
            n = np.bincount(text, weights=weight, minlength=batch.num_rows).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), lists], names=["node", "n", "keys"])

    return docs.select(_node().alias("node"), "text").mapInArrow(run, "node binary, n long, keys array<long>")


def _few(keys: DataFrame) -> DataFrame:
    """A written table of keys; to be sent to all executors if it is small, else a join shuffles it."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def texts_of(ids: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """id and text of each of the ids, whose hashes are in ``nodes`` (id, node)."""
    ids = lasting(ids)
    wanted = lasting(nodes.select("id", "node").join(_few(ids), "id", "left_semi"))
    found = docs.select(_node().alias("node"), "text").join(_few(wanted), "node")
    texts = lasting(found.groupBy("id").agg(F.first("text").alias("text")))
    forget(ids, wanted)
    return texts


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of ids, a written table, whose texts are alike enough; written."""
    texts = texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), nodes, docs)
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        kept: dict[int, tuple] = {}
        for batch in slices(batches, 250):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = dict(zip(a, batch.column(2).to_pylist())) | dict(zip(b, batch.column(3).to_pylist()))
            missing = [k for k in texts if k not in kept]
            for start in range(0, len(missing), 500):
                some = missing[start : start + 500]
                text, shingle, weight = shingles([texts[k] for k in some], hashes)
                cuts = np.searchsorted(text, np.arange(len(some) + 1))
                kept |= {k: (shingle[s:e], weight[s:e]) for k, s, e in zip(some, cuts, cuts[1:])}
            alike = pa.array([weighted_jaccard(kept[x], kept[y]) >= similarity for x, y in zip(a, b)])
            again = set(b[-50:])  # pairs come sorted by their leader, at least in part
            kept = {k: v for k, v in kept.items() if k in again}
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(alike), batch.column(1).filter(alike)], names=["a", "b"])

    found = lasting(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"))
    forget(texts)
    return found


def components(edges: DataFrame) -> DataFrame:
    """id and comp, the least id that it is linked to, of each id of the edges (a, b); written.

    Large-star and small-star steps in turn, until every component is a star around its least id.
    """
    edges = lasting(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        several = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
        inner = edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi")
        if not several.union(inner).take(1):
            found = lasting(edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(edges.select("v", "v").distinct()))
            forget(edges)
            return found
        around = edges.union(edges.select("v", "u")).toDF("x", "y")
        least = around.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = around.join(least, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        old, edges = edges, lasting(joined.select("u", F.col("m").alias("v")).union(joined.filter("v <> m").select("v", "m")).distinct())
        forget(old)


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """node (the 128-bit hash of a text) and comp, a number of its class, of each text; written."""
    signed = signatures(docs, *banding(similarity))
    texts = signed.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    texts = lasting(texts.withColumn("id", F.monotonically_increasing_id()))  # written, so that the numbers stay
    members = texts.filter("n > 0").select("id", F.explode("keys").alias("key"))
    # written before the join, so that adaptive execution can split a bucket that holds very many
    leaders = members.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("key", "leader")
    leaders = lasting(leaders)
    shared = lasting(members.join(leaders, "key"))
    pairs = lasting(shared.filter("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct())
    links = verified(pairs, texts, docs, similarity)
    classes = components(links)
    forget(leaders, pairs)
    # what is left: the members of buckets that still hold several classes
    placed = shared.join(classes, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = lasting(placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("key"))
    left = lasting(placed.join(mixed, "key", "left_semi").select("id", "leader", "comp").distinct())
    forget(shared, mixed)
    if left.take(1):
        more = linked_within_groups(left, texts, docs, similarity)
        if more.take(1):
            old, classes = classes, components(links.union(more))
            forget(old)
        forget(more)
    found = lasting(texts.select("id", "node").join(classes, "id", "left").select("node", F.coalesce("comp", "id").alias("comp")))
    forget(links, left, classes, texts)
    return found


def linked_within_groups(left: DataFrame, texts: DataFrame, docs: DataFrame, similarity: float, block_shingles: int = BLOCK_SHINGLES, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """Pairs (a, b) of ids of different classes that are alike, of those that buckets join, by whatever chain; written.

    left: id, leader, comp; texts: id, node, n. A group of ids is cut by hash into blocks of bounded size,
    and each pair of blocks is searched in a task of its own, which gives only the links that it finds.
    """
    members = lasting(left.groupBy("id").agg(F.first("comp").alias("comp")))
    groups = components(left.select(F.col("id").alias("a"), F.col("leader").alias("b")))
    placed = lasting(members.join(groups.withColumnRenamed("comp", "group"), "id").join(texts.select("id", "n"), "id"))
    blocks = F.greatest(F.ceil(F.sum("n") / block_shingles), F.ceil(F.count(F.lit(1)) / block_texts)).cast("int")
    sizes = placed.groupBy("group").agg(blocks.alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    bodies = texts_of(members.select("id"), texts, docs)
    copies = placed.join(sizes, "group").join(bodies, "id")
    copies = copies.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = copies.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "comp", "text")

    def search(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        names, classes = rows["id"].to_pylist(), rows["comp"].to_pylist()
        kinds = {c: k for k, c in enumerate(dict.fromkeys(classes))}
        kind, side = np.array([kinds[c] for c in classes]), rows["block"].to_numpy() == rows["j"].to_numpy()
        same = bool((rows["i"].to_numpy() == rows["j"].to_numpy()).all())
        found = cross_links([*rows["text"].to_pylist()], kind, None if same else side, similarity)
        return pa.table({"a": pa.array([names[x] for x, _ in found], pa.int64()), "b": pa.array([names[y] for _, y in found], pa.int64())})

    importable(docs.sparkSession)
    found = lasting(paired.groupBy("group", "i", "j").applyInArrow(search, "a long, b long"))
    forget(members, groups, placed, bodies)
    return found


def cross_links(texts: list[str | None], kind: np.ndarray, side: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Pairs of texts of different kinds (and different sides, if there are any) that are alike.

    A text gives one link to each other kind that it is linked to: the kind is one class already.
    Texts of the commonest kind are only looked up. Without sides, each other one looks its shingles up
    among all; with them, those of the one side do so on the other, and those of the other among
    the commonest kind.
    """
    hashes = WordHashes()
    parts = []
    for s in range(0, len(texts), 500):
        text, shingle, weight = shingles(texts[s : s + 500], hashes)
        parts.append((text + s, shingle, weight))
    text, shingle, weight = (np.concatenate(x) for x in zip(*parts))
    n = np.bincount(text, weights=weight, minlength=len(texts))
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    common = kind == np.bincount(kind).argmax()
    order = np.argsort(shingle, kind="stable")
    found = []

    def look_up(seekers: np.ndarray, among: np.ndarray) -> None:
        some = order[among[text[order]]]
        at, docs, counts = shingle[some], text[some], weight[some]
        for y in np.flatnonzero(seekers):
            own, own_counts = shingle[cuts[y] : cuts[y + 1]], weight[cuts[y] : cuts[y + 1]]
            low, high = np.searchsorted(at, own), np.searchsorted(at, own, side="right")
            m = high - low
            where = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low, m)
            both = np.bincount(docs[where], weights=np.minimum(counts[where], np.repeat(own_counts, m)), minlength=len(texts))
            alike = among & (both / np.maximum(n + n[y] - both, 1) >= similarity) & (kind != kind[y])
            if side is None:  # of two that both look up, the later one reports
                alike &= common | (np.arange(len(texts)) < y)
            hits = np.flatnonzero(alike)
            found.extend((int(y), int(hits[k])) for k in np.unique(kind[hits], return_index=True)[1])

    if side is None:
        look_up(~common, np.ones(len(texts), bool))
    else:
        look_up(side & ~common, ~side)
        look_up(~side & ~common, side & common)
    return found


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class) and class_size (rows) of each row.

    Rows are in one class if a chain of texts links them, each with a weighted Jaccard similarity
    of its five-word shingles of at least ``similarity`` to the next. Equal texts are in one class,
    also empty ones; a null text counts as empty. A text without words is like its equals alone. A
    class whose ids are all null has a null class_id. Repeated rows are rows of one class; an empty
    table gives no rows. Only doc_id and text are read.
    """
    classes = near_classes(docs, similarity)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _node().alias("node"))
    rows = lasting(rows.join(classes, "node").select("doc_id", "comp"))
    forget(classes)
    ids = rows.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(lasting(ids), "comp").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """All columns of the rows that stay: of each class, the row of least doc_id (nulls last), then of least text hash.

    Of rows of one id and text the one of the least hash of its other columns stays. See
    ``near_duplicates`` for the classes. Only the keys of the rows that go are sent to the texts.
    """
    classes = near_classes(docs, similarity)
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))
    placed = lasting(docs.select("doc_id", _node().alias("node")).join(classes, "node"))
    first = placed.groupBy("comp").agg(F.min(rank).alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("comp", "m")
    several = placed.join(lasting(first), "comp")
    stays = (F.col("node") == F.col("m.node")) & F.col("doc_id").eqNullSafe(F.col("m.doc_id"))
    several = lasting(several.select("doc_id", "node", stays.alias("stays")))
    gone = lasting(several.filter("not stays").select("doc_id", "node").distinct())
    again = lasting(several.filter("stays").groupBy("doc_id", "node").count().filter("count > 1").select("doc_id", "node"))
    forget(classes, placed, several)

    cells = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)))  # so that no name clashes
    rows = docs.select(F.col("doc_id").alias("id"), _node().alias("node"), cells.alias("cells"))

    def among(keys: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        keys = _few(keys)
        return rows.join(keys, rows["id"].eqNullSafe(keys["doc_id"]) & (rows["node"] == keys["node"]), how)

    kept = among(gone, "left_anti", rows)
    if again.take(1):
        same = among(again, "left_semi", kept).groupBy("id", "node").agg(F.min_by("cells", F.xxhash64("cells")).alias("cells"))
        kept = among(again, "left_anti", kept).unionByName(same)
    return kept.select(*(F.col(f"cells.c{k}").alias(c) for k, c in enumerate(docs.columns)))


#: The same classes by comparing all texts that share a shingle, and following links.
SQL = """
with recursive
w as (select doc_id, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\r\\f\\v]+') if x <> ''] as ws from documents),
s as (select doc_id, unnest(case when len(ws) >= 5 then [ws[i : i + 4] for i in range(1, len(ws) - 3)] when len(ws) > 0 then [ws] else [] end) as g from w),
c as (select doc_id, g, count(*) as n from s group by all),
t as (select doc_id, sum(n) as n from c group by all),
p as (select a.doc_id as x, b.doc_id as y, sum(least(a.n, b.n)) as same from c a join c b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (
    select x, y from p join t tx on tx.doc_id = x join t ty on ty.doc_id = y
    where cast(same as double) / cast(tx.n + ty.n - same as double) >= cast(0.8 as double)
    union select a.doc_id, b.doc_id from documents a join documents b on coalesce(a.text, '') = coalesce(b.text, '') and a.doc_id < b.doc_id),
e as (select x, y from l union all select y, x from l),
r(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, e.y from r join e on r.other = e.x)
select doc_id, min(other) as class_id, count(*) as class_size from r group by doc_id
"""
