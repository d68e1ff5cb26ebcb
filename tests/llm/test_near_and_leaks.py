from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import bag_min_hash as near
from tarn.llm import bm25_wand as bm25


def multiset(text):
    w = (text or "").lower().encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    both, all_ = sum((a & b).values()), sum((a | b).values())
    return both / all_ if all_ else 1.0


def plain_classes(texts, similarity=0.8):
    """The number of the first text of each text's class."""
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [multiset(t) for t in texts]
    for x in range(len(texts)):
        for y in range(x):
            if (texts[x] or "") == (texts[y] or "") or bags[x] and bags[y] and jaccard(bags[x], bags[y]) >= similarity:
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    return [root(x) for x in range(len(texts))]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        k, kind = int(rng.integers(0, len(words))), rng.integers(0, 3)
        if kind == 0:
            words[k] = f"w{rng.integers(0, 10**6)}"
        elif kind == 1:
            words.insert(k, f"v{rng.integers(0, 10**6)}")
        elif len(words) > 20:
            del words[k]
    return words


@pytest.fixture(scope="module")
def copies():
    """Groups of exact and near copies, a chain, and short and odd texts."""
    rng = np.random.default_rng(3)
    texts = []
    for size in (1, 2, 5, 60):
        base = [f"b{rng.integers(0, 10**6)}" for _ in range(120)]
        texts += [" ".join(edited(rng, base, int(rng.integers(0, 5)))) for _ in range(size)] + [" ".join(base)] * size
    chain = [f"c{k}" for k in range(100)]
    for _ in range(10):
        chain = edited(rng, chain, 2)
        texts.append(" ".join(chain))
    same = "again and again the same line " * 40
    return [*texts, same, same + "once more", "one two", "One  two", "one two three", "", "", "  ", None, "x" * 5000, "A B C D E F", "a b c d e f"]


def test_signatures_are_unbiased():
    rng, errors = np.random.default_rng(0), []
    for _ in range(100):
        ids = np.sort(rng.integers(0, 2**55, 50).astype(np.uint64))
        a = rng.integers(0, 20, 50)
        b = np.where(rng.random(50) < 0.6, a, rng.integers(0, 20, 50))
        x, y = np.flatnonzero(a), np.flatnonzero(b)
        best = near.bag_min_hash(np.repeat([0, 1], [len(x), len(y)]), np.concatenate([ids[x], ids[y]]), np.concatenate([a[x], b[y]]), 2, 128)
        errors.append((best[0] == best[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def test_drawing_stops_at_nothing_that_matters():
    """Early stopping against drawing far more points of every process."""
    rng = np.random.default_rng(1)
    ids, weight = np.sort(rng.integers(0, 2**55, 30).astype(np.uint64)), rng.integers(1, 9, 30)
    one = near.bag_min_hash(np.zeros(30, int), ids, weight, 1, 16)
    # alone, each shingle has to fill all registers; the earliest of all is the same
    alone = np.min([near.bag_min_hash(np.zeros(1, int), ids[k : k + 1], weight[k : k + 1], 1, 16) for k in range(30)], axis=0)
    assert (one == alone).all() and np.isfinite(one).all()


@given(st.lists(st.text(alphabet="ab \n", max_size=40), min_size=1, max_size=6))
def test_shingles(texts):
    text, shingle, count = near.shingles(texts, near.WordHashes())
    for k, t in enumerate(texts):
        assert sorted(count[text == k].tolist()) == sorted(multiset(t).values())
        assert (np.diff(shingle[text == k].astype(np.int64)) > 0).all()


def test_classes_by_brute_force(spark, copies):
    docs = spark.createDataFrame([(k + 10, t, "z", "z") for k, t in enumerate(copies)], "doc_id long, text string, comp string, node string")
    rows = {r.doc_id: r for r in near.near_duplicates(docs).collect()}
    want = plain_classes(copies)
    assert [rows[k + 10].class_id for k in range(len(copies))] == [w + 10 for w in want]
    sizes = Counter(want)
    assert all(rows[k + 10].class_size == sizes[w] for k, w in enumerate(want))


def test_one_of_each_class_stays(spark, copies):
    docs = spark.createDataFrame([(k + 10, t, "z", "z") for k, t in enumerate(copies)], "doc_id long, text string, comp string, _node0 string")
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [w + 10 for w in sorted(set(plain_classes(copies)))]


def test_near_copies_are_found(spark):
    """Recall of edited copies against brute force, at the threshold of the queries and at a lower one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    ids = [r.doc_id for r in docs.orderBy("doc_id").collect()]
    for similarity in (0.8, 0.5):
        found = {r.doc_id: r.class_id for r in near.near_duplicates(docs, similarity).collect()}
        want = plain_classes(texts, similarity)
        linked = [(ids[k], ids[w]) for k, w in enumerate(want) if w != k]
        assert linked and np.mean([found[a] == found[b] for a, b in linked]) >= 0.99
        assert all(found[ids[k]] >= ids[w] for k, w in enumerate(want))  # and no others
    assert near.banding(0.8) == (20, 4) and near.banding(0.5) == (37, 2)
    for similarity in (0.05, 0.3, 0.5, 0.6, 0.75, 0.8, 0.95, 1.0):
        bands, rows = near.banding(similarity)
        assert (1 - similarity**rows) ** bands < 5e-5


def test_nothing_needless_is_left(spark, copies, tmp_path, monkeypatch):
    """Of the tables that are written on the way, only those that the result is read from stay."""
    from tarn.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    docs = spark.createDataFrame([(k + 10, t) for k, t in enumerate(copies)], "doc_id long, text string")
    conf = dict(spark.sparkContext._conf.getAll()), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert near.near_duplicates(docs).count() == len(copies) and len(list(tmp_path.iterdir())) == 2
    assert conf == (dict(spark.sparkContext._conf.getAll()), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))


def test_odd_rows(spark):
    rows = [(None, "p q r s t u"), (None, "p q r s t u"), (7, "p q r s t u"), (7, "p q r s t u"), (8, None), (9, ""), (7, "other words here at all times"), (None, "nowhere else seen words of mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r.doc_id, r.class_id, r.class_size) for r in near.near_duplicates(docs).collect())
    assert found == Counter({(None, 7, 4): 2, (7, 7, 4): 2, (8, 8, 2): 1, (9, 8, 2): 1, (7, 7, 1): 1, (None, None, 1): 1})
    kept = Counter((r.doc_id, r.text) for r in near.keep_one(docs).collect())
    assert kept == Counter([(7, "p q r s t u"), (8, None), (7, "other words here at all times"), (None, "nowhere else seen words of mine")])
    assert near.near_duplicates(docs.limit(0)).count() == 0 and near.keep_one(docs.limit(0)).count() == 0
    more = spark.createDataFrame([(1, "p q r s t u", x, y) for x, y in (("b", 2), ("a", 9), (None, None))], "doc_id long, text string, DOC_ID_2 string, node long")
    kept = near.keep_one(more).collect()
    assert kept == near.keep_one(more.repartition(3)).collect() and len(kept) == 1


@pytest.mark.parametrize("limits", [(600, 1000), (10**6, 7)])
def test_links_within_groups_in_small_blocks(spark, copies, monkeypatch, limits):
    """Blocks of a few texts give the classes that brute force gives."""
    monkeypatch.setattr(near.linked_within_groups, "__defaults__", limits)
    monkeypatch.setattr(near, "verified", lambda pairs, nodes, docs, similarity: pairs.limit(0))  # leaders find nothing
    texts = copies[:140]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.class_id for r in near.near_duplicates(docs).collect()}
    assert [rows[k] for k in range(len(texts))] == plain_classes(texts)


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 480)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = {r.id: r.comp for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: root(x) for x in parent}
    sizes = Counter(want.values())
    assert found == {x: c for x, c in want.items() if sizes[c] > 1}
    assert near.components(spark.createDataFrame([], "a long, b long")).count() == 0


# benchmark leaks


ITEMS = [
    (1, "What is the boiling point of pure water at sea level in degrees? Answer: it boils at one hundred degrees of celsius exactly"),
    (2, "Name the largest planet of our solar system, please. The largest planet is jupiter by a wide margin."),
    (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (4, "too short"), (5, None), (6, ""), (None, "An item without any id is an item like any other one. It can leak as well."),
    (7, "Which metal is liquid at room temperature and was used in old thermometers? It is mercury, also named quicksilver."),
]
FILLER = " ".join(f"filler{k % 97}" for k in range(400))


def make_index(items, of=None):
    """An index of items, with the statistics of all items that it is a shard of."""
    kept = [(i, t) for i, t in items if bm25.words(t)]
    bags = [bm25.words(t)[s:e] for _, t in (of or kept) if bm25.words(t) for s, e in bm25.cut(len(bm25.words(t)))]
    return bm25.Index(kept, len(bags), sum(map(len, bags)) / len(bags), Counter(w for b in bags for w in set(b)))


def plain_score(index, part, passage):
    """From the postings alone."""
    have = {index.terms[x] for x in passage if x in index.terms}
    at = np.searchsorted(index.entry_at, np.arange(len(index.part)), side="right") - 1
    return sum(index.gain[index.part == part][np.isin(index.entry[at[index.part == part]] // index.n_blocks, list(have))])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_wand_equals_scoring_everything(seed):
    rng = np.random.default_rng(seed)
    items = [(k, " ".join(f"t{int(x)}" for x in rng.zipf(1.4, rng.integers(1, 150)) % 60)) for k in range(int(rng.integers(1, 40)))]
    index = make_index(items)
    assert np.allclose(np.bincount(index.part, weights=index.gain), 1)
    passages = [sorted(set(rng.integers(0, len(index.terms), rng.integers(0, 25)).tolist())) for _ in range(12)]
    scores = {(b, p): index.gain[(index.part == p) & np.isin(np.repeat(index.entry // index.n_blocks, np.diff(index.entry_at)), terms)].sum() for b, terms in enumerate(passages) for p in range(len(index.parts))}
    pairs = np.repeat(np.arange(12), [len(x) for x in passages]), np.array([t for x in passages for t in x], np.int64)
    for most in (10**6, 1, 50):  # however many passages are searched at a time
        bm25.MOST_BOUNDS = most
        for threshold in (0.1, 0.3, 0.6):
            found = {(int(b), int(p)) for b, p in zip(*index.search(*pairs, threshold))}
            assert {k for k, v in scores.items() if v >= threshold} <= found <= {k for k, v in scores.items() if v >= threshold - 1e-8}
    bm25.MOST_BOUNDS = 1_000_000


def test_most_postings_are_skipped():
    """Of the bounds and postings of passages without a leak, a small part is touched (texts of 20 subjects with common words)."""
    rng = np.random.default_rng(5)
    text = lambda n, k: " ".join(f"t{k if x > 30 else 0}x{int(x)}" for x in rng.zipf(1.3, n) % 2000)
    index = make_index([(k, text(40, k % 20)) for k in range(2000)])
    words = [text(128, k % 20).encode().split() for k in range(200)]
    pairs = sorted({(b, index.terms[x]) for b, w in enumerate(words) for x in w if x in index.terms})
    passage, term = (np.array(x, np.int64) for x in zip(*pairs))
    every = int((index.entry_at[index.term_at[term + 1]] - index.entry_at[index.term_at[term]]).sum())
    index.search(passage, term, 0.5)
    assert index.touched < every / 6


def plain_leaks(index, text, threshold, least_q, least_a, least_whole):
    """Every passage against every part of every item, by definition."""
    w, found = bm25.words(text), {}
    for s in range(0, max(len(w) - bm25.PART, 1), bm25.PART):
        passage = w[s : s + 2 * bm25.PART]
        for part, (k, before, after) in enumerate(index.parts):
            score = plain_score(index, part, passage)
            wide = w[max(0, s - before) : s + 2 * bm25.PART + after]
            item = bm25.words(index.texts[k])
            if len(item) < bm25.LEAST_WORDS:
                right = any(wide[i : i + len(item)] == item for i in range(len(wide)))
                q, a = (bm25.overlap(bm25.grams(x, n), wide, {}) for x, n in zip(bm25.question_and_answer(index.texts[k]), (3, 2)))
            else:
                q, a = (bm25.overlap(bm25.grams(x, n), wide, {}) for x, n in zip(bm25.question_and_answer(index.texts[k]), (3, 2)))
                right = q >= least_q and a >= least_a or bm25.overlap(bm25.grams(item, 3), wide, {}) >= least_whole
            if score >= threshold - 1e-9 and right:
                found[k] = max(found.get(k, (0, 0, 0)), (score, q, a))
    return found


LONG = " ".join(f"long{k % 150}x{k // 7}" for k in range(400))


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6))
def test_leaks_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    items = [*ITEMS, (9, LONG)]
    index = make_index(items)
    texts = []
    for _ in range(4):
        parts = [FILLER[: int(rng.integers(0, 3000))]]
        for _ in range(int(rng.integers(0, 3))):
            words = items[int(rng.choice([0, 1, 2, 3, 7, 8]))][1].split()
            parts += [" ".join(edited(rng, words, int(rng.integers(0, 4)))), FILLER[: int(rng.integers(0, 800))]]
        texts.append("\n".join(parts))
    found = index.leaks([*texts, "", None], 0.6, 0.5, 0.5, 0.8)
    for k, text in enumerate(texts):
        want = plain_leaks(index, text, 0.6, 0.5, 0.5, 0.8)
        own = {item: x for t, item, *x in found if t == k}
        assert own.keys() == want.keys()
        for item in own:
            assert np.allclose(own[item], want[item])
    assert not [x for x in found if x[0] >= 4]


def test_leaks_are_the_same_in_any_shards():
    """Items of 2 to 400 words, in one index and each in one of its own: the same leaks with the same scores."""
    rng = np.random.default_rng(2)
    short = "Seven travellers crossed the northern valley before winter, all alone"
    items = [(1, short), (2, LONG), *((k + 3, t) for k, (_, t) in enumerate(ITEMS) if t)]
    texts = [f"{FILLER} {short} {FILLER}", FILLER + LONG + FILLER, " ".join(edited(rng, LONG.split(), 30)), f"we say too short {FILLER}", "too, Short!", "short too", short + LONG]
    whole = make_index(items).leaks(texts, *bm25_limits())
    own = sorted((t, k, *x) for k, item in enumerate(items) for t, _, *x in make_index([item], items).leaks(texts, *bm25_limits()))
    assert own == whole and {(t, items[k][0]) for t, k, *_ in whole} == {(0, 1), (1, 2), (2, 2), (3, 6), (4, 6), (6, 1), (6, 2)}


def bm25_limits():
    return bm25.THRESHOLD, bm25.LEAST_QUESTION, bm25.LEAST_ANSWER, bm25.LEAST_WHOLE


def test_question_and_answer():
    q, a = bm25.question_and_answer(ITEMS[0][1])
    assert q[-1] == b"degrees" and a[0] == b"it"
    assert bm25.question_and_answer(ITEMS[1][1])[1][:2] == [b"the", b"largest"]
    assert [len(x) for x in bm25.question_and_answer(ITEMS[2][1])] == [9, 3]


def documents(spark):
    upper = ITEMS[1][1].upper().replace(",", " --")
    rows = [
        (1, FILLER + "\n" + ITEMS[0][1] + "\n" + FILLER), (2, upper), (3, FILLER), (4, None), (5, ""), (None, ITEMS[2][1]), (6, ITEMS[0][1].split("Answer")[0] + FILLER),
        (7, "x " * 20000 + ITEMS[6][1]), (2, upper), (8, "too short"),
    ]
    return spark.createDataFrame([(*r, "c", 1.0) for r in rows], "doc_id long, text string, item_id string, score double")


@pytest.mark.parametrize("shard_items", [20_000, 1])
def test_leaks_in_shards(spark, monkeypatch, shard_items):
    monkeypatch.setattr(bm25.index_shards, "__defaults__", (shard_items, bm25.SHARD_CHARS))
    benchmark = spark.createDataFrame([(*r, "q") for r in [*ITEMS, ITEMS[0]]], "item_id long, text string, doc_id string")
    docs = documents(spark)
    found = Counter((r.doc_id, r.item_id) for r in bm25.find_leaks(docs, benchmark).collect())
    assert found == Counter({(1, 1): 1, (2, 2): 2, (None, 3): 1, (7, None): 1, (8, 4): 1})
    kept = bm25.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]


def test_no_items_and_no_documents(spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark)
    assert bm25.find_leaks(docs, benchmark.limit(0)).count() == 0 and bm25.find_leaks(docs.limit(0), benchmark).count() == 0
    assert bm25.decontaminate(docs, benchmark.limit(0)).count() == docs.count() and bm25.decontaminate(docs.limit(0), benchmark).count() == 0


def test_short_last_sentences_and_cut_copies(spark):
    """An item whose last sentence is a word or two is found without it, and so is one without its last quarter."""
    text = "Seven travellers crossed the northern valley before winter and counted every bridge they saw on the road to town. How many were there in all? Nine."
    q, a = bm25.question_and_answer(text)
    assert a == b"how many were there in all nine".split() and q[-1] == b"town"
    assert [len(x) for x in bm25.question_and_answer("one two three. four five six")] == [5, 1]
    w = text.split()
    copies = [text, " ".join(w[:-1]), " ".join(w[:-3]), " ".join(w[: len(w) - len(w) // 4]), " ".join(w[:8]), " ".join(reversed(w))]
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, text), *((k + 2, f"{ITEMS[k][1]}") for k in (0, 1, 2))], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in bm25.find_leaks(docs, benchmark).collect()) == [(0, 1), (1, 1), (2, 1), (3, 1)]
    assert sorted(r.doc_id for r in bm25.decontaminate(docs, benchmark).collect()) == [4, 5]
