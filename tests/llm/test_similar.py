import random
import re
import time

import numpy as np
import pyarrow as pa
from llm.helpers import ODD, empty, odd
from pyspark.sql import functions as F

import corpus_pipeline
from biotope.llm import components, decontaminate, jaccard, queries
from biotope.llm.common import FILE_CLEANUP
from biotope.llm.words import ALNUM, split_words

WORD = re.compile("[^\x20\x09-\x0d]+")


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def shingles(t):
    w = WORD.findall(fold(t))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    boss = list(range(len(sets)))

    def find(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                boss[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(sets):
        best[find(i)] = min(best.get(find(i), d), d)
    return sorted((d, len(s), best[find(i)]) for i, (d, s) in enumerate(sets))


def near_copies(n, seed, words=60, edits=3):
    r = random.Random(seed)
    base = [f"w{r.randint(0, 400)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 9999)}"
        out.append(" ".join(w))
    return out


def test_join_against_brute_force(spark):
    r = random.Random(1)
    texts = near_copies(60, 2) + near_copies(40, 3, 200, 8) + near_copies(30, 4, 8, 1) + [" ".join(r.choice("abcde") for _ in range(r.randint(0, 12))) for _ in range(150)]
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"o{r.randint(0, 99999)}" for _ in range(r.randint(3, 40))) for _ in range(80)]
    r.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute_components(rows)
    # beyond every bound of a broadcast, with large groups in parts of a few sets
    beyond = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), few_rows=0, few_ids=0, few_bytes=0, unit=5).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in beyond) == brute_components(rows)


def test_join_of_odd_tables(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(odd(spark)).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 8, 5), (None, 8, 5), (7, 1, 7), (8, 1, 8)} <= got
    assert jaccard.join(odd(spark)).count() == len(ODD) and jaccard.join(empty(spark)).count() == 0
    one = jaccard.one_each(odd(spark))
    assert one.columns == odd(spark).columns and one.count() == len(ODD)
    copies = odd(spark).withColumn("doc_id", F.when(F.col("doc_id") == 6, 8).otherwise(F.col("doc_id"))).union(odd(spark).where("doc_id = 7").withColumn("doc_id", F.lit(70).cast("long")))
    for few in (100, 0):
        kept = jaccard.one_each(copies, few_ids=few)
        assert kept.columns == copies.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 5, 7, 8, 8]


def test_packed_words_name_their_owner_once():
    """Blocks hold a count for each set, not an index for each word; unpacked, every word has its set and size again."""
    for counts in ([1], [3, 255], [1, 256, 7], [70_000, 2]):
        packed = jaccard._narrow(np.array(counts))
        assert len(packed) == len(counts) * (1 if max(counts) < 256 else 2 if max(counts) < 65_536 else 4)
        assert jaccard._wide(packed, len(counts)).tolist() == counts
    docs = pa.record_batch({"doc_id": pa.array([1, 2, 3]), "text": [" ".join(f"w{i * k}" for i in range(n)) for k, n in ((1, 400), (3, 900), (7, 6))]})

    class Common:
        value = np.zeros(0, np.uint64)

    blocks = [r for b in jaccard._pack(3, Common)([docs]) for r in b.to_pylist()]
    sets = {jaccard.fingerprint(x)[1]: x for x in jaccard.shingle_sets(docs.column("text"))}
    got = {lo: [] for lo in sets}
    for r in blocks:
        los = np.frombuffer(r["los"], np.int64)
        n_words, sizes = jaccard._wide(r["owners"], len(los)), jaccard._wide(r["sizes"], len(los))
        assert len(r["owners"]) <= 2 * len(los) and n_words.sum() * 6 == len(r["words"])
        assert [len(sets[lo]) for lo in los.tolist()] == sizes.tolist()
        words = np.split(np.frombuffer(r["words"], np.uint8).reshape(-1, 6), np.cumsum(n_words)[:-1])
        for lo, w in zip(los.tolist(), words):
            got[lo] += [x.tobytes() for x in w]
    for lo, x in sets.items():
        assert sorted(got[lo]) == sorted(w.tobytes()[2:] for w in jaccard.sketch_words(x, Common.value))


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 900), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, rng.integers(0, 90), dtype=np.uint64)]))
        if not len(b):
            continue
        different = len(np.setxor1d(a, b))
        ka, kb = (np.frombuffer(jaccard.bit_sketch(x), np.uint64).reshape(1, -1) for x in (a, b))
        n = min(ka.shape[1], kb.shape[1])
        assert int(np.bitwise_count(jaccard.fold(ka, n) ^ jaccard.fold(kb, n)).sum()) <= different
        if jaccard.linked(a, b):
            none = np.zeros(0, np.uint64)
            assert jaccard.hamming_bounded([jaccard.bit_sketch(a)], [jaccard.bit_sketch(b)], np.array([len(a)]), np.array([len(b)]))[0]
            assert len(np.intersect1d(jaccard.sketch_words(a, none), jaccard.sketch_words(b, none)))
            assert len(np.intersect1d(jaccard.sketch_words(a, a[::2]), jaccard.sketch_words(b, a[::2])))


def test_sets_are_joined_by_as_many_words_as_their_size_needs():
    """Of a set of n shingles, no more words a band than the largest difference of a linked pair of that size there, and one; pairs just
    within the threshold still share one, at the ends of the bands too."""
    rng, none = np.random.default_rng(7), np.zeros(0, np.uint64)
    edges = [int(x) + k for x in jaccard._STARTS[2:14] for k in (-1, 0, 1)]
    for n in [*range(1, 60), *(x for x in edges if x < 1200), *rng.integers(60, 1200, 30).tolist()]:
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        most = 0
        for g in jaccard.bands(n):
            first, end = int(jaccard._STARTS[g]), int(jaccard._STARTS[g + 1]) - 1
            others = [m for m in range(-(-3 * n // 4), 4 * n // 3 + 1) if first <= min(m, n) <= end]
            assert jaccard.most_different(g, n) == (n + max(others)) // 7 <= jaccard.most_different(g)
            most += (n + max(others)) // 7 + 1
        words = jaccard.sketch_words(a, none)
        assert len(words) <= (most if n > 60 else 2 * most)  # a set that is small for its sketch is joined by its shingles as well
        for m in {-(-3 * n // 4), n, 4 * n // 3, int(rng.integers(-(-3 * n // 4), 4 * n // 3 + 1))}:
            both = -(-3 * (n + m) // 7)  # the least intersection of a linked pair
            b = np.unique(np.concatenate([rng.permutation(a)[:both], rng.integers(0, 2**63, m - both, dtype=np.uint64)]))
            assert jaccard.linked(a, b)
            for last in (none, a[::2], np.sort(b)):
                assert len(np.intersect1d(jaccard.sketch_words(a, last), jaccard.sketch_words(b, last)))


def test_shuffle_files_of_the_join_go(spark):
    """What the join has shuffled for a written table is deleted with the table's writing; the session's setting stays as it was."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def there():
        files = blocks.getAllFiles().iterator()
        return {name for name in iter(lambda: files.next().getName() if files.hasNext() else None, None) if re.match(r"shuffle_.*\.data$", name)}

    before, setting = there(), spark.conf.get(FILE_CLEANUP, "false")
    table = jaccard.cut(spark.range(5000).withColumn("k", F.xxhash64("id") % 100).repartition(7, "k"), "t")
    until = time.monotonic() + 20
    while there() - before and time.monotonic() < until:  # it is done in the background
        time.sleep(0.2)
    assert not there() - before and table.count() == 5000
    assert spark.conf.get(FILE_CLEANUP, "false") == setting


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 102), (102, 101), (7, 7), (None, 3)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100}


def brute_hits(docs, bench, w):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    wins = {}
    for i, t in bench:
        ws = word.findall(fold(t))
        for k in range(max(1, len(ws) - w + 1) if ws else 0):
            wins.setdefault(tuple(ws[k : k + w]), set()).add(str(i))
    out = []
    for d, t in docs:
        ws, hit, items = word.findall(fold(t)), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(ws) - size + 1):
                if x := wins.get(tuple(ws[k : k + size])):
                    hit |= set(range(k, k + size))
                    items |= x
        out.append((d, len(ws), len(hit), sorted(items)))
    return sorted(out, key=repr)


def test_hits_against_brute_force(spark):
    r = random.Random(3)

    def text(n, v):
        return "".join(r.choice(v) + r.choice([" ", ", ", "\n", "-"]) for _ in range(r.randint(0, n)))

    for trial in range(60):
        v = ["a", "b", "cé", "D", "e1"][: r.randint(1, 5)]
        docs = [(i, r.choice([None, text(60, v), text(5, v)])) for i in range(r.randint(1, 12))]
        bench = [(i, text(20, v)) for i in range(r.randint(1, 8))]
        blocks = [decontaminate.Block([str(i) for i, _ in part], [t for _, t in part], 4) for part in ((bench,), (bench[::3], bench[1::3], bench[2::3]))[trial % 2] if part]
        shard = decontaminate.Shard([d for d, _ in docs], *split_words(pa.array([t for _, t in docs], pa.string()), ALNUM))
        for block in blocks:
            shard.know(block)
        longest = [m for block in blocks for m in shard.match(block, True)]
        o = shard.rows()
        got = sorted(((d, int(a), int(b), i) for d, a, b, i in zip(o["doc_id"], o["n_words"], o["n_hit"], o["items"])), key=repr)
        assert got == brute_hits(docs, bench, 4)
        assert sorted(longest, key=repr) == brute_longest(docs, bench, 4)
        assert list(zip(o["doc_id"], o["longest"], o["longest_at"], o["longest_item"])) == [(d, *brute_document(t, bench, 4)) for d, t in docs]


def alnum(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", fold(t or ""))


def shared(a, b):
    """Words that two lists begin with."""
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def brute_longest(docs, bench, w):
    """The longest match of every benchmark suffix: smallest doc_id, then place."""
    out = []
    for item, t in bench:
        words = alnum(t)
        for offset in range(len(words)):
            if len(words) - offset >= w or not offset:
                found = [(-shared(words[offset:], (ws := alnum(x))[p:]), d, p) for d, x in docs for p in range(len(alnum(x)))]
                if found and -(best := min(found))[0] >= min(w, len(words) - offset):
                    out.append((str(item), offset, -best[0], best[1], best[2]))
    return sorted(out, key=repr)


def brute_document(text, bench, w):
    ws, best = alnum(text), (0, 0, None)
    for p in range(len(ws)):
        for item, t in bench:
            words = alnum(t)
            for offset in range(len(words)):
                n = shared(ws[p:], words[offset:])
                if (not offset or len(words) - offset >= w) and n >= min(w, len(words) - offset) and (n, -p, -int(item)) > (best[0], -best[1], -int(best[2] or 10**9)):
                    best = (n, p, str(item))
    return (best[0], best[1], best[2]) if best[0] else (0, None, None)


def test_hits_of_odd_tables(spark):
    bench = spark.createDataFrame([(1, "B c, d e f g h i j K l m"), (2, None), (None, "x"), (3, "one"), (3, ""), (4, "one")], "item_id long, text string")
    for size, rows in ((1, 20_000), (1 << 20, 20_000), (1 << 20, 1)):
        got = decontaminate.hits(odd(spark), bench, shard_words=size, block_rows=rows)
        rows = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()), key=repr)
        assert rows == brute_hits([(d, t) for d, t, _ in ODD], [(1, "B c, d e f g h i j K l m"), (3, "one"), (4, "one")], 10)
    kept = decontaminate.clean(odd(spark), bench)
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD) - 4  # three of doc 5's text, and doc 4
    assert decontaminate.clean(odd(spark), bench, block_rows=1).count() == len(ODD) - 4
    assert {(r.doc_id, r.longest, r.longest_at, r.longest_item) for r in decontaminate.hits(odd(spark), bench).where("contaminated").collect()} == {(5, 11, 1, "1"), (None, 11, 1, "1"), (4, 1, 0, "3")}
    assert decontaminate.hits(empty(spark), bench).count() == 0 and decontaminate.hits(odd(spark), bench.limit(0)).where("contaminated").count() == 0
    best = decontaminate.longest_matches(odd(spark), bench).where("item_id = '1' and offset = 0").first()
    assert (best.n_words, best.doc_id, best.position) == (11, 5, 1)


def test_items_without_id(spark, tmp_path):
    """The query and the pipeline's stage count an item without an id; only the id is missing."""
    passage = " ".join(f"p{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"so {passage} end"), (2, "clean words"), (3, f"{passage} and q")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (None, None), (7, "q")], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in queries.op3_decontamination(spark, str(tmp_path)).collect())
    assert got == [(1, 12, 0, True), (2, 0, 0, False), (3, 13, 1, True)]
    assert [r.doc_id for r in corpus_pipeline.benchmark(spark, docs, str(tmp_path)).collect()] == [2]
