"""N-gram Jaccard join by parity sketches.

A document's set holds its 5-word shingles as 64-bit hashes. For pairs whose smaller set lies in a size band, J >= 0.75 bounds the
symmetric difference by d. A sketch of m words is made by XOR-ing every shingle's hash into the word that the hash chooses: each
shingle in one set only changes one word, so the number of unequal words never exceeds the symmetric difference, and of the words of
one set at most d differ in the other. By the pigeonhole principle two such sketches agree in a non-empty word, if one of them has more
than d such words; under one order of all words they agree in one of the first d + 1 of each, and d may be each set's own bound, by its
size and the band: what bounds the one set's differences bounds the pair's. Those words are joined on (band, place, value). The order
puts words of very common shingles last, so a common passage makes no large groups unless a document is hardly
anything else. A set with d non-empty words or fewer (and any set of a small band) is joined by single shingles instead.

The joined words of a task go out packed by target partition. A group of up to SMALL documents gives its pairs; of a larger one,
every document is first held against the group's smallest; what is still in several components after that is compared inside the
group by a second, bitwise parity sketch, whose Hamming distance bounds the symmetric difference likewise, and only pairs within the bound
go on. A group of more than UNIT sets is dealt out as pairs of its parts, so that no task gets a whole large group. Every pair that goes on is verified on the whole sets. Equal sets are one class from the start.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as shared
from .common import BROADCAST_ROWS, chunks, drop, most_frequent, ship, sliced, table, texts, tidy
from .components import components
from .words import SPACED, split_words

SHINGLE = 5
#: J >= NUM / DEN.
NUM, DEN = 75, 100
#: Size bands start at these sizes; a band's sizes differ by less than this factor.
_RATIO = 5 / 3
#: Groups of up to so many give all their pairs at once.
SMALL = 8
#: A group of more sets is cut into parts of about so many sets, or into PARTS parts if those are more; two parts at a time are compared.
UNIT, PARTS = 512, 64
#: Shingles of the sets that one partition of the join stands for, about; the fewer partitions, the more words of a set share its id and size.
PART_WORDS = 2_500_000
#: Words that a task holds before it hands them on.
HELD_WORDS = 1_000_000
#: Common shingles that are put last: in so large a share of the documents, and so many at most (it is only an order).
COMMON_SHARE, COMMON_MOST = 0.002, 100_000
#: Ids that are broadcast at most; beyond it the texts are joined.
BROADCAST_IDS = 2_000_000
BROADCAST_BYTES = 48 << 20
BITS = 1024

#: The packed words take about as much disk as the input: their shuffle files go as soon as the groups are written.
cut = partial(shared.cut, freed=True)

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (splitmix64's finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(items, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words, of all its words; without words, none."""
    words, counts = split_words(items, SPACED)
    coded = words.dictionary_encode()
    table_ = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    w = table_[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
    n = len(w)
    rolled = np.zeros(max(0, n - shingle + 1), np.uint64)
    for j in range(shingle):
        rolled = rolled * _U(0x9E3779B97F4A7C15) + w[j : n - shingle + 1 + j]
    rolled = mix(rolled + _U(shingle)) if len(rolled) else rolled
    out, at = [], 0
    for c in counts.tolist():
        if c >= shingle:
            out.append(np.unique(rolled[at : at + c - shingle + 1]))
        elif c:
            one = np.zeros(1, np.uint64)
            for x in w[at : at + c]:
                one = one * _U(0x9E3779B97F4A7C15) + x
            out.append(mix(one + _U(c)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed 64-bit integers."""
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return tuple(int(x) - (1 << 64) if x >> 63 else int(x) for x in (h >> 64, h & (1 << 64) - 1))


def band_start(g: int) -> int:
    start = 1
    for _ in range(g):
        start = max(start + 1, int(start * _RATIO))
    return start


_STARTS = np.array([band_start(g) for g in range(60)])


def bands(size: int) -> range:
    """The bands in which a set of this size takes part: those of the sizes that the smaller set of a pair may have."""
    least = -(-NUM * size // DEN)
    return range(int(np.searchsorted(_STARTS, least, "right")) - 1, int(np.searchsorted(_STARTS, size, "right")))


def most_different(g: int, size: int | None = None) -> int:
    """The largest symmetric difference of a linked pair whose smaller set lies in band g, and one of whose sets has this size (None: any)."""
    end = int(_STARTS[g + 1]) - 1
    a = end if size is None else size
    b = a * DEN // NUM if a <= end else end
    # |A & B| >= (a + b) NUM / (NUM + DEN)
    return (a + b) * (DEN - NUM) // (DEN + NUM)


def sketch_words(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The hashes of the sketch words that a set is joined by."""
    out = []
    rare = ~_in_sorted(s, common)
    for g in bands(len(s)):
        # the band's bound makes the words, which must be the same for both sets; a set's own bound is enough for how many it is joined by
        most, d = most_different(g), most_different(g, len(s))
        enough = False
        if most >= 6:
            m = 2 * most + 2
            place = ((s >> _U(33)) % _U(m)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            place, x = place[order], s[order]
            first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            value = mix(np.bitwise_xor.reduceat(x, first) ^ mix(place[first].astype(np.uint64) + _U(g << 32)))
            last = ~np.logical_or.reduceat(rare[order], first)
            out.append(_prefix(value, last, d + 1))
            enough = len(first) > d
        if not enough:
            out.append(_prefix(mix(s ^ mix(np.array([(1 << 40) + g], np.uint64))), ~rare, d + 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _prefix(value: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    return value[np.lexsort((value, last))[:n]] if len(value) > n else value


def _in_sorted(s: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(s), bool)
    return among[np.minimum(np.searchsorted(among, s), len(among) - 1)] == s


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted, distinct) have J >= NUM / DEN."""
    if min(len(a), len(b)) * DEN < max(len(a), len(b)) * NUM:
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    both = int(_in_sorted(small, large).sum())
    return both * DEN >= NUM * (len(a) + len(b) - both)


def bit_sketch(s: np.ndarray) -> bytes:
    """Parity bits, BITS or the power of two from 2 * len(s) up: bit i is the parity of the shingles that choose it."""
    bits = max(BITS, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((mix(s) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words of sketches, folded to fewer words: the parities of a sketch of so few bits."""
    while sketch.shape[1] > words:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def hamming_bounded(a: list[bytes], b: list[bytes], na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether the size and the Hamming distance of the sketches allow a link, pair by pair."""
    ok = np.minimum(na, nb) * DEN >= np.maximum(na, nb) * NUM
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    for x, y in np.unique(np.stack([la[ok], lb[ok]], 1), axis=0):
        k = np.flatnonzero(ok & (la == x) & (lb == y))
        words = min(x, y) // 8
        one, two = (fold(np.frombuffer(b"".join([side[i] for i in k]), np.uint64).reshape(len(k), -1), words) for side in (a, b))
        ok[k] = np.bitwise_count(one ^ two).sum(1).astype(np.int64) * (NUM + DEN) <= (na[k] + nb[k]) * (DEN - NUM)
    return ok


# -- passes over the documents -------------------------------------------------------------------------------------------

SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("sketch", pa.binary()), ("shingle", pa.int64()), ("df", pa.int64())])
SETS_DDL = "doc_id long, n long, hi long, lo long, sketch binary, shingle long, df long"
PACKED = pa.schema([("part", pa.int32()), ("words", pa.binary()), ("owners", pa.binary()), ("los", pa.binary()), ("sizes", pa.binary())])
WHOLE = pa.schema([("id", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("shingles", pa.binary())])
WHOLE_DDL = "id long, hi long, lo long, shingles binary"


def _measure(batches):
    """A row a document (n, fingerprint); and a row for each shingle that is common in a chunk of documents (df, doc_id null)."""
    for b in chunks(batches):
        sets = shingle_sets(b.column("text"))
        prints = [fingerprint(s) if len(s) else (0, 0) for s in sets]
        n = len(sets)
        yield table({"doc_id": b.column("doc_id"), "n": [len(s) for s in sets], "hi": [h for h, _ in prints], "lo": [lo for _, lo in prints], "sketch": [bit_sketch(s) if len(s) else None for s in sets], "shingle": [None] * n, "df": [None] * n}, SETS)
        one = list({p: s for p, s in zip(prints, sets) if len(s)}.values())  # equal sets count once
        if len(one) >= 64:
            value, df = np.unique(np.concatenate(one), return_counts=True)
            value, df = value[df >= max(4, 0.005 * len(one))], df[df >= max(4, 0.005 * len(one))]
            if k := len(value):
                yield table({"doc_id": [None] * k, "n": [None] * k, "hi": [None] * k, "lo": [None] * k, "sketch": [None] * k, "shingle": value.view(np.int64), "df": df}, SETS)
        tidy()


def _narrow(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max()))).tobytes()


def _wide(x: bytes, n: int) -> np.ndarray:
    """n counts that _narrow() packed."""
    return np.frombuffer(x, f"u{len(x) // n}")


def _pack(parts: int, common):
    def run(batches):
        last, held, owners, los, sizes, n = common.value, [], [], [], [], 0
        seen: set[tuple[int, int]] = set()

        def flush():
            words, owner, who, size = np.concatenate(held), np.concatenate(owners), np.array(los, np.int64), np.array(sizes, np.uint32)
            part = (words % _U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.unique(part).tolist():
                mine = order[edges[p] : edges[p + 1]]
                used, n_words = np.unique(owner[mine], return_counts=True)  # words are in order of their owners
                high = words[mine].view(np.uint8).reshape(-1, 8)[:, 2:]  # 48 bits; the part tells some of the rest
                yield table({"part": [p], "words": [high.tobytes()], "owners": [_narrow(n_words)], "los": [who[used].tobytes()], "sizes": [_narrow(size[used])]}, PACKED)

        for b in chunks(batches):
            for s in shingle_sets(b.column("text")):
                if not len(s) or (f := fingerprint(s)) in seen:
                    continue
                seen.add(f)
                w = sketch_words(s, last)
                held.append(w)
                owners.append(np.full(len(w), len(los), np.uint32))
                los.append(f[1])
                sizes.append(len(s))
                n += len(w)
                if n >= HELD_WORDS or len(los) == 1 << 16:
                    yield from flush()
                    held, owners, los, sizes, n = [], [], [], [], 0
        if n:
            yield from flush()
        del held, owners
        tidy()

    return run


PAIRS = pa.schema([("word", pa.int64()), ("x", pa.int64()), ("y", pa.int64())])


def _group(batches):
    """From packed words in order of part: pairs (word null) of small groups and of larger groups' smallest with each other one, if their
    sizes allow a link, and the larger groups themselves (word, x; y null)."""

    def made(words, owners, sizes):
        order = np.lexsort((owners, words))
        words, owners, sizes = words[order], owners[order], sizes[order]
        new = np.append(True, (words[1:] != words[:-1]) | (owners[1:] != owners[:-1]))
        words, owners, sizes = words[new], owners[new], sizes[new].astype(np.int64)  # a set that several tasks have seen
        start = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
        size = np.diff(np.append(start, len(words)))
        xs, ys = [], []
        for k in range(2, SMALL + 1):
            at = start[size == k]
            for i in range(k):
                for j in range(i + 1, k):
                    near = np.minimum(sizes[at + i], sizes[at + j]) * DEN >= np.maximum(sizes[at + i], sizes[at + j]) * NUM
                    xs.append(owners[at + i][near])
                    ys.append(owners[at + j][near])
        for at, k in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
            rest = slice(at + 1, at + k)
            near = np.minimum(sizes[at], sizes[rest]) * DEN >= np.maximum(sizes[at], sizes[rest]) * NUM
            ys.append(owners[rest][near])
            xs.append(np.full(len(ys[-1]), owners[at]))
        if xs and sum(map(len, xs)):
            pair = np.unique(np.stack([np.concatenate(xs), np.concatenate(ys)], 1), axis=0)
            for k in range(0, len(pair), 1 << 16):
                some = pair[k : k + (1 << 16)]
                yield table({"word": pa.nulls(len(some), pa.int64()), "x": some[:, 0], "y": some[:, 1]}, PAIRS)
        seen = set()
        for at, k in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
            group = owners[at : at + k]
            if (same := xxhash.xxh3_128_digest(group.tobytes())) not in seen:  # equal groups once
                seen.add(same)
                yield table({"word": np.full(k, (words[at] | _U(now & 0xFFFF)).view(np.int64)), "x": group, "y": pa.nulls(k, pa.int64())}, PAIRS)

    words, owners, sizes, now = [], [], [], None
    for b in batches:
        for part, w, o, los, own in zip(*(b.column(c).to_pylist() for c in ("part", "words", "owners", "los", "sizes"))):
            if part != now and words:
                yield from made(np.concatenate(words), np.concatenate(owners), np.concatenate(sizes))
                words, owners, sizes = [], [], []
            now = part
            high = np.frombuffer(w, np.uint8).reshape(-1, 6)
            words.append(np.concatenate([np.zeros((len(high), 2), np.uint8), high], 1).view(np.uint64).ravel())
            who = np.frombuffer(los, np.int64)
            n_words = _wide(o, len(who))
            owners.append(np.repeat(who, n_words))
            sizes.append(np.repeat(_wide(own, len(who)).astype(np.uint32), n_words))
    if words:
        yield from made(np.concatenate(words), np.concatenate(owners), np.concatenate(sizes))
    del words, owners, sizes
    tidy()


def _whole(wanted=None):
    """The sets of the documents whose doc_id is wanted (all if None)."""

    def run(batches):
        for b in chunks(batches):
            if wanted is not None:
                doc_id = pa.compute.fill_null(b.column("doc_id"), 0).to_numpy(zero_copy_only=False)
                here = _in_sorted(doc_id, wanted.value) & ~np.asarray(b.column("doc_id").is_null())
                b = b.filter(pa.array(here))
            if b.num_rows:
                sets = shingle_sets(b.column("text"))
                prints = [fingerprint(s) for s in sets]
                yield table({"id": b.column("doc_id"), "hi": [h for h, _ in prints], "lo": [lo for _, lo in prints], "shingles": [s.tobytes() for s in sets]}, WHOLE)

    return run


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(batches):
    for b in sliced(batches, 128):
        keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column("sx").to_pylist(), b.column("sy").to_pylist())]
        if any(keep):
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], schema=LINKS).filter(pa.array(keep))
    tidy()


def _bounded(batches):
    """Of pairs (a, b, na, nb, ka, kb), those within the bounds of size and of the bit sketches' Hamming distance."""
    for b in sliced(batches, 4096):
        na, nb = (b.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
        ok = hamming_bounded(b.column("ka").to_pylist(), b.column("kb").to_pylist(), na, nb)
        if ok.any():
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], schema=LINKS).filter(pa.array(ok))


def _near(nearest: bool):
    """From rows (word, p, q, part, id, component, size, sketch) in order of word, p, q: the pairs of sets of different components, one of part p
    and one of part q, within the bounds of size and Hamming distance (nearest: for each set, the one of the least distance among those not
    smaller). Rows word, a, b, distance; a is the set that b is near to."""

    def pairs(word, p, q, part, ids, comp, size, sketch):
        order = np.lexsort((ids, size))
        part, ids, comp, size = part[order], ids[order], comp[order], size[order]
        words = min(map(len, sketch)) // 8  # sizes of a group are within a small factor
        sketch = np.concatenate([fold(np.frombuffer(sketch[i], np.uint64).reshape(1, -1), words) for i in order])
        found = []
        for i in range(len(ids)):
            best = None
            upto = np.searchsorted(size, size[i] * DEN // NUM, "right")
            for j in range(i + 1, upto, 4096):
                k = slice(j, min(upto, j + 4096))
                hamming = np.bitwise_count(sketch[k] ^ sketch[i]).sum(1).astype(np.int64)
                ok = (comp[k] != comp[i]) & (hamming * (NUM + DEN) <= (size[k] + size[i]) * (DEN - NUM))
                if p != q:
                    ok &= part[k] != part[i]
                if ok.any():
                    other = np.flatnonzero(ok)
                    if not nearest:
                        found.append(np.stack([np.full(len(other), ids[i]), ids[k][other], hamming[other]]))
                    elif best is None or hamming[other].min() < best[0]:
                        best = (hamming[other].min(), ids[k][other[hamming[other].argmin()]])
            if best is not None:
                found.append(np.array([[ids[i]], [best[1]], [best[0]]], np.int64))
            if found and (sum(f.shape[1] for f in found) > 1 << 16 or i == len(ids) - 1):
                a, b, distance = np.concatenate(found, 1)
                yield table({"word": np.full(len(a), word), "a": a, "b": b, "distance": distance}, NEAR)
                found = []

    def run(batches):
        held, now = [], None
        for b in batches:
            word, p, q = (b.column(c).to_numpy(zero_copy_only=False) for c in ("word", "p", "q"))
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "id", "component", "size")]
            cols.append(np.array(b.column("sketch").to_pylist(), object))
            edge = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])))
            for a, z in zip(edge.tolist(), [*edge[1:].tolist(), len(word)]):
                if (word[a], p[a], q[a]) != now and held:
                    yield from pairs(*now, *(np.concatenate(x) for x in zip(*held)))
                    held = []
                now = (word[a], p[a], q[a])
                held.append([c[a:z] for c in cols])
        if held:
            yield from pairs(*now, *(np.concatenate(x) for x in zip(*held)))
        tidy()

    return run


NEAR = pa.schema([("word", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("distance", pa.int64())])


# -- the join ---------------------------------------------------------------------------------------------------------------


def classes_and_links(docs: DataFrame, partitions: int | None = None, few_rows: int = BROADCAST_ROWS, few_ids: int = BROADCAST_IDS, few_bytes: int = BROADCAST_BYTES, unit: int = UNIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, links): a row a document (doc_id, n, hi, lo); a row for each distinct set (hi, lo, id: its smallest doc_id,
    copies); and links between sets (a < b, ids) whose components are those of all links. few_rows, few_ids, few_bytes: bounds of broadcasts;
    beyond them tables are joined, with the same result."""
    spark = docs.sparkSession
    ship(spark)
    rows = texts(docs)
    measured = cut(rows.mapInArrow(_measure, SETS_DDL), "measured")
    members = measured.where("shingle is null").select("doc_id", "n", "hi", "lo")
    members_sketched = measured.where("shingle is null and n > 0")
    classes = cut(members_sketched.groupBy("hi", "lo").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.max("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    total, n_sets = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = measured.where("shingle is not null").groupBy("shingle").agg(F.sum("df").alias("df")).where(F.col("df") >= max(16, COMMON_SHARE * n_sets))
    top = [r[0] for r in most_frequent(often, "df", COMMON_MOST).collect()]
    common = spark.sparkContext.broadcast(np.sort(np.array(top, np.int64).view(np.uint64)))

    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_WORDS))
    packed = rows.mapInArrow(_pack(parts, common), "part int, words binary, owners binary, los binary, sizes binary")
    grouped = cut(packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_group, "word long, x long, y long"), "grouped")
    pairs = grouped.where("word is null").select("x", "y").distinct()
    large = grouped.where("word is not null").select("word", F.col("x").alias("lo"))

    known = classes.where("id is not null").select("lo", "id", "n", "sketch")
    kx, ky = (known.select(F.col("lo").alias(k), F.col("id").alias(f"i{k}"), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"k{k}")) for k in "xy")
    both = pairs.join(kx, "x").join(ky, "y").select(F.col("ix").alias("a"), F.col("iy").alias("b"), F.col("nx").alias("na"), F.col("ny").alias("nb"), F.col("kx").alias("ka"), F.col("ky").alias("kb"))
    candidates = cut(both.mapInArrow(_bounded, "a long, b long"), "candidates")
    links = _verified(rows, classes, candidates, few_ids)
    drop(candidates)
    if large.limit(1).count():
        # first only the nearest of another component for each set: what that joins needs no further comparison. Components only
        # grow, so the second round looks at the groups that were mixed in the first
        first = _mixed(large.join(known.select("lo", "id", F.col("n").alias("size")), "lo").select("word", "id", "size"), components(links), few_rows, unit)
        links = _joined(links, first, True, rows, classes, known, few_ids, few_bytes)
        rest = _mixed(first.drop("component", "parts"), components(links), few_rows, unit)
        drop(first)
        links = _joined(links, rest, False, rows, classes, known, few_ids, few_bytes)
        drop(rest)
    drop(grouped)
    return members, classes, links


def _joined(links: DataFrame, mixed: DataFrame, nearest: bool, rows: DataFrame, classes: DataFrame, known: DataFrame, few_ids: int, few_bytes: int) -> DataFrame:
    """links, and those that the groups still give."""
    near, sketches = _residual(mixed, known, nearest, few_bytes)
    near = cut(near.distinct(), "near")
    drop(sketches)
    if near.limit(1).count():
        links = links.union(_verified(rows, classes, near, few_ids))
    drop(near)
    return links


def _mixed(groups: DataFrame, label: DataFrame, few_rows: int, unit: int) -> DataFrame:
    """groups (word, id, size) with components, and parts (into how many the group is cut), of words whose sets are in several; written."""
    few = label.limit(few_rows + 1).count() <= few_rows
    at = groups.join(F.broadcast(label) if few else label, "id", "left").select("word", "id", F.coalesce("component", "id").alias("component"), "size")
    at = cut(at, "groups")
    per = at.groupBy("word").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n")).where("least <> most")
    per = cut(per.select("word", F.least(F.lit(PARTS), F.ceil(F.col("n") / unit)).cast("int").alias("parts")), "several")
    few = per.limit(few_rows + 1).count() <= few_rows
    found = cut(at.join(F.broadcast(per) if few else per, "word"), "mixed")
    drop(at)
    drop(per)
    return found


def _residual(rest: DataFrame, known: DataFrame, nearest: bool, few_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, the written sketches that they are made from). Pairs (a, b) of different components in a mixed group (word, id, component, size, parts; a written table, since right after a join a
    repartition on its key would be left out, and a skewed word's rows dealt to several tasks) whose sizes and bit sketches allow a link
    (nearest: for each set of a group one of the least Hamming distance only)."""
    sketches = cut(known.select("id", "sketch").join(rest.select("id").distinct(), "id", "left_semi"), "sketches")
    size = sketches.agg(F.coalesce(F.sum(F.length("sketch") + 32), F.lit(0))).first()[0]
    # a set goes to every pair of parts that has its own: it is there as often as its group has parts
    part = rest.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    units = part.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("word", F.least("part", "o").alias("p"), F.greatest("part", "o").alias("q"), "part", "id", "component", "size")
    columns = ("word", "p", "q", "part", "id", "component", "size", "sketch")
    if size <= few_bytes:  # after the shuffle, so that it carries no sketches
        wide = units.repartition("word", "p", "q").join(F.broadcast(sketches), "id").select(*columns).sortWithinPartitions("word", "p", "q")  # a sort before a join is left out
    else:
        wide = cut(units.join(sketches, "id"), "wide").select(*columns).repartition("word", "p", "q").sortWithinPartitions("word", "p", "q")
    near = wide.mapInArrow(_near(nearest), "word long, a long, b long, distance long")
    if nearest:  # of a set's nearest in each part
        near = near.groupBy("word", "a").agg(F.min(F.struct("distance", "b")).alias("n")).select("a", "n.b")
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), sketches


def _verified(rows: DataFrame, classes: DataFrame, pairs: DataFrame, few_ids: int) -> DataFrame:
    """Of pairs (a, b: ids of classes; a written table), those whose sets are linked. Only the sets of the pairs' classes are made."""
    spark = rows.sparkSession
    ids = cut(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    if ids.count() <= few_ids:
        wanted = np.sort(np.fromiter((r[0] for r in ids.toLocalIterator()), np.int64))
        some = rows.mapInArrow(_whole(spark.sparkContext.broadcast(wanted)), WHOLE_DDL)
    else:
        some = rows.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_whole(), WHOLE_DDL)
    sets = cut(some, "sets")
    # a doc_id may stand for several texts; the class tells which of them is meant
    of = classes.select("id", "hi", "lo")
    p = pairs.join(of.select(F.col("id").alias("a"), F.col("hi").alias("ha"), F.col("lo").alias("la")), "a").join(of.select(F.col("id").alias("b"), F.col("hi").alias("hb"), F.col("lo").alias("lb")), "b")
    sb = sets.select(F.col("id").alias("b"), F.col("hi").alias("hb"), F.col("lo").alias("lb"), F.col("shingles").alias("sy"))
    sa = sets.select(F.col("id").alias("a"), F.col("hi").alias("ha"), F.col("lo").alias("la"), F.col("shingles").alias("sx"))
    found = cut(p.join(sb, ["b", "hb", "lb"]).join(sa, ["a", "ha", "la"]).select("a", "b", "sx", "sy").mapInArrow(_verify, "a long, b long").distinct(), "links")
    drop(sets)
    drop(ids)
    return found


def join(docs: DataFrame, tables: list | None = None, **bounds: int) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id (smallest doc_id reachable by links).

    docs: doc_id, text. A row for every row, equal ones too. Null and empty texts, and texts of white space, have an empty set and are
    linked with nothing (class and component are the row's own doc_id). A null doc_id stays null; such rows count as members of their
    set's class, and only a class without any doc_id has a null class and component. Texts are taken whole. Other columns are
    not read. An empty table gives an empty one. bounds: as in classes_and_links(). tables: a list that gets
    the written tables that the result is made from, for the caller to drop() when the result is written.
    """
    members, classes, links = classes_and_links(docs, **bounds)
    label = cut(components(links), "components")
    # classes of one document without links need no join
    known = cut(classes.join(label, "id", "left").where("copies > 1 or component is not null").select("hi", "lo", "id", F.coalesce("component", "id").alias("component")), "known")
    if tables is not None:
        tables += [members, classes, links, label, known]
    out = members.join(known, ["hi", "lo"], "left")
    own = F.when(F.col("id").isNotNull(), F.col("id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("component").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    empty = F.col("n") == 0
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(own).alias("class_id"),
        F.when(empty, F.col("doc_id")).otherwise(component).alias("component_id"),
    )


def one_each(docs: DataFrame, few_ids: int = BROADCAST_IDS) -> DataFrame:
    """One document of each group of linked ones, the one of the smallest doc_id; all columns, whatever their names. Documents with an empty set
    (null and empty texts) stay; very long texts are compared whole; an empty table gives an empty one.

    Rows are told apart by doc_id: rows that repeat a doc_id stay or go together, and a null doc_id stays.
    """
    tables: list = []
    gone = cut(join(docs, tables).where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    for t in tables:
        drop(t)
    if gone.count() > few_ids:
        ids = gone.select(F.col("doc_id").alias("_gone"))
        return docs.join(ids, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti").select(*(docs[c] for c in docs.columns))
    ids = docs.sparkSession.sparkContext.broadcast(np.sort(np.fromiter((r[0] for r in gone.toLocalIterator()), np.int64)))
    at = docs.columns.index("doc_id")

    def run(batches):
        for b in sliced(batches, 1024):
            doc_id = pa.compute.fill_null(b.column(at).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(~_in_sorted(doc_id, ids.value) | np.asarray(b.column(at).is_null())))
        tidy()

    return docs.mapInArrow(run, docs.schema)
