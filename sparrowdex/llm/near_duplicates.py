"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles is signed by 30 MinHash symbols of 16 bits.
Two signatures are *near* when at most ``ERRORS`` = 13 symbols differ.  The
symbols are split into 7 chunks; by pigeonhole a near pair has a chunk with at
most one wrong symbol (2 * 7 > 13), and every allowed error is enumerated by a
key that leaves that one symbol out.  So every near pair meets under one of 30
keys - a guarantee, not a probability.  (A pair at the similarity threshold is
near with probability 0.9998 at 0.85 and 0.999 at 0.8.)

Pairs within a group of copies are never all built:

1. equal shingle sets become one node;
2. the rows of each key are sorted, and each is compared with its predecessor
   only; of these pairs the most promising of each node are confirmed on full
   sets first, the others only if they would still join two components;
3. a key whose nodes now share a component is done.  For the others, blocks of
   bounded size find the near pairs *across* components; those of two blocks
   travel packed in one row to one task, which holds the texts of both blocks,
   confirms all of them on full sets and returns a spanning forest.

What is left out is only what cannot change a component.  A key with very many
rows is dealt over range partitions in step 2 and over pairs of blocks in step 3.
There, a component with many nodes under a key has blocks of its own, which
meet no other block of that component, so the work follows the pairs across components and not
the square of the key.  Rows of a set with very many copies are reduced to one before any
shuffle by their node, and get their component from a broadcast of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

SYMBOLS, CHUNKS, ERRORS = 30, (5, 5, 4, 4, 4, 4, 4), 13
SKETCH = 128
BLOCK = 512
_START = np.concatenate([[0], np.cumsum(CHUNKS)])
#: Key t leaves symbol t out: the other symbols of its chunk.
_REST = [[s for s in range(_START[c], _START[c + 1]) if s != t] for t in range(SYMBOLS) for c in [int(np.searchsorted(_START, t, "right")) - 1]]
#: The symbols by which the rows of key t are sorted: those of the next chunk.
_NEXT = [[(_START[-1] + _START[(int(np.searchsorted(_START, t, "right"))) % len(CHUNKS)] + i) % SYMBOLS for i in range(4)] for t in range(SYMBOLS)]
_r = np.random.Generator(np.random.PCG64(77))
_A = _r.integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _r.integers(1, 1 << 63, SKETCH, dtype=np.uint64)
_K = _r.integers(1, 1 << 63, SYMBOLS + 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(shingle_set: np.ndarray) -> np.ndarray:
    """128 minima of linear hashes over a set, 2,048 members at a time."""
    low = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingle_set), 2048):
            part = shingle_set[i : i + 2048]
            np.minimum(low, (part[None, :] * _A[:, None] + _B[:, None]).min(1), out=low)
    return C.mix(low)


def _sign(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows with their set's node and signature; a set that a task meets again has the node only, so copies stay small."""
    seen: set[int] = set()
    for b in batches:
        ids, ths = b.column(0), b.column(1)
        n_sh, node, sig, low = [], [], [], []
        for words, _ in C.batch_words(C.text_bytes(b.column(2))):
            u = np.unique(C.shingles(words, k))
            n_sh.append(len(u))
            if len(u):
                with np.errstate(over="ignore"):
                    node.append(int(C.as_long(C.mix(np.array([C.mix(u).sum() + np.uint64(len(u))], np.uint64)))[0]))
                if node[-1] in seen:
                    sig.append(None)
                    continue
                if len(seen) < 200_000:
                    seen.add(node[-1])
                s = sketch(u)
                low.append(s[:SYMBOLS] & np.uint64(0xFFFF))
                sig.append(low[-1].astype("<u2").tobytes() + (s[SYMBOLS:] & np.uint64(0xFF)).astype(np.uint8).tobytes())
            else:
                node.append(None)
                sig.append(None)
        keys: list = [None] * len(node)
        orders: list = [None] * len(node)
        if low:
            m = np.array(low, np.uint64)
            with np.errstate(over="ignore"):
                key = np.stack([C.mix((m[:, _REST[t]] + np.uint64(1)) @ _K[: len(_REST[t])] * np.uint64(64) + np.uint64(t)) for t in range(SYMBOLS)], 1)
                key = key & ~np.uint64(31) | np.arange(SYMBOLS, dtype=np.uint64)  # the low bits name the key
                order = np.stack([(m[:, _NEXT[t]] << np.array([48, 32, 16, 0], np.uint64)).sum(1, dtype=np.uint64) for t in range(SYMBOLS)], 1)
            at = [i for i, x in enumerate(sig) if x is not None]
            for i, x, y in zip(at, C.as_long(key).tolist(), C.as_long(order).tolist(), strict=True):
                keys[i], orders[i] = x, y
        yield pa.RecordBatch.from_arrays([ids, ths, pa.array(n_sh, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(orders, pa.list_(pa.int64()))], ["doc_id", "th", "n_shingles", "node", "sig", "keys", "orders"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: those whose key has others (or may have, at a partition's edge), with the row before of the same key."""
    key = node = None
    first = True

    for b in batches:
        k, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        if key is not None:
            k, n = np.concatenate([key, k]), np.concatenate([node, n])
        if len(k) < 3:
            key, node = k, n
            continue
        same = k[1:] == k[:-1]
        keep = np.concatenate([[first], same]) | np.concatenate([same, [False]])
        # the last two rows are carried: the last for its successor, the one before for the last's predecessor
        p = np.concatenate([[0], n[:-1]])
        done = slice(0, len(k) - 1) if first else slice(1, len(k) - 1)
        prev = pa.array(p, pa.int64(), mask=~(np.concatenate([[False], same]) & (n != p)))
        yield from pa.table({"key": k, "node": n, "prev": prev}).slice(done.start, done.stop - done.start).filter(pa.array(keep[done])).to_batches()
        key, node, first = k[-2:], n[-2:], False
    if key is not None:
        same = key[1:] == key[:-1]
        p = np.concatenate([[0], node[:-1]])
        prev = pa.array(p, pa.int64(), mask=~(np.concatenate([[False], same]) & (node != p)))
        t = pa.table({"key": key, "node": node, "prev": prev})
        yield from (t if first else t.slice(1)).to_batches()


def _parts(sigs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)
    return raw[:, : 2 * SYMBOLS].copy().view("<u2"), raw[:, 2 * SYMBOLS :]


def _least(num: int, den: int) -> int:
    """Agreeing symbols of 128 that a pair at the threshold has but for one in 10^7."""
    p = num / den
    return int(SKETCH * p - 5.3 * (SKETCH * p * (1 - p)) ** 0.5)


def _estimated(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        (s1, r1), (s2, r2) = _parts(b.column("sig_a").to_pylist()), _parts(b.column("sig_b").to_pylist())
        est = (s1 == s2).sum(1) + (r1 == r2).sum(1)
        t = pa.table({"a": b.column("a"), "b": b.column("b"), "est": pa.array(est, pa.int32())})
        yield from t.filter(pa.array(est >= least)).to_batches()


def _across(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Near pairs of different components within a block or across two blocks of a key; each pair only under the first key that it shares.

    One row for each two home blocks holds all their pairs, packed.
    """
    for t in C.whole_groups(batches, ["key", "i", "j"], 4000):
        key, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
        node, comp, own, home = (t.column(c).to_numpy() for c in ("node", "comp", "own", "home"))
        sym, rest = _parts(t.column("sig").to_pylist())
        found = []
        at = C.bounds([key, i, j])
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if hi - lo < 2 or (comp[lo:hi] == comp[lo]).all():
                continue
            x = np.arange(lo, hi)
            left, right = (x, x) if i[lo] == j[lo] else (x[own[lo:hi] == i[lo]], x[own[lo:hi] == j[lo]])
            if not len(left) or not len(right):
                continue
            eq = sym[left][:, None, :] == sym[right][None, :, :]
            ok = (eq.sum(2) >= SYMBOLS - ERRORS) & (comp[left][:, None] != comp[right][None, :])
            if i[lo] == j[lo]:
                ok = np.triu(ok, 1)
            p, q = np.nonzero(ok)
            if not len(p):
                continue
            e = eq[p, q]
            early = np.zeros(len(p), bool)
            for u in range(int(key[lo]) & 31):
                early |= e[:, _REST[u]].all(1)
            est = e.sum(1) + (rest[left[p]] == rest[right[q]]).sum(1)
            take = ~early & (est >= least)
            a, b = left[p[take]], right[q[take]]
            swap = home[a] > home[b]
            found.append(np.where(swap, [b, a], [a, b]))
        if not found:
            continue
        a, b = np.concatenate(found, 1)
        order = np.lexsort([home[b], home[a]])
        a, b = a[order], b[order]
        cuts = C.bounds([home[a], home[b]])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(home[a[cuts[:-1]]]), pa.array(home[b[cuts[:-1]]]), pa.array([np.stack([node[a[x:y]], node[b[x:y]]]).tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["ga", "gb", "pairs"])


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of x with every set of y, a slice of the members at a time."""
    out = np.zeros((len(x), len(y)), np.float64)
    member = np.unique(np.concatenate([*x, *y]))
    for lo in range(0, len(member), 4096):
        part = member[lo : lo + 4096]
        m = []
        for sets in (x, y):
            z = np.zeros((len(sets), len(part)), np.float32)
            for r, v in enumerate(sets):
                w = v[np.searchsorted(v, part[0]) : np.searchsorted(v, part[-1], "right")]
                z[r, np.searchsorted(part, w)] = 1
            m.append(z)
        out += m[0] @ m[1].T
    return out


def _settle(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Of the pairs of two home blocks, those confirmed on full sets that connect them: a spanning forest."""
    for t in C.whole_groups(batches, ["ga", "gb"], 400):
        ga, gb = t.column("ga").to_numpy(), t.column("gb").to_numpy()
        node, comp = t.column("node").to_pylist(), t.column("comp").to_pylist()
        text, packed = t.column("text"), t.column("pairs").to_pylist()
        at = C.bounds([ga, gb])
        A, B = [], []
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            both = [np.frombuffer(x, np.int64).reshape(2, -1) for x in packed[lo:hi] if x is not None]
            if not both:
                continue
            a, b = np.concatenate(both, 1)
            used = set(a.tolist()) | set(b.tolist())
            body = dict(zip(node[lo:hi], C.text_bytes(text.slice(lo, hi - lo)), strict=True))
            sets = {n: np.unique(C.shingles(C.word_hashes(body[n])[0], k)) for n in used}
            top = {n: c for n, c in zip(node[lo:hi], comp[lo:hi], strict=True) if n in used}
            xs, p = np.unique(a, return_inverse=True)
            ys, q = np.unique(b, return_inverse=True)
            if len(a) > 8 * (len(xs) + len(ys)):
                same = _shared([sets[n] for n in xs.tolist()], [sets[n] for n in ys.tolist()])[p, q]
            else:
                same = np.array([len(np.intersect1d(sets[m], sets[n], assume_unique=True)) for m, n in zip(a.tolist(), b.tolist(), strict=True)])
            total = np.array([len(sets[n]) for n in xs.tolist()])[p] + np.array([len(sets[n]) for n in ys.tolist()])[q]
            ok = den * same >= num * (total - same)
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while root.get(c, c) != c:
                    c = root[c]
                return c

            for m, n in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
                u, v = find(top[m]), find(top[n])
                if u != v:
                    root[max(u, v)] = min(u, v)
                    A.append(m)
                    B.append(n)
        if A:
            yield pa.RecordBatch.from_arrays([pa.array(A, pa.int64()), pa.array(B, pa.int64())], ["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        last: tuple = (None, None)
        for x, (a_text, b_text) in enumerate(zip(C.text_bytes(b.column("text_a")), C.text_bytes(b.column("text_b")), strict=True)):
            u = last[1] if last[0] == a_text else np.unique(C.shingles(C.word_hashes(a_text)[0], k))
            last = (a_text, u)
            v = np.unique(C.shingles(C.word_hashes(b_text)[0], k))
            same = len(u) + len(v) - len(np.unique(np.concatenate([u, v])))
            ok.append(den * same >= num * (len(u) + len(v) - same))
        yield from pa.table({"a": b.column("a"), "b": b.column("b")}).filter(pa.array(ok, pa.bool_())).to_batches()


def blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (key, node, comp, m nodes of the key) dealt over pairs of blocks of about ``BLOCK`` nodes: adds own, i and j.

    Two nodes of one key and different components meet in exactly one pair (i, j) of blocks; a component with
    ``BLOCK`` nodes or more under a key has blocks of its own there, which don't meet each other.
    """
    zero = F.lit(0).cast("long")
    few = rows.where(F.col("m") <= BLOCK).select("key", "node", "comp", zero.alias("own"), zero.alias("i"), zero.alias("j"))
    many = rows.where(F.col("m") > BLOCK)
    sizes = many.groupBy("key", "comp").agg(F.count("*").alias("n"), F.first("m").alias("m"))
    rest = sizes.where(F.col("n") < BLOCK).groupBy("key").agg(F.sum("n").alias("rest"))
    big = F.col("n") >= BLOCK
    sizes = sizes.join(rest, "key", "left").select("key", "comp", "m", big.alias("big"), F.when(big, F.col("comp")).otherwise(zero).alias("group"), F.ceil(F.when(big, F.col("n")).otherwise(F.col("rest")) / BLOCK).alias("parts"))
    sizes = C.cut(sizes, "key-components")
    block = lambda part: F.xxhash64("big", "group", part)
    every = sizes.select("key", "big", "group", "parts").distinct().withColumn("part", F.explode(F.sequence(zero, F.col("parts") - 1))).select("key", "big", "group", block("part").alias("own"))
    one, two = every.toDF("key", "big", "group", "i"), every.toDF("key", "big_2", "group_2", "j")
    pairs = C.cut(one.join(two, "key").where((F.col("i") <= F.col("j")) & ~(F.col("big") & F.col("big_2") & (F.col("group") == F.col("group_2")))).select("key", "i", "j"), "block-pairs")
    sides = pairs.select("key", F.col("i").alias("own"), "i", "j").union(pairs.where("i <> j").select("key", F.col("j").alias("own"), "i", "j"))
    # a key's rows are salted, and what is known of it is repeated for each salt
    salts = F.ceil(F.col("m") / 100_000)
    told = sizes.withColumn("salt", F.explode(F.sequence(zero, salts - 1))).drop("m")
    own = many.withColumn("salt", F.pmod(F.xxhash64("node"), salts)).join(told, ["key", "comp", "salt"]).select("key", "node", "comp", block(F.pmod(F.xxhash64(F.lit(2), "node"), F.col("parts"))).alias("own"))
    return few.unionByName(own.join(sides, ["key", "own"]).select("key", "node", "comp", "own", "i", "j"))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, text_hash, class_hash, kept.

    Rows are linked when den * |intersection| >= num * |union| of their k-word
    shingle sets; ``component_id`` is the smallest id reachable by links.  Words are
    split at ASCII white space, A-Z in lower case.  A null or empty text has no
    shingles and no links.  Rows that repeat an id or a text are rows of their own,
    linked by their texts.  A null id counts as larger than all others: such a
    row gets the id of its component if some row there has one, else null, and is
    kept only in the latter case.  Rows with the component's id are kept.
    ``class_hash`` names the component, null where there are no shingles.  Other
    columns are not looked at.  An empty table gives an empty result.
    """
    least = _least(num, den)
    C.small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    base = C.cut(docs.mapInArrow(lambda it: _sign(it, k), "doc_id long, th long, n_shingles long, node long, sig binary, keys array<long>, orders array<long>"), "signed")

    # one node for each set; th_ref finds the text of one of its rows
    members = base.select("doc_id", "th", "n_shingles", "node")
    refs = members.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "th")).alias("r"), F.count("*").alias("n"))
    refs = C.cut(refs.select("node", F.col("r.doc_id").alias("ref_id"), F.col("r.th").alias("ref_th"), "n"), "refs")
    signed = base.where("sig is not null").select("node", "sig", "keys", "orders").dropDuplicates(["node"])
    signed = C.cut(signed, "one-each")
    posts = signed.select("node", F.explode(F.arrays_zip("keys", "orders")).alias("z")).select(F.col("z.keys").alias("key"), "node", F.col("z.orders").alias("o"))
    posts = posts.repartitionByRange("key", "o", "node").sortWithinPartitions("key", "o", "node").select("key", "node")
    posts = C.cut(posts.mapInArrow(_chain, "key long, node long, prev long"), "posts")

    sigs = C.cut(signed.select("node", "sig").join(posts.select("node").distinct(), "node", "left_semi"), "sigs")
    C.drop(signed)
    wanted = refs.join(sigs.select("node"), "node", "left_semi")
    texts = docs.alias("d").join(wanted.alias("w"), F.expr("d.doc_id <=> w.ref_id and d.th = w.ref_th")).select("w.node", "d.text").dropDuplicates(["node"])
    texts = C.cut(texts, "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(lambda it: _confirm(it, k, num, den), "a long, b long")

    def across(pairs: DataFrame, label: DataFrame) -> DataFrame:
        """Pairs of different components, with these."""
        one, two = label.toDF("a", "ca"), label.toDF("b", "cb")
        return pairs.join(one, "a", "left").join(two, "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca <> cb")

    def best(pairs: DataFrame, by: list[str]) -> DataFrame:
        return pairs.groupBy(*by).agg(F.max(F.struct("est", "a", "b")).alias("m")).select("m.a", "m.b")

    chain = posts.where("prev is not null").select(F.least("node", "prev").alias("a"), F.greatest("node", "prev").alias("b")).distinct()
    chain = chain.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b")
    chain = C.cut(chain.mapInArrow(lambda it: _estimated(it, least), "a long, b long, est int"), "chain")
    links = C.cut(confirmed(best(chain, ["a"]).union(best(chain, ["b"])).distinct()), "links")
    label = components(links, smallest=False)
    links_2 = C.cut(confirmed(across(chain, label)), "links")
    old = label
    links = C.cut(links.union(links_2).distinct(), "links")
    label = components(links, smallest=False)
    C.drop(old, chain, links_2)

    # keys whose nodes are not in one component yet
    marked = posts.select("key", "node").distinct().join(label.toDF("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    marked = C.cut(marked, "marked")
    sizes = C.cut(marked.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")), "key-sizes")
    mixed = sizes.where("lo <> hi").select("key", F.col("n").alias("m"))
    rows = C.cut(C.looked_up(marked, "key", sizes.select("key", "n"), mixed), "mixed")
    home = rows.groupBy("node").agg(F.max(F.struct("m", "key")).alias("h")).select("node", F.xxhash64("h.key", F.pmod(F.xxhash64(F.lit(1), "node"), F.ceil(F.col("h.m") / BLOCK))).alias("home"))
    home = C.cut(home, "homes")
    dealt = C.cut(blocks(rows), "dealt")
    rows = dealt.join(sigs.join(home, "node"), "node").select("key", "i", "j", "own", "node", "comp", "home", "sig")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    pairs = C.cut(rows.mapInArrow(lambda it: _across(it, least), "ga long, gb long, pairs binary"), "pairs")
    meet = pairs.select("ga", "gb").distinct()
    sides = meet.select("ga", "gb", F.col("ga").alias("home")).union(meet.where("ga <> gb").select("ga", "gb", F.col("gb").alias("home")))
    bodies = home.join(texts, "node").join(label.toDF("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    task = sides.join(bodies, "home").select("ga", "gb", "node", "comp", "text", F.lit(None).cast("binary").alias("pairs"))
    task = task.union(pairs.select("ga", "gb", F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("string"), "pairs"))
    task = task.repartition("ga", "gb").sortWithinPartitions("ga", "gb")
    links_3 = task.mapInArrow(lambda it: _settle(it, k, num, den), "a long, b long")
    final = components(links.union(links_3), smallest=False)
    C.drop(label, marked, posts, sigs, home, sizes, dealt)

    # labels by node first: copies are many rows, but one node
    named = C.cut(refs.join(final, "node", "left").select("node", "ref_id", "n", F.coalesce("comp", "node").alias("comp")), "named")
    low = named.groupBy("comp").agg(F.min("ref_id").alias("component_id"), F.count("*").alias("n"))
    low = C.cut(low, "lowest")
    named = C.cut(C.looked_up(named.select("node", "comp"), "comp", low.select("comp", "n"), low.drop("n")), "named-nodes")
    out = C.looked_up(members.where("node is not null"), "node", refs.select("node", "n"), named)
    out = out.select("doc_id", "n_shingles", "component_id", F.col("th").alias("text_hash"), F.col("comp").alias("class_hash"))
    alone = members.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("th").alias("text_hash"), F.lit(None).cast("long").alias("class_hash"))
    C.drop(texts, links, pairs, final, low)
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each component of ``near_duplicates`` left, with the smallest id; rows without words all stay.

    Of rows that share that id, the one with the smallest hash of its text stays, and of these the one with the
    smallest hash of all its columns; of equal rows one.  A null or empty text stays; of null ids the
    operator's rule holds.  All columns are kept, whatever their names.
    """
    found = near_duplicates(docs, k, num, den, id_col, text_col)
    stay = found.where("kept and class_hash is not null").groupBy("class_hash", "doc_id").agg(F.min("text_hash").alias("stay_hash")).select(F.col("doc_id").alias("stay_id"), "stay_hash")
    words = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.where(words).select(F.col(id_col).cast("long").alias("row_id"), F.xxhash64(text_col).alias("row_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    linked = rows.join(stay, F.col("row_id").eqNullSafe(F.col("stay_id")) & (F.col("row_hash") == F.col("stay_hash")))
    return linked.groupBy("row_id", "row_hash").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*").union(docs.where(~words))
