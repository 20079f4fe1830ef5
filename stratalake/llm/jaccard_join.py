"""Operator 3: near-duplicate documents by Jaccard similarity of word shingles, filtered under several global orders.

Two sets whose similarity is at least t share at least a = ceil(t * n) tokens (n: the size of either), so under ANY
global order their first n - a + l tokens share at least l.

1. Hash order, corpus-frequent tokens last. Every document sends its first n - a + l tokens (l a tenth of n). A token of one
   document falls away; a document left with fewer than l shared tokens links with nothing.
2. Frequency order, rarest first, over what is left: of m shared prefix tokens a partner shares at least l, hence one
   of the first m - l + 1. Only these tokens tie documents to one another.
3. Candidates are pairs of tied documents that share prefix tokens under the first order and under each of two more hash
   orders: the filters of all orders are intersected, where the documents meet, before exact intersections are counted.

Documents that are tied together, directly or not, form a cluster. A cluster of more than a block is cut into length bands
as wide as the similarity, so that only neighbouring bands meet, and bands into blocks; each pair of blocks is verified in
one task, which returns the links of a spanning forest and never the pairs. Exact copies (of the word sequence) are one
class throughout. Classes are told apart by two 64-bit hashes of the word sequence (where documents are merely gathered as candidates,
by the first) and shingles by 64-bit hashes of their words.

Documents of a token are counted in one window, but for tokens of more than ``HEAVY`` documents: their rows are dealt by
document, counted apart and given the counts back by broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Words, bit_field, bounded_batches, chained, components, discard, in_field, mix, pieces, row_key, scratch, table

#: Tokens in so many documents, as seen by the tasks, are ordered last.
FREQUENT = 64
#: Documents (as seen by the tasks) beyond which a token's rows are not gathered in one task.
HEAVY = 20_000
#: Documents of a block; two blocks meet in a task.
BLOCK = 384
_FLUSH = 1 << 21


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    grams, out = chained(w.hash, k, 3), []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(mix(chained(w.hash[a:b], b - a, 5), b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sequence_keys(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys per document, from its whole sequence of words."""
    n = w.counts()
    at = np.arange(len(w.hash), dtype=np.uint64) - np.repeat(w.first[:-1], n).astype(np.uint64)

    def keys(salt: int) -> np.ndarray:
        total = np.zeros(len(w.hash) + 1, np.uint64)
        np.cumsum(mix(w.hash + at * np.uint64(0x9E3779B97F4A7C15), salt), out=total[1:])
        return mix((total[w.first[1:]] - total[w.first[:-1]]) ^ n.astype(np.uint64), salt + 4).view(np.int64)

    return keys(9), keys(33)


def order_key(s: np.ndarray, salt: int, frequent: np.ndarray) -> np.ndarray:
    """Place of each token in global order number salt: those in the field of frequent tokens come after all others."""
    return (mix(s, salt) >> np.uint64(1)) | (in_field(frequent, s).astype(np.uint64) << np.uint64(63))


def first_of(s: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    return s if n >= len(s) else s[np.argpartition(key, n)[:n]]


def _need(n: int, num: int, den: int) -> int:
    return -(-num * n // den)


def _slack(n: int) -> int:
    return -(-n // 10)


def _frequent_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            t, c = np.unique(np.concatenate(held), return_counts=True)
            m = c > 1
            return table(token=t[m].view(np.int64), n=c[m])

        for rb in pieces(batches):
            held += (s := shingle_sets(Words(rb.column("text"), lower=True), k))
            size += sum(map(len, s))
            if size >= _FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _class_rows(k: int):
    def run(batches):
        for rb in pieces(batches):
            w = Words(rb.column("text"), lower=True)
            n = [len(s) for s in shingle_sets(w, k)]
            key, key2 = sequence_keys(w)
            yield table(**{c: rb.column(c) for c in rb.schema.names if c != "text"}, key=key, key2=key2, n=pa.array(n, pa.int64()))

    return run


def _prefix_rows(k: int, num: int, den: int, frequent):
    def run(batches):
        held: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        size = 0

        def flush():
            ks = np.array([k for k, _ in held], np.int64)
            lens = [len(t) for _, t in held.values()]
            return table(
                token=np.concatenate([t for _, t in held.values()]).view(np.int64),
                key=np.repeat(ks, lens),
                n=np.repeat(np.array([n for n, _ in held.values()], np.int32), lens),
            )

        for rb in pieces(batches):
            w = Words(rb.column("text"), lower=True)
            both = (x.tolist() for x in sequence_keys(w))
            for *key, s in zip(*both, shingle_sets(w, k), strict=True):
                key = tuple(key)
                if len(s) and key not in held:
                    n = len(s)
                    t = first_of(s, order_key(s, 1, frequent.value), n - _need(n, num, den) + _slack(n))
                    held[key] = n, t
                    size += len(t)
            if size >= _FLUSH // 8:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    return run


def _set_rows(k: int):
    def run(batches):
        done = set()
        for rb in pieces(batches):
            w = Words(rb.column("text"), lower=True)
            key = list(zip(rb.column("key").to_pylist(), rb.column("key2").to_pylist(), strict=True))
            same = list(zip(*(x.tolist() for x in sequence_keys(w)), strict=True))  # a repeated doc_id may have other texts
            use = [a == b and a not in done and not done.add(a) for a, b in zip(same, key, strict=True)]
            sets = pa.array([s.tobytes() for s in shingle_sets(w, k)], pa.binary())
            yield table(**{c: rb.column(c) for c in rb.schema.names if c not in ("d", "text")}, tokens=sets).filter(pa.array(use, pa.bool_()))

    return run


def _incidence(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Row, column of each token that two rows share at least; the number of columns."""
    r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    _, c, n = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    m = n[c] > 1
    return r[m], (np.cumsum(n > 1) - 1)[c[m]], int((n > 1).sum())


def _shared(rows: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes, summed over slices of the columns."""
    r, c, n = _incidence(rows)
    out, order = np.zeros((len(rows), len(rows)), np.float32), np.argsort(c, kind="stable")
    r, c = r[order], c[order]
    step = max(256, (1 << 22) // len(rows))
    for a in range(0, n, step):
        i, j = np.searchsorted(c, [a, a + step])
        x = np.zeros((len(rows), min(step, n - a)), np.float32)
        x[r[i:j], c[i:j] - a] = 1
        out += x @ x.T
    return out


def _links(sides: list[int], sets: list[np.ndarray], inside: bool, num: int, den: int, frequent: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest among verified pairs: those of a block, or else those between the two sides."""
    if len(sets) == 2 and (inside or sides[0] != sides[1]):
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if den * shared >= num * (len(sets[0]) + len(sets[1]) - shared) else []
    n = np.array([len(s) for s in sets])
    side = np.array(sides)
    ok = (num * np.maximum.outer(n, n) <= den * np.minimum.outer(n, n)) & np.tri(len(n), k=-1, dtype=bool)
    if not inside:  # pairs of one block are compared where it meets itself
        ok &= side[:, None] != side[None, :]
    for salt in (1, 21, 22):
        if not ok.any():
            return []
        ok &= _shared([first_of(s, order_key(s, salt, frequent), len(s) - _need(len(s), num, den) + 1) for s in sets]) > 0
    if not ok.any():
        return []
    inter = _shared(sets)
    ok &= den * inter >= num * (np.add.outer(n, n) - inter)
    parent = list(range(len(n)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in np.argwhere(ok).tolist():
        if (x := root(a)) != (y := root(b)):
            parent[x] = y
            out.append((a, b))
    return out


MEET = ("cluster", "b", "c", "i", "j")


def _verify(num: int, den: int, frequent):
    """Links (node of either end) of the blocks that meet."""

    def run(batches):
        now, nodes, sides, sets, keys = None, [], [], [], set()

        def close():
            if len(sets) < 2:
                return None
            found = _links(sides, sets, now[1] == now[2] and now[3] == now[4], num, den, frequent.value)
            ends = {x: [nodes[p[i]] for p in found] for i, x in enumerate("ab")}
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            return table(**{f"{x}_{c}": pa.array([v[j] for v in ends[x]], t) for x in "ab" for j, (c, t) in enumerate(zip(NODE, kinds, strict=True))}) if found else None

        for rb in batches:
            for *at, z, low, key, key2, side, tokens in zip(*(rb.column(x).to_pylist() for x in (*MEET, *NODE, "side", "tokens")), strict=True):
                if at != now:
                    if (out := close()) is not None:
                        yield out
                    now, nodes, sides, sets, keys = at, [], [], [], set()
                if (key, key2) not in keys:
                    keys.add((key, key2))
                    nodes.append((z, low, key, key2))
                    sides.append(side)
                    sets.append(np.frombuffer(tokens, np.uint64))
        if (out := close()) is not None:
            yield out

    return run


def frequent_tokens(docs: DataFrame, k: int) -> DataFrame:
    """token, n: tokens that many documents hold, with the documents that the tasks have seen more of them in."""
    t = docs.select("text").mapInArrow(_frequent_rows(k), "token long, n long")
    return t.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)


def _shared_tokens(prefix: DataFrame, frequent: DataFrame) -> DataFrame:
    """token, key, n, df: the rows of prefix (token, key, n) once each, with the documents of their token, if more than one."""
    alike = ["token", "key", "n"]
    heavy = frequent.where(F.col("n") >= HEAVY).select("token")
    some = heavy.count()
    apart = None
    if some:
        heavy = F.broadcast(heavy) if some <= 100_000 else heavy
        apart = scratch(prefix.join(heavy, "token", "left_semi").dropDuplicates(alike), "heavy")  # dealt by token and document
        counts = apart.groupBy("token").agg(F.count("*").alias("df"))
        apart = apart.join(F.broadcast(counts) if some <= 100_000 else counts, "token").select(*alike, "df")
        prefix = prefix.join(heavy, "token", "left_anti")
    prefix = prefix.repartition("token").dropDuplicates(alike)
    out = prefix.withColumn("df", F.count("*").over(Window.partitionBy("token"))).select(*alike, "df")
    return (out if apart is None else out.unionByName(apart)).where("df > 1")


#: A class as node of the graph of links: the order of nodes is that of their smallest doc_id, null last.
NODE = ("z", "low", "key", "key2")


def _dealt(sets: DataFrame, num: int, den: int) -> DataFrame:
    """sets (cluster, total, bands, band, ...) once for each pair of blocks in which they meet others."""
    own, above, below = (F.coalesce(F.try_element_at("bands", F.col("band") + x), F.lit(0)) for x in (0, 1, -1))
    sets = sets.withColumns({"own": own, "above": above, "below": below, "sub": F.pmod(F.xxhash64("key"), own).cast("int")})

    def cells(n: str, b: int, c: int, of) -> Column:
        at = lambda o: F.struct((F.col("band") + b).alias("b"), (F.col("band") + c).alias("c"), *of(o))
        return F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), at)).otherwise(F.array())

    sub, one = F.col("sub"), F.lit(1)
    many = F.concat(
        cells("own", 0, 0, lambda o: (F.least(sub, o).alias("i"), F.greatest(sub, o).alias("j"), (sub > o).cast("int").alias("side"))),
        cells("above", 0, 1, lambda o: (sub.alias("i"), o.alias("j"), F.lit(0).alias("side"))),
        cells("below", -1, 0, lambda o: (o.alias("i"), sub.alias("j"), one.alias("side"))),
    )
    single = F.array(F.struct(*[F.lit(0).alias(x) for x in ("b", "c", "i", "j", "side")]))
    return sets.withColumn("cell", F.explode(F.when(F.col("total") > BLOCK, many).otherwise(single))).select("cluster", "cell.*", *NODE, "tokens")


def grouped(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n, group, component_id and the columns named in also, for each row of docs (doc_id, text).

    group is the class of linked word sequences (a node, see NODE), null without words.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *also)
    docs = docs.withColumn("d", F.coalesce("doc_id", F.xxhash64("text")))
    often = scratch(frequent_tokens(docs, k), "frequent")
    frequent = spark.sparkContext.broadcast(bit_field(often, "token"))
    kept = docs.select("doc_id", "d", "text", *also)
    fields = ", ".join(f"{c} {t}" for c, t in kept.drop("text").dtypes)
    classes = scratch(kept.mapInArrow(_class_rows(k), fields + ", key long, key2 long, n long"), "classes")

    prefix = docs.select("text").mapInArrow(_prefix_rows(k, num, den, frequent), "token long, key long, n int")
    shared = _shared_tokens(prefix, often)
    slack = F.ceil(F.col("n") / 10)
    per_class = shared.groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    per_class = per_class.where(F.size("t") >= slack)
    rare = per_class.select("key", F.explode(F.slice("t", F.lit(1), F.size("t") - slack.cast("int") + 1)).alias("t"))
    rare = scratch(rare.select("key", F.col("t.token").alias("token")), "rare")
    lead = rare.groupBy("token").agg(F.min("key").alias("lead"))
    ties = rare.join(lead, "token").where("lead < key").select(F.col("lead").alias("a"), F.col("key").alias("b"))
    cluster = components(ties).select(F.col("node").alias("key"), F.col("root").alias("cluster"))

    # a class is met through the row of its smallest doc_id
    least = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("low"), "d")).alias("r")
    reps = classes.where("n > 0").groupBy("key", "key2").agg(least, F.first("n").alias("n")).select("key", "key2", "r.z", "r.low", "r.d", "n")
    # a little wider than the similarity, so that rounding cannot part a pair by two bands
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(den / num) * 1.0001)).cast("int")
    reps = scratch(reps.join(cluster, "key").withColumn("band", band), "reps")
    blocks = reps.groupBy("cluster", "band").agg(F.count("*").alias("n"))
    blocks = blocks.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).groupBy("cluster").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("bands"))
    texts = docs.select("d", "text").join(reps.drop("n").join(blocks, "cluster"), "d")
    fields = "cluster long, total long, bands map<int, int>, band int, z boolean, low long, key long, key2 long"
    names = [x.split()[0] for x in fields.replace("map<int, int>", "m").split(", ")]
    sets = texts.select("d", *names, "text").mapInArrow(_set_rows(k), fields + ", tokens binary")
    dealt = _dealt(sets, num, den).repartition(*MEET).sortWithinPartitions(*MEET)
    links = dealt.mapInArrow(_verify(num, den, frequent), ", ".join(f"{x}_{c} {t}" for x in "ab" for c, t in zip(NODE, ("boolean", "long", "long", "long"), strict=True)))
    ends = [F.struct(*[F.col(f"{x}_{c}").alias(c) for c in NODE]).alias(x) for x in "ab"]
    group = components(links.select(*ends)).select("node.key", "node.key2", F.col("root").alias("group"))
    lows = classes.where("n > 0").groupBy("key", "key2").agg(least).select("key", "key2", F.struct("r.z", "r.low", "key", "key2").alias("own"))
    of = scratch(lows.join(group, ["key", "key2"], "left").select("key", "key2", F.coalesce("group", "own").alias("group")), "groups")
    out = classes.withColumn("key", F.when(F.col("n") > 0, F.col("key"))).drop("d").join(of, ["key", "key2"], "left")
    discard(rare, often)
    low = F.when(F.col("n") > 0, F.col("group.low")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n", "group", low.alias("component_id"), *also)


def jaccard_classes(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text); other columns are ignored.

    Words are runs of other characters than ASCII white space, A-Z lower-cased; a set holds the distinct k-word shingles,
    or the whole sequence where there are fewer words. Null and wordless texts: n_shingles 0, linked with nothing, their
    own component. Rows with a null doc_id are linked like others; component_id is null where no row of the group has an id.
    Rows of one doc_id and several texts belong to the group of their own text. Repeated rows come back as often as they
    came, with one answer. An empty table gives an empty result. Two documents link when
    den * |intersection| >= num * |union|; component_id is the smallest doc_id reachable. A text is worked on whole in one
    task, at some 60 bytes of memory for each of its bytes.
    """
    return grouped(docs, k, num, den).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row of docs (doc_id, text, other columns) for each group of linked rows: that of the smallest doc_id, null last,
    and of several such rows the one of smallest hash. Rows without words all stay."""
    names = docs.columns
    keyed = row_key(docs, *names)
    g = grouped(keyed, k, num, den, also=("_a", "_b"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_a", "_b")).alias("first")
    one = g.where("n > 0").groupBy("group").agg(first).select("first._a", "first._b")
    bare = g.where("n = 0").select("_a", "_b").distinct()
    one = keyed.join(one, ["_a", "_b"], "left_semi").dropDuplicates(["_a", "_b"])  # equal rows hash alike
    return one.unionByName(keyed.join(bare, ["_a", "_b"], "left_semi")).select(*names)
