"""Operator 8: language-model scoring by a probabilistic suffix tree over words.

Symbols are all words and the end of a text. A context is the last one to ``DEPTH`` words; every context of ``LEAST``
occurrences or more is tested against its longest retained suffix, and is retained if its next-symbol counts diverge from
what that suffix predicts. Symbols without an edge of their own (seen less than ``PAIR`` times after the context, or hardly
likelier than the suffix says) count as one in the test, and keep the suffix's distribution over what is left of the
probability; a context's edges are its counts smoothed by ``PRIOR``. The root discounts word counts absolutely, all unseen
words together having the discounted mass. A text is scored along the longest retained suffix at each place.

Nothing is bounded in number. Given a context, the logarithm of a symbol's probability is the root's, plus one term for
every retained context along the suffixes, plus one for every edge of these, so nodes and edges are one written table of
terms by hash. The most frequent words and terms are sent to the tasks (fixed numbers, only for speed); all others meet the
texts in buckets by hash: groups of texts send packs of what they ask for, and a bucket answers each pack with one pack of sums per
text. Bit fields of fixed size tell which grams are frequent and which terms exist, so that only what may be asked for is sent. The texts are read once for the words, once for contexts of one word, once for those of
two, and once for all longer ones, whose candidates are made up of frequent grams of three words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FIELD_BITS, FIELD_LEAST, FIELD_MOST, Words, bounded_batches, discard, mix, parted, pieces, release, scratch, table, topmost, xxhash

#: Words and terms that tasks know by heart, keys that joins broadcast: for speed alone, the others are met by shuffles.
TOP, TOP_TERMS, TOP_KEYS = 200_000, 1_000_000, 20_000
#: The symbol of a text's end; frequent words are their ranks, other words their hashes.
END = 1 << 61
#: Least occurrences of a context and of an edge; divergence a context needs (nats per occurrence) and gain an edge needs
#: (nats); weight of the suffix; words in the longest context.
LEAST, PAIR, DIVERGENCE, GAIN, PRIOR, DEPTH = 20, 3, 0.02, 3.0, 10.0, 5
#: Tells contexts' terms from those of edges.
_NODE = 0x510E527FADE682D1
_FLUSH = 1 << 19
#: Bits of a frequent word's rank in a code, which is a gram's words side by side; entries that a task gathers before it packs them;
#: training tokens and look-ups of texts that a bucket has by and large.
_RANK, _PAIRS, _BUCKET = 21, 1 << 20, 1 << 21
_LOW = np.uint64((1 << _RANK) - 1)
#: Bytes of text that a task works on at once; words of a field in a pack.
_PIECE, _PACK = 1 << 19, 1 << 17


def held_out(doc_id: Column, mod: int = 7, rest: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def _summed(parts):
    """Rows (key, ..., n) of equal keys as one row, the counts added; the other columns follow from the key."""
    key, *columns, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(n):
        return key, *columns, n
    order = np.argsort(key)
    key, n = key[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[new], *(c[order[new]] for c in columns), np.add.reduceat(n, new)


def _counted(of, names: list[str]):
    """Rows (names, n): counts of the tuples of 64-bit values that of(piece) gives, the first of which tells them apart, merged
    within the task up to a bound. names: of the last columns."""

    def out(parts):
        return table(**{c: v.view(np.int64) for c, v in zip([*names, "n"], parts[-1 - len(names) :], strict=True)})

    def run(batches):
        held, size = [], 0
        for rb in pieces(batches, most=_PIECE):
            values = of(rb)
            held.append((*values, np.ones(len(values[0]), np.int64)))
            size += len(held[-1][-1])
            if size >= _FLUSH:
                held = [_summed(held)]
                size = len(held[0][-1])
                if size >= _FLUSH // 2:
                    yield out(held[0])
                    held, size = [], 0
        if held:
            yield out(_summed(held))

    return run


def _field_packs(batches):
    """A task's words of a field, (i, b), as few packs of places and words: the driver holds all of a field at once."""
    held, size = [], 0

    def pack():
        i, b = (np.concatenate(x).view(np.uint64) for x in zip(*held, strict=True))
        order = np.argsort(i)
        return table(parts=pa.array([[_packed(i[order]), _squeezed(b[order], np.uint64)]], pa.list_(pa.binary())))

    for rb in batches:
        held.append((rb.column("i").to_numpy(), rb.column("b").to_numpy()))
        size += rb.num_rows
        if size >= _PACK:
            yield pack()
            held, size = [], 0
    if size:
        yield pack()


def bit_field(keys: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of the (well mixed) keys: four bits in one of its 64-bit words, so a key is one row of the shuffle and one
    place to look at. Its size follows the number of keys up to 32 MB."""
    x = keys.select(F.col(column).alias("x"))
    size = min(FIELD_MOST, max(FIELD_LEAST, (FIELD_BITS * x.count()).bit_length()))
    bits = " | ".join(f"shiftleft(1L, cast(shiftright(x, {6 * j}) & 63 as int))" for j in range(4))
    found = x.groupBy(F.expr(f"shiftrightunsigned(x, {70 - size})").alias("i")).agg(F.expr(f"bit_or({bits})").alias("b"))
    out = np.zeros(1 << (size - 6), np.uint64)
    for pack in found.mapInArrow(_field_packs, "parts array<binary>").toArrow().column("parts"):
        i, b = pack.as_py()
        out[_unpacked(i)] = _array(b, np.uint64)
    return out


def in_field(field: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of the keys may be in the field."""
    low, one, bits = np.uint64(63), np.uint64(1), np.zeros(len(x), np.uint64)
    for j in range(4):
        bits |= one << ((x >> np.uint64(6 * j)) & low)
    return ~field[x >> np.uint64(65 - len(field).bit_length())] & bits == 0


def _array(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True), kind)


def _squeezed(x: np.ndarray, kind) -> bytes:
    b = np.ascontiguousarray(x, kind).tobytes()
    return len(b).to_bytes(8, "little") + pa.compress(b, "zstd", asbytes=True)


def _packed(x: np.ndarray) -> bytes:
    """Ascending 64-bit values as the bytes of their steps, those of each place together: they compress well."""
    return _squeezed(np.diff(x, prepend=np.uint64(0)).astype(np.uint64).view(np.uint8).reshape(-1, 8).T, np.uint8)


def _unpacked(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(_array(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values begin, and their lengths."""
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))
    return new, np.diff(np.append(new, len(x)))


def _by_bucket(b: np.ndarray, buckets: int) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """A stable order by bucket, and the part of it that each bucket has."""
    b = b.astype(np.min_scalar_type(buckets))
    order = np.argsort(b, kind="stable")
    b = b[order]
    new, n = _runs(b)
    return order, {i: (start, start + m) for i, start, m in zip(b[new].tolist(), new.tolist(), n.tolist(), strict=True)}


def _word_values(rb):
    return (Words(rb.column("text"), lower=True).hash,)


def walk(v: np.ndarray, begin: np.ndarray, depth: int, frequent: dict[int, np.ndarray]):
    """For k = 1, 2, ..., depth: k, the places whose last k words may be a frequent context, the keys of that context and of
    the context without its oldest word together with the symbol, and the key of context and symbol.

    frequent[k]: field of the frequent grams of k words; beyond the last one, a gram may be frequent if its parts may be.
    """
    since = np.arange(len(v)) - np.repeat(begin, np.diff(np.append(begin, len(v))))
    at = np.flatnonzero(since >= 1)
    at = at[in_field(frequent[1], xxhash(v[at - 1], v[at - 1]))] if 1 in frequent else at[:0]
    key = v  # of the k symbols that end at each place
    for k in range(1, depth + 1):
        if not len(at):
            return
        ctx, par = key[at - 1], key[at]
        both = xxhash(ctx, par)
        yield k, at, ctx, par, both
        key, alive = np.zeros(len(v), np.uint64), np.zeros(len(v), bool)
        key[at], alive[at] = both, True
        at = at[alive[at - 1]]
        if k + 1 in frequent:
            at = at[in_field(frequent[k + 1], key[at - 1])]


def _met(rows: DataFrame, other: DataFrame, key: str, top: Column, weight: str, how: str = "inner") -> DataFrame:
    """rows joined with other by key, the keys of largest weight (top) by broadcast: no task has all rows of a hot key."""
    hot, rest = other.where(top).drop(weight), other.where(~top).drop(weight)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cold.join(rest, key, how))


class Index:
    """Sorted, well mixed 64-bit keys, and where those of each leading bits begin: a look-up reads a few neighbours."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, len(keys).bit_length())
        self.keys, self.shift = np.append(keys, np.uint64(2**64 - 1)), np.uint64(64 - bits)
        self.start = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each of x would lie, at most the last place, and whether it is there."""
        i = self.start[x >> self.shift]
        less = np.flatnonzero(self.keys[i] < x)
        while len(less):
            i[less] += 1
            less = less[self.keys[i[less]] < x[less]]
        i = np.minimum(i, max(0, len(self.keys) - 2))
        return i, (self.keys[i] == x) & (len(self.keys) > 1)


class Tree:
    """What the tasks hold: frequent words, the heaviest terms, and fields of the frequent grams, nodes and edges."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, totals: dict, depth: int):
        rank = np.lexsort((words, -counts))
        order = np.argsort(words)
        self.words, self.counts, self.totals, self.depth = words[order], counts[order], totals, depth
        self.rank = np.argsort(rank)[order].astype(np.uint64)
        self.index, self.keys, self.terms = Index(self.words), Index(np.zeros(0, np.uint64)), np.zeros(0)
        self.frequent: dict[int, np.ndarray] = {}
        self.nodes = self.edges = np.zeros(1 << 10, np.uint64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index among the frequent words and whether it is one."""
        return self.index.find(h)

    def symbols(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts, each with its end; where each text begins; index and known of the words."""
        i, known = self.find(w.hash)
        v = np.full(len(w.hash) + len(w.first) - 1, END, np.uint64)
        v[np.arange(len(w.hash)) + w.doc()] = np.where(known, self.rank[i], w.hash) if len(self.rank) else w.hash
        return v, w.first[:-1] + np.arange(len(w.first) - 1), i, known

    def root(self, counts):
        """The root's probability of a symbol that was seen so often."""
        return np.maximum(counts - self.totals["discount"], 0.05) / (self.totals["tokens"] + 0.5)

    def end(self) -> float:
        return self.root(self.totals["docs"]) if self.totals["docs"] else self.totals["unseen"]

    def along(self, v: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sum of the terms held at each place; the places and keys of those that may be in the table only, and the places and
        codes of such edges that have a code."""
        total, places, keys = np.zeros(len(v)), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        coded = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for k, at, ctx, par, both in walk(v, begin, self.depth, self.frequent):
            node = xxhash(ctx, np.full(len(ctx), _NODE, np.uint64))
            m = np.flatnonzero(in_field(self.nodes, node))  # only a retained context has edges
            edge = m[in_field(self.edges, both[m])]
            for x, of, may in ((node, m, False), (both, edge, k == 1)):
                x, where = x[of], at[of]
                if len(self.terms):
                    i, own = self.keys.find(x)
                    total[where[own]] += self.terms[i[own]]
                    x, where, of = x[~own], where[~own], of[~own]
                if may:
                    code, small = _code((ctx[of], par[of]))
                    coded = where[small], code[small]
                    x, where = x[~small], where[~small]
                places.append(where)
                keys.append(x)
        return total, np.concatenate(places), np.concatenate(keys), *coded


def _code(words) -> tuple[np.ndarray, np.ndarray]:
    """The words of each gram side by side in one number, and which grams have frequent words only: others have no code."""
    code, own = np.zeros(len(words[0]), np.uint64), np.ones(len(words[0]), bool)
    for w in words:
        code = code << np.uint64(_RANK) | w
        own &= w <= _LOW
    return code, own


def _decoded(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a context of k words (at most two) and of the context without its oldest word together with the symbol."""
    w = [code >> np.uint64(_RANK * j) & _LOW for j in range(k, -1, -1)]
    return (w[0], w[1]) if k == 1 else (xxhash(w[0], w[1]), xxhash(w[1], w[2]))


#: A pack of grams for bucket b, contexts of k words: codes and counts, or (coded: false) keys of context and rest, and counts.
_GRAMS = "b long, k long, coded boolean, parts array<binary>"


def _gram_packs(held, first: int, last: int, buckets: int):
    """Per bucket the grams of first to last words and a symbol, as often as the task has them."""

    def of(rb):
        """k, codes; and k, ctx, par of grams without a code."""
        t, field = held.value
        v, begin, *_ = t.symbols(Words(rb.column("text"), lower=True))
        may = None
        for k, at, ctx, par, _ in walk(v, begin, last, t.frequent):
            if k == first:
                may = np.zeros(len(v), bool)
                may[at] = in_field(field, xxhash(par, par) if k == 1 else par)
            if k >= first:
                m = may[at]
                at, ctx, par = at[m], ctx[m], par[m]
                code, own = _code([v[at - j] for j in range(k, -1, -1)]) if k <= 2 else (at[:0], np.zeros(len(at), bool))
                yield k, code[own] if k <= 2 else np.zeros(0, np.uint64), ctx[~own], par[~own]

    def packs(parts):
        to, ks, coded, out = [], [], [], []

        def add(b, k, arrays, pack):
            order, ends = _by_bucket(b, buckets)
            arrays = [x[order] for x in arrays]
            for i, (start, end) in ends.items():
                to.append(i)
                ks.append(k)
                coded.append(len(arrays) == 2)
                out.append(pack(*(x[start:end] for x in arrays)))

        for k in sorted({p[0] for p in parts}):
            code, ctx, par = (np.concatenate([p[j] for p in parts if p[0] == k]) for j in (1, 2, 3))
            code.sort()
            new, n = _runs(code)
            add(mix(code[new], 23) % np.uint64(buckets), k, (code[new], n), lambda c, n: [_packed(c), _squeezed(n, np.int32)])
            both = xxhash(ctx, par)
            order = np.argsort(both)
            new, n = _runs(both[order])
            at = order[new]
            order = np.argsort(ctx[at])
            at, n = at[order], n[order]
            add(
                (both[at] >> np.uint64(20)) % np.uint64(buckets), k, (ctx[at], par[at], n),
                lambda c, p, n: [_packed(c), _squeezed(p, np.uint64), _squeezed(n, np.int32)],
            )
        return table(b=pa.array(to, pa.int64()), k=pa.array(ks, pa.int64()), coded=pa.array(coded, pa.bool_()), parts=pa.array(out, pa.list_(pa.binary())))

    def run(batches):
        parts, size = [], 0
        for rb in pieces(batches, most=_PIECE):
            for p in of(rb):
                parts.append(p)
                size += len(p[1]) + len(p[2])
            if size >= _PAIRS:
                yield packs(parts)
                parts, size = [], 0
        if parts:
            yield packs(parts)

    return run


def _gram_counts(least: int):
    """k, ctx, par, n of a bucket's grams that occur so often."""

    def run(packs: pa.Table) -> pa.Table:
        kinds = list(zip(packs.column("k").to_pylist(), packs.column("coded").to_pylist(), strict=True))
        out = []
        for kind in sorted(set(kinds)):
            k, coded = kind
            parts = [p.as_py() for p, x in zip(packs.column("parts"), kinds, strict=True) if x == kind]
            n = np.concatenate([_array(p[-1], np.int32) for p in parts])
            key = ctx = np.concatenate([_unpacked(p[0]) for p in parts])
            if not coded:
                par = np.concatenate([_array(p[1], np.uint64) for p in parts])
                key = xxhash(ctx, par)
            del parts
            order = np.argsort(key)
            new, _ = _runs(key[order])
            n = np.add.reduceat(n[order].astype(np.int64), new)
            often = n >= least
            at, n = order[new[often]], n[often]
            ctx, par = _decoded(key[at], k) if coded else (ctx[at], par[at])
            out.append((np.full(len(n), k), ctx.view(np.int64), par.view(np.int64), n))
        return pa.table(dict(zip(("k", "ctx", "par", "n"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    return run


def _pairs(train: DataFrame, tree: Tree, first: int, last: int, likely: np.ndarray) -> DataFrame:
    """k, ctx, par, n: counts of the symbols after frequent contexts of first to last words. likely: field of the grams of
    first words (and, by their spread keys, of the words) that occur PAIR times; others cannot be edges."""
    held = train.sparkSession.sparkContext.broadcast((tree, likely))
    packs = train.mapInArrow(_gram_packs(held, first, last, 1 + tree.totals["tokens"] // _BUCKET), _GRAMS)
    out = scratch(packs.groupBy("b").applyInArrow(_gram_counts(PAIR), "k long, ctx long, par long, n long"), "grams")
    held.destroy()
    return out


def _level(pairs: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(e, n, p) of the symbols e after the contexts of pairs (ctx, par, n), the terms (x, d, n, node) of the contexts that
    pass the test and of their edges, and the scratch table of the contexts. before: (e, n, p) one level up."""
    parents = before.select(F.col("e").alias("par"), F.col("p").alias("pp"), F.col("n").alias("w"))
    full = scratch(_met(pairs, parents, "par", topmost(parents, "w", TOP_KEYS), "w"), "predicted")
    sums = full.groupBy("ctx").agg(
        F.sum("n").alias("own"), F.sum("pp").alias("over"), F.count("*").alias("kinds"), F.sum(F.col("n") * (F.log("n") - F.log("pp"))).alias("g")
    )
    of = before.where(F.col("n") >= LEAST).select(F.col("e").alias("ctx"), F.col("n").alias("of"))
    rest = F.col("of") - F.col("own")
    gain = F.col("g") - F.col("of") * F.log("of") + F.when(rest > 0, rest * (F.log(rest) - F.log(F.greatest(1 - F.col("over"), F.lit(1e-12))))).otherwise(0.0)
    s = sums.join(of, "ctx").withColumn("gain", gain)
    passed = (F.col("gain") >= DIVERGENCE * F.col("of")) & (2 * F.col("gain") > F.col("kinds") + 4 * F.sqrt(2 * F.col("kinds")))
    nodes = scratch(s.where(passed).select("ctx", "of", F.col("of").alias("w")), "nodes")
    edge = F.col("n") * (F.log(F.col("n") / F.col("of")) - F.log("pp")) > GAIN
    share = F.col("n") / (F.col("of") + PRIOR)
    top = topmost(nodes, "w", TOP_KEYS)
    held = _met(full, nodes, "ctx", top, "w").where(edge).groupBy("ctx").agg(F.sum(share).alias("held"))
    left = nodes.join(held, "ctx", "left").select("ctx", "of", "w", (1 - F.coalesce("held", F.lit(0.0))).alias("rest"))
    left = scratch(left, "rest")
    by_suffix = F.coalesce("rest", F.lit(1.0)) * F.col("pp")
    own = F.when(edge, share)
    out = _met(full, left, "ctx", top, "w", "left").select(
        F.xxhash64("ctx", "par").alias("e"), "n", (F.coalesce(own, F.lit(0.0)) + by_suffix).alias("p"), F.log10((own + by_suffix) / by_suffix).alias("d")
    )
    out = scratch(out, "level")
    discard(full, nodes)
    terms = left.select(F.xxhash64("ctx", F.lit(_NODE)).alias("x"), F.log10("rest").alias("d"), F.col("of").alias("n"))
    terms = terms.withColumn("node", F.lit(True))
    edges = out.where("d is not null").select(F.col("e").alias("x"), "d", "n", F.lit(False).alias("node"))
    return out, terms.unionByName(edges), left


def trained(train: DataFrame) -> tuple[Tree, DataFrame, list[DataFrame]]:
    """The tree's part for the tasks, the table of the other training words and terms (x, c, d: one of both null), and the
    scratch tables that it reads, from the texts of train (text)."""
    vocab = train.mapInArrow(_counted(_word_values, ["x"]), "x long, n long").groupBy("x").agg(F.sum("n").alias("n"))
    vocab = scratch(vocab, "vocab")
    row = vocab.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.count("*").alias("types"),
        F.count(F.when(F.col("n") == 1, 1)).alias("ones"), F.count(F.when(F.col("n") == 2, 1)).alias("twos"),
    ).first()
    docs = train.count()
    tokens, types = int(row["words"]) + docs, int(row["types"]) + (docs > 0)
    discount = min(max(row["ones"] / max(1, row["ones"] + 2 * row["twos"]), 0.05), 0.95)
    totals = {"tokens": tokens, "types": types, "docs": docs, "discount": discount, "unseen": (discount * types + 0.5) / (tokens + 0.5)}
    top, others = parted(vocab, "n", TOP)
    top = top.toArrow()
    tree = Tree(top.column("x").to_numpy().view(np.uint64), top.column("n").to_numpy(), totals, DEPTH)

    spark = train.sparkSession
    end = spark.createDataFrame([(END, docs)], "e long, n long")
    rank = scratch(spark.createDataFrame(pa.table({"x": tree.words.view(np.int64), "rank": tree.rank.view(np.int64)})), "rank")
    seen = vocab.join(F.broadcast(rank), "x", "left").select(F.coalesce("rank", "x").alias("e"), "n").unionByName(end).where(F.col("n") >= PAIR)
    seen = scratch(seen, "seen")
    done = [rank, seen]
    before, terms, pairs = seen.withColumn("p", (F.col("n") - discount) / (tokens + 0.5)), None, None
    for k in range(1, DEPTH + 1):
        of = F.xxhash64("e", "e") if k == 1 else F.col("e")
        if k <= 3:
            field = bit_field(before.where((F.col("n") >= LEAST) & (F.col("e") != END)).select(of.alias("e")), "e")
            if not field.any():
                break
            tree.frequent[k] = field
            release(spark)
            pairs = _pairs(train, tree, k, k if k < 3 else DEPTH, bit_field(before.select(of.alias("e")), "e"))
        before, found, left = _level(pairs.where(F.col("k") == k).drop("k"), before)
        done += [before, left]
        if k < 3 or k == DEPTH:
            discard(pairs)
        terms = found if terms is None else terms.unionByName(found)
    lookup, read = others.select("x", F.col("n").alias("c"), F.lit(None).cast("double").alias("d")), [vocab]
    if terms is not None:
        terms = scratch(terms, "terms")
        read.append(terms)
        discard(*done)
        release(spark)
        top, others = parted(terms, "n", TOP_TERMS)
        top = top.select("x", "d").toArrow()
        keys = top.column("x").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        tree.keys, tree.terms = Index(keys[order]), top.column("d").to_numpy()[order]
        tree.nodes, tree.edges = bit_field(terms.where("node"), "x"), bit_field(terms.where("not node"), "x")
        lookup = lookup.unionByName(others.select("x", F.lit(None).cast("long").alias("c"), "d"))
    release(spark)
    return tree, lookup, read


#: Look-ups that a task gathers before it deals them out.
_GATHER = 1 << 19
#: A pack of arrays for bucket b from group g of texts, which a task has gathered. own: per text doc_id, without doc_id, tokens, known
#: tokens, base, score; else the words and terms that are left to look up: per look-up the step from the text before to its own in the
#: group, its hash and how often it is asked for (words: negative); then those of edges with a code: place and code in one number, and how often.
_PACKS = "b long, g long, own boolean, parts array<binary>"
#: A pack of answers for group g, or its own pack: per text its place, known tokens, base, score.
_SUMS = "g long, own boolean, parts array<binary>"
_ROWS = "d long, z long, n_tokens long, n_known long, base double, score double"
_OWN = (np.int64,) * 4 + (np.float64,) * 2
_ASKED = (np.int32, np.uint64, np.int32)
_ANSWER = (np.int32, np.int32, np.float64, np.float64)
_SHIFT = 20


def _bytes(arrays, types) -> list[bytes]:
    return [_squeezed(x, t) for x, t in zip(arrays, types, strict=True)]


def _arrays(parts: list[bytes], types) -> list[np.ndarray]:
    return [_array(p, t) for p, t in zip(parts, types, strict=True)]


def _word_buckets(buckets: int) -> int:
    """Buckets of words, the first ones; those of terms follow."""
    return 1 + buckets // 4


def _hash_of(coded: np.ndarray) -> np.ndarray:
    """The hash of the edge in a place and code."""
    return xxhash(coded >> np.uint64(_RANK) & _LOW, coded & _LOW)


def _dealt(asked: list, coded: list, own: list, g: int, buckets: int) -> pa.RecordBatch:
    """The own pack of group g, and one pack per bucket of its look-ups (x, text, n) and of those in codes."""
    x, of, n = (np.concatenate(c) for c in zip(*asked, strict=True))
    words = np.uint64(_word_buckets(buckets))
    b = np.where(n < 0, (x >> np.uint64(_SHIFT)) % words, words + (x >> np.uint64(_SHIFT)) % np.uint64(buckets))
    order, ends = _by_bucket(b, buckets + int(words))
    x, of, n = x[order], of[order], n[order]
    c = np.concatenate(coded)
    c.sort()
    new, m = _runs(c)
    c = c[new]
    order, coded_ends = _by_bucket(words + (_hash_of(c) >> np.uint64(_SHIFT)) % np.uint64(buckets), buckets + int(words))
    c, m = c[order], m[order]
    to = [int(mix(np.array([g], np.uint64), 17)[0] >> np.uint64(_SHIFT)) % buckets]
    parts = [_bytes([np.concatenate(c) for c in zip(*own, strict=True)], _OWN)]
    for b in sorted({*ends, *coded_ends}):
        (i, j), (k, l) = ends.get(b, (0, 0)), coded_ends.get(b, (0, 0))
        to.append(b)
        step = np.diff(of[i:j], prepend=0)  # look-ups lie in the order of their texts
        parts.append([*_bytes([step, x[i:j], n[i:j]], _ASKED), _packed(c[k:l]), _squeezed(m[k:l], np.int32)])
    own_pack = np.arange(len(to)) == 0
    return table(b=pa.array(to, pa.int64()), g=pa.array([g] * len(to), pa.int64()), own=own_pack, parts=pa.array(parts, pa.list_(pa.binary())))


def _score_rows(held, buckets: int):
    """Per group of texts a pack of their sums, and packs of the words and terms that are left to look up."""

    def run(batches):
        tree, task = held.value, TaskContext.get()
        totals = tree.totals
        scale = np.log10(totals["tokens"] + totals["types"] + 1)
        g = (task.partitionId() if task else 0) << 32
        asked, codes, sums, size, docs = [], [], [], 0, 0
        for rb in pieces(batches, most=_PIECE):
            w = Words(rb.column("text"), lower=True)
            n_docs = rb.num_rows
            v, begin, i, known = tree.symbols(w)
            terms, places, keys, coded_at, coded = tree.along(v, begin)
            c = tree.counts[i] if len(tree.words) else np.zeros(len(w.hash))
            own = np.where(known, np.log10(tree.root(c)), 0.0)
            base = np.where(known, np.log10(c + 1) - scale, 0.0)
            doc = w.doc()
            add = lambda v: np.bincount(doc, weights=v, minlength=n_docs)
            score = np.add.reduceat(terms, begin) + add(own) + np.log10(tree.end())
            d, z = (rb.column(c).to_numpy(zero_copy_only=False) for c in ("d", "z"))
            base = add(base) + np.log10(totals["docs"] + 1) - scale
            sums.append((d, z, w.counts() + 1, add(known) + (totals["docs"] > 0), base, score))
            rest = np.flatnonzero(~known)  # may be rarer training words
            x = np.concatenate([w.hash[rest], keys])
            of = np.concatenate([doc[rest], np.searchsorted(begin, places, "right") - 1])
            word = np.arange(len(x)) < len(rest)
            order = np.lexsort((word, x, of))
            of, x, word = of[order], x[order], word[order]
            new = np.ones(len(x), bool)
            new[1:] = (of[1:] != of[:-1]) | (x[1:] != x[:-1]) | (word[1:] != word[:-1])
            new = np.flatnonzero(new)
            n = np.diff(np.append(new, len(x)))
            asked.append((x[new], of[new] + docs, np.where(word[new], -n, n)))
            of = (np.searchsorted(begin, coded_at, "right") - 1 + docs).astype(np.uint64)
            codes.append(of << np.uint64(2 * _RANK) | coded)
            size, docs = size + len(new) + len(coded), docs + n_docs
            if max(size, docs) >= _GATHER:
                yield _dealt(asked, codes, sums, g, buckets)
                g, asked, codes, sums, size, docs = g + 1, [], [], [], 0, 0
        if sums:
            yield _dealt(asked, codes, sums, g, buckets)

    return run


def _answers(totals: dict):
    """A bucket's packs, its look-ups answered from the bucket's part (x, c, d) of the table by sums per text of the pack."""
    scale = np.log10(totals["tokens"] + totals["types"] + 1)

    def answer(index, c, delta, parts):
        step, x, n = _arrays(parts[:3], _ASKED)
        of, coded, m = np.cumsum(step), _unpacked(parts[3]), _array(parts[4], np.int32)
        at, hit = index.find(x)
        word, n = n < 0, np.abs(n).astype(np.float64)
        count = np.where(hit & word, c[at], 0)
        seen = np.maximum(count - totals["discount"], 0.05) / (totals["tokens"] + 0.5)
        score = n * np.where(word, np.log10(np.where(count > 0, seen, totals["unseen"])), np.where(hit, delta[at], 0.0))
        base = n * np.where(word, np.log10(count + 1) - scale, 0.0)
        at, hit = index.find(_hash_of(coded))
        place = (coded >> np.uint64(2 * _RANK)).astype(np.int64)
        size = 1 + max(of.max(initial=0), place.max(initial=0))
        known, base, score = (np.bincount(of, v, size) for v in (n * (count > 0), base, score))
        score = score + np.bincount(place, m * np.where(hit, delta[at], 0.0), size)
        there = np.flatnonzero((score != 0) | (base != 0))
        return there, known[there], base[there], score[there]

    def run(packs: pa.Table, part: pa.Table) -> pa.Table:
        key = part.column("x").to_numpy().view(np.uint64)
        order = np.argsort(key)
        held = Index(key[order]), part.column("c").fill_null(0).to_numpy()[order], part.column("d").fill_null(0.0).to_numpy()[order]
        if not len(key):
            held = Index(key), np.zeros(1, np.int64), np.zeros(1)
        own, out = packs.column("own").to_pylist(), []
        for is_own, parts in zip(own, packs.column("parts"), strict=True):
            parts = parts.as_py()
            out.append(parts if is_own else _bytes(answer(*held, parts), _ANSWER))
        return pa.table({"g": packs.column("g"), "own": packs.column("own"), "parts": pa.array(out, pa.list_(pa.binary()))})

    return run


def _gathered(packs: pa.Table) -> pa.Table:
    """The rows of a group's texts: their own sums and those of all buckets."""
    own = packs.column("own").to_pylist()
    parts = packs.column("parts").to_pylist()
    d, z, n_tokens, *sums = _arrays(parts[own.index(True)], _OWN)
    sums = [x.copy() for x in sums]
    for p in (p for p, is_own in zip(parts, own, strict=True) if not is_own):
        of, *more = _arrays(p, _ANSWER)  # a text comes once in a pack
        for x, y in zip(sums, more, strict=True):
            x[of] += y
    return pa.table(dict(zip([c.split()[0] for c in _ROWS.split(", ")], (d, z, n_tokens, *sums), strict=True)))


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of docs (doc_id, text).

    Tokens: words (runs of other characters than ASCII white space, A-Z lower-cased) and one end; a null text has the end
    alone. Training rows are those not held out by crc32 of doc_id; a null doc_id trains. base_score is the add-one unigram
    sum and score the tree's, both log10; unseen words are one token type in both. Without training rows every token is
    unseen. Other columns are ignored; repeated rows train and come back as often as they came; every row is scored by its own
    text, whatever its doc_id. An empty table gives an empty result. A text is worked on whole in one task, at some 100 bytes of memory for each of its bytes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    train = docs.where(~held_out(doc_id)).select(text.alias("text"))
    tree, lookup, read = trained(train)
    totals = tree.totals
    rows = docs.select(F.coalesce(doc_id, F.lit(0).cast("long")).alias("d"), doc_id.isNull().cast("long").alias("z"), text.alias("text"))
    buckets = 1 + totals["tokens"] // (2 * _BUCKET)
    held = spark.sparkContext.broadcast(tree)
    packs = rows.mapInArrow(_score_rows(held, buckets), _PACKS)
    words, h = F.lit(_word_buckets(buckets)).cast("long"), F.shiftrightunsigned("x", _SHIFT)
    of_word = F.col("c").isNotNull()
    lookup = lookup.withColumn("b", F.when(of_word, F.pmod(h, words)).otherwise(words + F.pmod(h, F.lit(buckets).cast("long"))))
    s = packs.groupBy("b").cogroup(lookup.groupBy("b")).applyInArrow(_answers(totals), _SUMS)
    # written here: a caller's result would else keep the tree in the driver's memory, beside that of the next call
    s = scratch(s.groupBy("g").applyInArrow(_gathered, _ROWS), "scores")
    held.destroy()
    del tree, held, packs, lookup
    discard(*read)
    release(spark)
    doc = F.when(F.col("z") == 0, F.col("d"))
    return s.select(
        doc.alias("doc_id"), held_out(doc).alias("held_out"), "n_tokens", "n_known",
        F.lit(totals["tokens"]).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )
