"""Token sets, quality gate, priority, similar pairs and leader clusters of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import running
from tidemark.session import bounded, durable, release, shuffle_width

#: Sets that hold a token from which on it is common, the share of all sets, one in so many, likewise, and most common tokens.
HOT, SHARE, COMMON = 100, 1000, 1 << 20
#: Words of 64 bits for a set's common tokens; most sets in a block, blocks aimed at where that suffices, least sets in one of those.
WORDS, BLOCK, BLOCKS, LEAST = 6, 65_536, 12, 8192
#: Sets of more tokens than LONG have a second sketch of WIDE words, since so many turn half the bits of the first one.
LONG, WIDE = 200, 32
#: Keys aimed at in a task; sets at a key up to which it is compared together with others; pairs laid out at a time.
KEYS, FEW, PAIRS = 400_000, 24, 1 << 18
#: A set in a block.
KIND = [("id", "<i8"), ("h", "<i8"), ("slack", "<f8"), ("w", "<u8", (WORDS,))]


def tokens(text: Column) -> Column:
    """Distinct lower-case words of more than one character, cut at white space of any script."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda t: F.length(t) > 1))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def keyword_hits(text: Column, lexicon: list[str]) -> Column:
    """Number of the lexicon's entries that the text holds."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return sum((t.contains(k).cast("int") for k in lexicon), F.lit(0))


def passes_gate(text: Column, body: Column, markers: list[str], min_words: int) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    bad = F.lit(False)
    for m in markers:
        bad |= t.contains(m)
    return ~(bad | (word_count(body) < min_words))


def priority(authority: Column, hits: Column, max_hits: int, fresh: Column) -> Column:
    return authority * (1 + F.least(hits, F.lit(max_hits))) * fresh


def similar_classes(docs: DataFrame, threshold: float, hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, members) of ``docs`` (id, toks): pairs (a, b, similarity), a < b, of Jaccard similarity of at least ``threshold``, and (id, rep).

    Equal token sets (told by SHA-256) are one class, stood for by its least id and compared once. Empty sets stand for
    themselves and match nothing. For ``hot`` see ``candidates``.
    """
    d = docs.select("id", F.sort_array("toks").alias("toks"))
    keyed = durable(d.withColumn("key", F.when(F.size("toks") > 0, F.unhex(F.sha2(F.concat_ws(" ", "toks"), 256)))), "tokens")
    lead = durable(keyed.where("key is not null").groupBy("key").agg(F.min("id").alias("rep")), "classes")
    members = durable(keyed.select("id", "key").join(bounded(lead), "key", "left").select("id", F.coalesce("rep", "id").alias("rep")), "members")
    # the sets themselves are not shuffled while the copies are few
    copies = bounded(members.where("id <> rep").select("id"))
    reps = keyed.where("key is not null").join(copies, "id", "left_anti").select("id", "toks")
    cand = durable(candidates(reps, threshold, hot), "candidates")
    named = bounded(cand.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    met = durable(reps.join(named, "id", "left_semi"), "met")
    release(keyed)

    def both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        return pairs.join(sets.select(F.col("id").alias("a"), F.col("toks").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("toks").alias("y")), "b")

    # tokens in common are at most their hashes in common and the tokens of one set that share a hash
    hashed = met.select("id", _hashes().alias("toks"))
    least = F.ceil((F.size("x") + F.size("y")) * (threshold / (1 + threshold)) - 1e-6)
    twice = F.size("x") - F.size(F.array_distinct("x"))
    left = durable(both(cand, hashed).where(F.size(F.array_intersect("x", "y")) + twice >= least).select("a", "b"), "likely")
    kept = bounded(left.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sim = both(left, met.join(kept, "id", "left_semi")).withColumn("similarity", jaccard(F.col("x"), F.col("y")))
    return sim.where(F.col("similarity") >= threshold - 1e-12).select("a", "b", "similarity"), members


def _hashes() -> Column:
    """The 64-bit hash of each of ``toks``."""
    return F.transform("toks", lambda t: F.xxhash64(t))


def candidates(sets: DataFrame, threshold: float, hot: int | None = None) -> DataFrame:
    """(a, b), a < b: every pair of ``sets`` (id, toks) that may be as similar as ``threshold``, and few others.

    Two such sets differ in at most (1 - threshold) / (1 + threshold) of both sizes' sum. A token in more than ``hot`` sets
    (by default one in ``SHARE``, at least ``HOT``) is common; at most ``COMMON`` tokens are. Pairs that share a rare token meet
    at one, of the prefix with rare tokens first. In all others every rare token is a difference, so that little is left for the
    common ones: sets are cut into blocks by size, and blocks are compared in bits, of which a difference turns one at most.
    Nothing is lost.
    """
    if hot is None:
        docs, toks = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("toks")), F.lit(0))).first()
        hot = max(HOT, docs // SHARE, toks // COMMON)
    tok = sets.select(F.explode("toks").alias("t")).select(F.xxhash64("t").alias("t"))
    common = tok.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > hot).select("t").toArrow().column("t").to_numpy()
    common = sets.sparkSession.sparkContext.broadcast(sorted(common.tolist()))
    share = (1 - threshold) / (1 + threshold)
    words = ["q", *(f"w{k}" for k in range(WORDS))]

    def signed(batches):
        import numpy as np

        known = np.array(common.value, np.int64)
        for b in batches:
            if b.num_rows:
                yield _signed(b, known, threshold, share)

    def meeting(batches):
        import numpy as np
        import pyarrow as pa

        rows = [b for b in batches if b.num_rows]
        if rows:
            x = pa.Table.from_batches(rows)
            t, ids, n, *w = (x.column(c).to_numpy() for c in ["t", "id", "n", *words])
            a, b = _meet(t, ids, n, np.stack(w).view(np.uint64), threshold, share)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})

    kind = ", ".join(["id long, n int, h long, slack double", *(f"{w} long" for w in words), "keys array<long>, v array<long>"])
    sig = durable(sets.select("id", _hashes().alias("toks")).mapInArrow(signed, kind), "signatures")
    keys = sig.select("id", "n", *words, F.explode("keys").alias("t"))
    parts = max(shuffle_width(sets.sparkSession), -(-(sig.agg(F.sum(F.size("keys"))).first()[0] or 0) // KEYS))
    met = keys.repartition(parts, "t").mapInArrow(meeting, "a long, b long").unionByName(_without_rare(sig))
    long = bounded(sig.where(F.col("n") > LONG).select("id", "n", *(F.col("v")[k].alias(f"v{k}") for k in range(WIDE))))
    turned = sum((F.bit_count(F.col(f"x.v{k}").bitwiseXOR(F.col(f"y.v{k}"))) for k in range(WIDE)), F.lit(0))
    apart = turned > (F.col("x.n") + F.col("y.n")) * share + 1e-6  # null where a set isn't long
    met = met.join(long.alias("x"), F.col("a") == F.col("x.id"), "left").join(long.alias("y"), F.col("b") == F.col("y.id"), "left")
    return met.where(~F.coalesce(apart, F.lit(False))).select("a", "b").distinct()


def _meet(t, ids, n, w, threshold: float, share: float):
    """(a, b), a < b, each once: pairs of sets at the same key ``t`` whose sizes and bits (``w``, a row for each word) may be those of sets as similar as ``threshold``.

    Three words laid over the others rule most pairs out; a group larger than ``FEW`` is laid out in a matrix, ``PAIRS`` at a time.
    """
    import numpy as np

    order = np.lexsort((n, t))
    t, ids, n, w = t[order], ids[order], n[order].astype(np.int64), np.ascontiguousarray(w[:, order])
    begins = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    size = np.diff(np.append(begins, len(t)))
    laid = np.stack([np.bitwise_xor.reduce(w[k::3], axis=0) for k in range(3)])
    found = []

    def keep(i, j, of=w):
        # within a key sizes don't fall
        near = n[i] >= threshold * n[j] - 1e-9
        i, j = i[near], j[near]
        if not len(i):
            return
        turned = np.bitwise_count(of[0][i] ^ of[0][j]).astype(np.int16)
        for u in of[1:]:
            turned += np.bitwise_count(u[i] ^ u[j])
        near = turned <= (n[i] + n[j]) * share + 1e-6
        if of is laid:
            return keep(i[near], j[near])
        a, b = ids[i[near]], ids[j[near]]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b])

    after = np.repeat(begins + size, size) - np.arange(len(t)) - 1  # sets at the key from here on
    i = np.flatnonzero(np.repeat(size <= FEW, size))
    for step in range(1, FEW):
        i = i[after[i] >= step]
        for k in range(0, len(i), PAIRS):
            keep(i[k : k + PAIRS], i[k : k + PAIRS] + step, laid)
    for begin, end in zip(begins[size > FEW], (begins + size)[size > FEW]):
        at, sizes = begin, n[begin:end]
        while at < end:
            to = min(end, at + max(1, min(64, PAIRS // (end - at))))
            stop = begin + np.searchsorted(sizes, (n[to - 1] + 1e-9) / threshold, "right") if threshold > 0 else end
            # random turns come to more of 192 bits; a byte that runs over only lets a pair through
            of = laid if 2 * n[to - 1] * share < 60 else w
            most = np.minimum((n[to - 1] + n[at:stop]) * share + 1e-6, 255).astype(np.uint8)
            turned = np.bitwise_count(of[0, at:to, None] ^ of[0, None, at:stop])
            for u in of[1:]:
                turned += np.bitwise_count(u[at:to, None] ^ u[None, at:stop])
            i, j = np.divmod(np.flatnonzero(turned <= most), stop - at)
            keep(at + i[j > i], at + j[j > i])
            at = to
    both = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    both = both[:, np.lexsort(both)]
    return both[:, np.concatenate([[True], (both[:, 1:] != both[:, :-1]).any(axis=0)])] if both.size else both


def _signed(batch, common, threshold: float, share: float):
    """Of sets (id, toks as hashes): size, number of common tokens, slack, bits of rare (q) and common tokens (w0 ...), rare tokens of the prefix, bits of all tokens where they are many (v)."""
    import numpy as np
    import pyarrow as pa

    t = batch.column("toks")
    n = t.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    t = t.flatten().to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    at = np.searchsorted(common, t)
    rare = np.ones(len(t), bool) if not len(common) else common[np.minimum(at, len(common) - 1)] != t
    bit = np.uint64(1) << (t.view(np.uint64) & np.uint64(63))
    word = np.where(rare, 0, 1 + (t.view(np.uint64) >> np.uint64(6)) % np.uint64(WORDS))
    bits = np.zeros((len(n), 1 + WORDS), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        begins = np.cumsum(n)[some] - n[some]
        for k in range(1 + WORDS):
            bits[some, k] = np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), begins)
    # a row of bits for each long set
    long = n > LONG
    of, u = (np.cumsum(long) - 1)[row[long[row]]], t[long[row]].view(np.uint64) >> np.uint64(16)
    wide = np.zeros(long.sum() * WIDE, np.uint64)
    np.bitwise_xor.at(wide, of * WIDE + (u >> np.uint64(6) & np.uint64(WIDE - 1)).astype(np.int64), np.uint64(1) << (u & np.uint64(63)))
    few = np.bincount(row[rare], minlength=len(n))
    row, key = row[rare], t[rare]
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    first = np.cumsum(few) - few
    prefix = np.arange(len(key)) - first[row] < (n - np.ceil(n * threshold - 1e-9) + 1)[row]
    ends = np.cumsum(np.bincount(row[prefix], minlength=len(n)))
    keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(key[prefix]))
    cols = {"id": batch.column("id"), "n": pa.array(n.astype(np.int32)), "h": pa.array(n - few), "slack": pa.array(n * share - few), "q": pa.array(bits[:, 0].copy().view(np.int64))}
    cols |= {f"w{k}": pa.array(bits[:, 1 + k].copy().view(np.int64)) for k in range(WORDS)} | {"keys": keys, "v": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(long) * WIDE]).astype(np.int32)), pa.array(wide.view(np.int64)))}
    return pa.RecordBatch.from_pydict(cols)


def _without_rare(sig: DataFrame) -> DataFrame:
    """(a, b) of ``sig`` (id, n, h common tokens, slack, bits) whose common tokens may differ in no more than both slacks' sum."""
    words = [f"w{k}" for k in range(WORDS)]
    # a set that the largest slack can't make up for has no partner
    most = sig.agg(F.max("slack")).first()[0] or 0.0
    s = sig.where(F.col("slack") >= -most - 1e-6).select("id", "n", "h", "slack", *words)
    n = s.count()
    blocks = max(1, -(-n // BLOCK), min(BLOCKS, n // LEAST))

    def packed(batches):
        import hashlib

        import numpy as np
        import pandas as pd

        rows = [b for b in batches if len(b)]
        t = pd.concat(rows) if rows else ()
        for i in range(0, len(t), 2 * BLOCK):
            x = t.iloc[i : i + 2 * BLOCK]
            r = np.empty(len(x), KIND)
            r["id"], r["h"], r["slack"], r["w"] = x.id, x.h, x.slack, x[words].to_numpy(np.int64).view(np.uint64)
            data = r.tobytes()
            yield pd.DataFrame({"k": [hashlib.blake2b(data, digest_size=16).hexdigest()], "low": [float((x.h - x.slack).min())], "high": [float((x.h + x.slack).max())], "data": [data]})

    parts = durable(s.repartitionByRange(blocks, "n", "id").mapInPandas(packed, "k string, low double, high double, data binary"), "blocks")
    i, j = parts.drop("data").alias("i"), parts.drop("data").alias("j")
    # the difference is at least that of the numbers of common tokens
    near = (F.col("i.low") <= F.col("j.high") + 1e-6) & (F.col("j.low") <= F.col("i.high") + 1e-6)
    pairs = i.join(F.broadcast(j), (F.col("i.k") <= F.col("j.k")) & near).select(F.col("i.k").alias("i"), F.col("j.k").alias("j"))
    sides = durable(pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("k")), "block_pairs")

    def compared(x):
        return _compare(x.data.iloc[0], x.data.iloc[-1])

    return parts.select("k", "data").join(bounded(sides), "k").select("i", "j", "data").groupBy("i", "j").applyInPandas(compared, "a long, b long")


def _compare(left: bytes, right: bytes):
    """(a, b) of two blocks, or of one with itself, that may be alike.

    All words are laid over each other for a first comparison, in one word or two; all bits are compared where that doesn't rule the pair out.
    """
    import numpy as np
    import pandas as pd

    few, many, enough = 16, 2048, 14

    def chunks(data: bytes) -> list:
        # by the least number of common tokens a partner may have, then the most first, which at like sizes is the most slack first
        r = np.frombuffer(data, KIND)
        r = r[np.argsort(r["h"] - r["slack"], kind="stable")]
        out = []
        for g in range(0, len(r), many):
            p = r[g : g + many]
            p = p[np.argsort(-(p["h"] + p["slack"]), kind="stable")]
            low, high = p["h"] - p["slack"], p["h"] + p["slack"]
            most = np.maximum.accumulate(p["slack"][::-1])[::-1]  # largest slack from here on
            w = np.ascontiguousarray(p["w"].T)
            halves = np.stack([np.bitwise_xor.reduce(w[::2], axis=0), np.bitwise_xor.reduce(w[1::2], axis=0)])
            out.append((low.min() - 1e-6, high + 1e-6, p["id"].copy(), p["h"].copy(), p["slack"].copy(), most, halves[0] ^ halves[1], halves, w))
        return out

    turned, count, more = np.empty(few * many, np.uint64), np.empty(few * many, np.uint8), np.empty(few * many, np.uint8)
    fits = np.zeros(few * many // 8, np.uint64)  # eight answers in each
    found = []
    lefts = chunks(left)
    rights = lefts if left == right else chunks(right)
    for c, (low, high, ids, size, slack, _, one, two, w) in enumerate(lefts):
        for low2, high2, ids2, size2, slack2, most2, one2, two2, w2 in rights[c if rights is lefts else 0 :]:
            rows, cols = np.searchsorted(-high, -low2, "right"), np.searchsorted(-high2, -low, "right")
            for g in range(0, rows if cols else 0, few):
                to = min(g + few, rows)
                # falls along the chunk
                bound = np.floor(slack[g:to].max() + most2[:cols] + 1e-6)
                end, wide = np.searchsorted(-bound, 0, "right"), np.searchsorted(-bound, -enough, "left")
                for begin, end, halves in ((0, min(wide, end), True), (min(wide, end), end, False)):
                    m = end - begin
                    if m <= 0:
                        continue
                    many8 = -(-m // 8) * 8
                    x, y, z = (v[: (to - g) * m].reshape(to - g, m) for v in (turned, count, more))
                    f = fits[: (to - g) * many8 // 8]
                    if m < many8:
                        f[:] = 0
                    if halves:
                        np.bitwise_xor(two[0, g:to, None], two2[0, None, begin:end], out=x)
                        np.bitwise_count(x, out=y)
                        np.bitwise_xor(two[1, g:to, None], two2[1, None, begin:end], out=x)
                        np.bitwise_count(x, out=z)
                        np.add(y, z, out=y)
                    else:
                        np.bitwise_xor(one[g:to, None], one2[None, begin:end], out=x)
                        np.bitwise_count(x, out=y)
                    fit = f.view(bool).reshape(to - g, many8)
                    np.less_equal(y, np.minimum(bound[begin:end], 255).astype(np.uint8), out=fit[:, :m])
                    if not f.view(bool).any():
                        continue
                    at = np.flatnonzero(f != 0)
                    at = (at[:, None] * 8 + np.arange(8))[f.view(bool).reshape(-1, 8)[at]]
                    p, q = np.divmod(at, many8)
                    p, q = p + g, q + begin
                    for words, words2 in ((two, two2), (w, w2)):
                        if words is two and halves:
                            continue
                        n = sum(np.bitwise_count(u[p] ^ v[q]).astype(np.int64) for u, v in zip(words, words2))
                        near = n <= slack[p] + slack2[q] + 1e-6
                        p, q = p[near], q[near]
                    near = np.abs(size[p] - size2[q]) <= slack[p] + slack2[q] + 1e-6
                    u, v = ids[p[near]], ids2[q[near]]
                    if len(u):
                        found.append(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1)[u != v])
    both = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})


def leaders(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, event_id) by greedy leader clustering in order of id: an item joins its earliest similar leader, else leads.

    ``links`` and ``members`` as from ``similar_classes``; equal items share their representative's event. By rounds: an
    undecided item with a leader among its earlier neighbours is a member, one whose earlier neighbours are all members
    leads. Every round decides at least the least open id, so the rounds end; each is written to the shared folder, so the
    plan doesn't grow, and the one before is deleted; no group is gathered.
    """
    pairs = links
    reps = members.select(F.col("rep").alias("id")).distinct()
    state = durable(reps.join(pairs.select(F.col("b").alias("id")).distinct().withColumn("_o", F.lit(1)), "id", "left").select("id", F.when(F.col("_o").isNull(), F.lit(1)).otherwise(F.lit(0)).alias("s")), "state")
    edges = durable(pairs.select("a", "b"), "edges")
    while not state.where("s = 0").isEmpty():
        near = edges.join(state.where("s = 0").select(F.col("id").alias("b")), "b").join(state.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
        seen = near.groupBy(F.col("b").alias("id")).agg(F.max((F.col("sa") == 1).cast("int")).alias("led"), F.max((F.col("sa") == 0).cast("int")).alias("open"))
        new = F.when(F.col("s") != 0, F.col("s")).when(F.col("led") == 1, 2).when(F.col("open") == 0, 1).otherwise(0)
        before, state = state, durable(state.join(seen, "id", "left").select("id", new.alias("s")), "state")
        release(before)
    first = edges.join(state.where("s = 1").select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("lead"))
    settled = state.join(first, "id", "left").select(F.col("id").alias("rep"), F.when(F.col("s") == 1, F.col("id")).otherwise(F.col("lead")).alias("event_id"))
    return members.join(settled, "rep").select("id", "event_id")


def prioritised(pool: DataFrame, threshold: float, penalty: float, least: float) -> DataFrame:
    """(id, event_id, novelty, score, eligible) of ``pool`` (id, base, bad, toks): near-copies of a better item join its event and lose by ``penalty``.

    Items are taken by base score, then id: each joins the earliest leader it is as similar to as ``threshold``, else
    leads. Bad items stay out, keep an event of their own and are not eligible; so are scores under ``least``.
    """
    # written first, since a range sort evaluates its input twice
    good = durable(pool.where("not bad"), "good")
    ranked = durable(running(good, [], [F.col("base").desc_nulls_last(), F.col("id")]), "ranked")
    release(good)
    events = leaders(*similar_classes(ranked.select(F.col("_rank").alias("id"), "toks"), threshold)).select(F.col("id").alias("_rank"), F.col("event_id").alias("_lead"))
    names = ranked.select(F.col("_rank").alias("_lead"), F.col("id").alias("event_id"))
    good = ranked.select("id", "base", "_rank").join(events, "_rank").join(names, "_lead")
    novelty = F.when(F.col("event_id") == F.col("id"), F.lit(1.0)).otherwise(F.lit(penalty))
    out = good.select("id", "event_id", novelty.alias("novelty"), (F.coalesce("base", F.lit(0.0)) * novelty).alias("score")).withColumn("eligible", F.col("score") >= least)
    return out.unionByName(pool.where("bad").select("id", F.col("id").alias("event_id"), F.lit(1.0).alias("novelty"), F.lit(0.0).alias("score"), F.lit(False).alias("eligible")))
