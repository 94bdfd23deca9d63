"""Near-duplicate records by circulant MinHash, banding and exact Jaccard verification.

One permutation scatters the shingles over a circle, a second one, shifted by one place per
coordinate, ranks them: two permutations make all coordinates. One pass over the texts computes
signatures and packs the band keys of a batch into one blob per key range, so that what is
shuffled is a few bytes per key. Pairs that share a band are screened by one-bit sketches of the
signature and then compared exactly, on the texts' whole shingle sets.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.buckets import WHOLE, large_bucket_pairs
from tidemark.session import bounded, durable, release, shuffle_width

WORD = re.compile(r"[^\W_]+")
#: Places on the circle, a power of two. Shingles that share a place only add candidates.
PLACES = 1 << 20
#: Documents per blob; the local number of a document takes 12 bits.
BATCH = 4096
#: Keys that one task sorts at a time.
RANGE_KEYS = 2_000_000


@dataclass(frozen=True)
class Plan:
    """words per shingle, least similarity, least words, bands of so many rows."""

    words: int = 5
    similarity: float = 0.8
    least_words: int = 0
    bands: int = 24
    rows: int = 6
    seed: int = 11

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows

    @property
    def screen(self) -> int:
        """Least equal sketch bits: 3.5 standard deviations under what the similarity threshold lets expect."""
        k, p = self.coordinates, (1 + self.similarity) / 2
        return int(k * p - 3.5 * np.sqrt(k * p * (1 - p)))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Texts to 64-bit shingle hashes; words are hashed once per worker, as far as memory is set aside."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def _word(self, w: str) -> int:
        h = self.known.get(w)
        if h is None:
            h = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            if len(self.known) < 300_000:
                self.known[w] = h
        return h

    def batch(self, texts: list[str], least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingles, their document's position, words per document). Documents of fewer than least_words have no shingles."""
        get, slow = self.known.get, self._word
        hashes: list[int] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for k, t in enumerate(texts):
            ws = WORD.findall(t.lower())
            counts[k] = len(ws)
            if len(ws) >= max(least_words, 1):
                hashes += [get(w) or slow(w) for w in ws]
        used = np.where(counts >= max(least_words, 1), counts, 0)
        h = np.array(hashes, dtype=np.uint64)
        doc = np.repeat(np.arange(len(texts)), used)
        n = self.words
        if len(h) < n:
            return h[:0], doc[:0], counts
        s = h[: len(h) - n + 1].copy()
        with np.errstate(over="ignore"):
            for j in range(1, n):
                s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
        ok = doc[: len(s)] == doc[n - 1 :]
        return s[ok], doc[: len(s)][ok], counts


def permutations(plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """The two permutations of places, the second prolonged by as many places as there are shifts."""
    rng = np.random.default_rng(plan.seed)
    first = rng.permutation(PLACES).astype(np.int32)
    second = rng.permutation(PLACES).astype(np.int32)
    return first, np.concatenate([second, second[: plan.coordinates]])


def signatures(shingles: np.ndarray, doc: np.ndarray, plan: Plan, perms: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(documents that have shingles, their signatures)."""
    first, second = perms
    docs, start = np.unique(doc, return_index=True)
    place = first[(shingles & np.uint64(PLACES - 1)).astype(np.int64)]
    windows = np.lib.stride_tricks.sliding_window_view(second, plan.coordinates)
    out = np.empty((len(docs), plan.coordinates), dtype=np.int32)
    step = max(1, 4_000_000 // plan.coordinates)
    k = 0
    ends = np.append(start[1:], len(doc))
    while k < len(docs):
        # whole documents whose shingles fit one gather, or one long document in pieces
        j = max(k + 1, int(np.searchsorted(ends, start[k] + step, side="right")))
        if ends[j - 1] - start[k] <= step:
            out[k:j] = np.minimum.reduceat(windows[place[start[k] : ends[j - 1]]], start[k:j] - start[k], axis=0)
        else:
            out[k] = np.minimum.reduce([windows[place[a : min(a + step, ends[k])]].min(axis=0) for a in range(start[k], ends[k], step)])
        k = j
    return docs, out


def band_keys(sig: np.ndarray, plan: Plan) -> np.ndarray:
    s = sig.astype(np.uint64).reshape(len(sig), plan.bands, plan.rows)
    h = np.broadcast_to(np.arange(1, plan.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), s.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for r in range(plan.rows):
            h = _mix(h * np.uint64(31) + s[:, :, r] + np.uint64(1))
    return h


def _pack(plan: Plan, ranges: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per batch: one row with ids, contents and sketches (range -1), and one row per key range with sorted keys and local numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        perms, sh = permutations(plan), Shingler(plan.words)
        part, count = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, len(b), BATCH):
                ids, texts = b["id"].to_numpy()[at : at + BATCH], b["text"].tolist()[at : at + BATCH]
                s, d, _ = sh.batch(texts, plan.least_words)
                if not len(s):
                    continue
                docs, sig = signatures(s, d, plan, perms)
                # equal sets give equal contents: two order-free sums over the distinct shingles, 128 bits
                order = np.lexsort((s, d))
                s, d = s[order], d[order]
                new = np.append(True, (s[1:] != s[:-1]) | (d[1:] != d[:-1]))
                with np.errstate(over="ignore"):
                    starts = np.unique(d[new], return_index=True)[1]
                    content = np.stack([np.add.reduceat(_mix(s[new] ^ np.uint64(x)), starts) for x in (0, 0x5851F42D4C957F2D)], axis=1)
                sketch = np.packbits((sig & 1).astype(np.uint8), axis=1)
                base = (part << 40) | (count << 12)
                count += 1
                keys = band_keys(sig, plan)
                # one of each content in a batch stands for the others
                _, lead = np.unique(content, axis=0, return_index=True)
                k, local = keys[lead].ravel(), np.repeat(lead, plan.bands).astype(np.uint16)
                rng = (k % np.uint64(ranges)).astype(np.int64)
                short = (k // np.uint64(ranges)).astype(np.uint32)
                order = np.lexsort((short, rng))
                rng, short, local = rng[order], short[order], local[order]
                cuts = np.searchsorted(rng, np.arange(ranges + 1))
                full = [g for g in range(ranges) if cuts[g + 1] > cuts[g]]
                yield pd.DataFrame(
                    {
                        "rng": [-1, *full], "base": base,
                        "a": [ids[docs].astype("<i8").tobytes(), *(short[cuts[g] : cuts[g + 1]].tobytes() for g in full)],
                        "b": [content.tobytes() + sketch.tobytes(), *(local[cuts[g] : cuts[g + 1]].tobytes() for g in full)],
                    }
                )

    return run


def _unpack(plan: Plan) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    width = (plan.coordinates + 7) // 8

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for base, a, x in zip(b["base"], b["a"], b["b"]):
                n = len(a) // 8
                sk = np.frombuffer(x, dtype=np.uint8, offset=16 * n).reshape(n, width)
                yield pd.DataFrame({"rid": base + np.arange(n), "id": np.frombuffer(a, dtype="<i8"), "content": [x[16 * k : 16 * k + 16] for k in range(n)], "sketch": [r.tobytes() for r in sk]})

    return run


def _collide(pdf: pd.DataFrame) -> pd.DataFrame:
    """Keys of one range: pairs of small buckets, and the members of large ones (b is null, key tells the bucket)."""
    keys = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in pdf["a"]])
    rid = np.concatenate([base + np.frombuffer(x, dtype=np.uint16).astype(np.int64) for base, x in zip(pdf["base"], pdf["b"])])
    order = np.argsort(keys, kind="stable")
    keys, rid = keys[order], rid[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    size = np.diff(np.append(start, len(keys)))
    pa, pb = [], []
    for n in np.unique(size[(size > 1) & (size <= WHOLE)]):
        m = rid[start[size == n][:, None] + np.arange(n)[None, :]]
        i, j = np.triu_indices(n, 1)
        pa.append(m[:, i].ravel())
        pb.append(m[:, j].ravel())
    a = np.concatenate(pa) if pa else rid[:0]
    b = np.concatenate(pb) if pb else rid[:0]
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    pairs = pd.DataFrame({"a": lo, "b": pd.array(hi, dtype="Int64"), "key": np.int64(0)}).drop_duplicates()
    big = np.repeat(size > WHOLE, size)
    rng = int(pdf["rng"].iloc[0])
    members = pd.DataFrame({"a": rid[big], "b": pd.array([None] * int(big.sum()), dtype="Int64"), "key": (rng << 32) | keys[big].astype(np.int64)})
    return pd.concat([pairs, members])


_BITS = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def _screen(plan: Plan) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.frombuffer(b"".join(b["sa"]), dtype=np.uint8) ^ np.frombuffer(b"".join(b["sb"]), dtype=np.uint8)
                apart = _BITS[x].reshape(len(b), -1).sum(axis=1)
                yield b.loc[plan.coordinates - apart.astype(int) >= plan.screen, ["a", "b"]]

    return run


def _check_sketches(plan: Plan) -> Callable[[pd.DataFrame, pd.DataFrame], tuple[np.ndarray, np.ndarray]]:
    def check(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(left["sketch"]), dtype=np.uint8).reshape(len(left), -1)
        y = np.frombuffer(b"".join(right["sketch"]), dtype=np.uint8).reshape(len(right), -1)
        apart = np.stack([_BITS[r[None, :] ^ y].sum(axis=1) for r in x]) if len(x) and len(y) else np.zeros((len(x), len(y)), dtype=int)
        return np.nonzero(plan.coordinates - apart.astype(int) >= plan.screen)

    return check


def _sets(plan: Plan) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sh = Shingler(plan.words)
        for b in batches:
            s, d, _ = sh.batch(b["text"].tolist(), plan.least_words)
            order = np.lexsort((s, d))
            s, d = s[order], d[order]
            new = np.append(True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])) if len(s) else np.zeros(0, dtype=bool)
            s, d = s[new], d[new]
            docs, start = np.unique(d, return_index=True)
            yield pd.DataFrame({"id": b["id"].to_numpy()[docs], "set": [x.tobytes() for x in np.split(s, start[1:])] if len(docs) else []})

    return run


def _exact(plan: Plan) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sim = np.zeros(len(b))
            for k, (p, q) in enumerate(zip(b["pa"], b["pb"])):
                x, y = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                sim[k] = both / (len(x) + len(y) - both)
            out = b[["a", "b"]].assign(similarity=sim)
            yield out[sim >= plan.similarity - 1e-12]

    return run


@dataclass(frozen=True)
class Groups:
    """links (a, b, similarity) between documents that stand for their equals, and members (id, rep): equal shingle sets."""

    links: DataFrame
    members: DataFrame


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> Groups:
    """Links of at least ``plan.similarity`` between different contents, and the members of each content, for ``docs`` (id, text).

    Null, empty and too short texts take no part. Repeated rows and texts with equal shingles form one class, stood for
    by its least id, so copies never meet in a bucket. Buckets of any size are compared, large ones in blocks. Very long
    texts count whole. Candidates come from banding: at the threshold a pair is found with probability 1 - (1 - s^rows)^bands.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("id").cast("long").alias("id"), "text").where("text is not null")
    rows = texts.select("id").count()
    ranges = max(shuffle_width(spark), -(-rows * plan.bands // RANGE_KEYS))
    packed = durable(texts.mapInPandas(_pack(plan, ranges), "rng int, base bigint, a binary, b binary"), "packed")
    info = durable(packed.where("rng = -1").select("base", "a", "b").mapInPandas(_unpack(plan), "rid bigint, id bigint, content binary, sketch binary"), "info")
    lead = info.groupBy("content").agg(F.min("id").alias("rep"))
    members = durable(info.join(lead, "content").select("rid", "id", "rep"), "members")
    met = durable(packed.where("rng >= 0").repartition(ranges, "rng").groupBy("rng").applyInPandas(_collide, "a bigint, b bigint, key bigint"), "met")
    release(packed)
    # from local numbers to the documents that stand for them; copies in different batches fall together here
    stand = info.join(lead, "content").select("rid", F.col("rep").alias("id"), "sketch")
    far = F.col("a") != F.col("b")
    side = lambda c: stand.select(F.col("rid").alias(f"r{c}"), F.col("id").alias(c), F.col("sketch").alias(f"s{c}"))
    pairs = met.where("b is not null").select(F.col("a").alias("ra"), F.col("b").alias("rb"))
    pairs = pairs.join(side("a"), "ra").join(side("b"), "rb").where(far).select("a", "b", "sa", "sb").mapInPandas(_screen(plan), "a bigint, b bigint")
    big = met.where("b is null").select(F.col("a").alias("rid"), "key").join(stand.select("rid", "id"), "rid").select("key", "id").distinct()
    big = durable(big, "large")
    sizes = big.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # what was large by copies only may be small now; any size is compared in blocks
    more = large_bucket_pairs(big, sizes, stand.select("id", "sketch").dropDuplicates(["id"]), _check_sketches(plan), whole=1)
    cand = pairs.unionByName(more).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    cand = durable(cand, "candidates")
    release(met, info, big)
    wanted = cand.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = texts.join(bounded(wanted), "id", "left_semi").mapInPandas(_sets(plan), "id bigint, set binary")
    full = cand.join(sets.select(F.col("id").alias("a"), F.col("set").alias("pa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("pb")), "b")
    links = durable(full.mapInPandas(_exact(plan), "a bigint, b bigint, similarity double").dropDuplicates(["a", "b"]), "links")
    return Groups(links, members.select("id", "rep"))


def expanded(groups: Groups) -> DataFrame:
    """(a, b), a < b: all pairs of records, copies included."""
    m = groups.members
    cross = groups.links.join(m.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(m.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    several = m.groupBy("rep").count().where("count > 1").select("rep")
    copies = m.join(several, "rep", "left_semi")
    same = copies.select("rep", F.col("id").alias("x")).join(copies.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y")
    return cross.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def classes(groups: Groups) -> DataFrame:
    """(id, rep, n_links): one row per document, its class of equals, and the number of other classes it is linked to."""
    n = groups.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    return groups.members.join(n, "rep", "left").select("id", "rep", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def grouped(groups: Groups) -> DataFrame:
    """(id, group_id, n): every record of a group of two or more, copies included; a group is what links connect, named by its least id.

    Least labels travel along the links and jump to their label's label, so a chain of n links takes about log n rounds;
    each round is written to the shared folder, and no group is gathered.
    """
    links = groups.links.select("a", "b")
    edges = durable(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = durable(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(label.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = label.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.join(label.select(F.col("id").alias("label"), F.col("label").alias("far")), "label", "left")
        new = durable(jump.select("id", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        moved = not new.where("old <> label").isEmpty()
        release(label)
        label = new
        if not moved:
            break
    all_ = groups.members.join(label.select(F.col("id").alias("rep"), "label"), "rep", "left").select("id", F.coalesce("label", "rep").alias("group_id"))
    n = all_.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return all_.join(n, "group_id").select("id", "group_id", "n")
