"""New batches against all history: same page address or same headline.

The state is a folder that can be closed and opened again: three tables that only grow, cut into
buckets by hash and sorted inside them, the list of common words its keys were made with, and a
mark for each batch taken in. A headline's signature is the least hashes of its telling words;
each pair of signature entries, with the figures and months, is a band key. A batch shuffles its
own keys to the buckets and meets the held keys there; of the history only the buckets met are
read and nothing is shuffled. Headlines that share a key are compared in full, and what is new is
appended.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.attempts import Attempts
from tidemark.llm.buckets import WHOLE, in_blocks, small_bucket_pairs
from tidemark.operators.outlets import url_host
from tidemark.session import durable, folder_names, make_folder, new_path, release, shuffle_width

#: A word in at least this share of the first batch's distinct headlines, and in so many of them, says little about which story it is.
#: There are at most mean length / share such words. The list is stored: it decides which keys are made, not what is the same.
COMMON, COMMON_LEAST = 0.002, 30
#: Word changes allowed besides spelling slips, and the part of a headline that a cut one must keep.
SWAPS, KEEP = 2, 0.6
#: Words on either side that may differ where two headlines share less than two telling words, and common words that stand in if they share none.
EDITS, REST = 2, 6
#: Entries of the signature. Two headlines that share two telling words, and have at most SIGNATURE - 2 others each, share a pair of entries.
SIGNATURE = 8
#: Word hashes after all others, for headlines of few common words.
BLANKS = [(1 << 64) - 1 - k for k in reversed(range(REST + EDITS))]

# Query parts that do not select an article, month names, and marks that desks put before a headline.
TRACKING = r"utm_[a-z_]+|fbclid|gclid|dclid|msclkid|igshid|mc_[ce]id|cmpid|cmp|ref|referrer|src|source|trk|spm|share|amp|outputtype"
MONTHS = set("january february march april may june july august september october november december".split())
LABEL = re.compile(r"\s*[(\[]?\s*(?:exclusive|breaking(?: news)?|update(?:d)?(?: ?\d+)?|wrap ?up(?: ?\d+)?|refile|correct(?:ion|ed)|corrected|recap|live|watch|video|factbox|rpt)\s*[)\]]?\s*(?:[:\-–—|]+|(?<=[)\]]))\s*", re.I)
TRAILER = re.compile(r"\s*[(\[](?:video|audio|photos?|pictures|live|update[d]?|graphic|podcast)[)\]]\s*$", re.I)
OUTLET = re.compile(r"\s+(?:-|–|—|\||::|»)\s+[^\-–—|:]{3,40}$")
CUT = re.compile(r"\s*(?:…|\.\.\.)\s*$")
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)?")
QUOTES = "\"“”„'‘’«» "


def address_key(url: Column) -> Column:
    """Host without port and edition prefix, path without closing slash, and the query parts that select an article, in order. Null if there is no host."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_extract(u, r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//[^/?]+([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(rest, r"(?i)/(?:amp|index\.\w+)/?$", ""), r"/+$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^(?:{TRACKING})(?:=|$)")))
    return F.when(url_host(url).isNotNull(), F.concat(url_host(url), path, F.lit("?"), F.array_join(F.array_distinct(parts), "&")))


def clean(title: str) -> tuple[str, bool]:
    """Headline without mark-up, desk marks, outlet and quotes; whether it was cut."""
    t = html.unescape(title) if "&" in title else title
    t = (t if t.isascii() else unicodedata.normalize("NFKC", t)).strip()
    if t[-1:] in (")", "]"):
        t = TRAILER.sub("", t)
    short = OUTLET.sub("", t) if any(c in t for c in "-–—|:»") else t
    if short != t and len(TOKEN.findall(short)) >= 4:
        t = short
    t = (TRAILER.sub("", t) if t[-1:] in (")", "]") else t).strip(QUOTES)
    for _ in range(2):
        mark = LABEL.match(t)
        if not mark or len(TOKEN.findall(t, mark.end())) < 4:
            break
        t = t[mark.end() :]
    t = t.strip(QUOTES)
    if t[-1:] in ("…", "."):
        whole = CUT.sub("", t)
        return whole, whole != t
    return t, False


def words(title: str) -> tuple[list[str], str, bool]:
    """(words in lower case, kind of each, cut): n number, m month, N name, w plain word, ? first word or a headline in capitals."""
    t, cut = clean(title)
    toks = TOKEN.findall(t)
    inner = [x for x in toks[1:] if x[0].isalpha()]
    big = sum(x[0].isupper() for x in inner)
    flat = (len(inner) >= 3 and big >= 0.8 * len(inner)) or t.upper() == t or t.lower() == t
    kinds, low = [], [x.lower() for x in toks]
    for k, (x, y) in enumerate(zip(toks, low)):
        if x[0].isdigit():
            kinds.append("n")
        elif y in MONTHS and (y != "may" or flat or x[0].isupper()):
            kinds.append("m")
        elif flat or k == 0:
            kinds.append("?")
        else:
            kinds.append("N" if x[0].isupper() else "w")
    return low, "".join(kinds), cut


def slip(a: str, b: str) -> bool:
    """One spelling slip apart: two neighbours swapped, or a letter lost or put in."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3:
        return False
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :]


def replaced(a: str, b: str) -> bool:
    """One letter put for another in a long word."""
    return len(a) == len(b) >= 5 and sum(x != y for x, y in zip(a, b)) == 1


def _differ(x: str, kx: str, y: str, ky: str) -> int | None:
    """Cost of putting word y for x; None if that makes another headline."""
    if x == y:
        return 0
    kinds = {kx, ky}
    if kinds & {"n", "m", "N"}:
        return None
    if slip(x, y):
        return 0
    if "w" in kinds:
        return 0 if replaced(x, y) else 1
    return None


Line = tuple[list[str], str, bool]


def same_headline(a: Line, b: Line) -> bool:
    """Whether two headlines differ only by small edits; another name, figure or month makes another headline.

    Spelling slips cost nothing, a plain word put for another, lost or put in costs 1, and SWAPS are allowed. The answer
    is the same whichever headline comes first.
    """
    (x, kx, cx), (y, ky, cy) = a, b
    if cx != cy:
        if cy:
            (x, kx), (y, ky) = (y, ky), (x, kx)
        # x is the cut one: what it lost is no difference, but it must keep enough
        if len(x) < max(3, KEEP * len(y)):
            return False
        if len(y) > len(x):
            last, whole = x[-1], y[len(x) - 1]
            if last != whole and whole.startswith(last):
                x = [*x[:-1], whole]
            y, ky = y[: len(x)], ky[: len(x)]
    # names joined or parted, words run together
    if x == y or "".join(x) == "".join(y):
        return True
    if abs(len(x) - len(y)) > SWAPS:
        return False
    # least cost of turning one into the other; a way within the limit stays within SWAPS of the diagonal, and a row beyond it ends the search
    inf = SWAPS + 1
    gap = [1 if k == "w" else inf for k in ky]
    row = [0]
    for g in gap[:SWAPS]:
        row.append(row[-1] + g)
    row += [inf] * (len(y) + 1 - len(row))
    for i, (p, kp) in enumerate(zip(x, kx)):
        own = 1 if kp == "w" else inf
        new = [inf] * (len(y) + 1)
        if i < SWAPS:
            new[0] = row[0] + own
        for q in range(max(0, i - SWAPS), min(len(y), i + SWAPS + 1)):
            least = min(row[q + 1] + own, new[q] + gap[q])
            if row[q] < least and (d := _differ(p, kp, y[q], ky[q])) is not None:
                least = min(least, row[q] + d)
            new[q + 1] = least
        row = new
        if min(row) > SWAPS:
            return False
    return row[-1] <= SWAPS


@lru_cache(maxsize=200_000)
def _hash(w: str) -> int:
    return int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _mixed(rows: list[tuple[int, ...]], words: int) -> np.ndarray:
    """One key of 63 bits for each row of a salt and so many word hashes."""
    m = np.array(rows, dtype=np.uint64).reshape(len(rows), words + 1)
    k = np.full(len(rows), words * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for c in range(words + 1):
            k = (k ^ m[:, c]) * np.uint64(0xFF51AFD7ED558CCD)
            k ^= k >> np.uint64(29)
    return (k >> np.uint64(1)).astype(np.int64)


def _word_sets(toks: list[str], common: frozenset[str]) -> Iterator[tuple[int, ...]]:
    """Sets of word hashes of which two headlines share one if they share two telling words, or are at most EDITS words apart on either side.

    The least k of the words that two headlines share are among the first k + e of either, where e words of it are not
    shared; so pairs of the signature's entries are enough. A cut headline may have lost more than that, but nothing at
    its beginning, so a headline of more telling words has pairs of its first ones too. Headlines that share one telling
    word, or none, have few of them, all others being edited; what is left of EDITS bounds the edits of the common words
    that stand in for them, in order of place. Blanks stand in where those are few.
    """
    told = [_hash(w) for w in dict.fromkeys(toks) if w not in common]
    t = len(told)
    if t > 1:
        pairs = set(combinations(sorted(told)[:SIGNATURE], 2))
        if t > SIGNATURE:
            pairs |= {(a, b) if a < b else (b, a) for a, b in combinations(told[:SIGNATURE], 2)}
        yield from pairs
    if t <= EDITS + 1:
        rest = [_hash(w) for w in dict.fromkeys(toks) if w in common] + BLANKS
        if t:
            for x in combinations(rest[: 2 + EDITS + 1 - t], 2):
                x = (x[0], x[1]) if x[0] < x[1] else (x[1], x[0])
                yield from ((a, *x) for a in told)
        if t <= EDITS:
            yield from (tuple(sorted(x)) for x in combinations(rest[: REST + EDITS - t], REST))


def _salts(toks: list[str], kinds: str) -> set[str]:
    """Figures and months of the headline, and of each beginning that a cut version of it may be."""
    if "n" not in kinds and "m" not in kinds:
        return {""}
    least = max(2, ceil(KEEP * len(toks) - 1e-9) - 1)
    told = [w for w, c in zip(toks[:least], kinds) if c in "nm"]
    out = {" ".join(sorted(told))}
    for w, c in zip(toks[least:], kinds[least:]):
        if c in "nm":
            told.append(w)
            out.add(" ".join(sorted(told)))
    return out


def story_keys(lines: list[tuple[list[str], str]], common: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """(position of the headline, key) for headlines given as (words, kinds): sets of words (see ``_word_sets``) with the figures and months (see ``_salts``)."""
    rows: dict[int, list[tuple[int, ...]]] = {2: [], 3: [], REST: []}
    owner: dict[int, list[int]] = {n: [] for n in rows}
    for k, (toks, kinds) in enumerate(lines):
        if not toks:
            continue
        salts = [_hash(x) for x in _salts(toks, kinds)]
        for x in _word_sets(toks, common):
            n = len(x)
            for s in salts:
                rows[n].append((s, *x))
                owner[n].append(k)
    return np.concatenate([np.array(owner[n], dtype=np.int64) for n in rows]), np.concatenate([_mixed(rows[n], n) for n in rows])


def _spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [words(t) if t is not None and t.strip() else ([], "", False) for t in b["title"]]
        plain = [(" ".join(w) + (" …" if c else "")) if w else None for w, _, c in got]
        yield pd.DataFrame({"id": b["id"], "batch": b["batch"], "address": b["address"], "plain": plain, "kinds": [k for _, k, _ in got]})


def _keys(common: frozenset[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, key = story_keys([_row(p, k)[:2] for p, k in zip(b["plain"], b["kinds"])], common)
            yield pd.DataFrame({"key": key, "head": b["head"].to_numpy()[at]})

    return run


def _row(plain: str, kinds: str) -> Line:
    cut = plain.endswith("…")
    return plain[:-1].split() if cut else plain.split(), kinds, cut


#: Headline and the (batch, id) of the first record of one that is the same.
LINK = "head bigint, plain string, batch bigint, id bigint"


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ok = [same_headline(_row(p, kp), _row(q, kq)) for p, kp, q, kq in zip(b["pa"], b["ka"], b["pb"], b["kb"])]
        b = b.loc[np.array(ok, dtype=bool)]
        for x, y in (("a", "b"), ("b", "a")):
            yield pd.DataFrame({"head": b[x], "plain": b[f"p{x}"], "batch": b[f"t{y}"], "id": b[f"i{y}"]})


def _verify_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Of each headline of either block, the first record of those in the other that are the same: one row each, not all pairs."""
    x = [_row(p, k) for p, k in zip(left["plain"], left["kinds"])]
    y = [_row(p, k) for p, k in zip(right["plain"], right["kinds"])]
    to, tq = list(zip(left["batch"], left["record"])), list(zip(right["batch"], right["record"]))
    best: dict[tuple[int, str], tuple[int, int]] = {}
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            if p != q and same_headline(p, q):
                a, b = (left["id"].iat[i], left["plain"].iat[i]), (right["id"].iat[j], right["plain"].iat[j])
                best[a] = min(best.get(a, tq[j]), tq[j])
                best[b] = min(best.get(b, to[i]), to[i])
    return pd.DataFrame([(h, p, t, r) for (h, p), (t, r) in best.items()], columns=["head", "plain", "batch", "id"])


def common_words(heads: DataFrame) -> DataFrame:
    """(word) in at least COMMON of the distinct headlines (plain); their number is bounded by mean words / COMMON."""
    n = heads.count()
    w = heads.select(F.explode(F.array_distinct(F.split("plain", " "))).alias("word"))
    return w.groupBy("word").count().where(F.col("count") >= max(float(COMMON_LEAST), COMMON * n)).select("word")


#: Tables of the state: columns, and the one whose hash tells the bucket.
TABLES = {
    "addresses": ("address string, batch bigint, id bigint, attempt int", "address"),
    "headlines": ("head bigint, plain string, kinds string, batch bigint, id bigint, attempt int", "head"),
    "keys": ("key bigint, head bigint, attempt int", "key"),
}


@dataclass
class History:
    """A state folder, new or opened again.

    Rows carry the attempt that wrote them, and an attempt counts only when its mark is there: a batch that was broken off
    leaves nothing that is read, and is simply given again. ``common`` replaces the list of common words of a new state;
    ``buckets``, of a new state too, is by default the session's number of shuffle partitions.
    """

    spark: SparkSession
    path: str = ""
    common: frozenset[str] | None = None
    buckets: int = 0
    _attempts: Attempts = field(init=False)

    def __post_init__(self) -> None:
        self.path = self.path or new_path(self.spark, "history")
        self._attempts = Attempts(self.spark, self.path)
        made = folder_names(self.spark, f"{self.path}/shape")
        if made:
            self.buckets = int(made[0])
        else:
            self.buckets = self.buckets or shuffle_width(self.spark)
            make_folder(self.spark, f"{self.path}/shape/{self.buckets}")
        if folder_names(self.spark, f"{self.path}/common"):
            self.common = frozenset(r.word for r in self.spark.read.parquet(f"{self.path}/common").collect())
        elif self.common is not None:
            self._keep_common(self.spark.createDataFrame([(w,) for w in sorted(self.common)], "word string"))
        tag = blake2b(self.path.encode(), digest_size=8).hexdigest()
        self._names = {name: f"history_{tag}_{name}" for name in TABLES}
        for name, (columns, by) in TABLES.items():
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._names[name]} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self.spark.catalog.refreshTable(self._names[name])

    def _keep_common(self, words: DataFrame) -> None:
        words.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/common")

    def _old(self, name: str) -> DataFrame:
        """What finished batches wrote."""
        return self.spark.table(self._names[name]).where(self._attempts.done()).drop("attempt")

    def _append(self, df: DataFrame, name: str) -> DataFrame:
        """Writes this attempt's rows, one file per bucket, and reads them back."""
        by = TABLES[name][1]
        df.withColumn("attempt", F.lit(self._attempts.number)).repartition(self.buckets, by).write.insertInto(self._names[name])
        return self.spark.table(self._names[name]).where(F.col("attempt") == self._attempts.number).drop("attempt")

    def probe_and_append(self, records: DataFrame) -> DataFrame:
        """(id) of the ``records`` (id, batch, url, title) that bring an article already held; their new keys are appended.

        Earlier means smaller batch, or equal batch and smaller id, in the history or among ``records``. Null and blank
        addresses and headlines match nothing; a headline without words neither. Repeated records match the first of
        them. Batches may come in any order; only the given records are judged. An empty batch changes nothing. Other
        columns are ignored.
        """
        self._attempts.begin()
        order = F.struct("batch", "id")
        first = F.min(order).alias("f")
        told = F.length(F.regexp_replace("kinds", r"\?", ""))
        prep = records.select(F.col("id").cast("long"), F.col("batch").cast("long"), address_key(F.col("url")).alias("address"), "title")
        prep = prep.mapInPandas(_spell, "id bigint, batch bigint, address string, plain string, kinds string")
        prep = durable(prep.withColumn("head", F.when(F.col("plain").isNotNull(), F.xxhash64("plain"))), "records")
        # addresses: only those with more than one record, or an earlier one, are looked up again
        mine = prep.where("address is not null").groupBy("address").agg(first, F.count(F.lit(1)).alias("n"))
        mine = durable(mine.select("address", "f.*", "n"), "addresses")
        held = self._old("addresses").join(mine.select("address"), "address", "left_semi").groupBy("address").agg(first.alias("h"))
        at = mine.join(held, "address", "left").withColumn("o", F.least(order, F.coalesce("h", order))).where((F.col("n") > 1) | (F.col("h") < order))
        at = durable(at.select("address", "o"), "met")
        self._append(mine.drop("n"), "addresses")
        # headlines: one row per sequence of words; the spelling that tells most of its words' kinds speaks for it
        heads = prep.where("plain is not null").groupBy("head", "plain").agg(F.max_by("kinds", told).alias("kinds"), first, F.count(F.lit(1)).alias("n"))
        heads = durable(heads.select("head", "plain", "kinds", "f.*", "n"), "heads")
        if self.common is None:
            found = common_words(heads)
            self.common = frozenset(r.word for r in found.collect())
            if self.common:
                self._keep_common(self.spark.createDataFrame([(w,) for w in sorted(self.common)], "word string"))
        before = self._old("headlines")
        known = before.join(heads.select("head", F.col("plain").alias("p")), "head").where("plain = p").groupBy("head", "plain").agg(first.alias("h"), F.max(told).alias("t"))
        heads = durable(heads.join(known, ["head", "plain"], "left"), "known")
        fresh = heads.where("h is null")
        self._append(heads.where(F.col("h").isNull() | (order < F.col("h")) | (told > F.col("t"))).select("head", "plain", "kinds", "batch", "id"), "headlines")
        keys = self._append(fresh.select("head", "plain", "kinds").mapInPandas(_keys(self.common), "key bigint, head bigint"), "keys").distinct()
        # the held keys of the buckets that the new ones meet; both sides lie in buckets by key, so nothing is shuffled here
        own = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("head").alias("a"), F.max("head").alias("b"))
        met = self._old("keys").join(own.select("key"), "key", "left_semi").distinct()
        held = met.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("head").alias("c"), F.max("head").alias("d"))
        n = F.col("n") + F.coalesce("m", F.lit(0))
        counted = durable(own.join(held, "key", "left").where(n > 1).select("key", n.alias("n"), F.least("a", "c").alias("a"), F.greatest("b", "d").alias("b")), "counted")
        # two members are the pair itself; only larger groups are looked up again
        sizes = counted.where("n > 2").select("key", "n")
        some = durable(keys.join(sizes.select("key"), "key", "left_semi").unionByName(met.join(sizes.select("key"), "key", "left_semi")).select("key", F.col("head").alias("id")).distinct(), "members")
        pairs = durable(counted.where("n = 2 and a <> b").select("a", "b").unionByName(small_bucket_pairs(some, sizes)).distinct(), "pairs")
        lines = self.spark.table(self._names["headlines"]).where(self._attempts.done(also_now=True))
        line = lambda c: lines.select(F.col("head").alias(c), F.col("plain").alias(f"p{c}"), F.col("kinds").alias(f"k{c}"), F.col("batch").alias(f"t{c}"), F.col("id").alias(f"i{c}"))
        near = pairs.join(line("a"), "a").join(line("b"), "b").mapInPandas(_verify, LINK)
        hot = some.join(sizes.where(f"n > {WHOLE}").select("key"), "key", "left_semi").select(F.col("id").alias("head")).distinct()
        payload = lines.join(hot, "head").groupBy(F.col("head").alias("id"), "plain").agg(F.max_by("kinds", told).alias("kinds"), first).select("id", "plain", "kinds", F.col("f.batch").alias("batch"), F.col("f.id").alias("record"))
        near = near.unionByName(in_blocks(some, sizes, payload, _verify_block, LINK))
        near = durable(near.groupBy("head", "plain").agg(F.min(F.struct("batch", "id")).alias("near")), "near")
        heads = heads.join(near, ["head", "plain"], "left").withColumn("o", F.least("h", "near", order)).where((F.col("n") > 1) | (F.col("o") < order))
        me = F.struct("batch", "id")
        again = prep.where("address is not null").select("id", "batch", "address").join(at, "address").where(me > F.col("o")).select("id")
        said = prep.where("plain is not null").select("id", "batch", "head", "plain").join(heads.select("head", "plain", "o"), ["head", "plain"]).where(me > F.col("o")).select("id")
        out = durable(again.unionByName(said).distinct(), "found")
        self._attempts.finish()
        release(prep, mine, at, counted, some, pairs, near)
        return out
