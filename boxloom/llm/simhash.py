"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32.  Of two fingerprints that differ in at
most two bits, one segment differs in at most one, so the pair meets under a key made of that
segment with one bit struck out.  Each distinct fingerprint is indexed under its 64 keys; equal
keys are brought together and verified:

* keys with two fingerprints are verified from the aggregate alone (minimum and maximum);
* keys with up to ``BUCKET`` are gathered, verified against each other, and leave a spanning
  forest of their links, never all pairs;
* larger keys are not gathered.  Their members are indexed once more with two bits struck out
  of the whole fingerprint, over those bit pairs that vary within their keys.  All that share
  such a key are within two bits of each other, so each links to the smallest.

All three are exact, so no link is lost whatever the size of a group.  Copies of a fingerprint
meet in one aggregation before any of this.

Null and empty texts have fingerprint zero and link like any other.  Null ids get the component
of their fingerprint, whose id ignores nulls.  Repeated rows are kept.

``drop_near_copies`` is for corpora, where near means that the sets of five-word shingles have a
Jaccard similarity of 0.8 or more.  At that similarity a bit of a fingerprint flips with probability 0.15,
about ten of 64, so a bit index of two finds few such pairs.  It keeps the deletion variants but
makes them of symbols that flip less often: the signature is a row of min-wise symbols, two of which agree with
the probability of the similarity; it is cut into segments, each indexed with one symbol
struck out, and pairs that meet under a key are verified on their whole shingle sets.  Of pairs at 0.8,
98.6 % share a key, of pairs at 0.9 more than 99.98 %.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import checkpoint, marked, stored, text_or_empty
from .components import connected_components

SEED = 42
WORDS = 3
#: Fingerprints that one key may bring together in a list.
BUCKET = 512
#: What counts as near for ``drop_near_copies``.
NEAR_WORDS = 5
SIMILARITY = 0.8
#: Symbols of a signature, and of one segment of it.
SYMBOLS, SEGMENT = 24, 6
#: How many times more leaders of a key each round has, and after how many rounds keys with more than ``CROWD`` members are settled at once.
MORE, PARTED, CROWD = 2, 2, 16
#: Shingles that are known as common when a set is put in order, the rarest first; one of ``SPARSE`` documents is looked at for that.
COMMON, SPARSE = 1 << 16, 16
#: Parts into which the comparisons with one document are split.
SALTS = 64
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """The hash of every shingle of a text, in order; one of the whole sequence if it is shorter."""
    w = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        w, words = [b" ".join(w)], 1
    n = len(w) - words + 1
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False))), np.uint64, n)


def fingerprint(text: str, words: int = WORDS) -> int:
    """The unsigned fingerprint of a text; bits are counted a million shingles at a time."""
    hashes = shingle_hashes(text, words)
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 20):
        part = hashes[k : k + (1 << 20)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def shingle_set(text: str, words: int = NEAR_WORDS) -> np.ndarray:
    """The distinct shingle hashes, sorted; a text without words has the one shingle zero."""
    h = shingle_hashes(text, words)
    return np.unique(h) if len(h) else np.zeros(1, np.uint64)


def symbol_keys(h: np.ndarray) -> np.ndarray:
    """The one-wildcard keys of a shingle set's symbols.

    Shingles fall into ``SYMBOLS`` classes by their hash; the smallest of a class is its symbol, and
    an empty class borrows the symbol of the next one that has any.  Each segment of ``SEGMENT``
    symbols gives one key for each of them struck out.
    """
    classed = np.sort(h % np.uint64(SYMBOLS) << np.uint64(58) | h >> np.uint64(6))
    first = np.searchsorted(classed >> np.uint64(58), np.arange(SYMBOLS))
    has = np.append(classed, np.uint64(2**64 - 1))[first] >> np.uint64(58) == np.arange(SYMBOLS)
    full = np.flatnonzero(has)
    lender = full[np.searchsorted(full, np.arange(SYMBOLS)) % len(full)]
    place = np.arange(SYMBOLS, dtype=np.uint64)
    m = _mixed(classed[first[lender]] + place * _MIX).reshape(-1, SEGMENT)
    return _mixed((m.sum(axis=1, keepdims=True) - m).ravel() + place * _MIX).view(np.int64)


def rarest(h: np.ndarray, common: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """The rarest shingles of a sorted set, rarest first, and how many of them are enough beside a set that is not smaller.

    Near sets A, B share at least ``t / (1 + t) * (|A| + |B|)`` shingles, so, in one order for all, the first few of each have one in common: of A
    one more than |A| less that number, which is most for the smallest B (``t * |A|``), and less for B of the size of A.
    ``common`` has the common ones, the rarest first.  Any order serves; this one makes few sets meet.
    """
    n, t = len(h), similarity
    many, few = (n - int(np.ceil(t * (n + m) / (1 + t) - 1e-6)) + 1 for m in (t * n, n))
    if len(common):
        by_hash = np.argsort(common)
        at = by_hash[np.minimum(np.searchsorted(common, h, sorter=by_hash), len(common) - 1)]
        h = h[np.argsort(np.where(common[at] == h, at + 1, 0), kind="stable")]
    return h[:many], few


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _MIX
    return x ^ x >> np.uint64(29)


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series(np.array([fingerprint(t) for t in s], np.uint64).view(np.int64))


def _forest(buckets: pd.Series) -> pd.Series:
    """Links from each member to the smallest of its part of the bucket."""
    out = []
    for b in buckets:
        f = np.sort(np.asarray(b, np.int64))
        near = np.bitwise_count((f[:, None] ^ f[None, :]).view(np.uint64)) <= 2
        label = np.arange(len(f))
        while True:
            low = np.where(near, label[None, :], len(f)).min(axis=1)
            low = low[low]
            if (low == label).all():
                break
            label = low
        out.append([{"u": int(f[i]), "v": int(f[k])} for i, k in enumerate(label) if i != k])
    return pd.Series(out)


def _struck(fp: str = "fp"):
    """The 64 keys of a fingerprint: segment, struck bit, and what is left of the segment."""
    keys = []
    for seg in (0, 1):
        part = F.shiftrightunsigned(fp, 32 * seg).bitwiseAND(F.lit(0xFFFFFFFF))
        for bit in range(32):
            keys.append(part.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit))).bitwiseOR(F.lit((seg * 32 + bit) << 32)))
    return F.array(*keys)


def link_fingerprints(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints ``fp`` within two bits."""
    keys = fps.select("fp", F.explode(_struck()).alias("key"))
    full = checkpoint(
        keys.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"), F.bit_or("fp").alias("some"), F.bit_and("fp").alias("all"))
        .where("n > 1")
    )
    links = full.where("n = 2 and bit_count(u ^ v) <= 2").select("u", "v")
    small = full.where(F.col("n").between(3, bucket)).select("key")
    lists = keys.join(small, "key").groupBy("key").agg(F.collect_list("fp").alias("b"))
    links = links.unionByName(lists.select(F.explode(F.pandas_udf(_forest, "array<struct<u:long,v:long>>")("b")).alias("l")).select("l.*"))
    large = full.where(F.col("n") > bucket).select("key", F.expr("some ^ all").alias("vary"))
    if not large.isEmpty():
        vary = keys.join(large, "key").groupBy("fp").agg(F.bit_or("vary").alias("vary"))
        bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("vary", i) == 1)
        pairs = vary.select("fp", F.explode(bits).alias("i"), bits.alias("bits")).select("fp", "i", F.explode("bits").alias("j")).where("i <= j")
        mask = F.expr("shiftleft(1L, i) | shiftleft(1L, j)")
        cut = pairs.select("fp", "i", "j", F.col("fp").bitwiseAND(F.bitwise_not(mask)).alias("rest"))
        low = cut.groupBy("i", "j", "rest").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
        links = links.unionByName(cut.join(low, ["i", "j", "rest"]).where("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v")))
    return links.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id, text_hash, root.

    ``root`` is the smallest fingerprint of the component, which tells components apart whose
    smallest ids agree or are null.
    """
    text = text_or_empty(text_col)
    rows = checkpoint(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.pandas_udf(_fingerprints, "long")(text).alias("fp")))
    # each fingerprint becomes 64 keys, so the few bytes of this table must not end in few tasks
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fps = checkpoint(rows.groupBy("fp").agg(F.min("id").alias("low")).repartition(parts, "fp"))
    roots = connected_components(link_fingerprints(fps, bucket), "u", "v").withColumnRenamed("node", "fp")
    nodes = fps.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    groups = nodes.join(lows, "root").select("fp", "component_id", "root")
    return rows.join(groups, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash", "root"
    )


def near_pairs(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those (node, rep) whose shingle sets have the Jaccard similarity; ``sets`` has node, h.

    What is compared with one document is split by salt, and its set is sent to each salt once.
    """
    p = pairs.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    theirs = p.select("rep", "salt").distinct().join(sets.select(F.col("node").alias("rep"), F.col("h").alias("g")), "rep")
    both = p.join(sets, "node").join(theirs, ["rep", "salt"])
    common = F.size(F.array_intersect("h", "g"))
    return both.where(common >= F.lit(similarity) * (F.size("h") + F.size("g") - common) - 1e-9).select("node", "rep")


def _crowded_pairs(left: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (node, rep) of the members of crowded keys that may be near, by a prefix filter: the smaller set's few rarest shingles among the other's."""
    inside = stored(left.select("node", "order").distinct().join(sets, "node"))
    # what is common decides only in which order shingles are taken; any order is exact
    seen = inside.where(F.pmod(F.xxhash64("node"), F.lit(SPARSE)) == 0).select(F.explode("h").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    common = np.array([r.s for r in seen.orderBy(F.desc("n"), "s").limit(COMMON).collect()][::-1], np.int64)

    @F.pandas_udf("struct<rare:array<long>,few:int>")
    def rare(found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rarest(np.asarray(h, np.int64), common, similarity) for h in found], columns=["rare", "few"])

    size = F.struct(F.size("h").alias("n"), "node").alias("size")
    keys = inside.select("order", size, rare("h").alias("r")).select("order", "size", "r.few", F.posexplode("r.rare").alias("at", "key"))
    keys = stored(keys.withColumn("few", F.col("at") < F.col("few")))
    # most rare shingles are one document's own
    shared = keys.groupBy("key").agg(F.count("*").alias("m"), F.bool_or("few").alias("any")).where("m > 1 AND any").select("key")
    keys = stored(keys.join(shared, "key", "left_semi"))
    a, b = (keys.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("order", "size", "few")]) for s in "ab")
    met = a.where("a_few").join(b, "key").where((F.col("a_size") < F.col("b_size")) & (F.col("a_size.n") >= F.lit(similarity) * F.col("b_size.n") - 1e-6))
    met = met.select(F.least("a_order", "b_order").alias("low"), F.greatest("a_order", "b_order").alias("high"))
    return met.select(F.col("low.node").alias("node"), F.col("high.node").alias("rep")).distinct()


def _led(near: DataFrame) -> DataFrame:
    """The nodes of near pairs (node, rep) for which a rep stands for whom nobody does."""
    covered = None
    while not near.isEmpty():
        free = near.select("rep").join(near.select(F.col("node").alias("rep")), "rep", "left_anti").distinct()
        now = stored(near.join(free, "rep", "left_semi").select("node").distinct())
        covered = now if covered is None else covered.unionByName(now)
        near = stored(near.join(now, "node", "left_anti").join(now.withColumnRenamed("node", "rep"), "rep", "left_anti").select("node", "rep"))
    return covered


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = NEAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """id, hash (of the text), covered: whether another document that is near, and before it, stands for it.

    Documents that share a key are candidates.  Before others come those with more candidates, then
    smaller ids.  A round chooses leaders of each key, compares each with all later members of the key
    that nobody stands for yet, and takes the leaders out of the key.  There is one leader of a key at first, and ``MORE``
    times as many in each round after, so few rounds are left for keys with many that are not near.  After ``PARTED`` rounds
    the members of keys that still have more than ``CROWD`` meet under their rarest shingles instead, all at once: sets that are near share one of
    those (prefix filter), so no near pair is lost, and documents that have only common lines in common meet no more.  In the end
    of two documents that share a key and that nobody stands for none is near the other, and a
    chain of near documents leads from every covered one to one that is not.
    """
    text = text_or_empty(text_col)

    @F.pandas_udf("array<long>")
    def keys(texts: pd.Series) -> pd.Series:
        return pd.Series([symbol_keys(shingle_set(t, words)) for t in texts])

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, words).view(np.int64) for t in texts])

    rows = checkpoint(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), keys(text).alias("keys")).withColumn("node", F.monotonically_increasing_id()))
    members = rows.select("node", F.explode("keys").alias("key"))
    members = checkpoint(members.join(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
    candidates = stored(members.groupBy("node").agg(F.sum("n").alias("support")).join(rows.select("node", "id", "hash"), "node"))
    found = marked(docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__hash"), text.alias("__text")), candidates.select("hash"), "__hash", "__maybe")
    same = F.col("__id").eqNullSafe(F.col("id")) & (F.col("__hash") == F.col("hash"))
    # rows that agree in id and text match each other's nodes; one set for each node is enough
    sets = stored(found.where("__maybe").join(candidates, same).dropDuplicates(["node"]).select("node", hashes("__text").alias("h")))
    left = stored(members.join(candidates.select("node", F.struct("support", (-F.col("id")).alias("neg"), "node").alias("order")), "node").select("key", "node", "order"))
    covered, leaders = None, 1
    while True:
        if leaders == MORE**PARTED:
            crowded = stored(left.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("key"))
            if not crowded.isEmpty():
                pairs = stored(_crowded_pairs(left.join(crowded, "key", "left_semi"), sets, similarity))
                near = _led(stored(near_pairs(pairs, sets, similarity)))
                left = left.join(crowded, "key", "left_anti")
                if near is not None:
                    covered = near if covered is None else covered.unionByName(near)
                    left = left.join(near, "node", "left_anti")
                left = stored(left.select("key", "node", "order"))
        parted = left.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(leaders)))
        top = stored(parted.groupBy("key", "part").agg(F.max("order").alias("top")))
        # near documents share many keys: a node meets each leader once, however many keys they share
        lists = left.join(top.groupBy("key").agg(F.collect_list("top").alias("tops")), "key")
        met = lists.groupBy("node", "order").agg(F.array_distinct(F.flatten(F.collect_list("tops"))).alias("tops"))
        pairs = stored(met.select("node", F.explode(F.filter("tops", lambda x: x > F.col("order"))).alias("top")).select("node", F.col("top.node").alias("rep")))
        if pairs.isEmpty():
            break
        near = stored(near_pairs(pairs, sets, similarity).select("node").distinct())
        covered = near if covered is None else covered.unionByName(near)
        left = stored(parted.join(top, ["key", "part"]).where("order < top").select("key", "node", "order").join(near, "node", "left_anti"))
        leaders *= MORE
    if covered is None:
        return rows.select("id", "hash", F.lit(False).alias("covered"))
    return rows.join(covered.withColumn("covered", F.lit(True)), "node", "left").select("id", "hash", F.coalesce("covered", F.lit(False)).alias("covered"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = NEAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The input's rows and columns without the documents that ``near_copies`` finds covered.

    Rows that agree in id and text are copies, which stay or go together: an exact pass removes them.
    """
    found = near_copies(docs, id_col, text_col, words, similarity)
    gone = stored(found.groupBy(F.col("id").alias("__id"), F.col("hash").alias("__hash")).agg(F.bool_and("covered").alias("all")).where("all").drop("all"))
    rows = docs.withColumn("__text_hash", F.xxhash64(text_or_empty(text_col)))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash"))
    rows = marked(rows, gone.select("__hash"), "__text_hash", "__maybe")
    # most documents are not even compared with those that go
    stay = rows.where("not __maybe").unionByName(rows.where("__maybe").join(gone, same, "left_anti"))
    return stay.drop("__text_hash", "__maybe")
