"""Jaccard self-join on word shingles by token-combination prefixes.

1. Chunks of documents send every owner the sorted, compressed shingle hashes of its range and get back in how many
   documents each occurs, as a power of two.  Sets are ordered rarest first by that; the order is global, so prefix
   filtering is exact, and shingles that occur once use up the error budget without being indexed.
2. A prefix is extended until its signatures cannot all be lost within the budget: a shingle of a rare class is a
   signature by itself, one of a frequent class only with another of its bucket (c such shingles in a bucket survive
   c - 2 losses).  Buckets are as many as the size band of the sets needs, so signatures stay linear in the set.
3. Owners group equal signatures.  In each group every set is verified against the group's centre.  Two sets that are
   then still in different components and differ from the same centre can only be linked if they share some of these
   differences, so they meet through an index of differences, again rarest first and prefixes only.  Sets without a
   common centre meet in their groups, those outside the commonest component with all others.  A pair is left out only
   if sizes, shingles that no other set has, bitmaps of the sets or their differences rule a link out.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from watchtide.llm import common
from watchtide.operators.cluster import components

WORDS = 5
NUMERATOR, DENOMINATOR = 3, 4  # similarity of at least 3/4
FREQUENT = 6  # shingles in 2 ** FREQUENT or more sets are indexed in pairs
BITS = 1024  # of a set's bitmap
DIFFERENCE = 512  # shingles by which a set may differ from its centre to have them listed
CHUNK_BYTES = 8 << 20  # text of a chunk, about
KNOWN_WORDS = 500_000

_K = np.uint64(0x9E3779B97F4A7C15)
_LINE = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _LINE[0]
    x = (x ^ (x >> np.uint64(27))) * _LINE[1]
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


@lru_cache(maxsize=1)
def worker_words() -> Words:
    """The word hashes of this Python worker, kept from task to task."""
    return Words()


def rolling(parts: list[bytes], size: int, words: Words) -> np.ndarray:
    """64-bit hashes of every run of ``size`` words, in order, put together from runs of powers of two."""
    n = len(parts) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run, length = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts)), 1
    total, done, left = None, 0, size
    while left:
        if left & 1:
            piece = run[done:done + n]
            total = piece.copy() if total is None else total * _power(length) + piece
            done += length
        left >>= 1
        if left:
            run = run[:-length] * _power(length) + run[length:]
            length *= 2
    return _mix(total + np.uint64(size * int(_LINE[1]) % (1 << 64)))


def _power(length: int) -> np.uint64:
    return np.uint64(pow(int(_K), length, 1 << 64))


def shingles(text: str, words: Words, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than one shingle has are one shingle."""
    parts = text.encode("utf-8", "replace").lower().split()
    return common.distinct(rolling(parts, min(size, len(parts)), words)) if parts else np.zeros(0, np.uint64)


def set_id(tokens: np.ndarray) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(tokens.tobytes())], np.uint64).view(np.int64)[0])


def budget(n: int) -> int:
    """Shingles of a set of ``n`` that may be missing from a linked set."""
    return n - -(-NUMERATOR * n // DENOMINATOR)


def band(n: int) -> int:
    """Size bands grow by the ratio that sizes of linked sets may have, so these lie in one band or two neighbours."""
    return int(np.log(n) / np.log(DENOMINATOR / NUMERATOR) + 1e-9)


def buckets(of_band: int) -> int:
    return max(1, int((DENOMINATOR / NUMERATOR) ** of_band) // 16)


def signatures(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Signatures of a set from its shingles and their frequency classes (0: in this set alone)."""
    n = len(tokens)
    if n < 2:
        return np.zeros(0, np.uint64)  # only an equal set can be linked
    order = np.lexsort((tokens, classes))
    tokens, classes, need = tokens[order], classes[order], budget(n) + 1
    rare = int(np.searchsorted(classes, FREQUENT))
    ahead = min(rare, need)
    found = [_mix(tokens[:ahead][classes[:ahead] > 0] + _K)]
    if rare < need:
        often = tokens[rare:]
        for table in (band(n), band(n) - 1):  # a pair is found in the table of its smaller set
            place = (_mix(often ^ _LINE[0]) % np.uint64(buckets(table))).astype(np.int64)
            first = np.zeros(len(often), bool)
            first[np.unique(place, return_index=True)[1]] = True
            upto = int(np.searchsorted(np.cumsum(~first), need - rare)) + 1
            members = np.argsort(place[:upto], kind="stable")
            place, own = place[:upto][members], often[:upto][members]
            for lag in range(1, upto):
                same = place[lag:] == place[:-lag]
                if not same.any():
                    break
                a, b = own[:-lag][same], own[lag:][same]
                found.append(_mix(np.minimum(a, b) * _K + np.maximum(a, b) * _LINE[0] + np.uint64(table + 2)))
    return common.distinct(np.concatenate(found))


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """BITS bits as longs, one of which each shingle sets."""
    bits = np.zeros(BITS, np.uint8)
    bits[(tokens >> np.uint64(20)) % np.uint64(BITS)] = 1
    return np.packbits(bits).view(np.int64)


def owned(values: np.ndarray, bits: int, owners: int) -> Iterator[tuple[int, slice, np.ndarray]]:
    """Owner, place and offsets inside the owner's range, for sorted values of ``bits`` bits."""
    span = -(-(1 << bits) // owners)
    owner = (values // np.uint64(span)).astype(np.int64)
    edges = np.flatnonzero(np.diff(owner, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(values)]):
        yield int(owner[a]), slice(int(a), int(b)), values[a:b] - np.uint64(int(owner[a]) * span)


def _sets(texts: pd.Series) -> Iterator[np.ndarray]:
    words = worker_words()
    for text in texts:
        yield shingles(text, words)


def frequencies(chunked: DataFrame, bits: int, owners: int, sets: Callable[[pd.Series], Iterator[np.ndarray]] = _sets,
                copies: int = 1) -> DataFrame:
    """Answers (chunk, owner, classes) to the distinct hashes that the chunks sent, in their order: the rounded-down
    logarithm of the number of sets that hold each.  Equal sets of a chunk count up to ``copies`` times.
    """
    span, shift = -(-(1 << bits) // owners), np.uint64(64 - bits)

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, lists = {}, []
        for s in sets(pdf["text"]):
            if len(s):
                key = set_id(s)
                seen[key] = seen.get(key, 0) + 1
                if seen[key] <= copies:
                    lists.append(s >> shift)
        rows, chunk = [], int(pdf["chunk"].iloc[0])
        if lists:
            for owner, _, offsets in owned(np.sort(np.concatenate(lists)), bits, owners):
                width = common.rice_width(span, len(offsets))
                rows.append((chunk, owner, len(offsets), width, common.rice_encode(offsets, width)))
        return pd.DataFrame(rows, columns=["chunk", "owner", "n", "width", "blob"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [common.rice_decode(b, n, w) for b, n, w in zip(pdf["blob"], pdf["n"], pdf["width"])]
        every, times = common.counted(np.concatenate(lists))
        classes = np.log2(times).astype(np.uint8)
        return pd.DataFrame({"chunk": pdf["chunk"], "owner": pdf["owner"],
                             "classes": [zlib.compress(classes[np.searchsorted(every, common.distinct(x))].tobytes(), 1) for x in lists]})

    sent = chunked.groupBy("chunk").applyInPandas(send, "chunk long, owner int, n int, width int, blob binary")
    return sent.groupBy("owner").applyInPandas(answer, "chunk long, owner int, classes binary")


def classes_of(every: np.ndarray, bits: int, owners: int, replies: pd.DataFrame) -> np.ndarray:
    """The answered classes of a chunk's sorted distinct hashes."""
    known = dict(zip(replies["owner"], replies["classes"]))
    parts = [np.frombuffer(zlib.decompress(known[o]), np.uint8) for o, _, _ in owned(every, bits, owners)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


# one table with three kinds of rows: documents (kind 0, the digest as text if asked for), signature blocks (1), texts of indexed sets (2)
INDEXED = "kind int, doc_id string, set_id long, n int, text string, owner int, width int, blob binary, members binary, bits array<long>"


def index(chunked: DataFrame, answers: DataFrame, bits: int, sig_bits: int, owners: int) -> DataFrame:
    span, shift, sig_shift = -(-(1 << sig_bits) // owners), np.uint64(64 - bits), np.uint64(64 - sig_bits)
    columns = [c.split()[0] for c in INDEXED.split(", ")]
    blank = (None,) * 6

    def run(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        sets = list(_sets(pdf["text"]))
        ids = [set_id(s) if len(s) else None for s in sets]
        digests = pdf["sha"] if "sha" in pdf else [None] * len(pdf)
        rows = [(0, d, i, len(s), sha, *blank[:5]) for d, i, s, sha in zip(pdf["doc_id"], ids, sets, digests)]
        distinct = {i: k for k, i in enumerate(ids) if i is not None}
        if distinct:
            every = common.distinct(np.concatenate([sets[k] for k in distinct.values()]) >> shift)
            classes = classes_of(every, bits, owners, replies)
            texts, sigs, holders, shared = pdf["text"].to_numpy(), [], [], {}
            for i, k in distinct.items():
                of_set = classes[np.searchsorted(every, sets[k] >> shift)]
                own = common.distinct(signatures(sets[k], of_set) >> sig_shift)
                if len(own):
                    shared[k] = int(np.count_nonzero(of_set))
                    rows.append((2, None, i, len(sets[k]), texts[k], *blank[:4], bitmap(sets[k])))
                    sigs.append(own)
                    holders.append(np.full(len(own), k))
            if sigs:
                sigs, holders = np.concatenate(sigs), np.concatenate(holders)
                order = np.argsort(sigs, kind="stable")
                sigs, holders = sigs[order], holders[order]
                for owner, place, offsets in owned(sigs, sig_bits, owners):
                    width, (who, which) = common.rice_width(span, len(offsets)), np.unique(holders[place], return_inverse=True)
                    head = np.array([len(who)], "<i4").tobytes() + np.array([ids[k] for k in who], "<i8").tobytes() + np.array(
                        [(len(sets[k]), shared[k]) for k in who], "<i4").tobytes() + which.astype("<u2" if len(who) < 1 << 16 else "<u4").tobytes()
                    rows.append((1, None, None, len(offsets), None, owner, width, common.rice_encode(offsets, width), head, None))
        whole = {"kind", "set_id", "n", "owner", "width"}  # pandas would make floats of integers beside nulls
        return pd.DataFrame({c: pd.array(v, "Int64") if c in whole else pd.Series(v, dtype=object) for c, v in zip(columns, zip(*rows))})

    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(run, INDEXED)


def stars(n: np.ndarray, shared: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Place of the centre of each row, for rows sorted by set size inside groups that begin at ``starts``.

    A group is cut into stretches of sizes that linked sets may have.  The centre of a stretch is the set with the
    largest share of shingles that other sets have as well: of near copies that is the one with the fewest changes.
    """
    first = np.repeat(starts, np.diff([*starts, len(n)]))
    while True:
        beyond = NUMERATOR * n > DENOMINATOR * n[first]
        if not beyond.any():
            break
        rows = np.flatnonzero(beyond)  # the ends of their groups, where the next stretch begins at the first of them
        new = np.r_[True, (np.diff(rows) > 1) | (first[rows][1:] != first[rows][:-1])]
        first[rows] = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
    order = np.lexsort((np.arange(len(n)), -shared / np.maximum(n, 1), first))
    opens = np.flatnonzero(np.r_[True, first[order][1:] != first[order][:-1]]) if len(n) else starts
    return np.repeat(order[opens], np.diff([*opens, len(n)]))  # stretches lie in order, one after the other


def groups(blocks: DataFrame) -> DataFrame:
    """(gid, member, n, shared, centre): distinct groups of two or more sets with an equal signature."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sigs, members, sizes = [], [], []
        for count, width, blob, head in zip(pdf["n"], pdf["width"], pdf["blob"], pdf["members"]):
            m = int(np.frombuffer(head, "<i4", 1)[0])
            which = np.frombuffer(head, "<u2" if m < 1 << 16 else "<u4", count, 4 + 16 * m)
            sigs.append(common.rice_decode(blob, int(count), int(width)))
            members.append(np.frombuffer(head, "<i8", m, 4)[which])
            sizes.append(np.frombuffer(head, "<i4", 2 * m, 4 + 8 * m).reshape(-1, 2)[which])
        sig, member, size = np.concatenate(sigs), np.concatenate(members), np.concatenate(sizes)
        order = np.lexsort((member, size[:, 0], sig))
        sig, member, size = sig[order], member[order], size[order]
        keep = np.r_[True, (sig[1:] != sig[:-1]) | (member[1:] != member[:-1])]  # copies in several chunks
        sig, member, size = sig[keep], member[keep], size[keep]
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        times = np.diff([*starts, len(sig)])
        gid = np.add.reduceat(_mix(member.view(np.uint64)), starts) + times.astype(np.uint64)
        chosen = np.zeros(len(starts), bool)
        chosen[np.unique(gid, return_index=True)[1]] = True
        chosen &= times > 1
        rows = np.repeat(chosen, times)
        member, n, shared, times, gid = member[rows], size[rows, 0].astype(np.int64), size[rows, 1].astype(np.int64), times[chosen], gid[chosen]
        if not len(times):
            return pd.DataFrame({"gid": [], "member": [], "n": [], "shared": [], "centre": []}).astype("int64")
        centre = member[stars(n, shared, np.r_[0, np.cumsum(times)[:-1]])]
        return pd.DataFrame({"gid": np.repeat(gid.view(np.int64), times), "member": member, "n": n, "shared": shared, "centre": centre})

    # equal sets in several chunks may differ in ``shared`` where hashes of one chunk only are counted there
    found = blocks.groupBy("owner").applyInPandas(run, "gid long, member long, n int, shared int, centre long")
    return found.groupBy("gid", "member").agg(F.max("n").alias("n"), F.max("shared").alias("shared"), F.min("centre").alias("centre"))


def may_link(n_a: str, shared_a: str, n_b: str, shared_b: str) -> Column:
    """Whether sizes, and shingles that any other set has, allow a link: 7 common >= 3 (n_a + n_b)."""
    whole = NUMERATOR + DENOMINATOR
    return (DENOMINATOR * F.least(n_a, n_b) >= NUMERATOR * F.greatest(n_a, n_b)) & (
        whole * F.least(shared_a, shared_b) >= NUMERATOR * (F.col(n_a) + F.col(n_b)))


def may_overlap(n_a: str, bits_a: str, n_b: str, bits_b: str) -> Column:
    """Whether the bitmaps allow a link: a bit that only one of two sets has stands for a shingle that only it has."""
    room = F.floor((NUMERATOR * (F.col(n_a) + F.col(n_b)) + NUMERATOR + DENOMINATOR - 1) / (NUMERATOR + DENOMINATOR))  # least overlap

    def only(x: str, y: str) -> Column:
        return reduce(add, (F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(BITS // 64)))
    return (only(bits_a, bits_b) <= F.col(n_a) - room) & (only(bits_b, bits_a) <= F.col(n_b) - room)


def verify(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids with ``linked``, and how b differs from a: hashes of ``lost`` and ``new`` shingles.

    Differences of more than DIFFERENCE shingles are left null, and those whose lost or new shingles' shortened hashes
    are not all distinct: these would count as fewer common shingles than there are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, known = worker_words(), OrderedDict()

        def tokens(key: int, text: str) -> np.ndarray:
            found = known.get(key)
            if found is None:
                if len(known) > 500:
                    known.popitem(last=False)
                known[key] = found = shingles(text, words)
            return found

        def short(x: np.ndarray) -> np.ndarray:
            return (x >> np.uint64(32)).astype(np.uint32).view(np.int32)

        for pdf in batches:
            rows = []
            for a, b, text_a, text_b in zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"]):
                x, y = tokens(a, text_a), tokens(b, text_b)
                lost, new = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                both = len(x) - len(lost)
                gone, some = short(lost), short(new)
                near = len(lost) + len(new) <= DIFFERENCE and all(len(common.distinct(h)) == len(h) for h in (gone, some))
                rows.append((a, b, DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both), gone if near else None, some if near else None))
            yield pd.DataFrame(rows, columns=["a", "b", "linked", "lost", "new"])

    left = bodies.select(F.col("member").alias("a"), F.col("text").alias("text_a"))
    right = bodies.select(F.col("member").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInPandas(
        run, "a long, b long, linked boolean, lost array<int>, new array<int>")


def differences(tried: DataFrame, sizes: DataFrame) -> DataFrame:
    """(of, ctr, n_ctr, lost, new): how each set differs from the centre that most sets were verified against."""
    often = tried.groupBy("a").agg(F.count("*").alias("k"))
    none = F.array().cast("array<int>")
    rows = tried.where("lost IS NOT NULL").select("a", "b", "lost", "new").unionByName(
        often.select("a", F.col("a").alias("b"), none.alias("lost"), none.alias("new")))
    best = rows.join(often, "a").groupBy("b").agg(F.max_by(F.struct("a", "lost", "new"), F.struct("k", "a")).alias("m"))
    return best.select(F.col("b").alias("of"), F.col("m.a").alias("ctr"), "m.lost", "m.new").join(
        sizes.select(F.col("a").alias("ctr"), F.col("n_a").alias("n_ctr")), "ctr")


def may_differ() -> Column:
    """Whether the differences of x and y from one centre allow a link: common = centre - (lost by either) + (new in both).

    Hashes of two sets that meet by chance make the left side larger, never smaller; those of one set's new shingles
    are distinct.
    """
    common_ = F.col("n_ctr_x") - F.size(F.array_union("lost_x", "lost_y")) + F.size(F.array_intersect("new_x", "new_y"))
    return F.when(F.col("ctr_x") == F.col("ctr_y"), (NUMERATOR + DENOMINATOR) * common_ >= NUMERATOR * (F.col("n_x") + F.col("n_y"))).otherwise(True)


def through_differences(facts: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that differ from the same centre, lie in different components and may be linked.

    ``facts`` are the sets with how they differ from a centre they were verified against, ``found`` all components.
    With L lost and N new shingles a set x has weight w(x) = 4 L + 3 N - |c| / 2; it is linked with the centre c where
    4 L + 3 N <= |c|, and x with y where they share at least (w(x) + w(y)) / 7 differences.  Sets linked with c share
    its component, so one set of a pair, the outsider, is not linked with c: 4 L + 3 N > |c|.  Hence

    * any set shares more than (4 L + 3 N) / 7 of its differences with an outsider that it is linked with,
    * an outsider shares at least (4 L + 3 N - |c|) / 7 of its own, and more than none.

    With differences in one order, rarest of the centre first, the two sets meet in the prefixes that these counts leave.
    """
    whole = NUMERATOR + DENOMINATOR
    sets = facts.where("ctr IS NOT NULL").select("member", "ctr", "n_ctr", "lost", "new").join(
        found.select(F.col("id").alias("member"), "component"), "member").join(
        found.select(F.col("id").alias("ctr"), F.col("component").alias("of_ctr")), "ctr")
    sets = common.staged(sets.withColumn("outside", F.col("component") != F.col("of_ctr")), "ngram-sets")
    sets = sets.join(sets.where("outside").select("ctr").distinct(), "ctr", "left_semi")  # centres that all are linked with need no index
    weight = DENOMINATOR * F.size("lost") + NUMERATOR * F.size("new")
    tokens = F.concat(F.transform("lost", lambda e: 2 * e.cast("long")), F.transform("new", lambda e: 2 * e.cast("long") + 1))
    rows = sets.select("ctr", "member", "component", "outside", (F.size("lost") + F.size("new")).alias("size"),
                       (F.floor(weight / whole) + 1).alias("least"),
                       F.greatest(F.lit(1), F.ceil((weight - F.col("n_ctr")) / whole)).alias("least_outside"), F.explode(tokens).alias("token"))
    often = rows.groupBy("ctr", "token").agg(F.count("*").alias("times")).where("times > 1")
    of_set = Window.partitionBy("member")
    # differences that no other set has come first: they use up the prefix without being indexed
    ranked = rows.join(often, ["ctr", "token"]).withColumn(
        "place", F.col("size") - F.count("*").over(of_set) + F.row_number().over(of_set.orderBy("times", "token")))

    def inside(least: str) -> Column:
        return F.col("place") <= F.col("size") - F.col(least) + 1
    ranked = ranked.select("ctr", "token", "member", "component", (F.col("outside") & inside("least_outside")).alias("asks"), inside("least").alias("answers"))
    ranked = common.staged(ranked.where("asks OR answers"), "ngram-prefixes")
    x = ranked.where("asks").select("ctr", "token", F.col("member").alias("x"), F.col("component").alias("component_x"))
    y = ranked.where("answers").select("ctr", "token", F.col("member").alias("y"), F.col("component").alias("component_y"))
    return x.join(y, ["ctr", "token"]).where("component_x <> component_y").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES,
         digests: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: the smallest id reachable over links of similarity 3/4 or more.

    With ``digests`` also (text_sha256, component_sha256): the row's own digest, and the smallest one among the texts of
    the component that have the id ``component_id``.

    Null, empty and blank texts have no shingles and are linked with nothing; equal sets are linked.  A null id never
    names a component that has another id.  An empty table gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = common.texts_of(docs, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    chunks = max(common.shuffle_partitions(spark), -(-size // chunk_bytes))
    owners = common.owners_for(spark, size // 6, 1 << 22)
    bits = min(60, max(20, int(np.log2(size + 1)) + 6))  # one in some hundred shingles shares its hash by chance
    chunked = texts.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), F.col("doc_id").cast("string").alias("doc_id"), "text",
                           *([F.sha2("text", 256).alias("sha")] if digests else []))
    made = common.staged(index(chunked, frequencies(chunked, bits, owners), bits, min(62, bits + 12), owners), "ngram-index")

    rows = made.where("kind = 0").select(F.col("doc_id").cast("long").alias("doc_id"), "set_id", "n", F.col("text").alias("sha"))
    bodies = made.where("kind = 2").groupBy(F.col("set_id").alias("member")).agg(
        F.any_value("text").alias("text"), F.any_value("bits").alias("bits"))
    bodies = common.staged(bodies, "ngram-bodies")
    grouped = common.staged(groups(made.where("kind = 1").select("owner", "n", "width", "blob", "members")), "ngram-groups")

    of_centre = grouped.select(F.col("member").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("shared_a")).distinct()
    tried = grouped.where("member <> centre").select(F.col("centre").alias("a"), F.col("member").alias("b"), "n", "shared").distinct()
    tried = common.staged(tried.join(of_centre, "a").where(may_link("n_a", "shared_a", "n", "shared")).select("a", "b"), "ngram-tried")
    # sets that cannot be linked with any of their centres: one is looked at all the same, for the differences
    often = tried.groupBy("a").agg(F.count("*").alias("k"))
    alone = grouped.where("member <> centre").select("member", "centre").distinct().join(
        tried.select(F.col("b").alias("member")).distinct(), "member", "left_anti").join(often, F.col("centre") == F.col("a"), "left")
    alone = alone.groupBy(F.col("member").alias("b")).agg(F.max_by("centre", F.struct(F.coalesce("k", F.lit(0)), "centre")).alias("a"))
    tried = common.staged(tried.unionByName(alone), "ngram-pairs")
    verified = common.staged(verify(tried, bodies), "ngram-verified")
    links = verified.where("linked").select("a", "b")
    nodes = grouped.select(F.col("member").alias("id"))
    found = common.staged(components(nodes, links), "ngram-components")

    facts = grouped.select("member", "n").distinct().join(bodies.select("member", "bits"), "member")
    facts = facts.join(differences(verified, of_centre), F.col("member") == F.col("of"), "left").drop("of")
    facts = common.staged(facts, "ngram-facts")
    # groups that still hold different components: the sets outside the commonest one against those with another centre
    placed = common.staged(grouped.select("gid", "member", "n", "shared").join(found, F.col("member") == F.col("id")).drop("id"), "ngram-placed")
    counts = placed.groupBy("gid", "component").agg(F.count("*").alias("k"))
    most = counts.groupBy("gid").agg(F.max(F.struct("k", "component")).alias("most"), F.count("*").alias("kinds")).where("kinds > 1")
    placed = placed.join(most.select("gid", F.col("most.component").alias("common")), "gid").join(facts.select("member", "ctr"), "member")
    centres = placed.groupBy("gid").agg(F.min("ctr").alias("low"), F.max("ctr").alias("high"), F.count("ctr").alias("k"), F.count("*").alias("all"))
    placed = placed.join(centres.where("low IS NULL OR low < high OR k < all").select("gid"), "gid", "left_semi")
    placed = common.staged(placed, "ngram-mixed")
    names = [c for c in placed.columns if c != "gid"]
    one = placed.where("component <> common").select("gid", *[F.col(c).alias(f"{c}_x") for c in names])
    two = placed.select("gid", *[F.col(c).alias(f"{c}_y") for c in names])
    across = one.join(two, "gid").where(
        (F.col("component_x") != F.col("component_y"))
        & F.coalesce(F.col("ctr_x") != F.col("ctr_y"), F.lit(True))
        & ((F.col("component_y") == F.col("common_y")) | (F.col("member_x") < F.col("member_y")))  # two outsiders meet once
        & may_link("n_x", "shared_x", "n_y", "shared_y"))
    # near copies share many groups: a pair is made one before bitmaps and differences are looked at
    across = across.select(F.least("member_x", "member_y").alias("a"), F.greatest("member_x", "member_y").alias("b")).unionByName(
        through_differences(facts, found)).distinct()
    both_ways = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    across = common.staged(across.join(both_ways, ["a", "b"], "left_anti"), "ngram-across")
    for key, mark in (("a", "x"), ("b", "y")):
        across = across.join(facts.select(*[F.col(c).alias(key if c == "member" else f"{c}_{mark}") for c in facts.columns]), key)
    across = across.where(may_overlap("n_x", "bits_x", "n_y", "bits_y") & may_differ()).select("a", "b")
    more = common.staged(verify(across, bodies).where("linked").select("a", "b"), "ngram-links")
    if more.limit(1).count():
        found = components(nodes, more.unionByName(found.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))))

    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha") if digests else F.col("doc_id")
    firsts = rows.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min(own).alias("first"))
    firsts = firsts.join(found.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    names = firsts.groupBy("component").agg(F.min("first").alias("name"))
    named = common.staged(firsts.join(names, "component").select(F.col("set_id").alias("of"), "name"), "ngram-names")
    found = rows.join(named, F.col("set_id") == F.col("of"), "left").withColumn("name", F.when(F.col("set_id").isNull(), own).otherwise(F.col("name")))
    return found.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), (F.col("name.doc_id") if digests else F.col("name")).alias("component_id"),
        *([F.col("sha").alias("text_sha256"), F.col("name.sha").alias("component_sha256")] if digests else []))
