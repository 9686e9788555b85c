"""Near-duplicate join on word n-grams by parity sketches, with components of linked documents.

A document is the set of its distinct word n-grams; equal sets are one class. Members of a set are hashed
into segments, and a segment's sign is the XOR of its members' hashes, so a member that only one of two sets
has changes one segment: the Hamming distance of two sketches, counted in segments or in bits of a parity
bitmap, is never above the symmetric difference. Similarity bounds that difference by sizes, so sizes fall
into bands (powers of two, and a band around each power for pairs on both sides of it), each with more
segments than the difference can touch. A set offers its first segments that are not empty, one more than the
difference can touch: by the pigeonhole two similar sets agree on one of the first of the set that needs the shorter
row of them, and the other offers it too. Sketches are joined on (band, segment, sign). A set whose members leave no segment to spare also
offers its empty segments.

Candidates are verified on the sets themselves. Not all pairs in a group of near copies are looked at,
only what the components need: first each class with the most central class it shares a segment with (the
one whose segments are shared most), then what is left between different components, by bitmap distance,
nearest first, and at last every pair of different components whose bitmaps allow a link. That is done on one
sixth of the keys, then on a third and on the others, where pairs that share a key of a turn before are passed over: a
pair of near copies shares very many keys and would be found at each. So no link that would join two components
is lost, and no candidates are capped.

Only classes that share a segment are read again for their sets. Their ids are broadcast if they are few
(``BROADCAST_IDS``), else joined by shuffle.

Defined results: a null or blank text has no n-grams and is linked with nothing; a text of fewer words than
n is one n-gram; documents of a class are one component; null ids are told apart by row and give a null
component only among themselves; repeated rows give a row each; an empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.common import Workspace, bounded_batches, fresh, numbered, portions, starts_of
from casewright.llm.components import components

#: Ids broadcast at most (16 bytes each and the table around them).
BROADCAST_IDS = 500_000
#: Turns: the keys up to which share of twelve belong to each; pairs that share several keys are met in an early one, and not again.
TURNS = (2, 6, 12)
#: Rows of a block of one key's classes that one task compares.
BLOCK = 4096
#: Parts in which all keys are looked through for those that two classes share: one part's shuffle files go before the next are written.
PARTS = 4
#: Classes up to which one part is enough, in every turn.
ONE_PART = 100_000
#: Bytes of texts whose sets are in a Python worker's memory at a time, about.
PORTION = 1 << 18

_U = np.uint64


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Sizes:
    """What the threshold (``percent`` of the union) says about sizes, bands and segments."""

    def __init__(self, percent: int):
        self.percent = percent

    def apart(self, total):
        """The largest symmetric difference of two similar sets whose sizes sum to ``total``."""
        return (100 - self.percent) * total // (100 + self.percent)

    def segments(self, k: int) -> int:
        """More than ``k``, with room for empty ones."""
        return 1 if k == 0 else -(-6 * (k + 1) // 5) + 6

    def bands(self, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each of a set's (up to three) bands: number or -1, difference allowed, segments."""
        power = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
        low = np.left_shift(1, power)
        k = self.apart(2 * (2 * low - 1))
        yield np.where(n > 0, 2 * power, -1), k, self._segments(k)
        for edge, p in ((low, power), (2 * low, power + 1)):  # bands around the powers below and above
            least, most = -(-self.percent * edge // 100), (edge - 1) * 100 // self.percent
            k = self.apart(edge - 1 + most)
            yield np.where((n > 0) & (least <= n) & (n <= most) & (least < edge) & (most >= edge), 2 * p + 1, -1), k, self._segments(k)

    def _segments(self, k: np.ndarray) -> np.ndarray:
        return np.where(k == 0, 1, -(-6 * (k + 1) // 5) + 6)

    def bits(self, n: np.ndarray) -> np.ndarray:
        """Bits of a set's bitmap: a power of two of 64 or more, 8 to 16 for each difference allowed."""
        k = np.maximum(8, self.apart(2 * np.maximum(n, 1)))
        return np.left_shift(8, np.ceil(np.log2(k)).astype(np.int64))


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams, one text after another, and their numbers."""
    cut = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    n = np.fromiter(map(len, cut), np.int64, len(cut))
    code, vocabulary = numbered([w for row in cut for w in row])
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), _U, len(vocabulary))
    flat, at = (hashes[code] if len(code) else np.zeros(0, _U)), starts_of(n)
    factors = [_U(int(x) | 1) for x in mixed(np.arange(words, dtype=_U), 7)]
    whole = np.zeros(max(0, len(flat) - words + 1), _U)
    for j in range(words):
        whole += flat[j : j + len(whole)] * factors[j]
    whole = mixed(whole)
    out = []
    for i, size in enumerate(n.tolist()):
        if size >= words:
            out.append(np.unique(whole[at[i] : at[i + 1] - words + 1]))
        elif size:
            short = sum((flat[at[i] + j : at[i] + j + 1] * factors[j] for j in range(size)), np.zeros(1, _U))
            out.append(mixed(short, 100 + size))
        else:
            out.append(np.zeros(0, _U))
    return (np.concatenate(out) if out else np.zeros(0, _U)), np.fromiter(map(len, out), np.int64, len(out))


def sketches(flat: np.ndarray, n: np.ndarray, sizes: Sizes, seed: int) -> tuple[np.ndarray, np.ndarray, list, list]:
    """Class hashes (two of 64 bits), segment keys and bitmap of each set."""
    at, full = starts_of(n), np.flatnonzero(n)
    node, check = np.zeros(len(n), _U), np.zeros(len(n), _U)
    if len(full):
        node[full] = np.add.reduceat(mixed(flat, 20 + seed), at[full])
        check[full] = np.bitwise_xor.reduceat(mixed(flat, 40), at[full])
    row = np.repeat(np.arange(len(n)), n)
    sign, high = mixed(flat, 60), flat >> _U(32)
    keys: list[list] = [[] for _ in n]
    for band, k, segments in sizes.bands(n):
        use = np.repeat(band >= 0, n)
        some = np.flatnonzero(use)
        if not len(some):
            continue
        r = row[some]
        segment = ((high[some] * segments[r].astype(_U)) >> _U(32)).astype(np.int64)  # in order, since hashes are sorted
        new = np.ones(len(some), bool)
        new[1:] = (r[1:] != r[:-1]) | (segment[1:] != segment[:-1])
        first = np.flatnonzero(new)
        r, segment = r[first], segment[first]
        place = mixed((band[r] << 32 | segment).astype(_U), 80)
        key = mixed(np.bitwise_xor.reduceat(sign[some], first) ^ place, 90)
        found = np.bincount(r, minlength=len(n))
        use = np.arange(len(r)) - np.repeat(starts_of(found)[:-1], found) <= k[r]  # of those that are not empty the first k + 1
        r, segment, key = r[use], segment[use], key[use]
        cut = np.searchsorted(r, np.arange(len(n) + 1))
        for i in np.flatnonzero(found).tolist():
            keys[i].append(key[cut[i] : cut[i + 1]])
            if found[i] <= k[i]:  # a difference could touch every segment that is not empty
                empty = np.setdiff1d(np.arange(segments[i]), segment[cut[i] : cut[i + 1]])
                keys[i].append(mixed(mixed((band[i] << 32 | empty).astype(_U), 80), 95))
    bits = np.where(n > 0, sizes.bits(n), 0)
    start = starts_of(bits)
    spot = start[:-1][row] + (mixed(flat, 120) & (bits[row] - 1).astype(_U)).astype(np.int64)
    odd = np.bincount(spot, minlength=int(start[-1])) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    maps = [packed[a // 8 : b // 8] for a, b in zip(start.tolist(), start.tolist()[1:], strict=False)]
    joined = [np.concatenate(k).view(np.int64) if k else np.zeros(0, np.int64) for k in keys]
    return node.view(np.int64), check.view(np.int64), joined, maps


def _sketched(df: DataFrame, words: int, sizes: Sizes, seed: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, node, check, keys, map``; within a task only the first of a class brings keys and bitmap."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf("n long, node long, check long, keys array<long>, map binary")
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for column in batches:
            texts = [t or "" for t in column]
            for part in portions(texts, PORTION):
                flat, n = shingle_sets(texts[part], words)
                node, check, keys, maps = sketches(flat, n, sizes, seed)
                for i, x in enumerate(node.tolist()):
                    if n[i] and x in seen:
                        keys[i], maps[i] = None, None
                    seen.add(x)
                if len(seen) > 2_000_000:
                    seen.clear()
                yield pd.DataFrame({"n": n, "node": node, "check": check, "keys": keys, "map": maps})

    return df.select(df[id_col].alias("doc_id"), sketched(df[text_col].cast("string")).alias("s")).select("doc_id", "s.*")


def _sets(df: DataFrame, words: int, sizes: Sizes, seed: int, id_col: str, text_col: str) -> DataFrame:
    """``node, members array<long>`` of the documents in ``df``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [t or "" for t in rows["text"]]
            for part in portions(texts, PORTION):
                flat, n = shingle_sets(texts[part], words)
                at, full = starts_of(n), np.flatnonzero(n)
                if len(full):
                    node = np.add.reduceat(mixed(flat, 20 + seed), at[full]).view(np.int64)
                    yield pd.DataFrame({"node": node, "members": [flat[at[i] : at[i + 1]].view(np.int64) for i in full.tolist()]})

    return df.select(df[text_col].cast("string").alias("text")).mapInPandas(run, "node long, members array<long>")


def _verified(pairs: DataFrame, classes: DataFrame, df: DataFrame, ws: Workspace, name: str, words: int, sizes: Sizes, seed: int, id_col: str, text_col: str) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar, written."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = ws.keep(nodes.join(classes, "node").select("node", F.coalesce(F.col("first.doc_id").cast("string"), F.lit("")).alias("_k")), f"{name}-wanted")
    ids = wanted.select("_k").distinct()
    few = wanted.count() <= BROADCAST_IDS
    texts = df.select(F.coalesce(df[id_col].cast("string"), F.lit("")).alias("_k"), df[text_col].alias("text"))
    texts = texts.join(F.broadcast(ids) if few else ids, "_k", "left_semi")
    sets = _sets(texts, words, sizes, seed, "_k", "text").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])
    sets = ws.keep(sets, f"{name}-sets")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    linked = 100 * common >= sizes.percent * (F.size("x") + F.size("y") - common)
    return ws.keep(both.filter(linked).select("a", "b"), f"{name}-links")


def _across(shared: DataFrame, labels: DataFrame, maps: DataFrame, sizes: Sizes, nearest: bool) -> DataFrame:
    """Pairs (a, b) that share a key, lie in different components and whose bitmaps allow a link.

    ``nearest``: for a class and another component only the nearest. Of a key's components the one with
    most classes is not compared with itself; large keys are dealt out in pairs of blocks. ``maps`` brings a
    class's keys of turns before (``done``): a pair that shares one of them has been looked at and is passed over.
    """
    placed = shared.join(labels, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    by_comp = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed_keys = by_comp.groupBy("key").agg(F.max(F.struct("c", "comp"))["comp"].alias("most"), F.sum("c").alias("size"), F.count("*").alias("comps")).filter("comps > 1")
    rows = placed.join(mixed_keys, "key").join(maps, "node")
    rows = rows.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp", (F.col("comp") == F.col("most")).alias("main"), "n", "map", "done")
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for rows in batches:
            if not len(rows):
                continue
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            last = rows.iloc[-1]
            open_ = (rows["key"] == last["key"]) & (rows["i"] == last["i"]) & (rows["j"] == last["j"])
            held = rows[open_]
            yield from compared(rows[~open_])
        if held is not None:
            yield from compared(held)

    def compared(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(rows):
            group = rows[["key", "i", "j"]].to_numpy()
            cut = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(1), True]).tolist()
            columns = {c: rows[c].to_numpy() for c in ("node", "comp", "main", "block", "n", "map", "done")}
            found = []
            for a, b in zip(cut, cut[1:], strict=False):
                one = group[a, 1] == group[a, 2]
                found += near_pairs({c: v[a:b] for c, v in columns.items()}, bool(one), sizes, nearest)
            if found:
                yield pd.DataFrame({"a": [min(x) for x in found], "b": [max(x) for x in found]})

    return dealt.mapInPandas(run, "a long, b long").distinct()


def near_pairs(group: dict[str, np.ndarray], one_block: bool, sizes: Sizes, nearest: bool) -> list[tuple[int, int]]:
    """Pairs within one group of classes that share a key (see ``_across``); of two blocks only pairs across them."""
    node, comp, n, main, block = group["node"], group["comp"], group["n"], group["main"].astype(bool), group["block"]
    raw = [np.frombuffer(m, np.uint64) for m in group["map"]]
    width = min(map(len, raw))
    done = [frozenset() if d is None else frozenset(d.tolist()) for d in group["done"]]
    grid = np.stack([m if len(m) == width else np.bitwise_xor.reduce(m.reshape(-1, width), axis=0) for m in raw])  # larger bitmaps fold down
    out = []
    for x in np.flatnonzero(~main).tolist():
        other = (comp != comp[x]) & ((block != block[x]) | one_block) & (main | (np.arange(len(node)) > x))
        other &= (100 * np.minimum(n, n[x]) >= sizes.percent * np.maximum(n, n[x]))
        y = np.flatnonzero(other)
        if not len(y):
            continue
        distance = np.bitwise_count(grid[y] ^ grid[x]).sum(1, dtype=np.int64)
        ok = distance <= sizes.apart(n[y] + n[x])
        if done[x] and ok.any():
            ok[ok] = [done[x].isdisjoint(done[k]) for k in y[ok].tolist()]
        y, distance = y[ok], distance[ok]
        if nearest and len(y):
            turn = np.lexsort((node[y], distance, comp[y]))
            y = y[turn]
            y = y[np.r_[True, comp[y][1:] != comp[y][:-1]]]
        out += [(int(node[x]), int(node[k])) for k in y.tolist()]
    return out


def _allowed(pairs: DataFrame, maps: DataFrame, sizes: Sizes) -> DataFrame:
    """Those of ``pairs`` (a, b) whose bitmaps allow a link."""
    sides = [maps.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("map").alias(f"map{k}")) for k in "ab"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ok = np.zeros(len(rows), bool)
            for i, r in enumerate(rows.itertuples()):
                x, y = np.frombuffer(r.mapa, np.uint64), np.frombuffer(r.mapb, np.uint64)
                width = min(len(x), len(y))
                x, y = np.bitwise_xor.reduce(x.reshape(-1, width), axis=0), np.bitwise_xor.reduce(y.reshape(-1, width), axis=0)
                ok[i] = 100 * min(r.na, r.nb) >= sizes.percent * max(r.na, r.nb) and np.bitwise_count(x ^ y).sum() <= sizes.apart(r.na + r.nb)
            yield rows.loc[ok, ["a", "b"]]

    return pairs.join(sides[0], "a").join(sides[1], "b").mapInPandas(run, "a long, b long")


def near_components(df: DataFrame, ws: Workspace, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, class_size`` for each row.

    ``component_id`` is the smallest id that links reach, the row's own included.
    """
    sizes, seed = Sizes(percent), 0
    while True:
        rows = ws.keep(_sketched(df, words, sizes, seed, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), f"rows{seed}")
        first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
        classes = ws.keep(rows.filter("n > 0").groupBy("node").agg(F.min(first).alias("first"), F.count("*").alias("class_size"), F.min("check").alias("c0"), F.max("check").alias("c1")), f"classes{seed}")
        if not classes.filter("c0 != c1").head(1):
            break
        seed += 1  # two sets with one hash: hash anew
    how = (df, ws)
    args = (words, sizes, seed, id_col, text_col)
    over = Window.partitionBy("key")
    keyed = rows.filter("keys is not null").select("node", F.explode("keys").alias("key"))

    def repeated(part: DataFrame) -> DataFrame:
        part = part.withColumn("least", F.min("node").over(over)).withColumn("most", F.max("node").over(over)).filter("least != most")
        return part.select("key", "node").distinct()

    many = classes.count() > ONE_PART
    n = PARTS if many else 1
    shared = ws.keep_parts([repeated(keyed.filter(F.pmod("key", F.lit(n)) == k)) for k in range(n)], "shared")

    # links with the most central class
    counts = shared.groupBy("key").agg(F.count("*").alias("c"))
    central = shared.join(counts, "key").groupBy("node").agg(F.sum("c").alias("s"))
    tops = shared.join(central, "node").groupBy("key").agg(F.max(F.struct("s", "node")).alias("top"))
    best = shared.join(tops, "key").filter("node != top.node").groupBy("node").agg(F.max("top")["node"].alias("top"))
    maps = rows.filter("map is not null and n > 0").select("node", "n", "map").join(shared.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    maps = ws.keep(maps, "maps")
    plain = ws.keep(rows.select("doc_id", "n", "node", "row"), "plain")
    ws.drop(f"rows{seed}")  # keys and bitmaps of all classes, most of which share no key
    pairs = best.select(F.least("node", "top").alias("a"), F.greatest("node", "top").alias("b")).distinct()
    pairs = ws.keep(_allowed(pairs, maps, sizes), "central")
    links = _verified(pairs, classes, *how, "central", *args)
    labels = components(links, ws, "central-comps")

    # what is left between components, a few of the keys first (most pairs share several): the nearest, then all
    share = F.pmod(F.xxhash64("key"), F.lit(TURNS[-1]))
    for turn, (low, high) in enumerate(zip((0, *TURNS), TURNS, strict=False)):
        of = (share >= low) & (share < high)
        done = shared.filter(share < low).groupBy("node").agg(F.collect_list("key").alias("done"))  # no more than a text's own segments
        known = maps.join(done, "node", "left") if turn else maps.withColumn("done", F.lit(None).cast("array<long>"))
        keyed = shared.filter(of)
        # rows of keys carry bitmaps, so a late turn goes in parts as large as the first turn; a pair may be found in several
        step = TURNS[0] if many else high - low
        parts = [_across(keyed.filter((share >= k) & (share < k + step)), labels, known, sizes, nearest=True) for k in range(low, high, step)]
        found = ws.keep_parts(parts, f"nearest{turn}").distinct()
        if not found.head(1):
            continue
        more = _verified(found, classes, *how, f"nearest{turn}", *args)
        links = links.union(more)
        labels = components(links, ws, f"nearest{turn}-comps")
        # where all nearest candidates were links, nothing is left; else every candidate of keys with a failed one
        failed = found.join(more, ["a", "b"], "left_anti")
        nodes = failed.select(F.col("a").alias("node")).union(failed.select("b")).distinct()
        keys = ws.keep(keyed.join(nodes, "node", "left_semi").select("key").distinct(), f"failed-keys{turn}")
        rest = _across(keyed.join(keys, "key", "left_semi"), labels, known, sizes, nearest=False)
        found = ws.keep(ws.keep(rest, f"rest{turn}").join(failed, ["a", "b"], "left_anti"), f"all{turn}")
        if found.head(1):
            links = links.union(_verified(found, classes, *how, f"all{turn}", *args))
            labels = components(links, ws, f"all{turn}-comps")

    named = classes.join(labels, "node", "left").select("node", "first", "class_size", F.coalesce("comp", "node").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("first")["doc_id"].alias("component_id"))
    known = ws.keep(named.join(smallest, "comp").select("node", "component_id", "class_size"), "known")
    out = plain.filter("n > 0").join(known, "node").select("row", "doc_id", "n", "component_id", "class_size")
    none = plain.filter("n = 0").select("row", "doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("class_size"))
    return out.union(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_size")


def one_of_each(df: DataFrame, ws: Workspace, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``df`` that stay, whole: of each component those with the smallest id, and rows without id."""
    own = fresh(df, "_id")[0]
    found = near_components(df, ws, id_col=id_col, **how).filter("component_id = doc_id").select(F.col("doc_id").alias(own)).distinct()
    return df.join(found, df[id_col] == F.col(own), "left_semi").unionByName(df.filter(df[id_col].isNull()))
