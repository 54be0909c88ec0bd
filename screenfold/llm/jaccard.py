"""Op 9: Jaccard join of word n-gram sets by a grouped prefix join.

1. Documents with equal sets are one class; only classes go on.
2. Grams are ordered by how many classes hold them, then by hash. Each block of documents asks for the
   counts of its classes' grams, bucket by bucket, so a frequent gram is one entry a block, never one a
   document.
3. Two sets that reach the threshold share a gram of their prefixes. Classes with equal prefixes and
   size are one group; only groups have postings, and grams that one class alone holds have none.
4. Groups that share a gram are filtered by size, members are expanded and their sets intersected. Pairs
   that links have already connected need no further look: classes first meet at the smallest of their
   grams only, then one leader for each part does, as long as units have to be cut. What is still apart
   at some gram meets by families of bounded size; classes of larger families meet at every gram whose
   posting holds different parts, each pair at its first common gram. Every unit is a bounded number
   of classes.

Grams are compared by 64-bit hashes of their words, never by the words.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from screenfold.llm.common import distinct_each, pack_counts, pack_sorted, slices, unpack_counts, unpack_sorted, windows, word_hashes
from screenfold.operators.graph import connected_components
from screenfold.plans.session import shuffle_width, stash


@dataclass(frozen=True)
class Threshold:
    """Jaccard of at least num / den over sets of distinct ``n``-word grams."""

    n: int = 4
    num: int = 85
    den: int = 100

    def prefix(self, size: int) -> int:
        return size + (-self.num * size // self.den) + 1

    def sizes_fit(self, a: int, b: int) -> bool:
        return self.den * min(a, b) >= self.num * max(a, b)

    def holds(self, shared: int, a: int, b: int) -> bool:
        return self.den * shared >= self.num * (a + b - shared)


#: Classes that meet in one unit, and words of a block of documents.
MOST, BLOCK_WORDS = 512, 400_000


def gram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Ascending distinct gram hashes of each whole text with A-Z lower-cased; empty without words."""
    grams, at = distinct_each(*windows(*word_hashes(texts), n))
    return [grams[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def _set_key(grams: np.ndarray) -> str | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).hexdigest() if len(grams) else None


def set_keys(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, key): the number of distinct grams and a 128-bit digest of the set (null if empty)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in slices(batches):
            sets = gram_sets(b.column(1), n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], type=pa.int64()), pa.array([_set_key(s) for s in sets], type=pa.string())], ["id", "size", "key"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, size long, key string")


def _ranked(texts: DataFrame, classes: DataFrame, rule: Threshold, buckets: int, blocks: int) -> DataFrame:
    """(cid, size, gid, prefix, grams) of the classes whose prefix holds a gram of another class.

    ``texts`` is (id, text), ``classes`` (cid, rep, key): a class is read from the row of its id ``rep``,
    where ids repeat from one whose set has its key. Grams are counted by 32 bits of their hash, which
    orders them the same way everywhere; equality is always of all 64.
    """
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int").alias("block")
    texts = texts.select("id", "text", block("id"))
    named = classes.select(F.col("rep").alias("id"), "cid", "key", block("rep"))
    edges = ((np.arange(1, buckets, dtype=np.uint64) << np.uint64(32)) // np.uint64(buckets)).astype(np.uint32)

    def sets_of(rows, ids, cids, keys):
        """(cid, grams) of the block's classes, and their distinct 32-bit grams with counts and cuts."""
        wanted: dict = {}
        for i, c, k in zip(ids, cids, keys):
            wanted.setdefault(i, {})[k] = c
        own = rows.column("id").to_pylist()
        many = {i for i in own if i is None} | {i for i in wanted if len(wanted[i]) > 1}
        if len(set(own)) < len(own):
            seen: set = set()
            many |= {i for i in own if i in seen or seen.add(i)}
        at = [k for k, i in enumerate(own) if i in wanted]
        sets = []
        for part in slices(rows.select(["text"]).take(pa.array(at, pa.int64())).combine_chunks().to_batches()):
            sets += gram_sets(part.column(0), rule.n)
        out = []
        for k, grams in zip(at, sets):
            of = wanted[own[k]]
            if own[k] not in many:
                out.append((next(iter(of.values())), grams))
            elif (c := of.pop(_set_key(grams), None)) is not None:
                out.append((c, grams))
        flat = np.concatenate([g for _, g in out]) if out else np.zeros(0, np.uint64)
        low, times = np.unique((flat >> np.uint64(32)).astype(np.uint32), return_counts=True)
        return out, low, times, np.searchsorted(low, edges)

    def ask(key, rows, got):
        _, low, times, cuts = sets_of(rows, *(got.column(c).to_pylist() for c in ("id", "cid", "key")))
        parts, own = np.split(low, cuts), np.split(times, cuts)
        keep = [i for i, x in enumerate(parts) if len(x)]
        return pa.table({"block": pa.array([key[0].as_py()] * len(keep), pa.int32()), "bucket": pa.array(keep, pa.int32()), "asked": pa.array([pack_sorted(parts[i].astype(np.uint64), 4) for i in keep], pa.binary()), "times": pa.array([pack_counts(own[i]) for i in keep], pa.binary())})

    def answer(key, rows):
        asked = [unpack_sorted(x, 4).astype(np.uint32) for x in rows.column("asked").to_pylist()]
        grams, at = np.unique(np.concatenate(asked), return_inverse=True)
        times = np.concatenate([unpack_counts(x, len(a)) for x, a in zip(rows.column("times").to_pylist(), asked)])
        sums = np.bincount(at, times)
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "counts": pa.array([pack_counts(sums[np.searchsorted(grams, a)]) for a in asked], pa.binary())})

    def order(key, rows, got):
        answers = got.filter(got.column("bucket").is_valid())
        got = got.filter(got.column("cid").is_valid())
        sets, low, _, cuts = sets_of(rows, *(got.column(c).to_pylist() for c in ("id", "cid", "key")))
        held_in = np.diff(cuts, prepend=0, append=len(low))
        parts = sorted(zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist()))
        counts = np.concatenate([unpack_counts(raw, held_in[k]) for k, raw in parts] or [np.zeros(0)])
        out: dict[str, list] = {c: [] for c in ("cid", "size", "gid", "prefix", "grams")}
        for cid, grams in sets:
            held = counts[np.searchsorted(low, (grams >> np.uint64(32)).astype(np.uint32))]
            first = np.argsort(held, kind="stable")[: rule.prefix(len(grams))]
            shared = grams[first][held[first] > 1]
            if len(shared):
                gid = hashlib.blake2b(grams[first].tobytes() + len(grams).to_bytes(8, "little"), digest_size=8).digest()
                for c, v in zip(out, (cid, len(grams), int.from_bytes(gid, "little", signed=True), shared.view(np.int64).tolist(), grams.tobytes())):
                    out[c].append(v)
        return pa.table({"cid": pa.array(out["cid"], pa.int64()), "size": pa.array(out["size"], pa.int64()), "gid": pa.array(out["gid"], pa.int64()), "prefix": pa.array(out["prefix"], pa.list_(pa.int64())), "grams": pa.array(out["grams"], pa.binary())})

    asked = texts.groupBy("block").cogroup(named.groupBy("block")).applyInArrow(ask, "block int, bucket int, asked binary, times binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "block int, bucket int, counts binary")
    both = answers.unionByName(named, allowMissingColumns=True)
    return texts.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(order, "cid long, size long, gid long, prefix array<long>, grams binary")


def unit_links(cids, comps, sides, gids, prefixes, grams, rule: Threshold, at: int | None = None, every: bool = False) -> list[tuple[int, int]]:
    """Links among the classes of one unit: those that connect what the threshold connects and no more
    than needed, or ``every`` one.

    ``comps``: parts already connected. ``sides``: pairs are looked at only across different sides,
    unless all are on side 0. ``at``: pairs are looked at only where this is their smallest common gram.
    """
    root = {c: c for c in comps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    groups: dict[int, list[int]] = {}
    for i, g in enumerate(gids):
        groups.setdefault(g, []).append(i)
    held = {g: set(prefixes[members[0]]) for g, members in groups.items()}
    index: dict[int, list[int]] = {}
    size = [len(g) for g in grams]
    for g, ts in held.items():
        for t in ts if at is None else (at,):
            index.setdefault(t, []).append(g)
    two_sided = any(sides)
    done, links = set(), []
    for g in groups:
        near = {h for t in (held[g] if at is None else (at,)) for h in index[t] if h not in done}
        near = [h for h in near if rule.sizes_fit(size[groups[g][0]], size[groups[h][0]]) and (at is None or min(held[g] & held[h]) == at)]
        for h in sorted(near):
            for i in groups[g]:
                for j in groups[h]:
                    if (h == g and j <= i) or (two_sided and sides[i] == sides[j]):
                        continue
                    a, b = find(comps[i]), find(comps[j])
                    if a == b and not every:
                        continue
                    shared = len(np.intersect1d(grams[i], grams[j], assume_unique=True))
                    if rule.holds(shared, size[i], size[j]):
                        root[a] = b
                        links.append((cids[i], cids[j]))
        done.add(g)
    return links


def _verify(ranked: DataFrame, units: DataFrame, rule: Threshold, bins: int, every: bool = False) -> DataFrame:
    """Links (a, b) within each unit; ``units`` is (cid, unit, comp, side, at), a unit bounded in size."""

    def run(key, rows):
        at_of = rows.column("at").to_pylist()
        got = rows.drop_columns(["at"]).to_pandas()
        a, b = [], []
        for _, u in got.groupby("unit", sort=True):
            if len(u) > 1:
                u = u.sort_values("cid")
                grams = [np.frombuffer(x, np.uint64) for x in u["grams"]]
                for x, y in unit_links(u["cid"].tolist(), u["comp"].tolist(), u["side"].tolist(), u["gid"].tolist(), [p.tolist() for p in u["prefix"]], grams, rule, at_of[u.index[0]], every):
                    a.append(x), b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = ranked.join(units, "cid").select("cid", "unit", "comp", "side", "at", "gid", "prefix", "grams", F.pmod(F.xxhash64("unit"), F.lit(bins)).cast("int").alias("bin"))
    return rows.groupBy("bin").applyInArrow(run, "a long, b long")


def _parts(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with comp, the part that links have put each class in."""
    comps = connected_components(links)
    return members.join(comps.select(F.col("id").alias("cid"), "component"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")


def _units(rows: DataFrame, most: int, step: int) -> DataFrame:
    """Units of at most about ``most`` of the classes that share ``meet``; ``rows`` is (cid, meet, comp)."""
    split = rows.groupBy("meet").agg(F.count("*").alias("m")).where("m > 1").withColumn("k", F.ceil(F.col("m") / most).cast("long"))
    cut = F.xxhash64("meet", F.lit(step), F.pmod(F.xxhash64("cid", F.lit(step)), F.col("k")))
    return rows.join(split, "meet").select("cid", cut.alias("unit"), "comp", F.lit(0).alias("side"), F.lit(None).cast("long").alias("at"), (F.col("k") > 1).alias("cut"))


def _apart(posts: DataFrame, parts: DataFrame) -> DataFrame:
    """(gram, gid, cid, comp, size) of the classes at grams whose posting holds several parts.

    Tables with a row for each gram are written before they are joined, here and below: a join of plain
    shuffles is one that adaptive execution can split where a gram is frequent.
    """
    rows = posts.join(parts.select("gid", "cid", "comp", "size"), "gid")
    mixed = stash(rows.groupBy("gram").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("gram"), "mixed")
    return rows.join(mixed, "gram", "left_semi").select("gram", "gid", "cid", "comp", "size")


def _families(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Units of whole families, as far as these have at most ``most`` classes, and the rows of the rest.

    A family is what the grams of ``rows`` connect: its classes meet once, not at every gram.
    """
    heads = stash(rows.groupBy("gram").agg(F.min("gid").alias("head")), "heads")
    near = rows.select("gram", "gid").distinct().join(heads, "gram").select("gid", "head").distinct()
    families = connected_components(near, "gid", "head").select(F.col("id").alias("gid"), F.col("component").alias("family"))
    held = rows.select("gid", "cid", "comp").distinct().join(families, "gid")
    sizes = held.groupBy("family").agg(F.count("*").alias("m"))
    small = held.join(sizes.where(F.col("m") <= most), "family")
    units = small.select("cid", F.col("family").alias("unit"), "comp", F.lit(0).alias("side"), F.lit(None).cast("long").alias("at"))
    large = families.join(sizes.where(F.col("m") > most), "family", "left_semi").select("gid")
    return units, rows.join(large, "gid", "left_semi")


def _meetings(rows: DataFrame, rule: Threshold, most: int) -> DataFrame:
    """Units in which classes of different parts meet: (cid, unit, comp, side, at).

    The classes of each gram are dealt into blocks: by size band, as sets of distant sizes cannot link,
    and a large part by itself, as it need not meet itself. All pairs of blocks of equal or
    neighbouring bands meet.
    """
    band = F.floor(F.log("size") / F.lit(float(np.log(rule.den / rule.num)) * 1.000001)).cast("int")
    rows = rows.select("gram", "cid", "comp", band.alias("band"))
    by = ["gram", "band", "comp"]
    sized = rows.groupBy(*by).agg(F.count("*").alias("m")).withColumn("k", F.ceil(F.col("m") / most).cast("long"))
    few = sized.where(F.col("m") < most).groupBy("gram", "band").agg(F.ceil(F.sum("m") / most).cast("long").alias("few"))
    large = F.col("m") >= most
    block = F.when(large, F.xxhash64("comp", F.pmod(F.xxhash64("cid"), F.col("k")))).otherwise(F.xxhash64(F.lit("small"), F.pmod(F.xxhash64("comp"), F.col("few"))))
    dealt = stash(rows.join(sized, by).join(few, ["gram", "band"], "left").select("gram", "band", "cid", "comp", block.alias("block"), F.when(large, F.col("comp")).alias("whole")), "dealt")
    kinds = dealt.select("gram", "band", "block", "whole").distinct()
    # each block meets itself, later ones of its band and all of the next band
    left = kinds.withColumn("next", F.explode(F.array("band", F.col("band") + 1)))
    right = kinds.select("gram", F.col("band").alias("next"), F.col("block").alias("other"), F.col("whole").alias("other_whole"))
    pairs = left.join(right, ["gram", "next"]).where((F.col("next") > F.col("band")) | (F.col("block") <= F.col("other")))
    pairs = pairs.where(F.col("whole").isNull() | F.col("other_whole").isNull() | (F.col("whole") != F.col("other_whole")))
    pairs = pairs.withColumn("unit", F.xxhash64("gram", "band", "block", "next", "other"))
    same = (F.col("band") == F.col("next")) & (F.col("block") == F.col("other"))
    sided = pairs.select("gram", "band", "block", "unit", F.lit(0).alias("side")).unionAll(pairs.where(~same).select("gram", F.col("next").alias("band"), F.col("other").alias("block"), "unit", F.lit(1).alias("side")))
    return dealt.join(sided, ["gram", "band", "block"]).select("cid", "unit", "comp", "side", F.col("gram").alias("at"))


def class_links(texts: DataFrame, classes: DataFrame, rule: Threshold, total_grams: int, total: int, most: int = MOST, every: bool = False) -> DataFrame:
    """Links (a, b) between class ids: those that connect exactly what the threshold connects, or with
    ``every`` all pairs of classes that reach it."""
    width = shuffle_width(texts.sparkSession)
    buckets = max(16, min(width, 64), total_grams // 4_000_000)
    blocks = max(16, total_grams // BLOCK_WORDS)
    bins = max(32, total // 500)
    ranked = stash(_ranked(texts, classes, rule, buckets, blocks), "ranked")
    groups = ranked.groupBy("gid").agg(F.first("prefix").alias("prefix"), F.count("*").alias("n"))
    posts = groups.select("gid", "n", F.explode("prefix").alias("gram"))
    common = stash(posts.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram"), "common")
    posts = stash(posts.select("gid", "gram").join(common, "gram", "left_semi"), "posts")
    meet = posts.groupBy("gid").agg(F.min("gram").alias("meet"))
    members = stash(ranked.select("cid", "gid", "size").join(meet, "gid"), "members")
    if every:
        rows = stash(_apart(posts, members.withColumn("comp", F.col("cid"))), "apart")
        units, rest = _families(rows, most)
        links = _verify(ranked, units, rule, bins, True).unionByName(_verify(ranked, _meetings(rest, rule, most), rule, 4 * bins, True))
        return stash(links, "links")
    units = stash(_units(members.withColumn("comp", F.col("cid")), most, 0), "units")
    links = stash(_verify(ranked, units.drop("cut"), rule, bins), "links")
    parts, step, before = stash(_parts(members, links), "parts"), 0, None
    while True:
        # what had to be cut: one leader of each part of the cut units
        cut = units.where("cut").select("cid").join(parts.where("cid = comp").select("cid", "meet", "comp"), "cid")
        left = cut.count()
        if not left or (before is not None and left > 0.9 * before):
            break
        before, step = left, step + 1
        units = stash(_units(cut, most, step), f"units-{step}")
        links = stash(links.unionByName(_verify(ranked, units.drop("cut"), rule, bins)), "links")
        parts = stash(_parts(members, links), "parts")
    rows = stash(_apart(posts, parts), "apart")
    units, rest = _families(rows, most)
    found = _verify(ranked, units, rule, bins).unionByName(_verify(ranked, _meetings(rest, rule, most), rule, 4 * bins))
    return links.unionByName(stash(found, "links"))


def _classes(docs: DataFrame, rule: Threshold, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    """Light rows (id, size, key), classes (cid, key, rep, size), texts (id, text), and totals of grams and classes."""
    light = stash(set_keys(docs, rule.n, id_col, text_col), "sets")
    found = light.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.max("size").alias("size"))
    classes = stash(found.withColumn("cid", F.monotonically_increasing_id()), "classes")
    row = classes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("grams"), F.count("*").alias("n")).first()
    return light, classes, docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), int(row["grams"]), int(row["n"])


def similar_pairs(docs: DataFrame, rule: Threshold = Threshold(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, (a, b) with a < b, and (id, class_id) of every document.

    A pair stands for its classes: documents of equal sets share the class id, their smallest id, and
    are not expanded. Documents without words have a null class.
    """
    light, classes, texts, grams, n = _classes(docs, rule, id_col, text_col)
    links = class_links(texts, classes, rule, grams, n, every=True)
    reps = classes.select("cid", "rep")
    pairs = links.join(reps.toDF("a", "ra"), "a").join(reps.toDF("b", "rb"), "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    return pairs, light.join(classes.select("key", "rep"), "key", "left").select(F.col("id").alias(id_col), F.col("rep").alias("class_id"))


def near_classes(docs: DataFrame, rule: Threshold = Threshold(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    component_id is the smallest id reachable by links. A null or empty text, or one without words,
    has no grams and is linked with nothing; a text of fewer than n words is one gram. Equal texts are
    linked whatever their number. A row without an id belongs to its text's component, null if it is
    alone. Very long texts are hashed piece by piece. Other columns are not read; an empty table gives
    an empty one.
    """
    light, classes, texts, grams, n = _classes(docs, rule, id_col, text_col)
    links = class_links(texts, classes, rule, grams, n)
    comps = connected_components(links).select(F.col("id").alias("cid"), "component")
    named = classes.join(comps, "cid", "left").select("key", "rep", F.coalesce("component", "cid").alias("root"))
    low = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(low, "root").select("key", "component_id")
    # sets without grams have no key: those rows, however many, are not joined
    none = light.where("key IS NULL").withColumn("component_id", F.lit(None).cast(light.schema["id"].dataType))
    out = light.where("key IS NOT NULL").join(named, "key").select(*none.columns).unionByName(none)
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, rule: Threshold, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, and every row without a gram.

    The row with the smallest id stays, one without an id only where its component has none with one; of rows
    that share this id, that with the smallest set key, then the smallest hash of its text, then any of
    equal ones. So rows of one id that are not alike all stay, each for its own component.
    """
    light, classes, texts, grams, n = _classes(docs, rule, id_col, text_col)
    comps = connected_components(class_links(texts, classes, rule, grams, n)).select(F.col("id").alias("cid"), "component")
    roots = classes.join(comps, "cid", "left").select("key", F.coalesce("component", "cid").alias("root"))
    each = light.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("first"))
    chosen = each.join(roots, "key").groupBy("root").agg(F.min("first").alias("first")).select("first.id", "first.key")
    chosen = stash(chosen, "chosen")
    if light.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL").isEmpty():
        kept = chosen.select(F.col("id").alias("kept id")).unionByName(light.where("key IS NULL").select(F.col("id").alias("kept id")))
        return docs.join(kept, F.col(id_col) == F.col("`kept id`"), "left_semi")
    # names that no column of the documents has
    named = set_keys_of_rows(docs, rule.n, text_col)
    own, own_key, text_hash = (F.col(f"`{c}`") for c in ("own id", KEY, "own text hash"))
    chosen = chosen.select(F.col("id").alias("chosen id"), F.col("key").alias("chosen key"))
    rows = named.where(own_key.isNotNull()).withColumns({"own id": F.col(id_col), "own text hash": F.xxhash64(text_col)})
    rows = rows.join(chosen, own.eqNullSafe(F.col("`chosen id`")) & (own_key == F.col("`chosen key`")), "left_semi")
    least = rows.groupBy("own id", KEY).agg(F.min("own text hash").alias("least hash")).select(F.col("`own id`").alias("least id"), own_key.alias("least key"), "`least hash`")
    rows = rows.join(least, own.eqNullSafe(F.col("`least id`")) & (own_key == F.col("`least key`")) & (text_hash == F.col("`least hash`")), "left_semi")
    rows = rows.dropDuplicates(["own id", KEY]).select(*docs.columns)
    return rows.unionByName(named.where(own_key.isNull()).select(*docs.columns))


#: Column that ``set_keys_of_rows`` adds.
KEY = "own set key"


def set_keys_of_rows(docs: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with the key of its text's set, null if it has no gram."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in slices(batches):
            keys = pa.array([_set_key(s) for s in gram_sets(b.column(at), n)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, keys], [*b.schema.names, KEY])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(KEY, StringType())]))
