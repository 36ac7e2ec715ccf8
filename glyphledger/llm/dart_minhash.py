"""Near-duplicates by DartMinHash signatures, banding and verified links.

A document is the multiset of its five-word shingles; the weight of a shingle is how often it occurs. Hashed darts fall on
the weighted regions of the elements, in regions of doubling time; a document of weight w looks as far as darts cover its
signature, so a signature costs about as many darts as coordinates times their logarithm, however long the text is. The
earliest dart at each coordinate makes a signature whose agreement estimates the weighted Jaccard similarity.

Bands of the signature make buckets. No bucket is expanded into pairs: its members are compared with one leader, verified
on the whole texts, and verified links make components. A bucket that still holds several components is settled as a whole
in one task if it is small, by all its texts. A large one gets a pivot, the signature that most of its members agree with:
members with few coordinates unlike the pivot's are near one another, so all are compared with the member that has the
fewest; two that are alike without being near the pivot share coordinates that differ from it, so these make the next,
smaller groups. That goes on until no group holds several components, so each level asks in proportion to its members.
Classes are the connected components of verified links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphledger.llm import common as C

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Members of one leader that are compared in one group.
GROUP_ROWS = 256
#: Members, and bytes of their texts, of a group that one task settles as a whole.
SMALL_ROWS, SMALL_BYTES = 1024, 32 << 20
#: Members of a group of long texts that is not split further; its pairs are compared two texts at a time.
FEW = 32
#: Members whose signatures make a group's pivot. Any pivot is right; a good one makes smaller groups.
PIVOT_ROWS = 65
#: Share of equal coordinates that two texts of the similarity have in all but one of 10,000 cases (four standard deviations).
AGREE = 0.66
#: Texts whose darts are thrown in one step: each takes some hundred darts, however short it is.
SIGN_ROWS = 256
#: Length of the first time region, as a power of two; regions double after it.
_FIRST = -6


def _poisson_steps(mean: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson law, for inversion."""
    n = int(mean + 12 * mean**0.5 + 12)
    logs = np.arange(n) * np.log(mean) - mean - np.cumsum(np.log(np.maximum(np.arange(n), 1)))
    return np.cumsum(np.exp(logs))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> C.U64(11)).astype(np.float64) * 2.0**-53


def signatures(shingle: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """(n_rows, k) earliest darts: the hash of the dart that is first at each coordinate; rows without shingles get 0."""
    order = np.lexsort((shingle, row))
    s, r = shingle[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    layer = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    unit = C.mix64(s + C.mix64(layer.astype(C.U64) + C.U64(1)))  # the j-th unit of an element's weight is a region of its own
    weight = np.bincount(r, minlength=n_rows)
    need = (k * np.log(k) + 2 * k) / np.maximum(weight, 1)
    depth = np.maximum(0, np.ceil(np.log2(need)) - _FIRST).astype(np.int64)
    best = np.full((n_rows, k), np.inf)
    name = np.zeros((n_rows, k), C.U64)
    active = weight > 0
    level = 0
    while active.any():
        here = active & (depth >= level)
        if here.any():
            use = here[r]
            length = 2.0 ** (_FIRST if level == 0 else _FIRST + level - 1)
            begin = 0.0 if level == 0 else length
            u = C.mix64(unit[use] ^ C.BYTE64[level % 256])
            darts = np.searchsorted(_poisson_steps(length), _unit(u), "right")
            got = np.flatnonzero(darts)
            n = darts[got]
            at = np.repeat(got, n)
            j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            dart = C.mix64(u[at] + C.mix64(j.astype(C.U64) + C.U64(0xDA27)))
            when = begin + length * _unit(C.mix64(dart ^ C.BYTE64[1]))
            place = (dart % C.U64(k)).astype(np.int64)
            flat = r[use][at] * k + place
            earliest = np.lexsort((dart, when, flat))
            f = flat[earliest]
            lead = np.ones(len(f), bool)
            lead[1:] = f[1:] != f[:-1]
            f, w, d = f[lead], when[earliest][lead], dart[earliest][lead]
            better = w < best.ravel()[f]
            best.ravel()[f[better]], name.ravel()[f[better]] = w[better], d[better]
        # a row is done at its depth if each coordinate has a dart; else it looks further
        short = active & (depth <= level)
        full = np.isfinite(best).all(1)
        depth[short & ~full] = level + 1
        active &= ~(short & full)
        level += 1
    return name


def _signed(shingle: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """signatures() of a block whose rows are in order, SIGN_ROWS at a time, so that memory doesn't grow with their number."""
    edges = np.append(np.arange(0, n_rows, SIGN_ROWS), n_rows)
    parts = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        own = slice(*np.searchsorted(row, (lo, hi)))
        parts.append(signatures(shingle[own], row[own] - lo, hi - lo, k))
    return np.concatenate(parts) if parts else np.zeros((0, k), C.U64)


def _band_keys(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tid = np.asarray(batch.column(0))
            for lo, hi, buf, offs in C.blocks(batch.column(1)):
                words, _, _, per_row = C.hashed_words(buf, offs)
                h, row = C.shingles(words, per_row, SHINGLE)
                name = _signed(h, row, hi - lo, bands * rows)
                grid = name.reshape(hi - lo, bands, rows)
                key = np.zeros((hi - lo, bands), C.U64)
                for j in range(rows):
                    key = C.mix64(key * C.U64(31) + grid[:, :, j] + C.BYTE64[:bands])
                ok = np.flatnonzero(per_row > 0)
                offsets = pa.array(np.arange(len(ok) + 1) * bands, pa.int32())
                short = np.ascontiguousarray((name[ok] >> C.U64(32)).astype(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array(tid[lo:hi][ok]), pa.ListArray.from_arrays(offsets, pa.array(C.signed(key[ok].ravel()))), pa.array([x.tobytes() for x in short], pa.binary())], names=["tid", "keys", "sig"])

    return run


def _weighted(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, _ = C.shingles(words, np.array([len(words)]), SHINGLE)
    return np.unique(h, return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (leader, salt, tid, is_member, text), sorted so that a leader comes before its members: similarity of each pair."""
    key, lead = None, None
    for batch in batches:
        leader, salt, tid, member = (np.asarray(batch.column(i)) for i in range(4))
        out_l, out_t, out_s = [], [], []
        for lo, hi, buf, offs in C.blocks(batch.column(4)):
            words, _, _, per_row = C.hashed_words(buf, offs)
            ends = np.cumsum(per_row)
            for i in range(lo, hi):
                own = _weighted(words[ends[i - lo] - per_row[i - lo] : ends[i - lo]])
                if not member[i]:
                    key, lead = (leader[i], salt[i]), own
                elif key == (leader[i], salt[i]):
                    out_l.append(leader[i]), out_t.append(tid[i]), out_s.append(weighted_jaccard(lead, own))
        yield pa.RecordBatch.from_arrays([pa.array(out_l, pa.int64()), pa.array(out_t, pa.int64()), pa.array(out_s, pa.float64())], names=["leader", "tid", "similarity"])


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(leader, tid, similarity) of pairs (leader, tid), from texts (tid, text) with one row for each tid."""
    # a leader's many members are dealt in groups of bounded size, each with a copy of the leader's text
    counts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("groups"))
    salted = pairs.join(counts, "leader").withColumn("salt", F.pmod(F.xxhash64("tid", F.lit(5)), F.col("groups")))
    members = salted.select("leader", "salt", "tid", F.lit(1).alias("is_member"))
    leaders = counts.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("salt"), F.col("leader").alias("tid"), F.lit(0).alias("is_member"))
    asked = members.unionByName(leaders).join(texts, "tid").select("leader", "salt", "tid", "is_member", "text")
    return asked.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "is_member").mapInArrow(_compare, "leader long, tid long, similarity double")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) with the least node of each connected component, for nodes (node) and links (a, b).

    Large-star and small-star steps alternate until nothing changes; each shuffles the links, none gathers a component.
    """
    edges = C.checkpoint(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: every larger neighbour of a node hangs on the least of its neighbourhood
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.where("b > a").join(least, "a").select(F.col("root").alias("a"), "b").where("a < b")
        # small star: each node and its smaller neighbours hang on the least of these
        up = large.groupBy("b").agg(F.min("a").alias("root"))
        small = large.join(up, "b").select(F.explode(F.array("a", "b")).alias("b"), "root")
        old, edges = edges, C.checkpoint(small.where("root < b").select(F.col("root").alias("a"), "b").distinct())
        C.discard(old)
        # stars whose nodes hang on one root each don't change any more
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("b").agg(F.min("a").alias("root"))
    return nodes.join(roots, nodes["node"] == roots["b"], "left").select("node", F.coalesce("root", "node").alias("root"))


def _elements(words: np.ndarray) -> np.ndarray:
    """The units of a text's weighted shingles: one element for each occurrence, so that sets of them have its similarity."""
    h = np.sort(C.shingles(words, np.array([len(words)]), SHINGLE)[0])
    first = np.searchsorted(h, h)
    return C.mix64(h + C.mix64((np.arange(len(h)) - first).astype(C.U64) + C.U64(1)))


def _merging_links(elements: list[np.ndarray], roots: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of places whose texts have the similarity, as few as join all components that they join."""
    m = len(elements)
    size = np.array([len(e) for e in elements], float)
    owner = np.repeat(np.arange(m), size.astype(np.int64))
    _, which, n = np.unique(np.concatenate(elements), return_inverse=True, return_counts=True)
    column = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[which]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((m, m), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        part = slice(*np.searchsorted(column, (lo, lo + 2048)))
        grid = np.zeros((m, 2048), np.float32)
        grid[owner[part], column[part] - lo] = 1
        both += grid @ grid.T
    total = size[:, None] + size - both
    i, j = np.nonzero(np.triu(both / np.maximum(total, 1) >= similarity, 1))
    up = {r: r for r in roots.tolist()}

    def find(r: int) -> int:
        while up[r] != r:
            up[r] = r = up[up[r]]
        return r

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(int(roots[a])), find(int(roots[b]))
        if x != y:
            up[x] = y
            out.append((a, b))
    return out


def _settle(similarity: float):
    """Rows (group, tid, root, text) sorted by group, small groups: links (a, b) that join components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tids, roots, sets = None, [], [], []

        def made() -> pa.RecordBatch:
            links = _merging_links(sets, np.array(roots), similarity) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([tids[pair[k]] for pair in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            group, tid, root = (np.asarray(batch.column(i)) for i in range(3))
            for lo, hi, buf, offs in C.blocks(batch.column(3)):
                words, _, _, per_row = C.hashed_words(buf, offs)
                ends = np.cumsum(per_row)
                for i in range(lo, hi):
                    if group[i] != key:
                        yield made()
                        key, tids, roots, sets = group[i], [], [], []
                    tids.append(int(tid[i])), roots.append(int(root[i]))
                    sets.append(_elements(words[ends[i - lo] - per_row[i - lo] : ends[i - lo]]))
        yield made()

    return run


def _signature(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def _pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, sigs) to (group, pivot): at each coordinate what most signatures have, the least of ties."""
    for batch in batches:
        out = []
        for sigs in batch.column(1):
            grid = np.sort(np.stack([np.frombuffer(x.as_py(), np.uint32) for x in sigs]), axis=0)
            times = (grid[:, None] == grid).sum(1)
            out.append(np.take_along_axis(grid, times.argmax(0)[None], 0)[0].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["group", "pivot"])


def _deviations(k: int):
    """(tid, root, sig, pivots array<group, path, pivot>) to (tid, root, groups, far, keys): how many coordinates differ
    from each group's pivot, and the keys of the next groups. A key is the set of coordinates that led to it, so each set
    makes one group whatever the order. Two texts that agree at AGREE of all coordinates share one of the first
    k - AGREE x k + 1 coordinates that differ, or have fewer than that between them and are near the pivot."""
    most = k - int(AGREE * k) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, far, keys = [], [], []
            for sig, pivots in zip(_signature(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                own, differ = set(), []
                for p in pivots:
                    at = np.flatnonzero(sig != np.frombuffer(p["pivot"], np.uint32))
                    differ.append(len(at))
                    h = C.mix64(C.mix64(sig[at[:most]].astype(C.U64) + C.U64(1)) ^ C.BYTE64[at[:most] % 256]) ^ C.U64(p["path"] & (2**64 - 1))
                    own |= set(C.signed(h).tolist())
                groups.append([p["group"] for p in pivots]), far.append(differ), keys.append(sorted(own))
            lists = [pa.array(x, pa.list_(t)) for x, t in ((groups, pa.int64()), (far, pa.int32()), (keys, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["tid", "root", "groups", "far", "keys"])

    return run


def similar_classes(texts: DataFrame, *, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, small_rows: int = SMALL_ROWS, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """(node, root) for the texts (tid, text) that share a bucket with another; copies of a text have one tid."""
    signed = C.checkpoint(texts.mapInArrow(_band_keys(bands, rows), "tid long, keys array<long>, sig binary").dropDuplicates(["tid"]))
    buckets = signed.select("tid", F.posexplode("keys").alias("band", "key")).select("tid", F.xxhash64("band", "key").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = C.checkpoint(buckets.join(sizes, "bucket"))
    # a leader is the member that has the most company over all bands: near the middle of its class
    company = shared.groupBy("tid").agg(F.sum("n").alias("company"))
    # copies go before the shuffle, in each task's share of the aggregation
    candidates = C.checkpoint(texts.dropDuplicates(["tid"]).join(company, "tid").select("tid", "company", F.octet_length("text").cast("long").alias("bytes"), "text"))
    ranked = shared.join(candidates.select("tid", "company"), "tid")
    lead = ranked.groupBy("bucket").agg(F.max(F.struct("company", "tid")).alias("l")).select("bucket", F.col("l.tid").alias("leader"))
    pairs = shared.select("bucket", "tid").join(lead, "bucket").where("tid <> leader").select("leader", "tid").distinct()
    links = C.checkpoint(_linking(pairs, candidates, similarity))
    roots = _linked(candidates, links)
    tables = [signed, shared, candidates, links]
    placed = shared.select(F.col("bucket").alias("group"), F.lit(0).cast("long").alias("path"), "tid")
    while True:
        # groups that still hold several components; of groups with the same members, one
        members = placed.join(roots.withColumnRenamed("node", "tid"), "tid").join(candidates.select("tid", "bytes"), "tid")
        open_ = members.groupBy("group").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.bit_xor(F.xxhash64("tid")).alias("who")).where("least <> most")
        open_ = open_.groupBy("n", "bytes", "who").agg(F.min("group").alias("group"))
        size = F.when((F.col("n") <= small_rows) & (F.col("bytes") <= small_bytes), "small").when(F.col("n") <= FEW, "few").otherwise("large")
        mixed = C.checkpoint(members.drop("bytes").join(open_.select("group", size.alias("size")), "group"))
        sizes = {r.size for r in mixed.select("size").distinct().collect()}
        tables.append(mixed)
        if not sizes:
            break
        found = []
        if "small" in sizes:
            gathered = mixed.where("size = 'small'").join(candidates.select("tid", "text"), "tid").select("group", "tid", "root", "text")
            found.append(C.checkpoint(gathered.repartition("group").sortWithinPartitions("group", "tid").mapInArrow(_settle(similarity), "a long, b long")))
        if "few" in sizes:
            few = mixed.where("size = 'few'").select("group", "tid", "root")
            other = few.select("group", F.col("tid").alias("leader"), F.col("root").alias("its"))
            asked = few.join(other, "group").where("leader < tid and root <> its").select("leader", "tid").distinct()
            found.append(C.checkpoint(_linking(asked, candidates, similarity)))
        if "large" in sizes:
            large = mixed.where("size = 'large'")
            some = large.select("group", "tid", F.row_number().over(Window.partitionBy("group").orderBy(F.xxhash64("tid", "group"), "tid")).alias("r")).where(F.col("r") <= PIVOT_ROWS)
            pivots = some.join(signed.select("tid", "sig"), "tid").groupBy("group").agg(F.collect_list("sig").alias("sigs")).mapInArrow(_pivot, "group long, pivot binary")
            own = large.join(pivots, "group").groupBy("tid", "root").agg(F.collect_list(F.struct("group", "path", "pivot")).alias("pivots"))
            own = own.join(signed.select("tid", "sig"), "tid").select("tid", "root", "sig", "pivots")
            tables.append(away := C.checkpoint(own.mapInArrow(_deviations(bands * rows), "tid long, root long, groups array<long>, far array<int>, keys array<long>")))
            each = away.select("tid", "root", F.inline(F.arrays_zip("groups", "far")).alias("group", "far"))
            lead = each.groupBy("group").agg(F.min(F.struct("far", "tid", "root")).alias("l")).select("group", F.col("l.tid").alias("leader"), F.col("l.root").alias("its"))
            asked = each.join(lead, "group").where("root <> its").select("leader", "tid").distinct()
            found.append(C.checkpoint(_linking(asked, candidates, similarity)))
            next_ = away.select(F.explode("keys").alias("group"), F.col("tid"))
            placed = next_.select("group", F.col("group").alias("path"), "tid")
        fresh = [f for f in found if not f.isEmpty()]
        if fresh:
            known = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
            for more in fresh:
                known = known.unionByName(more)
            roots = _linked(candidates, known)
        tables += found
        if "large" not in sizes:
            break
    C.discard(*tables)
    return roots


def _linking(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): those of the pairs (leader, tid) that have the similarity."""
    compared = _verify(pairs, texts.select("tid", "text"))
    return compared.where(F.col("similarity") >= similarity).select(F.col("leader").alias("a"), F.col("tid").alias("b"))


def _linked(candidates: DataFrame, links: DataFrame) -> DataFrame:
    return C.checkpoint(components(candidates.select(F.col("tid").alias("node")), links))


def classes(docs: DataFrame, *, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, small_rows: int = SMALL_ROWS, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """doc_id, class_id and keep for each row of docs (doc_id, text).

    class_id is the least doc_id of the class; keep marks one row of each class, rows of equal id and text aside. Null and
    wordless texts have no shingles: each is in a class with its equals only. Texts of fewer than five words have one
    shingle of all their words. Copies of a text, and equal rows, are in one class; a null id comes after all others. Other
    columns are ignored.
    """
    keyed, named = _named(docs, similarity, bands, rows, small_rows=small_rows, small_bytes=small_bytes)
    heads = named.groupBy("root").agg(F.min("least_id").alias("class_id"))
    member = C.checkpoint(named.join(heads, "root").select("tid", "class_id"))
    return keyed.select("doc_id", "tid").join(member, "tid").select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("keep"))


def _named(docs: DataFrame, similarity: float, bands: int, rows: int, **limits: int) -> tuple[DataFrame, DataFrame]:
    """docs as (doc_id, text, tid), and (tid, least_id, root): the least id and the class of each distinct text."""
    keyed = docs.select("doc_id", "text", _tid())
    ids = C.checkpoint(keyed.groupBy("tid").agg(F.min("doc_id").alias("least_id")))
    roots = similar_classes(keyed.where("text is not null").select("tid", "text"), similarity=similarity, bands=bands, rows=rows, **limits)
    return keyed, ids.join(roots.withColumnRenamed("node", "tid"), "tid", "left").select("tid", "least_id", F.coalesce("root", "tid").alias("root"))


def _tid(name: str = "tid") -> Column:
    return F.coalesce(F.xxhash64("text", F.octet_length("text")), F.lit(0)).alias(name)


def drop_near_duplicates(docs: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class of near-duplicates: that of the least doc_id, and of the texts of that id the least hash.

    A null id comes after all others. Classes are of texts, so rows that share an id, or have none, stand for themselves.
    """
    _, named = _named(docs, similarity, BANDS, ROWS)
    tid, kept_tid, kept_id = (C.unused(name, docs.columns) for name in ("_tid", "_kept_tid", "_kept"))
    kept = named.groupBy("root").agg(F.min(F.struct(F.col("least_id").isNull(), "least_id", "tid")).alias("k")).select(F.col("k.tid").alias(kept_tid), F.col("k.least_id").alias(kept_id))
    keyed = docs.select("*", _tid(tid))
    first = keyed.join(kept, (F.col(tid) == F.col(kept_tid)) & keyed["doc_id"].eqNullSafe(F.col(kept_id)), "left_semi")
    return first.dropDuplicates([tid]).select(*docs.columns)
