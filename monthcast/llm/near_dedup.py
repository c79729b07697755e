"""Near-duplicate detection: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from monthcast.llm.tables import bounded_batches, connected, stored
from monthcast.llm.words import WORD_BASE, Words, chunks, mix, spans, texts, windows

#: Words of a shingle; links need 100 * common >= PERCENT * union.
SHINGLE = 2
PERCENT = 80
#: Bands of rows: a pair of similarity 0.8 misses every band with a probability of 5e-6.
BANDS = 40
ROWS = 6
#: Pairs whose own sketches agree on a smaller share are not compared. At
#: similarity 0.8 the share is 0.8 with a standard deviation of 0.026.
LEAST_AGREEMENT = 0.68
#: Texts compared at once.
CHUNK = 192
#: Members of a band that are compared at once, a text of many shingles counting as several.
BAND_CHUNK = 2048
SHINGLES = 512
#: Shingles that more sets share are counted by products of matrices, others pair by pair.
DENSE = 48


def shingles(words: Words, length: int = SHINGLE, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text: text, hash, sorted. A shorter text is one shingle as a whole."""
    count = words.counts()
    hashes = words.hashes(which)
    h = windows(hashes, length, which)
    doc = words.doc[: len(h)]
    inside = doc == words.doc[length - 1 :] if len(h) else np.zeros(0, bool)
    h, doc = h[inside], doc[inside]
    for n in range(1, length):  # texts of fewer words
        at = words.first[:-1][count == n]
        if len(at):
            whole = windows(hashes, n, which)[at] ^ mix(np.full(1, n, np.uint64))
            h, doc = np.concatenate([h, whole]), np.concatenate([doc, words.doc[at]])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    return doc[new], h[new]


EMPTY = np.iinfo(np.uint64).max


def sketches(doc: np.ndarray, h: np.ndarray, sets: int, size: int) -> np.ndarray:
    """Fast similarity sketch of each set: ``size`` coordinates, all filled.

    In round i every element draws a bin and a value between i and i + 1, and
    a bin keeps its least value. The first ``size`` rounds draw bins at
    random; in the next ``size`` rounds all elements draw the same bin, one
    after the other, so every bin fills in the end. A set leaves when its
    bins are full, for later values are larger: about size * log(size) draws
    instead of size for each element. Two sets agree in a coordinate with the
    probability of their similarity, and the share of agreeing coordinates is
    at least as concentrated as for independent coordinates. Empty sets keep
    empty sketches.
    """
    out = np.full((sets, size), EMPTY, np.uint64)
    flat, i = out.reshape(-1), 0
    while len(h) and i < 2 * size:
        for j in range(i, min(2 * size, i + max(1, min(32, (1 << 19) // len(h))))):
            drawn = mix(h + np.uint64(WORD_BASE[0] * (j + 1) % (1 << 64)))
            value = mix(drawn) >> np.uint64(16) | np.uint64(j << 48)
            own = (drawn >> np.uint64(32)) * np.uint64(size) >> np.uint64(32) if j < size else np.uint64(j - size)
            np.minimum.at(flat, doc * size + np.int64(own) if j >= size else doc * size + own.astype(np.int64), value)
            i = j + 1
        open_ = (out == EMPTY).any(axis=1)[doc]
        doc, h = doc[open_], h[open_]
    return out


def bands(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for every ``rows`` coordinates."""
    part = sketch.reshape(len(sketch), -1, rows)
    key = np.broadcast_to(np.arange(part.shape[1], dtype=np.uint64), part.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * np.uint64(WORD_BASE[1]) + part[:, :, r])
    return key


def _scan(batches: Iterator[pa.RecordBatch], length: int, size: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Size, digest, band keys and one byte of each coordinate, for every text."""
    for batch in batches:
        for first, part in chunks(texts(batch.column("text"))):
            n = len(part)
            doc, h = shingles(Words.of(part, lower=True), length)
            count = np.bincount(doc, minlength=n)
            edge = np.concatenate([[0], np.cumsum(count)])
            digest = [spans(x, edge[:-1], edge[1:], WORD_BASE[0]) for x in (h, mix(h))]
            sketch = sketches(doc, h, n, size)
            keys = bands(sketch, rows).view(np.int64).reshape(-1)
            flat = pa.array(keys)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (size // rows))
            low = (sketch & np.uint64(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(first, n).cast(pa.int64()),
                    pa.array(count, pa.int64()),
                    pa.array(digest[0].view(np.int64)),
                    pa.array(digest[1].view(np.int64)),
                    pa.ListArray.from_arrays(offsets, flat),
                    pa.array([r.tobytes() for r in low], pa.binary()),
                ],
                ["id", "n", "s1", "s2", "bands", "sketch"],
            )


@F.pandas_udf(DoubleType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of coordinates in which two sketches agree."""
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).mean(axis=1) if len(a) else np.zeros(0))


def alike(doc: np.ndarray, h: np.ndarray, n: int, percent: int = PERCENT) -> np.ndarray:
    """Which of n sets are linked, from the sizes of their intersections: a square of booleans. Elements by set, in any order."""
    size = np.bincount(doc, minlength=n).astype(float)
    order = np.lexsort((doc, h))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
    times = np.diff(np.r_[first, len(h)])
    common = np.zeros((n, n), np.float32)
    few = np.repeat((times > 1) & (times <= DENSE), times)
    d, t = doc[few], np.repeat(np.arange(len(times)), times)[few]
    for step in range(1, int(times[times <= DENSE].max(initial=1))):
        same = np.flatnonzero(t[:-step] == t[step:])
        np.add.at(common, (d[same], d[same + step]), 1)
    common += common.T
    dense = first[times > DENSE], times[times > DENSE]
    for low in range(0, len(dense[0]), 1024):
        start, many = (x[low : low + 1024] for x in dense)
        at = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())
        has = np.zeros((n, len(many)), np.float32)
        has[doc[at], np.repeat(np.arange(len(many)), many)] = 1
        common += has @ has.T
    linked = np.zeros((n, n), bool)
    for low in range(0, n, 256):  # in doubles: exact at any size
        c, own = common[low : low + 256].astype(float), size[low : low + 256, None]
        linked[low : low + 256] = (100 * c >= percent * (own + size - c)) & (own > 0) & (size > 0)
    np.fill_diagonal(linked, size > 0)
    return linked


def links(part: list[bytes], length: int = SHINGLE, percent: int = PERCENT) -> np.ndarray:
    """Which of a few texts are linked: a square of booleans."""
    doc, h = shingles(Words.of(part, lower=True), length)
    return alike(doc, h, len(part), percent)


def _joined(near: np.ndarray, name: np.ndarray) -> pa.Table:
    """As few links as join the names of what hangs together: (u, v). Places with one name hang together."""
    _, same = np.unique(name, return_inverse=True)
    root = np.arange(len(name))
    while True:
        low = np.minimum(root, np.where(near, root[None, :], len(name)).min(axis=1, initial=len(name)))
        least = np.full(same.max(initial=-1) + 1, len(name))
        np.minimum.at(least, same, low)
        low = least[same]
        low = np.minimum(low, low[low])
        if (low == root).all():
            break
        root = low
    pairs = np.unique(np.stack([name, name[root]], axis=1)[name != name[root]], axis=0)
    return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})


def _compare(group: pa.Table, length: int, percent: int) -> pa.Table:
    """Links among the texts of one comparison, as few as keep its components: (u, v)."""
    first = dict(zip(group["node"].to_pylist(), texts(group["text"].combine_chunks()).to_pylist(), strict=True))
    node = np.array(sorted(first), np.int64)
    return _joined(links([first[k] for k in node.tolist()], length, percent), node)


def _verify(group: pa.Table, percent: int) -> pa.Table:
    """Links among the components of the sets of one unit, as few as join them: (u, v)."""
    order = np.argsort(group["node"].to_numpy(), kind="stable")
    sets = [np.frombuffer(x, np.uint64) for x in group["set"].take(pa.array(order)).to_pylist()]
    doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    return _joined(alike(doc, np.concatenate(sets), len(sets), percent), group["component"].to_numpy()[order])


def _sets(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The shingle hashes of every text as bytes."""
    for batch in batches:
        for first, part in chunks(texts(batch.column("text"))):
            doc, h = shingles(Words.of(part, lower=True), length)
            edge = np.searchsorted(doc, np.arange(len(part) + 1))
            each = pa.array([h[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(first, len(part)), each], ["node", "set"])


UNIT = "unit long, node long, component long"


def _units(group: pa.Table) -> pa.Table:
    """Members of each band that have to be compared on full sets: (unit, node, component).

    Asking members are held against the asked ones of their band. A member is
    returned, once, if its sketch agrees with that of a member of another
    component with which it was not compared on full sets before and shares
    no band of a smaller number, where the pair is seen to.
    """
    group = group.combine_chunks()
    column = {k: group[k].to_numpy() for k in ("unit", "at", "node", "component", "cluster", "chunk", "asks", "asked")}
    low = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(len(group), -1)
    bands_ = group["bands"].combine_chunks().flatten().to_numpy().reshape(len(group), -1)
    order = np.argsort(column["unit"], kind="stable")
    unit = column["unit"][order]
    component, cluster, chunk = (column[k] for k in ("component", "cluster", "chunk"))
    found = np.zeros(len(group), bool)
    for at in np.split(order, np.flatnonzero(unit[1:] != unit[:-1]) + 1):
        x, y = at[column["asks"][at]], at[column["asked"][at]]
        number = int(column["at"][at[0]])
        for first in range(0, len(x), 256):
            a = x[first : first + 256]
            open_ = component[a][:, None] != component[y][None, :]
            done = (chunk[a][:, None] == chunk[y][None, :]) | (chunk[a] == 0)[:, None] | (chunk[y] == 0)[None, :]
            u, v = np.nonzero(open_ & ~(done & (cluster[a][:, None] == cluster[y][None, :])))
            for part in range(0, len(u), 1 << 14):
                s, t = a[u[part : part + (1 << 14)]], y[v[part : part + (1 << 14)]]
                near = (low[s] == low[t]).mean(axis=1) >= LEAST_AGREEMENT
                near[near] = ~(bands_[s[near], :number] == bands_[t[near], :number]).any(axis=1)
                found[s[near]] = found[t[near]] = True
    return pa.table({k: pa.array(column[k][found]) for k in ("unit", "node", "component")})


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = SHINGLE,
    percent: int = PERCENT,
    bands_: int = BANDS,
    rows: int = ROWS,
    chunk: int = CHUNK,
    band_chunk: int | None = None,
) -> DataFrame:
    """id_col, n_shingles, component_id, kept for every row of ``docs``.

    Words are lower-cased (A-Z) runs without white space; a text's set holds
    its distinct runs of ``length`` words, or all its words if it has fewer.
    Rows are linked if 100 * common >= percent * union. component_id is the
    smallest id reachable by links, kept whether that is the row's own.

    1. Texts with equal sets are one node, named by their smallest id.
    2. Nodes that share a band of their sketches are joined to the smallest
       node of the band, unless their sketches show that they are far apart;
       what hangs together is a cluster, the candidates.
    3. A cluster is compared on full sets in chunks: every chunk in itself
       and with the first one. Links found make components.
    4. In each band the members outside its most frequent component so far
       are held against all its members by their sketches, whatever their
       clusters. A pair of different components that agrees is seen to in
       the first band it shares. Members with such a pair are a unit, which
       is compared on full sets in one task and returns as few links as join
       its components. So every pair of a band is judged by its own sketches
       or linked already, no pair is judged by a third text, and no list of
       pairs is made: a unit has as many rows as members.
    5. Components of the links found, over all components of step 3.

    Members of a band beyond ``band_chunk`` are dealt to parts, and units hold
    the parts two by two. A family of more texts of 0.68 to 0.8 similarity
    than that, without links, therefore costs rows in proportion to its size
    times its parts, and comparisons to its square.

    Null and empty texts have no shingles and are linked with nothing: their
    component is their own id. A null id takes the component of the other
    rows with an equal set, null if there is none. Repeated rows share all
    values. Ids are whole numbers. No rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    size, band_chunk = bands_ * rows, band_chunk or BAND_CHUNK
    rows_ = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scan = stored(
        rows_.mapInArrow(
            lambda b: _scan(b, length, size, rows), "id long, n long, s1 long, s2 long, bands array<long>, sketch binary"
        ),
        "sketches",
    )
    sets = scan.where("n > 0").groupBy("s1", "s2")
    # Written, so that the last join has a plain shuffle on either side and Spark can split a large group.
    nodes = stored(sets.agg(F.min("id").alias("node"), F.first("n").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    known = nodes.where("node is not null")

    at = known.select("node", "size", F.posexplode("bands").alias("at", "band"))
    centers = stored(at.groupBy("band").agg(F.min("node").alias("center"), F.count("*").alias("c")).where("c > 1").drop("c"), "bands")
    shared = stored(at.join(centers, "band"), "shared")
    pairs = shared.where("node != center").select("node", "center").distinct()
    sketch = known.select("node", "sketch")
    pairs = pairs.join(sketch, "node").join(sketch.select(F.col("node").alias("center"), F.col("sketch").alias("s")), "center")
    clusters = connected(
        pairs.where(agreement("sketch", "s") >= LEAST_AGREEMENT).select(F.col("node").alias("u"), F.col("center").alias("v"))
    )
    chunks_ = clusters.groupBy("component").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    members = clusters.join(stored(chunks_, "chunks"), "component").select(
        "node", F.col("component").alias("cluster"), "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk")
    )
    members = stored(members, "members")
    found = members.join(rows_.withColumnRenamed("id", "node"), "node")
    found = stored(found.select("cluster", "chunks", "chunk", "node", "text"), "found")

    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    first = found.withColumn("with", F.explode(F.when(F.col("chunk") == 0, every).otherwise(F.array("chunk"))))
    compare = lambda t: _compare(t, length, percent)
    near = stored(first.groupBy("cluster", "with").applyInArrow(compare, "u long, v long"), "links")

    # Members of the bands that hold pairs not settled so far.
    linked = stored(connected(near), "linked")
    seen = shared.join(members, "node", "left").join(linked, "node", "left")
    seen = seen.select(
        "band", "at", "node", F.coalesce("component", "node").alias("component"), F.coalesce("cluster", "node").alias("cluster"),
        F.coalesce("chunks", F.lit(1)).alias("chunks"), F.coalesce("chunk", F.lit(0)).alias("chunk"),
        (1 + F.col("size") / SHINGLES).cast("long").alias("weight"),
    )
    seen = stored(seen, "seen")
    parts = seen.groupBy("band", "component").agg(
        F.sum("weight").alias("weight"), F.count("*").alias("count"),
        F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.max("chunks").alias("chunks"),
    )
    open_ = parts.groupBy("band").agg(
        F.max(F.struct("weight", "component")).alias("m"), F.sum("weight").alias("all"), F.sum("count").alias("members"),
        F.count("*").alias("parts"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("chunks").alias("chunks"),
    )
    # A band of two has been judged by its sketches, a cluster of one chunk on full sets.
    unsettled = F.when(F.col("low") == F.col("high"), F.col("chunks") > 1).otherwise(F.col("members") > 2)
    open_ = open_.where((F.col("parts") > 1) & unsettled).select(
        "band", F.col("m.component").alias("main"),
        F.ceil(F.col("all") / band_chunk).cast("int").alias("n"),
        F.ceil((F.col("all") - F.col("m.weight")) / band_chunk).cast("int").alias("strays"),
    )
    asked = seen.join(stored(open_, "open"), "band").withColumn("stray", F.col("component") != F.col("main"))
    asked = stored(asked, "asked")
    buckets = 1 + asked.count() // (4 * band_chunk)
    own = [F.pmod(F.xxhash64(F.lit(k), "node"), F.col(n)).cast("int") for k, n in ((1, "strays"), (2, "n"))]
    role = lambda i, j, asks, asked: F.struct(
        i.alias("i"), j.alias("j"), F.lit(asks).alias("asks"), F.lit(asked).alias("asked")
    )
    asking = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: role(own[0], j, True, False))
    roles = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("strays") - 1), lambda i: role(i, own[1], False, True)),
        F.when(F.col("stray"), asking).otherwise(F.slice(asking, 1, 0)),
    )
    whole = F.array(role(F.lit(0), F.lit(0), F.col("stray"), True))
    asked = asked.select(
        "band", "at", "node", "component", "cluster", "chunk", "n",
        F.explode(F.when(F.col("n") > 1, roles).otherwise(whole)).alias("r"),
    ).select("*", "r.*", F.xxhash64("band", "r.i", "r.j").alias("unit"))
    bucket = F.when(F.col("n") > 1, F.col("unit")).otherwise(F.pmod("unit", F.lit(buckets)))
    asked = asked.select(
        bucket.alias("bucket"), "unit", "at", "node", "component", "cluster", "chunk", "asks", "asked"
    ).join(known.select("node", "sketch", "bands"), "node")
    units = stored(asked.groupBy("bucket").applyInArrow(_units, UNIT).distinct(), "units")
    some = stored(units.select("node").distinct(), "compared").join(rows_.withColumnRenamed("id", "node"), "node")
    some = stored(some.mapInArrow(lambda b: _sets(b, length), "node long, set binary").dropDuplicates(["node"]), "sets")
    more = units.join(some, "node").groupBy("unit").applyInArrow(lambda t: _verify(t, percent), "u long, v long")
    above = connected(more).select(F.col("node").alias("component"), F.col("component").alias("top"))
    every = linked.select("node", "component").union(above.select(F.col("component").alias("node"), F.col("component")))
    components = every.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    components = stored(components.groupBy("node").agg(F.min("component").alias("component")), "components")
    named = nodes.select("s1", "s2", "node").join(components, "node", "left")
    named = stored(named.select("s1", "s2", F.coalesce("component", "node").alias("component")), "named")
    out = scan.select("id", "n", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are their component's smallest id, all columns as they are.

    Rows repeated with that id all stay; rows with a null id stay, for they
    cannot be told apart. Only the ids of rows that go are joined.
    """
    gone = near_duplicates(docs, id_col, text_col, **options).where(~F.col("kept") & F.col(id_col).isNotNull())
    gone = gone.select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
