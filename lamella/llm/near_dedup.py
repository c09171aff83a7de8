"""Near-duplicate documents by SetSketch registers.

A sketch holds ``m`` registers; register j is ``floor(1 - log_b(min_j))``, cut to 0 .. q + 1, of the least of the elements'
exponentially distributed hash values.  Registers merge by maximum and two sets agree in one with a chance close to their
Jaccard similarity.  The steps:

1. one row for each different shingle set (copies are one node);
2. bands of register values make buckets; each bucket's best connected member, its hub, is paired with the others;
3. pairs whose joint likelihood (registers and set sizes) allows the threshold are verified on the full sets, and linked
   sets are contracted into components;
4. buckets that still hold several components are compared in blocks inside tasks: pairs across components whose
   likelihood allows the threshold are verified on the full sets there and then, and only links become rows.

Pairs inside a component need no test, so a group of copies is never expanded into pairs.  A pair at the threshold shares
no bucket with a chance of (1 - 0.85^6)^40, less than 1e-8.
"""
from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lamella.llm.common import small_batches, written
from lamella.llm.graph import components



@dataclass(frozen=True)
class SketchSpec:
    """``bands`` x ``rows`` registers of base ``base`` and rate ``rate``; 16 bits each."""
    bands: int = 40
    rows: int = 6
    base: float = 1.001
    rate: float = 20.0
    seed: int = 2024

    @property
    def m(self) -> int:
        return self.bands * self.rows

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.integers(0, 1 << 32, self.m, dtype=np.uint32), rng.integers(0, 1 << 31, self.m, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


class WordHash(dict):
    """64-bit hashes of words, remembered for a task; forgotten beyond ``limit`` words."""
    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles; of all words if they are fewer; empty without words."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    w = min(n, k)
    out = np.full(n - w + 1, w, np.uint64)
    for i in range(w):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + len(out)])
    return np.unique(out)


def registers(elements: np.ndarray, spec: SketchSpec, hashes=None) -> np.ndarray:
    """uint16 registers of a non-empty set, over chunks of elements, so memory doesn't grow with the text."""
    c, a = hashes or spec.hashes()
    least = np.full(spec.m, 0xFFFFFFFF, np.uint32)
    x = (elements >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 256):
        y = x[at:at + 256, None] ^ c
        y *= a
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(least, y.min(axis=0), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0 ** 32
    k = np.floor(1 - np.log(-np.log1p(-u) / spec.rate) / np.log(spec.base))
    return np.clip(k, 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def likelihood_slope(above: np.ndarray, below: np.ndarray, m: int, na: np.ndarray, nb: np.ndarray, jaccard: float, base: float) -> np.ndarray:
    """Slope of the joint log likelihood at ``jaccard``, given how many registers of a lie above and below b's.

    The likelihood is concave, so a slope of 0 or more says that its maximum, the estimate, is at ``jaccard`` or above.
    """
    u = na / (na + nb)
    v = 1 - u
    f, lb = (base - 1) / base, np.log(base)
    x, y = np.maximum(u - v * jaccard, 1e-12), np.maximum(v - u * jaccard, 1e-12)
    p, q = -np.log1p(-f * x) / lb, -np.log1p(-f * y) / lb
    dp, dq = -v * f / (1 - f * x) / lb, -u * f / (1 - f * y) / lb
    return above * dp / p + below * dq / q - (m - above - below) * (dp + dq) / np.maximum(1 - p - q, 1e-12)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, spec: SketchSpec = SketchSpec()) -> DataFrame:
    """``id, n_shingles, set_key, registers`` for each row; the last two are null for an empty set."""
    small_batches(docs.sparkSession)
    given = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))

    def run(batches):
        words, hashes = WordHash(), spec.hashes()
        for b in batches:
            n, key, regs = [], [], []
            with np.errstate(over="ignore"):
                for t in b.column("text"):
                    s = shingle_set(t.as_py(), k, words)
                    n.append(len(s))
                    key.append(set_key(s))
                    regs.append(registers(s, spec, hashes).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(regs, pa.binary())],
                                             ["id", "n_shingles", "set_key", "registers"])

    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, n_shingles long, set_key binary, registers binary")


def set_key(s: np.ndarray) -> bytes | None:
    """16 bytes of digest of a set, its name as a node; none for the empty set."""
    return blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """``id`` (the set's key) and ``shingles array<long>`` of a column ``text``."""
    def run(batches):
        words = WordHash()
        for b in batches:
            with np.errstate(over="ignore"):
                sets = [shingle_set(t.as_py(), k, words) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "shingles"])

    return texts.select("text").mapInArrow(run, "id binary, shingles array<long>")


def likely(pairs: DataFrame, nodes: DataFrame, floor: float, ratio: float, spec: SketchSpec) -> DataFrame:
    """Pairs (``a``, ``b``) whose set sizes and joint likelihood allow the threshold; ``floor`` lies five deviations below it."""
    x = nodes.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
    y = nodes.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))
    d = pairs.join(x, "a").join(y, "b").where(F.least("na", "nb") >= ratio * F.greatest("na", "nb"))

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            ra, rb = (np.frombuffer(b"".join(c), "<u2").reshape(-1, spec.m) for c in (b["ra"], b["rb"]))
            slope = likelihood_slope((ra > rb).sum(1), (ra < rb).sum(1), spec.m, b["na"].to_numpy(), b["nb"].to_numpy(), floor, spec.base)
            yield b.loc[slope >= 0, ["a", "b"]]

    return d.select("a", "b", "na", "nb", "ra", "rb").mapInPandas(run, "a binary, b binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have ``100 * intersection >= percent * union``. ``sets``: ``id, shingles``."""
    d = (pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
         .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a"))
    common = F.size(F.array_intersect("sa", "sb"))
    d = d.select("a", "b", common.alias("x"), (F.size("sa") + F.size("sb")).alias("n"))
    return d.where(F.lit(100) * F.col("x") >= F.lit(percent) * (F.col("n") - F.col("x"))).select("a", "b")


RUN = ["key", "lo", "hi", "_own", "band", "id", "comp", "n_shingles", "registers"]
RUN_SCHEMA = "key long, lo int, hi int, _own int, band int, id binary, comp binary, n_shingles long, registers binary"


def dealt(rest: DataFrame, block: int = 1024) -> DataFrame:
    """Buckets' members dealt into runs. A bucket of ``n`` members has about ``n / block`` blocks, and any two of them meet in
    one run (``key, lo, hi``). ``rest``: ``key, band, n, id, comp, n_shingles, registers``."""
    blocks = F.ceil(F.col("n") / block)
    d = rest.withColumn("_own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    d = d.withColumn("_other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    return d.withColumn("lo", F.least("_own", "_other")).withColumn("hi", F.greatest("_own", "_other")).select(*RUN)


def by_run(d: DataFrame, work, schema: str) -> DataFrame:
    """``work(columns of one run)`` for each run of ``d``, one at a time; it yields pandas frames."""
    def run(batches):
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            if not len(b):
                continue
            c = {n: b[n].to_numpy() for n in b.columns}
            new = (c["key"][1:] != c["key"][:-1]) | (c["lo"][1:] != c["lo"][:-1]) | (c["hi"][1:] != c["hi"][:-1])
            cut = [0, *(np.flatnonzero(new) + 1).tolist()]
            for s, e in zip(cut[:-1], cut[1:]):
                yield from work({n: x[s:e] for n, x in c.items()})
            held = b.iloc[cut[-1]:]
        if held is not None and len(held):
            yield from work({n: held[n].to_numpy() for n in held.columns})

    return d.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "id").mapInPandas(run, schema)


def run_pairs(c: dict, spec: SketchSpec, floor: float, ratio: float):
    """(i, its later partners, registers they share) in a run: across components, in the first band they share, and with a
    likelihood that allows the threshold."""
    comp, own, size, band = c["comp"], c["_own"], c["n_shingles"], int(c["band"][0])
    if (comp == comp[0]).all():
        return
    regs = np.frombuffer(b"".join(c["registers"]), "<u2").reshape(-1, spec.m)
    single = c["lo"][0] == c["hi"][0]
    for i in range(len(comp) - 1):
        ok = (comp[i + 1:] != comp[i]) & (np.minimum(size[i + 1:], size[i]) >= ratio * np.maximum(size[i + 1:], size[i]))
        if not single:
            ok &= own[i + 1:] != own[i]
        j = np.flatnonzero(ok) + i + 1
        if len(j):
            same = regs[j] == regs[i]
            banded = same.reshape(len(j), spec.bands, spec.rows).all(2)
            first = banded[:, band] & ~banded[:, :band].any(1)
            j, same = j[first], same[first]
        if len(j):
            slope = likelihood_slope((regs[i] > regs[j]).sum(1), (regs[i] < regs[j]).sum(1), spec.m, np.full(len(j), size[i]), size[j], floor, spec.base)
            if (slope >= 0).any():
                yield i, j[slope >= 0], same[slope >= 0].sum(1)


def across(rest: DataFrame, sets: DataFrame, spec: SketchSpec, floor: float, ratio: float, percent: int) -> DataFrame:
    """Links (``a``, ``b``) between components inside buckets, verified on the full sets where the pairs are found.

    A first pass over the registers finds the members that have a likely partner in their run; only they get their sets.  The
    second verifies likely pairs, best first, and joins components as it goes, so a run of n members yields less than n links
    and pairs never become rows.
    """
    def take_part(c):
        some = np.zeros(len(c["id"]), bool)
        for i, j, _ in run_pairs(c, spec, floor, ratio):
            some[i] = True
            some[j] = True
        if some.any():
            yield pd.DataFrame({n: c[n][some] for n in RUN})

    def verify(c):
        found = [(k, i, x) for i, j, same in run_pairs(c, spec, floor, ratio) for x, k in zip(j.tolist(), same.tolist())]
        root = {x: x for x in set(c["comp"])}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        links = []
        for _, i, j in sorted(found, key=lambda f: -f[0]):
            x, y = find(c["comp"][i]), find(c["comp"][j])
            if x == y:
                continue
            sa, sb = c["shingles"][i], c["shingles"][j]
            at = np.searchsorted(sb, sa)
            common = int((sb[np.minimum(at, len(sb) - 1)] == sa).sum())
            if 100 * common >= percent * (len(sa) + len(sb) - common):
                root[x] = y
                links.append((c["id"][i], c["id"][j]))
        if links:
            yield pd.DataFrame(links, columns=["a", "b"])

    members = written(by_run(dealt(rest), take_part, RUN_SCHEMA))
    sorted_sets = sets.select("id", F.sort_array("shingles").alias("shingles"))
    return by_run(members.join(sorted_sets, "id").select(*RUN, "shingles"), verify, "a binary, b binary")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, spec: SketchSpec = SketchSpec()) -> DataFrame:
    """One row for each row of ``docs``: ``id_col, n_shingles, component_id, kept``.

    Words are lower-cased A-Z; documents with ``100 * intersection >= percent * union`` of their shingle sets are linked and
    ``component_id`` is the smallest id reachable, which is kept.  A null, empty or blank text is linked with nothing; so is a
    row with a null id, which is kept under a null component.  Rows that repeat id and text share a component; all are kept
    if one is.
    """
    jaccard = percent / 100
    floor = max(0.01, jaccard - 5 * (jaccard * (1 - jaccard) / spec.m) ** 0.5)
    sk = written(sketches(docs, id_col, text_col, k, spec))
    full = sk.where("n_shingles > 0 AND id IS NOT NULL")
    # a node is a set; equal sets have equal sketches, and the smallest id names them
    nodes = written(full.groupBy("set_key").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
                    .withColumnRenamed("set_key", "id"))
    width = 2 * spec.rows
    bands = F.transform(F.sequence(F.lit(0), F.lit(spec.bands - 1)),
                        lambda i: F.struct(i.alias("band"), F.xxhash64(F.substring(F.col("registers"), i * width + 1, F.lit(width)), i).alias("key")))
    rows = nodes.select("id", F.explode(bands).alias("_b")).select("id", "_b.band", "_b.key")
    shared = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    member = written(rows.join(shared, "key"))
    if member.isEmpty():
        comp = None
    else:
        # the hub of a bucket: the member that shares most buckets with others
        degree = member.groupBy("id").agg(F.sum("n").alias("degree"))
        hubs = written(member.join(written(degree), "id").groupBy("key").agg(F.max_by("id", F.struct("degree", "id")).alias("hub")))
        star = member.join(hubs, "key").where("id != hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        star = written(likely(star, nodes, floor, jaccard, spec))
        near = written(member.select("id").distinct().join(nodes.select("id", "rep"), "id"))
        texts = docs.select(docs[f"`{id_col}`"].alias("rep"), docs[f"`{text_col}`"].alias("text"))
        sets = written(shingle_sets(texts.join(near.select("rep"), "rep", "left_semi"), k).join(near.select("id"), "id", "left_semi").dropDuplicates(["id"]))
        links = written(verified(star, sets, percent))
        comp = None if links.isEmpty() else components(links)
        named = member.withColumn("comp", F.col("id")) if comp is None else (
            member.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
        named = written(named)
        mixed_ = written(named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key"))
        rest = named.join(mixed_, "key", "left_semi").join(nodes, "id")
        more = written(across(rest, sets, spec, floor, jaccard, percent))
        if not more.isEmpty():
            comp = components(links.unionByName(more))
    named = nodes.select("id", "rep") if comp is None else nodes.select("id", "rep").join(comp, "id", "left")
    if comp is not None:
        group = F.coalesce("comp", "id")
        named = named.join(named.groupBy(group.alias("g")).agg(F.min("rep").alias("least")), group == F.col("g"))
    named = written(named.select(F.col("id").alias("set_key"), (F.col("rep") if comp is None else F.col("least")).alias("found")))
    out = sk.select("id", "n_shingles", "set_key").join(named, "set_key", "left")
    out = out.withColumn("comp", F.when(F.col("id").isNotNull(), F.coalesce("found", "id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", F.col("comp").alias("component_id"),
                      (F.col("id").isNull() | (F.col("id") == F.col("comp"))).alias("kept"))
