"""Spelling variants: words one edit apart, found through Bloom-guided neighbourhoods.

The vocabulary is counted on Spark.  Its words go into blocked Bloom filters, one for each word length, which are broadcast.
Tasks generate the edits of their words and probe the filters; only edits that a filter may hold are shuffled, to an exact
join with the vocabulary, which removes the false ones.  A deletion reaches the shorter word of a pair and a replacement by a
later letter the later one, so each pair is met once and insertions need not be generated.

A word's key is the sum, modulo 2^64, of a pseudorandom number for each (place, letter), so an edit's key takes one addition.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lamella.llm.common import arrow_batches, ascii_lower, written
from lamella.llm.sharding import crc32_sql, crc_table_sql

#: Letters that words are made of, after lower-casing A-Z; code points are all below 256.
LETTERS = np.r_[np.arange(ord("a"), ord("z") + 1), np.arange(0xC0, 0x100)].astype(np.uint64)
#: Words of this length and longer share one filter.
LONG = 64
#: A block is 256 bits: eight lanes of 32, a bit in each.
LANES, BITS_A_WORD, LEAST_BLOCKS = 8, 16, 1024
#: Edits that a task holds at once, and letters of its words.
EDITS, HELD = 1 << 21, 1 << 22
U = np.uint64


def number(place: np.ndarray, letter) -> np.ndarray:
    """The pseudorandom 64-bit number of a letter at a place."""
    with np.errstate(over="ignore"):
        x = (np.asarray(place, U) << U(8) | np.asarray(letter, U)) * U(0x9E3779B97F4A7C15) + U(0x9E3779B97F4A7C15)
        x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
        x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
        return x ^ x >> U(31)


def length_number(n: int) -> np.uint64:
    return number(np.uint64(1 << 40), U(0)) * U(2 * n + 1)


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, typo_every: int = 199) -> DataFrame:
    """``word``, a row for each run of letters that counts: lower-cased, of ``min_length`` letters and more.

    Every run whose checksum with the document's id is a multiple of ``typo_every`` loses a letter first.
    """
    runs = docs.select(F.coalesce(docs[f"`{id_col}`"].cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(ascii_lower(docs[f"`{text_col}`"]), F.lit(f"[a-zÀ-ÿ]{{{min_length},}}"), 0)).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    n = F.length("run")
    at = (h % n).cast("int")
    hurt = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, n))
    return runs.select(F.when(h % typo_every == 0, hurt).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_length)


def keyed(vocabulary: DataFrame) -> DataFrame:
    """``vocabulary`` (``word, n``) with ``len`` and ``key``."""
    def run(batches):
        for b in batches:
            keys = [key(w.encode("latin-1")) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.array(keys, U).view(np.int64))], ["word", "n", "len", "key"])

    def key(w: bytes) -> np.uint64:
        with np.errstate(over="ignore"):
            return number(np.arange(len(w)), np.frombuffer(w, np.uint8)).sum(dtype=U) + length_number(len(w))

    return vocabulary.select("word", "n", F.length("word").alias("len")).mapInArrow(run, "word string, n long, len int, key long")


def filters(vocabulary: DataFrame, max_mb: int) -> dict[int, np.ndarray]:
    """For each length a blocked Bloom filter, as blocks x lanes of uint32; all together at most about ``max_mb``.

    Each word sets a bit in each lane of one block; blocks are united on Spark, and only they reach the driver.
    """
    shard = F.least("len", F.lit(LONG))
    count = {r[0]: r[1] for r in vocabulary.groupBy(shard.alias("s")).count().collect()}  # at most LONG rows
    block_bits = 32 * LANES
    wanted = {s: max(LEAST_BLOCKS, -(-n * BITS_A_WORD // block_bits)) for s, n in count.items()}
    share = min(1.0, (max_mb << 20) * 8 / block_bits / max(1, sum(wanted.values())))
    blocks = {s: max(LEAST_BLOCKS, int(w * share)) for s, w in wanted.items()}
    if not blocks:
        return {}
    many = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])
    own = vocabulary.select(shard.alias("s"), "key").withColumn("block", F.shiftright(F.shiftrightunsigned("key", 40) * many[F.col("s")], 24).cast("int"))
    rows = own.groupBy("s", "block").agg(*[F.expr(f"bit_or(shiftleft(1, cast(shiftright(key, {5 * i}) & 31 as int)))").alias(f"l{i}") for i in range(LANES)]).toArrow()
    out = {s: np.zeros((n, LANES), np.uint32) for s, n in blocks.items()}
    at, block = rows.column("s").to_numpy(), rows.column("block").to_numpy()
    lanes = np.stack([rows.column(f"l{i}").to_numpy().astype(np.int32).view(np.uint32) for i in range(LANES)], 1)
    for s in out:
        out[s][block[at == s]] = lanes[at == s]
    return out


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Indexes of the keys that the filter may hold."""
    left = np.arange(len(keys))
    flat = table.reshape(-1)
    at = (((keys >> U(40)) * U(len(table))) >> U(24)).astype(np.int64) * LANES
    for i in range(LANES):
        set_ = flat[at + i] >> (keys >> U(5 * i) & U(31)).astype(np.uint32) & np.uint32(1)
        ok = np.flatnonzero(set_)
        left, keys, at = left[ok], keys[ok], at[ok]
    return left


def edits(own: list[bytes], tables: dict[int, np.ndarray]):
    """Pairs (index of a word, edit) whose edit a filter may hold. All words of ``own`` have one length."""
    n = len(own[0])
    letters = np.frombuffer(b"".join(own), np.uint8).reshape(len(own), n)
    place = np.arange(n)
    numbers = number(place, letters)
    with np.errstate(over="ignore"):
        total = numbers.sum(1, dtype=U)
        shorter = tables.get(min(n - 1, LONG))
        if shorter is not None:
            # before a place as they are, behind it a place to the left
            ahead = np.cumsum(numbers, 1, dtype=U) - numbers
            moved = number(np.maximum(place - 1, 0), letters)
            behind = np.cumsum(moved[:, ::-1], 1, dtype=U)[:, ::-1] - moved
            new = np.ones(letters.shape, bool)  # of equal letters in a row only the first is taken out
            new[:, 1:] = letters[:, 1:] != letters[:, :-1]
            i, p = np.nonzero(new)
            keys = ahead[i, p] + behind[i, p] + length_number(n - 1)
            for k in may_hold(shorter, keys).tolist():
                w = own[i[k]]
                yield int(i[k]), w[:p[k]] + w[p[k] + 1:]
        same = tables.get(min(n, LONG))
        if same is None:
            return
        wide = max(1, EDITS // (len(LETTERS) * len(own)))
        for lo in range(0, n, wide):
            here = letters[:, lo:lo + wide]
            rest = total[:, None] - numbers[:, lo:lo + wide] + length_number(n)
            keys = rest[:, :, None] + number(place[lo:lo + wide, None], LETTERS[None])[None]
            i, p, c = np.nonzero(LETTERS[None, None] > here[:, :, None])
            for k in may_hold(same, keys[i, p, c]).tolist():
                w, q = own[i[k]], lo + int(p[k])
                yield int(i[k]), w[:q] + bytes([int(LETTERS[c[k]])]) + w[q + 1:]


def near_words(vocabulary: DataFrame, max_mb: int = 64) -> DataFrame:
    """``word, n, near, near_n``, both ways, for all pairs of ``vocabulary`` (keyed, written) one edit apart.

    The filters' size is bounded by ``max_mb``; beyond some 30 million words more false edits reach the join, and no pair is lost.
    """
    spark = vocabulary.sparkSession
    tables = spark.sparkContext.broadcast(filters(vocabulary, max_mb))

    def run(batches):
        for b in batches:
            all_words, n = [w.encode("latin-1") for w in b.column("word").to_pylist()], b.column("n").to_numpy()
            by_length: dict[int, list[int]] = {}
            for i, w in enumerate(all_words):
                by_length.setdefault(len(w), []).append(i)
            for length, rows in by_length.items():
                many = max(1, min(EDITS // (len(LETTERS) * 4), HELD // length))
                for lo in range(0, len(rows), many):
                    part = rows[lo:lo + many]
                    word, count, near, size = [], [], [], 0
                    for i, e in edits([all_words[k] for k in part], tables.value):
                        word.append(all_words[part[i]].decode("latin-1"))
                        count.append(n[part[i]])
                        near.append(e.decode("latin-1"))
                        size += length
                        if size > HELD:
                            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(count, pa.int64()), pa.array(near, pa.string())], ["word", "n", "near"])
                            word, count, near, size = [], [], [], 0
                    yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(count, pa.int64()), pa.array(near, pa.string())], ["word", "n", "near"])

    found = vocabulary.select("word", "n").mapInArrow(run, "word string, n long, near string")
    pairs = found.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    one = F.struct("word", "n", "near", "near_n")
    other = F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.select(F.explode(F.array(one, other)).alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``forms`` (``word, form``): the end of the chain of forms, by pointer jumping.

    A form's count is a multiple of its word's, so chains are short: with five-fold counts 27 steps at most, five jumps.
    """
    at = written(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if at.join(onward, "root", "left_semi").isEmpty():
            return at
        at = written(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, ratio: int = 5,
                      typo_every: int = 199, max_mb: int = 64) -> DataFrame:
    """``word, form, root, n, n_near, form_n``, a row for each word of ``min_count`` occurrences and more in whole texts.

    Two words are near if one letter inserted, deleted or replaced makes one of the other.  ``form`` is the near word of
    largest count (ties: the first in code-point order) where that is at least ``ratio`` (2 or more) times the word's count.
    Null and empty texts have no words; a null id stands as an empty one; repeated rows count each time; words of any length
    are taken whole; no words give no rows.
    """
    if ratio < 2:
        raise ValueError("a ratio below 2 could chain words in a circle")
    spark = docs.sparkSession
    counted = words(docs, id_col, text_col, min_length, typo_every).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    with arrow_batches(spark, 4096):
        vocabulary = written(keyed(written(counted)))
        near = written(near_words(vocabulary, max_mb).groupBy("word").agg(
            F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form"))).alias("best")))
    d = vocabulary.select("word", "n").join(near, "word", "left")
    better = -F.col("best.m") >= F.lit(ratio) * F.col("n")
    d = written(d.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                         F.when(better, F.col("best.form")).alias("form"), F.when(better, -F.col("best.m")).alias("form_n")))
    d = d.join(roots(d.where("form IS NOT NULL")), "word", "left")
    return d.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def sql(min_length: int = 6, min_count: int = 5, ratio: int = 5, typo_every: int = 199) -> str:
    """Near words share what is left when one place is masked or taken out."""
    return f"""
WITH RECURSIVE crc_table AS ({crc_table_sql()}),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents),
long_runs AS (SELECT id, run, count(*) AS c FROM runs WHERE length(run) >= {min_length} GROUP BY ALL),
marked AS (SELECT run, c, {crc32_sql("id || ':' || run")} AS h FROM long_runs, crc_table),
w AS (SELECT CASE WHEN h % {typo_every} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM marked),
v AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= {min_length} GROUP BY word HAVING sum(c) >= {min_count}),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v),
masked AS (SELECT word, n, p, left(word, p - 1) AS a, substr(word, p + 1) AS b FROM cut),
replaced AS (SELECT x.word, y.word AS near, y.n AS near_n FROM masked x JOIN masked y USING (p, a, b) WHERE x.word <> y.word),
deleted AS (SELECT DISTINCT m.word, m.n, v.word AS near, v.n AS near_n FROM masked m JOIN v ON v.word = m.a || m.b),
near AS (SELECT * FROM replaced UNION ALL SELECT word, near, near_n FROM deleted UNION ALL SELECT near, word, n FROM deleted),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM near GROUP BY word),
named AS (SELECT word, any_value(n_near) AS n_near, any_value(most) AS most, min(near) AS form FROM near JOIN best USING (word) WHERE near_n = most GROUP BY word),
formed AS MATERIALIZED (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {ratio} * n THEN form END AS form, CASE WHEN most >= {ratio} * n THEN most END AS form_n FROM v LEFT JOIN named USING (word)),
chain AS (SELECT word, word AS here, 0 AS k FROM formed UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN formed f ON f.word = c.here WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, k) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""
