"""Mixing, packing, token files and archives: brute force and round trips."""
import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lamella.llm import mixing as M, packing as P, range_coder as R, token_file as T, warc as W
from lamella.llm.common import written
from lamella.llm.tokens import Encoder, tokenizer_path


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5000, "c": 7, None: 900}, {"x": 1}, {"a": 0, "b": 10}, {"a": 0}, {chr(65 + i): (i * 37) % 101 for i in range(30)}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in M.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_permuted_is_a_permutation():
    for n in (1, 2, 3, 5, 64, 1000):
        for key in (1, 99):
            p = M.permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(p.tolist()) == list(range(n))
    assert (M.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 1)) != M.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 2))).mean() > 0.9


@pytest.mark.parametrize("deck", [1 << 29, 500])
def test_slots_meet_the_totals(spark, monkeypatch, deck):
    monkeypatch.setattr(M, "DECK", deck)
    plan = spark.createDataFrame([(1, 100, 150), (2, 7, 14), (3, 1000, 900), (9, 1, 1)], "source_no long, blocks long, slots long")
    rows = M.slots(plan, 100, 7).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.slots(plan.repartition(3), 100, 7).collect()))
    per = defaultdict(Counter)
    for r in rows:
        per[r.source_no][r["index"]] += 1
    for no, blocks, slots in [(1, 100, 150), (2, 7, 14), (3, 1000, 900), (9, 1, 1)]:
        assert sum(per[no].values()) == slots and set(per[no]) <= set(range(blocks))
        assert max(per[no].values()) <= -(-slots // blocks) and min(per[no].values(), default=0) >= (slots // blocks or 1)
    shards = Counter(r.shard for r in rows)
    assert max(shards.values()) <= 100


def corpus(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(rng.choice([0, 1, 3, 40, 300]))), rng.choice(["a", "a", "b", "c", None])) for i in range(120)]
    rows += [(500, None, "a"), (501, "only", "tiny"), (502, "again and again", "b"), (502, "again and again", "b"), (None, "no name here", "b")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("target", F.lit(1)).repartition(3)


def test_mix(spark):
    rows, d = corpus(spark)
    docs, uses = M.mix(d, block=8)
    out = M.taken(written(docs), uses, 8).collect()
    assert len(out) == len(rows)
    sizes, took, target = Counter(), Counter(), {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
        took[r.source] += r.taken
        target[r.source] = r.target
    want = Counter()
    for _, t, s in rows:
        want[s] += len((t or "").split())
    assert sizes == want and target == pytest.approx(brute_targets(dict(want)))
    assert all(abs(took[s] - target[s]) <= 8 + 8 * (s == "tiny") for s in target)
    again = M.taken(written(M.mix(d.repartition(5), block=8)[0]), M.mix(d, block=8)[1], 8).collect()
    assert sorted((r.taken for r in out)) == sorted((r.taken for r in again))
    none = M.mix(d.where("false"))
    assert M.taken(none[0], none[1], 8).collect() == []


def test_mixed_documents_hold_the_words_taken(spark):
    rows, d = corpus(spark)
    docs, uses = M.mix(d, block=8)
    want = Counter()
    for r in M.taken(written(docs), uses, 8).collect():
        want[r.id] += r.taken
    got, texts = Counter(), {i: t for i, t, _ in rows}
    out = M.mixed_documents(d, block=8)
    assert out.columns == d.columns
    for r in out.collect():
        got[r.doc_id] += len(r.text.split())
        assert set(r.text.split()) <= set(texts[r.doc_id].split())
    assert +got == +want


@pytest.mark.parametrize("n,size,want", [(0, 4, []), (1, 4, [(0, 1)]), (4, 4, [(0, 4)]), (5, 4, [(0, 1), (1, 4)]), (9, 4, [(0, 1), (1, 4), (5, 4)])])
def test_cuts(n, size, want):
    assert P.cuts(n, size) == want


@pytest.mark.parametrize("lengths", [[1] * 900, [60] * 200 + [40] * 200, [51] * 300, [100] * 20, list(range(1, 101)) * 8, [70] * 100 + [30] * 50 + [29] * 60])
def test_pack(spark, lengths):
    d = spark.createDataFrame(list(enumerate(lengths)), "id long, length long").withColumn("_x", F.lit(1)).repartition(3)
    rows = P.pack(d, 100, per_group=128, fan_in=2).collect()
    assert sorted(r.id for r in rows) == list(range(len(lengths)))
    bins = defaultdict(list)
    for r in rows:
        assert r.length == lengths[r.id]
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 100
    least = max(-(-sum(lengths) // 100), sum(n > 50 for n in lengths))
    assert len(bins) <= 1.06 * least + 2


@pytest.mark.parametrize("lengths", [[1100] * 5000 + [10] * 40, [700] * 3000 + [600] * 3000, [1500, 300] * 2000 + [2000] * 500, "random", "small"])
def test_what_a_task_emits_costs_no_sequence(lengths):
    """The tree with its quotas gives as many sequences as one that hands up every bin that is not full."""
    rng = np.random.default_rng(5)
    lengths = {"random": rng.integers(1, 2049, 8000), "small": rng.integers(1, 40, 30_000)}[lengths] if isinstance(lengths, str) else np.array(lengths)
    groups = np.array_split(rng.permutation(lengths), 32)

    def sequences(groups, free):
        done = 0
        while True:
            rounds, n = 0, len(groups)
            while n > 1:
                n, rounds = -(-n // 2), rounds + 1
            kept = []
            for g in groups:
                bins, _ = P.best_fit(g, 2048)
                level = np.bincount(bins, weights=g).astype(np.int64)
                up = P._goes_up(level, 2048, 2041, 10**9 if free else 2 * rounds) & (rounds > 0)
                done += int((~up).sum())
                kept.append(level[up])
            if not rounds:
                return done
            groups = [np.concatenate(kept[i:i + 2]) for i in range(0, len(kept), 2)]

    assert sequences(groups, False) == sequences(groups, True)


def test_pack_against_brute_force(spark):
    """One group takes the fewest sequences that trying every way gives; of a tree, no two sequences fit together."""
    def fewest(items, free, size=10):
        if not items:
            return 0
        n, rest = items[0], items[1:]
        ways = [fewest(rest, free[:i] + (f - n,) + free[i + 1:]) for i, f in enumerate(free) if f >= n]
        return min([*ways, 1 + fewest(rest, (*free, size - n))])

    def levels(lengths, size, per_group):
        d = spark.createDataFrame(list(enumerate(lengths)), "id long, length long")
        return sorted(r.n for r in P.pack(d, size, per_group=per_group, fan_in=2, slack=0).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect())

    for lengths in ([6, 4, 5, 5, 3, 7], [9, 1, 8, 2, 10], [3, 3, 3, 7, 7, 7, 1], [6, 6, 4]):
        assert len(levels(lengths, 10, 8)) == fewest(sorted(lengths, reverse=True), ())
    for lengths in ([6, 4, 5, 5, 3, 7], [55] * 400 + [3] * 90, [random.Random(8).randrange(1, 101) for _ in range(500)]):
        got = levels(lengths, max(10, max(lengths)), 32 if len(lengths) > 9 else 1)
        assert sum(got) == sum(lengths) and (len(got) < 2 or got[0] + got[1] > max(10, max(lengths)))


def test_pack_of_odd_lengths(spark):
    d = spark.createDataFrame([(1, 5)], "id long, length long")
    assert P.pack(d.where("false"), 10).collect() == []
    for bad in (None, 0, 11):
        with pytest.raises(Exception, match="length outside"):
            P.pack(d.withColumn("length", F.lit(bad).cast("long")), 10).collect()


TEXTS = [(5, "Hello world, it's a test."), (1, None), (2, ""), (3, "word " * 30_000), (5, "a tie"), (None, "no name"), (7, "x" * 50_000), (7, "x" * 50_000), (9, " \n \n  <|endoftext|> é漢\U0001F600 ")]


def test_pieces_of_documents(spark):
    d = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("piece", F.lit("clash")).withColumn("length", F.lit("clash"))
    enc = Encoder(tokenizer_path())
    want = []
    for i, t in TEXTS:
        ids = np.array(enc.whole([t or ""])[0] + [0], "<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s:s + n].tobytes())) for k, (s, n) in enumerate(P.cuts(len(ids), 2048))]
    rows = P.pack_documents(d).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)


PARTS = st.sampled_from(["a", "b", " ", "  ", "\n", "\t", "\r", "\u00a0", "\u3000", "é", "1", "'s", "'", "!", ".", ",", "\x85", "\x1c", "\u200b", "\ufeff", "\0", "<|endoftext|>", "漢", "\x0b", "The", "\U0001F600"])
ENC = []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=14).map("".join), max_size=40))
def test_cutting_changes_no_ids(texts):
    if not ENC:
        ENC.append(Encoder(tokenizer_path(), cache=200))
    ids, sizes = ENC[0].encode(pa.array(texts, pa.string()))
    whole = ENC[0].whole(texts)
    assert sizes.tolist() == [len(x) for x in whole]
    assert ids.tolist() == [i for x in whole for i in x]


def test_common_pieces_outlast_a_full_cache(monkeypatch):
    enc = Encoder(tokenizer_path(), cache=60)
    common = [f" common{chr(97 + i)}" for i in range(20)]
    seen = []
    monkeypatch.setattr(enc, "whole", lambda texts, whole=enc.whole: seen.append("".join(texts)) or whole(texts))
    for k in range(12):
        texts = ["x" + "".join(common) + "".join(f" w{chr(97 + k)}{chr(97 + i)}" for i in range(15)), None]
        ids, sizes = enc.encode(pa.array(texts, pa.string()))
        assert ids.tolist() == enc.tok.encode(texts[0], add_special_tokens=False).ids and sizes.tolist() == [len(ids), 0]
        assert enc.n <= 60 + 36
    assert "".join(seen).count(" commona") == 1


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=300), st.sampled_from([1, 7, 64]))
def test_range_coder_round_trip(ids, block):
    names, symbols = np.unique(np.array(ids), return_inverse=True)
    for freq in (R.order0_tables(symbols, np.array([len(ids)]), len(names)), R.order0_tables(symbols, np.array([0, 1, len(ids) - 1]), len(names), tables=3, least=1)):
        blocks = R.encode(symbols, freq, block)
        assert (names[R.decode(blocks, len(ids), freq, block)] == ids).all()


def test_what_a_step_finds_is_what_weights_learn_from():
    """Entries of every confidence, right and wrong, against the rule written out."""
    model = R.Model(16, np.array([[1 << R.ORDER0_BITS - 1] * 2]))
    c = np.tile(np.arange(16) % 8, (2, 1)).astype(np.int32)
    coded = np.full(16, 1 << R.CONF_BITS, np.int32)
    right = np.arange(16) < 8
    entry = np.where(right, coded, 0).astype(np.int32) + c
    slot = model.base + 3
    found = model.see(slot, entry, c, coded)
    assert found.tolist() == [[k % 8 + (0 if k < 8 else 8) for k in range(16)]] * 2
    want = [min(k + 1, 7) + 8 for k in range(8)] + [9, 9] + [1] * 6
    assert model.table[slot].tolist() == [want, want] and (model.table > 0).sum() == 32
    model.learn(np.ones((1, 16), np.int32), (found + model.cell)[None])
    start = np.r_[0, np.linspace(4096, 57344, 7)].astype(np.int64)
    for order in range(2):
        own = model.right.reshape(2, 16, 8)[order]
        for k in range(16):
            moved = start.copy()
            if k % 8:
                moved[k % 8] += ((60000 if k < 8 else 600) - start[k % 8]) // 17
            assert own[k].tolist() == moved.tolist()


def test_blocks_are_decoded_alone():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 50, 1000) * rng.integers(0, 2, 1000)
    freq = R.order0(np.bincount(x, minlength=50))[None]
    blocks = R.encode(x, freq, 256)
    for i, b in enumerate(blocks):
        own = x[i * 256:(i + 1) * 256]
        if len(own) == 256:
            assert (R.decode([b], 256, freq, 256) == own).all()


def test_range_coder_learns():
    rng = np.random.default_rng(0)
    x = np.tile(rng.integers(0, 2000, 300), 40)
    for ids, most in ((x, 0.5), (rng.integers(0, 60_000, 20_000), 2.3)):
        symbols = np.unique(ids, return_inverse=True)[1]
        freq = R.order0_tables(symbols, np.array([len(ids)]), symbols.max() + 1)
        blocks = R.encode(symbols, freq, 1024 * 8)
        assert sum(map(len, blocks)) / len(ids) < most
        assert (R.decode(blocks, len(ids), freq, 1024 * 8) == symbols).all()


def test_compression_of_documents_at_the_registered_block(spark, sf):
    """The files of the documents table take at most 0.92 of the order-0 entropy of its ids, heads included."""
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    ids, sizes = Encoder(tokenizer_path()).encode(pa.array(texts, pa.string()))
    p = np.bincount(ids) / len(ids)
    least = -(p[p > 0] * np.log2(p[p > 0])).sum() / 8 * len(ids)
    segment = T.pack_segment(list(range(len(sizes))), sizes, ids)
    assert T.BLOCK == 4096 and len(segment) < 0.92 * least
    one = R.order0_tables(np.unique(ids, return_inverse=True)[1], sizes, len(np.unique(ids)), tables=1)
    assert len(R.order0_tables(np.unique(ids, return_inverse=True)[1], sizes, len(np.unique(ids)))) > len(one) == 1


def test_damaged_segments_are_errors():
    ids = np.arange(5000, dtype=np.uint32) % 97
    good = T.pack_segment([1, None], np.array([2000, 3000]), ids)
    (names, sizes, back), = T.segments(good + b"\n")
    assert names == [1, None] and sizes.tolist() == [2000, 3000] and (back == ids).all()
    for at in (2, 30, len(good) - 40):
        bad = bytearray(good)
        bad[at] ^= 0x55
        with pytest.raises((ValueError, zlib.error)):
            list(T.segments(bytes(bad) + b"\n"))


def test_token_files(spark, tmp_path):
    d = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(3)
    folder = str(tmp_path / "tokens")
    T.write_token_files(d, folder, per_task=20_000)
    rows = sorted(T.read_token_files(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    enc = Encoder(tokenizer_path())
    assert sorted(map(repr, ([r.doc_id, r["ids"]] for r in rows))) == sorted(repr([i, enc.whole([t or ""])[0] + [0]]) for i, t in TEXTS)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r["ids"]) and r.ids_crc32 == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r.n_tokens
    names = [r.doc_id for r in rows]
    assert names == sorted(names, key=lambda x: (x is not None, x))
    assert T.token_files(d.where("false")).collect() == []


def test_a_task_writes_several_files_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT", 1)
    monkeypatch.setattr(T, "chunks", lambda batches, column: batches)
    folder = tmp_path / "tokens"
    T.write_token_files(spark.range(1000).selectExpr("id AS doc_id", "concat('text ', id) AS text"), str(folder), per_file=1)
    assert len(list(folder.glob("part-00000-*-c00?.txt"))) == 4
    rows = sorted(T.read_token_files(spark, str(folder)).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == list(range(1000)) and [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()


FAKE = W.record(666, "http://fake.net/", b"not a record", None, False, "2000-01-01T00:00:00Z").decode()
PAGES = [(1, "http://a.net/", "plain"), (2, None, None), (3, "", ""), (4, "http://b.net/\r\nX: y", "plain"), (9, "http://c.net/", "plain"), (9, "http://c.net/", "plain"), (5, "http://d.net/", FAKE), (6, "u", FAKE + "WARC/1.1\r\n"),
         (7, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n"), (None, "u", "nameless"), (None, "u", "nameless"), (8, "é", "é漢\r\n\r\n" * 10), (10, "u", "z" * 300_000)]


def test_archives_round_trip(spark, tmp_path):
    d = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("id", F.lit(1)).withColumn("payload", F.lit("clash")).repartition(3)
    folder = str(tmp_path / "archives")
    W.write_archives(d, folder, per_file=3)
    rows = W.read_archives(spark, folder, with_payload=True).collect()
    groups = defaultdict(list)
    for i, _, h in PAGES:
        groups[h or ""].append(i)
    want = []
    for i, _, h in PAGES:
        first = max((x for x in groups[h or ""] if x is not None), default=None)
        b = (h or "").encode()
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), *(("response", None) if i == first else ("revisit", first))))
    assert sorted((tuple(r)[:1] + (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr) == sorted(want, key=repr)
    assert all(r.payload == (dict((i, h) for i, _, h in PAGES if i)[r.page_id] or "").encode() for r in rows if r.record_type == "response" and r.page_id)
    short = W.archived(d, min_bytes=6).where("page_id in (1, 4)").collect()
    assert {r.record_type for r in short} == {"response"}
    assert W.archived(d.where("false")).collect() == []


def test_archives_of_others_and_damage(spark, tmp_path):
    records = [W.record(i, "http://x.net/", FAKE.encode() * (i % 2) + b"%d" % i, None, False, "2000-01-01T00:00:00Z") for i in range(40)]
    for name, data in (("plain", b"".join(records)), ("members", b"".join(gzip.compress(r) for r in records))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(data)
        assert sorted(r.page_id for r in W.read_archives(spark, str(tmp_path / name)).collect()) == list(range(40))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.warc").write_bytes(b"".join(records[:20]) + b"?" + b"".join(records[20:]))
    with pytest.raises(ValueError, match="damaged"):
        W.read_archives(spark, str(tmp_path / "bad")).collect()


def test_archives_of_long_urls_and_large_pages(spark, tmp_path, monkeypatch):
    long = "data:text/plain," + "x" * 200_000
    d = spark.createDataFrame([(1, long, "a"), (2, "http://x.net/", "b"), (3, long, "a"), (4, None, "c" * 300_000), (5, None, "d" * 300_000), (6, "http://y.net/", "")],
                              "page_id long, url string, html string").coalesce(1)
    folder = str(tmp_path / "long")
    W.write_archives(d, folder, per_file=8)
    rows = {r.page_id: r for r in W.read_archives(spark, folder, with_payload=True).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6] and rows[1].url == rows[3].url == long and rows[1].refers_to == 3
    assert rows[4].payload == b"c" * 300_000 and rows[6].payload == b""
    sizes = [len(W.plain(f.read_bytes())) for f in (tmp_path / "long").glob("*.gz")]
    assert sum(sizes) > 1_000_000 and max(sizes) < 8 * W.SMALL + 4096  # 8 rows of at most 64 KiB, or fewer that are larger


def test_heads_inside_heads():
    inner = b"".join(b"a:WARC/1.1\r\nx%d: y\r\n" % i for i in range(20_000))
    block = b"WARC/1.1\r\n" + inner + b"Content-Length: 3\r\n\r\nabc\r\n\r\n"
    found = list(W.candidates(block + W.record(7, None, b"p", None, False, "2000-01-01T00:00:00Z")))
    assert len(found) == 20_002 and {f[1] for f in found[:-1]} == {len(block)}
    assert found[0][3] == b"abc" and W._page(found[-1][2][b"warc-record-id"]) == 7
