"""Hilbert sharding, WARC archives and the pipeline."""

import gzip
import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from supplymetrics.llm import hilbert, queries, warc

from .conftest import EDGE, documents

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 3), (2, 5)])
def test_curve_visits_every_cell_in_steps_of_one(spark, n, bits):
    cells = spark.createDataFrame(list(product(range(1 << bits), repeat=n)), ", ".join(f"cell_{i} int" for i in range(n)))
    rows = cells.withColumn("h", hilbert.hilbert_index([F.col(f"cell_{i}") for i in range(n)], bits)).collect()
    path = [r[:n] for r in sorted(rows, key=lambda r: r.h)]
    assert sorted(r.h for r in rows) == list(range(1 << bits * n))
    assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for x, y in zip(path, path[1:]))


def check_law(rows, texts, shards=16):
    counts, slots = Counter(r.shard for r in rows), defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(counts) <= set(range(shards))
    assert max(counts[s] for s in range(shards)) - min(counts[s] for s in range(shards)) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def test_sharding_law(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = queries.op8_hilbert_sharding(spark, SMALL).collect()
    check_law(rows, [(r.doc_id, r.text) for r in df.collect()])
    again = hilbert.assign(df.repartition(7, "text")).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_runs_prune_every_dimension(spark):
    rng = random.Random(8)
    df = documents(spark, [(i, "x" * int(2 ** rng.uniform(0, 14)), rng.choice("abcd"), rng.choice("pqrst")) for i in range(2000)])
    found = hilbert.assign(df).join(df.select("doc_id", "lang", "source"), "doc_id").collect()
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r)
    assert sum(len({r.lang for r in v}) + len({r.source for r in v}) for v in by.values()) < .75 * 16 * 9


def plain_hilbert(cell, bits):
    """Distance along the curve by Skilling's transpose, one axis after the other."""
    x, n = list(cell), len(cell)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= low
            else:
                t = (x[0] ^ x[i]) & low
                x[0], x[i] = x[0] ^ t, x[i] ^ t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    for level in range(bits - 1, 0, -1):
        if x[n - 1] >> level & 1:
            t ^= (1 << level) - 1
    return sum((x[i] ^ t) >> k & 1 and 1 << (k * n + n - 1 - i) for k in range(bits) for i in range(n))


def plain_cells(values, bits):
    """Share of rows before the middle of each value."""
    counts, before, out = Counter(values), 0, {}
    for v in sorted(counts, key=lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)):
        out[v] = min(math.floor((before + counts[v] / 2) / len(values) * 2 ** bits), 2 ** bits - 1)
        before += counts[v]
    return out


def test_placement_matches_plain_python(spark):
    """Shards and slots from a plain sort by curve index, text hash, id and row hash; the hashes are Spark's."""
    df = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 7 > 0, F.col("lang")))
    rows = df.select("doc_id", "source", "lang", "text", F.xxhash64("text").alias("h"), hilbert.row_key(df).alias("k")).collect()
    steps = [math.floor(64 * math.log2(len((r.text or "").encode()) + 1)) for r in rows]
    axes = [(column, plain_cells(column, hilbert.BITS)) for column in ([r.source for r in rows], [r.lang for r in rows], steps)]
    index = [plain_hilbert([cells[column[i]] for column, cells in axes], hilbert.BITS) for i in range(len(rows))]
    order = sorted(range(len(rows)), key=lambda i: (index[i], rows[i].h, rows[i].doc_id, rows[i].k))
    n, want = len(rows), {}
    for rank, i in enumerate(order):
        shard = rank * 16 // n
        want[rows[i].doc_id] = (shard, rank - sum(r * 16 // n < shard for r in range(n)), index[i])
    assert {r.doc_id: (r.shard, r.slot, r.curve_index) for r in hilbert.assign(df).collect()} == want


def test_long_documents_are_told_apart(spark):
    df = documents(spark, [(i, "x" * n, "en", "s") for i, n in enumerate([60_000, 90_000, 400_000, 3_000_000] * 4)])
    found = {r.doc_id: (r.size, r.shard) for r in hilbert.assign(df).collect()}
    by_size = defaultdict(set)
    for size, shard in found.values():
        by_size[size].add(shard)
    assert sorted(map(len, by_size.values())) == [4] * 4 and not set.intersection(*by_size.values())
    assert len(set().union(*by_size.values())) == 16


def test_sharding_edges(spark, edge, none):
    check_law(hilbert.assign(edge).collect(), [r[:2] for r in EDGE])
    assert hilbert.assign(none).collect() == []
    hot = [(i, "one text", "en", "s") for i in range(300)] + [(1000 + i, f"t{i}", None, None) for i in range(40)]
    check_law(hilbert.assign(documents(spark, hot)).collect(), [r[:2] for r in hot])
    placed = hilbert.in_shards(edge)
    assert placed.columns == [c for c in edge.columns if c != "shard"] + ["shard", "slot"]
    assert Counter((r.doc_id, r.text) for r in placed.collect()) == Counter(r[:2] for r in EDGE)
    assert hilbert.in_shards(none).count() == 0


PAGES = "page_id long, url string, html string, warc string, digest string"


def test_page_ids_of_any_type(spark):
    big = "w" * 2000
    df = spark.createDataFrame([("none", "u", big), ("a/b <c>", "u", big), ("é", None, "x"), (None, "u", "y"), ("", "u", "z")], "page_id string, url string, html string")
    rows = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert set(rows) == {"none", "a/b <c>", "é", None, ""}
    assert (rows["a/b <c>"].record_type, rows["a/b <c>"].refers_to, rows["none"].record_type) == ("revisit", "none", "response")


def test_archive_round_trip(spark, tmp_path):
    big = "é" * 600
    pages = [(1, "http://a/b c", big), (2, None, big), (9, "u", big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""),
             (None, "u\r\nX: y", big), (7, "u", "x" * 300_000), (8, "u", "HTTP\r\n\r\nWARC/1.1\r\n\r\n" * 80), (9, "u", big)]
    df = spark.createDataFrame([(*p, "w", "d") for p in pages], PAGES)
    warc.write_archive(df, str(tmp_path / "w"), records_per_file=3, large_bytes=5000)
    rows = warc.read_archive(spark, str(tmp_path / "w")).collect()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = Counter((i, len((t or "").encode()), sha(t), "revisit" if t == big and i != 9 else "response", 9 if t == big and i != 9 else None) for i, _, t in pages)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want
    files = [tmp_path / "w" / f for f in os.listdir(tmp_path / "w") if f.startswith("part")]
    inflated = b"".join(gzip.open(f).read() for f in files)  # any gzip reader skips the padding
    assert inflated.count(b"WARC/1.1\r\nWARC-Type: ") == len(pages)
    held = [[warc.read_record(m)[0] for m in warc.members(f.read_bytes())] for f in files]
    assert max(map(len, held)) <= 3 and ["7"] in held  # the large one has a file of its own
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        warc.write_archive(df, str(tmp_path / "w"))


def test_reader_verifies():
    good = warc.member(1, "u", b"payload" * 300, None, False)
    assert warc.read_record(next(warc.members(good)))[2] == 2100
    assert [len(list(warc.members(good + b"\0\0" + good + b"\0")))] == [2]
    with pytest.raises(warc.WarcError):
        list(warc.members(good[:-9]))
    plain = gzip.decompress(good)
    for broken in (plain.replace(b"payload", b"paYload", 1), plain[:-5], plain.replace(b"Content-Length: 21", b"Content-Length: 20"), b"none"):
        with pytest.raises(warc.WarcError):
            warc.read_record(broken)
    with pytest.raises(warc.WarcError):
        list(warc.members(b"\x01\x02\x03"))


def test_archive_of_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none).collect() == []


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    toxic = {r.doc_id for r in queries.op4_toxicity(spark, SMALL).collect() if r.predicted}
    left = docs.filter(~F.col("doc_id").isin(list(toxic) or [-1]))
    from .test_simhash import plain_components, plain_fingerprint
    groups = plain_components([(i, plain_fingerprint(t.text)) for i, t in texts.items() if i not in toxic])
    kept = {c for _, _, c in groups}
    from supplymetrics.llm import decontam, mixing
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    item = [decontam.shingles(decontam.words_of(b.text), 5) for b in bench]
    clean = {i for i in kept if not any(len(s & decontam.shingles(decontam.words_of(texts[i].text), 5)) >= .8 * len(s) for s in item if s)}
    assert len(kept) < left.count() and len(clean) < len(kept)
    mixed = mixing.mix(docs.filter(F.col("doc_id").isin(list(clean)))).collect()
    want = Counter({r.doc_id: int(r.taken / r.size + .5) for r in mixed if r.size and int(r.taken / r.size + .5)})
    result = P.run(spark, SMALL)
    assert result.columns == [*docs.columns, "shard", "slot"]
    rows = result.collect()
    assert Counter(r.doc_id for r in rows) == want and all(r.text == texts[r.doc_id].text for r in rows)
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts[s] for s in range(16)) <= 1


def test_stages_on_edge_rows(spark, edge, none, tmp_path):
    import corpus_pipeline as P

    for name, rows in (("edge", edge), ("none", none)):
        folder = tmp_path / name
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "never there at all my friend")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs, count = rows, rows.count()
        for i, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, str(folder))
            assert i == len(P.STAGES) - 1 or out.columns == rows.columns
            out.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
        assert docs.count() <= 3 * count


def test_registered_queries_run_without_a_limit():
    names = list(queries.QUERIES)
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and set(queries.SQL) <= set(names)
