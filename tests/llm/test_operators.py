"""The text operators against brute force on small tables."""

import base64
import collections
import hashlib
import itertools
import math
import re

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from panelsmith.llm import embeddings, langid, licenses, packing, quality, secret_scan, sentencepiece_bpe, simhash, spotsigs, warc
from panelsmith.llm.components import connected_components
from panelsmith.llm.queries import LLM_ORACLES, LLM_QUERIES

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def read(name, folder=SMALL):
    return pd.read_parquet(f"{folder}/{name}.parquet")


def run(spark, name, folder=SMALL):
    return LLM_QUERIES[name](spark, folder).toPandas()


def classes_of(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_match_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(120)] + [(5, 5)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes_of(1200, edges)
    assert found == {n: want[n] for n in {x for e in edges if e[0] != e[1] for x in e}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op1_matches_brute_force(spark):
    docs = read("documents").sort_values("doc_id", ignore_index=True)
    got = run(spark, "op1_simhash").sort_values("doc_id", ignore_index=True)
    fps = [slow_fingerprint(t) for t in docs.text]
    assert got.fingerprint.tolist() == [f"{x:016x}" for x in fps]
    want = classes_of(len(fps), [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert got.component_id.tolist() == docs.doc_id[want].tolist()


@pytest.mark.parametrize("runs", [1, 2, 4])
def test_trees_find_every_close_pair(spark, runs):
    """Dense balls and strays, shards and blocks far below their usual size."""
    rng = np.random.default_rng(runs)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 3), replace=False))) for _ in range(20)]
    values = np.unique(np.concatenate([base, *[base[:12] ^ f for f in flips]]))
    rows = [(i, int(v).to_bytes(8, "big")) for i, v in enumerate(values)]
    fps = spark.createDataFrame(rows, "node long, fp binary")
    links = [(r.a, r.b) for r in simhash.near_links(fps, 3, 1, runs, shard_rows=16, block_rows=16).collect()]
    near = [(i, j) for i, j in itertools.combinations(range(len(values)), 2) if int(values[i] ^ values[j]).bit_count() <= 3]
    assert classes_of(len(values), links) == classes_of(len(values), near)
    assert len(links) < len(near)


def test_visit_never_prunes_a_partner():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, (400, 1), dtype=np.uint64)
    y = x ^ np.array([[1 << int(rng.integers(32))] for _ in range(400)], dtype=np.uint64)
    tree = simhash.fit_trees(x, 6, 1, 2, 1)[0]
    rows, shards, _ = tree.visit(x)
    visited = set(zip(rows.tolist(), shards.tolist(), strict=True))
    rows, shards, home = tree.visit(y)
    assert all((r, s) in visited for r, s in zip(rows[home].tolist(), shards[home].tolist(), strict=True))


def test_near_copies_by_five_words(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = [" ".join(rng.choice(vocabulary, 220)) for _ in range(40)]
    copies = [" ".join(w if k not in (60, 150) else "changed" for k, w in enumerate(t.split())) for t in texts[:15]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts + copies + texts[:3])], "doc_id long, text string, row string")
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))


def test_a_repeated_line_makes_no_near_copy(spark):
    rng = np.random.default_rng(8)
    line = " ".join(f"l{i}" for i in range(15))
    texts = [" ".join([*(f"d{d}w{i}" for i in rng.permutation(300)), *[line] * 60]) for d in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect()) == list(range(20))


def test_near_copies_match_brute_force_around_the_limit(spark):
    rng = np.random.default_rng(9)
    texts = []
    for size in [400] * 120 + [12] * 60:
        words = [f"w{x}" for x in rng.integers(0, 1 << 30, size + 4)]
        k = 4 + size * 0.889 * (1 + rng.uniform(-0.06, 0.06))
        texts += [" ".join(words), " ".join(w if i < k else f"v{rng.integers(1 << 30)}" for i, w in enumerate(words))]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    alike = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert sum(0.75 < x < 0.8 for x in alike) > 20 and sum(0.8 <= x < 0.85 for x in alike) > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one_of_each(docs).collect()}
    assert kept == {2 * i for i in range(len(alike))} | {2 * i + 1 for i, x in enumerate(alike) if x < 0.8}


def test_candidates_by_sets_come_from_the_trees(spark, monkeypatch):
    """Fingerprints alone make candidates: pairs as far apart as at 0.8 are connected, strays are not; deep trees with small shards."""
    rng = np.random.default_rng(14)
    base = rng.integers(0, 1 << 63, (1500, 16), dtype=np.uint64) * np.uint64(2)
    flips = np.packbits(rng.random((500, 1024)) < 0.1515, axis=1).view(np.uint64)
    every = np.concatenate([base, base[:500] ^ flips])
    rows = [(i, x.astype(">u8").tobytes()) for i, x in enumerate(every)]
    groups = spark.createDataFrame(rows, "node long, keys binary")
    for shard_rows in (64, 1 << 13):
        monkeypatch.setattr(simhash, "SET_SHARD_ROWS", shard_rows)
        links = {(min(r), max(r)) for r in simhash.candidate_links(groups).collect()}
        assert links == {(i, 1500 + i) for i in range(500)}
    sized = groups.withColumn("size", F.when(F.col("node") >= 1600, 100).otherwise(70).cast("long"))
    assert {(min(r), max(r)) for r in simhash.candidate_links(sized).collect()} == {(i, 1500 + i) for i in range(100)}
    # Without trees only equal sets are found.
    monkeypatch.setattr(simhash, "fit_trees", lambda *a, **k: [])
    docs = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "a b c d e f g h i"), (3, "a b c d e f g h i j")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect()) == [1, 3]


def test_one_of_two_near_rows_visits_the_other():
    rng = np.random.default_rng(15)
    x = rng.integers(0, 1 << 63, (3000, 1), dtype=np.uint64)
    for width, levels in ((5, 3), (5, 5), (8, 8), (12, 9)):
        tree = simhash.fit_trees(x, levels, 1, 2, 1, width=width)[1]
        y = x ^ (np.uint64(1) << rng.integers(tree.shift, tree.shift + width, (3000, 1), dtype=np.uint64))
        seen, homes = [], []
        for z in (x, y):
            rows, shards, home = tree.visit(z, one_way=True)
            seen.append(set(zip(rows.tolist(), shards.tolist(), strict=True)))
            homes.append(dict(zip(rows[home].tolist(), shards[home].tolist(), strict=True)))
        assert len(homes[0]) == len(homes[1]) == 3000
        met = [((i, homes[1][i]) in seen[0]) + ((i, homes[0][i]) in seen[1]) for i in range(3000)]
        assert all(n == (2 if homes[0][i] == homes[1][i] else 1) for i, n in enumerate(met))
        assert len(seen[0]) < len(tree.visit(x)[0])


def test_blocks_of_a_component_match_all_pairs(spark):
    rng = np.random.default_rng(10)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(w if rng.random() > p else f"v{rng.integers(1 << 30)}" for w in base) for p in rng.uniform(0, 0.06, 90)]
    known = simhash.shingle_sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).withColumn("row", F.col("id"))
    groups = known.select(F.col("row").alias("node"), "size", "bits")
    chain = spark.createDataFrame([(i, i + 1) for i in range(89)], "a long, b long")
    links = [(r.a, r.b) for r in simhash.similar_links(known, groups, chain, 5, 0.8, block_rows=16).collect()]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    alike = [(i, j) for i in range(90) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    assert {frozenset(x) for x in links} <= {frozenset(x) for x in alike}
    assert classes_of(90, links) == classes_of(90, alike)


def test_texts_with_a_boilerplate_in_common_stay_apart(spark):
    rng = np.random.default_rng(12)
    shared = [f"s{i}" for i in range(140)]
    texts = [" ".join([*shared, *(f"v{x}" for x in rng.integers(0, 1 << 40, 60))]) for _ in range(1200)]
    texts += [texts[0].rsplit(" ", 5)[0] + " five other words stand here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = simhash.shingle_sets(docs).withColumn("row", F.col("id")).persist()
    loose = simhash.candidate_links(known.select(F.col("row").alias("node"), "keys"))
    groups = known.select(F.col("row").alias("node"), "size", "bits")
    blocks = simhash._in_blocks(connected_components(loose).join(groups, "node"), {"*": 512})
    # The texts' similarity is 0.53: one pair in 6000 has fingerprints as near as the limit.
    assert simhash._links_in_groups(blocks, simhash._allowed_links, 0.8).count() < 300 < loose.count()
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect()) == list(range(1200))


def test_fingerprints_allow_what_is_similar(spark):
    """Pairs at a similarity of 0.8 stay below the limit of bits; sets of unequal size too."""
    rng = np.random.default_rng(13)
    apart = []
    for n in [64, 100, 400, 3000] * 50:
        both, own = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
        k = round(n * 0.8)
        some, other = (both, both[:k]) if rng.random() < 0.3 else (both, np.concatenate([both[: -(-n * 8 // 9)], own[: n - -(-n * 8 // 9)]]))
        a, b = (np.frombuffer(simhash.simhash_bits(x, simhash.SET_WORDS), np.uint64) for x in (some, other))
        apart.append(int(np.bitwise_count(a ^ b).sum()))
    assert max(apart) <= simhash.NEAR_BITS and 140 < np.mean(apart) < 170


def test_texts_in_no_learnt_language_go(spark):
    folder = "/root/testdata/sf0.1"
    docs, held = spark.read.parquet(f"{folder}/documents.parquet"), read("documents", folder)
    model = langid.learn_with_floors(docs)
    assert len(model.floors) == len(model.languages) == 4 and all(0.5 < f < 0.95 for f in model.floors)
    rng = np.random.default_rng(14)
    random_words = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(200))
    odd = ["東京は日本の首都であり、世界最大の都市の一つです。" * 8, "Это предложение написано на русском языке и никем не выучено. " * 4, random_words]
    assert model.explains(odd) == [False] * 3 and model.explains(["zq", "7 8", None, ""]) == [True, False, False, False]
    # A text in two learnt languages stays.
    two = [held[held.lang == x].text.str.slice(0, 2000).iloc[3] for x in ("en", "de")]
    assert model.explains([" ".join(two)]) == [True]
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() >= 0.9995 * sum(langid.has_letter(t) for t in held.text)


def test_op2_matches_plain_patterns(spark):
    docs = read("documents", MIDDLE)
    got = run(spark, "op2_secret_scan", MIDDLE).set_index("doc_id")
    kinds = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32)]
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text, re.ASCII) if ok(m))
        row = got.loc[doc]
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == x for _, k, _ in found) for x in range(3)]
        assert row.base_sha256 == hashlib.sha256(",".join(f"{kinds[k][0]}:{s}:{e}" for s, k, e in found).encode()).hexdigest()
    assert got.n_hex.sum() and got.n_assign.sum()


def test_random_strings_beside_digests_and_names(spark):
    rows = {
        1: 'key "9xQv2LmZ8RtY4WcB7NpK3HsD6GfJ1" end', 2: "sha1 " + "Ab12" * 0 + hashlib.sha1(b"x").hexdigest().upper(), 3: "my_long_variable_name_for_testing", 4: "550e8400-e29b-41d4-a716-446655440000",
        5: "2024-01-01T00:00:00.000+00:00", 6: "token: short then secret: abcdefgh12", 7: "token=secret: abcdefghij", 8: None, 9: "",
    }
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    found = {r.doc_id: [(s.kind, rows[r.doc_id][s.start : s.end]) for s in r.spans] for r in secret_scan.scan_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    assert found == {1: [("random", "9xQv2LmZ8RtY4WcB7NpK3HsD6GfJ1")], 2: [], 3: [], 4: [], 5: [], 6: [("assign", "secret: abcdefgh12")], 7: [], 8: [], 9: []}
    masked = {r.doc_id: (r.text, r.n) for r in secret_scan.redact_secrets(docs.selectExpr("*", "7 AS n"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, size_col="n").collect()}
    assert masked[1] == ('key "<random>" end', 18) and masked[8] == (None, 7) and masked[3][0] == rows[3]


def test_random_strings_within_longer_runs():
    rng = np.random.default_rng(6)
    encoding = secret_scan.load_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    some = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    lost = collections.Counter()
    for before, after in [("", ""), ("//hooks.example.com/services/", ""), ("/home/projects/internal/configuration/production/", ""), ("session_identifier=", "/documents/overview.html")]:
        for letters, size in ((some, 24), (some + "-_", 40), (some + "+/", 40), (some[:26], 32)):
            for _ in range(100):
                secret = "".join(rng.choice(list(letters), size))
                text = f"see {before}{secret}{after} there"
                a = text.index(secret)
                spans = secret_scan.random_spans(text, encoding, 2.0, [])
                kept = secret.strip("/=._-+")
                a += secret.index(kept)
                lost[before, size, letters[-1]] += not any(x <= a and a + len(kept) <= y for x, y in spans)
    assert max(lost.values()) <= 12, lost
    plain = [
        "/home/projects/internal/configuration/production/overview.html", "internationalization", "Donaudampfschifffahrtsgesellschaft", "keitstlichschenverpf", "/home/projects/internal/configuration/production/2024-01-01T00.00.00/overview.html",
        "/home/projects/internal/configuration/production/550e8400-e29b-41d4-a716-446655440000/overview.html", "/home/projects/internal/configuration/production/documents/" + hashlib.sha1(b"x").hexdigest().upper() + "/overview.html", "getHttpResponseCodeFromServerName",
    ]
    assert [(t, [t[a:b] for a, b in found]) for t in plain if (found := secret_scan.random_spans(t, encoding, 2.0, []))] == []


def test_op3_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{MIDDLE}/pages.parquet')")
    want = con.execute(LLM_ORACLES["op3_warc"]).df().sort_values("page_id", ignore_index=True)
    got = run(spark, "op3_warc", MIDDLE).sort_values("page_id", ignore_index=True)[want.columns]
    assert got.astype(str).replace({"nan": "<NA>"}).equals(want.astype(str).replace({"nan": "<NA>"}))


def test_archives_round_trip_in_chunks(spark, tmp_path):
    long = "é\r\n\r\nWARC/1.1\r\n" * 40 + "x" * 301
    rows = [(1, "http://a b\n", long), (2, None, "same"), (3, "u", "same"), (4, "u", ""), (5, "u", None), (None, "u", "own"), (6, "u", "x\r\n"), (7, "u", "\r\n\r\n"), (8, "u", long), (8, "u", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.page_records(pages, f"{tmp_path}/a", chunk_bytes=64)
    chunks = warc.read_warc(spark, f"{tmp_path}/a").collect()
    assert max(len(c.data) for c in chunks) <= 64
    texts = collections.defaultdict(bytes)
    for c in chunks:
        if c.record_type == "response":
            assert c.payload_bytes % 64 == 0 or c.last
            texts[c.id] += c.data
    assert texts[8].decode() == long * 2 and texts[3] == b"same" and texts[7] == b"\r\n\r\n" and texts[6] == b"x\r\n"
    got = {(r.id, r.record_type, r.payload_bytes, r.refers_to) for r in warc.resolved_records(warc.read_warc(spark, f"{tmp_path}/a", False)).collect()}
    n = len(long.encode())
    assert got == {(1, "revisit", n, 8), (8, "response", n, None), (2, "revisit", 4, 3), (3, "response", 4, None), (4, "revisit", 0, 5), (5, "response", 0, None), (None, "response", 3, None), (6, "response", 3, None), (7, "response", 4, None)}
    reader = warc.ArchiveReader(False)
    with pytest.raises(ValueError):
        reader.feed([b"WARC/1.1\r", b"WARC-Type: response\r", b"WARC-Record-ID: <urn:page:1>\r", b"WARC-Payload-Digest: sha1:A\r", b"Content-Length: 1\r", b"\r", b"ab\r", b"\r"])
    with pytest.raises(ValueError):
        reader = warc.ArchiveReader(False)
        reader.feed([b"WARC/1.1\r", b"Content-Length: 5\r"])
        reader.end()


def test_base32_of_hexadecimal_digits(spark):
    digits = ["0" * 40, "f" * 40, "0" * 15 + "1" + "0" * 24, "0" * 39 + "1", *(hashlib.sha1(bytes([i])).hexdigest() for i in range(200))]
    got = spark.createDataFrame([(d,) for d in digits], "d string").select("d", warc.base32(F.col("d"))).collect()
    assert all(b == base64.b32encode(bytes.fromhex(d)).decode() for d, b in got) and len(got) == len(digits)


def test_payloads_are_hashed_once_a_side(spark, monkeypatch):
    texts = [(1, "é" * 9), (2, None), (3, ""), (4, "same"), (5, "same"), (None, "same"), (5, "same"), (6, "\ufffdA")]
    pages = spark.createDataFrame([(i, None, b"\xffA" if i == 6 else None if t is None else t.encode()) for i, t in texts], "page_id long, url string, html binary")
    taken = []
    monkeypatch.setattr(warc, "write_warc", lambda records, *_: taken.append(records))
    warc.page_records(pages.withColumn("html", F.col("html").cast("string")), "unused")
    plan = taken[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha1(") == 2, plan
    rows = [(r.id, bytes(r.payload).decode(), r.payload_digest, r.record_type, r.refers_to) for r in taken[0].collect()]
    holders = {"": 3, "same": 5, "é" * 9: 1, "\ufffdA": 6}
    want = []
    for i, t in ((i, t or "") for i, t in texts):
        digest = base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
        want.append((i, t, digest, "response", None) if i == holders[t] else (i, t, digest, "revisit", holders[t]))
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_op4_matches_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs, got = read("documents"), run(spark, "op4_sentencepiece").set_index("doc_id")
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        ids = sp.encode(text)
        assert got.loc[doc].tolist() == [len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()]


def test_agenda_on_odd_texts():
    v = sentencepiece_bpe.MergeVocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    odd = ["", " ", "  a  b ", "\ta\nb\r\n", "▁x▁▁", "x²..", "é😀日本 \x00", "e" * 3000, "=" * 2000 + " x" * 3, "a　b", "<0x41></s>", "Ünï ſ K"]
    for text in odd:
        assert v.encode(text) == v.library.encode(text) and v.decode(v.encode(text)) == v.library.decode(v.library.encode(text)), text
    parts = [p for t in odd for p in v.parts(t)]
    assert all(v._merge_short(list(p)) == v._merge_long(list(p)) for p in parts if len(p) < 300)
    rng = np.random.default_rng(0)
    for _ in range(500):
        ids = rng.choice([*v.of_byte, 29871, 300, 278], rng.integers(1, 6)).tolist()
        assert v.decode(ids) == v.library.decode(ids), ids


def test_op5_matches_word_search(spark):
    docs, got = read("documents", MIDDLE), run(spark, "op5_license_scan", MIDDLE).set_index("doc_id")
    total = 0
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
        row = got.loc[doc]
        assert (row.n_words, row.n_base, row.base_labels) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        if places:
            assert (row.first_word, row.last_word) == (min(places)[0], max(places)[0])
        total += len(places)
    assert total > 5


def test_licence_expressions(spark):
    parse = licenses.parse_expression
    assert parse("MIT or Apache-2.0 AND GPL-2.0+ WITH x-1.0 */") == ["mit", "apache-2.0", "gpl-2.0+", "x-1.0", "with", "and", "or"]
    assert parse("(MIT OR ISC) AND BSD-2-Clause)") == ["mit", "isc", "or", "bsd-2-clause", "and"]
    assert parse("MIT and and") == ["mit"] and parse("AND MIT") == [] and parse("(MIT") == [] and parse("") == [] and parse("()") == []
    assert parse("( " * 5000 + "MIT") == [] and len(parse("MIT OR " * 5000 + "MIT")) == 10001
    ok = lambda s: licenses.evaluate_expression(parse(s))
    assert ok("GPL-3.0-only OR MIT") and not ok("GPL-3.0-only AND MIT") and ok("(MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception")
    texts = ["// SPDX-License-Identifier: MIT OR GPL-2.0-only WITH Classpath-exception-2.0 */\ncode", "Released under the MIT License under the mit license.", "SPDX license identifier", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert got[0].tag_licences == ["mit", "gpl-2.0-only with classpath-exception-2.0"] and got[0].accepted and got[0].score == 1.0
    assert [(p.label, p.word) for p in got[1].places] == [("mit", 1), ("mit", 5)] and got[1].score == 0.75
    assert got[2].tag_licences == [] and got[2].accepted is None and got[3].n_words == got[4].n_words == 0


def unit(v):
    return v / np.linalg.norm(v)


def test_op6_matches_all_pairs_cosine(spark):
    rng = np.random.default_rng(1)
    base = [unit(rng.normal(size=24)) for _ in range(150)]
    rows = [x for b in base for x in (b, unit(b + 0.04 * rng.normal(size=24)))]
    hub = [unit(base[0] + 0.01 * rng.normal(size=24)) for _ in range(60)]
    vectors = [[float(np.float32(y)) for y in x] for x in rows + hub + [base[3], base[3] * 2.0]]
    vectors += [None, [], [0.0] * 24, [math.nan] * 24, [math.inf] + [0.0] * 23, [None] * 24, [1.0, 0.0], [2.0, 0.0]]
    table = spark.createDataFrame([(i, v, 0, b"x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, n int, v binary")
    got = embeddings.near_vectors(table, block_rows=16).toPandas().sort_values("vec_id", ignore_index=True)
    n = len(rows) + len(hub) + 2
    m = np.array([unit(np.float32(v).astype(float)) for v in vectors[:n]])
    cosine = m @ m.T
    near = [(i, j) for i, j in itertools.combinations(range(n), 2) if cosine[i, j] >= 0.95] + [(n + 6, n + 7)]
    links = np.bincount(np.array(near).ravel(), minlength=len(vectors))
    assert (got.n_links <= links).all() and got.n_links.sum() >= 0.97 * links.sum()
    exact = classes_of(len(vectors), near)
    assert (got.component_id == exact).mean() > 0.97 and (got.kept == (got.vec_id == got.component_id)).all()
    assert got.n_links[n : n + 6].sum() == 0 and got.component_id[n : n + 6].tolist() == list(range(n, n + 6))


def test_op6_recall_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(400):
        b = unit(rng.normal(size=64))
        o = rng.normal(size=64)
        o = unit(o - (o @ b) * b)
        rows += [b, 0.951 * b + math.sqrt(1 - 0.951**2) * o]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
    assert embeddings.near_vectors(table).where("n_links > 0").count() >= 0.9 * len(rows)


def area(scores, labels):
    ranks = pd.Series(scores).rank()
    good = np.asarray(labels) == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_op7_held_out(spark):
    got = run(spark, "op7_quality", MIDDLE).merge(read("labels", MIDDLE), on="doc_id")
    held = got[got.held_out]
    assert area(held.score.tolist(), held.quality.tolist()) > 0.97
    assert (held.predicted == held.quality).mean() > 0.93 and got.score.between(0, 1).all()
    import zlib

    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()


def test_pairs_in_linear_time_equal_the_double_sum():
    rng = np.random.default_rng(0)
    machine = quality.FactorisationMachine(0.3, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, 4)))
    index, value = quality.features("Some words, some MARKS ### and 12 numbers.\nSome words", 30)
    slow = 0.3 + machine.linear[index] @ value + sum(machine.factors[i] @ machine.factors[j] * x * y for (i, x), (j, y) in itertools.combinations(zip(index, value, strict=True), 2))
    assert machine.raw(index, value) == pytest.approx(slow)


def test_op8_packs_like_one_by_one_best_fit(spark):
    from tokenizers import Tokenizer

    docs, got = read("documents", MIDDLE), run(spark, "op8_best_fit_packing", MIDDLE)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        for k in range(0, len(ids), 2048):
            import zlib

            want[doc, k // 2048] = (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048
    rooms = []
    for n in sorted(got.length, reverse=True):
        open_bins = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if open_bins:
            rooms[min(open_bins)[1]] -= n
        else:
            rooms.append(2048 - n)
    assert got.sequence_id.nunique() == len(rooms)


def test_room_tree():
    rng = np.random.default_rng(0)
    tree, some = packing.RoomTree(100), set()
    for _ in range(3000):
        room = int(rng.integers(0, 101))
        tree.set(room, present := bool(rng.integers(2)))
        (some.add if present else some.discard)(room)
        least = int(rng.integers(0, 101))
        assert tree.tightest(least) == min((x for x in some if x >= least), default=None)


def test_words_are_tokenised_apart_exactly():
    t = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), 50)
    odd = ["", "Don't 'Stop' \"'s\" it's.", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "É́ é x y\x85z", "\x01 a \x01", "ΑΣ İ ß ﬁ", "1234 5.6,7", "..., !? ###x###", "a\x1cb"]
    for _ in range(2):
        ids, ends = t.encode(pa.array(odd))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [t.library.encode(x, add_special_tokens=False).ids for x in odd]
    assert t.by_words and t.by_letters


def test_op9_held_out(spark):
    got = run(spark, "op9_language_id", MIDDLE).merge(read("documents", MIDDLE), on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_folded_kernel_equals_landmark_products():
    texts = ["the cat and the dog", "der hund und die katze", "le chat et le chien", "the house of the man", "das haus und der mann", "la maison et les gens"] * 3
    langs = ["en", "de", "fr"] * 6
    bits = np.stack([langid.presence(t) for t in texts])
    model = langid.fit_ridge(bits, langs, landmarks=6)
    assert model.predict(["the dog of the house", "die katze und das haus", None, "123 !", ""]) [0] == ["en", "de", "und", "und", "und"]
    long = "abcdé " * 60000
    grams = {long.lower()[i : i + n] for n in langid.GRAMS for i in range(600)}
    assert 0 < langid.presence(long).sum() <= len(grams)
    assert (langid.presence(long) == langid.presence(long[:1000])).all()


def slow_signatures(text):
    words = re.sub(r"[^\w]|_", " ", text.lower()).split()
    found = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS and i + 1 < len(words) and words[i + 1] not in spotsigs.ANCHORS:
            chain = [x for x in words[i + 1 :] if x not in spotsigs.ANCHORS][:2]
            if len(chain) == 2:
                found.add((w, *chain))
    return found or {tuple(words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_op10_matches_slow_chains(spark):
    docs = read("documents").sort_values("doc_id", ignore_index=True)
    got = run(spark, "op10_spotsigs").set_index("doc_id")
    for i, text in enumerate(docs.text):
        after = docs.text[(i + 1) % len(docs)]
        cut = len(text) // 2
        edited = text[: len(text) - cut] + after[:cut]
        row, own = got.loc[docs.doc_id[i]], slow_signatures(text)
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(row.fingerprint.split(",")) == len(own) == row.n_spots
        assert row.near_edited == pytest.approx(jaccard(own, slow_signatures(edited))) and row.near_next == pytest.approx(jaccard(own, slow_signatures(after)))


def test_next_over_many_ranges_nulls_and_ties(spark):
    rng = np.random.default_rng(4)
    ids = sorted({int(x) for x in rng.integers(-(10**9), 10**15, 300)} | set(range(50)))
    rows = [(i, f"t{i}") for i in ids] + [(7, "a"), (7, "z"), (None, "none")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(7)
    got = spotsigs.with_next(docs, "id", ["text"], bucket_rows=9).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = {r: order[(k + 1) % len(order)][1] for k, r in enumerate(order)}
    assert {(r.id, r.text): r.next_text for r in got} == want and len(got) == len(rows)
    assert spotsigs.with_next(docs.limit(0), "id", ["text"]).count() == 0


def test_near_pairs_match_all_pairs(spark):
    rng = np.random.default_rng(9)
    vocabulary, anchors = [f"w{i}" for i in range(400)], ["the", "of", "and"]

    def text():
        return [w for _ in range(int(rng.integers(10, 60))) for w in (str(rng.choice(anchors)), str(rng.choice(vocabulary)), str(rng.choice(vocabulary)))]

    texts = []
    for _ in range(40):
        t = text()
        near = list(t)
        near[4] = "changed"
        texts += [" ".join(t), " ".join(near), " ".join(t)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs, members = spotsigs.near_pairs(docs, 0.8)
    sets = [slow_signatures(t) for t in texts]
    group = {r.doc_id: r.class_id for r in members.collect()}
    assert group == {i: min(j for j in range(len(sets)) if sets[j] == s) for i, s in enumerate(sets)}
    reps = sorted(set(group.values()))
    want = {(a, b): jaccard(sets[a], sets[b]) for a, b in itertools.combinations(reps, 2) if jaccard(sets[a], sets[b]) >= 0.8}
    got = {(r.a, r.b): r.similarity for r in pairs.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and want
