"""Shards, the prefix trie and the Merkle manifest against brute force, and on odd tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelsmith.llm import kd_shards, merkle, prefix_trie
from panelsmith.llm.queries import LLM_QUERIES
from panelsmith.llm.ranking import powers, ranked

SMALL = "/root/testdata/sf0.001"
LONG = "many words of a long text " * 30_000


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_ranked_numbers_and_sums_a_key_over_many_tasks(spark):
    factor = 0x9E3779B97F4A7C15
    rng = np.random.default_rng(5)
    rows = [(int(k), int(v), int(t)) for k, v, t in zip(np.where(rng.random(6000) < 0.5, 7, rng.integers(0, 40, 6000)), rng.permutation(6000), rng.integers(-(1 << 62), 1 << 62, 6000), strict=True)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k long, v long, t long").repartition(5)
        got = {(r.k, r.v): r for r in ranked(df, "k", [F.col("v")], running={"s": ("v", 1), "p": ("t", factor)}).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for key in {k for k, _, _ in rows}:
        plain = weighed = 0
        for i, (v, t) in enumerate(sorted((v, t) for k, v, t in rows if k == key)):
            plain, weighed = plain + v, (weighed + t * pow(factor, i, 1 << 64)) % (1 << 64)
            r = got[(key, v)]
            assert (r["rank"], r.s, r.p % (1 << 64)) == (i, plain, weighed)
    assert powers(3, np.array([0, 1, 5])).tolist() == [1, 3, 243]
    assert ranked(df.limit(0), "k", [F.col("v")]).count() == 0


# ---- shards ------------------------------------------------------------------------------------


def slow_coordinate(value):
    if value is None:
        return -1
    return max(0, value) if isinstance(value, int) else int.from_bytes(value.encode()[:7].ljust(7, b"\0"), "big")


def slow_shards(docs, shards, dimensions=("n_chars", "source", "lang")):
    """Shard of each row (doc_id, text, and the dimensions as a dict), by sorting whole nodes."""
    points = [([slow_coordinate(d[c]) for c in dimensions], len((t or "").encode()) + 1, (zlib.crc32((t or "").encode()), i)) for i, t, d in docs]
    widths = [max(1, max(p[0][k] for p in points) - min(p[0][k] for p in points)) for k in range(len(dimensions))]
    out = {}

    def cut(rows, leaves, first):
        if leaves == 1 or not rows:
            out.update(dict.fromkeys(rows, first))
            return
        spread = [(max(points[r][0][k] for r in rows) - min(points[r][0][k] for r in rows)) / w for k, w in enumerate(widths)]
        k = spread.index(max(spread))
        rows = sorted(rows, key=lambda r: (points[r][0][k], points[r][2]))
        goal, sums = sum(points[r][1] for r in rows) * (leaves // 2) / leaves, np.cumsum([points[r][1] for r in rows])
        at = int(np.argmax(sums >= goal))
        n = at + 1 if len(rows) > 1 and sums[at] - goal <= goal - (sums[at] - points[rows[at]][1]) else at
        cut(rows[:n], leaves // 2, first)
        cut(rows[n:], leaves - leaves // 2, first + leaves // 2)

    cut(list(range(len(points))), shards, 0)
    return [out[r] for r in range(len(points))]


@pytest.mark.parametrize("shards", [8, 5, 1])
def test_shards_match_sorting_whole_nodes(spark, shards):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet").sort_values("doc_id", ignore_index=True)
    if shards == 8:
        got = LLM_QUERIES["op11_kd_shards"](spark, SMALL).toPandas()
    else:
        got = kd_shards.kd_shards(spark.read.parquet(f"{SMALL}/documents.parquet"), shards=shards).toPandas()
    got = got.sort_values("doc_id", ignore_index=True)
    rows = [(int(r.doc_id), r.text, {"n_chars": int(r.n_chars), "source": r.source, "lang": r.lang}) for r in docs.itertuples()]
    assert got.shard.tolist() == slow_shards(rows, shards)
    assert got["size"].tolist() == [len(t.encode()) + 1 for t in docs.text] and got.text_crc32.tolist() == [zlib.crc32(t.encode()) for t in docs.text]
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    for _, part in got.groupby("shard"):
        assert part.slot.tolist() == list(range(len(part)))
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == shards and sums.max() - sums.min() <= 3 * got["size"].max()


def odd_docs(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, row int, part int, node long, shard string, size string, `key` int, leaf string"
    return spark.createDataFrame([(i, t, lang, s, n, 1, 2, 3, 4, "s", "z", 5, "l") for i, t, lang, s, n in rows], schema)


ODD = [(1, "the cat", "en", "a", 7), (1, "the cat", "en", "a", 7), (2, None, None, None, None), (None, "", "de", "b", 0), (3, LONG, "en", "a", len(LONG)), (-4, "é 日本", "dé", "", -3), (1 << 40, "x", "en", None, 1), (1 << 40, "x", "en", None, 1)]


def test_shards_of_odd_tables(spark):
    got = kd_shards.kd_shards(odd_docs(spark, ODD), shards=3).toPandas()
    assert sorted(got.doc_id.fillna(-9)) == sorted(-9 if i is None else i for i, *_ in ODD) and set(got.shard) <= {0, 1, 2}
    assert got[got.doc_id == 2]["size"].tolist() == [1] and got[got.doc_id == 2].text_crc32.tolist() == [0]
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert kd_shards.kd_shards(odd_docs(spark, ODD).limit(0), shards=8).count() == 0
    same = odd_docs(spark, [(5, "copy", "en", "a", 4)] * 90 + [(6, "other", "en", "a", 5)] * 10)
    sizes = kd_shards.kd_shards(same, shards=4).groupBy("shard").agg(F.sum("size").alias("b")).toPandas()
    assert len(sizes) == 4 and sizes.b.max() - sizes.b.min() <= 12
    by_target = kd_shards.kd_shards(same, target_bytes=100).groupBy("shard").agg(F.sum("size").alias("b")).toPandas()
    assert len(by_target) == 6 and by_target.b.max() <= 106
    with pytest.raises(ValueError, match="positive"):
        kd_shards.kd_shards(same, shards=0)


# ---- prefix trie -------------------------------------------------------------------------------


def slow_trie(talks):
    """Rows of op12's contract for {conv: [(role, text)]}, by listing every prefix."""
    heads = lambda c: zlib.crc32(str(c).encode()) % 4
    rebuilt = {c: talks.get(c - c % 20, [])[: heads(c)] + own[heads(c) :] for c, own in talks.items()}
    members, last = collections.defaultdict(list), {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    saved, leaves = collections.Counter(), collections.Counter()
    children = collections.Counter(p[:-1] for p in members if p)
    for p in members:
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members[p]) - 1) * words(p)
            leaves[p[:d]] += not children[p]
    ends = collections.defaultdict(list)
    for c, turns in rebuilt.items():
        ends[tuple(turns)].append(c)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], sha(",".join(map(str, sorted(ends[p]))))) for p, m in members.items())


def trie_of(spark, rows):
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, a int, conv string, pos int, depth int").repartition(3)
    turns = prefix_trie.turn_table(talks)
    rebuilt = prefix_trie.graft(turns, lambda c: c - c % 20, lambda c: F.crc32(c.cast("string")) % 4, 3)
    got = prefix_trie.prefix_trie(rebuilt, turns.select("conv"), ["kind", "pos"]).toPandas()
    got.parent_conv_id = got.parent_conv_id.fillna(-1).astype(int)
    return sorted(got.itertuples(index=False, name=None))


@pytest.mark.parametrize(("run_turns", "held"), [(1024, 1 << 17), (3, 10)])
def test_trie_matches_listing_every_prefix(spark, monkeypatch, run_turns, held):
    monkeypatch.setattr(prefix_trie, "RUN_TURNS", run_turns)
    whole = prefix_trie.trie_sums
    monkeypatch.setattr(prefix_trie, "trie_sums", lambda runs, values: whole(runs, values, held))
    rng = random.Random(held)
    talks = {}
    for c in range(0, 260):
        if c % 20 or rng.random() < 0.7:
            n = rng.choice([1, 1, 2, 3, 5, 8, 30])
            talks[c] = [(rng.choice(["user", "bot", ""]), rng.choice(["a b", "a", "", " \t", "é日 x"])) for _ in range(n)]
    for c in (31, 32, 33, 47, 48):
        talks[c] = [("user", "same")] * 40
    rows = [(c, None if d == 0 else d, role or None, text or None, 1, "x", 2, 3) for c, turns in talks.items() for d, (role, text) in enumerate(turns)]
    assert trie_of(spark, rows) == slow_trie(talks)


def test_trie_of_odd_tables(spark):
    rows = [(1, 5, "u", "x", 0, "", 0, 0), (1, 5, "u", "x", 0, "", 0, 0), (None, 0, "u", "lost", 0, "", 0, 0), (3, None, None, None, 0, "", 0, 0), (40, 0, "u", LONG, 0, "", 0, 0)]
    got = trie_of(spark, rows)
    assert got == slow_trie({1: [("u", "x")] * 2, 3: [("", "")], 40: [("u", LONG)]})
    assert trie_of(spark, [(None, 0, "u", "x", 0, "", 0, 0)]) == []


def test_two_fattest_numbers():
    for low in range(40):
        for high in range(low + 1, 70):
            best = prefix_trie.two_fattest(low, high)
            assert low < best <= high and all((n & -n) <= (best & -best) for n in range(low + 1, high + 1))


# ---- manifest ----------------------------------------------------------------------------------


def slow_levels(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        levels.append(nodes)
    return levels


def slow_manifest(rows):
    """{row number: (leaf, subroot, root, proof_sha256, folded_root, verified)} for rows (doc_id, source, lang, n_chars, text)."""
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = [sha("".join(map(shown, r))) for r in rows]
    other = [sha("".join(map(shown, (*r[:3], None if r[3] is None else r[3] + 1, r[4])))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else x for r, x in zip(rows, leaf, strict=True)]
    by_lang = collections.defaultdict(list)
    for i, r in enumerate(rows):
        by_lang[b"" if r[2] is None else b"=" + r[2].encode()].append(i)
    trees = {}
    for lang, members in by_lang.items():
        members.sort(key=lambda i: ((rows[i][0] is not None, rows[i][0] or 0), leaf[i]))
        trees[lang] = slow_levels([leaf[i] for i in members])
    order = sorted(trees)
    top = slow_levels([trees[k][-1][0] for k in order])
    out = {}
    for place, lang in enumerate(order):
        for at, i in enumerate(by_lang[lang]):
            digest, proof = other[i], []
            for levels, p in ((trees[lang], at), (top, place)):
                for nodes in levels[:-1]:
                    sibling = nodes[p ^ 1 : (p ^ 1) + 1]
                    proof += sibling
                    digest = sha("".join([*sibling, digest] if p & 1 else [digest, *sibling]))
                    p >>= 1
            out[i] = (leaf[i], trees[lang][-1][0], top[-1][0], sha("".join(proof)), digest, digest == top[-1][0])
    return out


def manifest(spark, rows, **how):
    docs = odd_docs(spark, [(r[0], r[4], r[2], r[1], r[3]) for r in rows]).repartition(3)
    return merkle.merkle_manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, changes={"n_chars": F.col("n_chars") + 1}, **how).toPandas()


def test_manifest_matches_plain_trees(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["s", None]), "en", rng.choice([None, i]), f"text {i}") for i in range(2500)]
    rows += [(9000 + i, "s", lang, 1, None if i % 3 else "") for lang, n in ((None, 1), ("", 2), ("de", 1024), ("fr", 1025), ("é", 3)) for i in range(n)]
    want, got = slow_manifest(rows), manifest(spark, rows)
    columns = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(got[columns].itertuples(index=False, name=None)) == sorted(want.values())
    assert len(got) == len(rows) and 0.1 < (~got.verified).mean() < 0.2


def test_manifest_of_odd_tables(spark):
    rows = [(i, s, lang, n, t) for i, t, lang, s, n in ODD]
    got = manifest(spark, rows)
    columns = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(got[columns].itertuples(index=False, name=None)) == sorted(slow_manifest(rows).values())
    assert sorted(got.doc_id.fillna(-9)) == sorted(-9 if i is None else i for i, *_ in ODD)
    one = manifest(spark, [(12, "s", "en", 4, "text")])
    assert one.leaf[0] == one.subroot[0] == one.root[0] and one.proof_sha256[0] == sha("")
    assert merkle.merkle_manifest(odd_docs(spark, ODD).limit(0)).count() == 0


def test_versions_share_all_but_a_path(spark):
    rows = [(i, "s", "en" if i < 1500 else "de", i, f"text {i}") for i in range(2000)]
    got = manifest(spark, rows, with_copies=True)
    tampered = got[got.copied.notna()]
    assert len(tampered) == sum(zlib.crc32(str(i).encode()) % 7 == 0 for i in range(2000)) and (tampered.copied.map(lambda c: c[-1]) == tampered.folded_root).all()
    # 1500 leaves: 11 levels, 500: 9 levels; one more above both languages.
    assert set(tampered[tampered.doc_id < 1500].copied.map(len)) == {13} and set(tampered[tampered.doc_id >= 1500].copied.map(len)) == {11}
    tree = merkle.PersistentTree([sha(str(i)) for i in range(11)], False)
    before = [list(level) for level in tree.levels]
    assert tree.version(10, sha("x"))[-1] == slow_levels([*tree.levels[0][:10], sha("x")])[-1][0] and tree.levels == before


def test_rows_not_tampered_are_folded_too(spark, monkeypatch):
    """Their roots come from leaf and siblings: rows whose proofs don't fit are not verified."""
    rows = [(i, "s", "en", i, f"text {i}") for i in range(1100)]
    assert manifest(spark, rows).set_index("doc_id").verified.to_dict() == {i: zlib.crc32(str(i).encode()) % 7 != 0 for i in range(1100)}

    class OneWrong(merkle.PersistentTree):
        """Puts a wrong sibling into the proof of each block's sixth node."""

        def paths(self, above=""):
            found = merkle.PersistentTree.paths(self, above)
            return [p[0] + "0" * 64 + p[65:] if i == 5 else p for i, p in enumerate(found)]

    monkeypatch.setattr(merkle, "PersistentTree", OneWrong)
    got = manifest(spark, rows).set_index("doc_id")
    assert [i for i in range(1100) if zlib.crc32(str(i).encode()) % 7 and not got.verified[i]] == [i for i in (5, 1029) if zlib.crc32(str(i).encode()) % 7] != []
    assert (got.folded_root[~got.verified] != got.root[~got.verified]).all()
