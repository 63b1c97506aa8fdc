"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from panelsmith.llm import embeddings, langid, licenses, packing, quality, secret_scan, sentencepiece_bpe, simhash, spotsigs

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, node long, root long, row int, text_hash long, spans int, sigs int, next_text string, length int, part int, size int, score double, _kept int"
LONG = "the word of many words and more. " * 40_000
TEXTS = [(1, "The cat and the dog of the house.", "en"), (1, "The cat and the dog of the house.", "en"), (2, None, None), (3, "", "en"), (4, LONG, "en"), (None, "der Hund und die Katze im Haus", "de"), (5, " \t\n", None), (6, "word", "de"), (7, None, "de"), (8, "\x00 é 日本 😀", None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None if t is None else len(t), 9, "x", 1, 2, 3, 4, 5, 6, "n", 7, 8, 9, 0.5, 1) for i, t, lang in rows], SCHEMA)


def operators(spark):
    machine = quality.fit_machine([(*quality.features("good text here", 14), 1), (*quality.features("### ### ###", 11), 0)])
    model = langid.fit_ridge(__import__("numpy").stack([langid.presence(t) for t in ("the cat", "der hund")]), ["en", "de"])
    return {
        "simhash": lambda d: simhash.simhash_classes(d),
        "wide": lambda d: simhash.simhash_classes(d, **simhash.NEAR_COPIES),
        "secrets": lambda d: secret_scan.scan_secrets(d, RANKS, PATTERN),
        "pieces": lambda d: sentencepiece_bpe.encode_pieces(d, PIECES),
        "licenses": lambda d: licenses.scan_licenses(d),
        "quality": lambda d: quality.score_quality(d, machine),
        "packing": lambda d: packing.pack_documents(d, WORDS),
        "language": lambda d: langid.predict_languages(d, model),
        "spots": lambda d: spotsigs.fingerprints_and_edits(d),
    }


def filters(spark):
    machine = quality.fit_machine([(*quality.features("good text here", 14), 1)])
    model = langid.fit_ridge(__import__("numpy").stack([langid.presence(t) for t in ("the cat", "der hund")]), ["en", "de"])
    return {
        "quality": lambda d: quality.keep_quality(d, machine, 0.0),
        "language": lambda d: langid.keep_identified(d, model),
        "copies": lambda d: simhash.keep_one_of_each(d),
        "secrets": lambda d: secret_scan.redact_secrets(d, RANKS, PATTERN, size_col="n_chars"),
    }


@pytest.mark.parametrize("name", ["simhash", "wide", "secrets", "pieces", "licenses", "quality", "packing", "language", "spots"])
def test_every_row_has_a_result(spark, name):
    operator = operators(spark)[name]
    got = operator(frame(spark, TEXTS)).toPandas()
    pieces = got[got.piece == 0] if name == "packing" else got
    assert len(pieces) == len(TEXTS) and sorted(pieces.doc_id.fillna(-1)) == sorted(-1 if i is None else i for i, _, _ in TEXTS)
    whole = pieces[pieces.doc_id == 1].drop(columns=["sequence_id", "offset"], errors="ignore").astype(str)
    assert len(whole) == 2 and (name == "spots" or len(whole.drop_duplicates()) == 1)
    assert operator(frame(spark, TEXTS).limit(0)).count() == 0


@pytest.mark.parametrize("name", ["quality", "language", "copies", "secrets"])
def test_filters_keep_columns(spark, name):
    docs = frame(spark, TEXTS)
    got = filters(spark)[name](docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    rows = got.collect()
    expected = {"quality": 10, "language": 6, "copies": 6, "secrets": 10}[name]
    assert len(rows) == expected, [(r.doc_id, (r.text or "")[:20]) for r in rows]
    assert filters(spark)[name](docs.limit(0)).count() == 0


def test_learning_from_odd_tables(spark):
    docs = frame(spark, TEXTS)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (4, None, None), (8, 0, 0)], "doc_id long, quality int, toxic int")
    machine = quality.learn_quality(docs, labels)
    assert 0 <= machine.score(None, None) <= 1 and quality.learn_quality(docs.limit(0), labels.limit(0)).score("text", 4) == 0.5
    assert langid.learn_languages(docs.limit(0)).predict(["the"]) == (["und"], [0.0])
    model = langid.learn_languages(docs)
    assert set(model.languages) <= {"en", "de"}
    for empty in (docs.limit(0), docs.withColumn("lang", F.lit(None).cast("string"))):
        nothing = langid.learn_with_floors(empty)
        assert nothing.languages == () and langid.keep_identified(docs, nothing).count() == len(TEXTS)
    # Too few long rows for floors: only texts without a letter go.
    few = langid.learn_with_floors(docs)
    assert langid.keep_identified(docs, few).count() == (6 if few.languages else len(TEXTS))


def test_embeddings_edges(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 0), (2, None, 0), (3, [0.0, 1.0], 0), (4, [-0.0, 1.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(vectors).collect()))
    assert got == [(0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False)]
    assert embeddings.near_vectors(vectors.limit(0)).count() == 0
