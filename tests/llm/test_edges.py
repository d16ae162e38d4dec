"""Nulls, empty and long texts, repeated rows, empty tables, clashing columns: no crash, and the rows that the docstrings say."""

import pytest
from pyspark.sql import functions as F

from sievetide.llm import audio, context_mix, line_dedup, mixing, near_dup, packing, pseudonyms, quality, secret_scan, token_counts

NAMED = "score kept copy batch n_lines pii n_tokens bucket own_0 own_3 key seed n block row cap place parts ld_text ld_hash ld_id ld_runs ld_kept rate mix_seed mix_count mix_source pack_key nd_place nd_row qk_0 Perplexity N_Words th held_out".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in NAMED)
LONG = "lorem ipsum dolor sit amet " * 8000
#: Weights with which sources of a few bytes are repeated a few times.
FEW = {None: 1e-5, "s": 1e-4}
EXTRA = tuple(f"x{i}" for i in range(len(NAMED)))
ROWS = [
    (1, None, None, None, None, *EXTRA),
    (None, "some text with words", "en", "s", 3, *[None] * len(NAMED)),
    (None, "some text with words", "en", "s", 3, *[None] * len(NAMED)),
    (2, "", "xx", "s", 0, *EXTRA),
    (3, LONG, "en", "t", len(LONG), *EXTRA),
    (4, LONG, "de", "t", len(LONG), *EXTRA),
    (5, "x" * 200_000, "fr", "t", 200_000, *EXTRA),
    (6, "\n\n \t\r\n", "es", "t", 6, *EXTRA),
    (7, "née ñandú 中文 🎉 \x00 end", "es", "t", 9, *EXTRA),
]


def count(df):
    import public_tokenizers

    return token_counts.count_tokens(df, public_tokenizers.path("word_bpe_49k.json"))


EACH_ROW = {
    "tokens": count,
    "audio": audio.audio_features,
    "quality": quality.judge,
    "near": near_dup.near_duplicates,
    "pack": packing.pack,
    "pseudonyms": lambda df: pseudonyms.pseudonymise(df, "k"),
    "lines": line_dedup.dedup_lines,
    "scores": context_mix.lm_scores,
}
OTHERS = {"mix": mixing.mix, "keep_one": near_dup.keep_one, "keep_good": quality.keep_good, "secrets": lambda df: secret_scan.scan(df)}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("name", EACH_ROW)
def test_every_row_stays(name, odd):
    out = EACH_ROW[name](odd).collect()
    assert len(out) == len(ROWS)
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in ROWS)


def ids(df):
    return sorted(str(r.doc_id) for r in df.collect())


def test_odd_rows(odd):
    # Only words count as good texts here, of which none has fifty that differ.
    assert ids(quality.keep_good(odd)) == []
    assert ids(near_dup.keep_one(odd)) == ["1", "3", "5", "7", "None"]
    # A run of letters is a candidate, and no secret.
    assert [(r.doc_id, r.is_secret) for r in secret_scan.scan(odd).collect()] == [(5, False)]
    mixed = mixing.mix(odd, FEW, budget=3.0).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("copy").cast("int")).alias("most"), F.first("rate").alias("rate")).collect()
    # Repeated rows are repeated alike.
    assert all(r.n == r.most * (2 if r.doc_id is None else 1) for r in mixed) and {r.rate for r in mixed} <= {None, EXTRA[NAMED.index("rate")]}


@pytest.mark.parametrize("name", [*EACH_ROW, *OTHERS])
def test_empty_tables(name, odd):
    assert (EACH_ROW | OTHERS)[name](odd.limit(0)).count() == 0


def test_repeated_rows_are_equal(odd):
    for f in (count, context_mix.lm_scores, audio.audio_features):
        rows = [tuple(r) for r in f(odd).filter("doc_id IS NULL").collect()]
        assert len(rows) == 2 and rows[0] == rows[1]


def test_empty_texts_count_their_end(odd):
    r = context_mix.lm_scores(odd).filter("doc_id = 1").first()
    assert (r.n_tokens, r.n_known) == (1, 1)


def test_extra_columns_come_along(odd):
    given = {"lines": ("n_lines", "n_deleted"), "pack": ("n_tokens", "bucket", "bucket_len", "shard", "batch", "slot"), "pseudonyms": ("pii",)}
    outs = {name: EACH_ROW[name](odd) for name in given} | {"mix": mixing.mix(odd, FEW, budget=3.0), "keep_one": near_dup.keep_one(odd), "keep_good": quality.keep_good(odd), "quality": quality.judge(odd)}
    given |= {"mix": ("copy", "shuffle_key"), "keep_one": (), "keep_good": (), "quality": tuple(f.split(" ")[0] for f in quality.SCHEMA.split(", "))}
    for name, out in outs.items():
        old = [c for c in odd.columns if c.lower() not in given[name]]
        assert out.columns == [*old, *given[name]], name
        for r in out.filter("doc_id = 3").collect():
            assert all(r[c] == EXTRA[NAMED.index(c)] for c in old if c in NAMED), name


def test_repeated_documents_of_a_small_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 7)
    df = spark.createDataFrame([(1, "a", "few"), *[(i, "b" * 50, "many") for i in range(2, 40)]], "doc_id long, text string, source string")
    out = mixing.mix(df, {"few": 1.0, "many": 1.0}, budget=0.5).filter("doc_id = 1").collect()
    assert len(out) > 300 and sorted(r.copy for r in out) == list(range(1, len(out) + 1))


def test_rows_without_an_id_are_dealt_by_text(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    assert packing.pack(df, shard_rows=100).select("bucket", "shard").distinct().count() > 20


def test_stages_take_odd_rows(spark, odd):
    import corpus_pipeline as c

    odd = odd.withColumn("text", F.substring("text", 1, 400))
    for name, stage in c.STAGES:
        out = stage(spark, odd, "")
        assert set(c.COLUMNS) <= set(out.columns) and (name == "pack" or out.columns == list(c.COLUMNS))
        assert ids(out) == {"quality": [], "near_dup": ["1", "3", "5", "7", "None"]}.get(name, ids(out))
        if name in ("line_dedup", "pack"):
            assert len(ids(out)) == len(ROWS)
        assert stage(spark, odd.limit(0), "").count() == 0


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from sievetide import tables

    conf = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn", applicationId="a")))
