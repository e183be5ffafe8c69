"""The pipeline's stages, each on its own input, against brute force; and the contract of the queries."""

import collections
import shutil

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def passed(spark, tmp_path_factory):
    """What each stage gets and gives, over planted rows and the small table."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    prose = " ".join(f"word{i % 37}x{i % 11}" for i in range(200))
    near = prose.replace("word5x5", "other")
    odd = [(10_000, None), (10_001, ""), (10_002, "12 34 !?"), (10_003, prose), (10_004, prose), (10_005, near), (10_006, "Write to anna.b@mail.example.com or +1 (269) 555-3296.")]
    more = spark.createDataFrame([(i, t, None, "s1", 0) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [docs.select(COLUMNS).unionByName(more)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, kept[-1], SMALL).write.parquet(path)
        kept.append(spark.read.parquet(path))
    return kept


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_are_the_named_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "pii", "packing"]


def test_all_but_the_last_give_documents(passed):
    assert all(df.columns == COLUMNS for df in passed[:-1])


def test_language_stage_drops_texts_without_a_letter_alone(passed):
    gone = set(rows(passed[0])) - set(rows(passed[1]))
    assert gone == {i for i, r in rows(passed[0]).items() if not r.text or not any(c.isalpha() for c in r.text)} >= {10_000, 10_001, 10_002}


def test_line_stage_keeps_every_document_and_one_of_each_line(passed):
    before, after = rows(passed[1]), rows(passed[2])
    assert set(before) == set(after)
    sites = collections.defaultdict(set)
    for r in before.values():
        for line in r.text.split("\n"):
            sites[line.strip(" ")].add(r.source)
    seen = set()
    for i in sorted(before):
        want = []
        for line in before[i].text.split("\n"):
            bare = line.strip(" ")
            if bare and len(sites[bare]) >= 8:
                if bare in seen:
                    continue
                seen.add(bare)
            want.append(line)
        assert after[i].text == "\n".join(want) and after[i].n_chars == len(after[i].text)


def test_near_copies_leave_one(passed):
    before, after = rows(passed[2]), rows(passed[3])
    assert 10_003 in after and 10_004 not in after and 10_005 not in after
    first = {}
    for i in sorted(before):
        first.setdefault(before[i].text, i)
    # Of equal texts at most one stays, and a text stands for each that is gone.
    assert len({r.text for r in after.values()}) == len(after)

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    kept = [shingles(r.text) for r in after.values()]
    for i in set(before) - set(after):
        mine = shingles(before[i].text)
        assert max(len(mine & k) / len(mine | k) for k in kept) > 0.5


def test_personal_data_stage(passed):
    before, after = rows(passed[3]), rows(passed[4])
    assert set(before) == set(after)
    assert "anna.b@mail" not in after[10_006].text and "555-3296" not in after[10_006].text
    for i, r in before.items():
        if not any(c.isdigit() or c == "@" for c in r.text):
            assert after[i].text == r.text


def test_packing_stage_holds_every_document(passed):
    pieces = passed[5].collect()
    assert {r.doc_id for r in pieces} == set(rows(passed[4]))
    size = collections.Counter()
    for r in pieces:
        size[r.sequence_id] += r.length
    assert max(size.values()) <= 4096


def test_packing_stage_leaves_no_encoder_in_a_worker(spark, tmp_path, monkeypatch):
    """Python workers go on with the next stages, whose memory the encoder and its remembered chunks would take."""
    path = str(tmp_path / "vocabulary.json")  # no other test has an encoder of this path
    shutil.copy(public_tokenizers.path("word_bpe_49k.json"), path)
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(64)], "doc_id long, text string").repartition(8).localCheckpoint()

    def held(batches):
        from matchstrata.llm.vocabulary import encoder

        for batch in batches:
            hits = encoder.cache_info().hits
            encoder(path)
            yield pa.RecordBatch.from_arrays([pa.array([encoder.cache_info().hits - hits])], names=["held"])
            encoder.cache_clear()

    monkeypatch.setattr(public_tokenizers, "path", lambda name: path)
    assert corpus_pipeline.packed(spark, docs, "").count() == 64
    assert {r.held for r in docs.mapInArrow(held, "held long").collect()} == {0}


def test_every_operator_has_one_query():
    names = [k for k in entry.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("key", ["op5_line_site_spread", "op7_maxscore_top5", "op10_cover_tree_duplicates", "op11_angular_hard_negatives", "op12_misra_gries_collocations"])
def test_query_equals_twin(spark, key):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    got = entry.queries()[key](spark, SMALL)
    want = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())


def test_queries_take_the_whole_table(spark):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for key in ("op2_prefix_byte_bpe", "op6_elias_fano_shards", "op8_crf_language"):
        assert entry.queries()[key](spark, SMALL).agg(F.count_distinct("doc_id")).first()[0] == n
