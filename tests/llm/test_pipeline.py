"""The pipeline on a small table: every stage's decisions against brute force over its own input."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_operators import WORDS, brute_repeats, brute_sets, ids_of


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    passage = prose(70)
    base = [prose(rng.choice([60, 90, 150])) for _ in range(40)]
    values = [*base, *base[:5], *(b + " end" for b in base[5:10]), prose(120) + "\n" + passage, passage + "\n" + prose(120), "too short", None, ""]
    rows = [(i, t, "en", "s" + str(i % 2), len(t or ""), "extra") for i, t in enumerate(values)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _doc string")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == columns
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            kept[name] = docs.collect()
    assert sorted(r.doc_id for r in kept["quality_rules"]) == list(range(52))
    ordered = sorted(kept["quality_rules"], key=lambda r: r.doc_id)
    sets = brute_sets([r.text for r in ordered])
    first = [r.doc_id for i, r in enumerate(ordered) if not any(100 * len(sets[i] & s) >= 80 * len(sets[i] | s) for s in sets[:i])]
    assert sorted(r.doc_id for r in kept["ngram_jaccard_join"]) == first == [*range(40), 50, 51]
    ordered = sorted(kept["ngram_jaccard_join"], key=lambda r: r.doc_id)
    want = brute_repeats([r.text for r in ordered], 200)
    left = {r.doc_id: r for r in kept["suffix_array_dedup"]}
    assert {i: len(r.text.encode()) for i, r in left.items()} == {r.doc_id: w[0] - w[1] for r, w in zip(ordered, want)}
    assert all(r.n_chars == len(r.text) for r in left.values()) and len(left[50].text) < len(values[50])
    copies = {}
    for r in kept["mix_sources"]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        assert r.text == left[r.doc_id].text
    assert max(copies.values()) <= 3 and set(copies) <= set(left)
    ids = {r.doc_id: x.tobytes() for r, x in zip(left.values(), ids_of([r.text for r in left.values()], 0))}
    sequences, found = {}, {}
    for r in out.collect():
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        found.setdefault(r.doc_id, []).append(bytes(r.ids))
    assert {i: sorted(x) for i, x in found.items()} == {i: [ids[i]] * n for i, n in copies.items()}
    assert all(sum(n for _, n in parts) <= 2048 for parts in sequences.values())


def test_run(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(80)), "en", "s", 1) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.select(F.countDistinct("doc_id")).first()[0] <= 12 and out.count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "mix_sources", "best_fit_packing"]


def test_stages_on_empty_tables_and_null_sources(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, " ".join(f"v{i}x{j % 97}" for j in range(90 + i)), None, None if i % 2 else "s", None) for i in range(8)] + [(None, " ".join(f"null{j}" for j in range(70)), None, None, 1)]
    for values in ([], rows):
        docs = spark.createDataFrame(values, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"{name}{len(values)}"))
            docs = spark.read.schema(docs.schema).parquet(str(tmp_path / f"{name}{len(values)}"))
            if name != "mix_sources":
                assert docs.count() == len(values)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) and bool(packed) == bool(values)
