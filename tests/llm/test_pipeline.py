"""The corpus pipeline's stages on small tables, against brute force and the library."""

import gc
import random

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import piecefst, quality, simhash

from .test_operators import brute_components, brute_hits, brute_lines, docs, labelled, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(30)
    base, labels, _ = labelled(spark, 160, 31)
    texts = [r.text for r in base.orderBy("doc_id").collect()]
    item = "one two three four five six seven eight nine ten eleven"
    line = "this line of more than forty characters stands in many documents."
    good = [t for t in texts if t and t.endswith(".")]
    near = good[0].split()
    texts += [f"{line}\n{prose(rng, 30)}." for _ in range(6)]
    texts += [" ".join([*near[:58], "changed", near[-1]]), good[0], *(f"{prose(rng, 60)} {item} {prose(rng, 20)}." for _ in range(5)), None, "", "x" * 30_000]
    where = tmp_path_factory.mktemp("sf")
    rows = docs(spark, texts).union(docs(spark, [good[1], good[1]], [None, None]))
    extra = {n: F.lit(n) for n in ("row", "gone", "_gone", "quality_score", "node", "text_")}
    rows.withColumns(extra).write.parquet(f"{where}/documents.parquet")
    labels.write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "encode"]


def test_each_stage_against_brute_force(spark, folder, tmp_path):
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    before = [tuple(r) for r in now.select("doc_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        after = [tuple(r) for r in out.select("doc_id", "text").collect()]
        if name != "encode":
            assert out.columns == columns and all(r[n] == n for r in out.collect() for n in ("row", "gone", "_gone", "quality_score", "node", "text_"))
        if name == "quality":
            score = {(r.doc_id, r.text): r.quality_score for r in quality.score_quality(now.drop("quality_score"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
            want = [x for x in before if score[x] >= 0.5]
        elif name == "line_dedup":
            want = None
            kept = brute_lines(before)
            assert sum(k[2] for k in kept) == sum((t or "").count("\n") + 1 for _, t in before) - sum(t.count("\n") + 1 for _, t in after) - sum(1 for k in kept if k[2] == k[1])
            assert out.where("n_chars <> length(text)").isEmpty()
        elif name == "near_dedup":
            named = sorted(x for x in before if x[0] is not None)
            sets = [set(simhash.shingle_set(t, 5).tolist()) for _, t in named]
            pairs = [(i, j) for i in range(len(named)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
            roots = set(brute_components(pairs, range(len(named))).values())
            want = [named[i] for i in roots] + [x for x in before if x[0] is None]
        elif name == "decontaminate":
            items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            dirty = {h[0] for h in brute_hits(before, items) if h[5] and h[0] is not None}
            assert dirty
            want = [x for x in before if x[0] not in dirty]
        else:
            lib = sentencepiece.SentencePieceProcessor(model_file=piecefst.MODEL_FILE)
            want = before
            assert all(r.token_ids == lib.encode(r.text or "") and r.n_tokens == len(r.token_ids) for r in out.collect())
        if want is not None:
            assert sorted(after, key=str) == sorted(want, key=str)
        assert name in ("encode", "line_dedup") or len(after) < len(before)
        now, before = out, after


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "text", "token_ids", "n_tokens"} <= set(out.columns) and out.count() > 0


def test_run_on_no_documents(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_a_worker_process_keeps_memory_of_one_operator_at_a_time(spark):
    class Taken:
        """Gives the function that would run over batches."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    def alive(kind):
        gc.collect()
        return [x for x in gc.get_objects() if type(x) is kind]

    data = open(piecefst.MODEL_FILE, "rb").read()
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["some words", None])], names=["doc_id", "text"])
    for other in (lambda: list(quality.token_buckets("a word")), lambda: list(simhash.set_fingerprints(Taken())([batch])), lambda: list(simhash.fingerprints(Taken(), 4)([batch]))):
        other()
        before = len(alive(piecefst.Transducer))
        assert piecefst._transducer(data) is piecefst._transducer(data)
        assert len(alive(piecefst.Transducer)) == before + 1 and not any(alive(quality._Buckets))
        other()
        assert len(alive(piecefst.Transducer)) == before
    list(quality.token_buckets(" ".join("".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(120_000))))
    assert max(map(len, alive(quality._Buckets))) <= 50_000
