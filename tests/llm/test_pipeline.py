"""The pipeline against its stages in plain Python, and the entry without the pipeline's folders."""

import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import numpy as np
import sentencepiece
from vitrine.llm import near_copies, toxicity
from vitrine.llm.queries import tokenizer_path

from test_decontaminate import brute as brute_hits
from test_near_and_repeats import corpus
from test_near_copies import brute_similar

REPO = Path(__file__).resolve().parents[2]


def test_stages_follow_each_other(spark, monkeypatch, tmp_path):
    items = [(0, "one two three four five six seven eight nine ten eleven"), (1, "zebra crossing")]
    base = [(d, t) for d, t in corpus(9, 60) if d is not None and t]
    seen, rows = set(), []
    for d, t in base:
        if d not in seen:
            seen.add(d)
            rows.append((d, t, "en", "s", len(t)))
    rows += [(200, "Such a clown is this idiot of ours", "en", "s", 34), (201, "see " + items[0][1] + " end", "en", "s", 60), (202, "clean words here only", "en", "s", 20), (203, "clean words here only", "en", "s", 20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.Model(["^idiot$"], np.array([9.0]), -3.0)
    monkeypatch.setattr(toxicity, "train", lambda *a, **k: model)
    # Texts of a few words: all pairs are held against each other.
    monkeypatch.setattr(near_copies, "choices", lambda n, s: np.zeros((1, 0), int))
    monkeypatch.setattr(near_copies, "radius", lambda s: 128)

    left = [(r[0], r[1]) for r in rows if "idiot" not in r[1]]
    left = [(d, t) for (d, t), (k, least) in zip(sorted(left), sorted(brute_similar(left))) if d == k == least]
    first, cut = {}, []
    for d, t in left:
        w = t.encode().split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i:i + 13]), d)
    for d, t in left:
        w = t.encode().split()
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i:i + 13])] < d for j in range(i, i + 13)}
        cut.append((d, b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else t))
    clean = [(d, t) for d, t in cut if not brute_hits([(d, t)], items)[0][5]]
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in got) == sorted((d, lib.encode(t)) for d, t in clean) and all(r["same"] for r in got)
    assert {202} <= {d for d, _ in clean} and not {200, 201, 203} & {d for d, _ in clean}


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "substring dedup", "benchmark decontamination", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_odd_documents_go_through_every_stage(spark, monkeypatch, tmp_path):
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "you idiot", None, None, 9), (None, "no id here", "en", "s", 10), (4, "fine words", "en", "s", 10), (4, "fine words", "en", "s", 10),
            (5, "long text " * 30_000, "en", "s", 300_000)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, None), (1, "zebra crossing")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(toxicity, "train", lambda *a, **k: toxicity.Model(["^idiot$"], np.array([9.0]), -3.0))
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {None, 1, 4, 5} and got[1] == 0  # the null and the empty text are copies of each other
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_rest_imports_without_the_pipeline(tmp_path):
    for name in ("vitrine", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(REPO / name) if name != "vitrine" else (tmp_path / name).mkdir()
    for p in (REPO / "vitrine").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "vitrine" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 190 and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}).returncode == 0
