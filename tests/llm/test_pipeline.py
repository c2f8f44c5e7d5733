"""The pipeline, stage by stage, against plain versions of what each stage must keep."""

import re
from collections import Counter

import numpy as np
from llm_tables import FOLDER, documents, plain_encoder
from test_simhash import plain_components, plain_print

import corpus_pipeline
from stayspark.llm import mixing, queries, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0d]+")


def test_stages_keep_what_they_must(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = toxicity.fit_model(docs, queries.toxic_labels(spark, FOLDER))
    marked = toxicity.score_documents(docs, model).collect()
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        result = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert result.dtypes == docs.dtypes
        kept.append((name, docs.collect(), result.collect()))
        docs = result
    assert [name for name, _, _ in kept] == ["toxicity", "exact_dedup", "simhash", "mixing", "packing"]
    for name, before, after in kept:
        if name == "toxicity":
            toxic = {r.doc_id for r in marked if r.toxic}
            assert 0 < len(toxic) < len(before) / 2
            assert sorted(after) == sorted(r for r in before if r.doc_id not in toxic)
        elif name == "exact_dedup":
            first = {}
            for r in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", r.text or ""), r)
            assert sorted(after) == sorted(first.values())
        elif name == "simhash":
            group = plain_components({r.doc_id: plain_print(r.text) for r in before})
            assert sorted(after) == sorted(r for r in before if group[r.doc_id] == r.doc_id)
        elif name == "mixing":
            sizes, taken = Counter(), Counter()
            texts = {r.doc_id: r for r in before}
            for r in before:
                sizes[r.source] += len(WORDS.findall(r.text))
            for r in after:
                assert r.text in texts[r.doc_id].text and r.n_chars == len(r.text)
                taken[r.source] += len(WORDS.findall(r.text))
            want = mixing.targets(dict(sizes), mixing.Mix())
            assert taken == Counter({s: int(n) for s, n in want.items()})
        else:
            plain = plain_encoder()
            want = Counter((r.doc_id, tuple(plain(r.text) + [1])) for r in before)
            assert sum(len(ids) * n for (_, ids), n in want.items()) == sum(r.length for r in after)
            lengths = Counter()
            for r in after:
                lengths[r.sequence_id] += r.length
            assert max(lengths.values()) <= 2048
            assert Counter(
                i for r in after for i in np.frombuffer(r.ids, "<u4").tolist()
            ) == Counter(i for (_, ids), n in want.items() for _ in range(n) for i in ids)


def test_run_gives_the_rows_of_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.columns[:4] == ["doc_id", "start", "length", "doc_tokens"] and rows.count() > 100


def test_near_copies_leave_other_rows_of_their_id(spark):
    said = "one two three four five six"
    docs = documents(spark, [(3, said), (7, said + " "), (7, "nobody else says anything like it")])
    kept = corpus_pipeline.drop_near_copies(spark, docs, FOLDER)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, said), (7, "nobody else says anything like it")]
