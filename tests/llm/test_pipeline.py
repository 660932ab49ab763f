"""The pipeline's stages on the small table."""
import collections

import corpus_pipeline
from test_operators import kept_rows
from pricemill.llm import pieces, secret_scan


def test_stages(spark, fixture_dir, documents):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    last = corpus_pipeline.STAGES[-1][0]
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, fixture_dir)
        assert name == last or new.columns == docs.columns
        held[name] = rows = [r.asDict() for r in new.collect()]
        if name != last:
            docs = spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema)
    spoken = [d for d in documents if d["text"] and any(c.isalpha() for c in d["text"])]
    foreign = [d for d in spoken if "日本語" in d["text"]]  # in none of the languages that the labels show
    assert len(held["language_id"]) == len(spoken) - len(foreign) and not any("日本語" in r["text"] for r in held["language_id"])
    assert collections.Counter((r["doc_id"], r["text"]) for r in held["ngram_jaccard_join"]) == kept_rows(held["language_id"], 5, 80)
    masked = {r["doc_id"]: r for r in held["secret_scan"]}
    before = collections.defaultdict(set)  # rows that share an id are documents of their own
    for r in held["ngram_jaccard_join"]:
        before[r["doc_id"]].add(r["text"])
    assert set(masked) == set(before)
    for r in held["secret_scan"]:
        if r["text"] not in before[r["doc_id"]]:
            assert any(secret_scan.find(t) for t in before[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    clean = {(i, t) for i, texts in before.items() for t in texts if not secret_scan.find(t)}
    assert clean <= {(r["doc_id"], r["text"]) for r in held["secret_scan"]}
    assert set(r["doc_id"] for r in held["source_mix"]) == set(masked)
    assert all(r["lossless"] for r in held[last]) and len(held[last]) == len(held["source_mix"])
    model = pieces.spellings(pieces.load()).to_pylist()
    for r in held[last][:20]:
        text = b"".join(model[i] for i in r["pieces"])[1:].decode()
        assert text in {x["text"] for x in held["source_mix"] if x["doc_id"] == r["doc_id"]}


def test_run_on_an_empty_table(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).collect() == []
