"""The pipeline's stages on the smallest tables, each against a brute-force version."""

import sys
from pathlib import Path

import pyarrow as pa
import pytest

import corpus_pipeline
from statespan.llm import language, segmentation

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import item_words, linked  # noqa: E402

DATA = Path("/root/testdata/sf0.001")


def cut_repeats(rows):
    """Whole characters of which every byte is covered by 100 bytes that start earlier."""
    seen, out = {}, {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - 99):
            w = raw[a: a + 100]
            if seen.setdefault(w, (i, a)) != (i, a):
                gone[a: a + 100] = b"\1" * 100
        kept, at = [], 0
        for c in t or "":
            n = len(c.encode())
            if not all(gone[at: at + n]):
                kept.append(c)
            at += n
        out[i] = "".join(kept)
    return out


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_pipeline_is_brute_force(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "suffix_array_dedup", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}

    kept = {}
    predict = language._predict(type("Shared", (), {"value": language.learn(language.training_rows(docs))}), language.LEVEL, language.PIECE_BYTES, False)
    batch = pa.RecordBatch.from_arrays([pa.array(list(texts)), pa.array(list(texts.values()))], names=["row", "text"])
    for b in predict([batch]):
        for r in b.to_pylist():
            if r["lang_pred"] != "und" and r["margin"] >= language.MIN_MARGIN:
                kept[r["row"]] = texts[r["row"]]
    assert len(kept) > 0.95 * len(texts)
    low = linked(list(kept.items()))
    kept = {i: t for i, t in kept.items() if low[i] == i}
    kept = cut_repeats(list(kept.items()))
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = item_words(r.text)
        windows |= {tuple(w[a: a + min(10, len(w))]) for a in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}

    def clean(text):
        w = item_words(text)
        return not any(tuple(w[a: a + k]) in windows for k in sizes for a in range(len(w) - k + 1))

    kept = {i: t for i, t in kept.items() if clean(t)}
    found = corpus_pipeline.run(spark, str(DATA))
    rows = {r.doc_id: r for r in found.collect()}
    assert set(rows) == set(kept)
    tool = segmentation.Segmenter(segmentation.load_pieces(segmentation.default_model()))
    assert all(r.round_trip and tool.decode(r.tokens) == kept[i] for i, r in rows.items())


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(DATA))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_stages_with_odd_rows(spark):
    """Null ids and texts, repeated rows, columns of clashing names, a long text and an empty table."""
    some = spark.read.parquet(f"{DATA}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(12).collect()
    long = " ".join(r.text for r in some) * 20
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in some] + [(None, some[0].text, "en", "s", 1), (None, None, None, None, None), (901, "", "en", "s", 0), (902, long, "en", "s", len(long)), (902, long, "en", "s", len(long)), (903, long + " end", "en", "s", len(long) + 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "1 as _", "2 as other", "3 as row", "4 as runs", "5 as items", "6 as d", "'x' as `Component_id`")
    for given in (docs, docs.limit(0)):
        kept = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, str(DATA))
            assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        out = corpus_pipeline.STAGES[-1][1](spark, kept, str(DATA))
        found = {r.doc_id for r in out.collect()}
        assert found <= {r[0] for r in rows} and (903 not in found) and (given is docs) == bool(found) and 901 not in found
